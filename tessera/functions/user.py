"""Python functions of one's own in the places of Column functions: transforms and label changes.

They run on Arrow batches, with the type of their results declared; no row goes through Python alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators import stats


def of_arrays(function: Callable[..., np.ndarray], returns: str = "double") -> Callable[..., Column]:
    """A function of numpy arrays, each a column's values in a batch, as a function of Columns.

    NULL comes as NaN in arrays of numbers and as None in others; NaN and None go back as NULL.
    """

    def batch(*columns: pd.Series) -> pd.Series:
        made = np.asarray(function(*(c.to_numpy() for c in columns)))
        if made.shape != (len(columns[0]),):
            raise ValueError(f"a function of {len(columns[0])} values gave an array of shape {made.shape}")
        return pd.Series(made)

    batch.__annotations__ = {"columns": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, returns)


def of_values(function: Callable[[object], object], returns: str = "string") -> Callable[[Column], Column]:
    """A function of one value as a function of a Column: called once for each different value of a batch.

    NULL stays NULL, and isn't passed to the function. Its results must depend on the value only.
    """

    def batch(column: pd.Series) -> pd.Series:
        changed = {v: function(v) for v in column.dropna().unique()}
        return pd.Series([None if pd.isna(v) else changed[v] for v in column], dtype=object)

    batch.__annotations__ = {"column": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, returns)


def register_transform(name: str, function: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> None:
    """Let specifications name a transform of arrays (values, lower and upper quantiles; NaN where there is none).

    `name` is the first part of a specification, as in name/uq_0.99_image. A name of the
    engine's own transforms isn't taken.
    """
    if "/" in name or not name:
        raise ValueError(f"a transform's name has no slash and isn't empty: {name!r}")
    if name in BUILT_IN:
        raise ValueError(f"{name!r} is a transform of the engine")
    made = of_arrays(function)
    stats.TRANSFORMS[name] = lambda value, lower, upper: made(value.cast("double"), lower.cast("double"), upper.cast("double"))


BUILT_IN = frozenset(stats.TRANSFORMS)
