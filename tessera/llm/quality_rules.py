"""Operator 4: rule statistics of whole texts and isolation forests over them.

Fixed rules reject very short and repetitive texts. For the others isolation forests,
whose trees are grown on a few rows each, drawn from all labelled ones, give each text its
mean path length over random splits. Each family of rules has a forest of its own: in one over all
rates a text that is odd in one family looks as usual as the many that vary in the others.
The score from which a text counts as anomalous is calibrated on all labelled rows for each
forest, so that hardly any good row is lost; a forest that can't tell bad rows from good
ones rejects nothing.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch, aside, prepare, tasks_of, values_at
from tessera.llm.textblocks import Block, blocks, mix

#: An isolation tree is grown on so many rows, drawn by chance from all; that is the method, not a bound on the input.
TREES, TREE_ROWS = 100, 256
#: Share of good labelled rows that a forest's threshold may reject, and the share of bad
#: ones that it must reject to be used.
LOST_SHARE, LEAST_CAUGHT = 0.001, 0.05
#: The columns of `features` by family of rules: symbols, form of words, repetition.
FAMILIES = {"symbols": [0, 1], "form": [2, 5], "repetition": [3, 4]}

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_upper", "n_exclaim", "n_line_words"]


def block_stats(block: Block) -> dict[str, np.ndarray]:
    """The counts of each text of a block."""
    texts, data = len(block), block.data

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return np.diff(sums[block.offsets])

    code_point = (data & 0xC0) != 0x80
    out = {
        "n_words": block.n_words,
        "word_chars": per_text(~block.blank & code_point),
        "n_symbols": per_text(SYMBOL[data]),
        "n_upper": per_text(UPPER[data]),
        "n_exclaim": per_text(data == 33),
    }

    # Lines with a word; one that equals an earlier line of its text counts as repeated.
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([block.offsets[:-1], breaks + 1])
    text = np.concatenate([np.arange(texts), np.searchsorted(block.offsets, breaks, "right") - 1])
    order = np.lexsort((starts, text))
    starts, text = starts[order], text[order]
    ends = np.concatenate([starts[1:], block.offsets[-1:]])
    same = np.concatenate([text[1:] == text[:-1], [False]]) if texts else np.zeros(0, bool)
    ends = np.where(same, ends - 1, block.offsets[1:][text] if texts else ends[:0])
    filled = np.concatenate([[0], np.cumsum(~block.blank)])
    worded = filled[ends] > filled[starts]
    starts, ends, text = starts[worded], ends[worded], text[worded]
    _, at = np.unique(mix(block.span_hashes(starts, ends) + mix(text.astype(np.uint64))), return_index=True)
    lines = np.bincount(text, minlength=texts)
    out["n_dup_lines"] = lines - np.bincount(text[at], minlength=texts)
    out["n_line_words"] = lines

    # Words that a five-word window found twice or more in the text covers.
    at, found = block.windows(5)
    owner = np.searchsorted(block.word_offsets, at, "right") - 1
    _, which, times = np.unique(mix(found + mix(owner.astype(np.uint64))), return_inverse=True, return_counts=True)
    twice = at[times[which] > 1]
    cover = np.bincount(twice, minlength=len(block.starts) + 6) - np.bincount(twice + 5, minlength=len(block.starts) + 6)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover) > 0)])
    out["n_repeat_words"] = np.diff(covered[block.word_offsets])
    return out


def text_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    parts = [block_stats(block) for _, block in blocks(texts)]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in BASE + MORE}


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """The rates that the forests split on."""
    words = np.maximum(1, stats["n_words"])
    chars = np.maximum(1, stats["word_chars"])
    return np.column_stack([
        stats["n_symbols"] / words,
        stats["n_exclaim"] / words,
        stats["n_upper"] / chars,
        stats["n_dup_lines"] / np.maximum(1, stats["n_line_words"]),
        stats["n_repeat_words"] / words,
        stats["word_chars"] / words,
    ])


def _usual_path(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, n - 1)


class IsolationForest:
    """Random trees; `score` is near 1 for rows that few splits set apart, and below 0.5 for usual ones."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.rows = min(tree_rows, len(rows))
        self.trees = []
        for _ in range(trees):
            nodes: list[list[float]] = []  # feature or -1, cut, left, right, path length
            self._grow(rows[rng.choice(len(rows), self.rows, replace=False)], 0, nodes, rng)
            self.trees.append(np.array(nodes))

    def _grow(self, rows: np.ndarray, depth: int, nodes: list, rng: np.random.Generator) -> int:
        me = len(nodes)
        nodes.append([-1, 0, 0, 0, depth + float(_usual_path(len(rows)))])
        low, high = rows.min(0), rows.max(0)
        able = np.flatnonzero(high > low)
        if len(rows) > 1 and len(able) and depth < np.ceil(np.log2(self.rows)):
            feature = rng.choice(able)
            cut = rng.uniform(low[feature], high[feature])
            left = rows[:, feature] < cut
            nodes[me][:2] = [feature, cut]
            nodes[me][2] = self._grow(rows[left], depth + 1, nodes, rng)
            nodes[me][3] = self._grow(rows[~left], depth + 1, nodes, rng)
        return me

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        each = np.arange(len(rows))
        for tree in self.trees:
            at = np.zeros(len(rows), int)
            while True:
                feature = tree[at, 0].astype(int)
                inner = feature >= 0
                if not inner.any():
                    break
                left = rows[each, np.maximum(feature, 0)] < tree[at, 1]
                at = np.where(inner, np.where(left, tree[at, 2], tree[at, 3]).astype(int), at)
            total += tree[at, 4]
        return 2 ** (-total / len(self.trees) / max(1e-9, float(_usual_path(self.rows))))


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])


class Rule(NamedTuple):
    """One family's forest and the score beyond which a text is anomalous."""

    columns: list[int]
    forest: IsolationForest
    threshold: float

    def excess(self, rates: np.ndarray) -> np.ndarray:
        return self.forest.score(rates[:, self.columns]) - self.threshold


class Model(NamedTuple):
    rules: list[Rule]

    def excess(self, stats: dict[str, np.ndarray]) -> np.ndarray:
        """How far the most anomalous family's score is beyond its threshold; below 0 for usual texts."""
        rates = features(stats)
        return np.max([np.full(len(rates), -1.0), *(r.excess(rates) for r in self.rules)], axis=0)


def _threshold(lowest: float, bad: int, beyond: int, first: float | None) -> float | None:
    """Midway between the good rows' limit and the first bad row beyond it; None if too few bad ones are."""
    if not bad:
        return lowest
    return (lowest + first) / 2 if beyond and beyond >= LEAST_CAUGHT * bad else None


def _limit_rank(good: int, bad: int) -> int:
    """The place, in order, of the good row's score that is the limit: LOST_SHARE is beyond, or none without bad rows."""
    return int(np.ceil((good - 1) * (1 - LOST_SHARE))) if bad else good - 1


def calibrated(good: np.ndarray, bad: np.ndarray) -> float | None:
    """The threshold for scores of rows labelled good and bad, or None if it would reject too few bad ones.

    It lies midway between what LOST_SHARE of the good rows is beyond and the first bad
    row beyond that; without bad rows it is the highest score of a good one.
    """
    lowest = float(np.sort(good)[_limit_rank(len(good), len(bad))])
    beyond = bad[bad > lowest]
    return _threshold(lowest, len(bad), len(beyond), float(beyond.min()) if len(beyond) else None)


def calibrated_rows(scored: DataFrame, name: str, bad: int) -> float | None:
    """The same of the scores `name` of scored(quality, ...), wherever its rows are."""
    lowest = values_at(scored.where("quality = 1"), name, lambda n: [_limit_rank(n, bad)])[0]
    beyond = scored.where("quality <> 1").where(F.col(name) > lowest).agg(F.count("*").alias("n"), F.min(name).alias("first")).first()
    return _threshold(lowest, bad, beyond["n"], beyond["first"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Forests and the scores from which a text is anomalous, from all labelled rows.

    Texts become counts before they meet their labels, so no text is shuffled. The rows that
    trees draw from, TREES * TREE_ROWS of them, are picked by a hash; thresholds are exact
    order statistics of all rows' scores. None without rows labelled good: then only the
    fixed rules decide.
    """
    spark = docs.sparkSession
    wanted = labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("quality")).dropna().dropDuplicates(["id"])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            made = text_stats(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(made[k]) for k in BASE + MORE)], ["id", *BASE, *MORE])

    columns = ", ".join(f"{k} long" for k in BASE + MORE)
    scratch = Scratch(spark)
    known = texts.mapInArrow(run, f"id {kind}, {columns}").join(wanted, "id").drop("id").dropDuplicates()
    judged = scratch.keep(known.where("n_words >= 10 and 100 * n_repeat_words <= 20 * n_words").repartition(tasks_of(spark), *BASE, *MORE), "judged")
    counts = {bool(r["good"]): r["n"] for r in judged.groupBy((F.col("quality") == 1).alias("good")).agg(F.count("*").alias("n")).collect()}
    good, bad = counts.get(True, 0), counts.get(False, 0)
    if not good:
        return None
    drawn = F.xxhash64(*BASE, *MORE, "quality")
    # hashes below a bound that about twice as many rows are below: no task sends many more than its share
    bound = int(min(1.0, 2 * TREES * TREE_ROWS / (good + bad)) * (1 << 30))
    pool = judged.where(F.pmod(drawn, F.lit(1 << 30)) < bound).orderBy(F.pmod(drawn, F.lit(1 << 30)), *BASE, *MORE, "quality").limit(TREES * TREE_ROWS).toPandas()
    rates = features({k: pool[k].to_numpy() for k in BASE + MORE})
    forests = {f"score_{name}": (columns, IsolationForest(rates[:, columns])) for name, columns in FAMILIES.items()}

    def scores(batches):
        for batch in batches:
            each = features({k: batch.column(k).to_numpy() for k in BASE + MORE})
            made = [pa.array(forest.score(each[:, columns])) for columns, forest in forests.values()]
            yield pa.RecordBatch.from_arrays([batch.column("quality"), *made], ["quality", *forests])

    scored = scratch.keep(judged.mapInArrow(scores, "quality int, " + ", ".join(f"{n} double" for n in forests)), "scored")
    rules = []
    for name, (columns, forest) in forests.items():
        if (threshold := calibrated_rows(scored, name, bad)) is not None:
            rules.append(Rule(columns, forest, threshold))
    scratch.drop("judged", "scored")
    return Model(rules)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the counts of BASE, base_failed, anomaly and kept.

    anomaly is how far the most anomalous family's score is beyond its threshold (not
    kept), or below it. Words are runs of bytes other than ASCII white space; a null text
    has no words and fails the fixed rules, as every text under ten words. Lines end at
    line feeds. Repeated rows are judged alike, whatever their ids; null ids have no label;
    an id labelled twice has one of its labels. An empty table gives no rows, and without
    labels only the fixed rules decide. Columns of docs that have these names already come
    back with _input behind them.
    """
    spark = docs.sparkSession
    prepare(spark)
    model = fit(docs, labels, id_col, text_col)
    docs, text_col = aside(docs, [*BASE, "base_failed", "anomaly", "kept"], text_col)
    at = docs.columns.index(text_col)
    names = docs.columns

    def run(batches):
        for batch in batches:
            stats = text_stats(batch.column(at))
            failed = base_failed(stats)
            scores = model.excess(stats) if model else np.full(len(failed), -1.0)
            kept = ~failed & (scores <= 0)
            made = [*(pa.array(stats[k].astype(np.int64)) for k in BASE), pa.array(failed), pa.array(scores), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, *BASE, "base_failed", "anomaly", "kept"])

    old = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{old}, " + ", ".join(f"{k} long" for k in BASE) + ", base_failed boolean, anomaly double, kept boolean")
