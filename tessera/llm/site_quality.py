"""Operator 6: document quality by a classifier's evidence and hierarchical site rates.

A logistic model over the rates of the quality rules gives a text's own evidence. Labelled
rows also give each host and each of its paths a share of good texts; shares of sparse
sites are drawn towards the level above: a path's towards its host's, a host's towards the
global one, each with the strength that the spread between sites shows. Both add up on the
scale of log-odds. Rows are dealt into folds by their ids, and each is judged by the labels
of the other folds, so that no row's own label is in its site's rates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.quality_rules import BASE, MORE, features, text_stats
from tessera.llm.shared import bounded_sample, aside, prepare

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE_ROWS = 8_000
RIDGE = 1.0
KEPT_FROM = 0.5
#: Folds of rows.
FOLDS = 4
#: Bounds of the strength (in rows) with which a level draws its sites.
STRENGTH = (2.0, 200.0)


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (bias first) of a ridge logistic regression, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    w[0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        bend = (x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        step = np.linalg.solve(bend, x.T @ (y - p) - RIDGE * w)
        size = np.abs(step).max()
        w += step / max(1, size)
        if size < 1e-8:
            break
    return w


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _stats(known: DataFrame):
    def run(batches):
        for batch in batches:
            made = text_stats(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("quality"), *(pa.array(made[k]) for k in BASE + MORE)], ["quality", *BASE, *MORE])

    return known.mapInArrow(run, "quality int, " + ", ".join(f"{k} long" for k in BASE + MORE)).dropDuplicates().toPandas()


def fold_of(key: Column) -> Column:
    """0 to FOLDS - 1 by the id; rows without an id, which have no label, are in the first."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS)).cast("int"), F.lit(0))


def _drawn(rates: DataFrame, prior: Column) -> DataFrame:
    """rates(fold, good, n and what the prior needs) with `rate`: the share drawn towards the prior.

    The strength is the prior's variance over the variance between sites beyond chance
    (method of moments over all sites of a fold), within STRENGTH.
    """
    share = F.col("good") / F.col("n")
    moments = rates.groupBy("fold").agg(
        F.sum(F.col("n") * (share - prior) ** 2).alias("seen"), F.sum(prior * (1 - prior)).alias("chance"), F.sum("n").alias("n")
    )
    between = F.greatest((F.col("seen") - F.col("chance")) / F.col("n"), F.lit(1e-6))
    strength = moments.select("fold", F.least(F.greatest(F.col("chance") / F.greatest(F.col("n"), F.lit(1)) / between, F.lit(STRENGTH[0])), F.lit(STRENGTH[1])).alias("strength"))
    drawn = rates.join(F.broadcast(strength), "fold")  # a row for each fold
    return drawn.withColumn("rate", (F.col("good") + F.col("strength") * prior) / (F.col("n") + F.col("strength"))).drop("strength")


def site_rates(docs: DataFrame, labels: DataFrame, host: str, path: str, id_col: str) -> tuple[DataFrame, DataFrame, list[float]]:
    """(fold, host, host_rate), (fold, host, path, path_rate) and the global share of each fold.

    They are from all labelled rows of the other folds.
    """
    known = labels.select(id_col, F.col("quality").cast("int").alias("quality")).dropna().dropDuplicates([id_col])
    sites = docs.select(id_col, F.col(host).alias("host"), F.col(path).alias("path")).join(known, id_col)
    own = sites.groupBy("host", "path", fold_of(F.col(id_col)).alias("own")).agg(F.sum("quality").alias("good"), F.count("*").alias("n"))
    others = own.withColumn("fold", F.explode(F.filter(F.array(*[F.lit(f) for f in range(FOLDS)]), lambda f: f != F.col("own"))))
    paths = others.groupBy("fold", "host", "path").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    hosts = paths.groupBy("fold", "host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    totals = {r["fold"]: (r["good"], r["n"]) for r in hosts.groupBy("fold").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).collect()}
    shares = [(good + 1) / (n + 2) for good, n in (totals.get(f, (0, 0)) for f in range(FOLDS))]
    by_host = _drawn(hosts, F.get(F.array(*map(F.lit, shares)), F.col("fold"))).select("fold", "host", F.col("rate").alias("host_rate"))
    upper = by_host.select(F.col("fold").alias("f"), F.col("host").alias("h"), "host_rate")
    named = paths.join(upper, (F.col("fold") == F.col("f")) & F.col("host").eqNullSafe(F.col("h"))).drop("f", "h")
    by_path = _drawn(named, F.col("host_rate")).select("fold", "host", "path", F.col("rate").alias("path_rate"))
    return by_host, by_path, shares


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with doc_score, host_rate, path_rate, quality_score (0 to 1) and kept.

    A path or host without labelled rows gets the rate of the level above. Null hosts and
    paths are sites of their own. Null and empty texts count as texts without words.
    Without labels, all rates are one half; null ids have no label. Repeated rows are judged
    alike; an empty table gives no rows. Columns of docs that have these names already, or
    those of working columns (h1, h2, p2, f1, f2, fold), come back with _input behind them.
    """
    spark = docs.sparkSession
    prepare(spark)
    wanted = labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("quality")).dropna().dropDuplicates(["id"])
    wanted = bounded_sample(wanted, F.col("id"), SAMPLE_ROWS)
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(wanted), "id").select("quality", "text")
    got = _stats(known).sort_values([*BASE, *MORE, "quality"])
    rates = features({k: got[k].to_numpy() for k in BASE + MORE})
    scale = rates.std(0) + 1e-9 if len(rates) else np.ones(rates.shape[1])
    weights = fit_logistic(rates / scale, got["quality"].to_numpy().astype(float))
    by_host, by_path, shares = site_rates(docs, labels, host, path, id_col)

    docs, host, path, text_col, id_col = aside(docs, ["doc_score", "host_rate", "path_rate", "quality_score", "kept", "h1", "h2", "p2", "f1", "f2", "fold"], host, path, text_col, id_col)
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches):
        for batch in batches:
            z = weights[0] + features(text_stats(batch.column(at))) / scale @ weights[1:]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [*names, "doc_score"])

    old = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs.mapInArrow(run, f"{old}, doc_score double").withColumn("fold", fold_of(F.col(id_col)))
    hosts = by_host.withColumnsRenamed({"fold": "f1", "host": "h1"})
    paths = by_path.withColumnsRenamed({"fold": "f2", "host": "h2", "path": "p2"})
    same_path = (out["fold"] == paths["f2"]) & out[host].eqNullSafe(paths["h2"]) & out[path].eqNullSafe(paths["p2"])
    out = out.join(paths, same_path, "left").drop("f2", "h2", "p2")
    out = out.join(hosts, (F.col("fold") == hosts["f1"]) & F.col(host).eqNullSafe(hosts["h1"]), "left").drop("f1", "h1")
    share = F.get(F.array(*map(F.lit, shares)), F.col("fold"))
    out = out.withColumn("host_rate", F.coalesce("host_rate", share))
    out = out.withColumn("path_rate", F.coalesce("path_rate", "host_rate"))
    odds = _logit(F.least(F.greatest("doc_score", F.lit(1e-12)), F.lit(1 - 1e-12))) + _logit(F.col("path_rate")) - _logit(share)
    return out.withColumn("quality_score", 1 / (1 + F.exp(-odds))).withColumn("kept", F.col("quality_score") >= KEPT_FROM).drop("fold")
