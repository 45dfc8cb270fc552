"""Operator 3: allow and block rules for URLs by a sort-merge range join.

A host is written with its labels reversed (`com/example/www/`; no host holds a slash), so that a
rule for a host and all its subdomains is an interval of such keys, and nested rules are nested
intervals. Rules and URLs are dealt into the same ranges of keys; within a range, one sweep over the
sorted keys keeps the stack of the hosts whose intervals are open. Each has its rules by path, so
that a URL costs a look-up for each open host and length of its paths, however many they are.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import bucket_of, aside, cut_points, prepare

#: Sorts behind every key that begins with the host's.
AFTER = "\U0010ffff"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? or #; empty if there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "/"), F.lit("/"))


class _Host:
    """The rules of one host whose interval is open."""

    def __init__(self, key: str):
        self.key, self.rules, self.lengths = key, {}, []

    def add(self, path: str, rule: str, verdict: str) -> None:
        self.rules[path] = (rule, verdict)
        if len(path) not in self.lengths:
            self.lengths = sorted([*self.lengths, len(path)], reverse=True)

    def longest(self, path: str) -> tuple[int, int, str, str] | None:
        """(length of the rule, length of the host's key, rule, verdict) of the longest path that `path` begins with."""
        for n in self.lengths:
            found = self.rules.get(path[:n]) if n <= len(path) else None
            if found:
                return len(found[0]), len(self.key), *found
        return None


def _sweep(rows: list[str]):
    """Rows come sorted by bucket, key and kind: rules (kind 0) before URLs (kind 1)."""

    def run(batches):
        bucket, stack = None, []
        for batch in batches:
            columns = {name: batch.column(name).to_pylist() for name in ("bucket", "key", "kind", "host", "path", "rule", "verdict")}
            rules, verdicts, urls = [], [], []
            for i, (b, key, kind) in enumerate(zip(columns["bucket"], columns["key"], columns["kind"], strict=True)):
                if b != bucket:
                    bucket, stack = b, []
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1].key != key:
                        stack.append(_Host(key))
                    stack[-1].add(columns["path"][i], columns["rule"][i], columns["verdict"][i])
                    continue
                path = columns["path"][i]
                best = max((f for f in (host.longest(path) for host in stack) if f), default=None)
                urls.append(i)
                rules.append(best and best[2])
                verdicts.append(best and best[3])
            kept = batch.take(pa.array(urls, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(kept.column(n) for n in rows), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], [*rows, "rule", "verdict"]
            )

    return run


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (null where none fits) and verdict (the rule's, else `default`).

    rules(host, path, verdict): a rule fits its host and its subdomains if the URL's path
    starts with the rule's. The longest rule string (host and path) wins, among equally
    long ones the one with the longer host, then the greater string; a rule given twice
    counts once, and two verdicts for one rule are an error of the caller's: block wins.
    Null URLs and URLs without :// have an empty host and path, which no rule fits.
    Repeated pages come back repeated, null ids as any; an empty table gives no rows, and
    without rules every page gets the default. Columns of pages named like these, or like
    bucket, key, kind and salt, come back with _input behind their names.

    Cuts between ranges come from a bounded sample of keys and a hash of the page, so a
    host or URL that many pages share is spread over several ranges; a rule goes to each
    range that its interval meets.
    """
    spark = pages.sparkSession
    prepare(spark)
    pages, id_col, url_col = aside(pages, ["host", "path", "rule", "verdict", "bucket", "key", "kind", "salt"], id_col, url_col)
    old = pages.columns
    urls = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    urls = urls.withColumns({"key": reversed_host(F.col("host")), "salt": F.xxhash64(id_col, url_col), "kind": F.lit(1)})
    points = cut_points(urls, ["key", "salt"], max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    urls = urls.withColumns({"bucket": bucket_of(points, ["key", "salt"]), "rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})

    heads = rules.select("host", "path", "verdict").dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    heads = heads.withColumns({"key": reversed_host(F.col("host")), "rule": F.concat("host", "path"), "kind": F.lit(0), "salt": F.lit(None).cast("long")})
    first_keys = F.array(*[F.lit(p[0]) for p in points]) if points else F.array().cast("array<string>")
    low = F.size(F.filter(first_keys, lambda k: k < F.col("key")))
    high = F.size(F.filter(first_keys, lambda k: k <= F.concat("key", F.lit(AFTER))))
    heads = heads.withColumn("bucket", F.explode(F.sequence(low, high)))
    both = urls.unionByName(heads, allowMissingColumns=True).repartition("bucket").sortWithinPartitions("bucket", "key", "kind")
    kept = [*old, "host", "path"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields), "host string, path string, rule string, verdict string"])
    return both.mapInArrow(_sweep(kept), schema).withColumn("verdict", F.coalesce("verdict", F.lit(default)))
