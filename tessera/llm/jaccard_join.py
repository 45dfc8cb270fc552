"""Operator 1: all pairs of texts with a Jaccard similarity of word n-grams, by PartEnum.

Sets of sizes r <= s with a similarity of at least t differ in few elements, so sizes fall
into bands in which only equal or neighbouring bands can link, and each band has a largest
difference k. The domain of shingles is cut by a hash into first-level partitions, each of
these into second-level ones; a set's signatures are its projections on subsets of the
second-level partitions. With n1 * (k2 + 1) > k, two linked sets differ by at most k2 in
some first-level partition, and so agree on some subset of n2 - k2 of its parts.

An agreement on an empty projection says nothing, so those give no signature. To stay
exact, a set in which too many projections are empty (it could owe a link to them alone)
also gives signatures under the next of several hashes, and under the last one its empty
ones too. Both ends of an endangered link are such sets, so they meet there.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shared import Scratch, bounded_sample, prepare
from tessera.llm.textblocks import ODD, blocks, mix

#: Up to this difference, subsets of two of three second-level partitions; beyond, subsets of
#: one. Two of three in every band made 25.1 million signatures of 51,000 texts instead of 15.3,
#: shared by more sets instead of fewer: what texts share by chance, the bitmaps tell anyway.
FINE_K = 8
#: Hashes that sets with many empty projections go on to.
SEEDS = 6
#: A signature that so many of SAMPLE sampled sets share is salted: at most SAMPLE / HOT
#: groups of near copies have such signatures, so their list is small.
HOT, SAMPLE, SALTS = 100, 20_000, 16
#: Other pivots of a bucket that its sets are compared with before the rest of the pairs is.
OTHER_PIVOTS = 2
#: Longs of a set's bitmap.
BITMAP = 16
#: Keys that a task remembers to skip the signatures of copies.
SEEN = 200_000
#: Parts of the star of one set that is compared with many.
STAR_SALTS = 32
#: Sets whose common shingles a task finds by itself.
TOGETHER = 100


class Bands:
    """Size bands for links of at least percent / 100, and the largest difference in each."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("the similarity must be from 50 to 100 percent")
        self.percent, self.first = percent, [1]

    def _grow(self, size: int) -> None:
        while self.first[-1] <= size:
            self.first.append(self.first[-1] * 100 // self.percent + 1)

    def band(self, size: int) -> int:
        """The band of a set of that size; linked sets are at most one band apart."""
        self._grow(size)
        return int(np.searchsorted(self.first, size, "right")) - 1

    @functools.lru_cache(maxsize=4096)  # noqa: B019
    def plan(self, band: int) -> tuple[int, int, int]:
        """(k, n1, empty projections that do no harm) for sets of this band and the one below."""
        self._grow(self.first[min(band, len(self.first) - 1)])
        while len(self.first) < band + 2:
            self.first.append(self.first[-1] * 100 // self.percent + 1)
        low, high = self.first[max(0, band - 1)], self.first[band + 1] - 1
        k = 0
        for both in (2 * high, 2 * high - 1):  # the largest sums give the largest difference
            k = max(k, both - 2 * -(-self.percent * both // (100 + self.percent)))
        if k == 0:
            return 0, 0, 0
        if k <= FINE_K:
            return k, k // 2 + 1, 0
        expected = (k + 1) * np.exp(-low / (k + 1))
        spare = int(np.ceil(expected + 2 * np.sqrt(expected)))
        return k, k + 1 + spare, spare


def signatures(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """The distinct signatures of one set of 64-bit shingles."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    out = []
    own = bands.band(len(shingles))
    for band in (own, own + 1):
        k, n1, harmless = bands.plan(band)
        if k == 0:
            continue
        fine = k <= FINE_K
        parts = 3 if fine else 1
        for seed in range(SEEDS):
            label = np.uint64(((band * SEEDS + seed) * 2 + 1) * int(ODD) % (1 << 64))
            h = mix(shingles + label)
            part = ((h >> np.uint64(32)) % np.uint64(n1 * parts)).astype(np.int64)
            value = mix(h)
            low = np.bincount(part, (value & np.uint64(0xFFFFFFFF)).astype(float), n1 * parts)
            high = np.bincount(part, (value >> np.uint64(32)).astype(float), n1 * parts)
            sums = (mix(low.astype(np.uint64)) + high.astype(np.uint64) * ODD).reshape(n1, parts)
            filled = (np.bincount(part, minlength=n1 * parts) > 0).reshape(n1, parts)
            if fine:
                chosen = [(sums[:, i] + mix(sums[:, j] + np.uint64(i)), filled[:, i] | filled[:, j]) for i, j in itertools.combinations(range(3), 2)]
            else:
                chosen = [(sums[:, 0], filled[:, 0])]
            endangered = False
            for which, (sums_of, some) in enumerate(chosen):
                where = np.arange(n1, dtype=np.uint64) * np.uint64(4) + np.uint64(which)
                signature = mix(mix(where + label) + sums_of)
                last = seed == SEEDS - 1
                out.append(signature if last else signature[some])
                endangered |= np.count_nonzero(~some) > harmless
            if not endangered:
                break
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, np.int64)


def set_key(shingles: np.ndarray) -> int:
    """64 bits that stand for the whole set."""
    with np.errstate(over="ignore"):
        total = mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles)) * ODD
    return int(mix(np.array([total]))[0].view(np.int64)) if len(shingles) else 0


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """BITMAP longs of parities of how many shingles fall on each bit: bits that differ come from shingles that differ."""
    odd = np.bincount((shingles % np.uint64(BITMAP * 64)).astype(np.int64), minlength=BITMAP * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    for _, block in blocks(texts, lower=True):
        yield from block.shingle_sets(size)


def _keyed(size: int):
    def run(batches):
        for batch in batches:
            keys, sizes, bits = [], [], []
            for s in _sets(batch.column("text"), size):
                keys.append(set_key(s))
                sizes.append(len(s))
                bits.append(bitmap(s) if len(s) else None)
            made = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hash"), *made], ["id", "hash", "key", "n_shingles", "bits"])

    return run


def _signed(size: int, percent: int, hot: np.ndarray):
    def run(batches):
        bands, seen = Bands(percent), set()
        for batch in batches:
            keys, found, rows = [], [], 0
            for s in _sets(batch.column("text"), size):
                key = set_key(s)
                if key in seen:  # copies in the same task; the others meet later
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                got = signatures(s, bands)
                keys.append(np.full(len(got), key, np.int64))
                found.append(got)
                rows += len(got)
                if rows > 200_000:
                    yield _rows(found, keys, hot)
                    keys, found, rows = [], [], 0
            if rows:
                yield _rows(found, keys, hot)

    return run


def _rows(found: list[np.ndarray], keys: list[np.ndarray], hot: np.ndarray) -> pa.RecordBatch:
    signature = np.concatenate(found)
    return pa.RecordBatch.from_arrays([pa.array(signature), pa.array(np.concatenate(keys)), pa.array(np.isin(signature, hot))], ["signature", "key", "hot"])


def _packed(size: int):
    """The set of each text, where it is the one that is asked for by its key."""

    def run(batches):
        for batch in batches:
            sets = list(_sets(batch.column("text"), size))
            right = pa.array([set_key(s) == k for s, k in zip(sets, batch.column("key").to_pylist(), strict=True)], pa.bool_())
            made = [batch.column("key"), batch.column("stars"), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, ["key", "stars", "shingles"]).filter(right)

    return run


def _verified(percent: int):
    """(a, b) that link, of rows in order of star and of is_b: a star's first row is its centre."""

    def run(batches):
        star, centre = None, None
        for batch in batches:
            a, b = [], []
            columns = [batch.column(n).to_pylist() for n in ("a", "salt", "is_b", "key", "shingles")]
            for at, salt, is_b, key, packed in zip(*columns, strict=True):
                own = np.frombuffer(packed, np.uint64)
                if not is_b:
                    star, centre = (at, salt), own
                elif star == (at, salt):
                    common = len(np.intersect1d(centre, own, assume_unique=True))
                    if 100 * common >= percent * (len(centre) + len(own) - common):
                        a.append(at)
                        b.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


class Corpus:
    """The texts, with what is known of their sets: keyed(id, hash, key, n_shingles, bits).

    The sets themselves are made from the texts again when a few of them are needed, which
    takes no room on disk. `places` has for each set where to find it: the text's hash with
    the smallest id that it comes under.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int, scratch: Scratch):
        self.size = size
        text = F.col(text_col)
        self.rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))
        kind = "id long, hash long, key long, n_shingles long, bits array<long>"
        self.keyed = scratch.keep(self.rows.mapInArrow(_keyed(size), kind), "keyed")
        place = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "hash"))
        sets = self.keyed.where("n_shingles > 0").groupBy("key").agg(place.alias("place"))
        self.places = scratch.keep(sets.select("key", "place.id", "place.hash"), "places")
        self.slim = self.keyed.where("n_shingles > 0").select("key", F.col("n_shingles").alias("n"), "bits")

    def texts_of(self, keys: DataFrame) -> DataFrame:
        """(text, and the columns of keys) for each row of keys(key, ...)."""
        wanted = self.places.join(keys, "key").withColumnsRenamed({"id": "at_id", "hash": "at_hash"})
        same = (self.rows["hash"] == wanted["at_hash"]) & self.rows["id"].eqNullSafe(wanted["at_id"])
        return self.rows.join(wanted, same).drop("id", "hash", "at_id", "at_hash")

    def sketches(self, keys: DataFrame) -> DataFrame:
        """(key, n, bits) of the sets that keys(key) names, once each."""
        return self.slim.join(keys.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])

    def links(self, pairs: DataFrame, percent: int) -> DataFrame:
        """The pairs (a, b) that link by the exact similarity of their sets.

        A star (all pairs of one a) is dealt to STAR_SALTS parts, and each set goes to the
        parts in which it has pairs, the centre once to each of them.
        """
        dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(STAR_SALTS)).cast("int").alias("salt"))
        ends = dealt.select("a", "salt", F.lit(True).alias("is_b"), F.col("b").alias("key"))
        centres = dealt.select("a", "salt", F.lit(False).alias("is_b"), F.col("a").alias("key")).distinct()
        asked = ends.union(centres).groupBy("key").agg(F.collect_list(F.struct("a", "salt", "is_b")).alias("stars"))
        kind = "key long, stars array<struct<a:long,salt:int,is_b:boolean>>, shingles binary"
        sets = self.texts_of(asked).select("key", "stars", "text").mapInArrow(_packed(self.size), kind)
        members = sets.select("key", F.explode("stars").alias("star"), "shingles").select("star.*", "key", "shingles")
        order = ["a", "salt"]
        return members.repartition(*order).sortWithinPartitions(*order, "is_b").mapInArrow(_verified(percent), "a long, b long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs: groups of linked texts.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; two of them link
    when 100 * |intersection| >= percent * |union| of their distinct `size`-word shingles.
    component_id is the smallest id that links reach. Null and empty texts and texts
    without words have 0 shingles and link with nothing, whatever else they equal: their
    component is their own id. A null id gets the component of its text's group, and a
    null one when it stands alone. Repeated rows come back repeated; an empty table gives
    no rows. Other columns of docs, whatever their names, are not read. Keys of sets are
    64-bit hashes.

    Not all pairs of a group are compared. In each signature's bucket every set is
    compared with one pivot, then sets that are still apart with other pivots; only pairs
    of a bucket whose sets no links join yet are compared one by one at the end, so the
    components are those of all links. Sizes and bitmaps of two sets are looked at first,
    and only the sets that may link by these travel.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    corpus = Corpus(docs, id_col, text_col, size, scratch)
    shared = _shared_signatures(corpus.rows, scratch, size, percent)
    star = scratch.keep(_star_pairs(shared, corpus, percent), "pairs")
    links = scratch.keep(corpus.links(star, percent), "links")
    labels = components(links, scratch, "components")
    still = scratch.keep(_still_apart(shared, labels, corpus, percent), "apart")
    scratch.drop("shared", "pairs", "links")
    for i, which in enumerate((_other_pairs, _all_pairs)):
        pairs = scratch.keep(which(_mixed(still, labels), percent), f"pairs-{i}")
        more = scratch.keep(corpus.links(pairs, percent), f"links-{i}")
        if not more.isEmpty():
            ends = more.join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left")
            joins = ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
            tops = components(joins, scratch, f"tops-{i}")
            old = labels.join(tops.toDF("component", "top"), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
            new = tops.join(labels.select("node"), "node", "left_anti")
            labels = scratch.keep(old.union(new), f"labels-{i}")
        scratch.drop(f"pairs-{i}", f"links-{i}")
    scratch.drop("apart")

    named = corpus.places.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    by_key = named.join(least, "component").select("key", "component_id")
    keyed = corpus.keyed
    out = keyed.join(by_key, (keyed.key == by_key.key) & (keyed.n_shingles > 0), "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def _shared_signatures(rows: DataFrame, scratch: Scratch, size: int, percent: int) -> DataFrame:
    """(signature, salt, key, pivot) of signatures that several sets have.

    Signatures of very many sets are cut by a salt; a bounded sample tells which.
    """
    kind = "signature long, key long, hot boolean"
    sampled = bounded_sample(rows, F.struct("id", "hash"), SAMPLE).select("text").mapInArrow(_signed(size, percent, np.zeros(0, np.int64)), kind)
    many = sampled.groupBy("signature").count().where(F.col("count") >= HOT).select("signature").collect()
    hot = np.array([r[0] for r in many], np.int64)
    signed = rows.select("text").mapInArrow(_signed(size, percent, hot), kind)
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    w = Window.partitionBy("signature", "salt")
    found = signed.withColumn("salt", salt).withColumns({"pivot": F.min("key").over(w), "last": F.max("key").over(w)})
    return scratch.keep(found.where("hot or pivot < last").select("signature", "salt", "key", "pivot"), "shared")


def _star_pairs(shared: DataFrame, corpus: Corpus, percent: int) -> DataFrame:
    """(a, b): a bucket's pivot with its sets, and the pivots of a salted bucket with the least, if they may link."""
    heads = shared.select("signature", "salt", F.col("pivot").alias("key")).distinct()
    top = heads.groupBy("signature").agg(F.min("key").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    pairs = shared.select("pivot", "key").union(heads.join(top, "signature").select("pivot", "key"))
    pairs = pairs.where("pivot <> key").distinct().toDF("a", "b")
    sketches = corpus.sketches(shared)
    x, y = sketches.alias("x"), sketches.alias("y")
    met = pairs.join(x, F.col("a") == F.col("x.key")).join(y, F.col("b") == F.col("y.key"))
    return met.where(_alike("x", "y", percent)).select("a", "b")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    named = rows.join(labels.withColumnRenamed("node", "key"), "key", "left")
    return named.withColumn("component", F.coalesce("component", "key"))


def _still_apart(shared: DataFrame, labels: DataFrame, corpus: Corpus, percent: int) -> DataFrame:
    """(signature, key, n, c, bits) of sets that may have links which no star has looked at.

    These are sets of buckets that aren't joined and have more than the pivot's own
    comparisons open: three sets at least. Of the n shingles of a set, c are in another
    of these sets too. A link needs at least percent / 100 * n of those, so most sets go
    here, as what sets a loose copy apart from the others is mostly its own.
    """
    named = _labelled(shared, labels)
    other = F.when(F.col("key") != F.col("pivot"), F.col("key"))
    buckets = named.groupBy("signature").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min(other).alias("one"), F.max(other).alias("two")
    )
    buckets = buckets.where("low < high and one < two").select("signature")
    rows = named.join(buckets, "signature", "left_semi").select("signature", "key").distinct()
    keys = rows.select("key").distinct()
    each = corpus.texts_of(keys).select("key", "text").mapInArrow(_exploded(corpus.size), "key long, shingle long, many boolean, own long")
    w = Window.partitionBy("shingle")
    seen = each.where("own = 1").withColumn("common", F.bool_or("many").over(w) | (F.min("key").over(w) < F.max("key").over(w)))
    found = seen.where("common and not many").select("key", "own")
    counts = found.union(each.where("own > 1").select("key", F.col("own") - 1)).groupBy("key").agg(F.sum("own").alias("c"))
    able = corpus.sketches(keys).join(counts, "key").where(F.col("c") * 100 >= F.col("n") * percent)
    return rows.join(able, "key").select("signature", "key", "n", "c", "bits")


def _exploded(size: int):
    """(key, shingle, many, own) of a set's shingles that are in no other set of TOGETHER ones.

    Those in several of them are common for sure: one row, `many`, tells of each, and a
    row of each set how many of these it has (`own`, and one more). So a shingle that very
    many sets have gives few rows.
    """

    def run(batches):
        for batch in batches:
            sets = list(_sets(batch.column("text"), size))
            names = batch.column("key").to_numpy()
            for at in range(0, len(sets), TOGETHER):
                some, keys = sets[at : at + TOGETHER], names[at : at + TOGETHER]
                _, first = np.unique(keys, return_index=True)  # a text may be there twice
                some, keys = [some[i] for i in first], keys[first]
                owner = np.repeat(np.arange(len(some)), [len(s) for s in some])
                values, which, times = np.unique(np.concatenate(some), return_inverse=True, return_counts=True)
                alone = times[which] == 1
                owns = np.bincount(owner[~alone], minlength=len(some))
                single, several = values[which[alone]], values[times > 1]
                shingle = np.concatenate([single, several, np.zeros(len(some), np.uint64)]).view(np.int64)
                key = np.concatenate([keys[owner[alone]], np.zeros(len(several), np.int64), keys])
                many = np.repeat([False, True], [len(single), len(several) + len(some)])
                own = np.concatenate([np.ones(len(single) + len(several), np.int64), owns + 1])
                made = [pa.array(key), pa.array(shingle), pa.array(many), pa.array(own)]
                yield pa.RecordBatch.from_arrays(made, ["key", "shingle", "many", "own"])

    return run


def _mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, with their components, of buckets whose sets aren't all joined."""
    named = _labelled(rows, labels)
    mixed = named.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return named.join(mixed.select("signature"), "signature", "left_semi")


def _alike(x: str, y: str, percent: int) -> Column:
    """Whether sizes and bitmaps allow a link: no more bits differ than shingles of linked sets do."""
    n, less = F.col(f"{x}.n") + F.col(f"{y}.n"), F.least(f"{x}.n", f"{y}.n")
    near = less * 100 >= (n - less) * percent
    differ = [F.bit_count(F.get(f"{x}.bits", F.lit(i)).bitwiseXOR(F.get(f"{y}.bits", F.lit(i)))) for i in range(BITMAP)]
    return near & (functools.reduce(Column.__add__, differ) * (100 + percent) <= n * (100 - percent))


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether two sets can have a link that joins something new: they need enough common shingles too."""
    n = F.col(f"{x}.n") + F.col(f"{y}.n")
    enough = F.least(f"{x}.c", f"{y}.c") * (100 + percent) >= n * percent
    return (F.col(f"{x}.component") != F.col(f"{y}.component")) & enough & _alike(x, y, percent)


def _other_pairs(named: DataFrame, percent: int) -> DataFrame:
    """Each set of a bucket with OTHER_PIVOTS pivots that the signature picks, if the two may link."""
    columns = ["key", "component", "n", "c", "bits"]
    least = [F.min_by(F.struct(*columns), F.xxhash64("signature", "key", F.lit(turn))) for turn in range(OTHER_PIVOTS)]
    picked = named.groupBy("signature").agg(F.array(*least).alias("pivots"))
    x, y = named.alias("x"), picked.select("signature", F.explode(F.array_distinct("pivots")).alias("p")).select("signature", "p.*").alias("y")
    met = x.join(y, (F.col("x.signature") == F.col("y.signature")) & _may_link("x", "y", percent))
    return met.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def _all_pairs(named: DataFrame, percent: int) -> DataFrame:
    """The pairs that share a signature and may link, once each."""
    x, y = named.alias("x"), named.alias("y")
    once = (F.col("x.signature") == F.col("y.signature")) & (F.col("x.key") < F.col("y.key"))
    return x.join(y, once & _may_link("x", "y", percent)).select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
