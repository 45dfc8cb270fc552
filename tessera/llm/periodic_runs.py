"""Repetition in texts: maximal periodic runs of words, found by block convolution.

A run with period q and at least 4 q words holds an aligned block of B words, B <= q < 2 B,
together with its copy q words later, whatever the alignment. So at each scale B = 1, 2, 4, ...
every block is laid over the window behind it: the sum of squared differences of word numbers
at a distance is 0 just where the block occurs again. The sums come from number theoretic
transforms modulo as many primes as exceed the largest possible sum, so they are exact. Each
zero seeds an extension to both sides, by prefix hashes; what comes out is compared word by word.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import aside, prepare
from tessera.llm.textblocks import INVERSE, ODD, mix

#: A run has at least LEAST words and FOLD periods.
LEAST, FOLD = 6, 4
#: Primes k * 2**26 + 1 and a generator of each; products of two residues fit 64 bits.
PRIMES = ((2013265921, 31), (1811939329, 13), (469762049, 3))
#: Texts are searched together up to so many words, a longer one alone.
TOGETHER = 200_000
#: Block words that are transformed at once.
AT_ONCE = 1 << 18


@functools.lru_cache(maxsize=128)
def _roots(prime: int, generator: int, size: int) -> np.ndarray:
    """The first `size` powers of a root of unity of order 2 * size."""
    root = pow(generator, (prime - 1) // (2 * size), prime)
    powers = np.ones(size, np.uint64)
    done = 1
    while done < size:
        powers[done : 2 * done] = powers[:done] * np.uint64(pow(root, done, prime)) % np.uint64(prime)
        done *= 2
    return powers


def _reduced(sums: np.ndarray, p: np.uint64) -> np.ndarray:
    """Sums of two residues modulo p: below p, sums - p wraps around and is the larger one."""
    return np.minimum(sums, sums - p)


def transform(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """The number theoretic transform of each row, its values in bit-reversed order."""
    p = np.uint64(prime)
    rows = rows % p
    half = rows.shape[1] // 2
    while half:
        cut = rows.reshape(len(rows), -1, 2, half)
        low, high = cut[:, :, 0], cut[:, :, 1]
        rows = np.stack([_reduced(low + high, p), (low + (p - high)) * _roots(prime, generator, half) % p], axis=2)
        half //= 2
    return rows.reshape(len(rows), -1)


def inverse(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """What `transform` was given."""
    p = np.uint64(prime)
    size, half, back = rows.shape[1], 1, pow(generator, prime - 2, prime)
    while half < size:
        cut = rows.reshape(len(rows), -1, 2, half)
        low, high = cut[:, :, 0], cut[:, :, 1] * _roots(prime, back, half) % p
        rows = np.stack([_reduced(low + high, p), _reduced(low + (p - high), p)], axis=2)
        half *= 2
    return rows.reshape(len(rows), -1) * np.uint64(pow(size, prime - 2, prime)) % p


def zero_mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Whether block i equals windows[i, o : o + B], for each o below B; windows are 2 B long.

    Numbers are not negative. A sum of squared differences below the product of the primes is 0
    if it is 0 modulo each of them.
    """
    size = blocks.shape[1]
    top = int(max(blocks.max(), windows.max()))
    found = np.ones(blocks.shape, bool)
    product = 1
    for prime, generator in PRIMES:
        if product > size * top * top:
            break
        p = np.uint64(prime)
        own, other = blocks.astype(np.uint64) % p, windows.astype(np.uint64) % p
        backwards = np.zeros(windows.shape, np.uint64)
        backwards[:, :size] = own[:, ::-1]
        both = transform(backwards, prime, generator) * transform(other, prime, generator) % p
        products = inverse(both, prime, generator)[:, size - 1 : 2 * size - 1]
        squares = np.zeros((len(windows), 2 * size + 1), np.uint64)
        np.cumsum(other * other % p, axis=1, out=squares[:, 1:])
        sums = (own * own % p).sum(axis=1)[:, None] + squares[:, size : 2 * size] - squares[:, :size]
        found &= (sums + p + p - np.uint64(2) * products % p) % p == 0
        product *= prime
    if product <= size * top * top:
        raise ValueError("too many different words for the primes")
    return found


def _until_next(words: np.ndarray) -> np.ndarray:
    """How many places further each word occurs again; far beyond the end if it doesn't."""
    order = np.argsort(words, kind="stable")
    again = np.full(len(words), np.iinfo(np.int64).max)
    same = words[order[1:]] == words[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return again


def _seeds(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and distance of all aligned blocks that occur again at a distance from their size to below twice that."""
    again = _until_next(words)
    starts, sizes, distances = [], [], []
    size = 1
    while FOLD * size <= longest:
        n = len(words) // size
        # a block one of whose words isn't there again within the window can't be either
        able = np.flatnonzero(again[: n * size].reshape(n, size).max(axis=1) < 2 * size) * size
        if len(able):
            known = np.unique(words[able[:, None] + np.arange(size)])
            for some in np.array_split(able, max(1, len(able) * size // AT_ONCE)):
                blocks = np.searchsorted(known, words[some[:, None] + np.arange(size)])
                at = some[:, None] + size + np.arange(2 * size)
                inside = at < len(words)
                seen = words[np.where(inside, at, 0)]
                place = np.minimum(np.searchsorted(known, seen), len(known) - 1)
                windows = np.where(inside & (known[place] == seen), place, len(known))  # one number for all other words
                block, offset = np.nonzero(zero_mismatches(blocks, windows))
                starts.append(some[block])
                sizes.append(np.full(len(block), size))
                distances.append(offset + size)
        size *= 2
    if not starts:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(starts), np.concatenate(sizes), np.concatenate(distances)


class _Prefixes:
    """Hashes of stretches of a word sequence: equal stretches have equal ones."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        steps = np.full(self.n + 1, ODD, np.uint64)
        back = np.full(self.n + 1, INVERSE, np.uint64)
        steps[0] = back[0] = 1
        self.back = np.cumprod(back, dtype=np.uint64)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(mix(words.astype(np.uint64) * ODD) * np.cumprod(steps, dtype=np.uint64)[: self.n], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.back[start]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, backward: bool) -> np.ndarray:
        """How many words from a and from b on (or before them) are the same, `most` at most."""
        low, high = np.zeros_like(most), most.copy()
        while True:
            open_ = low < high
            if not open_.any():
                return low
            half = (low + high + 1) // 2
            same = self.of(a - half, half) == self.of(b - half, half) if backward else self.of(a, half) == self.of(b, half)
            low, high = np.where(open_ & same, half, low), np.where(open_ & ~same, half - 1, high)


def _same(words: np.ndarray, start: int, end: int, period: int) -> list[tuple[int, int]]:
    """The stretches of [start, end) that keep the period, word by word: all of it, unless two stretches share a hash."""
    same = words[start : end - period] == words[start + period : end]
    if same.all():
        return [(start, end)]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    return [(start + a, start + b + period) for a, b in edges.reshape(-1, 2).tolist()]


def find_runs(words: np.ndarray, longest: int | None = None) -> np.ndarray:
    """Rows (start, length, period) of the runs of a sequence of word numbers, by start, then period.

    No run is longer than `longest`, if it is given.
    """
    none = np.zeros((0, 3), np.int64)
    start, size, period = _seeds(words, len(words) if longest is None else longest)
    if not len(start):
        return none
    prefixes = _Prefixes(words)
    behind = start + size
    end = behind + period + prefixes.common(behind, behind + period, len(words) - behind - period, False)
    start = start - prefixes.common(start, start + period, start, True)
    keep = end - start >= np.maximum(LEAST, FOLD * period)
    start, end, period = start[keep], end[keep], period[keep]
    # one stretch has one smallest period; the others found for it are multiples
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    found: dict[tuple[int, int], int] = {}
    for s, e, q in zip(start[first].tolist(), end[first].tolist(), period[first].tolist(), strict=True):
        for stretch in _same(words, s, e, q):
            if stretch[1] - stretch[0] >= max(LEAST, FOLD * q):
                found[stretch] = min(q, found.get(stretch, q))
    return np.array(sorted((s, q, e - s) for (s, e), q in found.items()), np.int64).reshape(-1, 3)[:, [0, 2, 1]]


def _together(texts: Iterator[bytes]) -> Iterator[list[list[bytes]]]:
    """The words of the texts, some texts at a time."""
    some, size = [], 0
    for text in texts:
        some.append(text.split())  # at 0x20 and 0x09 to 0x0D
        size += len(some[-1])
        if size >= TOGETHER:
            yield some
            some, size = [], 0
    if some:
        yield some


def runs_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each text, given by its words."""
    numbers: dict[bytes, int] = {}
    lengths = np.array([len(t) for t in texts])
    parts = []
    for words in texts:
        parts += [numbers.setdefault(w, len(numbers)) for w in words]
        parts.append(-1)
    line = np.array(parts, np.int64)
    ends = np.cumsum(lengths + 1)
    line[ends - 1] = len(numbers) + np.arange(len(texts))  # between two texts stands what is nowhere else
    found = find_runs(line, int(lengths.max(initial=0)))
    begins = ends - lengths - 1
    text = np.searchsorted(begins, found[:, 0], "right") - 1
    found[:, 0] -= begins[text]
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    return [found[cuts[i] : cuts[i + 1]] for i in range(len(texts))]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by spaces, without those that a run holds after its first period."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)])


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `runs` (structs of start, length, period, in words, by start, then period) and `collapsed` in place of the text.

    A run is a stretch with smallest period q of at least max(LEAST, FOLD * q) words that no
    neighbour extends with that period; `collapsed` joins by spaces the words that no run holds
    after its first q words. Words are what ASCII blanks separate, compared byte by byte. A null,
    empty or blank text has no runs and an empty `collapsed`. A text is one row and is searched
    whole, in memory in proportion to its words. Repeated rows stay repeated, other columns pass
    through, an empty table gives no rows; columns named runs or collapsed come back with _input
    behind their names.
    """
    prepare(docs.sparkSession)
    docs, text_col = aside(docs, ["runs", "collapsed"], text_col)
    rest = [f for f in docs.schema.fields if f.name != text_col]
    at = docs.columns.index(text_col)
    field = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary())
            counts, rows, collapsed = [0], [], []
            for some in _together(t.as_py() or b"" for t in texts):
                for words, found in zip(some, runs_of(some), strict=True):
                    rows.append(found)
                    counts.append(len(found))
                    collapsed.append(collapse(words, found))
            values = np.concatenate(rows or [np.zeros((0, 3), np.int64)])
            structs = pa.StructArray.from_arrays([pa.array(values[:, i]) for i in range(3)], fields=list(field))
            runs = pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), structs)
            kept = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, runs, pa.array(collapsed, pa.binary()).cast(pa.string())], [*(f.name for f in rest), "runs", "collapsed"])

    own = "runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), own]))


def digests(found: DataFrame) -> DataFrame:
    """`found` with the number of runs, the one of most periods and digests in place of runs and collapsed."""

    def more(best, run):
        return F.when(best.isNull() | (run.length * best.period > best.length * run.period), run).otherwise(best)

    best = F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), more)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    told = found.withColumn("best", best)
    return told.select(
        *[c for c in found.columns if c not in ("runs", "collapsed")],
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_repeats(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, the texts of one id in ten rewritten to end in repetitions whose place and period its digits tell.

    With h the CRC-32 of the decimal id and g = h div 10, rows with h mod 10 = 0 and n > 0 words
    keep the first a = g mod n; from there the next p = 1 + (n - a) div (3 + g mod 8) words repeat.
    Rows without an id stay as they are.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def laid(w):
        n = F.size(w)
        a = g % F.greatest(n, F.lit(1))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " "))

    words = F.regexp_extract_all(text_col, F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    # the words are bound to a variable, so that they are cut once whatever the optimizer does
    text = F.coalesce(F.when(h % 10 == 0, F.get(F.transform(F.array(words), laid), 0)), text_col)
    return docs.select(*[text.alias(c) if c == text_col else c for c in docs.columns])
