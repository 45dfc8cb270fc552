"""Operator 2: passages of benchmark items in documents, by CGK embedding and bit sampling.

Every window of a text with as many words as an item is compared with the items of that
size. A window and an item within an edit distance of d have most of their word pairs in
common, so windows with too few word pairs of the benchmark go at once. The others take
the random walk of Chakraborty, Goldenberg and Koucky, which copies each word a random
number of times and so turns edits into few Hamming differences; windows that agree with
an item at the sampled positions of one of several repetitions are candidates, and the
exact edit distance of the item to the best stretch of the text there decides.

The number of positions in a sample and of repetitions follow from the target recall and
from how often walks of edited items agree, which is measured on the items of each size.

What the walks leave to chance, or can't see as no whole window fits before a text's end,
an exact bound finds: an edit breaks at most two word pairs, so of an item's rarest pairs
a known number is in every stretch within its edits. Such stretches, of whatever size and
place, are compared with the item where no candidate of the walks was compared before.
"""

from __future__ import annotations

import itertools
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textblocks
from tessera.llm.shared import aside, prepare
from tessera.llm.textblocks import ODD, Block, mix

#: Words are runs of letters, digits and bytes beyond ASCII; A-Z count as a-z.
APART = np.ones(256, bool)
APART[[*b"0123456789", *b"abcdefghijklmnopqrstuvwxyz", *b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(128, 256)]] = False
#: Items of fewer words are looked for without edits, those of fewer than SHORT_WORDS words,
#: which any text may hold by chance, as whole texts only.
LEAST_WORDS, SHORT_WORDS = 8, 4
#: Edits allowed for each word of an item.
EDITS = 0.2
#: Share of contaminated windows that the sampling should find; the exact bound finds the rest.
RECALL = 0.98
#: Positions in one sample at most, and different random walks.
SAMPLED, WALKS = 3, 4
#: Steps of a walk for each word. It needs about two; later ones have seen more edits.
WALKED = 2
#: Edited items that the recall is measured on.
TRIED = 400
#: Repetitions after which one position less is sampled.
MOST_REPETITIONS = 160
#: Words of the benchmark that a task holds; a larger benchmark takes several passes.
PASS_WORDS = 400_000
#: Rarest pairs of an item that a stretch must hold, if the item has enough of them.
RAREST = 4
#: Passes that a worker keeps prepared.
PREPARED = 2
#: Windows that walk together.
TOGETHER = 50_000
HIT = "item_id long, edits int, first_word int, n_words int"


def edits_of(words: int) -> int:
    return int(EDITS * words) if words >= LEAST_WORDS else 0


class Walks:
    """The first WALKED times as many steps as words of the CGK embeddings of windows."""

    def __init__(self, length: int, seed: int):
        self.length, self.seed = length, np.uint64((seed * 2 + 1) * 0xD1342543DE82EF95 % (1 << 64))

    def embed(self, words: np.ndarray) -> np.ndarray:
        """words: a row of word hashes for each window."""
        rows = np.arange(len(words))
        padded = np.concatenate([words, np.zeros((len(words), 1), np.uint64)], 1)
        at = np.zeros(len(words), np.int64)
        out = np.empty((len(words), WALKED * self.length), np.uint64)
        for j in range(WALKED * self.length):
            out[:, j] = padded[rows, at]
            step = mix(out[:, j] ^ (self.seed + np.uint64(j))) & np.uint64(1)
            at = np.minimum(at + step.astype(np.int64), self.length)
        return out


class Probe(NamedTuple):
    """The items of one size: keys of each repetition, and what to compare windows with."""

    length: int
    walks: list[Walks]
    positions: list[tuple[int, np.ndarray]]
    keys: list[dict[int, list[int]]]
    sorted_keys: list[np.ndarray]
    ids: list[int]
    words: np.ndarray
    pairs: int


def window_keys(embedded: list[np.ndarray], positions: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
    out = []
    for walk, where in positions:
        total = np.zeros(len(embedded[walk]), np.uint64)
        for p in where:
            total = mix(total * ODD + embedded[walk][:, p])
        out.append(total)
    return out


def _edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """One row with so many random replacements, insertions and deletions, as long as before."""
    row = list(words)
    for _ in range(edits):
        at, kind = int(rng.integers(len(row))), rng.integers(3)
        new = np.uint64(rng.integers(1 << 62))
        row[at : at + (kind != 1)] = [] if kind == 2 and len(row) > 1 else [new]
    row = row[: len(words)]
    return np.array(row + [np.uint64(rng.integers(1 << 62)) for _ in range(len(words) - len(row))], np.uint64)


def sampling(words: np.ndarray, walks: list[Walks]) -> list[tuple[int, np.ndarray]]:
    """(walk, positions) of the repetitions that find RECALL of the items with all edits allowed.

    Of the numbers of positions, SAMPLED first, the one is taken that needs no more than
    MOST_REPETITIONS; one position, which nearly every walk shares, needs few.
    """
    reach = (1 + RECALL) / 2  # above the target, as it is measured on few
    rng = np.random.default_rng(words.shape[1])
    chosen = words[rng.integers(len(words), size=TRIED)]
    other = np.array([_edited(w, edits_of(words.shape[1]), rng) for w in chosen])
    here, there = ([w.embed(side) for w in walks] for side in (chosen, other))
    for sampled in range(min(SAMPLED, WALKED * words.shape[1]), 0, -1):
        positions, found = [], np.zeros(len(chosen), bool)
        while found.mean() < reach and (sampled == 1 or len(positions) < MOST_REPETITIONS):
            where = np.sort(rng.choice(WALKED * words.shape[1], sampled, replace=False))
            positions.append((len(positions) % WALKS, where))
            found |= window_keys(here, positions[-1:])[0] == window_keys(there, positions[-1:])[0]
        if found.mean() >= reach:
            break
    return positions


def by_size(items: list[tuple[int, np.ndarray]]) -> dict[int, list[tuple[int, np.ndarray]]]:
    out: dict[int, list[tuple[int, np.ndarray]]] = {}
    for item, words in items:
        if len(words) >= SHORT_WORDS:
            out.setdefault(len(words), []).append((item, words))
    return out


def samplings(items: list[tuple[int, np.ndarray]]) -> dict[int, list[tuple[int, np.ndarray]]]:
    """The sampling for the items of each size."""
    return {n: sampling(np.array([w for _, w in own]), [Walks(n, i) for i in range(WALKS)]) for n, own in by_size(items).items()}


def probes(items: list[tuple[int, np.ndarray]], sampled: dict[int, list[tuple[int, np.ndarray]]]) -> list[Probe]:
    out = []
    for length, own in sorted(by_size(items).items()):
        walks = [Walks(length, i) for i in range(WALKS)]
        words = np.array([w for _, w in own])
        positions = sampled[length]
        keys: list[dict[int, list[int]]] = []
        for found in window_keys([w.embed(words) for w in walks], positions):
            keys.append({})
            for i, key in enumerate(found.tolist()):
                keys[-1].setdefault(key, []).append(i)
        out.append(Probe(length, walks, positions, keys, [np.array(sorted(k), np.uint64) for k in keys], [i for i, _ in own], words, min(_pairs_without_runs(w) for w in words)))
    return out


def _pairs_without_runs(words: np.ndarray) -> int:
    same = words[1:] == words[:-1]
    return len(same) - int((same[1:] & same[:-1]).sum())


def edit_distance_within(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int, int]:
    """(edits, first, end): the least edit distance of the item to a part of the stretch."""
    n = len(stretch)
    row, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    steps = np.arange(n + 1)
    for i, word in enumerate(item, 1):
        change = row[:-1] + (stretch != word)
        now = np.concatenate([[i], np.minimum(row[1:] + 1, change)])
        source = np.concatenate([[begin[0]], np.where(change <= row[1:] + 1, begin[:-1], begin[1:])])
        least = np.minimum.accumulate(now - steps)
        where = np.maximum.accumulate(np.where(now - steps == least, steps, 0))
        row, begin = least + steps, source[where]
    end = int(np.argmin(row))
    return int(row[end]), int(begin[end]), end


class Benchmark:
    """Items prepared to be looked for in many texts."""

    def __init__(self, items: list[tuple[int, np.ndarray]], sampled: dict[int, list[tuple[int, np.ndarray]]] | None = None):
        self.whole: dict[tuple[int, ...], list[int]] = {}
        for item, words in items:
            if len(words) < SHORT_WORDS:
                self.whole.setdefault(tuple(words.tolist()), []).append(item)
        items = [i for i in items if len(i[1]) >= SHORT_WORDS]
        self.probes = probes(items, samplings(items) if sampled is None else sampled)
        found: dict[int, int] = {}
        for _, words in items:
            for pair in self._pairs(words).tolist():
                found[pair] = found.get(pair, 0) | 1 << len(words) % 64
        self.pairs = np.array(sorted(found), np.uint64)
        #: For each pair the sizes, modulo 64, of the items that have it, as bits.
        self.sizes = np.array([found[p] for p in self.pairs.tolist()], np.uint64)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.pairs >> np.uint64(42)).astype(np.int64)] = True
        self._index(items)

    def _index(self, items: list[tuple[int, np.ndarray]]) -> None:
        """For each pair the items that have it among their rarest, as a run of `self.having`."""
        self.items = items
        self.lengths = np.array([len(words) for _, words in items], np.int64)
        self.edits = np.array([edits_of(n) for n in self.lengths.tolist()], np.int64)
        #: Rarest pairs that are in each stretch within the edits of an item.
        self.least = np.ones(len(items), np.int64)
        own = [np.unique(self._pairs(words)) for _, words in items]
        spread = np.zeros(len(self.pairs), np.int64)
        for pairs in own:
            spread[np.searchsorted(self.pairs, pairs)] += 1
        having: list[tuple[int, int]] = []
        for i, pairs in enumerate(own):
            # One more is lost where a stretch begins within a run of one word.
            lost = 2 * int(self.edits[i]) + 1
            at = np.searchsorted(self.pairs, pairs)
            rarest = at[np.argsort(spread[at], kind="stable")][: lost + RAREST]
            self.least[i] = max(1, len(rarest) - lost)
            having += [(p, i) for p in rarest.tolist()]
        having.sort()
        self.having = np.array([i for _, i in having], np.int64)
        self.having_from = np.searchsorted(np.array([p for p, _ in having]), np.arange(len(self.pairs) + 1))

    @staticmethod
    def _pairs(words: np.ndarray) -> np.ndarray:
        return mix(words[:-1] * ODD + words[1:])

    def known(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the benchmark's pairs of neighbouring words are, and their numbers.

        A run of one word has one such pair.
        """
        pairs = self._pairs(words)
        flags = self.maybe[(pairs >> np.uint64(42)).astype(np.int64)]
        flags[1:] &= pairs[1:] != pairs[:-1]
        where = np.flatnonzero(flags)
        at = np.minimum(np.searchsorted(self.pairs, pairs[where]), len(self.pairs) - 1)
        same = self.pairs[at] == pairs[where]
        return where[same], at[same]

    def search(self, block: Block) -> list[list[tuple[int, int, int, int]]]:
        """For each text of the block its hits (item, edits, first word, words), best for each item."""
        out: list[dict[int, tuple]] = [{} for _ in range(len(block))]
        words = block.word_hashes()
        for text in np.flatnonzero((block.n_words > 0) & (block.n_words < SHORT_WORDS)) if self.whole else ():
            own = words[block.word_offsets[text] : block.word_offsets[text + 1]]
            out[text] = {item: (item, 0, 0, len(own)) for item in self.whole.get(tuple(own.tolist()), ())}
        if len(words) < 2 or not len(self.pairs):
            return [sorted(found.values()) for found in out]
        # For each item and text the stretches that the walks had compared, by their first words.
        seen: dict[tuple[int, int], list[tuple[int, int]]] = {}
        where, pairs = self.known(words)
        sizes = self.sizes[pairs]
        last_word = np.repeat(block.word_offsets[1:], block.n_words)
        for probe in self.probes:
            n, d = probe.length, edits_of(probe.length)
            own = where[(sizes >> np.uint64(n % 64)) & np.uint64(1) == 1]
            # Each edit breaks two word pairs, or breaks one and pushes one out of the window;
            # one more is lost where a window begins within a run of one word.
            need = max(1, probe.pairs - 1 - 2 * d)
            if len(own) < need:
                continue
            # Windows that hold `need` of the pairs: they begin from `low` to `high`.
            low, high = np.maximum(0, own[need - 1 :] - (n - 2)), own[: len(own) - need + 1]
            some = [np.arange(a, b + 1) for a, b in zip(low[low <= high], high[low <= high], strict=True)]
            able = np.unique(np.concatenate(some)) if some else np.zeros(0, np.int64)
            able = able[able + n <= last_word[able]]
            for k in range(0, len(able), TOGETHER):
                self._look(probe, able[k : k + TOGETHER], words, block, out, seen)
        self._compare_bounded(where, pairs, words, block, out, seen)
        return [sorted(found.values()) for found in out]

    def _compare_bounded(self, where: np.ndarray, pairs: np.ndarray, words: np.ndarray, block: Block, out: list[dict[int, tuple]], seen: dict[tuple[int, int], list[tuple[int, int]]]) -> None:
        """Compare the items with the stretches that hold enough of their rarest pairs, but for those seen as a whole."""
        offsets = block.word_offsets
        text = np.searchsorted(offsets, where, "right") - 1
        inside = where + 1 < offsets[text + 1]
        where, pairs, text = where[inside], pairs[inside], text[inside]
        many = self.having_from[pairs + 1] - self.having_from[pairs]
        ends = np.cumsum(many)
        place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.having_from[pairs] - ends + many, many)
        item, at, text = self.having[place], np.repeat(where, many), np.repeat(text, many)
        order = np.lexsort((at, item))
        item, at, text = item[order], at[order], text[order]
        last = np.arange(len(item)) + self.least[item] - 1
        fits = np.flatnonzero(last < len(item))
        last = last[fits]
        # The most words of a stretch hold one pair less.
        most = self.lengths[item] + self.edits[item]
        near = (item[last] == item[fits]) & (text[last] == text[fits]) & (at[last] - at[fits] <= most[fits] - 2)
        i, j = fits[near], last[near]
        first = np.maximum(offsets[text[i]], at[j] + 2 - most[i])
        end = np.minimum(offsets[text[i] + 1], at[i] + most[i])
        if seen:
            left = [not any(a <= x and y <= b for a, b in seen.get((self.items[n][0], t), ())) for n, t, x, y in zip(item[i].tolist(), text[i].tolist(), first.tolist(), end.tolist(), strict=True)]
            i, first, end = i[left], first[left], end[left]
        # Stretches of an item that overlap are compared as one.
        new = np.ones(len(i), bool)
        new[1:] = (item[i][1:] != item[i][:-1]) | (text[i][1:] != text[i][:-1]) | (first[1:] > end[:-1])
        cuts = [*np.flatnonzero(new).tolist(), len(i)]
        for a, b in itertools.pairwise(cuts):
            name, wanted = self.items[item[i[a]]]
            self._compare(name, wanted, int(text[i[a]]), int(first[a]), int(end[b - 1]), words, block, out)

    @staticmethod
    def _compare(name: int, wanted: np.ndarray, text: int, first: int, end: int, words: np.ndarray, block: Block, out: list[dict[int, tuple]]) -> bool:
        """Keep the best part of the words from first to end if it's within the item's edits."""
        stretch, d = words[first:end], edits_of(len(wanted))
        if np.isin(wanted, stretch).sum() < len(wanted) - d:
            return False  # each word that is missing takes an edit
        edits, a, b = edit_distance_within(wanted, stretch)
        if edits > d:
            return False
        hit = (name, edits, first + a - int(block.word_offsets[text]), b - a)
        best = out[text].get(name)
        if best is None or hit[1:3] < best[1:3]:
            out[text][name] = hit
        return True

    def _look(self, probe: Probe, starts: np.ndarray, words: np.ndarray, block: Block, out: list[dict[int, tuple]], seen: dict[tuple[int, int], list[tuple[int, int]]]) -> None:
        windows = words[starts[:, None] + np.arange(probe.length)]
        met: set[tuple[int, int]] = set()
        found = window_keys([w.embed(windows) for w in probe.walks], probe.positions)
        for keys, items, known in zip(found, probe.keys, probe.sorted_keys, strict=True):
            near = known[np.minimum(np.searchsorted(known, keys), len(known) - 1)]
            for i in np.flatnonzero(near == keys):
                met.update((int(starts[i]), item) for item in items[int(keys[i])])
        reach: dict[int, int] = {}
        d = edits_of(probe.length)
        for start, item in sorted(met):
            if start < reach.get(item, 0):
                continue  # the stretch of an earlier window had this one in it
            text = int(np.searchsorted(block.word_offsets, start, "right")) - 1
            low, high = int(block.word_offsets[text]), int(block.word_offsets[text + 1])
            # As wide as the bound looks around the pairs of a passage that begins up to d words
            # before or after, so that it needn't look here again.
            most = probe.length + d
            first, end = max(low, start - d - most), min(high, start + probe.length + 2 * d + most)
            if self._compare(probe.ids[item], probe.words[item], text, first, end, words, block, out):
                reach[item] = start + most
                seen.setdefault((probe.ids[item], text), []).append((first, end))


def _item_words(text: str | None) -> np.ndarray:
    data = textblocks.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    return Block(data, np.array([0, len(data)]), APART).word_hashes()


def flag(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with `hits`: array of (item_id, edits, first_word, n_words), empty for clean texts.

    A hit is a stretch of the text within EDITS edits for each word of an item, of whole
    words without regard to case and punctuation; for each item the best one counts.
    Items under LEAST_WORDS words count without edits, those under SHORT_WORDS as whole
    texts; items that are null or without words aren't looked for, and null and empty texts
    have no hits. Items given twice count once for each id; an item without an id isn't
    looked for. Repeated rows are flagged alike; an empty table of texts or of items gives
    no hits. A column `hits` of docs comes back as hits_input.

    The benchmark goes to the tasks in passes of at most PASS_WORDS words (or one longer
    item), so a larger one takes more passes over the texts and no more memory, in the
    driver neither.
    """
    prepare(docs.sparkSession)
    docs, text_col = aside(docs, ["hits"], text_col)
    items = benchmark.select(F.col(item_col).cast("long"), item_text).dropna().distinct()
    out = docs.withColumn("hits", F.array().cast(f"array<struct<{HIT.replace(' ', ':').replace(',:', ',')}>>"))
    some: list[tuple[int, np.ndarray]] = []
    size = 0
    for item, text in items.orderBy(*items.columns).toLocalIterator():
        words = _item_words(text)
        if some and size + len(words) > PASS_WORDS:
            out, some, size = _one_pass(out, some, text_col), [], 0
        if len(words):
            some.append((item, words))
            size += len(words)
    return _one_pass(out, some, text_col) if some else out


#: The last passes' items that this worker has prepared, by their broadcast.
_prepared: dict[str, Benchmark] = {}


def _benchmark_of(name: str, sent) -> Benchmark:
    """Prepared once in a worker: a function of the module, as tasks get copies of what they close over."""
    if name not in _prepared:
        while len(_prepared) >= PREPARED:
            _prepared.pop(next(iter(_prepared)))
        own, sampled = sent.value
        _prepared[name] = Benchmark([(item, np.frombuffer(words, np.uint64)) for item, words in own], sampled)
    return _prepared[name]


def _one_pass(docs: DataFrame, items: list[tuple[int, np.ndarray]], text_col: str) -> DataFrame:
    at, names = docs.columns.index(text_col), docs.columns
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("first_word", pa.int32()), ("n_words", pa.int32())]))
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(([(item, words.tobytes()) for item, words in items], samplings(items)))  # at most PASS_WORDS words
    name = f"{context.applicationId}-{uuid.uuid4().hex}"

    def run(batches):
        benchmark = _benchmark_of(name, sent)
        for batch in batches:
            hits = []
            for _, block in textblocks.blocks(batch.column(at), lower=True, separator=APART):
                hits += benchmark.search(block)
            old = batch.column(names.index("hits")).to_pylist()
            fields = ("item_id", "edits", "first_word", "n_words")
            new = pa.array([a + [dict(zip(fields, h, strict=True)) for h in b] for a, b in zip(old, hits, strict=True)], kind)
            yield pa.RecordBatch.from_arrays([new if n == "hits" else c for n, c in zip(names, batch.columns, strict=True)], names)

    return docs.mapInArrow(run, docs.schema)


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc id, item_id, edits, first_word, n_words): one row for each item found in a text."""
    found = flag(docs.select(id_col, "text"), benchmark).select(id_col, F.explode("hits").alias("hit"))
    return found.select(id_col, "hit.*")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, as they are, whose texts hold no passage of the benchmark."""
    flagged = flag(docs, benchmark, text_col)
    return flagged.where(F.size("hits") == 0).drop("hits").toDF(*docs.columns)
