"""Operator 9: byte-level BPE encoding and decoding with a segment tree over byte positions.

Text is cut by the tokenizer's pattern; each piece is merged on its own. A segment tree
over the piece's bytes keeps, for every live position, the rank of the pair that starts
there, and at its root the least rank with the leftmost position. A merge removes the
right neighbour and updates three positions at most, each in logarithmic time, so a piece
of n bytes costs n log n however long it is. Pieces of like length merge side by side.

Spark deals out the rows; a worker merges each distinct piece once while it remembers it,
and remembers a bounded number: those of late, and of those before them the ones met again.
"""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from tessera.llm.shared import aside, prepare, ship_file

#: Remembered pieces in a Python worker; beyond, those not met again among as many new ones go.
REMEMBER = 150_000
#: Longer pieces aren't remembered, so that memory stays bounded.
REMEMBER_CHARS = 64
#: Unicode's White_Space; the regex module's \s has four more control characters.
SPACE = r"\t-\r \x85\xa0  -     　"
NO_RANK = (1 << 31) - 1
#: Bytes of pieces that merge together.
FOREST_BYTES = 1 << 18
#: Longer pieces merge alone.
ALONE_BYTES = 128
#: Ids that are decoded together.
DECODE_IDS = 1 << 16
#: Characters of text that are encoded together; a longer text is alone.
TOGETHER = 2_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token bytes, from lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class RankForest:
    """A segment tree for each of several pieces of at most `width` bytes.

    Leaf i of a tree is the rank of the pair whose left part starts at byte i, an inner
    node the lesser of its two: the root is the least rank of the piece, and going down to
    the left whenever the left child equals its parent finds the leftmost such pair. All
    pieces take a step at a time together.
    """

    def __init__(self, leaves: np.ndarray):
        rows, self.width = leaves.shape
        self.least = np.full((rows, 2 * self.width), NO_RANK, np.int32)
        self.least[:, self.width :] = leaves
        for i in range(self.width - 1, 0, -1):
            np.minimum(self.least[:, 2 * i], self.least[:, 2 * i + 1], out=self.least[:, i])

    def put(self, rows: np.ndarray, positions: np.ndarray, ranks: np.ndarray) -> None:
        """Point updates, each followed up to the root."""
        node = positions + self.width
        self.least[rows, node] = ranks
        while len(node) and node[0] > 1:
            node >>= 1
            self.least[rows, node] = np.minimum(self.least[rows, 2 * node], self.least[rows, 2 * node + 1])

    def leftmost(self, rows: np.ndarray) -> np.ndarray:
        node = np.ones(len(rows), np.int64)
        while node[0] < self.width:
            right = self.least[rows, 2 * node] != self.least[rows, node]
            node = 2 * node + right
        return node - self.width


class RankTree:
    """The same tree for one long piece."""

    def __init__(self, ranks: list[int]):
        self.width = 1 << max(0, len(ranks) - 1).bit_length()
        self.least = [NO_RANK] * self.width + ranks + [NO_RANK] * (self.width - len(ranks))
        for i in range(self.width - 1, 0, -1):
            self.least[i] = min(self.least[2 * i], self.least[2 * i + 1])

    def put(self, position: int, rank: int) -> None:
        least, i = self.least, position + self.width
        least[i] = rank
        while i > 1:
            i >>= 1
            least[i] = min(least[2 * i], least[2 * i + 1])

    def leftmost(self) -> int:
        least, i = self.least, 1
        while i < self.width:
            i = 2 * i + (least[2 * i] != least[i])
        return i - self.width


def pattern_keeps_spaces(pattern: str) -> bool:
    """Whether no piece of the pattern goes on over a single space."""
    pieces = regex.compile(pattern).findall
    letters = "aé文7½.,'’_-\u0301😀"
    return all(pieces(f"{x}{x} {y}{y}") == pieces(x + x) + pieces(f" {y}{y}") for x in letters for y in letters)


class Encoded(NamedTuple):
    ids: str
    data: bytes


class ByteBPE:
    """Encodes and decodes by a rank file and the pattern that cuts text before merges."""

    def __init__(self, path: str, pattern: str):
        if not pattern_keeps_spaces(pattern):
            raise ValueError("the pattern must begin a piece at each single space between other characters")
        self.ranks = load_ranks(path)
        self.decimals = [str(i) for i in range(1 + max(self.ranks.values()))]
        tokens = dict(zip(self.ranks.values(), self.ranks, strict=True))
        self.token_sizes = np.array([len(tokens.get(i, b"")) for i in range(len(self.decimals))])
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.token_bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(len(self.decimals))), np.uint8)
        explicit = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self.pieces = regex.compile(explicit).findall
        #: (left id, right id) in one number, sorted, and the rank of the pair.
        pairs = sorted(
            (self.ranks[t[:i]] << 32 | self.ranks[t[i:]], rank)
            for t, rank in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        )
        self.pair_keys = np.array([p for p, _ in pairs] + [1 << 62], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs] + [NO_RANK], np.int32)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, str] = {}
        self.earlier: dict[str, str] = {}

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_RANK)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece: the lowest rank merges first, the leftmost among equals."""
        out: list[list[int]] = [[] if rank is None else [rank] for rank in map(self.ranks.get, pieces)]
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if not out[i] and piece:
                by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, which in by_width.items():
            if width > ALONE_BYTES:
                for i in which:
                    out[i] = self._merge_long(pieces[i])
                continue
            at_once = max(1, FOREST_BYTES // width)
            for k in range(0, len(which), at_once):
                part = which[k : k + at_once]
                for i, ids in zip(part, self._merge_alike([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _merge_alike(self, pieces: list[bytes], width: int) -> list[list[int]]:
        n = np.array([len(p) for p in pieces])
        data = np.array(pieces, f"S{width}").view(np.uint8).reshape(-1, width)
        place = np.arange(width)
        live = place < n[:, None]
        ids = np.zeros((len(pieces), width + 1), np.int32)
        ids[:, :width] = self.byte_ids[data]
        after = np.tile(np.arange(1, width + 2), (len(pieces), 1))
        before = np.tile(np.arange(-1, width), (len(pieces), 1))
        leaves = np.full((len(pieces), width), NO_RANK, np.int32)
        inner = place[:-1] < n[:, None] - 1
        leaves[:, :-1][inner] = self._pair(ids[:, : width - 1][inner], ids[:, 1:width][inner])
        forest = RankForest(leaves)
        rows = np.flatnonzero(forest.least[:, 1] != NO_RANK)
        while len(rows):
            at = forest.leftmost(rows)
            gone = after[rows, at]
            end = after[rows, gone]
            ids[rows, at] = forest.least[rows, 1]
            live[rows, gone] = False
            after[rows, at] = end
            before[rows, np.minimum(end, width)] = at
            right = np.where(end < n[rows], self._pair(ids[rows, at], ids[rows, np.minimum(end, width)]), NO_RANK)
            forest.put(rows, gone, np.int32(NO_RANK))
            forest.put(rows, at, right)
            left = before[rows, at]
            has = left >= 0
            some, left = rows[has], left[has]
            forest.put(some, left, self._pair(ids[some, left], ids[some, at[has]]))
            rows = rows[forest.least[rows, 1] != NO_RANK]
        flat = ids[:, :width][live].tolist()
        ends = np.cumsum(live.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _merge_long(self, piece: bytes) -> list[int]:
        ranks, n = self.ranks, len(piece)
        after, before = list(range(1, n + 2)), list(range(-1, n))

        def pair(at: int) -> int:  # the rank of the live part at `at` with the next one
            return ranks.get(piece[at : after[after[at]]], NO_RANK) if after[at] < n else NO_RANK

        tree = RankTree([pair(i) for i in range(n)])
        while tree.least[1] != NO_RANK:
            at = tree.leftmost()
            gone = after[at]
            after[at] = after[gone]
            before[after[at]] = at
            tree.put(gone, NO_RANK)
            tree.put(at, pair(at))
            if before[at] >= 0:
                tree.put(before[at], pair(before[at]))
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : after[at]]])
            at = after[at]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, one after another; gathered some tokens at a time."""
        out = []
        for k in range(0, len(ids), DECODE_IDS):
            part = ids[k : k + DECODE_IDS]
            sizes = self.token_sizes[part]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1]) + np.repeat(self.token_starts[part] - ends + sizes, sizes)
            out.append(self.token_bytes[at].tobytes())
        return b"".join(out)

    def encode_ids(self, text: str) -> list[int]:
        """Ids of one text, without memory of earlier ones."""
        return [i for ids in self.merge([p.encode() for p in self.pieces(text)]) for i in ids]

    def listed(self, texts: list[str]) -> list[str]:
        """The decimal ids of each text, joined by commas."""
        gc.disable()  # what is made here holds no cycles, but would be searched for them
        try:
            cut = [self.pieces(t) for t in texts]
            found = [list(map(self.known.get, c)) for c in cut]
            gaps = [[i for i, ids in enumerate(f) if ids is None] for f in found]
            new = dict.fromkeys(c[i] for c, g in zip(cut, gaps, strict=True) for i in g)
            self._fill(list(new))
            for c, f, g in zip(cut, found, gaps, strict=True):
                for i in g:
                    f[i] = self.known[c[i]]
            for piece in new:
                if len(piece) > REMEMBER_CHARS:
                    del self.known[piece]
            if len(self.known) > REMEMBER:
                self.known, self.earlier = {}, self.known
            return [",".join(f) for f in found]
        finally:
            gc.enable()

    def _fill(self, pieces: list[str]) -> None:
        unknown = []
        for piece in pieces:
            ids = self.earlier.get(piece)
            if ids is None:
                unknown.append(piece)
            else:
                self.known[piece] = ids
        decimal = self.decimals.__getitem__
        for piece, ids in zip(unknown, self.merge([p.encode() for p in unknown]), strict=True):
            self.known[piece] = ",".join(map(decimal, ids))

    def parts(self, texts: list[str]) -> list[list[Encoded]]:
        """Each text encoded and decoded: one part, or none if it is empty."""
        return [[Encoded(ids, self.decode(numbers(ids)))] if ids else [] for ids in self.listed(texts)]


def numbers(ids: str) -> np.ndarray:
    """Ids from decimals joined by commas."""
    return np.fromstring(ids, np.int32, sep=",") if ids else np.zeros(0, np.int32)


@functools.lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One for each Python worker; tasks of the worker share what it remembers."""
    return ByteBPE(path, pattern)


def _in_turn(bpe: ByteBPE, texts: pa.Array) -> Iterator[str]:
    """The ids of each text, encoded some texts at a time."""
    some, size = [], 0
    for text in texts:
        some.append(text.as_py() or "")
        size += len(some[-1])
        if size >= TOGETHER:
            yield from bpe.listed(some)
            some, size = [], 0
    yield from bpe.listed(some)


def encode_digests(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 in place of the text.

    Texts are encoded whole, without special tokens, and decoded again; a null text counts
    as an empty one: no tokens, and the digests of nothing. The digests are of the decimal
    ids joined by commas, and of the decoded bytes. Other columns pass through, repeated
    rows stay repeated, an empty table gives no rows; columns that have these names already
    come back with _input behind them. The rank file goes to the workers with the job. A pattern must begin a
    piece at each single space between other characters, as those of byte-level tokenizers
    do; others are an error.
    """
    prepare(docs.sparkSession)
    docs, text_col = aside(docs, ["n_tokens", "ids_sha256", "decoded_sha256"], text_col)
    rest = [f for f in docs.schema.fields if f.name != text_col]
    at, name = docs.columns.index(text_col), ship_file(docs.sparkSession, path)

    def run(batches):
        bpe = tokenizer(SparkFiles.get(name), pattern)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for listed in _in_turn(bpe, batch.column(at)):
                found = numbers(listed)
                counts.append(len(found))
                ids.append(hashlib.sha256(listed.encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(found)).hexdigest())
            kept = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                [*(f.name for f in rest), "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "n_tokens long, ids_sha256 string, decoded_sha256 string"])
    return docs.mapInArrow(run, schema)


def tokenize(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with `ids` (array of int) in place of the text; a null text has none."""
    prepare(docs.sparkSession)
    docs, text_col = aside(docs, ["ids"], text_col)
    rest = [f for f in docs.schema.fields if f.name != text_col]
    at, name = docs.columns.index(text_col), ship_file(docs.sparkSession, path)

    def run(batches):
        bpe = tokenizer(SparkFiles.get(name), pattern)
        for batch in batches:
            ids = [numbers(listed) for listed in _in_turn(bpe, batch.column(at))]
            kept = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ids, pa.list_(pa.int32()))], [*(f.name for f in rest), "ids"])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "ids array<int>"]))
