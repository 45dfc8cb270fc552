"""Operator 8: toxicity by a weighted grammar of finite-state transducers over clauses.

A lexical transducer turns words into weighted symbols: insults and threats, whose words
and stems are learned from labelled rows, and short lists of target, negation and
reported-speech words. Further transducers rewrite the symbols of a clause: one marks
targets that are addressed right after an insult, one threats that follow a target, one
insults and such threats in the scope of a negation, one those in reported speech, one
insults shortly after a target. Their composition reads a clause once and gives the
pattern and weight of each match. A text's evidence is the summed weight of its patterns,
and a logistic model fitted on the labelled rows, with the patterns' usual weights as its
prior, turns it into a score.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import bounded_sample, aside, prepare

#: Labelled rows that lexicon and weights are learned from, at most.
SAMPLE_ROWS = 6_000
#: A word or stem must be in texts of so many different labelled toxic groups of copies.
#: No share of all toxic rows is asked for, which words of a small language never reach.
SUPPORT = 3
#: Least log-odds of a learned word or stem, and the least of them less a standard error if
#: it is in texts that aren't toxic.
LEAST_WEIGHT, LEAST_SURE = 2.5, 2.25
#: Lengths of stems.
STEMS = (4, 5, 6, 7, 8)
#: Words and stems handed on at once.
TOGETHER = 100_000
#: Words after a negation that it reaches, and words between an insult and its target.
SCOPE = 3
PREDICTED_FROM = 0.3

# Common words of the four languages of the tables.
THREATS = "kill hurt destroy burn beat töten umbringen vernichten tuer détruire frapper matar destruir golpear".split()
TARGETS = "you your they them he she du dich dein ihr sie tu toi vous ils elle tú usted ellos ella".split()
NEGATIONS = "not no never nicht kein keine nie ne pas jamais nunca ningún".split()
REPORTS = "said says wrote called quoted sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()

WORD = re.compile(r"[^\W\d_]+")
BREAK = re.compile(r"[.!?;:\n]")
#: Patterns that an insult or threat can end up in, the last symbols that mean them (by their
#: place in PATTERNS), and the bias and weights that they usually have.
PATTERNS = ["plain", "targeted", "negated", "reported", "threat"]
ENDS = {"insult": 0, "targeted": 1, "addressed": 1, "negated": 2, "reported": 3, "aimed": 4}
USUAL = np.array([-3.0, 1.2, 1.4, 0.3, 0.3, 1.2])
PRIOR_STRENGTH = 1.0


def held_out(id_column: Column) -> Column:
    """Rows whose labels are for testing only."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Transducer:
    """Rules (state, symbol) -> (state, symbol); what has no rule passes and resets to state 0."""

    def __init__(self, rules: dict[tuple[int, str], tuple[int, str]], other: dict[int, int]):
        self.rules, self.other = rules, other

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.rules.get((state, symbol)) or (self.other.get(state, 0), symbol)


def _insult() -> Transducer:
    """Up to SCOPE words after an insult, a target is addressed by it."""
    rules = {(s, "insult"): (SCOPE, "insult") for s in range(SCOPE + 1)}
    rules |= {(s, "target"): (0, "addressed") for s in range(1, SCOPE + 1)}
    return Transducer(rules, {s: s - 1 for s in range(1, SCOPE + 1)})


def _threat() -> Transducer:
    """After a target, to the clause's end, threats are aimed; others are words as any."""
    rules = {(0, "target"): (1, "target"), (0, "addressed"): (1, "addressed"), (0, "threat"): (0, "word"), (1, "threat"): (1, "aimed")}
    return Transducer(rules, {1: 1})


def _negation() -> Transducer:
    """After a negation, SCOPE words long, insults and aimed threats are negated ones."""
    rules = {(s, "neg"): (SCOPE, "neg") for s in range(SCOPE + 1)}
    rules |= {(s, kind): (s - 1, "negated") for s in range(1, SCOPE + 1) for kind in ("insult", "aimed")}
    rules |= {(s, "addressed"): (s - 1, "target") for s in range(1, SCOPE + 1)}
    return Transducer(rules, {s: s - 1 for s in range(1, SCOPE + 1)})


def _reported() -> Transducer:
    """After a word of saying, to the clause's end, insults and aimed threats are reported ones."""
    rules = {(0, "report"): (1, "report"), (1, "insult"): (1, "reported"), (1, "aimed"): (1, "reported"), (1, "addressed"): (1, "target")}
    return Transducer(rules, {1: 1})


def _targeted() -> Transducer:
    """Shortly after a target, insults are aimed at it."""
    rules = {(s, kind): (SCOPE, kind) for s in range(SCOPE + 1) for kind in ("target", "addressed")}
    rules |= {(s, "insult"): (s - 1, "targeted") for s in range(1, SCOPE + 1)}
    return Transducer(rules, {s: s - 1 for s in range(1, SCOPE + 1)})


class Lexicon(NamedTuple):
    """Weights of insult words and of stems (a stem is the beginning of a longer word)."""

    words: dict[str, float]
    stems: dict[str, float]


class Lexical:
    """The transducer of one state that reads words: each becomes a symbol with a weight."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.symbols = {w: s for ws, s in ((TARGETS, "target"), (NEGATIONS, "neg"), (REPORTS, "report"), (THREATS, "threat")) for w in ws}

    def read(self, word: str) -> tuple[str, float]:
        weight = max([self.lexicon.words.get(word, 0.0), *(self.lexicon.stems.get(word[:n], 0.0) for n in STEMS if len(word) > n)])
        return ("insult", weight) if weight else (self.symbols.get(word, "word"), 1.0)


class Composition:
    """Transducers one after another, each reading what the one before writes; the lexical one reads the words."""

    def __init__(self, lexical: Lexical, parts: list[Transducer]):
        self.lexical, self.parts = lexical, parts
        self.start = (0,) * len(parts)
        self._step = functools.lru_cache(maxsize=None)(self._compose)  # few states and symbols

    def _compose(self, states: tuple[int, ...], symbol: str) -> tuple[tuple[int, ...], str]:
        after = []
        for part, state in zip(self.parts, states, strict=True):
            state, symbol = part.step(state, symbol)
            after.append(state)
        return tuple(after), symbol

    def step(self, states: tuple[int, ...], word: str) -> tuple[tuple[int, ...], str, float]:
        symbol, weight = self.lexical.read(word)
        return *self._step(states, symbol), weight


class Grammar:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights
        self.composed = Composition(Lexical(lexicon), [_insult(), _threat(), _negation(), _reported(), _targeted()])
        self.triggers = ahocorasick.Automaton()
        for entry in {*lexicon.words, *lexicon.stems, *THREATS}:
            self.triggers.add_word(entry, len(entry))
        if len(self.triggers):
            self.triggers.make_automaton()

    def evidence(self, text: str | None) -> np.ndarray:
        """Summed weights of the patterns of the clauses of a whole text, damped."""
        out = np.zeros(len(PATTERNS))
        if text and len(self.triggers):
            text = text.lower()
            done = 0
            for end, size in self.triggers.iter(text):
                at = end - size + 1
                if at < done or (at and WORD.match(text[at - 1])):
                    continue
                begins = max((text.rfind(mark, done, at) for mark in ".!?;:\n"), default=-1) + 1
                found = BREAK.search(text, at)
                done = found.start() if found else len(text)
                self._clause(text[max(begins, 0) : done], out)
        return np.log1p(out)

    def _clause(self, clause: str, out: np.ndarray) -> None:
        states = self.composed.start
        for word in WORD.findall(clause):
            states, symbol, weight = self.composed.step(states, word)
            if (pattern := ENDS.get(symbol)) is not None:
                out[pattern] += weight

    def score(self, evidence: np.ndarray) -> np.ndarray:
        """Between 0 and 1; texts without evidence get the model's base rate."""
        z = self.weights[0] + evidence @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_weights(evidence: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Bias and pattern weights: logistic regression drawn towards the usual weights."""
    x = np.column_stack([np.ones(len(evidence)), evidence])
    w = USUAL.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (toxic - p) - PRIOR_STRENGTH * (w - USUAL)
        bend = (x * (p * (1 - p))[:, None]).T @ x + PRIOR_STRENGTH * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _entries(batches):
    """(entry, kind, toxic, sketch) of each word and stem of each text, once a text.

    Near copies mostly have the same sketch, so that they count as one text; of texts
    without long words only exact copies do.
    """
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())

    def made():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["entry", "kind", "toxic", "sketch"])

    for batch in batches:
        out = ([], [], [], [])
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = set(WORD.findall((text or "").lower()))
            sketch = min((_hash(w) for w in words if len(w) > 6), default=zlib.crc32((text or "").encode()))
            found = {(w, "word") for w in words} | {(w[:n], "stem") for w in words for n in STEMS if len(w) > n}
            for entry, kind in found:
                for column, value in zip(out, (entry, kind, toxic, sketch), strict=True):
                    column.append(value)
            if len(out[0]) >= TOGETHER:
                yield made()
                out = ([], [], [], [])
        yield made()


def _hash(word: str) -> int:
    value = 1469598103934665603
    for byte in word.encode():
        value = (value ^ byte) * 1099511628211 & 0x7FFFFFFFFFFFFFFF
    return value


def entry_weight(bad: int, fine: int, toxic: int, clean: int) -> float:
    """Log-odds less a standard error of an entry in so many texts of either kind, or 0.

    Rare entries so get small weights instead of none.
    """
    if bad < SUPPORT:
        return 0.0
    odds = math.log((bad + 0.5) / (toxic + 1)) - math.log((fine + 0.5) / (clean + 1))
    sure = odds - math.sqrt(1 / (bad + 0.5) + 1 / (fine + 0.5))
    return round(max(sure, 0.0), 9) if odds >= LEAST_WEIGHT and (not fine or sure >= LEAST_SURE) else 0.0


def _lexicon(found: list, toxic: int, clean: int, less: tuple[int, int] = (0, 0)) -> Lexicon:
    """Of rows (entry, kind, bad, fine); `less` texts of either kind are left out of the counts."""
    out = Lexicon({}, {})
    for r in found:
        if weight := entry_weight(r["bad"] - less[0], max(0, r["fine"] - less[1]), toxic, clean):
            (out.words if r["kind"] == "word" else out.stems)[r["entry"]] = weight
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Grammar:
    """The grammar learned from at most about SAMPLE_ROWS labelled rows that aren't held out.

    Without labels the grammar has the fixed words and usual weights only.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).dropna().where(~held_out(F.col("id"))).dropDuplicates(["id"])
    known = bounded_sample(known, F.col("id"), SAMPLE_ROWS)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id").select("text", "toxic")
    each = rows.mapInArrow(_entries, "entry string, kind string, toxic int, sketch long")
    counted = each.groupBy("entry", "kind").agg(
        F.count_distinct(F.when(F.col("toxic") == 1, F.col("sketch"))).alias("bad"),
        F.count_distinct(F.when(F.col("toxic") == 0, F.col("sketch"))).alias("fine"),
    )
    sizes = known.groupBy("toxic").count().collect()
    many = {r["toxic"]: r["count"] for r in sizes}
    toxic, clean = many.get(1, 0), many.get(0, 0)

    def odds(fine):
        return F.log((F.col("bad") + 0.5) / (toxic + 1)) - F.log((fine + 0.5) / (clean + 1))

    able = counted.where((F.col("bad") >= SUPPORT) & (odds(F.greatest(F.col("fine") - 1, F.lit(0))) >= LEAST_WEIGHT))
    # Entries of the sample only, and of SUPPORT toxic texts of it each.
    best = able.orderBy(F.desc(F.round(odds(F.col("fine")), 9)), "entry", "kind").collect()
    lexicon = _lexicon(best, toxic, clean)
    # A labelled row is measured without its own share in the counts, as new texts are.
    others = {1: _lexicon(best, toxic, clean, (1, 0)), 0: _lexicon(best, toxic, clean, (0, 1))}
    grammar = Grammar(lexicon, USUAL)

    def run(batches):
        own = {kind: Grammar(words, USUAL) for kind, words in others.items()}
        for batch in batches:
            pairs = zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True)
            seen = np.array([own[int(toxic == 1)].evidence(t) for t, toxic in pairs]).reshape(-1, len(PATTERNS))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(seen[:, i]) for i in range(len(PATTERNS)))], ["toxic", *PATTERNS])

    got = rows.mapInArrow(run, "toxic int, " + ", ".join(f"{p} double" for p in PATTERNS)).toPandas()
    got = got.sort_values(["toxic", *PATTERNS])
    if len(got):
        grammar = Grammar(lexicon, fit_weights(got[PATTERNS].to_numpy(), (got["toxic"] == 1).to_numpy().astype(float)))
    return grammar


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (1 from PREDICTED_FROM on).

    Only the text decides a score. A null or empty text has no evidence and gets the base
    rate; repeated rows get equal scores; a null id is not held out; of an id labelled
    twice one label counts. An empty table gives no rows; without labels the fixed words
    and usual weights decide. Columns of docs that have these names already come back with
    _input behind them.
    """
    prepare(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col)
    docs, id_col, text_col = aside(docs, ["held_out", "score", "predicted"], id_col, text_col)
    lexicon, weights = model.lexicon, model.weights
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches):
        grammar = Grammar(lexicon, weights)
        for batch in batches:
            seen = np.array([grammar.evidence(t.as_py()) for t in batch.column(at)]).reshape(-1, len(PATTERNS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(grammar.score(seen))], [*names, "score"])

    old = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    scored = docs.mapInArrow(run, f"{old}, score double")
    return scored.withColumns({"held_out": held_out(F.col(id_col)), "predicted": (F.col("score") >= PREDICTED_FROM).cast("int")})
