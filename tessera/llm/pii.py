"""Personal data in texts: plain identifiers, and disguised ones by transducers that keep offsets.

A Tape is a text with the source span of each of its characters. Transducers rewrite one tape
into the next: look-alike letters and invisible characters, then spelled digits, then disguised
at and dot signs. The identifiers of the last tape that hold a rewritten character are mapped
back to source characters.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import aside, prepare

KINDS = ("email", "ip", "card", "phone")
Found = tuple[str, int, int]

# Plain identifiers. What a match can't begin within is told by a look behind, so that long runs of
# one kind of character are walked once.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    odd, even = map(int, digits[-1::-2]), (int(d) * 2 for d in digits[-2::-2])
    return (sum(odd) + sum(d - 9 if d > 9 else d for d in even)) % 10 == 0


def _emails(text: str) -> Iterable[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(done, at + 1))


def plain(text: str) -> list[Found]:
    """Identifiers as they stand: leftmost ones that don't overlap, those that fail their check dropped."""
    found = [("email", *span) for span in _emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() <= 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.findall(m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


class Tape:
    """A text whose character i stands for source characters starts[i] to ends[i]; `changed` marks rewritten ones."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None, changed: np.ndarray | None = None):
        self.text = text
        self.starts = np.arange(len(text)) if starts is None else starts
        self.ends = self.starts + 1 if ends is None else ends
        self.changed = np.zeros(len(text), bool) if changed is None else changed

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Tape:
        """With each text[a:b] of the edits (in order, apart) replaced; the new characters stand for all of it."""
        if not edits:
            return self
        texts, starts, ends, changed, done = [], [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            if a < done:  # two invisible characters in a row: the mark went to the second one
                for kept in (texts, starts, ends, changed):
                    kept.pop()
                done = a
            texts += [self.text[done:a], new]
            starts.append(self.starts[done:a])
            ends.append(self.ends[done:a])
            changed.append(self.changed[done:a])
            if new:
                starts.append(np.full(len(new), self.starts[a]))
                ends.append(np.full(len(new), self.ends[b - 1]))
                changed.append(np.ones(len(new), bool))
            elif b < len(self.text):  # what is left out marks what follows
                starts.append(self.starts[b : b + 1])
                ends.append(self.ends[b : b + 1])
                changed.append(np.ones(1, bool))
                texts.append(self.text[b])
                b += 1
            done = b
        return Tape("".join(texts), np.concatenate(starts), np.concatenate(ends), np.concatenate(changed))

    def source(self, start: int, end: int) -> tuple[int, int]:
        return int(self.starts[start]), int(self.ends[end - 1])


# Look-alikes. Letters of other scripts drawn like Latin ones, and signs like . @ + -
LOOK_ALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХЗаеѕіјорсухһԁԛԝѵαβγεικνορτυχωΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɡɩ",
        "ABESIJKMHOPCTYX3aesijopcyxhdqwvaByeikvoptuxwABEZHIKMNOPTYXigi",
        strict=True,
    )
) | {"。": ".", "·": ".", "•": ".", "∙": ".", "⋅": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "ʘ": "@", "➕": "+"}
#: Characters of these Unicode categories that show nothing.
INVISIBLE = {"Cf", "Mn", "Me"}


@functools.lru_cache(maxsize=1 << 16)
def folded(char: str) -> str:
    """The ASCII character that a character looks like, nothing for an invisible one, else itself."""
    if char < "\x80":
        return char
    if char in LOOK_ALIKES:
        return LOOK_ALIKES[char]
    plain_form = unicodedata.normalize("NFKC", char)
    if len(plain_form) == 1 and plain_form < "\x80":
        return plain_form
    digit = unicodedata.digit(char, None)
    if digit is not None:
        return str(digit)
    if unicodedata.category(char) in INVISIBLE:
        return ""
    return " " if unicodedata.category(char) == "Zs" else char


def unmasked(tape: Tape) -> Tape:
    """Look-alikes and invisible characters; blanks of other widths count as they are but aren't marked."""
    to = {c: folded(c) for c in set(tape.text) if c >= "\x80"}
    odd = {c: new for c, new in to.items() if c != new}
    if not odd:
        return tape
    edits = [(m.start(), m.end(), odd[m[0]]) for m in re.finditer("[" + "".join(map(re.escape, odd)) + "]", tape.text)]
    out = tape.rewritten(edits)
    return Tape(out.text, out.starts, out.ends, out.changed & (np.frombuffer(out.text.encode("utf-32-le"), np.uint32) != 32))


# Words for digits and signs. Fixed values, by language: English, German, French, Spanish.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
TIMES = {"double": 2, "triple": 3}
AT_WORDS = ("at", "ät", "klammeraffe", "arobase", "arroba")
DOT_WORDS = ("dot", "punkt", "point", "punto")
PLUS_WORDS = ("plus", "más")

_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_DOTS, _ATS, _PLUS = "|".join(DOT_WORDS), "|".join(AT_WORDS), "|".join(PLUS_WORDS)
_GAP = r"(?:\s*[,;/-]\s*|\s+)"
_TOKEN = rf"(?:(?:double|triple)\s+(?:{_WORD}|\d)|{_WORD}|{_DOTS}|\d{{1,4}})"
_SPELLED = re.compile(rf"(?<!\w)(?:(?:{_PLUS}){_GAP}|\+\s*)?(?:(?:double|triple)\s+)?(?:{_WORD}|\d{{1,4}}(?={_GAP}(?:{_WORD}|double|triple|{_DOTS})\b))(?:{_GAP}{_TOKEN})*(?:{_GAP}(?:{_WORD})|{_GAP}\d{{1,4}})(?!\w)", re.I)
_PART = re.compile(rf"(double|triple)\s+({_WORD}|\d)|({_WORD})|({_DOTS})|({_PLUS}|\+)|(\d{{1,4}})", re.I)
#: Spelled digits alone are a phone number from this many on; fewer in a row are words of a sentence.
LEAST_SPELLED = 8
#: O and l among digits, as in 4O8-55l2.
_LEET = re.compile(r"(?<=[0-9])[ ().-]?[OoIl|]{1,2}(?=[ ().-]?[0-9])")
_LEET_DIGITS = str.maketrans("OoIl|", "00111")


def digits_of(tape: Tape) -> tuple[Tape, list[tuple[int, int]]]:
    """Spelled digits and letters among digits; then the spans, in the new tape, of digits that were only words."""
    edits, taken = [], np.zeros(len(tape.text), bool)
    for m in _SPELLED.finditer(tape.text):
        new, words, spelled = "", 0, 0
        for part in _PART.finditer(m[0]):
            times, of, word, dot, plus, number = part.groups()
            digits = DIGIT_WORDS.get(of.lower(), of) * TIMES[times.lower()] if times else DIGIT_WORDS[word.lower()] if word else ""
            new += digits or ("." if dot else "+" if plus else number)
            words += bool(digits or dot)
            spelled += len(digits)
        if words >= 2 and len(new) >= 4:
            edits.append((m.start(), m.end(), new, new.isdigit() and 2 * spelled >= len(new)))
            taken[m.start() : m.end()] = True
    for m in _LEET.finditer(tape.text):
        if not taken[m.start() : m.end()].any():
            edits += [(i, i + 1, tape.text[i].translate(_LEET_DIGITS), False) for i in range(m.start(), m.end()) if tape.text[i] in "OoIl|"]
    edits.sort()
    spans, moved = [], 0
    for a, b, new, alone in edits:
        if alone:
            spans.append((a + moved, a + moved + len(new)))
        moved += len(new) - (b - a)
    return tape.rewritten([e[:3] for e in edits]), spans


_OPEN, _CLOSE = r"[\[({<«]", r"[\])}>»]"
#: Signs in brackets or between marks, as entities or in URL code: disguises wherever they stand.
_STRONG_AT = rf"\s*{_OPEN}\s*(?:{_ATS}|@)\s*{_CLOSE}\s*|\s*[-_*~|]+\s*(?:{_ATS})\s*[-_*~|]+\s*|&#0*64;|&#x0*40;|&commat;|%40|\s+@\s+|\s+@|@\s+(?=[A-Za-z0-9-]+[.\[({{])"
_STRONG_DOT = rf"\s*{_OPEN}\s*(?:{_DOTS}|\.)\s*{_CLOSE}\s*|\s*[-_*~|]+\s*(?:{_DOTS})\s*[-_*~|]+\s*|&#0*46;|&#x0*2e;|&period;|%2e"
_SIGNS = re.compile(rf"({_STRONG_AT})|({_STRONG_DOT})", re.I)
#: Bare words are signs only inside a whole address.
_BARE = re.compile(rf"(\s+(?:{_ATS})\s+|@)[a-z0-9-]+((?:(?:\s+(?:{_DOTS})\s+|\.)[a-z0-9-]+)*)(\s+(?:{_DOTS})\s+|\.)[a-z]{{2,24}}(?![a-z0-9-])", re.I)
_BARE_DOT = re.compile(rf"\s+(?:{_DOTS})\s+", re.I)
_LOCAL_WORDS = re.compile(rf"(?:[a-z0-9_%+-]+(?:\s+(?:{_DOTS})\s+|\.))*[a-z0-9_%+-]+$", re.I)
_BARE_IP = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:\s+(?:{_DOTS})\s+|\s?\.\s?)[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_SPACED_DOT = re.compile(rf"\s+(?:{_DOTS})\s+|\s?\.\s|\s\.", re.I)
#: The longest address that mail can have; what stands further left of an at sign isn't its local part.
LONGEST = 254


def signs_of(tape: Tape) -> Tape:
    """Disguised at and dot signs."""
    edits = [(m.start(), m.end(), "@" if m[1] else ".") for m in _SIGNS.finditer(tape.text)]
    tape = tape.rewritten([e for e in edits if tape.text[e[0] : e[1]] != e[2]])
    edits = []
    for m in _BARE.finditer(tape.text):
        local = _LOCAL_WORDS.search(tape.text[max(0, m.start() - LONGEST) : m.start()])
        dots = [d.span() for d in _BARE_DOT.finditer(tape.text, m.end(1), m.end())]
        # "look at example.com" is no address, "j.doe at example.com" is one
        if not local or not (dots or m[1] == "@" or re.search(r"[0-9._]", local[0])):
            continue
        first = m.start() - len(local[0])
        edits += [(*d.span(), ".") for d in _BARE_DOT.finditer(tape.text, first, m.start())]
        edits += [(m.start(1), m.end(1), "@")] if m[1] != "@" else []
        edits += [(a, b, ".") for a, b in dots]
    for m in _BARE_IP.finditer(tape.text):
        edits += [(*d.span(), ".") for d in _SPACED_DOT.finditer(tape.text, *m.span())]
    apart, done = [], 0
    for a, b, new in sorted(set(edits)):
        if a >= done:
            apart.append((a, b, new))
            done = b
    return tape.rewritten(apart)


def disguised(text: str) -> list[Found]:
    """Identifiers that the transducers bring out, by source characters; plain ones aren't repeated."""
    tape, spelled = digits_of(unmasked(Tape(text)))
    found = [("phone", *tape.source(a, b)) for a, b in spelled if LEAST_SPELLED <= b - a <= 15]
    cards = [("card", *tape.source(a, b)) for a, b in spelled if 16 <= b - a <= 19 and luhn(tape.text[a:b])]
    tape = signs_of(tape)
    before = np.concatenate([[0], np.cumsum(tape.changed)])
    for kind, a, b in plain(tape.text):
        if before[b] > before[a]:
            found.append((kind, *tape.source(a, b)))
    return found + cards


def all_spans(text: str, suspicious: bool = True) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, plain) of all identifiers, by kind, then start; disguised ones lie in no other of their kind."""
    spans = [(*f, True) for f in plain(text)]
    if suspicious:
        reach = dict.fromkeys(KINDS, -1)
        both = spans + [(*f, False) for f in set(disguised(text))]
        spans = []
        for kind, a, b, base in sorted(both, key=lambda f: (f[1], -f[2], not f[3])):
            if base or b > reach[kind]:
                spans.append((kind, a, b, base))
            reach[kind] = max(reach[kind], b)
    return sorted(spans, key=lambda f: (KINDS.index(f[0]), f[1], f[2]))


def redacted(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with each stretch that spans cover replaced by the kind of the first one, in brackets."""
    out, done = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda f: (f[1], -f[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


#: A text without any of these has no identifier, in no disguise: RE2, over whole texts.
_PLAIN_SIGN = r"@|[0-9].*[0-9]"
_ANY_WORD = "|".join(sorted([*DIGIT_WORDS, *DOT_WORDS, *TIMES], key=len, reverse=True))
_GAP2 = r"(\s*[,;/-]\s*|\s+)"
_HINT = (
    rf"(?i)(^|\W)({_ANY_WORD}|[0-9]{{1,4}}){_GAP2}({_ANY_WORD}|[0-9]){_GAP2}?"
    rf"|[\[({{<«*~|_-]\s*({_ATS}|{_DOTS}|@|\.)\s*[\])}}>»*~|_-]|&#|&commat;|&period;|%40|%2e|\s@|@\s|\s({_ATS})\s+[a-z0-9-]+(\s+({_DOTS})\s|\.[a-z])|@[a-z0-9-]+\s+({_DOTS})\s"
    r"|[0-9][ ().-]?[OoIl|]{1,2}[ ().-]?[0-9]|[0-9]\s+\.|[0-9]\.\s+[0-9]"
)
#: Characters that may be folded: all but Latin letters with marks.
_ODD = r"[^\x00-\x{9F}\x{A1}-\x{A9}\x{AB}-\x{AC}\x{AE}-\x{B1}\x{B4}-\x{B6}\x{BB}\x{BF}-\x{17F}]"


def find(docs: DataFrame, text_col: str = "text", redact: bool = False) -> DataFrame:
    """docs with `spans` in place of the text: structs of kind, start, end (code points, end exclusive) and whether it is plain.

    Spans go by kind (email, ip, card, phone), then start. Plain ones are what the patterns find in
    the text as it is; disguised ones are added where they lie in no other span of their kind. With
    `redact`, `redacted` holds the text with the kinds in place of the identifiers. Null, empty and
    very long texts are taken as they are, a null text has no spans and its redacted text is empty.
    Repeated rows stay repeated, other columns pass through, an empty table gives no rows; columns
    named spans or redacted come back with _input behind their names. A text is searched whole and
    alone, so no text's work depends on another's.
    """
    prepare(docs.sparkSession)
    docs, text_col = aside(docs, ["spans", "redacted"] if redact else ["spans"], text_col)
    rest = [f for f in docs.schema.fields if f.name != text_col]
    at = docs.columns.index(text_col)
    field = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("plain", pa.bool_())]))

    def run(batches):
        for batch in batches:
            texts = batch.column(at).fill_null("")
            odd = pc.or_(pc.match_substring_regex(texts, _HINT), pc.match_substring_regex(texts, _ODD)).to_pylist()
            worth = pc.match_substring_regex(texts, _PLAIN_SIGN).to_pylist()
            spans, clean = [], []
            for text, suspicious, some in zip(texts, odd, worth, strict=True):
                text = text.as_py() if suspicious or some or redact else ""
                spans.append(all_spans(text, suspicious))
                clean.append(redacted(text, spans[-1]) if redact else None)
            rows = pa.array([[dict(zip(("kind", "start", "end", "plain"), s, strict=True)) for s in found] for found in spans], field)
            kept = [batch.column(i) for i in range(batch.num_columns) if i != at]
            more = [pa.array(clean, pa.string())] if redact else []
            yield pa.RecordBatch.from_arrays([*kept, rows, *more], [*(f.name for f in rest), "spans", *(["redacted"] if redact else [])])

    own = "spans array<struct<kind: string, start: int, end: int, plain: boolean>>" + (", redacted string" if redact else "")
    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), own]))


def digests(found: DataFrame) -> DataFrame:
    """`found` with counts and a digest of the plain spans, and all spans as one string."""

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s.plain & (s.kind == kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s.plain)
    counts = [number(kind) for kind in KINDS]
    return found.select(*[c for c in found.columns if c != "spans"], *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
