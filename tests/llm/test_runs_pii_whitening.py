"""Periodic runs, personal data and whitening against brute force, and on odd input."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import periodic_runs, pii, queries, whitening
from tests.llm.test_operators import DOCS, odd_docs

SMALLEST = "/root/testdata/sf0.001"


def texts_of(spark):
    return {r.doc_id: r.text or "" for r in queries.table(spark, SMALLEST, "documents").select("doc_id", "text").collect()}


# Periodic runs


def runs_by_brute_force(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def row_by_brute_force(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_by_brute_force(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *told, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_transforms_give_back_what_they_took():
    for prime, generator in periodic_runs.PRIMES:
        rows = np.random.default_rng(0).integers(0, prime, (3, 64)).astype(np.uint64)
        assert (periodic_runs.inverse(periodic_runs.transform(rows, prime, generator), prime, generator) == rows).all()


@pytest.mark.parametrize("top", [2, 3, 50, 40_000, 1 << 27])
def test_zero_mismatches_are_exact(top):
    rng = np.random.default_rng(top)
    windows = rng.integers(0, top, (40, 16))
    blocks = np.stack([w[o : o + 8] for w, o in zip(windows, rng.integers(0, 8, 40), strict=True)])
    blocks[20:, 3] += rng.integers(0, 2, 20)
    want = np.array([[(b == w[o : o + 8]).all() for o in range(8)] for b, w in zip(blocks, windows, strict=True)])
    assert (periodic_runs.zero_mismatches(blocks, windows) == want).all()
    assert want.any()


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            kinds, words = rng.choice([1, 2, 2, 3, 50]), []
            for _ in range(rng.randrange(0, 6)):
                part = [rng.randrange(kinds) for _ in range(rng.randrange(1, 12))]
                words += part * rng.randrange(1, 8) + part[: rng.randrange(0, len(part) + 1)]
                words += [rng.randrange(kinds) for _ in range(rng.randrange(0, 5))]
            texts.append([str(w).encode() for w in words])
        for words, found in zip(texts, periodic_runs.runs_of(texts), strict=True):
            assert [tuple(r) for r in found.tolist()] == runs_by_brute_force(words)


def test_stretches_that_share_a_hash_are_told_apart():
    words = [str(bin(i).count("1") % 2).encode() for i in range(1 << 13)]  # prefix hashes modulo 2**64 take halves of it for equal
    assert [tuple(r) for r in periodic_runs.runs_of([words])[0].tolist()] == []
    doubled = words[:4096] * 4
    assert (0, 4 * 4096, 4096) in {tuple(r) for r in periodic_runs.runs_of([doubled])[0].tolist()}


def test_long_texts_of_few_words_are_searched_whole():
    once = [str(i).encode() for i in range(3000)]
    assert periodic_runs.runs_of([[b"w"] * 50_000, once * 5])[0].tolist() == [[0, 50_000, 1]]
    assert periodic_runs.runs_of([[b"a"] * 300 + [b"b"], [b"x"], once * 5])[2].tolist() == [[0, 15_000, 3000]]


def test_query_of_runs_equals_brute_force(spark):
    got = sorted(tuple(r) for r in queries.op11_periodic_runs(spark, SMALLEST).collect())
    assert got == sorted(row_by_brute_force(*d) for d in texts_of(spark).items())
    assert sum(r[1] for r in got) > 10


def test_runs_of_odd_rows(spark):
    docs = odd_docs(spark).withColumn("Runs", F.lit("mine"))
    rows = periodic_runs.periodic_runs(docs).collect()
    assert rows[0].asDict().keys() == {"doc_id", "lang", "source", "Runs_input", "runs", "collapsed"}
    assert len(rows) == 9
    by = {r.doc_id: r for r in rows}
    assert [tuple(r) for r in by[6].runs] == [(0, 60_000, 1)]
    assert by[6].collapsed == "long"
    assert (by[1].runs, by[1].collapsed, by[3].collapsed, len(by[7].collapsed)) == ([], "", "", 200_000)
    assert by[None].collapsed == "one two three four five six"
    assert periodic_runs.digests(periodic_runs.periodic_runs(spark.createDataFrame([], DOCS))).count() == 0
    same = [r.text for r in periodic_runs.with_repeats(odd_docs(spark)).where("doc_id is null or text is null").collect()]
    assert sorted(map(str, same)) == ["None", "one two three four five six"]


# Personal data

DISGUISED = [
    ("Mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
    ("jane at example dot co dot uk please", "email", "jane at example dot co dot uk"),
    ("j.doe at mail.example.com ok", "email", "j.doe at mail.example.com"),
    ("escribe a ana (arroba) correo (punto) es hoy", "email", "ana (arroba) correo (punto) es"),
    ("cyrillic jоhn.smith@exаmple.com end", "email", "jоhn.smith@exаmple.com"),
    ("wide ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ end", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("hidden jo​​hn@exam­ple.com end", "email", "jo​​hn@exam­ple.com"),
    ("coded john&#64;example&#46;com end", "email", "john&#64;example&#46;com"),
    ("marks john_AT_example_DOT_com end", "email", "john_AT_example_DOT_com"),
    ("john dot smith at example dot org", "email", "john dot smith at example dot org"),
    ("call +1 (4O8) 555-l212 today", "phone", "+1 (4O8) 555-l212"),
    ("wide +49 １７１ ２３４ ５６７８ end", "phone", "+49 １７１ ２３４ ５６７８"),
    ("dial plus one four one five five five five two six seven one thanks", "phone", "plus one four one five five five five two six seven one"),
    ("Nummer null acht fünf drei sieben zwei eins vier bitte", "phone", "null acht fünf drei sieben zwei eins vier"),
    ("card four zero four one eight nine four nine seven four six zero eight seven nine five end", "card", "four zero four one eight nine four nine seven four six zero eight seven nine five"),
    ("card ٤٠٤١٨٩٤٩٧٤٦٠٨٧٩٥ end", "card", "٤٠٤١٨٩٤٩٧٤٦٠٨٧٩٥"),
    ("server 192[.]168[.]1[.]10 down", "ip", "192[.]168[.]1[.]10"),
    ("server one nine two dot one six eight dot zero dot one down", "ip", "one nine two dot one six eight dot zero dot one"),
]
CLEAN = [
    "look at example.com or this dot com", "I have one two three four friends at home", "meet at noon. dot com", "zwei-drei. Am 12.10.2020 at 5.30 uhr", "x@y. z",
    "version 1.2.3 of 2020, one more, two less", "il y a un point à deux ou trois", "naïve café – schön · ça va", "a card 4041 8949 7460 8796 with a wrong digit", "999.1.2.3",
]


@pytest.mark.parametrize(("text", "kind", "want"), DISGUISED)
def test_disguised_identifiers_are_found_where_they_stand(text, kind, want):
    assert [(k, text[a:b], base) for k, a, b, base in pii.all_spans(text)] == [(kind, want, False)]


def test_clean_texts_stay_clean():
    assert [pii.all_spans(t) for t in CLEAN] == [[]] * len(CLEAN)


def plain_by_brute_force(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if max(map(int, m[0].split("."))) <= 255:
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


def test_plain_identifiers_equal_the_patterns():
    rng = random.Random(5)
    for alphabet in ("a.@-1", "1. ", "4 -", "+1 (.)-", "@.a+1 é"):
        for _ in range(1500):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
            assert pii.plain(text) == plain_by_brute_force(text), text


def test_query_of_personal_data_equals_the_patterns(spark):
    rows = queries.op12_pii(spark, SMALLEST).collect()
    texts = texts_of(spark)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        found = plain_by_brute_force(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(f[0] == k for f in found) for k in pii.KINDS]
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(told.split(",")) <= set(r.spans.split(","))
    assert sum(r.n_email for r in rows) and sum(r.n_phone for r in rows)


def test_personal_data_of_odd_rows(spark):
    docs = odd_docs(spark).union(spark.createDataFrame([(9, "a@b.cc and a (at) b.cc é 1.2.3.4", "en", "a"), (10, "1" * 300_000 + " at " * 50_000 + "@" * 1000, "en", "a")], DOCS))
    rows = pii.find(docs.withColumnRenamed("lang", "Spans"), redact=True).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 11
    assert rows[0].asDict().keys() == {"doc_id", "Spans_input", "source", "spans", "redacted"}
    assert [tuple(s) for s in by[9].spans] == [("email", 0, 6, True), ("email", 11, 22, False), ("ip", 25, 32, True)]
    assert by[9].redacted == "[EMAIL] and [EMAIL] é [IP]"
    assert (by[1].spans, by[1].redacted, by[10].spans, by[8].spans) == ([], "", [], [])
    assert pii.digests(pii.find(spark.createDataFrame([], DOCS))).count() == 0


def test_every_disguise_passes_the_hints(spark):
    rows = [(i, t) for i, (t, _, _) in enumerate(DISGUISED)] + [(100 + i, t) for i, t in enumerate(CLEAN)]
    got = {r.doc_id: [(s.kind, s.start, s.end, s.plain) for s in r.spans] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: pii.all_spans(t) for i, t in rows}


# Whitening


def whitened_by_numpy(vectors, components):
    longs = np.floor(64 * np.asarray(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(longs, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, basis = np.linalg.eigh(((n * fit - sums) / n).T @ ((n * fit - sums) / n) / n)
    values, basis = values[::-1], basis[:, ::-1]
    with np.errstate(all="ignore"):
        return n, ((n * longs - sums) ** 2).sum(axis=1), ((n * longs - sums) / n @ basis / np.sqrt(values))[:, :components], values / values.sum()


def rows_of(df, key="vec_id"):
    rows = sorted(df.collect(), key=lambda r: (r[key], r.component))
    k = max((r.component for r in rows), default=0)
    return rows, np.array([np.nan if r.whitened is None else r.whitened for r in rows]).reshape(-1, max(k, 1))


def test_query_of_whitening_equals_numpy(spark):
    rows, got = rows_of(queries.op13_embedding_whitening(spark, SMALLEST))
    table = sorted(queries.table(spark, SMALLEST, "embeddings").collect(), key=lambda r: r.vec_id)
    n, deviation, want, explained = whitened_by_numpy([r.embedding for r in table], 16)
    assert {r.n for r in rows} == {n}
    assert [r.deviation for r in rows] == np.repeat(deviation, 16).tolist()
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-9)
    assert (np.sign(got[0]) * np.sign(want[0]) * want == pytest.approx(got, abs=1e-9))
    assert [r.explained for r in rows[:16]] == pytest.approx(explained[:16].tolist(), rel=1e-9)
    assert rows[0].identity_error < 1e-9


def test_whitening_of_ill_conditioned_vectors(spark):
    rng = np.random.default_rng(2)
    wide = rng.normal(size=(400, 6)) * [3e9, 1e5, 40, 2, 1, 0.5] @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(wide.tolist())], "vec_id long, v array<double>")
    rows, got = rows_of(whitening.whiten(df, "v", components=4))
    _, _, want, _ = whitened_by_numpy(wide, 4)
    assert np.abs(np.cov(got.T, bias=True) - np.eye(4)).max() < 1e-6
    assert np.allclose(np.abs(got[:, :2]), np.abs(want[:, :2]), atol=1e-5)
    assert rows[0].identity_error < 1e-6


def test_whitening_drops_bad_vectors_and_counts_copies_once(spark):
    good = [[0.5 * i, float(i % 3), 1.0] for i in range(9)]
    nan, inf = float("nan"), float("inf")
    rows = [(i, v, "x") for i, v in enumerate(good + good[:2])] + [(20, None, "x"), (21, [1.0, None, 1.0], "x"), (22, [nan, 1.0, 1.0], "x"), (23, [1.0, -inf, 1.0], "x"), (24, [], "x"), (25, [1.0], None), (26, [1e300, 0.0, 0.0], "x"), (None, good[0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, N string")
    got = whitening.whiten(df, "v").collect()
    assert set(got[0].asDict()) == {"vec_id", "N_input", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    assert sorted({r.vec_id for r in got}, key=repr) == [*range(10), 10, None] or {r.vec_id for r in got} == {*range(11), None}
    assert {r.n for r in got} == {9}
    assert {r.component for r in got} == {1, 2, 3}
    assert all(r.whitened is None for r in got if r.component == 3)  # the third entry is always the same
    assert all(r.whitened is not None for r in got if r.component < 3)
    assert max(r.identity_error for r in got) < 1e-9
    assert sum(r.explained for r in got if r.vec_id == 3) == pytest.approx(1)


def test_whitening_with_fewer_vectors_than_dimensions_and_none(spark):
    rng = np.random.default_rng(4)
    few = rng.normal(size=(5, 12))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(few.tolist())], "vec_id long, v array<double>")
    rows, got = rows_of(whitening.whiten(df, "v"))
    assert np.isnan(got[:, 4:]).all() and np.abs(np.cov(got[:, :4].T, bias=True) - np.eye(4)).max() < 1e-8
    assert rows[0].identity_error < 1e-8
    one = whitening.whiten(df.where("vec_id = 0"), "v").collect()
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    assert whitening.whiten(df.where("vec_id < 0"), "v").collect() == []


def test_triangular_solves_undo_products():
    rng = np.random.default_rng(1)
    upper = np.triu(rng.normal(size=(20, 20))) + 5 * np.eye(20)
    rows = rng.normal(size=(50, 20))
    assert np.allclose(whitening.solved(rows @ upper, upper), rows)
