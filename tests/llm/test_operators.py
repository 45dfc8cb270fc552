"""The llm operators against brute force, round trips and odd input."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import Row
from pyspark.sql import functions as F

import public_tokenizers
from tessera.llm import bpe, chat_format, decontaminate, hilbert_shards, jaccard_join, packing, quality_rules, queries, site_quality, toxicity, url_rules
from tessera.llm.components import components
from tessera.llm.shared import Scratch

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string"


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(words)]


def edited(rng: random.Random, words: list[str], edits: int) -> list[str]:
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at : at + rng.choice([0, 1])] = rng.choice([[], [f"x{rng.randrange(999)}"]])
    return out or ["x"]


def odd_docs(spark):
    """Nulls in each column, empty, blank and very long texts, repeated rows."""
    rows = [
        (1, None, "en", "a"), (2, "", None, "a"), (3, " \t\n", "en", None), (None, "one two three four five six", "en", "a"),
        (5, "word", "en", "a"), (5, "word", "en", "a"), (6, "long " * 60_000, "de", "b"), (7, "x" * 200_000, "de", "b"), (8, "Ünïcode 文字 😀 text", "fr", "c"),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


# Components and the Jaccard join


def groups_by_brute_force(rows, size, percent):
    sets = []
    for _, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set())
    above = list(range(len(rows)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            common = len(x & sets[j])
            if common and 100 * common >= percent * len(x | sets[j]):
                a, b = top(i), top(j)
                above[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), doc), doc)
    return sorted((doc, len(s), least[top(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_jaccard_groups_equal_brute_force(spark, size, percent):
    rng = random.Random(size)
    rows = []
    for length in (3, 4, 6, 12, 40, 150):
        base = prose(rng, length, 5000)
        rows += [" ".join(edited(rng, base, rng.randrange(0, 1 + length // 12))) for _ in range(14)]
        rows += [" ".join(base[:-1] + prose(rng, 3)) for _ in range(4)] + [" ".join(base).upper()] * 2
    rows = [(i, t) for i, t in enumerate([*rows, "", None, "  ", "a", "A", "a b"])]
    rng.shuffle(rows)
    got = jaccard_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), size=size, percent=percent)
    assert sorted(map(tuple, got.collect())) == groups_by_brute_force(rows, size, percent)


def test_jaccard_groups_with_salted_signatures(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 5)
    rng = random.Random(21)
    base = prose(rng, 80, 5000)
    rows = [(i, " ".join(edited(rng, base, i % 4))) for i in range(60)] + [(100 + i, " ".join(prose(rng, 60, 5000))) for i in range(5)]
    got = jaccard_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == groups_by_brute_force(rows, 4, 85)


def test_signatures_never_miss_a_linked_pair():
    rng = np.random.default_rng(1)
    bands = jaccard_join.Bands(85)
    for size in [*range(6, 80), 200, 700]:
        common = rng.integers(1 << 62, size=size, dtype=np.uint64)
        for more in range(size):
            if 100 * size < 85 * (size + more):
                break
            own = rng.integers(1 << 62, size=more, dtype=np.uint64)
            cut = rng.integers(more + 1)
            x, y = np.unique(np.concatenate([common, own[:cut]])), np.unique(np.concatenate([common, own[cut:]]))
            if 100 * size >= 85 * (len(x) + len(y) - size) and more:
                assert np.intersect1d(jaccard_join.signatures(x, bands), jaccard_join.signatures(y, bands)).size, (size, more)


def test_jaccard_on_odd_rows_and_no_rows(spark):
    got = jaccard_join.near_groups(odd_docs(spark)).collect()
    assert len(got) == 9
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} >= {(1, 0, 1), (2, 0, 2), (3, 0, 3), (5, 1, 5), (6, 1, 6), (7, 1, 7), (None, 3, None)}
    assert jaccard_join.near_groups(spark.createDataFrame([], DOCS)).collect() == []


def test_jaccard_links_rows_without_ids(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(None, " ".join(words)), (4, " ".join(words[:-1])), (4, "something else of more than four words"), (None, "alone " * 9)]
    got = jaccard_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, got)) == sorted(
        map(repr, [Row(doc_id=None, n_shingles=97, component_id=4), Row(doc_id=4, n_shingles=96, component_id=4), Row(doc_id=4, n_shingles=4, component_id=4), Row(doc_id=None, n_shingles=1, component_id=None)])
    )


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (101, 100)], "a long, b long")
    got = {r.node: r.component for r in components(links, Scratch(spark), "c").collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


# Decontamination


def test_decontamination_finds_edited_passages_and_leaves_clean_texts(spark):
    rng = random.Random(3)
    items = [(i, " ".join(prose(rng, 12 + i % 30, 3000))) for i in range(40)]
    docs = []
    for i in range(200):
        item = rng.choice(items)
        words = item[1].split()
        passage = edited(rng, words, max(0, decontaminate.edits_of(len(words)) - 2)) if i % 2 else prose(rng, 30, 3000)
        docs.append((i, " ".join(prose(rng, 50, 3000) + [w.upper() + "." for w in passage] + prose(rng, 50, 3000)), item[0]))
    frame = spark.createDataFrame(docs, "doc_id long, text string, item long")
    got = {(r.doc_id, r.item_id) for r in decontaminate.hits(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, item) for d, _, item in docs if d % 2}
    assert got <= want
    assert len(got) >= 0.95 * len(want)


@pytest.mark.parametrize("place", ["alone", "start", "end"])
def test_decontamination_finds_all_edits_as_deletions(spark, place):
    rng = random.Random(14)
    items = [(i, " ".join(prose(rng, n, 5000))) for i, n in enumerate([8, 12, 15, 30, 45, 59] * 10)]
    docs = []
    for i, text in items:
        words = text.split()
        for at in sorted(rng.sample(range(len(words)), decontaminate.edits_of(len(words)) if i % 2 else 1), reverse=True):
            del words[at]
        more = [f"x{rng.randrange(5000)}" for _ in range(40)]
        docs.append((i, " ".join({"alone": words, "start": words + more, "end": more + words}[place]), "en", "s"))
    found = decontaminate.hits(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(i, i) for i, _ in items]


@pytest.mark.parametrize("n", [4, 8, 15, 30, 59, 100, 200, 300])
def test_walks_alone_reach_the_recall_at_all_edits_allowed(n):
    rng = np.random.default_rng(n)
    words = rng.integers(1 << 62, size=(60, n), dtype=np.uint64)
    walks = [decontaminate.Walks(n, i) for i in range(decontaminate.WALKS)]
    positions = decontaminate.sampling(words, walks)
    chosen = words[rng.integers(60, size=500)]
    other = np.array([decontaminate._edited(w, decontaminate.edits_of(n), rng) for w in chosen])
    keys = [decontaminate.window_keys([w.embed(x) for w in walks], positions) for x in (chosen, other)]
    assert np.any([a == b for a, b in zip(*keys, strict=True)], axis=0).mean() >= decontaminate.RECALL - 0.01


def test_short_items_are_found_exactly_and_tiny_ones_as_whole_texts(spark):
    items = spark.createDataFrame([(1, "red blue green pink gold"), (2, "Yes."), (3, "一二三四五六"), (4, ""), (5, "?!"), (None, "a b c d e f g h")], "item_id long, text string")
    docs = [
        (1, "so: Red, blue green pink gold!"), (2, "red blue green white gold and red blue green"), (3, "yes"), (4, "yes no"), (5, "一二三四五六。"),
        (6, "?!"), (7, ""), (8, None), (9, "a b c d e f g h"),
    ]
    got = decontaminate.hits(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert sorted((r.doc_id, r.item_id, r.edits) for r in got) == [(1, 1, 0), (3, 2, 0), (5, 3, 0)] or sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (3, 2)]


def test_hits_in_documents_equal_brute_force(spark):
    docs = [(r.doc_id, decontaminate._item_words(r.text)) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    bench = [(r.item_id, decontaminate._item_words(r.text)) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    want = {}
    for doc, words in docs:
        for item, wanted in bench:
            d = decontaminate.edits_of(len(wanted))
            if np.isin(wanted, words).sum() >= len(wanted) - d:
                edits = decontaminate.edit_distance_within(wanted, words)[0]
                if edits <= d:
                    want[doc, item] = edits
    got = queries.op2_benchmark_decontamination(spark, "/root/testdata/sf0.001").collect()
    assert want and {(r.doc_id, r.item_id): r.edits for r in got} == want


def test_passages_are_found_whatever_the_repetitions_reach(monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_REPETITIONS", 1)
    rng = random.Random(16)
    texts = [prose(rng, n, 5000) for n in [15, 45, 59] * 20]
    bench = decontaminate.Benchmark([(i, decontaminate._item_words(" ".join(t))) for i, t in enumerate(texts)])
    docs = [" ".join([*prose(rng, 50, 9), *edited(rng, t, decontaminate.edits_of(len(t))), *prose(rng, 50, 9)]) for t in texts]
    blocks = decontaminate.textblocks.blocks(pa.array(docs), lower=True, separator=decontaminate.APART)
    assert [[h[0] for h in hits] for _, block in blocks for hits in bench.search(block)] == [[i] for i in range(len(texts))]


def test_walks_find_whole_windows_and_the_bound_what_is_left(monkeypatch):
    """Edited passages inside texts come from the walks, cut ones at a text's end from the bound."""
    rng = random.Random(19)
    texts = [prose(rng, n, 5000) for n in [12, 30, 60] * 20]
    bench = decontaminate.Benchmark([(i, decontaminate._item_words(" ".join(t))) for i, t in enumerate(texts)])
    inside = [" ".join([*prose(rng, 80, 9), *edited(rng, t, decontaminate.edits_of(len(t)) // 2), *prose(rng, 80, 9)]) for t in texts]
    cut = [" ".join(t[: len(t) - decontaminate.edits_of(len(t))]) for t in texts]
    whole = {}
    by_bound = decontaminate.Benchmark._compare_bounded
    for name, docs in (("inside", inside), ("cut", cut)):
        for how in ("both", "walks"):
            monkeypatch.setattr(decontaminate.Benchmark, "_compare_bounded", by_bound if how == "both" else lambda *_: None)
            blocks = decontaminate.textblocks.blocks(pa.array(docs), lower=True, separator=decontaminate.APART)
            whole[name, how] = sum(any(h[0] == n for h in hits) for n, hits in enumerate(h for _, block in blocks for h in bench.search(block)))
    assert whole["inside", "both"] == whole["cut", "both"] == len(texts)
    assert whole["inside", "walks"] >= 0.95 * len(texts) and whole["cut", "walks"] == 0


def test_the_bound_compares_nothing_that_the_walks_had(monkeypatch):
    rng = random.Random(20)
    texts = [prose(rng, 40, 5000) for _ in range(30)]
    bench = decontaminate.Benchmark([(i, decontaminate._item_words(" ".join(t))) for i, t in enumerate(texts)])
    docs = [" ".join([*prose(rng, 200, 9), *t, *prose(rng, 200, 9)]) for t in texts]
    calls, compare, by_bound = [], decontaminate.Benchmark._compare, decontaminate.Benchmark._compare_bounded

    def bounded(self, *rest):
        with monkeypatch.context() as m:
            m.setattr(decontaminate.Benchmark, "_compare", staticmethod(lambda *a: calls.append(a[0]) or compare(*a)))
            by_bound(self, *rest)

    monkeypatch.setattr(decontaminate.Benchmark, "_compare_bounded", bounded)
    for _, block in decontaminate.textblocks.blocks(pa.array(docs), lower=True, separator=decontaminate.APART):
        assert [[h[:2] for h in hits] for hits in bench.search(block)] == [[(i, 0)] for i in range(len(texts))]
    assert not calls


def test_bounded_stretches_miss_nothing_of_repeated_words(monkeypatch):
    """Without any walk, items of few and repeated words: hits as by comparing whole texts."""
    rng = random.Random(15)
    monkeypatch.setattr(decontaminate.Benchmark, "_look", lambda *_: None)
    texts = [" ".join(prose(rng, rng.randrange(8, 26), rng.choice([2, 3, 40]))) for _ in range(60)]
    items = [(i, decontaminate._item_words(t)) for i, t in enumerate(texts)]
    docs = [" ".join([*prose(rng, rng.randrange(4), 40), *edited(rng, t.split(), decontaminate.edits_of(len(t.split()))), *prose(rng, rng.randrange(4), 40)]) for t in texts]
    bench = decontaminate.Benchmark(items)
    for _, block in decontaminate.textblocks.blocks(pa.array(docs), lower=True, separator=decontaminate.APART):
        words = block.word_hashes()
        for n, hits in enumerate(bench.search(block)):
            own = words[block.word_offsets[n] : block.word_offsets[n + 1]]
            want = {(i, e) for i, w in items if (e := decontaminate.edit_distance_within(w, own)[0]) <= decontaminate.edits_of(len(w))}
            assert {h[:2] for h in hits} == want


def test_edit_distance_equals_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(1, n))] for n in (8, 14))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
            row = now
        assert decontaminate.edit_distance_within(np.array(a), np.array(b))[0] == min(row)


def test_decontamination_in_several_passes_and_on_odd_rows(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, " ".join(prose(rng, 20, 9000))) for i in range(6)] + [(90, None), (91, "too short")]
    monkeypatch.setattr(decontaminate, "PASS_WORDS", 45)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, items[0][1] + " and " + items[5][1]), (2, None), (3, "")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.edits) for r in decontaminate.hits(docs, bench).collect()} == {(1, 0, 0), (1, 5, 0)}
    assert decontaminate.flag(odd_docs(spark), bench).where("size(hits) > 0").count() == 0
    assert decontaminate.clean(odd_docs(spark), bench.limit(0)).count() == 9


# URL rules


def test_url_rules_of_hosts_with_commas_and_odd_signs(spark):
    rules = [("com", "/en/", "block"), ("a,b.com", "/", "block"), ("a", "/x", "block"), ("com,evil", "/y", "block")]
    urls = {
        "http://com,evil/en/x": None, "http://com,a/en/": None, "http://x.com,evil/y": "com,evil/y", "http://com/en/x": "com/en/", "http://b.com/zz": None, "http://m.a,b.com/zz": "a,b.com/",
        "http://b.com,a/en/": None, "http://a,/x": None, "http://,a/x": None, "http://..a/x": "a/x", "http://com-x/en/": None, "http://com!/en/": None, "http://!.com/en/": "com/en/", "http://com\x00/en/": None,
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, "http://com/en/"), (None, None)], "page_id long, url string")
    got = url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert sorted((r.url or "", r.rule or "") for r in got) == sorted([(u, r or "") for u, r in urls.items()] + [("http://com/en/", "com/en/"), ("", "")])


def test_many_rules_of_one_host_and_very_long_urls(spark):
    rules = [("big.com", "/" + "d/" * (i % 7) + str(i), "block") for i in range(10_000)] + [("com", "/", "allow")]
    urls = ["http://m.big.com/" + "d/" * (i % 7) + str(i) + "x" * (i % 3) for i in range(0, 10_000, 11)] + ["http://big.com/" + "y" * 300_000, "http://" + "z." * 50_000 + "com/q"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.rule for r in url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    known = {h + p for h, p, _ in rules}
    for i, url in enumerate(urls[:-2]):
        path = url.removeprefix("http://m.big.com")
        want = max((path[:n] for n in range(len(path) + 1) if "big.com" + path[:n] in known), key=len)
        assert got[i] == "big.com" + want
    assert (got[len(urls) - 2], got[len(urls) - 1]) == ("com/", "com/")


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(5)
    hosts = ["com", "a.com", "b.a.com", "xa.com", "net", "a.net", ""]
    paths = ["/", "/en/", "/en/7", "/de", ""]
    rules = [(h, p, rng.choice(["allow", "block"])) for h in hosts[:6] for p in paths if rng.random() < 0.5]
    urls = [None, "", "no scheme", "x://", "HTTP://A.COM/EN/", "http://a.com?q=/en/", "https://B.a.com/en/7#x"]
    urls += [f"https://{rng.choice(['', 'm.', 'M.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'x', '?a', '#b'])}" for _ in range(400)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls + urls[-1:] * 50)], "page_id long, url string")

    def verdict(url):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[2:] if fit else (None, "allow")))

    got = url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert sorted((r.page_id, r.url or "", r.host, r.path, r.rule or "-", r.verdict) for r in got) == sorted(
        (i, u or "", *verdict(u)[:2], verdict(u)[2] or "-", verdict(u)[3]) for i, u in enumerate(urls + urls[-1:] * 50)
    )
    named = spark.createDataFrame(rules, "host string, path string, verdict string")
    more = url_rules.judge(pages.withColumns({"host": F.lit(1), "KEY": F.lit(2)}), named)
    assert more.columns == ["page_id", "url", "host_input", "KEY_input", "host", "path", "rule", "verdict"] and more.select("host_input", "KEY_input").distinct().collect() == [(1, 2)]
    assert url_rules.judge(pages.limit(0), named).collect() == []
    assert {r.verdict for r in url_rules.judge(pages.withColumn("page_id", F.lit(None).cast("long")), named.limit(0)).collect()} == {"allow"}


# Quality rules and site quality


def base_by_brute_force(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(5)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


def test_rule_statistics_equal_brute_force():
    rng = random.Random(6)
    texts = [None, "", " ", "\n\n", "é\né\né\n", "a b c d e a b c d e", "x x x x x x x"]
    texts += ["".join(rng.choice("ab \n#é") for _ in range(rng.randrange(60))) for _ in range(1500)]
    stats = quality_rules.text_stats(pa.array(texts))
    assert [[int(stats[k][i]) for k in quality_rules.BASE] for i in range(len(texts))] == [base_by_brute_force(t) for t in texts]


def labelled(spark, n=300):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randrange(20, 120))
        bad = i % 7 == 0
        docs.append((i, " ".join(w + "###" * bad for w in words), "en", f"s{i % 3}"))
        labels.append((i, int(not bad), 0))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def path_by_hand(tree, sample, row):
    """Splits down to the row's leaf, and the usual path among the sample's rows there."""
    at, depth, here = 0, 0, sample
    while tree[at, 0] >= 0:
        feature, cut = int(tree[at, 0]), tree[at, 1]
        left = row[feature] < cut
        here = here[(here[:, feature] < cut) == left]
        at, depth = int(tree[at, 2 if left else 3]), depth + 1
    n = len(here)
    return depth + (2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else n - 1)


def test_forest_scores_equal_paths_by_hand():
    rng = np.random.default_rng(3)
    sample = np.column_stack([rng.random(120), rng.integers(0, 3, 120), np.zeros(120)])
    forest = quality_rules.IsolationForest(sample, trees=20, tree_rows=120)
    rows = np.concatenate([sample[:30], rng.random((30, 3)) * 4 - 1])
    usual = 2 * (np.log(119) + 0.5772156649) - 2 * 119 / 120
    by_hand = [2 ** (-np.mean([path_by_hand(t, sample, r) for t in forest.trees]) / usual) for r in rows]
    assert np.allclose(forest.score(rows), by_hand)
    assert forest.score(np.array([[9.0, 9.0, 0.0]]))[0] > forest.score(sample).mean()


def test_thresholds_keep_good_rows_and_useless_forests_reject_nothing():
    good, bad = np.linspace(0.3, 0.5, 2000), np.linspace(0.6, 0.8, 50)
    assert 0.5 <= quality_rules.calibrated(good, bad) < 0.6
    assert quality_rules.calibrated(good, np.linspace(0.3, 0.5, 50)) is None
    assert quality_rules.calibrated(good, bad[:0]) == 0.5


def test_quality_verdicts_equal_the_model_row_by_row(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = queries.op4_quality_rules(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        base = base_by_brute_force(texts[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == base
        assert r.base_failed == (base[0] < 10 or 100 * base[4] > 20 * base[0])
        rates = quality_rules.features(quality_rules.text_stats(pa.array([texts[r.doc_id]])))[0]
        odd = []
        for rule in model.rules:
            usual = float(quality_rules._usual_path(rule.forest.rows))
            paths = []
            for tree in rule.forest.trees:
                at = 0
                while tree[at, 0] >= 0:
                    at = int(tree[at, 2 if rates[rule.columns[int(tree[at, 0])]] < tree[at, 1] else 3])
                paths.append(tree[at, 4])
            odd.append(2 ** (-np.mean(paths) / usual) > rule.threshold)
        assert r.kept == (not r.base_failed and not any(odd))


def test_quality_rules_and_site_quality_tell_junk_from_prose(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in quality_rules.judge(docs, labels.where("doc_id < 200")).collect()}
    assert all(got[i].kept == bool(i % 7) for i in range(200, 300))
    sites = {r.doc_id: r.kept for r in site_quality.judge(docs, labels.where("doc_id < 200")).collect()}
    assert all(sites[i] == bool(i % 7) for i in range(200, 300))


def test_quality_on_odd_rows_without_labels(spark):
    got = quality_rules.judge(odd_docs(spark), empty_labels(spark)).collect()
    assert len(got) == 9
    assert {r.doc_id: r.kept for r in got}[1] is False
    assert site_quality.judge(odd_docs(spark), empty_labels(spark)).count() == 9
    assert quality_rules.judge(spark.createDataFrame([], DOCS), empty_labels(spark)).count() == 0


def test_site_rates_draw_sparse_sites_to_the_level_above(spark):
    docs = spark.createDataFrame([(i, "t", "p", "big") for i in range(100)] + [(200, "t", "p", "tiny")], DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(100)] + [(200, 0, 0)], "doc_id long, quality int, toxic int")
    hosts, paths, shares = site_quality.site_rates(docs, labels, "source", "lang", "doc_id")
    rates = {(r.fold, r.host): r.host_rate for r in hosts.collect()}
    own = zlib.crc32(b"200") % site_quality.FOLDS
    for fold in range(site_quality.FOLDS):
        assert abs(rates[fold, "big"] - 0.75) < 0.05
        if fold == own:  # the row's own label doesn't count
            assert (fold, "tiny") not in rates
        else:
            assert 0.2 < rates[fold, "tiny"] < shares[fold]
    assert paths.count() == 2 * site_quality.FOLDS - 1


def test_site_quality_equals_brute_force(spark):
    import pandas as pd

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    sites = docs.select("doc_id", "source", "lang").toPandas().merge(labels.select("doc_id", "quality").toPandas().dropna(), on="doc_id")

    def drawn(rates, prior):
        chance = (prior * (1 - prior)).sum()
        seen = (rates.n * (rates.good / rates.n - prior) ** 2).sum()
        between = max((seen - chance) / rates.n.sum(), 1e-6)
        strength = min(max(chance / rates.n.sum() / between, site_quality.STRENGTH[0]), site_quality.STRENGTH[1])
        return (rates.good + strength * prior) / (rates.n + strength)

    fold_of = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % site_quality.FOLDS for r in docs.collect()}
    known = {}
    for fold in range(site_quality.FOLDS):
        some = sites[[fold_of[d] != fold for d in sites.doc_id]]
        share = (some.quality.sum() + 1) / (len(some) + 2)
        hosts = some.groupby("source").quality.agg(good="sum", n="count")
        hosts["rate"] = drawn(hosts, pd.Series(share, hosts.index))
        paths = some.groupby(["source", "lang"]).quality.agg(good="sum", n="count").reset_index()
        paths["rate"] = drawn(paths, paths.source.map(hosts.rate))
        known[fold] = share, hosts.rate, {(s, lang): rate for s, lang, rate in paths[["source", "lang", "rate"]].itertuples(index=False)}
    place = {r.doc_id: (r.source, r.lang) for r in docs.collect()}

    def odds(p):
        return np.log(p / (1 - p))

    got = queries.op6_quality_classifier(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in got) == sorted(place)
    for r in got:
        share, hosts, by_path = known[fold_of[r.doc_id]]
        host = hosts.get(place[r.doc_id][0], share)
        path = by_path.get(place[r.doc_id], host)
        assert np.allclose([r.host_rate, r.path_rate], [host, path])
        z = odds(min(max(r.doc_score, 1e-12), 1 - 1e-12)) + odds(path) - odds(share)
        assert np.isclose(r.quality_score, 1 / (1 + np.exp(-z))) and r.kept == (r.quality_score >= 0.5)


# Packing


@pytest.mark.parametrize("capacity", [1, 7, 64, 100])
def test_best_fit_decreasing_chooses_the_fullest_row(capacity):
    rng = random.Random(capacity)
    sizes = [rng.randint(1, capacity) for _ in range(300)]
    rows, room = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        able = [r for r in range(len(rows)) if room[r] >= sizes[i]]
        if able:
            least = min(room[r] for r in able)
            row = max((r for r in able if room[r] == least), key=lambda r: rows[r][-1][0])
        else:
            rows.append([])
            room.append(capacity)
            row = len(rows) - 1
        rows[row].append((len([x for r in rows for x in r]), i))
        room[row] -= sizes[i]
    got = packing.best_fit_decreasing(sizes, capacity)
    assert sorted(i for r in got for i in r) == list(range(300))
    assert sorted(sum(sizes[i] for i in r) for r in got) == sorted(capacity - r for r in room)


def test_packed_rows_give_the_texts_back(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(prose(rng, rng.randrange(400)))) for i in range(60)] + [(100, None), (101, "")]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), RANKS, public_tokenizers.PATTERN, length=256).collect()
    parts = {}
    for r in rows:
        assert len(r.ids) == len(r.positions) == 256 and r.cu_seqlens[-1] == r.n_tokens
        for s, a, b in zip(r.segments, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            parts[s.doc_id, s.part] = r.ids[a:b]
            assert r.positions[a:b] == list(range(b - a))
        assert set(r.ids[r.n_tokens :]) <= {packing.PADDING}
    encoding = packing._encoding(RANKS, public_tokenizers.PATTERN)
    for doc, text in docs:
        assert sum([parts[k] for k in sorted(k for k in parts if k[0] == doc)], []) == encoding.encode_ordinary(text or "")


# Sharding


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_hilbert_neighbours_touch(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    order = hilbert_shards.hilbert_index(grid, bits)
    assert sorted(order) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(order)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("n", [0, 3, 8, 100])
def test_shards_are_even_and_slots_gapless(spark, n):
    rows = [(i, "same" if i % 3 else None, None if i % 5 else "fr", "s") for i in range(n)]
    got = hilbert_shards.shard(spark.createDataFrame(rows, DOCS), ["lang", "source"], ["text", "doc_id"]).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == n and (not n or max(sizes.values()) - min(sizes[s] for s in range(8)) <= 1)
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def test_shards_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    got = {r.doc_id: r for r in queries.op7_sharding(spark, "/root/testdata/sf0.001").collect()}
    assert sorted(got) == sorted(r.doc_id for r in rows)
    cuts, values = [], {"lang": [r.lang for r in rows], "source": [r.source for r in rows], "size": [len((r.text or "").encode()) + 1 for r in rows]}
    for name in values:
        known = sorted(v for v in values[name] if v is not None)
        cuts.append(sorted({known[len(known) * i // 64] for i in range(1, 64)}))
    cells = np.array([[0 if v is None else sum(c <= v for c in cuts[d]) for v in values[n]] for d, n in enumerate(values)]).T
    curve = {r.doc_id: int(c) for r, c in zip(rows, hilbert_shards.hilbert_index(cells, hilbert_shards.BITS), strict=True)}
    first = {}
    for r in rows:
        first[r.text] = min(first.get(r.text, 1 << 62), curve[r.doc_id])
    counts = Counter(g.shard for g in got.values())
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(8))
    order = sorted(rows, key=lambda r: (got[r.doc_id].shard, got[r.doc_id].slot))
    assert [first[r.text] for r in order] == sorted(first[r.text] for r in rows)
    for r in rows:
        data = (r.text or "").encode()
        assert (got[r.doc_id].size, got[r.doc_id].text_crc32, got[r.doc_id].law, got[r.doc_id].grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    for s in range(8):
        assert sorted(g.slot for g in got.values() if g.shard == s) == list(range(counts[s]))
    places = {}
    for i, r in enumerate(order):
        places.setdefault(r.text, []).append(i)
    assert all(max(p) - min(p) == len(p) - 1 for p in places.values())  # equal texts are neighbours


def test_curve_ranges_come_from_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(hilbert_shards, "SAMPLE_ROWS", 50)
    same = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"))
    sample = hilbert_shards.bounded_sample(same, F.struct("lang", "doc_id"), 50)
    assert sample.count() < 150
    assert hilbert_shards.shard(same, ["lang"], ["doc_id"]).groupBy("shard").count().where("count <> 250").count() == 0


def test_curve_ranges_are_those_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(hilbert_shards, "SAMPLE_ROWS", 50)
    rows = [(i, None if i % 7 == 0 else float("nan") if i % 7 == 1 else float(i * i % 1009)) for i in range(1500)]
    got = hilbert_shards.with_curve(spark.createDataFrame(rows, "id int, v double").repartition(4), ["v"], 4).collect()
    known = sorted(v for _, v in rows if v is not None and v == v)
    cuts = sorted({known[len(known) * i // 16] for i in range(1, 16)})
    cells = np.array([[0 if r.v is None or r.v != r.v else sum(c <= r.v for c in cuts)] for r in got])
    assert [r.curve for r in got] == hilbert_shards.hilbert_index(cells, 4).tolist()


def test_thresholds_come_from_all_labelled_rows(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "SAMPLE_ROWS", 100, raising=False)
    monkeypatch.setattr(quality_rules, "TREES", 3)
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) + str(rng.randint(0, 99999)) for _ in range(rng.randint(12, 60))) + " #$%" * (25 if i % 10 == 0 else 0) + "!" * (i % 13), "en", "s") for i in range(1500)]
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(1500)], "doc_id long, quality int, toxic int")
    model = quality_rules.fit(spark.createDataFrame(docs, DOCS).repartition(3), labels)
    stats = quality_rules.text_stats(pa.array([d[1] for d in docs]))
    able, good = ~quality_rules.base_failed(stats), np.array([i % 10 != 0 for i in range(1500)])
    rates = quality_rules.features(stats)
    assert model.rules
    for rule in model.rules:
        scores = rule.forest.score(rates[:, rule.columns])
        assert rule.threshold == quality_rules.calibrated(scores[able & good], scores[able & ~good])


def test_written_shards_and_matrices_read_back(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s") for i in range(40)], DOCS)
    placed = hilbert_shards.shard(docs, ["lang"], ["text", "doc_id"])
    hilbert_shards.write_shards(placed, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).groupBy("shard").count().where("count = 5").count() == 8
    packed = packing.pack(docs, RANKS, public_tokenizers.PATTERN, length=16)
    packing.write_matrix(packed, str(tmp_path / "matrix"))
    want = sorted(tuple(r.ids) for r in packed.collect())
    assert sorted(tuple(np.frombuffer(bytes(r.matrix_row), "<i4").tolist()) for r in spark.read.parquet(str(tmp_path / "matrix")).collect()) == want


# Toxicity


def test_toxicity_learns_words_and_stems_from_labels(spark):
    rng = random.Random(10)
    docs, labels = [], []
    for i in range(800):
        words, toxic = prose(rng, 60, 3000), i % 8 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(60), rng.choice(["blorp", "grundel" + rng.choice("abcdefgh") * 3]))
        docs.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic)))
    got = toxicity.judge(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).where("held_out").collect()
    assert len(got) > 100
    assert sum(r.predicted == int(r.doc_id % 8 == 0) for r in got) >= 0.98 * len(got)


def test_toxicity_learns_rare_short_and_productive_words(spark):
    """A small group's insults in under 2 % of toxic rows, of 3 letters, and with stems beyond 5 letters."""
    rng = random.Random(12)

    def out(i):
        return zlib.crc32(str(i).encode()) % 4 == 2

    docs, labels, groups = [], [], {}

    def add(i, words, toxic, group):
        docs.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, toxic))
        if out(i):
            groups.setdefault(group, []).append(i)

    for i in range(1600):
        words = [*prose(rng, 60, 3000), "qualm" + "".join(rng.choices("abcde", k=4))]
        if i % 4 == 0:
            words[rng.randrange(60)] = "blorp"
        add(i, words, int(i % 4 == 0), "blorp" if i % 4 == 0 else "clean")
    ids = iter(range(5000, 6000))
    for group, known in (("rare", 5), ("short", 18), ("productive", 18)):
        left = {False: known, True: 5}
        while any(left.values()):
            if left[out(i := next(ids))]:
                left[out(i)] -= 1
                insult = {"rare": "grundelwort", "short": "zog", "productive": "qualmort" + "".join(rng.choices("abcdefgh", k=6))}[group]
                words = prose(rng, 60, 3000)
                words[3:3] = ["qualm" + "".join(rng.choices("abcde", k=4)), insult, "w", insult]
                add(i, words, 1, group)
    made = toxicity.judge(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    said = {r.doc_id: r.predicted for r in made.where("held_out").collect()}
    share = {g: sum(said[i] for i in own) / len(own) for g, own in groups.items()}
    assert share.pop("clean") <= 0.02
    assert min(share.values()) == 1, share


def test_patterns_of_clauses():
    grammar = toxicity.Grammar(toxicity.Lexicon({"fool": 3.0}, {}), toxicity.USUAL)

    def pattern(text):
        return {p for p, v in zip(toxicity.PATTERNS, grammar.evidence(text), strict=True) if v}

    assert pattern("what a fool") == {"plain"}
    assert pattern("you utter fool") == {"targeted"}
    assert pattern("a fool, you") == {"plain", "targeted"}
    assert pattern("she said a fool, you") == {"reported"}
    assert pattern("he is not a fool") == {"negated"}
    assert pattern("she said that the man was a fool") == {"reported"}
    assert pattern("not now. a fool") == {"plain"}
    assert pattern("they will kill you") == {"threat"}
    assert pattern("kill the lights") == set()
    assert pattern("he said you must not hurt them") == {"negated"}
    assert pattern("she said that they will kill you") == {"reported"}
    assert pattern("do not kill the lights") == set()
    assert pattern("foolish talk") == pattern("") == pattern(None) == set()


def clause_by_brute_force(symbols):
    """Patterns of a clause's symbols (with weights), by looking at the words around each."""
    out = dict.fromkeys(toxicity.PATTERNS, 0.0)

    def before(i, kinds, reach):
        return [j for j in range(max(0, i - reach), i) if symbols[j][0] in kinds]

    for i, (kind, weight) in enumerate(symbols):
        negated, reported = before(i, {"neg"}, 3), before(i, {"report"}, i)
        aimed = kind == "threat" and before(i, {"target"}, i)
        if kind == "insult" or aimed:
            name = "negated" if negated else "reported" if reported else "threat" if aimed else "targeted" if before(i, {"target"}, 3) else "plain"
            out[name] += weight
        if kind == "target" and (insults := before(i, {"insult"}, 3)) and not any(j > insults[-1] for j in before(i, {"target"}, 3)) and not (negated or reported):
            out["targeted"] += weight
    return out


def test_composed_transducers_equal_brute_force():
    lexicon = toxicity.Lexicon({"fool": 3.0, "oaf": 2.5}, {"grun": 1.5})
    grammar = toxicity.Grammar(lexicon, toxicity.USUAL)
    rng = random.Random(17)
    words = {"fool": ("insult", 3.0), "oaf": ("insult", 2.5), "grundel": ("insult", 1.5), "you": ("target", 1.0), "not": ("neg", 1.0), "said": ("report", 1.0), "kill": ("threat", 1.0), "tree": ("word", 1.0), "grun": ("word", 1.0)}
    for _ in range(3000):
        clauses = [[rng.choice(list(words)) for _ in range(rng.randrange(10))] for _ in range(rng.randrange(1, 4))]
        total = np.zeros(len(toxicity.PATTERNS))
        for clause in clauses:
            total += list(clause_by_brute_force([words[w] for w in clause]).values())
        text = ". ".join(" ".join(c) for c in clauses)
        assert np.allclose(grammar.evidence(text), np.log1p(total)), text
        z = toxicity.USUAL[0] + np.log1p(total) @ toxicity.USUAL[1:]
        assert np.isclose(grammar.score(grammar.evidence(text)), 1 / (1 + np.exp(-z)))


def test_toxicity_finds_most_held_out_rows(spark):
    got = queries.op8_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").select("predicted", "toxic").dropna().collect()
    found = sum(r.predicted for r in got if r.toxic == 1) / sum(r.toxic == 1 for r in got)
    false = sum(r.predicted for r in got if r.toxic == 0) / sum(r.toxic == 0 for r in got)
    assert found >= 0.9 and false <= 0.02


def test_toxicity_on_odd_rows_without_labels(spark):
    got = toxicity.judge(odd_docs(spark), empty_labels(spark)).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)


# Byte-level BPE


def test_bpe_equals_tiktoken_and_decodes():
    own = bpe.ByteBPE(RANKS, public_tokenizers.PATTERN)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(11)
    letters = "ab ’é  \n\t\x1c\x85\xa0　'sdrev1²½٣%$中文😀"
    texts = ["", " ", "a" * 3000, "ab" * 2000, "<|endoftext|>"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(3000)]
    for text, parts in zip(texts, own.parts(texts), strict=True):
        ids = [int(i) for p in parts for i in p.ids.split(",")]
        assert ids == encoding.encode_ordinary(text) == own.encode_ids(text)
        assert b"".join(p.data for p in parts) == text.encode()


def test_bpe_merges_a_piece_once_while_it_is_remembered(monkeypatch):
    """Other signs around a word don't make it another piece, and a full memory keeps what is met again."""
    own, merged = bpe.ByteBPE(RANKS, public_tokenizers.PATTERN), []
    monkeypatch.setattr(own, "merge", lambda pieces, merge=own.merge: merged.extend(pieces) or merge(pieces))
    monkeypatch.setattr(bpe, "REMEMBER", 4)
    for once, sign in zip("vwxyz", ",.!?)", strict=True):
        text = f"so erthanou{sign} ederwhat{sign} thing{once}qq"
        assert b"".join(p.data for parts in own.parts([text]) for p in parts) == text.encode()
    assert merged.count(b" erthanou") == merged.count(b" ederwhat") == 1
    held = own.known | own.earlier
    assert " erthanou" in held and " thingzqq" in held and " thingvqq" not in held and len(held) < 20


def test_bpe_decodes_more_ids_than_are_gathered_at_once(monkeypatch):
    monkeypatch.setattr(bpe, "DECODE_IDS", 7)
    own = bpe.ByteBPE(RANKS, public_tokenizers.PATTERN)
    texts = ["", "x", "Ünïcode 中文 😀 " * 50, "ab " * 7]
    assert [b"".join(p.data for p in parts).decode() for parts in own.parts(texts)] == texts


def test_bpe_digests_on_odd_rows(spark):
    got = bpe.encode_digests(odd_docs(spark), RANKS, public_tokenizers.PATTERN).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert len(got) == 9
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got}[1] == (0, nothing, nothing)
    assert bpe.encode_digests(odd_docs(spark).limit(0), RANKS, public_tokenizers.PATTERN).collect() == []
    with pytest.raises(ValueError, match="pattern"):
        bpe.ByteBPE(RANKS, r"\S+ \S+|\S+|\s+")


def test_columns_with_an_operators_names_come_back_beside_its_own(spark):
    names = ["n_words", "kept", "held_out", "Score", "predicted", "hits", "doc_score", "h1", "host_rate", "curve", "shard", "slot", "rank", "n_tokens", "ids", "key", "bits", "id", "hash", "component_id"]
    docs = odd_docs(spark).withColumns({n: F.lit(f"own {n}") for n in names})
    none = empty_labels(spark)
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    made = {
        "quality": quality_rules.judge(docs, none), "toxicity": toxicity.judge(docs, none), "hits": decontaminate.flag(docs, bench), "site": site_quality.judge(docs, none),
        "shards": hilbert_shards.shard(docs, ["lang", "slot"], ["text", "doc_id", "rank"], together="text"), "bpe": bpe.encode_digests(docs, RANKS, public_tokenizers.PATTERN), "ids": bpe.tokenize(docs, RANKS, public_tokenizers.PATTERN),
    }
    added = {"quality": ["n_words", "kept"], "toxicity": ["held_out", "Score", "predicted"], "hits": ["hits"], "site": ["kept", "doc_score", "h1", "host_rate"], "shards": ["curve", "shard", "slot", "rank", "h1"], "bpe": ["n_tokens"], "ids": ["ids"]}
    for what, got in made.items():
        rows = got.collect()
        assert len(rows) == 9, what
        for n in names:
            assert {r[f"{n}_input" if n in added[what] else n] for r in rows} == {f"own {n}"}, (what, n)
    assert decontaminate.clean(docs, bench).columns == docs.columns
    assert jaccard_join.near_groups(docs).count() == 9
    assert packing.pack(docs, RANKS, public_tokenizers.PATTERN).count() > 0


def test_operators_on_empty_tables(spark):
    none, rows = empty_labels(spark), spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    for got in (
        quality_rules.judge(rows, none), toxicity.judge(rows, none), decontaminate.flag(rows, bench), decontaminate.hits(odd_docs(spark), bench.limit(0)), site_quality.judge(rows, none), hilbert_shards.shard(rows, ["lang"], ["text", "doc_id"], together="text"),
        packing.pack(rows, RANKS, public_tokenizers.PATTERN), jaccard_join.near_groups(rows), chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
    ):
        assert got.collect() == []


# Chat formatting


def test_chats_read_back(spark):
    said = ["</s>[INST] ok [/INST]", "[NEXT]", "~t~l<~[", "", None, "é😀 文", "a\nb"]
    rng = random.Random(12)
    turns = [Row(conv_id=c, turn=t, role=rng.choice(["user", "assistant", "a[b", None]), text=rng.choice(said), more=1) for c in range(40) for t in range(rng.randrange(1, 9))]
    formatted = chat_format.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, more int"))
    read = formatted.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    for r in read.collect():
        own = sorted((t for t in turns if t.conv_id == r.conv_id), key=lambda t: t.turn)
        assert [tuple(t) for t in r.turns] == [(t.role or "", t.text or "") for t in own]
        assert r.loss == "".join(t.text or "" for t in own if t.role == "assistant")
        blocks = 1 + sum((a.role or "") != (b.role or "") for a, b in zip(own, own[1:], strict=False))
        assert r.formatted.count(chat_format.HEAD) == r.formatted.count(chat_format.TAIL) == blocks


def test_chats_of_no_rows_and_null_ids(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert chat_format.digests(chat_format.format_chats(spark.createDataFrame([], kind))).count() == 0
    got = chat_format.digests(chat_format.format_chats(spark.createDataFrame([(None, None, None, None), (None, None, None, None)], kind))).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in got] == [(None, 1, 0), (None, 1, 0)]


def test_chats_with_repeated_turns_and_long_texts(spark):
    long = "[é~" * 70_000
    turns = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", long), (None, 5, "assistant", "b"), (None, 5, "assistant", "b")]
    got = chat_format.digests(chat_format.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()
    assert sorted((r.conv_id or 0, r.n_turns, r.loss_chars) for r in got) == [(0, 1, 1), (0, 1, 1), (1, 3, len(long))]
    assert {r.loss_sha256 for r in got if r.conv_id == 1} == {hashlib.sha256(long.encode()).hexdigest()}
