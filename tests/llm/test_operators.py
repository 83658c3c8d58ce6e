"""The training-text operators against brute force, on the smallest tables and on rows that are hard to handle."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from contactlake.llm import ctw, mixing, queries
from contactlake.llm.decontaminate import contamination
from contactlake.llm.graph import connected_components
from contactlake.llm.licenses import scan_licenses
from contactlake.llm.minhash import MinHash, near_duplicates
from contactlake.llm.mixing import Mixing, fitted_rates, mix_sources, mixed
from contactlake.llm.phrases import remove_repeated_phrases
from contactlake.llm.quality import QualityRules, quality_verdicts
from contactlake.llm.sharding import Node, assign_shards, grown_tree, hash_tree
from contactlake.llm.suffixes import remove_repeated_bytes, suffix_array
from contactlake.llm.url_filters import judge_urls

from . import brute

SF = "/root/testdata/sf0.001"


def table(name):
    return duckdb.sql(f"select * from '{SF}/{name}.parquet'")


@pytest.fixture(scope="module")
def small():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()


r = random.Random(5)
WORDS = ["ab", "Cd", "é", "the", "of", "x1", "zz", "long" * 5]
LONG = " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(30_000))
BASE = " ".join(r.choice(WORDS) + str(r.randrange(900)) for _ in range(60))
ODD = [
    (1, BASE),
    (2, BASE.replace("the", "THE")),
    (3, None),
    (4, ""),
    (5, " \t\n\x0b\x0c\r "),
    (6, LONG),
    (7, LONG[:90_000] + " tail"),
    (8, BASE + " and more at the end"),
    (9, "\n".join(["same line here"] * 9)),
    (10, "one"),
    (11, "ONE"),
    (12, "a\u00a0b \u2028 c \x1c d \x00 e"),
    (13, "ab " * 400),
    (14, BASE),
    (15, BASE[:150] + " filler " * 3 + BASE[150:]),
]


def docs(spark, rows):
    """With other columns whose names the operators use inside."""
    out = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    for c in ("id", "n", "key", "words", "uid", "h", "size", "b", "rid", "chunk", "component", "rate", "start", "path"):
        out = out.withColumn(c, F.lit("extra"))
    return out


def by_id(df):
    return {x[0]: tuple(x)[1:] for x in df.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


# graph


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    g = random.Random(seed)
    edges = [(g.randrange(60), g.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


# near-duplicates


def test_near_duplicates_table(spark, small):
    want = brute.near(small, 2)
    got = by_id(queries.QUERIES["op3_minhash"](spark, SF))
    assert got == {i: (len(brute.shingles(t, 2)), want[i], want[i] == i) for i, t in small}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_odd(spark, odd, k):
    want = brute.near(ODD, k)
    got = by_id(near_duplicates(odd, MinHash(shingle=k)))
    assert got == {i: (len(brute.shingles(t, k)), want[i], want[i] == i) for i, t in ODD}


def test_near_duplicates_chain_and_blocks(spark):
    """Neighbours in a chain are similar, its ends are not; blocks of two members and texts force every blocked path."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 60])) for i in range(40)] + [(100 + i, " ".join(words[:60]) + f" z{i}") for i in range(12)]
    want = brute.near(rows, 2)
    for p in (MinHash(shingle=2), MinHash(shingle=2, block=2, confirm=3)):
        got = by_id(near_duplicates(docs(spark, rows), p))
        assert {i: x[1] for i, x in got.items()} == want


def test_near_duplicates_repeated_and_null_ids(spark):
    rows = [(1, "a b c d"), (1, "e f g h"), (2, "a b c d"), (3, "e f g h"), (3, "e f g h"), (None, "a b c d"), (None, None)]
    got = sorted((tuple(x) for x in near_duplicates(docs(spark, rows), MinHash(shingle=2)).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (3, 3, 1, False), (None, 3, None, True), (None, 0, None, True)], key=str)


def test_near_duplicates_patterned_ids_and_one_large_class(spark):
    """Ids that are multiples of 1000 and a class of many copies: small blocks force the blocked paths."""
    words = [f"w{i}" for i in range(400)]
    rows = [(1000 * i, " ".join(words[i * 4 : i * 4 + 60])) for i in range(40)] + [(1000 * (100 + i), " ".join(words[:60]) + f" z{i}") for i in range(12)] + [(1000 * (200 + i), "one text of many copies " * 3) for i in range(150)]
    want = brute.near(rows, 2)
    for p in (MinHash(shingle=2), MinHash(shingle=2, block=4, confirm=5, confirm_bytes=2000, salts=8)):
        assert {i: x[1] for i, x in by_id(near_duplicates(docs(spark, rows), p)).items()} == want


# quality


def test_quality_table(spark, small):
    got = by_id(queries.QUERIES["op4_quality"](spark, SF))
    assert got == {i: (*brute.quality(t), brute.kept_by_rules(t)) for i, t in small}


def test_quality_odd_and_order(spark, odd):
    want = {i: (*brute.quality(t), brute.kept_by_rules(t)) for i, t in ODD}
    assert by_id(quality_verdicts(odd)) == want
    assert by_id(quality_verdicts(odd, order=["symbols", "lines", "capitals", "long_words", "short_words"])) == want
    assert by_id(quality_verdicts(odd, QualityRules(), order=["long_words", "capitals", "lines", "short_words", "symbols"])) == want


def test_quality_order(spark):
    """Rejection per cost, steady under noise; a rule that rejects nothing comes last."""
    from contactlake.llm.quality import QualityRules as Rules, chosen_order, order_rules

    found = {"cheap": (0.01, 100), "dear": (0.64, 100), "idle": (0.001, 0), "rare": (0.01, 1)}
    assert order_rules(found, 1000) == ["cheap", "rare", "dear", "idle"] or order_rules(found, 1000) == ["cheap", "dear", "rare", "idle"]
    g = random.Random(1)
    noisy = [order_rules({n: (t * g.uniform(0.9, 1.1), h) for n, (t, h) in found.items()}, 1000) for _ in range(20)]
    assert {x[0] for x in noisy} == {"cheap"} and {x[-1] for x in noisy} == {"idle"}
    table_ = spark.read.parquet(f"{SF}/documents.parquet")
    got = chosen_order(table_, Rules())
    assert set(got) == {"few_words", "repeats", "symbols", "short_words", "long_words", "lines", "capitals"}
    assert got[0] != "repeats"


def test_quality_repeated_rows_and_null_ids(spark):
    from contactlake.llm.quality import passing

    good = " ".join(f"word{i}" for i in range(30))
    rows = [(1, good), (1, good), (1, "short"), (None, good), (None, None), (2, "# " * 40)]
    got = sorted((tuple(x) for x in quality_verdicts(docs(spark, rows)).collect()), key=str)
    assert got == sorted(((i, *brute.quality(t), brute.kept_by_rules(t)) for i, t in rows), key=str)
    kept = sorted(((x.doc_id, x.text, x.rate) for x in passing(docs(spark, rows)).collect()), key=str)
    assert kept == sorted([(1, good, "extra"), (1, good, "extra"), (None, good, "extra")], key=str)


def test_quality_sample_of_null_ids_and_repeated_rows(spark, monkeypatch):
    """The sample stays near its size where all rows are the same and have no id."""
    from contactlake.llm import quality

    sizes = []
    monkeypatch.setattr(quality, "measure", lambda sample, conditions, times: sizes.append(sample.count()) or {n: (1.0, 0) for n in conditions})
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    assert quality.chosen_order(rows, QualityRules(sample_rows=500)) == sorted(quality.rules(quality.counts(F.col("text"), F.array(), QualityRules()), F.col("text"), QualityRules()))
    quality.chosen_order(rows.limit(100), QualityRules(sample_rows=500))
    assert 350 < sizes[0] < 650 and sizes[1] == 100


# repeats


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 20, 101, 500])
def test_suffix_array(n):
    g = np.random.default_rng(n)
    for letters in (1, 2, 5, 200):
        s = g.integers(1, letters + 1, n)
        assert suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_repeated_bytes_table(spark, small):
    assert by_id(queries.QUERIES["op5_suffix_array"](spark, SF)) == dict(zip([i for i, _ in small], brute.repeated_bytes(small), strict=True))


def test_repeated_words_table(spark, small):
    assert by_id(queries.QUERIES["op8_substrings"](spark, SF)) == dict(zip([i for i, _ in small], brute.repeated_words(small), strict=True))


def test_repeats_odd(spark, odd):
    ids = [i for i, _ in ODD]
    assert by_id(remove_repeated_bytes(odd)) == dict(zip(ids, brute.repeated_bytes(ODD), strict=True))
    assert by_id(remove_repeated_phrases(odd)) == dict(zip(ids, brute.repeated_words(ODD), strict=True))


def test_automaton_against_all_windows():
    """Places by the automaton equal those by comparing every window with every earlier document, whatever the rows' order."""
    from contactlake.llm.phrases import occurrences

    g = random.Random(3)
    for window in (2, 3, 5):
        for _ in range(60):
            rows = [(7, g.randrange(6), 100 * k, " ".join(g.choice("a b aa ab".split()) for _ in range(g.randrange(12))).encode()) for k in range(8)]
            split = {(u, lo): d.decode().split(" ") for _, u, lo, d in rows}
            at = [(u, lo + i, tuple(w[i : i + window])) for (u, lo), w in split.items() for i in range(len(w) - window + 1)]
            want = sorted((u, i) for u, i, p in at if any(v < u and q == p for v, _, q in at))
            uid, lo, hi = occurrences(rows, window)
            assert sorted(zip(uid.tolist(), lo.tolist(), strict=True)) == want and lo.tolist() == hi.tolist()


def test_repeats_hot_anchors(spark):
    """A passage in many different surroundings: with a low bound its anchors are matched window by window."""
    from contactlake.llm import repeats

    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"a{i} b{i} c{i} {passage} d{i} e{i} " + " ".join(f"q{j}" for j in range(i % 7, i % 7 + 15))) for i in range(60)]
    want_bytes, want_words = brute.repeated_bytes(rows), brute.repeated_words(rows)
    old = repeats.Layout.__dataclass_fields__["hot"].default
    for hot in (old, 3):
        make = repeats.Layout
        lay = lambda **k: make(**k, hot=hot, block=4096, chunk=2000)  # noqa: B023, E731
        import contactlake.llm.phrases as ph
        import contactlake.llm.suffixes as su

        ph.Layout, su.Layout = lay, lay
        try:
            assert by_id(remove_repeated_bytes(docs(spark, rows))) == dict(enumerate(want_bytes))
            assert by_id(remove_repeated_phrases(docs(spark, rows))) == dict(enumerate(want_words))
        finally:
            ph.Layout = su.Layout = make


def test_repeats_same_ids(spark):
    rows = [(1, BASE), (1, BASE), (None, BASE), (2, BASE + " x")]
    got = sorted((x.doc_id is not None, x.doc_id or 0, x.n_removed) for x in remove_repeated_phrases(docs(spark, rows)).collect())
    n = len(BASE.split())
    assert got == [(False, 0, 0), (True, 1, n), (True, 1, n), (True, 2, n)]


def test_repeated_bytes_same_ids(spark):
    rows = [(1, BASE), (1, BASE), (None, BASE), (2, BASE + " x"), (None, None)]
    got = sorted((x.doc_id is not None, x.doc_id or 0, x.n_bytes, x.n_removed) for x in remove_repeated_bytes(docs(spark, rows)).collect())
    n = len(brute.utf8(BASE))
    assert got == [(False, 0, 0, 0), (False, 0, n, 0), (True, 1, n, n), (True, 1, n, n), (True, 2, n + 2, n)]


# decontamination


def test_contamination_table(spark, small):
    items = table("benchmark").fetchall()
    got = by_id(queries.QUERIES["op6_decontaminate"](spark, SF))
    assert got == dict(zip([i for i, _ in small], brute.contaminated(small, items), strict=True))


@pytest.mark.parametrize("way", ["named keys, broadcast", "slots, shuffle"])
def test_contamination_odd(spark, odd, way, monkeypatch):
    import contactlake.llm.decontaminate as de

    items = [(1, " ".join(BASE.split()[5:30])), (2, "one"), (3, None), (4, ""), (None, BASE), (5, "the of ab0"), (1, "ONE a"), (6, " ".join(BASE.split()[5:30]))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit(1)).withColumn("words", F.lit(1))
    bound = 64 << 20
    if way.startswith("slots"):
        monkeypatch.setattr(de, "NAMED_KEYS", 2)
        monkeypatch.setattr(de, "SLOTS", 16)
        bound = 0
    got = by_id(contamination(odd, bench, broadcast_bytes=bound))
    assert got == dict(zip([i for i, _ in ODD], brute.contaminated(ODD, items), strict=True))
    assert not any(x.n_hit for x in contamination(odd, bench.limit(0), broadcast_bytes=bound).collect())


def test_contamination_long_item_and_repeated_ids(spark):
    """A very long item keeps its anchors small; rows with the same or no id are judged on their own."""
    import contactlake.llm.decontaminate as de

    g = random.Random(9)
    long_item = " ".join(f"v{g.randrange(3000)}" for _ in range(20_000))
    w = long_item.split()
    rows = [(1, " ".join(w[300:340])), (1, "nothing of it " * 30), (None, " ".join(w[-15:]) + " x"), (None, None), (2, " ".join(w[5000:5012])), (3, " ".join(w[9000:9200] + ["y"] * 50))]
    bench = spark.createDataFrame([("L", long_item)], "item_id string, text string")
    got = sorted((tuple(x) for x in contamination(docs(spark, rows), bench).collect()), key=str)
    assert got == sorted(((i, *c) for (i, _), c in zip(rows, brute.contaminated(rows, [("L", long_item)]), strict=True)), key=str)
    items = bench.select(F.lit(0).alias("item"), "item_id", de.item_words(F.col("text")).alias("words"))
    held = de._anchors(docs(spark, rows).select(de.item_words(F.col("text")).alias("words")), items, 13)
    assert held.agg(F.max(F.size("words"))).first()[0] <= 25


# sharding


def leaves(node):
    return [node] if node.shard is not None else [x for c in node.children for x in leaves(c)]


def plain_shard(key, node):
    """The leaf with the smallest exponential draw, by its weight."""

    def draw(leaf):
        h = xxhash.xxh64_intdigest(f"s{leaf.shard}".encode(), seed=xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), seed=42))
        return -np.log(((h >> 11) + 0.5) / 2**53) / leaf.own_weight

    return min((x for x in leaves(node) if x.own_weight > 0), key=draw).shard


def test_sharding_table(spark, small):
    tree = hash_tree(8)
    more = grown_tree(tree, 8)
    got = queries.QUERIES["op7_sharding"](spark, SF).collect()
    want = {i: (len(brute.utf8(t)) + 1, zlib.crc32(brute.utf8(t)), "key", plain_shard(i, tree), plain_shard(i, more)) for i, t in small}
    assert {x.doc_id: (x["size"], x.text_crc32, x.law, x.shard, x.grown_shard) for x in got} == want
    assert all(x.grown_shard in (x.shard, 8) for x in got)
    for s in range(8):
        slots = sorted(x.slot for x in got if x.shard == s)
        assert slots == list(range(len(slots)))


def test_sharding_weights_and_odd(spark, odd):
    tree = Node("root", (Node("a", (Node("a/0", shard=0), Node("a/1", shard=1, own_weight=0.0))), Node("b", (Node("b/2", shard=2, own_weight=3.0),))))
    n = assign_shards(spark.range(8000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text")), tree).groupBy("shard").count().collect()
    share = {x.shard: x["count"] / 8000 for x in n}
    assert set(share) == {0, 2} and abs(share[2] - 0.75) < 0.03
    got = assign_shards(odd.unionByName(docs(odd.sparkSession, [(1, BASE), (None, None)])), hash_tree(3), slot_buckets=2).collect()
    assert len(got) == len(ODD) + 2 and all(x.grown_shard is None for x in got)
    for s in {x.shard for x in got}:
        slots = sorted(x.slot for x in got if x.shard == s)
        assert slots == list(range(len(slots)))


def test_sharding_grows_into_the_new_shard_only(spark):
    """For every number of shards, and for a weight that changes inside a region."""
    keys = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    at = None
    for n in range(1, 17):
        now = by_id(assign_shards(keys, hash_tree(n)).select("doc_id", "shard"))
        assert {x[0] for x in now.values()} == set(range(n))
        assert at is None or all(now[i] in (at[i], (n - 1,)) for i in at)
        at = now
    tree = hash_tree(8)
    region = tree.children[0]
    heavy = Node(region.name, (region.children[0], Node(region.children[1].name, (Node("x", shard=2, own_weight=4.0), region.children[1].children[1]))))
    before, after = (by_id(assign_shards(keys, t).select("doc_id", "shard")) for t in (tree, Node("root", (heavy, tree.children[1]))))
    assert all(after[i] in (before[i], (2,)) for i in before) and sum(x == (2,) for x in after.values()) > 2 * sum(x == (2,) for x in before.values())


def test_sharding_many_alike_rows(spark):
    rows = [(7, "same")] * 500 + [(None, None)] * 300 + [(100 + i, "t") for i in range(50)]
    got = assign_shards(docs(spark, rows), hash_tree(4)).collect()
    assert len(got) == len(rows) and sum(x.doc_id == 7 for x in got) == 500
    for k in {x.shard for x in got}:
        assert sorted(x.slot for x in got if x.shard == k) == list(range(sum(x.shard == k for x in got)))


# language model


def close(a, b):
    return abs(a - b) <= 1e-9 * max(1, abs(b))


def test_scores_table(spark, small):
    got = by_id(queries.QUERIES["op9_ctw"](spark, SF))
    for (i, _), want in zip(small, brute.base_scores(small), strict=True):
        assert got[i][:4] == want[:4] and close(got[i][4], want[4])
    held = [x for x in got.values() if x[0]]
    assert sum(x[5] for x in held) > 1.3 * sum(x[4] for x in held)


def test_scores_odd(spark, odd):
    rows = [(i, t) for i, t in ODD if len(t or "") < 3000] + [(None, "Ab the"), (1, BASE)]
    got = sorted((tuple(x) for x in ctw.score_texts(docs(spark, rows), chunk_bytes=700).collect()), key=str)
    want = sorted(((i, *b, s) for (i, _), b, s in zip(rows, brute.base_scores(rows), brute.tree_scores(rows), strict=True)), key=str)
    for x, y in zip(got, want, strict=True):
        assert x[:5] == y[:5] and close(x[5], y[5]) and close(x[6], y[6])


def test_scores_of_a_long_text(spark):
    rows = [(1, LONG[:40_000]), (2, "Ab the"), (11, LONG[100:3000]), (5, None)]
    got = sorted((tuple(x) for x in ctw.score_texts(docs(spark, rows), chunk_bytes=20_000).collect()), key=str)
    want = sorted(((i, *b, s) for (i, _), b, s in zip(rows, brute.base_scores(rows), brute.tree_scores(rows), strict=True)), key=str)
    for x, y in zip(got, want, strict=True):
        assert x[:5] == y[:5] and close(x[5], y[5]) and close(x[6], y[6])


def test_chunks_have_buckets_of_their_own(spark):
    for n in (1, 2, 7, 64, 300):
        labels = ctw._labels(spark, n)
        dealt = spark.createDataFrame([(x,) for x in labels], "c long").select(F.pmod(F.hash("c"), F.lit(n))).distinct().count()
        assert len(labels) == n == dealt


def test_long_texts_are_cut_without_a_seam(monkeypatch):
    text = bytes(random.Random(3).randrange(256) for _ in range(1000))
    whole = ctw.grams(text)
    for step in (1, 7, 333, 1000, 5000):
        monkeypatch.setattr(ctw, "STEP", step)
        assert np.concatenate(list(ctw.gram_blocks(text))).tolist() == whole.tolist()


# urls

PAGES = [
    (1, "http://Shop.NET/a", "<link rel=canonical href='https://mirror.example.org/b'>"),
    (2, "https://mirror.example.org/b#x", ""),
    (3, "https://example.net/en/x", '<META HTTP-EQUIV="Refresh" CONTENT="0; URL=https://third.example.org/c">'),
    (4, "https://third.example.org/c", None),
    (5, "https://www.example.com/de/q?x=1", '<link href="/z" rel="canonical">'),
    (6, "https://www.example.com/z", "<p>canonical</p>"),
    (7, None, "<link rel=canonical href='https://shop.net/a'>"),
    (8, "no scheme", None),
    (9, "https://a.org/fr/1", "<link rel=canonical href='https://shop.net/a'>"),
    (10, "x://", ""),
    (11, "https://evilnet/", ""),
    (12, "https://mirror.example.org/b", ""),
]


def test_urls(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("node", F.lit(1)).withColumn("rule", F.lit(1))
    got = by_id(judge_urls(pages))
    # 1, 2, 9 and 12 are one page: 9's own rule allows, and so do its aliases without a rule; 1's own rule blocks
    want = {1: ("net/", "block"), 2: (None, "allow"), 3: ("example.net/en/", "allow"), 4: (None, "allow"), 5: ("example.com/de/", "block"), 6: (None, "block"), 7: (None, "allow"), 8: (None, "allow"), 9: ("org/fr/", "allow"), 10: (None, "allow"), 11: (None, "allow"), 12: (None, "allow")}
    assert {i: x[2:] for i, x in got.items()} == want
    assert got[1][:2] == ("shop.net", "/a") and got[5][:2] == ("www.example.com", "/de/q") and got[7][:2] == got[8][:2] == ("", "")
    log = spark.createDataFrame([("https://evilnet/", "https://shop.net/zzz")], "from_url string, to_url string")
    assert by_id(judge_urls(pages, redirects=log))[11][2:] == (None, "block")


def test_urls_relative(spark):
    """Aliases by relative canonical links and refreshes: each page shares the rule of one on shop.net or example.net/en/."""
    canonical, refresh = "<link rel=canonical href='{}'>".format, '<meta http-equiv=refresh content="0; url={}">'.format
    block, allow = canonical("https://shop.net/"), canonical("https://example.net/en/")
    cases = [("/d/e/x?q", canonical("page2.html"), "/d/e/page2.html"), ("/d/e/x", refresh("../y/./z?k=1#f"), "/d/y/z?k=1"), ("/d/e/x", refresh("?id=3"), "/d/e/x?id=3"), ("", canonical("p"), "/p"), ("", canonical("?p"), "/?p"), ("/d/e/x", canonical("../../../.."), "/"), ("/d/e/x", canonical(".."), "/d/"), ("/d/x", canonical("/a/../b"), "/b"), ("/d/x", "<base href='/o/q/'>" + canonical("r"), "/o/q/r")]
    rows = []
    for i, (at, html, to) in enumerate(cases):
        rows += [(2 * i, f"https://h{i}.example.org{at}", html), (2 * i + 1, f"https://h{i}.example.org{to}", block)]
    rows += [(100, "https://k.example.com/de/a", canonical("../b")), (101, "https://k.example.com/b", ""), (102, "https://m.example.org/d/a", canonical("mailto:x")), (103, "https://m.example.org/d/mailto:x", block), (104, "https://n.example.org/d/a", canonical("#top")), (105, "https://o.example.org/d/a", refresh("b")), (106, "https://o.example.org/d/b", allow), (107, "https://o.example.org/d/b", canonical("https://other.net/"))]
    got = {i: x[2:] for i, x in by_id(judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"))).items()}
    assert {i: v for i, (_, v) in got.items() if i < 100} == {i: "block" for i in range(2 * len(cases))}
    assert [got[i][1] for i in range(100, 108)] == ["block", "block", "allow", "block", "allow", "allow", "allow", "allow"]


def test_urls_ports_comments_scripts_and_long_pages(spark):
    canonical = "<link rel=canonical href='{}'>".format
    block = canonical("https://shop.net/")
    rows = [
        (1, "https://a.example.org/z", ""),
        (2, "https://a.example.org:443/z", block),
        (3, "http://b.example.org:80", block),
        (4, "HTTP://b.example.org/", ""),
        (5, "https://c.example.org:80/z", block),
        (6, "https://c.example.org/z", ""),
        (7, "https://d.example.org/", f"<!-- {block} -->"),
        (8, "https://e.example.org/", f"<script>var x = \"{block}\";</script>"),
        (9, "https://f.example.org/", f"<p>x</p><!-- {block}"),
        (10, "https://g.example.org/", "<p>filler</p>" * 40_000 + block),
        *((100 + i, None, block) for i in range(50)),
    ]
    got = by_id(judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert {i: got[i][3] for i in range(1, 11)} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "block"}
    assert all(got[100 + i] == ("", "", None, "allow") for i in range(50))


def test_urls_plan_stays_small(spark):
    """No step's expression is pasted into the next."""
    rows = [(1, "https://a.example.org/d/e", "<base href='/o/'><link rel=canonical href='../x?y'>"), (2, "https://a.example.org/x?y", "<link rel=canonical href='https://shop.net/'>")]
    out = judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {i: x[3] for i, x in by_id(out).items()} == {1: "block", 2: "block"}
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 100_000


def test_urls_rules_of_equal_length(spark):
    from contactlake.llm.url_filters import Rule

    rules = (Rule("a.org", "/x/", "block"), Rule("b.a.org", "/", "allow"), Rule("b.a.org", "/x", "block"))
    got = by_id(judge_urls(spark.createDataFrame([(1, "https://b.a.org/x/1", ""), (2, "https://b.a.org/y", "")], "page_id long, url string, html string"), rules))
    assert [got[i][2:] for i in (1, 2)] == [("b.a.org/x", "block"), ("b.a.org/", "allow")]
    ties = (Rule("a.org", "/xyz/", "block"), Rule("b.a.org", "/xy", "allow"))
    assert len(ties[0].name) == len(ties[1].name)
    got = by_id(judge_urls(spark.createDataFrame([(1, "https://b.a.org/xyz/1", "")], "page_id long, url string, html string"), ties))
    assert got[1][2:] == ("b.a.org/xy", "allow")


# mixing and licences


def test_mixing_meets_targets(spark):
    g = random.Random(1)
    kinds = {"clean": "sun moon star", "poor": "### $$$ %%%", "toxic": "bad worse worst"}
    rows, labels = [], []
    for i in range(600):
        k = ["clean", "clean", "poor", "toxic"][i % 4]
        rows.append((i, " ".join(g.choice(kinds[k].split()) + g.choice("ab") for _ in range(g.randrange(5, 40)))))
        if i % 3:
            labels.append((i, int(k != "poor"), int(k == "toxic")))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = Mixing(targets={"clean": 0.7, "poor": 0.2, "toxic": 0.1}, keep=None)
    out = mix_sources(docs(spark, rows), lab, m).collect()
    names = ["clean", "clean", "poor", "toxic"]
    assert sum(max(m.targets, key=lambda d: x[f"p_{d}"]) == names[x.doc_id % 4] for x in out) >= 0.98 * len(out)
    whole = sum(x.n_tokens for x in out)
    for d, share in m.targets.items():
        assert abs(sum(x.n_tokens * x[f"p_{d}"] * x.rate for x in out) / whole - share) < 0.01
    assert all(0 <= x.rate <= m.max_rate and x.copies in (int(x.rate), int(x.rate) + 1) for x in out)
    n = {x.doc_id: x.copies for x in out}
    again = [x.doc_id for x in mixed(docs(spark, rows), lab, m).collect()]
    assert sorted(again) == sorted(i for i, k in n.items() for _ in range(k))


@pytest.mark.parametrize("tokens", [(0.45, 0.50, 0.05), (0.60, 0.10, 0.30), (0.05, 0.05, 0.90), (0.95, 0.045, 0.005), (0.97, 0.03, 0.0)])
@pytest.mark.parametrize("keep", ["clean", None])
def test_mixing_skewed_shares_reach_the_optimum(spark, tokens, keep):
    g, rows = np.random.default_rng(2), []
    for d, t in enumerate(tokens):
        for _ in range(int(t * 400)):
            q = g.dirichlet([0.02, 0.02, 0.02]) * 0.002
            q[d] += 1 - q.sum()
            rows.append((100, *map(float, q)))
    a = np.array(rows)
    m = Mixing(keep=keep)
    p, share = a[:, 1:], np.array(list(m.targets.values()))
    whole = max(len(a), p[:, 0].sum() / share[0]) if keep else len(a)
    got = np.array([x.rate for x in fitted_rates(spark.createDataFrame(rows, "n_tokens long, p_clean double, p_poor double, p_toxic double"), m).collect()])
    # the same problem by many plain steps
    w, rate = 1 / share, np.ones(len(a))
    step = 1 / np.linalg.eigvalsh(np.sqrt(w)[:, None] * (p.T @ p / whole) * np.sqrt(w)).max()
    for _ in range(50_000):
        rate = np.clip(rate - step * p @ (w * (p.T @ rate / whole - share)), 0, m.max_rate)
    assert np.abs(p.T @ got / whole - p.T @ rate / whole).max() < 0.005  # rates are in hundredths


def test_mixing_fails_if_not_at_the_optimum(spark):
    rows = spark.createDataFrame([(10, 0.9, 0.1), (10, 0.2, 0.8)], "n_tokens long, p_clean double, p_poor double")
    with pytest.raises(RuntimeError, match="optimum"):
        fitted_rates(rows, Mixing(targets={"clean": 0.7, "poor": 0.3}, keep=None, steps=0))
    with pytest.warns(UserWarning, match="no rates"):
        fitted_rates(rows.where("p_clean > 0.5"), Mixing(targets={"clean": 0.2, "poor": 0.8}, keep=None))


def test_mixing_odd(spark, odd, none):
    lab = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (9, 0, 0), (99, 1, 1), (None, 1, 0), (10, None, None)], "doc_id long, quality int, toxic int")
    out = mix_sources(odd, lab).collect()
    assert len(out) == len(ODD) and all(abs(x.p_clean + x.p_poor + x.p_toxic - 1) < 1e-9 and x.source is None for x in out)
    assert mixed(odd, lab.limit(0)).columns == odd.columns
    assert mix_sources(none, lab).count() == 0


def test_mixing_keeps_its_tables_out_of_the_plans(spark, small):
    """What the driver keeps of every job is its plan's text."""
    labels = spark.createDataFrame(duckdb.sql(f"select doc_id, quality, toxic from '{SF}/labels.parquet'").fetchall(), "doc_id long, quality int, toxic int")
    text = lambda df: df._jdf.queryExecution().toString()
    d = docs(spark, small)
    model = mixing.train(d, labels, Mixing())
    rows = mixing.memberships(d, model, Mixing())
    assert model.evidence.any() and len(text(rows)) < 50_000
    assert "AS _e0" not in rows._jdf.queryExecution().optimizedPlan().toString()  # no row carries the array
    assert len(text(fitted_rates(rows.localCheckpoint(), Mixing()))) < 50_000
    # the same posteriors by plain numpy
    known = np.array([[float(f"{x:.4g}") for x in e] for e in model.evidence])
    for x in rows.withColumn("b", mixing.features(F.col("text"), Mixing().buckets)).collect():
        raw = model.prior + known[:, x.b].sum(axis=1)
        odds = np.exp(raw - raw.max())
        assert np.allclose([x[f"p_{n}"] for n in model.names], odds / odds.sum())


def test_mixing_without_labels_of_a_domain_and_repeated_rows(spark):
    g = random.Random(3)
    rows = [(i, " ".join(g.choice(["sun", "moon", "star"] if i % 3 else ["bad", "worse", "worst"]) + g.choice("ab") for _ in range(30))) for i in range(150)]
    rows += [rows[1]] * 40 + [(None, "sun moon"), (None, None)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(150)], "doc_id long, quality int, toxic int")
    with pytest.warns(UserWarning, match="poor"):
        out = mix_sources(docs(spark, rows), labels).collect()
    assert len(out) == len(rows) and all(x.p_poor == 0 for x in out)
    assert len({tuple(x) for x in out if x.doc_id == 1}) == 1
    assert all(x.copies >= 1 for x in out if x.p_clean > x.p_toxic)
    whole = {d: sum(x.n_tokens * x.rate * x[f"p_{d}"] for x in out) for d in ("clean", "toxic")}
    assert abs(whole["toxic"] / sum(whole.values()) - 0.03 / 0.93) < 0.01


def test_licenses_long_texts_ties_and_clashing_names(spark):
    filler = " ".join(f"w{i}" for i in range(60_000))
    notice = "alpha beta gamma delta epsilon"
    rows = [(1, "a/x", filler + "\n" + notice), (2, "a/y", notice), (2, "a/y", notice), (3, "b/z", None), (None, "a/q", "nothing")]
    f = spark.createDataFrame(rows, "doc_id long, path string, text string")
    for c in ("rid", "n_words", "_x", "dir", "at", "w", "license"):
        f = f.withColumn(c, F.lit("extra"))
    got = sorted(((x.doc_id, x.license, x.origin, x.from_dir) for x in scan_licenses(f, (("B", notice), ("A", notice))).collect()), key=str)
    assert got == sorted([(1, "A", "header", None), (2, "A", "file", None), (2, "A", "file", None), (3, None, "none", None), (None, "A", "inherited", "a")], key=str)


def test_licenses(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/x.txt", "no notice here"),
        (3, "a/b/c/y.txt", "text\nLicensed under the Apache License, Version 2.0.\n" + "word " * 60),
        (4, "z/q.txt", "the license of the thing is unclear"),
        (5, None, None),
        (6, "top.txt", ""),
        (7, "a/b/LICENSE", "This work is licensed under the GNU General Public License, version 3."),
        (2, "a/b/x.txt", "no notice here"),
    ]
    f = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("dir", F.lit(1)).withColumn("license", F.lit(1))
    got = sorted((x.doc_id, x.license, x.origin, x.from_dir) for x in scan_licenses(f).collect())
    assert got == [(1, "MIT", "file", None), (2, "GPL-3.0", "inherited", "a/b"), (2, "GPL-3.0", "inherited", "a/b"), (3, "Apache-2.0", "header", None), (4, None, "none", None), (5, None, "none", None), (6, None, "none", None), (7, "GPL-3.0", "file", None)]


def license_brute(texts, templates, threshold=0.8):
    """Best (license, cosine) of each text over all lines, blocks, windows and the whole, without any bound."""
    words = lambda t: re.findall("[a-z0-9]+", t.translate(brute.UPPER))
    known = {w for _, t in templates for w in words(t)}
    df = Counter(w for t in texts for w in set(words(t or "")))
    idf = lambda w: math.log((1 + len(texts)) / (1 + (df[w] if w in known else 0))) + 1
    vector = lambda w: {x: n * idf(x) for x, n in Counter(w).items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = []
    for text in texts:
        t = text or ""
        w = words(t)
        found = []
        for i, (lic, template) in enumerate(templates):
            tv, n = vector(words(template)), len(words(template))
            for part in [w, *map(words, t.split("\n")), *map(words, re.split(r"\n[ \t\r]*\n", t)), *(w[j : j + n] for j in range(len(w) - n + 1))]:
                if part:
                    v = vector(part)
                    c = round(sum(x * tv.get(k, 0) for k, x in v.items()) / size(v) / size(tv), 6)
                    found += [(-c, lic, i)] if c >= threshold else []
        out.append((min(found)[1], -min(found)[0]) if found else (None, None))
    return out


ZLIB = "This software is provided as-is, without any express or implied warranty."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"


def test_licenses_without_cues_and_across_lines(spark):
    from contactlake.llm.licenses import TEMPLATES

    filler = " ".join(f"f{i}" for i in range(50))
    whole = ". ".join(" ".join(f"clause{j} w{i}" for i in range(j, j + 12)) for j in range(20))
    templates = (*TEMPLATES, ("Zlib", ZLIB), ("Full", whole))
    g = random.Random(4)
    pool = " ".join(t for _, t in templates[:-1]).split() + ["zz", "yy"]
    texts = [
        BSD.replace("Redistribution and use", "Use"),
        BSD.replace("or without ", "or without\n * ").replace("that the", "that\n * the"),
        f"{filler} {BSD} {filler}",
        f"{filler}\n\n# This software is provided as-is,\n# without any express or implied\n# warranty.\n\n{filler}",
        whole.replace(". ", ".\n").replace("clause7 w7 ", "Copyright holder "),
        "nothing here",
        None,
        "",
        *(" ".join(g.choice(pool) + g.choice(["", "", "", "\n", "\n\n"]) for _ in range(40)) for _ in range(8)),
        *(" ".join(w for w in g.choice(templates)[1].split() if g.random() < 0.85) + "\n" + filler for _ in range(14)),
    ]
    f = spark.createDataFrame([(i, f"d{i}/x", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    got = {x.doc_id: x for x in scan_licenses(f, templates).collect()}
    want = license_brute(texts, templates)
    for i, (lic, c) in enumerate(want):
        assert got[i].license == lic and (c is None or abs(got[i].cosine - c) < 2e-6), (i, got[i], lic, c)
    assert [x[0] for x in want[:8]] == ["BSD-3-Clause"] * 3 + ["Zlib", "Full", None, None, None]
    assert [got[i].origin for i in (0, 1, 2, 3, 4)] == ["file", "file", "header", "header", "file"]
    assert scan_licenses(f, ()).where("license is not null").count() == 0


def test_licenses_table(spark, small):
    """Every row of the table: matches by brute force, then the nearest directory with a licence file."""
    from contactlake.llm.licenses import TEMPLATES

    files = [(x.doc_id, x.path, x.text) for x in queries.document_files(spark, SF).orderBy("doc_id").collect()]
    best = license_brute([t for *_, t in files], TEMPLATES)
    got = {x.doc_id: x for x in queries.QUERIES["op2_licenses"](spark, SF).collect()}
    assert len(got) == len(files)
    folders = {}
    for (i, path, _), (lic, c) in zip(files, best, strict=True):
        x = got[i]
        assert x.path == path
        if lic:
            assert x.license == lic and x.origin in ("file", "header") and x.from_dir is None and abs(x.cosine - c) < 2e-6
        if x.origin == "file":
            folders.setdefault(path.rpartition("/")[0], []).append((-x.cosine, path, lic))
    assert sum(lic is not None for lic, _ in best) >= 3
    for (i, path, _), (lic, _) in zip(files, best, strict=True):
        if not lic:
            d = path.rpartition("/")[0]
            while d not in folders and d:
                d = d.rpartition("/")[0]
            want = (min(folders[d])[2], "inherited", d) if d in folders else (None, "none", None)
            assert (got[i].license, got[i].origin, got[i].from_dir) == want


def test_mixing_meets_its_targets(spark):
    from contactlake.llm.mixing import TARGETS

    rows = queries.QUERIES["op1_mixing"](spark, SF.replace("0.001", "0.1")).collect()  # the smallest tables have too few labels
    whole = sum(x.rate * x.n_tokens for x in rows)
    for d, share in TARGETS.items():
        assert abs(sum(x.rate * x.n_tokens * x[f"p_{d}"] for x in rows) / whole - share) < 1e-3


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (near_duplicates(none), quality_verdicts(none), remove_repeated_bytes(none), remove_repeated_phrases(none), contamination(none, bench), assign_shards(none, hash_tree(8)), ctw.score_texts(none), judge_urls(pages), mix_sources(none, labels), scan_licenses(none.withColumn("path", F.lit("a")))):
        assert df.count() == 0


def test_decontamination_of_a_text_full_of_hits(spark):
    """Time grows with the text, not with the square of its hits."""
    import time

    r = random.Random(9)
    item = [f"w{r.randrange(10**6)}" for _ in range(20_000)]
    text = " ".join(item * 10)  # 200,000 places, one hit each
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "never seen words here")], "item_id long, text string")
    began = time.time()
    got = contamination(spark.createDataFrame([(1, text), (2, "clean " * 50)], "doc_id long, text string"), bench).orderBy("doc_id").collect()
    assert (got[0].n_words, got[0].n_hit, got[0].n_items, got[0].contaminated) == (200_000, 200_000, 1, True)
    assert got[1].n_hit == 0 and time.time() - began < 30


def test_licenses_of_a_text_of_very_many_lines(spark):
    import time

    from contactlake.llm.licenses import TEMPLATES

    lines = [f"line number {i} of this file x{i * 7}" for i in range(200_000)]
    lines[100_000] = TEMPLATES[0][1]
    began = time.time()
    got = scan_licenses(spark.createDataFrame([(1, "a/b.txt", "\n".join(lines)), (2, "a/c.txt", "x")], "doc_id long, path string, text string")).orderBy("doc_id").collect()
    assert got[0].license == TEMPLATES[0][0] and got[0].cosine > 0.99 and got[1].license is None
    assert time.time() - began < 30
