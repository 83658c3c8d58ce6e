"""Source divergence, nearest neighbours and centroid clustering against plain Python, on tables and on rows that are hard to handle."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from contactlake.llm import queries
from contactlake.llm.centroids import cluster_vectors
from contactlake.llm.divergence import source_divergence
from contactlake.llm.neighbours import PermutationIndex, nearest_neighbours
from contactlake.llm.oracles import ORACLES
from tests.compare import differences, duck

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
BILLION = 1_000_000_000


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", ["op11_divergence", "op13_centroids"])
def test_queries_against_sql(spark, con, name):
    assert differences(spark, con, queries.QUERIES[name], ORACLES[name], SF) is None


def more_columns(df, *names):
    for c in names:
        df = df.withColumn(c, F.lit("extra"))
    return df


# --- source divergence


def plain_divergence(docs, least=30, top=50):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [(a or "", b or "", TERM.findall((t or "").translate(lower))) for a, b, t in docs]
    df, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        n[lang, source].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in df[lang].items() if k >= least]
        counts = {s: {t: n[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(c[t] for c in counts.values()) for t in kept}

        def shares(c, kept=kept):
            return {t: 1 + BILLION * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            out += [(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(pairs)]
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(terms)]
    return sorted(out)


def divergence_rows(spark, docs, **more):
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id long, lang string, source string, text string")
    df = more_columns(df, "n", "docs", "term", "chunk", "block", "pos", "width", "total", "terms")
    return sorted(tuple(r) for r in source_divergence(df, **more).select("lang", "source", "part", "item", "value", "rank").collect())


def odd_docs(seed=1, rows=400):
    r = random.Random(seed)
    words = ["Ab", "aB", "é", "É", "日本", "x-y", "a1b", "\x00nul", "zz"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]
    out = []
    for k in range(rows):
        lang = r.choice(["en", "en", "en", None, "", "de"])
        source = r.choice(["big", "big", "s1", "s2", None, "", "é", "s3"])
        out.append((lang, source, " ".join(r.choice(words[: 20 + 100 * (k % 2)]) for _ in range(r.randrange(60)))))
    return out + [("en", "no terms", "1 2 3 []"), ("en", "none at all", None), ("fr", "alone", "few words"), ("fr", "other", ""), ("xx", "one source", "x"), ("en", "long", "word " * 400_000 + "é" * 2_000_000)] + out[:5]


def test_divergence_against_plain_python(spark):
    docs = odd_docs()
    assert divergence_rows(spark, docs) == plain_divergence(docs)


def test_divergence_over_many_tiles_and_chunks(spark):
    docs = odd_docs(2, 700) + [("en", f"src{k % 37}", f"wa wb w{chr(97 + k % 26)}a only{k % 5}") for k in range(300)]
    assert divergence_rows(spark, docs, block=4, chunk=7, least_docs=3, top=5) == plain_divergence(docs, 3, 5)


def test_divergence_of_nothing(spark):
    assert divergence_rows(spark, []) == []


def test_shares_are_exact_at_large_counts(spark):
    from contactlake.llm.divergence import _shares, share

    for c, n, v in ((0, 0, 1), (7, 7, 1), (10**15, 8 * 10**15, 10**6), (123_456_789_012, 10**14 + 7, 999), (10**15 - 1, 10**15 - 1, 1)):
        want = 1 + BILLION * (c + 5) // (n + 5 * v)
        assert int(_shares(np.array([c]), n, v)[0]) == want
        assert spark.range(1).select(share(*[F.lit(x).cast("long") for x in (c, n, v)])).first()[0] == want


# --- nearest neighbours


def plain_neighbours(rows, every=20, k=20):
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out = []
    for i, v in rows:
        if i % every == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in rows if (j, w) != (i, v))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(near)]
    return out


def neighbour_rows(spark, rows, kind="double", every=20, **more):
    df = more_columns(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), "v", "cid", "rank", "first", "score", "pivot", "ids")
    return sorted(tuple(r) for r in nearest_neighbours(df, F.col("vec_id") % every == 0, **more).select("query_id", "rank", "vec_id", "score").collect())


def agree(got, want, recall):
    """Every query has as many rows as it must; shares of right rows; scores that belong to their rows."""
    assert Counter(r[0] for r in got) == Counter(r[0] for r in want)
    right = len({(r[0], r[2]) for r in got} & {(r[0], r[2]) for r in want})
    assert right >= recall * len(want)
    assert [r[1] for r in got] == [r[1] for r in want]
    by_query = defaultdict(list)
    for q, _, v, s in got:
        by_query[q].append((-s, v))
    assert all(x == sorted(x) for x in by_query.values())


def test_neighbours_of_the_table(spark):
    rows = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()
    got = sorted(tuple(r) for r in queries.QUERIES["op12_neighbours"](spark, SF).select("query_id", "rank", "vec_id", "score").collect())
    agree(got, sorted(plain_neighbours(rows)), 0.9)


def test_neighbours_recall_on_even_and_on_clustered_vectors(spark):
    r = np.random.default_rng(3)
    even = r.normal(size=(3000, 24))
    centres = r.normal(size=(40, 24)) * 4
    clustered = centres[r.integers(40, size=3000)] + r.normal(size=(3000, 24)) * 0.3
    for x in (even, clustered):
        rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
        agree(neighbour_rows(spark, rows, index=PermutationIndex(sample=1000, list_block=64, query_block=16)), sorted(plain_neighbours(rows)), 0.9)


def test_neighbours_of_odd_rows(spark):
    r = random.Random(4)
    same = [0.5, -0.25, 1.0]
    rows = [(i, same) for i in range(70)] + [(i, [r.choice([-1.0, 0.5, 2.0]) for _ in range(3)]) for i in range(70, 110)]
    rows += [(110, None), (111, []), (112, [0.0, 0.0, -0.0]), (113, [1.0, None, 2.0]), (114, [float("nan"), 1.0, 1.0]), (115, [float("inf"), 1.0, 1.0]), (None, same), (120, [-0.0, 1.0, 0.0]), (121, [0.0, 1.0, 0.0]), (140, [3.0]), (141, [1.0, 1.0, 1.0, 1.0])]
    rows += [(20, same), (160, [1e3, -1e3, 5.0]), (160, [7.0, 1.0, 1.0])]
    got = neighbour_rows(spark, rows)
    assert got == sorted(plain_neighbours(rows))  # so few classes that all are met


def test_neighbours_of_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]
    assert neighbour_rows(spark, rows) == sorted(plain_neighbours(rows))
    assert neighbour_rows(spark, [(0, [1.0])]) == [] == neighbour_rows(spark, [])
    assert neighbour_rows(spark, [(1, [1.0]), (2, [2.0])]) == []


def test_neighbours_that_no_file_leads_to(spark):
    """A query that meets fewer rows than it must return is compared with all."""
    from contactlake.llm import neighbours as n

    r = np.random.default_rng(5)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(r.normal(size=(400, 8)))]
    real = n.fitted
    n.fitted = lambda *a: n._Fitted(real(*a).pivots, 1, 1, 0)
    try:
        got = neighbour_rows(spark, rows, index=PermutationIndex(sample=200))
    finally:
        n.fitted = real
    assert Counter(x[0] for x in got) == {q: 20 for q in range(0, 400, 20)}


# --- centroid clustering


def plain_lloyd(rows, clusters=8, rounds=10, components=64, seed="3"):
    kept = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if v is not None and len(v) == components and all(x is not None and math.isfinite(x) and abs(x) < 2**52 for x in v)]
    name = {i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest() for i, _ in kept}
    cs = [v for i, v in sorted(kept, key=lambda r: (name[r[0]], r[1]))[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(cs)) for _, v in kept]

    for _ in range(rounds):
        members = defaultdict(list)
        for (_, k), (_, v) in zip(assign(), kept, strict=True):
            members[k].append(v)
        cs = [tuple(sum(x) // len(members[k]) for x in zip(*members[k], strict=True)) if members[k] else c for k, c in enumerate(cs)]
    last, sums = assign(), Counter()
    for d, k in last:
        sums[k] += d
    fits = lambda n: n if n < 2**63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return [(i, k, fits(d), fits(sums[k]), fits(sum(sums.values())), sha[k]) for (i, _), (d, k) in zip(kept, last, strict=True)]


def cluster_rows(spark, rows, kind="double", **more):
    df = more_columns(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), "x", "d", "cluster", "v", "h")
    return cluster_vectors(df, **more).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def compare(spark, rows, **more):
    got = [tuple(r) for r in cluster_rows(spark, rows, **more).collect()]
    assert sorted(got, key=repr) == sorted(plain_lloyd(rows, **{k: v for k, v in more.items() if k != "kind"}), key=repr)
    return got


def test_clusters_of_odd_rows(spark):
    r = random.Random(6)
    rows = [(i, [r.choice([-1.5, -0.001, 0.0, 0.7, 3.25]) for _ in range(4)]) for i in range(200)]
    rows += [(500 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(300)]  # one very common vector
    rows += [(900, None), (901, []), (902, [1.0]), (903, [1.0, None, 1.0, 1.0]), (904, [float("nan")] * 4), (905, [float("-inf"), 0.0, 0.0, 0.0]), (None, [1.0, 2.0, 3.0, 4.0]), (7, [9.0, 9.0, 9.0, 9.0]), (7, [9.0, 9.0, 9.0, 9.0]), (906, [2.0**60, 0.0, 0.0, 0.0])]
    assert len({x[1] for x in compare(spark, rows, components=4)}) > 4
    compare(spark, rows, components=4, clusters=3, rounds=0)


def test_clusters_of_large_components(spark):
    """Squares beyond 64 bits are exact; what no long holds is null."""
    r = random.Random(7)
    rows = [(i, [r.choice([-1, 1]) * r.random() * 10.0 ** r.choice([2, 6, 9]) for _ in range(3)]) for i in range(90)]
    got = compare(spark, rows, components=3, clusters=30)
    assert any(x[2] is None for x in got) and any(x[2] for x in got)


def test_clusters_of_equal_starts_few_rows_and_none(spark):
    compare(spark, [(i, [1.0, 2.0]) for i in range(30)], components=2)
    compare(spark, [(1, [1.0, 2.0]), (2, [3.0, 4.0])], components=2)
    assert cluster_rows(spark, []).collect() == []


def test_clusters_of_floats(spark):
    r = np.random.default_rng(8)
    compare(spark, [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(r.normal(size=(500, 64)))], kind="float")
