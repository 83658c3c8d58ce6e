"""Each stage on what its predecessor kept, against brute force."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contactlake.llm.common import stored, table

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "test")
        out.append((name, docs))
    return out


def rows(df):
    return sorted((x.doc_id, x.text) for x in df.select("doc_id", "text").collect())


def test_stages(spark, stages):
    start = table(spark, SF, "documents")
    assert [n for n, _ in stages] == ["quality rules", "near-dedup", "decontamination", "mixing", "sharding"]
    assert all(df.columns == start.columns for _, df in stages[:-1])
    before = rows(start)
    want = [x for x in before if brute.kept_by_rules(x[1])]
    assert rows(stages[0][1]) == want
    comp = brute.near(want, 5)
    want = [x for x in want if comp[x[0]] == x[0]]
    assert rows(stages[1][1]) == want
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    want = [x for x, c in zip(want, brute.contaminated(want, items), strict=True) if not c[-1]]
    assert rows(stages[2][1]) == want
    mixed = rows(stages[3][1])
    assert set(mixed) <= set(want)
    labels = {i: (q, t) for i, q, t in duckdb.sql(f"select doc_id, quality, toxic from '{SF}/labels.parquet'").fetchall()}
    clean = [x for x in want if labels.get(x[0]) == (1, 0)]
    assert sum(x in mixed for x in clean) >= 0.97 * len(clean)
    assert sorted(x.doc_id for x in stages[4][1].collect()) == [i for i, _ in mixed]


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[4][1].count()


def test_rows_have_their_own_decisions(spark, tmp_path):
    """Null ids, and one id with different texts: copies go, everything else stays."""
    text = lambda c, n=40: " ".join(f"{c}{i}" for i in range(n))
    a, b, c, d = map(text, "abcd")
    docs = spark.createDataFrame([(5, a), (5, b), (9, b), (None, c), (None, c), (None, d), (7, d), (5, a), (None, None)], "doc_id long, text string")
    got = corpus_pipeline.dedup(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(5, a), (5, b), (None, c), (7, d), (None, None)], key=str)
    spark.createDataFrame([(1, a)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, a), (None, b), (None, None), (5, a), (5, b)], "doc_id long, text string")
    got = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, b), (None, None), (5, b)], key=str)


def odd_rows():
    """Nulls, blanks, copies, repeated ids and a very long text."""
    text = lambda c, n=60: " ".join(f"{c}word{i}" for i in range(n))
    long = text("l", 20_000)
    return [(1, text("a")), (2, text("a")), (2, text("a")), (3, text("a") + " end"), (None, text("a")), (None, None), (4, ""), (5, " \n "), (6, long), (7, long), (8, text("b")), (8, text("c")), (None, text("d")), (9, "too short"), (10, "### " * 50)]


def wide(spark, rows):
    out = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("row", "rate", "draw", "n", "__row", "n_tokens", "p_clean", "words", "key", "kept", "b"):
        out = out.withColumn(c, F.lit("extra"))
    return out


def test_stages_on_odd_rows(spark, tmp_path):
    rows = odd_rows()
    passage = rows[10][1]
    spark.createDataFrame([(1, passage), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (8, 0, 0), (8, 1, 1), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = wide(spark, rows)
    of = lambda df: sorted(((x.doc_id, x.text) for x in df.collect()), key=str)
    got = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and of(got) == sorted([x for x in rows if brute.kept_by_rules(x[1])], key=str)
    got = corpus_pipeline.dedup(spark, docs, str(tmp_path))
    a, long = rows[0][1], rows[8][1]
    assert got.columns == docs.columns
    assert of(got) == sorted([x for x in rows if x[1] not in (a, long, a + " end")] + [(1, a), (6, long)], key=str)
    got = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and of(got) == sorted([x for x in rows if x[1] != passage], key=str)
    got = corpus_pipeline.mix(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and set(of(got)) <= set(rows)
    got = corpus_pipeline.shard(spark, docs, str(tmp_path)).collect()
    assert sorted((x.doc_id or -1, x["size"]) for x in got) == sorted((i or -1, len(brute.utf8(t)) + 1) for i, t in rows)
    for s in {x.shard for x in got}:
        assert sorted(x.slot for x in got if x.shard == s) == list(range(sum(x.shard == s for x in got)))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


@pytest.mark.parametrize("keep", ["clean", None])
def test_mixing_against_plain_python(spark, stages, keep):
    """Posteriors, cells and rates of the stage's own input, recomputed in numpy from the trained model."""
    import math
    import re

    import numpy as np
    import xxhash

    from contactlake.llm import mixing

    docs, labels, m = stages[2][1], table(spark, SF, "labels"), mixing.Mixing(keep=keep)  # the stage keeps clean documents, the query nothing
    model = mixing.train(docs, labels, m)
    got = {x.doc_id: x for x in mixing.mix_sources(docs, labels, m).collect()}
    texts = dict(rows(docs))
    names = [d for d in m.targets if d in model.names]
    rounded = np.array([[float(f"{x:.4g}") for x in e] for e in model.evidence])
    p, n = {}, {}
    for i, t in texts.items():
        words = re.sub(r"([!-/:-@\[-`{-~]+)", r" \1 ", t.lower())
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", words) if w]
        b = sorted({int(np.int64(np.uint64(xxhash.xxh64_intdigest(w.encode(), seed=42))) % m.buckets) for w in words})
        raw = {d: model.prior[k] + rounded[k, b].sum() for k, d in enumerate(model.names)}
        top = max(raw.values())
        odds = {d: math.exp(raw[d] - top) for d in raw}
        p[i] = [odds.get(d, 0.0) / sum(odds.values()) for d in m.targets]
        n[i] = len(re.findall(r"[^\x20\x09-\x0D]+", t))
        assert got[i].n_tokens == n[i] and all(abs(got[i][f"p_{d}"] - x) < 1e-9 for d, x in zip(m.targets, p[i], strict=True))
    ids = sorted(texts)
    a, q = np.array([n[i] for i in ids], float), np.array([p[i] for i in ids])
    share = np.array([m.targets[d] if d in names else 0.0 for d in m.targets])
    share /= share.sum()
    whole = max(a.sum(), (a * q[:, 0]).sum() / share[0]) if keep else a.sum()
    low = np.where(q[:, 0] >= q.max(axis=1), 1.0, 0.0) if keep else np.zeros(len(ids))
    w, rate = 1 / np.maximum(share, 0.01), np.maximum(1.0, low)
    step = 1 / np.linalg.eigvalsh(np.sqrt(w)[:, None] * ((q * (a / whole)[:, None]).T @ q) * np.sqrt(w)).max()
    for _ in range(100_000):
        rate = np.maximum(low, rate - step * q @ (w * ((a / whole * rate) @ q - share)))
    mine = np.array([got[i].rate for i in ids])
    assert np.abs((a / whole * rate) @ q - (a / whole * mine) @ q).max() < 0.01
    assert all((x >= 1) for x, l in zip(mine, low, strict=True) if l)
