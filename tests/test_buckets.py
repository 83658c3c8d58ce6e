"""Copy-on-write tables and the suppression kept up to date in them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from contactlake.operators import blocklist as b
from contactlake.operators.merge import coalesced, new_value
from contactlake.operators.suppression import Suppression
from contactlake.sources.buckets import BucketedTable

SCHEMA = "company_id long, email string, category string, source string"
POLICIES = {"category": new_value, "source": coalesced}


def files(path):
    return {str(f.relative_to(path)) for f in path.rglob("*.parquet")}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_an_upsert_rewrites_the_buckets_it_touches(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, ["company_id", "email"], ["company_id"], 100)
    known = [(c, f"{k}@x.com", "a", f"s{c}") for c in range(1000) for k in range(3)]
    assert table.read().count() == 0
    table.upsert(spark.createDataFrame(known, SCHEMA), POLICIES)
    before = files(tmp_path / "t")
    assert len(before) == 100
    some = [(c, e, "b", None) for c in range(10) for e in ("0@x.com", "new@x.com")] + [(None, "x", None, "n")]
    batch = spark.createDataFrame([(*r, k) for k, r in enumerate(some + [(3, "0@x.com", "last", None)])], SCHEMA + ", ord int")
    at = table.upsert(batch, POLICIES, "ord")
    after = files(tmp_path / "t")
    assert len(before - after) <= len(at) <= 11 and len(after) == 100  # a hundredth of the companies, about as many buckets
    want = {(c, e): (c, e, k, s) for c, e, k, s in known}
    for c, e, k, s in [*some, (3, "0@x.com", "last", None)]:
        want[c, e] = (c, e, k, s if s or (c, e) not in want else want[c, e][3])
    assert rows(table.read()) == sorted(want.values(), key=repr)
    assert table.upsert(batch.limit(0), POLICIES) == [] and files(tmp_path / "t") == after
    # a second handle on the same folder; removal by key
    again = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, ["company_id", "email"], ["company_id"], 100)
    gone = spark.createDataFrame([(c, f"{k}@x.com") for c in (500, 501) for k in range(3)] + [(7777, "none")], "company_id long, email string")
    again.delete(gone)
    assert rows(again.read()) == sorted((r for k, r in want.items() if k[0] not in (500, 501)), key=repr)
    assert again.read(of=gone).count() < again.read().count() / 10


def test_a_failed_upsert_changes_nothing(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, ["company_id", "email"], ["company_id"], 8)
    table.upsert(spark.createDataFrame([(c, "e", "a", "s") for c in range(50)], SCHEMA), POLICIES)
    before, told = files(tmp_path / "t"), rows(table.read())
    bad = spark.createDataFrame([(c, "e", "a", "s") for c in range(50)], SCHEMA).withColumn("category", F.when(F.col("company_id") == 49, F.raise_error(F.lit("bad row"))).otherwise(F.col("category")))
    with pytest.raises(Exception, match="bad row"):
        table.upsert(bad, POLICIES)
    assert files(tmp_path / "t") == before and rows(table.read()) == told


def test_buckets_must_be_of_columns(spark, tmp_path):
    with pytest.raises(ValueError):
        BucketedTable(spark, str(tmp_path), SCHEMA, ["nothing"])


def test_suppression_equals_full_recomputation(spark, tmp_path):
    r = random.Random(2)
    words = ["acme", "fleet", "telematics", "geo", "trak", "north", "blue", "one"]
    company = lambda i: (i, " ".join(r.sample(words, r.randrange(1, 4))).title() if i % 17 else None, f"{r.choice(words)}{i % 7}.com" if i % 5 else None, False)
    companies = [company(i) for i in range(120)]
    entries = [(i, " ".join(r.sample(words, r.randrange(1, 3))) if i % 9 else None, f"{r.choice(words)}{i % 7}.com" if i % 2 else None) for i in range(24)]
    of = lambda rs: spark.createDataFrame(rs, "id long, name string, domain string")
    known, later = spark.createDataFrame(companies[:80], "id long, name string, domain string, blocked boolean"), spark.createDataFrame(companies[80:], "id long, name string, domain string, blocked boolean")
    kept, live, seen = Suppression(spark, str(tmp_path), 16), {}, known
    kept.add_companies(known)

    def same():
        want = {x.id: x.blocked for x in b.flags(seen, of([*live.values()])).collect()}
        assert {x.id: x.blocked for x in kept.flags(seen).collect()} == want
        return sum(want.values())

    kept.add(of(entries[:10]))
    live |= {e[0]: e for e in entries[:10]}
    assert 0 < same() < 80
    before = files(tmp_path / "supports")
    at = kept.add(of([entries[11], entries[3], entries[11]]))  # one is known, one is told twice
    live[11] = entries[11]
    same()
    assert len(before - files(tmp_path / "supports")) <= len(at)
    kept.add_companies(later)
    seen = known.unionByName(later)
    same()
    kept.remove(of([entries[0], entries[5], entries[20], entries[11]]))  # one isn't known
    for i in (0, 5, 11):
        live.pop(i)
    same()
    kept.remove(of(entries))
    live.clear()
    assert same() == 0 and kept.entries.read().count() == 0
    assert kept.add(of([])) == []


def test_an_upsert_computes_its_batch_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(x):
        seen.add(1)
        return x

    table = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, ["company_id", "email"], ["company_id"], 8)
    batch = spark.range(100).select(F.col("id").alias("company_id"), F.lit("e").alias("email"), told(F.lit("a")).alias("category"), F.lit("s").alias("source")).withColumn("company_id", F.when(F.col("category") == "a", F.col("company_id")))
    for n in (100, 200):  # a new table, then one that there is
        assert table.upsert(batch, POLICIES) == [*range(8)] and table.read().count() == 100
        assert seen.value <= 2 * n  # the two columns that need it
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
