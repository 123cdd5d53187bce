import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import edge_docs, empty_docs
from veilwatch.llm import sharding as S

LIMIT = 20_000


def check(rows, limit):
    """Every shard fits, and its parent prefix would not have."""
    shards, prefixes = {}, {}
    for r in rows:
        shards.setdefault(r["shard_id"], []).append(r["n_bytes"])
        bits = r["shard_id"].split("-")[1]
        for d in range(len(bits)):
            if r["n_bytes"] <= limit:
                prefixes[bits[:d]] = prefixes.get(bits[:d], 0) + r["n_bytes"]
    for name, sizes in shards.items():
        depth, bits = name.split("-")
        assert int(depth) == len(bits)
        assert sum(sizes) <= limit or len(sizes) == 1
        if len(bits) and len(bits) < S.BITS:
            assert prefixes[bits[:-1]] > limit
    names = sorted(n.split("-")[1] for n in shards if not n.startswith("128"))
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    return shards


@pytest.mark.parametrize("limit", [5_000, 50_000, 1 << 26])
def test_shards_fit_and_split_only_when_needed(spark, limit):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = S.shards(docs, limit).collect()
    assert len(rows) == docs.count()
    shards = check(rows, limit)
    assert len(shards) > 1 or limit > 1_000_000


def test_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(S, "SLACK", 1)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(S.shards(docs, 3_000).collect(), 3_000)


def test_copies_of_one_row_split(spark):
    df = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("x" * 100).alias("text"))
    rows = S.shards(df, LIMIT).collect()
    assert len(rows) == 4000
    assert len(check(rows, LIMIT)) >= 20


def test_copies_are_dealt_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "COPIES", 100)
    text = F.when(F.col("id") < 1950, "x" * 100).otherwise(F.concat(F.lit("y"), (F.col("id") % 7).cast("string")))
    df = spark.range(2050).select(F.lit(1).cast("long").alias("doc_id"), text.alias("text"))
    rows = S._rows(df).groupBy("doc_id", "h1", "n_bytes").agg(F.count(F.lit(1)).alias("n"))
    placed = S._placed(rows)
    assert placed.count() == 2050 and placed.select("h1", "h2").distinct().count() == 2050
    per = placed.where("n = 1950").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(per) > 1
    assert len(check(S.shards(df, LIMIT).collect(), LIMIT)) >= 10


def test_rows_keep_all_columns(spark):
    docs = edge_docs(spark)
    out = S.sharded_rows(docs, LIMIT)
    assert out.columns == [*docs.columns, "shard_id"]
    assert out.drop("shard_id").exceptAll(docs).count() == 0 and out.count() == docs.count()
    per = {r["shard_id"]: r["b"] for r in out.groupBy("shard_id").agg(
        F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b")).collect()}
    assert all(b <= LIMIT or name.startswith("128") for name, b in per.items())


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    S.write_shards(docs, str(tmp_path / "out"), 100_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.drop("shard_id").exceptAll(docs).count() == 0 and back.count() == docs.count()
    assert all(len(list(p.glob("*.parquet"))) == 1 for p in (tmp_path / "out").glob("shard_id=*"))


def test_directory(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = S.directory(S.shards(docs, 50_000)).collect()
    top = max(r["depth"] for r in rows if r["depth"] < S.BITS)
    assert sum(r["slots"] or 0 for r in rows) == 2 ** top
    assert sum(r["n_rows"] for r in rows) == docs.count()


def test_edge_rows(spark):
    docs = edge_docs(spark)
    rows = S.shards(docs, LIMIT).collect()
    assert len(rows) == docs.count()
    check(rows, LIMIT)
    assert {r["n_bytes"] for r in rows if r["doc_id"] in (0, 1)} == {0}


def test_empty_table(spark):
    assert S.shards(empty_docs(spark)).count() == 0
