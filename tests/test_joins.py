"""Joins on keys of few values: whole results, and tasks that don't grow with a key."""

import duckdb
import pytest
from pyspark.sql import functions as F

from versewright import catalog
from versewright.functions import text as tx
from versewright.operators import joins

NAMES = ["blue ring", "Ёлка ring", "ёлка", "123 @~\x7f", "", None, "Aa", "ОКНО 7", "😀 x😀"]


@pytest.mark.parametrize("block", [1, 3, 2048])
def test_blocks_hold_every_pair_once(spark, block):
    left = spark.createDataFrame([(i, i % 4 if i < 12 else None) for i in range(15)] + [(1, 1)] + [(100 + i, 0) for i in range(20)], "a long, k long")
    right = spark.createDataFrame([(i, i % 5) for i in range(10)] + [(200 + i, 0) for i in range(20)] + [(300, None)], "b long, k long")
    found = joins.in_blocks(left, right, "k", block).select("a", "b", "k").collect()
    assert sorted(found) == sorted(left.join(right, "k").select("a", "b", "k").collect()) and len(found) > 400


def test_similarity_of_sets(spark):
    both = spark.createDataFrame([(a, b) for a in NAMES for b in NAMES], "a string, b string")
    x, y = (F.filter(F.array_distinct(F.split(F.upper(c), "")), lambda s: s != "") for c in "ab")
    plain = F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y)))
    common = tx.common_characters(tx.character_set("a"), tx.character_set("b"))
    for want, share, rounded in both.select(plain, tx.character_similarity("a", "b"), tx.rounded_share(*common, 6)).collect():
        assert share == want and rounded == (None if want is None else round(want, 6))


def test_shares_are_rounded_as_doubles_are(spark):
    shares = spark.range(0, 200).alias("p").join(spark.range(0, 200).alias("w"), F.expr("p.id <= w.id")).select(F.col("p.id").alias("p"), F.col("w.id").alias("w"))
    assert shares.where(~F.round(F.try_divide("p", "w"), 6).eqNullSafe(tx.rounded_share("p", "w", 6))).count() == 0


def test_char_jaccard_of_one_key_is_dealt_to_many_tasks(spark, tmp_path):
    part, supplier = str(tmp_path / "part.parquet"), str(tmp_path / "supplier.parquet")
    duckdb.sql(f"COPY (SELECT 50 * i AS p_partkey, 'part ' || i % 97 AS p_name FROM range(14550) t(i)) TO '{part}'")
    duckdb.sql(f"COPY (SELECT 50 * i AS s_suppkey, 'Supplier#' || i AS s_name FROM range(1000) t(i)) TO '{supplier}'")
    found = catalog.QUERIES["char_jaccard"](spark, str(tmp_path))
    tasks = found.groupBy(F.spark_partition_id()).agg(F.count("*"), F.sum(F.round(F.col("similarity") * 1_000_000).cast("long"))).collect()
    con = duckdb.connect()  # sees each of the 97 names once
    con.execute(f"CREATE VIEW part AS FROM '{part}' WHERE p_partkey < 50 * 97; CREATE VIEW supplier AS FROM '{supplier}'")
    want = con.execute(f"SELECT 150 * count(*), 150 * sum(round(similarity * 1000000)::BIGINT) FROM ({catalog.ORACLE_SQL['char_jaccard']})").fetchone()
    assert (sum(t[1] for t in tasks), sum(t[2] for t in tasks)) == want
    assert len(tasks) > 1 and max(t[1] for t in tasks) < 0.9 * want[0]
