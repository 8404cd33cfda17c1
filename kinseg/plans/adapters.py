"""Deterministic views of the supplied tables as reads, windows, pairs, calls and signals, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3600
EPOCH = 1704067200
MEDIAN, MAD = 60, 10


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as aligned reads: type is the contig, second since 2024 the place."""
    e = load(spark, sf_dir, "events")
    flag = F.when(F.col("event_id") % 17 == 0, 1024).when(F.col("event_id") % 19 == 0, 4).when(F.col("event_id") % 23 == 0, 256).otherwise(0)
    return e.select(
        (F.col("user_id") % 3).cast("int").alias("sample_idx"),
        F.col("event_type").alias("chrom"),
        (F.unix_timestamp("ts") - EPOCH + 1).alias("start"),
        F.least(F.floor(F.abs("value")), F.lit(60)).cast("int").alias("mapq"),
        flag.alias("flag"),
    )


READS = f"""reads AS (
  SELECT user_id % 3 AS sample_idx, event_type AS chrom, floor(epoch(ts))::BIGINT - {EPOCH} + 1 AS start,
    least(floor(abs(value)), 60)::INT AS mapq,
    CASE WHEN event_id % 17 = 0 THEN 1024 WHEN event_id % 19 = 0 THEN 4 WHEN event_id % 23 = 0 THEN 256 ELSE 0 END AS flag
  FROM events)"""

WINDOWS = f"""{READS}, counts AS (
  SELECT chrom, (start - 1) // {HOUR} AS bin, count(*) FILTER (sample_idx = 0) AS rd0, count(*) FILTER (sample_idx = 1) AS rd1, count(*) FILTER (sample_idx = 2) AS rd2
  FROM reads WHERE flag = 0 AND mapq >= 1 GROUP BY ALL
), bounds AS (SELECT chrom, min(bin) AS lo, max(bin) - 1 AS hi FROM counts GROUP BY chrom HAVING max(bin) > min(bin)
), windows AS (
  SELECT b.chrom, b.bin, b.bin * {HOUR} + 1 AS start, (b.bin + 1) * {HOUR} AS "end", coalesce(rd0, 0) AS rd0, coalesce(rd1, 0) AS rd1, coalesce(rd2, 0) AS rd2,
    30 + b.bin % 41 AS gc, (b.bin % 10) / 10.0::DOUBLE AS mappability
  FROM (SELECT chrom, unnest(generate_series(lo, hi)) AS bin FROM bounds) b LEFT JOIN counts c ON b.chrom = c.chrom AND b.bin = c.bin)"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly depth windows with a GC content and a mappability from the bin's number."""
    from kinseg.operators.depth import depth_windows

    w = depth_windows(reads(spark, sf_dir), HOUR, 1, contigs=None)
    return w.withColumn("gc", (30 + F.col("bin") % 41).cast("int")).withColumn("mappability", (F.col("bin") % 10) / 10.0)


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as alignments of 100 bases with mates, strands from the return flag."""
    li = load(spark, sf_dir, "lineitem")
    start = (F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).cast("int")
    tlen = (200 + F.col("l_quantity") * 4 + F.col("l_partkey") % 50).cast("int")
    strand = F.when(F.col("l_returnflag") == "N", 32).when(F.col("l_returnflag") == "A", 16).otherwise(0)
    flag = F.lit(1) + F.when(F.col("l_linenumber") % 2 == 1, 64).otherwise(0) + strand + F.when(F.col("l_suppkey") % 31 == 0, 1024).otherwise(0)
    rows = li.select(
        F.concat(F.lit("s"), F.col("l_linenumber") % 3).alias("sample"),
        (F.col("l_linenumber") % 3).cast("int").alias("sample_idx"),
        (F.col("l_linenumber") % 3).cast("int").alias("bam_ord"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        F.concat(F.lit("q"), F.col("l_orderkey")).alias("qname"),
        flag.alias("flag"),
        (1 + F.col("l_orderkey") % 5).cast("string").alias("chrom"),
        (F.col("l_orderkey") % 5).cast("int").alias("ref_idx"),
        start.alias("start"),
        (start + 99).alias("end"),
        (F.col("l_linenumber") * 10 % 60).cast("int").alias("mapq"),
        F.when(F.col("l_linestatus") == "O", F.when(F.col("l_suppkey") % 2 == 0, "30S70M").otherwise("70M30S")).otherwise("100M").alias("cigar"),
        (F.col("l_orderkey") % 5).cast("int").alias("mate_ref_idx"),
        (start + tlen - 100).alias("mate_start"),
        tlen.alias("tlen"),
        F.lit(None).cast("map<string,string>").alias("tags"),
    )
    return rows


ALIGNMENTS = """alignments AS (
  SELECT *, start + 99 AS "end", start + tlen - 100 AS mate_start,
    CASE WHEN flag & 16 = 16 THEN CASE WHEN start + tlen - 100 < start + 99 THEN 'FR' ELSE 'RF' END
         WHEN flag & 32 = 32 THEN CASE WHEN start < start + tlen THEN 'FR' ELSE 'RF' END ELSE 'TANDEM' END AS facing
  FROM (SELECT 's' || (l_linenumber % 3) AS sample, l_linenumber % 3 AS sample_idx, l_orderkey * 10 + l_linenumber AS ord, 'q' || l_orderkey AS qname,
    1 + CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 0 END + CASE l_returnflag WHEN 'N' THEN 32 WHEN 'A' THEN 16 ELSE 0 END + CASE WHEN l_suppkey % 31 = 0 THEN 1024 ELSE 0 END AS flag,
    (1 + l_orderkey % 5)::VARCHAR AS chrom, (l_partkey * 100 + l_suppkey % 100)::INT AS start, (l_linenumber * 10) % 60 AS mapq,
    trunc(200 + l_quantity * 4 + l_partkey % 50)::INT AS tlen,
    CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_suppkey % 2 = 0 THEN '30S70M' ELSE '70M30S' END ELSE '100M' END AS cigar
  FROM lineitem))"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as discordant pairs, close together within an order."""
    li = load(spark, sf_dir, "lineitem")
    first = F.col("l_orderkey") * 1000 + F.col("l_partkey") % 7 * 20
    second = first + 99 + 300 + F.col("l_quantity").cast("int") * 4
    return li.select(
        (F.col("l_linenumber") % 3).cast("int").alias("sample_idx"),
        (F.col("l_orderkey") % 5).cast("string").alias("chrom"),
        F.lit("DELETION").alias("sv_type"),
        first.alias("left_first"),
        (first + 99).alias("right_first"),
        second.alias("left_second"),
        (second + 99).alias("right_second"),
    )


PAIRS = """pairs AS (
  SELECT l_linenumber % 3 AS sample_idx, (l_orderkey % 5)::VARCHAR AS chrom, first AS left_first, first + 99 AS right_first, first + 399 + l_quantity::INT * 4 AS left_second, first + 498 + l_quantity::INT * 4 AS right_second
  FROM (SELECT *, l_orderkey * 1000 + l_partkey % 7 * 20 AS first FROM lineitem))"""


def typed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs(), those of one contig in five as duplications."""
    return pairs(spark, sf_dir).withColumn("sv_type", F.when(F.col("chrom") == "3", "DUPLICATION").otherwise("DELETION"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as excluded regions of 1 to 400 bases."""
    o = load(spark, sf_dir, "orders")
    start = F.col("o_orderkey") * 1000 + F.col("o_custkey") % 600
    return o.select((F.col("o_orderkey") % 5).cast("string").alias("chrom"), start.alias("start"), (start + F.col("o_custkey") % 400).alias("end"))


REGIONS = """regions AS (
  SELECT (o_orderkey % 5)::VARCHAR AS chrom, o_orderkey * 1000 + o_custkey % 600 AS start, o_orderkey * 1000 + o_custkey % 600 + o_custkey % 400 AS "end" FROM orders)"""


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a signal: 100 bases each, value by size."""
    p = load(spark, sf_dir, "part")
    return p.select(F.lit("1").alias("chrom"), (F.col("p_partkey") * 100).alias("start0"), (F.col("p_partkey") * 100 + 100).alias("end0"), (F.col("p_size") / 50.0).alias("value"))


SIGNAL = "signal AS (SELECT '1' AS chrom, p_partkey * 100 AS start0, p_partkey * 100 + 100 AS end0, p_size / 50.0::DOUBLE AS value FROM part)"


def calls(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    """Parts as calls along three contigs; lengths differ by size. Side 1 holds a call beside each of side 0, shifted by its size."""
    p = load(spark, sf_dir, "part")
    start = F.col("p_partkey") * 300 + F.col("p_size") * (10 * side)
    kinds = F.array(F.lit("DELETION"), F.lit("REFERENCE"), F.lit("DUPLICATION"))
    types = [F.element_at(kinds, (1 + (F.col("p_partkey") + i * F.col("p_size")) % 3).cast("int")).alias(f"type{i}") for i in range(3)]
    return p.select((F.col("p_partkey") * 2 + side).alias("call_id"), (1 + F.col("p_partkey").cast("long") / 2 % 3).cast("int").cast("string").alias("chrom"), start.alias("start"), (start + 200 + F.col("p_size") * 20).alias("end"), *types)


def calls_sql(name: str, side: int) -> str:
    kind = lambda i: f"['DELETION', 'REFERENCE', 'DUPLICATION'][1 + (p_partkey + {i} * p_size) % 3] AS type{i}"
    return f"""{name} AS (SELECT p_partkey * 2 + {side} AS call_id, trunc(1 + (p_partkey / 2) % 3)::INT::VARCHAR AS chrom, p_partkey * 300 + p_size * {10 * side} AS start, p_partkey * 300 + p_size * {10 * side} + 200 + p_size * 20 AS "end",
  {kind(0)}, {kind(1)}, {kind(2)} FROM part)"""


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with copy numbers from their depths: a stand-in for decoded paths."""
    w = windows(spark, sf_dir)
    return w.select("chrom", F.lit(0).cast("long").alias("contig"), "start", "end", *((F.col(f"rd{i}") / 2 % 5).cast("int").alias(f"s{i}") for i in range(3)))


STATES = f"""{WINDOWS}, states AS (SELECT chrom, 0::BIGINT AS contig, start, "end", trunc((rd0 / 2) % 5)::INT AS s0, trunc((rd1 / 2) % 5)::INT AS s1, trunc((rd2 / 2) % 5)::INT AS s2 FROM windows)"""
