"""Named queries that write the text files of the stages and read them back, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinseg.plans import adapters as ad
from kinseg.plans.catalog import query
from kinseg.sources import bam, tables
from kinseg.sources.scratch import folder


@query(f'WITH {ad.WINDOWS} SELECT chrom, start, "end", rd0, rd1, rd2, gc, mappability FROM windows')
def window_file(spark, sf_dir):
    path = folder(spark, "windows")
    w = ad.windows(spark, sf_dir).select("chrom", "start", "end", F.col("rd0").alias("father"), F.col("rd1").alias("mother"), F.col("rd2").alias("child"), "gc", "mappability")
    tables.write_tsv(w, path, header=True)
    return tables.read_depth(spark, path)[0]


@query("SELECT 's' || (l_linenumber % 3) AS sample, trunc(sum(l_quantity) / count(*))::INT AS median, trunc(max(l_quantity) / 7.0)::INT AS mad FROM lineitem GROUP BY 1")
def parameter_file(spark, sf_dir):
    path = folder(spark, "parameters")
    li = ad.load(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("s"), F.col("l_linenumber") % 3).alias("sample"))
    tables.write_tsv(li.agg((F.sum("l_quantity") / F.count("*")).cast("double").alias("median"), (F.max("l_quantity") / 7.0).cast("double").alias("mad")), path)
    return tables.parameters(spark, path)


@query(f"WITH {ad.PAIRS} SELECT 's' || sample_idx AS sample, chrom, left_first, right_first, left_second, right_second, CASE left_first % 2 WHEN 0 THEN 'DELETION' ELSE 'DUPLICATION' END AS sv_type FROM pairs")
def pair_files(spark, sf_dir):
    path = folder(spark, "pairs")
    kind = F.when(F.col("left_first") % 2 == 0, "DELETION").otherwise("DUPLICATION")
    p = ad.pairs(spark, sf_dir).select(F.concat(F.lit("s"), "sample_idx").alias("sample"), "chrom", "left_first", "right_first", "left_second", "right_second", kind.alias("sv_type"))
    tables.write_pairs(p, path)
    return tables.read_pairs(spark, path)


@query(f"WITH {ad.SIGNAL} SELECT chrom, start0, end0, value FROM signal")
def signal_file(spark, sf_dir):
    path = folder(spark, "signal")
    tables.write_tsv(ad.signal(spark, sf_dir), path)
    return tables.signal(spark, path)


@query(f'WITH {ad.REGIONS} SELECT chrom, start, "end" FROM regions')
def interval_file(spark, sf_dir):
    path = folder(spark, "intervals")
    tables.write_tsv(ad.regions(spark, sf_dir), path)
    return tables.intervals(spark, path)


#: Bytes of a file that a task reads.
PART = 4 << 20
BINARY = f"""{ad.ALIGNMENTS}, binary_ AS (SELECT qname, flag, chrom, (chrom::INT - 1)::INT AS ref_idx, start, start + CASE cigar WHEN '100M' THEN 99 ELSE 69 END AS "end", mapq, cigar, mate_start, tlen, md5(qname || start) AS letters, ord FROM alignments)"""


def binary_reads(spark, sf_dir):
    """Line items as alignments with letters and tags, sorted by place, as binary files, as many as their size asks for."""
    letters = F.translate(F.md5(F.concat("qname", "start")), "0123456789abcdef", "ACGTACGTACGTACGT")
    rows = ad.alignments(spark, sf_dir).select("qname", "flag", "chrom", "start", "mapq", "cigar", "mate_ref_idx", "mate_start", "tlen", letters.alias("seq"), F.rpad(F.lit("I"), 32, "F#").alias("qual"), F.create_map(F.lit("XO"), F.col("ord").cast("string")).alias("tags"))
    return rows.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start")


def binary_file(spark, sf_dir) -> str:
    path = folder(spark, "reads")
    bam.write_bam(binary_reads(spark, sf_dir), path, [(str(i), 1 << 29) for i in range(1, 6)], "s")
    return path


@query(f"""WITH {BINARY} SELECT qname, flag, chrom, ref_idx, start, "end", mapq, cigar, mate_start, tlen, translate(letters, '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq, rpad('I', 32, 'F#') AS qual, ord::VARCHAR AS tag FROM binary_""")
def bam_file(spark, sf_dir):
    """Written by tasks and read in parts."""
    found = bam.read_bam(spark, binary_file(spark, sf_dir), split=PART)
    return found.select("qname", "flag", "chrom", "ref_idx", "start", "end", "mapq", "cigar", "mate_start", "tlen", "seq", "qual", F.element_at("tags", "XO").alias("tag"))


@query(f"""WITH {BINARY}, w AS (SELECT (o_orderkey % 5)::INT AS ref_idx, o_custkey * 700 AS lo, o_custkey * 700 + o_orderkey % 400 AS hi FROM orders WHERE o_orderstatus = 'P')
SELECT DISTINCT qname, flag, chrom, start, ord::VARCHAR AS tag FROM binary_ b WHERE EXISTS (SELECT 1 FROM w WHERE w.ref_idx = b.ref_idx AND b.start <= w.hi AND w.lo <= b."end")""")
def indexed_file(spark, sf_dir):
    """Reads of the places of some orders by way of the index."""
    path = binary_file(spark, sf_dir)
    where = folder(spark, "index")
    bam.build_index(bam.read_places(spark, path, split=PART)).write.parquet(where)
    o = ad.load(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    low = F.col("o_custkey") * 700
    windows = o.select((F.col("o_orderkey") % 5).cast("int").alias("ref_idx"), low.cast("int").alias("start"), (low + F.col("o_orderkey") % 400).cast("int").alias("end"))
    return bam.indexed_reads(spark, path, spark.read.parquet(where), windows).select("qname", "flag", "chrom", "start", F.element_at("tags", "XO").alias("tag"))


CALL_COLUMNS = ("chrom", "start", "end", "type0", "type1", "type2")


@query(f"""WITH {ad.calls_sql('c', 0)} SELECT chrom, start, "end", type0, type1, type2, call_id / 2.0::DOUBLE AS score, 'RD' AS evidence FROM c""")
def call_file(spark, sf_dir):
    path = folder(spark, "calls")
    tables.write_tsv(ad.calls(spark, sf_dir, 0).select(*CALL_COLUMNS, (F.col("call_id") / 2.0).alias("score"), F.lit("RD").alias("evidence")), path)
    return tables.calls(spark, path)


@query(f"""WITH {ad.calls_sql('c', 0)} SELECT chrom, start, "end", type0, type1, type2, 'RD:RP' AS evidence FROM c""")
def final_file(spark, sf_dir):
    """The final table with its header of sample names."""
    path = folder(spark, "final")
    tables.write_calls(ad.calls(spark, sf_dir, 0).select(*CALL_COLUMNS, F.lit("RD:RP").alias("evidence")), path, ["father", "mother", "child"])
    return tables.final_calls(spark, path)
