"""Readers and writers of the text files that stages exchange."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinseg import schemas
from kinseg.functions.alignments import end_position

REFERENCE_CHUNK = 100_000


def _tsv(spark: SparkSession, path, schema: str, header: bool = False) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema, header=header, comment="#", mode="FAILFAST")


def pedigree(spark: SparkSession, path: str) -> DataFrame:
    """PED rows; fields are split at tabs, spaces and quotes. A blank line ends nothing here: such lines are skipped."""
    names = [f.split() for f in schemas.PED.split(", ")]
    words = F.filter(F.split("value", r'[\t "]+'), lambda w: w != "")
    rows = spark.read.text(path).select(words.alias("w")).filter(F.size("w") >= len(names))
    return rows.select(*(F.col("w")[i].cast(kind).alias(name) for i, (name, kind) in enumerate(names)))


def trios(ped: DataFrame) -> DataFrame:
    """family_id, father, mother, offspring, offspring_sex of families with a founder of either sex and a child of both; whatever the order of rows."""
    founder = (F.col("paternal_id") == "0") & (F.col("maternal_id") == "0")
    child = (F.col("paternal_id") != "0") & (F.col("maternal_id") != "0")
    pick = lambda test, col="individual_id": F.min(F.when(test, F.col(col)))
    found = ped.groupBy("family_id").agg(pick(founder & (F.col("sex") == 1)).alias("father"), pick(founder & (F.col("sex") == 2)).alias("mother"), pick(child).alias("offspring"), pick(child, "sex").alias("offspring_sex"))
    return found.filter("father is not null and mother is not null and offspring is not null")


def intervals(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, schemas.INTERVALS)


def parameters(spark: SparkSession, path: str) -> DataFrame:
    """Insert-size median and MAD per sample, cut to whole numbers."""
    rows = _tsv(spark, path, schemas.PARAMETERS)
    return rows.select("sample", F.col("median").cast("int").alias("median"), F.col("mad").cast("int").alias("mad"))


def read_depth(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The window table and the three sample names of its header."""
    names = spark.read.csv(path, sep="\t", header=True).columns[3:6]
    return _tsv(spark, path, schemas.READ_DEPTH, header=True), names


def read_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of all files, or folders of files, of a folder, typed by the suffix .DEL or .DUP of their names; none without such files."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.{{DEL,DUP}}")
    if not glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob):
        return spark.createDataFrame([], f"{schemas.PAIRS}, sv_type string")
    rows = spark.read.csv(f"{folder}/*.{{DEL,DUP}}", sep="\t", schema=schemas.PAIRS, mode="FAILFAST").withColumn("_file", F.col("_metadata.file_path"))
    kind = F.when(F.col("_file").rlike(r"\.DEL(/[^/]*)?$"), "DELETION").otherwise("DUPLICATION")
    return rows.withColumn("sv_type", kind).drop("_file")


def calls(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, schemas.CALLS)


def final_calls(spark: SparkSession, path: str) -> DataFrame:
    """The table that write_calls() leaves."""
    return _tsv(spark, path, schemas.FINAL)


def signal(spark: SparkSession, path: str) -> DataFrame:
    """A bedGraph file: chrom, 0-based start, exclusive end, value."""
    return _tsv(spark, path, schemas.SIGNAL)


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines in file order with the number of heads (segment) and of bases before them since the block began or the last head."""
    block, segment, offset = None, 0, 0
    for batch in batches:
        for key, lines in batch.groupby(["file", "block"], sort=False):
            if key != block:
                block, segment, offset = key, 0, 0
            head = lines["value"].str.startswith(">")
            bases = lines["value"].str.replace(r"\s+", "", regex=True).mask(head, "")
            after = bases.str.len().cumsum() + offset
            since = after.where(head).ffill().fillna(0).astype("int64")
            numbers = segment + head.cumsum()
            name = lines["value"].str.extract(r"^>\s*(\S+)", expand=False)
            yield pd.DataFrame({"file": key[0], "block": key[1], "segment": numbers, "name": name, "offset": after - bases.str.len() - since, "bases": bases})
            segment, offset = int(numbers.iloc[-1]), int(after.iloc[-1] - since.iloc[-1])


def fasta(spark: SparkSession, path: str, chunk: int = REFERENCE_CHUNK) -> DataFrame:
    """Contigs of FASTA files in chunks (chrom, chunk_start, bases), each of the whole lines that begin within `chunk` bases.

    Lines keep their place by the block of the file they were read with. Where a contig
    goes on from block to block, sums per block and contig, a small table, tell what lies before; so no
    task holds more than a block or a chunk. The head is the name up to the first space.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    found = lines.mapInPandas(_numbered, "file string, block long, segment long, name string, offset long, bases string")
    sums = found.groupBy("file", "block", "segment").agg(F.max("name").alias("name"), F.sum(F.length("bases")).alias("n"))
    order = Window.partitionBy("file").orderBy("block", "segment")
    named = sums.withColumn("chrom", F.last("name", ignorenulls=True).over(order)).withColumn("contig", F.count("name").over(order))
    earlier = Window.partitionBy("file", "contig").orderBy("block", "segment").rowsBetween(Window.unboundedPreceding, -1)
    named = named.select("file", "block", "segment", "chrom", "contig", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = found.filter("bases <> ''").join(named.filter("chrom is not null"), ["file", "block", "segment"]).withColumn("at", F.col("before") + F.col("offset"))
    parts = placed.groupBy("file", "contig", "chrom", F.floor(F.col("at") / chunk).alias("part")).agg(F.sort_array(F.collect_list(F.struct("at", "bases"))).alias("lines"))
    return parts.select("chrom", (F.col("lines")[0]["at"] + 1).cast("int").alias("chunk_start"), F.array_join(F.transform("lines", lambda x: x["bases"]), "").alias("bases"))


def sam(spark: SparkSession, path: str, sample: str | None = None, bam_ord: int = 0) -> DataFrame:
    """Records of a SAM text file as READS. The sample is that of the first @RG line unless given; ord follows the file."""
    lines = spark.read.text(path)
    if sample is None:
        group = lines.filter(F.col("value").startswith("@RG")).select(F.regexp_extract("value", r"\tSM:([^\t]+)", 1).alias("s")).first()
        sample = group.s if group else ""
    heads = lines.filter(F.col("value").startswith("@SQ")).select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("chrom"), F.monotonically_increasing_id().alias("_i"))
    dictionary = heads.select("chrom", (F.row_number().over(Window.orderBy("_i")) - 1).alias("ref_idx"))
    # Null for lines of the header, as conditions on fields may be looked at before the filter.
    c = F.when(~F.col("value").startswith("@"), F.split("value", "\t"))
    rows = lines.filter(~F.col("value").startswith("@")).select(F.monotonically_increasing_id().alias("ord"), c.alias("c"))
    tags = F.map_from_entries(F.array_distinct(F.transform(F.slice("c", 12, F.size("c")), lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substring(t, 6, 1_000_000).alias("value")))))
    field = lambda i, kind="string": F.col("c")[i].cast(kind)
    flat = rows.select(F.lit(sample).alias("sample"), F.lit(bam_ord).alias("bam_ord"), "ord", field(0).alias("qname"), field(1, "int").alias("flag"), field(2).alias("chrom"), field(3, "int").alias("start"), field(4, "int").alias("mapq"), field(5).alias("cigar"), F.when(field(6) == "=", field(2)).otherwise(field(6)).alias("mate_chrom"), field(7, "int").alias("mate_start"), field(8, "int").alias("tlen"), field(9).alias("seq"), field(10).alias("qual"), tags.alias("tags"))
    flat = flat.withColumn("end", end_position().cast("int"))
    known = F.broadcast(dictionary)
    joined = flat.join(known, "chrom", "left").join(known.select(F.col("chrom").alias("mate_chrom"), F.col("ref_idx").alias("mate_ref_idx")), "mate_chrom", "left")
    return joined.select(*(f.split()[0] for f in schemas.READS.split(", ")))


def write_tsv(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=header)


def write_calls(df: DataFrame, path: str, names: list[str] | None = None) -> None:
    """Calls sorted by contig name, start and end, in one file, a table of thousands of rows; with the samples' names, below a header."""
    calls = df.select(*(f.split()[0] for f in schemas.FINAL.split(", "))).orderBy("chrom", "start", "end").coalesce(1)
    heads = ["#CHROM", "START", "END", *(names or ["FATHER", "MOTHER", "OFFSPRING"]), "Evidence"]
    # A comment sign of its own keeps the writer from quoting the head that begins with #.
    calls.toDF(*heads).write.mode("overwrite").option("comment", "~").csv(path, sep="\t", header=names is not None)


def write_pairs(df: DataFrame, path: str) -> None:
    """Pairs as text, a folder <contig>.DEL or <contig>.DUP each, sorted by place within their files."""
    suffix = F.when(F.col("sv_type") == "DELETION", ".DEL").otherwise(".DUP")
    rows = df.select(F.concat("chrom", suffix).alias("pairs"), *(f.split()[0] for f in schemas.PAIRS.split(", ")))
    ranged = rows.repartitionByRange("pairs", "left_first", "left_second").sortWithinPartitions("pairs", "left_first", "left_second")
    ranged.write.mode("overwrite").partitionBy("pairs").csv(path, sep="\t")
