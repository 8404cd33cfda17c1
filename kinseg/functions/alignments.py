"""Predicates and expressions on alignment records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: SAM flag bits, and the name patterns of contigs.
PAIRED, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECONDARY, DUPLICATE, SUPPLEMENTARY = 0x1, 0x4, 0x8, 0x10, 0x20, 0x40, 0x100, 0x400, 0x800
CONTIGS = r"^(chr)?([1-9]|1[0-9]|2[0-2]|[X|Y])$"
AUTOSOMES = r"^(chr)?([1-9]|1[0-9]|2[0-2])$"
MAX_MATE_DISTANCE = 10_000_000


def has(bits: int, flag: str | Column = "flag") -> Column:
    return (F.col(flag) if isinstance(flag, str) else flag).bitwiseAND(F.lit(bits)) != 0


def counted(min_mapq: int) -> Column:
    """Reads that count towards depth."""
    return ~has(SECONDARY | SUPPLEMENTARY | UNMAPPED | DUPLICATE) & (F.col("mapq") >= min_mapq)


def orientation() -> Column:
    """FR, RF or TANDEM from strands and 5' positions, as alignment libraries define it."""
    reverse, mate_reverse = has(REVERSE), has(MATE_REVERSE)
    positive = F.when(reverse, F.col("mate_start")).otherwise(F.col("start"))
    negative = F.when(reverse, F.col("end")).otherwise(F.col("start") + F.col("tlen"))
    return F.when(reverse == mate_reverse, "TANDEM").when(positive < negative, "FR").otherwise("RF")


def sizes_insert() -> Column:
    """First reads of unambiguous proper pairs, whose |tlen| is an insert size; secondary records are not excluded."""
    bad = UNMAPPED | MATE_UNMAPPED | DUPLICATE | SUPPLEMENTARY
    return has(PAIRED) & has(FIRST) & ~has(bad) & F.element_at("tags", "XA").isNull() & (orientation() == "FR")


def maybe_discordant() -> Column:
    """Primary mapped pairs on one contig, not too far apart."""
    bad = UNMAPPED | MATE_UNMAPPED | DUPLICATE | SECONDARY | SUPPLEMENTARY
    near = F.abs(F.col("mate_start") - F.col("start")) <= MAX_MATE_DISTANCE
    return has(PAIRED) & ~has(bad) & (F.col("ref_idx") == F.col("mate_ref_idx")) & near & (F.col("mapq") != 0)


def spans_deletion(median: str | Column, mad: str | Column, deviation: float) -> Column:
    """FR pairs further apart than median + deviation raw MADs."""
    limit = F.col(median) + F.col(mad) * deviation if isinstance(median, str) else median + mad * deviation
    return (orientation() == "FR") & (F.abs("tlen") > limit)


def spans_duplication() -> Column:
    return orientation() == "RF"


def left_clipped(cigar: str = "cigar", ops: str = "S") -> Column:
    return F.col(cigar).rlike(rf"^\d+[{ops}]")


def right_clipped(cigar: str = "cigar", ops: str = "S") -> Column:
    return F.col(cigar).rlike(rf"\d+[{ops}]$")


def soft_clip_evidence(side: Column) -> Column:
    """Clipped records that may show a breakpoint: mapped, paired, mate mapped, MAPQ above 0."""
    return side & has(PAIRED) & ~has(UNMAPPED | MATE_UNMAPPED) & (F.col("mapq") != 0)


def one_end_anchored() -> Column:
    """Exactly one of the mates is mapped."""
    return has(UNMAPPED) != has(MATE_UNMAPPED)


def end_position() -> Column:
    """Alignment end: start plus the reference-consuming CIGAR operations, minus one."""
    lengths = F.transform(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"), 1), lambda x: x.cast("int"))
    return F.col("start") + F.aggregate(lengths, F.lit(0), lambda a, b: a + b) - 1


def sv_type(state: Column) -> Column:
    return F.when(state < 2, "DELETION").when(state == 2, "REFERENCE").otherwise("DUPLICATION")


def with_chr(chrom: Column) -> Column:
    return F.when(chrom.startswith("chr"), chrom).otherwise(F.concat(F.lit("chr"), chrom))


def sex_letter(sex: Column) -> Column:
    return F.when(sex == 1, "M").when(sex == 2, "F").otherwise("N")


def state_name(state: Column) -> Column:
    return F.when(state < 2, "DEL").when(state == 2, "REF").otherwise("DUP")
