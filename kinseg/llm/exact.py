"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Native: every step is a DataFrame expression, no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinseg.llm.shared import folded, whole, written

PREFIX_CHARS = 64
#: Keys of 16 bytes each; up to so many are sent to every executor, more are joined by a shuffle.
BROADCAST_KEYS = 400_000


def _length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def _prefix(text: Column, chars: int) -> Column:
    return F.xxhash64(folded(F.substring(text, 1, chars)))


def full_hash(text: Column) -> Column:
    """SHA-256 of the normalised text (A-Z lowered), lower-case hex."""
    return F.sha2(folded(text).cast("binary"), 256)


def within(docs: DataFrame, keys: DataFrame, on: list[str], broadcast_keys: int) -> DataFrame:
    """The rows of docs whose columns `on` are in keys, which go to the executors whole up to broadcast_keys of them."""
    return docs.join(F.broadcast(keys) if keys.count() <= broadcast_keys else keys, on, "left_semi")


def surviving_keys(docs: DataFrame, prefix_chars: int = PREFIX_CHARS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(len, prefix) of the groups that may hold equal texts.

    First the lengths that occur twice; then, for texts of these lengths alone,
    the prefix hashes that occur twice within a length. Both counts combine on the
    map side, so a hot length or prefix sends one row per task; where lengths are
    too many to broadcast, only the first prefix_chars of a text move. Lowering
    A-Z keeps the length, so lengths need no folding.
    """
    sized = docs.select(_length(whole("text")).alias("len"), F.substring(whole("text"), 1, prefix_chars).alias("head"))
    lengths = written(sized.groupBy("len").agg(F.count("*").alias("n")).filter("n > 1").select("len"), "exact-lengths")
    kept = within(sized, lengths, ["len"], broadcast_keys)
    return kept.groupBy("len", _prefix(F.col("head"), prefix_chars).alias("prefix")).agg(F.count("*").alias("n")).filter("n > 1").select("len", "prefix")


def refine(docs: DataFrame, prefix_chars: int = PREFIX_CHARS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """docs with `candidate` (a member of a surviving group) and `full_hash` (null for the rest).

    The full text is hashed for surviving groups only. The surviving keys are
    counted: up to broadcast_keys of them go to the executors whole, so that no
    text is shuffled; beyond that the join shuffles by key, and Spark splits hot keys.
    """
    keys = written(surviving_keys(docs, prefix_chars, broadcast_keys), "exact-keys").select(F.col("len").alias("_len"), F.col("prefix").alias("_prefix"), F.lit(True).alias("_hit"))
    if keys.count() <= broadcast_keys:
        keys = F.broadcast(keys)
    text = whole(docs["text"])
    on = (_length(text) == keys["_len"]) & (_prefix(text, prefix_chars) == keys["_prefix"])
    joined = docs.join(keys, on, "left")
    candidate = keys["_hit"].isNotNull()
    return joined.select(*(docs[c] for c in docs.columns), candidate.alias("candidate"), F.when(candidate, full_hash(text)).alias("full_hash"))


def groups(rows: DataFrame) -> DataFrame:
    """full_hash, group_size and the row to keep (`winner`: largest doc_id, then largest row number) of refined rows with `row`."""
    return rows.filter("full_hash is not null").groupBy("full_hash").agg(F.count("*").alias("group_size"), F.max(F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("order"), "doc_id", "row")).alias("winner"))


def exact_groups(docs: DataFrame, **limits) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, full_hash (null outside surviving groups), text_sha256.

    Equal means identical after lowering A-Z. The row with the largest doc_id
    stays; of rows that repeat a doc_id and text, one stays. A null text is empty,
    a null doc_id counts as the smallest. An empty table gives no rows. Other
    columns of docs are ignored whatever their names.
    """
    slim = docs.select("doc_id", "text")
    refined = refine(slim, **limits)
    rows = written(
        refined.select("doc_id", "full_hash", F.coalesce("full_hash", full_hash(whole("text"))).alias("text_sha256"), F.monotonically_increasing_id().alias("row")),
        "exact-rows",
    )
    # Rows without a full hash stay out of the join, where their nulls would meet in one
    # task; the groups are written first, so that Spark can split a hot text's rows.
    alone = rows.filter("full_hash is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "full_hash", "text_sha256")
    found = written(groups(rows), "exact-groups")
    kept = F.col("winner.row") == F.col("row")
    shared = rows.filter("full_hash is not null").join(found, "full_hash")
    return alone.unionByName(shared.select("doc_id", F.col("winner.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "full_hash", "text_sha256"))


def drop_exact(docs: DataFrame, **limits) -> DataFrame:
    """docs with one row of each set of equal texts, all columns as they came.

    Rows outside surviving groups pass without a shuffle; of the others each task
    first keeps its own best row per text, so a hot text moves once per task. The
    row with the largest doc_id stays, a null id before all others only; null and
    empty texts are equal; of rows that tie, one stays. Empty in, empty out.
    """
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    key, text = f"c{columns.index('doc_id')}", f"c{columns.index('text')}"
    refined = refine(plain.withColumn("text", F.col(text)), **limits)
    single = refined.filter("full_hash is null").select(*plain.columns)
    best = (
        refined.filter("full_hash is not null")
        .groupBy("full_hash")
        .agg(F.max_by(F.struct(*plain.columns), F.struct(F.coalesce(F.col(key), F.lit(-(2**63))), F.md5(whole(text)))).alias("best"))
        .select("best.*")
    )
    return single.unionByName(best).toDF(*columns)
