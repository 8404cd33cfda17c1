"""Contigs of the reads of each call, by a graph of k-mers held in tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinseg.operators.relops import Rows, per_group

K, LEAST = 31, 2


def solid_kmers(reads: DataFrame, k: int = K, least: int = LEAST) -> DataFrame:
    """(call_id, kmer, n): k-mers that occur `least` times or more in the reads (call_id, seq) of a call; errors of single reads do not. None holds an N."""
    seq = F.upper("seq")
    each = F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda i: F.substring(seq, i, k))
    kmers = reads.filter(F.length("seq") >= k).select("call_id", F.explode(each).alias("kmer")).filter(~F.col("kmer").contains("N"))
    return kmers.groupBy("call_id", "kmer").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def links(kmers: DataFrame, k: int = K) -> DataFrame:
    """(call_id, kmer, next): at each overlap of k - 1 letters, the commonest k-mer that ends with it and the commonest that begins with it.

    Where reads disagree the rarer branch loses its link, at both ends of a bubble and at the
    root of a tip, and is left as a short piece. Equals are told apart by their letters.
    """
    commonest = F.min_by("kmer", F.struct(-F.col("n"), "kmer"))
    into = kmers.groupBy("call_id", F.substring("kmer", 2, k - 1).alias("joint")).agg(commonest.alias("kmer"))
    out = kmers.groupBy("call_id", F.substring("kmer", 1, k - 1).alias("joint")).agg(commonest.alias("next"))
    # Sizes are guessed from the reads, not from their k-mers, so without the hint a table of k-mers would be sent whole to all.
    return into.hint("merge").join(out, ["call_id", "joint"]).select("call_id", "kmer", "next")


def walked(rows: Rows) -> Iterator[tuple]:
    """(call_id, contig, seq, kmers, depth) of one call's k-mers and links, longest contigs first; a ring begins at its smallest k-mer."""
    after = {a: b for a, b in zip(rows["kmer"], rows["next"]) if b is not None}
    depth = dict(zip(rows["kmer"], rows["n"].tolist()))
    inner = set(after.values())
    left, found = set(depth), []
    for start in [*(x for x in depth if x not in inner), *sorted(inner)]:
        at, letters, total, n = start, [], 0, 0
        while at in left:
            left.discard(at)
            letters.append(at[-1] if letters else at)
            total, n = total + depth[at], n + 1
            at = after.get(at)
        if letters:
            found.append(("".join(letters), n, total / n))
    for contig, row in enumerate(sorted(found, key=lambda x: (-len(x[0]), x[0]))):
        yield rows["call_id"][0], contig, *row


def contigs(reads: DataFrame, k: int = K, least: int = LEAST, shortest: int | None = None) -> DataFrame:
    """call_id, contig (0: the longest), seq, kmers, depth (mean times its k-mers occur): contigs of `shortest` letters, 2 k if not given, or more.

    Counting and choosing links are joins and groupings over all calls at once; only the walk along the links
    takes one call's solid k-mers together, a few for each letter of its windows. Reads lie on one strand, as alignment files hold them.
    """
    kmers = solid_kmers(reads, k, least)
    rows = kmers.hint("merge").join(links(kmers, k), ["call_id", "kmer"], "left").select("call_id", "kmer", "n", "next")
    call = dict(reads.dtypes)["call_id"]
    found = per_group(rows, ["call_id"], ["kmer"], walked, f"call_id {call}, contig int, seq string, kmers int, depth double")
    return found.filter(F.length("seq") >= (2 * k if shortest is None else shortest))
