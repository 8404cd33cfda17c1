"""Named queries of assembly and split alignment, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinseg.operators import alignment, assembly
from kinseg.plans import adapters as ad
from kinseg.plans.catalog import query

K, LENGTH, STEP, PARTS = 20, 60, 7, 25


@query(f"""WITH RECURSIVE texts AS (SELECT p_partkey // {PARTS} AS call_id, string_agg(translate(upper(p_name), 'N', '*'), ' ' ORDER BY p_partkey) AS b FROM part GROUP BY 1),
cut AS (SELECT call_id, i, substr(b, 1 + {STEP} * i::INT, {LENGTH}) AS s FROM (SELECT call_id, b, unnest(generate_series(0, (length(b) - {LENGTH}) // {STEP})) AS i FROM texts WHERE length(b) >= {LENGTH})),
reads AS (SELECT call_id, CASE i % 5 WHEN 2 THEN left(s, 29) || '#' || substr(s, 31) ELSE s END AS s FROM cut),
k AS MATERIALIZED (SELECT call_id, substr(s, j::INT, {K}) AS kmer, count(*) AS n FROM (SELECT call_id, s, unnest(generate_series(1, {LENGTH} - {K} + 1)) AS j FROM reads) GROUP BY ALL HAVING count(*) >= 2),
l AS MATERIALIZED (SELECT a.call_id, a.kmer, b.kmer AS next FROM (SELECT call_id, substr(kmer, 2) AS joint, arg_min(kmer, (-n, kmer)) AS kmer FROM k GROUP BY ALL) a
  JOIN (SELECT call_id, left(kmer, {K} - 1) AS joint, arg_min(kmer, (-n, kmer)) AS kmer FROM k GROUP BY ALL) b USING (call_id, joint)),
walk AS (SELECT k.call_id, k.kmer AS start, k.kmer AS spot, k.kmer AS seq, 1::INT AS kmers, n FROM k LEFT JOIN l ON l.call_id = k.call_id AND l.next = k.kmer WHERE l.next IS NULL
  UNION ALL SELECT w.call_id, start, l.next, seq || right(l.next, 1), kmers + 1, w.n + k.n FROM walk w JOIN l ON l.call_id = w.call_id AND l.kmer = w.spot JOIN k ON k.call_id = w.call_id AND k.kmer = l.next),
rest AS MATERIALIZED (SELECT * FROM k WHERE (call_id, kmer) NOT IN (SELECT call_id, spot FROM walk)),
ring AS (SELECT call_id, kmer AS start, kmer AS spot, kmer AS seq, 1::INT AS kmers, n FROM rest
  UNION ALL SELECT w.call_id, start, l.next, seq || right(l.next, 1), kmers + 1, w.n + k.n FROM ring w JOIN l ON l.call_id = w.call_id AND l.kmer = w.spot AND l.next > start JOIN k ON k.call_id = w.call_id AND k.kmer = l.next),
whole AS (SELECT call_id, max_by(seq, kmers) AS seq, max(kmers) AS kmers, max_by(n, kmers) AS n FROM walk GROUP BY call_id, start
  UNION ALL SELECT w.call_id, seq, kmers, n FROM ring w JOIN l ON l.call_id = w.call_id AND l.kmer = w.spot AND l.next = start),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY call_id ORDER BY length(seq) DESC, seq) - 1)::INT AS contig FROM whole)
SELECT call_id, contig, seq, kmers, n / kmers AS depth FROM numbered WHERE length(seq) >= {2 * K}""")
def assembled_contigs(spark, sf_dir):
    """Names of 25 parts each, end to end, from reads of 60 letters every 7, some with a wrong letter; names repeat words, so the graph branches."""
    p = ad.load(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / PARTS).alias("call_id"), F.struct("p_partkey", F.translate(F.upper("p_name"), "N", "*").alias("b")).alias("p"))
    texts = p.groupBy("call_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda x: x["b"]), " ").alias("b")).filter(F.length("b") >= LENGTH)
    cut = texts.select("call_id", "b", F.explode(F.sequence(F.lit(0), F.floor((F.length("b") - LENGTH) / STEP).cast("int"))).alias("i"))
    seq = F.substring("b", 1 + STEP * F.col("i"), F.lit(LENGTH))
    reads = cut.select("call_id", F.when(F.col("i") % 5 == 2, F.overlay(seq, F.lit("#"), 30)).otherwise(seq).alias("seq"))
    return assembly.contigs(reads, K, 2)


#: Letters of a supplier's window and the two stretches, start and length, that its contig puts end to end.
LETTERS = 1280
HEAD, TAIL = {0: (101, 200), 1: (301, 90), 2: (801, 150)}, {0: (901, 150), 1: (391, 110), 2: (501, 180)}


def _by_kind(kind: str, of: dict, at: int) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN {k} THEN {v[at]}" for k, v in of.items()) + " END"


@query(f"""WITH c AS (SELECT s_suppkey AS call_id, s_suppkey % 3 AS kind, translate(string_agg(md5(s_suppkey || '-' || i), '' ORDER BY i), '0123456789abcdef', 'ACGTACGTACGTACGT') AS w
  FROM supplier, (SELECT unnest(generate_series(0, {LETTERS // 32 - 1})) AS i) GROUP BY ALL),
p AS (SELECT *, {_by_kind('kind', HEAD, 0)} AS a, {_by_kind('kind', HEAD, 1)} AS m, {_by_kind('kind', TAIL, 0)} AS b, {_by_kind('kind', TAIL, 1)} AS n FROM c),
x AS (SELECT *, unnest(generate_series(1, 30)) AS d FROM p WHERE kind <> 1),
y AS (SELECT call_id, d, sum(CASE WHEN substr(w, a + m + d::INT - 1, 1) = substr(w, b + d::INT - 1, 1) THEN 1 ELSE -4 END) OVER (PARTITION BY call_id ORDER BY d) AS on_,
  sum(CASE WHEN substr(w, b - d::INT, 1) = substr(w, a + m - d::INT, 1) THEN 1 ELSE -4 END) OVER (PARTITION BY call_id ORDER BY d) AS back FROM x),
z AS (SELECT call_id, coalesce(arg_min(d, (-on_, d)) FILTER (on_ > 0), 0) AS ahead, coalesce(max(on_) FILTER (on_ > 0), 0) AS won, coalesce(arg_min(d, (-back, d)) FILTER (back > 0), 0) AS behind, coalesce(max(back) FILTER (back > 0), 0) AS won2 FROM y GROUP BY call_id),
r AS (SELECT call_id, m + n AS size, m + won AS score, 0 AS q0, m + ahead AS q1, a AS start FROM p JOIN z USING (call_id)
  UNION ALL SELECT call_id, m + n, n + won2, m - behind, m + n, b - behind FROM p JOIN z USING (call_id) UNION ALL SELECT call_id, m + n, m + n - 5, 0, m + n, a FROM p WHERE kind = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY score DESC, q0) - 1 AS ord FROM r)
SELECT call_id, ord::INT AS ord, CASE ord WHEN 0 THEN 0 ELSE 2048 END AS flag, start::INT AS start, (start + q1 - q0 - 1)::INT AS "end", 60 AS mapq,
  CASE WHEN q0 > 0 THEN q0 || CASE ord WHEN 0 THEN 'S' ELSE 'H' END ELSE '' END || (q1 - q0) || 'M' || CASE WHEN q1 < size THEN (size - q1) || CASE ord WHEN 0 THEN 'S' ELSE 'H' END ELSE '' END AS cigar, score::INT AS score FROM o""")
def contig_alignments(spark, sf_dir):
    """A contig of each supplier over a deletion, a wrong letter or a duplication of the supplier's window, both made of digests."""
    c = ad.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("call_id"), (F.col("s_suppkey") % 3).alias("kind"))
    # Keys are few bytes beside the letters made of them, so they are dealt over all tasks first.
    c = c.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "call_id")
    digests = F.transform(F.sequence(F.lit(0), F.lit(LETTERS // 32 - 1)), lambda i: F.md5(F.concat(F.col("call_id"), F.lit("-"), i)))
    windows = c.withColumn("bases", F.translate(F.array_join(digests, ""), "0123456789abcdef", "ACGTACGTACGTACGT"))
    pick = lambda of, at: F.expr(_by_kind("kind", of, at))
    head, tail = (F.substring("bases", pick(of, 0), pick(of, 1)) for of in (HEAD, TAIL))
    contigs = windows.select("call_id", F.lit(0).alias("contig"), F.concat(head, tail).alias("seq"), "kind")
    wrong = F.translate(F.substring("seq", F.lit(100), F.lit(1)), "ACGT", "CGTA")
    contigs = contigs.withColumn("seq", F.when(F.col("kind") == 1, F.overlay("seq", wrong, 100)).otherwise(F.col("seq")))
    return alignment.split_alignments(contigs, windows).drop("contig")
