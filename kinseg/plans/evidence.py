"""Named queries over names of contigs, whole windows, decoding scores and supporting pairs, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinseg.functions import tensors
from kinseg.operators import depth, model, pairs, refine, segment
from kinseg.plans import adapters as ad
from kinseg.plans.catalog import DIGITS, EMISSION, GAMETES, HAPLOTYPES, _models, _parameters, query

#: Contigs with and without chr, and six that are none or no autosomes.
NAMES = [f"chr{i}" if i % 2 else str(i) for i in range(1, 23)] + ["X", "chrY", "MT", "GL1", "chr23", "x"]
NAME_SQL = f"{NAMES!r}[1 + user_id % {len(NAMES)}]"
WIDTH = 150


def named_reads(spark, sf_dir):
    """Events as reads on contigs by user, one base a minute."""
    e = ad.load(spark, sf_dir, "events").select("event_id", (1 + F.col("user_id") % len(NAMES)).cast("int").alias("n"), F.unix_timestamp("ts").alias("at"), "user_id")
    chrom = F.element_at(F.array(*map(F.lit, NAMES)), F.col("n"))
    return e.select((F.col("user_id") % 3).cast("int").alias("sample_idx"), chrom.alias("chrom"), (F.floor((F.col("at") - ad.EPOCH) / 60) + 1).alias("start"), F.lit(60).alias("mapq"), F.when(F.col("event_id") % 17 == 0, 1024).otherwise(0).alias("flag"))


NAMED = f"""named AS (SELECT user_id % 3 AS sample_idx, {NAME_SQL} AS chrom, (floor(epoch(ts))::BIGINT - {ad.EPOCH}) // 60 AS spot FROM events WHERE event_id % 17 <> 0),
counts AS (SELECT chrom, spot // {WIDTH} AS bin, count(*) FILTER (sample_idx = 0) AS rd0, count(*) FILTER (sample_idx = 1) AS rd1, count(*) FILTER (sample_idx = 2) AS rd2
  FROM named WHERE regexp_full_match(chrom, '(chr)?([1-9]|1[0-9]|2[0-2]|X|Y)') GROUP BY ALL),
bounds AS (SELECT chrom, min(bin) AS lo, max(bin) - 1 AS hi FROM counts GROUP BY chrom HAVING max(bin) > min(bin)),
filled AS (SELECT b.chrom, b.bin, b.bin * {WIDTH} + 1 AS start, (b.bin + 1) * {WIDTH} AS "end", coalesce(rd0, 0) AS rd0, coalesce(rd1, 0) AS rd1, coalesce(rd2, 0) AS rd2
  FROM (SELECT chrom, unnest(generate_series(lo, hi)) AS bin FROM bounds) b LEFT JOIN counts c ON b.chrom = c.chrom AND b.bin = c.bin)"""


@query(f'WITH {NAMED} SELECT chrom, start, "end", rd0, rd1, rd2 FROM filled')
def contig_names(spark, sf_dir):
    return depth.depth_windows(named_reads(spark, sf_dir), WIDTH).drop("bin")


@query(f"""WITH {NAMED}, bases AS (SELECT CASE p_partkey % 2 WHEN 0 THEN '2' ELSE 'chr1' END AS chrom, string_agg(rpad(upper(p_name), 30, 'ACGTN'), '' ORDER BY p_partkey) AS b FROM part GROUP BY 1),
cut AS (SELECT chrom, bin, substr(b, (bin * {WIDTH} + 2)::INT, {WIDTH}) AS x FROM (SELECT chrom, b, unnest(generate_series(0, length(b) // {WIDTH})) AS bin FROM bases)),
gc AS (SELECT chrom, bin, CASE WHEN length(x) - length(replace(x, 'N', '')) >= 10 THEN -1 ELSE 100 * (2 * length(x) - length(replace(x, 'G', '')) - length(replace(x, 'C', ''))) // length(x) END AS gc FROM cut WHERE length(x) > 0),
track AS (SELECT CASE p_partkey % 2 WHEN 0 THEN '2' ELSE '1' END AS name, (p_partkey - 1) // 2 * 40 AS spot, p_size / 50.0::DOUBLE AS value FROM part),
t AS (SELECT name, unnest(generate_series(spot // {WIDTH}, (spot + 39) // {WIDTH})) AS bin, spot, value FROM track),
m AS (SELECT name, bin, sum(value * (least(spot + 40, (bin + 1) * {WIDTH}) - greatest(spot, bin * {WIDTH}))) / {WIDTH} AS mean FROM t GROUP BY ALL),
mappable AS (SELECT name, bin, CASE WHEN bin < max(bin) OVER (PARTITION BY name) THEN mean ELSE 0 END AS mean FROM m)
SELECT f.chrom, f.start, f."end", rd0, rd1, rd2, coalesce(gc, -1)::INT AS gc, round(coalesce(mean, 0), {DIGITS}) AS mappability
FROM filled f LEFT JOIN gc ON gc.chrom = f.chrom AND gc.bin = f.bin LEFT JOIN mappable m ON m.name = replace(f.chrom, 'chr', '') AND m.bin = f.bin""")
def read_depth(spark, sf_dir):
    """The whole window table; two contigs have bases, from part names of 30 letters, and a signal that writes chr before both names."""
    p = ad.load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", (F.col("p_partkey") % 2 == 0).alias("even"), F.floor(F.col("p_partkey") / 1000).alias("range"))
    # A name lies behind those of smaller keys of its contig: of the ranges of keys before its own, a table of a row each, and within it.
    earlier = lambda keys, order, column: F.coalesce(F.sum(column).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = p.groupBy("even", "range").agg(F.count("*").alias("n")).select("even", "range", earlier(["even"], "range", F.col("n")).alias("before"))
    names = p.join(before, ["even", "range"]).withColumn("n", F.col("before") + earlier(["even", "range"], "p_partkey", F.lit(1)))
    reference = names.select(F.when(F.col("even"), "2").otherwise("chr1").alias("chrom"), (F.col("n") * 30 + 1).cast("int").alias("chunk_start"), F.rpad(F.upper("p_name"), 30, "ACGTN").alias("bases"))
    at = ((F.col("p_partkey") - 1) / 2).cast("long") * 40
    signal = p.select(F.when(F.col("even"), "chr2").otherwise("chr1").alias("chrom"), at.alias("start0"), (at + 40).alias("end0"), (F.col("p_size") / 50.0).alias("value"))
    return depth.read_depth(named_reads(spark, sf_dir), reference, signal, WIDTH).withColumn("mappability", F.round("mappability", DIGITS))


@query(f"""WITH {ad.ALIGNMENTS}, named AS (SELECT * REPLACE ({NAME_SQL.replace("user_id", "start")} AS chrom) FROM alignments)
SELECT chrom, CASE facing WHEN 'FR' THEN 'DELETION' ELSE 'DUPLICATION' END AS sv_type, count(*) AS n, sum(start)::BIGINT AS places FROM named
WHERE flag & 1 = 1 AND flag & 3340 = 0 AND abs(mate_start - start) <= 10000000 AND mapq <> 0 AND regexp_full_match(chrom, '(chr)?([1-9]|1[0-9]|2[0-2])')
  AND ((facing = 'FR' AND abs(tlen) > 250 + 10 * 9) OR facing = 'RF') GROUP BY ALL""")
def autosomal_pairs(spark, sf_dir):
    chrom = F.element_at(F.array(*map(F.lit, NAMES)), (1 + F.col("start") % len(NAMES)).cast("int"))
    found = pairs.discordant(ad.alignments(spark, sf_dir).withColumn("chrom", chrom), _parameters(spark))
    return found.groupBy("chrom", "sv_type").agg(F.count("*").alias("n"), F.sum("start").alias("places"))


LONGEST = 500 * ad.HOUR
RAW_EMISSION = EMISSION[: EMISSION.rindex("SELECT sample_idx")]
RAW_SCORE = EMISSION[EMISSION.rindex("round(") + len("round(") : EMISSION.rindex(f", {DIGITS})")]


@query(f"""WITH RECURSIVE {RAW_EMISSION.removeprefix("WITH ")}, scored AS (SELECT sample_idx, chrom, start, state, {RAW_SCORE} AS score FROM e), {GAMETES}, {HAPLOTYPES},
hand AS (SELECT f.c1 AS f1, f.c2 AS f2, m.c1 AS m1, m.c2 AS m2, least(4, f.x + m.x) AS o1, least(4, f.y + m.y) AS o2, sum(f.w * m.w) AS h FROM gam f, gam m GROUP BY ALL),
mv AS (SELECT x.c AS a, y.c AS b, CASE WHEN x.c = y.c THEN 1 - 4e-5 ELSE 1e-5 END AS t FROM cn x, cn y),
j AS (SELECT b.f AS f1, b.m AS m1, b.o AS o1, a.f AS f2, a.m AS m2, a.o AS o2, b.p > 0 AS ok1, a.p > 0 AS ok2 FROM mendel b, mendel a),
k AS (SELECT *, sum((main = 0)::INT) OVER (PARTITION BY f, m) AS n FROM mendel),
born AS (SELECT f, m, o, p * (1 - 1e-4) + CASE WHEN main = 0 THEN 1e-4 * CASE WHEN n = 3 THEN CASE WHEN p = 0 THEN .333 ELSE .3333 END ELSE 1.0 / n END ELSE 0 END AS p FROM k),
tr AS MATERIALIZED (SELECT f1 * 25 + m1 * 5 + o1 AS before, f2 * 25 + m2 * 5 + o2 AS after, ln(tf.t * tm.t * CASE WHEN ok1 AND ok2 AND coalesce(h, 0) > 0 THEN h WHEN (NOT ok1 AND NOT ok2) OR coalesce(h, 0) = 0 THEN tt.t ELSE x.p * y.p END) AS value
  FROM j LEFT JOIN hand USING (f1, f2, m1, m2, o1, o2) JOIN mv tf ON tf.a = f1 AND tf.b = f2 JOIN mv tm ON tm.a = m1 AND tm.b = m2 JOIN mv tt ON tt.a = o1 AND tt.b = o2 JOIN born x ON x.f = f1 AND x.m = m1 AND x.o = o1 JOIN born y ON y.f = f2 AND y.m = m2 AND y.o = o2),
begin AS MATERIALIZED (SELECT f * 25 + m * 5 + o AS state, ln(p) + ln(CASE f WHEN 2 THEN 9.6e-4 ELSE 1e-4 END) + ln(CASE m WHEN 2 THEN 9.6e-4 ELSE 1e-4 END) + ln(CASE o WHEN 2 THEN 9.6e-4 ELSE 1e-4 END) AS score FROM born),
numbered AS MATERIALIZED (SELECT chrom, start, "end", row_number() OVER (PARTITION BY chrom ORDER BY start) AS n FROM windows),
fold AS (SELECT chrom, n, start, "end", 0::BIGINT AS contig, start AS first FROM numbered WHERE n = 1
  UNION ALL SELECT w.chrom, w.n, w.start, w."end", f.contig + (f."end" - f.first + 1 > {LONGEST})::INT, CASE WHEN f."end" - f.first + 1 > {LONGEST} THEN w.start ELSE f.first END FROM fold f JOIN numbered w ON w.chrom = f.chrom AND w.n = f.n + 1),
placed AS MATERIALIZED (SELECT chrom, start, contig, row_number() OVER (PARTITION BY chrom, contig ORDER BY start) AS n FROM fold),
em AS MATERIALIZED (SELECT p.chrom, p.contig, p.n, f.state * 25 + m.state * 5 + o.state AS state, f.score + m.score + o.score AS e FROM placed p JOIN scored f ON f.sample_idx = 0 AND f.chrom = p.chrom AND f.start = p.start
  JOIN scored m ON m.sample_idx = 1 AND m.chrom = p.chrom AND m.start = p.start JOIN scored o ON o.sample_idx = 2 AND o.chrom = p.chrom AND o.start = p.start),
trellis AS (SELECT chrom, contig, n, state, score + e AS score FROM em JOIN begin USING (state) WHERE n = 1
  UNION ALL SELECT t.chrom, t.contig, t.n + 1, tr.after, max(t.score + tr.value) + any_value(em.e) FROM trellis t JOIN tr ON tr.before = t.state JOIN em ON em.chrom = t.chrom AND em.contig = t.contig AND em.n = t.n + 1 AND em.state = tr.after GROUP BY t.chrom, t.contig, t.n, tr.after)
SELECT chrom, contig, max_n AS windows, round(max(score), 4) AS score FROM trellis JOIN (SELECT chrom, contig, max(n) AS max_n FROM placed GROUP BY ALL) USING (chrom, contig) WHERE n = max_n GROUP BY ALL""")
def viterbi_optimum(spark, sf_dir):
    """The score of each contig's decoded path, which must be the best there is."""
    windows = segment.contigs(ad.windows(spark, sf_dir), 3 * ad.HOUR, LONGEST)
    path = segment.decode(windows, _models(spark)).withColumn("state", F.col("s0") * 25 + F.col("s1") * 5 + F.col("s2"))
    own = model.emission_scores(model.long_depth(windows), _models(spark)).select("sample_idx", "chrom", "start", "scores")
    chosen = F.element_at(F.array("s0", "s1", "s2"), F.col("sample_idx") + 1)
    emitted = path.join(own, ["chrom", "start"]).groupBy("chrom", "contig", "start", "state").agg(F.sum(F.element_at("scores", chosen + 1)).alias("e"))
    moves = spark.createDataFrame([(a, b, float(v)) for a, row in enumerate(tensors.joint_transition()) for b, v in enumerate(row)], "before int, state int, value double")
    begins = spark.createDataFrame([(-1, s, float(v)) for s, v in enumerate(tensors.start_scores())], "before int, state int, value double")
    before = F.coalesce(F.lag("state").over(Window.partitionBy("chrom", "contig").orderBy("start")), F.lit(-1))
    steps = emitted.withColumn("before", before).join(F.broadcast(moves.unionByName(begins)), ["before", "state"])
    return steps.groupBy("chrom", "contig").agg(F.count("*").alias("windows"), F.round(F.sum(F.col("e") + F.col("value")), 4).alias("score"))


LIMIT = 3


@query(f"""WITH {ad.ALIGNMENTS}, {ad.calls_sql('c', 0)}, reads AS (SELECT * REPLACE (flag | CASE WHEN start % 13 = 0 THEN 8 ELSE 0 END | CASE start % 10 WHEN 3 THEN 256 WHEN 7 THEN 2048 ELSE 0 END AS flag), start::VARCHAR AS seq FROM alignments),
primary_ AS (SELECT * FROM reads WHERE flag & 2304 = 0),
spots AS (SELECT call_id, chrom, start - 200 AS s, CASE WHEN "end" - start + 1 > 400 THEN start + 200 ELSE "end" + 200 END AS e FROM c UNION ALL SELECT call_id, chrom, "end" - 200, "end" + 200 FROM c WHERE "end" - start + 1 > 400),
kinds AS (SELECT call_id, unnest([0, 1, 2]) AS sample_idx, unnest([type0, type1, type2]) AS type FROM c),
names AS (SELECT DISTINCT s.call_id, r.sample_idx, k.type, r.qname FROM primary_ r JOIN spots s ON s.chrom = r.chrom AND r.start >= s.s AND r."end" <= s.e JOIN kinds k ON k.call_id = s.call_id AND k.sample_idx = r.sample_idx WHERE k.type <> 'REFERENCE'),
both_ AS (SELECT n.call_id, n.sample_idx, n.qname, min(r.ord) AS ord, max((cigar LIKE '%S%' OR (flag & 4 = 4) <> (flag & 8 = 8))::INT) AS shown,
    min(CASE n.type WHEN 'DELETION' THEN (facing = 'FR' AND abs(tlen) > 250 + 10 * 9)::INT ELSE (facing = 'RF')::INT END) AS odd, max(seq) FILTER (flag & 64 = 64) AS seq1, max(seq) FILTER (flag & 64 = 0) AS seq2
  FROM primary_ r JOIN names n USING (sample_idx, qname) WHERE flag & 1 = 1 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY call_id, sample_idx ORDER BY ord, qname) AS i FROM both_ WHERE (shown = 1 OR odd = 1) AND seq1 <> seq2),
stops AS (SELECT call_id, min(sample_idx) AS stop FROM ranked WHERE i >= {LIMIT} GROUP BY call_id)
SELECT call_id, sample_idx, sample_idx AS bam_ord, qname, seq1, seq2 FROM ranked LEFT JOIN stops USING (call_id) WHERE i <= {LIMIT} AND (stop IS NULL OR sample_idx <= stop)""")
def supporting_pairs(spark, sf_dir):
    """Pairs around the breakpoints of calls; some mates are unmapped, some records secondary or supplementary, and a call stops at three pairs of a file."""
    reads = ad.alignments(spark, sf_dir).withColumn("seq", F.col("start").cast("string"))
    odd = F.when(F.col("start") % 13 == 0, 8).otherwise(0) + F.when(F.col("start") % 10 == 3, 256).when(F.col("start") % 10 == 7, 2048).otherwise(0)
    reads = reads.withColumn("flag", F.col("flag").bitwiseOR(odd))
    return refine.supporting_pairs(ad.calls(spark, sf_dir, 0), reads, _parameters(spark), limit=LIMIT)
