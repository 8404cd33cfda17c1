"""Insert sizes, discordant read pairs, their clusters and calls."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinseg.functions.alignments import AUTOSOMES, maybe_discordant, sizes_insert, spans_deletion, spans_duplication
from kinseg.operators.relops import Rows, folded, islands, overlap_join, pair_by_key, per_group

SIZES_PER_SAMPLE = 1_000_000
#: File positions are counted by ranges of so many.
ORDS_PER_RANGE = 1_000_000
SCALE, WIDTH = 1.4826, 3
LEAST_PAIRS, MOST_PAIRS, LEAST_LENGTH = 3, 499, 50
#: Pairs of fewer bases look for regions with both reads at once.
NEAR = 2_000
PLACE = ("left_first", "right_first", "left_second", "right_second")


def insert_sizes(reads: DataFrame, limit: int | None = SIZES_PER_SAMPLE) -> DataFrame:
    """sample, x: absolute insert sizes of the first `limit` eligible pairs of each sample in file order, of all without a limit."""
    kept = reads.filter(sizes_insert()).select("sample", "ord", F.abs("tlen").alias("x"))
    if limit is None:
        return kept.select("sample", "x")
    kept = kept.withColumn("_range", F.floor(F.col("ord") / ORDS_PER_RANGE))
    order = Window.partitionBy("sample").orderBy("_range")
    counts = kept.groupBy("sample", "_range").agg(F.count("*").alias("_in"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_in").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("_before") < limit)
    placed = kept.join(counts, ["sample", "_range"])
    # Ranges of file positions lie before the limit as a whole but for one of each sample, whose rows alone are ranked.
    whole = F.col("_before") + F.col("_in") <= limit
    last = placed.filter(~whole).withColumn("_n", F.row_number().over(Window.partitionBy("sample").orderBy("ord")))
    return placed.filter(whole).select("sample", "x").unionByName(last.filter(F.col("_n") + F.col("_before") <= limit).select("sample", "x"))


def insert_statistics(sizes: DataFrame, low: float = 0.05, high: float = 0.95, pad_to: int | None = None) -> DataFrame:
    """sample, median (of the sizes ranked between the low and high share) and mad (median absolute deviation of all, unscaled).

    Equal sizes are counted first, so a sample sends a row per size and task, whatever its depth.
    pad_to adds zeros up to that many sizes, as fixed-length arrays of old did.
    """
    counts = sizes.groupBy("sample", "x").agg(F.count("*").alias("c"))
    if pad_to:
        short = counts.groupBy("sample").agg((F.lit(pad_to) - F.sum("c")).alias("c")).filter("c > 0")
        counts = counts.unionByName(short.select("sample", F.lit(0).alias("x"), "c")).groupBy("sample", "x").agg(F.sum("c").alias("c"))
    n = F.sum("c").over(Window.partitionBy("sample"))
    stop = F.sum("c").over(Window.partitionBy("sample").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("n", n).withColumn("stop", stop)
    first, last = F.greatest(F.floor(F.col("n") * low) - 1, F.lit(0)), F.floor(F.col("n") * high)
    inside = ranked.withColumn("c", F.least("stop", last) - F.greatest(F.col("stop") - F.col("c"), first)).filter("c > 0")
    middle = inside.groupBy("sample").agg(F.percentile("x", 0.5, F.col("c")).alias("median"))
    centre = counts.groupBy("sample").agg(F.percentile("x", 0.5, F.col("c")).alias("_m"))
    spread = counts.join(F.broadcast(centre), "sample").groupBy("sample").agg(F.percentile(F.abs(F.col("x") - F.col("_m")), 0.5, F.col("c")).alias("mad"))
    return middle.join(spread, "sample")


def discordant(reads: DataFrame, parameters: DataFrame, deviation: float = 9, contigs: str | None = AUTOSOMES) -> DataFrame:
    """Reads of discordant pairs with sv_type DELETION or DUPLICATION. parameters: sample, median, mad; one row per sample."""
    kept = reads.filter(maybe_discordant())
    if contigs:
        kept = kept.filter(F.col("chrom").rlike(contigs))
    joined = kept.join(F.broadcast(parameters.select("sample", F.col("median").cast("int").alias("_median"), F.col("mad").cast("int").alias("_mad"))), "sample")
    kind = F.when(spans_deletion("_median", "_mad", deviation), "DELETION").when(spans_duplication(), "DUPLICATION")
    return joined.withColumn("sv_type", kind).filter("sv_type is not null").drop("_median", "_mad")


def read_pairs(found: DataFrame) -> DataFrame:
    """Discordant reads paired by name within sample, contig and type, the earlier in coordinate order first."""
    pairs = pair_by_key(found, ["sample", "chrom", "sv_type", "qname"], ["start", "ord"], ["start", "end"])
    return pairs.select("sample", "chrom", "sv_type", F.col("start_1").alias("left_first"), F.col("end_1").alias("right_first"), F.col("start_2").alias("left_second"), F.col("end_2").alias("right_second"))


def exclude_pairs(pairs: DataFrame, regions: DataFrame, bucket: int = 100_000) -> DataFrame:
    """Pairs neither read of which overlaps a region (closed intervals).

    A pair whose reads lie near each other looks for regions once, along both reads and what is between, and
    its reads decide on those it meets; other pairs look once for each read.
    """
    place = ["chrom", *PLACE]
    span = lambda a, b: F.struct(F.col(a).alias("start"), F.col(b).alias("end"))
    near = (F.col("left_first") <= F.col("right_first")) & (F.col("right_first") <= F.col("right_second")) & (F.col("left_first") <= F.col("left_second"))
    near = near & (F.col("left_second") <= F.col("right_second")) & (F.col("right_second") - F.col("left_first") < NEAR)
    ends = F.explode(F.when(near, F.array(span("left_first", "right_second"))).otherwise(F.array(span("left_first", "right_first"), span("left_second", "right_second"))))
    reads = pairs.select(*place).distinct().select(*place, ends.alias("e")).select(*place, "e.start", "e.end")
    touches = lambda a, b: (F.col(a) <= F.col("r_end")) & (F.col("r_start") <= F.col(b))
    met = overlap_join(reads, regions, bucket).filter(touches("left_first", "right_first") | touches("left_second", "right_second"))
    hit = met.select(*place).distinct()
    return pairs.join(hit, place, "left_anti")


def reach(median: int, mad: int) -> float:
    """How far ends of pairs of one event may lie apart, from the largest median and MAD of the samples."""
    return median + WIDTH * mad * SCALE


def maximum_parameters(parameters: DataFrame) -> tuple[int, int]:
    """Largest median and largest MAD over the samples, as whole numbers; 0, 0 without samples."""
    row = parameters.agg(F.max(F.col("median").cast("int")), F.max(F.col("mad").cast("int"))).first()
    return row[0] or 0, row[1] or 0


def pair_islands(pairs: DataFrame, apart: float) -> DataFrame:
    """pairs plus island: cut where the first positions lie `apart` or more from the one before, as no link crosses that."""
    far = F.col("left_first") - F.col("_before") >= apart
    return islands(pairs, ["chrom", "sv_type"], [*PLACE, "sample_idx"], {"_before": ("max", "left_first")}, far)


class Group:
    """Pairs of one event, still open: its number, size, newest place, members near the line's head, and those to be given out."""

    def __init__(self, number: int):
        self.number, self.size, self.newest = number, 0, 0
        self.near: deque[tuple[int, int, int, int]] = deque()
        self.members: list[tuple] = []


class OpenGroups:
    """Single link along the sorted pairs of one island; gives (*pair, number of the group's first pair) of groups of least to most pairs.

    Each pair in turn joins the oldest group that is still open and has a member
    near it, or opens one. A group is open as long as its newest member lies no further than `apart` behind;
    then it is given out. Kept are the open groups alone: of each the members less than `apart` behind, and up to
    `most` in all, as more are not given out. So memory goes with what lies within `apart`, not with the island.
    """

    def __init__(self, apart: float, deletion: bool, least: int, most: int, names: tuple[str, ...]):
        self.apart, self.deletion, self.least, self.most, self.names = apart, deletion, least, most, names
        self.count = 0
        self.groups: list[Group] = []

    def _joins(self, group: Group, at: int, inner: int, outer: int, far: int) -> bool:
        while group.near and at - group.near[0][0] >= self.apart:
            group.near.popleft()
        return any(abs(far - f) < self.apart and (not self.deletion or max(inner, i) < min(outer, o)) for _, i, o, f in reversed(group.near))

    def _out(self, group: Group) -> Iterator[tuple]:
        if self.least <= group.size <= self.most:
            for member in group.members:
                yield *member, group.number

    def take(self, rows: Rows) -> Iterator[tuple]:
        for place, row in zip(zip(*(rows[c].tolist() for c in PLACE)), zip(*(rows[c].tolist() for c in self.names))):
            shut = [g for g in self.groups if place[0] - g.newest > self.apart]
            for group in shut:
                yield from self._out(group)
            if shut:
                self.groups = [g for g in self.groups if place[0] - g.newest <= self.apart]
            home = next((g for g in self.groups if self._joins(g, *place)), None)
            if home is None:
                self.groups.append(home := Group(self.count))
            home.size += 1
            home.newest = place[0]
            home.near.append(place)
            if home.size <= self.most:
                home.members.append(row)
            else:
                home.members.clear()
            self.count += 1

    def close(self) -> Iterator[tuple]:
        for group in self.groups:
            yield from self._out(group)
        self.groups = []


def components(pairs: DataFrame, apart: float, least: int = LEAST_PAIRS, most: int = MOST_PAIRS) -> DataFrame:
    """pairs (chrom, sv_type, sample_idx and places) plus island, component: single links, components of least to most pairs.

    Islands smaller than `least` cannot hold one and are dropped before Python.
    """
    cut = pair_islands(pairs, apart)
    sizes = cut.groupBy("chrom", "sv_type", "island").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    names = ("chrom", "sv_type", "island", "sample_idx", *PLACE)
    rows = cut.join(sizes, ["chrom", "sv_type", "island"]).select(*names)

    def begin(first: Rows) -> OpenGroups:
        return OpenGroups(apart, first["sv_type"][0] == "DELETION", least, most, names)

    schema = "chrom string, sv_type string, island long, sample_idx int, left_first long, right_first long, left_second long, right_second long, component long"
    return folded(rows, ["chrom", "sv_type", "island"], [*PLACE, "sample_idx"], begin, schema)


def largest_cliques(rows: Rows, apart: float, deletion: bool) -> list[list[int]]:
    """All largest sets of pairs that lie less than `apart` from each other at both their ends, each in order.

    Such pairs are points of the plane within one square, which may be moved until the leftmost and
    the lowest of them lie on its sides. So a sweep over the lefts, with the heights of each strip sorted, meets
    every set. A deletion's pair whose reads overlap goes with later pairs only, and those must have a gap.
    """
    first, far = rows["left_first"], rows["right_second"]
    gap = rows["right_first"] < rows["left_second"] if deletion else np.ones(len(first), bool)
    best: list[bytes] = []
    size = 0
    for i in range(len(first)):
        # The strip holds pair i and, from it on, those to its right; equal lefts are met by the first of them.
        strip = np.flatnonzero((first >= first[i]) & (first - first[i] < apart) & gap)
        if not gap[i]:
            later = strip[strip > i]
            strip = np.append(later[np.abs(far[later] - far[i]) < apart], i)
        if len(strip) < size:
            continue
        strip = strip[np.argsort(far[strip], kind="stable")]
        height = far[strip]
        stop = np.searchsorted(height, height + apart, side="left")
        own = np.arange(len(strip))
        low = int(np.flatnonzero(strip == i)[0])
        counts = np.where((own <= low) & (stop > low), stop - own, 0)
        most = int(counts.max())
        if most > size:
            best, size = [], most
        if most == size:
            best += [np.sort(strip[k : stop[k]]).tobytes() for k in np.flatnonzero(counts == most)]
    return [np.frombuffer(q, np.int64).tolist() for q in dict.fromkeys(best)]


def supported(father: int | Column, mother: int | Column, offspring: int | Column):
    """Whether counts of pairs in the trio make an event credible: inherited, new in the offspring, or strong in a parent alone."""
    f, m, o = father, mother, offspring
    return ((o > 1) & ((f > 1) | (m > 1))) | ((o > 2) & (f < 2) & (m < 2)) | ((o < 2) & ((f > 2) | (m > 2)))


def likelihood_ratio(sizes: np.ndarray, length: float, median: float, mad: float) -> float:
    """Log-likelihood gain of fragment sizes when the event of that length explains them, under Normal sizes of sd mad."""
    x = sizes - median
    return float((x**2 - (x - length) ** 2).sum() / (2 * mad * mad)) if mad > 0 else 0.0


def clique_call(rows: Rows, median: int, mad: int) -> tuple | None:
    """(start, end, type0..2, quality) of one clique, None without support."""
    kind = rows["sv_type"][0]
    counts = [int((rows["sample_idx"] == i).sum()) for i in range(3)]
    if not supported(*counts):
        return None
    if kind == "DELETION":
        start, end = int(rows["right_first"].max()), int(rows["left_second"].min())
        quality = likelihood_ratio(rows["right_second"] - rows["left_first"] + 1, end - start + 1, median, mad)
    else:
        start, end, quality = int(rows["right_first"].min()), int(rows["left_second"].max()), float(len(rows["right_first"]))
    return start, end, *(kind if n > 1 else "REFERENCE" for n in counts), quality


def pair_calls(found: DataFrame, apart: float, median: int, mad: int) -> DataFrame:
    """One call per component: of its largest cliques the one of best quality above -1, ties to the smallest place.

    chrom, start, end, type0..2, score, evidence RP; calls of 50 bases or fewer are not kept.
    """

    def run(group: Rows) -> Iterator[tuple]:
        cliques = largest_cliques(group, apart, group["sv_type"][0] == "DELETION")
        calls = [c for q in cliques if (c := clique_call({n: x[q] for n, x in group.items()}, median, mad)) and c[-1] > -1]
        if calls:
            yield group["chrom"][0], *min(calls, key=lambda c: (-c[-1], c[:2]))

    schema = "chrom string, start long, end long, type0 string, type1 string, type2 string, score double"
    calls = per_group(found, ["chrom", "sv_type", "island", "component"], [*PLACE, "sample_idx"], run, schema)
    return calls.filter(F.col("end") - F.col("start") + 1 > LEAST_LENGTH).withColumn("evidence", F.lit("RP"))
