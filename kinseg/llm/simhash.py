"""SimHash near-duplicates by multi-index hashing.

Fingerprints are computed beside the text in Arrow batches. Everything after
that (segment tables, probes, verification, components) is DataFrame work on
distinct 8-byte fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinseg.llm.components import components
from kinseg.llm.shared import LOWER, UPPER, release, whole, written

BITS = 64
SEED = 42
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Shingles are hashed so many at a time, so that a very long text needs no more memory.
BLOCK = 50_000
#: Sampled segments, for links by similarity: their number, and the shingles in each.
SEGMENTS, SAMPLED, NOTHING = 20, 5, np.uint64(2**64 - 1)
#: All pairs of a sampled segment's texts are compared at once up to so many; larger groups are first thinned out by leaders, in so many rounds.
SMALL, ROUNDS = 24, 2
#: Where the donors of empty bins lie: for each bin so many tries, the same for all texts.
DONORS = np.random.default_rng(SEED).integers(0, SEGMENTS * SAMPLED, (SEGMENTS * SAMPLED, 96))
#: Shingles are counted in so many slots, by hash, to tell rare from common ones.
SLOTS = 1 << 18
#: Bits of a text's outline, which bounds its similarity to others; texts of a large group compared in one cell, along either side.
OUTLINE, CELL = 1024, 512
#: Bits of the outlines of texts that are compared in full; sizes of such texts in one band differ by this factor at most.
WIDE, BAND = 8192, 1.03
#: Fingerprints of candidates are sent to every executor up to so many, joined by a shuffle beyond.
BROADCAST_KEYS = 400_000
#: Segment values shared by more fingerprints than this are matched by midpoints instead.
CROWD = 16


def shingle_hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's word shingles, repeats included, in blocks of bounded size.

    Words are runs of anything but space and \\t..\\r, A-Z lowered. Fewer words
    than a shingle takes: one shingle of them all; none: no block.
    """
    found = text.encode().translate(FOLD).split()
    if not found:
        return
    if len(found) < words:
        shingles, total = iter([b" ".join(found)]), 1
    else:
        shingles, total = map(b" ".join, zip(*(found[i:] for i in range(words)))), len(found) - words + 1
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    for start in range(0, total, BLOCK):
        yield np.fromiter(hashes, dtype="<u8", count=min(BLOCK, total - start))


def _majority(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes along the last axis set each of the 64 bits."""
    return np.unpackbits(hashes.view(np.uint8), axis=-1, bitorder="little").reshape(*hashes.shape, BITS).sum(axis=-2, dtype=np.int64)


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1, bitorder="little").view("<i8")[..., 0]


def fingerprint(text: str, words: int = 3) -> int:
    """Signed 64-bit SimHash of a text's word shingles, repeats counted; without words 0."""
    ones, total = np.zeros(BITS, np.int64), 0
    for block in shingle_hashes(text, words):
        ones += _majority(block)
        total += len(block)
    return int(_packed(ones * 2 > total))


def sketch(text: str, words: int) -> tuple[int, list[int | None], int, list[int]]:
    """fingerprint(), SEGMENTS more SimHashes, each of SAMPLED shingles that texts alike sample alike, and an outline.

    The shingles are dealt into SEGMENTS * SAMPLED bins by hash and the smallest
    of each bin is taken, so a segment of two texts of similarity s agrees with a
    probability of about s to the power SAMPLED. An empty bin borrows from a bin
    drawn at random, the same for all texts, so that the segments of short texts
    are samples of several shingles as well. Segments are None without any shingle.
    The outline is the number of distinct shingles and a bitmap of them, see may_be_alike().
    """
    ones, total = np.zeros(BITS, np.int64), 0
    least = np.full(SEGMENTS * SAMPLED, NOTHING, np.uint64)
    distinct, marks = np.zeros(0, np.uint64), np.zeros(OUTLINE, np.uint8)
    for block in shingle_hashes(text, words):
        ones += _majority(block)
        total += len(block)
        np.minimum.at(least, (block % np.uint64(len(least))).astype(np.int64), block)
        distinct = np.union1d(distinct, block)
        marks[(block >> np.uint64(32)) % np.uint64(OUTLINE)] = 1
    outline = _packed(marks.reshape(-1, BITS)).tolist()
    if not total:
        return 0, [None] * SEGMENTS, 0, outline
    if (empty := np.flatnonzero(least == NOTHING)).size:
        lent = least[DONORS[empty]]
        first = (lent != NOTHING).argmax(axis=1)
        lent = lent[np.arange(len(empty)), first]
        least[empty] = np.where(lent == NOTHING, least[least != NOTHING][0], lent)
    own = _packed(_majority(least.reshape(SEGMENTS, SAMPLED)) * 2 > SAMPLED)
    return int(_packed(ones * 2 > total)), own.tolist(), len(distinct), outline


def similarity(a: str, b: str, words: int) -> float:
    """Jaccard similarity of the sets of word shingles; two texts without words are alike."""
    one, two = (set(shingle_set(t, words).tolist()) for t in (a, b))
    return len(one & two) / len(one | two) if one or two else 1.0


def fingerprint_column(text: Column, words: int = 3) -> Column:
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(x or "", words) for x in texts.to_pylist()], pa.int64())

    return of(text)


def _ball(width: int, radius: int) -> list[int]:
    """Every mask of `width` bits with at most `radius` bits set."""
    return [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _longs(values: list[int]) -> Column:
    return F.array(*(F.lit(v - 2**64 if v >= 2**63 else v).cast("long") for v in values))


def links(prints: DataFrame, max_distance: int = 2, segments: int = 2, crowd: int = CROWD) -> DataFrame:
    """(a, b), a < b: pairs of the distinct fingerprints `fp` within max_distance bits, enough to connect all that are linked.

    Multi-index hashing: two such fingerprints differ in at most
    max_distance // segments bits of some segment. The table holds each
    fingerprint under each of its segment values; a probe enumerates the Hamming
    ball of that radius around its own segment values, fetches the table's
    matches, and the whole distance decides.

    A segment value that more than `crowd` fingerprints share (a large group of
    near copies) is not expanded. Every fingerprint whose probes meet such a
    value is matched through midpoints instead: two fingerprints within d bits
    have a value within half of d of both, so fingerprints meet where the balls
    of their whole 64 bits overlap. At most a ball's worth of distinct
    fingerprints can meet at one midpoint, so no group there can grow with the
    data, and each adds one link to the smallest of them per midpoint.
    """
    if max_distance % 2 or BITS % segments:
        raise ValueError("max_distance must be even and segments must divide 64")
    width = BITS // segments
    masks = _ball(width, max_distance // segments)
    low = (1 << width) - 1
    value = [F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit(low)) if segments > 1 else F.col("fp") for i in range(segments)]

    def tag(i: int, v: Column) -> Column:
        return v.bitwiseOR(F.lit(i << width)) if segments > 1 else v

    def probed(i: int) -> Column:
        return F.transform(_longs(masks), lambda mask: tag(i, value[i].bitwiseXOR(mask)))

    table = prints.select("fp", F.explode(F.array(*(tag(i, v) for i, v in enumerate(value)))).alias("key"))
    crowded = table.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("key")
    crowded = written(crowded, "crowded")
    entries = table.join(crowded, "key", "left_anti").select("key", F.col("fp").alias("match")).unionByName(crowded.select("key", F.lit(None).cast("long").alias("match")))
    probes = prints.select("fp", F.explode(F.concat(*map(probed, range(segments)))).alias("key"))
    # Spark takes the exploded probes for as small as the file they come from and would broadcast them.
    met = probes.hint("merge").join(entries, "key").filter(F.col("match").isNull() | ((F.col("fp") < F.col("match")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("match"))) <= max_distance)))
    met = written(met.select("fp", "match"), "matches")
    pairs = met.filter("match is not null").select(F.col("fp").alias("a"), F.col("match").alias("b"))
    dense = met.filter("match is null").select("fp").distinct()
    middle = _longs(_ball(BITS, max_distance // 2))
    meeting = dense.select("fp", F.explode(F.transform(middle, lambda m: F.col("fp").bitwiseXOR(m))).alias("key"))
    meeting = meeting.groupBy("key").agg(F.sort_array(F.collect_set("fp")).alias("fps")).filter(F.size("fps") > 1)
    star = meeting.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, F.size("fps"))).alias("b"))
    star = star.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)
    return pairs.unionByName(star).distinct()


def near_groups(docs: DataFrame, words: int = 3, max_distance: int = 2, segments: int = 2, crowd: int = CROWD) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id (smallest doc_id reachable over links of max_distance bits).

    A null or empty text has fingerprint 0, linked like any other. Repeated rows
    come back as often as they came. A null doc_id gets its component's smallest
    id; a component without any id gets null. No rows: no rows. Other columns of
    docs are ignored whatever their names.
    """
    rows = written(docs.select("doc_id", fingerprint_column(whole("text"), words).alias("fp")), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    roots = components(links(prints.select("fp"), max_distance, segments, crowd))
    named = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = written(named, "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(labels, "fp", "left").select("doc_id", "fp", "component_id")


def sketch_column(text: Column, words: int) -> Column:
    @F.arrow_udf("struct<fp:bigint,segments:array<bigint>,size:bigint,outline:array<bigint>>")
    def of(texts: pa.Array) -> pa.Array:
        release()
        found = [sketch(x.as_py() or "", words) for x in texts]
        columns = zip(*found) if found else [()] * 4
        kinds = [pa.int64(), pa.list_(pa.int64())] * 2
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["fp", "segments", "size", "outline"])

    return of(text)


def outline_column(text: Column, words: int) -> Column:
    """The outline of sketch() with WIDE bits."""

    @F.arrow_udf("array<bigint>")
    def of(texts: pa.Array) -> pa.Array:
        release()
        marks = np.zeros((len(texts), WIDE), np.uint8)
        for mark, text in zip(marks, texts):
            mark[(shingle_set(text.as_py() or "", words) >> np.uint64(32)) % np.uint64(WIDE)] = 1
        return pa.array(list(_packed(marks.reshape(len(texts), -1, BITS))), pa.list_(pa.int64()))

    return of(text)


def may_be_alike(least: float, bits: int = OUTLINE) -> Column:
    """Whether two texts with size_a, outline_a, size_b, outline_b can be that similar; never false where they are.

    Each bit in which the bitmaps differ stands for a shingle that only one of the
    texts has, and with d such shingles of both sizes' sum s the similarity is (s - d) / (s + d).
    """
    differ = sum((F.bit_count(F.col("outline_a")[i].bitwiseXOR(F.col("outline_b")[i])) for i in range(bits // BITS)), F.lit(0))
    close = differ <= (1 - least) / (1 + least) * (F.col("size_a") + F.col("size_b")) + 1e-6
    return close & (F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b") - 1e-6)


def within(least: float) -> Column:
    """Whether a shingle at at_a and at_b of the orders of rare_shingles() can be the first that two texts at least that similar share.

    Texts of size_a and size_b are that similar only if they share least / (1 + least) of both sizes' sum, so
    behind the first shared one either order must hold as many, itself included.
    """
    common = least / (1 + least) * (F.col("size_a") + F.col("size_b")) - 1e-6
    return (F.col("size_a") - F.col("at_a") >= common) & (F.col("size_b") - F.col("at_b") >= common)


def bands(least: float) -> tuple[Column, Column]:
    """The band of a text's size, and those of all sizes with which a row of rare_shingles() can be within()."""

    def band(size: Column) -> Column:
        return F.floor(F.log(F.greatest(size, F.lit(1.0))) / float(np.log(BAND))).cast("int")

    size = F.col("size").cast("double")
    most = F.least(size / least, (size - F.col("at")) * (1 + least) / least - size)
    return band(size), F.sequence(band(size * least - 1e-6), band(F.greatest(most, size * least) + 1e-6))


def divided(large: DataFrame, found: DataFrame) -> DataFrame:
    """(key, fp, label, main, n, outside): members of the groups that the links found so far do not connect.

    label is a member's component, main the group's commonest, outside the number of members in others.
    """
    roots = components(found).withColumnRenamed("node", "fp")
    labelled = written(large.join(roots, "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("label")), "labelled")
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("m"))
    most = sizes.groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.sum("m").alias("n"), F.max("m").alias("m"))
    apart = most.filter("m < n").select("key", "main", "n", (F.col("n") - F.col("m")).alias("outside"))
    return written(labelled.join(apart, "key"), "divided")


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words)]))


def rare_shingles(texts: DataFrame, words: int, least: float) -> DataFrame:
    """(key, fp, at): the rarest shingles of texts(fp, text) and their places, so many that two texts at least that similar share one.

    Of texts of n shingles that is all but least * n of them, and one more, in an
    order that all texts share: the one of their hash's count in SLOTS slots over
    all of texts, then of the hash. Passages that many texts share come last, so
    texts that have little else in common do not meet. Only the SLOTS counts reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount((shingle_set(text.as_py() or "", words) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["slot", "n"])

    table = texts.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    uses = np.zeros(SLOTS, np.int64)
    uses[table["slot"].to_numpy()] = table["n"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(uses)

    @F.arrow_udf("array<bigint>")
    def of(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts:
            found = shingle_set(text.as_py() or "", words)
            order = np.lexsort((found, shared.value[(found % np.uint64(SLOTS)).astype(np.int64)]))
            out.append(found[order[: len(found) - int(np.ceil(least * len(found) - 1e-9)) + 1]].view(np.int64).tolist())
        return pa.array(out, pa.list_(pa.int64()))

    return texts.select(F.posexplode(of("text")).alias("at", "key"), "fp").select("key", "fp", "at")


def led(groups: DataFrame, found: DataFrame, alike: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """found and what leaders add to it, and divided() of the groups(key, fp) that are still in parts, None without any.

    In each round a leader of every group, the member with most links that was
    not one yet, is compared with those not connected to it: edited copies lead
    to the text they were made of, and that to all others.
    """
    apart, leaders = divided(groups, found), None
    for _ in range(ROUNDS):
        if apart.isEmpty():
            return found, None
        ends = found.select(F.col("a").alias("fp")).unionByName(found.select(F.col("b").alias("fp")))
        able = apart.join(ends.groupBy("fp").agg(F.count("*").alias("links")), "fp", "left")
        if leaders is not None:
            able = able.join(leaders.select("key", F.col("leader").alias("fp")), ["key", "fp"], "left_anti")
        rank = F.struct(F.coalesce("links", F.lit(0)), F.xxhash64("key", "fp"), "fp")
        new = able.groupBy("key").agg(F.max_by(F.struct("fp", "label"), rank).alias("l"))
        new = written(new.select("key", F.col("l.fp").alias("leader"), F.col("l.label").alias("of")), "leaders")
        leaders = new if leaders is None else leaders.unionByName(new)
        pairs = apart.join(new, "key").filter("label <> of").select(F.least("leader", "fp").alias("a"), F.greatest("leader", "fp").alias("b"))
        found = found.unionByName(alike(pairs))
        apart = divided(groups, found)
    return found, None if apart.isEmpty() else apart


def similar(texts: DataFrame, near: DataFrame, words: int, least: float) -> DataFrame:
    """(a, b): pairs of fingerprints in texts(fp, segments, size, outline, text), one row each, whose texts are at least that similar.

    Candidates are the pairs of near(a, b) and texts that share the value of a
    sampled segment. The pair's whole texts decide. The links connect whatever
    the comparison of all candidates would. Groups of more than SMALL texts are
    first led(). Members of those that this leaves in parts meet again wherever
    they share one of their rare_shingles(), which misses no pair; groups of more than
    SMALL texts there are led(), and what is still in parts is compared in full,
    cell by cell, where the place of the shared shingle and the sizes leave room for
    that similarity, see within(); wide outlines then decide which texts are read. So candidates grow with
    the square of a group's size only for texts that share nearly as many shingles as texts that are alike.
    """
    outlines = written(texts.select("fp", "size", "outline"), "outlines")
    of_a, of_b = (outlines.toDF(c, f"size_{c}", f"outline_{c}") for c in "ab")

    @F.arrow_udf("double")
    def of(ones: pa.Array, twos: pa.Array) -> pa.Array:
        release()
        return pa.array([similarity(a.as_py(), b.as_py(), words) for a, b in zip(ones, twos)], pa.float64())

    def compared(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs.select("a", "b").distinct(), "candidates")
        named = written(pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct(), "candidate-texts")
        if named.count() <= BROADCAST_KEYS:
            named = F.broadcast(named)
        wanted = written(texts.select("fp", "text").join(named, "fp"), "candidate-texts")
        both = pairs.join(wanted.toDF("a", "text_a"), "a").join(wanted.toDF("b", "text_b"), "b")
        return written(both.select("a", "b", of("text_a", "text_b").alias("s")).filter(F.col("s") >= least).select("a", "b"), "similar")

    def alike(pairs: DataFrame) -> DataFrame:
        pairs = pairs.filter("a < b").distinct()
        return compared(pairs.join(of_a, "a").join(of_b, "b").filter(may_be_alike(least)))

    def alike_in_full(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs.select(F.least("fp_a", "fp_b").alias("a"), F.greatest("fp_a", "fp_b").alias("b")).distinct(), "within")
        wide = written(wanted.select("fp", outline_column(F.col("text"), words).alias("outline")).join(sizes, "fp"), "wide-outlines")
        ends = (wide.select(F.col("fp").alias(c), F.col("size").alias(f"size_{c}"), F.col("outline").alias(f"outline_{c}")) for c in "ab")
        return compared(pairs.join(next(ends), "a").join(next(ends), "b").filter(may_be_alike(least, WIDE)))

    def counted(keyed: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """The groups(key, fp) of up to SMALL, and of more texts."""
        groups = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        keyed = written(keyed.join(groups, "key"), name)
        return keyed.filter(F.col("n") <= SMALL).drop("n"), keyed.filter(F.col("n") > SMALL).drop("n")

    def pairs_of(small: DataFrame) -> DataFrame:
        return small.toDF(*(c if c == "key" else f"{c}_a" for c in small.columns)).join(small.toDF(*(c if c == "key" else f"{c}_b" for c in small.columns)), "key").filter("fp_a < fp_b")

    keyed = texts.select("fp", F.posexplode("segments").alias("i", "value")).filter("value is not null").select(F.xxhash64("i", "value").alias("key"), "fp")
    small, large = counted(written(keyed, "segments"), "shared-segments")
    found = alike(pairs_of(small).select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).unionByName(near.select("a", "b")))
    found, apart = led(large, found, alike)
    if apart is None:
        return found
    members = written(apart.select("fp", "label").distinct(), "apart")
    wanted = written(texts.select("fp", "text").join(members.select("fp"), "fp", "left_semi"), "apart-texts")
    sizes = outlines.select("fp", "size").join(members.select("fp"), "fp", "left_semi")
    rare = written(rare_shingles(wanted, words, least).join(sizes, "fp"), "rare-shingles")
    small, large = counted(rare, "shared-shingles")
    labelled = small.join(members, "fp").select("key", "fp", "label", "at", "size")
    met = pairs_of(labelled).filter((F.col("label_a") != F.col("label_b")) & within(least)).select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
    found, apart = led(large.select("key", "fp"), found.unionByName(alike(met)), alike)
    if apart is None:
        return found
    own, others = bands(least)
    rows, columns = (F.ceil(F.col(c) / CELL).cast("int") for c in ("outside", "n"))
    members = apart.join(large.select("key", "fp", "at", "size"), ["key", "fp"])
    members = members.select("*", own.alias("own"), rows.alias("rows"), columns.alias("columns"), F.explode(others).alias("other"))
    deal = F.xxhash64(F.lit("cell"), "fp")
    one = members.filter("label <> main").select("key", "own", "other", F.pmod(deal, "rows").alias("row"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"), *(F.col(c).alias(f"{c}_a") for c in ("fp", "label", "size", "at")))
    two = members.select("key", F.col("other").alias("own"), F.col("own").alias("other"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), F.pmod(deal, "columns").alias("column"), "main", *(F.col(c).alias(f"{c}_b") for c in ("fp", "label", "size", "at")))
    once = (F.col("label_b") == F.col("main")) | (F.col("fp_a") < F.col("fp_b"))
    # Spark takes the exploded rows for as small as the file they come from and would broadcast them.
    met = one.hint("merge").join(two, ["key", "own", "other", "row", "column"]).filter((F.col("label_a") != F.col("label_b")) & once & within(least))
    return found.unionByName(alike_in_full(met))


def near_texts(prints: DataFrame, max_distance: int, segments: int, crowd: int) -> DataFrame:
    """(a, b): texts of prints(fp, print), a key and a fingerprint each, to compare: those of fingerprints within max_distance bits.

    Of texts with one fingerprint one stands for all: it meets each of the others, and the ones that stand for near fingerprints.
    """
    first = written(prints.groupBy("print").agg(F.min("fp").alias("of")), "first-of-print")
    near = links(first.select(F.col("print").alias("fp")), max_distance, segments, crowd).select("a", "b")
    ends = [first.select(F.col("print").alias(c), F.col("of").alias(f"of_{c}")) for c in "ab"]
    apart = near.join(ends[0], "a").join(ends[1], "b").select("of_a", "of_b")
    same = prints.join(first, "print").filter("fp <> of").select("of", "fp")
    both = apart.toDF("x", "y").unionByName(same.toDF("x", "y"))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def drop_near(docs: DataFrame, words: int = 5, least: float = 0.8, max_distance: int = 2, segments: int = 2, crowd: int = CROWD) -> DataFrame:
    """docs with one row of each group of near copies, all columns as they came.

    Texts are linked whose sets of word shingles have a Jaccard similarity of at
    least `least`. Candidates have fingerprints within max_distance bits, equal
    ones included; but near that similarity they differ in some ten
    bits, more than segment balls can reach at scale, so sampled segments give candidates as well.
    Whole texts decide on every link: texts that repeat one passage may share a fingerprint and little else.
    The row with the smallest doc_id of a group stays (a null id after all
    others; of rows that tie, one). Null and empty texts are one group; empty in, empty out. Texts are
    sketched once; decisions are made on slim rows, and texts move only for candidates and groups of several rows.
    """
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    key, text = f"c{columns.index('doc_id')}", f"c{columns.index('text')}"
    marked = plain.withColumn("sketch", sketch_column(whole(text), words)).withColumn("row", F.monotonically_increasing_id())
    sketched = [F.col(f"sketch.{c}").alias(c) for c in ("segments", "size", "outline")]
    marked = written(marked.select(*plain.columns, "row", F.xxhash64(whole(text)).alias("fp"), F.col("sketch.fp").alias("print"), *sketched), "marked")
    prints = written(marked.groupBy("fp").agg(F.count("*").alias("n"), F.min("row").alias("row"), F.min("print").alias("print")), "prints")
    repeated = prints.filter("n > 1").select("fp", F.col("row").alias("first_row"))
    if repeated.count() <= BROADCAST_KEYS:
        repeated = F.broadcast(repeated)
    one_each = marked.join(repeated, "fp", "left").filter("first_row is null or first_row = row")
    near = near_texts(prints, max_distance, segments, crowd)
    roots = components(similar(one_each.select("fp", "segments", "size", "outline", whole(text).alias("text")), near, words, least))
    named = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"))
    named = written(named, "named")
    several = named.groupBy("root").agg(F.sum("n").alias("rows")).filter("rows > 1").select("root")
    shared = written(named.join(several, "root", "left_semi").select("fp", "root"), "shared")
    if shared.count() <= BROADCAST_KEYS:
        shared = F.broadcast(shared)
    single = marked.join(shared.select("fp"), "fp", "left_anti").select(*plain.columns)
    best = (
        marked.join(shared, "fp")
        .groupBy("root")
        .agg(F.min_by(F.struct(*plain.columns), F.struct(F.coalesce(F.col(key), F.lit(2**63 - 1)), F.md5(whole(text)))).alias("best"))
        .select("best.*")
    )
    return single.unionByName(best).toDF(*columns)
