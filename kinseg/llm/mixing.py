"""Mixing sources to target weights: fixed-length blocks drawn into output shards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinseg.llm.shared import whole, written

WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
#: Weights of the sources in code-point order, repeating; words of the mix and most words of a source, as multiples of what there is.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Words a block, and blocks a shard.
BLOCK, SHARD = 128, 4096
#: The plan of at most so many sources goes to every task; more are an error.
SOURCES = 100_000
#: Documents of a source are numbered within buckets of some so many, buckets within groups of exactly so many.
ROWS = 1024
#: numpy draws without replacement from fewer than a thousand million; above, shards are split in proportion.
DRAWN = 1 << 29
SEED = "mix"
SLOTS = "shard long, position int, source_no int, block long, epoch int, words int"


def targets(sizes: list[int], weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words that each source gives: by weight, none above `most` times its size, what is above reshared by weight."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    left, rest, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while rest:
        each = left / sum(weight[i] for i in rest)
        full = {i for i in rest if each * weight[i] > most * sizes[i]}
        for i in full or rest:
            out[i] = float(most * sizes[i]) if full else each * weight[i]
        left -= sum(out[i] for i in full)
        rest = rest - full if full else set()
    return out


def _scramble(x: np.ndarray, half: int, keys: list[int], back: bool) -> np.ndarray:
    """A keyed permutation of the numbers below 4 ** half, or its inverse, in rounds that exchange both halves."""
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for key in reversed(keys) if back else keys:
        side = left if back else right
        mixed = (side + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(32))) & mask
        left, right = (right ^ mixed, left) if back else (right, left ^ mixed)
    return left << np.uint64(half) | right


def permuted(x: np.ndarray, size: int, key: str, back: bool = False) -> np.ndarray:
    """Where a pseudorandom permutation of range(size), fixed by key, takes each x; with back, where it comes from."""
    digest = sha256(key.encode()).digest()
    keys = [int.from_bytes(digest[8 * i : 8 * i + 8], "little") for i in range(4)]
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    out = _scramble(np.asarray(x, np.uint64), half, keys, back)
    while (beyond := out >= size).any():
        out[beyond] = _scramble(out[beyond], half, keys, back)
    return out.astype(np.int64)


@dataclass
class Source:
    """What is taken of one source: `slots` blocks in all, the last of them cut to `cut` words."""

    name: str | None
    size: int
    docs: int
    target: float
    block: int

    def __post_init__(self):
        self.blocks = -(-self.size // self.block)
        self.take = min(int(self.target + 0.5), MOST * self.size)
        epochs, left = divmod(self.take, self.size) if self.size else (0, 0)
        self.slots, self.cut = epochs * self.blocks, 0
        if left:
            short = self.blocks * self.block - self.size
            at = int(permuted(np.array([self.blocks - 1]), self.blocks, self.key(epochs), True)[0])
            words = lambda n: n * self.block - (short if at < n else 0)
            n = left // self.block
            while words(n) < left:
                n += 1
            self.slots, self.cut = self.slots + n, left - words(n - 1)

    def key(self, epoch: int) -> str:
        return f"{SEED}:{self.name!r}:{epoch}"

    def drawn(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, epoch, words) of each of the source's slots: every block once an epoch, in an order of that epoch's own."""
        epoch = slots // self.blocks
        block = np.empty(len(slots), np.int64)
        for e in np.unique(epoch).tolist():
            block[epoch == e] = permuted(slots[epoch == e] % self.blocks, self.blocks, self.key(e))
        words = np.minimum(self.block, self.size - block * self.block)
        return block, epoch, np.where((slots == self.slots - 1) & (self.cut > 0), self.cut, words)


def halves(counts: np.ndarray, left: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each source's `counts` slots the first `left` slots get."""
    total = int(counts.sum())
    if total < DRAWN:
        return rng.multivariate_hypergeometric(counts, left)
    share = [int(c) * left for c in counts]
    out = np.array([s // total for s in share], np.int64)
    out[np.argsort([-(s % total) for s in share], kind="stable")[: left - int(out.sum())]] += 1
    return out


def shard_counts(counts: np.ndarray, shards: int, first: int, stop: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, slots of each source in it, slots of each source before it) for the shards first to stop - 1.

    A multinomial draw per shard, given each source's total: shards are halved down to single ones, each half's
    counts drawn by a generator that its bounds seed. So any task finds any shard's counts, without the others.
    """
    total = int(counts.sum())

    def walk(low: int, high: int, own: np.ndarray, before: np.ndarray) -> Iterator:
        if high <= first or low >= stop:
            return
        if high - low == 1:
            yield low, own, before
            return
        middle = (low + high) // 2
        seed = int.from_bytes(sha256(f"{SEED}:{low}:{high}".encode()).digest()[:8], "little")
        left = halves(own, total * middle // shards - total * low // shards, np.random.default_rng(seed))
        yield from walk(low, middle, left, before)
        yield from walk(middle, high, own - left, before + left)

    yield from walk(0, shards, counts, np.zeros_like(counts))


def slots(spark, sources: list[Source], shard: int = SHARD) -> DataFrame:
    """SLOTS: one row per drawn block, its shard, place within it, source, block number, epoch and words."""
    counts = np.array([s.slots for s in sources], np.int64)
    shards = -(-int(counts.sum()) // shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            for number, own, before in shard_counts(counts, shards, int(ids.min()), int(ids.max()) + 1):
                parts = [(i, *sources[i].drawn(np.arange(before[i], before[i] + own[i]))) for i in np.flatnonzero(own).tolist()]
                source = np.concatenate([np.full(len(p[1]), p[0], np.int32) for p in parts])
                block, epoch, words = (np.concatenate([p[c] for p in parts]) for c in (1, 2, 3))
                seed = int.from_bytes(sha256(f"{SEED}:order:{number}".encode()).digest()[:8], "little")
                place = np.random.default_rng(seed).permutation(len(source)).astype(np.int32)
                columns = [np.full(len(source), number), place, source, block, epoch.astype(np.int32), words.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in SLOTS.split(", ")])

    return spark.range(0, shards).mapInArrow(run, SLOTS)


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, digest): the words of each document, counted once.

    Each word with the space behind it becomes one letter, which needs no array of all words.
    """
    text = whole("text")
    marks = F.regexp_replace(F.regexp_replace(text, f"{WORD}{SPACE}*", "x"), f"^{SPACE}+", "")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.length(marks).cast("long").alias("size"), F.xxhash64(text).alias("digest"))


def before(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows plus the sum of value over the rows before within keys."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(value).over(window), F.lit(0)))


def placed(measured: DataFrame, plan: DataFrame) -> DataFrame:
    """(source_no, doc_id, digest, size, first): each document's first word in its source.

    Documents are added up within buckets by hash, buckets within groups and
    groups within sources, so no task holds a whole source. Equal rows are counted first and stand side by side.
    """
    known = plan.select(F.col("name"), "source_no", "buckets")
    rows = measured.groupBy("source", "doc_id", "digest", "size").agg(F.count("*").alias("copies"))
    rows = rows.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest"), "buckets")).withColumn("words", F.col("size") * F.col("copies"))
    inner = before(rows, ["source_no", "bucket"], ["doc_id", "digest"], "words", "in_bucket")
    sums = rows.groupBy("source_no", "bucket").agg(F.sum("words").alias("words")).withColumn("group", F.floor(F.col("bucket") / ROWS))
    groups = before(sums.groupBy("source_no", "group").agg(F.sum("words").alias("words")), ["source_no"], ["group"], "words", "at_group").drop("words")
    offsets = before(sums, ["source_no", "group"], ["bucket"], "words", "in_group").join(groups, ["source_no", "group"])
    offsets = offsets.select("source_no", "bucket", (F.col("at_group") + F.col("in_group")).alias("at_bucket"))
    rows = inner.join(offsets, ["source_no", "bucket"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    first = F.col("at_bucket") + F.col("in_bucket") + (F.col("copy") - 1) * F.col("size")
    return rows.select("source_no", "doc_id", "digest", "size", first.alias("first"))


def pieces(rows: DataFrame, block: int, words: Column | None = None) -> DataFrame:
    """placed() rows cut at block bounds: plus block, from (in the block), start (in the document), n, and the piece's text if words are given."""
    last = F.col("first") + F.col("size")
    blocks = F.sequence(F.floor(F.col("first") / block), F.floor((last - 1) / block))
    start = lambda b: F.greatest(b * block, F.col("first")) - F.col("first")
    stop = lambda b: F.least((b + 1) * block, last) - F.col("first")

    def cut(b: Column) -> Column:
        parts = [b.alias("block"), (F.col("first") + start(b) - b * block).alias("from"), start(b).alias("start"), (stop(b) - start(b)).alias("n")]
        if words is not None:
            parts.append(F.slice(words, (start(b) + 1).cast("int"), (stop(b) - start(b)).cast("int")).alias("piece"))
        return F.struct(*parts)

    kept = ["source_no", "doc_id", "digest", "size", "first"]
    return rows.filter("size > 0").select(*kept, F.explode(F.transform(blocks, cut)).alias("p")).select(*kept, "p.*")


@dataclass
class Mix:
    """documents: placed() rows; plan: a row per source; drawn: SLOTS; block: words a block."""

    documents: DataFrame
    plan: DataFrame
    drawn: DataFrame
    block: int

    def spans(self, cut: DataFrame | None = None) -> DataFrame:
        """Which words stand where: shard, position, epoch, source_no, doc_id, digest, first, from (place in the block), start (place in the document), n.

        Blocks and slots are joined by source and block number. A block has at most as many
        documents as words and is drawn at most once an epoch, so no key is hot.
        """
        # Spark takes the drawn slots for as few as their shards, and would send them all to every executor.
        met = self.drawn.hint("merge").join(pieces(self.documents, self.block) if cut is None else cut, ["source_no", "block"])
        return met.withColumn("n", F.least("n", F.col("words") - F.col("from"))).filter("n > 0").drop("size", "words", "block")

    def taken(self) -> DataFrame:
        """documents plus taken: how many of a document's words the mix holds, repeats counted."""
        sums = self.spans().groupBy("source_no", "first").agg(F.sum("n").alias("taken"))
        rows = self.documents.join(sums.withColumn("_some", F.lit(1)), ["source_no", "first"], "left")
        return rows.withColumn("taken", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0)).drop("_some")

    def texts(self, docs: DataFrame) -> DataFrame:
        """The mix itself: shard, position, source, text, each block's words joined by spaces. docs are the documents that were mixed."""
        words = docs.select("doc_id", F.xxhash64(whole("text")).alias("digest"), F.regexp_extract_all(whole("text"), F.lit(f"({WORD})"), 1).alias("all")).dropDuplicates(["doc_id", "digest"])
        same = self.documents["doc_id"].eqNullSafe(words["doc_id"]) & (self.documents["digest"] == words["digest"])
        cut = pieces(self.documents.join(words.select("doc_id", "digest", "all"), same).select(self.documents["*"], "all"), self.block, F.col("all"))
        parts = self.spans(cut).select("shard", "position", "source_no", "from", F.slice("piece", 1, F.col("n").cast("int")).alias("piece"))
        blocks = parts.groupBy("shard", "position", "source_no").agg(F.sort_array(F.collect_list(F.struct("from", "piece"))).alias("ps"))
        text = F.array_join(F.flatten(F.transform("ps", lambda p: p["piece"])), " ")
        return blocks.join(F.broadcast(self.plan.select("source_no", F.col("name").alias("source"))), "source_no").select("shard", "position", "source", text.alias("text"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, block: int = BLOCK, shard: int = SHARD) -> Mix:
    """Words of all documents packed into blocks by source, and blocks drawn into shards so that each source gives its target.

    Documents of a source stand end to end in an order by hash; every `block` words are one block. Per shard, the
    slots of each source are a multinomial draw given the sources' totals. Slots of a source run through
    pseudorandom permutations of its blocks, one an epoch, and the last slot is cut, so a source gives exactly its
    rounded target and no block comes more than twice. All draws are keyed: reruns agree, whatever the partitions.

    Null texts have no words; documents without words are placed but never drawn. Null is a source of its own, the last.
    Repeated rows are documents of their own. An empty table gives no rows. Extra columns are ignored. More than SOURCES sources are an error.
    """
    spark = docs.sparkSession
    measured = written(sized(docs), "mix-sizes")
    found = measured.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    wanted = targets([r.size for r in found], weights, share)
    sources = [Source(r.source, r.size, r.docs, t, block) for r, t in zip(found, wanted)]
    rows = [(i, s.name, s.size, s.target, -(-s.docs // ROWS)) for i, s in enumerate(sources)]
    plan = spark.createDataFrame(rows, "source_no int, name string, source_size long, target double, buckets long")
    documents = written(placed(measured, plan), "mix-placed")
    return Mix(documents, plan, slots(spark, sources, shard), block)


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document: see mix()."""
    made = mix(docs)
    plan = F.broadcast(made.plan.select("source_no", "source_size", "target"))
    return made.taken().join(plan, "source_no").select("doc_id", "size", "source_size", "target", "taken")
