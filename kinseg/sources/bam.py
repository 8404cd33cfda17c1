"""Binary alignment files: a data source that is read in parts and written by tasks, an index built by Spark, and reads by place."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from struct import Struct, pack, unpack_from

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from kinseg import schemas
from kinseg.functions.alignments import end_position  # noqa: F401 (tests take it from here)
from kinseg.operators.relops import overlap_join
from kinseg.sources.bamrows import FIELDS, FILE, OFFSET, OPERATIONS, SHIFTS, TAGS, columns, encoded, tags  # noqa: F401 (the last for tests)

#: Fixed values of the format: its magic, that of a block, the empty block at the end.
MAGIC, BLOCK = b"BAM\1", b"\x1f\x8b\x08\x04"
LAST = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Bytes of a partition, of plain text in a block that is written and of that taken apart at once, records that must follow each other to begin at a guess, and bytes of each that are looked at.
SPLIT, FILLED, TAKEN, TRUSTED, AHEAD = 32 << 20, 0xFF00, 1 << 21, 4, 1 << 16
#: As a power of two, the bytes of a file that a task of reads by place takes; the narrowest bins in which reads meet windows; what an index is made of.
CHUNK, NARROW = 22, 1 << 10
PLACED = ["file", "ord", "stop", "ref_idx", "start", "end"]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files(path: str) -> list[str]:
    """The file itself, or the .bam files of a folder in the order of their names; those that begin with _ were never finished."""
    store, at = _store(path)
    if store.get_file_info(at).type == fs.FileType.Directory:
        at = sorted(f.path for f in store.get_file_info(fs.FileSelector(at)) if f.path.endswith(".bam") and not f.base_name.startswith("_"))
        if len(at) > 1 << 63 - FILE:
            raise ValueError(f"{path} holds more than {1 << 63 - FILE} files")
        prefix = path[: path.index("://") + 3] if "://" in path else ""
        return [prefix + f for f in at]
    return [path]


class Blocks:
    """The compressed blocks of a file; `read` counts those that were taken apart."""

    def __init__(self, path: str):
        store, at = _store(path)
        self.file, self.read = store.open_input_file(at), 0
        self.size = self.file.size()

    def length(self, at: int, data: bytes, place: int = 0) -> int | None:
        """The size of the block at data[place:], None where none begins."""
        if data[place : place + 4] != BLOCK or len(data) < place + 18:
            return None
        extra, i = unpack_from("<H", data, place + 10)[0], place + 12
        while i + 6 <= place + 12 + extra <= len(data):
            kind, n = data[i : i + 2], unpack_from("<H", data, i + 2)[0]
            if kind == b"BC" and n == 2:
                size = unpack_from("<H", data, i + 4)[0] + 1
                return size if at + size <= self.size else None
            i += 4 + n
        return None

    def block(self, at: int) -> tuple[bytes, int]:
        """The text of the block at a place, and the next block's place; empty at the end of the file."""
        if at >= self.size:
            return b"", at
        data = self.file.read_at(1 << 16, at)
        if (size := self.length(at, data)) is None:
            raise ValueError(f"no block begins at {at}")
        self.read += 1
        extra = unpack_from("<H", data, 10)[0]
        return zlib.decompress(data[12 + extra : size - 8], -15), at + size

    def first(self, low: int) -> int:
        """The first block that begins at low or behind; it must be followed by another or end the file."""
        while low < self.size:
            data = self.file.read_at(1 << 17, low)
            at = data.find(BLOCK)
            while at >= 0:
                size = self.length(low + at, data, at)
                if size and (low + at + size == self.size or self.length(low + at + size, self.file.read_at(64, low + at + size))):
                    return low + at
                at = data.find(BLOCK, at + 1)
            low += max(1, len(data) - 64)
        return self.size


class Cursor:
    """A place in the plain text of a file's blocks."""

    def __init__(self, blocks: Blocks, at: int, place: int = 0):
        self.blocks, self.at, self.place = blocks, at, place
        self.text, self.next = blocks.block(at)

    def settle(self) -> int | None:
        """The virtual offset of what comes next, at the head of a block rather than the end of the one before; None at the end."""
        while self.place >= len(self.text):
            if self.next >= self.blocks.size:
                return None
            self.at, self.place = self.next, 0
            self.text, self.next = self.blocks.block(self.at)
        return self.at << OFFSET | self.place

    def take(self, n: int) -> bytes:
        parts = []
        while n:
            if self.settle() is None:
                raise ValueError("the file ends within a record")
            part = self.text[self.place : self.place + n]
            parts.append(part)
            self.place, n = self.place + len(part), n - len(part)
        return b"".join(parts)

    def skip(self, n: int) -> None:
        while n:
            if self.settle() is None:
                raise ValueError("the file ends within a record")
            part = min(n, len(self.text) - self.place)
            self.place, n = self.place + part, n - part


@dataclass
class Header:
    text: str
    names: list[str]
    lengths: list[int]
    end: int

    @property
    def sample(self) -> str:
        found = re.search(r"^@RG.*?\tSM:([^\t\n]+)", self.text, re.MULTILINE)
        return found[1] if found else ""


def header(path: str) -> Header:
    cursor = Cursor(Blocks(path), 0)
    number = lambda: unpack_from("<i", cursor.take(4))[0]
    if cursor.take(4) != MAGIC:
        raise ValueError(f"{path} is no alignment file")
    text = cursor.take(number()).rstrip(b"\0").decode()
    names, lengths = [], []
    for _ in range(number()):
        names.append(cursor.take(number())[:-1].decode())
        lengths.append(number())
    end = cursor.settle()
    return Header(text, names, lengths, cursor.blocks.size << OFFSET if end is None else end)


def tagged(text: bytes, at: int, end: int) -> bool:
    """Whether tags of known kinds fill text[at:end]."""
    while at < end:
        if at + 4 > end or not (65 <= text[at] <= 122 and 48 <= text[at + 1] <= 122):
            return False
        kind, at = chr(text[at + 2]), at + 3
        if kind in "ZH":
            at = text.find(0, at, end) + 1
            if not at:
                return False
        elif kind == "A":
            at += 1
        elif kind == "B":
            if at + 5 > end or chr(text[at]) not in TAGS or (n := unpack_from("<i", text, at + 1)[0]) < 0:
                return False
            at += 5 + n * Struct(TAGS[chr(text[at])]).size
        elif kind in TAGS:
            at += Struct(TAGS[kind]).size
        else:
            return False
    return at == end


def plausible(text: bytes, at: int, references: int) -> int | None:
    """Where the record after one that begins at text[at] would begin; None if none can begin there. What lies behind the text is not judged."""
    if at + 36 > len(text):
        return None
    size, ref, pos, name, _, _, ops, _, letters, mate, mate_pos = unpack_from("<iiiBBHHHiii", text, at)
    if not (-1 <= ref < references and -1 <= mate < references and pos >= -1 and mate_pos >= -1 and name >= 1 and 0 <= letters and 32 <= size < 1 << 28):
        return None
    behind = 32 + name + 4 * ops + (letters + 1) // 2 + letters
    if behind > size:
        return None
    spelled = text[at + 36 : at + 36 + name]
    if len(spelled) == name and (spelled[-1] or any(c < 33 or c > 126 for c in spelled[:-1])):
        return None
    if any(c & 15 >= len(OPERATIONS) for c in text[at + 36 + name : at + 36 + name + 4 * ops : 4]):
        return None
    if at + 4 + size <= len(text) and not tagged(text, at + 4 + behind, at + 4 + size):
        return None
    return at + 4 + size


def follows(blocks: Blocks, at: int, place: int, references: int) -> bool:
    """Whether TRUSTED records, or all up to the end of the file, follow each other from there, however far they reach."""
    cursor = Cursor(blocks, at, place)
    try:
        for _ in range(TRUSTED):
            if cursor.settle() is None:
                break
            text = cursor.take(36)
            if plausible(text, 0, references) is None:
                return False
            left = unpack_from("<i", text)[0] - 32
            text += cursor.take(min(left, AHEAD))
            if plausible(text, 0, references) is None:
                return False
            cursor.skip(left - (len(text) - 36))
    except ValueError:
        return False
    return True


def record_start(blocks: Blocks, at: int, stop: int, references: int) -> int | None:
    """The virtual offset of the first record that begins in a block from at to before stop; None without one.

    Bytes within a record can look like the head of a long one, so those that it would be followed by are always looked at.
    """
    while at < stop:
        text, after = blocks.block(at)
        own = len(text)
        ahead = after
        while ahead < blocks.size and len(text) < own + AHEAD:
            more, ahead = blocks.block(ahead)
            text += more
        for place in range(own):
            if plausible(text, place, references) is not None and follows(blocks, at, place, references):
                return at << OFFSET | place
        at = after
    return None


def records(blocks: Blocks, begin: int, stop: int) -> Iterator[tuple[int, int, bytes]]:
    """(virtual offset, that of the next, content) of the records that begin from virtual offset begin to before stop."""
    cursor = Cursor(blocks, begin >> OFFSET, begin & 0xFFFF)
    here = cursor.settle()
    while here is not None and here < stop:
        content = cursor.take(unpack_from("<i", cursor.take(4))[0])
        following = cursor.settle()
        yield here, blocks.size << OFFSET if following is None else following, content
        here = following


def stretch(blocks: Blocks, begin: int, stop: int, taken: int = TAKEN) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(text, places in it, virtual offsets and that behind the last) of the records that begin from virtual offset begin to before stop, some `taken` bytes at a time."""
    at, place = begin >> OFFSET, begin & 0xFFFF
    text, least = b"", place + 1
    firsts: list[int] = []
    begins: list[int] = []
    length = Struct("<i").unpack_from
    while True:
        parts, n = [text], len(text)
        while at < blocks.size and (n < least or (n < taken and at <= stop >> OFFSET)):
            more, after = blocks.block(at)
            if more:
                firsts.append(n)
                begins.append(at)
                parts.append(more)
                n += len(more)
            at = after
        text, done = b"".join(parts), at >= blocks.size
        places: list[int] = []
        here = place
        while here + 4 <= n:
            size = length(text, here)[0]
            if size < 32:
                raise ValueError("a record is shorter than its head")
            # The last record waits for the block behind it, which tells its end.
            if here + 4 + size > n or (here + 4 + size == n and not done):
                break
            places.append(here)
            here += 4 + size
        if here >= n and done and not places:
            return
        every = np.array([*places, here], np.int64)
        of = np.searchsorted(firsts, every, side="right") - 1
        virtual = np.array(begins, np.int64)[of] << OFFSET | (every - np.array(firsts, np.int64)[of])
        if here >= n and done:
            virtual[-1] = blocks.size << OFFSET
        count = int(np.searchsorted(virtual[:-1], stop))
        if count:
            yield text, every[:count], virtual[: count + 1]
        if count < len(places) or (here < n and virtual[-1] >= stop) or (here >= n and done):
            return
        if done:
            raise ValueError("the file ends within a record")
        shift = firsts[of[-1]]
        firsts, begins = [f - shift for f in firsts[of[-1] :]], begins[of[-1] :]
        text, place = text[shift:], here - shift
        least = place + 5 if len(text) < place + 4 else place + 5 + length(text, place)[0]


@dataclass
class Part(InputPartition):
    path: str
    file: int
    low: int
    high: int


class Reader(DataSourceReader):
    """Each file in stretches of `split` bytes; a task finds the first block and the first record that begin in its own."""

    def __init__(self, options: dict):
        self.path, self.split, self.columns = options["path"], int(options.get("split", SPLIT)), options["columns"].split(",") if "columns" in options else list(FIELDS)

    def partitions(self) -> list[Part]:
        sizes = [(path, Blocks(path).size) for path in files(self.path)]
        return [Part(path, i, low, min(low + self.split, size)) for i, (path, size) in enumerate(sizes) for low in range(0, size, self.split)] or [Part("", 0, 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        head, blocks = header(part.path), Blocks(part.path)
        at = blocks.first(part.low)
        first = at << OFFSET
        if first < head.end:
            begin: int | None = head.end
        else:
            begin = record_start(blocks, at, part.high, len(head.names))
        if begin is not None:
            for text, places, here in stretch(blocks, begin, part.high << OFFSET):
                yield columns(text, places, here[:-1], here[1:], part.file, head.names, self.columns)


@dataclass
class Written(WriterCommitMessage):
    name: str


def compressed(text: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(text) + packer.flush()
    return BLOCK + bytes([0, 0, 0, 0, 0, 255, 6, 0]) + b"BC" + pack("<HH", 2, len(body) + 25) + body + pack("<II", zlib.crc32(text), len(text))


class Writer(DataSourceArrowWriter):
    """A folder with one file per task, which takes its name only when all tasks are done."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.text, self.overwrite = options["path"], options.get("header", "@HD\tVN:1.6\n"), overwrite
        self.contigs = [(n, int(size)) for n, size in re.findall(r"^@SQ\tSN:([^\t]+)\tLN:(\d+)", self.text, re.MULTILINE)]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, at = _store(self.path)
        store.create_dir(at)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.bam"
        text = self.text.encode()
        held = MAGIC + pack("<i", len(text)) + text + pack("<i", len(self.contigs)) + b"".join(pack("<i", len(n) + 1) + n.encode() + b"\0" + pack("<i", size) for n, size in self.contigs)
        contigs = [n for n, _ in self.contigs]
        with store.open_output_stream(f"{at}/_{name}") as out:
            for batch in iterator:
                held += encoded(batch, contigs)
                full = len(held) // FILLED * FILLED
                for at_text in range(0, full, FILLED):
                    out.write(compressed(held[at_text : at_text + FILLED]))
                held = held[full:]
            if held:
                out.write(compressed(held))
            out.write(LAST)
        return Written(name)

    def commit(self, messages) -> None:
        store, at = _store(self.path)
        names = {m.name for m in messages if m is not None}
        for info in store.get_file_info(fs.FileSelector(at)):
            own = info.base_name.removeprefix("_")
            if own in names:
                store.move(info.path, f"{at}/{own}")
            elif self.overwrite and own.endswith(".bam"):
                store.delete_file(info.path)

    def abort(self, messages) -> None:
        store, at = _store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{at}/_{m.name}")


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        wanted = self.options["columns"].split(",") if "columns" in self.options else FIELDS
        return ", ".join(f"{c} {FIELDS[c]}" for c in wanted)

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)


def read_bam(spark: SparkSession, path: str, sample: str | None = None, bam_ord: int = 0, split: int = SPLIT, extra: bool = False) -> DataFrame:
    """Records of a file, or of the files of a folder, as READS, in parts of `split` bytes. The sample is the header's unless given; ord is the place in the file."""
    spark.dataSource.register(BamSource)
    own = next((header(f).sample for f in files(path)), "") if sample is None else sample
    return as_reads(spark.read.format("bam").option("split", split).load(path), own, bam_ord, extra)


def read_places(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Where the records of read_bam(..., extra=True) lie, without their names, letters and tags: all that build_index() needs."""
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("split", split).option("columns", ",".join(PLACED)).load(path)


def as_reads(rows: DataFrame, sample: str, bam_ord: int, extra: bool = False) -> DataFrame:
    rows = rows.select("*", F.lit(sample).alias("sample"), F.lit(bam_ord).alias("bam_ord"))
    return rows.select(*(f.split()[0] for f in schemas.READS.split(", ")), *(["file", "stop"] if extra else []))


def write_bam(reads: DataFrame, path: str, contigs: list[tuple[str, int]], sample: str) -> None:
    """Reads (qname, flag, chrom, start, mapq, cigar, mate_ref_idx, mate_start, tlen, seq, qual, tags) as a folder of files, each in its task's order."""
    reads.sparkSession.dataSource.register(BamSource)
    text = "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in contigs) + f"@RG\tID:1\tSM:{sample}\n"
    own = [n for n in FIELDS if n not in ("file", "ord", "stop", "ref_idx", "end")]
    reads.select(*own).write.format("bam").option("header", text).mode("overwrite").save(path)


LINEAR = 14


def bin_of(low: int, high: int) -> int:
    """The smallest bin that holds the 0-based half-open interval."""
    high -= 1
    return next((first + (low >> shift) for shift, first in reversed(SHIFTS.items()) if low >> shift == high >> shift), 0)


def bin_column(low: Column, high: Column) -> Column:
    """bin_of() for columns."""
    out = F.lit(0)
    for shift, first in SHIFTS.items():
        a, b = F.shiftright(low.cast("long"), shift), F.shiftright((high - 1).cast("long"), shift)
        out = F.when(a == b, first + a).otherwise(out)
    return out


def build_index(reads: DataFrame) -> DataFrame:
    """(file, ref_idx, bin, begin, stop, least, most): stretches of a file that hold the records of each bin, from read_places() or read_bam(..., extra=True).

    Records that follow each other in a bin make one stretch, cut where over 64 kb of the file lie between. Bins of
    16 kb also have, in a row of their own, the first and the last place of all records that reach into
    them, so that what lies outside need not be read, however large the bin that holds it. Files need not be sorted.
    Both come from one reading.
    """
    placed = reads.filter("ref_idx is not null").withColumn("start", F.greatest("start", F.lit(1))).withColumn("last", F.greatest("end", "start"))
    placed = placed.select("file", "ref_idx", F.col("ord").alias("begin"), "stop", (F.col("start") - 1).cast("long").alias("low"), F.col("last").cast("long").alias("high"))
    slot = F.shiftright(F.col("begin"), OFFSET + 16)
    at = lambda bin, slot: F.struct(bin.cast("long").alias("bin"), slot.cast("long").alias("slot"))
    reach = F.transform(F.sequence(F.shiftright("low", LINEAR), F.shiftright(F.col("high") - 1, LINEAR)), lambda w: at(w + SHIFTS[LINEAR], F.lit(None)))
    each = placed.select("file", "ref_idx", "begin", "stop", F.explode(F.concat(F.array(at(bin_column(F.col("low"), F.col("high")), slot)), reach)).alias("at"))
    parts = each.groupBy("file", "ref_idx", "at.bin", "at.slot").agg(F.min("begin").alias("begin"), F.max("stop").alias("stop")).withColumn("linear", F.col("slot").isNull())
    order = Window.partitionBy("file", "ref_idx", "bin", "linear").orderBy("slot")
    new = F.coalesce((F.col("slot") - F.lag("slot").over(order) > 1).cast("int"), F.lit(1))
    numbered = parts.withColumn("new", new).withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = numbered.groupBy("file", "ref_idx", "bin", "linear", "part").agg(F.min("begin").alias("begin"), F.max("stop").alias("stop"))
    one = lambda c, linear, name: F.when(F.col("linear") == linear, F.col(c)).alias(name)
    return found.select("file", "ref_idx", "bin", one("begin", False, "begin"), one("stop", False, "stop"), one("begin", True, "least"), one("stop", True, "most"))


def stretches(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(file, begin, stop) of the stretches where records that overlap the windows (ref_idx, start, end) can be, each once.

    A window is looked up in its own 16 kb bins and in every bin above them, and what lies before or behind all records that reach its 16 kb bins is cut off.
    """
    own = windows.select("ref_idx", "start", "end").filter("start <= end").distinct()
    first, last = F.greatest(F.col("start") - 1, F.lit(0)).cast("long"), F.greatest(F.col("end") - 1, F.lit(0)).cast("long")
    own = own.select(F.xxhash64("ref_idx", "start", "end").alias("window"), "ref_idx", first.alias("first"), last.alias("last"))
    level = [F.sequence(F.shiftright("first", shift) + number, F.shiftright("last", shift) + number) for shift, number in SHIFTS.items()]
    bins = F.flatten(F.array(F.array(F.lit(0).cast("long")), *level))
    linear = index.filter("least is not null").select("file", "ref_idx", "bin", "least", "most")
    reach = own.select("window", "ref_idx", F.explode(level[-1]).alias("bin")).join(linear, ["ref_idx", "bin"]).groupBy("window", "file").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    met = own.select("window", "ref_idx", F.explode(bins).alias("bin")).join(index.filter("begin is not null").select("file", "ref_idx", "bin", "begin", "stop"), ["ref_idx", "bin"])
    met = met.join(reach, ["window", "file"])
    return met.select("file", F.greatest("begin", "least").alias("begin"), F.least("stop", "most").alias("stop")).filter("begin < stop").distinct()


def indexed_reads(spark: SparkSession, path: str, index: DataFrame, windows: DataFrame, sample: str | None = None, bam_ord: int = 0) -> DataFrame:
    """READS that overlap the windows (ref_idx, start, end), each once, taking apart only the blocks that the index names.

    Windows and index meet by a join. Tasks read the places of the records in what it leaves, cut into chunks of
    the files; these meet the windows by a join, and only the records that overlap are read whole.
    """
    paths = files(path)
    own = next((header(f).sample for f in paths), "") if sample is None else sample
    mask, line = (1 << FILE) - 1, OFFSET + CHUNK
    tasks = max(spark.sparkContext.defaultParallelism, sum(Blocks(f).size for f in paths) >> CHUNK)
    local = lambda c: F.col(c).bitwiseAND(F.lit(mask))
    chunk = lambda c: F.shiftright(c, line)
    wanted = stretches(index, windows).select("file", local("begin").alias("begin"), local("stop").alias("stop"))
    cut = wanted.withColumn("chunk", F.explode(F.sequence(chunk(F.col("begin")), chunk(F.col("stop") - 1))))
    cut = cut.select("file", "chunk", F.greatest("begin", F.shiftleft("chunk", line)).alias("begin"), F.least("stop", F.shiftleft(F.col("chunk") + 1, line)).alias("stop"))
    before = F.max("stop").over(Window.partitionBy("file", "chunk").orderBy("begin", "stop").rowsBetween(Window.unboundedPreceding, -1))
    # Stretches that overlap are read once: each begins where those before it have ended. What they are is little, so tasks are as many as the files' size asks for.
    fresh = cut.repartition(tasks, "file", "chunk").withColumn("begin", F.greatest("begin", F.coalesce(before, "begin"))).filter("begin < stop")

    def opened(file: int, known: dict[int, tuple[Blocks, list[str]]]) -> tuple[Blocks, list[str]]:
        if file not in known:
            known[file] = Blocks(paths[file]), header(paths[file]).names
        return known[file]

    def near(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[Blocks, list[str]]] = {}
        for part in parts:
            for file, begin, stop in zip(*(part.column(c).to_pylist() for c in ("file", "begin", "stop"))):
                blocks, names = opened(file, known)
                if begin % (1 << line) == 0:
                    # A stretch that goes on from the chunk before: its first record here is looked for.
                    first = record_start(blocks, blocks.first(begin >> OFFSET), -(-stop >> OFFSET), len(names))
                    if first is None:
                        continue
                    begin = first
                for text, places, here in stretch(blocks, begin, stop):
                    yield columns(text, places, here[:-1], here[1:], file, names, PLACED)

    def whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[Blocks, list[str]]] = {}
        for part in parts:
            file, places_of = (part.column(c).to_numpy() for c in ("file", "ord"))
            wanted = places_of & mask
            # Records in blocks near each other are read in one go.
            cuts = (np.flatnonzero((np.diff(file) != 0) | (np.diff(wanted >> OFFSET) > 1 << 16)) + 1).tolist()
            for low, high in zip([0, *cuts], [*cuts, len(wanted)]):
                blocks, names = opened(int(file[low]), known)
                for text, places, here in stretch(blocks, int(wanted[low]), int(wanted[high - 1]) + 1):
                    met = np.isin(here[:-1], wanted[low:high])
                    if met.any():
                        yield columns(text, places[met], here[:-1][met], here[1:][met], int(file[low]), names, list(FIELDS))

    schema = lambda wanted: ", ".join(f"{c} {FIELDS[c]}" for c in wanted)
    found = fresh.select("file", "begin", "stop").mapInArrow(near, schema(PLACED)).filter("ref_idx is not null")
    found = found.select("file", "ord", "ref_idx", "start", F.greatest("end", "start").alias("end"))
    hits = overlap_join(found, windows.select("ref_idx", "start", "end").filter("start <= end").distinct(), NARROW, key="ref_idx").select("file", chunk(local("ord")).alias("chunk"), "ord")
    hits = hits.repartition(tasks, "file", "chunk").distinct().sortWithinPartitions("ord").select("file", "ord")
    return as_reads(hits.mapInArrow(whole, schema(FIELDS)), own, bam_ord)
