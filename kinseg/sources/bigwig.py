"""Binary signal files: names by their B+ tree, data blocks by their R-tree, read in parts and by place."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from struct import calcsize, unpack, unpack_from

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from kinseg import schemas
from kinseg.sources.bam import _store

#: Fixed values of the format: magics of the file, the tree of names and the tree of blocks, and the kinds of blocks.
FILE, NAMES, BLOCKS = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
INTERVALS, STARTS, STEPS = 1, 2, 3
#: Parts that a file is cut into at least, if it has as many nodes.
PARTS = 64
PUSHED = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Range:
    """Places that are asked for: names of contigs (None: all) and the bounds that an interval's end must pass and its start must not."""

    names: set[str] | None = None
    after: float = -1
    before: float = float("inf")


class Wig:
    """An open file; `blocks` counts data blocks that were taken apart."""

    def __init__(self, path: str):
        store, at = _store(path)
        self.file, self.blocks = store.open_input_file(at), 0
        head = self.file.read_at(64, 0)
        self.order = next((o for o in "<>" if len(head) == 64 and unpack_from(o + "I", head)[0] == FILE), None)
        if self.order is None:
            raise ValueError(f"{path} is no binary signal file")
        _, _, _, self.names_at, _, self.tree_at, _, _, _, _, self.packed, _ = unpack(self.order + "IHHQQQHHQQIQ", head)

    def take(self, at: int, form: str) -> tuple:
        return unpack(self.order + form, self.file.read_at(calcsize(self.order + form), at))

    def names(self) -> dict[int, str]:
        """Names of contigs by number."""
        magic, _, key, _, _, _ = self.take(self.names_at, "IIIIQQ")
        if magic != NAMES:
            raise ValueError("the tree of names is missing")
        out, nodes = {}, [self.names_at + 32]
        while nodes:
            at = nodes.pop()
            leaf, _, n = self.take(at, "BBH")
            for i in range(n):
                if leaf:
                    name, number, _ = self.take(at + 4 + i * (key + 8), f"{key}sII")
                    out[number] = name.rstrip(b"\0").decode()
                else:
                    nodes.append(self.take(at + 4 + i * (key + 8), f"{key}sQ")[1])
        return out

    def root(self) -> int:
        if self.take(self.tree_at, "I")[0] != BLOCKS:
            raise ValueError("the tree of blocks is missing")
        return self.tree_at + 48

    def children(self, at: int, names: dict[int, str], wanted: Range) -> tuple[bool, list[tuple[int, int]]]:
        """(leaf, [(place, size)]) of the blocks or nodes below a node that may hold wanted places; nodes have no size."""
        leaf, _, n = self.take(at, "BBH")
        form = "IIIIQQ" if leaf else "IIIIQ"
        data = self.file.read_at(n * calcsize("<" + form), at + 4)
        out = []
        for i in range(n):
            c0, start, c1, end, place, *size = unpack_from(self.order + form, data, i * calcsize("<" + form))
            if wanted.names is not None and not any(c0 <= c <= c1 and names[c] in wanted.names for c in names):
                continue
            if c0 == c1 and (end <= wanted.after or start > wanted.before):
                continue
            out.append((place, size[0] if leaf else 0))
        return bool(leaf), out

    def values(self, place: int, size: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """(contig, starts, ends, values) of a data block."""
        data = self.file.read_at(size, place)
        data = zlib.decompress(data) if self.packed else data
        self.blocks += 1
        contig, start, _, step, span, kind, _, n = unpack_from(self.order + "IIIIIBBH", data)
        u, f = np.dtype(np.uint32).newbyteorder(self.order), np.dtype(np.float32).newbyteorder(self.order)
        if kind == INTERVALS:
            rows = np.frombuffer(data, np.dtype([("s", u), ("e", u), ("v", f)]), n, 24)
            starts, ends, values = rows["s"], rows["e"], rows["v"]
        elif kind == STARTS:
            rows = np.frombuffer(data, np.dtype([("s", u), ("v", f)]), n, 24)
            starts, values = rows["s"], rows["v"]
            ends = starts + span
        elif kind == STEPS:
            values = np.frombuffer(data, f, n, 24)
            starts = start + step * np.arange(n)
            ends = starts + span
        else:
            raise ValueError(f"blocks of kind {kind} are not known")
        return contig, starts.astype(np.int32), ends.astype(np.int32), values.astype(np.float64)


@dataclass
class Part(InputPartition):
    nodes: list[tuple[int, int]]
    leaf: bool


class Reader(DataSourceReader):
    """Nodes of the tree of blocks, down to a level with enough of them, dealt out to tasks, which go on down; what the filters rule out is not read."""

    def __init__(self, options: dict):
        self.path, self.parts, self.wanted = options["path"], int(options.get("parts", PARTS)), Range()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrow the range; all filters stay with Spark, as blocks hold other places, too."""
        for f in filters:
            name = getattr(f, "attribute", ())
            if name == ("chrom",) and isinstance(f, (EqualTo, In)):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted.names = asked if self.wanted.names is None else self.wanted.names & asked
            elif name == ("end0",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.wanted.after = max(self.wanted.after, f.value - isinstance(f, GreaterThanOrEqual))
            elif name == ("start0",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.wanted.before = min(self.wanted.before, f.value)
            yield f

    def partitions(self) -> list[Part]:
        wig = Wig(self.path)
        names = wig.names()
        nodes, leaf = [(wig.root(), 0)], False
        while nodes and not leaf and len(nodes) < self.parts:
            below = [wig.children(at, names, self.wanted) for at, _ in nodes]
            nodes, leaf = [x for _, found in below for x in found], any(level for level, _ in below)
        size = max(1, -(-len(nodes) // self.parts))
        return [Part(nodes[i : i + size], leaf) for i in range(0, len(nodes), size)] or [Part([], True)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        wig = Wig(self.path)
        names = wig.names()
        todo = [(x, part.leaf) for x in reversed(part.nodes)]
        while todo:
            (place, size), block = todo.pop()
            if not block:
                leaf, found = wig.children(place, names, self.wanted)
                todo += [(x, leaf) for x in reversed(found)]
                continue
            contig, starts, ends, values = wig.values(place, size)
            yield pa.RecordBatch.from_arrays([pa.array([names[contig]] * len(starts), pa.string()), pa.array(starts), pa.array(ends), pa.array(values)], ["chrom", "start0", "end0", "value"])


class BigWigSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return schemas.SIGNAL

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def read_bigwig(spark: SparkSession, path: str, parts: int = PARTS) -> DataFrame:
    """The signal (chrom, start0, end0, value) of a file. Filters on chrom, start0 and end0 reach its tree, so that other blocks are not read."""
    spark.dataSource.register(BigWigSource)
    spark.conf.set(PUSHED, "true")
    return spark.read.format("bigwig").option("parts", parts).load(path)
