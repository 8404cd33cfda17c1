"""Cross-tokenizer alignment: where tokens of two vocabularies begin and end together, and which ids belong together."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinseg.llm.counts import LETTERS, library
from kinseg.llm.shared import held, whole, written
from kinseg.llm.terms import FREQUENT, commonest

#: A space between two characters that no library takes for white space: both vocabularies cut before it, whatever stands around.
CUT = re.compile(r"(?<=[^\s\x1c-\x1f▁]) (?=[^\s\x1c-\x1f▁])")
#: A stretch that keeps its tokens when others like it stand before and behind.
PLAIN = re.compile(r" [^\s\x1c-\x1f▁](.*[^\s\x1c-\x1f▁])?", re.DOTALL)
#: A marker behind another character; no piece may have one, or it could reach across such a cut.
INNER = re.compile("[^▁]▁")
#: Fixed value: how a vocabulary with byte fallback writes a byte.
BYTE = re.compile("<0x([0-9A-F]{2})>")
#: A worker keeps the alignment of so many distinct stretches, then of the newer half.
KEPT = 500_000
#: Stretches that DuckDB aligns at a time, and that the libraries encode as one text.
TABLE, RUN = 20_000, 500

#: The offsets where tokens of both sides end, in order, with the places and ids of these tokens, the tokens of
#: either side since the offset before, and how many of their byte ranges overlap.
ALIGNED = """
WITH under AS (
  -- Under the last byte of each A token lies the first B token that ends there or behind.
  SELECT a.i, a.id, a.e, b.i AS j, b.id AS other, a.e = b.e AS cut FROM a ASOF JOIN b ON a.e <= b.e
), shared AS (
  SELECT a.i, count(*) AS n FROM a JOIN b ON a.s < b.e AND b.s < a.e GROUP BY a.i
), summed AS (
  SELECT under.*, sum(n) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS met FROM under JOIN shared USING (i)
)
SELECT e, i - coalesce(lag(i) OVER w, -1) AS n_a, j - coalesce(lag(j) OVER w, -1) AS n_b, (met - coalesce(lag(met) OVER w, 0))::BIGINT AS n_overlaps, id * 4294967296 + other AS pair
FROM summed WHERE cut WINDOW w AS (ORDER BY e) ORDER BY e
"""


def grouped(a: pa.Array, b: pa.Array, n_a: np.ndarray, n_b: np.ndarray, stop: np.ndarray) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` of each stretch: written ids of both sides, sizes of the groups, and the group after each stretch's last."""
    a_end, b_end = np.cumsum(n_a), np.cumsum(n_b)
    a_at = np.arange(len(a)) + np.repeat(b_end - n_b, n_a)
    b_at = np.arange(len(b)) + np.repeat(a_end, n_b)
    place = np.empty(len(a) + len(b), np.int64)
    place[a_at], place[b_at] = np.arange(len(a)), len(a) + np.arange(len(b))
    mark = np.zeros(len(place), np.int64)
    mark[a_end + b_end - n_b - 1] = 1
    mark[a_end + b_end - 1] = 2
    last = (a_end + b_end)[stop - 1]
    mark[last - 1] = 3
    written_ids = pa.concat_arrays([a, b]).take(pa.array(place))
    parts = pc.binary_join_element_wise(written_ids, pa.array([",", "|", ";", ""]).take(pa.array(mark)), "")
    offsets = pa.array(np.concatenate([[0], last]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, parts), "").to_pylist()


class Aligner:
    """Alignments of distinct stretches of text: one worker's two vocabularies, DuckDB connection and cache."""

    def __init__(self, byte_path: str, piece_path: str):
        import duckdb
        import sentencepiece
        from tokenizers import Tokenizer

        library(byte_path)  # on one thread
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        letter = {shown: byte for byte, shown in LETTERS.items()}
        special = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        names = {i: name for name, i in self.a.get_vocab().items()}
        self.a_bytes = [special[i] if i in special else bytes(letter[x] for x in names.get(i, "")) for i in range(max(names) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(BYTE.fullmatch(p)[1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        usual = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.apart = not any(INNER.search(p) for p in usual)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.pairs: list[bytes] = []
        #: n_a, n_b, n_overlaps of each stretch; -1 where its bytes do not come back.
        self.counts = np.zeros((KEPT + TABLE, 3), np.int64)

    def stretches(self, text: str) -> list[str]:
        """A text, after a space, cut where both vocabularies cut; without the space that each begins with."""
        return CUT.split(text) if self.apart else [text]

    def numbers(self, texts: list[list[str]]) -> list[list[int]]:
        """The numbers of each text's stretches, after all of them have been aligned."""
        fresh = list({x for stretches in texts for x in stretches}.difference(self.number))
        if len(self.groups) + len(fresh) > KEPT:
            used = set(chain.from_iterable(texts))
            kept = [(x, i) for x, i in self.number.items() if i >= len(self.groups) - KEPT // 2 or x in used]
            places = [i for _, i in kept]
            self.groups, self.pairs = ([old[i] for i in places] for old in (self.groups, self.pairs))
            self.counts[: len(kept)] = self.counts[places]
            self.number = {x: i for i, (x, _) in enumerate(kept)}
        for at in range(0, len(fresh), TABLE):
            part = fresh[at : at + TABLE]
            first = len(self.groups)
            if first + len(part) > len(self.counts):
                self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            self.add([" " + x for x in part])
            self.number.update(zip(part, range(first, first + len(part))))
        return [list(map(self.number.__getitem__, stretches)) for stretches in texts]

    def add(self, stretches: list[str]) -> None:
        """Align stretches and keep the results in their order."""
        first, size = len(self.groups), len(stretches)
        self.groups += [""] * size
        self.pairs += [b""] * size
        self.counts[first : first + size] = -1
        usual = [c for c, x in enumerate(stretches) if PLAIN.fullmatch(x)] if self.apart else []
        runs = [usual[at : at + RUN] for at in range(0, len(usual), RUN)] + [[c] for c in set(range(size)).difference(usual)]
        odd = self.aligned(stretches, runs, first)
        self.aligned(stretches, [[c] for c in odd], first)

    def aligned(self, stretches: list[str], runs: list[list[int]], first: int) -> list[int]:
        """Align the stretches of each run, encoded as one text, and keep them from number `first` on.

        Comes back with the stretches of runs of several whose bytes differ on either side; a single one stays without a result.
        """
        texts = ["".join([stretches[c] for c in run]) for run in runs]
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([x[1:] for x in texts], num_threads=1)
        same = [k for k, x in enumerate(texts) if b"".join(map(self.a_bytes.__getitem__, a[k])) == x.encode() == b"".join(map(self.b_bytes.__getitem__, b[k]))]
        if same:
            for name, ids, of in (("a", a, self.a_bytes), ("b", b, self.b_bytes)):
                self.db.register(name, table := self.intervals([ids[k] for k in same], of))
                words = pc.cast(table["id"], pa.string()).combine_chunks()
                a_words, b_words = (words, None) if name == "a" else (a_words, words)
            found = self.db.sql(ALIGNED).to_arrow_table()
            e, n_a, n_b, n_overlaps = (found.column(k).to_numpy() for k in ("e", "n_a", "n_b", "n_overlaps"))
            order = [c for k in same for c in runs[k]]
            stop = np.searchsorted(e, np.cumsum([len(stretches[c].encode()) for c in order])) + 1
            sums = np.array([np.concatenate([[0], np.cumsum(n)])[stop] for n in (n_a, n_b, n_overlaps)])
            self.counts[first + np.array(order)] = np.diff(sums, axis=1, prepend=0).T
            text = grouped(a_words, b_words, n_a, n_b, stop)
            pairs = found.column("pair").to_numpy().tobytes()
            low = 0
            for c, groups, high in zip(order, text, (8 * stop).tolist()):
                self.groups[first + c] = groups
                self.pairs[first + c] = pairs[low:high]
                low = high
        bad = set(range(len(runs))).difference(same)
        return [c for k in bad if len(runs[k]) > 1 for c in runs[k]]

    @staticmethod
    def intervals(lists: list[list[int]], of: list[bytes]) -> pa.Table:
        """The token table of DuckDB: i (place), id, and the bytes s to e that a token covers, of texts end to end."""
        ids = list(chain.from_iterable(lists))
        lengths = np.array([len(of[i]) for i in ids], np.int64)
        e = np.cumsum(lengths)
        return pa.table({"i": np.arange(len(ids)), "id": np.array(ids, np.int64), "s": e - lengths, "e": e})


def aligner(byte_path: str, piece_path: str) -> Aligner:
    """One per Python worker, kept between its tasks."""
    return held(("aligner", byte_path, piece_path), lambda: Aligner(byte_path, piece_path))


NONE = np.zeros(0, np.int64)


def lists(parts: list[np.ndarray], kind: type) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate(parts).astype(kind))


ROW = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, pairs array<long>, times array<int>"


def alignments(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """ROW of each document: counts, its groups, and its linked id pairs (a << 32 | b) with how often each occurs.

    A text without tokens has zeros, '' and no pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(byte_path, piece_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [own.stretches(t) if t else [] for t in part.column("text").to_pylist()]
                counts, groups, pairs, times = [], [], [], []
                for numbers in own.numbers(texts):
                    each = own.counts[numbers]
                    if not numbers or each.min() < 0:
                        counts.append((0, 0, 0, 0, 0))
                        groups.append("")
                        pairs.append(NONE)
                        times.append(NONE)
                        continue
                    linked, often = np.unique(np.frombuffer(b"".join(map(own.pairs.__getitem__, numbers)), np.int64), return_counts=True)
                    n_a, n_b, n_overlaps = each.sum(axis=0).tolist()
                    links = int(often.sum())
                    counts.append((n_a, n_b, links, links, n_overlaps))
                    groups.append(sha256(";".join(map(own.groups.__getitem__, numbers)).encode()).hexdigest())
                    pairs.append(linked)
                    times.append(often.astype(np.int32))
                columns = [part.column("row"), part.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*counts)), pa.array(groups), lists(pairs, np.int64), lists(times, np.int32)]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in ROW.split(", ")])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    return numbered.mapInArrow(run, ROW)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(term, n, best): each linked pair of ids, how many links hold it, and whether no pair of its second id has more."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("term")).agg(F.sum("p.times").alias("n"))
    second = F.col("term").bitwiseAND(F.lit(0xFFFFFFFF))
    return each.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(second)))


def links(docs: DataFrame, byte_path: str, piece_path: str, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps.

    A is a byte-level file of the tokenizers library, encoding a space and the text; B is a SentencePiece
    model, encoding the text. Both cut before every single space between words, so
    each distinct stretch between such spaces is aligned once per worker: tasks hold the token intervals of new stretches
    in DuckDB tables, where ASOF joins find the offsets at which tokens of both end, window sums number the
    groups between them, and a range join counts overlaps. Documents add up their stretches.

    Partial counts of linked pairs are merged by a shuffle. A second pass looks up the `frequent` commonest pairs
    in a table that every task has, and all others by a join.

    Texts that are null, empty, or that either vocabulary does not spell back byte for byte give zeros and ''.
    Repeated rows and null ids come back as they came; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    aligned = written(alignments(docs, byte_path, piece_path), "aligned")
    counts = written(pair_counts(aligned), "linked-pairs")
    common = commonest(counts, frequent)
    table = counts.filter(common).orderBy("term").toPandas()
    known = spark.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("term", "n", "best")))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, n, best = known.value
        for batch in batches:
            lists = batch.column("pairs")
            pairs, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(term, pairs), max(len(term) - 1, 0))
            hit = term[at] == pairs if len(term) else np.zeros(len(pairs), bool)
            sums, top = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, owner[hit], times[hit] * n[at[hit]])
            np.add.at(top, owner[hit], times[hit] * best[at[hit]])
            rest = np.concatenate([[0], np.cumsum(np.bincount(owner[~hit], minlength=batch.num_rows))]).astype(np.int32)
            rare = [pa.ListArray.from_arrays(rest, x[~hit]) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sums), pa.array(top), *rare], ["row", "sums", "top", "pairs", "times"])

    parts = aligned.select("row", "pairs", "times").mapInArrow(resolve, "row long, sums long, top long, pairs array<long>, times array<long>")
    parts = written(parts, "pairs-by-row")
    rare = parts.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("term"), F.col("p.times").alias("times"))
    found = rare.join(counts.filter(~common), "term").select("row", (F.col("times") * F.col("n")).alias("sums"), F.when(F.col("best"), F.col("times")).otherwise(0).alias("top"))
    each = parts.select("row", "sums", "top").unionByName(found).groupBy("row").agg(F.sum("sums").alias("count_sum"), F.sum("top").alias("n_best"))
    return aligned.drop("pairs", "times").join(each, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")
