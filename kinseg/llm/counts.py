"""Token counts without token ids: pieces once per distinct pre-token, joined to per-document pre-token frequencies."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinseg.llm.shared import whole, written
from kinseg.llm.terms import FREQUENT, commonest, term_counts

#: Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


LETTERS = byte_letters()


def spelled(piece: str) -> str:
    """A pre-token as the vocabulary writes it."""
    return piece.encode().decode("latin-1").translate(LETTERS)


@lru_cache(maxsize=4)
def library(path: str):
    """The tokenizer of a file, loaded once per Python worker, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def specials(path: str) -> frozenset:
    return frozenset(t.content for t in library(path).get_added_tokens_decoder().values())


def pretokens(text: str, marks: frozenset) -> list[str]:
    """The pre-tokens of a text; special strings stand alone, as the library takes them by default."""
    if not any(mark in text for mark in marks):
        return PATTERN.findall(text)
    found = []
    for part in regex.split("(" + "|".join(map(regex.escape, sorted(marks, key=len, reverse=True))) + ")", text):
        found += [part] if part in marks else PATTERN.findall(part)
    return found


def piece_count(path: str):
    """Arrow function from distinct pre-tokens to the number of pieces of each."""

    @F.arrow_udf("int")
    def of(terms: pa.Array) -> pa.Array:
        model, marks = library(path).model, specials(path)
        return pa.array([1 if t in marks else len(model.tokenize(spelled(t))) for t in terms.to_pylist()], pa.int32())

    return of


def token_counts(docs: DataFrame, path: str, limit: int = 512, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    path is a byte-level BPE file of the tokenizers library. First pass: every
    distinct pre-token of the corpus with its frequency, tokenised once. Second
    pass: each document's pre-token frequencies; those of the `frequent` commonest
    are resolved on the spot, the others leave as (row, pre-token, times), are
    joined with the table and summed. Ids are never built.

    Null and empty texts count 0; repeated rows and null ids come back as they
    came; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    table = term_counts(docs, lambda text: pretokens(text, specials(path)))
    table = written(table.withColumn("pieces", piece_count(path)("term")), "pretokens")
    common = commonest(table, frequent)
    known = spark.sparkContext.broadcast({r.term: r.pieces for r in table.filter(common).select("term", "pieces").toLocalIterator()})

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, marks = known.value, specials(path)
        for batch in batches:
            rows, lengths, sums, at, rare, times = [], [], [], [], [], []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                text = text.as_py()
                total, before = 0, len(rare)
                for term, n in Counter(pretokens(text, marks)).items():
                    if (count := pieces.get(term)) is None:
                        rare.append(term)
                        times.append(n)
                    else:
                        total += n * count
                at += [row] * (len(rare) - before)
                rows.append(row)
                lengths.append(len(text.encode()))
                sums.append(total)
            n, m = len(rows), len(rare)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows + at, pa.int64()),
                    pa.concat_arrays([batch.column("doc_id").cast(pa.int64()), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([pa.array(lengths, pa.int64()), pa.nulls(m, pa.int64())]),
                    pa.array(sums + times, pa.int64()),
                    pa.concat_arrays([pa.nulls(n, pa.string()), pa.array(rare, pa.string())]),
                ],
                ["row", "doc_id", "n_bytes", "n", "term"],
            )

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    parts = written(numbered.mapInArrow(resolve, "row long, doc_id long, n_bytes long, n long, term string"), "pretokens-by-row")
    rare = parts.filter("term is not null").select("row", "term", "n")
    found = rare.join(table.filter(~common).select("term", "pieces"), "term").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    whole_rows = parts.filter("term is null").select("row", "doc_id", "n_bytes", "n")
    counted = whole_rows.join(found, "row", "left").withColumn("n_tokens", F.col("n") + F.coalesce("more", F.lit(0)))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
