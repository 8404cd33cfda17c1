"""SentencePiece models on the tokenizers library: the model file parsed, rebuilt, and checked against the original library."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from struct import pack, unpack, unpack_from
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinseg.llm.shared import Recent, held, whole

MARK = "▁"
#: Piece types and model types of the model file.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
#: A run of markers and what follows up to the next; no piece reaches across its end.
CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: The same, cut at line ends as well, where no piece holds one beside other characters.
LINES = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n+")
#: A marker behind another character, which lets a piece reach across the end of a chunk.
INNER = re.compile(f"[^{MARK}]{MARK}")
THREADS = 2
#: The original library encodes one in so many texts as a whole, too: every one.
WHOLE = 1
#: A worker keeps the ids of so many distinct chunks, for two generations.
KEPT = 450_000


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protobuf message; nested messages and strings stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        elif wire == 2:
            size = varint()
            yield number, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[wire]
            yield number, unpack_from("<d" if wire == 1 else "<f", data, at)[0]
            at += size


def parsed(data: bytes) -> dict:
    """pieces [(text, score, type)], model type and normaliser settings of a model file."""
    pieces, trainer, normaliser = [], {}, {}
    for number, value in fields(data):
        if number == 1:
            own = dict(fields(value))
            pieces.append((own[1].decode(), own.get(2, 0.0), own.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
        elif number == 3:
            normaliser = dict(fields(value))
    if trainer.get(24, 0) or not normaliser.get(5, 1):
        raise ValueError("markers must stand before words, in place of spaces")
    own = {text: i for i, (text, _, kind) in enumerate(pieces) if kind == USER}
    if own and normaliser.get(2):
        raise ValueError("user-defined pieces that a character map leaves alone are not known")
    return {
        "atoms": own if trainer.get(3, UNIGRAM) == BPE else {},
        "pieces": pieces,
        "inner": any(kind == NORMAL and INNER.search(text) for text, _, kind in pieces),
        "type": trainer.get(3, UNIGRAM),
        "byte_fallback": bool(trainer.get(35, 0)),
        "charsmap": normaliser.get(2, b""),
        "dummy_prefix": bool(normaliser.get(3, 1)),
        "squeeze": bool(normaliser.get(4, 1)),
    }


def merges(pieces: list[tuple]) -> list[tuple[str, str]]:
    """Merges of a BPE model from its scores: every split of a piece into two pieces, best pieces first."""
    ids = {text: i for i, (text, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
    found = []
    for text, i in ids.items():
        for cut in range(1, len(text)):
            if (left := ids.get(text[:cut])) is not None and (right := ids.get(text[cut:])) is not None:
                found.append((-pieces[i][1], left, right, text[:cut], text[cut:]))
    return [(x[3], x[4]) for x in sorted(found)]


def rebuilt(data: bytes):
    """(tokenizers.Tokenizer that does what the model file says, chunk by chunk; the model's settings).

    Pieces that no text can spell (control, unknown, byte) get a name with a space before it, which the
    normaliser leaves in no text. That rules out the library's own byte fallback for unigrams, whose
    unknown tokens therefore go to spelt().
    """
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    spec = parsed(data)
    pieces = spec["pieces"]
    unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), None)
    if spec["type"] == UNIGRAM:
        scores = [score for _, score, kind in pieces if kind == NORMAL] or [0.0]
        # A user-defined piece of n bytes scores a little less than n of the best pieces.
        score_of = {NORMAL: lambda text, score: (text, score), USER: lambda text, _: (text, len(text.encode()) * max(scores) - 0.1)}
        rows = [score_of.get(kind, lambda text, _: (f" {text}", min(scores)))(text, score) for text, score, kind in pieces]
        model = models.Unigram(rows, unk_id=unknown, byte_fallback=False)
    elif spec["type"] == BPE:
        model = models.BPE({text: i for i, (text, _, _) in enumerate(pieces)}, merges(pieces), unk_token=pieces[unknown][0] if unknown is not None else None, fuse_unk=True, byte_fallback=spec["byte_fallback"])
    else:
        raise ValueError("only unigram and BPE models are known")
    tokenizer = Tokenizer(model)
    steps = [normalizers.Precompiled(spec["charsmap"])] if spec["charsmap"] else []
    if spec["squeeze"]:
        steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if not spec["inner"]:
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    tokenizer.decoder = decoders.Sequence([decoders.Strip(" ", 1, 0), decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    return tokenizer, spec


def spelt(ids: list[int], tokens: list[str], unknown: int, first_byte: int) -> list[int]:
    """ids with the bytes of each unknown token in its place."""
    out: list[int] = []
    for i, token in zip(ids, tokens):
        out.extend((first_byte + b for b in token.encode()) if i == unknown else (i,))
    return out


class Codec(Recent):
    """Maps a chunk to its ids as unsigned 32-bit bytes; `lossy` holds chunks that do not decode to themselves, `bad` those the original library encodes otherwise (unless it is given all whole texts)."""

    def __init__(self, path: str, threads: int = THREADS):
        super().__init__(KEPT)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as file:
            self.tokenizer, self.spec = rebuilt(file.read())
        self.original = SentencePieceProcessor(model_file=path)
        self.prefix = MARK if self.spec["dummy_prefix"] else ""
        self.normalises = bool(self.spec["squeeze"] or self.spec["charsmap"])
        kinds = [kind for _, _, kind in self.spec["pieces"]]
        #: Texts of pieces; those that stand for something else begin with a space, which no chunk holds.
        self.texts = [text if kind in (NORMAL, USER) and not text.startswith("<0x") else f" {text}" for text, _, kind in self.spec["pieces"]]
        self.bytes = [pack("<I", i) for i in range(len(kinds))]
        lines = self.spec["type"] == BPE and self.spec["byte_fallback"] and kinds.count(BYTE) == 256
        self.lines = lines and not any("\n" in text and text != "\n" for text in self.texts)
        self.first_byte = kinds.index(BYTE) if BYTE in kinds else None
        spells = self.spec["type"] == UNIGRAM and self.spec["byte_fallback"] and self.first_byte is not None
        self.unknown = kinds.index(UNKNOWN) if spells and UNKNOWN in kinds else None
        atoms = {a: np.array([i], "<u4").tobytes() for a, i in self.spec["atoms"].items()}
        self.atoms = atoms
        self.split = re.compile("|".join(map(re.escape, sorted(atoms, key=len, reverse=True)))) if atoms else None
        #: Chunks after an atom or a line end have no text of their own that the original could encode: whole texts are compared then.
        self.whole = 1 if atoms or self.lines else WHOLE
        self.bad: set[str] = set()
        self.lossy: set[str] = set()
        self.update(atoms)

    def normal(self, text: str) -> str:
        """The text as the model's normaliser leaves it, spaces as markers, without the dummy prefix."""
        return self.tokenizer.normalizer.normalize_str(text) if self.normalises else text.replace(" ", MARK)

    def pieces_of(self, text: str) -> list[str]:
        if self.spec["inner"] and text:
            return [text]
        if self.lines and MARK * 2 not in text and "\0" not in text:  # as the pattern cuts, with empty chunks between
            return text.replace(MARK, f"\0{MARK}").replace("\n", "\0\n\0").split("\0")
        return (LINES if self.lines else CHUNK).findall(text)

    def chunks(self, text: str) -> list[str]:
        """What is encoded apart: user-defined pieces, and what lies between, cut before markers where no piece has one inside."""
        text = self.normal(text)
        if not text:
            return []
        text = self.prefix + text
        if self.split is None:
            return self.pieces_of(text)
        out, at = [], 0
        for found in self.split.finditer(text):
            out += [*self.pieces_of(text[at : found.start()]), found.group()]
            at = found.end()
        return out + self.pieces_of(text[at:])

    def learn(self, chunks: set[str]) -> None:
        """Encode what is not known yet, and check it: merges by the model alone, as chunks are normalised and cut, unigrams in one multithreaded batch."""
        if len(self) > self.kept:
            self.before = dict(self)
            self.clear()
            self.update(self.atoms)
        new = [c for c in chunks if c not in self]
        if self.before:
            self.update((c, self.before[c]) for c in new if c in self.before)
            new = [c for c in new if c not in self]
        if not new:
            return
        if self.spec["type"] == BPE:
            tokens = self.tokenizer.model.tokenize
            found = ([t.id for t in tokens(c)] for c in new)
        else:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            if self.unknown is not None and any(self.unknown in ids for ids in found):
                made = self.tokenizer.encode_batch(new, add_special_tokens=False)  # the fast way keeps no strings
                found = [spelt(ids, e.tokens, self.unknown, self.first_byte) if self.unknown in ids else ids for ids, e in zip(found, made)]
        bytes_of, text_of, other = self.bytes.__getitem__, self.texts.__getitem__, []
        for chunk, ids in zip(new, found):
            self[chunk] = b"".join(map(bytes_of, ids))
            if "".join(map(text_of, ids)) != chunk:
                other.append((chunk, ids))
        # Pieces that join to their chunk decode to it; the library decodes the others.
        for (chunk, _), back in zip(other, self.tokenizer.decode_batch([ids for _, ids in other], skip_special_tokens=False)):
            if back != chunk.replace(MARK, " "):
                self.lossy.add(chunk)
        if self.whole > 1:
            self.compare(new, [unpack(f"<{len(self[c]) // 4}I", self[c]) for c in new])

    def compare(self, chunks: list[str], found: list[tuple[int, ...]]) -> None:
        n = len(self.prefix)
        plain = [c[n:].replace(MARK, " ") for c in chunks]
        for chunk, ids, text, other in zip(chunks, found, plain, self.original.encode(plain, num_threads=1)):
            if not text:  # a marker at the end of a text, which the original adds to no empty one
                other = self.original.encode("\n ")[len(self.original.encode("\n")) :]
            if list(ids) != other:
                self.bad.add(chunk)

    def differs(self, texts: list[str], ids: list[bytes]) -> list[bool | None]:
        """For each text, whether the original library encodes it as a whole to other ids; None where not compared."""
        asked = [i for i, x in enumerate(ids) if crc32(x) % self.whole == 0]
        out: list[bool | None] = [None] * len(texts)
        for i in asked:
            out[i] = self.original.encode_as_numpy(texts[i]).astype("<u4").tobytes() != ids[i]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.chunks(t) for t in texts]
        self.learn(set().union(*cut) if cut else set())
        return [b"".join(map(self.__getitem__, c)) for c in cut]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of id lists, in one multithreaded batch, the dummy prefix taken off."""
        n = len(self.prefix)
        return [t[n:] if n and t.startswith(" ") else t for t in self.tokenizer.decode_batch(ids, skip_special_tokens=False)]


def codec(path: str) -> Codec:
    return held(("codec", path), lambda: Codec(path))


def encode_column(text: Column, path: str) -> Column:
    """array<int> of ids; of a null or empty text the empty array."""

    @F.arrow_udf("array<int>")
    def of(texts: pa.Array) -> pa.Array:
        found = codec(path).encode([t or "" for t in texts.to_pylist()])
        ends = np.cumsum([0, *(len(f) // 4 for f in found)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32), pa.int32()))

    return of(text)


def decode_column(ids: Column, path: str) -> Column:
    """Text of an array of ids; of a null one the empty text."""

    @F.arrow_udf("string")
    def of(lists: pa.Array) -> pa.Array:
        return pa.array(codec(path).decode([x or [] for x in lists.to_pylist()]), pa.string())

    return of(ids)


def digests(docs: DataFrame, path: str, block: int = 500) -> DataFrame:
    """One row per document: doc_id, n_ids, n_byte_ids, ids_crc32 (of little-endian unsigned 32-bit ids), round_trip, parity.

    round_trip: the ids decode to the text, or to what the model's normaliser leaves of it. parity: whether the
    original library, given the whole text, gives the same ids; every text is compared. Null and empty texts have no ids;
    repeated rows and null ids come back as they came; an empty table gives no rows. Other columns are ignored.
    """
    names = ["n_ids", "n_byte_ids", "ids_crc32", "round_trip", "parity"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]

    @F.arrow_udf("struct<n_ids:bigint,n_byte_ids:bigint,ids_crc32:bigint,round_trip:boolean,parity:boolean>")
    def of(texts: pa.Array) -> pa.Array:
        own, rows = codec(path), []
        low = -256 if own.first_byte is None else own.first_byte
        for start in range(0, len(texts), block):
            part = [t or "" for t in texts.slice(start, block).to_pylist()]
            encoded = own.encode(part)
            for text, ids, other in zip(part, encoded, own.differs(part, encoded)):
                numbers = np.frombuffer(ids, "<u4")
                chunks = set(own.chunks(text)) if own.bad or own.lossy else set()
                rows.append((len(numbers), int(((numbers >= low) & (numbers < low + 256)).sum()) if low >= 0 else 0, crc32(ids), not chunks & own.lossy and MARK not in text, False if other or chunks & own.bad else None if other is None else True))
        columns = zip(*rows) if rows else [()] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.select("doc_id", of(whole("text")).alias("d")).select("doc_id", "d.*")
