"""Records of binary alignment files as Arrow columns and back, many at a time, with numpy."""

from __future__ import annotations

import re
from collections.abc import Callable
from struct import Struct, unpack_from

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed values of the format: letters of bases and operations, sizes of tags, levels of bins, each an eighth of the one above, with numbers of a level's first bin.
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
TAGS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
NUMBERS = {"c": "<i1", "C": "<u1", "s": "<i2", "S": "<u2", "i": "<i4", "I": "<u4"}
SHIFTS = {26: 1, 23: 9, 20: 73, 17: 585, 14: 4681}
CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")
#: The head of a record, its size included.
HEAD = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("ops", "<u2"), ("flag", "<u2"), ("letters", "<i4"), ("mate", "<i4"), ("mate_pos", "<i4"), ("tlen", "<i4")])
#: Whether an operation moves along the reference; the two letters of a byte, and the four bits of a letter.
ALONG = np.array([c in "MDN=X" for c in OPERATIONS])
DOUBLE = np.array([[ord(BASES[i >> 4]), ord(BASES[i & 15])] for i in range(256)], np.uint8)
CODES = np.array([BASES.index(c) if (c := chr(i).upper()) in BASES else 15 for i in range(128)] + [15] * 128, np.uint8)
#: The farthest place of a file that the place of a record holds, and the bits of its file and its block.
FILE, OFFSET = 53, 16
KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "map<string,string>": pa.map_(pa.string(), pa.string())}
#: What each column is made of: its type in Spark.
FIELDS = {
    "file": "int", "ord": "long", "stop": "long", "qname": "string", "flag": "int", "chrom": "string", "ref_idx": "int", "start": "int", "end": "int", "mapq": "int", "cigar": "string",
    "mate_ref_idx": "int", "mate_start": "int", "tlen": "int", "seq": "string", "qual": "string", "tags": "map<string,string>",
}


def tags(data: bytes, at: int) -> dict[str, str]:
    """Tags with their values as text, the first of equal names."""
    out: dict[str, str] = {}
    while at + 3 <= len(data):
        name, kind, at = data[at : at + 2].decode(), chr(data[at + 2]), at + 3
        if kind in "ZH":
            end = data.index(0, at)
            value, at = data[at:end].decode(), end + 1
        elif kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind == "B":
            inner, n = chr(data[at]), unpack_from("<i", data, at + 1)[0]
            form = Struct("<" + TAGS[inner][1] * n)
            value = ",".join([inner, *(f"{x:g}" if inner == "f" else str(x) for x in form.unpack_from(data, at + 5))])
            at += 5 + form.size
        else:
            form = Struct(TAGS[kind])
            x = form.unpack_from(data, at)[0]
            value, at = f"{x:g}" if kind == "f" else str(x), at + form.size
        out.setdefault(name, value)
    return out


def before(lengths: np.ndarray) -> np.ndarray:
    """0 and the running sums of lengths."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all stretches, one stretch after another."""
    at = before(lengths)
    return np.arange(at[-1]) + np.repeat(starts - at[:-1], lengths)


def strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The stretches of data as strings; an error where they are no text."""
    out = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(before(lengths).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
    out.validate(full=True)
    return out


def stretched(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of strings without nulls, and the length of each."""
    column = pa.array(column.to_pylist(), pa.string()) if column.offset else column.cast(pa.string())
    if column.null_count:
        raise ValueError("a text is missing")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1) if offsets else np.zeros(1, np.int32)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], np.diff(at).astype(np.int64)


def starred(column: pa.Array, absent: np.ndarray) -> pa.Array:
    return pc.if_else(pa.array(absent), pa.scalar("*"), column) if absent.any() else column


def tag_column(text: bytes, raw: np.ndarray, at: np.ndarray, end: np.ndarray) -> pa.Array:
    """The tags of each record as a map: a tag of all records at a time; records with lists, fractions or equal names one by one."""
    zeros = np.flatnonzero(raw == 0)
    found: list[tuple[np.ndarray, ...]] = []
    extra, size = [raw], len(raw)
    alone = np.zeros(len(at), bool)
    live, at_tag = np.arange(len(at)), at.copy()
    while len(live := live[at_tag[live] + 3 <= end[live]]):
        names, kinds = at_tag[live], raw[at_tag[live] + 2]
        after, place, length = np.full(len(live), -1), names + 3, np.ones(len(live), np.int64)
        letters = np.isin(kinds, [ord("Z"), ord("H")])
        if letters.any():
            where = np.searchsorted(zeros, place[letters])
            stop = zeros[np.minimum(where, len(zeros) - 1)] if len(zeros) else np.zeros(len(where), np.int64)
            stop = np.where((where < len(zeros)) & (stop < end[live][letters]), stop, -2)
            length[letters], after[letters] = np.maximum(stop - place[letters], 0), stop + 1
        one = kinds == ord("A")
        # A letter above 127 is two bytes as text.
        one &= raw[np.minimum(place, len(raw) - 1)] < 128
        after[one] = place[one] + 1
        for kind, form in NUMBERS.items():
            width = np.dtype(form).itemsize
            whole = (kinds == ord(kind)) & (names + 3 + width <= end[live])
            if whole.any():
                values = np.ascontiguousarray(raw[place[whole][:, None] + np.arange(width)]).view(form)[:, 0]
                written, lengths = stretched(pa.array(values).cast(pa.string()))
                after[whole] = place[whole] + width
                place[whole], length[whole] = size + before(lengths)[:-1], lengths
                extra.append(written)
                size += len(written)
        good = (after > 0) & (after <= end[live])
        alone[live[~good]] = True
        live = live[good]
        found.append((live, names[good], place[good], length[good]))
        at_tag[live] = after[good]
    row, name, place, length = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found) if found else [[]] * 4))
    order = np.argsort(row, kind="stable")
    row, name, place, length = row[order], name[order], place[order], length[order]
    code = (row.astype(np.int64) << 16) | (raw[name].astype(np.int64) << 8) | raw[name + 1] if len(row) else row
    if len(code):
        same = np.sort(code)
        alone[same[1:][same[1:] == same[:-1]] >> 16] = True
    if alone.any():
        own = ~alone[row]
        parts = [(row[own], name[own], np.full(own.sum(), 2), place[own], length[own])]
        for i in np.flatnonzero(alone).tolist():
            for key, value in tags(text[at[i] : end[i]], 0).items():
                written = [key.encode(), value.encode()]
                parts.append(tuple(np.array([x]) for x in (i, size, len(written[0]), size + len(written[0]), len(written[1]))))
                extra.append(np.frombuffer(b"".join(written), np.uint8))
                size += len(extra[-1])
        row, name, wide, place, length = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(row, kind="stable")
        row, name, wide, place, length = row[order], name[order], wide[order], place[order], length[order]
    else:
        wide = np.full(len(row), 2)
    pool = np.concatenate(extra) if len(extra) > 1 else raw
    offsets = before(np.bincount(row, minlength=len(at))).astype(np.int32)
    return pa.MapArray.from_arrays(pa.array(offsets), strings(pool[spread(name, wide)], wide), strings(pool[spread(place, length)], length))


def columns(text: bytes, places: np.ndarray, here: np.ndarray, after: np.ndarray, file: int, names: list[str], wanted: list[str]) -> pa.RecordBatch:
    """The wanted columns of FIELDS of the records that begin at places of the text; here, after: the place of each in the file, and of what follows it.

    What the text form writes as * is *.
    """
    raw = np.frombuffer(text, np.uint8)
    h = np.ascontiguousarray(raw[places[:, None] + np.arange(HEAD.itemsize)]).view(HEAD)[:, 0]
    name, ops, letters = (h[c].astype(np.int64) for c in ("name", "ops", "letters"))
    known = lambda x: pa.array(x.copy(), mask=x < 0)
    at_ops = places + HEAD.itemsize + name
    at_seq = at_ops + 4 * ops
    half = (letters + 1) // 2
    at_qual = at_seq + half
    behind = at_qual + letters
    if (behind > places + 4 + h["size"]).any() or (h["ref"] >= len(names)).any():
        raise ValueError("a record does not fit its own size, or lies on a contig that the file does not name")

    def operations() -> np.ndarray:
        return raw[spread(at_ops, 4 * ops)].view("<u4")

    def end() -> pa.Array:
        each = operations()
        along = before(np.where(ALONG[each & 15], each >> 4, 0))
        at = before(ops)
        return pa.array((h["pos"] + along[at[1:]] - along[at[:-1]]).astype(np.int32))

    def cigar() -> pa.Array:
        kinds, which = np.unique(operations(), return_inverse=True)
        written = pa.array([f"{x >> 4}{OPERATIONS[x & 15]}" for x in kinds.tolist()], pa.string()).take(pa.array(which.ravel()))
        return starred(pc.binary_join(pa.ListArray.from_arrays(pa.array(before(ops).astype(np.int32)), written), ""), ops == 0)

    def seq() -> pa.Array:
        flat = DOUBLE[raw[spread(at_seq, half)]].ravel()
        odd = letters % 2 == 1
        if odd.any():
            kept = np.ones(len(flat), bool)
            kept[2 * before(half)[1:][odd] - 1] = False
            flat = flat[kept]
        return starred(strings(flat, letters), letters == 0)

    def qual() -> pa.Array:
        absent = (letters == 0) | (raw[np.minimum(at_qual, len(raw) - 1)] == 255)
        lengths = np.where(absent, 0, letters)
        flat = raw[spread(at_qual, lengths)]
        if (flat > 94).any():
            raise ValueError("a quality is no letter")
        return starred(strings(flat + 33, lengths), absent)

    made: dict[str, Callable[[], pa.Array]] = {
        "file": lambda: pa.array(np.full(len(places), file, np.int32)),
        "ord": lambda: pa.array(here | file << FILE),
        "stop": lambda: pa.array(after | file << FILE),
        "qname": lambda: strings(raw[spread(places + HEAD.itemsize, name - 1)], name - 1),
        "flag": lambda: pa.array(h["flag"].astype(np.int32)),
        "chrom": lambda: pa.array([*names, "*"], pa.string()).take(pa.array(np.where(h["ref"] >= 0, h["ref"], len(names)))),
        "ref_idx": lambda: known(h["ref"]),
        "start": lambda: pa.array(h["pos"] + 1),
        "end": end,
        "mapq": lambda: pa.array(h["mapq"].astype(np.int32)),
        "cigar": cigar,
        "mate_ref_idx": lambda: known(h["mate"]),
        "mate_start": lambda: pa.array(h["mate_pos"] + 1),
        "tlen": lambda: pa.array(h["tlen"].copy()),
        "seq": seq,
        "qual": qual,
        "tags": lambda: tag_column(text, raw, behind, places + 4 + h["size"]),
    }
    return pa.RecordBatch.from_arrays([made[c]().cast(KINDS[FIELDS[c]]) if c != "tags" else made[c]() for c in wanted], wanted)


def bins(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The smallest bin that holds each 0-based half-open interval."""
    out = np.zeros(len(low), np.int64)
    for shift, first in SHIFTS.items():
        out = np.where(low >> shift == (high - 1) >> shift, first + (low >> shift), out)
    return out


def encoded(batch: pa.RecordBatch, names: list[str]) -> bytes:
    """The records of a batch (qname, flag, chrom, start, mapq, cigar, mate_ref_idx, mate_start, tlen, seq, qual, tags), one after another.

    Tags are written as text, and places that are null as absent.
    """
    of = {c: batch.column(c) for c in batch.schema.names}
    number = lambda c, absent: of[c].fill_null(absent).to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(batch)
    name, name_length = stretched(of["qname"])
    ref = pc.index_in(of["chrom"], pa.array(names, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    start = number("start", 0)

    coded = pc.dictionary_encode(of["cigar"].fill_null("*").cast(pa.string()))
    each = [np.array([int(k) << 4 | OPERATIONS.index(op) for k, op in CIGAR.findall(c)], "<u4") for c in coded.dictionary.to_pylist()]
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    count = np.array([len(x) for x in each], np.int64)
    ops = count[which] if n else np.zeros(0, np.int64)
    written = (np.concatenate(each) if each else np.zeros(0, "<u4"))[spread(before(count)[:-1][which], ops)] if n else np.zeros(0, "<u4")
    along = np.array([max(1, int((x >> 4)[ALONG[x & 15]].sum())) for x in each], np.int64)
    span = along[which] if n else ops

    plain = pc.if_else(pc.equal(of["seq"], "*"), "", of["seq"]).fill_null("")
    seq, letters = stretched(plain)
    if (seq > 127).any():
        seq, letters = stretched(pa.array([s.upper().encode("ascii", "replace").decode() for s in plain.to_pylist()], pa.string()))
    half = (letters + 1) // 2
    nibbles = np.zeros(2 * int(half.sum()), np.uint8)
    nibbles[spread(2 * before(half)[:-1], letters)] = CODES[seq]
    quality = of["qual"].fill_null("*")
    absent = pc.equal(quality, "*").to_numpy(zero_copy_only=False)
    given, lengths = stretched(pc.if_else(pa.array(absent), "", quality))
    # A single base of quality 9 is written as the star of none.
    if (lengths[~absent] != letters[~absent]).any() or (given < 33).any() or (given > 127).any():
        raise ValueError("qualities are as many as letters, from ! on")
    qual = np.full(int(letters.sum()), 255, np.uint8)
    qual[spread(before(letters)[:-1], lengths)] = given - 33

    held = of["tags"]
    if held.offset:
        held = pa.array(held.to_pylist(), held.type)
    at = held.offsets.to_numpy()
    keys, key_length = stretched(held.keys[at[0] : at[-1]].cast(pa.string()))
    values, value_length = stretched(held.items[at[0] : at[-1]].cast(pa.string()))
    if (key_length != 2).any():
        raise ValueError("names of tags are two letters")
    whole = value_length + 4
    own = np.zeros(int(whole.sum()), np.uint8)
    first = before(whole)[:-1]
    own[spread(first, key_length)] = keys
    own[first + 2] = ord("Z")
    own[spread(first + 3, value_length)] = values
    tag_length = np.diff(before(whole)[at - at[0]])

    h = np.zeros(n, HEAD)
    size = 32 + name_length + 1 + 4 * ops + half + letters + tag_length
    held_in = {
        "size": size, "ref": ref, "pos": start - 1, "name": name_length + 1, "mapq": number("mapq", 0), "bin": bins(start - 1, start - 1 + span) & 0xFFFF, "ops": ops, "flag": number("flag", 0),
        "letters": letters, "mate": number("mate_ref_idx", -1), "mate_pos": number("mate_start", 0) - 1, "tlen": number("tlen", 0),
    }
    for field, value in held_in.items():
        bounds = np.iinfo(HEAD[field])
        if n and (value.min() < bounds.min or value.max() > bounds.max):
            raise ValueError(f"{field} does not fit a record")
        h[field] = value
    out = np.zeros(int((4 + size).sum()), np.uint8)
    begin = before(4 + size)[:-1]
    out[(begin[:, None] + np.arange(HEAD.itemsize)).ravel()] = h.view(np.uint8)
    begin = begin + HEAD.itemsize
    for data, lengths in ((name, name_length), (written.view(np.uint8), 4 * ops), (nibbles[::2] << 4 | nibbles[1::2], half), (qual, letters), (own, tag_length)):
        out[spread(begin, lengths)] = data
        begin = begin + lengths + (data is name)
    return out.tobytes()
