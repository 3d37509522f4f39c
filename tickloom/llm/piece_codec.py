"""SentencePiece encoding and decoding by an Aho-Corasick automaton and Viterbi.

The model file is read for its pieces, scores and types. An automaton over all pieces reports at each
position the pieces that end there, the longest first and the rest by output links; each relaxes the
best score at its end in a single pass over the text. A character that no piece covers costs a penalty
below the least score and is written as its bytes where the model has byte pieces, else as the unknown piece.
The result is the segmentation of highest summed score (of equal ones, that whose last piece is longest).

Spaces become U+2581, with one more in front, as the model asks. No piece holds that mark behind another character
(checked when the model is read), so a text is cut in front of marks and each distinct word is segmented once.
Decoding joins pieces, turns byte pieces back and drops the mark in front.

Cases: a null text has null ids, an empty one has none; repeated rows are coded alike; an
empty table gives no rows; bytes that aren't UTF-8 are decoded as U+FFFD.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import rows_of
from tickloom.llm.memory import Memory

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # types of pieces in the model file
PENALTY = 10.0  # below the least score, for an uncovered character
SKIP = (0, 0.0, -1)  # an uncovered character, in place of (characters before the last, score, id) of a piece
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
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
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, data[at : at + size]
        at += size


def coded(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Pieces:
    """A model: pieces by id, and the segmentation of texts. `most_bytes` bounds each of two generations of words remembered."""

    def __init__(self, file: str, most_bytes: int = 100 << 20):
        import public_tokenizers

        path = file if os.path.isabs(file) else public_tokenizers.path(file)
        with open(path, "rb") as f:
            data = f.read()
        self.names, self.scores, self.kinds = [], [], []
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.names.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
        self.memory = Memory(most_bytes)
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(self.names, self.kinds)) if k == BYTE}
        self.values = {i: bytes([b]) for b, i in self.bytes.items()}
        self.automaton = ahocorasick.Automaton()
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, DEFINED)]
        for i in usable:
            if MARK in self.names[i].lstrip(MARK):
                raise ValueError(f"piece {i} goes beyond a word")
            self.automaton.add_word(self.names[i], (len(self.names[i]) - 1, self.scores[i], i))
        self.automaton.make_automaton()
        self.worst = min(self.scores[i] for i in usable) - PENALTY

    def segment(self, word: str) -> list[int]:
        """Ids of the best segmentation: one pass over the pieces that end at each position."""
        worst, reached = self.worst, 0
        best, back = [0.0], [SKIP]
        for last, piece in self.automaton.iter(word):
            while reached <= last:  # an uncovered character, unless a piece is as good
                best.append(best[reached] + worst)
                back.append(SKIP)
                reached += 1
            before, score, _ = piece
            total = best[last - before] + score
            if total > best[reached] or (total == best[reached] and back[reached] is SKIP):
                best[reached], back[reached] = total, piece
        back += [SKIP] * (len(word) - reached)
        out, at = [], len(word)
        while at:
            before, _, i = back[at]
            at -= before + 1
            if i >= 0:
                out.append(i)
            else:
                raw = word[at].encode()
                out += [self.bytes[b] for b in reversed(raw)] if len(self.bytes) == 256 else [self.unknown]
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        words = WORD.findall(MARK + text.replace(" ", MARK))
        self.memory.turn()
        self.memory.add({x: coded(self.segment(x)) for x in self.memory.missing(set(words))})
        known = self.memory.now
        return b"".join([known[x] for x in words])

    def decode(self, ids: list[int]) -> str:
        out, run = [], b""
        for i in ids:
            if i in self.values:
                run += self.values[i]
                continue
            if run:
                out.append(run.decode("utf-8", errors="replace"))
                run = b""
            if self.kinds[i] == UNKNOWN:
                out.append("�")
            elif self.kinds[i] != CONTROL:
                out.append(self.names[i])
        out.append(run.decode("utf-8", errors="replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


@functools.cache
def pieces(file: str) -> Pieces:
    return Pieces(file)


def encode_texts(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every whole text."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = pieces(file).encode
        for names, values in rows_of(batches, 1 << 20, "doc_id", "text"):
            flat = [None if x is None else np.frombuffer(encode(x), "<i4") for x in values]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(flat, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(code, "doc_id long, ids array<int>")


def decode_ids(coded: DataFrame, file: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = pieces(file).decode
        for batch in batches:
            out = [decode(x.values.to_pylist()) if x.is_valid else None for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(text, "doc_id long, text string")


def coding_report(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, n_bytes_pieces, score, ids_crc32, round_trip) of every row: encoded, and decoded again."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(file)
        scores = np.array(model.scores)
        spelled = np.array([k == BYTE for k in model.kinds])
        for names, values in rows_of(batches, 1 << 20, "doc_id", "text"):
            rows = []
            for x in values:
                data = model.encode(x or "")
                ids = np.frombuffer(data, "<u4")
                rows.append((len(ids), int(spelled[ids].sum()), float(scores[ids].sum()), zlib.crc32(data), model.decode(ids.tolist()) == (x or "")))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_())
            cells = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *cells], ["doc_id", "n_pieces", "n_byte_pieces", "score", "ids_crc32", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(report, "doc_id long, n_pieces long, n_byte_pieces long, score double, ids_crc32 long, round_trip boolean")
