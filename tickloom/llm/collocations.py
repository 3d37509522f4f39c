"""Phrase collocations by Rabin-Karp fingerprints.

A text is cut into pieces and words; each n-gram inside a piece gets the fingerprint that a prefix
polynomial over its words gives, salted with its language. Fingerprints are counted first, level by
level: words, then pairs of words that may be frequent, then longer phrases whose pairs all may be.
What may be frequent is told by a bit table of bounded size, so a crowded table costs time and
never rows. Only then are phrases materialised: texts are read once more, occurrences whose
fingerprint is frequent are checked word by word against the first of their batch, and counted by
their text. A fingerprint shared by two phrases therefore costs a row and never changes a count.

Cases: a null text is empty; a null language is `und`; texts without words, and pieces of one word,
have no phrases (their words still count in n); repeated rows count each time; numbers of documents
may be null or repeat (`first_doc` is the smallest number, null if there is none); other columns are
ignored whatever their names; an empty table, or one without frequent phrases, gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import mix, payload
from tickloom.session import cut_lineage

BASE = 0x9E3779B97F4A7C15
SEGMENT = 2 << 20
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
LETTER, SPACE, MARK = 0, 1, 2
KIND = np.full(256, LETTER, np.uint8)
KIND[[0x20, 0x09]] = SPACE
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = MARK
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
TOP_SALTS = 64


class Powers:
    """BASE to the powers from 0 on and their inverses, modulo 2 ** 64; the tables grow to the longest sequence met."""

    tables = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    @classmethod
    def up_to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.tables[0]) < n:
            size = 1 << n.bit_length()
            grown = []
            for factor in (BASE, pow(BASE, -1, 1 << 64)):
                power = np.full(size, factor, np.uint64)
                power[0] = 1
                grown.append(np.cumprod(power, out=power))
            cls.tables = tuple(grown)
        return cls.tables


class Prefixes:
    """Prefix polynomials of a sequence of values: the hash of every part in constant time."""

    def __init__(self, values: np.ndarray):
        up, self.down = Powers.up_to(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def parts(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(BASE))


def string_values(strings: pa.Array) -> np.ndarray:
    """A 64-bit value of every string, from its bytes."""
    raw, at = payload(strings)
    return Prefixes(raw.astype(np.uint64) + np.uint64(1)).parts(at[:-1], at[1:])


class Segment(NamedTuple):
    """Words of some documents in order: numbers in `vocabulary`, and the piece and the document of each."""

    words: np.ndarray
    vocabulary: pa.Array
    piece: np.ndarray
    doc: np.ndarray


def segments(column: pa.Array, most_bytes: int = SEGMENT) -> Iterator[Segment]:
    """The words of all texts of a batch, in segments of about `most_bytes` that end between pieces."""
    raw, at = payload(column)
    if not len(raw):
        return
    low, kind = LOWER[raw], KIND[raw]
    first = np.zeros(len(raw) + 1, bool)  # a document starts here
    first[at[:-1]] = True
    cuts = np.flatnonzero((kind == MARK) | first[:-1])
    ends = np.unique(np.append(cuts[np.minimum(np.searchsorted(cuts, np.arange(most_bytes, len(raw), most_bytes)), len(cuts) - 1)], len(raw)))
    begin = 0
    for end in ends[ends > 0].tolist():
        part = slice(begin, end)
        letter = kind[part] == LETTER
        opens = letter.copy()
        opens[1:] &= ~letter[:-1] | first[begin + 1 : end]
        starts = np.flatnonzero(opens)
        if len(starts):
            text = np.ascontiguousarray(low[part][letter])
            before = np.cumsum(letter, dtype=np.int32)
            edges = np.append(before[starts] - 1, len(text)).astype(np.int32)
            coded = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(text)]).dictionary_encode()
            doc = np.searchsorted(at, begin + starts, side="right") - 1
            marks = np.cumsum(kind[part] == MARK, dtype=np.int32)[starts]
            yield Segment(coded.indices.to_numpy().astype(np.int64), coded.dictionary, marks + doc, doc)
        begin = end


class BitTable:
    """Which fingerprints may be in a set: two places of each in a table of bits."""

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.size = bits, size

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for half in (keys & np.uint64(0xFFFFFFFF), keys >> np.uint64(32)):
            place = (half % np.uint64(self.size)).astype(np.int64)
            out &= (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        return out


def bit_table(frequent: DataFrame) -> BitTable:
    """The bit table of all `fp`; Spark ORs the bits, so at most MOST_BITS / 64 rows reach the driver."""
    size = min(max(1 << (16 * frequent.count()).bit_length(), LEAST_BITS), MOST_BITS)
    low, high = F.expr("fp & 4294967295L"), F.shiftrightunsigned("fp", 32)
    place = F.explode(F.array(low % size, high % size)).alias("place")
    rows = frequent.select(place).groupBy((F.col("place") / 64).cast("long").alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits")).toArrow()
    table = np.zeros(size // 64, np.int64)
    table[rows["slot"].to_numpy()] = rows["bits"].to_numpy()
    return BitTable(table.view(np.uint8), size)


class Grams:
    """Fingerprints of the n-grams of a segment; those of `width` bits make collisions likely in tests."""

    def __init__(self, segment: Segment, salts: np.ndarray, width: int):
        self.segment = segment
        self.prefixes = Prefixes(string_values(segment.vocabulary)[segment.words])
        self.salts, self.mask = salts[segment.doc], np.uint64((1 << width) - 1)

    def starts(self, m: int) -> np.ndarray:
        """Words from which a phrase of m words lies within a piece."""
        piece = self.segment.piece
        return np.flatnonzero(piece[: len(piece) - m + 1] == piece[m - 1 :]) if len(piece) >= m else np.zeros(0, np.int64)

    def keys(self, starts: np.ndarray, m: int) -> np.ndarray:
        return mix(self.prefixes.parts(starts, starts + m) ^ self.salts[starts]) & self.mask

    def known(self, m: int, table: BitTable) -> np.ndarray:
        """For every word, whether a phrase of m words that may be frequent starts there."""
        out, starts = np.zeros(len(self.segment.words), bool), self.starts(m)
        out[starts[table.holds(self.keys(starts, m))]] = True
        return out


def grouped(keys: np.ndarray, tuples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first occurrence, group of each occurrence) by key; where a key has several tuples, by tuple."""
    _, first, group = np.unique(keys, return_index=True, return_inverse=True)
    if (tuples[:, first[group]] != tuples).any():
        _, first, group = np.unique(tuples, axis=1, return_index=True, return_inverse=True)
    return first, group.reshape(-1)


def languages(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(language of each row, salt of each row); null is `und`."""
    named = pc.fill_null(column.cast(pa.string()), "und").dictionary_encode()
    return named, string_values(named.dictionary)[named.indices.to_numpy()]


def counted(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...], table, below: int, width: int) -> Iterator[pa.RecordBatch]:
    """Fingerprints of phrases of `sizes` words, of which all parts of `below` words may be frequent, with counts.

    Without a table, words: then there is a row per language too, without fingerprint, with its number of words.
    """
    for batch in batches:
        named, salts = languages(batch.column(0))
        total = np.zeros(len(named.dictionary), np.int64)
        for segment in segments(batch.column(1)):
            grams = Grams(segment, salts, width)
            good = None if table is None else grams.known(below, table.value)
            keys = []
            for m in sizes:
                starts = grams.starts(m)
                for i in range(0 if good is None else m - below + 1):
                    starts = starts[good[starts + i]]
                keys.append(grams.keys(starts, m))
            fp, count = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.record_batch({"lang": pa.nulls(len(fp), pa.string()), "fp": fp.view(np.int64), "c": count})
            if table is None:
                total += np.bincount(named.indices.to_numpy()[segment.doc], minlength=len(total))
        if table is None:
            yield pa.record_batch({"lang": named.dictionary, "fp": pa.nulls(len(total), pa.int64()), "c": total})


def materialised(batches: Iterator[pa.RecordBatch], longest: int, table, width: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, words, c, first_doc) of the phrases of a segment whose fingerprint may be frequent."""
    for batch in batches:
        named, salts = languages(batch.column(0))
        lang = named.indices.to_numpy()
        names = batch.column(2)
        number = pc.fill_null(names, np.iinfo(np.int64).max).to_numpy()
        for segment in segments(batch.column(1)):
            grams = Grams(segment, salts, width)
            for m in range(1, longest + 1):
                starts = grams.starts(m)
                keys = grams.keys(starts, m)
                chosen = table.value.holds(keys)
                starts, keys = starts[chosen], keys[chosen]
                if not len(starts):
                    continue
                doc = segment.doc[starts]
                first, group = grouped(keys, np.stack([lang[doc], *[segment.words[starts + i] for i in range(m)]]))
                smallest = np.full(len(first), np.iinfo(np.int64).max)
                np.minimum.at(smallest, group, number[doc])
                words = [segment.vocabulary.take(pa.array(segment.words[starts[first] + i])) for i in range(m)]
                yield pa.record_batch(
                    {
                        "lang": named.dictionary.take(pa.array(lang[doc[first]])),
                        "phrase": pc.binary_join_element_wise(*words, " ") if m > 1 else words[0],
                        "words": np.full(len(first), m, np.int32),
                        "c": np.bincount(group, minlength=len(first)),
                        "first_doc": pa.array(smallest, mask=smallest == np.iinfo(np.int64).max),
                    }
                )


def frequent_phrases(docs: DataFrame, longest: int, least: int, id_col: str, text_col: str, lang_col: str, width: int = 64) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f, first_doc) of all phrases of f >= `least`, (lang, n))."""
    context = docs.sparkSession.sparkContext
    narrow = docs.select(
        F.col(f"`{lang_col}`").cast("string").alias("lang"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
    )

    def level(sizes: tuple[int, ...], table, below: int) -> DataFrame:
        found = narrow.select("lang", "text").mapInArrow(lambda batches: counted(batches, sizes, table, below, width), "lang string, fp long, c long")
        kept = found.groupBy("lang", "fp").agg(F.sum("c").alias("c")).where((F.col("c") >= least) | F.col("fp").isNull())
        return cut_lineage(kept, "phrases")

    words = level((1,), None, 0)
    frequent = [words.where(F.col("fp").isNotNull())]
    for below, sizes in ((1, (2,)), (2, tuple(range(3, longest + 1)))):
        if longest > below and sizes:
            frequent.append(level(sizes, context.broadcast(bit_table(frequent[-1])), below))
    table = context.broadcast(bit_table(functools.reduce(DataFrame.union, frequent)))
    texts = narrow.mapInArrow(lambda batches: materialised(batches, longest, table, width), "lang string, phrase string, words int, c long, first_doc long")
    phrases = texts.groupBy("lang", "phrase", "words").agg(F.sum("c").alias("f"), F.min("first_doc").alias("first_doc"))
    return cut_lineage(phrases.where(F.col("f") >= least), "phrases"), words.where(F.col("fp").isNull()).select("lang", F.col("c").alias("n"))


def part(first: int | Column, count: int | Column) -> Column:
    return F.array_join(F.slice("all", first, count), " ")


def collocations(
    docs: DataFrame,
    longest: int = 4,
    least: int = 30,
    top: int = 2000,
    share: int = 80,
    scale: int = 2_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    width: int = 64,
) -> DataFrame:
    """The `top` phrases of every language: lang, rank, phrase, a, l, r, n, score, first_doc.

    A phrase of 2 to `longest` words that occurs a >= `least` times scores floor(scale * a / (l + r)) at
    the cut into two parts, occurring l and r times, where that is lowest. Phrases go that lie in a longer one
    occurring at least `share` percent as often.
    """
    phrases, totals = frequent_phrases(docs, longest, least, id_col, text_col, lang_col, width)
    candidates = phrases.where("words > 1").withColumn("all", F.split("phrase", " ")).withColumnRenamed("f", "a")
    inner = candidates.where("words > 2").select("lang", "words", "a", "all", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "a", "all", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    inner = inner.groupBy("lang", part(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = candidates.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | F.expr(f"100 * cast(longer as decimal(20)) < {share} * cast(a as decimal(20))"))

    cuts = kept.select("lang", "phrase", "a", "first_doc", "words", "all", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "first_doc", "k", part(1, F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words")).alias("right"))
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(count)), ["lang", side])
    score = F.expr(f"cast({scale} as decimal(18)) * cast(a as decimal(20)) div (l + r)").alias("score")
    worst = F.min(F.struct(score, "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a", "first_doc").agg(worst).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "first_doc")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(TOP_SALTS)))
    for by in (["lang", "salt"], ["lang"]):  # so that no task ranks all phrases of a language
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return salted.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "first_doc")


REPORT_SQL = r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT doc_id, lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
lines AS (SELECT doc_id, lang, ws, len(ws) AS k FROM split WHERE len(ws) > 0),
totals AS (SELECT lang, CAST(sum(k) AS BIGINT) AS n FROM lines GROUP BY lang),
sized AS (SELECT doc_id, lang, ws, k, m FROM lines, (VALUES (1), (2), (3), (4)) s(m) WHERE m <= k),
placed AS (SELECT doc_id, lang, ws, m, unnest(range(1, k - m + 2)) AS i FROM sized),
phrases AS (
  SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase, count(*) AS f, min(doc_id) AS first_doc
  FROM placed GROUP BY ALL HAVING count(*) >= 30),
candidates AS (SELECT lang, m, phrase, f AS a, first_doc, string_split(phrase, ' ') AS ws FROM phrases WHERE m > 1),
inside AS (
  SELECT lang, array_to_string(ws[i : i + size - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, ws, a, size, unnest(range(1, m - size + 2)) AS i FROM candidates, (VALUES (2), (3)) s(size) WHERE size < m)
  GROUP BY ALL),
kept AS (
  SELECT c.* FROM candidates c LEFT JOIN inside i ON c.lang = i.lang AND c.phrase = i.phrase
  WHERE i.longer IS NULL OR 100 * i.longer::HUGEINT < 80 * c.a::HUGEINT),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.first_doc, c.k, p.f AS l, q.f AS r, CAST(2000000::HUGEINT * c.a // (p.f + q.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM kept) c
  JOIN phrases p ON p.lang = c.lang AND p.phrase = array_to_string(c.ws[1 : c.k], ' ')
  JOIN phrases q ON q.lang = c.lang AND q.phrase = array_to_string(c.ws[c.k + 1 :], ' ')),
worst AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst WHERE place = 1)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score, r.first_doc FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
