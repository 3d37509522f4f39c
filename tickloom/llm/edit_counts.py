"""Edit-aware token counts.

A document is kept as a segment tree over its pre-token chunks: a leaf holds a chunk's text, its
characters and its tokens, an inner node the sums below it. An edit (place, characters removed, text put in)
finds its chunks by descending along character sums. Only those chunks and their neighbours are cut and
encoded anew: a border between chunks depends on two characters at either side and no more, so the borders
beyond the neighbours stay. Then the sums above the changed leaves are updated; the token count after each
edit is the sum at the root.

Documents meet their edits in one shuffle of the edits and texts by document number. The edits of a document
are applied in the order of `seq`; places count in characters of the text as it is at that time and are cut to its length.

Cases: a null text is empty; documents without edits keep their count; edits of unknown documents or without a
number have no effect; an edit with nulls removes nothing and puts in nothing; repeated rows get the
same edits; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.encoders import LEADING, Encoder, encoder


class CountTree:
    """Token counts of one text under edits."""

    def __init__(self, text: str, coder: Encoder):
        self.coder, self.encoded = coder, 0
        self.build(self.cut(text))

    def cut(self, text: str) -> list[str]:
        return [x for x in self.coder.cut(text) if x]

    def count(self, chunks: list[str]) -> list[int]:
        self.coder.learn(set(chunks))
        known = self.coder.memory.now
        return [len(known[x]) // 4 for x in chunks]

    def build(self, chunks: list[str]) -> None:
        """Leaves start at `size`; a leaf may come to hold several chunks, or none."""
        self.size = 1 << max(0, len(chunks) - 1).bit_length()
        self.leaves = [[x] for x in chunks] + [[] for _ in range(self.size - len(chunks))]
        self.chars, self.tokens = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        self.chars[self.size : self.size + len(chunks)] = [len(x) for x in chunks]
        self.tokens[self.size : self.size + len(chunks)] = self.count(chunks)
        level = self.size
        while level > 1:
            for sums in (self.chars, self.tokens):
                sums[level // 2 : level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
            level //= 2

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def length(self) -> int:
        return int(self.chars[1])

    def text(self) -> str:
        return "".join(x for leaf in self.leaves for x in leaf)

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and the characters before that leaf."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if before + self.chars[node] <= place:
                before += int(self.chars[node])
                node += 1
        return node - self.size, before

    def between(self, first: int, last: int) -> str:
        return "".join(x for leaf in self.leaves[first : last + 1] for x in leaf)

    def side(self, leaf: int, step: int) -> int:
        """The nearest leaf with text at one side, or -1."""
        leaf += step
        while 0 <= leaf < self.size and not self.leaves[leaf]:
            leaf += step
        return leaf if 0 <= leaf < self.size else -1

    def store(self, leaf: int, chunks: list[str]) -> None:
        self.leaves[leaf] = chunks
        node = self.size + leaf
        self.chars[node], self.tokens[node] = sum(map(len, chunks)), sum(self.count(chunks))
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, place: int, removed: int, added: str) -> None:
        length = self.length
        place = min(max(place, 0), length)
        end = min(place + max(removed, 0), length)
        if not length:
            self.build(self.cut(added))
            self.encoded += len(added)
            return
        first, before = self.find(min(place, length - 1))
        last = self.find(end - 1)[0] if end > place else first
        region = self.between(first, last)
        region = region[: place - before] + added + region[end - before :]
        # a border depends on two characters at either side: take in neighbours until so many are unchanged
        for step in (-1, 1):
            taken = 0
            leaf = self.side(first if step < 0 else last, step)
            while leaf >= 0 and taken < 2:
                text = "".join(self.leaves[leaf])
                taken += len(text)
                if step < 0:
                    first, region = leaf, text + region
                else:
                    last, region = leaf, region + text
                leaf = self.side(leaf, step)
        for leaf in range(first + 1, last + 1):
            if self.leaves[leaf]:
                self.store(leaf, [])
        self.encoded += len(region)
        self.store(first, self.cut(region))


def edited_counts(docs: DataFrame, edits: DataFrame, file: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens_before, tokens_after, chars_after, chars_encoded, n_edits) of every row.

    `edits`: (doc_id, seq, place, removed, added). `chars_encoded` counts what edits made encode anew.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(file, LEADING)
        for batch in batches:
            rows = []
            for name, text, changes in zip(*[batch.column(c).to_pylist() for c in ("name", "text", "edits")], strict=True):
                tree = CountTree(text, coder)
                before = tree.total
                for x in changes or ():
                    tree.edit(x["place"], x["removed"], x["added"])
                rows.append((name, before, tree.total, tree.length, tree.encoded, len(changes or ())))
            cells = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 6)]
            yield pa.RecordBatch.from_arrays(cells, ["doc_id", "tokens_before", "tokens_after", "chars_after", "chars_encoded", "n_edits"])

    change = F.struct("seq", F.coalesce("place", F.lit(0)).cast("long").alias("place"), F.coalesce("removed", F.lit(0)).cast("long").alias("removed"), F.coalesce("added", F.lit("")).alias("added"))
    mine = edits.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("d")).agg(F.array_sort(F.collect_list(change)).alias("edits"))
    rows = docs.select(F.col(id_col).cast("long").alias("name"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = "doc_id long, tokens_before long, tokens_after long, chars_after long, chars_encoded long, n_edits long"
    return rows.join(mine, F.col("name") == F.col("d"), "left").select("name", "text", "edits").mapInArrow(count, out)


def sample_edits(docs: DataFrame) -> DataFrame:
    """Three edits of every document, placed by a hash of its number: a word put in, a stretch replaced, one removed."""
    docs = docs.where("doc_id is not null").select("doc_id", "source", "lang", F.length("text").alias("n")).dropDuplicates(["doc_id"])
    place = lambda k: F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.greatest("n", F.lit(1)))
    kinds = [(0, place(0), 0, F.concat(F.lit(" "), F.coalesce("source", F.lit("source")), F.lit(" "))), (1, place(1), 12, F.coalesce("lang", F.lit(""))), (2, place(2), 30, F.lit(""))]
    array = F.array(*[F.struct(F.lit(k).alias("seq"), p.alias("place"), F.lit(n).alias("removed"), a.alias("added")) for k, p, n, a in kinds])
    return docs.select("doc_id", F.explode(array).alias("e")).select("doc_id", "e.*")
