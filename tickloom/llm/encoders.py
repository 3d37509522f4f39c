"""Encoding with a public tokenizer, one chunk at a time and each distinct chunk once.

A text is cut only where no token can cross, so the joined ids of its chunks are the ids of
the text. Where white space is dropped by the tokenizer, that is at every space and line end.
Where a space belongs to the word behind it, that is before a single space between two
characters which aren't white space.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Collection

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tickloom.llm.memory import Memory

DROPPED, LEADING = "dropped", "leading"
DOUBLE = re.compile(r"\s\s")
SINGLE = re.compile(r"(?<=\S) (?=\S)")
MARKS = ".,;:!?%&$*#"


def chunks_without_space(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


def chunks_with_space(text: str) -> list[str]:
    """Chunks whose concatenation is the text. A single line end between two characters is one as well."""
    if DOUBLE.search(text) or text[:1].isspace() or text[-1:].isspace():
        head, *rest = SINGLE.split(text)
        return [head, *[" " + x for x in rest]]
    head, *rest = text.split(" ")
    if "\n" not in text:
        return [head, *[" " + x for x in rest]]
    out = []
    for x in [head, *[" " + x for x in rest]]:
        if "\n" in x:
            first, *more = x.split("\n")
            out.append(first)
            for y in more:
                out += ("\n", y)
        else:
            out.append(x)
    return out


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit bytes.

    `most_bytes` bounds each of the two generations of chunks that are remembered.
    """

    def __init__(self, file: str, spaces: str, most_bytes: int = 100 << 20):
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(file if os.path.isabs(file) else public_tokenizers.path(file))
        self.normalizer = self.tokenizer.normalizer
        self.leading = spaces == LEADING
        self.cut = chunks_with_space if self.leading else chunks_without_space
        # tokens that start a word with its space, or that end a word
        names = sorted(self.tokenizer.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        self.edge = np.zeros(names[-1][1] + 1, bool)
        for name, i in names:
            self.edge[i] = name.startswith("\u0120") if self.leading else name.endswith("</w>")
        # whether the tokenizer sees no difference between A-Z and a-z
        same = [x.ids for x in self.tokenizer.encode_batch(["QWERTYuiopASDFghjklZXCVBnm", "qwertyuiopasdfghjklzxcvbnm"], add_special_tokens=False)]
        self.folds = same[0] == same[1]
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [x.content for x in added]
        self.memory = Memory(most_bytes, {"": b""})

    def of_letters(self, word: str) -> bool:
        """Whether a word is letters only, also as the tokenizer normalises it: of some letters it makes marks."""
        if not word.isalpha():
            return False
        return word.isascii() or self.normalizer is None or self.normalizer.normalize_str(word).isalpha()

    def learn(self, chunks: Collection[str]) -> None:
        """Ids of distinct chunks not met before; letters and the marks behind them are tokens apart."""
        memory, leading = self.memory, self.leading
        memory.turn()
        words, whole, parts = set(), set(), []
        for chunk in memory.missing(chunks):
            core = chunk.rstrip(MARKS)
            spaced = leading and core[:1] == " "
            word = core[1:] if spaced else core
            if not (word.isalpha() if word.isascii() else self.of_letters(word)):
                whole.add(chunk)
                continue
            name = core.lower() if self.folds and core.isascii() else core
            (words if spaced == leading else whole).add(name)
            if name != chunk:
                marks = chunk[len(core) :]
                whole.add(marks)
                parts.append((chunk, name, marks))
        self.encode_words(memory.missing(words))
        known = memory.now
        self.encode_whole(memory.missing([x for x in words | whole if x not in known]))
        memory.add({chunk: known[name] + known[marks] for chunk, name, marks in parts})

    def encode_words(self, words: list[str]) -> None:
        """Words of letters, many in one text: a token that starts (or ends) a word tells where each begins."""
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            code = self.tokenizer.encode_batch_fast([("" if self.leading else " ").join(part)], add_special_tokens=False)
            ids = np.array(code[0].ids, dtype="<u4")
            edges = np.flatnonzero(self.edge[ids])
            edges = np.append(edges, len(ids)) if self.leading else np.append(0, edges + 1)
            if len(edges) == len(part) + 1 and edges[0] == 0 and edges[-1] == len(ids):
                data, edges = ids.tobytes(), (4 * edges).tolist()
                self.memory.add({x: data[a:b] for x, a, b in zip(part, edges, edges[1:])})

    def encode_whole(self, new: list[str]) -> None:
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            codes = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.memory.add({chunk: np.array(code.ids, dtype="<u4").tobytes() for chunk, code in zip(part, codes, strict=True)})

    def folded(self, text: str) -> str:
        """A text in small letters where the tokenizer sees no difference, so that more of its chunks are equal.

        Added tokens are found before letters are folded, so a text that would gain one is left as it is.
        """
        if not (self.folds and text.isascii()):
            return text
        small = text.lower()
        return text if any(x in small for x in self.added) else small

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.leading and not (DOUBLE.search(x) or x[:1].isspace() or x[-1:].isspace()) for x in texts]
        cut = [self.cut(self.folded(x)) for x, p in zip(texts, plain, strict=True) if not p]
        coded = iter(self.encode_plain([x for x, p in zip(texts, plain, strict=True) if p]))
        self.learn(set().union(*cut))
        known = self.memory.now
        pieced = iter([b"".join([known[c] for c in x]) for x in cut])
        return [next(coded if p else pieced) for p in plain]

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        """Texts without white space at an end or next to other white space, where a space belongs to the word behind it.

        Arrow numbers the distinct chunks, so Python meets each once a call. A chunk holds the line end before it; one is
        put before each text as well, and its ids are left out.
        """
        if not texts:
            return []
        words = pc.split_pattern(pa.array(["\n" + x.replace("\n", " \n") for x in texts], pa.large_string()), " ")
        coded = words.flatten().dictionary_encode()
        chunks = [x if x[0] == "\n" else " " + x for x in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        self.learn(["\n", *chunks])
        known = self.memory.now
        ids = list(map(known.__getitem__, chunks))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, firsts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        number = coded.indices.to_numpy()
        counts = sizes[number]
        ends = np.cumsum(counts)
        out = flat[np.arange(ends[-1]) + np.repeat(firsts[number] - ends + counts, counts)]
        edges = np.append(0, ends)[words.offsets.to_numpy()].tolist()
        line = len(known["\n"]) // 4
        return [out[a + line : b].tobytes() for a, b in zip(edges, edges[1:])]


@functools.cache
def encoder(file: str, spaces: str, most_bytes: int = 100 << 20) -> Encoder:
    """One per Python worker; later tasks of the worker find its memory filled."""
    return Encoder(file, spaces, most_bytes)
