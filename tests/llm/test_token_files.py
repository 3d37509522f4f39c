import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tickloom.llm.encoders import DROPPED, LEADING, encoder
from tickloom.llm.token_files import Block, EliasFano, read_token_files, write_token_files

CODES = {"word_bpe_49k.json": DROPPED, "byte_bpe_50k.json": LEADING}
PIECES = ["Hello", "they're", "İstanbul", "ΟΔΟΣ", "e\u0301a", "<|endoftext|>", "  ", " ", "\n", "\t", "\n\n", " \n", "\u00a0", "\x1c", "\u2028", "don't", "'s", "3.14", "%%%", "naïve.", "WORD!!", "日本", "🤖", "a.b", "x\u0301", ".", "'", "end.\nThe", "\u0130", "ab\u0130,", "\u0130!", "\u01c5", "\u01c8x.", "\u0307", "\u0345", "\u200d", "\u00a0x", "\u1e9e", "\ufb01", "\u03a3."]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*PIECES, " "]), max_size=14))
@pytest.mark.parametrize("file", CODES)
def test_chunks_give_the_ids_of_the_whole_text(file, parts):
    text = "".join(parts)
    plain = whole(file, text)
    assert np.frombuffer(encoder(file, CODES[file]).encode([text])[0], "<u4").tolist() == plain


TOKENIZERS = {}


def whole(file, text):
    if file not in TOKENIZERS:
        TOKENIZERS[file] = Tokenizer.from_file(public_tokenizers.path(file))
    return TOKENIZERS[file].encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-(2**62), 2**62) | st.integers(0, 300), max_size=300))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    coded = EliasFano.of(np.array(values, np.int64))
    again, end = EliasFano.read(b"xx" + coded.to_bytes(), 2)
    assert end == len(coded.to_bytes()) + 2 and again.values().tolist() == values
    assert [again.select(i) for i in range(len(values))] == values


def test_boundaries_take_little_space():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 1000, 50_000))
    assert len(EliasFano.of(ends).to_bytes()) * 8 / len(ends) < 2 + np.log2(ends[-1] / len(ends)) + 2
    with pytest.raises(IndexError):
        EliasFano.of(ends).select(len(ends))


def test_block_finds_documents():
    codes = [np.arange(n, dtype="<u4") + 70_000 * (n == 5) for n in (3, 0, 5, 200)]
    block = Block.from_bytes(Block.of([None, 4, 4, 9], codes).to_bytes())
    assert [block.document(i).tolist() for i in range(4)] == [x.tolist() for x in codes]
    assert block.nameless == 1 and block.names.values().tolist() == [4, 4, 9]


@pytest.mark.parametrize("block_ids", [50, 1 << 20])
def test_files_round_trip(spark, docs_of, tmp_path, block_ids):
    rng = random.Random(3)
    rows = [(rng.randrange(10**12) - 10**6, "".join(rng.choices(PIECES, k=rng.randrange(30)))) for _ in range(200)]
    rows += [(7, None), (8, ""), (9, "word " * 20_000), (None, "no number"), (None, "nor this"), (5, "twice"), (5, "twice"), (5, "thrice")]
    docs = docs_of(rows, ["1 as shard", "2 as start", "3 as payload"])
    write_token_files(docs, f"{tmp_path}/files", "word_bpe_49k.json", block_ids=block_ids)
    got = sorted((tuple(r) for r in read_token_files(spark, f"{tmp_path}/files").collect()), key=lambda r: r[1])
    assert [r[0] is not None for r in got] == sorted(r[0] is not None for r in got)
    names = [r[0] for r in got if r[0] is not None]
    assert names == sorted(names) and len(got) == len(rows)
    at = 0
    for r in got:
        assert r[1] == at
        at += r[2]
    codes = lambda t: whole("word_bpe_49k.json", t or "") + [1]
    expect = sorted((str(i), len(codes(t)), zlib.crc32(np.array(codes(t), "<u4").tobytes())) for i, t in rows)
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == expect


def test_empty_table(spark, docs_of, tmp_path):
    write_token_files(docs_of([]), f"{tmp_path}/files", "word_bpe_49k.json")
    assert read_token_files(spark, f"{tmp_path}/files").count() == 0


def test_letters_of_either_case_are_one_chunk():
    from tickloom.llm.encoders import DROPPED, Encoder

    code = Encoder("word_bpe_49k.json", DROPPED)
    rows = ["Word word, WORD", "<|ENDOFTEXT|> Word", "<|endoftext|> word", "IT'S Ünder KELVINK don'T"]
    for text in rows:
        wanted = code.tokenizer.encode(text, add_special_tokens=False).ids
        assert list(memoryview(code.encode([text])[0]).cast("I")) == wanted
    fresh = Encoder("word_bpe_49k.json", DROPPED)
    fresh.encode(rows[:1])
    assert set(fresh.memory.now) <= {"", "word", "word,", ","}
