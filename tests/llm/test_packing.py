import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tickloom.llm.encoders import LEADING, Encoder, encoder
from tickloom.llm.memory import give_back
from tickloom.llm.packing import MEMORY, Bins, pack_documents, pieces_of

FILE = "byte_bpe_50k.json"


@pytest.mark.parametrize(("seed", "low", "high"), [(1, 1, 100), (2, 30, 60), (3, 20, 50), (4, 34, 67)])
def test_exchanges_empty_bins_and_lose_nothing(seed, low, high):
    lengths = np.random.default_rng(seed).integers(low, high, 300)
    bins = Bins(lengths, 100)
    before = sum(n > 0 for n in bins.fill)
    bins.improve()
    places = sorted(bins.places())
    assert [i for i, _, _ in places] == list(range(300))
    for b, items in enumerate(bins.items):
        assert bins.fill[b] == sum(n for n, _ in items) <= 100 and all(lengths[i] == n for n, i in items)
    assert bins.needed <= sum(n > 0 for n in bins.fill) <= before


def test_exchanges_beat_best_fit():
    # best fit, largest first, needs three bins for what fits into two
    lengths = np.array([6, 5, 4, 3, 2])
    bins = Bins(lengths, 10)
    assert sum(n > 0 for n in bins.fill) >= 2
    bins.improve()
    assert sum(n > 0 for n in bins.fill) == 2
    lengths = np.array([44, 24, 24, 22, 21, 17, 8, 8, 6, 6] * 2)
    bins = Bins(lengths, 60)
    before = sum(n > 0 for n in bins.fill)
    bins.improve()
    assert bins.needed <= sum(n > 0 for n in bins.fill) <= before


@pytest.mark.parametrize("block_items", [7, 20_000])
def test_pieces_and_places(docs_of, block_items):
    rng = random.Random(6)
    words = ["the", "quick", "Fox,", "%%%", "naïve", "\n", "idiot."]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(90)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "word " * 700), (None, "no number"), (3, rows[3][1]), (103, " a" * 63)]
    found = pack_documents(docs_of(rows, ["1 as block", "2 as piece"]), FILE, 64, 2, block_items).collect()
    coder = Tokenizer.from_file(public_tokenizers.path(FILE))
    expect = []
    for name, text in rows:
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 2]
        edges = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)] if len(ids) > 64 else [0, len(ids)]
        expect += [(str(name), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(expect)
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    if block_items > 1000:
        assert len(bins) <= 1.05 * sum(x[3] for x in expect) / 64 + 1


def test_empty_table(docs_of):
    assert pack_documents(docs_of([]), FILE).count() == 0


@pytest.mark.parametrize(("seed", "low", "high"), [(3, 20, 50), (4, 34, 67), (7, 1, 40)])
def test_a_block_ends_only_where_no_exchange_helps(seed, low, high):
    bins = Bins(np.random.default_rng(seed).integers(low, high, 300), 100)
    bins.improve()
    live = [b for b, n in enumerate(bins.fill) if n]
    helps = [(a, b) for a in live for b in live if a != b and bins.exchange(a, b)]
    assert len(live) == bins.needed or not helps


def test_plain_texts_are_cut_outside_python(monkeypatch):
    coder = Encoder(FILE, LEADING)
    texts = ["the Fox,\nran naïve.\n\u65e5 x", "", "one", "a\u00a0b \u0130!\n<|endoftext|> z"]
    wanted = [coder.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    monkeypatch.setattr(coder, "cut", None)
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts * 3)] == wanted * 3


def test_workers_of_packing_remember_little(docs_of, monkeypatch):
    from tickloom.llm import packing

    seen = []
    monkeypatch.setattr(packing, "encoder", lambda *a: seen.append(a) or Encoder(*a))
    cut = {}
    monkeypatch.setattr(packing, "texts", lambda *a: type("T", (), {"mapInArrow": lambda self, f, s: cut.update(f=f)})())
    packing.pieces_of(None, FILE)
    list(cut["f"](iter([])))
    assert Encoder(*seen[0]).memory.most <= 48 << 20


def test_without_keep_pieces_are_the_same_and_a_worker_forgets_its_chunks(spark, docs_of):
    docs = docs_of([f"a text of its own {i} {i * 7919}" for i in range(400)]).repartition(8)
    kept, forgotten = (pieces_of(docs, FILE, 16, 2, keep=k) for k in (True, False))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, forgotten.collect()))

    def held(batches):
        for _ in batches:
            pass
        memory = encoder(FILE, LEADING, MEMORY).memory
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(memory.now) + len(memory.former)], pa.int64())})

    for _ in range(4):  # until every idle worker, also those of other tests, has ended a task without keep
        forgotten.count()
    assert {r.n for r in docs.select("doc_id").mapInArrow(held, "n long").collect()} == {1}


def test_an_encoder_learns_again_what_it_forgot():
    coder = Encoder(FILE, LEADING)
    ids = coder.encode(["some words, and more"])
    coder.memory.forget()
    give_back()
    assert coder.memory.now == {"": b""} and not coder.memory.former and not coder.memory.bytes
    assert coder.encode(["some words, and more"]) == ids
