import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm.edit_counts import CountTree, edited_counts, sample_edits
from tickloom.llm.encoders import LEADING, encoder

FILE = "byte_bpe_50k.json"
BITS = ["word", " ", "  ", "\n", "\n\n", " the", "'s", "123", "é", "\t", ".", "<|endoftext|>", " \n", "Hello", "🤖"]


def whole(text):
    return len(encoder(FILE, LEADING).tokenizer.encode(text, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=25), st.lists(st.tuples(st.integers(-2, 60), st.integers(-1, 15), st.lists(st.sampled_from(BITS), max_size=4)), max_size=6))
def test_counts_equal_those_of_whole_texts(parts, edits):
    text = "".join(parts)
    tree = CountTree(text, encoder(FILE, LEADING))
    assert tree.total == whole(text)
    for place, removed, added in edits:
        at = min(max(place, 0), len(text))
        text = text[:at] + "".join(added) + text[at + max(removed, 0) :]
        tree.edit(place, removed, "".join(added))
        assert tree.text() == text and tree.length == len(text) and tree.total == whole(text)
        sums = tree.tokens
        assert all(sums[i] == sums[2 * i] + sums[2 * i + 1] for i in range(1, tree.size))


def test_only_the_region_is_encoded():
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(20_000))
    tree = CountTree(text, encoder(FILE, LEADING))
    for _ in range(50):
        place = rng.randrange(len(text))
        text = text[:place] + "xy z" + text[place + 3 :]
        tree.edit(place, 3, "xy z")
    assert tree.total == whole(text) and tree.encoded < 50 * 60


def test_table(spark, docs_of):
    rows = [(1, "one two three"), (2, None), (3, ""), (None, "no number"), (1, "one two three"), (4, "x " * 30_000)]
    docs = docs_of(rows, ["1 as name", "2 as d", "3 as edits"])
    edits = spark.createDataFrame([(1, 1, 0, 3, "1"), (1, 0, 3, 0, " and"), (3, 0, 5, 5, "new text"), (9, 0, 0, 0, "?"), (None, 0, 0, 9, ""), (4, 0, 7, None, None)], "doc_id long, seq int, place long, removed long, added string")
    got = sorted((tuple(r)[:4] + (r.n_edits,) for r in edited_counts(docs, edits).collect()), key=str)
    one = (1, whole("one two three"), whole("1 and two three"), len("1 and two three"), 2)
    long = "x " * 30_000
    expect = [one, one, (2, 0, 0, 0, 0), (3, 0, whole("new text"), 8, 1), (None, whole("no number"), whole("no number"), 9, 0), (4, whole(long), whole(long), 60_000, 1)]
    assert got == sorted(expect, key=str)
    texts = {i: t or "" for i, t in rows if i is not None}
    made = {}
    for e in sample_edits(docs).orderBy("doc_id", "seq").collect():
        t = made.get(e.doc_id, texts[e.doc_id])
        at = min(e.place, len(t))
        made[e.doc_id] = t[:at] + e.added + t[at + e.removed :]
    for r in edited_counts(docs, sample_edits(docs)).collect():
        if r.doc_id is not None:
            assert r.n_edits == 3 and r.tokens_after == whole(made[r.doc_id]) and r.chars_after == len(made[r.doc_id])
    assert edited_counts(docs_of([]), edits).count() == 0
