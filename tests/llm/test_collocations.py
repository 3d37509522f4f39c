import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tickloom.llm.collocations import Prefixes, collocations, segments, string_values

SHAPE = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("phrase", T.StringType()), ("a", T.LongType()), ("words", T.StringType()))])
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [[w for w in re.split(r"[ \t]+", p) if w] for p in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER))]


def truth(rows, longest, least, top, share):
    f, n, where = Counter(), Counter(), {}
    for i, text, lang in rows:
        lang = lang or "und"
        for ws in pieces(text):
            n[lang] += len(ws)
            for m in range(1, longest + 1):
                for at in range(len(ws) - m + 1):
                    key = lang, tuple(ws[at : at + m])
                    f[key] += 1
                    if i is not None:
                        where[key] = min(where.get(key, i), i)
    good = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    longer = defaultdict(int)
    for (lang, ws), a in good.items():
        for m in range(2, len(ws)):
            for at in range(len(ws) - m + 1):
                longer[lang, ws[at : at + m]] = max(longer[lang, ws[at : at + m]], a)
    out = defaultdict(list)
    for (lang, ws), a in good.items():
        if 100 * longer[lang, ws] >= share * a:
            continue
        cuts = [(2_000_000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]], where.get((lang, ws))))
    return sorted((lang, r, p.decode(), -a, left, right, n[lang], -s, i) for lang, xs in out.items() for r, (s, a, p, left, right, i) in enumerate(sorted(xs, key=lambda x: x[:3])[:top], 1))


def some_rows(seed, n=250):
    rng = random.Random(seed)
    words = ["new", "York", "city", "of", "the", "a", "été", "İx", "New", "\U0001f916", "b c", "z"]
    weights = [8, 8, 5, 5, 8, 5, 3, 2, 4, 1, 1, 1]
    rows = []
    for i in range(n):
        out = []
        for _ in range(rng.randrange(40)):
            out.append(rng.choices(words, weights)[0])
            if out[-1] == "new" and rng.random() < 0.8:
                out.append("york")
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " \x0b"]) for w in out)
        rows.append((i, text, rng.choice(["en", "en", "en", "de", None, "und"])))
    return [*rows, (None, "new york city", "en"), (7, None, "en"), (8, "", None), (9, " .,; ", "fr"), (10, "x " * 30_000, "fr"), (11, "the of " * 100, "en"), (11, "the of " * 100, "en")]


@pytest.mark.parametrize("width", [64, 5])
def test_against_counting_phrases(spark, width):
    rows = some_rows(1)
    docs = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SHAPE).repartition(5)
    got = collocations(docs, 4, 6, 25, 80, width=width)
    assert [x[1] for x in got.dtypes] == ["string", "bigint", "string", *["bigint"] * 6]
    got = sorted(map(tuple, got.collect()))
    expect = truth(rows, 4, 6, 25, 80)
    assert len(expect) > 60 and got == expect


def test_shorter_phrases_and_shares(spark):
    rows = some_rows(2, 120)
    docs = spark.createDataFrame([(*r, "", 1, "") for r in rows], SHAPE)
    for longest, share in ((2, 80), (3, 50)):
        assert sorted(map(tuple, collocations(docs, longest, 5, 1000, share).collect())) == truth(rows, longest, 5, 1000, share)


def test_nothing_frequent_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "", 1, "")], SHAPE)
    assert collocations(docs).count() == 0
    assert collocations(docs.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aB .,\t\né\U0001f916", max_size=30), max_size=8), st.integers(1, 50))
def test_segments_hold_all_words(texts, most):
    got = [[] for _ in texts]
    for s in segments(pa.array(texts, pa.string()), most):
        last = None
        for w, p, d in zip(s.words.tolist(), s.piece.tolist(), s.doc.tolist(), strict=True):
            if (id(s), p, d) != last:
                got[d].append([])
                last = id(s), p, d
            got[d][-1].append(s.vocabulary[w].as_py())
    assert got == [[p for p in pieces(t) if p] for t in texts]


def test_prefix_polynomials_are_of_the_parts_alone():
    values = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    p = Prefixes(np.concatenate([values, values]))
    a, b = np.arange(400), np.arange(400) + 7
    assert (p.parts(a, b) == p.parts(a + 500, b + 500)).all()
    assert len(np.unique(p.parts(a, b))) == 400
    assert string_values(pa.array(["ab", "ba", "ab", ""])).tolist()[0] == string_values(pa.array(["ab"])).tolist()[0]
