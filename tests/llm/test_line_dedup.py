import random
import re

import pytest

from tickloom.llm.line_dedup import drop_lines, line_report


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def brute(rows, least, near):
    found, order = {}, []
    for name, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            words = [w for w in re.split(r"[ \t\x0b\f\r]+", line) if w]
            if len(words) >= least:
                order.append(((name if name is not None else 1 << 63, i), tuple(words)))
    gone = set()
    for o, words in order:
        for p, other in order:
            if p < o and (words == other or (min(len(words), len(other)) >= near and one_edit(words, other))):
                gone.add(o)
    for name, text in rows:
        key = name if name is not None else 1 << 63
        n = len((text or "").split("\n"))
        found.setdefault(str(name), []).append((n, [i for i in range(n) if (key, i) in gone]))
    return {k: sorted(v) for k, v in found.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(docs_of, seed):
    rng = random.Random(seed)
    pool = [rng.choices("abcdefg", k=rng.choice([1, 2, 3, 5, 6, 7, 8, 15, 16, 17, 40])) for _ in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            words = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.randint(0, 1)] = rng.choices("abcdefg", k=rng.randint(0, 1))
            lines.append(rng.choice([" ", "  ", "\t "]).join(words) + rng.choice(["", "\r", " "]))
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, rows[3][1] + "\nx y z q r s t u"), (103, "w " * 3000 + "\n" + "w " * 3001)]
    docs = docs_of(rows, ["1 as d", "2 as line", "3 as lines", "4 as h1"])
    got = {}
    for r in line_report(docs, 3, 6).collect():
        assert r.n_removed == len(r.removed)
        got.setdefault(str(r.doc_id), []).append((r.n_lines, r.removed))
    expect = brute(rows, 3, 6)
    assert {k: sorted(v) for k, v in got.items()} == expect

    out = drop_lines(docs, 3, 6)
    assert out.columns == docs.columns
    kept = {}
    for name, text in rows:
        (n, gone), = expect[str(name)]
        if len(gone) < n:
            lines = (text or "").split("\n")
            kept[str(name)] = text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    assert {str(r.doc_id): r.text for r in out.collect()} == kept


def test_ties_and_empty_table(docs_of):
    line = "one two three four five six seven"
    rows = [(1, line), (1, line), (2, line + " eight"), (3, "one two three")]
    got = sorted((r.doc_id, r.removed) for r in line_report(docs_of(rows), 3, 6).collect())
    assert got == [(1, []), (1, []), (2, [0]), (3, [])]
    assert line_report(docs_of([]), 3, 6).count() == 0 and drop_lines(docs_of([])).count() == 0


def test_short_lines_count_by_default(docs_of):
    rng = random.Random(5)
    texts = ["\n".join(" ".join(rng.choices("abcd", k=rng.randint(0, 6))) for _ in range(5)) for _ in range(8)]
    rows = [*enumerate(["Home", "red green blue", "Home\nred green grey", "red green", "back home\nyes"]), (5, "back home\nno\nred green blue too"), *enumerate(texts, 10)]
    got = {}
    for r in line_report(docs_of(rows)).collect():
        got.setdefault(str(r.doc_id), []).append((r.n_lines, r.removed))
    assert got == brute(rows, 1, 3)
    assert got["2"] == [(2, [0, 1])] and got["5"] == [(3, [0, 2])]
    assert {r.doc_id: r.text for r in drop_lines(docs_of(rows)).where("doc_id < 10").collect()} == {0: "Home", 1: "red green blue", 3: "red green", 4: "back home\nyes", 5: "no"}
