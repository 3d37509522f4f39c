import random

from pyspark.sql import functions as F

from tickloom.llm.toxicity import Chain, drop_toxic, toxicity_scores

BAD, JUNK = ["idiot", "scum", "moron", "loser"], ["%%%", "$$$", "###"]


def corpus(n=400):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(20, 80))
        poor, toxic = rng.random() < 0.3, rng.random() < 0.2
        for extra, wanted in ((JUNK, poor), (BAD, toxic)):
            for _ in range(3 * wanted):
                text.insert(rng.randrange(len(text)), rng.choice(extra))
        rows.append((i, " ".join(text)))
        marks.append((i, int(not poor), int(toxic)))
    return rows, marks


def test_held_out_documents(spark, docs_of):
    rows, marks = corpus()
    docs = docs_of([*rows, (1000, None), (1001, ""), (None, "scum idiot moron loser"), (3, "w1 w2")], ["1 as words", "2 as p_toxic", "3 as row"])
    labels = spark.createDataFrame([*marks[:250], (None, 1, 1), (251, None, 0)], "doc_id long, quality int, toxic int")
    out = toxicity_scores(docs, labels).collect()
    assert len(out) == len(rows) + 4 and {r.doc_id for r in out if r.doc_id is None or r.doc_id > 999} == {None, 1000, 1001}
    truth = {i: bool(t) for i, _, t in marks[250:]}
    held = [(truth[r.doc_id], r.is_toxic) for r in out if r.doc_id in truth]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(r.is_toxic for r in out if r.doc_id is None) and not any(r.is_toxic for r in out if r.doc_id in (1000, 1001))

    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in out if not r.is_toxic)


def test_later_models_see_out_of_fold_predictions(spark, docs_of):
    rows, marks = corpus(150)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").select("doc_id", (1 - F.col("quality")).alias("poor"), "toxic")
    chain = Chain()
    found = chain.fit(docs_of(rows), labels, judge=True).collect()
    assert len(found) == 150 and {r.fold for r in found} == {0, 1, 2}
    assert sum((r.p_toxic >= 0.5) == (r.toxic == 1) for r in found) > 135
    assert chain.models["toxic"].stages[-1].numFeatures == len(chain.models["toxic"].stages[0].vocabulary) + 1


def test_nothing_to_learn_from(spark, docs_of):
    docs = docs_of(["a b", "c d"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(0, 1, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")
    assert {(r.p_poor, r.p_toxic) for r in toxicity_scores(docs, none).collect()} == {(0.0, 0.0)}
    assert {(r.p_poor, r.p_toxic) for r in toxicity_scores(docs, one).collect()} == {(0.0, 1.0)}
    assert toxicity_scores(docs_of([]), one).count() == 0
