import random
import re
import sys
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tickloom import session

sys.path.insert(0, str(Path(__file__).parent))
from test_line_dedup import brute as removed_lines
from test_token_join import brute as components

BAD = ["idiot", "scum", "moron", "loser"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    line = lambda k: " ".join(rng.choices(words, k=k))
    shared = line(80)
    rows, labels = [], []
    for i in range(160):
        text = [line(rng.randint(12, 60)) for _ in range(rng.randint(1, 4))]
        toxic = i % 5 == 0
        if toxic:
            text.append(" ".join(rng.sample(BAD, 4)) + " " + line(8))
        if i % 7 == 3:
            text[0] = f"{line(3)} {shared} {line(3)}"
        rows.append((i, "\n".join(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(200 + i, rows[i + 1][1].replace(" ", "  ", 1)) for i in range(10)] + [(300, None), (301, ""), (302, "short one")]
    path = str(tmp_path_factory.mktemp("tables"))
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], kinds).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_every_stage_on_its_own_input(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, texts = docs.columns, dict(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == columns
        got = {r.doc_id: r.text for r in out.collect()}
        if name == "toxicity":
            expect = {i: t for i, t in texts.items() if not set(BAD) & set(re.split(r"\s+", t or ""))}
        elif name == "line_dedup":
            expect = {}
            gone = removed_lines(list(texts.items()), 3, 10)
            for i, t in texts.items():
                (n, lines), = gone[str(i)]
                if len(lines) < n:
                    expect[i] = t if not lines else "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in lines)
        elif name == "near_copies":
            expect = {i: texts[i] for i, _, least in components(list(texts.items()), 80) if i == least}
        else:
            expect = dict(zip(texts, cut(list(texts.values()))))
        assert got == expect and (name == "long_repeats" or len(got) < len(texts) or name == "near_copies")
        texts = {i: t for i, t in got.items()}
        docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    assert {r.doc_id for r in packed.collect()} == set(texts)


def cut(texts):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for x in data:
        for i in range(len(x) - 199):
            seen[x[i : i + 200]] = seen.get(x[i : i + 200], 0) + 1
    out = []
    for x in data:
        gone = bytearray(len(x))
        for i in range(len(x) - 199):
            if seen[x[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        out.append(bytes(b for b, g in zip(x, gone) if not g).decode())
    return out


def test_run(spark, folder):
    path, rows = folder
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    least = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert least <= 1024 and out.select("doc_id").distinct().count() > 100


def test_tables_of_stages_go_when_the_next_one_is_written(spark, folder, tmp_path, monkeypatch):
    path, rows = folder
    monkeypatch.setattr(session, "shared_folder", lambda spark, purpose: f"{tmp_path}/{purpose}-{random.random()}")
    packed = corpus_pipeline.run(spark, path)
    assert 0 < packed.select("doc_id").distinct().count() <= len(rows)
    left = {p.name.rpartition("-")[0] for p in tmp_path.iterdir()}
    assert {x for x in left if x.startswith("pipeline-")} == {"pipeline-long_repeats"}
    assert not left & {"shared-keys", "pairs", "sets", "texts", "open-rows"}
