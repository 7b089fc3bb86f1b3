"""The pipeline's stages on planted documents, and its parts without each other."""

import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

ROOT = Path(__file__).parents[2]
WORDS = [a + b + c for a in ("ba", "de", "ki", "lo", "mu", "vo") for b in ("ra", "se", "ti", "no") for c in ("n", "s", "", "x")]


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    item = words(40, 9000)
    passage = "\n".join(words(25, 8000 + k) for k in range(6))
    rows, labels = [], []
    for i in range(400):
        text = words(80, i) + "\n" + words(60, 1000 + i)
        if i % 10 == 3:
            w = text.split(" ")
            for k in range(6):
                w.insert(7 * k, "zarfidiot")
            text = " ".join(w)
        elif i in (50, 51, 52):
            text = words(200, 50)
        elif i in (60, 61):
            text = text + "\n" + item
        elif i % 20 == 5:
            text = words(12, i) + "\n" + passage + "\n" + text
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, int(i % 10 == 3)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, passage, item


def test_run_applies_every_stage(spark, corpus):
    folder, passage, item = corpus
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    gone = {i for i in range(400) if i % 10 == 3} | {52, 60, 61}
    assert set(out) == set(range(400)) - gone
    assert out[51]["text"] == "" and out[51]["taken"] == 0  # copies that line dedup emptied: one stands for all
    assert sum(passage in r["text"] for r in out.values()) == 1
    assert all(r["n_chars"] == len(r["text"]) and r["size"] == len(r["text"].split()) and r["taken"] <= 3 * r["size"] for r in out.values())
    for name, _ in {(r["source"], 0) for r in out.values()}:
        own = [r for r in out.values() if r["source"] == name]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)


def test_stages_return_the_columns_of_documents(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 40")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name


def test_stages_take_awkward_and_empty_documents(spark, corpus):
    folder, _, _ = corpus
    schema = spark.read.parquet(f"{folder}/documents.parquet").schema
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "a", 0), (2, "word", "en", None, 4), (2, "other word", "en", "b", 9)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder)
        assert docs.where(F.col("taken") > 3 * F.col("size")).count() == 0


def test_stages_take_text_ids_repeated_ids_and_clashing_columns(spark, corpus):
    folder, passage, item = corpus
    named = lambda k: words(90, 7000 + k) + "\n" + words(70, 7500 + k)
    rows = [("a", named(1)), ("b", named(1)), ("b", named(2)), ("b", named(2)), ("c", named(3) + "\n" + item), ("d", named(4) + "\n" + passage), ("e", passage), (None, named(5)), ("f", None), ("", named(6))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 1.0, "x", 3) for i, t in rows], "doc_id string, text string, lang string, source string, n_chars long, score double, licences string, size long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "licences", "size"], name
    kept = {(r["doc_id"], (r["text"] or "").split("\n")[0]) for r in docs.collect()}
    first = lambda k: named(k).split("\n")[0]
    assert {("b", first(2)), (None, first(5)), ("", first(6))} <= kept  # unlike all others, whatever their ids
    assert sum(x[1] == first(1) for x in kept) == 1 and not any(x[0] == "c" for x in kept)


def test_the_rest_works_without_the_text_operators(tmp_path):
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin:/opt/py313/bin", "PYTHONPATH": str(copy)})
