"""The pipeline's stages against brute force, each on its own input, and the
optional entry."""

import os
import random
import shutil
import subprocess
import sys

import corpus_pipeline
from conftest import ROOT, SF001
from llm import brute
from pyspark.sql import functions as F

from kiln.llm import lines, quality
from kiln.llm.decontaminate import decontaminate

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality", "line_dedup", "near_duplicates", "decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_on_the_corpus(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").cache()
    steps = dict(corpus_pipeline.STAGES)

    good = steps["quality"](spark, docs, SF001).cache()
    model = quality.fit(docs, spark.read.parquet(f"{SF001}/labels.parquet"))
    want = {r["doc_id"] for r in quality.score(docs, model, ["doc_id"]).filter(F.col("score") >= quality.KEEP).collect()}
    assert good.columns == COLUMNS and {r["doc_id"] for r in good.collect()} == want

    clean = steps["line_dedup"](spark, good, SF001).cache()
    assert clean.columns == COLUMNS and clean.count() == good.count()
    assert clean.filter("n_chars <> length(text)").isEmpty()
    full = lines.drop_boilerplate(good).select("doc_id", "text")
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, clean.select("doc_id", "text").collect()))

    one = steps["near_duplicates"](spark, clean, SF001).cache()
    pairs = [(r["doc_id"], r["text"]) for r in clean.collect()]
    comp = brute.components(pairs, 5, 80, 100)
    assert one.columns == COLUMNS
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({c if n else d for d, n, c in comp})

    left = steps["decontamination"](spark, one, SF001).cache()
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet")
    bad = {r["doc_id"] for r in decontaminate(one, bench).filter("contaminated").collect()}
    assert bad and left.columns == COLUMNS
    assert {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in one.collect()} - bad

    packed = steps["packing"](spark, left, SF001).toPandas()
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in left.collect()}
    assert packed.groupby("doc_id").length.sum().to_dict() == {d: n for d, n in words.items() if n}
    assert packed.groupby("bin").length.sum().max() <= 2048
    for df in (docs, good, clean, one, left):
        df.unpersist()


def test_stages_keep_clashing_columns_and_take_empty_tables(spark, make_docs):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 5) for _ in range(30))) for i in range(30)]
    docs = make_docs(rows + [(None, None), (99, ""), (5, rows[5][1])]).withColumns(
        {c: F.lit(1) for c in ("row_key", "score", "n", "host_", "text_key")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF001).columns == docs.columns
        assert stage(spark, docs.limit(0), SF001).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF001).count() == 0


def test_entry_without_the_subpackage(tmp_path):
    """The rest imports and lists its queries when these folders are gone."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), 'pipeline' in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split()[-2:] == ["False", "False"] and int(said.stdout.split()[-3]) > 70
