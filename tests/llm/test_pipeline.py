"""The pipeline, stage by stage and whole, against plain versions on a small folder of tables."""

import random

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspan.llm import quality_rules
from quillspan.llm.queries import tokenizer_path

random.seed(11)
VOCABULARY = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7))) for _ in range(300)]


def prose(n):
    return " ".join(random.choice(VOCABULARY) for _ in range(n)) + "."


ITEM = prose(30)
GOOD = [prose(40) + "\n" + prose(30) for _ in range(12)]
DOCS = [(i, t) for i, t in enumerate(GOOD)]
DOCS += [(20, GOOD[0]), (21, GOOD[1].replace(GOOD[1].split()[3], "changed", 1))]  # a copy and a near copy
DOCS += [(30, prose(30) + "\n" + ITEM)]  # a benchmark passage
DOCS += [(40, prose(30) + " mail a.b@c.org now.")]
DOCS += [(50, "one two three"), (51, None), (52, "w x y z v " * 30), (53, "Home | News | Sport | More\n" * 3 + "a b c")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def expected(spark):
    """{doc_id: text} before packing; only the line rules come from the operator, whose lines have a test of their own."""
    judged = quality_rules.judge(spark.createDataFrame(DOCS, "doc_id long, text string")).collect()
    good = [(r.doc_id, r.clean_text) for r in judged if not brute.base_counts(r.text)[-1] and len(brute.words(r.clean_text)) >= 0.7 * len(brute.words(r.text))]
    label, _ = brute.classes(good)
    one = {c: min(i for (i, _), d in zip(good, label, strict=True) if d == c) for c in label}
    stay = {i: t for i, t in good if i in one.values()}
    item = brute.words(ITEM)
    stay = {i: t for i, t in stay.items() if " ".join(item) not in " ".join(brute.words(t))}
    out = {}
    for i, t in stay.items():
        for span in reversed([s.split(":") for s in brute.base_spans(t).split(",") if s]):
            t = t[: int(span[1])] + f"[{span[0].upper()}]" + t[int(span[2]) :]
        out[i] = t
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.dtypes
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.dtypes == columns, name
    rows = docs.collect()
    want = expected(spark)
    assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)
    assert set(want) == set(range(12)) | {40} and "[EMAIL]" in want[40]


def test_run(spark, folder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = corpus_pipeline.run(spark, folder).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in expected(spark).items()}


def test_stages_on_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0
