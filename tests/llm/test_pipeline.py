"""The pipeline on a small corpus, stage by stage beside plain decisions."""

import random

from pyspark.sql import functions as F

import corpus_pipeline

from . import brute
from .conftest import CLASH, prose
from .test_texts import leaks_of


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    items = [(k, prose(rng, 20)) for k in range(3)]
    texts = [prose(rng, 60) for _ in range(40)]
    texts[4] += " " + items[1][1] + " tail"
    texts[6] += " write to some.one@mail.example.org today"
    texts += [texts[0], "".join(c.upper() if c.isascii() else c for c in texts[1]), None, "", "short one", "again and again " * 30]
    rows = [*enumerate(texts), (2, texts[2]), (None, texts[3]), (None, prose(rng, 50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn(
        "n_chars", F.length("text").cast("long"))
    docs = docs.select("*", *(F.lit("?").alias(name) for name in CLASH))
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int"
                          ).write.parquet(f"{folder}/labels.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        seen[name] = docs
    for name in list(seen)[:-1]:
        assert seen[name].columns[:3] == ["doc_id", "text", "n_chars"] and len(seen[name].columns) == 19
    ids = {name: sorted((r.doc_id for r in seen[name].collect()), key=repr) for name in seen}
    judged = brute.rule_counts(rows)
    assert ids["quality_rules"] == sorted((r[0] for r in judged if not r[-1]), key=repr)
    # 40 and 41 copy 0 and 1, the second 2 and the first null copy 2 and 3
    assert ids["near_dedup"] == sorted([*range(40), None], key=repr)
    bad = {i for i, _ in leaks_of(rows, items)}
    assert bad == {4}
    assert ids["decontamination"] == [i for i in ids["near_dedup"] if i != 4] == ids["personal_data"]
    clean = {r.doc_id: r for r in seen["personal_data"].collect()}
    assert "[email] today" in clean[6].text and "@" not in clean[6].text
    assert clean[6].n_chars == len(clean[6].text) and clean[7].text == texts[7]
    assert sorted((r.doc_id for r in seen["packing"].collect()), key=repr) == ids["personal_data"]
    assert corpus_pipeline.run(spark, folder).count() == len(ids["packing"])


def test_empty_documents(spark, tmp_path):
    folder = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
