"""The pipeline's stages, each against what its operator says about its own input."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from pulsegrain.llm import mixing, ngram_join, quality_classifier

BENCH = "which of these towns lies nearest to the mouth of the long river in the north"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(500)]
    rows = []
    for i in range(300):
        text = " ".join(rng.choices(words, k=rng.randint(40, 120)))
        if i % 7 == 0 and i:
            text = rows[i - 1][1].replace(" ", "  ", 3) + " more"
        if i % 10 == 1:
            text = " ".join(w + "!!&&" for w in text.split())
        if i % 25 == 2:
            text += f"\n{BENCH}\n"
        if i % 20 == 3:
            text += " mail ann.lee@example.org or +49 30 1234567 now"
        rows.append((i, text, rng.choice(["en", "de"]), f"s{i % 4}", len(text)))
    rows += [(400, None, None, None, None), (401, "", "en", "s1", 0), (None, "no id " + " ".join(words[:60]), "en", None, 9), (7, rows[7][1], "en", "s3", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    spark.createDataFrame([(i, 0 if i % 10 == 1 else 1, 0) for i in range(0, 300, 2)] + [(11, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def test_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names = docs.columns
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tables).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        assert out.columns == names or k == 4
        kept.append((name, docs, out))
        docs = out
    ids = lambda df: sorted(str(r.doc_id) for r in df.select("doc_id").collect())
    assert [n for n, *_ in kept] == ["quality", "near_duplicates", "benchmark", "personal_data", "mixing"]
    _, before, after = kept[0]
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    assert ids(after) == ids(quality_classifier.quality_scores(before, labels).where("predicted = 1"))
    _, before, after = kept[1]
    found = ngram_join.ngram_jaccard_join(before)
    assert {r.doc_id for r in after.collect()} == {r.class_id for r in found.collect()}
    _, before, after = kept[2]
    assert ids(after) == ids(before.where(f"text IS NULL OR NOT contains(text, '{BENCH}')"))
    _, before, after = kept[3]
    assert ids(after) == ids(before) and not after.where("contains(text, '@')").count() and after.where("contains(text, '[EMAIL] or [PHONE] now')").count() == before.where("contains(text, '@')").count()
    assert before.where("NOT contains(text, '@')").exceptAll(after.where("NOT contains(text, '[EMAIL]')")).count() == 0
    _, before, after = kept[4]
    taken = mixing.mix_sizes(before)
    assert after.selectExpr("sum(copies)").first()[0] == taken.selectExpr("sum(copies)").first()[0]
    assert sorted(map(str, corpus_pipeline.run(spark, tables).collect())) == sorted(map(str, after.collect()))


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
