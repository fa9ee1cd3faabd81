"""Quality and language models: held-out accuracy, and rows that are hard to handle."""

from __future__ import annotations

import random
import zlib

import numpy as np

from pulsegrain.llm import language_id as L
from pulsegrain.llm import quality_classifier as Q

LANGUAGES = {"xx": ["ka", "to", "mi", "ran", "el"], "yy": ["sch", "ung", "ött", "der", "ie"], "zz": ["ción", "que", "los", "ar", "ñe"]}


def corpus(n: int = 900) -> list[tuple]:
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = rng.choice(list(LANGUAGES))
        words = ["".join(rng.choices(LANGUAGES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(30, 200))]
        good = rng.random() < 0.8
        if not good:
            words = [w + "!!" for w in words] if i % 2 else [w + "###" for w in words]
        rows.append((i, " ".join(words), lang if i % 9 else None, lang, int(good)))
    return rows


def held_out(i) -> bool:
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


HARD = [(None, "hello there 123", None), (5000, None, "xx"), (5001, "", None), (5002, "12 34 !! --", "yy"), (5003, "Жизнь", None), (5004, "mi to ka " * 60000, "xx"), (3, "mi ka to", "xx")]


def test_language(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, lang, 1, 0.5) for i, t, lang, _, _ in rows] + [(*h, 1, 0.5) for h in HARD], "doc_id long, text string, lang string, d int, score double")
    got = L.language_id(docs).collect()
    assert len(got) == len(rows) + len(HARD) and all(0 <= r.score <= 1 for r in got)
    truth = {i: lang for i, _, _, lang, _ in rows}
    test = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == held_out(r.doc_id) for r in got) and sum(r.lang_pred == truth[r.doc_id] for r in test) >= 0.97 * len(test)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" for i in (5000, 5001, 5002)) and by_id[5003].lang_pred in LANGUAGES and by_id[5004].lang_pred == "xx"
    assert {r.lang_pred for r in L.language_id(docs.withColumn("lang", docs.lang.substr(9, 9)).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}
    assert L.language_id(docs.limit(0)).collect() == []


def test_quality(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, lang, "q", 1) for i, t, lang, _, _ in rows] + [(*h, "q", 1) for h in HARD], "doc_id long, text string, lang string, x string, y int")
    labels = spark.createDataFrame([(i, q, 0) for i, *_, q in rows if i % 2] + [(None, 1, 0), (1, rows[1][4], 0)], "doc_id long, quality int, toxic int")
    got = Q.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) + len(HARD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == held_out(r.doc_id) for r in got)
    truth = {i: q for i, *_, q in rows if i != 3}
    test = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in test) >= 0.97 * len(test)
    kept = Q.keep_good(docs, labels).collect()
    good = {r.doc_id for r in got if r.predicted and r.doc_id not in (3, None)}
    assert {r.doc_id for r in kept if r.doc_id not in (3, None)} == good and kept[0].asDict().keys() == {"doc_id", "text", "lang", "x", "y"}
    assert {r.score for r in Q.quality_scores(docs.limit(5), labels.where("quality = 7")).collect()} == {0.5}
    assert Q.quality_scores(docs.limit(0), labels).collect() == []


def test_prior_of_mixed_scores():
    rng = np.random.default_rng(1)
    positive, bad = rng.normal(2, 1, 4000), rng.normal(-3, 1, 2000)
    assert abs(Q.class_prior(positive, np.concatenate([rng.normal(2, 1, 6000), bad])) - 0.75) < 0.05
