from __future__ import annotations

import re

from pulsegrain.llm.licenses import KNOWN, PHRASES, license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text: str | None) -> tuple:
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    found = [(i, label) for phrase, label in PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def test_base_places_and_edge_cases(spark):
    texts = [None, "", "  ", "Apache-License apache LICENSE apache license", "x mit license cc by cc-by GNU General Public License v3", "mit licénse mit_license", "ÀMIT license MIT\nlicense", "gnu general public", "word " * 5000 + "cc by " * 500]
    texts += ["This work is licensed under the GNU General Public License, version 3."] * 2
    docs = spark.createDataFrame([(None if i == 4 else i, t, "x", i) for i, t in enumerate(texts)] + [(3, texts[3], "y", 9)], "doc_id long, text string, template string, grams int")
    got = license_scan(docs).collect()
    assert len(got) == len(texts) + 1
    by_id = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        r = by_id[None if i == 4 else i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), i
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert by_id[9].labels == "gpl,gpl-3.0"


def test_changed_template_is_found(spark):
    text = "so permission is hereby granted free of any charge to a person obtaining a copy of this nice software etc"
    (r,) = license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r.labels == "mit" and r.base_labels == "" and r.n_base == 0 and 0.8 <= r.score < 1


def test_no_rows(spark):
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_texts_and_paragraphs(spark):
    mit = next(" ".join(words) for words, label in KNOWN if label == "mit" and len(words) > 100)
    words = mit.split()
    changed = " ".join("thing" if i % 25 == 7 else w for i, w in enumerate(words))
    docs = [(1, f"My code. {mit.upper()}!"), (2, changed), (3, " ".join(words[: len(words) // 3])), (4, "the software is provided to the user and the rights of the author are in the book " * 40)]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1].labels == got[2].labels == "mit" and got[1].score == 1 and 0.8 <= got[2].score <= 1
    assert f"mit:2:{2 + len(words)}" in got[1].spans.split(",")
    # a third holds the opening, which is a template of its own, but not the whole
    assert got[3].spans == "mit:0:16" and got[4].labels == ""
