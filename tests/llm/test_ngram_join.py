from __future__ import annotations

import random
import re

import numpy as np
import pytest

from pulsegrain.llm import ngram_join as J
from pulsegrain.llm.components import connected_components


def shingles(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows: list[tuple]) -> list[tuple]:
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    links = [[j for j in range(n) if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in links[i])]) for i in range(n)]
        if new == root:
            break
        root = new
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        out.append((rows[i][0], min(ids, default=None), len(links[i])))
    return sorted(out, key=str)


def corpus(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choices(words, k=12))
    rows: list[tuple] = []
    for g in range(40):
        base = rng.choices(words, k=rng.choice([3, 5, 8, 40, 120]))
        for c in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(c % 4):
                copy[rng.randrange(len(copy))] = "edit"
            rows.append((len(rows), ("" if g % 3 else line + "\n") + " ".join(copy)))
    return rows


def test_like_brute_force(spark):
    rows = corpus()
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "one"), (905, "x " * 30000), (906, rows[5][1]), (5, rows[5][1]), (None, rows[9][1]), (None, "alone with no id at all here")]
    docs = spark.createDataFrame([(*r, "sig", 1) for r in rows], "doc_id long, text string, class string, kept_ int")
    got = J.ngram_jaccard_join(docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    kept = J.keep_one_of_each_group(docs).collect()
    assert kept[0].asDict().keys() == {"doc_id", "text", "class", "kept_"}
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == firsts(rows)


def firsts(rows: list[tuple]) -> list[tuple]:
    """Of each group of linked texts the first row by id, null last, told by the texts; without words each row."""
    sets = [shingles(t) for _, t in rows]
    out, left = [], set(range(len(rows)))
    while left:
        group, work = set(), [left.pop()]
        while work:
            i = work.pop()
            group.add(i)
            near = {j for j in left if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
            left -= near
            work += near
        least = min((rows[i][0] is None, rows[i][0] or 0) for i in group)
        mine = {rows[i] for i in group if (rows[i][0] is None, rows[i][0] or 0) == least}
        assert len(mine) == 1
        out += mine
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_an_id_that_two_texts_share(spark, parts):
    a, b = "a b c d e f g h", "other words than those of a"
    docs = spark.createDataFrame([(3, a, "x"), (7, a, "x"), (7, b, "x"), (9, b + " ", "y"), (9, None, "z"), (9, None, "z"), (3, a, "w")], "doc_id long, text string, source string").repartition(parts)
    kept = sorted(((r.doc_id, r.text) for r in J.keep_one_of_each_group(docs).collect()), key=str)
    assert kept == sorted([(3, a), (7, b), (9, None), (9, None)], key=str)


@pytest.mark.parametrize("limit", [256, 8])
def test_a_chain_of_many_texts(spark, monkeypatch, limit):
    monkeypatch.setattr(J, "BLOCK", limit)
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(1000)]
    # each text shares nine tenths with the next and the more distant ones less; a dense core hangs on it
    rows = [(i, " ".join(words[i * 6 : i * 6 + 100])) for i in range(60)]
    core = words[300:400]
    for i in range(30):
        copy = list(core)
        copy[rng.randrange(100)] = f"e{i}"
        rows.append((100 + i, " ".join(copy)))
    got = J.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


@pytest.mark.parametrize("crowd", [4096, 10])
def test_a_large_group_in_blocks(spark, monkeypatch, crowd):
    monkeypatch.setattr(J, "BLOCK", 16)
    monkeypatch.setattr(J, "CROWD", crowd)
    rng = random.Random(3)
    base = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(90):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = J.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_pruning_keeps_what_may_reach_the_threshold():
    least = dict(J.fewest_matches())
    assert list(least) == list(range(10, 101, 10)) and all(0 <= m <= 0.8 * n for n, m in least.items())
    rng = np.random.default_rng(1)
    lost = sum(any((np.cumsum(rng.random(100) < 0.8)[n - 1] < m) for n, m in least.items()) for _ in range(3000))
    assert lost <= 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (200, 200)] + [(300, j) for j in range(301, 340)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 200: 200, **{i: 300 for i in range(300, 340)}}


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert J.ngram_jaccard_join(none).collect() == [] == J.keep_one_of_each_group(none).collect()
