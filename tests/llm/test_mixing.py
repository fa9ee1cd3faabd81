from __future__ import annotations

import re
from collections import defaultdict

import pytest

from pulsegrain.llm.mixing import mix, mix_sizes


def filled(sizes: dict, weights=(5, 2, 1), most: int = 3) -> dict:
    """Targets by going round: give by weight, stop at the limit, share what is left again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, free = float(sum(sizes.values())), [s for s in names if sizes[s]]
    while left > 1e-9 and free:
        unit = left / sum(weight[s] for s in free)
        for s in free:
            target[s] = min(most * sizes[s], target[s] + unit * weight[s])
        left = sum(sizes.values()) - sum(target.values())
        free = [s for s in free if target[s] < most * sizes[s] - 1e-9]
    return target


def documents(n: int = 3000) -> list[tuple]:
    rows = []
    for i in range(n):
        source = None if i % 50 == 0 else "hot" if i % 3 == 0 else f"s{i * i % 7}" if i % 200 else "tiny"
        rows.append((i, " ".join("word" for _ in range(i * 7919 % 90 + 1)), source))
    return rows


def test_targets_and_words_taken(spark):
    rows = documents() + [(9000, None, "s1"), (9001, "", "s1"), (9002, " \t ", "empty"), (9003, "a " * 4000, "s2"), (None, "no id at all", "s3"), (5, "word word", "s4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnsRenamed({}).selectExpr("*", "1 AS copies", "'x' AS target", "2 AS p")
    got = mix_sizes(docs).collect()
    assert len(got) == len(rows)
    sizes: dict = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = filled(sizes)
    source = {d: s for d, _, s in rows[:-1] if d is not None} | {None: "s3"}
    taken: dict = defaultdict(int)
    largest: dict = defaultdict(int)
    for r in got:
        s = "s4" if r.doc_id == 5 and r.size == 2 else source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s], s
    assert sorted(got, key=str) == sorted(mix_sizes(docs.repartition(7)).collect(), key=str)
    kept = mix(docs).collect()
    assert sum(len((r.text or "").split()) * r.copies for r in kept) == sum(taken.values()) and set(kept[0].asDict()) == {"doc_id", "text", "source", "copies", "target", "p"}


def test_weighted_inclusion(spark):
    rows = [(i, "a b c d", "x" if i % 2 else "y", 3.0 if i % 4 < 2 else 1.0) for i in range(4000)]
    got = mix_sizes(spark.createDataFrame(rows, "doc_id long, text string, source string, w double"), weight="w").collect()
    of = {i: w for i, _, _, w in rows}
    heavy, light = (sum(r.taken for r in got if of[r.doc_id] == w) for w in (3.0, 1.0))
    assert 2.2 < heavy / light < 3.8 and max(r.taken for r in got) <= 12
    for s in ("x", "y"):
        mine = [r for r in got if ("x" if r.doc_id % 2 else "y") == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 4


def test_one_source_and_none(spark):
    (a, b) = mix_sizes(spark.createDataFrame([(1, "x y", "s"), (2, "z", "s")], "doc_id long, text string, source string")).orderBy("doc_id").collect()
    assert (a.target, a.taken, b.taken) == (3.0, 2, 1)
    assert mix_sizes(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    (r,) = mix_sizes(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).collect()
    assert (r.size, r.source_size, r.target, r.taken) == (0, 0, 0.0, 0)
