from __future__ import annotations

import random

import numpy as np
import pytest

from pulsegrain.llm import decontamination as D


def distance_in(item: bytes, text: bytes) -> int:
    """Fewest edits of `item` against any part of `text`, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def changed(rng: random.Random, text: str, n: int) -> str:
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = rng.choice("xyz")
        elif kind == 1:
            out.insert(i, rng.choice("xyz"))
        else:
            del out[i]
    return "".join(out)


def fold(text: str | None) -> bytes:
    return D._FOLD[np.frombuffer((text or "").encode(), np.uint8)].tobytes()


def holds(item: str, text: str | None) -> bool:
    """By trying every place, or every cell of the alignment."""
    t, x = fold(item), fold(text)
    if len(t) >= D.EDITED:
        return distance_in(t, x) <= len(t) // 20
    word = lambda c: bytes([c]).isalnum() or c > 127
    free = lambda a, z: len(t) >= D.WORDS or not ((a and word(x[a - 1]) and word(t[0])) or (z < len(x) and word(x[z]) and word(t[-1])))
    return any(x[a : a + len(t)] == t and free(a, a + len(t)) for a in range(len(x) - len(t) + 1))


def tables(spark) -> tuple[list, list]:
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(60)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, say(rng.randint(9, 40))) for i in range(12)] + [(91, None), (None, say(20)), (3, say(15)), (92, " \t"), (93, ""), (94, "?"), (95, "é")]
    # 1 to 39 bytes
    items += [(100 + n, "".join(rng.choices("abcdefgh ", k=n - 2)).strip().ljust(n - 2, "h") + "gz") for n in range(3, 40, 2)] + [(200 + n, "q" * n) for n in (1, 2, 8, 12, 19)]
    docs = [(0, None), (1, ""), (2, say(50)), (3, "what? 😀 é, x"), (4, "été qq qqq"), (5, "q " * 3 + "q" * 8 + "!" + "q" * 12 + " " + "q" * 40)]
    for n, (_, t) in enumerate((i, t) for i, t in items if t and i is not None and t.strip()):
        e = D.edits(len(t.encode()))
        for k in sorted({0, 1, e, e + 3}):
            docs.append((10 * n + 10 + k, f"{say(20)} {changed(rng, t.upper() if n % 2 else t, min(k, len(t) - 1))}\n{say(10)}"))
        docs.append((5000 + n, f"{say(3)} a{t}b {t}"))
    docs += [docs[7], (None, docs[8][1])]
    return docs, items


def wanted(docs: list, items: list) -> list:
    real = [(i, t) for i, t in items if t and i is not None and t.strip()]
    return sorted((d if d is not None else -1, ",".join(map(str, sorted({i for i, t in real if holds(t, x)})))) for d, x in docs)


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 0])
def test_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    docs, items = tables(spark)
    found = D.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = wanted(docs, items)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.item_ids) for r in found) == want
    kept = D.decontaminate(spark.createDataFrame([(d, x, "en", 1) for d, x in docs], "doc_id long, text string, spans string, items int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(d for d, ids in want if not ids)


def test_a_large_benchmark_gives_the_same_spans(spark, monkeypatch):
    docs, items = (spark.createDataFrame(x, f"{n} long, text string") for x, n in zip(tables(spark), ("doc_id", "item_id"), strict=True))
    one = sorted(map(str, D.find_contamination(docs, items).collect()))
    monkeypatch.setattr(D, "BLOCK_BYTES", 0)
    assert sorted(map(str, D.find_contamination(docs, items).collect())) == one


def test_a_text_in_chunks(spark, monkeypatch):
    docs, items = tables(spark)
    docs = [(1, " ".join(t or "" for _, t in docs))]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    (one,) = D.find_contamination(*frames).collect()
    data, ends = np.frombuffer(docs[0][1].encode(), np.uint8), np.array([0, len(docs[0][1].encode())])
    searcher = D.Searcher([(i, t.encode()) for i, t in items if t and t.strip() and i is not None])
    (whole,) = searcher.search(data, ends)
    monkeypatch.setattr(D, "CHUNK", 300)
    (parts,) = searcher.search(data, ends)
    assert whole[3] == parts[3] and len(whole[3]) == len(one.spans.split(","))


def test_repeated_characters(spark):
    docs = spark.createDataFrame([(1, "a" * 5000), (2, "b" * 100)], "doc_id long, text string")
    got = D.find_contamination(docs, spark.createDataFrame([(7, "A" * 60)], "item_id long, text string")).collect()
    assert {r.doc_id: r.contaminated for r in got} == {1: True, 2: False}


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert D.find_contamination(none, items).collect() == []
    (r,) = D.find_contamination(spark.createDataFrame([(1, "x" * 50)], "doc_id long, text string"), items).collect()
    assert not r.contaminated and r.spans == ""
