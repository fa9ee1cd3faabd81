from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrain.llm import suffix_dedup as S


def brute(rows: list[tuple]) -> list[tuple]:
    seen: set[bytes] = set()
    out = []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            window = raw[i : i + 100]
            if window in seen:
                gone[i : i + 100] = True
            seen.add(window)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def corpus() -> list[tuple]:
    rng = random.Random(7)
    say = lambda n: "".join(rng.choices("abcdeé \n", k=n))
    passages = [say(n) for n in (60, 99, 100, 101, 150, 400)]
    rows = []
    for i in range(60):
        parts = [say(rng.randrange(0, 150))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), say(rng.randrange(0, 60))]
        rows.append((i * 3, "".join(parts)))
    rows += [(500, rows[4][1]), (501, rows[4][1][:-1] + "z"), (502, "ab" * 3000), (503, "c" * 250), (504, (say(70)) * 5), (505, None), (506, ""), (507, say(99)), (508, "xy" + "ab" * 200), (None, rows[7][1])]
    rows += [(600 + n, "".join(rng.choices("abcdefghijkl", k=n)) * (300 // n + 2)) for n in range(1, 140, 4)] + [(800 + n, "".join(rng.choices("mnopqrst", k=n)) * 5) for n in (67, 68, 69, 70, 71, 100)]
    return rows + [(509, "".join(passages) * 3)]


def test_like_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, first int, bucket string")
    got = S.remove_repeats(docs.repartition(5)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(S, "CROWD", 2)
    rows = corpus()
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_long_texts_in_chunks(spark, monkeypatch):
    for name, size in (("CHUNK", 130), ("MOST", 80), ("BLOCK_BYTES", 500)):
        monkeypatch.setattr(S, name, size)
    rows = corpus()
    batch = pa.RecordBatch.from_pydict({"doc": [r[0] or -1 for r in rows], "sub": [0] * len(rows), "text": [r[1] or "" for r in rows]})
    # in this process, as workers would not see the changed sizes
    settled, contents = [], {}
    found = pa.Table.from_batches(list(S._stretches(iter([batch])))).sort_by([(k, "ascending") for k in S.ORDER])
    texts = {r[0] or -1: (r[1] or "").encode() for r in rows}
    for got in S._settle(iter(found.to_batches())):
        for x in got.to_pylist():
            if x["open"]:
                contents[x["bucket"], x["doc"], x["sub"], x["first"]] = texts[x["doc"]][x["first"] : x["first"] + x["n"] + 99]
            else:
                settled.append((x["doc"], x["first"], x["n"]))
    blocks = pa.RecordBatch.from_pylist([dict(zip(("bucket", "doc", "sub", "first", "bytes"), (*k, v), strict=True)) for k, v in sorted(contents.items())], schema=pa.schema([("bucket", pa.int64()), ("doc", pa.int64()), ("sub", pa.int64()), ("first", pa.int32()), ("bytes", pa.binary())]))
    for got in S._sorted_blocks(iter([blocks])):
        settled += [(x["doc"], x["first"], x["n"]) for x in got.to_pylist()]
    want = {r[0] or -1: r[2] for r in brute(rows)}
    for doc, text in texts.items():
        gone = np.zeros(len(text), bool)
        for d, first, n in settled:
            if d == doc:
                gone[first : first + n + 99] = True
        assert gone.sum() == want[doc], doc


def test_repeated_rows_are_one_document(spark):
    text = "".join(random.Random(1).choices("abcdef", k=300))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in S.remove_repeats(docs).collect()) == [(1, 0), (1, 0), (2, 300)]
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_long_text(spark):
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefgh", k=400_000))
    docs = spark.createDataFrame([(1, text), (2, text[1000:300_000] + "tail" + "".join(rng.choices("xyz", k=200)))], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in S.remove_repeats(docs).collect()}
    assert got == {1: (0, 0), 2: (299_000, 1)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab"), min_size=1, max_size=12), min_size=1, max_size=5), st.integers(20, 60))
def test_sorting_like_brute_force(seeds, times):
    segments = [(s * times).encode()[: 100 + 37 * (i + 1)] for i, s in enumerate(seeds)]
    segments = [s for s in segments if len(s) >= 100]
    if not segments:
        return
    begin = np.cumsum([0] + [len(s) for s in segments[:-1]])
    count = np.array([len(s) - 99 for s in segments])
    got = set(S.repeated_windows(b"".join(segments), begin, count, np.zeros(len(segments), np.int64)).tolist())
    seen, want = set(), set()
    for s, b in zip(segments, begin.tolist(), strict=True):
        for i in range(len(s) - 99):
            want |= {b + i} if s[i : i + 100] in seen else set()
            seen.add(s[i : i + 100])
    assert got == want


def test_cover():
    for v in (8, 16, 32, 64):
        c = S.difference_cover(v)
        assert {(int(a) - int(b)) % v for a in c for b in c} == set(range(v))
