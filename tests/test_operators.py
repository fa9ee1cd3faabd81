"""Operators against fixed values and brute force."""

from __future__ import annotations

import binascii
import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrain.functions import checksums, folds, mfm, registry, signal
from pulsegrain.operators import aggregates, cluster, loops, marks, merge, search, sequence, timeline

LONG = "the quick onyx goblin jumps over a lazy dwarf"
HELLO = "tick tock goes the clock, and tick tock again tick"


def one(df):
    (r,) = df.collect()
    return r


def long_form(spark, values, key=1):
    return spark.createDataFrame([(key, i, int(v)) for i, v in enumerate(values)], "k int, pos long, v int")


def hits(spark, text, needles):
    hay = spark.createDataFrame([(1, text)], "id int, text string")
    found = search.find_matches(hay, "id", "text", spark.createDataFrame(list(enumerate(needles)), "n int, needle string"), "n", "needle")
    return sorted((r.idx, r.needle_id) for r in found.collect())


def test_search_gold(spark):
    assert hits(spark, HELLO, ["tack"]) == []
    assert hits(spark, HELLO, ["tick"]) == [(0, 0), (30, 0), (46, 0)]
    text = "near the old mill, " + LONG
    assert hits(spark, text, [LONG, "goblin  jumps", "goblin jumps"]) == [(19, 0), (text.index("goblin jumps"), 2)]
    assert hits(spark, "é" * 1000 + "añb" * 3, ["añbañb", "ñb"]) == [(1000, 0), (1001, 1), (1003, 0), (1004, 1), (1007, 1)]


def test_search_edges(spark):
    hay = spark.createDataFrame([(1, None), (2, ""), (3, "aaaa"), (3, "aaaa")], "id int, text string")
    needles = spark.createDataFrame([(7, "aa")], "n int, needle string")
    assert sorted(r.idx for r in search.find_matches(hay, "id", "text", needles, "n", "needle").collect()) == [0, 0, 1, 1, 2, 2]
    assert one(search.find_apart(hay.where("id = 3").limit(1), "id", "text", "aa")).starts == [0, 2]
    with pytest.raises(ValueError):
        search.find_matches(hay, "id", "text", spark.createDataFrame([(1, "")], "n int, needle string"), "n", "needle")
    with pytest.raises(ValueError):
        search.checked(spark.createDataFrame([(1, "abc"), (2, "xbc")], "n int, needle string").withColumn("needle", F.expr("right(needle, 2)")), "n", "needle", unique=True)
    assert search.first_matches(hay, "id", "text", needles, "n", "needle", 2).count() == 2


def test_search_of_pieces_like_find(spark):
    rng = random.Random(2)
    text = "".join(rng.choices("abé", k=3000))
    needle = text[1200:1210]
    want = [i for i in range(len(text)) if text.startswith(needle, i)]
    assert [i for i, _ in hits(spark, text, [needle, "zzzzzzzzzz"])] == want
    assert [i for i, _ in hits(spark, text, [text[100:700]])] == [100]


def test_joined_search_like_the_automaton(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choices("abé", k=rng.randrange(400)))) for i in range(30)] + [(99, None), (98, "")]
    hay = spark.createDataFrame(rows, "id int, text string")
    needles = spark.createDataFrame([(i, "".join(rng.choices("abé", k=rng.randrange(2, 6)))) for i in range(20)] + [(50, "ab"), (51, "ab")], "n int, needle string")
    one_way = sorted(map(tuple, search.find_matches(hay, "id", "text", needles, "n", "needle").collect()))
    monkeypatch.setattr(search, "AUTOMATON_CHARS", 0)
    assert sorted(map(tuple, search.find_matches(hay, "id", "text", needles, "n", "needle").collect())) == one_way and one_way


def test_band_matches(spark):
    # rises and falls as 0 0 1 0 from place 1 on; the second place has overlapping bands
    df = long_form(spark, [50, 10, 11, 30, 12, 40, 41, 45, 44, 90])
    found = search.band_matches(df, ["k"], "pos", "v", {7: (0, 0, 1, 0)}).collect()
    assert [(r.start, r.needle_id, [tuple(x) for x in r.intervals], r.centers) for r in found] == [(1, 7, [(10.0, 12.0), (30.0, 30.0)], [11.0, 30.0]), (5, 7, [(40.0, 44.0), (45.0, 45.0)], [41.0, 45.0])]
    df = long_form(spark, [50, 10, 31, 30, 12, 40])
    assert not search.band_matches(df, ["k"], "pos", "v", {7: (0, 0, 1, 0)}).where("start = 1").collect()


def test_rolling_hashes(spark):
    values = np.array([0, 1, 2, 0, 1, 2, 2, 0])
    want = []
    for end in range(1, 9):
        h = 0
        for x in values[max(0, end - 3) : end].tolist():
            h = (h * search.ROLL_MULTIPLIER + x) % search.ROLL_MODULUS
        want.append(h)
    assert search.rolling_hashes(values, 3).tolist() == want
    df = spark.createDataFrame([(1, "2201210002"), (2, "222222"), (3, None)], "id int, bands string")
    got = {(r.id, r.start) for r in search.hash_candidates(df, "id", "bands", "0121", 4, 0, 0, 1, "012").collect()}
    # a deletion cuts the needle to three symbols, which occur at places 2 and 3
    assert (1, 2) in got and not any(i in (2, 3) for i, _ in got)


def test_near_and_corrupted(spark):
    assert "ab" in search.corruptions("abc", 0, 0, 1, "abc") and "aabc" in search.corruptions("abc", 0, 1, 0, "abc") and len(search.corruptions("abc", 1, 0, 0, "abc")) == 7
    texts = spark.createDataFrame([(1, "xxabcdxx"), (2, "xxabdxx"), (3, "xxabZcdxx"), (4, None)], "id int, text string")
    found = search.near_matches(texts, "id", "text", "abcd", 0, 1, 1).collect()
    best = {i: min(r.edits for r in found if r.id == i) for i in (1, 2, 3)}
    assert best == {1: 0, 2: 1, 3: 1}


def test_near_pairs_like_brute_force(spark):
    def edits(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(4)
    texts = ["", "a", "ab", "red bolt", "bed bolt", "d bolt", "xxred bolt", "é😀 bolt"] + ["".join(rng.choices("abc", k=rng.randrange(14))) for _ in range(60)]
    df = spark.createDataFrame([(x,) for x in [*texts, "red bolt", None]], "t string")
    for most in (0, 1, 4):
        got = search.near_pairs(df, "t", df, "t", most).collect()
        want = {(a, b, d) for a in texts for b in texts if (d := edits(a, b)) <= most}
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_sign_codes(spark):
    df = long_form(spark, [3, 2, 2, 3])
    assert [r.sign for r in sequence.ordinal(df, ["k"], "pos", "v", padding=False).orderBy("pos").collect()] == [-1, 0, 1]
    assert [r.sign for r in sequence.ordinal(df, ["k"], "pos", "v").orderBy("pos").collect()] == [0, -1, 0, 1]
    assert [r.increase for r in sequence.increases(df, ["k"], "pos", "v").orderBy("pos").collect()] == [False, False, True]
    assert sequence.wildcard_needle([5, 5, 5, 7, 6]) == (2, [True, False])
    with pytest.raises(ValueError):
        sequence.wildcard_needle([5, 6, 6])


def test_run_lengths(spark):
    runs = sequence.zero_runs(long_form(spark, [0, 0, 1, 0, 1]), ["k"], "pos", "v").orderBy("run_no").collect()
    assert [(r.run_len, r.at_least) for r in runs] == [(2, True), (1, False)]
    with pytest.raises(ValueError):
        sequence.compile_needle([0, 1, 0])
    with pytest.raises(ValueError):
        sequence.compile_needle([1, 0, 1, 0, 1])


def test_false_positive_clock(spark):
    runs = sequence.zero_run_lengths([int(c) for c in "100101000101"])
    exact = [(b, False) for b, at_least in runs if not at_least]
    df = spark.createDataFrame([([30, 10, 20, 11],), ([30, 20, 40, 20],), ([30, 20],)], "d array<int>")
    assert [r.c is not None for r in df.select(signal.clock_fit(F.col("d"), exact).alias("c")).collect()] == [False, True, False]


def test_decode_delays_like_the_codec(spark):
    rng = np.random.default_rng(1)
    raw = mfm.pack_delays(rng.integers(0, 300, 60)) + bytes([63, 2])
    df = long_form(spark, list(raw))
    got = [r.delay for r in sequence.decode_delays(df, ["k"], "pos", "v").orderBy("pos").collect()]
    assert got == mfm.unpack_delays(raw).tolist()


def test_bit_round_trip(spark):
    rng = np.random.default_rng(5)
    data = bytes(rng.integers(0, 256, 40, dtype=np.uint8))
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    df = long_form(spark, bits)
    coded = sequence.mfm_encode(df, ["k"], "pos", "v")
    assert "".join(str(r.bit) for r in coded.orderBy("bit_pos").collect()) == mfm.encode(data, 1)
    back = sequence.mfm_decode(coded, ["k"], "bit_pos", "bit")
    assert back.where("error <> 0").count() == 0
    found = sequence.bits_to_bytes(back, ["k"], "bit_pos", "bit", "error").orderBy("byte_pos").collect()
    assert bytes(r.byte for r in found) == data and all(r.err_mask == 0 for r in found)
    broken = sequence.mfm_decode(long_form(spark, [0, 1, 1, 0, 1, 1, 0, 1, 0]), ["k"], "pos", "v").orderBy("bit_pos").collect()
    assert [(r.bit, r.error) for r in broken] == [(1, 0), (0, 1), (None, 0), (1, 0)]


def test_quantise_round_trip(spark):
    rng = np.random.default_rng(6)
    zeros = rng.integers(1, 4, 50)
    q = sequence.quantised(long_form(spark, (zeros + 1) * 12 + rng.integers(-2, 3, 50)), "v", 24.0)
    bits = sequence.expand_bits(q, ["k"], "pos").orderBy("bit_pos").collect()
    assert "".join(str(r.bit) for r in bits) == "1" + "".join("0" * z + "1" for z in zeros) and bits[-1].flux_idx == 49
    bands = sequence.bands_from_bits(sequence.expand_bits(q, ["k"], "pos"), ["k"], "bit_pos", "bit").orderBy("bit_pos").collect()
    assert [r.band for r in bands] == [z - 1 for z in zeros]
    with pytest.raises(Exception, match="begin with a 1"):
        sequence.bands_from_bits(long_form(spark, [0, 1, 0, 1]), ["k"], "pos", "v").collect()


def test_checksums(spark):
    values = ["test", "", "é😀", "x" * 300, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = df.select(checksums.crc16(F.col("v")).alias("a"), checksums.crc16_bitwise(F.col("v")).alias("b"), checksums.crc16_long(F.encode("v", "utf-8")).alias("c"), checksums.fnv32(F.col("v")).alias("f"), checksums.poly_hash(F.col("v")).alias("p")).collect()
    assert got[0].a == 8134
    for v, r in zip(values, got, strict=True):
        raw = None if v is None else v.encode()
        want = None if raw is None else binascii.crc_hqx(raw, 0xFFFF)
        assert r.a == r.b == r.c == want
        f, p = 2166136261, 0
        for b in raw or b"":
            f, p = (f ^ b) * 16777619 % 2**32, (p * 33 + b) % 2**32
        assert raw is None or (r.f, r.p) == (f, p)


def test_headers(spark):
    row = spark.range(1).select(marks.with_crc(marks.header_bytes(F.lit(4), F.lit(1), F.lit(11), F.lit(2))).alias("raw"))
    assert bytes(one(row).raw).hex().upper() == "A1A1A1FE04010B02D865"
    h = one(row.select(marks.parse_header(F.col("raw")).alias("h"), marks.parse_header(F.substring("raw", 1, 9)).alias("short")))
    assert h.h.asDict() == {"track": 4, "head": 1, "sector": 11, "datalen": 512, "crc": 0xD865, "crc_ok": True} and h.short is None
    data = spark.range(1).select(marks.with_crc(marks.data_bytes(F.lit(bytearray(range(128))), deleted=True)).alias("raw"))
    d = one(data.select(marks.parse_data(F.col("raw"), F.lit(128)).alias("d"), marks.parse_data_of_unknown_length(F.col("raw")).alias("u"), marks.parse_data(F.col("raw"), F.lit(256)).alias("short"), signal.mark_type(F.col("raw")).alias("t")))
    assert d.d.crc_ok and d.d.deleted and bytes(d.u.data) == bytes(range(128)) and d.short is None and d.t == "DDAM"
    assert one(spark.range(1).select(signal.sector_size(F.lit(9)).alias("n"))).n == 8192


def brute_cost(values, centers):
    return sum(min(abs(v - c) for c in centers) for v in values)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=9), st.integers(1, 3))
def test_k_median_is_optimal(values, k):
    v, n = np.unique(values, return_counts=True)
    centers, cost = cluster.k_median(v, n, k)
    assert cost == min(brute_cost(values, c) for c in itertools.combinations(sorted(set(values)), min(k, len(v)))) == brute_cost(values, centers)
    assert centers == sorted(centers)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=7), st.integers(1, 2), st.sampled_from([0.5, 1.0, 2.0]))
def test_k_center_is_optimal(values, k, radius):
    v, n = np.unique(values, return_counts=True)
    centers, reach, dropped = cluster.k_center(v, n, k, radius)
    assert sum(min(abs(x - c) for c in centers) > reach + 1e-9 for x in values) <= dropped
    halves = [x / 2 for x in range(0, 25)]
    best = min(r + 1e-3 * sum(min(abs(x - c) for c in cs) > r for x in values) for cs in itertools.combinations(halves, k) for r in {abs(x - c) for x in values for c in cs if abs(x - c) <= radius} | {0.0})
    assert reach + 1e-3 * dropped == pytest.approx(best)


def test_clusters(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 1, 2, 50, 51, 99)] + [("b", 5)], "g string, v int")
    got = {r.g: r for r in cluster.clusters(df, ["g"], "v", 3).collect()}
    assert got["a"].centers == [1.0, 50.5, 99.0] and got["a"].cost == 2.0 and got["b"].centers == [5.0]
    assert {r.g: (r.start, r.n) for r in cluster.densest_window(df, ["g"], "v", 1).collect()} == {"a": (1, 3), "b": (5, 1)}
    assert one(cluster.clusters(df.where("v < 0"), [], "v", 2).groupBy().count())["count"] == 0


def test_weighted_median(spark):
    df = spark.createDataFrame([(1, x) for x in (0, 0, 1, 1)] + [(2, x) for x in (0, 1, 3)], "g int, v int")
    assert {r.g: r.median for r in aggregates.weighted_median(df, ["g"], "v").collect()} == {1: 0.5, 2: 1.0}
    cdf = aggregates.weighted_cdf(df.where("g = 1"), [], "v").orderBy("v").collect()
    assert [tuple(r) for r in cdf] == [(0, 2, 0), (1, 4, 2)]


def test_intervals(spark):
    df = spark.createDataFrame([([(17, 28), (33, 37), (38, 54)],)], "i array<struct<lo:int,hi:int>>")
    c = one(df.select(signal.interval_centers(F.col("i"), F.lit(22.5)).alias("c"))).c
    assert c == sorted(c) and c[0] == max(22.5, 33 + 28 - 37) and c[1] == 33 + 28 - c[0]
    r = one(df.select(*[signal.bands_of(F.lit(x), F.col("i")).alias(f"b{x}") for x in (5, 20, 30, 60)]))
    assert list(r) == [[0], [0], [0, 1], [2]]
    near = one(spark.range(1).select(signal.nearest(F.lit(20), [10, 30, 50]).alias("n"), signal.ranked_centers(F.lit(20), [10, 30, 50]).alias("r")))
    assert near.n.band == 0 and near.n.residual == 10 and near.r == [0, 1, 2]
    assert cluster.random_centers([(17, 28), (33, 37), (45, 54)], 1) is not None and cluster.random_centers([(0, 9), (9, 9), (9, 9)], 1, 50) is None


def test_folds_like_numpy(spark):
    rng = np.random.default_rng(8)
    d = rng.integers(5, 70, 300)
    row = one(spark.createDataFrame([([int(x) for x in d],)], "d array<int>").select(folds.tracked(F.col("d"), 12.0, 0.1).alias("t"), folds.smoothest_cost(F.col("d"), 24.0).alias("c")))
    zeros, _, rmse = mfm.track(d, 24.0, 0.1)
    assert row.t.n_zeroes == zeros.sum() and (row.t.squares / len(d)) ** 0.5 == pytest.approx(rmse)
    cost = None
    for x in d:
        e = [x - 12 * p for p in (2, 3, 4, 5)]
        cost = dict.fromkeys(range(4), 0.0) if cost is None else {p: min(cost[q] + (e[p] - was[q]) ** 2 for q in range(4)) + (e[p] / 100) ** 2 for p in range(4)}
        was = e
    assert row.c == pytest.approx(min(cost.values()) ** 0.5)


def test_smoothest_and_zeroes(spark):
    rng = np.random.default_rng(3)
    d = [int(x) for x in rng.integers(20, 66, 7)]
    row = one(spark.createDataFrame([(d,), (None,)], "d array<int>").where("d IS NOT NULL").select(folds.smoothest(F.col("d"), 24.0).alias("s"), folds.smoothest_cost(F.col("d"), 24.0).alias("c"), folds.tracked_zeroes(F.col("d"), 24.0, 0.1).alias("z")))
    cost = lambda way: sum((x - w - (a - b)) ** 2 + ((x - w) / 100) ** 2 for (a, b), (x, w) in itertools.pairwise(zip(d, way, strict=True)))
    assert cost(row.s) == pytest.approx(row.c**2) == pytest.approx(min(cost(w) for w in itertools.product((24.0, 36.0, 48.0, 60.0), repeat=7)))
    assert row.z == mfm.track(np.array(d), 24.0, 0.1)[0].tolist()
    long = one(spark.createDataFrame([([int(x) for x in rng.integers(20, 66, 130_000)],)], "d array<int>").select(folds.tracked(F.col("d"), 12.0, 0.1)["n"].alias("n"), folds.biased(F.col("d"), 24.0, 0.1)["n_zeroes"].alias("z")))
    assert long.n > 100_000 and long.z > 0


def test_fixed_point_and_warps(spark):
    assert one(spark.range(1).select(signal.mark_type(marks.index_bytes()).alias("k"))).k == "IAM"
    r = one(spark.range(1).select(signal.lp_distance_fixed(F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(3.0), F.lit(5.0)), 2).alias("d"), signal.stretched(F.lit(40), 0.25).alias("s"), signal.warped(F.lit(40), F.lit(0), 0.0, 4.0, 0.1).alias("w")))
    assert (r.d, r.s, r.w) == (5000, 50, 42)
    kinds = spark.createDataFrame([("IDAM", 0), ("IAM", 0), ("DAM", 512), ("UNKNOWN", 0)], "k string, n int")
    assert [r.b for r in kinds.select(signal.byte_length(F.col("k"), F.col("n")).alias("b")).collect()] == [10, 4, 518, None]


def test_local_medians_start_and_follow(spark):
    assert cluster.repaired([11.0, 12.0, 31.0], [10.0, 20.0, 30.0]).tolist() == [11.0, 20.0, 31.0]
    rng = np.random.default_rng(4)
    band = rng.integers(0, 3, 900)
    values = np.round(np.array([20.0, 30.0, 40.0])[band] * (1 + np.arange(900) / 3000) + rng.normal(0, 0.5, 900))
    df = long_form(spark, values)
    got = cluster.local_centers(df, ["k"], "pos", "v").orderBy("pos").collect()
    assert (np.array([r.band for r in got]) == band).mean() > 0.99
    # by hand: one step of reassigning and taking lower medians at each row
    v, n = np.unique(values, return_counts=True)
    w, m = np.unique(values[:151], return_counts=True)
    home = cluster.k_median(v, n, 3)[0]
    now = cluster.repaired(cluster.k_median(w, m, 3)[0], home).tolist()
    cost = lambda c, near: sum(min(abs(x - y) for y in c) for x in near)
    for i, r in enumerate(got):
        near = values[max(0, i - 150) : i + 151].tolist()
        if i and i % 801 == 0 and cost(home, near) < cost(now, near):
            now = list(home)
        own = [min(range(3), key=lambda b, x=x: (abs(x - now[b]), b)) for x in near]
        now = [sorted(x for x, o in zip(near, own, strict=True) if o == b)[(own.count(b) - 1) // 2] if own.count(b) > 10 else now[b] for b in range(3)]
        assert r.centers == now


def test_loops_follow_a_drift(spark):
    rng = np.random.default_rng(9)
    band = rng.integers(0, 3, 1500)
    drift = 1 + 0.25 * np.sin(np.arange(1500) / 250)
    values = np.array([20.0, 30.0, 40.0])[band] * drift
    plain = np.abs(values[:, None] - [20, 30, 40]).argmin(1)
    for loop, options in ((loops.lagged, {"alpha": 0.2}), (loops.neighbourhood, {"alpha": 0.3}), (loops.centred, {"alpha": 0.1})):
        assert (loop(values, [20, 30, 40], **options) == band).mean() > max(0.98, (plain == band).mean())
    df = spark.createDataFrame([(1, i, int(v)) for i, v in enumerate(values[:200])], "k int, pos long, v int")
    assert loops.follow(df, ["k"], "pos", "v", loops.lagged).count() == 200
    assert loops.fewest_errors([10, 25], [(8, 12), (28, 32)], lambda a: a[1], lambda a: False) == (0, 0)
    assert loops.fewest_errors([10, 25], [(8, 12), (28, 32)], lambda a: a[1], lambda a: a == (0, 1)) == (0, 1)
    assert dict(loops.header_needles(4, 1, 11, 11, 2))[11].hex().upper() == "A1A1A1FE04010B02D865"


def test_slices_and_pairs(spark):
    matches = spark.createDataFrame([(1, 5), (1, 60), (2, 0)], "k int, start long")
    totals = spark.createDataFrame([(1, 70), (2, 200), (3, 10)], "k int, total long")
    got = sorted(tuple(r) for r in timeline.slices(matches, totals, ["k"], "start", "total").collect())
    assert got == [(1, 0, 0, 5, "TRUNCATED"), (1, 1, 5, 60, "PREAMBLE_FOUND"), (1, 2, 60, 70, "TRUNCATED"), (2, 1, 0, 200, "PREAMBLE_FOUND"), (3, 0, 0, 10, "TRUNCATED")]
    df = spark.createDataFrame([(0, 10, 4, "OK"), (0, 10, None, "OK"), (0, 10, 10, "OK")], "b long, e long, cut long, s string")
    cut = sorted((r.b, r.e, r.s, r.part) for r in timeline.split(df, "b", "e", "cut", "s", "last").collect())
    assert cut == [(0, 4, "UNKNOWN", 0), (0, 10, "OK", 0), (0, 10, "OK", 0), (4, 10, "OK", 1)]
    with pytest.raises(ValueError):
        timeline.split(df, "b", "e", "cut", "s", "both")
    a = spark.createDataFrame([([1, 0, 1], [1, 0], 0), ([1, 0], [0, 1], 1)], "a array<int>, b array<int>, gap int")
    assert [r.t for r in a.select(timeline.joined_trains(F.col("a"), F.col("b"), F.col("gap")).alias("t")).collect()] == [[1, 0, 1, 0], [1, 0, 0, 1]]
    with pytest.raises(Exception, match="adjacent"):
        a.select(timeline.joined_trains(F.col("a"), F.col("b"), F.lit(2)).alias("t")).collect()


def test_placing_slices(spark):
    r = one(spark.createDataFrame([([7, 9, 12],)], "a array<int>").select(timeline.rebase(F.col("a")).alias("r"), timeline.slice_id("a").alias("i"), timeline.slice_id("a").alias("j")))
    assert r.r == [0, 2, 5] and r.i == r.j
    chunks = spark.createDataFrame([(1, 0, 10, False, "a"), (1, 10, 20, True, "b"), (1, 20, 30, False, "c")], "k int, start int, end int, ok boolean, what string")
    found = spark.createDataFrame([(1, 2, 10, True, "x"), (1, 11, 20, True, "y"), (1, 40, 50, True, "z")], "k int, start int, end int, ok boolean, what string")
    assert [r.what for r in timeline.upsert_headers(chunks, found, ["k"], "end", "start", "ok").collect()] == ["x", "b", "c", "z"]


def test_merge(spark):
    old = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "c", False)], "k int, v string, ok boolean")
    new = spark.createDataFrame([(1, "x", True), (2, "y", True), (4, "z", False)], "k int, v string, ok boolean")
    assert sorted(tuple(r) for r in merge.upsert(old, new, ["k"], "ok").collect()) == [(1, "a", True), (2, "y", True), (3, "c", False), (4, "z", False)]
    assert sorted(tuple(r) for r in merge.first_wins([old, new], ["k"], ["v"]).select("k", "v").collect()) == [(1, "a"), (2, "b"), (3, "c"), (4, "z")]
    axes = [spark.createDataFrame([(i,) for i in (1, 2)], "k int"), spark.createDataFrame([("p",), ("q",)], "v string")]
    have = spark.createDataFrame([(1, "q", 5)], "k int, v string, n int")
    assert sorted(tuple(r) for r in merge.dense_grid(axes, have, ["k", "v"], {"n": 0}).collect()) == [(1, "p", 0), (1, "q", 5), (2, "p", 0), (2, "q", 0)]
    assert merge.missing(axes, have, ["k", "v"]).count() == 3


def test_names_for_sql(spark):
    registry.register(spark)
    assert one(spark.sql("SELECT crc16(encode('test', 'utf-8')) AS c")).c == 8134
    assert bytes(one(spark.sql("SELECT mfm_decode('0100010010101001') AS b")).b) == mfm.decode(np.array([int(c) for c in "0100010010101001"], np.uint8))[0]
    assert [r.idx for r in spark.sql(f"SELECT idx FROM match_needles('{HELLO}', 'tick')").collect()] == [0, 30, 46]
    raw = spark.createDataFrame([(b"abc", 0)], "d binary, c int").select(registry.inflate("d", "c").alias("b"))
    assert bytes(one(raw).b) == b"abc"


def test_corrupted_headers(spark):
    needles = {1: "0001200", 2: "0001211", 3: "0001022"}
    df = spark.createDataFrame([(1, "2222" + "0001211" + "22"), (2, "22" + "001211" + "2"), (3, "2" * 20), (4, None)], "id int, bands string")
    found = search.corrupted_headers(df, "id", "bands", needles, 4, 0, 0, 1).collect()
    least = {(r.id, r.sector): r.edits for r in sorted(found, key=lambda r: -r.edits)}
    assert least[1, 2] == 0 and least[2, 2] == 1 and not any(i in (3, 4) for i, _ in least)
    with pytest.raises(ValueError):
        search.corrupted_headers(df, "id", "bands", {1: "01", 2: "11"}, 2, 0, 0, 0)


def test_stitched_bands(spark):
    df = long_form(spark, [10, 20, 10, 20, 30])
    where = spark.createDataFrame([(1, 2, [5.0, 10.0, 20.0])], "k int, start long, c array<double>")
    got = timeline.stitched_bands(df, where, ["k"], "pos", "v", "start", "c", (10, 20, 30)).orderBy("pos").collect()
    assert [r.band for r in got] == [0, 1, 1, 2, 2]


def test_least_radius():
    values = np.array([10.0, 10, 20, 20, 30, 30, 900])
    want = np.array([0, 0, 1, 1, 2, 2, 2])
    r, bands, errors = loops.least_radius(values, 3, (1.0, 2.0), lambda b: int((b != want).sum()))
    assert errors == 0 and r > 0 and (bands == want).all()
