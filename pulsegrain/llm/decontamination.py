"""Benchmark decontamination by the q-gram lemma.

A benchmark item of m bytes that occurs in a text with at most e edits shares at least m - q + 1 - q * e of its q-grams
with it, and those lie in a band of 2 e + 1 diagonals (place in the text minus place in the item). Shared q-grams are
counted in diagonal bands that overlap by more than that, so that each occurrence falls whole into one; bands that reach
the bound are verified by banded alignment. Short items have shorter q-grams, so that the bound stays above zero; those that
allow no edit are one q-gram.

A benchmark of up to BLOCK_BYTES is an index in each task, and texts are read once. A larger one is a table of q-grams that
the texts' q-grams are joined to; only counts, and the regions to be aligned, are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import arrow, batch_of, broadcast_if_small, checkpointed, joined, pieces, runs, utf8

RATE = 0.05
#: Bytes from which an item may have an edit, and from which its q-grams are long; bytes under which it must stand as words.
EDITED, LONG, WORDS = 20, 40, 12
Q, SHORT_Q = 12, 8
#: Bytes of benchmark text that are indexed in a task at once.
BLOCK_BYTES = 2 << 20
#: Bytes of one text that are searched at once.
CHUNK = 1 << 20
#: The table of q-grams of a larger benchmark that the texts' q-grams have to pass: 16 MB.
FILTER_BITS = 27

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_WORD = H.classes("alnum")


def edits(m: int, rate: float = RATE) -> int:
    return int(m * rate)


def gram_length(m: int) -> int:
    return m if m < EDITED else SHORT_Q if m < LONG else Q


class Bits:
    """A set of hashes as a packed bit table: none of the set fails, few others pass."""

    def __init__(self, bits: int) -> None:
        self.shift = H.U(64 - bits)
        self.table = np.zeros(1 << bits >> 3, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        slot = hashes >> self.shift
        np.bitwise_or.at(self.table, slot >> H.U(3), np.uint8(1) << (slot & H.U(7)).astype(np.uint8))

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> self.shift
        return (self.table[slot >> H.U(3)] >> (slot & H.U(7)).astype(np.uint8)) & 1 != 0


class Grams:
    """Items whose q-grams are equally long: sorted hashes with postings, behind a bit table."""

    def __init__(self, items: list[tuple[int, np.ndarray]], q: int) -> None:
        self.q, self.ids, self.texts = q, [i for i, _ in items], [t for _, t in items]
        grams = [H.rolling(t, q) for t in self.texts]
        flat = np.concatenate(grams)
        order = np.argsort(flat, kind="stable")
        self.hashes = flat[order]
        self.item = np.repeat(np.arange(len(items), dtype=np.int32), [len(g) for g in grams])[order]
        self.place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams])[order]
        self.filter = Bits(max(16, int(np.ceil(np.log2(len(flat) * 32)))))
        self.filter.add(flat)
        self.size = np.array([len(t) for t in self.texts])
        self.edits = np.array([edits(n) for n in self.size], np.int64)
        self.bound = self.size - q + 1 - q * self.edits
        self.longest = int(self.size.max())

    def candidates(self, buf: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
        """Row, item and band (of diagonals, shifted by the longest item) where enough q-grams are shared."""
        grams = H.rolling(buf, self.q)
        hit = np.flatnonzero(self.filter.passes(grams))
        first = np.searchsorted(self.hashes, grams[hit])
        count = np.searchsorted(self.hashes, grams[hit], side="right") - first
        row = np.searchsorted(at, hit, side="right") - 1
        real = (count > 0) & (row >= 0) & (hit + self.q <= (at + sizes)[row])
        hit, first, count, row = hit[real], first[real], count[real], row[real]
        if not len(hit):
            return []
        n_items, n_bands = len(self.ids), int(sizes.max()) + self.longest + 3
        keys, times, held = [], [], 0
        steps = np.cumsum(count)
        z = 0
        while z < len(hit):
            y = max(z + 1, int(np.searchsorted(steps, (steps[z - 1] if z else 0) + (1 << 18), side="right")))
            n = count[z:y]
            post = np.repeat(first[z:y], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item = self.item[post].astype(np.int64)
            diagonal = np.repeat(hit[z:y] - at[row[z:y]], n) - self.place[post] + self.longest
            band = diagonal // (2 * self.edits[item] + 1)
            name = (np.repeat(row[z:y], n) * n_items + item) * n_bands + band + 1
            # each hit goes to its band of twice that width and to the one before, which it shares
            found, c = np.unique(np.concatenate([name, name - 1]) if self.edits.any() else name, return_counts=True)
            keys.append(found)
            times.append(c)
            held += len(found)
            if held > 1 << 21 or y >= len(hit):
                every, c = np.concatenate(keys), np.concatenate(times)
                order = np.argsort(every, kind="stable")
                cut = runs(every[order])[:-1]
                keys, times, held = [every[order][cut]], [np.add.reduceat(c[order], cut)], len(cut)
            z = y
        name, c = keys[0], times[0]
        item = name // n_bands % n_items
        name = name[c >= self.bound[item]]
        return [(int(x) // n_bands // n_items, int(x) // n_bands % n_items, int(x) % n_bands - 1) for x in name.tolist()]


def alignment(item: np.ndarray, text: np.ndarray, e: int, free: int) -> tuple[int, int, int] | None:
    """Fewest edits that turn `item` into a part of `text`, with that part's start and end; None beyond e edits. The part
    may start at any of the first `free` places. Diagonals outside of the band from -e to free + e are left out."""
    m, n = len(item), len(text)
    width = free + 2 * e + 1
    big = m + n + 1
    shift = np.arange(width) - e
    row = np.where((shift >= 0) & (shift <= n), 0, big)
    start = np.clip(shift, 0, n)
    for i in range(1, m + 1):
        j = shift + i
        inside = (j >= 1) & (j <= n)
        cost = np.where(inside, (text[np.clip(j - 1, 0, n - 1)] != item[i - 1]).astype(np.int64), big) if n else np.full(width, big)
        best, origin = row + cost, start.copy()
        up = np.append(row[1:], big) + 1  # a byte of the item left out
        better = (up < best) & (j >= 0) & (j <= n)
        best[better], origin[better] = up[better], np.append(start[1:], 0)[better]
        # bytes of the text put in: a running minimum along the row
        slope = best - np.arange(width)
        low = np.minimum.accumulate(slope)
        where = np.maximum.accumulate(np.where(slope == low, np.arange(width), -1))
        row, start = np.where(j <= n, low + np.arange(width), big), origin[where]
    end = shift + m
    row = np.where((end >= 0) & (end <= n), row, big)
    z = int(np.argmin(row))
    return (int(row[z]), int(start[z]), int(end[z])) if row[z] <= e else None


def region(m: int, low: int, size: int) -> tuple[int, int]:
    """Where to look in a text of `size` bytes for an item of m bytes, given the least diagonal of its band."""
    e = edits(m)
    return max(0, low - e), min(size, low + 4 * e + 2 + e + m) if e else min(size, low + m)


def verified(item: np.ndarray, part: np.ndarray, before: int, after: int) -> tuple[int, int, int] | None:
    """Edits, start and end of `item` in its region, given the bytes around the region (-1 for none)."""
    m, e = len(item), edits(len(item))
    if not e:
        if part.tobytes() != item.tobytes():
            return None
        goes_on = (before >= 0 and _WORD[before] and _WORD[item[0]]) or (after >= 0 and _WORD[after] and _WORD[item[-1]])
        return None if m < WORDS and goes_on else (0, 0, m)
    exact = part.tobytes().find(item.tobytes())
    return (0, exact, exact + m) if exact >= 0 else alignment(item, part, e, max(0, min(len(part), 5 * e + 2)))


def merged(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Row, item's id, start, end and edits, where of occurrences of an item that begin within half of its length the best stays."""
    out: list[tuple[int, int, int, int, int]] = []
    for x in sorted(set(found)):
        last = out[-1] if out else None
        if last and last[:2] == x[:2] and x[2] - last[2] <= (last[3] - last[2]) // 2:
            if x[4] < last[4]:
                out[-1] = x
        else:
            out.append(x)
    return out


class Searcher:
    """All items of a block."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        folded = [(i, _FOLD[np.frombuffer(t, np.uint8)]) for i, t in items]
        by_length: dict[int, list] = {}
        for i, t in folded:
            by_length.setdefault(gram_length(len(t)), []).append((i, t))
        self.grams = [Grams(some, q) for q, some in sorted(by_length.items())]
        self.overlap = max((len(t) + 2 * edits(len(t)) for _, t in folded), default=0) + 2

    def find(self, buf: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Row, item's id, start, end and edits of what is verified, in folded text."""
        out = []
        for g in self.grams:
            for r, item, band in g.candidates(buf, at, sizes):
                a, z = region(int(g.size[item]), band * (2 * int(g.edits[item]) + 1) - g.longest, int(sizes[r]))
                if a < 0 or z <= a:
                    continue
                text = buf[at[r] : at[r] + sizes[r]]
                got = verified(g.texts[item], text[a:z], int(text[a - 1]) if a else -1, int(text[z]) if z < len(text) else -1)
                if got is not None:
                    out.append((r, g.ids[item], a + got[1], a + got[2], got[0]))
        return out

    def search(self, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, list[tuple[int, int, int, int, int]]]]:
        """Row ranges a to b with the bytes of the first of them on, and what is found, rows from 0. A long text is searched
        in chunks that overlap by more than any occurrence."""
        step = max(CHUNK, 2 * self.overlap)
        for a, b in pieces(ends, CHUNK):
            size = int(ends[b] - ends[a])
            if b - a > 1 or size <= step + self.overlap:
                buf, at = joined(data, ends, a, b, 0)
                yield a, b, data[ends[a] : ends[b]], merged(self.find(_FOLD[buf], at, np.diff(ends[a : b + 1])))
                continue
            found = []
            for z in range(0, size, step):
                part = _FOLD[data[ends[a] + z : ends[a] + min(size, z + step + self.overlap)]]
                # what begins at a cut or ends at one is found whole in the chunk before or after
                for _, i, s, t, e in self.find(part, np.zeros(1, np.int64), np.array([len(part)])):
                    if (s or not z) and (t < len(part) or z + len(part) == size):
                        found.append((0, i, z + s, z + t, e))
            yield a, b, data[ends[a] : ends[b]], merged(found)


_cached: dict[str, Searcher] = {}


def _searcher(name: str, items: list[tuple[int, bytes]]) -> Searcher:
    """Made once in each worker; it keeps the last one."""
    if name not in _cached:
        _cached.clear()
        _cached[name] = Searcher(items)
    return _cached[name]


FOUND = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.string())), ("items", pa.list_(pa.int64()))])


def _search(items: list[tuple[int, bytes]], whole: bool):
    """Per row the regions as item:start:end:edits in code points; `whole` keeps the texts of rows without any instead."""
    name = hashlib.blake2b(repr(items).encode(), digest_size=16).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = _searcher(name, items)
        for batch in batches:
            data, ends = utf8(batch.column(batch.schema.get_field_index("text")) if whole else batch.column(1))
            clean = np.ones(len(ends) - 1, bool)
            for a, b, raw, found in searcher.search(data, ends):
                clean[[a + r for r, *_ in found]] = False
                if not whole:
                    rows: list[list] = [[] for _ in range(b - a)]
                    for r, item, s, t, e in found:
                        rows[r].append((item, s, t, e))
                    spans, ids = [], []
                    for r, got in enumerate(rows):
                        point = _points(raw[ends[a + r] - ends[a] : ends[a + r + 1] - ends[a]]) if got else []
                        spans.append([f"{i}:{point[s]}:{point[t]}:{e}" for i, s, t, e in got])
                        ids.append(sorted({i for i, *_ in got}))
                    yield batch_of(FOUND, [batch.column(0).slice(a, b - a), spans, ids])
            if whole:
                yield batch.filter(pa.array(clean))

    return run


def _points(raw: np.ndarray) -> np.ndarray:
    """Code points before each byte of UTF-8, and in all."""
    return np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """i, t: distinct searchable items."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.encode(F.col(text), "utf-8").alias("t"))
    return rows.where("i IS NOT NULL").where(F.col("t").cast("string").rlike(r"[^\x20\x09-\x0D]")).distinct()


# --- a benchmark of any size --------------------------------------------------------------------------------------------------


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("gram", pa.int64()), ("key", pa.int64()), ("m", pa.int64()), ("place", pa.int64())])
    for batch in batches:
        for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            g = H.rolling(_FOLD[np.frombuffer(t, np.uint8)], gram_length(len(t))).view(np.int64)
            for z in range(0, len(g), 1 << 16):
                part = g[z : z + (1 << 16)]
                n = len(part)
                yield batch_of(schema, [part, np.full(n, key), np.full(n, len(t)), np.arange(z, z + n)])


def _hits(bits: Bits, lengths: list[int]):
    schema = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("gram", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = utf8(batch.column(2))
            h, g = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in pieces(ends, CHUNK):
                buf, at = joined(data, ends, a, b, 0)
                buf, sizes = _FOLD[buf], np.diff(ends[a : b + 1])
                for q in lengths:
                    for z in range(0, len(buf), CHUNK):
                        grams = H.rolling(buf[z : z + CHUNK + q - 1], q)
                        hit = np.flatnonzero(bits.passes(grams))
                        row = np.searchsorted(at, hit + z, side="right") - 1
                        inner = (row >= 0) & (hit + z + q <= (at + sizes)[row])
                        hit, row = hit[inner], row[inner]
                        if len(hit):
                            yield batch_of(schema, [h[a + row], g[a + row], grams[hit].view(np.int64), hit + z - at[row]])

    return run


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each text that are to be aligned, with the bytes around them and where they stand."""
    schema = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("key", pa.int64()), ("at", pa.int64()), ("point", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("part", pa.binary())])
    for batch in batches:
        rows, held = [], 0
        for h, g, text, found in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            raw = np.frombuffer(text.encode(), np.uint8)
            point = _points(raw)
            for x in found:
                a, z = region(x["m"], x["band"] * (2 * edits(x["m"]) + 1), len(raw))
                if 0 <= a < z:
                    rows.append((h, g, x["key"], a, int(point[a]), int(raw[a - 1]) if a else -1, int(raw[z]) if z < len(raw) else -1, raw[a:z].tobytes()))
                    held += z - a
                if held > CHUNK:
                    yield batch_of(schema, list(map(list, zip(*rows, strict=True))))
                    rows, held = [], 0
        if rows:
            yield batch_of(schema, list(map(list, zip(*rows, strict=True))))


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("item", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())])
    fold = lambda c: int(_FOLD[c]) if c >= 0 else c
    for batch in batches:
        rows = []
        for h, g, point, before, after, part, i, t in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
            raw = np.frombuffer(part, np.uint8)
            got = verified(_FOLD[np.frombuffer(t, np.uint8)], _FOLD[raw], fold(before), fold(after))
            if got is not None:
                p = _points(raw)
                rows.append((h, g, i, point + int(p[got[1]]), point + int(p[got[2]]), got[0]))
        if rows:
            yield batch_of(schema, list(map(list, zip(*rows, strict=True))))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("spans", pa.list_(pa.string())), ("items", pa.list_(pa.int64()))])
    for batch in batches:
        spans, items = [], []
        for found in batch.column(2).to_pylist():
            got = merged([(0, x["item"], x["start"], x["end"], x["edits"]) for x in found])
            spans.append([f"{i}:{s}:{t}:{e}" for _, i, s, t, e in got])
            items.append(sorted({i for _, i, *_ in got}))
        yield batch_of(schema, [batch.column(0), batch.column(1), spans, items])


def _by_join(texts: DataFrame, items: DataFrame) -> DataFrame:
    """h, g, spans, items of the texts (h, g: two hashes of the text; text) that hold an item of a benchmark of any size.

    The benchmark passes the driver a block at a time, for the bit table; all else is joined. Texts go over the network only
    if they have a region to be aligned."""
    items = checkpointed(items.withColumn("key", F.xxhash64("i", "t")))
    bits, lengths = Bits(FILTER_BITS), set()
    for r in items.select("t").distinct().toLocalIterator():
        t = _FOLD[np.frombuffer(bytes(r.t), np.uint8)]
        bits.add(H.rolling(t, gram_length(len(t))))
        lengths.add(gram_length(len(t)))
    postings = arrow(items.select("key", "t"), _postings, "gram long, key long, m long, place long")
    hits = arrow(texts.select("h", "g", "text"), _hits(bits, sorted(lengths)), "h long, g long, gram long, place long").distinct()
    e = F.floor(F.col("m") * RATE + 1e-9)
    q = F.when(F.col("m") < EDITED, F.col("m")).when(F.col("m") < LONG, SHORT_Q).otherwise(Q)
    shared = hits.join(postings.withColumnRenamed("place", "at"), "gram").withColumn("band", F.floor((F.col("place") - F.col("at")) / (2 * e + 1)))
    shared = shared.withColumn("band", F.explode(F.when(e > 0, F.array(F.col("band"), F.col("band") - 1)).otherwise(F.array("band"))))
    wanted = shared.groupBy("h", "g", "key", "m", "band").agg(F.count("*").alias("n")).where(F.col("n") >= F.col("m") - q + 1 - q * e)
    wanted = checkpointed(wanted.groupBy("h", "g").agg(F.collect_list(F.struct("key", "m", "band")).alias("found")))
    some = texts.select("h", "g", "text").join(broadcast_if_small(wanted.select("h", "g"), 24), ["h", "g"], "left_semi").dropDuplicates(["h", "g"]).join(wanted, ["h", "g"])
    parts = arrow(some.select("h", "g", "text", "found"), _regions, "h long, g long, key long, at long, point long, before int, after int, part binary")
    both = parts.join(items, "key").select("h", "g", "point", "before", "after", "part", "i", "t")
    found = arrow(both, _align, "h long, g long, item long, start long, end long, edits long")
    found = found.groupBy("h", "g").agg(F.collect_list(F.struct("item", "start", "end", "edits")).alias("found"))
    return checkpointed(arrow(found, _spans, "h long, g long, spans array<string>, items array<long>"))


def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h"), F.xxhash64(F.lit(7), text).alias("g")]


def _small(items: DataFrame) -> list[tuple[int, bytes]] | None:
    """All items, or None if they are more than BLOCK_BYTES."""
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()
    return [(r.i, bytes(r.t)) for r in items.orderBy("i", "t").collect()] if size <= BLOCK_BYTES else None


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, contaminated, n_items, item_ids (comma-joined, ascending), spans (item:start:end:edits in
    code points, comma-joined).

    An item occurs where at most 5 % of its bytes are edited, after A-Z are lower-cased and tabs and line ends are blanks:
    from 20 bytes on an edit is allowed, and under 12 bytes an item must not be a part of a longer word. Null and blank items
    and those without an id are not searched. Null texts are empty. Repeated rows get equal results; an empty table gives no
    rows, an empty benchmark clean ones; other columns are ignored. Texts are told apart by 128 bits where a large benchmark
    is joined.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    items = _items(benchmark, item_id, item_text)
    small = _small(items)
    if small is not None:
        found = arrow(rows, _search(small, False), "doc_id long, spans array<string>, items array<long>")
    else:
        keyed = rows.select("doc_id", "text", *_hashes(F.col("text")))
        every = _by_join(keyed.where("text IS NOT NULL"), items)
        empty = lambda kind: F.array().cast(f"array<{kind}>")
        found = keyed.join(broadcast_if_small(every, 256), ["h", "g"], "left").select("doc_id", F.coalesce("spans", empty("string")).alias("spans"), F.coalesce("items", empty("long")).alias("items"))
    ids = F.array_sort("items")
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("item_ids"), F.array_join(F.array_sort("spans"), ",").alias("spans"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` (a column `text` at least) in which no benchmark item occurs, with all their columns; cases as in find_contamination."""
    items = _items(benchmark, "item_id", "text")
    small = _small(items)
    if small is not None:
        return arrow(docs, _search(small, True), docs.schema)
    found = _by_join(docs.where("text IS NOT NULL").select("text", *_hashes(F.col("text"))), items).select(F.col("h").alias("h_"), F.col("g").alias("g_"))
    h, g = (c for c in (F.xxhash64("text"), F.xxhash64(F.lit(7), "text")))
    return docs.join(broadcast_if_small(found, 24), (h == F.col("h_")) & (g == F.col("g_")) & F.col("text").isNotNull(), "left_anti")
