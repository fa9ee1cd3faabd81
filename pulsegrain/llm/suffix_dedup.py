"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

The 100-byte windows that start in a document are suffixes of which only the first 100 bytes matter. They are dealt into
suffix buckets by the least hash of the 32-byte strings in the window, which depends on the window's bytes alone, so equal
windows share a bucket; neighbouring windows share it too, so that a bucket gets them as one stretch of text. Stretches
whose bucket or whose bytes settle the matter need no sorting. For the others one block of buckets after the other is
sorted: by the first 32 bytes, and ties by the ranks of a difference-cover sample of the block, computed beforehand.
Memory is that of a block of buckets, never that of the text: long texts are cut into overlapping chunks and long stretches
into shorter ones, and a bucket of many bytes, such as that of a common line, is dealt anew with each whole window as a bucket
of its own. Stretches that are removed unsorted, as copies of another, are told by three hashes of two kinds (190 bits).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import arrow, batch_of, broadcast_if_small, by_key, checkpointed, joined, long_rows, pieces, runs, utf8, written

LENGTH, ANCHOR, PERIOD = 100, 32, 32
#: Buckets whose open stretches have more bytes than this are dealt anew by whole windows, so that no block outgrows a task.
CROWD = 2 << 20
#: Bytes of a text that are cut into stretches at once, windows of a stretch at most, and bytes of a block of buckets.
CHUNK, MOST, BLOCK_BYTES = 1 << 19, 1 << 14, 1 << 20


def difference_cover(v: int) -> np.ndarray:
    """A small set in which every difference modulo v occurs: greedily grown from 0 and 1."""
    cover, have = [0, 1], {0, 1, v - 1}
    while len(have) < v:
        best = max(range(v), key=lambda x: len(({(x - c) % v for c in cover} | {(c - x) % v for c in cover}) - have) if x not in cover else -1)
        have |= {(best - c) % v for c in cover} | {(c - best) % v for c in cover}
        cover.append(best)
    return np.array(sorted(cover))


COVER = difference_cover(PERIOD)
_IN = np.isin(np.arange(PERIOD), COVER)
#: For two remainders, how far to go until both positions are in the sample.
SHIFT = np.array([[next(d for d in range(PERIOD) if _IN[(i + d) % PERIOD] and _IN[(j + d) % PERIOD]) for j in range(PERIOD)] for i in range(PERIOD)])


def stretches(buf: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each row's windows the runs in one bucket, of MOST windows at most: row, first window, number of windows, bucket, two
    hashes of the bytes they span, and whether the least hash stands there twice, without which no two of the windows can be
    equal."""
    n = np.maximum(0, sizes - LENGTH + 1)
    if not n.sum():
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64), z.astype(np.uint64), z > 0
    need = LENGTH - ANCHOR + 1
    hashes = H.rolling(buf, ANCHOR)
    low = _slide(np.minimum, hashes, need)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    least = low[at[row] + place]
    cut = runs(least, row)
    inside = np.arange(len(row)) - np.repeat(cut[:-1], np.diff(cut))
    cut = np.append(np.flatnonzero(inside % MOST == 0), len(row))
    first, count = cut[:-1], np.diff(cut)
    goes_on = inside[first] > 0
    a = at[row[first]] + place[first]
    b = a + count + LENGTH - 1
    # a place holds the least hash of some window if the largest of its windows' least hashes is its own
    padded = np.concatenate([np.full(need - 1, low[0]), low, np.full(need - 1, low[-1])])
    anchors = np.flatnonzero(_slide(np.maximum, padded, need)[: len(hashes)] == hashes)
    left = anchors[:-1][(hashes[anchors[1:]] == hashes[anchors[:-1]]) & (anchors[1:] - anchors[:-1] <= need)]
    full = np.flatnonzero(n)
    doc = np.searchsorted(at[full], left, side="right") - 1
    window = np.minimum(left[doc >= 0], (at + n - 1)[full[doc[doc >= 0]]])
    window = window[low[window] == hashes[left[doc >= 0]]]
    twice = np.zeros(len(first), bool)
    twice[np.searchsorted(a, window, side="right") - 1] = True
    # the first of two equal windows begins up to `need` before its anchor, which may be in the part before
    twice[:-1] |= twice[1:] & goes_on[1:]
    return row[first], place[first], count, least[first], H.word_hashes(buf, a, b), H.check_hashes(buf, a, b), twice


def _slide(of: np.ufunc, values: np.ndarray, need: int) -> np.ndarray:
    """Least or largest of each `need` successive values, by doubling."""
    width = 1
    while width * 2 <= need:
        values = of(values[:-width], values[width:])
        width *= 2
    return of(values[: len(values) - (need - width)], values[need - width :]) if need > width else values


STRETCH = "bucket long, salt int, content long, check long, doc long, sub long, first int, n int, twice boolean"
_STRETCH = pa.schema([("bucket", pa.int64()), ("salt", pa.int32()), ("content", pa.int64()), ("check", pa.int64()), ("doc", pa.int64()), ("sub", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("twice", pa.bool_())])
ORDER = ("bucket", "salt", "content", "check", "doc", "sub", "first")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each stretch; those whose bytes stand earlier in the same batch are settled (salt > 0), which keeps copies from piling up."""
    for batch in batches:
        doc, sub = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data, ends = utf8(batch.column(2))
        parts = []
        for rows, shift, bounds in long_rows(ends, CHUNK, LENGTH - 1):
            buf, at = joined(data, bounds, 0, len(rows), 10)
            row, first, n, bucket, content, check, twice = stretches(buf, at, np.diff(bounds))
            parts.append((bucket.view(np.int64), content.view(np.int64), check.view(np.int64), doc[rows[row]], sub[rows[row]], first + shift[row], n, twice))
        if not parts:
            continue
        bucket, content, check, d, s, first, n, twice = (np.concatenate(c) for c in zip(*parts, strict=True))
        del parts
        order = np.lexsort((first, s, d, check, content, bucket))
        bucket, content, check, d, s, first, n, twice = (c[order] for c in (bucket, content, check, d, s, first, n, twice))
        repeat = np.zeros(len(d), bool)
        repeat[1:] = (bucket[1:] == bucket[:-1]) & (content[1:] == content[:-1]) & (check[1:] == check[:-1])
        same = np.zeros(len(d), bool)
        same[1:] = repeat[1:] & (d[1:] == d[:-1]) & (s[1:] == s[:-1]) & (first[1:] == first[:-1])
        salt = np.where(repeat, 1 + (d + first) % 251, 0)
        for z in range(0, len(d), 1 << 16):
            here = np.flatnonzero(~same[z : z + (1 << 16)]) + z
            yield batch_of(_STRETCH, [bucket[here], salt[here].astype(np.int32), content[here], check[here], d[here], s[here], first[here].astype(np.int32), n[here].astype(np.int32), twice[here]])


SETTLED = "doc long, sub long, first int, n int, bucket long, open boolean"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by bucket, bytes and place: those whose bytes came before are removable whole; the first of each
    bytes stays open if its bucket has others, or if it may repeat within itself. Holds one row from batch to batch, however large a bucket is."""
    schema = pa.schema([("doc", pa.int64()), ("sub", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("bucket", pa.int64()), ("open", pa.bool_())])
    last = held = None  # last: the row before; held: the first stretch of a bucket of one content so far
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        c = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}
        settled = c["salt"] > 0

        def before(name: str, missing: int = 0, c: dict = c, last: tuple | None = last) -> np.ndarray:
            return np.concatenate([[last[name] if last else missing], c[name][:-1]])

        head = np.arange(n) == 0 if last is None else np.zeros(n, bool)
        new_bucket = head | (before("bucket") != c["bucket"]) | settled | (before("salt") > 0)
        new_content = new_bucket | (before("content") != c["content"]) | (before("check") != c["check"])
        same_place = ~new_content & (before("doc") == c["doc"]) & (before("sub") == c["sub"]) & (before("first") == c["first"])
        whole = settled | (~new_content & ~same_place)
        firsts = np.flatnonzero(new_content & ~settled)
        opened = np.zeros(n, bool)
        later = ~new_bucket[firsts]  # another content in a bucket that has begun
        opened[firsts[later]] = True
        opened[firsts[c["twice"][firsts]]] = True
        opened[firsts[:-1][later[1:]]] = True
        if held is not None and len(firsts) and later[0]:
            yield batch_of(schema, [[held["doc"]], [held["sub"]], [held["first"]], [held["n"]], [held["bucket"]], [True]])
        if len(firsts):
            z = firsts[-1]
            held = None if opened[z] else {k: c[k][z] for k in c}
        elif settled.any():
            held = None
        keep = whole | opened
        if keep.any():
            yield batch_of(schema, [c["doc"][keep], c["sub"][keep], c["first"][keep], c["n"][keep], c["bucket"][keep], opened[keep]])
        last = {k: c[k][-1] for k in c}


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc", pa.int64()), ("sub", pa.int64()), ("z", pa.binary()), ("doc_id", pa.int64())])
    for batch in batches:
        pack = zstandard.ZstdCompressor(level=1).compress
        data, ends = utf8(batch.column(2))
        view = memoryview(data)
        for a, b in pieces(ends, 8 << 20):
            yield batch_of(schema, [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), [pack(view[ends[i] : ends[i + 1]]) for i in range(a, b)], batch.column(3).slice(a, b - a)])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("bucket", pa.int64()), ("doc", pa.int64()), ("sub", pa.int64()), ("first", pa.int32()), ("bytes", pa.binary())])
    for batch in batches:
        unpack = zstandard.ZstdDecompressor().decompress
        rows, held = [], 0
        for doc, sub, z, parts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            text = unpack(z)
            for p in parts:
                rows.append((p["bucket"], doc, sub, p["first"], text[p["first"] : p["first"] + p["n"] + LENGTH - 1]))
                held += p["n"] + LENGTH
            if held > 1 << 20:
                yield batch_of(schema, list(map(list, zip(*rows, strict=True))))
                rows, held = [], 0
        if rows:
            yield batch_of(schema, list(map(list, zip(*rows, strict=True))))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A stretch of one window for each different window of the asked ones in a text: the window is its own bucket. Windows
    that come again in the text are settled, those that follow each other as one stretch."""
    for batch in batches:
        unpack = zstandard.ZstdDecompressor().decompress
        for doc, sub, z, parts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            text = np.frombuffer(unpack(z), np.uint8)
            parts.sort(key=lambda p: p["first"])
            at = np.concatenate([np.arange(p["first"], p["first"] + p["n"]) for p in parts])
            hashes, check = H.word_hashes(text, at, at + LENGTH), H.check_hashes(text, at, at + LENGTH)
            order = np.lexsort((at, check, hashes))
            again = np.zeros(len(at), bool)
            again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (check[order[1:]] == check[order[:-1]])
            cut = np.flatnonzero(np.concatenate([[True], ~again[1:] | ~again[:-1] | (at[1:] != at[:-1] + 1)]))
            n = np.diff(np.append(cut, len(at)))
            for x in range(0, len(cut), 1 << 16):
                here = cut[x : x + (1 << 16)]
                k, h = len(here), hashes[here].view(np.int64)
                salt = np.where(again[here], 1 + at[here] % 251, 0).astype(np.int32)
                yield batch_of(_STRETCH, [h, salt, h, check[here].view(np.int64), np.full(k, doc), np.full(k, sub), at[here].astype(np.int32), n[x : x + (1 << 16)].astype(np.int32), np.zeros(k, bool)])


class Sorter:
    """Order of the windows of one block of text."""

    def __init__(self, text: bytes) -> None:
        padded = np.frombuffer(text + bytes(2 * LENGTH + 64), np.uint8)
        self.words = np.ndarray((len(text) + 2 * LENGTH + 40,), ">u8", padded, 0, (1,)).astype(np.uint64)
        self.n = len(text)

    def word(self, pos: np.ndarray, depth: int, length: int) -> np.ndarray:
        w = self.words[pos + depth]
        return w if length - depth >= 8 else w >> H.U(8 * (8 - (length - depth)))

    def refine(self, pos: np.ndarray, new: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions put in order by their next `length` bytes within groups (`new` marks where each begins), eight bytes at a time; only ties go on."""
        for depth in range(0, length, 8):
            end = np.append(new[1:], True)
            tied = np.flatnonzero(~(new & end))
            if not len(tied):
                break
            group = np.cumsum(new)[tied]
            key = self.word(pos[tied], depth, length)
            order = np.lexsort((key, group))
            pos[tied], key = pos[tied][order], key[order]
            new[tied[1:][(key[1:] != key[:-1]) & (group[1:] == group[:-1])]] = True
        return pos, new

    def ranks(self, sample: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Rank of each sampled position by its next LENGTH bytes; `group` is ascending, and ranks are compared within groups only."""
        new = np.ones(len(sample), bool)
        new[1:] = group[1:] != group[:-1]
        pos, new = self.refine(sample.copy(), new, LENGTH)
        rank = np.zeros(self.n + PERIOD + LENGTH, np.int32)
        rank[pos] = np.cumsum(new)
        return rank

    def order(self, windows: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
        new = np.ones(len(windows), bool)
        new[1:] = group[1:] != group[:-1]
        pos, new = self.refine(windows.copy(), new, PERIOD)
        done = np.zeros(len(pos), bool)
        while True:
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(pos)))
            live = (size > 1) & ~done[at]
            if not live.any():
                return pos
            own = np.repeat(np.arange(len(at)), size)
            tied = np.flatnonzero(live[own])
            group = own[tied]
            pivot = pos[at + size // 2][group]
            here = pos[tied]
            d = SHIFT[here % PERIOD, pivot % PERIOD]
            side = np.sign(rank[here + d] - rank[pivot + d])
            order = np.argsort(group * 3 + side, kind="stable")
            pos[tied], side = here[order], side[order]
            new[tied[1:][(side[1:] != side[:-1]) & (group[1:] == group[:-1])]] = True
            done[tied] = side == 0

    def equal_to_previous(self, pos: np.ndarray) -> np.ndarray:
        same = np.zeros(len(pos), bool)
        left = np.arange(1, len(pos))
        for depth in range(0, LENGTH, 8):
            left = left[self.word(pos[left], depth, LENGTH) == self.word(pos[left - 1], depth, LENGTH)]
        same[left] = True
        return same


def repeated_windows(text: bytes, begin: np.ndarray, count: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Positions of windows that equal an earlier one of their group. Stretches begin at `begin`, hold `count` windows each,
    and stand in the text by group, and within a group in order of document and place."""
    each = lambda n: np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    sorter = Sorter(text)
    reach = count + PERIOD
    sample = each(reach)
    chosen = _IN[sample % PERIOD]
    rank = sorter.ranks(sample[chosen], np.repeat(group, reach)[chosen])
    owner = np.repeat(group, count)
    pos = sorter.order(each(count), owner, rank)
    spread = np.zeros(sorter.n, np.int64)
    spread[each(count)] = owner
    same = sorter.equal_to_previous(pos) & np.concatenate([[False], spread[pos[1:]] == spread[pos[:-1]]])
    cls = np.cumsum(~same) - 1
    earliest = np.minimum.reduceat(pos, np.flatnonzero(~same))
    return np.sort(pos[pos != earliest[cls]])


def _sorted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc", pa.int64()), ("sub", pa.int64()), ("first", pa.int32()), ("n", pa.int32())])
    for got in by_key(batches, ["bucket"], BLOCK_BYTES):
        texts = got["bytes"].to_pylist()
        length = np.array([len(x) for x in texts])
        begin = np.cumsum(length) - length
        bucket = got["bucket"].to_numpy()
        group = np.cumsum(np.concatenate([[0], bucket[1:] != bucket[:-1]]))
        hit = repeated_windows(b"".join(texts), begin, length - LENGTH + 1, group)
        if len(hit):
            cut = np.flatnonzero(np.concatenate([[True], hit[1:] != hit[:-1] + 1]))
            n = np.diff(np.append(cut, len(hit)))
            row = np.searchsorted(begin, hit[cut], side="right") - 1
            yield batch_of(schema, [got["doc"].to_numpy()[row], got["sub"].to_numpy()[row], (got["first"].to_numpy()[row] + hit[cut] - begin[row]).astype(np.int32), n.astype(np.int32)])


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    for batch in batches:
        unpack = zstandard.ZstdDecompressor().decompress
        rows = []
        for z, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            text = unpack(z)
            kept, at, removed, n = hashlib.sha256(), 0, 0, 0
            start = stop = -1
            for first, count in sorted((s["first"], s["n"]) for s in spans or ()):
                if first <= stop and stop >= 0:
                    stop = max(stop, first + count + LENGTH - 1)
                    continue
                if stop >= 0:
                    kept.update(text[at:start])
                    at, removed, n = stop, removed + stop - start, n + 1
                start, stop = first, first + count + LENGTH - 1
            if stop >= 0:
                kept.update(text[at:start])
                at, removed, n = stop, removed + stop - start, n + 1
            kept.update(text[at:])
            rows.append((len(text), removed, n, kept.hexdigest()))
        if rows:
            yield batch_of(schema, [batch.column(0), *map(list, zip(*rows, strict=True))])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of what is left of the
    UTF-8 text when each byte goes that a 100-byte string covers which also starts earlier: in a document of smaller id, or
    before in the same document. Strings are judged on the input and never cross documents.

    A null text is empty; texts under 100 bytes stay. A null id counts as the smallest. Rows that share an id come in order
    of their texts' hashes (64 bits); rows that repeat id and text are one document and get equal results. An empty table gives
    no rows; other columns are ignored. Equal stretches are told by a hash of their bucket and two hashes of their bytes.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(F.lit(7), body).alias("sub"), body.alias("text"), F.col(doc_id).cast("long").alias("doc_id"))
    settle = lambda df: arrow(df.repartition(parts, "bucket", "salt").sortWithinPartitions(*ORDER), _settle, SETTLED)
    settled = written(settle(arrow(rows.where(F.octet_length("text") >= LENGTH).select("doc", "sub", "text"), _stretches, STRETCH)))
    packed = arrow(rows, _packed, "doc long, sub long, z binary, doc_id long")
    open_ = settled.where("open")
    crowds = checkpointed(open_.groupBy("bucket").agg(F.sum(F.col("n").cast("long") + LENGTH - 1).alias("bytes")).where(F.col("bytes") > CROWD).select("bucket"))
    spread = None
    if crowds.head(1):
        crowds = broadcast_if_small(crowds, 16)
        many = open_.join(crowds, "bucket", "left_semi").groupBy("doc", "sub").agg(F.collect_list(F.struct("first", "n")).alias("parts"))
        open_ = open_.join(crowds, "bucket", "left_anti")
        spread = settle(arrow(packed.select("doc", "sub", "z").join(many, ["doc", "sub"]).select("doc", "sub", "z", "parts"), _windows, STRETCH)).select("doc", "sub", "first", "n")
    asked = open_.groupBy("doc", "sub").agg(F.collect_list(F.struct("bucket", "first", "n")).alias("parts"))
    whole = packed.select("doc", "sub", "z").join(asked, ["doc", "sub"]).select("doc", "sub", "z", "parts")
    blocks = arrow(whole, _contents, "bucket long, doc long, sub long, first int, bytes binary").dropDuplicates(["bucket", "doc", "sub", "first"])
    blocks = blocks.repartition(parts, "bucket").sortWithinPartitions("bucket", "doc", "sub", "first")
    sorted_ = arrow(blocks, _sorted_blocks, "doc long, sub long, first int, n int")
    spans = settled.where("NOT open").select("doc", "sub", "first", "n").unionByName(sorted_)
    spans = spans.unionByName(spread) if spread is not None else spans
    spans = spans.groupBy("doc", "sub").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    out = packed.join(spans, ["doc", "sub"], "left")
    return arrow(out.select("doc_id", "z", "spans"), _removed, OUT)
