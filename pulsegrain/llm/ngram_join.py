"""N-gram Jaccard join with Bayesian candidate pruning.

Texts with equal shingle sets form a class, so copies are compared once. Classes meet in bands of their MinHash values;
in each band bucket pairs are compared a few MinHash values at a time and dropped when the posterior probability of
reaching the threshold falls below a tolerance. What survives is verified exactly on the shingle sets: groups of survivors
that fit a block as one block; of larger groups the dense cores, where nearly all pairs survive, block against block, and
other pairs by themselves. Within a core no pair is emitted: tasks return sums for each class and spanning forests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import arrow, batch_of, binaries, broadcast_if_small, by_key, checkpointed, flat, joined, pieces, runs, utf8
from .components import connected_components

SHINGLE, THRESHOLD = 5, 0.8
#: 25 bands of 4 values: a pair at the threshold shares no band with probability 2e-6.
BANDS, ROWS = 25, 4
HASHES = BANDS * ROWS
STEP, TOLERANCE = 10, 1e-6
#: Classes, and bytes of shingles, that a block of a group holds on average, and pairs for each class up to which a block counts as sparse.
BLOCK, BLOCK_BYTES, FEW = 256, 4 << 20, 4
#: Band buckets of more classes than this are cut into blocks before any task holds them.
CROWD = 4096

_rng = np.random.default_rng(5)
A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | H.U(1)
B = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64)


def fewest_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """After n compared values, the fewest matches with which P(similarity >= threshold | matches), from a uniform prior, is at least the tolerance."""
    found = []
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        found.append((n, m))
    return found


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Row ranges with their sorted distinct shingle hashes. A text of fewer than k words is one shingle; one without words has none."""
    data, ends = utf8(column)
    table = H.classes("space")
    for a, b in pieces(ends):
        buf, at = joined(data, ends, a, b)
        starts, stops = H.words(buf, table)
        h = H.word_hashes(buf, starts, stops)
        cut = np.append(np.searchsorted(starts, at), len(starts))
        grams = H.ngrams(h, k)
        sets = []
        for i in range(b - a):
            x, y = cut[i], cut[i + 1]
            if y - x >= k:
                sets.append(np.unique(grams[x : y - k + 1]))
            else:
                sets.append(H.ngrams(h[x:y], y - x) if y > x else np.zeros(0, np.uint64))
        yield a, sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of non-empty sets, a row each."""
    out = np.empty((len(sets), HASHES), np.uint32)
    if sets:
        every = np.concatenate(sets)
        at = np.cumsum([0] + [len(s) for s in sets[:-1]])
        for j in range(HASHES):
            out[:, j] = np.minimum.reduceat((every * A[j] + B[j]) >> H.U(32), at)
    return out


def class_key(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _features(k: int):
    """doc_id, hash of the text, class, number of shingles and signature of each row of doc_id, hash, text."""
    schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("class", pa.int64()), ("size", pa.int32()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, sets in shingle_sets(batch.column(2), k):
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = binaries(signatures([sets[i] for i in full])).to_pylist()
                sigs: list = [None] * len(sets)
                keys: list = [None] * len(sets)
                for i, v in zip(full, sig, strict=True):
                    sigs[i], keys[i] = v, class_key(sets[i])
                yield batch_of(schema, [batch.column(0).slice(a, len(sets)), batch.column(1).slice(a, len(sets)), keys, [len(x) for x in sets], sigs])

    return run, "doc_id long, hash long, class long, size int, sig binary"


def _matrix(column: pa.Array) -> np.ndarray:
    data, ends = flat(column)
    return data[ends[0] : ends[-1]].view(np.uint32).reshape(-1, HASHES)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("band", pa.int64()), ("class", pa.int64())])
    for batch in batches:
        if batch.num_rows:
            sig = _matrix(batch.column(1)).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), sig.shape[:2]).copy()
            for r in range(ROWS):
                key = H.mix(key * H.STEP + sig[:, :, r])
            yield batch_of(schema, [key.view(np.int64).ravel(), np.repeat(batch.column(0).to_numpy(), BANDS)])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of two classes or more, named by their members, so that bands with the same members become one; large ones as pairs of blocks."""
    schema = pa.schema([("bucket", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("own", pa.int32()), ("class", pa.int64())])
    for got in by_key(batches, ["band"]):
        band, node = got["band"].to_numpy(), got["class"].to_numpy()
        at = runs(band)
        size = np.diff(at)
        if not (size > 1).any():
            continue
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for x, n in zip(at[:-1][size > 1], size[size > 1], strict=True):
            members = np.sort(node[x : x + n])
            name = class_key(members)
            blocks = -(-n // BLOCK)
            own = np.arange(n) // BLOCK
            for other in range(blocks):
                for c, v in zip(out, (np.full(n, name), np.minimum(own, other), np.maximum(own, other), own, members), strict=True):
                    c.append(v)
            if sum(map(len, out[0])) > 1 << 16:
                yield batch_of(schema, [np.concatenate(c).astype(f.type.to_pandas_dtype()) for c, f in zip(out, schema, strict=True)])
                out = [[], [], [], [], []]
        if out[0]:
            yield batch_of(schema, [np.concatenate(c).astype(f.type.to_pandas_dtype()) for c, f in zip(out, schema, strict=True)])


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component."""
    label = np.arange(n)
    while len(x):
        low = np.minimum(label[x], label[y])
        was = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (was == label).all():
            break
    return label


def _prune(fewest: list[tuple[int, int]]):
    """Pairs that survive the comparison of their MinHash values: as they are where a block has few of them (dense false),
    else the block's spanning forest, which only says what belongs together (dense true)."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("dense", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in by_key(batches, ["bucket", "i", "j"]):
            node, own, i, j = (got[c].to_numpy() for c in ("class", "own", "i", "j"))
            sig = _matrix(got["sig"])
            at = runs(got["bucket"].to_numpy(), i, j)
            size = np.diff(at)
            out: list[list[np.ndarray]] = [[], [], []]
            for n in np.unique(size[size > 1]):
                first = at[:-1][size == n]
                step = max(1, (1 << 17) // (int(n) * int(n)))
                p, q = np.triu_indices(int(n), 1)
                for z in range(0, len(first), step):
                    some = first[z : z + step]
                    x, y = (some[:, None] + p).ravel(), (some[:, None] + q).ravel()
                    block = np.repeat(np.arange(len(some)), len(p))
                    wanted = (own[x] != own[y]) | (i[x] == j[x])
                    x, y, block = x[wanted], y[wanted], block[wanted]
                    matches = np.zeros(len(x), np.int64)
                    for upto, least in fewest:
                        matches += (sig[x, upto - STEP : upto] == sig[y, upto - STEP : upto]).sum(1)
                        alive = matches >= least
                        x, y, matches, block = x[alive], y[alive], matches[alive], block[alive]
                        if not len(x):
                            break
                    if not len(x):
                        continue
                    dense = (np.bincount(block, minlength=len(some)) > FEW * n)[block]
                    pairs = ~dense
                    out[0].append(node[x[pairs]])
                    out[1].append(node[y[pairs]])
                    out[2].append(np.zeros(int(pairs.sum()), bool))
                    if dense.any():
                        x, y = x[dense], y[dense]
                        nodes, back = np.unique(np.concatenate([x, y]), return_inverse=True)
                        root = _forest(len(nodes), back[: len(x)], back[len(x) :])
                        out[0].append(node[nodes])
                        out[1].append(node[nodes[root]])
                        out[2].append(np.ones(len(nodes), bool))
            if out[0]:
                yield batch_of(schema, [np.concatenate(c) for c in out])

    return run, "u long, v long, dense boolean"


def _sets(k: int):
    schema = pa.schema([("class", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in shingle_sets(batch.column(0), k):
                full = [s for s in sets if len(s)]
                yield batch_of(schema, [[class_key(s) for s in full], [s.tobytes() for s in full]])

    return run, schema


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Counts of common shingles, a row for each set on the left: products of incidence matrices, some thousand columns at a time."""
    flat = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in [*left, *right]])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    at = runs(flat)
    repeated = np.repeat(np.diff(at) > 1, np.diff(at))
    column = np.cumsum(np.concatenate([[0], (flat[1:] != flat[:-1]) & repeated[1:]]).astype(np.int64) if len(flat) else [])
    flat, owner, column = flat[repeated], owner[repeated], column[repeated]
    counts = np.zeros((len(left), len(right)), np.float32)
    for z in range(int(column[0]) if len(column) else 0, int(column[-1]) + 1 if len(column) else 0, 4096):
        here = slice(*np.searchsorted(column, [z, z + 4096]))
        grid = np.zeros((len(left) + len(right), 4096), np.float32)
        grid[owner[here], column[here] - z] = 1
        counts += grid[: len(left)] @ grid[len(left) :].T
    return counts.astype(np.int64)


def _verify(threshold: float):
    """For each class of a block pair, the weight of the classes it is linked with, and the root of its forest of links."""
    schema = pa.schema([("class", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in by_key(batches, ["group", "i", "j"]):
            node, own, weight, i, j = (got[c].to_numpy() for c in ("class", "own", "weight", "i", "j"))
            data, ends = flat(got["shingles"])
            sets = [data[x:y].view(np.uint64) for x, y in zip(ends[:-1], ends[1:], strict=True)]
            size = np.array([len(s) for s in sets])
            out: list[list[np.ndarray]] = [[], [], []]
            at = runs(got["group"].to_numpy(), i, j)
            for x, y in zip(at[:-1], at[1:], strict=True):
                if i[x] == j[x]:
                    left = right = np.arange(x, y)
                else:
                    left, right = x + np.flatnonzero(own[x:y] == i[x]), x + np.flatnonzero(own[x:y] == j[x])
                if not len(left) or not len(right) or y - x < 2:
                    continue
                common = shared([sets[z] for z in left], [sets[z] for z in right])
                union = size[left][:, None] + size[right] - common
                linked = common >= threshold * union - 1e-9
                if i[x] == j[x]:
                    np.fill_diagonal(linked, False)
                p, q = np.nonzero(linked)
                if not len(p):
                    continue
                p, q = left[p] - x, right[q] - x
                links = np.bincount(p, weight[x + q], y - x)
                if i[x] != j[x]:
                    links = links + np.bincount(q, weight[x + p], y - x)
                root = _forest(y - x, p, q)
                for c, v in zip(out, (node[x:y], links.astype(np.int64), node[x + root]), strict=True):
                    c.append(v)
            if out[0]:
                yield batch_of(schema, [np.concatenate(c) for c in out])

    return run, schema


def _blocks(members: DataFrame) -> DataFrame:
    """class, group, i, j, own, weight: members (class, group, n, bytes, weight) of groups as pairs of blocks, which hold
    BLOCK classes and BLOCK_BYTES of shingles each on average."""
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    placed = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.select("class", "group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "weight")


def _grouped(roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """class, group, n, bytes, rep, weight of the nodes of components (node, root)."""
    members = roots.join(nodes.select(F.col("class").alias("node"), "rep", "weight", "size"), "node")
    many = members.groupBy("root").agg(F.count("*").alias("n"), (F.sum("size") * 8).alias("bytes"))
    return checkpointed(members.join(broadcast_if_small(checkpointed(many), 32), "root").select(F.col("node").alias("class"), F.col("root").alias("group"), "n", "bytes", "rep", "weight"))


def _classes(docs: DataFrame, text: str, doc_id: str, k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, hash of the text, class) and classes (class, class_id, n_links, group), both computed."""
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("hash"), F.col(f"`{text}`").alias("text"))
    base = checkpointed(arrow(source, *_features(k)))
    nodes = base.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    nodes = checkpointed(nodes)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bands = arrow(nodes.select("class", "sig"), _bands, "band long, class long")
    crowds = checkpointed(bands.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > CROWD))
    large = None
    if crowds.head(1):
        side = broadcast_if_small(crowds, 32)
        large = bands.join(side, "band").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        large = large.select(F.col("band").alias("bucket"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class")
        bands = bands.join(side.select("band"), "band", "left_anti")
    small = arrow(bands.repartition(parts, "band").sortWithinPartitions("band"), _buckets, "bucket long, i int, j int, own int, class long")
    buckets = (small if large is None else small.unionByName(large)).dropDuplicates(["bucket", "i", "j", "class"])
    kept = arrow(buckets.join(nodes.select("class", "sig"), "class").repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "class"), *_prune(fewest_matches(threshold)))
    kept = checkpointed(kept.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), "dense").distinct())
    members = _grouped(checkpointed(connected_components(kept, "u", "v")), nodes)
    placed = _blocks(members.where(F.col("n") <= BLOCK))
    wide = members.where(F.col("n") > BLOCK).select(F.col("class").alias("u"))
    if wide.head(1):
        # of a group too large for a block only what is dense is compared as a whole, and other pairs by themselves
        wide = kept.join(wide, "u", "left_semi")
        cores = _grouped(checkpointed(connected_components(wide.where("dense"), "u", "v")), nodes)
        core = cores.select(F.col("class").alias("c"), "group")
        pairs = wide.where("NOT dense AND u <> v").join(core.select(F.col("c").alias("u"), F.col("group").alias("core_u")), "u", "left").join(core.select(F.col("c").alias("v"), F.col("group").alias("core_v")), "v", "left")
        pairs = pairs.where("core_u IS NULL OR core_v IS NULL OR core_u <> core_v").select(F.xxhash64("u", "v").alias("group"), F.explode(F.array("u", "v")).alias("class"))
        alone = pairs.join(members.select("class", "weight"), "class").select("class", "group", F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(-1).alias("own"), "weight")
        placed = placed.unionByName(_blocks(cores)).unionByName(alone)
    owners = checkpointed(members.select("rep").distinct())
    sets, _ = _sets(k)
    own_rows = source.join(broadcast_if_small(owners, 24), source.doc_id.eqNullSafe(F.col("rep")), "left_semi")
    shingles = arrow(own_rows.select("text"), sets, "class long, shingles binary").join(broadcast_if_small(members.select("class"), 24), "class", "left_semi").dropDuplicates(["class"])
    verify, _ = _verify(threshold)
    found = placed.join(shingles, "class").repartition(parts, "group", "i", "j").sortWithinPartitions("group", "i", "j", "class")
    found = checkpointed(arrow(found, verify, "class long, links long, root long"))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    root = connected_components(found.select("class", "root"), "class", "root")
    named = root.join(nodes.select(F.col("class").alias("node"), "rep"), "node")
    first = named.groupBy("root").agg(F.min("rep").alias("first"))
    linked = named.join(first, "root").join(links.withColumnRenamed("class", "node"), "node").select(F.col("node").alias("class"), "first", "links", "root")
    classes = nodes.select("class", "rep", "weight").join(linked, "class", "left")
    classes = classes.select("class", F.coalesce("first", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "class").alias("group"))
    # on its own, so that a class with very many copies can be split in the join
    return base.select("doc_id", "hash", "class"), checkpointed(classes)


def ngram_jaccard_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: doc_id, class_id (smallest doc_id of its connected group of links), n_links (other rows at
    Jaccard similarity >= threshold over k-word shingles; words are runs of non-blank characters).

    Texts of fewer than k words are one shingle; null texts and texts without words have no links and are their own class.
    Repeated rows are documents of their own. A null doc_id counts as a document but names a class only if nothing else does.
    An empty table gives an empty result; other columns are ignored. Equal shingle sets are told by 64-bit hashes.
    """
    rows, classes = _classes(docs, text, doc_id, k, threshold)
    out = rows.select("doc_id", "class").join(classes, "class", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one_of_each_group(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of `docs` for each connected group of links in ngram_jaccard_join, with all its columns: the one of least
    doc_id, a null one last, and of least hash of its text.

    Rows are told apart by id and text, so that an id that two texts share keeps either of them if its group has no earlier
    row, whatever the partitions. Of rows that repeat both, the one of least hash of all its columns stays. Texts without
    words are groups of their own and all stay. An empty table gives no rows.
    """
    rows, classes = _classes(docs, text, doc_id, SHINGLE, THRESHOLD)
    each = rows.where("class IS NOT NULL").groupBy("doc_id", "hash", "class").agg(F.count("*").alias("n"))
    best = each.join(classes.select("class", "group"), "class").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash", "n")).alias("b")).select("b.doc_id", "b.hash", "b.n")
    wordless = rows.where("class IS NULL").select("doc_id", "hash", F.lit(1).cast("long").alias("n")).distinct()
    chosen = best.unionByName(wordless).select(F.col("doc_id").alias("pulsegrain_id"), F.col("hash").alias("pulsegrain_hash"), "n")
    chosen = checkpointed(chosen)
    key, body = F.col(f"`{doc_id}`").cast("long"), F.xxhash64(F.col(f"`{text}`"))
    same = key.eqNullSafe(F.col("pulsegrain_id")) & (body == F.col("pulsegrain_hash"))
    of = lambda which: docs.join(broadcast_if_small(chosen.where(which).drop("n"), 32), same, "left_semi")
    if not chosen.where("n > 1").head(1):
        return of("n = 1")
    # the few that are repeated whole meet by their key
    again = of("n > 1").withColumns({"pulsegrain_id": key, "pulsegrain_hash": body})
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = again.groupBy("pulsegrain_id", "pulsegrain_hash").agg(F.min_by(row, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias("pulsegrain_row"))
    return of("n = 1").unionByName(again.select(*[F.col(f"pulsegrain_row.`{c}`").alias(c) for c in docs.columns]))
