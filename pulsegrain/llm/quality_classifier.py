"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled texts; unlabelled ones are a sample of the whole table, good and bad. A small network on
whole-text statistics minimises the non-negative unbiased risk pi R_p(+) + max(0, R_u(-) - pi R_p(-)), where the class prior
pi is the least ratio, over score thresholds, of how many unlabelled and how many positive texts lie above it. Labels of
bad texts are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import arrow, batch_of, broadcast_if_small, joined, pieces, runs, utf8

#: Texts per class that are sampled for training (those of least hash), hidden units, steps, batch, step, seed.
SAMPLE, HIDDEN, ROUNDS, BATCH, STEP, SEED = 8000, 24, 700, 1536, 0.01, 7
FOLD, CUT, FIRST, SAFE = 5, 0.3, 3, 0.93

_LETTERS = np.zeros(256, np.int64)
for _i, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"'\"()-", b"#*$%&|<>", b" \t", b"\n\r", bytes(range(128, 256)))):
    _LETTERS[list(_set)] = _i + 1
CLASSES = int(_LETTERS.max()) + 1


def features(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of numbers for each whole text: shares of kinds of bytes, of words by form, and of repeated words, triples and lines."""
    out = []
    table = H.classes("space")
    for a, b in pieces(ends):
        n = b - a
        buf, at = joined(data, ends, a, b, 10)
        kind = _LETTERS[buf]
        row = np.repeat(np.arange(n), np.diff(ends[a : b + 1]) + 1)
        row = np.concatenate([row, [n - 1]])[: len(buf)]
        # the separator before each text goes to the one before; its kind is not counted below
        kinds = np.bincount(row * CLASSES + kind[: len(row)], minlength=n * CLASSES).reshape(n, CLASSES).astype(float)
        kinds[:, 9] -= 1
        size = np.maximum(1, np.diff(ends[a : b + 1])).astype(float)
        starts, stops = H.words(buf, table)
        own = np.searchsorted(at, starts, side="right") - 1
        words = np.bincount(own, minlength=n).astype(float)
        w1 = np.maximum(1, words)
        length = stops - starts
        last = kind[stops - 1]
        first = kind[starts]
        per = lambda x: np.bincount(own, x.astype(float), n) / w1
        h = H.word_hashes(buf, starts, stops)
        distinct = _distinct(own, h, n)
        triple = H.ngrams(h, 3)
        inside = own[: len(triple)] == own[2:] if len(triple) else np.zeros(0, bool)
        triples = np.bincount(own[: len(triple)][inside], minlength=n).astype(float)
        triple_distinct = _distinct(own[: len(triple)][inside], triple[inside], n)
        breaks = np.flatnonzero(buf == 10)
        line_start, line_stop = breaks[:-1] + 1, breaks[1:]
        real = line_stop > line_start
        line_start, line_stop = line_start[real], line_stop[real]
        line_own = np.searchsorted(at, line_start, side="right") - 1
        lines = np.bincount(line_own, minlength=n).astype(float)
        line_distinct = _distinct(line_own, H.word_hashes(buf, line_start, line_stop), n)
        out.append(
            np.column_stack(
                [
                    kinds / size[:, None],
                    per(length) / 10,
                    per(length > 12),
                    per(length == 1),
                    per(first == 2),
                    per(last == 4),
                    per(last == 5),
                    per(last == 7),
                    per((first == 7) & (length == 1)),
                    distinct / w1,
                    np.minimum(3, distinct / np.sqrt(w1)) / 3,
                    1 - triple_distinct / np.maximum(1, triples),
                    1 - line_distinct / np.maximum(1, lines),
                    np.log1p(words) / 10,
                    np.log1p(lines) / 10,
                ]
            )
        )
    return np.concatenate(out) if out else np.zeros((0, CLASSES + 14))


def _distinct(own: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    if not len(h):
        return np.zeros(n)
    order = np.lexsort((h, own))
    at = runs(own[order], h[order])[:-1]
    return np.bincount(own[order][at], minlength=n).astype(float)


def _described(keep: int):
    """`keep` columns as they are, then the features of the text that follows them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(*utf8(batch.column(keep)))
            values = pa.array(np.ascontiguousarray(x).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), values)
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], lists], names=[*batch.schema.names[:keep], "x"])

    return run


class Network:
    """One hidden layer of tanh units; the score is the logistic of its output."""

    def __init__(self, n: int, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, 1 / math.sqrt(n), (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.mean, self.scale = np.zeros(n), np.ones(n)
        self.moments: list[list[np.ndarray]] = [[np.zeros_like(p), np.zeros_like(p)] for p in self.w]
        self.t = 0

    def fit_scale(self, x: np.ndarray) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3

    def out(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]

    def step(self, x: np.ndarray, slope: np.ndarray, rate: float, decay: float = 1e-4) -> None:
        """One Adam step given the risk's derivative by each row's output."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        hidden = np.tanh(z @ self.w[0] + self.w[1])
        back = np.outer(slope, self.w[2]) * (1 - hidden**2)
        grads = [z.T @ back + decay * self.w[0], back.sum(0), hidden.T @ slope + decay * self.w[2], np.array([slope.sum()])]
        self.t += 1
        for p, g, (m, v) in zip(self.w, grads, self.moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.out(x), -30, 30)))


def _loss_slope(out: np.ndarray, sign: int) -> np.ndarray:
    """Derivative of log(1 + exp(-sign out))."""
    return -sign / (1 + np.exp(np.clip(sign * out, -30, 30)))


def _loss(out: np.ndarray, sign: int) -> np.ndarray:
    return np.logaddexp(0, -sign * out)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Least ratio of the unlabelled texts' and the positives' shares above a threshold, with a margin for the sample's size."""
    best = 1.0
    for q in np.linspace(0.02, 0.98, 97):
        t = np.quantile(positive, q)
        p, u = (positive >= t).mean(), (unlabelled >= t).mean()
        if p >= 0.2:
            best = min(best, (u + 0.5 * math.sqrt(u * (1 - u) / len(unlabelled))) / p)
    return float(min(0.99, max(0.05, best)))


def train(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = ROUNDS, seed: int = SEED) -> tuple[Network, float]:
    """Network and class prior. First positives are told from unlabelled texts, which gives the prior; then the non-negative risk is minimised."""
    both = np.concatenate([positive, unlabelled])
    rng = np.random.default_rng(seed)
    # each half is scored by networks that learned from the other
    half_p, half_u = rng.random(len(positive)) < 0.5, rng.random(len(unlabelled)) < 0.5
    out_p, out_u = np.zeros(len(positive)), np.zeros(len(unlabelled))
    for side in (False, True):
        for run in range(FIRST):
            first = Network(both.shape[1], seed + run)
            first.fit_scale(both)
            mine_p, mine_u = positive[half_p == side], unlabelled[half_u == side]
            if not len(mine_p) or not len(mine_u):
                continue
            for x_p, x_u in _batches(rng, mine_p, mine_u, rounds // 5 + 1):
                x = np.concatenate([x_p, x_u])
                out = first.out(x)
                first.step(x, np.concatenate([_loss_slope(out[: len(x_p)], 1) / len(x_p), _loss_slope(out[len(x_p) :], -1) / len(x_u)]), STEP, 3e-3)
            out_p[half_p != side] += first.out(positive[half_p != side])
            out_u[half_u != side] += first.out(unlabelled[half_u != side])
    # too high a prior would call one kind of bad texts good; too low a one only lowers all scores, which boundary() makes up
    prior = class_prior(out_p, out_u)
    share = SAFE * prior
    net = Network(both.shape[1], seed)
    net.fit_scale(both)
    for n, (x_p, x_u) in enumerate(_batches(rng, positive, unlabelled, rounds)):
        x = np.concatenate([x_p, x_u])
        out = net.out(x)
        a, b = out[: len(x_p)], out[len(x_p) :]
        negative = _loss(b, -1).mean() - share * _loss(a, -1).mean()
        if negative >= 0:
            slope = np.concatenate([share * (_loss_slope(a, 1) - _loss_slope(a, -1)) / len(a), _loss_slope(b, -1) / len(b)])
        else:  # the risk of the bad class cannot be below zero: go back up on it
            slope = np.concatenate([share * _loss_slope(a, -1) / len(a), -_loss_slope(b, -1) / len(b)])
        net.step(x, slope, STEP * (1 - 0.9 * n / rounds))
    net.w[3] += math.log(CUT / (1 - CUT)) - boundary(net.out(positive), net.out(unlabelled), prior)
    return net, prior


def boundary(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """Output that is to score CUT: the middle of the highest wide gap of the unlabelled texts' outputs around the share that
    the prior leaves for bad ones, below all but a few of the positives."""
    order = np.sort(unlabelled)
    low = int(0.8 * (1 - prior) * len(order))
    high = min(int((1 - prior + 0.05) * len(order)), int(np.searchsorted(order, np.quantile(positive, 0.002))) + 1)
    low, high = max(0, min(low, high - 2)), min(len(order), max(high, 2))
    gaps = np.diff(order[low:high])
    if not len(gaps):
        return float(order[0]) - 1
    z = low + int(np.flatnonzero(gaps >= 0.3 * gaps.max())[-1])
    return float(order[z] + order[z + 1]) / 2


def _batches(rng: np.random.Generator, p: np.ndarray, u: np.ndarray, rounds: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for _ in range(rounds):
        yield p[rng.integers(0, len(p), min(BATCH, len(p)))], u[rng.integers(0, len(u), min(BATCH, len(u)))]


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLD == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, learn_all: bool = False) -> tuple[Network, float] | None:
    """Trained on at most `sample` positives and `sample` unlabelled texts, those of least hash of their id, outside of the held-out fold."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    if not learn_all:
        rows = rows.where(~held_out())
    trusted = labels.where("quality = 1").select(F.col("doc_id").alias("l")).distinct()
    order = F.xxhash64(F.lit(SEED), F.col("doc_id"))
    # the least hashes are picked without the texts, which then come for the sample alone
    ids = rows.select("doc_id")
    positive = ids.join(trusted, F.col("doc_id") == F.col("l"), "left_semi").distinct().orderBy(order, "doc_id").limit(sample).withColumn("y", F.lit(1))
    unlabelled = ids.distinct().orderBy(F.xxhash64(F.lit(SEED + 1), F.col("doc_id")), "doc_id").limit(sample).withColumn("y", F.lit(0))
    picked = positive.unionByName(unlabelled).withColumnRenamed("doc_id", "d")
    got = arrow(rows.join(F.broadcast(picked), F.col("doc_id") == F.col("d")).select("d", "y", "text"), _described(2), "d long, y int, x array<double>").collect()
    got.sort(key=lambda r: (r.y, r.d, r.x))
    p, u = (np.array([r.x for r in got if r.y == y]) for y in (1, 0))
    return train(p, u) if len(p) >= 2 and len(u) >= 2 else None


def _scored(net: Network | None, keep: int, least: float | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(keep)
            data, ends = utf8(text)
            score = net.scores(features(data, ends)) if net is not None else np.full(len(text), 0.5)
            if least is None:
                yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(score)], names=[*batch.schema.names[:keep], "score"])
            else:
                yield batch.filter(pa.array(score >= least))

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out (crc32 of the id modulo 5 is 0), score (probability of good quality), predicted (score >= 0.3).

    Only the text makes the score; ids choose training rows. Null texts are scored as empty ones. A null id is never learned
    from and not held out. Repeated rows get equal scores. Without two positives to learn from every score is a half. An
    empty table gives no rows; other columns are ignored. The sample for training is bounded by SAMPLE for each class.
    """
    model = fit(docs, labels, doc_id, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scored = arrow(rows, _scored(model[0] if model else None, 1), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = CUT) -> DataFrame:
    """The rows of `docs` (doc_id and text among their columns) whose score is at least `least`, with all their columns; cases as in quality_scores."""
    model = fit(docs, labels)
    return arrow(docs, _scored(model[0] if model else None, docs.columns.index("text"), least), docs.schema)
