"""Language identification by a byte convolutional network.

A text is cut into windows of fixed length. Filters two, three and four bytes wide run over each window; the largest
answer of each is kept, and a softmax layer turns these into languages. Bytes enter one-hot, as one of 128 symbols, so that
a filter is a table for each place, and applying it is a lookup by pairs of bytes. A text's language is that of the mean
log-probabilities over all its windows. Training is plain numpy on a bounded sample of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, broadcast_if_small, checkpointed, pieces, utf8

WINDOW, WIDTHS, FILTERS, SYMBOLS = 256, (2, 3, 4), 12, 128
#: Labelled texts that are sampled for training, shared alike by the languages (those of least hash of each), and the least
#: share of a language; windows of each text, passes, batch, step, seed.
SAMPLE, SHARE, EACH, ROUNDS, BATCH, STEP, SEED = 6000, 60, 3, 8, 64, 0.02, 11
FOLD = 5
#: Bytes that are cut into windows at once.
STRIP = 1 << 18

CODE = np.zeros(256, np.uint8)
CODE[97:123] = CODE[65:91] = np.arange(1, 27)
CODE[48:58] = 27
CODE[33:48] = CODE[58:65] = CODE[91:97] = CODE[123:127] = 28
CODE[128:] = 30 + np.arange(128) % 98
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = True


def windows(data: np.ndarray, ends: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all windows of rows a to b, a row each; the row of each; and how many bytes it holds. An empty text has none."""
    size = np.diff(ends[a : b + 1])
    n = -(-size // WINDOW)
    row = np.repeat(np.arange(b - a), n)
    grid = np.zeros(int(n.sum()) * WINDOW, np.uint8)
    first = (np.cumsum(n) - n) * WINDOW
    place = np.arange(int(size.sum())) + np.repeat(first - (ends[a:b] - ends[a]), size)
    grid[place] = CODE[data[ends[a] : ends[b]]]
    inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return grid.reshape(-1, WINDOW), row, np.minimum(WINDOW, size[row] - inside * WINDOW)


class Network:
    def __init__(self, languages: list[str], seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [rng.normal(0, 0.3, (w, SYMBOLS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.top = rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.top_bias = np.zeros(len(languages), np.float32)
        self.pairs: list[list[np.ndarray]] = []

    def freeze(self) -> None:
        """Tables by pairs of bytes for each filter width."""
        self.pairs = [[(t[i][:, None] + t[i + 1][None]).reshape(-1, FILTERS) if i + 1 < len(t) else t[i] for i in range(0, len(t), 2)] for t in self.tables]

    def responses(self, grid: np.ndarray) -> Iterator[np.ndarray]:
        """For each width the filters' answers at each place of each window."""
        pair = grid[:, :-1].astype(np.int32) * SYMBOLS + grid[:, 1:]
        for w, tables in zip(WIDTHS, self.pairs, strict=True):
            n = WINDOW - w + 1
            out = tables[0].take(pair[:, :n].ravel(), axis=0)
            for i, t in enumerate(tables[1:], 1):
                out += t.take((pair if len(t) > SYMBOLS else grid)[:, 2 * i : 2 * i + n].ravel(), axis=0)
            yield out.reshape(len(grid), n, FILTERS)

    def pooled(self, grid: np.ndarray) -> np.ndarray:
        return np.concatenate([r.max(1) for r in self.responses(grid)], 1)

    def log_probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.top + self.top_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def train(self, grid: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, seed: int = SEED) -> None:
        """Adam on cross-entropy; only the place of each filter's largest answer passes a gradient on."""
        rng = np.random.default_rng(seed)
        weights = [*self.tables, self.bias, self.top, self.top_bias]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in weights]
        t, steps = 0, rounds * -(-len(grid) // BATCH)
        for _ in range(rounds):
            order = rng.permutation(len(grid))
            for z in range(0, len(order), BATCH):
                x, want = grid[order[z : z + BATCH]], y[order[z : z + BATCH]]
                self.freeze()
                best = [r.argmax(1) for r in self.responses(x)]
                rows = np.arange(len(x))[:, None]
                pooled = np.concatenate([sum(tab[j][x[rows, at + j], np.arange(FILTERS)] for j in range(w)) for w, tab, at in zip(WIDTHS, self.tables, best, strict=True)], 1)
                hidden = np.maximum(pooled + self.bias, 0)
                p = np.exp(self.log_probabilities(pooled))
                p[np.arange(len(x)), want] -= 1
                p /= len(x)
                back = (p @ self.top.T) * (hidden > 0)
                grads = [np.zeros_like(tab) for tab in self.tables]
                for i, (w, at) in enumerate(zip(WIDTHS, best, strict=True)):
                    part = back[:, i * FILTERS : (i + 1) * FILTERS]
                    for j in range(w):
                        np.add.at(grads[i][j], (x[rows, at + j], np.broadcast_to(np.arange(FILTERS), at.shape)), part)
                grads += [back.sum(0), hidden.T @ p + 1e-4 * self.top, p.sum(0)]
                t += 1
                rate = STEP * (1 - 0.95 * t / steps)
                for w_, g, (m, v) in zip(weights, grads, moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    w_ -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        self.freeze()

    def predict(self, data: np.ndarray, ends: np.ndarray) -> tuple[list[str], list[float]]:
        """Language and probability of each text; und and 0 for one without a letter."""
        names: list[str] = []
        scores: list[float] = []
        for a, b in pieces(ends, STRIP):
            total = np.zeros((b - a, len(self.languages)))
            # a long text in strips of whole windows
            for x in range(int(ends[a]), int(ends[b]), STRIP) if b - a == 1 else (int(ends[a]),):
                grid, row, size = windows(data, np.array([x, min(x + STRIP, int(ends[b]))]), 0, 1) if b - a == 1 else windows(data, ends, a, b)
                for z in range(0, len(grid), 64):
                    logs = self.log_probabilities(self.pooled(grid[z : z + 64]))
                    np.add.at(total, row[z : z + 64], logs * size[z : z + 64, None])
            total /= np.maximum(1, np.diff(ends[a : b + 1]))[:, None]
            p = np.exp(total - total.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for i in range(b - a):
                raw = data[ends[a + i] : ends[a + i + 1]]
                if _LETTER[raw].any() or (len(raw) and raw.max() > 127 and any(c.isalpha() for c in raw.tobytes().decode())):
                    z = int(p[i].argmax())
                    names.append(self.languages[z])
                    scores.append(float(p[i, z]))
                else:
                    names.append("und")
                    scores.append(0.0)
        return names, scores


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few windows of each sampled text, evenly spread."""
    for batch in batches:
        data, ends = utf8(batch.column(2))
        ids, langs, out = [], [], []
        for i, (d, lang) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            grid, _, size = windows(data, ends, i, i + 1)
            full = np.flatnonzero(size >= min(WINDOW, 24))
            for z in full[np.unique(np.linspace(0, len(full) - 1, EACH).astype(int))] if len(full) else ():
                ids.append(d)
                langs.append(lang)
                out.append(grid[z].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(out, pa.binary())], names=["d", "lang", "window"])


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLD == 0, F.lit(False))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Network | None:
    """Trained on the texts of labelled documents outside of the held-out fold: at most `sample` in all, or SHARE of each
    language if that is more; those of least hash of their id within each language, so that a rare one is learned as well."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = checkpointed(rows.groupBy("lang").agg(F.count("*").alias("n")).withColumnRenamed("lang", "l"))
    share = max(SHARE, sample // max(1, sizes.count()))
    # twice the share of each language by a threshold for the hash; only those are put in order
    place = F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id")), F.lit(1 << 40)) / float(1 << 40)
    near = rows.select("doc_id", "lang", place.alias("place")).join(broadcast_if_small(sizes, 64), F.col("lang") == F.col("l"))
    near = near.where(F.col("place") * F.col("n") < 2 * share + 100).select("doc_id", "lang", "place").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    picked = checkpointed(near.withColumn("rank", rank).where(F.col("rank") <= share).select(F.col("doc_id").alias("p"), F.col("lang").alias("q")))
    side = broadcast_if_small(picked, 48)
    got = arrow(rows.join(side, (F.col("doc_id") == F.col("p")) & (F.col("lang") == F.col("q"))).select("doc_id", "lang", "text"), _cut, "d long, lang string, window binary").collect()
    got.sort(key=lambda r: (r.d, r.lang, bytes(r.window)))
    languages = sorted({r.lang for r in got})
    if not languages:
        return None
    net = Network(languages)
    net.train(np.frombuffer(b"".join(bytes(r.window) for r in got), np.uint8).reshape(-1, WINDOW), np.array([languages.index(r.lang) for r in got]))
    return net


def language_id(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out (crc32 of the id modulo 5 is 0), lang_pred (a learned value of `lang`, or und), score (0 to 1).

    Only the text's bytes make a prediction; ids and labels choose training rows. Null texts and texts without a letter are
    und with score 0, as all are if there is nothing to learn from. A null id is never learned from and not held out.
    Repeated rows get equal results. An empty table gives no rows; other columns are ignored.
    """
    net = fit(docs, doc_id, text, lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            names, scores = net.predict(*utf8(batch.column(1))) if net else (["und"] * n, [0.0] * n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return arrow(rows, run, "doc_id long, lang_pred string, score double").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
