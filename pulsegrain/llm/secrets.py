"""Secret scans: fixed patterns, and random-looking strings by a battery of randomness tests.

Candidates are runs of key characters. For the encoding that a run's characters imply, three tests measure how far it is
from random: a chi-squared test of uniform use of the alphabet, a Wald-Wolfowitz runs test about a cut of the alphabet and a
serial-correlation test. Their combined p-value is small for words and identifiers and spread out for keys. How often an
ordinary run of the same encoding and length class is as random-looking is counted over the whole corpus, each distinct
run once, and a Benjamini-Hochberg bound within each encoding and length class sets the p-value from which a run is reported.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Taken, arrow, batch_of, hinted

#: The base patterns by kind, in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}", re.A)
#: What a text must hold for a run, and for anything at all, to be found in it.
RUN_HINT = "[A-Za-z0-9+/_=-]{16}"
HINT = f"(?i:passw|secret|token|api_?key)|{RUN_HINT}"
#: Encodings, tried in order: name, alphabet.
ENCODINGS = (("digits", "0123456789"), ("hex", "0123456789abcdef"), ("upperhex", "0123456789ABCDEF"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), ("upper36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("lower36", "0123456789abcdefghijklmnopqrstuvwxyz"), ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"))
_SETS = tuple(frozenset(a) for _, a in ENCODINGS)
_PLACE = tuple({c: i for i, c in enumerate(a)} for _, a in ENCODINGS)
#: Share of false reports that is accepted, and bins of p-values.
FDR, BINS = 0.05, 40
#: Standard deviations by which a bin must exceed its expected random runs before the excess counts as ordinary ones.
SPREAD = 2.0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the base matches, by start and then kind."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi2_tail(x: float, df: int) -> float:
    """Upper tail by Wilson and Hilferty's cube root."""
    if df <= 0:
        return 1.0
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


@lru_cache(1 << 14)
def battery(run: str) -> tuple[int, float]:
    """Number of the implied encoding, and the combined p-value of randomness (Fisher), 0 to 1."""
    body = run.rstrip("=")
    if not any(c in "0123456789" for c in body):  # long words are as uniform as short keys of letters
        return -1, 0.0
    chars = set(body)
    code = next((i for i, s in enumerate(_SETS) if chars <= s), -1)
    n = len(body)
    if code < 0 or n < (20 if code == 0 else 16):  # shorter numbers are those of cards, accounts and times
        return -1, 0.0
    size, values = len(ENCODINGS[code][1]), [_PLACE[code][c] for c in body]
    # characters pooled to cells of at least four expected
    cells = max(2, min(size, n // 4))
    counts = [0] * cells
    for v in values:
        counts[v * cells // size] += 1
    widths = [0] * cells
    for v in range(size):
        widths[v * cells // size] += 1
    chi = sum((c - n * w / size) ** 2 / (n * w / size) for c, w in zip(counts, widths, strict=True))
    p1 = _chi2_tail(chi, cells - 1)
    # capitals against the rest in an alphabet that has both, which identifiers mix least; else the two halves
    cut = 26 if size > 36 else size / 2
    above = [v >= cut for v in values]
    a = sum(above)
    b = n - a
    if a and b:
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p2 = _normal_tail((1 + sum(x != y for x, y in zip(above, above[1:], strict=False)) - mean) / math.sqrt(var)) if var > 0 else 0.0
    else:
        p2 = 0.0
    m = sum(values) / n
    spread = sum((v - m) ** 2 for v in values)
    p3 = _normal_tail(sum((x - m) * (y - m) for x, y in zip(values, values[1:], strict=False)) / spread * math.sqrt(n)) if spread else 0.0
    f = -2 * sum(math.log(max(p, 1e-12)) for p in (p1, p2, p3))
    return code, math.exp(-f / 2) * sum((f / 2) ** i / math.factorial(i) for i in range(3))


def _bin(p: float) -> int:
    """Ascending in p, finer towards 0."""
    return max(0, min(BINS - 1, int(BINS + math.log10(max(p, 1e-10)) * 4)))


def candidates(text: str) -> list[tuple[int, int, int, int, int]]:
    """Start, end, encoding, length class and p-value's bin of each run."""
    out = []
    for m in RUN.finditer(text):
        code, p = battery(m[0])
        if code >= 0:
            out.append((m.start(), m.end(), code, min(7, (m.end() - m.start()).bit_length() - 4), _bin(p)))
    return out


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash, encoding, length class and bin of each batch's distinct runs."""
    schema = pa.schema([("run", pa.int64()), ("code", pa.int32()), ("length", pa.int32()), ("bin", pa.int32())])
    for batch in batches:
        found: dict[str, tuple[int, int, int]] = {}
        for _, text in hinted(batch.column(0), RUN_HINT):
            for s, e, *rest in candidates(text):
                found[text[s:e]] = tuple(rest)
        if found:
            names = [int.from_bytes(hashlib.blake2b(run.encode(), digest_size=8).digest(), "big", signed=True) for run in found]
            yield batch_of(schema, [names, *map(list, zip(*found.values(), strict=True))])


def histogram(rows: DataFrame) -> list[tuple[int, int, int, int]]:
    """Encoding, length class, bin and number of the distinct runs in the column `text`. A run counts once however often it
    occurs: copies and boilerplate say nothing of how many ordinary runs look random. Runs are told apart by 64-bit hashes."""
    runs = arrow(rows.select("text"), _distinct, "run long, code int, length int, bin int").distinct()
    return [tuple(r) for r in runs.groupBy("code", "length", "bin").agg(F.count("*").alias("n")).collect()]


def thresholds(counts: list[tuple[int, int, int, int]], fdr: float = FDR) -> dict[tuple[int, int], int]:
    """Per encoding and length class the least bin that is reported.

    Ordinary runs pile up at small p-values, random ones spread evenly over (0, 1). The share of random runs is estimated
    from the bins above a half, and bins go in from the top while the expected share of ordinary runs among those reported
    stays within `fdr`.
    """
    out = {}
    for key in {(c, length) for c, length, *_ in counts}:
        hist = [0] * BINS
        for c, length, b, n in counts:
            if (c, length) == key:
                hist[b] += n
        lower = [0.0] + [10 ** ((b - BINS) / 4) for b in range(1, BINS)] + [1.0]
        width = [lower[b + 1] - lower[b] for b in range(BINS)]
        top = [b for b in range(BINS) if lower[b] >= 0.5] or [BINS - 1]
        # random runs per unit of p, from where ordinary ones hardly reach
        density = sum(hist[b] for b in top) / sum(width[b] for b in top)
        least, seen, ordinary = BINS, 0, 0.0
        for b in range(BINS - 1, -1, -1):
            seen += hist[b]
            # what is more than random runs and their usual spread explain
            more = hist[b] - density * width[b]
            ordinary += more if more > SPREAD * math.sqrt(density * width[b]) else 0.0
            if seen and ordinary <= fdr * seen:
                least = b
        out[key] = least
    return out


NOTHING = (0, 0, 0, hashlib.sha256().hexdigest(), "")
OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(least: dict[tuple[int, int], int]):
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = [NOTHING] * batch.num_rows
            for i, text in hinted(batch.column(1), HINT):
                base = base_spans(text)
                taken = Taken([(s, e) for s, e, _ in base])
                more = [(s, e) for s, e, code, length, b in candidates(text) if b >= least.get((code, length), BINS) and not taken.touches(s, e)]
                joined = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
                spans = sorted([(s, KINDS.index(k), e, k) for s, e, k in base] + [(s, 3, e, "random") for s, e in more])
                n = [sum(k == kind for *_, k in base) for kind in KINDS]
                rows[i] = (*n, hashlib.sha256(joined.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans))
            if rows:
                yield batch_of(schema, [batch.column(0), *map(list, zip(*rows, strict=True))])

    return run


def secret_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fdr: float = FDR) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans kind:start:end), spans (base ones and
    random:start:end; code points, end exclusive).

    Null texts are empty; without spans the counts are 0, `spans` is empty and the digest is that of no bytes. Repeated rows
    get equal results, and repeated runs count once in the corpus histogram (encodings x length classes x bins at most, which
    is all that reaches the driver). An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return arrow(rows, _scan(thresholds(histogram(rows), fdr)), OUT)
