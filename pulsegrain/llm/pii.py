"""Personal data by weak-supervision aggregation.

Candidates are the matches of the fixed patterns and of looser ones. Six labelers (pattern, checksum, gazetteer, context
for, context against, shape) vote for, against or not at all. Expectation-maximisation over the counts of vote patterns in
the whole corpus estimates how reliable each is, and the posteriors of a bounded sample of candidates train the logistic
span classifier that decides on the loose candidates. Matches of the fixed patterns stay whatever it says.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Taken, arrow, batch_of, checkpointed, hinted

KINDS = ("email", "ip", "card", "phone")
#: The base patterns; an address is found from its @ outwards, which gives the same matches as
#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ from left to right without trying every word.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[(\[{]at[)\]}]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[(\[{]dot[)\]}])\x20?[A-Za-z0-9-]{1,63}){1,8}", re.I | re.A)),
    ("phone", re.compile(r"(?<![\w.+-])\(?[0-9]{2,4}\)?(?:[\x20.-][0-9]{2,5}){2,4}(?![\w-])", re.A)),
    ("id", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", re.A)),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)", re.A)),
)
#: What a text must hold for a loose pattern to match: cheaper to look for than the pattern.
HINTS = {"email": re.compile(r"[(\[{]at[)\]}]", re.I), "phone": re.compile(r"[0-9]{2}\)?[\x20.-][0-9]{2}"), "id": re.compile(r"[0-9]{3}-[0-9]{2}-"), "iban": re.compile(r"[0-9]{2}\x20?[A-Z0-9]{4}\x20?[A-Z0-9]{4}")}
#: What a text must hold for any pattern to match.
HINT = r"@|\+[0-9]|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9](?:[ -]?[0-9]){12}|(?i:[(\[{]at[)\]}])|[0-9]{2}\)?[ .-][0-9]{2}|[0-9]{3}-[0-9]{2}-|[0-9]{2} ?[A-Z0-9]{4} ?[A-Z0-9]{4}"
#: Gazetteers and context words.
TLDS = frozenset("com org net edu gov info biz io co de fr es uk us it nl eu ch at be ca au jp cn br ru pl se no".split())
CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "98", "351", "352", "353", "358", "380", "420")
FOR = re.compile(r"\b(?:e-?mail|mail|contact|reach|write|tel|phone|call|mobile|cell|fax|telefon|téléphone|teléfono|ssn|social|iban|account|card|visa|mastercard|ip|addr|address|host|server)\b")
AGAINST = re.compile(r"\b(?:version|ver|v|release|isbn|issn|doi|page|pages|pp|chapter|section|figure|table|no|nr|order|price|year)\b\W*\Z|[$€£#=]\s?\Z")
ROUNDS, SAMPLE = 50, 20000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        # the local part: the whole run before the @, or what an earlier match has left of it
        low = at
        while low > end and (text[low - 1].isascii() and (text[low - 1].isalnum() or text[low - 1] in "._%+-")):
            low -= 1
        m = HOST.match(text, at + 1) if low < at else None
        if m:
            found.append((low, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Kind's number, start and end of the base matches, by kind and start."""
    found = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return found


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """Kind, start and end of loose matches that touch no base match and no earlier loose one."""
    out: list[tuple[str, int, int]] = []
    for kind, pattern in LOOSE:
        if HINTS[kind].search(text):
            taken = Taken([(s, e) for _, s, e in [*base, *out]])
            out += [(kind, *m.span()) for m in pattern.finditer(text) if not taken.touches(*m.span())]
    return sorted(out, key=lambda x: x[1])


def votes(text: str, kind: str, start: int, end: int, strict: bool) -> tuple[int, ...]:
    """The labelers' votes: 1 for, -1 against, 0 none."""
    span, before = text[start:end], text[max(0, start - 40) : start].lower()
    digits = "".join(c for c in span if c in "0123456789")
    if kind == "card":
        check = 1 if luhn(digits) else -1
    elif kind == "iban":
        flat = span.replace(" ", "")
        check = 1 if int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1 else -1
    else:
        check = 0
    if kind == "email":
        known = 1 if re.split(r"[^a-z]", span.lower())[-1] in TLDS else 0
    elif kind == "phone":
        known = 1 if span[0] == "+" and digits.startswith(CODES) else 0
    else:
        known = 0
    if kind == "phone":
        shape = 1 if 10 <= len(digits) <= 13 else -1
    elif kind == "ip":
        shape = -1 if digits.startswith("0") or span in ("0.0.0.0", "255.255.255.255") else 1
    elif kind == "id":
        shape = -1 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else 1
    else:
        shape = 1 if len(span) <= 80 else -1
    if digits and len(set(digits)) == 1:
        shape = -1
    # a pattern that fits dates, versions and lists as well says nothing by itself
    return (1 if strict else 0, check, known, 1 if FOR.search(before) else 0, -1 if AGAINST.search(before) else 0, shape)


ALL_KINDS = (*KINDS, "id", "iban")


def features(text: str, kind: str, start: int, end: int, vote: tuple[int, ...]) -> list[float]:
    span = text[start:end]
    n = len(span)
    digits = sum(c in "0123456789" for c in span)
    return [1.0, *[float(kind == k) for k in ALL_KINDS], min(n, 60) / 60, digits / n, sum(not c.isalnum() for c in span) / n, float(span[0] == "+"), *map(float, vote)]


def estimate(counts: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Posterior of each vote pattern by EM: labelers vote independently given the truth; each has its own rates. Starts
    from the majority of votes; rates are smoothed, and a labeler's votes never count against their meaning."""
    if not counts:
        return {}
    patterns = np.array(list(counts))
    n = np.array([counts[tuple(p)] for p in patterns.tolist()], float)
    post = 1 / (1 + np.exp(-1.5 * patterns.sum(1).astype(float)))
    for _ in range(rounds):
        prior = np.clip((n @ post + 1) / (n.sum() + 2), 0.02, 0.98)
        logit = np.full(len(patterns), math.log(prior / (1 - prior)))
        for j in range(patterns.shape[1]):
            for v in (-1, 0, 1):
                here = patterns[:, j] == v
                if here.any():
                    yes = ((n * post)[here].sum() + 1) / (n @ post + 3)
                    no = ((n * (1 - post))[here].sum() + 1) / (n @ (1 - post) + 3)
                    weight = math.log(yes / no)
                    logit[here] += max(0.0, weight) if v > 0 else min(0.0, weight) if v < 0 else 0.0
        post = 1 / (1 + np.exp(-logit))
    return {tuple(p): float(q) for p, q in zip(patterns.tolist(), post, strict=True)}


def train(x: np.ndarray, y: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic regression on soft labels, by gradient steps with a small penalty."""
    w = np.zeros(x.shape[1])
    scale = 4 / max(1e-9, float((x * x).sum(1).mean()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w -= scale * (x.T @ (p - y) / len(y) + 1e-4 * w)
    return w


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of vote and feature patterns; a batch's candidates with equal ones are one row."""
    schema = pa.schema([("votes", pa.string()), ("features", pa.string()), ("n", pa.int64())])
    for batch in batches:
        counts: Counter = Counter()
        for _, text in hinted(batch.column(0), HINT):
            base = base_spans(text)
            for kind, s, e, strict in [*((KINDS[k], s, e, True) for k, s, e in base), *((k, s, e, False) for k, s, e in loose_spans(text, base))]:
                v = votes(text, kind, s, e, strict)
                counts[",".join(map(str, v)), ",".join(f"{f:.2g}" for f in features(text, kind, s, e, v))] += 1
        if counts:
            yield batch_of(schema, [[k[0] for k in counts], [k[1] for k in counts], list(counts.values())])


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> list[float]:
    """Weights of the span classifier. Votes are counted over all rows; at most `sample` distinct feature patterns, those
    of least hash, train the classifier."""
    found = arrow(docs.select(F.col(text)), _gather, "votes string, features string, n long").groupBy("votes", "features").agg(F.sum("n").alias("n"))
    found = checkpointed(found)
    counts = {tuple(map(int, r.votes.split(","))): r.n for r in found.groupBy("votes").agg(F.sum("n").alias("n")).collect()}
    post = estimate(counts)
    rows = found.orderBy(F.xxhash64("features"), "features", "votes").limit(sample).collect()
    if not rows:
        return []
    x = np.array([[float(f) for f in r.features.split(",")] for r in rows])
    y = np.array([post[tuple(map(int, r.votes.split(",")))] for r in rows])
    return train(x, y).tolist()


def find(text: str, weights: list[float]) -> tuple[list[tuple[int, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and the loose ones that the classifier holds for personal data."""
    base = base_spans(text)
    more = []
    for kind, s, e in loose_spans(text, base) if weights else ():
        v = votes(text, kind, s, e, False)
        if sum(a * b for a, b in zip(features(text, kind, s, e, v), weights, strict=True)) >= 0:
            more.append((kind, s, e))
    return base, more


NOTHING = (0, 0, 0, 0, hashlib.sha256().hexdigest(), "")
OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _scan(weights: list[float]):
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = [NOTHING] * batch.num_rows
            for i, text in hinted(batch.column(1), HINT):
                base, more = find(text, weights)
                digest = hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
                every = sorted([*base, *((ALL_KINDS.index(k), s, e) for k, s, e in more)])
                rows[i] = (*[sum(k == kind for k, *_ in base) for kind in range(len(KINDS))], digest, ",".join(f"{ALL_KINDS[k]}:{s}:{e}" for k, s, e in every))
            if rows:
                yield batch_of(schema, [batch.column(0), *map(list, zip(*rows, strict=True))])

    return run


def mask(text: str, weights: list[float]) -> str:
    """`text` with each span replaced by its kind in brackets; overlapping spans are replaced together, by the first's kind."""
    base, more = find(text, weights)
    out, at = [], 0
    for s, e, kind in sorted([(s, e, KINDS[k]) for k, s, e in base] + [(s, e, k) for k, s, e in more]):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def pii_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans kind:start:end, by kind and start),
    spans (with those of the method; code points, end exclusive).

    Null texts are empty; without spans the counts are 0, `spans` is empty and the digest is that of no bytes. Repeated rows
    get equal results. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return arrow(rows, _scan(fit(rows)), OUT)


def pii_mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with personal data in `text` replaced by its kind, all other columns unchanged.

    Null texts stay null and empty ones empty; repeated rows are masked alike; an empty table gives no rows, and one without
    any match is returned as it is."""
    weights = fit(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            found = hinted(batch.column(at), HINT)
            if found:
                done = batch.column(at).to_pylist()
                for i, t in found:
                    done[i] = mask(t, weights)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(done, batch.schema.field(at).type))
            yield batch

    return arrow(docs, run, docs.schema)
