"""Quality rules combined by weak supervision, in DataFrame operations only.

Each rule votes that a text is bad (1), that it is good (-1), or abstains (0). Vote patterns are counted over the whole
table, which leaves a row for each pattern at most (3 to the number of rules). Expectation-maximisation on those counts
estimates the shares of good texts and of a few kinds of bad ones that the rules share, and how often each rule votes for
bad in each; the posterior of a text's pattern decides, in place of passing every rule.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

WORD = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
FEW_WORDS, MOST_REPEATED = 50, 50


def counted(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, and of each whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_letters, n_upper, n_bangs, n_distinct."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body_"))
    gone = lambda chars: F.length(F.translate("body_", chars, ""))
    size = F.length("body_")
    blanks = " \t\n\x0b\x0c\r"
    rows = rows.select(
        *[F.col(f"`{c}`") for c in keep],
        "body_",
        gone(blanks).cast("long").alias("word_chars"),
        (size - gone(SYMBOLS)).cast("long").alias("n_symbols"),
        (size - gone("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_upper"),
        (size - gone("!?")).cast("long").alias("n_bangs"),
        F.filter(F.split("body_", WORD), lambda w: w != "").alias("words_"),
        F.when(F.contains("body_", F.lit("\n")), F.filter(F.split("body_", "\n", -1), lambda x: F.length(F.translate(x, blanks, "")) > 0)).alias("lines_"),
    )
    rows = rows.select(
        *[F.col(f"`{c}`") for c in keep],
        "word_chars",
        "n_symbols",
        "n_upper",
        "n_bangs",
        F.size("words_").cast("long").alias("n_words"),
        F.coalesce(F.size("lines_") - F.size(F.array_distinct("lines_")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.transform("words_", lambda w: F.xxhash64(w)).alias("hashes_"),
    )
    triples = F.when(F.col("n_words") >= 3, F.zip_with(F.zip_with(F.slice("hashes_", 1, F.size("hashes_") - 2), F.slice("hashes_", 2, F.size("hashes_") - 2), lambda a, b: F.xxhash64(a, b)), F.slice("hashes_", 3, F.size("hashes_") - 2), lambda a, b: F.xxhash64(a, b)))
    rows = rows.withColumn("n_distinct", F.size(F.array_distinct("hashes_")).cast("long")).withColumn("triples_", triples).drop("hashes_")
    rows = rows.withColumn("again_", F.size("triples_") > F.size(F.array_distinct("triples_")))
    # only texts with a repeated window: windows in order of hash and place; equal neighbours are repeats; their places give the words covered
    placed = F.when(F.col("again_"), F.sort_array(F.transform("triples_", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("placed_", placed).drop("triples_")
    n = F.size("placed_")
    repeated = F.filter("placed_", lambda x, i: ((i > 0) & (F.get("placed_", F.greatest(i - 1, F.lit(0)))["h"] == x["h"])) | ((i < n - 1) & (F.get("placed_", F.least(i + 1, n - 1))["h"] == x["h"])))
    rows = rows.withColumn("starts_", F.sort_array(F.transform(repeated, lambda x: x["i"]))).drop("placed_")
    m = F.size("starts_")
    covered = F.aggregate(F.transform("starts_", lambda x, i: F.when(i + 1 < m, F.least(F.lit(3), F.get("starts_", F.least(i + 1, m - 1)) - x)).otherwise(F.lit(3))), F.lit(0), lambda a, b: a + b)
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("again_", "starts_")


def rules() -> dict[str, Column]:
    """Votes: 1 bad, -1 good, 0 none. Thresholds are parts of the rules and fixed."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, 1).when(good, -1).otherwise(0)

    mean = F.col("word_chars") / words
    distinct = F.col("n_distinct") / words
    return {
        "symbols": vote(F.col("n_symbols") > 0.1 * words, F.col("n_symbols") <= 0.02 * words),
        "repeats": vote(F.col("n_repeat_words") > 0.3 * words, F.col("n_repeat_words") <= 0.1 * words),
        "lines": vote((F.col("n_dup_lines") >= 3) & (F.col("n_dup_lines") * 20 > words), F.col("n_dup_lines") == 0),
        "capitals": vote(F.col("n_upper") > 0.3 * chars, F.col("n_upper") <= 0.1 * chars),
        "bangs": vote(F.col("n_bangs") > 0.1 * words, F.col("n_bangs") <= 0.03 * words),
        "lengths": vote((mean < 2.5) | (mean > 15), (mean >= 3) & (mean <= 10)),
        "variety": vote((words >= 100) & (distinct * F.sqrt(words) < 4), distinct * F.sqrt(words) >= 5),
    }


def _fit(votes: np.ndarray, counts: np.ndarray, share: np.ndarray, rounds: int = 300) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """EM from `share` (patterns x classes): log likelihood, shares of the classes, rates of votes for bad (classes x rules),
    and the new `share`. All that is set beforehand is what a vote for bad means: in each kind of bad texts a rule votes so
    at least as often as in good ones (class 0), where the rates would say otherwise they are pooled."""
    total, before = counts.sum(), -math.inf
    overall = counts @ votes / total
    while True:
        mass = counts[:, None] * share
        n = mass.sum(0) + 1  # with one text of the overall rates
        hits = mass.T @ votes + overall
        rate = hits / n[:, None]
        for j in range(votes.shape[1]):
            pool = [0]
            while True:
                least = hits[pool, j].sum() / n[pool].sum()
                low = [k for k in range(1, len(n)) if k not in pool and rate[k, j] < least]
                if not low:
                    break
                pool.append(min(low, key=lambda k: rate[k, j]))
            rate[pool, j] = least
        rate = np.clip(rate, 1e-9, 1 - 1e-9)
        prior = (n - 0.5) / (total + 0.5 * len(n))
        logs = np.log(prior) + votes @ np.log(rate).T + (1 - votes) @ np.log(1 - rate).T
        top = logs.max(1, keepdims=True)
        each = top[:, 0] + np.log(np.exp(logs - top).sum(1))
        likelihood, share = float(counts @ each), np.exp(logs - each[:, None])
        rounds -= 1
        if rounds <= 0 or likelihood - before < 1e-6:
            return likelihood, prior, rate, share
        before = likelihood


def shared_kinds(counts: dict[tuple[int, ...], int]) -> tuple[list[float], list[list[float]]]:
    """The share of each class, and in each the rate of every rule's votes for bad. Class 0 is the good texts, the others are
    kinds of bad ones: fewer than rules, and one more only while it raises the log likelihood by more than its parameters
    cost (Schwarz). A kind has to explain which rules vote together or keep apart; a rule that votes at random does so alike
    in all classes, gives no kind of its own, and has no weight.

    Rules vote independently given the class. Votes for good and abstentions are both no votes for bad: they only tell the
    rule's own kind, and classes by them would split good texts, say those with few repeated lines from those with none.
    """
    merged: dict[tuple[int, ...], int] = {}
    for p, n in counts.items():
        key = tuple(int(v > 0) for v in p)
        merged[key] = merged.get(key, 0) + n
    if not merged:
        return [1.0], [[]]
    votes, weights = np.array(sorted(merged), float), np.array([merged[p] for p in sorted(merged)], float)
    m = votes.shape[1]
    best = _fit(votes, weights, np.ones((len(votes), 1)))
    for _ in range(m - 1):
        # a further kind begins with the texts that a rule votes against, or with those of them that others do too
        begins = [w for j in range(m) for w in (votes[:, j], votes[:, j] * (votes.sum(1) > 1)) if w.any()]
        tries = [_fit(votes, weights, np.hstack([best[3] * (1 - 0.9 * w[:, None]), 0.9 * w[:, None]])) for w in begins]
        more = max(tries, key=lambda x: x[0], default=best)
        if more[0] - best[0] <= (m + 1) / 2 * math.log(weights.sum()):
            break
        best = more
    return best[1].tolist(), best[2].tolist()


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (fewer than 50 words, or more
    than half of them in repeated 3-word windows), kept, and p_good, the posterior that the text is good. A text
    is kept if it has not base_failed and p_good is at least a half.

    Words are runs of non-blank characters. Null and empty texts have counts 0 and fail. Repeated rows get equal results and
    count each. An empty table gives no rows; other columns are ignored. Windows are compared by 64-bit hashes.
    """
    rows = counted(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    votes = rules()
    failed = (F.col("n_words") < FEW_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    rows = rows.withColumn("base_failed", failed).withColumns({f"vote_{k}": v for k, v in votes.items()})
    names = [f"vote_{k}" for k in votes]
    # numbers only: the texts are read once, for the counts of patterns and for the verdicts
    rows = checkpointed(rows)
    # at most 3 ** 7 rows
    counts = {tuple(r[:-1]): r[-1] for r in rows.where("n_words > 0").groupBy(*names).count().collect()}
    prior, rates = shared_kinds(counts)
    others = F.lit(0.0)
    for k in range(1, len(prior)):
        odds = F.lit(math.log(prior[k] / prior[0]))
        for name, bad, good in zip(names, rates[k], rates[0], strict=True):
            odds = odds + F.when(F.col(name) > 0, math.log(bad / good)).otherwise(math.log((1 - bad) / (1 - good)))
        others = others + F.exp(odds)
    out = rows.withColumn("p_good", F.when(F.col("n_words") > 0, 1 / (1 + others)).otherwise(F.lit(0.0)))
    kept = ~F.col("base_failed") & (F.col("p_good") >= 0.5)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "p_good")
