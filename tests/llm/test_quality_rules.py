from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from pulsegrain.llm.quality_rules import counted, quality_rules, rules, shared_kinds

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


TEXTS = [None, "", " \t\n\x0b\x0c\r ", "a", "a b", "a b c", "a a a a", "a b c a b c", "x y z " * 400, "\n\none\none\n two\n two\n", "é😀 ß\x0bx\x1cy z", "a b c d a b c x a b", "# * $ % & | < >", "w" * 100000]
TEXTS += [" ".join(f"word{i}" for i in range(n)) for n in (49, 50, 3000)]
TEXTS += [" ".join(f"w{i}" for i in range(60)) + " same words here" * 3 + " end"]


def test_counts_like_brute_force(spark):
    rows = [(None if i == 3 else i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], 2, "y")]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, n_words int, body_ string")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(TEXTS[3 if r.doc_id is None else r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, r
        assert not (r.kept and r.base_failed) and 0 <= r.p_good <= 1


def test_verdict(spark):
    clean = [(i, " ".join(f"Word{(i * 37 + j * j) % 997} of" for j in range(60))) for i in range(80)]
    junk = [(100 + i, " ".join(f"buy{(i * 31 + j * j) % 997}!!### {j}***" for j in range(60))) for i in range(10)]
    kept = {r.doc_id for r in quality_rules(spark.createDataFrame(clean + junk, "doc_id long, text string")).collect() if r.kept}
    assert kept == {i for i, _ in clean}
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def good(prior: list[float], rates: list[list[float]], pattern: tuple[int, ...]) -> float:
    each = []
    for p, r in zip(prior, rates, strict=True):
        for v, x in zip(pattern, r, strict=True):
            p *= x if v > 0 else 1 - x
        each.append(p)
    return each[0] / sum(each)


@pytest.mark.parametrize("often", [0.005, 0.02, 0.1, 0.3])
def test_a_random_rule_loses_its_weight(often):
    rng = random.Random(7)
    counts: Counter = Counter()
    for i in range(10000):
        kind = i % 20  # junk: rules 0 and 1, and 2 half the time; a kind that only rule 3 sees and the others do not share
        votes = [kind == 0 and rng.random() < 0.9, kind == 0 and rng.random() < 0.9, kind == 0 and rng.random() < 0.5, kind in (1, 2) and rng.random() < 0.9]
        counts[tuple(1 if v else -1 for v in [*votes, rng.random() < often])] += 1
    prior, rates = shared_kinds(counts)
    assert 1 < len(prior) <= 5
    assert good(prior, rates, (-1, -1, -1, -1, 1)) > 0.8 and good(prior, rates, (-1, -1, -1, -1, -1)) > 0.8
    assert good(prior, rates, (1, 1, -1, -1, -1)) < 0.05 and good(prior, rates, (1, 1, 1, -1, 1)) < 0.05
    assert good(prior, rates, (-1, -1, -1, 1, -1)) < 0.5


def test_no_votes():
    assert shared_kinds({}) == ([1.0], [[]])
    prior, rates = shared_kinds({(-1, 0, -1): 50})
    assert len(prior) == 1 and all(0 < r < 1 for r in rates[0])


def test_a_random_rule_drops_no_text(spark):
    rng = random.Random(2)
    # bangs at random in a tenth of all texts; junk has symbols and capitals
    text = lambda i, junk, bang: " ".join((f"BUY{(i * 31 + j * j) % 997} ###" if junk else f"Word{(i * 37 + j * j) % 997} of") + (" wow!!!!!!!!" if bang and j % 9 == 0 else "") for j in range(60))
    rows = [(i, text(i, i % 10 == 0, rng.random() < 0.1)) for i in range(600)]
    kept = {r.doc_id for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.kept}
    assert kept == {i for i, _ in rows if i % 10}


def test_the_posterior_is_not_all_must_pass(spark):
    """A text that only an unreliable rule votes against is kept, though it does not pass all rules."""
    rng = random.Random(9)
    junk = lambda i: " ".join(f"BUY{(i * 31 + j * j) % 997} ###" for j in range(60))
    good = lambda i, bang: " ".join(f"Word{(i * 37 + j * j) % 997} of" + (" wow!!!!!!!!" if bang and j % 9 == 0 else "") for j in range(60))
    rows = [(i, junk(i) if i % 5 == 0 else good(i, rng.random() < 0.1)) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    votes = counted(docs).select("doc_id", *[v.alias(k) for k, v in rules().items()]).collect()
    passes = {r.doc_id for r in votes if all(r[k] <= 0 for k in rules())}
    kept = {i for i, r in got.items() if r.kept}
    assert kept - passes and kept == {i for i, _ in rows if i % 5}
