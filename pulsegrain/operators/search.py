"""Search: many needles at once in texts or in coded sequences, exact, by order pattern, and with errors.

Needles that fit a task are one automaton, which each text passes once, whatever their number; hits are all that leaves the
task. More needles than that are found by a hash join: places of the haystack are keyed by as many symbols as the shortest
needle has, joined to the needles, and compared whole in the same stage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .sequence import ordinal, record, wildcard_needle

try:
    import ahocorasick
except ImportError:  # then all needles are joined
    ahocorasick = None

#: Needles are broadcast up to this many characters in all, keys included; beyond it the join shuffles.
BROADCAST_CHARS = 8 << 20
#: Needles make an automaton up to this many; a character takes some 50 bytes of it.
AUTOMATON_CHARS = 1 << 20


#: Texts are cut into pieces of this many characters, or of the longest needle's length: finding a character's byte in
#: UTF-8 means counting from the front, which must not be the front of a long text.
PIECE = 128


def checked(needles: DataFrame, id_: str, needle: str, unique: bool = False) -> tuple[DataFrame, int, int, int]:
    """Needles, hinted for broadcast if small, the lengths of the shortest and the longest, and characters in all. ValueError
    for an empty one, or with `unique` for two that end alike."""
    n, shortest, longest, chars = needles.agg(F.count("*"), F.min(F.length(needle)), F.max(F.length(needle)), F.sum(F.length(needle) * 2 + 16)).first()
    if n and (shortest is None or shortest < 1):
        raise ValueError("a needle is empty")
    rows = needles.select(F.col(id_).alias("needle_id"), F.col(needle).alias("needle_"))
    if n and unique:
        ends = rows.groupBy(F.right("needle_", F.lit(shortest))).count().where("count > 1").limit(1).count()
        if ends:
            raise ValueError("two needles end alike")
    return (F.broadcast(rows) if (chars or 0) <= BROADCAST_CHARS else rows), shortest or 1, longest or 1, chars or 0


_automata: dict[str, object] = {}


def _automaton(name: str, needles: list[tuple]):
    """Made once in each worker, which keeps the last one."""
    if name not in _automata:
        _automata.clear()
        found = ahocorasick.Automaton()
        by_text: dict[str, list] = {}
        for i, text in needles:
            by_text.setdefault(text, []).append(i)
        for text, ids in by_text.items():
            found.add_word(text, (len(text), ids))
        found.make_automaton()
        _automata[name] = found
    return _automata[name]


def _scanned(texts: DataFrame, id_: str, text: str, needles: DataFrame) -> DataFrame:
    few = [tuple(r) for r in needles.where("needle_ IS NOT NULL").select("needle_id", "needle_").collect()]
    name = hashlib.blake2b(repr(sorted(few, key=str)).encode(), digest_size=16).hexdigest()
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((texts, id_), (needles, "needle_id"))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(name, few)
        for batch in batches:
            rows = [(i, end - n + 1, needle) for i, t in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True) if t for end, (n, ids) in automaton.iter(t) for needle in ids]
            yield pd.DataFrame(rows, columns=[id_, "idx", "needle_id"])

    return texts.select(id_, text).mapInPandas(run, f"`{id_}` {kinds[0]}, idx long, needle_id {kinds[1]}")


def find_matches(texts: DataFrame, id_: str, text: str, needles: DataFrame, needle_id: str, needle: str) -> DataFrame:
    """id, idx (characters from 0), needle_id of every occurrence, overlapping ones too. Null texts and needles have none."""
    rows, shortest, longest, chars = checked(needles, needle_id, needle)
    if ahocorasick is not None and 0 < chars <= AUTOMATON_CHARS:
        return _scanned(texts, id_, text, rows)
    return _joined(texts, id_, text, rows, shortest, longest)


def _joined(texts: DataFrame, id_: str, text: str, rows: DataFrame, shortest: int, longest: int) -> DataFrame:
    rows = rows.withColumn("key_", F.substring("needle_", 1, shortest))
    size = max(PIECE, longest)
    # each piece is followed by as much of the next as a needle may reach into
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{1,{size + longest - 1}}})).{{1,{size}}}"), F.lit(1))
    hay = texts.select(F.col(id_), F.posexplode(pieces).alias("piece_", "text_")).where(F.length("text_") >= shortest)
    hay = hay.withColumn("at_", F.explode(F.sequence(F.lit(1), F.least(F.length("text_") - shortest + 1, F.lit(size)))))
    hits = hay.join(rows, F.substring(F.col("text_"), F.col("at_"), F.lit(shortest)) == F.col("key_"))
    whole = F.substring(F.col("text_"), F.col("at_"), F.length("needle_")) == F.col("needle_")
    return hits.where(whole).select(F.col(id_), (F.col("piece_") * F.lit(size).cast("long") + F.col("at_") - 1).alias("idx"), "needle_id")


def first_matches(texts: DataFrame, id_: str, text: str, needles: DataFrame, needle_id: str, needle: str, k: int) -> DataFrame:
    """The k occurrences of each text that end first, with their rank."""
    lengths = checked(needles, needle_id, needle)[0].select("needle_id", F.length("needle_").alias("length_"))
    hits = find_matches(texts, id_, text, needles, needle_id, needle).join(lengths, "needle_id")
    window = Window.partitionBy(id_).orderBy(F.col("idx") + F.col("length_"), "idx", "needle_id")
    return hits.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select(id_, "idx", "needle_id", "rank")


def find_apart(texts: DataFrame, id_: str, text: str, needle: str) -> DataFrame:
    """id and sorted starts of the occurrences of one needle that do not overlap, taken from the left."""
    if not needle:
        raise ValueError("a needle is empty")

    @F.pandas_udf(ArrayType(IntegerType()))
    def starts(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else _apart(t, needle))

    return texts.select(id_, starts(F.col(text)).alias("starts"))


def _apart(text: str | bytes, needle: str | bytes) -> list[int]:
    """Places from the left that do not overlap."""
    out, at = [], text.find(needle)
    while at >= 0:
        out.append(at)
        at = text.find(needle, at + len(needle))
    return out


def order_matches(df: DataFrame, keys: Sequence[str], pos: str, value: str, needles: dict[int, tuple[int, Sequence[int]]]) -> DataFrame:
    """keys, idx, start, needle_id: places where the signs of differences follow a needle (offset, signs). idx is the place of
    the first sign and start lies `offset` before; a start before the record is no match."""
    coded = ordinal(df, keys, pos, value)
    window = record(keys, pos)
    found = None
    for name, (offset, signs) in sorted(needles.items()):
        fits = F.lit(True)
        for i, s in enumerate(signs):
            fits = fits & (F.lead("sign", i).over(window) == s)
        hits = coded.withColumn("fits_", F.coalesce(fits, F.lit(False))).where((F.col("fits_")) & (F.col(pos) >= offset))
        part = hits.select(*keys, F.col(pos).alias("idx"), (F.col(pos) - offset).alias("start"), F.lit(name).alias("needle_id"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError("no needle")
    return found


def band_matches(df: DataFrame, keys: Sequence[str], pos: str, value: str, needles: dict[int, Sequence[int]]) -> DataFrame:
    """keys, start, needle_id, intervals, centers: where values rise and fall as a needle of bands does (what precedes its
    first change is free), found from the left without overlaps, and the bands' intervals there do not overlap either. Hits
    are in order within a record; centers are the medians of their bands."""
    coded = {name: (wildcard_needle(bands), np.array(bands)) for name, bands in sorted(needles.items())}
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema]
    shape = ", ".join([*kinds, "start long, needle_id int, intervals array<struct<lo:double,hi:double>>, centers array<double>"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos, kind="stable")
        values = pdf[value].to_numpy(float)
        rising = (np.diff(values) > 0).astype(np.uint8).tobytes()
        rows = []
        for name, ((free, rises), bands) in coded.items():
            for at in _apart(rising, bytes(rises)):
                here = values[at - free : at - free + len(bands)] if at >= free else values[:0]
                if len(here) < len(bands):
                    continue
                parts = [here[bands == b] for b in np.unique(bands)]
                if all(x.max() < y.min() for x, y in zip(parts, parts[1:], strict=False)):
                    rows.append((at - free, name, [{"lo": x.min(), "hi": x.max()} for x in parts], [float(np.median(x)) for x in parts]))
        out = pd.DataFrame(sorted(rows, key=lambda r: r[:2]), columns=["start", "needle_id", "intervals", "centers"])
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return df.select(*keys, pos, value).groupBy(*keys).applyInPandas(solve, shape)


#: Modulus and multiplier of the rolling hash.
ROLL_MODULUS, ROLL_MULTIPLIER = (1 << 31) - 1, 48271


def rolling_hashes(values: np.ndarray, m: int) -> np.ndarray:
    """Hash of the m values that end at each place, or of as many as there are: polynomials in ROLL_MULTIPLIER."""
    out = np.zeros(len(values), np.uint64)
    padded = np.concatenate([np.zeros(m - 1, np.uint64), np.asarray(values, np.uint64)])
    for k in range(m):
        out = (out * np.uint64(ROLL_MULTIPLIER) + padded[k : k + len(values)]) % np.uint64(ROLL_MODULUS)
    return out


def hash_candidates(texts: DataFrame, id_: str, text: str, needle: str, m: int, substitutions: int, inserts: int, deletes: int, alphabet: str) -> DataFrame:
    """id and start where a band string's rolling hash is that of a corruption of the needle's first m symbols, cut to
    m - deletes of them. Hits are candidates that nothing has verified; the shorter windows that begin a text count too."""
    n = m - deletes
    wanted = {int(rolling_hashes(_symbols(x[:n]), n)[-1]) for x in corruptions(needle[:m], substitutions, inserts, deletes, alphabet)}
    kind = texts.schema[id_].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, max(0, int(at) - n + 1)) for i, t in zip(batch[id_], batch[text], strict=True) if t for at in np.flatnonzero(np.isin(rolling_hashes(_symbols(t), n), list(wanted)))]
            yield pd.DataFrame(rows, columns=[id_, "start"])

    return texts.select(id_, text).mapInPandas(run, f"`{id_}` {kind}, start int")


def _symbols(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8).astype(np.uint64) - np.uint64(48)


def frames(df: DataFrame, keys: Sequence[str], pos: str, value: str, length: int, out: str = "frame") -> DataFrame:
    """Each row with the array of its own and the following values, `length` at most."""
    return df.withColumn(out, F.collect_list(value).over(record(keys, pos).rowsBetween(0, length - 1)))


def corruptions(needle: str, substitutions: int, inserts: int, deletes: int, alphabet: str) -> set[str]:
    """All strings from up to that many substitutions, then inserts, then deletes."""
    now = {needle}
    for _ in range(substitutions):
        now |= {x[:i] + c + x[i + 1 :] for x in now for i in range(len(x)) for c in alphabet}
    for _ in range(inserts):
        now |= {x[:i] + c + x[i:] for x in now for i in range(len(x) + 1) for c in alphabet}
    for _ in range(deletes):
        now |= {x[:i] + x[i + 1 :] for x in now for i in range(len(x))}
    return now


def fuzzy_pairs(left: DataFrame, left_text: str, right: DataFrame, right_text: str, block: int, most: int) -> DataFrame:
    """Distinct texts of either side that share their first `block` characters and lie within `most` edits: left, right, distance."""
    a = left.select(F.col(left_text).alias("left")).distinct().withColumn("block_", F.substring("left", 1, block))
    b = right.select(F.col(right_text).alias("right")).distinct().withColumn("block_", F.substring("right", 1, block))
    near = a.join(b, "block_").withColumn("distance", F.levenshtein("left", "right", most))
    return near.where("distance >= 0").select("left", "right", "distance")


def near_pairs(left: DataFrame, left_text: str, right: DataFrame, right_text: str, most: int) -> DataFrame:
    """Distinct texts of either side within `most` edits, wherever the edits fall: left, right, distance.

    Of `most` + 1 pieces of the left text one at least stands unchanged in the right text, shifted by `most` places at most;
    pairs are joined on such a piece and then compared whole. Pieces of texts shorter than that are empty and always equal."""
    k = F.lit(most)
    numbers = F.sequence(F.lit(0), k)
    start = lambda n, i: F.floor(n * i / (most + 1)).cast("int")
    size = lambda n, i: start(n, i + 1) - start(n, i)
    key = lambda n, i, text, at: F.struct(n.alias("n"), i.alias("i"), F.substring(text, at + 1, size(n, i)).alias("piece"))
    a = left.select(F.col(left_text).alias("left")).where("left IS NOT NULL").distinct()
    a = a.select("left", F.explode(F.transform(numbers, lambda i: key(F.length("left"), i, F.col("left"), start(F.length("left"), i)))).alias("key_"))
    b = right.select(F.col(right_text).alias("right")).where("right IS NOT NULL").distinct()
    r = F.length("right")
    places = lambda n, i: F.sequence(F.greatest(F.lit(0), start(n, i) - k), F.least(r - size(n, i), start(n, i) + k))
    fits = lambda n, i: F.greatest(F.lit(0), start(n, i) - k) <= F.least(r - size(n, i), start(n, i) + k)
    keys = F.transform(F.sequence(F.greatest(F.lit(0), r - k), r + k), lambda n: F.flatten(F.transform(F.filter(numbers, lambda i: fits(n, i)), lambda i: F.transform(places(n, i), lambda at: key(n, i, F.col("right"), at)))))
    b = b.select("right", F.explode(F.array_distinct(F.flatten(keys))).alias("key_"))
    near = a.join(b, "key_").select("left", "right").distinct().withColumn("distance", F.levenshtein("left", "right", most))
    return near.where("distance >= 0")


def prefix_then_fuzzy(texts: DataFrame, text: str, needles: DataFrame, needle: str, prefix: int, most: int) -> DataFrame:
    """Distinct texts and needles with the same first `prefix` characters whose rests lie within `most` edits and the wholes too."""
    hits = fuzzy_pairs(needles, needle, texts, text, prefix, most)
    rest = F.levenshtein(F.substring("left", prefix + 1, 1 << 20), F.substring("right", prefix + 1, 1 << 20), most)
    return hits.where(rest >= 0).select(F.col("left").alias("needle"), F.col("right").alias("text"), "distance")


def _near(needle: str, text: str, subs: int, inserts: int, deletes: int) -> list[tuple[int, int, int]]:
    """Start, end and edits of the best near match for each end, with separate limits for each kind of edit."""
    m = len(needle)
    best: dict[int, tuple[int, int]] = {}
    for start in range(len(text) + 1):
        states = {(0, start, 0, 0, 0)}
        seen = set(states)
        while states:
            fresh = set()
            for i, j, s, n, d in states:
                if i == m:
                    if j > start and (j not in best or s + n + d < best[j][0]):
                        best[j] = (s + n + d, start)
                    continue
                if j < len(text) and text[j] == needle[i]:
                    fresh.add((i + 1, j + 1, s, n, d))
                else:
                    if j < len(text) and s < subs:
                        fresh.add((i + 1, j + 1, s + 1, n, d))
                    if j < len(text) and n < inserts:
                        fresh.add((i, j + 1, s, n + 1, d))
                    if d < deletes:
                        fresh.add((i + 1, j, s, n, d + 1))
            states = fresh - seen
            seen |= states
    return sorted((start, end, e) for end, (e, start) in best.items())


def near_matches(texts: DataFrame, id_: str, text: str, needle: str, substitutions: int, inserts: int, deletes: int) -> DataFrame:
    """id, start, end, edits: for each end the near match with the fewest edits, the first of equals; each kind has a limit of its own."""
    kind = texts.schema[id_].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *m) for i, t in zip(batch[id_], batch[text], strict=True) if t is not None for m in _near(needle, t, substitutions, inserts, deletes)]
            yield pd.DataFrame(rows, columns=[id_, "start", "end", "edits"])

    return texts.select(id_, text).mapInPandas(run, f"{id_} {kind}, start int, end int, edits int")


def corrupted_headers(bands: DataFrame, id_: str, text: str, needles: dict[int, str], prefix: int, substitutions: int, inserts: int, deletes: int) -> DataFrame:
    """id, sector, start, end, edits of needles (one for each sector number, as band strings with a common prefix) that occur
    with limited edits. The prefix is searched once, for all of them; what follows it is compared only there, and the whole
    is compared again within the same limits."""
    if not needles:
        raise ValueError("no needle")
    heads = {n[:prefix] for n in needles.values()}
    if len(heads) != 1:
        raise ValueError("the needles have no common prefix of that length")
    (head,) = heads
    kind = bands.schema[id_].dataType.simpleString()
    longest = max(map(len, needles.values())) + inserts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, t in zip(batch[id_], batch[text], strict=True):
                places = {start for start, *_ in _near(head, t, substitutions, inserts, deletes)} if t is not None else set()
                for sector, needle in needles.items():
                    best: dict[int, tuple[int, int]] = {}
                    for start in places:
                        for s, e, edits in _near(needle, t[start : start + longest], substitutions, inserts, deletes):
                            if s == 0 and (start + e not in best or edits < best[start + e][1]):
                                best[start + e] = (start, edits)
                    rows += [(i, sector, s, e, edits) for e, (s, edits) in sorted(best.items())]
            yield pd.DataFrame(rows, columns=[id_, "sector", "start", "end", "edits"])

    return bands.select(id_, text).mapInPandas(run, f"{id_} {kind}, sector int, start int, end int, edits int")
