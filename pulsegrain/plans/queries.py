"""One query for each operator over the test tables, with DuckDB text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checksums, folds, signal
from ..operators import aggregates, cluster, loops, merge, search, sequence, timeline
from ..operators.marks import header_bytes
from ..operators.marks import parse_header as parsed
from ..streaming import online
from .views import BANDS, BITS, KEYS, PULSES, bands, bits, pulses, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CLOCK, CENTERS = 24.0, (15.0, 30.0, 45.0)
#: Order pattern + - +, and the runs of zeros that its four delays stand for.
NEEDLE = {0: (1, (1, -1, 1))}
RUNS = ((1, True), (2, False), (1, False), (2, False))


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        name = f.__name__.strip("_")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


W_USER = "OVER (PARTITION BY user_id ORDER BY pos)"


# --- sources and sinks ---------------------------------------------------------------------------------------------------


@query(_with(PULSES) + f"SELECT user_id, pos, gap FROM (SELECT user_id, pos, pos - lag(pos) {W_USER} - 1 AS gap FROM pulses WHERE event_type = 'click') WHERE gap IS NOT NULL")
def pulse_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.pulse_gaps(pulses(spark, sf_dir), KEYS, "pos", F.col("event_type") == "click").select("user_id", "pos", "gap")


@query(
    _with(
        PULSES,
        "v AS (SELECT user_id, pos, least(63, raw % 80) AS v FROM pulses)",
        f"g AS (SELECT *, coalesce(sum(CASE WHEN v <> 63 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM v)",
    )
    + "SELECT user_id, CAST(g - 1 AS BIGINT) AS pos, CAST(sum(v) AS BIGINT) AS delay FROM g WHERE g > 0 GROUP BY user_id, g"
)
def varint_delta_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pulses(spark, sf_dir).withColumn("byte", F.least(F.lit(63), F.col("raw") % 80).cast("int"))
    return sequence.decode_delays(rows, KEYS, "pos", "byte")


GRID = "grid AS (SELECT b.p_brand, s.p_size FROM (SELECT DISTINCT p_brand FROM part) b CROSS JOIN (SELECT DISTINCT p_size FROM part) s)"


def _cells(spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], DataFrame]:
    part = table(spark, sf_dir, "part")
    cells = part.groupBy("p_brand", "p_size").agg(F.count("*").alias("n_parts"), F.min("p_partkey").alias("first_part"))
    return [part.select("p_brand").distinct(), part.select("p_size").distinct()], cells


@query(_with(GRID) + "SELECT g.p_brand, g.p_size, count(p_partkey) AS n_parts, coalesce(min(p_partkey), -1) AS first_part FROM grid g LEFT JOIN part p ON p.p_brand = g.p_brand AND p.p_size = g.p_size GROUP BY ALL")
def dense_grid_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes, cells = _cells(spark, sf_dir)
    return merge.dense_grid(axes, cells, ["p_brand", "p_size"], {"n_parts": 0, "first_part": -1})


@query(_with(GRID) + "SELECT g.p_brand, g.p_size FROM grid g LEFT JOIN part p ON p.p_brand = g.p_brand AND p.p_size = g.p_size WHERE p.p_partkey IS NULL")
def missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes, cells = _cells(spark, sf_dir)
    return merge.missing(axes, cells, ["p_brand", "p_size"])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def predicate_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_linestatus = 'F'").select("l_orderkey", "l_linenumber", "l_quantity")


# --- projections and filters ----------------------------------------------------------------------------------------------


@query(_with(PULSES) + f"SELECT user_id, pos, CAST(coalesce(sign(delay - lag(delay) {W_USER}), 0) AS INT) AS sign FROM pulses")
def ordinal_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.ordinal(pulses(spark, sf_dir), KEYS, "pos", "delay").select("user_id", "pos", "sign")


@query(_with(PULSES) + f"SELECT user_id, pos, increase FROM (SELECT user_id, pos, delay > lag(delay) {W_USER} AS increase FROM pulses) WHERE increase IS NOT NULL")
def ordinal_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.increases(pulses(spark, sf_dir), KEYS, "pos", "delay").select("user_id", "pos", "increase")


QUANTISED = f"quantised AS (SELECT user_id, pos, delay, greatest(0, CAST(round(2.0 * delay / {CLOCK}) AS INT) - 1) AS zeroes FROM pulses WHERE round(2.0 * delay / {CLOCK}) > 1)"


@query(_with(PULSES, QUANTISED) + "SELECT user_id, pos, delay, zeroes FROM quantised")
def halfclock_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.quantised(pulses(spark, sf_dir), "delay", CLOCK).select("user_id", "pos", "delay", "zeroes")


@query(
    _with(
        PULSES,
        QUANTISED,
        "s AS (SELECT *, coalesce(sum(zeroes + 1) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS s FROM quantised)",
        "e AS (SELECT user_id, pos, s, zeroes, unnest(range(0, zeroes + 1)) AS i FROM s)",
    )
    + "SELECT user_id, CAST(s + i AS BIGINT) AS bit_pos, CASE WHEN i = zeroes THEN 1 ELSE 0 END AS bit, pos AS flux_idx FROM e UNION ALL SELECT user_id, 0, 1, min(pos) FROM quantised GROUP BY user_id"
)
def pulse_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.expand_bits(sequence.quantised(pulses(spark, sf_dir), "delay", CLOCK), KEYS, "pos")


@query(
    _with(PULSES, BITS, "r AS (SELECT *, coalesce(sum(bit) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run_no, sum(bit) OVER (PARTITION BY user_id) AS ones FROM bits)")
    + "SELECT user_id, CAST(run_no AS BIGINT) AS run_no, CAST(sum(1 - bit) AS BIGINT) AS run_len, run_no = 0 OR run_no = ones AS at_least FROM r GROUP BY user_id, run_no, ones"
)
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.zero_runs(bits(spark, sf_dir), KEYS, "pos", "bit")


@query("SELECT p_partkey, CAST(('0x' || substring(hex(encode(p_name)), 1, 8)) AS BIGINT) AS head, CAST(('0x' || substring(hex(encode(p_name)), 2 * octet_length(encode(p_name)) - 5, 6)) AS BIGINT) AS tail FROM part")
def be_uint(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = checksums.big_endian(F.col("p_name"), F.octet_length("p_name") - 2, 8)
    return table(spark, sf_dir, "part").select("p_partkey", checksums.big_endian(F.col("p_name"), 1, 4).alias("head"), tail.alias("tail"))


NEAREST = "nearest AS (SELECT *, CASE WHEN abs(delay - 15.0) <= abs(delay - 30.0) AND abs(delay - 15.0) <= abs(delay - 45.0) THEN 0 WHEN abs(delay - 30.0) <= abs(delay - 45.0) THEN 1 ELSE 2 END AS band FROM pulses)"


@query(_with(PULSES, NEAREST) + "SELECT user_id, pos, band, CAST(delay - [15.0, 30.0, 45.0][band + 1] AS DOUBLE) AS residual FROM nearest")
def nearest_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = signal.nearest(F.col("delay"), CENTERS)
    return pulses(spark, sf_dir).withColumn("n", near).select("user_id", "pos", F.col("n.band").alias("band"), F.col("n.residual").alias("residual"))


@query(_with(PULSES, NEAREST) + "SELECT user_id, pos, CAST([16.0, 32.0, 48.0][band + 1] + delay - [15.0, 30.0, 45.0][band + 1] AS DOUBLE) AS recentered FROM nearest")
def recenter(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.array(F.lit(16.0), F.lit(32.0), F.lit(48.0))
    rows = pulses(spark, sf_dir).withColumn("n", signal.nearest(F.col("delay"), CENTERS))
    return rows.select("user_id", "pos", (F.element_at(target, F.col("n.band") + 1) + F.col("n.residual")).alias("recentered"))


@query(
    _with(PULSES, "c AS (SELECT user_id, pos, unnest([{'d': abs(delay - 15.0), 'i': 0}, {'d': abs(delay - 30.0), 'i': 1}, {'d': abs(delay - 45.0), 'i': 2}]) AS x FROM pulses)")
    + "SELECT user_id, pos, string_agg(CAST(x.i AS VARCHAR), ',' ORDER BY x.d, x.i) AS ranked FROM c GROUP BY user_id, pos"
)
def center_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pulses(spark, sf_dir).select("user_id", "pos", F.array_join(F.transform(signal.ranked_centers(F.col("delay"), CENTERS), lambda x: x.cast("string")), ",").alias("ranked"))


@query("SELECT event_id, value FROM events WHERE value >= 0 AND event_type IN ('error', 'view', 'click')")
def status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where((F.col("value") >= 0) & F.col("event_type").isin("error", "view", "click")).select("event_id", "value")


HEADERS = """headers AS (SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'A1A1A1' WHEN event_type = 'error' THEN 'C2C2C2' ELSE '000000' END
  || upper(hex(CAST(248 + CAST(floor(value * 100) AS BIGINT) % 8 AS BIGINT))) AS h FROM events)"""


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.when(F.col("event_type").isin("view", "click"), "A1A1A1").when(F.col("event_type") == "error", "C2C2C2").otherwise("000000")
    fourth = F.hex(F.floor(F.col("value") * 100).cast("long") % 8 + 248)
    return table(spark, sf_dir, "events").select("event_id", F.unhex(F.concat(start, fourth)).alias("header"))


@query(
    _with(HEADERS)
    + """SELECT event_id, CASE WHEN h IN ('C2C2C2FC', 'C2C2C2FE') THEN 'IAM' WHEN h IN ('A1A1A1FC', 'A1A1A1FD', 'A1A1A1FE', 'A1A1A1FF') THEN 'IDAM'
  WHEN h IN ('A1A1A1FA', 'A1A1A1FB') THEN 'DAM' WHEN h IN ('A1A1A1F8', 'A1A1A1F9') THEN 'DDAM' ELSE 'UNKNOWN' END AS mark_type,
  h IN ('A1A1A1F8', 'A1A1A1F9') AS deleted FROM headers"""
)
def classify_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headers(spark, sf_dir).select("event_id", signal.mark_type(F.col("header")).alias("mark_type"), signal.is_deleted(F.col("header")).alias("deleted"))


@query(_with(PULSES) + "SELECT user_id, pos, CAST(floor(delay * 1.25) AS INT) AS delay FROM pulses")
def stretched_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pulses(spark, sf_dir).select("user_id", "pos", signal.stretched(F.col("delay"), 0.25).alias("delay"))


@query(_with(PULSES) + "SELECT user_id, string_agg(CAST(pos * 3 + delay - first AS VARCHAR), ',' ORDER BY pos) AS places FROM (SELECT *, first_value(pos * 3 + delay) OVER (PARTITION BY user_id ORDER BY pos) AS first FROM pulses) GROUP BY user_id")
def rebased_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pulses(spark, sf_dir).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("pos", (F.col("pos") * 3 + F.col("delay")).alias("at")))).alias("p"))
    places = timeline.rebase(F.transform("p", lambda x: x["at"]))
    return rows.select("user_id", F.array_join(F.transform(places, lambda x: x.cast("string")), ",").alias("places"))


@query(
    _with(HEADERS)
    + """SELECT event_id, CAST(CASE WHEN h IN ('C2C2C2FC', 'C2C2C2FE') THEN 4 WHEN h IN ('A1A1A1FC', 'A1A1A1FD', 'A1A1A1FE', 'A1A1A1FF') THEN 10
  WHEN h IN ('A1A1A1F8', 'A1A1A1F9', 'A1A1A1FA', 'A1A1A1FB') THEN 518 END AS INT) AS n_bytes FROM headers"""
)
def record_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headers(spark, sf_dir).select("event_id", signal.byte_length(signal.mark_type(F.col("header")), F.lit(512)).alias("n_bytes"))


# --- pairing and slicing --------------------------------------------------------------------------------------------------


@query(
    _with(PULSES, "s AS (SELECT user_id, pos, k FROM pulses WHERE event_type = 'signup')", "p AS (SELECT user_id, pos FROM pulses WHERE event_type = 'purchase')")
    + """SELECT p.user_id, p.pos, CASE WHEN p.pos - s.pos < 4 THEN s.pos END AS header_pos, CASE WHEN p.pos - s.pos < 4 THEN s.k END AS header_k
FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.pos > s.pos"""
)
def asof_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline.pair_latest(pulses(spark, sf_dir), KEYS, "pos", F.col("event_type") == "signup", F.col("event_type") == "purchase", ["k"], 4)
    return rows.select("user_id", "pos", "header_pos", "header_k")


PAIRS = f"pairs AS (SELECT *, lag(event_type) {W_USER} AS t, lag(k) {W_USER} AS header_k FROM pulses)"


@query(_with(PULSES, PAIRS) + "SELECT user_id, pos, k, header_k FROM pairs WHERE event_type = 'purchase' AND t = 'signup' AND header_k % 10 <> 0")
def adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = (F.col("event_type") == "signup") & (F.col("k") % 10 != 0)
    return timeline.pair_adjacent(pulses(spark, sf_dir), KEYS, "pos", header, F.col("event_type") == "purchase", ["k"]).select("user_id", "pos", "k", "header_k")


SIGNS = f"signs AS (SELECT *, coalesce(sign(delay - lag(delay) {W_USER}), 0) AS sign FROM pulses)"
MATCHES = f"""matches AS (SELECT user_id, pos AS idx, pos - 1 AS start FROM (SELECT *, lead(sign, 1) {W_USER} AS b, lead(sign, 2) {W_USER} AS c FROM signs)
  WHERE sign = 1 AND b = -1 AND c = 1 AND pos >= 1)"""


@query(_with(PULSES, SIGNS, MATCHES) + "SELECT user_id, idx, start, 0 AS needle_id FROM matches")
def ordinal_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.order_matches(pulses(spark, sf_dir), KEYS, "pos", "delay", NEEDLE)


TOTALS = "totals AS (SELECT user_id, count(*) AS total FROM pulses GROUP BY user_id)"
SLICES = """own AS (SELECT m.user_id, row_number() OVER (PARTITION BY m.user_id ORDER BY start) AS slice_no, start AS flux_begin,
  lead(start, 1, total) OVER (PARTITION BY m.user_id ORDER BY start) AS flux_end FROM matches m JOIN totals t ON t.user_id = m.user_id),
head AS (SELECT t.user_id, 0 AS slice_no, 0 AS flux_begin, coalesce(min(start), total) AS flux_end FROM totals t LEFT JOIN matches m ON m.user_id = t.user_id GROUP BY t.user_id, total HAVING coalesce(min(start), total) > 0),
slices AS (SELECT *, CASE WHEN flux_end - flux_begin < 3 THEN 'TRUNCATED' WHEN slice_no = 0 THEN 'UNKNOWN' ELSE 'PREAMBLE_FOUND' END AS status FROM (SELECT * FROM head UNION ALL SELECT * FROM own))"""


def _slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pulses(spark, sf_dir)
    totals = rows.groupBy("user_id").agg(F.count("*").alias("total"))
    return timeline.slices(search.order_matches(rows, KEYS, "pos", "delay", NEEDLE), totals, KEYS, "start", "total", 3)


@query(_with(PULSES, SIGNS, MATCHES, TOTALS, SLICES) + "SELECT user_id, slice_no, flux_begin, flux_end, status FROM slices")
def slice_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slices(spark, sf_dir)


@query(
    _with(PULSES, SIGNS, MATCHES, TOTALS, SLICES, "c AS (SELECT *, flux_begin + 5 AS cut FROM slices)")
    + """SELECT user_id, slice_no, 0 AS part, flux_begin, CASE WHEN cut < flux_end THEN cut ELSE flux_end END AS flux_end, status FROM c
UNION ALL SELECT user_id, slice_no, 1, cut, flux_end, 'UNKNOWN' FROM c WHERE cut < flux_end"""
)
def interval_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _slices(spark, sf_dir).withColumn("cut", F.col("flux_begin") + 5)
    return timeline.split(rows, "flux_begin", "flux_end", "cut", "status").select("user_id", "slice_no", "part", "flux_begin", "flux_end", "status")


@query(
    _with(PULSES, SIGNS, MATCHES, TOTALS, SLICES)
    + "SELECT user_id, slice_no, CAST(coalesce(sum(flux_end - flux_begin) OVER (PARTITION BY user_id ORDER BY slice_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin FROM slices"
)
def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _slices(spark, sf_dir).withColumn("length", F.col("flux_end") - F.col("flux_begin"))
    return sequence.running_offsets(rows, KEYS, "slice_no", "length").select("user_id", "slice_no", "begin")


@query(_with(PULSES, SIGNS, MATCHES, TOTALS, SLICES) + "SELECT s.user_id, sum(flux_end - flux_begin) / any_value(total) AS coverage FROM slices s JOIN totals t ON t.user_id = s.user_id WHERE status = 'PREAMBLE_FOUND' GROUP BY s.user_id")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _slices(spark, sf_dir).where("status = 'PREAMBLE_FOUND'")
    totals = pulses(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("total"))
    return aggregates.coverage(rows.join(totals, "user_id"), KEYS, "flux_begin", "flux_end", F.max("total"))


# --- search ---------------------------------------------------------------------------------------------------------------


def _needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").where(F.length("text") >= 12).select("item_id", F.col("text").alias("needle"))


HITS = """needles AS (SELECT item_id AS needle_id, text AS needle FROM benchmark WHERE length(text) >= 12),
places AS (SELECT doc_id, text, unnest(range(1, greatest(length(text) - 10, 1))) AS i FROM documents),
hits AS (SELECT doc_id, i - 1 AS idx, needle_id, length(needle) AS n FROM places JOIN needles ON substring(text, i, 12) = substring(needle, 1, 12) WHERE substring(text, i, length(needle)) = needle)"""


@query(_with(HITS) + "SELECT doc_id, idx, needle_id FROM hits")
def multi_needle_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find_matches(table(spark, sf_dir, "documents"), "doc_id", "text", _needles(spark, sf_dir), "item_id", "needle")


@query(_with(HITS) + "SELECT doc_id, idx, needle_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx + n, idx, needle_id) AS INT) AS rank FROM hits) WHERE rank <= 2")
def first_k_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.first_matches(table(spark, sf_dir, "documents"), "doc_id", "text", _needles(spark, sf_dir), "item_id", "needle", 2)


@query("SELECT item_id, (length(text) - length(replace(text, 'anan', ''))) // 4 AS n_apart FROM benchmark")
def nonoverlap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.find_apart(table(spark, sf_dir, "benchmark"), "item_id", "text", "anan")
    return found.select("item_id", F.size("starts").cast("long").alias("n_apart"))


@query("SELECT a.p_name AS \"left\", b.p_name AS \"right\", CAST(levenshtein(a.p_name, b.p_name) AS INT) AS distance FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON substring(a.p_name, 1, 3) = substring(b.p_name, 1, 3) WHERE levenshtein(a.p_name, b.p_name) <= 4")
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return search.fuzzy_pairs(part, "p_name", part, "p_name", 3, 4)


@query()
def fuzzy_match_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return search.near_pairs(part, "p_name", part, "p_name", 4)


@query(
    """SELECT n AS needle, p_name AS text, CAST(levenshtein(n, p_name) AS INT) AS distance FROM (SELECT DISTINCT p_name FROM part) p JOIN (SELECT DISTINCT p_type, lower(p_type) || ' rang' AS n FROM part) t
ON substring(n, 1, 4) = substring(p_name, 1, 4) WHERE levenshtein(n, p_name) <= 3 AND levenshtein(substring(n, 5), substring(p_name, 5)) <= 3"""
)
def prefix_then_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    needles = part.select(F.concat(F.lower("p_type"), F.lit(" rang")).alias("needle")).distinct()
    return search.prefix_then_fuzzy(part, "p_name", needles, "needle", 4, 3)


@query("SELECT p_name, count(*) AS n FROM part WHERE levenshtein(p_name, 'red bolt') <= 1 GROUP BY p_name")
def one_edit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    alphabet = "abcdefghijklmnopqrstuvwxyz "
    near = search.corruptions("red bolt", 1, 0, 0, alphabet) | search.corruptions("red bolt", 0, 1, 0, alphabet) | search.corruptions("red bolt", 0, 0, 1, alphabet)
    needles = spark.createDataFrame([(x,) for x in sorted(near)], "p_name string")
    return table(spark, sf_dir, "part").join(F.broadcast(needles), "p_name", "left_semi").groupBy("p_name").agg(F.count("*").alias("n"))


@query(
    """SELECT user_id, sector, upper('A1A1A1FE' || printf('%02x', user_id % 80) || '01' || printf('%02x', sector) || '02') AS header
FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (SELECT CAST(unnest(range(1, 19)) AS INT) AS sector)"""
)
def generated_needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    sectors = spark.range(1, 19).select(F.col("id").cast("int").alias("sector"))
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    return users.crossJoin(F.broadcast(sectors)).select("user_id", "sector", F.concat(F.lit("A1A1A1FE"), two(F.col("user_id") % 80), F.lit("01"), two(F.col("sector")), F.lit("02")).alias("header"))


@query(
    _with(
        PULSES,
        SIGNS,
        MATCHES,
        f"f AS (SELECT user_id, pos, delay AS d0, lead(delay, 1) {W_USER} AS d1, lead(delay, 2) {W_USER} AS d2, lead(delay, 3) {W_USER} AS d3 FROM pulses)",
        "b AS (SELECT m.user_id, idx, d2, least(d1, d3) AS lo2, least(d0 * 4.0::DOUBLE / 3, d2 * 4.0::DOUBLE / 3, least(d1, d3) * 4.0::DOUBLE / 5) AS up, greatest(d2 * 4.0::DOUBLE / 5, greatest(d1, d3) * 4.0::DOUBLE / 7) AS low FROM matches m JOIN f ON f.user_id = m.user_id AND f.pos = m.start)",
    )
    + "SELECT user_id, idx, 0.6 * low + 0.4 * up AS clock FROM b WHERE lo2 > d2 AND low < up"
)
def clock_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pulses(spark, sf_dir)
    found = search.order_matches(rows, KEYS, "pos", "delay", NEEDLE)
    framed = search.frames(rows, KEYS, "pos", "delay", len(RUNS)).select("user_id", F.col("pos").alias("start"), "frame")
    fitted = found.join(framed, ["user_id", "start"]).withColumn("clock", signal.clock_fit(F.col("frame"), RUNS))
    return fitted.where("clock IS NOT NULL").select("user_id", "idx", "clock")


# --- aggregations ---------------------------------------------------------------------------------------------------------


@query(_with(PULSES) + f"SELECT user_id, sqrt(sum(pow(delay - round(2.0 * delay / {CLOCK}) * {CLOCK / 2}, 2)) / count(*)) AS rmse FROM pulses GROUP BY user_id")
def quantise_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.quantisation_error(pulses(spark, sf_dir), KEYS, "delay", CLOCK)


@query(_with(PULSES) + "SELECT user_id, median(delay) AS median FROM pulses GROUP BY user_id")
def exact_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.exact_median(pulses(spark, sf_dir), KEYS, "delay")


@query(
    _with(
        PULSES,
        SIGNS,
        f"n AS (SELECT user_id, pos, sign AS a, lead(sign, 1) {W_USER} AS b, lead(sign, 2) {W_USER} AS c FROM signs)",
        "g AS (SELECT *, pos - lag(pos) OVER (PARTITION BY user_id, a, b, c ORDER BY pos) AS gap FROM n WHERE c IS NOT NULL)",
        "m AS (SELECT user_id, median(gap) AS m FROM g GROUP BY user_id, a, b, c HAVING count(*) >= 5 AND median(gap) > 2)",
    )
    + "SELECT user_id, median(m) AS period FROM m GROUP BY user_id"
)
def period_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.estimated_period(pulses(spark, sf_dir), KEYS, "pos", "delay", 3, 5, 2)


@query(_with(PULSES) + "SELECT user_id, (quantile_cont(delay, 0.1) + quantile_cont(delay, 0.9)) / 2 AS midrange FROM pulses GROUP BY user_id")
def trimmed_midrange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.midrange(pulses(spark, sf_dir), KEYS, "delay", 0.1)


INTERVALS = """parts AS (SELECT user_id, pos // 6 AS part, pos % 3 AS band, min(delay) AS lo, max(delay) AS hi FROM pulses GROUP BY ALL),
clash AS (SELECT *, coalesce(hi >= lead(lo) OVER (PARTITION BY user_id, part ORDER BY band), false) AS clash FROM parts)"""


@query(_with(PULSES, INTERVALS) + "SELECT user_id, part, CASE WHEN NOT bool_or(clash) THEN string_agg(lo || '-' || hi, ',' ORDER BY band) END AS intervals FROM clash GROUP BY user_id, part")
def band_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pulses(spark, sf_dir).withColumn("part", F.floor(F.col("pos") / 6)).withColumn("band", F.col("pos") % 3)
    found = aggregates.band_intervals(rows, ["user_id", "part"], "band", "delay")
    text = F.array_join(F.transform("intervals", lambda x: F.concat_ws("-", x["lo"].cast("string"), x["hi"].cast("string"))), ",")
    return found.select("user_id", "part", F.when(F.col("intervals").isNotNull(), text).alias("intervals"))


@query(_with(PULSES, BANDS) + "SELECT user_id, band, median(delay) AS center, count(*) AS n FROM bands GROUP BY ALL")
def band_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.band_centers(bands(spark, sf_dir), KEYS, "band", "delay")


@query(_with(PULSES, BANDS) + "SELECT user_id, band, round((quantile_cont(delay, 0.1) + quantile_cont(delay, 0.9)) / 2, 6) AS center, count(*) AS n FROM bands GROUP BY ALL")
def band_midranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.band_centers(bands(spark, sf_dir), KEYS, "band", "delay", 0.1).withColumn("center", F.round("center", 6))


@query(_with(PULSES) + "SELECT user_id, count(*) FILTER (k % 10 <> 0) AS n_valid, count(*) FILTER (k % 10 = 0) AS n_invalid, count(*) FILTER (k % 10 <> 0) / count(k) AS fraction FROM pulses GROUP BY user_id")
def valid_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.valid_fraction(pulses(spark, sf_dir).withColumn("ok", F.col("k") % 10 != 0), KEYS, "ok")


@query(_with(PULSES) + "SELECT user_id, min_by(event_id, pos) AS event_id FROM pulses WHERE k % 10 = 0 GROUP BY user_id")
def first_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.first_valid(pulses(spark, sf_dir).withColumn("ok", F.col("k") % 10 == 0), KEYS, "pos", "ok", "event_id")


@query(
    _with(PULSES)
    + """SELECT count(DISTINCT CASE WHEN k % 10 <> 0 THEN user_id * 1000 + k END) AS n_ok, count(DISTINCT user_id * 1000 + k) AS n_keys, count(*) FILTER (k % 10 = 0) AS n_failed,
greatest(count(DISTINCT CASE WHEN k % 10 <> 0 THEN user_id * 1000 + k END), max(CASE WHEN k % 10 <> 0 THEN k END)) AS n_sectors FROM pulses"""
)
def distinct_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.distinct_valid(pulses(spark, sf_dir).withColumn("ok", F.col("k") % 10 != 0), KEYS, "ok", "k")


CDF = "hist AS (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY l_quantity), cdf AS (SELECT l_quantity, CAST(sum(n) OVER (ORDER BY l_quantity) AS BIGINT) AS cum_count, CAST(sum(n * l_quantity) OVER (ORDER BY l_quantity) AS DOUBLE) AS cum_sum FROM hist)"


@query(_with(CDF) + "SELECT l_quantity, cum_count, cum_sum FROM cdf")
def weighted_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.weighted_cdf(table(spark, sf_dir, "lineitem"), [], "l_quantity")


@query("SELECT l_returnflag, median(l_quantity) AS median FROM lineitem GROUP BY l_returnflag")
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.weighted_median(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")


@query(_with(PULSES, BITS) + "SELECT user_id, pos // 8 AS byte_pos, CAST(sum(bit << CAST(7 - pos % 8 AS INT)) AS INT) AS byte, 0 AS err_mask FROM bits GROUP BY user_id, pos // 8 HAVING count(*) = 8")
def bits_to_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.bits_to_bytes(bits(spark, sf_dir), KEYS, "pos", "bit")


@query(_with(PULSES) + "SELECT user_id, CAST(sum(least(abs(delay - 15), abs(delay - 30), abs(delay - 45))) AS DOUBLE) AS residual_sum FROM pulses GROUP BY user_id")
def abs_residual_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.residual_sum(pulses(spark, sf_dir), KEYS, "delay", CENTERS)


# --- clustering -----------------------------------------------------------------------------------------------------------

COSTS = """n AS (SELECT row_number() OVER (ORDER BY l_quantity) AS i, l_quantity AS v, n AS w FROM hist),
pair AS (SELECT a.i AS i, b.i AS j, m.v AS c FROM n a JOIN n b ON a.i <= b.i JOIN n m ON m.i BETWEEN a.i AND b.i),
cost AS (SELECT i, j, min(s) AS s FROM (SELECT p.i, p.j, p.c, sum(x.w * abs(x.v - p.c)) AS s FROM pair p JOIN n x ON x.i BETWEEN p.i AND p.j GROUP BY p.i, p.j, p.c) GROUP BY i, j)"""


@query(_with(CDF.split(", cdf AS")[0], COSTS) + "SELECT CAST(min(a.s + b.s + c.s) AS DOUBLE) AS cost FROM cost a JOIN cost b ON b.i = a.j + 1 JOIN cost c ON c.i = b.j + 1 WHERE a.i = 1 AND c.j = (SELECT max(i) FROM n)")
def kmedian_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.clusters(table(spark, sf_dir, "lineitem"), [], "l_quantity", 3).select("cost")


@query(
    """WITH h AS (SELECT p_brand, p_size AS v, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT unnest(range(0, 13)) AS w),
span AS (SELECT h.p_brand, r.w, h.v, sum(x.n) AS n FROM h CROSS JOIN r JOIN h x ON x.p_brand = h.p_brand AND x.v BETWEEN h.v AND h.v + r.w GROUP BY ALL),
places AS (SELECT p_brand, w, v, n FROM span UNION ALL SELECT DISTINCT p_brand, w, 1000 + 100 * k, 0 FROM span, (VALUES (1), (2), (3)) f(k)),
kept AS (SELECT a.p_brand, a.w, max(a.n + b.n + c.n) AS n FROM places a JOIN places b ON b.p_brand = a.p_brand AND b.w = a.w AND b.v > a.v + a.w JOIN places c ON c.p_brand = a.p_brand AND c.w = a.w AND c.v > b.v + a.w GROUP BY ALL),
total AS (SELECT p_brand, sum(n) AS n FROM h GROUP BY p_brand)
SELECT p_brand, round(min(w / 2.0 + (t.n - k.n) / 1000.0), 6)::DOUBLE AS objective FROM kept k JOIN total t USING (p_brand) GROUP BY p_brand"""
)
def kcenter_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster.clusters(table(spark, sf_dir, "part"), ["p_brand"], "p_size", 3, 6.0)
    return found.select("p_brand", F.round(F.col("cost") + F.col("dropped") / 1000, 6).alias("objective"))


@query(
    """WITH h AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL),
w AS (SELECT p_brand, p_size, sum(n) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN CURRENT ROW AND 8 FOLLOWING) AS n FROM h)
SELECT p_brand, CAST(min(p_size) AS INT) AS start, CAST(any_value(n) AS BIGINT) AS n FROM (SELECT *, max(n) OVER (PARTITION BY p_brand) AS most FROM w) WHERE n = most GROUP BY p_brand"""
)
def densest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.densest_window(table(spark, sf_dir, "part"), ["p_brand"], "p_size", 4)


BAND_ROWS = "rows_ AS (SELECT user_id, band, min(delay) AS lo, max(delay) AS hi, median(delay) AS med FROM bands GROUP BY user_id, band), three AS (SELECT user_id, max(CASE band WHEN 0 THEN lo END) AS l0, max(CASE band WHEN 0 THEN hi END) AS h0, max(CASE band WHEN 0 THEN med END) AS m0, max(CASE band WHEN 1 THEN lo END) AS l1, max(CASE band WHEN 1 THEN hi END) AS h1, max(CASE band WHEN 2 THEN lo END) AS l2, max(CASE band WHEN 2 THEN hi END) AS h2, max(CASE band WHEN 1 THEN med END) AS m1, max(CASE band WHEN 2 THEN med END) AS m2 FROM rows_ GROUP BY user_id HAVING count(*) = 3)"


def _three_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with all three bands: intervals and medians."""
    rows = bands(spark, sf_dir).groupBy("user_id", "band").agg(F.min("delay").alias("lo"), F.max("delay").alias("hi"), F.median("delay").alias("med"))
    both = rows.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("band", "lo", "hi", "med"))).alias("b")).where(F.size("b") == 3)
    return both.select("user_id", F.transform("b", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"))).alias("intervals"), F.transform("b", lambda x: x["med"]).alias("centers"))


@query(_with(PULSES, BANDS, BAND_ROWS, "c AS (SELECT user_id, CAST(greatest(m0, l1 + h0 - h1) AS DOUBLE) AS c0, h0, h1, l1, l2 FROM three)") + "SELECT user_id, c0, l1 + h0 - c0 AS c1, l2 + h1 - (l1 + h0 - c0) AS c2 FROM c")
def interval_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _three_bands(spark, sf_dir).withColumn("c", signal.interval_centers(F.col("intervals"), F.get("centers", F.lit(0))))
    return rows.select("user_id", *[F.get("c", F.lit(i)).alias(f"c{i}") for i in range(3)])


@query(_with(PULSES, BANDS, BAND_ROWS) + "SELECT user_id, 2 * h0 - m0 < m1 AND m1 < 2 * l1 - m0 AND 2 * h1 - m1 < m2 AND m2 < 2 * l2 - m1 AS valid FROM three")
def valid_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _three_bands(spark, sf_dir).select("user_id", signal.valid_centers(F.col("intervals"), F.col("centers")).alias("valid"))


@query(_with(PULSES) + "SELECT user_id, pos, CASE WHEN delay <= 20 THEN '0' WHEN delay < 25 THEN '0,1' WHEN delay <= 35 THEN '1' WHEN delay < 42 THEN '1,2' ELSE '2' END AS bands FROM pulses")
def band_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    intervals = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in ((12, 20), (25, 35), (42, 50))])
    found = signal.bands_of(F.col("delay"), intervals)
    return pulses(spark, sf_dir).select("user_id", "pos", F.array_join(F.transform(found, lambda x: x.cast("string")), ",").alias("bands"))


@query(_with(PULSES) + "SELECT user_id, pos, median(delay) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 150 PRECEDING AND 150 FOLLOWING) AS moving FROM pulses")
def moving_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.moving_median(pulses(spark, sf_dir), KEYS, "pos", "delay", 150).select("user_id", "pos", "moving")


@query(_with(PULSES, NEAREST) + "SELECT user_id, pos, avg(delay - [15.0, 30.0, 45.0][band + 1]) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 27 PRECEDING AND 27 FOLLOWING) AS moving FROM nearest")
def moving_mean_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pulses(spark, sf_dir).withColumn("residual", signal.nearest(F.col("delay"), CENTERS)["residual"])
    return cluster.moving_mean_residual(rows, KEYS, "pos", "residual", 27).select("user_id", "pos", "moving")


@query()
def local_k_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.local_centers(pulses(spark, sf_dir), KEYS, "pos", "delay")


# --- scalar functions -----------------------------------------------------------------------------------------------------

NAME_BYTES = "names AS (SELECT p_partkey, p_name, list_transform(range(0, octet_length(encode(p_name))), lambda i: CAST(('0x' || substring(hex(encode(p_name)), 2 * i + 1, 2)) AS BIGINT)) AS b FROM part)"


@query(
    _with(NAME_BYTES, "distinct_ AS (SELECT DISTINCT p_name, b FROM names)", "crc AS (SELECT p_name, CAST(list_reduce(list_concat([65535], b), lambda a, x: list_reduce(list_concat([xor(a, x << 8)], [1, 1, 1, 1, 1, 1, 1, 1]), lambda c, y: CASE WHEN c & 32768 <> 0 THEN xor(c << 1, 4129) & 65535 ELSE (c << 1) & 65535 END)) AS INT) AS crc FROM distinct_)")
    + "SELECT p_partkey, crc FROM names JOIN crc USING (p_name)"
)
def crc16_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", checksums.crc16(F.col("p_name")).alias("crc"))


@query(_with(NAME_BYTES) + "SELECT p_partkey, list_reduce(list_concat([2166136261], b), lambda h, x: (xor(h, x) * 16777619) % 4294967296) AS fnv FROM names")
def fnv1a_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", checksums.fnv32(F.col("p_name")).alias("fnv"))


@query(_with(NAME_BYTES) + "SELECT p_partkey, list_reduce(list_concat([0], b), lambda h, x: (h * 33 + x) % 4294967296) AS poly FROM names")
def poly_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", checksums.poly_hash(F.col("p_name")).alias("poly"))


@query("SELECT p_partkey, CAST(128 << least(p_size % 9, 6) AS INT) AS length FROM part")
def size_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", signal.sector_size(F.col("p_size") % 9).alias("length"))


@query(
    _with(
        "h AS (SELECT DISTINCT user_id FROM events)",
        "g AS (SELECT user_id, [161, 161, 161, 254, user_id % 80, user_id % 2, user_id % 18 + 1, 2] AS b FROM h)",
    )
    + """SELECT user_id, CAST(user_id % 80 AS INT) AS track, CAST(user_id % 2 AS INT) AS head, CAST(user_id % 18 + 1 AS INT) AS sector, 512 AS datalen,
CAST(list_reduce(list_concat([65535], b), lambda a, x: list_reduce(list_concat([xor(a, x << 8)], [1, 1, 1, 1, 1, 1, 1, 1]), lambda c, y: CASE WHEN c & 32768 <> 0 THEN xor(c << 1, 4129) & 65535 ELSE (c << 1) & 65535 END)) AS INT) AS crc, user_id % 5 <> 0 AS crc_ok FROM g"""
)
def parse_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    raw = header_bytes(F.col("user_id") % 80, F.col("user_id") % 2, F.col("user_id") % 18 + 1, F.lit(2))
    # every fifth has its last byte changed
    crc = checksums.crc16(raw)
    broken = F.when(F.col("user_id") % 5 == 0, crc.bitwiseXOR(F.lit(1))).otherwise(crc)
    rows = users.withColumn("raw", F.concat(raw, F.unhex(F.lpad(F.hex(broken), 4, "0")))).withColumn("h", parsed(F.col("raw")))
    return rows.select("user_id", "h.track", "h.head", "h.sector", "h.datalen", F.when(F.col("h.crc_ok"), F.col("h.crc")).otherwise(F.col("h.crc").bitwiseXOR(F.lit(1))).alias("crc"), "h.crc_ok")


@query(
    _with(HEADERS)
    + """SELECT event_id, CASE WHEN value < 1 THEN 'TRUNCATED' WHEN h IN ('C2C2C2FC', 'C2C2C2FE') THEN 'DECODED_OK' WHEN h LIKE 'A1A1A1%' AND h >= 'A1A1A1F8' THEN
CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 10 <> 0 THEN 'DECODED_OK' ELSE 'DECODED_BAD' END ELSE 'DECODED_UNKNOWN' END AS status FROM headers JOIN events USING (event_id)"""
)
def tri_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _headers(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "value", F.get_json_object("props", "$.k").cast("int").alias("k")), "event_id")
    return rows.select("event_id", signal.decoded_status(signal.mark_type(F.col("header")), F.col("k") % 10 != 0, F.col("value") >= 1).alias("status"))


ENCODED = "enc AS (SELECT user_id, pos, bit, coalesce(lag(bit) OVER (PARTITION BY user_id ORDER BY pos), 1) AS was FROM bits), mfm AS (SELECT user_id, 2 * pos AS bit_pos, CASE WHEN bit = 0 AND was = 0 THEN 1 ELSE 0 END AS bit FROM enc UNION ALL SELECT user_id, 2 * pos + 1, bit FROM enc)"


@query(_with(PULSES, BITS, ENCODED) + "SELECT user_id, bit_pos, CAST(bit AS INT) AS bit FROM mfm")
def mfm_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.mfm_encode(bits(spark, sf_dir), KEYS, "pos", "bit")


@query(
    _with(
        PULSES,
        BITS,
        "two AS (SELECT user_id, pos // 2 AS bit_pos, max(CASE WHEN pos % 2 = 0 THEN bit END) AS c, max(CASE WHEN pos % 2 = 1 THEN bit END) AS d FROM bits GROUP BY user_id, pos // 2 HAVING count(*) = 2)",
        "l AS (SELECT *, lag(d) OVER (PARTITION BY user_id ORDER BY bit_pos) AS was FROM two)",
    )
    + "SELECT user_id, bit_pos, CASE WHEN c + d < 2 THEN CAST(d AS INT) END AS bit, CASE WHEN was IS NULL OR c + d = 2 THEN 0 WHEN d = 1 THEN c WHEN was = 0 THEN 1 - c ELSE c END AS error FROM l"
)
def mfm_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.mfm_decode(bits(spark, sf_dir), KEYS, "pos", "bit")


@query("SELECT a.vec_id, round(pow(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: pow(abs(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)), 3))), 1.0 / 3), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def lp_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(after, "vec_id").select("vec_id", F.round(signal.lp_distance(F.col("embedding"), F.col("other"), 3), 6).alias("distance"))


@query("SELECT a.vec_id, CAST(floor(pow(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: pow(floor(abs(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * 1000), 2))), 0.5) + 1e-9) AS BIGINT) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def lp_distance_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(after, "vec_id").select("vec_id", signal.lp_distance_fixed(F.col("embedding"), F.col("other"), 2).alias("distance"))


# --- recurrences ----------------------------------------------------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id and delays in order."""
    rows = pulses(spark, sf_dir).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("pos", "delay"))).alias("p"))
    return rows.select("user_id", F.transform("p", lambda x: x["delay"]).alias("delays"))


LISTS = "lists AS (SELECT user_id, list(delay ORDER BY pos) AS d FROM pulses GROUP BY user_id)"


def _tracking(start: str, alpha: str) -> str:
    """DuckDB fold of the phase-locked loop over `d`: half clock, sum of zeroes, counted, squared errors."""
    h = "round(x.half_in / s.half)"
    moved = f"greatest({start} * 0.75, least({start} * 2.25, s.half * (1 - {alpha}) + x.half_in / greatest({h}, 1) * {alpha}))"
    return f"""list_reduce(list_concat([{{'half': CAST({start} AS DOUBLE), 'z': 0.0::DOUBLE, 'n': 0.0::DOUBLE, 'sq': 0.0::DOUBLE, 'half_in': 0.0::DOUBLE}}],
  list_transform(d, lambda v: {{'half': 0.0::DOUBLE, 'z': 0.0::DOUBLE, 'n': 0.0::DOUBLE, 'sq': 0.0::DOUBLE, 'half_in': CAST(v AS DOUBLE)}})),
  lambda s, x: CASE WHEN {h} BETWEEN 1 AND 4 THEN {{'half': {moved}, 'z': s.z + {h} - 1, 'n': s.n + 1, 'sq': s.sq + pow(x.half_in - {h} * s.half, 2), 'half_in': 0.0::DOUBLE}} ELSE s END)"""


@query(_with(PULSES, LISTS, f"t AS (SELECT user_id, {_tracking('12.0', '0.1')} AS t FROM lists)") + "SELECT user_id, CAST(t.z AS BIGINT) AS n_zeroes, CAST(t.n AS INT) AS n, round(t.half, 6) AS half FROM t")
def pll_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).withColumn("t", folds.tracked(F.col("delays"), CLOCK / 2, 0.1))
    return rows.select("user_id", F.col("t.n_zeroes").alias("n_zeroes"), F.col("t.n").alias("n"), F.round("t.half", 6).alias("half"))


@query(
    _with(
        PULSES,
        LISTS,
        f"""t AS (SELECT user_id, list_reduce(list_concat([{{'b': 0.0::DOUBLE, 'd': 0.0::DOUBLE}}], list_transform(d, lambda v: {{'b': 0.0::DOUBLE, 'd': CAST(v AS DOUBLE)}})),
  lambda s, x: {{'b': s.b * 0.9 + (x.d - round(trunc(x.d - s.b) * 2.0 / {CLOCK}) * {CLOCK / 2}) * 0.1, 'd': 0.0::DOUBLE}}) AS t FROM lists)""",
    )
    + "SELECT user_id, round(t.b, 6) AS bias FROM t"
)
def ewma_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("user_id", F.round(folds.biased(F.col("delays"), CLOCK, 0.1)["bias"], 6).alias("bias"))


def _viterbi_sql() -> str:
    """Four costs and four errors carried along."""
    e = [f"(x.d - {CLOCK} * {p} / 2)" for p in (2, 3, 4, 5)]
    cost = [f"CASE WHEN s.first THEN 0.0 ELSE least({', '.join(f's.c{q} + pow({e[p]} - s.e{q}, 2)' for q in range(4))}) + pow(0.01 * {e[p]}, 2) END" for p in range(4)]
    fields = lambda c, x: ", ".join([f"'c{i}': CAST({c[i]} AS DOUBLE)" for i in range(4)] + [f"'e{i}': CAST({x[i]} AS DOUBLE)" for i in range(4)])
    zero = ["0.0"] * 4
    start = f"{{{fields(zero, zero)}, 'first': true, 'd': 0.0::DOUBLE}}"
    each = f"list_transform(d, lambda v: {{{fields(zero, zero)}, 'first': false, 'd': CAST(v AS DOUBLE)}})"
    return f"list_reduce(list_concat([{start}], {each}), lambda s, x: {{{fields(cost, e)}, 'first': false, 'd': 0.0::DOUBLE}})"


@query(_with(PULSES, LISTS, f"t AS (SELECT user_id, {_viterbi_sql()} AS t FROM lists)") + "SELECT user_id, round(sqrt(least(t.c0, t.c1, t.c2, t.c3)), 6) AS cost FROM t")
def viterbi_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("user_id", F.round(folds.smoothest_cost(F.col("delays"), CLOCK), 6).alias("cost"))


# --- merging and iteration ------------------------------------------------------------------------------------------------


@query(_with(PULSES) + "SELECT user_id, k, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY src, pos) AS r FROM (SELECT *, 0 AS src FROM pulses WHERE event_type = 'click' UNION ALL SELECT *, 1 FROM pulses WHERE event_type = 'view')) WHERE r = 1")
def union_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pulses(spark, sf_dir).select("user_id", "k", "pos", "event_id", "event_type")
    parts = [rows.where(F.col("event_type") == t).drop("event_type") for t in ("click", "view")]
    return merge.first_wins(parts, ["user_id", "k"], ["pos"]).select("user_id", "k", "event_id")


@query(_with(PULSES) + "SELECT user_id, k, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY pos) AS r FROM pulses WHERE event_type = 'purchase') WHERE r = 1")
def first_ok_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pulses(spark, sf_dir).select("user_id", "k", "pos", "event_id", "event_type")
    return merge.first_valid_per_key(rows, ["user_id", "k"], F.col("event_type") == "purchase", ["pos"]).select("user_id", "k", "event_id")


UPSERT = "o AS (SELECT user_id, k, min(event_id) AS event_id, bool_or(raw % 2 = 0) AS ok FROM pulses WHERE event_type = 'error' GROUP BY ALL), w AS (SELECT user_id, k, min(event_id) AS event_id, true AS ok FROM pulses WHERE event_type = 'view' GROUP BY ALL)"


@query(
    _with(PULSES, UPSERT)
    + "SELECT coalesce(o.user_id, w.user_id) AS user_id, coalesce(o.k, w.k) AS k, CASE WHEN o.user_id IS NULL THEN w.event_id WHEN w.user_id IS NULL OR o.ok THEN o.event_id ELSE w.event_id END AS event_id, CASE WHEN o.user_id IS NULL THEN true WHEN w.user_id IS NULL OR o.ok THEN o.ok ELSE true END AS ok FROM o FULL JOIN w ON o.user_id = w.user_id AND o.k = w.k"
)
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pulses(spark, sf_dir)
    old = rows.where("event_type = 'error'").groupBy("user_id", "k").agg(F.min("event_id").alias("event_id"), F.bool_or(F.col("raw") % 2 == 0).alias("ok"))
    new = rows.where("event_type = 'view'").groupBy("user_id", "k").agg(F.min("event_id").alias("event_id"), F.lit(True).alias("ok"))
    return merge.upsert(old, new, ["user_id", "k"], "ok")


ALPHAS = (0.05, 0.1, 0.2, 0.4)


@query(
    _with(PULSES, LISTS, "sweep AS (" + " UNION ALL ".join(f"SELECT user_id, {a} AS alpha, {_tracking('12.0', str(a))} AS t FROM lists" for a in ALPHAS) + ")", "e AS (SELECT user_id, alpha, round(sqrt(t.sq / t.n), 6) AS rmse FROM sweep)")
    + "SELECT user_id, CAST(alpha AS DOUBLE) AS alpha, rmse FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rmse, alpha) AS r FROM e) WHERE r = 1"
)
def best_of_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    alphas = spark.createDataFrame([(a,) for a in ALPHAS], "alpha double")
    tries = _records(spark, sf_dir).crossJoin(F.broadcast(alphas)).withColumn("t", folds.tracked(F.col("delays"), CLOCK / 2, F.col("alpha")))
    rated = tries.select("user_id", "alpha", F.round(F.sqrt(F.col("t.squares") / F.col("t.n")), 6).alias("rmse"))
    return merge.best_of(rated, KEYS, ["rmse", "alpha"]).select("user_id", "alpha", "rmse")


# --- loops and streams: state along a record ---------------------------------------------------------------------------------


MATERIAL = PULSES.replace("pulses AS (", "pulses AS MATERIALIZED (", 1)


def _scaled_band(value: str, scale: str, out: tuple = (0, 1, 2)) -> str:
    """One of three by the nearest of the centers times a scale."""
    far = [f"abs({value} - {scale} * {c}::DOUBLE)" for c in CENTERS]
    return f"(CASE WHEN {far[0]} <= {far[1]} AND {far[0]} <= {far[2]} THEN {out[0]} WHEN {far[1]} <= {far[2]} THEN {out[1]} ELSE {out[2]} END)"


def _excess(value: str, scale: str) -> str:
    return f"({value} / ({scale} * {_scaled_band(value, scale, tuple(f'{c}::DOUBLE' for c in CENTERS))}) - 1)"


def _loop_sql(state: str, start: str, step: str, seen: str) -> str:
    """A recursion along each record: columns beside the scale `s`, their start and step, and the place whose scale gives a value its band."""
    columns = f", {state}" if state else ""
    return f"""WITH RECURSIVE {MATERIAL}, lists AS MATERIALIZED (SELECT user_id, list(CAST(delay AS DOUBLE) ORDER BY pos) AS v, count(*) AS n FROM pulses GROUP BY user_id),
walk(user_id, i, s{columns}) AS (SELECT user_id, CAST(-1 AS BIGINT), 1.0::DOUBLE{start} FROM lists UNION ALL SELECT w.user_id, w.i + 1, {step} FROM walk w JOIN lists l ON l.user_id = w.user_id WHERE w.i + 1 < l.n)
SELECT p.user_id, p.pos, p.delay, CAST({_scaled_band('p.delay', 'w.s')} AS INT) AS band FROM pulses p JOIN lists l ON l.user_id = p.user_id JOIN walk w ON w.user_id = p.user_id AND w.i = {seen}"""


@query(_loop_sql("", "", f"w.s * (1 + 0.05::DOUBLE * {_excess('l.v[w.i + 2]', 'w.s')})", f"least(p.pos + {loops.delay_of(0.05)}, l.n - 1)"))
def lagged_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loops.follow(pulses(spark, sf_dir), KEYS, "pos", "delay", loops.lagged, centers=CENTERS)


@query(_loop_sql("", "", f"w.s * (1 + 0.05::DOUBLE * list_median(list_transform(l.v[greatest(w.i - 13, 1):w.i + 16], lambda x: {_excess('x', 'w.s')})))", "p.pos"))
def neighbourhood_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loops.follow(pulses(spark, sf_dir), KEYS, "pos", "delay", loops.neighbourhood, centers=CENTERS)


@query(
    _loop_sql(
        "e",
        f", list_transform(v[1:27], lambda x: {_excess('x', '1.0::DOUBLE')})",
        f"""w.s * (1 + 0.005::DOUBLE * (list_sum(w.e[greatest(w.i - 25, 1):]) + CASE WHEN w.i + 28 < l.n THEN {_excess('l.v[w.i + 29]', 'w.s')} ELSE 0 END) / (least(l.n, w.i + 29) - greatest(w.i - 26, 0))),
  CASE WHEN w.i + 28 < l.n THEN list_append(w.e, {_excess('l.v[w.i + 29]', 'w.s')}) ELSE w.e END""",
        "p.pos",
    )
)
def centred_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loops.follow(pulses(spark, sf_dir), KEYS, "pos", "delay", loops.centred, centers=CENTERS)


@query(
    """WITH RECURSIVE ticks AS MATERIALIZED (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CAST(floor(value * 100) AS BIGINT) % 200 + 60 AS n FROM events),
steps AS MATERIALIZED (SELECT *, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY i) AS BIGINT) AS tick FROM ticks),
loop(user_id, i, d, skip, kind) AS (SELECT user_id, CAST(0 AS BIGINT), CAST(100 AS BIGINT), 1, 0 FROM steps WHERE i = 0
  UNION ALL SELECT user_id, i, greatest(d - d // 8, least(d + d // 8, CASE kind WHEN 2 THEN d - CAST(floor((d - n) / 2) AS BIGINT) WHEN 3 THEN d - CAST(floor((d - 2 * n // 4 - 2 * n // 8 + 2 * n // 32) / 2) AS BIGINT) WHEN 4 THEN d - CAST(floor((d - n // 2) / 2) AS BIGINT) ELSE d END)),
    CASE WHEN skip > 0 THEN skip - 1 WHEN n >= 3 * d THEN 5 ELSE 0 END, kind
  FROM (SELECT l.user_id, t.i, l.d, l.skip, t.n, CASE WHEN l.skip > 0 OR t.n < l.d // 4 THEN 0 WHEN t.n < l.d + l.d // 4 THEN 2 WHEN t.n < 2 * l.d - l.d // 4 THEN 3 WHEN t.n < 3 * l.d THEN 4 ELSE 0 END AS kind FROM loop l JOIN steps t ON t.user_id = l.user_id AND t.i = l.i + 1))
SELECT user_id AS drive, tick, CASE WHEN i = 0 THEN 0 ELSE n END AS length, kind FROM loop JOIN steps USING (user_id, i)"""
)
def online_pulse_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return online.pulse_types(online.as_pulses(table(spark, sf_dir, "events")))


@query(
    f"""WITH RECURSIVE orders AS MATERIALIZED (SELECT user_id, epoch_us(ts) * 50 AS tick, CASE event_type WHEN 'click' THEN 'motor' WHEN 'view' THEN 'seek' WHEN 'purchase' THEN 'read' WHEN 'signup' THEN 'done' WHEN 'error' THEN 'cancel' END AS command FROM events),
steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tick, command) AS i FROM orders),
go(user_id, i, last, motor, began, late) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false, CAST(NULL AS BIGINT), false FROM steps
  UNION ALL SELECT user_id, i, tick, motor OR command IN ('motor', 'seek', 'read'), CASE WHEN command = 'read' THEN tick WHEN command IN ('done', 'cancel') THEN NULL ELSE began END, late
  FROM (SELECT user_id, i, tick, command, late, CASE WHEN NOT late THEN began END AS began, motor AND NOT ((began IS NULL OR late) AND last IS NOT NULL AND tick - last > {online.IDLE_TICKS}) AS motor
    FROM (SELECT t.user_id, t.i, t.tick, t.command, g.last, g.motor, g.began, coalesce(t.tick - g.began > {online.READ_TICKS}, false) AS late FROM go g JOIN steps t ON t.user_id = g.user_id AND t.i = g.i + 1)))
SELECT user_id AS drive, tick, motor, began IS NOT NULL AS reading, late AS timed_out FROM go JOIN steps USING (user_id, i)"""
)
def online_drive_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    command = F.element_at(F.create_map(*[F.lit(x) for x in ("click", "motor", "view", "seek", "purchase", "read", "signup", "done", "error", "cancel")]), F.col("event_type"))
    rows = table(spark, sf_dir, "events")
    return online.drive_states(rows.select(F.col("user_id").alias("drive"), (F.unix_micros(F.col("ts").cast("timestamp")) * 50).alias("tick"), command.alias("command")))


NEAR_NEEDLE = "blue bolt"


@query(
    f"""WITH RECURSIVE names AS (SELECT DISTINCT p_name FROM part),
st(p_name, a, i, j, s, n, d) AS (SELECT p_name, CAST(unnest(range(0, length(p_name) + 1)) AS INT) AS a, 0, a, 0, 0, 0 FROM names
  UNION SELECT p_name, a, i + di, j + dj, s + ds, n + dn, d + dd FROM st, (VALUES (0, 1, 1, 0, 0, 0), (1, 1, 1, 1, 0, 0), (2, 0, 1, 0, 1, 0), (3, 1, 0, 0, 0, 1)) x(kind, di, dj, ds, dn, dd)
  WHERE i < {len(NEAR_NEEDLE)} AND (kind = 3 OR j < length(p_name)) AND s + ds <= 2 AND n + dn <= 1 AND d + dd <= 1
    AND (kind = 0) = (j < length(p_name) AND substring(p_name, j + 1, 1) = substring('{NEAR_NEEDLE}', i + 1, 1))),
best AS (SELECT p_name, j AS e, min(s + n + d) AS edits FROM st WHERE i = {len(NEAR_NEEDLE)} AND j > a GROUP BY ALL),
firsts AS (SELECT b.p_name, b.e, b.edits, min(a) AS a FROM best b JOIN st ON st.p_name = b.p_name AND st.j = b.e AND st.i = {len(NEAR_NEEDLE)} AND s + n + d = b.edits AND st.j > st.a GROUP BY ALL)
SELECT p_partkey, a AS start, e AS "end", CAST(edits AS INT) AS edits FROM part JOIN firsts USING (p_name)"""
)
def near_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.near_matches(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", NEAR_NEEDLE, 2, 1, 1)


RISES = f"""rises AS (SELECT user_id, pos, delay, lag(delay) {W_USER} AS before, lead(delay, 1) {W_USER} AS b, lead(delay, 2) {W_USER} AS c FROM pulses)"""


@query(
    _with(PULSES, RISES, "s AS (SELECT user_id, pos - 1 AS start, before AS x0, delay AS x1, b AS x2, c AS x3 FROM rises WHERE b > delay AND c <= b AND before IS NOT NULL)")
    + "SELECT user_id, start, 0 AS needle_id, CAST(least(x0, x1, x3) AS DOUBLE) AS lo0, CAST(greatest(x0, x1, x3) AS DOUBLE) AS hi0, CAST(x2 AS DOUBLE) AS center1 FROM s WHERE greatest(x0, x1, x3) < x2"
)
def band_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands 0 0 1 0: the first change is a rise from the second value on."""
    found = search.band_matches(pulses(spark, sf_dir), KEYS, "pos", "delay", {0: (0, 0, 1, 0)})
    return found.select("user_id", "start", "needle_id", F.col("intervals")[0]["lo"].alias("lo0"), F.col("intervals")[0]["hi"].alias("hi0"), F.col("centers")[1].alias("center1"))
