"""The registered queries over the driver's tables, each with its equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import SMALL
from tidewatch.functions import kernels, lsh
from tidewatch.operators import alerts, density, diagnose, eh, episodes, evaluate, features, quality, scoring
from tidewatch.plans import dashboards, memory, series, serving
from tidewatch.sources import readings as src
from tidewatch.sources import sinks
from tidewatch.streaming import monitor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CHANNELS = ["ch_value", "ch_k"]
FLAGS = ["flag_high", "flag_odd"]
LIMITS = {"ch_value": (0.0, 400.0), "ch_k": (0.0, 95.0)}
GAP, EPISODE_GAP, ALERTING, HORIZON = 3600.0, 6 * 3600.0, 0.05, 24.0
DIM, ROWS, K, WINDOW, EVERY = 64, 6, 3, 64, 5

# ---- SQL of the shared inputs

READINGS = """
r AS (SELECT event_type AS asset_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS BIGINT) AS seq, ts,
  value AS ch_value, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS ch_k,
  CAST(CASE WHEN value > 100 THEN 1 ELSE 0 END AS DOUBLE) AS flag_high,
  CAST(CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 1 THEN 1 ELSE 0 END AS DOUBLE) AS flag_odd
  FROM events)"""
FAULTY = (
    READINGS
    + """,
f AS (SELECT asset_id, seq,
  CASE WHEN seq % 89 = 0 THEN lag(ts) OVER w WHEN seq % 83 = 0 THEN lag(ts) OVER w - INTERVAL 60 SECOND WHEN seq % 79 = 0 THEN NULL ELSE ts END AS ts,
  CASE WHEN seq % 97 = 0 THEN NULL WHEN seq % 53 = 0 THEN -ch_value ELSE ch_value END AS ch_value,
  CASE WHEN seq % 101 = 0 THEN NULL ELSE ch_k END AS ch_k, flag_high, flag_odd
  FROM r WINDOW w AS (PARTITION BY asset_id ORDER BY seq)),
c0 AS (SELECT *, (epoch_us(ts) - epoch_us(last_value(ts IGNORE NULLS) OVER (PARTITION BY asset_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) / 1e6 AS delta FROM f),
c AS (SELECT *, concat_ws(',', CASE WHEN ch_value IS NULL THEN 'ch_value' END, CASE WHEN ch_k IS NULL THEN 'ch_k' END) AS missing_fields,
  concat_ws(',', CASE WHEN ch_value NOT BETWEEN 0 AND 400 THEN 'ch_value' END, CASE WHEN ch_k NOT BETWEEN 0 AND 95 THEN 'ch_k' END) AS out_of_range,
  coalesce(delta < 0, false) AS regression, coalesce(delta = 0, false) AS duplicate, CASE WHEN delta > 3600 THEN delta ELSE 0.0 END AS gap_seconds,
  ch_value IS NOT NULL AND ch_k IS NOT NULL AS usable FROM c0),
o AS (SELECT *, sum(CASE WHEN usable THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS usable_rank FROM c)"""
)
FAILURES = (
    """
w AS (SELECT idx, name, CAST(s AS TIMESTAMP) AS f_start, CAST(e AS TIMESTAMP) AS f_end, CAST(s AS TIMESTAMP) - INTERVAL 24 HOUR AS horizon_start FROM (VALUES """
    + ", ".join(f"({i}, '{n}', '{s}', '{e}')" for i, (n, s, e) in enumerate(src.EVENTS))
    + ") v(idx, name, s, e))"
)
SCORED = (
    READINGS
    + """,
t AS (SELECT asset_id, quantile_cont(ch_value, 0.95) AS threshold FROM r GROUP BY 1),
s AS (SELECT r.asset_id, seq, ts, ch_value AS score, threshold FROM r JOIN t USING (asset_id))"""
)
SESSIONS = """,
a AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY asset_id ORDER BY ts, seq)) <= 21600000000 THEN 0 ELSE 1 END AS first FROM s WHERE score > threshold),
b AS (SELECT *, sum(first) OVER (PARTITION BY asset_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS episode FROM a),
ep AS (SELECT asset_id, CAST(episode AS BIGINT) AS episode, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n, max(score) AS peak_score, max(threshold) AS threshold FROM b GROUP BY 1, 2)"""
SPANS = """,
sp AS (SELECT asset_id, min(ts) AS span_start, max(ts) AS span_end FROM r GROUP BY 1)"""
MATCHED = """,
m AS (SELECT ep.*, (SELECT min(idx) FROM w WHERE ep.started_at BETWEEN w.horizon_start AND w.f_end) AS idx FROM ep)"""
VECTORS = """
v AS (SELECT CAST(label AS BIGINT) AS asset_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS BIGINT) AS clock, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(c: str) -> F.Column:
    return F.round(F.col(c), 6).alias(c)


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check(src.faulty_readings(spark, sf_dir), CHANNELS, LIMITS, GAP)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value itself as a score, with each asset's threshold."""
    series = src.readings(spark, sf_dir).select("asset_id", "seq", "ts", F.col("ch_value").alias("score"))
    return series.join(episodes.thresholds(series, ALERTING), "asset_id")


def angular_bank() -> lsh.Angular:
    return lsh.Angular(ROWS, K, DIM, np.random.default_rng(0))


def pstable_bank() -> lsh.PStable:
    return lsh.PStable(ROWS, K, DIM, 2.0, 1 << 20, np.random.default_rng(0))


def codes_sql(bank: lsh.Angular | lsh.PStable) -> str:
    return " UNION ALL ".join(f"SELECT asset_id, clock, {i} AS row, CAST({lsh.code_sql(bank, i, 'x', 'list_inner_product({a}, {b})')} AS BIGINT) AS code FROM v" for i in range(bank.rows))


# ---- sources and projections


@query("scan_project_readings", f"WITH {READINGS} SELECT * FROM r")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.readings(spark, sf_dir)


@query("json_extract_features", f"WITH {READINGS} SELECT asset_id, seq, ch_k, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM r")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    wire = sinks.wire_records(src.readings(spark, sf_dir).withColumn("ts", F.col("ts")), ["asset_id", "seq", "ch_k"])
    back = src.decode_json(wire, ["ch_k"])
    return back.filter("decoded").select(
        F.get_json_object("value", "$.asset_id").alias("asset_id"), F.get_json_object("value", "$.seq").cast("long").alias("seq"),
        F.col("vector")[0].alias("ch_k"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
    )


@query("try_cast_missing", f"WITH {FAULTY} SELECT asset_id, seq, coalesce(ch_value, -1.0) AS v0, coalesce(ch_k, -1.0) AS v1 FROM f")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = src.faulty_readings(spark, sf_dir).select("asset_id", "seq", features.vector(CHANNELS).alias("v"))
    return df.select("asset_id", "seq", *(F.when(F.isnan(F.col("v")[i]), -1.0).otherwise(F.col("v")[i]).alias(f"v{i}") for i in (0, 1)))


@query("finite_filter", f"WITH {FAULTY} SELECT asset_id, count(*) AS n FROM f WHERE ch_value IS NOT NULL AND ch_k IS NOT NULL GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = src.faulty_readings(spark, sf_dir).withColumn("v", features.vector(CHANNELS))
    return df.filter(features.is_finite("v")).groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"))


@query("injected_fault", f"WITH {READINGS} SELECT asset_id, seq, CASE WHEN seq BETWEEN 50 AND 79 THEN ch_value * 3.0 ELSE ch_value END AS ch_value, seq BETWEEN 50 AND 79 AS injected FROM r")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.inject(src.readings(spark, sf_dir), ["ch_value"], 50, 30).select("asset_id", "seq", "ch_value", "injected")


# ---- quality


@query("clean_usable_flags", f"WITH {FAULTY} SELECT asset_id, seq, missing_fields, out_of_range, usable, usable AND out_of_range = '' AND NOT regression AND NOT duplicate AS clean FROM c")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).select("asset_id", "seq", F.array_join("missing_fields", ",").alias("missing_fields"), F.array_join("out_of_range", ",").alias("out_of_range"), "usable", "clean")


@query("prev_timestamp_quality", f"WITH {FAULTY} SELECT asset_id, seq, regression, duplicate, gap_seconds FROM c")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).select("asset_id", "seq", "regression", "duplicate", "gap_seconds")


@query(
    "quality_counts_by_kind",
    f"""WITH {FAULTY}, k AS (
SELECT asset_id, 'missing_field' AS kind, (ch_value IS NULL)::INT + (ch_k IS NULL)::INT AS n FROM c UNION ALL
SELECT asset_id, 'out_of_range', coalesce((ch_value NOT BETWEEN 0 AND 400)::INT, 0) + coalesce((ch_k NOT BETWEEN 0 AND 95)::INT, 0) FROM c UNION ALL
SELECT asset_id, 'timestamp_regression', regression::INT FROM c UNION ALL SELECT asset_id, 'duplicate_timestamp', duplicate::INT FROM c UNION ALL
SELECT asset_id, 'gap', (gap_seconds > 0)::INT FROM c) SELECT asset_id, kind, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1, 2 HAVING sum(n) > 0""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.issues(checked(spark, sf_dir))


OUTCOME = "CASE WHEN NOT usable THEN 'dropped' WHEN usable_rank < 200 THEN 'warmup' ELSE 'accepted' END"


@query("record_outcomes", f"WITH {FAULTY} SELECT asset_id, {OUTCOME} AS outcome, count(*) AS n FROM o GROUP BY 1, 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.count_outcomes(quality.outcomes(checked(spark, sf_dir), SMALL.warmup))


@query("logical_clock", f"WITH {FAULTY} SELECT asset_id, seq, CAST(usable_rank - 199 AS BIGINT) AS clock FROM o WHERE usable AND usable_rank >= 200")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.outcomes(checked(spark, sf_dir), SMALL.warmup).filter("clock is not null").select("asset_id", "seq", "clock")


# ---- features

STATS = """, st AS (SELECT asset_id, avg(ch_value) AS m0, stddev_pop(ch_value) AS d0, avg(ch_k) AS m1, stddev_pop(ch_k) AS d1 FROM o WHERE usable AND usable_rank <= 200 GROUP BY 1 HAVING count(*) >= 200)"""


@query(
    "warmup_stats",
    f"""WITH {FAULTY}{STATS} SELECT asset_id, 'ch_value' AS channel, round(m0, 6) AS mean, round(CASE WHEN d0 < 1e-9 THEN 1.0 ELSE d0 END, 6) AS scale FROM st
UNION ALL SELECT asset_id, 'ch_k', round(m1, 6), round(CASE WHEN d1 < 1e-9 THEN 1.0 ELSE d1 END, 6) FROM st""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.outcomes(checked(spark, sf_dir), SMALL.warmup)
    return features.warmup_stats(rows, CHANNELS, SMALL.warmup).select("asset_id", "channel", r6("mean"), r6("scale"))


@query("standardized_readings", f"WITH {FAULTY}{STATS} SELECT o.asset_id, seq, round((ch_value - m0) / d0, 6) AS z_ch_value, round((ch_k - m1) / d1, 6) AS z_ch_k FROM o JOIN st USING (asset_id) WHERE usable AND usable_rank >= 200")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.outcomes(checked(spark, sf_dir), SMALL.warmup)
    stats = features.warmup_stats(rows, CHANNELS, SMALL.warmup)
    return features.standardize(rows.filter("clock is not null"), stats, CHANNELS).select("asset_id", "seq", r6("z_ch_value"), r6("z_ch_k"))


@query("duty_cycle_rolling", f"WITH {READINGS} SELECT asset_id, seq, round(avg(flag_high) OVER w, 6) AS duty_flag_high, round(avg(flag_odd) OVER w, 6) AS duty_flag_odd FROM r WINDOW w AS (PARTITION BY asset_id ORDER BY seq ROWS 359 PRECEDING)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.duty_cycles(src.readings(spark, sf_dir), FLAGS).select("asset_id", "seq", r6("duty_flag_high"), r6("duty_flag_odd"))


# ---- hashes and densities


@query("simhash_codes", f"WITH {VECTORS} {codes_sql(angular_bank())}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.cells(src.vectors(spark, sf_dir), angular_bank())


@query("pstable_codes", f"WITH {VECTORS} {codes_sql(pstable_bank())}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.cells(src.vectors(spark, sf_dir), pstable_bank())


CELLS = f"WITH {VECTORS}, ce AS ({codes_sql(angular_bank())}), n AS (SELECT *, count(*) OVER (PARTITION BY asset_id, row, code ORDER BY clock RANGE BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS n FROM ce)"


@query("cell_window_count", f"{CELLS} SELECT asset_id, clock, row, code, n FROM n")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.windowed_counts(density.cells(src.vectors(spark, sf_dir), angular_bank()), WINDOW)


@query("density_exact_cells", f"{CELLS} SELECT asset_id, clock, round(sum(n) / {ROWS}, 6) AS density FROM n WHERE clock % {EVERY} = 0 GROUP BY 1, 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.exact_density(src.vectors(spark, sf_dir), angular_bank(), WINDOW, EVERY).select("asset_id", "clock", r6("density"))


P_CELLS = CELLS.replace(codes_sql(angular_bank()), codes_sql(pstable_bank()))


@query("density_euclidean_sketch", f"{P_CELLS} SELECT asset_id, clock, round(sum(n) / {ROWS}, 6) AS density FROM n WHERE clock % {EVERY} = 0 GROUP BY 1, 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.blocked_density(src.vectors(spark, sf_dir), pstable_bank(), WINDOW, EVERY, row_block=4).select("asset_id", "clock", r6("density"))


@query("density_exact_blocked", f"{CELLS} SELECT asset_id, clock, round(sum(n) / {ROWS}, 6) AS density FROM n WHERE clock % {EVERY} = 0 GROUP BY 1, 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.blocked_density(src.vectors(spark, sf_dir), angular_bank(), WINDOW, EVERY, row_block=4).select("asset_id", "clock", r6("density"))


@query(
    "race_unwindowed",
    f"""{CELLS}, u AS (SELECT asset_id, clock, row // 5 AS chunk, count(*) OVER (PARTITION BY asset_id, row, code ORDER BY clock) AS n FROM ce),
m AS (SELECT asset_id, clock, chunk, avg(n) AS mean FROM u GROUP BY 1, 2, 3) SELECT asset_id, clock, round(median(mean), 6) AS density FROM m GROUP BY 1, 2""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.unwindowed(src.vectors(spark, sf_dir), angular_bank()).select("asset_id", "clock", r6("density"))


@query("live_cells", f"{CELLS} SELECT asset_id, count(DISTINCT (row, code)) AS cells FROM ce JOIN (SELECT asset_id, max(clock) AS last FROM v GROUP BY 1) USING (asset_id) WHERE clock > last - {WINDOW} GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.live_cells(src.vectors(spark, sf_dir), angular_bank(), WINDOW)


COLLISION = "tb AS (SELECT [" + ", ".join(map(repr, kernels.TABLE.tolist())) + "]::DOUBLE[] AS t)"


def collision_sql(distance: str, width: float) -> str:
    """The tabulated chance of `distance`, linear between entries; t is the table."""
    at = f"least(greatest({distance} / {width}, 0.0), 60.0) * {(len(kernels.TABLE) - 1) / 60.0!r}"
    low = f"CAST(least(floor({at}), {len(kernels.TABLE) - 2}) AS BIGINT)"
    return f"(t[{low} + 1] + ({at} - {low}) * (t[{low} + 2] - t[{low} + 1]))"


COSINE = "greatest(-1.0, least(1.0, list_inner_product(q.x, p.x) / (greatest(sqrt(list_inner_product(q.x, q.x)), 1e-12) * greatest(sqrt(list_inner_product(p.x, p.x)), 1e-12))))"


@query(
    "exact_windowed_kde_angular",
    f"""WITH {VECTORS} SELECT q.asset_id, q.clock, round(sum(pow(1 - acos({COSINE}) / pi(), {K})), 6) AS density FROM v q JOIN v p
ON p.asset_id = q.asset_id AND p.clock <= q.clock AND p.clock > q.clock - {WINDOW} WHERE q.clock % {EVERY} = 0 GROUP BY 1, 2""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.exact_angular(src.vectors(spark, sf_dir), WINDOW, K, EVERY).select("asset_id", "clock", r6("density"))


@query(
    "exact_windowed_kde_l2",
    f"""WITH {VECTORS}, {COLLISION}, d AS (SELECT q.asset_id, q.clock, list_distance(q.x, p.x) AS d FROM v q JOIN v p ON p.asset_id = q.asset_id AND p.clock <= q.clock AND p.clock > q.clock - {WINDOW} WHERE q.clock % {EVERY} = 0)
SELECT asset_id, clock, round(sum(pow({collision_sql("d", 2.0)}, {K})), 6) AS density FROM d, tb GROUP BY 1, 2""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.exact_euclidean(src.vectors(spark, sf_dir), WINDOW, K, 2.0, EVERY).select("asset_id", "clock", r6("density"))


@query(
    "brute_force_kde",
    f"""WITH {VECTORS} SELECT q.asset_id, q.clock, round(sum(pow(1 - acos({COSINE}) / pi(), {K})), 6) AS density FROM v q JOIN v p ON p.asset_id = q.asset_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = src.vectors(spark, sf_dir)
    return density.brute_force(v.filter("vec_id % 50 = 0").select("asset_id", "clock", "x"), v, K).select("asset_id", "clock", r6("density"))


@query("l2_collision_probability", f"""WITH {READINGS}, {COLLISION} SELECT asset_id, seq, ch_value AS distance, round({collision_sql("ch_value", 2.0)}, 9) AS p FROM r, tb""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = src.readings(spark, sf_dir).select("asset_id", "seq", F.col("ch_value").alias("distance"))
    return df.withColumn("p", F.round(kernels.collision_column(F.col("distance"), 2.0), 9))


@query("density_eh")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eh.density(src.vectors(spark, sf_dir), angular_bank(), WINDOW, 0.1, EVERY)


@query("eh_state")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eh.states(src.vectors(spark, sf_dir), angular_bank(), WINDOW, 0.1).withColumn("buckets", F.to_json("buckets"))


@query("memory_model_crossover", f"{CELLS}, l AS (SELECT asset_id, count(DISTINCT (row, code)) AS cells FROM ce JOIN (SELECT asset_id, max(clock) AS last FROM v GROUP BY 1) USING (asset_id) WHERE clock > last - {WINDOW} GROUP BY 1) SELECT asset_id, cells, cells * 345 AS sketch_bytes, CAST({WINDOW * DIM * 8} AS INT) AS raw_bytes, round(cells * 345.0 / {WINDOW * DIM * 8}, 6) AS times_raw, round(cells * 345.0 / {WINDOW * 8}, 6) AS crossover_dim FROM l")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = density.live_cells(src.vectors(spark, sf_dir), angular_bank(), WINDOW)
    return memory.model(cells, WINDOW, DIM).withColumns({"times_raw": F.round("times_raw", 6), "crossover_dim": F.round("crossover_dim", 6)})


# ---- scores

SMOOTHED = (
    READINGS
    + """,
l AS (SELECT asset_id, seq, list(ln(1 + greatest(ch_value, 0))) OVER (PARTITION BY asset_id ORDER BY seq) AS h FROM r),
e AS (SELECT asset_id, seq, list_reduce(h, lambda s, v: (2.0 / 9) * v + (1 - 2.0 / 9) * s) AS smoothed FROM l)"""
)


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.readings(spark, sf_dir).select("asset_id", F.col("seq").alias("clock"), F.col("ch_value").alias("density"))


@query("ewma_log_density", f"WITH {SMOOTHED} SELECT asset_id, seq AS clock, round(smoothed, 6) AS smoothed FROM e")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _series(spark, sf_dir).withColumn("v", scoring.log_density(F.col("density")))
    return scoring.ewma(df, "v", SMALL.scorer.smoothing).select("asset_id", "clock", r6("smoothed"))


@query("rolling_median", f"WITH {READINGS} SELECT asset_id, seq AS clock, round(median(ch_value) OVER (PARTITION BY asset_id ORDER BY seq ROWS 199 PRECEDING), 6) AS median FROM r")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rolling_median(_series(spark, sf_dir), "density", SMALL.scorer.history).select("asset_id", "clock", r6("median"))


@query("rolling_mad", f"WITH {READINGS} SELECT asset_id, seq AS clock, round(mad(ch_value) OVER (PARTITION BY asset_id ORDER BY seq ROWS 199 PRECEDING), 6) AS mad FROM r")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rolling_mad(_series(spark, sf_dir), "density", SMALL.scorer.history).select("asset_id", "clock", r6("mad"))


@query(
    "anomaly_score",
    f"""WITH {SMOOTHED}, q AS (SELECT asset_id, seq, smoothed, median(smoothed) OVER w AS mid, mad(smoothed) OVER w AS mad, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY asset_id ORDER BY seq ROWS 199 PRECEDING))
SELECT asset_id, seq AS clock, round(CASE WHEN n < 40 THEN 0.0 ELSE least(greatest((mid - smoothed) / greatest(1.4826 * mad, 1e-3), 0.0), 100.0) END, 5) AS score FROM q""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(_series(spark, sf_dir), SMALL.scorer).select("asset_id", "clock", F.round("score", 5).alias("score"))


@query("score_percentiles", f"WITH {READINGS} SELECT asset_id, " + ", ".join(f"round(quantile_cont(ch_value, {p}), 6) AS p{f'{p * 100:g}'.replace('.', '_')}" for p in (0.25, 0.5, 0.75, 0.95, 0.99, 0.999)) + " FROM r GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = (0.25, 0.5, 0.75, 0.95, 0.99, 0.999)
    df = src.readings(spark, sf_dir).groupBy("asset_id").agg(F.percentile("ch_value", F.array(*map(F.lit, shares))).alias("p"))
    return df.select("asset_id", *(F.round(F.col("p")[i], 6).alias(f"p{s * 100:g}".replace(".", "_")) for i, s in enumerate(shares)))


@query("alert_budget_threshold", f"WITH {SCORED} SELECT asset_id, round(threshold, 6) AS threshold FROM t")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = src.readings(spark, sf_dir).withColumnRenamed("ch_value", "score")
    return episodes.thresholds(series, ALERTING).select("asset_id", r6("threshold"))


@query("alerting_fraction", f"WITH {SCORED} SELECT asset_id, round(avg(CASE WHEN score > threshold THEN 1.0 ELSE 0.0 END), 6) AS alerting_fraction FROM s GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.alerting_fraction(scored(spark, sf_dir)).select("asset_id", r6("alerting_fraction"))


# ---- episodes and evaluation


@query("alert_episodes", f"WITH {SCORED}{SESSIONS} SELECT * FROM ep")
def alert_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.episodes(scored(spark, sf_dir), EPISODE_GAP)


@query("episode_peak", f"WITH {SCORED}{SESSIONS} SELECT ep.asset_id, episode, max(s.score) AS peak FROM ep JOIN s ON s.asset_id = ep.asset_id AND s.ts BETWEEN started_at AND ended_at GROUP BY 1, 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_episodes(spark, sf_dir).select("asset_id", "episode", F.col("peak_score").alias("peak"))


@query("label_series", f"WITH {READINGS}, {FAILURES} SELECT asset_id, seq, coalesce((SELECT max(idx) FROM w WHERE r.ts BETWEEN horizon_start AND f_end), -1) AS window_index, (SELECT max(idx) FROM w WHERE r.ts BETWEEN horizon_start AND f_end) IS NOT NULL AS in_window FROM r")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.labelled(src.readings(spark, sf_dir), episodes.windows(src.failures(spark), HORIZON))


@query("failure_at", f"WITH {READINGS}, {FAILURES} SELECT asset_id, seq, (SELECT name FROM w WHERE r.ts BETWEEN f_start AND f_end ORDER BY idx LIMIT 1) AS failure FROM r")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.first_failure(src.readings(spark, sf_dir), src.failures(spark))


def matched_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.matched(alert_episodes(spark, sf_dir), episodes.windows(src.failures(spark), HORIZON))


@query("episode_match_failure", f"WITH {SCORED}{SESSIONS}, {FAILURES}{MATCHED} SELECT m.asset_id, episode, name AS matched_failure, round((epoch_us(f_start) - epoch_us(started_at)) / 3.6e9, 6) AS lead_hours FROM m LEFT JOIN w USING (idx)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched_episodes(spark, sf_dir).select("asset_id", "episode", "matched_failure", r6("lead_hours"))


@query("unmatched_false_alarms", f"WITH {SCORED}{SESSIONS}, {FAILURES}{MATCHED} SELECT asset_id, count(*) AS false_alarms FROM m WHERE idx IS NULL GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched_episodes(spark, sf_dir).filter("matched_failure is null").groupBy("asset_id").agg(F.count(F.lit(1)).alias("false_alarms"))


FIRST = f"WITH {SCORED}{SESSIONS}{SPANS}, {FAILURES}{MATCHED}, fa AS (SELECT sp.asset_id, w.idx, name, f_start, (SELECT min(started_at) FROM m WHERE m.asset_id = sp.asset_id AND m.idx = w.idx) AS hit, (SELECT min(started_at) FROM ep WHERE ep.asset_id = sp.asset_id AND ep.started_at BETWEEN w.horizon_start AND w.f_end) AS first FROM sp JOIN w ON f_start <= span_end AND f_end >= span_start)"


@query("failure_first_alert", f"{FIRST} SELECT asset_id, idx, name, hit IS NOT NULL AS detected, CASE WHEN hit IS NOT NULL THEN first END AS first_alert, CASE WHEN hit IS NOT NULL THEN round((epoch_us(f_start) - epoch_us(first)) / 3.6e9, 6) END AS lead_hours FROM fa")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scored(spark, sf_dir)
    found = episodes.first_alerts(episodes.episodes(base, EPISODE_GAP), episodes.windows(src.failures(spark), HORIZON), episodes.spans(base))
    return found.select("asset_id", "idx", "name", "detected", "first_alert", r6("lead_hours"))


@query("mean_lead_hours", f"{FIRST} SELECT asset_id, round(avg(CASE WHEN hit IS NOT NULL THEN (epoch_us(f_start) - epoch_us(first)) / 3.6e9 END), 6) AS mean_lead_hours FROM fa GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.evaluate(scored(spark, sf_dir), src.failures(spark), HORIZON, EPISODE_GAP)
    return out.select("asset_id", r6("mean_lead_hours"))


DAYS = "greatest((epoch_us(max(span_end)) - epoch_us(min(span_start)) - sum(coalesce(greatest(epoch_us(least(f_end, span_end)) - epoch_us(greatest(horizon_start, span_start)), 0), 0))) / 8.64e10, 1e-9)"


@query("normal_days", f"WITH {READINGS}{SPANS}, {FAILURES} SELECT asset_id, round({DAYS}, 6) AS normal_days FROM sp LEFT JOIN w ON f_start <= span_end AND f_end >= span_start GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = episodes.normal_days(episodes.spans(src.readings(spark, sf_dir)), episodes.windows(src.failures(spark), HORIZON))
    return out.select("asset_id", r6("normal_days"))


def sweep_sql(samples: str, key: str, hours: float = HORIZON) -> str:
    """Counts and rates for groups (asset_id, key) of `samples` (asset_id, key, seq, ts, score, threshold)."""
    wins = FAILURES.replace("INTERVAL 24 HOUR", f"INTERVAL {int(hours)} HOUR")
    return f"""WITH {READINGS}{SPANS}, {wins}, g AS ({samples}),
a AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY asset_id, {key} ORDER BY ts, seq)) <= 21600000000 THEN 0 ELSE 1 END AS first FROM g WHERE score > threshold),
b AS (SELECT *, sum(first) OVER (PARTITION BY asset_id, {key} ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS episode FROM a),
ep AS (SELECT asset_id, {key}, episode, min(ts) AS started_at FROM b GROUP BY 1, 2, 3),
m AS (SELECT ep.*, (SELECT min(idx) FROM w JOIN sp ON sp.asset_id = ep.asset_id WHERE f_start <= span_end AND f_end >= span_start AND started_at BETWEEN horizon_start AND f_end) AS idx FROM ep),
al AS (SELECT asset_id, {key}, avg(CASE WHEN score > threshold THEN 1.0 ELSE 0.0 END) AS fraction FROM g GROUP BY 1, 2),
nd AS (SELECT asset_id, {DAYS} AS days FROM sp LEFT JOIN w ON f_start <= span_end AND f_end >= span_start GROUP BY 1),
ct AS (SELECT asset_id, {key}, count(*) FILTER (WHERE idx IS NULL) AS false_alarms, count(DISTINCT idx) AS detected, count(*) AS episodes FROM m GROUP BY 1, 2)
SELECT al.asset_id, al.{key}, round(fraction, 6) AS alerting_fraction, coalesce(false_alarms, 0) AS false_alarms, coalesce(detected, 0) AS detected, coalesce(episodes, 0) AS episodes, round(coalesce(false_alarms, 0) / days, 6) AS false_alarms_per_day
FROM al JOIN nd USING (asset_id) LEFT JOIN ct ON ct.asset_id = al.asset_id AND ct.{key} = al.{key}"""


RATES = ("false_alarms", "detected", "episodes")
CUTS = (50.0, 100.0, 150.0, 200.0, 300.0)


@query("threshold_sweep", sweep_sql(f"SELECT asset_id, seq, ts, ch_value AS score, threshold FROM r CROSS JOIN (SELECT unnest([{', '.join(map(str, CUTS))}])::DOUBLE AS threshold)", "threshold"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = src.readings(spark, sf_dir).select("asset_id", "seq", "ts", F.col("ch_value").alias("score"))
    out = evaluate.sweep(series, src.failures(spark), CUTS, horizon_hours=HORIZON, gap_seconds=EPISODE_GAP)
    return out.select("asset_id", "threshold", r6("alerting_fraction"), *RATES, r6("false_alarms_per_day"))


def budget_sql(hours: float) -> str:
    budgets = ", ".join(map(str, evaluate.HORIZON_BUDGETS))
    cut = f"(SELECT asset_id, unnest([{budgets}])::DOUBLE AS budget, unnest(quantile_cont(ch_value, [{', '.join(str(1.0 - b) for b in evaluate.HORIZON_BUDGETS)}])) AS threshold FROM r GROUP BY 1)"
    return sweep_sql(f"SELECT r.asset_id, seq, ts, ch_value AS score, budget, threshold FROM r JOIN {cut} USING (asset_id)", "budget", hours)


@query("false_alarms_per_day", budget_sql(HORIZON))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = src.readings(spark, sf_dir).select("asset_id", "seq", "ts", F.col("ch_value").alias("score"), F.lit("value").alias("method"))
    out = evaluate.compare(series, src.failures(spark), evaluate.HORIZON_BUDGETS, horizon_hours=HORIZON, gap_seconds=EPISODE_GAP)
    return out.select("asset_id", "budget", r6("alerting_fraction"), *RATES, r6("false_alarms_per_day"))


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three series to compare: the value, its smoothed logarithm, its score."""
    base = src.readings(spark, sf_dir).select("asset_id", "seq", "ts", F.col("seq").alias("clock"), F.col("ch_value").alias("density"))
    done = scoring.score(base, SMALL.scorer)
    pairs = "stack(3, 'value', density, 'smoothed', smoothed, 'robust', score) as (method, score)"
    return done.selectExpr("asset_id", "seq", "ts", pairs)


def compare_sql() -> str:
    budgets, shares = (", ".join(map(str, x)) for x in (evaluate.BUDGETS, [1.0 - b for b in evaluate.BUDGETS]))
    samples = f"""WITH {SMOOTHED[len(READINGS):].lstrip().lstrip(",")}, q AS (SELECT asset_id, seq, smoothed, median(smoothed) OVER w AS mid, mad(smoothed) OVER w AS mad, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY asset_id ORDER BY seq ROWS 199 PRECEDING)),
z AS (SELECT asset_id, seq, ts, 'value' AS method, ch_value AS score FROM r UNION ALL SELECT asset_id, seq, ts, 'smoothed', smoothed FROM e JOIN r USING (asset_id, seq) UNION ALL
SELECT asset_id, seq, ts, 'robust', CASE WHEN n < 40 THEN 0.0 ELSE least(greatest((mid - smoothed) / greatest(1.4826 * mad, 1e-3), 0.0), 100.0) END FROM q JOIN r USING (asset_id, seq)),
cut AS (SELECT asset_id, method, unnest([{budgets}])::DOUBLE AS budget, unnest(quantile_cont(score, [{shares}])) AS threshold FROM z GROUP BY 1, 2)
SELECT asset_id, seq, ts, score, threshold, method || '/' || budget AS mb FROM z JOIN cut USING (asset_id, method)"""
    lead = """,
lw AS (SELECT ep.asset_id, mb, w.idx, (epoch_us(any_value(f_start)) - epoch_us(min(started_at))) / 3.6e9 AS lead FROM ep JOIN sp ON sp.asset_id = ep.asset_id JOIN w ON f_start <= span_end AND f_end >= span_start AND started_at BETWEEN horizon_start AND f_end GROUP BY 1, 2, 3),
ld AS (SELECT asset_id, mb, avg(lead) AS lead FROM lw GROUP BY 1, 2)
SELECT al.asset_id, split_part(al.mb, '/', 1) AS method, CAST(split_part(al.mb, '/', 2) AS DOUBLE) AS budget, round(lead, 6) AS mean_lead_hours"""
    whole = sweep_sql(samples, "mb").replace("\nSELECT al.asset_id, al.mb", lead, 1)
    return whole + " LEFT JOIN ld ON ld.asset_id = al.asset_id AND ld.mb = al.mb"


@query("compare_methods", compare_sql())
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.compare(methods(spark, sf_dir), src.failures(spark), horizon_hours=HORIZON, gap_seconds=EPISODE_GAP)
    return out.select("asset_id", "method", "budget", r6("alerting_fraction"), *RATES, r6("false_alarms_per_day"), r6("mean_lead_hours"))


@query("horizon_sensitivity", " UNION ALL ".join(f"SELECT *, {h} AS horizon_hours FROM ({budget_sql(h)})" for h in evaluate.HORIZONS))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = src.readings(spark, sf_dir).select("asset_id", "seq", "ts", F.col("ch_value").alias("score"), F.lit("value").alias("method"))
    out = evaluate.horizons(series, src.failures(spark), gap_seconds=EPISODE_GAP)
    return out.select("asset_id", "budget", "horizon_hours", r6("alerting_fraction"), *RATES, r6("false_alarms_per_day"))


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = episodes.spans(src.readings(spark, sf_dir))
    w = F.broadcast(episodes.windows(src.failures(spark), HORIZON).withColumnsRenamed({"end": "w_end"}))
    part = episodes.seconds(F.least("w_end", "span_end"), F.greatest("horizon_start", "span_start")) / episodes.seconds(F.col("span_end"), F.col("span_start"))
    hit = span.join(w, (F.col("start") <= F.col("span_end")) & (F.col("w_end") >= F.col("span_start")))
    return hit.groupBy("asset_id").agg(F.sort_array(F.collect_list(F.struct("idx", part.alias("share")))).alias("s")).select("asset_id", F.transform("s", lambda x: x["share"]).alias("shares"))


@query(
    "chance_closed_form",
    f"""WITH {READINGS}{SPANS}, {FAILURES}, sh AS (SELECT asset_id, list((epoch_us(least(f_end, span_end)) - epoch_us(greatest(horizon_start, span_start))) / (epoch_us(span_end) - epoch_us(span_start)) ORDER BY idx) AS s FROM sp JOIN w ON f_start <= span_end AND f_end >= span_start GROUP BY 1),
none AS (SELECT asset_id, mask, pow(1 - (CASE WHEN mask & 1 > 0 THEN s[1] ELSE 0 END) - (CASE WHEN mask & 2 > 0 THEN s[2] ELSE 0 END) - (CASE WHEN mask & 4 > 0 THEN s[3] ELSE 0 END) - (CASE WHEN mask & 8 > 0 THEN s[4] ELSE 0 END), 20) AS p FROM sh, (SELECT unnest(range(16)) AS mask)),
miss AS (SELECT a.asset_id, a.mask AS missed, sum((CASE WHEN bit_count(xor(a.mask, b.mask)) % 2 = 0 THEN 1 ELSE -1 END) * b.p) AS p FROM none a JOIN none b ON b.asset_id = a.asset_id AND b.mask & a.mask = a.mask GROUP BY 1, 2)
SELECT asset_id, {", ".join(f"round(sum(CASE WHEN bit_count(missed) = {4 - k} THEN p ELSE 0 END), 6) AS p_{k}" for k in range(5))} FROM miss GROUP BY 1""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.closed_form(_shares(spark, sf_dir).withColumn("alarms", F.lit(20)))
    return out.select("asset_id", *(r6(f"p_{k}") for k in range(5)))


def chance_sql(tail: str) -> str:
    """Operating points of the value with their p-value as c, then `tail`."""
    gone = " ".join(f"- (CASE WHEN mask & {1 << i} > 0 THEN coalesce(s[{i + 1}], 0) ELSE 0 END)" for i in range(4))
    return f"""WITH e AS ({budget_sql(HORIZON)}), {READINGS}{SPANS}, {FAILURES}, sh AS (SELECT asset_id, list((epoch_us(least(f_end, span_end)) - epoch_us(greatest(horizon_start, span_start))) / (epoch_us(span_end) - epoch_us(span_start)) ORDER BY idx) AS s FROM sp JOIN w ON f_start <= span_end AND f_end >= span_start GROUP BY 1),
none AS (SELECT e.asset_id, budget, detected, mask, pow(greatest(1 {gone}, 0.0), false_alarms + detected) AS p FROM e JOIN sh USING (asset_id), (SELECT unnest(range(16)) AS mask)),
hit AS (SELECT a.asset_id, a.budget, sum((CASE WHEN bit_count(xor(a.mask, b.mask)) % 2 = 0 THEN 1 ELSE -1 END) * b.p) AS p FROM none a JOIN none b ON b.asset_id = a.asset_id AND b.budget = a.budget AND b.mask & a.mask = a.mask WHERE 4 - bit_count(a.mask) >= a.detected GROUP BY 1, 2),
c AS (SELECT e.asset_id, budget, detected, false_alarms, round(least(greatest(p, 0.0), 1.0), 9) AS p_value FROM e JOIN hit USING (asset_id, budget)) {tail}"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = src.readings(spark, sf_dir).select("asset_id", "seq", "ts", F.col("ch_value").alias("score"), F.lit("value").alias("method"))
    out = evaluate.compare(series, src.failures(spark), evaluate.HORIZON_BUDGETS, horizon_hours=HORIZON, gap_seconds=EPISODE_GAP)
    out = evaluate.with_chance(out.join(_shares(spark, sf_dir), "asset_id"))
    return out.select("asset_id", "budget", "detected", "false_alarms", "p_value")


CHANCE = "asset_id, budget, detected, false_alarms, round(p_value, 6) AS p_value"


@query("operating_point_chance", chance_sql(f"SELECT {CHANCE} FROM c"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).withColumn("p_value", F.round("p_value", 6))


@query("strongest_operating_point", chance_sql(f"SELECT {CHANCE} FROM c QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY c.p_value, detected DESC, budget) = 1"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.strongest(_points(spark, sf_dir)).withColumn("p_value", F.round("p_value", 6))


AROUND = "(epoch_us(ts) - epoch_us(f_start)) / 3.6e9"


@query("score_around_failures", f"WITH {READINGS}, {FAILURES} SELECT asset_id, idx, name, max(ch_value) FILTER (WHERE {AROUND} < 0) AS peak_before, max(ch_value) FILTER (WHERE {AROUND} >= 0) AS peak_after, count(*) AS n FROM r JOIN w ON {AROUND} BETWEEN -48 AND 24 GROUP BY 1, 2, 3")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = src.readings(spark, sf_dir).select("asset_id", "ts", F.col("ch_value").alias("score"))
    return series.around(scores, src.failures(spark))


@query("score_series_methods")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for method in series.METHODS:
        one = series.build(src.faulty_readings(spark, sf_dir), CHANNELS, SMALL, method)
        out = one if out is None else out.unionByName(one)
    return out


# ---- diagnosis

PERIODS = f"""WITH {READINGS}, {FAILURES}, pd AS (
SELECT r.*, 'normal' AS period FROM r WHERE NOT EXISTS (SELECT 1 FROM w WHERE r.ts BETWEEN horizon_start AND f_end) UNION ALL
SELECT r.*, name FROM r JOIN w ON r.ts >= horizon_start AND r.ts < f_start),
lo AS (SELECT asset_id, period, unnest(['ch_value', 'ch_k']) AS channel, unnest([ch_value, ch_k]) AS v FROM pd),
sx AS (SELECT asset_id, period, channel, avg(v) AS mean, stddev_samp(v) AS dev FROM lo GROUP BY 1, 2, 3),
ef AS (SELECT s.asset_id, s.period AS failure, s.channel, CASE WHEN n.dev < 1e-9 THEN 0.0 ELSE (s.mean - n.mean) / n.dev END AS effect FROM sx s JOIN sx n ON n.asset_id = s.asset_id AND n.channel = s.channel AND n.period = 'normal' WHERE s.period <> 'normal')"""


@query("effect_size_by_failure", f"{PERIODS} SELECT asset_id, failure, channel, round(effect, 6) AS effect FROM ef")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.effects(src.readings(spark, sf_dir), src.failures(spark), CHANNELS).select("asset_id", "failure", "channel", r6("effect"))


@query("top3_channels", f"{PERIODS} SELECT asset_id, failure, channel, CAST(row_number() OVER (PARTITION BY asset_id, failure ORDER BY abs(effect) DESC, channel) AS INT) AS rank FROM ef")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.strongest(diagnose.effects(src.readings(spark, sf_dir), src.failures(spark), CHANNELS)).select("asset_id", "failure", "channel", "rank")


@query("overall_effect", f"{PERIODS} SELECT asset_id, failure, round(avg(abs(effect)), 6) AS mean_effect, round(max(abs(effect)), 6) AS max_effect FROM ef GROUP BY 1, 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.overall(diagnose.effects(src.readings(spark, sf_dir), src.failures(spark), CHANNELS)).select("asset_id", "failure", r6("mean_effect"), r6("max_effect"))


@query("duty_by_period", PERIODS.replace("unnest(['ch_value', 'ch_k'])", "unnest(['flag_high', 'flag_odd'])").replace("unnest([ch_value, ch_k])", "unnest([flag_high, flag_odd])") + " SELECT asset_id, period, channel, round(mean, 6) AS duty FROM sx")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.duty_by_period(src.readings(spark, sf_dir), src.failures(spark), FLAGS).select("asset_id", "period", "channel", r6("duty"))


# ---- alert rules


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.readings(spark, sf_dir).select("asset_id", "seq", "ts", F.col("ch_value").alias("score"))


def runs_sql(limit: float, hold: float, name: str) -> str:
    return f"""{name}0 AS (SELECT asset_id, seq, ts, ch_value > {limit} AS active, sum(CASE WHEN ch_value > {limit} THEN 0 ELSE 1 END) OVER (PARTITION BY asset_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM r),
{name} AS (SELECT asset_id, CAST(run AS BIGINT) AS run, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n FROM {name}0 WHERE active GROUP BY 1, 2 HAVING epoch_us(max(ts)) - epoch_us(min(ts)) >= {int(hold * 1_000_000)})"""


@query("alert_hold", f"WITH {READINGS}, {runs_sql(40, 1800, 'x')} SELECT * FROM x")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.runs(_samples(spark, sf_dir), 40.0, 1800.0)


@query("alert_inhibition", f"WITH {READINGS}, {runs_sql(40, 0, 'x')}, {runs_sql(100, 0, 'y')} SELECT x.* FROM x WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.asset_id = x.asset_id AND x.started_at <= y.ended_at AND x.ended_at >= y.started_at)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _samples(spark, sf_dir)
    return alerts.inhibited(alerts.runs(df, 40.0, 0.0), alerts.runs(df, 100.0, 0.0))


@query(
    "alert_state_machine",
    f"""WITH {READINGS}, z AS (SELECT asset_id, seq, ts, severity, ch_value > lim AS active FROM r CROSS JOIN (VALUES ('warning', 40.0), ('critical', 100.0)) v(severity, lim)),
y AS (SELECT *, sum(CASE WHEN active THEN 0 ELSE 1 END) OVER v AS run, max(CASE WHEN active THEN ts END) OVER v AS seen FROM z WINDOW v AS (PARTITION BY asset_id, severity ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
x AS (SELECT *, min(CASE WHEN active THEN ts END) OVER (PARTITION BY asset_id, severity, run) AS since,
  sum(CASE WHEN NOT active AND epoch_us(ts) - epoch_us(seen) >= 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id, severity ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS part FROM y),
u AS (SELECT *, max(CASE WHEN active AND epoch_us(ts) - epoch_us(since) >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id, severity, part ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS fired FROM x)
SELECT asset_id, ts, severity, CASE WHEN fired = 1 THEN 'firing' WHEN active THEN 'pending' ELSE 'inactive' END AS state FROM u""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.states(_samples(spark, sf_dir), 1800.0, 7200.0, {"warning": 40.0, "critical": 100.0})


@query(
    "quality_issue_rate",
    f"""WITH {FAULTY}, k AS (SELECT asset_id, ts, 'missing_field' AS kind, (ch_value IS NULL)::INT + (ch_k IS NULL)::INT AS n FROM c UNION ALL SELECT asset_id, ts, 'out_of_range', coalesce((ch_value NOT BETWEEN 0 AND 400)::INT, 0) + coalesce((ch_k NOT BETWEEN 0 AND 95)::INT, 0) FROM c)
SELECT asset_id, kind, time_bucket(INTERVAL 1 DAY, ts) AS "from", CAST(sum(n) AS BIGINT) AS n, round(sum(n) / 86400.0, 9) AS rate FROM k WHERE ts IS NOT NULL GROUP BY 1, 2, 3 HAVING sum(n) / 86400.0 > 0.00003""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = "stack(2, 'missing_field', size(missing_fields), 'out_of_range', size(out_of_range)) as (kind, n)"
    rows = checked(spark, sf_dir).selectExpr("asset_id", "ts", kinds)
    return alerts.issue_rate(rows, 0.00003, "1 day").withColumn("n", F.col("n").cast("long")).withColumn("rate", F.round("rate", 9))


@query("stream_stalled", f'WITH {READINGS}, g AS (SELECT asset_id, lag(ts) OVER (PARTITION BY asset_id ORDER BY ts, seq) AS "from", ts AS until FROM r) SELECT asset_id, "from", until, (epoch_us(until) - epoch_us("from")) / 1e6 AS gap FROM g WHERE epoch_us(until) - epoch_us("from") >= 7200000000')
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.stalled(_samples(spark, sf_dir), 7200.0)


# ---- serving


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.readings(spark, sf_dir).select("asset_id").distinct().withColumn("description", F.concat(F.lit("events of type "), "asset_id"))


ANOMALIES = f"WITH {SCORED}{SESSIONS}, {FAILURES}{MATCHED}, an AS (SELECT m.asset_id, episode, started_at, ended_at, peak_score, threshold, name AS matched_failure, (epoch_us(f_start) - epoch_us(started_at)) / 3.6e9 AS lead_hours FROM m LEFT JOIN w USING (idx))"
HEALTH = f"""{ANOMALIES}, e AS (SELECT asset_id, max(ended_at) AS window_end FROM an GROUP BY 1)
SELECT asset_id, 'events of type ' || asset_id AS description, max(window_end) AS window_end, count(*) FILTER (WHERE started_at >= window_end - INTERVAL 24 HOUR) AS anomalies_24h,
count(*) FILTER (WHERE started_at >= window_end - INTERVAL 7 DAY) AS anomalies_7d, count(*) AS anomalies_total, count(matched_failure) AS anomalies_matched,
CASE WHEN count(*) FILTER (WHERE started_at >= window_end - INTERVAL 24 HOUR) = 0 THEN 'healthy' WHEN arg_max(peak_score, started_at) >= 2.0 THEN 'critical' ELSE 'warning' END AS status FROM an JOIN e USING (asset_id) GROUP BY 1"""


def _anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.anomaly_rows(matched_episodes(spark, sf_dir), "value")


@query("asset_health", HEALTH)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.health(_assets(spark, sf_dir), _anomalies(spark, sf_dir)).drop("latest")


DESCRIBED = "strftime(started_at, '%Y-%m-%dT%H:%M:%S') AS started_at, strftime(ended_at, '%Y-%m-%dT%H:%M:%S') AS ended_at, round((epoch_us(ended_at) - epoch_us(started_at)) / 3.6e9, 2) AS duration_hours"


@query("recent_anomalies", f"{ANOMALIES} SELECT asset_id, {DESCRIBED}, matched_failure AS coincided_with_documented_failure FROM an WHERE asset_id = (SELECT min(event_type) FROM events) ORDER BY an.started_at DESC LIMIT 10")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = src.table(spark, sf_dir, "events", ["event_type"]).agg(F.min("event_type")).first()[0]
    out = serving.list_recent_anomalies(_anomalies(spark, sf_dir), first, 10)
    return out.select("asset_id", "started_at", "ended_at", "duration_hours", "coincided_with_documented_failure")


@query(
    "explain_alert",
    f"""{ANOMALIES} SELECT asset_id, started_at, CASE WHEN matched_failure IS NULL THEN
'This alert did not coincide with any documented failure, so on the evaluation''s accounting it is a false alarm. The measured rate is roughly 0.35 such alarms per day of normal operation at this threshold.'
ELSE 'This alert coincided with documented failure ''' || matched_failure || ''' (value), firing ' || CASE WHEN lead_hours > 0.5 THEN format('{{:.1f}}', lead_hours) || 'h before that failure''s recorded start' ELSE 'essentially at the failure''s recorded start' END || '.' END AS verdict,
'Kernel density around the current sensor reading fell to ' || format('{{:.1f}}', CASE WHEN coalesce(threshold, 0) = 0 THEN 0.0 ELSE peak_score / threshold END) || 'x the alerting threshold, measured as robust deviations below the rolling median of log density. A drop means recent readings moved into a region of the feature space that had gone sparse within the sliding window.' AS why_it_fired FROM an""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.with_verdict(_anomalies(spark, sf_dir)).select("asset_id", "started_at", "verdict", "why_it_fired")


@query("latest_per_asset", f"WITH {READINGS} SELECT asset_id, max(seq) AS seq, arg_max(ch_value, seq) AS ch_value, arg_max(ch_k, seq) AS ch_k FROM r GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.latest(src.readings(spark, sf_dir), CHANNELS, "seq")


@query("upsert_assets", f"WITH {READINGS} SELECT DISTINCT asset_id, CASE WHEN asset_id < 'm' THEN 'new' ELSE 'old' END AS description FROM r")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _assets(spark, sf_dir).withColumn("description", F.lit("old"))
    return sinks.upserted(old, old.filter("asset_id < 'm'").withColumn("description", F.lit("new")), ["asset_id"])


# ---- dashboards


@query("ingest_rate", f"WITH {FAULTY} SELECT asset_id, time_bucket(INTERVAL 1 DAY, ts) AS at, count(*) AS n, round(count(*) / 86400.0, 9) AS rate FROM o WHERE usable AND usable_rank >= 200 AND ts IS NOT NULL GROUP BY 1, 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.outcomes(checked(spark, sf_dir), SMALL.warmup)
    return dashboards.ingest_rate(rows, "1 day", 86400.0).withColumn("rate", F.round("rate", 9))


@query("outcomes_over_time", f"WITH {FAULTY} SELECT asset_id, {OUTCOME} AS outcome, time_bucket(INTERVAL 1 DAY, ts) AS at, count(*) AS n FROM o WHERE ts IS NOT NULL GROUP BY 1, 2, 3")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.outcomes_over_time(quality.outcomes(checked(spark, sf_dir), SMALL.warmup), "1 day")


@query("value_histogram", f"WITH {READINGS} SELECT asset_id, le, count(*) FILTER (WHERE ch_value <= le) AS n FROM r CROSS JOIN (SELECT unnest(['10', '20', '50', '100', '200', 'Infinity']::DOUBLE[]) AS le) GROUP BY 1, 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.histogram(src.readings(spark, sf_dir), "ch_value", (10.0, 20.0, 50.0, 100.0, 200.0))


@query(
    "histogram_quantile",
    f"""WITH {READINGS}, h AS (SELECT asset_id, le, count(*) FILTER (WHERE ch_value <= le) AS n FROM r CROSS JOIN (SELECT unnest(['10', '20', '50', '100', '200', 'Infinity']::DOUBLE[]) AS le) GROUP BY 1, 2),
x AS (SELECT asset_id, le, n, coalesce(lag(le) OVER v, 0) AS lo, coalesce(lag(n) OVER v, 0) AS below, 0.95 * max(n) OVER (PARTITION BY asset_id) AS want FROM h WINDOW v AS (PARTITION BY asset_id ORDER BY le))
SELECT asset_id, round(arg_min(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (want - below) / (n - below) END, le), 6) AS value FROM x WHERE n >= want AND n > below GROUP BY 1""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = (10.0, 20.0, 50.0, 100.0, 200.0)
    return dashboards.quantile(dashboards.histogram(src.readings(spark, sf_dir), "ch_value", ends), 0.95).select("asset_id", r6("value"))


@query("counter_rate", f"WITH {READINGS} SELECT asset_id, seq AS t, round(sum(up) OVER (PARTITION BY asset_id ORDER BY seq RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) / 60, 6) AS rate FROM (SELECT asset_id, seq, CASE WHEN ch_k - lag(ch_k) OVER w < 0 THEN ch_k ELSE coalesce(ch_k - lag(ch_k) OVER w, 0) END AS up FROM r WINDOW w AS (PARTITION BY asset_id ORDER BY seq))")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = src.readings(spark, sf_dir).select("asset_id", F.col("seq").alias("t"), F.col("ch_k").alias("total"))
    return dashboards.rate(df).select("asset_id", "t", r6("rate"))


# ---- the monitor as a whole


@query("monitor_batch")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.batch(src.faulty_readings(spark, sf_dir), CHANNELS, LIMITS, SMALL)


@query("monitor_outcomes", f"WITH {FAULTY} SELECT asset_id, {OUTCOME} AS label, CAST(count(*) AS DOUBLE) AS value FROM o GROUP BY 1, 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = monitor.metrics(monitor.batch(src.faulty_readings(spark, sf_dir), CHANNELS, LIMITS, SMALL))
    return out.filter("metric = 'records'").drop("metric")
