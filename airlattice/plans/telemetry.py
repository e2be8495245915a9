"""Telemetry queries over ``events``: a user is a sensor of a kit, value its reading, event_type its role or flag."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlattice.operators import cleaning, filters, joins, segments, series
from airlattice.session import table

from .catalog import query


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


ORDER = ["ts", "event_id"]


def r6(c) -> F.Column:
    return F.round(c, 6)


@query(
    "kit_summary",
    """SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts,
    CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n_error,
    CAST(sum(CASE WHEN event_type IN ('error', 'signup') OR value > 200 THEN 1 ELSE 0 END) AS BIGINT) AS n_any
    FROM events GROUP BY user_id""",
)
def kit_summary(spark, sf_dir):
    flags = F.greatest((F.col("event_type") == "error").cast("int"), (F.col("event_type") == "signup").cast("int"), (F.col("value") > 200).cast("int"))
    return events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum((F.col("event_type") == "error").cast("int")).alias("n_error"), F.sum(flags).alias("n_any"))


@query(
    "kit_diagnostics",
    """WITH s AS (SELECT *, event_type <> 'signup' AND value >= 2 AND value <= 90 AS scope, event_type = 'error' AS bad FROM events),
    k AS (SELECT user_id, CAST(sum(CASE WHEN scope THEN 1 ELSE 0 END) AS BIGINT) AS n_scope,
      round(100.0 * sum(CASE WHEN scope AND bad THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN scope THEN 1 ELSE 0 END), 0), 2) AS error_pct,
      max(CASE WHEN value > 1 THEN ts END) AS last_seen FROM s GROUP BY user_id)
    SELECT user_id, n_scope, CAST(error_pct AS DOUBLE) AS error_pct, last_seen,
    CASE WHEN error_pct IS NULL THEN 'unknown' WHEN error_pct >= 35 THEN 'critical' WHEN error_pct >= 25 THEN 'warning' ELSE 'healthy' END AS status FROM k""",
)
def kit_diagnostics(spark, sf_dir):
    """Rates within the regime, status by thresholds, and when the kit was last seen; one pass over all kits."""
    scope = (F.col("event_type") != "signup") & F.col("value").between(2, 90)
    bad = F.col("event_type") == "error"
    n = F.sum(scope.cast("int"))
    pct = F.round(F.try_divide(100.0 * F.sum((scope & bad).cast("int")), n), 2)
    k = events(spark, sf_dir).groupBy("user_id").agg(n.alias("n_scope"), pct.alias("error_pct"), F.max(F.when(F.col("value") > 1, F.col("ts"))).alias("last_seen"))
    status = F.when(F.col("error_pct").isNull(), "unknown").when(F.col("error_pct") >= 35, "critical").when(F.col("error_pct") >= 25, "warning").otherwise("healthy")
    return k.withColumn("status", status)


@query(
    "last_location",
    """SELECT user_id, arg_max(value, ts) AS value, arg_max(event_type, ts) AS event_type, max(ts) AS ts
    FROM events WHERE value >= 1 GROUP BY user_id""",
)
def last_location(spark, sf_dir):
    best = F.max_by(F.struct("value", "event_type", "ts"), F.struct("ts", "event_id"))
    return events(spark, sf_dir).where("value >= 1").groupBy("user_id").agg(best.alias("b")).select("user_id", "b.value", "b.event_type", "b.ts")


@query(
    "sensor_stats",
    """SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
    round(stddev_pop(value), 6) AS std_pop, min(value) AS low, max(value) AS high, round(median(value), 6) AS mid FROM events GROUP BY user_id""",
)
def sensor_stats(spark, sf_dir):
    v = "value"
    return events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), r6(F.avg(v)).alias("mean"), r6(F.stddev_samp(v)).alias("std"), r6(F.stddev_pop(v)).alias("std_pop"), F.min(v).alias("low"), F.max(v).alias("high"), r6(F.median(v)).alias("mid"))


@query("load_bins", "SELECT event_id, CASE WHEN value IS NULL THEN NULL WHEN value < 20 THEN 0 WHEN value > 30 THEN 2 ELSE 1 END AS load_bin, CASE WHEN value > 30 THEN 2 WHEN value > 20 THEN 1 ELSE 0 END AS closed_bin FROM events")
def load_bins(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", cleaning.load_bin(F.col("value"), 20, 30).alias("load_bin"), cleaning.right_closed_bin(F.col("value"), [20, 30]).alias("closed_bin"))


@query(
    "calibration",
    """SELECT event_id, round(value * (3.6 / 3.3 * 0.000788) - 2.3057, 9) AS pressure, round(value / 60 * 2 * pi() * 0.46 * 3.6, 6) AS speed,
    greatest(0, least(value / 100, 1.5)) AS clamped, CASE WHEN abs(value - 53.46) < 0.0001 THEN NULL ELSE value END AS clean FROM events""",
)
def calibration(spark, sf_dir):
    v = F.col("value")
    return events(spark, sf_dir).select("event_id", F.round(cleaning.calibrated_pressure(v), 9).alias("pressure"), r6(cleaning.speed_from_rpm(v)).alias("speed"), cleaning.clamp(v / 100, 0.0, 1.5).alias("clamped"), cleaning.without_stuck(v, 53.46).alias("clean"))


@query("time_range_filter", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' AND hour(ts) BETWEEN 1 AND 23")
def time_range_filter(spark, sf_dir):
    return events(spark, sf_dir).where((F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("ts") <= F.lit("2024-01-20").cast("timestamp_ntz")) & F.hour("ts").between(1, 23)).select("event_id", "ts")


@query("day_slice_shift", "SELECT event_id, ts + INTERVAL 2 HOURS AS shifted, CAST(ts AS DATE) AS day FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'")
def day_slice_shift(spark, sf_dir):
    day = (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz"))
    return events(spark, sf_dir).where(day).select("event_id", (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("shifted"), F.to_date("ts").alias("day"))


@query("valid_fixes", "SELECT c_custkey, c_acctbal / 100 AS lat, c_nationkey AS lon FROM customer WHERE NOT (abs(c_acctbal / 100) < 0.5 AND abs(c_nationkey) < 0.5) AND c_acctbal / 100 BETWEEN -90 AND 90")
def valid_fixes(spark, sf_dir):
    d = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("lat"), F.col("c_nationkey").alias("lon"))
    return d.where(cleaning.valid_fix(F.col("lat"), F.col("lon")) & cleaning.in_bounds(F.col("lat"), F.col("lon")))


@query("decimate", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r FROM events) WHERE r % 5 = 0")
def decimate(spark, sf_dir):
    return cleaning.decimate(events(spark, sf_dir), "user_id", ORDER, 5).select("event_id", "user_id")


@query("moving_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS smooth FROM events")
def moving_average(spark, sf_dir):
    d = series.moving_average(events(spark, sf_dir).select("event_id", "user_id", "ts", "value"), "user_id", ORDER, "value", 20, "smooth")
    return d.select("event_id", r6("smooth").alias("smooth"))


@query("gradient", "SELECT event_id, round(coalesce((value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) * 40, 0), 6) AS gradient FROM events")
def gradient(spark, sf_dir):
    d = series.with_lag(events(spark, sf_dir).select("event_id", "user_id", "ts", "value"), "user_id", ORDER, before=F.col("value"))
    return d.select("event_id", r6(F.coalesce((F.col("value") - F.col("before")) * 40, F.lit(0.0))).alias("gradient"))


@query(
    "lowpass_10hz",
    "SELECT event_id, round((value + coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0)) / 2, 6) AS y FROM events",
)
def lowpass_10hz(spark, sf_dir):
    """At a quarter of the rate the feedback vanishes: a mean of two."""
    d = series.with_lag(events(spark, sf_dir).select("event_id", "user_id", "ts", "value"), "user_id", ORDER, before=F.col("value"))
    return d.select("event_id", r6((F.col("value") + F.coalesce("before", F.lit(0.0))) / 2).alias("y"))


@query(
    "lowpass_1hz",
    """WITH RECURSIVE o AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
    f AS (SELECT event_id, user_id, value, r, 0.0729596572682667 * value AS y FROM o WHERE r = 1
      UNION ALL SELECT o.event_id, o.user_id, o.value, o.r, 0.0729596572682667 * (o.value + f.value) + 0.8540806854634666 * f.y FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1)
    SELECT event_id, round(y, 6) AS y FROM f""",
)
def lowpass_1hz(spark, sf_dir):
    d = filters.lowpass(events(spark, sf_dir).select("event_id", "user_id", "ts", "value"), ["user_id"], ORDER, "value", 1, 40, "y")
    return d.select("event_id", r6("y").alias("y"))


@query(
    "islands",
    """WITH c AS (SELECT *, CASE WHEN lag(value >= 50) OVER w = (value >= 50) THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM c)
    SELECT user_id, CAST(island AS BIGINT) AS island, bool_or(value >= 50) AS high, count(*) AS n, min(ts) AS start, max(ts) AS stop FROM i GROUP BY user_id, island""",
)
def islands(spark, sf_dir):
    d = series.islands(events(spark, sf_dir).select("event_id", "user_id", "ts", "value"), "user_id", ORDER, F.col("value") >= 50)
    return d.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.bool_or(F.col("value") >= 50).alias("high"), F.count(F.lit(1)).alias("n"), F.min("ts").alias("start"), F.max("ts").alias("stop"))


@query(
    "run_counters",
    """WITH c AS (SELECT *, sum(CASE WHEN value < 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events)
    SELECT event_id, CAST(CASE WHEN value < 50 THEN 0 ELSE sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) END AS BIGINT) AS run FROM c""",
)
def run_counters(spark, sf_dir):
    """Length so far of the run of readings of 50 or more; reset below. It is the count of such readings less the count at the last reset."""
    d = segments.segmented(events(spark, sf_dir).select("event_id", "user_id", "ts", "value"), ["user_id"], ORDER)
    d = segments.fold(d, ["user_id"], up=segments.running_sum((F.col("value") >= 50).cast("long")))
    d = segments.fold(d, ["user_id"], base=segments.last(F.when(F.col("value") < 50, F.col("up"))))
    return d.select("event_id", (F.col("up") - F.coalesce("base", F.lit(0))).alias("run"))


@query(
    "gap_metrics",
    """WITH d AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS dt FROM events)
    SELECT user_id, count(*) AS n, CAST(sum(CASE WHEN dt > 3600 THEN 1 ELSE 0 END) AS BIGINT) AS n_gaps, round(max(dt), 6) AS max_gap, round(avg(dt), 6) AS mean_gap,
    round(100.0 * sum(CASE WHEN dt > 3600 THEN 1 ELSE 0 END) / nullif(count(dt), 0), 6) AS gap_pct, round(1.0 / median(CASE WHEN dt > 0 THEN dt END), 9) AS frequency FROM d GROUP BY user_id""",
)
def gap_metrics(spark, sf_dir):
    d = series.gaps(events(spark, sf_dir).select("event_id", "user_id", "ts"), "user_id", "ts", ORDER, 3600)
    return d.select("user_id", "n", "n_gaps", r6("max_gap").alias("max_gap"), r6("mean_gap").alias("mean_gap"), r6("gap_pct").alias("gap_pct"), F.round("frequency", 9).alias("frequency"))


@query(
    "trapezoid_energy",
    """WITH d AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS dt, (value + lag(value) OVER w) / 2 AS mid FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, round(sum(mid * dt), 2) AS energy, round(sum(dt), 4) AS duration, round(sum(mid * dt) / nullif(sum(dt), 0), 6) AS power FROM d GROUP BY user_id""",
)
def trapezoid_energy(spark, sf_dir):
    d = series.trapezoid(events(spark, sf_dir).select("event_id", "user_id", "ts", "value"), "user_id", "value", "ts", ORDER)
    return d.select("user_id", F.round("energy", 2).alias("energy"), F.round("duration", 4).alias("duration"), r6("power").alias("power"))


@query(
    "stability_gate",
    """WITH g AS (SELECT event_id, user_id, ts, abs(coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0)) <= 10 AS calm FROM events),
    c AS (SELECT event_id, sum(CASE WHEN calm THEN 1 ELSE 0 END) OVER w AS n, count(*) OVER w AS m FROM g WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 79 PRECEDING AND CURRENT ROW))
    SELECT event_id, n >= ceil(0.6 * m) AS stable FROM c""",
)
def stability_gate(spark, sf_dir):
    d = series.with_lag(events(spark, sf_dir).select("event_id", "user_id", "ts", "value"), "user_id", ORDER, before=F.col("value"))
    d = d.withColumn("calm", (F.abs(F.coalesce(F.col("value") - F.col("before"), F.lit(0.0))) <= 10).cast("int"))
    d, run = segments.framed(d, ["user_id"], ORDER, 79)
    frame = run.rowsBetween(-79, 0)
    return d.withColumn("stable", F.sum("calm").over(frame) >= F.ceil(F.lit(0.6) * F.count(F.lit(1)).over(frame))).where("_own").select("event_id", "stable")


@query("windowed_drop", "SELECT event_id, coalesce(value - lag(value, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= -20, false) AS drop FROM events")
def windowed_drop(spark, sf_dir):
    d, run = segments.framed(events(spark, sf_dir).select("event_id", "user_id", "ts", "value"), ["user_id"], ORDER, 3)
    return d.withColumn("drop", F.coalesce(F.col("value") - F.lag("value", 3).over(run) <= -20, F.lit(False))).where("_own").select("event_id", "drop")


@query(
    "peak_crossing",
    """WITH m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, max(value) OVER (PARTITION BY user_id) AS peak FROM events)
    SELECT user_id, peak, CAST(min(CASE WHEN value >= 0.9 * peak THEN r END) AS BIGINT) AS crossing FROM m GROUP BY user_id, peak""",
)
def peak_crossing(spark, sf_dir):
    d = segments.numbered(events(spark, sf_dir).select("event_id", "user_id", "ts", "value"), ["user_id"], ORDER)
    peaks = d.groupBy("user_id").agg(F.max("value").alias("peak"))
    met = d.join(peaks, "user_id").where(F.col("value") >= 0.9 * F.col("peak"))
    return peaks.join(met.groupBy("user_id").agg((F.min("i") + 1).alias("crossing")), "user_id", "left")


@query(
    "first_per_second",
    "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY event_id) AS r FROM events) WHERE r = 1",
)
def first_per_second(spark, sf_dir):
    d = events(spark, sf_dir).withColumn("t", F.date_trunc("hour", "ts"))
    return series.first_per_time(d, "user_id", "t", "event_id").select("event_id")


@query(
    "asof_nearest",
    """WITH q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view'),
    b AS (SELECT q.event_id, q.user_id, q.ts, v.ts AS bt, v.value AS bv FROM q ASOF LEFT JOIN v ON q.user_id = v.user_id AND q.ts >= v.ts),
    a AS (SELECT q.event_id, v.ts AS n_t, v.value AS av FROM q ASOF LEFT JOIN v ON q.user_id = v.user_id AND q.ts <= v.ts)
    SELECT b.user_id, b.event_id, CASE WHEN bt IS NULL THEN n_t WHEN n_t IS NULL OR epoch_us(ts) - epoch_us(bt) <= epoch_us(n_t) - epoch_us(ts) THEN bt ELSE n_t END AS "at",
    CASE WHEN bt IS NULL THEN av WHEN n_t IS NULL OR epoch_us(ts) - epoch_us(bt) <= epoch_us(n_t) - epoch_us(ts) THEN bv ELSE av END AS value FROM b JOIN a USING (event_id)""",
)
def asof_nearest(spark, sf_dir):
    e = events(spark, sf_dir)
    return series.nearest(e.where("event_type = 'error'"), e.where("event_type = 'view'"), "user_id", "ts", "ts", "value", "event_id")


@query(
    "resample_linear",
    """WITH p AS (SELECT user_id, epoch_us(ts) / 1e6 AS s, min(value) AS x FROM events GROUP BY 1, 2),
    n AS (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS s2, lead(x) OVER (PARTITION BY user_id ORDER BY s) AS x2 FROM p),
    g AS (SELECT user_id, unnest(generate_series(CAST(ceil(s / 7200) AS BIGINT), CAST(floor(s2 / 7200) AS BIGINT))) * 7200 AS grid, s, x, s2, x2 FROM n WHERE s2 IS NOT NULL)
    SELECT user_id, grid, round(min(x + (x2 - x) * (grid - s) / (s2 - s)), 6) AS value FROM g GROUP BY user_id, grid""",
)
def resample_linear(spark, sf_dir):
    return series.resample(events(spark, sf_dir), "user_id", "value", "ts", 7200).withColumn("value", r6("value"))


@query(
    "steady_blocks",
    """WITH c AS (SELECT *, CASE WHEN lag(value BETWEEN 10 AND 90) OVER w = (value BETWEEN 10 AND 90) THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM c),
    b AS (SELECT user_id, island, count(*) AS n, min(ts) AS start FROM i WHERE value BETWEEN 10 AND 90 GROUP BY user_id, island)
    SELECT user_id, n, start FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, start) AS r FROM b) WHERE r = 1""",
)
def steady_blocks(spark, sf_dir):
    """The longest steady run of each sensor, the first of equals."""
    calm = F.col("value").between(10, 90)
    d = series.islands(events(spark, sf_dir).select("event_id", "user_id", "ts", "value"), "user_id", ORDER, calm).where(calm).groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("start"))
    return d.groupBy("user_id").agg(F.max_by(F.struct("n", "start"), F.struct(F.col("n"), -F.unix_micros(F.col("start").cast("timestamp")))).alias("b")).select("user_id", "b.*")


@query("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("binary_counts", "SELECT event_type, CAST(sum(CASE WHEN value >= 50 THEN 0 ELSE 1 END) AS BIGINT) AS zeros, CAST(sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END) AS BIGINT) AS ones, round(100.0 * sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END) / count(*), 4) AS pct FROM events GROUP BY event_type")
def binary_counts(spark, sf_dir):
    one = (F.col("value") >= 50).cast("int")
    return events(spark, sf_dir).groupBy("event_type").agg(F.sum(1 - one).alias("zeros"), F.sum(one).alias("ones"), F.round(100.0 * F.sum(one) / F.count(F.lit(1)), 4).alias("pct"))


TYPES = ["click", "error", "purchase", "signup", "view"]


@query("pivot_counts", "SELECT user_id, " + ", ".join(f"CAST(sum(CASE WHEN event_type = '{t}' THEN 1 ELSE 0 END) AS BIGINT) AS {t}" for t in TYPES) + " FROM events GROUP BY user_id")
def pivot_counts(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id").pivot("event_type", TYPES).count().na.fill(0)


@query("crosstab_share", "SELECT user_id, event_type, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS share FROM events GROUP BY user_id, event_type")
def crosstab_share(spark, sf_dir):
    d = events(spark, sf_dir).groupBy("user_id", "event_type").count()
    return d.select("user_id", "event_type", r6(F.col("count") / F.sum("count").over(Window.partitionBy("user_id"))).alias("share"))


@query("daily_counts", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def daily_counts(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), r6(F.avg("value")).alias("mean"))


@query("hourly_windows", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n, round(max(value), 6) AS high FROM events GROUP BY 1")
def hourly_windows(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), r6(F.max("value")).alias("high"))


@query("distinct_days", "SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events")
def distinct_days(spark, sf_dir):
    return events(spark, sf_dir).select("user_id", F.to_date("ts").alias("day")).distinct()


@query(
    "scored_dedup",
    "SELECT user_id, day, event_id FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, event_id) AS r FROM events) WHERE r = 1",
)
def scored_dedup(spark, sf_dir):
    """One row a cycle, scored ones first."""
    d = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    order = Window.partitionBy("user_id", "day").orderBy(F.when(F.col("event_type") == "purchase", 0).otherwise(1), "event_id")
    return d.withColumn("r", F.row_number().over(order)).where("r = 1").select("user_id", "day", "event_id")


@query("newest", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 100")
def newest(spark, sf_dir):
    return events(spark, sf_dir).orderBy(F.desc_nulls_last("ts"), "event_id").limit(100).select("event_id", "ts")


@query("paging", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 50 OFFSET 200")
def paging(spark, sf_dir):
    return events(spark, sf_dir).orderBy(F.desc("value"), "event_id").offset(200).limit(50).select("event_id", "value")


@query("last_known", "SELECT user_id, arg_max(value, ts) FILTER (WHERE event_type = 'view') AS last_view, avg(CASE WHEN value > 300 THEN NULL ELSE value END) AS mean, greatest(1, count(DISTINCT event_type)) AS kinds FROM events GROUP BY user_id")
def last_known(spark, sf_dir):
    view = F.max_by(F.when(F.col("event_type") == "view", F.col("value")), F.when(F.col("event_type") == "view", F.struct("ts", "event_id")))
    return events(spark, sf_dir).groupBy("user_id").agg(view.alias("last_view"), F.avg(F.when(F.col("value") <= 300, F.col("value"))).alias("mean"), F.greatest(F.lit(1), F.count_distinct("event_type")).alias("kinds"))


@query("cumulative", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total, round(avg(value) OVER (PARTITION BY user_id), 6) AS mean FROM events")
def cumulative(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "ts", "value")
    d = segments.fold(segments.segmented(e, ["user_id"], ORDER), ["user_id"], total=segments.running_sum(F.col("value")))
    return d.join(e.groupBy("user_id").agg(F.avg("value").alias("mean")), "user_id").select("event_id", F.round("total", 4).alias("total"), r6("mean").alias("mean"))


@query(
    "path_length",
    """WITH p AS (SELECT user_id, value / 10 AS lat, (event_id % 180) * 1.0 AS lon, ts, event_id FROM events WHERE value < 800),
    l AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, round(sum(2 * 6371.0 * asin(sqrt(least(pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2), 1.0)))), 3) AS km FROM l GROUP BY user_id""",
)
def path_length(spark, sf_dir):
    p = events(spark, sf_dir).where("value < 800").select("event_id", "user_id", "ts", (F.col("value") / 10).alias("lat"), (F.col("event_id") % 180).cast("double").alias("lon"))
    d = series.with_lag(p, "user_id", ORDER, la=F.col("lat"), lo=F.col("lon"))
    return d.groupBy("user_id").agg(F.round(F.sum(series.haversine(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon"))), 3).alias("km"))


@query(
    "phase_samples",
    """WITH p AS (SELECT event_id AS phase, user_id, epoch_us(ts) // 1000000 AS s FROM events WHERE event_type = 'purchase'), e AS (SELECT user_id, epoch_us(ts) // 1000000 AS at, value FROM events)
    SELECT phase, count(*) AS n, round(avg(value), 6) AS mean FROM p JOIN e ON e.user_id = p.user_id AND e.at BETWEEN p.s AND p.s + 43200 GROUP BY phase""",
)
def phase_samples(spark, sf_dir):
    """Samples within twelve hours of each purchase of the same user: a bucketed range join."""
    e = events(spark, sf_dir).withColumn("at", F.floor(series.seconds("ts")))
    phases = e.where("event_type = 'purchase'").select(F.col("event_id").alias("phase"), "user_id", F.col("at").alias("start"), (F.col("at") + 43200).alias("end"))
    return joins.range_join(e.select("user_id", "at", "value"), phases, "at", "start", "end", 43200, "user_id").groupBy("phase").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"))


@query(
    "sessions",
    """WITH i AS (SELECT user_id, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + 7200 AS b FROM events),
    n AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3600 OR lag(a) OVER (PARTITION BY user_id ORDER BY a, b) IS NULL THEN 1 ELSE 0 END AS c FROM i),
    s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM n)
    SELECT user_id, min(a) AS start, max(b) AS "end", count(*) AS n FROM s GROUP BY user_id, g""",
)
def sessions(spark, sf_dir):
    """Intervals of two hours, merged where they lie within an hour of each other."""
    i = events(spark, sf_dir).select("user_id", F.floor(series.seconds("ts")).alias("a")).withColumn("b", F.col("a") + 7200)
    return series.merge_intervals(i, "user_id", "a", "b", 3600)
