"""Queries on filters, joins by interval and label, unions, reshaping and scalar families."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlattice.operators import cleaning, joins, segments, series
from airlattice.session import table

from .catalog import query
from .telemetry import ORDER, events, r6


def micros(time: str):
    return F.unix_micros(F.col(time).cast("timestamp"))


# --- filters ---------------------------------------------------------------------------------------------------


@query("leak_guard", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def leak_guard(spark, sf_dir):
    """No label reaches a model's input."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    return cleaning.without_labels(d, ["l_returnflag", "l_linestatus", "label"])


@query("clean_rows", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_discount > 0.08) AND NOT (l_tax > 0.06) AND l_returnflag <> 'R' AND NOT (l_quantity > 45)")
def clean_rows(spark, sf_dir):
    flags = [F.col("l_discount") > 0.08, F.col("l_tax") > 0.06, F.col("l_returnflag") == "R", F.col("l_quantity") > 45]
    return table(spark, sf_dir, "lineitem").where(cleaning.no_flag(flags)).select("l_orderkey", "l_linenumber")


@query(
    "cutoff_split",
    """SELECT o_orderkey, CASE WHEN t0 < TIMESTAMP '1997-01-01' THEN 'before' ELSE 'after' END AS side, strftime(t0, '%Y-%m') AS month FROM (
    SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END, CASE WHEN o_orderpriority < '3' THEN o_orderdate + INTERVAL 1 DAY END, TIMESTAMP '1996-06-01') AS t0 FROM orders)""",
)
def cutoff_split(spark, sf_dir):
    """Time by fallback, then the side of a cut-off and the month."""
    day = F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")
    at = F.coalesce(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")), F.when(F.col("o_orderpriority") < "3", day), F.lit("1996-06-01").cast("timestamp_ntz"))
    d = table(spark, sf_dir, "orders").select("o_orderkey", at.alias("at"))
    return d.select("o_orderkey", F.when(F.col("at") < F.lit("1997-01-01").cast("timestamp_ntz"), "before").otherwise("after").alias("side"), F.date_format("at", "yyyy-MM").alias("month"))


@query("last_days", "SELECT event_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-30' - 7 AND CAST(ts AS DATE) <= DATE '2024-01-30'")
def last_days(spark, sf_dir):
    """The last seven days before a given anchor."""
    anchor = F.lit("2024-01-30").cast("date")
    return events(spark, sf_dir).where(F.to_date("ts").between(F.date_sub(anchor, 7), anchor)).select("event_id")


@query("allow_list", "SELECT event_id, user_id FROM events WHERE user_id IN (1, 3, 5, 8)")
def allow_list(spark, sf_dir):
    return events(spark, sf_dir).where(F.col("user_id").isin(1, 3, 5, 8)).select("event_id", "user_id")


@query("whitelist_projection", "SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name, CAST(NULL AS DOUBLE) AS c_discount, c_acctbal FROM customer")
def whitelist_projection(spark, sf_dir):
    return cleaning.project(table(spark, sf_dir, "customer"), {"c_custkey": "double", "c_name": "string", "c_discount": "double", "c_acctbal": "double"})


@query("band_filter", "SELECT event_id, CASE WHEN abs(value - 53.46) < 0.5 THEN NULL ELSE value END AS value FROM events WHERE NOT (value BETWEEN 20 AND 21)")
def band_filter(spark, sf_dir):
    v = F.col("value")
    return events(spark, sf_dir).where(~v.between(20, 21)).select("event_id", cleaning.without_stuck(v, 53.46, 0.5).alias("value"))


@query("binary_discovery", " UNION ALL ".join(f"SELECT '{c}' AS name FROM labels HAVING bool_and({c} IN (0, 1))" for c in ("doc_id", "quality", "toxic")))
def binary_discovery(spark, sf_dir):
    found = cleaning.binary_columns(table(spark, sf_dir, "labels"), ["doc_id", "quality", "toxic"])
    return spark.createDataFrame([(c,) for c in found], "name string")


@query("columns_like", "SELECT l_extendedprice, l_shipdate FROM lineitem")
def columns_like(spark, sf_dir):
    """Columns by parts of their names."""
    d = table(spark, sf_dir, "lineitem")
    return d.select(*cleaning.named_like(d, ["price", "date"]))


@query("finite_scrub", "SELECT event_id, CASE WHEN value > 90 OR value < 1 THEN NULL ELSE value END AS value, greatest(0.0, least(value, 1.5)) AS clamped FROM events")
def finite_scrub(spark, sf_dir):
    v = F.col("value")
    x = F.when(v > 90, float("inf")).when(v < 1, float("nan")).otherwise(v)
    return events(spark, sf_dir).select("event_id", cleaning.finite(x).alias("value"), cleaning.clamp(v, 0.0, 1.5).alias("clamped"))


@query("valid_dates", "SELECT event_id, ts, ts < TIMESTAMP '2024-01-03' OR ts >= TIMESTAMP '2024-01-25' AS invalid FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-28'")
def valid_dates(spark, sf_dir):
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    d = events(spark, sf_dir).where((F.col("ts") >= t("2024-01-02")) & (F.col("ts") < t("2024-01-28")))
    return d.select("event_id", "ts", ((F.col("ts") < t("2024-01-03")) | (F.col("ts") >= t("2024-01-25"))).alias("invalid"))


# --- series ----------------------------------------------------------------------------------------------------

AFTER = """SELECT event_id, wait, CASE WHEN bt IS NULL THEN at_ WHEN at_ IS NULL OR epoch_us(ts) - epoch_us(bt) <= epoch_us(at_) - epoch_us(ts) THEN bt ELSE at_ END AS "at",
    CASE WHEN bt IS NULL THEN av WHEN at_ IS NULL OR epoch_us(ts) - epoch_us(bt) <= epoch_us(at_) - epoch_us(ts) THEN bv ELSE av END AS value FROM x"""


@query(
    "after_checks",
    f"""WITH w AS (SELECT unnest([20, 60]) AS wait), q AS (SELECT event_id * 100 + wait AS tie, event_id, wait, user_id, ts + to_minutes(wait) AS ts FROM events, w WHERE event_type = 'purchase'),
    v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view'),
    b AS (SELECT q.*, v.ts AS bt, v.value AS bv FROM q ASOF LEFT JOIN v ON q.user_id = v.user_id AND q.ts >= v.ts),
    a AS (SELECT q.tie, v.ts AS at_, v.value AS av FROM q ASOF LEFT JOIN v ON q.user_id = v.user_id AND q.ts <= v.ts), x AS (SELECT * FROM b JOIN a USING (tie)), n AS ({AFTER})
    SELECT n.event_id, n.wait, n."at", n.value, round(abs(epoch_us(n."at") - epoch_us(x.ts)) / 1e6, 3) AS gap FROM n JOIN x USING (event_id, wait)""",
)
def after_checks(spark, sf_dir):
    """The reading nearest to 20 and to 60 minutes after each purchase, and how far away it is in seconds."""
    e = events(spark, sf_dir)
    waits = F.explode(F.array(F.lit(20), F.lit(60))).alias("wait")
    asked = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts", waits).withColumn("ts", F.expr("ts + make_dt_interval(0, 0, wait, 0)")).withColumn("tie", F.col("event_id") * 100 + F.col("wait"))
    met = series.nearest(asked, e.where("event_type = 'view'"), "user_id", "ts", "ts", "value", "tie")
    gap = F.round(F.abs(micros("at") - micros("ts")) / 1e6, 3)
    return met.select("tie", "at", "value").join(asked.select("tie", "event_id", "wait", "ts"), "tie").select("event_id", F.col("wait").cast("long").alias("wait"), "at", "value", gap.alias("gap"))


@query("all_calm", "SELECT date_trunc('hour', ts) AS hour, bool_and(value < 90) AS calm, count(DISTINCT user_id) AS sensors FROM events GROUP BY 1")
def all_calm(spark, sf_dir):
    """Whether every sensor is calm, by hour."""
    return events(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.bool_and(F.col("value") < 90).alias("calm"), F.count_distinct("user_id").alias("sensors"))


@query(
    "gap_segments",
    """WITH d AS (SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 14400000000 THEN 1 ELSE 0 END AS c FROM events)
    SELECT event_id, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM d""",
)
def gap_segments(spark, sf_dir):
    """Lines split where four hours are missing."""
    d = segments.segmented(events(spark, sf_dir).select("event_id", "user_id", micros("ts").alias("at")), ["user_id"], ["at", "event_id"])
    d = segments.fold(d, ["user_id"], before=segments.lag(F.col("at")))
    gap = F.coalesce((F.col("at") - F.col("before") > 14_400_000_000).cast("long"), F.lit(0))
    return segments.fold(d, ["user_id"], segment=segments.running_sum(gap)).select("event_id", "segment")


@query("group_share", "SELECT event_id, value / avg(value) OVER (PARTITION BY user_id) AS share FROM events")
def group_share(spark, sf_dir):
    """Each value against its group's mean; the means are aggregated first and joined, so no group is one task's."""
    e = events(spark, sf_dir).select("event_id", "user_id", "value")
    m = e.groupBy("user_id").agg(F.avg("value").alias("m"))
    return e.join(m, "user_id").select("event_id", F.try_divide("value", "m").alias("share"))


@query(
    "padded_tiles",
    """WITH i AS (SELECT user_id, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + 600 AS b FROM events WHERE event_type = 'error'),
    n AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 10800 OR lag(a) OVER (PARTITION BY user_id ORDER BY a, b) IS NULL THEN 1 ELSE 0 END AS c FROM i),
    s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM n),
    m AS (SELECT user_id, min(a) - 21600 AS a, max(b) + 21600 AS b FROM s GROUP BY user_id, g)
    SELECT user_id, a AS start, b AS "end", unnest(generate_series(a // 86400, (b - 1) // 86400)) * 86400 AS tile FROM m""",
)
def padded_tiles(spark, sf_dir):
    """Intervals merged over gaps of three hours, padded by six on either side and cut into days."""
    i = events(spark, sf_dir).where("event_type = 'error'").select("user_id", F.floor(series.seconds("ts")).alias("a")).withColumn("b", F.col("a") + 600)
    m = series.merge_intervals(i, "user_id", "a", "b", 10_800).select("user_id", (F.col("start") - 21_600).alias("start"), (F.col("end") + 21_600).alias("end"))
    days = F.explode(F.sequence(F.floor(F.col("start") / 86_400), F.floor((F.col("end") - 1) / 86_400)))
    return m.withColumn("day", days).select("user_id", "start", "end", (F.col("day") * 86_400).alias("tile"))


# --- joins -----------------------------------------------------------------------------------------------------


@query("label_lookup", "SELECT event_id, coalesce(n_name, 'WV') AS role FROM events LEFT JOIN nation ON user_id = n_nationkey")
def label_lookup(spark, sf_dir):
    """Roles by sensor, with a default for unknown ones."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("user_id"), "n_name")
    return events(spark, sf_dir).join(n, "user_id", "left").select("event_id", F.coalesce("n_name", F.lit("WV")).alias("role"))


@query("unknown_sensors", "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 8)")
def unknown_sensors(spark, sf_dir):
    """Rows of sensors without a role are set apart, not given a default."""
    n = table(spark, sf_dir, "nation").where("n_nationkey < 8").select(F.col("n_nationkey").cast("long").alias("user_id"))
    return events(spark, sf_dir).join(n, "user_id", "left_anti").select("event_id", "user_id")


@query(
    "phase_pairs",
    """WITH p AS (SELECT event_id AS phase, user_id, unnest([1, 2, 3]) AS pair FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id, event_id % 3 + 1 AS pair, count(*) AS n, avg(value) AS m FROM events WHERE event_type = 'view' GROUP BY 1, 2),
    w AS (SELECT user_id, event_id % 3 + 1 AS pair, max(value) AS high FROM events WHERE event_type = 'click' GROUP BY 1, 2)
    SELECT phase, pair, coalesce(n, 0) AS n, round(m, 6) AS mean, round(high, 6) AS high FROM p LEFT JOIN b USING (user_id, pair) LEFT JOIN w USING (user_id, pair)""",
)
def phase_pairs(spark, sf_dir):
    """One row for each phase and pair, with both members' measures where they exist."""
    e = events(spark, sf_dir).withColumn("pair", (F.col("event_id") % 3 + 1).cast("int"))
    phases = e.where("event_type = 'purchase'").select(F.col("event_id").alias("phase"), "user_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("pair"))
    b = e.where("event_type = 'view'").groupBy("user_id", "pair").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"))
    w = e.where("event_type = 'click'").groupBy("user_id", "pair").agg(F.max("value").alias("high"))
    met = phases.join(b, ["user_id", "pair"], "left").join(w, ["user_id", "pair"], "left")
    return met.select("phase", "pair", F.coalesce("n", F.lit(0)).alias("n"), r6("m").alias("mean"), r6("high").alias("high"))


@query(
    "half_open_count",
    """SELECT p.event_id, count(v.event_id) AS n, count(v.event_id) > 0 AS any FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.user_id = p.user_id AND v.ts >= p.ts AND v.ts < p.ts + INTERVAL 1 HOUR GROUP BY p.event_id""",
)
def half_open_count(spark, sf_dir):
    """Views in the hour from each purchase on, its end left out."""
    e = events(spark, sf_dir).withColumn("at", micros("ts"))
    p = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("at").alias("a"), (F.col("at") + 3_600_000_000 - 1).alias("b"))
    met = joins.range_join(e.where("event_type = 'view'").select("user_id", "at"), p, "at", "a", "b", 3_600_000_000, "user_id").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    return p.select("event_id").join(met, "event_id", "left").select("event_id", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("any"))


@query(
    "interval_semi",
    "SELECT event_id FROM events p WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM events v WHERE v.event_type = 'error' AND v.user_id = p.user_id AND v.ts BETWEEN p.ts AND p.ts + INTERVAL 2 HOUR)",
)
def interval_semi(spark, sf_dir):
    """Purchases with an error within two hours, both ends included: the next error of the series tells."""
    e = events(spark, sf_dir).where("event_type IN ('purchase', 'error')").select("event_id", "user_id", "event_type", micros("ts").alias("at"))
    d = segments.segmented(e, ["user_id"], ["at", F.col("event_type") == "error"])
    d = segments.fold(d, ["user_id"], next=segments.next_(F.when(F.col("event_type") == "error", F.col("at"))))
    return d.where("event_type = 'purchase' AND next <= at + 7200000000").select("event_id")


@query(
    "table_diff",
    """WITH a AS (SELECT o_custkey, round(avg(o_totalprice), 2) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, round(avg(o_totalprice), 2) AS x FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    SELECT count(*) AS n, CAST(sum(CASE WHEN abs(a.x - b.x) > 10000 THEN 1 ELSE 0 END) AS BIGINT) AS n_beyond, round(max(abs(a.x - b.x)), 2) AS most FROM a JOIN b USING (o_custkey)""",
)
def table_diff(spark, sf_dir):
    part = lambda s: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.round(F.avg("o_totalprice"), 2).alias("x"))
    return joins.differences(part("F"), part("O"), ["o_custkey"], "x", 10_000).select("n", "n_beyond", F.round("most", 2).alias("most"))


@query(
    "group_deltas",
    """WITH a AS (SELECT p_brand, avg(p_retailprice) AS m, count(*) AS n FROM part WHERE p_size <= 25 GROUP BY 1), b AS (SELECT p_brand, avg(p_retailprice) AS m, count(*) AS n FROM part WHERE p_size > 25 GROUP BY 1)
    SELECT p_brand, round(a.m, 6) AS m_x, round(b.m, 6) AS m_y, a.n AS n_x, b.n AS n_y, round(b.m - a.m, 6) AS m_delta FROM a JOIN b USING (p_brand)""",
)
def group_deltas(spark, sf_dir):
    part = lambda where, side: table(spark, sf_dir, "part").where(where).groupBy("p_brand").agg(F.avg("p_retailprice").alias(f"m_{side}"), F.count(F.lit(1)).alias(f"n_{side}"))
    d = part("p_size <= 25", "x").join(part("p_size > 25", "y"), "p_brand")
    return d.select("p_brand", r6("m_x").alias("m_x"), r6("m_y").alias("m_y"), "n_x", "n_y", r6(F.col("m_y") - F.col("m_x")).alias("m_delta"))


@query(
    "catalog_merge",
    """WITH o AS (SELECT o_orderdate AS day, count(*) AS n, 'old' AS src FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1), n AS (SELECT o_orderdate AS day, count(*) AS n, 'new' AS src FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1)
    SELECT day, coalesce(n.n, o.n) AS n, coalesce(n.src, o.src) AS src FROM o FULL JOIN n USING (day)""",
)
def catalog_merge(spark, sf_dir):
    """Files by day: new entries update or append."""
    part = lambda where, src: table(spark, sf_dir, "orders").where(where).groupBy(F.col("o_orderdate").alias("day")).agg(F.struct(F.count(F.lit(1)).alias("n"), F.lit(src).alias("src")).alias(src))
    d = part("o_orderkey % 3 <> 0", "old").join(part("o_orderkey % 5 = 0", "new"), "day", "full").withColumn("x", F.coalesce("new", "old"))
    return d.select("day", "x.n", "x.src")


@query("first_label", "SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS label FROM orders WHERE o_orderpriority NOT LIKE '4%' GROUP BY 1")
def first_label(spark, sf_dir):
    """The first label that isn't empty, by id over phases."""
    d = table(spark, sf_dir, "orders").withColumn("label", F.when(~F.col("o_orderpriority").startswith("4"), F.col("o_orderpriority"))).where("label IS NOT NULL")
    return d.groupBy("o_custkey").agg(F.min_by("label", F.struct("o_orderdate", "o_orderkey")).alias("label"))


# --- unions and shape ------------------------------------------------------------------------------------------


@query("union_intersection", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, 0 AS origin FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, 1 FROM customer")
def union_intersection(spark, sf_dir):
    """Two tables on the columns that both have, with their origin."""
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS balance", "s_nationkey AS home")
    c = table(spark, sf_dir, "customer").selectExpr("c_mktsegment AS segment", "c_acctbal AS balance", "c_custkey AS id", "c_name AS name")
    return joins.union_common([s, c], "origin")


@query("concat_sources", "SELECT 0 AS source, p_partkey AS id, CAST(p_size AS DOUBLE) AS value, p_name AS note FROM part UNION ALL SELECT 1, s_suppkey, s_acctbal, NULL FROM supplier UNION ALL SELECT 2, o_orderkey, NULL, o_orderpriority FROM orders")
def concat_sources(spark, sf_dir):
    """Tables of unlike columns under one typed schema, numbered by source."""
    parts = [table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_size AS value", "p_name AS note"), table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_acctbal AS value"), table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderpriority AS note")]
    typed = [cleaning.project(p.withColumn("source", F.lit(i)), {"source": "int", "id": "long", "value": "double", "note": "string"}) for i, p in enumerate(parts)]
    return typed[0].unionByName(typed[1]).unionByName(typed[2])


@query("explode_files", "SELECT o_custkey, o_orderdate AS day, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) - 1 AS i, o_orderkey AS file FROM orders")
def explode_files(spark, sf_dir):
    """Lists of files by kit and day, laid out as rows."""
    nested = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderdate").alias("day")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("files"))
    return nested.select("o_custkey", "day", F.posexplode("files").alias("i", "file"))


@query("files_by_status", "SELECT o_orderdate AS day, " + ", ".join(f"coalesce(string_agg(CASE WHEN o_orderstatus = '{s}' THEN CAST(o_orderkey AS VARCHAR) END, ',' ORDER BY o_orderkey), '') AS {s}" for s in "FOP") + " FROM orders GROUP BY 1")
def files_by_status(spark, sf_dir):
    """A row a day, a column a status, with the list of files in each cell."""
    d = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("day")).pivot("o_orderstatus", list("FOP")).agg(F.array_sort(F.collect_list("o_orderkey")))
    return d.select("day", *[F.coalesce(F.array_join(F.col(s).cast("array<string>"), ","), F.lit("")).alias(s) for s in "FOP"])


@query("transpose", "WITH g AS (SELECT o_orderstatus AS s, CAST(count(*) AS DOUBLE) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1) SELECT 'n' AS measure, max(CASE WHEN s = 'F' THEN n END) AS F, max(CASE WHEN s = 'O' THEN n END) AS O, max(CASE WHEN s = 'P' THEN n END) AS P FROM g UNION ALL SELECT 'mean', max(CASE WHEN s = 'F' THEN mean END), max(CASE WHEN s = 'O' THEN mean END), max(CASE WHEN s = 'P' THEN mean END) FROM g")
def transpose(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
    return g.unpivot("o_orderstatus", ["n", "mean"], "measure", "x").groupBy("measure").pivot("o_orderstatus", list("FOP")).agg(F.first("x"))


@query("point_lookup", "SELECT event_id, user_id, value FROM events WHERE event_id = 42")
def point_lookup(spark, sf_dir):
    return events(spark, sf_dir).where("event_id = 42").select("event_id", "user_id", "value")


@query("role_order", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END, ts, event_id) AS nth FROM events")
def role_order(spark, sf_dir):
    rank = cleaning.role_rank(F.col("event_type"), ["view", "click", "purchase"])
    d = segments.numbered(events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type"), ["user_id"], [rank, *ORDER])
    return d.select("event_id", (F.col("i") + 1).alias("nth"))


@query("page_with_total", "SELECT event_id, value, (SELECT count(*) FROM events WHERE value > 50) AS total FROM events WHERE value > 50 ORDER BY value DESC, event_id LIMIT 50 OFFSET 100")
def page_with_total(spark, sf_dir):
    """A page and the number of rows over all pages."""
    d = events(spark, sf_dir).where("value > 50").select("event_id", "value")
    return d.orderBy(F.desc("value"), "event_id").offset(100).limit(min(50, 500)).withColumn("total", d.agg(F.count(F.lit(1))).scalar())


@query(
    "newest_scored",
    """SELECT user_id, day, event_id FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, event_id) AS r FROM events)
    WHERE r = 1 ORDER BY day DESC, user_id LIMIT 20""",
)
def newest_scored(spark, sf_dir):
    """The newest cycles, one row each, scored rows first: a report of twenty."""
    d = events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min_by("event_id", F.struct(F.when(F.col("event_type") == "purchase", 0).otherwise(1), "event_id")).alias("event_id"))
    return d.orderBy(F.desc("day"), "user_id").limit(20)


# --- scalars ---------------------------------------------------------------------------------------------------


@query("map_lookup", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS status FROM orders")
def map_lookup(spark, sf_dir):
    names = F.create_map(F.lit("F"), F.lit("final"), F.lit("O"), F.lit("open"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.try_element_at(names, F.col("o_orderstatus")).alias("status"))


@query(
    "array_ops",
    """WITH a AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS q FROM lineitem GROUP BY 1)
    SELECT l_orderkey, coalesce(list_position(list_transform(q, lambda x: x > 25), true), 0) AS first_high, len(q) - coalesce(list_position(list_reverse(list_transform(q, lambda x: x > 25)), true), len(q) + 1) + 1 AS last_high,
    q[-1] - q[1] AS delta, list_sum(q[1:3]) AS head, list_max(q) AS high, list_position(q, list_max(q)) AS argmax FROM a""",
)
def array_ops(spark, sf_dir):
    """First and last index of a condition, slices, ends and extremes of small arrays (the lines of an order)."""
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("s")).select("l_orderkey", F.col("s.l_quantity").alias("q"))
    high = F.transform("q", lambda x: x > 25)
    n = F.size("q")
    last = F.array_position(F.reverse(high), True)
    head = F.aggregate(F.slice("q", 1, 3), F.lit(0.0), lambda s, x: s + x)
    return a.select("l_orderkey", F.array_position(high, True).alias("first_high"), F.when(last > 0, n - last + 1).otherwise(0).alias("last_high"), (F.element_at("q", -1) - F.element_at("q", 1)).alias("delta"), head.alias("head"), F.array_max("q").alias("high"), F.array_position("q", F.array_max("q")).alias("argmax"))


@query("coercion", "SELECT p_partkey, TRY_CAST(right(p_brand, 2) AS INTEGER) AS brand_no, lower(trim(p_type)) IN ('economy', 'promo', 'true', '1', 'yes') AS truthy, greatest(0.0, least(1.0, p_retailprice / 1500)) AS clipped FROM part")
def coercion(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.right("p_brand", F.lit(2)).try_cast("int").alias("brand_no"), cleaning.truthy(F.col("p_type"), ["economy", "promo"]).alias("truthy"), cleaning.clamp(F.col("p_retailprice") / 1500, 0.0, 1.0).alias("clipped"))


@query(
    "quality_flags",
    """SELECT user_id, CAST(ts AS DATE) AS day, (epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7 < 40 AS invalid_duration, count(*) < 3 AS low_messages,
    100.0 * sum(CASE WHEN value > 90 THEN 1 ELSE 0 END) / count(*) > 10 AS high_share, max(value) > 60 AS is_moving FROM events GROUP BY 1, 2""",
)
def quality_flags(spark, sf_dir):
    minutes = (F.max(micros("ts")) - F.min(micros("ts"))) / 6e7
    share = 100.0 * F.sum((F.col("value") > 90).cast("int")) / F.count(F.lit(1))
    return events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg((minutes < 40).alias("invalid_duration"), (F.count(F.lit(1)) < 3).alias("low_messages"), (share > 10).alias("high_share"), (F.max("value") > 60).alias("is_moving"))


@query(
    "series_json",
    """WITH a AS (SELECT user_id, CAST(ts AS DATE) AS day, list(round(value, 4) ORDER BY ts, event_id) AS v FROM events GROUP BY 1, 2) SELECT user_id, day, '[' || array_to_string(list_transform(v[1:4], lambda x: CAST(x AS VARCHAR)), ',') || ']' AS series FROM a""",
)
def series_json(spark, sf_dir):
    """Up to four readings of each day as a JSON array, rounded to four decimals."""
    d = events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.slice(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), 1, 4).alias("s"))
    return d.select("user_id", "day", F.to_json(F.transform("s.value", lambda x: F.round(x, 4))).alias("series"))
