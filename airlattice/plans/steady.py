"""Queries on smoothed series: the zero-phase filter, filled gaps, and sensor roles from a kit's steady window.

Sensors report every few hours in ``events``, so the grid is two hours wide and the other rules follow it; four
neighbouring users are a kit.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from airlattice.operators import filters, roles, segments, series

from .catalog import query
from .telemetry import ORDER, events

STEP = 7200.0
RULES = roles.Rules(rate=1 / STEP, cutoff=1 / (5 * STEP), slope=4e-5, reach=129_600.0, shortest=3 * STEP, longest=2880.0, full=4.6, empty=3.0)
B, A = (x.tolist() for x in filters.butterworth(4, 1, 5))
REST = filters.Filter.of(*filters.butterworth(4, 1, 5)).rest().tolist()


def _pass(name: str, source: str) -> str:
    """A pass of the filter in SQL: rows (sensor, r from 1, x) of ``source`` to (sensor, r, x, y), from rest at the first value."""

    def step(s: list[str], x: str) -> str:
        y = f"({B[0]!r} * {x} + {s[0]})"
        return f"{y} AS y, " + ", ".join(f"{s[k + 1] if k < 3 else '0.0'} + {B[k + 1]!r} * {x} - {A[k + 1]!r} * {y} AS s{k}" for k in range(4))

    first, later = [f"{z!r} * x" for z in REST], [f"f.s{k}" for k in range(4)]
    return f"""{name} AS (SELECT sensor, r, x, {step(first, 'x')} FROM {source} WHERE r = 1
      UNION ALL SELECT o.sensor, o.r, o.x, {step(later, 'o.x')} FROM {name} f JOIN {source} o ON o.sensor = f.sensor AND o.r = f.r + 1)"""


#: Zero-phase filter of ``series`` (sensor, i from 0, x), as ``smooth`` (sensor, i, y).
SMOOTH = f"""n AS MATERIALIZED (SELECT *, max(i) OVER (PARTITION BY sensor) AS l, arg_min(x, i) OVER (PARTITION BY sensor) AS h, arg_max(x, i) OVER (PARTITION BY sensor) AS e FROM series),
    wide AS (SELECT sensor, i AS p, x FROM n WHERE l >= 15 UNION ALL SELECT sensor, -i, 2 * h - x FROM n WHERE l >= 15 AND i BETWEEN 1 AND 15 UNION ALL SELECT sensor, 2 * l - i, 2 * e - x FROM n WHERE l >= 15 AND i BETWEEN l - 15 AND l - 1),
    up AS MATERIALIZED (SELECT sensor, p + 16 AS r, x FROM wide), {_pass('ahead', 'up')},
    down AS MATERIALIZED (SELECT sensor, max(r) OVER (PARTITION BY sensor) + 1 - r AS r, y AS x FROM ahead), {_pass('back', 'down')},
    smooth AS MATERIALIZED (SELECT n.sensor, n.i, coalesce(back.y, n.x) AS y FROM n LEFT JOIN back ON back.sensor = n.sensor AND back.r = n.l + 16 - n.i)"""


@query(
    "zero_phase",
    f"""WITH RECURSIVE series AS (SELECT event_id, user_id AS sensor, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS x FROM events), {SMOOTH}
    SELECT event_id, round(y, 5) AS y FROM series JOIN smooth USING (sensor, i)""",
)
def zero_phase(spark, sf_dir):
    """Each sensor's readings, low-passed forwards and backwards at a fifth of their rate."""
    d = segments.numbered(events(spark, sf_dir).select("event_id", "user_id", "ts", "value"), ["user_id"], ORDER)
    return filters.zero_phase(d, ["user_id"], "i", "value", 1, 5, "y").select("event_id", F.round("y", 5).alias("y"))


@query(
    "inpaint",
    """WITH d AS (SELECT user_id, epoch_us(ts) // 86400000000 AS day, avg(value) AS y FROM events GROUP BY 1, 2), s AS (SELECT user_id, min(day) AS a, max(day) AS b FROM d GROUP BY 1),
    g AS (SELECT user_id, unnest(generate_series(a - 1, b + 1)) AS day FROM s),
    w AS (SELECT user_id, day, y, last_value(CASE WHEN y IS NOT NULL THEN {'p': day, 'v': y} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day) AS b, first_value(CASE WHEN y IS NOT NULL THEN {'p': day, 'v': y} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM g LEFT JOIN d USING (user_id, day))
    SELECT user_id, day, y IS NULL AS filled, round(coalesce(y, b.v + (a.v - b.v) * (day - b.p) / (a.p - b.p), b.v, a.v), 5) AS y FROM w""",
)
def inpaint(spark, sf_dir):
    """Daily means of each sensor, missing days filled between their neighbours and held for a day beyond either end."""
    d = events(spark, sf_dir).groupBy("user_id", F.floor(series.seconds("ts") / 86_400).alias("day")).agg(F.avg("value").alias("y"))
    span = d.groupBy("user_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    grid = span.select("user_id", F.explode(F.sequence(F.col("a") - 1, F.col("b") + 1)).alias("day")).join(d, ["user_id", "day"], "left").withColumn("filled", F.col("y").isNull())
    return roles.inpainted(grid, ["user_id"], "day", "y").select("user_id", "day", "filled", F.round("y", 5).alias("y"))


def samples(spark, sf_dir):
    return events(spark, sf_dir).select(F.floor(F.col("user_id") / 4).alias("kit"), F.col("user_id").alias("sensor"), series.seconds("ts").alias("t"), (F.col("value") / 10).alias("p"), F.col("event_id").alias("seq"))


#: Grid, filter, steady instants and windows, with the rules above.
WINDOWS = f"""WITH RECURSIVE s AS (SELECT user_id // 4 AS kit, user_id AS sensor, epoch_us(ts) / 1e6 AS t, arg_min(value / 10, event_id) AS p FROM events GROUP BY 1, 2, 3),
    e AS (SELECT kit, sensor, min(t) AS lo, max(t) AS hi, count(*) AS n FROM s GROUP BY 1, 2),
    k AS (SELECT kit, max(lo) AS t0, CAST(ceil((min(hi) - max(lo)) / {STEP} + 1) AS BIGINT) AS m FROM e GROUP BY kit HAVING min(n) >= 2 AND max(lo) < min(hi)),
    a AS (SELECT s.*, lead(t) OVER w AS t2, lead(p) OVER w AS p2, t0, m FROM s JOIN k USING (kit) WINDOW w AS (PARTITION BY sensor ORDER BY t)),
    b AS (SELECT *, unnest(generate_series(CAST(greatest(ceil((t - t0) / {STEP}), 0) AS BIGINT), CAST(least(coalesce(ceil((t2 - t0) / {STEP}), m) - 1, m - 1) AS BIGINT))) AS g FROM a),
    c AS (SELECT kit, sensor, g, t0 + g * {STEP} AS at_, CASE WHEN t0 + g * {STEP} = t THEN p ELSE p + (p2 - p) * (t0 + g * {STEP} - t) / (t2 - t) END AS y, least(t0 + g * {STEP} - t, t2 - t0 - g * {STEP}) <= {RULES.reach} AS near FROM b),
    series AS MATERIALIZED (SELECT kit, sensor, g AS i, at_, near, coalesce(y, last_value(y IGNORE NULLS) OVER (PARTITION BY sensor ORDER BY g)) AS x FROM c),
    {SMOOTH},
    f AS (SELECT kit, sensor, i AS g, at_, near, CASE WHEN near THEN y END AS y FROM series JOIN smooth USING (sensor, i)),
    z AS MATERIALIZED (SELECT *, near AND coalesce(abs(CASE WHEN g = 0 THEN 0 ELSE (y - lag(y) OVER (PARTITION BY sensor ORDER BY g)) / {STEP} END) < {RULES.slope}, false) AS steady FROM f),
    q AS (SELECT kit, g, bool_and(steady) AS steady, max(y) AS top FROM z GROUP BY kit, g),
    o AS (SELECT *, g - row_number() OVER (PARTITION BY kit ORDER BY g) AS block FROM q WHERE steady),
    v AS (SELECT kit, min(g) AS a, max(g) AS b, arg_max(g, (top, -g)) AS peak FROM o GROUP BY kit, block HAVING max(top) > {RULES.full}),
    y AS (SELECT kit, a, b, peak FROM (SELECT *, row_number() OVER (PARTITION BY kit ORDER BY ((b - a) * {STEP} >= {RULES.shortest}) DESC, b - a DESC, a) AS nth FROM v) WHERE nth = 1),
    win AS MATERIALIZED (SELECT kit, CASE WHEN b - a + 1 > 24 THEN greatest(peak - 12, a) ELSE a END AS first_, CASE WHEN b - a + 1 > 24 THEN least(greatest(peak - 12, a) + 23, b) ELSE b END AS last_ FROM y)"""


@query("steady_instants", f"{WINDOWS} SELECT kit, g, steady FROM q")
def steady_instants(spark, sf_dir):
    """Whether all sensors of a kit hold still, at each instant of its grid; one out of reach of a sample doesn't."""
    return roles.smoothed(samples(spark, sf_dir), RULES).groupBy("kit", "g").agg(F.bool_and("steady").alias("steady"))


@query("steady_windows", f"{WINDOWS} SELECT kit, first_ AS first, last_ AS last FROM win")
def steady_windows(spark, sf_dir):
    """Each kit's longest steady stretch above the filling pressure, cut to two days around its peak."""
    return roles.windows(roles.smoothed(samples(spark, sf_dir), RULES), RULES)


@query(
    "steady_roles",
    f"""{WINDOWS}, m AS (SELECT z.kit, z.sensor, median(y) AS mid, min(at_) AS start, max(at_) AS stop FROM z JOIN win USING (kit) WHERE g BETWEEN first_ AND last_ GROUP BY 1, 2),
    r AS (SELECT *, CASE WHEN mid > {RULES.full} THEN 'MBP' WHEN mid < {RULES.empty} THEN 'BC' ELSE 'WV' END AS guess, row_number() OVER (PARTITION BY kit ORDER BY mid DESC, sensor) AS top_, count(*) OVER (PARTITION BY kit) AS n_ FROM m),
    l AS (SELECT *, row_number() OVER (PARTITION BY kit ORDER BY CASE WHEN top_ = 1 THEN 1 ELSE 0 END, mid, sensor) AS low FROM r), all_ AS (SELECT DISTINCT user_id // 4 AS kit, user_id AS sensor FROM events)
    SELECT all_.kit, all_.sensor, round(mid, 5) AS mid, guess, CASE WHEN top_ = 1 THEN 'MBP' WHEN low <= (n_ - 1) // 2 THEN 'BC' WHEN top_ IS NOT NULL THEN 'WV' END AS role, round(start, 3) AS start, round(stop, 3) AS stop FROM all_ LEFT JOIN l USING (kit, sensor)""",
)
def steady_roles(spark, sf_dir):
    """Roles from the medians of the steady window."""
    d = roles.identify(samples(spark, sf_dir), RULES)
    return d.select("kit", "sensor", F.round("mid", 5).alias("mid"), "guess", "role", F.round("start", 3).alias("start"), F.round("end", 3).alias("stop"))
