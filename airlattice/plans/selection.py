"""Queries that choose: robust distances, telling features, resampled neighbours, clusters by density, intervals that don't overlap."""

from __future__ import annotations

from math import log

from pyspark.sql import functions as F

from airlattice.operators import density, resampling, robust, series, statistics
from airlattice.session import table

from .catalog import query
from .telemetry import events

#: Rounds of concentration that the SQL spells out, the share that is kept, and the 97.5 percent bound for two columns.
ROUNDS, SHARE, BOUND = 6, 0.75, -2 * log(0.025)
D2 = "(d * (p_size - mx) * (p_size - mx) - 2 * b * (p_size - mx) * (p_retailprice - my) + a * (p_retailprice - my) * (p_retailprice - my)) / (a * d - b * b)"
CONCENTRATION = "".join(
    f""", m{r} AS (SELECT part.*, {D2} AS d2 FROM part, s{r}), q{r} AS (SELECT quantile_cont(d2, {SHARE}) AS t FROM m{r}),
    s{r + 1} AS (SELECT avg(p_size) AS mx, avg(p_retailprice) AS my, var_samp(p_size) AS a, var_samp(p_retailprice) AS d, covar_samp(p_size, p_retailprice) AS b FROM m{r}, q{r} WHERE d2 <= t)"""
    for r in range(ROUNDS)
)


@query(
    "robust_distance",
    f"""WITH c AS (SELECT median(p_size) AS mx, median(p_retailprice) AS my FROM part),
    s0 AS (SELECT mx, my, pow(1.4826 * median(abs(p_size - mx)), 2) AS a, pow(1.4826 * median(abs(p_retailprice - my)), 2) AS d, 0.0 AS b FROM part, c GROUP BY mx, my){CONCENTRATION}
    SELECT p_partkey, {D2} AS d2, {D2} > {BOUND} AS beyond FROM part, s{ROUNDS}""",
)
def robust_distance(spark, sf_dir):
    """Distances of parts from the concentrated three quarters of them, and which lie beyond the 97.5 percent ellipse."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    columns = ["p_size", "p_retailprice"]
    d2 = robust.distance(columns, *robust.concentrated(part, columns, SHARE, ROUNDS))
    return part.select("p_partkey", d2.alias("d2"), (d2 > BOUND).alias("beyond"))


@query(
    "group_distance",
    """WITH s AS (SELECT avg(p_size) AS mx, avg(p_retailprice) AS my, var_samp(p_size) AS a, var_samp(p_retailprice) AS d, covar_samp(p_size, p_retailprice) AS b FROM part WHERE p_brand = 'Brand#11'),
    g AS (SELECT p_brand, count(*) AS n, avg(p_size) AS x, avg(p_retailprice) AS y FROM part GROUP BY 1)
    SELECT p_brand, n, sqrt(greatest((d * (x - mx) * (x - mx) - 2 * b * (x - mx) * (y - my) + a * (y - my) * (y - my)) / (a * d - b * b), 0)) AS distance FROM g, s WHERE p_brand <> 'Brand#11'""",
)
def group_distance(spark, sf_dir):
    """How far each brand's centre is from the reference brand's, in that brand's covariance."""
    d = robust.group_distance(table(spark, sf_dir, "part"), "p_brand", "Brand#11", ["p_size", "p_retailprice"])
    return d.where("p_brand <> 'Brand#11'")


@query(
    "mutual_information",
    """WITH l AS (SELECT l_returnflag AS y, unnest([{'f': 'quantity', 'b': CAST(ceil(l_quantity / 5) AS BIGINT)}, {'f': 'discount', 'b': CAST(round(l_discount * 100) AS BIGINT)}, {'f': 'tax', 'b': CAST(round(l_tax * 100) AS BIGINT)}, {'f': 'year', 'b': year(l_shipdate)}, {'f': 'status', 'b': ascii(l_linestatus)}]) AS x FROM lineitem),
    j AS (SELECT x.f AS feature, x.b AS b, y, count(*) AS n_xy FROM l GROUP BY 1, 2, 3),
    w AS (SELECT *, sum(n_xy) OVER (PARTITION BY feature, b) AS n_x, sum(n_xy) OVER (PARTITION BY feature, y) AS n_y, sum(n_xy) OVER (PARTITION BY feature) AS n FROM j),
    m AS (SELECT feature, CAST(max(n) AS BIGINT) AS n, sum(n_xy / n * ln(n_xy * n / (n_x * n_y))) AS mi FROM w GROUP BY 1)
    SELECT *, row_number() OVER (ORDER BY mi DESC, feature) AS nth, row_number() OVER (ORDER BY mi DESC, feature) <= 3 AS kept FROM m""",
)
def mutual_information(spark, sf_dir):
    """What five features of a line tell about its return flag, and the best three of them."""
    bins = {"quantity": F.ceil(F.col("l_quantity") / 5), "discount": F.round(F.col("l_discount") * 100).cast("long"), "tax": F.round(F.col("l_tax") * 100).cast("long"), "year": F.year("l_shipdate"), "status": F.ascii("l_linestatus")}
    return statistics.best_features(statistics.mutual_information(table(spark, sf_dir, "lineitem"), bins, F.col("l_returnflag")), "mi", 3)


def _near(queries: str, k: int, name: str) -> str:
    """SQL: the k nearest vectors of each query vector."""
    return f"""{name} AS (SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, a.label AS own, b.label AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))), b.vec_id) AS nth
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE {queries}) WHERE nth <= {k})"""


QUERIES = "a.vec_id % 20 = 0"


def vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v, v.where("vec_id % 20 = 0")


@query("tomek_links", f"WITH {_near(QUERIES, 1, 'k')}, {_near('a.vec_id IN (SELECT id FROM k)', 1, 'r')} SELECT k.query_id, k.own, k.id, k.other FROM k JOIN r ON r.query_id = k.id AND r.id = k.query_id WHERE k.own IS DISTINCT FROM k.other")
def tomek_links(spark, sf_dir):
    """Queries and vectors of different labels that are each other's nearest."""
    return resampling.tomek_links(*vectors(spark, sf_dir), "vec_id", "embedding", "label")


@query("edited_neighbours", f"WITH {_near(QUERIES, 3, 'k')} SELECT query_id, own, CAST(sum(CASE WHEN own = other THEN 1 ELSE 0 END) AS BIGINT) AS same, 2 * sum(CASE WHEN own = other THEN 1 ELSE 0 END) >= count(*) AS kept FROM k GROUP BY 1, 2")
def edited_neighbours(spark, sf_dir):
    """Queries that most of their three nearest contradict are not kept."""
    return resampling.edited(*vectors(spark, sf_dir), "vec_id", "embedding", "label")


@query(
    "adaptive_quotas",
    f"""WITH {_near(QUERIES + ' AND a.label = 1', 5, 'k')}, f AS (SELECT query_id, CAST(sum(CASE WHEN other IS DISTINCT FROM own THEN 1 ELSE 0 END) AS BIGINT) AS foreign_ FROM k GROUP BY 1)
    SELECT query_id, foreign_ AS "foreign", CAST(floor(coalesce(foreign_ / nullif(sum(foreign_) OVER (), 0), 0) * 1000 + 0.5) AS BIGINT) AS quota FROM f""",
)
def adaptive_quotas(spark, sf_dir):
    """How many of a thousand new vectors of label 1 each query of that label should give."""
    return resampling.adaptive_quotas(*vectors(spark, sf_dir), "vec_id", "embedding", "label", 1, 1000)


@query("reverse_cleaned", f"WITH {_near(QUERIES, 5, 'k')}, n AS (SELECT id, count(*) AS n FROM k GROUP BY 1) SELECT vec_id, coalesce(n, 0) AS n, n IS NOT NULL AS kept FROM embeddings LEFT JOIN n ON id = vec_id")
def reverse_cleaned(spark, sf_dir):
    """Vectors that are near no query are left out."""
    return resampling.reverse_cleaned(*vectors(spark, sf_dir), "vec_id", "embedding")


EPS, LEAST = 0.03, 6


@query(
    "density_clusters",
    f"""WITH RECURSIVE p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
    e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {EPS * EPS}),
    c AS MATERIALIZED (SELECT a FROM e GROUP BY a HAVING count(*) >= {LEAST}), l AS MATERIALIZED (SELECT a, b FROM e WHERE a IN (FROM c) AND b IN (FROM c)),
    r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b), k AS (SELECT a AS id, min(b) AS cluster FROM r GROUP BY 1),
    n AS (SELECT e.a AS id, min(cluster) AS cluster FROM e JOIN k ON k.id = e.b WHERE e.a NOT IN (FROM c) GROUP BY 1)
    SELECT vec_id AS id, coalesce(k.cluster, n.cluster) AS cluster, k.cluster IS NOT NULL AS core FROM p LEFT JOIN k ON k.id = vec_id LEFT JOIN n ON n.id = vec_id""",
)
def density_clusters(spark, sf_dir):
    """Clusters of the vectors' first two components."""
    x = F.slice("embedding", 1, 2)
    return density.dbscan(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), x.cast("array<double>").alias("x")), EPS, LEAST, 2)


@query(
    "greedy_intervals",
    """WITH RECURSIVE i AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + 3600 * (1 + event_id % 48) AS b FROM events),
    c AS (SELECT user_id, min({'b': b, 'e': event_id}) AS m FROM i GROUP BY 1
      UNION ALL SELECT c.user_id, min({'b': i.b, 'e': i.event_id}) FROM c JOIN i ON i.user_id = c.user_id AND i.a >= c.m.b GROUP BY 1)
    SELECT i.* FROM c JOIN i ON i.event_id = c.m.e""",
)
def greedy_intervals(spark, sf_dir):
    """Of each sensor's recordings as many as don't overlap, the next to end first."""
    a = F.floor(series.seconds("ts"))
    d = events(spark, sf_dir).select("user_id", "event_id", a.alias("a"), (a + 3600 * (1 + F.col("event_id") % 48)).alias("b"))
    return series.greedy_intervals(d, "user_id", "a", "b", "event_id")
