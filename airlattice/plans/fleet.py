"""Fleet queries: rates by group, rankings, set operations, statistics and scoring on the relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from airlattice.operators import joins, statistics
from airlattice.session import table

from .catalog import query
from .telemetry import r6

RATE = "round(100.0 * sum(CASE WHEN {0} THEN 1 ELSE 0 END) / nullif(count(*), 0), 2)"


def pct(flag):
    return F.round(100.0 * F.sum(flag.cast("int")) / F.count(F.lit(1)), 2)


@query(
    "far_by_group",
    """SELECT n_name, l_linestatus, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS BIGINT) AS tn, count(*) AS n,
    round(100.0 * sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / count(*), 2) AS far
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name, l_linestatus""",
)
def far_by_group(spark, sf_dir):
    """False-alarm rate by nation and line status; lineitem is aggregated by supplier before it meets the dimensions."""
    bad = F.col("l_returnflag") == "R"
    l = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linestatus").agg(F.sum(bad.cast("int")).alias("fp"), F.sum((~bad).cast("int")).alias("tn"), F.count(F.lit(1)).alias("n"))
    d = l.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    out = d.groupBy("n_name", "l_linestatus").agg(F.sum("fp").alias("fp"), F.sum("tn").alias("tn"), F.sum("n").alias("n"))
    return out.withColumn("far", F.round(100.0 * F.col("fp") / F.col("n"), 2))


@query(
    "grouping_sets_rates",
    """SELECT l_shipmode_year AS year, l_linestatus, CAST(n AS BIGINT) AS n, rate FROM (
      SELECT year(l_shipdate) AS l_shipmode_year, l_linestatus, count(*) AS n, round(100.0 * sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) / count(*), 2) AS rate
      FROM lineitem GROUP BY GROUPING SETS ((year(l_shipdate)), (year(l_shipdate), l_linestatus)))""",
)
def grouping_sets_rates(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("long").alias("year"), "l_linestatus", "l_discount")
    return d.groupingSets([["year"], ["year", "l_linestatus"]], "year", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), pct(F.col("l_discount") > 0.05).alias("rate"))


@query(
    "rollup_totals",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
)
def rollup_totals(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


FLAGS = {"high_discount": "l_discount > 0.08", "high_tax": "l_tax > 0.06", "returned": "l_returnflag = 'R'", "bulk": "l_quantity > 45"}


@query("error_rates", " UNION ALL ".join(f"SELECT '{k}' AS flag, CAST(sum(CASE WHEN {v} THEN 1 ELSE 0 END) AS BIGINT) AS n, {RATE.format(v)} AS rate FROM lineitem" for k, v in FLAGS.items()))
def error_rates(spark, sf_dir):
    """Counts and rates of several flags, one scan, then long."""
    one = table(spark, sf_dir, "lineitem").agg(*[F.struct(F.sum(F.expr(v).cast("int")).alias("n"), pct(F.expr(v)).alias("rate")).alias(k) for k, v in FLAGS.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("flag"), F.col(k).alias("s")) for k in FLAGS])).alias("x")).select("x.flag", "x.s.n", "x.s.rate")


@query("class_means", "SELECT l_linestatus, round(avg(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END), 4) AS bad, round(avg(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END), 4) AS good, round(avg(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) - avg(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END), 4) AS diff FROM lineitem GROUP BY l_linestatus")
def class_means(spark, sf_dir):
    bad, good = (F.avg(F.when(c, F.col("l_extendedprice"))) for c in (F.col("l_returnflag") == "R", F.col("l_returnflag") != "R"))
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.round(bad, 4).alias("bad"), F.round(good, 4).alias("good"), F.round(bad - good, 4).alias("diff"))


@query("best_group", "SELECT p_brand, p_type, round(m, 6) AS mean FROM (SELECT p_brand, p_type, avg(p_retailprice) AS m, row_number() OVER (PARTITION BY p_brand ORDER BY avg(p_retailprice), p_type) AS r FROM part GROUP BY p_brand, p_type) WHERE r = 1")
def best_group(spark, sf_dir):
    """The type of least mean price of each brand."""
    m = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.avg("p_retailprice").alias("m"))
    return m.groupBy("p_brand").agg(F.min_by(F.struct("p_type", "m"), F.struct("m", "p_type")).alias("b")).select("p_brand", "b.p_type", r6("b.m").alias("mean"))


@query(
    "pair_stats",
    """SELECT l_suppkey, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, max(l_quantity) AS high,
    round(CASE WHEN count(*) >= 3 AND stddev_pop(l_quantity) > 1e-8 AND stddev_pop(l_extendedprice) > 1e-8 THEN corr(l_quantity, l_extendedprice) END, 6) AS corr FROM lineitem GROUP BY l_suppkey""",
)
def pair_stats(spark, sf_dir):
    q, p = "l_quantity", "l_extendedprice"
    safe = (F.count(F.lit(1)) >= 3) & (F.stddev_pop(q) > 1e-8) & (F.stddev_pop(p) > 1e-8)
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(q)).alias("mean"), r6(F.stddev_samp(q)).alias("std"), F.max(q).alias("high"), r6(F.when(safe, F.corr(q, p))).alias("corr"))


@query("quantile_summary", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 6) AS p5, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY l_returnflag")
def quantile_summary(spark, sf_dir):
    q = statistics.quantiles(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", {"p5": 0.05, "p50": 0.5, "p95": 0.95})
    return q.select("l_returnflag", *[r6(c).alias(c) for c in ("p5", "p50", "p95")])


@query(
    "moments",
    """WITH m AS (SELECT l_returnflag, avg(l_quantity) AS m FROM lineitem GROUP BY 1), c AS (SELECT l.l_returnflag, l_quantity - m AS d FROM lineitem l JOIN m USING (l_returnflag))
    SELECT l_returnflag, round(avg(d * d * d) / pow(avg(d * d), 1.5), 6) AS skew, round(avg(d * d * d * d) / pow(avg(d * d), 2) - 3, 6) AS kurtosis FROM c GROUP BY l_returnflag""",
)
def moments(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(r6(F.skewness("l_quantity")).alias("skew"), r6(F.kurtosis("l_quantity")).alias("kurtosis"))


COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for i, a in enumerate(COLS) for b in COLS[i + 1 :]))
def correlation_matrix(spark, sf_dir):
    return statistics.correlations(table(spark, sf_dir, "lineitem"), COLS).withColumn("corr", r6("corr"))


@query(
    "spearman",
    """WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part)
    SELECT round(corr(a, b), 6) AS spearman FROM r""",
)
def spearman(spark, sf_dir):
    d = statistics.average_rank(statistics.average_rank(table(spark, sf_dir, "part"), "p_size", "a"), "p_retailprice", "b")
    return d.agg(r6(F.corr("a", "b")).alias("spearman"))


@query("histogram", "SELECT CAST(floor(l_extendedprice / 5000) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_extendedprice") / 5000).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "iqr_filter",
    """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem GROUP BY 1)
    SELECT l_returnflag, count(*) AS before, CAST(sum(CASE WHEN l_extendedprice BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a) THEN 1 ELSE 0 END) AS BIGINT) AS after FROM lineitem JOIN q USING (l_returnflag) GROUP BY l_returnflag""",
)
def iqr_filter(spark, sf_dir):
    d = statistics.within_iqr(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", 0.5)
    return d.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("before"), F.sum(F.col("within").cast("int")).alias("after"))


@query(
    "normal_threshold",
    "SELECT p_brand, round(avg(p_retailprice) - 1.645 * stddev_samp(p_retailprice), 6) AS low, round(quantile_cont(p_retailprice, 0.95), 6) AS p95 FROM part GROUP BY p_brand",
)
def normal_threshold(spark, sf_dir):
    p = "p_retailprice"
    d = table(spark, sf_dir, "part")
    low = d.groupBy("p_brand").agg(r6(F.avg(p) - 1.645 * F.stddev_samp(p)).alias("low"))
    return low.join(statistics.quantiles(d, "p_brand", p, {"p95": 0.95}), "p_brand").select("p_brand", "low", r6("p95").alias("p95"))


@query(
    "mad_outliers",
    """WITH m AS (SELECT c_mktsegment, median(c_acctbal) AS m FROM customer GROUP BY 1), d AS (SELECT c.*, abs(c_acctbal - m) AS d FROM customer c JOIN m USING (c_mktsegment)),
    s AS (SELECT c_mktsegment, median(d) AS s FROM d GROUP BY 1) SELECT c_custkey FROM d JOIN s USING (c_mktsegment) WHERE 0.6745 * d > 1.2 * s""",
)
def mad_outliers(spark, sf_dir):
    return statistics.mad_outliers(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", 1.2).select("c_custkey")


@query(
    "mahalanobis_2d",
    """WITH s AS (SELECT avg(p_size) AS mx, avg(p_retailprice) AS my, var_samp(p_size) AS a, var_samp(p_retailprice) AS d, covar_samp(p_size, p_retailprice) AS b FROM part)
    SELECT p_partkey, round((d * (p_size - mx) * (p_size - mx) - 2 * b * (p_size - mx) * (p_retailprice - my) + a * (p_retailprice - my) * (p_retailprice - my)) / (a * d - b * b), 6) AS d2 FROM part, s""",
)
def mahalanobis_2d(spark, sf_dir):
    return statistics.mahalanobis(table(spark, sf_dir, "part"), "p_size", "p_retailprice").select("p_partkey", r6("d2").alias("d2"))


@query(
    "centroid_distance",
    """WITH u AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM u GROUP BY 1, 2), r AS (SELECT i, m FROM c WHERE label = 0)
    SELECT c.label, round(sqrt(sum((c.m - r.m) * (c.m - r.m))), 6) AS distance FROM c JOIN r USING (i) GROUP BY c.label""",
)
def centroid_distance(spark, sf_dir):
    return statistics.centroid_distances(table(spark, sf_dir, "embeddings"), "label", "embedding", 0).withColumn("distance", r6("distance"))


@query(
    "knn_join",
    """WITH d AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) AS s
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
    SELECT query_id, id, nth, round(s, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, id) AS nth FROM d) WHERE nth <= 5""",
)
def knn_join(spark, sf_dir):
    """Five nearest neighbours of the query set (every id divisible by 20) among all vectors."""
    v = table(spark, sf_dir, "embeddings")
    return joins.nearest_neighbours(v, v.where("vec_id % 20 = 0"), "vec_id", "embedding", 5).select("query_id", "id", F.col("nth").cast("long").alias("nth"), r6("distance").alias("distance"))


@query("rank_join", "WITH b AS (SELECT p_partkey, p_brand AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS pair FROM part), w AS (SELECT p_partkey AS other, p_brand AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS pair FROM part WHERE p_size > 25) SELECT k, pair, p_partkey, other FROM b JOIN w USING (k, pair)")
def rank_join(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    left, right = p.select("p_partkey", "p_size", F.col("p_brand").alias("k")), p.where("p_size > 25").select(F.col("p_partkey").alias("other"), "p_retailprice", F.col("p_brand").alias("k"))
    return joins.rank_join(left, right, [F.desc("p_size"), F.col("p_partkey")], [F.desc("p_retailprice"), F.col("other")], "k").select("k", F.col("pair").cast("long").alias("pair"), "p_partkey", "other")


@query(
    "interval_merge",
    """WITH i AS (SELECT o_custkey, epoch_us(o_orderdate) // 86400000000 AS a, epoch_us(o_orderdate) // 86400000000 + 20 AS b FROM orders),
    n AS (SELECT *, CASE WHEN max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= a THEN 0 ELSE 1 END AS c FROM i),
    s AS (SELECT *, sum(c) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM n)
    SELECT o_custkey, min(a) AS start, max(b) AS "end", count(*) AS n FROM s GROUP BY o_custkey, g""",
)
def interval_merge(spark, sf_dir):
    from airlattice.operators import series

    day = F.expr("unix_micros(CAST(o_orderdate AS TIMESTAMP)) div 86400000000")  # whole numbers cut towards zero, as in the SQL
    i = table(spark, sf_dir, "orders").select("o_custkey", day.alias("a")).withColumn("b", F.col("a") + 20)
    return series.merge_intervals(i, "o_custkey", "a", "b")


UPSERT = "SELECT o_custkey, o_orderpriority, {0} AS src, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE {1} GROUP BY 1, 2"


@query(
    "upsert_prefer_new",
    f"""WITH o AS ({UPSERT.format("'old'", "o_orderkey % 3 <> 0")}), n AS ({UPSERT.format("'new'", "o_orderkey % 3 <> 1")})
    SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.o_custkey = o.o_custkey AND n.o_orderpriority = o.o_orderpriority)""",
)
def upsert_prefer_new(spark, sf_dir):
    part = lambda name, where: table(spark, sf_dir, "orders").where(where).groupBy("o_custkey", "o_orderpriority").agg(F.lit(name).alias("src"), F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return joins.upsert(part("old", "o_orderkey % 3 <> 0"), part("new", "o_orderkey % 3 <> 1"), ["o_custkey", "o_orderpriority"], [F.col("n")])


@query("anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("presence_diff", "SELECT coalesce(a, b) AS id, CASE WHEN a IS NULL THEN 'right_only' WHEN b IS NULL THEN 'left_only' ELSE 'both' END AS presence FROM (SELECT DISTINCT o_custkey AS a FROM orders WHERE o_orderstatus = 'F') FULL JOIN (SELECT DISTINCT o_custkey AS b FROM orders WHERE o_orderstatus = 'O') ON a = b")
def presence_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "id")
    return joins.presence(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "id")


@query("union_align", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL AS segment, 'supplier' AS origin FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment, 'customer' FROM customer")
def union_align(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("origin"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("origin"))
    return s.unionByName(c, allowMissingColumns=True)


@query("set_ops", "SELECT 'except' AS op, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def set_ops(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    f, p = (o.where(F.col("o_orderstatus") == s).select("o_custkey") for s in ("F", "O"))
    return f.subtract(p).agg(F.count(F.lit(1)).alias("n")).select(F.lit("except").alias("op"), "n").unionAll(f.intersect(p).agg(F.count(F.lit(1)).alias("n")).select(F.lit("intersect"), "n"))


@query("melt", "SELECT p_partkey, 'p_size' AS name, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def melt(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return p.unpivot("p_partkey", ["p_size", "p_retailprice"], "name", "value")


@query("composite_key", "SELECT o_orderkey, concat_ws('|', coalesce(CAST(o_custkey AS VARCHAR), '<missing>'), o_orderpriority, strftime(o_orderdate, '%Y-%m-%d')) AS key, CAST(round(epoch(o_orderdate) / 604800.0) AS BIGINT) * 604800 AS rounded FROM orders")
def composite_key(spark, sf_dir):
    key = F.concat_ws("|", F.coalesce(F.col("o_custkey").cast("string"), F.lit("<missing>")), "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", key.alias("key"), (F.round(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6 / 604800.0) * 604800).cast("long").alias("rounded"))


@query("domain_reindex", "SELECT d AS status, n FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS d) LEFT JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) ON d = o_orderstatus")
def domain_reindex(spark, sf_dir):
    domain = spark.createDataFrame([(x,) for x in "FOPX"], "status string")
    return domain.join(table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n")), "status", "left")


@query("topk_mixed", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_returnflag, l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def topk_mixed(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").orderBy("l_returnflag", F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(25).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("argmax_row", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def argmax_row(spark, sf_dir):
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct(F.col("o_totalprice"), -F.col("o_orderkey")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.o_orderkey", "b.o_totalprice")


@query("weighted_rank", "WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS a, row_number() OVER (ORDER BY s_nationkey DESC, s_suppkey) AS b FROM supplier) SELECT s_suppkey, round(0.4 * a + 0.6 * b, 6) AS score FROM r ORDER BY score, s_suppkey LIMIT 20")
def weighted_rank(spark, sf_dir):
    """A report on suppliers: ranks by two measures, weighed. Ranks are running counts over ranges."""
    d = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey", F.lit(1).alias("one"))
    for name, x in (("a", "s_acctbal"), ("b", "s_nationkey")):
        d = statistics.running_sums(d, [F.desc_nulls_last(x), F.col("s_suppkey")], {"one": name})
    return d.select("s_suppkey", r6(0.4 * F.col("a") + 0.6 * F.col("b")).alias("score")).orderBy("score", "s_suppkey").limit(20)


@query("type_resolution", "SELECT l_suppkey, CASE WHEN count(DISTINCT l_returnflag) = 0 THEN 'Unknown' ELSE string_agg(DISTINCT l_returnflag, '+' ORDER BY l_returnflag) END AS types FROM lineitem GROUP BY l_suppkey")
def type_resolution(spark, sf_dir):
    t = F.array_join(F.array_sort(F.collect_set("l_returnflag")), "+")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.when(t == "", "Unknown").otherwise(t).alias("types"))


@query("nested_medians", "SELECT p_brand, round(median(CASE WHEN p_size > 25 THEN p_retailprice END), 6) AS a, round(median(CASE WHEN p_size <= 25 THEN p_retailprice END), 6) AS b, round(abs(median(CASE WHEN p_size > 25 THEN p_retailprice END) - median(CASE WHEN p_size <= 25 THEN p_retailprice END)), 6) AS separation FROM part GROUP BY p_brand")
def nested_medians(spark, sf_dir):
    d = table(spark, sf_dir, "part")
    a, b = (statistics.quantiles(d.select("p_brand", F.when(c, F.col("p_retailprice")).alias("x")), "p_brand", "x", {name: 0.5}) for name, c in (("a", F.col("p_size") > 25), ("b", F.col("p_size") <= 25)))
    return a.join(b, "p_brand").select("p_brand", r6("a").alias("a"), r6("b").alias("b"), r6(F.abs(F.col("a") - F.col("b"))).alias("separation"))


@query(
    "reference_difference",
    "WITH m AS (SELECT c_mktsegment, avg(c_acctbal) AS m FROM customer GROUP BY 1) SELECT m.c_mktsegment, round(m.m - r.m, 6) AS diff, round(100 * (m.m - r.m) / nullif(r.m, 0), 6) AS pct FROM m, (SELECT m FROM m WHERE c_mktsegment = 'BUILDING') r",
)
def reference_difference(spark, sf_dir):
    m = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("m"))
    r = F.max(F.when(F.col("c_mktsegment") == "BUILDING", F.col("m"))).over(Window.partitionBy(F.lit(1)))  # over the groups
    return m.withColumn("r", r).select("c_mktsegment", r6(F.col("m") - F.col("r")).alias("diff"), r6(F.try_divide(100 * (F.col("m") - F.col("r")), "r")).alias("pct"))


@query(
    "confusion_metrics",
    """WITH c AS (SELECT sum(CASE WHEN p AND toxic = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p AND toxic = 0 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN NOT p AND toxic = 1 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN NOT p AND toxic = 0 THEN 1 ELSE 0 END) AS tn
      FROM (SELECT toxic, doc_id % 3 = 0 AS p FROM labels))
    SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(fp / nullif(fp + tn, 0), 6) AS far, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tp / nullif(tp + fp, 0), 6) AS precision, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""",
)
def confusion_metrics(spark, sf_dir):
    d = table(spark, sf_dir, "labels").withColumn("p", F.col("doc_id") % 3 == 0)
    return statistics.confusion(d, F.col("p"), F.col("toxic") == 1)


@query(
    "threshold_far_budget",
    """WITH s AS (SELECT l_discount AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem), g AS (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY score),
    c AS (SELECT score, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS ps, sum(n) OVER () AS ns FROM g)
    SELECT min(score) AS threshold, round(max(tp / ps), 6) AS recall, round(max(fp / ns), 6) AS far FROM c WHERE fp <= 0.3 * ns""",
)
def threshold_far_budget(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("score"), (F.col("l_returnflag") == "R").alias("y"))
    return statistics.curve(d, "score", "y").where("fp <= 0.3 * negatives").agg(F.min("score").alias("threshold"), r6(F.max(F.col("tp") / F.col("positives"))).alias("recall"), r6(F.max(F.col("fp") / F.col("negatives"))).alias("far"))


@query(
    "roc_auc",
    """WITH s AS (SELECT l_quantity AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem), g AS (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY score),
    c AS (SELECT p, n, sum(p) OVER (ORDER BY score DESC) AS tp, sum(p) OVER () AS ps, sum(n) OVER () AS ns FROM g) SELECT round(sum(n * (tp - p / 2.0)) / max(ps) / max(ns), 6) AS auc FROM c""",
)
def roc_auc(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "R").alias("y"))
    return statistics.auc(d, "score", "y").select(r6("auc").alias("auc"))


@query("ensemble_vote", "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN v >= 2 THEN 1 ELSE 0 END AS INTEGER) AS vote, v IN (0, 3) AS unanimous FROM (SELECT l_orderkey, l_linenumber, CAST(l_discount > 0.05 AS INTEGER) + CAST(l_tax > 0.04 AS INTEGER) + CAST(l_quantity > 25 AS INTEGER) AS v FROM lineitem)")
def ensemble_vote(spark, sf_dir):
    v = sum((c.cast("int") for c in (F.col("l_discount") > 0.05, F.col("l_tax") > 0.04, F.col("l_quantity") > 25)), F.lit(0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (v >= 2).cast("int").alias("vote"), v.isin(0, 3).alias("unanimous"))


@query("anova_f", "WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity) * count(*) AS ss FROM lineitem GROUP BY 1), t AS (SELECT sum(n) AS n, sum(n * m) / sum(n) AS m, count(*) AS k FROM g) SELECT round((sum(g.n * (g.m - t.m) * (g.m - t.m)) / (max(t.k) - 1)) / (sum(g.ss) / (max(t.n) - max(t.k))), 6) AS f FROM g, t")
def anova_f(spark, sf_dir):
    return statistics.anova(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity").select(r6("f").alias("f"))


@query("minmax_scale", "SELECT s_suppkey, round(5 + (s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()) * 20, 6) AS size FROM supplier")
def minmax_scale(spark, sf_dir):
    return statistics.minmax(table(spark, sf_dir, "supplier"), "s_acctbal", 5, 25, "size").select("s_suppkey", r6("size").alias("size"))


@query("mercator", "SELECT c_custkey, round(6378137.0 * radians(c_nationkey), 4) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(c_acctbal / 200) / 2)), 4) AS y FROM customer")
def mercator(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(6378137.0 * F.radians("c_nationkey"), 4).alias("x"), F.round(6378137.0 * F.log(F.tan(F.pi() / 4 + F.radians(F.col("c_acctbal") / 200) / 2)), 4).alias("y"))


@query("stratified_folds", "SELECT c_custkey, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(CAST(c_custkey AS VARCHAR))) - 1) % 5 AS fold FROM customer")
def stratified_folds(spark, sf_dir):
    """Each class is dealt to the folds in the order of a hash: counts of hash ranges first, then places within a range."""
    d = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.md5(F.col("c_custkey").cast("string")).alias("h")).withColumn("range", F.substring("h", 1, 2))
    before = Window.partitionBy("c_mktsegment").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over 256 ranges
    starts = d.groupBy("c_mktsegment", "range").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    nth = F.row_number().over(Window.partitionBy("c_mktsegment", "range").orderBy("h"))
    return d.join(F.broadcast(starts), ["c_mktsegment", "range"]).select("c_custkey", ((F.col("start") + nth - 1) % 5).cast("long").alias("fold"))


@query("multi_agg", "SELECT l_partkey, round(sum(l_quantity), 2) AS l_quantity_sum, round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_samp(l_quantity), 6) AS l_quantity_std, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max FROM lineitem GROUP BY l_partkey")
def multi_agg(spark, sf_dir):
    q = "l_quantity"
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(F.sum(q), 2).alias(f"{q}_sum"), r6(F.avg(q)).alias(f"{q}_mean"), r6(F.stddev_samp(q)).alias(f"{q}_std"), F.min(q).alias(f"{q}_min"), F.max(q).alias(f"{q}_max"))


@query("first_seen", "SELECT o_custkey, o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def first_seen(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("m")).select("o_custkey", "o_orderstatus", "m.o_orderkey")


@query("keyword_filter", "SELECT p_partkey, p_name FROM part WHERE coalesce(contains(lower(p_name), 'red'), false)")
def keyword_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.coalesce(F.lower("p_name").contains("red"), F.lit(False))).select("p_partkey", "p_name")
