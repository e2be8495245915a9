"""Statistics, outlier rules and classifier metrics as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlattice.functions.columns import violations
from airlattice.session import shared_dir

from .joins import keyed_join

#: Groups whose quantiles are sent to all tasks at most.
FEW_GROUPS = 4096


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of all pairs of columns, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}~{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}~{b}`").alias("corr")) for a, b in pairs])).alias("x")).select("x.*")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds running sums over the whole table in the given order (column -> name).

    Rows are dealt into ranges of the order and kept, each range sums its own rows, and the totals of the ranges before
    it are added: only the table of ranges is ordered in one task. ``order`` should be unique, or equal rows share ranges in any order.
    """
    shared_dir(df.sparkSession)
    placed = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint()
    totals = placed.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{n}") for c, n in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges
    offsets = totals.select(F.col("_range"), *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums.values()])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(offsets), "_range")  # as many rows as shuffle partitions
    return out.select(*df.columns, *[(F.sum(c).over(inside) + F.col(f"_o_{n}")).alias(n) for c, n in sums.items()])


def average_rank(df: DataFrame, x: str, name: str) -> DataFrame:
    """Adds the rank of x, the mean of the ranks that equal values share. Ranks come from running counts over distinct values."""
    values = df.groupBy(F.col(x).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sums(values, [F.col("_v")], {"_n": "_upto"}).select("_v", (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranked, F.col(x) == F.col("_v")).drop("_v")


def quantiles(df: DataFrame, key: str, x: str, at: dict[str, float], cuts: int = 64, few: int = FEW_GROUPS) -> DataFrame:
    """(key, one column a quantile): exact quantiles with linear interpolation of every group, for groups of any size.

    An approximate sketch cuts each group's values into ``cuts`` ranges; counts by range, combined before they are shuffled,
    tell which ranges hold the wanted ranks, and only values of those are ordered, as distinct values with their counts. Nulls
    and NaN don't count. Keys are compared null-safely; a group without values has nulls.

    Up to ``few`` groups are sent to the rows; of more only those that hold a large share of the rows are, so no group is one task's.
    """
    return _quantiles(df, key, x, at, cuts, few)[0].select(F.col("_k").alias(key), *at)


def with_quantiles(df: DataFrame, key: str, x: str, at: dict[str, float], few: int = FEW_GROUPS) -> DataFrame:
    """Adds the quantiles of its group to each row; null keys are a group."""
    q, is_few, total = _quantiles(df, key, x, at, 64, few)
    return keyed_join(df, q.withColumnRenamed("_k", key), [key], "_rows", is_few, total).drop("_rows")


def _quantiles(df: DataFrame, key: str, x: str, at: dict[str, float], cuts: int, few: int) -> tuple[DataFrame, bool, int]:
    """(_k, _rows, quantiles), whether these are few, and the number of rows."""
    v = F.col(x).cast("double")
    rows = df.select(F.col(key).alias("_k"), F.when(~F.isnan(v), v).alias("_v"))
    groups = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_rows"), F.count("_v").alias("_n"), F.percentile_approx("_v", [i / cuts for i in range(1, cuts)], 4 * cuts).alias("_cuts"))
    shared_dir(df.sparkSession)
    groups = groups.checkpoint()
    n_groups, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    is_few = n_groups <= few
    with_cuts = keyed_join(rows.where("_v IS NOT NULL"), groups, ["_k"], "_rows", is_few, total)
    placed = with_cuts.select("_k", "_v", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_r"))
    counts = placed.groupBy("_k", "_r").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy("_k").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)  # over at most ``cuts`` rows a group
    ranges = counts.withColumn("_upto", F.sum("_c").over(upto)).withColumn("_from", F.col("_upto") - F.col("_c"))
    ranks = [(name, side) for name in at for side in (0, 1)]
    place = lambda name, n: F.lit(at[name]) * (n - 1)
    rank = lambda name, side, n: (F.floor(place(name, n)) if side == 0 else F.ceil(place(name, n)))
    keyed = ranges.join(groups.select(F.col("_k").alias("_g"), "_n"), F.col("_k").eqNullSafe(F.col("_g"))).drop("_g")
    wanted = F.lit(False)
    for name, side in ranks:
        r = rank(name, side, F.col("_n"))
        wanted = wanted | ((r >= F.col("_from")) & (r < F.col("_upto")))
    some = keyed.where(wanted).select("_k", "_r", "_from", "_n", "_c")
    near = keyed_join(placed, some, ["_k", "_r"], "_c", is_few, total)
    distinct = near.groupBy("_k", "_r", "_v").agg(F.count(F.lit(1)).alias("_c"), F.first("_from").alias("_from"), F.first("_n").alias("_n"))
    inside = Window.partitionBy("_k", "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    last = distinct.withColumn("_last", F.col("_from") + F.sum("_c").over(inside)).withColumn("_first", F.col("_last") - F.col("_c"))
    found = [F.max(F.when((rank(n, s, F.col("_n")) >= F.col("_first")) & (rank(n, s, F.col("_n")) < F.col("_last")), F.col("_v"))).alias(f"_{n}_{s}") for n, s in ranks]
    out = last.groupBy(F.col("_k").alias("_g"), "_n").agg(*found)
    part = {n: place(n, F.col("_n")) - F.floor(place(n, F.col("_n"))) for n in at}
    values = out.select("_g", *[(F.col(f"_{n}_0") + (F.col(f"_{n}_1") - F.col(f"_{n}_0")) * part[n]).alias(n) for n in at])
    return groups.select("_k", "_rows").join(values, F.col("_k").eqNullSafe(F.col("_g")), "left").select("_k", "_rows", *at), is_few, total


def within_iqr(df: DataFrame, key: str, x: str, k: float = 1.5) -> DataFrame:
    """Adds within: x is at most k interquartile ranges beyond its group's quartiles."""
    d = with_quantiles(df, key, x, {"_a": 0.25, "_b": 0.75})
    span = (F.col("_b") - F.col("_a")) * k
    return d.withColumn("within", F.col(x).between(F.col("_a") - span, F.col("_b") + span)).drop("_a", "_b")


def mad_outliers(df: DataFrame, key: str, x: str, limit: float = 3.5) -> DataFrame:
    """Rows whose modified z-score by the median absolute deviation exceeds ``limit``."""
    d = with_quantiles(df, key, x, {"_m": 0.5}).withColumn("_d", F.abs(F.col(x) - F.col("_m")))
    return with_quantiles(d, key, "_d", {"_s": 0.5}).where(0.6745 * F.col("_d") > limit * F.col("_s")).drop("_m", "_d", "_s")


def mahalanobis(df: DataFrame, x: str, y: str) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance in two dimensions; the five moments are one broadcast row."""
    m = df.agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.var_samp(x).alias("_a"), F.var_samp(y).alias("_d"), F.covar_samp(x, y).alias("_b"), F.lit(1).alias("_one"))
    d = df.withColumn("_one", F.lit(1)).join(F.broadcast(m), "_one")
    u, v = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    d2 = F.try_divide(F.col("_d") * u * u - 2 * F.col("_b") * u * v + F.col("_a") * v * v, F.col("_a") * F.col("_d") - F.col("_b") * F.col("_b"))
    return d.withColumn("d2", d2).drop("_one", "_mx", "_my", "_a", "_d", "_b")


def centroid_distances(df: DataFrame, key: str, vector: str, reference) -> DataFrame:
    """(key, distance) of each group's centroid from the reference group's."""
    c = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    r = c.where(F.col(key) == reference).select("i", F.col("m").alias("r"))
    return c.join(r, "i").groupBy(key).agg(F.sqrt(F.sum((F.col("m") - F.col("r")) * (F.col("m") - F.col("r")))).alias("distance"))


def confusion(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    n = lambda c: F.sum(c.cast("int"))
    c = df.agg(n(predicted & actual).alias("tp"), n(predicted & ~actual).alias("fp"), n(~predicted & actual).alias("fn"), n(~predicted & ~actual).alias("tn"))
    r = lambda a, b: F.round(F.try_divide(a, b), 6)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", r(fp, fp + tn).alias("far"), r(tp, tp + fn).alias("recall"), r(tp, tp + fp).alias("precision"), r(2.0 * tp, 2 * tp + fp + fn).alias("f1"))


def curve(df: DataFrame, score: str, y: str) -> DataFrame:
    """True and false positives at every distinct score as threshold. Rows are pre-aggregated by score; the window runs over distinct scores."""
    g = df.groupBy(score).agg(F.sum(F.col(y).cast("int")).alias("p"), F.sum((~F.col(y)).cast("int")).alias("n"))
    whole = g.agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.lit(1).alias("_one"))
    d = running_sums(g, [F.desc(score)], {"p": "tp", "n": "fp"}).withColumn("_one", F.lit(1))
    return d.join(F.broadcast(whole), "_one").select(score, "p", "n", "tp", "fp", "positives", "negatives")


def auc(df: DataFrame, score: str, y: str) -> DataFrame:
    """Area under the ROC curve by trapezoids; equal scores count half."""
    c = curve(df, score, y)
    return c.agg(F.try_divide(F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)), F.max("positives") * F.max("negatives")).alias("auc"))


def anova(df: DataFrame, key: str, x: str) -> DataFrame:
    """One-way F statistic from the groups' counts, means and sums of squares."""
    g = df.groupBy(key).agg(F.count(x).alias("n"), F.avg(x).alias("m"), (F.var_pop(x) * F.count(x)).alias("ss"), F.sum(x).alias("s"))
    t = g.agg(F.sum("n").alias("N"), (F.sum("s") / F.sum("n")).alias("M"), F.count(F.lit(1)).alias("k"), F.sum("ss").alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"))
    between = F.col("q") - F.col("N") * F.col("M") * F.col("M")
    return t.select(F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(F.col("within"), F.col("N") - F.col("k"))).alias("f"))


def minmax(df: DataFrame, x: str, low: float, high: float, name: str) -> DataFrame:
    """Adds x scaled to [low, high]; the extremes are one broadcast row."""
    m = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.lit(1).alias("_one"))
    d = df.withColumn("_one", F.lit(1)).join(F.broadcast(m), "_one")
    return d.withColumn(name, low + F.try_divide(F.col(x) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * (high - low)).drop("_one", "_lo", "_hi")


def precision_curve(df: DataFrame, score: str, y: str) -> DataFrame:
    """(score, precision, recall) at every distinct score as threshold, and the part of the average precision that it brings."""
    c = curve(df, score, y)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return c.select(score, precision.alias("precision"), F.try_divide("tp", "positives").alias("recall"), (precision * F.try_divide("p", "positives")).alias("gain"))


def axes(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """By group: rows, the angle of the first principal axis of two measures in degrees, and its share of the variance."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.var_samp(x).alias("a"), F.var_samp(y).alias("d"), F.covar_samp(x, y).alias("b"))
    half, root = (F.col("a") + F.col("d")) / 2, F.sqrt(F.pow((F.col("a") - F.col("d")) / 2, 2) + F.pow("b", 2))
    return g.select(key, "n", F.degrees(F.atan2(2 * F.col("b"), F.col("a") - F.col("d")) / 2).alias("angle"), F.try_divide(half + root, 2 * half).alias("share"))


def macro_metrics(df: DataFrame, actual: str, predicted: str, classes: list[str]) -> DataFrame:
    """Macro-averaged precision, recall, F1 and balanced accuracy over the classes, from one aggregate."""
    n = lambda c: F.sum(c.cast("int"))
    cols = []
    for i, k in enumerate(classes):
        a, p = F.col(actual) == k, F.col(predicted) == k
        cols += [n(a & p).alias(f"tp{i}"), n(~a & p).alias(f"fp{i}"), n(a & ~p).alias(f"fn{i}")]
    one = df.agg(*cols)
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    col = lambda name, i: F.col(f"{name}{i}").cast("double")
    mean = lambda f: sum((f(i) for i in range(len(classes))), F.lit(0.0)) / len(classes)
    recall = mean(lambda i: zero(col("tp", i), col("tp", i) + col("fn", i)))
    return one.select(mean(lambda i: zero(col("tp", i), col("tp", i) + col("fp", i))).alias("precision"), recall.alias("recall"), mean(lambda i: zero(2 * col("tp", i), 2 * col("tp", i) + col("fp", i) + col("fn", i))).alias("f1"), recall.alias("balanced_accuracy"))


def mutual_information(df: DataFrame, features: dict[str, Column], label: Column) -> DataFrame:
    """(feature, n, mi): what each binned feature tells about the label, in nats, from the joint counts of one pass.

    A null bin or label is a value of its own. Counts are combined before they are shuffled; bins should be few.
    """
    kinds = F.array(*[F.struct(F.lit(name).alias("feature"), c.cast("string").alias("bin")) for name, c in features.items()])
    joint = df.select(label.cast("string").alias("label"), F.explode(kinds).alias("f")).groupBy("f.feature", "f.bin", "label").agg(F.count(F.lit(1)).alias("n_xy"))
    by = lambda *keys: F.sum("n_xy").over(Window.partitionBy(*keys))  # noqa: E731  over bins and labels, not rows
    d = joint.withColumns({"n_x": by("feature", "bin"), "n_y": by("feature", "label"), "n": by("feature")})
    part = F.col("n_xy") / F.col("n") * F.log(F.col("n_xy") * F.col("n") / (F.col("n_x") * F.col("n_y")))
    return d.groupBy("feature").agg(F.max("n").alias("n"), F.sum(part).alias("mi"))


def best_features(scores: DataFrame, score: str, k: int) -> DataFrame:
    """Adds nth and kept: the k features of highest score, equal ones by name. A score a feature is little enough for one window."""
    nth = F.row_number().over(Window.orderBy(F.desc_nulls_last(score), "feature"))
    return scores.withColumn("nth", nth).withColumn("kept", F.col("nth") <= k)


def upper_violations(df: DataFrame, columns: list[str], healthy: Column, z: float, least: int = 2) -> DataFrame:
    """``df`` without the healthy rows that exceed mean + z deviations of the healthy ones in ``least`` columns or more. Other rows stay.

    Fewer than five healthy rows give no bounds, and nothing is removed.
    """
    of = df.where(healthy).agg(F.count(F.lit(1)).alias("_n"), *[(F.avg(c) + z * F.stddev_samp(c)).alias(f"_high_{c}") for c in columns])
    met = df.crossJoin(F.broadcast(of))  # one row
    bad = healthy & (F.col("_n") >= 5) & (violations(columns, {c: F.col(f"_high_{c}") for c in columns}) >= least)
    return met.where(~F.coalesce(bad, F.lit(False))).select(*df.columns)


def means_by_feature(df: DataFrame, group: str, values: list, features: list[str]) -> DataFrame:
    """(feature, one column a value of the group): the table of means, transposed."""
    means = df.agg(*[F.avg(F.when(F.col(group) == v, F.col(c))).alias(f"{c}~{v}") for c in features for v in values])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"`{c}~{v}`").alias(str(v)) for v in values]) for c in features])
    return means.select(F.explode(rows).alias("x")).select("x.*")
