"""URL filter: character language-model ratio of accepted against rejected URLs [native].

Explicit rules judge the URLs they fit. Those URLs are also the examples that two variable-order Markov
models over characters learn from: half of them (by checksum) train the models, the other half calibrates the
threshold: the cut of the log-likelihood difference per character at which the shares of wrongly blocked and of wrongly
allowed URLs add up to the least. Every other URL is judged by that cut.

A context of up to two characters is used where its class has seen it ``MIN_CONTEXT`` times, else a shorter
one; Witten-Bell interpolation smooths each order with the next. URLs are folded to an alphabet of 36 symbols,
so the whole model has 36 ** 3 numbers for any table. Log ratios are rounded to whole millionths before they
are added, so reruns agree.

Nulls: a URL that is null or has no ``://`` has an empty host and path, fits no rule and scores 0 characters;
the method allows it. Repeated URLs are judged alike, each row is kept. Without examples of both classes the
method allows everything. Input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections import Counter
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host and path, verdict); a rule fits its host, all subdomains, and paths that start with its path.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols of the models: ^ pads the start, $ ends, 0 stands for any digit, * for any other character.
ALPHABET = "^$*0./_%~-" + LOWER
MIN_CONTEXT = 5
MICRO = 1_000_000
#: Scores are counted in steps of this many millionths for the threshold, and so far from 0 at most.
STEP, FURTHEST = 2_000, 20_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]], give: int) -> Column:
    """The longest fitting rule (give 0) or its verdict (give 1); the rules are a short list that travels in the plan."""
    found = None
    for rule in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, prefix = rule[0].partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        found = F.when(fits, rule[give]) if found is None else found.when(fits, rule[give])
    return F.lit(None).cast("string") if found is None else found


def codes(host: Column, path: Column) -> Column:
    """Symbols of a URL as numbers: two pads, its folded characters, an end."""
    folded = F.translate(F.lower(F.concat(host, path)), "0123456789", "0" * 10)
    folded = F.regexp_replace(folded, r"[^a-z0./_%~-]", "*")
    return F.transform(F.regexp_extract_all(F.concat(F.lit("^^"), folded, F.lit("$")), F.lit("(.)"), F.lit(1)), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def trigrams(codes: Column) -> Column:
    """Number of each symbol with its two predecessors, below ``len(ALPHABET) ** 3``."""
    n, k = F.size(codes), len(ALPHABET)
    pairs = F.zip_with(F.slice(codes, 1, n - 2), F.slice(codes, 2, n - 2), lambda a, b: a * k + b)
    return F.zip_with(pairs, F.slice(codes, 3, n - 2), lambda p, c: p * k + c)


def markov(counts: Counter) -> list[float]:
    """Smoothed log probability of the last symbol of every trigram, from trigram counts."""
    k = len(ALPHABET)
    order: list[Counter] = [Counter(), Counter(), Counter()]
    for g, n in counts.items():
        order[2][g] += n
        order[1][g % (k * k)] += n
        order[0][g % k] += n
    totals = [Counter(), Counter(), Counter()]
    kinds = [Counter(), Counter(), Counter()]
    for i in range(3):
        for g, n in order[i].items():
            totals[i][g // k] += n
            kinds[i][g // k] += 1

    def smooth(i: int, g: int, lower: float) -> float:
        c = g // k
        least = MIN_CONTEXT if i else 1
        return (order[i][g] + kinds[i][c] * lower) / (totals[i][c] + kinds[i][c]) if totals[i][c] >= least else lower

    one = [smooth(0, g, 1 / k) for g in range(k)]
    two = [smooth(1, g, one[g % k]) for g in range(k * k)]
    return [log(smooth(2, g, two[g % (k * k)])) for g in range(k**3)]


def fit(seen: DataFrame) -> list[int]:
    """Log ratios in millionths by trigram, from rows with _grams, _half (0 trains, 1 calibrates) and _label."""
    rows = (
        seen.where("_label is not null and _half = 0").select("_label", F.explode_outer("_grams").alias("g")).groupBy("_label", "g").agg(F.count(F.lit(1)).alias("n")).collect()
    )  # len(ALPHABET) ** 3 rows for each label at most
    counts = {v: Counter() for v in ("allow", "block")}
    for r in rows:
        counts[r._label][r.g] += r.n
    if not counts["allow"] or not counts["block"]:
        return [0] * len(ALPHABET) ** 3
    good, bad = markov(counts["allow"]), markov(counts["block"])
    return [round(MICRO * (a - b)) for a, b in zip(good, bad, strict=True)]


def with_llr(df: DataFrame, ratios: list[int]) -> DataFrame:
    """Adds _llr (sum of the ratios) and _n (symbols)."""
    table = df.sparkSession.createDataFrame([(ratios,)], "model array<int>").scalar()
    total = F.aggregate("_grams", F.lit(0).cast("long"), lambda acc, g: acc + F.get("_model", g))
    return df.withColumn("_model", table).withColumn("_llr", total).withColumn("_n", F.size("_grams")).drop("_model")


def cut(good: dict[int, int], bad: dict[int, int]) -> int:
    """Least step to allow, from counts of allowed and blocked URLs by step: the middle of the steps of least added error shares; 0 without both."""
    if not good or not bad:
        return 0
    n_good, n_bad, steps = sum(good.values()), sum(bad.values()), sorted({*good, *bad})
    lost, passed, loss = 0, n_bad, []
    for s in [*steps, steps[-1] + 1]:  # allow from s on
        loss.append((lost / n_good + passed / n_bad, s))
        lost, passed = lost + good.get(s, 0), passed - bad.get(s, 0)
    least = min(x for x, _ in loss)
    at = [i for i, (x, _) in enumerate(loss) if x == least]
    first = loss[at[0]][1]
    before = loss[at[0] - 1][1] if at[0] else first
    return (before + first) // 2 + (first > before)


def threshold(seen: DataFrame, ratios: list[int]) -> int:
    """Least mean ratio of a symbol, in millionths, that is allowed; counted over the calibration half by steps, so that any number of URLs gives few rows."""
    step = F.greatest(F.lit(-FURTHEST), F.least(F.lit(FURTHEST), F.floor(F.col("_llr") / F.col("_n")))) / STEP
    rows = with_llr(seen.where("_label is not null and _half = 1"), ratios).groupBy("_label", F.floor(step).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()
    return STEP * cut({r.s: r.n for r in rows if r._label == "allow"}, {r.s: r.n for r in rows if r._label == "block"})


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict, score (mean log ratio of a character) and threshold."""
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score", "threshold")]
    host, path = host_and_path(F.col("url"))
    base = pages.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), host.alias("host"), path.alias("path"))
    base = base.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules, 0)).withColumn("_label", rule_of(F.col("host"), F.col("path"), rules, 1))
    base = base.withColumn("_codes", codes(F.col("host"), F.col("path"))).withColumn("_grams", trigrams(F.col("_codes")))
    base = base.withColumn("_half", (F.crc32(F.concat("host", "path")) % 2).cast("int"))
    ratios = fit(base)
    least = threshold(base, ratios)
    out = with_llr(base, ratios)
    verdict = F.coalesce(F.col("_label"), F.when((F.length("host") + F.length("path") == 0) | (F.col("_llr") >= least * F.col("_n")), "allow").otherwise("block"))
    return out.select("_row.*", "host", "path", "rule", verdict.alias("verdict"), (F.col("_llr") / F.col("_n") / MICRO).alias("score"), F.lit(least / MICRO).alias("threshold"))
