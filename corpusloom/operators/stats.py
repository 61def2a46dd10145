"""Resampling, tests and rank statistics. Bootstraps work on sufficient statistics: counts per cluster, never rows times replicates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.metrics import scores


def draws(clusters: DataFrame, cluster: str, replicates: int, seed: str = "0") -> DataFrame:
    """(b, cluster, m): how often each cluster is drawn in each replicate of as many draws as there are clusters.

    Draw i of replicate b takes the cluster with number md5(seed|b|i) modulo their number, clusters numbered in
    order. The table has at most clusters * replicates rows; clusters are sites or sources, not documents.
    """
    w = Window.orderBy(cluster)
    numbered = clusters.select(cluster).distinct().withColumn("k", F.row_number().over(w) - 1)
    n = numbered.agg(F.count(F.lit(1)).alias("g"))
    grid = clusters.sparkSession.range(replicates).withColumnRenamed("id", "b").crossJoin(F.broadcast(n)).where("g > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("g").cast("int") - 1)))
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("b").cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("bigint")
    return grid.withColumn("k", (hashed % F.col("g")).cast("int")).groupBy("b", "k").agg(F.count(F.lit(1)).alias("m")).join(numbered, "k").select("b", cluster, "m")


def bootstrap_scores(counts: DataFrame, cluster: str, replicates: int, keys: list[str] | None = None, seed: str = "0") -> DataFrame:
    """(b, keys, n, accuracy, macro_f1) of each replicate, from (cluster, keys, y, p, n) counts."""
    keys = keys or []
    d = draws(counts, cluster, replicates, seed)
    mult = counts.join(d, cluster).groupBy("b", *keys, "y", "p").agg(F.sum(F.col("n") * F.col("m")).alias("n"))
    return scores(mult, ["b", *keys])


def percentile_interval(df: DataFrame, value: str, keys: list[str] | None = None, lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    return df.groupBy(*(keys or [])).agg(F.avg(value).alias("mean"), F.percentile(value, lo).alias("lo"), F.percentile(value, hi).alias("hi"))


def paired_summary(diffs: DataFrame, diff: str = "diff", margin: float = 0.01) -> DataFrame:
    """Interval, two-sided p and equivalence test of bootstrap differences; zero counts on both sides."""
    d = F.col(diff)
    share = lambda c: F.avg(c.cast("double"))
    return diffs.agg(
        F.avg(d).alias("mean"), F.percentile(d, 0.025).alias("lo"), F.percentile(d, 0.975).alias("hi"),
        F.least(F.lit(1.0), 2 * F.least(share(d <= 0), share(d >= 0))).alias("p"),
        F.percentile(d, 0.05).alias("lo90"), F.percentile(d, 0.95).alias("hi90"),
        F.greatest(share(d <= -margin), share(d >= margin)).alias("p_equivalence"),
    ).withColumn("equivalent", (F.col("lo90") > -margin) & (F.col("hi90") < margin))


def log_binomial_tail(k: int, n: int) -> float:
    """P(X <= k) for X ~ Binomial(n, 1/2)."""
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1))


def mcnemar(counts: DataFrame) -> DataFrame:
    """(only_a, only_b, p) from (y, pa, pb, n) counts: exact two-sided binomial test of the discordant rows; 1 without any."""
    a, b = (F.col("pa") == F.col("y")), (F.col("pb") == F.col("y"))
    r = counts.agg(F.coalesce(F.sum(F.when(a & ~b, F.col("n"))), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.when(b & ~a, F.col("n"))), F.lit(0)).alias("only_b")).first()
    n, k = r.only_a + r.only_b, min(r.only_a, r.only_b)
    p = 1.0 if n == 0 else min(1.0, 2 * log_binomial_tail(k, n))
    return counts.sparkSession.createDataFrame([(r.only_a, r.only_b, p)], "only_a bigint, only_b bigint, p double")


def holm(df: DataFrame, p: str = "p", keys: list[str] | None = None, tie: str = "id") -> DataFrame:
    """Adds p_holm: running maximum of (m - rank + 1) * p, at most 1, within the keys. Null p stays null and counts in no family."""
    keys = keys or []
    w = Window.partitionBy(*keys).orderBy(p, tie)
    m = F.count(p).over(Window.partitionBy(*keys))
    live = df.where(F.col(p).isNotNull())
    step = live.withColumn("_s", (m - F.row_number().over(w) + 1) * F.col(p))
    out = step.withColumn("p_holm", F.least(F.lit(1.0), F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")
    return out.unionByName(df.where(F.col(p).isNull()).withColumn("p_holm", F.lit(None).cast("double")))


def average_rank(order: str, keys: list[str], descending: bool = False):
    """Rank with ties at their average, as a column."""
    o = F.col(order).desc() if descending else F.col(order).asc()
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(o)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, order)) - 1) / F.lit(2.0)


def with_ranks(df: DataFrame, col: str, name: str, buckets: int = 64) -> DataFrame:
    """Adds the rank of a numeric column without nulls, ties at their average, from 1.

    Values are counted first; approximate quantiles cut the distinct values into buckets, each ranked by itself after the sizes of those before, so no
    window holds all values. The quantiles only balance the work: ranks are exact.
    """
    counts = df.groupBy(F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    cuts = sorted(set(df.select(F.col(col).cast("double").alias("x")).approxQuantile("x", [i / buckets for i in range(1, buckets)], 0.005)))
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("_v"))) if cuts else F.lit(0)
    b = counts.withColumn("_b", bucket)
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = b.groupBy("_b").agg(F.sum("_n").alias("_s")).select("_b", before.alias("_first"))  # at most `buckets` rows
    smaller = F.coalesce(F.sum("_n").over(Window.partitionBy("_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = b.join(F.broadcast(first), "_b").select("_v", (F.col("_first") + smaller + (F.col("_n") + 1) / F.lit(2.0)).alias(name))
    return df.join(ranks, F.col(col) == F.col("_v")).drop("_v")


def welch(df: DataFrame, value: str, side: str) -> DataFrame:
    """(delta, t, dof) of the two sides' means; side is boolean."""
    a = df.agg(*[f(F.when(F.col(side) == s, F.col(value))).alias(f"{n}{int(s)}") for s in (True, False) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    sa, sb = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    return a.select((F.col("m1") - F.col("m0")).alias("delta"), ((F.col("m1") - F.col("m0")) / F.sqrt(sa + sb)).alias("t"), ((sa + sb) * (sa + sb) / (sa * sa / (F.col("n1") - 1) + sb * sb / (F.col("n0") - 1))).alias("dof"))


def wilcoxon(df: DataFrame, diff: str) -> DataFrame:
    """(n, w): the smaller of the rank sums of positive and negative differences; zero differences are dropped."""
    r = df.where((F.col(diff) != 0) & F.col(diff).isNotNull()).select(F.col(diff).alias("d"), F.abs(diff).alias("a"))
    r = with_ranks(r, "a", "r")
    return r.agg(F.count(F.lit(1)).alias("n"), F.least(F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0))).alias("w"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    r = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    r = with_ranks(with_ranks(r, "a", "ra"), "b", "rb")
    return r.agg(F.corr("ra", "rb").alias("rho"), F.count(F.lit(1)).alias("n"))


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """(h, groups): the statistic with tie correction."""
    r = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(value).alias("v"), F.col(group).alias("g"))
    r = with_ranks(r, "v", "r")
    ties = r.groupBy("v").agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    g = r.groupBy("g").agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("k")).agg(F.sum(F.col("s") * F.col("s") / F.col("k")).alias("q"), F.sum("k").alias("n"), F.count(F.lit(1)).alias("groups"))
    x = g.crossJoin(ties)  # one row each
    n = F.col("n").cast("double")
    return x.select(((12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))).alias("h"), "groups")


# --- distribution functions without SciPy, for p-values of small results on the driver ---


def _beta_cf(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + num / (c if abs(c) > 1e-300 else 1e-300)
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


def t_two_sided(t: float, dof: float) -> float:
    return beta_inc(dof / 2, 0.5, dof / (dof + t * t))


def chi2_upper(x: float, dof: float) -> float:
    """Upper tail of the chi-squared distribution by the series of the lower incomplete gamma function."""
    a, x = dof / 2, x / 2
    if x <= 0:
        return 1.0
    term = total = 1 / a
    k = a
    while abs(term) > abs(total) * 1e-15:
        k += 1
        term *= x / k
        total += term
    return max(0.0, 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def holm_list(p: list[float]) -> list[float]:
    """Holm's adjustment of a few p-values, in their order."""
    order = sorted(range(len(p)), key=lambda i: p[i])
    out, top = [0.0] * len(p), 0.0
    for k, i in enumerate(order):
        top = max(top, min(1.0, (len(p) - k) * p[i]))
        out[i] = top
    return out


def wilcoxon_p(n: int, w: float) -> float:
    """Two-sided p of the smaller rank sum: exact up to 50 differences if w is whole (no ties), by the normal limit beyond."""
    if n == 0:
        return 1.0
    if n <= 50 and float(w).is_integer():
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    return normal_two_sided((w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24))


def spearman_p(rho: float, n: int) -> float:
    if n < 3 or rho is None:
        return 1.0
    return 0.0 if abs(rho) >= 1 else t_two_sided(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)


def against_base(df: DataFrame, variant: str, base: str, value: str) -> DataFrame:
    """(variant, n, mean, sd, delta, t, dof, p, p_holm): Welch's test of each variant's values against the base's, adjusted over the variants.

    One aggregation; one row a variant comes back. Variants or a base with fewer than two values have no p and are left out of the adjustment.
    """
    rows = df.where(F.col(variant).isNotNull()).groupBy(F.col(variant).cast("string").alias("v")).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("s")).orderBy("v").collect()
    b = next((r for r in rows if r.v == base), None)
    out = []
    for r in rows:
        t = dof = p = None
        if b and r.v != base and min(r.n, b.n) > 1 and r.s + b.s > 0:
            x, y = r.s / r.n, b.s / b.n
            t, dof = (r.m - b.m) / math.sqrt(x + y), (x + y) ** 2 / (x * x / (r.n - 1) + y * y / (b.n - 1))
            p = t_two_sided(t, dof)
        out.append([r.v, r.n, r.m, math.sqrt(r.s) if r.s is not None else None, r.m - b.m if b and r.m is not None and b.m is not None else None, t, dof, p])
    tested = [r for r in out if r[-1] is not None]
    adjusted = dict(zip((r[0] for r in tested), holm_list([r[-1] for r in tested])))
    return df.sparkSession.createDataFrame([(*r, adjusted.get(r[0])) for r in out], f"`{variant}` string, n bigint, mean double, sd double, delta double, t double, dof double, p double, p_holm double")


def factor_tests(df: DataFrame, target: str, numeric: list[str], categories: list[str]) -> DataFrame:
    """(factor, test, statistic, n, p, p_holm): the target against each factor, by Spearman's or Kruskal and Wallis' test, adjusted over all of them."""
    out = []
    for f in numeric:
        r = spearman(df, target, f).first()
        out.append((f, "spearman", r.rho, r.n, spearman_p(r.rho, r.n)))
    for f in categories:
        r = kruskal(df, target, f).first()
        n = df.where(F.col(target).isNotNull() & F.col(f).isNotNull()).count()
        out.append((f, "kruskal", r.h, n, chi2_upper(r.h, r.groups - 1) if r.h is not None and r.groups > 1 else 1.0))
    return df.sparkSession.createDataFrame([(*r, h) for r, h in zip(out, holm_list([r[-1] for r in out]))], "factor string, test string, statistic double, n bigint, p double, p_holm double")
