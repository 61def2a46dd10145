"""Classification metrics, all from (group, y, p) counts: one aggregation of the rows, then work on at most K * K rows a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion_counts(df: DataFrame, y: str = "y", p: str = "p", groups: list[str] | None = None) -> DataFrame:
    """(groups, y, p, n); rows with a null label or prediction are left out."""
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*(groups or []), F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def per_label(counts: DataFrame, groups: list[str] | None = None, n: str = "n") -> DataFrame:
    """(groups, label, support, predicted, tp, f1) of labels in the reference or the predictions; f1 is 0 for 0 / 0."""
    g = groups or []
    side = F.explode(F.array(
        F.struct(F.col("y").alias("label"), F.col(n).alias("s"), F.lit(0).cast("bigint").alias("q"), F.when(F.col("y") == F.col("p"), F.col(n)).otherwise(F.lit(0)).alias("t")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("s"), F.col(n).alias("q"), F.lit(0).cast("bigint").alias("t")),
    ))
    parts = counts.select(*g, side.alias("x")).select(*g, "x.*")
    out = parts.groupBy(*g, "label").agg(F.sum("s").alias("support"), F.sum("q").alias("predicted"), F.sum("t").alias("tp"))
    both = F.col("support") + F.col("predicted")
    return out.withColumn("f1", F.when(both == 0, F.lit(0.0)).otherwise(2 * F.col("tp") / both))


def scores(counts: DataFrame, groups: list[str] | None = None, n: str = "n") -> DataFrame:
    """(groups, n, accuracy, macro_f1): macro-F1 over the labels that the reference has in the group."""
    g = groups or []
    labels = per_label(counts, g, n)
    if not g:
        counts, labels, g = counts.withColumn("_g", F.lit(1)), labels.withColumn("_g", F.lit(1)), ["_g"]
    f1 = labels.where("support > 0").groupBy(*g).agg(F.avg("f1").alias("macro_f1"))
    acc = counts.groupBy(*g).agg(F.sum(n).alias("n"), (F.sum(F.when(F.col("y") == F.col("p"), F.col(n)).otherwise(0)) / F.sum(n)).alias("accuracy"))
    cond = [F.col(f"a.{x}").eqNullSafe(F.col(f"f.{x}")) for x in g]
    out = acc.alias("a").join(f1.alias("f"), cond).select(*[F.col(f"a.{x}").alias(x) for x in g], "n", "accuracy", "macro_f1")
    return out.drop("_g")


def grouped_macro_f1(counts: DataFrame, group: str) -> DataFrame:
    return scores(counts, [group]).agg(F.avg("macro_f1").alias("grouped_macro_f1"), F.count(F.lit(1)).alias("groups"))


def normalised_confusion(counts: DataFrame) -> DataFrame:
    row = F.greatest(F.sum("n").over(Window.partitionBy("y")), F.lit(1))
    return counts.withColumn("share", F.col("n") / row)


def ece(df: DataFrame, conf: Column, correct: Column, groups: list[str], bins: int = 15, half_open_low: bool = False) -> DataFrame:
    """Expected calibration error; bins [lo, hi) by default, (lo, hi] with half_open_low (confidence 0 is in no bin then)."""
    b = F.ceil(conf * bins) if half_open_low else F.least(F.floor(conf * bins), F.lit(bins - 1))
    x = df.select(*groups, b.alias("bin"), conf.alias("c"), correct.cast("double").alias("ok")).where(F.col("bin") > 0 if half_open_low else F.lit(True))
    per = x.groupBy(*groups, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("conf"), F.avg("ok").alias("acc"))
    return per.groupBy(*groups).agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def reliability(df: DataFrame, conf: Column, correct: Column, groups: list[str], bins: int = 10) -> DataFrame:
    b = F.least(F.floor(conf * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*groups, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(conf).alias("confidence"), F.avg(correct.cast("double")).alias("accuracy"))


def agreement(counts: DataFrame) -> DataFrame:
    """Percent agreement, Cohen's kappa and Krippendorff's nominal alpha of two raters from their joint counts."""
    side = F.explode(F.array(F.struct(F.col("y").alias("label"), F.col("n").alias("a"), F.lit(0).cast("bigint").alias("b")), F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("a"), F.col("n").alias("b"))))
    m = counts.select(side.alias("x")).select("x.*").groupBy("label").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    m = m.agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum((F.col("a") + F.col("b")) * (F.col("a") + F.col("b") - 1)).alias("same"), F.sum("a").alias("n"))
    o = counts.agg((F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("po"))
    pe = F.col("ab") / (F.col("n") * F.col("n"))
    ne = F.col("same") / (2 * F.col("n") * (2 * F.col("n") - 1))
    return m.crossJoin(o).select("n", F.col("po").alias("agreement"), ((F.col("po") - pe) / (1 - pe)).alias("kappa"), (1 - (1 - F.col("po")) / (1 - ne)).alias("alpha"))  # one row each


def leave_one_out_counts(counts: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """Counts without each group in turn, by subtraction from the totals: (left_out, keys, n)."""
    total = counts.groupBy(*keys).agg(F.sum("n").alias("all"))
    names = counts.select(F.col(group).alias("left_out")).distinct()
    own = counts.groupBy(F.col(group).alias("left_out"), *keys).agg(F.sum("n").alias("own"))
    grid = total.crossJoin(F.broadcast(names))  # K * K count rows by the number of groups
    return grid.join(own, ["left_out", *keys], "left").withColumn("n", F.col("all") - F.coalesce("own", F.lit(0))).where("n > 0").select("left_out", *keys, "n")
