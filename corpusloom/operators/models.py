"""Models trained here: distillation of soft labels, linear SVM, language identification by character n-grams, grid choice."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import tokens
from corpusloom.operators.vectors import softmax
from corpusloom.session import ship

#: Fixed value: logit of a class a model was not trained on.
MISSING = -1e4


def features(df: DataFrame, text: str = "text", bits: int = 14) -> DataFrame:
    """Adds features: hashed, L2-normalised token counts."""
    d = df.withColumn("_t", F.coalesce(tokens(text), F.array().cast("array<string>")))
    d = HashingTF(numFeatures=1 << bits, inputCol="_t", outputCol="_f").transform(d)
    return Normalizer(inputCol="_f", outputCol="features").transform(d).drop("_t", "_f")


def distil(df: DataFrame, logits: str, temperature: float = 1.0, iterations: int = 30):
    """A multinomial regression on soft targets: one row a label with the teacher's probability as its weight.

    With frozen features, cross-entropy against soft targets equals the KL divergence up to a constant. Fitted at a
    temperature, its scores must be multiplied by it.
    """
    p = df.where(F.col(logits).isNotNull()).select("features", F.posexplode(softmax(logits, temperature)).alias("label", "w"))
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="w", maxIter=iterations, standardization=False).fit(p.where("w > 1e-4").withColumn("label", F.col("label").cast("double")))


def student_logits(model, df: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Adds student (array of scores) and student_label."""
    out = model.transform(df)
    raw = F.transform(vector_to_array("rawPrediction"), lambda x: x * F.lit(temperature))
    return out.withColumn("student", raw).withColumn("student_label", F.col("prediction").cast("int")).drop("rawPrediction", "probability", "prediction")


def train_svm(df: DataFrame, label: str, iterations: int = 10, reg: float = 0.01) -> dict[int, object]:
    """{class: linear SVM of that class against the rest} for the classes that occur; None where there is but one class. Null labels are left out."""
    rows = df.where(F.col(label).isNotNull()).withColumn("_y", F.col(label).cast("int")).select("features", "_y")
    classes = sorted(r[0] for r in rows.select("_y").distinct().collect())  # one row a class
    if len(classes) < 2:
        return dict.fromkeys(classes)
    fit = lambda k: LinearSVC(maxIter=iterations, regParam=reg, labelCol="_one").fit(rows.withColumn("_one", (F.col("_y") == k).cast("double")))
    with ThreadPoolExecutor(4) as pool:
        return dict(zip(classes, pool.map(fit, classes)))


def probability_logits(p: Column) -> Column:
    """Logs of clipped probabilities; null classes get the missing-class logit."""
    return F.transform(p, lambda x: F.coalesce(F.log(F.greatest(x, F.lit(1e-12))), F.lit(MISSING)))


def label_logits(label: Column, classes: int) -> Column:
    """Logits of a model that only gives labels: 0 for the label, the missing-class logit elsewhere."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == label, F.lit(0.0)).otherwise(F.lit(MISSING)))


def predict_batches(df: DataFrame, scorer: Callable[[list[str]], list[list[float]]], id_col: str, text: str = "text", batch: int = 64) -> DataFrame:
    """(id_col, logits) by any function from texts to logits, in batches of equal texts' length order within a task."""
    ship(df.sparkSession)
    kind = dict(df.dtypes)[id_col]

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            f = f.reset_index(drop=True)
            order = f["text"].fillna("").str.len().sort_values(kind="stable").index
            logits: list = [None] * len(f)
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                for r, z in zip(rows, scorer([f["text"][r] or "" for r in rows])):
                    logits[r] = [float(x) for x in z]
            yield pd.DataFrame({id_col: f["id"], "logits": logits})

    return df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInPandas(run, f"`{id_col}` {kind}, logits array<double>")


def _trigrams(text: Column) -> Column:
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[\s\d\p{P}\p{S}]+", " "), F.lit(" "))


def language_profiles(df: DataFrame, lang: str = "lang", text: str = "text", n: int = 3, most: int = 400) -> DataFrame:
    """(lang, gram, logp): the most frequent character n-grams of each language with smoothed log frequencies."""
    g = _gram_rows(df.where(F.col(lang).isNotNull()), [lang], text, n).groupBy(lang, "gram").agg(F.sum("n").alias("n"))
    top = g.withColumn("_r", F.row_number().over(Window.partitionBy(lang).orderBy(F.desc("n"), "gram"))).where(F.col("_r") <= most)
    total = F.sum("n").over(Window.partitionBy(lang))
    return top.select(F.col(lang).alias("lang"), "gram", F.log((F.col("n") + 1) / (total + most)).alias("logp"))


def _gram_rows(df: DataFrame, keys: list[str], text: str, n: int) -> DataFrame:
    s = df.where(F.col(text).isNotNull()).select(*keys, _trigrams(F.col(text)).alias("_s"))
    i = F.explode(F.sequence(F.lit(1), F.greatest(F.length("_s") - n + 1, F.lit(1)))).alias("_i")
    return s.select(*keys, "_s", i).groupBy(*keys, F.expr(f"substring(_s, _i, {n})").alias("gram")).agg(F.count(F.lit(1)).alias("n"))


def identify_language(df: DataFrame, profiles: DataFrame, id_col: str, text: str = "text", floor: float = -12.0) -> DataFrame:
    """(id_col, lid_lang, lid_conf) from the first 2,000 characters; rows of null texts are left out.

    A gram outside a language's profile counts `floor`. The profiles have at most languages * 400 rows and are broadcast.
    """
    g = _gram_rows(df.select(id_col, F.substring(text, 1, 2000).alias(text)), [id_col], text, 3)
    langs = profiles.select("lang").distinct()
    known = g.join(F.broadcast(profiles), "gram").groupBy(id_col, "lang").agg(F.sum(F.col("n") * (F.col("logp") - floor)).alias("s"))
    size = g.groupBy(id_col).agg(F.sum("n").alias("n"))
    scored = size.crossJoin(F.broadcast(langs)).join(known, [id_col, "lang"], "left").select(id_col, "lang", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("s"))
    w = Window.partitionBy(id_col)
    e = F.exp(F.col("s") - F.max("s").over(w))
    p = scored.withColumn("p", e).withColumn("p", F.col("p") / F.sum("p").over(w))
    best = p.groupBy(id_col).agg(F.max(F.struct("p", "lang")).alias("b"))
    return best.select(id_col, F.col("b.lang").alias("lid_lang"), F.col("b.p").alias("lid_conf"))


def best_of_grid(log: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The best-scored row of each key of a result log; ties by the smaller `tie`."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return log.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


#: Rows that offsets are fitted on at most, the first in hashed order: 17 logits of each are 27 MB.
MOST_CALIBRATION = 200_000


def _macro_f1(y: np.ndarray, p: np.ndarray, classes: int) -> float:
    """Macro-F1 over the classes that occur in y or p."""
    hit, of_y, of_p = (np.bincount(x, minlength=classes) for x in (y[y == p], y, p))
    some = of_y + of_p > 0
    return float(np.mean(2 * hit[some] / (of_y + of_p)[some])) if some.any() else 0.0


def fit_offsets(y: np.ndarray, z: np.ndarray, steps: tuple[float, ...] = (-0.5, -0.25, 0.0, 0.25, 0.5), passes: int = 3) -> np.ndarray:
    """Offsets by coordinate ascent on macro-F1: each class takes its best step in turn, until a pass changes nothing. Of equal steps the smallest wins."""
    classes = z.shape[1]
    best = np.zeros(classes)
    for _ in range(passes):
        before = best.copy()
        for k in range(classes):
            tried = []
            for step in steps:
                moved = z + best
                moved[:, k] += step
                tried.append((round(_macro_f1(y, moved.argmax(1), classes), 12), -abs(step), step))
            best[k] += max(tried)[2]
        if (before == best).all():
            break
    return best


def class_offsets(df: DataFrame, id_col: str, y: str, logits: str, classes: int, folds: int = 5, most_rows: int = MOST_CALIBRATION) -> tuple[np.ndarray, float, float]:
    """(offsets to add to the logits, macro-F1 without, macro-F1 out of fold): each fold is scored with offsets fitted on the others.

    Fitted on the driver on `most_rows` rows at most, the first in hashed order of their ids; null labels and logits are left out. No rows give zeros.
    """
    r = df.where(F.col(y).isNotNull() & F.col(logits).isNotNull()).select(F.xxhash64(id_col).alias("h"), F.col(y).cast("int").alias("y"), F.col(logits).cast("array<double>").alias("z"))
    rows = r.orderBy("h").limit(most_rows).toArrow()
    if not rows.num_rows:
        return np.zeros(classes), 0.0, 0.0
    labels, fold = rows["y"].to_numpy(), rows["h"].to_numpy() % folds
    z = rows["z"].combine_chunks().flatten().to_numpy().reshape(-1, classes)
    out = np.empty(len(labels), np.int64)
    for k in range(folds):
        at = fold == k
        out[at] = (z[at] + (fit_offsets(labels[~at], z[~at]) if (~at).any() else 0)).argmax(1)
    return fit_offsets(labels, z), round(_macro_f1(labels, z.argmax(1), classes), 6), round(_macro_f1(labels, out, classes), 6)


def svm_scores(models: dict, df: DataFrame, classes: int) -> DataFrame:
    """Adds scores: the decision score of each class by its own SVM; classes that none was trained for get the missing-class logit."""
    out, names = df, {}
    for k, m in models.items():
        if m is not None and k < classes:
            scored = m.copy({m.rawPredictionCol: f"_raw{k}", m.predictionCol: f"_p{k}"}).transform(out)
            names[k] = f"_s{k}"
            out = scored.withColumn(f"_s{k}", F.element_at(vector_to_array(f"_raw{k}"), 2)).drop(f"_raw{k}", f"_p{k}")
    alone = F.lit(0.0)
    scores = F.array(*[F.col(names[k]) if k in names else alone if k in models else F.lit(MISSING) for k in range(classes)])
    return out.withColumn("scores", scores).drop(*names.values())


def ols(df: DataFrame, target: str, numeric: list[str], category: str | None = None) -> tuple[float, int]:
    """(R squared, rows) of a linear regression with the category as dummies."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    d = df.dropna(subset=[target, *numeric, *([category] if category else [])])
    cols = list(numeric)
    if category:
        d = StringIndexer(inputCol=category, outputCol="_i").fit(d).transform(d)
        d = OneHotEncoder(inputCol="_i", outputCol="_d").fit(d).transform(d)
        cols.append("_d")
    d = VectorAssembler(inputCols=cols, outputCol="_x").transform(d)
    fit = LinearRegression(featuresCol="_x", labelCol=target, solver="normal").fit(d)
    return fit.summary.r2, fit.summary.numInstances
