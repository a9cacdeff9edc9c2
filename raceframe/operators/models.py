"""Fitting and scoring with Spark ML."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raceframe.functions.columns import clip, logit, sigmoid
from raceframe.operators import evaluate, isotonic
from raceframe.operators.grouping import dense_ids, quantiles
from raceframe.operators.splits import group_split
from raceframe.session import work_dir

MISSING = -999.0
# Rows per block of the factor model: a task builds whole blocks in memory.  Ten blocks at least, as Spark has by default.
BLOCK_ROWS, LEAST_BLOCKS = 1_000_000, 10
# Rows that are scored and measured at a time when features are permuted.
DRAWN_ROWS = 20_000_000


def _filled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in features})


def fit_trees(train: DataFrame, features: Sequence[str], label: str, rounds: int = 20, depth: int = 5, seed: int = 42) -> PipelineModel:
    """Boosted trees for a binary label; missing values take a constant outside the range."""
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="__x"),
        GBTClassifier(featuresCol="__x", labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed, stepSize=0.1),
    ]
    return Pipeline(stages=stages).fit(_filled(train, features).select(*features, F.col(label).cast("double").alias(label)))


def fit_logistic(train: DataFrame, features: Sequence[str], label: str, ridge: float = 0.01) -> PipelineModel:
    """Logistic regression on standardised features."""
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="__raw"),
        StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True),
        LogisticRegression(featuresCol="__x", labelCol=label, regParam=ridge, standardization=False),
    ]
    return Pipeline(stages=stages).fit(_filled(train, features).select(*features, F.col(label).cast("double").alias(label)))


def score(model: PipelineModel, df: DataFrame, features: Sequence[str], name: str = "p") -> DataFrame:
    """Add the probability of the label; the features themselves stay as they are."""
    copies = {c: f"__f_{i}" for i, c in enumerate(features)}
    kept = [c for c in df.columns if c != name]
    work = df.select(*kept, *[F.col(c).alias(copy) for c, copy in copies.items()]).withColumn("__row", F.struct(*kept))
    work = work.select("__row", *[F.coalesce(F.col(copy).cast("double"), F.lit(MISSING)).alias(c) for c, copy in copies.items()])
    out = model.transform(work)
    return out.select("__row.*", vector_to_array("probability")[1].alias(name))


def split_counts(model: PipelineModel, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """(feature, split): how many inner nodes of all trees split on each feature, from the saved model's table of nodes."""
    path = f"{work_dir(spark)}/trees-{uuid.uuid4().hex}"
    model.stages[-1].save(path)
    nodes = spark.read.parquet(f"{path}/data").select("nodeData.*").filter("leftChild >= 0")
    counts = nodes.groupBy(F.col("split.featureIndex").alias("i")).agg(F.count(F.lit(1)).alias("split"))
    names = spark.createDataFrame(list(enumerate(features)), "i int, feature string")
    return names.join(counts, "i", "left").select("feature", F.coalesce("split", F.lit(0)).alias("split"))


def importance(model: PipelineModel, features: Sequence[str], version: str, spark: SparkSession) -> DataFrame:
    """Gain and number of splits per feature, with the rank by each."""
    gains = model.stages[-1].featureImportances.toArray()
    df = spark.createDataFrame([(version, f, float(g)) for f, g in zip(features, gains)], "version string, feature string, gain double")
    df = df.join(split_counts(model, features, spark), "feature").select("version", "feature", "gain", "split")
    place = lambda c: F.row_number().over(Window.partitionBy("version").orderBy(F.col(c).desc(), F.col("feature"))).cast("long")
    return df.withColumns({"rank": place("gain"), "split_rank": place("split")})


# --- calibration -------------------------------------------------------------------------


def fit_platt(df: DataFrame, p: str, label: str) -> tuple[float, float]:
    """Slope and intercept of a logistic fit on the log-odds."""
    x = df.select(logit(p).alias("__l"), F.col(label).cast("double").alias("label"))
    model = LogisticRegression(featuresCol="x").fit(VectorAssembler(inputCols=["__l"], outputCol="x").transform(x))
    return float(model.coefficients[0]), float(model.intercept)


def apply_platt(p: str, fit: tuple[float, float]) -> Column:
    return sigmoid(fit[0] * logit(p) + fit[1])


def calibrate(fit_on: DataFrame, apply_to: DataFrame, p: str, label: str, method: str, name: str = "p_cal") -> DataFrame:
    """Calibrated probability by ``platt``, ``isotonic`` or ``identity``."""
    if method == "platt":
        return apply_to.withColumn(name, apply_platt(p, fit_platt(fit_on, p, label)))
    if method == "isotonic":
        return isotonic.apply(isotonic.fit(fit_on, p, label), apply_to, p, name)
    if method == "identity":
        return apply_to.withColumn(name, F.col(p))
    raise ValueError("method must be platt, isotonic or identity")


def compare_calibrations(fit_on: DataFrame, test: DataFrame, p: str, label: str, methods: Sequence[str] = ("identity", "platt", "isotonic")) -> DataFrame:
    """Calibration error, Brier score and log loss per method."""
    out = None
    for m in methods:
        c = calibrate(fit_on, test, p, label, m)
        one = c.agg(
            F.lit(m).alias("method"), F.avg(F.pow(F.col("p_cal") - F.col(label), 2)).alias("brier"),
            F.avg(evaluate.log_loss("p_cal", label)).alias("logloss"),
        )
        one = one.withColumn("ece", evaluate.expected_calibration_error(c, "p_cal", label).select("ece").scalar())
        out = one if out is None else out.unionByName(one)
    return out


def calibrated_fit(df: DataFrame, features: Sequence[str], label: str, method: str = "platt", holdout: float = 0.25) -> DataFrame:
    """Trees on some events, calibration on others, and the events of a third part with both probabilities.

    No row is scored by a model or a calibration that has seen its event.
    """
    outer = group_split(df, holdout, name="__part")
    inner = group_split(outer.filter("__part = 'train'").drop("__part"), holdout, seed=17, name="__part")
    model = fit_trees(inner.filter("__part = 'train'"), features, label, rounds=5, depth=3)
    fit_on = score(model, inner.filter("__part = 'test'").drop("__part"), features)
    held = score(model, outer.filter("__part = 'test'").drop("__part"), features)
    return calibrate(fit_on, held, "p", label, method)


# --- two-stage regression --------------------------------------------------------------------


def _fit_reg(df: DataFrame, features: Sequence[str], label: str, rounds: int, weight: str | None = None):
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="__x"),
        GBTRegressor(featuresCol="__x", labelCol=label, maxIter=rounds, maxDepth=3, seed=42, **({"weightCol": weight} if weight else {})),
    ]
    keep = [*features, label] + ([weight] if weight else [])
    return Pipeline(stages=stages).fit(_filled(df, features).select(*keep))


def _predict(model, df: DataFrame, features: Sequence[str], name: str) -> DataFrame:
    x = model.transform(_filled(df, features).withColumnRenamed(name, "__old") if name in df.columns else _filled(df, features))
    return x.select(*[c for c in df.columns if c != name], F.col("prediction").alias(name))


def two_stage(df: DataFrame, features: Sequence[str], first: str, second: str, folds: int = 3, rounds: int = 5) -> DataFrame:
    """Predict the first half, then the second half with the out-of-fold prediction of the first.

    The first stage is fitted again for every fold, so no event helps to predict itself.
    """
    bucket = F.pmod(F.xxhash64(F.col("event"), F.lit(42)), F.lit(folds))
    rows = df.withColumn("__fold", bucket)
    parts = None
    for k in range(folds):
        model = _fit_reg(rows.filter(F.col("__fold") != k), features, first, rounds)
        part = _predict(model, rows.filter(F.col("__fold") == k), features, f"pred_{first}")
        parts = part if parts is None else parts.unionByName(part)
    wide = [*features, f"pred_{first}"]
    model = _fit_reg(parts, wide, second, rounds)
    return _predict(model, parts, wide, f"pred_{second}").drop("__fold")


# --- residual in log-odds ---------------------------------------------------------------------


def residual_target(df: DataFrame, p: str, label: str, runs: str, alpha: float = 1.0, percentile: float = 99.0, full: int = 10) -> DataFrame:
    """Log-odds of the smoothed label minus those of the prediction, clipped at quantiles, with a weight by runs."""
    smooth = (F.col(label) + alpha) / (1 + 2 * alpha)
    target = df.withColumn("__t", logit(smooth.cast("double"), 0.001) - logit(p, 0.001))
    low = (100 - percentile) / 200
    bounds = quantiles(target, [], "__t", [low, 1 - low], "__q").select("__q").scalar()
    return target.withColumns(
        {"target": clip("__t", bounds[0], bounds[1]), "weight": F.least(F.lit(1.0), F.col(runs) / float(full))}
    ).drop("__t")


def apply_residual(p: str, delta: str, runs: str, full: int = 10) -> Column:
    """Probability after a shift in log-odds, weighted by the number of runs."""
    return sigmoid(logit(p, 0.001) + F.least(F.lit(1.0), F.col(runs) / float(full)) * F.col(delta))


def fit_residual(df: DataFrame, features: Sequence[str], p: str, label: str, runs: str, rounds: int = 5) -> DataFrame:
    """Fit the residual and return the adjusted probability."""
    t = residual_target(df, p, label, runs)
    model = _fit_reg(t.filter("weight > 0"), features, "target", rounds, "weight")
    out = _predict(model, t, features, "delta")
    return out.withColumn("p_adj", apply_residual(p, "delta", runs))


# --- pair affinity -----------------------------------------------------------------------------


def outcome_rating(outcome: str | Column) -> Column:
    """Outcome 1 to 5 points, falling to 1 beyond the sixth."""
    o = F.col(outcome) if isinstance(outcome, str) else outcome
    return F.when(o == 1, 5).when(o == 2, 4).when(o == 3, 3).when(o <= 6, 2).otherwise(1)


def pair_ratings(df: DataFrame, user: str, item: str) -> DataFrame:
    """Runs and mean rating per pair."""
    return df.groupBy(user, item).agg(F.count(F.lit(1)).alias("n"), F.avg(outcome_rating("outcome")).alias("rating"))


def shrink(estimate: Column, n: Column, overall: Column, prior: float = 10.0) -> Column:
    """Pull an estimate to the overall mean by prior / (prior + n)."""
    alpha = prior / (prior + n)
    return alpha * overall + (1 - alpha) * estimate


def factor_blocks(rows: int) -> int:
    """Blocks of users, and of items, for so many rows, so that a block does not grow with the table."""
    return max(LEAST_BLOCKS, math.ceil(rows / BLOCK_ROWS))


def pair_affinity(df: DataFrame, user: str, item: str, factors: int = 8, rounds: int = 5, prior: float = 10.0) -> DataFrame:
    """Factor model over pair ratings, shrunk to the overall mean where a pair has few runs.

    Ids may be of any type and size: the model sees them densely numbered.  Pairs with a
    NULL id have no factors and no row.
    """
    pairs = pair_ratings(df, user, item).filter(F.col(user).isNotNull() & F.col(item).isNotNull())
    pairs = pairs.join(dense_ids(pairs, user, "__u"), user).join(dense_ids(pairs, item, "__i"), item)
    pairs = pairs.withColumns({c: F.col(c).cast("int") for c in ("__u", "__i")})
    blocks = factor_blocks(df.count())
    model = ALS(userCol="__u", itemCol="__i", ratingCol="rating", rank=factors, maxIter=rounds, seed=42, coldStartStrategy="nan", numUserBlocks=blocks, numItemBlocks=blocks).fit(
        pairs.select("__u", "__i", F.col("rating").cast("float"))
    )
    overall = df.agg(F.avg(outcome_rating("outcome"))).scalar()
    guess = F.coalesce(F.when(~F.isnan("prediction"), F.col("prediction")).cast("double"), overall)
    out = model.transform(pairs).withColumn("affinity", shrink(clip(guess, 1.0, 5.0), F.col("n"), overall, prior))
    return out.select(user, item, "n", "rating", "affinity")


# --- permutation importance ----------------------------------------------------------------------


def permute(df: DataFrame, column: str, key: Sequence[str], seed: int = 42, buckets: int = 256) -> DataFrame:
    """Exchange the values of a column between rows at random.

    Rows fall into random buckets and are matched by two independent random orders
    within each, so no task orders all rows.
    """
    keys = [F.col(k) for k in key]
    bucket = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(buckets))

    def order(s: int) -> Column:
        w = Window.partitionBy("__b").orderBy(F.xxhash64(*keys, F.lit(seed + s)), *keys)
        return F.row_number().over(w)

    rows = df.withColumn("__b", bucket).withColumn("__k", order(1))
    values = df.select(*key, column).withColumn("__b", bucket).withColumn("__k", order(2)).select("__b", "__k", F.col(column).alias("__v"))
    out = rows.join(values, ["__b", "__k"])
    return out.withColumn(column, F.col("__v")).select(*df.columns)


def permuted_rows(df: DataFrame, key: Sequence[str], features: Sequence[str], repeats: int = 3, seed: int = 42, rows: int = 512) -> DataFrame:
    """Every row once per (``feature``, ``repeat``), with ``value``: what another row holds in that feature.

    Rows meet in random buckets of about ``rows`` rows, by a hash of their key, and a
    feature's values are dealt out again in the order of a hash of (key, feature, repeat),
    so one shuffle serves all features and repeats.  ``key`` tells rows apart.
    """
    keys = [F.col(k) for k in key]
    buckets = max(1, math.ceil(df.count() / rows))
    row = F.struct(F.xxhash64(*keys, F.lit(seed)).alias("h"), F.struct(*df.columns).alias("r"))
    packed = df.select(F.pmod(F.xxhash64(*keys, F.lit(seed + 1)), F.lit(buckets)).alias("b"), row.alias("x"))
    packed = packed.groupBy("b").agg(F.sort_array(F.collect_list("x")).alias("xs"))

    def dealt(f: str, k: int) -> Column:
        drawn = F.transform("xs", lambda x: F.struct(F.xxhash64(*[x.r[c] for c in key], F.lit(f), F.lit(seed + k)).alias("h"), x.h.alias("t"), x.r[f].cast("double").alias("v")))
        return F.struct(F.lit(f).alias("feature"), F.lit(k).alias("repeat"), F.array_sort(drawn).v.alias("vs"))

    turns = packed.select("xs", F.explode(F.array(*[dealt(f, k) for f in features for k in range(1, repeats + 1)])).alias("d"))
    each = turns.select("d.feature", "d.repeat", F.explode(F.arrays_zip(F.col("xs").r.alias("r"), F.col("d.vs").alias("vs"))).alias("z"))
    return each.select("z.r.*", "feature", "repeat", F.col("z.vs").alias("value"))


def permutation_importance(
    model: PipelineModel, df: DataFrame, features: Sequence[str], label: str, test_features: Sequence[str] | None = None, repeats: int = 3, seed: int = 42,
) -> DataFrame:
    """Mean loss of AUC, first-place hits and reciprocal rank when a feature is permuted, over ``repeats`` draws.

    Draws, numbered by feature and repeat, are scored and measured by number, as many features
    at a time as ``DRAWN_ROWS`` allow; 0 stands for the rows as they are.  The scores are written
    once, and so are the measures, as several steps read each.
    """
    spark, run = df.sparkSession, f"{work_dir(df.sparkSession)}/permuted-{uuid.uuid4().hex}"

    def kept(table: DataFrame, name: str) -> DataFrame:
        table.write.parquet(f"{run}/{name}")
        return spark.read.schema(table.schema).parquet(f"{run}/{name}")

    wanted = list(features if test_features is None else test_features)
    plain = df.select("event", "entity", label, *features)
    swapped = {f: F.when(F.col("feature") == f, F.col("value")).otherwise(F.col(f).cast("double")) for f in wanted}
    base = plain.withColumns({"feature": F.lit(""), "repeat": F.lit(0)} | {f: F.col(f).cast("double") for f in wanted})
    first = F.coalesce(*[F.when(F.col("feature") == f, i * repeats) for i, f in enumerate(wanted)], F.lit(0))
    by = ["draw"]
    at_once = max(1, DRAWN_ROWS // max(1, repeats * plain.count()))
    found = None
    for at in range(0, len(wanted), at_once):
        rows = permuted_rows(plain, ["event", "entity"], wanted[at : at + at_once], repeats, seed).withColumns(swapped).drop("value")
        scored = score(model, rows if at else rows.unionByName(base), features)
        scored = kept(scored.select("event", "entity", label, "p", (first + F.col("repeat")).alias("draw")), f"scores-{at}")
        one = evaluate.ranking_metrics(scored, "p", label, by).select(*by, F.col("top1_hit_rate").alias("top1"), "mrr").join(evaluate.roc_auc(scored, "p", label, by), by)
        one = kept(one, f"measures-{at}")
        found = one if found is None else found.unionByName(one)
    ref = found.filter("draw = 0").select(F.struct("auc", "top1", "mrr")).scalar()
    names = ("auc", "top1", "mrr")
    feature = F.element_at(F.array(*[F.lit(f) for f in wanted]), (F.floor((F.col("draw") - 1) / repeats) + 1).cast("int")).alias("feature")
    losses = found.filter("draw > 0").select(feature, *[(ref[m] - F.col(m)).alias(m) for m in names])
    out = losses.groupBy("feature").agg(
        *[F.avg(m).alias(f"delta_{m}") for m in names], F.stddev_samp("auc").alias("delta_auc_std"), F.count(F.lit(1)).alias("n_repeats"))
    order = Window.orderBy(F.col("delta_auc").desc(), F.col("feature"))
    return out.withColumn("rank", F.row_number().over(order).cast("long"))
