"""Metrics of a frame of predictions: (event, entity, p, label, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raceframe.functions.columns import clip, paid_places
from raceframe.operators.grouping import join_null_safe, prior, value_chunk, with_group_stats, with_quantiles
from raceframe.operators.history import ratio


def roc_auc(df: DataFrame, p: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve per group, ties counted half; NULL with one class only.

    Rows without a score take no part.  The others are first counted per score.  The lower-scored negatives of each score come
    from a prefix sum in chunks of the score, so no task sorts all scores.
    """
    by = list(by)
    counts = df.filter(F.col(p).isNotNull()).groupBy(*by, p).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("__pos"), F.count(F.when(F.col(label) == 0, 1)).alias("__neg")
    )
    counts = counts.withColumn("__chunk", value_chunk(F.col(p)))
    below = prior(counts, by, "__chunk", [F.col(p)], {"__below": ("sum", F.col("__neg"))})
    pairs = F.col("__pos").cast("double") * (F.coalesce("__below", F.lit(0)) + F.col("__neg") / 2)
    totals = below.groupBy(*by).agg(
        F.sum(pairs).alias("__u"), F.sum("__pos").alias("__p"), F.sum("__neg").alias("__n")
    )
    area = F.when((F.col("__p") > 0) & (F.col("__n") > 0), F.col("__u") / (F.col("__p").cast("double") * F.col("__n")))
    return totals.select(*by, area.alias("auc"))


def log_loss(p: str | Column, label: str | Column, eps: float = 1e-15) -> Column:
    q = clip(p, eps, 1 - eps)
    y = F.col(label) if isinstance(label, str) else label
    return -F.when(y == 1, F.ln(q)).otherwise(F.ln(1 - q))


def global_metrics(df: DataFrame, p: str, label: str, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1, log loss, Brier score and AUC per group; labels must be 0 or 1."""
    by = list(by)
    df = df.filter(F.col(label).isin(0, 1))
    guess, hit = F.col(p) >= threshold, F.col(label) == 1
    agg = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(hit, 1)).alias("n_positive"),
        F.avg(F.when(guess == hit, 1.0).otherwise(0.0)).alias("accuracy"),
        F.count(F.when(guess & hit, 1)).alias("__tp"), F.count(F.when(guess, 1)).alias("__guessed"),
        F.avg(log_loss(p, label)).alias("logloss"), F.avg(F.pow(F.col(p) - F.col(label), 2)).alias("brier"),
    )
    precision = F.coalesce(ratio("__tp", "__guessed"), F.lit(0.0))
    recall = F.coalesce(ratio("__tp", "n_positive"), F.lit(0.0))
    f1 = F.coalesce(ratio(2 * F.col("__tp"), F.col("__guessed") + F.col("n_positive")), F.lit(0.0))
    out = agg.select(*by, "n", "n_positive", "accuracy", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "logloss", "brier")
    area = roc_auc(df, p, label, by)
    if by:
        return out.join(area, by, "left")
    return out.withColumn("auc", area.scalar())


def best_label_rank(df: DataFrame, p: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Per event: field size and the best predicted rank among entries with the label.

    The rank is one more than the number of entries placed before that entry, so it
    takes two aggregations, the first of labelled entries alone, and no sort of an event.
    """
    keys = [*by, "event"]
    place = F.struct((-F.col(p)).alias("p"), F.col("entity"))
    best = df.filter(F.col(label) == 1).groupBy(*keys).agg(F.min(place).alias("__best"))
    marked = join_null_safe(df, best, keys)
    return marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.when(F.count(F.when(F.col(label) == 1, 1)) > 0, F.count(F.when(place < F.col("__best"), 1)) + 1).alias("rank"),
    )


def ranking_metrics(df: DataFrame, p: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Top-1/3/5 hit rates, mean reciprocal rank and field size; events without the label are left out of the rates."""
    ranks = best_label_rank(df, p, label, by)
    r = F.col("rank")
    known = F.count(r)

    def rate(test: Column) -> Column:
        return F.coalesce(ratio(F.count(F.when(test, 1)), known), F.lit(0.0))

    return ranks.groupBy(*by).agg(
        known.alias("n_races"), F.coalesce(F.sum("n_entries"), F.lit(0)).alias("n_entries"),
        rate(r == 1).alias("top1_hit_rate"), rate(r <= 3).alias("top3_hit_rate"), rate(r <= 5).alias("top5_hit_rate"),
        F.coalesce(F.avg(1 / r), F.lit(0.0)).alias("mrr"), F.coalesce(F.avg("n_entries"), F.lit(0.0)).alias("avg_field_size"),
    )


def rank_histogram(df: DataFrame, p: str, label: str) -> DataFrame:
    """Number of events per predicted rank of the winner, 1 to 9 and 10+."""
    r = best_label_rank(df, p, label).filter(F.col("rank").isNotNull())
    bucket = F.when(F.col("rank") >= 10, "10+").otherwise(F.col("rank").cast("string"))
    return r.groupBy(bucket.alias("rank")).agg(F.count(F.lit(1)).alias("n"))


def cover_metrics(df: DataFrame, p: str, label: str) -> DataFrame:
    """Share of events whose best labelled entry is ranked first, in two, in three; its mean rank."""
    r = best_label_rank(df, p, label).filter(F.col("rank").isNotNull())
    return r.agg(
        F.count(F.lit(1)).alias("n_races"),
        *[F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"hit_top{k}_rate") for k in (1, 2, 3)],
        F.avg("rank").alias("avg_rank_best"),
    )


def ndcg(df: DataFrame, p: str, label: str) -> DataFrame:
    """NDCG with one relevant entry (ties averaged) and top-1 accuracy over events of two or more entries."""
    hit = F.col(label) == 1
    sized = with_group_stats(df, ["event"], __n=F.count(F.lit(1)), __w=F.max(F.when(hit, F.col(p))))
    score = F.col(p)
    per = sized.filter(F.col("__n") > 1).groupBy("event").agg(
        F.count(F.when(score > F.col("__w"), 1)).alias("above"),
        F.count(F.when(score == F.col("__w"), 1)).alias("same"),
        F.min_by(F.col(label), F.struct(-score, F.col("entity"))).alias("top_label"),
    )
    gains = F.transform(F.sequence(F.col("above") + 1, F.col("above") + F.col("same")), lambda r: 1 / F.log2(r + 1))
    dcg = F.aggregate(gains, F.lit(0.0), lambda s, v: s + v) / F.col("same")
    return per.agg(
        F.count(F.lit(1)).alias("n_events"),
        F.avg(F.when(F.col("same") > 0, dcg).otherwise(0.0)).alias("ndcg"),
        F.avg(F.col("top_label").cast("double")).alias("top1_accuracy"),
    )


def _bin_totals(df: DataFrame, p: str, label: str, bin_of: Column) -> DataFrame:
    return df.groupBy(bin_of.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("avg_pred"), F.avg(label).alias("emp_rate")
    )


def calibration_bins(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """Mean prediction against observed rate per equal-width bin that holds rows."""
    b = F.greatest(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)), F.lit(0))
    return _bin_totals(df, p, label, b).withColumn("diff", F.col("avg_pred") - F.col("emp_rate"))


def _linspace_bin(p: str, bins: int) -> Column:
    """Bin with edges i / bins; the last bin includes 1."""
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    return F.when(F.col(p).between(0.0, 1.0), F.size(F.filter(edges, lambda e: F.col(p) >= e)))


def expected_calibration_error(df: DataFrame, p: str, label: str, bins: int = 15, min_rows: int = 20) -> DataFrame:
    """Weighted gap between prediction and rate; small bins add nothing but count in the total."""
    t = _bin_totals(df, p, label, _linspace_bin(p, bins))
    use = F.col("bin").isNotNull() & (F.col("n") >= min_rows)
    gap = F.col("n") * F.abs(F.col("avg_pred") - F.col("emp_rate"))
    return t.agg(
        F.coalesce(F.sum(F.when(use, gap)) / F.sum("n"), F.lit(0.0)).alias("ece"),
        F.count(F.when(use, 1)).alias("bins_used"),
    )


def reliability_curve(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """Centre, observed rate and mean prediction of every bin, NULL for an empty one."""
    spark = df.sparkSession
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"), ((F.col("id") + 0.5) / bins).alias("center"))
    t = _bin_totals(df, p, label, _linspace_bin(p, bins))
    return grid.join(t, "bin", "left").select("bin", "center", F.col("emp_rate").alias("bin_acc"), F.col("avg_pred").alias("bin_conf"))


def field_size_band(n: Column | str) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return F.when(n <= 10, "small").when(n <= 14, "medium").when(n <= 100, "large")


def segment_metrics(df: DataFrame, p: str, label: str, segments: Sequence[str]) -> DataFrame:
    """Ranking and global metrics for every value of every segment column, in one pass."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(s).alias("segment_key"), F.col(s).cast("string").alias("segment_value")) for s in segments])
    )
    long = df.select("event", "entity", p, label, pairs.alias("__s")).select("event", "entity", p, label, "__s.*")
    long = long.filter(F.col("segment_value").isNotNull())
    by = ["segment_key", "segment_value"]
    ranks = best_label_rank(long, p, label, by).filter(F.col("rank").isNotNull())
    r = F.col("rank")
    ranking = ranks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_races"), F.avg("n_entries").alias("avg_field_size"), F.avg(1 / r).alias("mrr"),
        *[F.avg(F.when(r <= k, 1.0).otherwise(0.0)).alias(f"top{k}_hit_rate") for k in (1, 3, 5)],
    )
    losses = long.groupBy(*by).agg(F.count(F.lit(1)).alias("n_entries"), F.avg(log_loss(p, label)).alias("logloss"))
    return ranking.join(losses, by).join(roc_auc(long, p, label, by), by, "left")


def payout_sanity_rows(df: DataFrame, payout: str) -> DataFrame:
    """Entries that finished in a paid place but have no payout."""
    places = paid_places("field_size")
    due = F.coalesce((F.col("outcome") <= places) & (places > 0), F.lit(False))
    return df.withColumn("paid_places", places).filter(due & F.col(payout).isNull())


def payout_sanity(df: DataFrame, payout: str) -> DataFrame:
    """Counts of due, present and missing payouts, and the expected against the actual missing rate."""
    places = paid_places("field_size")
    due = F.coalesce((F.col("outcome") <= places) & (places > 0), F.lit(False))
    missing = F.col(payout).isNull()
    per = df.groupBy("event").agg(
        F.max("field_size").alias("n"), F.count(payout).alias("paid"), F.count(F.lit(1)).alias("rows"),
        F.count(F.when(due, 1)).alias("due"), F.count(F.when(due & missing, 1)).alias("bad"),
        F.count(F.when(F.col("outcome") <= 3, 1)).alias("in3"), F.count(F.when((F.col("outcome") <= 3) & missing, 1)).alias("in3_missing"),
    )

    def events(test: Column, name: str) -> Column:
        return F.count(F.when(test, 1)).alias(name)

    n, paid = F.col("n"), F.col("paid")
    total = F.sum("rows")
    return per.agg(
        total.alias("n_rows"), events(n <= 4, "races_le4"), events(n.between(5, 7), "races_5_7"), events(n >= 8, "races_ge8"),
        events(paid == 0, "payouts_0"), events(paid == 2, "payouts_2"), events(paid == 3, "payouts_3"), events(paid >= 4, "payouts_4_plus"),
        events(paid == 1, "payouts_1"),
        F.sum("due").alias("n_due"), F.sum("bad").alias("n_anomaly_rows"), events(F.col("bad") > 0, "n_anomaly_races"),
        (F.sum("in3_missing") / F.sum("in3")).alias("in3_missing_rate"),
        (1 - F.avg(paid_places("n")) / F.avg("n")).alias("expected_missing_rate"),
        (1 - F.sum("paid") / total).alias("actual_missing_rate"),
        events(paid < 3, "races_with_few_payouts"), F.avg(paid).alias("avg_payout_per_race"),
    )


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, MAPE and the shares within half a second and one second."""
    e = F.abs(F.col(actual) - F.col(predicted))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(e / (F.abs(actual) + 1e-6)) * 100).alias("mape"),
        F.avg(F.when(e < 0.5, 1.0).otherwise(0.0)).alias("within_half"), F.avg(F.when(e < 1.0, 1.0).otherwise(0.0)).alias("within_one"),
    )


def score_summary(df: DataFrame, p: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Size, moments, quartiles and positive rate of a score."""
    stats = df.groupBy(*by).agg(
        F.count(p).alias("n"), F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"), F.min(p).alias("min"), F.max(p).alias("max"),
        F.avg(label).alias("positive_rate"),
    )
    return with_quantiles(stats, df, by, p, [0.25, 0.5, 0.75], "__q").select(
        *by, "n", "mean", "std", "min", "max", F.col("__q")[0].alias("q25"), F.col("__q")[1].alias("median"),
        F.col("__q")[2].alias("q75"), "positive_rate",
    )


def drift_flags(now: DataFrame, fitted: DataFrame) -> DataFrame:
    """Compare two one-row summaries: mean shift above two deviations, extreme positive rate."""
    ref = fitted.select(F.struct("mean", "std").alias("s")).scalar()
    shift = F.abs(F.col("mean") - ref["mean"])
    return now.select(
        "n", "mean", ref["mean"].alias("fit_mean"), shift.alias("shift"), (shift > 2 * ref["std"]).alias("drifted"),
        ((F.col("positive_rate") < 0.01) | (F.col("positive_rate") > 0.99)).alias("extreme_rate"),
    )
