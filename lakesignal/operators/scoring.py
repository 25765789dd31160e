"""Scoring of detectors and classifiers from labelled rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def ablation_verdicts(signals: DataFrame, trials: DataFrame, variants: Mapping[str, str | None], trial: str = "trial_id") -> DataFrame:
    """Trials x variants: drifted when any signal other than the left-out one drifted.

    All variants come from one aggregate over ``signals`` (one max per variant).
    A trial without any signal row counts as not drifted.
    """
    flags = [
        F.coalesce(F.bool_or(F.col("is_drifted") & (F.lit(True) if out is None else (F.col("name") != out))), F.lit(False)).alias(name)
        for name, out in variants.items()
    ]
    wide = signals.groupBy(trial).agg(*flags)
    rows = F.array(*[F.struct(F.lit(n).alias("method"), F.coalesce(F.col(n), F.lit(False)).alias("predicted")) for n in variants])
    return trials.join(wide, trial, "left").select(*trials.columns, F.inline(rows))


def detector_scores(predictions: DataFrame, keys: Sequence[str] = ("method",)) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, F1 and false-positive rate; zero denominators give 0."""
    hit, real = F.col("predicted"), F.col("drift_injected")
    c = predictions.groupBy(*keys).agg(
        F.count_if(real & hit).alias("tp"), F.count_if(~real & hit).alias("fp"), F.count_if(real & ~hit).alias("fn"), F.count_if(~real & ~hit).alias("tn")
    )
    c = c.withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
            "false_positive_rate": ratio(F.col("fp"), F.col("fp") + F.col("tn")),
        }
    )
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def recall_by_type(predictions: DataFrame, keys: Sequence[str] = ("method",)) -> DataFrame:
    return predictions.where("drift_injected").groupBy(*keys, "drift_type").agg(F.avg(F.col("predicted").cast("double")).alias("recall"))


def confusion(df: DataFrame, label: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def class_report(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per class precision / recall / F1 / support from confusion cells."""
    keys = list(keys)
    both = cells.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("chosen"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("chosen"), F.lit(0).cast("bigint").alias("hit")),
            )
        ),
    )
    c = both.groupBy(*keys, "class").agg(F.sum("support").alias("support"), F.sum("chosen").alias("chosen"), F.sum("hit").alias("hit"))
    c = c.withColumns({"precision": ratio(F.col("hit"), F.col("chosen")), "recall": ratio(F.col("hit"), F.col("support"))})
    c = c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return c.select(*keys, "class", "precision", "recall", "f1", "support")


def report_summary(cells: DataFrame, report: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy and macro F1."""
    from lakesignal.scale import attach_row

    hit = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    acc = cells.groupBy(*keys).agg((hit / F.sum("n")).alias("accuracy"))
    macro = report.groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))
    return acc.join(macro, list(keys)) if keys else attach_row(acc, macro)


def threshold_sweep(df: DataFrame, is_positive: Column, score: Column, cutoffs: Sequence[float] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """P / R / F1 and flagged count per cutoff, in one aggregate over the rows (no row is repeated)."""
    slim = df.select(is_positive.alias("_y"), score.alias("_s"))
    aggs = [F.count_if("_y").alias("_pos")]
    for i, t in enumerate(cutoffs):
        aggs += [F.count_if(F.col("_s") >= t).alias(f"_f{i}"), F.count_if(F.col("_y") & (F.col("_s") >= t)).alias(f"_t{i}")]
    wide = slim.agg(*aggs)
    rows = [F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_f{i}").alias("n_predicted_flagged"), F.col(f"_t{i}").alias("_tp")) for i, t in enumerate(cutoffs)]
    out = wide.select("_pos", F.inline(F.array(*rows)))
    out = out.withColumns({"precision": ratio(F.col("_tp"), F.col("n_predicted_flagged")), "recall": ratio(F.col("_tp"), F.col("_pos"))})
    return out.select(
        "threshold", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "n_predicted_flagged"
    )


def label_distribution(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def majority_class(distribution: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent label, ties to the smallest label, and its share (the baseline's accuracy)."""
    total = F.sum("n")
    best = F.min_by(F.col("label"), F.struct(-F.col("n"), F.col("label")))
    return distribution.groupBy(*keys).agg(best.alias("majority"), (F.max("n") / total).alias("accuracy"))
