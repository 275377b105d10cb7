"""Evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import running_sum, sliced
from .prefs import CLASSES, of_label


def confusion(rows: DataFrame, actual: str = "actual", predicted: str = "predicted", classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """One row an actual class with the counts of each predicted one."""
    return rows.groupBy(actual).pivot(predicted, list(classes)).agg(F.count(F.lit(1))).na.fill(0, list(classes))


def classification(rows: DataFrame, actual: str = "actual", predicted: str = "predicted", classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """Accuracy and macro F1 (0 where a denominator is 0) in one pass."""
    a, p = F.col(actual), F.col(predicted)
    sums = [F.count(F.lit(1)).alias("n"), F.count_if(a == p).alias("hit")]
    for k, c in enumerate(classes):
        sums += [F.count_if((a == c) & (p == c)).alias(f"tp{k}"), F.count_if((a == c) | (p == c)).alias(f"u{k}")]
    s = rows.agg(*sums)
    f1 = sum((F.when(F.col(f"tp{k}") + F.col(f"u{k}") > 0, 2 * F.col(f"tp{k}") / (F.col(f"tp{k}") + F.col(f"u{k}"))).otherwise(0.0) for k in range(len(classes))), F.lit(0.0)) / len(classes)
    return s.select("n", F.when(F.col("n") > 0, F.col("hit") / F.col("n")).otherwise(0.0).alias("accuracy"), f1.alias("macro_f1"))


def probability_scores(rows: DataFrame) -> DataFrame:
    """Log-loss (floor 1e-7) and Brier score over three classes."""
    brier = sum((F.pow(F.col(f"p_{c}") - (F.col("label") == k).cast("double"), 2) for k, c in enumerate(CLASSES)), F.lit(0.0)) / 3
    return rows.agg(F.avg(-F.log(F.greatest(of_label(), F.lit(1e-7)))).alias("log_loss"), F.avg(brier).alias("brier"))


def calibration_error(rows: DataFrame, confidence: str = "confidence", correct: str = "correct", bins: int = 10) -> DataFrame:
    """Weighted gap of confidence and accuracy over equal bins."""
    bin_ = F.floor(F.least(F.col(confidence), F.lit(0.999999)) * bins)
    b = rows.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(correct).cast("double")).alias("a"))
    return b.agg((F.sum(F.abs(F.col("c") - F.col("a")) * F.col("n")) / F.sum("n")).alias("ece"))


def _ratio(a, b):
    return F.when(b == 0, 1.0).otherwise(a / b)


def boundary_metrics(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of two sets of boundaries; 0/0 is 1."""
    both = predicted.select(*keys).distinct().withColumn("_p", F.lit(1)).join(truth.select(*keys).distinct().withColumn("_t", F.lit(1)), keys, "full_outer")
    s = both.agg(F.count_if(F.col("_p").isNotNull() & F.col("_t").isNotNull()).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select("tp", "fp", "fn", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def partition_metrics(rows: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Purity and how often truths are split or merged."""
    cells = rows.groupBy(predicted, truth).agg(F.count(F.lit(1)).alias("n"))
    pure = cells.groupBy(predicted).agg(F.max("n").alias("m"), F.sum("n").alias("n"), (F.count(F.lit(1)) - 1).alias("merged")).agg((F.sum("m") / F.sum("n")).alias("purity"), F.sum("merged").alias("under_segmentation"))
    split = cells.groupBy(truth).agg((F.count(F.lit(1)) - 1).alias("s")).agg(F.sum("s").alias("over_segmentation"))
    return pure.join(F.broadcast(split), F.lit(True))  # two rows of one row each


def retrieval_metrics(hits: DataFrame, query: str = "query_id", rank: str = "rank", relevant: str = "relevant", k: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Recall at k, MRR and nDCG at 10 over queries with one relevant item each (first relevant rank counts)."""
    first = hits.groupBy(query).agg(F.min(F.when(F.col(relevant), F.col(rank))).alias("r"))
    near = F.coalesce(F.col("r") <= 10, F.lit(False))
    return first.agg(F.count(F.lit(1)).alias("n_queries"), *[F.avg(F.coalesce((F.col("r") <= x).cast("double"), F.lit(0.0))).alias(f"recall_at_{x}") for x in k], F.avg(F.when(near, 1.0 / F.col("r")).otherwise(0.0)).alias("mrr_at_10"), F.avg(F.when(near, 1.0 / F.log2(F.col("r") + 1)).otherwise(0.0)).alias("ndcg_at_10"))


def candidate_recall(exact: DataFrame, candidates: DataFrame, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """Share of the exact hits that are among the candidates."""
    return exact.join(candidates.select(query, item, F.lit(1.0).alias("_in")).distinct(), [query, item], "left").agg(F.avg(F.coalesce("_in", F.lit(0.0))).alias("recall"))


def latency(rows: DataFrame, group: str, ms: str) -> DataFrame:
    """Total, upper median, the value at floor((n-1)*95/100) and the largest, per group.

    Ranks come from running counts of the distinct values, so a large group is no single task.
    """
    counted = rows.where(F.col(ms).isNotNull()).groupBy(group, ms).agg(F.count(F.lit(1)).alias("_k"))
    upto = running_sum(sliced(counted, group, [ms]), group, [ms], F.col("_k"), "_upto")
    whole = counted.groupBy(group).agg(F.sum("_k").alias("_n"), F.sum(F.col(ms) * F.col("_k")).alias("total"), F.max(ms).alias("largest"))
    at = lambda i: F.min(F.when(F.col("_upto") > i, F.col(ms)))
    ranks = upto.join(whole.select(group, "_n"), group).groupBy(group).agg(at(F.floor(F.col("_n") / 2)).alias("median"), at(F.floor((F.col("_n") - 1) * 95 / 100)).alias("p95"))
    return whole.join(ranks, group).select(group, "total", "median", "p95", "largest")
