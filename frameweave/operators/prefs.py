"""Preference model: features, leakage-aware split, softmax and pairwise fits, calibration, prediction.

Rows are ``features array<double>`` with ``label`` (0 keep, 1 review, 2 reject).
Fits are full-batch gradient steps: every step is one pass over the checkpointed
rows, each task returns one row of partial sums, so the driver holds as many
numbers as there are tasks times weights.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clamp, softmax
from ..session import cut

CLASSES = ("keep", "review", "reject")


@dataclass(frozen=True)
class TrainingConfig:
    steps: int = 72
    rate: float = 0.12
    decay: float = 0.015
    l2: float = 0.025
    sigma_floor: float = 0.05
    holdout_share: float = 0.20
    pairwise_least: int = 8
    temperatures: tuple[float, ...] = (0.60, 0.75, 0.90, 1.00, 1.15, 1.35, 1.60, 1.90)


@dataclass
class Model:
    mean: list[float]
    scale: list[float]
    weights: list[list[float]]
    biases: list[float]
    temperature: float = 1.0
    version: str = "softmax-1"
    pairwise: list[float] = field(default_factory=list)

    def encode(self) -> tuple[str, str]:
        """Canonical JSON and its digest."""
        import hashlib

        text = json.dumps(self.__dict__, sort_keys=True, separators=(",", ":"))
        return text, hashlib.sha256(text.encode()).hexdigest()

    @classmethod
    def decode(cls, text: str, digest: str) -> Model:
        """Refuses text that doesn't match its digest."""
        import hashlib

        if hashlib.sha256(text.encode()).hexdigest() != digest:
            raise ValueError("the artifact doesn't match its digest")
        return cls(**json.loads(text))


def optional_unit(x: Column) -> list[Column]:
    """An optional number within [0, 1] and whether it is available; non-finite ones are not."""
    d = x.cast("double")
    ok = d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))
    return [F.when(ok, clamp(d)).otherwise(0.0), ok.cast("double")]


def feature_vector(units: list[Column], one_hot: tuple[Column, tuple[str, ...]] | None = None, flags: list[Column] = ()) -> Column:
    """Optional units as pairs, a one-hot code with ``none``, and flags (null is false)."""
    parts = [p for u in units for p in optional_unit(u)]
    if one_hot:
        col, values = one_hot
        parts += [F.coalesce((col == v).cast("double"), F.lit(0.0)) for v in values] + [F.coalesce((~col.isin(list(values))).cast("double"), F.lit(1.0))]
    return F.array(*parts, *[F.coalesce(f.cast("double"), F.lit(0.0)) for f in flags])


def coverage(rows: DataFrame) -> DataFrame:
    """Share of non-zero cells."""
    return rows.agg((F.sum(F.size(F.filter("features", lambda x: x != 0))) / F.sum(F.size("features"))).alias("coverage"))


def class_support(rows: DataFrame) -> DataFrame:
    """A10: always one row a class: rows and distinct projects."""
    spark = rows.sparkSession
    classes = spark.createDataFrame(list(enumerate(CLASSES)), "label int, class string")
    n = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("project_id").alias("n_projects"))
    return classes.join(n, "label", "left").na.fill(0, ["n_rows", "n_projects"])


def split_groups(rows: DataFrame, config: TrainingConfig = TrainingConfig(), project: str = "project_id", fallback: list[str] = ("set_id", "moment_id", "day", "asset_id")) -> DataFrame:
    """``rows`` with ``split`` train or validation; no project, or else group, is in both.

    With two or more projects whole projects are held out, else the first
    available of the fallback keys groups the rows.  Groups are ordered by a stable
    hash; a fifth of them, at least one and not all, is held out; with fewer than
    two groups ``split`` is null.
    """
    projects = rows.select(project).distinct().limit(2).count()
    key = F.concat(F.lit("p:"), F.col(project)) if projects > 1 else F.coalesce(*[F.concat(F.lit(f"{f}:"), F.col(f).cast("string")) for f in fallback if f in rows.columns])
    keyed = rows.withColumn("_g", key)
    groups = keyed.select("_g").distinct().withColumn("_h", F.md5("_g"))
    n = groups.count()
    if n < 2:
        return keyed.withColumn("split", F.lit(None).cast("string")).drop("_g")
    take = min(max(round(n * config.holdout_share), 1), n - 1)
    # Counts of 65,536 ranges of the hash find the one with the last group held out; only that one is ordered.
    sizes = sorted(groups.groupBy(F.substring("_h", 1, 4).alias("r")).count().collect())
    range_, before = None, 0
    for r, c in sizes:
        if before + c >= take:
            range_ = r
            break
        before += c
    bound = groups.where(F.substring("_h", 1, 4) == range_).orderBy("_h", "_g").limit(take - before).agg(F.max(F.struct("_h", "_g")).alias("b")).first()["b"]
    at = F.struct(F.md5("_g").alias("_h"), F.col("_g"))
    held = at <= F.struct(F.lit(bound["_h"]).alias("_h"), F.lit(bound["_g"]).alias("_g"))
    return keyed.withColumn("split", F.when(held, "validation").otherwise("train")).drop("_g")


def fit_normalizer(train: DataFrame, config: TrainingConfig = TrainingConfig()) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation (floored) of every feature."""
    s = train.select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()  # one row a feature
    return np.array([r["m"] for r in s]), np.maximum(np.array([r["s"] for r in s]), config.sigma_floor)


def _sums(rows: DataFrame, f, names: list[str]) -> np.ndarray:
    """Sum of the arrays that ``f`` makes of each batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                part = f(pdf)
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"s": [total.ravel().tolist()]})

    parts = rows.select(*names).mapInPandas(run, "s array<double>").collect()  # one row a task
    return reduce(lambda a, b: a + b, [np.array(r["s"]) for r in parts]) if parts else np.zeros(0)


def _probabilities(x: np.ndarray, w: np.ndarray, b: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    z = (x @ w.T + b) / temperature
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_softmax(train: DataFrame, config: TrainingConfig = TrainingConfig()) -> Model:
    """M2: class-weighted softmax by full-batch steps with falling rate; biases start at the log shares."""
    rows = cut(train.select("features", "label"))
    mean, scale = fit_normalizer(rows, config)
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # three classes
    n = np.array([counts.get(k, 0) for k in range(3)], dtype=float)
    present = n > 0
    weight = np.where(present, n.sum() / (present.sum() * np.maximum(n, 1)), 0.0)
    b = np.log(np.maximum(n / n.sum(), 1e-6))
    w = np.zeros((3, len(mean)))
    for i in range(config.steps):

        def gradient(pdf: pd.DataFrame, w=w, b=b) -> np.ndarray:
            x = (np.stack(pdf["features"].to_numpy()) - mean) / scale
            y = pdf["label"].to_numpy()
            e = _probabilities(x, w, b)
            e[np.arange(len(y)), y] -= 1
            e *= weight[y][:, None]
            return np.concatenate([e.T @ x, e.sum(axis=0)[:, None], np.full((3, 1), weight[y].sum() / 3)], axis=1)

        s = _sums(rows, gradient, ["features", "label"]).reshape(3, len(mean) + 2)
        total, rate = s[:, -1].sum(), config.rate / (1 + i * config.decay)
        w = w - rate * (s[:, :-2] / total + config.l2 * w)
        b = b - rate * s[:, -2] / total
    return Model(mean.tolist(), scale.tolist(), w.tolist(), b.tolist())


def with_probabilities(rows: DataFrame, model: Model, temperature: float | None = None) -> DataFrame:
    """M5: ``p_keep, p_review, p_reject`` as built-in expressions over the model's weights."""
    z = F.transform(F.arrays_zip(F.col("features").alias("x"), F.array(*map(F.lit, model.mean)).alias("m"), F.array(*map(F.lit, model.scale)).alias("s")), lambda t: (t["x"] - t["m"]) / t["s"])
    out = rows.withColumn("_z", z)
    score = [F.aggregate(F.zip_with("_z", F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) + F.lit(bias) for w, bias in zip(model.weights, model.biases)]
    for k, s in enumerate(score):
        out = out.withColumn(f"_l{k}", s)
    p = softmax([F.col(f"_l{k}") for k in range(3)], model.temperature if temperature is None else temperature)
    return out.withColumns({f"p_{name}": x for name, x in zip(CLASSES, p)}).drop("_z", "_l0", "_l1", "_l2")


def log_loss(probability_of_label: Column) -> Column:
    return F.avg(-F.log(F.greatest(probability_of_label, F.lit(1e-7))))


def of_label(prefix: str = "p_") -> Column:
    return F.when(F.col("label") == 0, F.col(prefix + "keep")).when(F.col("label") == 1, F.col(prefix + "review")).otherwise(F.col(prefix + "reject"))


def select_temperature(validation: DataFrame, model: Model, config: TrainingConfig = TrainingConfig()) -> float:
    """M3: the temperature of the least log-loss, ties to the lower one; one pass for all of them."""
    rows = [with_probabilities(validation, model, t).select(F.lit(t).alias("t"), of_label().alias("p")) for t in config.temperatures]
    best = reduce(DataFrame.unionByName, rows).groupBy("t").agg(F.round(log_loss(F.col("p")), 9).alias("loss")).orderBy("loss", "t").first()
    return float(best["t"]) if best is not None else 1.0


def fit_pairwise(pairs: DataFrame, model: Model, config: TrainingConfig = TrainingConfig()) -> list[float]:
    """M4: logistic weights on normalised feature differences of ``chosen_features`` and ``other_features``; empty below the least number of pairs."""
    rows = cut(pairs.select("chosen_features", "other_features"))
    n = rows.count()
    if n < config.pairwise_least:
        return []
    scale = np.array(model.scale)
    w = np.zeros(len(scale))
    for i in range(config.steps):

        def gradient(pdf: pd.DataFrame, w=w) -> np.ndarray:
            d = (np.stack(pdf["chosen_features"].to_numpy()) - np.stack(pdf["other_features"].to_numpy())) / scale
            return -(d / (1 + np.exp(np.clip(d @ w, -500, 500)))[:, None]).sum(axis=0)

        g = _sums(rows, gradient, ["chosen_features", "other_features"])
        w = w - config.rate / (1 + i * config.decay) * (g / n + config.l2 * w)
    return w.tolist()


def decide(predicted: DataFrame) -> DataFrame:
    """The top class and its lead; strength high, moderate, low, or abstain with its reason; ties to the earlier class."""
    p = F.array(*[F.col(f"p_{c}") for c in CLASSES])
    ranked = F.sort_array(p, asc=False)
    out = predicted.withColumns({"top": F.array_max(p), "margin": F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1)), "decision": F.element_at(F.array(*map(F.lit, CLASSES)), F.array_position(p, F.array_max(p)).cast("int"))})
    t, m = F.col("top"), F.col("margin")
    strength = F.when((t >= 0.78) & (m >= 0.15), "high").when((t >= 0.60) & (m >= 0.10), "moderate").when((t >= 0.50) & (m >= 0.05), "low").otherwise("abstain")
    return out.withColumn("strength", strength).withColumn("reason", F.when(F.col("strength") == "abstain", F.when(t < 0.60, "low_confidence").otherwise("close_classes")))


def contributions(rows: DataFrame, model: Model, names: list[str], label: int, most: int = 5) -> DataFrame:
    """The largest contributions of a class's features, by size, ties by name."""
    parts = F.array(*[F.struct(F.lit(n).alias("name"), ((F.get("features", F.lit(i)) - m) / s * w).alias("c")) for i, (n, m, s, w) in enumerate(zip(names, model.mean, model.scale, model.weights[label]))])
    big = F.filter(parts, lambda x: F.abs(x["c"]) > 1e-4)
    keyed = F.transform(big, lambda x: F.struct((-F.round(F.abs(x["c"]), 9)).alias("k"), x["name"].alias("name"), x["c"].alias("c")))
    return rows.withColumn("explanations", F.transform(F.slice(F.array_sort(keyed), 1, most), lambda x: F.struct(x["name"].alias("name"), x["c"].alias("contribution"))))


def readiness(rows: DataFrame, evaluation: dict[str, float], least: dict[str, float] | None = None) -> DataFrame:
    """The named conditions of a usable model and the state they give."""
    need = {"rows": 48, "classes": 2, "per_class": 8, "projects": 2, "validation_rows": 8, "macro_f1": 0.55} | (least or {})
    seen = rows.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("label").alias("classes"), F.countDistinct("project_id").alias("projects"), *[F.count_if(F.col("label") == k).alias(f"n{k}") for k in range(3)])
    per = F.least(*[F.when(F.col(f"n{k}") > 0, F.col(f"n{k}")) for k in range(3)])
    got = {"rows": F.col("rows"), "classes": F.col("classes"), "per_class": F.coalesce(per, F.lit(0)), "projects": F.col("projects"), "validation_rows": F.lit(evaluation.get("validation_rows", 0)), "macro_f1": F.lit(evaluation.get("macro_f1", 0.0))}
    cond = F.array(*[F.struct(F.lit(k).alias("name"), v.cast("double").alias("observed"), F.lit(float(need[k])).alias("required"), (v >= need[k]).alias("met")) for k, v in got.items()])
    state = F.when(F.col("rows") == 0, "not_ready").when(F.forall("conditions", lambda c: c["met"]), "ready").otherwise("learning")
    return seen.withColumn("conditions", cond).withColumn("state", state).select("state", "conditions")
