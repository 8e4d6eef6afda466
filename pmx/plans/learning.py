"""A gradient-boosted edge model: features, chronological split, metrics against the price, deciles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pmx.functions import d, rnd, seconds_between
from pmx.operators.graph import checkpointed
from pmx.plans.categories import calibration
from pmx.plans.prices import resolved
from pmx.registry import register
from pmx.views import oracle

C = F.col
FEATURES = ["implied", "log_count", "log_tte", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "side"]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a resolved trade: the label (taker won), the implied chance and cyclic and logarithmic features."""
    hour, dow = F.hour("created_time"), F.dayofweek("created_time") - 1
    turn = lambda x, n: x * F.lit(6.283185307179586) / F.lit(float(n))
    tte = F.greatest(seconds_between(C("close_time"), C("created_time")), F.lit(0.0))
    return resolved(spark, sf_dir).select(
        "trade_id", "created_time", d("tw").alias("label"), (C("tp") / F.lit(100.0)).alias("implied"), F.log1p(d("count")).alias("log_count"), F.log1p(tte).alias("log_tte"),
        F.sin(turn(hour, 24)).alias("hour_sin"), F.cos(turn(hour, 24)).alias("hour_cos"), F.sin(turn(dow, 7)).alias("dow_sin"), F.cos(turn(dow, 7)).alias("dow_cos"), F.when(C("taker_side") == "yes", 1.0).otherwise(0.0).alias("side"))


@register("ml_features", oracle("""SELECT trade_id, CAST(tw AS DOUBLE) AS label, ROUND(tp / 100.0, 6) AS implied, ROUND(LN(1 + count), 6) AS log_count, ROUND(LN(1 + GREATEST(EPOCH(close_time - created_time), 0)), 6) AS log_tte, ROUND(SIN(EXTRACT(HOUR FROM created_time) * 6.283185307179586 / 24.0), 6) AS hour_sin,
  ROUND(COS(EXTRACT(HOUR FROM created_time) * 6.283185307179586 / 24.0), 6) AS hour_cos, ROUND(SIN(EXTRACT(DOW FROM created_time) * 6.283185307179586 / 7.0), 6) AS dow_sin, ROUND(COS(EXTRACT(DOW FROM created_time) * 6.283185307179586 / 7.0), 6) AS dow_cos, CASE WHEN taker_side = 'yes' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS side FROM rt"""))
def ml_features(spark, sf_dir):
    return features(spark, sf_dir).select("trade_id", "label", *[rnd(C(c)).alias(c) for c in FEATURES[:-1]], "side")


def split(df: DataFrame, holdout_days: int = 7) -> tuple[DataFrame, DataFrame]:
    """Training rows before the last days, held-out rows in them; the border is one row."""
    edge = df.agg((F.max("created_time") - F.make_dt_interval(F.lit(holdout_days))).alias("edge"))
    x = df.crossJoin(F.broadcast(edge))  # one row
    return x.filter("created_time < edge").drop("edge"), x.filter("created_time >= edge").drop("edge")


def fit_and_score(train: DataFrame, test: DataFrame, columns: list[str], trees: int = 10) -> DataFrame:
    """``test`` with the chance p of a boosted model of ``train``."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    va = VectorAssembler(inputCols=columns, outputCol="x")
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=3, stepSize=0.1, seed=11).fit(va.transform(train).select("x", "label"))
    return model.transform(va.transform(test)).withColumn("p", vector_to_array("probability")[1]).select(*test.columns, "p")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out rows with the model's chance p beside the implied one, as a table."""
    train, test = split(checkpointed(features(spark, sf_dir)))
    return checkpointed(fit_and_score(train, test, FEATURES).select("trade_id", "label", "implied", "p"))


def log_loss(p: str):
    x = F.least(F.greatest(C(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    return -F.avg(C("label") * F.log(x) + (1 - C("label")) * F.log(1 - x))


#: Sets of features that a fold chooses from.
CHOICES = {"price": FEATURES[:1], "price and trade": FEATURES[:3] + FEATURES[-1:], "all": FEATURES}


def walk_forward(table: DataFrame, days: int = 7, choices: dict[str, list[str]] = CHOICES) -> DataFrame:
    """Every row from the third fold on, with fold, choice and the chance p of a model that saw earlier folds only.

    Folds are stretches of ``days`` from the first row. Of a fold's past the last stretch is kept to choose the features on, by log loss; the model is
    then fitted on all of the past. The number of folds is that of the stretches, never of rows. A past of one label is left out.
    """
    start = table.agg(F.date_trunc("day", F.min("created_time")).cast("timestamp_ntz").alias("start"))
    t = checkpointed(table.crossJoin(F.broadcast(start)).withColumn("fold", F.floor(seconds_between(C("created_time"), C("start")) / F.lit(86400.0 * days)).cast("int")).drop("start"))  # one row
    out = None
    for fold in range(2, 1 + (t.agg(F.max("fold")).first()[0] or 0)):
        past, past_but_last, last, now = (t.filter(x) for x in (C("fold") < fold, C("fold") < fold - 1, C("fold") == fold - 1, C("fold") == fold))
        if past_but_last.select("label").distinct().count() < 2 or not last.take(1) or not now.take(1):
            continue
        loss = {name: fit_and_score(past_but_last, last, columns, 5).agg(log_loss("p")).first()[0] for name, columns in choices.items()}
        best = min(loss, key=lambda k: (loss[k], k))
        part = fit_and_score(past, now, choices[best]).withColumn("choice", F.lit(best))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else t.limit(0).withColumn("p", F.lit(0.0)).withColumn("choice", F.lit(""))


@register("ml_weekly")
def ml_weekly(spark, sf_dir):
    """Each week's log loss and Brier score of the model and of the price, and which features it chose."""
    w = walk_forward(features(spark, sf_dir))
    brier = lambda c: F.avg((C(c) - C("label")) * (C(c) - C("label")))
    m = w.groupBy("fold", "choice").agg(F.count("*").alias("n"), log_loss("p").alias("model_log_loss"), log_loss("implied").alias("price_log_loss"), brier("p").alias("model_brier"), brier("implied").alias("price_brier"))
    return m.withColumn("better", C("model_log_loss") < C("price_log_loss"))


@register("ml_split_metrics")
def ml_split_metrics(spark, sf_dir):
    """Brier, log loss and AUC of the model and of the price on the held-out week."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    s = scored(spark, sf_dir)
    out = None
    for name in ("p", "implied"):
        m = calibration(s.select(F.lit("model" if name == "p" else "price").alias("source"), C(name).alias("p"), F.lit(1.0).alias("n"), C("label").alias("w")), "source")
        auc = BinaryClassificationEvaluator(rawPredictionCol=name, labelCol="label").evaluate(s)
        m = m.withColumn("auc", F.lit(auc))
        out = m if out is None else out.unionByName(m)
    return out


@register("ml_deciles")
def ml_deciles(spark, sf_dir):
    """Realised excess by tenths of the model's edge over the price; cut points are quantiles of the values."""
    s = scored(spark, sf_dir).withColumn("edge", C("p") - C("implied"))
    cuts = s.agg(F.percentile("edge", [i / 10 for i in range(1, 10)]).alias("cuts"))
    tenth = F.size(F.filter("cuts", lambda c: c < C("edge")))
    return s.crossJoin(F.broadcast(cuts)).groupBy(tenth.alias("decile")).agg(F.count("*").alias("n"), F.avg("edge").alias("edge"), F.avg(C("label") - C("implied")).alias("realised"))
