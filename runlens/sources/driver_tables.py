"""The engine's input shapes (metrics, history, runs, predictions) over the star-schema tables.

Every function takes a :class:`Tables` and returns a DataFrame with work proportional to the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.ordering import ordered_index
from runlens.functions.probs import items, sigmoid, softmax
from runlens.operators.cascade import compose_probabilities
from runlens.vocab import labels_array


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")


METRIC_OF_EVENT = {
    "click": "train_loss",
    "view": "val_loss",
    "purchase": "train_acc",
    "signup": "val_acc",
    "error": "grad_norm",
}


def class_at(n: Column) -> Column:
    return F.get(labels_array(), n.cast("int"))


def metrics(t: Tables) -> DataFrame:
    """Tracker-export shape (run_id, metric, step, ts, seq, value) from ``events``."""
    e = t.events.select("event_id", "ts", "user_id", "event_type", "value")
    ranked = ordered_index(
        e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], F.to_date("ts"), out="step"
    )
    metric = F.lit(None).cast("string")
    for event, name in METRIC_OF_EVENT.items():
        metric = F.when(F.col("event_type") == event, name).otherwise(metric)
    value = (
        F.when(F.col("event_type").isin("click", "view"), F.col("value") / F.lit(100.0))
        .when(F.col("event_type").isin("purchase", "signup"), F.col("value") / (F.col("value") + F.lit(50.0)))
        .otherwise(F.col("value"))
    )
    return ranked.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run_id"),
        metric.alias("metric"),
        F.col("step").cast("long").alias("step"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        value.alias("value"),
    )


def history(t: Tables) -> DataFrame:
    """Wide curves (run_id, pos, train_loss, val_loss, train_acc, val_acc, grad_norm)."""
    m = metrics(t)
    return m.groupBy("run_id", F.col("step").alias("pos")).agg(
        *[F.max(F.when(F.col("metric") == c, F.col("value"))).alias(c) for c in METRIC_OF_EVENT.values()]
    )


def history_with_gaps(t: Tables) -> DataFrame:
    """``history`` with NaN injected at every seventh epoch."""
    h = history(t)
    nan = F.lit(float("nan"))
    return h.select(
        "run_id",
        "pos",
        *[
            F.when(F.col(c).isNotNull() & (F.col("pos") % 7 == 5), nan).otherwise(F.col(c)).alias(c)
            for c in METRIC_OF_EVENT.values()
        ],
    )


def meta(t: Tables) -> DataFrame:
    """(run_id, meta_json): the props of each user's first event."""
    first = t.events.groupBy("user_id").agg(F.min_by("props", F.struct("ts", "event_id")).alias("meta_json"))
    return first.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run_id"), "meta_json")


def runs_small(t: Tables) -> DataFrame:
    """One run per user of ``events``, with the run-record columns."""
    e = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    u = e.groupBy("user_id").agg(F.max("n").alias("n_history_rows"))
    uid = F.col("user_id")
    return u.select(
        F.concat(F.lit("u"), uid.cast("string")).alias("run_id"),
        uid.alias("ord"),
        F.when(uid % 13 != 12, class_at(uid % 6)).alias("primary_label"),
        F.get(F.array(*map(F.lit, ("mild", "moderate", "severe", "none"))), (uid % 4).cast("int")).alias("severity"),
        F.concat(F.lit("ds"), (uid % 8).cast("string")).alias("dataset"),
        F.when(uid % 17 != 0, F.concat(F.lit("e"), (uid % 30).cast("string"))).alias("entry_id"),
        (uid % 11 == 0).alias("is_multi_label"),
        F.col("n_history_rows").cast("long").alias("n_history_rows"),
    )


def runs_bulk(t: Tables) -> DataFrame:
    """One run per order; the history length is the number of its line items."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    cust = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    o = (
        t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
        .join(lines, "o_orderkey", "left")
        .join(cust, "o_custkey", "left")
    )
    key, prio = F.col("o_orderkey"), F.col("o_orderpriority")
    return o.select(
        F.concat(F.lit("o"), key.cast("string")).alias("run_id"),
        key.alias("ord"),
        F.when(key % 101 != 0, class_at(key % 6)).alias("primary_label"),
        F.when(prio.isin("1-URGENT", "2-HIGH"), "severe")
        .when(prio == "3-MEDIUM", "moderate")
        .when(prio == "5-LOW", "mild")
        .alias("severity"),
        F.col("c_mktsegment").alias("dataset"),
        F.concat(F.lit("e"), F.col("o_custkey").cast("string")).alias("entry_id"),
        ((F.col("o_orderstatus") == "P") & (key % 5 == 0)).alias("is_multi_label"),
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_history_rows"),
    )


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e"), "label")


def predictions(t: Tables) -> DataFrame:
    """Flat, cascade and stage probabilities for every row of ``embeddings``.

    run_id, vec_id, dataset, entry_id, y_true, flat[6], cascade[6], stage_probs[9]
    (``cascade`` composes all stages for every row).
    """
    v = vectors(t)
    e = [F.get("e", F.lit(i)) for i in range(14)]
    p_healthy = sigmoid(e[6] * 3.0)
    p_data = sigmoid(e[7] * 3.0)
    two, three = softmax([x * 3.0 for x in e[8:10]]), softmax([x * 3.0 for x in e[10:13]])
    stage = F.array(
        p_healthy, F.lit(1.0) - p_healthy, p_data, F.lit(1.0) - p_data, *items(two, 2), *items(three, 3)
    )
    base = v.select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("run_id"),
        "vec_id",
        (F.col("vec_id") % 8).alias("dataset"),
        (F.col("vec_id") % 100).alias("entry_id"),
        class_at(F.col("label") % 6).alias("y_true"),
        softmax([x * 2.0 for x in e[:6]]).alias("flat"),
        stage.alias("stage_probs"),
        e[13].alias("raw_confidence"),
    )
    return base.withColumn("cascade", compose_probabilities(F.col("stage_probs"), gate=None))


def feature_vectors(t: Tables, separable: bool = False) -> DataFrame:
    """(run_id, vec_id, y, x[64]) feature rows; ``separable`` shifts one dimension per class."""
    v = vectors(t)
    cls = F.col("label") % 6
    x = F.col("e")
    if separable:
        x = F.array(
            *[
                F.get("e", F.lit(i)) + (F.when(cls + 20 == i, 1.5).otherwise(0.0) if 20 <= i < 26 else F.lit(0.0))
                for i in range(64)
            ]
        )
    return v.select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("run_id"),
        "vec_id",
        (F.col("vec_id") % 100).alias("entry_id"),
        class_at(cls).alias("y"),
        x.alias("x"),
    )


def bulk_predictions(t: Tables) -> DataFrame:
    """Label-level predictions for every line item."""
    li = t.lineitem
    return li.select(
        class_at(F.col("l_linenumber") % 6).alias("y_true"),
        class_at(F.col("l_quantity").cast("int") % 6).alias("pred_a"),
        class_at(F.col("l_suppkey") % 6).alias("pred_b"),
        (F.lit(1.0) - F.col("l_discount")).alias("confidence"),
        F.col("l_orderkey").alias("group_id"),
        F.col("l_returnflag").alias("slice"),
    )


