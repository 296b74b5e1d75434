"""Class prototypes, distances to them, and alignment of curves by dynamic time warping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.numeric import finite
from runlens.functions.ordering import exact_quantiles
from runlens.session import ship_package
from runlens.vocab import CLASSES

EPS = 1e-9


def prototype_bank(train: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(class, feature, mean, train_mean, train_std, z) from labelled feature vectors.

    Means are combined map-side; the result has at most classes x features rows. A class without
    training rows is absent.
    """
    long = train.select(F.col(y).alias("class"), F.posexplode(x).alias("feature", "v"))
    cells = long.groupBy("class", "feature").agg(F.avg("v").alias("mean"))
    overall = long.groupBy("feature").agg(
        F.avg("v").alias("train_mean"), (F.stddev_pop("v") + F.lit(EPS)).alias("train_std")
    )
    z = (F.col("mean") - F.col("train_mean")) / F.col("train_std")
    return cells.where(F.col("class").isin(*CLASSES)).join(overall, "feature").select(
        "class", "feature", "mean", "train_mean", "train_std", z.alias("z")
    )


def _bank_row(bank: DataFrame) -> DataFrame:
    """The bank as one struct of arrays (classes x features values, a fixed small size)."""

    def ordered(cls: str, value: str):
        pairs = F.collect_list(F.when(F.col("class") == cls, F.struct("feature", F.col(value).alias("v"))))
        return F.transform(F.array_sort(pairs), lambda s: s["v"])

    def common(value: str):
        # Per-feature values repeat in every class; keep one by distinct (feature, value).
        return F.transform(F.array_sort(F.collect_set(F.struct("feature", F.col(value).alias("v")))), lambda s: s["v"])

    fields = [common("train_mean").alias("m"), common("train_std").alias("s")]
    for c in CLASSES:
        fields += [ordered(c, "mean").alias(f"p_{c}"), ordered(c, "z").alias(f"z_{c}")]
    one = bank.agg(*fields)
    # Centre each prototype here, once, rather than per scored row.
    cols = ["m", "s"]
    for c in CLASSES:
        mean = F.try_divide(_sum(F.col(f"p_{c}")), F.size(f"p_{c}"))
        one = one.withColumn(f"c_{c}", _shift(F.col(f"p_{c}"), mean)).withColumn(
            f"q_{c}", _sum(F.transform(f"c_{c}", lambda a: a * a))
        )
        cols += [f"z_{c}", f"c_{c}", f"q_{c}"]
    return one.select(F.struct(*cols).alias("bank"))


def _sum(arr):
    return F.aggregate(arr, F.lit(0.0), lambda a, v: a + v)


def _shift(arr, by):
    return F.transform(arr, lambda v: v - by)


def prototype_distances(table: DataFrame, bank: DataFrame, x: str = "x", keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """keys + proto_neuc_<class> (normalised Euclidean) and proto_corr_<class> (1 - Pearson)."""
    t = table.select(*keys, x).withColumn("b", _bank_row(bank).scalar())
    t = t.withColumn(
        "xz", F.zip_with(F.zip_with(x, F.col("b.m"), lambda a, m: a - m), F.col("b.s"), lambda a, s: a / s)
    ).withColumn("mx", _sum(F.col(x)) / F.size(x))
    t = t.withColumn("xc", F.transform(F.col(x), lambda a: a - F.col("mx")))
    t = t.withColumn("sxx", _sum(F.transform("xc", lambda a: a * a)))
    out = []
    for c in CLASSES:
        pc, z, q = F.col(f"b.c_{c}"), F.col(f"b.z_{c}"), F.col(f"b.q_{c}")
        there = F.size(pc) > 0
        neuc = F.sqrt(_sum(F.zip_with("xz", z, lambda a, b: (a - b) * (a - b))))
        num = _sum(F.zip_with("xc", pc, lambda a, b: a * b))
        den = F.sqrt(F.col("sxx") * q + F.lit(1e-30))
        out += [F.when(there, neuc).alias(f"proto_neuc_{c}"), F.when(there, F.lit(1.0) - num / den).alias(f"proto_corr_{c}")]
    return t.select(*keys, *out)


def curve_prototypes(history: DataFrame, labels: DataFrame, column: str = "val_loss") -> DataFrame:
    """(class, pos, value): median over a class's runs at each position, up to its shortest curve."""
    h = history.select("run_id", "pos", F.col(column).alias("v"))
    lengths = h.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("v").isNotNull()).alias("has"))
    train = labels.select("run_id", F.col("primary_label").alias("class")).where(F.col("class").isin(*CLASSES))
    used = lengths.where("has").join(train, "run_id")
    shortest = used.groupBy("class").agg(F.min("n").alias("m"))
    # Six rows at most: safe to broadcast whatever the corpus size.
    runs = used.select("run_id", "class").join(F.broadcast(shortest), "class")
    cells = h.join(runs, "run_id").where(F.col("pos") < F.col("m"))
    return exact_quantiles(
        cells.select("class", "pos", finite(F.col("v")).alias("value")), ["class", "pos"], "value", {"value": 0.5}
    )


BLOCK = 4096


def _advance(state: np.ndarray, curve: np.ndarray, proto: np.ndarray) -> np.ndarray:
    """Push warping costs through the curve's points; ``state`` holds one row per start column.

    Column 0 is "no prototype point used yet", reachable only before the first curve point.
    """
    for a in curve:
        cost = np.abs(a - proto)
        reach = np.minimum(state[:, 1:], state[:, :-1])
        total = np.cumsum(cost)
        before = np.concatenate(([0.0], total[:-1]))
        nxt = np.full_like(state, np.inf)
        nxt[:, 1:] = total + np.minimum.accumulate(reach - before, axis=1)
        state = nxt
    return state


def _warped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs per (run, class) from rows sorted by run, class and block; block -1 holds the prototype.

    Only one frontier of costs, as long as the prototype, is kept, however long the run.
    """
    key = proto = state = None

    def closed() -> tuple[list, list, list, list]:
        done = key is not None and state is not None
        return ([key[0]], [key[1]], [len(proto)], [float(state[0, -1])]) if done else ([], [], [], [])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = [sum(c, []) for c in zip(*rows)] if rows else [[], [], [], []]
        types = (pa.string(), pa.string(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["run_id", "class", "m", "cost"])

    for rows in batches:
        out = []
        runs, classes, blocks = (rows.column(i).to_pylist() for i in range(3))
        for i, own in enumerate(zip(runs, classes)):
            values = np.asarray(rows.column(3)[i].values.to_numpy(zero_copy_only=False), float)
            if own != key:
                out.append(closed())
                key, proto, state = own, None, None
            if blocks[i] < 0:
                proto, state = values, np.full((1, len(values) + 1), np.inf)
                state[0, 0] = 0.0
            elif state is not None:
                state = _advance(state, values, proto)
        yield packed(out)
    yield packed([closed()])


def dtw_distances(history: DataFrame, prototypes: DataFrame, column: str = "val_loss", block: int = BLOCK) -> DataFrame:
    """run_id + proto_dtw_<class>: warping distance over (curve length + prototype length).

    A run's blocks of at most ``block`` points pass through one task in order, behind the prototype, as a sorted stream.
    """
    ship_package(history.sparkSession)
    pts = history.select("run_id", "pos", finite(F.col(column)).alias("x"), F.floor(F.col("pos") / block).alias("b"))
    pieces = (
        pts.groupBy("run_id", "b")
        .agg(F.array_sort(F.collect_list(F.when(F.col("x").isNotNull(), F.struct("pos", "x")))).alias("p"))
        .select("run_id", "b", F.transform("p", lambda s: s["x"]).alias("xs"))
    )
    shape = pts.groupBy("run_id").agg(F.count("x").alias("n"))
    # Prototypes: one array per class, as long as the class's shortest curve.
    protos = prototypes.where("value is not null").groupBy("class").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("xs")
    )
    each = F.explode(F.array(*map(F.lit, CLASSES))).alias("class")
    heads = shape.select("run_id", each).join(protos, "class").select("run_id", "class", F.lit(-1).cast("long").alias("b"), "xs")
    stream = heads.union(pieces.select("run_id", each, "b", "xs")).repartition("run_id", "class").sortWithinPartitions("run_id", "class", "b")
    costs = stream.mapInArrow(_warped, "run_id string, class string, m long, cost double").join(shape, "run_id")
    dist = F.when((F.col("n") > 0) & (F.col("m") > 0), F.col("cost") / (F.col("n") + F.col("m")))
    wide = costs.groupBy("run_id").agg(
        *[F.max(F.when(F.col("class") == c, dist)).alias(f"proto_dtw_{c}") for c in CLASSES]
    )
    return history.select("run_id").distinct().join(wide, "run_id", "left")


def assemble(base: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """Join feature blocks on run_id."""
    out = base
    for b in blocks:
        out = out.join(b, "run_id", "left")
    return out


VARIANTS = ("base", "prototypes", "base+prototypes")


def matrix(base: DataFrame, blocks: list[DataFrame], variant: str, keep: tuple[str, ...] = ("run_id", "primary_label")) -> DataFrame:
    """One of the three feature matrices over the rows of ``base``: its own columns, the blocks' columns, or both."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}")
    if variant == "base":
        return base
    return assemble(base.select(*keep) if variant == "prototypes" else base, blocks)
