"""Bootstrap intervals from sufficient statistics.

Resampling n rows with replacement only changes how often each kind of row is drawn, and metrics only
depend on those counts. So Spark reduces the rows to counts per kind, and each replicate is one
multinomial draw over the kinds: the same distribution as drawing rows, at a cost that does
not grow with n. Replicates are drawn in chunks, which are spread over tasks and seeded by their number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runlens.session import ship_package
from runlens.vocab import CLASSES

OTHER = "<other>"


def in_vocabulary(label: Column, labels=CLASSES) -> Column:
    """Unknown labels share one kind, which keeps the number of kinds fixed."""
    return F.when(label.isin(*labels), label).otherwise(OTHER)


def _scores(y: np.ndarray, p: np.ndarray, w: np.ndarray, metric: str, labels: tuple[str, ...]) -> np.ndarray:
    """The metric for each row of ``w`` (replicates x kinds); NaN without any drawn row."""
    total = w.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        if metric == "accuracy":
            return np.where(total > 0, w[:, y == p].sum(axis=1) / total, np.nan)
        support = np.stack([w[:, y == c].sum(axis=1) for c in labels], axis=1)
        hits = np.stack([w[:, (y == c) & (p == c)].sum(axis=1) for c in labels], axis=1)
        den = support + np.stack([w[:, p == c].sum(axis=1) for c in labels], axis=1)
        f1 = np.where(den > 0, 2.0 * hits / den, 0.0)
        if metric == "macro_f1":
            out = f1.mean(axis=1)
        elif metric == "weighted_f1":
            out = np.where(support.sum(axis=1) > 0, (f1 * support).sum(axis=1) / support.sum(axis=1), 0.0)
        elif metric.startswith("f1:"):
            out = f1[:, labels.index(metric[3:])]
        else:
            raise ValueError(f"unsupported metric {metric!r}")
    return np.where(total > 0, out, np.nan)


def _cohen_h(pa: np.ndarray, pb: np.ndarray) -> np.ndarray:
    return 2.0 * (np.arcsin(np.sqrt(np.clip(pb, 0, 1))) - np.arcsin(np.sqrt(np.clip(pa, 0, 1))))


def cohen_h(pa: Column, pb: Column) -> Column:
    def angle(p: Column) -> Column:
        return F.asin(F.sqrt(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))))

    return F.lit(2.0) * (angle(pb) - angle(pa))


def magnitude(h: Column) -> Column:
    a = F.abs(h)
    return F.when(a < 0.2, "trivial").when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large")


def kinds(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Counts per (by, kind): the only step that sees all rows."""
    return df.groupBy(*by, *[in_vocabulary(F.col(c)).alias(c) for c in columns]).agg(F.count(F.lit(1)).alias("n"))


#: Replicates drawn at once.
CHUNK = 128


def _replicates(cells: DataFrame, by: list[str], columns: list[str], n_bootstrap: int, fn, schema: str) -> DataFrame:
    """Rows (by, b, result) with ``fn(columns, counts, chunk, size) -> arrays``; b = 0, alone in chunk 0, is the point."""
    ship_package(cells.sparkSession)
    rows = F.collect_list(F.struct(*columns, "n")).alias("cells")
    per = cells.groupBy(*by).agg(rows) if by else cells.agg(rows)
    work = per.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(-(-n_bootstrap // CHUNK)))))
    # One group may be all there is: spread the chunks over tasks.
    work = work.repartition(*by, "chunk")
    names = [part.split()[0] for part in schema.split(", ")]

    @F.pandas_udf(f"array<struct<b: long, {schema.replace(' ', ': ').replace(',: ', ', ')}>>")
    def run(cells_: pd.Series, chunk: pd.Series) -> pd.Series:
        out = []
        for cs, c in zip(cells_, chunk):
            cs = sorted(cs, key=lambda r: tuple(r[k] for k in columns))
            arrays = {k: np.array([r[k] for r in cs], dtype=object) for k in columns}
            size = 1 if c == 0 else min(CHUNK, n_bootstrap - (c - 1) * CHUNK)
            first = 0 if c == 0 else (c - 1) * CHUNK + 1
            values = fn(arrays, np.array([r["n"] for r in cs], dtype=np.int64), int(c), int(size))
            out.append([{"b": first + i, **{k: v[i] for k, v in zip(names, values)}} for i in range(size)])
        return pd.Series(out)

    return work.select(*by, F.explode(run("cells", "chunk")).alias("r")).select(*by, "r.*")


def _draw(n: np.ndarray, seed: int, chunk: int, size: int) -> np.ndarray:
    """``size`` replicates of the counts; chunk 0 has the counts themselves."""
    total = int(n.sum())
    if chunk == 0 or total == 0:
        return np.repeat(n[None, :], size, axis=0)
    return np.random.default_rng([seed, chunk]).multinomial(total, n / total, size=size)


def _interval(v: str, alpha: float) -> list[Column]:
    x = F.when(F.col("b") > 0, F.col(v))
    return [F.percentile(x, F.lit(alpha / 2)).alias(f"{v}_low"), F.percentile(x, F.lit(1 - alpha / 2)).alias(f"{v}_high")]


def metric_interval(
    df: DataFrame, by: list[str] | None = None, *, metric: str = "macro_f1", pred: str = "pred", n_bootstrap: int = 1000,
    alpha: float = 0.05, seed: int = 0, labels: tuple[str, ...] = CLASSES,
) -> DataFrame:
    """(by, n, point_estimate, ci_low, ci_high, n_bootstrap) of one metric."""
    by = by or []
    cells = kinds(df.withColumnRenamed(pred, "pred") if pred != "pred" else df, by, ["y_true", "pred"])

    def fn(a, n, chunk, size):
        return _scores(a["y_true"], a["pred"], _draw(n, seed, chunk, size), metric, labels), [int(n.sum())] * size

    reps = _replicates(cells, by, ["y_true", "pred"], n_bootstrap, fn, "v double, n long")
    return reps.groupBy(*by).agg(
        F.max("n").alias("n"), F.max(F.when(F.col("b") == 0, F.col("v"))).alias("point_estimate"), *_interval("v", alpha)
    ).withColumnsRenamed({"v_low": "ci_low", "v_high": "ci_high"}).withColumn("n_bootstrap", F.lit(n_bootstrap))


def _summarise_delta(reps: DataFrame, by: list[str], alpha: float, n_comparisons: int) -> DataFrame:
    better = F.avg(F.when(F.col("b") > 0, (F.col("d") > 0).cast("double")))
    out = reps.groupBy(*by).agg(
        F.max("n").alias("n"), F.max(F.when(F.col("b") == 0, F.col("d"))).alias("delta_point"), *_interval("d", alpha),
        better.alias("p_b_better"), F.max(F.when(F.col("b") == 0, F.col("h"))).alias("cohen_h"), *_interval("h", alpha),
    ).withColumnsRenamed({"d_low": "delta_ci_low", "d_high": "delta_ci_high", "h_low": "cohen_h_ci_low", "h_high": "cohen_h_ci_high"})
    out = out.withColumn("cohen_h_magnitude", magnitude(F.col("cohen_h")))
    corrected = alpha / max(1, n_comparisons)
    return out.withColumns(
        {"alpha_bonferroni": F.lit(corrected), "significant": F.col("p_b_better") >= 1.0 - corrected}
    )


def delta_interval(
    df: DataFrame, by: list[str] | None = None, *, a: str = "pred_a", b: str = "pred_b", metric: str = "macro_f1",
    n_bootstrap: int = 1000, alpha: float = 0.05, seed: int = 0, n_comparisons: int = 1, labels: tuple[str, ...] = CLASSES,
) -> DataFrame:
    """Paired difference b - a: point, interval, P(b better), corrected flag, Cohen's h of the accuracies."""
    by = by or []
    cells = kinds(df.select(*by, "y_true", F.col(a).alias("pred_a"), F.col(b).alias("pred_b")), by, ["y_true", "pred_a", "pred_b"])

    def fn(c, n, chunk, size):
        w = _draw(n, seed, chunk, size)
        d = _scores(c["y_true"], c["pred_b"], w, metric, labels) - _scores(c["y_true"], c["pred_a"], w, metric, labels)
        v = _draw(n, seed + 1, chunk, size)
        h = _cohen_h(
            _scores(c["y_true"], c["pred_a"], v, "accuracy", labels), _scores(c["y_true"], c["pred_b"], v, "accuracy", labels)
        )
        return d, h, [int(n.sum())] * size

    reps = _replicates(cells, by, ["y_true", "pred_a", "pred_b"], n_bootstrap, fn, "d double, h double, n long")
    return _summarise_delta(reps, by, alpha, n_comparisons)


GROUPS_PER_BUCKET = 20_000


def grouped_delta_interval(
    df: DataFrame, group: str, *, a: str = "pred_a", b: str = "pred_b", metric: str = "macro_f1", n_bootstrap: int = 1000,
    alpha: float = 0.05, seed: int = 0, n_comparisons: int = 1, labels: tuple[str, ...] = CLASSES,
) -> DataFrame:
    """Cluster bootstrap: whole groups are drawn with replacement, as many as there are groups.

    Groups are hashed into buckets, the leaves of a binary tree over hash prefixes. How many draws a bucket gets is found on its
    way down: at each node a binomial, seeded by replicate and node, splits the node's draws by the group counts of its two
    sides. Inside the bucket the draws are uniform. Together this is exactly the multinomial over all groups, and no
    task looks at other buckets than its own. A group contributes its few counts per kind, so a group holding most rows costs no
    more than any other; rows without a group are one group.
    """
    ship_package(df.sparkSession)
    known = (*labels, OTHER)

    def code(c: str) -> Column:
        pos = F.array_position(F.array(*map(F.lit, labels)), F.col(c))
        return F.when(pos > 0, pos - 1).otherwise(len(labels)).cast("int")

    size = len(known)
    kind = code("y_true") * (size * size) + code(a) * size + code(b)
    profile = df.select(F.col(group).alias("g"), kind.alias("kind")).groupBy("g", "kind").agg(F.count(F.lit(1)).alias("n"))
    total = profile.select("g").distinct().count()
    depth = max(3, int(np.ceil(np.log2(max(total, 1) / GROUPS_PER_BUCKET))))
    tagged = profile.withColumn("bucket", F.shiftrightunsigned(F.xxhash64("g"), 64 - depth).cast("long"))
    leaves = tagged.select("g", "bucket").distinct().groupBy("bucket").agg(F.count(F.lit(1)).alias("k"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("level")
    shift = lambda by: F.call_function("shiftright", F.col("bucket"), (F.lit(depth) - F.col("level") - by).cast("int"))
    ways = leaves.select("bucket", "k", levels).withColumns({"node": shift(0), "right": shift(1) % 2})
    nodes = ways.groupBy("level", "node").agg(
        F.sum("k").alias("n_node"), F.sum(F.when(F.col("right") == 0, F.col("k")).otherwise(0)).alias("n_left")
    )
    paths = ways.join(nodes, ["level", "node"]).select(F.col("bucket").alias("leaf"), "level", "node", "right", "n_node", "n_left")

    def draw(pdf: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        steps = path.sort_values("level")[["level", "node", "right", "n_node", "n_left"]].to_numpy(np.int64).tolist()
        codes, _ = pd.factorize(pdf["g"], sort=True, use_na_sentinel=False)
        kind_codes, kind_ids = pd.factorize(pdf["kind"], sort=True)
        n, g = pdf["n"].to_numpy(np.int64), codes.max() + 1
        sums = np.empty((n_bootstrap + 1, len(kind_ids)), dtype=np.int64)
        for i in range(n_bootstrap + 1):
            if i == 0:
                w = np.ones(g, dtype=np.int64)
            else:
                share = total
                for level, node, right, n_node, n_left in steps:
                    left = int(np.random.default_rng([seed, i, level, node]).binomial(share, n_left / n_node))
                    share = share - left if right else left
                w = np.random.default_rng([seed, i, depth, bucket]).multinomial(share, np.full(g, 1.0 / g))
            sums[i] = np.bincount(kind_codes, weights=n * w[codes], minlength=len(kind_ids))
        reps = np.repeat(np.arange(n_bootstrap + 1), len(kind_ids))
        return pd.DataFrame({"b": reps, "kind": np.tile(kind_ids, n_bootstrap + 1), "n": sums.ravel()})

    drawn = tagged.groupBy("bucket").cogroup(paths.groupBy("leaf")).applyInPandas(draw, "b long, kind int, n long")
    cells = drawn.groupBy("b", "kind").agg(F.sum("n").alias("n"))
    per = cells.groupBy("b").agg(F.collect_list("kind").alias("kinds"), F.collect_list("n").alias("ns"))

    @F.pandas_udf("d double, h double, n long")
    def score(kinds_: pd.Series, ns: pd.Series) -> pd.DataFrame:
        names, out = np.array(known, dtype=object), []
        for k, w in zip(kinds_, ns):
            k, w = np.asarray(k), np.asarray(w)[None, :]
            y, pa, pb = names[k // (size * size)], names[k // size % size], names[k % size]
            d = _scores(y, pb, w, metric, labels) - _scores(y, pa, w, metric, labels)
            h = _cohen_h(_scores(y, pa, w, "accuracy", labels), _scores(y, pb, w, "accuracy", labels))
            out.append((float(d[0]), float(h[0]), int(w.sum())))
        return pd.DataFrame(out)

    reps = per.select("b", score("kinds", "ns").alias("r")).select("b", "r.*")
    out = _summarise_delta(reps.withColumn("n", F.when(F.col("b") == 0, F.col("n"))), [], alpha, n_comparisons)
    return out.withColumn("n_groups", F.lit(total))


def class_f1_intervals(df: DataFrame, classes: tuple[str, ...] = CLASSES, *, pred: str = "pred", n_bootstrap: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(class, n, point_estimate, ci_low, ci_high) of each class's F1 from tp / fp / fn / tn counts."""
    # Rows become at most 49 counts before they are spread over the classes.
    counts = kinds(df.select("y_true", F.col(pred).alias("pred")), [], ["y_true", "pred"])
    y, p = F.col("y_true"), F.col("pred")
    spread = counts.select(
        "n",
        F.explode(
            F.array(*[
                F.struct(F.lit(c).alias("class"), F.when(y == c, "pos").otherwise("neg").alias("y_true"), F.when(p == c, "pos").otherwise("neg").alias("pred"))
                for c in classes
            ])
        ).alias("s"),
    ).select("n", "s.*")
    cells = spread.groupBy("class", "y_true", "pred").agg(F.sum("n").alias("n"))

    def fn(a, n, chunk, size):
        return _scores(a["y_true"], a["pred"], _draw(n, seed, chunk, size), "f1:pos", ("pos",)), [int(n.sum())] * size

    reps = _replicates(cells, ["class"], ["y_true", "pred"], n_bootstrap, fn, "v double, n long")
    return reps.groupBy("class").agg(
        F.max("n").alias("n"), F.max(F.when(F.col("b") == 0, F.col("v"))).alias("point_estimate"), *_interval("v", alpha)
    ).withColumnsRenamed({"v_low": "ci_low", "v_high": "ci_high"})


def proportion_interval(df: DataFrame, by: list[str], flag: str, *, n_bootstrap: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(by, n, point, ci_low, ci_high) of a share; a replicate is one binomial draw."""
    cells = df.groupBy(*by, F.when(F.col(flag), "1").otherwise("0").alias("s")).agg(F.count(F.lit(1)).alias("n"))

    def fn(a, n, chunk, size):
        w = _draw(n, seed, chunk, size)
        return w[:, a["s"] == "1"].sum(axis=1) / w.sum(axis=1), [int(n.sum())] * size

    reps = _replicates(cells, by, ["s"], n_bootstrap, fn, "v double, n long")
    return reps.groupBy(*by).agg(
        F.max("n").alias("n"), F.max(F.when(F.col("b") == 0, F.col("v"))).alias("point"), *_interval("v", alpha)
    ).withColumnsRenamed({"v_low": "ci_low", "v_high": "ci_high"})


def holm(df: DataFrame, p_better: str = "p_b_better", key: str = "comparison", alpha: float = 0.05) -> DataFrame:
    """Holm step-down over a small family of comparisons, with 1 - P(better) as the p-value."""
    order = W.partitionBy().orderBy(F.col("pseudo_p"), F.col(key))
    m = F.col("family_size")
    t = df.withColumn("pseudo_p", F.lit(1.0) - F.col(p_better)).withColumn("family_size", F.count(F.lit(1)).over(W.partitionBy()))
    t = t.withColumn("rank", F.row_number().over(order)).withColumn("threshold", F.lit(alpha) / (m - F.col("rank") + 1))
    t = t.withColumn("pass", (F.col("pseudo_p") <= F.col("threshold")).cast("int"))
    running = F.min("pass").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return t.withColumn("significant", running == 1).select(
        key, p_better, F.col("rank").cast("long").alias("rank"), F.col("threshold").alias("holm_threshold_pseudo_p"),
        (F.lit(1.0) - F.col("threshold")).alias("holm_threshold_p_better"), "significant", F.col("family_size").cast("long").alias("family_size"),
    )

