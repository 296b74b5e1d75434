"""Multiclass gradient boosting: softmax residuals shared by all classes, one regression tree per class and round.

Features become bins once. A tree level is one aggregation: each task adds up gradients and hessians per (class, node, feature, bin) of its
rows, the sums meet by (class, node), and there the best split is chosen; only one line per (class, node) reaches the driver. A
level serves all classes at once, and the last level's sums are the leaves' Newton steps, so a round costs ``depth`` jobs whatever
the number of classes. Margins are stored with the rows every ``store_every`` rounds; between that, tasks add the newest trees to
them, so a round does not get dearer with the number of rounds.

Bounds: edges are features x bins numbers, a model rounds x classes x 2**depth; both travel with the tasks. Sums of one level are
classes x nodes x features x bins pairs a task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.session import cut_lineage, ship_package

EPS = 1e-12


@dataclass(frozen=True)
class Boosting:
    rounds: int = 200
    depth: int = 3
    rate: float = 0.05
    bins: int = 32
    min_rows: float = 1.0
    store_every: int = 20


@dataclass
class Tree:
    """A complete tree: inner node i has children 2i+1 and 2i+2; feature -1 sends every row to the left."""

    feature: np.ndarray
    cut: np.ndarray  # rows with bin <= cut go left
    gain: np.ndarray
    leaf: np.ndarray

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Node of each row below ``levels`` levels, counted from that level's first node."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for level in range(levels):
            i = at + (1 << level) - 1
            f = self.feature[i]
            right = (f >= 0) & (bins[rows, np.maximum(f, 0)] > self.cut[i])
            at = 2 * at + right
        return at

    def values(self, bins: np.ndarray) -> np.ndarray:
        return self.leaf[self.nodes(bins, len(self.leaf).bit_length() - 1)]


def softmax_rows(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def residuals(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians of the log loss per class."""
    p = softmax_rows(margins)
    g = p.copy()
    g[np.arange(len(y)), y] -= 1.0
    return g, p * (1.0 - p)


def level_sums(bins: np.ndarray, node: np.ndarray, n_nodes: int, g: np.ndarray, h: np.ndarray, n_bins: int) -> np.ndarray:
    """(nodes, 3, features, bins): sums of gradient, hessian and rows."""
    n, width = bins.shape
    cell = ((node[:, None] * width + np.arange(width)) * n_bins + bins).ravel()
    size = n_nodes * width * n_bins
    parts = [np.bincount(cell, np.repeat(v, width), size) for v in (g, h, np.ones(n))]
    return np.stack(parts).reshape(3, n_nodes, width, n_bins).transpose(1, 0, 2, 3)


def best_split(sums: np.ndarray, min_rows: float) -> tuple[int, int, float, np.ndarray]:
    """(feature, cut, gain, [left g, left h, g, h]) of one node's (3, features, bins); feature -1 if nothing is gained."""
    upto = sums.cumsum(axis=2)
    total = upto[:, 0, -1]
    gl, hl, nl = upto[:, :, :-1]
    gr, hr, nr = (total[i] - upto[i, :, :-1] for i in range(3))
    gain = gl**2 / (hl + EPS) + gr**2 / (hr + EPS) - total[0] ** 2 / (total[1] + EPS)
    gain = np.where((nl >= min_rows) & (nr >= min_rows), gain, -np.inf)
    at = int(np.argmax(gain))
    f, cut = divmod(at, gain.shape[1])
    if not gain[f, cut] > 1e-10:
        return -1, 0, 0.0, np.array([total[0], total[1], total[0], total[1]])
    return f, cut, float(gain[f, cut]), np.array([gl[f, cut], hl[f, cut], total[0], total[1]])


@dataclass
class BoostedTrees:
    """A fitted model; ``edges[f]`` are the upper ends of feature f's bins but the last."""

    n_classes: int
    rate: float
    prior: np.ndarray
    edges: list[np.ndarray]
    rounds: list[list[Tree]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Missing values lie in the first bin."""
        out = np.zeros(x.shape, np.uint8)
        for f, e in enumerate(self.edges):
            out[:, f] = np.where(np.isnan(x[:, f]), 0, np.searchsorted(e, x[:, f], side="left"))
        return out

    def add(self, margins: np.ndarray, bins: np.ndarray, first: int = 0) -> np.ndarray:
        for trees in self.rounds[first:]:
            for k, tree in enumerate(trees):
                margins[:, k] += self.rate * tree.values(bins)
        return margins

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        return softmax_rows(self.add(np.repeat(self.prior[None], len(x), axis=0), bins))

    def importances(self) -> np.ndarray:
        total = np.zeros(len(self.edges))
        for trees in self.rounds:
            for tree in trees:
                used = tree.feature >= 0
                np.add.at(total, tree.feature[used], tree.gain[used])
        return total / total.sum() if total.sum() else total

    def to_json(self) -> str:
        trees = [[[t.feature.tolist(), t.cut.tolist(), t.gain.tolist(), t.leaf.tolist()] for t in r] for r in self.rounds]
        return json.dumps({"n_classes": self.n_classes, "rate": self.rate, "prior": self.prior.tolist(), "edges": [e.tolist() for e in self.edges], "rounds": trees})

    @classmethod
    def from_json(cls, text: str) -> BoostedTrees:
        d = json.loads(text)
        rounds = [[Tree(np.array(f, np.int64), np.array(c, np.int64), np.array(g), np.array(v)) for f, c, g, v in r] for r in d["rounds"]]
        return cls(d["n_classes"], d["rate"], np.array(d["prior"]), [np.array(e) for e in d["edges"]], rounds)

    def save(self, spark, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark, path: str) -> BoostedTrees:
        return cls.from_json(spark.read.text(path).first()[0])

    def transform(self, df: DataFrame, features: str, out: str) -> DataFrame:
        """Add ``out``: an array of probabilities."""
        ship_package(df.sparkSession)
        model = self

        @F.pandas_udf("array<double>")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                yield pd.Series(list(model.probabilities(np.array(x.tolist(), float).reshape(len(x), -1)))) if len(x) else pd.Series([], dtype=object)

        return df.withColumn(out, score(F.col(features)))


def tree_from(splits: dict[tuple[int, int], tuple], depth: int, shrink: float) -> Tree:
    """splits: (level, node) -> (feature, cut, gain, left g, left h, g, h)."""
    inner = (1 << depth) - 1
    feature, cut, gain = np.full(inner, -1), np.zeros(inner, np.int64), np.zeros(inner)
    leaf = np.zeros(1 << depth)
    for (level, node), (f, c, won, gl, hl, g, h) in splits.items():
        i = node + (1 << level) - 1
        feature[i], cut[i], gain[i] = f, c, won
        if level == depth - 1:
            leaf[2 * node] = -shrink * gl / (hl + EPS)
            leaf[2 * node + 1] = -shrink * (g - gl) / (h - hl + EPS) if f >= 0 else leaf[2 * node]
    return Tree(feature, cut, gain, leaf)


def feature_edges(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Inner bin edges of each feature from one mergeable sketch per feature, in one pass."""
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    got = rows.agg(*[F.percentile_approx(F.nanvl(F.get("x", F.lit(f)), F.lit(None)), probs, F.lit(10_000)).alias(f"e{f}") for f in range(width)]).first()
    return [np.unique(np.array(got[f] or [], float)) for f in range(width)]


def fit(rows: DataFrame, n_classes: int, b: Boosting = Boosting()) -> BoostedTrees:
    """rows: y INT (class number), x ARRAY<DOUBLE> of one length; rows without a class are left out."""
    rows = rows.where("y is not null").select(F.col("y").cast("int").alias("y"), "x")
    counts = {r["y"]: (r["n"], r["w"]) for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("w")).collect()}
    if not counts:
        raise ValueError("no labelled training rows")
    width = max(w for _, w in counts.values())
    share = np.array([counts.get(k, (0, 0))[0] for k in range(n_classes)], float)
    model = BoostedTrees(n_classes, b.rate, np.log((share + EPS) / share.sum()), feature_edges(rows, width, b.bins))
    ship_package(rows.sparkSession)

    kept, since = cut_lineage(_with_bins(rows, model)), 0
    shrink = (n_classes - 1) / n_classes
    for r in range(b.rounds):
        found: list[dict[tuple[int, int], tuple]] = [{} for _ in range(n_classes)]
        for level in range(b.depth):
            partial = [tree_from(s, b.depth, shrink) for s in found]
            for k, node, *split in _level(kept, model, since, partial, level, b):
                found[k][level, node] = split
            for k in range(n_classes):  # nodes that no row reached
                for node in range(1 << level):
                    found[k].setdefault((level, node), (-1, 0, 0.0, 0.0, 0.0, 0.0, 0.0))
        model.rounds.append([tree_from(s, b.depth, shrink) for s in found])
        if (r + 1) % b.store_every == 0 and r + 1 < b.rounds:
            kept, since = cut_lineage(_with_margins(kept, model, since)), r + 1
    return model


_ROW_SQL = "y int, bins binary, margins binary"
_ROW = pa.schema([("y", pa.int32()), ("bins", pa.binary()), ("margins", pa.binary())])


def _row_batch(y: np.ndarray, bins: np.ndarray, margins: np.ndarray) -> pa.RecordBatch:
    cells = [pa.array(y, pa.int32()), pa.array([x.tobytes() for x in bins], pa.binary()), pa.array([x.tobytes() for x in margins], pa.binary())]
    return pa.RecordBatch.from_arrays(cells, schema=_ROW)


def _arrays(rows: pa.RecordBatch, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(rows.column(1).to_pylist()), np.uint8).reshape(-1, width)
    margins = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.float64).reshape(-1, k).copy()
    return rows.column(0).to_numpy().astype(np.int64), bins, margins


def _with_bins(rows: DataFrame, model: BoostedTrees) -> DataFrame:
    width = len(model.edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([[np.nan if v is None else v for v in row] for row in batch.column(1).to_pylist()], float).reshape(-1, width)
                yield _row_batch(batch.column(0).to_numpy(), model.binned(x), np.repeat(model.prior[None], len(x), axis=0))

    return rows.mapInArrow(run, _ROW_SQL)


def _with_margins(kept: DataFrame, model: BoostedTrees, since: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y, bins, margins = _arrays(batch, len(model.edges), model.n_classes)
                yield _row_batch(y, bins, model.add(margins, bins, since))

    return kept.mapInArrow(run, _ROW_SQL)


def _level(kept: DataFrame, model: BoostedTrees, since: int, partial: list[Tree], level: int, b: Boosting) -> list[tuple]:
    """(class, node, feature, cut, gain, left g, left h, g, h) of every node of a level that rows reach."""
    width, k, n_nodes = len(model.edges), model.n_classes, 1 << level
    shape = (3, width, b.bins)
    sums_type = pa.list_(pa.float64())

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            y, bins, margins = _arrays(batch, width, k)
            g, h = residuals(model.add(margins, bins, since), y)
            parts = np.stack([level_sums(bins, partial[c].nodes(bins, level), n_nodes, g[:, c], h[:, c], b.bins) for c in range(k)])
            total = parts if total is None else total + parts
        if total is not None:
            cells = total.reshape(k * n_nodes, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(k * n_nodes), pa.int32()), pa.array(list(cells), sums_type)], names=["cell", "sums"]
            )

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for cell, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = sums.values.to_numpy()
                totals[cell] = totals[cell] + v if cell in totals else v.copy()
        if totals:
            found = [(cell, *best_split(v.reshape(shape), b.min_rows)) for cell, v in sorted(totals.items()) if v.reshape(shape)[2].any()]
            if found:
                cells, f, cut, gain, ends = zip(*found)
                columns = [pa.array(cells, pa.int32()), pa.array(f, pa.int32()), pa.array(cut, pa.int32()), pa.array(gain), pa.array([e.tolist() for e in ends], sums_type)]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "feature", "cut", "gain", "ends"])

    met = kept.mapInArrow(add_up, "cell int, sums array<double>").repartition("cell")
    got = met.mapInArrow(choose, "cell int, feature int, cut int, gain double, ends array<double>").collect()
    return [(r["cell"] // n_nodes, r["cell"] % n_nodes, r["feature"], r["cut"], r["gain"], *r["ends"]) for r in got]
