"""Per-run curve features and integrity proxies in one pass over the epoch table.

Contract of ``history``: run_id, pos (0..n-1 in time order, no gaps) and one DOUBLE column per curve.
Null = the run has no such curve at that epoch; NaN = logged as missing; +-inf is kept. A curve is
present when any of its values is not null. Aggregates use finite values only.

A run may be arbitrarily long, so nothing is windowed over ``run_id``. Epochs are cut into
blocks of ``block`` positions; windows run inside (run_id, block); the last epoch of a block is also
handed to the next block, so differences across the border are exact. Totals and finite-value
ranks come from a block-level summary, and the final aggregation combines map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runlens.functions.numeric import clip, finite, missing, not_nan, ratio

CURVES = ("train_loss", "val_loss", "train_acc", "val_acc")
BLOCK = 4096

CURVE_STATS = (
    "final", "min", "max", "mean", "std", "slope", "slope_first_half", "slope_second_half", "max_jump", "n_nan",
)
GAP_FEATURES = ("acc_final_gap", "acc_max_gap", "acc_mean_gap", "loss_final_gap", "loss_max_gap", "loss_mean_gap")
BASE_FEATURES = (
    "n_epochs",
    "diverged",
    *[f"{c}_{s}" for c in CURVES for s in CURVE_STATS],
    *GAP_FEATURES,
    "val_loss_argmin_frac",
)
PROXY_FEATURES = (
    "di_proxy_saturation",
    "di_proxy_zero_gap_ceiling",
    "di_proxy_train_val_lockstep",
    "di_proxy_val_loss_uniqueness",
    "di_proxy_early_val_flatness",
    "di_proxy_val_above_train_acc_frac",
    "di_proxy_val_acc_minus_train_acc_mean",
    "di_proxy_val_below_train_loss_frac",
    "di_proxy_loss_ratio_mean",
    "di_proxy_acc_lockstep_corr",
    "di_proxy_epoch_to_90pct_val_acc_frac",
    "di_proxy_best_minus_final_val_acc",
)
# Proxies that are also part of the base feature table.
KEPT_PROXIES = PROXY_FEATURES[5:]


def x_(curve: str) -> Column:
    return F.col(f"x_{curve}")


def prepare(history: DataFrame, block: int = BLOCK) -> DataFrame:
    """Epoch rows with finite values, the previous finite value, finite ranks and run totals."""
    raw = history.select(
        "run_id",
        F.col("pos").cast("long").alias("pos"),
        *CURVES,
        F.floor(F.col("pos") / F.lit(block)).cast("long").alias("block"),
    )
    h = raw.select("*", *[finite(F.col(c)).alias(f"x_{c}") for c in CURVES])
    sums = h.groupBy("run_id", "block").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count(x_("val_loss")).alias("_vl"),
        F.count(x_("val_acc")).alias("_va"),
        F.max(x_("val_acc")).alias("_va_max"),
        F.min(x_("val_loss")).alias("_vl_min"),
    )
    run = W.partitionBy("run_id")
    before = run.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = sums.select(
        "run_id",
        "block",
        F.sum("_rows").over(run).alias("run_rows"),
        F.sum("_vl").over(run).alias("vl_finite"),
        F.sum("_va").over(run).alias("va_finite"),
        F.max("_va_max").over(run).alias("va_max"),
        F.min("_vl_min").over(run).alias("vl_min"),
        F.coalesce(F.sum("_vl").over(before), F.lit(0)).alias("_vl_before"),
        F.coalesce(F.sum("_va").over(before), F.lit(0)).alias("_va_before"),
    )
    border = F.col("pos") % block == block - 1
    copies = F.when(border, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    carried = h.withColumn("carry", F.explode(copies)).withColumn("block", F.col("block") + F.col("carry"))
    j = carried.join(blocks, ["run_id", "block"])
    inside = W.partitionBy("run_id", "block").orderBy("pos")
    own = F.col("carry") == 0
    rank = inside.rowsBetween(W.unboundedPreceding, 0)
    j = j.select(
        "*",
        *[F.lag(x_(c)).over(inside).alias(f"prev_{c}") for c in CURVES],
        *[
            (F.count(F.when(own, x_(c))).over(rank) - 1 + F.col(f"_{s}_before")).alias(f"rank_{c}")
            for c, s in (("val_loss", "vl"), ("val_acc", "va"))
        ],
    )
    return j.where(own)


def _last(v: Column) -> Column:
    """Value at the run's last epoch (a plain max keeps the aggregation hash-based)."""
    return F.max(F.when(F.col("pos") == F.col("run_rows") - 1, v))


def _present(curve: str) -> Column:
    return F.coalesce(F.max(F.col(curve).isNotNull()), F.lit(False))


def _curve_block(curve: str) -> dict[str, Column]:
    v, x, pos = F.col(curve), x_(curve), F.col("pos").cast("double")
    half = F.greatest(F.lit(1), F.floor(F.col("run_rows") / 2))
    has = _present(curve)
    first, second = F.when(pos < half, x), F.when(pos >= half, x)
    jump = F.when(F.max("run_rows") == 1, F.lit(0.0)).otherwise(F.max(F.abs(x - F.col(f"prev_{curve}"))))

    def slope(y: Column) -> Column:
        return F.when(has, F.coalesce(F.regr_slope(y, pos), F.lit(0.0)))

    return {
        f"{curve}_final": _last(not_nan(v)),
        f"{curve}_min": F.min(x),
        f"{curve}_max": F.max(x),
        f"{curve}_mean": F.avg(x),
        f"{curve}_std": F.stddev_pop(x),
        f"{curve}_slope": slope(x),
        f"{curve}_slope_first_half": slope(first),
        f"{curve}_slope_second_half": slope(second),
        f"{curve}_max_jump": F.when(has, jump),
        f"{curve}_n_nan": F.when(has, F.count(F.lit(1)) - F.count(x)).otherwise(F.lit(0)).cast("double"),
    }


def _gap_block(prefix: str, a: str, b: str) -> dict[str, Column]:
    raw = F.col(a) - F.col(b)
    d = x_(a) - x_(b)
    return {
        f"{prefix}_final_gap": _last(not_nan(raw)),
        f"{prefix}_max_gap": F.max(d),
        f"{prefix}_mean_gap": F.avg(d),
    }


def base_aggregates() -> dict[str, Column]:
    lost = [_present(c) & F.max(missing(F.col(c))) for c in ("train_loss", "val_loss")]
    vl = x_("val_loss")
    argmin = F.min(F.when(vl == F.col("vl_min"), F.col("pos")))
    out: dict[str, Column] = {
        "n_epochs": F.count(F.lit(1)).cast("double"),
        "diverged": (lost[0] | lost[1]).cast("double"),
    }
    for curve in CURVES:
        out.update(_curve_block(curve))
    out.update(_gap_block("acc", "train_acc", "val_acc"))
    out.update(_gap_block("loss", "val_loss", "train_loss"))
    out["val_loss_argmin_frac"] = argmin / F.greatest(F.lit(1), F.max("run_rows") - 1).cast("double")
    return out


def proxy_aggregates() -> dict[str, Column]:
    """Integrity proxies except uniqueness, which needs its own distinct count."""
    ta, va, tl, vl = x_("train_acc"), x_("val_acc"), x_("train_loss"), x_("val_loss")
    acc_pair, loss_pair = ta.isNotNull() & va.isNotNull(), tl.isNotNull() & vl.isNotNull()
    n_acc, n_loss = F.count_if(acc_pair), F.count_if(loss_pair)
    pta, pva = F.when(acc_pair, ta), F.when(acc_pair, va)

    def share(pair: Column, cond: Column) -> Column:
        return F.avg(F.when(pair, cond.cast("double")))

    va_max = F.max(va)
    ta_final, gap_final = _last(ta), _last(ta - va)
    room = F.greatest(F.lit(1e-6), F.lit(1.0) - va_max)
    lockstep = (F.lit(1.0) - F.abs(ta_final - va_max)) / room
    head = F.greatest(F.lit(2), F.floor(F.col("vl_finite") / 5))
    ratio_ = clip(vl / F.greatest(tl, F.lit(1e-9)), 0.0, 50.0)
    sx, sy = F.stddev_pop(pta), F.stddev_pop(pva)
    reached = F.min(F.when(va >= F.col("va_max") * F.lit(0.9), F.col("rank_val_acc")))
    n_va, last_va = F.count(va), F.max(F.when(F.col("rank_val_acc") == F.col("va_finite") - 1, va))
    return {
        "di_proxy_saturation": va_max,
        "di_proxy_zero_gap_ceiling": F.when(
            va_max.isNotNull() & gap_final.isNotNull(), F.greatest(F.lit(0.0), va_max - F.abs(gap_final))
        ),
        "di_proxy_train_val_lockstep": F.when(ta_final.isNotNull() & va_max.isNotNull(), clip(lockstep, 0.0, 50.0)),
        "di_proxy_early_val_flatness": F.when(
            F.count(vl) > 4, clip(F.stddev_pop(F.when(F.col("rank_val_loss") < head, vl)), 0.0, 50.0)
        ),
        "di_proxy_val_above_train_acc_frac": F.when(n_acc >= 3, share(acc_pair, va > ta)),
        "di_proxy_val_acc_minus_train_acc_mean": F.when(n_acc >= 3, F.avg(va - ta)),
        "di_proxy_val_below_train_loss_frac": F.when(n_loss >= 3, share(loss_pair, vl < tl)),
        "di_proxy_loss_ratio_mean": F.when(n_loss >= 3, F.avg(F.when(loss_pair, ratio_))),
        "di_proxy_acc_lockstep_corr": F.when(
            (n_acc >= 3) & (sx > 1e-9) & (sy > 1e-9), ratio(F.covar_pop(pta, pva), sx * sy)
        ),
        "di_proxy_epoch_to_90pct_val_acc_frac": F.when(
            n_va > 1, F.coalesce(reached.cast("double") / F.greatest(n_va - 1, F.lit(1)).cast("double"), F.lit(1.0))
        ),
        "di_proxy_best_minus_final_val_acc": F.when(n_va >= 2, va_max - last_va),
    }


def loss_uniqueness(history: DataFrame) -> DataFrame:
    """Distinct finite validation losses (rounded half-even to 6 digits) over their count.

    The distinct step shuffles by (run_id, value), so a long run is spread over tasks.
    """
    h = history.select("run_id", "val_loss", finite(F.col("val_loss")).alias("x"))
    per_value = h.groupBy("run_id", F.bround("x", 6).alias("v")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("x").alias("n"), F.max(F.col("val_loss").isNotNull()).alias("seen")
    )
    out = per_value.groupBy("run_id").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.count("v").alias("d"), F.max("seen").alias("seen")
    )
    value = F.when(F.col("seen") & (F.col("rows") > 4), F.col("d") / F.greatest(F.lit(1), F.col("n")).cast("double"))
    return out.select("run_id", value.alias("di_proxy_val_loss_uniqueness"))


def _aggregate(prepared: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    return prepared.groupBy("run_id").agg(*[e.alias(name) for name, e in exprs.items()])


def curve_features(history: DataFrame, block: int = BLOCK) -> DataFrame:
    """run_id + the 49 base curve features."""
    return _aggregate(prepare(history, block), base_aggregates())


def integrity_proxies(history: DataFrame, block: int = BLOCK) -> DataFrame:
    """run_id + the 12 integrity proxies."""
    out = _aggregate(prepare(history, block), proxy_aggregates())
    return out.join(loss_uniqueness(history), "run_id").select("run_id", *PROXY_FEATURES)


def feature_table(history: DataFrame, block: int = BLOCK) -> DataFrame:
    """Base features plus the seven kept proxies from one pass."""
    proxies = proxy_aggregates()
    exprs = {**base_aggregates(), **{k: proxies[k] for k in KEPT_PROXIES}}
    return _aggregate(prepare(history, block), exprs)


def full_features(history: DataFrame, block: int = BLOCK) -> DataFrame:
    """Base features and all twelve proxies."""
    out = _aggregate(prepare(history, block), {**base_aggregates(), **proxy_aggregates()})
    return out.join(loss_uniqueness(history), "run_id").select("run_id", *BASE_FEATURES, *PROXY_FEATURES)
