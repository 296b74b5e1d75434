"""Live runs from their epochs to a diagnosis: one bounded curve state per run, closed by a finish mark or by silence.

Rows wait in the state until the watermark has passed them, so epochs that arrive out of order are folded in order; the wait is bounded
by the watermark's delay. Folding keeps moments, extremes and the last epoch, whose size does not depend on the length
of the run. An event-time timer wakes a run when its next waiting row may be folded or its silence is over; the
state goes with the run, so what is kept is bounded by the runs that are alive.

Rules: rows without an epoch, and epochs not above the last one folded (late or repeated ones), are dropped; of waiting rows of
one epoch the earliest counts. A finished run keeps only its last epoch, until its silence is over. A run that speaks again after
that starts anew.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from runlens.operators.curves import BASE_FEATURES, CURVES
from runlens.session import ship_package

#: Everything in the base table that can be kept while a run grows. The two half slopes need its final length.
LIVE_FEATURES = tuple(f for f in BASE_FEATURES if "_half" not in f)
CLOSED_SQL = "run_id string, opened_us long, closed_us long, reason string, features array<double>"
_STATE = "curve array<double>, last_epoch long, last_us long, marks array<bigint>, cells array<double>"
_NAN = float("nan")
_PER_CURVE = 13
_GAPS = (("acc", 2, 3), ("loss", 1, 0))


def _none(x: float) -> float | None:
    return None if math.isnan(x) else x


class CurveSummary:
    """Moments and marks of the epochs folded so far; ``cells`` is the whole of it, as numbers.

    Per curve: present, lost, n, mean, m2, mean of positions, m2 of positions, cross moment, min, max, largest jump, the epoch's
    value, the epoch's finite value. Then: rows, opening time, first position of the least validation loss, and per gap: n, mean, max, last.
    """

    def __init__(self, cells: list[float] | None = None):
        self.cells = list(cells) if cells else self._blank()

    @staticmethod
    def _blank() -> list[float]:
        curve = [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, _NAN, _NAN, _NAN, _NAN, _NAN]
        return curve * len(CURVES) + [0.0, _NAN, _NAN] + [0.0, 0.0, _NAN, _NAN] * len(_GAPS)

    @property
    def rows(self) -> int:
        return int(self.cells[_PER_CURVE * len(CURVES)])

    @property
    def opened(self) -> float:
        return self.cells[_PER_CURVE * len(CURVES) + 1]

    def fold(self, us: int, values: list[float | None]) -> None:
        """Add the next epoch; a value is None where the run has no such curve, NaN where it was logged as missing."""
        c, tail = self.cells, _PER_CURVE * len(CURVES)
        t = c[tail]
        if not t:
            c[tail + 1] = float(us)
        for k, v in enumerate(values):
            at = k * _PER_CURVE
            x = v if v is not None and math.isfinite(v) else _NAN
            c[at] = max(c[at], float(v is not None))
            c[at + 1] = max(c[at + 1], float(v is None or math.isnan(v)))
            jump = abs(x - c[at + 12])
            if not math.isnan(jump) and not jump <= c[at + 10]:
                c[at + 10] = jump
            c[at + 11], c[at + 12] = _NAN if v is None else v, x
            if math.isnan(x):
                continue
            n = c[at + 2] = c[at + 2] + 1
            dx, dt = x - c[at + 3], t - c[at + 5]
            c[at + 3] += dx / n
            c[at + 5] += dt / n
            c[at + 4] += dx * (x - c[at + 3])
            c[at + 6] += dt * (t - c[at + 5])
            c[at + 7] += dx * (t - c[at + 5])
            if not x >= c[at + 8]:
                c[at + 8] = x
                if CURVES[k] == "val_loss":
                    c[tail + 2] = t
            if not x <= c[at + 9]:
                c[at + 9] = x
        for g, (_, a, b) in enumerate(_GAPS):
            at = tail + 3 + 4 * g
            va, vb = values[a], values[b]
            c[at + 3] = _NAN if va is None or vb is None else va - vb
            d = c[a * _PER_CURVE + 12] - c[b * _PER_CURVE + 12]
            if not math.isnan(d):
                c[at] += 1
                c[at + 1] += (d - c[at + 1]) / c[at]
                if not d <= c[at + 2]:
                    c[at + 2] = d
        c[tail] = t + 1

    def features(self) -> dict[str, float | None]:
        c, tail, n_rows = self.cells, _PER_CURVE * len(CURVES), self.rows
        diverged = any(c[k * _PER_CURVE] and c[k * _PER_CURVE + 1] for k in (0, 1))
        out: dict[str, float | None] = {"n_epochs": float(n_rows), "diverged": float(diverged)}
        for k, name in enumerate(CURVES):
            has, _, n, mean, m2, _, t2, cross, low, high, jump, last, _ = c[k * _PER_CURVE : (k + 1) * _PER_CURVE]
            out[f"{name}_final"] = _none(last)
            out[f"{name}_min"], out[f"{name}_max"] = _none(low), _none(high)
            out[f"{name}_mean"] = mean if n else None
            out[f"{name}_std"] = math.sqrt(max(m2, 0.0) / n) if n else None
            out[f"{name}_slope"] = (cross / t2 if t2 > 0 else 0.0) if has else None
            out[f"{name}_max_jump"] = (0.0 if n_rows == 1 else _none(jump)) if has else None
            out[f"{name}_n_nan"] = n_rows - n if has else 0.0
        for g, (name, _, _) in enumerate(_GAPS):
            n, mean, high, last = c[tail + 3 + 4 * g : tail + 7 + 4 * g]
            out[f"{name}_final_gap"], out[f"{name}_max_gap"] = _none(last), _none(high)
            out[f"{name}_mean_gap"] = mean if n else None
        at = c[tail + 2]
        out["val_loss_argmin_frac"] = None if math.isnan(at) else at / max(1, n_rows - 1)
        return out


class RunCurves:
    """State machine of one run; gives a row of features whenever a session of the run closes.

    Spark hands over rows, states and timers of many runs at a time, so a run costs no calls of its own to the state store.
    """

    def __init__(self, silence_us: int):
        self.silence_us = silence_us

    def step(self, key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        curve, last_epoch, last_us, waiting = self._load(state)
        if not state.hasTimedOut:
            for pdf in rows:
                for (us, epoch, flags), v in zip(pdf["marks"], pdf["v"]):
                    flags = int(flags)
                    values = [float(x) if flags >> (k + 1) & 1 else None for k, x in enumerate(v)]
                    waiting.append((int(us), int(epoch), values, bool(flags & 1)))
        closed = self._advance(key[0], curve, last_epoch, last_us, waiting, state)
        if closed:
            yield self._frame(closed)

    # -- state --

    @staticmethod
    def _load(state: GroupState):
        if not state.exists:
            return CurveSummary(), None, None, []
        curve, last_epoch, last_us, marks, cells = state.get
        width, rows = len(CURVES), []
        for i in range(len(marks) // 3):
            us, epoch, flags = marks[3 * i : 3 * i + 3]
            v = cells[width * i : width * (i + 1)]
            rows.append((us, epoch, [x if flags >> (k + 1) & 1 else None for k, x in enumerate(v)], bool(flags & 1)))
        return CurveSummary(curve), last_epoch, last_us, rows

    @staticmethod
    def _save(state: GroupState, curve: CurveSummary, last_epoch, last_us, waiting) -> None:
        marks, cells = [], []
        for us, epoch, values, finish in waiting:
            marks += (us, epoch, int(finish) | sum(2 << k for k, v in enumerate(values) if v is not None))
            cells += (_NAN if v is None else v for v in values)
        state.update((curve.cells, last_epoch, last_us, marks, cells))

    def _advance(self, run: str, curve: CurveSummary, last_epoch, last_us, waiting: list, state: GroupState) -> list[tuple]:
        """Fold what the watermark has passed, close what is over, and set the next timer."""
        watermark_ms = state.getCurrentWatermarkMs()
        now = watermark_ms * 1000
        closed = []

        def close(at: int, reason: str) -> CurveSummary:
            if curve.rows:
                closed.append((run, int(curve.opened), at, reason, curve.features()))
            return CurveSummary()

        ready = sorted((w for w in waiting if w[0] <= now), key=lambda w: (w[0], w[1], str(w[2])))
        waiting = [w for w in waiting if w[0] > now]
        for us, epoch, values, finish in ready:
            if last_us is not None and us - last_us >= self.silence_us:
                curve, last_epoch = close(last_us, "silent"), None
            if last_epoch is not None and epoch <= last_epoch:
                continue
            curve.fold(us, values)
            last_epoch, last_us = epoch, us
            if finish:
                curve = close(us, "finished")
        if last_us is not None and last_us + self.silence_us <= now:
            curve, last_epoch, last_us = close(last_us, "silent"), None, None
        if last_us is None and not waiting:
            if state.exists:
                state.remove()
            return closed
        self._save(state, curve, last_epoch, last_us, waiting)
        due = [w[0] for w in waiting] + ([last_us + self.silence_us] if last_us is not None else [])
        # A timer goes off when the watermark is above it.
        state.setTimeoutTimestamp(max(-(-min(due) // 1000) - 1, watermark_ms + 1))
        return closed

    @staticmethod
    def _frame(closed: list[tuple]) -> pd.DataFrame:
        rows = [(*row[:4], [_NAN if row[4][f] is None else float(row[4][f]) for f in LIVE_FEATURES]) for row in closed]
        return pd.DataFrame(rows, columns=["run_id", "opened_us", "closed_us", "reason", "features"])


def closed_runs(epochs: DataFrame, silence_seconds: int = 86_400, delay: str = "1 hour") -> DataFrame:
    """A row of ``LIVE_FEATURES`` for each closed session of a run.

    epochs (a stream): run_id, epoch, ts TIMESTAMP, finish BOOLEAN and the four curves.
    """
    ship_package(epochs.sparkSession)
    flags = F.coalesce("finish", F.lit(False)).cast("long")
    for k, c in enumerate(CURVES):
        flags = flags + F.col(c).isNotNull().cast("long") * F.lit(2 << k)
    # Few columns: each costs every run a conversion.
    rows = epochs.where("run_id is not null and epoch is not null and ts is not null").select(
        "run_id", "ts", F.array(F.unix_micros("ts"), F.col("epoch").cast("long"), flags).alias("marks"),
        F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(_NAN)) for c in CURVES]).alias("v"),
    )
    machine = RunCurves(silence_seconds * 1_000_000)

    def step(key, frames, state):
        yield from machine.step(key, frames, state)

    closed = rows.withWatermark("ts", delay).groupBy("run_id").applyInPandasWithState(step, CLOSED_SQL, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    # A feature is never NaN.
    each = [F.nanvl(F.get("features", F.lit(i)), F.lit(None)).alias(f) for i, f in enumerate(LIVE_FEATURES)]
    return closed.select("run_id", "opened_us", "closed_us", "reason", *each)
