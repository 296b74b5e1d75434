"""Softmax boosting against a plain numpy version on the same bins."""

import numpy as np
import pytest

from runlens.operators import boosting, zoo

CLASSES = ("a", "b", "c")


def plain_fit(bins, y, k, b, prior):
    """Margins after all rounds, each tree grown row by row."""
    margins = np.repeat(prior[None], len(y), axis=0)
    shrink = (k - 1) / k
    for _ in range(b.rounds):
        g, h = boosting.residuals(margins, y)
        step = np.zeros_like(margins)
        for c in range(k):
            groups = [np.arange(len(y))]
            for _level in range(b.depth):
                nxt = []
                for rows in groups:
                    best = (0.0, None)
                    for f in range(bins.shape[1]):
                        for cut in range(b.bins - 1):
                            left = rows[bins[rows, f] <= cut]
                            right = rows[bins[rows, f] > cut]
                            if len(left) and len(right):
                                gain = sum(g[r, c].sum() ** 2 / (h[r, c].sum() + 1e-12) for r in (left, right)) - g[rows, c].sum() ** 2 / (h[rows, c].sum() + 1e-12)
                                if gain > best[0] + 1e-9:
                                    best = (gain, (f, cut))
                    if len(rows) and best[1] and best[0] > 1e-10:
                        f, cut = best[1]
                        nxt += [rows[bins[rows, f] <= cut], rows[bins[rows, f] > cut]]
                    else:
                        nxt += [rows, rows[:0]]
                groups = nxt
            for rows in groups:
                if len(rows):
                    step[rows, c] = -shrink * g[rows, c].sum() / (h[rows, c].sum() + 1e-12)
        margins = margins + b.rate * step
    return margins


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(int) + (x[:, 2] > 0.8)
    x[rng.random(300) < 0.05, 3] = np.nan
    return x, y


def test_margins_equal_plain_boosting(spark, rows):
    x, y = rows
    df = spark.createDataFrame([(int(c), [float(v) for v in r]) for c, r in zip(y, x)], "y int, x array<double>").repartition(3)
    b = boosting.Boosting(rounds=5, depth=3, rate=0.3, bins=8, store_every=2)
    model = boosting.fit(df, 3, b)
    bins = model.binned(x)
    margins = plain_fit(bins, y, 3, b, model.prior)
    assert np.allclose(model.add(np.repeat(model.prior[None], len(y), axis=0), bins), margins)
    again = boosting.BoostedTrees.from_json(model.to_json())
    assert np.allclose(again.probabilities(x), boosting.softmax_rows(margins))
    assert again.importances()[[0, 1, 2]].sum() > again.importances()[3]


def test_scorer_with_boosted_trees(spark, rows, tmp_path):
    x, y = rows
    data = [(f"r{i}", CLASSES[c], [float(v) for v in r]) for i, (c, r) in enumerate(zip(y, x))] + [("odd", None, [0.0] * 4)]
    df = spark.createDataFrame(data, "run_id string, y string, x array<double>")
    model = zoo.fit(df, CLASSES, kind="boosted", rounds=12, rate=0.3)
    got = {r["run_id"]: r for r in model.probabilities(df).collect()}
    assert all(abs(sum(r["p"]) - 1) < 1e-9 for r in got.values()) and len(got) == 301
    right = np.mean([CLASSES[int(np.argmax(got[f"r{i}"]["p"]))] == CLASSES[c] for i, c in enumerate(y)])
    assert right > 0.9
    zoo.save(model, str(tmp_path / "m"))
    back, _ = zoo.load(spark, str(tmp_path / "m"))
    assert {r["run_id"]: r["p"] for r in back.probabilities(df).collect()} == {k: r["p"] for k, r in got.items()}
    assert back.importances().keys() == model.importances().keys()


def test_one_class_and_no_rows(spark):
    one = spark.createDataFrame([(1, [1.0]), (1, [2.0])], "y int, x array<double>")
    model = boosting.fit(one, 3, boosting.Boosting(rounds=1))
    assert model.probabilities(np.array([[5.0]])).argmax() == 1
    with pytest.raises(ValueError):
        boosting.fit(one.limit(0), 3)
