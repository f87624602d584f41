import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pingscape.operators import regression

CELLS = [0, 60, 120, 180]


def least_norm(y, columns):
    """Minimum-norm OLS with a constant that is skipped if a column already is one."""
    x = np.column_stack(columns) if columns else np.zeros((len(y), 0))
    constant = any(np.ptp(c) == 0 and c[0] != 0 for c in x.T)
    if not constant:
        x = np.column_stack([np.ones(len(y)), x])
    b = np.linalg.pinv(x) @ y
    return b if constant else b[1:]


def sample(seed, cells, n=60, distinct=None):
    rng = np.random.default_rng(seed)
    d = rng.uniform(10, 300, n) if distinct is None else rng.choice(distinct, n)
    return pd.DataFrame({"time_to_raid_post": rng.choice(cells, n), "y": rng.normal(3, 2, n), "d": d})


EVENTS = {
    "full": sample(1, [-1, *CELLS]), "no_base": sample(2, CELLS), "one_cell": sample(3, [60]),
    "base_only": sample(4, [-1]), "missing_cell": sample(5, [-1, 0, 180]),
    "flat_cell": pd.concat([sample(6, [-1, 0, 60]), pd.DataFrame({"time_to_raid_post": [120], "y": [9.0], "d": [50.0]})]),
    "two_distances": sample(7, [-1, 0], distinct=[10.0, 20.0]), "no_base_x": sample(8, [0, 60]),
}


def frame(spark):
    pdf = pd.concat([p.assign(id=k) for k, p in EVENTS.items()])
    return spark.createDataFrame(pdf)


def test_closed_form_equals_pinv(spark):
    out = regression.dummy_effects(frame(spark), ["id"], "y").collect()
    got = {(r.id, r.time_to_raid_post): r.b for r in out}
    for key, p in EVENTS.items():
        dummies = [(p.time_to_raid_post == c).astype(float).values for c in CELLS]
        for c, b in zip(CELLS, least_norm(p.y.values, dummies)):
            assert abs(got.get((key, c), 0.0) - b) < 1e-9, (key, c)


def test_interacted_equals_pinv(spark):
    out = regression.interacted_effects(frame(spark), ["id"], "y", "d").collect()
    got = {(r.id, r.term, r.cell): r.b for r in out}
    for key, p in EVENTS.items():
        dummies = [(p.time_to_raid_post == c).astype(float).values for c in CELLS]
        b = least_norm(p.y.values, [*dummies, *[m * p.d.values for m in dummies], p.d.values])
        names = [("cell", c) for c in CELLS] + [("cell_x", c) for c in CELLS] + [("x", None)]
        for name, value in zip(names, b):
            assert abs(got.get((key, *name), 0.0) - value) < 1e-5 * max(1, abs(value)), (key, name)


def test_grouped_ols_equals_lstsq(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 300), "u": rng.normal(0, 1, 300), "v": rng.normal(5, 100, 300)})
    pdf["y"] = 2 * pdf.u - 0.1 * pdf.v + rng.normal(0, 1, 300)
    pdf.loc[5, "y"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    got = {(r.g, r.term): r.b for r in regression.grouped_ols(df, ["g"], "y", ["u", "v"]).collect()}
    for g, p in pdf.dropna().groupby("g"):
        for name, value in zip(("u", "v"), least_norm(p.y.values, [p.u.values, p.v.values])):
            assert abs(got[(g, name)] - value) < 1e-8


def test_wide_estimates_fill_unobserved_cells(spark):
    df = frame(spark).withColumnsRenamed({"id": "region_english"}).withColumn("start_raid_next", F.lit("t"))
    fit = regression.dummy_effects(df, ["start_raid_next", "region_english"], "y")
    with pytest.raises(Exception, match="not in the list"):
        regression.wide_estimates(fit, CELLS[:1]).collect()
    wide = regression.wide_estimates(fit, CELLS).filter("region_english = 'missing_cell'").first()
    assert wide["e_TYPE_60"] == 0.0 and wide["e_TYPE_120"] == 0.0 and wide["e_TYPE_0"] != 0.0


@pytest.mark.parametrize("centre, spread", [(270.0, 5.0), (270.0, 0.5), (1000.0, 0.05)])
def test_solvers_keep_digits_far_from_zero(spark, centre, spread):
    """Against the minimum-norm solution of the design itself; one cell has a single distance, so the solver is used."""
    rng = np.random.default_rng(4)
    cell = rng.choice([0, 60, 120, 180], 400)
    d = centre + spread * rng.standard_normal(400)
    d[cell == 180] = centre + spread
    y = 3 + 0.01 * cell + (1.8 + 0.002 * cell) * (d - centre) + 0.1 * rng.standard_normal(400)
    df = spark.createDataFrame(pd.DataFrame({"e": "a", regression.CELL_COL: cell, "d": d, "y": y}))
    got = {(r.term, r.cell): r.b for r in regression.interacted_effects(df, ["e"], "y", "d", base=0).collect()}
    names = [("cell", c) for c in (60, 120, 180)] + [("cell_x", c) for c in (60, 120, 180)] + [("x", None)]
    dummies = [(cell == c).astype(float) for c in (60, 120, 180)]
    design = np.column_stack([np.ones(400), *dummies, *[z * d for z in dummies], d])
    want = np.linalg.lstsq(design, y, rcond=1e-12)[0][1:]
    for name, value in zip(names, want):
        assert abs(got[name] - value) <= 1e-8 * max(1.0, abs(value)) * (centre / spread), name
    plain = {r.term: r.b for r in regression.grouped_ols(df.withColumn("u", F.col("d") * 0 + 7), ["e"], "y", ["d", "u"]).collect()}
    slope = np.polyfit(d - d.mean(), y, 1)[0]
    assert plain["d"] == pytest.approx(slope, rel=1e-8) and plain["u"] == pytest.approx((y.mean() - slope * d.mean()) / 7, rel=1e-8)
