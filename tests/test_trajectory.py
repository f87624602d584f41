import numpy as np
import pandas as pd
import pytest

from models import stays as model
from pingscape.operators import trajectory

COLUMNS = "caid string, latitude double, longitude double, utc_timestamp long, altitude double"


def walk(rng, n):
    """A path that rests, jumps and comes back."""
    places = 49 + rng.normal(0, 0.002, (4, 2))
    at = places[np.repeat(rng.integers(0, 4, n // 6 + 1), 6)[:n]]
    at = at + rng.normal(0, 0.00012, (n, 2))
    return at[:, 0], at[:, 1] - 19, np.cumsum(rng.integers(1, 40, n))


@pytest.mark.parametrize("window,block", [(18, 8192), (18, 11), (4, 5)])
def test_stays_match_the_sequential_model(spark, window, block):
    rng = np.random.default_rng(window + block)
    rows, want = [], []
    for d in range(25):
        n = int(rng.integers(1, 120))
        lat, lon, t = walk(rng, n)
        rows += [(f"d{d}", float(a), float(b), int(c), None) for a, b, c in zip(lat, lon, t)]
        for m in model(lat, lon, t, window, 25, 60):
            want.append((f"d{d}", int(t[m[0]]), int(t[m[-1]] - t[m[0]]), round(float(lat[m].mean()), 9)))
    pings = spark.createDataFrame(rows, COLUMNS).repartition(7)
    out = trajectory.stays(pings, window=window, block_size=block).collect()
    got = [(r.caid, r.utc_timestamp_start, r.stay_length_sec, round(r.latitude, 9)) for r in out]
    assert len(want) > 20
    assert sorted(got) == sorted(want)


def test_window_or_fewer_pings_give_no_stay(spark):
    def pings(n):
        return spark.createDataFrame([("d", 49.0, 30.0, 60 * i, None) for i in range(n)], COLUMNS)

    assert trajectory.stays(pings(18)).count() == 0
    assert trajectory.stays(pings(19)).count() == 1


def test_one_device_may_span_many_blocks(spark):
    pings = spark.createDataFrame([("d", 49.0, 30.0, 60 * i, None) for i in range(500)], COLUMNS)
    row = trajectory.stays(pings, block_size=16).collect()
    assert [(r.utc_timestamp_start, r.stay_length_sec) for r in row] == [(0, 499 * 60)]
    pos = trajectory.numbered_pings(pings).toPandas()["pos"]
    pd.testing.assert_series_equal(pos.sort_values(ignore_index=True), pd.Series(range(500), name="pos"))
