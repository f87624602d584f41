import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pingscape.operators import ordered


def frame(spark, seed=1, rows=800):
    """One key holds most rows; times have gaps longer than a chunk and ties."""
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(
        {
            "k": rng.choice(["hot", "a", "b"], rows, p=[0.8, 0.15, 0.05]),
            "t": np.sort(rng.integers(0, 40, rows)) * 700 + rng.integers(0, 5, rows),
            "v": rng.integers(0, 10**6, rows),
        }
    )
    return spark.createDataFrame(pdf), pdf.sort_values(["k", "t", "v"]).reset_index(drop=True)


def test_previous_and_next_row_match_plain_windows(spark):
    df, pdf = frame(spark)
    chunk = F.floor(F.col("t") / 3600)
    for step in (1, -1):
        out = ordered.previous_row(df, ["k"], ["t", "v"], ["v", "t"], chunk, step=step).toPandas()
        out = out.sort_values(["k", "t", "v"]).reset_index(drop=True)
        want = pdf.groupby("k")[["v", "t"]].shift(step)
        pd.testing.assert_series_equal(out["prev_v"], want["v"], check_names=False)
        pd.testing.assert_series_equal(out["prev_t"], want["t"], check_names=False)


def test_position_counts_over_chunks(spark):
    df, pdf = frame(spark, 2)
    out = ordered.with_position(df, ["k"], ["t", "v"], F.floor(F.col("t") / 3600)).toPandas()
    out = out.sort_values(["k", "t", "v"]).reset_index(drop=True)
    assert (out["pos"] == pdf.groupby("k").cumcount()).all()


def test_next_known_value_is_carried_over_chunks(spark):
    df, pdf = frame(spark, 6)
    df = df.withColumn("x", F.when(F.col("v") % 9 == 0, F.col("v")))
    out = ordered.next_known(df, ["k"], ["t", "v"], "x", F.floor(F.col("t") / 3600), "next_x").toPandas()
    out = out.sort_values(["k", "t", "v"]).reset_index(drop=True)
    want = pdf.v.where(pdf.v % 9 == 0).groupby(pdf.k).bfill()
    pd.testing.assert_series_equal(out["next_x"], want, check_names=False)


def test_merge_in_sequence_matches_a_loop(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for key in range(30):
        start = np.cumsum(rng.integers(0, 9, 60))
        end = start + rng.integers(0, 20, 60)
        groups, seen = [], None
        for pos in range(60):
            rows.append((key, pos, pos // 7, int(start[pos]), int(end[pos])))
            if seen is None or start[pos] > seen:
                groups.append([pos, pos])
            groups[-1][1] = pos
            seen = end[pos] if seen is None else max(seen, end[pos])
        want[key] = [tuple(g) for g in groups]
    df = spark.createDataFrame(rows, "k long, pos long, block long, s long, e long")
    out = ordered.merge_in_sequence(df, ["k"], "block", "pos", "s", "e").collect()
    got = {k: [] for k in want}
    for r in sorted(out, key=lambda r: (r.k, r.group_no)):
        got[r.k].append((r.first_pos, r.last_pos))
    assert got == want


def test_odd_toggle_leaves_other_keys_alone(spark):
    rows = [("a", t) for t in (10, 20, 30)] + [("b", t) for t in (5, 15, 4000, 4100)]
    df = spark.createDataFrame(rows, "k string, t long")
    out = ordered.pair_toggles(df, ["k"], "t", ["t"], F.floor(F.col("t") / 1000)).collect()
    assert sorted((r.k, r.start, r.end) for r in out if r.k == "b") == [("b", 5, 15), ("b", 4000, 4100)]
    assert sorted((r.start, r.end or 0) for r in out if r.k == "a") == [(10, 20), (30, 0)]


def test_merge_of_a_key_with_many_blocks_matches_a_loop(spark):
    """Starts are not in order and long intervals reach over many blocks; a null key is a key."""
    rng = np.random.default_rng(8)
    start = np.cumsum(rng.integers(0, 9, 2000)) - rng.integers(0, 12, 2000)
    end = start + np.where(rng.random(2000) < 0.01, 400, rng.integers(0, 8, 2000))
    want, seen = [], None
    for pos in range(2000):
        if seen is None or start[pos] > seen:
            want.append([pos, pos])
        want[-1][1] = pos
        seen = end[pos] if seen is None else max(seen, end[pos])
    rows = [(k, pos, pos // 16, int(start[pos]), int(end[pos])) for k in ("hot", None) for pos in range(2000)]
    df = spark.createDataFrame(rows, "k string, pos long, block long, s long, e long")
    out = ordered.merge_in_sequence(df, ["k"], "block", "pos", "s", "e").orderBy("k", "group_no").collect()
    for key in ("hot", None):
        assert [[r.first_pos, r.last_pos] for r in out if r.k == key] == want
        assert [r.group_no for r in out if r.k == key] == list(range(len(want)))


def plan_of(df):
    """The plan as it is run, each subtree once."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_rows_are_read_and_shuffled_once(spark, tmp_path):
    """Minute means of pings: one scan and one exchange of pings; the others carry one row a chunk or sums a minute."""
    from pingscape.operators import panel

    rows = spark.range(4000).selectExpr(
        "concat('d', id % 3) as caid", "id * 7 + 1647338400 as utc_timestamp", "49 + id / 1e6 as latitude",
        "30 + id / 1e6 as longitude", "double(id) as altitude",
    )
    rows.write.parquet(str(tmp_path / "pings"))
    stored = spark.read.parquet(str(tmp_path / "pings"))
    tree = plan_of(panel.minute_means(panel.with_speed(stored)))
    assert tree.count("Scan parquet") == 1 and "ReusedExchange" in tree
    wide = [line for line in tree.splitlines() if " Exchange " in line and "at_chunk" in line and "REPARTITION" in line and "Reused" not in line]
    assert len(wide) == 1


def test_one_device_and_one_hour_with_everything_is_cut(spark):
    """Chunks are cut by counts: none keeps much more than the bound, and results stay those of a plain window."""
    rng = np.random.default_rng(9)
    t = np.sort(rng.integers(0, 3600, 5000))
    pdf = pd.DataFrame({"k": "hot", "t": t, "v": rng.integers(0, 10**6, 5000)})
    pdf = pd.concat([pdf, pd.DataFrame({"k": ["a", None, None], "t": [5, 7, 9], "v": [1, 2, 3]})])
    df, chunk = ordered.even_chunks(spark.createDataFrame(pdf), ["k"], "t", F.floor(F.col("t") / 3600), most_rows=400)
    assert df.groupBy("k", chunk.alias("c")).count().agg(F.max("count")).first()[0] <= 500
    out = ordered.beside(df, ["k"], ["t", "v"], chunk, {"before": "v"}, {"after": "v"}, "pos").toPandas()
    assert "range_cuts" not in out.columns
    want = pdf.sort_values(["k", "t", "v"]).reset_index(drop=True)
    want["before"], want["after"] = (want.groupby("k", dropna=False)["v"].shift(s) for s in (1, -1))
    want["pos"] = want.groupby("k", dropna=False).cumcount()
    both = [x.sort_values(["k", "t", "v"])[["k", "t", "v", "before", "after", "pos"]].reset_index(drop=True) for x in (out, want)]
    pd.testing.assert_frame_equal(both[0], both[1], check_dtype=False)
    same, plain = ordered.even_chunks(spark.createDataFrame(pdf), ["k"], "t", F.lit(0), most_rows=10**6)
    assert "range_cuts" not in same.columns
