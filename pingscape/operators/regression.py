"""Regressions per event, from sums that Spark aggregates before anything is solved.

Dummy regressions have a closed form on cell means.  Where a solver is needed, each event has been
reduced to one row of sums by a partial aggregate first; only those rows reach numpy.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fixed_values import BASE_CELL
from .events import EVENT

CELL_COL = "time_to_raid_post"


def _grid(outcomes: list[str], samples: dict[tuple, Column]) -> list[tuple]:
    """(outcome, scale, sample, rule, value) of the outcome grid: outcome x {level, asinh} x sample.

    Rows with a missing outcome are left out, and zero distances from the anchor point too.
    """
    grid = []
    for name in outcomes:
        y = F.col(name).cast("double")
        usable = y.isNotNull() & (y != 0 if name == "distance_point" else F.lit(True))
        for sample, rule in samples.items():
            grid += [(name, scale, sample, usable & rule, value) for scale, value in (("", y), ("log", F.asinh(y)))]
    return grid


def long_outcomes(events: DataFrame, outcomes: list[str], samples: dict[str, Column] | None = None) -> DataFrame:
    """Outcome grid as rows, for uses that need the rows themselves; effects come from `grid_effects`."""
    grid = [
        F.when(keep, F.struct(
            F.lit(name).alias("outcome"), F.lit(scale).alias("scale"), F.lit(sample).alias("sample"), value.alias("y")
        ))
        for name, scale, sample, keep, value in _grid(outcomes, samples or {"": F.lit(True)})
    ]
    return (
        events.withColumn("cell_y", F.explode(F.array_compact(F.array(*grid))))
        .select(*events.columns, "cell_y.*")
    )


def grid_effects(
    events: DataFrame, keys: list[str], outcomes: list[str], samples: dict[tuple, Column] | None = None,
    names: tuple[str, ...] = ("sample",), cell: str = CELL_COL, base: int = BASE_CELL,
) -> DataFrame:
    """Dummy effects of the whole outcome grid from one aggregate: (keys, names, outcome, scale, cell, b, n).

    A row of the panel is read once and never repeated: per (keys, cell) every outcome, scale and sample is a mean and
    a count over the rows of its own rule, and these become rows only after the aggregate.  `samples` maps the values of
    the columns `names` to rules.
    """
    grid = _grid(outcomes, samples or {("",): F.lit(True)})
    sums, parts = [], []
    for i, (name, scale, sample, keep, value) in enumerate(grid):
        used = F.when(keep, value)
        sums += [F.avg(used).alias(f"m{i}"), F.count(used).alias(f"n{i}")]
        said = [F.lit(v).alias(n) for n, v in zip((*names, "outcome", "scale"), (*sample, name, scale))]
        parts.append(F.struct(*said, F.col(f"m{i}").alias("m"), F.col(f"n{i}").alias("n")))
    wide = events.groupBy(*keys, cell).agg(*sums)
    rows = wide.select(*keys, cell, F.explode(F.filter(F.array(*parts), lambda g: g["n"] > 0)).alias("g"))
    return effects_of_means(rows.select(*keys, cell, "g.*"), [*keys, *names, "outcome", "scale"], cell, base)


def dummy_effects(df: DataFrame, keys: list[str], y: str, cell: str = CELL_COL, base: int = BASE_CELL) -> DataFrame:
    """OLS of y on cell dummies and a constant, per key, as (keys, cell, b, n); see `effects_of_means`."""
    means = df.filter(F.col(y).isNotNull()).groupBy(*keys, cell).agg(
        F.avg(y).alias("m"), F.count(y).alias("n")
    )
    return effects_of_means(means, keys, cell, base)


def effects_of_means(means: DataFrame, keys: list[str], cell: str = CELL_COL, base: int = BASE_CELL) -> DataFrame:
    """(keys, cell, b, n) from the cell means m and counts n of a dummy regression with a constant.

    b is the cell mean minus the base mean.  Without base rows the minimum-norm solution applies: the
    constant is the sum of the K cell means over K + 1 (no constant when K = 1).  A cell without rows
    has coefficient 0 and gives no row here.
    """
    group = W.partitionBy(*keys)  # one row per cell: the group is bounded by the number of cells
    is_base = F.col(cell) == base
    return (
        means.withColumns(
            {
                "base_m": F.max(F.when(is_base, F.col("m"))).over(group),
                "k": F.count(F.when(~is_base, 1)).over(group),
                "total_m": F.sum(F.when(~is_base, F.col("m"))).over(group),
            }
        )
        .filter(~is_base)
        .withColumn(
            "const",
            F.coalesce("base_m", F.when(F.col("k") == 1, 0.0).otherwise(F.col("total_m") / (F.col("k") + 1))),
        )
        .select(*keys, cell, (F.col("m") - F.col("const")).alias("b"), "n")
    )


def cell_slopes(df: DataFrame, keys: list[str], y: str, d: str, cell: str = CELL_COL) -> DataFrame:
    """Sums per (keys, cell) that determine any regression of y on cell, d and cell x d."""
    used = df.filter(F.col(y).isNotNull() & F.col(d).isNotNull())
    x, v = F.col(d).cast("double"), F.col(y).cast("double")
    slope = F.try_divide(F.covar_pop(x, v), F.var_pop(x))
    return used.groupBy(*keys, cell).agg(
        F.count(v).alias("n"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"),
        F.sum(v).alias("sy"), F.sum(x * v).alias("sxy"),
        F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.var_pop(x).alias("x_var"),
        slope.alias("slope"), (F.avg(v) - slope * F.avg(x)).alias("intercept"),
    )


def interacted_effects(df: DataFrame, keys: list[str], y: str, d: str, cell: str = CELL_COL,
                       base: int = BASE_CELL) -> DataFrame:
    """OLS of y on cell dummies, their products with d, d and a constant: (keys, term, cell, b).

    term is "cell", "cell_x" (interaction) or "x" (main effect, null cell).  When the base and every
    observed cell have at least two distinct d, each cell is a line of its own and the coefficients
    are differences of lines; the other groups go to the solver.
    """
    sums = cell_slopes(df, keys, y, d, cell)
    group = W.partitionBy(*keys)  # bounded by the number of cells
    is_base = F.col(cell) == base
    marked = sums.withColumns(
        {
            "lines": F.min((F.col("x_min") < F.col("x_max")).cast("int")).over(group)
            * F.max(is_base.cast("int")).over(group),
            "b0": F.max(F.when(is_base, F.col("intercept"))).over(group),
            "s0": F.max(F.when(is_base, F.col("slope"))).over(group),
        }
    )
    exact = marked.filter("lines = 1")
    terms = F.when(
        is_base, F.array(_term("x", F.lit(None).cast("long"), F.col("s0")))
    ).otherwise(
        F.array(
            _term("cell", F.col(cell), F.col("intercept") - F.col("b0")),
            _term("cell_x", F.col(cell), F.col("slope") - F.col("s0")),
        )
    )
    direct = exact.select(*keys, F.explode(terms).alias("t")).select(*keys, "t.*")
    solved = solve_interacted(marked.filter("lines = 0"), keys, cell, base)
    return direct.unionByName(solved)


def _term(name: str, cell: Column, b: Column) -> Column:
    return F.struct(F.lit(name).alias("term"), cell.cast("long").alias("cell"), b.alias("b"))


def _interacted_row(cells: list[dict], base: int) -> list[dict]:
    """Minimum-norm solution of one event from its cell sums (a few dozen cells at most).

    The squares of a cell are n (y_mean - line at x_mean)^2 + n x_var (slope - slope of the line)^2 and a constant, so
    two rows stand for a cell; solving these rows keeps the digits that products of raw sums would lose.
    """
    named = sorted(c["cell"] for c in cells if c["cell"] != base)
    at = {c: i for i, c in enumerate(named)}
    k = len(named)
    # columns: constant, dummies, dummies x d, d
    design, target = [], []
    for c in cells:
        one, line = [0], [2 * k + 1]
        if c["cell"] in at:
            one, line = [0, 1 + at[c["cell"]]], [2 * k + 1, 1 + k + at[c["cell"]]]
        weight, level = np.sqrt(c["n"]), np.zeros(2 * k + 2)
        level[one], level[line] = 1.0, c["sx"] / c["n"]
        design.append(weight * level)
        target.append(weight * c["sy"] / c["n"])
        if c["x_min"] < c["x_max"]:
            weight, tilt = np.sqrt(c["n"] * c["x_var"]), np.zeros(2 * k + 2)
            tilt[line] = 1.0
            design.append(weight * tilt)
            target.append(weight * c["slope"])
    all_d = {c["x_min"] for c in cells} | {c["x_max"] for c in cells}
    # a regressor that is already a non-zero constant takes the place of the constant
    constant_given = (k == 1 and len(cells) == 1) or (len(all_d) == 1 and 0.0 not in all_d)
    keep = np.arange(1 if constant_given else 0, 2 * k + 2)
    b = np.zeros(2 * k + 2)
    b[keep] = np.linalg.lstsq(np.array(design)[:, keep], np.array(target), rcond=1e-10)[0]
    out = [{"term": "cell", "cell": c, "b": b[1 + i]} for c, i in at.items()]
    out += [{"term": "cell_x", "cell": c, "b": b[1 + k + i]} for c, i in at.items()]
    return out + [{"term": "x", "cell": None, "b": b[2 * k + 1]}]


def solve_interacted(sums: DataFrame, keys: list[str], cell: str = CELL_COL, base: int = BASE_CELL) -> DataFrame:
    """Coefficients from cell sums; one row per event (its cells as an array) reaches numpy."""
    parts = F.struct(F.col(cell).cast("long").alias("cell"), "n", "sx", "sy", "x_min", "x_max", "x_var", "slope")
    events = sums.groupBy(*keys).agg(F.collect_list(parts).alias("cells"))

    @F.pandas_udf("array<struct<term:string,cell:long,b:double>>")
    def solve(cells: pd.Series) -> pd.Series:
        return pd.Series([_interacted_row(list(c), base) for c in cells])

    return events.select(*keys, F.explode(solve("cells")).alias("t")).select(*keys, "t.*")


def grouped_ols(df: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """General OLS per group on any columns and a constant: (keys, term, b), constant left out.

    Means and covariances are made by Spark (rows with a missing value dropped); the solver sees one
    row of them per group.
    """
    complete = df.dropna("any", subset=[y, *xs])
    cols = [*[F.col(x).cast("double") for x in xs], F.col(y).cast("double")]
    size = len(cols)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sums = complete.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in cols]).alias("means"),
        F.array(*[F.covar_pop(cols[i], cols[j]) for i, j in pairs]).alias("s"),
        F.array(*[F.min(c) for c in cols[:-1]]).alias("lo"),
        F.array(*[F.max(c) for c in cols[:-1]]).alias("hi"),
    )

    @F.pandas_udf("array<struct<term:string,b:double>>")
    def solve(n: pd.Series, means: pd.Series, s: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        rows = []
        for count, mean, sums_row, low, high in zip(n, means, s, lo, hi):
            m, mean, low = np.zeros((size, size)), np.array(mean), np.array(low)
            for (i, j), value in zip(pairs, sums_row):
                m[i, j] = m[j, i] = value
            same = low == np.array(high)
            varied, fixed = np.flatnonzero(~same), np.flatnonzero(same & (low != 0))
            b = np.zeros(size - 1)
            scale = np.sqrt(np.diag(m)[varied])
            corr = m[np.ix_(varied, varied)] / np.outer(scale, scale)
            if not len(varied) or np.linalg.matrix_rank(corr, tol=1e-10, hermitian=True) == len(varied):
                # centred slopes; regressors that are constant share the level in the smallest way
                b[varied] = np.linalg.solve(corr, m[varied, -1] / scale) / scale
                if len(fixed):
                    b[fixed] = (mean[-1] - b[varied] @ mean[varied]) * low[fixed] / (low[fixed] ** 2).sum()
            else:  # minimum norm, from raw products with the constant unless a regressor takes its place
                full = np.append(1.0, mean)
                raw = count * np.outer(full, full)
                raw[1:, 1:] += count * m
                keep = np.arange(1 if len(fixed) else 0, size)
                found = np.linalg.pinv(raw[np.ix_(keep, keep)], rcond=1e-12, hermitian=True) @ raw[keep, -1]
                b = found[-(size - 1):]
            rows.append([{"term": x, "b": b[i]} for i, x in enumerate(xs)])
        return pd.Series(rows)

    return sums.select(*keys, F.explode(solve("n", "means", "s", "lo", "hi")).alias("t")).select(*keys, "t.*")


def wide_estimates(effects: DataFrame, cells: list[int], keys: list[str] = EVENT, prefix: str = "e_TYPE_") -> DataFrame:
    """One row per event and one column per cell of a known list; unobserved cells are 0.

    A cell that is missing from the list stops the job instead of being lost.
    """
    cell = F.col(CELL_COL)
    unlisted = F.raise_error(F.concat(cell.cast("string"), F.lit(" is not in the list of cells"))).cast("int")
    effects = effects.withColumn(CELL_COL, F.when(cell.isin(cells) | cell.isNull(), cell).otherwise(unlisted))
    wide = effects.groupBy(*keys).pivot(CELL_COL, cells).agg(F.first("b"))
    return wide.fillna(0.0, [str(c) for c in cells]).withColumnsRenamed({str(c): f"{prefix}{c}" for c in cells})
