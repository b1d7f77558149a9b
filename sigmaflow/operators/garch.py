"""GARCH(1,1) with zero mean and omega fixed at 0, as Spark jobs.

    h_1 = mean(r^2) of the fit sample,   h_t = alpha r_{t-1}^2 + beta h_{t-1}
    Normal:     l = -1/2 sum( ln 2pi + ln h_t + r_t^2 / h_t )
    Student-t:  l = sum( c(nu) - 1/2 ln h_t - (nu+1)/2 ln(1 + r_t^2 / (h_t (nu-2))) ),
                c(nu) = lnG((nu+1)/2) - lnG(nu/2) - 1/2 ln(pi (nu-2))

The grid QMLE evaluates every candidate of a broadcast parameter grid (its size
is fixed by the grid definition, not by the data) against every fit sample with
a Catalyst ``aggregate`` scan over the sample array, then keeps the arg-max per
(series, window, distribution). Fit samples are arrays bounded by one window.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmaflow.config import DEFAULT_GRID, DISTRIBUTIONS, GUARD_GRID, GarchGrid
from sigmaflow.operators.garch_kernel import COMPARED_DIGITS

LN_2PI = math.log(2 * math.pi)


def student_t_constant(nu: float) -> float:
    return math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))


def model_specs(spark: SparkSession) -> DataFrame:
    """The two model rows: sGARCH(1,1), no ARMA terms, no mean, omega = 0."""
    rows = [(d, "sGARCH", 1, 1, False, 0.0, "norm" if d == "Normal" else "std") for d in DISTRIBUTIONS]
    schema = ("distribution string, model string, garch_p int, garch_q int, include_mean boolean, "
              "omega double, dist_code string")
    return spark.createDataFrame(rows, schema)


def h1_expr(arr: str = "r") -> str:
    return f"aggregate({arr}, CAST(0 AS DOUBLE), (a, x) -> a + x * x) / size({arr})"


def grid_literal_sql(grid: GarchGrid = DEFAULT_GRID, distributions: tuple[str, ...] = DISTRIBUTIONS) -> str:
    """The candidate grid as a literal array of structs (its size is fixed by the grid)."""
    items = []
    for d in distributions:
        for a, p, nu in grid.points(d):
            nu_s = "CAST(NULL AS DOUBLE)" if nu is None else f"CAST({nu!r} AS DOUBLE)"
            c_s = "CAST(NULL AS DOUBLE)" if nu is None else f"CAST({student_t_constant(nu)!r} AS DOUBLE)"
            items.append(f"named_struct('distribution', '{d}', 'alpha', CAST({a!r} AS DOUBLE), "
                         f"'persistence', CAST({p!r} AS DOUBLE), 'beta', CAST({p - a!r} AS DOUBLE), "
                         f"'nu', {nu_s}, 'c_nu', {c_s})")
    return "array(" + ", ".join(items) + ")"


def loglik_expr(arr: str = "r", h1: str = "_h1", g: str = "g") -> str:
    """SQL: struct(h = variance for the step after the sample, ll = log-likelihood) of
    candidate ``g`` (a struct with alpha, beta, nu, c_nu, distribution)."""
    normal = f"-0.5 * ({LN_2PI!r} + ln(s.h) + x * x / s.h)"
    student = f"{g}.c_nu - 0.5 * ln(s.h) - ({g}.nu + 1) / 2 * ln(1 + x * x / (s.h * ({g}.nu - 2)))"
    term = f"CASE WHEN {g}.distribution = 'Normal' THEN {normal} ELSE {student} END"
    return (f"aggregate({arr}, CAST(named_struct('h', {h1}, 'll', 0D) AS struct<h: double, ll: double>), "
            f"(s, x) -> named_struct('h', {g}.alpha * x * x + {g}.beta * s.h, 'll', s.ll + {term}))")


def grid_loglik(samples: DataFrame, keys: list[str], grid: GarchGrid = DEFAULT_GRID,
                distributions: tuple[str, ...] = DISTRIBUTIONS) -> DataFrame:
    """Log-likelihood of every grid candidate on every fit sample ``keys..., r``, in the JVM.

    Each sample row maps the literal candidate array through a Catalyst
    ``aggregate`` scan (no join, and the sample array is not copied per candidate).
    """
    per_candidate = (f"transform({grid_literal_sql(grid, distributions)}, g -> named_struct("
                     f"'distribution', g.distribution, 'alpha', g.alpha, 'persistence', g.persistence, "
                     f"'beta', g.beta, 'nu', g.nu, 'fit', {loglik_expr()}))")
    return (samples.withColumn("_h1", F.expr(h1_expr("r")))
            .select(*keys, F.size("r").cast("long").alias("n_obs"), F.inline(F.expr(per_candidate)))
            .select(*keys, "distribution", "alpha", "persistence", "beta", "nu",
                    F.col("fit.ll").alias("loglik"), F.col("fit.h").alias("h_next"), "n_obs"))


def grid_fit(lls: DataFrame, keys: list[str]) -> DataFrame:
    """Best candidate per (keys, distribution); ties broken by (alpha, persistence, nu)."""
    best = F.max_by(F.struct("alpha", "persistence", "beta", "nu", "loglik", "h_next", "n_obs"),
                    F.struct(F.round("loglik", COMPARED_DIGITS), F.negative("alpha"), F.negative("persistence"),
                             F.negative(F.coalesce("nu", F.lit(0.0)))))
    return (lls.groupBy(*keys, "distribution").agg(best.alias("_b"))
            .select(*keys, "distribution", "_b.alpha", "_b.persistence", "_b.beta", "_b.nu",
                    "_b.loglik", "_b.h_next", "_b.n_obs"))


def nstep_forecast(fits: DataFrame, horizon_col: str = "n_ahead") -> DataFrame:
    """sigma_{T+k} for k = 1..n: h_{T+1} from the scan, h_{T+k} = (alpha+beta)^(k-1) h_{T+1}."""
    steps = fits.withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), F.col(horizon_col))))
    h = F.col("h_next") * F.pow(F.col("persistence"), F.col("step") - 1)
    return steps.withColumn("sigma", F.sqrt(h))


def daily_variance_expr(h: str = "h_next", p: str = "persistence", n: str = "n_ahead"):
    """Sum over steps k = 1..n of sigma_k^2, sigma_k = sqrt(h p^(k-1)), within the row."""
    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.col(n)), F.lit(0.0),
                       lambda acc, k: acc + F.pow(F.sqrt(F.col(h) * F.pow(F.col(p), k - 1)), 2))


def daily_variance(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Daily variance forecast = sum of the step variances of the day."""
    return steps.groupBy(*keys).agg(F.sum(F.col("sigma") * F.col("sigma")).alias("daily_variance_forecast"))


# ---------------------------------------------------------------- numpy path

FIT_FIELDS = ("alpha double, persistence double, beta double, nu double, loglik double, "
              "h_next double, n_obs long")


def _grid_arrays(spark: SparkSession, grid: GarchGrid, distributions: tuple[str, ...]):
    import numpy as np
    rows = [(d, a, p, p - a, np.nan if nu is None else nu)
            for d in distributions for a, p, nu in grid.points(d)]
    return {
        "distribution": np.array([x[0] for x in rows], dtype=object),
        "alpha": np.array([x[1] for x in rows], dtype=float),
        "persistence": np.array([x[2] for x in rows], dtype=float),
        "beta": np.array([x[3] for x in rows], dtype=float),
        "nu": np.array([x[4] for x in rows], dtype=float),
    }


def _fit_partitions(samples: DataFrame) -> int:
    """Two fit tasks per core: fits are CPU-heavy and byte-small, so the count follows
    the cluster's cores rather than the shuffle-partition setting."""
    spark = samples.sparkSession
    try:
        return max(2 * spark.sparkContext.defaultParallelism, 2)
    except Exception:  # noqa: BLE001 - remote sessions
        return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _iter_samples(rec: dict, keys: list[str]):
    """Yield (key values, sample array) from a per-window row (``r``) or a window block
    (``days`` + ``wins``), slicing each window out of the block's concatenated days."""
    import numpy as np
    if "days" not in rec:
        yield {k: rec[k] for k in keys}, np.asarray(rec["r"], dtype=float)
        return
    days = rec["days"]
    idx = np.array([d["day_idx"] for d in days], dtype=np.int64)
    parts = [np.asarray(d["values"], dtype=float) for d in days]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    allv = np.concatenate(parts) if parts else np.empty(0)
    for w in rec["wins"]:
        a = int(np.searchsorted(idx, w["fit_first_idx"], "left"))
        b = int(np.searchsorted(idx, w["fit_last_idx"], "right"))
        base = {k: rec[k] for k in keys if k != "window_id"}
        base["window_id"] = w["window_id"]
        yield base, allv[starts[a]:starts[b]]


def _input(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Spread fit inputs over tasks with an explicit repartition on their keys (AQE does
    not merge these CPU-heavy, byte-small partitions)."""
    if "days" in samples.columns:
        cols = [k for k in keys if k != "window_id"] + ["block_id", "days", "wins"]
        part = [k for k in keys if k != "window_id"] + ["block_id"]
    else:
        cols, part = [*keys, "r"], keys
    return samples.select(*cols).repartition(_fit_partitions(samples), *part)


def _out_schema(samples: DataFrame, keys: list[str], fields: str) -> str:
    types = {f.name: f.dataType.simpleString() for f in samples.schema.fields}
    types.setdefault("window_id", "bigint")
    if "days" in samples.columns:
        types["window_id"] = "bigint"
    return ", ".join(f"{k} {types[k]}" for k in keys) + ", distribution string, " + fields


def grid_fit_numpy(samples: DataFrame, keys: list[str], grid: GarchGrid = DEFAULT_GRID,
                   distributions: tuple[str, ...] = DISTRIBUTIONS, keep_all: bool = False) -> DataFrame:
    """Grid QMLE of every sample row ``keys..., r`` in a vectorised numpy scan.

    The samples are spread with an explicit repartition on the keys (AQE does not
    merge these CPU-heavy, byte-small partitions). Returns the best candidate per
    (keys, distribution), or every candidate with ``keep_all``.
    """
    import numpy as np
    import pandas as pd

    from sigmaflow.operators.garch_kernel import best_index, grid_scan

    g = _grid_arrays(samples.sparkSession, grid, distributions)
    schema = _out_schema(samples, keys, FIT_FIELDS)

    def fit_one(rec: dict, r) -> list[dict]:
        ll, h = grid_scan(r, g)
        rows = []
        for d in distributions:
            sel = np.flatnonzero(g["distribution"] == d)
            if keep_all:
                chosen = sel
            else:
                chosen = sel[[best_index(ll[sel], g["alpha"][sel], g["persistence"][sel], g["nu"][sel])]]
            for i in chosen:
                rows.append({**rec, "distribution": d, "alpha": g["alpha"][i],
                             "persistence": g["persistence"][i], "beta": g["beta"][i],
                             "nu": None if np.isnan(g["nu"][i]) else g["nu"][i],
                             "loglik": ll[i], "h_next": h[i], "n_obs": len(r)})
        return rows

    def run(batches):
        for pdf in batches:
            out = []
            for block in pdf.to_dict("records"):
                for rec, r in _iter_samples(block, keys):
                    out.extend(fit_one(rec, r))
            yield pd.DataFrame(out, columns=[*keys, "distribution", "alpha", "persistence", "beta", "nu",
                                             "loglik", "h_next", "n_obs"])

    return _input(samples, keys).mapInPandas(run, schema)


MLE_FIELDS = ("alpha double, persistence double, beta double, nu double, loglik double, h_next double, "
              "n_obs long, grid_loglik double, rounds int, warm boolean, converged boolean, at_bound boolean, "
              "se_alpha double, se_beta double, se_nu double")


def mle_fit_numpy(samples: DataFrame, keys: list[str], grid: GarchGrid = DEFAULT_GRID,
                  distributions: tuple[str, ...] = DISTRIBUTIONS, with_se: bool = True) -> DataFrame:
    """Refined ML fit per sample and distribution: bounded Newton steps with exact derivatives, then
    sandwich (robust) standard errors.

    The first window of a block climbs from the best point of the grid, the next ones from where their
    neighbour ended (``warm``). The likelihood of a short sample can have several tops, so every sample is also climbed from each point of a
    coarse grid that none of its neighbours exceeds (one point, where there is one top), and the best top stays.
    ``rounds`` counts the Newton steps; ``grid_loglik`` is given where the whole grid was searched.
    ``converged`` is false for a sample with a null return or without rows, whose fit is null.
    """
    import pandas as pd

    import numpy as np

    from sigmaflow.operators.garch_kernel import best_index, grid_scan
    from sigmaflow.operators.garch_newton import maximise, sandwich_se

    g = _grid_arrays(samples.sparkSession, grid, distributions)
    schema = _out_schema(samples, keys, MLE_FIELDS)
    cols = [*keys, "distribution", *(f.split()[0] for f in MLE_FIELDS.split(", "))]

    guard = _grid_arrays(samples.sparkSession, GUARD_GRID, distributions)
    axes = [np.unique(guard[c][~np.isnan(guard[c])]) for c in ("alpha", "persistence", "nu")]
    place = np.stack([np.searchsorted(axis, guard[c]) for axis, c in zip(axes, ("alpha", "persistence", "nu"), strict=True)], axis=1)
    near = (np.abs(place[:, None, :] - place[None, :, :]) <= 1).all(axis=2) & (guard["distribution"][:, None] == guard["distribution"][None, :])

    def point(grid_arrays, i):
        return tuple(grid_arrays[c][i] for c in ("alpha", "persistence", "nu"))

    def fit_all(r, neighbour: dict) -> dict:
        """By distribution: theta, log-likelihood, next variance, steps, converged, the grid's best likelihood, whether a neighbour was used."""
        usable = len(r) > 0 and bool(np.isfinite(r).all())
        found = {}
        lls, tops = None, np.zeros(0, int)
        if usable:
            lls, _ = grid_scan(r, guard)
            lls = np.where(np.isfinite(lls), lls, -np.inf)
            tops = np.flatnonzero(lls >= np.where(near, lls[None, :], -np.inf).max(axis=1))
        for d in distributions:
            student, before, grid_ll = d != "Normal", neighbour.get(d), np.nan
            sel = np.flatnonzero(g["distribution"] == d)
            if before is None and usable:
                ll, _ = grid_scan(r, {c: v[sel] for c, v in g.items()})
                i = best_index(ll, g["alpha"][sel], g["persistence"][sel], g["nu"][sel])
                first, grid_ll = point(g, sel[i]), ll[i]
            else:
                first = before or point(g, sel[0])
            starts = [first, *(point(guard, i) for i in tops if guard["distribution"][i] == d)]
            climbs = [maximise(r, a, p, n if student else None) for a, p, n in starts]
            theta, ll, h_next, _, converged = max(climbs, key=lambda t: (t[4], t[1] if np.isfinite(t[1]) else -np.inf))
            found[d] = theta, ll, h_next, sum(t[3] for t in climbs), converged, grid_ll, before is not None
        return found

    def fit_one(rec: dict, r, neighbour: dict) -> list[dict]:
        rows = []
        for d, (theta, best, h_next, rounds, converged, grid_ll, warm) in fit_all(r, neighbour).items():
            student = d != "Normal"
            row = {**rec, "distribution": d, "alpha": theta[0], "persistence": theta[1], "beta": theta[1] - theta[0],
                   "nu": theta[2] if student else None, "loglik": best, "h_next": h_next, "n_obs": len(r),
                   "grid_loglik": grid_ll, "rounds": rounds, "warm": warm, "converged": converged}
            if converged:
                neighbour[d] = (theta[0], theta[1], theta[2] if student else np.nan)
                if with_se:
                    se, row["at_bound"] = sandwich_se(r, theta)
                    row |= dict(zip(("se_alpha", "se_beta", "se_nu"), se, strict=False))
            rows.append({c: None if isinstance(v := row.get(c), float) and np.isnan(v) else v for c in cols})
        return rows

    def run(batches):
        for pdf in batches:
            out = []
            for block in pdf.to_dict("records"):
                neighbour: dict = {}
                for rec, r in _iter_samples(block, keys):
                    out.extend(fit_one(rec, r, neighbour))
            yield pd.DataFrame(out, columns=cols)

    return _input(samples, keys).mapInPandas(run, schema)
