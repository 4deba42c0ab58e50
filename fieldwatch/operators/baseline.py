"""Quiet-day baselines: robust harmonic fits per window in parallel, joined with overlapping weights, and a strictly causal form."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwatch.operators.blocks import forward_fill
from fieldwatch.session import materialize

PERIODS = (24.0, 12.0, 8.0, 6.0)


@dataclass(frozen=True)
class BaselineRule:
    """Settings (fixed values): window, step, weights of outliers, what counts as a stormy window."""

    window_h: float = 24.0
    step_h: float = 12.0
    passes: int = 4
    outlier: float = 30.0
    storm_residual: float = 50.0
    storm_share: float = 0.05
    least_known: float = 0.5
    kp_storm: float = 5.0
    dst_storm: float = -30.0
    update_min: float = 15.0


def harmonics(hours: np.ndarray, trend: tuple[float, float] | None = None) -> np.ndarray:
    """Columns 1, optionally the scaled time and its square, then sine and cosine of each period."""
    cols = [np.ones_like(hours)]
    if trend:
        u = np.clip((hours - trend[0]) / max(trend[1] - trend[0], 1e-12), -0.5, 1.5)
        cols += [u, u * u]
    for p in PERIODS:
        cols += [np.sin(2 * np.pi * hours / p), np.cos(2 * np.pi * hours / p)]
    return np.stack(cols, axis=1)


def robust_fit(a: np.ndarray, x: np.ndarray, rule: BaselineRule) -> np.ndarray | None:
    """Iteratively reweighted least squares over known values; NULL with fewer values than columns."""
    ok = np.isfinite(x)
    if ok.sum() < a.shape[1]:
        return None
    a, x = a[ok], x[ok]
    w, beta = np.ones(len(x)), np.zeros(a.shape[1])
    for _ in range(rule.passes):
        beta = np.linalg.lstsq(a * w[:, None], x * w, rcond=None)[0]
        size = np.abs(x - a @ beta)
        r = x - a @ beta
        sigma = 1.4826 * np.median(np.abs(r - np.median(r))) + 1e-12
        w = np.where(size > 3 * sigma, 0.01, np.where(size > rule.outlier, 0.1, 1.0))
    return beta


def harmonic_baseline(series: DataFrame, key: str, step_s: int, rule: BaselineRule = BaselineRule()) -> DataFrame:
    """(key, k, baseline) of a regular series (key, k, v, kp, dst); hours count from the series' start.

    Windows of ``window_h`` every ``step_h`` hours are fitted side by side; one row a window (its fit, its share of large
    residuals, its indices) then goes through the rule that stormy windows take the last quiet fit, before any quiet one
    that of the calmest window so far. Samples average their windows' curves with Hann weights; samples of no weight
    take the line between their neighbours' baselines, or the nearest one's at the ends.
    """
    size, hop = int(rule.window_h * 3600 / step_s), int(rule.step_h * 3600 / step_s)
    span = series.groupBy(key).agg(F.min("k").alias("k0"), F.max("k").alias("k1"))
    rows = series.join(span, key).withColumn("i", F.col("k") - F.col("k0")).withColumn("n", F.col("k1") - F.col("k0") + 1)
    most = F.greatest(F.lit(0), F.ceil(F.greatest(F.lit(1), F.col("n") - hop) / hop) - 1)
    first, last = F.greatest(F.lit(0), F.floor((F.col("i") - size) / hop) + 1), F.least(F.floor(F.col("i") / hop), most)
    placed = rows.where(last >= first).withColumn("window", F.explode(F.sequence(first, last)))
    key_field = series.schema[key]
    fits = T.StructType([key_field, T.StructField("window", T.LongType()), T.StructField("length", T.LongType()), T.StructField("beta", T.ArrayType(T.DoubleType())),
                         T.StructField("share", T.DoubleType()), T.StructField("stormy", T.BooleanType())])

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        x = part["v"].to_numpy(float)
        n = len(x)
        out = pd.DataFrame({key: part[key].iloc[:1], "window": part["window"].iloc[:1], "length": [n], "beta": [None], "share": [None], "stormy": [None]})
        if n < hop // 2 or np.isfinite(x).sum() < rule.least_known * n:
            return out
        a = harmonics(part["i"].to_numpy(float) * step_s / 3600.0)
        beta = robust_fit(a, x, rule)
        if beta is None:
            return out
        share = float(np.nansum(np.abs(x - a @ beta) > rule.storm_residual) / n)
        kp, dst = part["kp"].to_numpy(float), part["dst"].to_numpy(float)
        planet = bool((kp[np.isfinite(kp)] >= rule.kp_storm).any() or (dst[np.isfinite(dst)] < rule.dst_storm).any())
        out["beta"], out["share"], out["stormy"] = [beta.tolist()], [share], [share > rule.storm_share or planet]
        return out

    def settle(windows: pd.DataFrame) -> pd.DataFrame:
        windows = windows.sort_values("window")
        good = seed = None
        calmest, used = 1.0, []
        for beta, share, stormy in zip(windows["beta"], windows["share"], windows["stormy"]):
            if beta is None:
                used.append(None)
                continue
            own_seed = share < calmest
            if own_seed:
                calmest, seed = share, beta
            if not stormy:
                good = beta
                used.append(beta)
            elif good is not None:
                used.append(good)
            else:
                used.append(seed if seed is not None and not own_seed else beta)
        return windows.assign(beta=used)[[f.name for f in fits]]

    settled = placed.select(key, "window", "i", "v", "kp", "dst").groupBy(key, "window").applyInPandas(fit, fits).groupBy(key).applyInPandas(settle, fits)
    j = F.col("i") - F.col("window") * hop
    hann = F.when(F.col("length") > 1, 0.5 - 0.5 * F.cos(F.lit(2 * np.pi) * j / (F.col("length") - 1))).otherwise(F.lit(1.0))
    hours = F.col("i") * F.lit(step_s / 3600.0)
    terms = [F.lit(1.0)]
    for p in PERIODS:
        terms += [F.sin(F.lit(2 * np.pi / p) * hours), F.cos(F.lit(2 * np.pi / p) * hours)]
    curve = sum((F.col("beta")[m] * t for m, t in enumerate(terms)), F.lit(0.0))
    weighted = placed.join(settled.select(key, "window", "length", "beta"), [key, "window"]).where("beta is not null").select(key, "k", hann.alias("w"), curve.alias("c"))
    means = weighted.groupBy(key, "k").agg(F.sum("w").alias("w"), (F.sum(F.col("w") * F.col("c")) / F.greatest(F.sum("w"), F.lit(1e-300))).alias("b"))
    known = rows.select(key, "k").join(means.select(key, "k", F.when(F.col("w") > 1e-12, F.col("b")).alias("b")), [key, "k"], "left")
    filled = forward_fill(known.withColumn("_at", F.when(F.col("b").isNotNull(), F.struct("k", "b"))), [key], "k", "_at", "_before").withColumn("_neg", -F.col("k"))
    filled = forward_fill(filled, [key], "_neg", "_at", "_after")
    p, q = F.col("_before"), F.col("_after")
    line = p["b"] + (q["b"] - p["b"]) * (F.col("k") - p["k"]) / F.greatest(F.lit(1), q["k"] - p["k"])
    return filled.select(key, "k", F.coalesce("b", line, p["b"], q["b"]).alias("baseline"))


def mean_deviations(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Median distance from the median of each row of ``r``, of which ``n`` values are known and the others NaN."""
    at = np.arange(len(r))

    def middle(x: np.ndarray) -> np.ndarray:
        x.sort(axis=1)  # NaN comes last
        return 0.5 * (x[at, (n - 1) // 2] + x[at, n // 2])

    s = r.copy()
    s -= middle(s)[:, None]
    return middle(np.abs(s, out=s))


class TrailingFits:
    """``robust_fit`` of curves with trend over many windows of one length, all at once.

    Counted from its own start, every window has the same columns, here an orthonormal form of them, so fits are products of
    matrices: normal equations with one step of refinement. Windows whose equations are badly conditioned go through ``robust_fit``.
    """

    def __init__(self, size: int, step_s: float, rule: BaselineRule):
        self.size, self.step_s, self.rule = size, step_s, rule
        m = np.arange(size, dtype=float)
        self.q, self.r = np.linalg.qr(harmonics(m * step_s / 3600.0, (0.0, (size - 1) * step_s / 3600.0)))
        c = self.q.shape[1]
        one, other = np.triu_indices(c)
        # products of two columns are sums of 37 curves (powers of time, harmonics, both), so few sums give all
        u, s, v = np.linalg.svd(self.q[:, one] * self.q[:, other], full_matrices=False)
        few = s > 1e-13 * s[0]
        self.curves, self.mixed = u[:, few], s[few, None] * v[few]
        self.pair = np.zeros((c, c), int)
        self.pair[one, other] = self.pair[other, one] = np.arange(len(one))
        self.sound = np.linalg.cond(self.r) < 1e6

    def fit(self, x: np.ndarray, first: np.ndarray, i0: int) -> np.ndarray:
        """Coefficients of ``harmonics`` over hours since the series' start for the windows that begin at the positions ``first`` of ``x``,
        whose own first position is ``i0``; NaN where too little is known."""
        out = np.full((len(first), self.q.shape[1]), np.nan)
        ok = np.isfinite(x)
        total = np.concatenate([[0], np.cumsum(ok)])
        n = total[first + self.size] - total[first]
        some = np.flatnonzero(n >= max(self.rule.least_known * self.size, 12))
        x = np.where(ok, x, np.nan)
        windows = np.lib.stride_tricks.sliding_window_view(x, self.size) if len(some) else None
        most = max(1, 32768 // self.size)
        for a in range(0, len(some), most):
            at = some[a:a + most]
            y = windows[first[at]]
            known = np.isfinite(y)
            lo, hi = known.argmax(1), self.size - 1 - known[:, ::-1].argmax(1)
            local, good = self._solve(y, known, n[at]) if self.sound else (out[at], np.zeros(len(at), bool))
            out[at] = self._since_start(local, first[at] + i0, lo, hi)
            for w in np.flatnonzero(~good):
                h = (first[at[w]] + i0 + np.arange(self.size)) * self.step_s / 3600.0
                beta = robust_fit(harmonics(h, (h[lo[w]], h[hi[w]])), y[w], self.rule)
                out[at[w]] = np.nan if beta is None else beta
        return out

    def _solve(self, y: np.ndarray, known: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients of the windows' own columns, and which can be relied on."""
        q, rule = self.q, self.rule
        ok, y0 = known.astype(float), np.where(known, y, 0.0)
        w = ok
        for k in range(rule.passes):
            if k:
                limit = 3 * (1.4826 * mean_deviations(r, n) + 1e-12)
                size = np.abs(r)
                w = ok.copy()
                np.putmask(w, size > rule.outlier, 0.01)  # squares of the weights
                np.putmask(w, size > limit[:, None], 0.0001)
            g, b = (w @ self.curves @ self.mixed)[:, self.pair], (w * y0) @ q
            try:
                if k < rule.passes - 1:
                    r = y - np.linalg.solve(g, b[..., None])[..., 0] @ q.T
                else:
                    inverse = np.linalg.inv(g)
            except np.linalg.LinAlgError:
                return np.zeros((len(y), q.shape[1])), np.zeros(len(y), bool)
        beta = np.einsum("bij,bj->bi", inverse, b)
        beta += np.einsum("bij,bj->bi", inverse, (w * (y0 - beta @ q.T)) @ q)
        return beta, (np.abs(g).sum(2).max(1) * np.abs(inverse).sum(2).max(1) < 1e8) & np.isfinite(beta).all(1)

    def _since_start(self, local: np.ndarray, first: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The same curves with the trend over the known part of each window and phases from the series' start."""
        if not self.sound:
            return local
        b = np.linalg.solve(self.r, local.T).T
        c, d = lo / (self.size - 1), (hi - lo) / (self.size - 1)
        cols = [b[:, 0] + b[:, 1] * c + b[:, 2] * c * c, d * (b[:, 1] + 2 * b[:, 2] * c), b[:, 2] * d * d]
        for m, p in enumerate(PERIODS):
            turn, s, co = 2 * np.pi * (first * self.step_s / 3600.0) / p, b[:, 3 + 2 * m], b[:, 4 + 2 * m]
            cols += [s * np.cos(turn) + co * np.sin(turn), co * np.cos(turn) - s * np.sin(turn)]
        return np.stack(cols, axis=1)


def causal_baseline(series: DataFrame, key: str, step_s: int | str, rule: BaselineRule = BaselineRule(), fill: int = 0) -> DataFrame:
    """(key, k, baseline, residual) where every sample is judged by samples before it only.

    Every ``update_min`` minutes a curve with trend is fitted to the ``window_h`` hours before, if enough of them are known; it
    holds until the next. Blocks carry their history as halo, so fits of one series run side by side; fits are carried on
    where one is missing. Samples without a fit take the median of the window before them; NULL where nothing is known.

    Rows of unknown v may be left out of ``series`` between a key's first and last, they come out all the same. The first ``fill``
    samples of every gap are interpolated as by ``fill_gaps``, for which a block also gets the first known sample after it.
    ``step_s`` is the seconds of a step, or a LONG column that has them for each key and is returned too.

    Blocks are worked off once: only samples before a block's first fit are looked at again, with the last fit of the blocks
    before, and only they get a median. ``series`` is read several times, so it should be a written table.
    """
    by_key = isinstance(step_s, str)
    step = F.max(step_s) if by_key else F.lit(step_s).cast("long")
    geometry = {"_size": F.greatest(F.lit(12), F.bround(F.lit(rule.window_h * 3600.0) / F.col("_step")).cast("long")),
                "_hop": F.greatest(F.lit(1), F.bround(F.lit(rule.update_min * 60.0) / F.col("_step")).cast("long"))}
    # window j begins at sample j * hop, its fit holds for samples size + j * hop on; blocks hold whole hops of these
    span = series.groupBy(key).agg(F.min("k").alias("_k0"), F.max("k").alias("_k1"), step.alias("_step")).withColumns(geometry)
    span = span.withColumn("_length", F.floor(F.greatest(F.lit(4096), 4 * F.col("_size")) / F.col("_hop")) * F.col("_hop"))
    block = lambda k: F.floor((k - F.col("_k0") - F.col("_size")) / F.col("_length"))
    rows = series.where("v is not null and not isnan(v)").select(key, "k", "v").join(span, key)
    until = F.least(block(F.col("k") + F.col("_size") + fill), block(F.col("_k1")))
    cut = rows.select(key, "k", "v", F.explode(F.sequence(block(F.col("k")), until)).alias("_block"))
    blocks = span.select("*", F.explode(F.sequence(F.lit(-1).cast("long"), block(F.col("_k1")))).alias("_block"))
    if fill:
        firsts = rows.groupBy(key, block(F.col("k")).alias("_block")).agg(F.min("k").alias("_first"), F.min_by("v", "k").alias("_value"))
        ahead = Window.partitionBy(key).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)  # one row a block
        blocks = blocks.join(firsts, [key, "_block"], "left").withColumns({"_next": F.last("_first", ignorenulls=True).over(ahead), "_then": F.last("_value", ignorenulls=True).over(ahead)})
    else:
        blocks = blocks.withColumns({"_next": F.lit(None).cast("long"), "_then": F.lit(None).cast("double")})
    blocks = blocks.select(F.col(key).alias("_key"), F.col("_block").alias("_number"), "_k0", "_k1", "_step", "_length", "_next", "_then")
    done = T.StructType([series.schema[key], T.StructField("_block", T.LongType()), T.StructField("_k0", T.LongType()), T.StructField("_step", T.LongType()), T.StructField("k", T.LongType()),
                         T.StructField("v", T.DoubleType()), T.StructField("base", T.DoubleType()), T.StructField("_fitted", T.BooleanType()),
                         T.StructField("_ends", T.BooleanType()), T.StructField("_last", T.ArrayType(T.DoubleType()))])
    ready: dict[int, TrailingFits] = {}

    def judge(part: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
        at = about.iloc[0]
        k0, seconds, length, begin = int(at["_k0"]), int(at["_step"]), int(at["_length"]), int(at["_number"])
        if seconds not in ready:
            ready[seconds] = TrailingFits(max(12, round(rule.window_h * 3600.0 / seconds)), seconds, rule)
        fits, hop = ready[seconds], max(1, round(rule.update_min * 60.0 / seconds))
        size = fits.size
        low, high = max(0, size + begin * length), min(size + (begin + 1) * length - 1, int(at["_k1"]) - k0)
        i0 = low - size - fill  # before the series' start all is unknown
        pos, value = part["k"].to_numpy(np.int64) - k0, part["v"].to_numpy(float)
        order = np.argsort(pos)
        pos, value = pos[order], value[order]
        x = np.full(high - i0 + 1, np.nan)
        x[pos - i0] = value
        if fill and len(pos):
            beyond = not pd.isna(at["_next"])
            after, then = np.append(pos[1:], int(at["_next"]) - k0 if beyond else pos[-1] + 2 * fill + 1), np.append(value[1:], at["_then"] if beyond else value[-1])
            n = after - pos - 1
            for m in range(1, fill + 1):
                some = (n >= m) & (pos + m <= high)
                x[pos[some] + m - i0] = value[some] + (then[some] - value[some]) * m / (n[some] + 1)
        i = np.arange(low, high + 1)
        base, last, j = np.full(len(i), np.nan), None, (i - size) // hop
        if j[-1] >= 0:
            starts = np.arange(max(0, j[0]), j[-1] + 1)
            betas = fits.fit(x, starts * hop - i0, i0)
            used = np.maximum.accumulate(np.where(np.isfinite(betas).all(1), np.arange(len(starts)), -1))
            fit = np.where(j >= 0, used[np.maximum(j - starts[0], 0)], -1)
            told = fit >= 0
            hours, u, b = i[told] * seconds / 3600.0, np.clip((i[told] - j[told] * hop) / (size - 1), -0.5, 1.5), betas[fit[told]]
            curve = b[:, 0] + b[:, 1] * u + b[:, 2] * u * u
            for m, period in enumerate(PERIODS):
                curve += b[:, 3 + 2 * m] * np.sin(2 * np.pi / period * hours) + b[:, 4 + 2 * m] * np.cos(2 * np.pi / period * hours)
            base[told] = curve
            if used[-1] >= 0:
                last = betas[used[-1]].tolist()
        fitted = np.isfinite(base)
        bare = np.flatnonzero(~fitted)
        if len(bare):
            middle = pd.Series(x[:i[bare[-1]] - i0]).rolling(size, min_periods=1).median().to_numpy()
            base[bare] = middle[i[bare] - i0 - 1]
        ends = np.zeros(len(i), bool)
        ends[-1] = True
        return pd.DataFrame({key: about["_key"].iloc[0], "_block": begin, "_k0": k0, "_step": seconds, "k": i + k0, "v": x[low - i0:], "base": base, "_fitted": fitted, "_ends": ends,
                             "_last": pd.Series([None] * (len(i) - 1) + [last], dtype=object)})

    told = materialize(cut.groupBy(key, "_block").cogroup(blocks.groupBy("_key", "_number")).applyInPandas(judge, done), "causal")
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    carried = told.where("_ends").select(key, "_block", F.last("_last", ignorenulls=True).over(before).alias("used")).where("used is not null")
    # samples of no fit of their own block: the last fit before it, with the trend of their own window
    again = told.where("not _fitted").withColumns(geometry | {"i": F.col("k") - F.col("_k0")}).join(carried, [key, "_block"], "left")
    hours = F.col("i") * F.col("_step") / F.lit(3600.0)
    u = F.greatest(F.lit(-0.5), F.least(F.lit(1.5), (F.pmod(F.col("i") - F.col("_size"), F.col("_hop")) + F.col("_size")) / (F.col("_size") - 1)))
    terms = [F.lit(1.0), u, u * u]
    for p in PERIODS:
        terms += [F.sin(F.lit(2 * np.pi / p) * hours), F.cos(F.lit(2 * np.pi / p) * hours)]
    again = again.withColumn("base", F.coalesce(sum((F.col("used")[m] * t for m, t in enumerate(terms)), F.lit(0.0)), "base"))
    every = told.where("_fitted").select(key, "k", "v", "base", "_step").unionByName(again.select(key, "k", "v", "base", "_step"))
    return every.select(key, "k", F.col("base").alias("baseline"), (F.col("v") - F.col("base")).alias("residual"), *([F.col("_step").alias(step_s)] if by_key else []))
