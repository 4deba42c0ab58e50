"""Implausible readings: robust exponentially weighted control charts per source, run-length counters and physical limits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwatch.session import materialize, partitions_for


@dataclass(frozen=True)
class FieldRule:
    """What is implausible for one field. ``spike`` is a multiple of the usual scatter if ``relative``, else in units."""

    name: str
    low: float
    high: float
    spike: float
    relative: bool = False
    stuck_above: float | None = None
    max_gap_periods: int | None = None


@dataclass(frozen=True)
class Chart:
    """Settings of the control chart."""

    level_weight: float = 0.2
    scale_weight: float = 0.05
    clip: float = 3.0  # suspected values enter mean and scale clipped to so many scales
    limit: float = 4.0  # beyond so many scales a value is suspected
    accept_after: int = 3  # a longer run of suspected values is a new level
    lane: int = 512  # readings that one lane of the vectorised chart judges
    warm: int = 32  # readings before those, which only set the lane's state
    stuck_run: int = 12
    longest_spike: int = 3
    edge: int = 32  # readings that neighbouring partitions exchange
    copies: int = 16  # copies of an edge reading that are exchanged row by row


OUT = "kind string, f byte, station string, us long, id long, value double, a double, b double, gap_us long, hole boolean, wide boolean, n long"
_ARROW = pa.schema([("kind", pa.string()), ("f", pa.int8()), ("station", pa.string()), ("us", pa.int64()), ("id", pa.int64()), ("value", pa.float64()),
                    ("a", pa.float64()), ("b", pa.float64()), ("gap_us", pa.int64()), ("hole", pa.bool_()), ("wide", pa.bool_()), ("n", pa.int64())])


def _one_way(v: np.ndarray, starts: np.ndarray, steps: np.ndarray, c: Chart) -> tuple[np.ndarray, np.ndarray]:
    """Suspected flags and scale of every reading, by charts that run through ``v`` from left to right."""
    n = len(v)
    ends = np.append(starts[1:], n)
    first, out_from, out_to = [], [], []
    for s, e in zip(starts, ends):
        cuts = np.arange(s, e, c.lane)
        first.append(np.maximum(cuts - c.warm, s))
        out_from.append(cuts)
        out_to.append(np.append(cuts[1:], e))
    lo, begin, stop = (np.concatenate(x) if x else np.zeros(0, int) for x in (first, out_from, out_to))
    suspect, scale = np.zeros(n, bool), np.full(n, np.nan)
    if not n:
        return suspect, scale
    series_end = np.repeat(ends, [len(x) for x in out_from])
    at = lo[:, None] + np.arange(c.warm)
    head = np.where(at < series_end[:, None], v[np.minimum(at, n - 1)], np.nan)
    level = np.nanmedian(head, axis=1)
    # differences tell the scatter even where the level shifts inside the warm-up
    steps_seen = np.abs(np.diff(head, axis=1))
    steps_seen[np.isnan(steps_seen).all(axis=1), 0] = 0.0
    sc = np.maximum(np.nanmedian(steps_seen, axis=1) / 0.954, 1e-3)
    floor = np.maximum(sc * 0.25, 1e-3)
    prev, run = level.copy(), np.zeros(len(lo), int)
    for k in range(c.lane + c.warm):
        i = lo + k
        live = i < stop
        if not live.any():
            break
        x = v[np.minimum(i, n - 1)]
        e = x - level
        bad = (np.abs(e) > c.limit * sc) | (np.abs(x - prev) > np.minimum(1.5 * c.limit * sc, steps[np.minimum(i, n - 1)]))
        run = np.where(bad, run + 1, 0)
        new = run > c.accept_after
        clipped = np.clip(e, -c.clip * sc, c.clip * sc)
        told = live & (i >= begin)
        suspect[i[told]], scale[i[told]] = bad[told], sc[told]
        level = np.where(new, x, level + c.level_weight * clipped)
        sc = np.maximum(sc + c.scale_weight * (1.2533 * np.abs(clipped) - sc), floor)
        prev = np.where(bad & ~new, prev, x)
        run = np.where(new, 0, run)
    return suspect, scale


def run_chart(v: np.ndarray, starts: np.ndarray, steps: np.ndarray, c: Chart) -> tuple[np.ndarray, np.ndarray]:
    """Suspected flags and scale of every reading. ``starts``: first reading of each series in ``v``; ``steps``: by reading,
    a distance from the last accepted value that is suspicious at any scale (infinite where there is none).

    Series are cut in lanes that run side by side. A lane starts from the median and the median step of its first readings,
    clips suspected values before they move mean and scale, and after more than ``accept_after`` suspected values in a row
    takes the new level. A second chart runs through the series from its end, so that a value just behind a shift, which the
    first chart still measures from the level before, is measured from the level after; what either suspects is suspected.
    Series shorter than the warm-up are suspected as a whole: the chart knows nothing yet.
    """
    n = len(v)
    ends = np.append(starts[1:], n)
    suspect, scale = _one_way(v, starts, steps, c)
    back, _ = _one_way(v[::-1], (n - ends)[::-1], steps[::-1], c)
    short = np.repeat(ends - starts < c.warm, ends - starts)
    return suspect | back[::-1] | short, scale


def judge(f: np.ndarray, us: np.ndarray, v: np.ndarray, starts: np.ndarray, rules: list[FieldRule], c: Chart):
    """Spikes as (reading, value before, value after, gap), runs of one value as a mask, and the charts' scales.

    A spike is at most ``longest_spike`` suspected readings, each farther from the readings on both sides than those are
    from each other and than a low bar; the final threshold, which may need the whole station's scatter, comes later.
    """
    n = len(v)
    steps = np.array([np.inf if r.relative else 0.9 * r.spike for r in rules])[f] if n else np.zeros(0)
    suspect, scale = run_chart(v, starts, steps, c)
    series = np.zeros(n, int)
    series[starts[1:]] = 1
    series = np.cumsum(series)
    bar = np.zeros(len(starts))
    for s, (i, j) in enumerate(zip(starts, np.append(starts[1:], n))):
        r = rules[f[i]]
        bar[s] = (3 * np.nanquantile(scale[i:j], 0.25) if j - i >= c.warm else 0.0) if r.relative else 0.99 * r.spike
    bar = bar[series] if n else bar
    hits = []
    for r in range(1, c.longest_spike + 1):
        if n < r + 2:
            break
        i = np.arange(1, n - r)
        a, b = v[i - 1], v[i + r]
        ok = series[i - 1] == series[i + r]
        far = np.full(len(i), np.inf)
        for k in range(r):
            ok &= suspect[i + k]
            far = np.minimum(far, np.minimum(np.abs(v[i + k] - a), np.abs(v[i + k] - b)))
        ok &= (far > bar[i]) & (np.abs(a - b) < far)
        i = i[ok]
        gap = np.maximum(us[i] - us[i - 1], us[i + r] - us[i + r - 1])
        hits += [(i + k, v[i - 1], v[i + r], gap) for k in range(r)]
    hits = [np.concatenate(x) for x in zip(*hits)] if hits else [np.zeros(0, int), np.zeros(0), np.zeros(0), np.zeros(0, int)]
    new = np.ones(n, bool)
    new[1:] = (v[1:] != v[:-1]) | (series[1:] != series[:-1])
    run = np.cumsum(new) - 1
    stuck = np.bincount(run, minlength=1)[run] >= c.stuck_run if n else np.zeros(0, bool)
    above = np.array([-np.inf if r.stuck_above is None else r.stuck_above for r in rules])
    return hits, stuck & (v > above[f]) if n else stuck, scale


def _rows(kind: str, f, station, us, ids, v, **more) -> pa.RecordBatch:
    n = len(ids)
    cols = {"kind": pa.array([kind] * n, pa.string()), "f": pa.array(f, pa.int8()), "station": station, "us": pa.array(us, pa.int64()), "id": pa.array(ids, pa.int64()), "value": pa.array(v, pa.float64())}
    for field in _ARROW:
        if field.name not in cols:
            cols[field.name] = pa.array(more[field.name], field.type) if field.name in more else pa.nulls(n, field.type)
    return pa.RecordBatch.from_arrays([cols[x.name] for x in _ARROW], schema=_ARROW)


def _scan(rules: list[FieldRule], c: Chart, final: bool, again: bool = False):
    """Judge one partition sorted by (f, station, us, id). Unless the pass is the final one, the partition's outermost readings are
    left to the next pass, which gets ``edge`` readings from either end; ``hole`` marks a reading whose predecessor was not sent.
    ``again``: the rows are edges of an earlier pass."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)) if not isinstance(batches, pa.Table) else batches
        if not t.num_rows:
            return
        t = t.combine_chunks()
        f, us, ids, v = (t.column(x).to_numpy() for x in ("f", "us", "id", "value"))
        code = t.column("station").dictionary_encode().combine_chunks()
        code = code.chunk(0) if isinstance(code, pa.ChunkedArray) else code
        names, st = code.dictionary, code.indices.to_numpy(zero_copy_only=False)
        cut = np.ones(len(f), bool)
        cut[1:] = (f[1:] != f[:-1]) | (st[1:] != st[:-1])
        if again:
            cut |= t.column("hole").to_numpy(zero_copy_only=False).astype(bool)
        reading = np.ones(len(f), bool)
        reading[1:] = cut[1:] | (us[1:] != us[:-1])
        head = np.flatnonzero(reading)  # the smallest id speaks for its copies
        of = np.cumsum(reading) - 1
        rf, rus, rv, rcut = f[head], us[head], v[head], cut[head]
        n = len(head)
        inner = np.ones(n, bool)
        if not final:
            inner[[0, n - 1]] = False
        keep = np.flatnonzero(inner)
        wide, carried = np.zeros(n, bool), np.zeros(n, bool)
        if again:
            carried = t.column("hole").to_numpy(zero_copy_only=False).astype(bool)[head]
            w = t.column("wide").to_numpy(zero_copy_only=False).astype(bool)
            wide = np.bitwise_or.reduceat(w, head)
        last = np.append(head[1:], len(f))
        station = lambda rows: names.take(pa.array(st[rows]))

        def listed(kind, which, rd, **more):
            """Rows of every copy of the readings ``rd``; with ``which`` the positions in ``more``."""
            count = last[rd] - head[rd]
            rows = np.repeat(head[rd], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            each = np.repeat(np.arange(len(rd)), count)
            return _rows(kind, f[rows], station(rows), us[rows], ids[rows], v[rows], wide=np.repeat(wide[rd], count), **{k: x[each] for k, x in more.items()})

        if not final and not again:
            low, high = np.array([r.low for r in rules])[f], np.array([r.high for r in rules])[f]
            out = np.flatnonzero((v < low) | (v > high))
            if len(out):
                yield _rows("impossible", f[out], station(out), us[out], ids[out], v[out])
        if len(keep):
            starts_mask = rcut[keep].copy()
            starts_mask[0] = True
            starts = np.flatnonzero(starts_mask)
            (i, a, b, gap), stuck, scale = judge(rf[keep], rus[keep], rv[keep], starts, rules, c)
            if len(i):
                yield listed("spike", i, keep[i], a=a, b=b, gap_us=gap)
            if stuck.any():
                rd = keep[stuck]
                yield listed("stuck", rd, rd, a=rv[rd])
            if not final and not again:
                bins = np.round(8 * np.log2(np.maximum(scale, 1e-6)))
                for s, e in zip(starts, np.append(starts[1:], len(keep))):
                    x, cnt = np.unique(bins[s:e][np.isfinite(bins[s:e])], return_counts=True)
                    row = np.repeat(head[keep[s]], len(x))
                    yield _rows("scale", f[row], station(row), us[row], np.zeros(len(x), int), x, n=cnt)
        if final:
            return
        # edges: the first readings of the first series, the last of the last
        series = np.cumsum(rcut) - 1
        first_n, last_n = int((series == 0).sum()), int((series == series[-1]).sum())
        send = np.zeros(n, bool)
        send[: min(c.edge, first_n)] = True
        send[n - min(c.edge, last_n):] = True
        hole = np.zeros(n, bool)
        rd = np.flatnonzero(send)
        hole[rd[1:][np.diff(rd) > 1]] = True  # within the partition, readings before this one stay here
        if not (send[0] and rd[0] == 0):
            hole[rd[0]] = True
        count = np.minimum(last[rd] - head[rd], c.copies)
        rows = np.repeat(head[rd], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        each = np.repeat(rd, count)
        lead = np.zeros(len(rows), bool)
        lead[np.cumsum(count) - count] = True
        yield _rows("edge", f[rows], station(rows), us[rows], ids[rows], v[rows], hole=(hole | (rcut & carried))[each] & lead, wide=((last - head) > c.copies)[each] | wide[each])

    return scan


def flag_readings(readings: DataFrame, rules: list[FieldRule], cadence: DataFrame, chart: Chart = Chart(), target_rows: int = 200_000, rows_about: int | None = None) -> DataFrame:
    """Implausible rows of (field, station, ts_us, row_id, value): (field, row_id, reason, value), one row per row and reason.

    ``readings`` holds usable values only; ``cadence`` is (station, cadence_s) and is needed for rules with
    ``max_gap_periods``. Reasons: ``impossible`` (outside low..high), ``spike`` (one to three consecutive readings far from
    those on both sides, which agree) and ``stuck`` (at least twelve equal readings in a row). Rows with equal station and
    time are copies of one reading, for which the smallest id speaks; every copy that carries such a value is listed.
    ``rows_about``, such as a count from file footers, saves a pass that counts the rows; partitions hold ``target_rows`` of them.

    Rows are range-partitioned by (field, station, time, id), so a station, or a group of copies, of any size spreads over
    tasks; charts run within partitions, and partitions exchange their outermost readings (a bounded number each) for a
    second judgement across the borders. Where those edges are many, they are range-partitioned in turn, so no task sees all
    edges of a station. The usual scatter of a station is the median of its charts' scales, taken from
    histograms of all partitions. NULL fields and stations, and rows without time, are left out; an empty table gives none.
    """
    names = [r.name for r in rules]
    code = F.lit(None).cast("byte")
    for i, x in enumerate(names):
        code = F.when(F.col("field") == x, F.lit(i).cast("byte")).otherwise(code)
    rows = readings.select(code.alias("f"), "station", F.col("ts_us").alias("us"), F.col("row_id").alias("id"), "value").where(
        "f is not null and station is not null and us is not null and id is not null and value is not null")
    n = partitions_for(readings.count() if rows_about is None else rows_about, target_rows)
    order = ["f", "station", "us", "id"]
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    first = materialize(ranged.mapInArrow(_scan(rules, chart, False), OUT), "chart-pass")
    found = first.where("kind in ('spike', 'stuck')")
    edges, most = first.where("kind = 'edge'").select(*order, "value", "hole", "wide"), 2 * chart.edge * n
    per = max(target_rows, 16 * chart.edge)  # far more than a partition's edges, so every pass leaves fewer
    while most > per:
        n = partitions_for(most, per)
        step = materialize(edges.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_scan(rules, chart, False, True), OUT), "chart-edges")
        found = found.unionByName(step.where("kind in ('spike', 'stuck')"))
        edges, most = step.where("kind = 'edge'").select(*order, "value", "hole", "wide"), 2 * chart.edge * n
    by_series = edges.repartition("f", "station").sortWithinPartitions(*order)
    found = materialize(found.unionByName(by_series.mapInArrow(_scan(rules, chart, True, True), OUT)), "chart-found")

    scatter = first.where("kind = 'scale'").groupBy("f", "station", "value").agg(F.sum("n").alias("n")).groupBy("f", "station").agg(
        F.pow(F.lit(2.0), F.percentile("value", 0.5, F.col("n")) / 8).alias("scatter"))
    limit, gap_ok = F.lit(None).cast("double"), F.lit(True)
    for i, r in enumerate(rules):
        mine = F.col("f") == i
        limit = F.when(mine, F.lit(r.spike) * (F.col("scatter") if r.relative else F.lit(1.0))).otherwise(limit)
        if r.max_gap_periods is not None:
            near = F.col("gap_us") <= F.col("cadence_s").cast("long") * F.lit(r.max_gap_periods * 1_000_000)
            gap_ok = F.when(mine, F.coalesce(near, F.lit(False))).otherwise(gap_ok)
    far = F.least(F.abs(F.col("value") - F.col("a")), F.abs(F.col("value") - F.col("b")))
    is_spike = (far > F.col("limit")) & (F.abs(F.col("a") - F.col("b")) < F.col("limit"))

    def decided(rows: DataFrame) -> DataFrame:
        stuck = rows.where("kind = 'stuck' and value = a")
        spikes = rows.where("kind = 'spike'").join(scatter, ["f", "station"], "left").join(cadence, "station", "left")
        spikes = spikes.where(gap_ok).withColumn("limit", limit).where(is_spike)
        return stuck.select("f", "id", "kind", "value").unionByName(spikes.select("f", "id", "kind", "value"))

    result = decided(found)
    # copies of an edge reading beyond those exchanged: their readings' verdicts meet the rows again
    wide = found.where("wide").select("kind", "f", "station", "us", "a", "b", "gap_us").distinct()
    if not wide.isEmpty():
        result = result.unionByName(decided(rows.join(wide, ["f", "station", "us"])))
    result = result.unionByName(first.where("kind = 'impossible'").select("f", "id", "kind", "value"))
    name = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("f").cast("int") + 1)
    return result.select(name.alias("field"), F.col("id").alias("row_id"), F.col("kind").alias("reason"), "value").distinct()
