"""Latch with hysteresis as a composition of block transfer functions, evidence of activity, events and their matching."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwatch.functions.values import known
from fieldwatch.operators.blocks import sessions
from fieldwatch.session import materialize


def _steps(on: int, off: int) -> np.ndarray:
    """Next state by (kind of sample, state). States 0..on-1: released, with so many samples of evidence; from ``on``: latched, with so many of
    release. Kinds: 0 invalid, else 1 + (evidence to set) + 2 * (evidence to release)."""
    table = np.zeros((5, on + off), np.int64)
    for kind in range(1, 5):
        sets, frees = (kind - 1) % 2, (kind - 1) // 2
        for s in range(on + off):
            table[kind, s] = (s + 1 if sets else 0) if s < on else (s + 1 if s + 1 < on + off else 0) if frees else on
    return table


def _kinds(part: pd.DataFrame, cols: list[str]) -> np.ndarray:
    o, f, v = (part[c].to_numpy(bool) for c in cols)
    return np.where(v, 1 + o + 2 * f, 0)


def _runs(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First sample and length of every run of samples of one kind: states settle within on + off samples of a run."""
    first = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]])) if len(kinds) else np.zeros(0, int)
    return first, np.diff(np.append(first, len(kinds)))


@dataclass(frozen=True)
class LatchRule:
    """Columns of evidence and how many consecutive samples of it set and release a latch."""

    on: str
    off: str
    valid: str
    min_on: int
    min_off: int


def latch(df: DataFrame, key: str, pos: str, rules: dict[str, LatchRule], size: int = 4096) -> DataFrame:
    """Add a column per rule: TRUE from the ``min_on``-th consecutive sample of ``on`` evidence until the ``min_off``-th of
    ``off``; an invalid sample releases at once. NULL evidence counts as FALSE. Rows need distinct positions per key.

    A latch has min_on + min_off states, so a block of samples is a map from states to states. Blocks are mapped in
    parallel, the maps are composed per key (one row a block), and a second pass replays each block from its true
    first state: no key has to fit in one task. The input is written once, as both passes read it.
    """
    specs = [(o, max(1, r.min_on), max(1, r.min_off)) for o, r in rules.items()]
    bits = [known(F.col(c)).alias(f"_{i}{n}") for i, r in enumerate(rules.values()) for n, c in (("o", r.on), ("f", r.off), ("v", r.valid))]
    whole = materialize(df.select("*", F.floor(F.col(pos) / size).cast("long").alias("_block"), *bits), "latch")
    names = [[f"_{i}{n}" for n in "ofv"] for i in range(len(specs))]
    kept = list(df.columns)
    maps = T.StructType([whole.schema[key], T.StructField("_block", T.LongType()), T.StructField("_maps", T.ArrayType(T.ArrayType(T.IntegerType())))])
    entry = T.StructType([whole.schema[key], T.StructField("_block", T.LongType()), T.StructField("_entry", T.ArrayType(T.IntegerType()))])

    tables = [_steps(on, off) for _, on, off in specs]

    def transfer(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(pos)
        ends = []
        for cols, steps, (_, on, off) in zip(names, tables, specs):
            kinds = _kinds(part, cols)
            state = np.arange(on + off)
            for at, n in zip(*_runs(kinds)):
                row = steps[kinds[at]]
                for _ in range(n):
                    new = row[state]
                    if (new == state).all():
                        break  # nothing more changes in this run
                    state = new
            ends.append(state.tolist())
        return pd.DataFrame({key: part[key].iloc[:1], "_block": part["_block"].iloc[:1], "_maps": [ends]})

    def compose(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("_block")
        state, entries = [0] * len(specs), []
        for m in blocks["_maps"]:
            entries.append(state)
            state = [int(x[s]) for x, s in zip(m, state)]
        return pd.DataFrame({key: blocks[key], "_block": blocks["_block"], "_entry": entries})

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(pos)
        out = part[kept].copy()
        for cols, steps, (name, on, off), s in zip(names, tables, specs, part["_entry"].iloc[0]):
            kinds, state = _kinds(part, cols), int(s)
            seen = np.zeros(len(part), bool)
            for at, n in zip(*_runs(kinds)):
                row = steps[kinds[at]]
                for k in range(n):
                    new = int(row[state])
                    if new == state:
                        seen[at + k: at + n] = state >= on  # nothing more changes in this run
                        break
                    state = new
                    seen[at + k] = state >= on
            out[name] = seen
        return out

    slim = whole.select(key, pos, "_block", *[c for cols in names for c in cols])
    entries = slim.groupBy(key, "_block").applyInPandas(transfer, maps).groupBy(key).applyInPandas(compose, entry)
    final = T.StructType([*df.schema.fields, *[T.StructField(o, T.BooleanType()) for o, _, _ in specs]])
    return whole.join(entries, [key, "_block"]).groupBy(key, "_block").applyInPandas(run, final)


@dataclass(frozen=True)
class Trigger:
    """Evidence of a tier: a statistic of at least ``multiple`` levels while the 15-minute median has at least ``medium`` of them."""

    statistic: str
    multiple: float
    medium: float = 0.0


@dataclass(frozen=True)
class Tier:
    """One tier of the causal detector: its level in nT, what sets it, the share of the level at which the median releases it, and
    for how many minutes evidence must last to set and to release it."""

    name: str
    level: float
    triggers: tuple[Trigger, ...]
    release: float
    on_min: float
    off_min: float


def _tier(name: str, level: float, release: float, on_min: float, off_min: float, *rows: tuple) -> Tier:
    return Tier(name, level, tuple(Trigger(*r) for r in rows), release, on_min, off_min)


@dataclass(frozen=True)
class Profile:
    """The causal detector's tiers (fixed values) and the level from which calm samples count as unsettled."""

    unsettled: float = 10.0
    tiers: tuple[Tier, ...] = (
        _tier("active", 15.0, 0.60, 5, 30, ("medium", 1.0), ("slow", 0.65, 0.40), ("slow3", 0.55, 0.40), ("upper", 1.0, 0.35), ("fast", 1.25, 0.40), ("peak", 1.8, 0.25)),
        _tier("storm", 35.0, 0.65, 10, 180, ("medium", 1.0), ("slow", 1.0, 0.80), ("slow3", 1.0, 0.80), ("fast", 1.8, 0.55), ("peak", 1.7, 0.20), ("upper", 1.1, 0.70)),
        _tier("major", 100.0, 0.75, 10, 30, ("medium", 1.0), ("upper", 0.90, 0.80), ("peak", 1.15, 0.80)),
        _tier("severe", 200.0, 0.75, 10, 30, ("medium", 1.0), ("upper", 0.90, 0.80), ("peak", 1.10, 0.80)),
    )

    def problems(self) -> list[str]:
        """Everything inconsistent in the profile."""
        out = []
        levels = [self.unsettled, *[t.level for t in self.tiers]]
        if levels != sorted(set(levels)) or levels[0] <= 0:
            out.append("levels have to rise from tier to tier, the first above 0")
        for t in self.tiers:
            if not t.triggers:
                out.append(f"{t.name} has no trigger")
            if not 0 < t.release < 1:
                out.append(f"{t.name}: release must lie between 0 and 1")
            if t.on_min <= 0 or t.off_min <= 0:
                out.append(f"{t.name}: evidence must last some minutes")
            out += [f"{t.name}: {x.statistic} is no statistic of the detector" for x in t.triggers if x.statistic not in STATISTICS]
            out += [f"{t.name}: multiples of {x.statistic} must not be negative" for x in t.triggers if x.multiple <= 0 or x.medium < 0]
        return out

    @classmethod
    def load(cls, settings: dict) -> Profile:
        """A profile from nested settings {unsettled, tiers: {name: {level, release, on_min, off_min, triggers: [[statistic, multiple,
        medium], ...]}}}; what is left out keeps its default. Unknown names and inconsistent values are an error."""
        base = cls()
        strange = [*(settings.keys() - {"unsettled", "tiers"}), *(settings.get("tiers", {}).keys() - {t.name for t in base.tiers})]
        tiers = []
        for t in base.tiers:
            own = dict(settings.get("tiers", {}).get(t.name, {}))
            strange += own.keys() - {"level", "release", "on_min", "off_min", "triggers"}
            if "triggers" in own:
                own["triggers"] = tuple(Trigger(*x) for x in own["triggers"])
            tiers.append(replace(t, **{k: v for k, v in own.items() if hasattr(t, k)}))
        if strange:
            raise ValueError(f"unknown names in the profile: {sorted(strange)}")
        made = cls(float(settings.get("unsettled", base.unsettled)), tuple(tiers))
        if bad := made.problems():
            raise ValueError("; ".join(bad))
        return made


STATISTICS = ("fast", "medium", "upper", "slow", "slow3", "peak")


def evidence(ready: Column, profile: Profile = Profile()) -> dict[str, Column]:
    """Columns ``<tier>_on`` and ``<tier>_off`` over the statistics, which count as 0 where unknown."""
    at = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in STATISTICS}
    out = {}
    for t in profile.tiers:
        seen = F.lit(False)
        for x in t.triggers:
            seen = seen | ((at[x.statistic] >= x.multiple * t.level) & (at["medium"] >= x.medium * t.level))
        out |= {f"{t.name}_on": ready & seen, f"{t.name}_off": ready & (at["medium"] <= t.release * t.level)}
    return out


def bool_events(df: DataFrame, key: str, pos: str, mask: str, merge: int, least: int, step: int = 1) -> DataFrame:
    """Events of a mask: (key, first, last, samples). TRUE samples at most ``merge`` positions of FALSE apart are one event
    (inclusive); events shorter than ``least`` positions, both ends included, are dropped."""
    runs = sessions(df.where(known(F.col(mask))).select(key, F.col(pos).alias("_pos")), [key], "_pos", merge + step)
    return runs.groupBy(key, "session").agg(F.min("_pos").alias("first"), F.max("_pos").alias("last"), F.count(F.lit(1)).alias("samples")).where(
        F.col("last") - F.col("first") + step >= least).drop("session")


def match_events(reference: DataFrame, predicted: DataFrame, key: str, cell: int = 144, rounds: int = 3) -> DataFrame:
    """Per key the counts reference, predicted, matched, missed, false_positive of events (key, first, last).

    One-to-one rule, in rounds: a reference event without partner takes the first predicted event without partner that overlaps it, and of
    several reference events that take the same one the first keeps it; the others try again in the next of ``rounds`` rounds.
    Overlaps are looked up in cells of positions.
    """
    def cells(e: DataFrame, name: str) -> DataFrame:
        return e.select(key, F.col("first").alias(f"{name}_first"), F.col("last").alias(f"{name}_last"),
                        F.explode(F.sequence(F.floor(F.col("first") / cell), F.floor(F.col("last") / cell))).alias("cell"))

    pairs = cells(reference, "r").join(cells(predicted, "p"), [key, "cell"]).where("r_first <= p_last and p_first <= r_last").select(key, F.col("r_first").alias("r"), F.col("p_first").alias("p")).distinct()
    left = pairs = materialize(pairs, "overlaps")
    taken = None
    for _ in range(rounds):
        won = left.groupBy(key, "r").agg(F.min("p").alias("p")).groupBy(key, "p").agg(F.min("r").alias("r")).select(key, "r", "p")
        taken = materialize(won if taken is None else taken.unionByName(won), "matched")
        left = pairs.join(taken.select(key, "r"), [key, "r"], "left_anti").join(taken.select(key, "p"), [key, "p"], "left_anti")
    n_ref, n_pred, n_hit = (e.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for e, n in ((reference, "reference"), (predicted, "predicted"), (taken, "matched")))
    both = n_ref.join(n_pred, key, "full").join(n_hit, key, "left").na.fill(0, ["reference", "predicted", "matched"])
    return both.withColumn("missed", F.col("reference") - F.col("matched")).withColumn("false_positive", F.col("predicted") - F.col("matched"))


def event_totals(matches: DataFrame) -> DataFrame:
    """One row: the counts of all keys summed, then precision, recall and F1, NULL where undefined."""
    s = matches.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("reference", "predicted", "matched", "missed", "false_positive")])
    p, r = F.try_divide(F.col("matched").cast("double"), F.col("predicted")), F.try_divide(F.col("matched").cast("double"), F.col("reference"))
    return s.select("*", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))
