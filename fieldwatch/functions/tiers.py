"""Activity tiers, level ladders and cross-check labels (fixed values of the published thresholds)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldwatch.functions.values import known

LABELS = ["quiet", "unsettled", "active", "minor_storm", "major_storm", "severe_storm"]
THRESHOLDS = (20.0, 30.0, 100.0, 400.0, 800.0)  # nT of rolling amplitude
JUMP_NT = 100.0
PLAUSIBLE_NT = 3000.0


def tier_code(amplitude: Column, thresholds=THRESHOLDS) -> Column:
    """Ordinal 0..5 of an amplitude (strictly above each threshold); NULL for NULL."""
    out = F.when(amplitude.isNull(), F.lit(None).cast("int"))
    for i in range(len(thresholds), 0, -1):
        out = out.when(amplitude > thresholds[i - 1], i)
    return out.otherwise(0)


def flag(residual: Column, amplitude: Column, spike: Column) -> Column:
    """Label of a sample: tier, ``anomaly`` for one-sample spikes, ``invalid`` for missing or implausible values, last."""
    labels = F.array(*[F.lit(x) for x in LABELS])
    return (F.when(residual.isNull() | known(F.abs(residual) > PLAUSIBLE_NT), "invalid").when(known(spike), "anomaly")
            .otherwise(F.element_at(labels, tier_code(amplitude) + 1)))


def spike(diff: Column, rebound: Column) -> Column:
    """A jump and its reversal, both beyond the limit; NULL counts as none."""
    return known((F.abs(diff) > JUMP_NT) & (F.abs(rebound) > JUMP_NT) & (F.signum(rebound) != F.signum(diff)))


def global_level(kp: Column, dst: Column) -> Column:
    """Level 0..4 from Kp and Dst, the larger of the known ones."""
    k = F.when(kp.isNull(), F.lit(None).cast("int")).when(kp <= 2, 0).when(kp <= 4, 1).when(kp < 6, 2).when(kp < 8, 3).otherwise(4)
    d = F.when(dst.isNull(), F.lit(None).cast("int")).when(dst >= -10, 0).when(dst >= -30, 1).when(dst >= -50, 2).when(dst >= -100, 3).otherwise(4)
    return F.greatest(k, d)


def local_level(label: Column) -> Column:
    """Level 0..4 of a label; NULL for invalid and anomaly."""
    return F.when(label == "quiet", 0).when(label == "unsettled", 1).when(label == "active", 2).when(label == "minor_storm", 3).when(label.isin("major_storm", "severe_storm"), 4)


def cross_check(label: Column, kp: Column, dst: Column) -> Column:
    """Agreement of a label with the planetary indices; later rules win, unknown comparisons are false."""
    main = known(dst < -50) | known(kp >= 6)
    active = known(dst < -30) | known(kp >= 4)
    return (F.when(label.isin("major_storm", "severe_storm") & ~active & ~main, "unconfirmed_storm")
            .when((label == "quiet") & ~main & active, "under_reacting").when((label == "quiet") & main, "missed_global_event").otherwise("ok"))


def cross_check_live(label: Column, kp: Column, dst: Column) -> Column:
    """The live form of ``cross_check``: a lower bar for Kp, unsettled samples under-react too, earlier rules win."""
    main = known(dst < -50) | known(kp >= 5)
    active = known(dst < -30) | known(kp >= 4)
    return (F.when((label == "quiet") & main, "missed_global_event").when(label.isin("quiet", "unsettled") & active, "under_reacting")
            .when(label.isin("major_storm", "severe_storm") & ~active, "unconfirmed_storm").otherwise("ok"))
