"""Frame-pair features as array expressions, and index sampling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.functions.decide import clamp

# fixed values of the structural-similarity formula for 8-bit pixels
SSIM_C1 = (0.01 * 255) ** 2
SSIM_C2 = (0.03 * 255) ** 2
NOISE_FLOOR = 1e-8


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def moments(a: Column, b: Column) -> Column:
    """Means, population variances and covariance of two arrays, as one struct."""
    centred = F.struct(mean(a).alias("ma"), mean(b).alias("mb"))
    # a one-element transform gives the means a name, so that they are computed once
    return F.element_at(
        F.transform(
            F.array(centred),
            lambda m: F.struct(
                m["ma"].alias("ma"),
                m["mb"].alias("mb"),
                mean(F.transform(a, lambda x: (x - m["ma"]) * (x - m["ma"]))).alias("va"),
                mean(F.transform(b, lambda x: (x - m["mb"]) * (x - m["mb"]))).alias("vb"),
                mean(F.zip_with(a, b, lambda x, y: (x - m["ma"]) * (y - m["mb"]))).alias("cov"),
            ),
        ),
        1,
    )


def correlation_score(m: Column) -> Column:
    """Dot product of the two z-scored arrays, mapped to [0, 1]."""
    r = m["cov"] / ((F.sqrt(m["va"]) + NOISE_FLOOR) * (F.sqrt(m["vb"]) + NOISE_FLOOR))
    return clamp((r + 1) / 2)


def ssim_score(m: Column) -> Column:
    top = (2 * m["ma"] * m["mb"] + SSIM_C1) * (2 * m["cov"] + SSIM_C2)
    bottom = (m["ma"] * m["ma"] + m["mb"] * m["mb"] + SSIM_C1) * (m["va"] + m["vb"] + SSIM_C2)
    return clamp((top / (bottom + NOISE_FLOOR) + 1) / 2)


def pearson(m: Column) -> Column:
    """Correlation coefficient; 0 where one side is constant."""
    return F.coalesce(F.try_divide(m["cov"], F.sqrt(m["va"] * m["vb"])), F.lit(0.0))


def lip_sync_score(m: Column) -> Column:
    return clamp((pearson(m) + 1) / 2)


def pixel_difference(a: Column, b: Column) -> Column:
    return mean(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def mismatch_score(m: Column, difference: Column) -> Column:
    return clamp((1 - pearson(m)) * 50 + difference * 0.5, 0.0, 100.0)


def temporal_consistency(corr: Column, ssim: Column, edge: Column, hist: Column) -> Column:
    return clamp(corr * 0.3 + ssim * 0.3 + edge * 0.2 + hist * 0.2)


def sample_indices(total_rows: Column, k: int) -> Column:
    """k indices spread evenly from first to last; all of them when there are fewer; for k = 1 the first."""
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (total_rows - 1) / max(1, k - 1)).cast("int")
    )
    every = F.sequence(F.lit(0), (total_rows - 1).cast("int"))
    return (
        F.when(total_rows <= 0, F.array().cast("array<int>"))
        .when(total_rows < k, every)
        .otherwise(spread)
    )


# fixed values: capture strategy by clip length in seconds (limit, step, most frames)
CAPTURE_STRATEGIES = {"short": (30, 3, 10), "medium": (300, 10, 15), "long": (None, 30, 12)}


def capture_plan(duration: Column) -> Column:
    """Sorted distinct capture times for a clip; the middle jitter of long clips is zero."""
    plan = None
    for limit, step, most in CAPTURE_STRATEGIES.values():
        # steps strictly before duration - 1, at most `most` - 2 of them after the first capture
        last = F.least(F.ceil((duration - 1) / step) - 1, F.lit(most - 2)).cast("int")
        steps = F.when(
            last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: (i * step).cast("double"))
        ).otherwise(F.array().cast("array<double>"))
        times = F.concat(F.array(F.lit(0.5)), steps)
        none = F.array().cast("array<double>")
        room = F.size(times) < most
        near_end = F.when((duration > 30) & room, F.array((duration - 2).cast("double"))).otherwise(none)
        times2 = F.concat(times, near_end)
        middle = F.when(
            (duration > 300) & (F.size(times2) < most), F.array((duration / 2).cast("double"))
        ).otherwise(none)
        points = F.slice(F.array_sort(F.array_distinct(F.concat(times2, middle))), 1, most)
        if limit is None:
            return plan.otherwise(points)
        plan = (plan if plan is not None else F).when(
            duration <= limit, points
        )
    return plan
