"""Column expressions for measured quality, gates and the multi-factor score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sizewise.dims import PHOTO_PROBE_SSIM

# Gates and tolerances.
PERCEPTUAL_FLOOR_SSIM = 0.55
SEARCH_FLOOR_SSIM = 0.85
GREY_ZONE_SSIM = (0.85, 0.95)
SEARCH_PERCEPTUAL_LIMIT = 3.0
QUALITY_TOLERANCE = 1e-6
PERCEPTUAL_TOLERANCE = 1e-9
DOMINANCE_EPSILON = 2.220446049250313e-16

# Estimated quality by lower bound of the quality parameter, highest band first.
ESTIMATED_QUALITY = {
    "AVIF photo": [(90, 0.93), (80, 0.85), (70, 0.78), (60, 0.72), (50, 0.71), (40, 0.70), (30, 0.68), (0, 0.62)],
    "AVIF other": [(90, 0.99), (80, 0.99), (70, 0.98), (60, 0.98), (50, 0.97), (40, 0.95), (30, 0.90), (0, 0.75)],
    "WEBP": [(90, 0.95), (80, 0.92), (70, 0.88), (60, 0.84), (0, 0.78)],
    "JPEG": [(95, 0.96), (85, 0.92), (75, 0.88), (65, 0.84), (0, 0.78)],
}
ESTIMATED_QUALITY_OTHER = 0.85
ASSUMED_QUALITY = 75


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def percentage_saved(original: Column, output: Column) -> Column:
    """Signed saving in percent, 0 when the original is empty."""
    saved = (original - output).cast("double")
    return F.coalesce(F.try_divide(F.lit(100.0) * saved, original.cast("double")), F.lit(0.0))


def result_metrics(original: Column, output: Column, elapsed_ms: Column) -> dict[str, Column]:
    """Derived size and speed measures, all guarded against zero."""
    return {
        "bytes_saved": F.greatest(original - output, F.lit(0)).cast("long"),
        "percentage_saved": percentage_saved(original, output),
        "compression_ratio": F.when(original == 0, F.lit(1.0)).otherwise(
            output.cast("double") / original.cast("double")
        ),
        "throughput_mbps": F.when(elapsed_ms == 0, F.lit(0.0)).otherwise(
            (original / F.lit(1048576.0)) / (elapsed_ms / F.lit(1000.0))
        ),
    }


def perceptual_factor(perceptual: Column) -> Column:
    """Nudge of the quality by the perceptual measure, when there is one."""
    return F.when(perceptual > 1.5, 0.9).when(perceptual < 0.5, 1.05).otherwise(1.0)


def search_quality(ssim: Column, factor: Column) -> Column:
    """Quality of a candidate found by the quality search: SSIM in [0, 1] and the factor, no PSNR."""
    return F.when(F.isnan(ssim), F.lit(0.0)).otherwise(F.least(ssim * factor, F.lit(1.0)))


def normalized_quality(ssim: Column, psnr: Column, factor: Column) -> Column:
    """SSIM in [0, 1] blended with PSNR, times the perceptual factor."""
    share = F.when(F.isnan(psnr), F.lit(float("nan"))).otherwise(clamp((psnr - 20.0) / 30.0, 0.0, 1.0))
    return search_quality(ssim * (F.lit(0.85) + F.lit(0.15) * share), factor)


def photo_sensitive(probe_ssim: Column, photo_like: Column) -> Column:
    """The measured probe decides; the category is only the fallback."""
    return F.coalesce(probe_ssim < PHOTO_PROBE_SSIM, photo_like)


def _curve(bands: list[tuple[int, float]]) -> list[float]:
    """One value per five quality points, 0 to 100."""
    return [next(value for lower, value in bands if q >= lower) for q in range(0, 101, 5)]


def estimated_quality(fmt: Column, quality: Column, sensitive: Column) -> Column:
    """Conservative quality for an unmeasured lossy output.

    A lookup in one literal array instead of nested conditions keeps the generated code small enough to be
    compiled.
    """
    curves = [_curve(bands) for bands in ESTIMATED_QUALITY.values()]
    flat = F.array(*[F.lit(v) for curve in curves for v in curve])
    row = (
        F.when(fmt == "AVIF", F.when(sensitive, 0).otherwise(1)).when(fmt == "WEBP", 2).when(fmt == "JPEG", 3)
    )
    step = F.floor(F.coalesce(quality, F.lit(ASSUMED_QUALITY)) / 5).cast("int")
    return F.coalesce(F.get(flat, row * len(curves[0]) + step), F.lit(ESTIMATED_QUALITY_OTHER))


def format_preference(fmt: Column, preferred: Column) -> Column:
    """1 for the first preferred format down to 1/n for the last, 0 when absent."""
    position = F.array_position(preferred, fmt)
    n = F.size(preferred)
    return F.when(position > 0, (n - position + 1) / n).otherwise(F.lit(0.0))


def compression_score(saved_ratio: Column) -> Column:
    """Logarithmic reward for savings; a linear remainder, scaled down, when nothing was saved (ratio >= -0.5)."""
    return F.when(saved_ratio <= 0, (1.0 + saved_ratio) * 0.3).otherwise(
        F.log10(saved_ratio * 9.0 + 1.0)
    )


def speed_score(estimated_cost_ms: Column) -> Column:
    return F.when(estimated_cost_ms > 0, F.greatest(1.0 - estimated_cost_ms / 5000.0, F.lit(0.0))).otherwise(F.lit(1.0))


def marginal_saving_penalty(saved: Column, is_lossless: Column) -> Column:
    """Factor below 1 for lossy outputs that save under 20 %. ``saved`` is the unclamped ratio."""
    return (
        F.when(is_lossless | (saved >= 0.20), F.lit(1.0))
        .when(saved < 0.10, F.greatest(F.lit(0.5) + saved * 5.0, F.lit(0.5)))
        .otherwise(F.lit(0.7) + (saved - 0.10) * 3.0)
    )


def final_score(quality: Column, saved_percent: Column, cost_ms: Column, is_lossless: Column) -> Column:
    """Weighted score over a row that carries the terms of its goal (``goal_terms``)."""
    ratio = F.greatest(saved_percent / 100.0, F.lit(-0.5))  # a saving is never above 100 %
    weighted = (
        quality * F.col("wq") + compression_score(ratio) * F.col("wc") + speed_score(cost_ms) * F.col("ws")
    ) / F.col("wsum")
    bonus = F.greatest(ratio - 0.80, F.lit(0.0))  # from 0 at 80 % saved to 0.20 at 100 %
    raw = F.least(weighted + F.col("preference") + bonus, F.lit(1.2))  # all terms are at least 0
    return raw * marginal_saving_penalty(saved_percent / 100.0, is_lossless)


def valid_weights() -> Column:
    """Weights must be finite and not negative, the threshold within [0, 1]."""
    def usable(name: str) -> Column:
        c = F.col(name)
        return c.isNotNull() & ~F.isnan(c) & (c >= 0.0) & (c < float("inf"))

    threshold = F.col("min_quality_threshold")
    return (
        usable("quality_weight")
        & usable("compression_weight")
        & usable("speed_weight")
        & usable("min_quality_threshold")
        & (threshold <= 1.0)
    )


def needs_perceptual_metric(is_lossless: Column, ssim: Column, perceptual: Column, perceptual_gate: Column) -> Column:
    """Rows worth the expensive metric: the grey zone of SSIM, or every lossy row under the perceptual gate."""
    grey = ssim.between(*GREY_ZONE_SSIM) & perceptual.isNull()
    return ~is_lossless & ssim.isNotNull() & (perceptual_gate | grey)
