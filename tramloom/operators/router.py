"""Image statistics and the choice of preprocessing from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def luma_stats(c: Column) -> dict[str, Column]:
    """Statistics of an array of brightness values, in native array functions."""
    n = F.size(c)
    total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    mean = total / n
    spread = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x) / n - mean * mean)
    ordered = F.array_sort(c)

    def quantile(q: float) -> Column:
        at = (n - 1) * F.lit(q)
        low = F.floor(at).cast("int")
        a, b = F.element_at(ordered, low + 1), F.element_at(ordered, F.least(low + 2, n))
        return a + (b - a) * (at - low)

    near = F.size(F.filter(c, lambda x: (x < 25) | (x > 230))) / n
    return {"mean_luma": mean, "std_luma": spread, "p05": quantile(0.05), "p95": quantile(0.95), "near_binary_ratio": near}


def scale(short_side: Column, long_side: Column, target: int = 900, most: int = 1600) -> Column:
    """Resize factor: up to ``target`` on the short side, at most ``most`` on the long one, within 0.5 and 2.5."""
    up = F.when(short_side < target, F.lit(float(target)) / short_side).otherwise(1.0)
    return F.least(F.greatest(F.least(up, F.lit(float(most)) / long_side), F.lit(0.5)), F.lit(2.5))


def route(df: DataFrame) -> DataFrame:
    """``df`` (scale, mean_luma, std_luma, luma_range, laplacian, edge_density, noise, background, near_binary_ratio) with
    ``flags``, the steps to take, ``primary_variant`` and ``reason``."""
    c = F.col
    dark, bright = c("mean_luma") < 75, c("mean_luma") > 205
    low = (c("std_luma") < 38) | (c("luma_range") < 115)
    very_low = (c("std_luma") < 25) | (c("luma_range") < 80)
    blurry = (c("laplacian") < 70) & (c("edge_density") < 0.075)
    very_blurry = (c("laplacian") < 35) & (c("edge_density") < 0.045)
    noisy, very_noisy = c("noise") > 7.5, c("noise") > 13
    uneven, strong_uneven = c("background") > 18, c("background") > 28
    binary = c("near_binary_ratio") > 0.55
    checks = [(c("scale") > 1.10, "small_image_upscale"), (c("scale") < 0.90, "large_image_downscale"), (dark, "dark"), (bright, "bright"), (low, "low_contrast"), (very_low, "very_low_contrast"), (blurry, "blurry"), (very_blurry, "very_blurry"), (noisy, "noisy"), (very_noisy, "very_noisy"), (uneven, "uneven_background"), (strong_uneven, "strong_uneven_background"), (binary, "near_binary")]
    flags = F.filter(F.array(*[F.when(k, F.lit(n)) for k, n in checks]), lambda x: x.isNotNull())
    clahe = (low | dark | bright | uneven) & ~binary
    gaussian = very_noisy & ~very_blurry
    sharpen = (blurry | (c("scale") > 1.15) | clahe) & ~very_noisy
    out = df.withColumn("flags", flags).withColumn("use_clahe", clahe).withColumn("use_median", noisy).withColumn("use_gaussian", gaussian).withColumn("use_sharpen", sharpen)
    out = out.withColumn("use_hard_fallback", very_low | strong_uneven | binary | very_blurry).withColumn("threshold_mode", F.when(uneven, "adaptive").otherwise("otsu"))
    enhanced = clahe | noisy | gaussian | sharpen
    return out.withColumn("primary_variant", F.when(enhanced, "soft_enhanced").otherwise("raw_resized")).withColumn("reason", F.when(F.size("flags") > 0, F.array_join("flags", "+")).otherwise("clean_or_unknown"))
