"""Whether spans of a page can be seen: colour arithmetic on columns. spans: (color, alpha, size, char_flags, bg_r, bg_g, bg_b)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def channel(color: Column, shift: int) -> Column:
    return F.shiftright(F.coalesce(color, F.lit(0)), shift).bitwiseAND(F.lit(255))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of an sRGB colour."""
    linear = lambda c: F.when(c / 255.0 <= 0.04045, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def contrast(first: Column, second: Column) -> Column:
    return (F.greatest(first, second) + 0.05) / (F.least(first, second) + 0.05)


def concealed(spans: DataFrame) -> DataFrame:
    """The spans with their contrast and the reasons why they can't be seen."""
    fore = luminance(channel(F.col("color"), 16), channel(F.col("color"), 8), channel(F.col("color"), 0))
    back = luminance(*[F.coalesce(c, F.lit(255)) for c in ("bg_r", "bg_g", "bg_b")])
    ratio = contrast(fore, back)
    reasons = F.array_compact(F.array(
        F.when(F.coalesce("alpha", F.lit(255)) <= 32, F.lit("transparent")), F.when(ratio < 1.4, F.lit("low-contrast")), F.when(F.col("size") < 0.75, F.lit("sub-pixel")),
        F.when(F.col("char_flags").bitwiseAND(F.lit(24)) == 0, F.lit("non-rendering")),
    ))
    return spans.withColumn("contrast", ratio).withColumn("reasons", F.array_join(reasons, ","))


def page_background(pixels: DataFrame) -> DataFrame:
    """(page, bg_r, bg_g, bg_b): the median colour of a page. pixels: (page, r, g, b)."""
    return pixels.groupBy("page").agg(*[F.floor(F.median(c)).cast("int").alias(f"bg_{c}") for c in "rgb"])
