"""Quality gate over detection boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import pick, r6


def largest_boxes(detections: DataFrame, key: str = "item_id", order: str = "box_id") -> DataFrame:
    """Per item: number of boxes and the largest box; the first of equal areas wins."""
    box = F.struct("x", "y", "w", "h")
    area = F.col("w") * F.col("h")
    return (
        detections.groupBy(key)
        .agg(F.count(F.lit(1)).alias("box_count"), F.min_by(box, F.struct((-area).alias("a"), F.col(order).alias("o"))).alias("b"))
        .select(key, "box_count", "b.*")
    )


def box_area_ratio() -> Column:
    return (F.col("w") * F.col("h")) / (F.col("width") * F.col("height")).cast("double")


def box_center_offset() -> Column:
    """Larger of the two centre displacements, as a share of the image side."""
    dx = F.abs(F.col("x") + F.col("w") / 2.0 - F.col("width") / 2.0) / F.col("width")
    dy = F.abs(F.col("y") + F.col("h") / 2.0 - F.col("height") / 2.0) / F.col("height")
    return F.greatest(dx, dy)


def square_bounds(df: DataFrame) -> DataFrame:
    """Box grown by 25 % to a square, shifted into the image and then clamped: left, top, right, bottom."""
    longer = F.greatest("w", "h")
    side = longer + 2 * F.bround(longer * 0.25, 0).cast("bigint")  # half-even, as the reference rounds
    grown = df.withColumn("__side", side).withColumns(
        {
            "left": F.col("x") + F.floor(F.col("w") / 2) - F.floor(F.col("__side") / 2),
            "top": F.col("y") + F.floor(F.col("h") / 2) - F.floor(F.col("__side") / 2),
        }
    )
    grown = grown.withColumns({"right": F.col("left") + F.col("__side"), "bottom": F.col("top") + F.col("__side")})
    for low, high, limit in (("left", "right", "width"), ("top", "bottom", "height")):
        into = F.when(F.col(low) < 0, -F.col(low)).otherwise(0)
        grown = grown.withColumns({low: F.col(low) + into, high: F.col(high) + into})
        back = F.when(F.col(high) > F.col(limit), F.col(high) - F.col(limit)).otherwise(0)
        grown = grown.withColumns({low: F.col(low) - back, high: F.col(high) - back})
        grown = grown.withColumns(
            {low: F.greatest(F.lit(0), F.col(low)).cast("bigint"), high: F.least(F.col(limit), F.col(high)).cast("bigint")}
        )
    return grown.drop("__side")


def gate_reason(count: Column, ratio: Column, offset: Column) -> Column:
    """First failing reason of the gate, or the passing text (fixed values)."""
    return pick(
        (count != 1, "requires exactly one detected face"),
        (ratio.isNull() | (ratio < 0.08), "detected face is too small"),
        (ratio > 0.60, "detected face is too close or cropped"),
        (offset.isNull() | (offset > 0.24), "detected face is off center"),
        otherwise="single centered face",
    )


def review_quality(items: DataFrame, detections: DataFrame, key: str = "item_id") -> DataFrame:
    """Gate every item on its detections; items without any are kept and fail."""
    joined = items.join(largest_boxes(detections, key), key, "left").withColumn(
        "box_count", F.coalesce("box_count", F.lit(0))
    )
    measured = joined.withColumns({"area_ratio": box_area_ratio(), "center_offset": box_center_offset()})
    judged = measured.withColumn("reason", gate_reason(F.col("box_count"), F.col("area_ratio"), F.col("center_offset")))
    return judged.withColumn("qa_pass", F.col("reason") == "single centered face")


def gate_summary(reviews: DataFrame, by: list[str], passed: Column | str = "qa_pass") -> DataFrame:
    """Pass and fail counts and the pass rate; the rate is null without rows."""
    ok = F.coalesce(F.col(passed) if isinstance(passed, str) else passed, F.lit(False))
    counts = reviews.groupBy(*by).agg(F.count(F.lit(1)).alias("item_count"), F.count_if(ok).alias("pass_count"))
    return counts.withColumns(
        {
            "fail_count": F.col("item_count") - F.col("pass_count"),
            "pass_rate": r6(F.try_divide(F.col("pass_count").cast("double"), F.col("item_count"))),
        }
    )
