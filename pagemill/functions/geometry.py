"""Column expressions over sizes, angles and scores: target sizes, orientation choices, routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _int(x: Column) -> Column:
    return x.cast("bigint")


def resize_dims(h: Column, w: Column, longest: int = 1536) -> tuple[Column, Column]:
    """Never larger; sides shrink together and keep a pixel at least."""
    most = F.greatest(h, w)
    scale = F.lit(float(longest)) / most
    one = lambda x: F.when(most <= longest, _int(x)).otherwise(F.greatest(F.lit(1), _int(x * scale)))
    return one(h), one(w)


def ocr_dims(h: Column, w: Column, low: int = 800, high: int = 4000) -> tuple[Column, Column]:
    """The height moves into [low, high] and the width follows."""
    to = F.when(h < low, low).when(h > high, high)
    return _int(F.coalesce(to, h)), F.when(to.isNull(), _int(w)).otherwise(_int(w * (to.cast("double") / h)))


def analysis_dims(h: Column, w: Column, longest: int = 1500) -> tuple[Column, Column]:
    most = F.greatest(h, w)
    scale = F.lit(float(longest)) / most
    one = lambda x: F.when(most <= longest, _int(x)).otherwise(_int(x * scale))
    return one(h), one(w)


def canvas_dims(h: Column, w: Column, cos: Column, sin: Column) -> tuple[Column, Column]:
    """The canvas that holds all of a rotated image, from the absolute cosine and sine."""
    return _int(h * cos + w * sin), _int(h * sin + w * cos)


def aspect_score(h: Column, w: Column) -> Column:
    ratio = h / w
    return F.when(ratio > 1.1, 1.0).when(ratio < 0.9, 0.0).otherwise(0.5)


def aspect_confidence(h: Column, w: Column) -> Column:
    """How likely a page lies on its side, by its shape; 0 means not at all."""
    ratio = h / w
    return F.when(ratio < 0.85, F.least((F.lit(0.85) - ratio) * 2, F.lit(1.0))).otherwise(0.0)


def total_score(top_heavy: Column, variance: Column, header: Column, aspect: Column, weights: tuple[float, ...] = (0.35, 0.25, 0.15, 0.25)) -> Column:
    a, b, c, d = weights
    return top_heavy * a + variance * b + header * c + aspect * d


def choose_quarter_turn(cw: Column, ccw: Column, original: Column, angle: Column, aspect: Column, aggressive: bool, fallback: bool = True, min_diff: float = 0.15) -> tuple[Column, Column]:
    """(angle, confidence) from the scores of both quarter turns and of the image as it is."""
    diff = F.abs(cw - ccw)
    better = F.when(cw > ccw, 90).otherwise(-90)
    improved = F.greatest(cw, ccw) - original > 0.05
    sure = F.lit(aggressive) & F.abs(angle).between(85, 95)
    shape = F.lit(fallback) & (aspect > 0.5)
    towards = F.when(angle < 0, F.when(ccw >= cw, -90).otherwise(90)).otherwise(F.when(cw >= ccw, 90).otherwise(-90))
    agrees = F.when(angle < 0, ccw >= cw).otherwise(cw >= ccw)
    turn = F.when(improved, better).when(sure, towards).when(shape, better).when(diff < min_diff, 0).otherwise(better)
    confidence = (
        F.when(improved, F.least(diff + 0.3, F.lit(1.0)))
        .when(sure, F.when(agrees, 0.7).otherwise(0.6))
        .when(shape, aspect)
        .when(diff < min_diff, 0.5)
        .otherwise(F.least(diff, F.lit(1.0)))
    )
    return turn, confidence


def detect_rotation(angle: Column, cw: Column, ccw: Column, original: Column, aspect: Column, aggressive: bool = False, fallback: bool = True, min_diff: float = 0.15, tolerance: float = 5) -> Column:
    """The whole decision as a struct; angle is null where no line was found."""
    none = angle.isNull()
    turn, sure = choose_quarter_turn(cw, ccw, original, F.coalesce(angle, F.lit(90.0)), aspect, aggressive, fallback, min_diff)
    size = F.abs(angle)
    sideways = F.when(none, F.lit(fallback) & (aspect > 0)).otherwise((size >= tolerance) & (size <= 180 - tolerance) & size.between(85, 95))
    flipped = ~none & (size > 180 - tolerance) & (size >= tolerance)
    to = F.when(sideways, turn).when(flipped, 180).otherwise(0)
    return F.struct(
        to.cast("int").alias("angle"),
        F.when(sideways, sure).otherwise(1.0).cast("double").alias("confidence"),
        F.coalesce(angle, F.lit(0.0)).cast("double").alias("original_angle"),
        (to != 0).alias("applied_rotation"),
    )


def route(score: Column, issues: Column, reflect_iteration: Column, max_cycles: int = 2) -> Column:
    """Where the loop goes from the critic; what the model says of a revision doesn't count."""
    again = (score < 9) & (F.size(issues) > 0) & (reflect_iteration < max_cycles)
    return F.when(F.coalesce(again, F.lit(False)), "refine").otherwise("complete")
