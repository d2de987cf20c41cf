"""Image operators in relational form, over pixels as rows (img, y, x, v), so that an SQL engine can check them.

Whole collections of images go through one plan: every step groups or windows by img, partial sums are made before each
shuffle, and only profiles (a row for each line of an image) go through windows. The fused stage in operators.stage does
the same per image in NumPy, without taking pixels through a shuffle; that is the way for large rasters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..shared import stored


def _of_image(many: DataFrame, one: DataFrame, how: str = "inner") -> DataFrame:
    """Adds what has a row for each image. Spark can't tell how many rows pixels and profiles are, as they come out of explode,
    and would send them to the driver as the smaller side; so it is told to hash the other side, partition by partition."""
    return many.join(one.hint("shuffle_hash"), "img", how)


def gray(b: Column, g: Column, r: Column) -> Column:
    """Fixed-point luma, a whole number."""
    return F.shiftright(b * 1868 + g * 9617 + r * 4899 + 8192, 14)


def histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("img", "v").agg(F.count("*").alias("n"))


def otsu(pixels: DataFrame) -> DataFrame:
    """img and threshold: most variance between classes, the least value of equals; 0 where there is one value only."""
    upto = Window.partitionBy("img").orderBy("v")
    every = Window.partitionBy("img")
    h = histogram(pixels).select(
        "img",
        "v",
        F.sum("n").over(upto).cast("double").alias("q"),
        F.sum(F.col("n") * F.col("v")).over(upto).cast("double").alias("c"),
        F.sum("n").over(every).cast("double").alias("total"),
        F.sum(F.col("n") * F.col("v")).over(every).cast("double").alias("s"),
    )
    d = F.col("s") * F.col("q") - F.col("total") * F.col("c")
    spread = F.when(F.col("q") < F.col("total"), d * d / (F.col("q") * (F.col("total") - F.col("q"))))
    best = F.max(F.when(spread > 0, F.struct(spread.alias("spread"), (-F.col("v")).alias("less"))))
    return h.groupBy("img").agg(F.coalesce(-best["less"], F.lit(0)).cast("int").alias("threshold"))


def ink(pixels: DataFrame) -> DataFrame:
    """The pixels with ink: gray at most the threshold of their image."""
    return _of_image(pixels, otsu(pixels)).where("v <= threshold").drop("threshold")


def _filled(counted: DataFrame, dims: DataFrame, size: str, at: str) -> DataFrame:
    """The counts of every line, 0 for those without any."""
    every = dims.select("img", F.explode(F.sequence(F.lit(0), F.col(size).cast("int") - 1)).alias(at))
    return every.join(counted.hint("merge"), ["img", at], "left").fillna(0, ["n"])


def row_profile(inked: DataFrame, dims: DataFrame) -> DataFrame:
    """Ink of every row, empty ones included: img, y, n. dims has img, h and w."""
    return _filled(inked.groupBy("img", "y").agg(F.count("*").alias("n")), dims, "h", "y")


def column_profile(inked: DataFrame, dims: DataFrame) -> DataFrame:
    return _filled(inked.groupBy("img", "x").agg(F.count("*").alias("n")), dims, "w", "x")


def profiles(inked: DataFrame, dims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both profiles, counted in one pass over the pixels and written once, as several steps read them."""
    places = inked.select("img", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    counted = stored(places.groupingSets([["img", "y"], ["img", "x"]], "img", "y", "x").agg(F.count("*").alias("n")), "profiles")
    return tuple(_filled(counted.where(f"{at} IS NOT NULL").select("img", at, "n"), dims, size, at) for size, at in (("h", "y"), ("w", "x")))


def _int(x: Column) -> Column:
    return x.cast("int")


def mask_footer(rows: DataFrame, dims: DataFrame, percent: float = 12) -> DataFrame:
    """Clears the lowest rows. Where they are less than one, the whole profile is cleared."""
    cut = _int(F.col("h") * float(percent) / 100)
    n = F.when((cut == 0) | (F.col("y") >= F.col("h") - cut), 0).otherwise(F.col("n"))
    return _of_image(rows, dims.select("img", "h")).withColumn("n", n.cast("bigint")).select("img", "y", "n")


def profile_bounds(profile: DataFrame, at: str, more_than: DataFrame) -> DataFrame:
    """First and last place with more than img's `least` ink; images without any have no row."""
    return _of_image(profile, more_than).where("n > least").groupBy("img").agg(F.min(at).alias("first"), F.max(at).alias("last"))


def main_block(rows: DataFrame, gap: int = 100) -> DataFrame:
    """The block with most ink rows, the first of equals; gaps of more than `gap` rows part blocks."""
    by = Window.partitionBy("img").orderBy("y")
    marked = rows.where("n > 0").withColumn("new", (F.col("y") - F.lag("y").over(by) > gap).cast("int"))
    blocks = marked.withColumn("block", F.sum(F.coalesce("new", F.lit(0))).over(by))
    sizes = blocks.groupBy("img", "block").agg(F.min("y").alias("top"), F.max("y").alias("bottom"), F.count("*").alias("rows"))
    best = sizes.groupBy("img").agg(F.max(F.struct("rows", (-F.col("block")).alias("less"), "top", "bottom")).alias("b"))
    return best.select("img", "b.top", "b.bottom", "b.rows")


def guard(size: Column, a: Column, b: Column, most: float = 30) -> tuple[Column, Column]:
    """Gives back a part of what was cropped beyond so many percent."""
    percent = (F.lit(1.0) - (b - a) / size) * 100
    grow = F.when(percent > most, _int(size * (percent - float(most)) / 200)).otherwise(0)
    return _int(F.greatest(F.lit(0), a - grow)), _int(F.when(percent > most, F.least(size, b + grow)).otherwise(b))


def _box(rows: DataFrame, columns: DataFrame, dims: DataFrame, config: EngineConfig) -> DataFrame:
    """Bounds by profile in both directions, for images that have them in both."""
    least_row = dims.select("img", _int(F.col("w") * config.row_ink_ratio).alias("least"))
    least_column = dims.select("img", _int(F.col("h") * config.column_ink_ratio).alias("least"))
    tb = profile_bounds(rows, "y", least_row).withColumnsRenamed({"first": "top", "last": "bottom"})
    lr = profile_bounds(columns, "x", least_column).withColumnsRenamed({"first": "left", "last": "right"})
    return _of_image(_of_image(dims, tb), lr)


def first_pass(pixels: DataFrame, dims: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """img, top, bottom, left, right (half open) and whether the image is cropped at all."""
    rows, columns = profiles(ink(pixels), dims)
    if config.ignore_bottom_percent > 0:
        rows = mask_footer(rows, dims, config.ignore_bottom_percent)
    found = _of_image(_box(rows, columns, dims, config).drop("top", "bottom"), main_block(rows, config.footer_gap).drop("rows"))
    p = config.padding_size
    out = _of_image(dims.select("img", "h", "w"), found.drop("h", "w"), "left")
    top, bottom = guard(F.col("h"), F.col("top"), F.col("bottom"), config.max_crop_percent)
    left, right = guard(F.col("w"), F.col("left"), F.col("right"), config.max_crop_percent)
    cropped = F.col("top").isNotNull()
    pick = lambda x, whole: F.when(cropped, x).otherwise(whole).cast("int")
    return out.select(
        "img",
        pick(F.greatest(F.lit(0), top - p), F.lit(0)).alias("top"),
        pick(F.least(F.col("h"), bottom + p), F.col("h")).alias("bottom"),
        pick(F.greatest(F.lit(0), left - p), F.lit(0)).alias("left"),
        pick(F.least(F.col("w"), right + p), F.col("w")).alias("right"),
        cropped.alias("cropped"),
    )


def cut(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """The pixels within their image's box, counted from its corner."""
    inside = "y >= top AND y < bottom AND x >= left AND x < right"
    rest = [c for c in pixels.columns if c not in ("img", "y", "x")]
    return _of_image(pixels, boxes).where(inside).select("img", (F.col("y") - F.col("top")).alias("y"), (F.col("x") - F.col("left")).alias("x"), *rest)


def crop_box(pixels: DataFrame, dims: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """img, top, bottom, left, right of both passes together, in places of the whole image."""
    one = stored(first_pass(pixels, dims, config), "crop-first")  # a row for each image, which the second pass reads several times
    inner = one.where("cropped AND bottom > top AND right > left")
    part = cut(pixels, inner.select("img", "top", "bottom", "left", "right"))
    sizes = inner.select("img", (F.col("bottom") - F.col("top")).alias("h"), (F.col("right") - F.col("left")).alias("w"))
    two = _box(*profiles(ink(part), sizes), sizes, config)
    a, b = guard(F.col("h"), F.col("top"), F.col("bottom"), config.max_crop_percent)
    c, d = guard(F.col("w"), F.col("left"), F.col("right"), config.max_crop_percent)
    two = two.select("img", a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))
    pick = lambda base, x, old: F.when(F.col("a").isNull(), F.col(old)).otherwise(F.col(base) + F.col(x)).cast("int").alias(old)
    return _of_image(one, two, "left").select("img", pick("top", "a", "top"), pick("top", "b", "bottom"), pick("left", "c", "left"), pick("left", "d", "right"))


def top_heavy(inked: DataFrame, dims: DataFrame, cap: float = 5.0) -> DataFrame:
    """Density of the upper third, and half of the middle one, against the lower third's."""
    third = F.when(F.col("y") < F.floor(F.col("h") / 3), 0).when(F.col("y") < F.floor(F.col("h") * 2 / 3), 1).otherwise(2)
    sums = _of_image(inked, dims).groupBy("img").agg(*[F.sum(F.when(third == k, 255).otherwise(0)).alias(f"s{k}") for k in range(3)])
    a, b = F.floor(F.col("h") / 3), F.floor(F.col("h") * 2 / 3)
    sizes = (a * F.col("w"), (b - a) * F.col("w"), (F.col("h") - b) * F.col("w"))
    d = [F.coalesce(F.col(f"s{k}"), F.lit(0)) / (sizes[k] + F.lit(1e-6).cast("double")) for k in range(3)]
    score = F.least((d[0] + d[1] * F.lit(0.5)) / (d[2] + F.lit(1e-6).cast("double")), F.lit(float(cap)))
    return _of_image(dims, sums, "left").select("img", score.alias("score"))


def row_variance(inked: DataFrame, dims: DataFrame) -> DataFrame:
    """Population variance of the rows' sums (255 for ink): the deskew score."""
    return row_profile(inked, dims).groupBy("img").agg(F.var_pop(F.col("n") * 255).alias("variance"))


def quarter_turn(pixels: DataFrame, dims: DataFrame, angle: int) -> DataFrame:
    """Pixels turned by 90 (clockwise), -90 or 180 degrees."""
    y, x, h, w = (F.col(k) for k in "yxhw")
    to = {90: (x, h - 1 - y), -90: (w - 1 - x, y), 180: (h - 1 - y, w - 1 - x)}.get(angle, (y, x))
    rest = [c for c in pixels.columns if c not in ("img", "y", "x")]
    return _of_image(pixels, dims.select("img", "h", "w")).select("img", to[0].cast("int").alias("y"), to[1].cast("int").alias("x"), *rest)


def white_balance(pixels: DataFrame) -> DataFrame:
    """Each channel (b, g, r) scaled to the mean of all three, cut to a byte."""
    # whole sums: their division gives the same mean however they were added up
    means = pixels.groupBy("img").agg(*[(F.sum(c).cast("double") / F.count("*")).alias(f"m{c}") for c in "bgr"])
    middle = (F.col("mb") + F.col("mg") + F.col("mr")) / 3
    scaled = lambda c: F.when(F.col(f"m{c}") > 0, F.least(F.floor(F.col(c) * (middle / F.col(f"m{c}"))), F.lit(255))).otherwise(F.col(c)).cast("int").alias(c)
    return _of_image(pixels, means).select("img", "y", "x", *[scaled(c) for c in "bgr"])


def padded(pixels: DataFrame, dims: DataFrame, size: int = 16, value: int = 255) -> DataFrame:
    """A constant border around every image."""
    frame = dims.select("img", "h", "w", F.explode(F.sequence(F.lit(0), (F.col("h") + 2 * size - 1).cast("int"))).alias("y"))
    frame = frame.select("img", "h", "w", "y", F.explode(F.sequence(F.lit(0), (F.col("w") + 2 * size - 1).cast("int"))).alias("x"))
    inside = (F.col("y") >= size) & (F.col("y") < F.col("h") + size) & (F.col("x") >= size) & (F.col("x") < F.col("w") + size)
    border = frame.where(~inside).select("img", "y", "x", F.lit(value).alias("v"))
    return pixels.select("img", (F.col("y") + size).cast("int").alias("y"), (F.col("x") + size).cast("int").alias("x"), F.col("v").cast("int").alias("v")).unionByName(border)


def line_angle(votes: DataFrame, lines: int = 50) -> DataFrame:
    """Median angle of an image's strongest lines from (img, theta, rho, votes): ties in order of theta and rho."""
    by = Window.partitionBy("img").orderBy(F.desc("votes"), "theta", "rho")
    angle = F.col("theta").cast("double") - 90
    angle = F.when(angle > 90, angle - 180).when(angle < -90, angle + 180).otherwise(angle)
    top = votes.withColumn("place", F.row_number().over(by)).where(F.col("place") <= lines)
    return top.groupBy("img").agg(F.median(angle).alias("angle"))
