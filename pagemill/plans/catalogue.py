"""Queries over the reference tables and the SQL that checks them.

Inputs that the tables don't hold (tagged replies, page ranges, rasters, scores) are made from their rows by expressions
that both engines read alike. Integers leave as bigint.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EngineConfig, ParsingMode, check_request
from ..functions import geometry as G
from ..functions import kernels
from ..functions import text as X
from ..operators import pages as P
from ..operators import pixels as PX
from ..operators.reflect import unrolled
from ..operators.stage import kernel_stage, run_stage
from ..shared import ship
from .oracles import ORACLES

REPLY = """CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN 'Here: <transcription>' || chr(10) || text || chr(10) || '</transcription> done'
WHEN 2 THEN '<transcription>' || text WHEN 3 THEN '<transcription> ' || text || ' </transcription><transcription>second</transcription>'
ELSE '<transcription>  </transcription>' END"""
MODE = "CASE doc_id % 3 WHEN 0 THEN 'ocr_engine' WHEN 1 THEN 'parse_with_vlm' ELSE 'parse_with_agent' END"
BLANKED = "CASE WHEN doc_id % 4 = 0 THEN ' ' || chr(9) || chr(10) || '\u2003' WHEN doc_id % 4 = 1 THEN '' ELSE text END"
DIMS = "s_suppkey AS img, CAST(4 + (s_suppkey * 37) % 250 AS INT) AS h, CAST(8 + (s_suppkey * 13) % 33 AS INT) AS w"
PIXEL = """CASE WHEN img % 11 = 0 THEN 255 WHEN img % 13 = 0 THEN 0
WHEN y % 4 < 2 AND NOT (y >= 20 AND y < 80 + img % 90) AND x >= img % 5 AND x < w - img % 7 THEN (x * 31 + y * 17 + img * 7) % 60
ELSE 200 + (x * 7 + y * 3 + img) % 40 END"""
_IMAGE = pa.struct([("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("mode", pa.int32()), ("data", pa.binary())])
#: Pixels of a task, about: as rows, and as images, whose kernels take longer.
TASK_PIXELS, IMAGE_PIXELS = 2 << 20, 1 << 18
SIZES = "l_orderkey, l_linenumber, CAST(300 + l_partkey % 4500 AS BIGINT) AS h, CAST(200 + (l_suppkey * 37 + l_orderkey) % 4300 AS BIGINT) AS w"
SCORES = """event_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE CAST(CASE event_id % 9 WHEN 0 THEN 0 WHEN 1 THEN 4 WHEN 2 THEN -5 WHEN 3 THEN 85 WHEN 4 THEN -90 WHEN 5 THEN 90 WHEN 6 THEN -85 WHEN 7 THEN 176 ELSE 30 END AS DOUBLE) END AS angle,
CAST((event_id * 7) % 300 AS DOUBLE) / 100 AS cw, CAST((event_id * 11 + user_id) % 300 AS DOUBLE) / 100 AS ccw, CAST((event_id * 13 + user_id * 3) % 320 AS DOUBLE) / 100 AS original,
CAST(100 + user_id % 900 AS BIGINT) AS h, CAST(100 + (event_id * 17) % 900 AS BIGINT) AS w"""
CRITIC = """CASE WHEN (doc_id + $c) % 7 = 0 THEN '{"score": 12, "issues": []}' WHEN (doc_id + $c) % 11 = 0 THEN 'no json'
ELSE '{"score": ' || CAST((doc_id * 3 + $c * 2) % 11 AS STRING) || ', "issues": [' || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '"row ' || CAST($c AS STRING) || ' is cut"' END || '], "needs_revision": true}' END"""


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint."""
    return df.select(*[F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)) else F.col(f.name) for f in df.schema])


def _replies(spark, d) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", "source", F.expr(REPLY).alias("reply"), F.expr(MODE).alias("mode"))


def _contents(replies: DataFrame) -> DataFrame:
    kept = P.drop_blank(replies.withColumn("content", X.extract_or_empty(F.col("reply"))))
    return kept.select(F.concat("source", F.lit(".pdf")).alias("file_name"), F.col("doc_id").alias("page_number"), "content", F.col("mode").alias("parsing_mode"))


def page_contents(spark, d):
    """Replies to page records without their ids: extraction, metadata, blank pages, places in order."""
    return _contents(_replies(spark, d))


def page_records(spark, d):
    """The flagship: page_contents with the id that follows from each content, in page order.

    A global sort reads its input twice, so replies are sorted as they came, and contents and ids follow behind it.
    """
    return P.with_records(_contents(P.ordered(_replies(spark, d), "doc_id")))


def transcription_extract(spark, d):
    return _replies(spark, d).select("doc_id", X.extract_transcription("reply").alias("content"))


def extract_modes(spark, d):
    r = _replies(spark, d)
    return r.select("doc_id", X.extract_or_empty(F.col("reply")).alias("one_call"), X.extract_or_raw(F.col("reply")).alias("loop"))


def content_id(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.content_id("text").alias("id"))


def identical_content(spark, d):
    return _t(spark, d, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("pages"), F.min("doc_id").alias("first_page"))


def _ranges(spark, d) -> DataFrame:
    total = _t(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("total_pages"))
    start = "CASE conv_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN total_pages + 1 ELSE 3 END"
    end = "CASE conv_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 999 END"
    return total.withColumns({"start_page": F.expr(start).cast("int"), "end_page": F.expr(end).cast("int")})


def page_plan(spark, d):
    return _plain(P.plan_pages(_ranges(spark, d)).select("conv_id", "total_pages", "page_number", "error"))


def drop_blank(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.expr(BLANKED).alias("content"), F.expr(MODE).alias("mode"))
    return P.drop_blank(docs)


def page_error_isolation(spark, d):
    error = F.expr("CASE WHEN doc_id % 17 = 0 THEN 'unreadable' END")
    good, _ = P.split_errors(_t(spark, d, "documents").select("doc_id", "n_chars", error.alias("error")))
    return good


def metadata_precedence(spark, d):
    docs = _t(spark, d, "documents")
    has = F.col("doc_id") % 3 > 0
    user = F.expr("CASE WHEN doc_id % 3 = 1 THEN 'mine-' || CAST(doc_id AS STRING) END")
    pages = F.when(F.col("doc_id") % 2 == 0, 0)
    return docs.select(
        "doc_id",
        P.override(F.concat("source", F.lit(".pdf")), user, has).alias("file_name"),
        P.override(pages, F.length("lang"), F.lit(True)).cast("bigint").alias("total_pages"),
    )


def page_order(spark, d):
    from pyspark.sql import Window

    by = Window.partitionBy("conv_id").orderBy(F.coalesce("page_number", F.lit(0)), "turn")
    rows = _t(spark, d, "conversations").select("conv_id", "turn", F.expr("CASE WHEN turn % 5 = 3 THEN NULL ELSE turn % 3 END").alias("page_number"))
    return rows.withColumn("place", F.row_number().over(by).cast("bigint"))


def markdown_text(spark, d):
    rows = _t(spark, d, "conversations").select("conv_id", F.col("turn").alias("place"), F.expr("CASE WHEN turn % 4 = 3 THEN NULL ELSE turn + 1 END").alias("page_number"), F.col("text").alias("content"))
    return P.markdown(rows, ["conv_id"])


def json_content(spark, d):
    text = F.expr("CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN ' ' || props || ' ' WHEN 2 THEN '{' || props ELSE event_type END")
    return _t(spark, d, "events").select("event_id", text.alias("content")).select("event_id", X.is_json("content").alias("decoded"))


def ocr_line_assembly(spark, d):
    lines = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("place", "text"))
    top = F.expr("CASE WHEN place % 7 = 5 THEN NULL ELSE CAST((place * 37 + doc_id) % 11 AS DOUBLE) END")
    return P.ocr_lines(lines.withColumn("top", top), ["doc_id"])


def _outcome(mode: ParsingMode, image: bool, client: bool, schema: bool) -> str:
    """What the engine's own check says to a request."""
    try:
        check_request(mode, client, {} if schema else None, "image" if image else "pdf")
    except ValueError as refused:
        return next(short for part, short in (("agentic", "agentic image"), ("schema", "schema without model"), ("needs the model's", "no client")) if part in str(refused))
    return "run"


def mode_dispatch(spark, d):
    e = _t(spark, d, "events").select("event_id", F.expr("event_id % 3").alias("m"), F.expr("event_id % 2 = 0").alias("image"), F.expr("event_id % 5 < 3").alias("client"), F.expr("event_id % 7 = 0").alias("schema"))
    cases = [(m, mode, *flags) for m, mode in enumerate(ParsingMode) for flags in itertools.product((True, False), repeat=3)]
    table = spark.createDataFrame([(m, *flags, mode.value, _outcome(mode, *flags)) for m, mode, *flags in cases], "m bigint, image boolean, client boolean, schema boolean, mode string, outcome string")
    return e.join(F.broadcast(table), ["m", "image", "client", "schema"]).select("event_id", "mode", "outcome")


def message_build(spark, d):
    docs = _t(spark, d, "documents")
    prompt = F.expr("CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Read page ' || CAST(doc_id AS STRING) END")
    m = X.build_message(F.md5("text"), F.lit("image/png"), prompt, prompt)
    return docs.select("doc_id", m[0]["text"].alias("system_text"), m[1]["image_url"].alias("image_url"), m[1]["text"].alias("user_text"))


def refine_prompts(spark, d):
    issues = F.expr("CASE doc_id % 3 WHEN 0 THEN array() WHEN 1 THEN array('table {cut}') ELSE array('a', 'b') END").cast("array<string>")
    return _t(spark, d, "documents").select("doc_id", X.refine_prompt(issues, F.col("text")).alias("refine"), X.critic_prompt(F.col("text")).alias("critic"))


def retry_schedule(spark, d):
    e = _t(spark, d, "events").select("event_id", F.explode_outer(X.retry_waits(F.expr("CAST(event_id % 5 AS INT)"), F.expr("CAST(event_id % 3 + 1 AS DOUBLE)"))).alias("wait"))
    return e


def file_names(spark, d):
    path = F.expr("'/data/' || source || '/p' || CAST(doc_id AS STRING) || CASE doc_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.tar.gz' WHEN 2 THEN '' ELSE '.md' END")
    return _t(spark, d, "documents").select("doc_id", X.file_name(path).alias("name"), X.file_stem(path).alias("stem"), X.file_suffix(path).alias("suffix"))


def page_dims(spark, d):
    s = _t(spark, d, "lineitem").selectExpr(*_split(SIZES))
    h, w = F.col("h"), F.col("w")
    (rh, rw), (oh, ow), (ah, aw) = G.resize_dims(h, w), G.ocr_dims(h, w), G.analysis_dims(h, w)
    c, n = (F.lit(x) for x in (0.9375, 0.3125))
    ch, cw = G.canvas_dims(h, w, c, n)
    return s.select("l_orderkey", "l_linenumber", rh.alias("resize_h"), rw.alias("resize_w"), oh.alias("ocr_h"), ow.alias("ocr_w"), ah.alias("analysis_h"), aw.alias("analysis_w"), ch.alias("canvas_h"), cw.alias("canvas_w"))


def aspect(spark, d):
    s = _t(spark, d, "lineitem").selectExpr(*_split(SIZES))
    h, w = F.col("h"), F.col("w")
    return s.select("l_orderkey", "l_linenumber", G.aspect_score(h, w).alias("score"), G.aspect_confidence(h, w).alias("lying"))


def _split(columns: str) -> list[str]:
    """Select items, cut at commas outside parentheses."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


def rotation_decide(spark, d):
    e = _t(spark, d, "events").selectExpr(*_split(SCORES))
    args = [F.col(k) for k in ("angle", "cw", "ccw", "original")] + [G.aspect_confidence(F.col("h"), F.col("w"))]
    calm, bold = G.detect_rotation(*args), G.detect_rotation(*args, aggressive=True)
    out = e.select("event_id", calm.alias("c"), bold.alias("b"))
    return _plain(out.select("event_id", "c.angle", "c.confidence", "c.original_angle", "c.applied_rotation", F.col("b.angle").alias("bold_angle"), F.col("b.confidence").alias("bold_confidence")))


def orientation_total(spark, d):
    e = _t(spark, d, "events").selectExpr(*_split(SCORES))
    return e.select("event_id", G.total_score(F.col("cw"), F.col("ccw"), F.col("original"), G.aspect_score(F.col("h"), F.col("w"))).alias("score"))


def line_angle(spark, d):
    votes = _t(spark, d, "events").groupBy(F.col("user_id").alias("img"), F.expr("CAST((event_id * 7) % 180 AS INT)").alias("theta"), F.expr("CAST(event_id % 40 AS INT)").alias("rho")).agg(F.count("*").alias("votes"))
    return PX.line_angle(votes, 50)


def _dims(spark, d) -> DataFrame:
    return _t(spark, d, "supplier").selectExpr(*_split(DIMS))


def _parted(spark, d, pixels: int) -> DataFrame:
    """Sizes, parted by image in tasks of about so many pixels."""
    dims = _dims(spark, d)
    area = dims.agg(F.sum(F.expr("CAST(h AS BIGINT) * w"))).first()[0] or 0
    return dims.repartition(max(spark.sparkContext.defaultParallelism, -(-area // pixels)), "img")


def _raster(spark, d, value: str = PIXEL) -> tuple[DataFrame, DataFrame]:
    """Pixels and sizes, parted by image once, so that no step behind has to shuffle pixels."""
    dims = _parted(spark, d, TASK_PIXELS)
    rows = dims.select("img", "h", "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"))
    px = rows.select("img", "h", "w", "y", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))
    return px.select("img", "y", "x", F.expr(value).cast("int").alias("v")), dims


def gray_pixels(spark, d):
    px, _ = _raster(spark, d)
    b = px.withColumns({"b": F.col("v"), "g": F.expr("CAST(v * 7 DIV 8 AS INT)"), "r": F.expr("CAST((v * 3 + 20) DIV 4 AS INT)")})
    return _plain(b.select("img", "y", "x", PX.gray(F.col("b"), F.col("g"), F.col("r")).alias("gray")))


def gray_histogram(spark, d):
    return _plain(PX.histogram(_raster(spark, d)[0]))


def otsu_threshold(spark, d):
    return _plain(PX.otsu(_raster(spark, d)[0]))


def row_profile(spark, d):
    px, dims = _raster(spark, d)
    rows = PX.row_profile(PX.ink(px), dims)
    masked = PX.mask_footer(rows, dims).withColumnRenamed("n", "masked").hint("merge")
    return _plain(rows.join(masked, ["img", "y"]))


def column_profile(spark, d):
    px, dims = _raster(spark, d)
    return _plain(PX.column_profile(PX.ink(px), dims))


def profile_bounds(spark, d):
    px, dims = _raster(spark, d)
    rows = PX.row_profile(PX.ink(px), dims)
    return _plain(PX.profile_bounds(rows, "y", dims.select("img", F.expr("CAST(w * 0.002D AS INT)").alias("least"))))


def main_block(spark, d):
    px, dims = _raster(spark, d)
    return _plain(PX.main_block(PX.row_profile(PX.ink(px), dims)))


def crop_guard(spark, d):
    s = _t(spark, d, "lineitem").selectExpr(*_split(SIZES), "CAST(l_quantity AS BIGINT) AS a", "CAST(l_quantity * 5 + 20 AS BIGINT) AS b")
    a, b = PX.guard(F.col("h"), F.col("a"), F.col("b"))
    return _plain(s.select("l_orderkey", "l_linenumber", a.alias("first"), b.alias("last")))


def crop_first_pass(spark, d):
    return _plain(PX.first_pass(*_raster(spark, d)))


def crop_box(spark, d):
    return _plain(PX.crop_box(*_raster(spark, d)))


def top_heavy(spark, d):
    px, dims = _raster(spark, d)
    return PX.top_heavy(PX.ink(px), dims)


def row_variance(spark, d):
    px, dims = _raster(spark, d)
    return PX.row_variance(PX.ink(px), dims).select("img", F.round("variance", 6).alias("variance"))


def quarter_turn(spark, d):
    px, dims = _raster(spark, d)
    turned = [PX.quarter_turn(px, dims, a).withColumn("angle", F.lit(a)) for a in (90, -90, 180)]
    return _plain(turned[0].unionByName(turned[1]).unionByName(turned[2]))


def white_balance(spark, d):
    px, _ = _raster(spark, d)
    return _plain(PX.white_balance(px.selectExpr("img", "y", "x", "v AS b", "CAST(v * 7 DIV 8 AS INT) AS g", "CAST((v * 3 + 20) DIV 4 AS INT) AS r")))


def padded(spark, d):
    px, dims = _raster(spark, d)
    return _plain(PX.padded(px, dims))


def reflect_route(spark, d):
    issues = F.expr("CASE WHEN event_id % 3 = 0 THEN array() ELSE array('x') END")
    return _t(spark, d, "events").select("event_id", G.route(F.expr("CAST(event_id % 11 AS INT)"), issues, F.expr("CAST(user_id % 4 AS INT)")).alias("goto"))


def _critic(cycle: int):
    """The scripted critic's reply to a document in a cycle."""
    return F.expr(CRITIC.replace("$c", str(cycle)))


def critic_parse(spark, d):
    got = X.parse_critic(_critic(0))
    issues = F.when(got["score"].isNotNull(), F.size(got["issues"]))
    return _plain(_t(spark, d, "documents").select("doc_id", got["score"].alias("score"), issues.alias("issues"), F.get(got["issues"], F.lit(0)).alias("first_issue"), got["needs_revision"].alias("needs_revision")))


def reflect_loop(spark, d):
    """The loop with a scripted critic, unrolled into one plan."""
    docs = _t(spark, d, "documents").select("doc_id", F.expr(REPLY).alias("reply"))
    steps = iter(range(3))
    out = unrolled(docs, lambda: F.col("reply"), lambda text, cycle: _critic(next(steps)), lambda text, issues, cycle: F.concat(F.lit("<transcription>"), text, F.lit(" +"), F.size(issues).cast("string"), F.lit("</transcription>")))
    return _plain(out.select("doc_id", "accumulated_text", "iteration_count", F.size("generation_history").alias("generations"), "critic_score", F.size("critic_issues").alias("issues"), "reflect_iteration"))


def drawn(img: int, h: int, w: int) -> np.ndarray:
    """PIXEL for a whole raster at once."""
    y, x = np.ogrid[:h, :w]
    if img % 11 == 0 or img % 13 == 0:
        return np.full((h, w), 0 if img % 11 else 255, np.uint8)
    inked = (y % 4 < 2) & ~((y >= 20) & (y < 80 + img % 90)) & (x >= img % 5) & (x < w - img % 7)
    return np.where(inked, (x * 31 + y * 17 + img * 7) % 60, 200 + (x * 7 + y * 3 + img) % 40).astype(np.uint8)


def _images(spark, d) -> DataFrame:
    """The rasters as images, a row each, drawn where they are used: no pixel is a row, and none is shuffled."""
    ship(spark)

    def draw(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64).to_pylist()
                images = [{"origin": "made", "height": r["h"], "width": r["w"], "nChannels": 3, "mode": 16, "data": np.repeat(drawn(r["img"], r["h"], r["w"]), 3).tobytes()} for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r["img"] for r in rows], batch.schema.field("img").type), pa.array(images, _IMAGE)], ["img", "image"])

    dims = _parted(spark, d, IMAGE_PIXELS).where("img IS NOT NULL")
    made = dims.mapInArrow(draw, f"img {dims.schema['img'].dataType.simpleString()}, image struct<origin string, height int, width int, nChannels int, mode int, data binary>")
    return made.withColumn("error", F.lit(None).cast("string"))


def kernel_crop_box(spark, d):
    """The NumPy crop; its SQL is that of the relational form."""
    def box(x):
        return dict(zip(("top", "bottom", "left", "right"), kernels.crop_box(x)))

    return kernel_stage(_images(spark, d), box, "top bigint, bottom bigint, left bigint, right bigint", ["img"])


def kernel_otsu(spark, d):
    return kernel_stage(_images(spark, d), lambda x: {"threshold": kernels.otsu(kernels.to_gray(x))}, "threshold bigint", ["img"])


def kernel_turns(spark, d):
    """The NumPy turns, pixel by pixel; their SQL is that of the relational form."""
    angles = (90, -90, 180)

    def turn(x):
        out = [kernels.apply_rotation(x, a)[..., 0] for a in angles]
        return {f"{k}{n}": v for n, o in enumerate(out) for k, v in (("wide", o.shape[1]), ("values", o.ravel().astype(np.int16)))}

    rows = kernel_stage(_images(spark, d), turn, ", ".join(f"wide{n} bigint, values{n} array<smallint>" for n in range(3)), ["img"])
    each = F.explode(F.array(*[F.struct(F.lit(a).cast("bigint").alias("angle"), F.col(f"wide{n}").alias("wide"), F.col(f"values{n}").alias("values")) for n, a in enumerate(angles)]))
    turned = rows.select("img", each.alias("t")).select("img", "t.angle", "t.wide", F.posexplode("t.values").alias("at", "v"))
    return turned.selectExpr("img", "at DIV wide AS y", "at % wide AS x", "CAST(v AS BIGINT) AS v", "angle")


def kernel_scores(spark, d):
    """Every kernel of orientation, contrast and skew once over every raster."""
    def scores(x):
        found = kernels.detect_rotation(x)
        return {"score": kernels.orientation_score(x), "angle": found["angle"], "skew": kernels.skew_angle(x, "paper"), "light": float(kernels.enhance_contrast(x).mean()), "blur": float(kernels.gaussian(kernels.to_gray(x)).mean()), "sharp": float(kernels.unsharp(x).mean())}

    return kernel_stage(_images(spark, d), scores, "score double, angle bigint, skew double, light double, blur double, sharp double", ["img"])


class EchoModel:
    """A stand-in for a model: tells the size of the image it was sent."""

    def __call__(self, request: dict) -> dict:
        url = request["messages"][1]["content"][0]["image_url"]["url"]
        if request["schema"] is not None:
            return {"content": None, "parsed": {"score": 9, "issues": []}}
        return {"content": f"<transcription>{len(url)} characters</transcription>"}


def _pipeline(mode: ParsingMode):
    def run(spark, d):
        config = EngineConfig(post_crop_max_size=64, max_retries=1, max_concurrency=64)
        build = lambda: lambda x: [([[0, 0]], f"{x.shape[0]} rows", 1.0)]
        out = run_stage(_images(spark, d), mode, config, EchoModel(), build)
        return P.with_records(out.where("error IS NULL").select("img", "content", "reflect_iterations"))

    run.__name__ = f"pipeline_{mode.name.lower()}"
    return run


_QUERIES = [
    page_contents, page_records, transcription_extract, extract_modes, content_id, identical_content, page_plan, drop_blank, page_error_isolation, metadata_precedence,
    page_order, markdown_text, json_content, ocr_line_assembly, mode_dispatch, message_build, refine_prompts, retry_schedule, file_names, page_dims, aspect, rotation_decide,
    orientation_total, line_angle, gray_pixels, gray_histogram, otsu_threshold, row_profile, column_profile, profile_bounds, main_block, crop_guard, crop_first_pass, crop_box,
    top_heavy, row_variance, quarter_turn, white_balance, padded, reflect_route, critic_parse, reflect_loop, kernel_crop_box, kernel_otsu, kernel_turns, kernel_scores,
]


def queries():
    return {q.__name__: q for q in _QUERIES} | {f"page_{m.name.lower()}": _pipeline(m) for m in ParsingMode}


def oracle_sql():
    return dict(ORACLES)
