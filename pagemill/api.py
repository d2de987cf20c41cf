"""parse_images, parse_pdfs and save: from files to page records (id, content, metadata)."""

from __future__ import annotations

import json
import threading
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig, ParsingMode, check_request
from .functions import text as X
from .operators.model import HttpTransport
from .operators.pages import drop_blank
from .operators.stage import run_stage
from .shared import stored
from .sources.images import from_rasters, read_images
from .sources.pdf import Renderer, fitz_renderer, read_pdfs, render_pages
from .sources.sinks import save  # noqa: F401


def records(pages: DataFrame, mode: ParsingMode, user: dict, of_image: bool) -> DataFrame:
    """The record of each page that went well. Later keys win: the file's name, the user's, then what the engine tells."""
    has_total, has_name = "total_pages" in pages.columns, "path" in pages.columns and not of_image or "path" in pages.columns
    name = F.lit(user["file_name"]).cast("string") if "file_name" in user else X.file_name("path") if has_name else F.lit(None).cast("string")
    own = {"file_name", "page_number", "total_pages", "parsing_mode", "processing_time", "reflect_iterations", "final_critic_score", "final_critic_issues"}
    if of_image:  # an image has no pages of its own, so such keys of the user stay
        own -= {"page_number", "total_pages"}
    rest = {k: v for k, v in user.items() if k not in own}
    meta = F.struct(
        name.alias("file_name"),
        (F.col("total_pages").cast("int") if has_total else F.lit(None).cast("int")).alias("total_pages"),
        (F.col("page_number").cast("int") if "page_number" in pages.columns else F.lit(None).cast("int")).alias("page_number"),
        F.col("processing_time"),
        F.lit(mode.value).alias("parsing_mode"),
        "reflect_iterations",
        "final_critic_score",
        "final_critic_issues",
        F.lit(json.dumps(rest, ensure_ascii=False) if rest else None).cast("string").alias("user_meta"),
    )
    good = pages.where("error IS NULL").withColumn("mode", F.lit(mode.value))
    if not of_image:
        good = drop_blank(good)
    return good.select(X.content_id("content").alias("id"), F.coalesce("content", F.lit("")).alias("content"), meta.alias("metadata"))


def _done(run: Callable[[list | None], DataFrame], progress: Callable[[int], None] | None) -> DataFrame:
    """The stage's rows, written once: however often they are read, sorted or saved, no page is recognised again.

    Failed pages are told in a warning. progress is called with the number of finished pages while the stage runs.
    """
    if progress is None:
        rows = stored(run(None), "parsed")
    else:
        box: list = [None]
        plan, over = run(box), threading.Event()

        def tell():
            while not over.wait(1):
                progress(box[0].value)

        teller = threading.Thread(target=tell, daemon=True)
        teller.start()
        try:
            rows = stored(plan, "parsed")
        finally:
            over.set()
            teller.join()
        progress(rows.count())
    failed = rows.where("error IS NOT NULL")
    first = failed.select("path", "page_number" if "page_number" in rows.columns else F.lit(None).alias("page_number"), "error").limit(TOLD).collect()
    if first:
        n = failed.count() if len(first) == TOLD else len(first)
        warnings.warn(f"{n} pages failed: " + "; ".join(f"{r.path}{'' if r.page_number is None else f' page {r.page_number}'}: {r.error}" for r in first), UserWarning, stacklevel=4)
    return rows


#: Failed pages that a warning names one by one.
TOLD = 20


def parse_images(spark: SparkSession, source, mode: ParsingMode = ParsingMode.BASIC_OCR, config: EngineConfig = EngineConfig(), transport=None, build_recognizer=None, metadata: dict | None = None, output_schema=None, progress: Callable[[int], None] | None = None) -> DataFrame:
    """source: a path of image files, or a DataFrame with an `image` column."""
    check_request(mode, config.has_client or transport is not None, output_schema, "image")
    images = read_images(spark, source) if isinstance(source, str) else from_rasters(source)
    rows = _done(lambda told: run_stage(images, mode, config, _transport(mode, config, transport), build_recognizer, output_schema, progress=told), progress)
    return records(rows, mode, metadata or {}, True)


def parse_pdfs(spark: SparkSession, path: str, mode: ParsingMode = ParsingMode.BASIC_OCR, config: EngineConfig = EngineConfig(), start_page: int | None = None, end_page: int | None = None, renderer: Renderer = fitz_renderer, transport=None, build_recognizer=None, metadata: dict | None = None, output_schema=None, progress: Callable[[int], None] | None = None) -> DataFrame:
    """The pages from start to end of every PDF at a path, in order of path and page."""
    check_request(mode, config.has_client or transport is not None, output_schema, "pdf", path)
    if (start_page or 0) < 0 or (end_page or 0) < 0:
        raise ValueError("pages are counted from 1")
    tasks = None if mode == ParsingMode.BASIC_OCR else max(1, config.max_concurrency)
    pages = render_pages(spark, read_pdfs(spark, path, start_page, end_page), renderer, config.dpi, tasks)
    rows = _done(lambda told: run_stage(pages, mode, config, _transport(mode, config, transport), build_recognizer, output_schema, True, told), progress)
    return records(rows, mode, metadata or {}, False).orderBy("metadata.file_name", "metadata.page_number")


def _transport(mode: ParsingMode, config: EngineConfig, transport):
    return transport if transport is not None or mode == ParsingMode.BASIC_OCR else HttpTransport(config)
