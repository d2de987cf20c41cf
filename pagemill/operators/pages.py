"""Page operators: ranges, records, metadata, filters, recognised lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def plan_pages(documents: DataFrame) -> DataFrame:
    """A row for each page to read, from path, total_pages, start_page and end_page.

    A start of null or 0 is the first page, such an end the last; a start behind the end gives nothing. A start beyond
    the last page and negative pages are errors: those documents come with a null page_number and the error's text.
    """
    start = F.coalesce(F.nullif("start_page", F.lit(0)), F.lit(1)).cast("int")
    end = F.least(F.coalesce(F.nullif("end_page", F.lit(0)), F.col("total_pages")), F.col("total_pages")).cast("int")
    error = F.when((start < 0) | (end < 0), F.lit("pages are counted from 1")).when(start > F.col("total_pages"), F.concat(F.lit("start_page="), start.cast("string"), F.lit(" exceeds total pages ("), F.col("total_pages").cast("string"), F.lit(")")))
    # sequence counts down by itself, so a range that runs backwards has to be left out
    pages = F.when(error.isNotNull(), F.array(F.lit(None).cast("int"))).when(start <= end, F.sequence(start, F.greatest(start, end))).otherwise(F.array().cast("array<int>"))
    return documents.withColumn("error", error).withColumn("page_number", F.explode(pages))


def drop_blank(records: DataFrame, content: str = "content", mode: str = "mode") -> DataFrame:
    """Blank pages go, but for those of the vision-model mode."""
    return records.where((X.strip(F.coalesce(content, F.lit(""))) != "") | (F.col(mode) == "parse_with_vlm"))


def split_errors(pages: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Pages that went well, and those that failed; one page's failure leaves the others alone."""
    return pages.where(F.col(error).isNull()).drop(error), pages.where(F.col(error).isNotNull())


def override(value: Column, user: Column, present: Column) -> Column:
    """The user's value wherever there is a key for it, null included."""
    return F.when(present, user).otherwise(value)


def with_records(pages: DataFrame, content: str = "content") -> DataFrame:
    """Adds the id that follows from the content. Kept last, as it runs in Python."""
    return pages.withColumn("id", X.content_id(content))


def ordered(records: DataFrame, by: str = "page_number") -> DataFrame:
    return records.orderBy(F.coalesce(F.col(by), F.lit(0)))


def ocr_lines(detections: DataFrame, keys: list[str]) -> DataFrame:
    """Recognised text per page from (keys..., place, top, text): boxes from top to bottom, then in their order.

    A box without a place stands at 0; blank texts go, others are stripped; a page without any has ''.
    """
    top = F.coalesce(F.when(~F.isnan("top"), F.col("top")), F.lit(0.0))
    line = F.struct(top.alias("top"), "place", X.strip("text").alias("text"))
    lines = F.filter(F.array_sort(F.collect_list(line)), lambda x: F.coalesce(x["text"], F.lit("")) != "")
    return detections.withColumn("top", F.col("top").cast("double")).groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("content"))


def markdown(records: DataFrame, keys: list[str]) -> DataFrame:
    """One Markdown text per document from (keys..., page_number, place, content); pages in order, ties by place."""
    by = Window.partitionBy(*keys).orderBy(F.coalesce("page_number", F.lit(0)), "place")
    numbered = records.withColumn("index", F.row_number().over(by))
    page = F.concat(F.lit("<!-- page "), F.coalesce("page_number", "index").cast("string"), F.lit(" -->\n"), F.coalesce("content", F.lit("")))
    pages = F.array_sort(F.collect_list(F.struct("index", page.alias("page"))))
    return numbered.groupBy(*keys).agg(F.array_join(F.transform(pages, lambda x: x["page"]), "\n\n---\n\n").alias("markdown"))
