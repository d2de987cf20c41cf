"""PDF files as rows: page counts in pure Python, rendering by a replaceable backend."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..operators.pages import plan_pages
from ..schemas import IMAGE
from ..shared import ship, stored

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)


def _objects(content: bytes) -> dict[int, bytes]:
    """Bodies by number; of an object that was written again the last counts."""
    out: dict[int, bytes] = {}
    for number, body in _OBJECT.findall(content):
        out[int(number)] = body
        if re.search(rb"/Type\s*/ObjStm", body) and (packed := _STREAM.search(body)):
            try:
                raw = zlib.decompressobj().decompress(packed[1]) if b"FlateDecode" in body else packed[1]
            except zlib.error:
                continue
            first, n = (int(m[1]) if (m := re.search(rb"/" + k + rb"\s+(\d+)", body)) else 0 for k in (b"First", b"N"))
            head = [int(x) for x in raw[:first].split()[: 2 * n]]
            starts = [*head[1::2], len(raw) - first]
            for k, number in enumerate(head[::2]):
                out[number] = raw[first + starts[k] : first + starts[k + 1]]
    return out


def page_count(content: bytes | None) -> int | None:
    """Pages by the document's page tree, or else by its page objects; null for what is no PDF."""
    if not content or b"%PDF-" not in content[:1024]:
        return None
    objects = _objects(content)
    body = lambda b: b.split(b"stream", 1)[0]
    for root in reversed([o for o in objects.values() if re.search(rb"/Type\s*/Catalog\b", body(o))]):
        at = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", root)
        count = at and re.search(rb"/Count\s+(\d+)", body(objects.get(int(at[1]), b"")))
        if count:
            return int(count[1])
    return sum(bool(re.search(rb"/Type\s*/Page(?![A-Za-z])", body(o))) for o in objects.values()) or None


@F.pandas_udf(IntegerType())
def pdf_page_count(contents: pd.Series) -> pd.Series:
    return contents.map(lambda c: page_count(None if c is None else bytes(c))).astype("Int32")


def read_pdfs(spark: SparkSession, path: str, start_page: int | None = None, end_page: int | None = None) -> DataFrame:
    """A row for each page to read: path, total_pages, page_number and error. Contents stay in the files until pages are rendered."""
    ship(spark)  # counting runs this package's code
    files = spark.read.format("binaryFile").load(path)
    counted = files.select("path", pdf_page_count("content").alias("total_pages"))
    readable = counted.where("total_pages IS NOT NULL").withColumns({"start_page": F.lit(start_page).cast("int"), "end_page": F.lit(end_page).cast("int")})
    broken = counted.where("total_pages IS NULL").select("path", "total_pages", F.lit(None).cast("int").alias("page_number"), F.lit("not a PDF").alias("error"))
    return plan_pages(readable).select("path", "total_pages", "page_number", "error").unionByName(broken)


Renderer = Callable[[bytes, int, float], np.ndarray]
RENDERED = "path string, total_pages int, page_number int, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>, error string"


def fitz_renderer(content: bytes, page: int, zoom: float) -> np.ndarray:
    """Renders with PyMuPDF, where that is installed."""
    import fitz  # optional

    with fitz.open(stream=content, filetype="pdf") as doc:
        p = doc[page - 1].get_pixmap(matrix=fitz.Matrix(zoom, zoom), alpha=False)
        rgb = np.frombuffer(p.samples, np.uint8).reshape(p.height, p.width, p.n)
    return np.ascontiguousarray(rgb[..., 2::-1])


def _content(path: str) -> bytes:
    """A file's bytes, read where its pages are rendered."""
    if path.startswith("file:") or "://" not in path:
        return Path(re.sub(r"^file:(//)?(?=/)", "", path)).read_bytes()
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as f:
        return f.read()


#: Pages of a file that one row plans, and so the most that have to be rendered in one task.
PAGES = 16


def render_pages(spark: SparkSession, pages: DataFrame, renderer: Renderer, dpi: float = 300, tasks: int | None = None) -> DataFrame:
    """Rasters of the planned pages. Only names and numbers are shuffled; each run of PAGES pages reads its file."""
    ship(spark)
    pages = stored(pages.select("path", "total_pages", "page_number", "error"), "page-plan")  # so that files are read for counting once
    good = pages.where("error IS NULL")
    failed = pages.where("error IS NOT NULL").select("path", "total_pages", "page_number", F.lit(None).cast(IMAGE).alias("image"), "error")
    runs = good.groupBy("path", "total_pages", F.floor(F.col("page_number") / PAGES).alias("run")).agg(F.sort_array(F.collect_set("page_number")).alias("wanted"))
    runs = runs.repartition(tasks or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "run").sortWithinPartitions("path", "run")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("mode", pa.int32()), ("data", pa.binary())])
        path, content = None, b""
        for batch in batches:
            for r in batch.to_pylist():
                for n in r["wanted"]:
                    try:
                        if r["path"] != path:
                            path, content = None, _content(r["path"])
                            path = r["path"]
                        x = renderer(content, n, dpi / 72)
                        image, error = {"origin": r["path"], "height": x.shape[0], "width": x.shape[1], "nChannels": 3, "mode": 16, "data": x.tobytes()}, None
                    except Exception as failure:  # noqa: BLE001 - one page's failure leaves the others alone
                        image, error = None, f"{type(failure).__name__}: {failure}"
                    yield pa.RecordBatch.from_arrays([pa.array([r["path"]]), pa.array([r["total_pages"]], pa.int32()), pa.array([n], pa.int32()), pa.array([image], kind), pa.array([error], pa.string())], ["path", "total_pages", "page_number", "image", "error"])

    return runs.select("path", "total_pages", "wanted").mapInArrow(run, RENDERED).unionByName(failed)
