"""Sinks: one JSON or Markdown file as single readers want it, folders for what is large, debug images."""

from __future__ import annotations

import json
import shutil
import warnings
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.text import as_json
from ..shared import stored

MODEL_CACHE = Path.home() / ".cache" / "pagemill" / "models"


def save(records: DataFrame, path: str, stem: str = "output") -> Path | None:
    """Writes id, content and metadata, in page order: .json and .md to that file, else <stem>.json in the folder.

    Rows are read one by one, so the driver holds one partition of results at most. Nothing is written without rows.
    """
    records = stored(records, "saved")  # the order below is found in two passes
    if records.isEmpty():
        warnings.warn(f"nothing was extracted, so {path} isn't written", UserWarning, stacklevel=2)
        return None
    to = Path(path)
    kind = to.suffix.lower()
    if kind not in (".json", ".md"):
        to, kind = to / f"{stem}.json", ".json"
    to.parent.mkdir(parents=True, exist_ok=True)
    rows = records.orderBy(F.coalesce("metadata.page_number", F.lit(0))).toLocalIterator()
    with to.open("w", encoding="utf-8") as out:
        (write_markdown if kind == ".md" else write_json)((_plain(r) for r in rows), out)
    return to


def _plain(row) -> dict:
    """A record without the metadata it doesn't have; the user's keys, null ones too, stand beside the others."""
    meta = {k: v for k, v in row.metadata.asDict(True).items() if v is not None}
    meta = json.loads(meta.pop("user_meta", None) or "{}") | meta
    return {"id": row.id, "content": row.content, "metadata": meta}


def decoded(record: dict) -> dict:
    """A record whose content, where that is a JSON object or array, is decoded."""
    if (record["content"] or "").strip().startswith(("{", "[")):
        try:
            return record | {"content": json.loads(record["content"])}
        except ValueError:
            pass
    return record


def write_json(records: Iterator[dict], out) -> None:
    """A list of records; of a single one with decoded content the content alone."""
    first, second = next(records, None), next(records, None)
    if first is not None and second is None and isinstance(decoded(first)["content"], (dict, list)):
        out.write(as_json(decoded(first)["content"]))
        return
    out.write("[")
    between = "\n"
    for r in (x for x in (first, second) if x is not None):
        out.write(between + _indented(decoded(r)))
        between = ",\n"
    for r in records:
        out.write(between + _indented(decoded(r)))
    out.write("\n]" if first is not None else "]")


def _indented(value) -> str:
    return "\n".join("  " + line for line in as_json(value).split("\n"))


def write_markdown(records: Iterator[dict], out) -> None:
    for i, r in enumerate(records):
        out.write(("\n\n---\n\n" if i else "") + f"<!-- page {r['metadata'].get('page_number', i + 1)} -->\n" + (r["content"] or ""))


def write_folder(records: DataFrame, path: str, kind: str = "parquet") -> None:
    """The distributed sink: a file for each partition."""
    records.write.format(kind).mode("errorifexists").save(path)


def save_debug_images(images: DataFrame, folder: str, prefix: str) -> DataFrame:
    """Writes rasters (path, page_number, image) as PNG into a folder that all executors see; returns the files' names."""
    from ..shared import ship

    ship(images.sparkSession)

    def run(batches):
        import numpy as np

        for batch in batches:
            names = []
            for r in batch.to_pylist():
                x = r["image"]
                name = f"{folder}/{prefix}_p{r['page_number'] or 0}_{Path(r['path']).stem}.png"
                Path(folder).mkdir(parents=True, exist_ok=True)
                Path(name).write_bytes(kernels.encode_png(np.frombuffer(x["data"], np.uint8).reshape(x["height"], x["width"], x["nChannels"])))
                names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["file"])

    return images.where("image IS NOT NULL").select("path", "page_number", "image").mapInArrow(run, "file string")


def clear_model_cache(folder: Path | str | None = None) -> bool:
    """Removes the default cache; a folder of one's own is left alone."""
    if folder is not None and Path(folder) != MODEL_CACHE or not MODEL_CACHE.exists():
        return False
    shutil.rmtree(MODEL_CACHE)
    return True
