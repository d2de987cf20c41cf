"""The fused image stage: decode, preprocess, encode and call in one pass, so that pixels never cross a shuffle."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import EngineConfig, ParsingMode
from ..functions import kernels
from ..shared import ship
from ..sources import recognizer as rec
from .model import Client, bounded, python_transcription
from .reflect import reflect

ADDED = "content string, error string, processing_time double, reflect_iterations int, final_critic_score int, final_critic_issues array<string>"
_KINDS = {"content": pa.string(), "error": pa.string(), "processing_time": pa.float64(), "reflect_iterations": pa.int32(), "final_critic_score": pa.int32(), "final_critic_issues": pa.list_(pa.string())}
#: Arrow batches are bounded in bytes: rasters are large, and rows say nothing of that.
BATCH_BYTES = 64 << 20
#: Rows of a batch that are unpacked, worked on and sent on at once.
ROWS = 64


def raster(image: dict) -> np.ndarray:
    x = np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"])
    return np.repeat(x, 3, 2) if x.shape[2] == 1 else np.ascontiguousarray(x[..., :3])


def call_once(client: Client, image: np.ndarray, config: EngineConfig, schema) -> str:
    """One model call for one page: the text in the reply's tags, or the parsed answer as JSON."""
    b64, mime = kernels.encode_base64(image)
    reply = client.invoke(b64, mime, system_prompt=config.system_prompt, schema=schema)
    if schema is not None:
        parsed = (reply or {}).get("parsed")
        return parsed if isinstance(parsed, str) else "" if parsed is None else json.dumps(parsed, separators=(",", ":"), ensure_ascii=False)
    return python_transcription(((reply or {}).get("content") or "").strip())


def _keep_debug(image: np.ndarray, config: EngineConfig, prefix: str, row: dict) -> None:
    """What goes on to recognition, as a PNG in the debug folder, where one is set."""
    if config.debug_dir:
        folder = Path(config.debug_dir)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{Path(row.get('path') or 'image').stem}_{prefix}_p{row.get('page_number') or 0}_0.png").write_bytes(kernels.encode_png(image))


def run_stage(images: DataFrame, mode: ParsingMode, config: EngineConfig, transport=None, build_recognizer: Callable[[], rec.Recognizer] | None = None, schema=None, from_pdf: bool = False, progress: list | None = None) -> DataFrame:
    """Adds content, error and what the loop tells to rows that have an `image`, which goes.

    progress: a list that gets the accumulator of finished pages in place of its first element.
    """
    spark = images.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if mode == ParsingMode.BASIC_OCR:
        build_recognizer = build_recognizer or rec.default_builder(config)
        key, at_once = rec.session_key(config, build_recognizer), 1  # a task works on one page at a time: it has one core, and a page's arrays are large
    else:  # the model's server is called for so many pages at once, however many executors there are
        images, key, at_once = images.coalesce(max(1, config.max_concurrency)), "", 1
    done_pages = spark.sparkContext.accumulator(0) if progress else None
    rest = [f for f in images.schema if f.name not in ("image", "error")]

    def one(row: dict) -> dict:
        out = dict.fromkeys(_KINDS)
        began = time.monotonic()
        try:
            if row["error"]:
                raise RuntimeError(row["error"])
            image = raster(row["image"])
            if mode == ParsingMode.BASIC_OCR:
                if not from_pdf or config.preprocess_pdf_ocr:  # pages of documents are recognised as they are
                    image = kernels.preprocess_for_ocr(image, config)
                    _keep_debug(image, config, "ocr", row)
                out["content"] = rec.assemble(rec.session(key, build_recognizer)(image))
            else:
                image = kernels.preprocess_for_vlm(image, config)
                _keep_debug(image, config, "vlm", row)
                client = Client(transport, config)
                if mode == ParsingMode.VLM:
                    out["content"] = call_once(client, image, config, schema)
                else:
                    state = reflect(client, *kernels.encode_base64(image), config.system_prompt, config.max_reflect_cycles)
                    out |= {"content": state["accumulated_text"], "reflect_iterations": state["reflect_iteration"], "final_critic_score": state["critic_score"], "final_critic_issues": state["critic_issues"]}
        except Exception as failure:  # noqa: BLE001 - one page's failure leaves the others alone
            out["error"] = row["error"] or f"{type(failure).__name__}: {failure}"
        return out | {"processing_time": time.monotonic() - began}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS)):
                done = bounded(one, batch.select([n for n in ("path", "page_number", "image", "error") if n in batch.schema.names]).to_pylist(), at_once)
                if done_pages is not None:
                    done_pages.add(len(done))
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in rest], *[pa.array([d[k] for d in done], t) for k, t in _KINDS.items()]], [*[f.name for f in rest], *_KINDS])

    if progress:
        progress[0] = done_pages
    return images.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [ADDED]))


def kernel_stage(images: DataFrame, kernel: Callable[[np.ndarray], dict], schema: str, keep: list[str]) -> DataFrame:
    """Any NumPy kernel over rasters: its dict of plain values beside some columns."""
    ship(images.sparkSession)
    images.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    names = [p.strip().split(" ")[0] for p in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS)):
                got = [kernel(raster(i)) for i in batch.column("image").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], *[pa.array([g[n] for g in got]) for n in names]], [*keep, *names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema if f.name in keep)
    return images.select(*keep, "image").mapInArrow(run, f"{kept}, {schema}")
