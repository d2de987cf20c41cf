"""What all executors share: the folder in spark.checkpoint.dir and this package's code."""

from __future__ import annotations

import atexit
import io
import pathlib
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, as in tests, a temporary one of a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    made = getattr(spark.sparkContext, "_pagemill_dir", None)
    if made is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="pagemill-")
        atexit.register(shutil.rmtree, base, True)
        made = spark.sparkContext._pagemill_dir = f"file://{base}"
        spark.sparkContext.setCheckpointDir(made)
    return made


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once a session, through the shared folder."""
    sc = spark.sparkContext
    if getattr(sc, "_pagemill_shipped", False):
        return
    here = pathlib.Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/pagemill-{uuid.uuid4().hex}.zip")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(bytearray(packed.getvalue()))
    finally:
        out.close()
    sc.addPyFile(path.toString())
    sc._pagemill_shipped = True


def stored(df: DataFrame, name: str) -> DataFrame:
    """Rows written once to the shared folder, for what must not be computed again: calls of a model, and plans that are read many times."""
    ship(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
