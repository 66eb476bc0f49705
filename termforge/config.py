"""Settings shared by all operators, and how the package reaches Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "_termforge_shipped"
_WRITTEN: list[str] = []


@dataclass(frozen=True)
class Settings:
    """Constants of the weekly engine; every operator takes them as parameters too."""

    decay: float = 1.95
    horizons: tuple[int, ...] = (1, 2, 4, 9, 13, 26)
    maturities: tuple[int, ...] = (1, 2, 3, 4, 5, 6)
    thresholds: tuple[float, ...] = (0.02, 0.05, 0.08, 0.10)
    ew_decay: float = 0.997
    ew_grid: tuple[float, ...] = (0.90, 0.93, 0.95, 0.97, 0.98, 0.985, 0.99, 0.993, 0.995, 0.996, 0.997, 0.998, 0.999, 0.9995, 1.0)
    inventory_lag: int = 2
    train_end: date = date(1999, 12, 31)
    test_start: date = date(2000, 1, 1)
    shock: date = date(2001, 1, 1)
    change_weeks: tuple[int, ...] = (1, 4, 13, 26)
    z_window: int = 52
    z_min: int = 26
    models: dict = field(default_factory=lambda: {0: "random walk", 1: "direct autoregression", 2: "local projection", 3: "weighted local projection"})


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once; needed where it isn't installed on them."""
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="termforge-"), "termforge.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("termforge", os.path.relpath(full, top)))
    context.addPyFile(path)
    setattr(context, _SHIPPED, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A path that no other run uses in the folder that driver and executors share, spark.checkpoint.dir.

    Where that is unset, a session in one process gets a folder of its own, and any other an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "/tmp/checkpoints"
    path = f"{folder.rstrip('/')}/termforge/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete what this process wrote into the shared folder, for callers that have consumed the results."""
    while _WRITTEN:
        where = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: its plan is done once, and a lost executor costs a re-read."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
