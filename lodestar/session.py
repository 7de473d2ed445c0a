"""Session helpers of the engine."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestar import schema

_PACKAGE = Path(__file__).resolve().parent


def session(name: str = "lodestar", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; settings that are given win."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Python workers import the package, also where they do not share the driver's folders."""
    sc, root = spark.sparkContext, str(_PACKAGE.parent)
    if getattr(sc, "_lodestar_shipped", False) or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    target = Path(tempfile.mkdtemp(prefix="lodestar-")) / "lodestar_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent).as_posix())
    sc.addPyFile(str(target))
    sc._lodestar_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints, which ``spark.checkpoint.dir`` names. Only a session of one machine gets a temporary one where none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestar-cp-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    Its files go when the driver no longer refers to the frame, if ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is on; else they stay.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Grown:
    """A table that grows by durable parts; a part is written once, and all of them together only now and then."""

    def __init__(self, first: DataFrame, most: int = 8) -> None:
        self.parts, self.most = [first], most

    def add(self, part: DataFrame) -> None:
        self.parts.append(part)
        if len(self.parts) > self.most:
            self.parts = [durable(self.all())]

    def all(self) -> DataFrame:
        return reduce(DataFrame.union, self.parts)


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """``mapInArrow`` with the package shipped to the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, ddl)


def as_arrow(ddl: str) -> pa.Schema:
    """The Arrow schema of a schema string."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema.struct(ddl))
