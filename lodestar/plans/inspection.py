"""Inspection of one artifact: counts, level histogram, services and versions."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.session import as_arrow, mapped
from lodestar.sources.archive import SERVICES, VERSIONS, Budget, Contents, contents_of, with_content
from lodestar.sources.classfile import version
from lodestar.sources.classpath import NESTED_SUFFIXES, RefusedRun

SUMMARY = "artifact string, entry_count int, class_count int, nested_archive_count int, bytecode_levels array<string>, declared_services array<string>, multi_release_versions array<int>"


def level_histogram(classes: DataFrame) -> DataFrame:
    """(position, class_count, bytecode_levels): classes of each artifact by class file version."""
    counted = classes.groupBy("position", "major").agg(F.count("*").alias("n"))
    text = lambda x: F.concat_ws(":", x["major"].cast("string"), x["n"].cast("string"))
    levels = F.sort_array(F.collect_list(F.struct("major", "n")))
    return counted.groupBy("position").agg(F.sum("n").alias("class_count"), levels.alias("levels")).select("position", "class_count", F.array_join(F.transform("levels", text), ",").alias("bytecode_levels"))


def inspect(path: str, budget: Budget = Budget()) -> dict:
    """Facts of one archive or folder, read here; of classes only the first eight bytes count."""
    if not os.path.exists(path):
        raise RefusedRun(f"no such artifact: {path}")
    raw = None
    if not os.path.isdir(path):
        with open(path, "rb") as f:
            raw = f.read()
    return _summary(path, _opened(path, raw, budget))


def _opened(path: str, raw: bytes | None, budget: Budget) -> Contents:
    return contents_of({"kind": "DIRECTORY" if raw is None else "ARCHIVE", "display": path, "path": path}, raw, budget)[0]


def _summary(path: str, contents: Contents) -> dict:
    levels: Counter[int] = Counter()
    names = contents.names
    for n in names:
        if n.endswith(".class") and (got := version(contents.head(n, 8))):
            levels[got[0]] += 1
    steps = {n[len(VERSIONS) :].partition("/")[0] for n in names if n.startswith(VERSIONS)}
    return {
        "artifact": path, "entry_count": len(names), "class_count": sum(n.endswith(".class") for n in names), "nested_archive_count": sum(n.endswith(NESTED_SUFFIXES) for n in names),
        "bytecode_levels": [f"{m}:{n}" for m, n in sorted(levels.items())], "declared_services": sorted({n[len(SERVICES) :] for n in names if n.startswith(SERVICES) and "/" not in n[len(SERVICES) :]}),
        "multi_release_versions": sorted(int(s) for s in steps if s.isascii() and s.isdigit() and int(s) >= 9),
    }


def inspection(spark: SparkSession, paths: list[str], budget: Budget = Budget()) -> DataFrame:
    """``SUMMARY`` rows with a ``refusal``: one for each path, read by one task.

    An artifact that cannot be read, or is over the budget, has its name and the refusal only. A path that is named
    twice has two rows. Folders are opened by the tasks, so they must be mounted wherever executors run.
    """
    for p in paths:
        if not os.path.exists(p):
            raise RefusedRun(f"no such artifact: {p}")
    listed = spark.createDataFrame([(os.path.abspath(p), p) for p in paths], "file string, artifact string")
    ddl = f"{SUMMARY}, refusal string"
    wanted = pa.schema(as_arrow(ddl))

    def facts(path: str, raw: bytes | None) -> dict:
        try:
            return _summary(path, _opened(path, raw, budget))
        except RefusedRun as e:
            return dict.fromkeys(wanted.names) | {"artifact": path, "refusal": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist([facts(batch.column("artifact")[k].as_py(), batch.column("content")[k].as_py())], wanted)

    rows = with_content(listed, sorted({os.path.abspath(p) for p in paths if not os.path.isdir(p)}))
    return mapped(rows.repartition(max(1, len(paths)), "file"), run, ddl)
