"""Bytecode levels and layout: filters and small aggregates over class declarations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Class file version of Java 0; a release's version is this much above it.
VERSION_BASE = 44
PREVIEW_MINOR = 0xFFFF


def newer_than_target(classes: DataFrame, release: int) -> DataFrame:
    """Classes compiled for a later release than ``release``."""
    return classes.where(F.col("major") > VERSION_BASE + release)


def invalid_preview(classes: DataFrame, release: int, preview: bool) -> DataFrame:
    """Preview classes that this runtime refuses; one may also be newer than the target."""
    fits = F.lit(preview) & (F.col("major") == VERSION_BASE + release)
    return classes.where((F.col("minor") == PREVIEW_MINOR) & ~fits)


def mixed_levels(classes: DataFrame) -> DataFrame:
    """(position, levels): artifacts with classes of several releases, as sorted (major, count)."""
    counted = classes.groupBy("position", "major").agg(F.count("*").alias("n"))
    levels = counted.groupBy("position").agg(F.sort_array(F.collect_list(F.struct("major", "n"))).alias("levels"))
    return levels.where(F.size("levels") > 1)


def empty_roots(entries: DataFrame, classes: DataFrame, faults: DataFrame) -> DataFrame:
    """Application entries without a class and without a fault of the scan."""
    return entries.where(F.col("origin") == "APPLICATION").join(classes.select("position").distinct(), "position", "left_anti").join(faults.select("position").distinct(), "position", "left_anti")


def version_pick(versions: DataFrame, release: int) -> DataFrame:
    """(position, base_name, entry_name, version): of each base name the highest version from 9 to ``release``, else the base entry.

    ``versions(position, base_name, version, entry_name)``, version 0 for base entries. Of entries that share a version
    the first by name is taken.
    """
    seen = versions.where((F.col("version") == 0) | F.col("version").between(9, release))
    best = F.min_by(F.struct("entry_name", "version"), F.struct(-F.col("version"), "entry_name")).alias("b")
    return seen.groupBy("position", "base_name").agg(best).select("position", "base_name", "b.entry_name", "b.version")
