"""Winners, duplicates, split and sealed packages, version conflicts: keyed aggregates over class declarations.

Every aggregate here combines before its shuffle; none gathers the rows of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Descriptors of modules are no classes that could clash.
DESCRIPTOR = "module-info"


def first_by(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One whole row for each key: the first in ``order``. Null keys are a key; ties keep one of the equal rows."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*")


def first_few(df: DataFrame, keys: list[str], order: str, text: str, name: str, most: int = 20) -> DataFrame:
    """(keys, name): the texts of the first ``most`` rows of each key, in order, and how many more there are. No task gathers the rows of a key."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order, text))).where(F.col("__n") <= most)
    some = ranked.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("__n", text))), lambda x: x[text]).alias("__some"))
    more = df.groupBy(*keys).agg((F.count("*") - most).alias("__more"))
    rest = F.when(F.col("__more") > 0, F.array(F.concat_ws(" ", F.lit("and"), F.col("__more").cast("string"), F.lit("more")))).otherwise(F.array().cast("array<string>"))
    return some.join(more, keys).select(*keys, F.concat("__some", rest).alias(name))


def winners(classes: DataFrame) -> DataFrame:
    """The declaration that a JVM would load for each internal name: first by (position, ordinal)."""
    return first_by(classes, ["internal_name"], ["position", "ordinal"])


def duplicate_classes(classes: DataFrame) -> DataFrame:
    """(internal_name, verdict, claims, winner_position, winner_ordinal) of names with more than one declaration.

    ``identical``: one digest. ``unpredictable``: the winner came from a wildcard that also gave a different digest.
    ``differing`` otherwise. ``classes`` needs position, ordinal, internal_name, digest and wildcard_source.
    """
    place = F.struct("position", "ordinal")
    by_source = classes.where(F.col("internal_name") != DESCRIPTOR).groupBy("internal_name", "wildcard_source").agg(
        F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"), F.min(place).alias("first"), F.min_by("digest", place).alias("digest")
    )
    by_name = by_source.groupBy("internal_name").agg(
        F.sum("n").alias("claims"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min_by(F.struct("wildcard_source", "low", "high", "digest", "first"), "first").alias("w"),
    ).where("claims > 1")
    shared = F.col("w.wildcard_source").isNotNull() & ((F.col("w.low") != F.col("w.digest")) | (F.col("w.high") != F.col("w.digest")))
    verdict = F.when(F.col("low") == F.col("high"), "identical").when(shared, "unpredictable").otherwise("differing")
    return by_name.select("internal_name", verdict.alias("verdict"), "claims", F.col("w.first.position").alias("winner_position"), F.col("w.first.ordinal").alias("winner_ordinal"))


def contributors(classes: DataFrame) -> DataFrame:
    """(package, display, position): the artifacts that have classes of a package, each at its first position."""
    return classes.where(F.col("package").isNotNull()).groupBy("package", "display").agg(F.min("position").alias("position"))


def split_packages(classes: DataFrame) -> DataFrame:
    """(package, artifacts, first_position): packages with classes in more than one artifact."""
    return contributors(classes).groupBy("package").agg(F.count("*").alias("artifacts"), F.min("position").alias("first_position")).where("artifacts > 1")


def sealed_violations(classes: DataFrame, sealed: DataFrame) -> DataFrame:
    """(package, display, artifacts): sealed packages with more than one contributor, once for each sealing artifact. ``sealed(display, package)``."""
    return sealed.select("display", "package").distinct().join(split_packages(classes), "package").select("package", "display", "artifacts")


def version_conflicts(coordinates: DataFrame) -> DataFrame:
    """(identity, versions): artifacts in more than one version, versions sorted and with their first claimant.

    ``coordinates(position, display, group, artifact, version)``.
    """
    identity = F.concat_ws(":", F.coalesce("group", F.lit("")), "artifact").alias("identity")
    first = coordinates.groupBy(identity, "version").agg(F.min_by("display", "position").alias("display"), F.min("position").alias("position"))
    kinds = first.groupBy("identity").agg(F.count("*").alias("n"), F.min("position").alias("position"), F.sort_array(F.collect_list(F.struct("version", "display"))).alias("versions"))
    return kinds.where("n > 1").select("identity", "n", "position", "versions")
