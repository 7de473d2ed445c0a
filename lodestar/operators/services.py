"""Service providers: lines of provider files against declared types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.duplicates import first_by
from lodestar.operators.hierarchy import supertype_walk
from lodestar.operators.linkage import INTERFACE, PUBLIC, has

ABSTRACT = 0x400
#: The fault of a provider that nothing can create.
CONSTRUCTOR = "no public constructor without arguments"
_START, _PART = r"\p{javaJavaIdentifierStart}", r"\p{javaJavaIdentifierPart}"
LEGAL_NAME = f"^{_START}{_PART}*(\\.{_START}{_PART}*)*$"


def legal_name(name: Column) -> Column:
    """Dotted Java identifiers without an empty segment."""
    return name.rlike(LEGAL_NAME)


def provider_lines(files: DataFrame, text: str = "text") -> DataFrame:
    """``files(...)`` with line_number (from 1) and declared_name for each line that holds something.

    Lines end at a carriage return, a line feed or both; a comment begins at the first ``#``; white space of any kind
    goes at both ends; what is left empty is no line.
    """
    keep = [c for c in files.columns if c != text]
    lines = files.select(*keep, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\r\n|\r|\n")).alias("__i", "__line"))
    name = F.regexp_replace(F.substring_index("__line", "#", 1), r"(?U)^\s+|\s+$", "")
    return lines.select(*keep, (F.col("__i") + 1).alias("line_number"), name.alias("declared_name")).where("declared_name <> ''")


def repeated_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Legal names that one file (``keys``) lists more than once, with how often and where first."""
    return lines.where(legal_name(F.col("declared_name"))).groupBy(*keys, "declared_name").agg(F.count("*").alias("times"), F.min("line_number").alias("line_number")).where("times > 1")


def malformed_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines that are no legal name; of equal ones in a file the first."""
    return first_by(lines.where(~legal_name(F.col("declared_name"))), [*keys, "declared_name"], ["line_number"])


def internal(name: Column) -> Column:
    return F.translate(name, ".", "/")


def instantiability_faults(access: Column, members: Column) -> Column:
    """What keeps a provider from being created: an interface, or any of abstract, not public, no public constructor."""
    constructor = F.exists(members, lambda m: (m["name"] == "<init>") & (m["descriptor"] == "()V") & (m["access"].bitwiseAND(PUBLIC) != 0))
    others = F.filter(F.array(F.when(has(access, ABSTRACT), "abstract"), F.when(~has(access, PUBLIC), "not public"), F.when(~F.coalesce(constructor, F.lit(False)), CONSTRUCTOR)), lambda x: x.isNotNull())
    return F.when(has(access, INTERFACE), F.array(F.lit("an interface"))).otherwise(others)


def provider_verdicts(types: DataFrame, declared: DataFrame, lines: DataFrame) -> DataFrame:
    """``lines(service_name, declared_name, ...)``, legal ones, with missing, wrong_type and faults.

    ``declared(name)`` are all names that something declares, readable or not. The service must be declared, and all of
    the provider's supertypes must resolve, before another type is held against it.
    """
    names = declared.select("name").distinct()
    j = lines.withColumn("provider", internal(F.col("declared_name"))).withColumn("service", internal(F.col("service_name")))
    walk = supertype_walk(types, j.select(F.col("provider").alias("name"))).select(F.col("start").alias("provider"), F.col("names").alias("__names"), F.col("resolved").alias("__resolved"))
    j = j.join(names.select(F.col("name").alias("provider"), F.lit(True).alias("__known")), "provider", "left")
    j = j.join(names.select(F.col("name").alias("service"), F.lit(True).alias("__service")), "service", "left").join(walk, "provider", "left")
    j = j.join(types.select(F.col("name").alias("provider"), "access", "members"), "provider", "left")
    wrong = F.coalesce(F.col("__service") & F.col("__resolved") & ~F.array_contains("__names", F.col("service")), F.lit(False))
    faults = F.when(F.col("access").isNotNull(), instantiability_faults(F.col("access"), F.col("members"))).otherwise(F.array().cast("array<string>"))
    return j.withColumn("missing", F.col("__known").isNull()).withColumn("wrong_type", wrong).withColumn("faults", faults).drop("__known", "__service", "__names", "__resolved", "access", "members")

