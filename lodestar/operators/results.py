"""Findings as a set: canonical order, fingerprints, baselines and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import durable


def canonical_order(findings: DataFrame, ordinal: str | None = None) -> DataFrame:
    """By artifact, code, subject, class entry, summary; equal ones as they were produced. Strings by UTF-16 units, as Java does."""
    utf16 = lambda c: F.encode(F.coalesce(c, F.lit("")), "UTF-16BE")
    keys = [utf16(F.col(c)) for c in ("location.artifact", "code", "subject", "location.class_entry", "summary")]
    return findings.orderBy(*keys, *([ordinal] if ordinal else []))


def placed(findings: DataFrame, ordinal: str | None = None) -> DataFrame:
    """Findings with ``place`` from 1 in canonical order: ranges are sorted by tasks, their sizes give where each begins."""
    ordered = durable(canonical_order(findings, ordinal).withColumn("__id", F.monotonically_increasing_id()))
    part, inside = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = ordered.groupBy(part.alias("__part")).count()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = sizes.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    return ordered.withColumn("__part", part).join(F.broadcast(base), "__part").withColumn("place", F.col("__base") + inside + 1).drop("__id", "__part", "__base")


def fingerprint(code: Column, artifact: Column, entry: Column, subject: Column) -> Column:
    """What a baseline knows of a finding; no severity, line or evidence."""
    return F.concat_ws("|", code, artifact, F.coalesce(entry, F.lit("")), subject)


def new_findings(findings: DataFrame, accepted: DataFrame) -> DataFrame:
    """Findings whose fingerprint is not accepted; repeats all stay."""
    return findings.join(accepted.select("fingerprint").distinct(), "fingerprint", "left_anti")


def suppressed_findings(findings: DataFrame, accepted: DataFrame) -> DataFrame:
    return findings.join(accepted.select("fingerprint").distinct(), "fingerprint", "left_semi")


def stale_fingerprints(findings: DataFrame, accepted: DataFrame) -> DataFrame:
    """Accepted fingerprints that occur no more."""
    return accepted.select("fingerprint").distinct().join(findings.select("fingerprint").distinct(), "fingerprint", "left_anti")


def severity_counts(findings: DataFrame) -> DataFrame:
    """One row: info, warning, error and total."""
    one = lambda s: F.count_if(F.col("severity") == s).alias(s.lower())
    return findings.agg(one("INFO"), one("WARNING"), one("ERROR"), F.count("*").alias("total"))
