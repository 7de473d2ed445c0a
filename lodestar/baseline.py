"""Accepted findings: a JSON document of fingerprints, compared, pruned and checked for drift."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.names import measured
from lodestar.operators import results

VERSION = "1"
# The members of a baseline document and their kinds.
MEMBERS = {"version": str, "targetJava": int, "preview": str, "scope": str, "profile": str, "fingerprints": list}


@dataclass(frozen=True)
class Baseline:
    target_java: int
    preview: str
    scope: str
    profile: str
    fingerprints: tuple[str, ...]

    def text(self) -> str:
        return json.dumps({"version": VERSION, "targetJava": self.target_java, "preview": self.preview, "scope": self.scope, "profile": self.profile, "fingerprints": sorted(set(self.fingerprints))}, indent=2) + "\n"


def _plain(x: object) -> bool:
    """Whether a document holds strings, whole numbers, arrays and objects only."""
    if isinstance(x, dict):
        return all(map(_plain, x.values()))
    return all(map(_plain, x)) if isinstance(x, list) else isinstance(x, str) or type(x) is int


def parse(text: str) -> Baseline:
    """A baseline document; anything else is refused with the reason."""
    try:
        d = json.loads(text, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)), parse_float=lambda x: (_ for _ in ()).throw(ValueError(x)))
    except ValueError as e:
        raise ValueError(f"no baseline: {e}") from e
    if not isinstance(d, dict) or not _plain(d):
        raise ValueError("no baseline: not an object of strings, whole numbers, arrays and objects")
    for name, kind in MEMBERS.items():
        if not isinstance(d.get(name), kind) or isinstance(d.get(name), bool):
            raise ValueError(f"no baseline: {name} is missing or of another kind")
    if d["version"] != VERSION or not all(isinstance(x, str) for x in d["fingerprints"]):
        raise ValueError("no baseline: unknown version, or a fingerprint that is no string")
    return Baseline(d["targetJava"], d["preview"], d["scope"], d["profile"], tuple(sorted(set(d["fingerprints"]))))


def fingerprinted(findings: DataFrame, root: str | None = None) -> DataFrame:
    """Findings with their fingerprint; artifacts relative to ``root``."""
    artifact = F.col("location.artifact")
    return findings.withColumn("fingerprint", results.fingerprint(F.col("code"), measured(artifact, root) if root else artifact, F.col("location.class_entry"), F.col("subject")))


def drift(accepted: Baseline, now: Baseline) -> list[str]:
    """What differs between the run that was accepted and this one; it is told, and the baseline still applies."""
    return [f"the baseline was recorded with {name} {a}, this run has {b}" for name, a, b in (("target", accepted.target_java, now.target_java), ("preview", accepted.preview, now.preview), ("scope", accepted.scope, now.scope), ("profile", accepted.profile, now.profile)) if a != b]


def compare(findings: DataFrame, accepted: Baseline, root: str | None = None) -> tuple[DataFrame, int, list[str]]:
    """New findings, how many were suppressed, and stale fingerprints."""
    spark = findings.sparkSession
    f = fingerprinted(findings, root)
    a = spark.createDataFrame([(x,) for x in accepted.fingerprints], "fingerprint string")
    stale = [r["fingerprint"] for r in results.stale_fingerprints(f, a).orderBy("fingerprint").collect()]
    return results.new_findings(f, a).drop("fingerprint"), results.suppressed_findings(f, a).count(), stale


def pruned(accepted: Baseline, stale: list[str]) -> Baseline | None:
    """The baseline without stale fingerprints; None where there are none. It never grows."""
    gone = set(stale)
    if not gone:
        return None
    return Baseline(accepted.target_java, accepted.preview, accepted.scope, accepted.profile, tuple(x for x in accepted.fingerprints if x not in gone))
