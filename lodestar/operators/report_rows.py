"""Findings as rows of JSON and SARIF 2.1.0, made in tasks: what the driver's reports hold, for any number of findings.

Source roots are folders of the machine that writes a report, so results name artifacts here; see ``report`` for the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar import schema
from lodestar.functions.names import markdown
from lodestar.operators.duplicates import first_by

#: How the evidence line begins that holds a proof chain.
CHAIN = "reachable via: "
_ALL = {"ignoreNullFields": "false"}


def _json(**members: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in members.items()]), _ALL)


def json_rows(findings: DataFrame) -> DataFrame:
    """``findings`` with ``value``: each as a JSON object with the members of a finding, nulls kept."""
    return findings.withColumn("value", F.to_json(F.struct(*schema.FINDING_COLUMNS), _ALL))


def sarif_rows(findings: DataFrame) -> DataFrame:
    """``findings`` with ``value``: each as a SARIF result; a proof chain among its evidence becomes its code flow."""
    struct = lambda **m: F.struct(*[c.alias(n) for n, c in m.items()])
    level = F.when(F.col("severity") == "INFO", "note").otherwise(F.lower("severity"))
    evidence, remediation = (F.coalesce(c, F.array().cast("array<string>")) for c in ("evidence", "remediation"))
    place = struct(physicalLocation=struct(artifactLocation=struct(uri=F.col("location.artifact"))), logicalLocations=F.array(struct(fullyQualifiedName=F.col("subject"))))
    members = {
        "ruleId": F.col("code"), "level": level, "message": struct(text=F.col("summary"), markdown=markdown(F.col("summary"))), "locations": F.array(place),
        "properties": struct(evidence=evidence, remediation=remediation, predictedError=F.col("predicted_error")),
    }
    chain = F.get(F.filter(evidence, lambda e: e.startswith(CHAIN)), F.lit(0))
    steps = F.transform(F.split(F.substr(chain, F.lit(len(CHAIN) + 1)), " -> "), lambda s: struct(location=struct(message=struct(text=s))))
    flows = F.array(struct(threadFlows=F.array(struct(locations=steps))))
    return findings.withColumn("value", F.when(chain.isNull(), _json(**members)).otherwise(_json(**members, codeFlows=flows)))


def sarif_rules(findings: DataFrame, order: list[str]) -> DataFrame:
    """(code, value): a SARIF rule for each code, with the texts of its first finding in ``order``."""
    first = first_by(findings.select("code", *order, "summary", "explanation"), ["code"], order)
    text = lambda c: F.struct(F.col(c).alias("text"))
    return first.select("code", _json(id=F.col("code"), shortDescription=text("summary"), fullDescription=text("explanation")).alias("value"))


def write_lines(rows: DataFrame, order: list[str], folder: str) -> None:
    """``value`` of all rows as lines of text files, whose names follow the order."""
    rows.orderBy(*order).select("value").write.mode("overwrite").text(folder)
