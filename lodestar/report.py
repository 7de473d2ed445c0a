"""Findings as text, JSON and SARIF 2.1.0. Reports hold at most the ceiling of findings and are made on the driver."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Row

from lodestar.functions.names import Respelling, under_root

TOOL = {"name": "lodestar", "version": "1"}


def _plural(n: int, one: str, many: str) -> str:
    return f"{n} {one if n == 1 else many}"


def rooted(rows: list[Row], root: str | None) -> list[dict]:
    """Findings as dicts with artifact paths relative to the root, also where evidence names them."""
    out = [r.asDict(True) for r in rows]
    names = {d["location"]["artifact"]: under_root(root, d["location"]["artifact"]) for d in out}
    spelling = Respelling(names)
    for d in out:
        d["location"]["artifact"] = names[d["location"]["artifact"]]
        for c in ("evidence", "remediation"):
            d[c] = [spelling.of(x) for x in d[c] or []]
        d["summary"] = spelling.of(d["summary"])
    return out


def counts(findings: list[dict]) -> dict[str, int]:
    return {s.lower(): sum(f["severity"] == s for f in findings) for s in ("INFO", "WARNING", "ERROR")} | {"total": len(findings)}


def human(findings: list[dict], classes: int, artifacts: int, suppressed: int = 0, stale: int = 0) -> str:
    """A block for each finding, then a line of counts."""
    analyzed = f"analyzed {_plural(classes, 'class', 'classes')} across {_plural(artifacts, 'artifact', 'artifacts')}"
    lines: list[str] = []
    for f in findings:
        at = f["location"]
        lines.append(f"{f['severity']} {f['code']} {f['summary']}")
        place = at["artifact"] + (f"!/{at['class_entry']}" if at["class_entry"] else "")
        if at["source_file"]:
            place += f" ({at['source_file']}{':' + str(at['line']) if at['line'] else ''})"
        lines += [f"  at {place}"] + ([f"  predicts {f['predicted_error']}"] if f["predicted_error"] else []) + [f"  - {e}" for e in f["evidence"]] + [f"  > {r}" for r in f["remediation"]] + [""]
    n = counts(findings)
    told = ", ".join([_plural(n["error"], "error", "errors"), _plural(n["warning"], "warning", "warnings"), f"{n['info']} info"]) if findings else "no findings"
    notes = ([f"{suppressed} suppressed by the baseline"] if suppressed else []) + ([f"{_plural(stale, 'stale baseline entry', 'stale baseline entries')}"] if stale else [])
    return "\n".join([*lines, "; ".join([f"{told} — {analyzed}", *notes])]) + "\n"


def as_json(findings: list[dict], request: dict, classes: int, artifacts: int) -> str:
    summary = counts(findings) | {"analyzedClasses": classes, "analyzedArtifacts": artifacts}
    return json.dumps({"version": "1", "tool": TOOL, "request": request, "findings": findings, "summary": summary}, indent=2, ensure_ascii=False) + "\n"


def markdown(text: str) -> str:
    return re.sub(r"([\\`*_\[\]<>#])", r"\\\1", text)


def _source(at: dict, roots: list[str]) -> str | None:
    """The source file of a class entry under the first root that holds it."""
    if not at["class_entry"] or not at["source_file"]:
        return None
    path = os.path.join(os.path.dirname(at["class_entry"]), at["source_file"])
    return next((os.path.join(r, path) for r in roots if os.path.isfile(os.path.join(r, path))), None)


def _result(f: dict, roots: list[str]) -> dict:
    at = f["location"]
    source = _source(at, roots)
    physical = {"artifactLocation": {"uri": (source or at["artifact"]).replace(os.sep, "/")}}
    if source and at["line"]:
        physical["region"] = {"startLine": at["line"]}
    out = {
        "ruleId": f["code"], "level": {"INFO": "note", "WARNING": "warning", "ERROR": "error"}[f["severity"]],
        "message": {"text": f["summary"], "markdown": markdown(f["summary"])},
        "locations": [{"physicalLocation": physical, "logicalLocations": [{"fullyQualifiedName": f["subject"]}]}],
        "properties": {"evidence": f["evidence"], "remediation": f["remediation"], "predictedError": f["predicted_error"]},
    }
    chain = next((e[len("reachable via: ") :] for e in f["evidence"] if e.startswith("reachable via: ")), None)
    if chain:
        out["codeFlows"] = [{"threadFlows": [{"locations": [{"location": {"message": {"text": step}}} for step in chain.split(" -> ")]}]}]
    return out


def sarif(findings: list[dict], roots: list[str] = ()) -> str:
    """Rules by code, with the first summary of each, and a result for each finding."""
    rules: dict[str, dict] = {}
    for f in findings:
        rules.setdefault(f["code"], {"id": f["code"], "shortDescription": {"text": f["summary"]}, "fullDescription": {"text": f["explanation"]}})
    run = {"tool": {"driver": TOOL | {"rules": [rules[c] for c in sorted(rules)]}}, "results": [_result(f, list(roots)) for f in findings]}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, indent=2, ensure_ascii=False) + "\n"
