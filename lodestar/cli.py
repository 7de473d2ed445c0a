"""The command line: check, baseline, inspect, explain, symbols. Exit status 0 is clean, 1 has findings, 2 is a refused invocation."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from lodestar import baseline as base
from lodestar import report
from lodestar.functions.catalog import CODES, explain
from lodestar.functions.names import suggestions, under_root
from lodestar.plans.inspection import inspect
from lodestar.plans.verification import Request, verify
from lodestar.sources.classpath import RefusedRun, classpath_list
from lodestar.sources.platform import make_table, profile_identity

CLEAN, FINDINGS, REFUSED = 0, 1, 2


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        known = [o for a in self._actions for o in a.option_strings]
        commands = [c for a in self._actions if isinstance(a, argparse._SubParsersAction) for c in a.choices]
        near = [s for w in sys.argv[1:] for s in suggestions(w.partition("=")[0], known + commands)]
        raise RefusedRun(message + (f"; did you mean {' or '.join(dict.fromkeys(near))}?" if near else ""))


def _request_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--application", action="append", required=True)
    p.add_argument("--classpath", action="append", default=[])
    p.add_argument("--target-java", type=int, required=True)
    p.add_argument("--enable-preview", action="store_true")
    p.add_argument("--scope", choices=["application", "all", "reachable"], default="application")
    p.add_argument("--jdk")
    p.add_argument("--symbols", help="platform symbols as a text table, or a folder of one for each release")
    p.add_argument("--path-root")


def parser() -> argparse.ArgumentParser:
    top = _Parser(prog="lodestar", allow_abbrev=False)
    sub = top.add_subparsers(dest="command", required=True, parser_class=_Parser)
    c = sub.add_parser("check", allow_abbrev=False)
    _request_options(c)
    c.add_argument("--baseline")
    c.add_argument("--prune-stale", action="store_true")
    c.add_argument("--fail-on", choices=["error", "warning", "never"], default="error")
    c.add_argument("--format", choices=["human", "json", "sarif"], default="human")
    c.add_argument("--output")
    c.add_argument("--source-root", action="append", default=[])
    b = sub.add_parser("baseline", allow_abbrev=False)
    _request_options(b)
    b.add_argument("--out", "--output", dest="out", required=True)
    i = sub.add_parser("inspect", allow_abbrev=False)
    i.add_argument("artifact")
    i.add_argument("--format", choices=["human", "json"], default="human")
    i.add_argument("--output")
    i.add_argument("--path-root")
    e = sub.add_parser("explain", allow_abbrev=False)
    e.add_argument("code", nargs="?")
    s = sub.add_parser("symbols", allow_abbrev=False)
    s.add_argument("--jdk", required=True)
    s.add_argument("--target-java", type=int, action="append", required=True)
    s.add_argument("--out", "--output", dest="out", required=True, help="folder of the tables")
    return top


def _request(a: argparse.Namespace) -> Request:
    classpath = [x for value in a.classpath for x in classpath_list(value)]
    return Request(tuple(a.application), tuple(classpath), a.target_java, a.enable_preview, a.scope.upper(), a.jdk, a.symbols)


def _emit(text: str, output: str | None) -> None:
    if output is None:
        sys.stdout.write(text)
        return
    Path(output).write_text(text, encoding="utf-8")
    print(f"wrote {output}", file=sys.stderr)


def _recorded(a: argparse.Namespace, prints: tuple[str, ...]) -> base.Baseline:
    return base.Baseline(a.target_java, "enabled" if a.enable_preview else "disabled", a.scope, profile_identity(a.target_java, a.jdk, a.symbols), prints)


def _check(a: argparse.Namespace, spark) -> int:
    if a.prune_stale and not a.baseline:
        raise RefusedRun("--prune-stale needs --baseline")
    result = verify(spark, _request(a))
    findings, suppressed, stale = result.findings, 0, []
    if a.baseline:
        accepted = base.parse(Path(a.baseline).read_text(encoding="utf-8"))
        for note in base.drift(accepted, _recorded(a, ())):
            print(f"warning: {note}", file=sys.stderr)
        findings, suppressed, stale = base.compare(findings, accepted, a.path_root)
        if a.prune_stale and (kept := base.pruned(accepted, stale)):
            Path(a.baseline).write_text(kept.text(), encoding="utf-8")
    from lodestar.operators.results import canonical_order

    rows = report.rooted(canonical_order(findings).collect(), None if a.format == "human" else a.path_root)  # bounded by the ceiling
    if a.format == "human":
        text = report.human(rows, result.analyzed_classes, result.analyzed_artifacts, suppressed, len(stale))
    elif a.format == "json":
        request = {"applications": a.application, "classpath": a.classpath, "targetJava": a.target_java, "preview": "enabled" if a.enable_preview else "disabled", "scope": a.scope}
        text = report.as_json(rows, request, result.analyzed_classes, result.analyzed_artifacts)
    else:
        text = report.sarif(rows, a.source_root)
    _emit(text, a.output)
    bad = {"error": {"ERROR"}, "warning": {"ERROR", "WARNING"}, "never": set()}[a.fail_on]
    return FINDINGS if any(r["severity"] in bad for r in rows) else CLEAN


def _baseline(a: argparse.Namespace, spark) -> int:
    prints = base.fingerprinted(verify(spark, _request(a)).findings, a.path_root).select("fingerprint").distinct()
    _emit(_recorded(a, tuple(r["fingerprint"] for r in prints.collect())).text(), a.out)
    return CLEAN


def _inspect(a: argparse.Namespace) -> int:
    facts = inspect(a.artifact)
    facts["artifact"] = under_root(a.path_root, facts["artifact"])
    if a.format == "json":
        text = json.dumps(facts, indent=2) + "\n"
    else:
        width = max(map(len, facts))
        text = "".join(f"{k.replace('_', ' '):<{width}}  {', '.join(map(str, v)) or '-' if isinstance(v, list) else v}\n" for k, v in facts.items())
    _emit(text, a.output)
    return CLEAN


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        a = parser().parse_args(argv)
        if a.command == "explain":
            try:
                print(explain(a.code))
            except KeyError:
                near = suggestions(a.code, list(CODES))
                raise RefusedRun(f"unknown code {a.code}" + (f"; did you mean {' or '.join(near)}?" if near else "")) from None
            return CLEAN
        if a.command == "inspect":
            return _inspect(a)
        if spark is None:
            from lodestar.session import session

            spark = session("lodestar")
        if a.command == "symbols":
            for release in a.target_java:
                print(f"wrote {make_table(spark, a.out, release, a.jdk)}", file=sys.stderr)
            return CLEAN
        return _check(a, spark) if a.command == "check" else _baseline(a, spark)
    except (RefusedRun, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return REFUSED


if __name__ == "__main__":
    sys.exit(main())
