"""Verification of an application: scan, facts, the ten families of checks, ordered findings.

The driver expands the classpath; archives are scanned by tasks; every check is a DataFrame over the facts. Findings are a
DataFrame of ``schema.FINDING`` rows in canonical order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import schema
from lodestar.functions.catalog import CODES
from lodestar.functions.names import binary_name, package_of
from lodestar.operators import duplicates, levels, linkage, modules, proof, reachability, results, services
from lodestar.session import durable
from lodestar.sources import archive, classpath, platform


@dataclass(frozen=True)
class Request:
    applications: tuple[str, ...]
    classpath: tuple[str, ...] = ()
    release: int = 17
    preview: bool = False
    scope: str = "APPLICATION"
    jdk_home: str | None = None
    symbol_table: str | None = None

    def __post_init__(self) -> None:
        if not self.applications:
            raise ValueError("at least one application is needed")
        if self.release < 8:
            raise ValueError("releases before 8 are not analysed")
        if self.scope not in schema.SCOPES:
            raise ValueError(f"scope must be one of {schema.SCOPES}")


@dataclass
class Facts:
    entries: DataFrame
    classes: DataFrame
    scanned: DataFrame
    platform: DataFrame
    expansion: classpath.Expansion


@dataclass
class Result:
    findings: DataFrame
    analyzed_classes: int
    analyzed_artifacts: int

    def has_errors(self) -> bool:
        return not self.findings.where("severity = 'ERROR'").isEmpty()


def read_facts(spark: SparkSession, request: Request, budget: archive.Budget = archive.Budget()) -> Facts:
    expansion = classpath.expand(list(request.applications), list(request.classpath), budget)
    symbols = durable(platform.platform_classes(spark, request.release, request.jdk_home, request.symbol_table))
    if symbols.where("internal_name = 'java/lang/Object'").isEmpty():
        raise classpath.RefusedRun(f"the platform symbols for release {request.release} do not describe java/lang/Object")
    if expansion.declared > budget.expanded_bytes:
        raise classpath.RefusedRun(f"the run expands to more than {budget.expanded_bytes} bytes")
    scanned = durable(archive.scan_entries(spark, expansion.entries, request.release, budget))
    archive.refuse(scanned, budget)
    entries = spark.createDataFrame([{k: e[k] for k in schema.struct(schema.CLASSPATH_ENTRY).fieldNames()} for e in expansion.entries], schema.CLASSPATH_ENTRY)
    own = entries.select("position", "display", "origin", "wildcard_source", F.col("kind").alias("entry_kind"))
    found = scanned.where("row = 'class' and internal_name is not null").withColumn("package", package_of(F.col("internal_name")))
    return Facts(entries, found.join(F.broadcast(own), "position"), scanned, symbols, expansion)  # classpath entries: a driver-side list


def _found(df: DataFrame, code: str | Column, subject: Column, detail: Column, *, severity: Column | None = None, display: str = "display", entry: Column | None = None, source: Column | None = None, line: Column | None = None, evidence: Column | None = None) -> DataFrame:
    """Rows as findings; texts that depend on the code come from the catalog."""
    code = F.lit(code) if isinstance(code, str) else code
    known = F.create_map(*[F.lit(x) for c, d in CODES.items() for x in (c, f"{d.title}\t{d.severity or ''}\t{d.predicted or ''}\t{d.explanation}\t{d.remediation}")])
    text = lambda i: F.nullif(F.get(F.split(F.element_at(known, code), "\t"), F.lit(i)), F.lit(""))
    none = F.lit(None).cast("string")
    return df.select(
        code.alias("code"), (severity if severity is not None else text(1)).alias("severity"), text(2).alias("predicted_error"),
        F.struct(F.col(display).alias("artifact"), (none if entry is None else entry).alias("class_entry"), (none if source is None else source).alias("source_file"), (F.lit(None).cast("int") if line is None else line).alias("line")).alias("location"),
        subject.alias("subject"), F.concat(text(0), F.lit(": "), detail).alias("summary"), text(3).alias("explanation"),
        (F.array(detail) if evidence is None else evidence).alias("evidence"), F.array(text(4)).alias("remediation"),
    )


def conflict_findings(f: Facts) -> list[DataFrame]:
    """Duplicates, split packages, versions and seals."""
    c = f.classes
    verdict = duplicates.duplicate_classes(c)
    named = verdict.join(c.select("position", "ordinal", "internal_name", "display", "entry_name"), (verdict.internal_name == c.internal_name) & (F.col("winner_position") == F.col("position")) & (F.col("winner_ordinal") == F.col("ordinal"))).drop(c.internal_name)
    code = F.when(F.col("verdict") == "identical", "JP2001").when(F.col("verdict") == "unpredictable", "JP2006").otherwise("JP2002")
    claims = c.select("internal_name", F.concat_ws(" ", "display", F.substring("digest", 1, 8)).alias("claim"), "position").join(verdict.select("internal_name"), "internal_name", "left_semi")
    listed = duplicates.first_few(claims, ["internal_name"], "position", "claim", "claims_of")
    out = [_found(named.join(listed, "internal_name"), code, binary_name(F.col("internal_name")), binary_name(F.col("internal_name")), entry=F.col("entry_name"), evidence=F.col("claims_of"))]
    shares = durable(duplicates.contributors(c))
    split = shares.groupBy("package").agg(F.count("*").alias("n"), F.min_by("display", "position").alias("display")).where("n > 1")
    split = split.join(duplicates.first_few(shares, ["package"], "position", "display", "held_by"), "package")
    out.append(_found(split, "JP2003", binary_name(F.col("package")), binary_name(F.col("package")), evidence=F.col("held_by")))
    rows = f.scanned.where("row = 'artifact'").join(f.entries.select("position", "display", "kind", "origin"), "position")
    versions = duplicates.version_conflicts(rows.where("coordinate is not null").select("position", "display", "coordinate.group", "coordinate.artifact", "coordinate.version"))
    text = F.transform("versions", lambda v: F.concat_ws(" ", v["version"], v["display"]))
    out.append(_found(versions.withColumn("display", F.element_at("versions", 1)["display"]), "JP2004", F.col("identity"), F.col("identity"), evidence=text))
    seals = duplicates.sealed_violations(c, rows.select("display", F.explode("sealed").alias("package"))).join(split.select("package", "held_by"), "package")
    out.append(_found(seals, "JP2008", binary_name(F.col("package")), binary_name(F.col("package")), evidence=F.col("held_by")))
    return out


def layout_findings(f: Facts, request: Request) -> list[DataFrame]:
    """Bytecode levels, corrupt entries, multi-release and nested layouts, empty roots, missing manifest entries."""
    spark, c = f.entries.sparkSession, f.classes
    entry = {"entry": F.col("entry_name"), "source": F.col("source_file")}
    level = F.concat_ws(" ", F.lit("class file version"), F.concat_ws(".", F.col("major").cast("string"), F.col("minor").cast("string")))
    out = [_found(levels.newer_than_target(c, request.release), "JP3001", binary_name(F.col("internal_name")), level, **entry), _found(levels.invalid_preview(c, request.release, request.preview), "JP3002", binary_name(F.col("internal_name")), level, **entry)]
    own = f.entries.select("position", "display", "origin")
    bad = f.scanned.where("status in ('corrupt', 'unparsed')").join(own, "position")
    out.append(_found(bad, "JP3004", F.col("entry_name"), F.col("entry_name"), entry=F.col("entry_name")))
    notes = f.scanned.where("row = 'artifact'").join(own, "position").select("position", "display", F.explode("notes").alias("n"))
    out.append(_found(notes, "JP3003", F.concat(F.lit("META-INF/versions/"), F.col("n.detail")), F.concat_ws(" ", F.col("n.detail"), F.col("n.kind"))))
    mixed = levels.mixed_levels(c).join(own, "position")
    text = F.transform("levels", lambda x: F.concat_ws(" ", F.lit("version"), x["major"].cast("string"), F.lit("in"), x["n"].cast("string"), F.lit("classes")))
    out.append(_found(mixed, "JP3005", F.col("display"), F.concat_ws(", ", text), evidence=text))
    nested = spark.createDataFrame([(x["display"], x["kind"], x["detail"]) for x in f.expansion.layout], "display string, kind string, detail string")
    out.append(_found(nested, "JP3006", F.col("detail"), F.concat_ws(" ", "kind", "detail"), severity=F.when(F.col("kind") == "compressed", "WARNING").otherwise("ERROR")))
    faults = bad.select("position").union(notes.select("position")).union(own.join(nested.select("display"), "display").select("position"))
    out.append(_found(levels.empty_roots(own, f.scanned.where("row = 'class'"), faults), "JP3007", F.col("display"), F.col("display")))
    missing = spark.createDataFrame([(x["display"], x["named"]) for x in f.expansion.missing], "display string, named string")
    out.append(_found(missing, "JP2007", F.col("named"), F.col("named")))
    return out


def hierarchy_types(f: Facts) -> DataFrame:
    return durable(linkage.resolved_types(f.classes.select("internal_name", "position", "ordinal", "shape"), f.platform))


def call_graph(f: Facts, types: DataFrame) -> reachability.CallGraph:
    """What the winners among the classes may run."""
    first = duplicates.winners(f.classes.select("internal_name", "position", "ordinal", "origin", "member_refs", "type_refs")).join(types.where("not from_platform").select(F.col("name").alias("internal_name")), "internal_name", "left_semi")
    first = durable(first)
    members = first.select("internal_name", F.posexplode("member_refs").alias("ref", "r")).select("internal_name", "ref", "r.method", "r.kind", "r.owner", "r.name", "r.descriptor")
    targets = first.select("internal_name", F.explode("type_refs").alias("r")).select("internal_name", "r.method", "r.target")
    return reachability.CallGraph(types, first.select("internal_name", "origin"), members, targets)


def resolution_evidence(f: Facts, types: DataFrame, found: DataFrame) -> DataFrame:
    """``found(subject, code, owner, name, descriptor, declarer, member_access, ...)`` with ``facts``: what was selected, what the declaration is, and of a missing method up to three declarations of the same name."""
    chosen = duplicates.winners(f.classes.select("internal_name", "position", "ordinal", "display", "digest")).select(F.col("internal_name").alias("owner"), F.concat(F.lit("taken from "), "display", F.lit(", SHA-256 "), F.substring("digest", 1, 8)).alias("__by"))
    top = duplicates.first_by(f.platform.select(F.col("internal_name").alias("owner"), F.concat(F.lit("part of the platform: "), F.coalesce("module", "internal_name")).alias("__top")), ["owner"], ["__top"])
    own = types.select(F.col("name").alias("owner"), F.col("members").alias("__members"))
    j = found.join(top, "owner", "left").join(chosen, "owner", "left").join(own, "owner", "left")
    trait = F.when(F.col("code") == "JP1004", F.when(linkage.has(F.col("member_access"), linkage.STATIC), "static").otherwise("an instance member"))
    trait = trait.when(F.col("code") == "JP1007", F.when(linkage.has(F.col("member_access"), linkage.PRIVATE), "private").when(linkage.has(F.col("member_access"), linkage.PROTECTED), "protected").otherwise("visible in its package"))
    alike = F.filter("__members", lambda m: (m["name"] == F.col("name")) & (m["descriptor"] != F.col("descriptor")))
    named = F.when(F.col("code") == "JP1003", F.transform(F.slice(alike, 1, 3), lambda m: F.concat(F.lit("of that name there: "), m["name"], m["descriptor"])))
    one = F.array_compact(F.array(F.when(F.col("code") != "JP1001", F.coalesce("__top", "__by")), F.concat("declarer", F.lit(" has it as "), trait)))
    return j.withColumn("facts", F.concat(one, F.coalesce(named, F.array().cast("array<string>")))).drop("__top", "__by", "__members")


def linkage_findings(f: Facts, request: Request, types: DataFrame, most: int = 20_000) -> DataFrame:
    """JP1001 to JP1007, each (code, subject, artifact, entry) once."""
    c = f.classes.where("shape is not null")
    if request.scope == "APPLICATION":
        c = c.where("origin = 'APPLICATION'")
    winners = duplicates.winners(f.classes.select("internal_name", "position", "ordinal", F.col("shape").isNull().alias("unread")))
    unread = winners.where("unread").select(F.col("internal_name").alias("name"))
    hosts = linkage.nest_hosts(types, c.select("position", "ordinal", F.col("internal_name").alias("name"), F.col("shape.nest_host").alias("nest_host"))).select("position", "ordinal", "host")
    c = durable(c.join(hosts, ["position", "ordinal"]))
    severity = F.when((F.lit(request.scope) == "REACHABLE") | (F.col("origin") == "APPLICATION"), "ERROR").otherwise("WARNING").alias("severity")
    base = ["position", "ordinal", "display", "entry_name", "source_file", severity, F.col("internal_name").alias("caller")]
    t = c.select(*base, F.posexplode("type_refs").alias("ref", "r")).select("*", "r.*").drop("r").withColumn("phase", F.lit(0))
    m = c.select(*base, F.col("shape.super").alias("caller_super"), F.col("host").alias("caller_host"), F.posexplode("member_refs").alias("ref", "r")).select("*", "r.*").drop("r").withColumn("phase", F.lit(1))
    if request.scope == "REACHABLE":
        graph = call_graph(f, types)
        found = durable(graph.reached())
        live = durable(found.select(F.col("owner").alias("caller"), F.col("sig").alias("method")))
        t, m = t.join(live, ["caller", "method"], "left_semi"), m.join(live, ["caller", "method"], "left_semi")
    cols = ["code", "subject", "display", "entry_name", "position", "ordinal", "phase", "ref", "source_file", "severity", "line", "caller", "method"]
    more = ["owner", "name", "descriptor", "declarer", "member_access"]
    bare = [F.col("target").alias("owner"), *(F.lit(None).cast("string").alias(c) for c in more[1:4]), F.lit(None).cast("int").alias("member_access")]
    every = linkage.type_verdicts(types, unread, t).where("code is not null").select(*cols, *bare).union(linkage.member_verdicts(types, unread, m).where("code is not null").select(*cols, *more))
    once = durable(linkage.first_observed(every, ["position", "ordinal", "phase", "ref"]))
    if once.limit(most + 1).count() > most:
        raise classpath.RefusedRun(f"more than {most} findings")
    once = resolution_evidence(f, types, once)
    detail = F.concat_ws(" ", "subject", F.lit("from"), F.concat(binary_name(F.col("caller")), F.lit("#"), F.col("method")))
    evidence = F.concat(F.array(detail), "facts")
    if request.scope == "REACHABLE":
        wanted = durable(once.select(F.col("caller").alias("owner"), F.col("method").alias("sig")).distinct())  # as many as a run may have findings
        chains = proof.proof_chains(graph, found, wanted).select(F.col("owner").alias("caller"), F.col("sig").alias("method"), "chain") if not once.isEmpty() else wanted.select("owner", "sig", "sig").toDF("caller", "method", "chain")
        once = once.join(chains, ["caller", "method"])
        evidence = F.concat(F.array(detail, F.concat(F.lit("reachable via: "), F.col("chain"))), "facts")
    return _found(once, F.col("code"), F.col("subject"), detail, severity=F.col("severity"), entry=F.col("entry_name"), source=F.col("source_file"), line=F.col("line"), evidence=evidence)


def service_findings(f: Facts, types: DataFrame) -> list[DataFrame]:
    """JP4001 to JP4005."""
    files = f.scanned.where("row = 'artifact'").join(f.entries.select("position", "display"), "position").select("position", "display", F.explode("services").alias("s")).select("position", "display", F.col("s.service").alias("service_name"), F.col("s.text").alias("text"))
    entry = F.concat(F.lit("META-INF/services/"), F.col("service_name"))
    bad_files = files.where(~services.legal_name(F.col("service_name")))
    sound = files.where(services.legal_name(F.col("service_name")))
    lines = durable(services.provider_lines(sound))
    keys = ["position", "display", "service_name"]
    legal = duplicates.first_by(lines.where(services.legal_name(F.col("declared_name"))), [*keys, "declared_name"], ["line_number"])
    declared = f.classes.select(F.col("internal_name").alias("name")).union(f.platform.select("internal_name")).distinct()
    v = durable(services.provider_verdicts(types, declared, legal))
    name, at = F.col("declared_name"), {"entry": entry, "line": F.col("line_number")}
    out = [
        _found(v.where("missing"), "JP4001", name, F.concat_ws(" ", name, F.lit("for"), "service_name"), **at),
        _found(v.where("wrong_type"), "JP4002", name, F.concat_ws(" ", name, F.lit("for"), "service_name"), **at),
        _found(v.where(F.size("faults") > 0), "JP4005", name, F.concat_ws(" ", name, F.lit("is"), F.concat_ws(", ", "faults")), evidence=F.col("faults"), **at),
        _found(services.malformed_lines(lines, keys), "JP4003", name, name, **at),
        _found(bad_files, "JP4003", F.col("service_name"), F.col("service_name"), entry=entry),
        _found(services.repeated_lines(lines, keys), "JP4004", name, F.concat_ws(" ", name, F.col("times").cast("string"), F.lit("times")), **at),
    ]
    return [duplicates.first_by(x.withColumn("a", F.col("location.artifact")).withColumn("e", F.col("location.class_entry")), ["code", "subject", "a", "e"], ["location.line"]).select(*schema.FINDING_COLUMNS) for x in out]


def module_claims(f: Facts) -> DataFrame:
    """(position, display, automatic_name, descriptor): folders have no manifest, nested positions claim nothing."""
    e = f.entries.where("nested is null").select("position", "display", "kind")
    named = f.scanned.where("row = 'artifact'").join(e, "position").select("position", "display", F.when(F.col("kind") != "DIRECTORY", F.trim(F.element_at("manifest", "automatic-module-name"))).alias("automatic_name"))
    d = f.scanned.where("row = 'class' and internal_name = 'module-info' and module is not null").groupBy("position").agg(F.min_by("module", "ordinal").alias("descriptor"))
    return named.join(d, "position", "left")


def module_findings(f: Facts, types: DataFrame) -> list[DataFrame]:
    """JP5001 to JP5006."""
    claims = durable(module_claims(f))
    declared = f.classes.select(F.col("internal_name").alias("name")).union(f.platform.select("internal_name")).distinct()
    entry = {"entry": F.lit("module-info.class")}
    required = modules.missing_requirements(claims, f.platform.select("module").distinct())
    faults = modules.provider_faults(claims, types, f.classes.select("position", "internal_name", "shape.access", "shape.members"))
    split = modules.module_splits(claims, f.classes).join(f.entries.select("position", "display"), "position")
    slash = lambda c: binary_name(F.col(c))
    return [
        _found(required, "JP5001", F.col("required"), F.concat_ws(" ", F.col("module"), F.lit("requires"), F.col("required")), **entry),
        _found(modules.empty_exposed(claims, f.classes), "JP5002", slash("package"), F.concat_ws(" ", F.col("module"), F.lit("exposes"), slash("package")), **entry),
        _found(faults, "JP5003", slash("provider"), F.concat_ws(" ", slash("provider"), F.lit("is"), F.concat_ws(", ", "faults")), evidence=F.col("faults"), **entry),
        _found(modules.missing_services(claims, declared), "JP5004", slash("service"), F.concat_ws(" ", F.col("module"), F.lit("uses"), slash("service")), **entry),
        _found(split, "JP5005", slash("package"), F.concat_ws(" ", slash("package"), F.lit("in"), F.col("modules").cast("string"), F.lit("modules"))),
        _found(modules.illegal_automatic_names(claims), "JP5006", F.col("automatic_name"), F.col("automatic_name")),
    ]


def verify(spark: SparkSession, request: Request, budget: archive.Budget = archive.Budget()) -> Result:
    """All findings in canonical order. More than ``budget.findings`` of them refuse the run; none is cut off."""
    f = read_facts(spark, request, budget)
    types = hierarchy_types(f)
    families = [*layout_findings(f, request), *conflict_findings(f), linkage_findings(f, request, types, budget.findings), *service_findings(f, types), *module_findings(f, types)]
    every = durable(reduce(DataFrame.unionByName, families))
    if every.limit(budget.findings + 1).count() > budget.findings:
        raise classpath.RefusedRun(f"more than {budget.findings} findings")
    return Result(results.canonical_order(every), f.classes.count(), len(f.expansion.entries))
