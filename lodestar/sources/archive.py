"""Artifacts read into fact rows: a distributed scan of archives and class folders.

``spark.read.format("binaryFile")`` brings a small archive to a task. A large one, or one that presents several positions, is
split: each task reads the directory at the file's end and then only its own range of the entries, in the order that one
task would take them; such archives, and folders, must be mounted wherever executors run. Budgets are ceilings that refuse a run: tasks report a refusal as a row, and the driver raises the one
of the first position, whichever task was faster.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import zipfile
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import schema
from lodestar.session import as_arrow, mapped
from lodestar.sources.budget import Budget, RefusedRun, checked
from lodestar.sources.classfile import NEWEST_MAJOR, MalformedClass, parse, version
from lodestar.sources.classpath import MANIFEST
from lodestar.sources.manifest import coordinate, is_true, package_of, parse_manifest, properties, sealed_packages

VERSIONS = "META-INF/versions/"
SERVICES = "META-INF/services/"


class Contents:
    """Names of an artifact's entries in order, and their bytes; a part of an archive is one of these as well."""

    def __init__(self, display: str, names: list[str], read, budget: Budget) -> None:
        self.display, self.names, self._read, self.budget, self.expanded = display, names, read, budget, 0
        if len(names) > budget.entries:
            raise RefusedRun(f"{display} has more than {budget.entries} entries")

    def read(self, name: str, most: int | None = None) -> bytes:
        data = self._read(name, most or self.budget.class_bytes, None)
        self.expanded += len(data)
        return data

    def head(self, name: str, size: int) -> bytes:
        """The first bytes of an entry; no more of it is read."""
        return self._read(name, self.budget.class_bytes, size)


def archive_contents(display: str, raw: bytes | str, budget: Budget, prefix: str = "", without: tuple[str, ...] = ()) -> Contents:
    """Contents of an archive of which the bytes, or only the path, are known; of a path no more is read than is asked for."""
    try:
        z = zipfile.ZipFile(raw if isinstance(raw, str) else io.BytesIO(raw))
        infos = {i.filename: i for i in z.infolist() if not i.is_dir()}
    except (zipfile.BadZipFile, EOFError, OSError, ValueError) as e:
        raise RefusedRun(f"cannot read {display}: {e}") from e

    def read(name: str, most: int, first: int | None) -> bytes:
        info = infos[prefix + name]
        checked(info, most, budget, display)
        try:
            with z.open(info) as f:
                data = f.read(most + 1 if first is None else first)
        except (zipfile.BadZipFile, EOFError, OSError, NotImplementedError, ValueError) as e:
            raise RefusedRun(f"cannot read {display}!/{name}: {e}") from e
        if len(data) > most:
            raise RefusedRun(f"{display}!/{name} is larger than {most} bytes")
        return data

    names = sorted(n[len(prefix) :] for n in infos if n.startswith(prefix) and not (without and n.startswith(without)))
    return Contents(display, names, read, budget)


def selected(names: list[str], release: int, multi_release: bool) -> dict[str, tuple[str, int]]:
    """Base name -> (entry, version) that a JVM of ``release`` sees: the highest version from 9 to it, else the base entry."""
    best = {n: (n, 0) for n in names if not n.startswith(VERSIONS)}
    if multi_release:
        for n in names:
            if n.startswith(VERSIONS):
                step, _, base = n[len(VERSIONS) :].partition("/")
                if base and step.isascii() and step.isdigit() and 9 <= int(step) <= release and int(step) > best.get(base, ("", 0))[1]:
                    best[base] = (n, int(step))
    return best


def layout_notes(names: list[str], multi_release: bool) -> list[dict]:
    """JP3003: version folders that the manifest does not announce, or that are no release."""
    steps = sorted({n[len(VERSIONS) :].partition("/")[0] for n in names if n.startswith(VERSIONS) and "/" in n[len(VERSIONS) :]})
    bad = steps if not multi_release else [s for s in steps if not (s.isascii() and s.isdigit() and int(s) >= 9)]
    return [{"code": "JP3003", "kind": "unannounced" if not multi_release else "no release", "detail": s} for s in bad]


def _empty(position: int) -> dict:
    return dict.fromkeys(schema.SCANNED_COLUMNS) | {"position": position}


def scan(position: int, c: Contents, release: int, folder: bool = False, references: bool = True, part: int = 0, parts: int = 1) -> Iterator[dict]:
    """Fact rows of one artifact; ``folder``: base entries only, no manifest is honoured.

    Of several ``parts`` each has a range of the classes, the first the artifact's own row as well.
    """
    main, sections = parse_manifest(c.read(MANIFEST)) if MANIFEST in c.names and not folder else ({}, {})
    multi = is_true(main.get("multi-release"))
    pick = selected(c.names, release, multi)
    packages: set[str] = set()
    entries = sorted((entry, base) for base, (entry, _) in pick.items() if base.endswith(".class"))
    low, high = len(entries) * part // parts, len(entries) * (part + 1) // parts
    ordinal = low
    for entry, base in entries[low:high]:
        data = c.read(entry)
        row = _empty(position) | {"row": "class", "ordinal": ordinal, "entry_name": entry}
        ordinal += 1
        got = version(data)
        if got is None:
            yield row | {"status": "corrupt"}
            continue
        name = base[: -len(".class")]
        row |= {"internal_name": name, "major": got[0], "minor": got[1], "digest": hashlib.sha256(data).hexdigest(), "status": "declared"}
        if package := package_of(name):
            packages.add(package)
        if got[0] <= NEWEST_MAJOR:
            try:
                f = parse(data, references)
            except (MalformedClass, IndexError, ValueError, KeyError, TypeError, RecursionError, OverflowError):
                row["status"] = "unparsed"
            except Exception:  # struct.error and the like: whatever the bytes provoke, the class is unreadable
                row["status"] = "unparsed"
            else:
                row |= {
                    "source_file": f.source_file, "module": f.module,
                    "shape": {"internal_name": f.internal_name, "access": f.access, "super": f.super, "interfaces": f.interfaces, "nest_host": f.nest_host, "nest_members": f.nest_members, "members": [dict(zip(("name", "descriptor", "access"), m)) for m in f.members]},
                    "type_refs": [dict(zip(("target", "method", "line"), t)) for t in f.type_refs],
                    "member_refs": [dict(zip(("kind", "owner", "name", "descriptor", "method", "line"), m)) for m in f.member_refs],
                }
        yield row
    if part:
        yield _empty(position) | {"row": "part", "expanded": c.expanded}
        return
    if is_true(main.get("sealed")):  # which packages are declared shows in the first bytes of the other parts' classes
        packages.update(p for entry, base in entries[high:] if (p := package_of(base[: -len(".class")])) and version(c.head(entry, 8)) is not None)
    poms = [properties(c.read(n)) for n in c.names if n.startswith("META-INF/maven/") and n.endswith("pom.properties")]
    services = [{"service": n[len(SERVICES) :], "text": c.read(n).decode("utf-8", "replace")} for n in c.names if n.startswith(SERVICES) and "/" not in n[len(SERVICES) :]]
    yield _empty(position) | {
        "row": "artifact", "manifest": main, "sealed": sealed_packages(main, sections, packages), "coordinate": coordinate(poms, main),
        "names": c.names, "notes": layout_notes(c.names, multi), "services": services, "expanded": c.expanded,
    }


def _folder_contents(display: str, root: str, budget: Budget) -> Contents:
    names = sorted(os.path.relpath(os.path.join(d, n), root).replace("\\", "/") for d, _, files in os.walk(root) for n in files)

    def read(name: str, most: int, first: int | None) -> bytes:
        with open(os.path.join(root, name), "rb") as f:
            data = f.read(most + 1 if first is None else first)
        if len(data) > most:
            raise RefusedRun(f"{display}/{name} is larger than {most} bytes")
        return data

    return Contents(display, names, read, budget)


def contents_of(entry: dict, raw: bytes | str | None, budget: Budget) -> tuple[Contents, bool]:
    """What an entry of the classpath presents, and whether it is a folder."""
    kind, display = entry["kind"], entry["display"]
    if kind == "DIRECTORY":
        return _folder_contents(display, entry["path"], budget), True
    if kind == "ARCHIVE":
        return archive_contents(display, raw, budget), False
    if kind == "HOST_ARCHIVE":
        return archive_contents(display, raw, budget, without=(entry["layout"]["classes"], entry["layout"]["libraries"])), False
    if kind == "NESTED_CLASSES":
        return archive_contents(display, raw, budget, prefix=entry["nested"]["path"]), False
    outer = archive_contents(display, raw, budget)
    inner = archive_contents(display, outer.read(entry["nested"]["path"], budget.nested_bytes), budget)
    inner.expanded = outer.expanded
    return inner, False


def _escaped(path: str) -> str:
    return re.sub(r"([\\{}\[\]*?,])", r"\\\1", path)


def with_content(listed: DataFrame, files: list[str]) -> DataFrame:
    """``listed(file, ...)`` with the bytes of those ``files``, absolute paths, as ``content``; null for other rows."""
    if not files:
        return listed.withColumn("content", F.lit(None).cast("binary"))
    raw = listed.sparkSession.read.format("binaryFile").load([_escaped(p) for p in files]).select(F.regexp_replace("path", "^file:/*", "/").alias("file"), "content")
    return listed.join(raw, "file", "left")


#: Bytes of an archive for each task that scans it.
SPLIT = 32 << 20


def parts_of(entry: dict) -> int:
    """Tasks for one position; classes of a nested library are at hand as a whole."""
    return max(1, -(-os.path.getsize(entry["path"]) // SPLIT)) if entry["kind"] in ("ARCHIVE", "HOST_ARCHIVE", "NESTED_CLASSES") else 1


def scan_entries(spark: SparkSession, entries: list[dict], release: int, budget: Budget = Budget(), references: bool = True) -> DataFrame:
    """``schema.SCANNED`` rows of all entries, and of each further part of an archive a row ``part`` with what it read."""
    fields = schema.struct(schema.CLASSPATH_ENTRY).fieldNames()
    used: dict[str, int] = {}
    for e in entries:
        used[e["path"]] = used.get(e["path"], 0) + parts_of(e)
    rows, files = [], []
    for e in entries:
        file, split = os.path.abspath(e["path"]), used[e["path"]] > 1
        if e["kind"] != "DIRECTORY" and not split:
            files.append(file)
        rows += [(file, {k: e[k] for k in fields}, file if split else None, k, parts_of(e)) for k in range(parts_of(e))]
    listed = spark.createDataFrame(rows, f"file string, entry {schema.struct(schema.CLASSPATH_ENTRY).simpleString()}, path string, part int, parts int")
    wanted = pa.schema(as_arrow(schema.SCANNED))

    def facts(entry: dict, raw: bytes | str | None, part: int, parts: int) -> Iterator[dict]:
        try:
            contents, folder = contents_of(entry, raw, budget)
            yield from scan(entry["position"], contents, release, folder, references, part, parts)
        except RefusedRun as e:
            yield _empty(entry["position"]) | {"row": "artifact", "refusal": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at = {c: batch.column(c)[k].as_py() for c in ("entry", "path", "part", "parts", "content")}
                every = facts(at["entry"], at["path"] or at["content"], at["part"], at["parts"])
                while out := list(islice(every, 500)):
                    yield pa.RecordBatch.from_pylist(out, wanted)

    return mapped(with_content(listed, sorted(set(files))).repartition(max(1, len(rows))), run, schema.SCANNED)


def refuse(scanned: DataFrame, budget: Budget = Budget()) -> None:
    """Raise the refusal of the first position, or the one of the whole run."""
    first = scanned.where(F.col("refusal").isNotNull()).orderBy("position").select("refusal").limit(1).collect()
    if first:
        raise RefusedRun(first[0]["refusal"])
    total = scanned.agg(F.sum("expanded")).first()[0] or 0
    if total > budget.expanded_bytes:
        raise RefusedRun(f"the run expands to more than {budget.expanded_bytes} bytes")
