"""Classpath expansion on the driver: an ordered list of entries from applications, classpath and manifests."""

from __future__ import annotations

import os
import re
import zipfile
from dataclasses import dataclass, field
from pathlib import Path

from lodestar.sources.budget import Budget, RefusedRun, checked
from lodestar.sources.manifest import class_path, parse_manifest

MANIFEST = "META-INF/MANIFEST.MF"
ARCHIVE_SUFFIXES = (".jar", ".JAR")
NESTED_SUFFIXES = (".jar", ".JAR", ".zip")


@dataclass
class Expansion:
    entries: list[dict] = field(default_factory=list)
    missing: list[dict] = field(default_factory=list)  # manifest entries that do not exist: declaring, named
    layout: list[dict] = field(default_factory=list)  # nested layout faults: display, kind, detail
    declared: int = 0  # bytes of base classes and of nested libraries that archives announce


def classpath_list(value: str) -> list[str]:
    """Entries of a classpath option: ``@file`` has one a line, else the platform's separator is between them."""
    if value.startswith("@"):
        with open(value[1:], encoding="utf-8") as f:
            return [line.strip() for line in f if line.strip()]
    return [x for x in value.split(os.pathsep) if x]


def boot_layout(main: dict[str, str], names: list[str]) -> dict[str, str] | None:
    """Roots of classes and libraries inside an application archive, and the index beside the libraries.

    Both manifest attributes make a layout; else the usual folder that holds classes does, in which either attribute
    alone still counts.
    """
    named = {k: v.strip().rstrip("/") + "/" for k, v in (("classes", main.get("spring-boot-classes")), ("libraries", main.get("spring-boot-lib"))) if v and v.strip()}
    usual = next(({"classes": top + "classes/", "libraries": top + "lib/"} for top in ("BOOT-INF/", "WEB-INF/") if any(n.startswith(top + "classes/") for n in names)), None)
    if len(named) < 2 and usual is None:
        return None
    out = (usual or {}) | named
    return out | {"index": out["libraries"][: out["libraries"].rfind("/", 0, -1) + 1] + "classpath.idx"}


def library_order(index: str | None, libraries: list[str]) -> tuple[list[str], list[str]]:
    """Libraries in index order, then the rest in archive order; and index names that are not there.

    Names count as they are written, and a library is there once: a name again is one that is not there.
    """
    lines = [line.strip()[2:].strip() for line in re.split("\r\n|\r|\n", index or "") if line.strip().startswith("- ")]
    named = [x for n in lines if (x := n[1:-1] if len(n) > 1 and n[0] == n[-1] == '"' else n)]
    left, first, absent = dict.fromkeys(libraries), [], []
    for n in named:
        if n in left:
            first.append(n)
            del left[n]
        else:
            absent.append(n)
    return first + list(left), absent


def _class_bytes(z: zipfile.ZipFile) -> int:
    return sum(i.file_size for i in z.infolist() if i.filename.endswith(".class") and not i.filename.startswith("META-INF/versions/"))


class _Expander:
    def __init__(self, budget: Budget) -> None:
        self.out, self.visited, self.budget = Expansion(), set(), budget

    def add(self, path: str, display: str, kind: str, origin: str, wildcard: str | None = None, nested: dict | None = None, layout: dict | None = None) -> None:
        self.out.entries.append({"position": len(self.out.entries), "display": display, "path": path, "kind": kind, "origin": origin, "wildcard_source": wildcard, "nested": nested, "layout": layout})

    def once(self, path: str) -> bool:
        key = os.path.normpath(os.path.abspath(path))
        if key in self.visited:
            return False
        self.visited.add(key)
        return True

    def entry(self, path: str, origin: str, wildcard: str | None = None) -> None:
        if not self.once(path):
            return
        if os.path.isdir(path):
            self.add(path, path, "DIRECTORY", origin, wildcard)
            return
        main, names = self.opened(path)
        if origin == "APPLICATION" and (layout := boot_layout(main, names)):
            self.nested(path, layout, names)
        else:
            self.add(path, path, "ARCHIVE", origin, wildcard)
        self.chain(path, main)

    def opened(self, path: str) -> tuple[dict[str, str], list[str]]:
        try:
            with zipfile.ZipFile(path) as z:
                names = z.namelist()
                self.out.declared += _class_bytes(z)
                return (parse_manifest(z.read(MANIFEST))[0] if MANIFEST in names else {}), names
        except (OSError, zipfile.BadZipFile, EOFError) as e:
            raise RefusedRun(f"cannot read {path}: {e}") from e

    def nested(self, path: str, layout: dict, names: list[str]) -> None:
        roots = {"classes": layout["classes"], "libraries": layout["libraries"]}
        self.add(path, f"{path}!/{layout['classes'].rstrip('/')}", "NESTED_CLASSES", "APPLICATION", nested={"outer_display": path, "path": layout["classes"]}, layout=roots)
        with zipfile.ZipFile(path) as z:
            libraries = [n for n in names if n.startswith(layout["libraries"]) and n.endswith(ARCHIVE_SUFFIXES) and "/" not in n[len(layout["libraries"]) :]]
            index = None
            if layout["index"] in names:
                checked(z.getinfo(layout["index"]), self.budget.nested_bytes, self.budget, path)
                index = z.read(layout["index"]).decode("utf-8", "replace")
            ordered, absent = library_order(index, libraries)
            for n in absent:
                self.out.layout.append({"display": path, "kind": "absent", "detail": n})
            for n in ordered:
                display = f"{path}!/{n}"
                info = z.getinfo(n)
                checked(info, self.budget.nested_bytes, self.budget, path)
                self.out.declared += info.file_size
                if info.compress_type != zipfile.ZIP_STORED:
                    self.out.layout.append({"display": display, "kind": "compressed", "detail": n})
                try:
                    with z.open(n) as stream, zipfile.ZipFile(stream) as held:  # its directory; of a stored one no more is read
                        self.out.declared += _class_bytes(held)
                        inner = held.namelist()
                except (zipfile.BadZipFile, EOFError, OSError) as e:
                    raise RefusedRun(f"cannot read {display}: {e}") from e
                for deep in sorted(x for x in inner if x.endswith(NESTED_SUFFIXES)):
                    self.out.layout.append({"display": display, "kind": "deep", "detail": deep})
                self.add(path, display, "NESTED_ARCHIVE", "CLASSPATH", nested={"outer_display": path, "path": n}, layout=roots)
        self.add(path, path, "HOST_ARCHIVE", "CLASSPATH", layout=roots)

    def chain(self, path: str, main: dict[str, str]) -> None:
        """Manifest Class-Path entries, depth first, behind the entry that declares them."""
        for name in class_path(main):
            target = os.path.join(os.path.dirname(path), name.removeprefix("file:"))
            if os.path.exists(target):
                self.entry(target, "CLASSPATH")
            else:
                self.out.missing.append({"display": path, "named": name})

    def classpath(self, value: str) -> None:
        if value.endswith("/*") or value == "*":
            folder = value[:-2] or "."
            if not os.path.isdir(folder):
                raise RefusedRun(f"no such folder: {folder}")
            for p in sorted(Path(folder).iterdir(), key=lambda p: p.name):
                if p.is_file() and p.name.endswith(ARCHIVE_SUFFIXES):
                    self.entry(str(p), "CLASSPATH", value)
            return
        if not os.path.exists(value):
            raise RefusedRun(f"no such classpath entry: {value}")
        self.entry(value, "CLASSPATH")


def expand(applications: list[str], classpath: list[str], budget: Budget = Budget()) -> Expansion:
    """Applications first, then the classpath, both in the caller's order; a path that was seen already is left out."""
    if not applications:
        raise RefusedRun("at least one application is needed")
    e = _Expander(budget)
    for a in applications:
        if not os.path.exists(a):
            raise RefusedRun(f"no such application: {a}")
        e.entry(a, "APPLICATION")
    for c in classpath:
        e.classpath(c)
    return e.out
