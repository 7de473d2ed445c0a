"""Manifests, coordinates and sealed packages of an archive."""

from __future__ import annotations

import re


def parse_manifest(raw: bytes) -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    """Main attributes and those of each named section; lines continue after a line end and a space, names match in any case.

    An attribute that comes again has its last value, a section that comes again adds to the first.
    """
    main: dict[str, str] = {}
    sections: dict[str, dict[str, str]] = {}
    now = main
    text = raw.replace(b"\r\n", b"\n").replace(b"\r", b"\n").replace(b"\n ", b"").decode("utf-8", "replace")  # lines may break inside a character
    fresh = False
    for line in text.split("\n"):
        if not line:
            fresh = True
            continue
        name, colon, value = line.partition(":")
        if not colon:
            continue
        value = value[1:] if value.startswith(" ") else value
        if fresh and name.lower() == "name":
            now = sections.setdefault(value, {})
        else:
            now[name.lower()] = value
        fresh = False
    return main, sections


def is_true(value: str | None) -> bool:
    return (value or "").strip().lower() == "true"


def package_of(entry: str) -> str | None:
    """Package of an internal or entry name; None for the unnamed package."""
    at = entry.rfind("/")
    return entry[:at] if at > 0 else None


def sealed_packages(main: dict[str, str], sections: dict[str, dict[str, str]], packages: set[str]) -> list[str]:
    """All own packages if the main section seals, and those whose own section does."""
    sealed = set(packages) if is_true(main.get("sealed")) else set()
    sealed |= {name[:-1] for name, at in sections.items() if name.endswith("/") and len(name) > 1 and is_true(at.get("sealed"))}
    return sorted(sealed)


def class_path(main: dict[str, str]) -> list[str]:
    return (main.get("class-path") or "").split()


_BREAK = re.compile("\r\n|\r|\n")
_KEY = re.compile(r"((?:[^\\=: \t\f]|\\.)*)[ \t\f]*[=:]?[ \t\f]*(.*)", re.DOTALL)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|.)", re.DOTALL)
_NAMED = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}


def properties(raw: bytes) -> dict[str, str]:
    """A properties file as Java loads it.

    An odd number of backslashes at its end continues a line; a key ends at the first ``=``, ``:`` or blank that is not
    escaped; a key that comes again has its last value.
    """
    out: dict[str, str] = {}
    held = ""
    for line in [*_BREAK.split(raw.decode("latin-1")), ""]:
        line = line.lstrip(" \t\f")
        if not held and line[:1] in ("", "#", "!"):
            continue
        held += line
        if (len(held) - len(held.rstrip("\\"))) % 2:
            held = held[:-1]
            if line:
                continue
        key, value = (_ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _NAMED.get(m[1], m[1]), x) for x in _KEY.match(held).groups())
        out[key] = value
        held = ""
    return out


def coordinate(poms: list[dict[str, str]], main: dict[str, str]) -> dict[str, str] | None:
    """Group, artifact and version of the only complete pom.properties, else the implementation title and version."""
    if len(poms) == 1 and all(poms[0].get(k) for k in ("groupId", "artifactId", "version")):
        return {"group": poms[0]["groupId"], "artifact": poms[0]["artifactId"], "version": poms[0]["version"]}
    title, version = main.get("implementation-title"), main.get("implementation-version")
    return {"group": "", "artifact": title, "version": version} if title and version else None
