"""Compiles small Java sources into archives for tests."""

import subprocess
import zipfile
from pathlib import Path

RELEASE = 11


def compiled(folder: Path, sources: dict[str, str], classpath: list[Path] = (), release: int = RELEASE) -> Path:
    """Compile ``{path: source}`` into ``folder/classes``."""
    src, out = folder / "src", folder / "classes"
    for name, text in sources.items():
        p = src / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    out.mkdir(parents=True, exist_ok=True)
    cp = ["-cp", ":".join(map(str, classpath))] if classpath else []
    subprocess.run(["javac", "-g", "--release", str(release), "-d", str(out), *cp, *map(str, sorted(src.rglob("*.java")))], check=True, capture_output=True)
    return out


def jar(path: Path, folder: Path | None = None, extra: dict[str, bytes | str] | None = None, stored: bool = False) -> Path:
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as z:
        for p in sorted(folder.rglob("*")) if folder else []:
            if p.is_file():
                z.write(p, p.relative_to(folder).as_posix())
        for name, data in (extra or {}).items():
            z.writestr(name, data)
    return path


def thrown(classpath: list[Path], main: str) -> str | None:
    """Simple name of the error that ends ``main``, or None."""
    run = subprocess.run(["java", "-Xshare:auto", "-cp", ":".join(map(str, classpath)), main], capture_output=True, text=True)
    if run.returncode == 0:
        return None
    first = next(x for x in run.stderr.splitlines() if "Exception in thread" in x or "Error" in x)
    return first.split(":")[0].split()[-1].rsplit(".", 1)[-1]
