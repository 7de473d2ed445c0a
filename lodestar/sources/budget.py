"""Ceilings of one run; what is beyond them refuses it before it is read."""

from __future__ import annotations

import zipfile
from dataclasses import dataclass


class RefusedRun(ValueError):
    """Input that cannot be analysed at all."""


@dataclass(frozen=True)
class Budget:
    """Ceilings of one run."""

    entries: int = 262_144
    class_bytes: int = 32 << 20
    nested_bytes: int = 256 << 20
    expanded_bytes: int = 4 << 30
    ratio: int = 200
    findings: int = 20_000


def checked(info: zipfile.ZipInfo, most: int, budget: Budget, where: str) -> None:
    """Refuse an entry by the size and the ratio that its archive announces."""
    if info.file_size > most:
        raise RefusedRun(f"{where}!/{info.filename} is larger than {most} bytes")
    if info.compress_size > 0 and info.file_size > 0 and info.file_size // info.compress_size > budget.ratio:
        raise RefusedRun(f"{where}!/{info.filename} expands more than {budget.ratio} times")
