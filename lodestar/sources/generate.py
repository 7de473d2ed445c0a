"""Class files and archives from rows, for checks of the scan: what was put in is known from the tables."""

from __future__ import annotations

import io
import os
import shutil
import struct
import zipfile
from collections.abc import Iterable
from typing import BinaryIO

#: Opcodes of the instructions that are written, and tags of constants.
OPCODES = {"INVOKE_STATIC": 0xB8, "INVOKE_VIRTUAL": 0xB6, "INVOKE_SPECIAL": 0xB7, "GET_STATIC": 0xB2, "GET_FIELD": 0xB4, "NEW": 0xBB, "CHECKCAST": 0xC0, "RETURN": 0xB1}
_UTF8, _CLASS, _FIELD, _METHOD, _NAMED = 1, 7, 9, 10, 12


class _Pool:
    def __init__(self) -> None:
        self.at: dict[bytes, int] = {}

    def add(self, entry: bytes) -> int:
        return self.at.setdefault(entry, len(self.at) + 1)

    def text(self, s: str) -> int:
        raw = s.encode()  # plain ASCII names
        return self.add(struct.pack(">BH", _UTF8, len(raw)) + raw)

    def named(self, name: str) -> int:
        return self.add(struct.pack(">BH", _CLASS, self.text(name)))

    def member(self, owner: str, name: str, descriptor: str) -> int:
        pair = self.add(struct.pack(">BHH", _NAMED, self.text(name), self.text(descriptor)))
        return self.add(struct.pack(">BHH", _METHOD if descriptor.startswith("(") else _FIELD, self.named(owner), pair))


def class_file(name: str, above: str, access: int, major: int, minor: int = 0, members: tuple[tuple[str, str, int], ...] = (), code: tuple[tuple, ...] = (), source: str | None = None) -> bytes:
    """A class with ``members`` (name, descriptor, access) and a method ``run()V`` of ``code``: (opcode name, line, operands)."""
    pool = _Pool()
    body, lines = b"", []
    for op, line, *operands in code:
        lines.append((len(body), line))
        index = pool.named(operands[0]) if op in ("NEW", "CHECKCAST") else pool.member(*operands)
        body += struct.pack(">BH", OPCODES[op], index)
    body += bytes([OPCODES["RETURN"]])
    table = struct.pack(">H", len(lines)) + b"".join(struct.pack(">HH", *x) for x in lines)
    inner = struct.pack(">HI", pool.text("LineNumberTable"), len(table)) + table
    raw = struct.pack(">HHI", 9, 1, len(body)) + body + struct.pack(">HH", 0, 1) + inner
    run = struct.pack(">HHHH", 9, pool.text("run"), pool.text("()V"), 1) + struct.pack(">HI", pool.text("Code"), len(raw)) + raw
    plain = lambda m: struct.pack(">HHHH", m[2], pool.text(m[0]), pool.text(m[1]), 0)
    fields, methods = ([plain(m) for m in members if m[1].startswith("(") == is_method] for is_method in (False, True))
    if code:
        methods.append(run)
    this, over = pool.named(name), pool.named(above)
    end = struct.pack(">HHIH", 1, pool.text("SourceFile"), 2, pool.text(source)) if source else struct.pack(">H", 0)
    head = struct.pack(">IHHH", 0xCAFEBABE, minor, major, len(pool.at) + 1) + b"".join(pool.at)
    return head + struct.pack(">HHHH", access, this, over, 0) + struct.pack(">H", len(fields)) + b"".join(fields) + struct.pack(">H", len(methods)) + b"".join(methods) + end


def archive(entries: dict[str, bytes], deflated: tuple[str, ...] = ()) -> bytes:
    """A ZIP archive of the entries, stored but for those to be ``deflated``."""
    out = io.BytesIO()
    write_archive(out, entries.items(), deflated)
    return out.getvalue()


def write_archive(out: str | BinaryIO, entries: Iterable[tuple[str, bytes | BinaryIO]], deflated: tuple[str, ...] = ()) -> None:
    """Write a ZIP archive one entry at a time: of each its bytes, or an open file of which a part is held at once."""
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries:
            info = zipfile.ZipInfo(name)
            info.compress_type = zipfile.ZIP_DEFLATED if name in deflated else zipfile.ZIP_STORED
            if isinstance(data, bytes):
                z.writestr(info, data)
                continue
            info.file_size = os.fstat(data.fileno()).st_size
            with z.open(info, "w") as into:
                shutil.copyfileobj(data, into, 1 << 20)
