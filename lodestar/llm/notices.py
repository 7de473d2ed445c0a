"""License scans: fuzzy search for short notices, by pigeonhole seeds and bounded-error matching.

A notice that matches with at most e errors holds one of e + 1 pieces of it unchanged. Pieces are searched exactly; around
each hit the ``regex`` library verifies each run of words of about the notice's length as a whole, with at most e
insertions, deletions and substitutions. Notices that allow no error are their own only piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodestar.llm.common import PLAIN, documents, mapped, texts


@dataclass(frozen=True)
class Notice:
    label: str
    phrase: str  # words of letters and digits, lower case, one space apart
    errors: int = 0
    base: bool = False  # exact places count as base places


# The base phrases and their labels, and notices of common licences.
NOTICES = (
    Notice("cc-by", "cc by", 0, True),
    Notice("gpl", "general public license", 2, True),
    Notice("reserved", "all rights reserved", 1, True),
    Notice("apache", "apache license version 2 0", 2),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("cc-by", "creative commons attribution", 2),
    Notice("copyright", "copyright c", 0),
    Notice("mit", "released under the mit license", 2),
    Notice("mit", "permission is hereby granted free of charge", 4),
    Notice("mpl", "mozilla public license", 2),
    Notice("proprietary", "unauthorized copying of this file", 3),
    Notice("spdx", "spdx license identifier", 2),
)


#: Strings of which a search remembers whether they match.
MEMO = 1 << 16


class _Search:
    def __init__(self, notice: Notice) -> None:
        phrase, e = notice.phrase.encode(), notice.errors
        self.notice, self.phrase, self.reach = notice, phrase, len(phrase) + 2 * e
        cut = [len(phrase) * k // (e + 1) for k in range(e + 2)]
        self.pieces = [(a, phrase[a:z]) for a, z in zip(cut, cut[1:])]
        self.known: dict[bytes, int | None] = {}
        self.match = regex.compile(rb"(?b)(?:%s){e<=%d}" % (regex.escape(phrase, literal_spaces=True), e))

    def places(self, norm: bytes) -> list[tuple[int, int, int]]:
        """(from, to, errors) of every match in words joined by single spaces; of inexact ones that overlap the best, then the first."""
        e = self.notice.errors
        out = [(at, at + len(self.phrase), 0) for at in self._exact(norm)]
        if not e:
            return out
        spans: list[list[int]] = []
        starts = sorted(at - a for a, piece in self.pieces for at in _finds(norm, piece))
        for s in starts:
            lo, hi = max(0, s - e - 1), min(len(norm), s + self.reach + 1)
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = hi
            else:
                spans.append([lo, hi])
        taken = bytearray(len(norm))
        for a, z, _ in out:
            taken[a:z] = b"\1" * (z - a)
        for k, a, z in sorted(x for lo, hi in spans for x in self._matches(norm, lo, hi) if x[0]):
            if taken.find(1, a, z) < 0:
                taken[a:z] = b"\1" * (z - a)
                out.append((a, z, k))
        return sorted(out)

    def errors(self, words: bytes) -> int | None:
        """Errors with which these words match as a whole, if they do; each string is verified once."""
        if words not in self.known:
            if len(self.known) >= MEMO:
                self.known.clear()
            m = self.match.fullmatch(words)
            self.known[words] = sum(m.fuzzy_counts) if m else None
        return self.known[words]

    def _matches(self, norm: bytes, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        """(errors, from, to) of all runs of words in a window that match as a whole."""
        n, e = len(self.phrase), self.notice.errors
        cuts = [lo - 1] * (not lo or norm[lo - 1] == 32) + [lo + k for k, c in enumerate(norm[lo:hi]) if c == 32] + [hi] * (hi == len(norm) or norm[hi] == 32)
        for k, a in enumerate(cuts):
            for j in range(k + 1, len(cuts)):
                z = cuts[j]
                if z - a - 1 > n + e:
                    break
                if z - a - 1 >= n - e and (found := self.errors(norm[a + 1 : z])) is not None:
                    yield found, a + 1, z

    def _exact(self, norm: bytes) -> Iterator[int]:
        """Places where the phrase stands between word ends."""
        n = len(self.phrase)
        for at in _finds(norm, self.phrase):
            if (not at or norm[at - 1] == 32) and (at + n == len(norm) or norm[at + n] == 32):
                yield at


def _finds(text: bytes, piece: bytes) -> Iterator[int]:
    at = text.find(piece)
    while at >= 0:
        yield at
        at = text.find(piece, at + 1)


_SPAN = "array<struct<label:string,notice:string,first_word:bigint,n_words:bigint,start:bigint,end:bigint,errors:int,base:boolean>>"


def scan_text(text: bytes, searches: list[_Search]) -> tuple[int, list[dict]]:
    """Words of a text and the spans of notices in it; start and end are bytes of the text as it is."""
    plain = text.translate(PLAIN)
    words = plain.split()
    norm, out, offsets, blanks = b" ".join(words), [], None, None
    for s in searches:
        for a, z, k in s.places(norm):
            if offsets is None:
                offsets = [m.span() for m in re.finditer(rb"[^ ]+", plain)]
                blanks = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
            first, last = np.searchsorted(blanks, (a, z)).tolist()  # blanks before a place are words before it
            n = last - first + 1
            out.append({"label": s.notice.label, "notice": s.notice.phrase, "first_word": first, "n_words": n, "start": offsets[first][0], "end": offsets[first + n - 1][1], "errors": k, "base": s.notice.base and not k})
    return len(words), sorted(out, key=lambda x: (x["first_word"], x["notice"]))


def scan_notices(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans) of every row: whole texts, words as runs of letters, digits and non-ASCII characters.

    Exact places of a notice are always spans; inexact ones are left out where they overlap an exact one, or a better or
    earlier one. A null or empty text has no words and no spans. Rows that share an id, or have none, keep their rows.
    Other columns play no part. An empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [_Search(n) for n in notices]
        kind = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("errors", pa.int32()), ("base", pa.bool_())]))
        for batch in batches:
            for ids, block in texts(batch):
                found = [scan_text(b, searches) for b in block]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array([n for n, _ in found], pa.int64()), "spans": pa.array([s for _, s in found], kind)})

    return mapped(documents(docs, id_col, text_col), run, f"doc_id long, n_words long, spans {_SPAN}")
