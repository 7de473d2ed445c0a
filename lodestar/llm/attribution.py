"""Token counts per section by offset-mapped attribution.

A whole document is encoded once; a byte-level vocabulary keeps every byte, so token lengths add up to the tokens' byte
offsets. Sections are byte intervals of the document, its lines or those that a table names; tokens are joined to them by
their offsets, and a token over a boundary goes where the rule says: ``first`` (section of its first byte), ``last`` (of
its last byte) or ``most`` (the section that holds most of its bytes, the earlier one if two hold as many).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import documents, mapped, texts

RULES = ("first", "last", "most")
_loaded: dict[tuple[str, str], tuple] = {}


def encoding(path: str, pattern: str) -> tuple:
    """A byte-level encoding from a ranks file, and the length of each of its tokens; read once in each worker."""
    if (path, pattern) not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _loaded[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _loaded[path, pattern]


def line_sections(text: bytes) -> np.ndarray:
    """Ends of a text's lines; a line holds its line feed. An empty text is one empty section."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(text) else np.append(ends, len(text))


def attribute(ends: np.ndarray, token_ends: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross a boundary. Both arguments end at the text's end."""
    starts = np.append(0, token_ends[:-1])[: len(token_ends)]
    first = np.searchsorted(ends, starts, "right")
    last = np.searchsorted(ends, token_ends - 1, "right")
    own = first if rule == "first" else last
    if rule == "most":
        own = first.copy()
        begins = np.append(0, ends[:-1])
        for t in np.flatnonzero(first != last).tolist():
            s = np.arange(first[t], last[t] + 1)
            own[t] = s[(np.minimum(ends[s], token_ends[t]) - np.maximum(begins[s], starts[t])).argmax()]
    return np.bincount(own, minlength=len(ends)), np.bincount(own, weights=first != last, minlength=len(ends)).astype(np.int64)


def attribute_any(sections: np.ndarray, token_ends: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """The same for any intervals (rows start, end, in order), which may overlap or leave gaps.

    Under ``first`` and ``last`` a token goes to every section that holds that byte, under ``most`` to one at most.
    """
    starts, ends = sections[:, 0], sections[:, 1]
    begins = np.append(0, token_ends[:-1])[: len(token_ends)]
    lo, hi = np.searchsorted(token_ends, starts, "right"), np.searchsorted(begins, ends, "left")
    n = np.where(ends > starts, np.maximum(0, hi - lo), 0)
    own = np.repeat(np.arange(len(sections)), n)
    token = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    a, z = begins[token], token_ends[token]
    shared = np.minimum(z, ends[own]) - np.maximum(a, starts[own])
    if rule == "most":
        order = np.lexsort((own, -shared, token))
        keep = np.zeros(len(own), bool)
        keep[order[np.append(True, token[order][1:] != token[order][:-1])] if len(order) else order] = True
    else:
        byte = a if rule == "first" else z - 1
        keep = (starts[own] <= byte) & (byte < ends[own])
    return np.bincount(own[keep], minlength=len(sections)), np.bincount(own[keep & (shared < z - a)], minlength=len(sections))


def section_tokens(docs: DataFrame, ranks_path: str, pattern: str, rule: str = "first", id_col: str = "doc_id", text_col: str = "text", sections: DataFrame | None = None) -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing) for every section of every row.

    Sections are the lines, or those of ``sections(doc_id, start, end)``; they are numbered from 0 in their order, start
    and end are bytes. Over a document's lines the tokens add up to those of the whole text. A null or empty text is one
    empty line without tokens. Rows that share an id, or have none, give lines each.

    Sections of a table may overlap and leave gaps; equal ones of a document count once, bytes beyond a text hold no
    tokens, rows with a null are left out. Documents without sections, and those without an id, give no rows then.
    Other columns play no part. Empty tables give no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    from_table = sections is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sizes = encoding(ranks_path, pattern)
        for batch in batches:
            given = batch.column("sections").to_pylist() if from_table else None
            at = 0
            for ids, block in texts(batch):
                doc, cols = [], []
                for i, b in zip(ids, block):
                    tokens = np.array(enc.encode_ordinary(b.decode("utf-8", "replace")), np.int64) if b else np.zeros(0, np.int64)
                    token_ends = np.cumsum(sizes[tokens])
                    if given is None:
                        ends = line_sections(b)
                        spans = np.stack([np.append(0, ends[:-1]), ends], 1)
                        n, crossing = attribute(ends, token_ends, rule)
                    else:
                        spans = np.array(sorted((s["start"], s["end"]) for s in given[at]), np.int64).reshape(-1, 2)
                        n, crossing = attribute_any(spans, token_ends, rule)
                    at += 1
                    doc += [i] * len(spans)
                    cols.append(np.column_stack([np.arange(len(spans)), spans, n, crossing]))
                out = np.concatenate(cols).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64())} | {c: pa.array(out[:, k].copy()) for k, c in enumerate(("section", "start", "end", "n_tokens", "n_crossing"))})

    read = documents(docs, id_col, text_col)
    if from_table:
        s = sections.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).dropna()
        read = read.join(s.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("sections")), "doc_id")
    return mapped(read, run, "doc_id long, section long, start long, end long, n_tokens long, n_crossing long")
