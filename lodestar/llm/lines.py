"""Line dedup: Bloom filters suspect repeated lines, only suspects are shuffled for exact confirmation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.bloom import may_be_among, packed, seen_filter, segments_for
from lodestar.llm.common import durable, mapped, unused


def line_key(line: bytes) -> bytes:
    """A line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip().lower()


def _long(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least)


def document_keys(text: bytes, least: int) -> set[bytes]:
    """The different keys of a document that are long enough."""
    return {k for k in map(line_key, text.split(b"\n")) if _long(k, least)}


def _hashes(keys: set[bytes] | list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _raw(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    return (x.as_py() or b"" for x in batch.column(column).cast(pa.large_binary()))


def dedup_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    r"""Drop repeated lines: all columns of ``docs`` with the text rewritten, and n_lines (before) and n_dropped.

    A key of at least ``least_chars`` code points that at least ``least_docs`` documents hold loses its lines
    everywhere but in the largest id that holds it; there all of them stay. Other lines stay, joined by ``\n``.

    A null or empty text is one empty line and comes back as an empty text. Rows that share an id are one document;
    rows without an id are together one document, smaller than all others. Input columns named n_lines or n_dropped are
    replaced. An empty table stays empty.

    Pass one hashes each task's lines; the hashes go to Bloom segments for once-seen and twice-seen. Pass two probes
    the twice-seen filter. Suspects are confirmed by SHA-256 of the key, with partial counts before the shuffle; only
    texts of documents that lose a line move.
    """
    if least_docs < 2:
        raise ValueError("a repeat needs two documents")
    docs = docs.drop("n_lines", "n_dropped")
    names = docs.columns
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    lines = slim.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).alias("n")).first()["n"] or 1
    segments = segments_for(int(lines))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.uint64)]
        for batch in batches:
            held += [_hashes(keys) for t in _raw(batch, "text") if (keys := document_keys(t, least_chars))]
        yield packed(np.concatenate(held), segments)

    seen = slim.sparkSession.sparkContext.broadcast(seen_filter(mapped(slim, hashed, "segment long, hashes binary"), segments))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, t in zip(batch.column("id").to_pylist(), _raw(batch, "text")):
                own = list(document_keys(t, least_chars))
                if own:
                    own = [own[k] for k in np.flatnonzero(seen.value.has(_hashes(own)))]
                    keys += [hashlib.sha256(k).digest() for k in own]
                    ids += [i] * len(own)
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.binary())})

    found = durable(mapped(slim, suspects, "id long, key binary"))
    counts = found.groupBy("key").agg((F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))).alias("n"), F.max("id").alias("keeper"))
    repeated = durable(counts.where(F.col("n") >= least_docs).select("key", "keeper"))  # a plain side: a key that very many documents hold can be split in the join
    own, gone = unused([*names, "n_lines", "n_dropped"], "id", "drops")
    drops = durable(found.join(repeated, "key").where(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy("id").agg(F.collect_set("key").alias(gone)).withColumnRenamed("id", own))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, dropped = [], []
            for t, keys in zip(_raw(batch, text_col), batch.column(gone).to_pylist()):
                if not keys:
                    texts.append(t)
                    dropped.append(0)
                    continue
                keys, all_lines = set(keys), t.split(b"\n")
                kept = [x for x in all_lines if not (_long(k := line_key(x), least_chars) and hashlib.sha256(k).digest() in keys)]
                texts.append(b"\n".join(kept))
                dropped.append(len(all_lines) - len(kept))
            cols = {c: batch.column(c) for c in [*names, "n_lines"]}
            cols[text_col] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict(cols | {"n_dropped": pa.array(dropped, pa.int64())})

    types = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = docs.withColumn(text_col, text).withColumn("n_lines", (F.length(text_col) - F.length(F.replace(text_col, F.lit("\n"))) + 1).cast("long"))
    loses = may_be_among(drops, own, F.col(id_col))
    touched = every.where(loses).join(drops, F.col(id_col).cast("long").eqNullSafe(F.col(own)), "left").select(*names, "n_lines", gone)
    return every.where(~loses).select(*names, "n_lines", F.lit(0).cast("long").alias("n_dropped")).union(mapped(touched, rewrite, f"{types}, n_lines long, n_dropped long"))
