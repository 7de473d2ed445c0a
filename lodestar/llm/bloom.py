"""A pair of Bloom filters, for hashes seen once and seen twice, built in segments over a cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import mapped, unused
from lodestar.session import ship

#: Bits of a segment; a hash sets all its bits in one segment.
SEGMENT_BITS = 1 << 20
#: Bits for each expected hash.
BITS_EACH = 12
PROBES = 4
#: The filter that is sent to all tasks has no more bits than this (16 MB); beyond, it is folded onto itself.
MOST_BITS = 1 << 27


def segments_for(hashes: int) -> int:
    """A power of two of segments, so that a filter can be folded."""
    return 1 << max(0, (max(1, hashes) * BITS_EACH - 1) // SEGMENT_BITS).bit_length()


def _bits(h: np.ndarray) -> Iterator[np.ndarray]:
    """Bit numbers inside the segment, one array a probe: double hashing on the upper bits."""
    step = (h >> np.uint64(40)) | np.uint64(1)
    at = h >> np.uint64(20)
    for k in range(PROBES):
        with np.errstate(over="ignore"):
            yield ((at + step * np.uint64(k)) & np.uint64(SEGMENT_BITS - 1)).astype(np.int64)


def _segment(h: np.ndarray, segments: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(34) & np.uint64(segments - 1)).astype(np.int64)


class Filter:
    """Bits of ``segments`` segments, as a plain array that pickles."""

    def __init__(self, segments: int, folded: int = 0) -> None:
        self.segments = max(1, min(segments, folded or segments))
        self.bits = np.zeros(self.segments * SEGMENT_BITS // 8, np.uint8)

    def merge(self, segment: int, bits: bytes) -> None:
        at = segment % self.segments * SEGMENT_BITS // 8
        self.bits[at : at + SEGMENT_BITS // 8] |= np.frombuffer(bits, np.uint8)

    def __contains__(self, h: int) -> bool:
        return bool(self.has(np.array([h], np.uint64))[0])

    def has(self, h: np.ndarray) -> np.ndarray:
        """True where a hash may have been added; never False where it was."""
        base = _segment(h, self.segments) * SEGMENT_BITS
        out = np.ones(len(h), bool)
        for at in _bits(h):
            at = at + base
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def packed(h: np.ndarray, segments: int) -> pa.RecordBatch:
    """Rows (segment, hashes) for ``segment_filters``: what one task has seen, a hash twice at most."""
    u, n = np.unique(h, return_counts=True)
    u = np.concatenate([u, u[n > 1]])
    s = _segment(u, segments)
    order = np.argsort(s, kind="stable")
    u, s = u[order], s[order]
    starts = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(s))
    return pa.RecordBatch.from_pydict({"segment": pa.array(s[starts], pa.int64()), "hashes": pa.array([u[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())})


def seen_filter(rows: DataFrame, segments: int, times: int = 2) -> Filter:
    """The filter of hashes seen at least ``times`` (1 or 2) times, from ``rows(segment, hashes)``.

    A task takes its segments one after another: a hash whose bits are all set in the segment's once-seen filter, or
    that comes twice in one row, enters the twice-seen filter. Tasks fold those filters to at most ``MOST_BITS`` bits
    together before they are joined, so that neither a shuffle nor the driver sees more, however many segments there
    are; a folded filter lets more hashes pass that were seen once, and none less.
    """
    slots = max(1, min(segments, MOST_BITS // SEGMENT_BITS))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, again = -1, None, None
        folded: dict[int, np.ndarray] = {}

        def done() -> None:
            bits = np.packbits(again, bitorder="little")
            slot = now % slots
            folded[slot] = folded[slot] | bits if slot in folded else bits

        for batch in batches:
            for s, raw in zip(batch.column("segment").to_pylist(), batch.column("hashes").to_pylist()):
                if s != now:
                    if now >= 0:
                        done()
                    now, once, again = s, np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
                h = np.sort(np.frombuffer(raw, np.uint64))
                seen = np.append(h[1:] == h[:-1], False)
                hit = np.ones(len(h), bool)
                for at in _bits(h):
                    hit &= once[at]
                for at in _bits(h[seen | hit] if times == 2 else h):
                    again[at] = True
                for at in _bits(h):
                    once[at] = True
        if now >= 0:
            done()
        for slot, bits in folded.items():
            yield _slot(slot, bits)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, raw in zip(batch.column("slot").to_pylist(), batch.column("bits").to_pylist()):
                bits = np.frombuffer(raw, np.uint8)
                folded[slot] = folded[slot] | bits if slot in folded else bits
        for slot, bits in folded.items():
            yield _slot(slot, bits)

    built = mapped(rows.repartition("segment").sortWithinPartitions("segment"), build, "slot long, bits binary")
    if segments > slots:  # else a slot is one segment, which one task has built
        built = mapped(built.repartition("slot"), join, "slot long, bits binary")
    out = Filter(segments, slots)
    for r in built.collect():  # ``MOST_BITS`` bits at most, in one job; an iterator takes a job for each partition
        out.merge(r["slot"], r["bits"])
    return out


def _slot(slot: int, bits: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"slot": pa.array([slot], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})


def _scattered(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def may_be_among(ids: DataFrame, column: str, of: Column) -> Column:
    """Whether ``of`` may be one of the values of ``ids``, whole numbers or null: true for each that is, rarely for others.

    The filter that is sent has ``MOST_BITS`` bits at most. It looks at the one column only, so that rows which no other
    table has a say in need not move.
    """
    some = ids.select(F.coalesce(F.col(column).cast("long"), F.lit(-(1 << 63))).alias("id"))
    segments = segments_for(some.count())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield packed(_scattered(batch.column("id").to_numpy()), segments)

    ship(ids.sparkSession)
    sent = ids.sparkSession.sparkContext.broadcast(seen_filter(mapped(some, pack, "segment long, hashes binary"), segments, 1))

    @F.pandas_udf("boolean")
    def among(x: pd.Series) -> pd.Series:
        return pd.Series(sent.value.has(_scattered(x.to_numpy())))

    return among(F.coalesce(of.cast("long"), F.lit(-(1 << 63))))


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the rows whose id is in ``ids(id_col)``; rows without an id stay, and only rows that may go are shuffled."""
    (name,) = unused(docs.columns, "gone")
    gone = ids.select(F.col(id_col).cast("long").alias(name)).where(F.col(name).isNotNull())
    suspect = may_be_among(gone, name, F.col(id_col))
    return docs.where(~suspect).union(docs.where(suspect).join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti"))
