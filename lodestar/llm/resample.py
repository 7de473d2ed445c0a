"""Importance resampling towards a target: draw the documents that look most like it, without replacement, in order.

Hashed one- and two-word features are counted over all documents and over the target; the gain of a bucket is the log of
the two shares, kept in one array that scores every document. Gumbel noise makes the highest scores a sample. The order is
made by merging: each partition's eligible rows are a sorted run, cut into chunks at the bounds of ranges, and the runs of a
range are merged by a tournament tree that reads a chunk no sooner than its first row may win.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import PLAIN, documents, durable, mapped, texts

#: Rows of a chunk of a run, and about as many rows in a range of the order, whose runs one task merges.
CHUNK, RANGE = 4096, 1 << 18
#: Bytes of a text whose words are held at once.
PIECE = 1 << 20
SCORED = "doc_id long, n_features long, weight long, score long, eligible boolean"


def feature_hashes(text: bytes, piece: int | None = None) -> Iterator[np.ndarray]:
    """CRC-32 of all words and pairs of neighbouring words of a text, in pieces; a pair belongs to its second word."""
    piece = piece or PIECE
    plain, at, last = text.translate(PLAIN), 0, None
    while at < len(plain):
        end = plain.find(b" ", at + piece) if len(plain) - at > piece else len(plain)
        end = len(plain) if end < 0 else end
        words = plain[at:end].split()
        at = end + 1
        if words:
            single = [zlib.crc32(w) for w in words]
            before = single[:-1] if last is None else [last, *single[:-1]]
            after = words[1:] if last is None else words
            last = single[-1]
            yield np.array(single + [zlib.crc32(w, zlib.crc32(b" ", c)) for c, w in zip(before, after)], np.int64)


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all texts fall in each bucket; tasks send sums a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, block in texts(batch):
                for text in block:
                    for h in feature_hashes(text):
                        sums += np.bincount(h % buckets, minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "n": pa.array(sums[at], pa.int64())})

    out = np.zeros(buckets, np.int64)
    for r in mapped(rows, count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(of_all: np.ndarray, of_target: np.ndarray) -> np.ndarray:
    """The gain of each bucket in thousandths, rounded down; every count is one larger than it is."""
    n, s_all, t_all = len(of_all), int(of_all.sum()), int(of_target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + n)) / float((s + 1) * (t_all + n)))) for s, t in zip(of_all.tolist(), of_target.tolist())], np.int64)


def noise(doc_id: int, seed: int) -> int:
    """Gumbel noise in thousandths, rounded down, that depends on the id and the seed alone."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(rows: DataFrame, gain: np.ndarray, seed: int, least_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, block in texts(batch):
                out: list[tuple] = []
                for i, text in zip(ids, block):
                    n = total = 0
                    for h in feature_hashes(text):
                        n += len(h)
                        total += int(gain[h % len(gain)].sum())
                    weight = total // n if n else 0
                    out.append((i, n, weight, None if i is None else weight + noise(i, seed), i is not None and n >= 2 * least_words - 1 and n > 0))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if k == 4 else pa.int64()) for k, c in enumerate(zip(*out))], ["doc_id", "n_features", "weight", "score", "eligible"])

    return mapped(rows, run, SCORED)


class Tournament:
    """A tree of matches between sorted chunks; the root is the smallest next row. Places are reused, the tree doubles when full."""

    def __init__(self) -> None:
        self.size = 1
        self.chunks: list[list | None] = [None]
        self.heads: list[tuple | None] = [None]
        self.tree = [0, 0]
        self.free = [0]

    def _wins(self, a: int, b: int) -> int:
        x, y = self.heads[a], self.heads[b]
        return a if y is None or (x is not None and x <= y) else b

    def _replay(self, leaf: int) -> None:
        at = (leaf + self.size) // 2
        while at:
            left, right = (2 * at, 2 * at + 1)
            a = self.tree[left] if left < self.size else left - self.size
            b = self.tree[right] if right < self.size else right - self.size
            self.tree[at] = self._wins(a, b)
            at //= 2

    def add(self, chunk: list[tuple]) -> None:
        """``chunk``: rows in descending order, so that the next is taken from the end."""
        if not self.free:
            self.free = list(range(2 * self.size - 1, self.size - 1, -1))
            self.chunks += [None] * self.size
            self.heads += [None] * self.size
            self.size *= 2
            self.tree = [0] * self.size
            for leaf in range(0, self.size, 2):
                self._replay(leaf)
        leaf = self.free.pop()
        self.heads[leaf] = chunk.pop()
        self.chunks[leaf] = chunk
        self._replay(leaf)

    def first(self) -> tuple | None:
        return self.heads[self.tree[1] if self.size > 1 else 0]

    def take(self) -> tuple:
        leaf = self.tree[1] if self.size > 1 else 0
        out, chunk = self.heads[leaf], self.chunks[leaf]
        if chunk:
            self.heads[leaf] = chunk.pop()
        else:
            self.heads[leaf] = self.chunks[leaf] = None
            self.free.append(leaf)
        self._replay(leaf)
        return out


def _packed(batches: Iterator[pa.RecordBatch], bounds: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """A sorted run as chunks: rows (range, first_score, first_id, size, rows); no chunk crosses a bound."""
    held: list[tuple] = []
    now = -1

    def chunk() -> pa.RecordBatch:
        raw = np.array(held, np.int64).tobytes()
        first = held[0]
        return pa.RecordBatch.from_pydict({
            "range": pa.array([now], pa.int64()), "run": pa.array([TaskContext.get().partitionId()], pa.int64()), "first_score": pa.array([-first[0]], pa.int64()),
            "first_id": pa.array([first[1]], pa.int64()), "size": pa.array([len(held)], pa.int64()), "rows": pa.array([raw], pa.binary()),
        })

    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("less", "doc_id", "n_features", "weight"))):
            r = bisect.bisect_right(bounds, row[:2])
            if held and (r != now or len(held) == CHUNK):
                yield chunk()
                held = []
            now = r
            held.append(row)
    if held:
        yield chunk()


def _merged(batches: Iterator[pa.RecordBatch], before: dict[int, int], draw: int) -> Iterator[pa.RecordBatch]:
    """Ranges one after another, their chunks by first row: the rows in order with their ranks, beyond the draw without."""
    out: list[tuple] = []
    tree, now, rank = Tournament(), None, 0

    def flush(limit: tuple | None) -> Iterator[pa.RecordBatch]:
        """Give rows out until the next chunk may hold a smaller one."""
        nonlocal rank, out, tree
        while (best := tree.first()) is not None and (limit is None or best[:2] < limit) and rank < draw:
            row = tree.take()
            rank += 1
            out.append((row[1], row[2], row[3], -row[0], rank))
            if len(out) >= 20_000:
                yield batch()
        if rank >= draw:  # the draw is complete: what is left needs no order
            for row in [r for h, c in zip(tree.heads, tree.chunks) if h is not None for r in (h, *c)]:
                out.append((row[1], row[2], row[3], -row[0], None))
            tree = Tournament()
            if len(out) >= 20_000:
                yield batch()

    def batch() -> pa.RecordBatch:
        nonlocal out
        columns = list(zip(*out)) or [()] * 5
        out = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "n_features", "weight", "score", "rank"])

    for b in batches:
        for r, score, first, raw in zip(*(b.column(c).to_pylist() for c in ("range", "first_score", "first_id", "rows"))):
            if r != now:
                yield from flush(None)
                now, rank = r, before[r]
            yield from flush((-score, first))
            tree.add([tuple(x) for x in np.frombuffer(raw, np.int64).reshape(-1, 4)[::-1].tolist()])
    yield from flush(None)
    yield batch()


def ranges(eligible: DataFrame, counts: list[tuple[int, int]], cut: int, most: int) -> list[tuple[int, int]]:
    """Bounds (-score, id) that part all rows from the cut score up into ranges of about ``most`` rows, the best first.

    A score that more rows have is parted by quantiles of their ids.
    """
    bounds, held = [], 0
    wide = [s for s, n in counts if s >= cut and n > most]
    parts = {}
    if wide:
        pieces = max(2, -(-max(n for _, n in counts) // most))
        steps = F.array(*[F.lit(k / pieces) for k in range(1, pieces)])
        for r in eligible.where(F.col("score").isin(wide)).groupBy("score").agg(F.percentile_approx("doc_id", steps, 10 * pieces).alias("ids")).collect():
            parts[r["score"]] = r["ids"]
    for s, n in counts:  # scores fall
        if s < cut:
            break
        if s in parts or held + n > most:
            if held or bounds:
                bounds.append((-s, -(1 << 63)))
            held = 0
        held += n
        for i in parts.get(s, ()):
            bounds.append((-s, i))
            held = most
    return sorted(set(bounds))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = 25, seed: int = 7, buckets: int = 10_000, least_words: int = 20
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; ``rank`` from 1 in the order of the draw, else null.

    Of the N documents with an id and at least ``least_words`` words, floor(percent * N / 100) are drawn: the highest
    scores, ties to the smaller id; rows equal in both are drawn in the order of n_features and weight. A document without
    an id has no noise, so no score, and is not drawn. Null and empty texts have weight 0. Other columns are not read.
    The driver sees the counts of buckets, of scores (whole thousandths, within some 100,000) and of ranges.
    """
    rows = documents(docs, id_col, text_col)
    gain = gains(bucket_counts(rows, buckets), bucket_counts(target.select(F.lit(None).cast("long").alias("doc_id"), F.coalesce(F.col(target_text), F.lit("")).alias("text")), buckets))
    every = durable(scored(rows, gain, seed, least_words))
    eligible = every.where("eligible")
    counts = sorted(((r["score"], r["count"]) for r in eligible.groupBy("score").count().collect()), reverse=True)
    draw = percent * sum(n for _, n in counts) // 100
    undrawn = F.lit(None).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    if not draw:
        return every.select(*columns, undrawn)
    left, cut = draw, counts[0][0]
    for cut, n in counts:
        left -= n
        if left <= 0:
            break
    bounds = ranges(eligible, counts, cut, RANGE)
    high = F.col("eligible") & (F.col("score") >= cut)
    sorted_runs = every.where(high).select((-F.col("score")).alias("less"), "doc_id", "n_features", "weight").sortWithinPartitions("less", "doc_id", "n_features", "weight")
    chunks = durable(mapped(sorted_runs, lambda b: _packed(b, bounds), "range long, run long, first_score long, first_id long, size long, rows binary"))
    before, total = {}, 0
    for r in chunks.groupBy("range").agg(F.sum("size").alias("size")).orderBy("range").collect():  # a row a range
        before[r["range"]] = total
        total += r["size"]
    ordered = chunks.repartition("range").sortWithinPartitions("range", F.desc("first_score"), "first_id", "run")
    drawn = mapped(ordered, lambda b: _merged(b, before, draw), "doc_id long, n_features long, weight long, score long, rank long")
    return drawn.union(every.where(~high).select(*columns, undrawn))
