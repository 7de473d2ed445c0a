"""Exact top-k by inner product: a KD-tree per shard, best-first traversal, a propagated kth score.

Space is cut into cells by median splits of a bounded sample (``SAMPLE_VALUES``); a cell's vectors are dealt to shards of
bounded size by a hash of their id. Each shard builds a tree by median splits of the widest dimension with tight bounding
boxes. A query's bound for a box is its largest inner product with any point in it; leaves are taken in order of their
bounds until none can beat the kth score. A query is searched in its own shard first; with its kth score it goes to the
shards of those other cells whose boxes can still beat it.

Queries meet shards in blocks: a stated query set against all rows, with at most ``k`` rows back for each query and shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import durable, mapped

#: Vectors of one shard, about; the shard's tree is in one task's memory.
SHARD = 32_768
LEAF = 256
#: Queries of one block.
QUERY_BLOCK = 1024
#: Cells at most, and numbers in the sample that cuts them.
CELLS, SAMPLE_VALUES = 256, 1 << 20


def kind_of(most: int, width: int) -> type:
    """The cheapest numbers in which inner products of components up to ``most`` are exact."""
    bound = most * most * max(1, width)
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object


class Splits:
    """Median splits of the widest dimension: the cell of any point."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.nodes: list[tuple[int, int, int, int]] = []  # dimension, value, children; a cell has dimension -1 and its number
        self.cells = 0
        self._grow(sample, max(1, min(cells, len(sample) // 32)))

    def _grow(self, rows: np.ndarray, cells: int) -> int:
        node = len(self.nodes)
        self.nodes.append((-1, self.cells, 0, 0))
        wide = rows.max(0) - rows.min(0) if cells > 1 and rows.size else np.zeros(1, np.int64)
        at = int(wide.argmax())
        if not wide[at]:
            self.cells += 1
            return node
        value = int(np.partition(rows[:, at], len(rows) // 2)[len(rows) // 2])
        low = rows[:, at] < value
        if not low.any():  # half of the rows or more have the smallest value
            value, low = value + 1, rows[:, at] < value + 1
        self.nodes[node] = (at, value, self._grow(rows[low], cells // 2), self._grow(rows[~low], cells - cells // 2))
        return node

    def of(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        nodes = np.array(self.nodes, np.int64)
        while (going := np.flatnonzero(nodes[at, 0] >= 0)).size:
            dimension, value, low, high = nodes[at[going]].T
            at[going] = np.where(points[going, dimension] < value, low, high)
        return nodes[at, 1]


class Tree:
    """Median splits over integer vectors; ``ids`` break ties. Equal rows beyond ``k``, and equal vectors beyond the 2 ``k`` smallest ids of the rest, cannot be results."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, k: int) -> None:
        order = np.lexsort((ids, *points.T[::-1])) if points.shape[1] else np.argsort(ids)
        ids, points = ids[order], points[order]
        for most in (k, 2 * k):  # a query leaves out its own id, of which k rows are left at most
            head = np.append(True, (points[1:] != points[:-1]).any(1)) if len(ids) else np.zeros(0, bool)
            if most == k and len(ids):
                head[1:] |= ids[1:] != ids[:-1]
            run = np.arange(len(ids)) - np.maximum.accumulate(np.where(head, np.arange(len(ids)), 0)) if len(ids) else np.zeros(0, np.int64)
            ids, points = ids[run < most], points[run < most]
        leaves: list[np.ndarray] = []

        def grow(rows: np.ndarray) -> None:
            wide = points[rows].max(0) - points[rows].min(0) if points.shape[1] else np.zeros(1)
            if len(rows) <= LEAF or not wide.any():
                leaves.append(rows)
                return
            order = np.argsort(points[rows, int(wide.argmax())], kind="stable")
            half = len(rows) // 2
            grow(rows[order[:half]])
            grow(rows[order[half:]])

        if len(ids):
            grow(np.arange(len(ids)))
        self.leaf_ids, self.leaf_points = [ids[r] for r in leaves], [points[r] for r in leaves]
        self.low, self.high = (np.array([f(p, 0) for p in self.leaf_points]).reshape(len(leaves), -1) for f in (np.min, np.max))

    def search(self, names: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's row, score, id) of each query's best ``k`` that are no worse than its ``floor``, best first, the query's own id left out.

        A box is never better than one it lies in, so a best-first walk meets leaves in the order of their own bounds. All
        queries walk together: first their best leaf, then the next, then twice as many each time, always only those that
        can still beat the kth score.
        """
        least = floor.copy()
        row, score, found = np.zeros(0, np.int64), np.zeros(0, queries.dtype), np.zeros(0, np.int64)
        bounds = _bounds(queries, self.low, self.high)
        order = np.argsort(-bounds, 1, kind="stable")
        lo, hi = 0, 1
        while lo < len(self.leaf_ids):
            held = [(row, score, found)]
            leaf = order[:, lo:hi].reshape(-1)
            asks = np.repeat(np.arange(len(queries)), min(hi, len(self.leaf_ids)) - lo)
            able = bounds[asks, leaf] >= least[asks]
            if not able.any():
                break
            leaf, asks = leaf[able], asks[able]
            by_leaf = np.argsort(leaf, kind="stable")
            leaf, asks = leaf[by_leaf], asks[by_leaf]
            cut = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1]))
            for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(leaf)]):
                some, x = asks[a:z], int(leaf[a])
                s = queries[some] @ self.leaf_points[x].T
                ids = self.leaf_ids[x]
                bar = least[some]
                if len(ids) > 2 * k and s.dtype != object:  # of one leaf no more can be results, the own id's rows aside
                    bar = np.maximum(bar, np.partition(s, len(ids) - 2 * k, 1)[:, len(ids) - 2 * k])
                i, j = np.nonzero((s >= bar[:, None]) & (ids[None] != names[some][:, None]))
                held.append((some[i], s[i, j], ids[j]))
            row, score, found = (np.concatenate(x) for x in zip(*held))
            best = np.lexsort((found, -score, row))
            row, score, found = row[best], score[best], found[best]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            row, score, found, nth = row[nth < k], score[nth < k], found[nth < k], nth[nth < k]
            last = nth == k - 1
            least[row[last]] = np.maximum(least[row[last]], score[last])
            lo, hi = hi, max(hi + 1, 2 * hi)
        return row, score, found


def _bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product of each query with a point of each box."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


_BLOCK = "shard long, kind int, ids binary, points binary, floors binary, times binary"
_LOW = -(1 << 62)


def _block(shard: int, kind: int, ids: np.ndarray, points: np.ndarray, floors: np.ndarray | None = None, times: np.ndarray | None = None) -> dict:
    """A row of vectors (kind 0) or queries (kind 1) that go to a shard; numbers are little-endian, components as narrow as they fit."""
    most = int(np.abs(points).max(initial=0))
    narrow = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    raw = [None if x is None else x.astype("<i8").tobytes() for x in (floors, times)]
    return {"shard": shard, "kind": kind, "ids": ids.astype("<i8").tobytes(), "points": narrow.encode() + points.astype(narrow).tobytes(), "floors": raw[0], "times": raw[1]}


def _points(raw: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(raw[3:], raw[:3].decode()).astype(np.int64).reshape(n, width)


def _rows(blocks: list[dict]) -> pa.RecordBatch:
    kinds = {"shard": pa.int64(), "kind": pa.int32()}
    return pa.RecordBatch.from_pydict({c: pa.array([b[c] for b in blocks], kinds.get(c, pa.binary())) for c in ("shard", "kind", "ids", "points", "floors", "times")})


class Shards:
    """Where vectors and queries go: cells, the shards of each, and the boxes of cells."""

    def __init__(self, splits: Splits, sizes: dict[int, int], low: np.ndarray, high: np.ndarray) -> None:
        self.splits, self.low, self.high = splits, low, high
        self.each = np.array([-(-sizes.get(c, 0) // SHARD) for c in range(splits.cells)], np.int64)
        self.first = np.cumsum(self.each) - self.each

    @property
    def count(self) -> int:
        return int(self.each.sum())

    def of(self, ids: np.ndarray, points: np.ndarray) -> np.ndarray:
        cell = self.splits.of(points)
        with np.errstate(over="ignore"):
            h = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return self.first[cell] + (h >> np.uint64(33)).astype(np.int64) % np.maximum(1, self.each[cell])


def _shards(points: DataFrame, n: int, width: int, kind: type) -> Shards:
    """Cells by a bounded sample, their sizes and boxes by one pass over all vectors."""
    wanted = min(CELLS, -(-n // SHARD))
    rows = points.select("id", "point").orderBy(F.xxhash64("id"), "id").limit(max(64, SAMPLE_VALUES // max(1, width))).collect() if wanted > 1 else []
    splits = Splits(np.array([r["point"] for r in rows], np.int64).reshape(len(rows), width), wanted)

    def sized(cells: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(cells, kind="stable")
        cut = np.flatnonzero(np.append(True, cells[order][1:] != cells[order][:-1])) if len(cells) else np.zeros(0, np.int64)
        lows, highs = (f.reduceat(x[order], cut) if len(cut) else x for f, x in ((np.minimum, low), (np.maximum, high)))
        total = np.add.reduceat(n[order], cut) if len(cut) else n
        raw = [[r.astype("<i8").tobytes() for r in x] for x in (lows, highs)]
        return pa.RecordBatch.from_pydict({"cell": pa.array(cells[order][cut], pa.int64()), "n": pa.array(total, pa.int64()), "low": pa.array(raw[0], pa.binary()), "high": pa.array(raw[1], pa.binary())})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _matrix(batch.column("point"), width)
            yield sized(splits.of(p), np.ones(len(p), np.int64), p, p)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            parts = pa.Table.from_batches([batch] if held is None else [held, batch])
            low, high = (np.frombuffer(b"".join(parts.column(c).to_pylist()), "<i8").reshape(len(parts), width) for c in ("low", "high"))
            held = sized(parts.column("cell").to_numpy(), parts.column("n").to_numpy(), low, high)
        if held is not None:
            yield held

    schema = "cell long, n long, low binary, high binary"
    joined = mapped(mapped(points, read, schema).repartition("cell"), join, schema)
    low, high = np.zeros((splits.cells, width), np.int64), np.zeros((splits.cells, width), np.int64)
    sizes = {}
    for r in joined.collect():  # at most `CELLS` rows
        sizes[r["cell"]] = r["n"]
        low[r["cell"]], high[r["cell"]] = np.frombuffer(r["low"], "<i8"), np.frombuffer(r["high"], "<i8")
    return Shards(splits, sizes, low.astype(kind), high.astype(kind))


def _searched(blocks: DataFrame, k: int, width: int, kind: type) -> DataFrame:
    """(query_id, vec_id, score) of ``_BLOCK`` rows: each shard's vectors come before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, held = None, None, []
        for batch in batches:
            for s, is_query, ids, points, floors, times in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "ids", "points", "floors", "times"))):
                if s != shard:
                    shard, tree, held = s, None, []
                ids = np.frombuffer(ids, "<i8")
                points = _points(points, len(ids), width).astype(kind)
                if not is_query:
                    held.append((ids, points))
                    continue
                if tree is None:
                    every = [np.concatenate(x) for x in zip(*held)] if held else [np.zeros(0, np.int64), np.zeros((0, width), kind)]
                    tree, held = Tree(*every, k), []
                floor = np.frombuffer(floors, "<i8")
                floor = floor.astype(object) if kind is object else np.where(floor == _LOW, -np.inf, floor).astype(kind)
                row, score, found = tree.search(ids, points, k, floor)
                n = np.frombuffer(times, "<i8")[row]
                row, score, found = np.repeat(row, n), np.repeat(score, n), np.repeat(found, n)
                best = np.arange(len(row)) - np.searchsorted(row, row) < k
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids[row[best]], pa.int64()), "vec_id": pa.array(found[best], pa.int64()), "score": pa.array([int(x) for x in score[best]], pa.int64())})

    return mapped(blocks.repartition("shard").sortWithinPartitions("shard", "kind"), run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows by inner product for each row that ``queries`` picks.

    Components become floor(scale * x) in doubles; scores are whole numbers, ties go to the smaller id, a row is no
    result of its own query. Rows without an id, with a null vector, or with a null or non-finite component take no
    part; vectors of another length than most have do not either (of two lengths as common, the longer stays). Rows that
    share an id, equal ones too, are candidates each, and queries each: an id's answer is the best ``k`` of all its rows'
    pairs, as in a join. Other columns play no part. No queries, or an empty table: no rows. Scores beyond 64 bits are
    refused with an error.
    """
    x = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    points = vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("long")).alias("point"), F.coalesce(queries, F.lit(False)).alias("asks"))
    most = F.max(F.aggregate("point", F.lit(0).cast("long"), lambda a, v: F.greatest(a, F.abs(v))))
    facts = points.groupBy(F.size("point").alias("width")).agg(F.count("*").alias("n"), most.alias("most")).orderBy(F.desc("n"), F.desc("width")).first()
    width, n = (facts["width"], facts["n"]) if facts else (0, 0)
    kind = kind_of(facts["most"] or 0 if facts else 0, width)
    points = points.where(F.size("point") == width)
    shards = _shards(points, n, width, kind)

    def vectors_dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, p = batch.column("id").to_numpy(), _matrix(batch.column("point"), width)
            at = shards.of(ids, p)
            yield _rows([_block(s, 0, ids[at == s], p[at == s]) for s in np.unique(at).tolist()])

    def asked_in(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                b = batch.slice(at, QUERY_BLOCK)
                ids, p, times = b.column("id").to_numpy(), _matrix(b.column("point"), width), b.column("times").to_numpy()
                floors = np.array([_LOW if x is None else x for x in b.column("kth").to_pylist()], np.int64)
                yield _rows([_block(s, 1, ids[some], p[some], floors[some], times[some]) for s, some in of(ids, p, floors)])

    def at_home(ids: np.ndarray, p: np.ndarray, floors: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        at = shards.of(ids, p)
        yield from ((s, at == s) for s in np.unique(at).tolist())

    def abroad(ids: np.ndarray, p: np.ndarray, floors: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        at = shards.of(ids, p)
        able = _bounds(p.astype(kind), shards.low, shards.high) >= floors[:, None]
        for c in range(len(shards.each)):
            for s in range(int(shards.first[c]), int(shards.first[c] + shards.each[c])):
                if (some := able[:, c] & (at != s)).any():
                    yield s, some

    base = mapped(points.select("id", "point"), vectors_dealt, _BLOCK)
    asked = points.where("asks").groupBy("id", "point").agg(F.least(F.count("*"), F.lit(k)).cast("long").alias("times"))
    first = mapped(asked.withColumn("kth", F.lit(None).cast("long")), lambda b: asked_in(b, at_home), _BLOCK)
    own = durable(_searched(base.union(first), k, width, kind))
    found = own
    if shards.count > 1:
        kth = own.groupBy("query_id").agg(F.count("*").alias("have"), F.min("score").alias("kth")).where(F.col("have") >= k)
        others = mapped(asked.join(kth, asked["id"] == kth["query_id"], "left").select("id", "point", "times", "kth"), lambda b: asked_in(b, abroad), _BLOCK)
        found = own.union(_searched(base.union(others), k, width, kind))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
