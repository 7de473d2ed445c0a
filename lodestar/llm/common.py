"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import durable, shared_folder, ship

__all__ = ["components", "documents", "durable", "mapped", "prefix_sums", "shared_folder", "texts", "unused"]


def unused(names: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, lengthened where one of ``names`` is like it; names are compared as Spark does, in any case."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped to the workers, which give their memory back after each task."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Return what allocators keep to the system: workers stay for the next task, their arrays should not."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that matter, under fixed names; a null text is an empty text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def texts(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, UTF-8 texts) of a batch in blocks of about ``most`` bytes, so that working arrays stay small."""
    ids, raw = batch.column("doc_id").to_pylist(), batch.column(column).cast(pa.large_binary())
    block_ids, block, held = [], [], 0
    for i, x in zip(ids, raw):
        b = x.as_py() or b""
        block_ids.append(i)
        block.append(b)
        held += len(b)
        if held >= most:
            yield block_ids, block
            block_ids, block, held = [], [], 0
    if block:
        yield block_ids, block


#: A-Z to a-z; other ASCII that is no letter or digit to a space. Bytes of longer characters stay.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


#: Links that one task joins by itself instead of in rounds.
FEW_LINKS = 200_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all links in the batches, by union-find with the smallest node as root."""
    up: dict = {}

    def root(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    if kind is not None:
        nodes = list(up)
        yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, kind), "root": pa.array([root(x) for x in nodes], kind)})


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)``: (node, root), root the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows the hooks to their end by pointer jumping and
    contracts the graph; at least half of the nodes that still have links go, so the rounds are logarithmic. Nothing
    reaches the driver but counts. Nodes without links are not returned. At most ``FEW_LINKS`` links are joined by one
    task, with the same result.
    """
    edges = durable(links.where("a <> b").select("a", "b").distinct())
    if edges.count() <= FEW_LINKS:
        kind = dict(edges.dtypes)["a"]
        return durable(mapped(edges.coalesce(1), _joined, f"node {kind}, root {kind}"))
    found: DataFrame | None = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        hook = durable(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")))
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            hook = durable(hook.join(up, "root").select("node", F.col("higher").alias("root"), (F.col("higher") != F.col("root")).alias("moved")))
            moved = not hook.where("moved").isEmpty()
            hook = hook.select("node", "root")
            if not moved:
                break
        if found is None:
            found = hook
        else:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            found = durable(found.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root")))
        ra, rb = hook.select(F.col("node").alias("a"), F.col("root").alias("ra")), hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = durable(edges.join(ra, "a").join(rb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if edges.isEmpty():
            return found


#: Values of ``order`` that one range of prefix sums covers.
RANGE = 1024


def prefix_sums(rows: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of the same ``keys`` (not null) before each, by ``order``, a whole number that differs.

    In two levels: ranges of ``order`` are summed, the ranges' own prefix sums are joined to the sums inside them, so no
    task orders more rows of a key than there are ranges, or values in a range.
    """
    part, inner, base, total = unused([*rows.columns, name], "part", "inner", "base", "total")
    rows = rows.withColumn(part, F.floor(F.col(order) / RANGE)).withColumn(inner, value)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, part).agg(F.sum(inner).alias(total))
    sums = sums.select(*keys, part, F.coalesce(F.sum(total).over(before(Window.partitionBy(*keys).orderBy(part))), F.lit(0)).alias(base))
    own = F.coalesce(F.sum(inner).over(before(Window.partitionBy(*keys, part).orderBy(order))), F.lit(0))
    return rows.withColumn(name, own).join(sums, [*keys, part]).withColumn(name, F.col(name) + F.col(base)).drop(part, inner, base)
