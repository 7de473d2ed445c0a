"""SimHash near-duplicate groups with bit-sliced comparison.

Fingerprints are majority votes over the hashes of a document's word shingles. Equal fingerprints are one node (where
similarity is asked for, equal sets of shingles). Nodes that may link meet in blocks of a block key; there the
fingerprints lie vertically, bit plane by bit plane, and one fingerprint is compared with 64 others per machine word:
each plane's XOR enters carry-save counters, and a part of the block is abandoned as soon as all its counters exceed the
radius. Blocks give star links, never all pairs, and the links' components are the groups.

Block keys: ``bands`` is exact. The fingerprint is cut into bands of which at most ``radius`` can differ; a key is a
choice of bands that are equal. Blocks above ``BLOCK`` members are dealt again with twice as many bands, which leaves at most
2**16 different fingerprints in one for 64 bits and a radius of 2. ``shingles`` takes minima of the shingle hashes
instead, for radii at which no band is equal: documents that share most shingles share a minimum. Large blocks of these are
dealt as pairs of shares beside the small ones, still larger ones are worked on in passes (``split_links``), as are large
groups whose texts are compared; that changes the work, not the links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.bloom import may_be_among, without
from lodestar.llm.common import components, documents, durable, mapped, texts

#: Members of a block that is compared without being dealt again.
BLOCK = 2048
#: Candidates compared at once, as machine words of 64.
LANES = 512
#: Texts of one candidate group that are compared in one task; larger groups are worked on in shares.
SPLIT = 256
#: Members of a share and pivots of a group at most, and bytes of their shingles; a task compares one group with one share.
SHARE, GROUP, HELD = 2048, 512, 16 << 20
#: Pivots of a block in each pass; the last pass takes all that have not met the others.
PASSES = (64, 1024, None)
#: Members of a block that are all pivots in the first pass, which leaves nothing for the others.
WHOLE = 4096
#: Nodes of a block that is dealt as pairs of shares at most, and of a share about; larger blocks are worked on in passes.
PAIRED, PAIR = 8192, 1024
#: Blocks of which facts are sent to all tasks; facts of more are joined.
SENT_BLOCKS = 10_000

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
# The finalizer of the SplitMix64 generator.
_GAMMA, _MIX_A, _MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent-looking hash of 64-bit hashes; the 0th is the hash itself."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(_GAMMA * k & (1 << 64) - 1)
        z = (z ^ z >> np.uint64(30)) * np.uint64(_MIX_A)
        z = (z ^ z >> np.uint64(27)) * np.uint64(_MIX_B)
    return z ^ z >> np.uint64(31)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of a text's word shingles, A-Z lower-cased, words split at ASCII white space, repeats included."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)], np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(s), 42) for s in zip(*(w[k:] for k in range(words)))), np.uint64, len(w) - words + 1)


def set_digest(h: np.ndarray) -> bytes:
    """What names a set of shingles, given as its sorted distinct hashes."""
    return xxhash.xxh3_128_digest(h.astype("<u8").tobytes())


def vote(h: np.ndarray, lanes: int = 1) -> np.ndarray:
    """The fingerprint, ``lanes`` times 64 bits: a bit is set if it is in over half of the hashes. Counts add up in bytes, 255 rows at a time."""
    if not len(h):
        return np.zeros(lanes, np.uint64)
    rows = np.stack([mix(h, k) for k in range(lanes)], 1) if lanes > 1 else h[:, None]
    bits = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8), axis=1, bitorder="little")
    count = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(bits), 255):
        count += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return np.packbits(count * 2 > len(h), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, words: int = 3, lanes: int = 1, minima: int = 0, sets: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, keys, node): fingerprint as big-endian bytes, and ``minima`` minima of the shingle hashes. No words: all zero.

    A node is a fingerprint. With ``sets`` each different shingle votes once, as sets are what is compared, and a node
    is the digest of a set of shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, block in texts(batch):
                fps, keys, nodes = [], [], []
                for b in block:
                    h = shingle_hashes(b, words)
                    h = np.unique(h) if sets else h
                    fps.append(vote(h, lanes).astype(">u8").tobytes())
                    keys.append([int(mix(h, k + 5).min()) - (1 << 63) for k in range(minima)] if len(h) else [0] * minima)
                    nodes.append(set_digest(h) if sets else fps[-1])
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "fp": pa.array(fps, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64())), "node": pa.array(nodes, pa.binary())})

    return mapped(documents(docs, id_col, text_col), run, "doc_id long, fp binary, keys array<long>, node binary")


def planes(fp: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (rows of 64-bit words): plane p holds bit p of every row, 64 rows to a word."""
    n = len(fp)
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    wide = np.zeros((bits.shape[1], -(-n // 64) * 64), np.uint8)
    wide[:, :n] = bits.T
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def near(differ: Callable[[int], np.ndarray], n: int, rows: int, radius: int) -> np.ndarray:
    """Mask words of the rows at a distance of at most ``radius``; ``differ(p)`` gives plane p's differing bits.

    Vertical counters have as many bits as radius + 1 needs; one that overflows is stuck above the radius. Planes come
    three at a time: a carry-save adder turns three of them into a sum and a carry. When every row is beyond the
    radius, the rest of the planes is left out.
    """
    depth = max(2, (radius + 1).bit_length())
    counter: list = [None] * depth
    stuck = np.zeros(-(-rows // 64), np.uint64)
    past = np.zeros_like(stuck)  # rows that pad the last word
    if rows % 64:
        past[-1] = _ALL << np.uint64(rows % 64)

    def add(x: np.ndarray, level: int) -> None:
        for k in range(level, depth):
            if counter[k] is None:
                counter[k] = x
                return
            counter[k], x = counter[k] ^ x, counter[k] & x
        np.bitwise_or(stuck, x, out=stuck)

    def beyond() -> np.ndarray:
        """Rows above the radius: counters against the radius, from the top bit down."""
        more, same = stuck | past, ~stuck
        for k in reversed(range(depth)):
            c = counter[k] if counter[k] is not None else np.zeros_like(stuck)
            if radius >> k & 1:
                same = same & c
            else:
                more |= same & c
                same &= ~c
        return more

    for p in range(0, n, 3):
        if p + 3 <= n:
            a, b, c = differ(p), differ(p + 1), differ(p + 2)
            half = a ^ b
            add(half ^ c, 0)
            add(a & b | half & c, 1)
        else:
            for k in range(p, n):
                add(differ(k), 0)
        if p % 24 == 21 and p + 3 < n and (beyond() == _ALL).all():
            return np.zeros_like(stuck)
    return ~beyond()


def _rows(mask: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little"))


def _flips(fp: np.ndarray) -> np.ndarray:
    return np.where(np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), bitorder="little"), _ALL, np.uint64(0))


def block_links(fp: np.ndarray, radius: int, same: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Links (member, root) that connect the members of one block that are within the radius of each other, step by step.

    From the first row left on, each row found is compared with all rows not found yet, so a row is compared once and a
    group of m rows gives m - 1 links. ``same(x, y)`` is asked about rows within the radius, where it is given.
    """
    n, out = len(fp), []
    parts = [(at, min(64 * LANES, n - at)) for at in range(0, n, 64 * LANES)]
    held = [planes(fp[at : at + m]) for at, m in parts]
    left = [np.full(p.shape[1], _ALL) for p in held]

    def drop(row: int) -> None:
        left[row // (64 * LANES)][row % (64 * LANES) // 64] &= ~(np.uint64(1) << np.uint64(row % 64))

    seen = np.zeros(n, bool)
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        drop(root)
        queue = [root]
        while queue:
            now = queue.pop()
            flip = _flips(fp[now])
            for (at, m), plane, free in zip(parts, held, left):
                if not free.any():
                    continue
                mask = near(lambda p: plane[p] ^ flip[p], len(plane), m, radius) & free  # noqa: B023
                found = (_rows(mask) + at).tolist()
                if same is None:
                    free &= ~mask
                else:
                    found = [x for x in found if same(x, now)]
                    for x in found:
                        drop(x)
                for x in found:
                    seen[x] = True
                out += [(x, root) for x in found]
                queue += found
    return out


def sorted_links(key: np.ndarray, fp: np.ndarray, radius: int, small: int = 48, same: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Spanning links of all blocks of rows sorted by ``key``.

    Blocks of up to ``small`` rows are compared together: row i with row i + d for all i at once, d = 1, 2, ...; larger
    ones one by one. Links that join what is joined already are left out.
    """
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(starts, len(key)))
    out: list[tuple[int, int]] = []
    for k in np.flatnonzero(sizes > small):
        a = int(starts[k])
        inside = None if same is None else lambda x, y, a=a: same(x + a, y + a)
        out += [(x + a, y + a) for x, y in block_links(fp[a : a + int(sizes[k])], radius, inside)]
    rest = np.repeat(np.where(sizes > small, 0, starts + sizes), sizes)  # the end of each row's block
    at = np.arange(len(key))
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for d in range(1, small):
        at = at[at + d < rest[at]]
        if not len(at):
            break
        for lo in range(0, len(at), 64 * LANES):
            some = at[lo : lo + 64 * LANES]
            a, b = planes(fp[some]), planes(fp[some + d])
            for i in some[_rows(near(lambda p: a[p] ^ b[p], len(a), len(some), radius))].tolist():  # noqa: B023
                x, y = root(i), root(i + d)
                if x != y and (same is None or same(i, i + d)):
                    up[y] = x
                    out.append((i + d, i))
    return out


def _band_keys(fp: np.ndarray, radius: int) -> np.ndarray:
    """Block keys of single-lane fingerprints, a column for each choice of two equal bands of radius + 2."""
    k = radius + 2
    cut = [(64 * i // k, 64 * (i + 1) // k) for i in range(k)]
    value = [(fp[:, 0] >> np.uint64(lo)) & np.uint64((1 << hi - lo) - 1) for lo, hi in cut]
    cols = []
    for n, (i, j) in enumerate(combinations(range(k), 2)):
        with np.errstate(over="ignore"):
            cols.append(mix(mix(value[i] << np.uint64(32) | value[j], 1) + np.uint64(n), 2))
    return np.stack(cols, 1)


def _narrow_keys(fp: np.ndarray, radius: int) -> np.ndarray:
    """Keys inside large blocks: all bits are cut anew into 2 (radius + 2) bands, of which all but ``radius`` are equal."""
    k = 2 * (radius + 2)
    cut = [(64 * i // k, 64 * (i + 1) // k) for i in range(k)]
    value = [(fp[:, 0] >> np.uint64(lo)) & np.uint64((1 << hi - lo) - 1) for lo, hi in cut]
    cols = []
    for n, apart in enumerate(combinations(range(k), radius)):
        h = np.full(len(fp), n, np.uint64)
        for i in range(k):
            if i not in apart:
                with np.errstate(over="ignore"):
                    h = mix(h ^ value[i], 3)
        cols.append(h)
    return np.stack(cols, 1)


def _matrix(column: pa.Array, lanes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, lanes)


def _keyed(nodes: DataFrame, lanes: int, radius: int, how: str) -> DataFrame:
    """(key, fp): a row for each node and block key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fp = _matrix(batch.column("fp"), lanes)
            if how == "bands":
                keys = _band_keys(fp, radius)
            else:
                lists = [x or [0] for x in batch.column("keys").to_pylist()]
                width = max(map(len, lists))
                keys = np.array([x + x[:1] * (width - len(x)) for x in lists], np.int64).view(np.uint64)
                with np.errstate(over="ignore"):
                    keys = np.stack([mix(keys[:, k] + np.uint64(k), 1) for k in range(width)], 1)
            n, k = keys.shape
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys.view(np.int64).reshape(-1)), "fp": batch.column("fp").take(pa.array(np.repeat(np.arange(n), k)))})

    return mapped(nodes, run, "key long, fp binary")


def _again(rows: DataFrame, radius: int) -> DataFrame:
    """The rows of large blocks of single-lane fingerprints under narrower keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _narrow_keys(_matrix(batch.column("fp"), 1), radius)
            n, k = keys.shape
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys.view(np.int64).reshape(-1)), "fp": batch.column("fp").take(pa.array(np.repeat(np.arange(n), k)))})

    return mapped(rows.select("fp"), run, "key long, fp binary").distinct()


def _together(rows: DataFrame, key: str) -> DataFrame:
    """Rows of one key in one task, sorted by it.

    After a join by the key Spark leaves out a repartition by that key, and may then split a skewed partition of the join,
    which parts a key; it does not leave out one by an expression of the key.
    """
    return rows.repartition(F.xxhash64(key)).sortWithinPartitions(key)


def _compared(rows: DataFrame, lanes: int, radius: int) -> DataFrame:
    """Links (a, b) of the blocks of ``rows(key, fp)``; a task holds its largest block and one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros((0, lanes), np.uint64)

        def links(upto: int) -> pa.RecordBatch:
            found = sorted_links(key[:upto], fp[:upto], radius)
            raw = fp.astype(">u8")
            return pa.RecordBatch.from_pydict({"a": pa.array([raw[x].tobytes() for x, _ in found], pa.binary()), "b": pa.array([raw[y].tobytes() for _, y in found], pa.binary())})

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.append(key, batch.column("key").to_numpy())
            fp = np.concatenate([fp, _matrix(batch.column("fp"), lanes)])
            upto = int(np.searchsorted(key == key[-1], True))  # rows are sorted: the last block may go on
            if upto:
                yield links(upto)
                key, fp = key[upto:], fp[upto:]
        if len(key):
            yield links(len(key))

    return mapped(_together(rows, "key"), run, "a binary, b binary")


def near_links(nodes: DataFrame, lanes: int, radius: int, how: str) -> DataFrame:
    """Links between different fingerprints of ``nodes(fp, keys)`` that connect all that lie within the radius and meet in a block."""
    rows = durable(_keyed(nodes, lanes, radius, how))
    large = durable(rows.groupBy("key").count().where(F.col("count") > BLOCK))
    facts = large.agg(F.count("*").alias("blocks"), F.max("count").alias("most")).first()
    if not facts["blocks"]:
        return _compared(rows.select("key", "fp"), lanes, radius)
    if how == "bands":
        cold = _compared(rows.join(large, "key", "left_anti").select("key", "fp"), lanes, radius)
        return cold.union(_compared(_again(rows.join(large, "key", "left_semi"), radius), lanes, radius))
    sized = rows.join(F.broadcast(large) if facts["blocks"] <= SENT_BLOCKS else large, "key", "left")
    links = _compared(_paired(sized.where(F.col("count").isNull() | (F.col("count") <= PAIRED))), lanes, radius)
    if facts["most"] <= PAIRED:
        return links
    wide = sized.where(F.col("count") > PAIRED).select(F.col("key").alias("block"), F.col("fp").alias("node"), "fp", F.lit(None).cast("binary").alias("shingles"))
    return links.union(split_links(wide, lanes, radius))


def _paired(sized: DataFrame) -> DataFrame:
    """(key, fp) of ``sized(key, fp, count)``; where a count is given, under a key for each pair of shares of the block that the row is in.

    Every two rows of such a block meet: rows of two shares under the key of both, rows of one share under each key of it.
    """
    shares = F.greatest(F.ceil(F.col("count") / PAIR), F.lit(2)).cast("int")
    own = F.pmod(F.xxhash64("fp"), shares).cast("int")
    others = F.filter(F.sequence(F.lit(0), shares - 1), lambda x: x != own)
    pairs = F.transform(others, lambda x: F.xxhash64("key", F.least(x, own), F.greatest(x, own)))
    return sized.select(F.explode(F.when(F.col("count").isNull(), F.array("key")).otherwise(pairs)).alias("key"), "fp")


def _with_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``wanted(doc_id, node, fp, root)`` with ``shingles``: the sorted distinct shingle hashes of each text. Only texts that are wanted move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keep, sets = batch.column("node").to_pylist(), [], []
            for k, x in enumerate(batch.column("text").cast(pa.large_binary())):
                h = np.unique(shingle_hashes(x.as_py(), words))
                if set_digest(h) == nodes[k]:  # rows may share an id
                    keep.append(k)
                    sets.append(h.astype("<u8").tobytes())
            kept = batch.select(["node", "fp", "root"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sets, pa.binary())], [*kept.schema.names, "shingles"])

    read = docs.where(may_be_among(wanted, "doc_id", F.col("doc_id"))).join(wanted, "doc_id").select("text", "node", "fp", "root")
    return mapped(read, run, "node binary, fp binary, root long, shingles binary").dropDuplicates(["root", "node"])


def _alike(a: bytes, b: bytes, similarity: float) -> bool:
    """Whether two sets of shingles share so much of their union."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both)


def _verified(rows: DataFrame, lanes: int, radius: int, similarity: float) -> DataFrame:
    """Links (a, b) of nodes in the groups of ``rows(root, node, fp, shingles)`` whose texts are as similar as wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, fps, sets = np.zeros(0, np.int64), [], [], []

        def links(upto: int) -> pa.RecordBatch:
            fp = np.frombuffer(b"".join(fps[:upto]), ">u8").astype(np.uint64).reshape(-1, lanes)
            found = sorted_links(key[:upto], fp, radius, same=lambda x, y: _alike(sets[x], sets[y], similarity))
            return pa.RecordBatch.from_pydict({"a": pa.array([nodes[x] for x, _ in found], pa.binary()), "b": pa.array([nodes[y] for _, y in found], pa.binary())})

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.append(key, batch.column("root").to_numpy())
            nodes += batch.column("node").to_pylist()
            fps += batch.column("fp").to_pylist()
            sets += batch.column("shingles").to_pylist()
            upto = int(np.searchsorted(key == key[-1], True))
            if upto:
                yield links(upto)
                key, nodes, fps, sets = key[upto:], nodes[upto:], fps[upto:], sets[upto:]
        if len(key):
            yield links(len(key))

    return mapped(_together(rows.select("root", "node", "fp", "shingles"), "root"), run, "a binary, b binary")


class Sets:
    """Sets of 64-bit hashes, numbered together, so that one of them is compared with all others at once."""

    def __init__(self, raw: list[bytes], similarity: float) -> None:
        self.similarity = similarity
        self.sizes = np.array([len(x) // 8 for x in raw], np.int64)
        values, self.ids = np.unique(np.frombuffer(b"".join(raw), "<u8"), return_inverse=True)
        self.ends = np.cumsum(self.sizes)
        self.flags = np.zeros(len(values), np.int64)

    def like(self, p: int, some: np.ndarray) -> np.ndarray:
        """Which of the sets ``some`` share as much of their union with set ``p`` as is wanted, as a mask."""
        own = self.ids[self.ends[p] - self.sizes[p] : self.ends[p]]
        self.flags[own] = 1
        sums = np.append(0, np.cumsum(self.flags[self.ids]))
        self.flags[own] = 0
        both = sums[self.ends[some]] - sums[self.ends[some] - self.sizes[some]]
        return both >= self.similarity * (self.sizes[some] + self.sizes[p] - both)


def pivot_links(pivot: list[bool], comp: list[bytes], fp: np.ndarray, radius: int, like: Callable[[int, np.ndarray], np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links of the pivots among some rows with the other rows that are near them, as far as they join what ``comp`` does not join already.

    ``like(p, rows)`` tells which of the rows near a pivot are to be linked, where it is given.
    """
    names: dict[bytes, int] = {}
    label = np.array([names.setdefault(c, len(names)) for c in comp], np.int64)
    out, lots = [], planes(fp)
    for p in np.flatnonzero(pivot).tolist():
        flip = _flips(fp[p])
        some = _rows(near(lambda k: lots[k] ^ flip[k], len(lots), len(fp), radius))  # noqa: B023
        some = some[label[some] != label[p]]
        if len(some) and like is not None:
            some = some[like(p, some)]
        for x in some.tolist():
            if label[x] != label[p]:
                out.append((x, p))
                label[label == label[x]] = label[p]
    return out


def _met(rows: DataFrame, named: DataFrame | None, picked: DataFrame, lanes: int, radius: int, similarity: float | None, sent: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) of the ``picked(block, node, group, groups)`` pivots with all members of their blocks, each share of members with each group of pivots.

    A member that is a pivot itself does not come to the groups before its own, which come to it. Without ``named(block,
    node, comp)`` nothing is joined yet.
    """
    few = picked.select("block", "groups").distinct()
    shares = F.ceil(F.greatest(F.count("*") / SHARE, F.sum("bytes") / HELD)).cast("int").alias("shares")
    sized = sent(few.join(rows.groupBy("block").agg(shares), "block"))
    own = rows.withColumn("comp", F.col("node")) if named is None else rows.join(named, ["block", "node"])
    cols = ["comp", "node", "fp", "shingles"]
    members = own.join(picked.select("block", "node", F.col("group").alias("first")), ["block", "node"], "left").join(sized, "block")
    share = F.pmod(F.xxhash64("node"), F.col("shares")).cast("int").alias("share")
    members = members.select("block", F.explode(F.sequence(F.coalesce("first", F.lit(0)), F.col("groups") - 1)).alias("group"), share, F.lit(False).alias("pivot"), *cols)
    pivots = own.join(picked.drop("groups"), ["block", "node"]).join(sized, "block").select("block", "group", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(True).alias("pivot"), *cols)
    dealt = members.union(pivots).select(F.xxhash64("block", "group", "share").alias("key"), "pivot", *cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def links() -> pa.RecordBatch:
            pivot, comp, nodes, fps, sets = zip(*held)
            like = None if similarity is None else Sets(list(sets), similarity).like
            found = pivot_links(list(pivot), list(comp), np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(-1, lanes), radius, like)
            return pa.RecordBatch.from_pydict({"a": pa.array([nodes[x] for x, _ in found], pa.binary()), "b": pa.array([nodes[y] for _, y in found], pa.binary())})

        for batch in batches:
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "pivot", *cols))):
                if key != now and held:
                    yield links()
                    held = []
                now = key
                held.append(row)
        if held:
            yield links()

    return mapped(dealt.repartition("key").sortWithinPartitions("key"), run, "a binary, b binary")


def split_links(rows: DataFrame, lanes: int, radius: int, similarity: float | None = None) -> DataFrame:
    """Links (a, b) that connect, block by block of ``rows(block, node, fp, shingles)``, all nodes that are near enough, however large a block is.

    Some pivots of a block meet all its members, in shares of bounded size. What then belongs to the block's largest
    component needs no more links inside it; of the rest more pivots are taken, and in the last pass all of it meets all
    members, so that every two nodes have met, or are joined with most of the block. The passes are as many for any block,
    but all nodes of a block of at most ``WHOLE`` are pivots of the first pass, which is the only one if no block is larger.
    """
    rows = durable(rows.withColumn("bytes", F.coalesce(F.length("shingles"), F.lit(0)) + F.length("fp")))
    own = rows.select("block", "node", "bytes")
    facts = own.groupBy("block").count().agg(F.count("*").alias("blocks"), F.max("count").alias("most")).first()
    # facts of which there is one row a block are sent to all tasks where blocks are few, so that a large block's rows need not meet for them
    sent = F.broadcast if facts["blocks"] <= SENT_BLOCKS else lambda few: few
    found, settled = None, None
    for k, most in enumerate(PASSES):
        named, rest = None, own
        if found is not None:
            named = durable(own.join(components(found), "node", "left").select("block", "node", "bytes", F.coalesce("root", "node").alias("comp")))
            main = named.groupBy("block", "comp").count().groupBy("block").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
            rest = named.join(sent(main), "block").where("comp <> main").select("block", "node", "bytes")
            rest = durable(rest.join(settled, ["block", "node"], "left_anti"))
            if rest.isEmpty():
                break
            named = named.drop("bytes")
        waiting = sent(rest.groupBy("block").agg(F.count("*").alias("n"), F.sum("bytes").alias("size")))
        taken = F.lit(1.0) if most is None else F.least(F.lit(1.0), most / F.col("n"))
        taken = taken if k else F.when(F.col("n") <= WHOLE, 1.0).otherwise(taken)
        picked = rest.join(waiting, "block").where(F.pmod(F.xxhash64("node", F.lit(k)), F.lit(1 << 20)) < taken * (1 << 20))
        picked = picked.withColumn("groups", F.ceil(F.greatest(F.col("n") * taken / GROUP, F.col("size") * taken / HELD)).cast("int"))
        picked = durable(picked.select("block", "node", F.pmod(F.xxhash64("node", F.lit(-1)), F.col("groups")).cast("int").alias("group"), "groups"))
        now = _met(rows, named, picked, lanes, radius, similarity, sent)
        found = durable(now if found is None else found.union(now))
        if (facts["most"] or 0) <= WHOLE:
            break
        met = picked.select("block", "node")
        settled = met if settled is None else settled.union(met)
    return rows.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0) if found is None else found


def similar_links(docs: DataFrame, prints: DataFrame, words: int, lanes: int, radius: int, similarity: float) -> DataFrame:
    """Links between nodes of fingerprints within the radius whose texts' shingle sets have the wanted Jaccard similarity.

    Links by fingerprint alone come first; equal fingerprints of different sets need none. Only the texts of their
    components are read again, one for each set, and compared inside the component: by bit planes, and where those are
    near enough by their sets. A component of more than ``SPLIT`` sets is worked on in shares, with the same result.
    """
    nodes = prints.where("doc_id is not null")
    near = components(near_links(nodes.select("fp", "keys").distinct(), lanes, radius, "shingles"))
    low = nodes.groupBy("node", "fp").agg(F.min("doc_id").alias("doc_id"))
    shared = low.groupBy("fp").count().where(F.col("count") > 1).select("fp", F.col("fp").alias("root"))
    roots = near.withColumnRenamed("node", "fp").union(shared.join(near.select(F.col("node").alias("fp")), "fp", "left_anti"))
    wanted = durable(roots.join(low, "fp").select("doc_id", "node", "fp", F.xxhash64("root").alias("root")))
    large = durable(wanted.groupBy("root").count().where(F.col("count") > SPLIT).select("root"))
    if large.isEmpty():
        return _verified(_with_sets(docs, wanted, words), lanes, radius, similarity)
    sets = durable(_with_sets(docs, wanted, words))
    links = _verified(sets.join(large, "root", "left_anti"), lanes, radius, similarity)
    rows = sets.join(large, "root", "left_semi")
    return links.union(split_links(rows.select(F.col("root").alias("block"), "node", "fp", "shingles"), lanes, radius, similarity))


def groups(docs: DataFrame, words: int = 3, radius: int = 2, lanes: int = 1, minima: int = 0, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): fingerprints and the smallest doc_id of each group of linked documents.

    Two documents link if their fingerprints differ in at most ``radius`` bits; without ``minima`` every such pair is
    found, with them pairs that share one of so many minima of their shingle hashes. With ``similarity`` they must also
    share so much of their shingles (Jaccard), which is checked exactly inside the blocks, and each different shingle has
    one vote in the fingerprint, however often a text repeats it; documents without an id then
    link by equal sets only. Texts without words have the fingerprint zero and link like any other. Null texts
    are empty; documents without an id keep their row and have no say in component_id. Repeated rows and ids keep their
    rows. An empty table stays empty.
    """
    if not minima and lanes != 1:
        raise ValueError("bands are for fingerprints of 64 bits")
    if similarity is not None and not minima:
        raise ValueError("similarity is checked in blocks of shingle minima")
    prints = durable(fingerprints(docs, words, lanes, minima, similarity is not None, id_col, text_col))
    low = prints.groupBy("node").agg(F.min("doc_id").alias("low"))
    if similarity is not None:
        links = similar_links(documents(docs, id_col, text_col), prints, words, lanes, radius, similarity)
    else:
        nodes = prints.select("fp").distinct().withColumn("keys", F.lit(None).cast("array<long>")) if not minima else prints.select("fp", "keys").distinct()
        links = near_links(nodes, lanes, radius, "shingles" if minima else "bands")
    roots = components(links)
    named = durable(low.join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root")))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.select("doc_id", "fp", "node").join(named.join(least, "root").select("node", "component_id"), "node").select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` as they are, of each group (see ``groups``, which takes ``how``) those with the smallest id; rows without an id stay."""
    found = groups(docs, id_col=id_col, text_col=text_col, **how)
    gone = durable(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(id_col)).distinct())
    return without(docs, gone, id_col)
