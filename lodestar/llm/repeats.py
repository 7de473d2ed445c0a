"""Suffix-array dedup of long repeated byte strings over run-length Burrows-Wheeler indexes.

Every string of ``length`` bytes holds exactly one anchor: the leftmost of its smallest-hashed grams. An anchor is a
function of the string alone, so equal strings meet wherever their anchors meet. The strings of one anchor occurrence
overlap; together they are its window, a hundred odd bytes.

1. Each task reduces windows to (anchor, digest, place). Windows equal to an earlier one in the task are repeats at once
   and go no further. The rest is dealt by anchor; windows equal to an earlier one are repeats.
2. Anchors with several different windows are where copies begin and end. Only their windows travel as text; each task
   builds a run-length index of the windows that share anchors: Burrows-Wheeler transform, suffix samples at run ends,
   match lengths at run heads. From these alone follow, in text order, the matching statistics and the suffix above each
   suffix; every start with a match of ``length`` bytes or more joins the class of the suffix above it, and of a class
   all but the first place are repeats. Anchors with very many windows are dealt string by string instead.
3. The repeats of a document are joined to its text and cut out. Texts without repeats never move.

Equal windows are told by anchor and digest, 64 bits each, and not compared byte by byte; the index compares bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.bloom import Filter, may_be_among, packed, seen_filter, segments_for
from lodestar.llm.common import durable, mapped, texts, unused

#: Windows that a task holds before it hands them on.
FLUSH = 500_000
#: Windows dealt to one group of the reduction, about.
GROUP = 400_000
#: Different windows of one anchor beyond which its strings are dealt one by one.
HOT = 4096
#: Bytes that one run-length index covers, about.
INDEX_BYTES = 1 << 19
#: Bytes of text whose windows are found at once; working arrays take some hundred times as much.
BLOCK_BYTES = 1 << 20
_NO_ID = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15 | 1
_WINDOW = np.dtype([("anchor", "<u8"), ("digest", "<u8"), ("doc", "<i8"), ("tag", "<u4"), ("at", "<u4"), ("n", "<u2")])
_MARK = np.dtype([("doc", "<i8"), ("tag", "<u4"), ("at", "<u4"), ("n", "<u2")])


def gram_size(length: int) -> int:
    return max(1, length * 8 // 25)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each position, by doubling."""
    with np.errstate(over="ignore"):
        h, have = b.astype(np.uint64) + np.uint64(1), 1
        out, done = None, 0
        while True:
            if k & have:
                if out is None:
                    out, done = h, have
                else:
                    n = len(b) - done - have + 1
                    out = out[:n] * np.uint64(pow(_BASE, have, 1 << 64)) + h[done : done + n]
                    done += have
            if have * 2 > k:
                return _mix(out)
            n = len(h) - have
            h = h[:n] * np.uint64(pow(_BASE, have, 1 << 64)) + h[have:]
            have *= 2


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    m, have = h, 1
    while have < w:
        s = min(have, w - have)
        m = np.minimum(m[:-s], m[s:])
        have += s
    return m


def windows(b: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of joined documents: (first start, starts, anchor hash). ``ends`` are the documents' ends in ``b``."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    k = gram_size(length)
    w = length - k + 1
    if len(b) < length:
        return none
    h = gram_hashes(b, k)
    m = _window_min(h, w)
    begins = np.append(0, ends[:-1])
    cut = np.append(True, m[1:] != m[:-1])
    cut[begins[begins < len(m)]] = True
    whole = np.zeros(len(m) + 1, np.int32)  # starts whose string lies in one document
    fits = ends - begins >= length
    np.add.at(whole, begins[fits], 1)
    np.add.at(whole, ends[fits] - length + 1, -1)
    whole = np.cumsum(whole[:-1]) > 0
    cut[1:] |= whole[1:] != whole[:-1]
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(m))
    keep = whole[first]
    first, last = first[keep], last[keep]
    if not len(first):
        return none
    value = m[first]
    place = np.empty(len(first), np.int64)
    for at in range(0, len(first), 1 << 14):
        f = first[at : at + (1 << 14)]
        place[at : at + (1 << 14)] = f + (h[f[:, None] + np.arange(w)] == value[at : at + (1 << 14), None]).argmax(1)
    if (tied := np.flatnonzero(place < last - 1)).size:  # the same gram again inside the run: a new window from there
        more_first, more_last, more_value = [], [], []
        for t in tied.tolist():
            a, z = int(first[t]), int(last[t])
            spots = np.flatnonzero(h[a : z - 1] == value[t]) + a + 1
            more_first.append(spots)
            more_last.append(np.append(spots[1:], z))
            more_value.append(np.full(len(spots), value[t]))
            last[t] = spots[0]
        first, last, value = np.concatenate([first, *more_first]), np.concatenate([last, *more_last]), np.concatenate([value, *more_value])
    return first, last - first, value


def _digests(raw: bytes, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    view = memoryview(raw)
    return np.fromiter((digest(view[a:z]) for a, z in zip(first.tolist(), (first + size).tolist())), np.uint64, len(first))


def _scan(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, bytes, np.ndarray]]:
    """Windows of a block of documents, the block's bytes and each window's place in them."""
    for batch in batches:
        for ids, block in texts(batch, most=BLOCK_BYTES):
            raw = b"".join(block)
            sizes = np.fromiter(map(len, block), np.int64, len(block))
            ends = np.cumsum(sizes)
            first, n, anchor = windows(np.frombuffer(raw, np.uint8), ends, length)
            out = np.empty(len(first), _WINDOW)
            owner = np.searchsorted(ends, first, "right")
            out["anchor"], out["n"] = anchor, n
            out["digest"] = _digests(raw, first, n + length - 1)
            out["doc"] = np.array([_NO_ID if i is None else i for i in ids], np.int64)[owner]
            out["tag"] = np.fromiter(map(zlib.crc32, block), np.uint32, len(block))[owner]
            out["at"] = first - (ends - sizes)[owner]
            yield out, raw, first


def _grouped(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows by anchor, digest and place, and which of them repeat an earlier equal one."""
    w = w[np.lexsort((w["at"], w["doc"], w["digest"], w["anchor"]))]
    same = np.append(False, (w["anchor"][1:] == w["anchor"][:-1]) & (w["digest"][1:] == w["digest"][:-1]))
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(w))))
    return w, same & ((w["doc"] != w["doc"][head]) | (w["at"] != w["at"][head]))


def _marks(w: np.ndarray, deal: int) -> pa.RecordBatch:
    """Rows (group -1, bucket, 0, windows): marked windows, a row for each bucket of documents."""
    with np.errstate(over="ignore"):
        bucket = (_mix(w["doc"].copy().view(np.uint64)) % np.uint64(deal)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, marks = bucket[order], np.empty(len(w), _MARK)
    for c in _MARK.names:
        marks[c] = w[c][order]
    w = marks
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(w) else np.zeros(0, np.int64)
    body = [w[a:z].tobytes() for a, z in zip(cut, np.append(cut[1:], len(w)))]
    return pa.RecordBatch.from_pydict({"group": pa.array(np.full(len(cut), -1), pa.int64()), "doc": pa.array(bucket[cut]), "tag": pa.array(np.zeros(len(cut), np.int64)), "body": pa.array(body, pa.binary())})


def _by_document(w: np.ndarray) -> pa.RecordBatch:
    """Rows (doc, tag, starts): the marked starts of each document as pairs (at, n)."""
    w = w[np.lexsort((w["at"], w["tag"], w["doc"]))]
    cut = np.flatnonzero(np.append(True, (w["doc"][1:] != w["doc"][:-1]) | (w["tag"][1:] != w["tag"][:-1]))) if len(w) else np.zeros(0, np.int64)
    pairs = np.stack([w["at"].astype("<u4"), w["n"].astype("<u4")], 1)
    body = [pairs[a:z].tobytes() for a, z in zip(cut, np.append(cut[1:], len(w)))]
    return pa.RecordBatch.from_pydict({"doc": pa.array(w["doc"][cut], pa.int64()), "tag": pa.array(w["tag"][cut].astype(np.int64)), "body": pa.array(body, pa.binary())})


def _rows(group: np.ndarray, body: list[bytes]) -> pa.RecordBatch:
    zero = pa.array(np.zeros(len(body), np.int64))
    return pa.RecordBatch.from_pydict({"group": pa.array(group, pa.int64()), "doc": zero, "tag": zero, "body": pa.array(body, pa.binary())})


_ROW = "group long, doc long, tag long, body binary"


def _suffix_array(text: np.ndarray, left: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Suffixes in order; ``left`` bytes remain to the end of the window, and ends of windows differ, by ``owner``."""
    n = len(text)
    key = np.zeros(n, np.uint64)
    symbol = np.append(text.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64))
    for k in range(7):
        key = key << np.uint64(9) | np.where(left > k, symbol[k : k + n], np.uint64(0))
    short = left < 7
    order = np.lexsort((np.where(short, owner, -1), key))
    k_sorted, o_sorted = key[order], np.where(short, owner, -1)[order]
    new = np.append(False, (k_sorted[1:] != k_sorted[:-1]) | (o_sorted[1:] != o_sorted[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new)
    have = 7
    while int(new.sum()) + 1 < n:
        far = np.minimum(np.arange(n) + have, n - 1)
        pair = rank << 32 | np.where(left >= have, rank[far] + 1, 0)  # suffixes that end before are alone already
        order = np.argsort(pair)
        p = pair[order]
        new = np.append(False, p[1:] != p[:-1])
        rank[order] = np.cumsum(new)
        have *= 2
        if have > int(left.max()) * 2:
            break
    return order


def _common(text: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common bytes from a and from b, within their windows; 0 where a is -1."""
    most = np.where(a < 0, 0, np.minimum(left[a], left[b]))
    words = np.lib.stride_tricks.sliding_window_view(np.append(text, np.zeros(8, np.uint8)), 8)
    out, going = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
    while going.size:
        differ = words[a[going] + out[going]] != words[b[going] + out[going]]
        got = np.where(differ.any(1), differ.argmax(1), 8)
        out[going] += got
        going = going[(got == 8) & (out[going] < most[going])]
    return np.minimum(out, most)


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of windows.

    What is kept is as long as there are runs: each run's symbol, and by the place of its head in the text the sample at
    the end of the run above and how far the two agree. Text and suffix order go once it is built.
    """

    def __init__(self, pieces: list[bytes]) -> None:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
        text = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)  # no UTF-8 text has this byte
        ends = np.cumsum(sizes)
        self.begins, self.length = ends - sizes, len(text)
        owner = np.repeat(np.arange(len(pieces)), sizes)
        left = ends[owner] - 1 - np.arange(len(text))
        order = _suffix_array(text, left, owner)
        before = np.where(order > 0, text[order - 1].astype(np.int64), -1)
        edge = left[order - 1] == 0  # a window's first byte follows a separator that is like no other
        before[edge] = -1 - owner[order[edge]]
        heads = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        above = np.append(-1, order[heads[1:] - 1])  # the suffix above a run head ends the run before
        by_place = np.argsort(order[heads])
        self.symbols, self.heads, self.above = before[heads], order[heads][by_place], above[by_place]
        self.match = _common(text, left, self.above, self.heads)

    @property
    def runs(self) -> int:
        return len(self.heads)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.symbols, self.heads, self.above, self.match, self.begins))

    def at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how far it agrees with the suffix above it in order, that suffix) of each place: known at run heads, one less and one on with each step after."""
        k = np.searchsorted(self.heads, places, "right") - 1
        step = places - self.heads[k]
        return np.maximum(0, self.match[k] - step), self.above[k] + step

    def matches(self, length: int) -> np.ndarray:
        """The places whose matching statistics are at least ``length``, run head by run head."""
        n = np.minimum(np.maximum(0, self.match - length + 1), np.append(self.heads[1:], self.length) - self.heads)
        return np.repeat(self.heads, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)

    def repeated(self, length: int, earlier: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Places, in order, at which a string of ``length`` bytes starts that also starts earlier; ``earlier`` ranks places."""
        later = self.matches(length)
        if not later.size:
            return later
        _, up = self.at(later)
        places = np.union1d(later, up)
        root = np.arange(len(places))  # each match follows the suffixes above it to the first of its class
        root[np.searchsorted(places, later)] = np.searchsorted(places, up)
        while not np.array_equal(root, further := root[root]):
            root = further
        rank = earlier(places)
        low = np.full(len(places), rank.max())
        np.minimum.at(low, root, rank)
        return places[rank > low[root]]


def _index_marks(pieces: list[bytes], doc: np.ndarray, tag: np.ndarray, at: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Marked starts of one index's windows, as windows of one or more starts."""
    index = RunIndex(pieces)

    def named(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        owner = np.searchsorted(index.begins, places, "right") - 1
        return owner, places - index.begins[owner]

    def earlier(places: np.ndarray) -> np.ndarray:
        owner, inside = named(places)
        d, p = doc[owner], at[owner] + inside
        order = np.lexsort((p, d))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(np.append(False, (d[order][1:] != d[order][:-1]) | (p[order][1:] != p[order][:-1])))
        return rank

    hit = index.repeated(length, earlier)
    owner, inside = named(hit)
    own = inside < n[owner]
    hit, owner, inside = hit[own], owner[own], inside[own]
    if not hit.size:
        return np.zeros(0, _WINDOW)
    cut = np.append(True, (hit[1:] != hit[:-1] + 1) | (owner[1:] != owner[:-1]))
    out = np.zeros(int(cut.sum()), _WINDOW)
    out["doc"], out["tag"], out["at"] = doc[owner[cut]], tag[owner[cut]], at[owner[cut]] + inside[cut]
    out["n"] = np.diff(np.append(np.flatnonzero(cut), len(hit)))
    return out


def repeat_starts(slim: DataFrame, length: int = 100) -> DataFrame:
    """(doc, tag, body): the starts of repeated strings of ``slim(doc_id, text)`` as pairs (at, n), a row for each document with any."""
    sc = slim.sparkSession.sparkContext
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    deal = max(1, size * 2 // (length - gram_size(length) + 2) // GROUP + 1)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hand_on(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            w, repeat = _grouped(np.concatenate(held))
            yield _marks(w[repeat], deal)
            w = w[~repeat]
            group = (w["anchor"] >> np.uint64(3)).astype(np.int64) % deal
            order = np.argsort(group, kind="stable")
            w, group = w[order], group[order]
            cut = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(w) else np.zeros(0, np.int64)
            yield _rows(group[cut], [w[a:z].tobytes() for a, z in zip(cut, np.append(cut[1:], len(w)))])

        held, count = [], 0
        for w, _, _ in _scan(batches, length):
            held.append(w)
            count += len(w)
            if count > FLUSH:
                yield from hand_on(held)
                held, count = [], 0
        if held:
            yield from hand_on(held)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def decide(bodies: list[bytes]) -> Iterator[pa.RecordBatch]:
            w, repeat = _grouped(np.frombuffer(b"".join(bodies), _WINDOW))
            yield _marks(w[repeat], deal)
            kinds = w[np.append(True, (w["anchor"][1:] != w["anchor"][:-1]) | (w["digest"][1:] != w["digest"][:-1]))]
            anchor, count = np.unique(kinds["anchor"], return_counts=True)
            yield _rows(np.array([-2, -3]), [anchor[count > 1].tobytes(), anchor[count > HOT].tobytes()])

        now, bodies = 0, []
        for batch in batches:
            for k, (group, body) in enumerate(zip(batch.column("group").to_pylist(), batch.column("body").to_pylist())):
                if group < 0:
                    yield batch.slice(k, 1)
                    continue
                if group != now and bodies:
                    yield from decide(bodies)
                    bodies = []
                now = group
                bodies.append(body)
        if bodies:
            yield from decide(bodies)

    dealt = mapped(slim, first_pass, _ROW)
    spread = F.when(F.col("group") < 0, F.xxhash64("doc")).otherwise(F.col("group"))
    decided = durable(mapped(dealt.repartition(spread).sortWithinPartitions("group"), reduce, _ROW))

    def filter_of(kind: int) -> Filter:
        some = decided.where(F.col("group") == kind)
        count = some.agg(F.sum(F.octet_length("body")) / 8).first()[0] or 0
        segments = segments_for(int(count))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield packed(np.frombuffer(b"".join(batch.column("body").to_pylist()), np.uint64), segments)

        return seen_filter(mapped(some, pack, "segment long, hashes binary"), segments, 1)

    several, hot = sc.broadcast(filter_of(-2)), sc.broadcast(filter_of(-3))

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(route, w: np.ndarray, body: list) -> pa.RecordBatch:
            cols = {"route": pa.array(np.asarray(route).view(np.int64), pa.int64())} | {c: pa.array(w[c].astype(np.int64)) for c in ("doc", "tag", "at", "n")}
            return pa.RecordBatch.from_pydict(cols | {"body": pa.array(body, pa.binary())})

        known: dict[bytes, tuple[int, int]] = {}
        for w, raw, first in _scan(batches, length):
            pick = np.flatnonzero(several.value.has(w["anchor"]))
            if not pick.size:
                continue
            very = hot.value.has(w["anchor"][pick])
            rows, bodies = [], []
            for i in pick[~very].tolist():
                name = (int(w["anchor"][i]), int(w["digest"][i]))
                # an equal window of a later place adds no string; of an earlier place it must still be told
                place = (int(w["doc"][i]), int(w["at"][i]))
                if (old := known.get(name)) is not None and old <= place:
                    continue
                known[name] = place
                rows.append(i)
                bodies.append(raw[first[i] : first[i] + w["n"][i] + length - 1])
            if rows:
                yield out(w["anchor"][rows], w[rows], bodies)
            if len(known) > FLUSH // 4:
                known.clear()
            if very.any():
                some = pick[very]
                one = np.repeat(w[some], w["n"][some])
                step = np.arange(len(one)) - np.repeat(np.cumsum(w["n"][some].astype(np.int64)) - w["n"][some], w["n"][some])
                at = np.repeat(first[some], w["n"][some]) + step
                one["at"] += step.astype(np.uint32)
                one["n"] = 1
                one["digest"] = one["anchor"] = _digests(raw, at, np.full(len(at), length))
                order = np.lexsort((one["at"], one["doc"], one["digest"]))
                same = np.append(False, one["digest"][order][1:] == one["digest"][order][:-1])
                yield out(one["digest"][order[~same]], one[order[~same]], [raw[a : a + length] for a in at[order[~same]].tolist()])
                head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
                later = order[same & ((one["doc"][order] != one["doc"][head]) | (one["at"][order] != one["at"][head]))]
                yield out(one["digest"][later], one[later], [None] * len(later))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marks(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            doc, tag, at, n = (t.column(c).to_numpy() for c in ("doc", "tag", "at", "n"))
            place = list(zip(doc.tolist(), at.tolist()))
            best: dict[tuple[int, bytes], int] = {}  # the first of equal windows; the index holds each once
            same = np.empty(t.num_rows, np.int64)
            names = list(zip(t.column("route").to_pylist(), t.column("body").to_pylist()))
            for i, name in enumerate(names):
                if (old := best.get(name)) is None or place[i] < place[old]:
                    best[name] = i
            for i, name in enumerate(names):
                same[i] = best[name]
            later = np.flatnonzero((doc != doc[same]) | (at != at[same]))
            if later.size:
                w = np.zeros(later.size, _WINDOW)
                w["doc"], w["tag"], w["at"], w["n"] = doc[later], tag[later], at[later], n[later]
                yield _marks(w, deal)
            t = t.take(pa.array(np.unique(same)))
            route = t.column("route").to_numpy()
            count = np.unique(route, return_counts=True)
            keep = np.flatnonzero(np.isin(route, count[0][count[1] > 1]))
            if not keep.size:
                return
            t = t.take(pa.array(keep))
            sizes = np.cumsum(np.fromiter((len(x) for x in t.column("body").to_pylist()), np.int64, t.num_rows))
            route = t.column("route").to_numpy()
            bound = np.append(np.flatnonzero(np.append(True, route[1:] != route[:-1])), len(route))
            a = 0
            for z in bound[1:].tolist():
                if sizes[z - 1] - (sizes[a - 1] if a else 0) >= INDEX_BYTES or z == len(route):
                    part = t.slice(a, z - a)
                    doc, tag, at, n = (part.column(c).to_numpy() for c in ("doc", "tag", "at", "n"))
                    yield _marks(_index_marks(part.column("body").to_pylist(), doc, tag, at, n, length), deal)
                    a = z

        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            local = batch.filter(pa.compute.is_null(batch.column("body")))
            if local.num_rows:
                w = np.zeros(local.num_rows, _WINDOW)
                for c in ("doc", "tag", "at", "n"):
                    w[c] = local.column(c).to_numpy()
                yield _marks(w, deal)
            batch = batch.filter(pa.compute.is_valid(batch.column("body")))
            if not batch.num_rows:
                continue
            last = batch.column("route")[batch.num_rows - 1].as_py()
            upto = int(np.searchsorted(batch.column("route").to_numpy() == last, True))
            if held and upto:
                held.append(batch.slice(0, upto))
                count += upto
                if count > 50_000:
                    yield from marks(held)
                    held, count = [], 0
                batch = batch.slice(upto)
            held.append(batch)
            count += batch.num_rows
        if held:
            yield from marks(held)

    sent = mapped(slim, second_pass, "route long, doc long, tag long, at long, n long, body binary")
    indexed = mapped(sent.repartition("route").sortWithinPartitions("route"), index, _ROW)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, body in zip(batch.column("doc").to_pylist(), batch.column("body").to_pylist()):
                if bucket != now and held:
                    yield _by_document(np.frombuffer(b"".join(held), _MARK))
                    held = []
                now = bucket
                held.append(body)
        if held:
            yield _by_document(np.frombuffer(b"".join(held), _MARK))

    marks = decided.where(F.col("group") == -1).union(indexed).select("doc", "body")
    return mapped(marks.repartition("doc").sortWithinPartitions("doc"), collect, "doc long, tag long, body binary")


def merged(pairs: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs [from, to) of the bytes that strings from the marked starts cover."""
    a = pairs[:, 0].astype(np.int64)
    order = np.argsort(a, kind="stable")
    a, z = a[order], (a + pairs[:, 1] - 1 + length)[order]
    z = np.maximum.accumulate(z)
    new = np.append(True, a[1:] > z[:-1])
    return np.stack([a[new], z[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)]], 1)


def dedup_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut out repeated strings: all columns of ``docs`` with kept (binary), n_bytes, n_removed, n_spans and spans.

    Texts are UTF-8 bytes; a byte goes if a string of ``length`` bytes over it also starts earlier: in a smaller id, or
    in the same document at an earlier start. Strings never cross documents and are judged on the input.

    A null or empty text has no bytes and nothing to remove. Rows without an id come before all ids, as one document;
    rows that share an id are places of one document: the same string at the same start is no repeat. Input columns with
    the names of results are replaced, others stay whatever they are called. An empty table stays empty.
    """
    docs = docs.drop("kept", "n_bytes", "n_removed", "n_spans", "spans")
    columns = docs.columns
    doc, tag, marks = unused([*columns, "kept", "n_bytes", "n_removed", "n_spans", "spans"], "doc", "tag", "marks")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    starts = durable(repeat_starts(slim, length).select(F.col("doc").alias(doc), F.col("tag").alias(tag), F.col("body").alias(marks)))
    loses = may_be_among(starts, doc, F.col(id_col))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, size, removed, spans = [], [], [], []
            for x, own in zip(batch.column(text_col).cast(pa.large_binary()), batch.column(marks).to_pylist()):
                b = x.as_py() or b""
                runs = merged(np.frombuffer(own, "<u4").reshape(-1, 2), length).tolist() if own else []
                at, out = 0, []
                for a, z in runs:
                    out.append(b[at:a])
                    at = z
                kept.append(b"".join([*out, b[at:]]))
                size.append(len(b))
                removed.append(sum(z - a for a, z in runs))
                spans.append(runs)
            new = {"kept": pa.array(kept, pa.binary()), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(list(map(len, spans)), pa.int64()), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64())))}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in columns} | new)

    types = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    schema = f"{types}, kept binary, n_bytes long, n_removed long, n_spans long, spans array<array<long>>"
    clean = docs.where(~loses).select(*columns, F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b"")).alias("kept"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.array().cast("array<array<bigint>>").alias("spans"))
    named = docs.where(loses).join(starts, (F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)) == F.col(doc)) & (F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")) == F.col(tag)), "left")
    return clean.union(mapped(named.select(*columns, marks), cut, schema))
