"""Best-fit packing with Martello-Toth dominance reduction.

Token counts are whole numbers up to the capacity, so an instance of any number of documents is exactly its histogram:
at most ``capacity`` counts. The driver solves that histogram with multiplicities (``plan``): dominance reduction fixes
sets of at most three lengths in bulk, best-fit decreasing places the rest. What comes back is a short list of
placements (length, ranks) -> (sequences, offset); rows are ranked among those of their length with salted groups and
look their place up. No row but the histogram and the placements ever meets the driver.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import documents, durable, mapped, prefix_sums, unused

Group = tuple[list[tuple[int, int]], int]  # ([(length, how many of it in each sequence)], sequences)

#: Ranked rows of one length in one task, about.
SALT_ROWS = 512
#: Words whose ids a worker remembers, in each of two generations.
CACHE_WORDS = 400_000
#: Below this code point letters, digits and case never changed between Unicode versions and nothing composes.
_STABLE = 0x250


def _classes(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_STABLE) if unicodedata.category(chr(c))[0] == kind)


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Memory(dict):
    """A dict that works out what it lacks, in two generations: what was used lately stays when it grows too large."""

    def __init__(self, work: Callable[[str], bytes]) -> None:
        super().__init__()
        self.work, self.older = work, {}

    def __missing__(self, key: str) -> bytes:
        if (found := self.older.get(key)) is None:
            found = self.work(key)
        self[key] = found
        return found

    def trim(self) -> None:
        if len(self) > CACHE_WORDS:
            self.older = dict(self)
            self.clear()


class WordEncoder:
    """Token ids of whole texts, by a lower-casing tokenizer whose pre-tokens never span white space.

    ``str.split`` pieces are encoded once and remembered, and so are the pre-tokens in them, which go to the
    tokenizer's own model. Pieces with characters above Latin Extended-B, also once lower-cased, and texts with an added token or
    the four separators that only Python counts as white space, go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokens = self.tokenizer.model.tokenize
        letter, number = _classes("L"), _classes("N")
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\s{letter}{number}]+").findall
        self.hard = re.compile(rf"[\u0130{chr(_STABLE)}-\U0010ffff]").search
        self.other_space = re.compile(r"[\x1c-\x1f]").search
        added = self.tokenizer.get_added_tokens_decoder().values()
        # what is looked for in normalized text may stand in any
        self.added = [""] if any(t.normalized for t in added) else [t.content for t in added]
        self.letters = _byte_letters()
        self.parts, self.known = _Memory(self._part), _Memory(self._piece)

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.letters)
        return _ids(t.id for t in self.tokens(shown))

    def _piece(self, piece: str) -> bytes:
        low = piece.lower()
        if not piece.isascii() and (self.hard(piece) or self.hard(low)):
            return self._plain(piece)
        parts = self.split(low)
        return self.parts[parts[0]] if len(parts) == 1 else b"".join(map(self.parts.__getitem__, parts))

    def _whole(self, text: str) -> bool:
        """Whether a text must go through the whole tokenizer."""
        return bool(self.other_space(text)) or any(x in text for x in self.added)

    def rest(self) -> None:
        """Keep only the younger generation until the next task."""
        self.known.older, self.parts.older = {}, {}

    def encode(self, batch: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        self.known.trim()
        self.parts.trim()
        get = self.known.__getitem__
        return [b"".join(map(get, t.split())) if not self._whole(t) else self._plain(t) for t in batch]


def _ids(ids: Iterable[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and an end id, cut into pieces of ``capacity``: (doc_id, piece, start, length, ids_crc32[, ids]).

    A null or empty text is the end id alone. Rows that share a doc_id, or have none, are documents of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            names, raw = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for at in range(0, len(raw), 256):
                rows = []
                for doc, body in zip(names[at : at + 256], enc.encode(raw[at : at + 256])):
                    body += end
                    for k, lo in enumerate(range(0, len(body), 4 * capacity)):
                        part = body[lo : lo + 4 * capacity]
                        rows.append((doc, k, lo // 4, len(part) // 4, zlib.crc32(part), part if ids else None))
                doc, k, lo, n, crc, part = zip(*rows)
                out = {"doc_id": pa.array(doc, pa.int64()), "piece": pa.array(k, pa.int32()), "start": pa.array(lo, pa.int64()), "length": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(part, pa.binary())} if ids else {}))
        enc.rest()

    return mapped(documents(docs, id_col, text_col), run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)


class Stock:
    """How many items of each size are left, with the searches that the reduction needs."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.n = np.zeros(capacity + 1, np.int64)
        for s, c in counts.items():
            self.n[s] = c

    def without(self, *sizes: int) -> np.ndarray:
        n = self.n.copy()
        for s in sizes:
            n[s] -= 1
        return n

    def most(self, sizes: tuple[int, ...]) -> int:
        """How often the set can be taken."""
        return min(int(self.n[s]) // sizes.count(s) for s in set(sizes))

    def take(self, sizes: tuple[int, ...], times: int) -> None:
        for s in sizes:
            self.n[s] -= times


def _smallest(n: np.ndarray, k: int, above: int = 0) -> list[int]:
    out: list[int] = []
    for s in np.flatnonzero(n[above + 1 :])[:k] + above + 1:
        out += [int(s)] * int(min(n[s], k - len(out)))
        if len(out) == k:
            break
    return out


def dominating(stock: Stock, j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with ``j`` that some best packing has, or None where none is found.

    With r what ``j`` leaves: nothing else fits -> {j}; one item fills r -> {j, r}; no two others fit -> {j, the largest
    that fits}; no three fit -> the largest single if no pair outweighs it, else the best pair if its larger item is
    that single and no pair of items above its smaller one fits. Any other set's items can then be exchanged one for
    one against the chosen ones without overfilling a sequence. Every condition keeps holding while items are taken,
    so a set may be fixed as often as there are items for it.
    """
    r, n = capacity - j, stock.without(j)
    low = _smallest(n, 3)
    if not low or low[0] > r:
        return (j,)
    if n[r] > 0:
        return (j, r)
    fits = np.flatnonzero(n[: r + 1])
    top = int(fits[-1])
    if len(low) < 2 or low[0] + low[1] > r:
        return (j, top)
    if len(low) < 3 or sum(low) > r:
        best, pair = 0, (0, 0)
        upto = np.zeros(r + 1, np.int64)
        upto[fits] = fits
        upto = np.maximum.accumulate(upto)
        b = upto[np.minimum(r - fits, fits)]
        same = (b == fits) & (n[fits] < 2)
        b[same] = upto[np.maximum(fits[same] - 1, 0)]
        total = np.where(b > 0, fits + b, 0)
        k = int(total.argmax())
        best, pair = int(total[k]), (int(fits[k]), int(b[k]))
        if top >= best:
            return (j, top)
        # a pair with the largest single as its larger item
        b_top = int(upto[min(r - top, top)])
        if b_top == top and n[top] < 2:
            b_top = int(upto[top - 1])
        if b_top:
            above = _smallest(n, 2, b_top)
            if len(above) < 2 or sum(above) > r:
                return (j, top, b_top)
    return None


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Group], dict[str, int]]:
    """Sequences for a histogram of lengths: groups of alike sequences, and how many sequences each step made."""
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    stock, groups = Stock(counts, capacity), []
    while True:
        before = int(stock.n.sum())
        for j in np.flatnonzero(stock.n)[::-1].tolist():
            while stock.n[j] > 0 and (chosen := dominating(stock, j, capacity)):
                times = stock.most(chosen)
                stock.take(chosen, times)
                groups.append(([(s, 1) for s in chosen], times))
        if int(stock.n.sum()) == before:
            break
    fixed = sum(n for _, n in groups)
    rest = {int(s): int(stock.n[s]) for s in np.flatnonzero(stock.n)}
    groups += _best_fit(rest, capacity)
    total = sum(s * c for s, c in counts.items())
    return groups, {"sequences": sum(n for _, n in groups), "fixed": fixed, "lower_bound": -(-total // capacity)}


def _best_fit(counts: dict[int, int], capacity: int) -> list[Group]:
    """Best-fit decreasing over counts: a size goes to the fullest sequences that take it, as often as they do."""
    open_by: dict[int, list[Group]] = {}
    order: list[int] = []

    def put(items: list[tuple[int, int]], times: int, left: int) -> None:
        if times:
            if left not in open_by:
                open_by[left] = []
                insort(order, left)
            open_by[left].append((items, times))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            at = bisect_left(order, s)
            if at == len(order):
                q = capacity // s
                put([(s, q)], n // q, capacity - q * s)
                put([(s, n % q)], 1 if n % q else 0, capacity - n % q * s)
                break
            left = order[at]
            items, times = open_by[left].pop()
            if not open_by[left]:
                del open_by[left], order[at]
            q = min(left // s, n)
            used = min(times, n // q)
            put([*items, (s, q)], used, left - q * s)
            put(items, times - used, left)
            n -= used * q
    return [g for some in open_by.values() for g in some]


def placements(groups: list[Group]) -> dict[str, np.ndarray]:
    """Where the r-th piece of a length goes, by ranges of r: sorted ``key`` (length and first r), ``first`` sequence, ``each`` in one sequence, ``offset``."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for items, times in groups:
        offset = 0
        for s, m in items:
            rows.append((s << 44 | taken.get(s, 0), sequence, m, offset))
            taken[s] = taken.get(s, 0) + m * times
            offset += s * m
        sequence += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4)
    return dict(zip(("key", "first", "each", "offset"), cols.T.copy()))


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` (any columns, ``length`` among them, made durable by the caller) with ``sequence_id`` and ``offset``.

    Rows without a length, or with one outside 1..capacity, are refused with an error. An empty table stays empty.
    Groups of one length are split by a salt in proportion to their count, so that no task ranks more than a few
    thousand rows of one length, however common it is.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    groups, _ = plan(counts, capacity)
    place = placements(groups)
    names = pieces.columns
    salt, salts, base, rank = unused([*names, "sequence_id", "offset", "count"], "salt", "salts", "base", "rank")
    dealt = spark.createDataFrame([(s, -(-n // SALT_ROWS)) for s, n in counts.items()], f"length long, {salts} long")
    order = [c for c in names if c not in ("length", "ids")]
    salted = pieces.join(F.broadcast(dealt), "length").withColumn(salt, F.pmod(F.xxhash64(*order), F.col(salts)))  # at most `capacity` rows
    bases = prefix_sums(salted.groupBy("length", salt).count(), ["length"], salt, F.col("count"), base).select("length", salt, base)
    ranked = salted.withColumn(rank, F.row_number().over(Window.partitionBy("length", salt).orderBy(*order)) - 1)
    ranked = ranked.join(bases, ["length", salt]).withColumn(rank, F.col(rank) + F.col(base)).select(*names, rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nth = batch.column(rank).to_numpy()
            n = batch.column("length").to_numpy()
            at = np.searchsorted(place["key"], n << 44 | nth, "right") - 1
            r = nth - (place["key"][at] & ((1 << 44) - 1))
            each = place["each"][at]
            out = {c: batch.column(c) for c in names}
            out |= {"sequence_id": pa.array(place["first"][at] + r // each), "offset": pa.array(place["offset"][at] + r % each * n)}
            yield pa.RecordBatch.from_pydict(out)

    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return mapped(ranked, run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack whole documents: the rows of ``token_pieces`` with ``sequence_id`` and ``offset``.

    ``ids`` adds each piece's token ids as little-endian unsigned 32-bit binary. A null or empty text is the end id
    alone; a text of more than ``capacity`` ids is cut, so it never counts more than its ids. Rows that share an id, or
    have none, are documents of their own, equal ones too; which of equal pieces goes where is any. Other columns of
    ``docs``, whatever they are called, are left out. An empty table stays empty.
    """
    return pack(durable(token_pieces(docs, tokenizer_path, capacity, end_id, ids, id_col, text_col)), capacity)
