"""Benchmark decontamination by spaced-seed hashing.

Fixed masks look at some of a run of words and ignore the others. Hashes of the masked words of benchmark items and of
documents are joined; each hit gives a diagonal on which document and item are compared word by word, with substitutions
allowed, and the stretch with most agreeing words decides. Items that need fewer agreeing words than a passage has are
cut into one piece more than words of them may differ, and hashed by whole pieces too: one of the pieces is unchanged.
Texts whose words repeat so often that hits would be very many mark their diagonals item by item instead of listing hits.

The benchmark side is sent to all tasks in blocks of bounded size; a larger benchmark takes more than one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import PLAIN, documents, mapped, texts

#: Word offsets that a mask looks at.
MASKS = ((0, 1, 2, 4, 5, 6), (0, 1, 3, 6, 8, 9), (0, 2, 3, 7, 9, 10))
#: Characters of benchmark text in one block.
BLOCK_CHARS = 32 << 20
#: Hits of one text that are listed; beyond, diagonals are marked.
HITS = 100_000
#: Words that are compared at once.
COMPARED = 1 << 20
_PRIME = 0x9E3779B97F4A7C15 | 1


def _masked(ids: np.ndarray, mask: tuple[int, ...], k: int) -> np.ndarray:
    """Hashes of the masked words from each position; 0 where one of them is unknown."""
    n = len(ids) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, known = np.full(n, k + 1, np.uint64), np.ones(n, bool)
    with np.errstate(over="ignore"):
        for o in mask:
            x = ids[o : o + n]
            h = (h ^ x.astype(np.uint64)) * np.uint64(_PRIME)
            h ^= h >> np.uint64(29)
            known &= x > 0
    return np.where(known, h | np.uint64(1), np.uint64(0))


class SeedTable:
    """Benchmark items as word numbers, with the sorted hashes of their masked words."""

    def __init__(self, items: list[tuple[int, str]], least_words: int, identity: float) -> None:
        self.least_words, self.identity = least_words, Fraction(str(identity))
        self.vocabulary: dict[bytes, int] = {}
        self.names, self.words, self.widths = [], [], set()
        hashes, owner, place = [], [], []
        for name, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in text.encode().translate(PLAIN).split()], np.int64)
            for k, mask in enumerate(MASKS):
                h = _masked(ids, mask, k)
                hashes.append(h)
                owner.append(np.full(len(h), len(self.names)))
                place.append(np.arange(len(h)))
            for at, n in self._pieces(len(ids)):
                hashes.append(_masked(ids[at : at + n], tuple(range(n)), len(MASKS) + n))
                owner.append(np.array([len(self.names)]))
                place.append(np.array([at]))
                self.widths.add(n)
            self.names.append(name)
            self.words.append(ids)
        h = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.owner, self.place = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)[order] for x in (owner, place))
        self.coarse = np.zeros(1 << 20, bool)
        self.coarse[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def _need(self, n: int) -> int:
        """Agreeing words that a passage of an item of ``n`` words has."""
        return min(self.least_words, -int(-n * self.identity // 1))

    def _pieces(self, n: int) -> list[tuple[int, int]]:
        """(from, words) of the pieces of an item that is shorter than the seeds are sure for."""
        if not n or (need := self._need(n)) >= self.least_words:
            return []
        cut = [n * k // (n - need + 1) for k in range(n - need + 2)]
        return [(a, z - a) for a, z in zip(cut, cut[1:])]

    def hits(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(positions, from, to) of words that a mask finds among the items: seeds from ``from`` to ``to`` of the table are equal."""
        out = []
        for k, mask in [*enumerate(MASKS), *((len(MASKS) + n, tuple(range(n))) for n in sorted(self.widths))]:
            h = _masked(ids, mask, k)
            at = np.flatnonzero((h > 0) & self.coarse[(h >> np.uint64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
            found = hi > lo
            out.append((at[found], lo[found], hi[found]))
        return out

    def _listed(self, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Different (item, diagonal) of hits."""
        n = hi - lo
        row = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.unique(np.stack([self.owner[row], np.repeat(at, n) - self.place[row]], 1), axis=0)

    def _marked(self, words: int, hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
        """(item, its diagonals) of the hits of a text of so many words, one item at a time."""
        spots: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for at, lo, hi in hits:
            order = np.argsort(lo, kind="stable")
            cut = np.flatnonzero(np.append(True, lo[order][1:] != lo[order][:-1])) if len(lo) else []
            for same in np.split(order, cut[1:]) if len(lo) else []:
                a, z = int(lo[same[0]]), int(hi[same[0]])
                owners, first = np.unique(self.owner[a:z], return_index=True)
                for item, places in zip(owners.tolist(), np.split(self.place[a:z], first[1:])):
                    spots.setdefault(item, []).append((at[same], places))
        for item in sorted(spots):
            n = len(self.words[item])
            marks = np.zeros(words + n, bool)
            for where, places in spots[item]:
                for p in places.tolist():
                    marks[where - p + n] = True
            yield item, np.flatnonzero(marks) - n

    def leaks(self, block: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, words, agreeing words): the best stretch of each text and item that passes."""
        split = [b.translate(PLAIN).split() for b in block]
        sizes = np.array(list(map(len, split)), np.int64)
        get = self.vocabulary.get
        ids = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(get, w, repeat(0)), np.int64, len(w)) for w in split)])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        hits = self.hits(ids)
        out = []
        for text in np.unique(np.concatenate([np.searchsorted(ends, at, "right") for at, _, _ in hits])).tolist():
            a, z = int(begins[text]), int(ends[text])
            own = [(at[i:k] - a, lo[i:k], hi[i:k]) for at, lo, hi in hits for i, k in [np.searchsorted(at, (a, z))]]
            if sum(int((hi - lo).sum()) for _, lo, hi in own) <= HITS:
                pairs = self._listed(*(np.concatenate(x) for x in zip(*own)))
                item, first = np.unique(pairs[:, 0], return_index=True)
                by_item = zip(item.tolist(), np.split(pairs[:, 1], first[1:]))
            else:
                by_item = self._marked(z - a, own)
            for item, diagonals in by_item:
                if got := self._best(ids[a:z], item, diagonals):
                    out.append((text, self.names[item], *got))
        return out

    def _best(self, ids: np.ndarray, item: int, diagonals: np.ndarray) -> tuple[int, int, int] | None:
        """The best stretch of a text on any of the diagonals, the first of several."""
        words, best = self.words[item], None
        n = len(words)
        p, q = self.identity.numerator, self.identity.denominator
        padded = np.concatenate([np.full(n, -1), ids, np.full(n, -1)])
        at_once = max(1, COMPARED // n)
        for lo in range(0, len(diagonals), at_once):
            some = diagonals[lo : lo + at_once]
            same = np.lib.stride_tricks.sliding_window_view(padded, n)[some + n] == words
            total = same.sum(1)
            for k in np.flatnonzero(total >= max(1, self._need(n))).tolist():
                if best and total[k] <= best[2]:
                    continue
                if q * int(total[k]) >= p * n:  # the whole item agrees well enough, so all that agrees counts
                    where = np.flatnonzero(same[k])
                    got = int(where[0]), int(where[-1] - where[0] + 1), int(total[k])
                else:
                    got = self._stretch(same[k], n)
                if got and got[2] > (best[2] if best else 0):
                    best = (int(some[k]) + got[0], got[1], got[2])
        return best

    def _stretch(self, same: np.ndarray, n: int) -> tuple[int, int, int] | None:
        """The stretch with most agreeing words of those with a share of ``identity`` of them, the shortest of several; None if it has too few.

        A stretch has the share where the gain, of which a mismatch costs what keeps ``identity``, does not fall over it.
        The earlier it begins the more words agree, so each end goes with the first begin whose gain is not above its own.
        """
        p, q = self.identity.numerator, self.identity.denominator
        gain, agree = np.append(0, np.cumsum(np.where(same, q - p, -p))), np.append(0, np.cumsum(same))
        held = agree - agree[np.searchsorted(-np.minimum.accumulate(gain), -gain, "left")]
        most = int(held.max())
        if most < max(1, self._need(n)):
            return None
        z = np.flatnonzero(held == most)
        a = np.flatnonzero(same)[agree[z] - most]
        k = int((z - a).argmin())
        return int(a[k]), int(z[k] - a[k]), most


def seed_tables(benchmark: DataFrame, least_words: int = 13, identity: float = 0.8, id_col: str = "item_id", text_col: str = "text") -> Iterator[SeedTable]:
    """Blocks of benchmark items, each of about ``BLOCK_CHARS`` characters; null texts and ids are left out."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).dropna()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = chars // BLOCK_CHARS + 1
    for k in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        yield SeedTable([(r["item_id"], r["text"]) for r in some.collect()], least_words, identity)


def find_leaks(docs: DataFrame, benchmark: DataFrame, least_words: int = 13, identity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, n_words, n_agree) for each document that holds a passage of a benchmark item.

    A passage is a stretch of words with a share of at least ``identity`` equal to the item's words at the same
    distances, and at least ``least_words`` equal ones (or that share of a shorter item). At the given values every
    passage is found: one of at least 13 equal words holds a seed wherever the others are, and shorter items go by pieces.
    Words are runs of letters, digits and non-ASCII characters, lower-cased. Null and empty texts and items hold
    nothing; rows that share an id give the best passage once, of equally good ones the earliest; rows without an id are
    reported as one document without an id. Other columns play no part. An empty table on either side gives no rows.
    """
    out = None
    for table in seed_tables(benchmark, least_words, identity):
        sent = docs.sparkSession.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, block in texts(batch):
                    rows = [(ids[t], *x) for t, *x in sent.value.leaks(block)]
                    cols = list(zip(*rows)) or [()] * 5
                    yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in zip(("doc_id", "item_id", "first_word", "n_words", "n_agree"), cols)})

        found = mapped(documents(docs, id_col, text_col), run, "doc_id long, item_id long, first_word long, n_words long, n_agree long")
        out = found if out is None else out.union(found)
    best = F.max_by(F.struct("first_word", "n_words", "n_agree"), F.struct("n_agree", -F.col("first_word"), -F.col("n_words"))).alias("x")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least_words: int = 13, identity: float = 0.8, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no passage of a benchmark item, as they are, whatever their columns are called; see ``find_leaks``.

    Each row is judged by its own text; null and empty texts stay, and so do rows without an id and repeated rows.
    """
    types = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    for table in seed_tables(benchmark, least_words, identity):
        sent = docs.sparkSession.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = [x.as_py() or b"" for x in batch.column(text_col).cast(pa.large_binary())]
                keep = np.ones(len(raw), bool)
                for at in range(0, len(raw), 1000):
                    keep[[at + t for t, *_ in sent.value.leaks(raw[at : at + 1000])]] = False
                yield batch.filter(pa.array(keep))

        docs = mapped(docs, run, types)
    return docs
