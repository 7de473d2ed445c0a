"""Quality scores by Bradley-Terry pairwise ranking.

A labelled good document should rank above a labelled bad one: the model is linear in the features of a text and is
fitted by logistic loss on feature differences of such pairs. Features are counts that describe a text, and shares of its
words and of its runs of three bytes by hash, so that the ranking learns from what is said as well. A score is the
logistic function of the ranking value, shifted so that the wanted cut lies at the wanted quantile of the training
values. Training takes a bounded sample of the labelled rows (``sample``, by a hash of the id); scores are for every row.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import documents, mapped, texts

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_STOP = b".,;:?'\"()-"
_SYMBOL = b"!#$%&*+/<=>@[\\]^_`{|}~"
_HIGH = bytes(range(128, 256))
#: Names of the features, in order.
FEATURES = ("bytes", "words", "word_bytes", "upper", "digit", "punctuation", "symbol", "exclaim", "high", "newline", "distinct_words", "top_word", "distinct_lines", "top_line", "shouted", "odd_ends", "long_words", "sentence_words", "echo")


def _share(b: bytes, chars: bytes) -> float:
    return 1 - len(b.translate(None, chars)) / len(b)


#: Hash buckets of words, and of runs of three bytes.
WORDS, GRAMS = 256, 128
WIDTH = len(FEATURES) + WORDS + GRAMS


def counts(b: bytes) -> list[float]:
    """Numbers that describe a whole UTF-8 text; an empty one has only zeros."""
    words = b.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, lines = len(words), b.split(b"\n")
    counted, lined = Counter(words), Counter(lines)
    ends = [w[-1] for w in words]
    odd = sum(ends.count(c) for c in _SYMBOL)
    return [
        math.log1p(len(b)), math.log1p(n), min(30.0, (len(b) - n) / n), _share(b, _UPPER), _share(b, _DIGIT), _share(b, _STOP), _share(b, _SYMBOL), b.count(b"!") / n, _share(b, _HIGH), len(lines) / n,
        len(counted) / n, max(counted.values()) / n, len(lined) / len(lines), max(lined.values()) / len(lines), sum(map(bytes.isupper, words)) / n, odd / n, sum(len(w) > 25 for w in words) / n, (ends.count(46) + ends.count(63)) / n, sum(map(eq, words, words[1:])) / n,
    ]


def shares(b: bytes) -> np.ndarray:
    """Square roots of the shares of hashed words and of hashed runs of three bytes, A-Z lower-cased."""
    low = b.lower()
    counted = Counter(low.split())
    out = np.zeros(WORDS + GRAMS, np.float32)
    if counted:
        at = np.fromiter(map(zlib.crc32, counted), np.int64, len(counted)) % WORDS
        n = np.fromiter(counted.values(), np.float64, len(counted))
        out[:WORDS] = np.sqrt(np.bincount(at, n, WORDS) / n.sum())
    if len(low) > 2:
        x = np.frombuffer(low, np.uint8).astype(np.uint32)
        h = ((x[:-2] * np.uint32(961) + x[1:-1] * np.uint32(31) + x[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(25)
        out[WORDS:] = np.sqrt(np.bincount(h, minlength=GRAMS) / len(h))
    return out


def features(texts_: list[bytes]) -> np.ndarray:
    """A row of ``WIDTH`` numbers for each text."""
    out = np.zeros((len(texts_), WIDTH), np.float32)
    for k, b in enumerate(texts_):
        out[k, : len(FEATURES)] = counts(b)
        out[k, len(FEATURES) :] = shares(b)
    return out


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, features) of every row, features as little-endian 32-bit floats; a null text counts as empty. Repeated rows and ids keep their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, block in texts(batch):
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "features": pa.array([x.astype("<f4").tobytes() for x in features(block)], pa.binary())})

    return mapped(documents(docs, id_col, text_col), run, "doc_id long, features binary")


class Ranking:
    """A fitted linear ranking and its logistic scale."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, weights: np.ndarray, shift: float, slope: float) -> None:
        self.centre, self.scale, self.weights, self.shift, self.slope = centre, scale, weights, shift, slope

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, higher where label 1 is likelier."""
        return 1 / (1 + np.exp(-np.clip((_shaped(x, self.centre, self.scale) @ self.weights - self.shift) * self.slope, -40, 40)))


def _shaped(x: np.ndarray, centre: np.ndarray, scale: np.ndarray, dense: int = len(FEATURES)) -> np.ndarray:
    """Features on a common scale, of the first ``dense`` ones also the squares, so that a middle can be best; outliers are clipped."""
    z = np.clip((x - centre) / scale, -6, 6).astype(np.float32)
    return np.concatenate([z, z[:, :dense] ** 2], 1)


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = 100_000, ridge: float = 3.0, cut: float = 0.3, seed: int = 7) -> Ranking:
    """Bradley-Terry weights from ``pairs`` random (good, bad) pairs by Newton's method, and the score scale.

    The value at the quantile that the share of bad labels gives is mapped to ``cut``. With labels of one kind only,
    there is nothing to learn and every text scores on the safe side of ``cut``. Differences of pairs are never formed:
    a sum over pairs is a sum over texts, each weighted by its pairs, and steps come from conjugate gradients.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    width = x.shape[1] + min(len(FEATURES), x.shape[1])
    if not len(good) or not len(bad):
        base = 0.75 if len(good) or not len(bad) else cut / 2
        return Ranking(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(width), -math.log(base / (1 - base)), 1.0)
    centre, scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 1e-9
    scale = np.where(scale < 1e-6, 1.0, scale)
    z = _shaped(x, centre, scale)
    rng = np.random.default_rng(seed)
    up, down = rng.choice(good, pairs), rng.choice(bad, pairs)

    def over_pairs(r: np.ndarray) -> np.ndarray:
        """The sum of r times the difference of each pair."""
        return z.T @ (np.bincount(up, r, len(z)) - np.bincount(down, r, len(z))).astype(np.float32)

    def gap(w: np.ndarray) -> np.ndarray:
        v = z @ w.astype(np.float32)
        return (v[up] - v[down]).astype(np.float64)

    w = np.zeros(width)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(gap(w), -40, 40)))
        step = _conjugate(lambda v, p=p: over_pairs(p * (1 - p) * gap(v)) + ridge * v, over_pairs(1 - p) - ridge * w)
        w += step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    value = z @ w
    slope = 1.0
    at = float(np.quantile(value, len(bad) / len(y)))
    lo, hi = value[value <= at].max(initial=at), value[value > at].min(initial=at + 1e-6)
    return Ranking(centre, scale, w, float((lo + hi) / 2) - math.log(cut / (1 - cut)) / slope, slope)


def _conjugate(times: Callable[[np.ndarray], np.ndarray], b: np.ndarray, most: int = 60) -> np.ndarray:
    """The solution of a positive definite system, which ``times`` multiplies by, to about six digits."""
    x, r = np.zeros_like(b, np.float64), b.astype(np.float64)
    d, rr = r.copy(), float(r @ r)
    least = rr * 1e-12
    for _ in range(most):
        if rr <= least:
            break
        q = times(d)
        a = rr / float(d @ q)
        x += a * d
        r -= a * q
        rr, last = float(r @ r), rr
        d = r + rr / last * d
    return x


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that never train: the remainder of the id's CRC-32 is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit_quality(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = 20_000, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> Ranking:
    """Fit on at most ``sample`` labelled rows outside the held-out fold.

    Null labels, labels without a document and documents without an id are left out. Of several labels of an id the
    larger counts, of several texts of an id the one with the smallest features, so that the fit does not depend on the
    order of rows. Empty tables, or labels of one kind, give a model that keeps every text.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    taken = documents(docs, id_col, text_col).join(F.broadcast(known), "doc_id")  # at most `sample` rows
    rows = featured(taken).groupBy("doc_id").agg(F.min("features").alias("features")).join(F.broadcast(known), "doc_id").orderBy("doc_id").collect()
    x = np.frombuffer(b"".join(bytes(r["features"]) for r in rows), "<f4").reshape(-1, WIDTH)
    return fit_pairs(x, np.array([r["y"] for r in rows], int), cut=cut)


def score_quality(docs: DataFrame, model: Ranking, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` with ``score_col`` (replaced if it is there already); one row out for each row in.

    A score depends on the text alone: a null text counts as empty and has a score, equal texts have equal ones. Rows
    that share an id, or have none, keep their rows. An empty table stays empty.
    """
    docs = docs.drop(score_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.as_py() or b"" for t in batch.column(text_col).cast(pa.large_binary())]
            held = [model.scores(features(raw[at : at + 1024])) for at in range(0, len(raw), 1024)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0), *held]))], [*batch.schema.names, score_col])

    return mapped(docs, run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", `{score_col}` double")
