"""One-permutation MinHash: fingerprints of word shingles, in DataFrame functions alone.

Every shingle is hashed once; the upper bits of the hash choose a bin, and each bin keeps its smallest hash. An empty bin
borrows from a filled one by optimal densification: it has its own random order of all bins and takes the first filled one.
Of every bin only the low-order bits are stored, as hex digits; chance agreement of those bits is taken out of a likeness.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import durable

#: Words of a shingle, bins (a power of two), and low-order bits kept of a bin (4 or 8).
WORDS, BINS, BITS = 5, 256, 4
#: A shingle's hash is its CRC-32 times an odd number, modulo 2 to the 32.
HASH_BITS, ODD = 32, 1540483477
#: Bins of its order that an empty bin asks one by one, before it compares all filled bins at once; the choice is the same.
PROBES = 16

#: A-Z become lower case; tab to carriage return separate words as a space does.
RAW, PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz     "


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def start(bin_: int, bins: int) -> int:
    """Where the order of an empty bin begins."""
    return ((bin_ + 1) * 2654435761 >> 7) & (bins - 1)


def stride(bin_: int, bins: int) -> int:
    """An odd factor: filled bin k is number ``(k - start) * stride mod bins`` of the order, from 0."""
    return ((bin_ + 1) * 2246822519 >> 9) & (bins - 1) | 1


def numbers(values: list[int], kind: str = "bigint") -> Column:
    """A constant array, written as one literal, so that plans of hundreds of numbers are made at once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """32-bit hashes of all runs of ``words`` words; of fewer words, of the whole sequence; of none, an empty array."""
    split = F.filter(F.split(F.translate(text, RAW, PLAIN), " "), lambda w: w != "")
    number = lambda s: (F.crc32(s) * ODD).bitwiseAND((1 << HASH_BITS) - 1)

    def hashes(w: Column) -> Column:
        run = lambda i: number(F.concat(F.get(w, i), *[x for k in range(1, words) for x in (F.lit(" "), F.get(w, i + k))]))
        some = F.when(F.size(w) < words, F.array(number(F.array_join(w, " ")))).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - words, F.lit(0))), run))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(some)

    return let(split, hashes)


def fingerprint(text: Column, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> Column:
    """The low-order bits of all bins as hex digits, bin by bin; a text without words has the empty string.

    Texts with equal sequences of words have equal fingerprints; upper and lower case of A-Z are one.
    """
    if bins & (bins - 1) or bins < 2 or bits not in (4, 8):
        raise ValueError("bins must be a power of two, bits 4 or 8")
    shift = HASH_BITS - bins.bit_length() + 1
    rest, low = (1 << shift) - 1, (1 << bits) - 1
    ends = numbers([b << shift | rest for b in range(bins)])  # the largest hash of each bin stands for an empty one
    starts, strides = numbers([start(b, bins) for b in range(bins)]), numbers([stride(b, bins) for b in range(bins)])
    steps = [pow(stride(b, bins), -1, bins) for b in range(bins)]
    asks = [numbers([(start(b, bins) + k * steps[b]) % bins for b in range(bins)], "int") for k in range(PROBES)]
    hexed = F.split(F.lit(",".join(f"{v:0{bits // 4}x}" for v in range(low + 1))), ",")
    bin_of = lambda x: F.shiftright(x, shift)

    def smallest(hashes: Column) -> Column:
        """One value a bin, in the order of bins; null where no shingle fell."""
        first = lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1))))
        return F.transform(let(F.sort_array(F.concat(hashes, ends)), first), lambda x: F.when(x.bitwiseAND(rest) != rest, x))

    def digits(slots: Column) -> Column:
        def borrowed(filled: Column, b: Column) -> Column:
            asked = [F.get(slots, F.get(at, b)) for at in asks]
            number = lambda x: ((bin_of(x) - F.get(starts, b)) * F.get(strides, b)).bitwiseAND(bins - 1)
            nearest = F.array_min(F.transform(filled, lambda x: number(x) * (low + 1) + x.bitwiseAND(low)))
            return F.coalesce(*asked, nearest)

        def all_bins(filled: Column) -> Column:
            every = F.transform(slots, lambda x, b: F.get(hexed, F.coalesce(x, borrowed(filled, b)).bitwiseAND(low).cast("int")))
            return F.when(F.size(filled) == 0, F.lit("")).otherwise(F.array_join(every, ""))

        return let(F.filter(slots, lambda x: x.isNotNull()), all_bins)

    return let(shingle_hashes(text, words), lambda h: let(smallest(h), digits))


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """The estimated share of common shingles (Jaccard) of two fingerprints, 0 to 1.

    Bins that agree by chance, one in 2 to the ``bits``, are taken out; below that share the likeness is 0. Two empty
    fingerprints are alike, an empty one and another are not; null where one is null.
    """
    chance = 1.0 / (1 << bits)
    pieces = lambda x: F.split(x, "") if bits == 4 else F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: x.substr(i * 2 + 1, F.lit(2)))
    same = F.size(F.filter(F.zip_with(pieces(a), pieces(b), lambda x, y: x == y), lambda t: t))
    share = F.greatest(F.lit(0.0), (same / F.lit(float(bins)) - chance) / (1 - chance))
    empty = (a == "").cast("int") + (b == "").cast("int")
    return F.when(empty == 2, 1.0).when(empty == 1, 0.0).when(empty == 0, share)


def _order(rows: DataFrame) -> DataFrame:
    """(id, digest, before, wanted): for each id the digest of its leading text, the id before it (of the first: the last) and the most characters that the texts of that id want of it."""
    ids = rows.groupBy("id").agg(F.max(F.floor(F.length("text") / 2)).alias("need"), F.min(F.md5("text")).alias("digest"))
    ranged = durable(ids.repartitionByRange("id").withColumn("range", F.spark_partition_id()))
    ends = ranged.groupBy("range").agg(F.max(F.struct("id", "need")).alias("last"))  # a row for each range
    everywhere = Window.partitionBy(F.lit(0))
    ends = ends.select("range", F.coalesce(F.lag("last").over(everywhere.orderBy("range")), F.max("last").over(everywhere)).alias("ahead"))
    inside = F.lag(F.struct("id", "need")).over(Window.partitionBy("range").orderBy("id"))
    out = ranged.join(F.broadcast(ends), "range").withColumn("back", F.coalesce(inside, F.col("ahead")))
    return out.select("id", "digest", F.col("back.id").alias("before"), F.col("back.need").alias("wanted"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text is the text with its last half (rounded down) replaced by as many characters, or all, of the next
    document by id; after the last id comes the first. A null text is empty. Rows that share an id have the same next
    document, the one of the next id; where that id has several texts, it is the one of the smallest MD5. A row without an
    id is in no order: its edited text is its first half, and ``near_next`` is null. Other columns are not read.
    """
    all_rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = all_rows.withColumn("fp", fingerprint(F.col("text"), words, bins, bits))
    rows = marked.where("id is not null")
    order = _order(all_rows.where("id is not null"))
    heads = rows.join(order.withColumnRenamed("id", "own"), (F.col("id") == F.col("own")) & (F.md5("text") <= F.col("digest")))  # that is the smallest; the key is the id alone, as below
    heads = heads.select(F.col("before").alias("at"), F.col("text").substr(F.lit(1), F.col("wanted").cast("int")).alias("head"), F.col("fp").alias("next_fp"))
    heads = heads.groupBy("at").agg(F.first("head").alias("head"), F.first("next_fp").alias("next_fp"))  # equal rows of one id
    paired = rows.join(heads, F.col("id") == F.col("at"), "left").select("id", "text", "fp", "head", "next_fp")
    paired = paired.union(marked.where("id is null").select("id", "text", "fp", F.lit(None).cast("string"), F.lit(None).cast("string")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - half), F.coalesce(F.col("head").substr(F.lit(1), half), F.lit("")))
    out = paired.select("id", n.cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    out = out.withColumn("edited_fp", fingerprint(F.col("edited"), words, bins, bits))
    return out.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp"), bins, bits).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp"), bins, bits).alias("near_next"),
    )
