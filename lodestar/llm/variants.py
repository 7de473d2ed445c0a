"""Spelling variants: words one edit apart, found in sorted dictionaries read forwards and backwards.

One edit leaves the first or the second half of the shorter word intact, so two words that are near share a block of a
forward dictionary (equal first halves) or of a reversed one (equal second halves). Blocks of more than ``BLOCK`` words are
divided by the same argument: what lies between the shared ends is halved again, and one half of it is intact. This ends
where one character is left open, so the alphabet bounds every block. Blocks are scanned in order and every pair in them is
verified; each pair has exactly one block that reports it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import durable, mapped

#: Words of a block that one task compares with each other; larger ones are divided, unless one character only is open.
BLOCK = 64
#: Rows of a table that is sent to all tasks at most; a larger one is joined by shuffle.
SENT = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "([A-Za-zÀ-ÿ]+)"
#: A block: length of its shorter words, characters shared in front and at the end, these characters, and the common front
#: from which on a pair belongs to another block (the same characters may be shared along two ways).
KEY = ["short", "front", "back", "head", "tail", "bound"]


def dictionary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2, damage: int = 31) -> DataFrame:
    """(word, n): words of at least ``shortest`` characters that occur at least ``least`` times in all texts.

    Where ``damage`` divides the CRC-32 of "id:run", the run loses one character (no id counts as an empty one).
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(1))).alias("run"))
    runs = runs.where(F.length("run") >= shortest).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run"))).withColumn("at", (F.col("h") % F.length("run")).cast("int"))
    cut = F.concat(F.substr("run", F.lit(1), F.col("at")), F.substr("run", F.col("at") + 2))
    words = runs.select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with their block's characters; where all pairs belong to another block, none are left."""
    return rows.where("front < bound").select("word", "n", "short", "front", "back", "bound", F.expr("left(word, front)").alias("head"), F.expr("right(word, back)").alias("tail"))


def _halves(words: DataFrame) -> DataFrame:
    """Each word in the blocks of its own length, and in those of words shorter by one."""
    length = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("short")).withColumn("half", F.floor(F.col("short") / 2).cast("int"))
    sides = F.array(F.struct(F.col("half").alias("front"), F.lit(0).alias("back"), F.lit(1 << 30).alias("bound")), F.struct(F.lit(0).alias("front"), F.col("half").alias("back"), F.col("half").alias("bound")))
    return _keyed(rows.select("word", "n", "short", F.inline(sides)))


def _divided(rows: DataFrame) -> DataFrame:
    """Each row in two blocks more narrow: the first, or the second half of what is open is shared as well."""
    rows = rows.withColumn("half", F.floor((F.col("short") - F.col("front") - F.col("back")) / 2).cast("int")).withColumnsRenamed({"front": "f", "back": "b", "bound": "u"})
    longer = F.col("f") + F.col("half")
    sides = F.array(F.struct(longer.alias("front"), F.col("b").alias("back"), F.col("u").alias("bound")), F.struct(F.col("f").alias("front"), (F.col("b") + F.col("half")).alias("back"), F.least("u", longer).alias("bound")))
    return _keyed(rows.select("word", "n", "short", F.inline(sides)))


def blocks(words: DataFrame, most: int | None = None) -> DataFrame:
    """Rows (word, n, key) of all blocks, none of more than ``most`` words while more than one character is open."""
    most = most or BLOCK
    done, live = [], _halves(words)
    while True:
        wide = durable(live.where("short - front - back > 1").groupBy(KEY).agg(F.count("*").alias("size")).where(F.col("size") > most).drop("size"))
        count = wide.count()
        if not count:
            return reduce(DataFrame.union, [*done, live])
        if count <= SENT:
            wide = F.broadcast(wide)
        done.append(live.join(wide, KEY, "left_anti").select(live.columns))
        live = durable(_divided(live.join(wide, KEY, "left_semi").select(live.columns)))


def common_front(a: str, b: str, known: int = 0) -> int:
    """Characters that both words begin with, ``known`` of which are."""
    end = min(len(a), len(b))
    while known < end and a[known] == b[known]:
        known += 1
    return known


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of blocks that follow one another, in both directions."""
    now, held = None, []
    out: tuple[list, list, list] = ([], [], [])

    def compare() -> None:
        short, front, bound = now[0], now[1], now[5]
        base = [h for h in held if len(h[0]) == short]
        for i, (u, n) in enumerate(base):
            for v, k in base[i + 1 :]:
                at = common_front(u, v, front)
                if at < bound and at < short and u[at + 1 :] == v[at + 1 :]:
                    report(u, n, v, k)
            for v, k in held:
                if len(v) > short:
                    at = common_front(u, v, front)
                    if at < bound and u[at:] == v[at + 1 :]:
                        report(u, n, v, k)

    def report(u: str, n: int, v: str, k: int) -> None:
        for column, values in zip(out, ((u, v), (v, u), (k, n))):
            column.extend(values)

    def batch() -> pa.RecordBatch:
        r = pa.RecordBatch.from_pydict({"word": pa.array(out[0], pa.string()), "near": pa.array(out[1], pa.string()), "near_n": pa.array(out[2], pa.int64())})
        for column in out:
            column.clear()
        return r

    for b in batches:
        for *key, word, n in zip(*(b.column(c).to_pylist() for c in [*KEY, "word", "n"])):
            if key != now:
                if len(held) > 1:
                    compare()
                now, held = key, []
                if len(out[0]) > 50_000:
                    yield batch()
            held.append((word, n))
    if len(held) > 1:
        compare()
    yield batch()


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all pairs of words one inserted, deleted or replaced character apart, in both directions, each once."""
    rows = blocks(words).select(*KEY, "word", "n")
    return mapped(rows.repartition(*KEY).sortWithinPartitions(*KEY, "word"), _scan, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms(word, form)``: the end of each word's chain of forms, by pointer doubling. Chains must not be cycles."""
    now = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        ahead = durable(now.join(on, "root", "left").select("word", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")))
        now = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            return now


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2, damage: int = 31, factor: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``dictionary``.

    ``form`` is the near word of largest n (of equals the smallest), if it has at least ``factor`` times the word's n;
    ``root`` follows forms to the last. Null and empty texts have no words, repeated rows count each, other columns are not
    read. No words give no rows.
    """
    words = durable(dictionary(docs, id_col, text_col, shortest, least, damage))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(near, "word", "left").withColumn("fits", -F.col("best.less") >= F.col("n") * factor)
    form, form_n = F.when(F.col("fits"), F.col("best.near")), F.when(F.col("fits"), -F.col("best.less"))
    all_words = durable(joined.select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form_n.alias("form_n")))
    top = roots(all_words.where("form is not null"))
    return all_words.join(top, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
