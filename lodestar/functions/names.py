"""Scalar functions on names, paths and symbols; columns where Spark can tell them, Python where it cannot."""

from __future__ import annotations

import os

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.session import ship

# Primitive types of descriptors.
PRIMITIVES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "V": "void", "Z": "boolean"}
_TYPE = r"\[*(?:L[^;]*;|[BCDFIJSVZ])"


def package_of(name: Column) -> Column:
    """Package of a slashed name; null for none."""
    return F.nullif(F.regexp_extract(name, "^(.+)/[^/]*$", 1), F.lit(""))


def binary_name(name: Column) -> Column:
    return F.translate(name, "/", ".")


def internal_name(name: Column) -> Column:
    return F.translate(name, ".", "/")


def release_of(major: Column) -> Column:
    return major - 44


def quantity(n: Column, one: str, many: str | None = None) -> Column:
    """``1 class``, ``2 classes``."""
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).otherwise(many or one + "s"))


def canonical_name(enum: Column) -> Column:
    return F.lower(enum)


def readable_type(descriptor: Column) -> Column:
    """Simple name of a type descriptor with its array brackets."""
    bare = F.regexp_replace(descriptor, r"^\[+", "")
    named = F.regexp_extract(bare, r"([^/;]+);$", 1)
    primitive = F.create_map(*[F.lit(x) for kv in PRIMITIVES.items() for x in kv])
    return F.concat(F.when(bare.startswith("L"), F.translate(F.regexp_replace(named, "^L", ""), "$", ".")).otherwise(F.element_at(primitive, bare)), F.repeat(F.lit("[]"), F.length(descriptor) - F.length(bare)))


def readable_member(owner: Column, name: Column, descriptor: Column) -> Column:
    """``com.a.B.m(String, int[])`` for methods, ``com.a.B.f`` for fields; the return type is left out."""
    inside = F.regexp_extract(descriptor, r"^\((.*)\)", 1)
    kinds = F.transform(F.regexp_extract_all(inside, F.lit(f"({_TYPE})"), F.lit(1)), readable_type)
    arguments = F.when(descriptor.startswith("("), F.concat(F.lit("("), F.array_join(kinds, ", "), F.lit(")"))).otherwise("")
    return F.concat(binary_name(owner), F.lit("."), name, arguments)


def nested_display(outer: Column, path: Column) -> Column:
    return F.concat(outer, F.lit("!/"), F.regexp_replace(path, "/$", ""))


def markdown(text: Column) -> Column:
    r"""Escape the characters that markdown reads: ``\`*_[]<>#``."""
    return F.regexp_replace(text, r"([\\`*_\[\]<>#])", r"\\$1")


def _segments(path: str, onto: list[str] | None = None, absolute: bool = True) -> list[str]:
    out = list(onto or [])
    for x in path.split("/"):
        if x == ".." and out and out[-1] != "..":
            out.pop()
        elif x == ".." and not absolute or x not in ("", ".", ".."):
            out.append(x)
    return out


def under_root(root: str | None, path: str, cwd: str | None = None) -> str:
    """A path in the shortest spelling, relative to the root if it lies below it; as it is if there is no root, or nothing is left of it. What follows ``!/`` stays."""
    if root is None:
        return path
    cwd = cwd or os.getcwd()
    outer, mark, inner = path.partition("!/")
    absolute = outer.startswith("/")
    plain = "/" * absolute + "/".join(_segments(outer, None, absolute))
    top = _segments(root, [] if root.startswith("/") else _segments(cwd))
    whole = _segments(outer, [] if absolute else _segments(cwd))
    below = top and whole[: len(top)] == top and len(whole) > len(top)
    return (outer if not plain else "/".join(whole[len(top) :]) if below else plain) + mark + inner


def measured(path: Column, root: str, cwd: str | None = None) -> Column:
    """``under_root`` as a column: the segments of a path are folded with an array as the stack."""
    cwd = cwd or os.getcwd()
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    at = F.instr(path, "!/")
    outer, rest = F.when(at > 0, F.substr(path, F.lit(1), at - 1)).otherwise(path), F.when(at > 0, F.substr(path, at)).otherwise(F.lit(""))
    absolute = outer.startswith("/")
    last = lambda a: F.get(a, F.size(a) - 1)

    def folded(onto: Column, rooted: Column) -> Column:
        up = lambda a, x: F.when(F.coalesce(last(a) != "..", F.lit(False)), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(rooted, a).otherwise(F.array_append(a, x))
        return F.aggregate(F.filter(F.split(outer, "/"), lambda x: ~x.isin("", ".")), onto, lambda a, x: F.when(x == "..", up(a, x)).otherwise(F.array_append(a, x)))

    plain = F.concat(F.when(absolute, "/").otherwise(""), F.array_join(folded(strings([]), absolute), "/"))
    here, top = _segments(cwd), _segments(root, [] if root.startswith("/") else _segments(cwd))
    whole = folded(F.when(absolute, strings([])).otherwise(strings(here)), F.lit(True))
    n = len(top)
    below = F.lit(n > 0) & (F.slice(whole, 1, n) == strings(top)) & (F.size(whole) > n) if n else F.lit(False)
    spelled = F.when(plain == "", outer).when(below, F.array_join(F.slice(whole, n + 1, F.greatest(F.size(whole) - n, F.lit(0))), "/")).otherwise(plain)
    return F.concat(spelled, rest)


class Respelling:
    """Texts with each occurrence of a name replaced in one pass: at every place the longest name that begins there.

    An automaton of all names reads a text once, however many names there are; it pickles, so tasks can have it.
    """

    def __init__(self, names: dict[str, str]) -> None:
        self.names, self.automaton = names, ahocorasick.Automaton()
        for n in names:
            if n:
                self.automaton.add_word(n, n)
        self.automaton.make_automaton()

    def of(self, text: str) -> str:
        if not len(self.automaton):
            return text
        longest: dict[int, int] = {}
        for end, name in self.automaton.iter(text):
            start = end + 1 - len(name)
            longest[start] = max(longest.get(start, 0), len(name))
        out, at = [], 0
        for start in sorted(longest):
            if start >= at:
                end = start + longest[start]
                out += [text[at:start], self.names[text[start:end]]]
                at = end
        return "".join([*out, text[at:]])

    def column(self, spark: SparkSession, text: Column) -> Column:
        """The same in tasks; null stays null."""
        ship(spark)
        sent = spark.sparkContext.broadcast(self)

        @F.pandas_udf("string")
        def respell(x: pd.Series) -> pd.Series:
            return x.map(sent.value.of, na_action="ignore")

        return respell(text)


def respelled(text: str, names: dict[str, str]) -> str:
    return Respelling(names).of(text)


def spelling_suggestions(words: DataFrame, vocabulary: DataFrame, most: int = 2, distance: int = 2) -> DataFrame:
    """(word, suggestion, distance, rank): the nearest known words within ``distance`` edits, by distance, then name.

    Words meet by deletion neighbourhoods: two words within d edits share a string that each gives by deleting at most d
    characters, so that no pair is formed that has nothing in common. ``words(word)``, ``vocabulary(name)``; equal words
    are no suggestion.
    """
    own = _deletions(words.select("word").where("word is not null").distinct(), "word", distance)
    known = _deletions(vocabulary.select("name").where("name is not null").distinct(), "name", distance)
    pairs = own.join(known, "__key").select("word", "name").distinct()
    near = pairs.withColumn("distance", F.levenshtein("word", "name")).where(F.col("distance").between(1, distance))
    rank = F.row_number().over(Window.partitionBy("word").orderBy("distance", "name"))
    return near.withColumn("rank", rank).where(F.col("rank") <= most).select("word", F.col("name").alias("suggestion"), "distance", "rank")


def _deletions(df: DataFrame, column: str, distance: int) -> DataFrame:
    out = df.withColumn("__key", F.col(column))
    level = out
    for _ in range(distance):
        cut = F.transform(F.sequence(F.lit(1), F.length("__key")), lambda i: F.concat(F.substring(F.col("__key"), F.lit(1), i - 1), F.substring(F.col("__key"), i + 1, F.length("__key"))))
        level = level.where(F.length("__key") > 0).select(column, F.explode(cut).alias("__key")).distinct()
        out = out.union(level)
    return out.distinct()


def suggestions(word: str, vocabulary: list[str], most: int = 2, distance: int = 2) -> list[str]:
    """The same for one word on the driver, for the command line."""

    def edits(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    return [v for d, v in sorted((edits(word, v), v) for v in set(vocabulary)) if 0 < d <= distance][:most]
