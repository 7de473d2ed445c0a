"""Where dispatched calls go, without looking at every type below an owner.

What a receiver runs for a signature changes only at some classes of its superclass chain: those that declare the signature,
that list an interface which has it, or that bring in an interface on which it is called. Between two such points all
receivers run the same. Classes are numbered as nested sets, so the receivers of a point are a few ranges of numbers: its own
range less those of the points below it. Whether a receiver of a point is allocated is a join of ranges with the numbers of
allocated types, done on blocks of powers of two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.hierarchy import interface_closure
from lodestar.operators.linkage import INTERFACE, has, resolve_members
from lodestar.session import durable

MEMBER = ["name", "descriptor"]


def running_totals(rows: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before, in ``order``: summed inside ranges of the order, and over the few ranges."""
    ranged = durable(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sums = ranged.groupBy("__range").agg(F.sum(value).alias("__sum"))  # a row for each range
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__range", F.coalesce(F.sum("__sum").over(before(Window.partitionBy(F.lit(0)).orderBy("__range"))), F.lit(0)).alias("__base"))
    inside = F.coalesce(F.sum(value).over(before(Window.partitionBy("__range").orderBy(*order))), F.lit(0))
    return ranged.withColumn(out, inside).join(F.broadcast(sums), "__range").withColumn(out, F.col(out) + F.col("__base")).drop("__range", "__base")


def nested_sets(types: DataFrame, chain: DataFrame) -> DataFrame:
    """(name, low, high): numbers of the classes of ``chain(start, depth, name)``, so that a class is below another if its number is in the other's range.

    ``chain`` holds the chain of every class in it. Classes whose chain does not end at a root (it comes back to itself, or
    is too long) have no numbers. A class has the first number of its range; sizes of subtrees are counts of the chains,
    places among siblings are sums of the sizes before, and both add up along a chain.
    """
    ends = chain.groupBy("start").agg(F.max(F.struct("depth", "name")).alias("end")).select("start", F.col("end.name").alias("name"))
    known = types.select(F.col("name").alias("super"))
    open_ends = ends.join(types.select("name", "super"), "name").join(known, "super", "left_semi").select("start")
    sound = durable(chain.join(open_ends, "start", "left_anti"))
    sizes = sound.groupBy("name").agg(F.count("*").alias("size"))
    parents = sound.where("depth = 1").select(F.col("start").alias("name"), F.col("name").alias("parent"))
    siblings = sizes.join(parents, "name", "left").select("name", "size", F.coalesce("parent", F.lit("")).alias("parent"))
    placed = running_totals(siblings, ["parent", "name"], "size", "total")
    first = placed.groupBy("parent").agg(F.min("total").alias("__first"))
    offsets = placed.join(first, "parent").select("name", "size", (F.col("total") - F.col("__first")).alias("offset"))
    low = sound.join(offsets.select("name", "offset"), "name").groupBy("start").agg((F.sum("offset") + F.max("depth")).alias("low"))
    return low.join(sizes, F.col("start") == F.col("name")).select("name", "low", (F.col("low") + F.col("size") - 1).alias("high"))


def range_blocks(low, high, levels: int):
    """The fewest blocks (level, block), numbers ``block * 2**level`` and up, that make the range of whole numbers."""

    def at(k):
        two = F.lit(1).cast("long")
        step = F.call_function("shiftleft", two, k)
        first, end = F.floor((low + step - 1) / step), F.floor((high + 1) / step)
        left = F.when((first < end) & (first % 2 == 1), F.struct(k.alias("level"), first.cast("long").alias("block")))
        right = F.when((first < end) & (end % 2 == 1), F.struct(k.alias("level"), (end - 1).cast("long").alias("block")))
        return F.array(left, right)

    return F.array_compact(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))))


def number_blocks(number, levels: int):
    """All blocks (level, block) that hold a number."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("level"), F.floor(number / F.call_function("shiftleft", F.lit(1).cast("long"), k)).cast("long").alias("block")))


class Dispatch:
    """Targets of dispatched calls by what is allocated.

    ``targets(site, name, descriptor, at, declarer, sig)``: a call on ``site`` runs the declarer's method once ``at`` is
    alive for the signature. ``covers(level, block, at, name, descriptor)``: it is once a type with a number in the block is
    allocated. Types for which points do not tell what they run (interfaces, classes below one or on a chain without end)
    are their own points in ``special(type, name, descriptor)``.
    """

    def __init__(self, types: DataFrame, chain: DataFrame, sites: DataFrame, allocatable: DataFrame, own: DataFrame, paths: DataFrame | None = None, ways: DataFrame | None = None) -> None:
        """``chain`` holds the chain of every class in it; ``sites(owner, name, descriptor)``, ``allocatable(type)``, ``own(name)``: declarers that count."""
        shapes = types.select("name", has(F.col("access"), INTERFACE).alias("is_interface"))
        signatures = sites.select(*MEMBER).distinct()
        declared = types.select(F.col("name").alias("at"), F.explode("members").alias("m")).select("at", "m.name", "m.descriptor").join(signatures, MEMBER, "left_semi").select("at", *MEMBER).distinct()
        declared = durable(declared)
        nodes = durable(chain.select("name").distinct())
        brought = durable(interface_closure(types, nodes.select(F.col("name").alias("start"), F.lit(0).alias("depth"), "name"), most=None, ways=ways).select(F.col("start").alias("at"), F.col("name").alias("interface")))
        self.numbers = durable(nested_sets(types, chain))
        mixed = chain.join(shapes.where("is_interface"), "name", "left_semi").select(F.col("start").alias("type")).distinct()
        regular = self.numbers.select(F.col("name").alias("type")).join(mixed, "type", "left_anti")
        self.receivers = durable(allocatable.join(regular, "type", "left_semi").join(self.numbers.select(F.col("name").alias("type"), "low"), "type").select("type", "low"))

        through = brought.join(declared.withColumnRenamed("at", "interface"), "interface").select("at", *MEMBER)
        called = brought.join(sites.withColumnRenamed("owner", "interface"), "interface").select("at", *MEMBER)
        points = declared.union(through).union(called).distinct().join(self.numbers.withColumnRenamed("name", "at"), "at")
        #: (at, name, descriptor, low, high): where what receivers run for a signature may change.
        self.points = points = durable(points.join(shapes.where("is_interface").select(F.col("name").alias("at")), "at", "left_anti").select("at", *MEMBER, "low", "high"))

        above = chain.select(F.col("start").alias("at"), F.col("name").alias("site"))
        above = durable(above.union(above.join(brought.withColumnRenamed("at", "site"), "site").select("at", F.col("interface").alias("site"))).distinct())
        odd = allocatable.join(regular, "type", "left_anti")
        special = durable(above.join(odd.withColumnRenamed("type", "at"), "at", "left_semi").join(sites.withColumnRenamed("owner", "site"), "site").select("at", "site", *MEMBER).distinct())
        self.special = durable(special.select(F.col("at").alias("type"), *MEMBER).distinct())

        asked = points.select(F.col("at").alias("owner"), *MEMBER).union(special.select(F.col("at").alias("owner"), *MEMBER))
        runs = resolve_members(types, asked, paths, ways).join(own.withColumnRenamed("name", "declarer"), "declarer", "left_semi")
        runs = durable(runs.select(F.col("owner").alias("at"), *MEMBER, "declarer", F.concat("name", "descriptor").alias("sig")))
        below = points.select("at", *MEMBER).join(above, "at").join(sites.withColumnRenamed("owner", "site"), ["site", *MEMBER], "left_semi").select("at", "site", *MEMBER)
        self.targets = durable(below.union(special).distinct().join(runs, ["at", *MEMBER]).select("site", *MEMBER, "at", "declarer", "sig"))

        # ranges of a point: from its number to the first point right below it, between those, and from the last to its end
        up = points.join(chain.where("depth > 0").select(F.col("start").alias("at"), "depth", F.col("name").alias("higher")), "at")
        up = up.join(points.select(F.col("at").alias("higher"), *MEMBER), ["higher", *MEMBER]).groupBy("at", *MEMBER, "low", "high").agg(F.min_by("higher", "depth").alias("parent"))
        inner = up.select(F.col("parent").alias("at"), *MEMBER, F.col("low").alias("stop"), (F.col("high") + 1).alias("go"))
        bounds = points.select("at", *MEMBER, (F.col("high") + 1).alias("stop"), (F.col("high") + 1).alias("go")).union(inner)
        order = Window.partitionBy("at", *MEMBER).orderBy("stop")
        gaps = bounds.withColumn("from", F.lag("go").over(order)).join(points.select("at", *MEMBER, "low"), ["at", *MEMBER])
        gaps = gaps.select("at", *MEMBER, F.coalesce("from", "low").alias("low"), (F.col("stop") - 1).alias("high")).where("low <= high")
        gaps = gaps.join(runs.select("at", *MEMBER), ["at", *MEMBER], "left_semi")
        self.levels = max(1, int(self.numbers.agg(F.max("high")).first()[0] or 0).bit_length())
        self.covers = durable(gaps.select("at", *MEMBER, F.inline(range_blocks(F.col("low"), F.col("high"), self.levels))).distinct())

    def woken(self, fresh: DataFrame) -> DataFrame:
        """(at, name, descriptor): points with a receiver among ``fresh(type)``, and the special types among them."""
        blocks = self.receivers.join(fresh, "type", "left_semi").select(F.inline(number_blocks(F.col("low"), self.levels))).distinct()
        by_range = self.covers.join(blocks, ["level", "block"], "left_semi").select("at", *MEMBER)
        return by_range.union(self.special.join(fresh, "type", "left_semi").select(F.col("type").alias("at"), *MEMBER)).distinct()
