"""Type hierarchies as ordered closures, by pointer doubling.

``types(name, super, interfaces)`` has one row a name. A round doubles the length of the paths that are known, so a
hierarchy of 250 levels takes 8 rounds; each round is one equi-join and is checkpointed, so that plans stay flat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import Grown, durable

#: Classes of one chain and interfaces of one closure at most.
DEPTH = 256


def chains(types: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(name, path): of every type the names of its superclass chain, itself first.

    ``ahead`` points as many steps up as the path has names. A walk that comes back to a name only repeats itself from
    there, so a path ends with its last new name.
    """
    known = types.select("name", F.col("super").alias("ahead"))
    real = known.select(F.col("name").alias("ahead"))
    now = durable(known.join(real, "ahead", "left_semi").select("name", F.array("name").alias("path"), "ahead").union(known.join(real, "ahead", "left_anti").select("name", F.array("name"), F.lit(None).cast("string"))))
    length = 1
    while length < depth and not now.where("ahead is not null").isEmpty():
        on = now.select(F.col("name").alias("ahead"), F.col("path").alias("more"), F.col("ahead").alias("next"))
        going, ended = now.where("ahead is not null"), now.where("ahead is null")
        joined = going.join(on, "ahead").withColumn("whole", F.concat("path", "more"))
        joined = joined.select("name", F.array_distinct("whole").alias("path"), F.when(F.size(F.array_distinct("whole")) == F.size("whole"), F.col("next")).alias("ahead"))
        now = durable(joined.union(ended))
        length *= 2
    return now.select("name", F.slice("path", 1, depth).alias("path"))


def superclass_chain(types: DataFrame, wanted: DataFrame, depth: int = DEPTH, paths: DataFrame | None = None) -> DataFrame:
    """(start, depth, name): each wanted name that resolves, then its superclasses, nearest first.

    A chain ends before a name that does not resolve or that it holds already, and after ``depth`` classes. ``paths``: the
    ``chains`` of the types, where they are at hand.
    """
    starts = wanted.select("name").where("name is not null").distinct()
    paths = chains(types, depth) if paths is None else paths
    return paths.join(starts, "name", "left_semi").select(F.col("name").alias("start"), F.posexplode("path").alias("depth", "name"))


def superinterfaces(types: DataFrame) -> DataFrame:
    """(name, above, key): what each named interface reaches over declared interfaces; ``key`` has the numbers of the declarations on the shortest way, of several the smallest.

    The way of a pair is put together of the ways of two halves, which are shortest and smallest themselves.
    """
    step = types.select("name", F.posexplode("interfaces").alias("i", "above")).where("above is not null")
    best = lambda df: df.groupBy("name", "above").agg(F.min(F.struct(F.size("key").alias("n"), "key")).alias("k")).select("name", "above", "k.key")
    named = step.select(F.col("above").alias("name")).distinct()
    ways = durable(best(step.join(named, "name", "left_semi").select("name", "above", F.array("i").alias("key"))))
    count = ways.count()
    while count:
        on = ways.select(F.col("name").alias("above"), F.col("above").alias("top"), F.col("key").alias("more"))
        further = ways.join(on, "above").select("name", F.col("top").alias("above"), F.concat("key", "more").alias("key"))
        ways = durable(best(ways.union(further)))
        before, count = count, ways.count()
        if count == before:
            break
    return ways


def interface_closure(types: DataFrame, chain: DataFrame, most: int | None = DEPTH, unresolved: bool = False, ways: DataFrame | None = None) -> DataFrame:
    """(start, generation, key, name[, found]): interfaces of a chain, breadth first in declared order, first visit wins.

    ``key`` orders the interfaces of one generation: the numbers of the declarations on the way. Names that do not
    resolve are passed over, or kept with ``found`` false. At most ``most`` interfaces of a start stay. ``ways``: the
    ``superinterfaces`` of the types, where they are at hand.
    """
    declared = types.select("name", F.posexplode("interfaces").alias("i", "above")).where("above is not null")
    ways = superinterfaces(types) if ways is None else ways
    first = chain.join(declared, "name").select("start", F.array("depth", "i").alias("key"), F.col("above").alias("name"))
    first = durable(first.groupBy("start", "name").agg(F.min("key").alias("key")))
    further = first.join(ways.withColumnRenamed("key", "more"), "name").select("start", F.concat("key", "more").alias("key"), F.col("above").alias("name"))
    visit = first.select("start", "key", "name").union(further).groupBy("start", "name").agg(F.min(F.struct((F.size("key") - 2).alias("generation"), "key")).alias("v"))
    out = visit.select("start", "v.generation", "v.key", "name").join(types.select("name", F.lit(True).alias("found")), "name", "left")
    out = durable(out.select("start", "generation", "key", "name", F.coalesce("found", F.lit(False)).alias("found")))
    if not unresolved:
        out = out.where("found").drop("found")
        if most is not None:
            order = Window.partitionBy("start").orderBy("generation", "key")  # the interfaces of one class
            out = out.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")
    return out


def ordered_closure(types: DataFrame, wanted: DataFrame, paths: DataFrame | None = None, ways: DataFrame | None = None) -> DataFrame:
    """(start, phase, generation, key, name): the chain (phase 0), then the interface closure (phase 1), in lookup order."""
    chain = superclass_chain(types, wanted, paths=paths)
    closure = interface_closure(types, chain, ways=ways)
    return chain.select("start", F.lit(0).alias("phase"), F.col("depth").alias("generation"), F.array("depth").alias("key"), "name").union(closure.select("start", F.lit(1), "generation", "key", "name"))


def supertype_walk(types: DataFrame, wanted: DataFrame) -> DataFrame:
    """(start, names, resolved): all supertypes of each wanted name that resolves, over superclasses and interfaces, and whether every one of them resolves. No ceiling."""
    up = types.select("name", F.array_compact(F.array_append("interfaces", F.col("super"))).alias("above"))
    now = durable(wanted.select("name").where("name is not null").distinct().join(up, "name").select(F.col("name").alias("start"), "name", "above"))
    found = Grown(now.select("start", "name", F.lit(True).alias("found")))
    while not now.isEmpty():
        ahead = now.select("start", F.explode("above").alias("name")).distinct().join(found.all(), ["start", "name"], "left_anti")
        ahead = durable(ahead.join(up, "name", "left").select("start", "name", "above", F.col("above").isNotNull().alias("found")))
        found.add(ahead.select("start", "name", "found"))
        now = ahead.where("found").select("start", "name", "above")
    return found.all().groupBy("start").agg(F.array_sort(F.collect_set("name")).alias("names"), F.bool_and("found").alias("resolved"))
