"""Who reached a method first, and the chain of callers that proves it reachable.

Which methods are reached does not depend on the order, who reaches them first does: methods are taken by owner and
signature, references in class order, and what is found may come before what is waiting. That order is a sequence by its
nature, so the driver replays it, over numbers and one page at a time: methods, allocated types and dispatch points are
numbered by joins, their actions written as sorted pages to the shared folder, and only pages that the replay comes to are
read. It stops once all wanted methods are reached. The driver holds 8 bytes a reached method and a called site, a byte a
dispatch point, a number for each site below which a point is alive, and ``PAGES`` pages of each kind.
"""

from __future__ import annotations

import heapq
import uuid
from collections import OrderedDict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.dispatch import MEMBER, running_totals
from lodestar.operators.hierarchy import ordered_closure, superclass_chain
from lodestar.operators.reachability import FROM, CallGraph
from lodestar.session import durable, shared_folder

#: Numbers on a page (as a power of two), pages of a kind held at once, and pages read by one job.
PAGE_BITS, PAGES, AHEAD = 10, 1024, 32
#: What a page's rows say of a number: initialize, allocate, run, open a site; of a type's points; of a point's sites.
INITIALIZE, ALLOCATE, RUN, OPEN, WAKE, TARGET, SITE = range(7)
NONE, ENTRY = -1, -2
NOTHING = np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int64)


class Pages:
    """Rows (number, place, act, value) by number, 17 bytes each; a page is read with those that are needed soon and those behind it."""

    def __init__(self, rows: DataFrame, folder: str) -> None:
        spark = rows.sparkSession
        page = F.shiftright("number", PAGE_BITS).alias("page")
        held = rows.groupBy(page).agg(F.sort_array(F.collect_list(F.struct("number", "place", "act", "value"))).alias("rows"))
        held.repartitionByRange("page").sortWithinPartitions("page").write.parquet(folder)
        self.table, self.cache = spark.read.parquet(folder), OrderedDict()
        self.end = (self.table.agg(F.max("page")).first()[0] or 0) + 1

    def load(self, pages: list[int]) -> None:
        """Read the pages that are not held, with one job."""
        missing = list(dict.fromkeys(p for p in pages if p not in self.cache))[:AHEAD]
        if not missing:
            return
        for p in missing:
            self.cache[p] = NOTHING
        for r in self.table.where(F.col("page").isin(missing)).select("page", "rows.number", "rows.act", "rows.value").collect():  # AHEAD pages
            self.cache[r["page"]] = np.array(r["number"], np.int64), np.array(r["act"], np.int8), np.array(r["value"], np.int64)
        while len(self.cache) > max(PAGES, AHEAD):
            self.cache.popitem(last=False)

    def of(self, number: int, soon=()) -> list[tuple[int, int]]:
        page = number >> PAGE_BITS
        if page not in self.cache:
            self.load([page, *(n >> PAGE_BITS for n in soon), *range(page + 1, min(page + AHEAD, self.end))])
        self.cache.move_to_end(page)
        numbers, acts, values = self.cache[page]  # in order of the numbers
        low, high = np.searchsorted(numbers, (number, number + 1))
        return list(zip(acts[low:high].tolist(), values[low:high].tolist()))


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``number`` from 0 in the given order."""
    keys = [f"__k{i}" for i in range(len(order))]
    keyed = rows.select("*", *(c.alias(k) for c, k in zip(order, keys)), F.lit(1).cast("long").alias("__one"))
    return durable(running_totals(keyed, keys, "__one", "number").drop(*keys, "__one"))


def java_order(column: str) -> Column:
    """A sort key for Java's order of strings, which is by UTF-16 units."""
    return F.hex(F.encode(F.col(column), "UTF-16BE"))


class Replay:
    """The worklist over numbers. ``callers[n]`` is who reached method n first, ``ENTRY`` for the application's own."""

    def __init__(self, nodes: int, sites: int, points: int, methods: Pages, types: Pages, awake: Pages) -> None:
        self.callers, self.opened = np.full(nodes, NONE, np.int64), np.full(sites, NONE, np.int64)
        self.alive, self.allocated = bytearray(points), set()
        self.answers: dict[int, list[int]] = {}
        self.methods, self.types, self.awake = methods, types, awake
        self.pending: list[int] = []
        self.left: set[int] = set()

    def reach(self, caller: int, target: int) -> None:
        if self.callers[target] == NONE:
            self.callers[target] = caller
            self.left.discard(target)
            heapq.heappush(self.pending, target)

    def allocate(self, type_: int, caller: int) -> None:
        """A type counts as allocated from now on; of the application (no caller) it is not initialized by that."""
        if type_ in self.allocated:
            return
        self.allocated.add(type_)
        rows = self.types.of(type_)
        if caller != ENTRY:
            for act, value in rows:
                if act == INITIALIZE:
                    self.reach(caller, value)
        fresh = [p for act, p in rows if act == WAKE and not self.alive[p]]
        for p in fresh:
            self.alive[p] = 1
            target = None
            for act, value in self.awake.of(p, fresh):  # the target, then the sites in order of lookup
                if act == TARGET:
                    target = value
                elif self.opened[value] != NONE:
                    self.reach(int(self.opened[value]), target)
                else:
                    self.answers.setdefault(value, []).append(target)

    def run(self, entries: list[int], surface: list[int], wanted: list[int]) -> None:
        self.left = set(wanted)
        for n in entries:
            self.reach(ENTRY, n)
        for t in surface:
            self.allocate(t, ENTRY)
        while self.pending and self.left:
            at = heapq.heappop(self.pending)
            soon = self.pending[: 4 * AHEAD] if at >> PAGE_BITS not in self.methods.cache else ()
            for act, value in self.methods.of(at, soon):
                if act == INITIALIZE or act == RUN:
                    self.reach(at, value)
                elif act == ALLOCATE:
                    self.allocate(value, at)
                elif self.opened[value] == NONE:
                    self.opened[value] = at
                    for target in self.answers.pop(value, ()):
                        self.reach(at, target)

    def chain(self, node: int) -> list[int]:
        steps = [node]
        while self.callers[steps[-1]] >= 0:
            steps.append(int(self.callers[steps[-1]]))
        return steps[::-1]


def proof_chains(graph: CallGraph, reached: DataFrame, wanted: DataFrame) -> DataFrame:
    """(owner, sig, hops, chain) of every ``wanted(owner, sig)`` that is reached: ``entry -> ... -> method``.

    Of more than 12 steps the first and last five stay in the text; ``hops`` is the number of calls. At most as many
    methods may be wanted as a run may have findings.
    """
    spark, folder = reached.sparkSession, f"{shared_folder(reached.sparkSession)}/proof-{uuid.uuid4().hex}"
    dispatch = graph.dispatch
    nodes = numbered(reached.select("owner", "sig"), [java_order("owner"), java_order("sig")])
    goal = nodes.select("owner", "sig", F.col("number").alias("value"))
    at = nodes.select(F.col("owner").alias("from_owner"), F.col("sig").alias("from_sig"), "number")
    sites = numbered(graph.sites.join(at, FROM, "left_semi").select("site", *MEMBER).distinct(), [F.col("site"), F.col("name"), F.col("descriptor")])
    targets = dispatch.targets.join(sites.withColumnRenamed("number", "value"), ["site", *MEMBER])
    points = numbered(targets.select("at", *MEMBER, "declarer", "sig").distinct(), [F.col("at"), F.col("name"), F.col("descriptor")])
    every = graph.surface.union(graph.allocates.join(at, FROM, "left_semi").select("type")).distinct()
    types = numbered(every, [F.col("type")])

    say = lambda df, act, place="ref": df.select("number", F.col(place).cast("long").alias("place"), F.lit(act).alias("act"), "value")
    inits = graph.initializes.join(graph.starts.select("start", "owner", "sig"), "start").select(*FROM, "ref", "owner", "sig")
    methods = say(inits.join(at, FROM).join(goal, ["owner", "sig"]), INITIALIZE).union(say(graph.direct.join(at, FROM).join(goal, ["owner", "sig"]), RUN))
    methods = methods.union(say(graph.allocates.join(at, FROM).join(types.select("type", F.col("number").alias("value")), "type"), ALLOCATE))
    methods = methods.union(say(graph.sites.join(at, FROM).join(sites.withColumnRenamed("number", "value"), ["site", *MEMBER]), OPEN))

    chain = superclass_chain(graph.types, dispatch.receivers.select(F.col("type").alias("name")), paths=graph.paths).select(F.col("start").alias("type"), "depth", F.col("name").alias("at"))
    nearest = chain.join(dispatch.points.select("at", *MEMBER), "at").groupBy("type", *MEMBER).agg(F.min_by("at", "depth").alias("at"))
    runs = nearest.union(dispatch.special.select("type", *MEMBER, F.col("type").alias("at"))).join(points.select("at", *MEMBER, F.col("number").alias("value")), ["at", *MEMBER]).select("type", "value")
    woken = say(runs.join(types, "type").withColumn("ref", F.lit(1)), WAKE)
    started = graph.starts.withColumnRenamed("start", "type").join(types, "type").join(goal, ["owner", "sig"])
    of_types = woken.union(say(started.withColumn("ref", F.lit(0)), INITIALIZE))

    names = ordered_closure(graph.types, points.select(F.col("at").alias("name")).distinct(), graph.paths, graph.ways).select(F.col("start").alias("at"), F.struct("phase", "generation", "key").alias("way"), F.col("name").alias("site"))
    ordered = targets.select("at", "site", *MEMBER, "value").distinct().join(points, ["at", *MEMBER]).join(names, ["at", "site"])
    ranked = ordered.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("way", "value"))).alias("all")).select("number", F.posexplode(F.col("all.value")).alias("ref", "value"))  # the supertypes of one class
    of_points = say(ranked.withColumn("ref", F.col("ref") + 1), SITE).union(say(points.select("number", F.lit(0).alias("ref"), F.col("declarer").alias("owner"), "sig").join(goal, ["owner", "sig"]), TARGET))

    pages = [Pages(rows, f"{folder}/{k}") for k, rows in enumerate((methods, of_types, of_points))]
    replay = Replay(nodes.count(), sites.count(), points.count(), *pages)
    numbers = lambda df, among: sorted(r["number"] for r in df.join(among, among.columns, "left_semi").select("number").collect())
    goals = numbers(nodes, wanted.select("owner", "sig"))
    replay.run(numbers(nodes, graph.entries), numbers(types, graph.surface), goals)
    out = []
    for n in goals:
        steps = replay.chain(n)
        out += [(n, len(steps) - 1, k, x) for k, x in enumerate(steps) if len(steps) <= 12 or k < 5 or k >= len(steps) - 5]
    remove(spark, folder)
    told = spark.createDataFrame(out, "of long, hops long, place long, number long").join(nodes.select("number", F.concat(F.translate("owner", "/", "."), F.lit("#"), "sig").alias("step")), "number")
    told = told.groupBy("of", "hops").agg(F.sort_array(F.collect_list(F.struct("place", "step"))).alias("s")).withColumn("s", F.col("s.step"))  # ten steps at most
    short, cut = F.array_join("s", " -> "), F.array_join(F.concat(F.slice("s", 1, 5), F.array(F.concat(F.lit("... "), (F.col("hops") - 9).cast("string"), F.lit(" hops ..."))), F.slice("s", 6, 5)), " -> ")
    told = told.select(F.col("of").alias("number"), "hops", F.when(F.col("hops") > 11, cut).otherwise(short).alias("chain"))
    return durable(told.join(nodes, "number").select("owner", "sig", "hops", "chain"))


def remove(spark, folder: str) -> None:
    """Remove a folder of the shared file system, wherever that is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
