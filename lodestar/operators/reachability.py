"""Reachable methods by rapid type analysis: a semi-naive fixpoint of DataFrame joins.

A round joins only what the round before found. Edges whose target does not depend on what is allocated are resolved once
before the loop. Dispatched calls go to what allocated types below their owner run, also those allocated later: see
``dispatch``, which tells it from points of the hierarchy and ranges of numbers, not from every type below an owner.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.dispatch import Dispatch
from lodestar.operators.hierarchy import chains, superclass_chain, superinterfaces
from lodestar.operators.linkage import resolve_members
from lodestar.session import Grown, durable

DIRECT = ("INVOKE_STATIC", "INVOKE_SPECIAL", "METHOD_HANDLE")
DISPATCHED = ("INVOKE_VIRTUAL", "INVOKE_INTERFACE")
INITIALIZING = ("GET_STATIC", "PUT_STATIC", "INVOKE_STATIC")
LINKAGE_ERROR = "java/lang/LinkageError"
CLINIT = "<clinit>()V"
MEMBER = ["name", "descriptor"]
FROM = ["from_owner", "from_sig"]


def closure_from(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): all nodes that ``roots(node)`` reach over ``edges(src, dst)``, roots included. Cycles end it as any other path does."""
    fresh = durable(roots.select("node").where("node is not null").distinct())
    found, edges = Grown(fresh), durable(edges.select("src", "dst"))
    while not fresh.isEmpty():
        fresh = durable(edges.join(fresh, F.col("src") == F.col("node")).select(F.col("dst").alias("node")).where("node is not null").distinct().join(found.all(), "node", "left_anti"))
        found.add(fresh)
    return found.all()


def probes(types: DataFrame, type_refs: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(owner, sig): methods that name a LinkageError; they expect failures, so no edge leaves them."""
    chain = superclass_chain(types, type_refs.select(F.col("target").alias("name")).distinct(), paths=paths)
    errors = chain.where(F.col("name") == LINKAGE_ERROR).select(F.col("start").alias("target"))
    return type_refs.join(errors, "target", "left_semi").select(F.col("internal_name").alias("owner"), F.col("method").alias("sig")).distinct()


def _constructs(name: Column) -> Column:
    return name.startswith("<") & ~F.lit(CLINIT).startswith(name)


class CallGraph:
    """What the references of a classpath may run, resolved once.

    ``classes(internal_name, origin)`` are winners, the references those of winners: ``member_refs(internal_name, method,
    kind, owner, name, descriptor[, ref])``, ``type_refs(internal_name, method, target)``. Platform methods are never nodes.
    ``ref`` is the order of references in a class. Tables are keyed by the method that refers (``from_owner``, ``from_sig``).
    """

    def __init__(self, types: DataFrame, classes: DataFrame, member_refs: DataFrame, type_refs: DataFrame) -> None:
        self.types = types
        #: What every step asks of the hierarchy is made once.
        self.paths, self.ways = chains(types), superinterfaces(types)
        mine = durable(types.where("not from_platform").select("name", "super", "interfaces", "members"))
        own_names = mine.select("name")
        live = classes.join(mine.select(F.col("name").alias("internal_name"), "members"), "internal_name")
        application = durable(live.where("origin = 'APPLICATION'").select("internal_name", "members"))
        methods = application.select(F.col("internal_name").alias("owner"), F.explode("members").alias("m")).where(F.col("m.descriptor").startswith("("))
        #: Methods of the application, and its types, which count as allocated from the start and are not initialized.
        self.entries = durable(methods.select("owner", F.concat("m.name", "m.descriptor").alias("sig")).distinct())
        self.surface = durable(application.select(F.col("internal_name").alias("type")).distinct())

        refs = member_refs if "ref" in member_refs.columns else member_refs.withColumn("ref", F.lit(0))
        refs = refs.join(own_names.withColumnRenamed("name", "internal_name"), "internal_name", "left_semi").where(~F.col("owner").startswith("["))
        refs = refs.groupBy(F.col("internal_name").alias("from_owner"), F.col("method").alias("from_sig"), "kind", "owner", *MEMBER).agg(F.min("ref").alias("ref"))  # again it changes nothing
        refs = durable(refs.join(probes(types, type_refs, self.paths).toDF(*FROM), FROM, "left_anti"))
        calls = refs.where(F.col("descriptor").startswith("("))

        chain = durable(superclass_chain(types, own_names, paths=self.paths))
        higher = superclass_chain(types, chain.select("name").distinct().join(own_names, "name", "left_anti"), paths=self.paths)
        clinit = mine.where(F.exists("members", lambda m: (m["name"] == "<clinit>") & (m["descriptor"] == "()V"))).select("name")
        #: (start, depth, owner, sig): initializers that run when a class is initialized.
        self.starts = durable(chain.join(clinit, "name", "left_semi").select("start", "depth", F.col("name").alias("owner"), F.lit(CLINIT).alias("sig")))

        runs = resolve_members(types, calls.select("owner", *MEMBER), self.paths, self.ways).join(own_names.withColumnRenamed("name", "declarer"), "declarer", "left_semi")
        runs = runs.select("owner", *MEMBER, "declarer", F.concat(*MEMBER).alias("sig"))
        #: (from, ref, owner, sig): what a reference runs whatever is allocated.
        self.direct = durable(calls.where(F.col("kind").isin(*DIRECT + DISPATCHED)).join(runs, ["owner", *MEMBER]).select(*FROM, "ref", F.col("declarer").alias("owner"), "sig"))
        #: (from, ref, start): classes that a reference initializes.
        self.initializes = durable(refs.where(F.col("kind").isin(*INITIALIZING)).select(*FROM, "ref", F.col("owner").alias("start")))
        made = refs.where(_constructs(F.col("name"))).join(own_names.withColumnRenamed("name", "owner"), "owner", "left_semi").join(mine.select(F.col("name").alias("from_owner"), F.col("super").alias("parent")), "from_owner", "left")
        chaining = _constructs(F.col("from_sig")) & ((F.col("from_owner") == F.col("owner")) | F.coalesce(F.col("parent") == F.col("owner"), F.lit(False)))
        #: (from, ref, type): types that a reference allocates; a constructor that calls one of its own class or the superclass does not.
        self.allocates = durable(made.where(~chaining).select(*FROM, "ref", F.col("owner").alias("type")))
        #: (from, ref, site, name, descriptor): dispatched calls.
        self.sites = durable(calls.where(F.col("kind").isin(*DISPATCHED)).select(*FROM, "ref", F.col("owner").alias("site"), *MEMBER))
        every = self.surface.union(self.allocates.select("type")).distinct()
        self.dispatch = Dispatch(types, durable(chain.union(higher)), durable(self.sites.select(F.col("site").alias("owner"), *MEMBER).distinct()), every, own_names, self.paths, self.ways)

    def reached(self) -> DataFrame:
        """(owner, sig): the methods that application code may run."""
        nodes = lambda df: df.select(F.col("owner").alias("from_owner"), F.col("sig").alias("from_sig"))
        step = lambda df: df.select(F.col("declarer").alias("owner"), "sig")
        edges = durable(self.direct.select(*FROM, "owner", "sig").union(self.initializes.join(self.starts, "start").select(*FROM, "owner", "sig")).distinct())
        point, site, dispatch = ["at", *MEMBER], ["site", *MEMBER], self.dispatch
        fresh, first = self.entries, self.surface
        none = durable(dispatch.targets.select(*site, "at").limit(0))
        reached, allocated, open_sites, alive = Grown(fresh), Grown(first), Grown(none.select(*site)), Grown(none.select(*point))
        while not fresh.isEmpty():
            opens = self.sites.join(nodes(fresh), FROM, "left_semi").select(*site).distinct().join(open_sites.all(), site, "left_anti")
            makes = self.allocates.join(nodes(fresh), FROM, "left_semi").select("type").distinct().join(allocated.all(), "type", "left_anti")
            both = durable(opens.withColumn("type", F.lit(None).cast("string")).unionByName(makes, allowMissingColumns=True))  # one job for the two
            now_sites, made_now = both.where("type is null").select(*site), both.where("type is not null").select("type")
            new_types = made_now if first is None else made_now.union(first)
            asleep = first is None and made_now.isEmpty()
            woken = none.select(*point) if asleep else durable(dispatch.woken(new_types).join(alive.all(), point, "left_anti"))
            found = [
                edges.join(nodes(fresh), FROM, "left_semi").select("owner", "sig"),
                self.starts.join(made_now.withColumnRenamed("type", "start"), "start", "left_semi").select("owner", "sig"),
                step(dispatch.targets.join(now_sites, site, "left_semi").join(alive.all().union(woken), point, "left_semi")),
                step(dispatch.targets.join(woken, point, "left_semi").join(open_sites.all(), site, "left_semi")),
            ]
            fresh = durable(reduce(DataFrame.union, found).distinct().join(reached.all(), ["owner", "sig"], "left_anti"))
            reached.add(fresh)
            open_sites.add(now_sites)
            if not asleep:
                allocated.add(made_now)
                alive.add(woken)
            first = None
        return reached.all()


def reachable_methods(types: DataFrame, classes: DataFrame, member_refs: DataFrame, type_refs: DataFrame) -> DataFrame:
    """(owner, sig): the methods that application code may run; see ``CallGraph``."""
    return CallGraph(types, classes, member_refs, type_refs).reached()
