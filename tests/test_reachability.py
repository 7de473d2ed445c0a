"""Hierarchies by doubling, nested sets, dispatch points and reachable methods against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import dispatch, hierarchy, proof, reachability

TYPES = "name string, from_platform boolean, super string, interfaces array<string>, access int, members array<struct<name:string,descriptor:string,access:int>>"
OBJECT, ERROR = "java/lang/Object", "java/lang/LinkageError"


class Model:
    """A classpath as dicts, and what the rules say of it."""

    def __init__(self, rng, broken):
        n = 30
        names = [f"T{i:02}" for i in range(n)]
        self.t = {OBJECT: (True, None, [], 1, [("toString", "()V", 1), ("finalize", "()V", 4), ("m0", "()V", 1)]), ERROR: (True, OBJECT, [], 1, [])}
        for i, name in enumerate(names):
            is_interface = rng.random() < 0.3
            above = [x for x in names[:i] if broken or bool(self.t[x][3] & 512) == False]  # noqa: E712
            up = OBJECT if is_interface and not broken else rng.choice(above) if above and rng.random() < 0.7 else rng.choice([OBJECT, OBJECT, ERROR, "Gone"])
            below = [x for x in names[:i] if broken or self.t[x][3] & 512]
            faces = rng.sample(below, min(len(below), rng.choice([0, 0, 1, 2]))) + (["NoFace"] if rng.random() < 0.1 else [])
            members = [(m, "()V", rng.choice([1, 4, 9])) for m in rng.sample(["m0", "m1", "m2", "toString"], rng.choice([0, 1, 2]))] + [("<init>", "()V", 1)] * (not is_interface) + [("<clinit>", "()V", 8)] * (rng.random() < 0.3)
            self.t[name] = (rng.random() < 0.1, up, faces, 512 if is_interface else 1, members)
        if broken:  # chains that come back
            for a, b in (("T03", "T09"), ("T09", "T03"), ("T20", "T20")):
                p, _, f, x, m = self.t[a]
                self.t[a] = (p, b, f, x, m)
        self.mine = [x for x in names if not self.t[x][0]]
        self.application = set(rng.sample(self.mine, 5))
        kinds = ["INVOKE_STATIC", "INVOKE_SPECIAL", "METHOD_HANDLE", "INVOKE_VIRTUAL", "INVOKE_INTERFACE", "INVOKE_VIRTUAL", "GET_STATIC"]
        self.refs = []
        for c in self.mine:
            for m, d, _ in self.t[c][4]:
                for k in range(rng.choice([0, 1, 3])):
                    kind = rng.choice(kinds)
                    owner = rng.choice([*names, OBJECT, "[LT01;", "Gone"])
                    called = "f" if kind == "GET_STATIC" else rng.choice(["m0", "m1", "m2", "toString", "finalize", "<init>", "<init>"])
                    self.refs.append((c, len(self.refs), m + d, kind, owner, called, "I" if kind == "GET_STATIC" else "()V"))
        self.type_refs = [(c, m + d, rng.choice([ERROR, *names])) for c in self.mine for m, d, _ in self.t[c][4] if rng.random() < 0.1]

    def chain(self, n):
        out = []
        while n in self.t and n not in out:
            out.append(n)
            n = self.t[n][1]
        return out

    def closure(self, n):
        seen, queue = [], [i for c in self.chain(n) for i in self.t[c][2]]
        while queue:
            i = queue.pop(0)
            if i not in seen:
                seen.append(i)
                queue += self.t[i][2] if i in self.t else []
        return [i for i in seen if i in self.t]

    def run(self, n, name, d):
        if n not in self.t:
            return None
        is_interface = self.t[n][3] & 512
        ways = [(c, False) for c in ([n] if is_interface else self.chain(n))] + ([(OBJECT, True)] if is_interface else []) + [(c, False) for c in self.closure(n)]
        for c, inherited in ways:
            for m in self.t[c][4]:
                if m[:2] == (name, d) and not (inherited and (m[2] & 9) != 1):
                    return None if self.t[c][0] else (c, name + d)
        return None

    def settle(self):
        """The worklist in order: (reached, who reached a method first)."""
        order = lambda x: tuple(y.encode("utf-16-be") for y in x)
        silent = {(c, m) for c, m, x in self.type_refs if ERROR in self.chain(x)}
        entry = {(c, m + d) for c in self.application for m, d, _ in self.t[c][4]}
        reached, callers, pending, allocated, sites = set(entry), {}, set(entry), set(self.application), {}

        def reach(by, x):
            if x and x not in reached:
                reached.add(x)
                callers[x] = by
                pending.add(x)

        def initialize(by, n):
            if n in self.mine:
                for up in self.chain(n):
                    if not self.t[up][0] and any(m[0] == "<clinit>" for m in self.t[up][4]):
                        reach(by, (up, "<clinit>()V"))

        while pending:
            at = min(pending, key=order)
            pending.remove(at)
            if at in silent:
                continue
            for c, _, m, kind, o, n, d in sorted(self.refs, key=lambda r: r[1]):
                if (c, m) != at or o.startswith("["):
                    continue
                if kind in reachability.INITIALIZING:
                    initialize(at, o)
                if n == "<init>" and o in self.mine and not (m.startswith("<init>") and o in (c, self.t[c][1])) and o not in allocated:
                    allocated.add(o)
                    initialize(at, o)
                    for up in [*self.chain(o), *self.closure(o)]:
                        for _, (by, n2, d2) in sorted(sites.get(up, {}).items()):
                            reach(by, self.run(o, n2, d2))
                if kind in reachability.DIRECT + reachability.DISPATCHED and d.startswith("("):
                    reach(at, self.run(o, n, d))
                if kind in reachability.DISPATCHED:
                    sites.setdefault(o, {}).setdefault(n + d, (at, n, d))
                    for r in sorted(allocated):
                        if o in [*self.chain(r), *self.closure(r)]:
                            reach(at, self.run(r, n, d))
        return reached, callers

    def frames(self, spark):
        types = spark.createDataFrame([(n, *x) for n, x in self.t.items()], TYPES)
        classes = spark.createDataFrame([(n, "APPLICATION" if n in self.application else "CLASSPATH") for n in self.mine], "internal_name string, origin string")
        refs = spark.createDataFrame(self.refs, "internal_name string, ref int, method string, kind string, owner string, name string, descriptor string")
        return types, classes, refs, spark.createDataFrame(self.type_refs, "internal_name string, method string, target string")


@pytest.mark.parametrize("seed,broken,bits", [(2, False, 0), (3, True, 2)])
def test_reached_methods_and_first_callers_are_those_of_the_worklist(spark, monkeypatch, seed, broken, bits):
    m = Model(random.Random(seed), broken)
    facts = m.frames(spark)
    reached, callers = m.settle()
    graph = reachability.CallGraph(*facts)
    live = graph.reached().cache()
    assert {(r["owner"], r["sig"]) for r in live.collect()} == reached
    assert len(reached) > 10 and callers
    monkeypatch.setattr(proof, "PAGE_BITS", bits)
    monkeypatch.setattr(proof, "PAGES", 2)
    monkeypatch.setattr(proof, "AHEAD", 2)
    wanted = sorted(reached)[:: 1 if bits else 3] + [("Not", "there()V")]
    got = {(r["owner"], r["sig"]): (r["hops"], r["chain"]) for r in proof.proof_chains(graph, live, spark.createDataFrame(wanted, "owner string, sig string")).collect()}

    def text(node):
        steps = [node]
        while steps[-1] in callers:
            steps.append(callers[steps[-1]])
        steps = [f"{o.replace('/', '.')}#{s}" for o, s in reversed(steps)]
        return len(steps) - 1, " -> ".join(steps if len(steps) <= 12 else [*steps[:5], f"... {len(steps) - 10} hops ...", *steps[-5:]])

    assert got == {n: text(n) for n in wanted if n in reached}


@pytest.mark.parametrize("broken", [False, True])
def test_chains_and_closures_are_those_of_walks(spark, broken):
    m = Model(random.Random(17 + broken), broken)
    types = m.frames(spark)[0]
    chain = hierarchy.superclass_chain(types, types)
    got = {}
    for r in chain.orderBy("start", "depth").collect():
        got.setdefault(r["start"], []).append(r["name"])
    assert got == {n: m.chain(n) for n in m.t}
    faces = {}
    for r in hierarchy.interface_closure(types, chain).orderBy("start", "generation", "key").collect():
        faces.setdefault(r["start"], []).append(r["name"])
    assert faces == {n: m.closure(n) for n in m.t if m.closure(n)}


def test_a_chain_of_250_takes_few_rounds(spark, monkeypatch):
    rounds = []
    real = hierarchy.durable
    monkeypatch.setattr(hierarchy, "durable", lambda df: rounds.append(1) or real(df))
    rows = [(f"D{k:03}", f"D{k + 1:03}" if k < 299 else None) for k in range(300)]
    types = spark.createDataFrame(rows, "name string, super string")
    got = hierarchy.superclass_chain(types, spark.createDataFrame([("D049",), ("D000",)], "name string")).groupBy("start").count().collect()
    assert sorted(map(tuple, got)) == [("D000", 256), ("D049", 251)] and len(rounds) <= 10


def test_numbers_are_nested_sets(spark):
    m = Model(random.Random(5), True)
    types = m.frames(spark)[0]
    chain = hierarchy.superclass_chain(types, types)
    numbers = {r["name"]: (r["low"], r["high"]) for r in dispatch.nested_sets(types, chain).collect()}
    sound = {n for n in m.t if m.t[m.chain(n)[-1]][1] not in m.t}
    assert set(numbers) == sound and sorted(a for a, _ in numbers.values()) == list(range(len(sound)))
    for a in sound:
        for b in sound:
            assert (numbers[b][0] <= numbers[a][0] <= numbers[b][1]) == (b in m.chain(a))


def test_blocks_make_a_range(spark):
    rng = random.Random(2)
    rows = [tuple(sorted((rng.randrange(200), rng.randrange(200)))) for _ in range(60)] + [(0, 255), (7, 7), (0, 0), (128, 255)]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", dispatch.range_blocks(F.col("a"), F.col("b"), 8).alias("k"), dispatch.number_blocks(F.col("a"), 8).alias("n"))
    for r in df.collect():
        assert sorted(x for k in r["k"] for x in range(k["block"] << k["level"], (k["block"] + 1) << k["level"])) == list(range(r["a"], r["b"] + 1))
        assert [(k["level"], k["block"]) for k in r["n"]] == [(k, r["a"] >> k) for k in range(9)] and len(r["k"]) <= 16


def test_long_chains_are_told_by_their_ends(spark):
    names = [f"K{k:02}" for k in range(20)]
    types = spark.createDataFrame([(n, False, None, [], 1, [("m", "()V", 9)]) for n in names], TYPES)
    classes = spark.createDataFrame([(n, "APPLICATION" if n == "K19" else "CLASSPATH") for n in names], "internal_name string, origin string")
    refs = spark.createDataFrame([(names[k], 0, "m()V", "INVOKE_STATIC", names[k - 1], "m", "()V") for k in range(1, 20)], "internal_name string, ref int, method string, kind string, owner string, name string, descriptor string")
    graph = reachability.CallGraph(types, classes, refs, spark.createDataFrame([], "internal_name string, method string, target string"))
    (r,) = proof.proof_chains(graph, graph.reached(), spark.createDataFrame([("K00", "m()V")], "owner string, sig string")).collect()
    assert r["hops"] == 19 and r["chain"].count(" -> ") == 10 and "K15#m()V -> ... 10 hops ... -> K04#m()V" in r["chain"]
