"""Queries against their SQL on tables put together of copies with shifted keys, some of which are in two copies."""

import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
KEYS = {"part": ("p_partkey",), "lineitem": ("l_partkey", "l_suppkey", "l_orderkey"), "supplier": ("s_suppkey",), "orders": ("o_orderkey", "o_custkey")}


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """Three copies of the tables; the keys of a copy begin at half those of the one before."""
    out, con = tmp_path_factory.mktemp("copies"), duckdb.connect()
    last = {k: con.execute(f"SELECT max({c}) FROM '{SF}/{t}.parquet'").fetchone()[0] for k, t, c in (("partkey", "part", "p_partkey"), ("suppkey", "supplier", "s_suppkey"), ("orderkey", "orders", "o_orderkey"), ("custkey", "orders", "o_custkey"))}
    for t, keys in KEYS.items():
        shifted = ", ".join(f"({c} + i * {last[c.split('_')[1]] // 2}) AS {c}" for c in keys)
        con.execute(f"COPY (SELECT * REPLACE ({shifted}) FROM '{SF}/{t}.parquet', range(3) r(i)) TO '{out}/{t}.parquet' (FORMAT parquet)")
    return str(out)


def compared(spark, folder, name):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    df, rel = entry.queries()[name](spark, folder), con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    return sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()), sorted(map(repr, rel.fetchall()))


def test_interfaces_of_a_part_that_is_there_twice_have_one_place_each(spark, copies):
    got, wanted = compared(spark, copies, "interface_order")
    assert len(wanted) > 100 and got == wanted


def test_archives_of_a_table_may_be_larger_than_an_applications(spark, monkeypatch):
    from lodestar.sources import archive, budget, classpath

    low = (100, *budget.Budget.__init__.__defaults__[1:2], 1000, *budget.Budget.__init__.__defaults__[3:])
    monkeypatch.setattr(budget.Budget.__init__, "__defaults__", low)  # entries and nested bytes
    monkeypatch.setattr(archive.scan_entries, "__defaults__", (budget.Budget(), True))
    monkeypatch.setattr(classpath.expand, "__defaults__", (budget.Budget(),))
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet'")
    rel = con.execute(entry.oracle_sql()["nested_positions"])
    wanted = sorted(rel.fetchall())
    got = entry.queries()["nested_positions"](spark, folder).collect()
    assert sorted(tuple(r[d[0]] for d in rel.description) for r in got) == wanted


def shuffled(spark, name):
    """Bytes that a query writes to shuffles, for each order line."""
    store, folder = spark.sparkContext._jsc.sc().statusStore(), "/root/testdata/sf0.01"
    total = lambda: sum(store.executorList(False).apply(i).totalShuffleWrite() for i in range(store.executorList(False).size()))
    before = total()
    entry.queries()[name](spark, folder).write.format("noop").mode("overwrite").save()
    return (total() - before) / spark.read.parquet(f"{folder}/lineitem.parquet").count()


@pytest.mark.parametrize("name", ["first_failure_per_ref", "access_verdicts"])
def test_references_move_while_they_are_narrow(spark, name):
    got = shuffled(spark, name)
    assert 0 < got < 120


def test_pages_of_the_replay_are_read_with_those_behind_them(spark, tmp_path, monkeypatch):
    from lodestar.operators import proof

    monkeypatch.setattr(proof, "PAGE_BITS", 2)
    rows = spark.range(1600).selectExpr("id AS number", "0L AS place", "2 AS act", "id * 3 AS value")
    pages, reads = proof.Pages(rows, str(tmp_path / "pages")), []

    class Counted:
        def __init__(self, table):
            self.table = table

        def where(self, condition):
            reads.append(1)
            return self.table.where(condition)

    pages.table = Counted(pages.table)
    assert [pages.of(n) for n in [*range(1600), *range(1600)]] == [[(2, 3 * n)] for n in range(1600)] * 2
    assert len(reads) <= 1600 / 4 / proof.AHEAD + 1


def test_a_call_graph_makes_its_chains_once(spark, monkeypatch):
    from lodestar import archive_queries
    from lodestar.operators import hierarchy, reachability

    made = []
    real = hierarchy.chains
    for module in (hierarchy, reachability):
        monkeypatch.setattr(module, "chains", lambda *a, **k: made.append(1) or real(*a, **k), raising=False)
    reachability.CallGraph(*archive_queries._calls(spark, SF))
    assert len(made) == 1
