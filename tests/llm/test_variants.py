"""Spelling variants against a comparison of all words, and the SQL."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.llm import queries, variants
from lodestar.llm.variants import blocks, near_words, roots, spelling_groups

OUT = ["word", "form", "root", "n", "n_near", "form_n"]


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % 31 == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1 :]
            count[low] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    found = {w: [v for v in words if near(w, v)] for w in words}
    form = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in found.items() if vs}
    form = {w: v for w, v in form.items() if words[v] >= 10 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n, len(found[w]), words[form[w]] if w in form else None) for w, n in words.items()), key=str)


def texts(seed, n=60):
    rng = random.Random(seed)
    bases = ["inter" + "".join(rng.choice("abé") for _ in range(rng.randrange(2, 6))) for _ in range(25)] + ["".join(rng.choice("ab") for _ in range(7)) for _ in range(40)] + ["Zß÷×ÀÿÉ", "Abcdefgh" * 30]
    rows = [(k, " ".join(rng.choice(bases) for _ in range(rng.randrange(60))) + " common-" + "interabab " * rng.randrange(12) + "interabax") for k in range(n)]
    return rows + [(None, "interaba interaba INTERABA"), (None, None), (3, ""), (4, "interaba 9"), (4, "interaba 9"), (5, "a1b2 _ 日本日本日本日本")]


@pytest.mark.parametrize("block", [1, 3, 64])
def test_words_and_forms_are_those_of_comparing_all(spark, monkeypatch, block, tmp_path):
    monkeypatch.setattr(variants, "BLOCK", block)
    rows = texts(block)
    docs = spark.createDataFrame([(*r, "w", 3) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = sorted((tuple(r) for r in spelling_groups(docs).select(OUT).collect()), key=str)
    assert got == expected(rows) and any(r[1] for r in got) and max(r[4] for r in got) > 5
    if block == 64:
        duckdb = pytest.importorskip("duckdb")
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        db = duckdb.connect()
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        rel = db.execute(queries.ORACLE_SQL["op12_variants"])
        order = [[d[0] for d in rel.description].index(c) for c in OUT]
        assert sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=str) == got


@pytest.mark.parametrize("most", [1, 4, 20])
def test_wide_blocks_are_divided_and_each_pair_is_reported_once(spark, monkeypatch, most):
    monkeypatch.setattr(variants, "BLOCK", most)
    rng = random.Random(most)
    words = sorted({"prefixed" + "".join(rng.choice("abc") for _ in range(rng.randrange(4))) + "suffixed"[: rng.choice([6, 7, 8])] for _ in range(220)} | {"x" * k for k in range(7, 12)})
    df = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")
    sizes = blocks(df).where("short - front - back > 1").groupBy(variants.KEY).count().agg(F.max("count")).first()[0]
    assert sizes is None or sizes <= most
    got = [(r["word"], r["near"]) for r in near_words(df).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if near(a, b)}


def test_tables_without_words_and_long_chains(spark):
    assert spelling_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling_groups(spark.createDataFrame([(1, "short words only"), (2, None)], "doc_id long, text string")).count() == 0
    chain = spark.createDataFrame([(f"w{k:02}", f"w{k + 1:02}") for k in range(20)], "word string, form string")
    assert {r["root"] for r in roots(chain).collect()} == {"w20"}
