"""Importance resampling against a plain version, the SQL, and the tournament tree by itself."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import pytest

from lodestar.llm import queries, resample as module
from lodestar.llm.resample import Tournament, feature_hashes, resample

OUT = ["doc_id", "n_features", "weight", "score", "rank"]


def features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [zlib.crc32(x.encode()) for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def expected(rows, target, percent=25, seed=7, buckets=10_000, least=20):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(h % buckets for h in features(text)[1])
    for text in target:
        t.update(h % buckets for h in features(text)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets))))
    out = []
    for i, text in rows:
        w, hs = features(text)
        weight = sum(gain(h % buckets) for h in hs) // len(hs) if hs else 0
        score = None
        if i is not None:
            u = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296)))
        out.append([i, len(hs), weight, score, None, len(w) >= least and i is not None])
    may = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0], r[1], r[2]))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    rows = [(rng.randrange(-(10**6), 10**6), " ".join(rng.choice(["A", "b", "é日", "w" + str(rng.randrange(40))]) for _ in range(rng.choice([0, 3, 19, 20, 21, 90])))) for _ in range(n)]
    rows += [(5, "twenty words " * 10)] * 30 + [(None, "no id " * 30), (None, None), (6, None), (7, ""), (8, "!!! ... \x00"), (9, "x " * 5000)]
    return rows, [" ".join("w" + str(k) for k in range(12)), "A b", None, ""]


@pytest.mark.parametrize("chunk,width,percent", [(4096, 1 << 18, 25), (3, 20, 25), (2, 7, 90), (5, 40, 100), (4096, 1 << 18, 0)])
def test_rows_are_those_of_a_plain_version(spark, monkeypatch, chunk, width, percent):
    monkeypatch.setattr(module, "CHUNK", chunk)
    monkeypatch.setattr(module, "RANGE", width)
    rows, target = corpus(chunk, 300)
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, score int, rank string").repartition(7)
    got = resample(docs, spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int"), percent=percent)
    assert sorted((tuple(r) for r in got.select(OUT).collect()), key=str) == expected(rows, target, percent)


def test_one_score_of_very_many_rows_is_parted_by_id(spark, monkeypatch):
    monkeypatch.setattr(module, "RANGE", 50)
    monkeypatch.setattr(module, "noise", lambda i, seed: 0)
    docs = spark.createDataFrame([(k * 3, "the same words " * 10) for k in range(1000)], "doc_id long, text string").repartition(6)
    eligible = docs.selectExpr("doc_id", "0L AS score")
    assert len(module.ranges(eligible, [(0, 1000)], 0, 50)) >= 15
    got = {r["doc_id"]: r["rank"] for r in resample(docs, docs.limit(1)).collect()}
    ranked = sorted((i for i, r in got.items() if r), key=lambda i: got[i])
    assert len(ranked) == 250 and sorted(got[i] for i in ranked) == list(range(1, 251))


def test_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows, target = corpus(1, 150)
    spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, x string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for n in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {n} AS SELECT * FROM '{tmp_path}/{n}.parquet/*.parquet'")
    rel = db.execute(queries.ORACLE_SQL["op13_resample"])
    order = [[d[0] for d in rel.description].index(c) for c in OUT]
    assert sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=str) == expected(rows, target)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 10), (2, "d " * 30), (3, "e " * 30), (4, "f " * 30)], "doc_id long, text string")
    assert resample(none, some).count() == 0
    assert sorted(r["rank"] or 0 for r in resample(some, none).collect()) == [0, 0, 0, 1]


def test_long_texts_come_in_pieces():
    text = ("Some words, and " + "long" * 20 + " 12 ") * 50
    whole = sorted(features(text)[1])
    for piece in (1, 7, 100, 10**6):
        assert sorted(h for part in feature_hashes(text.encode(), piece) for h in part.tolist()) == whole


def test_tournament_is_a_merge():
    rng = random.Random(4)
    runs = [sorted((rng.randrange(50), rng.randrange(9)) for _ in range(rng.randrange(1, 30))) for _ in range(37)]
    tree, got = Tournament(), []
    for k, r in enumerate(runs):
        tree.add(r[::-1])
        if k == 20:  # places of ended runs are used again
            got += [tree.take() for _ in range(150)]
            rest = [x for h, c in zip(tree.heads, tree.chunks) if h is not None for x in (h, *c)]
            assert got == list(heapq.merge(*runs[:21]))[:150] and sorted(got + rest) == sorted(x for r in runs[:21] for x in r)
    while tree.first() is not None:
        got.append(tree.take())
    assert sorted(got) == sorted(x for r in runs for x in r) and got[150:] == sorted(got[150:])
