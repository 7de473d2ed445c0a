"""One-permutation MinHash against a plain version, the SQL and exact likenesses."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lodestar.llm import minhash, queries
from lodestar.llm.minhash import fingerprint, fingerprints, likeness, start, stride

OUT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
ODD = [(1, None), (2, ""), (None, "alone a b c d e f"), (None, None), (5, "é È ÀÉ x y z"), (3, "A b C d E f G"), (3, "other words of the same id, more of them"), (3, "A b C d E f G"), (9, "one two"), (9, "one two"), (-4, " \t\n "), (12, "w " * 9000)]


def plain(text, words=5, bins=256, bits=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    width = 32 - bins.bit_length() + 1
    slots = {}
    for r in runs:
        h = zlib.crc32(r.encode()) * 1540483477 % 2**32
        slots[h >> width] = min(h, slots.get(h >> width, h))
    if not slots:
        return ""
    out = []
    for b in range(bins):
        donor = b if b in slots else min(slots, key=lambda k: (k - start(b, bins)) * stride(b, bins) % bins)
        out.append(f"{slots[donor] % 2**bits:0{bits // 4}x}")
    return "".join(out)


def alike(a, b, bins=256, bits=4):
    if a is None or b is None:
        return None
    if not a or not b:
        return float(a == b)
    d = bits // 4
    same = sum(a[i : i + d] == b[i : i + d] for i in range(0, bins * d, d))
    return max(0.0, (same / bins - 2.0**-bits) / (1 - 2.0**-bits))


def expected(rows):
    rows = [(i, t or "") for i, t in rows]
    ids = sorted({i for i, _ in rows if i is not None})
    lead = {i: min((t for j, t in rows if j == i), key=lambda t: hashlib.md5(t.encode()).hexdigest()) for i in ids}
    out = []
    for i, t in rows:
        following = lead[ids[(ids.index(i) + 1) % len(ids)]] if i is not None else None
        half = len(t) // 2
        edited = t[: len(t) - half] + (following or "")[:half]
        f, e = plain(t), plain(edited)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e, alike(f, e), alike(f, plain(following) if following is not None else None)))
    return sorted(out, key=str)


def test_rows_are_those_of_a_plain_version_and_of_the_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(3)
    rows = ODD + [(20 + 7 * k, " ".join(rng.choice("aé B c D e f gg 日本 i".split()) + str(rng.randrange(9)) for _ in range(rng.choice([0, 1, 4, 5, 6, 30, 300])))) for k in range(40)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, id int").repartition(5)
    got = sorted((tuple(r) for r in fingerprints(docs).select(OUT).collect()), key=str)
    want = expected(rows)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5:] == pytest.approx(b[5:])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rel = db.execute(queries.ORACLE_SQL["op11_fingerprints"])
    order = [[d[0] for d in rel.description].index(c) for c in OUT]
    assert sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=str) == got


def test_a_table_of_one_row_and_none(spark):
    one = fingerprints(spark.createDataFrame([(7, "a b c d e f g h")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["near_next"]) for r in one] == [(7, 1.0)]
    assert fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [r["near_next"] for r in fingerprints(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()] == [None]


@pytest.mark.parametrize("bins,bits", [(64, 8), (512, 4), (256, 8)])
def test_other_sizes(spark, bins, bits):
    rng = random.Random(bins + bits)
    texts = [" ".join(str(rng.randrange(50)) for _ in range(n)) for n in (0, 1, 3, 9, 40, 400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fingerprint(F.col("t"), 3, bins, bits).alias("f"), fingerprint(F.lit(texts[-1]), 3, bins, bits).alias("g"))
    for r in df.select("t", "f", "g", likeness(F.col("f"), F.col("g"), bins, bits).alias("l")).collect():
        assert r["f"] == plain(r["t"], 3, bins, bits) and r["l"] == pytest.approx(alike(r["f"], r["g"], bins, bits))


def test_probing_and_comparing_choose_the_same_bins(spark, monkeypatch):
    texts = [(" ".join(f"w{i * k}" for i in range(n)),) for n in (5, 12, 60, 250) for k in (1, 3)]
    df = spark.createDataFrame(texts, "t string")
    a = df.select(fingerprint(F.col("t"))).collect()
    monkeypatch.setattr(minhash, "PROBES", 1)
    assert a == df.select(fingerprint(F.col("t"))).collect()


def test_likeness_estimates_the_share_of_common_shingles(spark):
    rng = random.Random(8)
    pairs = []
    for share in (0.0, 0.1, 0.33, 0.5, 0.8, 0.95, 1.0):
        for n in (12, 80, 700):
            for _ in range(6):
                a = [f"v{rng.randrange(10**6)}" for _ in range(n)]
                cut = int(n * (1 - share))
                b = [f"v{rng.randrange(10**6)}" for _ in range(cut)] + a[cut:]
                x, y = ({" ".join(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
                pairs.append((" ".join(a), " ".join(b), len(x & y) / len(x | y)))
    df = spark.createDataFrame(pairs, "a string, b string, j double")
    off = [r["l"] - r["j"] for r in df.select("j", likeness(fingerprint(F.col("a")), fingerprint(F.col("b"))).alias("l")).collect()]
    assert sum(map(abs, off)) / len(off) < 0.035 and abs(sum(off) / len(off)) < 0.015
