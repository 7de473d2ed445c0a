"""The training-data operators against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import tokenizers
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import bloom, chat, common, kdtree, notices, packing, queries, repeats, simhash
from lodestar.llm.attribution import attribute, encoding, line_sections, section_tokens
from lodestar.llm.chat import rotate_perspectives
from lodestar.llm.common import components
from lodestar.llm import decontaminate as decontamination
from lodestar.llm.decontaminate import SeedTable, decontaminate, find_leaks
from lodestar.llm.kdtree import top_k
from lodestar.llm.lines import dedup_lines
from lodestar.llm.notices import Notice, scan_notices
from lodestar.llm.quality import fit_pairs, fit_quality, score_quality

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string"
ODD = [(1, None, "en"), (2, "", None), (None, "alpha beta gamma delta epsilon zeta", "en"), (3, "x" * 50_000, "fr"), (4, "same line of more than twenty\nother", "de"), (4, "same line of more than twenty\nother", "de")]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def words(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# components


@pytest.mark.parametrize("few", [0, 200_000])
def test_components_are_those_of_union_find(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_LINKS", few)
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(1, 1)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(frame(spark, links, "a long, b long")).collect()}
    assert got == {n: root(n) for n in {x for l in links if l[0] != l[1] for x in l}}
    assert components(frame(spark, [], "a long, b long")).count() == 0


# packing


def least_bins(items, capacity):
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += items[i]
                place(i + 1, bins)
                bins[k] -= items[i]
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


def test_reduction_keeps_an_optimal_packing():
    rng = random.Random(2)
    for _ in range(400):
        capacity = rng.choice([10, 20, 50])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 8))), reverse=True)
        stock, fixed = packing.Stock(Counter(items), capacity), 0
        while True:
            before = stock.n.sum()
            for j in np.flatnonzero(stock.n)[::-1].tolist():
                while stock.n[j] > 0 and (chosen := packing.dominating(stock, j, capacity)):
                    times = stock.most(chosen)
                    stock.take(chosen, times)
                    fixed += times
            if stock.n.sum() == before:
                break
        rest = [int(s) for s in np.flatnonzero(stock.n)[::-1] for _ in range(stock.n[s])]
        assert fixed + (least_bins(rest, capacity) if rest else 0) == least_bins(items, capacity)


def test_plan_places_every_item_once():
    rng = random.Random(3)
    counts = Counter(min(4096, int(rng.lognormvariate(5, 1.5)) + 1) for _ in range(20_000))
    groups, facts = packing.plan(counts, 4096)
    placed = Counter()
    for items, times in groups:
        assert sum(s * m for s, m in items) <= 4096
        for s, m in items:
            placed[s] += m * times
    assert placed == counts and facts["sequences"] >= facts["lower_bound"]
    assert packing.plan({}, 10)[0] == []


def test_word_encoder_equals_the_tokenizer():
    enc = packing.WordEncoder(P.path("word_bpe_49k.json"))
    texts = ["It's 77 don't\x1cwe've Σας ΟΔΟΣ İİ ́x ﬁ é<|endoftext|> 7a a7b １７ can\x85t", "", " a  b　c", "Ünïcödé²½ª º naïve'll I'RE", "\x00\x01ab", "ends\n"]
    plain = [np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert enc.encode(texts) == plain == enc.encode(texts)


def test_word_encoder_equals_a_fresh_tokenizer():
    enc, fresh = packing.WordEncoder(P.path("word_bpe_49k.json")), tokenizers.Tokenizer.from_file(str(P.path("word_bpe_49k.json")))
    texts = [f for k in range(0x250) for f in (chr(k), chr(k) + "li", "a" + chr(k) + "B7", f"x {chr(k)}{chr(k)} y's")]
    texts += ["a <|endoftext|> b", "a<|endoftext|>b", "<|startoftext|>", "<|ENDOFTEXT|> c", "<|endoftext", "q<|endoftext|><|startoftext|>\n"]
    want = [np.array(fresh.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [t for t, a, b in zip(texts, enc.encode(texts), want) if a != b] == []


def test_packed_documents(spark):
    rng = random.Random(4)
    rows = ODD + [(k, words(rng, rng.choice([1, 5, 300, 6000]), 9000), "en") for k in range(10, 60)]
    clash = frame(spark, [(*r, 1, 2) for r in rows], DOCS + ", piece int, salt int")
    out = packing.pack_documents(clash, P.path("word_bpe_49k.json"), 1000, ids=True).collect()
    enc = packing.WordEncoder(P.path("word_bpe_49k.json"))
    want = Counter()
    for i, t, _ in rows:
        ids = np.append(np.frombuffer(enc.encode([t or ""])[0], "<u4"), 1).astype("<u4")
        want.update((i, k, k * 1000, zlib.crc32(ids[k * 1000 : k * 1000 + 1000].tobytes())) for k in range(-(-len(ids) // 1000)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["ids_crc32"]) for r in out) == want
    by = {}
    for r in out:
        assert len(r["ids"]) == 4 * r["length"]
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1000
    assert packing.pack_documents(frame(spark, []), P.path("word_bpe_49k.json")).count() == 0


# SimHash


def plain_fingerprint(text, n):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if x]
    s = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(pairs, n):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


@pytest.mark.parametrize("lanes,radius,small", [(1, 2, 48), (1, 2, 3), (1, 0, 48), (4, 50, 5), (2, 7, 48), (1, 3, 2)])
def test_bit_sliced_links(lanes, radius, small):
    rng = np.random.default_rng(lanes * 100 + radius)
    for n in (1, 2, 63, 64, 65, 400):
        base = rng.integers(0, 2**64, (max(1, n // 6), lanes), dtype=np.uint64)
        fp = base[rng.integers(0, len(base), n)].copy()
        for i in range(n):
            for bit in rng.integers(0, 64 * lanes, rng.integers(0, radius + 2)):
                fp[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        key = np.sort(rng.integers(0, max(1, n // 20), n))
        far = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2)
        want = groups_of(zip(*(x.tolist() for x in np.nonzero((far <= radius) & (key[:, None] == key[None])))), n)
        links = simhash.sorted_links(key, fp, radius, small)
        assert groups_of(links, n) == want and len(links) == n - len(set(want))


@pytest.mark.parametrize("block", [2048, 4])
def test_simhash_groups(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(common, "FEW_LINKS", 0 if block == 4 else 200_000)
    rng = random.Random(8)
    rows = list(ODD)
    for k in range(10, 90):
        base = words(random.Random(k % 9), 400).split() if k % 3 else words(rng, rng.choice([0, 1, 2, 40])).split()
        for _ in range(rng.choice([0, 1, 2])):
            if base:
                base[rng.randrange(len(base))] = "Zz"
        rows.append((k, " ".join(base), "en"))
    out = {(r["doc_id"], r["fp"].hex()): r["component_id"] for r in simhash.groups(frame(spark, rows)).collect()}
    fps = [plain_fingerprint(t or "", 3) for _, t, _ in rows]
    roots = groups_of([(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2], len(rows))
    for k, (i, _, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if roots[m] == roots[k] and rows[m][0] is not None]
        assert out[i, f"{fps[k]:016x}"] == min(ids, default=None)
    assert simhash.groups(frame(spark, [])).count() == 0


def test_near_groups_by_shingle_minima(spark):
    rng = random.Random(9)
    rows = []
    for k in range(12):
        base = words(rng, 300, 5000).split()
        rows.append((10 * k, " ".join(base), "en"))
        for m in range(1, 4):
            near = list(base)
            for at in rng.sample(range(300), 4):
                near[at] = f"new{m}{at}"
            rows.append((10 * k + m, " ".join(near), "en"))
    out = simhash.groups(frame(spark, rows), words=5, radius=52, lanes=4, minima=8).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {i: i // 10 * 10 for i, _, _ in rows}


@pytest.mark.parametrize("block,split", [(2048, 256), (3, 256), (2048, 4), (3, 4)])
def test_similar_groups_are_exact(spark, monkeypatch, block, split):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SPLIT", split)
    if split == 4:
        monkeypatch.setattr(simhash, "SHARE", 3)
        monkeypatch.setattr(simhash, "GROUP", 2)
        monkeypatch.setattr(simhash, "PASSES", (1, None))
    rng = random.Random(14)
    rows = [(None, "no id here at all, but words", "en"), (500, "", "en"), (501, None, "en")]
    for k in range(6):
        base = words(rng, 200, 5000).split()
        for m in range(10):
            text = list(base)
            for at in rng.sample(range(200), m):
                text[at] = f"new{m}x{at}"
            rows.append((10 * k + m, " ".join(text), "en"))
    rows += [(9, rows[5][1], "de")]  # an id of two texts
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for _, t, _ in rows]
    same = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    got = [(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.groups(frame(spark, rows), words=5, radius=72, lanes=4, minima=8, similarity=0.8).collect()]
    roots = groups_of([(a, b) for a in range(len(rows)) for b in range(a) if same(sets[a], sets[b])], len(rows))
    prints = [simhash.vote(simhash.shingle_hashes((t or "").encode(), 5), 4).astype(">u8").tobytes() for _, t, _ in rows]
    want = [(rows[k][0], prints[k], min((rows[m][0] for m in range(len(rows)) if roots[m] == roots[k] and rows[m][0] is not None), default=None)) for k in range(len(rows))]
    assert Counter((i, bytes(f), c) for i, f, c in got) == Counter(want)


def test_a_group_of_600_texts_is_exact_at_real_sizes(spark):
    """Copies of one text: chains of small changes, texts apart from all others, and a second cluster, all near by fingerprint."""
    rng = random.Random(15)
    base = [f"b{k}" for k in range(120)]
    rows, now = [], list(base)
    for k in range(600):
        text = list(base)
        if k < 250:  # a chain: each some words on from the one before
            now[rng.randrange(120)] = f"c{k}"
            text = list(now)
        for at in rng.sample(range(120), 6 if k >= 420 else 1):
            text[at] = f"n{k}x{at}"
        rows.append((k, " ".join(text), "en"))
    sets = [np.unique(simhash.shingle_hashes(t.encode(), 5)) for _, t, _ in rows]
    pairs = [(a, b) for a in range(600) for b in range(a) if simhash._alike(sets[a].astype("<u8").tobytes(), sets[b].astype("<u8").tobytes(), 0.8)]
    roots = groups_of(pairs, 600)
    first = {}
    for k, r in enumerate(roots):
        first.setdefault(r, k)
    out = simhash.groups(frame(spark, rows), **corpus_pipeline.NEAR).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {k: first[r] for k, r in enumerate(roots)} and len(set(roots)) > 100


def test_sets_are_compared_as_one_by_one():
    rng = random.Random(3)
    sets = [np.array(sorted(rng.sample(range(40), rng.choice([0, 1, 20, 30]))), "<u8").tobytes() for _ in range(60)]
    some = np.array(sorted(rng.sample(range(60), 25)))
    held = simhash.Sets(sets, 0.5)
    for p in range(60):
        if sets[p]:
            assert held.like(p, some).tolist() == [simhash._alike(sets[p], sets[x], 0.5) for x in some]


def test_near_copies_that_repeat_a_passage_are_found(spark):
    rng = random.Random(16)
    rows = []
    for k, (n, passage, times) in enumerate([(200, 10, 10), (500, 20, 10), (500, 20, 30), (100, 8, 8)]):
        base = [f"t{k}w{x}" for x in rng.sample(range(5000), n)]
        rows += [(10 * k, " ".join(base), "en"), (10 * k + 1, " ".join(base[:40] + base[40 : 40 + passage] * times + base[40 + passage :]), "en")]
    out = simhash.groups(frame(spark, rows), **corpus_pipeline.NEAR).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {i: i // 10 * 10 for i, _, _ in rows}


def test_equal_fingerprints_of_different_texts_are_compared(spark):
    rng = random.Random(17)
    rows = [(k, " ".join([x] * times + [f"own{k}w{m}" for m in range(60)]), "en") for k, (x, times) in enumerate([("same", 120)] * 3 + [("a b c", 100)] * 3)]
    out = simhash.groups(frame(spark, rows), **corpus_pipeline.NEAR).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {i: i for i, _, _ in rows}
    # all fingerprints equal: the sets alone decide
    rows = [(2 * k + m, " ".join([f"t{k}w{x}" for x in range(100)] + [f"end{m}"]), "en") for k in range(5) for m in range(2)]
    nodes = {i: simhash.set_digest(np.unique(simhash.shingle_hashes(t.encode(), 5))) for i, t, _ in rows}
    prints = frame(spark, [(i, bytes(32), [0] * 8, bytearray(x)) for i, x in nodes.items()], "doc_id long, fp binary, keys array<long>, node binary")
    links = simhash.similar_links(frame(spark, rows), prints, 5, 4, 72, 0.8).collect()
    assert {frozenset((bytes(r["a"]), bytes(r["b"]))) for r in links} == {frozenset((nodes[i], nodes[i + 1])) for i in range(0, 10, 2)}


def test_shares_connect_what_is_near(spark, monkeypatch):
    """Chains, far apart clusters and single nodes of two blocks, against all pairs."""
    monkeypatch.setattr(simhash, "SHARE", 4)
    monkeypatch.setattr(simhash, "GROUP", 3)
    monkeypatch.setattr(simhash, "PASSES", (2, 5, None))
    rng = np.random.default_rng(6)
    fp = rng.integers(0, 2**64, (60, 2), dtype=np.uint64)
    for k in range(1, 60):
        if k % 12:  # each twelve a chain of steps of 9 bits, of which only neighbours are near
            fp[k] = fp[k - 1]
            for bit in range(9 * (k % 12), 9 * (k % 12) + 9):
                fp[k, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    order = rng.permutation(60)
    block = (np.arange(60) >= 36).astype(int)
    rows = [(int(block[k]), bytes([k]), fp[k].astype(">u8").tobytes(), None) for k in order.tolist()]
    links = simhash.split_links(frame(spark, rows, "block long, node binary, fp binary, shingles binary"), 2, 10).collect()
    got = groups_of([(r["a"][0], r["b"][0]) for r in links], 60)
    far = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2)
    assert got == groups_of(zip(*(x.tolist() for x in np.nonzero((far <= 10) & (block[:, None] == block[None])))), 60) and len(set(got)) == 5


def test_one_document_of_each_group_stays(spark):
    rows = [(3, "a b c d e f g", "en"), (2, "A b c d e f g", "de"), (2, "A b c d e f g", "fr"), (None, "a b c d e f g", "en"), (4, None, "en"), (5, "", "en"), (6, "other words that are here alone", "en")]
    docs = frame(spark, [(*r, 1) for r in rows], DOCS + ", gone int")
    got = simhash.one_of_each_group(docs, **corpus_pipeline.NEAR)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["lang"]) for r in got.collect()) == Counter([(2, "de"), (2, "fr"), (None, "en"), (4, "en"), (6, "en")])


# helpers


def test_prefix_sums(spark, monkeypatch):
    monkeypatch.setattr(common, "RANGE", 8)
    rows = [(k % 3, k * 37 % 101 - 20, k) for k in range(60)] + [(7, -5, 2)]
    got = common.prefix_sums(frame(spark, rows, "key int, at long, total long"), ["key"], "at", F.col("total"), "base").collect()
    assert {(r["key"], r["at"], r["base"]) for r in got} == {(a, b, sum(z for x, y, z in rows if x == a and y < b)) for a, b, _ in rows}
    assert common.unused(["a", "A_", "b"], "a", "b", "c") == ["a__", "b_", "c"]


def test_rows_of_other_ids_are_told(spark):
    rng = random.Random(18)
    ids = [rng.randrange(10**6) for _ in range(3000)]
    docs = frame(spark, [(x, "t", "en") for x in [*ids[:500], *range(-600, 0), None]])
    maybe = {r["doc_id"] for r in docs.where(bloom.may_be_among(frame(spark, [(x,) for x in ids], "x long"), "x", F.col("doc_id"))).collect()}
    assert set(ids[:500]) <= maybe and None not in maybe and len(maybe) < 520
    assert docs.where(bloom.may_be_among(frame(spark, [(None,)], "x long"), "x", F.col("doc_id"))).where("doc_id is null").count() == 1
    assert bloom.without(docs, frame(spark, [(ids[0],), (None,)], "doc_id long"), "doc_id").count() == docs.count() - ids[:500].count(ids[0])


# Bloom filters and lines


def test_filters_miss_nothing(spark):
    rng = np.random.default_rng(1)
    once, twice = rng.integers(0, 2**63, 3000).astype(np.uint64), rng.integers(0, 2**63, 500).astype(np.uint64)
    rows = [bloom.packed(x, 4).to_pylist() for x in (np.concatenate([once[:1500], twice]), np.concatenate([once[1500:], twice[:400]]), np.concatenate([twice[400:], twice[400:410]]))]
    df = spark.createDataFrame([r for x in rows for r in x], "segment long, hashes binary")
    f = bloom.seen_filter(df, 4)
    assert f.has(twice).all() and f.has(once).mean() < 0.02
    assert bloom.seen_filter(df, 4, 1).has(np.concatenate([once, twice])).all()
    small = bloom.Filter(4, 1)
    for s in range(4):
        small.merge(s, f.bits[s * bloom.SEGMENT_BITS // 8 : (s + 1) * bloom.SEGMENT_BITS // 8].tobytes())
    assert small.has(twice).all()


def plain_lines(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(i)
    out = []
    for i, t, _ in rows:
        every = (t or "").split("\n")
        gone = [len(ids := held.get(key(x), set())) >= 3 and i != max(x for x in ids if x is not None) for x in every]
        out.append((i, len(every), sum(gone), "\n".join(x for x, g in zip(every, gone) if not g)))
    return Counter(out)


def test_lines(spark):
    rng = random.Random(6)
    pool = [f"  A Line number {k} with Text enough " for k in range(12)] + ["short", "", "éééééééééééééééééééé", "ÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉ", "kkkkkkkkkkkkkkkkkkkK\r", "\tTAB and more than twenty\x0b"]
    rows = ODD + [(k, "\n".join(rng.choice(pool) if rng.random() < 0.7 else words(rng, 8) for _ in range(rng.randrange(9))), "en") for k in range(10, 60)] + [(5, "same line of more than twenty", "x"), (None, pool[0], "y")]
    clash = frame(spark, [(*r, 7, "kept?", 1, 2, 3) for r in rows], DOCS + ", n_lines int, key string, __id int, id int, drops int")
    out = dedup_lines(clash)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()) == plain_lines(rows)
    assert {"lang", "key", "__id", "id", "drops"} <= set(out.columns)
    assert dedup_lines(frame(spark, [])).count() == 0


# license notices


def test_notices(spark):
    text = "Code (c) X, All  Rights\nReserved. CC-BY cc by; General Pubic License général public license ALL RIGHTS RESERVED"
    rows = [(1, text, "en"), (2, "all rights reservd everywhere, mozila public licence", "en"), (3, "released undr the MIT lcense", "en"), *ODD]
    out = {(r["doc_id"], r["n_words"]): r["spans"] for r in scan_notices(frame(spark, rows)).collect()}
    one = out[1, 19]
    assert [(s["label"], s["first_word"], s["errors"]) for s in one if s["base"]] == [("reserved", 3, 0), ("cc-by", 6, 0), ("cc-by", 8, 0), ("reserved", 16, 0)]
    assert [(s["label"], s["first_word"], s["errors"]) for s in one if not s["base"]] == [("gpl", 10, 1)]
    assert text.encode()[one[0]["start"] : one[0]["end"]] == b"All  Rights\nReserved"
    assert [(s["label"], s["errors"], s["base"]) for s in out[2, 7]] == [("reserved", 1, False), ("mpl", 2, False)]
    assert [(s["label"], s["errors"]) for s in next(v for (i, _), v in out.items() if i == 3 and v)] == [("mit", 2)]
    assert out[1, 0] == [] and out[2, 0] == []
    assert scan_notices(frame(spark, [])).count() == 0


@pytest.mark.parametrize("unit,places", [(b"license ", 0), (b"cc by x ", 1), (b"all right reserved x ", 1)])
def test_long_texts_of_notices_take_linear_time(unit, places):
    took = []
    for size in (200_000, 1_600_000):
        searches = [notices._Search(n) for n in notices.NOTICES]
        began = time.process_time()
        n, spans = notices.scan_text(unit * (size // len(unit)), searches)
        took.append(time.process_time() - began)
        assert len(spans) == places * (size // len(unit)) and n == len(unit.split()) * (size // len(unit))
        assert [s["first_word"] for s in spans[:3]] == [k * len(unit.split()) for k in range(3)][: len(spans)]
    assert took[1] < 24 * took[0] + 1  # eight times the text


def test_inexact_notices_before_a_better_one_are_found():
    search = notices._Search(Notice("reserved", "all rights reserved", 1, True))
    assert search.places(b"all right reserved x all rights reserved") == [(0, 18, 1), (21, 40, 0)]
    assert search.places(b"all right reserved x all rights reserved all rights reservd") == [(0, 18, 1), (21, 40, 0), (41, 59, 1)]


def test_every_exact_place_is_found(spark):
    rng = random.Random(7)
    bag = ["all", "rights", "reserved", "cc", "by", "general", "public", "license", "x"]
    rows = [(k, " ".join(rng.choice(bag) for _ in range(400)), "en") for k in range(40)]
    out = {r["doc_id"]: r["spans"] for r in scan_notices(frame(spark, rows)).collect()}
    for i, t, _ in rows:
        w = t.split()
        want = sorted((label, k) for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")) for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        assert sorted((s["label"], s["first_word"]) for s in out[i] if s["base"]) == want
    assert scan_notices(frame(spark, rows), (Notice("x", "no such phrase at all", 1),)).where(F.size("spans") > 0).count() == 0


def test_inexact_places_against_all_substrings():
    """Every run of words within the edits is a span or meets one, and no span has more edits than it says."""

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(24)
    met = 0
    for phrase, e in (("abc de", 1), ("abc de fg", 2), ("mit license here", 3)):
        search = notices._Search(Notice("x", phrase, e))
        for _ in range(150):
            w = []
            for _ in range(rng.randrange(1, 6)):
                near = list(phrase)
                for _ in range(rng.randrange(e + 2)):
                    at = rng.randrange(len(near))
                    near[at : at + rng.randrange(2)] = rng.choice(["", "q", "z", " "])
                w += "".join(near).split() + rng.choice([[], ["no"], ["abc"], ["de", "x"]])
            text = " ".join(w).encode()
            spots = [0, *(k + 1 for k, c in enumerate(text) if c == 32)]
            want = [(a, z, d) for a in spots for z in (*(s - 1 for s in spots[1:]), len(text)) if 0 < z - a <= len(phrase) + e and (d := edits(text[a:z], phrase.encode())) <= e]
            got = search.places(text)
            assert {(a, z) for a, z, d in want} >= {(a, z) for a, z, _ in got} and all(dict(((a, z), d) for a, z, d in want)[a, z] <= k <= e for a, z, k in got)
            assert all(any(a < z2 and a2 < z for a2, z2, _ in got) for a, z, _ in want), (text, phrase)
            met += len(want)
    assert met > 300


# chat


def test_perspectives(spark):
    turns = [(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, None, "x"), (1, None, "ann", "first"), (2, 0, "system", "only"), (None, 0, "ann", "lost"), (1, 2, "bob", None)]
    out = {}
    for r in rotate_perspectives(frame(spark, turns, "conv_id long, turn long, role string, text string")).orderBy("part").collect():
        out.setdefault((r["conv_id"], r["perspective"]), []).append(r)
    assert set(out) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    parts = out[1, "ann"]
    text = "".join(r["text"] for r in parts)
    assert text == "<|assistant|>\nfirst<|end|>\n<|system|>\nS<|end|>\n<|assistant|>\nhi<|end|>\n<|user:bob|>\n<|end|>\n<|user:bob|>\n<|end|>\n<|user:unknown|>\nx<|end|>\n"
    assert [text[m["from"] : m["to"]] for r in parts for m in r["mask"]] == ["first<|end|>\n", "hi<|end|>\n"]


TURNS = "conv_id long, turn long, role string, text string"


def test_long_conversations_come_in_parts(spark):
    turns = [(1, k, "ab"[k % 2], f"t{k}") for k in range(200)] + [(1, 70, "a", f"z{k}") for k in range(600)]
    out = rotate_perspectives(frame(spark, turns, TURNS)).where("perspective = 'a'").orderBy("part").collect()
    assert [r["part"] for r in out] == list(range(len(out))) and max(r["n_turns"] for r in out) <= 256
    whole = "".join(r["text"] for r in out)
    assert [r["start_char"] for r in out] == [sum(len(x["text"]) for x in out[:k]) for k in range(len(out))]
    said = [whole[m["from"] : m["to"]] for r in out for m in r["mask"]]
    assert len(said) == 700 and all(s[0] in "tz" for s in said) and len(re.findall(r"<\|user:b\|>", whole)) == 100
    assert rotate_perspectives(frame(spark, [], TURNS)).count() == 0


@pytest.mark.parametrize("rows", [255, 256, 257, 513])
def test_turns_of_one_number_keep_their_order_at_every_size(spark, rows):
    turns = [(1, 5, "a", f"m{k:03}") for k in range(rows)]
    out = rotate_perspectives(frame(spark, turns[::-1], TURNS).repartition(3)).orderBy("part").collect()
    assert [r["n_turns"] for r in out] == [256] * (rows // 256) + [rows % 256] * (rows % 256 > 0)
    assert re.findall(r"m\d+", "".join(r["text"] for r in out)) == [x[3] for x in turns]


@pytest.mark.parametrize("sent", [10_000, 0])
def test_long_conversations_equal_the_sql(spark, tmp_path, monkeypatch, sent):
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(chat, "SENT_BLOCKS", sent)
    monkeypatch.setattr(common, "RANGE", 3)
    rng = random.Random(19)
    turns = [(1, k, "ab"[k % 2], f"t{k}") for k in range(150)] + [(1, 70, "ab"[k % 2], f"z{k}") for k in range(600)] + [(2, 0, "a", "x")]
    turns += [(3, 9, "a", "same")] * 700 + [(3, 9, "a", "same!"), (3, None, None, None), (3, -70, "c", "early")]
    turns += [(None, rng.choice([None, -1, 3, 64, 900]), rng.choice("abc"), rng.choice([None, "", "é日本", "q"])) for _ in range(700)]
    turns += [(4, rng.randrange(300), rng.choice(["a", "system", None]), f"v{rng.randrange(9)}") for _ in range(1500)] + [(5, 1, "system", "alone")]
    clash = spark.createDataFrame([(*x, 7, "y") for x in turns], TURNS + ", block int, part string").coalesce(1)
    clash.write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    rel = db.execute(queries.ORACLE_SQL["op4_chat"])
    cols = [d[0] for d in rel.description]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, queries.op4_chat(spark, str(tmp_path)).select(cols).collect()), key=key) == sorted(rel.fetchall(), key=key)


# decontamination


def test_leaks(spark):
    rng = random.Random(10)
    items = [(k, words(rng, 30, 2000)) for k in range(20)] + [(20, None), (21, ""), (22, "too short")]
    bench = frame(spark, items, "item_id long, text string")
    rows, want = list(ODD), set()
    for k in range(100, 160):
        body = words(rng, 200, 2000).split()
        if k % 3:
            passage = items[k % 20][1].split()
            if k % 3 == 2:
                for at in rng.sample(range(30), 4):
                    passage[at] = "other"
            at = rng.randrange(len(body))
            body[at:at] = [w.upper() + "," for w in passage]
            want.add((k, k % 20))
        rows.append((k, " ".join(body), "en"))
    docs = frame(spark, rows)
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, bench).collect()} == want
    clean = decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert Counter(map(tuple, clean.collect())) == Counter(r for r in rows if r[0] not in {i for i, _ in want})
    assert find_leaks(docs, bench.limit(0)).count() == 0 and find_leaks(docs.limit(0), bench).count() == 0


def test_every_passage_of_the_rule_is_found():
    def passes(text, item):
        """The documented rule over all diagonals and stretches: the most agreeing words, 0 for no passage."""
        best = 0
        for d in range(1 - len(item), len(text)):
            same = [0 <= k - d < len(item) and w == item[k - d] for k, w in enumerate(text)]
            for a in range(len(text)):
                for z in range(a + 1, len(text) + 1):
                    if 5 * sum(same[a:z]) >= 4 * (z - a):
                        best = max(best, sum(same[a:z]))
        return best if best >= min(13, -(-4 * len(item) // 5)) else 0

    rng = random.Random(15)
    for n in [1, 3, 5, 6, 9, 10, 14, *range(15, 21), 25, 30]:
        for changed in (0, 1, 2, 3, 5):
            for _ in range(4):
                item = words(rng, n, 10_000).split()
                other = set(rng.sample(range(n), min(n, changed)))
                copy = [f"new{k}" if k in other else w for k, w in enumerate(item)]
                text = [*words(rng, 3).upper().split(), *copy, "tail"]
                got = SeedTable([(7, " ".join(item))], 13, 0.8).leaks([" ".join(text).encode()])
                want = passes(text, item)
                assert [x[4] for x in got] == ([want] if want else []), (n, changed)
    item = words(rng, 16, 10_000).split()
    copy = ["new" if k in (8, 12) else w for k, w in enumerate(item)]
    assert SeedTable([(7, " ".join(item))], 13, 0.8).leaks([" ".join(copy).encode()]) == [(0, 7, 0, 16, 14)]


def test_repeated_words_and_phrases_are_bounded(monkeypatch):
    import time

    rng = random.Random(21)
    item = "word " * 200 + words(rng, 30, 5000) + " word" * 170
    table = SeedTable([(7, item), (8, "a b " * 100)], 13, 0.8)
    began = time.process_time()
    got = table.leaks([b"word " * 20_000, b"a b " * 10_000, (words(rng, 500, 5000) + " ").encode() * 20])
    assert time.process_time() - began < 2
    assert [(t, i, n) for t, i, *_, n in got] == [(0, 7, 370), (1, 8, 200)]
    # listing and marking find the same
    bag = ["x", "y", "x y", "z z z", *words(rng, 4).split()]
    items = [(k, " ".join(rng.choice(bag) for _ in range(rng.randrange(1, 40)))) for k in range(12)]
    block = [" ".join(rng.choice(bag) for _ in range(rng.randrange(60))).encode() for _ in range(40)]
    table = SeedTable(items, 13, 0.8)
    listed = table.leaks(block)
    monkeypatch.setattr(decontamination, "HITS", 0)
    monkeypatch.setattr(decontamination, "COMPARED", 64)
    assert table.leaks(block) == listed and len(listed) > 20


def test_leaks_of_repeated_rows_and_clashing_names(spark):
    text = words(random.Random(22), 40, 2000)
    rows = [(1, text, 5), (1, text, 5), (1, "lead " + text, 6), (None, text, 7), (2, None, 8), (3, "clean", 9), (3, "clean", 9)]
    docs = frame(spark, rows, "doc_id long, text string, item_id int")
    bench = frame(spark, [(7, text), (7, text), (8, text), (None, text)], "item_id long, text string")
    got = sorted(map(tuple, find_leaks(docs, bench).collect()), key=str)
    assert got == sorted([(d, i, 0, 40, 40) for d in (1, None) for i in (7, 8)], key=str)
    assert Counter(map(tuple, decontaminate(docs, bench).collect())) == Counter([(2, None, 8), (3, "clean", 9), (3, "clean", 9)])


# quality


def test_quality_ranks_held_out_rows(spark):
    rng = random.Random(11)
    good = lambda: " ".join(words(rng, rng.randint(8, 14), 900) + "." for _ in range(10))
    bad = lambda: " ".join(w.upper() + "!!" for w in words(rng, 60, 15).split())
    rows = [(k, good() if k % 4 else bad(), "en") for k in range(400)] + ODD
    labels = frame(spark, [(k, int(k % 4 > 0)) for k in range(400)] + [(5000, 1), (7, None)], "doc_id long, quality int")
    docs = frame(spark, rows)
    model = fit_quality(docs, labels)
    out = score_quality(docs.withColumn("score", F.lit("old")), model)
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got if r["doc_id"] is not None and r["doc_id"] >= 10}
    assert np.mean([(by[k] >= 0.3) == (k % 4 > 0) for k in range(10, 400)]) > 0.98
    assert score_quality(docs.limit(0), model).count() == 0
    one = fit_pairs(np.ones((4, 3)), np.ones(4, int))
    assert (one.scores(np.zeros((2, 3))) > 0.3).all()
    assert (score_quality(docs, fit_quality(docs.limit(0), labels)).where("score < 0.3").count()) == 0
    twice = fit_quality(docs.union(docs).repartition(7), labels.union(labels).withColumn("text", F.lit(1)))
    assert np.allclose(twice.weights, model.weights, atol=1e-3)


def test_quality_learns_from_words(spark):
    """Texts that differ by their words alone, of the same lengths and counts."""
    rng = random.Random(23)
    pools = {1: [f"ab{k:03}" for k in range(0, 300)], 0: [f"cd{k:03}" for k in range(0, 300)]}
    rows = [(k, " ".join(rng.choice(pools[k % 2] if rng.random() < 0.3 else pools[rng.randrange(2)]) for _ in range(60)), "en") for k in range(600)]
    labels = frame(spark, [(k, k % 2) for k in range(400)], "doc_id long, quality int")
    docs = frame(spark, rows)
    got = {r["doc_id"]: r["score"] for r in score_quality(docs, fit_quality(docs, labels)).collect()}
    pairs = [got[a] > got[b] for a in range(401, 600, 2) for b in range(400, 600, 2)]
    assert np.mean(pairs) > 0.95


def test_pair_weights_equal_an_independent_fit():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6))
    y = (x @ np.array([1.0, -2, 0, 0.5, 0, 1]) + rng.normal(size=400) > 0).astype(int)
    model = fit_pairs(x, y, pairs=3000, ridge=3.0)
    z = np.clip((x - x.mean(0)) / x.std(0), -6, 6)
    z = np.concatenate([z, z * z], 1)
    draw = np.random.default_rng(7)
    up, down = draw.choice(np.flatnonzero(y == 1), 3000), draw.choice(np.flatnonzero(y == 0), 3000)
    d, w = z[up] - z[down], np.zeros(12)
    for _ in range(20_000):  # plain gradient ascent on the loss of explicit differences
        w += 2e-4 * (d.T @ (1 / (1 + np.exp(d @ w))) - 3.0 * w)
    assert np.allclose(model.weights, w, atol=2e-3)


# tokens


def test_tokens_per_section(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    enc, sizes = encoding(str(path), P.PATTERN)
    rng = random.Random(12)
    rows = ODD + [(k, "\n".join(words(rng, rng.randrange(5)) + "é\n\n  日本" * rng.randrange(3) for _ in range(6)), "en") for k in range(10, 30)]
    for rule in ("first", "last", "most"):
        out = section_tokens(frame(spark, rows), str(path), P.PATTERN, rule).collect()
        total = Counter()
        for r in out:
            total[r["doc_id"]] += r["n_tokens"]
        want = Counter()
        for i, t, _ in rows:
            want[i] += len(enc.encode_ordinary(t or ""))
        assert +total == +want
    for _ in range(200):
        ends = np.unique(np.append(np.array([rng.randrange(1, 40) for _ in range(rng.randrange(4))], int), 40))
        tokens = np.unique(np.append(np.array([rng.randrange(1, 40) for _ in range(9)], int), 40))
        for rule in ("first", "last", "most"):
            n, crossing = attribute(ends, tokens, rule)
            own, over = Counter(), Counter()
            for a, z in zip([0, *tokens[:-1]], tokens):
                held = [int(np.searchsorted(ends, x, "right")) for x in range(a, z)]
                s = held[0] if rule == "first" else held[-1] if rule == "last" else max(sorted(set(held)), key=held.count)
                own[s] += 1
                over[s] += len(set(held)) > 1
            assert [own[k] for k in range(len(ends))] == n.tolist() and [over[k] for k in range(len(ends))] == crossing.tolist()
    assert line_sections(b"a\nb").tolist() == [2, 3] and line_sections(b"").tolist() == [0] and line_sections(b"a\n").tolist() == [2]
    assert section_tokens(frame(spark, []), str(path), P.PATTERN).count() == 0


@pytest.mark.parametrize("rule", ["first", "last", "most"])
def test_tokens_of_sections_from_a_table(spark, rule):
    path = str(P.path("byte_bpe_50k.tiktoken"))
    enc, sizes = encoding(path, P.PATTERN)
    rng = random.Random(25)
    rows = [(k, words(rng, rng.randrange(1, 30)) + "é 日本", "en") for k in range(12)] + [(3, "another text of the same id", "de"), (None, "no id", "en"), (50, None, "en"), (51, "", "en"), (52, "without sections", "en")]
    table = [(k, *sorted((rng.randrange(60), rng.randrange(60)))) for k in [*range(12), 50, 51, 99] for _ in range(4)] + [(3, 0, 10), (3, 0, 10), (4, None, 5), (None, 0, 3)]
    sections = frame(spark, [(*x, "kind") for x in table], "doc_id long, start long, end long, text string")
    docs = frame(spark, [(*r, 5) for r in rows], DOCS + ", sections int")
    got = Counter(map(tuple, section_tokens(docs, path, P.PATTERN, rule, sections=sections).collect()))
    want = Counter()
    for i, t, _ in rows:
        own = sorted({(a, z) for d, a, z in table if d == i and i is not None and a is not None})
        ends = np.cumsum(sizes[enc.encode_ordinary(t or "")]).tolist()
        tally = Counter()
        for a, z in zip([0, *ends], ends):
            held = [max(0, min(z, e) - max(a, s)) for s, e in own]
            if rule == "most":
                mine = [held.index(max(held))] if held and max(held) else []
            else:
                mine = [k for k, (s, e) in enumerate(own) if s <= (a if rule == "first" else z - 1) < e]
            for k in mine:
                tally[k, "n"] += 1
                tally[k, "over"] += held[k] < z - a
        want.update((i, k, s, e, tally[k, "n"], tally[k, "over"]) for k, (s, e) in enumerate(own))
    assert got == want and sum(got.values()) > 40


# top-k


@pytest.mark.parametrize("shard,big", [(32_768, False), (60, False), (60, True)])
def test_top_k(spark, monkeypatch, shard, big):
    monkeypatch.setattr(kdtree, "SHARD", shard)
    monkeypatch.setattr(kdtree, "LEAF", 16)
    rng = np.random.default_rng(3)
    scale = 1e6 if big else 1.0
    vectors = [(k, (rng.normal(size=4) * scale if k % 4 else np.array([1.0, -0.5, 0.25, 0.0]) * scale).astype(np.float32).tolist()) for k in range(300)]
    odd = [(400, None), (420, [1.0, None, 0.0, 0.0]), (440, [float("nan")] * 4), (460, [float("inf")] * 4), (None, [9.0] * 4), (480, [1.0])]
    df = frame(spark, [(*r, 1, 2) for r in vectors + odd], "vec_id long, embedding array<float>, id int, shard int")
    got = {}
    for r in top_k(df, F.col("vec_id") % 20 == 0, 7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    points = {k: [int(np.floor(64 * np.float64(np.float32(x)))) for x in v] for k, v in vectors}
    for q in range(0, 300, 20):
        scores = sorted(((-sum(a * b for a, b in zip(points[q], p)), k) for k, p in points.items() if k != q))[:7]
        assert sorted(got[q]) == [(n + 1, k, -s) for n, (s, k) in enumerate(scores)]
    assert set(got) == set(range(0, 300, 20))
    assert top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_keeps_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "SHARD", 60)
    rng = np.random.default_rng(4)
    rows = [(k, rng.integers(-9, 9, 3).astype(float).tolist()) for k in range(200)]
    rows += [(7, [9.0, 9.0, 9.0])] * 25 + [(20, [9.0, 9.0, 9.0])] * 25 + [(21, [9.0, 9.0, 9.0]), (40, rows[40][1]), (40, rows[40][1]), (40, [1.0, -8.0, 2.0])]
    got = {}
    for r in top_k(frame(spark, rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 200, 20):
        pairs = sorted((-sum(int(64 * a) * int(64 * b) for a, b in zip(x, y)), j) for i, x in rows if i == q for j, y in rows if j != q)[:20]
        assert sorted(got[q]) == [(n + 1, j, -s) for n, (s, j) in enumerate(pairs)]


def test_one_vector_of_another_length_changes_nothing(spark):
    rows = [(k, [float(k % 7), float(k % 5)]) for k in range(100)]
    want = sorted(map(tuple, top_k(frame(spark, rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 3).collect()))
    got = top_k(frame(spark, [*rows, (100, [1.0, 2.0, 3.0]), (101, [])], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 3)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 15
    none = frame(spark, [(k, []) for k in range(0, 60, 20)], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(none, F.col("vec_id") == 20, 3).collect())) == [(20, 1, 0, 0), (20, 2, 40, 0)]


def test_cells_keep_far_queries_away(spark, monkeypatch):
    """Clusters far apart: the boxes of other cells cannot beat the kth score, and ties keep their order."""
    monkeypatch.setattr(kdtree, "SHARD", 100)
    rng = np.random.default_rng(8)
    centre = np.array([[9, 0, 0], [-9, 0, 0], [0, 9, 0], [0, -9, 0]], float)
    rows = [(k, (centre[k % 4] + rng.integers(-1, 2, 3) / 4).tolist()) for k in range(800)]
    points = np.array([[int(64 * x) for x in v] for _, v in rows])
    cut = kdtree.Splits(points, 8)
    low, high = (np.array([f(points[cut.of(points) == c], 0) for c in range(cut.cells)]) for f in (np.min, np.max))
    assert cut.cells == 8 and (kdtree._bounds(points[:1], low, high) < int(np.sort(points @ points[0])[-21])).sum() >= 4
    got = {}
    for r in top_k(frame(spark, rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 800, 20):
        pairs = sorted((-int(s), j) for j, s in enumerate(points @ points[q]) if j != q)[:20]
        assert sorted(got[q]) == [(n + 1, j, -s) for n, (s, j) in enumerate(pairs)]


# repeats


def plain_repeats(rows, length):
    first, covered = {}, []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    for k in order:
        b = (rows[k][1] or "").encode()
        for at in range(len(b) - length + 1):
            place = (rows[k][0] is not None, rows[k][0] or 0, at)
            g = b[at : at + length]
            first[g] = min(first.get(g, place), place)
    for i, t, _ in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for at in range(len(b) - length + 1):
            if first[b[at : at + length]] < (i is not None, i or 0, at):
                cover[at : at + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cover) if not c)
        spans = sum(1 for k in range(len(cover)) if cover[k] and not (k and cover[k - 1]))
        covered.append((i, len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(covered)


@pytest.mark.parametrize("length,hot", [(100, 4096), (25, 1), (25, 4096)])
def test_repeats(spark, monkeypatch, length, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "GROUP", 300)
    monkeypatch.setattr(repeats, "INDEX_BYTES", 3000)
    rng = random.Random(13)
    pool = [words(rng, 40) for _ in range(5)] + ["ab" * 90, "q" * 300, "ÄÖ日本" * 40]
    rows = [(1, None, "en"), (2, "", None), (None, pool[0], "en"), (4, pool[1], "de"), (4, pool[1], "de"), (5, "x" * 3000, "fr")]
    rows += [(k, " ".join(rng.choice(pool)[rng.randrange(30) :] if rng.random() < 0.5 else words(rng, 30, 3000) for _ in range(rng.randrange(6))), "en") for k in range(10, 60)]
    extra = ", ".join(f"{c} int" for c in ("n_bytes", "doc", "tag", "marks", "__doc", "id", "body"))
    docs = frame(spark, [(*r, *[1] * 7) for r in rows], f"{DOCS}, {extra}").repartition(5)
    out = repeats.dedup_repeats(docs, length).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in out) == plain_repeats(rows, length)
    assert all(sum(z - a for a, z in r["spans"]) == r["n_removed"] for r in out)
    assert repeats.dedup_repeats(frame(spark, []), length).count() == 0


def test_run_index_is_compressed_on_repetitive_text():
    piece = words(random.Random(1), 20).encode()
    index = repeats.RunIndex([piece] * 50)
    assert index.runs < index.length / 10
    assert len(index.repeated(len(piece), lambda p: p)) == 49
    for n in (50, 500):  # what is kept grows with the runs, not with the text
        rng = random.Random(n)
        long = repeats.RunIndex([words(rng, 400).encode() * 6] * 4)
        assert long.runs < long.length / 3 and long.nbytes() <= 40 * long.runs + 100


def test_run_index_gives_matching_statistics():
    rng = random.Random(20)
    for _ in range(60):
        pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 20))) for _ in range(rng.randrange(1, 7))]
        index = repeats.RunIndex(pieces)
        suffix = sorted((p[k:], m, index.begins[m] + k) for m, p in enumerate(pieces) for k in range(len(p)))
        for (a, _, _), (b, _, at) in zip([(b"", 0, 0), *suffix], suffix):
            agree = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert index.at(np.array([at]))[0].tolist() == [agree]
        rank = dict(zip(rng.sample(range(1000), index.length), range(index.length)))
        order = np.array(list(rank))
        for n in (1, 3, 6):
            first = {}
            for s, _, at in suffix:
                if len(s) >= n:
                    first[s[:n]] = min(first.get(s[:n], 10**6), order[at])
            want = sorted(at for s, _, at in suffix if len(s) >= n and order[at] > first[s[:n]])
            assert index.repeated(n, lambda p: order[p]).tolist() == want
