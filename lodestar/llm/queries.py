"""The registered queries of the training-data operators, and their SQL where SQL can tell the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.attribution import section_tokens
from lodestar.llm.chat import rotate_perspectives
from lodestar.llm.decontaminate import find_leaks
from lodestar.llm.kdtree import top_k
from lodestar.llm.lines import dedup_lines
from lodestar.llm.minhash import fingerprints
from lodestar.llm.notices import scan_notices
from lodestar.llm.packing import pack_documents
from lodestar.llm.quality import fit_quality, held_out, score_quality
from lodestar.llm.repeats import dedup_repeats
from lodestar.llm.resample import resample
from lodestar.llm.simhash import groups
from lodestar.llm.variants import spelling_groups


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_pack(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Best-fit packing of all documents into sequences of 4096 tokens."""
    out = pack_documents(table(spark, sf_dir, "documents"), tokenizer or tokenizer_file("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents: 3-word shingles, 64 bits, links at 2 bits or fewer."""
    out = groups(table(spark, sf_dir, "documents"), words=3, radius=2)
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op3_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents; spans as label:from:to:edits, bytes of the text."""
    out = scan_notices(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    best = F.array_max(F.transform("spans", lambda s: 1 - s["errors"] / F.length(s["notice"])))
    first = F.transform(base, lambda s: s["first_word"])
    return out.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("spans")).alias("labels"), F.coalesce(best, F.lit(0.0)).alias("score"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string"), s["errors"].cast("string"))), ",").alias("spans"),
    )


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's perspective, in parts, with masks."""
    out = rotate_perspectives(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["from"].cast("string"), m["to"].cast("string"))), ",")
    return out.select("conv_id", "perspective", F.col("part").cast("long").alias("part"), "start_char", "text", mask.alias("mask"), F.col("n_turns").cast("long").alias("n_turns"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item, and where."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_tokens(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    """Tokens of every line of every document, each document encoded once."""
    import public_tokenizers

    return section_tokens(table(spark, sf_dir, "documents"), ranks or tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best vectors for every vector whose id is divisible by 20."""
    out = top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 100 bytes cut out of all documents."""
    out = dedup_repeats(table(spark, sf_dir, "documents"), 100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold, kept in the last of them only."""
    out = dedup_lines(table(spark, sf_dir, "documents"), 20, 3)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash fingerprints of all documents and of their edited texts, with likenesses."""
    return fingerprints(table(spark, sf_dir, "documents"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words' count and the form that they are a variant of."""
    return spelling_groups(table(spark, sf_dir, "documents"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents of 20 words or more, drawn towards the benchmark's features."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_simhash": op2_simhash,
    "op3_notices": op3_notices,
    "op4_chat": op4_chat,
    "op5_decontaminate": op5_decontaminate,
    "op6_quality": op6_quality,
    "op7_tokens": op7_tokens,
    "op8_topk": op8_topk,
    "op9_repeats": op9_repeats,
    "op10_lines": op10_lines,
    "op11_fingerprints": op11_fingerprints,
    "op12_variants": op12_variants,
    "op13_resample": op13_resample,
    "pipeline": pipeline,
}

_OP4 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(floor(turn / 64), -1e18) AS block, coalesce(role, 'unknown') AS role, coalesce(text, '') AS said FROM conversations),
a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, said) AS no FROM t),
c AS (SELECT *, (no - min(no) OVER (PARTITION BY conv_id, block)) // 256 AS cut FROM a),
n AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY block, cut) - 1 AS part FROM c),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
s AS (SELECT n.conv_id, perspective, part, no, role, said, role = perspective AS own,
        '<|' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user:' || role END || '|>' || chr(10) AS head,
        said || '<|end|>' || chr(10) AS tail
      FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, coalesce(sum(length(head) + length(tail)) OVER (PARTITION BY conv_id, perspective ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM s)
SELECT conv_id, perspective, part::BIGINT AS part, min(pos) AS start_char, string_agg(head || tail, '' ORDER BY no) AS text,
  coalesce(string_agg((pos + length(head))::VARCHAR || '-' || (pos + length(head) + length(tail))::VARCHAR, ',' ORDER BY no) FILTER (own), '') AS mask, count(*) AS n_turns
FROM o GROUP BY conv_id, perspective, part
"""

_OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 20
"""

_OP10 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT k.doc_id, i, line, keeper IS NOT NULL AND keeper <> k.doc_id AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id
"""

_OP9 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT doc_id, b, octet_length(b) AS len FROM d),
g AS (SELECT doc_id, i, b[i : i + 99] AS s FROM (SELECT doc_id, b, unnest(range(1, len - 98)) AS i FROM n WHERE len >= 100)),
m AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
j AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, TRUE) AS fresh FROM m),
k AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM j),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS z FROM k GROUP BY 1, 2),
gaps AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS a, a AS z FROM r
  UNION ALL SELECT n.doc_id, coalesce(max(r.z), 1), n.len + 1 FROM n LEFT JOIN r USING (doc_id) GROUP BY n.doc_id, n.len),
kept AS (SELECT doc_id, string_agg(hex(b[gaps.a : gaps.z - 1]), '' ORDER BY gaps.a) AS h FROM gaps JOIN n USING (doc_id) WHERE gaps.z > gaps.a GROUP BY 1),
t AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM r GROUP BY 1)
SELECT n.doc_id, n.len::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM n LEFT JOIN t USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: CRC-32 in SQL: a table by the rule of its polynomial, and the fold over the bytes of ``x``.
_CRC_TABLE = "SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i))"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(x)) + 1), lambda i: ('0x' || hex(encode(x)[i : i]))::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"

_OP11 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
i AS (SELECT doc_id, arg_min(text, md5(text)) AS lead_text FROM d WHERE doc_id IS NOT NULL GROUP BY doc_id),
o AS (SELECT doc_id, coalesce(lead(lead_text) OVER (ORDER BY doc_id), first_value(lead_text) OVER (ORDER BY doc_id)) AS next FROM i),
r AS (SELECT d.doc_id, text, next, length(text) AS n, left(text, n - n // 2) || coalesce(left(next, n // 2), '') AS edited FROM d LEFT JOIN o ON d.doc_id = o.doc_id),
t AS (SELECT row_number() OVER () AS id, text FROM (SELECT text FROM r UNION SELECT edited FROM r)),
w AS (SELECT id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]'), lambda x: x <> '') AS w FROM t),
s AS (SELECT id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS x FROM w),
c AS ({_CRC_TABLE}),
u AS (SELECT x, {_CRC} * 1540483477 & 4294967295 AS h FROM (SELECT DISTINCT x FROM s), c),
m AS (SELECT id, h >> 24 AS bin, min(h) AS h FROM s JOIN u USING (x) WHERE h & 16777215 <> 16777215 GROUP BY ALL),
a AS (SELECT id, list(h) AS filled FROM m GROUP BY id),
b AS (SELECT b AS bin, ((b + 1) * 2654435761 >> 7) & 255 AS start, ((b + 1) * 2246822519 >> 9) & 255 | 1 AS stride FROM range(256) x(b)),
v AS (SELECT a.id, b.bin, coalesce(h, list_min(list_transform(filled, lambda x: (((x >> 24) - start) * stride & 255) * 16 + (x & 15)))) & 15 AS low FROM a CROSS JOIN b LEFT JOIN m ON m.id = a.id AND m.bin = b.bin),
f AS (SELECT id, string_agg(substr('0123456789abcdef', low + 1, 1), '' ORDER BY bin) AS fp FROM v GROUP BY id),
g AS (SELECT text, coalesce(fp, '') AS fp FROM t LEFT JOIN f ON t.id = f.id),
j AS (SELECT r.*, x.fp AS fingerprint, y.fp AS edited_fingerprint, z.fp AS next_fingerprint FROM r JOIN g x ON x.text = r.text JOIN g y ON y.text = r.edited LEFT JOIN g z ON z.text = r.next),
k AS (SELECT *, len(list_filter(range(1, 257), lambda i: fingerprint[i] = edited_fingerprint[i])) AS e, len(list_filter(range(1, 257), lambda i: fingerprint[i] = next_fingerprint[i])) AS x FROM j)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN fingerprint = '' AND edited_fingerprint = '' THEN 1 WHEN fingerprint = '' OR edited_fingerprint = '' THEN 0 ELSE greatest(0, (e / 256 - 0.0625::DOUBLE) / 0.9375::DOUBLE) END::DOUBLE AS near_edited,
  CASE WHEN next_fingerprint IS NULL THEN NULL WHEN fingerprint = '' AND next_fingerprint = '' THEN 1 WHEN fingerprint = '' OR next_fingerprint = '' THEN 0 ELSE greatest(0, (x / 256 - 0.0625::DOUBLE) / 0.9375::DOUBLE) END::DOUBLE AS near_next
FROM k
"""

_OP12 = f"""
WITH RECURSIVE c AS ({_CRC_TABLE}),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
g AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS x, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, n, {_CRC} AS h FROM g, c),
k AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM k WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
v AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (SELECT a.word, b.word AS near FROM v a JOIN v b ON a.i = b.i AND a.d = b.d WHERE a.word <> b.word
  UNION SELECT v.word, w.word FROM v JOIN w ON v.d = w.word UNION SELECT w.word, v.word FROM v JOIN w ON v.d = w.word),
b AS (SELECT e.word, count(*) AS n_near, max(w.n) AS best_n, arg_min(e.near, (-w.n, e.near)) AS best FROM e JOIN w ON e.near = w.word GROUP BY e.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form, CASE WHEN best_n >= 10 * w.n THEN best_n END::BIGINT AS form_n FROM w LEFT JOIN b ON w.word = b.word),
t AS (SELECT word, word AS here, 0 AS depth FROM f UNION ALL SELECT t.word, f.form, depth + 1 FROM t JOIN f ON t.here = f.word WHERE f.form IS NOT NULL),
z AS (SELECT word, arg_max(here, depth) AS root FROM t GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z ON f.word = z.word
"""

_OP13 = f"""
WITH c AS ({_CRC_TABLE}),
x AS (SELECT row_number() OVER () AS r, doc_id, text, FALSE AS target FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, TRUE FROM benchmark),
w AS (SELECT r, doc_id, target, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]'), lambda x: x <> '') AS w FROM x),
f AS (SELECT r, target, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS x FROM w),
b AS (SELECT x, {_CRC} % 10000 AS bucket FROM (SELECT DISTINCT x FROM f), c),
n AS (SELECT r, target, bucket, count(*) AS n FROM f JOIN b ON f.x = b.x GROUP BY ALL),
k AS (SELECT bucket, coalesce(sum(n) FILTER (NOT target), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (target), 0)::DOUBLE AS t FROM n GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM k),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM k, a),
d AS (SELECT r, sum(n) AS n, sum(n * gain) AS total FROM n JOIN g ON n.bucket = g.bucket WHERE NOT target GROUP BY r),
v AS (SELECT doc_id, len(w) AS words, coalesce(d.n, 0)::BIGINT AS n_features, coalesce(floor(total / d.n), 0)::BIGINT AS weight FROM w LEFT JOIN d ON w.r = d.r WHERE NOT target),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM v),
o AS (SELECT *, doc_id IS NOT NULL AND words >= 20 AS may FROM z),
p AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id, n_features, weight) AS place, count(*) FILTER (may) OVER () AS eligible FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= 25 * eligible // 100 THEN place END::BIGINT AS rank FROM p
"""

ORACLE_SQL: dict[str, str] = {"op4_chat": _OP4, "op8_topk": _OP8, "op9_repeats": _OP9, "op10_lines": _OP10, "op11_fingerprints": _OP11, "op12_variants": _OP12, "op13_resample": _OP13}
