"""The registered queries of the engine's relational operators over the bridged tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import bridge as b
from lodestar.functions import names as fn
from lodestar.operators import duplicates, hierarchy, levels, linkage, modules, reachability, results, services

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# The bridge in SQL.
_ENTRIES = """entries AS (SELECT s_suppkey::INT AS position, s_name AS display, CASE WHEN s_suppkey % 10 = 0 THEN 'APPLICATION' ELSE 'CLASSPATH' END AS origin,
  CASE WHEN s_suppkey % 3 = 0 THEN 'w' || (s_suppkey % 2) END AS wildcard_source FROM supplier)"""
_CLASSES = _ENTRIES + """, g AS (SELECT l_suppkey, l_partkey, p_size, p_brand, max(l_linenumber) AS line, min(l_returnflag || l_linestatus) AS kind
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 45 GROUP BY ALL),
d AS (SELECT l_suppkey::INT AS position, l_partkey::INT AS ordinal, CASE WHEN p_size = 1 THEN NULL ELSE 'p/' || replace(p_brand, '#', '') END AS package, sha256(CASE WHEN l_partkey % 4 = 0 THEN p_brand ELSE kind END) AS digest,
  (52 + line)::INT AS major, (CASE WHEN l_partkey % 17 = 0 THEN 65535 ELSE 0 END)::INT AS minor, l_partkey AS part FROM g),
classes AS (SELECT d.*, coalesce(package || '/', '') || 'C' || part AS internal_name, display, origin, wildcard_source FROM d JOIN entries USING (position))"""
_TYPES = """types AS (SELECT 'C' || p_partkey AS name, CASE WHEN p_partkey >= 3 THEN 'C' || (p_partkey // 3) END AS super,
  CASE WHEN p_partkey % 4 = 0 THEN ['C' || (p_partkey // 2), 'C' || (p_partkey // 5 + 1)] ELSE []::VARCHAR[] END AS interfaces,
  (CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE 1 END) + (CASE WHEN p_partkey % 11 = 0 THEN 512 ELSE 0 END) AS access,
  (CASE p_partkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 0 ELSE 1 END) + (CASE WHEN p_partkey % 2 = 0 THEN 8 ELSE 0 END) AS member_access, p_partkey % 13 = 0 AS from_platform,
  CASE WHEN p_partkey % 9 = 0 THEN 'C' || (p_partkey + 1) END AS nest_host, CASE WHEN p_partkey % 9 = 1 THEN 'C' || (p_partkey - 1) END AS nest_member,
  'm' || (p_partkey % 7) AS m, 'f' || (p_partkey % 4) AS f FROM part WHERE p_size <= 45)"""
_WANTED = "wanted AS (SELECT 'C' || p_partkey AS name FROM part)"
_EDGES = """edges AS (SELECT DISTINCT a.l_partkey AS src, z.l_partkey AS dst FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R') a
  JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R') z ON a.l_orderkey = z.l_orderkey AND a.l_linenumber = z.l_linenumber - 1)"""
_FINDINGS = """findings AS (SELECT 'JP100' || (event_id % 7 + 1) AS code, ['INFO', 'WARNING', 'ERROR'][user_id % 3 + 1] AS severity, 'lib' || (user_id % 20) || '.jar' AS artifact,
  CASE WHEN user_id % 5 <> 0 THEN 'E' || (user_id % 50) END AS class_entry, event_type AS subject, event_type || ' ' || event_id AS summary, (event_id % 100)::INT AS position, event_id AS ordinal, value FROM events),
printed AS (SELECT *, code || '|' || artifact || '|' || coalesce(class_entry, '') || '|' || subject AS fingerprint FROM findings),
accepted AS (SELECT DISTINCT fingerprint FROM printed WHERE value > (SELECT avg(value) FROM events) * 1.5 UNION SELECT 'gone|' || fingerprint FROM printed WHERE value < (SELECT avg(value) FROM events) * 0.01)"""


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {_CLASSES} SELECT internal_name, position, ordinal, digest FROM classes QUALIFY row_number() OVER (PARTITION BY internal_name ORDER BY position, ordinal) = 1")
def winner_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.winners(b.classes(spark, sf_dir).select("internal_name", "position", "ordinal", "digest"))


_DUPLICATES = f"""WITH {_CLASSES}, w AS (SELECT * FROM classes QUALIFY row_number() OVER (PARTITION BY internal_name ORDER BY position, ordinal) = 1),
n AS (SELECT internal_name, count(*) AS claims, count(DISTINCT digest) AS kinds FROM classes GROUP BY 1 HAVING count(*) > 1)
SELECT n.internal_name, n.claims, w.position AS winner_position, w.ordinal AS winner_ordinal FROM n JOIN w USING (internal_name)
WHERE CASE WHEN kinds = 1 THEN 'identical' WHEN EXISTS (SELECT 1 FROM classes c WHERE c.internal_name = n.internal_name AND c.wildcard_source = w.wildcard_source AND c.digest <> w.digest) THEN 'unpredictable' ELSE 'differing' END = """


def _duplicates(spark: SparkSession, sf_dir: str, verdict: str) -> DataFrame:
    return duplicates.duplicate_classes(b.classes(spark, sf_dir)).where(F.col("verdict") == verdict).drop("verdict")


@query(_DUPLICATES + "'identical'")
def duplicate_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _duplicates(spark, sf_dir, "identical")


@query(_DUPLICATES + "'differing'")
def duplicate_differing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _duplicates(spark, sf_dir, "differing")


@query(_DUPLICATES + "'unpredictable'")
def duplicate_unpredictable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _duplicates(spark, sf_dir, "unpredictable")


@query(f"WITH {_CLASSES} SELECT package, count(DISTINCT display) AS artifacts, min(position) AS first_position FROM classes WHERE package IS NOT NULL GROUP BY 1 HAVING count(DISTINCT display) > 1")
def split_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.split_packages(b.classes(spark, sf_dir))


@query(f"""WITH {_CLASSES}, k AS (SELECT package, count(DISTINCT display) AS artifacts FROM classes WHERE package IS NOT NULL GROUP BY 1 HAVING count(DISTINCT display) > 1)
SELECT DISTINCT package, display, artifacts FROM classes JOIN k USING (package) WHERE position IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def sealed_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.sealed_violations(b.classes(spark, sf_dir), b.sealed(spark, sf_dir))


@query(f"""WITH {_ENTRIES}, c AS (SELECT position, display, (CASE WHEN position % 4 = 0 THEN '' ELSE 'g' END) || ':a' || (position % 40) AS identity, '1.' || (position % 3) AS version FROM entries),
f AS (SELECT identity, version, arg_min(display, position) AS display, min(position) AS position FROM c GROUP BY 1, 2)
SELECT identity, min(position) AS position, count(*) AS n, string_agg(version || '@' || display, ',' ORDER BY version) AS versions FROM f GROUP BY 1 HAVING count(*) > 1""")
def version_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = duplicates.version_conflicts(b.coordinates(spark, sf_dir))
    return out.withColumn("versions", F.array_join(F.transform("versions", lambda v: F.concat_ws("@", v["version"], v["display"])), ","))


@query(f"WITH {_CLASSES} SELECT position, internal_name, major FROM classes WHERE major > 56")
def newer_than_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.newer_than_target(b.classes(spark, sf_dir), b.TARGET).select("position", "internal_name", "major")


@query(f"WITH {_CLASSES} SELECT position, internal_name, major FROM classes WHERE minor = 65535 AND major <> 56")
def invalid_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.invalid_preview(b.classes(spark, sf_dir), b.TARGET, True).select("position", "internal_name", "major")


@query("""WITH s AS (SELECT l_orderkey::INT AS position, (52 + l_linenumber)::INT AS major, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT position, string_agg(major || ':' || n, ',' ORDER BY major) AS levels FROM s GROUP BY 1 HAVING count(*) > 1""")
def mixed_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = levels.mixed_levels(b.order_levels(spark, sf_dir))
    return out.select("position", F.array_join(F.transform("levels", lambda x: F.concat_ws(":", x["major"].cast("string"), x["n"].cast("string"))), ",").alias("levels"))


@query("SELECT c_custkey::INT AS position, c_name AS display FROM customer WHERE c_acctbal >= 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def empty_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.empty_roots(*b.roots(spark, sf_dir)).select("position", "display")


@query("""WITH v AS (SELECT DISTINCT l_suppkey::INT AS position, 'C' || l_partkey AS base_name, (CASE WHEN l_linenumber = 1 THEN 0 ELSE l_linenumber + 7 END)::INT AS version, l_partkey FROM lineitem)
SELECT position, base_name, version, 'v' || version || '/C' || l_partkey AS entry_name FROM v WHERE version = 0 OR version BETWEEN 9 AND 12 QUALIFY row_number() OVER (PARTITION BY position, base_name ORDER BY version DESC) = 1""")
def multi_release_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.version_pick(b.versions(spark, sf_dir), b.TARGET)


@query(f"""WITH RECURSIVE {_TYPES}, {_WANTED}, c AS (SELECT name AS start, 0 AS depth, name, super FROM wanted JOIN types USING (name)
  UNION ALL SELECT c.start, c.depth + 1, t.name, t.super FROM c JOIN types t ON t.name = c.super) SELECT start, depth, name FROM c""")
def superclass_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.superclass_chain(b.types(spark, sf_dir), b.wanted_types(spark, sf_dir))


@query(f"""WITH RECURSIVE {_TYPES}, {_WANTED}, c AS (SELECT name AS start, name, super FROM wanted JOIN types USING (name) UNION ALL SELECT c.start, t.name, t.super FROM c JOIN types t ON t.name = c.super),
i AS (SELECT start, unnest(interfaces) AS name FROM c JOIN types USING (name) UNION SELECT i.start, unnest(t.interfaces) FROM i JOIN types t ON t.name = i.name)
SELECT start, count(*) AS interfaces, string_agg(name, ',' ORDER BY name) AS names FROM i JOIN (SELECT name FROM types) USING (name) GROUP BY 1""")
def interface_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = b.types(spark, sf_dir)
    closure = hierarchy.interface_closure(t, hierarchy.superclass_chain(t, b.wanted_types(spark, sf_dir)))
    return closure.groupBy("start").agg(F.count("*").alias("interfaces"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


@query(f"""WITH RECURSIVE {_TYPES}, {_WANTED}, w AS (SELECT name AS start, name FROM wanted JOIN types USING (name)
  UNION SELECT start, unnest(list_append(interfaces, super)) AS name FROM w JOIN types USING (name)),
k AS (SELECT start, name FROM w WHERE name IS NOT NULL)
SELECT start, string_agg(name, ',' ORDER BY name) AS names, bool_and(name IN (SELECT name FROM types)) AS resolved FROM k GROUP BY 1""")
def supertype_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = hierarchy.supertype_walk(b.types(spark, sf_dir), b.wanted_types(spark, sf_dir))
    return w.select("start", F.array_join("names", ",").alias("names"), "resolved")


@query("""WITH p AS (SELECT l_partkey AS part FROM lineitem)
SELECT 'C' || part AS target, count(*) AS refs FROM p JOIN part ON part = p_partkey WHERE p_size > 45 GROUP BY 1""")
def missing_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = b.table(spark, sf_dir, "lineitem").select("l_partkey")
    refs = li.select(F.lit("C0").alias("caller"), F.concat(F.lit("C"), F.col("l_partkey").cast("string")).alias("target"))
    none = spark.createDataFrame([], "name string")
    out = linkage.type_verdicts(b.types(spark, sf_dir), none, refs).where("code = 'JP1001'")
    return out.groupBy("target").agg(F.count("*").alias("refs"))


_KINDS = "['INVOKE_VIRTUAL', 'INVOKE_STATIC', 'INVOKE_INTERFACE', 'GET_STATIC', 'GET_FIELD', 'METHOD_HANDLE'][l_orderkey % 6 + 1]"
_REFS = f"""r0 AS (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem),
r AS (SELECT l_orderkey || '-' || l_partkey || '-' || l_linenumber AS ref, l_partkey % 97 + 1 AS k, 'C' || (l_partkey % 97 + 1) AS caller, {_KINDS} AS kind, 'C' || l_partkey AS owner,
  CASE WHEN {_KINDS} IN ('GET_STATIC', 'GET_FIELD') THEN 'f' ELSE 'm' END || (l_orderkey % 3) AS name, {_KINDS} NOT IN ('GET_STATIC', 'GET_FIELD') AS method FROM r0)"""
_RESOLVED = f"""WITH RECURSIVE {_TYPES}, {_REFS}, o AS (SELECT DISTINCT owner FROM r JOIN types ON owner = types.name),
c AS (SELECT owner AS start, 0 AS depth, owner AS name FROM o UNION ALL SELECT start, depth + 1, p.name FROM c JOIN types t ON t.name = c.name JOIN types p ON p.name = t.super),
x AS (SELECT name AS sub, unnest(interfaces) AS name, generate_subscripts(interfaces, 1) AS n FROM types),
i AS (SELECT start, 0 AS generation, [depth, x.n] AS key, x.name FROM c JOIN x ON x.sub = c.name
  UNION ALL SELECT i.start, generation + 1, list_append(key, x.n), x.name FROM i JOIN x ON x.sub = i.name WHERE generation < 16),
f AS (SELECT start, name, min({{'g': generation, 'k': key}}) AS place FROM i JOIN (SELECT name FROM types) t USING (name) GROUP BY 1, 2),
a AS (SELECT start, 0 AS phase, 0 AS g, [depth] AS key, name FROM c UNION ALL SELECT start, 1, place.g, place.k, name FROM f),
q AS (SELECT DISTINCT owner, name, method FROM r),
h AS (SELECT q.owner, q.name, q.method, a.name AS declarer, t.member_access, row_number() OVER (PARTITION BY q.owner, q.name, q.method ORDER BY a.phase, a.g, a.key) AS n
  FROM q JOIN a ON a.start = q.owner JOIN types t ON t.name = a.name AND q.name = CASE WHEN q.method THEN t.m ELSE t.f END JOIN types o ON o.name = q.owner
  WHERE NOT (q.method AND o.access >= 512) OR a.phase = 1 OR a.name = q.owner),
best AS (SELECT * FROM h WHERE n = 1)"""


@query(_RESOLVED + " SELECT owner, name, declarer, member_access::INT AS member_access FROM best")
def member_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.resolve_members(b.types(spark, sf_dir), b.member_refs(spark, sf_dir)).select("owner", "name", "declarer", "member_access")


@query(_RESOLVED + """, host AS (SELECT t.name, CASE WHEN h.nest_member = t.name THEN t.nest_host ELSE t.name END AS host FROM types t LEFT JOIN types h ON h.name = t.nest_host),
up AS (SELECT name AS start, name FROM types UNION SELECT up.start, t2.name FROM up JOIN types t ON t.name = up.name JOIN types t2 ON t2.name = t.super),
j AS (SELECT r.*, o.name IS NOT NULL AS known, o.access, o.from_platform, best.declarer, best.member_access AS ma, host.host,
  EXISTS (SELECT 1 FROM up WHERE up.start = 'C' || (k // 3) AND up.name = best.declarer) AS above
  FROM r LEFT JOIN types o ON o.name = r.owner LEFT JOIN best ON best.owner = r.owner AND best.name = r.name AND best.method = r.method LEFT JOIN host ON host.name = best.declarer),
v AS (SELECT ref, CASE WHEN NOT known THEN 'JP1001' WHEN access & 1 = 0 AND from_platform THEN 'JP1006'
  WHEN CASE WHEN kind = 'INVOKE_INTERFACE' THEN access & 512 = 0 ELSE kind = 'INVOKE_VIRTUAL' AND access & 512 <> 0 END THEN 'JP1005'
  WHEN declarer IS NULL THEN CASE WHEN method THEN 'JP1003' ELSE 'JP1002' END
  WHEN kind <> 'METHOD_HANDLE' AND (ma & 8 <> 0) <> (kind IN ('GET_STATIC', 'INVOKE_STATIC')) THEN 'JP1004'
  WHEN ma & 2 <> 0 AND host <> caller THEN 'JP1007' END AS code FROM j)
SELECT ref, code FROM v WHERE code IS NOT NULL""")
def first_failure_per_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "name string")
    return linkage.member_verdicts(b.types(spark, sf_dir), none, b.member_refs(spark, sf_dir, by_owner=True), b.member_refs(spark, sf_dir)).where("code is not null").select("ref", "code")


@query(_RESOLVED + " SELECT owner, name, count(*) AS refs FROM r WHERE EXISTS (SELECT 1 FROM types WHERE types.name = r.owner) AND NOT EXISTS (SELECT 1 FROM best WHERE best.owner = r.owner AND best.name = r.name AND best.method = r.method) GROUP BY 1, 2")
def missing_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, refs = b.types(spark, sf_dir), b.member_refs(spark, sf_dir)
    found = linkage.resolve_members(t, refs)
    known = refs.join(t.select(F.col("name").alias("owner")), "owner", "left_semi")
    return known.join(found, ["owner", "name", "descriptor"], "left_anti").groupBy("owner", "name").agg(F.count("*").alias("refs"))


@query(f"WITH RECURSIVE {_EDGES}, s AS (SELECT p_partkey AS node FROM part WHERE p_size >= 40 UNION SELECT dst FROM s JOIN edges ON src = node) SELECT node FROM s")
def reachable_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = b.table(spark, sf_dir, "part").where("p_size >= 40").select(F.col("p_partkey").alias("node"))
    return reachability.closure_from(b.call_edges(spark, sf_dir), roots)


@query("""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), 1) AS line_number FROM documents),
n AS (SELECT doc_id, line_number::INT AS line_number, regexp_replace(string_split(line, '#')[1], '^\\s+|\\s+$', '', 'g') AS declared_name FROM l)
SELECT doc_id, line_number, declared_name FROM n WHERE declared_name <> ''""")
def service_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.provider_lines(b.table(spark, sf_dir, "documents").select("doc_id", "text"))


_LINES = """l AS (SELECT DISTINCT o_orderkey AS file, o_custkey % 50 AS svc, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
s AS (SELECT file, 'C' || (svc + 1) AS service, 'C' || l_partkey AS provider FROM l)"""


def _service_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = b.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = o.join(b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select(F.col("o_orderkey").alias("file"), F.concat(F.lit("C"), (F.col("o_custkey") % 50 + 1).cast("string")).alias("service_name"), F.concat(F.lit("C"), F.col("l_partkey").cast("string")).alias("declared_name")).distinct()


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = b.types(spark, sf_dir)
    return services.provider_verdicts(t, t.select("name"), _service_lines(spark, sf_dir))


@query(f"WITH {_TYPES}, {_LINES} SELECT file, service, provider FROM s WHERE provider NOT IN (SELECT name FROM types)")
def service_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).where("missing").select("file", "service", "provider")


@query(f"""WITH RECURSIVE {_TYPES}, {_LINES}, w AS (SELECT DISTINCT provider AS start, provider AS name FROM s JOIN types ON provider = types.name
  UNION SELECT start, unnest(list_append(interfaces, super)) AS name FROM w JOIN types USING (name)),
k AS (SELECT start, bool_and(name IN (SELECT name FROM types)) AS resolved, list(name) AS names FROM w WHERE name IS NOT NULL GROUP BY 1)
SELECT file, service, provider FROM s JOIN k ON start = provider WHERE resolved AND service IN (SELECT name FROM types) AND NOT list_contains(names, service)""")
def service_wrong_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).where("wrong_type").select("file", "service", "provider")


@query(f"""WITH {_TYPES}, {_LINES} SELECT file, service, provider, CASE WHEN access & 512 <> 0 THEN 'an interface' WHEN access & 1 = 0 THEN 'not public,no public constructor without arguments' ELSE 'no public constructor without arguments' END AS faults FROM s JOIN types ON name = provider""")
def service_not_instantiable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).where(F.size("faults") > 0).select("file", "service", "provider", F.array_join("faults", ",").alias("faults"))


@query("""WITH l AS (SELECT o_custkey, 'x.' || replace(replace(p_type, ' ', '_'), '-', '_') AS declared_name, o_orderkey::INT AS line_number FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey)
SELECT o_custkey, declared_name, count(*) AS times, min(line_number) AS line_number FROM l GROUP BY 1, 2 HAVING count(*) > 1""")
def service_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = b.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    j = o.join(b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey")).join(b.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lines = j.select("o_custkey", F.concat(F.lit("x."), F.translate("p_type", " -", "__")).alias("declared_name"), F.col("o_orderkey").cast("int").alias("line_number"))
    return services.repeated_lines(lines, ["o_custkey"])


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second supplier is a module that requires two others, exposes a package and uses a service; some have automatic names."""
    e = b.entries(spark, sf_dir)
    p, name = F.col("position"), lambda c: F.concat(F.lit("mod"), c.cast("string"))
    d = F.struct(
        name(p).alias("module_name"), F.array(name(p + 1), name(p * 2), F.lit("java.base"), F.lit("java.sql")).alias("required"), F.array(F.concat(F.lit("p/Brand"), (p % 30).cast("string"))).alias("exposed"), F.array(F.concat(F.lit("C"), p.cast("string"))).alias("uses"),
    )
    return e.select("position", "display", F.when(p % 2 == 0, d).alias("descriptor"), F.when(p % 4 == 1, F.when(p % 8 == 1, name(p)).otherwise(F.concat(F.lit("9mod"), p.cast("string")))).alias("automatic_name"))


_CLAIMS = """claims AS (SELECT *, position % 2 = 0 AS module, CASE WHEN position % 4 = 1 THEN CASE WHEN position % 8 = 1 THEN 'mod' ELSE '9mod' END || position END AS automatic_name FROM entries)"""


@query(f"""WITH {_ENTRIES}, {_CLAIMS}, known AS (SELECT 'mod' || position AS required FROM claims WHERE module OR position % 8 = 1 UNION SELECT 'java.sql'),
asked AS (SELECT position, 'mod' || position AS module, unnest(['mod' || (position + 1), 'mod' || (position * 2), 'java.sql']) AS required FROM claims WHERE module)
SELECT DISTINCT position, module, required FROM asked WHERE required NOT IN (SELECT required FROM known)""")
def module_requires_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    platform = spark.createDataFrame([("java.sql",)], "module string")
    return modules.missing_requirements(_claims(spark, sf_dir), platform).select("position", "module", "required")


@query(f"""WITH {_CLASSES}, {_CLAIMS} SELECT position, 'mod' || position AS module, 'p/Brand' || (position % 30) AS package FROM claims k WHERE module
AND NOT EXISTS (SELECT 1 FROM classes c WHERE c.position = k.position AND c.package = 'p/Brand' || (k.position % 30))""")
def module_empty_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.empty_exposed(_claims(spark, sf_dir), b.classes(spark, sf_dir)).select("position", "module", "package")


@query(f"WITH {_CLASSES}, {_CLAIMS} SELECT package, count(DISTINCT position) AS modules, min(position) AS position FROM classes JOIN claims USING (position) WHERE package IS NOT NULL AND (module OR automatic_name IS NOT NULL) GROUP BY 1 HAVING count(DISTINCT position) > 1")
def module_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.module_splits(_claims(spark, sf_dir), b.classes(spark, sf_dir))


@query(f"WITH {_TYPES}, {_ENTRIES}, {_CLAIMS} SELECT position, 'mod' || position AS module, 'C' || position AS service FROM claims WHERE module AND 'C' || position NOT IN (SELECT name FROM types)")
def module_uses_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.missing_services(_claims(spark, sf_dir), b.types(spark, sf_dir)).select("position", "module", "service")


@query(f"WITH {_ENTRIES}, {_CLAIMS} SELECT position, automatic_name FROM claims WHERE automatic_name LIKE '9%'")
def module_illegal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.illegal_automatic_names(_claims(spark, sf_dir)).select("position", "automatic_name")


def _findings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = b.findings(spark, sf_dir)
    f = f.withColumn("fingerprint", results.fingerprint(F.col("code"), F.col("artifact"), F.col("class_entry"), F.col("subject")))
    mean = f.agg(F.avg("value").alias("mean"))
    valued = f.crossJoin(F.broadcast(mean))  # one row
    gone = valued.where("value < mean * 0.01").select(F.concat(F.lit("gone|"), "fingerprint").alias("fingerprint"))
    return f, valued.where("value > mean * 1.5").select("fingerprint").union(gone).distinct()


@query(f"WITH {_FINDINGS} SELECT code, artifact, class_entry, subject, summary, ordinal FROM findings QUALIFY row_number() OVER (PARTITION BY code, subject, artifact, class_entry ORDER BY position, ordinal) = 1")
def finding_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, _ = _findings(spark, sf_dir)
    return duplicates.first_by(f.select("code", "subject", "artifact", "class_entry", "summary", "position", "ordinal"), ["code", "subject", "artifact", "class_entry"], ["position", "ordinal"]).drop("position")


@query(f"WITH {_FINDINGS} SELECT fingerprint, ordinal FROM printed WHERE fingerprint NOT IN (SELECT fingerprint FROM accepted)")
def baseline_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.new_findings(*_findings(spark, sf_dir)).select("fingerprint", "ordinal")


@query(f"WITH {_FINDINGS} SELECT fingerprint, ordinal FROM printed WHERE fingerprint IN (SELECT fingerprint FROM accepted)")
def baseline_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.suppressed_findings(*_findings(spark, sf_dir)).select("fingerprint", "ordinal")


@query(f"WITH {_FINDINGS} SELECT fingerprint FROM accepted WHERE fingerprint NOT IN (SELECT fingerprint FROM printed)")
def baseline_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.stale_fingerprints(*_findings(spark, sf_dir))


@query(f"WITH {_FINDINGS} SELECT artifact, code, subject, class_entry, summary, row_number() OVER (ORDER BY artifact, code, subject, coalesce(class_entry, ''), summary, ordinal) AS place FROM findings")
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = b.findings(spark, sf_dir)
    f = f.withColumn("location", F.struct("artifact", "class_entry"))
    return results.placed(f, "ordinal").select("artifact", "code", "subject", "class_entry", "summary", "place")


@query(f"WITH {_FINDINGS} SELECT count(*) FILTER (severity = 'INFO') AS info, count(*) FILTER (severity = 'WARNING') AS warning, count(*) FILTER (severity = 'ERROR') AS error, count(*) AS total FROM findings")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.severity_counts(b.findings(spark, sf_dir))


@query(f"""WITH {_CLASSES}, h AS (SELECT position, major, count(*) AS n FROM classes GROUP BY 1, 2)
SELECT position, sum(n)::BIGINT AS class_count, string_agg(major || ':' || n, ',' ORDER BY major) AS bytecode_levels FROM h GROUP BY 1""")
def inspect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.plans.inspection import level_histogram

    return level_histogram(b.classes(spark, sf_dir))


@query("""WITH w AS (SELECT DISTINCT p_name AS word FROM part), v AS (SELECT DISTINCT p_name AS name FROM part),
p AS (SELECT word, name AS suggestion, levenshtein(word, name)::INT AS distance FROM w JOIN v ON levenshtein(word, name) BETWEEN 1 AND 2)
SELECT word, suggestion, distance, row_number() OVER (PARTITION BY word ORDER BY distance, suggestion)::INT AS rank FROM p QUALIFY rank <= 2""")
def spelling_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.table(spark, sf_dir, "part")
    return fn.spelling_suggestions(p.select(F.col("p_name").alias("word")), p.select(F.col("p_name").alias("name")))


@query(f"""WITH {_CLASSES} SELECT DISTINCT internal_name, package, replace(internal_name, '/', '.') AS binary_name, major - 44 AS release, internal_name || ' ' || CASE WHEN ordinal % 3 = 1 THEN '1 class' ELSE (ordinal % 3) || ' classes' END AS counted,
replace(internal_name, '/', '.') || '.m(String, int[])' AS readable FROM classes""")
def scalar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = b.classes(spark, sf_dir)
    n = F.col("internal_name")
    counted = F.concat_ws(" ", n, fn.quantity(F.col("ordinal") % 3, "class", "classes"))
    return c.select("internal_name", fn.package_of(n).alias("package"), fn.binary_name(n).alias("binary_name"), fn.release_of(F.col("major")).alias("release"), counted.alias("counted"), fn.readable_member(n, F.lit("m"), F.lit("(Ljava/lang/String;[I)V")).alias("readable")).distinct()
