"""Class files, layouts, graphs, baselines, reports and the command line."""

import gzip
import itertools
import json
import random
import re
import shutil
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestar import baseline, cli, report
from lodestar.functions import names
from lodestar.functions.catalog import CODES, explain
from lodestar.operators import duplicates, hierarchy, levels, reachability, results, services
from lodestar.plans.inspection import inspect, inspection
from lodestar.sources import archive, classfile, classpath, manifest, platform
from tests import javakit as k

java = pytest.mark.skipif(not shutil.which("javac"), reason="needs a JDK")


@java
def test_class_file_facts(tmp_path):
    source = """import java.util.function.*; public class All implements Runnable { static int s; int f; class Inner {}
    public void run() { int[][] a = new int[2][3]; Object o = new String[1]; if (o instanceof Integer) s = f; try { System.out.println((Long) o); } catch (IllegalStateException e) { f = 1; }
    Supplier<All> q = All::new; Runnable r = () -> run(); switch (s) { case 1: case 2: case 5000: f = 2; } Class<?> c = Byte[].class; long big = 1L << 40; double d = 2.5; } }"""
    out = k.compiled(tmp_path, {"All.java": source})
    f = classfile.parse((out / "All.class").read_bytes())
    assert (f.internal_name, f.super, f.interfaces, f.source_file, f.nest_members) == ("All", "java/lang/Object", ["java/lang/Runnable"], "All.java", ["All$Inner"])
    types = {t for t, m, _ in f.type_refs if m == "run()V"}
    assert {"java/lang/Integer", "java/lang/Long", "java/lang/IllegalStateException", "java/lang/String", "java/lang/Byte"} <= types
    assert f.type_refs[0][:2] == ("java/lang/IllegalStateException", "run()V")  # exception tables come first
    kinds = {(r[0], r[1], r[2]) for r in f.member_refs}
    assert {("PUT_STATIC", "All", "s"), ("GET_FIELD", "All", "f"), ("INVOKE_VIRTUAL", "java/io/PrintStream", "println"), ("METHOD_HANDLE", "All", "<init>"), ("METHOD_HANDLE", "java/lang/invoke/LambdaMetafactory", "metafactory")} <= kinds
    assert classfile.parse((out / "All$Inner.class").read_bytes()).nest_host == "All"
    assert classfile.version(b"\xca\xfe\xba\xbe\0\1\0\x37") == (55, 1) and classfile.version(b"\xca\xfe") is None
    with pytest.raises(classfile.MalformedClass):
        classfile.parse((out / "All.class").read_bytes()[:80])
    assert classfile.modified_utf8(b"a\xc0\x80\xed\xa0\xbd\xed\xb8\x80") == "a\0\U0001f600"


@java
def test_module_descriptor(tmp_path):
    out = k.compiled(tmp_path, {"module-info.java": "module m { requires java.logging; requires static java.sql; exports p; opens q; uses p.S; provides p.S with p.I; }", "p/S.java": "package p; public interface S {}", "p/I.java": "package p; public class I implements S {}", "q/Q.java": "package q; class Q {}"})
    m = classfile.parse((out / "module-info.class").read_bytes()).module
    assert m == {"module_name": "m", "required": ["java.base", "java.logging"], "compile_only": ["java.sql"], "exposed": ["p", "q"], "uses": ["p/S"], "provides": [{"service": "p/S", "providers": ["p/I"]}]}


def test_manifest_and_coordinates():
    main, sections = manifest.parse_manifest(b"Manifest-Version: 1.0\r\nClass-Path: a.jar b/\r\n c.jar\r\nSealed: TRUE\r\n\r\nName: p/q/\r\nSealed: true\r\n")
    assert manifest.class_path(main) == ["a.jar", "b/c.jar"] and manifest.sealed_packages(main, sections, {"x"}) == ["p/q", "x"]
    pom = manifest.properties(b"# c\ngroupId=g\nartifactId = a\nversion:1\n")
    assert manifest.coordinate([pom], {}) == {"group": "g", "artifact": "a", "version": "1"}
    assert manifest.coordinate([pom, pom], {"implementation-title": "t", "implementation-version": "2"}) == {"group": "", "artifact": "t", "version": "2"}
    assert manifest.package_of("A") is None and manifest.package_of("/A") is None


def test_multi_release_selection(spark):
    n = ["A.class", "META-INF/versions/9/A.class", "META-INF/versions/11/A.class", "META-INF/versions/21/A.class", "META-INF/versions/8/A.class", "META-INF/versions/x/B.class"]
    assert archive.selected(n, 17, True)["A.class"] == ("META-INF/versions/11/A.class", 11)
    assert archive.selected(n, 17, False) == {"A.class": ("A.class", 0)}
    assert [x["detail"] for x in archive.layout_notes(n, True)] == ["8", "x"] and len(archive.layout_notes(n, False)) == 5
    rows = [(0, "A", 0, "A"), (0, "A", 9, "9/A"), (0, "A", 18, "18/A"), (0, "B", 9, "z"), (0, "B", 9, "y")]
    got = levels.version_pick(spark.createDataFrame(rows, "position int, base_name string, version int, entry_name string"), 17).collect()
    assert {(r["base_name"], r["entry_name"]) for r in got} == {("A", "9/A"), ("B", "y")}


def test_budgets_refuse(tmp_path):
    b = archive.Budget(entries=2, class_bytes=100, ratio=5)
    many = k.jar(tmp_path / "many.jar", None, {f"{i}.class": b"x" for i in range(3)}).read_bytes()
    with pytest.raises(classpath.RefusedRun):
        archive.archive_contents("many", many, b)
    for raw in (b"A" * 101, b"A" * 99):
        c = archive.archive_contents("one", k.jar(tmp_path / "one.jar", None, {"A.class": raw}).read_bytes(), b)
        with pytest.raises(classpath.RefusedRun):
            c.read("A.class")
    with pytest.raises(classpath.RefusedRun):
        archive.archive_contents("cut", many[:40], b)


def test_classpath_order(tmp_path):
    lib = tmp_path / "lib"
    lib.mkdir()
    for n in ("b.jar", "a.JAR", "c.txt"):
        k.jar(lib / n, None, {"x": b""})
    k.jar(lib / "b.jar", None, {classpath.MANIFEST: "Class-Path: a.JAR gone.jar more/\n"})
    (lib / "more").mkdir()
    app = k.jar(tmp_path / "app.jar", None, {classpath.MANIFEST: "Class-Path: lib/b.jar\n"})
    e = classpath.expand([str(app)], [f"{lib}/*", str(app)])
    assert [(x["position"], x["path"].rsplit("/", 1)[1], x["origin"]) for x in e.entries] == [(0, "app.jar", "APPLICATION"), (1, "b.jar", "CLASSPATH"), (2, "a.JAR", "CLASSPATH"), (3, "", "CLASSPATH")]
    assert [m["named"] for m in e.missing] == ["gone.jar"]
    (tmp_path / "list").write_text(" x.jar \n\n y.jar\n")
    assert classpath.classpath_list(f"@{tmp_path}/list") == ["x.jar", "y.jar"]
    with pytest.raises(classpath.RefusedRun):
        classpath.expand([], [])


def test_hierarchies_with_cycles_and_gaps(spark):
    rows = [("A", "B", ["I", "J"]), ("B", "A", []), ("C", "Gone", ["K"]), ("I", "O", ["L"]), ("J", "O", ["L", "I"]), ("L", "O", []), ("O", None, [])]
    t = spark.createDataFrame(rows, "name string, super string, interfaces array<string>")
    w = spark.createDataFrame([("A",), ("C",), ("X",), (None,)], "name string")
    chain = hierarchy.superclass_chain(t, w)
    assert sorted(map(tuple, chain.collect())) == [("A", 0, "A"), ("A", 1, "B"), ("C", 0, "C")]
    closure = hierarchy.interface_closure(t, chain).orderBy("start", "generation", "key").collect()
    assert [(r["start"], r["name"]) for r in closure] == [("A", "I"), ("A", "J"), ("A", "L")]
    walk = {r["start"]: (r["names"], r["resolved"]) for r in hierarchy.supertype_walk(t, w).collect()}
    assert walk == {"A": (["A", "B", "I", "J", "L", "O"], True), "C": (["C", "Gone", "K"], False)}


def worklist(types, classes, member_refs, type_refs):
    """Rapid type analysis the plain way, over dicts."""

    def chain(n):
        out = []
        while n in types and n not in out:
            out.append(n)
            n = types[n]["super"]
        return out

    def names_of(n):
        out, queue = list(chain(n)), [i for c in chain(n) for i in types[c]["interfaces"]]
        seen = set()
        while queue:
            i = queue.pop(0)
            if i not in seen:
                seen.add(i)
                if i in types:
                    out.append(i)
                    queue += types[i]["interfaces"]
        return out

    def run(n, name, d):
        if n not in types:
            return None
        for c in names_of(n):
            if (name, d) in types[c]["members"]:
                return None if types[c]["platform"] else (c, name + d)
        return None

    reached, allocated, sites = set(), {c for c, o in classes.items() if o == "APPLICATION"}, set()
    pending = [(c, n + d) for c in allocated for n, d in types[c]["members"] if d.startswith("(")]
    silent = {(c, m) for c, m, t in type_refs if "java/lang/LinkageError" in chain(t)}

    def reach(x):
        if x and x not in reached:
            reached.add(x)
            pending.append(x)

    reached.update(pending)
    mine = {c for c in classes if not types[c]["platform"]}
    while pending:
        at = pending.pop()
        if at in silent:
            continue
        for c, m, kind, o, n, d in member_refs:
            if (c, m) != at:
                continue
            if kind in reachability.INITIALIZING and o in mine:
                for up in chain(o):
                    if ("<clinit>", "()V") in types[up]["members"] and not types[up]["platform"]:
                        reach((up, "<clinit>()V"))
            if n == "<init>" and o in mine and o not in allocated and not (m.startswith("<init>") and o in (c, types[c]["super"])):
                allocated.add(o)
                for up in chain(o):
                    if ("<clinit>", "()V") in types[up]["members"] and not types[up]["platform"]:
                        reach((up, "<clinit>()V"))
                for s in list(sites):
                    if s[0] in names_of(o):
                        reach(run(o, s[1], s[2]))
            if kind in reachability.DIRECT + reachability.DISPATCHED:
                reach(run(o, n, d))
            if kind in reachability.DISPATCHED:
                sites.add((o, n, d))
                for r in allocated:
                    if o in names_of(r):
                        reach(run(r, n, d))
    return reached


def test_reachability_equals_a_worklist(spark):
    rng = random.Random(4)
    for _ in range(2):
        names_ = [f"T{i}" for i in range(14)] + ["java/lang/LinkageError"]
        types = {}
        for i, n in enumerate(names_):
            members = {("<init>", "()V")} | {(f"m{rng.randrange(4)}", "()V") for _ in range(2)} | ({("<clinit>", "()V")} if rng.random() < 0.4 else set())
            types[n] = {"super": names_[rng.randrange(i)] if i and rng.random() < 0.6 else None, "interfaces": [], "members": members, "platform": n.startswith("java") or i == 3}
        classes = {n: "APPLICATION" if i in (7, 13) else "CLASSPATH" for i, n in enumerate(names_[:-1])}
        kinds = ["INVOKE_STATIC", "INVOKE_SPECIAL", "METHOD_HANDLE", "INVOKE_VIRTUAL", "INVOKE_INTERFACE", "GET_STATIC"]
        refs = [(c, n + d, rng.choice(kinds), rng.choice(names_[:-1]), rng.choice(["m0", "m1", "m2", "<init>"]), "()V") for c in classes for n, d in sorted(types[c]["members"]) for _ in range(2)]
        trefs = [("T7", "m0()V", "java/lang/LinkageError"), ("T5", "m1()V", "T1")]
        t = spark.createDataFrame([(n, x["platform"], x["super"], x["interfaces"], 1, [(a, b, 1) for a, b in sorted(x["members"])]) for n, x in types.items()], "name string, from_platform boolean, super string, interfaces array<string>, access int, members array<struct<name:string,descriptor:string,access:int>>")
        got = reachability.reachable_methods(t, spark.createDataFrame(list(classes.items()), "internal_name string, origin string"), spark.createDataFrame(refs, "internal_name string, method string, kind string, owner string, name string, descriptor string"), spark.createDataFrame(trefs, "internal_name string, method string, target string"))
        assert {(r["owner"], r["sig"]) for r in got.collect()} == worklist(types, classes, refs, trefs)


def test_provider_lines_and_names(spark):
    files = spark.createDataFrame([("f", "a.B # c\r\n x.Y\t\r#only\n\n a b "), ("g", None)], "file string, text string")
    assert [(r["line_number"], r["declared_name"]) for r in services.provider_lines(files).orderBy("line_number").collect()] == [(1, "a.B"), (2, "x.Y"), (5, "a b")]
    legal = spark.createDataFrame([("a.B",), ("9x",), ("a..b",), ("",), ("é.$_1",), ("a.",)], "n string").select(services.legal_name(F.col("n"))).collect()
    assert [r[0] for r in legal] == [True, False, False, False, True, False]


def test_scalar_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(names.readable_member(F.lit("com/a/B"), F.lit("m"), F.lit("(Ljava/lang/String;[[IJ)V"))) == "com.a.B.m(String, int[][], long)"
    assert value(names.readable_member(F.lit("com/a/B"), F.lit("f"), F.lit("I"))) == "com.a.B.f"
    assert value(names.markdown(F.lit("a*b_[c]<d>#`\\"))) == report.markdown("a*b_[c]<d>#`\\")
    assert value(names.quantity(F.lit(1), "class", "classes")) == "1 class" and value(names.package_of(F.lit("A"))) is None
    assert names.under_root("/r", "/r/a/../b.jar!/x/../y") == "b.jar!/x/../y" and names.under_root("/r", "/s/b.jar") == "/s/b.jar" and names.under_root(None, "x") == "x"
    assert names.respelled("aab ab", {"a": "1", "aa": "2", "b": "a"}) == "2a 1a" and names.respelled("x", {}) == "x" and names.respelled("abcd bcx", {"abx": "1", "bc": "2", "bcd": "3", "d": "4"}) == "a3 2x"


def test_report_rows_are_those_of_the_driver(spark, tmp_path):
    from lodestar import schema
    from lodestar.operators import report_rows

    at = lambda e, line: ("/r/a.jar", e, "A.java" if e else None, line)
    rows = [
        ("JP1003", "ERROR", "NoSuchMethodError", at("p/A.class", 3), "s#*", "Missing *method* é", "why", ["x", "reachable via: a -> b -> c"], ["fix"]),
        ("JP2003", "INFO", None, at(None, None), 'q"', "Split `p`\n", "because", [], []),
        ("JP2003", "WARNING", None, at("x", 1), "q", "Split", "because", ["only"], []),
    ]
    df = spark.createDataFrame(rows, schema.FINDING)
    found = [r.asDict(True) for r in df.collect()]
    assert sorted((json.loads(r["value"]) for r in report_rows.json_rows(df).collect()), key=str) == sorted(found, key=str)
    run = json.loads(report.sarif(found))["runs"][0]
    assert sorted((json.loads(r["value"]) for r in report_rows.sarif_rows(df).collect()), key=str) == sorted(run["results"], key=str)
    rules = [json.loads(r["value"]) for r in report_rows.sarif_rules(df, ["severity"]).orderBy("code").collect()]
    assert rules == run["tool"]["driver"]["rules"]
    report_rows.write_lines(report_rows.json_rows(df), ["code", "summary"], str(tmp_path / "out"))
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text(encoding="utf-8").splitlines()]
    assert [json.loads(x)["summary"] for x in lines] == ["Missing *method* é", "Split", "Split `p`\n"]


def test_paths_are_measured_alike_on_the_driver_and_in_tasks(spark):
    paths = ["/r/a/../b.jar!/x/../y", "/s/b.jar", "b.jar", "../c.jar", "../../../x", "", ".", "/", "/r", "/r/", "r/../..", "a/./b//c!/d!/e", "/../r/q", "é/日本.jar", None]
    for root, cwd in (("/r", "/r/w"), ("/", "/r"), ("w/..", "/r"), ("/r/w/v", "/r/w")):
        got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", names.measured(F.col("p"), root, cwd).alias("m")).collect()
        assert [r["m"] for r in got] == [None if p is None else names.under_root(root, p, cwd) for p in paths]
    told = lambda p, root="/r", cwd="/r/w": names.under_root(root, p, cwd)
    assert [told(p) for p in ("/r/a/../b.jar!/x/../y", "/s/./b.jar", "b.jar", "../c.jar", "../../../x", "", "/r")] == ["b.jar!/x/../y", "/s/b.jar", "w/b.jar", "c.jar", "../../../x", "", "/r"]


def test_respelling_in_tasks(spark):
    rng = random.Random(9)
    known = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))): f"<{k}>" for k in range(12)}
    plain = lambda t: re.sub("|".join(sorted(known, key=len, reverse=True)), lambda m: known[m[0]], t)
    texts = ["".join(rng.choice("abc ") for _ in range(40)) for _ in range(50)] + ["", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(names.Respelling(known).column(spark, F.col("t")).alias("r")).collect()
    assert [r["r"] for r in got] == [None if t is None else plain(t) for t in texts]
    assert names.suggestions("chek", ["check", "baseline", "cheks"]) == ["check", "cheks"]


def test_order_fingerprints_and_baselines(spark):
    loc = "struct<artifact:string,class_entry:string>"
    rows = [("JP1001", ("b", None), "s", "t", 2), ("JP1001", ("a", "e"), "s", "t", 1), ("JP1001", ("a", None), "s", "t", 0), ("JP1001", ("a", None), "s", "t", 3)]
    df = spark.createDataFrame(rows, f"code string, location {loc}, subject string, summary string, n int")
    orders = [[r["n"] for r in results.canonical_order(spark.createDataFrame(list(p), df.schema), "n").collect()] for p in itertools.islice(itertools.permutations(rows), 6)]
    assert set(map(tuple, orders)) == {(0, 3, 1, 2)}
    accepted = baseline.Baseline(17, "disabled", "application", "bundled:17", ("JP1001|a||s", "JP9|gone"))
    new, suppressed, stale = baseline.compare(df, accepted)
    assert (sorted(r["n"] for r in new.collect()), suppressed, stale) == ([1, 2], 2, ["JP9|gone"])
    assert baseline.parse(accepted.text()) == accepted and baseline.pruned(accepted, stale).fingerprints == ("JP1001|a||s",) and baseline.pruned(accepted, []) is None
    for bad in ("[]", "{", '{"version": "2"}', accepted.text().replace("17", "1.5"), accepted.text().replace('"JP9|gone"', "null")):
        with pytest.raises(ValueError):
            baseline.parse(bad)
    assert len(baseline.drift(accepted, baseline.Baseline(11, "enabled", "all", "x", ()))) == 4


def test_duplicates_of_hot_names(spark):
    rows = [(i, 0, "H", f"d{i % 2}", None, "p", f"x{i}") for i in range(50)] + [(3, 1, "S", "d", "w", None, "x3"), (4, 1, "S", "d", "w", None, "x4"), (5, 1, "U", "d", "w", None, "x5"), (6, 1, "U", "e", "w", None, "x6")]
    df = spark.createDataFrame(rows, "position int, ordinal int, internal_name string, digest string, wildcard_source string, package string, display string")
    assert {(r["internal_name"], r["verdict"], r["winner_position"]) for r in duplicates.duplicate_classes(df).collect()} == {("H", "differing", 0), ("S", "identical", 3), ("U", "unpredictable", 5)}
    assert duplicates.duplicate_classes(df.limit(0)).count() == 0 and duplicates.winners(df).count() == 3


def test_symbol_table_round_trip(spark, tmp_path):
    shape = {"internal_name": "java/lang/Object", "access": 33, "super": None, "interfaces": [], "nest_host": None, "nest_members": ["a", "b"], "members": [{"name": "m", "descriptor": "()V", "access": 1}]}
    path = str(tmp_path / "t.gz")
    platform.write_table(path, 17, "here", [("java.base", shape)])
    (row,) = platform.read_table(spark, path, 17).collect()
    assert row["module"] == "java.base" and row["shape"].asDict(True) == shape
    with pytest.raises(classpath.RefusedRun):
        platform.read_table(spark, path, 11)
    with gzip.open(path, "at") as f:
        f.write("one line too many\n")
    with pytest.raises(classpath.RefusedRun):
        platform.read_table(spark, path, 17)
    assert platform.release_code(8) == "8" and platform.release_code(17) == "H"


def test_inspection(tmp_path):
    j = k.jar(tmp_path / "x.jar", None, {"A.class": classfile.MAGIC + b"\0\0\0\x37", "B.class": b"bad", "lib/in.jar": b"", "META-INF/services/p.S": b"", "META-INF/versions/11/A.class": classfile.MAGIC + b"\0\0\0\x41"})
    facts = inspect(str(j))
    assert (facts["entry_count"], facts["class_count"], facts["nested_archive_count"], facts["bytecode_levels"], facts["declared_services"], facts["multi_release_versions"]) == (5, 3, 1, ["55:1", "65:1"], ["p.S"], [11])


def test_inspection_by_tasks(spark, tmp_path):
    j = k.jar(tmp_path / "x y+%.jar", None, {"A.class": classfile.MAGIC + b"\0\0\0\x37", "META-INF/versions/11/A.class": classfile.MAGIC + b"\0\0\0\x41", "B.class": b""})
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "C.class").write_bytes(classfile.MAGIC + b"\0\0\0\x3d" + b"x" * 100)
    (tmp_path / "bad.jar").write_bytes(b"no archive")
    paths = [str(j), str(tmp_path / "d"), str(tmp_path / "bad.jar"), str(j)]
    got = sorted((r.asDict() for r in inspection(spark, paths).collect()), key=lambda r: r["artifact"])
    assert [r["artifact"] for r in got] == sorted(paths)
    sound = [r for r in got if not r.pop("refusal")]
    assert sound == sorted((inspect(p) for p in paths if not p.endswith("bad.jar")), key=lambda r: r["artifact"]) and len(sound) == 3
    with pytest.raises(classpath.RefusedRun):
        inspect(str(tmp_path / "bad.jar"))
    with pytest.raises(classpath.RefusedRun):
        inspection(spark, [str(tmp_path / "none.jar")])


@pytest.mark.skipif(not shutil.which("javac"), reason="needs a JDK")
def test_symbols_of_a_release_are_found_in_their_folder(spark, tmp_path, capsys):
    home = str(Path(shutil.which("javac")).resolve().parent.parent)
    folder = tmp_path / "symbols"
    assert cli.main(["symbols", "--jdk", home, "--target-java", "11", "--out", str(folder)], spark=spark) == 0
    assert [p.name for p in folder.iterdir()] == ["11.gz"] and str(folder / "11.gz") in capsys.readouterr().err
    key = lambda df: df.selectExpr("internal_name", "module", "to_json(shape) AS shape")
    made, own = key(platform.platform_classes(spark, 11, table=str(folder))), key(platform.platform_classes(spark, 11, home))
    assert made.count() == own.count() > 1000 and made.exceptAll(own).isEmpty()
    with pytest.raises(classpath.RefusedRun):
        platform.platform_classes(spark, 17, table=str(folder))
    assert platform.profile_identity(11, None, str(folder)) == platform.profile_identity(11, None, str(folder / "11.gz"))


def test_reports_and_explanations():
    f = {"code": "JP1003", "severity": "ERROR", "predicted_error": "NoSuchMethodError", "location": {"artifact": "/r/a.jar", "class_entry": "p/A.class", "source_file": "A.java", "line": 3}, "subject": "s", "summary": "Missing *method*", "explanation": "e", "evidence": ["reachable via: a -> b"], "remediation": ["fix"]}
    text = report.human([f], 2, 1, 1, 1)
    assert text.splitlines()[0] == "ERROR JP1003 Missing *method*" and text.endswith("1 error, 0 warnings, 0 info — analyzed 2 classes across 1 artifact; 1 suppressed by the baseline; 1 stale baseline entry\n")
    assert report.human([], 1, 2).strip() == "no findings — analyzed 1 class across 2 artifacts"
    s = json.loads(report.sarif([f]))["runs"][0]
    assert s["results"][0]["codeFlows"] and s["results"][0]["level"] == "error" and s["results"][0]["message"]["markdown"] == "Missing \\*method\\*" and "region" not in s["results"][0]["locations"][0]["physicalLocation"]
    assert json.loads(report.as_json([f], {}, 1, 1))["summary"]["error"] == 1
    assert len(CODES) == 32 and "NoSuchMethodError" in explain("JP1003") and explain().count("\n") == 31


def test_command_line(capsys, tmp_path):
    j = k.jar(tmp_path / "x.jar", None, {"A": b""})
    assert cli.main(["inspect", str(j), "--format", "json", "--path-root", str(tmp_path)]) == 0 and json.loads(capsys.readouterr().out)["artifact"] == "x.jar"
    assert cli.main(["explain", "JP1001"]) == 0 and cli.main(["explain", "JP1O01"]) == 2 and "did you mean" in capsys.readouterr().err
    assert cli.main(["check"]) == 2 and cli.main(["nonsense"]) == 2 and cli.main(["check", "--application", str(j), "--target-java", "17", "--prune-stale"], spark=object()) == 2
    assert zipfile.is_zipfile(j)


def test_baselines_hold_strings_and_whole_numbers_only(tmp_path):
    sound = baseline.Baseline(17, "disabled", "all", "bundled:17", ("a",)).text()
    assert baseline.parse(sound.replace("{", '{"more": [1, {"x": "y"}],', 1)).fingerprints == ("a",)
    for more in ("true", "null", "[false]", "1.5", '{"x": null}'):
        with pytest.raises(ValueError):
            baseline.parse(sound.replace("{", f'{{"more": {more},', 1))
    for n, text in enumerate(("one", "two")):
        (tmp_path / f"{n}").write_text(text)
    names = {platform.profile_identity(17, None, str(tmp_path / n)) for n in ("0", "1")}
    assert len(names) == 2 and all(n.startswith("table:17:") for n in names) and platform.profile_identity(17) == "bundled:17"
