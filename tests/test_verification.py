"""Findings against what the JVM does with the same classes."""

import glob
import os
import shutil

import pytest

from lodestar.plans.verification import Request, verify
from lodestar.sources import platform
from lodestar.sources.classpath import RefusedRun
from tests import javakit as k

pytestmark = pytest.mark.skipif(not shutil.which("javac"), reason="needs a JDK")
HOME = os.environ.get("JAVA_HOME") or next(iter(sorted(glob.glob("/usr/lib/jvm/*/lib/ct.sym"))), "/x/lib/ct.sym")[: -len("/lib/ct.sym")]

# name: (library v1, library v2, consumer body, code, error)
PAIRS = {
    "method": ("public class Lib { public static String greet(String s) { return s; } }", "public class Lib { public static String other(String s) { return s; } }", "Lib.greet(\"x\");", "JP1003", "NoSuchMethodError"),
    "field": ("public class Lib { public static int limit = Integer.parseInt(\"3\"); }", "public class Lib { }", "System.out.println(Lib.limit);", "JP1002", "NoSuchFieldError"),
    "clazz": ("public class Lib { public Lib() {} }", "class Other { }", "new Lib();", "JP1001", "NoClassDefFoundError"),
    "flip": ("public class Lib { public static void run() {} }", "public class Lib { public void run() {} }", "Lib.run();", "JP1004", "IncompatibleClassChangeError"),
    "iface": ("public class Lib { public void run() {} public static Lib make() { return new Lib(); } }", "public interface Lib { default void run() {} static Lib make() { return new Lib() {}; } }", "Lib l = null; try { l = (Lib) Class.forName(\"Lib\").getMethod(\"make\").invoke(null); } catch (Exception e) { throw new RuntimeException(e); } l.run();", "JP1005", "IncompatibleClassChangeError"),
    "hidden": ("package lib; public class Lib { public static void run() {} }", "package lib; class Lib { public static void run() {} }", "lib.Lib.run();", "JP1006", "IllegalAccessError"),
    "private": ("package lib; public class Lib { public static void run() {} }", "package lib; public class Lib { private static void run() {} }", "lib.Lib.run();", "JP1007", "IllegalAccessError"),
    "lambda": ("public class Lib { public static void run() {} }", "public class Lib { }", "Runnable r = Lib::run; r.run();", "JP1003", "NoSuchMethodError"),
}


@pytest.fixture(scope="session")
def symbols(spark, tmp_path_factory):
    """The platform of one release as a text table, made once from ct.sym."""
    path = str(tmp_path_factory.mktemp("symbols") / "symbols.gz")
    rows = [(r["module"], r["shape"].asDict(True)) for r in platform.read_ct_sym(spark, f"{HOME}/lib/ct.sym", k.RELEASE).collect()]
    platform.write_table(path, k.RELEASE, "test", rows)
    return path


@pytest.fixture(scope="session")
def pairs(tmp_path_factory):
    """One application with all consumers, and both libraries."""
    top = tmp_path_factory.mktemp("pairs")
    app, old, new = {}, {}, {}
    for name, (v1, v2, body, *_) in PAIRS.items():
        lib = "Lib" + name.capitalize()
        swap = lambda s, lib=lib: s.replace("Lib", lib).replace("Other", lib + "Other")
        at = f"lib/{lib}.java" if v1.startswith("package") else f"{lib}.java"
        old[at], new[at] = swap(v1), swap(v2)
        app[f"Use{name.capitalize()}.java"] = f"public class Use{name.capitalize()} {{ public static void main(String[] a) {{ {swap(body)} }} }}"
    v1, v2 = k.compiled(top / "v1", old), k.compiled(top / "v2", new)
    a = k.compiled(top / "app", app, [v1])
    return k.jar(top / "app.jar", a), k.jar(top / "v1.jar", v1), k.jar(top / "v2.jar", v2)


def found(spark, symbols, applications, classpath=(), **more):
    r = verify(spark, Request(tuple(map(str, applications)), tuple(map(str, classpath)), release=k.RELEASE, symbol_table=symbols, **more))
    return r, r.findings.collect()


def test_breakages_are_what_the_jvm_throws(spark, symbols, pairs):
    app, v1, v2 = pairs
    _, rows = found(spark, symbols, [app], [v2])
    by = {r["location"]["class_entry"]: r for r in rows if r["code"].startswith("JP1")}
    for name, (_, _, _, code, error) in PAIRS.items():
        main = "Use" + name.capitalize()
        r = by[f"{main}.class"]
        assert (r["code"], r["predicted_error"], r["severity"]) == (code, error, "ERROR"), name
        assert r["location"]["line"] == 1 and r["location"]["source_file"] == f"{main}.java"
        assert k.thrown([app, v2], main) == error, name
        assert any(e.startswith("taken from ") and str(v2) in e for e in r["evidence"]) == (code != "JP1001"), name
        assert k.thrown([app, v1], main) is None, name
    _, quiet = found(spark, symbols, [app], [v1])
    assert [r["code"] for r in quiet] == []


def test_reachable_scope_keeps_application_breaks(spark, symbols, pairs):
    app, _, v2 = pairs
    _, rows = found(spark, symbols, [app], [v2], scope="REACHABLE")
    assert {r["code"] for r in rows if r["code"].startswith("JP1")} == {c for *_, c, _ in PAIRS.values()}
    assert all(any(e.startswith("reachable via: ") for e in r["evidence"]) for r in rows if r["code"].startswith("JP1"))


def test_chains_name_the_first_caller(spark, symbols, tmp_path):
    v1 = k.compiled(tmp_path / "v1", {"Lib.java": "public class Lib { public static void gone() {} }"})
    v2 = k.compiled(tmp_path / "v2", {"Lib.java": "public class Lib { }"})
    front = k.compiled(tmp_path / "front", {"Go.java": "public class Go { public static void go() { Mid2.live(); } }", "Mid2.java": "class Mid2 { static void live() { new Leaf().act(); } static void dead() { Lib.gone(); } }", "Stem.java": "abstract class Stem { abstract void act(); }", "Leaf.java": "class Leaf extends Stem { void act() { Lib.gone(); } }"}, [v1])
    start = k.compiled(tmp_path / "start", {"Start.java": "public class Start { public static void main(String[] a) { Go.go(); } }"}, [front])
    _, rows = found(spark, symbols, [start], [front, v2], scope="REACHABLE")
    (r,) = [x for x in rows if x["code"] == "JP1003"]
    assert r["location"]["class_entry"] == "Leaf.class" and r["severity"] == "ERROR"
    assert r["evidence"][1] == "reachable via: Start#main([Ljava/lang/String;)V -> Go#go()V -> Mid2#live()V -> Leaf#act()V"


def test_conflicts_services_and_layout(spark, symbols, tmp_path):
    one = k.compiled(tmp_path / "a", {"p/Twice.java": "package p; public class Twice { int a; }", "p/Same.java": "package p; public class Same {}", "p/Svc.java": "package p; public interface Svc {}", "p/Good.java": "package p; public class Good implements Svc {}", "p/Abs.java": "package p; public abstract class Abs implements Svc {}", "p/Wrong.java": "package p; public class Wrong {}"})
    two = k.compiled(tmp_path / "b", {"p/Twice.java": "package p; public class Twice { long b; }"})
    lines = "# comment\np.Good\n p.Missing # gone\np.Abs\np.Wrong\np.Good\n9bad\n"
    libs = tmp_path / "libs"
    libs.mkdir()
    manifest = "Manifest-Version: 1.0\nImplementation-Title: thing\nImplementation-Version: {}\nSealed: true\nClass-Path: nowhere.jar\nAutomatic-Module-Name: 1x\n\n"
    a = k.jar(libs / "a.jar", one, {"META-INF/MANIFEST.MF": manifest.format(1), "META-INF/services/p.Svc": lines, "META-INF/versions/9/p/Same.class": b"x", "p/Broken.class": b"\xca\xfe\xba\xbe\0\0\0\x37rubbish"})
    shutil.copy(one / "p/Same.class", two / "p/Same.class")
    b = k.jar(libs / "b.jar", two, {"META-INF/MANIFEST.MF": manifest.format(2)})
    empty = tmp_path / "empty"
    empty.mkdir()
    r, rows = found(spark, symbols, [empty], [a, b])
    got = sorted((x["code"], x["subject"]) for x in rows)
    assert got == sorted([
        ("JP2001", "p.Same"), ("JP2002", "p.Twice"), ("JP2003", "p"), ("JP2004", ":thing"), ("JP2007", "nowhere.jar"), ("JP2007", "nowhere.jar"), ("JP2008", "p"), ("JP2008", "p"),
        ("JP3003", "META-INF/versions/9"), ("JP3004", "p/Broken.class"), ("JP3007", str(empty)),
        ("JP4001", "p.Missing"), ("JP4002", "p.Wrong"), ("JP4003", "9bad"), ("JP4004", "p.Good"), ("JP4005", "p.Abs"), ("JP5005", "p"), ("JP5006", "1x"), ("JP5006", "1x"),
    ])
    assert r.analyzed_artifacts == 3
    _, wild = found(spark, symbols, [empty], [f"{libs}/*"])
    assert ("JP2006", "p.Twice") in {(x["code"], x["subject"]) for x in wild}
    assert [tuple(x) for x in wild] == sorted(wild, key=lambda x: (x["location"]["artifact"], x["code"], x["subject"], x["location"]["class_entry"] or "", x["summary"]))


def test_nested_application(spark, symbols, tmp_path, pairs):
    app, _, v2 = pairs
    import zipfile

    classes = {f"BOOT-INF/classes/{n}": zipfile.ZipFile(app).read(n) for n in zipfile.ZipFile(app).namelist()}
    boot = k.jar(tmp_path / "boot.jar", None, classes | {"BOOT-INF/lib/v2.jar": v2.read_bytes(), "BOOT-INF/classpath.idx": '- "BOOT-INF/lib/v2.jar"\n- "BOOT-INF/lib/none.jar"\n'}, stored=True)
    _, rows = found(spark, symbols, [boot])
    assert ("JP3006", "BOOT-INF/lib/none.jar") in {(r["code"], r["subject"]) for r in rows}
    assert {r["location"]["artifact"] for r in rows if r["code"] == "JP1003"} == {f"{boot}!/BOOT-INF/classes"}


def test_nested_index_lies_beside_the_libraries(tmp_path):
    from lodestar.sources.classpath import boot_layout, expand

    names = ["BOOT-INF/classes/A.class"]
    assert boot_layout({}, names) == {"classes": "BOOT-INF/classes/", "libraries": "BOOT-INF/lib/", "index": "BOOT-INF/classpath.idx"}
    assert boot_layout({"spring-boot-lib": "app/jars"}, names) == {"classes": "BOOT-INF/classes/", "libraries": "app/jars/", "index": "app/classpath.idx"}
    assert boot_layout({"spring-boot-classes": "c/", "spring-boot-lib": "l/"}, []) == {"classes": "c/", "libraries": "l/", "index": "classpath.idx"}
    assert boot_layout({"spring-boot-lib": "l/"}, ["A.class"]) is None
    inner = k.jar(tmp_path / "x.jar", None, {"X.class": b""}).read_bytes()
    manifest = "Spring-Boot-Classes: c/\nSpring-Boot-Lib: l/\n"
    app = k.jar(tmp_path / "app.jar", None, {"META-INF/MANIFEST.MF": manifest, "c/A.class": b"", "l/a.jar": inner, "l/b.jar": inner, "l/sub/c.jar": inner, "classpath.idx": '- "l/b.jar"\n'}, stored=True)
    assert [e["display"].removeprefix(str(app)) for e in expand([str(app)], []).entries] == ["!/c", "!/l/b.jar", "!/l/a.jar", ""]


def test_module_providers(spark, symbols, tmp_path):
    sources = {
        "module-info.java": "module m { exports p; provides p.S with p.Good, p.Made, p.Abs, p.Inst; }",
        "p/S.java": "package p; public interface S {}", "p/Good.java": "package p; public class Good implements S {}",
        "p/Made.java": "package p; public class Made { private Made() {} public static Good provider() { return new Good(); } }",
        "p/Abs.java": "package p; public abstract class Abs implements S { public static Good provider() { return null; } }",
        "p/Inst.java": "package p; public class Inst implements S { public Inst() {} }",
    }
    good = k.compiled(tmp_path / "good", sources)
    broken = k.compiled(tmp_path / "bad", {"p/Inst.java": "package p; class Inst { Inst(int x) {} public static Wrong provider() { return null; } }", "p/Wrong.java": "package p; public class Wrong {}"})
    shutil.copy(broken / "p/Inst.class", good / "p/Inst.class")
    shutil.copy(broken / "p/Wrong.class", good / "p/Wrong.class")
    (good / "p/Good.class").rename(tmp_path / "Good.class")
    _, rows = found(spark, symbols, [k.jar(tmp_path / "m.jar", good)])
    got = {r["subject"]: r["evidence"] for r in rows if r["code"] == "JP5003"}
    assert got == {"p.Good": ["outside the module"], "p.Made": ["another type"], "p.Inst": ["another type", "not public", "no public constructor without arguments"], "p.Abs": ["abstract"]}


def test_refused_runs(spark, symbols, tmp_path):
    with pytest.raises(RefusedRun):
        verify(spark, Request((str(tmp_path / "none.jar"),), release=k.RELEASE, symbol_table=symbols))
    (tmp_path / "bad.jar").write_bytes(b"no archive")
    with pytest.raises(RefusedRun):
        verify(spark, Request((str(tmp_path / "bad.jar"),), release=k.RELEASE, symbol_table=symbols))
    with pytest.raises(ValueError):
        Request(())
