"""Splitting, orders and budgets of archives, and manifests and properties as Java reads them."""

import zipfile

import pytest

from lodestar.sources import archive, classpath, generate
from lodestar.sources.budget import Budget, RefusedRun
from lodestar.sources.manifest import parse_manifest, properties, sealed_packages


def jar(path, classes=300, sealed=True):
    entries = {classpath.MANIFEST: b"Manifest-Version: 1.0\nMulti-Release: true\n" + b"Sealed: true\n" * sealed + b"\n"}
    for k in range(classes):
        entries[f"p{k % 7}/C{k}.class"] = b"broken" if k % 50 == 3 else generate.class_file(f"p{k % 7}/C{k}", "java/lang/Object", 1, 52, members=(("m", "()V", 1),))
    entries["META-INF/versions/9/p1/C1.class"] = generate.class_file("p1/C1", "java/lang/Object", 1, 53)
    entries["META-INF/services/p0.S"] = b"p1.C1\n"
    path.write_bytes(generate.archive(entries))
    return str(path)


def facts(spark, path):
    found = classpath.expand([path], [])
    rows = archive.scan_entries(spark, found.entries, 17)
    return rows, sorted((r.asDict(True) for r in rows.where("row <> 'part'").drop("expanded").collect()), key=lambda r: (r["position"], r["row"], r["ordinal"] or 0))


def test_a_split_archive_gives_the_same_facts(spark, tmp_path, monkeypatch):
    path = jar(tmp_path / "big.jar")
    whole_rows, whole = facts(spark, path)
    monkeypatch.setattr(archive, "SPLIT", 20_000)
    parts_rows, parts = facts(spark, path)
    assert parts == whole and len(whole) == 301 and [r["ordinal"] for r in whole if r["row"] == "class"] == list(range(300))
    assert parts_rows.where("row = 'part'").count() == archive.parts_of(classpath.expand([path], []).entries[0]) - 1 > 1
    assert parts_rows.agg({"expanded": "sum"}).first()[0] >= whole_rows.agg({"expanded": "sum"}).first()[0]
    archive.refuse(parts_rows)
    with pytest.raises(RefusedRun, match="expands to more"):
        archive.refuse(parts_rows, Budget(expanded_bytes=1000))


def application(path, libraries, index, deflated=()):
    entries = {"BOOT-INF/classes/A.class": generate.class_file("A", "java/lang/Object", 1, 52), "BOOT-INF/classpath.idx": index.encode()}
    entries |= {f"BOOT-INF/lib/{n}": raw for n, raw in libraries.items()}
    path.write_bytes(generate.archive(entries, deflated))
    return str(path)


def test_index_names_count_as_they_are_written_and_once(tmp_path):
    lib = generate.archive({"K.class": generate.class_file("K", "java/lang/Object", 1, 52)})
    path = application(tmp_path / "app.jar", {"a1.jar": lib, "a2.jar": lib, "a3.jar": lib}, '- "a3.jar"\n- "BOOT-INF/lib/a2.jar"\n- BOOT-INF/lib/a2.jar\n- none\n')
    found = classpath.expand([path], [])
    assert [e["nested"]["path"] for e in found.entries if e["kind"] == "NESTED_ARCHIVE"] == [f"BOOT-INF/lib/{n}.jar" for n in ("a2", "a1", "a3")]
    assert [(x["kind"], x["detail"]) for x in found.layout] == [("absent", "a3.jar"), ("absent", "BOOT-INF/lib/a2.jar"), ("absent", "none")]


def test_libraries_are_checked_before_they_are_unzipped_and_are_summed(spark, tmp_path):
    lib = generate.archive({"K.class": generate.class_file("K", "java/lang/Object", 1, 52), "pad": b"\0" * 2_000_000})
    path = application(tmp_path / "bomb.jar", {"b.jar": lib}, "", ("BOOT-INF/lib/b.jar",))
    with pytest.raises(RefusedRun, match="expands more than"):
        classpath.expand([path], [])
    stored = application(tmp_path / "app.jar", {"b.jar": lib}, "")
    with pytest.raises(RefusedRun, match="larger than"):
        classpath.expand([stored], [], Budget(nested_bytes=1_000_000))
    found = classpath.expand([stored], [])
    assert found.declared > 2_000_000
    rows = archive.scan_entries(spark, found.entries, 17)
    assert rows.where("position = 1").agg({"expanded": "sum"}).first()[0] > 2_000_000
    with zipfile.ZipFile(stored) as z:
        assert z.getinfo("BOOT-INF/lib/b.jar").file_size == len(lib)


def test_properties_and_manifests_are_read_as_java_does():
    raw = b"a\\:b=c\nartifactId x\nv = 1.\\\n   2\\\\\n# no\n\n!no\nk\nu\\u0041:\\tz\\n\r\nx=1\rx=2\nend\\"
    assert properties(raw) == {"a:b": "c", "artifactId": "x", "v": "1.2\\", "k": "", "uA": "\tz\n", "x": "2", "end": ""}
    assert properties(b"") == {}
    main, sections = parse_manifest("Sealed: false\r\nSealed: true\r\nLong: ab\xc3\r\n \xa9\r\n\r\nName: p/\r\nX: y\r\n\r\nName: p/\r\nSealed: true\r\n".encode("latin-1"))
    assert main == {"sealed": "true", "long": "abé"} and sections == {"p/": {"x": "y", "sealed": "true"}} and sealed_packages(main, sections, {"q"}) == ["p", "q"]
