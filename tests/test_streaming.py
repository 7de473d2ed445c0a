import json

from lodestar.streaming.watch import counts_of, watch_findings


def test_new_findings_are_counted(spark, tmp_path):
    folder, seen = tmp_path / "in", {}
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps({"code": "JP1001", "severity": s}) for s in ("ERROR", "INFO")) + "\nnot json\n")
    for name in ("b", "c"):
        watch_findings(spark, str(folder), str(tmp_path / "cp"), counts_of(seen), once=True).awaitTermination()
        (folder / f"{name}.json").write_text(json.dumps({"code": "JP1002", "severity": "WARNING"}) + "\n")
    assert [seen[k] for k in sorted(seen)] == [{"info": 1, "warning": 0, "error": 1, "total": 2}, {"info": 0, "warning": 1, "error": 0, "total": 1}]
