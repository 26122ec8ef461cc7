"""Folders, files and projects are found without opening what is not wanted."""

import pytest

from tallyflow.sources import discover, jsonl


def put(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def test_folders(spark, tmp_path):
    (tmp_path / "a/projects").mkdir(parents=True)
    (tmp_path / "b").mkdir()
    (tmp_path / "c/projects").mkdir(parents=True)
    (tmp_path / "f").write_text("a file")
    a, b, c, f = (f"{tmp_path}/{x}" for x in "abcf")
    assert discover.folders(spark, f" {a}/ ,, {c}/projects,{a}, {b},{f}", [], "projects") == [a, c]
    assert discover.folders(spark, None, [b, c, f"{tmp_path}/none"], "projects") == [c]
    assert discover.folders(spark, None, [f], "") == []
    with pytest.raises(ValueError, match="no folder"):
        discover.folders(spark, f"{b},", [a], "projects")


def test_overlapping_homes_count_once(spark, tmp_path):
    put(tmp_path / "live/x y/one.jsonl", "a", "b")
    put(tmp_path / "live/two.jsonl", "c")
    put(tmp_path / "archive/x y/one.jsonl", "old", "old", "old")
    put(tmp_path / "archive/three.jsonl", "d")
    put(tmp_path / "other/two.jsonl", "e")
    put(tmp_path / "other/two.txt", "no log")
    sources = [("home", f"{tmp_path}/live"), ("home", f"{tmp_path}/archive/"), ("else", f"{tmp_path}/other")]
    got = {(r["source"], r["home"], r["relative"].replace("%20", " ")) for r in discover.listing(spark, sources).collect()}
    assert got == {(0, "home", "x y/one.jsonl"), (0, "home", "two.jsonl"), (1, "home", "three.jsonl"), (2, "else", "two.jsonl")}
    assert sorted(r["line"] for r in discover.source_lines(spark, sources).collect()) == ["a", "b", "c", "d", "e"]
    assert discover.has_data(spark, f"{tmp_path}/other") and discover.has_data(spark, f"{tmp_path}/live")
    assert not discover.has_data(spark, f"{tmp_path}/other", "*.json") and not discover.has_data(spark, f"{tmp_path}/nowhere")
    plan = discover.listing(spark, sources)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_a_project_is_read_alone(spark, tmp_path):
    usage = '{"timestamp":"2026-03-01T10:00:00.000Z","message":{"id":"%s","model":"m","usage":{"input_tokens":1,"output_tokens":1}}}'
    for project, session in (("alpha", "s1"), ("alpha", "s2"), ("beta", "s1"), ("alphabet", "s3")):
        put(tmp_path / f"projects/{project}/{session}/chat.jsonl", usage % f"{project}-{session}")
    for path in (tmp_path, tmp_path / "projects"):
        rows = jsonl.claude(spark, str(path), project="alpha")
        assert sorted(r["message_id"] for r in rows.collect()) == ["alpha-s1", "alpha-s2"]
        assert len(set(rows.inputFiles())) == 2
        whole = jsonl.claude(spark, str(path)).where("project = 'alpha'")
        assert sorted(map(str, whole.collect())) == sorted(map(str, rows.collect()))
    assert jsonl.claude(spark, str(tmp_path), project="gamma").collect() == []
