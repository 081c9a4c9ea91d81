import json
import os

import pytest
from codemap_spark.plans import commands, output

yaml = pytest.importorskip("yaml")


def call(capsys, spark, root, *argv):
    code = commands.main(["--root", str(root), *argv], spark)
    return code, capsys.readouterr().out.strip()


def test_from_nothing_to_a_gate(spark, tmp_path, capsys):
    for k in range(3):
        (tmp_path / "lib" / "a").mkdir(parents=True, exist_ok=True)
        (tmp_path / "lib" / "a" / f"m{k}.py").write_text(f"def f{k}(): pass\n")
    assert json.loads(call(capsys, spark, tmp_path, "list")[1])["error"]["code"] == "E_MANIFEST_NOT_FOUND"
    assert json.loads(call(capsys, spark, tmp_path, "init", "--project", "p")[1])["written"]
    assert json.loads(call(capsys, spark, tmp_path, "discover")[1])["proposals"]["lib-a"]["exposes"][0]["name"] == "f0"
    assert json.loads(call(capsys, spark, tmp_path, "discover", "--apply")[1])["written"] == ["lib-a"]
    assert [r["subsystem"] for r in json.loads(call(capsys, spark, tmp_path, "list")[1])["rows"]] == ["lib-a"]
    code, text = call(capsys, spark, tmp_path, "--ci", "validate")
    assert code == 0 and text.startswith("ok\tfresh")
    assert json.loads(call(capsys, spark, tmp_path, "where", "f9")[1])["did_you_mean"] == []
    assert json.loads(call(capsys, spark, tmp_path, "edit", "lib-a", "--field", "role", "--value", '"library"')[1])["written"] == ["lib-a"]
    assert call(capsys, spark, tmp_path, "edit", "lib-a", "--field", "exposes", "--value", "[]")[0] == 2
    assert call(capsys, spark, tmp_path, "calibrate", "--dump-baseline")[0] == 0
    (tmp_path / "lib" / "a" / "new.py").write_text("def g(): pass\n")
    code, text = call(capsys, spark, tmp_path, "calibrate", "--check")
    assert code == 1 and "add_expose\\tg" in text
    assert json.loads(call(capsys, spark, tmp_path, "cache")[1])["written"] == ["4 files"]
    (tmp_path / "lib" / "a" / "new.py").unlink()
    assert json.loads(call(capsys, spark, tmp_path, "cache", "--prune")[1])["written"] == ["3 files"]
    assert {r["n"] for r in json.loads(call(capsys, spark, tmp_path, "cache", "--inspect")[1])["rows"]} == {3}
    assert [r["ok"] for r in json.loads(call(capsys, spark, tmp_path, "sdd", "doctor")[1])["rows"]] == [True, True, True]


def test_text_files_and_versions(tmp_path):
    (tmp_path / "AGENTS.md").write_text("# Mine\n")
    assert commands.agent_files(tmp_path, True)["written"] == ["AGENTS.md"] and commands.agent_files(tmp_path, True)["written"] == []
    assert (tmp_path / "AGENTS.md").read_text().startswith("# Mine\n\n<!-- codemap -->")
    assert commands.ci_files(tmp_path, True)["written"] and not commands.ci_files(tmp_path, True)["written"]
    assert "preflight" in yaml.safe_load(commands.WORKFLOW)["jobs"]
    assert commands.newer(["0.1.0", "v9.0", "9.0rc1"]) == "v9.0" and commands.newer(["0.0.1", "x"]) is None


def test_hook_reads_one_event_and_notes_once(tmp_path, monkeypatch):
    monkeypatch.setenv("CODEMAP_HOOK_DIR", str(tmp_path / "marks"))
    r, w = os.pipe()
    os.write(w, b'  {"prompt": "where is the parser?", "session_id": "s"} trailing')
    with os.fdopen(r) as stream:  # the writing end stays open
        event = commands.read_event(stream, 1.0)
        assert commands.read_event(stream, 0.05) == {}
    os.close(w)
    assert event["session_id"] == "s" and commands.hook(event, tmp_path)["text"] and commands.hook(event, tmp_path) == {} and commands.hook({"prompt": "hello"}, tmp_path) == {}


def test_renderers():
    doc = {"status": "stale", "mode": "full", "ok": False, "issues": [{"severity": "error", "code": "E", "subsystem": None, "message": "m\tn"}, {"severity": "info", "code": "F", "subsystem": "s", "message": "x", "suppressed": True}], "next_steps": ["do"]}
    assert output.emit(doc, "ci") == "error\tE\t-\tm n" and output.emit({"status": "fresh", "issues": []}, "ci") == "ok\tfresh"
    assert "next: do" in output.emit(doc, "human") and list(json.loads(output.emit(doc)))[0] == "status"
    assert output.human({"rows": [{"a": 1, "b": "xy"}]}).splitlines() == ["a  b", "1  xy"] and output.human({"rows": []}) == "nothing"
    assert output.ci({"error": {"code": "E_USAGE", "message": "no"}}) == "fatal\tE_USAGE\tno" and output.human({"own": 1}) == "own: 1"
