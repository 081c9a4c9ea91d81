from pathlib import Path

import pytest
from codemap_spark.plans.project import Project
from codemap_spark.sources import manifests

yaml = pytest.importorskip("yaml")


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    r = tmp_path_factory.mktemp("repo")

    def put(path, text):
        (r / path).parent.mkdir(parents=True, exist_ok=True)
        (r / path).write_text(text)

    put(".codemap/root.yaml", "project: demo\nsubsystems: [models, svc, gone]\n")
    put(".codemap/subsystems/models.yaml", "role: library\ncriticality: core\npaths: [src/models]\nexposes: [Thing, Lost]\nconsumes: [{subsystem: svc}]\n")
    put(".codemap/subsystems/svc.yaml", "role: servic\npaths: [src/svc]\nconsumes: [{subsystem: models, interfaces: [Thing, Ghost]}]\n")
    put(".codemap/policy.yaml", "suppress:\n - {code: E_UNOWNED_FILE, message_contains: stray}\n")
    put("src/models/thing.py", "class Thing: pass\ndef secret(): pass\n")
    put("src/svc/main.py", "from ..models.thing import Thing, secret\n")
    put("stray.py", "x = 1\n")
    put("build/out.py", "y = 1\n")
    put("gen/skip.py", "z = 1\n")
    put(".gitignore", "# made\ngen/\n")
    return r


def test_validate(spark, root):
    got = {(r.code, r.severity, r.subsystem, r.message, r.suppressed) for r in Project(spark, str(root)).validate().collect()}
    assert ("E_STRUCTURAL_DRIFT", "error", "models", "declared but not found: Lost", False) in got
    assert ("E_STRUCTURAL_DRIFT", "info", "models", "not declared: secret", False) in got
    assert ("E_BOUNDARY_VIOLATION", "error", "svc", "src/svc/main.py imports secret of models", False) in got
    assert ("E_CONTRACT_MISSING_EXPORT", "error", "svc", "Ghost is not exposed by models", False) in got
    assert ("E_CYCLE_DETECTED", "error", "models", "models -> svc -> models", False) in got
    assert ("E_ORPHAN_EXPORT", "warning", "models", "nobody consumes Lost", False) in got
    assert ("E_UNOWNED_FILE", "info", None, "stray.py", True) in got
    assert ("E_SUBSYSTEM_NOT_FOUND", "error", "gone", "no manifest of this name", False) in got
    assert any(c == "E_SCHEMA_INVALID" and "did you mean service" in m for c, _, _, m, _ in got)


def test_every_check_of_the_modes(spark, tmp_path):
    def put(path, text):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)

    put(".codemap/root.yaml", "project: demo\nsubsystems: [a, b, c]\n")
    put(".codemap/subsystems/a.yaml", "paths: [db, go]\n")
    put(".codemap/subsystems/b.yaml", "paths: [both]\n")
    put(".codemap/subsystems/c.yaml", "paths: [both]\n")
    put("db/first.sql", "CREATE TABLE t (x int);\nCREATE FOREIGN TABLE 9 (y int);\n")
    put("db/second.sql", "ALTER TABLE t ADD COLUMN z int;\n")
    put("db/hidden.sql", "-- revision: 7\nCREATE TABLE 9 (y int);\n")
    put("db/s.prisma", "model User {\n id Int @id\n kind Role\n Boss Role\n}\n")
    put("both/x.py", "y = 1\n")
    put("both/bad.py", "def (\n")
    put("go/m.go", "package m\n")
    put("dark/n.rs", "fn f() {}\n")
    put("stray.py", "x = 1\n")
    Project(spark, str(tmp_path)).confirm_surface()
    put("go/m.go", "package n\n")
    p = Project(spark, str(tmp_path))
    got = {(r.code, r.subsystem, r.message) for r in p.validate().collect()}
    assert ("E_SCHEMA_UNPARSED", "a", "1 statements that could not be read in db/first.sql") in got
    assert ("E_SCHEMA_NO_ORDER", "a") in {g[:2] for g in got}
    assert ("E_ADAPTER_CONTRACT", "a", "relations as columns of User: Boss") in got
    assert ("E_SUBSYSTEM_OVERLAP", "b", "2 files are claimed alike by b,c") in got
    assert {g[1] for g in got if g[0] == "E_EXTRACTION_FAILED"} == {"a", "b"}
    assert ("E_COVERAGE_GAP", None, "1 supported and 1 other files in no subsystem: dark/n.rs, stray.py") in got
    assert ("E_UNSUPPORTED_SURFACE_STALE", "a", "1 files changed since their exposes were confirmed: go/m.go") in got
    assert {"E_SCHEMA_UNPARSED", "E_SCHEMA_NO_ORDER", "E_ADAPTER_CONTRACT"} <= {r.code for r in p.validate("quick").collect()}
    assert [(r.subsystem, r.tbl, r.columns) for r in p.tables().where("tbl = 't'").collect()] == [("a", "t", ["x", "z"])]


def test_accepted_cycles_do_not_hide_new_ones(spark, tmp_path):
    names = [f"{s}{k:02}" for k in range(12) for s in "ab"]
    (tmp_path / ".codemap" / "subsystems").mkdir(parents=True)
    (tmp_path / ".codemap" / "root.yaml").write_text(f"project: demo\nsubsystems: [{', '.join(names)}]\n")
    for n in names:
        (tmp_path / ".codemap" / "subsystems" / f"{n}.yaml").write_text(f"paths: [src/{n}]\nconsumes: [{'ba'[n[0] == 'b'] + n[1:]}]\n")
    manifests.write_keys(tmp_path / ".codemap" / "baseline" / "cycles.json", {(f"a{k:02}", f"b{k:02}") for k in range(11)})
    got = {(r.severity, r.subsystem, r.message) for r in Project(spark, str(tmp_path)).cycle().collect()}
    assert got == {("error", "a11", "a11 -> b11 -> a11"), ("info", None, "11 known cycles accepted by the baseline")}


def test_commands(spark, root):
    p = Project(spark, str(root))
    assert [(r.name, r.verified) for r in p.describe("models").collect()] == [("Lost", False), ("Thing", True)]
    assert [(r.consumer, r.direct) for r in p.impact("models").collect()] == [("svc", True)]
    assert [(r.path, r.kind) for r in p.where("Thing").collect()] == [("src/models/thing.py", "class")]
    assert {(r.subsystem, r.change, r.target) for r in p.calibrate().collect()} == {("models", "remove_expose", "Lost"), ("models", "add_expose", "secret"), ("models", "remove_consume_edge", "svc"), ("svc", "remove_consume_interface", "models")}
    assert p.preflight().first().blocked and p.undeclared_consumers().collect() == []
    assert {(r.path, r.change) for r in p.changes(p.state()).collect()} == {(f, "hit") for f in ("src/models/thing.py", "src/svc/main.py", "stray.py")}


def test_ignore_globs():
    import re

    def hit(pattern, path):
        return bool(re.search(manifests.glob_regex(pattern), path))

    assert hit("gen/", "a/gen/x.py") and not hit("gen/", "gen") and hit("*.min.js", "a/b.min.js") and hit("/a/**/z.py", "a/b/c/z.py") and not hit("a/b", "c/a/b")


def test_baseline_keys_and_roots(tmp_path, root):
    manifests.write_keys(tmp_path / "b.json", {("a", "b"), ("c",)})
    assert manifests.read_keys(tmp_path / "b.json") == {("a", "b"), ("c",)} and manifests.read_keys(tmp_path / "none.json") is None
    assert manifests.find_root(str(root / "src" / "svc")) == Path(root).resolve()
    assert manifests.one_edit("servic", "service") and not manifests.one_edit("abc", "cba")


@pytest.fixture
def mapped(tmp_path):
    def put(path, text):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)

    put(".codemap/root.yaml", "project: demo\nsubsystems: [api, db, ui]\ncriticality: {deep: -1}\n")
    put(".codemap/subsystems/api.yaml", "paths: [api]\ncriticality: deep\nexposes: [Api, gone]\nconsumes: [{subsystem: db, interfaces: [users, users.email, users.none]}, {subsystem: ghost}]\n")
    put(".codemap/subsystems/db.yaml", "paths: [db]\nexposes: [users, posts]\ntests: [checks/db]\n")
    put(".codemap/subsystems/ui.yaml", "paths: [ui]\nconsumes: [api]\n")
    put("tsconfig.json", '{"compilerOptions": {"baseUrl": ".", "paths": {"@api/*": ["api/*"]}}}')
    put("api/main.ts", "@Controller()\nexport class Api {}\nexport const fresh = 1;\nconst q = 'SELECT * FROM users JOIN posts';\n")
    put("ui/app.ts", "import { fresh } from '@api/main';\nexport const page = 1;\n")
    put("db/1_a.sql", "CREATE TABLE users (id int, email text);\nCREATE TABLE old (x int);\n")
    put("db/2_b.sql", "DROP TABLE old;\nCREATE TABLE extra (x int);\n")
    put("checks/db/test_x.py", "def test_one(): pass\n")
    put("tests/test_api.py", "from api import main\n")
    put("lib/util/a.py", "from lib.other import b0\ndef go(): pass\n")
    for k in range(3):
        put(f"lib/util/m{k}.py", f"def f{k}(): pass\n")
        put(f"lib/other/b{k}.py", f"class C{k}: pass\n")
    put("vite.config.ts", "export default {};\n")
    return tmp_path


def test_schema_and_alias_checks(spark, mapped):
    p = Project(spark, str(mapped))
    got = {(r.code, r.severity, r.subsystem, r.message) for r in p.validate().collect()}
    drift = {m for c, s, _, m in got if c == "E_STRUCTURAL_DRIFT" and s == "error"}
    assert drift == {"declared but not found: gone", "declared but not found: posts"}  # a folded table is no drift
    assert ("E_STRUCTURAL_DRIFT", "info", "db", "not declared: extra") in got
    assert ("E_CONTRACT_MISSING_EXPORT", "error", "api", "users.none is not exposed by db") in got and not any("users.email" in g[3] for g in got)
    assert ("E_BOUNDARY_VIOLATION", "error", "ui", "ui/app.ts imports fresh of api") in got
    assert ("E_UNRESOLVED_REFERENCE", "warning", "api", "unknown provider ghost") in got
    assert {r.consumer: r.n_files for r in p.verify_impact().collect()} == {}
    assert [(r.subsystem, r.via) for r in p.raw_consumers("posts").collect()] == [("api", "reads")]
    r = p.report("full")
    assert r["status"] == "stale" and not r["ok"] and r["stats"]["E_STRUCTURAL_DRIFT"] == 4 and r["next_steps"]


def test_impact_where_and_links(spark, mapped):
    p = Project(spark, str(mapped))
    assert [tuple(r) for r in p.impact("db").collect()] == [("api", True), ("ui", False)]
    assert [tuple(r) for r in p.impact("users").collect()] == [("api", True), ("ui", False)]
    assert {r.name for r in p.where("api/main.ts").collect()} == {"Api", "fresh", "q"}
    near, subs = p.suggest("ap")
    assert [r.name for r in near.collect()] == ["Api"] and [r.subsystem for r in subs.collect()] == ["api"]
    assert {(r.path, r.owner) for r in p.linked("tests").collect()} == {("checks/db/test_x.py", "db"), ("tests/test_api.py", "api")}
    assert {(r.subsystem, r.kind, r.n) for r in p.schema_catalog().collect()} == {("db", "table", 2)}
    assert p.why_path("vite.config.ts").first().status == "algorithm_miss" and p.why_path("nope.py").first().status == "not_found"
    assert {(r.consumer) for r in p.cross_impact(["db/1_a.sql"]).select("subsystem").withColumnRenamed("subsystem", "consumer").collect()} == set()


def test_calibration_is_applied(spark, mapped):
    p = Project(spark, str(mapped))
    p.dump_baselines()
    assert p.drift_gate().collect() == []
    assert set(p.apply_calibration(prune_unknown=True)) == {"api", "db", "ui"}
    again = Project(spark, str(mapped))
    assert {(r.subsystem, r.change, r.target) for r in again.calibrate().collect()} == set()
    assert {r.status for r in again.drift_gate().collect()} == {"resolved"}
    assert again.fix_coverage() == ["vite.config.ts"] and again.fix_coverage(apply=True) == ["vite.config.ts"] and Project(spark, str(mapped)).fix_coverage() == []


def test_discovery_is_applied(spark, mapped):
    p = Project(spark, str(mapped))
    assert [(r.folder, r.n, r.confidence) for r in p.discover().collect()] == [("lib/other", 3, "medium"), ("lib/util", 4, "medium")]
    assert p.apply_discovery(namespace="core") == ["lib-other", "lib-util"] and p.apply_discovery() == []
    d = manifests.load(mapped)
    assert {s[0] for s in d.subsystems} == {"api", "db", "ui", "lib-other", "lib-util"} and ("lib-other", "C0", "class", None, False) in d.exposes and d.issues == []
    assert Project(spark, str(mapped)).discover(merges=[("all", "lib")]).collect() == []


def test_manifests_of_wrong_shape_are_findings(tmp_path):
    (tmp_path / ".codemap" / "subsystems").mkdir(parents=True)
    (tmp_path / ".codemap" / "root.yaml").write_text("enforce: maybe\nroles: [a]\ncriticality: {x: many}\nsubsystems: [a, b, '../c']\n")
    (tmp_path / ".codemap" / "subsystems" / "a.yaml").write_text("exposes: [3, {kind: x}]\nconsumes: {a: 1}\npaths: 7\n")
    (tmp_path / ".codemap" / "subsystems" / "b.yaml").write_text("- 1\n")
    d = manifests.load(tmp_path)
    codes = [(i[0], i[2]) for i in d.issues]
    assert codes.count(("E_SCHEMA_INVALID", None)) == 3 and codes.count(("E_SCHEMA_INVALID", "a")) == 4 and ("E_SCHEMA_INVALID", "b") in codes and ("E_SUBSYSTEM_NOT_FOUND", "../c") in codes


def test_writers_and_git(tmp_path):
    import subprocess

    assert manifests.init(tmp_path, "p") == [".codemap/root.yaml", ".codemap/.gitignore"] and manifests.init(tmp_path) == []
    assert manifests.add_subsystem(tmp_path, "a", {"paths": ["a"]}) and not manifests.add_subsystem(tmp_path, "a", {})
    manifests.edit(tmp_path, "a", "role", "library")
    assert manifests.load(tmp_path).subsystems[0][:2] == ("a", "library")
    with pytest.raises(ValueError):
        manifests.edit(tmp_path, "a", "exposes", [])
    assert manifests.append_ignore(tmp_path, ["b", "a"]) == ["a", "b"] and manifests.append_ignore(tmp_path, ["a"]) == [] and manifests.ignore_lines(tmp_path) == ["a", "b"]
    assert not manifests.is_git_repo(tmp_path) and manifests.gitignored(tmp_path, ["a"]) == set()
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / ".gitignore").write_text("*.log\n!keep.log\n")
    assert manifests.is_git_repo(tmp_path) and manifests.gitignored(tmp_path, ["x.log", "é.log", "y"]) == {"x.log", "é.log"} and manifests.negations(tmp_path) == ["!keep.log"]
    (tmp_path / "out").symlink_to("/tmp")
    (tmp_path / "in").symlink_to(tmp_path / ".codemap")
    assert manifests.external_symlinks(tmp_path) == ["out"] and "out" in manifests.changed_files(tmp_path)
