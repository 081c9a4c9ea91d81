from codemap_spark.functions import paths as P
from codemap_spark.operators import calibrate, checks, fold, graph, imports, incremental, ownership
from codemap_spark.sources import extract
from pyspark.sql import functions as F


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_back_edge_cycles_of_a_hub():
    g = {"god": [f"a{i}" for i in range(10)], **{f"a{i}": [f"b{j}" for j in range(10)] for i in range(10)}, **{f"b{j}": ["god"] for j in range(10)}}
    found = graph.back_edge_cycles(g)
    assert len(found) == 19 and all(len(c) == 3 for c in found)
    cuts = graph.greedy_cuts(found)
    assert cuts and not [c for c in found if not ({(a, b) for a, b in zip(c, c[1:] + c[:1])} & {(a, b) for a, b, _ in cuts})]


def test_cycles_and_rotation():
    assert graph.back_edge_cycles({"a": ["b"], "b": ["a"]}) == [["a", "b"]]
    assert graph.back_edge_cycles({"a": ["b"]}) == []


def test_closure_and_propagation(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3)], "u long, v long")
    assert (1, 1) in rows(graph.transitive_closure(spark, e)) and len(rows(graph.transitive_closure(spark, e))) == 12
    n = spark.createDataFrame([(1, "core"), (2, "connector"), (3, "leaf"), (4, "leaf")], "id long, criticality string")
    assert rows(graph.propagate(spark, e, n, spark.createDataFrame([(3,)], "id long"))) == []
    assert rows(graph.propagate(spark, e, n, spark.createDataFrame([(2,)], "id long"))) == [(1,)]
    assert rows(graph.propagate(spark, e, n, spark.createDataFrame([(1,)], "id long"))) == [(2,), (3,), (4,)]


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (4, 5), (5, 4)], "u long, v long")
    assert rows(graph.components(spark, e)) == [(1, 1, 2), (2, 1, 2), (4, 4, 2), (5, 4, 2)]


def test_most_specific_owner_wins(spark):
    f = spark.createDataFrame([("src/alpha/core.py",), ("src/alpha/beta/mod.py",), ("x.py",)], "path string")
    c = spark.createDataFrame([("alpha", "src/alpha"), ("beta", "src/alpha/beta"), ("rest", "."), ("also", "src/alpha")], "owner string, prefix string")
    assert [r[:2] for r in rows(ownership.owners(f, c))] == [("src/alpha/beta/mod.py", "beta"), ("src/alpha/core.py", "alpha"), ("x.py", "rest")]
    assert rows(ownership.overlaps(f, c)) == [("alpha,also", 1)]


def test_containment(spark):
    c = spark.createDataFrame([("auth", "src/auth"), ("guards", "src/auth/guards"), ("sellers", "src/sellers")], "owner string, prefix string")
    assert rows(graph.containment(c)) == [("auth", "guards")]


def test_import_candidates():
    assert imports.candidates("src/auth/auth.module.ts", "./auth.service")[0] == "src/auth/auth.service"
    assert imports.candidates("pkg/sub/m.py", "..auth.service") == ["pkg/auth/service"]
    assert imports.candidates("src/a/x.ts", "../billing/pricing.js") == ["src/billing/pricing.js", "src/billing/pricing"]


def test_resolution_prefers_earlier_candidates(spark):
    f = spark.createDataFrame([("src/auth/auth.service.ts",), ("pkg/auth/__init__.py",), ("web/ui/index.ts",)], "path string")
    i = spark.createDataFrame([(1, ["src/auth/auth.service"]), (2, ["pkg/auth"]), (3, ["web/ui"]), (4, ["os"]), (5, ["auth.service"])], "k long, stems array<string>")
    assert rows(imports.resolve(f, i, ["k"])) == [(1, "src/auth/auth.service.ts"), (2, "pkg/auth/__init__.py"), (3, "web/ui/index.ts"), (5, "src/auth/auth.service.ts")]


def test_fold_of_renames():
    log = [("create_table", "users", None, ["id", "email", "tmp"], None), ("add_column", "users", "name", None, None), ("drop_column", "users", "tmp", None, None), ("rename_column", "users", "name", None, "full_name"), ("rename_table", "users", None, None, "members")]
    assert fold.fold_rows(log) == {"members": {"email", "full_name", "id"}}
    assert fold.fold_rows([("rename_table", "x", None, None, "y")]) == {"y": set()}
    assert fold.revision_chain([("2", "1"), ("1", None)]) == ["1", "2"]
    assert fold.revision_chain([("1", None), ("2", "1"), ("3", "1")]) is None


def test_grouped_fold_agrees_with_windows_without_renames(spark):
    log = spark.createDataFrame([("s", k, 0, op, "t", c, None, None) for k, (op, c) in enumerate([("add_column", "a"), ("drop_column", "a"), ("create_table", None), ("add_column", "b"), ("add_column", "c"), ("drop_column", "c")])], "subsystem string, rank long, ord long, op string, tbl string, col string, columns array<string>, to string")
    assert [r.columns for r in fold.fold_tables(log).collect()] == [["b"]]
    assert rows(fold.live_columns(log.withColumnRenamed("rank", "seq"))) == [("t", "b")]


def test_policy_first_match_wins(spark):
    found = spark.createDataFrame([("A", "error", "s", "m1"), ("A", "error", None, "m2")], "code string, severity string, subsystem string, message string")
    rules = spark.createDataFrame([(1, "A", "s", None, "suppress"), (2, "A", None, None, "warning")], "rule_ord int, code string, subsystem string, contains string, action string")
    assert sorted((r.message, r.severity, r.suppressed) for r in checks.apply_policy(found, rules).collect()) == [("m1", "info", True), ("m2", "warning", False)]


def test_report_order_over_ranges(spark):
    data = [(c, v, None if k % 5 == 0 else str(k % 3), f"m{k:03}", False) for k in range(200) for c, v in (("A", "error"), ("B", "warning"), ("C", "info"))]
    found = spark.createDataFrame(data, "code string, severity string, subsystem string, message string, suppressed boolean")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    got = [(r.code, r.subsystem, r.message) for r in sorted(checks.ranked(found).collect(), key=lambda r: r["rank"])]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == [(c, s, m) for c, _, s, m, _ in sorted(data, key=lambda r: (r[0], r[2] or "", r[3]))]


def test_state_comparison(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content_hash string")
    old = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, content_hash string")
    assert rows(incremental.compared(now, old)) == [("a", "hit"), ("b", "changed"), ("c", "new"), ("d", "deleted")]


def test_path_functions(spark):
    df = spark.createDataFrame([("tests/a.py",), ("src/x.test.ts",), ("src/config.py",), (".env",), ("app/x/page.tsx",)], "path string")
    got = df.select("path", P.strip_ext(F.col("path")), P.is_test_file(F.col("path")), P.is_config_file(F.col("path")), P.is_framework_entry(F.col("path")))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {"tests/a.py": ("tests/a", True, False, False), "src/x.test.ts": ("src/x.test", True, False, False), "src/config.py": ("src/config", False, True, False), ".env": (".env", False, False, False), "app/x/page.tsx": ("app/x/page", False, False, True)}


def names(language, text, what="symbol"):
    return [(r["name"], r.get("kind"), r.get("exported")) if what == "symbol" else (r["name"], r["names"]) for r in extract.extract_one("f", text, language) if r["what"] == what]


def test_python_facts():
    text = "from ..models.thing import Thing as T\nimport os.path\n__all__ = ['f']\nX = 1\ndef f(): pass\nclass _C: pass\n"
    assert names("python", text) == [("X", "const", False), ("f", "function", True), ("_C", "class", False)]
    assert names("python", text, "import") == [("..models.thing", ["Thing"]), ("os.path", [])]
    assert extract.extract_one("f", "def (", "python")[0]["what"] == "error"


def test_typescript_facts():
    text = "import { a, b as c } from './x';\nexport function f(x: string): void;\nexport function f(x: any) {}\nexport default class K {}\nconst z = 1;\nexport { z as zz };\n// export class No {}\n"
    got = names("typescript", text)
    assert ("f", "function", True) in got and ("zz", "const", True) in got and ("default", "default", True) in got and sum(g[0] == "f" for g in got) == 1 and all(g[0] != "No" for g in got)
    assert names("typescript", text, "import") == [("./x", ["a", "b"])]


def test_sql_facts():
    text = 'CREATE TABLE public.users (id int primary key, "Full Name" text, CONSTRAINT c UNIQUE (id));\nALTER TABLE users ADD COLUMN x int, DROP COLUMN id;\n-- create table no (a int)\nALTER TABLE users ENABLE ROW LEVEL SECURITY;\nCREATE POLICY p ON users;\nALTER TABLE users RENAME TO members;'
    got = [(r["op"], r["tbl"], r.get("col"), r.get("columns")) for r in extract.extract_one("f", text, "sql")]
    assert got == [("create_table", "users", None, ["Full Name", "id"]), ("add_column", "users", "x", None), ("drop_column", "users", "id", None), ("rename_table", "users", None, None), ("enable_rls", "users", None, None), ("create_policy", "users", None, None)]
    assert extract.extract_one("f", "select 1", "sql") == []


def test_prisma_and_shell_facts():
    got = extract.extract_one("f", 'model User {\n id Int @id\n name String @map("full_name")\n posts Post[]\n @@map("users")\n}\nmodel Post {\n id Int\n}\n', "prisma")
    assert [(r["tbl"], r["columns"]) for r in got] == [("users", ["full_name", "id"]), ("Post", ["id"])]
    assert names("shell", "source ./lib.sh\nfoo() {\n}\nfunction _bar {\n}\n") == [("foo", "function", True), ("_bar", "function", False)]


def test_extract_over_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def f(): pass\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "b.js").write_text("export const x = 1;\n")
    facts = extract.extract(extract.source_files(spark, str(tmp_path)))
    assert [(r.path, r.name, r.kind) for r in facts.collect()] == [("src/a.py", "f", "function")]
    assert len(extract.structure_hash(facts).collect()[0].structure_hash) == 64


def test_alias_order():
    text = '{ // c\n "compilerOptions": {"paths": {"@/*": ["src/*"], "@/ui/*": ["ui/*"], "lib": ["lib/index"]},} }'
    assert extract.aliases(text) == [("lib", "", "lib/index"), ("@/ui/", "", "ui/*"), ("@/", "", "src/*")]


def test_django_inheritance_and_mapped_tables():
    text = "class A(models.Model):\n class Meta:\n  abstract = True\nclass B(A):\n pass\nclass C(B):\n class Meta:\n  db_table = 'cs'\nclass D(Base):\n __tablename__ = f'{x}'\nclass E(Base):\n __table__ = Table('es', m)\nclass X(Y): pass\nclass Y(X): pass\n"
    assert [r["tbl"] for r in extract.extract_one("f", text, "python") if r["kind"] == "table"] == ["B", "cs", "D", "es"]


def test_typescript_declarators_tables_and_entries():
    text = """export const a = 1, b = { x: 1, y: [2, 3] }, c = f(1, 2);
export const { d, e: ee } = obj;
export const users = pgTable("app_users", { id: serial() });
const t2 = sqliteTable({});
@Entity({ name: "accounts" })
export class Account {}
@Controller('x')
export class Api {}
module.exports = { a, run: go, other() {}, ...rest };
class K {}
export { K as Kay };
"""
    rows = extract.extract_one("f.ts", text, "typescript")
    got = {(r["name"], r["kind"], r["exported"]) for r in rows if r["what"] == "symbol"}
    assert {("a", "const", True), ("b", "const", True), ("c", "const", True), ("d", "const", True), ("ee", "const", True), ("app_users", "table", True), ("t2", "table", True), ("accounts", "table", True), ("Account", "class", True), ("run", "variable", True), ("other", "variable", True), ("Kay", "class", True)} <= got
    assert next(r for r in rows if r["name"] == "Api")["target"] == "nest_controller" and not [g for g in got if g[0] in ("x", "y", "rest")]


def test_aliases_with_extends(tmp_path):
    (tmp_path / "conf").mkdir()
    (tmp_path / "conf" / "base.json").write_text('{"compilerOptions": {"baseUrl": "../src", "paths": {"@/*": ["*"], "old": ["x"]}}}')
    (tmp_path / "tsconfig.json").write_text('{ // c\n"extends": "./conf/base", "compilerOptions": {"paths": {"@/ui/*": ["ui/*.ts"], "lib": ["lib/index.ts"]}},}')
    base, paths = extract.load_aliases(tmp_path)
    assert base == "src" and paths == {"@/*": ["src"] if False else ["src/*"], "old": ["src/x"], "@/ui/*": ["src/ui/*.ts"], "lib": ["src/lib/index.ts"]}
    stems = lambda m: extract.alias_stems(m, base, extract.ordered(paths), set(paths))
    assert stems("@/ui/button") == ["src/ui/button", "src/@/ui/button"] or stems("@/ui/button")[0] == "src/ui/button"
    assert stems("lib")[0] == "src/lib/index" and stems("@/a")[0] == "src/a"
    assert imports.candidates("w/x.ts", "@/a", stems)[0] == "src/a" and imports.candidates("w/x.py", "a.b", stems) == ["a/b"]
    assert imports.member_candidates("pkg/m.py", ".", ["output"])[1] == (True, ["pkg/output"])
    assert extract.load_aliases(tmp_path / "none") == (None, {})


def test_raw_sql_literals(spark):
    from codemap_spark.operators import rawsql

    assert rawsql.literals("x = 'select * from a'\ny = f'from {t}'\n", "python") == ["select * from a"]
    assert rawsql.literals("const q = `from b`; const r = `from ${t}`; // 'from c'\n'into d'", "typescript") == ["from b", "into d"]
    df = spark.createDataFrame([("m.py", "python", "q = 'SELECT 1 FROM s.users JOIN \"posts\"; DELETE FROM logs'")], "path string, language string, text string")
    claims = spark.createDataFrame([("m.py", "b"), ("m.py", "a")], "path string, owner string")
    assert rows(rawsql.consumers(rawsql.literal_rows(df), claims)) == [("logs", "a", "reads", 1), ("logs", "a", "writes", 1), ("posts", "a", "reads", 1), ("users", "a", "reads", 1)] or rows(rawsql.consumers(rawsql.literal_rows(df), claims)) == [("logs", "a", "writes", 1), ("posts", "a", "reads", 1), ("users", "a", "reads", 1)]


def test_state_merges_and_prunes(spark):
    now = spark.createDataFrame([("a", "1", "x")], "path string, content_hash string, subsystem string")
    state = spark.createDataFrame([("a", "0", "x"), ("b", "2", "x"), ("c", "3", "x")], "path string, content_hash string, subsystem string")
    live, owners = spark.createDataFrame([("a",), ("b",)], "path string"), spark.createDataFrame([("a", "x"), ("b", "y")], "path string, owner string")
    assert rows(incremental.merged(now, state, live, owners)) == [("a", "1", "x"), ("b", "2", "y")] and rows(incremental.merged(now, state)) == [("a", "1", "x"), ("b", "2", "x"), ("c", "3", "x")]
    assert rows(incremental.vanished_owners(state, live)) == [("x",)]


def test_state_versions(spark, tmp_path):
    import pytest
    from pyspark.errors import AnalysisException  # noqa: F401

    s = spark.createDataFrame([("a", "1", "x")], "path string, content_hash string, subsystem string")
    assert incremental.read_state(spark, str(tmp_path / "s"), s.schema).collect() == [] and not incremental.migrate(spark, str(tmp_path / "s"), s.schema, 1, 2)
    incremental.write_state(s, str(tmp_path / "s"), 1)
    assert incremental.migrate(spark, str(tmp_path / "s"), s.schema, 1, 2) and [r.path for r in incremental.read_state(spark, str(tmp_path / "s"), s.schema, "x", 2).collect()] == ["a"]
    assert pytest


def test_components_against_mutual_reach(spark):
    import random

    r = random.Random(5)
    e = sorted({(r.randrange(40), r.randrange(40)) for _ in range(70)})
    df = spark.createDataFrame(e, "u long, v long")
    reach = {tuple(x) for x in graph.transitive_closure(spark, df).collect()}
    want = {a: min(b for b in range(40) if (a, b) in reach and (b, a) in reach) for a in range(40) if (a, a) in reach}
    assert {x.id: x.component for x in graph.components(spark, df).collect()} == want


def test_small_and_large_searches_agree(spark, monkeypatch):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (5, 4)], "u long, v long")
    n = spark.createDataFrame([(1, "core"), (2, "connector"), (3, "leaf"), (4, "leaf"), (5, "leaf")], "id long, criticality string")
    seeds = spark.createDataFrame([(3,), (2,)], "id long")
    one = rows(graph.transitive_closure(spark, e)), rows(graph.propagate(spark, e, n, seeds)), rows(graph.reached_from(spark, e, seeds))
    monkeypatch.setattr(graph, "SMALL", 1)
    assert one == (rows(graph.transitive_closure(spark, e)), rows(graph.propagate(spark, e, n, seeds)), rows(graph.reached_from(spark, e, seeds)))


def test_orphans_of_repeated_rows_and_nulls(spark):
    d = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, None), (2, "a"), (None, "a")], "subsystem int, name string")
    c = spark.createDataFrame([(7, 1, "a"), (8, 1, "a"), (7, 1, None), (7, None, "b")], "consumer int, provider int, name string")
    for tasks in (None, 3):
        assert sorted(checks.orphans(d, c, tasks).collect(), key=str) == [(1, "b"), (1, None)]


def test_baselines_by_row(spark):
    now = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "b")], "subsystem int, name string")
    base = spark.createDataFrame([(1, None), (3, "c"), (3, "c")], "subsystem int, name string")
    for tasks in (None, 3):
        assert rows(incremental.baseline_diff(now, base, tasks)) == [(1, "a", "new"), (2, "b", "new"), (3, "c", "resolved")]
        assert rows(checks.drift_missing(now, base, tasks)) == [(1, "a"), (2, "b")]


def test_proposals_of_repeated_rows(spark):
    d = spark.createDataFrame([(1, n, n == "p") for n in "abcp" * 2] + [(5, "z", False)], "subsystem int, name string, internal boolean")
    a = spark.createDataFrame([(1, "a", "class", False), (1, "n", "class", False), (1, "n", "class", False), (1, "g", "class", True)], "subsystem int, name string, kind string, generated boolean")
    c = spark.createDataFrame([(9, 1, "b"), (8, 1, "b"), (9, 5, "z")], "consumer int, provider int, name string")
    dark = spark.createDataFrame([(5,), (5,)], "subsystem int")
    same = [(1, "add_expose", "n", "class"), (1, "remove_expose", "c", None), (5, "needs_review", "z", "unsupported_language")]
    for tasks in (None, 3):
        assert sorted(calibrate.exposes(d, a, c, dark, tasks=tasks).collect(), key=str) == sorted([*same, (1, "needs_review", "b", "consumed_contract")], key=str)
        assert sorted(calibrate.exposes(d, a, c, dark, True, tasks).collect(), key=str) == sorted([*same, (1, "remove_expose", "b", None)], key=str)
        keys = calibrate.drift_keys(calibrate.exposes(d, a, c, dark, tasks=tasks), tasks)
        assert rows(keys) == [("1\tadd_expose\tn",), ("1\tremove_expose\tc",)]
        assert rows(calibrate.drift_check(keys, spark.createDataFrame([("1\tadd_expose\tn",), ("x",)], "key string"), tasks)) == [("1\tremove_expose\tc", "new"), ("x", "resolved")]


def test_report_order_in_a_given_number_of_ranges(spark):
    data = [(c, v, None if k % 5 == 0 else str(k % 3), f"m{k:03}", False) for k in range(200) for c, v in (("A", "error"), ("B", "warning"), ("C", "info"))]
    found = spark.createDataFrame(data, "code string, severity string, subsystem string, message string, suppressed boolean")
    got = checks.ranked(found, 13)
    assert [(r.code, r.subsystem, r.message, r["rank"]) for r in sorted(got.collect(), key=lambda r: r["rank"])] == [(c, s, m, k) for k, (c, _, s, m, _) in enumerate(sorted(data, key=lambda r: (r[0], r[2] or "", r[3])), 1)]
