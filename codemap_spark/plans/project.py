"""A repository as facts, and the commands that people run on it."""

from __future__ import annotations

from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codemap_spark.functions import paths as P
from codemap_spark.operators import calibrate, checks, coverage, discover, fold, graph, imports, incremental, locate, ownership, rawsql
from codemap_spark.sources import extract, manifests

QUICK = ("drift", "cross_impact", "schema", "adapter_contracts", "overlap", "extraction_failed")
FULL = ("drift", "boundary", "contract", "cross_impact", "cycle", "composition", "orphan", "unowned", "schema", "adapter_contracts", "overlap", "extraction_failed", "coverage_gap", "unsupported_surface", "symlinks", "negations")
SENSITIVE = ("add_column", "drop_column", "drop_table", "rename_table", "rename_column", "drop_policy", "alter_policy", "disable_rls", "no_force_rls")
ADVISORY = ("audit", "hotfix")


class Project:
    """Facts of one repository; every property is a DataFrame."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Path(root)
        self.declared = manifests.load(self.root)
        self.frames = self.declared.frames(spark)

    @cached_property
    def files(self) -> DataFrame:
        """Source files, read and hashed once: a table in the shared folder that all checks use."""
        return graph._saved(self.spark, self._files(extract.LANGUAGES))

    @cached_property
    def foreign(self) -> DataFrame:
        """Source files of languages without an extractor, with the owner where one claims them."""
        f = self._files(extract.FOREIGN).where(~P.is_test_file(F.col("path")))
        return f.join(ownership.owners(f.select("path"), self.frames["claims"]), "path", "left")

    def _files(self, languages: dict[str, str]) -> DataFrame:
        f = extract.source_files(self.spark, str(self.root), languages).where(~F.col("path").startswith(manifests.FOLDER + "/"))
        if rules := manifests.ignore_regex(self.root):
            f = f.where(~F.col("path").rlike(rules))
        if manifests.is_git_repo(self.root):  # what git tracks or could add; a list of paths, as git itself gives it
            listed = [(x,) for x in {*manifests.tracked_files(self.root), *manifests.changed_files(self.root)}]
            f = f.join(self.spark.createDataFrame(listed, "path string"), "path", "left_semi")
        return f.withColumn("content_hash", F.sha2("content", 256)).drop("content")

    @cached_property
    def owners(self) -> DataFrame:
        return ownership.owners(self.files.select("path"), self.frames["claims"])

    @cached_property
    def facts(self) -> DataFrame:
        """What is extracted from the files, once."""
        return graph._saved(self.spark, extract.extract(self.files).join(self.owners.select("path", F.col("owner").alias("subsystem")), "path", "left"))

    @cached_property
    def migrations(self) -> DataFrame:
        """(subsystem, path, rank, no_order) of owned SQL and Prisma files in the order of the fold."""
        meta = self.facts.where("what = 'symbol'").groupBy("path").agg(
            F.max(F.expr("CASE WHEN op = 'order' THEN try_cast(name AS INT) END")).alias("explicit"), F.max(F.when(F.col("op") == "revision", F.col("name"))).alias("revision"),
            F.max(F.when(F.col("op") == "down_revision", F.col("name"))).alias("down"), F.max(F.col("op").isin(*SENSITIVE)).alias("sensitive"),
        )
        own = self.files.where("language IN ('sql', 'prisma')").select("path").join(self.owners.select("path", F.col("owner").alias("subsystem")), "path")
        return fold.migration_ranks(own.join(meta, "path", "left").select("subsystem", "path", "explicit", "revision", "down", F.coalesce("sensitive", F.lit(False)).alias("sensitive")))

    @cached_property
    def exported(self) -> DataFrame:
        """(subsystem, name, path) of what code exports; tests, framework entries and generated files keep their flag."""
        s = self.facts.where("what = 'symbol' AND exported AND subsystem IS NOT NULL")
        # Statements of migrations show nothing by themselves; the tables that they leave do.
        gen = self.files.where("language NOT IN ('sql', 'prisma')").select("path", P.is_generated(F.col("text")).alias("generated"))
        return s.join(gen, "path").select("subsystem", "name", "path", (P.is_test_file(F.col("path")) | P.is_framework_entry(F.col("path")) | F.col("generated") | F.col("name").startswith("_")).alias("quiet"))

    @cached_property
    def exposes(self) -> DataFrame:
        return self.frames["exposes"].select("subsystem", "name").distinct()

    @cached_property
    def edges(self) -> DataFrame:
        return self.frames["consumes"].select(F.col("consumer").alias("u"), F.col("provider").alias("v")).distinct()

    @cached_property
    def consumed(self) -> DataFrame:
        return self.frames["consumes"].select("consumer", "provider", F.explode("interfaces").alias("name"))

    @cached_property
    def aliases(self):
        """What a bare import of a web file may mean by the compiler configuration; None without one."""
        base, paths = extract.load_aliases(self.root)
        if base is None and not paths:
            return None
        order, patterns = extract.ordered(paths), set(paths)
        return lambda module: extract.alias_stems(module, base, order, patterns)

    @cached_property
    def resolved(self) -> DataFrame:
        """(path, ord, target, consumer, provider, names) of imports that stay in the repository."""
        stems = imports.stems_udf(self.aliases)
        i = self.facts.where("what = 'import'").select("path", "ord", "names", F.col("subsystem").alias("consumer"), stems("path", "name").alias("stems"))
        hit = imports.resolve(self.files.select("path"), i, ["path", "ord"])
        return i.join(hit, ["path", "ord"]).join(self.owners.select(F.col("path").alias("target"), F.col("owner").alias("provider")), "target").drop("stems")

    @cached_property
    def targets(self) -> DataFrame:
        """(path, consumer, provider, member, names): resolved again with each name as a member of its module."""
        members = imports.members_udf(self.aliases)
        i = self.facts.where("what = 'import'").select("path", "ord", "names", F.col("subsystem").alias("consumer"), F.posexplode(members("path", "name", "names")).alias("m", "x"))
        i = i.select("path", "ord", "m", "names", "consumer", "x.member", "x.stems")
        hit = imports.resolve(self.files.select("path"), i, ["path", "ord", "m"])
        return i.join(hit, ["path", "ord", "m"]).join(self.owners.select(F.col("path").alias("target"), F.col("owner").alias("provider")), "target").select("path", "consumer", "provider", "member", "names")

    @cached_property
    def folded(self) -> DataFrame:
        return graph._saved(self.spark, self.tables())

    @cached_property
    def dark(self) -> DataFrame:
        """(subsystem) with files of languages without an extractor, by any claim, not only the winning one."""
        claims = ownership.claims_of(self._files(extract.FOREIGN).select("path"), self.frames["claims"])
        return claims.select(F.col("owner").alias("subsystem")).distinct()

    @cached_property
    def symbols(self) -> DataFrame:
        """(subsystem, name): all that code and folded tables define; statements of migrations count by what they leave."""
        lang = self.files.select("path", F.col("language").alias("lang"))
        code = self.facts.where("what = 'symbol'").join(lang, "path").where("lang NOT IN ('sql', 'prisma')").select("subsystem", "name")
        t = self.folded
        return code.unionByName(t.select("subsystem", F.col("tbl").alias("name"))).unionByName(t.select("subsystem", F.explode(F.transform("columns", lambda c: F.concat_ws(".", "tbl", c))).alias("name"))).distinct()

    # --- checks ----------------------------------------------------------------------------------

    def drift(self) -> DataFrame:
        actual = self.exported.select("subsystem", "name").unionByName(self.folded.select("subsystem", F.col("tbl").alias("name"))).distinct()
        gone = checks.drift_missing(self.exposes, actual).join(self.dark, "subsystem", "left_anti")
        gone = checks.contract_columns(gone.select(F.col("subsystem").alias("provider"), "name"), actual, self.folded).select(F.col("provider").alias("subsystem"), "name")
        missing = checks.issues(gone, "E_STRUCTURAL_DRIFT", "subsystem", F.concat(F.lit("declared but not found: "), "name"))
        loud = self.exported.where("NOT quiet").select("subsystem", "name").unionByName(self.folded.select("subsystem", F.col("tbl").alias("name"))).distinct()
        # A table whose columns are declared is declared with them.
        parents = self.exposes.where(F.col("name").contains(".")).select("subsystem", F.substring_index("name", ".", 1).alias("name"))
        extra = loud.join(self.exposes.unionByName(parents), ["subsystem", "name"], "left_anti").where("NOT startswith(name, '_')").join(self.exposes.select("subsystem").distinct(), "subsystem", "left_semi")
        roll = extra.groupBy("subsystem").agg(P.sampled(F.collect_list("name")).alias("s"))
        return missing.unionByName(checks.issues(roll, "E_STRUCTURAL_DRIFT", "subsystem", F.concat(F.lit("not declared: "), "s")).withColumn("severity", F.lit("info")))

    def boundary(self) -> DataFrame:
        used = self.resolved.where(~P.is_test_file(F.col("path"))).select("consumer", "provider", "path", F.explode("names").alias("name"))
        hit = checks.boundary(used.where("consumer IS NOT NULL"), self.symbols, self.exposes)
        return checks.issues(hit, "E_BOUNDARY_VIOLATION", "consumer", F.concat("path", F.lit(" imports "), "name", F.lit(" of "), "provider"))

    def unresolved_local(self) -> DataFrame:
        """(path, ord, name): imports that look local and lead to no file."""
        tops = self.files.agg(F.array_sort(F.collect_set(F.split("path", "/")[0])).alias("tops"))
        i = self.facts.where("what = 'import'").select("path", "ord", "name").join(self.resolved.select("path", "ord"), ["path", "ord"], "left_anti")
        return i.crossJoin(F.broadcast(tops)).where(P.is_local_looking(F.col("name"), F.col("tops"))).drop("tops")  # tops is one row

    def contract(self) -> DataFrame:
        known = self.frames["subsystems"].select(F.col("subsystem").alias("provider"))
        lost = checks.issues(self.frames["consumes"].join(known, "provider", "left_anti"), "E_UNRESOLVED_REFERENCE", "consumer", F.concat(F.lit("unknown provider "), "provider"))
        hit = self.consumed.join(known, "provider", "left_semi").join(self.exposes.select(F.col("subsystem").alias("provider"), "name"), ["provider", "name"], "left_anti")
        hit = checks.contract_columns(hit, self.exposes, self.folded)
        return lost.unionByName(checks.issues(hit, "E_CONTRACT_MISSING_EXPORT", "consumer", F.concat("name", F.lit(" is not exposed by "), "provider")))

    def orphan(self) -> DataFrame:
        tolerant = [r for r, ok in self.declared.roles.items() if ok]
        strict = self.frames["subsystems"].where(~F.col("role").isin(tolerant)).select("subsystem")
        called = self.facts.where("what = 'symbol' AND exported AND startswith(target, 'nest_')").select("subsystem", "name").distinct()
        hit = checks.orphans(self.exposes.join(strict, "subsystem", "left_semi"), self.consumed).join(called, ["subsystem", "name"], "left_anti")
        roll = hit.groupBy("subsystem").agg(P.sampled(F.collect_list("name")).alias("s"))
        return checks.issues(roll, "E_ORPHAN_EXPORT", "subsystem", F.concat(F.lit("nobody consumes "), "s"))

    def contained(self) -> set[tuple[str, str]]:
        """Pairs of subsystems of which one lies in the other, by paths or by a declared parent."""
        pairs = {(r.outer, r.inner) for r in graph.containment(self.frames["claims"]).collect()}  # pairs of one repository's manifests
        up = {s[0]: s[4] for s in self.declared.subsystems if s[4]}
        for name in up:
            at, seen = up.get(name), {name}
            while at and at not in seen:
                pairs.add((at, name))
                seen.add(at)
                at = up.get(at)
        return pairs | {(b, a) for a, b in pairs}

    def cycles(self) -> list[list[str]]:
        """Cycles of declared edges that are more than a part and its whole, shortest first."""
        adj: dict[str, list[str]] = {}
        for r in self.edges.collect():  # the declared edges of one repository
            adj.setdefault(r.u, []).append(r.v)
        inside = self.contained()
        return [c for c in graph.back_edge_cycles(adj) if len(c) > 2 or tuple(c) not in inside]

    def symlinks(self) -> DataFrame:
        rows = [("E_EXTERNAL_SYMLINK", "warning", None, f"{p} leads out of the project") for p in manifests.external_symlinks(self.root, extract.IGNORED)]
        return self.spark.createDataFrame(rows, manifests.ISSUES)

    def negations(self) -> DataFrame:
        rows = [("E_SCHEMA_INVALID", "warning", None, f"an ignore file takes back {x[1:]}, which is not supported") for x in manifests.negations(self.root)]
        return self.spark.createDataFrame(rows, manifests.ISSUES)

    def cycle(self) -> DataFrame:
        found = self.cycles()
        base = manifests.read_keys(self._baseline("cycles")) or set()
        new = [c for c in found if tuple(c) not in base]
        out = [("E_CYCLE_DETECTED", "error", c[0], " -> ".join([*c, c[0]])) for c in new[:10]]
        if known := len(found) - len(new):
            out.append(("E_CYCLE_DETECTED", "info", None, f"{known} known cycles accepted by the baseline"))
        if cuts := graph.greedy_cuts(new, self.contained()) if len(new) > 1 else []:
            rest, more = f", {len(new) - 10} not listed" if len(new) > 10 else "", f", +{len(cuts) - 15} more" if len(cuts) > 15 else ""
            out.append(("E_CYCLE_DETECTED", "error", None, f"{len(new)} cycles{rest}; cutting breaks them: " + ", ".join(f"{a} -> {b}" for a, b, _ in cuts[:15]) + more))
        return self.spark.createDataFrame(out, manifests.ISSUES)

    def composition(self) -> DataFrame:
        n = self.frames["subsystems"].select(F.col("subsystem").alias("id"))
        return checks.issues(graph.composition_roots(n, self.edges), "E_COMPOSITION_ROOT", "id", F.concat(F.lit("fan-in "), F.col("fan_in").cast("string"), F.lit(", fan-out "), F.col("fan_out").cast("string")))

    def unowned(self) -> DataFrame:
        u = self.files.where(~P.is_test_file(F.col("path")) & ~P.is_config_file(F.col("path"))).join(self.owners, "path", "left_anti")
        return checks.issues(u.withColumn("none", F.lit(None).cast("string")), "E_UNOWNED_FILE", "none", F.col("path"))

    def schema(self) -> DataFrame:
        m = self.migrations
        lost = self.facts.where("op = 'unparsed'").join(m.select("path"), "path")
        found = checks.issues(lost, "E_SCHEMA_UNPARSED", "subsystem", F.concat("name", F.lit(" statements that could not be read in "), "path"))
        return found.unionByName(checks.issues(m.where("no_order").select("subsystem").distinct(), "E_SCHEMA_NO_ORDER", "subsystem", F.lit("migrations depend on an order that neither numbers, revisions nor headers give")))

    def adapter_contracts(self) -> DataFrame:
        """What an extractor must not give out: a header that hides a file without readable statements, relations as columns."""
        s = self.facts.where("what IN ('symbol', 'error')").join(self.files.select("path", F.col("language").alias("lang")), "path")
        own = s.where("lang = 'sql'").groupBy("path", "subsystem").agg(F.max(F.col("kind") == "schema_meta").alias("meta"), F.max(F.col("kind") == "schema_error").alias("lost"), F.max((F.col("what") == "error") | ~F.col("kind").isin("schema_meta", "schema_error")).alias("other"))
        one = checks.issues(own.where("meta AND lost AND NOT other"), "E_ADAPTER_CONTRACT", "subsystem", F.concat(F.lit("a header hides that nothing could be read in "), "path"))
        t = s.where("lang = 'prisma' AND kind = 'table'")
        t = t.join(t.groupBy("path").agg(F.collect_set("target").alias("models")), "path").withColumn("leaked", F.expr("array_sort(filter(columns, c -> array_contains(models, c) OR c RLIKE '^[A-Z]'))"))
        return one.unionByName(checks.issues(t.where("size(leaked) > 0"), "E_ADAPTER_CONTRACT", "subsystem", F.concat(F.lit("relations as columns of "), "tbl", F.lit(": "), F.array_join("leaked", ", "))))

    def overlap(self) -> DataFrame:
        o = ownership.overlaps(self.files.select("path"), self.frames["claims"]).withColumn("first", F.element_at(F.split("contenders", ","), 1))
        return checks.issues(o, "E_SUBSYSTEM_OVERLAP", "first", F.concat(F.col("n_files").cast("string"), F.lit(" files are claimed alike by "), "contenders"))

    def extraction_failed(self) -> DataFrame:
        return checks.issues(self.facts.where("what = 'error' AND subsystem IS NOT NULL"), "E_EXTRACTION_FAILED", "subsystem", F.concat("path", F.lit(": "), "error"))

    def coverage_gap(self) -> DataFrame:
        """One finding while supported files have no owner, or others no claim."""
        open_ = self.why().where("status = 'unowned'").select("path", F.lit(1).alias("known")).unionByName(self.foreign.where("owner IS NULL").select("path", F.lit(0).alias("known")))
        n = open_.agg(F.sum("known").alias("known"), F.count("*").alias("n"), P.sampled(F.collect_list("path")).alias("s")).where("n > 0").withColumn("none", F.lit(None).cast("string"))
        return checks.issues(n, "E_COVERAGE_GAP", "none", F.concat(F.col("known").cast("string"), F.lit(" supported and "), (F.col("n") - F.col("known")).cast("string"), F.lit(" other files in no subsystem: "), "s"))

    def unsupported_surface(self) -> DataFrame:
        """Subsystems whose files without an extractor changed or went since the surface baseline."""
        base = manifests.read_keys(self._baseline("surface")) or set()
        saved = self.spark.createDataFrame(sorted(base), "subsystem string, path string, content_hash string")
        # A file that moved to another owner is gone from its first one.
        now = self.foreign.where("owner IS NOT NULL").select(F.concat_ws("\t", "owner", "path").alias("path"), "content_hash")
        stale = incremental.surface_stale(saved.select(F.concat_ws("\t", "subsystem", "path").alias("path"), "content_hash"), now)
        parts = F.split("path", "\t")
        hit = stale.select(parts[0].alias("subsystem"), parts[1].alias("path")).groupBy("subsystem").agg(F.count("*").alias("n"), P.sampled(F.collect_list("path")).alias("s"))
        return checks.issues(hit, "E_UNSUPPORTED_SURFACE_STALE", "subsystem", F.concat(F.col("n").cast("string"), F.lit(" files changed since their exposes were confirmed: "), "s"))

    def _baseline(self, kind: str) -> Path:
        """Where a baseline lies: drift, cycles or surface."""
        return self.root / manifests.FOLDER / "baseline" / f"{kind}.json"

    def confirm_surface(self) -> None:
        """Write the baseline that unsupported_surface compares with."""
        manifests.write_keys(self._baseline("surface"), {tuple(r) for r in self.foreign.where("owner IS NOT NULL").select("owner", "path", "content_hash").collect()})

    def tables(self) -> DataFrame:
        """(subsystem, tbl, columns) that the migrations fold to."""
        log = self.facts.where("what = 'symbol' AND op IS NOT NULL").join(self.migrations.select("path", "rank"), "path")
        return fold.fold_tables(log.select("subsystem", "rank", "ord", "op", "tbl", "col", "columns", F.col("target").alias("to")))

    def cross_impact(self, changed: list[str] | None = None) -> DataFrame:
        """Consumers of subsystems with files that differ from the saved state, or that git calls changed."""
        changed = manifests.changed_files(self.root) if changed is None else changed
        rows = self.spark.createDataFrame([(c,) for c in changed], "path string")
        dirty = self.owners.join(rows, "path", "left_semi").select(F.col("owner").alias("id")).distinct()
        nodes = self.frames["subsystems"].select(F.col("subsystem").alias("id"), "criticality")
        far = graph.propagate(self.spark, self.edges, nodes, dirty, self.declared.depths)
        hit = checks.stale_interfaces(self.edges, far, dirty)
        return checks.issues(hit, "E_STALE_INTERFACE", "consumer", F.concat(F.lit("changed providers: "), F.coalesce(F.regexp_replace("providers", ",", ", "), F.lit("further up"))))

    # --- commands -----------------------------------------------------------------------------------

    def validate(self, mode: str = "full") -> DataFrame:
        """Findings with suppressed, in the order of the report."""
        names = () if mode == "hotfix" else QUICK if mode == "quick" else FULL
        found = self.frames["issues"]
        for name in names:
            found = found.unionByName(getattr(self, name)())
        if mode == "quick":
            found = found.withColumn("severity", F.when(F.col("severity") == "error", "warning").otherwise(F.col("severity")))
        if mode == "quick" or mode == "hotfix":  # unowned files are errors in every mode
            found = found.unionByName(self.unowned())
        rules, _, _, warnings = self.policy
        found = found.unionByName(self.spark.createDataFrame([("E_SCHEMA_INVALID", "warning", None, w) for w in warnings], manifests.ISSUES))
        return checks.ranked(checks.apply_policy(found, self.spark.createDataFrame(rules, "rule_ord int, code string, subsystem string, contains string, action string")))

    @cached_property
    def policy(self):
        return manifests.load_policy(self.root / manifests.FOLDER / "policy.yaml")

    def report(self, mode: str = "full", fail_on: tuple[str, ...] = ()) -> dict:
        """Status, gate, tallies and next steps beside the findings, as one document."""
        found = graph._saved(self.spark, self.validate(mode))
        gate = checks.gate(found, mode, self.declared.enforce, tuple(checks.fail_codes(list(fail_on), self.policy[2]))).first()
        n = {r.code: r.n for r in checks.tally(found.where("NOT suppressed")).groupBy("code").agg(F.sum("n").alias("n")).collect()}
        steps = [r.action for r in checks.ladder(found.where("NOT suppressed")).orderBy("step").collect()]
        if mode == "quick":
            steps.insert(0, "run the full mode before calling the project clean")
        return {"status": gate.status, "mode": mode, "ok": not gate.blocked, "issues": [r.asDict() for r in found.orderBy("rank").collect()], "next_steps": steps, "stats": dict(sorted(n.items()))}

    def preflight(self, fail_on: tuple[str, ...] = ()) -> DataFrame:
        return checks.gate(self.validate("full"), "preflight", self.declared.enforce, tuple(checks.fail_codes(list(fail_on), self.policy[2])))

    def list(self, namespace: str | None = None) -> DataFrame:
        s = self.frames["subsystems"]
        s = s if namespace is None else s.where(F.col("namespace") == namespace)
        back = self.edges.groupBy(F.col("v").alias("subsystem")).agg(F.array_sort(F.collect_set("u")).alias("consumed_by"))
        return s.join(back, "subsystem", "left").orderBy("subsystem")

    def describe(self, name: str) -> DataFrame:
        """(name, kind, verified) of a subsystem's interfaces."""
        hit = self.exported.select("subsystem", "name").distinct().withColumn("hit", F.lit(True))
        return self.frames["exposes"].where(F.col("subsystem") == name).join(hit, ["subsystem", "name"], "left").select("name", "kind", F.coalesce("hit", F.lit(False)).alias("verified")).orderBy("name")

    def overview(self) -> DataFrame:
        return self.frames["subsystems"].groupBy("role", "criticality").agg(F.count("*").alias("n"), F.count_if(F.col("description").isNotNull()).alias("described"))

    def where(self, name: str, prefix: bool = False) -> DataFrame:
        """Symbols of a name, or, for what is a file or holds a slash, all symbols of that file."""
        s = self.facts.where("what = 'symbol'")
        if "/" in name or (self.root / name).is_file():
            return locate.by_path(s, self.exposes, Path(name).as_posix())
        match = F.col("name").startswith(name) if prefix else F.col("name") == name
        return s.where(match).select("path", "name", "line", "kind", "subsystem").orderBy("path", "name", "line", "kind")

    def suggest(self, name: str) -> tuple[DataFrame, DataFrame]:
        """For a name that where() misses: symbols that contain it, and subsystems that mention it."""
        return locate.near_symbols(self.facts.where("what = 'symbol'"), name), locate.near_subsystems(self.frames["subsystems"], name)

    def impact(self, name: str) -> DataFrame:
        """Direct and transitive consumers of a subsystem, or of an interface where no subsystem has the name."""
        if name not in {s[0] for s in self.declared.subsystems}:
            return locate.interface_impact(self.spark, self.consumed, self.edges, name).orderBy("consumer")
        direct = self.edges.where(F.col("v") == name).select(F.col("u").alias("consumer"), F.lit(True).alias("direct"))
        far = graph.reached_from(self.spark, self.edges, self.spark.createDataFrame([(name,)], "id string")).where(F.col("id") != name).select(F.col("id").alias("consumer"))
        return far.join(direct, "consumer", "left").select("consumer", F.coalesce("direct", F.lit(False)).alias("direct")).orderBy("consumer")

    def raw_consumers(self, table: str) -> DataFrame:
        """(subsystem, via, n_files): who names a table in SQL strings; advice alone."""
        claimants = ownership.claims_of(self.files.select("path"), self.frames["claims"]).select("path", "owner")
        return rawsql.consumers(rawsql.literal_rows(self.files), claimants).where(F.col("tbl") == table).select("subsystem", "via", "n_files").orderBy("subsystem", "via")

    def verify_impact(self) -> DataFrame:
        """(consumer, provider, n_files): imports across subsystems that no manifest declares."""
        return locate.undeclared(self.resolved.where("consumer IS NOT NULL"), self.frames["consumes"].select("consumer", "provider"))

    def undeclared_consumers(self) -> DataFrame:
        used = self.resolved.where("consumer IS NOT NULL AND consumer <> provider").select(F.col("consumer").alias("u"), F.col("provider").alias("v"))
        return checks.undeclared_edges(used, self.edges)

    def coverage(self) -> DataFrame:
        return ownership.coverage(self.files, self.owners, list(extract.EXTRACTORS))

    def classified(self) -> DataFrame:
        """(path, language, owner, class) of all source files, those of languages without an extractor among them."""
        every = self._files(extract.LANGUAGES | extract.FOREIGN).select("path", "language")
        return coverage.classify(every, ownership.owners(every.select("path"), self.frames["claims"]), list(extract.EXTRACTORS))

    def mapping(self) -> DataFrame:
        return coverage.has_gap(coverage.mapping(self.classified()))

    def fix_coverage(self, apply: bool = False) -> list[str]:
        """Exact ignore rules for build configurations; they are written only if asked."""
        known = self.spark.createDataFrame([(x,) for x in manifests.ignore_lines(self.root)], "path string")
        paths = [r.path for r in coverage.auto_rules(self.classified(), known).orderBy("path").collect()]
        return manifests.append_ignore(self.root, paths) if apply else paths

    def why(self) -> DataFrame:
        return ownership.explain(self.files, self.owners, list(extract.EXTRACTORS))

    def why_path(self, path: str) -> DataFrame:
        """(path, status, reason, owner) of one path."""
        return coverage.explain(self.classified(), self.spark.createDataFrame([(path,)], "path string"))

    def linked(self, kind: str) -> DataFrame:
        """(path, owner) of documents or tests: an explicit link, a claim, a folder of the area's name, then the file's name."""
        if kind == "tests":
            f = self.files.where(P.is_test_file(F.col("path"))).select("path")
        else:
            f = self._files({".md": "markdown", ".mdx": "markdown", ".rst": "rst"}).select("path")
        own = self.frames["links"].where(F.col("field") == kind).select("owner", "prefix").where("prefix <> '.'")
        names = self.frames["subsystems"].select(F.col("subsystem").alias("owner"))
        first = ownership.owners(f, own).select("path", F.col("owner").alias("o"))
        rest = ownership.linked(f, self.frames["claims"], names).withColumnRenamed("owner", "p")
        area = f.select("path", P.test_area(F.col("path")).alias("owner")).join(names, "owner").select("path", F.col("owner").alias("a"))
        return f.join(first, "path", "left").join(rest, "path", "left").join(area, "path", "left").select("path", F.coalesce("o", "p", "a" if kind == "tests" else F.lit(None)).alias("owner"))

    def schema_catalog(self) -> DataFrame:
        """(subsystem, kind, n): how many objects of each kind the migrations leave or make."""
        made = self.facts.where("what = 'symbol' AND op LIKE 'create_%' AND op <> 'create_table'").groupBy("subsystem", "kind").agg(F.countDistinct("name").alias("n"))
        return made.unionByName(self.folded.groupBy("subsystem").agg(F.count("*").alias("n")).select("subsystem", F.lit("table").alias("kind"), "n"))

    def calibrate(self, accept: bool = False, track: bool = False, coarsen: bool = False) -> DataFrame:
        """(subsystem, change, target, detail): what manifests and source disagree on."""
        s = self.facts.where("what = 'symbol' AND exported AND subsystem IS NOT NULL")
        gen = self.files.select("path", P.is_generated(F.col("text")).alias("generated"))
        actual = calibrate.first_declarations(s).join(gen, "path")
        outer = self.frames["exposes"].select("subsystem", "name", "internal")
        shown = calibrate.exposes(outer, actual, self.consumed, self.dark, accept)
        known = self.frames["subsystems"].select("subsystem")
        declared = self.frames["consumes"].select("consumer", "provider", F.explode_outer("interfaces").alias("name"))
        t = self.targets.where("consumer IS NOT NULL AND consumer <> provider")
        # A member counts only for providers that are declared: a name alone is weak evidence of a new edge.
        known_edges = declared.select("consumer", "provider").distinct().withColumn("known", F.lit(True))
        t = t.join(known_edges, ["consumer", "provider"], "left").where("NOT member OR known")
        e = self.exposes.select(F.col("subsystem").alias("provider"), "name")
        names = t.select("consumer", "provider", F.explode_outer("names").alias("name")).join(e.withColumn("e", F.lit(True)), ["provider", "name"], "left")
        used = names.select("consumer", "provider", F.when(F.col("e"), F.col("name")).alias("name")).distinct()
        return shown.unionByName(calibrate.consumes(declared, used, e, known, track, coarsen))

    def apply_calibration(self, prune_unknown: bool = False, **how: bool) -> list[str]:
        """Write what calibrate() finds into the manifests; the subsystems that changed."""
        rows: dict[str, list] = {}
        for r in self.calibrate(**how).where(F.col("change") != "needs_review").collect():  # changes of one repository's manifests
            rows.setdefault(r.subsystem, []).append((r.change, r.target, r.detail))
        return [n for n in sorted(rows) if manifests.apply_changes(self.root, n, rows[n], prune_unknown)]

    def drift_gate(self) -> DataFrame:
        """(key, status): differences that the baseline does not have, and those that are gone."""
        base = manifests.read_keys(self._baseline("drift")) or set()
        keys = self.spark.createDataFrame([("\t".join(k),) for k in sorted(base)], "key string")
        return calibrate.drift_check(calibrate.drift_keys(self.calibrate()), keys)

    def dump_baselines(self) -> None:
        """Accept the present drift, cycles and surfaces."""
        manifests.write_keys(self._baseline("drift"), {tuple(r.key.split("\t")) for r in calibrate.drift_keys(self.calibrate()).collect()})
        manifests.write_keys(self._baseline("cycles"), {tuple(c) for c in self.cycles()})
        self.confirm_surface()

    def discover(self, merges: list[tuple[str, str]] = ()) -> DataFrame:
        """(folder, n, confidence): folders of unclaimed sources that could be subsystems; merges are (name, prefix)."""
        free = self.files.join(self.owners, "path", "left_anti").where(~P.is_test_file(F.col("path"))).select("path", "language")
        frame = self.spark.createDataFrame([(k, n, p) for k, (n, p) in enumerate(merges)], "ord int, name string, prefix string") if merges else None
        self._grouped = discover.grouped(free, frame)
        s = discover.scored(self._grouped, [n for n, _ in merges]).where("kept")
        return s.select(F.col("candidate").alias("folder"), "n", F.col("score").alias("confidence")).orderBy("folder")

    def proposals(self, merges: list[tuple[str, str]] = (), namespace: str | None = None) -> dict[str, dict]:
        """Manifests for what discover() finds, by name: the folder with its slashes as dashes."""
        found = self.discover(merges).collect()  # candidates of one repository
        kept = self.spark.createDataFrame([(r.folder,) for r in found], "candidate string")
        g = self._grouped.select("path", "candidate")
        home = g.join(kept, "candidate", "left_semi").unionByName(self.owners.select("path", F.col("owner").alias("candidate")))
        i = self.facts.where("what = 'import'").select("path", "ord", imports.stems_udf(self.aliases)("path", "name").alias("stems"))
        hit = imports.resolve(self.files.select("path"), i, ["path", "ord"])
        e = hit.join(home.select("path", F.col("candidate").alias("consumer")), "path").join(home.select(F.col("path").alias("target"), F.col("candidate").alias("provider")), "target")
        every = kept.unionByName(self.frames["subsystems"].select(F.col("subsystem").alias("candidate"))).distinct()
        e = graph._saved(self.spark, discover.edges(e, every))
        roles = {r.id: r for r in discover.roles(graph.degrees(every.select(F.col("candidate").alias("id")), e)).collect()}
        gen = self.files.select("path", P.is_generated(F.col("text")).alias("generated"))
        s = self.facts.where("what = 'symbol'").select("path", "ord", "name", "kind", "exported").join(g.join(kept, "candidate", "left_semi"), "path").join(gen, "path")
        shows: dict[str, list] = {}
        for r in discover.surface(s).orderBy("candidate", "name").collect():
            shows.setdefault(r.candidate, []).append({"name": r.name, "kind": r.kind})
        uses: dict[str, list] = {}
        for r in e.orderBy("u", "v").collect():
            uses.setdefault(r.u, []).append({"subsystem": r.v.replace("/", "-")})
        merged: dict[str, list] = {}
        for n, p in merges:
            merged.setdefault(n, []).append(p)
        out = {}
        for r in found:
            doc = {"role": roles[r.folder].role, "criticality": roles[r.folder].criticality, **({"namespace": namespace} if namespace else {}), "paths": merged.get(r.folder, [r.folder]), "exposes": shows.get(r.folder, []), "consumes": uses.get(r.folder, [])}
            out[r.folder.replace("/", "-")] = doc
        return out

    def apply_discovery(self, merges: list[tuple[str, str]] = (), namespace: str | None = None) -> list[str]:
        """Write the proposals; manifests that exist stay as they are."""
        return [n for n, doc in self.proposals(merges, namespace).items() if manifests.NAME.match(n) and manifests.add_subsystem(self.root, n, doc)]

    def state(self) -> DataFrame:
        structure = extract.structure_hash(self.facts)
        f = self.files.join(self.owners, "path", "left").join(structure, "path", "left")
        return f.select("path", F.col("owner").alias("subsystem"), "language", "content_hash", "structure_hash")

    def refreshed(self, saved: DataFrame, changed: list[str]) -> DataFrame:
        """The state after a quick run: only changed files are extracted anew, the rest comes from the saved one."""
        rows = self.spark.createDataFrame([(c,) for c in changed], "path string")
        now = self.state().join(rows, "path", "left_semi")
        return incremental.merged(now.select(*saved.columns), saved, self.files.select("path"), self.owners)

    def changes(self, saved: DataFrame) -> DataFrame:
        return incremental.compared(self.files.select("path", "content_hash"), saved.select("path", "content_hash"))
