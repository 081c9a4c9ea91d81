"""Named queries over the stand-in relations, each beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codemap_spark.functions import paths as P
from codemap_spark.functions.keyed import sides
from codemap_spark.operators import calibrate, checks, coverage, discover, fold, graph, imports, incremental, locate, ownership, rawsql
from codemap_spark.sources import extract
from codemap_spark.sources import tables as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SUPPORTED = ["de", "en", "fr"]

# The stand-in relations as SQL, put before a query as needed.
CTE = {
    "node": "node AS (SELECT n_nationkey::BIGINT AS id, n_name AS name, r_name AS namespace, ['service','platform','connector','library'][n_nationkey % 4 + 1] AS role, ['core','connector','leaf'][n_nationkey % 3 + 1] AS criticality FROM nation JOIN region ON n_regionkey = r_regionkey)",
    "edge": "edge AS (SELECT DISTINCT c_nationkey::BIGINT AS u, s_nationkey::BIGINT AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey AND (c_nationkey * 7 + s_nationkey * 13) % 25 < 1)",
    "edge2": "edge2 AS (SELECT DISTINCT c_nationkey::BIGINT AS u, s_nationkey::BIGINT AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey AND (c_nationkey * 7 + s_nationkey * 13) % 25 < 2)",
    "edges": "edges AS (SELECT DISTINCT c_nationkey::BIGINT AS u, s_nationkey::BIGINT AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey)",
    "declared": "declared AS (SELECT DISTINCT l_suppkey AS subsystem, l_partkey AS name FROM lineitem WHERE l_linestatus = 'O')",
    "actual": "actual AS (SELECT DISTINCT l_suppkey AS subsystem, l_partkey AS name FROM lineitem WHERE l_linestatus = 'F')",
    "consumed": "consumed AS (SELECT DISTINCT o_custkey AS consumer, l_suppkey AS provider, l_partkey AS name FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' OR l_shipdate >= TIMESTAMP '1998-01-01')",
    "file": "file AS (SELECT source || '/' || lang || '/' || doc_id || '.' || lang AS path, lang AS language, source, doc_id, text FROM documents)",
    "claim": "claim AS (SELECT 's' || n AS owner, source AS prefix FROM src UNION ALL SELECT 's' || n || '_en', source || '/en' FROM src WHERE n % 2 = 0 UNION ALL SELECT 't' || n, source FROM src WHERE n % 5 = 0)",
    "src": "src AS (SELECT DISTINCT source, regexp_extract(source, '(\\d+)', 1)::INT AS n FROM documents)",
    "claimed": "claimed AS (SELECT path, owner, max(len(string_split(prefix, '/')) + 1) AS spec FROM file JOIN claim ON path LIKE prefix || '/%' GROUP BY 1, 2)",
    "owner": "owner AS (SELECT path, owner, spec FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY spec DESC, owner) AS r FROM claimed) WHERE r = 1)",
    "page_file": "page_file AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '^/+|/+$', '', 'g') AS path FROM pages)",
    "page_import": "page_import AS (SELECT page_id, 0::BIGINT AS ord, 'en/' || (page_id * 37 % 1000) AS module FROM page_file UNION ALL SELECT page_id, 1, 'en/' || regexp_extract(path, '(\\d+)$', 1) FROM page_file)",
    "oplog": "oplog AS (SELECT user_id AS tbl, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, MAP {'signup':'create_table','view':'add_column','click':'drop_column','error':'drop_table','purchase':'rename_column'}[event_type] AS op, json_extract_string(props, '$.k') AS col FROM events)",
    "live": "live AS (SELECT tbl, col FROM (SELECT o.tbl, o.col, arg_max(o.op, o.seq) AS op FROM oplog o JOIN (SELECT tbl, coalesce(max(seq) FILTER (op IN ('create_table','drop_table')), 0) AS reset FROM oplog GROUP BY 1) r ON r.tbl = o.tbl WHERE o.op IN ('add_column','drop_column') AND o.col IS NOT NULL AND o.seq > reset GROUP BY 1, 2) WHERE op = 'add_column')",
    "now": "now AS (SELECT path, sha256(text) AS content_hash FROM file)",
    "prev": "prev AS (SELECT path, sha256(CASE WHEN doc_id % 10 = 3 THEN text || '!' ELSE text END) AS content_hash FROM file WHERE doc_id % 10 <> 7 UNION ALL SELECT 'old/' || path, sha256(text) FROM file WHERE doc_id % 25 = 0)",
    "missing": "missing AS (SELECT * FROM declared EXCEPT SELECT * FROM actual)",
    "issue": "issue AS (SELECT 'E_STRUCTURAL_DRIFT' AS code, 'error' AS severity, subsystem::VARCHAR AS subsystem, 'missing ' || name AS message FROM missing UNION ALL SELECT 'E_ORPHAN_EXPORT', 'warning', subsystem::VARCHAR, 'orphan ' || name FROM orphan)",
    "orphan": "orphan AS (SELECT subsystem, name FROM declared d WHERE subsystem IN (SELECT provider FROM consumed) AND NOT EXISTS (SELECT 1 FROM consumed c WHERE c.provider = d.subsystem AND c.name = d.name))",
    "rule": "rule AS (SELECT * FROM (VALUES (1, 'E_ORPHAN_EXPORT', '3', NULL, 'suppress'), (2, 'E_ORPHAN_EXPORT', NULL, '7', 'error'), (3, NULL, NULL, 'missing 1', 'warning'), (4, 'E_STRUCTURAL_DRIFT', '5', NULL, 'suppress')) t(rule_ord, code, subsystem, contains, action))",
    "judged": "judged AS (SELECT code, subsystem, message, CASE WHEN action = 'suppress' THEN 'info' ELSE coalesce(action, severity) END AS severity, coalesce(action = 'suppress', false) AS suppressed FROM (SELECT i.*, r.action, row_number() OVER (PARTITION BY i.code, i.severity, i.subsystem, i.message ORDER BY rule_ord NULLS LAST) AS k FROM issue i LEFT JOIN rule r ON (r.code IS NULL OR r.code = i.code) AND (r.subsystem IS NULL OR r.subsystem = i.subsystem) AND (r.contains IS NULL OR contains(i.message, r.contains))) WHERE k = 1)",
    "reach": "reach AS (SELECT u AS src, v AS dst FROM edge UNION SELECT r.src, e.v FROM reach r JOIN edge e ON r.dst = e.u)",
    "reach2": "reach2 AS (SELECT u AS src, v AS dst FROM edge2 UNION SELECT r.src, e.v FROM reach2 r JOIN edge2 e ON r.dst = e.u)",
}
NEEDS = {"claim": ["src"], "claimed": ["file", "src", "claim"], "owner": ["file", "src", "claim", "claimed"], "page_import": ["page_file"], "live": ["oplog"], "now": ["file"], "prev": ["file"], "missing": ["declared", "actual"], "orphan": ["declared", "consumed"], "issue": ["declared", "actual", "missing", "consumed", "orphan"], "judged": ["declared", "actual", "missing", "consumed", "orphan", "issue", "rule"], "reach": ["edge"], "reach2": ["edge2"]}


def query(cte: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; cte names the relations that its SQL needs."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            names = list(dict.fromkeys(x for c in cte.split() for x in [*NEEDS.get(c, []), c]))
            ORACLES[f.__name__] = ("WITH RECURSIVE " + ",\n".join(CTE[n] for n in names) + "\n" if names else "") + sql
        return f

    return put


def found_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = checks.issues(drift_missing(spark, sf_dir), "E_STRUCTURAL_DRIFT", "subsystem", F.concat(F.lit("missing "), F.col("name").cast("string")))
    return one.unionByName(checks.issues(orphan_exports(spark, sf_dir), "E_ORPHAN_EXPORT", "subsystem", F.concat(F.lit("orphan "), F.col("name").cast("string"))))


def policy_rules(spark: SparkSession) -> DataFrame:
    rows = [(1, "E_ORPHAN_EXPORT", "3", None, "suppress"), (2, "E_ORPHAN_EXPORT", None, "7", "error"), (3, None, None, "missing 1", "warning"), (4, "E_STRUCTURAL_DRIFT", "5", None, "suppress")]
    return spark.createDataFrame(rows, "rule_ord int, code string, subsystem string, contains string, action string")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.apply_policy(found_issues(spark, sf_dir), policy_rules(spark))


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.nodes(spark, sf_dir).where("id % 5 = 2").select("id")


def owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.owners(S.files(spark, sf_dir).select("path"), S.claims(spark, sf_dir))


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.files(spark, sf_dir).select("path", F.sha2("text", 256).alias("content_hash"))


# --- graph -----------------------------------------------------------------------------------


@query("reach", "SELECT src, dst FROM reach")
def transitive_closure(spark, sf_dir):
    return graph.transitive_closure(spark, S.edges(spark, sf_dir))


@query("node reach", "SELECT t.name AS target, count(*) AS radius, string_agg(c.name, ',' ORDER BY c.name) AS consumers FROM reach JOIN node t ON t.id = dst JOIN node c ON c.id = src WHERE src <> dst GROUP BY 1")
def entry_blast_radius(spark, sf_dir):
    n = S.nodes(spark, sf_dir).select("id", "name")
    r = graph.blast_radius(spark, S.edges(spark, sf_dir))
    r = r.join(n.toDF("target", "tn"), "target").join(n.toDF("consumer", "cn"), "consumer")
    return r.groupBy(F.col("tn").alias("target")).agg(F.count("*").alias("radius"), F.array_join(F.array_sort(F.collect_list("cn")), ",").alias("consumers"))


@query("node edge2", """, p AS (
  SELECT id AS seed, id AS node, 0 AS depth, CASE criticality WHEN 'core' THEN -1 WHEN 'connector' THEN 1 ELSE 0 END AS most FROM node WHERE id % 5 = 2
  UNION SELECT seed, u, CASE WHEN most = -1 THEN 0 ELSE depth + 1 END, most FROM p JOIN edge2 ON p.node = edge2.v WHERE most = -1 OR depth < most)
SELECT DISTINCT node AS id FROM p WHERE node % 5 <> 2""")  # fmt: skip
def propagate_bounded(spark, sf_dir):
    return graph.propagate(spark, S.edges(spark, sf_dir, 2), S.nodes(spark, sf_dir), dirty(spark, sf_dir))


@query("edge2", "SELECT v AS provider, string_agg(u::VARCHAR, ',' ORDER BY u) AS consumers, count(*) AS n FROM edge2 GROUP BY 1")
def consumer_index(spark, sf_dir):
    return graph.consumer_index(S.edges(spark, sf_dir, 2))


@query("node edge2", "SELECT id, (SELECT count(*) FROM edge2 WHERE v = id) AS fan_in, (SELECT count(*) FROM edge2 WHERE u = id) AS fan_out FROM node")
def fan_in_out(spark, sf_dir):
    return graph.degrees(S.nodes(spark, sf_dir), S.edges(spark, sf_dir, 2))


@query("node edges", "SELECT id, fan_in, fan_out FROM (SELECT id, (SELECT count(*) FROM edges WHERE v = id) AS fan_in, (SELECT count(*) FROM edges WHERE u = id) AS fan_out, (SELECT count(*) FROM node) AS n FROM node) WHERE n >= 8 AND fan_in * 2 >= n - 1 AND fan_out * 2 >= n - 1")
def composition_root(spark, sf_dir):
    return graph.composition_roots(S.nodes(spark, sf_dir), S.edges(spark, sf_dir, 25))


@query("node edge2", "SELECT id, CASE WHEN i > 0 AND o = 0 THEN 'library' WHEN i > 0 THEN 'platform' ELSE 'service' END AS role, CASE WHEN i >= 3 THEN 'core' WHEN i >= 1 THEN 'connector' ELSE 'leaf' END AS criticality FROM (SELECT id, (SELECT count(*) FROM edge2 WHERE v = id) AS i, (SELECT count(*) FROM edge2 WHERE u = id) AS o FROM node)")
def infer_role_criticality(spark, sf_dir):
    return graph.inferred(S.nodes(spark, sf_dir), S.edges(spark, sf_dir, 2))


@query("claim", ", pairs AS (SELECT o.owner AS outer_, i.owner AS inner_, i.prefix FROM claim o JOIN claim i ON o.owner <> i.owner AND i.prefix LIKE o.prefix || '/%'), f AS (SELECT outer_, inner_ FROM pairs GROUP BY 1, 2 HAVING count(DISTINCT prefix) = (SELECT count(DISTINCT prefix) FROM claim WHERE owner = inner_)) SELECT outer_ AS \"outer\", inner_ AS \"inner\" FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.outer_ = f.inner_ AND g.inner_ = f.outer_)")
def containment_pairs(spark, sf_dir):
    return graph.containment(S.claims(spark, sf_dir))


@query("reach2", ", m AS (SELECT a.src AS id, min(a.dst) AS component FROM reach2 a JOIN reach2 b ON a.src = b.dst AND a.dst = b.src GROUP BY 1) SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM m")
def scc_members(spark, sf_dir):
    return graph.components(spark, S.edges(spark, sf_dir, 2))


@query()
def dfs_cycles(spark, sf_dir):
    return graph.cycles(S.edges(spark, sf_dir, 2))


@query()
def feedback_edges(spark, sf_dir):
    return graph.feedback_edges(S.edges(spark, sf_dir, 2))


# --- ownership and coverage --------------------------------------------------------------------


@query("owner", "SELECT path, owner, spec::INT AS spec FROM owner")
def owner_most_specific(spark, sf_dir):
    return owned(spark, sf_dir)


@query("claimed", "SELECT contenders, count(*) AS n_files FROM (SELECT path, string_agg(owner, ',' ORDER BY owner) AS contenders, count(*) AS k FROM (SELECT *, max(spec) OVER (PARTITION BY path) AS m FROM claimed) WHERE spec = m GROUP BY 1) WHERE k > 1 GROUP BY 1")
def owner_overlap(spark, sf_dir):
    return ownership.overlaps(S.files(spark, sf_dir).select("path"), S.claims(spark, sf_dir))


@query("claim page_file", """, d AS (SELECT DISTINCT path FROM page_file), n AS (SELECT DISTINCT lang AS owner FROM documents),
folder AS (SELECT path, min(owner) AS o FROM (SELECT path, unnest(string_split(path, '/')[:-2]) AS owner FROM d) JOIN n USING (owner) GROUP BY 1)
SELECT d.path, folder.o AS owner FROM d LEFT JOIN folder USING (path)""")  # fmt: skip
def doc_owner_linkage(spark, sf_dir):
    names = S.table(spark, sf_dir, "documents").select(F.col("lang").alias("owner")).distinct()
    return ownership.linked(S.page_files(spark, sf_dir).select("path").distinct(), S.claims(spark, sf_dir), names)


@query("file owner", """, t AS (SELECT 'tests/' || owner || '/t' || doc_id || '_test.py' AS path, owner AS e FROM file JOIN owner USING (path) WHERE doc_id % 3 = 0)
SELECT path, CASE WHEN e IN (SELECT owner FROM claim) THEN e END AS owner FROM t""")  # fmt: skip
def test_owner_linkage(spark, sf_dir):
    f = S.files(spark, sf_dir).where("doc_id % 3 = 0").select("path", "doc_id").join(owned(spark, sf_dir), "path")
    tests = f.select(F.concat(F.lit("tests/"), "owner", F.lit("/t"), F.col("doc_id").cast("string"), F.lit("_test.py")).alias("path"))
    return ownership.linked(tests, S.claims(spark, sf_dir), S.claims(spark, sf_dir).select("owner").distinct())


@query("file owner", """, t AS (SELECT 'tests/' || owner || '/t' || doc_id || '_test.py' AS path, owner AS e FROM file JOIN owner USING (path))
SELECT path, CASE WHEN e IN (SELECT owner FROM claim) THEN e END AS owner FROM t""")  # fmt: skip
def test_owner_linkage_all(spark, sf_dir):
    f = S.files(spark, sf_dir).select("path", "doc_id").join(owned(spark, sf_dir), "path")
    tests = f.select(F.concat(F.lit("tests/"), "owner", F.lit("/t"), F.col("doc_id").cast("string"), F.lit("_test.py")).alias("path"))
    return ownership.linked(tests, S.claims(spark, sf_dir), S.claims(spark, sf_dir).select("owner").distinct())


_COVER = """, c AS (SELECT language, path, owner FROM file LEFT JOIN (SELECT path, owner FROM owner WHERE owner NOT LIKE '%\\_en' ESCAPE '\\') o USING (path)),
g AS (SELECT language, count(*) AS total, count(*) FILTER (language IN ('de','en','fr')) AS supported, count(*) FILTER (language IN ('de','en','fr') AND owner IS NOT NULL) AS mapped, count(*) FILTER (language NOT IN ('de','en','fr') AND owner IS NULL) AS dark FROM c GROUP BY 1)
"""


@query("owner", _COVER + "SELECT *, (CASE WHEN supported = 0 THEN 1000 WHEN mapped < supported THEN least(floor(mapped * 1000 / supported + 0.5), 999) ELSE floor(mapped * 1000 / supported + 0.5) END)::BIGINT AS permille FROM g")
def coverage_by_language(spark, sf_dir):
    return ownership.coverage(S.files(spark, sf_dir), owned(spark, sf_dir).where("owner NOT LIKE '%\\\\_en'"), SUPPORTED)


@query("owner", _COVER + "SELECT sum(total)::BIGINT AS total, sum(supported)::BIGINT AS supported, sum(mapped)::BIGINT AS mapped, sum(dark)::BIGINT AS dark FROM g")
def coverage_mapping(spark, sf_dir):
    return coverage_by_language(spark, sf_dir).agg(*(F.sum(c).alias(c) for c in ("total", "supported", "mapped", "dark")))


@query("owner", """, g AS (SELECT path, language, owner, lower(substr(text, 1, 4096)) AS t FROM file LEFT JOIN (SELECT path, owner FROM owner WHERE owner NOT LIKE '%\\_en' ESCAPE '\\') o USING (path))
SELECT path, CASE WHEN contains(t, '@generated') OR contains(t, 'do not edit') OR contains(t, 'autogenerated') OR contains(t, 'auto-generated') OR contains(t, 'code generated by') OR contains(t, 'generated by') OR contains(t, 'this file is generated') THEN 'generated'
 WHEN language NOT IN ('de','en','fr') AND owner IS NOT NULL THEN 'declared_unsupported' WHEN language NOT IN ('de','en','fr') THEN 'dark' WHEN owner IS NOT NULL THEN 'mapped' ELSE 'unowned' END AS status FROM g""")  # fmt: skip
def coverage_explain(spark, sf_dir):
    return ownership.explain(S.files(spark, sf_dir), owned(spark, sf_dir).where("owner NOT LIKE '%\\\\_en'"), SUPPORTED)


@query("file owner", "SELECT owner, language, count(*) AS n, sum(length(text))::BIGINT AS chars FROM file JOIN owner USING (path) GROUP BY GROUPING SETS ((owner), (language), ())")
def inspect_grouping_sets(spark, sf_dir):
    f = S.files(spark, sf_dir).withColumn("chars", F.length("text")).drop("text").join(owned(spark, sf_dir), "path")
    f.createOrReplaceTempView("codemap_inspect")
    return spark.sql("SELECT owner, language, count(*) AS n, sum(chars) AS chars FROM codemap_inspect GROUP BY GROUPING SETS ((owner), (language), ())")


# --- imports -------------------------------------------------------------------------------------


@query("page_import", """, st AS (SELECT regexp_replace(path, '([^/])\\.[^./]+$', '\\1') AS stem, min(path) AS path FROM page_file GROUP BY 1),
parts AS (SELECT stem, string_split(stem, '/') AS p FROM st), suf AS (SELECT array_to_string(p[k:], '/') AS suffix, min(stem) AS stem FROM parts, unnest(range(1, len(p) + 1)) u(k) GROUP BY 1)
SELECT i.page_id, i.ord, coalesce(a.path, b.path) AS target FROM page_import i LEFT JOIN st a ON a.stem = i.module LEFT JOIN suf s ON s.suffix = i.module LEFT JOIN st b ON b.stem = s.stem WHERE coalesce(a.path, b.path) IS NOT NULL""")  # fmt: skip
def import_resolution(spark, sf_dir):
    i = S.page_imports(spark, sf_dir).withColumn("stems", F.array("module"))
    return imports.resolve(S.page_files(spark, sf_dir).select("path").distinct(), i, ["page_id", "ord"])


@query("page_file", """, st AS (SELECT DISTINCT regexp_replace(path, '([^/])\\.[^./]+$', '\\1') AS stem FROM page_file), parts AS (SELECT stem, string_split(stem, '/') AS p FROM st)
SELECT array_to_string(p[k:], '/') AS suffix, min(stem) AS stem FROM parts, unnest(range(1, len(p) + 1)) u(k) GROUP BY 1""")  # fmt: skip
def suffix_index(spark, sf_dir):
    return imports.suffix_index(S.page_files(spark, sf_dir).select("path").distinct())


@query("page_import", """, parts AS (SELECT string_split(regexp_replace(path, '([^/])\\.[^./]+$', '\\1'), '/') AS p FROM page_file), suf AS (SELECT DISTINCT array_to_string(p[k:], '/') AS suffix FROM parts, unnest(range(1, len(p) + 1)) u(k))
SELECT page_id, ord, module FROM page_import WHERE module NOT IN (SELECT suffix FROM suf)""")  # fmt: skip
def unresolved_local_imports(spark, sf_dir):
    i = S.page_imports(spark, sf_dir)
    return i.join(import_resolution(spark, sf_dir), ["page_id", "ord"], "left_anti").select("page_id", "ord", "module")


# --- drift, contracts, impact ----------------------------------------------------------------------


@query("missing", "SELECT subsystem, name FROM missing")
def drift_missing(spark, sf_dir):
    return checks.drift_missing(S.surface_lines(spark, sf_dir, "O"), S.surface_lines(spark, sf_dir, "F"), S.tasks(spark, sf_dir))


@query("declared actual", """, e AS (SELECT a.subsystem, lpad(a.name::VARCHAR, 8, '0') AS name FROM actual a WHERE NOT EXISTS (SELECT 1 FROM declared d WHERE d.subsystem = a.subsystem AND d.name = a.name) AND subsystem IN (SELECT subsystem FROM declared)), l AS (SELECT subsystem, count(*) AS n, list(name ORDER BY name) AS s FROM e GROUP BY 1)
SELECT subsystem, n, array_to_string(s[1:5], ', ') || CASE WHEN n > 5 THEN ', +' || (n - 5) || ' more' ELSE '' END AS sample FROM l""")  # fmt: skip
def drift_undeclared_rollup(spark, sf_dir):
    return checks.drift_undeclared(S.surface(spark, sf_dir, "O"), S.surface(spark, sf_dir, "F"))


@query("consumed declared", "SELECT consumer, provider, name FROM consumed c WHERE provider IN (SELECT subsystem FROM declared) AND NOT EXISTS (SELECT 1 FROM declared d WHERE d.subsystem = c.provider AND d.name = c.name)")
def contract_missing(spark, sf_dir):
    return checks.contract_missing(S.consumed(spark, sf_dir), S.surface(spark, sf_dir, "O"))


@query("consumed", "SELECT DISTINCT consumer, provider FROM consumed WHERE provider NOT IN (SELECT l_suppkey FROM lineitem WHERE l_linestatus = 'O' AND l_suppkey % 7 <> 0)")
def unresolved_reference(spark, sf_dir):
    return checks.unresolved(S.consumed(spark, sf_dir), S.surface(spark, sf_dir, "O").where("subsystem % 7 <> 0"))


@query("consumed actual declared", "SELECT consumer, provider, name FROM consumed c WHERE consumer <> provider AND EXISTS (SELECT 1 FROM actual a WHERE a.subsystem = c.provider AND a.name = c.name) AND NOT EXISTS (SELECT 1 FROM declared d WHERE d.subsystem = c.provider AND d.name = c.name)")
def boundary_violations(spark, sf_dir):
    hit = checks.boundary(S.consumed_lines(spark, sf_dir), S.surface_lines(spark, sf_dir, "F"), S.surface_lines(spark, sf_dir, "O"), S.tasks(spark, sf_dir))
    return hit.select("consumer", "provider", "name").distinct()


@query("orphan", "SELECT subsystem, name FROM orphan")
def orphan_exports(spark, sf_dir):
    return checks.orphans(S.surface_lines(spark, sf_dir, "O"), S.consumed_lines(spark, sf_dir), S.tasks(spark, sf_dir))


@query("edge2", "SELECT u AS consumer, string_agg(v::VARCHAR, ',' ORDER BY v) AS providers FROM edge2 WHERE v % 5 = 2 GROUP BY 1")
def cross_impact(spark, sf_dir):
    return checks.cross_impact(S.edges(spark, sf_dir, 2), dirty(spark, sf_dir))


@query("edge edge2", "SELECT u, v FROM edge2 EXCEPT SELECT u, v FROM edge")
def undeclared_consumers(spark, sf_dir):
    return checks.undeclared_edges(S.edges(spark, sf_dir, 2), S.edges(spark, sf_dir))


@query("node", "SELECT a.name AS name, min(b.name) AS suggestion FROM node a JOIN node b ON levenshtein(a.name, b.name) = 1 GROUP BY 1")
def typo_suggest(spark, sf_dir):
    n = S.nodes(spark, sf_dir).select("name")
    # Names of equal or neighbouring length only; a manifest's names are few.
    a, b = n.select("name", F.explode(F.array(F.length("name") - 1, F.length("name"), F.length("name") + 1)).alias("len")), n.select(F.col("name").alias("other"), F.length("name").alias("len"))
    return a.join(b, "len").where(F.levenshtein("name", "other", 1) == 1).groupBy("name").agg(F.min("other").alias("suggestion"))


# --- lookups -----------------------------------------------------------------------------------------


@query("", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_name = (SELECT min(p_name) FROM part)")
def where_exact(spark, sf_dir):
    p = S.table(spark, sf_dir, "part")
    least = p.agg(F.min("p_name").alias("p_name"))
    return p.join(F.broadcast(least), "p_name", "left_semi").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("", "SELECT p_partkey AS id, p_name AS name FROM part WHERE starts_with(p_brand, 'Brand#1')")
def where_prefix(spark, sf_dir):
    return S.table(spark, sf_dir, "part").where(F.col("p_brand").startswith("Brand#1")).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("node", "SELECT name, row_number() OVER (ORDER BY name) AS rank FROM node WHERE contains(lower(name), 'a') OR contains(lower(namespace), 'asia') ORDER BY name LIMIT 8")
def where_suggest(spark, sf_dir):
    from pyspark.sql import Window

    hit = S.nodes(spark, sf_dir).where(F.lower("name").contains("a") | F.lower("namespace").contains("asia"))
    return hit.select("name", F.row_number().over(Window.orderBy("name")).cast("long").alias("rank")).where("rank <= 8")


@query("node edge2", "SELECT namespace, name, role, criticality, (SELECT count(*) FROM edge2 WHERE v = id) AS consumed_by FROM node")
def list_subsystems(spark, sf_dir):
    n = S.nodes(spark, sf_dir)
    return n.join(graph.degrees(n, S.edges(spark, sf_dir, 2)), "id").select("namespace", "name", "role", "criticality", F.col("fan_in").alias("consumed_by"))


@query("declared actual", "SELECT d.subsystem, count(*) AS declared, count(a.name) AS verified FROM declared d LEFT JOIN actual a USING (subsystem, name) GROUP BY 1")
def describe_verify(spark, sf_dir):
    d, a = S.surface(spark, sf_dir, "O"), S.surface(spark, sf_dir, "F").withColumn("hit", F.lit(1))
    return d.join(a, ["subsystem", "name"], "left").groupBy("subsystem").agg(F.count("*").alias("declared"), F.count("hit").alias("verified"))


@query("node edge2", "SELECT role, criticality, count(*) AS n, sum((SELECT count(*) FROM edge2 WHERE u = id))::BIGINT AS edges FROM node GROUP BY 1, 2")
def overview_counts(spark, sf_dir):
    n = S.nodes(spark, sf_dir)
    return n.join(graph.degrees(n, S.edges(spark, sf_dir, 2)), "id").groupBy("role", "criticality").agg(F.count("*").alias("n"), F.sum("fan_out").alias("edges"))


@query("consumed", "SELECT name, count(DISTINCT consumer) AS direct, min(provider) AS provider FROM consumed GROUP BY 1")
def impact_interface(spark, sf_dir):
    return S.consumed(spark, sf_dir).groupBy("name").agg(F.countDistinct("consumer").alias("direct"), F.min("provider").alias("provider"))


# --- schema fold ---------------------------------------------------------------------------------------


@query("live", "SELECT tbl, col FROM live")
def fold_live_columns(spark, sf_dir):
    return fold.live_columns(S.oplog(spark, sf_dir))


@query("oplog", "SELECT tbl, count(*) FILTER (op = 'create_table') AS n_on, arg_max(op, seq) = 'create_table' AS enabled FROM oplog WHERE op IN ('create_table', 'drop_table') GROUP BY 1")
def policy_liveness(spark, sf_dir):
    return fold.liveness(S.oplog(spark, sf_dir), "create_table", "drop_table")


@query("oplog live", """, r AS (SELECT tbl, arg_max(op, seq) = 'create_table' AS enabled FROM oplog WHERE op IN ('create_table', 'drop_table') GROUP BY 1), p AS (SELECT tbl, count(*) AS n FROM live GROUP BY 1)
SELECT CASE WHEN coalesce(enabled, false) AND coalesce(n, 0) > 0 THEN 'protected' WHEN coalesce(enabled, false) THEN 'locked' ELSE 'open' END AS status, count(*) AS n_tables FROM (SELECT DISTINCT tbl FROM oplog) LEFT JOIN r USING (tbl) LEFT JOIN p USING (tbl) GROUP BY 1""")  # fmt: skip
def rls_posture(spark, sf_dir):
    log = S.oplog(spark, sf_dir)
    return fold.posture(log.select("tbl").distinct(), fold.liveness(log, "create_table", "drop_table"), fold.live_columns(log))


@query("live", "SELECT tbl, sha256(tbl || '|' || string_agg(DISTINCT col, ',' ORDER BY col)) AS hash FROM live GROUP BY 1")
def catalog_hash(spark, sf_dir):
    return fold.catalog_hash(fold.live_columns(S.oplog(spark, sf_dir)))


@query("", "SELECT source AS subsystem, doc_id || '_up.sql' AS path, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN doc_id % 4 = 0 THEN doc_id % 3 END NULLS LAST, lpad(doc_id::VARCHAR, 32, '0'), doc_id || '_up.sql') AS rank FROM documents")
def migration_order(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    return fold.migration_order(d.select(F.col("source").alias("subsystem"), F.concat(F.col("doc_id").cast("string"), F.lit("_up.sql")).alias("path"), F.when(F.col("doc_id") % 4 == 0, F.col("doc_id") % 3).alias("explicit")))


@query("oplog", "SELECT op, col, count(DISTINCT tbl) AS n, min(tbl) AS first FROM oplog GROUP BY 1, 2")
def dedup_objects(spark, sf_dir):
    return S.oplog(spark, sf_dir).groupBy("op", "col").agg(F.countDistinct("tbl").alias("n"), F.min("tbl").alias("first"))


@query()
def fold_with_renames(spark, sf_dir):
    log = S.oplog(spark, sf_dir)
    to = F.concat(F.lit("r"), "col")
    return fold.fold_tables(log.select((F.col("tbl") % 16).cast("string").alias("subsystem"), F.col("seq").alias("rank"), F.col("tbl").alias("ord"), "op", F.col("tbl").cast("string").alias("tbl"), "col", F.lit(None).cast("array<string>").alias("columns"), to.alias("to")))


# --- hashing and texts -----------------------------------------------------------------------------------


@query("now", "SELECT path, content_hash FROM now")
def content_hash(spark, sf_dir):
    return hashed(spark, sf_dir)


@query("", """SELECT path, sha256(array_to_string(list_concat(list_sort(list(r) FILTER (r LIKE 'sym:%')), list_sort(list(DISTINCT r) FILTER (r LIKE 'imp:%'))), chr(10))) AS structure_hash FROM (
  SELECT l_suppkey::VARCHAR AS path, 'sym:' || l_linestatus || ':' || l_partkey || ':{}' AS r FROM lineitem UNION ALL SELECT l_suppkey::VARCHAR, 'imp:' || l_returnflag FROM lineitem) GROUP BY 1""")
def structure_hash(spark, sf_dir):
    li = S.table(spark, sf_dir, "lineitem")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("op", "string"), ("tbl", "string"), ("col", "string"), ("columns", "array<string>"), ("target", "string"))]
    sym = li.select(F.col("l_suppkey").cast("string").alias("path"), F.lit("symbol").alias("what"), F.col("l_linestatus").alias("kind"), F.col("l_partkey").cast("string").alias("name"), *none)
    imp = li.select(F.col("l_suppkey").cast("string").alias("path"), F.lit("import").alias("what"), F.lit(None).cast("string").alias("kind"), F.col("l_returnflag").alias("name"), *none)
    return extract.structure_hash(sym.unionByName(imp))


_SEVEN = " OR ".join(f"contains(t, '{m}')" for m in P.GENERATED)


@query("", f"SELECT doc_id, {_SEVEN} AS generated, contains(t, 'license') OR contains(t, 'the and') AS marked FROM (SELECT doc_id, lower(substr(text || CASE doc_id % 5 WHEN 0 THEN ' @Generated' WHEN 1 THEN repeat('x', 4096) || ' do not edit' ELSE '' END, 1, 4096)) AS t FROM documents)")
def generated_marker(spark, sf_dir):
    tail = F.when(F.col("doc_id") % 5 == 0, " @Generated").when(F.col("doc_id") % 5 == 1, F.concat(F.repeat(F.lit("x"), 4096), F.lit(" do not edit"))).otherwise("")
    t = S.table(spark, sf_dir, "documents").select("doc_id", F.concat("text", tail).alias("t"))
    return t.select("doc_id", P.is_generated(F.col("t")).alias("generated"), P.is_generated(F.col("t"), ("license", "the and")).alias("marked"))


@query("", "SELECT tbl, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '(?i)\\b(?:from|join|into|update)\\s+([A-Za-z_][A-Za-z0-9_.]*)', 1))) AS tbl FROM documents) GROUP BY 1")
def raw_sql_refs(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents").select("doc_id", F.explode(P.table_refs(F.col("text"))).alias("tbl"))
    return d.groupBy("tbl").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("", "SELECT href, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY 1")
def import_extract(spark, sf_dir):
    h = S.table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return h.groupBy("href").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


# --- incremental ---------------------------------------------------------------------------------------------


@query("file owner now prev", "SELECT path, 'changed' AS change FROM now JOIN prev USING (path) WHERE now.content_hash <> prev.content_hash UNION ALL SELECT path, 'new' FROM now WHERE path NOT IN (SELECT path FROM prev)")
def dirty_files(spark, sf_dir):
    return incremental.compared(hashed(spark, sf_dir), S.previous_state(spark, sf_dir)).where("change IN ('changed', 'new')")


@query("now prev", "SELECT path FROM prev EXCEPT SELECT path FROM now")
def deleted_files(spark, sf_dir):
    return incremental.compared(hashed(spark, sf_dir), S.previous_state(spark, sf_dir)).where("change = 'deleted'").select("path")


@query("now prev", "SELECT count(*) AS hits FROM now JOIN prev USING (path, content_hash)")
def cache_hits(spark, sf_dir):
    return hashed(spark, sf_dir).join(S.previous_state(spark, sf_dir), ["path", "content_hash"], "left_semi").agg(F.count("*").alias("hits"))


@query("missing", ", b AS (SELECT l_suppkey AS subsystem, l_partkey AS name FROM lineitem WHERE l_linestatus = 'O' AND l_partkey % 3 = 0 GROUP BY 1, 2) SELECT subsystem, name, 'new' AS change FROM (SELECT * FROM missing EXCEPT SELECT * FROM b) UNION ALL SELECT subsystem, name, 'resolved' FROM (SELECT * FROM b EXCEPT SELECT * FROM missing)")
def baseline_new_resolved(spark, sf_dir):
    return incremental.baseline_diff(drift_missing(spark, sf_dir), S.surface_lines(spark, sf_dir, "O").where("name % 3 = 0"), S.tasks(spark, sf_dir))


@query("now prev", "SELECT p.path, CASE WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS why FROM prev p LEFT JOIN now n USING (path) WHERE n.path IS NULL OR n.content_hash <> p.content_hash")
def surface_stale(spark, sf_dir):
    return incremental.surface_stale(S.previous_state(spark, sf_dir), hashed(spark, sf_dir))


# --- policy and reports -----------------------------------------------------------------------------------------


@query("judged", "SELECT code, subsystem, message, severity, suppressed FROM judged")
def policy_apply(spark, sf_dir):
    return judged(spark, sf_dir)


@query("judged", "SELECT code, severity, sum(CASE WHEN code = 'E_ORPHAN_EXPORT' THEN length(message) ELSE 1 END)::BIGINT AS n FROM judged GROUP BY 1, 2")
def issue_tally(spark, sf_dir):
    return checks.tally(judged(spark, sf_dir).withColumn("count", F.when(F.col("code") == "E_ORPHAN_EXPORT", F.length("message"))))


@query("judged", "SELECT code, subsystem, message, severity, suppressed, row_number() OVER (ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, code, coalesce(subsystem, ''), message) AS rank FROM judged")
def report_order(spark, sf_dir):
    return checks.ranked(judged(spark, sf_dir), S.tasks(spark, sf_dir))


@query("judged", "SELECT severity || chr(9) || code || chr(9) || coalesce(subsystem, '-') || chr(9) || message AS line FROM judged")
def ci_tsv(spark, sf_dir):
    return checks.tsv(judged(spark, sf_dir))


@query("judged", "SELECT CASE WHEN count(*) FILTER (severity = 'error' AND NOT suppressed) > 0 THEN 'stale' ELSE 'fresh' END AS status, count(*) FILTER (severity = 'error' AND NOT suppressed) > 0 AS blocked FROM judged")
def gate_status(spark, sf_dir):
    return checks.gate(judged(spark, sf_dir))


@query("declared actual consumed", """SELECT subsystem, 'remove' AS change, count(*) AS n FROM (SELECT subsystem, name FROM declared EXCEPT SELECT subsystem, name FROM actual) WHERE (subsystem, name) NOT IN (SELECT provider, name FROM consumed) GROUP BY 1
UNION ALL SELECT subsystem, 'needs_review', count(*) FROM (SELECT subsystem, name FROM declared EXCEPT SELECT subsystem, name FROM actual) WHERE (subsystem, name) IN (SELECT provider, name FROM consumed) GROUP BY 1
UNION ALL SELECT subsystem, 'add', count(*) FROM (SELECT subsystem, name FROM actual EXCEPT SELECT subsystem, name FROM declared) GROUP BY 1""")  # fmt: skip
def calibrate_proposals(spark, sf_dir):
    used = S.consumed_lines(spark, sf_dir).select(F.col("provider").alias("subsystem"), "name")
    per = sides(S.tasks(spark, sf_dir), ["subsystem", "name"], S.surface_lines(spark, sf_dir, "O"), S.surface_lines(spark, sf_dir, "F"), used)
    change = F.when(F.col("side") == 1, "remove").when(F.col("side") == 5, "needs_review").when(F.col("side").isin(2, 6), "add")
    return per.select("subsystem", change.alias("change")).where("change IS NOT NULL").groupBy("subsystem", "change").agg(F.count("*").alias("n"))


@query("file", "SELECT source || '/' || language AS folder, count(*) AS n, CASE WHEN count(*) >= 5 THEN 'high' WHEN count(*) >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM file GROUP BY 1")
def discover_candidates(spark, sf_dir):
    f = S.files(spark, sf_dir).groupBy(F.concat_ws("/", "source", "language").alias("folder")).agg(F.count("*").alias("n"))
    return f.withColumn("confidence", F.when(F.col("n") >= 5, "high").when(F.col("n") >= 3, "medium").otherwise("low"))


@query("claim", "SELECT DISTINCT prefix AS path FROM claim c WHERE NOT EXISTS (SELECT 1 FROM claim d WHERE c.prefix LIKE d.prefix || '/%')")
def minimal_paths(spark, sf_dir):
    p = S.claims(spark, sf_dir).select(F.col("prefix").alias("path")).distinct()
    above = p.select("path", F.explode(P.prefixes(F.col("path"))).alias("up")).where("path <> up").join(p.select(F.col("path").alias("up")), "up")
    return p.join(above.select("path").distinct(), "path", "left_anti")


# --- calibration -----------------------------------------------------------------------------------------------------


def expose_changes(spark: SparkSession, sf_dir: str, accept: bool = False) -> DataFrame:
    """Every seventh interface is private, every eleventh symbol generated; every fifth subsystem has files without an extractor."""
    d = S.surface_lines(spark, sf_dir, "O").withColumn("internal", F.col("name") % 7 == 0)
    a = S.surface_lines(spark, sf_dir, "F").select("*", F.lit("class").alias("kind"), (F.col("name") % 11 == 0).alias("generated"))
    return calibrate.exposes(d, a, S.consumed_lines(spark, sf_dir), d.select("subsystem").where("subsystem % 5 = 0"), accept, S.tasks(spark, sf_dir))


CTE["review"] = "review AS (SELECT d.subsystem, d.name, CASE WHEN d.subsystem % 5 = 0 THEN 'unsupported_language' WHEN (d.subsystem, d.name) IN (SELECT provider, name FROM consumed) THEN 'consumed_contract' END AS reason FROM declared d WHERE d.name % 7 <> 0 AND (d.subsystem, d.name) NOT IN (SELECT subsystem, name FROM actual))"
CTE["expose_change"] = "expose_change AS (SELECT subsystem, 'add_expose' AS change, name::VARCHAR AS target, 'class' AS detail FROM (SELECT * FROM actual EXCEPT SELECT * FROM declared) WHERE name % 11 <> 0 UNION ALL SELECT subsystem, 'remove_expose', name::VARCHAR, NULL FROM review WHERE reason IS NULL UNION ALL SELECT subsystem, 'needs_review', name::VARCHAR, reason FROM review WHERE reason IS NOT NULL)"
NEEDS["review"] = ["declared", "actual", "consumed"]
NEEDS["expose_change"] = ["declared", "actual", "consumed", "review"]


@query("expose_change", "SELECT * FROM expose_change")
def calibrate_exposes(spark, sf_dir):
    return expose_changes(spark, sf_dir)


@query("review", "SELECT subsystem, count(*) FILTER (reason IS DISTINCT FROM 'unsupported_language') AS removed, count(*) FILTER (reason = 'unsupported_language') AS held FROM review GROUP BY 1")
def calibrate_accept(spark, sf_dir):
    gone = expose_changes(spark, sf_dir, accept=True).where("change <> 'add_expose'")
    return gone.groupBy("subsystem").agg(F.count_if(F.col("change") == "remove_expose").alias("removed"), F.count_if(F.col("change") == "needs_review").alias("held"))


@query("expose_change", "SELECT subsystem || chr(9) || change || chr(9) || target AS key FROM expose_change WHERE change <> 'needs_review'")
def calibrate_drift_keys(spark, sf_dir):
    return calibrate.drift_keys(expose_changes(spark, sf_dir), S.tasks(spark, sf_dir))


@query("expose_change", "SELECT change, count(*) AS n, count(DISTINCT subsystem) AS subsystems FROM expose_change GROUP BY 1")
def calibrate_summary(spark, sf_dir):
    return calibrate.summary(expose_changes(spark, sf_dir))


@query("expose_change", "SELECT subsystem, true AS any, bool_or(change <> 'needs_review') AS applicable FROM expose_change GROUP BY 1")
def calibrate_changed(spark, sf_dir):
    return calibrate.changed(expose_changes(spark, sf_dir))


@query("expose_change", """, k AS (SELECT subsystem || chr(9) || change || chr(9) || target AS key, target::BIGINT AS n FROM expose_change WHERE change <> 'needs_review'), b AS (SELECT key FROM k WHERE n % 3 <> 0 UNION ALL SELECT '0' || chr(9) || 'add_expose' || chr(9) || 'x' || n_nationkey FROM nation)
SELECT key, 'new' AS status FROM (SELECT key FROM k EXCEPT SELECT key FROM b) UNION ALL SELECT key, 'resolved' FROM (SELECT key FROM b EXCEPT SELECT key FROM k)""")  # fmt: skip
def calibrate_drift_check(spark, sf_dir):
    k = calibrate.drift_keys(expose_changes(spark, sf_dir), S.tasks(spark, sf_dir))
    old = S.table(spark, sf_dir, "nation").select(F.concat(F.lit("0\tadd_expose\tx"), F.col("n_nationkey").cast("string")).alias("key"))
    base = k.where(F.split("key", "\t")[2].cast("long") % 3 != 0).unionByName(old)
    return calibrate.drift_check(k, base, S.tasks(spark, sf_dir))


def consume_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Declared edges are those of returned lines, some without names; used ones those of late lines; suppliers are the providers that exist, one in nine is not."""
    li, o = S.table(spark, sf_dir, "lineitem"), S.table(spark, sf_dir, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey).select((F.col("o_custkey") % 97).alias("consumer"), F.col("l_suppkey").alias("provider"), F.col("l_partkey").alias("name"), "l_returnflag", "l_shipdate")
    declared = j.where("l_returnflag = 'R'").select("consumer", "provider", F.when(F.col("provider") % 4 != 0, F.col("name")).alias("name")).distinct()
    used = j.where("l_shipdate >= TIMESTAMP '1998-01-01'").select("consumer", "provider", "name").distinct()
    known = S.table(spark, sf_dir, "supplier").where("s_suppkey % 9 <> 4").select(F.col("s_suppkey").alias("subsystem"))
    exposed = S.surface(spark, sf_dir, "O").select(F.col("subsystem").alias("provider"), "name")
    return declared, used, exposed, known


CTE["line"] = "line AS (SELECT o_custkey % 97 AS consumer, l_suppkey AS provider, l_partkey AS name, l_returnflag, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
CTE["dec"] = "dec AS (SELECT DISTINCT consumer, provider, CASE WHEN provider % 4 <> 0 THEN name END AS name FROM line WHERE l_returnflag = 'R')"
CTE["known"] = "known AS (SELECT s_suppkey AS provider FROM supplier WHERE s_suppkey % 9 <> 4)"
CTE["use"] = "use AS (SELECT DISTINCT consumer, provider, name FROM line WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND provider IN (SELECT provider FROM known))"
CTE["usen"] = "usen AS (SELECT * FROM use WHERE (provider, name) IN (SELECT subsystem, name FROM declared))"
CTE["stale"] = "stale AS (SELECT * FROM dec WHERE name IS NOT NULL AND provider IN (SELECT provider FROM known) AND (provider, name) NOT IN (SELECT subsystem, name FROM declared))"
for _k, _v in {"dec": ["line"], "use": ["line", "known"], "usen": ["line", "known", "use", "declared"], "stale": ["line", "dec", "known", "declared"]}.items():
    NEEDS[_k] = _v


@query("usen stale", """, e AS (SELECT consumer, provider, bool_or(name IS NOT NULL) AS tracked FROM dec GROUP BY 1, 2), o AS (SELECT consumer, name, min(provider) AS owner FROM usen GROUP BY 1, 2)
SELECT consumer AS subsystem, 'add_consume' AS change, provider::VARCHAR AS target, NULL::VARCHAR AS detail FROM (SELECT consumer, provider FROM use EXCEPT SELECT consumer, provider FROM e)
UNION ALL SELECT consumer, 'add_consume_interface', provider::VARCHAR, name::VARCHAR FROM usen u WHERE EXISTS (SELECT 1 FROM e WHERE e.consumer = u.consumer AND e.provider = u.provider AND tracked) AND NOT EXISTS (SELECT 1 FROM dec d WHERE d.consumer = u.consumer AND d.provider = u.provider AND d.name = u.name)
UNION ALL SELECT consumer, 'unknown_consume', provider::VARCHAR, NULL FROM e WHERE provider NOT IN (SELECT provider FROM known)
UNION ALL SELECT consumer, 'remove_consume_edge', provider::VARCHAR, NULL FROM e WHERE provider IN (SELECT provider FROM known) AND NOT EXISTS (SELECT 1 FROM use u WHERE u.consumer = e.consumer AND u.provider = e.provider)
UNION ALL SELECT consumer, 'remove_consume_interface', provider::VARCHAR, name::VARCHAR FROM stale s WHERE EXISTS (SELECT 1 FROM use u WHERE u.consumer = s.consumer AND u.provider = s.provider)
UNION ALL SELECT s.consumer, 'reattribute_consume', owner::VARCHAR, s.provider || ':' || s.name FROM stale s JOIN o USING (consumer, name) WHERE owner <> s.provider""")  # fmt: skip
def calibrate_consumes(spark, sf_dir):
    return calibrate.consumes(*consume_tables(spark, sf_dir))


@query("usen dec", """, e AS (SELECT DISTINCT consumer, provider FROM dec)
SELECT consumer AS subsystem, 'coarsen_consume' AS change, provider::VARCHAR AS target, string_agg(name::VARCHAR, ',' ORDER BY name) AS detail FROM dec WHERE name IS NOT NULL GROUP BY 1, 3
UNION ALL SELECT u.consumer, 'add_consume', u.provider::VARCHAR, coalesce(string_agg(n.name::VARCHAR, ',' ORDER BY n.name), '') FROM (SELECT consumer, provider FROM use EXCEPT SELECT consumer, provider FROM e) u LEFT JOIN usen n USING (consumer, provider) GROUP BY 1, 3""")  # fmt: skip
def calibrate_coarsen_and_track(spark, sf_dir):
    return calibrate.consumes(*consume_tables(spark, sf_dir), track=True, coarsen=True).where("change IN ('coarsen_consume', 'add_consume')")


@query("", "SELECT subsystem, name, kind, path FROM (SELECT source AS subsystem, n_chars % 50 AS name, lang AS kind, lpad(doc_id::VARCHAR, 9, '0') AS path, row_number() OVER (PARTITION BY source, n_chars % 50 ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def first_declaration(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    return calibrate.first_declarations(d.select(F.col("source").alias("subsystem"), (F.col("n_chars") % 50).alias("name"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.lit(0).alias("ord"), F.col("lang").alias("kind")))


# --- coverage ----------------------------------------------------------------------------------------------------------


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files with ignore rules, tests and build configurations among them; Spanish has no extractor, files of ten digits no source."""
    d = S.files(spark, sf_dir)
    name = F.when(F.col("doc_id") % 17 == 1, "config").when(F.col("doc_id") % 19 == 2, F.concat(F.lit("test_"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"), F.concat_ws(".", name, "language"))
    return d.select(path.alias("path"), F.when(F.col("doc_id") % 23 != 3, F.col("language")).alias("language"), (F.col("doc_id") % 13 == 4).alias("ignored"), (F.col("doc_id") % 29 == 5).alias("gitignored"))


CTE["tree"] = "tree AS (SELECT source || '/' || doc_id || '/' || CASE WHEN doc_id % 17 = 1 THEN 'config' WHEN doc_id % 19 = 2 THEN 'test_' || doc_id ELSE doc_id::VARCHAR END || '.' || lang AS path, CASE WHEN doc_id % 23 <> 3 THEN lang END AS language, doc_id, regexp_extract(source, '(\\d+)', 1)::INT AS n FROM documents)"
CTE["class"] = "class AS (SELECT path, language, doc_id, CASE WHEN doc_id % 13 = 4 THEN 'ignored' WHEN doc_id % 29 = 5 THEN 'gitignored' WHEN doc_id % 17 <> 1 AND doc_id % 19 = 2 THEN 'test_file' WHEN language IS NULL THEN 'non_source' WHEN language IN ('de','en','fr') AND n % 3 = 0 THEN 'mapped' WHEN language IN ('de','en','fr') AND doc_id % 17 = 1 THEN 'algorithm_miss' WHEN language IN ('de','en','fr') THEN 'user_decision' WHEN n % 3 = 0 THEN 'declared' ELSE 'dark' END AS class, n FROM tree)"
NEEDS["class"] = ["tree"]


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    own = t.where(F.regexp_extract("path", r"^\D*(\d+)", 1).cast("int") % 3 == 0).select("path", F.lit("s").alias("owner"))
    return coverage.classify(t, own, SUPPORTED)


@query("class", "SELECT path, class FROM class")
def coverage_classes(spark, sf_dir):
    return classified(spark, sf_dir).select("path", "class")


@query("class", """, c AS (SELECT count(*) FILTER (class = 'mapped') AS mapped, count(*) FILTER (class = 'user_decision') AS user_decision, count(*) FILTER (class = 'algorithm_miss') AS algorithm_miss, count(*) FILTER (class = 'declared') AS declared, count(*) FILTER (class = 'dark') AS dark, count(*) FILTER (class = 'ignored') AS ignored, count(*) FILTER (class = 'gitignored') AS gitignored, count(*) FILTER (class = 'test_file') AS test_file, count(*) FILTER (class = 'non_source') AS non_source FROM class), s AS (SELECT mapped + user_decision + algorithm_miss AS supported, * FROM c)
SELECT *, (CASE WHEN supported = 0 THEN 1000 WHEN mapped < supported THEN least(floor(mapped * 1000 / supported + 0.5), 999) ELSE 1000 END)::BIGINT AS permille, user_decision + algorithm_miss + dark > 0 AS gap FROM s""")  # fmt: skip
def coverage_summary(spark, sf_dir):
    return coverage.has_gap(coverage.mapping(classified(spark, sf_dir)))


@query("class", ", l AS (SELECT class, count(*) AS n, list(DISTINCT path ORDER BY path) AS s FROM class WHERE class IN ('user_decision', 'algorithm_miss', 'dark') GROUP BY 1) SELECT class, n, array_to_string(s[1:10], ', ') || CASE WHEN len(s) > 10 THEN ', +' || (len(s) - 10) || ' more' ELSE '' END AS sample FROM l")
def coverage_diagnose(spark, sf_dir):
    return coverage.samples(classified(spark, sf_dir))


@query("class", "SELECT CASE WHEN m > 0 THEN 'fix-coverage --auto' || CASE WHEN u > 0 THEN ', then assign ' || u || ' files' ELSE '' END WHEN u > 0 THEN 'assign ' || u || ' files' WHEN d > 0 THEN 'declare ' || d || ' files' ELSE 'complete' END AS next_step FROM (SELECT count(*) FILTER (class = 'algorithm_miss') AS m, count(*) FILTER (class = 'user_decision') AS u, count(*) FILTER (class = 'dark') AS d FROM class)")
def coverage_next_step(spark, sf_dir):
    return coverage.next_step(coverage.mapping(classified(spark, sf_dir)))


@query("class", """, asked AS (SELECT DISTINCT CASE doc_id % 4 WHEN 1 THEN '/abs/' || path WHEN 2 THEN 'x/../../' || path WHEN 3 THEN path || '.gone' ELSE path END AS path FROM class)
SELECT a.path, CASE WHEN a.path LIKE '/%' OR a.path LIKE 'x/../%' THEN 'outside_project' WHEN class IS NULL THEN 'not_found' ELSE MAP {'ignored':'excluded_by_design','gitignored':'excluded_by_design','test_file':'excluded_test','non_source':'non_source','mapped':'owned','declared':'unsupported_declared','dark':'unsupported_declarable','algorithm_miss':'algorithm_miss','user_decision':'needs_your_decision'}[class] END AS status, CASE WHEN class IN ('mapped', 'declared') THEN 's' END AS owner FROM asked a LEFT JOIN class USING (path)""")  # fmt: skip
def coverage_why(spark, sf_dir):
    c = classified(spark, sf_dir)
    d = F.regexp_extract("path", r"/(\d+)/", 1).cast("long") % 4
    asked = c.select(F.when(d == 1, F.concat(F.lit("/abs/"), "path")).when(d == 2, F.concat(F.lit("x/../../"), "path")).when(d == 3, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("path"))
    return coverage.explain(c, asked).select("path", "status", "owner")


@query("class", "SELECT path FROM class WHERE class = 'algorithm_miss' AND n % 2 = 0")
def coverage_auto_rules(spark, sf_dir):
    c = classified(spark, sf_dir)
    return coverage.auto_rules(c, c.where(F.regexp_extract("path", r"^\D*(\d+)", 1).cast("int") % 2 != 0).select("path"))


@query("class", "SELECT language, count(*) AS n FROM class WHERE class IN ('declared', 'dark') GROUP BY 1")
def coverage_dark_languages(spark, sf_dir):
    return coverage.by_language(classified(spark, sf_dir))


@query("claim page_file", """, d AS (SELECT DISTINCT path FROM page_file), n AS (SELECT DISTINCT lang AS owner FROM documents),
folder AS (SELECT path, min(owner) AS o FROM (SELECT path, unnest(string_split(path, '/')[:-2]) AS owner FROM d) JOIN n USING (owner) GROUP BY 1)
SELECT count(*) AS total, count(folder.o) AS linked, count(*) FILTER (folder.o IS NULL) AS unlinked FROM d LEFT JOIN folder USING (path)""")  # fmt: skip
def coverage_linkage(spark, sf_dir):
    return coverage.linkage(doc_owner_linkage(spark, sf_dir))


# --- looking things up ---------------------------------------------------------------------------------------------------


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols: a brand is a subsystem, a type its file."""
    p = S.table(spark, sf_dir, "part")
    return p.select(F.col("p_name").alias("name"), F.col("p_size").alias("line"), F.lower("p_type").alias("kind"), F.col("p_brand").alias("subsystem"), F.concat_ws("/", "p_brand", "p_type").alias("path"), F.col("p_partkey").alias("id"))


@query("", "SELECT DISTINCT p_name AS name, p_size AS line, lower(p_type) AS kind, p_brand AS subsystem, p_name LIKE '%widget%' AS exposed FROM part WHERE p_brand || '/' || p_type = (SELECT min(p_brand || '/' || p_type) FROM part)")
def where_path(spark, sf_dir):
    s = parts(spark, sf_dir)
    first = s.agg(F.min("path")).first()[0]
    return locate.by_path(s, s.where("name LIKE '%widget%'").select("subsystem", "name"), first or "").distinct()


@query("", "SELECT name, subsystem FROM (SELECT DISTINCT p_name AS name, p_brand AS subsystem FROM part WHERE contains(lower(p_name), 'bolt') ORDER BY 1, 2 LIMIT 8)")
def where_near_symbols(spark, sf_dir):
    return locate.near_symbols(parts(spark, sf_dir), "BOLT")


@query("node", "SELECT name AS subsystem, CASE WHEN contains(lower(name), 'an') THEN 'name' ELSE 'description' END AS matched_on FROM node WHERE contains(lower(name), 'an') OR contains(lower(namespace), 'an') ORDER BY name LIMIT 6")
def where_near_subsystems(spark, sf_dir):
    return locate.near_subsystems(S.nodes(spark, sf_dir).select(F.col("name").alias("subsystem"), F.col("namespace").alias("description")), "AN")


@query("edge reach consumed", """, c AS (SELECT DISTINCT c_nationkey::BIGINT AS id FROM consumed JOIN customer ON consumer = c_custkey WHERE name = (SELECT min(name) FROM consumed))
SELECT id AS consumer, true AS direct FROM c UNION ALL SELECT DISTINCT src, false FROM reach WHERE dst IN (SELECT id FROM c) AND src NOT IN (SELECT id FROM c)""")  # fmt: skip
def impact_closure(spark, sf_dir):
    used = S.consumed(spark, sf_dir).join(S.table(spark, sf_dir, "customer"), F.col("consumer") == F.col("c_custkey")).select(F.col("c_nationkey").cast("long").alias("consumer"), "name")
    least = S.consumed(spark, sf_dir).agg(F.min("name")).first()[0]
    return locate.interface_impact(spark, used, S.edges(spark, sf_dir), least)


@query("", "SELECT conv_id, turn, regexp_matches(lower(t), 'architecture|where (is|are)|what (uses|breaks)') AS asks FROM (SELECT conv_id, turn, text || CASE turn % 4 WHEN 0 THEN ' Where is it?' WHEN 1 THEN ' the architecture' WHEN 2 THEN ' What uses it' ELSE '' END AS t FROM conversations)")
def prompt_shapes(spark, sf_dir):
    tail = F.element_at(F.array(F.lit(" Where is it?"), F.lit(" the architecture"), F.lit(" What uses it"), F.lit("")), (F.col("turn") % 4 + 1).cast("int"))
    return S.table(spark, sf_dir, "conversations").select("conv_id", "turn", locate.is_architectural(F.concat("text", tail)).alias("asks"))


@query("", "SELECT DISTINCT conv_id * 1000 + turn AS id FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '([a-z_][a-z0-9_]{2,})', 1)) AS w FROM conversations) WHERE w IN (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) FROM part UNION SELECT 'the') OR w IN (SELECT lower(n_name) FROM nation)")
def prompt_targets(spark, sf_dir):
    c = S.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    shown = S.table(spark, sf_dir, "part").select(F.split("p_name", " ")[0].alias("name")).unionByName(c.limit(1).select(F.lit("the").alias("name")))
    return locate.covered_targets(c, shown, S.nodes(spark, sf_dir).select(F.col("name").alias("subsystem")))


@query("", "SELECT user_id, event_type, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def session_markers(spark, sf_dir):
    return locate.once(S.table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"])


@query("edge edge2", "SELECT u AS consumer, v AS provider, 1::BIGINT AS n_files FROM edge2 WHERE (u, v) NOT IN (SELECT u, v FROM edge)")
def impact_undeclared_files(spark, sf_dir):
    used = S.edges(spark, sf_dir, 2).select(F.col("u").alias("consumer"), F.col("v").alias("provider"), F.concat_ws("/", F.col("u").cast("string"), F.col("v").cast("string")).alias("path"))
    return locate.undeclared(used, S.edges(spark, sf_dir).toDF("consumer", "provider"))


# --- discovery -----------------------------------------------------------------------------------------------------------


@query("file", ", c AS (SELECT CASE WHEN n % 6 = 0 THEN 'sixth' ELSE source || '/' || language END AS candidate, count(*) AS n FROM (SELECT *, regexp_extract(source, '(\\d+)', 1)::INT AS n FROM file) GROUP BY 1) SELECT candidate, n, CASE WHEN n >= 5 THEN 'high' WHEN n >= 3 THEN 'medium' ELSE 'low' END AS score, n >= 3 OR candidate = 'sixth' AS kept FROM c")
def discover_scored(spark, sf_dir):
    f = S.files(spark, sf_dir).select("path", "language")
    merges = f.select(F.split("path", "/")[0].alias("prefix")).distinct().where(F.regexp_extract("prefix", r"(\d+)", 1).cast("int") % 6 == 0).select(F.lit(0).alias("ord"), F.lit("sixth").alias("name"), "prefix")
    return discover.scored(discover.grouped(f, merges), ["sixth"])


@query("edge2 node", "SELECT u, v FROM edge2 WHERE u % 4 <> 1 AND v % 4 <> 1")
def discover_edges(spark, sf_dir):
    e = S.edges(spark, sf_dir, 2)
    return discover.edges(e.toDF("consumer", "provider"), S.nodes(spark, sf_dir).where("id % 4 <> 1").select(F.col("id").alias("candidate")))


@query("node edge2", "SELECT id, CASE WHEN i >= 3 THEN 'library' WHEN o > 0 AND i = 0 THEN 'service' WHEN o > 0 THEN 'connector' ELSE 'library' END AS role, CASE WHEN i >= 3 THEN 'core' WHEN i >= 1 THEN 'connector' ELSE 'leaf' END AS criticality FROM (SELECT id, (SELECT count(*) FROM edge2 WHERE v = id) AS i, (SELECT count(*) FROM edge2 WHERE u = id) AS o FROM node)")
def discover_roles(spark, sf_dir):
    return discover.roles(graph.degrees(S.nodes(spark, sf_dir), S.edges(spark, sf_dir, 2)))


@query("", """SELECT candidate, name, kind, path FROM (SELECT source AS candidate, CASE WHEN doc_id % 5 = 0 THEN 'test_' ELSE 's' END || n_chars % 40 AS name, CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE 'class' END AS kind, p AS path, row_number() OVER (PARTITION BY source, name ORDER BY doc_id % 3 = 0, p) AS r
FROM (SELECT *, CASE doc_id % 7 WHEN 0 THEN 'tests/' WHEN 1 THEN 'app/' ELSE 'lib/' END || doc_id || CASE WHEN doc_id % 7 = 1 THEN '/page.tsx' ELSE '/x.ts' END AS p FROM documents)
WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND doc_id % 7 <> 1 AND NOT (doc_id % 7 = 0 AND doc_id % 5 = 0)) WHERE r = 1""")  # fmt: skip
def discover_surface(spark, sf_dir):
    d, i = S.table(spark, sf_dir, "documents"), F.col("doc_id")
    path = F.concat(F.when(i % 7 == 0, "tests/").when(i % 7 == 1, "app/").otherwise("lib/"), i.cast("string"), F.when(i % 7 == 1, "/page.tsx").otherwise("/x.ts"))
    name = F.concat(F.when(i % 5 == 0, "test_").otherwise("s"), (F.col("n_chars") % 40).cast("string"))
    return discover.surface(d.select(F.col("source").alias("candidate"), path.alias("path"), F.lit(0).alias("ord"), name.alias("name"), F.when(i % 3 == 0, "unknown").otherwise("class").alias("kind"), (i % 11 != 0).alias("exported"), (i % 13 == 0).alias("generated")))


# --- imports, texts and state ------------------------------------------------------------------------------------------------


@query("page_import", """, st AS (SELECT regexp_replace(path, '([^/])\\.[^./]+$', '\\1') AS stem, min(path) AS path FROM page_file GROUP BY 1), pp AS (SELECT stem, string_split(stem, '/') AS p FROM st), suf AS (SELECT array_to_string(p[k:], '/') AS stem, min(stem) AS full FROM pp, unnest(range(1, len(p) + 1)) u(k) GROUP BY 1),
c AS (SELECT page_id, ord, 0 AS c, module || '/none' AS stem FROM page_import UNION ALL SELECT page_id, ord, 1, 'de/' || split_part(module, '/', 2) FROM page_import UNION ALL SELECT page_id, ord, 2, module FROM page_import),
h AS (SELECT page_id, ord, c * 4 AS prio, st.path FROM c JOIN st USING (stem) UNION ALL SELECT page_id, ord, c * 4 + 3, st.path FROM c JOIN suf USING (stem) JOIN st ON st.stem = suf.full)
SELECT page_id, ord, arg_min(path, prio) AS target FROM h GROUP BY 1, 2""")  # fmt: skip
def import_candidates(spark, sf_dir):
    m = F.col("module")
    i = S.page_imports(spark, sf_dir).withColumn("stems", F.array(F.concat(m, F.lit("/none")), F.concat(F.lit("de/"), F.split(m, "/")[1]), m))
    return imports.resolve(S.page_files(spark, sf_dir).select("path").distinct(), i, ["page_id", "ord"])


@query("page_import", "SELECT page_id, ord, starts_with(module, '.') OR split_part(replace(module, '.', '/'), '/', 1) IN ('de', 'en') AS is_local FROM (SELECT page_id, ord, CASE ord + page_id % 3 WHEN 0 THEN '.' || module WHEN 1 THEN 'os.path' ELSE module END AS module FROM page_import)")
def local_looking(spark, sf_dir):
    k = F.col("ord") + F.col("page_id") % 3
    module = F.when(k == 0, F.concat(F.lit("."), "module")).when(k == 1, "os.path").otherwise(F.col("module"))
    return S.page_imports(spark, sf_dir).select("page_id", "ord", P.is_local_looking(module, F.array(F.lit("de"), F.lit("en"))).alias("is_local"))


@query("", """, r AS (SELECT DISTINCT path, tbl, via FROM (SELECT path, unnest(regexp_extract_all(t, '(?i)\\b(?:from|join|into|update|delete\\s+from)\\s+["''`\\[]?([A-Za-z_][A-Za-z0-9_.]*)', 0)) AS m FROM (SELECT source || '/' || doc_id AS path, 'select * from ' || lang || '.t' || doc_id % 30 || ' join u' || doc_id % 7 || '; DELETE  FROM v' || doc_id % 5 || '; insert into w' || doc_id % 3 AS t FROM documents))
, LATERAL (SELECT string_split(regexp_extract(m, '([A-Za-z_][A-Za-z0-9_.]*)$', 1), '.')[-1] AS tbl, CASE WHEN regexp_matches(m, '(?i)^(into|update|delete)') THEN 'writes' ELSE 'reads' END AS via))
SELECT tbl, split_part(path, '/', 1) AS subsystem, via, count(DISTINCT path) AS n_files FROM r GROUP BY 1, 2, 3""".replace(", r AS", "WITH r AS", 1))  # fmt: skip
def raw_sql_consumers(spark, sf_dir):
    d, i = S.table(spark, sf_dir, "documents"), lambda n: (F.col("doc_id") % n).cast("string")
    text = F.concat(F.lit("select * from "), "lang", F.lit(".t"), i(30), F.lit(" join u"), i(7), F.lit("; DELETE  FROM v"), i(5), F.lit("; insert into w"), i(3))
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    claimants = d.select(path.alias("path"), F.explode(F.array("source", F.lit("zzz"))).alias("owner"))
    return rawsql.consumers(d.select(path.alias("path"), text.alias("literal")), claimants)


@query("now prev", "SELECT path, content_hash FROM now WHERE path NOT LIKE '%7.%' UNION ALL SELECT path, content_hash FROM prev WHERE (path NOT IN (SELECT path FROM now) OR path LIKE '%7.%') AND path IN (SELECT path FROM now)")
def state_merged(spark, sf_dir):
    h = hashed(spark, sf_dir)
    return incremental.merged(h.where("path NOT LIKE '%7.%'"), S.previous_state(spark, sf_dir), live=h)


@query("now prev", "SELECT DISTINCT split_part(path, '/', 1) AS subsystem FROM prev WHERE path NOT IN (SELECT path FROM now)")
def vanished_owners(spark, sf_dir):
    s = S.previous_state(spark, sf_dir).withColumn("subsystem", F.split("path", "/")[0])
    return incremental.vanished_owners(s, hashed(spark, sf_dir))


@query("now prev", "SELECT path, content_hash FROM prev WHERE path IN (SELECT path FROM now)")
def state_pruned(spark, sf_dir):
    return incremental.pruned(S.previous_state(spark, sf_dir), hashed(spark, sf_dir))


@query("orphan", ", l AS (SELECT subsystem, count(*) AS n, list(DISTINCT name::VARCHAR ORDER BY name::VARCHAR) AS s FROM orphan GROUP BY 1) SELECT subsystem, n, array_to_string(s[1:5], ', ') || CASE WHEN len(s) > 5 THEN ', +' || (len(s) - 5) || ' more' ELSE '' END AS sample FROM l")
def orphan_rollup(spark, sf_dir):
    return checks.orphan_rollup(orphan_exports(spark, sf_dir))


@query("judged", "SELECT DISTINCT 3::INTEGER AS step, 'calibrate' AS action FROM judged WHERE code = 'E_STRUCTURAL_DRIFT'")
def remediation_ladder(spark, sf_dir):
    return checks.ladder(judged(spark, sf_dir))


@query("node edge2", """, d AS (SELECT id FROM node WHERE id % 5 = 2), p AS (SELECT id AS seed, id AS node, 0 AS depth, CASE criticality WHEN 'core' THEN -1 WHEN 'connector' THEN 1 ELSE 0 END AS most FROM node WHERE id % 5 = 2
  UNION SELECT seed, u, CASE WHEN most = -1 THEN 0 ELSE depth + 1 END, most FROM p JOIN edge2 ON p.node = edge2.v WHERE most = -1 OR depth < most), x AS (SELECT DISTINCT node AS id FROM p WHERE node % 5 <> 2)
SELECT x.id AS consumer, (SELECT string_agg(v::VARCHAR, ',' ORDER BY v) FROM edge2 WHERE u = x.id AND v % 5 = 2) AS providers FROM x""")  # fmt: skip
def stale_interfaces(spark, sf_dir):
    e, d = S.edges(spark, sf_dir, 2), dirty(spark, sf_dir)
    return checks.stale_interfaces(e, graph.propagate(spark, e, S.nodes(spark, sf_dir), d), d)


@query("live", ", m AS (SELECT DISTINCT tbl, tbl || '.' || col AS name FROM oplog WHERE col IS NOT NULL) SELECT tbl AS provider, name FROM m WHERE NOT (tbl % 3 <> 0 AND (tbl, name) IN (SELECT tbl, tbl || '.' || col FROM live))")
def contract_columns(spark, sf_dir):
    log = S.oplog(spark, sf_dir)
    asked = log.where("col IS NOT NULL").select(F.col("tbl").alias("provider"), F.concat_ws(".", F.col("tbl").cast("string"), "col").alias("name")).distinct()
    declared = log.where("tbl % 3 <> 0").select(F.col("tbl").alias("subsystem"), F.col("tbl").cast("string").alias("name")).distinct()
    tables = fold.live_columns(log).groupBy("tbl").agg(F.collect_set("col").alias("columns")).select(F.col("tbl").alias("subsystem"), F.col("tbl").cast("string").alias("tbl"), "columns")
    return checks.contract_columns(asked, declared, tables)


@query("", "SELECT source AS repo, min(t)::DOUBLE AS least, median(t)::DOUBLE AS middle, max(t)::DOUBLE AS most, round((1 - sum(t) / sum(n_chars)) * 1000)::BIGINT AS saved_permille FROM (SELECT source, n_chars, least(n_chars, 400)::DOUBLE AS t FROM documents) GROUP BY 1")
def token_economics(spark, sf_dir):
    t = F.least("n_chars", F.lit(400)).cast("double")
    d = S.table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), "n_chars", t.alias("t"))
    return d.groupBy("repo").agg(F.min("t").alias("least"), F.median("t").alias("middle"), F.max("t").alias("most"), F.round((1 - F.sum("t") / F.sum("n_chars")) * 1000).cast("long").alias("saved_permille"))


@query("", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_extract(n, '^test_([^.]*)', 1) WHEN doc_id % 3 = 1 THEN split_part(n, '.spec.', 1) END AS area FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'test_' || lang || '.py' WHEN 1 THEN lang || '.spec.ts' ELSE lang || '.md' END AS n FROM documents)")
def test_areas(spark, sf_dir):
    k = F.col("doc_id") % 3
    name = F.when(k == 0, F.concat(F.lit("a/test_"), "lang", F.lit(".py"))).when(k == 1, F.concat(F.lit("b/"), "lang", F.lit(".spec.ts"))).otherwise(F.concat("lang", F.lit(".md")))
    return S.table(spark, sf_dir, "documents").select("doc_id", P.test_area(name).alias("area"))


@query("oplog", "SELECT op, count(DISTINCT tbl) AS n_tables, count(DISTINCT tbl || '.' || col) AS n_objects FROM oplog GROUP BY 1")
def schema_object_counts(spark, sf_dir):
    return fold.object_counts(S.oplog(spark, sf_dir))
