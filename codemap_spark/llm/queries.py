"""The registered queries of this subpackage; each covers its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codemap_spark.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents")).drop("detections")


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codemap_spark.llm.scratch import arrow_batches
    from codemap_spark.llm.secret_scan import scan

    arrow_batches(spark)
    return scan(table(spark, sf_dir, "documents"))


@query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codemap_spark.llm.html_extract import extract_pages
    from codemap_spark.llm.scratch import arrow_batches

    arrow_batches(spark)
    return extract_pages(table(spark, sf_dir, "pages"))


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer's JSON; path is where its file lies."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codemap_spark.llm import token_files
    from codemap_spark.llm.scratch import arrow_batches

    arrow_batches(spark)
    folder, manifest = token_files.write(spark, table(spark, sf_dir, "documents"), tokenizer_json())
    return token_files.read(spark, folder, manifest)


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codemap_spark.llm.bpe import digests
    from codemap_spark.llm.scratch import arrow_batches

    arrow_batches(spark)
    return digests(spark, table(spark, sf_dir, "documents"), tokenizer_json())


@query
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codemap_spark.llm.minhash_dedup import near_duplicates
    from codemap_spark.llm.scratch import arrow_batches

    arrow_batches(spark)
    return near_duplicates(spark, table(spark, sf_dir, "documents"), k=2, percent=80)


# Every pair that shares a shingle, then the links' transitive closure.
ORACLES["op8_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END)) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id
"""


@query
def op10_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codemap_spark.llm.lattice_dedup import near_duplicates
    from codemap_spark.llm.scratch import arrow_batches

    arrow_batches(spark)
    return near_duplicates(spark, table(spark, sf_dir, "embeddings"))


# Every pair; right for whole tables as long as they are small.
ORACLES["op10_lattice_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
    AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY 1),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY 1)
SELECT t.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, t.vec_id = c.component_id AS kept
FROM embeddings t LEFT JOIN n USING (vec_id) JOIN c ON c.node = t.vec_id
"""


@query
def op6_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codemap_spark.llm.hilbert_search import search
    from codemap_spark.llm.scratch import arrow_batches

    arrow_batches(spark)
    return search(spark, table(spark, sf_dir, "embeddings"))


# Brute force: windows would hold more rows than tables of this size have, so all are met and the results are the same.
ORACLES["op6_hilbert_search"] = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
    AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op5_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codemap_spark.llm.mixing import mix

    return mix(spark, table(spark, sf_dir, "documents"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codemap_spark.llm.scratch import arrow_batches
    from codemap_spark.llm.toxicity import score

    arrow_batches(spark)
    return score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# What SQL can say of op1 and op2: the columns that fixed patterns give.


@query
def license_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


ORACLES["license_base_columns"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, i - 1 AS place, CASE WHEN ws[i:i+3] = ['under', 'the', 'mit', 'license'] THEN 'mit' WHEN ws[i:i+2] = ['apache', 'license', 'version'] AND ws[i+3] = '2' THEN 'apache-2' WHEN ws[i:i+2] = ['cc', 'by', 'nc'] THEN 'cc-by-nc' END AS label
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE list_contains(ws, 'license') OR list_contains(ws, 'nc'))),
a AS (SELECT doc_id, count(*) AS n, min(place) AS f, max(place) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p WHERE label IS NOT NULL GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN a USING (doc_id)
"""


@query
def secret_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


ORACLES["secret_base_columns"] = r"""
SELECT doc_id, len(list_filter(regexp_extract_all(t, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6))::BIGINT AS n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::BIGINT AS n_access,
  len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24))::BIGINT AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
