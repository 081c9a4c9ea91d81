"""Graph operators over (u consumes v) edges."""

from __future__ import annotations

import re
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Edges that a counted broadcast may hold; graphs of subsystems have hundreds.
SMALL = 20_000
#: Rounds of a loop whose tables stay apart before they are merged.
MERGE = 8
DEPTHS = {"core": -1, "connector": 1, "leaf": 0}


def _saved(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder of spark.checkpoint.dir; a local one only where Spark runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="codemap-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _small(spark: SparkSession, edges: DataFrame) -> tuple[list, bool]:
    """The distinct edges where a count shows at most SMALL of them, and whether that is so."""
    rows = edges.select("u", "v").distinct().limit(SMALL + 1).collect()
    return (rows, True) if len(rows) <= SMALL else ([], False)


def _reach(after: dict, seeds) -> dict:
    """seed -> nodes on paths of one edge or more, by breadth-first search."""
    out = {}
    for s in seeds:
        seen, todo = set(), [s]
        while todo:
            new = {w for v in todo for w in after.get(v, ())} - seen
            seen |= new
            todo = list(new)
        out[s] = seen
    return out


def reached_from(spark: SparkSession, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, id): nodes from which edges u -> v lead to a seed; only what the seeds reach is searched."""
    edges = edges.select("u", "v").distinct()
    seeds = seeds.select(F.col("id").alias("seed"), "id")
    rows, small = _small(spark, edges)
    schema = T.StructType([T.StructField("seed", seeds.schema["id"].dataType), T.StructField("id", edges.schema["u"].dataType)])
    if small:
        back: dict = {}
        for r in rows:
            back.setdefault(r.v, []).append(r.u)
        shared = spark.sparkContext.broadcast(back)

        def run(batches):
            for pdf in batches:
                found = _reach(shared.value, pdf["id"].tolist())
                yield pd.DataFrame([(s, x) for s, xs in found.items() for x in xs], columns=["seed", "id"])

        return seeds.select("id").distinct().mapInPandas(run, schema)
    edges, seen = _saved(spark, edges), None
    frontier = _saved(spark, seeds)
    rounds = 0
    while True:
        step = frontier.join(edges, frontier["id"] == edges.v).select("seed", F.col("u").alias("id")).distinct()
        new = _saved(spark, step if seen is None else step.join(seen, ["seed", "id"], "left_anti"))
        if new.isEmpty():
            return new if seen is None else seen
        seen, frontier, rounds = new if seen is None else seen.unionByName(new), new, rounds + 1
        if rounds % MERGE == 0:
            seen = _saved(spark, seen)


def transitive_closure(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(src, dst) for every path u -> v.

    Up to SMALL counted edges each source is searched on its own over a
    broadcast of them; beyond, semi-naive rounds go on until one finds nothing.
    """
    if _small(spark, edges)[1]:
        back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        return reached_from(spark, back, edges.select(F.col("u").alias("id"))).select(F.col("seed").alias("src"), F.col("id").alias("dst"))
    edges = _saved(spark, edges.select("u", "v").distinct())
    seen = frontier = edges.select(F.col("u").alias("src"), F.col("v").alias("dst"))
    rounds = 0
    while True:
        step = frontier.join(edges, frontier.dst == edges.u).select("src", F.col("v").alias("dst")).distinct()
        new = _saved(spark, step.join(seen, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return seen
        seen, frontier, rounds = seen.unionByName(new), new, rounds + 1
        if rounds % MERGE == 0:
            seen = _saved(spark, seen)


def blast_radius(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(target, consumer): who is reached when target changes, the target left out."""
    reach = transitive_closure(spark, edges)
    return reach.where("src <> dst").select(F.col("dst").alias("target"), F.col("src").alias("consumer"))


def propagate(spark: SparkSession, edges: DataFrame, nodes: DataFrame, dirty: DataFrame, depths: dict[str, int] = DEPTHS) -> DataFrame:
    """(name) of consumers reached from dirty nodes within each seed's depth, dirty ones left out."""
    limit = F.create_map(*(F.lit(x) for kv in depths.items() for x in kv))
    seeds = dirty.join(nodes, "id").select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("depth"), F.coalesce(limit[F.col("criticality")], F.lit(0)).alias("most"))
    rows, small = _small(spark, edges)
    if small:
        back: dict = {}
        for r in rows:
            back.setdefault(r.v, []).append(r.u)
        shared = spark.sparkContext.broadcast(back)

        def run(batches):
            for pdf in batches:
                hit = set()
                for s, most in zip(pdf["seed"].tolist(), pdf["most"].tolist(), strict=True):
                    seen, todo, depth = {s}, [s], 0
                    while todo and (most == -1 or depth < most):
                        todo = list({w for v in todo for w in shared.value.get(v, ())} - seen)
                        seen.update(todo)
                        depth += 1
                    hit |= seen
                yield pd.DataFrame({"id": list(hit)})

        found = seeds.mapInPandas(run, T.StructType([T.StructField("id", seeds.schema["node"].dataType)]))
        return found.distinct().join(dirty, "id", "left_anti")
    edges = _saved(spark, edges)
    seen = frontier = _saved(spark, seeds)
    rounds = 0
    while True:
        near = frontier.where("most = -1 OR depth < most")
        step = near.join(edges, near.node == edges.v).select("seed", F.col("u").alias("node"), (F.col("depth") + 1).alias("depth"), "most").distinct()
        new = _saved(spark, step.join(seen, ["seed", "node"], "left_anti"))
        if new.isEmpty():
            break
        seen, frontier, rounds = seen.unionByName(new), new, rounds + 1
        if rounds % MERGE == 0:
            seen = _saved(spark, seen)
    return seen.select(F.col("node").alias("id")).distinct().join(dirty, "id", "left_anti")


def consumer_index(edges: DataFrame) -> DataFrame:
    """(provider, consumers, n): the inverted edges."""
    return edges.groupBy(F.col("v").alias("provider")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("u")), lambda x: x.cast("string")), ",").alias("consumers"), F.countDistinct("u").alias("n"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out) of every node."""
    ends = edges.select(F.col("v").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("u").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    sums = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return nodes.select("id").join(sums, "id", "left").select("id", F.coalesce("i", F.lit(0)).alias("fan_in"), F.coalesce("o", F.lit(0)).alias("fan_out"))


def composition_roots(nodes: DataFrame, edges: DataFrame, share_tenths: int = 5, least: int = 8) -> DataFrame:
    """Nodes that at least half of the others consume and that consume half of the others, in graphs of some size."""
    n = nodes.agg(F.count("*").alias("n"))
    d = degrees(nodes, edges).crossJoin(F.broadcast(n))  # n is one row
    bound = (F.col("n") - 1) * share_tenths
    return d.where((F.col("n") >= least) & (F.col("fan_in") * 10 >= bound) & (F.col("fan_out") * 10 >= bound)).select("id", "fan_in", "fan_out")


def inferred(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Role and criticality by degree."""
    role = F.when((F.col("fan_in") > 0) & (F.col("fan_out") == 0), "library").when((F.col("fan_in") > 0) & (F.col("fan_out") > 0), "platform").otherwise("service")
    crit = F.when(F.col("fan_in") >= 3, "core").when(F.col("fan_in") >= 1, "connector").otherwise("leaf")
    return degrees(nodes, edges).select("id", role.alias("role"), crit.alias("criticality"))


def containment(claims: DataFrame) -> DataFrame:
    """(outer, inner): every prefix of inner lies strictly under some prefix of outer, and not the other way round."""
    p = claims.select("owner", "prefix").distinct()
    parts = F.split("prefix", "/")
    above = p.select(F.col("owner").alias("inner"), F.col("prefix").alias("ip"), F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))).alias("up"))
    under = above.join(p.select(F.col("owner").alias("outer"), F.col("prefix").alias("up")), "up").where("inner <> outer").groupBy("outer", "inner").agg(F.countDistinct("ip").alias("k"))
    sizes = p.groupBy(F.col("owner").alias("inner")).agg(F.count("*").alias("n"))
    full = under.join(sizes, "inner").where("k = n").select("outer", "inner")
    back = full.select(F.col("inner").alias("outer"), F.col("outer").alias("inner"))
    return full.join(back, ["outer", "inner"], "left_anti")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, component, size): strongly connected components of nodes on some cycle, named by their smallest member.

    Colouring: every node takes the smallest name that reaches it; from each
    root, whose name is its own, the nodes of its colour that reach it back are
    its component. What is settled goes, and the rest is coloured anew; rows
    never exceed nodes and edges.
    """
    left = _saved(spark, edges.select("u", "v").where("u <> v").distinct())
    loops = edges.where("u = v").select(F.col("u").alias("id")).distinct()
    done = None
    while not left.isEmpty():
        nodes = left.select(F.col("u").alias("id")).unionByName(left.select(F.col("v").alias("id"))).distinct()
        colour = _spread(spark, left, nodes.select("id", F.col("id").alias("c")))
        # Edges within one colour, walked backwards from the roots.
        same = _saved(spark, left.join(colour.toDF("u", "a"), "u").join(colour.toDF("v", "b"), "v").where("a = b").select("u", "v", "a"))
        back, seen = same.select(F.col("v").alias("u"), F.col("u").alias("v")), _saved(spark, colour.where("id = c"))
        front, rounds = seen, 0
        while True:
            new = _saved(spark, front.join(back, front["id"] == back.u).select(F.col("v").alias("id"), "c").distinct().join(seen, "id", "left_anti"))
            if new.isEmpty():
                break
            seen, front, rounds = seen.unionByName(new), new, rounds + 1
            if rounds % MERGE == 0:
                seen = _saved(spark, seen)
        seen = _saved(spark, seen)
        done = seen if done is None else done.unionByName(seen)
        gone = seen.select("id")
        left = _saved(spark, left.join(gone.withColumnRenamed("id", "u"), "u", "left_anti").join(gone.withColumnRenamed("id", "v"), "v", "left_anti").select("u", "v"))
    alone = loops.select("id", F.col("id").alias("component"))
    if done is None:
        out = alone
    else:
        done = _saved(spark, done)
        out = done.select("id", F.col("c").alias("component")).unionByName(alone.join(done.select("id"), "id", "left_anti"))
    size = out.groupBy("component").agg(F.count("*").alias("size"))
    sized = out.join(size, "component").select("id", "component", "size")
    return sized.join(loops.withColumn("loop", F.lit(True)), "id", "left").where("size > 1 OR loop").select("id", "component", "size")


def _spread(spark: SparkSession, edges: DataFrame, colour: DataFrame) -> DataFrame:
    """(id, c): the smallest c of all nodes that lead to a node, itself included."""
    colour = _saved(spark, colour)
    while True:
        near = edges.join(colour.withColumnRenamed("id", "u"), "u").groupBy(F.col("v").alias("id")).agg(F.min("c").alias("n"))
        new = _saved(spark, colour.join(near, "id", "left").select("id", F.least("c", "n").alias("c"), (F.col("n") < F.col("c")).alias("moved")))
        colour = new.select("id", "c")
        if new.where("moved").isEmpty():
            return colour


def back_edge_cycles(edges: dict[str, list[str]]) -> list[list[str]]:
    """Cycles closed by back edges of a depth-first search in sorted order, rotated to their smallest node."""
    state: dict[str, int] = {}
    found: set[tuple[str, ...]] = set()
    for first in sorted(edges):
        if state.get(first):
            continue
        path, todo = [first], [iter(sorted(edges.get(first, ())))]
        state[first] = 1
        while path:
            node = next(todo[-1], None)
            if node is None:
                state[path.pop()] = 2
                todo.pop()
            elif state.get(node) == 1:
                loop = path[path.index(node) :]
                k = loop.index(min(loop))
                found.add(tuple(loop[k:] + loop[:k]))
            elif not state.get(node):
                state[node] = 1
                path.append(node)
                todo.append(iter(sorted(edges.get(node, ()))))
    return [list(c) for c in sorted(found, key=lambda c: (len(c), c))]


def greedy_cuts(cycles: list[list[str]], kept: set[tuple[str, str]] = frozenset()) -> list[tuple[str, str, int]]:
    """Edges that cover all cycles: each time the one in most uncovered cycles, ties to the smallest."""
    open_ = [{(a, b) for a, b in zip(c, c[1:] + c[:1], strict=True)} for c in cycles]
    cuts = []
    while open_:
        count: dict[tuple[str, str], int] = {}
        for c in open_:
            for e in c - kept:
                count[e] = count.get(e, 0) + 1
        if not count:
            break
        best = min(count, key=lambda e: (-count[e], e))
        cuts.append((*best, count[best]))
        open_ = [c for c in open_ if best not in c]
    return cuts


def cycles(edges: DataFrame) -> DataFrame:
    """(rank, length, chain); the search is sequential, so the deduplicated subsystem graph goes to one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        graph: dict[str, list[str]] = {}
        for u, v in zip(pdf.u, pdf.v, strict=True):
            graph.setdefault(str(u).zfill(12), []).append(str(v).zfill(12))
        rows = [(k, len(c), "\t".join(str(int(x)) for x in c)) for k, c in enumerate(back_edge_cycles(graph), 1)]
        return pd.DataFrame(rows, columns=["rank", "length", "chain"])

    return edges.select("u", "v").distinct().groupBy(F.lit("all").alias("g")).applyInPandas(run, "rank long, length long, chain string")


def feedback_edges(edges: DataFrame) -> DataFrame:
    """(rank, u, v, covers): a greedy set of edges whose removal breaks every found cycle."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        graph: dict[str, list[str]] = {}
        for u, v in zip(pdf.u, pdf.v, strict=True):
            graph.setdefault(str(u).zfill(12), []).append(str(v).zfill(12))
        cuts = greedy_cuts(back_edge_cycles(graph))
        return pd.DataFrame([(k, int(a), int(b), n) for k, (a, b, n) in enumerate(cuts, 1)], columns=["rank", "u", "v", "covers"])

    return edges.select("u", "v").distinct().groupBy(F.lit("all").alias("g")).applyInPandas(run, "rank long, u long, v long, covers long")
