"""Import resolution: ordered candidates against indexes of stems and suffixes."""

from __future__ import annotations

import posixpath
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codemap_spark.functions.paths import strip_ext, suffixes

WEB = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts")


def candidates(importer: str, module: str, aliases: Callable[[str], list[str]] | None = None) -> list[str]:
    """Stems that an import may mean, best first; aliases gives those of a bare one in a web file."""
    if not module:
        return []
    web, here = importer.endswith(WEB), posixpath.dirname(importer)
    if module.startswith("."):
        if web or "/" in module:
            stem = posixpath.normpath(posixpath.join(here, module))
            cut, ext = posixpath.splitext(stem)
            return [stem, cut] if ext in WEB else [stem]
        dots = len(module) - len(module.lstrip("."))
        for _ in range(dots - 1):
            here = posixpath.dirname(here)
        rest = module[dots:].replace(".", "/")
        return [posixpath.normpath(posixpath.join(here, rest)) if rest else (here or ".")]
    known = aliases(module) if web and aliases else []
    return list(dict.fromkeys([*known, module if web or "/" in module else module.replace(".", "/")]))


def member_candidates(importer: str, module: str, names: list[str], aliases: Callable[[str], list[str]] | None = None) -> list[tuple[bool, list[str]]]:
    """Candidates of the module, and of each name as a member of it: ``from . import output`` means a file of the package."""
    out = [(False, candidates(importer, module, aliases))]
    for n in filter(None, names):
        out.append((True, candidates(importer, f"{module}{n}" if module.endswith(".") or not module else f"{module}.{n}", aliases)))
    return out


def stems_udf(aliases: Callable[[str], list[str]] | None = None):
    """A column function (importer, module) -> array of stems."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def stems(importer: pd.Series, module: pd.Series) -> pd.Series:
        return pd.Series([candidates(a or "", b or "", aliases) for a, b in zip(importer, module, strict=True)])

    return stems


def members_udf(aliases: Callable[[str], list[str]] | None = None):
    """A column function (importer, module, names) -> array of (member, stems)."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("member", T.BooleanType()), T.StructField("stems", T.ArrayType(T.StringType()))])))
    def members(importer: pd.Series, module: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([[{"member": m, "stems": s} for m, s in member_candidates(a or "", b or "", list(n) if n is not None else [], aliases)] for a, b, n in zip(importer, module, names, strict=True)])

    return members


candidate_stems = stems_udf()


def stem_index(files: DataFrame) -> DataFrame:
    """(stem, path): the first file of each stem."""
    return files.select(strip_ext(F.col("path")).alias("stem"), "path").groupBy("stem").agg(F.min("path").alias("path"))


def suffix_index(files: DataFrame) -> DataFrame:
    """(suffix, stem): the smallest stem that ends with it, whole segments only."""
    return stem_index(files).select("stem", F.explode(suffixes(F.col("stem"))).alias("suffix")).groupBy("suffix").agg(F.min("stem").alias("stem"))


def resolve(files: DataFrame, imports: DataFrame, key: list[str]) -> DataFrame:
    """key and target: per candidate the stem itself, its index file, its package, a suffix; the first hit wins.

    imports has key and stems, an array of candidate stems, best first.
    """
    tried = imports.select(*key, F.posexplode("stems").alias("c", "stem"))
    ways = F.array(F.struct(F.lit(0).alias("p"), F.col("stem").alias("k")), F.struct(F.lit(1).alias("p"), F.concat("stem", F.lit("/index")).alias("k")), F.struct(F.lit(2).alias("p"), F.concat("stem", F.lit("/__init__")).alias("k")))
    exact = tried.select(*key, "c", F.explode(ways).alias("w")).select(*key, (F.col("c") * 4 + F.col("w.p")).alias("prio"), F.col("w.k").alias("stem"))
    stems = stem_index(files).withColumnRenamed("path", "target")
    exact = exact.join(stems, "stem").select(*key, "prio", "target")
    index = suffix_index(files).join(stems, "stem").select(F.col("suffix").alias("stem"), "target")
    loose = tried.join(index, "stem").select(*key, (F.col("c") * 4 + 3).alias("prio"), "target")
    return exact.unionByName(loose).groupBy(*key).agg(F.min_by("target", "prio").alias("target"))
