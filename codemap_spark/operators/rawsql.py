"""Tables that SQL in string literals of code names: advice, never a contract."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TS = re.compile(r"""//[^\n]*|/\*.*?\*/|"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\]|\\.)*)`""", re.S)
#: What precedes a table in a statement; group 1 tells reads from writes.
REFERENCE = r"(?i)\b(from|join|into|update|delete\s+from)\s+[\"'`\[]?([A-Za-z_][\w.]*)"


def literals(text: str, language: str) -> list[str]:
    """Static string literals of Python or TypeScript; interpolated ones are left out."""
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            return []
        inner = {id(v) for n in ast.walk(tree) if isinstance(n, ast.JoinedStr) for v in ast.walk(n)}
        return [n.value for n in ast.walk(tree) if isinstance(n, ast.Constant) and isinstance(n.value, str) and id(n) not in inner]
    if language == "typescript":
        return [s for m in _TS.finditer(text) for s in m.groups() if s is not None and not (m[3] is not None and "${" in s)]
    return []


def literal_rows(files: DataFrame) -> DataFrame:
    """(path, literal) of files (path, language, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, s) for p, lang, t in zip(pdf.path, pdf.language, pdf.text, strict=True) for s in literals(t or "", lang)]
            yield pd.DataFrame(rows, columns=["path", "literal"])

    return files.where("language IN ('python', 'typescript')").select("path", "language", "text").mapInPandas(run, "path string, literal string")


def references(text: Column) -> Column:
    """Array of (tbl, via): reads and writes of a text, schema qualifiers dropped."""
    words = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1))
    tables = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(2))
    via = lambda w: F.when(F.regexp_replace(F.lower(w), r"\s+", " ").isin("into", "update", "delete from"), "writes").otherwise("reads")
    both = F.zip_with(words, tables, lambda w, t: F.struct(F.element_at(F.split(t, r"\."), -1).alias("tbl"), via(w).alias("via")))
    return F.filter(both, lambda x: x["tbl"] != "")


def consumers(literal_rows_: DataFrame, claimants: DataFrame) -> DataFrame:
    """(tbl, subsystem, via, n_files); claimants has path, owner: the first that claims a file by name, not the most specific."""
    refs = literal_rows_.select("path", F.explode(references(F.col("literal"))).alias("r")).select("path", "r.tbl", "r.via").distinct()
    first = claimants.groupBy("path").agg(F.min("owner").alias("subsystem"))
    return refs.join(first, "path").groupBy("tbl", "subsystem", "via").agg(F.countDistinct("path").alias("n_files"))
