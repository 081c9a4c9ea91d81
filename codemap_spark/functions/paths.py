"""Column functions over paths, names and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEST_FOLDERS = ("tests", "test", "__tests__", "spec", "specs", "e2e")
CONFIG_STEMS = ("conf", "config", "settings", "setup", "webpack.config", "jest.config", "vite.config", "tsup.config")
#: File stems that a web framework calls by itself.
ENTRIES = tuple("page layout loading error not-found template default route global-error middleware instrumentation sitemap robots manifest opengraph-image twitter-image icon apple-icon".split())
GENERATED = ("@generated", "do not edit", "autogenerated", "auto-generated", "code generated by", "generated by", "this file is generated")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def strip_ext(path: Column) -> Column:
    """The path without its last suffix; names that begin with their only dot keep it."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")


def is_test_file(path: Column) -> Column:
    folder = F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.array(*map(F.lit, TEST_FOLDERS)))
    return folder | base_name(path).rlike(r"^test[_.]|_test\.|\.test\.|\.spec\.|_spec\.|conftest\.")


def is_test_symbol(name: Column, kind: Column) -> Column:
    """A test case, which a runner finds by its name."""
    return name.startswith("test_") | ((kind == "class") & name.startswith("Test"))


def is_config_file(path: Column) -> Column:
    return strip_ext(base_name(path)).isin(*CONFIG_STEMS)


def is_framework_entry(path: Column) -> Column:
    """Page, layout and route files under an app or pages folder of a web project."""
    name = base_name(path)
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.arrays_overlap(folders, F.array(F.lit("app"), F.lit("pages"))) & name.rlike(rf"^(?:{'|'.join(ENTRIES)})\.(?:ts|tsx|js|jsx|mjs|cjs|mts|cts)$")


def is_generated(text: Column, markers: tuple[str, ...] = GENERATED, head: int = 4096) -> Column:
    start = F.lower(F.substring(text, 1, head))
    hit = F.lit(False)
    for m in markers:
        hit = hit | start.contains(m)
    return F.coalesce(hit, F.lit(False))


def prefixes(path: Column) -> Column:
    """Every folder above the path, and the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def sampled(names: Column, k: int = 5) -> Column:
    """'a, b, +N more' of an array of names."""
    s = F.array_sort(F.array_distinct(names))
    more = F.size(s) - k
    return F.concat(F.array_join(F.slice(s, 1, k), ", "), F.when(more > 0, F.concat(F.lit(", +"), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")))


def suffixes(stem: Column) -> Column:
    """Every run of trailing segments of a stem."""
    parts = F.split(stem, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))


def table_refs(text: Column) -> Column:
    """Tables that SQL in a text reads or writes."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b(?:from|join|into|update)\s+([A-Za-z_][A-Za-z0-9_.]*)"), F.lit(1)), F.lower)


def percent(part: Column, whole: Column) -> Column:
    """Tenths of a percent as a whole number; under 1000 while a gap remains, 1000 of nothing."""
    tenth = F.floor(part * 1000 / whole + 0.5)
    return F.when(whole == 0, 1000).when(part < whole, F.least(tenth, F.lit(999))).otherwise(tenth).cast("long")


def is_local_looking(module: Column, tops: Column) -> Column:
    """Whether an import seems to mean the repository: it is relative, or begins with one of the array tops."""
    first = F.element_at(F.split(F.regexp_replace(module, r"\.", "/"), "/"), 1)
    return F.coalesce((module != "") & (module.startswith(".") | F.array_contains(tops, first)), F.lit(False))


def literal_prefix(path: Column) -> Column:
    """A path up to its first wildcard, without a slash at its end."""
    return F.regexp_replace(F.regexp_extract(path, r"^([^*?\[]*)", 1), "/+$", "")


def test_area(path: Column) -> Column:
    """The area that a test file's name tells: test_auth.py and auth.spec.ts test auth."""
    name = base_name(path)
    area = F.when(name.startswith("test_"), F.regexp_extract(name, r"^test_([^.]*)", 1)).otherwise(F.regexp_extract(name, r"^(.*?)(?:\.test\.|\.spec\.|_test\.|_spec\.)", 1))
    return F.when(area != "", area)
