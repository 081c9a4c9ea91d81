"""License scans: ordered signature rules behind a keyword prefilter.

Built from column expressions alone: one pass over the texts, no shuffle. A
text becomes its words joined by single spaces. A rule is gated by its keyword
and, where its regex fixes it, by the word next to the keyword; where those
stand, the rule is tried on the words around them. What it matches becomes an
interval of words. An interval inside a longer one is suppressed, of equal
intervals the earlier rule stays. The rest is taken by rank: an interval stays
if it overlaps none that stays by an earlier rule.

Nulls and empty texts have no words: counts 0, places null, labels empty,
score 0. Texts of any length are scanned whole. Repeated rows are each scanned,
an empty table has no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from functools import cache, reduce
from itertools import product
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codemap_spark.llm.license_rules import RULES_TEXT

MARK = "\u0001"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def _most_spaces(parsed) -> int:
    """The most spaces that a match can hold."""
    n = 0
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            n += arg == 32
        elif op == "ANY":
            n += 1
        elif op == "MAX_REPEAT":
            n += arg[1] * _most_spaces(arg[2])
        elif op == "SUBPATTERN":
            n += _most_spaces(arg[-1])
        elif op == "BRANCH":
            n += max(map(_most_spaces, arg[1]))
        elif op != "IN":  # classes hold letters and digits only
            raise ValueError(f"a rule may not use {op}")
    return n


def _strings(parsed) -> set[str] | None:
    """All strings of a finite regex part; None where a wildcard keeps it open."""
    parts: list[set[str]] = []
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            parts.append({chr(arg)})
        elif op == "SUBPATTERN":
            parts.append(_strings(arg[-1]))
        elif op == "BRANCH":
            some = [_strings(x) for x in arg[1]]
            parts.append(None if None in some else set().union(*some))
        elif op == "MAX_REPEAT" and arg[1] == 1:
            inner = _strings(arg[2])
            parts.append(None if inner is None else inner | ({""} if arg[0] == 0 else set()))
        else:
            parts.append(None)
        if parts[-1] is None:
            return None
    return {"".join(x) for x in product(*parts)}


def _gates(before: str, key: str, after: str) -> list[str]:
    """The keyword with each word that can stand before it, else with each that can follow, else alone."""
    left, right = (_strings(re._parser.parse(x)) for x in (before, after))
    if left and all(x.endswith(" ") for x in left):
        return sorted({f"{x.split()[-1]} {key}" for x in left})
    if right and all(x.startswith(" ") for x in right):
        return sorted({f"{key} {x.split()[0]}" for x in right})
    return [key]


@cache
def _parsed(text: str) -> tuple[dict, ...]:
    out = []
    for line in text.strip().splitlines():
        label, _, pattern = line.partition(" : ")
        for part in re.split(r"\|(?![^()]*\))", pattern):
            if "@" not in part:
                raise ValueError(f"no keyword in {part!r} of {label}")
            key = re.search(r"@(\w+(?:\[cs\]\w*)?)", part)[1]
            spelled = [key.replace("[cs]", "c"), key.replace("[cs]", "s")] if "[cs]" in key else [key, key.replace("license", "licence")]
            left, right = part.split("@" + key)
            inner = left.rfind("(?:") > left.rfind(")")  # a keyword in a group gates by itself
            for word in dict.fromkeys(spelled):
                gates = [word] if inner else _gates(left, word, right)
                reach = _most_spaces(re._parser.parse(left + word + right))
                out.append({"rank": len(out), "label": label, "key": word, "gates": gates, "reach": reach, "rx": rf"(?<![^ ]){left}{MARK}{word}{right}(?![^ ])"})
    return tuple(out)


def rules() -> list[dict]:
    """The signatures: priority, label, keyword, gates and its regex around MARK; reach is how many words a match has besides."""
    return list(_parsed(RULES_TEXT))


def words_of(text: Column) -> Column:
    """Words joined by single spaces; '' where there are none.

    lower() also folds letters beyond ASCII; they are word characters either
    way, so neither the words' ends nor the ASCII phrases change.
    """
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS, " "))


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _table() -> tuple[str, str]:
    """The gates' map of rules, and the gates."""
    by: dict[str, list[dict]] = {}
    for r in rules():
        for g in r["gates"]:
            by.setdefault(g, []).append(r)
    pairs = []
    for gate, own in by.items():
        structs = ", ".join(f"named_struct('rank', {r['rank']}, 'label', {_sql(r['label'])}, 'rx', {_sql(r['rx'])})" for r in own)
        pairs.append(f"{_sql(gate)}, array({structs})")
    return f"map({', '.join(pairs)})", ", ".join(map(_sql, by))


def detect(df: DataFrame, words: str = "words") -> Column:
    """Array of (start, stop, rank, label) of every rule that matches in the word array."""
    keys, reach = ", ".join(sorted({_sql(r["key"]) for r in rules()})), max(r["reach"] for r in rules())
    table, gates = _table()
    window = (
        f"concat_ws(' ', slice({words}, greatest(a - {reach}, 0) + 1, least(a, {reach})), "
        f"concat('{MARK}', {words}[a]), slice({words}, a + 2, {reach}))"
    )
    near = f"array({words}[a], concat_ws(' ', get({words}, a - 1), {words}[a]), concat_ws(' ', {words}[a], get({words}, a + 1)))"
    open_ = f"filter(array_distinct({near}), g -> g IN ({gates}))"
    hits = (
        f"flatten(transform(gs, g -> transform(element_at({table}, g), r -> named_struct('a', a, 'rank', r.rank, 'label', r.label, "
        f"'m', regexp_extract(w, r.rx, 0)))))"
    )
    anchors = f"filter(sequence(0, size({words}) - 1), i -> {words}[i] IN ({keys}))"
    # The words around a keyword are joined only where a gate is open.
    tried = f"transform({anchors}, a -> flatten(transform(filter(array({open_}), gs -> size(gs) > 0), gs -> flatten(transform(array({window}), w -> {hits})))))"
    matched = f"filter(flatten({tried}), h -> h.m <> '')"
    left = f"(length(substring_index(h.m, '{MARK}', 1)) - length(replace(substring_index(h.m, '{MARK}', 1), ' ', '')))"
    return F.expr(
        f"transform({matched}, h -> named_struct('start', h.a - {left}, "
        f"'stop', h.a - {left} + length(h.m) - length(replace(h.m, ' ', '')) + 1, 'rank', h.rank, 'label', h.label))"
    )


_EMPTY = "slice(array(named_struct('start', 0, 'stop', 0, 'rank', 0, 'label', '')), 1, 0)"


def outermost(found: str) -> Column:
    """Detections by start that lie in no other; their ends rise as well."""
    order = f"array_sort({found}, (x, y) -> CASE WHEN x.start <> y.start THEN x.start - y.start WHEN x.stop <> y.stop THEN y.stop - x.stop ELSE x.rank - y.rank END)"
    # Sorted by start and falling stop, an interval lies in an earlier one iff it ends no later than the farthest end so far.
    return F.expr(
        f"aggregate({order}, named_struct('far', -1, 'kept', {_EMPTY}), (s, x) -> IF(x.stop <= s.far, s, "
        f"named_struct('far', x.stop, 'kept', concat(s.kept, array(x)))), s -> s.kept)"
    )


def resolve(outer: str) -> Column:
    """What stays of outermost detections by rank; only runs of overlapping ones are compared."""
    first = f"filter(sequence(0, size({outer}) - 1), i -> i = 0 OR {outer}[i].start >= {outer}[i - 1].stop)"
    by_rank = "array_sort(run, (x, y) -> CASE WHEN x.rank <> y.rank THEN x.rank - y.rank ELSE x.start - y.start END)"
    free = f"aggregate({by_rank}, {_EMPTY}, (k, x) -> IF(exists(k, y -> x.start < y.stop AND y.start < x.stop), k, concat(k, array(x))))"
    runs = f"transform(array({first}), f -> transform(f, (a, n) -> slice({outer}, a + 1, coalesce(get(f, n + 1), size({outer})) - a)))[0]"
    kept = f"flatten(transform({runs}, run -> IF(size(run) = 1, run, {free})))"
    return F.expr(f"array_sort({kept}, (x, y) -> x.start - y.start)")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    # Plain substring tests are several times cheaper than one alternation of the keywords.
    gate = reduce(or_, (F.col("norm").contains(k) for k in sorted({r["key"] for r in rules()})))
    df = docs.select(F.col(id_col).alias(id_col), words_of(F.col(text_col)).alias("norm"))
    df = df.withColumn("n_words", F.expr("IF(norm = '', 0, length(norm) - length(replace(norm, ' ', '')) + 1)").cast("long"))
    # The prefilter: only texts with a keyword get their words as an array, all others an empty one.
    df = df.withColumn("words", F.when(gate, F.split("norm", " ")).otherwise(F.array().cast("array<string>"))).drop("norm")
    df = df.withColumn("found", F.when(F.size("words") > 0, detect(df)).otherwise(F.lit(None)))
    phrase = " OR ".join("(" + " AND ".join(f"get(words, i + {k}) = {_sql(w)}" for k, w in enumerate(p.split())) + ")" for p in BASE)
    label = "CASE get(words, i) " + " ".join(f"WHEN {_sql(p.split()[0])} THEN {_sql(b)}" for p, b in BASE.items()) + " END"
    df = df.withColumn("base", F.when(F.size("words") > 0, F.expr(f"transform(filter(sequence(0, size(words) - 1), i -> {phrase}), i -> named_struct('at', i, 'label', {label}))"))).drop("words")
    df = df.withColumn("outer", F.when(F.size("found") > 0, outermost("found")))
    df = df.withColumn("kept", F.when(F.size("outer") > 0, resolve("outer")))
    base_labels, kept_labels = F.expr("coalesce(base.label, array())").cast("array<string>"), F.expr("coalesce(kept.label, array())").cast("array<string>")
    n = F.coalesce(F.when(F.size("kept") > 0, F.size("kept")), F.lit(0))
    return df.select(
        id_col, "n_words", F.coalesce(F.when(F.col("base").isNotNull(), F.size("base")), F.lit(0)).cast("long").alias("n_base"),
        F.expr("array_min(base.at)").cast("long").alias("first_word"), F.expr("array_max(base.at)").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, kept_labels))), ",").alias("labels"),
        (F.lit(1.0) - F.pow(F.lit(0.5), n)).alias("score"), F.col("kept").alias("detections"),
    )
