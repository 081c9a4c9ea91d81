"""Secret scans: assignment-aware lexing on top of fixed patterns.

Fixed kinds are assign, access and hex (leftmost, non-overlapping per kind).
The lexer adds kind literal. It splits source and configuration into names,
strings, operators, brackets and line ends, leaving comments' marks aside, and
reads name-literal pairs from them: assignments with or without a type, keys
and subscripts, arguments, flags, XML elements and attributes, INI sections,
nested keys and block scalars, and defaults (``${NAME:-x}``). A value's
literals are those of its strings, calls and concatenations and those that the
constants in it hold: the last assignment before, or, where there is none, the
last of all; a function's constants are its own. A literal is scored by the
most sensitive name that it reaches and by how random it looks. PEM private
keys count as well.

Spans are in code points, end exclusive, without quotes. Nulls and empty texts
have no spans. Texts of any length are lexed whole, in time linear in them.
Null ids and repeated rows are each scanned, an empty table has no rows, and
extra columns are ignored (scan) or kept (redact), whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codemap_spark.llm.scratch import fresh, trimmed

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Weight of a name's parts; a name takes the largest of its parts and pairs of parts.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "pass": 0.8, "secret": 1.0, "token": 0.95, "apikey": 1.0, "api key": 1.0,
    "access key": 0.95, "secret key": 1.0, "private key": 1.0, "privatekey": 1.0, "secretkey": 1.0, "accesskey": 0.95, "client secret": 1.0, "auth": 0.7, "authorization": 0.8,
    "bearer": 0.9, "credential": 0.9, "credentials": 0.9, "encryption key": 0.95, "signing key": 0.95, "session key": 0.9, "connection string": 0.8, "key": 0.45, "signature": 0.45, "salt": 0.45,
}
PLACEHOLDER = re.compile(r"(?i)^(?:true|false|null|none|undefined|example.*|sample.*|changeme|change_me|your[_-].*|xx+|\*+|<.*>|\$\{.*\}|\{\{.*\}\}|%\w+%)$")
LEAST = 0.5

#: Names that say nothing of their own; the key, section or element around them does.
GENERIC = {"value", "default", "data", "content", "text", "literal", "string", "val", "raw", "plain", "current"}
_LEX = re.compile(
    r"""(?P<nl>\n[ \t]*)|(?P<ws>[^\S\n]+)|(?P<flag>(?<![\w-])--[A-Za-z][\w-]*)|(?P<id>[A-Za-z_$@][\w$]*(?:[.\-:]{1,2}[A-Za-z_][\w$]*)*)"""
    r"""|(?P<op>=>|:=|\?\?=|\|\|=|\+=|[=!<>]=|->|=|:|\+|\.\.|,|;|[()\[\]{}<>|])|(?P<q>[rRbBuUfF]?(?:\"\"\"|\'\'\'|["'`]))|(?P<bare>[0-9][\w.+/-]*)|(?P<other>.)""",
    re.A | re.S,
)
_QUOTED = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*{q}" if q != "`" else r"(?:[^`\\]|\\.)*`", re.S) for q in "\"'`"}
_BARE = re.compile(r"""[^\s"'`,;<>(){}\[\]]+""")
_DEFAULT = re.compile(r"\$\{([A-Za-z_]\w*):?[-=]([^}\n]*)\}", re.A)
_XML = re.compile(r"<([A-Za-z_][\w.\-]*)[^<>\n]*>([^<>]+)</", re.A)
_ATTRIBUTE = re.compile(r"""\b(?:key|name|id)=["']([\w.\-]+)["']\s+value=(["'])((?:(?!\2)[^<>\n])*)\2""", re.A | re.I)
ASSIGNS = {"=", ":=", ":", "=>", "+=", "||=", "??="}
_OPEN, _CLOSE = set("([{"), set(")]}")
_FUNCTIONS = {"def", "function", "func", "fn", "class"}
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_NAME = re.compile(r"[A-Za-z_$@][\w.$]*\Z", re.A)
#: A text without any of these has no span of any kind.
STEMS = ("pass", "pwd", "secret", "token", "key", "cred", "auth", "bearer", "connection", "signature", "salt")


def sensitivity(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    return max((SENSITIVE.get(p, 0.0) for p in [*parts, *(" ".join(x) for x in zip(parts, parts[1:], strict=False))]), default=0.0)


def randomness(value: str) -> float:
    """0 to 1: entropy a character, length and number of character classes."""
    if len(value) < 6 or PLACEHOLDER.match(value):
        return 0.0
    bits = -sum(c / len(value) * math.log2(c / len(value)) for c in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.4 * min(bits / 3.5, 1) + 0.3 * min(len(value) / 16, 1) + 0.3 * (classes - 1) / 2)


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, start of value, end of value)."""
    out = [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]


def tokens(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, text) without spaces and comment marks; a str's ends are those of its content."""
    out, at, dead = [], 0, {}
    end = len(text)
    while at < end:
        m = _LEX.match(text, at)
        kind, at = m.lastgroup, m.end()
        if kind == "q":
            quote = m[0].lstrip("rRbBuUfF")
            if len(quote) == 3:
                close = text.find(quote, at)
                if close >= 0:
                    out.append(("str", at, close, text[at:close]))
                    at = close + 3
                continue
            # An apostrophe in a word is no quote; on a line where one is not closed, no later one is looked at.
            if at >= 2 and quote == "'" and len(m[0]) == 1 and text[at - 2].isalnum() or dead.get(quote, -1) >= at:
                continue
            if s := _QUOTED[quote].match(text, at):
                out.append(("str", at, s.end() - 1, text[at : s.end() - 1]))
                at = s.end()
            else:
                eol = text.find("\n", at)
                dead[quote] = end if eol < 0 or quote == "`" else eol
        elif kind not in ("ws", "other"):
            out.append((kind, m.start(), at, m[0]))
    return out


class _Lexer:
    """Pairs of names with the literals that reach them, in one pass over the tokens."""

    def __init__(self, text: str):
        self.text, self.toks = text, tokens(text)
        self.found: dict[tuple[int, int], tuple[float, bool]] = {}
        self.scopes: list[tuple[int, dict[str, list]]] = [(-1, {})]
        self.last: dict[str, list] = {}
        self.waiting: list[tuple[str, str]] = []
        self.parents: list[tuple[int, str]] = []
        self.section = ""
        self.read()
        for name, ref in self.waiting:  # constants that are only assigned later
            for literal in self.last.get(ref, ()):
                self.reach(name, literal)

    def reach(self, name: str, literal: tuple[int, int, bool]) -> None:
        start, end, quoted = literal
        weight = sensitivity(name)
        if weight:
            strength = randomness(self.text[start:end].strip())
            if strength and weight * (0.4 + 0.6 * strength) >= LEAST and (quoted or strength >= 0.6):
                self.found[start, end] = (max(weight, self.found.get((start, end), (0.0,))[0]), quoted)

    def look(self, ref: str) -> list | None:
        for name in (ref, ref.rsplit(".", 1)[-1]):
            for _, held in reversed(self.scopes):
                if name in held:
                    return held[name]
        return None

    def full(self, name: str, indent: int) -> str:
        """The name, after the one around it where it says nothing."""
        if name.rsplit(".", 1)[-1].lower() in GENERIC:
            up = next((p for k, p in reversed(self.parents) if k < indent), self.section)
            return f"{up}.{name}"
        return name

    def value(self, i: int, name: str) -> tuple[list, list[str]]:
        """Literals and references of the value from token i on, up to its end or the next pair."""
        toks, literals, refs, depth, first = self.toks, [], [], 0, True
        while i < len(toks):
            kind, start, end, s = toks[i]
            if kind == "nl" and not depth or s in (",", ";") and kind == "op" and not depth or kind == "op" and s == "{":
                break
            if kind == "op" and s in _OPEN:
                depth += 1
            elif kind == "op" and s in _CLOSE:
                depth -= 1
                if depth < 0:
                    break
            elif kind in ("id", "str") and i + 1 < len(toks) and toks[i + 1][0] == "op" and toks[i + 1][3] in ASSIGNS and not first:
                break  # the next pair
            elif kind == "str":
                literals.append((start, end, True))
                refs += re.findall(r"\$?\{([A-Za-z_][\w.]*)\}", s)
            elif kind in ("id", "bare", "flag"):
                bare = _BARE.match(self.text, start)
                word = bare[0].rstrip(".:") if bare else s
                called = i + 1 < len(toks) and toks[i + 1][3] == "("
                if not called and first and not depth:
                    literals.append((start, start + len(word), False))
                if _NAME.match(word) and not called:
                    refs.append(word)
                while bare and i + 1 < len(toks) and toks[i + 1][1] < bare.end():
                    i += 1  # the rest of an unquoted value
            first = first and kind == "op"
            i += 1
        return literals, refs

    def pair(self, name: str, literals: list, refs: list[str], indent: int, adds: bool = False) -> None:
        full = self.full(name, indent)
        held = []
        for ref in refs:
            if (known := self.look(ref)) is not None:
                held += known
            elif sensitivity(full):
                self.waiting.append((full, ref))
        # An unquoted word that is a known constant is that constant.
        own = [x for x in literals if x[2] or self.look(self.text[x[0] : x[1]]) is None]
        reached = [*own, *held]
        for literal in reached:
            self.reach(full, literal)
        keep = [x for x in reached if x[2]]
        where = self.scopes[-1][1]
        where[name] = [*where.get(name, []), *keep] if adds else keep
        self.last[name] = where[name]

    def read(self) -> None:
        toks, n = self.toks, len(self.toks)
        i, indent, fresh = 0, len(self.text) - len(self.text.lstrip(" \t")), True
        while i < n:
            kind, start, end, s = toks[i]
            if kind == "nl":
                indent, fresh = len(s) - 1, True
                i += 1
                continue
            if fresh:
                fresh = False
                while len(self.scopes) > 1 and indent <= self.scopes[-1][0] and s not in ("{", "("):
                    self.scopes.pop()
                while self.parents and self.parents[-1][0] >= indent:
                    self.parents.pop()
                if s in _FUNCTIONS:
                    self.scopes.append((indent, {}))
                if s == "[" and i + 2 < n and toks[i + 1][0] == "id" and toks[i + 2][3] == "]" and (i + 3 == n or toks[i + 3][0] == "nl"):
                    self.section, i = toks[i + 1][3], i + 3
                    continue
            if kind == "flag":
                nxt = i + 1 + (i + 1 < n and toks[i + 1][3] == "=")
                if nxt < n and toks[nxt][0] in ("str", "id", "bare"):
                    self.pair(s[2:], self.value(nxt, s)[0][:1], [], indent)
                i += 1
                continue
            if kind not in ("id", "str"):
                i += 1
                continue
            name, j = s.removeprefix("self.").removeprefix("this.").lstrip("$@"), i + 1
            if kind == "id" and s.endswith(":"):
                name = name.rstrip(":")
            while j + 2 < n and toks[j][3] == "[" and toks[j + 1][0] in ("str", "id") and toks[j + 2][3] == "]":
                name, j = toks[j + 1][3], j + 3
            if j < n and toks[j][0] == "op" and toks[j][3] == ":" and j + 2 < n and toks[j + 1][0] == "id":  # a type
                k = j + 2
                while k < n and k < j + 12 and (toks[k][3] in ("[", "]", "<", ">", "|", ",") or toks[k][0] == "id"):
                    k += 1
                if k < n and toks[k][3] == "=":
                    if k == j + 2:  # or the name itself, after a word and a colon
                        self.pair(toks[j + 1][3], *self.value(k + 1, name), indent)
                    j = k
            if j < n and toks[j][0] == "op" and toks[j][3] in ASSIGNS and len(name) <= 200:
                op, v = toks[j][3], j + 1
                if op == ":" and (v == n or toks[v][0] == "nl" or toks[v][3] == "{"):
                    self.parents.append((indent, name))
                elif v < n and toks[v][3] in ("|", ">") and (v + 1 == n or toks[v + 1][0] == "nl"):
                    i = self.block(name, v + 1, indent)
                    continue
                else:
                    self.pair(name, *self.value(v, name), indent, op == "+=")
                i = v
            elif j < n and toks[j][3] == "(" and kind == "id" and j + 1 < n and toks[j + 1][0] == "str":
                key = toks[j + 1]
                if j + 3 < n and toks[j + 2][3] == "," and toks[j + 3][0] == "str" and _NAME.match(key[3].replace("-", "_")):
                    self.pair(key[3], [(toks[j + 3][1], toks[j + 3][2], True)], [], indent)
                else:
                    self.pair(name, [(key[1], key[2], True)], [], indent)
                i = j + 1
            else:
                i = max(j, i + 1) if kind == "id" else i + 1

    def block(self, name: str, i: int, indent: int) -> int:
        """A block scalar: the lines that are further in; gives the token after it."""
        toks, start, end = self.toks, None, None
        while i < len(toks):
            kind, a, b, s = toks[i]
            if kind == "nl":
                if len(s) - 1 <= indent and self.text[b : b + 1] not in ("", "\n"):
                    break
            else:
                start, end = a if start is None else start, b
            i += 1
        if start is not None:
            line = self.text.find("\n", end)
            start = self.text.rfind("\n", 0, start) + 1
            start += len(self.text[start:]) - len(self.text[start:].lstrip()) if start < end else 0
            self.pair(name, [(start, line if line >= 0 else len(self.text), True)], [], indent)
        return i


def lexed_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """Literals that reach a sensitive name, over constants if need be."""
    lexer = _Lexer(text)
    if "${" in text:
        for m in _DEFAULT.finditer(text):
            lexer.reach(m[1], (m.start(2), m.end(2), True))
    if "</" in text:
        for m in _XML.finditer(text):
            a, b = m.span(2)
            value = m[2].strip()
            a += len(m[2]) - len(m[2].lstrip())
            lexer.reach(m[1], (a, a + len(value), True))
    for m in _ATTRIBUTE.finditer(text) if "value=" in text else ():
        lexer.reach(m[1], (m.start(3), m.end(3), True))
    out = [(a, 3, b, a, b) for a, b in lexer.found]
    if "PRIVATE KEY-----" in text:
        out += [(m.start(), 3, m.end(), m.start(), m.end()) for m in PEM.finditer(text)]
    return out


def spans(text: str) -> tuple[list, list]:
    """Base spans and all spans, each by start, then kind; the lexer's count where no base span overlaps them."""
    base = sorted(base_spans(text))
    extra, k, far = [], 0, -1
    for s in sorted(set(lexed_spans(text))):
        while k < len(base) and base[k][0] < s[2]:
            far = max(far, base[k][2])
            k += 1
        if far <= s[0]:
            extra.append(s)
            far = s[2]
    return base, sorted(base + extra)


def _joined(found: list) -> str:
    return ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in found)


def redacted(text: str) -> str:
    """The text with each secret value as [SECRET]; names and quotes stay."""
    out, at = [], 0
    for _, _, _, a, b in sorted(spans(text)[1], key=lambda s: (s[3], -s[4])):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def gate(text: Column) -> Column:
    """True wherever a span can be; evaluated in the JVM so that other texts never go to Python."""
    low = F.lower(text)
    return reduce(or_, (low.contains(s) for s in STEMS)) | text.contains("AKIA") | text.contains("PRIVATE KEY") | text.rlike("[0-9a-f]{24}")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans, n_literal."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_literal", T.LongType())])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, found = spans(text) if text else ([], [])
                count = Counter(s[1] for s in found)
                rows.append((count[0], count[1], count[2], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found), count[3]))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string() if k in (3, 4) else pa.int64()) for k, c in enumerate(cols))], names)

    return docs.select(F.col(id_col), F.when(gate(F.col(text_col)), F.col(text_col)).alias("t")).mapInArrow(trimmed(run), schema)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs, all columns, with the secrets of text_col masked and length_col set to the new length."""
    masked = fresh(docs, "masked")

    @F.pandas_udf(T.StringType())
    def mask(texts):
        return texts.map(lambda t: redacted(t) if t else t)

    # Texts that can hold no secret reach the function as null.
    out = docs.withColumn(masked, mask(F.when(gate(F.col(text_col)), F.col(text_col))))
    out = out.withColumn(text_col, F.coalesce(F.col(masked), F.col(text_col)))
    if length_col:
        out = out.withColumn(length_col, F.when(F.col(masked).isNotNull(), F.length(text_col).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return out.drop(masked)
