"""Source texts to symbols and imports: one row function per language, run by mapInPandas.

An extractor never raises: what can't be read gives a row with an error. Only
top-level declarations count. Rows carry ord, their place in the file.
"""

from __future__ import annotations

import ast
import json
import posixpath
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGES = {".py": "python", ".sql": "sql", ".prisma": "prisma", ".sh": "shell", ".bash": "shell", ".zsh": "shell", **dict.fromkeys((".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts"), "typescript")}
#: Source code without an extractor.
FOREIGN = {
    ".go": "go", ".rs": "rust", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".rb": "ruby", ".php": "php", ".cs": "c#", ".swift": "swift", ".scala": "scala",
    **dict.fromkeys((".c", ".h"), "c"), **dict.fromkeys((".cc", ".cpp", ".cxx", ".hpp", ".hh"), "c++"), ".m": "objective-c", ".mm": "objective-c++", ".dart": "dart", ".lua": "lua",
    ".ex": "elixir", ".exs": "elixir", ".erl": "erlang", ".clj": "clojure", ".hs": "haskell", ".ml": "ocaml", ".r": "r", ".jl": "julia", ".groovy": "groovy", ".vue": "vue", ".svelte": "svelte", ".ps1": "powershell",
}
MOST_BYTES = 1_000_000
IGNORED = ("node_modules", ".git", "dist", "build", "__pycache__", ".venv", "venv", "target", "coverage")

SCHEMA = "path string, ord int, what string, name string, kind string, line int, exported boolean, op string, tbl string, col string, columns array<string>, target string, names array<string>, error string"
FIELDS = ["ord", "what", "name", "kind", "line", "exported", "op", "tbl", "col", "columns", "target", "names", "error"]


def symbol(name: str, kind: str, line: int, exported: bool = True, **meta) -> dict:
    return {"what": "symbol", "name": name, "kind": kind, "line": line, "exported": exported, **meta}


def imported(module: str, line: int, names: list[str] | None = None) -> dict:
    return {"what": "import", "name": module, "line": line, "names": names or []}


# --- Python ------------------------------------------------------------------------------------


def _literal_all(tree: ast.Module) -> set[str] | None:
    for node in tree.body:
        if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets):
            try:
                return {x for x in ast.literal_eval(node.value) if isinstance(x, str)}
            except (ValueError, TypeError, SyntaxError):
                return None
    return None


def _bases(node: ast.ClassDef) -> set[str]:
    """Dotted names of base classes."""
    return {ast.unparse(b) for b in node.bases if isinstance(b, ast.Name | ast.Attribute)}


def _django(classes: list[ast.ClassDef]) -> set[str]:
    """Names of the file's classes that are models by a base of theirs, directly or over each other."""
    bases = {c.name: _bases(c) for c in classes}
    models = {n for n, bs in bases.items() if any(b == "Model" or b.endswith(".Model") for b in bs)}
    while new := {n for n, bs in bases.items() if n not in models and bs & models}:
        models |= new
    return models


def _orm_table(node: ast.ClassDef, models: set[str]) -> str | None:
    """The table of a mapped class; an abstract model has none, a name that is computed gives the class's."""
    django = node.name in models
    table, mapped, meta_table = None, False, None

    def pairs(body: list[ast.stmt]) -> Iterator[tuple[str, ast.expr]]:
        for x in body:
            if isinstance(x, ast.Assign) and len(x.targets) == 1 and isinstance(x.targets[0], ast.Name):
                yield x.targets[0].id, x.value

    text = lambda v: v.value if isinstance(v, ast.Constant) and isinstance(v.value, str) else None
    for key, value in pairs(node.body):
        if key == "__tablename__":
            mapped, table = True, text(value)
        elif key == "__table__" and isinstance(value, ast.Call) and value.args and text(value.args[0]):
            mapped, table = True, text(value.args[0])
        elif key == "__abstract__" and getattr(value, "value", None) is True:
            return None
    for meta in (x for x in node.body if isinstance(x, ast.ClassDef) and x.name == "Meta"):
        for key, value in pairs(meta.body):
            if key == "abstract" and getattr(value, "value", None) is True and django:
                return None
            meta_table = text(value) if key == "db_table" else meta_table
    if mapped:
        return table or node.name
    return (meta_table or node.name) if django else None


def python(text: str) -> list[dict]:
    tree = ast.parse(text)
    public, out = _literal_all(tree), []
    models = _django([n for n in tree.body if isinstance(n, ast.ClassDef)])

    def shown(name: str) -> bool:
        return name in public if public is not None else not name.startswith("_")

    for node in tree.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            out.append(symbol(node.name, "function", node.lineno, shown(node.name)))
        elif isinstance(node, ast.ClassDef):
            out.append(symbol(node.name, "class", node.lineno, shown(node.name)))
            if table := _orm_table(node, models):
                out.append(symbol(table, "table", node.lineno, True, op="create_table", tbl=table))
        elif isinstance(node, ast.Assign | ast.AnnAssign):
            for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(t, ast.Name) and t.id != "__all__":
                    out.append(symbol(t.id, "const" if t.id.isupper() else "variable", node.lineno, shown(t.id)))
        elif isinstance(node, ast.Import):
            out += [imported(a.name, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out.append(imported("." * node.level + (node.module or ""), node.lineno, [a.name for a in node.names if a.name != "*"]))
    return out


def _liner(text: str) -> Callable[[int], int]:
    """The line of a place, by search among line ends that are found once."""
    ends = [m.start() for m in re.finditer("\n", text)]
    return lambda at: bisect_left(ends, at) + 1


# --- TypeScript and JavaScript -------------------------------------------------------------------


def masked(text: str, comments: str, quotes: str) -> str:
    """text with comments and the insides of strings blanked, line ends kept; comments is a regex."""
    token = re.compile(f"(?:{comments})" + "".join(rf"|{q}(?:[^{q}\\]|\\.)*{q}" for q in quotes), re.S)
    return token.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] not in quotes else m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1], text)


_TS_KIND = {"function": "function", "class": "class", "interface": "interface", "type": "type", "enum": "enum", "namespace": "namespace", "module": "namespace", "const": "const", "let": "variable", "var": "variable"}
_TS_DECL = re.compile(r"(?m)^(export\s+)?(default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function\*?|class|interface|type|enum|namespace|module|const(?:\s+enum)?|let|var)\s*(?<=[\s*])([A-Za-z_$][\w$]*|(?<=const )[{\[]|(?<=let )[{\[]|(?<=var )[{\[])")
_TS_FROM = re.compile(r"""(?m)^(import|export)\s+(?:type\s+)?([^'";]*?)\s*(?:from\s*)?(['"])([^'"\n]+)\3""")
_TS_REQUIRE = re.compile(r"""(?:(?:const|let|var)\s+(\{[^}]*\}|[\w$]+)\s*=\s*)?require\(\s*(['"])([^'"]+)\2\s*\)""")
_RANK = {"class": 0, "function": 1, "enum": 2, "interface": 3, "type": 4}


def _names(clause: str) -> list[str]:
    return [n for n in (re.split(r"\s+as\s+", x.strip().removeprefix("type ").strip())[0] for x in re.sub(r"[{}]", ",", clause).split(",")) if n and n != "*"]


_TS_BRACKETS = {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}
_DRIZZLE = re.compile(r"^\s*(?:[\w$]+\.)?(?:pgTable|sqliteTable|mysqlTable)\s*\(\s*(?:(['\"`])([^'\"`\n]*)\1)?")
_DECORATOR = re.compile(r"@([A-Za-z_$][\w$.]*)\s*(\()?")
_ENTRIES = {"Controller": "nest_controller", "Resolver": "nest_resolver"}


def _declarators(code: str, at: int) -> Iterator[tuple[str, int, int]]:
    """(name, its start, start of its value) of each declarator of a statement; patterns give each name that they bind."""
    depth, k, want = 0, at, True
    while k < len(code):
        c = code[k]
        if want and depth == 0 and (m := re.compile(r"[A-Za-z_$][\w$]*").match(code, k)):
            v = re.compile(r"\s*(?::[^=;\n]*?)?=(?!=|>)").match(code, m.end())
            yield m[0], k, v.end() if v else -1
            k, want = m.end(), False
            continue
        if want and depth == 0 and c in "{[":
            end = _closing(code, k)
            for part in _split(code[k + 1 : end], "([{", ")]}"):
                name = re.split(r"=(?!>)", part.split(":")[-1])[0].strip().lstrip(".")
                if re.fullmatch(r"[A-Za-z_$][\w$]*", name):
                    yield name, k, -1
            k, want = end + 1, False
            continue
        depth += _TS_BRACKETS.get(c, 0)
        if depth < 0 or depth == 0 and (c == ";" or c == "\n" and re.match(r"\s*(?:export|import|const|let|var|function|class|interface|type|enum|async|declare|abstract|namespace|@|/|$)", code[k + 1 : k + 40])):
            return
        if c == "," and depth == 0:
            want = True
        k += 1


def _closing(code: str, at: int) -> int:
    """Place of the bracket that closes the one at a place."""
    depth = 0
    for k in range(at, len(code)):
        depth += _TS_BRACKETS.get(code[k], 0)
        if depth == 0:
            return k
    return len(code)


def _decorators(code: str, visible: str, at: int) -> dict[str, str]:
    """name -> argument text of the decorators right before a declaration."""
    out: dict[str, str] = {}
    start = max(code.rfind(";", 0, at), code.rfind("}\n", 0, at)) + 1
    # An argument's braces belong to the decorator, so the search starts at the line of the first @.
    lines = code[:at].rstrip().rsplit("\n", 12)
    head = code[:at].rstrip()
    begin = len(head)
    for row in reversed(lines[1:] if len(lines) > 1 else lines):
        begin = head.rfind(row, 0, begin + len(row)) if row else begin
        if row.lstrip().startswith("@"):
            start = min(start, begin) if start > begin else begin
        elif not re.match(r"\s*[\]})\w'\",:{\[(]", row) or re.match(r"\s*(?:export|import|const|let|class|function)\b", row):
            break
    for m in _DECORATOR.finditer(code, start, at):
        end = _closing(code, m.end() - 1) if m[2] else m.end()
        out[m[1].split(".")[-1]] = visible[m.end() : end] if m[2] else ""
    return out


def typescript(text: str) -> list[dict]:
    code = masked(text, r"//[^\n]*|/\*.*?\*/", "'\"`")
    visible = masked(text, r"//[^\n]*|/\*.*?\*/", "`")
    line = _liner(text)
    found = []

    def table(at: int, name: str) -> None:
        found.append((at, symbol(name, "table", line(at), True, op="create_table", tbl=name)))

    for m in _TS_DECL.finditer(code):
        kind = "enum" if m[3].endswith("enum") else _TS_KIND[m[3].rstrip("*")]
        if m[3] in ("const", "let", "var"):
            for name, at, value in _declarators(code, m.start(4) if code[m.start(4)] not in "{[" else m.start(4)):
                found.append((m.start(), symbol(name, kind, line(at), bool(m[1]))))
                if value >= 0 and (d := _DRIZZLE.match(visible[value : value + 400])):
                    table(m.start(), d[2] or name)
            continue
        extra = {}
        if kind == "class":
            marks = _decorators(code, visible, m.start())
            entry = next((role for d, role in _ENTRIES.items() if d in marks), None)
            extra = {"target": entry} if entry else {}
            if "Entity" in marks:
                arg = re.match(r"""\s*(?:(['"])([^'"]*)\1|\{[^}]*?\bname\s*:\s*(['"])([^'"]*)\3)""", marks["Entity"])
                table(m.start(), (arg and (arg[2] or arg[4])) or m[4])
        found.append((m.start(), symbol(m[4], kind, line(m.start()), bool(m[1]), **extra)))
        if m[2]:
            found.append((m.start(), symbol("default", "default", line(m.start()))))
    for m in re.finditer(r"(?m)^export\s+default\b(?!\s+(?:async\s+)?(?:abstract\s+)?(?:function|class)\b)", code):
        found.append((m.start(), symbol("default", "default", line(m.start()))))
    kinds = {s["name"]: s["kind"] for _, s in found if s["kind"] not in ("unknown", "default", "table")}
    for m in re.finditer(r"(?m)^export\s+(?:type\s+)?\{([^}]*)\}(\s*from\b)?", code):
        for x in filter(str.strip, m[1].split(",")):
            names = [n.removeprefix("type ").strip() for n in re.split(r"\s+as\s+", x.strip())]
            # A clause over local names shows their declarations; over another file's it stays open.
            found.append((m.start(), symbol(names[-1], "unknown" if m[2] else kinds.get(names[0], "unknown"), line(m.start()))))
    for m in re.finditer(r"(?m)^export\s+\*\s+as\s+([\w$]+)", code):
        found.append((m.start(), symbol(m[1], "namespace", line(m.start()))))
    for m in re.finditer(r"(?m)^(?:module\.)?exports\.([\w$]+)\s*=", code):
        found.append((m.start(), symbol(m[1], "variable", line(m.start()))))
    for m in re.finditer(r"(?m)^(?:[\w$.]+\s*=\s*)?module\.exports\s*=\s*(?:[\w$.]+\s*=\s*)*(\{|[A-Za-z_$][\w$]*|[^\s])", code):
        if m[1] == "{":
            for part in _split(code[m.end() : _closing(code, m.end() - 1)], "([{", ")]}"):
                if (n := re.match(r"\s*(?:async\s+)?([A-Za-z_$][\w$]*)\s*(?:$|[:,(])", part)) and not part.lstrip().startswith("..."):
                    found.append((m.start(), symbol(n[1], kinds.get(n[1], "variable"), line(m.start()))))
        else:
            found.append((m.start(), symbol("default", "default", line(m.start()))))
    best: dict[tuple, tuple] = {}
    for at, s in sorted(found, key=lambda x: x[0]):
        key = (s["name"], s["exported"], s["kind"] == "table")
        if key not in best or _RANK.get(s["kind"], 9) < _RANK.get(best[key][1]["kind"], 9):  # overloads collapse to one
            best[key] = (best[key][0] if key in best else at, s)
    out = [s for _, s in sorted(best.values(), key=lambda x: x[0])]
    out += [imported(m[4], line(m.start()), _names(m[2])) for m in _TS_FROM.finditer(visible)]
    seen = set()
    for m in _TS_REQUIRE.finditer(visible):
        key = (visible.rfind("\n", 0, m.start()), m[3])  # once a statement
        if key not in seen:
            seen.add(key)
            out.append(imported(m[3], line(m.start()), _names(m[1] or "") if (m[1] or "").startswith("{") else []))
    return out


# --- SQL -----------------------------------------------------------------------------------------


_ID = r'(?:"[^"]+"|`[^`]+`|\[[^\]]+\]|[A-Za-z_][\w$]*)'
_REF = rf"{_ID}(?:\s*\.\s*{_ID})*"
_CONSTRAINT = re.compile(r"(?i)^\s*(?:constraint|primary|foreign|unique|check|exclude|key|index|like)\b")


def bare(ref: str) -> str:
    """The last part of a reference, without quotes."""
    return re.findall(_ID, ref)[-1].strip('"`[]')


def sql_masked(text: str) -> str:
    token = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\$(\w*)\$.*?\$\1\$", re.S)
    return token.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _split(body: str, opens: str = "(", closes: str = ")") -> list[str]:
    parts, depth, at = [], 0, 0
    for k, c in enumerate(body):
        depth += (c in opens) - (c in closes)
        if c == "," and depth == 0:
            parts.append(body[at:k])
            at = k + 1
    return [*parts, body[at:]]


def _body(code: str, at: int) -> str:
    depth = 0
    for k in range(at, len(code)):
        depth += (code[k] == "(") - (code[k] == ")")
        if depth == 0:
            return code[at + 1 : k]
    return code[at + 1 :]


_SQL = [
    ("create_table", re.compile(rf"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:global\s+|local\s+)?(?:temp(?:orary)?\s+|unlogged\s+)?table\s+(?:if\s+not\s+exists\s+)?({_REF})\s*(\()?")),
    ("drop_table", re.compile(rf"(?i)\bdrop\s+table\s+(?:if\s+exists\s+)?({_REF}(?:\s*,\s*{_REF})*)")),
    ("alter", re.compile(rf"(?i)\balter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?({_REF})([^;]*)")),
    ("object", re.compile(rf"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:unique\s+|materialized\s+|constraint\s+)*(function|procedure|view|index|trigger|type)\s+(?:concurrently\s+)?(?:if\s+not\s+exists\s+)?({_REF})(?:[^;]*?\bon\s+({_REF}))?")),
    ("policy", re.compile(rf"(?i)\b(create|drop|alter)\s+policy\s+(?:if\s+exists\s+)?({_ID})\s+on\s+({_REF})(?:\s+rename\s+to\s+({_ID}))?")),
]
_ALTER = re.compile(rf"(?i)^\s*(?:(add)\s+(?:column\s+)?(?:if\s+not\s+exists\s+)?(?!constraint\b|primary\b|foreign\b|unique\b|check\b)({_ID})|(drop)\s+(?:column\s+)?(?:if\s+exists\s+)?(?!constraint\b)({_ID})|rename\s+to\s+({_ID})|rename\s+(?:column\s+)?({_ID})\s+to\s+({_ID})|((?:no\s+)?force|enable|disable)\s+row\s+level\s+security)")
_DDL = re.compile(r"(?i)\s*(?:(?:create\s+(?:\w+\s+){0,4}?|alter\s+|drop\s+)(?:table|policy)|create\s+(?:\w+\s+){0,3}?(?:view|index))\b")
_HEADER = re.compile(r"(?im)^\s*--\s*(revision|down_revision|order)\s*[:=]\s*(\S+)")


def sql(text: str) -> list[dict]:
    code = sql_masked(text)
    line = _liner(text)
    found, starts = [], []
    for what, pattern in _SQL:
        for m in pattern.finditer(code):
            at, n = m.start(), line(m.start())
            starts.append(at)
            if what == "create_table":
                columns = [re.match(_ID, x.strip())[0].strip('"`[]') for x in _split(_body(code, m.end(2) - 1)) if re.match(rf"\s*{_ID}", x) and not _CONSTRAINT.match(x)] if m[2] else []
                found.append((0, at, symbol(bare(m[1]), "table", n, True, op=what, tbl=bare(m[1]), columns=sorted(set(columns)))))
            elif what == "drop_table":
                found += [(0, at, symbol(bare(x), "drop", n, False, op=what, tbl=bare(x))) for x in m[1].split(",")]
            elif what == "alter":
                table = bare(m[1])
                for part in _split(m[2]):
                    if not (a := _ALTER.match(part)):
                        continue
                    if a[1]:
                        found.append((0, at, symbol(f"{table}.{bare(a[2])}", "column", n, True, op="add_column", tbl=table, col=bare(a[2]))))
                    elif a[3]:
                        found.append((0, at, symbol(f"{table}.{bare(a[4])}", "drop", n, False, op="drop_column", tbl=table, col=bare(a[4]))))
                    elif a[5]:
                        found.append((0, at, symbol(bare(a[5]), "rename", n, True, op="rename_table", tbl=table, target=bare(a[5]))))
                    elif a[6]:
                        found.append((0, at, symbol(f"{table}.{bare(a[7])}", "rename", n, True, op="rename_column", tbl=table, col=bare(a[6]), target=bare(a[7]))))
                    else:
                        found.append((1, at, symbol(table, "rls", n, False, op=re.sub(r"\s+", "_", a[8].lower()) + "_rls", tbl=table)))
            elif what == "object":
                kind = m[1].lower()
                found.append((0, at, symbol(bare(m[2]), "function" if kind == "procedure" else kind, n, True, op=f"create_{kind}", tbl=bare(m[3]) if m[3] and kind in ("index", "trigger") else None)))
            else:
                found.append((1, at, symbol(bare(m[2]), "policy", n, False, op=f"{m[1].lower()}_policy", tbl=bare(m[3]), target=bare(m[4]) if m[4] else None)))
    # Row security and policies come after the other statements, each kind in the order of the text.
    out = [s for _, _, s in sorted(found, key=lambda x: x[:2])]
    head = re.match(r"(?:\s*--[^\n]*\n|\s*\n)*", text)[0]
    out += [symbol(m[2], "schema_meta", 1, False, op=m[1].lower()) for m in _HEADER.finditer(head)]
    starts.sort()
    lost = [m for m in re.finditer(r"[^;]+", code) if _DDL.match(m[0]) and ((k := bisect_left(starts, m.start())) == len(starts) or starts[k] >= m.end())]
    if lost and not found:  # a header alone is no definition
        raise ValueError("definitions that could not be read")
    return out + ([symbol(str(len(lost)), "schema_error", line(lost[0].start()), False, op="unparsed")] if lost else [])


# --- Prisma and shell --------------------------------------------------------------------------------


def prisma(text: str) -> list[dict]:
    code = re.sub(r"//[^\n]*", "", text)
    blocks = list(re.finditer(r"(?m)^\s*(model|enum)\s+(\w+)\s*\{(.*?)^\s*\}", code, re.S))
    models = {m[2] for m in blocks if m[1] == "model"}
    out = []
    for m in blocks:
        n = code.count("\n", 0, m.start(1)) + 1
        if m[1] == "enum":
            out.append(symbol(m[2], "enum", n))
            continue
        name, columns = m[2], []
        for row in m[3].splitlines():
            if x := re.match(r'\s*@@map\("([^"]+)"\)', row):
                name = x[1]
            elif (f := re.match(r"\s*(\w+)\s+(\w+)(\[\])?\??(.*)", row)) and f[2] not in models:
                x = re.search(r'@map\("([^"]+)"\)', f[4])
                columns.append(x[1] if x else f[1])
        out.append(symbol(name, "table", n, True, op="create_table", tbl=name, columns=sorted(set(columns)), target=m[2]))
    return out


def shell(text: str) -> list[dict]:
    out = []
    for n, row in enumerate(text.splitlines(), 1):
        if m := re.match(r"(?:function\s+([\w-]+)\s*(?:\(\s*\))?|([\w-]+)\s*\(\s*\))\s*\{?", row):
            name = m[1] or m[2]
            out.append(symbol(name, "function", n, not name.startswith("_")))
        elif (m := re.match(r"""\s*(?:source|\.)\s+(['"]?)([^\s'"]+)\1""", row)) and "$" not in m[2]:
            out.append(imported(m[2], n))
    return out


EXTRACTORS: dict[str, Callable[[str], list[dict]]] = {"python": python, "typescript": typescript, "sql": sql, "prisma": prisma, "shell": shell}


def extract_one(path: str, text: str | None, language: str | None) -> list[dict]:
    if language not in EXTRACTORS:
        return []
    if text is None:
        return [{"what": "error", "error": "oversized"}]
    if len(text.encode("utf-8", "replace")) > MOST_BYTES:
        return [{"what": "error", "error": "oversized"}]
    try:
        return EXTRACTORS[language](text)
    except Exception as e:  # noqa: BLE001  a bad file is a finding
        return [{"what": "error", "error": f"{type(e).__name__}: {e}"[:200]}]


def extract(files: DataFrame) -> DataFrame:
    """Facts of files (path, language, text): symbols, imports and errors with ord."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, language, text in zip(pdf.path, pdf.language, pdf.text, strict=True):
                rows += [{"path": path, "ord": k, **r} for k, r in enumerate(extract_one(path, text, language))]
            pdf = pd.DataFrame(rows, columns=["path", *FIELDS], dtype=object)
            yield pdf.astype({"ord": "Int32", "line": "Int32"}).where(pdf.notna(), None)

    return files.select("path", "language", "text").mapInPandas(run, SCHEMA)


def source_files(spark: SparkSession, root: str, languages: dict[str, str] = LANGUAGES) -> DataFrame:
    """Files of languages under root: path below it, language, size, text; ignored folders left out.

    The text of an oversized file is never read into a row of text: it is null, and extract() gives an error for it.
    """
    ext = F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1)
    lang = F.create_map(*(F.lit(x) for kv in languages.items() for x in kv))
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "^" + re.escape(root.rstrip("/")) + "/", "")
    df = df.select(rel.alias("path"), lang[ext].alias("language"), F.col("length").alias("size"), F.col("content"))
    df = df.where(F.col("language").isNotNull() & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, IGNORED))))
    return df.withColumn("text", F.when(F.col("size") <= MOST_BYTES, F.decode("content", "UTF-8")))


def structure_hash(facts: DataFrame) -> DataFrame:
    """(path, structure_hash) over sorted symbols, without lines and export flags, then sorted modules."""
    meta = F.to_json(F.struct("col", "columns", "op", "tbl", "target"))
    row = F.when(F.col("what") == "symbol", F.concat(F.lit("sym:"), "kind", F.lit(":"), "name", F.lit(":"), meta)).when(F.col("what") == "import", F.concat(F.lit("imp:"), "name"))
    agg = facts.withColumn("r", row).groupBy("path")
    syms, imps = F.array_sort(F.collect_list(F.when(F.col("what") == "symbol", F.col("r")))), F.array_sort(F.collect_set(F.when(F.col("what") == "import", F.col("r"))))
    return agg.agg(F.sha2(F.array_join(F.concat(syms, imps), "\n"), 256).alias("structure_hash"))


def strip_jsonc(text: str) -> str:
    """JSON without comments and trailing commas."""
    out = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", out)


def aliases(config: str) -> list[tuple[str, str, str]]:
    """(prefix, suffix, target) of a compiler configuration's paths, most specific first."""
    return ordered(json.loads(strip_jsonc(config)).get("compilerOptions", {}).get("paths", {}))


def ordered(paths: dict[str, list[str]]) -> list[tuple[str, str, str]]:
    rows = []
    for pattern, targets in paths.items():
        head, star, tail = pattern.partition("*")
        rows += [(bool(star), -len(head), -len(tail), pattern, k, head, tail if star else None, t) for k, t in enumerate(targets)]
    return [(r[5], r[6] or "", r[7]) for r in sorted(rows, key=lambda r: r[:5])]


MOST_EXTENDS = 16


def load_aliases(root: Path) -> tuple[str | None, dict[str, list[str]]]:
    """(base folder, pattern -> targets) of a project's compiler configuration, with what it extends read first; nothing where it can't be read."""
    for name in ("tsconfig.json", "jsconfig.json"):
        if (root / name).is_file():
            try:
                return _merged(root, root / name)
            except (OSError, ValueError, AttributeError, TypeError):
                return None, {}
    return None, {}


def _merged(root: Path, path: Path) -> tuple[str | None, dict[str, list[str]]]:
    chain, seen = [], set()
    while path and path.is_file() and path.resolve() not in seen and len(chain) < MOST_EXTENDS:
        seen.add(path.resolve())
        config = json.loads(strip_jsonc(path.read_text(encoding="utf-8")))
        chain.append((path.parent.relative_to(root).as_posix(), config.get("compilerOptions") or {}))
        up = config.get("extends")
        up = up[-1] if isinstance(up, list) and up else up
        found = (path.parent / up) if isinstance(up, str) and up.startswith(".") else None
        path = found if found is None or found.is_file() else found.with_name(found.name + ".json")
        if path is not None and not path.resolve().is_relative_to(root.resolve()):
            path = None
    base, paths = None, {}
    for here, options in reversed(chain):
        if isinstance(options.get("baseUrl"), str):
            base = posixpath.normpath(posixpath.join(here, options["baseUrl"]))
        for pattern, targets in (options.get("paths") or {}).items():
            anchor = base if base is not None else here
            if isinstance(targets, list):
                paths[pattern] = [posixpath.normpath(posixpath.join(anchor, t)) for t in targets if isinstance(t, str)]
    return base, {k: v for k, v in paths.items() if v}


def alias_stems(module: str, base: str | None, paths: list[tuple[str, str, str]], patterns: set[str]) -> list[str]:
    """What a bare import may mean by aliases, most specific first, then below the base folder."""
    out = []
    for head, tail, target in paths:
        star = f"{head}*{tail}" in patterns
        if star and module.startswith(head) and module.endswith(tail) and len(module) >= len(head) + len(tail):
            out.append(target.replace("*", module[len(head) : len(module) - len(tail) or None], 1))
        elif not star and module == head:
            out.append(target)
    if base is not None:
        out.append(posixpath.normpath(posixpath.join(base, module)))
    # Targets may name a file; stems have no suffix.
    return list(dict.fromkeys(re.sub(r"(?<=[^/])\.(?:d\.)?(?:ts|tsx|js|jsx|mjs|cjs|mts|cts)$", "", x) for x in out))
