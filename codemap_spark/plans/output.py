"""What commands print: JSON by default, text for people, tab-separated lines for CI."""

from __future__ import annotations

import json
from collections.abc import Callable


def _issues(d: dict) -> str:
    rows = [f"{i['severity']:7} {i['code']} {i['subsystem'] or '-'}: {i['message']}" for i in d["issues"] if not i.get("suppressed")]
    return "\n".join([f"{d['status']} ({d['mode']})", *rows, *(f"next: {s}" for s in d.get("next_steps", []))])


def _table(d: dict) -> str:
    rows = d["rows"]
    names = list(rows[0]) if rows else []
    wide = {c: max(len(c), *(len(str(r[c])) for r in rows)) for c in names}
    line = lambda r: "  ".join(str(r[c]).ljust(wide[c]) for c in names).rstrip()
    return "\n".join([line({c: c for c in names}), *map(line, rows)]) if rows else "nothing"


#: The first that holds renders a document.
RENDERERS: list[tuple[Callable[[dict], bool], Callable[[dict], str]]] = [
    (lambda d: "error" in d, lambda d: f"{d['error']['code']}: {d['error']['message']}"),
    (lambda d: "issues" in d, _issues),
    (lambda d: "rows" in d, _table),
    (lambda d: "text" in d, lambda d: d["text"]),
    (lambda d: "steps" in d, lambda d: "\n".join(f"[{'x' if s['done'] else ' '}] {s['step']}" for s in d["steps"])),
    (lambda d: "written" in d, lambda d: "\n".join(d["written"]) or "nothing written"),
]


def human(doc: dict) -> str:
    for holds, render in RENDERERS:
        if holds(doc):
            return render(doc)
    return "\n".join(f"{k}: {v}" for k, v in doc.items())


def ci(doc: dict) -> str:
    """One line a finding: severity, code, place, message; or the status alone."""
    if "error" in doc:
        return "fatal\t" + "\t".join(str(doc["error"][k]) for k in ("code", "message"))
    rows = ["\t".join((i["severity"], i["code"], i["subsystem"] or "-", i["message"].replace("\t", " "))) for i in doc.get("issues", []) if not i.get("suppressed")]
    return "\n".join(rows) or f"ok\t{doc.get('status', 'fresh')}"


def emit(doc: dict, how: str = "json") -> str:
    return human(doc) if how == "human" else ci(doc) if how == "ci" else json.dumps(doc, ensure_ascii=False, default=str)
