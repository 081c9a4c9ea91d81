"""The commands: ``python -m codemap_spark <command>`` over a Project."""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import select
import sys
import tempfile
from pathlib import Path

from codemap_spark import __version__
from codemap_spark.plans import output
from codemap_spark.sources import extract, manifests

READS = ("list", "describe", "overview", "where", "impact", "validate", "preflight", "calibrate", "coverage", "fix-coverage", "discover", "cache", "sdd")


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("codemap").config("spark.ui.enabled", "false").getOrCreate()


def rows(df) -> dict:
    return {"rows": [r.asDict(recursive=True) for r in df.collect()]}  # what a person reads: subsystems, symbols, findings


def guide(root: Path) -> dict:
    """A checklist of what a project still lacks."""
    top = root / manifests.FOLDER / "root.yaml"
    names = [s[0] for s in manifests.load(root).subsystems] if top.is_file() else []
    steps = [
        ("init: write the root manifest", top.is_file()), ("discover --apply: write the first subsystems", bool(names)),
        ("calibrate --dump-baseline: accept today's differences", (root / manifests.FOLDER / "baseline" / "drift.json").is_file()), ("ci: run preflight on every change", (root / ".github" / "workflows" / "codemap.yml").is_file()),
    ]
    return {"steps": [{"step": s, "done": d} for s, d in steps]}


WORKFLOW = """name: codemap
on: [push, pull_request]
jobs:
  preflight:
    runs-on: ubuntu-latest
    steps:
      - uses: actions/checkout@v4
        with: {fetch-depth: 0}
      - uses: actions/setup-python@v5
        with: {python-version: "3.13"}
      - run: pip install pyspark pandas pyarrow pyyaml
      - run: python -m codemap_spark preflight --ci
"""
NOTES = ("AGENTS.md", "<!-- codemap -->", "<!-- /codemap -->")
NOTE = """Ask the map before searching the tree:
- `python -m codemap_spark where NAME` finds who defines a symbol;
- `python -m codemap_spark impact NAME` tells who breaks when it changes;
- `python -m codemap_spark validate --quick` after an edit."""


def ci_files(root: Path, apply: bool) -> dict:
    path = root / ".github" / "workflows" / "codemap.yml"
    if not apply:
        return {"text": WORKFLOW}
    if path.exists():
        return {"written": []}
    manifests._replace(path, WORKFLOW)
    return {"written": [path.relative_to(root).as_posix()]}


def agent_files(root: Path, apply: bool) -> dict:
    """The block between the marks is ours; the rest of the file stays."""
    name, start, end = NOTES
    path = root / name
    text = path.read_text(encoding="utf-8") if path.exists() else ""
    block = f"{start}\n{NOTE}\n{end}"
    new = text[: text.index(start)] + block + text[text.index(end) + len(end) :] if start in text and end in text else (f"{text.rstrip()}\n\n" if text.strip() else "") + block + "\n"
    if apply and new != text:
        manifests._replace(path, new)
    return {"written": [name] if apply and new != text else []} if apply else {"text": block}


def read_event(stream=None, seconds: float = 5.0) -> dict:
    """One JSON value from a stream, as soon as it is whole and without waiting for its end; {} where none comes in time."""
    stream, data, decoder = stream or sys.stdin, "", json.JSONDecoder()
    fd = stream.fileno()
    while select.select([fd], [], [], seconds)[0]:
        part = os.read(fd, 65536)
        data += part.decode("utf-8", "replace")
        try:
            value = decoder.raw_decode(data.lstrip())[0]
            return value if isinstance(value, dict) else {}
        except ValueError:
            if not part:
                break
    return {}


def marked(root: Path, session_id: str, kind: str, folder: str | None = None) -> bool:
    """Whether a note was given in this session; from now on it was."""
    home = Path(folder or os.environ.get("CODEMAP_HOOK_DIR") or Path(tempfile.gettempdir()) / "codemap-hooks")
    path = home / hashlib.sha256(f"{root.resolve()}\0{session_id}\0{kind}".encode()).hexdigest()[:16]
    if path.exists():
        return True
    try:
        home.mkdir(parents=True, exist_ok=True)
        path.touch()
    except OSError:
        pass  # a note more does no harm
    return False


def hook(event: dict, root: Path) -> dict:
    """A note for prompts that ask about structure, once a session."""
    import re

    from codemap_spark.operators.locate import SHAPES

    if re.search(SHAPES, str(event.get("prompt") or "")) and not marked(root, str(event.get("session_id", "")), "note"):
        return {"text": NOTE}
    return {}


PHASES = {"specify": ("describe", "where"), "plan": ("impact", "overview"), "implement": ("validate",), "review": ("preflight", "calibrate")}


def sdd(project, what: str) -> dict:
    """status: the phases; a phase: its commands; doctor: how the modes judge the project now."""
    if what == "doctor":
        return {"rows": [{"mode": m, "status": (r := project.report(m))["status"], "ok": r["ok"]} for m in ("quick", "full", "hotfix")]}
    return {"rows": [{"phase": p, "commands": " ".join(c)} for p, c in PHASES.items() if what in ("status", p)]}


def cache(project, args) -> dict:
    from codemap_spark.operators import incremental

    at, schema = str(project.root / manifests.FOLDER / "state"), project.state().schema
    if args.migrate is not None:
        return {"written": [f"v={args.migrate + 1}"] if incremental.migrate(project.spark, at, schema, args.migrate, args.migrate + 1) else []}
    saved = incremental.read_state(project.spark, at, schema)
    if args.inspect:
        return rows(incremental.inspect(saved).orderBy("level", "subsystem", "language"))
    from codemap_spark.operators.graph import _saved

    # The old state is read whole before it is written over.
    kept = _saved(project.spark, incremental.pruned(saved, project.files) if args.prune else project.state())
    incremental.write_state(kept, at)
    return {"written": [f"{kept.count()} files"]}


def newer(known: list[str], own: str = __version__) -> str | None:
    """The newest of known versions above our own; names that are no versions don't count."""
    def key(v: str) -> tuple[int, ...] | None:
        parts = v.removeprefix("v").split(".")
        return tuple(map(int, parts)) if all(p.isdigit() for p in parts) else None

    found = [v for v in known if key(v) and key(v) > key(own)]
    return max(found, key=key, default=None)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("codemap")
    p.add_argument("--root", default=".")
    p.add_argument("-H", "--human", action="store_true")
    p.add_argument("--ci", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda command, *flags, **valued: _with(sub.add_parser(command), flags, valued)
    for name in ("guide", "upgrade"):
        add(name)
    add("overview")
    add("init", project=None, subsystem=None, path=None)
    for name in ("ci", "agent"):
        add(name, "--apply")
    add("agent-hook")
    add("upgrade-check", known=None)
    add("list", namespace=None)
    add("describe", "--full", "--deep", name="")
    add("where", "--prefix", name="")
    add("impact", "--verify", "--include-raw-queries", name="")
    add("validate", "--quick", mode="full", fail_on="")
    add("preflight", "--ci", fail_on="")
    add("calibrate", "--apply", "--check", "--dump-baseline", "--prune-unknown", "--prune-missing-exports", "--track-interfaces", "--coarsen-interfaces")
    add("coverage", "--summary", why=None)
    add("fix-coverage", "--auto", "--apply", explain=None)
    add("discover", "--apply", namespace=None, merge_into=None)
    add("edit", name="", field=None, value=None)
    c = add("cache", "--prune", "--inspect")
    c.add_argument("--migrate", type=int)
    add("sdd", what="status")
    return p


def _with(p: argparse.ArgumentParser, flags, valued) -> argparse.ArgumentParser:
    for f in flags:
        p.add_argument(f, action="store_true", default=argparse.SUPPRESS if f == "--ci" else False)
    for name, default in valued.items():
        p.add_argument(name if name in ("name", "what", "known") else "--" + name.replace("_", "-"), **({"nargs": "?"} if name in ("name", "what", "known") else {}), default=default)
    return p


def run(args, spark=None) -> tuple[dict, int]:
    """The document of a command and its exit code: 1 where a gate blocks, 2 where it can't run."""
    root = Path(args.root)
    name = args.command
    if name == "guide":
        return guide(root), 0
    if name == "init":
        written = manifests.init(root, args.project, sorted({extract.LANGUAGES[p.suffix] for p in root.iterdir() if p.suffix in extract.LANGUAGES}))
        if args.subsystem and manifests.add_subsystem(root, args.subsystem, {"role": "service", "criticality": "leaf", "paths": [args.path or args.subsystem], "exposes": [], "consumes": []}):
            written.append(f"{manifests.FOLDER}/subsystems/{args.subsystem}.yaml")
        return {"written": written}, 0
    if name == "ci":
        return ci_files(root, args.apply), 0
    if name == "agent":
        return agent_files(root, args.apply), 0
    if name == "agent-hook":
        return hook(read_event(), root), 0
    if name in ("upgrade", "upgrade-check"):
        return {"own": __version__, "newer": newer((getattr(args, "known", None) or "").split(","))}, 0
    found = manifests.find_root(str(root))
    if found is None:
        return {"error": {"code": "E_MANIFEST_NOT_FOUND", "message": "no root manifest at or above this folder", "fix": "run init"}}, 2
    if name == "edit":
        try:
            manifests.edit(found, args.name, args.field, json.loads(args.value) if args.value else None)
        except (KeyError, ValueError) as e:
            return {"error": {"code": "E_USAGE", "message": str(e), "fix": f"fields: {', '.join(manifests.EDITABLE)}"}}, 2
        return {"written": [args.name]}, 0
    from codemap_spark.plans.project import Project

    p = Project(spark or session(), str(found))
    fail_on = tuple(filter(None, getattr(args, "fail_on", "").split(",")))
    if name == "validate":
        doc = p.report("quick" if args.quick else args.mode, fail_on)
        return doc, 0 if doc["ok"] else 1
    if name == "preflight":
        doc = p.report("preflight", fail_on)
        return doc, 0 if doc["ok"] else 1
    if name == "calibrate":
        how = {"accept": args.prune_missing_exports, "track": args.track_interfaces, "coarsen": args.coarsen_interfaces}
        if args.dump_baseline:
            p.dump_baselines()
            return {"written": ["baseline"]}, 0
        if args.check:
            gate = rows(p.drift_gate().orderBy("key"))
            return gate, 1 if any(r["status"] == "new" for r in gate["rows"]) else 0
        if args.apply:
            return {"written": p.apply_calibration(args.prune_unknown, **how)}, 0
        return rows(p.calibrate(**how).orderBy("subsystem", "change", "target", "detail")), 0
    if name == "discover":
        merges = [tuple(x.split("=", 1)) for x in (args.merge_into or "").split(",") if "=" in x]
        return ({"written": p.apply_discovery(merges, args.namespace)} if args.apply else {"proposals": p.proposals(merges, args.namespace)}), 0
    if name == "coverage":
        return rows(p.why_path(args.why) if args.why else p.mapping() if args.summary else p.coverage()), 0
    if name == "fix-coverage":
        if args.explain:
            return rows(p.why_path(args.explain)), 0
        if args.auto:
            return {"written" if args.apply else "proposed": p.fix_coverage(args.apply)}, 0
        from codemap_spark.operators import coverage

        return rows(coverage.samples(p.classified())), 0
    if name == "cache":
        return cache(p, args), 0
    if name == "sdd":
        return sdd(p, args.what), 0
    if name == "impact":
        doc = rows(p.impact(args.name))
        if args.verify:
            doc["undeclared"] = rows(p.verify_impact().where(f"provider = '{args.name}'").orderBy("consumer"))["rows"] if manifests.NAME.match(args.name) else []
        if args.include_raw_queries:
            doc["heuristic"] = rows(p.raw_consumers(args.name))["rows"]
        return doc, 0
    if name == "where":
        doc = rows(p.where(args.name, args.prefix))
        if not doc["rows"]:
            near, subs = p.suggest(args.name)
            doc |= {"did_you_mean": rows(near)["rows"], "subsystems": rows(subs)["rows"]}
        return doc, 0
    if name == "describe" and args.name:
        if args.name not in {s[0] for s in p.declared.subsystems}:
            return {"error": {"code": "E_SUBSYSTEM_NOT_FOUND", "message": args.name, "fix": "list shows all"}}, 2
        return rows(p.describe(args.name)), 0
    return rows(p.overview() if name == "overview" else p.list(getattr(args, "namespace", None))), 0


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    try:
        doc, code = run(args, spark)
    except Exception as e:  # noqa: BLE001  a command always gives a document
        doc, code = {"error": {"code": "E_INTERNAL", "message": f"{type(e).__name__}: {e}".splitlines()[0], "fix": "run again with a smaller scope"}}, 2
    print(output.emit(doc, "human" if args.human else "ci" if args.ci else "json"))
    return code
