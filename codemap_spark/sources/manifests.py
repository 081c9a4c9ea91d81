"""Declared architecture: manifests, ignore rules, policy files, baselines and git, read on the driver.

All of these are a few small files of one repository. They become DataFrames
with the schemas below; what is malformed becomes a finding.
"""

from __future__ import annotations

import json
import os
import re
import subprocess
import tempfile
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

FOLDER = ".codemap"
ROLES = {"service": False, "platform": False, "connector": False, "library": False, "entrypoint": True}
CRITICALITY = {"core": -1, "connector": 1, "leaf": 0}
NAME = re.compile(r"[A-Za-z0-9_-]+\Z")
#: Ignore files in the order in which they are read: shared ones first, personal ones last.
IGNORE_FILES = (".gitignore", ".codemapignore", f"{FOLDER}/ignore", f"{FOLDER}/ignore.shared", ".codemapignore.local", f"{FOLDER}/ignore.local")
ENFORCE = ("on", "warn", "off")
#: Fields of a subsystem's manifest that list strings.
LISTS = ("paths", "files", "docs", "tests")

SUBSYSTEMS = "subsystem string, role string, criticality string, namespace string, parent string, description string"
EXPOSES = "subsystem string, name string, kind string, signature string, internal boolean"
CONSUMES = "consumer string, provider string, via string, interfaces array<string>"
CLAIMS = "owner string, prefix string"
LINKS = "owner string, field string, prefix string"
ISSUES = "code string, severity string, subsystem string, message string"


@dataclass
class Declared:
    """Rows of the declared relations and what was wrong with their files."""

    project: str = ""
    enforce: str = "on"
    roles: dict[str, bool] = field(default_factory=lambda: dict(ROLES))
    depths: dict[str, int] = field(default_factory=lambda: dict(CRITICALITY))
    subsystems: list[tuple] = field(default_factory=list)
    exposes: list[tuple] = field(default_factory=list)
    consumes: list[tuple] = field(default_factory=list)
    claims: list[tuple] = field(default_factory=list)
    links: list[tuple] = field(default_factory=list)
    entry_points: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    issues: list[tuple] = field(default_factory=list)

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {
            "subsystems": spark.createDataFrame(self.subsystems, SUBSYSTEMS), "exposes": spark.createDataFrame(self.exposes, EXPOSES), "consumes": spark.createDataFrame(self.consumes, CONSUMES),
            "claims": spark.createDataFrame(self.claims, CLAIMS), "links": spark.createDataFrame(self.links, LINKS), "issues": spark.createDataFrame(self.issues, ISSUES),
        }


def find_root(start: str) -> Path | None:
    """The nearest folder at or above start that has a root manifest."""
    for p in [Path(start).resolve(), *Path(start).resolve().parents]:
        if (p / FOLDER / "root.yaml").is_file():
            return p
    return None


def _parse(path: Path) -> object:
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def _list(x: object) -> list[str]:
    return [str(v) for v in x] if isinstance(x, list) else [str(x)] if isinstance(x, str) else []


def load(root: Path) -> Declared:
    """All manifests of a repository; a missing root manifest is an error of the caller, a bad subsystem a finding."""
    out = Declared()
    top = _parse(root / FOLDER / "root.yaml")
    if not isinstance(top, dict):
        out.issues.append(("E_SCHEMA_INVALID", "error", None, "the root manifest is not a mapping"))
        top = {}
    out.root(top)
    for name in _list(top.get("subsystems")):
        path = manifest_path(root, name)
        if path is None:
            out.issues.append(("E_SUBSYSTEM_NOT_FOUND", "error", name, "no manifest of this name"))
            continue
        try:
            m = _parse(path)
        except Exception as e:  # noqa: BLE001  a bad file is a finding
            out.issues.append(("E_MANIFEST_PARSE_ERROR", "error", name, str(e).splitlines()[0][:200]))
            continue
        out.add(name, m) if isinstance(m, dict) else out.issues.append(("E_SCHEMA_INVALID", "error", name, "not a mapping"))
    out.check_parents()
    return out


def manifest_path(root: Path, name: str) -> Path | None:
    """The manifest of a subsystem; a name with other characters has none, so none lies outside the folder."""
    if not NAME.match(name):
        return None
    return next((p for e in ("yaml", "yml", "json") if (p := root / FOLDER / "subsystems" / f"{name}.{e}").is_file()), None)


def _root(self: Declared, top: dict) -> None:
    """The root manifest; what has a wrong shape is a finding and the default stays."""

    def wrong(what: str) -> None:
        self.issues.append(("E_SCHEMA_INVALID", "error", None, what))

    self.project = str(top.get("project", ""))
    enforce = {False: "off", True: "on"}.get(top.get("enforce", "on"), top.get("enforce", "on"))
    if enforce in ENFORCE:
        self.enforce = enforce
    else:
        wrong(f"unknown enforce {enforce}")
    for field_ in ("subsystems", "languages", "entry_points"):
        if not isinstance(top.get(field_) or [], list | str):
            wrong(f"{field_} is no list")
    self.entry_points, self.languages = _list(top.get("entry_points")), _list(top.get("languages"))
    roles, depths = top.get("roles") or {}, top.get("criticality") or {}
    for what, value in (("roles", roles), ("criticality", depths)):
        if not isinstance(value, dict):
            wrong(f"{what} is no mapping")
    for name, r in roles.items() if isinstance(roles, dict) else ():
        if not isinstance(r or {}, dict):
            wrong(f"role {name} is no mapping")
            continue
        base = (r or {}).get("extends", (r or {}).get("type", "service"))
        if base not in self.roles:
            wrong(f"role {name} extends the unknown role {base}")
        self.roles[str(name)] = bool((r or {}).get("orphan_exposes", self.roles.get(base, False)))
    for name, depth in depths.items() if isinstance(depths, dict) else ():
        if isinstance(depth, int) and not isinstance(depth, bool) and depth >= -1:
            self.depths[str(name)] = depth
        else:
            wrong(f"criticality {name} is no depth")


def _add(self: Declared, name: str, m: dict) -> None:
    def wrong(what: str) -> None:
        self.issues.append(("E_SCHEMA_INVALID", "error", name, what))

    role, crit = str(m.get("role", "service")), str(m.get("criticality", "leaf"))
    for what, value, known in (("role", role, self.roles), ("criticality", crit, self.depths)):
        if value not in known:
            near = next((k for k in sorted(known) if one_edit(value, k)), None)
            wrong(f"unknown {what} {value}" + (f"; did you mean {near}?" if near else ""))
    if m.get("name") not in (None, name):
        wrong(f"the manifest names itself {m['name']}")
    text = lambda k: None if m.get(k) is None else str(m[k])
    self.subsystems.append((name, role, crit, text("namespace"), text("parent"), text("description")))
    for field_ in LISTS:
        if not isinstance(m.get(field_) or [], list | str):
            wrong(f"{field_} is no list")
    for field_ in ("exposes", "consumes"):
        if not isinstance(m.get(field_) or [], list):
            wrong(f"{field_} is no list")
            continue
        for e in m.get(field_) or []:
            e = {"name": e, "subsystem": e} if isinstance(e, str) else e
            key = "name" if field_ == "exposes" else "subsystem"
            if not isinstance(e, dict) or not isinstance(e.get(key), str):
                wrong(f"an entry of {field_} has no {key}")
            elif field_ == "exposes":
                self.exposes.append((name, e["name"], None if e.get("kind") is None else str(e["kind"]), None if e.get("signature") is None else str(e["signature"]), bool(e.get("internal", False))))
            else:
                self.consumes.append((name, e["subsystem"], None if e.get("via") is None else str(e["via"]), _list(e.get("interfaces"))))
    self.claims += [(name, p.rstrip("/") or ".") for p in (*_list(m.get("paths")), *_list(m.get("files")))]
    self.links += [(name, f, p.rstrip("/") or ".") for f in ("docs", "tests") for p in _list(m.get(f))]


def _check_parents(self: Declared) -> None:
    up = {s[0]: s[4] for s in self.subsystems}
    for name, parent in sorted(up.items()):
        if parent is None:
            continue
        if parent == name or parent not in up:
            self.issues.append(("E_SCHEMA_INVALID", "error", name, "its own parent" if parent == name else f"unknown parent {parent}"))
            continue
        seen, at = {name}, parent
        while at is not None and at not in seen:
            seen.add(at)
            at = up.get(at)
        if at == name:
            self.issues.append(("E_SCHEMA_INVALID", "error", name, "circular parents"))


Declared.add, Declared.root, Declared.check_parents = _add, _root, _check_parents


def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion or replacement makes a into b."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    k = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return a[k:] == b[k + 1 :] or a[k + 1 :] == b[k + 1 :]


def glob_regex(pattern: str) -> str:
    """A line of an ignore file as a regex over relative paths, for Python and Java alike."""
    folder, rooted = pattern.endswith("/"), "/" in pattern.rstrip("/")
    body = pattern.strip("/")
    out = "^" if rooted else "^(?:.*/)?"
    k = 0
    while k < len(body):
        if body.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif body.startswith("**", k):
            out, k = out + ".*", k + 2
        else:
            c = body[k]
            out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), k + 1
    return out + ("/.*$" if folder else "(?:/.*)?$")


def ignore_lines(root: Path) -> list[str]:
    """Patterns of all ignore files, in the order of files and lines; what can't be read gives none."""
    out = []
    for name in IGNORE_FILES:
        try:
            text = (root / name).read_text(encoding="utf-8", errors="replace")
        except OSError:
            continue
        out += [x for x in map(str.strip, text.splitlines()) if x and not x.startswith("#")]
    return out


def ignore_regex(root: Path) -> str | None:
    """One regex of all ignore files' lines; lines that take others back are told by negations()."""
    rules = [glob_regex(x) for x in ignore_lines(root) if not x.startswith("!")]
    return "|".join(f"(?:{r})" for r in rules) or None


def negations(root: Path) -> list[str]:
    return [x for x in ignore_lines(root) if x.startswith("!")]


def append_ignore(root: Path, paths: list[str]) -> list[str]:
    """Add exact paths to the project's ignore file in one step; those that it has are not written again."""
    target = root / ".codemapignore"
    text = target.read_text(encoding="utf-8") if target.exists() else ""
    known = {x.strip() for x in text.splitlines()}
    new = [p for p in sorted(set(paths)) if p not in known]
    if new:
        head = text.rstrip("\n")
        _replace(target, (f"{head}\n\n" if head else "") + "\n".join(["# tool configuration, no library source", *new]) + "\n")
    return new


def _replace(target: Path, text: str) -> None:
    """Write a file whole or not at all; an old one's mode stays."""
    target.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=target.parent, prefix=f".{target.name}.", delete=False) as f:
        f.write(text)
    os.chmod(f.name, target.stat().st_mode & 0o777 if target.exists() else 0o644)
    os.replace(f.name, target)


def _yaml(doc: dict) -> str:
    import yaml

    return yaml.safe_dump(doc, sort_keys=False, allow_unicode=True)


def init(root: Path, project: str | None = None, languages: list[str] = ()) -> list[str]:
    """The root manifest and the folder's own ignore file, where they are missing; what was written."""
    doc = {"version": 1, "project": project or root.resolve().name, "languages": list(languages), "subsystems": [], "entry_points": []}
    files = {root / FOLDER / "root.yaml": _yaml(doc), root / FOLDER / ".gitignore": "state/\n"}
    new = [p for p in files if not p.exists()]
    for p in new:
        _replace(p, files[p])
    return [p.relative_to(root).as_posix() for p in new]


def add_subsystem(root: Path, name: str, doc: dict) -> bool:
    """Write a subsystem's manifest and list it in the root; one that exists is never overwritten."""
    if not NAME.match(name):
        raise ValueError(f"no name for a subsystem: {name!r}")
    if manifest_path(root, name) is not None:
        return False
    init(root)
    _replace(root / FOLDER / "subsystems" / f"{name}.yaml", _yaml({"name": name, **doc}))
    top = _parse(root / FOLDER / "root.yaml") or {}
    top["subsystems"] = sorted({*_list(top.get("subsystems")), name})
    _replace(root / FOLDER / "root.yaml", _yaml(top))
    return True


EDITABLE = ("role", "criticality", "namespace", "parent", "description", *LISTS)


def edit(root: Path, name: str, field_: str, value: object) -> None:
    """Set exactly one field of a manifest; None takes it out."""
    path = manifest_path(root, name)
    if path is None:
        raise KeyError(name)
    if field_ not in EDITABLE:
        raise ValueError(f"{field_} can't be edited")
    m = _parse(path)
    m.pop(field_, None) if value is None else m.update({field_: value})
    _replace(path, json.dumps(m, indent=1) + "\n" if path.suffix == ".json" else _yaml(m))


def apply_changes(root: Path, name: str, changes: list[tuple[str, str, str | None]], prune_unknown: bool = False) -> bool:
    """Write (change, target, detail) rows of calibration into a manifest: exposes and consumes alone."""
    path = manifest_path(root, name)
    m = _parse(path)
    exposes = {e if isinstance(e, str) else e["name"]: e for e in m.get("exposes") or []}
    consumes = {c if isinstance(c, str) else c["subsystem"]: {"subsystem": c} if isinstance(c, str) else dict(c) for c in m.get("consumes") or []}

    def names(provider: str) -> set[str]:
        return set(_list(consumes[provider].get("interfaces")))

    def put(provider: str, interfaces: set[str]) -> None:
        entry = consumes.setdefault(provider, {"subsystem": provider})
        entry.pop("interfaces", None)
        if interfaces:
            entry["interfaces"] = sorted(interfaces)

    before = json.dumps([list(exposes.values()), list(consumes.values())])
    for change, target, detail in sorted(changes, key=lambda c: (c[0].startswith("remove"), c[0], c[1], c[2] or "")):
        if change == "add_expose":
            exposes[target] = {"name": target, "kind": detail}
        elif change == "remove_expose":
            exposes.pop(target, None)
        elif change == "add_consume":
            put(target, set(filter(None, (detail or "").split(","))))
        elif change == "add_consume_interface":
            put(target, names(target) | {detail})
        elif change == "coarsen_consume":
            put(target, set())
        elif change == "reattribute_consume":
            _, _, interface = detail.partition(":")
            if target in consumes:
                put(target, names(target) | {interface})
            else:
                put(target, {interface})
        elif change == "remove_consume_interface" and target in consumes:
            put(target, names(target) - {detail})
        elif change == "remove_consume_edge" or change == "unknown_consume" and prune_unknown:
            consumes.pop(target, None)
    if before == json.dumps([list(exposes.values()), list(consumes.values())]):
        return False
    m["exposes"], m["consumes"] = [exposes[k] for k in sorted(exposes)], [consumes[k] for k in sorted(consumes)]
    _replace(path, json.dumps(m, indent=1) + "\n" if path.suffix == ".json" else _yaml(m))
    return True


def load_policy(path: Path) -> tuple[list[tuple], dict[str, str], list[str], list[str]]:
    """Suppression rules (ord, code, subsystem, contains, action), severities by code, fail_on codes, warnings."""
    warnings: list[str] = []
    try:
        top = _parse(path)
    except OSError:
        return [], {}, [], []
    except Exception as e:  # noqa: BLE001
        return [], {}, [], [f"policy can't be read: {str(e).splitlines()[0][:100]}"]
    if not isinstance(top, dict):
        return [], {}, [], ["policy is not a mapping"]
    rules = []
    for r in top.get("suppress") or []:
        if isinstance(r, dict) and r.get("code"):
            rules.append((len(rules) + 1, r["code"], r.get("subsystem"), r.get("message_contains"), "suppress"))
        else:
            warnings.append("a suppression without a code")
    severity = {k: v for k, v in (top.get("severity") or {}).items() if v in ("error", "warning", "info")}
    rules += [(len(rules) + 1 + k, code, None, None, level) for k, (code, level) in enumerate(sorted(severity.items()))]
    return rules, severity, list(dict.fromkeys(_list(top.get("fail_on")))), warnings


def read_keys(path: Path) -> set[tuple[str, ...]] | None:
    """A baseline of tab-joined keys; None where there is none that can be read."""
    try:
        return {tuple(k.split("\t")) for k in json.loads(path.read_text(encoding="utf-8"))["keys"]}
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        return None


def write_keys(path: Path, keys: set[tuple[str, ...]]) -> None:
    _replace(path, json.dumps({"keys": sorted("\t".join(k) for k in keys)}, indent=1) + "\n")


def _git(root: Path, *args: str, stdin: str | None = None, fine: tuple[int, ...] = (0,)) -> list[str]:
    """Lines of a git command; none where it fails or takes over ten seconds."""
    try:
        r = subprocess.run(["git", "-C", str(root), *args], input=stdin, capture_output=True, text=True, timeout=10, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return []
    return [x for x in r.stdout.split("\0" if "-z" in args else "\n") if x] if r.returncode in fine else []


def repo_root(root: Path) -> Path | None:
    found = _git(root, "rev-parse", "--show-toplevel")
    return Path(found[0]) if found else None


def is_git_repo(root: Path) -> bool:
    return repo_root(root) is not None


def changed_files(root: Path, base: str = "HEAD") -> list[str]:
    """Changed against base, staged or untracked."""
    return sorted({*_git(root, "diff", "--name-only", "-z", "--relative", base), *_git(root, "diff", "--name-only", "-z", "--relative", "--cached"), *_git(root, "ls-files", "-z", "--others", "--exclude-standard")})


def tracked_files(root: Path) -> list[str]:
    return sorted(_git(root, "ls-files", "-z"))


def gitignored(root: Path, paths: list[str]) -> set[str]:
    """Those of paths that git ignores, by one call; none outside a repository."""
    return set(_git(root, "check-ignore", "-z", "--stdin", stdin="\0".join(paths), fine=(0, 1))) if paths else set()


def external_symlinks(root: Path, skipped: tuple[str, ...] = ()) -> list[str]:
    """Links below root that lead out of it; linked folders are not walked, so loops end."""
    out, home = [], root.resolve()
    for folder, folders, files in os.walk(root):
        folders[:] = sorted(d for d in folders if d not in skipped)
        for x in sorted((*folders, *files)):
            p = Path(folder, x)
            if p.is_symlink() and not p.resolve().is_relative_to(home):
                out.append(p.relative_to(root).as_posix())
    return out
