"""Manifests, configuration and version control: small inputs that the driver reads, as tables."""

from __future__ import annotations

import json
import os
import re
import subprocess
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.scalars import glob_regex
from graphloom.sources.readers import SKIPPED, without_json_comments

try:
    import yaml
except ImportError:  # manifests are then refused, the rest works
    yaml = None

SECTIONS = ("dependencies", "dev_dependencies", "dependency_overrides")
PACKAGES = "root string, name string, application boolean, workspace boolean"
DECLARED = "root string, package string, section string, dep string, source string, line bigint"


class ConfigError(ValueError):
    """Configuration that can't be read or that holds unknown keys."""


def parse_yaml(text: str) -> dict:
    """YAML with repeated keys refused and merge keys as they are."""
    if yaml is None:
        raise ConfigError("no YAML parser is installed")

    class Strict(yaml.SafeLoader):
        def construct_mapping(self, node, deep=False):
            seen = set()
            for k, _ in node.value:
                if k.value in seen:
                    raise ConfigError(f"key given twice: {k.value}")
                seen.add(k.value)
            return {self.construct_object(k, True): self.construct_object(v, True) for k, v in node.value}

    Strict.add_constructor("tag:yaml.org,2002:map", lambda loader, node: loader.construct_mapping(node, True))
    return yaml.load(text, Strict) or {}  # noqa: S506 - a SafeLoader


def package_above(path: str) -> tuple[str, str | None]:
    """The nearest package root at or above a folder, and the folder as scope if it lies below."""
    here = Path(path).resolve()
    for p in (here, *here.parents):
        if (p / "pubspec.yaml").is_file():
            return str(p), None if p == here else str(here)
    return str(here), None


def discover(root: str, ignored: list[str] | None = None) -> list[str]:
    """Folders with a manifest under a root, tool folders and ignored globs left out, in order."""
    skip = [re.compile(glob_regex(g)) for g in ignored or []]
    found = []
    for folder, dirs, names in os.walk(root):
        rel = os.path.relpath(folder, root)
        dirs[:] = sorted(d for d in dirs if d not in SKIPPED and not any(s.match(os.path.normpath(os.path.join(rel, d))) for s in skip))
        if "pubspec.yaml" in names:
            found.append("" if rel == "." else rel.replace(os.sep, "/"))
    return sorted(found)


def manifests(spark: SparkSession, root: str, ignored: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """packages and declared dependencies of all manifests under a root."""
    packages, declared = [], []
    for rel in discover(root, ignored):
        base = Path(root, rel)
        text = (base / "pubspec.yaml").read_text(encoding="utf-8")
        m = parse_yaml(text)
        over = base / "pubspec_overrides.yaml"
        extra = parse_yaml(over.read_text(encoding="utf-8")) if over.is_file() else {}
        name = str(m.get("name", ""))
        application = m.get("publish_to") == "none" or (base / "lib/main.dart").is_file() or (base / "bin" / f"{name}.dart").is_file()
        packages.append((rel, name, bool(application), bool(m.get("workspace"))))
        for section in SECTIONS:
            both = {**(m.get(section) or {}), **((extra.get(section) or {}) if section == "dependency_overrides" else {})}
            for dep, spec in both.items():
                source = next((k for k in ("path", "git", "sdk", "hosted") if isinstance(spec, dict) and k in spec), "hosted" if spec is not None else "missing")
                at = next((i for i, x in enumerate(text.split("\n"), 1) if re.match(rf"\s+{re.escape(str(dep))}\s*:", x)), None)
                declared.append((rel, name, section, str(dep), source, at))
    return spark.createDataFrame(packages, PACKAGES), spark.createDataFrame(declared, DECLARED)


def misconfigured_overrides(declared: DataFrame) -> DataFrame:
    """Overrides that give no version or source, or override the package itself."""
    reason = F.when(F.col("source") == "missing", "empty").when(F.col("dep") == F.col("package"), "self").when(~F.col("dep").rlike("^[a-z_][a-z0-9_]*$"), "bad-name")
    return declared.where("section = 'dependency_overrides'").withColumn("reason", reason).where("reason IS NOT NULL")


def locked(root: str) -> set[str] | None:
    """Names in pubspec.lock, None without one."""
    p = Path(root, "pubspec.lock")
    return set((parse_yaml(p.read_text(encoding="utf-8")).get("packages") or {})) if p.is_file() else None


def package_config(spark: SparkSession, root: str) -> DataFrame:
    """Configured packages: name and root uri of .dart_tool/package_config.json."""
    p = Path(root, ".dart_tool/package_config.json")
    rows = [(e["name"], e["rootUri"], e.get("packageUri", "lib/")) for e in json.loads(p.read_text())["packages"]] if p.is_file() else []
    return spark.createDataFrame(rows, "name string, root_uri string, package_uri string")


def needed_packages(graph: DataFrame, package: str) -> DataFrame:
    """All that a package needs, by its graph(name, dependency): itself left out."""
    from graphloom.operators.graph import reachable

    seeds = graph.sparkSession.createDataFrame([(package,)], "n string")
    return reachable(graph, seeds, "name", "dependency").where(F.col("depth") > 0).select(F.col("node").alias("name"))


CANDIDATES = ("graphloom.json", "graphloom.jsonc", "graphloom.toml", ".graphloom.json")


def load_config(root: str, allowed: set[str], explicit: str | None = None) -> dict:
    """The first configuration file there is, JSON, JSON with comments or TOML; unknown keys are errors."""
    paths = [explicit] if explicit else [os.path.join(root, c) for c in CANDIDATES]
    for p in paths:
        if os.path.isfile(p):
            text = Path(p).read_text(encoding="utf-8")
            try:
                value = tomllib.loads(text) if p.endswith(".toml") else json.loads(without_json_comments(text))
            except ValueError as e:
                raise ConfigError(f"{p}: {e}") from e
            if extra := set(value) - allowed:
                raise ConfigError(f"{p}: unknown keys {sorted(extra)}")
            return value
    if explicit:
        raise ConfigError(f"{explicit} isn't there")
    return {}


def policy_rules(spark: SparkSession, packs: list[dict]) -> DataFrame:
    """Rule packs as a table of patterns; a rule without patterns is an error."""
    rows = []
    for pack in packs:
        for n, r in enumerate(pack.get("rules", [])):
            if r.get("kind") not in ("banned-import", "banned-call", "banned-effect") or not r.get("patterns"):
                raise ConfigError(f"rule {n} of {pack.get('name')}: kind and patterns are needed")
            rows += [(pack.get("name"), r.get("id", str(n)), r["kind"], p, r.get("severity", "warning")) for p in r["patterns"]]
    return spark.createDataFrame(rows, "pack string, rule string, kind string, pattern string, severity string")


#: Of each preset, the folders under lib and those that they must not use.
PRESETS = {
    "layered": {"domain": "data application infrastructure presentation ui", "data": "presentation ui", "application": "infrastructure presentation ui"},
    "hexagonal": {"domain": "application infrastructure adapters presentation ui", "application": "infrastructure adapters presentation ui"},
    "feature-sliced": {"shared": "entities features widgets pages app", "entities": "features widgets pages app", "features": "widgets pages app", "widgets": "pages app", "pages": "app"},
    "bulletproof": {"core": "features app pages", "shared": "features app pages", "features": "app pages"},
}


def preset_rules(spark: SparkSession, names: list[str]) -> DataFrame:
    """Boundary rules of named presets: pairs of folders under lib."""
    rows = sorted({(f"lib/{a}", f"lib/{b}") for n in names for a, outer in PRESETS[n].items() for b in outer.split()})
    return spark.createDataFrame(rows, "rule_from string, rule_disallow string")


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], check=True, capture_output=True, text=True).stdout


def changed_files(spark: SparkSession, root: str, base: str) -> DataFrame:
    """Paths that differ from a revision, and untracked ones."""
    names = set(_git(root, "diff", "--name-only", "--relative", base).split("\n")) | set(_git(root, "ls-files", "--others", "--exclude-standard").split("\n"))
    return spark.createDataFrame(sorted((n,) for n in names if n), "path string")


def changed_lines(spark: SparkSession, root: str, base: str) -> DataFrame:
    """(path, line) of what was added since a revision; every line of an untracked file."""
    from graphloom.sources.readers import diff_lines, text_lines

    diff = _git(root, "diff", "--unified=0", "--relative", base)
    out = diff_lines(text_lines(spark.createDataFrame([("diff", diff)], "path string, source string")))
    rows = []
    for name in _git(root, "ls-files", "--others", "--exclude-standard").split("\n"):
        if name:
            n = Path(root, name).read_bytes().count(b"\n") + 1
            rows += [(name, i) for i in range(1, n + 1)]
    return out.unionByName(spark.createDataFrame(rows, "path string, line bigint"))


def files_at(spark: SparkSession, root: str, revision: str, suffix: str = ".dart") -> DataFrame:
    """files(path, source) of a revision: the base side of an audit."""
    names = [n for n in _git(root, "ls-tree", "-r", "--name-only", revision).split("\n") if n.endswith(suffix)]
    return spark.createDataFrame([(n, _git(root, "show", f"{revision}:{n}")) for n in names], "path string, source string")


def tracked_files(spark: SparkSession, root: str, suffix: str = ".dart") -> DataFrame:
    names = [n for n in _git(root, "ls-files").split("\n") if n.endswith(suffix)]
    return spark.createDataFrame([(n,) for n in names], "path string")


def workspace_scope(files: DataFrame, packages: DataFrame, selectors: list[str]) -> DataFrame:
    """Files of the packages that the selectors name: globs over name or root, ``!`` leaves out; none is an error."""
    from graphloom.operators.joins import longest_prefix

    hit = F.lit(False)
    for s in selectors:
        regex = glob_regex(s.lstrip("!"))
        match = F.col("name").rlike(regex) | F.col("root").rlike(regex)
        hit = hit & ~match if s.startswith("!") else hit | match
    chosen = packages.where(hit)
    if chosen.isEmpty():
        raise ConfigError(f"no package matches {selectors}")
    return longest_prefix(files, "path", packages.select("root", "name"), "root").join(chosen.select("root"), "root", "left_semi")
