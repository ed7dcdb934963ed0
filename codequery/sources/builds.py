"""Build files as module coordinates and dependencies."""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROW = "path string, tool string, rank int, group_id string, artifact_id string, version string, modules array<string>, deps array<struct<group_id:string,artifact_id:string,version:string,scope:string>>"
NAMES = [c.split()[0] for c in re.split(r", (?=\w+ )", ROW)]
#: Which tool's files count first.
ORDER = ("maven", "gradle", "python", "node", "cmake")


def _dep(group: str, artifact: str, version: str | None, scope: str | None) -> dict:
    return {"group_id": group, "artifact_id": artifact, "version": version, "scope": scope}


def _out(path: str, tool: str, group: str, artifact: str, version: str, deps: list[dict], modules: list[str] = ()) -> dict:
    return {"path": path, "tool": tool, "rank": ORDER.index(tool), "group_id": group, "artifact_id": artifact, "version": version, "modules": list(modules), "deps": deps}


def _folder(path: str) -> str:
    return path.rsplit("/", 2)[-2] if path.count("/") else "unknown"


def maven(path: str, text: str) -> dict | None:
    """A POM: own or parent's coordinates, properties filled in, managed dependencies left out."""
    try:
        root = ET.fromstring(re.sub(r'\sxmlns="[^"]+"', "", text, count=1))
    except ET.ParseError:
        return None
    get = lambda e, tag: (e.findtext(tag) or "").strip() if e is not None else ""
    parent = root.find("parent")
    props = {p.tag: (p.text or "").strip() for p in root.find("properties") if isinstance(p.tag, str)} if root.find("properties") is not None else {}
    own = {t: get(root, t) or (get(parent, t) if t != "artifactId" else "") or "unknown" for t in ("groupId", "artifactId", "version")}
    props |= {f"project.{k}": v for k, v in own.items()} | {f"project.parent.{k}": get(parent, k) for k in ("groupId", "artifactId", "version")}

    def filled(s: str) -> str:
        for _ in range(10):
            new = re.sub(r"\$\{([^}]+)\}", lambda m: props.get(m[1], m[0]), s)
            if new == s:
                break
            s = new
        return s

    deps = [_dep(filled(get(d, "groupId")), filled(get(d, "artifactId")), filled(get(d, "version")) or None, get(d, "scope") or None) for d in root.findall("dependencies/dependency")]
    return _out(path, "maven", filled(own["groupId"]), filled(own["artifactId"]), filled(own["version"]), deps, [(m.text or "").strip() for m in root.findall("modules/module")])


def gradle(path: str, text: str, settings: str = "", properties: str = "", catalog: str = "") -> dict:
    """A Gradle build with its settings, properties and version catalog, as far as they are at hand."""
    props = dict(re.findall(r"(?m)^\s*([\w.]+)\s*=\s*(.*?)\s*$", properties))
    said = lambda k: (re.search(rf"(?m)^\s*{k}\s*=?\s*['\"]([^'\"]+)['\"]", text) or ["", ""])[1]
    name = (re.search(r"rootProject\.name\s*=\s*['\"]([^'\"]+)['\"]", settings) or ["", _folder(path)])[1]
    libs, bundles = {}, {}
    if catalog:
        try:
            raw = tomllib.loads(catalog)
        except tomllib.TOMLDecodeError:
            raw = {}
        versions = raw.get("versions", {})
        for k, v in raw.get("libraries", {}).items():
            v = {"module": v.rpartition(":")[0], "version": v.rpartition(":")[2]} if isinstance(v, str) else v
            group, _, artifact = v.get("module", f"{v.get('group', '')}:{v.get('name', '')}").partition(":")
            version = v.get("version")
            version = versions.get(version.get("ref")) if isinstance(version, dict) else version
            libs[k] = (group, artifact, version)
        bundles = raw.get("bundles", {})
    found: dict[tuple[str, str], dict] = {}
    add = lambda g, a, v: found.setdefault((g, a), _dep(g, a, v, "compile"))
    conf = r"\b(?:api|implementation|compileOnly|runtimeOnly|testImplementation|testRuntimeOnly|annotationProcessor|compile|kapt)\b"
    for m in re.finditer(conf + r"\s*\(?\s*(?:platform\()?(?:['\"]([\w.\-]+):([\w.\-]+)(?::([^'\"]+))?['\"]|libs\.bundles\.([\w.]+)|libs\.([\w.]+)|project\(\s*['\"]:([\w:\-]+)['\"])", text):
        if m[1]:
            add(m[1], m[2], m[3])
        elif m[6]:
            add("", m[6].split(":")[-1], "LOCAL")
        else:
            for k in bundles.get(m[4].replace(".", "-"), []) if m[4] else [m[5].replace(".", "-")]:
                if k in libs:
                    add(*libs[k])
    return _out(path, "gradle", props.get("group") or said("group") or name, name, props.get("version") or said("version") or "unknown", list(found.values()))


def _requirement(text: str) -> dict | None:
    m = re.match(r"\s*([A-Za-z0-9][\w.\-]*)\s*(?:\[[^\]]*\])?\s*(?:(?:[=<>~!]=?|===)\s*([\w.*]+))?", text)
    return _dep("python", m[1].replace("-", "_"), m[2], "runtime") if m else None


def _poetry_version(value) -> str | None:
    value = value.get("version") if isinstance(value, dict) else value
    return value.lstrip("^~") if isinstance(value, str) else None


def python(path: str, text: str) -> dict | None:
    """``pyproject.toml``, ``setup.cfg`` or ``setup.py``."""
    base = path.rsplit("/", 1)[-1]
    if base == "pyproject.toml":
        try:
            raw = tomllib.loads(text)
        except tomllib.TOMLDecodeError:
            return None
        p, poetry = raw.get("project", {}), raw.get("tool", {}).get("poetry", {})
        deps = [_requirement(d) for d in p.get("dependencies", [])] + [_dep("python", k.replace("-", "_"), _poetry_version(v), "runtime") for k, v in poetry.get("dependencies", {}).items() if k != "python"]
        name, version = p.get("name") or poetry.get("name"), p.get("version") or poetry.get("version")
    else:
        q = r"\s*=\s*['\"]?([^'\",\n]+)['\"]?"
        name, version = ((m[1].strip() if (m := re.search(rf"(?m)\b{k}{q}", text)) else None) for k in ("name", "version"))
        block = (re.search(r"install_requires\s*=\s*\[(.*?)\]", text, re.S) or ["", ""])[1] if base == "setup.py" else (re.search(r"install_requires\s*=\s*\n((?:[ \t]+\S.*\n?)+)", text) or ["", ""])[1]
        deps = [_requirement(x) for x in (re.findall(r"['\"]([^'\"]+)['\"]", block) if base == "setup.py" else block.split("\n")) if x.strip()]
    return _out(path, "python", "python", (name or _folder(path)).replace("-", "_"), version or "unknown", [d for d in deps if d])


def node(path: str, text: str) -> dict | None:
    """``package.json``: scopes as groups."""
    try:
        raw = json.loads(text)
    except ValueError:
        return None
    name = raw.get("name") or _folder(path)
    scoped = re.fullmatch(r"@([^/]+)/(.+)", name)
    group, artifact = scoped.groups() if scoped else ("npm", name)
    both = {**raw.get("dependencies", {}), **raw.get("peerDependencies", {})}
    return _out(path, "node", group, artifact, raw.get("version") or "unknown", [_dep("npm", re.sub(r"^@[^/]+/", "", k), v, "runtime") for k, v in both.items()])


def cmake(path: str, text: str) -> dict | None:
    m = re.search(r"(?i)\bproject\s*\(\s*([\w.\-]+)(?:[^)]*?\bVERSION\s+([\w.]+))?", text)
    return _out(path, "cmake", "cmake", m[1].lower(), m[2] or "unknown", []) if m else None


def read(path: str, text: str) -> dict | None:
    base = path.rsplit("/", 1)[-1]
    if base == "pom.xml":
        return maven(path, text)
    if base in ("pyproject.toml", "setup.py", "setup.cfg"):
        return python(path, text)
    if base == "package.json":
        return node(path, text)
    return cmake(path, text) if base == "CMakeLists.txt" else None


def _nearest(builds: DataFrame, files: DataFrame, name: str, ending: str, own_folder: bool = False) -> DataFrame:
    """``builds`` (path, folder) with column ``name``: the text of the file of that ending in the folder or, unless it
    must be in the same one, in the nearest of the folders above."""
    found = files.where(F.rlike("path", F.lit(rf"(?:^|/){ending}$")))
    of = found.select(F.regexp_replace("path", rf"/?{ending}$", "").alias("_at"), F.col("text").alias("_text"))
    of = of.groupBy("_at").agg(F.min("_text").alias("_text"))
    parts = F.filter(F.split("folder", "/"), lambda p: p != "")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    lead = F.when(F.startswith("folder", F.lit("/")), "/").otherwise("")
    rows = builds.select("path", "folder", F.explode(above).alias("_f")).withColumn("_f", F.concat(lead, "_f"))
    rows = rows.where(F.col("_f") == F.col("folder")) if own_folder else rows
    hit = rows.join(of, F.col("_f") == F.col("_at")).groupBy(F.col("path").alias("_path"))
    hit = hit.agg(F.max_by("_text", F.length("_f")).alias(name))
    return builds.join(hit, F.col("path") == F.col("_path"), "left").drop("_path")


def modules(files: DataFrame) -> DataFrame:
    """The module of each build file (path, text); a Gradle build is read with the settings of its folder, and with the
    properties and version catalog of its folder or the nearest above."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for p, t in zip(b.path, b.text, strict=True) if (r := read(p, t or ""))], columns=NAMES)

    def run_gradle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = b[["path", "text", "settings", "properties", "catalog"]].fillna("").itertuples(index=False)
            yield pd.DataFrame([gradle(*r) for r in rows], columns=NAMES)

    is_gradle = F.rlike("path", F.lit(r"(?:^|/)build\.gradle(?:\.kts)?$"))
    built = files.where(is_gradle).select("path", "text", F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1).alias("folder"))
    for name, ending, own in (
        ("settings", r"settings\.gradle(?:\.kts)?", True), ("properties", r"gradle\.properties", False),
        ("catalog", r"gradle/libs\.versions\.toml", False),
    ):
        built = built.join(_nearest(built.select("path", "folder"), files, name, ending, own).select(F.col("path").alias("_p"), name), F.col("path") == F.col("_p"), "left").drop("_p")
    others = files.where(~is_gradle).select("path", "text").mapInPandas(run, ROW)
    return others.unionByName(built.mapInPandas(run_gradle, ROW))


def first_of_folder(found: DataFrame) -> DataFrame:
    """One module for each folder: that of the tool that counts first."""
    folder = F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1)
    w = Window.partitionBy(folder).orderBy("rank", F.when(F.endswith("path", F.lit(".toml")), 0).when(F.endswith("path", F.lit(".py")), 1).otherwise(2), "path")
    return found.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "rank")
