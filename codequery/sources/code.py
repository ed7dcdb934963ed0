"""Source code as rows of classes, methods, calls, fields and relationships.

Files are parsed alone, in Arrow batches; what needs the whole project (names, imports) is resolved by joins.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequery.functions import text as X
from codequery.operators.graph import package_hint

ROW = (
    "path string, kind string, owner string, name string, params array<string>, types array<string>, returns string, "
    "bases array<string>, annotations array<string>, access string, flags array<string>, comment string, "
    "calls array<string>, line int, end_line int, body string, package string, imports array<string>"
)
NAMES = [c.split()[0] for c in re.split(r", (?=\w+ )", ROW)]
MAX_BODY = 300
#: Words before a parenthesis that are no calls.
NO_CALLS = frozenset(
    "if for while do switch case catch new return throw match when let fun fn def defp class struct enum type import use "
    "where with try yield await async module namespace package super this self print println printf sprintf require".split()
)
_CALL = re.compile(r"\b(\w+)\s*\(")


def calls_in(body: str) -> list[str]:
    """Distinct called names of a body, in order; keywords, constants and single letters are none."""
    return list(dict.fromkeys(n for n in _CALL.findall(body) if n not in NO_CALLS and len(n) > 1 and not n.isupper()))


def split_params(text: str) -> list[str]:
    """Parts between commas outside brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and depth == 0:
            out.append(text[last:i].strip())
            last = i + 1
    return [p for p in [*out, text[last:].strip()] if p]


def count_arguments(text: str, raw: str) -> int:
    """The number of arguments of a call: ``text`` is ``raw`` with strings blanked."""
    depth = commas = 0
    for c in text:
        depth += (c in "([{<") - (c in ")]}>")
        commas += c == "," and depth == 0
    return commas + 1 if raw.strip() else 0


def param_name(text: str) -> str:
    """The name in ``name: type``, ``type name`` or ``name = value``."""
    text = text.split("=")[0].strip()
    if ":" in text:
        text = text.split(":")[0].strip()
    words = re.findall(r"\w+", text)
    return words[-1] if words else ""


def _row(path: str, kind: str, name: str, line: int, **more) -> dict:
    empty = {
        "owner": "", "params": [], "types": [], "returns": None, "bases": [], "annotations": [], "access": "", "flags": [],
        "comment": "", "calls": [], "end_line": line, "body": "", "package": "", "imports": [],
    }
    return {"path": path, "kind": kind, "name": name, "line": line, **empty, **more}


# -- languages by rule ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Language:
    name: str
    endings: tuple[str, ...]
    comment: str
    package: str | None
    imports: str
    classes: str
    methods: str
    body: str  # braces, end, parens or indent


#: Where declarations of a language are, the first group that matched being the name, the next the parameters.
LANGUAGES = (
    Language("Rust", (".rs",), "//", None, r"^\s*use\s+([\w:*{}]+)", r"^\s*(?:pub(?:\s*\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)|^\s*impl(?:<[^>]*>)?\s+(?:[\w:]+\s+for\s+)?(\w+)", r"^\s*(?:pub(?:\s*\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)(?:<[^>]*>)?\s*\(([^)]*)\)", "braces"),
    Language("Kotlin", (".kt", ".kts"), "//", r"^package\s+([\w.]+)", r"^import\s+([\w.*]+)(?:\s+as\s+\w+)?", r"^\s*(?:(?:data|sealed|abstract|open|enum|value|inner|private|public|protected|internal)\s+)*(?:class|interface|object)\s+(\w+)", r"^\s*(?:(?:override|suspend|inline|infix|operator|open|private|public|protected|internal|abstract|final|tailrec)\s+)*fun\s+(?:<[^>]*>\s+)?(?:\([^)]*\)\.)?\s*(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)", "braces"),
    Language("Scala", (".scala",), "//", r"^package\s+([\w.]+)", r"^import\s+([\w.*{}]+)", r"^\s*(?:(?:case|abstract|sealed|final|private|protected|override)\s+)*(?:class|object|trait)\s+(\w+)", r"^\s*(?:override\s+)?def\s+(\w+)(?:\s*\[[^\]]*\])?\s*(?:\(([^)]*)\))?", "braces"),
    Language("Swift", (".swift",), "//", None, r"^import\s+(\w+)", r"^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|internal|open|final|fileprivate)\s+)*(?:class|struct|enum|protocol|extension)\s+(\w+)", r"^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|internal|open|override|static|class|mutating|final|required|convenience)\s+)*func\s+(\w+)(?:\s*<[^>]*>)?\s*\(([^)]*)\)", "braces"),
    Language("C#", (".cs",), "//", r"^namespace\s+([\w.]+)", r"^using\s+(?:static\s+)?([\w.]+)", r"^\s*(?:(?:public|private|protected|internal|static|abstract|sealed|partial|new)\s+)*(?:class|interface|struct|enum|record)\s+(\w+)", r"^\s*(?:(?:public|private|protected|internal|static|virtual|override|abstract|async|new|sealed|readonly|extern)\s+)+[\w<>\[\].,?\s]+\s+(\w+)\s*\(([^)]*)\)\s*(?:where\s+.*)?\s*[{;]", "braces"),
    Language("F#", (".fs", ".fsx"), "//", r"^(?:module|namespace)\s+([\w.]+)", r"^open\s+([\w.]+)", r"^\s*type\s+(\w+)", r"^\s*(?:let(?:\s+rec)?\s+(\w+)|(?:member|override|abstract)\s+(?:\w+\.)?(\w+)\s*\(([^)]*)\))", "indent"),
    Language("Haskell", (".hs", ".lhs"), "--", r"^module\s+([\w.]+)", r"^import\s+(?:qualified\s+)?([\w.]+)", r"^(?:data|newtype)\s+(\w+)|^class\s+(?:[\w()\s]+\s+)?(\w+)(?:\s+\w+)*\s+where", r"^(\w+)\s*::", "indent"),
    Language("Elixir", (".ex", ".exs"), "#", r"^\s*defmodule\s+([\w.]+)", r"^\s*(?:import|alias|use|require)\s+([\w.]+)", r"^\s*defmodule\s+([\w.]+)", r"^\s*def(?:p)?\s+(\w+)(?:\s*\(([^)]*)\))?(?:\s+do|,)?", "end"),
    Language("Clojure", (".clj", ".cljs", ".cljc"), ";", r"^\(ns\s+([\w.-]+)", r"(?::require|:use|:import)\s+\[?([\w.-]+)", r"^\s*\((?:defrecord|deftype|defprotocol)\s+(\w+)", r"^\s*\(defn-?\s+(\w+)\s+\[([^\]]*)\]", "parens"),
    Language("Ruby", (".rb", ".rake"), "#", r"^\s*module\s+([\w:]+)", r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]", r"^\s*(?:class|module)\s+(\w+)", r"^\s*def\s+(?:self\.)?(\w+)(?:\s*\(([^)]*)\))?", "end"),
    Language("VB.NET", (".vb",), "'", r"(?i)^Namespace\s+([\w.]+)", r"(?i)^Imports\s+([\w.]+)", r"(?i)^\s*(?:Public|Private|Protected|Friend|Partial|MustInherit|NotInheritable)?\s*(?:Class|Interface|Structure|Module|Enum)\s+(\w+)", r"(?i)^\s*(?:Public|Private|Protected|Friend|Shared|Overrides|Overridable|MustOverride|Async)?\s*(?:Sub|Function)\s+(\w+)\s*\(([^)]*)\)", "end"),
)
BY_ENDING = {e: lang for lang in LANGUAGES for e in lang.endings}


def comment_above(lines: list[str], at: int, mark: str) -> str:
    """The comment lines right above a declaration, without their marks."""
    out = []
    while at and lines[at - 1].lstrip().startswith(mark):
        at -= 1
        out.append(lines[at].strip().lstrip(mark + "!").strip())
    return "\n".join(reversed(out)).strip()


def body_end(lines: list[str], at: int, style: str) -> int:
    """The index after the last line of a body that begins at ``at``."""
    stop = min(len(lines), at + MAX_BODY)
    if style == "indent":
        own = len(lines[at]) - len(lines[at].lstrip())
        for i in range(at + 1, stop):
            if lines[i].strip() and len(lines[i]) - len(lines[i].lstrip()) <= own:
                return i
        return stop
    depth, opened = 0, False
    for i in range(at, stop):
        if style == "end":
            opens = len(re.findall(r"\b(?:do|def|defp|class|module|begin|if|unless|case|while|Sub|Function)\b", re.sub(r"\bEnd\s+\w+", "", lines[i])))
            depth += min(opens, 1) - len(re.findall(r"^\s*end\b|\bEnd\s+(?:Sub|Function|If)\b", lines[i], re.I))
        else:
            a, b = "{}" if style == "braces" else "()"
            depth += lines[i].count(a) - lines[i].count(b)
        opened |= depth > 0 or (style == "braces" and "{" in lines[i])
        if (opened and depth <= 0) or (style == "braces" and not opened and lines[i].rstrip().endswith(";")):
            return i + 1
    return stop


def parse_by_rule(path: str, text: str, lang: Language) -> list[dict]:
    """Classes and methods of a file; a method belongs to the last class before it, or to the file's stem."""
    lines = text.split("\n")
    stem = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
    first = lambda pattern: next((m[1] for x in lines if pattern and (m := re.search(pattern, x))), "")
    package, imports = first(lang.package), [m[1] for x in lines if (m := re.search(lang.imports, x))]
    found, owner = [], stem
    for i, x in enumerate(lines):
        if x.lstrip().startswith(lang.comment):
            continue
        if m := re.search(lang.classes, x):
            owner = next(g for g in m.groups() if g)
            comment = comment_above(lines, i, lang.comment)
            found.append(_row(path, "class", owner, i + 1, comment=comment, package=package, imports=imports))
        elif m := re.search(lang.methods, x):
            groups = list(m.groups())
            at = next(k for k, g in enumerate(groups) if g)
            end = body_end(lines, i, lang.body)
            body = "\n".join(lines[i:end])
            raw = groups[-1] if len(groups) > at + 1 and groups[-1] else ""
            params = [param_name(p) for p in split_params(raw)]
            more = {"calls": calls_in(body.split("\n", 1)[-1] if "\n" in body else ""), "package": package, "imports": imports}
            more |= {"comment": comment_above(lines, i, lang.comment), "end_line": end, "body": body}
            found.append(_row(path, "method", groups[at], i + 1, owner=owner, params=params, **more))
    return found


# -- Python --------------------------------------------------------------------------------------------------------------


def parse_python(path: str, text: str) -> list[dict]:
    """Top-level classes and functions and direct methods; fields from annotated attributes and from ``__init__``."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    parts = re.sub(r"\.py$", "", path).split("/")
    parts = parts[1:] if parts and parts[0] == "src" else parts
    package = ".".join(parts[:-1])
    imports = [a.name for n in tree.body if isinstance(n, ast.Import) for a in n.names] + [f"{n.module or ''}.{a.name}".lstrip(".") for n in tree.body if isinstance(n, ast.ImportFrom) for a in n.names]
    lines, out = text.split("\n"), []
    dotted = lambda n: ast.unparse(n.func if isinstance(n, ast.Call) else n)

    def function(f, owner: str) -> None:
        args = [*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs]
        called = [c.func.attr if isinstance(c.func, ast.Attribute) else c.func.id for c in ast.walk(f) if isinstance(c, ast.Call) and isinstance(c.func, (ast.Attribute, ast.Name))]
        marks = [dotted(d) for d in f.decorator_list]
        flags = ["async"] * isinstance(f, ast.AsyncFunctionDef) + ["static"] * ("staticmethod" in marks) + ["abstract"] * any(m.endswith("abstractmethod") for m in marks)
        out.append(
            _row(
                path, "method", f.name, f.lineno, owner=owner, params=[a.arg for a in args],
                types=[ast.unparse(a.annotation) if a.annotation else "" for a in args],
                returns=ast.unparse(f.returns) if f.returns else None, annotations=marks, flags=flags,
                access="private" if f.name.startswith("_") and not f.name.startswith("__") else "public",
                comment=ast.get_docstring(f) or "", calls=list(dict.fromkeys(called)), end_line=f.end_lineno,
                body="\n".join(lines[f.lineno - 1 : f.end_lineno]), package=package, imports=imports,
            )
        )

    for n in tree.body:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            function(n, parts[-1])
        elif isinstance(n, ast.ClassDef):
            out.append(_row(path, "class", n.name, n.lineno, bases=[dotted(b) for b in n.bases], annotations=[dotted(d) for d in n.decorator_list], access="public", comment=ast.get_docstring(n) or "", end_line=n.end_lineno, package=package, imports=imports))
            fields = {b.target.id: ast.unparse(b.annotation) for b in n.body if isinstance(b, ast.AnnAssign) and isinstance(b.target, ast.Name)}
            for b in n.body:
                if isinstance(b, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    function(b, n.name)
                    if b.name == "__init__":
                        for a in ast.walk(b):
                            for t in a.targets if isinstance(a, ast.Assign) else [a.target] if isinstance(a, ast.AnnAssign) else []:
                                if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self":
                                    fields.setdefault(t.attr, ast.unparse(a.annotation) if isinstance(a, ast.AnnAssign) else "")
            out += [_row(path, "field", k, n.lineno, owner=n.name, returns=t, package=package) for k, t in fields.items()]
    return out


# -- Java, JavaScript and TypeScript -------------------------------------------------------------------------------------

_BLANKED = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_JAVA_CLASS = re.compile(r"((?:@[\w.]+(?:\([^)]*\))?\s+)*)((?:(?:public|protected|private|static|final|abstract|sealed|non-sealed|strictfp)\s+)*)(class|interface|enum|record|@interface)\s+(\w+)\s*(?:<[^{]*?>)?\s*(?:\([^)]*\))?\s*(?:extends\s+([\w.<>,\s?&]+?))?\s*(?:implements\s+([\w.<>,\s?&]+?))?\s*(?:permits\s+[\w.,\s]+?)?\{")
_JAVA_METHOD = re.compile(r"((?:@[\w.]+(?:\([^)]*\))?\s+)*)((?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)\s+)*)(?:<[^>(){};]+>\s+)?([\w.$]+(?:<[^(){};]*>)?(?:\[\])*\s+)?(\w+)\s*\(([^(){};]*(?:\([^()]*\)[^(){};]*)*)\)\s*(?:throws\s+[\w.,\s]+?)?\s*([{;])")
_JAVA_FIELD = re.compile(r"^\s*(?:@[\w.]+(?:\([^)]*\))?\s+)*((?:(?:public|protected|private|static|final|volatile|transient)\s+)*)([\w.$]+(?:<[^;=(){}]*>)?(?:\[\])*)\s+(\w+)\s*(?:=[^;]*)?;", re.M)
_NOT_TYPES = frozenset("return new throw else case package import assert".split())


def blanked(text: str) -> str:
    """A text with strings and comments as blanks of the same length."""
    return _BLANKED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _closing(text: str, at: int) -> int:
    """The place after the brace that closes the one at ``at``."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(text)


def _access(words: str) -> str:
    return next((a for a in ("public", "protected", "private") if a in words.split()), "")


def _flags(words: str) -> list[str]:
    return [w for w in words.split() if w not in ("public", "protected", "private")]


class _Comments:
    """The documentation comments of a file, found by where they end."""

    def __init__(self, text: str, clean: str) -> None:
        self.clean = clean
        self.found = [(m.start(), m.end(), m[1]) for m in re.finditer(r"/\*\*(?!/)(.*?)\*/", text, re.S)]
        self.ends = [e for _, e, _ in self.found]

    def before(self, at: int) -> str:
        """The comment that a declaration at a place has, without its stars."""
        k = bisect_right(self.ends, at) - 1
        if k < 0 or self.clean[self.ends[k] : at].strip():
            return ""
        lines = [re.sub(r"^\s*\*? ?", "", x).rstrip() for x in self.found[k][2].split("\n")]
        return "\n".join(lines).strip()


def parse_java(path: str, text: str) -> list[dict]:
    """Classes, methods and constructors with their comments, flags, parameter types and receivers of their calls, fields.
    Owners are written from the outermost class down; calls ``receiver.name/arity``."""
    clean = blanked(text)
    comments = _Comments(text, clean)
    line = lambda at: text.count("\n", 0, at) + 1
    package = (re.search(r"^\s*package\s+([\w.]+)", clean, re.M) or ["", ""])[1]
    imports = re.findall(r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", clean, re.M)
    out, spans = [], []
    for m in _JAVA_CLASS.finditer(clean):
        end = _closing(clean, m.end() - 1)
        around = [s[3] for s in spans if s[1] <= m.start() < s[2]]
        spans.append((m.start(), m.end(), end, m[4], ".".join([*around, m[4]])))
        kind = {"@interface": "annotation"}.get(m[3], m[3])
        bases = [f"{word} {b}" for word, found in (("extends", m[5]), ("implements", m[6])) for b in split_params(found or "")]
        out.append(
            _row(
                path, "class", m[4], line(m.start(3)), owner=".".join(around), returns=kind, bases=bases,
                annotations=re.findall(r"@([\w.]+)", m[1]), access=_access(m[2]), flags=_flags(m[2]),
                comment=comments.before(m.start()), end_line=line(end - 1), package=package, imports=imports,
            )
        )

    def owner_of(at: int) -> tuple | None:
        return max((s for s in spans if s[1] <= at < s[2]), key=lambda s: s[1], default=None)

    inside = []
    for m in _JAVA_METHOD.finditer(clean):
        own, kind = owner_of(m.start(4)), (m[3] or "").strip()
        if own is None or kind in _NOT_TYPES or m[4] in NO_CALLS or (not kind and m[4] != own[3]) or any(a < m.start(4) < b for a, b in inside):
            continue
        end = _closing(clean, m.end() - 1) if m[6] == "{" else m.end()
        if m[6] == "{":
            inside.append((m.end(), end))
        params = [re.sub(r"@\w+(?:\([^)]*\))?\s*|\bfinal\s+", "", p).strip() for p in split_params(m[5])]
        types, names = [re.sub(r"\s+\w+$", "", p) for p in params], [param_name(p) for p in params]
        body = clean[m.end() : end]
        known = dict(zip(names, types, strict=True)) | {n: t for t, n in re.findall(r"\b([A-Z][\w.]*(?:<[^;=(){}]*>)?)\s+(\w+)\s*[=;:]", body)}
        called = []
        for c in re.finditer(r"(?:\b(\w+)\s*\.\s*)?\b(\w+)\s*\(", body):
            if c[2] in NO_CALLS or re.search(r"\bnew\s+$", body[: c.start()]):
                continue
            shut = _paren(body, c.end() - 1)
            n = count_arguments(body[c.end() : shut], text[m.end() + c.end() : m.end() + shut])
            receiver = re.sub(r"<.*", "", known.get(c[1], c[1] or own[3]))
            called.append(f"{receiver}.{c[2]}/{n}")
        at = m.start() + len(m[0]) - len(m[0].lstrip())
        out.append(
            _row(
                path, "method", m[4] if kind else "<init>", line(m.start(4)), owner=own[4], params=names, types=types,
                returns=kind or None, annotations=re.findall(r"@([\w.]+)", m[1]), access=_access(m[2]), flags=_flags(m[2]),
                comment=comments.before(at), calls=list(dict.fromkeys(called)), end_line=line(end - 1),
                body=text[m.start() : end].strip(), package=package, imports=imports,
            )
        )
    for m in _JAVA_FIELD.finditer(clean):
        own = owner_of(m.start(3))
        if own and m[2] not in _NOT_TYPES and not any(a <= m.start(3) < b for a, b in inside):
            out.append(_row(path, "field", m[3], line(m.start(3)), owner=own[4], returns=m[2].strip(), access=_access(m[1]), flags=_flags(m[1]), package=package))
    fields = {(r["owner"], r["name"]) for r in out if r["kind"] == "field"}
    for r in [r for r in out if r["kind"] == "method"]:
        body = blanked(r["body"])
        local = set(r["params"]) | {n for _, n in re.findall(r"\b(?:[A-Z]\w*(?:<[^;=]*>)?|int|long|double|float|boolean|char|byte|short|var)(\[\])*\s+(\w+)\s*[=;:]", body)}
        for owner, name in sorted(fields):
            if owner != r["owner"]:
                continue
            use = rf"(?<![\w.])(?:this\.)?{name}\b" if name not in local else rf"\bthis\.{name}\b"
            if re.search(use + r"\s*(?:[+\-*/|&^]|<<|>>)?=(?!=)|" + use + r"\s*(?:\+\+|--)|(?:\+\+|--)\s*" + use, body):
                out.append(_row(path, "writes", name, r["line"], owner=owner, returns=r["name"], package=package))
            if re.search(use + r"(?!\s*=(?!=))", body):
                out.append(_row(path, "reads", name, r["line"], owner=owner, returns=r["name"], package=package))
    return out


def _paren(text: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"[()]").finditer(text, at):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            return m.start()
    return len(text)


_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_SCRIPT = re.compile(r"[A-Za-z_$][\w$]*|=>|\S")
_PAIRS = {"(": ")", "{": "}", "[": "]"}
_MODIFIERS = frozenset("export default declare public private protected static async abstract readonly override get set".split())


class _Tokens:
    """The tokens of a script without strings and comments: words, arrows and single signs, and each bracket's partner."""

    def __init__(self, clean: str) -> None:
        found = [(m[0], m.start()) for m in _SCRIPT.finditer(clean)]
        self.words, self.places = [w for w, _ in found], [p for _, p in found]
        self.partner, opened = {}, []
        for i, w in enumerate(self.words):
            if w in _PAIRS:
                opened.append(i)
            elif w in _PAIRS.values():
                while opened and _PAIRS[self.words[opened[-1]]] != w:
                    opened.pop()  # a bracket without a partner
                if opened:
                    self.partner[opened.pop()] = i

    def at(self, i: int) -> str:
        return self.words[i] if 0 <= i < len(self.words) else ""

    def is_word(self, i: int) -> bool:
        return bool(_WORD.fullmatch(self.at(i)))

    def after_types(self, i: int, stop: frozenset[str]) -> int:
        """The first token from ``i`` on that is one of ``stop`` outside of brackets; generics may hold anything."""
        while i < len(self.words) and self.words[i] not in stop:
            i = self.partner.get(i, i) + 1
        return i


def parse_script(path: str, text: str) -> list[dict]:
    """Classes, interfaces and functions of JavaScript and TypeScript; a body is its first line.

    The tokens are walked once. A function is a ``function``, a name that is given an arrow or a function, or a name with
    parentheses and a block directly inside of a class.
    """
    clean = blanked(text)
    t, comments = _Tokens(clean), _Comments(text, clean)
    line = lambda at: text.count("\n", 0, at) + 1
    imports = re.findall(r"(?:from\s+|require\(\s*|import\s+)['\"]([^'\"]+)['\"]", text)
    stem = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
    out: list[dict] = []
    inside: list[tuple[int, str]] = []  # the closing brackets and names of the classes around
    blocks: list[int] = []  # the closing brackets of all blocks around
    marks: list[str] = []  # decorators of the declaration that is next
    lead: int | None = None  # its first token, a decorator or modifier

    def declared(kind: str, name: int, begin: int, end: int, **more) -> None:
        row = {"annotations": list(marks), "comment": comments.before(t.places[begin]), "imports": imports}
        row |= {"end_line": line(t.places[min(end, len(t.places) - 1)])}
        out.append(_row(path, kind, t.at(name), line(t.places[name]), **{**row, **more}))

    def method(name: int, opening: int, block: int, begin: int) -> None:
        whole = t.at(block) == "{" and block in t.partner
        end = t.partner[block] if whole else t.after_types(block, frozenset(";"))
        shut = t.partner.get(opening, opening)
        params = split_params(clean[t.places[opening] + 1 : t.places[shut]])
        last = t.places[end] + 1 if end < len(t.places) else len(clean)
        words = t.words[begin:name]
        declared(
            "method", name, begin, end, owner=inside[-1][1] if inside else stem, params=[param_name(p) for p in params],
            calls=calls_in(clean[t.places[min(block, len(t.places) - 1)] : last]), access=_access(" ".join(words)),
            flags=[w for w in words if w in ("static", "async", "abstract", "get", "set")],
            body=text[t.places[begin] : last].strip().split("\n")[0],
        )

    def function(name: int, value: int, begin: int) -> None:
        """A name that is given what begins at ``value``: parentheses and an arrow, or a function."""
        if t.at(value) == "<":
            value = t.after_types(value, frozenset("(;"))
        if t.at(value) == "function":
            value = t.after_types(value + 1, frozenset("({;"))
            block = t.after_types(t.partner.get(value, value) + 1, frozenset("{;"))
        elif t.at(value) == "(" and value in t.partner:
            arrow = t.after_types(t.partner[value] + 1, frozenset(("=>", ";", ",", "{", "}", ")")))
            block = arrow + 1 if t.at(arrow) == "=>" else len(t.words)
        else:
            return
        if t.at(value) == "(" and block < len(t.words):
            method(name, value, block, begin)

    i = 0
    while i < len(t.words):
        w = t.words[i]
        while inside and i > inside[-1][0]:
            inside.pop()
        while blocks and i > blocks[-1]:
            blocks.pop()
        if w == "@" and t.is_word(i + 1):
            lead = i if lead is None else lead
            marks.append(t.at(i + 1))
            i = t.partner[i + 2] + 1 if t.at(i + 2) == "(" and i + 2 in t.partner else i + 2
            continue
        if w in _MODIFIERS and (t.is_word(i + 1) or t.at(i + 1) in ("@", "*", "[")):
            lead = i if lead is None else lead
            i += 1
            continue
        begin = i if lead is None else lead
        member = bool(inside and blocks and blocks[-1] == inside[-1][0])
        if w in ("class", "interface") and t.is_word(i + 1) and t.at(i - 1) != ".":
            block = t.after_types(i + 2, frozenset("{;"))
            end = t.partner.get(block, len(t.words) - 1)
            heritage = clean[t.places[i + 1] + len(t.at(i + 1)) : t.places[block] if block < len(t.places) else len(clean)]
            heritage = re.split(r"\b(?:extends|implements)\b", re.sub(r"<[^{]*?>", "", heritage))[1:]
            bases = [b for part in heritage for b in re.findall(r"[\w.$]+", part)]
            kind = {"annotations": [*marks, "interface"], "flags": ["interface"]} if w == "interface" else {}
            declared("class", i + 1, begin, end, bases=bases, **kind)
            if w == "class":
                inside.append((end, t.at(i + 1)))
                blocks.append(end)
            i = block if w == "class" else end
        elif w == "function":
            name = i + 2 if t.at(i + 1) == "*" else i + 1
            opening = t.after_types(name, frozenset("({;"))
            if t.is_word(name) and t.at(opening) == "(":
                method(name, opening, t.after_types(t.partner.get(opening, opening) + 1, frozenset("{;")), begin)
        elif w in ("const", "let", "var") and t.is_word(i + 1):
            equals = t.after_types(i + 2, frozenset("=;,"))
            if t.at(equals) == "=":
                function(i + 1, equals + 1 + (t.at(equals + 1) == "async"), begin)
        elif member and t.is_word(i) and t.at(i - 1) != "." and w not in ("constructor", "function") and w not in NO_CALLS:
            opening = t.after_types(i + 1, frozenset("(;={}"))
            if t.at(opening) == "(" and (opening == i + 1 or t.at(i + 1) == "<"):
                block = t.after_types(t.partner.get(opening, opening) + 1, frozenset("{;=}"))
                if t.at(block) == "{" and block in t.partner:
                    method(i, opening, block, begin)
                    i = block - 1
            elif t.at(opening) == "=":
                function(i, opening + 1 + (t.at(opening + 1) == "async"), begin)
        elif w == "{":
            blocks.append(t.partner.get(i, len(t.words)))
        marks, lead = [], None
        i += 1
    return out


def parse(path: str, text: str) -> list[dict]:
    """The rows of a file, by its ending; other files have none."""
    ending = "." + path.rsplit(".", 1)[-1]
    if ending == ".java":
        return parse_java(path, text)
    if ending == ".py":
        return parse_python(path, text)
    if ending in (".js", ".jsx", ".ts", ".tsx", ".mjs"):
        return parse_script(path, text)
    return parse_by_rule(path, text, BY_ENDING[ending]) if ending in BY_ENDING else []


def parsed(files: DataFrame) -> DataFrame:
    """The rows of all files (path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for p, t in zip(b.path, b.text, strict=True) for r in parse(p, t or "")], columns=NAMES)

    return files.select("path", "text").mapInPandas(run, ROW)


def class_fqn() -> Column:
    """The full name of a class row, outer classes included."""
    return F.concat_ws(".", F.nullif(F.col("package"), F.lit("")), F.nullif(F.col("owner"), F.lit("")), F.col("name"))


def method_fqn() -> Column:
    """The full name of a method row; in Java with its parameters' types, so that overloads stay apart."""
    owner = F.concat_ws(".", F.nullif(F.col("package"), F.lit("")), F.nullif(F.col("owner"), F.lit("")))
    types = F.concat(F.lit("("), F.array_join(F.transform("types", X.simple_type), ","), F.lit(")"))
    return F.concat(owner, F.lit("#"), F.col("name"), F.when(F.endswith("path", F.lit(".java")), types).otherwise(""))


def simple_owner() -> Column:
    """The innermost class that a row belongs to."""
    return F.element_at(F.split("owner", r"\."), -1)


def relationships(rows: DataFrame) -> DataFrame:
    """(src, edge_type, dst): what types, methods and fields refer to, resolved by imports, then by the project's own
    classes."""
    own = rows.where("kind = 'class'").select(F.col("name").alias("simple"), class_fqn().alias("fqn"))
    own = own.groupBy("simple").agg(F.min("fqn").alias("own_fqn"))
    me = F.when(F.col("kind") == "method", method_fqn()).otherwise(class_fqn())
    link = lambda kind, to: F.struct(F.lit(kind).alias("edge_type"), to.alias("to"))
    is_face = lambda b: F.startswith(b, F.lit("implements "))
    kind = lambda b: F.when(is_face(b), "implements_iface").otherwise("inherits").alias("edge_type")
    bases = F.transform("bases", lambda b: F.struct(kind(b), F.regexp_replace(b, "^(?:extends|implements) ", "").alias("to")))
    marks = F.transform("annotations", lambda a: link("annotated_by", a))
    takes = F.transform("types", lambda t: link("takes_type", t))
    given = (F.col("kind") == "method") & F.col("returns").isNotNull() & (F.col("returns") != "void")
    none = F.array().cast("array<struct<edge_type:string,to:string>>")
    gives = F.when(given, F.array(link("returns_type", F.col("returns")))).otherwise(none)
    out = rows.where("kind IN ('class', 'method')")
    out = out.select(me.alias("src"), "imports", F.explode(F.concat(bases, marks, takes, gives)).alias("e"))
    out = out.select("src", "imports", "e.*")
    simple = F.regexp_replace(F.regexp_replace("to", r"<.*|\[\]|\.\.\.", ""), r"^.*\.", "")
    out = out.withColumn("simple", F.trim(simple)).where("simple <> '' AND NOT simple RLIKE '^[a-z]'")
    by_import = F.get(F.filter("imports", lambda i: F.endswith(i, F.concat(F.lit("."), F.col("simple")))), F.lit(0))
    out = out.join(own, "simple", "left").withColumn("dst", F.coalesce(by_import, "own_fqn", "simple"))
    return out.select("src", "edge_type", "dst").distinct()


def call_rows(rows: DataFrame) -> DataFrame:
    """(caller, call, c, n, k, imports): calls as the parsers write them, and their class, name and number of arguments."""
    m = rows.where("kind = 'method'").select(method_fqn().alias("caller"), "imports", F.explode("calls").alias("call"))
    part = lambda pattern: F.regexp_extract("call", pattern, 1)
    return m.select(
        "caller", "call", part(r"^(.*)\.\w+/\d+$").alias("c"), part(r"(\w+)/\d+$").alias("n"),
        part(r"/(\d+)$").try_cast("int").alias("k"), "imports",
    )


def resolved_calls(rows: DataFrame) -> DataFrame:
    """(caller, callee, resolved): calls joined to the project's methods by class, name and number of arguments."""
    known = rows.where("kind = 'method'")
    known = known.select(simple_owner().alias("c"), F.col("name").alias("n"), F.size("params").alias("k"), method_fqn().alias("callee"))
    known = known.groupBy("c", "n", "k").agg(F.min("callee").alias("callee"))
    out = call_rows(rows).join(known, ["c", "n", "k"], "left")
    return out.select("caller", F.coalesce("callee", "call").alias("callee"), F.col("callee").isNotNull().alias("resolved")).distinct()


def unresolved_refs(rows: DataFrame) -> DataFrame:
    """(caller, name, receiver, arity, package_hint): calls of methods that the project does not have, with the package of
    the import that names their class."""
    known = rows.where("kind = 'method'").select(simple_owner().alias("c"), F.col("name").alias("n"), F.size("params").alias("k")).distinct()
    out = call_rows(rows).where("n <> ''").join(known, ["c", "n", "k"], "left_anti")
    hint = package_hint(F.col("imports"), F.col("c"))
    return out.select("caller", F.col("n").alias("name"), F.col("c").alias("receiver"), F.col("k").alias("arity"), hint.alias("package_hint")).distinct()


SCRIPT_JSON = (
    "array<struct<file:string,package:string,classes:array<struct<name:string,qualified:string,bases:array<string>,"
    "decorators:array<string>,line:int,end_line:int>>,functions:array<struct<name:string,class_name:string,"
    "params:array<string>,decorators:array<string>,calls:array<string>,line:int,end_line:int,body:string>>>>"
)


def from_script_json(outputs: DataFrame) -> DataFrame:
    """Rows of classes and methods of an external parser's output (json): files with classes and functions. Functions
    outside of classes belong to a class named by the module, which is a row of its own; no output gives no rows."""
    f = outputs.select(F.explode(F.from_json("json", SCRIPT_JSON)).alias("f")).select("f.*")
    module = F.coalesce(F.nullif(F.element_at(F.split("package", r"\."), -1), F.lit("")), F.lit("module"))
    f = f.select("*", module.alias("module"))
    head = ["file", F.coalesce("package", F.lit("")).alias("package")]
    none = F.array().cast("array<string>")
    classes = f.select(*head, F.explode("classes").alias("x")).select(
        F.col("file").alias("path"), F.lit("class").alias("kind"), F.lit("").alias("owner"), "x.name", none.alias("params"),
        F.coalesce("x.bases", none).alias("bases"), F.coalesce("x.decorators", none).alias("annotations"),
        none.alias("calls"), "x.line", "x.end_line", "package",
    )
    functions = f.select(*head, "module", F.explode("functions").alias("x"))
    modules = functions.where("x.class_name IS NULL").select("file", "package", "module").distinct().select(
        F.col("file").alias("path"), F.lit("class").alias("kind"), F.lit("").alias("owner"), F.col("module").alias("name"),
        none.alias("params"), none.alias("bases"), none.alias("annotations"), none.alias("calls"), F.lit(1).alias("line"),
        F.lit(1).alias("end_line"), "package",
    )
    methods = functions.select(
        F.col("file").alias("path"), F.lit("method").alias("kind"), F.coalesce("x.class_name", "module").alias("owner"),
        "x.name", F.coalesce("x.params", none).alias("params"), none.alias("bases"),
        F.coalesce("x.decorators", none).alias("annotations"), F.coalesce("x.calls", none).alias("calls"), "x.line",
        "x.end_line", "package",
    )
    return classes.unionByName(modules).unionByName(methods)
