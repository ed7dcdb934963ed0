"""Licence scan: ordered signature rules behind a keyword gate, resolved by priority and interval containment.

A text is reduced to lower-case words parted by single spaces; only A to Z are lowered. A rule is a regex over those
words: about three hundred are written by hand (``license_rules``), the forms of a licence's name with its versions are
made from FAMILIES. Each rule is gated by a keyword, the rarest word that its every match holds: a text's words, digits
taken off, are met with all keywords at once, and only the rules of keywords that occur are tried. A detection is
dropped when a rule of the same or a stronger priority found an interval that contains it. That is decided in one sweep
over the detections by start, in blocks of about the root of their number, which carry the furthest end of each priority
so far. All of it is row-local: no shuffle, no Python on the executors.

Edge cases: a null text counts as empty; a text without words has no detections, null positions, empty labels and score
0; texts of any length are scanned whole, each rule that is tried once along it, and n detections are resolved in
n ** 1.5 steps; repeated rows are each scanned; an empty table gives no rows; columns besides the id and the text are
ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequery.llm import license_rules
from codequery.llm._support import text_of

#: Characters that part words once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Letters beyond A-Z that lower to a-z, and a letter that stays as it is.
FOLDING, KEPT = ("\u212a", "\u0130"), "\u0138"

#: Phrase and label of the base rules.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: label, name as words, versions, short name.
FAMILIES = (
    ("agpl", "gnu affero general public license", ("3",), "agpl"),
    ("lgpl", "gnu (?:lesser|library) general public license", ("2", "2 1", "3"), "lgpl"),
    ("gpl", "gnu general public license", ("1", "2", "3"), "gpl"),
    ("gfdl", "gnu free documentation license", ("1 1", "1 2", "1 3"), "gfdl"),
    ("apache", "apache(?: software)? license", ("1 0", "1 1", "2 0"), "apache"),
    ("mpl", "mozilla public license", ("1 0", "1 1", "2 0"), "mpl"),
    ("epl", "eclipse public license", ("1 0", "2 0"), "epl"),
    ("eupl", "european union public licen[cs]e", ("1 0", "1 1", "1 2"), "eupl"),
    ("cddl", "common development and distribution license", ("1 0", "1 1"), "cddl"),
    ("cpl", "common public license", ("1 0",), "cpl"),
    ("osl", "open software license", ("1 0", "2 0", "2 1", "3 0"), "osl"),
    ("afl", "academic free license", ("1 1", "2 0", "2 1", "3 0"), "afl"),
    ("artistic", "(?:perl )?artistic license", ("1 0", "2 0"), "artistic"),
    ("bsl", "boost software license", ("1 0",), "bsl"),
    ("isc", "isc license", (), "isc"),
    ("mit", "(?:mit|expat) license", (), "mit"),
    ("bsd-2-clause", "(?:simplified bsd|freebsd|bsd 2 clause) license", (), "bsd 2 clause"),
    ("bsd-3-clause", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause) license", (), "bsd 3 clause"),
    ("bsd-4-clause", "(?:original bsd|bsd 4 clause) license", (), "bsd 4 clause"),
    ("bsd", "bsd(?: style)? license", (), "bsd"),
    ("zlib", "zlib(?: libpng)? license", (), "zlib"),
    ("ofl", "sil open font license", ("1 0", "1 1"), "ofl"),
    ("ms-pl", "microsoft public license", (), "ms pl"),
    ("ms-rl", "microsoft reciprocal license", (), "ms rl"),
    ("unlicense", "unlicense", (), "unlicense"),
    ("wtfpl", "do what the fuck you want to public license", (), "wtfpl"),
    ("psf", "python software foundation license", ("2",), "psf"),
    ("php", "php license", ("3 0", "3 01"), "php"),
    ("postgresql", "postgresql license", (), "postgresql"),
    ("ncsa", "university of illinois ncsa open source license", (), "ncsa"),
    ("upl", "universal permissive license", ("1 0",), "upl"),
    ("qpl", "q public license", ("1 0",), "qpl"),
    ("lppl", "latex project public license", ("1 0", "1 2", "1 3"), "lppl"),
    ("odbl", "open data commons open database license", ("1 0",), "odbl"),
    ("odc-by", "open data commons attribution license", ("1 0",), "odc by"),
    ("pddl", "open data commons public domain dedication and license", ("1 0",), "pddl"),
    ("cecill", "cecill free software license agreement", ("1 0", "2 0", "2 1"), "cecill"),
    ("busl", "business source license", ("1 1",), "busl"),
    ("sspl", "server side public license", ("1",), "sspl"),
    ("elastic", "elastic license", ("1", "2 0"), "elastic"),
)
#: Creative Commons elements, and the words that name them in full.
CREATIVE = (
    ("by", "attribution"),
    ("by nc", "attribution non ?commercial"),
    ("by sa", "attribution share ?alike"),
    ("by nd", "attribution no derivatives"),
    ("by nc sa", "attribution non ?commercial share ?alike"),
    ("by nc nd", "attribution non ?commercial no derivatives"),
)
CREATIVE_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Confidence of a priority; 9 is that of the base rules, which are neither dropped nor drop others.
CONFIDENCE = {1: 1.0, 2: 0.95, 3: 0.9, 4: 0.8, 5: 0.7, 6: 0.3, 9: 0.6}
#: Words that are no keyword where a rule has another: frequent ones, and those that most licences share.
COMMON = frozenset(
    "a about all an and any are as at available be by can changed code copies copy copyright distribute distributed do document "
    "file files for free general granted have holders hereby if in including is it its library license licenses licensed "
    "licence made may modify must name names no not of on open or other person permission program project provided public "
    "purpose redistribute released rights s same see shall software source statement terms text that the these this to under "
    "use used version v was will with without work you your".split()
)


@dataclass(frozen=True)
class Rule:
    order: int
    label: str
    regex: str
    gate: str
    priority: int


def _bounded(body: str) -> str:
    return rf"(?<= )(?:{body})(?= )"


def _spaced(parsed, last: bool) -> bool:
    """Whether all that a part of a regex matches begins, or ends, with a space."""
    items = list(parsed)
    if not items:
        return False
    op, x = str(items[-1 if last else 0][0]), items[-1 if last else 0][1]
    if op == "LITERAL":
        return x == 32
    if op == "BRANCH":
        return all(_spaced(branch, last) for branch in x[1])
    return op == "SUBPATTERN" and _spaced(x[-1], last)


def _certain(parsed) -> str:
    """What every match of a regex holds, in order; digits as spaces, other parts as a mark that is no letter."""
    out = ""
    for op, x in parsed:
        op = str(op)
        if op == "LITERAL":
            out += " " if chr(x).isdigit() else chr(x)
        elif op == "SUBPATTERN":
            out += _certain(x[-1])
        elif op == "MAX_REPEAT" and [str(x[2][0][0]), x[2][0][1]] == ["LITERAL", 32]:
            out += "\x01"  # a space or none: a space where digits follow
        else:
            inner = x[2] if op in ("MAX_REPEAT", "MIN_REPEAT") else [(op, x)]
            out += (" " if _spaced(inner, False) else "") + "\x00" + (" " if _spaced(inner, True) else "")
    return re.sub("\x01(?=[ \x01]|$)|(?<= )\x01", " ", out)


def keyword(body: str) -> str:
    """The gate of a regex: a whole word of all its matches, the rarest by COMMON and length."""
    words = [w for w in _certain(re._parser.parse(body)).split(" ") if w.isalpha()]
    if not words:
        raise ValueError(f"no word is in all matches of {body!r}")
    return max(words, key=lambda w: (w not in COMMON, len(w)))


def rules() -> list[Rule]:
    """The rules in order. Priorities: 1 choices and SPDX tags, 2 texts, exceptions and grants, 3 names with versions,
    4 names, 5 short names, 6 hints."""
    made = [(label, body, 1) for label, body in license_rules.DUAL]
    made += [(label, body, 2) for label, body in (*license_rules.EXCEPTIONS, *license_rules.BODIES)]
    grant = r"(?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?"
    later = "(?: or (?:any )?later(?: version)?)?"
    for label, name, versions, short in FAMILIES:
        for v in versions:
            zero = ".0" if " " not in v and label.endswith("gpl") else ""
            tag, number = f"{label}-{v.replace(' ', '.')}{zero}", rf"(?: version| v)? ?{v}(?: 0)?"
            made += [
                (tag, rf"spdx license identifier {short} {v}(?: 0)?(?: only| or later)?", 1),
                (tag, grant + name + number + later, 2),
                (tag, name + number + later, 3),
                (tag, rf"{short}(?: license)?(?: version| v)? ?{v}(?: 0)?(?: only{later})?", 5),
            ]
        made += [(label, rf"spdx license identifier {short}", 1), (label, grant + name, 2), (label, name, 4)]
    for short, name in CREATIVE:
        label = f"cc-{short.replace(' ', '-')}"
        for v in CREATIVE_VERSIONS:
            tag, where = f"{label}-{v.replace(' ', '.')}", "(?: international| unported| generic)?"
            made += [
                (tag, rf"spdx license identifier cc {short} {v}", 1),
                (tag, grant + rf"(?:a )?cc {short}(?: license)? {v}{where}", 2),
                (tag, grant + rf"(?:a )?creative commons {name}(?: license)? {v}{where}", 2),
                (tag, rf"cc {short} {v}{where}", 3),
                (tag, rf"creative commons {name} {v}{where}", 3),
            ]
        made += [(label, rf"creative commons {name}", 4), (label, rf"cc {short}", 5)]
    made += [("cc0", "cc ?0(?: 1 0)?(?: universal)?(?: license)?", 4), ("cc0", "creative commons (?:zero|0)(?: 1 0)?", 4)]
    made += [(label, body, 4) for label, body in license_rules.NAMES]
    made += [(label, body, 6) for label, body in license_rules.HINTS]
    made += [(label, phrase, 9) for phrase, label in BASE]
    # A regex of branches becomes a rule for each, so that each has a keyword.
    split = [(label, part, p) for label, body, p in made for part in _branches(body)]
    return [Rule(i, label, _bounded(body), keyword(body), p) for i, (label, body, p) in enumerate(split)]


def _branches(body: str) -> list[str]:
    """The parts between bars outside parentheses."""
    out, depth = [""], 0
    for c in body:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _literal(found: list[Rule]) -> Column:
    """The rules as one constant of the plan."""
    rows = [r.__dict__ | {"confidence": CONFIDENCE[r.priority]} for r in found]
    kind = "array<struct<order:int,label:string,regex:string,gate:string,priority:int,confidence:double>>"
    return F.from_json(F.lit(json.dumps(rows)), kind)


DETECTION = "struct<start:bigint,end:bigint,order:int,label:string,priority:int,confidence:double>"


def _spans(words: Column, rule: Column) -> Column:
    """Detections of one rule in the order of the sweep's keys: start, end from large to small, priority, order. Word
    positions of its matches are found by a mark put before each."""
    marked = F.split(F.trim(F.regexp_replace(words, rule["regex"], F.lit("\u0001$0"))), " ")
    at = F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit("\u0001")), i).otherwise(-1))
    return F.zip_with(
        F.filter(at, lambda i: i >= 0),
        F.regexp_extract_all(words, rule["regex"], F.lit(0)),
        lambda i, m: F.struct(
            i.cast("long").alias("start"),
            (-(i + F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))) + 1)).cast("long").alias("less"),
            rule["priority"].alias("priority"), rule["order"].alias("order"),
            rule["label"].alias("label"), rule["confidence"].alias("confidence"),
        ),
    )


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value taken once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _resolved(found: Column) -> Column:
    """The sorted detections that none before them drops: what contains one comes before it or is as strong at most."""
    levels = sorted(p for p in CONFIDENCE if p < 9)
    ends = lambda some, p: F.coalesce(F.array_max(F.transform(F.filter(some, lambda d: d["priority"] <= p), lambda d: -d["less"])), F.lit(-1).cast("long"))
    width = lambda d: F.greatest(F.lit(1), F.floor(F.sqrt(F.size(d))).cast("int"))
    cut = lambda d: _let(width(d), lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(d) - 1) / n).cast("int")), lambda b: F.slice(d, b * n + 1, n)))
    tops = lambda blocks: F.transform(blocks, lambda some: F.array(*(ends(some, p) for p in levels)))
    before = lambda tops: F.transform(tops, lambda _, b: _let(F.slice(tops, F.lit(1), b), lambda seen: F.array(*(F.coalesce(F.array_max(F.transform(seen, lambda t: F.get(t, F.lit(k)))), F.lit(-1).cast("long")) for k in range(len(levels))))))

    def kept(some: Column, high: Column) -> Column:
        inside = lambda d, i: (F.get(high, d["priority"] - levels[0]) >= -d["less"]) | F.exists(F.slice(some, F.lit(1), i), lambda e: (e["priority"] <= d["priority"]) & (e["less"] <= d["less"]))
        return F.filter(some, lambda d, i: (d["priority"] == 9) | ~inside(d, i))

    blocks = lambda d: _let(cut(d), lambda b: F.flatten(F.zip_with(b, _let(tops(b), before), kept)))
    return F.when(F.size(found) > 0, _let(found, blocks))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df``'s ids with ``n_words`` and ``detections``: array of (start, end, order, label, priority, confidence), end
    exclusive."""
    known = rules()
    text = text_of(text_col)
    for c in FOLDING:
        text = F.replace(text, F.lit(c), F.lit(KEPT))
    core = F.trim(F.regexp_replace(F.lower(text), SEPARATORS, " "))
    spaces = F.length("_words") - F.length(F.replace(F.col("_words"), F.lit(" "), F.lit("")))
    gates = F.array(*(F.lit(g) for g in sorted({r.gate for r in known})))
    out = df.select(F.col(id_col), F.concat(F.lit(" "), core, F.lit(" ")).alias("_words"))
    out = out.withColumn("n_words", F.when(F.col("_words") == "  ", F.lit(0)).otherwise(spaces - 1).cast("long"))
    out = out.withColumn("_keys", F.array_intersect(F.split("_words", "[ 0-9]+"), gates))
    hits = F.filter(_literal(known), lambda r: F.array_contains(F.col("_keys"), r["gate"]) & F.rlike(F.col("_words"), r["regex"]))
    found = F.flatten(F.transform(hits, lambda r: _spans(F.col("_words"), r)))
    out = out.withColumn("_found", F.when(F.size("_keys") > 0, F.sort_array(found)))
    fields = [f.split(":")[0] for f in DETECTION[7:-1].split(",")]
    shown = lambda d: F.struct(*((-d["less"] if f == "end" else d[f]).alias(f) for f in fields))
    kept = F.transform(_resolved(F.col("_found")), shown)
    return out.select(id_col, "n_words", F.coalesce(kept, F.array().cast(f"array<{DETECTION}>")).alias("detections"))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One summary row per scanned document."""
    base = F.filter("detections", lambda d: d["priority"] == 9)
    joined = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")
    best = F.array_max(F.transform("detections", lambda d: d["confidence"]))
    starts = scanned.withColumn("_at", F.transform(base, lambda d: d["start"]))
    return starts.select(
        F.col(id_col), "n_words", F.size("_at").cast("long").alias("n_base"), F.array_min("_at").alias("first_word"),
        F.array_max("_at").alias("last_word"), joined(base).alias("base_labels"),
        joined(F.col("detections")).alias("labels"), F.coalesce(best, F.lit(0.0)).alias("score"),
    )
