"""Scalar functions over identifiers, signatures, paths and code text; all are Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word of the analyzer, dotted names staying whole.
TOKEN = r"[\p{L}\p{N}_]+(?:[.'][\p{L}\p{N}_]+)*"

#: Path rules in order, and their factors.
PATH_RULES = (("/benchmark/", 0.25), ("/jmh/", 0.25), ("/src/test/", 0.30), ("/test/", 0.30), ("/.github/", 0.10))
PATH_ENDINGS, PATH_ENDING_FACTOR = (".md", ".txt", ".sh", ".yml"), 0.10
DOC_ENDINGS = (".md", ".txt", ".yml", ".adoc", ".yaml", ".sh", ".xml")
TEST_PARTS = ("/src/test/", "/test/", "/benchmark/", "/jmh/")
ACCESS = (("public", 1.0), ("protected", 0.85), ("private", 0.5))
ACCESS_OTHER = 0.75

#: Factor of a class type under an intent; ``other`` where a type is not listed.
CLASS_TYPES = ("interface", "abstract", "class", "enum", "record", "annotation")
CLASS_BONUS = {
    "INTERFACE": (3.0, 1.8, 0.7, 1.0, 1.0, 1.0, 1.0),
    "ABSTRACT": (1.8, 3.0, 0.7, 1.0, 1.0, 1.0, 1.0),
    "ENUM": (0.6, 0.6, 0.8, 3.0, 0.6, 0.6, 0.6),
    "RECORD": (0.6, 0.6, 0.8, 0.6, 3.0, 0.6, 0.6),
    "ANNOTATION": (0.9, 0.6, 0.7, 0.6, 0.6, 3.0, 0.6),
    "IMPLEMENTATION": (0.4, 0.7, 2.5, 1.5, 1.5, 1.0, 1.0),
}

#: Type names that read as a map, a wrapper or a collection.
MAP_TYPES = ("map", "hashmap", "linkedhashmap", "treemap", "concurrentmap", "concurrenthashmap", "enummap", "sortedmap", "navigablemap")
WRAPPER_TYPES = ("optional", "completablefuture", "listenablefuture", "future", "mono", "flux", "observable", "single", "maybe")
COLLECTION_TYPES = {
    "list": ("list", "arraylist", "linkedlist", "copyonwritearraylist", "vector"),
    "set": ("set", "hashset", "linkedhashset", "treeset", "enumset", "sortedset", "navigableset"),
    "collection": ("collection", "iterable", "queue", "deque", "arraydeque", "linkedblockingqueue"),
    "stream": ("stream",),
    "page": ("page",),
    "slice": ("slice",),
}


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once: what a lambda takes from outside is computed anew for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case words of a text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def split_identifier(name: Column) -> Column:
    """``parseXMLDocument`` and ``parse_xml_document`` as ``parse xml document``."""
    parted = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(parted, r"[_$\-]+", " ")), r"\s+", " "))


def is_identifier_like(word: Column) -> Column:
    """Whether a word has an underscore or a capital after its first character."""
    return F.contains(word, F.lit("_")) | F.rlike(word, F.lit(r"^.+[A-Z]"))


def scope(path: Column, is_chunk: Column | None = None) -> Column:
    """prod, test or docs by path; chunks are docs."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    out = F.when(is_chunk, "docs") if is_chunk is not None else F
    out = out.when(path.isNull(), "prod")
    ends, holds = F.lit(False), F.lit(False)
    for e in DOC_ENDINGS:
        ends = ends | p.endswith(e)
    for t in TEST_PARTS:
        holds = holds | p.contains(t)
    return out.when(ends, "docs").when(holds, "test").otherwise("prod")


def path_factor(path: Column) -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    out = F.when(path.isNull(), 1.0)
    for part, factor in PATH_RULES:
        out = out.when(p.contains(part), factor)
    for e in PATH_ENDINGS:
        out = out.when(p.endswith(e), PATH_ENDING_FACTOR)
    return out.otherwise(1.0)


def doc_type_factor(doc_type: Column, path: Column) -> Column:
    p = F.coalesce(F.replace(path, F.lit("\\"), F.lit("/")), F.lit(""))
    return F.when((doc_type == "class") & ~p.contains("/src/test/") & ~p.contains("/test/"), 1.8).otherwise(1.0)


def class_type_factor(class_type: Column, intent: Column) -> Column:
    out = F.when(class_type.isNull() | intent.isNull(), 1.0)
    for name, row in CLASS_BONUS.items():
        for kind, factor in zip(CLASS_TYPES, row, strict=False):
            out = out.when((intent == name) & (class_type == kind), factor)
        out = out.when(intent == name, row[-1])
    return out.otherwise(1.0)


def access_factor(access: Column) -> Column:
    out = F
    for name, factor in ACCESS:
        out = out.when(access == name, factor)
    return out.otherwise(ACCESS_OTHER)


def _bare(kind: Column) -> Column:
    return F.trim(F.replace(F.trim(F.regexp_replace(kind, r"<.*", "")), F.lit("[]"), F.lit("")))


def return_phrase(kind: Column) -> Column:
    """A return type in words; null for none and void."""
    rt = F.trim(kind)
    outer = F.trim(F.regexp_extract(rt, r"^([^<]*)<", 1))
    inner = F.trim(F.regexp_extract(rt, r"^[^<]+<(.*?)>?[^>]*$", 1))
    low = F.lower(outer)
    comma = F.instr(inner, ",")
    pair = F.concat(F.lit("map of "), _bare(F.trim(F.substring_index(inner, ",", 1))), F.lit(" to "), _bare(F.trim(F.substr(inner, comma + 1))))
    out = F.when(kind.isNull() | (rt == "") | (rt == "void"), None).when(rt.endswith("[]"), F.concat(F.lit("array of "), _bare(F.regexp_replace(rt, r"\[\]$", ""))))
    out = out.when(outer == "", rt)
    out = out.when(low.isin(*MAP_TYPES), F.when(comma > 1, pair).otherwise("map"))
    out = out.when(low.isin(*WRAPPER_TYPES), F.concat(F.replace(F.replace(low, F.lit("completablefuture"), F.lit("future")), F.lit("listenablefuture"), F.lit("future")), F.lit(" "), _bare(inner)))
    for word, names in COLLECTION_TYPES.items():
        out = out.when(low.isin(*names), F.concat(F.lit(f"{word} of "), _bare(inner)))
    return out.otherwise(outer)


def description(name: Column, class_name: Column, is_constructor: Column, params: Column, return_type: Column, callees: Column) -> Column:
    """A method in words: verb, parameters, return, the first five callees."""
    given = F.filter(F.transform(F.filter(params, lambda p: ~p.isin("self", "this")), split_identifier), lambda p: p != "")
    called = F.slice(F.array_distinct(F.filter(F.transform(callees, split_identifier), lambda c: c != "")), 1, 5)
    returned = F.when(~is_constructor, return_phrase(return_type))
    return F.concat(
        F.when(is_constructor, F.concat(F.lit("creates "), class_name)).otherwise(split_identifier(name)),
        F.when(F.size(given) > 0, F.concat(F.lit(": given "), F.array_join(given, ", "))).otherwise(""),
        F.coalesce(F.concat(F.lit(" — returns "), returned), F.lit("")),
        F.when(F.size(called) > 0, F.concat(F.lit(" — calls "), F.array_join(called, ", "))).otherwise(""),
    )


def capped(text: Column, n: int) -> Column:
    """The first ``n`` characters."""
    return F.substring(text, 1, n)


def embedding_text(kind: Column, name: Column, summary: Column, comment: Column, body: Column) -> Column:
    """What is embedded of a row: name, summary, comment and body, capped by kind."""
    part = lambda x, n: F.when(F.coalesce(x, F.lit("")) != "", capped(x, n))
    return (
        F.when(kind == "class", F.concat_ws("\n", part(name, 4000), part(summary, 4000), part(comment, 8000), part(body, 16000)))
        .when(kind == "chunk", F.concat_ws("\n", part(summary, 4000), part(name, 4000), part(body, 20000)))
        .otherwise(F.concat_ws("\n", part(name, 4000), part(summary, 4000), part(comment, 4000), part(body, 8000)))
    )


def passage(name: Column, signature: Column, comment: Column, body: Column, n: int = 300) -> Column:
    """What a cross-encoder reads: name, signature, then the comment or else the body, shortened."""
    tail = F.when(F.coalesce(comment, F.lit("")) != "", capped(comment, n)).otherwise(capped(body, n))
    return F.concat_ws(" ", *(F.when(F.coalesce(x, F.lit("")) != "", x) for x in (name, signature, tail)))


def fqn_parts(fqn: Column) -> Column:
    """(class_fqn, package, simple_name, n_params, kind) of ``a.b.C#m(X<Y,Z>,W)``."""
    owner = F.substring_index(F.substring_index(fqn, "#", 1), "(", 1)
    last = F.element_at(F.split(owner, r"\."), -1)
    args = F.regexp_extract(fqn, r"\((.*)\)$", 1)
    # Commas outside of generics, however deep these nest.
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"))
    step = lambda a, c: F.struct(
        (a["depth"] + F.when(c == "<", 1).when(c == ">", -1).otherwise(0)).alias("depth"),
        (a["n"] + F.when((c == ",") & (a["depth"] == 0), 1).otherwise(0)).alias("n"),
    )
    commas = F.aggregate(F.split(args, ""), start, step)["n"]
    return F.struct(
        owner.alias("class_fqn"),
        F.when(F.contains(owner, F.lit(".")), F.regexp_replace(owner, r"\.[^.]*$", "")).otherwise("").alias("package"),
        F.when(F.contains(fqn, F.lit("#")), F.regexp_extract(fqn, r"#([^(]*)", 1)).otherwise(last).alias("simple_name"),
        F.when(F.trim(args) == "", 0).otherwise(commas + 1).cast("int").alias("n_params"),
        F.when(~F.contains(fqn, F.lit("#")), "class").when(F.contains(fqn, F.lit("#<init>")), "constructor").otherwise("method").alias("kind"),
    )


def extension(path: Column) -> Column:
    found = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(found == "", "other").otherwise(F.coalesce(found, F.lit("other")))


def simple_type(kind: Column) -> Column:
    """``java.util.List<a.B>`` as ``List<B>``."""
    return F.regexp_replace(kind, r"([\w$]+\.)+(?=[\w$])", "")


def project_name(folder: Column) -> Column:
    """A folder's name without a version at its end."""
    return F.regexp_replace(folder, r"-\d+(\.\d+)*$", "")


def field_name(model: Column) -> Column:
    """A model id as a field name."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(model), r"[^a-z0-9]+", "_"), r"^_+|_+$", ""), 1, 64)


def first_word(name: Column) -> Column:
    """``findActiveUser`` as ``find``."""
    return F.lower(F.regexp_extract(name, r"^.[^A-Z]*", 0))


def first_sentence(text: Column, n: int = 200) -> Column:
    """Up to the first full stop before a blank, capped."""
    return capped(F.trim(F.regexp_extract(text, r"(?s)^(.*?)(?:\.\s|\.$|$)", 1)), n)


def normal_term(word: Column, stop_words: Column) -> Column:
    """A term of mining: lower case without digits at its edges; null if short or a stop word."""
    t = F.regexp_replace(F.lower(word), r"^[0-9]+|[0-9]+$", "")
    return F.when((F.length(t) >= 3) & ~F.array_contains(stop_words, t), t)


def linked_classes(comment: Column) -> Column:
    """Simple class names of ``{@link ...}`` and ``@see ...``."""
    inline = F.regexp_extract_all(comment, F.lit(r"\{@link\s+([\w.#()]+)\}"), F.lit(1))
    see = F.regexp_extract_all(comment, F.lit(r"@see\s+([\w.#()]+)"), F.lit(1))
    return F.array_distinct(F.transform(F.concat(inline, see), lambda x: F.element_at(F.split(F.substring_index(x, "#", 1), r"\."), -1)))


def escaped(query: Column) -> Column:
    """A query with the signs of the query syntax taken as text."""
    return F.regexp_replace(query, r'([+\-!(){}\[\]^"~*?:\\/|&])', r"\\$1")


def encoded_ranges(ranges: Column) -> Column:
    """Line ranges (start, end) as bytes: their number, then each start and end, four bytes each, the highest first."""
    four = lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 8, "0")
    return F.unhex(F.concat(four(F.size(ranges)), F.array_join(F.transform(ranges, lambda r: F.concat(four(r["start"]), four(r["end"]))), "")))


def decoded_ranges(raw: Column) -> Column:
    """The line ranges that ``encoded_ranges`` has written; none of less than four bytes."""
    at = lambda k: F.conv(F.substr(F.hex(raw), k * 8 + 1, F.lit(8)), 16, 10).cast("long").cast("int")
    each = F.transform(F.sequence(F.lit(0), at(F.lit(0)) - 1), lambda i: F.struct(at(2 * i + 1).alias("start"), at(2 * i + 2).alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.when(F.coalesce(F.length(raw), F.lit(0)) < 4, none).when(at(F.lit(0)) == 0, none).otherwise(each)


def label(doc_type: Column) -> Column:
    """What a result is called; both spellings of a document count."""
    return F.when(doc_type == "class", "class").when(doc_type.isin("doc", "document"), "document").when(doc_type == "chunk", "chunk").otherwise("method")


def collision_probability(cosine: Column, bits: int = 1) -> Column:
    """That two vectors agree on so many random hyperplanes."""
    return F.pow(1 - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) / F.lit(3.141592653589793), F.lit(float(bits)))
