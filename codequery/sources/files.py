"""Files as tables: project trees, discovery, documents of text formats, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Folders that a walk leaves out, and files that mark a project's root.
PRUNED = ("target", "build", "node_modules", "dist", "out", "__pycache__", "venv", "vendor")
MARKERS = (
    "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "build.sbt", "pyproject.toml", "setup.py", "setup.cfg", "Pipfile", "requirements.txt", "package.json", "Cargo.toml", "go.mod", "Gemfile",
    "composer.json", "mix.exs", "Package.swift", "project.clj", "deps.edn", "package.yaml",
)
MARKER_ENDINGS = (".csproj", ".fsproj", ".vbproj", ".sln", ".cabal")
#: Extensions of generic documents.
TEXT_EXTENSIONS = ("md", "mdx", "txt", "rst", "adoc", "html", "htm", "yaml", "yml", "json", "toml", "properties", "ini", "cfg", "xml")
PARAGRAPH_LINES, TITLE_CHARS = 150, 60


def walked(spark: SparkSession, root: str, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """(path, mtime, size, text) of the files below ``root``, pruned and hidden folders left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return kept(files, extensions).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.col("content").cast("string").alias("text"))


def kept(files: DataFrame, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """Rows whose path has no pruned or hidden folder and one of the extensions."""
    out = files.where(~F.rlike("path", F.lit(rf"/(?:{'|'.join(PRUNED)}|\.[^/]+)/")))
    return out.where(F.rlike("path", F.lit(rf"\.(?:{'|'.join(extensions)})$"))) if extensions else out


def discovered(paths: DataFrame, depth: int | None = None) -> DataFrame:
    """(root): folders with a marker file, the topmost of nested ones, at most ``depth`` folders deep."""
    ends = F.lit(False)
    for e in MARKER_ENDINGS:
        ends = ends | F.endswith("name", F.lit(e))
    rows = paths.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("root"), F.element_at(F.split("path", "/"), -1).alias("name"))
    roots = kept(rows.where(F.col("name").isin(*MARKERS) | ends).withColumn("path", F.concat("root", F.lit("/x")))).select("root").distinct()
    if depth is not None:
        roots = roots.where(F.size(F.split("root", "/")) <= depth)
    # A root lies below another if one of its parents is a root.
    parts = F.split("root", "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    above = roots.where(F.size(parts) > 1).select("root", F.explode(parents).alias("parent")).join(roots.select(F.col("root").alias("parent")), "parent", "left_semi").select("root")
    return roots.join(above, "root", "left_anti")


def numbered_lines(files: DataFrame) -> DataFrame:
    """(path, line, text) of each line, from 1."""
    return files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("i", "line_text")).select("path", (F.col("i") + 1).alias("line"), F.col("line_text").alias("text"))


def _w(*by) -> Window:
    return Window.partitionBy("path").orderBy(*by)


def _sections(lines: DataFrame, start: Column) -> DataFrame:
    """Lines with ``section``, which grows at each start."""
    return lines.withColumn("section", F.sum(start.cast("int")).over(_w("line")))


def _chunks(rows: DataFrame, *more: Column) -> DataFrame:
    """(path, section, start, end, text, ...) of sections that are not blank."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy("path", "section").agg(F.min("line").alias("start"), F.max("line").alias("end"), text.alias("text"), *more).where(F.trim("text") != "")


def markdown_chunks(files: DataFrame) -> DataFrame:
    """Chunks at headings outside fences, with the titles above as a breadcrumb."""
    lines = numbered_lines(files).withColumn("fence", F.rlike("text", F.lit(r"^\s*(?:```|~~~)")))
    lines = lines.withColumn("inside", F.sum(F.col("fence").cast("int")).over(_w("line")) % 2 == 1)
    level = F.when(~F.col("inside") & ~F.col("fence"), F.length(F.regexp_extract("text", r"^(#{1,6})\s+\S", 1))).otherwise(0)
    lines = lines.withColumn("level", level).withColumn("title", F.when(level > 0, F.trim(F.regexp_replace("text", r"^#{1,6}\s+|\s*#*\s*$", ""))))
    lines = _sections(lines, F.col("level") > 0)
    # A title holds until a heading of its level or above.
    upto = _w("line").rowsBetween(Window.unboundedPreceding, 0)
    for k in range(1, 7):
        mark = F.when(F.col("level") == k, F.struct(F.col("line").alias("l"), F.col("title").alias("t")))
        shallower = F.when((F.col("level") > 0) & (F.col("level") < k), F.col("line"))
        lines = lines.withColumn(f"h{k}", F.last(mark, ignorenulls=True).over(upto)).withColumn(f"s{k}", F.max(shallower).over(upto))
        lines = lines.withColumn(f"h{k}", F.when(F.col(f"h{k}.l") > F.coalesce(f"s{k}", F.lit(0)), F.col(f"h{k}.t")))
    crumbs = F.concat_ws(" > ", *(f"h{k}" for k in range(1, 7)))
    return _chunks(lines.withColumn("crumbs", crumbs), F.max_by("crumbs", "line").alias("breadcrumb"))


def rst_chunks(files: DataFrame) -> DataFrame:
    """Chunks at lines that the next one underlines."""
    lines = numbered_lines(files).withColumn("next", F.lead("text").over(_w("line")))
    under = F.rlike("next", F.lit(r"^([=\-~^\"'`#*+])\1{2,}\s*$")) & (F.trim("text") != "") & (F.length(F.trim("next")) >= F.length(F.trim("text")))
    lines = lines.withColumn("head", F.coalesce(under, F.lit(False)))
    return _chunks(_sections(lines, F.col("head")), F.max(F.when(F.col("head"), F.trim("text"))).alias("title"))


def paragraph_chunks(files: DataFrame, most: int = PARAGRAPH_LINES) -> DataFrame:
    """Paragraphs, parted by blank lines and every ``most`` lines, titled by their first words."""
    lines = numbered_lines(files).withColumn("blank", F.trim("text") == "")
    before = F.lag("blank", 1, True).over(_w("line"))
    lines = lines.withColumn("begin", ~F.col("blank") & before)
    lines = lines.withColumn("para", F.sum(F.col("begin").cast("int")).over(_w("line"))).where(~F.col("blank"))
    nth = F.row_number().over(Window.partitionBy("path", "para").orderBy("line")) - 1
    lines = lines.withColumn("cut", F.floor(nth / most))
    lines = lines.withColumn("section", F.dense_rank().over(Window.partitionBy("path").orderBy("para", "cut")))
    return _chunks(lines, F.substring(F.trim(F.min_by("text", "line")), 1, TITLE_CHARS).alias("title"))


def yaml_chunks(files: DataFrame) -> DataFrame:
    """A chunk for each top-level key."""
    lines = numbered_lines(files).withColumn("key", F.nullif(F.regexp_extract("text", r"^([A-Za-z_][\w.\-]*)\s*:", 1), F.lit("")))
    return _chunks(_sections(lines, F.col("key").isNotNull()), F.max("key").alias("title"))


def generic_documents(files: DataFrame) -> DataFrame:
    """One document row for each file: stem, title from the first heading or line, description from the first paragraph."""
    first = F.trim(F.regexp_replace(F.regexp_extract("text", r"(?m)^\s*(\S.*)$", 1), r"^#+\s*", ""))
    title = F.coalesce(F.nullif(F.trim(F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1)), F.lit("")), first)
    para = F.regexp_extract("text", r"(?:^|\n\s*\n|\n)((?!#)[^\n#\s][^\n]*(?:\n(?!\s*\n|#)[^\n]+)*)", 1)
    clean = F.trim(F.regexp_replace(F.regexp_replace(title, r"[^\p{L}\p{N} _.\-]", ""), r"\s+", " "))
    return files.select("path", F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("stem"), F.substring(clean, 1, TITLE_CHARS).alias("title"), F.regexp_replace(para, r"\s+", " ").alias("description"))


def single_chunks(files: DataFrame) -> DataFrame:
    """(path, start, end, text, title, description): a file as one chunk, titled by its stem; described by its first
    heading, else its first line of words, shortened, else the stem."""
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    head = F.trim(F.regexp_extract("text", r"(?m)^#{1,6}\s+(\S.*)$", 1))
    line = F.trim(F.regexp_extract("text", r"(?m)^[ \t]*(\S.*)$", 1))
    short = F.when(F.length(line) > 120, F.concat(F.substring(line, 1, 117), F.lit("..."))).otherwise(line)
    said = F.coalesce(F.nullif(head, F.lit("")), F.nullif(short, F.lit("")), stem)
    return files.select(
        "path", F.lit(1).alias("start"), F.size(F.split("text", "\n")).alias("end"), F.trim("text").alias("text"),
        stem.alias("title"), said.alias("description"),
    )


def chunk_name(heading: Column) -> Column:
    """A heading as a name: other signs and blanks as underscores, none at its ends, 80 characters at most."""
    plain = F.regexp_replace(F.regexp_replace(heading, r"[^a-zA-Z0-9_\-. ]", "_"), r"\s+", "_")
    return F.substring(F.regexp_replace(F.regexp_replace(plain, "_+", "_"), "^_|_$", ""), 1, 80)


def markdown_links(files: DataFrame) -> DataFrame:
    """(path, target, anchor) of links to other files; web, mail and file-transfer links are left out."""
    links = F.regexp_extract_all("text", F.lit(r"\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1))
    rows = files.select("path", F.explode(links).alias("link")).where(~F.rlike("link", F.lit(r"^(?i)(?:https?|mailto|ftp):")))
    stem = F.regexp_extract(F.split_part("link", F.lit("#"), F.lit(1)), r"([^/]*?)(?:\.[^./]*)?$", 1)
    return rows.select("path", F.when(F.startswith("link", F.lit("#")), F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)).otherwise(stem).alias("target"), F.nullif(F.split_part("link", F.lit("#"), F.lit(2)), F.lit("")).alias("anchor"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, href, n) of the links of html pages."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))
