"""``python -m codequery index TREE FOLDER`` and ``python -m codequery QUESTION FOLDER [ARGUMENT ...]``."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from codequery.api import CodeIndex
from codequery.sources import files

QUESTIONS = (
    "search", "get", "callers", "callees", "impact", "trace", "path", "usages", "subtypes", "links", "skeleton", "languages",
    "counts", "stamps", "dependencies", "module_listing", "suggestions",
)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="codequery", description=__doc__)
    p.add_argument("command", choices=("index", *QUESTIONS))
    p.add_argument("arguments", nargs="*")
    p.add_argument("--rows", type=int, default=50)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("codequery").getOrCreate()
    if a.command == "index":
        tree, folder = a.arguments
        root = os.path.abspath(tree)
        found = files.walked(spark, root)
        rows = found.selectExpr(f"substring(regexp_replace(path, '^file:/*', '/'), {len(root) + 2}) AS path", "text")
        CodeIndex.build(rows, os.path.basename(root)).save(folder)
        return
    folder, *rest = a.arguments
    getattr(CodeIndex.load(spark, folder), a.command)(*rest).show(a.rows, truncate=False)


if __name__ == "__main__":
    main()
