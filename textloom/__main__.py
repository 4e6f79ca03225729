"""Command line: ``python -m textloom BASE ingest|rarities|search|graph|analyze|export ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from textloom.workbench import WRITERS, Workbench


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="textloom", description="Corpora, terms and concept graphs under one folder.")
    top.add_argument("base", help="folder of the stored tables")
    steps = top.add_subparsers(dest="step", required=True)

    def step(name: str, *given: str, **options) -> None:
        p = steps.add_parser(name)
        for g in given:
            p.add_argument(g)
        for k, default in options.items():
            flag = "--" + k.replace("_", "-")
            p.add_argument(flag, action="store_true") if default is False else p.add_argument(flag, type=type(default), default=default)

    step("ingest", "path", "corpus", pattern="*.txt", recursive=False, clean_ocr=False)
    step("rarities", "corpus", "background", "terms", method="hybrid", top_n=50, min_score=0.0)
    step("search", "corpus", "term", width=50)
    step("graph", "corpus", "terms", "name", method="count", threshold=1.0)
    step("analyze", "name", method="degree")
    step("export", "name", "path", format="json")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    given = vars(parser().parse_args(arguments))
    base, step = given.pop("base"), given.pop("step")
    if step == "export" and given["format"] not in WRITERS:
        raise SystemExit(f"format: one of {', '.join(sorted(WRITERS))}")
    bench = Workbench(spark or SparkSession.builder.appName("textloom").getOrCreate(), base)
    out = getattr(bench, step)(**given)
    if step in ("rarities", "analyze"):
        out.show(50, truncate=80)
    elif step == "search":
        for row in out.toLocalIterator():
            print(row.line)


if __name__ == "__main__":
    main()
