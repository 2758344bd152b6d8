"""Command line: ``python -m tessella run|inspect|plan|python PROJECT ...``.

Exit codes: 0 done, 1 a step failed, 2 wrong usage, 3 the project can't be read.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from tessella.plans import Engine, Project
from tessella.plans.project import parameter_value
from tessella.types import FormulaError, StepError


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tessella")
    p.add_argument("command", choices=("run", "inspect", "plan", "python"))
    p.add_argument("project", help="a project's JSON file or folder")
    p.add_argument("query", nargs="?", help="default: all queries with a load target")
    p.add_argument("--data", default=".", help="folder of the source files")
    p.add_argument("--out", default="out", help="folder or file for results")
    p.add_argument("--format", default="parquet", choices=("csv", "tsv", "parquet", "arrow", "xlsx"))
    p.add_argument("--param", action="append", default=[], metavar="NAME=VALUE")
    p.add_argument("--master", default=None)
    return p.parse_args(argv)


def export_python(project: Project, name: str) -> str:
    """A script that runs a query and those it needs, a line for each step."""
    queries = project.order([name])
    lines = [
        "import datetime",
        "",
        "from pyspark.sql import SparkSession",
        "from tessella.operators import apply_step",
        "from tessella.operators.base import Context",
        "from tessella.plans import Engine, Project",
        "",
        "spark = SparkSession.builder.getOrCreate()",
        "files = {}  # paths of files by their names",
        "engine, tables = Engine(spark, Project({}), files), {}",
        f"params = { {n: parameter_value(p) for n, p in project.params.items()}!r}",
        f"context = Context({project.locale!r}, params, tables.__getitem__, {tuple(queries)!r})",
    ]
    for q in queries:
        lines += ["", f"# {q}"]
        for s in project.queries[q].steps:
            source = s.get("source") or s
            if s["type"] != "Source":
                lines.append(f"r = apply_step(r, {s!r}, context)")
            elif source.get("kind") == "query":
                lines.append(f"r = tables[{source['query']!r}]")
            else:
                lines.append(f"r = engine.source({s!r}, 'full')")
        lines.append(f"tables[{q!r}] = r")
    return "\n".join([*lines, "", f"tables[{name!r}].ordered().show()", ""])


def main(argv: list[str] | None = None) -> int:
    try:
        a = _arguments(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 2
    try:
        project = Project.load(a.project)
    except (OSError, ValueError, KeyError) as e:
        print(f"Can't read {a.project}: {e}", file=sys.stderr)
        return 3
    for p in a.param:
        name, eq, value = p.partition("=")
        if not eq or name not in project.params:
            print(f"Unknown parameter {name}", file=sys.stderr)
            return 2
        project.params[name]["value"] = value
    if a.query and a.query not in project.queries:
        print(f"Unknown query {a.query}", file=sys.stderr)
        return 2
    if a.command == "python":
        print(export_python(project, a.query or next(iter(project.queries))))
        return 0
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("tessella").config("spark.sql.session.timeZone", "UTC")
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    files = {f: os.path.join(a.data, f) for f in os.listdir(a.data)} if os.path.isdir(a.data) else {}
    engine = Engine(spark, project, files)
    try:
        if a.command == "inspect":
            print(json.dumps({n: engine.schema(n) for n in ([a.query] if a.query else project.order())}, indent=2))
        elif a.command == "plan":
            for n in [a.query] if a.query else project.order():
                engine.relation(n).output().explain("formatted")
        elif a.query:
            engine.export(a.query, a.out, a.format, ordered=True)
            print(a.out)
        else:
            os.makedirs(a.out, exist_ok=True)
            print("\n".join(engine.refresh_all(a.out)))
    except (StepError, FormulaError) as e:
        print("\n".join([f"{type(e).__name__}: {e}", *getattr(e, "__notes__", [])]), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
