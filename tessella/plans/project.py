"""Projects and the engine that compiles them.

A project has named queries; a query is a list of steps, the first a Source. Queries
refer to each other by name, so a project is a graph without cycles. Compiling a
query builds one lazy DataFrame; equal prefixes of steps are built once.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from tessella.operators import Context, apply_step
from tessella.operators import quality as quality_views
from tessella.operators.joining import merge_stats
from tessella.operators.values import clusters
from tessella.relation import Relation
from tessella.sources import read_file, read_folder, read_rows, write
from tessella.sources.files import preview, suggest_types
from tessella.types import FormulaError, StepError, closest

FORMAT_VERSION = 1
PREVIEW_ROWS = 1_000


@dataclass
class Query:
    name: str
    steps: list[dict[str, Any]]
    load: dict[str, Any] = field(default_factory=dict)


def parameter_value(spec: Mapping[str, Any]) -> Any:
    """A parameter as a constant: number, date, list (comma-separated) or text."""
    kind, value = spec.get("type", "text"), spec.get("value")
    if value is None:
        return None
    if kind == "number":
        n = float(value)
        return int(n) if n.is_integer() else n
    if kind == "date":
        return dt.date.fromisoformat(str(value)[:10])
    if kind == "list":
        return [x.strip() for x in str(value).split(",")] if isinstance(value, str) else list(value)
    return str(value)


@dataclass
class Project:
    queries: dict[str, Query]
    params: dict[str, dict[str, Any]] = field(default_factory=dict)
    locale: str = "en-US"
    preview_rows: int = PREVIEW_ROWS
    format_version: int = FORMAT_VERSION

    @classmethod
    def from_json(cls, text: str) -> Project:
        raw = json.loads(text)
        queries = {}
        for q in raw.get("queries", []):
            name = q.get("name") or q["id"]
            queries[name] = Query(name, list(q.get("steps", [])), dict(q.get("load") or {}))
        settings = raw.get("settings") or raw
        params = {p["name"]: p for p in raw.get("params", raw.get("parameters", []))}
        return cls(queries, params, settings.get("locale", "en-US"), int(settings.get("previewRows", PREVIEW_ROWS)), int(raw.get("format_version", FORMAT_VERSION)))

    def to_json(self) -> str:
        """Stable text: keys are sorted."""
        raw = {
            "format_version": self.format_version,
            "settings": {"locale": self.locale, "previewRows": self.preview_rows},
            "params": list(self.params.values()),
            "queries": [{"name": q.name, "steps": q.steps, "load": q.load} for q in self.queries.values()],
        }
        return json.dumps(raw, sort_keys=True, indent=2, ensure_ascii=False)

    @classmethod
    def load(cls, path: str) -> Project:
        """A JSON file, or a folder with ``project.json`` and one file for each query."""
        if os.path.isdir(path):
            with open(os.path.join(path, "project.json"), encoding="utf-8") as f:
                raw = json.load(f)
            folder = os.path.join(path, "queries")
            raw["queries"] = []
            for name in sorted(os.listdir(folder)):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    raw["queries"].append(json.load(f))
            return cls.from_json(json.dumps(raw))
        with open(path, encoding="utf-8") as f:
            return cls.from_json(f.read())

    def save(self, folder: str) -> None:
        os.makedirs(os.path.join(folder, "queries"), exist_ok=True)
        raw = json.loads(self.to_json())
        for q in raw.pop("queries"):
            name = re.sub(r"[^\w.-]+", "_", q["name"])
            with open(os.path.join(folder, "queries", f"{name}.json"), "w", encoding="utf-8") as f:
                json.dump(q, f, sort_keys=True, indent=2, ensure_ascii=False)
        with open(os.path.join(folder, "project.json"), "w", encoding="utf-8") as f:
            json.dump(raw, f, sort_keys=True, indent=2, ensure_ascii=False)

    def references(self, name: str) -> list[str]:
        """Queries that a query needs."""
        out: list[str] = []
        for s in self.queries[name].steps:
            source = s.get("source") or s
            if s["type"] == "Source" and source.get("kind") == "query":
                out.append(source["query"])
            elif s["type"] == "Merge":
                out.append(s["right"])
            elif s["type"] == "Append":
                out += s.get("others", [])
            elif s["type"] == "CustomSql":
                from tessella.operators.sql import alias

                words = {w.lower() for w in re.findall(r"[A-Za-z_]\w*", s.get("sql", ""))}
                out += [q for q in self.queries if q != name and alias(q) in words]
        return list(dict.fromkeys(out))

    def order(self, names: Sequence[str] | None = None) -> list[str]:
        """Queries so that each comes after those it needs; a cycle is an error."""
        done: list[str] = []

        def visit(name: str, path: tuple[str, ...]) -> None:
            if name in path:
                raise StepError(f"Circular reference: {' → '.join([*path[path.index(name):], name])}")
            if name not in self.queries:
                like = closest(name, self.queries)
                raise StepError(f"Query `{name}` not found", [f"Did you mean `{like}`?"] if like else [])
            if name not in done:
                for q in self.references(name):
                    visit(q, (*path, name))
                done.append(name)

        for n in names or list(self.queries):
            visit(n, ())
        return done

    def rename_column(self, query: str, at: int, old: str, new: str) -> None:
        """Rewrites a column's name in the steps from ``at`` on, formulas included."""
        from tessella.formula import quote_column

        def swap(x):
            if isinstance(x, str):
                return new if x == old else x.replace(quote_column(old), quote_column(new))
            if isinstance(x, list):
                return [swap(y) for y in x]
            return {k: v if k in ("type", "kind", "mode", "op", "fn", "how", "check", "action") else swap(v) for k, v in x.items()} if isinstance(x, dict) else x

        steps = self.queries[query].steps
        steps[at:] = [swap(s) for s in steps[at:]]


class Engine:
    """Compiles and runs a project's queries. ``files`` maps file names to paths."""

    def __init__(self, spark: SparkSession, project: Project, files: Mapping[str, str] | None = None, collation: str = "natural"):
        self.spark, self.project, self.files, self.collation = spark, project, dict(files or {}), collation
        self.tables: dict[str, Relation] = {}
        self._memo: dict[str, Relation] = {}

    def register(self, name: str, table: Any) -> None:
        """A DataFrame or relation as a source that queries can name."""
        self.tables[name] = table if isinstance(table, Relation) else Relation.of(table)

    def context(self, mode: str) -> Context:
        params = {n: parameter_value(p) for n, p in self.project.params.items()}
        return Context(self.project.locale, params, lambda q: self.relation(q, mode=mode), tuple([*self.project.queries, *self.tables]), self.collation)

    def source(self, step: Mapping[str, Any], mode: str) -> Relation:
        s = step.get("source") or step
        kind = s.get("kind", "file")
        if kind == "query":
            return self.relation(s["query"], mode=mode)
        if kind == "blank":
            return read_rows(self.spark, s.get("columns", []), s.get("rows", []))
        if kind == "table":
            return self.tables[s["table"]]
        if kind == "folder":
            r = read_folder(self.spark, self.files.get(s["folder"], s["folder"]), s)
        else:
            r = read_file(self.spark, self.files.get(s["file"], s["file"]), s)
        return preview(r, self.project.preview_rows)[0] if mode == "preview" else r

    def fingerprint(self, name: str, upto: int | None, mode: str) -> str:
        """A hash of the steps and of all that they refer to."""
        if name in self.tables and name not in self.project.queries:
            return f"table:{name}:{id(self.tables[name])}"
        steps = self.project.queries[name].steps[: None if upto is None else upto + 1]
        refs = [self.fingerprint(q, None, mode) for q in self.project.references(name)]
        text = json.dumps([steps, refs, mode, self.project.locale, self.project.params, self.project.preview_rows, self.collation], sort_keys=True, default=str)
        return hashlib.sha256(text.encode()).hexdigest()

    def relation(self, name: str, upto: int | None = None, mode: str = "full") -> Relation:
        """The query's table after the step ``upto`` (default: all), lazily."""
        if name in self.tables and name not in self.project.queries:
            return self.tables[name]
        self.project.order([name])
        steps, context = self.project.queries[name].steps, self.context(mode)
        last = len(steps) - 1 if upto is None else upto
        out, done = None, -1
        for k in range(last, -1, -1):
            if (found := self._memo.get(self.fingerprint(name, k, mode))) is not None:
                out, done = found, k
                break
        for k in range(done + 1, last + 1):
            s = steps[k]
            try:
                out = self.source(s, mode) if s["type"] == "Source" else apply_step(out, s, context)
            except (StepError, FormulaError) as e:
                e.add_note(f"in step {k + 1} ({s['type']}) of query `{name}`")
                raise
            self._memo[self.fingerprint(name, k, mode)] = out
        if out is None:
            raise StepError(f"Query `{name}` has no steps")
        return out

    def clear_cache(self) -> None:
        self._memo.clear()

    # -- views

    def schema(self, name: str, upto: int | None = None) -> dict[str, str]:
        return dict(self.relation(name, upto).types)

    def page(self, name: str, offset: int = 0, count: int = 200, mode: str = "full") -> list[dict]:
        r = apply_step(self.relation(name, mode=mode), {"type": "KeepRows", "mode": "range", "offset": offset, "n": count})
        return [x.asDict() for x in r.ordered().collect()]

    def quality(self, name: str) -> list[dict]:
        return [x.asDict() for x in quality_views.quality(self.relation(name)).collect()]

    def profile(self, name: str, column: str) -> dict:
        return quality_views.profile(self.relation(name), column)

    def distinct(self, name: str, column: str) -> dict:
        rows = quality_views.distinct_values(self.relation(name), column, quality_views.DISTINCT + 1).collect()
        return {"values": [(x["value"], x["count"]) for x in rows[: quality_views.DISTINCT]], "capped": len(rows) > quality_views.DISTINCT}

    def overview(self, name: str) -> dict:
        return quality_views.overview(self.relation(name))

    def clusters(self, name: str, column: str, method: str = "fingerprint") -> list[dict]:
        return [x.asDict(True) for x in clusters(self.relation(name), column, method).collect()]

    def merge_stats(self, left: str, right: str, spec: Mapping[str, Any]) -> dict:
        return merge_stats(self.relation(left), self.relation(right), spec)

    def suggest(self, name: str) -> list[dict]:
        """Steps that would tidy a query's table, from a bounded sample."""
        from tessella.plans.suggestions import suggestions

        return suggestions(self.relation(name))

    def suggest_steps(self, file: str) -> list[dict]:
        """First steps for a new source."""
        r = read_file(self.spark, self.files.get(file, file))
        step = suggest_types(r)
        return [{"type": "Source", "source": {"kind": "file", "file": file}}, *([step] if step else [])]

    # -- sinks

    def export(self, name: str, path: str, kind: str, **options: Any) -> None:
        write(self.relation(name), path, kind, **options)

    def refresh_all(self, folder: str) -> list[str]:
        """Writes every query that has a load target, in the order of their references."""
        done = []
        for name in self.project.order():
            target = (self.project.queries[name].load or {}).get("target", "none")
            if target not in ("none", None):
                path = os.path.join(folder, f"{name}.{target}")
                self.export(name, path, target)
                done.append(path)
        return done
