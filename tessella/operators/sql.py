"""SQL over the previous step and other queries."""

from __future__ import annotations

import re
import uuid

from tessella.operators.base import step
from tessella.relation import Relation
from tessella.types import StepError


def alias(name: str) -> str:
    """The name under which SQL sees a query."""
    out = re.sub(r"[^0-9a-z]+", "_", name.lower()).strip("_") or "query"
    return f"q_{out}" if out[0].isdigit() else out


@step("CustomSql")
def custom_sql(r, s, c):
    """A SELECT in Spark's SQL; the previous step is ``self``, errors are null.

    Queries are visible by their names in lower case with underscores, as far as the
    statement mentions them.
    """
    sql = (s.get("sql") or "").strip()
    if not re.match(r"(?is)^(?:\s|--[^\n]*\n)*(select|with|values|from|table)\b", sql):
        raise StepError("The SQL must be a SELECT statement")
    words = {w.lower() for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", sql)}
    frames = {"self": r.output()}
    for name in c.names:
        if alias(name) in words:
            frames[alias(name)] = c.query(name).output()
    # the frames come in as parameters of the session's SQL, under names that no view of the user's has
    spark, suffix = r.df.sparkSession, uuid.uuid4().hex[:12]
    names = {k: f"{k}_{suffix}" for k in frames}
    for k, df in frames.items():
        df.createOrReplaceTempView(names[k])
    heads = ", ".join(f"{k} AS (SELECT * FROM {v})" for k, v in names.items())
    body = sql.rstrip("; \n")
    with_ = re.match(r"(?is)^(?:\s|--[^\n]*\n)*with\s+(recursive\s+)?", body)
    body = f"WITH {with_[1] or ''}{heads}, {body[with_.end():]}" if with_ else f"WITH {heads} {body}"
    try:
        out = Relation.of(spark.sql(body))
    except Exception as e:
        raise StepError(f"SQL error: {str(e).splitlines()[0]}") from e
    finally:
        for v in names.values():
            spark.catalog.dropTempView(v)
    return out
