"""The steps: each maps a relation to a relation.

``STEPS`` has them by kind; a step is a mapping with its ``type`` and fields.
"""

from tessella.operators import columns, grouping, joining, quality, reshape, rows, sql, values, windows
from tessella.operators.base import STEPS, Context, apply_step

__all__ = ["STEPS", "Context", "apply_step", "columns", "grouping", "joining", "quality", "reshape", "rows", "sql", "values", "windows"]
