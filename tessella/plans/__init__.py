"""Projects: named queries of steps, compiled to DataFrames."""

from tessella.plans.project import Engine, Project, Query

__all__ = ["Engine", "Project", "Query"]
