"""The registry of steps and what they get from their surroundings."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from tessella.formula import compile_formula
from tessella.formula.syntax import Node
from tessella.relation import Cell, Relation
from tessella.types import StepError


@dataclass
class Context:
    """``resolve`` gives another query's relation; ``collation`` is natural or binary."""

    locale: str = "en-US"
    params: Mapping[str, Any] = field(default_factory=dict)
    resolve: Callable[[str], Relation] | None = None
    names: tuple[str, ...] = ()
    collation: str = "natural"

    def query(self, name: str) -> Relation:
        if self.resolve is None:
            raise StepError(f"Query `{name}` not found")
        return self.resolve(name)

    @property
    def natural(self) -> bool:
        return self.collation == "natural"

    def formula(self, source: str | Node, relation: Relation) -> Cell:
        return compile_formula(source, relation, self.params)


Step = Callable[[Relation, Mapping[str, Any], Context], Relation]
STEPS: dict[str, Step] = {}


def step(*kinds: str) -> Callable[[Step], Step]:
    def register(f: Step) -> Step:
        for kind in kinds:
            STEPS[kind] = f
        return f

    return register


def apply_step(relation: Relation, spec: Mapping[str, Any], context: Context | None = None) -> Relation:
    if spec["type"] not in STEPS:
        raise StepError(f"Unknown step {spec['type']}")
    return STEPS[spec["type"]](relation, spec, context or Context())
