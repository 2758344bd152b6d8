"""What functions take: how many arguments, and of which kinds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from tessella.types import TYPES


@dataclass(frozen=True)
class Kind:
    """Types that an argument of this kind may have, and how a message speaks of it."""

    types: frozenset[str]
    noun: str
    converter: str


#: The kinds of arguments, by the letters of signatures, and the words of messages.
KINDS = {
    "t": Kind(frozenset(("text", "any")), "text", "Text.From"),
    "n": Kind(frozenset(("number", "int", "any", "bool")), "a number", "Number.From"),
    "d": Kind(frozenset(("date", "datetime", "any", "text")), "a date", "Date.From"),
}
COUNT_MESSAGE = "{name} expects {wanted} argument(s), got {given}"
KIND_MESSAGE, KIND_HINT = "{name} needs {noun} but argument {place} is {have}", "Wrap it: {converter}(...)"
MANY = "one or more"


@dataclass(frozen=True)
class Signature:
    """Parameters in order; the last one may repeat, and those from ``required`` on may be left out."""

    kinds: tuple[str, ...]
    required: int
    repeats: bool

    @classmethod
    @lru_cache(maxsize=256)
    def parse(cls, parameters: tuple[str, ...]) -> Signature:
        """From letters with ``?`` (may be left out) or ``...`` (once or more)."""
        optional = [p for p in parameters if p[-1] == "?"]
        return cls(tuple(p[0] for p in parameters), len(parameters) - len(optional), parameters[-1][-1] == "." if parameters else False)

    def takes(self, given: int) -> bool:
        return given >= self.required and (self.repeats or given <= len(self.kinds))

    def count_problem(self, name: str, given: int) -> str | None:
        if self.takes(given):
            return None
        most = len(self.kinds)
        wanted = MANY if self.repeats else f"{most}" if self.required == most else f"{self.required}–{most}"
        return COUNT_MESSAGE.format(name=name, wanted=wanted, given=given)

    def kind_problems(self, name: str, types: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """The place, message and hint of each argument of a wrong type; None stands for a plain null, which fits all."""
        last = len(self.kinds) - 1
        for place, have in enumerate(types):
            kind = KINDS.get(self.kinds[min(place, last)])
            if kind and have is not None and have not in kind.types:
                yield place, KIND_MESSAGE.format(name=name, noun=kind.noun, place=place + 1, have=TYPES[have]), KIND_HINT.format(converter=kind.converter)
