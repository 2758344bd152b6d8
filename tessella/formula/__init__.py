"""The formula language: tokens, syntax tree, static checks and compilation to Spark columns."""

from tessella.formula.compile import compile_formula
from tessella.formula.syntax import parse, quote_column, quote_text

__all__ = ["compile_formula", "parse", "quote_column", "quote_text"]
