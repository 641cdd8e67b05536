"""Typed predicate trees over nested records, compiled to Catalyst columns."""

from .compile import compile_tree
from .lint import Lint, lint_column, lint_columns, multi_branch
from .tree import parse, serialise, validate
from .vocabulary import CERTIFICATE, Field, Vocabulary

__all__ = ["CERTIFICATE", "Field", "Lint", "Vocabulary", "compile_tree", "lint_column", "lint_columns", "multi_branch", "parse", "serialise", "validate"]
