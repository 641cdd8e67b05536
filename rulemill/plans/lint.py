"""Lints: a predicate with an optional precondition and a severity, as one column with NA, pass, warn or error."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compile import compile_tree
from .tree import Node
from .vocabulary import Vocabulary

#: Obligations and what breaking them means.
ERRORS = ("MUST", "MUST NOT", "SHALL", "SHALL NOT", "REQUIRED")
WARNINGS = ("SHOULD", "SHOULD NOT", "RECOMMENDED", "NOT RECOMMENDED")
NON_PASS = ("error", "warn", "fatal")


@dataclass(frozen=True)
class Lint:
    name: str
    main: Node
    precondition: Node | None = None
    obligation: str = "MUST"

    @property
    def severity(self) -> str:
        return "error" if self.obligation in ERRORS else "warn" if self.obligation in WARNINGS else "info"

    @property
    def kind(self) -> str:
        """``guarded`` lints can answer NA; ``folded`` ones (a When inside the tree) answer pass there."""
        return "guarded" if self.precondition is not None else "folded"


def lint_column(lint: Lint, vocabulary: Vocabulary) -> Column:
    main = F.when(compile_tree(lint.main, vocabulary), "pass").otherwise(lint.severity)
    if lint.precondition is not None:
        main = F.when(~compile_tree(lint.precondition, vocabulary), "NA").otherwise(main)
    return main


def lint_columns(records: DataFrame, lints: list[Lint], vocabulary: Vocabulary, key: str) -> DataFrame:
    """Long form: (key, lint, status), one scan of the records whatever the number of lints."""
    results = F.array(*[F.struct(F.lit(x.name).alias("lint"), lint_column(x, vocabulary).alias("status")) for x in lints])
    return records.select(key, F.explode(results).alias("r")).select(key, "r.lint", "r.status")


def multi_branch(branches: list[Lint], vocabulary: Vocabulary) -> Column:
    """The first branch whose precondition holds answers; NA if none does."""
    out = F.lit("NA")
    for b in reversed(branches):
        own = F.when(compile_tree(b.main, vocabulary), "pass").otherwise(b.severity)
        out = F.when(compile_tree(b.precondition, vocabulary), own).otherwise(out) if b.precondition is not None else own
    return out
