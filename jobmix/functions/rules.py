"""Ordered label rules: data, not code.

A rule set maps a name column to a label; the first rule that matches wins
and names matching nothing get the default.  ``contains`` rules compare
against the lower-cased name (any case), ``one_of`` rules compare the name
as it is (case-sensitive), mirroring how the dashboard's CASE blocks are
written.  Replace the rule sets to fit an estate's naming convention.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobmix.params import UNMAPPED


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str                 # "contains" (any case) or "one_of" (exact, case-sensitive)
    values: tuple[str, ...]

    def __post_init__(self):
        if self.kind not in ("contains", "one_of"):
            raise ValueError(f"unknown rule kind {self.kind!r}")
        object.__setattr__(self, "values", tuple(self.values))

    def predicate(self, name: Column) -> Column:
        if self.kind == "one_of":
            return name.isin(list(self.values))
        lowered = F.lower(name)
        preds = [lowered.contains(v.lower()) for v in self.values]
        out = preds[0]
        for p in preds[1:]:
            out = out | p
        return out


def load_rules(path: str) -> dict[str, tuple["Rule", ...]]:
    """Rule sets from a JSON file: ``{"bu": [{"label", "kind", "values"}, ...], "env": [...]}``.

    ``bu`` is required; without ``env`` the built-in environment rules apply.
    """
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    if not found.get("bu"):
        raise ValueError(f"{path}: no 'bu' rules")
    out = {k: tuple(Rule(r["label"], r["kind"], tuple(r["values"])) for r in found[k])
           for k in ("bu", "env") if k in found}
    return {"env": ENV_RULES, **out}


def contains(label: str, *needles: str) -> Rule:
    return Rule(label, "contains", needles)


def one_of(label: str, *names: str) -> Rule:
    return Rule(label, "one_of", names)


def label_expr(name: Column, rules: Sequence[Rule], default: str = UNMAPPED) -> Column:
    """An ordered ``CASE WHEN`` chain; a NULL name falls through to ``default``."""
    if not rules:
        return F.lit(default)
    expr = None
    for r in rules:
        expr = F.when(r.predicate(name), F.lit(r.label)) if expr is None \
            else expr.when(r.predicate(name), F.lit(r.label))
    return expr.otherwise(F.lit(default))


# Environment from the workspace name, by hyphen-delimited infix,
# in this order (DEV infixes are checked before PROD ones).
ENV_RULES: tuple[Rule, ...] = (
    contains("DEV", "-dev-"),
    contains("DEV", "-sandbox-"),
    contains("DEV", "-test-"),
    contains("DEV", "-nonprod-"),
    contains("QAT", "-qat-"),
    contains("PPE", "-ppe-"),
    contains("PROD", "-prod-"),
    contains("PROD", "-beta-"),
)

# Business-unit rules for the test fixture's naming convention (w-<bu>-<env>-r1).
# Rule 5 lists one name ("w-risk-ppe-r1") that rule 4 already takes: kept on
# purpose to pin first-match-wins ordering.
FIXTURE_BU_RULES: tuple[Rule, ...] = (
    contains("Ingest", "ingest"),
    contains("Daas", "-daas-"),
    contains("Market", "market"),
    contains("Risk", "risk"),
    one_of("Legacy", "w-legacy-prod-r1", "w-legacy-qat-r1", "w-risk-ppe-r1"),
    contains("Retail", "retail"),
)
