"""Approval gates over JSON evidence: rules by path, with missing, ill-typed and refused evidence told apart.

Documents are parsed once into VARIANT columns, joined by the id that they are about, and judged in the row: a rule takes a
value out of one document by its path, looks at the type that it has there (a number in quotes is no number), and compares
it with a constant or with a value of another document. Nothing is approved by what isn't there.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The type that a value must have in the document, as a pattern of the type's name, and the type that it is compared as.
TYPES = {"boolean": ("^BOOLEAN$", "boolean"), "number": (r"^(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "double"), "string": ("^STRING$", "string")}
_OPS = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}


@dataclass(frozen=True)
class Rule:
    """``document``'s value at ``path`` must be of ``kind`` and satisfy ``op`` with ``value``, or with another document's path."""

    document: str
    path: str
    kind: str
    op: str = "="
    value: bool | float | str | None = None
    other: tuple[str, str] | None = None

    @property
    def name(self) -> str:
        return f"{self.document}{self.path.removeprefix('$')}"


def documents(tables: dict[str, DataFrame], id_col: str, body_col: str) -> DataFrame:
    """id and, for each document, its parsed body (``name``) and how many the id has of it (``n_name``); ids of any document are there."""
    parts = []
    for name, rows in tables.items():
        one = rows.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias(f"n_{name}"), F.min(body_col).alias(name))
        parts.append(one.withColumn(name, F.try_parse_json(name)))
    met = reduce(lambda a, b: a.join(b, "id", "full"), parts)
    return met.withColumns({f"n_{name}": F.coalesce(f"n_{name}", F.lit(0)) for name in tables})


def _at(document: str, path: str) -> Column:
    """The variant at a path; null if there is none, or if it is JSON's null."""
    v = F.try_variant_get(F.col(document), path, "variant")
    return F.when(~F.is_variant_null(v), v)


def reason(rule: Rule) -> Column:
    """Why a rule fails: missing, ill_typed, unmatched (nothing to compare with) or refused; null if it holds."""
    pattern, kind = TYPES[rule.kind]
    value = _at(rule.document, rule.path)
    typed = lambda v: F.when(F.schema_of_variant(v).rlike(pattern), F.try_variant_get(v, "$", kind))
    wanted = F.lit(rule.value).cast(kind) if rule.other is None else typed(_at(*rule.other))
    failed = F.when(value.isNull(), "missing").when(typed(value).isNull(), "ill_typed").when(wanted.isNull(), "unmatched").when(~_OPS[rule.op](typed(value), wanted), "refused")
    return F.when(failed.isNotNull(), F.concat(F.lit(rule.name + ":"), failed))


def judged(evidence: DataFrame, rules: list[Rule]) -> DataFrame:
    """``evidence`` (from ``documents``) with failures, in the order of the rules, and approved.

    A document that is absent, repeated or no JSON fails once, as ``name:absent``, ``name:repeated`` or ``name:unreadable``, before
    its rules, which are then not judged.
    """
    names = list(dict.fromkeys(r.document for r in rules))
    state = lambda d: F.when(F.col(f"n_{d}") == 0, "absent").when(F.col(f"n_{d}") > 1, "repeated").when(F.col(d).isNull(), "unreadable")
    own = [F.when(state(d).isNotNull(), F.concat(F.lit(f"{d}:"), state(d))) for d in names]
    told = [F.when(state(r.document).isNull(), reason(r)) for r in rules]
    out = evidence.withColumn("failures", F.array_compact(F.array(*own, *told)))
    return out.withColumn("approved", F.size("failures") == 0)
