"""The quality diff: what a plan would do to a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import templates as tpl
from ..model import CleaningPlan, QualityDiff
from . import compile as compiling


def null_facts(columns: list[str]) -> list[Column]:
    """n, the number of rows, and c0, c1, ...: nulls of each column."""
    return [F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(tpl.quoted(c)).isNull()).alias(f"c{k}") for k, c in enumerate(columns)]]


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*null_facts(columns))


def compare(table: str, before: DataFrame, after: DataFrame, expressions: dict[str, str] | None = None, may_vanish: set[str] = frozenset(), settings: Settings = DEFAULTS) -> QualityDiff:
    """Rows, columns, nulls and types on both sides; unsafe if rows change, a column vanishes
    without successors, or nulls rise beyond the sentinels by more than the limit."""
    warnings: list[str] = []
    safe = True
    names = before.columns
    sentinel = [f"s{k}" for k in range(len(names))]
    b = before.agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(tpl.quoted(c)).isNull()).alias(f"c{k}") for k, c in enumerate(names)],
        *[F.count_if(F.expr(f"{tpl.as_text(c)} is not null and {tpl.is_sentinel(tpl.as_text(c))}") if dict(before.dtypes)[c] == "string" else F.lit(False)).alias(s) for c, s in zip(names, sentinel)],
    ).first()
    a = null_counts(after, after.columns).first()
    left = {c: a[f"c{k}"] for k, c in enumerate(after.columns)}
    if b["n"] == 0:
        warnings.append("the sample is empty")
        safe = False
    if a["n"] != b["n"]:
        warnings.append(f"row count changes from {b['n']} to {a['n']}")
        safe = False
    columns = []
    kinds_before, kinds_after = dict(before.dtypes), dict(after.dtypes)
    for k, c in enumerate(names):
        if c not in left:
            if c not in may_vanish and not any(n.startswith(f"{c}_") for n in left):
                warnings.append(f"column {c} is missing")
                safe = False
            continue
        rise = max(left[c] - b[f"c{k}"] - b[f"s{k}"], 0) / b["n"] if b["n"] else 0.0
        if rise > settings.null_spike:
            warnings.append(f"column {c}: nulls rise by {rise:.1%}")
            safe = False
        changed = (expressions or {}).get(c, tpl.quoted(c)) != tpl.quoted(c)
        columns.append({"column": c, "null_before": b[f"c{k}"], "null_after": left[c], "type_before": kinds_before[c], "type_after": kinds_after[c], "transformed": changed})
    for c in after.columns:
        if c not in names:
            columns.append({"column": c, "null_before": None, "null_after": left[c], "type_before": None, "type_after": kinds_after[c], "transformed": True})
    return QualityDiff(table, b["n"], a["n"], columns, warnings, safe)


def dry_run(plan: CleaningPlan, sample: DataFrame, settings: Settings = DEFAULTS) -> QualityDiff:
    try:
        after = compiling.apply(plan, sample)
        return compare(plan.table, sample, after, dict(plan.items), settings=settings)
    except Exception as e:
        return QualityDiff(plan.table, 0, 0, [], [f"Dry-run failed: {str(e).splitlines()[0][:300]}"], False)
