"""From classified columns to a plan: one expression for each output column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..config import DEFAULTS, Settings
from ..functions import templates as tpl
from ..model import Classified, CleaningPlan, ColumnClass, ColumnProfile, Expression
from ..operators import capture

PRIORITY = ("currency_string", "percentage_string", "mixed_date_format", "numeric_as_string", "inconsistent_boolean", "needs_trim", "null_variant", "inconsistent_casing")
TYPED = set(PRIORITY[:5])


def passthrough(c: ColumnProfile, note: str | None = None) -> Expression:
    return Expression(c.name, [c.name], [tpl.quoted(c.name)], "passthrough", note=note)


def deterministic(c: ColumnProfile, lower_categories: bool = True) -> Expression:
    """The template of the leading issue; on text, null variants, trimming and casing on top."""
    issues = set(c.issues)
    lead = next((i for i in PRIORITY if i in issues), None)
    e = tpl.as_text(c.name)
    flags = capture.flags_of(c)
    if lead is None:
        return passthrough(c)
    if lead in TYPED:
        sql = {
            "currency_string": lambda: tpl.currency(e, flags),
            "percentage_string": lambda: tpl.percentage(e),
            "mixed_date_format": lambda: tpl.date(e, c.date_format),
            "numeric_as_string": lambda: tpl.numeric_text(e, flags),
            "inconsistent_boolean": lambda: tpl.boolean(e),
        }[lead]()
    else:
        sql = tpl.null_variant(e) if "null_variant" in issues else e
        if "needs_trim" in issues:
            sql = tpl.trimmed(sql)
        if "inconsistent_casing" in issues and lower_categories:
            sql = tpl.lowered(sql)
    return Expression(c.name, [c.name], [sql], "deterministic", sorted(issues))


def select_sql(items: list[tuple[str, str]], table: str) -> str:
    """The plan as one SELECT; a column under its own name needs no alias."""
    parts = [s if s == tpl.quoted(n) else f"{s} AS {tpl.quoted(n)}" for n, s in items]
    return "SELECT\n  " + ",\n  ".join(parts) + f"\nFROM {tpl.quoted(table)}"


def assemble(plan: CleaningPlan) -> str:
    for e in plan.expressions:
        if len(e.names) != len(e.sql):
            raise ValueError(f"{e.column}: {len(e.names)} names for {len(e.sql)} expressions")
    return select_sql(plan.items, plan.table)


def apply(plan: CleaningPlan, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The plan's columns, and the columns ``keep`` as they are."""
    return df.selectExpr(*[f"{s} AS {tpl.quoted(n)}" for n, s in plan.items], *map(tpl.quoted, keep))


def audit(plan: CleaningPlan, classified: list[Classified]) -> str:
    """What happens to each column and why, as text."""
    kind = {c.column.name: c for c in classified}
    lines = [f"table {plan.table}: {len(plan.expressions)} columns, source {plan.source}"]
    for e in plan.expressions:
        c = kind.get(e.column)
        lines.append(f"- {e.column} [{c.kind.value if c else '?'}] -> {', '.join(e.names)} ({e.source})" + (f" issues: {', '.join(e.issues)}" if e.issues else "") + (f" note: {e.note}" if e.note else ""))
    return "\n".join(lines)


def compile_plan(
    table: str,
    sample: DataFrame,
    classified: list[Classified],
    overrides: dict[str, Expression] | None = None,
    suggest: capture.Suggester | None = None,
    patch: Callable[[Expression, ColumnProfile], Expression] | None = None,
    settings: Settings = DEFAULTS,
) -> CleaningPlan:
    """Route each column: personal, key, structured and free text pass through; the rest is typed
    and healed; in full mode issues on text are cleaned as well.  Answers given by people win, and
    ``patch`` has the last word."""
    healed = {e.column: e for e in capture.heal(sample, classified, suggest, settings)}
    out = []
    for c in classified:
        name = c.column.name
        e = healed.get(name) or passthrough(c.column)
        if settings.mode == "full" and e.source == "passthrough" and c.kind is ColumnClass.CLEAN_DET and not e.note:
            e = deterministic(c.column)
        if overrides and name in overrides:
            e = overrides[name]
        if patch is not None:
            e = patch(e, c.column)
        out.append(e)
    return CleaningPlan(table, out)
