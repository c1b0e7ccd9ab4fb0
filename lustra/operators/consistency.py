"""Formats across tables: columns of one kind are grouped, and those that differ are aligned."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import templates as tpl
from ..model import ColumnProfile, Expression, Group, Member, TableProfile
from .classify import is_identifier, label_key, name_words
from .profile import DATE_WORDS, PHONE_WORDS


def is_numeric_type(declared: str) -> bool:
    return any(t in declared.lower() for t in ("int", "numeric", "decimal", "serial"))


def majority(members: list[Member], prefer: Callable[[str], bool]) -> str:
    """The form with most rows; ties go to a preferred form, then to the first seen."""
    weight: dict[str, int] = {}
    for m in members:
        weight[m.form] = weight.get(m.form, 0) + max(m.rows, 1)
    top = max(weight.values())
    tied = [f for f, w in weight.items() if w == top]
    return next((f for f in tied if prefer(f)), tied[0])


def majority_frame(members: DataFrame) -> DataFrame:
    """The same for a DataFrame (label, form, rows, preferred, seen)."""
    sums = members.groupBy("label", "form").agg(F.sum(F.greatest("rows", F.lit(1))).alias("weight"), F.max("preferred").alias("preferred"), F.min("seen").alias("seen"))
    order = Window.partitionBy("label").orderBy(F.desc("weight"), F.desc("preferred"), "seen")
    return sums.withColumn("k", F.row_number().over(order)).filter("k = 1").select("label", F.col("form").alias("canonical"), "weight")


def find_groups(tables: dict[str, TableProfile]) -> list[Group]:
    """Phone, date and identifier columns that two or more tables share and that need a patch."""
    found: dict[tuple[str, str], list[Member]] = {}
    for table, t in tables.items():
        for c in t.columns:
            if not c.signature:
                continue
            words, declared = name_words(c.name), c.declared_type.lower()
            if words & PHONE_WORDS:
                kind, label, form = "phone", label_key(c.name), c.signature
            elif "mixed_date_format" in c.issues or "date" in declared or "timestamp" in declared or words & DATE_WORDS:
                kind, label = "date", label_key(c.name)
                form = "ambiguous" if c.signature == "ambiguous" else "native_timestamp"
            elif is_identifier(c):
                kind, label, form = "id", c.name.lower(), c.signature
            else:
                continue
            found.setdefault((kind, label), []).append(Member(table, c.name, form, t.rows, c.is_primary_key, c.declared_type))
    groups = []
    for kind in ("date", "phone", "id"):
        for (k, label), members in found.items():
            if k != kind or len({m.table for m in members}) < 2:
                continue
            if kind == "date":
                canonical = majority(members, lambda f: f == "native_timestamp")
                reason = "most rows are timestamps after cleaning" if canonical == "native_timestamp" else "most rows have no certain date format"
            elif kind == "phone":
                canonical, reason = majority(members, lambda f: f.startswith("intl")), "most rows have this form"
            else:
                native = next((m for m in members if is_numeric_type(m.declared_type)), None)
                letters = any(m.form == "alnum" for m in members)
                canonical = "numeric" if native or not letters else "alnum"
                reason = f"numeric type in {native.table}" if native else ("letters in some ids" if letters else "no letters in any id")
            groups.append(Group(kind, label, canonical, reason, members))
    return [g for g in groups if g.to_patch]


def patcher(groups: list[Group], table: str) -> Callable[[Expression, ColumnProfile], Expression]:
    """A last step for a table's plan that brings its columns to their group's form."""
    mine = {m.column: (g, m) for g in groups for m in g.members if m.table == table}

    def patch(e: Expression, c: ColumnProfile) -> Expression:
        if c.name not in mine:
            return e
        g, m = mine[c.name]
        if g.kind != "id" and m.form == g.canonical:
            return e
        note = f"{g.label}: {m.form}, the group has {g.canonical}"
        sql = None
        local = m.form.startswith("local") and g.canonical.startswith("local")
        if g.kind == "phone" and local and m.form.split("_")[-1] == g.canonical.split("_")[-1]:
            # Only separators differ; a country code is never made up.
            sql = tpl.digits(tpl.as_text(c.name))
        elif g.kind == "id":
            numeric = g.canonical == "numeric" and m.form != "alnum"
            sql = tpl.identifier(tpl.as_text(c.name), numeric)
            note = note if g.canonical == "numeric" and m.form == "alnum" else None
        if sql is None:
            return Expression(e.column, e.names, e.sql, e.source, e.issues, note, e.question, e.options)
        return Expression(e.column, [c.name], [sql], "consistency", [*e.issues, f"cross_table_{g.kind}"], note)

    return patch


def summary(groups: list[Group]) -> list[dict]:
    return [{"kind": g.kind, "label": g.label, "canonical": g.canonical, "reason": g.reason, "tables_matching": g.matching, "tables_patched": g.to_patch} for g in groups]
