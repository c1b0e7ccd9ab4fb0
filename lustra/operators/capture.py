"""Target types and self-healing: find values that a cast would lose, and patch the expression."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULTS, Settings, fallback
from ..functions import templates as tpl
from ..model import Classified, ColumnClass, ColumnProfile, Expression
from ..plans import guard
from . import patterns
from .classify import name_words

# Words in names that tell a column's type; texts that are null on purpose.
DURATION_WORDS = ("hrs", "hours", "hr", "mins", "minutes", "min", "secs", "seconds", "sec", "days", "duration")
DATE_WORDS = ("date", "at", "on", "time", "timestamp", "datetime")
AMOUNT_WORDS = ("amount", "price", "cost", "revenue", "balance", "fee", "total", "salary", "rate")
BOOLEAN_WORDS = ("is_", "has_", "flag", "active", "enabled", "verified")
EXPECTED_NULLS = ("tbd", "na", "n/a", "n.a.", "null", "none", "-", "–", "—", "nan", "#n/a", "nil", "", "not available", "missing")

_EMAIL = r"\S+@\S+\.\S+"
_PHONE = r"[+\d][\d\s\-()]{7,}"
_DATE = r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}$"
_NATIVE = re.compile(r"int|numeric|decimal|float|real|double|timestamp|date|bool|long|short|byte")

Suggester = Callable[[dict], str | None]


def _boolean_name(name: str, parity: bool) -> bool:
    low = name.lower()
    if parity:
        return any(w in low for w in BOOLEAN_WORDS)
    return low.startswith(("is_", "has_")) or bool(name_words(name) & {"flag", "active", "enabled", "verified"})


def target_type(c: ColumnProfile, values: list[str], settings: Settings = DEFAULTS) -> str | None:
    """DOUBLE, TIMESTAMP, BOOLEAN, or None where no cast is called for.  ``values``: a few of the
    column's texts, in a fixed order."""
    if _NATIVE.search(c.declared_type.lower()):
        return None
    words = name_words(c.name)
    if words & set(DURATION_WORDS):
        return "DOUBLE"
    if words & set(DATE_WORDS):
        return "TIMESTAMP"
    if words & set(AMOUNT_WORDS):
        return "DOUBLE"
    if _boolean_name(c.name, settings.mode == "parity"):
        return "BOOLEAN"
    probe = [v.strip() for v in values if v is not None and v.strip()][:5]
    if not probe:
        return None
    if all(v.lower() in tpl.TRUE_WORDS + tpl.FALSE_WORDS for v in probe):
        return "BOOLEAN"
    plain = [re.sub("[,%]|" + tpl.SYMBOL_CLASS, "", v) for v in probe]
    if all(re.fullmatch(r"\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*", v) for v in plain):
        zeros = settings.mode != "parity" and (c.flags.get("leading_zero") or any(re.fullmatch(r"0\d+", v) for v in probe))
        return None if zeros else "DOUBLE"
    if all(re.match(r"\d{4}-\d{2}-\d{2}", v) or re.match(r"\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}$", v) for v in probe):
        return "TIMESTAMP"
    return None


def flags_of(c: ColumnProfile) -> tpl.Flags:
    return tpl.Flags(**{k: bool(c.flags.get(k)) for k in ("european", "magnitude", "parentheses", "leading_zero")})


def smart_base(c: ColumnProfile, target: str, settings: Settings = DEFAULTS) -> str:
    """The best deterministic expression for the target."""
    e = tpl.as_text(c.name)
    if target == "DOUBLE":
        if "currency_string" in c.issues:
            return tpl.currency(e, flags_of(c))
        if "percentage_string" in c.issues:
            return tpl.percentage(e)
        if settings.mode == "full" and "numeric_as_string" in c.issues:
            return tpl.number(e, flags_of(c))
    if settings.mode == "full" and target == "TIMESTAMP":
        return tpl.date(e, c.date_format, more=True)
    if settings.mode == "full" and target == "BOOLEAN":
        return tpl.boolean(e)
    return tpl.base_cast(e, target)


def lost_values(df: DataFrame, bases: dict[str, tuple[str, str]], limit: int = DEFAULTS.exception_limit) -> dict[str, list[str]]:
    """For each column the first ``limit`` distinct values, in order, that its expression turns to
    NULL.  ``bases``: column to (expression, target).  One job for all columns."""
    if not bases:
        return {}
    known = tpl.words(tpl.TRUE_WORDS + tpl.FALSE_WORDS)
    entries = []
    for name, (sql, target) in bases.items():
        text = tpl.as_text(name)
        lost = f"lower(trim({text})) not in ({known})" if target == "BOOLEAN" else f"({sql}) is null"
        entries.append(F.when(F.expr(f"{text} is not null and {lost}"), F.struct(F.lit(name).alias("name"), F.expr(text).alias("value"))))
    rows = df.select(F.explode(F.array_compact(F.array(*entries))).alias("x")).select("x.*").distinct()
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("value"))).filter(F.col("k") <= limit)
    out: dict[str, list[str]] = {name: [] for name in bases}
    for r in first.orderBy("name", "k").collect():
        out[r["name"]].append(r["value"])
    return out


#: Most patterns of a column's unread values; with more of them no expression is looked for.
PATTERNS = 50


def lost_patterns(df: DataFrame, bases: dict[str, tuple[str, str]]) -> dict[str, list[str]]:
    """For each column one unread value of each pattern (:func:`patterns.pattern`), over all values; none
    where there are more than ``PATTERNS``.  One job for all columns."""
    if not bases:
        return {}
    entries = [F.when(F.expr(f"{tpl.as_text(n)} is not null and ({sql}) is null"), F.struct(F.lit(n).alias("name"), F.expr(tpl.as_text(n)).alias("value"))) for n, (sql, _) in bases.items()]
    rows = df.select(F.explode(F.array_compact(F.array(*entries))).alias("x")).select("x.*")
    form = F.lower(F.trim(F.regexp_replace("value", r"\s+", " ")))
    form = F.regexp_replace(F.regexp_replace(form, ",[0-9]{3}(?![0-9])", ",#"), "[0-9]+", "9")
    each = rows.groupBy("name", form.alias("form")).agg(F.min("value").alias("value"))
    listed = each.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("form"))).filter(F.col("k") <= PATTERNS + 1)
    out: dict[str, list[str]] = {n: [] for n in bases}
    for r in listed.orderBy("name", "k").collect():
        out[r["name"]].append(r["value"])
    return {n: v if len(v) <= PATTERNS else [] for n, v in out.items()}


def is_private(value: str, target: str) -> bool:
    """Too long, or shaped like an address or a phone number."""
    if len(value) > 100 or re.search(_EMAIL, value):
        return True
    if target == "TIMESTAMP" and re.match(_DATE, value.strip()):
        return False
    return bool(re.search(_PHONE, value))


def is_expected_null(value: str) -> bool:
    return value.strip().lower() in EXPECTED_NULLS or not any(ch.isdigit() for ch in value)


def verified(df: DataFrame, column: str, sql: str, values: list[str], target: str = "DOUBLE") -> bool:
    """Whether a suggested expression reads every value that isn't null on purpose."""
    spark = df.sparkSession
    if not guard.safe_expression(spark, sql):
        return False
    try:
        table = spark.createDataFrame([(v,) for v in values], f"{tpl.quoted(column)} string")
        got = table.select(F.col(tpl.quoted(column)).alias("v"), F.expr(sql).alias("out")).collect()
    except Exception:
        return False
    if target == "BOOLEAN":
        return all(r["out"] is not None for r in got if r["v"].strip().lower() not in EXPECTED_NULLS)
    return all(r["out"] is not None for r in got if not is_expected_null(r["v"]))


def reads_alike(df: DataFrame, column: str, sql: str, values: list[str]) -> bool:
    """Whether the expression gives each value's own number."""
    table = df.sparkSession.createDataFrame([(v,) for v in values], f"{tpl.quoted(column)} string")
    got = table.select(F.col(tpl.quoted(column)).alias("v"), F.expr(sql).alias("out")).collect()
    return all(r["out"] == patterns.read(r["v"]) for r in got if not is_expected_null(r["v"]))


def expected_null(value: Column) -> Column:
    """:func:`is_expected_null` for a whole column."""
    return F.lower(F.trim(value)).isin(*EXPECTED_NULLS) | ~value.rlike("[0-9]")


def private(value: Column, target: str) -> Column:
    """:func:`is_private` for a whole column."""
    shown = F.trim(value).rlike(_DATE) if target == "TIMESTAMP" else F.lit(False)
    return (F.length(value) > 100) | value.rlike(_EMAIL) | (~shown & value.rlike(_PHONE))


def heal(df: DataFrame, classified: list[Classified], suggest: Suggester | None = None, settings: Settings = DEFAULTS) -> list[Expression]:
    """One expression for each column that may be cleaned; what can't be read leads to a patch, if
    somebody suggests one that passes, or to the deterministic expression."""
    targets: dict[str, tuple[str, str]] = {}
    counts: dict[str, int] = {}
    live = [c for c in classified if c.kind in (ColumnClass.OBSERVE, ColumnClass.CLEAN_DET, ColumnClass.CLEAN_AMBIG)]
    for c in live:
        t = target_type(c.column, c.column.sample_values, settings)
        if t:
            targets[c.column.name] = (smart_base(c.column, t, settings), t)
    if targets:
        got = df.agg(*[F.count(tpl.quoted(n)).alias(f"n{k}") for k, n in enumerate(targets)]).first()
        counts = {n: got[f"n{k}"] for k, n in enumerate(targets)}
    few = {n for n in targets if counts[n] < settings.min_values}
    lost = lost_values(df, {n: t for n, t in targets.items() if n not in few}, settings.exception_limit)
    unread = {n: targets[n] for n, v in lost.items() if v and targets[n][1] == "DOUBLE" and settings.mode == "full"}
    shapes = {n: [v for v in vs if not is_expected_null(v)] for n, vs in lost_patterns(df, unread).items()}
    out = []
    for c in live:
        p = c.column
        name = p.name
        if name not in targets:
            out.append(Expression(name, [name], [tpl.quoted(name)], "passthrough"))
            continue
        sql, target = targets[name]
        notes = []
        if len(p.currency_symbols) > 1:
            notes.append(f"several currencies ({' '.join(p.currency_symbols)}); amounts aren't converted")
        if name in few:
            out.append(Expression(name, [name], [tpl.quoted(name)], "passthrough", note=f"fewer than {settings.min_values} values"))
            continue
        source = "deterministic"
        open_ = [v for v in lost[name] if not is_private(v, target)]
        if lost[name] and not open_:
            notes.append("unread values look like personal data and are shown to nobody")
        elif open_:
            patch = None
            if suggest is not None:
                try:
                    patch = suggest({"column": name, "target": target, "base": sql, "values": open_})
                except Exception:
                    patch = None
            examples = shapes.get(name, [])
            derived = patterns.propose(name, sql, [v for v in examples if not is_private(v, target)])
            if patch and verified(df, name, patch, open_, target):
                sql, source = patch, "suggested"
            elif derived and verified(df, name, derived, open_, target) and reads_alike(df, name, derived, open_ + examples):
                sql = derived
                notes.append(f"unread values are read by pattern: {', '.join(sorted({patterns.pattern(v) for v in examples}))}")
            else:
                if not all(is_expected_null(v) for v in open_):
                    fallback(settings, f"{name}: unread values")
                    source = "deterministic_fallback"
                notes.append(f"{len(open_)} kinds of unread values become NULL")
        out.append(Expression(name, [name], [sql], source, sorted(p.issues), "; ".join(notes) or None))
    return out
