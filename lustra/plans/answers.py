"""Questions for people, and what their answers compile to."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings, fallback
from ..functions import templates as tpl
from ..model import Classified, ColumnClass, ColumnProfile, Expression
from ..operators.capture import flags_of
from . import compile as compiling
from . import guard


def option_id(text: str) -> str:
    """A label in lower case, its words joined."""
    return "_".join(text.lower().split()) or "option"


CURRENCY_OPTIONS = ["split", "keep", "assume_same", "custom"]
DATE_OPTIONS = ["month_first", "day_first", "custom"]
PERCENT_OPTIONS = ["fraction", "percent", "custom"]


def questions(classified: list[Classified]) -> list[dict]:
    """One for each column with more than one reading."""
    out = []
    for c in classified:
        if c.kind is not ColumnClass.CLEAN_AMBIG:
            continue
        p = c.column
        if len(p.currency_symbols) > 1:
            out.append({"column": p.name, "question": f"Values use {' '.join(p.currency_symbols)}. How should amounts be kept?", "options": CURRENCY_OPTIONS})
        else:
            out.append({"column": p.name, "question": "Dates can be read month first or day first. Which is it?", "options": DATE_OPTIONS})
    return out


def source_of(expressions: list[Expression]) -> str:
    """Where a plan as a whole comes from: suggested, deterministic_fallback or deterministic."""
    sources = {e.source for e in expressions}
    return next((s for s in ("suggested", "deterministic_fallback") if s in sources), "deterministic")


def asked(expressions: list[Expression]) -> list[dict]:
    """The questions that expressions bring along; the first option is the default."""
    out = []
    for e in expressions:
        if e.question:
            options = [{"id": option_id(o), "label": o} for o in e.options or ["Leave as text"]]
            out.append({"column": e.column, "question": e.question, "options": options, "default": options[0]["id"]})
    return out


def is_known(answer: str) -> bool:
    """Whether an answer compiles by itself, without a suggestion."""
    return answer in {*CURRENCY_OPTIONS, *DATE_OPTIONS, *PERCENT_OPTIONS} - {"custom"}


def resolve(sample: DataFrame, columns: list[ColumnProfile], propose: Callable[[list[dict]], dict[str, str]] | None, batch: int = 8, settings: Settings = DEFAULTS) -> list[Expression]:
    """One expression for each column, whatever is proposed.  Columns are put forward ``batch`` at a
    time; a proposal counts if it is safe and runs on the sample, and otherwise, or if a whole batch
    fails, the column's deterministic expression stands in."""
    out = []
    for at in range(0, len(columns), batch):
        part = columns[at : at + batch]
        try:
            given = propose([{"column": c.name, "type": c.declared_type, "issues": sorted(c.issues), "values": c.sample_values} for c in part]) if propose else {}
        except Exception:
            given = {}
        for c in part:
            sql = given.get(c.name)
            if sql and guard.safe_expression(sample.sparkSession, sql) and _runs(sample, sql):
                out.append(Expression(c.name, [c.name], [sql], "suggested", sorted(c.issues)))
                continue
            e = compiling.deterministic(c)
            if propose:
                fallback(settings, f"{c.name}: no usable proposal")
                e.source = "deterministic_fallback"
            out.append(e)
    return out


def _runs(sample: DataFrame, sql: str) -> bool:
    try:
        sample.limit(100).select(F.expr(sql).alias("x")).agg(F.count("x")).collect()
        return True
    except Exception:
        return False


def apply_answer(c: ColumnProfile, answer: str, parity: bool = False, settings: Settings = DEFAULTS) -> Expression | None:
    """The expression that an answer stands for; None: leave the plan as it is.  Unknown answers
    give the deterministic expression as a fallback, with the answer as a note; strict mode raises."""
    e = tpl.as_text(c.name)
    name = c.name
    separator = next((s for v in c.sample_values for s in re.findall(r"^\d{1,2}([-/.])\d", v.strip())), "/")
    if answer == "split":
        if parity:
            amount = rf"try_cast(regexp_replace({e}, r'[^0-9.\-]', '') as double)"
            code = tpl.first_symbol(e)
        else:
            amount, code = tpl.currency(e, flags_of(c)), tpl.currency_code(e)
        return Expression(name, [f"{name}_amount", f"{name}_currency"], [amount, code], "answer", sorted(c.issues))
    if answer == "keep":
        return compiling.passthrough(c, "kept as text")
    if answer == "assume_same":
        return None
    if answer in ("month_first", "day_first"):
        form = "%m{0}%d{0}%Y" if answer == "month_first" else "%d{0}%m{0}%Y"
        return Expression(name, [name], [tpl.parsed_date(f"trim({e})", form.format(separator))], "answer", sorted(c.issues))
    if answer in ("fraction", "percent"):
        return Expression(name, [name], [tpl.fraction_answer(e, answer == "percent")], "answer", sorted(c.issues))
    fallback(settings, f"{name}: answer {answer!r}")
    out = compiling.deterministic(c)
    out.note, out.source = answer, "deterministic_fallback"
    return out
