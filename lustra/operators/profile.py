"""Profiling: every fact about a table from one aggregate over the table and one over its sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULTS, Settings
from ..functions import templates as tpl
from ..model import ColumnProfile, TableProfile
from . import classify

# Names of columns that tell when a row was made, changed or deleted.
CREATED = ("created_at", "createdat", "create_date", "insert_date", "inserted_at")
UPDATED = ("updated_at", "updatedat", "update_date", "modified_at", "last_modified")
DELETED = ("deleted_at", "deletedat", "delete_date", "is_deleted", "soft_delete")
PHONE_WORDS = {"phone", "mobile", "cell", "tel", "fax", "whatsapp"}
DATE_WORDS = {"date", "time", "at", "on", "timestamp", "datetime"}

_EDGES = r"^\s+|\s+$"
_DATE_LIKE = r"^(\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|\w+ \d{1,2},? \d{4})"
_SLASH_DATE = r"^(\d{1,2})([-/.])(\d{1,2})[-/.](\d{2,4})$"
_NUMERIC = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def sync_mode(names: list[str], rows: int, primary_key: str | None, settings: Settings = DEFAULTS) -> tuple[str, str | None]:
    """How the table could be kept in step, and the column that tells changes."""
    low = {n.lower(): n for n in names}
    updated = next((low[n] for n in UPDATED if n in low), None)
    created = next((low[n] for n in CREATED if n in low), None)
    deleted = next((low[n] for n in DELETED if n in low), None)
    if deleted:
        return "delete_aware", updated or deleted
    if primary_key and updated:
        return "upsert", updated
    if rows < settings.full_resync_rows and not updated:
        return "full_resync", None
    return "append_only", created or primary_key


def full_table(df: DataFrame, table: str, primary_key: str | None = None, settings: Settings = DEFAULTS) -> TableProfile:
    """Row count and the share of nulls of every column, in one scan."""
    names = df.columns
    got = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(tpl.quoted(c)).isNull()).alias(f"c{k}") for k, c in enumerate(names)]).first()
    n = got["n"]
    columns = [
        ColumnProfile(f.name, f.dataType.simpleString(), (got[f"c{k}"] / n) if n else 0.0, is_primary_key=f.name == primary_key) for k, f in enumerate(df.schema.fields)
    ]
    mode, tracking = sync_mode(names, n, primary_key, settings)
    return TableProfile(table, n, columns, mode, primary_key, tracking)


def stripped(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), _EDGES, "")


def _share(cond: Column, of: Column) -> Column:
    return F.coalesce(F.avg(F.when(of.isNotNull(), cond.cast("double"))), F.lit(0.0))


def conditions(raw: Column) -> dict[str, Column]:
    """What a value's text looks like."""
    text = raw.cast("string")
    v = stripped(raw)
    low = F.lower(v)
    unsigned = F.regexp_replace(v, "[,%]|" + tpl.SYMBOL_CLASS, "")
    return {
        "currency_symbol": v.rlike(tpl.SYMBOL_CLASS),
        "percent_sign": v.endswith("%"),
        "null_variant": low.isin(*tpl.SENTINELS),
        "needs_trim": text != v,
        "date_like": v.rlike(_DATE_LIKE),
        "numeric_like": unsigned.rlike(_NUMERIC),
        "bare": v.rlike(_NUMERIC),
        "true": low.isin(*tpl.TRUE_WORDS),
        "false": low.isin(*tpl.FALSE_WORDS),
    }


def issue_facts(raw: Column) -> dict[str, Column]:
    """Aggregates of one column's text, by name.  Nulls don't count.  Those on distinct values keep
    sets, so use them on samples only; the ratios are fit for whole tables."""
    text = raw.cast("string")
    v = stripped(raw)
    low = F.lower(v)
    says = conditions(raw)
    symbol, percent, bare = says["currency_symbol"], says["percent_sign"], says["bare"]
    truthy, falsy = says["true"], says["false"]
    first = F.regexp_extract(v, _SLASH_DATE, 1)
    slash = v.rlike(_SLASH_DATE)
    return {
        "values": F.count(text),
        "currency_symbol_ratio": _share(symbol, text),
        "percent_sign_ratio": _share(percent, text),
        "null_variant_ratio": _share(says["null_variant"], text),
        "needs_trim_ratio": _share(says["needs_trim"], text),
        "mixed_percent_format": (F.coalesce(F.max(percent.cast("int")), F.lit(0)) * F.coalesce(F.max(bare.cast("int")), F.lit(0))).cast("double"),
        "date_like_ratio": _share(says["date_like"], text),
        "numeric_like_ratio": _share(says["numeric_like"], text),
        "exact": F.size(F.collect_set(text)),
        "distinct_values": F.size(F.collect_set(v)),
        "distinct_folded": F.size(F.collect_set(low)),
        "all_boolean": F.coalesce(F.min((truthy | falsy).cast("int")), F.lit(0)),
        "any_true": F.coalesce(F.max(truthy.cast("int")), F.lit(0)),
        "any_false": F.coalesce(F.max(falsy.cast("int")), F.lit(0)),
        "symbols": F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.regexp_extract_all(v, F.lit(f"({tpl.SYMBOL_CLASS})")))))),
        "slash_share": _share(slash, text),
        "day_first": F.coalesce(F.max(F.when(slash, (first.try_cast("int") > 12).cast("int"))), F.lit(0)),
        "month_first": F.coalesce(F.max(F.when(slash, (F.regexp_extract(v, _SLASH_DATE, 3).try_cast("int") > 12).cast("int"))), F.lit(0)),
        "separator": F.mode(F.when(slash, F.regexp_extract(v, _SLASH_DATE, 2)), True),
        "iso_share": _share(v.rlike(r"^\d{4}-\d{2}-\d{2}"), text),
        "any_letter": F.coalesce(F.max(v.rlike("[A-Za-z]").cast("int")), F.lit(0)),
        "digit_mode": F.mode(F.length(F.regexp_replace(v, r"\D", "")), True),
        "plus_share": _share(v.startswith("+"), text),
        "magnitude": F.coalesce(F.max(F.upper(v).rlike(r"[0-9.][KMB]$").cast("int")), F.lit(0)),
        "european": _share(v.rlike(r"\d,\d{1,2}\D*$"), F.when(symbol | v.rlike(r"\d"), text)),
        "parentheses": F.coalesce(F.max(v.rlike(r"^\([^()]*\)$").cast("int")), F.lit(0)),
        "leading_zero": F.coalesce(F.max(v.rlike(r"^0\d+$").cast("int")), F.lit(0)),
    }


def whole_facts(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """The facts of each column over all rows, but for the symbols.  Distinct values are counted by
    shuffle, and nothing keeps a set of them."""
    facts_of = {c: {n: v for n, v in issue_facts(F.col(tpl.quoted(c))).items() if n not in _SETS} for c in columns}
    got = df.agg(*[F.struct(*[v.alias(n) for n, v in facts_of[c].items()]).alias(f"f{k}") for k, c in enumerate(columns)]).first()
    texts = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(tpl.quoted(c)).cast("string").alias("text")) for c in columns])).alias("x")
    texts = df.select(texts).select("x.*").filter("text is not null").distinct()
    v = stripped(F.col("text"))
    counts = texts.groupBy("name").agg(F.count("*").alias("exact"), F.count_distinct(v).alias("distinct_values"), F.count_distinct(F.lower(v)).alias("distinct_folded"))
    sizes = {r["name"]: {n: r[n] for n in _SETS if n != "symbols"} for r in counts.collect()}
    return {c: got[f"f{k}"].asDict() | sizes.get(c, {"exact": 0, "distinct_values": 0, "distinct_folded": 0}) for k, c in enumerate(columns)}


#: Facts that keep sets of values.
_SETS = ("exact", "distinct_values", "distinct_folded", "symbols")
RATIOS = ("currency_symbol_ratio", "percent_sign_ratio", "null_variant_ratio", "needs_trim_ratio", "mixed_percent_format", "date_like_ratio", "numeric_like_ratio")


def issues_of(facts: dict, declared: str, distinct: int, settings: Settings = DEFAULTS) -> list[str]:
    """Presence decides, except for date and number shapes, which need a share of the values."""
    if not facts["values"]:
        return []
    found = []
    if facts["currency_symbol_ratio"] > 0:
        found.append("currency_string")
    if facts["percent_sign_ratio"] > 0 or facts["mixed_percent_format"] > 0:
        found.append("percentage_string")
    if facts["null_variant_ratio"] > 0:
        found.append("null_variant")
    if facts["needs_trim_ratio"] > 0:
        found.append("needs_trim")
    if distinct < settings.casing_distinct and facts["distinct_values"] > facts["distinct_folded"]:
        found.append("inconsistent_casing")
    if classify.is_text(declared):
        if distinct <= 2 and facts["all_boolean"] and facts["any_true"] and facts["any_false"]:
            found.append("inconsistent_boolean")
        if facts["date_like_ratio"] > settings.like_share:
            found.append("mixed_date_format")
        elif facts["numeric_like_ratio"] > settings.like_share:
            found.append("numeric_as_string")
    return found


def date_format_of(facts: dict, settings: Settings = DEFAULTS) -> str | None:
    """One format for the column if the evidence points one way."""
    if not facts["values"] or facts["slash_share"] < settings.slash_date_share or facts["day_first"] == facts["month_first"]:
        return None
    s = facts["separator"]
    return f"%d{s}%m{s}%Y" if facts["day_first"] else f"%m{s}%d{s}%Y"


def signature_of(c: ColumnProfile, facts: dict, settings: Settings = DEFAULTS) -> str | None:
    """The form of a phone, identifier or date column; the name decides which of them it is."""
    words = classify.name_words(c.name)
    declared = c.declared_type.lower()
    if words & PHONE_WORDS:
        if not facts["values"]:
            return None
        return f"{'intl' if facts['plus_share'] > settings.intl_share else 'local'}_{facts['digit_mode']}d"
    if classify.is_identifier(c):
        if any(t in declared for t in ("int", "numeric", "decimal", "serial")):
            return "numeric"
        if not facts["values"]:
            return None
        return "alnum" if facts["any_letter"] else "numeric"
    if "timestamp" in declared or "date" in declared:
        return "native_timestamp"
    if not facts["values"]:
        return None
    if facts["iso_share"] > settings.iso_share:
        return "%Y-%m-%d"
    found = date_format_of(facts, settings)
    if found:
        return found
    return "ambiguous" if "mixed_date_format" in c.issues else None


def _groupable(df: DataFrame) -> DataFrame:
    """Nested values as JSON, which can be compared."""
    nested = (T.MapType, T.StructType, T.ArrayType)
    return df.select(*[F.to_json(tpl.quoted(f.name)).alias(f.name) if isinstance(f.dataType, nested) else F.col(tpl.quoted(f.name)) for f in df.schema.fields])


def enrich(profile: TableProfile, sample: DataFrame, settings: Settings = DEFAULTS) -> TableProfile:
    """Facts from the sample, all columns in one job.  Personal, key and structured columns get a
    format signature and nothing that shows their values."""
    sample = _groupable(sample)
    facts_of = {c.name: issue_facts(F.col(tpl.quoted(c.name))) for c in profile.columns}
    exprs = [F.struct(*[v.alias(k) for k, v in facts_of[c.name].items()]).alias(f"f{k}") for k, c in enumerate(profile.columns)]
    got = sample.agg(F.count("*").alias("n"), *exprs).first()
    candidates = set(classify.needs_values(profile))
    from .sample import diverse_values

    values = diverse_values(sample, [c.name for c in profile.columns if c.name in candidates], settings.sample_values)
    for k, c in enumerate(profile.columns):
        facts = got[f"f{k}"].asDict()
        c.distinct_count = facts["exact"]
        c.distinct_ratio = facts["exact"] / got["n"] if got["n"] else 0.0
        if c.name in candidates:
            c.issues = issues_of(facts, c.declared_type, c.distinct_count, settings)
            c.issue_ratios = {r: float(facts[r]) for r in RATIOS} if facts["values"] else {}
            c.currency_symbols = list(facts["symbols"]) if len(facts["symbols"]) > 1 else []
            c.date_format = date_format_of(facts, settings)
            c.sentinel_pct = float(facts["null_variant_ratio"])
            c.sample_values = values.get(c.name, [])
            c.flags = {"european": facts["european"] > 0.5, "magnitude": bool(facts["magnitude"]), "parentheses": bool(facts["parentheses"]), "leading_zero": bool(facts["leading_zero"])}
        c.signature = signature_of(c, facts, settings)
    return profile
