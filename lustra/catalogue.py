"""The registered queries of the cleaning engine, and the same in DuckDB SQL."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import templates as tpl
from .messy import duck, messy
from .model import Classified, CleaningPlan, ColumnClass, ColumnProfile, Expression, Group, Member, TableProfile
from .operators import capture, classify, consistency, profile, rowdiff, sample
from .pipeline import Engine
from .plans import answers, dryrun, guard, materialize
from .plans import compile as compiling
from .plans.materialize import Cache
from .sources.tables import Source, TableNotFound
from .streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


def _query(oracle: str | None = None):
    def add(f: Query) -> Query:
        _register(f.__name__, f, oracle)
        return f

    return add


# DuckDB's side of the templates.

_SENTINEL = "lower(trim({0})) IN ('n/a', 'na', 'null', 'none', '-', '–', '—', '', 'nan', '#n/a')"
_SYMBOLS = "[" + "".join(tpl.CURRENCIES) + "]"
_NUM = r"TRY_CAST(regexp_replace({0}, '[^0-9.\-]', '', 'g') AS DOUBLE)"
_EU = r"TRY_CAST(replace(replace(regexp_replace({0}, '[^0-9.,\-]', '', 'g'), '.', ''), ',', '.') AS DOUBLE)"
_WHOLE = r"(CASE WHEN regexp_full_match(trim({0}), '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(trim({0}) AS DOUBLE) END)"


def _d(template: str, column: str) -> str:
    return template.replace("{0}", column)


def _d_magnitude(c: str) -> str:
    n = _d(_NUM, c)
    return f"({n} * (CASE right(upper(trim({c})), 1) WHEN 'B' THEN 1e9 WHEN 'M' THEN 1e6 WHEN 'K' THEN 1e3 ELSE 1 END))"


def _d_currency(c: str, number: str, parentheses: bool = True) -> str:
    minus = rf" WHEN regexp_full_match({c}, '\([^()]*\)') THEN -1 * {number}" if parentheses else ""
    return f"CASE WHEN {_d(_SENTINEL, c)} THEN NULL WHEN upper(trim({c})) = 'FREE' THEN 0.0::DOUBLE{minus} ELSE {number} END"


def _d_percent(c: str) -> str:
    n = _d(_NUM, c)
    return f"CASE WHEN {_d(_SENTINEL, c)} THEN NULL WHEN contains({c}, '%') OR abs({n}) > 1 THEN {n} / 100.0::DOUBLE ELSE {n} END"


_STAMP = r"(CASE WHEN regexp_full_match({0}, '\s*[0-9]{1,6}[-/][0-9]{1,2}[-/][0-9]{1,2}([ T].*)?\s*') THEN TRY_CAST(trim({0}) AS TIMESTAMP) END)"


def _d_date(c: str, form: str | None = None) -> str:
    n = _d(_WHOLE, c)
    arms = [_d(_STAMP, c)] + ([f"try_strptime({c}, '{form}')"] if form else [])
    arms += [f"try_strptime({c}, '{f}')" for f in ("%b %d %Y", "%B %d %Y")]
    arms.append(f"(CASE WHEN round({n}) BETWEEN 0 AND 4102444800 THEN epoch_ms((round({n}) * 1000)::BIGINT) END)")
    arms.append(f"(CASE WHEN {n} BETWEEN 20000 AND 60000 THEN (DATE '1899-12-30' + CAST({n} AS INTEGER))::TIMESTAMP END)")
    return f"coalesce({', '.join(arms)})"


def _d_boolean(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) IN ('y', 'yes', 'true', '1', 't') THEN TRUE WHEN lower(trim({c})) IN ('n', 'no', 'false', '0', 'f') THEN FALSE END"


def _d_plain_boolean(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) IN ('t', 'true', 'y', 'yes', '1') THEN TRUE WHEN lower(trim({c})) IN ('f', 'false', 'n', 'no', '0') THEN FALSE END"


# Expressions: key, column and the two texts.

_US = tpl.Flags(parentheses=True)
_MAG = tpl.Flags(parentheses=True, magnitude=True)
_EUF = tpl.Flags(european=True)
_EXPRESSIONS: list[tuple[str, str, str, str, str, str]] = [
    ("clean_currency_us", "messy_orders", "order_id", "order_value", tpl.currency("`order_value`", _US), _d_currency("order_value", _d(_NUM, "order_value"))),
    ("clean_magnitude", "messy_orders", "order_id", "order_value", tpl.currency("`order_value`", _MAG), _d_currency("order_value", _d_magnitude("order_value"))),
    ("clean_parens_negative", "messy_customer", "customer_id", "account_balance", tpl.currency("`account_balance`", _US), _d_currency("account_balance", _d(_NUM, "account_balance"))),
    ("clean_currency_eu", "messy_part", "product_id", "price_eu", tpl.currency("`price_eu`", _EUF), _d_currency("price_eu", _d(_EU, "price_eu"), False)),
    ("clean_percentage", "messy_orders", "order_id", "discount_pct", tpl.percentage("`discount_pct`"), _d_percent("discount_pct")),
    ("clean_margin", "messy_part", "product_id", "margin_pct", tpl.percentage("`margin_pct`"), _d_percent("margin_pct")),
    ("clean_boolean", "messy_orders", "order_id", "is_returned", tpl.boolean("`is_returned`"), _d_boolean("is_returned")),
    ("clean_date", "messy_orders", "order_id", "order_date", tpl.date("`order_date`", "%d/%m/%Y"), _d_date("order_date", "%d/%m/%Y")),
    ("clean_numeric_string", "messy_part", "product_id", "weight_txt", tpl.numeric_text("`weight_txt`"), _d(_NUM, "weight_txt")),
    ("keep_leading_zero", "messy_part", "product_id", "card_code", tpl.numeric_text("`card_code`", tpl.Flags(leading_zero=True)), "card_code"),
    ("clean_null_variant", "messy_orders", "order_id", "priority", tpl.null_variant("`priority`"), f"CASE WHEN NOT ({_d(_SENTINEL, 'priority')}) THEN priority END"),
    ("clean_trim", "messy_orders", "order_id", "priority", tpl.trimmed("`priority`"), "trim(priority)"),
    ("clean_casing", "messy_orders", "order_id", "priority", tpl.lowered("`priority`"), "lower(trim(priority))"),
    ("layered_issues", "messy_orders", "order_id", "priority", compiling.deterministic(ColumnProfile("priority", "string", issues=["needs_trim", "null_variant", "inconsistent_casing"])).sql[0], f"CASE WHEN NOT ({_d(_SENTINEL, 'priority')}) THEN lower(trim(priority)) END"),
    ("answer_mdy", "messy_customer", "customer_id", "signup_date", tpl.parsed_date("trim(`signup_date`)", "%m/%d/%Y"), "try_strptime(trim(signup_date), '%m/%d/%Y')"),
    ("answer_dmy", "messy_customer", "customer_id", "signup_date", tpl.parsed_date("trim(`signup_date`)", "%d/%m/%Y"), "try_strptime(trim(signup_date), '%d/%m/%Y')"),
    ("answer_fraction", "messy_orders", "order_id", "discount_pct", tpl.fraction_answer("`discount_pct`", False), _d(_WHOLE, "discount_pct")),
    ("answer_percent", "messy_orders", "order_id", "discount_pct", tpl.fraction_answer("`discount_pct`", True), f"{_d(_WHOLE, 'discount_pct')} / 100.0::DOUBLE"),
    ("base_cast_double", "messy_orders", "order_id", "discount_pct", tpl.plain_double("`discount_pct`"), _d(_WHOLE, "discount_pct")),
    ("base_cast_timestamp", "messy_orders", "order_id", "order_date", tpl.plain_timestamp("`order_date`"), f"CASE WHEN regexp_full_match(order_date, '[0-9]+-[0-9]+-[0-9]+') THEN TRY_CAST(order_date AS TIMESTAMP) END"),
    ("base_cast_boolean", "messy_orders", "order_id", "is_returned", tpl.plain_boolean("`is_returned`"), _d_plain_boolean("is_returned")),
    ("phone_strip", "messy_customer", "customer_id", "phone_number", tpl.digits("`phone_number`"), "regexp_replace(phone_number, '[^0-9]', '', 'g')"),
    ("id_zero_strip", "messy_customer", "customer_id", "nation_code", tpl.identifier("`nation_code`", True), r"regexp_replace(trim(nation_code), '^0+([0-9])', '\1')"),
    ("id_trim_alnum", "messy_customer", "customer_id", "rep_key", tpl.identifier("`rep_key`", False), "trim(rep_key)"),
    ("currency_code", "messy_customer", "customer_id", "account_balance", tpl.currency_code("`account_balance`"), f"CASE regexp_extract(account_balance, '{_SYMBOLS}') WHEN '£' THEN 'GBP' WHEN '€' THEN 'EUR' ELSE 'USD' END"),
    ("null_vs_empty", "messy_customer", "customer_id", "tier", "case when `tier` is null then 'null' when `tier` = '' then 'empty' else 'value' end", "CASE WHEN tier IS NULL THEN 'null' WHEN tier = '' THEN 'empty' ELSE 'value' END"),
]

for _name, _table, _key, _column, _spark, _duck in _EXPRESSIONS:
    _register(
        _name,
        lambda spark, sf, t=_table, k=_key, c=_column, e=_spark: messy(spark, sf, t).selectExpr(k, f"{c} AS raw", f"{e} AS cleaned"),
        duck(_table) + f"SELECT {_key}, {_column} AS raw, {_duck} AS cleaned FROM {_table}",
    )


@_query(duck("messy_customer") + f"SELECT customer_id, {_d(_NUM, 'account_balance')} AS balance_amount, regexp_extract(account_balance, '{_SYMBOLS}') AS balance_currency FROM messy_customer")
def split_amount_currency(spark: SparkSession, sf: str) -> DataFrame:
    c = ColumnProfile("account_balance", "string", issues=["currency_string"])
    e = answers.apply_answer(c, "split", parity=True)
    return messy(spark, sf, "messy_customer").selectExpr("customer_id", f"{e.sql[0]} AS balance_amount", f"{e.sql[1]} AS balance_currency")


@_query(duck("messy_part") + f"SELECT product_id, {_d_percent('margin_pct')} AS margin, {_d_currency('price_eu', _d(_EU, 'price_eu'), False)} AS price FROM messy_part")
def smart_base(spark: SparkSession, sf: str) -> DataFrame:
    margin = capture.smart_base(ColumnProfile("margin_pct", "string", issues=["percentage_string"]), "DOUBLE")
    price = capture.smart_base(ColumnProfile("price_eu", "string", issues=["currency_string"], flags={"european": True}), "DOUBLE")
    return messy(spark, sf, "messy_part").selectExpr("product_id", f"{margin} AS margin", f"{price} AS price")


# The flagship: a whole plan.

ORDERS_PLAN = CleaningPlan(
    "messy_orders",
    [
        Expression("order_id", ["order_id"], ["`order_id`"]),
        Expression("customer_id", ["customer_id"], ["`customer_id`"]),
        Expression("order_value", ["order_value"], [tpl.currency("`order_value`", _MAG)], "deterministic"),
        Expression("discount_pct", ["discount_pct"], [tpl.percentage("`discount_pct`")], "deterministic"),
        Expression("order_date", ["order_date"], [tpl.date("`order_date`", "%d/%m/%Y")], "deterministic"),
        Expression("is_returned", ["is_returned"], [tpl.boolean("`is_returned`")], "deterministic"),
        Expression("priority", ["priority"], [tpl.lowered(tpl.trimmed(tpl.null_variant("`priority`")))], "deterministic"),
        Expression("ticket_code", ["ticket_code"], [tpl.identifier("`ticket_code`", True)], "consistency"),
    ],
)
_CLEAN = f"""SELECT order_id, customer_id, {_d_currency('order_value', _d_magnitude('order_value'))} AS order_value, {_d_percent('discount_pct')} AS discount_pct,
  {_d_date('order_date', '%d/%m/%Y')} AS order_date, {_d_boolean('is_returned')} AS is_returned,
  CASE WHEN NOT ({_d(_SENTINEL, 'priority')}) THEN lower(trim(priority)) END AS priority, regexp_replace(trim(ticket_code), '^0+([0-9])', '\\1') AS ticket_code FROM messy_orders"""
_BOTH = duck("messy_orders") + f", cleaned AS ({_CLEAN}) "
COLUMNS = ["order_id", "customer_id", "order_value", "discount_pct", "order_date", "is_returned", "priority", "ticket_code"]


def sql_of_cleaned() -> str:
    """WITH messy_orders and cleaned: the orders before and after the whole plan."""
    return _BOTH


def _cleaned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    raw = messy(spark, sf, "messy_orders")
    return raw, compiling.apply(ORDERS_PLAN, raw)


@_query(_BOTH + "SELECT * FROM cleaned")
def clean_orders(spark: SparkSession, sf: str) -> DataFrame:
    guard.validate(spark, compiling.assemble(ORDERS_PLAN), "messy_orders")
    return _cleaned(spark, sf)[1]


# Profiles.


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _long(spark: SparkSession, wide: DataFrame, names: list[str]) -> DataFrame:
    """One aggregated row, turned into a row per column without leaving Spark."""
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(f"f{k}").alias("x")) for k, n in enumerate(names)])).alias("r")).select("r.column_name", "r.x.*")


@_query(duck("messy_orders") + "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*)::BIGINT AS n_rows, count_if({c} IS NULL)::BIGINT AS n_nulls, CASE WHEN count(*) = 0 THEN 0.0 ELSE count_if({c} IS NULL)::DOUBLE / count(*)::DOUBLE END::DOUBLE AS null_pct FROM messy_orders" for c in COLUMNS) + ")")
def profile_nulls(spark: SparkSession, sf: str) -> DataFrame:
    t = profile.full_table(messy(spark, sf, "messy_orders"), "messy_orders", "order_id")
    return frame(spark, [(c.name, t.rows, round(c.null_pct * t.rows), c.null_pct) for c in t.columns], "column_name string, n_rows long, n_nulls long, null_pct double")


@_query("SELECT 'lineitem' AS table_name, count(*)::BIGINT AS n_rows FROM lineitem UNION ALL SELECT 'events', count(*)::BIGINT FROM events UNION ALL SELECT 'orders', count(*)::BIGINT FROM orders")
def profile_rowcount(spark: SparkSession, sf: str) -> DataFrame:
    names = ("lineitem", "events", "orders")
    return frame(spark, [(t, profile.full_table(spark.read.parquet(f"{sf}/{t}.parquet"), t).rows) for t in names], "table_name string, n_rows long")


@_query("SELECT count(DISTINCT event_type)::BIGINT AS d_event_type, count(DISTINCT user_id)::BIGINT AS d_user_id, count(DISTINCT user_id)::DOUBLE / count(*)::DOUBLE AS user_ratio FROM events")
def profile_distinct(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "user_id")
    facts, n = profile.whole_facts(e, e.columns), profile.full_table(e, "events").rows
    users = facts["user_id"]["exact"]
    return frame(spark, [(facts["event_type"]["exact"], users, users / n)], "d_event_type long, d_user_id long, user_ratio double")


def _d_facts(c: str) -> str:
    v = rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    num = r"'[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?'"
    share = lambda cond: f"coalesce(avg(CASE WHEN {c} IS NOT NULL THEN ({cond})::INT::DOUBLE END), 0.0)::DOUBLE"
    return f"""SELECT '{c}' AS column_name, {share(f"regexp_matches({v}, '{_SYMBOLS}')")} AS currency_symbol_ratio, {share(f"suffix({v}, '%')")} AS percent_sign_ratio,
      {share(f"lower({v}) IN ('n/a','na','null','none','-','–','—','','nan','#n/a')")} AS null_variant_ratio, {share(f"{c} <> {v}")} AS needs_trim_ratio,
      (coalesce(max(suffix({v}, '%')::INT), 0) * coalesce(max(regexp_full_match({v}, {num})::INT), 0))::DOUBLE AS mixed_percent_format,
      {share(f"regexp_matches({v}, '^([0-9]{{1,4}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,4}}|[0-9A-Za-z_]+ [0-9]{{1,2}},? [0-9]{{4}})')")} AS date_like_ratio,
      {share(f"regexp_full_match(regexp_replace({v}, '[,%]|{_SYMBOLS}', '', 'g'), {num})")} AS numeric_like_ratio FROM messy_orders"""


def sql_of_ratios(c: str, ratios: tuple[str, ...]) -> str:
    """Rows, nulls and shares of one column of messy_orders."""
    return f"SELECT column_name, (SELECT count(*) FROM messy_orders)::BIGINT AS n_rows, (SELECT count_if({c} IS NULL) FROM messy_orders)::BIGINT AS n_nulls, {', '.join(f'{r}_ratio' for r in ratios)}, TRUE AS close FROM ({_d_facts(c)})"


_TEXTS = ["order_value", "discount_pct", "order_date", "is_returned", "priority", "ticket_code"]


@_query(duck("messy_orders") + " UNION ALL ".join(_d_facts(c) for c in _TEXTS))
def issue_ratios(spark: SparkSession, sf: str) -> DataFrame:
    aggs = []
    for k, c in enumerate(_TEXTS):
        facts = profile.issue_facts(F.col(c))
        aggs.append(F.struct(*[facts[r].alias(r) for r in profile.RATIOS]).alias(f"f{k}"))
    return _long(spark, messy(spark, sf, "messy_orders").agg(*aggs), _TEXTS)


def _d_issues(c: str) -> str:
    v = rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    truthy, falsy = (f"lower({v}) IN ({', '.join(repr(w) for w in ws)})" for ws in (tpl.TRUE_WORDS, tpl.FALSE_WORDS))
    say = lambda cond, issue: f"CASE WHEN {cond} THEN '{issue}' END"
    found = [
        say("currency_symbol_ratio > 0", "currency_string"),
        say("n <= 2 AND every AND yes AND no", "inconsistent_boolean"),
        say("n < 20 AND nv > nl", "inconsistent_casing"),
        say("date_like_ratio > 0.1", "mixed_date_format"),
        say("needs_trim_ratio > 0", "needs_trim"),
        say("null_variant_ratio > 0", "null_variant"),
        say("date_like_ratio <= 0.1 AND numeric_like_ratio > 0.1", "numeric_as_string"),
        say("percent_sign_ratio > 0 OR mixed_percent_format > 0", "percentage_string"),
    ]
    return f"""SELECT column_name, concat_ws(',', {', '.join(found)}) AS issues FROM ({_d_facts(c)}),
      (SELECT count(DISTINCT {c}) AS n, count(DISTINCT {v}) AS nv, count(DISTINCT lower({v})) AS nl, bool_and({truthy} OR {falsy}) AS every, bool_or({truthy}) AS yes, bool_or({falsy}) AS no FROM messy_orders)"""


@_query(duck("messy_orders") + " UNION ALL ".join(_d_issues(c) for c in _TEXTS))
def detect_issues(spark: SparkSession, sf: str) -> DataFrame:
    facts = profile.whole_facts(messy(spark, sf, "messy_orders"), _TEXTS)
    rows = [(c, ",".join(sorted(profile.issues_of(facts[c], "string", facts[c]["exact"])))) for c in _TEXTS]
    return frame(spark, rows, "column_name string, issues string")


@_query(duck("messy_orders") + f"SELECT avg(CASE WHEN priority IS NOT NULL THEN ({_d(_SENTINEL, 'priority')})::INT::DOUBLE END) AS sentinel_pct FROM messy_orders")
def sentinel_pct(spark: SparkSession, sf: str) -> DataFrame:
    return messy(spark, sf, "messy_orders").agg(profile.issue_facts(F.col("priority"))["null_variant_ratio"].alias("sentinel_pct"))


@_query(duck("messy_customer") + f"SELECT string_agg(s, ',' ORDER BY s) AS symbols FROM (SELECT DISTINCT unnest(regexp_extract_all(account_balance, '{_SYMBOLS}')) AS s FROM messy_customer)")
def currency_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return messy(spark, sf, "messy_customer").agg(F.array_join(profile.issue_facts(F.col("account_balance"))["symbols"], ",").alias("symbols"))


@_query(duck("messy_orders") + r""", p AS (SELECT regexp_extract(trim(order_date), '^([0-9]{1,2})([-/.])([0-9]{1,2})[-/.]([0-9]{2,4})$', 1) AS a, regexp_extract(trim(order_date), '^([0-9]{1,2})([-/.])([0-9]{1,2})[-/.]([0-9]{2,4})$', 2) AS s,
  regexp_extract(trim(order_date), '^([0-9]{1,2})([-/.])([0-9]{1,2})[-/.]([0-9]{2,4})$', 3) AS b FROM messy_orders WHERE order_date IS NOT NULL)
  SELECT avg((a <> '')::INT::DOUBLE) AS slash_share, coalesce(max((TRY_CAST(a AS INT) > 12)::INT), 0)::INT AS day_first, coalesce(max((TRY_CAST(b AS INT) > 12)::INT), 0)::INT AS month_first, mode(s) FILTER (s <> '') AS separator FROM p""")
def date_format_evidence(spark: SparkSession, sf: str) -> DataFrame:
    facts = profile.issue_facts(F.col("order_date"))
    return messy(spark, sf, "messy_orders").agg(*[facts[k].alias(k) for k in ("slash_share", "day_first", "month_first", "separator")])


def _signature(spark: SparkSession, sf: str, column: str) -> str | None:
    df = messy(spark, sf, "messy_customer").select(column)
    facts = profile.whole_facts(df, [column])[column]
    c = ColumnProfile(column, df.schema[column].dataType.simpleString())
    c.issues = profile.issues_of(facts, c.declared_type, facts["exact"])
    return profile.signature_of(c, facts)


@_query(duck("messy_customer") + """, d AS (SELECT length(regexp_replace(phone_number, '[^0-9]', '', 'g')) AS n, (phone_number LIKE '+%')::INT::DOUBLE AS plus FROM messy_customer),
  m AS (SELECT n FROM d GROUP BY n ORDER BY count(*) DESC, n LIMIT 1)
  SELECT concat(CASE WHEN (SELECT avg(plus) FROM d) > 0.5 THEN 'intl' ELSE 'local' END, '_', n::VARCHAR, 'd') AS signature FROM m""")
def phone_signature(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, [(_signature(spark, sf, "phone_number"),)], "signature string")


@_query(duck("messy_customer") + "SELECT CASE WHEN max(regexp_matches(rep_key, '[A-Za-z]')::INT) = 1 THEN 'alnum' ELSE 'numeric' END AS rep_key, CASE WHEN max(regexp_matches(nation_code, '[A-Za-z]')::INT) = 1 THEN 'alnum' ELSE 'numeric' END AS nation_code FROM messy_customer")
def id_signature(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, [(_signature(spark, sf, "rep_key"), _signature(spark, sf, "nation_code"))], "rep_key string, nation_code string")


@_query(duck("messy_customer") + r""", p AS (SELECT regexp_matches(trim(signup_date), '^[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}$') AS slash, TRY_CAST(split_part(trim(signup_date), '/', 1) AS INT) AS a, TRY_CAST(split_part(trim(signup_date), '/', 2) AS INT) AS b FROM messy_customer WHERE signup_date IS NOT NULL)
  SELECT 'signup_date' AS column_name, CASE WHEN avg(slash::INT) >= 0.5 AND coalesce(bool_or(slash AND a > 12), FALSE) <> coalesce(bool_or(slash AND b > 12), FALSE)
    THEN CASE WHEN bool_or(slash AND a > 12) THEN '%d/%m/%Y' ELSE '%m/%d/%Y' END WHEN avg(slash::INT) > 0.1 THEN 'ambiguous' END AS signature FROM p""")
def date_signature(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, [("signup_date", _signature(spark, sf, "signup_date"))], "column_name string, signature string")


# Samples.

_RAW = ", ".join(COLUMNS)


@_query(duck("messy_orders") + f"SELECT {_RAW} FROM messy_orders ORDER BY md5(order_id::VARCHAR), order_id LIMIT 400")
def sample_hash_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return sample.baseline(messy(spark, sf, "messy_orders"), "order_id", 400)


@_query(duck("messy_orders") + f"SELECT {_RAW} FROM messy_orders WHERE is_returned IS NULL ORDER BY md5(order_id::VARCHAR), order_id LIMIT 10")
def sample_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return sample.null_rows(messy(spark, sf, "messy_orders"), "is_returned", "order_id", 10)


@_query("SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, md5(o_orderkey::VARCHAR) LIMIT 20) UNION ALL SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, md5(o_orderkey::VARCHAR) LIMIT 20)")
def sample_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    return sample.boundaries(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 20)


@_query(duck("messy_orders") + f"SELECT * FROM (SELECT {_RAW} FROM messy_orders ORDER BY order_id LIMIT 20) UNION ALL SELECT * FROM (SELECT {_RAW} FROM messy_orders ORDER BY order_id DESC LIMIT 20)")
def sample_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    return sample.endpoints(messy(spark, sf, "messy_orders"), "order_id", 20)


@_query(duck("messy_orders") + f""", k AS (SELECT * FROM (SELECT order_id FROM messy_orders ORDER BY md5(order_id::VARCHAR) LIMIT 400)
  {"".join(f" UNION SELECT * FROM (SELECT order_id FROM messy_orders WHERE {c} IS NULL ORDER BY md5(order_id::VARCHAR) LIMIT 10)" for c in COLUMNS)}
  {"".join(f" UNION SELECT * FROM (SELECT order_id FROM messy_orders ORDER BY {c} {d}, md5(order_id::VARCHAR) LIMIT 20)" for c in ("order_id", "customer_id") for d in ("ASC", "DESC"))})
  SELECT {_RAW} FROM messy_orders WHERE order_id IN (SELECT order_id FROM k)""")
def sample_stratified(spark: SparkSession, sf: str) -> DataFrame:
    df = messy(spark, sf, "messy_orders")
    return sample.stratified(df, profile.full_table(df, "messy_orders", "order_id"))


@_query(duck("messy_orders") + """, v AS (SELECT priority AS value, min(md5(priority)) AS pos FROM messy_orders WHERE priority IS NOT NULL GROUP BY priority),
  r AS (SELECT *, row_number() OVER (ORDER BY length(value) DESC, pos) AS a, row_number() OVER (ORDER BY length(value), pos) AS b FROM v),
  t AS (SELECT *, CASE WHEN a = 1 THEN 0 WHEN b = 1 THEN 1 ELSE 2 END AS tier FROM r),
  p AS (SELECT value, row_number() OVER (ORDER BY tier, CASE WHEN tier < 2 OR regexp_matches(value, '[^A-Za-z0-9]') THEN 0 ELSE 1 END, pos) AS place FROM t)
  SELECT value, place::INT AS place FROM p WHERE place <= 10""")
def diverse_sample_values(spark: SparkSession, sf: str) -> DataFrame:
    v = messy(spark, sf, "messy_orders").filter("priority is not null").groupBy(F.col("priority").alias("value")).agg(F.min(F.md5("priority")).alias("pos")).withColumn("name", F.lit("priority"))
    return sample.value_ranks(v, 10).select("value", F.col("place").cast("int").alias("place"))


# Captures.


@_query(duck("messy_orders") + f"SELECT 'order_date' AS column_name, value FROM (SELECT DISTINCT order_date AS value FROM messy_orders WHERE order_date IS NOT NULL AND {_d(_WHOLE, 'order_date')} IS NULL ORDER BY value LIMIT 20)")
def exception_capture(spark: SparkSession, sf: str) -> DataFrame:
    got = capture.lost_values(messy(spark, sf, "messy_orders"), {"order_date": (tpl.plain_double("`order_date`"), "DOUBLE")})
    return frame(spark, [(c, v) for c, vs in got.items() for v in vs], "column_name string, value string")


@_query(duck("messy_orders") + "SELECT 'is_returned' AS column_name, value FROM (SELECT DISTINCT is_returned AS value FROM messy_orders WHERE lower(trim(is_returned)) NOT IN ('y','yes','true','1','t','n','no','false','0','f') ORDER BY value LIMIT 20)")
def exception_capture_boolean(spark: SparkSession, sf: str) -> DataFrame:
    got = capture.lost_values(messy(spark, sf, "messy_orders"), {"is_returned": (tpl.plain_boolean("`is_returned`"), "BOOLEAN")})
    return frame(spark, [(c, v) for c, vs in got.items() for v in vs], "column_name string, value string")


@_query(duck("messy_orders") + f"""SELECT * FROM (SELECT 'discount_pct' AS column_name, value FROM (SELECT DISTINCT discount_pct AS value FROM messy_orders WHERE {_d(_WHOLE, 'discount_pct')} IS NULL AND discount_pct IS NOT NULL ORDER BY value LIMIT 20))
  UNION ALL SELECT * FROM (SELECT 'order_value', value FROM (SELECT DISTINCT order_value AS value FROM messy_orders WHERE {_d(_WHOLE, 'order_value')} IS NULL AND order_value IS NOT NULL ORDER BY value LIMIT 20))
  UNION ALL SELECT * FROM (SELECT 'is_returned', value FROM (SELECT DISTINCT is_returned AS value FROM messy_orders WHERE lower(trim(is_returned)) NOT IN ('y','yes','true','1','t','n','no','false','0','f') ORDER BY value LIMIT 20))""")
def capture_all_columns(spark: SparkSession, sf: str) -> DataFrame:
    bases = {c: (tpl.plain_double(f"`{c}`"), "DOUBLE") for c in ("discount_pct", "order_value")} | {"is_returned": (tpl.plain_boolean("`is_returned`"), "BOOLEAN")}
    got = capture.lost_values(messy(spark, sf, "messy_orders"), bases)
    return frame(spark, [(c, v) for c, vs in got.items() for v in vs], "column_name string, value string")


@_query(duck("messy_customer") + f"""SELECT *, length(value) > 100 OR regexp_matches(value, '\\S+@\\S+\\.\\S+') OR (column_name <> 'signup_date' AND regexp_matches(value, '[+0-9][0-9\\s\\-()]{{7,}}')) AS private FROM (
  SELECT * FROM (SELECT 'phone_number' AS column_name, value FROM (SELECT DISTINCT phone_number AS value FROM messy_customer WHERE {_d(_WHOLE, 'phone_number')} IS NULL ORDER BY value LIMIT 20))
  UNION ALL SELECT * FROM (SELECT 'full_name', value FROM (SELECT DISTINCT full_name AS value FROM messy_customer WHERE {_d(_WHOLE, 'full_name')} IS NULL ORDER BY value LIMIT 20))
  UNION ALL SELECT * FROM (SELECT 'signup_date', value FROM (SELECT DISTINCT signup_date AS value FROM messy_customer WHERE {_d(_WHOLE, 'signup_date')} IS NULL ORDER BY value LIMIT 20)))""")
def pii_value_filter(spark: SparkSession, sf: str) -> DataFrame:
    got = capture.lost_values(messy(spark, sf, "messy_customer"), {"phone_number": (tpl.plain_double("`phone_number`"), "DOUBLE"), "full_name": (tpl.plain_double("`full_name`"), "DOUBLE"), "signup_date": (tpl.plain_double("`signup_date`"), "TIMESTAMP")})
    return frame(spark, [(c, v, capture.is_private(v, "TIMESTAMP" if c == "signup_date" else "DOUBLE")) for c, vs in got.items() for v in vs], "column_name string, value string, private boolean")


@_query(duck("messy_orders") + "SELECT value, lower(trim(value)) IN ('tbd','na','n/a','n.a.','null','none','-','–','—','nan','#n/a','nil','','not available','missing') OR NOT regexp_matches(value, '[0-9]') AS expected_null FROM (SELECT DISTINCT order_value AS value FROM messy_orders ORDER BY value DESC LIMIT 200)")
def expected_null(spark: SparkSession, sf: str) -> DataFrame:
    values = messy(spark, sf, "messy_orders").select(F.col("order_value").alias("value")).distinct().orderBy(F.desc("value")).limit(200).collect()
    return frame(spark, [(r["value"], capture.is_expected_null(r["value"])) for r in values], "value string, expected_null boolean")


@_query("SELECT * FROM (VALUES ('plain', TRUE), ('loses', FALSE), ('unsafe', FALSE)) t(name, accepted)")
def verify_expression(spark: SparkSession, sf: str) -> DataFrame:
    values = ["72 hours", "n/a", "3.5 h"]
    df = spark.range(1)
    tried = {"plain": "try_cast(regexp_extract(`x`, '[0-9.]+', 0) as double)", "loses": "try_cast(`x` as double)", "unsafe": "java_method('java.lang.System', 'exit')"}
    return frame(spark, [(k, capture.verified(df, "x", e, values)) for k, e in tried.items()], "name string, accepted boolean")


# Consistency and classes.


@_query("""WITH m AS (SELECT 'segment' AS label, c_mktsegment AS form, count(*)::BIGINT AS weight FROM customer GROUP BY c_mktsegment)
  SELECT label, arg_max(form, (weight, -ascii(form))) AS canonical, max(weight)::BIGINT AS weight FROM m GROUP BY label""")
def weighted_majority(spark: SparkSession, sf: str) -> DataFrame:
    m = spark.read.parquet(f"{sf}/customer.parquet").groupBy(F.col("c_mktsegment").alias("form")).agg(F.count("*").alias("rows"))
    m = m.select(F.lit("segment").alias("label"), "form", "rows", F.lit(0).alias("preferred"), F.ascii("form").alias("seen"))
    return consistency.majority_frame(m)


def _profiles(spark: SparkSession, sf: str) -> dict[str, TableProfile]:
    out = {}
    for name, key in (("messy_orders", "order_id"), ("messy_customer", "customer_id")):
        df = messy(spark, sf, name)
        t = profile.full_table(df, name, key)
        out[name] = profile.enrich(t, sample.stratified(df, t))
    return out


@_query("SELECT 'id' AS kind, 'customer_id' AS label, 'numeric' AS canonical, 2 AS patched")
def cross_table_groups(spark: SparkSession, sf: str) -> DataFrame:
    groups = consistency.find_groups(_profiles(spark, sf))
    return frame(spark, [(g.kind, g.label, g.canonical, len(g.to_patch)) for g in groups], "kind string, label string, canonical string, patched int")


@_query("SELECT * FROM (VALUES ('a', 'delete_aware'), ('b', 'upsert'), ('c', 'full_resync'), ('d', 'append_only')) t(table_name, sync_mode)")
def sync_mode(spark: SparkSession, sf: str) -> DataFrame:
    cases = {"a": (["id", "updated_at", "deleted_at"], 5, "id"), "b": (["id", "updated_at"], 5, "id"), "c": (["id"], 5, "id"), "d": (["id", "created_at"], 50_000, "id")}
    return frame(spark, [(t, profile.sync_mode(*c)[0]) for t, c in cases.items()], "table_name string, sync_mode string")


@_query("SELECT * FROM (VALUES ('customer_id','IDENTIFIER'),('full_name','PII'),('phone_number','PII'),('signup_date','CLEAN_AMBIG'),('account_balance','CLEAN_AMBIG'),('is_active','OBSERVE'),('rep_key','IDENTIFIER'),('nation_code','IDENTIFIER'),('tier','CLEAN_DET')) t(column_name, class)")
def classify_columns(spark: SparkSession, sf: str) -> DataFrame:
    t = _profiles(spark, sf)["messy_customer"]
    return frame(spark, [(c.column.name, c.kind.value) for c in classify.classify(t)], "column_name string, class string")


@_query("SELECT unnest(['signup_date','account_balance','is_active','tier']) AS column_name")
def needs_sample(spark: SparkSession, sf: str) -> DataFrame:
    t = profile.full_table(messy(spark, sf, "messy_customer"), "messy_customer", "customer_id")
    return frame(spark, [(c,) for c in classify.needs_values(t)], "column_name string")


# Quality.


@_query(_BOTH + " UNION ALL ".join(f"SELECT '{c}' AS column_name, (SELECT count_if({c} IS NULL) FROM messy_orders)::BIGINT AS null_before, (SELECT count_if({c} IS NULL) FROM cleaned)::BIGINT AS null_after" for c in COLUMNS))
def dry_run_diff(spark: SparkSession, sf: str) -> DataFrame:
    diff = dryrun.dry_run(ORDERS_PLAN, messy(spark, sf, "messy_orders"))
    return frame(spark, [(c["column"], c["null_before"], c["null_after"]) for c in diff.columns], "column_name string, null_before long, null_after long")


@_query(_BOTH + "SELECT column_name FROM (" + " UNION ALL ".join(f"""SELECT '{c}' AS column_name, greatest((SELECT count_if({c} IS NULL) FROM cleaned) - (SELECT count_if({c} IS NULL) FROM messy_orders) - (SELECT count_if({_d(_SENTINEL, f'{c}::VARCHAR')}) FROM messy_orders), 0)::DOUBLE / (SELECT count(*) FROM messy_orders)::DOUBLE AS rise""" for c in COLUMNS) + ") WHERE rise > 0.1")
def null_spike_guard(spark: SparkSession, sf: str) -> DataFrame:
    diff = dryrun.dry_run(ORDERS_PLAN, messy(spark, sf, "messy_orders"))
    return frame(spark, [(m[1],) for w in diff.warnings if (m := re.match(r"column (\w+): nulls rise", w))], "column_name string")


@_query("SELECT 'customer_id' AS column_name, 'column customer_id is missing' AS warning")
def missing_columns(spark: SparkSession, sf: str) -> DataFrame:
    raw, clean = _cleaned(spark, sf)
    diff = dryrun.compare("messy_orders", raw.select("order_id", "customer_id"), clean.select("order_id"))
    return frame(spark, [("customer_id", w) for w in diff.warnings], "column_name string, warning string")


@_query("SELECT * FROM (VALUES ('order_id','bigint','bigint'),('customer_id','bigint','bigint'),('order_value','string','double'),('discount_pct','string','double'),('order_date','string','timestamp_ntz'),('is_returned','string','boolean'),('priority','string','string'),('ticket_code','string','string')) t(column_name, type_before, type_after)")
def type_diff(spark: SparkSession, sf: str) -> DataFrame:
    raw, clean = _cleaned(spark, sf)
    return frame(spark, [(c, *t) for c, t in rowdiff.column_types(raw, clean).items()], "column_name string, type_before string, type_after string")


@_query(_BOTH + "SELECT *, abs(cache_rows - source_rows)::DOUBLE / greatest(source_rows, 1) > 0.005 AS warned FROM (SELECT 'whole' AS name, (SELECT count(*) FROM messy_orders)::BIGINT AS source_rows, (SELECT count(*) FROM cleaned)::BIGINT AS cache_rows UNION ALL SELECT 'short', (SELECT count(*) FROM messy_orders)::BIGINT, (SELECT count(*) FROM cleaned WHERE order_id % 100 <> 0)::BIGINT)")
def reconcile_counts(spark: SparkSession, sf: str) -> DataFrame:
    raw, clean = _cleaned(spark, sf)
    n = dryrun.null_counts(raw, []).first()["n"]
    sides = {"whole": clean, "short": clean.filter("order_id % 100 <> 0")}
    counts = {k: dryrun.null_counts(df, []).first()["n"] for k, df in sides.items()}
    return frame(spark, [(k, n, c, bool(materialize.reconcile(n, c))) for k, c in counts.items()], "name string, source_rows long, cache_rows long, warned boolean")


@_query(_BOTH + ", b AS (SELECT m.order_id, " + ", ".join(f"((c.{c} IS NULL)::INT - (m.{c} IS NULL)::INT) AS {c}" for c in COLUMNS[1:]) + " FROM messy_orders m JOIN cleaned c USING (order_id)) SELECT column_name FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, avg({c})::DOUBLE - avg({c}) FILTER (order_id % 8 <> 5)::DOUBLE AS more FROM b" for c in COLUMNS[1:]) + ") WHERE more > 0.1")
def post_load_null_check(spark: SparkSession, sf: str) -> DataFrame:
    raw, clean = _cleaned(spark, sf)
    # A sample without the values that turn to NULL foretells too little.
    predicted = dryrun.dry_run(ORDERS_PLAN, raw.filter("order_id % 8 <> 5"))
    before, after = (dryrun.null_counts(df, COLUMNS).first() for df in (raw, clean))
    found = materialize.unexpected_nulls(before, after, COLUMNS, COLUMNS, predicted)
    return frame(spark, [(re.match(r"column (\w+):", w)[1],) for w in found], "column_name string")


_PAIR = duck("messy_orders") + f""", cleaned AS (SELECT order_id, customer_id, {_d_boolean('is_returned')} AS is_returned, CASE WHEN NOT ({_d(_SENTINEL, 'priority')}) THEN lower(trim(priority)) END AS priority, regexp_replace(trim(ticket_code), '^0+([0-9])', '\\1') AS ticket_code FROM messy_orders),
  d AS (SELECT s.order_id AS _key, s.is_returned IS DISTINCT FROM c.is_returned::VARCHAR AS a, s.priority IS DISTINCT FROM c.priority AS b, s.ticket_code IS DISTINCT FROM c.ticket_code AS t, s.priority AS before__priority, c.priority AS after__priority FROM messy_orders s JOIN cleaned c USING (order_id)) """
_SUBSET = ["order_id", "customer_id", "is_returned", "priority", "ticket_code"]


def _pair(spark: SparkSession, sf: str) -> DataFrame:
    raw, clean = _cleaned(spark, sf)
    return rowdiff.changed_rows(raw.select(*_SUBSET), clean.select(*_SUBSET), "order_id")


@_query(_PAIR + "SELECT count(*)::BIGINT AS total_changed FROM d WHERE a OR b OR t")
def row_diff_count(spark: SparkSession, sf: str) -> DataFrame:
    return _pair(spark, sf).agg(F.count("*").alias("total_changed"))


@_query(_PAIR + "SELECT _key, before__priority, after__priority, b AS chg__priority FROM d WHERE a OR b OR t ORDER BY _key LIMIT 50 OFFSET 50")
def row_diff_page(spark: SparkSession, sf: str) -> DataFrame:
    return _pair(spark, sf).orderBy("_key").offset(50).limit(50).select("_key", "before__priority", "after__priority", "chg__priority")


@_query(_PAIR + ", u AS (SELECT unnest([CASE WHEN a THEN 'is_returned' END, CASE WHEN b THEN 'priority' END, CASE WHEN t THEN 'ticket_code' END]) AS column_name FROM d) SELECT column_name, count(*)::BIGINT AS n FROM u WHERE column_name IS NOT NULL GROUP BY column_name")
def changed_columns(spark: SparkSession, sf: str) -> DataFrame:
    return _pair(spark, sf).select(F.explode("changed_columns").alias("column_name")).groupBy("column_name").agg(F.count("*").alias("n"))


@_query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS position, n_name AS name FROM nation")
def row_diff_positional(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.read.parquet(f"{sf}/nation.parquet")
    return rowdiff.with_position(n, [F.col("n_nationkey")]).select(F.col("_position").alias("position"), F.col("n_name").alias("name"))


# Checks that the fixtures describe.


@_query("SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


@_query(duck("messy_customer") + "SELECT customer_id, tier FROM messy_customer WHERE is_active <> 'F' AND tier IS NOT NULL")
def soft_delete_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = messy(spark, sf, "messy_customer").withColumn("is_deleted", F.col("is_active") == "F")
    return incremental.alive(rows, "is_deleted").filter("tier is not null").select("customer_id", "tier")


@_query(duck("messy_part") + "SELECT product_id, card_code FROM messy_part WHERE regexp_full_match(card_code, '0[0-9]+')")
def leading_zero_filter(spark: SparkSession, sf: str) -> DataFrame:
    return messy(spark, sf, "messy_part").filter(F.col("card_code").rlike("^0[0-9]+$")).select("product_id", "card_code")


@_query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*)::BIGINT AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")))
def union_counts(spark: SparkSession, sf: str) -> DataFrame:
    parts = [spark.read.parquet(f"{sf}/{t}.parquet").agg(F.lit(t).alias("table_name"), F.count("*").alias("n")) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@_query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "ts")
    return incremental.latest(e, "user_id", "ts", [F.col("event_id").desc()])


_CHANGES = """WITH cache AS (SELECT o_orderkey AS id, o_totalprice AS price, 1 AS upd, FALSE AS is_deleted FROM orders WHERE o_orderkey % 3 <> 0),
  changes AS (SELECT o_orderkey AS id, o_totalprice + 1 AS price, CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 7 = 1 THEN 1 ELSE 2 END AS upd, o_orderkey % 10 = 0 AS is_deleted FROM orders WHERE o_orderkey % 5 = 0),
  every AS (SELECT *, 0 AS new FROM cache UNION ALL SELECT *, 1 AS new FROM changes), last AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY upd DESC, new DESC) AS r FROM every) """


def _changes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    cache = o.filter("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS id", "o_totalprice AS price", "1 AS upd", "false AS is_deleted")
    at = "CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 7 = 1 THEN 1 ELSE 2 END AS upd"
    return cache, o.filter("o_orderkey % 5 = 0").selectExpr("o_orderkey AS id", "o_totalprice + 1 AS price", at, "o_orderkey % 10 = 0 AS is_deleted")


@_query(_CHANGES + "SELECT id, price, upd FROM last WHERE r = 1")
def merge_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.merged(*_changes(spark, sf), "id", "upd").select("id", "price", "upd")


@_query(_CHANGES + "SELECT id, price, upd FROM last WHERE r = 1 AND NOT is_deleted")
def merge_delete_aware(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.merged(*_changes(spark, sf), "id", "upd", "is_deleted").select("id", "price", "upd")


# Loading.


def folder_of(spark: SparkSession) -> str:
    """A folder of this call's own: in the shared one, or where that is unset and the master is local
    in a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    folder = f"{shared.rstrip('/')}/engine-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="lustra-engine-")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def _cache(spark: SparkSession) -> Cache:
    return Cache(spark, folder_of(spark))


@_query(_BOTH + "SELECT * FROM cleaned")
def cold_start_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    cache = _cache(spark)
    cache.load(ORDERS_PLAN, messy(spark, sf, "messy_orders"))
    return cache.read("messy_orders")


@_query("SELECT o_orderkey, lower(trim(o_orderpriority)) AS priority FROM orders")
def resume_idempotent(spark: SparkSession, sf: str) -> DataFrame:
    engine, project = Engine(spark, folder_of(spark)), "p"
    plan = CleaningPlan("orders", [Expression("o_orderkey", ["o_orderkey"], ["`o_orderkey`"]), Expression("o_orderpriority", ["priority"], [tpl.lowered("`o_orderpriority`")])])
    engine.state.put("projects", (project,), status="completed", source={"location": sf, "format": "parquet", "primary_keys": [], "options": []})
    engine.state.write_memory(project, "Business_Logic", "cleaning_script_orders", plan.to_json())
    for _ in range(2):  # cut off twice
        engine.state.put("sync", (project, "orders"), status="in_progress")
        if engine.resume() != ["orders"]:
            raise RuntimeError("nothing was resumed")
    return Cache(spark, f"{engine.folder}/cache/{project}").read("orders")


@_query("SELECT * FROM (VALUES ('select', TRUE), ('drop', FALSE), ('two', FALSE), ('union', FALSE), ('other', FALSE), ('file', FALSE), ('typo', FALSE), ('blank', FALSE), ('subquery', FALSE), ('join', FALSE)) t(name, accepted)")
def validate_sql(spark: SparkSession, sf: str) -> DataFrame:
    cases = {
        "select": "SELECT a, trim(b) AS b FROM t", "drop": "DROP TABLE t", "two": "SELECT 1 FROM t; DELETE FROM t", "union": "SELECT a FROM t UNION SELECT a FROM t", "other": "SELECT a FROM u",
        "file": "SELECT * FROM csv.`/etc/passwd`", "typo": "SELECT a FRM t", "blank": " ", "subquery": "SELECT (SELECT max(x) FROM u) FROM t", "join": "SELECT a FROM t JOIN u ON t.a = u.a",
    }

    def accepted(sql: str) -> bool:
        try:
            guard.validate(spark, sql, "t")
            return True
        except guard.InvalidSql:
            return False

    return frame(spark, [(k, accepted(s)) for k, s in cases.items()], "name string, accepted boolean")


@_query("SELECT 'native_timestamp' AS canonical_tie, 'intl_12d' AS canonical_phone, 'local_10d' AS canonical_rows")
def majority_rules(spark: SparkSession, sf: str) -> DataFrame:
    tie = consistency.majority([Member("a", "d", "ambiguous", 10), Member("b", "d", "native_timestamp", 10)], lambda f: f == "native_timestamp")
    phone = consistency.majority([Member("a", "p", "local_10d", 5), Member("b", "p", "intl_12d", 5)], lambda f: f.startswith("intl"))
    rows = consistency.majority([Member("a", "p", "local_10d", 50), Member("b", "p", "intl_12d", 5)], lambda f: f.startswith("intl"))
    return frame(spark, [(tie, phone, rows)], "canonical_tie string, canonical_phone string, canonical_rows string")


# The engine's steps on the driver tables.


def _source(sf: str, **keys: str) -> Source:
    return Source(sf, primary_keys=tuple(keys.items()))


@_query("SELECT unnest(['benchmark','conversations','customer','documents','embeddings','events','labels','lineitem','nation','orders','pages','part','region','supplier']) AS table_name")
def list_tables(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, [(t,) for t in _source(sf).list_tables(spark)], "table_name string")


@_query("SELECT 'region' AS name, (SELECT count(*) FROM region)::BIGINT AS n, TRUE AS found UNION ALL SELECT 'regio', 0, FALSE")
def table_existence(spark: SparkSession, sf: str) -> DataFrame:
    def rows(name: str) -> tuple:
        try:
            return name, profile.full_table(_source(sf).read(spark, name), name).rows, True
        except TableNotFound:
            return name, 0, False

    return frame(spark, [rows("region"), rows("regio")], "name string, n long, found boolean")


@_query("SELECT least((SELECT count(*) FROM lineitem), 10000)::BIGINT AS n")
def first_rows_scan(spark: SparkSession, sf: str) -> DataFrame:
    return sample.first_rows(spark.read.parquet(f"{sf}/lineitem.parquet")).agg(F.count("*").alias("n"))


@_query("SELECT (count(*) > 0) AS some, count(*) <= 2 AS few FROM region WHERE r_regionkey < 2")
def page_sample_fallback(spark: SparkSession, sf: str) -> DataFrame:
    # So small a share of five rows is empty, so the first rows stand in.
    got = sample.page_sample(spark.read.parquet(f"{sf}/region.parquet"), 1e-9, rows=2)
    return got.agg((F.count("*") > 0).alias("some"), (F.count("*") <= 2).alias("few"))


@_query("SELECT n_name AS name, n_nationkey::VARCHAR AS key_text FROM nation")
def as_text_cast(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/nation.parquet").selectExpr("n_name AS name", f"{tpl.as_text('n_nationkey')} AS key_text")


@_query(duck("messy_part") + r"SELECT avg(regexp_matches(price_eu, '[0-9],[0-9]{1,2}[^0-9]*$')::INT) > 0.5 AS european, bool_or(regexp_matches(card_code, '^0[0-9]+$')) AS leading_zero FROM messy_part")
def column_flags(spark: SparkSession, sf: str) -> DataFrame:
    got = profile.whole_facts(messy(spark, sf, "messy_part"), ["price_eu", "card_code"])
    return frame(spark, [(got["price_eu"]["european"] > 0.5, bool(got["card_code"]["leading_zero"]))], "european boolean, leading_zero boolean")


@_query(duck("messy_orders") + f"SELECT 'order_value' AS column_name, count_if(order_value IS NOT NULL AND {_d_currency('order_value', _d_magnitude('order_value'))} IS NULL)::BIGINT AS lost FROM messy_orders UNION ALL SELECT 'discount_pct', count_if(discount_pct IS NOT NULL AND {_d_percent('discount_pct')} IS NULL)::BIGINT FROM messy_orders")
def heal_columns(spark: SparkSession, sf: str) -> DataFrame:
    df = messy(spark, sf, "messy_orders")
    columns = [ColumnProfile("order_value", "string", issues=["currency_string"], flags={"magnitude": True, "parentheses": True}, sample_values=["$5", "$6"]), ColumnProfile("discount_pct", "string", issues=["percentage_string"], sample_values=["5%"])]
    healed = capture.heal(df, [Classified(c, ColumnClass.CLEAN_DET) for c in columns])
    lost = df.agg(*[F.count_if(F.expr(f"{tpl.as_text(e.column)} is not null and ({e.sql[0]}) is null")).alias(e.column) for e in healed]).first()
    return frame(spark, [(e.column, lost[e.column]) for e in healed], "column_name string, lost long")


@_query(duck("messy_orders") + "SELECT count(*)::BIGINT AS rows_before, count_if(order_id % 2 = 0)::BIGINT AS rows_after, count(*) = count_if(order_id % 2 = 0) AS safe FROM messy_orders")
def row_count_guard(spark: SparkSession, sf: str) -> DataFrame:
    raw = messy(spark, sf, "messy_orders").select("order_id")
    diff = dryrun.compare("messy_orders", raw, raw.filter("order_id % 2 = 0"))
    return frame(spark, [(diff.rows_before, diff.rows_after, diff.safe)], "rows_before long, rows_after long, safe boolean")


@_query("SELECT n_nationkey AS key, n_nationkey % 2 = 0 AS was_nan, CASE WHEN n_nationkey % 2 <> 0 THEN n_nationkey + 0.5 END::DOUBLE AS value FROM nation")
def json_safe_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/nation.parquet").selectExpr("n_nationkey AS key", "CASE WHEN n_nationkey % 2 = 0 THEN double('NaN') ELSE n_nationkey + 0.5D END AS value").collect()
    return frame(spark, [(r["key"], r["value"] != r["value"], rowdiff.json_value(r["value"])) for r in rows], "key int, was_nan boolean, value double")


@_query(duck("messy_customer") + f"SELECT 'account_balance' AS column_name, 'split,keep,assume_same,custom' AS options FROM (SELECT count(DISTINCT regexp_extract(account_balance, '{_SYMBOLS}')) AS n FROM messy_customer) WHERE n > 1 UNION ALL SELECT 'signup_date', 'month_first,day_first,custom' FROM (SELECT max(TRY_CAST(split_part(signup_date, '/', 1) AS INT)) AS a, max(TRY_CAST(split_part(signup_date, '/', 2) AS INT)) AS b FROM messy_customer) WHERE a <= 12 AND b <= 12")
def clarifications(spark: SparkSession, sf: str) -> DataFrame:
    asked = answers.questions(classify.classify(_profiles(spark, sf)["messy_customer"]))
    return frame(spark, [(q["column"], ",".join(q["options"])) for q in asked], "column_name string, options string")


@_query(duck("messy_customer") + "SELECT customer_id, try_strptime(trim(signup_date), '%d/%m/%Y') AS signup_date, account_balance FROM messy_customer")
def answers_applied(spark: SparkSession, sf: str) -> DataFrame:
    df, t = messy(spark, sf, "messy_customer"), _profiles(spark, sf)["messy_customer"]
    given = {c: answers.apply_answer(t.column(c), a) for c, a in (("signup_date", "day_first"), ("account_balance", "keep"))}
    keep = [Classified(t.column(c), ColumnClass.CLEAN_AMBIG) for c in given] + [Classified(t.column("customer_id"), ColumnClass.IDENTIFIER)]
    return compiling.apply(compiling.compile_plan("messy_customer", df, keep, given), df).select("customer_id", "signup_date", "account_balance")


@_query(duck("messy_orders") + f"SELECT order_id, CASE WHEN NOT ({_d(_SENTINEL, 'priority')}) THEN lower(trim(priority)) END AS priority, upper(is_returned) AS is_returned, {_d_percent('discount_pct')} AS discount_pct FROM messy_orders")
def batched_resolver(spark: SparkSession, sf: str) -> DataFrame:
    df = messy(spark, sf, "messy_orders")
    columns = [ColumnProfile("priority", "string", issues=["needs_trim", "null_variant", "inconsistent_casing"]), ColumnProfile("is_returned", "string"), ColumnProfile("discount_pct", "string", issues=["percentage_string"])]
    # One usable proposal, one that reaches outside, and a batch that fails.
    offers = {"is_returned": "upper(`is_returned`)", "priority": "java_method('java.lang.System', 'exit')"}
    healed = answers.resolve(df, columns, lambda part: {c["column"]: offers[c["column"]] for c in part}, batch=2)
    return df.selectExpr("order_id", *[f"{e.sql[0]} AS {e.column}" for e in healed])


@_query(duck("messy_customer") + r"SELECT customer_id, regexp_replace(trim(nation_code), '^0+([0-9])', '\1') AS nation_code, regexp_replace(phone_number, '[^0-9]', '', 'g') AS phone_number FROM messy_customer")
def consistency_patch(spark: SparkSession, sf: str) -> DataFrame:
    df = messy(spark, sf, "messy_customer")
    member = lambda t, c, form, kind="string": Member(t, c, form, 1, declared_type=kind)
    groups = [Group("id", "nation_code", "numeric", "", [member("nation", "nation_code", "numeric", "int"), member("messy_customer", "nation_code", "numeric")]), Group("phone", "phone", "local_10d", "", [member("a", "phone", "local_10d"), member("messy_customer", "phone_number", "local_formatted_10d")])]
    patch = consistency.patcher(groups, "messy_customer")
    done = [patch(compiling.passthrough(ColumnProfile(c, "string")), ColumnProfile(c, "string")) for c in ("nation_code", "phone_number")]
    return df.selectExpr("customer_id", *[f"{e.sql[0]} AS {e.column}" for e in done])


@_query("SELECT c_custkey, c_mktsegment FROM customer WHERE FALSE")
def empty_source_load(spark: SparkSession, sf: str) -> DataFrame:
    cache = _cache(spark)
    plan = CleaningPlan("customer", [Expression(c, [c], [tpl.quoted(c)]) for c in ("c_custkey", "c_mktsegment")])
    cache.load(plan, spark.read.parquet(f"{sf}/customer.parquet").filter("false"))
    return cache.read("customer")


@_query("SELECT n_name AS before, upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS after FROM nation WHERE n_name <> upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2))")
def row_diff_keyless(spark: SparkSession, sf: str) -> DataFrame:
    engine, project = Engine(spark, folder_of(spark)), "p"
    plan = CleaningPlan("nation", [Expression("n_name", ["n_name"], ["concat(upper(substr(`n_name`, 1, 1)), lower(substr(`n_name`, 2)))"])])
    engine.state.put("projects", (project,), status="completed", source={"location": sf, "format": "parquet", "primary_keys": [], "options": []})
    engine.state.write_memory(project, "Business_Logic", "cleaning_script_nation", plan.to_json())
    engine.state.put("sync", (project, "nation"), status="in_progress")
    engine.resume()
    page = engine.diff(project, "nation")
    return frame(spark, [(r["before__n_name"], r["after__n_name"]) for r in page.rows], "before string, after string")


@_query("SELECT 'region' AS table_name, 'cold_start_done' AS status, (SELECT count(*) FROM region)::BIGINT AS n")
def lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Analyse one table, approve it and read its cache."""
    engine = Engine(spark, folder_of(spark))
    spark.read.parquet(f"{sf}/region.parquet").write.parquet(f"{engine.folder}/source/region.parquet")
    project = engine.analyze_project(Source(f"{engine.folder}/source", primary_keys=(("region", "r_regionkey"),)))
    done = engine.approve(project)
    return frame(spark, [(t, s, Cache(spark, f"{engine.folder}/cache/{project}").read(t).count()) for t, s in done.items()], "table_name string, status string, n long")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
