"""Validation of cleaning SQL with Spark's own parser and analyser: a plain projection of one table,
by allow-list, whose expressions give one value for each row, the same every time."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

ALLOWED_NODES = {"Project", "SubqueryAlias", "UnresolvedRelation"}
# After analysis, over an empty table.
ANALYSED_NODES = {"Project", "SubqueryAlias", "View", "LocalRelation", "LogicalRDD"}
# Functions that give one value for each row, the same every time.
ALLOWED_FUNCTIONS = (
    "abs", "btrim", "cardinality", "ceil", "ceiling", "char_length", "coalesce", "concat", "concat_ws", "contains", "date", "date_add", "date_sub", "date_trunc", "datediff", "day",
    "dayofmonth", "element_at", "endswith", "floor", "get_json_object", "greatest", "hour", "if", "ifnull", "initcap", "instr", "isnan", "isnotnull", "isnull", "last_day", "lcase", "least",
    "left", "len", "length", "locate", "lower", "lpad", "ltrim", "make_date", "make_timestamp", "map", "md5", "minute", "mod", "month", "named_struct", "nanvl", "negative", "nullif", "nvl",
    "nvl2", "pmod", "position", "power", "quarter", "regexp", "regexp_count", "regexp_extract", "regexp_like", "regexp_replace", "regexp_substr", "replace", "reverse", "right", "rint",
    "rlike", "round", "rpad", "rtrim", "second", "sha2", "sign", "signum", "split", "split_part", "startswith", "string", "struct", "substr", "substring", "substring_index",
    "timestamp_seconds", "to_date", "to_number", "to_timestamp", "to_timestamp_ntz", "translate", "trim", "try_add", "try_divide", "try_element_at", "try_multiply", "try_subtract",
    "try_to_date", "try_to_number", "try_to_timestamp", "ucase", "unix_timestamp", "upper", "when", "year",
    # Operators that the parser reads as functions.
    "between", "like", "ilike", "not",
)
# Names without parentheses that Spark reads as functions.
NILADIC = ("current_date", "current_timestamp", "current_time", "localtimestamp", "current_user", "user", "session_user", "grouping__id")
DENIED_EXPRESSIONS = ("Window", "Current", "LocalTimestamp", "Lambda", "Generate", "Star_")


class InvalidSql(ValueError):
    pass


def _parser(spark: SparkSession):
    return spark._jsparkSession.sessionState().sqlParser()


def _walk(node, expressions: list, nodes: list) -> None:
    nodes.append(node)
    seq = node.expressions()
    for k in range(seq.size()):
        _walk_expression(seq.apply(k), expressions, nodes)
    kids = node.children()
    for k in range(kids.size()):
        _walk(kids.apply(k), expressions, nodes)


def _walk_expression(e, expressions: list, nodes: list) -> None:
    expressions.append(e)
    if hasattr(e, "plan") and "Subquery" in e.getClass().getSimpleName():
        _walk(e.plan(), expressions, nodes)
    kids = e.children()
    for k in range(kids.size()):
        _walk_expression(kids.apply(k), expressions, nodes)


def _check_functions(expressions: list) -> None:
    for e in expressions:
        kind = e.getClass().getSimpleName()
        if any(w in kind for w in DENIED_EXPRESSIONS):
            raise InvalidSql(f"{kind} isn't allowed")
        if kind == "UnresolvedFunction":
            parts = e.nameParts()
            name = parts.apply(parts.size() - 1).lower()
            if parts.size() > 1 or name not in ALLOWED_FUNCTIONS:
                raise InvalidSql(f"function {name} isn't allowed")
        elif kind == "UnresolvedAttribute":
            parts = e.nameParts()
            if parts.size() == 1 and parts.apply(0).lower() in NILADIC:
                raise InvalidSql(f"function {parts.apply(0)} isn't allowed")


def _analyse(spark: SparkSession, text: str, table: str, schema: StructType) -> StructType:
    """The output's schema, from an empty table of the same columns in a session of its own."""
    own = spark.newSession()
    own.createDataFrame([], schema).createOrReplaceTempView("`" + table.replace("`", "``") + "`")
    try:
        df = own.sql(text)
        plan = df._jdf.queryExecution().analyzed()
    except Exception as e:
        raise InvalidSql(f"doesn't fit the table: {str(e).splitlines()[0][:200]}") from e
    nodes: list = []
    expressions: list = []
    _walk(plan, expressions, nodes)
    for n in nodes:
        if n.getClass().getSimpleName() not in ANALYSED_NODES:
            raise InvalidSql(f"{n.getClass().getSimpleName()} isn't allowed")
    for e in expressions:
        if not e.deterministic():
            raise InvalidSql(f"{e.getClass().getSimpleName()} isn't the same every time")
    return df.schema


def validate(spark: SparkSession, sql: str, table: str, schema: StructType | None = None) -> str:
    """The stripped SQL if it is one SELECT over ``table`` alone, without filter, order, limit or
    aggregate; InvalidSql otherwise.  With the table's ``schema`` it is analysed as well: columns and
    types have to fit, and all expressions have to be deterministic."""
    text = (sql or "").strip().rstrip(";").strip()
    if not text:
        raise InvalidSql("empty")
    try:
        plan = _parser(spark).parsePlan(text)
    except Exception as e:
        raise InvalidSql(f"can't be parsed: {str(e).splitlines()[0][:200]}") from e
    nodes: list = []
    expressions: list = []
    _walk(plan, expressions, nodes)
    names = [n.getClass().getSimpleName() for n in nodes]
    for n in names:
        if n not in ALLOWED_NODES:
            raise InvalidSql(f"{n} isn't allowed")
    if "Project" not in names:
        raise InvalidSql("not a SELECT")
    _check_functions(expressions)
    relations = [n for n in nodes if n.getClass().getSimpleName() == "UnresolvedRelation"]
    if len(relations) != 1:
        raise InvalidSql("exactly one table is allowed")
    parts = relations[0].multipartIdentifier()
    if parts.size() != 1 or parts.apply(0).lower() != table.lower():
        raise InvalidSql(f"only table {table} is allowed")
    if schema is not None:
        _analyse(spark, text, table, schema)
    return text


def accepts(spark: SparkSession, sql: str, table: str, schema: StructType | None = None) -> bool:
    """Whether :func:`validate` takes it."""
    try:
        validate(spark, sql, table, schema)
        return True
    except InvalidSql:
        return False


def safe_expression(spark: SparkSession, sql: str) -> bool:
    """Whether ``sql`` is one expression without subqueries or functions that reach outside."""
    try:
        tree = _parser(spark).parseExpression(sql)
        expressions: list = []
        nodes: list = []
        _walk_expression(tree, expressions, nodes)
        _check_functions(expressions)
        return not nodes
    except Exception:
        return False
