"""Registered queries that run whole steps of the engine on the given tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import COLUMNS, ORDERS_PLAN, Query, folder_of, frame, sql_of_cleaned, sql_of_ratios
from .messy import duck, messy
from .model import Classified, CleaningPlan, ColumnClass, Expression, Member
from .operators import capture, consistency, profile, profilestate, sample
from .pipeline import Engine
from .plans import guard
from .plans.materialize import Cache
from .sources import snapshot as snapshots
from .sources.tables import Source

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _loaded(engine: Engine, sf: str, plan: CleaningPlan, **keys: str) -> str:
    """A project in which the plan's table of ``sf`` is loaded, as after an approval."""
    project = "p"
    engine.state.put("projects", (project,), status="completed", source={"location": sf, "format": "parquet", "primary_keys": list(keys.items()), "options": []})
    engine.state.write_memory(project, "Business_Logic", f"cleaning_script_{plan.table}", plan.to_json())
    engine.state.put("sync", (project, plan.table), status="in_progress")
    if engine.resume() != [plan.table]:
        raise RuntimeError(f"{plan.table} was not loaded")
    return project


def _plan(table: str, columns: list[str], **changed: str) -> CleaningPlan:
    return CleaningPlan(table, [Expression(c, [c], [changed.get(c, f"`{c}`")], "deterministic" if c in changed else "passthrough") for c in columns])


# Snapshots, loads and diffs.


@_query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0")
def snapshot_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the orders are analysed, the others come afterwards: the load sees the first half."""
    engine = Engine(spark, folder_of(spark))
    at = f"{engine.folder}/source/orders.parquet"
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    orders.filter("o_orderkey % 2 = 0").write.parquet(at)
    project = engine.analyze_project(Source(f"{engine.folder}/source", primary_keys=(("orders", "o_orderkey"),)))
    orders.filter("o_orderkey % 2 = 1").write.mode("append").parquet(at)
    if engine.approve(project) != {"orders": "cold_start_done"}:
        raise RuntimeError(engine.table_detail(project, "orders")["error"])
    return Cache(spark, f"{engine.folder}/cache/{project}").read("orders")


_SHIP = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_returnflag".split()


@_query("""WITH n AS (SELECT row_number() OVER () - 1 AS _key, l_returnflag AS before, CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'N' THEN NULL ELSE l_returnflag END AS after FROM lineitem)
  SELECT _key, before, after FROM n WHERE before IS DISTINCT FROM after""")
def keyless_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Every changed row of a table without a key, paired by the places that the cache carries."""
    engine = Engine(spark, folder_of(spark))
    project = _loaded(engine, sf, _plan("lineitem", _SHIP, l_returnflag="CASE `l_returnflag` WHEN 'R' THEN 'returned' WHEN 'N' THEN NULL ELSE `l_returnflag` END"))
    rows = engine.diff_index(project, "lineitem").rows()
    return rows.select("_key", F.col("before__l_returnflag").alias("before"), F.col("after__l_returnflag").alias("after"))


@_query("""WITH d AS (SELECT o_orderkey AS _key, o_orderpriority AS before, lower(o_orderpriority) AS after FROM orders WHERE o_orderstatus <> 'O'),
  r AS (SELECT *, (row_number() OVER (ORDER BY _key) - 1) // 50 + 1 AS page, count(*) OVER () AS total_changed FROM d WHERE before <> after)
  SELECT page, _key, before, after, total_changed FROM r WHERE page IN (1, 2, 7) OR page = (SELECT max(page) FROM r)""")
def diff_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The first pages and the last one, each from the file or two that hold it."""
    engine = Engine(spark, folder_of(spark))
    columns = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    project = _loaded(engine, sf, _plan("orders", columns, o_orderpriority="CASE WHEN `o_orderstatus` <> 'O' THEN lower(`o_orderpriority`) ELSE `o_orderpriority` END"), orders="o_orderkey")
    index = engine.diff_index(project, "orders")
    rows = []
    for page in dict.fromkeys((1, 2, 7, -(-index.total // 50))):
        got = engine.diff(project, "orders", page, 50)
        rows += [(page, r["_key"], r["before__o_orderpriority"], r["after__o_orderpriority"], got.total_changed) for r in got.rows]
    return frame(spark, rows, "page long, _key long, before string, after string, total_changed long")


@_query(sql_of_cleaned() + " UNION ALL ".join(f"SELECT '{c}' AS column_name, (SELECT count(*) FROM messy_orders)::BIGINT AS n_source, (SELECT count(*) FROM cleaned)::BIGINT AS n_cache, (SELECT count_if({c} IS NULL) FROM messy_orders)::BIGINT AS null_source, (SELECT count_if({c} IS NULL) FROM cleaned)::BIGINT AS null_cache" for c in COLUMNS))
def one_pass_load(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and nulls of both sides, as counted by the write itself."""
    report = Cache(spark, folder_of(spark)).load(ORDERS_PLAN, messy(spark, sf, "messy_orders"))
    return frame(spark, [(c, report.source_rows, report.cache_rows, *n) for c, n in report.nulls.items()], "column_name string, n_source long, n_cache long, null_source long, null_cache long")


# Profiles that add up.

_HALVES = {"a": "order_id % 10 < 7", "b": "order_id % 10 >= 7"}
_TEXT_RATIOS = ("currency_symbol", "percent_sign", "null_variant", "needs_trim", "date_like", "numeric_like")


@_query(sql_of_cleaned() + " UNION ALL ".join(sql_of_ratios(c, _TEXT_RATIOS) for c in COLUMNS[2:]))
def profile_after_append(spark: SparkSession, sf: str) -> DataFrame:
    """The orders come in two files; the second is measured alone and merged with the first one's facts.
    Distinct values are estimated: told is whether they are within three standard errors."""
    at = folder_of(spark)
    source, state = Source(f"{at}/source"), profilestate.ProfileState(spark, f"{at}/state")
    orders = messy(spark, sf, "messy_orders")
    for part, condition in _HALVES.items():
        orders.filter(condition).coalesce(1).write.mode("append").parquet(f"{at}/source/orders.parquet")
        done = state.update(snapshots.take(spark, source, "orders", f"{at}/snapshot-{part}"))
        if done.measured != 1:
            raise RuntimeError(f"{done.measured} files were read for {part}")
    got = profilestate.summary(profilestate.merged(state.read()))
    exact = {r["name"]: r["n"] for r in orders.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in COLUMNS[2:]])).alias("x")).groupBy("x.name").agg(F.count_distinct("x.v").alias("n")).collect()}
    rows = [(r["name"], r["rows"], r["nulls"], *[r[f"{c}_ratio"] for c in _TEXT_RATIOS], abs(r["distinct_values"] - exact[r["name"]]) <= 3 * 0.01625 * exact[r["name"]] + 1) for r in got.collect() if r["name"] in exact]
    return frame(spark, rows, "column_name string, n_rows long, n_nulls long, " + ", ".join(f"{c}_ratio double" for c in _TEXT_RATIOS) + ", close boolean")


# Samples.

_LINE = """, l AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_shipdate_text, md5(concat('{"l_orderkey":', l_orderkey::VARCHAR, ',"l_linenumber":', l_linenumber::VARCHAR, ',"l_returnflag":', CASE WHEN l_returnflag IS NULL THEN 'null' ELSE concat('"', l_returnflag, '"') END, ',"l_shipdate_text":"', l_shipdate_text, '"}')) AS h
  FROM (SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'N') AS l_returnflag, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate_text FROM lineitem))"""


@_query("WITH x AS (SELECT 1)" + _LINE + """, s AS (SELECT * FROM (SELECT h FROM l ORDER BY h LIMIT 400) UNION SELECT * FROM (SELECT h FROM l WHERE l_returnflag IS NULL ORDER BY h LIMIT 10)"""
  + "".join(f" UNION SELECT * FROM (SELECT h FROM l ORDER BY {c} {d}, h LIMIT 20)" for c in ("l_orderkey", "l_linenumber") for d in ("ASC", "DESC"))
  + ") SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, l_shipdate_text FROM l WHERE h IN (SELECT h FROM s)")
def sample_keyless(spark: SparkSession, sf: str) -> DataFrame:
    """The stratified sample of a table without a key: rows go by a hash of their JSON."""
    df = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", "nullif(l_returnflag, 'N') AS l_returnflag", "date_format(l_shipdate, 'yyyy-MM-dd') AS l_shipdate_text")
    return sample.stratified(df, profile.full_table(df, "lineitem"))


@_query("SELECT l_orderkey // 500 AS block, count(*)::BIGINT AS n, sum(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY ALL")
def block_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A sample by row groups with a share of 1: each block once, with all its rows."""
    at = folder_of(spark)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    block = F.floor(F.col("l_orderkey") / 500)
    lines.repartition(16, block).write.option("parquet.block.size", 1 << 16).parquet(f"{at}/source/lines.parquet")
    shot = snapshots.take(spark, Source(f"{at}/source"), "lines", f"{at}/snapshot")
    return sample.page_sample(shot.read(spark), 1.0, snapshot=shot).groupBy(block.alias("block")).agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


# Values that a cast loses.

_WAIT = """SELECT p_partkey AS product_id, CASE p_partkey % 4 WHEN 0 THEN concat(CAST(p_size AS STRING), ' hours') WHEN 1 THEN concat(CAST(p_size AS STRING), ',5 h')
  WHEN 2 THEN concat('0.', lpad(CAST(p_size AS STRING), 2, '0'), '  Hrs') ELSE 'n/a' END AS wait_hours,
  CASE p_partkey % 2 WHEN 0 THEN concat(CAST(p_size AS STRING), ' kg') ELSE concat(CAST(p_size AS STRING), ' g') END AS net_amount FROM {0}"""


@_query(f"""WITH w AS ({_WAIT.format('part')}) SELECT product_id, CASE WHEN wait_hours <> 'n/a' THEN replace(regexp_extract(wait_hours, '[0-9]+([.,][0-9]+)?'), ',', '.')::DOUBLE END AS wait_hours,
  TRY_CAST(net_amount AS DOUBLE) AS net_amount FROM w""")
def pattern_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Hours in several spellings are read by pattern; amounts in kilograms and grams are not, as the
    number alone would lose the unit."""
    df = spark.sql(_WAIT.format("{t}"), t=spark.read.parquet(f"{sf}/part.parquet"))
    t = profile.full_table(df, "stock", "product_id")
    columns = [Classified(c, ColumnClass.CLEAN_DET) for c in profile.enrich(t, df).columns if c.name != "product_id"]
    healed = capture.heal(df, columns)
    return df.selectExpr("product_id", *[f"{e.sql[0]} AS {e.column}" for e in healed])


_LOST = f"lower(trim(order_value)) IN ({', '.join(repr(v) for v in capture.EXPECTED_NULLS)}) OR NOT regexp_matches(order_value, '[0-9]')"


@_query(duck("messy_orders") + f"SELECT value, {_LOST.replace('order_value', 'value')} AS expected_null FROM (SELECT DISTINCT order_value AS value FROM messy_orders)")
def expected_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """All distinct values of a column."""
    values = messy(spark, sf, "messy_orders").select(F.col("order_value").alias("value")).distinct()
    return values.select("value", capture.expected_null(F.col("value")).alias("expected_null"))


@_query(duck("messy_customer") + r"""SELECT column_name, value, length(value) > 100 OR regexp_matches(value, '\S+@\S+\.\S+')
    OR (NOT (column_name = 'signup_date' AND regexp_matches(trim(value), '^[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}$')) AND regexp_matches(value, '[+0-9][0-9\s\-()]{7,}')) AS private
  FROM (SELECT 'phone_number' AS column_name, phone_number AS value FROM messy_customer UNION SELECT 'full_name', full_name FROM messy_customer UNION SELECT 'signup_date', signup_date FROM messy_customer)""")
def private_values(spark: SparkSession, sf: str) -> DataFrame:
    """All distinct values of three columns."""
    df = messy(spark, sf, "messy_customer")
    parts = [df.select(F.lit(c).alias("column_name"), F.col(c).alias("value")).distinct().withColumn("private", capture.private(F.col("value"), "TIMESTAMP" if c == "signup_date" else "DOUBLE")) for c in ("phone_number", "full_name", "signup_date")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query(duck("messy_orders") + f""", lost AS (SELECT DISTINCT discount_pct AS v FROM messy_orders WHERE TRY_CAST(discount_pct AS DOUBLE) IS NULL AND discount_pct IS NOT NULL ORDER BY v LIMIT 20)
  SELECT name, bool_and(x IS NOT NULL OR {_LOST.replace('order_value', 'v')}) AS accepted FROM (
    SELECT 'cast' AS name, v, TRY_CAST(v AS DOUBLE) AS x FROM lost UNION ALL SELECT 'digits', v, TRY_CAST(regexp_replace(v, '[^0-9.]', '', 'g') AS DOUBLE) FROM lost) GROUP BY name UNION ALL SELECT 'outside', FALSE""")
def verified_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Which expressions read all of a column's lost values, and are safe."""
    df = messy(spark, sf, "messy_orders")
    lost = capture.lost_values(df, {"discount_pct": ("try_cast(`discount_pct` as double)", "DOUBLE")})["discount_pct"]
    tried = {"cast": "try_cast(`discount_pct` as double)", "digits": "try_cast(regexp_replace(`discount_pct`, '[^0-9.]', '') as double)", "outside": "java_method('java.lang.System', 'exit')"}
    return frame(spark, [(k, capture.verified(df, "discount_pct", e, lost)) for k, e in tried.items()], "name string, accepted boolean")


# Plans and classes.

_TABLES = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id"}


@_query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, CASE WHEN count(*) < 10000 THEN 'full_resync' ELSE 'append_only' END AS sync_mode, CASE WHEN count(*) >= 10000 THEN '{k}' END AS tracking FROM {t}" for t, k in _TABLES.items()))
def sync_modes(spark: SparkSession, sf: str) -> DataFrame:
    found = [profile.full_table(spark.read.parquet(f"{sf}/{t}.parquet"), t, k) for t, k in _TABLES.items()]
    return frame(spark, [(t.table, t.sync_mode, t.tracking_column) for t in found], "table_name string, sync_mode string, tracking string")


@_query("""SELECT table_name, column_name, kind, CASE kind WHEN 'year' THEN data_type LIKE 'TIMESTAMP%' WHEN 'trim' THEN TRUE ELSE FALSE END AS accepted
  FROM information_schema.columns, (SELECT unnest(['year', 'trim', 'limit', 'distinct', 'where', 'max', 'other', 'missing']) AS kind) WHERE table_name IN ('customer', 'orders', 'part')""")
def guarded_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaning SQL over each column of three tables, with the tables' own types."""
    rows = []
    for table in ("customer", "orders", "part"):
        schema = spark.read.parquet(f"{sf}/{table}.parquet").schema
        for f in schema.fields:
            c = f"`{f.name}`"
            tried = {
                "year": f"SELECT year({c}) AS x FROM {table}", "trim": f"SELECT trim(cast({c} as string)) AS x FROM {table}", "limit": f"SELECT {c} FROM {table} LIMIT 1000", "distinct": f"SELECT DISTINCT {c} FROM {table}",
                "where": f"SELECT {c} FROM {table} WHERE {c} IS NOT NULL", "max": f"SELECT max({c}) AS x FROM {table}", "other": f"SELECT {c} FROM region", "missing": f"SELECT {c}, nothing FROM {table}",
            }
            if not f.dataType.simpleString().startswith("timestamp"):
                tried["year"] = f"SELECT date_trunc('YEAR', element_at({c}, 1)) AS x FROM {table}"
            rows += [(table, f.name, k, guard.accepts(spark, sql, table, schema)) for k, sql in tried.items()]
    return frame(spark, rows, "table_name string, column_name string, kind string, accepted boolean")


@_query(duck("messy_customer") + """SELECT 'phone' AS label, CASE WHEN count_if(phone_number LIKE '+%') >= count_if(phone_number NOT LIKE '+%') THEN 'intl' ELSE 'local' END AS canonical FROM messy_customer
  UNION ALL SELECT 'segment', (SELECT c_mktsegment FROM customer GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment LIMIT 1)""")
def majority_forms(spark: SparkSession, sf: str) -> DataFrame:
    """The form that most rows have; ties go to the preferred one, then to the first."""
    forms = F.when(F.col("phone_number").startswith("+"), "intl").otherwise("local")
    phones = messy(spark, sf, "messy_customer").groupBy(forms.alias("form")).agg(F.count("*").alias("n")).orderBy("form").collect()
    segments = spark.read.parquet(f"{sf}/customer.parquet").groupBy(F.col("c_mktsegment").alias("form")).agg(F.count("*").alias("n")).orderBy("form").collect()
    said = [(label, consistency.majority([Member(label, label, r["form"], r["n"]) for r in rows], lambda f: f == "intl")) for label, rows in (("phone", phones), ("segment", segments))]
    return frame(spark, said, "label string, canonical string")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
