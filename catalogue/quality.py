"""Queries that profile tables, derive rules from them, and apply rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.adapters import load, scratch
from catalogue.logs import money
from meterwise.operators import evaluate as ev, profile as pf, rules as rl, ruletext
from meterwise.settings import TOLERANCES, QualityShape
from meterwise.sinks import documents
from meterwise.sources import tables as tb

QUERIES: dict = {}
SQL: dict[str, str] = {}
SHAPE = QualityShape()

# Columns and kinds of the profiled tables, as the SQL side needs them.
COLUMNS = {
    "orders": [("o_orderkey", "integer", "int64"), ("o_custkey", "integer", "int64"), ("o_orderstatus", "string", "string"),
               ("o_totalprice", "float", "double"), ("o_orderdate", "timestamp", "timestamp[us]"), ("o_orderpriority", "string", "string")],
    "customer": [("c_custkey", "integer", "int64"), ("c_name", "string", "string"), ("c_nationkey", "integer", "int32"),
                 ("c_acctbal", "float", "double"), ("c_mktsegment", "string", "string")],
    "part": [("p_partkey", "integer", "int64"), ("p_name", "string", "string"), ("p_brand", "string", "string"),
             ("p_type", "string", "string"), ("p_size", "integer", "int32"), ("p_retailprice", "float", "double")],
    "documents": [("doc_id", "integer", "int64"), ("text", "string", "string"), ("lang", "string", "string"),
                  ("source", "string", "string"), ("n_chars", "integer", "int64")],
    "events": [("event_id", "integer", "int64"), ("ts", "timestamp", "timestamp[us]"), ("user_id", "integer", "int64"),
               ("event_type", "string", "string"), ("value", "float", "double"), ("props", "string", "string")],
    "embeddings": [("vec_id", "integer", "int64"), ("embedding", "other", "array<float>"), ("label", "integer", "int32")],
    # Orders with gaps: some amounts and states missing, some order keys repeated.
    "gaps": [("o_orderkey", "integer", "int64"), ("o_orderstatus", "string", "string"), ("o_totalprice", "float", "double"),
             ("o_orderdate", "date", "date32[day]"), ("is_open", "boolean", "bool"), ("nothing", "string", "string")],
}
_GAPS = """SELECT CASE WHEN o_orderkey % 40 = 39 THEN o_orderkey - 1 ELSE o_orderkey END AS o_orderkey,
  CASE WHEN o_custkey % 10 <> 3 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 100 <> 7 THEN o_totalprice END AS o_totalprice,
  CAST(o_orderdate AS DATE) AS o_orderdate, o_orderstatus = 'O' AS is_open, CAST(NULL AS {text}) AS nothing FROM {orders}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "gaps":
        orders = load(spark, sf_dir, "orders")["orders"]
        return spark.sql(_GAPS.replace("{text}", "STRING"), orders=orders)
    return load(spark, sf_dir, name)[name]


def _from(name: str) -> str:
    return f"({_GAPS.replace('{text}', 'VARCHAR').replace('{orders}', 'orders')})" if name == "gaps" else name


def profile_sql(name: str) -> str:
    """One row per column, numbered in order."""
    parts = []
    for i, (column, kind, source_type) in enumerate(COLUMNS[name]):
        number, text = kind in ("integer", "float"), kind == "string"
        stats = (
            f"CAST(min({column}) AS DOUBLE) AS minimum, CAST(max({column}) AS DOUBLE) AS maximum, avg({column}) AS mean, stddev_pop({column}) AS stddev"
            if number else "CAST(NULL AS DOUBLE) AS minimum, CAST(NULL AS DOUBLE) AS maximum, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS stddev"
        )
        sizes = (
            f"CAST(min(octet_length(encode({column}))) AS INT) AS min_length, CAST(max(octet_length(encode({column}))) AS INT) AS max_length"
            if text else "CAST(NULL AS INT) AS min_length, CAST(NULL AS INT) AS max_length"
        )
        distinct = f"count(DISTINCT {column})" if kind != "other" else "CAST(NULL AS BIGINT)"
        top = "CAST(NULL AS STRUCT(value VARCHAR, n BIGINT)[])"
        if kind in ("string", "integer", "boolean"):
            top = (
                f"(SELECT CASE WHEN count(*) <= {SHAPE.value_set_size} THEN list(struct_pack(value := value, n := n) ORDER BY n DESC, value) END "
                f"FROM (SELECT CAST({column} AS VARCHAR) AS value, count(*) AS n FROM src WHERE {column} IS NOT NULL GROUP BY 1) AS v)"
            )
        parts.append(
            f"SELECT {i} AS column_no, '{column}' AS name, '{kind}' AS kind, '{source_type}' AS source_type, count(*) AS row_count, "
            f"count(*) - count({column}) AS null_count, {distinct} AS distinct_count, {stats}, {sizes}, {top} AS top_list FROM src"
        )
    return f"src AS (SELECT * FROM {_from(name)}), prof AS ({' UNION ALL '.join(parts)})"


_TOP = "coalesce(array_to_string([t.value || ':' || t.n FOR t IN top_list], '|'), '') AS top_values"


def _profile_out(name: str) -> str:
    return (
        f"WITH {profile_sql(name)} SELECT column_no, name, kind, source_type, row_count, null_count, distinct_count, minimum, maximum, "
        f"round(mean, 4) AS mean, round(stddev, 4) AS stddev, min_length, max_length, {_TOP}, "
        "round(CASE WHEN row_count = 0 THEN 1 ELSE (row_count - null_count) / row_count END, 6) AS completeness, "
        "round(CASE WHEN row_count > null_count THEN distinct_count / (row_count - null_count) END, 6) AS uniqueness FROM prof"
    )


def _profiled(name: str):
    def run(spark, sf_dir):
        rows = pf.with_ratios(pf.profile(table(spark, sf_dir, name), SHAPE))
        top = F.array_join(F.transform("top_values", lambda v: F.concat(v["value"], F.lit(":"), v["count"].cast("string"))), "|")
        return rows.select(
            "column_no", "name", "kind", "source_type", "row_count", "null_count", "distinct_count", "minimum", "maximum",
            F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"), "min_length", "max_length", top.alias("top_values"),
            F.round("completeness", 6).alias("completeness"), F.round("uniqueness", 6).alias("uniqueness"),
        )

    return run


for _name in COLUMNS:
    QUERIES[f"profile_{_name}"] = _profiled(_name)
    SQL[f"profile_{_name}"] = _profile_out(_name)


def _dataset(spark, sf_dir):
    return pf.dataset_summary(pf.profile(table(spark, sf_dir, "gaps"), SHAPE))


QUERIES["dataset_summary"] = _dataset
SQL["dataset_summary"] = (
    f"SELECT count(*) AS row_count, FALSE AS sampled, count(*) AS total_row_count, CAST({len(COLUMNS['gaps'])} AS BIGINT) AS column_count, "
    "TRUE AS row_count_is_known FROM orders"
)


# --- rules ----------------------------------------------------------------------------------------


def rules_sql(name: str, level: str) -> str:
    """All rules of a profile as text, numbered as the rule table numbers them."""
    t = TOLERANCES[level]
    present = "(row_count - null_count)"

    def num(x: str) -> str:
        return f"regexp_replace(CAST(CAST({x} AS DECIMAL(38,6)) AS VARCHAR), '\\.?0+$', '')"

    def low(x: str) -> str:
        return num(f"floor(CAST(round({x}, 9) AS DECIMAL(38,9)) * 1000000) / CAST(1000000 AS DECIMAL(38,0))")

    def high(x: str) -> str:
        return num(f"ceil(CAST(round({x}, 9) AS DECIMAL(38,9)) * 1000000) / CAST(1000000 AS DECIMAL(38,0))")

    complete = f"floor(({present} / row_count - {t.completeness_margin}) * 100) / 100"
    unique = f"floor((distinct_count / {present} - {t.uniqueness_margin}) * 100) / 100"
    pad = f"((CASE WHEN maximum > minimum THEN maximum - minimum ELSE abs(minimum) END) * {t.numeric_padding}::DOUBLE)"
    q = "' \"' || name || '\"'"
    category = (
        f"kind = 'string' AND row_count >= {SHAPE.minimum_rows_for_values} AND distinct_count <= {SHAPE.value_set_size} AND {present} > 0 "
        f"AND distinct_count / {present} <= {SHAPE.maximum_distinct_ratio}"
    )
    types = "CASE kind WHEN 'boolean' THEN 'Boolean' WHEN 'integer' THEN 'Long' WHEN 'float' THEN 'Double' WHEN 'date' THEN 'Date' WHEN 'timestamp' THEN 'Timestamp' END"
    rules = [
        f"CASE WHEN row_count = 0 THEN NULL WHEN null_count = 0 THEN 'IsComplete' || {q} WHEN {complete} > 0 THEN 'Completeness' || {q} || ' >= ' || {num(complete)} END",
        f"CASE WHEN kind NOT IN ('integer', 'string') OR {present} = 0 THEN NULL WHEN distinct_count = {present} THEN (CASE WHEN null_count = 0 THEN 'IsPrimaryKey' ELSE 'IsUnique' END) || {q} "
        f"WHEN distinct_count / {present} >= {SHAPE.minimum_uniqueness} AND {unique} > 0 THEN 'Uniqueness' || {q} || ' >= ' || {num(unique)} END",
        f"CASE WHEN {category} THEN 'ColumnValues' || {q} || ' in [\"' || array_to_string(list_sort([t.value FOR t IN top_list]), '\", \"') || '\"]' END",
        f"CASE WHEN {category} THEN 'DistinctValuesCount' || {q} || ' between 1 and ' || distinct_count END",
        f"CASE WHEN minimum IS NOT NULL THEN 'ColumnValues' || {q} || ' between ' || CASE WHEN kind = 'integer' THEN CAST(CAST(floor(minimum - {pad}) AS BIGINT) AS VARCHAR) ELSE {low('minimum - ' + pad)} END "
        f"|| ' and ' || CASE WHEN kind = 'integer' THEN CAST(CAST(ceil(maximum + {pad}) AS BIGINT) AS VARCHAR) ELSE {high('maximum + ' + pad)} END END",
        f"CASE WHEN min_length IS NOT NULL THEN 'ColumnLength' || {q} || ' between ' || greatest(0, min_length - {t.length_padding}) || ' and ' || (max_length + {t.length_padding}) END",
        f"CASE WHEN {types} IS NOT NULL THEN 'ColumnDataType' || {q} || ' = \"' || {types} || '\"' END",
    ]
    columns = " UNION ALL ".join(f"SELECT CAST((column_no + 1) * 16 + {i} AS INT) AS rule_no, {r} AS rule_text FROM prof" for i, r in enumerate(rules))
    r = t.row_count_tolerance
    table_rules = (
        f"SELECT 0 AS rule_no, 'RowCount between ' || CAST(greatest(0, floor(count(*) * (1 - {r}::DOUBLE))) AS BIGINT) || ' and ' || CAST(ceil(count(*) * (1 + {r}::DOUBLE)) AS BIGINT) AS rule_text FROM src "
        f"UNION ALL SELECT 1, 'ColumnCount = {len(COLUMNS[name])}'"
    )
    return f"{profile_sql(name)}, every AS ({table_rules} UNION ALL {columns}), rules AS (SELECT * FROM every WHERE rule_text IS NOT NULL)"


def derived(spark: SparkSession, sf_dir: str, name: str, level: str) -> DataFrame:
    return rl.derive_rules(pf.profile(table(spark, sf_dir, name), SHAPE), level, SHAPE)


def _rule_query(name: str, level: str):
    return lambda spark, sf_dir: derived(spark, sf_dir, name, level).select("rule_no", "rule_text")


for _name, _level in (
    ("orders", "balanced"), ("customer", "strict"), ("part", "lenient"), ("documents", "balanced"), ("events", "strict"),
    ("gaps", "balanced"), ("embeddings", "lenient"),
):
    QUERIES[f"rules_{_name}_{_level}"] = _rule_query(_name, _level)
    SQL[f"rules_{_name}_{_level}"] = f"WITH {rules_sql(_name, _level)} SELECT rule_no, rule_text FROM rules"


def _document(spark, sf_dir):
    lines = ruletext.document_lines(derived(spark, sf_dir, "gaps", "balanced"), "Rules of orders")
    # Comments are checked against fixed documents by the tests; here the rules and brackets.
    kept = lines.filter(~F.trim("line").startswith("#") & (F.trim("line") != ""))
    return kept.select(F.trim("line").alias("line"))


QUERIES["rule_document"] = _document
SQL["rule_document"] = (
    f"WITH {rules_sql('gaps', 'balanced')} SELECT rule_text || CASE WHEN rule_no < (SELECT max(rule_no) FROM rules) THEN ',' ELSE '' END AS line FROM rules "
    "UNION ALL SELECT 'Rules = [' UNION ALL SELECT ']'"
)


def evidence_sql(name: str, level: str) -> str:
    """The evidence of every rule of a whole table, under the rule's number."""
    t, present = TOLERANCES[level], "(row_count - null_count)"
    many = lambda x: f"format('{{:,}}', {x})"
    share = lambda x: f"format('{{:.3f}}', CAST({x} AS DOUBLE))"
    short = lambda x: f"format('{{:.6g}}', CAST({x} AS DOUBLE))"
    percent, shown = f"{t.numeric_padding * 100:g}%", SHAPE.shown_values
    listed = (
        f"array_to_string([v.value || ' x ' || {many('v.n')} FOR v IN top_list[1:{shown}]], ', ') "
        f"|| CASE WHEN len(top_list) > {shown} THEN ', +' || (len(top_list) - {shown}) || ' others' ELSE '' END"
    )
    evidence = [
        f"CASE WHEN null_count = 0 THEN 'every one of ' || {many('row_count')} || ' rows has a value' ELSE 'filled in ' || {many(present)} || ' rows of ' || {many('row_count')} "
        f"|| ', a share of ' || {share(present + ' / row_count')} || '; {level} tolerance lowers the bar by {t.completeness_margin}' END",
        f"CASE WHEN distinct_count = {present} AND null_count = 0 THEN 'key candidate: each of ' || {many('row_count')} || ' rows has its own value' "
        f"WHEN distinct_count = {present} THEN 'no value occurs twice among ' || {many(present)} || '; empty in ' || {many('null_count')} || ' rows, which rules out a key' "
        f"ELSE 'few repeats: ' || {many('distinct_count')} || ' different values in ' || {many(present)} || ' filled rows, a share of ' || {share('distinct_count / ' + present)} "
        f"|| '; {level} tolerance lowers the bar by {t.uniqueness_margin}' END",
        f"'closed list of ' || distinct_count || ', counted over ' || {many(present)} || ' filled rows: ' || {listed}",
        "'the list had ' || distinct_count || ' members; more of them, or none at all, is a change'",
        f"CASE WHEN maximum > minimum THEN 'seen from ' || {short('minimum')} || ' up to ' || {short('maximum')} ELSE 'only ' || {short('minimum')} || ' was seen' END "
        f"|| '; {level} tolerance adds {percent} on both ends'",
        f"'sizes seen: ' || min_length || ' - ' || max_length || ' bytes; {level} tolerance adds {t.length_padding} on both ends'",
        "'stored type: ' || source_type",
    ]
    columns = " UNION ALL ".join(f"SELECT CAST((column_no + 1) * 16 + {i} AS INT) AS rule_no, {e} AS evidence FROM prof" for i, e in enumerate(evidence))
    return (
        f"facts AS (SELECT 0 AS rule_no, 'table size when profiled: ' || {many('count(*)')} || '; {level} tolerance of plus or minus {t.row_count_tolerance * 100:g}%' AS evidence FROM src "
        f"UNION ALL SELECT 1, 'width when profiled: {len(COLUMNS[name])}' UNION ALL {columns})"
    )


def _evidence_query(name: str, level: str):
    return lambda spark, sf_dir: derived(spark, sf_dir, name, level).select("rule_no", "rule_text", "evidence")


# Between them these tables bring up all kinds of evidence.
for _suffix, _name, _level in (("", "gaps", "balanced"), ("_documents", "documents", "strict"), ("_part", "part", "lenient")):
    QUERIES[f"rule_evidence{_suffix}"] = _evidence_query(_name, _level)
    SQL[f"rule_evidence{_suffix}"] = (
        f"WITH {rules_sql(_name, _level)}, {evidence_sql(_name, _level)} SELECT rule_no, rule_text, evidence FROM rules JOIN facts USING (rule_no)"
    )


# --- applying rules -------------------------------------------------------------------------------


def _checks(spark, sf_dir):
    """Rules of the orders applied to the orders with gaps."""
    orders = load(spark, sf_dir, "orders")["orders"].select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    rules = rl.derive_rules(pf.profile(orders, SHAPE), "strict", SHAPE)
    kept = rules.filter((F.col("column") != "o_orderdate") | F.col("column").isNull())
    broken = table(spark, sf_dir, "gaps").select(
        F.when(F.col("o_orderkey") % 9 == 4, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("o_orderkey"),
        F.when(F.col("o_orderkey") % 11 == 0, F.concat("o_orderstatus", F.lit("-late"))).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        (F.col("o_totalprice") * 1.5).alias("o_totalprice"),
    )
    return ev.evaluate(broken, kept).select(
        "rule_no", "rule_type", F.round("measured", 6).alias("measured"), "failing_rows", "passed"
    )


_BROKEN = f"""src AS (SELECT * FROM {_from('gaps')}),
  b AS (SELECT CASE WHEN o_orderkey % 9 = 4 THEN -o_orderkey ELSE o_orderkey END AS k, CASE WHEN o_orderkey % 11 = 0 THEN o_orderstatus || '-late' ELSE o_orderstatus END AS s, o_totalprice * 1.5 AS p FROM src),
  o AS (SELECT count(*) AS n, min(o_totalprice) AS plo, max(o_totalprice) AS phi, min(o_orderkey) AS klo, max(o_orderkey) AS khi, count(DISTINCT o_orderstatus) AS ds,
    min(length(o_orderstatus)) AS slo, max(length(o_orderstatus)) AS shi FROM orders)"""


def _check(no: int, kind: str, measured: str, failing: str, passed: str) -> str:
    return f"SELECT {no} AS rule_no, '{kind}' AS rule_type, CAST(round({measured}, 6) AS DOUBLE) AS measured, {failing} AS failing_rows, {passed} AS passed FROM b CROSS JOIN o GROUP BY ALL"


def _judged(no: int, kind: str, bad: str) -> str:
    n = f"count(*) FILTER (WHERE {bad})"
    return f"SELECT {no} AS rule_no, '{kind}' AS rule_type, CAST({n} AS DOUBLE) AS measured, {n} AS failing_rows, {n} = 0 AS passed FROM b, o"


_NO_FAIL = "CAST(NULL AS BIGINT)"
QUERIES["rule_checks"] = _checks
SQL["rule_checks"] = f"WITH {_BROKEN} " + " UNION ALL ".join(
    [
        f"SELECT 0 AS rule_no, 'RowCount' AS rule_type, CAST(count(*) AS DOUBLE) AS measured, {_NO_FAIL} AS failing_rows, count(*) BETWEEN floor(max(n) * 0.95::DOUBLE) AND ceil(max(n) * 1.05::DOUBLE) AS passed FROM b, o",
        f"SELECT 1, 'ColumnCount', 3.0, {_NO_FAIL}, FALSE",
        _judged(16, "IsComplete", "k IS NULL"),
        f"SELECT 17, 'IsPrimaryKey', round(count(DISTINCT k) / count(k), 6), {_NO_FAIL}, count(DISTINCT k) = count(*) FROM b",
        _judged(20, "ColumnValues", "NOT k BETWEEN klo AND khi"),
        _judged(22, "ColumnDataType", "FALSE"),
        _judged(32, "IsComplete", "s IS NULL"),
        _judged(34, "ColumnValues", "s NOT IN (SELECT DISTINCT o_orderstatus FROM orders)"),
        f"SELECT 35, 'DistinctValuesCount', CAST(count(DISTINCT s) AS DOUBLE), {_NO_FAIL}, count(DISTINCT s) BETWEEN 1 AND max(ds) FROM b, o",
        _judged(37, "ColumnLength", "NOT length(s) BETWEEN slo AND shi"),
        _judged(48, "IsComplete", "p IS NULL"),
        _judged(52, "ColumnValues", "NOT p BETWEEN plo AND phi"),
        _judged(54, "ColumnDataType", "FALSE"),
    ]
)


def _failing(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")["orders"].select("o_totalprice", "o_orderstatus")
    cheap = orders.filter("o_totalprice < 300000 AND o_orderstatus <> 'P'")
    rules = rl.derive_rules(pf.profile(cheap, SHAPE), "balanced", SHAPE)
    found = ev.failing_rows(load(spark, sf_dir, "orders")["orders"], rules)
    return found.select("o_orderkey", F.array_join(F.transform("broken_rules", lambda n: n.cast("string")), ",").alias("broken_rules"))


QUERIES["rows_breaking_rules"] = _failing
SQL["rows_breaking_rules"] = """
  WITH c AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_totalprice < 300000 AND o_orderstatus <> 'P'),
  r AS (SELECT floor(round(lo - (hi - lo) * 0.05::DOUBLE, 9) * 1000000) / 1000000 AS lo, ceil(round(hi + (hi - lo) * 0.05::DOUBLE, 9) * 1000000) / 1000000 AS hi FROM c),
  f AS (SELECT o_orderkey, NOT o_totalprice BETWEEN lo AND hi AS far, o_orderstatus = 'P' AS unknown FROM orders, r)
  SELECT o_orderkey, concat_ws(',', CASE WHEN far THEN '20' END, CASE WHEN unknown THEN '34' END) AS broken_rules FROM f WHERE far OR unknown"""


# --- sources --------------------------------------------------------------------------------------


def _head(spark, sf_dir):
    return tb.head(load(spark, sf_dir, "orders")["orders"], 500, "o_orderdate", "o_orderkey").select("o_orderkey", "o_totalprice")


QUERIES["first_rows"] = _head
SQL["first_rows"] = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 500"


def _head_of_files(spark, sf_dir, write="parquet", suffix=".parquet"):
    """A folder of three files, the first by name the smallest; each holds its orders by key."""
    path = scratch(spark) + suffix
    key = F.col("o_orderkey")
    small_first = F.when(key < 100, "a").when(key < 1000, "b").otherwise("c").alias("part")
    rows = load(spark, sf_dir, "orders")["orders"].select("o_orderkey", "o_totalprice", small_first)
    dealt = rows.repartition("part").sortWithinPartitions("part", "o_orderkey")
    dealt.write.partitionBy("part").option("header", True).format(write).save(path)
    return tb.read_table(spark, path, sample=500).table.select("o_orderkey", "o_totalprice")


def _head_of_text_files(spark, sf_dir):
    return _head_of_files(spark, sf_dir, "csv", ".csv")


QUERIES["first_rows_of_files"] = _head_of_files
SQL["first_rows_of_files"] = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500"
QUERIES["first_rows_of_text_files"] = _head_of_text_files
SQL["first_rows_of_text_files"] = SQL["first_rows_of_files"]


def _csv(spark, sf_dir):
    """Writes the customers as delimited text, then reads and profiles them like any such file."""
    path = scratch(spark) + ".tsv"
    rows = load(spark, sf_dir, "customer")["customer"]
    rows = rows.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 50 != 0, F.col("c_mktsegment")))
    rows.write.option("sep", "\t").option("header", True).csv(path)
    loaded = tb.read_table(spark, path)
    return pf.profile(loaded.table, SHAPE, loaded.sampled, loaded.total_row_count).select(
        "name", "kind", "source_type", "row_count", "null_count", "distinct_count", "min_length", "max_length", "sampled", "total_row_count"
    )


QUERIES["delimited_text_profile"] = _csv
SQL["delimited_text_profile"] = "WITH s AS (SELECT * REPLACE (CASE WHEN c_custkey % 50 <> 0 THEN c_mktsegment ELSE '' END AS c_mktsegment) FROM customer) " + " UNION ALL ".join(
    f"SELECT '{c}' AS name, '{k}' AS kind, '{t}' AS source_type, count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, "
    + (f"CAST(min(length({c})) AS INT) AS min_length, CAST(max(length({c})) AS INT) AS max_length" if k == "string" else "CAST(NULL AS INT) AS min_length, CAST(NULL AS INT) AS max_length")
    + ", FALSE AS sampled, count(*) AS total_row_count FROM s"
    for c, k, t in (("c_custkey", "integer", "int64"), ("c_name", "string", "string"), ("c_nationkey", "integer", "int64"), ("c_acctbal", "float", "double"), ("c_mktsegment", "string", "string"))
)


def _sampled(spark, sf_dir):
    """A sample of a Parquet table: the full count is known, and the rules say so."""
    loaded = tb.read_table(spark, f"{sf_dir}/orders.parquet", 100, ("o_orderkey",))
    profiled = pf.profile(loaded.table, SHAPE, loaded.sampled, loaded.total_row_count)
    return rl.derive_rules(profiled, "balanced", SHAPE).filter("column IS NULL OR column = 'o_orderkey'").select("rule_text", "evidence")


QUERIES["sampled_rules"] = _sampled
SQL["sampled_rules"] = """
  WITH t AS (SELECT count(*) AS n FROM orders), s AS (SELECT o_orderkey AS k FROM orders ORDER BY o_orderkey LIMIT 100),
  m AS (SELECT min(k) AS lo, max(k) AS hi, max(n) AS n, ' [sample: 100 rows out of ' || format('{:,}', max(n)) || ']' AS tail FROM s, t)
  SELECT 'RowCount between ' || CAST(floor(n * 0.8::DOUBLE) AS BIGINT) || ' and ' || CAST(ceil(n * 1.2::DOUBLE) AS BIGINT) AS rule_text, 'table size when profiled: ' || format('{:,}', n) || '; balanced tolerance of plus or minus 20%' AS evidence FROM m
  UNION ALL SELECT 'ColumnCount = 6', 'width when profiled: 6'
  UNION ALL SELECT 'IsComplete "o_orderkey"', 'every one of 100 rows has a value' || tail FROM m
  UNION ALL SELECT 'IsPrimaryKey "o_orderkey"', 'key candidate: each of 100 rows has its own value' || tail FROM m
  UNION ALL SELECT 'ColumnValues "o_orderkey" between ' || CAST(floor(lo - (hi - lo) * 0.05::DOUBLE) AS BIGINT) || ' and ' || CAST(ceil(hi + (hi - lo) * 0.05::DOUBLE) AS BIGINT), 'seen from ' || lo || ' up to ' || hi || '; balanced tolerance adds 5% on both ends' || tail FROM m
  UNION ALL SELECT 'ColumnDataType "o_orderkey" = "Long"', 'stored type: int64' || tail FROM m"""


def _profile_document(spark, sf_dir):
    profiled = pf.profile(table(spark, sf_dir, "gaps"), SHAPE)
    document = F.col("document")
    columns = F.transform(document["columns"], lambda c: F.concat_ws(":", c["name"], c["kind"], c["null_count"].cast("string")))
    rules = F.transform(document["rules"], lambda r: r["rule_text"])
    return documents.profile_document(profiled, rl.derive_rules(profiled, "balanced", SHAPE)).select(
        document["row_count"].alias("row_count"), F.array_join(columns, "|").alias("columns"), F.array_join(rules, "|").alias("rules")
    )


QUERIES["profile_document"] = _profile_document
SQL["profile_document"] = (
    f"WITH {rules_sql('gaps', 'balanced')} SELECT max(row_count) AS row_count, string_agg(name || ':' || kind || ':' || null_count, '|' ORDER BY column_no) AS columns, "
    "(SELECT string_agg(rule_text, '|' ORDER BY rule_no) FROM rules) AS rules FROM prof"
)
