"""SQL for the checking engine, one text per query where SQL can say the same."""

from __future__ import annotations

from tablescope.functions import vocabulary as V

from .fixtures import DIRTY, with_dirty

ORACLES: dict[str, str] = {}

TOKENS = ", ".join("'" + t.replace("'", "''") + "'" for t in V.NULL_TOKENS)


def rnd(x: str, digits: int) -> str:
    return f"(round({x}, {digits}) + 0.0::DOUBLE)"


def even(x: str, digits: int) -> str:
    return f"(round_even(({x})::DOUBLE, {digits}) + 0.0::DOUBLE)"


def pct(part: str, whole: str, digits: int) -> str:
    return f"(CASE WHEN {whole} > 0 THEN {even(f'({part})::DOUBLE / ({whole}) * 100', digits)} ELSE 0.0::DOUBLE END)"


def big(x: str) -> str:
    return f"({x})::BIGINT"


def money(x: str) -> str:
    return f"concat('$', format('{{:,.2f}}', {even(x, 2)}))"


def no_token(c: str) -> str:
    return f"CASE WHEN {c} IN ({TOKENS}) THEN NULL ELSE {c} END"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# dirty_orders as the loader leaves it: tokens gone, text dates converted.
CLEAN_ORDERS = f"""clean AS (SELECT o_orderkey, o_custkey, total_amount, payout_value, priority_label,
 CAST(try_strptime(order_date_text, '%Y-%m-%d') AS TIMESTAMP) AS order_date_text,
 {no_token('order_status')} AS order_status, posted_at FROM dirty_orders)"""


def clean_orders(body: str) -> str:
    return f"WITH dirty_orders AS ({DIRTY['dirty_orders']}),\n{CLEAN_ORDERS}\n{body}"


# --- Loading and saving -----------------------------------------------------------------

ORACLES["header_trim"] = "SELECT * FROM customer"
ORACLES["null_tokens"] = with_dirty(
    "dirty_orders", f"SELECT o_orderkey, {no_token('order_date_text')} AS order_date_text, {no_token('order_status')} AS order_status FROM dirty_orders"
)
ORACLES["infer_types"] = with_dirty(
    "dirty_orders",
    f"""SELECT o_orderkey, o_custkey, total_amount, payout_value, priority_label, {no_token('order_date_text')} AS order_date_text,
 {no_token('order_status')} AS order_status, CAST(posted_at AS VARCHAR) AS posted_at FROM dirty_orders""",
)
ORACLES["infer_wide_ids"] = """SELECT o_orderkey, CAST('1' || lpad(CAST(o_orderkey AS VARCHAR), 18, '0') AS BIGINT) AS id_19,
 '1' || lpad(CAST(o_orderkey AS VARCHAR), 21, '0') AS id_22, o_orderkey AS signed, o_orderkey + 0.5::DOUBLE AS number, o_orderkey % 2 = 0 AS flag,
 NULL::DOUBLE AS nothing, CAST(o_orderkey AS VARCHAR) || 'x' AS word FROM orders"""
ORACLES["date_formats"] = """SELECT o_orderkey, o_orderdate AS iso_zone, o_orderdate - INTERVAL 2 HOUR AS iso_offset, o_orderdate AS day_first, o_orderdate AS month_first,
 o_orderdate AS half_day, o_orderdate AS full_month, o_orderdate AS short_month, o_orderdate AS dotted, o_orderdate AS german, o_orderdate AS day_dash,
 o_orderdate AS two_digits, o_orderdate AS compact FROM orders"""
ORACLES["explore_scatter"] = """SELECT l_quantity, l_extendedprice, l_returnflag FROM lineitem
 ORDER BY md5(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey), l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 5000"""
ORACLES["load_csv"] = clean_orders("SELECT * FROM clean")
ORACLES["export_csv"] = with_dirty("dirty_orders", "SELECT * FROM dirty_orders")
ORACLES["display_projection"] = "SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate) FROM orders"
ORACLES["preview"] = "SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate) FROM orders ORDER BY o_orderkey LIMIT 10"
DIRTY_ORDER_COLUMNS = "o_orderkey o_custkey total_amount payout_value priority_label order_date_text order_status posted_at".split()
ORACLES["table_delta"] = with_dirty(
    "dirty_orders",
    f"""SELECT a.n AS rows_original, b.n AS rows_now, a.n - b.n AS rows_removed, 8::BIGINT AS columns_now, b.cells AS missing_cells
 FROM (SELECT count(*) AS n FROM dirty_orders) a,
 (SELECT count(*) AS n, ({' + '.join(f'count(*) - count({c})' for c in DIRTY_ORDER_COLUMNS)})::BIGINT AS cells
  FROM dirty_orders WHERE total_amount IS NOT NULL) b""",
)

# --- Filters and predicates -----------------------------------------------------------------

ORACLES["missing_by_column"] = with_dirty(
    "dirty_orders",
    union(
        [
            f"SELECT {i}::INT AS ordinal, '{c}' AS \"column\", count(*) - count({c}) AS missing, {pct(f'count(*) - count({c})', 'count(*)', 1)} AS missing_pct FROM dirty_orders"
            for i, c in enumerate(DIRTY_ORDER_COLUMNS)
        ]
    ),
)
ORACLES["plausible_dates"] = """SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
 WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderdate <= TIMESTAMP '2001-06-30'"""
ORACLES["dup_preview"] = with_dirty(
    "numbered_customer",
    """, marked AS (SELECT *, count(*) OVER (PARTITION BY c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment) AS copies FROM numbered_customer)
 SELECT * EXCLUDE (copies) FROM marked WHERE copies > 1
 ORDER BY c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, row_id LIMIT 50""",
)


def numbers(table: str, columns: list[tuple[int, str]]) -> str:
    """CTE body: statistics of numeric columns, one row each, as (ordinal, column, ...)."""
    parts = []
    for i, c in columns:
        x = f"({c})::DOUBLE"
        parts.append(
            f"""SELECT {i}::INT AS ordinal, '{c}' AS "column", s.*,
 (SELECT count(*) FROM {table} WHERE {x} < s.q1 - 1.5 * (s.q3 - s.q1) OR {x} > s.q3 + 1.5 * (s.q3 - s.q1)) AS outliers
 FROM (SELECT count(*) AS n_rows, count({c}) AS present, count(*) - count({c}) AS missing,
  CASE WHEN count({c}) < 3 THEN NULL ELSE coalesce(skewness({x}), 0) END AS skew,
  quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS median, quantile_cont({x}, 0.75) AS q3, quantile_cont({x}, 0.99) AS p99,
  min({x}) AS low, max({x}) AS high, avg({x}) AS mean, sum({x}) AS total, count(*) FILTER (WHERE {x} = 0) AS zeros FROM {table}) s"""
        )
    return union(parts)


LINE_NUMBERS = list(enumerate("l_orderkey l_linenumber l_quantity l_discount l_extendedprice".split()))
LINE_STATS = f", stats AS ({numbers('dirty_lineitem', LINE_NUMBERS)})"
OUTLIER_PCT = pct("outliers", "present", 1)
LOWER, UPPER = "(q1 - 1.5 * (q3 - q1))", "(q3 + 1.5 * (q3 - q1))"
EXTREME = "(p99 > 0 AND high > 10 * p99)"
HEALTH = f"""ordinal, "column", {even('skew', 2)} AS skewness, coalesce(abs(skew) >= 1, false) AS is_highly_skewed,
 outliers AS outlier_count, {OUTLIER_PCT} AS outlier_pct, {OUTLIER_PCT} > 5 AS has_many_outliers,
 {even(LOWER, 2)} AS lower_fence, {even(UPPER, 2)} AS upper_fence, {even('p99', 2)} AS p99, {even('high', 2)} AS max_value,
 {EXTREME} AS is_extreme, least(10::DOUBLE, {OUTLIER_PCT} * 0.5::DOUBLE) AS outlier_penalty"""
ORACLES["numeric_health"] = with_dirty("dirty_lineitem", LINE_STATS + f" SELECT {HEALTH} FROM stats WHERE present > 0")
ORACLES["iqr_outliers"] = with_dirty(
    "dirty_lineitem",
    LINE_STATS
    + f""", health AS (SELECT {HEALTH} FROM stats WHERE present > 0)
 SELECT "column", outlier_count, outlier_pct, has_many_outliers, lower_fence, upper_fence, outlier_penalty FROM health""",
)
ORACLES["column_skew"] = with_dirty(
    "dirty_lineitem", LINE_STATS + f' SELECT "column", {rnd("skew", 6)} AS skewness, abs(skew) >= 1 AS is_highly_skewed FROM stats'
)
ORACLES["p99_cap"] = with_dirty(
    "dirty_lineitem",
    """, s AS (SELECT quantile_cont(l_extendedprice, 0.99) AS p99, max(l_extendedprice) AS high FROM dirty_lineitem),
 k AS (SELECT count(*) AS present, count(*) FILTER (WHERE NOT (s.p99 > 0 AND s.high > 10 * s.p99) OR l_extendedprice <= s.p99) AS kept
  FROM dirty_lineitem, s WHERE l_extendedprice IS NOT NULL)
 SELECT round(p99, 4) AS p99, round(high, 2) AS max_value, (p99 > 0 AND high > 10 * p99) AS is_extreme, kept, present - kept AS excluded FROM s, k""",
)
ORACLES["drop_column"] = "SELECT * EXCLUDE (o_totalprice) FROM orders"
ORACLES["rename_column"] = 'SELECT * RENAME (o_totalprice AS "total price") FROM orders'

# --- Column classification -------------------------------------------------------------------

SCHEMAS = {
    "dirty_orders": "o_orderkey:number o_custkey:number total_amount:number payout_value:number priority_label:text order_date_text:text order_status:text posted_at:date",
    "dirty_profile": "o_orderkey:number size_label:text sparse_amount:number constant_flag:text day_label:text band_label:text is_even:number claim_outcome:text settlement_fee:number",
    "lineitem": "l_orderkey:number l_partkey:number l_suppkey:number l_linenumber:number l_quantity:number l_extendedprice:number l_discount:number l_tax:number l_returnflag:text l_linestatus:text l_shipdate:date",
    "part": "p_partkey:number p_name:text p_brand:text p_type:text p_size:number p_retailprice:number",
    "events": "event_id:number ts:date user_id:number event_type:text value:number props:text",
    "documents": "doc_id:number text:text lang:text source:text n_chars:number",
    "embeddings": "vec_id:number embedding:nested label:number",
}
ALL_FORMATS = {"yyyy-M-d": "%Y-%m-%d", "yyyy-M-d H:m:s": "%Y-%m-%d %H:%M:%S", "yyyy/M/d": "%Y/%m/%d", "M/d/yyyy": "%m/%d/%Y", "yyyyMMdd": "%Y%m%d"}


def named(name: str, words: tuple[str, ...]) -> str:
    return f"regexp_matches(lower('{name}'), '{'|'.join(words)}')"


def semantic_type(name: str, kind: str) -> str:
    """Aggregate expression that gives the detected type of a column."""
    if kind in ("date", "nested"):
        return f"CASE WHEN count(*) >= 0 THEN '{'date_column' if kind == 'date' else 'nested'}' END"
    value = no_token(name) if kind == "text" else name
    unique = f"count(DISTINCT {value}) >= 0.90 * count({value}) AND count({value}) > 0"
    identifier = f"WHEN {named(name, V.ID_KEYWORDS)} AND {unique} THEN 'id_column'"
    if kind == "number":
        return f"CASE {identifier} WHEN {named(name, V.FINANCIAL_KEYWORDS)} THEN 'financial' ELSE 'metric' END"
    strict, other = (f"count(try_strptime({value}, '{f}'))" for f in ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S"))
    best = f"CASE WHEN {strict} >= 0.5 * count(*) THEN {strict} ELSE {other} END"
    return f"""CASE WHEN {named(name, V.DATE_KEYWORDS)} AND ({best}) >= 0.7 * count(*) AND count(*) > 0 THEN 'date_column' {identifier}
 WHEN count(DISTINCT {value}) <= 50 THEN 'categorical' WHEN {named(name, V.TEXT_KEYWORDS)} THEN 'text' ELSE 'high_cardinality' END"""


def type_rows(table: str) -> list[str]:
    rows = []
    for i, field in enumerate(SCHEMAS[table].split()):
        name, kind = field.split(":")
        rows.append(f"SELECT '{table}' AS table_name, {i}::INT AS ordinal, '{name}' AS \"column\", {semantic_type(name, kind)} AS semantic_type FROM {table}")
    return rows


ORACLES["column_types"] = with_dirty("dirty_orders dirty_profile", union([r for t in SCHEMAS for r in type_rows(t)]))
ORACLES["type_summary"] = with_dirty(
    "dirty_orders", f", t AS ({union(type_rows('dirty_orders'))}) SELECT semantic_type, count(*) AS columns FROM t GROUP BY ALL"
)
LABEL = "CASE semantic_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.TYPE_LABELS.items()) + " ELSE 'Other' END"
ORACLES["column_inventory"] = clean_orders(
    f""", t AS ({union(type_rows('dirty_orders'))}),
 u AS ({union([f"SELECT '{c}' AS c, count(DISTINCT {c}) AS d, count(*) - count({c}) AS m FROM clean" for c in DIRTY_ORDER_COLUMNS])})
 SELECT ordinal, "column", {LABEL} AS detected_as, d AS unique_values, m AS missing FROM t JOIN u ON c = "column" """
)
ORACLES["date_convert"] = with_dirty(
    "dirty_orders", "SELECT o_orderkey, CAST(try_strptime(order_date_text, '%Y-%m-%d') AS TIMESTAMP) AS order_date_text FROM dirty_orders"
)


def expected_type(name: str, kind: str) -> str:
    tail = f"WHEN count(DISTINCT {name}) >= 0.95 * count({name}) THEN 'id_column' ELSE 'categorical' END"
    if kind == "boolean":
        return f"CASE WHEN count({name}) = 0 THEN 'categorical' {tail}"
    digits = f"abs({name}) < 1e16 AND ({name} = 0 OR abs({name}) >= 1e-4)" if kind == "number" else f"regexp_matches({name}, '^-?\\d+(\\.\\d+)?$')"
    cash = "0" if kind == "number" else f"count(*) FILTER (WHERE regexp_matches({name}, '\\$|,'))"
    dates = "0" if kind == "number" else f"count(try_strptime({name}, '%Y-%m-%d'))"
    return f"""CASE WHEN count({name}) = 0 THEN 'categorical' WHEN count(*) FILTER (WHERE {digits}) >= 0.85 * count({name}) THEN 'metric'
 WHEN {cash} >= 0.60 * count({name}) THEN 'financial' WHEN {dates} >= 0.75 * count({name}) THEN 'date_column' {tail}"""


def expected_rows() -> str:
    rows = []
    for i, field in enumerate(SCHEMAS["dirty_profile"].split()):
        name, kind = field.split(":")
        kind = "boolean" if name == "is_even" else kind
        rows.append(f"SELECT {i}::INT AS ordinal, '{name}' AS \"column\", {expected_type(name, kind)} AS expected, 100.0 * (count(*) - count({name})) / count(*) AS missing_pct, count(DISTINCT {name}) AS d FROM dirty_profile")
    return union(rows)


ORACLES["expected_types"] = with_dirty("dirty_profile", f', e AS ({expected_rows()}) SELECT ordinal, "column", expected FROM e')
ORACLES["recommendations"] = with_dirty(
    "dirty_profile",
    f""", e AS ({expected_rows()}), t AS ({union(type_rows('dirty_profile'))}),
 r AS (SELECT e.ordinal, e."column", semantic_type AS detected, expected,
  CASE WHEN d <= 1 THEN 'Column has only one unique value. Consider removing.'
   WHEN missing_pct >= 30 THEN concat('Column is ', {even('missing_pct', 1)}, '% missing. Consider filling or removing.')
   WHEN semantic_type = 'categorical' AND expected IN ('metric', 'financial') THEN 'Values appear numeric but are stored as text. Consider converting to numeric.'
   WHEN semantic_type = 'categorical' AND expected = 'date_column' THEN 'Values appear to be dates. Consider converting to datetime.'
   WHEN semantic_type = 'metric' AND expected = 'id_column' THEN 'High uniqueness suggests this is an identifier. Consider excluding from analysis.'
  END AS recommendation FROM e JOIN t ON e."column" = t."column")
 SELECT * FROM r WHERE recommendation IS NOT NULL""",
)

# --- Quality ---------------------------------------------------------------------------------------


def missing_summary(table: str, columns: list[str]) -> str:
    """CTE texts ``cells`` and ``missing`` (one row)."""
    rows = union([f"SELECT {i} AS ordinal, '{c}' AS c, count(*) - count({c}) AS m, count(*) AS n FROM {table}" for i, c in enumerate(columns)])
    shares = pct("sum(m)", "sum(n)", 4)
    return f""", cells AS ({rows}), missing AS (SELECT *, {even('least(30::DOUBLE, missing_pct * 10)', 2)} AS penalty FROM (
 SELECT {big('sum(m)')} AS total_missing, {shares} AS missing_pct, count(*) FILTER (WHERE m > 0) AS cols_affected,
  CASE WHEN max(m) > 0 THEN (SELECT c FROM cells ORDER BY m DESC, ordinal LIMIT 1) END AS worst_col,
  {pct('max(m)', 'max(n)', 1)} AS worst_col_pct FROM cells))"""


def duplicate_summary(table: str) -> str:
    return f""", copies AS (SELECT *, {even('least(20::DOUBLE, duplicate_pct * 4)', 2)} AS penalty FROM (
 SELECT n - u AS n_duplicates, {pct('n - u', 'n', 2)} AS duplicate_pct, n FROM
 (SELECT count(*) AS n FROM {table}), (SELECT count(*) AS u FROM (SELECT DISTINCT * FROM {table}))))"""


ORACLES["quality_missing"] = with_dirty("dirty_orders", missing_summary("dirty_orders", DIRTY_ORDER_COLUMNS) + " SELECT * FROM missing")
ORACLES["quality_duplicates"] = with_dirty("dirty_customer", duplicate_summary("dirty_customer") + " SELECT * EXCLUDE (n) FROM copies")
LINE_COLUMNS = "l_orderkey l_linenumber l_quantity l_discount l_extendedprice l_returnflag l_shipdate".split()


def scored(table: str, numeric: list[tuple[int, str]], columns: list[str]) -> str:
    """CTE texts from column statistics to ``graded`` (one row)."""
    return (
        f", stats AS ({numbers(table, numeric)})"
        + missing_summary(table, columns)
        + duplicate_summary(table)
        + f""", health AS (SELECT {HEALTH} FROM stats WHERE present > 0),
 points AS (SELECT coalesce(count(*) FILTER (WHERE is_highly_skewed) * 5, 0)::DOUBLE AS skew_penalty,
  {even('least(10::DOUBLE, coalesce(sum(outlier_penalty), 0))', 2)} AS outlier_penalty FROM health),
 scored AS (SELECT copies.n AS n_rows, {len(columns)}::BIGINT AS n_cols, missing.penalty AS missing_penalty, copies.penalty AS duplicate_penalty, skew_penalty, outlier_penalty,
  greatest(0::DOUBLE, least(100::DOUBLE, {even('100 - (missing.penalty + copies.penalty + skew_penalty + outlier_penalty)', 1)})) AS score
  FROM missing, copies, points),
 graded AS (SELECT *, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 60 THEN 'Fair' ELSE 'Needs Work' END AS grade FROM scored)"""
    )


def level(share: str) -> str:
    return f"CASE WHEN {share} < 5 THEN 'warning' ELSE 'problem' END"


FINDINGS = f"""SELECT 1::INT AS section, 0::INT AS ordinal, CASE WHEN total_missing = 0 THEN 'good' ELSE {level('missing_pct')} END AS level,
  CASE WHEN total_missing = 0 THEN 'No missing values — your data is complete.' ELSE concat(format('{{:,}}', total_missing), ' missing values found across ',
   cols_affected, ' column(s). The most affected column is ''', worst_col, ''' (', worst_col_pct, '% empty). Fill or remove them before analysis.') END AS message FROM missing
 UNION ALL SELECT 2, 0, CASE WHEN n_duplicates = 0 THEN 'good' ELSE {level('duplicate_pct')} END,
  CASE WHEN n_duplicates = 0 THEN 'No duplicate rows found.' ELSE concat(format('{{:,}}', n_duplicates), ' duplicate rows detected (', duplicate_pct,
   '% of your data). These are identical copies that can skew your results.') END FROM copies
 UNION ALL SELECT 3, 0, 'warning', concat('Some numeric columns have very uneven value distributions: ', string_agg(concat('''', "column", ''''), ', ' ORDER BY ordinal),
   '. Most values are clustered at one end while a few are extreme.') FROM health WHERE is_highly_skewed HAVING count(*) > 0
 UNION ALL SELECT 4, ordinal, 'warning', concat('''', "column", ''' contains extreme values — the largest value (', format('{{:,.0f}}', {even('max_value', 0)}),
   ') is far above the typical range.') FROM health WHERE is_extreme
 UNION ALL SELECT 5, ordinal, 'warning', concat('''', "column", ''' has ', outlier_pct, '% of values outside the normal range (', format('{{:,}}', outlier_count),
   ' values). These may be legitimate but are worth reviewing.') FROM health WHERE has_many_outliers AND NOT is_extreme"""
LINE_SCORED = scored("dirty_lineitem", LINE_NUMBERS, LINE_COLUMNS)
ORACLES["quality_score"] = with_dirty("dirty_lineitem", LINE_SCORED + " SELECT * FROM graded")
ORACLES["quality_findings"] = with_dirty("dirty_lineitem", LINE_SCORED + " " + FINDINGS)
ORACLES["column_health"] = with_dirty(
    "dirty_lineitem",
    LINE_STATS
    + f""" SELECT ordinal, "column", CASE WHEN "column" IN ('l_discount', 'l_extendedprice') THEN 'Financial Amount' ELSE 'Numeric Measurement' END AS type,
 missing, {pct('missing', 'n_rows', 1)} AS missing_pct, outliers, {OUTLIER_PCT} AS outlier_pct,
 CASE WHEN abs(skew) < 0.5 THEN 'Even' WHEN abs(skew) < 1 THEN 'Slightly Uneven' ELSE 'Very Uneven' END AS value_spread,
 CASE WHEN {pct('missing', 'n_rows', 1)} > 20 OR {OUTLIER_PCT} > 15 THEN 'Needs Attention' WHEN abs(skew) >= 1 THEN 'Acceptable' ELSE 'Healthy' END AS status FROM stats""",
)

# --- Cleaning -----------------------------------------------------------------------------------------

ORACLES["remove_duplicates"] = with_dirty("dirty_customer", "SELECT DISTINCT * FROM dirty_customer")
for key, value in (("fill_mean", "avg(total_amount)"), ("fill_median", "quantile_cont(total_amount, 0.5)")):
    ORACLES[key] = with_dirty(
        "dirty_orders", f"SELECT o_orderkey, {rnd(f'coalesce(total_amount, (SELECT {value} FROM dirty_orders))', 4)} AS total_amount FROM dirty_orders"
    )
for key, column in (("fill_mode", "priority_label"), ("fill_mode_date", "posted_at")):
    ORACLES[key] = with_dirty(
        "dirty_orders",
        f"""SELECT o_orderkey, coalesce({column}, (SELECT {column} FROM dirty_orders WHERE {column} IS NOT NULL
 GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)) AS {column} FROM dirty_orders""",
    )
ORACLES["fill_constant"] = with_dirty("dirty_orders", "SELECT o_orderkey, coalesce(total_amount, 0::DOUBLE) AS total_amount FROM dirty_orders")
ORACLES["drop_missing_col"] = with_dirty("dirty_orders", "SELECT * FROM dirty_orders WHERE total_amount IS NOT NULL")
ORACLES["drop_missing_any"] = with_dirty(
    "dirty_orders", "SELECT * FROM dirty_orders WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in DIRTY_ORDER_COLUMNS)
)
TRIMMED = "regexp_replace(priority_label, '^\\s+|\\s+$', '', 'g')"
TITLE = """array_to_string([CASE WHEN i > 1 AND regexp_matches(priority_label[i-1:i-1], '\\p{L}') THEN lower(priority_label[i:i])
 ELSE upper(priority_label[i:i]) END for i in range(1, length(priority_label) + 1)], '')"""
for key, value in (("trim_text", TRIMMED), ("case_title", TITLE), ("case_lower", "lower(priority_label)"), ("case_upper", "upper(priority_label)")):
    ORACLES[key] = with_dirty("dirty_orders", f"SELECT o_orderkey, {value} AS priority_label FROM dirty_orders")
ORACLES["currency_to_number"] = with_dirty(
    "dirty_money",
    """, t AS (SELECT o_orderkey, trim(amount_text) AS a FROM dirty_money),
 d AS (SELECT o_orderkey, CASE WHEN a LIKE '(%)' THEN '-' ELSE '' END || regexp_replace(a, '[$,€£¥\\s()]', '', 'g') AS b FROM t)
 SELECT o_orderkey, CASE WHEN regexp_matches(b, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN try_cast(b AS DOUBLE) END AS amount_text FROM d""",
)

# --- Transforms -------------------------------------------------------------------------------------------

ORACLES["log_transform"] = with_dirty("dirty_orders", f"SELECT o_orderkey, payout_value, {rnd('ln(1 + payout_value)', 6)} AS payout_value_log FROM dirty_orders")
ORACLES["log_skew"] = with_dirty(
    "dirty_orders",
    f"""SELECT 'payout_value' AS "column", {rnd('skewness(payout_value)', 6)} AS skewness FROM dirty_orders
 UNION ALL SELECT 'payout_value_log', {rnd('skewness(ln(1 + payout_value))', 6)} FROM dirty_orders""",
)
ORACLES["standard_scale"] = with_dirty(
    "dirty_orders",
    f""", s AS (SELECT avg(coalesce(total_amount, 0)) AS m, stddev_pop(coalesce(total_amount, 0)) AS d FROM dirty_orders)
 SELECT o_orderkey, total_amount, {rnd('(coalesce(total_amount, 0) - m) / CASE WHEN d = 0 THEN 1 ELSE d END', 6)} AS total_amount_scaled FROM dirty_orders, s""",
)
ORACLES["minmax_scale"] = with_dirty(
    "dirty_orders",
    f""", s AS (SELECT min(coalesce(total_amount, 0)) AS lo, max(coalesce(total_amount, 0)) AS hi FROM dirty_orders)
 SELECT o_orderkey, total_amount, {rnd('(coalesce(total_amount, 0) - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END', 6)} AS total_amount_minmax FROM dirty_orders, s""",
)
ORACLES["one_hot"] = with_dirty(
    "dirty_orders",
    "SELECT o_orderkey, " + ", ".join(f"(order_status = '{v}')::INT AS \"order_status_{v}\"" for v in "FOP") + " FROM dirty_orders",
)
ORACLES["date_parts"] = with_dirty(
    "dirty_orders",
    """SELECT o_orderkey, posted_at, year(posted_at)::INT AS posted_at_year, month(posted_at)::INT AS posted_at_month, day(posted_at)::INT AS posted_at_day
 FROM dirty_orders""",
)

# --- Aggregates and insights ---------------------------------------------------------------------------------

ORACLES["value_counts"] = with_dirty(
    "dirty_orders", 'SELECT priority_label AS value, count(*) AS "count" FROM dirty_orders WHERE priority_label IS NOT NULL GROUP BY 1'
)


def granularity(days: str) -> str:
    return f"CASE WHEN {days} > 730 THEN 'yearly' WHEN {days} > 60 THEN 'monthly' ELSE 'daily' END"


ORACLES["time_granularity"] = union(
    [
        f"""SELECT first_date, last_date, date_sub('day', first_date, last_date) AS span_days, {granularity("date_sub('day', first_date, last_date)")} AS granularity,
 '{t}' AS source FROM (SELECT min({c}) AS first_date, max({c}) AS last_date FROM {t})"""
        for t, c in (("orders", "o_orderdate"), ("events", "ts"))
    ]
)
PERIODS = {"yearly": "year({})::INT", "monthly": "date_trunc('month', {})::TIMESTAMP", "daily": "date_trunc('day', {})::TIMESTAMP"}


def periods(table: str, date: str, value: str, unit: str, where: str = "true") -> str:
    return f"""SELECT {PERIODS[unit].format(date)} AS period, avg({value}) AS mean, count(*) AS "count" FROM {table}
 WHERE {date} IS NOT NULL AND {value} IS NOT NULL AND {where} GROUP BY 1"""


def trend(table: str, date: str, value: str, unit: str) -> str:
    return f"SELECT period, {rnd('mean', 4)} AS mean, \"count\" FROM ({periods(table, date, value, unit)})"


ORACLES["trend_yearly"] = with_dirty("dirty_orders", trend("dirty_orders", "posted_at", "total_amount", "yearly"))
ORACLES["trend_monthly"] = with_dirty("dirty_orders", trend("dirty_orders", "posted_at", "total_amount", "monthly"))
ORACLES["trend_daily"] = trend("events", "ts", "value", "daily")


def headline(table: str, date: str, value: str, unit: str, where: str = "true") -> str:
    """One row with the numbers and sentences of a trend."""
    label = "period::VARCHAR" if unit == "yearly" else "strftime(period, '%b %Y')"
    size = f"format('{{:.0f}}', {even('abs(pct_change)', 0)})"
    return f"""(WITH p AS ({periods(table, date, value, unit, where)}),
 f AS (SELECT count(*) AS periods, (SELECT {label} FROM p ORDER BY "count" DESC, period LIMIT 1) AS peak_label, max("count") AS peak_count,
  (SELECT "count" FROM p ORDER BY period LIMIT 1) AS first_count, (SELECT "count" FROM p ORDER BY period DESC LIMIT 1) AS last_count,
  avg(mean) AS average, sum(mean * "count") / sum("count") AS row_average FROM p),
 g AS (SELECT *, (last_count - first_count) / first_count::DOUBLE * 100 AS pct_change FROM f)
 SELECT periods, peak_label, peak_count, first_count, last_count, {rnd('pct_change', 4)} AS pct_change, {rnd('average', 4)} AS average, {rnd('row_average', 4)} AS row_average,
  concat('Activity peaked in ', peak_label, ' with ', format('{{:,}}', peak_count), ' records and has ',
   CASE WHEN pct_change < -25 THEN concat('declined significantly (', {size}, '%) since then') WHEN pct_change < -10 THEN concat('trended downward (', {size}, '%) since then')
   WHEN pct_change > 25 THEN concat('grown significantly (', {size}, '%) since then') WHEN pct_change > 10 THEN concat('trended upward (', {size}, '%) since then')
   ELSE 'remained relatively stable' END, '.') AS headline,
  concat('The average {value} across the full period was ', {money('average')}, '.') AS detail, '{unit}' AS granularity FROM g WHERE periods >= 2)"""


ORACLES["trend_headline"] = with_dirty(
    "dirty_orders",
    union(
        "SELECT * FROM " + headline(*args)
        for args in (
            ("dirty_orders", "posted_at", "total_amount", "yearly"),
            ("dirty_orders", "posted_at", "payout_value", "monthly"),
            ("events", "ts", "value", "daily"),
        )
    ),
)
PLAUSIBLE = "order_date_text >= TIMESTAMP '2000-01-01' AND order_date_text <= TIMESTAMP '2024-12-31'"


def order_trend(unit: str) -> str:
    return f"""SELECT 'order_date_text' AS "column", 'total_amount' AS value_column, x.excluded_rows, h.*,
 concat('Note: ', format('{{:,}}', x.excluded_rows), ' rows with dates outside 2000–present were excluded.') AS note
 FROM {headline('clean', 'order_date_text', 'total_amount', unit, PLAUSIBLE)} h,
 (SELECT count(*) - count(*) FILTER (WHERE {PLAUSIBLE}) AS excluded_rows,
  date_sub('day', min(order_date_text) FILTER (WHERE {PLAUSIBLE} AND total_amount IS NOT NULL), max(order_date_text) FILTER (WHERE {PLAUSIBLE} AND total_amount IS NOT NULL)) AS days,
  count(*) FILTER (WHERE {PLAUSIBLE} AND total_amount IS NOT NULL) AS usable FROM clean) x
 WHERE usable >= 10 AND {granularity('days')} = '{unit}'"""


ORACLES["insight_trend"] = clean_orders(union(order_trend(unit) for unit in PERIODS))


def segment_rows(table: str, columns: list[str]) -> str:
    parts = []
    for i, c in enumerate(columns):
        counts = f'(SELECT {c}::VARCHAR AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1)'
        parts.append(
            f"""SELECT {i}::INT AS ordinal, '{c}' AS "column", k AS categories, t.v AS top_category, t.n AS top_count, {pct('t.n', 'r', 1)} AS top_pct,
 b.v AS bottom_category, b.n AS bottom_count, {pct('b.n', 'r', 1)} AS bottom_pct
 FROM (SELECT count(DISTINCT {c}) AS k, count(*) AS r FROM {table}), (SELECT * FROM {counts} ORDER BY n DESC, v LIMIT 1) t, (SELECT * FROM {counts} ORDER BY n, v DESC LIMIT 1) b WHERE k >= 2"""
        )
    return union(parts)


ORACLES["segments"] = clean_orders(segment_rows("clean", ["priority_label", "order_status"]))


def ratio_rows(table: str, columns: list[str], value: str) -> str:
    parts = []
    for i, c in enumerate(columns):
        means = f"(SELECT {c}::VARCHAR AS v, avg({value}) AS m FROM {table} WHERE {c} IS NOT NULL GROUP BY 1)"
        parts.append(
            f"""SELECT {i}::INT AS ordinal, '{c}' AS "column", t.v AS top_category, t.m AS top_avg, b.v AS bottom_category, b.m AS bottom_avg, t.m / b.m AS ratio
 FROM (SELECT * FROM {means} ORDER BY m DESC NULLS LAST, v LIMIT 1) t, (SELECT * FROM {means} ORDER BY m ASC NULLS FIRST, v DESC LIMIT 1) b,
 (SELECT count(DISTINCT {c}) AS k FROM {table}) WHERE k >= 2 AND b.m > 0 AND t.m / b.m >= 2"""
        )
    return union(parts)


ORACLES["segment_value_ratio"] = with_dirty(
    "dirty_profile",
    f""", r AS ({ratio_rows('dirty_profile', ['claim_outcome', 'constant_flag', 'band_label'], 'settlement_fee')})
 SELECT * REPLACE ({rnd('top_avg', 4)} AS top_avg, {rnd('bottom_avg', 4)} AS bottom_avg, {rnd('ratio', 4)} AS ratio) FROM r""",
)


def money_stats(table: str, columns: list[tuple[int, str]]) -> str:
    parts = []
    for i, c in columns:
        x = f"({c})::DOUBLE"
        parts.append(
            f"""SELECT {i}::INT AS ordinal, '{c}' AS "column", sum({x}) AS total, quantile_cont({x}, 0.5) AS median, avg({x}) AS mean, quantile_cont({x}, 0.99) AS p99, max({x}) AS max_value,
 count(*) FILTER (WHERE {x} = 0) AS n_zero, {pct(f'count(*) FILTER (WHERE {x} = 0)', f'count({c})', 1)} AS zero_pct,
 (quantile_cont({x}, 0.99) > 0 AND max({x}) > 10 * quantile_cont({x}, 0.99)) AS is_extreme,
 CASE WHEN {pct(f'count(*) FILTER (WHERE {x} = 0)', f'count({c})', 1)} > 40 THEN quantile_cont(CASE WHEN {x} > 0 THEN {x} END, 0.5) END AS median_positive, '{table}' AS table_name FROM {table}"""
        )
    return union(parts)


MONEY_STATS = union(
    [
        money_stats("dirty_orders", [(0, "total_amount"), (1, "payout_value")]),
        money_stats("dirty_profile", [(0, "sparse_amount"), (1, "settlement_fee")]),
        money_stats("dirty_lineitem", [(0, "l_discount"), (1, "l_extendedprice")]),
    ]
)
ORACLES["financial_summary"] = with_dirty(
    "dirty_orders dirty_profile dirty_lineitem",
    f", m AS ({MONEY_STATS}) SELECT * REPLACE ("
    + ", ".join(f"{rnd(c, 2 if c == 'total' else 4)} AS {c}" for c in ("total", "median", "mean", "p99", "max_value", "median_positive"))
    + ") FROM m",
)


def outcome_rows(table: str, column: str) -> str:
    return f"""SELECT {column} AS value, n AS "count", {pct('n', 'r', 1)} AS pct_of_rows
 FROM (SELECT {column}, count(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY 1), (SELECT count(*) AS r FROM {table})"""


ORACLES["outcome_breakdown"] = with_dirty("dirty_profile", outcome_rows("dirty_profile", "claim_outcome"))
TOP_PROPS = f"""top10 AS (SELECT props AS v, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, v LIMIT 10),
 best AS (SELECT props AS v, avg(value) AS m FROM events WHERE props IN (SELECT v FROM top10) GROUP BY 1 ORDER BY m DESC NULLS LAST, v LIMIT 1),
 leader AS (SELECT 0::INT AS ordinal, 'props' AS "column", t.v AS top_value, t.n AS top_count, {pct('t.n', 'r', 1)} AS top_pct, best.v AS best_value, best.m AS best_avg
  FROM (SELECT * FROM top10 ORDER BY n DESC, v LIMIT 1) t, best, (SELECT count(*) AS r FROM events))"""
ORACLES["topn_segments"] = f"WITH {TOP_PROPS} SELECT * REPLACE ({rnd('best_avg', 4)} AS best_avg) FROM leader"

# --- Insight sentences ----------------------------------------------------------------------------------------------


def whole(x: str) -> str:
    return f"format('{{:,.0f}}', {even(x, 0)})"


def outcome_sentences(table: str, column: str) -> str:
    listed = "(SELECT string_agg(concat('''', value, ''' ', pct_of_rows, '%'), ', ' ORDER BY \"count\" DESC, value) FROM (SELECT * FROM o ORDER BY \"count\" DESC, value LIMIT {}))"
    bad = f"regexp_matches(lower(value), '{'|'.join(V.NEGATIVE_OUTCOME_WORDS)}') AND pct_of_rows > 50"
    good = f"(SELECT {{}} FROM o WHERE regexp_matches(lower(value), '{'|'.join(V.POSITIVE_OUTCOME_WORDS)}') ORDER BY \"count\" DESC, value LIMIT 1)"
    return f"""SELECT * FROM (WITH o AS ({outcome_rows(table, column)})
 SELECT 1::INT AS section, 0::INT AS ordinal, 'outcome' AS kind, '{column}' AS "column",
  CASE WHEN {bad} THEN concat({whole('pct_of_rows')}, '% of records result in ''', value, ''' — the most common outcome by far.')
   ELSE concat('The most common {column} is ''', value, ''' (', {whole('pct_of_rows')}, '% of records).') END AS headline,
  CASE WHEN {bad} AND {good.format('1')} IS NOT NULL THEN concat('Only ', {whole(good.format('pct_of_rows'))}, '% of records result in ''', {good.format('value')},
    '''. The remaining ', {whole('100 - pct_of_rows - ' + good.format('pct_of_rows'))}, '% have other outcomes.')
   WHEN {bad} THEN concat('The full breakdown: ', {listed.format(4)}) ELSE concat('Full breakdown: ', {listed.format(5)}) END AS detail,
  NULL::VARCHAR AS note FROM o ORDER BY "count" DESC, value LIMIT 1)"""


def money_sentences(table: str, columns: list[tuple[int, str]]) -> str:
    return f"""SELECT 3 AS section, ordinal, 'financial' AS kind, "column",
 CASE WHEN zero_pct > 40 THEN concat({whole('zero_pct')}, '% of ', "column", ' values are $0 — meaning most records resulted in no payout.')
  WHEN is_extreme THEN concat('The total ', "column", ' across all records is ', {money('total')}, '. Most values are modest — the typical record is ', {money('median')}, '.')
  ELSE concat('The total ', "column", ' is ', {money('total')}, ', with a typical record value of ', {money('median')}, '.') END AS headline,
 CASE WHEN zero_pct > 40 THEN concat('Among records with a positive amount, the median is ', {money('median_positive')}, '. The total across all records is ', {money('total')}, '.')
  WHEN is_extreme THEN concat('However, a small number of extreme values (above ', {money('p99')}, ' at the 99th percentile) are pulling the average up to ', {money('mean')},
   '. The single largest value is ', {money('max_value')}, '.')
  ELSE concat('The average is ', {money('mean')}, ', and 99% of values fall below ', {money('p99')}, '.') END AS detail,
 NULL::VARCHAR AS note FROM ({money_stats(table, columns)})"""


def segment_sentences(table: str, columns: list[str], value: str) -> str:
    ratio = "s.top_count / s.bottom_count::DOUBLE"
    return f"""SELECT 4 AS section, s.ordinal, 'segment' AS kind, s."column",
 CASE WHEN top_pct >= 75 THEN concat('''', s.top_category, ''' dominates — it accounts for ', {whole('top_pct')}, '% of all ', s."column", ' records.')
  WHEN top_pct >= 50 THEN concat('''', s.top_category, ''' is the most common ', s."column", ', making up ', {whole('top_pct')}, '% of all records.')
  ELSE concat('''', s.top_category, ''' is the leading ', s."column", ' (', {whole('top_pct')}, '%), but no single category dominates.') END AS headline,
 CASE WHEN {ratio} >= 5 THEN concat('''', s.top_category, ''' has ', {whole(ratio)}, 'x more records than the least common category ''', s.bottom_category, ''' (', format('{{:.1f}}', bottom_pct), '%).')
  ELSE concat('The least common category is ''', s.bottom_category, ''' with ', format('{{:,}}', s.bottom_count), ' records (', format('{{:.1f}}', bottom_pct), '%).') END AS detail,
 CASE WHEN r.ratio IS NOT NULL THEN concat('''', r.top_category, ''' records have ', format('{{:.1f}}', {even('r.ratio', 1)}), 'x higher average {value} (', {money('r.top_avg')}, ') than ''',
  r.bottom_category, ''' (', {money('r.bottom_avg')}, ').') END AS note
 FROM ({segment_rows(table, columns)}) s LEFT JOIN ({ratio_rows(table, columns, value)}) r ON s.ordinal = r.ordinal"""


def insight_rows(table: str, parts: list[str]) -> str:
    """Union of sentences; the first per column stays."""
    return f"""SELECT section::INT AS section, ordinal::INT AS ordinal, kind, "column", headline, detail, note, '{table}' AS table_name FROM (
 SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY section, ordinal) AS place FROM ({union(parts)})) WHERE place = 1"""


def trend_sentences(source: str) -> str:
    return f"SELECT 2 AS section, 0 AS ordinal, 'time_trend' AS kind, \"column\", headline, detail, note FROM ({source})"


EVENT_TREND = f"""SELECT 'ts' AS "column", headline, detail, NULL::VARCHAR AS note FROM {headline('events', 'ts', 'value', 'daily')}"""
TOP_SENTENCES = f"""SELECT 5 AS section, 0 AS ordinal, 'high_cardinality_segment' AS kind, 'props' AS "column",
 concat('''', top_value, ''' leads in props with ', format('{{:,}}', top_count), ' records (', {whole('top_pct')}, '% of the total).') AS headline,
 concat('Among the top 10, ''', best_value, ''' has the highest average value at ', {money('best_avg')}, '.') AS detail, NULL::VARCHAR AS note FROM leader"""
PROFILE_CATEGORIES = ["size_label", "constant_flag", "day_label", "band_label"]
ORACLES["insights"] = f"""WITH dirty_orders AS ({DIRTY['dirty_orders']}),
{CLEAN_ORDERS}, dirty_profile AS ({DIRTY['dirty_profile']}), {TOP_PROPS}
""" + union(
    [
        insight_rows(
            "dirty_orders",
            [
                outcome_sentences("clean", "order_status"),
                trend_sentences(union(order_trend(unit) for unit in PERIODS)),
                money_sentences("clean", [(0, "total_amount"), (1, "payout_value")]),
                segment_sentences("clean", ["priority_label", "order_status"], "total_amount"),
            ],
        ),
        insight_rows(
            "dirty_profile",
            [
                outcome_sentences("dirty_profile", "claim_outcome"),
                money_sentences("dirty_profile", [(0, "sparse_amount"), (1, "settlement_fee")]),
                segment_sentences("dirty_profile", PROFILE_CATEGORIES, "sparse_amount"),
            ],
        ),
        insight_rows(
            "events", [trend_sentences(EVENT_TREND), money_sentences("events", [(0, "value")]), segment_sentences("events", ["event_type"], "value"), TOP_SENTENCES]
        ),
    ]
)

# --- Charts -------------------------------------------------------------------------------------------------------------

ORACLES["bar_shares"] = f"""WITH b AS (SELECT p_name AS value, count(*) AS "count" FROM part GROUP BY 1 ORDER BY "count" DESC, value LIMIT 20),
 s AS (SELECT value, "count", {even('"count" / (SELECT sum("count") FROM b)::DOUBLE * 100', 1)} AS pct_of_shown FROM b)
 SELECT *, concat(format('{{:,}}', "count"), ' (', pct_of_shown, '%)') AS label FROM s"""


def histogram(source: str, bins: int, digits: int) -> str:
    lower = "lo + bin * w"
    return f""", v AS ({source}), e AS (SELECT min(x) AS lo, max(x) AS hi, CASE WHEN max(x) = min(x) THEN 1 ELSE (max(x) - min(x)) / {bins} END AS w FROM v),
 b AS (SELECT least(floor((x - lo) / w), {bins - 1})::INT AS bin, count(*) AS n FROM v, e GROUP BY 1)
 SELECT bin, {rnd(lower, digits)} AS lower, {rnd(f'{lower} + w', digits)} AS upper, n AS "count" FROM b, e"""


ORACLES["histogram_40"] = with_dirty("dirty_orders", histogram("SELECT total_amount AS x FROM dirty_orders WHERE total_amount IS NOT NULL", 40, 6))
ORACLES["histogram_log"] = with_dirty(
    "dirty_lineitem", histogram("SELECT log10(l_extendedprice) AS x FROM dirty_lineitem WHERE l_extendedprice > 0", 50, 6)
)
ORACLES["explore_bar_count"] = 'SELECT props AS value, count(*) AS "count" FROM events WHERE props IS NOT NULL GROUP BY 1 ORDER BY "count" DESC, value LIMIT 20'
ORACLES["explore_bar_mean"] = f"SELECT p_name AS value, {rnd('avg(p_retailprice)', 4)} AS mean FROM part WHERE p_name IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 20"
ORACLES["explore_line"] = with_dirty(
    "dirty_orders",
    f"""SELECT period, {rnd('mean', 4)} AS mean FROM ({periods('dirty_orders', 'posted_at', 'total_amount', 'monthly',
    "posted_at >= TIMESTAMP '2000-01-01' AND posted_at <= TIMESTAMP '2024-12-31'")})""",
)

# --- Suggestions and recipes -----------------------------------------------------------------------------------------------


def suggestion_rows(table: str, label: str, columns: list[tuple[str, str]], numeric: list[str]) -> str:
    """Suggestions for (column, type) pairs; ids count as other columns."""
    n = f"(SELECT count(*) FROM {table})"
    copies = f"(SELECT count(*) FROM {table}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {table}))"
    parts = [
        f"""SELECT 1 AS priority, 1 AS section, 0 AS ordinal, concat(format('{{:,}}', d), ' duplicate rows found (', {pct('d', n, 1)}, '% of your data).') AS issue,
 'Remove duplicate rows' AS action, 'remove_duplicates' AS operation, NULL::VARCHAR AS "column" FROM (SELECT {copies} AS d) WHERE d > 0"""
    ]
    for i, (c, kind) in enumerate(columns):
        share = pct("m", "n", 1)
        if kind in ("financial", "metric"):
            action, operation = f"concat('Fill ', format('{{:,}}', m), ' empty values in ''{c}'' with the median value')", "fill_missing_median"
        elif kind == "date_column":
            action, operation = f"concat('Remove ', format('{{:,}}', m), ' rows with a missing date in ''{c}''')", "drop_missing_rows"
        else:
            action, operation = f"concat('Fill ', format('{{:,}}', m), ' empty values in ''{c}'' with the most common value')", "fill_missing_mode"
        parts.append(
            f"""SELECT CASE WHEN {share} > 5 THEN 1 ELSE 2 END, 2, {i}, concat('''{c}'' is ', {share}, '% empty (', format('{{:,}}', m), ' missing values).'),
 {action}, '{operation}', '{c}' FROM (SELECT count(*) - count({c}) AS m, count(*) AS n FROM {table}) WHERE m > 0"""
        )
        if c in numeric:
            parts.append(
                f"""SELECT 3, 3, {i}, '''{c}'' has a very uneven value distribution — a few extreme values are much larger than the rest.',
 'Apply log scale to ''{c}'' to compress extreme values', 'log_transform', '{c}' FROM {table} HAVING abs(skewness({c}::DOUBLE)) >= 1 AND min({c}) >= 0"""
            )
    return f"SELECT priority::INT AS priority, section::INT AS section, ordinal::INT AS ordinal, issue, action, operation, \"column\", '{label}' AS table_name FROM ({union(parts)})"


ORDER_TYPES = list(zip(DIRTY_ORDER_COLUMNS, "id_column metric financial financial categorical date_column categorical date_column".split()))
CUSTOMER_TYPES = [("c_custkey", "id_column"), ("c_name", "high_cardinality"), ("c_nationkey", "metric"), ("c_acctbal", "metric"), ("c_mktsegment", "categorical")]
ORACLES["suggestions"] = clean_orders(
    f", dirty_customer AS ({DIRTY['dirty_customer']})"
    + suggestion_rows("clean", "dirty_orders", ORDER_TYPES, ["o_orderkey", "o_custkey", "total_amount", "payout_value"])
    + "\nUNION ALL\n"
    + suggestion_rows("dirty_customer", "dirty_customer", CUSTOMER_TYPES, ["c_custkey", "c_nationkey", "c_acctbal"])
)


def mode(table: str, column: str) -> str:
    return f"(SELECT {column} FROM {table} WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)"


ORACLES["auto_clean"] = clean_orders(
    f""", a AS (SELECT * REPLACE (coalesce(total_amount, (SELECT quantile_cont(total_amount, 0.5) FROM clean)) AS total_amount) FROM clean),
 b AS (SELECT * REPLACE (coalesce(priority_label, {mode('a', 'priority_label')}) AS priority_label) FROM a),
 c AS (SELECT * FROM b WHERE order_date_text IS NOT NULL),
 d AS (SELECT * REPLACE (coalesce(order_status, {mode('c', 'order_status')}) AS order_status) FROM c),
 e AS (SELECT * FROM d WHERE posted_at IS NOT NULL)
 SELECT * REPLACE ({rnd('total_amount', 4)} AS total_amount, {rnd('payout_value', 4)} AS payout_value), {rnd('ln(1 + payout_value)', 4)} AS payout_value_log FROM e"""
)
UPPER_LABEL = f"upper({TRIMMED})"
RECIPE_STAGES = f""", t1 AS (SELECT * REPLACE ({TRIMMED} AS priority_label) FROM dirty_orders),
 t2 AS (SELECT * REPLACE (upper(priority_label) AS priority_label) FROM t1),
 t3 AS (SELECT * REPLACE (coalesce(priority_label, {mode('t2', 'priority_label')}) AS priority_label) FROM t2),
 t4 AS (SELECT * FROM t3 WHERE posted_at IS NOT NULL),
 t5 AS (SELECT * REPLACE (coalesce(total_amount, 0) AS total_amount) FROM t4),
 t6 AS (SELECT DISTINCT * FROM t5)"""


def counted(table: str) -> str:
    return f"(SELECT count(*) FROM {table})"


CELLS = {
    1: f"(SELECT count(*) FROM dirty_orders WHERE {TRIMMED} IS DISTINCT FROM priority_label)",
    2: "(SELECT count(*) FROM t1 WHERE upper(priority_label) IS DISTINCT FROM priority_label)",
    3: "(SELECT count(*) FROM t2 WHERE priority_label IS NULL)",
    5: "(SELECT count(*) FROM t4 WHERE total_amount IS NULL)",
}
AUDIT = [
    (1, "trim_whitespace", "'priority_label'", "dirty_orders", "t1", "'Trimmed extra whitespace from all values in ''priority_label''.'"),
    (2, "standardize_case", "'priority_label'", "t1", "t2", "'Standardized ''priority_label'' text to UPPERCASE.'"),
    (3, "fill_missing", "'priority_label'", "t2", "t3",
     f"concat('Filled ', format('{{:,}}', cells_changed), ' missing value(s) in ''priority_label'' with the most common value (''', {mode('t2', 'priority_label')}, ''').')"),
    (4, "drop_missing_rows", "'posted_at'", "t3", "t4",
     "concat('Removed ', format('{:,}', rows_before - rows_after), ' row(s) with missing values in ''posted_at''. Dataset now has ', format('{:,}', rows_after), ' rows.')"),
    (5, "fill_missing", "'total_amount'", "t4", "t5", "concat('Filled ', format('{:,}', cells_changed), ' missing value(s) in ''total_amount'' with the value ''0''.')"),
    (6, "remove_duplicates", "NULL::VARCHAR", "t5", "t6", "'No duplicate rows found — nothing to remove.'"),
    (7, "drop_column", "'no_such_column'", "t6", "t6", "'Column ''no_such_column'' not found — nothing was changed.'"),
]
ORACLES["recipe_audit"] = with_dirty(
    "dirty_orders",
    RECIPE_STAGES
    + "\n"
    + union(
        [
            f"""SELECT step::INT AS step, operation, "column", rows_before, rows_after, cells_changed, {text} AS message FROM (SELECT {i} AS step, '{op}' AS operation, {c} AS "column",
 {counted(before)} AS rows_before, {counted(after)} AS rows_after, {CELLS.get(i, '0::BIGINT')} AS cells_changed)"""
            for i, op, c, before, after, text in AUDIT
        ]
    ),
)
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_orderkey"]
PAIRS = [(a, b) for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :]]
ORACLES["correlation_vif"] = with_dirty(
    "dirty_lineitem",
    f""", whole AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, l_discount) AS ac, corr(l_extendedprice, l_discount) AS bc, count(*) AS n
  FROM dirty_lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_discount IS NOT NULL),
 v AS (SELECT n, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS d, ab, ac, bc FROM whole)
 {union([f"SELECT 'pair' AS part, '{a}' AS column_a, '{b}' AS column_b, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n_rows, {rnd(f'corr({a}, {b})', 8)} AS value FROM dirty_lineitem" for a, b in PAIRS])}
 UNION ALL SELECT 'vif', 'l_quantity', NULL, n, {rnd('(1 - bc * bc) / d', 8)} FROM v
 UNION ALL SELECT 'vif', 'l_extendedprice', NULL, n, {rnd('(1 - ac * ac) / d', 8)} FROM v
 UNION ALL SELECT 'vif', 'l_discount', NULL, n, {rnd('(1 - ab * ab) / d', 8)} FROM v""",
)
ORACLES["fill_median_approx"] = with_dirty("dirty_orders", "SELECT count(*) AS n_rows, 0::BIGINT AS left_missing, true AS within_bound FROM dirty_orders")
ORACLES["recipe_audit_written"] = with_dirty(
    "dirty_customer",
    """, low AS (SELECT * REPLACE (lower(c_mktsegment) AS c_mktsegment) FROM dirty_customer),
 n AS (SELECT (SELECT count(*) FROM dirty_customer) AS a, (SELECT count(*) FROM (SELECT DISTINCT * FROM low)) AS b,
  (SELECT count(*) FROM dirty_customer WHERE lower(c_mktsegment) IS DISTINCT FROM c_mktsegment) AS cased,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM low) WHERE trim(c_name) IS DISTINCT FROM c_name) AS trimmed)
 SELECT 1::INT AS step, 'standardize_case' AS operation, 'c_mktsegment' AS "column", a AS rows_before, a AS rows_after, cased AS cells_changed,
  'Standardized ''c_mktsegment'' text to lowercase.' AS message FROM n
 UNION ALL SELECT 2, 'remove_duplicates', NULL, a, b, 0, concat('Removed ', format('{:,}', a - b), ' duplicate row(s). Dataset now has ', format('{:,}', b), ' rows.') FROM n
 UNION ALL SELECT 3, 'trim_whitespace', 'c_name', b, b, trimmed, 'Trimmed extra whitespace from all values in ''c_name''.' FROM n
 UNION ALL SELECT 4, 'drop_column', 'c_nationkey', b, b, 0, 'Removed column ''c_nationkey''. Dataset now has 4 columns.' FROM n""",
)
ORACLES["recipe_undo"] = with_dirty("dirty_orders", RECIPE_STAGES + " SELECT * FROM t3")

# --- Report -------------------------------------------------------------------------------------------------------------------

ORACLES["date_range"] = clean_orders(f"SELECT min(order_date_text) AS first_date, max(order_date_text) AS last_date FROM clean WHERE {PLAUSIBLE}")
ORACLES["report_financial"] = with_dirty(
    "dirty_profile",
    f""", m AS ({money_stats('dirty_profile', [(0, 'sparse_amount'), (1, 'settlement_fee')])})
 SELECT "column", {rnd('total', 2)} AS total, {rnd('median', 4)} AS median, {rnd('mean', 4)} AS mean, n_zero, zero_pct FROM m""",
)


def top_rows(table: str, ordinal: int, column: str, n: int) -> str:
    return f"""SELECT {ordinal}::INT AS ordinal, '{column}' AS "column", place::INT AS place, v AS value, n AS "count", {pct('n', 'r', 1)} AS pct_of_rows, k
 FROM (SELECT {column}::VARCHAR AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {column}) AS place FROM {table} WHERE {column} IS NOT NULL GROUP BY {column}),
 (SELECT count(*) AS r, count(DISTINCT {column}) AS k FROM {table}) WHERE place <= {n}"""


ORACLES["report_categories"] = clean_orders(
    f"""SELECT * EXCLUDE (k), k AS categories, greatest(k - 3, 0)::BIGINT AS more FROM
 ({union([top_rows('clean', 0, 'priority_label', 3), top_rows('clean', 1, 'order_status', 3)])})"""
)
ORACLES["report_top5"] = f"SELECT * EXCLUDE (k) FROM ({top_rows('events', 0, 'props', 5)})"


def profile_row(i: int, name: str, kind: str) -> str:
    shown = kind in ("metric", "financial")
    spread = [f"{rnd(f'{f}', 4)} AS {a}" if shown else f"NULL::DOUBLE AS {a}" for f, a in (
        (f"min({name})::DOUBLE", "minimum"), (f"max({name})::DOUBLE", "maximum"), (f"avg({name})", "mean"), (f"quantile_cont({name}::DOUBLE, 0.5)" if shown else "", "median"))]
    return f"SELECT {i}::INT AS ordinal, '{name}' AS \"column\", '{kind}' AS semantic_type, {pct(f'count(*) - count({name})', 'count(*)', 1)} AS missing_pct, {', '.join(spread)} FROM clean"


ORACLES["table_profile"] = clean_orders(union([profile_row(i, c, k) for i, (c, k) in enumerate(ORDER_TYPES)]))
ORACLES["glance"] = with_dirty(
    "dirty_customer",
    missing_summary("dirty_customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    + duplicate_summary("dirty_customer")
    + " SELECT copies.n AS n_rows, 5::BIGINT AS n_cols, total_missing, n_duplicates FROM missing, copies",
)


def report_lines() -> str:
    """The report of dirty_orders as (line_no, line)."""
    rule, dash = "=" * 65, "-" * 40
    parts: list[str] = []

    def add(*lines: str) -> None:
        for line in lines:
            parts.append(f"SELECT {len(parts)} AS a, 0 AS b, 0 AS c, {line} AS line")

    def text(*lines: str) -> None:
        add(*[f"'{line}'" for line in lines])

    text(rule, "  DATA ANALYSIS REPORT", rule, "  Dataset   : orders", "  Generated : December 31, 2024 at 12:00 AM")
    add("concat('  Records   : ', (SELECT format('{:,}', n_rows) FROM graded))")
    text("  Columns   : 8", rule, "", "SECTION 1 — DATASET OVERVIEW", dash, "")
    add(f"concat('  Date Range     : ', (SELECT concat(strftime(min(order_date_text), '%B %d, %Y'), ' to ', strftime(max(order_date_text), '%B %d, %Y')) FROM clean WHERE {PLAUSIBLE}))")
    add("concat('  Total Records  : ', (SELECT format('{:,}', n_rows) FROM graded))")
    text("  Total Columns  : 8", "", "  Column Inventory:")
    text(*[f"    - {c} ({V.type_label(kind)})" for c, kind in ORDER_TYPES])
    text("", "SECTION 2 — DATA QUALITY", dash, "")
    add("concat('  Quality Score  : ', (SELECT score FROM graded), ' / 100')", "concat('  Grade          : ', (SELECT grade FROM graded))")
    text("", "  Findings:")
    mark = "CASE level WHEN 'good' THEN '  [OK]     ' WHEN 'warning' THEN '  [NOTE]   ' ELSE '  [ISSUE]  ' END"
    parts.append(f"SELECT {len(parts)}, section, ordinal, concat({mark}, message) FROM findings")
    text("", "SECTION 3 — KEY FINDINGS", dash, "", "  Financial Columns:")
    block = [
        "concat('    ', \"column\", ':')", "concat('      Total   : $', lpad(format('{:,.2f}', total), greatest(15, length(format('{:,.2f}', total)))::INT, ' '))", "concat('      Median  : $', lpad(format('{:,.2f}', median), greatest(15, length(format('{:,.2f}', median)))::INT, ' '))",
        "concat('      Average : $', lpad(format('{:,.2f}', mean), greatest(15, length(format('{:,.2f}', mean)))::INT, ' '))", "concat('      Zero $  : ', format('{:,}', n_zero), ' records (', zero_pct, '%)')", "''",
    ]
    place = len(parts)
    parts += [f"SELECT {place}, ordinal, {i}, {line} FROM money" for i, line in enumerate(block)]
    text("  Category Breakdowns:")
    place = len(parts)
    parts.append(f"SELECT {place}, ordinal, 0, concat('    ', \"column\", ' (', k, ' categories):') FROM cats WHERE place = 1")
    parts.append(f"SELECT {place}, ordinal, place, concat('      ', rpad(value, greatest(35, length(value))::INT, ' '), ' ', lpad(format('{{:,}}', \"count\"), greatest(7, length(format('{{:,}}', \"count\")))::INT, ' '), '  (', pct_of_rows, '%)') FROM cats")
    parts.append(f"SELECT {place}, ordinal, 4, concat('      ... and ', k - 3, ' more categories') FROM cats WHERE place = 1 AND k > 3")
    parts.append(f"SELECT {place}, ordinal, 5, '' FROM cats WHERE place = 1")
    text("SECTION 4 — CLEANING ACTIONS PERFORMED", dash, "", "   1. Trimmed text.", "", rule, "  For questions about this data, consult your data analyst.", rule)
    return union(parts)


ORDER_NUMBERS = [(0, "o_orderkey"), (1, "o_custkey"), (2, "total_amount"), (3, "payout_value")]
ORACLES["report"] = clean_orders(
    scored("clean", ORDER_NUMBERS, DIRTY_ORDER_COLUMNS)
    + f""", findings AS ({FINDINGS}), money AS ({money_stats('clean', [(0, 'total_amount'), (1, 'payout_value')])}),
 cats AS ({union([top_rows('clean', 0, 'priority_label', 3), top_rows('clean', 1, 'order_status', 3)])}), lines AS ({report_lines()})
 SELECT (row_number() OVER (ORDER BY a, b, c))::INT AS line_no, line FROM lines"""
)
ORACLES["report_sink"] = f"SELECT line FROM ({ORACLES['report']}) whole"


def context_lines() -> str:
    """The metadata of dirty_orders as (line_no, line): names of columns by type, then what the tables say."""
    kinds = {
        "Date columns       ": ("date_column",), "Numeric columns    ": ("metric", "financial"), "Category columns   ": ("categorical",),
        "Identifier columns ": ("id_column",), "Text/high-card cols": ("text", "high_cardinality"),
    }
    shown = [c for c, kind in ORDER_TYPES if kind in ("metric", "financial")]
    gaps = union([f"SELECT {i} AS i, '{c}' AS c, {pct(f'count(*) - count({c})', 'count(*)', 1)} AS share FROM clean HAVING count({c}) < count(*)" for i, c in enumerate(DIRTY_ORDER_COLUMNS)])
    parts = ["SELECT 0 AS a, 0 AS b, 0 AS c, 'Dataset name   : orders' AS line"]
    parts += ["SELECT 1, 0, 0, concat('Rows           : ', format('{:,}', n_rows)) FROM graded", "SELECT 2, 0, 0, 'Columns        : 8'"]
    parts += ["SELECT 3, 0, 0, concat('Quality score  : ', score, ' / 100 (', grade, ')') FROM graded", "SELECT 4, 0, 0, 'Column inventory:'"]
    for k, (label, types) in enumerate(kinds.items()):
        parts.append(f"SELECT 5, {k}, 0, '  - {label}: {', '.join(c for c, kind in ORDER_TYPES if kind in types) or 'None'}'")
    parts.append(f"SELECT 6, 0, 0, concat('Missing values : ', coalesce(string_agg(concat(c, ' (', share, '% missing)'), ', ' ORDER BY i), 'No missing values.')) FROM ({gaps})")
    parts.append("SELECT 7, 0, 0, 'Numeric column statistics:'")
    for k, c in enumerate(shown):
        values = {"min": f"min({c})::DOUBLE", "max": f"max({c})::DOUBLE", "mean": f"avg({c})", "median": f"quantile_cont({c}::DOUBLE, 0.5)"}
        spread = ", ', ', ".join(f"'{label}=', format('{{:.2f}}', {value})" for label, value in values.items())
        parts.append(f"SELECT 8, {k}, 0, concat('  - {c}: ', {spread}) FROM clean")
    parts.append("SELECT 9, 0, 0, 'Quality findings:'")
    parts.append("SELECT 10, section, ordinal, concat('  - ', message) FROM (SELECT * FROM findings ORDER BY section, ordinal LIMIT 6)")
    return union(parts)


ORACLES["table_context"] = clean_orders(
    scored("clean", ORDER_NUMBERS, DIRTY_ORDER_COLUMNS)
    + f""", findings AS ({FINDINGS}), lines AS ({context_lines()})
 SELECT (row_number() OVER (ORDER BY a, b, c))::INT AS line_no, line FROM lines"""
)
