"""The registry of named queries over Parquet tables, each with SQL for another engine that gives the same rows.

Most are written in the dialect and go through its parser and compiler. Those over xBase tables and indexes first write the
Parquet tables as xBase ones, in the order of their keys, and run everything through ``Database``: scans, memos, record numbers,
changes, definitions, transactions and indexes. Sorted and limited queries have a total order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Database
from .errors import code_of, failure
from .operators import compat
from .plans import compiler, syntax
from .session import workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def run(spark: SparkSession, sf_dir: str, sql: str, mode: str = "ansi") -> DataFrame:
    """A query in the dialect over the Parquet tables of a folder."""
    return compiler.select(syntax.parse(sql)["query"], lambda name, _: spark.read.parquet(f"{sf_dir}/{name}.parquet"), mode)


def add(name: str, sql: str, oracle: str | None = None, mode: str = "ansi") -> None:
    QUERIES[name] = lambda spark, sf_dir: run(spark, sf_dir, sql, mode)
    ORACLE_SQL[name] = oracle or sql


def query(oracle: str | None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return keep


# The flagship: filter, function, expression sort, top n.
add("flagship_top_n", "SELECT TOP 25 c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND UCASE(c_name) LIKE 'CUSTOMER%' ORDER BY UCASE(c_name), c_custkey",
    "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND upper(c_name) LIKE 'CUSTOMER%' ORDER BY upper(c_name), c_custkey LIMIT 25")

# Scans and projections.
add("scan_all", "SELECT * FROM nation")
add("project_alias", "SELECT n_nationkey AS id, n_name nm, n.n_regionkey AS 'rk' FROM nation n", "SELECT n_nationkey AS id, n_name AS nm, n_regionkey AS rk FROM nation")
add("project_expr", "SELECT l_orderkey ok, l_linenumber ln, l_extendedprice * (1 - l_discount) net, -l_quantity neg FROM lineitem",
    "SELECT l_orderkey AS ok, l_linenumber AS ln, l_extendedprice * (1 - l_discount) AS net, -l_quantity AS neg FROM lineitem")
add("project_constants", "SELECT r_regionkey k, 0 x, '' y, NULL z, 1.5 w, 'it''s' q FROM region", "SELECT r_regionkey AS k, 0 AS x, '' AS y, NULL::VARCHAR AS z, 1.5::DOUBLE AS w, 'it''s' AS q FROM region")
add("project_distinct", "SELECT DISTINCT l_returnflag f, l_linestatus s FROM lineitem", "SELECT DISTINCT l_returnflag AS f, l_linestatus AS s FROM lineitem")

# Predicates.
_L = "SELECT l_orderkey ok, l_linenumber ln FROM lineitem WHERE "
_LO = "SELECT l_orderkey AS ok, l_linenumber AS ln FROM lineitem WHERE "
for _name, _where in {
    "filter_cmp": "l_quantity < 5 AND l_discount >= 0.05 AND l_linenumber <> 3", "filter_and_or_not": "(l_quantity = 1 OR l_quantity = 50) AND NOT (l_returnflag = 'N')",
    "filter_between": "l_quantity BETWEEN 10 AND 12", "filter_not_between": "l_quantity NOT BETWEEN 3 AND 49", "filter_in": "l_linenumber IN (1, 7)", "filter_not_in": "l_returnflag NOT IN ('N', 'R')",
    "filter_arith": "l_quantity * 2 + 1 > 99 AND l_extendedprice / l_quantity > 1000",
}.items():
    add(_name, _L + _where, _LO + _where)
add("filter_is_null", "SELECT o_orderkey k FROM orders WHERE o_orderpriority IS NOT NULL AND NOT o_orderstatus IS NULL", "SELECT o_orderkey AS k FROM orders WHERE o_orderpriority IS NOT NULL AND NOT o_orderstatus IS NULL")
add("filter_like", "SELECT p_partkey k, p_type t FROM part WHERE p_type LIKE '%A_%' AND p_name LIKE 'P%'", "SELECT p_partkey AS k, p_type AS t FROM part WHERE p_type LIKE '%A_%' AND p_name LIKE 'P%'")
add("filter_not_like", "SELECT p_partkey k FROM part WHERE p_brand NOT LIKE 'Brand#1%'", "SELECT p_partkey AS k FROM part WHERE p_brand NOT LIKE 'Brand#1%'")
add("filter_date_literal", "SELECT o_orderkey k FROM orders WHERE o_orderdate >= #1996-01-01# AND o_orderdate < #1/1/1997#", "SELECT o_orderkey AS k FROM orders WHERE o_orderdate::DATE >= DATE '1996-01-01' AND o_orderdate::DATE < DATE '1997-01-01'")

# Joins.
add("join_inner", "SELECT o.o_orderkey k, c.c_name n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", "SELECT o_orderkey AS k, c_name AS n FROM orders JOIN customer ON o_custkey = c_custkey")
add("join_left", "SELECT c.c_custkey k, o.o_orderkey o FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey", "SELECT c_custkey AS k, o_orderkey AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
add("join_right", "SELECT s.s_suppkey s, n.n_name n FROM supplier s RIGHT OUTER JOIN nation n ON s.s_nationkey = n.n_nationkey", "SELECT s_suppkey AS s, n_name AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
add("join_full", "SELECT s.s_suppkey s, c.c_custkey c FROM supplier s FULL JOIN customer c ON s.s_suppkey = c.c_custkey", "SELECT s_suppkey AS s, c_custkey AS c FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
add("join_multi", "SELECT r.r_name r, COUNT(*) n, ROUND(SUM(o.o_totalprice), 2) t FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
    "SELECT r_name AS r, count(*) AS n, round(sum(o_totalprice), 2) AS t FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
add("join_self", "SELECT a.n_name a, b.n_name b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
add("join_composite_key", "SELECT a.l_orderkey k, a.l_linenumber n, b.l_quantity q FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber", "SELECT a.l_orderkey AS k, a.l_linenumber AS n, b.l_quantity AS q FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
add("join_filter_after", "SELECT c.c_custkey k, o.o_orderkey o FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL OR o.o_totalprice > 300000", "SELECT c_custkey AS k, o_orderkey AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL OR o_totalprice > 300000")
add("join_parenthesised_tree", "SELECT l.l_orderkey k, l.l_linenumber n, a.n_name sn, b.n_name cn FROM ((((lineitem l LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey) LEFT JOIN nation a ON s.s_nationkey = a.n_nationkey) LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey) LEFT JOIN customer c ON o.o_custkey = c.c_custkey) LEFT JOIN nation b ON c.c_nationkey = b.n_nationkey WHERE l.l_quantity > 45",
    "SELECT l_orderkey AS k, l_linenumber AS n, a.n_name AS sn, b.n_name AS cn FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation a ON s_nationkey = a.n_nationkey LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation b ON c_nationkey = b.n_nationkey WHERE l_quantity > 45")

# Aggregates.
add("agg_global", "SELECT COUNT(*) n, ROUND(SUM(l_quantity), 2) q, MIN(l_shipdate) a, MAX(l_shipdate) b FROM lineitem", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS q, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem")
add("agg_count_star", "SELECT event_type t, COUNT(*) n, COUNT(value) v FROM events GROUP BY event_type", "SELECT event_type AS t, count(*) AS n, count(value) AS v FROM events GROUP BY event_type")
add("agg_sum_avg_min_max", "SELECT l_returnflag f, l_linestatus s, ROUND(SUM(l_quantity), 2) q, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) net, ROUND(AVG(l_extendedprice), 4) a, MIN(l_tax) lo, MAX(l_tax) hi FROM lineitem WHERE l_shipdate <= #1998-09-02# GROUP BY l_returnflag, l_linestatus",
    "SELECT l_returnflag AS f, l_linestatus AS s, round(sum(l_quantity), 2) AS q, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(avg(l_extendedprice), 4) AS a, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem WHERE l_shipdate::DATE <= DATE '1998-09-02' GROUP BY ALL")
add("agg_distinct", "SELECT o_orderpriority p, COUNT(DISTINCT o_custkey) c, SUM(DISTINCT o_custkey) s FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority AS p, count(DISTINCT o_custkey) AS c, sum(DISTINCT o_custkey)::BIGINT AS s FROM orders GROUP BY ALL")
add("agg_expr_arg", "SELECT SUM(l_linenumber * 2 + 1) s, MAX(LENGTH(l_returnflag)) m FROM lineitem", "SELECT sum(l_linenumber * 2 + 1)::BIGINT AS s, max(length(l_returnflag)) AS m FROM lineitem")
add("agg_composite_expr", "SELECT l_linestatus s, MAX(l_linenumber) + 1 a, ROUND(SUM(l_quantity) / COUNT(*), 4) b FROM lineitem GROUP BY l_linestatus", "SELECT l_linestatus AS s, max(l_linenumber) + 1 AS a, round(sum(l_quantity) / count(*), 4) AS b FROM lineitem GROUP BY ALL")
add("agg_group_expr", "SELECT YEAR(o_orderdate) y, COUNT(*) n FROM orders GROUP BY YEAR(o_orderdate)", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL")
add("agg_having", "SELECT o_custkey c, COUNT(*) n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15 AND n < 40", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND count(*) < 40")
add("agg_order_by_agg", "SELECT TOP 7 o_custkey c, MAX(o_totalprice) m FROM orders GROUP BY o_custkey ORDER BY MAX(o_totalprice) DESC, o_custkey", "SELECT o_custkey AS c, max(o_totalprice) AS m FROM orders GROUP BY o_custkey ORDER BY m DESC NULLS LAST, c LIMIT 7")
add("agg_over_join", "SELECT n.n_name n, COUNT(*) c, ROUND(SUM(c.c_acctbal), 2) b FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name", "SELECT n_name AS n, count(*) AS c, round(sum(c_acctbal), 2) AS b FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
add("group_dedupe", "SELECT p_brand b, p_size s FROM part GROUP BY p_brand, p_size", "SELECT DISTINCT p_brand AS b, p_size AS s FROM part")
add("agg_empty_input", "SELECT COUNT(*) n, SUM(l_linenumber) s, MAX(l_returnflag) m FROM lineitem WHERE l_quantity < 0", "SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS s, max(l_returnflag) AS m FROM lineitem WHERE l_quantity < 0")

# Sorting and limits.
add("sort_multi", "SELECT TOP 50 o_orderstatus s, o_totalprice t, o_orderkey k FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey", "SELECT o_orderstatus AS s, o_totalprice AS t, o_orderkey AS k FROM orders ORDER BY s NULLS FIRST, t DESC NULLS LAST, k LIMIT 50")
add("sort_expr", "SELECT p_partkey k FROM part ORDER BY LENGTH(p_name), UPPER(p_name), p_partkey LIMIT 20", "SELECT p_partkey AS k FROM part ORDER BY length(p_name), upper(p_name), p_partkey LIMIT 20")
add("sort_ordinal", "SELECT TOP 30 PERCENT p_brand b, p_partkey k FROM part ORDER BY 1 DESC, 2", "SELECT p_brand AS b, p_partkey AS k FROM part ORDER BY 1 DESC, 2 LIMIT 30")
add("sort_hidden_column", "SELECT TOP 10 c_name n FROM customer ORDER BY c_acctbal DESC, c_custkey", "SELECT c_name AS n FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
add("topn", "SELECT TOP 10 o_orderkey k, o_totalprice t FROM orders ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_orderkey AS k, o_totalprice AS t FROM orders ORDER BY t DESC, k LIMIT 10")
add("limit_after_filter", "SELECT s_suppkey k FROM supplier WHERE s_acctbal > 0 ORDER BY s_suppkey LIMIT 5", "SELECT s_suppkey AS k FROM supplier WHERE s_acctbal > 0 ORDER BY 1 LIMIT 5")

# Functions.
_O = "o_orderkey k"
add("fn_conditional", f"SELECT {_O}, IIF(o_totalprice > 100000, 'big', 'small') a, NVL(o_orderstatus, '?') b, NVL2(o_orderpriority, 1, 0) c, COALESCE(NULL, o_orderpriority, 'x') d, ISNULL(o_orderstatus) e, ISNULL(o_orderstatus, 'n') f, ISBLANK(' ') g FROM orders",
    "SELECT o_orderkey AS k, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS a, coalesce(o_orderstatus, '?') AS b, CASE WHEN o_orderpriority IS NOT NULL THEN 1 ELSE 0 END AS c, coalesce(o_orderpriority, 'x') AS d, o_orderstatus IS NULL AS e, coalesce(o_orderstatus, 'n') AS f, true AS g FROM orders")
add("fn_case_searched", f"SELECT {_O}, CASE WHEN o_totalprice > 200000 THEN 'a' WHEN o_totalprice > 100000 THEN 'b' ELSE 'c' END x, CASE WHEN o_totalprice < 0 THEN 1 END y FROM orders", "SELECT o_orderkey AS k, CASE WHEN o_totalprice > 200000 THEN 'a' WHEN o_totalprice > 100000 THEN 'b' ELSE 'c' END AS x, CASE WHEN o_totalprice < 0 THEN 1 END AS y FROM orders")
add("fn_case_simple", f"SELECT {_O}, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END x FROM orders", "SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS x FROM orders")
add("fn_decode_nullif", f"SELECT {_O}, DECODE(o_orderstatus, 'O', 'open', 'F', 'done', 'other') d, NULLIF(o_orderstatus, 'O') n FROM orders", "SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'other' END AS d, nullif(o_orderstatus, 'O') AS n FROM orders")
add("fn_greatest_least", "SELECT l_orderkey k, l_linenumber n, GREATEST(l_tax, l_discount, NULL) g, LEAST(l_tax, l_discount) l FROM lineitem", "SELECT l_orderkey AS k, l_linenumber AS n, greatest(l_tax, l_discount) AS g, least(l_tax, l_discount) AS l FROM lineitem")
add("fn_cast", "SELECT l_orderkey k, l_linenumber n, CAST(l_extendedprice AS INTEGER) i, CAST(l_linenumber AS CHAR(5)) s, CAST(l_shipdate AS DATE) d, CAST(l_linenumber AS NUMERIC(8,2)) x FROM lineitem",
    "SELECT l_orderkey AS k, l_linenumber AS n, trunc(l_extendedprice)::BIGINT AS i, l_linenumber::VARCHAR AS s, l_shipdate::DATE AS d, l_linenumber::DOUBLE AS x FROM lineitem")
_P, _PO = "SELECT p_partkey k, ", "SELECT p_partkey AS k, "
for _name, _a, _b in (
    ("fn_case_trim", "UCASE(p_name) a, LCASE(p_name) b, TRIM('  x ') c, LTRIM('  x ') d, RTRIM('  x ') e, ALLTRIM(p_brand) f", "upper(p_name) AS a, lower(p_name) AS b, 'x' AS c, 'x ' AS d, '  x' AS e, p_brand AS f"),
    ("fn_substr_left_right", "LEFT(p_name, 3) a, RIGHT(p_name, 4) b, SUBSTR(p_name, 2, 3) c, MID(p_name, 0, 2) d, SUBSTRING(p_name, 5) e, SUBSTR(p_name, 900) f", "left(p_name, 3) AS a, right(p_name, 4) AS b, substr(p_name, 2, 3) AS c, substr(p_name, 1, 2) AS d, substr(p_name, 5) AS e, '' AS f"),
    ("fn_pad_repeat", "LPAD(p_brand, 12, '*') a, RPAD(p_brand, 4) b, REPEAT('ab', 2) c, REPEAT('x', -1) d, SPACE(3) e", "lpad(p_brand, 12, '*') AS a, rpad(p_brand, 4, ' ') AS b, 'abab' AS c, '' AS d, '   ' AS e"),
    ("fn_replace_reverse", "REPLACE(p_name, 'a', 'A') a, REVERSE(p_brand) b", "replace(p_name, 'a', 'A') AS a, reverse(p_brand) AS b"),
    ("fn_locate_instr", "LOCATE('a', p_name) a, LOCATE('a', p_name, 4) b, INSTR(p_name, 'r') c, POSITION('#', p_brand) d", "instr(p_name, 'a') AS a, CASE WHEN instr(substr(p_name, 4), 'a') > 0 THEN instr(substr(p_name, 4), 'a') + 3 ELSE 0 END AS b, instr(p_name, 'r') AS c, instr(p_brand, '#') AS d"),
    ("fn_length_family", "LEN(p_name) a, LENGTH('é') b, CHAR_LENGTH(p_brand) c, OCTET_LENGTH('é') d", "length(p_name) AS a, 1 AS b, length(p_brand) AS c, 2 AS d"),
    ("fn_ascii_chr", "ASCII(p_name) a, CHR(65 + p_size) b, CHAR(8364) c", "ascii(p_name) AS a, chr(65 + p_size) AS b, '€' AS c"),
    ("fn_concat", "CONCAT(p_brand, '-', p_size) a, p_brand + '/' + p_type b", "concat(p_brand, '-', p_size) AS a, p_brand || '/' || p_type AS b"),
    ("fn_str_val", "STR(p_retailprice) a, STR(2.345, 8, 2) b, VAL('12.5') c, VAL('x') d", "trunc(p_retailprice)::BIGINT::VARCHAR AS a, '2.35' AS b, 12.5::DOUBLE AS c, 0::DOUBLE AS d"),
):
    add(_name, f"{_P}{_a} FROM part", f"{_PO}{_b} FROM part")
add("fn_initcap", "SELECT n_nationkey k, INITCAP(n_name) a FROM nation", "SELECT n_nationkey AS k, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), ' ') AS a FROM nation")
_S, _SO = "SELECT s_suppkey k, ", "SELECT s_suppkey AS k, "
for _name, _a, _b in (
    ("fn_abs_round_trunc", "ABS(s_acctbal) a, ROUND(s_acctbal, 1) b, TRUNC(s_acctbal) c, INT(s_acctbal) d", "abs(s_acctbal) AS a, round(s_acctbal, 1) AS b, trunc(s_acctbal) AS c, trunc(s_acctbal)::BIGINT AS d"),
    ("fn_mod_sign", "MOD(s_suppkey, 7) a, MOD(-7, 3) b, SIGN(s_acctbal) c", "s_suppkey % 7 AS a, -1 AS b, sign(s_acctbal)::BIGINT AS c"),
    ("fn_ceil_floor", "CEIL(s_acctbal) a, FLOOR(s_acctbal) b, CEILING(1.2) c", "ceil(s_acctbal)::BIGINT AS a, floor(s_acctbal)::BIGINT AS b, 2 AS c"),
    ("fn_pow_sqrt_exp", "POWER(s_suppkey, 2) a, ROUND(SQRT(s_suppkey), 6) b, ROUND(EXP(s_nationkey / 10), 6) c, ROUND(PI(), 6) d", "pow(s_suppkey, 2)::DOUBLE AS a, round(sqrt(s_suppkey), 6) AS b, round(exp(s_nationkey / 10), 6) AS c, 3.141593::DOUBLE AS d"),
    ("fn_logs", "ROUND(LN(s_suppkey), 6) a, ROUND(LOG10(s_suppkey), 6) b, ROUND(LOG(2, s_suppkey), 6) c", "round(ln(s_suppkey), 6) AS a, round(log10(s_suppkey), 6) AS b, round(ln(s_suppkey) / ln(2), 6) AS c"),
):
    add(_name, f"{_S}{_a} FROM supplier WHERE s_suppkey > 0", f"{_SO}{_b} FROM supplier WHERE s_suppkey > 0")
_OD, _ODO = "SELECT o_orderkey k, ", "SELECT o_orderkey AS k, "
for _name, _a, _b in (
    ("fn_ymd", "YEAR(o_orderdate) a, MONTH(o_orderdate) b, DAY(o_orderdate) c", "year(o_orderdate) AS a, month(o_orderdate) AS b, day(o_orderdate) AS c"),
    ("fn_extract", "EXTRACT(YEAR FROM o_orderdate) a, EXTRACT(QUARTER FROM o_orderdate) b, EXTRACT(DOW FROM o_orderdate) c, EXTRACT(DOY FROM o_orderdate) d", "year(o_orderdate) AS a, quarter(o_orderdate) AS b, dayofweek(o_orderdate) + 1 AS c, dayofyear(o_orderdate) AS d"),
    ("fn_datediff_add", "DATEDIFF(o_orderdate, #1995-01-01#) a, DATEADD(o_orderdate, 30) b, TO_DATE('19960229') c", "date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS a, o_orderdate::DATE + 30 AS b, DATE '1996-02-29' AS c"),
    ("fn_dow_doy_quarter_week", "DAYOFWEEK(o_orderdate) a, DAYOFYEAR(o_orderdate) b, QUARTER(o_orderdate) c, WEEK(o_orderdate) d", "dayofweek(o_orderdate) + 1 AS a, dayofyear(o_orderdate) AS b, quarter(o_orderdate) AS c, week(o_orderdate) AS d"),
    ("fn_last_day_names", "LAST_DAY(o_orderdate) a, MONTHNAME(o_orderdate) b, DAYNAME(o_orderdate) c", "last_day(o_orderdate::DATE) AS a, monthname(o_orderdate) AS b, dayname(o_orderdate) AS c"),
):
    add(_name, f"{_OD}{_a} FROM orders", f"{_ODO}{_b} FROM orders")
add("fn_hms", "SELECT event_id k, HOUR(ts) a, MINUTE(ts) b, SECOND(ts) c FROM events", "SELECT event_id AS k, hour(ts) AS a, minute(ts) AS b, second(ts) AS c FROM events")

add("fn_now_rand", "SELECT r_regionkey k, IIF(CURRENT_DATE() > #2020-01-01#, 1, 0) a, IIF(YEAR(NOW()) >= 2024, 1, 0) b, IIF(RAND() >= 0 AND RAND() < 1, 1, 0) c, IIF(CURRENT_TIMESTAMP() >= #2024-01-01#, 1, 0) d FROM region",
    "SELECT r_regionkey AS k, 1 AS a, 1 AS b, 1 AS c, 1 AS d FROM region")

# xBase tables. Names have ten characters at most.

TABLES = {
    "region": (["r_regionkey R_KEY", "r_name R_NAME"], "R_KEY,N,6,0;R_NAME,C,12,0"),
    "nation": (["n_nationkey N_KEY", "n_name N_NAME", "n_regionkey N_REGION"], "N_KEY,N,6,0;N_NAME,C,12,0;N_REGION,N,6,0"),
    "supplier": (["s_suppkey S_KEY", "s_name S_NAME", "s_nationkey S_NATION", "s_acctbal S_BAL", "repeat(s_name, 40) S_NOTE"], "S_KEY,N,10,0;S_NAME,C,18,0;S_NATION,N,6,0;S_BAL,N,12,2;S_NOTE,M,10,0"),
    "customer": (["c_custkey C_KEY", "c_name C_NAME", "c_nationkey C_NATION", "c_acctbal C_BAL", "c_mktsegment C_SEGMENT", "concat('0', c_nationkey, '.0') C_TEXT"], "C_KEY,N,10,0;C_NAME,C,18,0;C_NATION,N,6,0;C_BAL,N,12,2;C_SEGMENT,C,12,0;C_TEXT,C,8,0"),
    "orders": (["o_orderkey O_KEY", "o_custkey O_CUST", "o_orderstatus O_STATUS", "o_totalprice O_TOTAL", "cast(o_orderdate AS date) O_DATE", "o_totalprice > 250000 O_BIG"], "O_KEY,N,12,0;O_CUST,N,10,0;O_STATUS,C,1,0;O_TOTAL,N,14,2;O_DATE,D,8,0;O_BIG,L,1,0"),
}


def database(spark: SparkSession, sf_dir: str, *tables: str, **options: object) -> Database:
    """A folder with some tables of ``sf_dir``, as xBase ones whose records are in the order of the key."""
    db = Database(spark, workspace(spark, "queries"), **options)
    for name in tables:
        columns, fields = TABLES[name]
        source = spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(*columns)
        source.orderBy(source.columns[0]).write.format("xbase").option("fields", fields).mode("overwrite").save(f"{db.folder}/{name}.dbf")
    return db


def on_tables(name: str, tables: str, sql: str, oracle: str, *before: str, mode: str = "ansi", **options: object) -> None:
    """A query over xBase tables after some changes."""

    def run_on(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = database(spark, sf_dir, *tables.split(), mode=mode, **options)
        for statement in before:
            db.execute(statement)
        return db.sql(sql)

    QUERIES[name], ORACLE_SQL[name] = run_on, oracle


_CUSTOMER = "(SELECT row_number() OVER (ORDER BY c_custkey) AS r, * FROM customer)"

on_tables("xbase_scan", "customer", "SELECT RECNO() r, C_KEY, C_NAME, C_NATION, C_BAL FROM customer", f"SELECT r, c_custkey AS C_KEY, rpad(c_name, 18, ' ') AS C_NAME, c_nationkey AS C_NATION, c_acctbal AS C_BAL FROM {_CUSTOMER}")
on_tables("xbase_scan_star", "orders", "SELECT * FROM orders", "SELECT o_orderkey AS O_KEY, o_custkey AS O_CUST, o_orderstatus AS O_STATUS, o_totalprice AS O_TOTAL, o_orderdate::DATE AS O_DATE, o_totalprice > 250000 AS O_BIG FROM orders")
on_tables("xbase_projected_scan", "customer", "SELECT C_KEY k, TRIM(C_SEGMENT) s FROM customer WHERE C_BAL > 5000 AND C_NATION BETWEEN 3 AND 9 ORDER BY k", "SELECT c_custkey AS k, c_mktsegment AS s FROM customer WHERE c_acctbal > 5000 AND c_nationkey BETWEEN 3 AND 9 ORDER BY k")
on_tables("xbase_aggregate", "customer", "SELECT TRIM(C_SEGMENT) s, COUNT(*) n, ROUND(SUM(C_BAL), 2) b, MIN(RECNO()) a, MAX(RECNO()) z FROM customer GROUP BY TRIM(C_SEGMENT)", f"SELECT c_mktsegment AS s, count(*) AS n, round(sum(c_acctbal), 2) AS b, min(r) AS a, max(r) AS z FROM {_CUSTOMER} GROUP BY ALL")
on_tables("xbase_deleted", "customer", "SELECT RECNO() r, C_KEY k FROM customer WHERE C_NATION < 20", f"SELECT r, c_custkey AS k FROM {_CUSTOMER} WHERE c_acctbal >= 0 AND c_nationkey < 20", "DELETE FROM customer WHERE C_BAL < 0")
on_tables("xbase_memo", "supplier", "SELECT S_KEY k, S_NOTE t, LENGTH(S_NOTE) n FROM supplier", "SELECT s_suppkey AS k, repeat(s_name, 40) AS t, 40 * length(s_name) AS n FROM supplier")
on_tables("recno_range", "nation", "SELECT RECNO() recno, TRIM(N_NAME) n_name FROM nation WHERE RECNO() BETWEEN 5 AND 9", "SELECT recno, n_name FROM (SELECT row_number() OVER (ORDER BY n_nationkey) AS recno, n_name FROM nation) WHERE recno BETWEEN 5 AND 9")
on_tables("recno_list", "customer", "SELECT RECNO() r, C_KEY k FROM customer WHERE RECNO() IN (1, 7, 90, 100000000)", f"SELECT r, c_custkey AS k FROM {_CUSTOMER} WHERE r IN (1, 7, 90)")
on_tables("recno_compare", "nation", "SELECT RECNO() * 2 d FROM nation WHERE RECNO() > 20 AND RECNO() <> 23 ORDER BY RECNO() DESC", "SELECT 2 * r AS d FROM (SELECT row_number() OVER (ORDER BY n_nationkey) AS r FROM nation) WHERE r > 20 AND r <> 23")
on_tables("sort_stable", "customer", "SELECT TOP 40 TRIM(C_SEGMENT) s, C_KEY k FROM customer ORDER BY C_SEGMENT DESC", "SELECT c_mktsegment AS s, c_custkey AS k FROM customer ORDER BY c_mktsegment DESC, c_custkey LIMIT 40")
on_tables("max_rows", "nation", "SELECT N_KEY k FROM nation ORDER BY N_KEY DESC LIMIT 20", "SELECT n_nationkey AS k FROM nation ORDER BY k DESC LIMIT 6", max_rows=6)
on_tables("join_xbase_folded_keys", "customer nation", "SELECT c.C_KEY k, n.N_KEY n FROM customer c JOIN nation n ON c.C_TEXT = n.N_KEY", "SELECT c_custkey AS k, n_nationkey AS n FROM customer JOIN nation ON c_nationkey = n_nationkey", mode="xbase")
on_tables("compat_truth", "customer", "SELECT C_KEY k FROM customer WHERE C_NATION AND NOT (C_TEXT = '3') AND 'yes'", "SELECT c_custkey AS k FROM customer WHERE c_nationkey <> 0 AND c_nationkey <> 3", mode="xbase")
on_tables("compat_first_value", "customer", "SELECT TRIM(C_SEGMENT) s, C_KEY k, COUNT(*) n FROM customer GROUP BY TRIM(C_SEGMENT)", "SELECT c_mktsegment AS s, min(c_custkey) AS k, count(*) AS n FROM customer GROUP BY ALL", mode="xbase")
on_tables("compat_pushed_filter", "orders", "SELECT O_KEY k FROM orders WHERE O_CUST = 7 OR O_TOTAL >= 400000 AND O_STATUS = 'F'", "SELECT o_orderkey AS k FROM orders WHERE o_custkey = 7 OR o_totalprice >= 400000 AND o_orderstatus = 'F'", mode="xbase")


# Changes of xBase tables, as the rows that they leave.
on_tables("dml_update_expr", "nation", "SELECT N_KEY n_nationkey, TRIM(N_NAME) n_name, N_REGION n_regionkey FROM nation",
    "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS n_name, CASE WHEN n_regionkey = 1 THEN n_nationkey ELSE n_regionkey END AS n_regionkey FROM nation",
    "UPDATE nation SET N_NAME = UPPER(TRIM(N_NAME)) + '!', N_REGION = N_KEY WHERE N_REGION = 1")
on_tables("dml_update_join", "supplier customer", "SELECT S_KEY s_suppkey, TRIM(S_NAME) s_name, S_NATION s_nationkey, S_BAL s_acctbal FROM supplier",
    "SELECT s_suppkey, s_name, s_nationkey, coalesce(m, s_acctbal) AS s_acctbal FROM supplier LEFT JOIN (SELECT c_nationkey, arg_min(c_acctbal, c_custkey) AS m FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY c_nationkey) ON s_nationkey = c_nationkey",
    "UPDATE supplier s JOIN customer c ON s.S_NATION = c.C_NATION SET S_BAL = c.C_BAL WHERE TRIM(c.C_SEGMENT) = 'BUILDING'")
on_tables("dml_insert", "region", "SELECT R_KEY r_regionkey, TRIM(R_NAME) r_name FROM region", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'NOWHERE' UNION ALL SELECT 100, NULL", "INSERT INTO region VALUES (99, 'NOWHERE')", "INSERT INTO region (R_KEY) VALUES (100)")
on_tables("dml_delete", "supplier", "SELECT S_KEY s_suppkey, TRIM(S_NAME) s_name, S_NATION s_nationkey, S_BAL s_acctbal FROM supplier", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal >= 0", "DELETE FROM supplier WHERE S_BAL < 0")
on_tables("dml_values", "region", "SELECT * FROM v", "SELECT * FROM (VALUES (1, 'it''s', 2.68, DATE '2024-02-29', true), (NULL, 'x   ', -0.5, NULL, false)) t(A, B, C, D, E)",
    "CREATE TABLE v (A INT, B VARCHAR(4), C NUMERIC(8,2), D DATE, E LOGICAL)", "INSERT INTO v VALUES (1, 'it''s', 2.675, #2024-02-29#, TRUE)", "INSERT INTO v (B, C) VALUES ('x   ', -0.5)")
on_tables("ddl_add_drop_rename", "nation", "SELECT N_KEY n_nationkey, TRIM(NAME) name, EMAIL email FROM nation", "SELECT n_nationkey, n_name AS name, NULL::VARCHAR AS email FROM nation", "ALTER TABLE nation ADD COLUMN EMAIL CHAR(20)", "ALTER TABLE nation DROP COLUMN N_REGION", "ALTER TABLE nation RENAME COLUMN N_NAME TO NAME")
on_tables("ddl_rename_table", "nation region", "SELECT N_KEY k FROM lands", "SELECT n_nationkey AS k FROM nation", "ALTER TABLE nation RENAME TO lands", "DROP TABLE region", "CREATE TABLE IF NOT EXISTS lands (A INT)", "DROP TABLE IF EXISTS nowhere")


@query("SELECT * FROM (VALUES ('A', 'C', 30, 0, 1), ('B', 'C', 7, 0, 2), ('C', 'N', 10, 0, 3), ('D', 'N', 8, 2, 4), ('E', 'N', 10, 0, 5), ('F', 'N', 6, 0, 6), ('G', 'N', 18, 0, 7), ('H', 'N', 18, 5, 8), ('I', 'D', 8, 0, 9), ('J', 'L', 1, 0, 10), ('K', 'M', 10, 0, 11)) t(\"column\", type, length, decimals, position)")
def ddl_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What CREATE TABLE makes of the type names, by the catalog."""
    db = database(spark, sf_dir)
    db.execute("CREATE TABLE t (A CHAR, B VARCHAR(7), C NUMERIC, D DECIMAL(8,2), E INTEGER, F SMALLINT, G BIGINT, H DOUBLE, I DATE, J BOOLEAN, K TEXT)")
    return db.columns("t").drop("table")


@query("SELECT n_nationkey AS k, n_regionkey AS r FROM nation WHERE n_regionkey <> 2")
def xbase_undelete_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted records come back, others go for good, and records are numbered anew."""
    db = database(spark, sf_dir, "nation")
    db.execute("DELETE FROM nation WHERE N_REGION < 3")
    assert db.undelete("nation", "N_REGION <> 2") and db.pack("nation")
    return db.sql("SELECT N_KEY k, N_REGION r FROM nation WHERE RECNO() <= 100000")


@query("SELECT 6 + i AS \"RECNO\" FROM range(50) t(i)")
def dml_generated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One INSERT with parameters for many rows gives their record numbers."""
    db = database(spark, sf_dir, "region")
    return db.execute_many("INSERT INTO region VALUES (?, ?)", [(100 + i, f"R{i}") for i in range(50)])


@query("SELECT n_nationkey AS k, n_name AS n FROM nation WHERE n_nationkey = 7 OR n_regionkey = 3 AND n_nationkey > 10")
def prepared_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir, "nation").sql("SELECT N_KEY k, TRIM(N_NAME) n FROM nation WHERE N_KEY = ? OR N_REGION = ? AND N_KEY > ?", [7, 3, 10])


@query("SELECT * FROM (VALUES (0, 1), (1, -3), (2, 0), (3, 20)) t(place, n)")
def dml_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each statement of a batch has touched; -3 for one that fails."""
    db = database(spark, sf_dir, "nation")
    counts = db.batch(["DELETE FROM nation WHERE N_KEY = 1", "DELETE FROM nowhere", "ALTER TABLE nation ADD COLUMN X INT", "UPDATE nation SET X = 1 WHERE N_KEY >= 5"])
    return spark.createDataFrame(list(enumerate(counts)), "place int, n int")


@query("SELECT 'nation' AS t, count(*) AS n, sum(n_nationkey + 1)::BIGINT AS s FROM nation UNION ALL SELECT 'region', count(*), sum(r_regionkey)::BIGINT FROM region WHERE r_regionkey <> 0")
def dml_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables change together; a transaction that fails leaves them as they were."""
    db = database(spark, sf_dir, "nation", "region")
    with db.transaction():
        db.execute("UPDATE nation SET N_KEY = N_KEY + 1")
        db.execute("DELETE FROM region WHERE R_KEY = 0")
    try:
        with db.transaction():
            db.execute("DELETE FROM nation")
            db.execute("DELETE FROM region WHERE NOPE = 1")
    except ValueError:
        pass
    return db.sql("SELECT 'nation' t, COUNT(*) n, SUM(N_KEY) s FROM nation").unionByName(db.sql("SELECT 'region' t, COUNT(*) n, SUM(R_KEY) s FROM region"))


@query("SELECT * FROM (VALUES (0, '42S02', 17007), (1, '42S22', 17006), (2, '42000', 17001), (3, '42000', 17001), (4, '42000', 17001), (5, '42000', 17001), (6, '07001', 17008), (7, '22003', 17009), (8, '22003', 17009), (9, '42S01', 17000)) t(place, sqlstate, code)")
def errors_by_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes wrong with tables, columns, * beside aggregates, conditions of joins, syntax, types, parameters and values."""
    db, out = database(spark, sf_dir, "nation", "region", mode="xbase"), []
    for text in ("SELECT A FROM nowhere", "INSERT INTO nation (NOPE) VALUES (1)", "SELECT *, COUNT(*) FROM nation", "SELECT n.N_KEY FROM nation n JOIN region r ON n.N_REGION > r.R_KEY", "SELECT FROM nation", "CREATE TABLE t (A POINT)",
                 "INSERT INTO nation VALUES (?, 'x', 1)", "INSERT INTO region (R_KEY) VALUES (12345678)", "UPDATE nation SET N_KEY = N_KEY + 10000000", "CREATE TABLE nation (A INT)"):
        try:
            db.execute(text)
        except Exception as e:  # noqa: BLE001
            out.append(failure(e))
    return spark.createDataFrame([(i, s, code_of(s)) for i, s in enumerate(out)], "place int, sqlstate string, code int")


@query("SELECT c_custkey AS k, trunc(c_acctbal)::BIGINT AS i, rpad(c_name, 18, ' ') AS s, c_nationkey <> 0 AS b, round(c_acctbal)::BIGINT AS d FROM customer WHERE c_nationkey < 3")
def cursor_getters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a cursor by its typed getters."""
    c, out = database(spark, sf_dir, "customer").cursor("SELECT C_KEY, C_BAL, C_NAME, C_NATION FROM customer WHERE C_NATION < 3"), []
    while c.next():
        out.append((c.get(1, "int"), c.get("c_bal", "int"), c.get("C_NAME", "string"), c.get(4, "bool"), int(c.get(2, "decimal"))))
    return spark.createDataFrame(out, "k bigint, i bigint, s string, b boolean, d bigint")


# Indexes.


@query(f"SELECT upper(rpad(c_name, 18, ' ')) || lpad(c_nationkey::VARCHAR, 6, ' ') AS key, r AS recno FROM {_CUSTOMER}")
def ntx_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries of an index of two terms."""
    db = database(spark, sf_dir, "customer")
    db.create_index("customer", "UPPER(C_NAME)+STR(C_NATION)", "byname")
    return spark.read.format("ntx").load(f"{db.folder}/byname.ntx").select("key", "recno")


@query(f"SELECT strftime(o_orderdate, '%Y%m%d') || substr(o_orderstatus, 1, 1) || lpad((o_orderkey + 1)::VARCHAR, 10, ' ') AS key FROM orders")
def ntx_key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, parts of texts and record numbers in keys."""
    db = database(spark, sf_dir, "orders")
    db.create_index("orders", "DTOS(O_DATE)+SUBSTR(O_STATUS,1,1)+STR(RECNO(),10)", "bydate")
    return spark.read.format("ntx").load(f"{db.folder}/bydate.ntx").select("key")


@query("SELECT c_custkey AS k, c_mktsegment AS s FROM customer WHERE c_mktsegment LIKE 'BU%' AND c_acctbal >= 0")
def ntx_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by a prefix of their keys."""
    db = database(spark, sf_dir, "customer")
    db.create_index("customer", "C_SEGMENT+C_NAME", "bysegment")
    return db.seek("customer", "bysegment.ntx", "BU").filter("C_BAL >= 0").select(F.col("C_KEY").alias("k"), F.rtrim("C_SEGMENT").alias("s"))


@query("SELECT c_custkey AS k FROM customer WHERE c_name LIKE 'Customer#00000001%' AND c_acctbal > 0")
def ntx_planned_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prefix LIKE reads the records that an index gives; the condition is applied to them again."""
    db, text = database(spark, sf_dir, "customer"), "SELECT C_KEY k FROM customer WHERE UCASE(C_NAME) LIKE 'CUSTOMER#00000001%' AND C_BAL > 0"
    db.create_index("customer", "UPPER(C_NAME)", "byname")
    assert db.plan(text)["prefix"] == "CUSTOMER#00000001"
    return db.sql(text)


@query("SELECT c_custkey AS k, c_name AS n FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_name LIMIT 9")
def ntx_order_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows in an index's order, without a scan."""
    db, text = database(spark, sf_dir, "customer"), "SELECT TOP 9 C_KEY k, TRIM(C_NAME) n FROM customer WHERE C_SEGMENT = 'BUILDING    ' ORDER BY C_NAME"
    db.create_index("customer", "C_SEGMENT+C_NAME", "bysegment")
    plan = db.plan(text)
    assert plan["ordered"] and len(plan["records"]) <= 9
    return db.sql(text)


@query("SELECT n_nationkey AS k, 'NEW' AS n FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 77, 'NEWER'")
def ntx_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index follows inserts, updates, deletes and packing."""
    db = database(spark, sf_dir, "nation")
    db.create_index("nation", "UPPER(N_NAME)", "byname")
    db.execute("INSERT INTO nation VALUES (77, 'newer', 1)")
    db.execute("UPDATE nation SET N_NAME = 'new' WHERE N_KEY IN (2, 3)")
    db.execute("DELETE FROM nation WHERE N_KEY < 3")
    db.pack("nation")
    return db.seek("nation", "byname.ntx", "NEW").select(F.col("N_KEY").alias("k"), F.upper(F.rtrim("N_NAME")).alias("n"))


# The historical rules.


@query("SELECT s_suppkey, true AS null_is_null, s_acctbal IS NOT NULL AS differs_from_null, NOT (s_acctbal > 0) AS not_above, s_suppkey < 5 AS text_below FROM supplier")
def compat_two_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    none, bal = F.lit(None).cast("double"), F.col("s_acctbal")
    return s.select("s_suppkey", compat.compare("=", none, none).alias("null_is_null"), compat.compare("<>", bal, none).alias("differs_from_null"), (~compat.compare(">", bal, F.lit(0))).alias("not_above"), compat.compare("<", F.col("s_suppkey").cast("string"), F.lit("5")).alias("text_below"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def compat_join_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys written as '007', 7.0 or ' 7 ' are one key; the join stays one of equal keys."""
    c, n = spark.read.parquet(f"{sf_dir}/customer.parquet"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    return c.join(n, compat.join_key(F.concat(F.lit(" 0"), F.col("c_nationkey"))) == compat.join_key(F.col("n_nationkey").cast("double"))).select("c_custkey", "n_name")


add("compat_integer_avg", "SELECT l_returnflag f, AVG(l_linenumber) a, SUM(l_linenumber) s, COUNT(DISTINCT l_linestatus) d FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag AS f, sum(l_linenumber)::BIGINT // count(*) AS a, sum(l_linenumber)::BIGINT AS s, count(DISTINCT l_linestatus) AS d FROM lineitem GROUP BY ALL", "xbase")
add("compat_functions", "SELECT p_partkey k, ROUND(0 - p_size / 2, 0) a, LENGTH(NULL) b, CONCAT(p_brand, NULL, '!') c, INITCAP('foo-bar BAZ') d, MOD(p_size, 4) e, INT('12x') f FROM part",
    "SELECT p_partkey AS k, floor(-p_size / 2.0 + 0.5) AS a, 0 AS b, p_brand || '!' AS c, 'Foo-Bar Baz' AS d, (p_size % 4)::DOUBLE AS e, NULL::BIGINT AS f FROM part", "xbase")
