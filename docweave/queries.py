"""Registered queries of the transformation engine, each with the SQL that must give the same rows.

Most queries are scripts over a whole table (``Engine.rows``); ``fn_*`` put one function's value on every row.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, Script
from .operators import collection



def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per customer: {c_custkey, info: {name, segment}, orders: [{key, price, status, priority}]}."""
    # dealt by the key in a number that small tables keep too: what follows can cost much more than the bytes tell
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    o = load(spark, sf_dir, "orders").select("o_custkey", F.struct(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("o"))
    packed = o.repartition(parts, "o_custkey").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o")).alias("orders"))
    c = load(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("info"))
    return c.repartition(parts, "c_custkey").join(packed, F.col("c_custkey") == F.col("o_custkey")).drop("o_custkey")


def half(sql: str, digits: int) -> str:
    """SQL for rounding half away from zero on the shortest decimal text of a double."""
    return f"CAST(round(CAST(CAST({sql} AS VARCHAR) AS DECIMAL(34,15)), {digits}) AS DOUBLE)"


# ---- one function on every row -----------------------------------------------------------------------------------
_D, _E = "least(o_orderdate, TIMESTAMP '2000-01-15')", "greatest(o_orderdate, TIMESTAMP '2000-01-15')"
_M = f"((year({_E}) - year({_D})) * 12 + month({_E}) - month({_D}))"
MONTHS = f"CAST(({_M} - CASE WHEN {_M} > 0 AND {_D} + to_months(CAST({_M} AS INTEGER)) > {_E} THEN 1 ELSE 0 END) * CASE WHEN o_orderdate > TIMESTAMP '2000-01-15' THEN -1 ELSE 1 END AS DOUBLE)"
#: name -> (table, key columns, value, SQL)
FUNCTIONS: dict[str, tuple[str, list[str], str, str]] = {
    # math
    "abs": ("customer", ["c_custkey"], "=abs(@.c_acctbal)", "abs(c_acctbal)"),
    "ceiling": ("customer", ["c_custkey"], "=ceiling(@.c_acctbal)", "ceil(c_acctbal)"),
    "floor": ("customer", ["c_custkey"], "=floor(@.c_acctbal)", "floor(c_acctbal)"),
    "sign": ("customer", ["c_custkey"], "=sign(@.c_acctbal)", "CAST(sign(c_acctbal) AS DOUBLE)"),
    "sqrt": ("part", ["p_partkey"], "=round(sqrt(@.p_retailprice), 6)", half("sqrt(p_retailprice)", 6)),
    "sqrt_failure": ("customer", ["c_custkey"], "=round(sqrt(@.c_acctbal), 6)", "CASE WHEN c_acctbal >= 0 THEN " + half("sqrt(c_acctbal)", 6) + " END"),
    "pow": ("part", ["p_partkey"], "=pow(@.p_size, 3)", "CAST(power(p_size, 3) AS DOUBLE)"),
    "round": ("lineitem", ["l_orderkey", "l_linenumber"], "=round(@.l_extendedprice, 1)", half("l_extendedprice", 1)),
    "clamp": ("customer", ["c_custkey"], "=clamp(@.c_acctbal, 0, 5000)", "least(greatest(c_acctbal, 0.0), 5000.0)"),
    "subtract": ("lineitem", ["l_orderkey", "l_linenumber"], "=round(subtract(@.l_quantity, @.l_discount), 4)", half("l_quantity - l_discount", 4)),
    "divide": ("lineitem", ["l_orderkey", "l_linenumber"], "=round(divide(@.l_extendedprice, @.l_quantity), 4)", half("l_extendedprice / l_quantity", 4)),
    "divide_by_zero": ("lineitem", ["l_orderkey", "l_linenumber"], "=round(divide(@.l_quantity, @.l_discount), 4)", "CASE WHEN l_discount <> 0 THEN " + half("l_quantity / l_discount", 4) + " END"),
    "multiply": ("lineitem", ["l_orderkey", "l_linenumber"], "=round(multiply(@.l_quantity, @.l_discount, 2), 4)", half("l_quantity * l_discount * 2", 4)),
    "modulo": ("part", ["p_partkey"], "=modulo(@.p_size, 7)", "CAST(p_size % 7 AS DOUBLE)"),
    "calculate": ("part", ["p_partkey"], "=@.p_size + calculate('2 * (3 + 4) / 7')", "CAST(p_size + 2 AS DOUBLE)"),
    "infix": ("lineitem", ["l_orderkey", "l_linenumber"], "=round(@.l_extendedprice * (1 - @.l_discount) * (1 + @.l_tax), 2)", half("l_extendedprice * (1 - l_discount) * (1 + l_tax)", 2)),
    "infix_precedence": ("part", ["p_partkey"], "=2 ^ 3 ^ 1 + @.p_size % 5 * 2 - 10 / 4", "CAST(8 + (p_size % 5) * 2 - 2.5 AS DOUBLE)"),
    "variadic_sum_avg_max": ("lineitem", ["l_orderkey", "l_linenumber"], "=round(sum(@.l_tax, @.l_discount) + avg(@.l_tax, @.l_discount) + max(@.l_tax, @.l_discount) + min(@.l_tax, @.l_discount) + median(@.l_tax, @.l_discount, 1), 4)", half("l_tax + l_discount + (l_tax + l_discount) / 2 + greatest(l_tax, l_discount) + least(l_tax, l_discount) + list_sort([l_tax, l_discount, 1.0])[2]", 4)),
    "comma_numbers": ("part", ["p_partkey"], "=abs(concat('-', @.p_size, ',', @.p_size))", "CAST(CAST(p_size AS VARCHAR) || CAST(p_size AS VARCHAR) AS DOUBLE)"),
    # text
    "concat": ("customer", ["c_custkey"], "=concat(@.c_name, ' - ', @.c_mktsegment, '/', @.c_nationkey)", "c_name || ' - ' || c_mktsegment || '/' || c_nationkey"),
    "length": ("part", ["p_partkey"], "=length(@.p_name)", "CAST(length(p_name) AS DOUBLE)"),
    "substring": ("part", ["p_partkey"], "=substring(@.p_name, 2, 5)", "substr(p_name, 3, 5)"),
    "substring_tail": ("part", ["p_partkey"], "=substring(@.p_name, 4)", "substr(p_name, 5)"),
    "right": ("customer", ["c_custkey"], "=right(@.c_name, 4)", "right(c_name, 4)"),
    "toupper": ("part", ["p_partkey"], "=toUpper(@.p_name)", "upper(p_name)"),
    "tolower": ("part", ["p_partkey"], "=tolower(@.p_type)", "lower(p_type)"),
    "trim": ("part", ["p_partkey"], "=concat('[', trim(concat('  ', @.p_name, ' ')), ']')", "'[' || trim(p_name) || ']'"),
    "trimstart": ("part", ["p_partkey"], "=trimStart(concat('  ', @.p_name, ' '))", "ltrim(p_name) || ' '"),
    "trimend": ("part", ["p_partkey"], "=trimEnd(concat('  ', @.p_name, ' '))", "'  ' || rtrim(p_name)"),
    "startswith": ("part", ["p_partkey"], "=startsWith(@.p_brand, 'BRAND#1')", "starts_with(lower(p_brand), 'brand#1')"),
    "endswith": ("part", ["p_partkey"], "=endsWith(@.p_brand, '3')", "ends_with(p_brand, '3')"),
    "contains": ("part", ["p_partkey"], "=contains(@.p_type, 'ECO')", "contains(lower(p_type), 'eco')"),
    "indexof": ("part", ["p_partkey"], "=indexOf(@.p_name, '1')", "CAST(strpos(lower(p_name), '1') - 1 AS DOUBLE)"),
    "replace": ("part", ["p_partkey"], "=replace(@.p_name, '1', '<one>')", "replace(p_name, '1', '<one>')"),
    "split_join": ("part", ["p_partkey"], "=join(split(@.p_brand, '#'), '|')", "replace(p_brand, '#', '|')"),
    "padleft": ("part", ["p_partkey"], "=padLeft(@.p_size, 6, '0')", "CASE WHEN length(CAST(p_size AS VARCHAR)) >= 6 THEN CAST(p_size AS VARCHAR) ELSE lpad(CAST(p_size AS VARCHAR), 6, '0') END"),
    "padright": ("part", ["p_partkey"], "=padRight(@.p_brand, 12, '.')", "CASE WHEN length(p_brand) >= 12 THEN p_brand ELSE rpad(p_brand, 12, '.') END"),
    "format": ("part", ["p_partkey"], "=format('{0}: {1:D4} ({{x}})', @.p_brand, @.p_size)", "p_brand || ': ' || lpad(CAST(p_size AS VARCHAR), 4, '0') || ' ({x})'"),
    "tofixed": ("part", ["p_partkey"], "=toFixed(@.p_size, 2, ',')", "CAST(p_size AS VARCHAR) || ',00'"),
    "tostring": ("part", ["p_partkey"], "=toString(@.p_size)", "CAST(p_size AS VARCHAR)"),
    "isempty": ("part", ["p_partkey"], "=isEmpty(replace(@.p_brand, 'Brand#11', ''))", "replace(p_brand, 'Brand#11', '') = ''"),
    "regexreplace": ("part", ["p_partkey"], "=regexReplace(@.p_brand, '(\\w+)#(\\d)', '$2-$1')", "regexp_replace(p_brand, '(\\w+)#(\\d)', '\\2-\\1', 'g')"),
    "regexextract": ("part", ["p_partkey"], "=regexExtract(@.p_brand, '#(\\d+)', 1)", "regexp_extract(p_brand, '#(\\d+)', 1)"),
    # predicates
    "equals": ("orders", ["o_orderkey"], "=equals(@.o_orderstatus, 'O')", "o_orderstatus = 'O'"),
    "equals_loose_number": ("part", ["p_partkey"], "=equals(@.p_size, '7')", "p_size = 7"),
    "notequals": ("orders", ["o_orderkey"], "=notEquals(@.o_orderstatus, 'O')", "o_orderstatus <> 'O'"),
    "greaterthan": ("orders", ["o_orderkey"], "=greaterThan(@.o_totalprice, 100000)", "o_totalprice > 100000"),
    "greaterorequal": ("part", ["p_partkey"], "=greaterOrEqual(@.p_size, '10')", "p_size >= 10"),
    "lessthan": ("part", ["p_partkey"], "=lessThan(@.p_brand, 'Brand#3')", "p_brand < 'Brand#3'"),
    "lessorequal": ("part", ["p_partkey"], "=lessOrEqual(@.p_size, 10)", "p_size <= 10"),
    "between": ("part", ["p_partkey"], "=between(@.p_size, 5, 10)", "p_size BETWEEN 5 AND 10"),
    "and_or_not": ("part", ["p_partkey"], "=and(or(lessThan(@.p_size, 5), greaterThan(@.p_size, 40)), not(contains(@.p_brand, '1')))", "(p_size < 5 OR p_size > 40) AND NOT contains(p_brand, '1')"),
    "exists": ("part", ["p_partkey"], "=and(exists(@.p_size), not(exists(@.nowhere)))", "true"),
    "isnull": ("customer", ["c_custkey"], "=isNull(@.c_acctbal)", "c_acctbal IS NULL"),
    "kinds": ("part", ["p_partkey"], "=concat(isString(@.p_name), isNumber(@.p_size), isBoolean(@.p_size), isArray(@.p_name), isObject(@.p_name))", "'truetruefalsefalsefalse'"),
    "in": ("orders", ["o_orderkey"], "=in(@.o_orderstatus, 'F', 'P')", "o_orderstatus IN ('F', 'P')"),
    "matches": ("orders", ["o_orderkey"], "=matches(@.o_orderpriority, '^[12]')", "regexp_matches(o_orderpriority, '^[12]')"),
    "if": ("part", ["p_partkey"], "=if(greaterThan(@.p_size, 25), 'big', @.p_brand)", "CASE WHEN p_size > 25 THEN 'big' ELSE p_brand END"),
    "coalesce": ("part", ["p_partkey"], "=coalesce(@.nowhere, replace(@.p_brand, 'Brand#11', ''), 'none')", "coalesce(nullif(replace(p_brand, 'Brand#11', ''), ''), 'none')"),
    "fetch": ("part", ["p_partkey"], "=concat(fetch(@.p_brand), fetch(@.nowhere, 'dflt'))", "p_brand || 'dflt'"),
    # dates
    "datecompare": ("lineitem", ["l_orderkey", "l_linenumber"], "=dateCompare(@.l_shipdate, '1995-06-17')", "CAST(CASE WHEN l_shipdate > TIMESTAMP '1995-06-17' THEN 1 WHEN l_shipdate < TIMESTAMP '1995-06-17' THEN -1 ELSE 0 END AS DOUBLE)"),
    "isdatebetween": ("orders", ["o_orderkey"], "=isDateBetween(@.o_orderdate, '1994-01-01', '12/31/1995')", "o_orderdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1995-12-31'"),
    "datediff_days": ("orders", ["o_orderkey"], "=dateDiff(@.o_orderdate, '2000-01-01')", "CAST(trunc((epoch_us(TIMESTAMP '2000-01-01') - epoch_us(o_orderdate)) / 86400000000.0) AS DOUBLE)"),
    "datediff_months": ("orders", ["o_orderkey"], "=dateDiff(@.o_orderdate, '2000-01-15', 'months')", MONTHS),
    "dateadd_month": ("orders", ["o_orderkey"], "=substring(dateAdd(@.o_orderdate, 1, 'month'), 0, 10)", "strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d')"),
    "dateadd_day": ("orders", ["o_orderkey"], "=substring(dateAdd(@.o_orderdate, -10, 'days'), 0, 10)", "strftime(o_orderdate - INTERVAL 10 DAY, '%Y-%m-%d')"),
    "datepart": ("orders", ["o_orderkey"], "=datePart(@.o_orderdate, 'year') * 1000000 + datePart(@.o_orderdate, 'quarter') * 100000 + datePart(@.o_orderdate, 'week') * 1000 + datePart(@.o_orderdate, 'dayofweek') * 100 + datePart(@.o_orderdate, 'daysInMonth')", "CAST(year(o_orderdate) * 1000000 + quarter(o_orderdate) * 100000 + week(o_orderdate) * 1000 + isodow(o_orderdate) * 100 + day(last_day(o_orderdate)) AS DOUBLE)"),
    "formatdate": ("orders", ["o_orderkey"], "=formatDate(@.o_orderdate, 'dddd dd MMM yyyy')", "strftime(o_orderdate, '%A %d %b %Y')"),
    "parsedate": ("part", ["p_partkey"], "=parseDate(concat('0', modulo(@.p_size, 9) + 1, '/02/2001'), 'MM/dd/yyyy')", "'2001-0' || (p_size % 9 + 1) || '-02'"),
    "startofmonth": ("orders", ["o_orderkey"], "=startOfMonth(@.o_orderdate)", "strftime(date_trunc('month', o_orderdate), '%Y-%m-%d')"),
    "endofmonth": ("orders", ["o_orderkey"], "=endOfMonth(@.o_orderdate)", "strftime(last_day(o_orderdate), '%Y-%m-%d')"),
    "daycountfraction": ("orders", ["o_orderkey"], "=round(dayCountFraction(startOfMonth(@.o_orderdate), '2000-01-31', '30E360') + dayCountFraction(startOfMonth(@.o_orderdate), '2000-01-31', 'A365'), 6)", half("((2000 - year(o_orderdate)) * 360 + (1 - month(o_orderdate)) * 30 + 29) / 360.0 + date_diff('day', date_trunc('month', o_orderdate), TIMESTAMP '2000-01-31') / 365.0", 6)),
    "mindate_maxdate": ("orders", ["o_orderkey"], "=concat(minDate(startOfMonth(@.o_orderdate), '1995-01-01'), maxDate(startOfMonth(@.o_orderdate), '1995-01-01'))", "strftime(least(date_trunc('month', o_orderdate), TIMESTAMP '1995-01-01'), '%Y-%m-%d') || strftime(greatest(date_trunc('month', o_orderdate), TIMESTAMP '1995-01-01'), '%Y-%m-%d')"),
    "avgdate": ("orders", ["o_orderkey"], "=substring(avgDate(startOfMonth(@.o_orderdate), endOfMonth(@.o_orderdate)), 0, 10)", "strftime(make_timestamp(CAST((epoch_us(date_trunc('month', o_orderdate)) + epoch_us(CAST(last_day(o_orderdate) AS TIMESTAMP))) // 2 AS BIGINT)), '%Y-%m-%d')"),
}

#: The same over arrays inside a document per customer.
NESTED_SQL = "WITH n AS (SELECT c_custkey, list({'key': o_orderkey, 'price': o_totalprice, 'status': o_orderstatus, 'priority': o_orderpriority} ORDER BY o_orderkey) AS orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) SELECT c_custkey, {} AS out FROM n"
NESTED: dict[str, tuple[str, str]] = {
    "array_sum": ("=round(sum($.orders[*].price), 2)", half("list_sum([x.price for x in orders])", 2)),
    "array_avg": ("=round(avg($.orders[*].price), 2)", half("list_avg([x.price for x in orders])", 2)),
    "array_min_max": ("=round(max($.orders[*].price) - min($.orders[*].price), 2)", half("list_max([x.price for x in orders]) - list_min([x.price for x in orders])", 2)),
    "array_count": ("=count($.orders[*])", "CAST(len(orders) AS DOUBLE)"),
    "array_median": ("=round(median($.orders[*].price), 2)", half("list_median([x.price for x in orders])", 2)),
    "array_sumifs": ("=round(sumifs($.orders[*].price, $.orders[*].status, 'o', $.orders[*].price, '>50000'), 2)", half("coalesce(list_sum([x.price for x in orders if x.status = 'O' and x.price > 50000]), 0)", 2)),
    "array_countif": ("=countif($.orders[*].priority, '*URGENT')", "CAST(len([x for x in orders if ends_with(x.priority, 'URGENT')]) AS DOUBLE)"),
    "array_averageif": ("=round(averageif($.orders[*].status, '<>O', $.orders[*].price), 2)", half("coalesce(list_avg([x.price for x in orders if x.status <> 'O']), 0)", 2)),
    "path_filter_array": ("=count($.orders[?(@.price > 100000 && @.status == 'O')])", "CAST(len([x for x in orders if x.price > 100000 and x.status = 'O']) AS DOUBLE)"),
    "path_filter_regex": ("=count($.orders[?(@.priority =~ /^[12]-/)])", "CAST(len([x for x in orders if regexp_matches(x.priority, '^[12]-')]) AS DOUBLE)"),
    "path_index": ("=fetch($.orders[0].key)", "orders[1].key"),
    "path_slice_array": ("=join($.orders[1:6:2].key, '-')", "array_to_string([x.key for x, i in orders if i >= 2 and i <= 6 and (i - 2) % 2 = 0], '-')"),
    "path_union": ("=join($.orders[0,2].key, '-')", "array_to_string([x.key for x, i in orders if i in (1, 3)], '-')"),
    "path_deep": ("=count($..price)", "CAST(len(orders) AS DOUBLE)"),
    "sort_array": ("=join(sort($.orders[*].priority, 'desc'), ',')", "array_to_string(list_reverse_sort([x.priority for x in orders]), ',')"),
    "distinct_array": ("=join(sort(distinct($.orders[*].status)), ',')", "array_to_string(list_sort(list_distinct([x.status for x in orders])), ',')"),
    "sortby_array": ("=partial(sortby($.orders, 'price', 'desc'))", ""),
    "last_partial": ("=concat(last($.orders[*].key), '/', partial($.orders[*].key, 0))", "orders[-1].key || '/' || orders[1].key"),
    "resolve_function": ("=resolve($.orders, 'status', 'O', 'key')", "[x.key for x in orders if x.status = 'O'][1]"),
    "in_array": ("=in('P', $.orders[*].status)", "len([x for x in orders if x.status = 'P']) > 0"),
}
del NESTED["sortby_array"]


def _function(table: str, keys: list[str], value: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = Engine().rows(load(spark, sf_dir, table), [{"command": "put", "path": "$[*]", "property": "out", "value": value}]).rows
        return rows.select(*keys, "out")

    return run


def _nested(value: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .operators.document import transform

        return transform(nested_orders(spark, sf_dir), [{"command": "put", "path": "$.out", "value": value}]).select("c_custkey", "out")

    return run


# ---- scripts over tables -----------------------------------------------------------------------------------------
#: name -> (table, order key, other tables, script, columns or output, SQL)
SCRIPTS: dict[str, tuple] = {}


def script(name: str, table: str, commands: list | Script, columns: list[str] | str, sql: str, order: str | None = None, tables: dict | None = None) -> None:
    SCRIPTS[name] = (table, order, tables or {}, commands.commands if isinstance(commands, Script) else commands, columns, sql)


LINE = ["l_orderkey", "l_linenumber"]
script("put_computed", "lineitem", Script().put("$[*]", "=round(@.l_extendedprice * (1 - @.l_discount), 2)", "net"), [*LINE, "net"], f"SELECT l_orderkey, l_linenumber, {half('l_extendedprice * (1 - l_discount)', 2)} AS net FROM lineitem")
script("put_legacy_path", "part", Script().put("$[*].label", "=concat(@.p_brand, '/', @.p_size)"), ["p_partkey", "label"], "SELECT p_partkey, p_brand || '/' || p_size AS label FROM part")
script("put_filtered_path", "part", Script().put("$[?(@.p_size > 25)].p_brand", "large"), ["p_partkey", "p_brand"], "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' ELSE p_brand END AS p_brand FROM part")
script("put_template", "part", Script().put("$[*].info", {"brand": "=toUpper(@.p_brand)", "fixed": 1}).put("$[*].b", "=concat(@.info.brand, @.info.fixed)"), ["p_partkey", "b"], "SELECT p_partkey, upper(p_brand) || '1' AS b FROM part")
script("put_deep_path", "part", Script().put("$[*].a.b.c", "@.p_size").set("$[*].a.b.c", "=@.a.b.c + 1").put("$[*].flat", "@.a.b.c"), ["p_partkey", "flat"], "SELECT p_partkey, CAST(p_size + 1 AS DOUBLE) AS flat FROM part")
script("set_existing", "orders", Script().set("$[*].o_orderstatus", "=tolower(@.o_orderstatus)").set("$[*].nowhere", 1), ["o_orderkey", "o_orderstatus"], "SELECT o_orderkey, lower(o_orderstatus) AS o_orderstatus FROM orders")
script("set_failing_keeps", "customer", Script().set("$[*].c_acctbal", "=sqrt(@.c_acctbal)").set("$[*].c_acctbal", "=round(@.c_acctbal, 4)"), ["c_custkey", "c_acctbal"], f"SELECT c_custkey, {half('CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) ELSE c_acctbal END', 4)} AS c_acctbal FROM customer")
script("add_missing_only", "part", Script().add("$[*].p_brand", "x").add("$[*].fresh", "=@.p_size * 2"), ["p_partkey", "p_brand", "fresh"], "SELECT p_partkey, p_brand, CAST(p_size * 2 AS DOUBLE) AS fresh FROM part")
script("remove_field", "part", Script().remove("$[*].p_name").remove("$[*]['p_type','p_brand']").remove("$[*].p_retailprice"), ["*"], "SELECT p_partkey, p_size FROM part")
script("remove_rows", "part", Script().remove("$[?(@.p_size > 10 || @.p_brand == 'Brand#11')]"), ["p_partkey", "p_size"], "SELECT p_partkey, p_size FROM part WHERE NOT (p_size > 10 OR p_brand = 'Brand#11')")
script("rename_field", "region", Script().rename("$[*].r_name", "name"), ["*"], "SELECT r_regionkey, r_name AS name FROM region")
script("copy_field", "region", Script().copy("$[*].r_name", "$[*].copy.name").put("$[*].x", "@.copy.name"), ["r_regionkey", "r_name", "x"], "SELECT r_regionkey, r_name, r_name AS x FROM region")
script("move_field", "region", Script().move("$[*].r_name", "$[*].moved"), ["*"], "SELECT r_regionkey, r_name AS moved FROM region")
script("set_properties", "nation", [{"command": "setProperties", "path": "$[*]", "properties": ["n_name"], "value": "=concat('<', toUpper(@), '>')"}], ["n_nationkey", "n_name"], "SELECT n_nationkey, '<' || upper(n_name) || '>' AS n_name FROM nation")
script("if_else", "orders", Script().if_else("=greaterThan(@.o_totalprice, 150000)", Script().put("$[*].band", "high").put("$[*].fee", "=round(@.o_totalprice * 0.01, 2)"), Script().put("$[*].band", "low")), ["o_orderkey", "band", "fee"], f"SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'high' ELSE 'low' END AS band, CASE WHEN o_totalprice > 150000 THEN {half('o_totalprice * 0.01::DOUBLE', 2)} END AS fee FROM orders")
script("for_each_rows", "part", [{"command": "forEach", "path": "$", "commands": [{"command": "put", "path": "@.half", "value": "=@.p_size / 2"}, {"command": "put", "path": "@.quarter", "value": "=@.half / 2"}]}], ["p_partkey", "quarter"], "SELECT p_partkey, p_size / 4.0 AS quarter FROM part")
script("flagship", "lineitem", [{"command": "put", "path": "$[*]", "property": "net", "value": "=round(@.l_extendedprice * (1 - @.l_discount), 2)"}, {"command": "put", "path": "$summary", "property": "returned", "value": "=round(sumifs($[*].net, $[*].l_returnflag, 'R'), 2)", "groupBy": ["l_linestatus"]}, {"command": "put", "path": "$summary", "property": "lines", "value": "=count($[*])", "groupBy": ["l_linestatus"]}, {"command": "put", "path": "$summary", "property": "mean", "value": "=round(avg($[*].net), 2)", "groupBy": ["l_linestatus"]}], "summary", f"SELECT l_linestatus, round(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN net END), 0), 2) AS returned, CAST(count(*) AS DOUBLE) AS lines, round(avg(net), 2) AS mean FROM (SELECT *, {half('l_extendedprice * (1 - l_discount)', 2)} AS net FROM lineitem) GROUP BY l_linestatus")


def _aggregate(name: str, value: str, sql: str, table: str = "lineitem") -> None:
    script(name, table, [{"command": "put", "path": "$out", "property": "out", "value": value}], "out", f"SELECT {sql} AS out FROM {table}")


_aggregate("agg_sum", "=round(sum($[*].l_quantity), 2)", half("sum(l_quantity)", 2))
_aggregate("agg_avg_null_zero", "=round(avg($[*].l_extendedprice), 3)", half("sum(coalesce(l_extendedprice, 0)) / count(*)", 3))
_aggregate("agg_count", "=count($[*])", "CAST(count(*) AS DOUBLE)")
_aggregate("agg_min", "=min($[*].l_extendedprice)", "min(coalesce(l_extendedprice, 0))")
_aggregate("agg_max", "=max($[*].l_extendedprice)", "max(coalesce(l_extendedprice, 0))")
_aggregate("agg_median", "=round(median($[*].l_extendedprice), 4)", half("median(coalesce(l_extendedprice, 0))", 4))
_aggregate("agg_sumif", "=round(sumif($[*].l_quantity, '>=45'), 2)", half("sum(CASE WHEN l_quantity >= 45 THEN l_quantity END)", 2))
_aggregate("agg_sumif_range", "=round(sumif($[*].l_returnflag, 'r', $[*].l_quantity), 2)", half("sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END)", 2))
_aggregate("agg_sumifs", "=round(sumifs($[*].l_extendedprice, $[*].l_returnflag, 'A', $[*].l_quantity, '<10'), 2)", half("sum(CASE WHEN l_returnflag = 'A' AND l_quantity < 10 THEN l_extendedprice END)", 2))
_aggregate("agg_countif", "=countif($[*].l_discount, '<>0')", "CAST(count(CASE WHEN l_discount <> 0 THEN 1 END) AS DOUBLE)")
_aggregate("agg_countifs", "=countifs($[*].l_returnflag, 'N', $[*].l_linestatus, '!=F')", "CAST(count(CASE WHEN l_returnflag = 'N' AND l_linestatus <> 'F' THEN 1 END) AS DOUBLE)")
_aggregate("agg_averageif", "=round(averageif($[*].l_returnflag, 'A', $[*].l_quantity), 4)", half("coalesce(avg(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 0)", 4))
_aggregate("agg_averageifs_none", "=averageifs($[*].l_quantity, $[*].l_returnflag, 'zzz')", "CAST(0 * count(*) AS DOUBLE)")
_aggregate("agg_minifs", "=minifs($[*].l_extendedprice, $[*].l_quantity, '>40')", "min(CASE WHEN l_quantity > 40 THEN l_extendedprice END)")
_aggregate("agg_maxifs", "=maxifs($[*].l_extendedprice, $[*].l_quantity, '<=2')", "max(CASE WHEN l_quantity <= 2 THEN l_extendedprice END)")
_aggregate("agg_criteria_wildcard", "=countif($[*].p_name, '*a?o*')", "CAST(count(CASE WHEN regexp_matches(lower(p_name), 'a.o') THEN 1 END) AS DOUBLE)", "part")
_aggregate("agg_mindate_maxdate", "=concat(substring(minDate($[*].o_orderdate), 0, 10), substring(maxDate($[*].o_orderdate), 0, 10))", "strftime(min(o_orderdate), '%Y-%m-%d') || strftime(max(o_orderdate), '%Y-%m-%d')", "orders")
_aggregate("agg_infix_of_aggregates", "=round(sum($[*].l_tax) / count($[*]) * 100, 4)", half("sum(l_tax) / count(*) * 100", 4))
script("share_of_total", "part", Script().put("$[*]", "=round(@.p_retailprice / sum($[*].p_retailprice) * 1000000, 4)", "share"), ["p_partkey", "share"], f"SELECT p_partkey, {half('p_retailprice / (SELECT sum(p_retailprice) FROM part) * 1000000', 4)} AS share FROM part")

for _n, _path, _sql in (
    ("eq", "@.o_orderstatus == 'F'", "o_orderstatus = 'F'"),
    ("cmp", "@.o_totalprice >= 200000", "o_totalprice >= 200000"),
    ("and_or", "(@.o_totalprice < 20000 || @.o_totalprice > 200000) && @.o_orderpriority != '5-LOW'", "(o_totalprice < 20000 OR o_totalprice > 200000) AND o_orderpriority <> '5-LOW'"),
    ("regex", "@.o_orderpriority =~ /urgent$/i", "regexp_matches(o_orderpriority, '(?i)urgent$')"),
    ("exists", "@.o_custkey", "o_custkey IS NOT NULL"),
    ("strict", "@.o_orderstatus === 'P'", "o_orderstatus = 'P'"),
    ("date", "@.o_orderdate > '1996-01-01'", "o_orderdate > TIMESTAMP '1996-01-01'"),
):
    script(f"path_filter_{_n}", "orders", [{"command": "put", "path": "$", "value": f"$[?({_path})]"}], ["o_orderkey"], f"SELECT o_orderkey FROM orders WHERE {_sql}")
script("path_slice_first", "orders", [{"command": "put", "path": "$", "value": "$[0:25]"}], ["o_orderkey"], "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25", "o_orderkey")
script("path_slice_last", "orders", [{"command": "put", "path": "$", "value": "$[-7:]"}], ["o_orderkey"], "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7", "o_orderkey")
script("path_slice_stop_from_end", "orders", [{"command": "put", "path": "$", "value": "$[-30:-9:4]"}], ["o_orderkey"], "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) WHERE i >= n - 30 AND i < n - 9 AND (i - n + 30) % 4 = 0", "o_orderkey")
script("path_slice_back", "orders", [{"command": "put", "path": "$", "value": "$[50:7:-6]"}], ["o_orderkey"], "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i <= 50 AND i > 7 AND (50 - i) % 6 = 0", "o_orderkey")
script("path_slice_step", "orders", [{"command": "put", "path": "$", "value": "$[10:500:7]"}], ["o_orderkey"], "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i >= 10 AND i < 500 AND (i - 10) % 7 = 0", "o_orderkey")
script("topk_sortby", "orders", [{"command": "put", "path": "$", "value": "=sortby($, 'o_totalprice', 'desc')"}, {"command": "put", "path": "$", "value": "$[0:40]"}], ["o_orderkey", "o_totalprice"], "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40", "o_orderkey")
script("distinct_rows", "orders", [{"command": "remove", "path": "$[*]['o_orderkey','o_custkey','o_totalprice','o_orderdate']"}, {"command": "put", "path": "$", "value": "=distinct($)"}], ["*"], "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
script("last_row", "events", [{"command": "put", "path": "$", "value": "=last($)"}], ["event_id"], "SELECT max(event_id) AS event_id FROM events", "event_id")
script("partial_row", "events", [{"command": "put", "path": "$", "value": "=partial($, 3)"}], ["event_id"], "SELECT event_id FROM events ORDER BY event_id LIMIT 1 OFFSET 3", "event_id")
script("filter_by_schema", "part", [{"command": "put", "path": "$", "value": "=filterBySchema({\"type\":\"array\",\"items\":{\"properties\":{\"p_size\":{},\"p_partkey\":{}}}}, $)"}], ["*"], "SELECT p_partkey, p_size FROM part")
script("order_by_schema", "region", [{"command": "put", "path": "$", "value": "=orderBySchema({\"items\":{\"properties\":{\"r_name\":{}}}}, $)"}], ["*"], "SELECT r_name, r_regionkey FROM region")


def _resolve(collection_path: str, keys: list[tuple[str, str]], values: list[dict], order: list[str] | None = None) -> list[dict]:
    return [{"command": "resolve", "path": "$[*]", "resolveSettings": [{"resolveKeys": [{"keyPath": a, "referenceKeyPath": b} for a, b in keys], "referencesCollectionPath": collection_path, "values": values} | ({"order": order} if order else {})]}]


script("resolve_left_lookup", "orders", _resolve("$customer[*]", [("@.o_custkey", "@.c_custkey")], [{"targetPath": "@.segment", "value": "@.c_mktsegment", "resolveTypeBehavior": "AlwaysAsObject"}, {"targetPath": "@.name", "value": "=toUpper(@.c_name)"}]), ["o_orderkey", "segment", "name"], "SELECT o_orderkey, c_mktsegment AS segment, upper(c_name) AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey", tables={"customer": "customer"})
script("resolve_filtered_references", "nation", _resolve("$region[?(@.r_name != 'ASIA')]", [("@.n_regionkey", "@.r_regionkey")], [{"targetPath": "@.region", "value": "@.r_name"}]), ["n_nationkey", "region"], "SELECT n_nationkey, r_name AS region FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_name <> 'ASIA'", tables={"region": "region"})
script("resolve_as_array", "customer", [*_resolve("$orders[*]", [("@.c_custkey", "@.o_custkey")], [{"targetPath": "@.keys", "value": "@.o_orderkey", "resolveTypeBehavior": "AlwaysAsArray"}]), {"command": "put", "path": "$[*].joined", "value": "=join(@.keys, '-')"}], ["c_custkey", "joined"], "SELECT c_custkey, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), '-' ORDER BY o_orderkey), '') AS joined FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", tables={"orders": "orders"})
script("resolve_multi_key", "lineitem", [{"command": "put", "path": "$", "value": "$[?(@.l_linenumber == 1)]"}, *_resolve("$lines[*]", [("@.l_orderkey", "@.l_orderkey"), ("@.l_returnflag", "@.l_returnflag")], [{"targetPath": "@.same", "value": "@.l_linenumber", "resolveTypeBehavior": "AlwaysAsArray"}]), {"command": "put", "path": "$[*].n", "value": "=length(@.same)"}], ["l_orderkey", "n"], "SELECT a.l_orderkey, CAST((SELECT count(*) FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = a.l_returnflag) AS DOUBLE) AS n FROM lineitem a WHERE a.l_linenumber = 1", tables={"lines": "lineitem"})

MERGE = {"arraySettings": [{"arrayPath": "$", "keyPaths": ["@.c_custkey"]}]}


def _merge_sql(strategy: str) -> str:
    t, s = "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING'", "SELECT c_custkey, 'new' AS c_name, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal >= 0"
    pick = {"full": "CASE WHEN s.c_custkey IS NOT NULL THEN s.c_name ELSE t.c_name END AS c_name, t.c_acctbal, s.c_nationkey", "values": "CASE WHEN s.c_custkey IS NOT NULL THEN s.c_name ELSE t.c_name END AS c_name, t.c_acctbal", "structure": "CASE WHEN t.c_custkey IS NOT NULL THEN t.c_name ELSE s.c_name END AS c_name, t.c_acctbal, s.c_nationkey"}[strategy]
    return f"SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, {pick} FROM ({t}) t {'LEFT' if strategy == 'values' else 'FULL'} JOIN ({s}) s ON t.c_custkey = s.c_custkey"


def _merge(strategy: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = load(spark, sf_dir, "customer")
        target = c.filter("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_name", "c_acctbal")
        source = c.filter("c_mktsegment = 'BUILDING' OR c_acctbal >= 0").select("c_custkey", F.lit("new").alias("c_name"), "c_nationkey")
        return Engine().rows(target, [{"command": "merge", "path": "$s", "targetPath": "$", "settings": MERGE | {"strategy": strategy}}], tables={"s": source}).rows

    return run


def _lists(command: dict) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = load(spark, sf_dir, "orders")
        target = o.filter("o_totalprice < 50000").select("o_orderpriority", "o_orderstatus")
        source = o.filter("o_totalprice >= 40000").select("o_orderpriority", "o_orderstatus")
        return Engine().rows(target, [{"command": "merge", "path": "$s", "targetPath": "$", **command}], tables={"s": source}).rows

    return run


_T, _S = "SELECT o_orderpriority, o_orderstatus FROM orders WHERE o_totalprice < 50000", "SELECT o_orderpriority, o_orderstatus FROM orders WHERE o_totalprice >= 40000"


def _compared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = load(spark, sf_dir, "customer")
    a = c.filter("c_mktsegment <> 'MACHINERY'").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    b = c.filter("c_mktsegment <> 'FURNITURE'").select("c_custkey", "c_name", F.when(F.col("c_nationkey") < 5, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal"), F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("c_nationkey"))
    return a, b


def compare_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _compared(spark, sf_dir)
    out = Engine().rows(a, [{"command": "compare", "firstPath": "$", "secondPath": "$other", "resultPath": "$diff", "settings": {"arraySettings": [{"arrayPath": "$", "keyPaths": ["@.c_custkey"]}]}}], tables={"other": b}).outputs["diff"]
    return out.select("c_custkey", "differenceType", "differenceSubType", "property")


def compare_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Engine().rows(load(spark, sf_dir, "lineitem"), [{"command": "compare", "firstPath": "@.l_tax", "secondPath": "@.l_discount", "resultPath": "@.verdict"}]).rows
    return rows.select("l_orderkey", "l_linenumber", "verdict")


def structural_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _compared(spark, sf_dir)
    changes = collection.structural_changes(a.select("c_custkey", "c_name", "c_nationkey"), b.select("c_custkey", F.col("c_name").alias("title"), "c_nationkey"), ["c_custkey"])
    return changes.select("c_custkey", "path", "kind")


_A = "(SELECT * FROM customer WHERE c_mktsegment <> 'MACHINERY')"
_B = "(SELECT c_custkey, c_name, CASE WHEN c_nationkey < 5 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal >= 0 THEN c_nationkey END AS c_nationkey FROM customer WHERE c_mktsegment <> 'FURNITURE')"
COMPARE_SQL = f"""
SELECT a.c_custkey, 'arrayDifference' AS differenceType, 'missingInSecond' AS differenceSubType, NULL::VARCHAR AS property FROM {_A} a ANTI JOIN {_B} b USING (c_custkey)
UNION ALL SELECT b.c_custkey, 'arrayDifference', 'missingInFirst', NULL FROM {_B} b ANTI JOIN {_A} a USING (c_custkey)
UNION ALL SELECT a.c_custkey, 'valueDifference', 'notEquals', 'c_acctbal' FROM {_A} a JOIN {_B} b USING (c_custkey) WHERE abs(a.c_acctbal - b.c_acctbal) > 1e-10
UNION ALL SELECT a.c_custkey, 'valueDifference', 'notEquals', 'c_nationkey' FROM {_A} a JOIN {_B} b USING (c_custkey) WHERE a.c_nationkey IS DISTINCT FROM b.c_nationkey
"""

RULES = [
    {"priority": 1, "conditions": {"price": ">200000", "status": ["F", "P"]}, "results": {"band": "top", "score": 10}},
    {"priority": 2, "conditions": {"price": ">100000 && <=200000"}, "results": {"band": "mid", "score": 5}},
    {"priority": 3, "conditions": {"status": "O", "urgency": "=1-URGENT || =2-HIGH"}, "results": {"band": "rush", "score": 7}},
]
_C = ["o_totalprice > 200000 AND o_orderstatus IN ('F', 'P')", "o_totalprice > 100000 AND o_totalprice <= 200000", "o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')"]


def _decision(mode: str, conflict: str = "priority") -> Callable[[SparkSession, str], DataFrame]:
    table = {"inputs": [{"name": "price", "path": "@.o_totalprice"}, {"name": "status", "path": "@.o_orderstatus"}, {"name": "urgency", "path": "@.o_orderpriority"}], "outputs": [{"name": "band", "path": "@.band"}, {"name": "score", "path": "@.score"}], "rules": RULES, "defaultResults": {"band": "none", "score": 0}, "strategy": {"mode": mode, "conflictResolution": conflict}}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = Engine().rows(load(spark, sf_dir, "orders"), [{"command": "decisionTable", "path": "$[*]", "decisionTable": table}]).rows
        return rows.select("o_orderkey", "band", F.col("score").cast("double").alias("score"))

    return run


def _decision_sql(order: list[int]) -> str:
    when = lambda key: " ".join(f"WHEN {_C[i]} THEN {RULES[i]['results'][key]!r}" for i in order)
    return f"SELECT o_orderkey, CASE {when('band')} ELSE 'none' END AS band, CAST(CASE {when('score')} ELSE 0 END AS DOUBLE) AS score FROM orders"


DECISION_MERGE_SQL = f"""
SELECT o_orderkey, CASE WHEN {_C[2]} THEN 'rush' WHEN {_C[1]} THEN 'mid' WHEN {_C[0]} THEN 'top' ELSE 'none' END AS band,
  CAST(coalesce(greatest(CASE WHEN {_C[0]} THEN 10 END, CASE WHEN {_C[1]} THEN 5 END, CASE WHEN {_C[2]} THEN 7 END), 0) AS DOUBLE) AS score FROM orders
"""


def foreach_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property of each array element, then one number of them."""
    from .operators.document import transform

    out = transform(nested_orders(spark, sf_dir), [{"command": "put", "path": "$.orders[*]", "property": "vat", "value": "=round(@.price * 0.21, 2)"}, {"command": "put", "path": "$.total", "value": "=round(sum($.orders[*].vat), 2)"}])
    return out.select("c_custkey", "total")


def flatten_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nested_orders(spark, sf_dir).select("c_custkey", "info")
    return Engine().rows(rows, [{"command": "flatten", "path": "$", "flattenSettings": {"delimiter": "_"}}]).rows


def restore_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nested_orders(spark, sf_dir).select("c_custkey", "info")
    back = Engine().rows(rows, [{"command": "flatten", "path": "$", "flattenSettings": {"delimiter": "_x_"}}, {"command": "restore", "path": "$", "restoreSettings": {"delimiter": "_x_"}}]).rows
    return back.select("c_custkey", F.col("info.name").alias("name"), F.col("info.segment").alias("segment"))


def to_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return Engine().rows(part, [{"command": "toCsv", "path": "$", "csvSettings": {"delimiter": ";", "quoteAllFields": True}}]).outputs["csv"]


def exists_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an order over 200000: a filter over the nested array."""
    from .operators.document import transform

    out = transform(nested_orders(spark, sf_dir), [{"command": "put", "path": "$.big", "value": "=exists($.orders[?(@.price > 200000)])"}])
    return out.filter("big").select("c_custkey")


# ---- dynamic tier ---------------------------------------------------------------------------------------------------
def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_orders(spark, sf_dir).select("c_custkey", F.to_json(F.struct("info", "orders")).alias("doc"))


def dynamic_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script of many commands over JSON text: data-dependent paths, loops, lookups inside the document."""
    steps = [
        {"command": "put", "path": "$.ref", "value": "$.info.name"},
        {"command": "put", "path": "$.pointer", "value": "'$$.info.segment'"},
        {"command": "put", "path": "$.pointer", "value": "=concat('$', '.info.segment')"},
        {"command": "put", "path": "$.total", "value": 0},
        {"command": "forEach", "path": "$.orders", "commands": [{"command": "set", "path": "$.total", "value": "=round($.total + @.price, 2)"}]},
        {"command": "put", "path": "$.n", "value": 0},
        {"command": "while", "condition": "=lessThan($.n, 3)", "maxIterations": 10, "commands": [{"command": "set", "path": "$.n", "value": "=$.n + 1"}]},
        {"command": "remove", "path": "$..priority"},
    ]
    out = Engine().documents(_documents(spark, sf_dir), steps)
    return out.select("c_custkey", F.round(F.get_json_object("doc", "$.total").cast("double"), 2).alias("total"), F.get_json_object("doc", "$.n").cast("double").alias("n"), F.get_json_object("doc", "$.ref").alias("ref"), F.col("ok"))


def convert_json_xml_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip through XML and YAML; the numbers survive as numbers by inference."""
    steps = [{"command": "convert", "to": "xml"}, {"command": "convert", "to": "yaml"}, {"command": "convert", "to": "json"}]
    out = Engine().documents(_documents(spark, sf_dir), steps)
    orders = F.from_json(F.get_json_object("doc", "$.orders"), "array<struct<key:string,price:string,status:string,priority:string>>")
    seen = out.select("c_custkey", F.get_json_object("doc", "$.info.name").alias("name"), F.get_json_object("doc", "$.info.segment").alias("segment"), orders.alias("o"), "ok")
    texts = F.array_join(F.transform("o", lambda x: F.concat_ws("/", x["key"], x["status"], x["priority"])), ",").alias("orders")
    total = F.round(F.aggregate("o", F.lit(0.0), lambda a, x: a + x["price"].cast("double")), 2).alias("total")
    return seen.select("c_custkey", "name", "segment", texts, total, "ok")


#: One document per customer, {info: {name, segment}, orders: [{key, price, status, priority}]}, orders by key:
#: name -> (script, SQL for the text of $.out, dialect).
DYNAMIC: dict[str, tuple[list | str, str, str]] = {
    "with_scope": ([{"command": "with", "path": "$.info", "commands": [{"command": "put", "path": "$.out", "value": "@.name"}]}], "c_name", "classic"),
    "path_index_union": ([{"command": "put", "path": "$.out", "value": "=join($.orders[0,2].key, '-')"}], "array_to_string(list_filter([o[1].o_orderkey, o[3].o_orderkey], lambda x: x IS NOT NULL), '-')", "classic"),
    "path_slice_negative": ([{"command": "put", "path": "$.out", "value": "=join($.orders[-2:].key, '-')"}], "array_to_string([x.o_orderkey FOR x IN o[-2:]], '-')", "classic"),
    "path_rfc_filter": ([{"command": "put", "path": "$.out", "value": "=count($.orders[?@.price > 100000 && @.status == 'O'])"}], "CAST(len([x FOR x IN o IF x.o_totalprice > 100000 AND x.o_orderstatus = 'O']) AS VARCHAR)", "rfc9535"),
    "path_rfc_match_length": ([{"command": "put", "path": "$.out", "value": "=count($.orders[?match(@.priority, '[12]-.*') && length(@.status) == 1])"}], "CAST(len([x FOR x IN o IF x.o_orderpriority[1] IN ('1', '2')]) AS VARCHAR)", "rfc9535"),
    "path_rfc_search": ([{"command": "put", "path": "$.out", "value": "=count($.orders[?search(@.priority, 'U[A-Z]{2}')])"}], "CAST(len([x FOR x IN o IF regexp_matches(x.o_orderpriority, 'U[A-Z]{2}')]) AS VARCHAR)", "rfc9535"),
    "path_rfc_slice_back": ([{"command": "put", "path": "$.out", "value": "=join($.orders[::-1].key, '-')"}], "array_to_string(list_reverse([x.o_orderkey FOR x IN o]), '-')", "rfc9535"),
    "path_parent": ([{"command": "forEach", "path": "$.orders", "commands": [{"command": "put", "path": "@.owner", "value": "@.<--.<--.info.name"}]}, {"command": "put", "path": "$.out", "value": "=last($.orders[*].owner)"}], "c_name", "classic"),
    "indirect_value": ([{"command": "put", "path": "$.pointer", "value": "$$.info.segment"}, {"command": "put", "path": "$.out", "value": "=indirect($.pointer)"}], "c_mktsegment", "classic"),
    "indirect_path": ([{"command": "put", "path": "$.pointer", "value": "$$.info.segment"}, {"command": "set", "path": "=indirect($.pointer)", "value": "=toLower($.info.segment)"}, {"command": "put", "path": "$.out", "value": "$.info.segment"}], "lower(c_mktsegment)", "classic"),
    "promote_value": ([{"command": "put", "path": "$.p", "value": "=promote($.info.name, 'x')"}, {"command": "put", "path": "$.out", "value": "$.p.x"}], "c_name", "classic"),
    "to_array_value": ([{"command": "put", "path": "$.p", "value": "=toArray($.info.name)"}, {"command": "put", "path": "$.out", "value": "$.p[0]"}], "c_name", "classic"),
    "parse_value": ([{"command": "put", "path": "$.t", "value": "=concat('{\"a\":[1,\"', $.info.segment, '\"]}')"}, {"command": "put", "path": "$.p", "value": "=parse($.t)"}, {"command": "put", "path": "$.out", "value": "$.p.a[1]"}], "c_mktsegment", "classic"),
    "script_path": ([{"command": "put", "path": "$.out", "value": "=scriptpath($.info.name)"}], "'$.info.name'", "classic"),
    "skeleton_value": ([{"command": "put", "path": "$.p", "value": "=skeleton({\"properties\":{\"a\":{\"type\":\"array\"},\"b\":{\"default\":\"d\"}}})"}, {"command": "put", "path": "$.out", "value": "=concat($.p.b, '-', length($.p.a))"}], "'d-0'", "classic"),
    "schema_references": ([{"command": "put", "path": "$.p", "value": "=filterBySchema({\"$defs\":{\"i\":{\"properties\":{\"name\":{}}}},\"properties\":{\"info\":{\"$ref\":\"#/$defs/i\"}}}, $)"}, {"command": "put", "path": "$.out", "value": "=concat($.p.info.name, '|', exists($.p.info.segment), '|', exists($.p.orders))"}], "c_name || '|false|false'", "classic"),
    "schema_all_of": ([{"command": "put", "path": "$.p", "value": "=filterBySchema({\"allOf\":[{\"properties\":{\"info\":{\"properties\":{\"segment\":{}}}}},{\"properties\":{\"x\":{}}}]}, $)"}, {"command": "put", "path": "$.out", "value": "=concat($.p.info.segment, '|', exists($.p.info.name))"}], "c_mktsegment || '|false'", "classic"),
    "convert_value": ([{"command": "put", "path": "$.x", "value": "=concat('<r><a>', $.info.segment, '</a><b>2</b></r>')"}, {"command": "convertValue", "path": "$.x", "to": "json"}, {"command": "put", "path": "$.out", "value": "=concat($.x.a, $.x.b)"}], "c_mktsegment || '2'", "classic"),
    "convert_value_settings": ([{"command": "put", "path": "$.x", "value": {"a": ["$.info.name", "=fetch($.info.segment)"], "n": None}}, {"command": "convertValue", "path": "$.x", "to": "xml", "settings": {"arrayHandling": "repeated", "nullRepresentation": "xsiNil", "rootName": "r"}}, {"command": "put", "path": "$.out", "value": "$.x"}], "'<r><a>' || c_name || '</a><a>' || c_mktsegment || '</a><n xmlns:xsi=\"http://www.w3.org/2001/XMLSchema-instance\" xsi:nil=\"true\"/></r>'", "classic"),
    "convert_settings_text_flag": ([{"command": "put", "path": "$.x", "value": "<r><a>1</a></r>"}, {"command": "put", "path": "$.y", "value": "<r><a>1</a></r>"}, {"command": "convertValue", "path": "$.x", "to": "json", "settings": {"inferTypes": "false"}}, {"command": "convertValue", "path": "$.y", "to": "json", "settings": {"inferTypes": "true"}}, {"command": "put", "path": "$.out", "value": "=concat(isString($.x.a), '|', isString($.y.a))"}], "'true|false'", "classic"),
    "flatten_metadata_roundtrip": ([{"command": "put", "path": "$.before", "value": "=toString($.orders)"}, {"command": "put", "path": "$.kept", "value": {"info": "$.info", "orders": "$.orders"}}, {"command": "flatten", "path": "$.kept", "flattenSettings": {"delimiter": "/"}}, {"command": "restore", "path": "$.kept", "restoreSettings": {"metadataPath": "$"}}, {"command": "put", "path": "$.out", "value": "=concat(equals(toString($.kept.orders), $.before), '|', $.kept.info.name, '|', exists($._flattenMetadata))"}], "'true|' || c_name || '|false'", "classic"),
    "deep_merge": ([{"command": "put", "path": "$.other", "value": {"name": "n", "more": {"a": 1}}}, {"command": "put", "path": "$.info.more", "value": {"b": 2}}, {"command": "merge", "path": "$.info", "targetPath": "$.other"}, {"command": "put", "path": "$.out", "value": "=concat($.other.name, '|', $.other.segment, '|', $.other.more.a + $.other.more.b)"}], "c_name || '|' || c_mktsegment || '|3'", "classic"),
    "for_each_limit": ([{"command": "put", "path": "$.n", "value": 0}, {"command": "forEach", "path": "$.orders", "maxIterations": 2, "commands": [{"command": "set", "path": "$.n", "value": "=$.n + 1"}]}, {"command": "put", "path": "$.out", "value": "=toString($.n)"}], "CAST(least(len(o), 2) AS VARCHAR)", "classic"),
    "null_slots": ([{"command": "put", "path": "$.x", "value": None}, {"command": "put", "path": "$.l", "value": [None, 1, None]}, {"command": "put", "path": "$.out", "value": "=concat(isNull($.x), '|', exists($.x), '|', length($.l))"}], "'true|true|3'", "classic"),
    "new_guid": ([{"command": "put", "path": "$.out", "value": "=toString(length(newGuid()))"}], "'36'", "classic"),
    "now_in_between": ([{"command": "put", "path": "$.out", "value": "=toString(isDateBetween(datetime(), '2020-01-01', '2200-01-01'))"}], "'true'", "classic"),
    "script_in_yaml": ("- command: put\n  path: $.out\n  value: =toUpper($.info.name)\n", "upper(c_name)", "classic"),
    "script_in_xml": ("<script><put><path>$.out</path><value>=toUpper($.info.name)</value></put></script>", "upper(c_name)", "classic"),
    "unknown_command": ([{"command": "frobnicate"}, {"command": "put", "path": "$.out", "value": "on"}], "'on'", "classic"),
    "unknown_function": ([{"command": "put", "path": "$.out", "value": "kept"}, {"command": "set", "path": "$.out", "value": "=frobnicate(1)"}], "'kept'", "classic"),
    "pattern_limit": ([{"command": "put", "path": "$.out", "value": "=toString(matches($.info.name, '^Customer#\\d+$'))"}], "CAST(regexp_full_match(c_name, 'Customer#[0-9]+') AS VARCHAR)", "classic"),
    "calculate_not_finite": ([{"command": "put", "path": "$.out", "value": "=concat(calculate('5/0'), '|', calculate('0/0'))"}], "'Infinity|NaN'", "classic"),
}
_DYNAMIC_SQL = "SELECT c_custkey, {} AS out FROM (SELECT c_custkey, c_name, c_mktsegment, list({{'o_orderkey': o_orderkey, 'o_totalprice': o_totalprice, 'o_orderstatus': o_orderstatus, 'o_orderpriority': o_orderpriority}} ORDER BY o_orderkey) AS o FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL)"


def _dynamic(name: str) -> Callable[[SparkSession, str], DataFrame]:
    steps, _, dialect = DYNAMIC[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = Engine(dialect).documents(_documents(spark, sf_dir), steps)
        return out.select("c_custkey", F.get_json_object("doc", "$.out").alias("out"))

    return run


def trace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the trace says of each command: outcome and number of nodes."""
    steps = [{"command": "set", "path": "$.orders[*].status", "value": "x"}, {"command": "set", "path": "$.nowhere.at", "value": 1}, {"command": "remove", "path": "$.info.name"}]
    out = Engine().documents(_documents(spark, sf_dir), steps).select("c_custkey", F.posexplode("trace").alias("step", "t"))
    return out.select("c_custkey", "step", "t.command", "t.matched")


def registered_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function and a command of the caller's own, beside those there are."""

    def stamp(state, command: dict) -> int:
        state.root.value["stamp"] = command["mark"]
        return 1

    engine = Engine().function("shout", lambda context, value: f"{context.one(value)}!").command("stamp", stamp)
    out = engine.documents(_documents(spark, sf_dir), [{"command": "stamp", "mark": "m"}, {"command": "put", "path": "$.out", "value": "=concat(shout($.info.name), $.stamp)"}])
    return out.select("c_custkey", F.get_json_object("doc", "$.out").alias("out"))


def fluent_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = Script().put("$.out", "=count($.orders)").if_else("=greaterThan($.out, 10)", Script().set("$.out", "many"), Script().set("$.out", "few")).commands
    return Engine().documents(_documents(spark, sf_dir), steps).select("c_custkey", F.get_json_object("doc", "$.out").alias("out"))


def path_xpath(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slash paths name the root and count from one."""
    steps = [{"command": "set", "path": "/doc/info/name", "value": "z"}, {"command": "set", "path": "/doc/orders[1]/status", "value": "first"}, {"command": "remove", "path": "//priority"}]
    out = Engine("xpath").documents(_documents(spark, sf_dir), steps)
    return out.select("c_custkey", F.concat_ws("|", *[F.get_json_object("doc", p) for p in ("$.info.name", "$.orders[0].status", "$.orders[0].key", "$.orders[0].priority")]).alias("out"))


def resolve_many_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of many values on both sides: nations meet regions that share a number of theirs."""
    left = load(spark, sf_dir, "nation").select("n_nationkey", F.array("n_nationkey", "n_regionkey").alias("keys"), F.create_map(F.lit("name"), "n_name").alias("m"))
    right = load(spark, sf_dir, "region").select("r_name", F.array(F.col("r_regionkey"), F.col("r_regionkey") + 7).alias("ids"))
    steps = [*_resolve("$region[*]", [("@.keys[*]", "@.ids[*]")], [{"targetPath": "@.regions", "value": "@.r_name", "resolveTypeBehavior": "AlwaysAsArray"}])]
    rows = Engine().rows(left, steps, tables={"region": right}).rows
    return rows.select("n_nationkey", F.array_join(F.array_sort("regions"), ",").alias("regions"))


def streaming_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document-mode script over a stream of the events table, run to its end."""
    import uuid

    from .runtime import shared_dir
    from .streaming import documents

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    steps = [{"command": "put", "path": "$.twice", "value": "=$.value * 2"}, {"command": "put", "path": "$.kind", "value": "=toUpper($.event_type)"}, {"command": "remove", "path": "$.props"}]
    stream = documents.apply(documents.read_table(spark, sf_dir, "events"), steps)
    documents.run_available(stream.select("event_id", "twice", "kind"), f"{base}/out", f"{base}/progress")
    return spark.read.parquet(f"{base}/out")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _script("flagship")(spark, sf_dir)


def _script(name: str) -> Callable[[SparkSession, str], DataFrame]:
    table, order, tables, commands, columns, _ = SCRIPTS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        others = {k: load(spark, sf_dir, v) for k, v in tables.items()}
        found = Engine().rows(load(spark, sf_dir, table), json.loads(json.dumps(commands)), order, others)
        if isinstance(columns, str):
            return found.outputs[columns]
        return found.rows if columns == ["*"] else found.rows.select(*columns)

    return run


#: name -> (query, SQL or None)
OTHERS: dict[str, tuple[Callable, str | None]] = {
    "merge_full": (_merge("fullMerge"), _merge_sql("full")),
    "merge_only_values": (_merge("onlyValues"), _merge_sql("values")),
    "merge_only_structure": (_merge("onlyStructure"), _merge_sql("structure")),
    "merge_concat": (_lists({"arrayMergeMode": "concat"}), f"{_T} UNION ALL {_S}"),
    "merge_unique_items": (_lists({"settings": {"arraySettings": [{"arrayPath": "$", "uniqueItemsWithoutKeys": True}]}}), f"{_T} UNION ALL ({_S} EXCEPT {_T})"),
    "merge_replace": (_lists({"arrayMergeMode": "replace"}), _S),
    "compare_keyed": (compare_keyed, COMPARE_SQL),
    "compare_scalar": (compare_scalar, "SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_tax - l_discount) <= 1e-10 THEN 'equal' WHEN l_tax > l_discount THEN 'greater' ELSE 'less' END AS verdict FROM lineitem"),
    "structural_diff": (structural_diff, f"SELECT c_custkey, 'c_name -> title' AS path, 'rename' AS kind FROM {_A} a JOIN {_B} b USING (c_custkey) UNION ALL SELECT c_custkey, 'c_nationkey', 'mutate' FROM {_A} a JOIN {_B} b USING (c_custkey) WHERE a.c_nationkey IS DISTINCT FROM b.c_nationkey UNION ALL SELECT c_custkey, unnest(['c_name', 'c_nationkey']), 'remove' FROM {_A} a ANTI JOIN {_B} b USING (c_custkey) UNION ALL SELECT c_custkey, unnest(['title', 'c_nationkey']), 'add' FROM {_B} b ANTI JOIN {_A} a USING (c_custkey)"),
    "decision_first": (_decision("firstMatch"), _decision_sql([0, 1, 2])),
    "decision_best": (_decision("bestMatch"), _decision_sql([0, 2, 1])),
    "decision_all_priority": (_decision("allMatches"), _decision_sql([0, 1, 2])),
    "decision_all_last_wins": (_decision("allMatches", "lastWins"), _decision_sql([2, 1, 0])),
    "decision_all_merge": (_decision("allMatches", "merge"), DECISION_MERGE_SQL),
    "foreach_transform": (foreach_transform, f"SELECT o_custkey AS c_custkey, round(sum({half('o_totalprice * 0.21::DOUBLE', 2)}), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey"),
    "flatten_nested": (flatten_nested, "SELECT c_custkey, c_name AS info_name, c_mktsegment AS info_segment FROM customer SEMI JOIN orders ON o_custkey = c_custkey"),
    "restore_nested": (restore_nested, "SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer SEMI JOIN orders ON o_custkey = c_custkey"),
    "to_csv_rows": (to_csv_rows, "SELECT '\"' || p_brand || '\";\"' || p_name || '\";\"' || p_partkey || '\";\"' || p_size || '\"' AS line FROM part"),
    "exists_semi": (exists_semi, "SELECT c_custkey FROM customer SEMI JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) ON o_custkey = c_custkey"),
    "trace_rows": (trace_rows, "SELECT c_custkey, 0 AS step, 'set' AS command, count(*) AS matched FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey UNION ALL SELECT c_custkey, 1, 'set', 0 FROM customer SEMI JOIN orders ON o_custkey = c_custkey UNION ALL SELECT c_custkey, 2, 'remove', 1 FROM customer SEMI JOIN orders ON o_custkey = c_custkey"),
    "registered_extensions": (registered_extensions, "SELECT c_custkey, c_name || '!m' AS out FROM customer SEMI JOIN orders ON o_custkey = c_custkey"),
    "fluent_script": (fluent_script, "SELECT o_custkey AS c_custkey, CASE WHEN count(*) > 10 THEN 'many' ELSE 'few' END AS out FROM orders SEMI JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey"),
    "path_xpath": (path_xpath, "SELECT o_custkey AS c_custkey, 'z|first|' || min(o_orderkey) AS out FROM orders SEMI JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey"),
    "resolve_many_keys": (resolve_many_keys, "SELECT n_nationkey, coalesce(string_agg(r_name, ',' ORDER BY r_name), '') AS regions FROM nation LEFT JOIN region ON list_has_any([n_nationkey, n_regionkey], [r_regionkey, r_regionkey + 7]) GROUP BY n_nationkey"),
    "streaming_script": (streaming_script, "SELECT event_id, value * 2 AS twice, upper(event_type) AS kind FROM events"),
    "dynamic_mapping": (dynamic_mapping, "SELECT c_custkey, round(sum(o_totalprice), 2) AS total, 3.0::DOUBLE AS n, any_value(c_name) AS ref, true AS ok FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"),
    "convert_json_xml_yaml": (convert_json_xml_yaml, "SELECT c_custkey, c_name AS name, c_mktsegment AS segment, string_agg(o_orderkey || '/' || o_orderstatus || '/' || o_orderpriority, ',' ORDER BY o_orderkey) AS orders, round(sum(o_totalprice), 2) AS total, true AS ok FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name, c_mktsegment"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable] = {name: _script(name) for name in SCRIPTS}
    out |= {f"fn_{n}": _function(t, keys, v) for n, (t, keys, v, _) in FUNCTIONS.items()}
    out |= {n: _nested(v) for n, (v, _) in NESTED.items()}
    out |= {n: _dynamic(n) for n in DYNAMIC}
    return out | {n: q for n, (q, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: s[5] for name, s in SCRIPTS.items()}
    out |= {f"fn_{n}": f"SELECT {', '.join(keys)}, {sql} AS out FROM {t}" for n, (t, keys, _, sql) in FUNCTIONS.items()}
    out |= {n: NESTED_SQL.replace("{}", sql) for n, (_, sql) in NESTED.items()}
    out |= {n: _DYNAMIC_SQL.format(sql) for n, (_, sql, _) in DYNAMIC.items()}
    return out | {n: sql for n, (_, sql) in OTHERS.items() if sql}
