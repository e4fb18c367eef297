"""The catalogue: queries in the engine's language on the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.limits import Limits
from ferrule.operators.sinks import export
from ferrule.operators.tables import file_system, shared_folder
from ferrule.session import Engine

#: name: (query, SQL).
CATALOGUE: dict[str, tuple[str, str]] = {
    # Scans and projections
    "scan_parquet": ("from region.parquet select r_regionkey, r_name", "SELECT r_regionkey, r_name FROM region"),
    "select_star": ("from nation.parquet select *", "SELECT * FROM nation"),
    "project_columns": ("from nation.parquet select n_name, n_regionkey", "SELECT n_name, n_regionkey FROM nation"),
    "project_alias": ("from nation.parquet select n_name as nation, n_nationkey as key", "SELECT n_name AS nation, n_nationkey AS key FROM nation"),
    "project_literal": ('from region.parquet select r_name, "x" as tag, 7 as seven', "SELECT r_name, 'x' AS tag, 7 AS seven FROM region"),
    "project_duplicate": ("from region.parquet select r_name, r_name", "SELECT r_name, r_name AS r_name_2 FROM region"),
    "project_duplicate_alias": ("from region.parquet select r_regionkey, r_regionkey, r_name as r_regionkey_2", "SELECT r_regionkey, r_regionkey AS r_regionkey_3, r_name AS r_regionkey_2 FROM region"),
    "project_condition": ("from region.parquet select r_name, r_regionkey > 2 as late", "SELECT r_name, r_regionkey > 2 AS late FROM region"),
    "project_distinct": ("from nation.parquet select distinct n_regionkey", "SELECT DISTINCT n_regionkey FROM nation"),
    "clauses_any_order": ("select n_name where n_regionkey == 1 from nation.parquet", "SELECT n_name FROM nation WHERE n_regionkey = 1"),
    # Filters
    "filter_numeric": ("from lineitem.parquet where l_quantity > 45 select l_orderkey, l_linenumber, l_quantity", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45"),
    "filter_string_eq": ('from orders.parquet where o_orderstatus == "F" select o_orderkey, o_orderstatus', "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'"),
    "filter_not_equal": ('from orders.parquet where o_orderpriority != "1-URGENT" select o_orderkey, o_orderpriority', "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority <> '1-URGENT'"),
    "filter_and_or": (
        'from lineitem.parquet where (l_returnflag == "A" or l_returnflag == "R") and l_discount >= 0.05 and l_quantity <= 10 select l_orderkey, l_linenumber',
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag = 'A' OR l_returnflag = 'R') AND l_discount >= 0.05 AND l_quantity <= 10",
    ),
    "filter_numeric_text": ('from orders.parquet where o_custkey == "7" select o_orderkey', "SELECT o_orderkey FROM orders WHERE o_custkey = 7"),
    "filter_date": ('from orders.parquet where o_orderdate >= "1997-01-01" select o_orderkey', "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'"),
    "filter_function": ("from customer.parquet where length(c_mktsegment) > 8 select c_custkey, c_mktsegment", "SELECT c_custkey, c_mktsegment FROM customer WHERE length(c_mktsegment) > 8"),
    "filter_in_between": (
        "from part.parquet where p_size in (1, 5, 9) and p_partkey not between 10 and 50 select p_partkey, p_size",
        "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9) AND p_partkey NOT BETWEEN 10 AND 50",
    ),
    "filter_not": ("from nation.parquet where not n_regionkey == 1 and n_name is not null select n_name", "SELECT n_name FROM nation WHERE NOT n_regionkey = 1 AND n_name IS NOT NULL"),
    "filter_arithmetic": ("from lineitem.parquet where l_extendedprice * (1 - l_discount) > 50000 select l_orderkey, l_linenumber", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000"),
    "like_prefix": ('from part.parquet where p_type like "S%" select p_partkey, p_type', "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'S%'"),
    "like_suffix": ('from customer.parquet where c_name like "%7" select c_custkey, c_name', "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%7'"),
    "like_infix": ('from part.parquet where p_type like "%A%" select p_partkey, p_type', "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%'"),
    "like_single_char": ('from customer.parquet where c_mktsegment like "B______G" select c_custkey, c_mktsegment', "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment LIKE 'B______G'"),
    # Aggregation
    "count_all": ("from lineitem.parquet select count", "SELECT count(*) AS count FROM lineitem"),
    "count_star": ("from orders.parquet select count(*) as n", "SELECT count(*) AS n FROM orders"),
    "global_agg": (
        "from orders.parquet select count() as n, round(sum(o_totalprice)) as total, min(o_totalprice) as low, max(o_totalprice) as high, round(avg(o_totalprice)) as mean",
        "SELECT count(*) AS n, round(sum(o_totalprice)) AS total, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_totalprice)) AS mean FROM orders",
    ),
    "global_agg_empty": ("from orders.parquet where o_orderkey < 0 select count(*) as n, sum(o_custkey) as total", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders WHERE o_orderkey < 0"),
    "group_sum": (
        "from lineitem.parquet where l_quantity > 10 group by l_returnflag select l_returnflag, count(1) as n, sum(l_quantity) as quantity",
        "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag",
    ),
    "group_avg": ("from lineitem.parquet group by l_shipdate select l_shipdate, round(avg(l_quantity) * 100) as mean", "SELECT l_shipdate, round(avg(l_quantity) * 100) AS mean FROM lineitem GROUP BY l_shipdate"),
    "group_min_max": ("from part.parquet group by p_brand select p_brand, min(p_retailprice) as low, max(p_retailprice) as high, min(p_name) as first", "SELECT p_brand, min(p_retailprice) AS low, max(p_retailprice) AS high, min(p_name) AS first FROM part GROUP BY p_brand"),
    "group_negative_max": ("from customer.parquet where c_acctbal < 0 group by c_mktsegment select c_mktsegment, max(c_acctbal) as high", "SELECT c_mktsegment, max(c_acctbal) AS high FROM customer WHERE c_acctbal < 0 GROUP BY c_mktsegment"),
    "group_filtered": ('from events.parquet where event_type != "view" group by event_type select event_type, count as n', "SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY event_type"),
    "group_multi_key": (
        "from lineitem.parquet group by l_returnflag, l_linestatus select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as quantity",
        "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_returnflag, l_linestatus",
    ),
    "group_first_value": ("from nation.parquet group by n_regionkey select n_regionkey, n_name, count(*) as n", "SELECT n_regionkey, arg_min(n_name, n_nationkey) AS n_name, count(*) AS n FROM nation GROUP BY n_regionkey"),
    "group_star_first_row": ("from nation.parquet group by n_regionkey select *", "SELECT * FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) = 1"),
    "group_by_expression": ("from orders.parquet group by year(o_orderdate) select year(o_orderdate) as y, count(*) as n", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY 1"),
    "agg_of_scalar": ("from customer.parquet select round(sum(abs(c_acctbal))) as total, max(length(c_name)) as longest", "SELECT round(sum(abs(c_acctbal))) AS total, CAST(max(length(c_name)) AS INTEGER) AS longest FROM customer"),
    "scalar_of_agg": (
        "from part.parquet group by p_brand select lower(p_brand) as brand, concat(p_brand, count(*)) as tag, round(max(p_retailprice)) as high",
        "SELECT lower(p_brand) AS brand, p_brand || count(*) AS tag, round(max(p_retailprice)) AS high FROM part GROUP BY p_brand",
    ),
    "agg_equals_literal": ("from nation.parquet group by n_regionkey select n_regionkey, count(*) == 5 as five", "SELECT n_regionkey, CAST(count(*) = 5 AS INTEGER) AS five FROM nation GROUP BY n_regionkey"),
    "agg_arithmetic": ("from lineitem.parquet group by l_returnflag select l_returnflag, sum(l_quantity) / count(*) > 25 as big", "SELECT l_returnflag, CAST(sum(l_quantity) / count(*) > 25 AS INTEGER) AS big FROM lineitem GROUP BY l_returnflag"),
    "agg_distinct": ("from lineitem.parquet select count(distinct l_suppkey) as suppliers", "SELECT count(DISTINCT l_suppkey) AS suppliers FROM lineitem"),
    "having_sum": ("from orders.parquet group by o_custkey having sum(o_totalprice) > 1000000 select o_custkey, count as n", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 1000000"),
    "having_count": ("from orders.parquet group by o_custkey having count(*) >= 15 select o_custkey, count(*) as n", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15"),
    "having_unselected_agg": ("from lineitem.parquet group by l_suppkey having avg(l_quantity) > 25.5 and max(l_discount) > 0 select l_suppkey", "SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING avg(l_quantity) > 25.5 AND max(l_discount) > 0"),
    # Order and limit
    "order_numeric_topk": ("from orders.parquet select o_orderkey, o_totalprice order by o_totalprice desc, o_orderkey limit 10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "order_string_topk": ("from customer.parquet select c_custkey, c_name order by c_name limit 10", "SELECT c_custkey, c_name FROM customer ORDER BY c_name LIMIT 10"),
    "order_by_unselected": ("from orders.parquet order by o_orderkey desc select o_custkey limit 5", "SELECT o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 5"),
    "order_by_aggregate": ("from orders.parquet group by o_custkey select o_custkey, count(*) as n order by count(*) desc, o_custkey limit 7", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 7"),
    "order_by_hidden_aggregate": ("from orders.parquet group by o_custkey select o_custkey order by max(o_totalprice) desc limit 5", "SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY max(o_totalprice) DESC LIMIT 5"),
    "order_all": ("from customer.parquet select c_name order by c_name", "SELECT c_name FROM customer ORDER BY c_name"),
    "order_offset": ("from orders.parquet select o_orderkey order by o_orderkey offset 20 limit 10", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20"),
    "order_nulls_last": (
        "from customer.parquet left join (from orders.parquet where o_totalprice > 400000 select o_custkey, o_orderkey) on c_custkey == o_custkey select c_custkey, o_orderkey order by o_orderkey nulls last, c_custkey limit 15",
        "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey ORDER BY o_orderkey NULLS LAST, c_custkey LIMIT 15",
    ),
    # Joins
    "join_equi": ("from nation.parquet join region.parquet on n_regionkey == r_regionkey select n_name, r_name", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "join_multi": (
        'from customer.parquet join nation.parquet on c_nationkey == n_nationkey join region.parquet on n_regionkey == r_regionkey where r_name == "ASIA" select c_custkey, n_name, r_name',
        "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
    ),
    "join_theta": ("from region.parquet join nation.parquet on r_regionkey > n_regionkey select r_name, n_name", "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey > n_regionkey"),
    "join_composite": (
        "from lineitem.parquet join orders.parquet on l_orderkey == o_orderkey and l_extendedprice > 90000 select l_orderkey, l_linenumber, o_custkey",
        "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_extendedprice > 90000",
    ),
    "join_same_name": ("from nation.parquet join (from nation.parquet where n_regionkey < 2 select n_nationkey, n_name) on n_nationkey == n_nationkey select *", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey < 2"),
    "join_group": (
        "from orders.parquet join customer.parquet on o_custkey == c_custkey group by c_mktsegment select c_mktsegment, count(*) as n, round(sum(o_totalprice)) as total",
        "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice)) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    ),
    "join_order_limit": (
        "from orders.parquet join customer.parquet on o_custkey == c_custkey select o_orderkey, c_name, o_totalprice order by o_totalprice desc, o_orderkey limit 10",
        "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    ),
    "join_cte": (
        "with big as (from orders.parquet where o_totalprice > 300000 select o_custkey, o_totalprice) from customer.parquet join big on c_custkey == o_custkey select c_name, o_totalprice",
        "SELECT c_name, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 300000",
    ),
    "join_left": ("from customer.parquet left join (from orders.parquet where o_totalprice > 400000 select o_custkey, o_orderkey) on c_custkey == o_custkey select c_custkey, o_orderkey", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey"),
    "join_semi": ("from customer.parquet semi join (from orders.parquet where o_totalprice > 400000 select o_custkey) on c_custkey == o_custkey select c_custkey", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)"),
    "join_anti": (
        "from customer.parquet anti join (from orders.parquet where o_totalprice > 400000 select o_custkey) on c_custkey == o_custkey select c_custkey",
        "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 400000)",
    ),
    "join_full": (
        "from nation.parquet full join (from region.parquet where r_regionkey > 2 select r_regionkey, r_name) on n_regionkey == r_regionkey select n_name, r_name",
        "SELECT n_name, r_name FROM nation FULL JOIN (SELECT * FROM region WHERE r_regionkey > 2) ON n_regionkey = r_regionkey",
    ),
    "join_right": (
        "from (from nation.parquet where n_nationkey < 3 select n_name, n_regionkey) right join region.parquet on n_regionkey == r_regionkey select n_name, r_name",
        "SELECT n_name, r_name FROM (SELECT * FROM nation WHERE n_nationkey < 3) RIGHT JOIN region ON n_regionkey = r_regionkey",
    ),
    "join_cross": ("from region.parquet cross join (from nation.parquet where n_nationkey < 4 select n_name) select r_name, n_name", "SELECT r_name, n_name FROM region CROSS JOIN (SELECT n_name FROM nation WHERE n_nationkey < 4)"),
    # Subqueries, CTEs, unions, recursion
    "subquery_from": ("from (from customer.parquet where c_acctbal > 9000 select c_custkey, c_acctbal) select count(*) as n", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 9000"),
    "subquery_nested": (
        "from (from (from orders.parquet where o_totalprice > 200000 select o_custkey, o_totalprice) group by o_custkey select o_custkey, count(*) as n) where n > 2 select o_custkey, n",
        "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey HAVING count(*) > 2",
    ),
    "subquery_join": ("from (from nation.parquet where n_regionkey > 2 select n_name, n_regionkey) join region.parquet on n_regionkey == r_regionkey select n_name, r_name", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey > 2"),
    "subquery_derived_name": ('from (from region.parquet select upper(r_name), r_regionkey) where upper(r_name) like "A%" select r_regionkey', "SELECT r_regionkey FROM region WHERE upper(r_name) LIKE 'A%'"),
    "subquery_limit": ("from (from orders.parquet order by o_orderkey select o_orderkey, o_custkey limit 20) where o_custkey > 100 select o_orderkey", "SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 20) WHERE o_custkey > 100"),
    "cte_single": ("with rich as (from customer.parquet where c_acctbal > 9500 select c_custkey, c_nationkey) from rich select c_custkey", "SELECT c_custkey FROM customer WHERE c_acctbal > 9500"),
    "cte_multi": (
        "with a as (from orders.parquet where o_totalprice > 100000 select o_custkey), b as (from a group by o_custkey select o_custkey, count(*) as n) from b where n > 5 select o_custkey, n",
        "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey HAVING count(*) > 5",
    ),
    "union_all": ("from customer.parquet select c_nationkey union all from supplier.parquet select s_nationkey", "SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "union_distinct": ("from customer.parquet select c_nationkey union from supplier.parquet select s_nationkey", "SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier"),
    "intersect": ("from customer.parquet select c_nationkey intersect from supplier.parquet where s_suppkey < 9 select s_nationkey", "SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_suppkey < 9"),
    "except": ("from customer.parquet select c_nationkey except from supplier.parquet where s_suppkey < 9 select s_nationkey", "SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 9"),
    "except_all": ("from customer.parquet select c_nationkey except all from supplier.parquet select s_nationkey", "SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier"),
    "in_query": (
        "from customer.parquet where c_acctbal > 0 and c_custkey in (from orders.parquet where o_totalprice > 300000 select o_custkey) select c_custkey",
        "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    ),
    "not_in_query": ("from customer.parquet where c_custkey not in (from orders.parquet where o_totalprice > 400000 select o_custkey) select c_custkey", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)"),
    "recursive_counter": (
        "with recursive c as (from region.parquet where r_regionkey == 0 select r_regionkey as id union all from c where id < 10 select id + 1 as id) from c select id",
        "SELECT CAST(i AS INTEGER) AS id FROM range(0, 11) t(i)",
    ),
    "recursive_hierarchy": (
        "with recursive t as (from nation.parquet where n_nationkey == 0 select n_nationkey as node, n_name as name union all from t join (from nation.parquet select n_nationkey, n_name, n_nationkey / 2 - 0.5 as half, n_nationkey / 2 - 1 as whole) on node == half or node == whole where n_nationkey > 0 select n_nationkey as node, n_name as name) from t select node, name",
        "WITH RECURSIVE t AS (SELECT n_nationkey AS node, n_name AS name FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n_nationkey, n_name FROM t JOIN nation ON n_nationkey > 0 AND (2 * node + 1 = n_nationkey OR 2 * node + 2 = n_nationkey)) SELECT node, name FROM t",
    ),
    "recursive_union": (
        "with recursive r as (from region.parquet where r_regionkey == 1 select r_regionkey as k union from r join region.parquet on r_regionkey != k select r_regionkey as k) from r select k",
        "WITH RECURSIVE r AS (SELECT r_regionkey AS k FROM region WHERE r_regionkey = 1 UNION SELECT r_regionkey FROM r JOIN region ON r_regionkey <> k) SELECT k FROM r",
    ),
    # Scalar functions
    "fn_upper_lower": ("from region.parquet select upper(r_name) as u, lower(r_name) as l", "SELECT upper(r_name) AS u, lower(r_name) AS l FROM region"),
    "fn_concat": ('from nation.parquet select concat(n_name, " - ", n_regionkey) as tag', "SELECT n_name || ' - ' || n_regionkey AS tag FROM nation"),
    "fn_length": ("from part.parquet select p_partkey, length(p_name) as n, octet_length(p_type) as b", "SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS n, CAST(strlen(p_type) AS INTEGER) AS b FROM part"),
    "fn_abs": ("from customer.parquet select c_custkey, abs(c_acctbal) as size", "SELECT c_custkey, abs(c_acctbal) AS size FROM customer"),
    "fn_round": ("from customer.parquet select c_custkey, round(c_acctbal) as r", "SELECT c_custkey, round(c_acctbal) AS r FROM customer"),
    "fn_year_month_day": (
        "from orders.parquet select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as d",
        "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d FROM orders",
    ),
    "fn_nested": ('from nation.parquet select lower(concat(upper(n_name), "!")) as shout', "SELECT lower(upper(n_name) || '!') AS shout FROM nation"),
    "fn_now": ("from region.parquet select r_name, length(now()) as n", "SELECT r_name, 20 AS n FROM region"),
    "arithmetic": ("from nation.parquet select n_name, n_nationkey * 2 + 1 - n_regionkey as a, n_nationkey % 4 as b, -n_regionkey as c", "SELECT n_name, CAST(n_nationkey * 2 + 1 - n_regionkey AS INTEGER) AS a, n_nationkey % 4 AS b, -n_regionkey AS c FROM nation"),
}

#: name: (file written through the engine, query over it, SQL). All values of text sources are texts.
ROUND_TRIPS: dict[str, tuple[str, str, str, str]] = {
    "csv_roundtrip": ("from nation.parquet select * into nation.csv", "nation.csv", "from nation.csv where n_nationkey > 3 select n_nationkey, n_name", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation WHERE n_nationkey > 3"),
    "csv_group": ("from orders.parquet select * into orders.csv", "orders.csv", "from orders.csv group by o_orderstatus select o_orderstatus, count(*) as n, max(o_custkey) as high", "SELECT o_orderstatus, count(*) AS n, CAST(max(o_custkey) AS DOUBLE) AS high FROM orders GROUP BY o_orderstatus"),
    "csv_order_numbers": ("from nation.parquet select * into nation.csv", "nation.csv", "from nation.csv select n_nationkey order by n_nationkey desc limit 12", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey FROM nation ORDER BY nation.n_nationkey DESC LIMIT 12"),
    "csv_join": ("from nation.parquet select * into nation.csv", "nation.csv", "from nation.csv join region.parquet on n_regionkey == r_regionkey select n_name, r_name", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "tsv_group": ("from nation.parquet select * into nation.tsv", "nation.tsv", "from nation.tsv group by n_regionkey select n_regionkey, count(*) as n", "SELECT CAST(n_regionkey AS VARCHAR) AS n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey"),
    "json_filter": ("from customer.parquet select c_custkey, c_name, c_acctbal into customer.json", "customer.json", "from customer.json where c_acctbal < 0 select c_custkey, c_name", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer WHERE c_acctbal < 0"),
    "into_parquet": ("from part.parquet where p_size > 40 select p_partkey, p_size into part_large.parquet", "part_large.parquet", "from part_large.parquet select p_partkey, p_size", "SELECT p_partkey, p_size FROM part WHERE p_size > 40"),
}

#: Files that the engine reads but does not write, of some columns of customer: name: (file, query, SQL).
FOREIGN: dict[str, tuple[str, str, str]] = {
    "xml_scan": ("customer.xml", "from customer.xml where c_nationkey == 2 select c_name", "SELECT c_name FROM customer WHERE c_nationkey = 2"),
    "yaml_scan": ("customer.yaml", "from customer.yaml where c_nationkey <= 7 select c_custkey, c_name", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer WHERE c_nationkey <= 7"),
    "yaml_crlf": ("customer_crlf.yaml", "from customer_crlf.yaml where c_mktsegment == 'BUILDING' select c_custkey, c_mktsegment", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "sqlite_scan": ("customer.sqlite", "from 'customer.sqlite:customer' group by c_nationkey select c_nationkey, count(*) as n", "SELECT CAST(c_nationkey AS VARCHAR) AS c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey"),
    "sqlite_filter": ("customer.sqlite", "from customer.sqlite where c_custkey > 100 select c_name", "SELECT c_name FROM customer WHERE c_custkey > 100"),
}

#: Texts of which some are numbers, and what a query makes of them: name: (text of the file, query, SQL).
TEXTS: dict[str, tuple[str, str, str]] = {
    "csv_number_texts": (
        "k\n12d\n12\n12f\n0x1p2\n 7\n1e1\n7 \n-inf\n1_0\n",
        "from texts.csv where k != '-inf' select count(*) as n, sum(k) as total, max(k) as high",
        "SELECT CAST(8 AS BIGINT) AS n, CAST(33 AS DOUBLE) AS total, CAST(12 AS DOUBLE) AS high",
    ),
    "csv_number_equal": ("k\n12d\n12\n12f\n12.0\n0xC\nx\n", "from texts.csv where k == 12 select k", "SELECT unnest(['12', '12.0', '0xC']) AS k"),
    "csv_line_breaks": ('k,v\n1,"a\nb"\n2,"c ""d"", e"\n3,f\n', "from texts.csv where k > 1 select k, v", "SELECT unnest(['2', '3']) AS k, unnest(['c \"d\", e', 'f']) AS v"),
}


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/exports-{name}-{abs(hash((spark.sparkContext.applicationId, name))):x}"


def on_table(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine(spark, base=sf_dir).sql(text)


def round_trip(name: str) -> Callable[[SparkSession, str], DataFrame]:
    write, file, read, _ = ROUND_TRIPS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine, target = Engine(spark, base=sf_dir), folder(spark, name)
        export(engine.sql(write.rpartition(" into ")[0]), f"{target}/{file}")
        back = Engine(spark, base=sf_dir)
        back.register(file, Engine(spark, base=target).open(file))
        return back.sql(read)

    return run


def foreign(name: str) -> Callable[[SparkSession, str], DataFrame]:
    file, read, _ = FOREIGN[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        target = folder(spark, name)
        rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").orderBy("c_custkey").collect()  # written by hand below
        write_foreign(spark, f"{target}/{file}", rows)
        return Engine(spark, base=target).sql(read)

    return run


def of_text(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text, read, _ = TEXTS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        target = folder(spark, name)
        write_text(spark, f"{target}/texts.csv", text)
        return Engine(spark, base=target).sql(read)

    return run


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, where = file_system(spark, path)
    out = fs.create(where, True)
    out.write(text.encode())
    out.close()


def write_foreign(spark: SparkSession, path: str, rows: list) -> None:
    """A small XML, YAML or SQLite file of rows; SQLite needs a path that is mounted everywhere."""
    import os
    import sqlite3
    from xml.sax.saxutils import escape

    fs, where = file_system(spark, path)
    fs.mkdirs(where.getParent())
    names = rows[0].__fields__
    if path.endswith(".sqlite"):
        plain = path.removeprefix("file://")
        if os.path.exists(plain):
            os.remove(plain)
        db = sqlite3.connect(plain)
        db.execute(f"CREATE TABLE customer ({', '.join(names)})")
        db.executemany(f"INSERT INTO customer VALUES ({', '.join('?' * len(names))})", [tuple(r) for r in rows])
        db.commit()
        db.close()
    elif path.endswith(".xml"):
        write_text(spark, path, "<?xml version='1.0'?>\n<rows>\n" + "".join("<row>" + "".join(f"<{n}>{escape(str(r[n]))}</{n}>" for n in names) + "</row>\n" for r in rows) + "</rows>\n")
    else:
        text = "# customers\n" + "".join("- " + "\n  ".join(f"{n}: {r[n]}" for n in names) + "\n" for r in rows)
        write_text(spark, path, text.replace("\n", "\r\n") if "crlf" in path else text)


def into_own_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query may write the file that it reads, in every form."""
    target, left = folder(spark, "own"), []
    for suffix in ("parquet", "csv", "tsv", "json"):
        name = f"nation.{suffix}"
        export(Engine(spark, base=sf_dir).sql("from nation.parquet select *"), f"{target}/{name}")
        engine = Engine(spark, base=target)
        for _ in engine.run(f"from {name} where n_regionkey < 3 select n_name, n_regionkey into {name}"):
            pass
        left.append(Engine(spark, base=target).sql(f"from {name} select n_name, '{suffix}' as form"))
    return left[0].union(left[1]).union(left[2]).union(left[3])


def within_row_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits on rows leave results within them alone."""
    engine = Engine(spark, limits=Limits(rows=100), base=sf_dir)
    df = engine.sql("from nation.parquet select n_name")
    engine.check_rows(df)
    return df.agg(F.count(F.lit(1)).alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = (
    {n: on_table(q) for n, (q, _) in CATALOGUE.items()} | {n: round_trip(n) for n in ROUND_TRIPS} | {n: foreign(n) for n in FOREIGN} | {n: of_text(n) for n in TEXTS} | {"limit_rows_within": within_row_limit, "into_own_source": into_own_source}
)
ORACLE_SQL: dict[str, str] = {n: s for n, (_, s) in CATALOGUE.items()} | {n: t[3] for n, t in ROUND_TRIPS.items()} | {n: t[2] for n, t in FOREIGN.items()} | {n: t[2] for n, t in TEXTS.items()}
ORACLE_SQL |= {"limit_rows_within": "SELECT count(*) AS n FROM nation", "into_own_source": "SELECT n_name, form FROM nation, (VALUES ('parquet'), ('csv'), ('tsv'), ('json')) f(form) WHERE n_regionkey < 3"}
