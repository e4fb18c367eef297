"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The q_ queries run on the driver's tables. The csv_, json_ and sqlite_ queries repeat
the published single-node cases on tables of the same form and size (1,000,000 rows
of id, name, age, score, date, those that end in _10m ten times as many, join3 three
files of 10,000 rows). "queries" holds the best of two runs after a first one;
"cold" holds that first run, with all that is found out about a file only once
(whether a field holds a line break, a JSON file's schema).
"""

from __future__ import annotations

import json
import os
import shutil
import sqlite3
import sys
import tempfile
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ROWS = int(os.environ.get("BENCH_ROWS", "1000000"))

ON_TABLES = {
    "q_group_sum": "from lineitem.parquet where l_quantity > 10 group by l_returnflag select l_returnflag, count(1), sum(l_quantity)",
    "q_group_min_max": "from lineitem.parquet group by l_suppkey select l_suppkey, min(l_extendedprice), max(l_extendedprice)",
    "q_filter": "from lineitem.parquet where l_quantity > 45 and l_discount >= 0.05 select count(*)",
    "q_like": 'from part.parquet where p_type like "S%" select count(*)',
    "q_topk": "from lineitem.parquet select l_orderkey, l_linenumber, l_extendedprice order by l_extendedprice desc limit 10",
    "q_having": "from orders.parquet group by o_custkey having sum(o_totalprice) > 1000000 select o_custkey, count",
    "q_join3": "from orders.parquet join customer.parquet on o_custkey == c_custkey join nation.parquet on c_nationkey == n_nationkey group by n_name select n_name, count(*), sum(o_totalprice)",
    "q_join_big": "from lineitem.parquet join orders.parquet on l_orderkey == o_orderkey group by o_orderpriority select o_orderpriority, sum(l_extendedprice)",
    "q_subquery": "from (from lineitem.parquet where l_quantity > 40 select l_suppkey, l_extendedprice) group by l_suppkey select l_suppkey, sum(l_extendedprice)",
    "q_cte_union": "with a as (from customer.parquet select c_nationkey as k), b as (from supplier.parquet select s_nationkey as k) from (from a select k union from b select k) select count(*)",
}
ON_FILES = {
    "csv_count": "from t.csv select count(id)",
    "csv_filter_number": "from t.csv where age > 50 select count(*)",
    "csv_filter_text": 'from t.csv where name == "User50000" select count(*)',
    "csv_like": 'from t.csv where name like "User1%0" select count(*)',
    "csv_group_sum": "from t.csv group by age select age, sum(score)",
    "csv_group_min_max": "from t.csv group by age select age, min(score), max(score)",
    "csv_order_number": "from t.csv select id, score order by score desc limit 10",
    "csv_order_text": "from t.csv select id, name order by name limit 10",
    "csv_functions": "from t.csv select upper(name), lower(name), length(name), year(date), abs(score) limit 1000",
    "csv_subquery": "from (from t.csv where age > 80 select id, age) select count(*)",
    "csv_having": "from t.csv group by age having sum(score) > 50000 select age, sum(score)",
    "csv_math": "from t.csv select abs(score), round(score) limit 1000",
    "csv_dates": "from t.csv select year(date), month(date), day(date) limit 1000",
    "csv_cte": "with a as (from t.csv where age > 80 select id) from a select count(*)",
    "csv_join3": "from j1.csv join j2.csv on id == id2 join j3.csv on id == id3 select count(*)",
    "csv_filter_10m": "from big.csv where age > 50 select count(*)",
    "csv_group_10m": "from big.csv group by age select age, sum(score)",
    "sqlite_count": "from t.sqlite select count(id)",
    "json_count": "from t.json select count(id)",
    "json_filter": "from t.json where age > 50 select count(*)",
}


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from ferrule.session import Engine
    from ferrule.sources.text import forget

    conf = {"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}
    spark = SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="bench-")
    try:
        from ferrule.operators.sinks import export

        def table(n: int):
            return spark.range(n).select("id", F.format_string("User%d", "id").alias("name"), (F.col("id") % 100).alias("age"), (F.col("id") % 1000).alias("score"), F.lit("2023-05-15").alias("date"))

        rows = table(ROWS)
        export(rows, f"{folder}/t.csv")
        export(table(10 * ROWS), f"{folder}/big.csv")
        for i in (1, 2, 3):
            export(table(10_000).select(F.col("id").alias("id" if i == 1 else f"id{i}"), F.col("name").alias(f"name{i}")), f"{folder}/j{i}.csv")
        rows.select([F.col(c).cast("string") for c in rows.columns]).coalesce(1).write.json(f"{folder}/t.json")
        db = sqlite3.connect(f"{folder}/t.sqlite")
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, age INTEGER, score INTEGER, date TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", ((i, f"User{i}", i % 100, i % 1000, "2023-05-15") for i in range(ROWS)))
        db.commit()
        db.close()
        times: dict[str, float] = {}
        cold: dict[str, float] = {}
        for base, some in ((SF_DIR, ON_TABLES), (folder, ON_FILES)):
            for name, text in some.items():
                taken = []
                for run in range(3):
                    if run == 0:
                        forget()
                    began = time.time()
                    Engine(spark, base=base).sql(text).collect()
                    taken.append(time.time() - began)
                times[name], cold[name] = round(min(taken[1:]), 4), round(taken[0], 4)
        print(json.dumps({"metric": "total of the best times of all queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "cold": cold, "sf": SF_DIR.rpartition("sf")[2]}))
    finally:
        spark.stop()
        shutil.rmtree(folder, ignore_errors=True)


if __name__ == "__main__":
    main()
