"""The learner table derived from the given tables: all-text source columns plus ``student_id``.

No learner table is given, so one is derived from every order, its customer and its lines, with
planted dirt (copies, missing and unreadable cells, out-of-range numbers). It is invented data
for checking operators. Spark and the SQL check share the column expressions below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.workspace import new_path

# One expression per column, valid in Spark SQL and DuckDB.
COLUMNS = {
    "student_id": "k",
    "School": "CASE WHEN nk % 3 = 0 THEN 'MS' ELSE 'GP' END",
    "Gender": "CASE WHEN c % 2 = 0 THEN 'F' ELSE 'M' END",
    "Age": "CAST(15 + c % 9 AS STRING)",
    "Address": "CASE WHEN nk % 4 = 0 THEN 'R' ELSE 'U' END",
    "Family_Size": "CASE WHEN a % 3 = 0 THEN 'LE3' ELSE 'GT3' END",
    "Parental_Status": "CASE WHEN a % 7 = 0 THEN 'A' ELSE 'T' END",
    "Mother_Education": "CAST(a % 5 AS STRING)",
    "Father_Education": "CAST((a + c) % 5 AS STRING)",
    "Mother_Job": (
        "CASE WHEN k % 47 = 0 THEN NULL WHEN seg = 'BUILDING' THEN 'teacher' "
        "WHEN seg = 'MACHINERY' THEN 'services' WHEN seg = 'FURNITURE' THEN 'health' "
        "WHEN seg = 'HOUSEHOLD' THEN 'at_home' ELSE 'other' END"
    ),
    "Father_Job": (
        "CASE WHEN p % 5 = 0 THEN 'teacher' WHEN p % 5 = 1 THEN 'services' "
        "WHEN p % 5 = 2 THEN 'health' WHEN p % 5 = 3 THEN 'at_home' ELSE 'other' END"
    ),
    "Reason_for_Choosing_School": (
        "CASE WHEN pr = '1-URGENT' THEN 'course' WHEN pr = '2-HIGH' THEN 'home' "
        "WHEN pr = '3-MEDIUM' THEN 'reputation' ELSE 'other' END"
    ),
    "Guardian": "CASE WHEN st = 'F' THEN 'father' WHEN st = 'O' THEN 'mother' ELSE 'other' END",
    "Travel_Time": "CAST(1 + nk % 4 AS STRING)",
    "Study_Time": "CASE WHEN k % 41 = 0 THEN 'n/a' ELSE CAST(1 + p % 4 AS STRING) END",
    "Number_of_Failures": "CAST(CASE WHEN n_ret > 3 THEN 3 ELSE n_ret END AS STRING)",
    "School_Support": "CASE WHEN k % 3 = 0 THEN 'yes' ELSE 'no' END",
    "Family_Support": "CASE WHEN a % 2 = 0 THEN 'yes' ELSE 'no' END",
    "Extra_Paid_Class": "CASE WHEN k % 11 = 0 THEN 'yes' ELSE 'no' END",
    "Extra_Curricular_Activities": "CASE WHEN p % 2 = 0 THEN 'yes' ELSE 'no' END",
    "Attended_Nursery": "CASE WHEN c % 5 = 0 THEN 'no' ELSE 'yes' END",
    "Wants_Higher_Education": "CASE WHEN p % 10 = 0 THEN 'no' ELSE 'yes' END",
    "Internet_Access": (
        "CASE WHEN k % 43 = 0 THEN 'maybe' WHEN c % 4 = 0 THEN 'no' ELSE 'yes' END"
    ),
    "In_Relationship": "CASE WHEN k % 8 < 3 THEN 'yes' ELSE 'no' END",
    "Family_Relationship": "CAST(1 + a % 5 AS STRING)",
    "Free_Time": "CAST(1 + p % 5 AS STRING)",
    "Going_Out": "CAST(1 + qty % 5 AS STRING)",
    "Weekend_Alcohol_Consumption": "CAST(1 + (qty + c) % 5 AS STRING)",
    "Weekday_Alcohol_Consumption": "CAST(1 + (qty + a) % 5 AS STRING)",
    "Health_Status": "CAST(1 + k % 5 AS STRING)",
    "Number_of_Absences": "CAST((n_ret * 5 + k % 9) AS STRING)",
    "Grade_1": (
        "CASE WHEN k % 37 = 0 THEN NULL WHEN k % 101 = 0 THEN '25' "
        "ELSE CAST(p % 18 + k % 3 AS STRING) END"
    ),
    "Grade_2": "CASE WHEN k % 103 = 0 THEN '-1' ELSE CAST(p % 18 + c % 3 AS STRING) END",
    "Final_Grade": "CAST(p % 18 + a % 3 AS STRING)",
    "Dropped_Out": (
        "CASE WHEN p % 18 < 3 AND (n_ret > 0 OR k % 4 = 0) OR k % 61 = 0 "
        "THEN 'True' ELSE 'False' END"
    ),
}
SELECT_LIST = ",\n  ".join(f"{expr} AS {name}" for name, expr in COLUMNS.items())

SQL = f"""lines AS (
  SELECT l_orderkey, count(*) AS n_lines,
         sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_ret,
         CAST(sum(l_quantity) AS BIGINT) AS qty
  FROM lineitem GROUP BY l_orderkey),
enrolment AS (
  SELECT o.o_orderkey AS k, o.o_custkey AS c, CAST(floor(o.o_totalprice) AS BIGINT) AS p,
         CAST(floor(abs(cu.c_acctbal)) AS BIGINT) AS a, o.o_orderstatus AS st,
         o.o_orderpriority AS pr, cu.c_mktsegment AS seg, cu.c_nationkey AS nk,
         coalesce(li.n_ret, 0) AS n_ret, coalesce(li.qty, 0) AS qty
  FROM orders o JOIN customer cu ON o.o_custkey = cu.c_custkey
  LEFT JOIN lines li ON li.l_orderkey = o.o_orderkey),
once AS (SELECT {SELECT_LIST} FROM enrolment),
raw AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE student_id % 50 = 0)"""


def derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as ``raw`` in :data:`SQL`; copies are exploded so the joins run once."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    lines = (
        spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        .groupBy("l_orderkey")
        .agg(
            F.count_if(F.col("l_returnflag") == "R").alias("n_ret"),
            F.sum("l_quantity").cast("bigint").alias("qty"),
        )
    )
    enrolment = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            F.col("o_orderkey").alias("k"),
            F.col("o_custkey").alias("c"),
            F.floor("o_totalprice").alias("p"),
            F.floor(F.abs("c_acctbal")).alias("a"),
            F.col("o_orderstatus").alias("st"),
            F.col("o_orderpriority").alias("pr"),
            F.col("c_mktsegment").alias("seg"),
            F.col("c_nationkey").alias("nk"),
            F.coalesce("n_ret", F.lit(0)).alias("n_ret"),
            F.coalesce("qty", F.lit(0)).alias("qty"),
        )
    )
    copies = F.when(F.col("k") % 50 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return enrolment.withColumn("copy", F.explode(copies)).selectExpr(
        *[f"{expr} AS {name}" for name, expr in COLUMNS.items()]
    )


#: Files of the learner table, dealt by id whatever the plan of the joins, so that narrow steps use all cores.
PARTS = 16

_paths: dict[tuple[str, str], str] = {}


def student_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw learner table, written once per application and read from there by every query."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _paths:
        path = new_path(spark, "students")
        derive(spark, sf_dir).repartition(PARTS, "student_id").write.parquet(path)
        _paths[key] = path
    return spark.read.parquet(_paths[key])
