"""The driver's tables in the roles of SURVEY section 7.1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lepidus.plans import Tables

#: A total order over annotations, in which no two rows are equal.
ORDER = ["image_id", "num", "category_id", "supp", "qty", "price", "disc", "tax", "ship"]

IMG = "images AS (SELECT o_orderkey AS id, 'img_' || o_orderkey || '.jpg' AS file_name, o_custkey AS specimen FROM orders)"
CAT = "categories AS (SELECT p_partkey AS id, p_name AS name, p_brand AS supercategory FROM part)"
ANN = """ann AS (SELECT l_orderkey AS image_id, l_linenumber AS num, l_partkey AS category_id, l_suppkey AS supp, l_quantity AS qty,
 l_extendedprice AS price, l_discount AS disc, l_tax AS tax, l_shipdate AS ship, l_returnflag AS flag, l_linestatus AS status FROM lineitem)"""
NUM = f"{ANN}, numbered AS (SELECT *, row_number() OVER (ORDER BY {', '.join(ORDER)}) AS pos FROM ann)"


def images(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("img_"), "o_orderkey", F.lit(".jpg")).alias("file_name"), F.col("o_custkey").alias("specimen"))


def categories(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("supercategory"))


def annotations(t: Tables) -> DataFrame:
    a = t.lineitem.select(
        F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("num"), F.col("l_partkey").alias("category_id"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"), F.col("l_shipdate").alias("ship"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
    )
    return a.withColumn("bbox", F.array(F.col("num").cast("double"), F.col("supp").cast("double"), "qty", "disc"))


def groups(t: Tables) -> DataFrame:
    """(specimen, group): the nation of a customer, of which those of key 7, 11, ... (3 of 4) are mapped."""
    c = t.customer.where("c_custkey % 4 <> 3").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("specimen"), F.col("n_name").alias("group"))


GRP = "grp AS (SELECT c_custkey AS specimen, n_name AS \"group\" FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 4 <> 3)"
