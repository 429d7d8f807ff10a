"""The driver's tables read as filings.

A customer is a filing, an order a context of it (or, for calculation, an order's line), measures of lines and
orders are facts. Money is decimal from the start, so sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ISO4217, XBRLI
from ..session import local_table

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def order_id(column: str = "o_orderkey") -> Column:
    return F.concat(F.lit("o"), text(column))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as contexts with members for priority, for status unless it is O, and for a customer's segment."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    dims = F.map_filter(
        F.create_map(F.lit("priority"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")), F.lit("segment"), F.col("c_mktsegment"), F.lit("status"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderstatus"))),
        lambda k, v: v.isNotNull(),
    )
    return joined.select(
        text("o_custkey").alias("instance_id"), order_id().alias("context_id"), F.lit("cust").alias("entity_scheme"), text("o_custkey").alias("entity_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", "duration").otherwise("instant").alias("period_type"), F.to_date("o_orderdate").alias("instant"),
        F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("end"), dims.alias("dims"), F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("clerk"), text(F.col("o_orderkey") % 1000))).otherwise(F.create_map().cast("map<string,string>")).alias("typed"),
        F.create_map(F.lit("segment"), F.when(F.col("o_orderkey") % 3 == 0, "segment").otherwise("scenario")).alias("containers"),
    )


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's total as a fact."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        text("o_custkey").alias("instance_id"), F.col("o_orderkey").alias("fact_ord"), F.lit("OrderTotal").alias("concept"), order_id().alias("context_id"), F.lit("USD").alias("unit_id"),
        text(F.col("o_totalprice").cast(MONEY)).alias("value"), F.lit("2").alias("decimals"), F.lit(None).cast("string").alias("precision"), F.lit(False).alias("is_nil"),
    )


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity, price, discount, tax and charge of a line in a context of its own, with value_dec."""
    lines = table(spark, sf_dir, "lineitem")
    price, off, tax = F.col("l_extendedprice").cast(MONEY), F.col("l_discount").cast(MONEY), F.col("l_tax").cast(MONEY)
    one = F.lit(1).cast(MONEY)
    facts = [
        ("LinePrice", price, "2"), ("LineDiscount", price * off, "0"), ("LineTax", price * (one - off) * tax, "0"), ("LineCharge", price * (one - off) * (one + tax), "0"),
    ]
    each = F.array(*(F.struct(F.lit(c).alias("concept"), v.cast("decimal(38,10)").alias("value_dec"), F.lit(d).alias("decimals")) for c, v, d in facts))
    rows = lines.select(F.lit("lines").alias("instance_id"), F.concat(order_id("l_orderkey"), F.lit("-"), text("l_linenumber")).alias("context_id"), F.explode(each).alias("f"))
    return rows.select("instance_id", "context_id", "f.concept", F.lit("USD").alias("unit_id"), "f.value_dec", "f.decimals", F.lit(None).cast("string").alias("precision"))


def quantity_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line's quantity as a fact of its order; the unit is the line's status, decimals and precision vary with the line."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.lit("lines").alias("instance_id"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("fact_ord"), F.when(F.col("l_returnflag") == "R", "Returned").otherwise("Shipped").alias("concept"), order_id("l_orderkey").alias("context_id"), F.col("l_linestatus").alias("unit_id"),
        text(F.col("l_quantity").cast(MONEY)).alias("value"), F.when(F.col("l_linenumber") % 3 != 0, "0").alias("decimals"), F.when(F.col("l_linenumber") % 2 == 0, "3").alias("precision"), (F.col("l_quantity") > 49).alias("is_nil"),
    )


def concepts(spark: SparkSession) -> DataFrame:
    rows = [
        ("OrderTotal", "{t}monetaryItemType", "instant", "debit"), ("LinePrice", "{t}monetaryItemType", "instant", "debit"), ("LineDiscount", "{t}monetaryItemType", "instant", "credit"),
        ("LineTax", "{t}monetaryItemType", "instant", "debit"), ("LineCharge", "{t}monetaryItemType", "instant", "debit"), ("Returned", "{t}decimalItemType", "duration", None), ("Shipped", "{t}stringItemType", "instant", None),
    ]
    return local_table(spark, rows, "concept string, data_type string, period_type string, balance string").withColumn("abstract", F.lit(False))


def line_arcs(spark: SparkSession) -> DataFrame:
    rows = [("lines", "LineCharge", "LinePrice", 1.0), ("lines", "LineCharge", "LineDiscount", -1.0), ("lines", "LineCharge", "LineTax", 1.0)]
    return local_table(spark, rows, "elr string, parent string, child string, weight double").withColumns({"use": F.lit("optional"), "eq_key": F.lit(None).cast("string")})


def nation_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit for each nation: a currency named after it, but every fifth divides by itself and every seventh is a measure of the base namespace."""
    name = F.upper(F.substring("n_name", 1, 3))
    currency, odd = F.concat(F.lit(f"{{{ISO4217}}}"), name), F.concat(F.lit(f"{{{XBRLI}}}"), F.lower(name))
    measure = F.when(F.col("n_nationkey") % 7 == 0, odd).otherwise(currency)
    divides = F.col("n_nationkey") % 5 == 0
    return table(spark, sf_dir, "nation").select(
        F.lit("customers").alias("instance_id"), text("n_nationkey").alias("unit_id"), F.when(divides, "divide").otherwise("simple").alias("form"),
        F.array(measure).alias("numerator"), F.when(divides, F.array(measure)).otherwise(F.array().cast("array<string>")).alias("denominator"),
    )


def customer_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's balance, in the unit of its nation."""
    return table(spark, sf_dir, "customer").select(
        F.lit("customers").alias("instance_id"), F.col("c_custkey").alias("fact_ord"), F.lit("OrderTotal").alias("concept"), text("c_custkey").alias("context_id"), text("c_nationkey").alias("unit_id"),
        text(F.col("c_acctbal").cast(MONEY)).alias("value"), F.lit("2").alias("decimals"), F.lit(None).cast("string").alias("precision"), F.lit(False).alias("is_nil"),
    )
