"""Adapters from the star-schema test tables to the canonical and the raw-looking layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def orders_tx(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical transactions from orders."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("description"),
        F.col("o_orderstatus").alias("status"),
    )


def events_tx(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical transactions from events; errors are failures."""
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("value").alias("amount"),
        F.col("event_type").alias("description"),
        (F.col("event_type") == "error").cast("int").alias("is_failure"),
    )


def retail_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Invoice lines with retail column names."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = table(spark, folder, "part").select("p_partkey", "p_type")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(parts, lines.l_partkey == parts.p_partkey)
        .select(
            # every 50th invoice stands for a cancellation
            F.when(F.col("o_orderkey") % 50 == 0, F.concat(F.lit("C"), F.col("o_orderkey").cast("string")))
            .otherwise(F.col("o_orderkey").cast("string"))
            .alias("Invoice"),
            F.col("l_partkey").alias("StockCode"),
            F.col("p_type").alias("Description"),
            F.col("l_quantity").alias("Quantity"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("UnitPrice"),
            F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("InvoiceDate"),
            F.col("o_custkey").alias("CustomerID"),
        )
    )


def bank_raw(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer with bank column names."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderdate")
    last = orders.agg(F.max("o_orderdate").alias("t")).scalar()
    per_user = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("NumOfProducts"),
        F.min("o_orderdate").alias("first"),
        F.max("o_orderdate").alias("latest"),
    )
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return customers.join(per_user, customers.c_custkey == per_user.o_custkey).select(
        F.col("c_custkey").alias("CustomerId"),
        F.col("c_nationkey").cast("string").alias("Geography"),
        F.col("c_acctbal").alias("Balance"),
        "NumOfProducts",
        F.floor(F.datediff(last, "first") / 365).alias("Tenure"),
        (F.abs("c_acctbal") * 12).alias("EstimatedSalary"),
        (F.datediff(last, "latest") > 120).cast("int").alias("Exited"),
    )


def upi_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Payments with payment-app column names."""
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("Txn ID"),
        F.col("user_id").cast("string").alias("Sender VPA"),
        F.concat(F.lit("m"), (F.col("event_id") % 37).cast("string")).alias("Payee VPA"),
        F.col("value").alias("Amount"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Txn Date"),
        F.when(F.col("event_type") == "error", "FAILURE").otherwise("SUCCESS").alias("Status"),
    )


def tax_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Tax credits with statement column names, one per invoice line."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_extendedprice", "l_tax", "l_returnflag", "l_linestatus"
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").cast("string").alias("PAN"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date_of_Credit"),
        F.col("l_extendedprice").alias("Gross_Amount_INR"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("TDS_Amount_INR"),
        F.col("l_returnflag").alias("Income_Head"),
        F.concat("l_returnflag", "l_linestatus").alias("Section"),
        F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("Quarter"),
    )
