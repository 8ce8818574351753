"""Billed usage: pricing, spend labelling and serverless usage per job."""

from __future__ import annotations

from decimal import Decimal
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobmix.operators.joins import fits_broadcast
from jobmix.operators.labels import attach_labels
from jobmix.params import Params, TimeRange

JOBS_PRODUCT = "JOBS"
ALL_PURPOSE_PRODUCT = "ALL_PURPOSE"
SPEND_PRODUCTS = (JOBS_PRODUCT, ALL_PURPOSE_PRODUCT)
SRV, JC, AP_TOTAL, OTHER = "SRV", "JC", "AP_TOTAL", "OTHER"


def usage_in_range(usage: DataFrame, time_range: TimeRange) -> DataFrame:
    """Usage rows with ``usage_date`` between the two dates (both inclusive)."""
    d = F.col("usage_date")
    return usage.where(d.between(F.lit(time_range.min), F.lit(time_range.max)))


def spend_bucket() -> Column:
    """JOBS split by ``is_serverless`` (NULL is neither), ALL_PURPOSE as a total."""
    product = F.col("billing_origin_product")
    serverless = F.col("product_features.is_serverless")
    return (F.when((product == F.lit(JOBS_PRODUCT)) & (serverless == F.lit(True)), F.lit(SRV))
            .when((product == F.lit(JOBS_PRODUCT)) & (serverless == F.lit(False)), F.lit(JC))
            .when(product == F.lit(ALL_PURPOSE_PRODUCT), F.lit(AP_TOTAL))
            .otherwise(F.lit(OTHER)))


def price_usage(usage: DataFrame, prices: DataFrame, time_range: TimeRange,
                rate: Decimal | str | int = Decimal("1.0"),
                products: Sequence[str] = SPEND_PRODUCTS,
                keep: Sequence[str] = ()) -> DataFrame:
    """Price each usage row at the list price in force at ``usage_end_time``.

    A price is in force from ``price_start_time`` (inclusive) to
    ``price_end_time`` (exclusive, NULL = still open).  Usage with no price
    in force costs 0.  ``rate`` multiplies the list price (an effective
    contract rate).  Quantity, price and rate are multiplied in decimal; with
    the declared input types the product keeps all its digits, with wider
    decimals Spark rounds it to the scale its decimal rules allow.

    Output: ``date``, ``workspace_id``, ``bucket``, ``revenue`` (+ ``keep``).
    The price list is a dimension (SKUs x price changes): it is broadcast when
    its estimate fits, the SKU / unit equality is the hash key and the validity
    interval a residual condition.  Beyond the bound both sides are shuffled by
    SKU, unit and month of use: see :func:`month_bin`.
    """
    rate = Decimal(str(rate))
    u = usage_in_range(usage, time_range).where(F.col("billing_origin_product").isin(list(products)))
    u = u.select("usage_date", "usage_end_time", "workspace_id", "sku_name", "usage_unit",
                 "usage_quantity", "billing_origin_product", "product_features", *keep)
    p = prices.select(F.col("sku_name").alias("_p_sku"), F.col("usage_unit").alias("_p_unit"),
                      F.col("price_start_time").alias("_p_start"),
                      F.col("price_end_time").alias("_p_end"),
                      F.col("pricing.default").alias("_p_price"))
    end = u["usage_end_time"]
    cond = ((u["sku_name"] == p["_p_sku"]) & (u["usage_unit"] == p["_p_unit"])
            & (end >= p["_p_start"]) & ((end < p["_p_end"]) | p["_p_end"].isNull()))
    if fits_broadcast(p):
        p = F.broadcast(p)
    else:
        u = u.withColumn("_bin", month_bin(F.col("usage_end_time"), time_range))
        first = month_bin(F.col("_p_start"), time_range)
        last = month_bin(F.coalesce("_p_end", F.lit("9999-12-31").cast("timestamp")), time_range)
        p = p.where("_p_start < _p_end OR _p_end IS NULL").withColumn("_p_bin", F.explode(F.sequence(first, last)))
        cond = cond & (F.col("_bin") == F.col("_p_bin"))
    joined = u.join(p, cond, "left")
    revenue = (F.col("usage_quantity") * F.coalesce(F.col("_p_price"), F.lit(Decimal("0")))
               * F.lit(rate))
    return joined.select(F.col("usage_date").alias("date"), "workspace_id",
                         spend_bucket().alias("bucket"), revenue.alias("revenue"), *keep)


def month_bin(at: Column, time_range: TimeRange) -> Column:
    """The month of a time, as a number, brought into the range and a month on both sides of it.

    An equality that an interval join can be shuffled by: a price stands in
    every bin that it is in force in, usage in its own.  A few hundred SKUs are
    too few keys for a large shuffle, and one of them may have a third of all
    usage; by month there are as many times more as the range has months, and
    adaptive execution splits what is still too much.  Bringing both sides into
    the range keeps their order, so a price's bins still hold those of the
    usage it covers, and an open price gets no endless list of bins.
    """
    def number(day) -> int:
        return day.year * 12 + day.month

    return F.greatest(F.lit(number(time_range.min) - 1), F.least(
        F.lit(number(time_range.max) + 1), F.year(at) * 12 + F.month(at)))


def overlapping_prices(prices: DataFrame) -> DataFrame:
    """Pairs of prices of one SKU and unit that are in force at the same time.

    Usage at such a time is counted once per price; a price list should give
    no row here.  Each price is compared with the latest end before it, so a
    SKU's history is read once, in order.
    """
    by_sku = Window.partitionBy("sku_name", "usage_unit").orderBy("price_start_time", "price_end_time")
    before = by_sku.rowsBetween(Window.unboundedPreceding, -1)
    open_end = F.lit("9999-12-31").cast("timestamp")
    ends = F.coalesce("price_end_time", open_end)
    return (prices.where(F.col("price_start_time") < ends)
            .withColumn("earlier_end", F.max(F.coalesce("price_end_time", open_end)).over(before))
            .where(F.col("earlier_end") > F.col("price_start_time"))
            .select("sku_name", "usage_unit", "price_start_time", "price_end_time", "earlier_end"))


def tag_spend(priced: DataFrame, ws: DataFrame, params: Params | None = None) -> DataFrame:
    """Attach ``bu`` / ``env`` of the workspace to priced usage and apply the choices.

    A ``bu`` that is already there (taken from a tag of the usage) is kept.
    """
    return attach_labels(priced, ws, params, with_name=False, keep_bu="bu" in priced.columns)


def serverless_usage(usage: DataFrame, time_range: TimeRange, keep: Sequence[str] = ()) -> DataFrame:
    """Serverless job usage per (workspace, job, ``keep``): DBUs, first and last day.

    Aggregated before any join, so the name lookups afterwards see one row
    per job instead of one per usage record.
    """
    u = (usage_in_range(usage, time_range)
         .where((F.col("billing_origin_product") == F.lit(JOBS_PRODUCT))
                & (F.col("product_features.is_serverless") == F.lit(True))
                & F.col("usage_metadata.job_id").isNotNull()))
    return (u.groupBy("workspace_id", F.col("usage_metadata.job_id").alias("job_id"), *keep)
            .agg(F.sum("usage_quantity").alias("serverless_dbus"),
                 F.min("usage_date").alias("first_usage"),
                 F.max("usage_date").alias("last_usage")))


def job_names(jobs: DataFrame) -> DataFrame:
    """Job names collapsed to one row per (workspace, job).

    ``job_name`` is the greatest name; ``name_rows`` counts the rows a plain
    join would have matched (used to weight averages exactly).
    """
    return jobs.groupBy("workspace_id", "job_id").agg(
        F.max("name").alias("job_name"), F.count(F.lit(1)).alias("name_rows"))
