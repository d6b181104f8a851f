"""Images made of tables: counts or sums on a grid, divided by the image's largest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dense(cells: DataFrame, h: int, w: int) -> DataFrame:
    """pixels(image_id, h, w, y, x, v) from sparse cells(image_id, y, x, n): missing cells are 0."""
    peaks = cells.groupBy("image_id").agg(F.max("n").alias("peak"))
    grid = peaks.select("image_id", "peak", F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("y")).select("image_id", "peak", "y", F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("x"))
    joined = grid.join(cells, ["image_id", "y", "x"], "left")
    return joined.select("image_id", F.lit(h).alias("h"), F.lit(w).alias("w"), "y", "x", (F.coalesce(F.col("n"), F.lit(0)) / F.col("peak")).cast("double").alias("v"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image of 30 days by 24 hours for each kind of event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts")
    cells = e.groupBy(F.col("event_type").alias("image_id"), (F.dayofmonth("ts") - 1).alias("y"), F.hour("ts").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    return dense(cells, 30, 24)


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image of 83 months by 50 quantities for each return flag and line status."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_linestatus", "l_shipdate", "l_quantity", "l_extendedprice")
    month: Column = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    cells = x.groupBy(F.concat("l_returnflag", F.lit("-"), "l_linestatus").alias("image_id"), month.alias("y"), (F.col("l_quantity").cast("int") - 1).alias("x")).agg(F.sum(cents).alias("n"))
    return dense(cells, 83, 50)


EVENTS_SQL = """cells as (
    select event_type as image_id, (day(ts) - 1)::int as y, hour(ts)::int as x, count(*) as n from events group by 1, 2, 3
), px as (
    select g.image_id, 30 as h, 24 as w, g.y, g.x, (coalesce(c.n, 0) / g.peak)::double as v
    from (select image_id, max(n) as peak, unnest(range(720)) as k from cells group by image_id) q,
         lateral (select q.image_id, q.peak, (q.k // 24)::int as y, (q.k % 24)::int as x) g
    left join cells c on c.image_id = g.image_id and c.y = g.y and c.x = g.x
)"""

LINEITEM_SQL = """cells as (
    select l_returnflag || '-' || l_linestatus as image_id, ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::int as y,
           l_quantity::int - 1 as x, sum(round(l_extendedprice * 100)::bigint)::bigint as n
    from lineitem group by 1, 2, 3
), px as (
    select g.image_id, 83 as h, 50 as w, g.y, g.x, (coalesce(c.n, 0)::double / g.peak::double) as v
    from (select image_id, max(n) as peak, unnest(range(4150)) as k from cells group by image_id) q,
         lateral (select q.image_id, q.peak, (q.k // 50)::int as y, (q.k % 50)::int as x) g
    left join cells c on c.image_id = g.image_id and c.y = g.y and c.x = g.x
)"""
