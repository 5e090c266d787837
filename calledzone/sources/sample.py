"""Game tables seen through an order schema, so that every job can run on order data.

An order is an at-bat, its date the game, a supplier the umpire, a customer the
batter and a line item the pitch. Tests and the entry file use it; real data
comes through `tables`.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calledzone.sources.tables import GameTables

# Given outright, so that no job is spent on reading file footers for them.
SCHEMAS = {
    "orders": "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz",
    "supplier": "s_suppkey long, s_name string",
    "customer": "c_custkey long",
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
}
SLOTS, ORDER_IDS = 64, 1 << 20
FIRST_DAY = "1995-01-01"


GAME_NAME = "concat('gid_', replace(CAST(o_orderdate AS STRING), '-', '_')) AS gameName"
# As stored by `ingest`, the tables carry their dates.
CALENDAR = (
    "o_orderdate AS game_date", "year(o_orderdate) AS season", "month(o_orderdate) AS month"
)


def games(orders: DataFrame) -> DataFrame:
    return orders.select("o_orderdate").distinct().selectExpr(
        GAME_NAME, "CASE WHEN month(o_orderdate) <= 2 THEN 'S' ELSE 'R' END AS type", *CALENDAR
    )


def umpires(orders: DataFrame, supplier: DataFrame) -> DataFrame:
    staff = supplier.agg(F.count("*")).scalar()
    days = orders.select("o_orderdate").distinct()
    turn = F.datediff("o_orderdate", F.lit(FIRST_DAY).cast("date")) % staff
    return days.withColumn("s_suppkey", turn).join(supplier, "s_suppkey").selectExpr(
        GAME_NAME, "s_suppkey AS id",
        "CASE WHEN s_suppkey % 9 = 8 THEN '' ELSE s_name END AS name", "'home' AS position",
    )


def atbats(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        GAME_NAME, "o_orderkey AS num", "o_custkey AS batter",
        """CASE WHEN o_orderkey % 5 = 0 THEN 'X'
                WHEN (o_custkey + o_orderkey) % 7 < 3 THEN 'L' ELSE 'R' END AS stand""",
        "CAST(CASE WHEN o_custkey % 50 = 0 THEN 0 ELSE 66 + o_custkey % 13 END AS INT) AS b_height_in",
        *CALENDAR,
    )


def pitches(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Lines are numbered within slots of their order, so that a long order spreads over tasks."""
    lines = lineitem.selectExpr("*", f"(l_partkey + l_suppkey) % {SLOTS} AS slot").selectExpr(
        "*",
        "(l_quantity - 25.5D) / 12.5D AS x",
        "1.0D + (l_partkey % 101) * 0.05D AS z",
        """row_number() OVER (
             PARTITION BY l_orderkey, slot
             ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                      l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS line""",
    )
    lines = lines.selectExpr(
        "l_orderkey AS gameAtBatID",
        f"l_orderkey * {ORDER_IDS} + (line - 1) * {SLOTS} + slot AS gamedayPitchID",
        "CASE WHEN l_partkey % 97 <> 0 THEN x END AS px",
        "CASE WHEN l_suppkey % 89 <> 0 THEN z END AS pz",
        """CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'In play, out(s)'
                WHEN (abs(x) < 0.9D AND z BETWEEN 1.6D AND 3.5D)
                     <> ((l_partkey + l_suppkey) % 17 = 0) THEN 'Called Strike'
                WHEN z < 1.25D AND l_linestatus = 'F' THEN 'Ball In Dirt'
                WHEN z < 1.25D THEN 'Ball in Dirt'
                ELSE 'Ball' END AS des""",
        "CAST(NULL AS DOUBLE) AS start_speed",
        "l_discount * 100.0D - 5.0D AS pfx_x",
        "l_tax * 100.0D AS pfx_z",
    )
    dates = orders.selectExpr("o_orderkey AS gameAtBatID", GAME_NAME)
    return lines.join(dates, "gameAtBatID")


def batter_zones(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """Zones of every batter in all seasons from the first order's to the last one's."""
    first, last = (orders.agg(pick(F.year("o_orderdate"))).scalar() for pick in (F.min, F.max))
    spans = customer.select(F.col("c_custkey").alias("batter"), first.alias("first"), last.alias("last"))
    years = spans.selectExpr("batter", "explode(sequence(first, last)) AS year")
    return years.where("(batter + year) % 11 <> 0").selectExpr(
        "batter", "year",
        "3.2D + (batter % 7) * 0.1D AS sz_top", "1.4D + (batter % 5) * 0.08D AS sz_bot",
        "0 AS generic",
    )


def load(spark: SparkSession, root: str) -> GameTables:
    """Game tables over the parquet files under `root`."""

    def table(name):
        return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}.parquet")

    orders = table("orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    return GameTables(
        games=games(orders),
        umpires=umpires(orders, table("supplier")),
        atbats=atbats(orders),
        pitches=pitches(table("lineitem"), orders),
        zones=batter_zones(table("customer"), orders),
    )
