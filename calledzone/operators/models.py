"""Choosing, checking and taking apart stored nets."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calledzone import schema as S
from calledzone.functions import net
from calledzone.session import small_side


def lookup_weights(models: DataFrame, inputs: int, *keys, prefix: str = "") -> DataFrame:
    """Keys and plain weight columns of usable models, ready to be joined to pitches."""
    columns = net.weight_columns(inputs, prefix)
    return usable_models(models).select(*keys, *[c.alias(name) for name, c in columns.items()])


def usable_models(models: DataFrame) -> DataFrame:
    return models.where(net.usable(F.col("status"), F.col("sse")))


def of_kind(models: DataFrame, kind: str, span: str | None = None) -> DataFrame:
    rows = models.where(F.col("kind") == kind)
    return rows if span is None else rows.where(F.col("span") == span)


def zone_model(models: DataFrame, wanted: DataFrame) -> DataFrame:
    """Umpire models named by rows of (id, start, end, stand); id is a number or 'generic'."""
    names = models.withColumn(
        "id", F.coalesce(F.col("entity_id").cast("string"), F.lit("generic"))
    ).withColumnsRenamed({"d_s": "start", "d_e": "end"})
    keys = ["id", "start", "end", "stand"]
    return names.join(wanted.select(*keys).dropDuplicates(), keys).withColumnsRenamed(
        {"start": "d_s", "end": "d_e"}
    ).select(*models.columns)


def batter_model(models: DataFrame, batters: DataFrame) -> DataFrame:
    """A batter-season's own model only; batters without one drop out."""
    own = of_kind(models, S.BATTER).withColumnsRenamed({"entity_id": "id", "season": "year"})
    return own.join(batters.select("id", "year"), ["id", "year"])


def with_fallback(batters: DataFrame, hands: DataFrame, own: DataFrame, pooled: DataFrame) -> DataFrame:
    """Attach to each batter-season its own row, else the pooled row of its main hand.

    `own` is keyed by (id, year), `pooled` by (year, stand); both carry one struct
    column `pick`. Column `generic` says which was used (0 own, 1 pooled).
    """
    hands = hands.select(F.col("batter").alias("id"), F.col("season").alias("year"), "stand")
    rows = batters.join(own.withColumnRenamed("pick", "own"), ["id", "year"], "left")
    rows = rows.join(hands, ["id", "year"], "left")
    rows = rows.join(small_side(pooled.withColumnRenamed("pick", "pooled")), ["year", "stand"], "left")
    return rows.select(
        "id", "year", "stand",
        F.coalesce("own", "pooled").alias("pick"),
        F.col("own").isNull().cast("int").alias("generic"),
    )


def umpire_health(models: DataFrame) -> DataFrame:
    """Umpire models with `test`: usable weights and a sure strike in the middle of the zone."""
    weights = net.weight_columns(0)
    tested = models.withColumns(weights).withColumn("p_centre", net.net_score([]))
    sound = (F.col("status") == "ok") & (F.col("p_centre") >= S.UMPIRE_HEALTH_FLOOR)
    return tested.withColumn("test", F.coalesce(sound, F.lit(False))).drop(*weights)


def batter_health(models: DataFrame) -> DataFrame:
    """Batter models with `test`: usable weights and no strike at any far-off point."""
    weights = net.weight_columns(2)
    far = [net.net_score(point) for point in S.BATTER_HEALTH_PROBES]
    tested = models.withColumns(weights).withColumn("p_worst", F.greatest(*far))
    sound = (F.col("status") == "ok") & (F.col("p_worst") <= S.BATTER_HEALTH_CEILING)
    return tested.withColumn("test", F.coalesce(sound, F.lit(False))).drop(*weights)


def failing(tested: DataFrame) -> DataFrame:
    return tested.where(~F.col("test"))


def pending(tasks: DataFrame, models: DataFrame) -> DataFrame:
    """Tasks no stored model answers yet.

    A failed umpire fit is stored as such and stays; a batter without a usable net is tried again, as
    pitches may have been added.
    """
    stays = ~F.col("kind").isin(S.BATTER, S.BATTER_GENERIC) | (F.col("status") == "ok")
    return tasks.join(models.where(stays).select("model_key"), "model_key", "left_anti")


def model_edges(models: DataFrame) -> DataFrame:
    """Nets as edge rows: one per weight, with the fit's error and steps."""
    key = [c for c in ("model_key", "sse", "steps") if c in models.columns]
    inputs = F.concat(F.array(F.lit("bias")), F.col("features"))
    hidden = models.select(
        *key, inputs.alias("names"), F.posexplode("w_hidden").alias("unit", "weights")
    ).select(*key, "names", "unit", F.posexplode("weights").alias("i", "weight"))
    first = hidden.select(
        *key, F.lit(1).alias("layer"), F.get("names", F.col("i")).alias("source"),
        F.concat(F.lit("h"), (F.col("unit") + 1).cast("string")).alias("target"), "weight",
    )
    out = models.select(*key, F.posexplode("w_out").alias("i", "weight"))
    source = F.when(F.col("i") == 0, "bias").otherwise(
        F.concat(F.lit("h"), F.col("i").cast("string"))
    )
    second = out.select(
        *key, F.lit(2).alias("layer"), source.alias("source"), F.lit("c").alias("target"), "weight"
    )
    return first.unionByName(second)
