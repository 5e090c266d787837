"""Schemas and fixed values shared by all jobs."""

from pyspark.sql import types as T

# Must equal the source system's, or results differ.
CALLED = ("Ball", "Ball In Dirt", "Called Strike")
CALLED_PREFIXES = ("Called", "Ball")
STRIKE = "Called Strike"
HOME_PLATE = "home"
REGULAR = "R"
SPRING = "S"
HANDS = ("R", "L")
NO_SCORE = -999.0
DUPLICATE_BUCKET = -1.0
NAIVE_BOX = {"left": -0.85, "right": 0.85, "low": 1.5, "high": 3.6}
BUCKETS_PER_FOOT = 12
AREA_CELLS_PER_FOOT = 40
BATTER_CELLS_PER_FOOT = 50
SQUARE_INCHES_PER_FOOT = 144
REGRESS_PITCHES = 900
MAX_TRAINING_PITCHES = 99_999
MAX_DAILY_TRAINING_PITCHES = 15_000
MIN_BATTER_PITCHES = 200
MAX_FIT_STEPS = 200_000
MAX_BATTER_FIT_STEPS = 100_000
UMPIRE_HEALTH_FLOOR = 0.8
BATTER_HEALTH_CEILING = 0.1
BATTER_HEALTH_PROBES = ((0, 6), (3, 2.25), (-3, 2.25), (-2, 6), (2, 6), (-2, 1), (2, 1))

ZONE_FEATURES = ("px", "pz_ratio")
MOVEMENT_FEATURES = ("px", "pz_ratio", "pfx_x", "pfx_z")
BATTER_FEATURES = ("px", "pz")

GAMES = T.StructType([
    T.StructField("gameName", T.StringType()),
    T.StructField("type", T.StringType()),
])
UMPIRES = T.StructType([
    T.StructField("gameName", T.StringType()),
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("position", T.StringType()),
])
ATBATS = T.StructType([
    T.StructField("gameName", T.StringType()),
    T.StructField("num", T.LongType()),
    T.StructField("batter", T.LongType()),
    T.StructField("stand", T.StringType()),
    T.StructField("b_height_in", T.IntegerType()),
])
PITCHES = T.StructType([
    T.StructField("gamedayPitchID", T.LongType()),
    T.StructField("gameName", T.StringType()),
    T.StructField("gameAtBatID", T.LongType()),
    T.StructField("px", T.DoubleType()),
    T.StructField("pz", T.DoubleType()),
    T.StructField("des", T.StringType()),
    T.StructField("start_speed", T.DoubleType()),
    T.StructField("pfx_x", T.DoubleType()),
    T.StructField("pfx_z", T.DoubleType()),
])
BATTER_ZONES = T.StructType([
    T.StructField("batter", T.IntegerType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("sz_top", T.DoubleType()),
    T.StructField("sz_bot", T.DoubleType()),
    T.StructField("generic", T.IntegerType()),
])
UMPIRE_UCS = T.StructType([
    T.StructField("gamedayPitchID", T.LongType()),
    T.StructField("umpire", T.LongType()),
    T.StructField("date", T.DateType()),
    T.StructField("p", T.DoubleType()),
    T.StructField("ucs", T.DoubleType()),
    T.StructField("c", T.ShortType()),
    T.StructField("stand", T.StringType()),
])
UMPIRE_ROC = T.StructType([
    T.StructField("gamedayPitchID", T.LongType()),
    T.StructField("umpire", T.LongType()),
    T.StructField("date", T.DateType()),
    T.StructField("n", T.LongType()),
    T.StructField("nn_ind", T.DoubleType()),
    T.StructField("nn_gen", T.DoubleType()),
    T.StructField("nn_pdata", T.DoubleType()),
    T.StructField("nn_regress", T.DoubleType()),
    T.StructField("roeg", T.DoubleType()),
    T.StructField("c", T.ShortType()),
    T.StructField("stand", T.StringType()),
])
MODEL_LIST = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("start", T.DateType()),
    T.StructField("end", T.DateType()),
    T.StructField("stand", T.StringType()),
])

# One fitted net per row. `kind` says what was fitted, `span` how long its window is.
UMPIRE_GENERIC = "ump_generic"
UMPIRE_INDIVIDUAL = "ump_individual"
UMPIRE_MOVEMENT = "ump_generic_pitchdata"
BATTER = "batter"
BATTER_GENERIC = "batter_generic"

TASK = T.StructType([
    T.StructField("model_key", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("span", T.StringType()),
    T.StructField("entity_id", T.LongType()),
    T.StructField("season", T.IntegerType()),
    T.StructField("d_s", T.DateType()),
    T.StructField("d_e", T.DateType()),
    T.StructField("stand", T.StringType()),
])
FIT = T.StructType([
    T.StructField("model_key", T.StringType()),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("hidden", T.IntegerType()),
    T.StructField("w_hidden", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("w_out", T.ArrayType(T.DoubleType())),
    T.StructField("n_train", T.LongType()),
    T.StructField("sse", T.DoubleType()),
    T.StructField("steps", T.IntegerType()),
    T.StructField("status", T.StringType()),
])
MODELS = T.StructType(TASK.fields + FIT.fields[1:])
BUCKET_MODELS = T.StructType([
    T.StructField("entity_id", T.LongType()),
    T.StructField("season", T.IntegerType()),
    T.StructField("span", T.StringType()),
    T.StructField("d_s", T.DateType()),
    T.StructField("d_e", T.DateType()),
    T.StructField("stand", T.StringType()),
    T.StructField("grid_x", T.IntegerType()),
    T.StructField("grid_z", T.IntegerType()),
    T.StructField("n", T.LongType()),
    T.StructField("s", T.LongType()),
    T.StructField("ratio", T.DoubleType()),
])
