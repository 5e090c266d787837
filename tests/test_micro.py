"""Hand-made cases with known answers."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from calledzone import schema as S
from calledzone.functions import net
from calledzone.functions import pitch as P
from calledzone.operators import buckets as B
from calledzone.operators import calendars as C
from calledzone.operators import grids as G
from calledzone.operators import models as M
from calledzone.operators import pitches as Q
from calledzone.operators import windows as W
from calledzone.sources.tables import with_calendar

UMPIRE_R = ([[5.1, 6.0, 0.0], [5.1, -6.0, 0.0], [6.0, 0.0, 6.0], [6.0, 0.0, -6.0]], [-21.0, 6.0, 6.0, 6.0, 6.0])
BATTER = ([[5.1, 6.0, 0.0], [5.1, -6.0, 0.0], [-9.6, 0.0, 6.0], [20.4, 0.0, -6.0]], [-21.0, 6.0, 6.0, 6.0, 6.0])


def model(spark, weights, kind=S.UMPIRE_GENERIC, features=S.ZONE_FEATURES, bias=None, status="ok", **more):
    w_hidden, w_out = weights
    if bias is not None:
        w_out = [bias, *w_out[1:]]
    row = dict(
        model_key="m", kind=kind, span="season", entity_id=None, season=2015, d_s=date(2015, 1, 1),
        d_e=date(2015, 12, 31), stand="R", features=list(features), hidden=4, w_hidden=w_hidden,
        w_out=w_out, n_train=1000, sse=1.0, steps=10, status=status,
    )
    row.update(more)
    return spark.createDataFrame([tuple(row[f] for f in S.MODELS.fieldNames())], S.MODELS)


def one(df):
    (row,) = df.collect()
    return row


def value(spark, column):
    return one(spark.range(1).select(column.alias("v")))["v"]


def test_dates_come_from_the_name(spark):
    names = spark.createDataFrame([("gid_2015_04_05_abc",), ("x",), ("gid_2015_13_05",), ("gid_2015_02_30",)], ["gameName"])
    rows = with_calendar(names).collect()
    assert [(r.game_date, r.season, r.month) for r in rows] == [(date(2015, 4, 5), 2015, 4)]


def test_height_is_scaled(spark):
    top, bottom = F.lit(3.4), F.lit(1.6)
    assert value(spark, P.scaled_height(F.lit(3.4), top, bottom)) == pytest.approx(1)
    assert value(spark, P.scaled_height(F.lit(1.6), top, bottom)) == pytest.approx(-1)
    assert value(spark, P.scaled_height(F.lit(2.0), F.lit(2.0), F.lit(2.0))) is None


@pytest.mark.parametrize("des,called,strike", [
    ("Ball", True, 0), ("ball in dirt", True, 0), ("Ball In Dirt", True, 0),
    ("Called Strike", True, 1), ("called strike", True, 0), ("Foul", False, 0),
])
def test_calls(spark, des, called, strike):
    assert value(spark, P.is_called(F.lit(des))) is called
    assert value(spark, P.strike_flag(F.lit(des))) == strike


def test_naive_box_is_open(spark):
    assert value(spark, P.in_naive_box(F.lit(0.0), F.lit(2.0))) == 1
    assert value(spark, P.in_naive_box(F.lit(0.85), F.lit(2.0))) == 0
    assert value(spark, P.in_naive_box(F.lit(0.0), F.lit(1.5))) == 0


def test_bucket_rounds_down(spark):
    assert value(spark, P.bucket(F.lit(-0.1))) == -2


@pytest.mark.parametrize("p,c,ucs", [(0.9, 1, 0.08), (0.9, 0, -0.72), (0.5, 1, 0.0)])
def test_call_score(spark, p, c, ucs):
    assert value(spark, net.call_score(F.lit(p), F.lit(c))) == pytest.approx(ucs)


@pytest.mark.parametrize("n,expected", [(100, 0.53), (0, 0.5)])
def test_shrink(spark, n, expected):
    column = net.shrink(F.lit(0.8), F.lit(n), F.lit(0.5), F.lit(900.0))
    assert value(spark, column) == pytest.approx(expected)


def test_bucket_score(spark):
    rows = [("m", 0, 30, 0.4), ("m", 1, 30, 0.6), ("m", 1, 30, 0.6)]
    model = spark.createDataFrame(rows, "k string, grid_x int, grid_z int, ratio double")
    pitches = spark.createDataFrame(
        [("m", 0.05, 2.55), ("m", 0.1, 2.55), ("m", 1.9, 2.55)], "k string, px double, pz double"
    )
    scored = B.bucket_score(pitches, model, ["k"]).orderBy("px")
    assert [r.roeg for r in scored.collect()] == [0.4, -1.0, 0.0]


def test_known_probabilities(spark):
    weights = M.lookup_weights(model(spark, UMPIRE_R), 2, "model_key")
    assert one(weights.select(net.net_score([0, 0]).alias("p"))).p == pytest.approx(0.947728, abs=1e-6)
    weights = M.lookup_weights(model(spark, BATTER), 2, "model_key")
    far = one(weights.select(net.net_score([0, 6]).alias("a"), net.net_score([3, 2.25]).alias("b")))
    assert (far.a, far.b) == (pytest.approx(0.0442, abs=1e-4), pytest.approx(0.0421, abs=1e-4))


def test_known_zone_and_area(spark):
    limits = one(G.zone_extents(model(spark, BATTER)))
    assert (limits.sz_top, limits.sz_bot) == (3.38, 1.62)
    cells = one(G.strike_cells(model(spark, UMPIRE_R))).cells
    assert cells == 4801
    assert value(spark, G.square_inches(F.lit(cells), F.lit(2.0))) == pytest.approx(432.09)


@pytest.mark.parametrize("weights", [UMPIRE_R, BATTER])
def test_skipped_blocks_hold_no_strike(spark, weights):
    tilted = ([[b + 0.3, x - 1.1, z + 0.7] for b, x, z in weights[0]], weights[1])
    nets = model(spark, tilted)
    for grid in (G.AREA_GRID, G.BATTER_GRID):
        every = G.over_grid(nets, grid).where("p > 0.5").agg(
            F.count("*").alias("n"), F.max("z").alias("top"), F.min("z").alias("bot")
        )
        all_cells, limits = one(every), one(G.zone_extents(nets, grid))
        assert one(G.strike_cells(nets, grid)).cells == all_cells.n
        assert (limits.sz_top, limits.sz_bot) == (all_cells.top, all_cells.bot)


def test_empty_zone_is_null(spark):
    nets = model(spark, BATTER, bias=-30.0)
    limits = one(G.zone_extents(nets))
    assert (limits.sz_top, limits.sz_bot) == (None, None)
    assert one(G.strike_cells(nets)).cells == 0


def test_umpire_health(spark):
    assert one(M.umpire_health(model(spark, UMPIRE_R))).test is True
    assert one(M.umpire_health(model(spark, UMPIRE_R, bias=-30.0))).test is False
    assert one(M.umpire_health(model(spark, UMPIRE_R, status="not_converged"))).test is False
    moving = ([[*unit, 0.05, -0.05] for unit in UMPIRE_R[0]], UMPIRE_R[1])
    assert one(M.umpire_health(model(spark, moving, kind=S.UMPIRE_MOVEMENT))).test is True
    assert one(M.umpire_health(model(spark, (None, [None]), status="error", w_out=None))).test is False


def test_batter_health(spark):
    assert one(M.batter_health(model(spark, BATTER))).test is True
    assert one(M.batter_health(model(spark, BATTER, bias=-10.0))).test is False


def test_main_hand_tie_goes_to_first_letter(spark):
    atbats = spark.createDataFrame(
        [("gid_2015_05_01", 7, hand) for hand in "LR" * 10], "gameName string, batter long, stand string"
    )
    row = one(Q.main_hands(atbats))
    assert (row.stand, row.ab) == ("L", 10)


def season(spark, first, last):
    games = spark.createDataFrame(
        [(f"gid_{d:%Y_%m_%d}", "R") for d in (first, last)], "gameName string, type string"
    )
    return Q.season_range(games)


def test_month_windows_cover_the_season(spark):
    rows = C.month_windows(season(spark, date(2015, 3, 29), date(2015, 10, 4))).orderBy("d_s").collect()
    assert [r.month for r in rows] == [3, 4, 5, 6, 7, 8, 9, 10]
    assert (rows[0].d_s, rows[0].d_e) == (date(2015, 3, 29), date(2015, 3, 31))
    assert (rows[1].d_s, rows[1].d_e) == (date(2015, 4, 1), date(2015, 4, 30))
    assert (rows[-1].d_s, rows[-1].d_e) == (date(2015, 10, 1), date(2015, 10, 4))


def test_year_to_date_ends_on_day_30(spark):
    months = spark.createDataFrame([(2015, 5), (2015, 2)], "season int, month int")
    ends = {r.month: r.d_e for r in C.year_to_date(months).collect()}
    assert ends == {5: date(2015, 5, 30), 2: date(2015, 2, 28)}


def test_window_end_is_open(spark):
    fact = spark.createDataFrame(
        [(1, date(2015, 5, 1), "R"), (2, date(2015, 5, 31), "R")], "pitch_id long, game_date date, stand string"
    )
    window = spark.createDataFrame(
        [("w", date(2015, 5, 1), date(2015, 5, 31), "R")], "model_key string, d_s date, d_e date, stand string"
    )
    assert [r.pitch_id for r in W.assign_windows(fact, window, ("stand",)).collect()] == [1]


def test_model_edges(spark):
    edges = M.model_edges(model(spark, UMPIRE_R)).collect()
    assert len(edges) == 4 * 3 + 5
    assert {(e.source, e.target): e.weight for e in edges}[("px", "h2")] == -6.0


def test_models_by_list_and_fallback(spark):
    wanted = spark.createDataFrame(
        [("generic", date(2015, 1, 1), date(2015, 12, 31), "R")] * 2, S.MODEL_LIST
    )
    assert M.zone_model(model(spark, UMPIRE_R), wanted).count() == 1
    batters = spark.createDataFrame([(1, 2015), (2, 2015)], "id long, year int")
    hands = spark.createDataFrame([(1, 2015, "R"), (2, 2015, "R")], "batter long, season int, stand string")
    own = spark.createDataFrame([(1, 2015, ("own",))], "id long, year int, pick struct<k:string>")
    pooled = spark.createDataFrame([(2015, "R", ("pool",))], "year int, stand string, pick struct<k:string>")
    rows = {r.id: (r.pick.k, r.generic) for r in M.with_fallback(batters, hands, own, pooled).collect()}
    assert rows == {1: ("own", 0), 2: ("pool", 1)}
