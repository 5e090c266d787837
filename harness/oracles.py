"""The same results in plain SQL, for checking the registered queries on whole tables."""

FIRST, LAST = 1995, 2001
RECENT_PITCHES = 150
BATTER_ROWS = 10
POOLED_BATTER_ROWS = 500

BASE = """
ord AS (
  SELECT *, CAST(o_orderdate AS DATE) AS d, 'gid_' || strftime(o_orderdate, '%Y_%m_%d') AS gameName
  FROM orders
),
games AS (
  SELECT DISTINCT gameName, d AS game_date, CAST(year(d) AS INT) AS season,
         CASE WHEN month(d) <= 2 THEN 'S' ELSE 'R' END AS type
  FROM ord
),
umpires AS (
  SELECT gameName, s_suppkey AS id, CASE WHEN s_suppkey % 9 = 8 THEN '' ELSE s_name END AS name
  FROM games JOIN supplier
    ON s_suppkey = date_diff('day', DATE '1995-01-01', game_date) % (SELECT count(*) FROM supplier)
),
names AS (SELECT id, min(name) AS name FROM umpires GROUP BY id),
atbats AS (
  SELECT gameName, d AS game_date, CAST(year(d) AS INT) AS season, CAST(month(d) AS INT) AS month,
         o_orderkey AS num, o_custkey AS batter,
         CASE WHEN o_orderkey % 5 = 0 THEN 'X'
              WHEN (o_custkey + o_orderkey) % 7 < 3 THEN 'L' ELSE 'R' END AS stand,
         CASE WHEN o_custkey % 50 = 0 THEN 0 ELSE 66 + o_custkey % 13 END AS b_height_in
  FROM ord
),
lines AS (
  SELECT *, (l_quantity - 25.5::DOUBLE) / 12.5::DOUBLE AS px0,
         1.0::DOUBLE + (l_partkey % 101) * 0.05::DOUBLE AS pz0,
         (l_partkey + l_suppkey) % 64 AS slot,
         row_number() OVER (PARTITION BY l_orderkey, (l_partkey + l_suppkey) % 64 ORDER BY l_linenumber, l_partkey, l_suppkey,
           l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS rn
  FROM lineitem
),
pitches AS (
  SELECT l_orderkey AS gameAtBatID, l_orderkey * 1048576 + (rn - 1) * 64 + slot AS pitch_id,
         CASE WHEN l_partkey % 97 <> 0 THEN px0 END AS px,
         CASE WHEN l_suppkey % 89 <> 0 THEN pz0 END AS pz,
         l_discount * 100.0::DOUBLE - 5.0::DOUBLE AS pfx_x, l_tax * 100.0::DOUBLE AS pfx_z,
         CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'In play, out(s)'
              WHEN (abs(px0) < 0.9::DOUBLE AND pz0 BETWEEN 1.6::DOUBLE AND 3.5::DOUBLE)
                   <> ((l_partkey + l_suppkey) % 17 = 0) THEN 'Called Strike'
              WHEN pz0 < 1.25::DOUBLE AND l_linestatus = 'F' THEN 'Ball In Dirt'
              WHEN pz0 < 1.25::DOUBLE THEN 'Ball in Dirt'
              ELSE 'Ball' END AS des
  FROM lines
),
zones AS (
  SELECT c_custkey AS batter, CAST(y AS INT) AS season,
         3.2::DOUBLE + (c_custkey % 7) * 0.1::DOUBLE AS sz_top,
         1.4::DOUBLE + (c_custkey % 5) * 0.08::DOUBLE AS sz_bot
  FROM customer, (SELECT unnest(range(min(year(d)), max(year(d)) + 1)) AS y FROM ord)
  WHERE (c_custkey + y) % 11 <> 0
),
thrown AS (
  SELECT p.*, a.game_date, a.season, a.month, a.batter, a.stand, a.b_height_in, g.type, u.id AS umpire,
         z.sz_top, z.sz_bot, (z.sz_top + z.sz_bot) / 2 AS sz_mid,
         (p.pz - (z.sz_top + z.sz_bot) / 2) / ((z.sz_top - z.sz_bot) / 2) AS pz_ratio,
         CAST(p.des = 'Called Strike' AS INT) AS c
  FROM pitches p JOIN atbats a ON a.num = p.gameAtBatID
  JOIN games g ON g.gameName = a.gameName
  JOIN umpires u ON u.gameName = a.gameName
  LEFT JOIN zones z ON z.batter = a.batter AND z.season = a.season
),
calls AS MATERIALIZED (
  SELECT * FROM thrown
  WHERE lower(des) IN ('ball', 'ball in dirt', 'called strike')
    AND px IS NOT NULL AND pz IS NOT NULL AND type = 'R'
),
train AS (SELECT * FROM calls WHERE sz_top IS NOT NULL AND b_height_in <> 0),
fact AS (SELECT * FROM calls WHERE sz_top IS NOT NULL AND stand IN ('L', 'R')),
seasons AS (
  SELECT season, min(game_date) AS min_date, max(game_date) AS max_date
  FROM games WHERE type = 'R' GROUP BY season
),
hands AS (SELECT unnest(['R', 'L']) AS stand),
month_starts AS (
  SELECT season, min_date, max_date,
         CAST(unnest(generate_series(date_trunc('month', min_date), CAST(max_date AS TIMESTAMP),
                                     INTERVAL 1 MONTH)) AS DATE) AS m
  FROM seasons
),
month_w AS (
  SELECT season, CAST(month(m) AS INT) AS month, greatest(min_date, m) AS d_s,
         least(max_date, last_day(m)) AS d_e, 'month' AS span, m AS month_day
  FROM month_starts
),
year_w AS (
  SELECT season, make_date(season, 1, 1) AS d_s, make_date(season, 12, 31) AS d_e, 'season' AS span
  FROM seasons
),
ytd_w AS (
  SELECT season, month, make_date(season, 1, 1) AS d_s,
         least(month_day + 29, last_day(month_day)) AS d_e, 'ytd' AS span, month_day
  FROM month_w
),
counts AS (
  SELECT umpire AS id, season, month, stand, count(*) AS pcount
  FROM calls WHERE b_height_in <> 0 GROUP BY ALL
),
hand_ab AS (
  SELECT batter, season, stand, count(*) AS ab FROM atbats GROUP BY ALL
),
main_hand AS (
  SELECT batter, season, stand, ab FROM hand_ab
  QUALIFY row_number() OVER (PARTITION BY batter, season ORDER BY ab DESC, stand) = 1
),
"""


def key(kind: str, entity: str = "'generic'") -> str:
    return f"concat_ws('.', '{kind}', {entity}, span, d_s, d_e, stand)"


def logistic(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


def p(*inputs: str, hidden: str = "w_hidden", out: str = "w_out") -> str:
    total = f"{out}[1]"
    for unit in range(1, 5):
        drive = f"{hidden}[{unit}][1]"
        for i, name in enumerate(inputs, start=2):
            drive += f" + {hidden}[{unit}][{i}] * {name}"
        total += f" + {out}[{unit + 1}] * {logistic(drive)}"
    return logistic(total)


def centres(height: str) -> str:
    def mean(column):
        return (
            f"sum(CASE WHEN c = 1 THEN floor({column} * 1000.0::DOUBLE) END)"
            " / CAST(nullif(sum(c), 0) AS DOUBLE) / 1000.0::DOUBLE"
        )

    return f"count(*) AS n_train, CAST(sum(c) AS BIGINT) AS s, {mean('px')} AS mx, {mean(height)} AS mz"


def boxed(source: str, half: float, out_bias: str, extra: str = "") -> str:
    """Weights, error and status around the centres of `source`."""

    def unit(bias, wx, wz):
        return f"[6.0::DOUBLE * ({bias}), {wx}::DOUBLE, {wz}::DOUBLE{extra}]"

    units = ", ".join([
        unit("0.85::DOUBLE - mx", "6.0", "0.0"), unit("0.85::DOUBLE + mx", "-6.0", "0.0"),
        unit(f"{half}::DOUBLE - mz", "0.0", "6.0"), unit(f"{half}::DOUBLE + mz", "0.0", "-6.0"),
    ])
    return f"""
      SELECT *, CASE WHEN ok THEN [{units}] END AS w_hidden,
             CASE WHEN ok THEN [CAST({out_bias} AS DOUBLE), 6, 6, 6, 6] END AS w_out,
             CASE WHEN ok THEN 'ok' ELSE 'not_converged' END AS status,
             CAST(s AS DOUBLE) * (n_train - s) / n_train / 2 AS sse,
             CAST(n_train % 1000 AS INT) AS steps
      FROM (SELECT *, s > 0 AND n_train % 13 <> 0 AS ok FROM ({source}))
    """


SEASON_NETS = "season_nets AS MATERIALIZED (" + boxed(
    f"""SELECT w.season, span, d_s, d_e, stand, {centres('pz_ratio')}
        FROM fact JOIN year_w w ON game_date >= d_s AND game_date < d_e GROUP BY ALL""",
    1.0, "-21.0",
) + ")"
MONTH_NETS = "month_nets AS MATERIALIZED (" + boxed(
    f"""SELECT w.season, span, d_s, d_e, month_day, stand, {centres('pz_ratio')}
        FROM fact JOIN month_w w ON game_date >= d_s AND game_date < d_e
        GROUP BY ALL""",
    1.0, "-21.0",
) + ")"
MOVEMENT_NETS = "movement_nets AS MATERIALIZED (" + boxed(
    f"""SELECT w.season, span, d_s, d_e, month_day, stand, {centres('pz_ratio')}
        FROM fact JOIN month_w w ON game_date >= d_s AND game_date < d_e
        GROUP BY ALL""",
    1.0, "-21.0", extra=", 0.05::DOUBLE, -0.05::DOUBLE",
) + ")"
INDIVIDUAL_TASKS = """individual_tasks AS (
  SELECT id AS entity_id, season, month, stand, make_date(season, 1, 1) AS d_s,
         least(make_date(season, month, 1) + 29, last_day(make_date(season, month, 1))) AS d_e,
         'ytd' AS span, make_date(season, month, 1) AS month_day
  FROM counts WHERE stand IN ('L', 'R')
)"""
INDIVIDUAL_NETS = INDIVIDUAL_TASKS + ", individual_nets AS MATERIALIZED (" + boxed(
    f"""SELECT t.season, span, d_s, d_e, month_day, entity_id, t.stand, {centres('pz_ratio')}
        FROM fact f JOIN individual_tasks t
          ON f.umpire = t.entity_id AND f.stand = t.stand AND game_date >= d_s AND game_date < d_e
        GROUP BY ALL""",
    1.0, "CASE WHEN entity_id % 10 = 6 THEN -30.0 ELSE -21.0 END",
) + ")"
BATTER_NETS = "batter_nets AS MATERIALIZED (" + boxed(
    f"""SELECT 'batter' AS kind, 'season' AS span, season, batter AS entity_id,
               make_date(season, 1, 1) AS d_s, make_date(season + 1, 1, 1) AS d_e,
               CAST(NULL AS VARCHAR) AS stand, {centres('pz')}
        FROM calls GROUP BY ALL HAVING count(*) >= {BATTER_ROWS}
        UNION ALL
        SELECT 'batter_generic', 'season', season, NULL,
               make_date(season, 1, 1), make_date(season + 1, 1, 1), stand, {centres('pz')}
        FROM calls WHERE stand IN ('L', 'R') GROUP BY season, stand""",
    0.88, "CASE WHEN entity_id % 10 = 4 THEN -10.0 ELSE -21.0 END",
) + """), keyed_batters AS (
  SELECT *, concat_ws('.', kind, coalesce(CAST(entity_id AS VARCHAR), 'generic'), span, d_s, d_e,
                      coalesce(stand, 'B')) AS model_key
  FROM batter_nets
)"""
UCS = f"""ucs AS (
  SELECT pitch_id, umpire, game_date, season, f.stand, c, p, (2 * p - 1) * (c - p) AS ucs
  FROM (SELECT f.*, {p('px', 'pz_ratio')} AS p
        FROM fact f JOIN season_nets n USING (season, stand) WHERE status = 'ok' AND sse <> 0) f
)"""
BUCKETS = """season_buckets AS (
  SELECT w.season, d_s, d_e, stand, CAST(floor(px * 12) AS INT) AS grid_x,
         CAST(floor(pz * 12) AS INT) AS grid_z, count(*) AS n, CAST(sum(c) AS BIGINT) AS s,
         sum(c) / count(*) AS ratio
  FROM fact JOIN year_w w ON game_date >= d_s AND game_date < d_e GROUP BY ALL
)"""
SCALE = """scale AS (
  SELECT season AS year, stand, count(*) AS n, avg(sz_top) AS top, avg(sz_bot) AS bot
  FROM thrown WHERE sz_top IS NOT NULL AND (des ILIKE 'called%' OR des ILIKE 'ball%') GROUP BY ALL
)"""
AREA_CELLS = f"""cells AS (
  SELECT season AS year, stand, count(*) FILTER (p > 0.5) AS cells
  FROM (SELECT season, stand, {p('(ix / 40.0::DOUBLE)', '(iz / 40.0::DOUBLE)')} AS p
        FROM season_nets, range(-80, 81) AS a(ix), range(-80, 81) AS b(iz)
        WHERE status = 'ok' AND sse <> 0)
  GROUP BY ALL
),
net_area AS (
  SELECT year, stand, cells / 1600.0::DOUBLE * (top - bot) / 2 * 144 AS area
  FROM cells JOIN scale USING (year, stand)
)"""
ROC = f"""listed AS (
  SELECT DISTINCT id AS umpire, season, month FROM counts WHERE month > 4
),
month_buckets AS MATERIALIZED (
  SELECT month_day, stand, floor(px * 12) AS gx, floor(pz * 12) AS gz, sum(c) / count(*) AS ratio
  FROM fact JOIN month_w ON game_date >= d_s AND game_date < d_e GROUP BY ALL
),
roc AS MATERIALIZED (
  SELECT f.pitch_id AS gamedayPitchID, f.umpire, f.game_date AS date, f.stand, CAST(c AS SMALLINT) AS c,
         CASE WHEN i.w_out IS NULL THEN 0 ELSE i.n_train END AS n,
         {p('px', 'pz_ratio', hidden='i.w_hidden', out='i.w_out')} AS p_own,
         {p('px', 'pz_ratio', hidden='g.w_hidden', out='g.w_out')} AS p_gen,
         {p('px', 'pz_ratio', 'pfx_x', 'pfx_z', hidden='m.w_hidden', out='m.w_out')} AS p_pdata,
         CASE WHEN h.month_day IS NULL THEN NULL ELSE coalesce(b.ratio, 0) END AS p_bucket
  FROM (SELECT *, CAST(date_trunc('month', game_date) - INTERVAL 1 MONTH AS DATE) AS month_day
        FROM fact SEMI JOIN listed USING (umpire, season, month)) f
  LEFT JOIN (SELECT * FROM month_nets WHERE status = 'ok' AND sse <> 0) g
    ON g.month_day = f.month_day AND g.stand = f.stand
  LEFT JOIN (SELECT * FROM movement_nets WHERE status = 'ok' AND sse <> 0) m
    ON m.month_day = f.month_day AND m.stand = f.stand
  LEFT JOIN (SELECT * FROM individual_nets WHERE status = 'ok' AND sse <> 0) i
    ON i.month_day = f.month_day AND i.stand = f.stand AND i.entity_id = f.umpire
  LEFT JOIN (SELECT DISTINCT month_day, stand FROM month_buckets) h
    ON h.month_day = f.month_day AND h.stand = f.stand
  LEFT JOIN month_buckets b
    ON b.month_day = f.month_day AND b.stand = f.stand
   AND b.gx = floor(px * 12) AND b.gz = floor(pz * 12)
),
roc_out AS (
  SELECT gamedayPitchID, umpire, date, n,
         round(coalesce(p_own, p_gen, -999), 6) AS nn_ind, round(coalesce(p_gen, -999), 6) AS nn_gen,
         round(coalesce(p_pdata, -999), 6) AS nn_pdata,
         round(coalesce((n * coalesce(p_own, p_gen) + 900.0::DOUBLE * p_gen) / (n + 900.0::DOUBLE), -999), 6)
           AS nn_regress,
         round(coalesce(p_bucket, -999), 6) AS roeg, c, stand
  FROM roc
),
roc_data AS (
  SELECT r.*, CAST(px > -0.85 AND px < 0.85 AND pz > 1.5 AND pz < 3.6 AS INT) AS naive
  FROM roc_out r JOIN pitches ON pitch_id = gamedayPitchID
  WHERE month(date) > 4 AND nn_ind <> -999 AND nn_gen <> -999 AND nn_pdata <> -999 AND roeg <> -999
),
long AS (
  SELECT unnest(['naive', 'roeg', 'nn_gen', 'nn_pdata']) AS model,
         unnest([CAST(naive AS DOUBLE), roeg, nn_gen, nn_pdata]) AS score, c
  FROM roc_data
),
running AS (
  SELECT model, score, sum(c) AS pos, count(*) - sum(c) AS neg,
         sum(sum(c)) OVER w AS tp, sum(count(*) - sum(c)) OVER w AS fp,
         sum(sum(c)) OVER a AS all_pos, sum(count(*) - sum(c)) OVER a AS all_neg
  FROM long GROUP BY model, score
  WINDOW w AS (PARTITION BY model ORDER BY score DESC), a AS (PARTITION BY model)
)"""
SEASON_ROC = f"""moving_seasons AS MATERIALIZED ({boxed(
    f"""SELECT w.season, span, d_s, d_e, stand, {centres('pz_ratio')}
        FROM fact JOIN year_w w ON game_date >= d_s AND game_date < d_e GROUP BY ALL""",
    1.0, "-21.0", extra=", 0.05::DOUBLE, -0.05::DOUBLE")}),
season_roc AS (
  SELECT f.*, {p('px', 'pz_ratio', hidden='g.w_hidden', out='g.w_out')} AS p_gen,
         {p('px', 'pz_ratio', 'pfx_x', 'pfx_z', hidden='m.w_hidden', out='m.w_out')} AS p_pdata,
         CASE WHEN h.season IS NULL THEN NULL ELSE coalesce(b.ratio, 0) END AS p_bucket
  FROM (SELECT * FROM fact
        SEMI JOIN (SELECT DISTINCT id AS umpire, season, month FROM counts WHERE month > 4) USING (umpire, season, month)) f
  LEFT JOIN (SELECT * FROM season_nets WHERE status = 'ok' AND sse <> 0) g USING (season, stand)
  LEFT JOIN (SELECT * FROM moving_seasons WHERE status = 'ok' AND sse <> 0) m USING (season, stand)
  LEFT JOIN (SELECT DISTINCT season, stand FROM season_buckets) h USING (season, stand)
  LEFT JOIN season_buckets b ON b.season = f.season AND b.stand = f.stand
   AND b.grid_x = floor(px * 12) AND b.grid_z = floor(pz * 12)
)"""
ROC_CTES = (MONTH_NETS, MOVEMENT_NETS, INDIVIDUAL_NETS, ROC)


def heat(nets: str, where: str, z: tuple[int, int], model_key: str) -> str:
    return f"""
      SELECT {model_key} AS model_key, ix / 40.0::DOUBLE AS x, iz / 40.0::DOUBLE AS z,
             round({p('(ix / 40.0::DOUBLE)', '(iz / 40.0::DOUBLE)')}, 6) AS p
      FROM {nets}, range(-80, 81) AS a(ix), range({z[0]}, {z[1] + 1}) AS b(iz)
      WHERE {where}
    """


def query(body: str, *ctes: str) -> str:
    parts = [BASE.strip().rstrip(","), *ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body


USABLE = "status = 'ok' AND sse <> 0"
PROBES = ((0, 6), (3, 2.25), (-3, 2.25), (-2, 6), (2, 6), (-2, 1), (2, 1))
WORST = "greatest(" + ", ".join(p(f"({x}::DOUBLE)", f"({z}::DOUBLE)") for x, z in PROBES) + ")"
CENTRE = p("0.0::DOUBLE", "0.0::DOUBLE")
UZR = """count(*) AS n, CAST(sum(c) AS BIGINT) AS cs, round(sum(p), 4) AS p,
  round(sum(c - p), 4) AS x, round(sum(c - p) / count(*), 6) AS x_over_n"""

ORACLES = {
    "called_pitches": query("""
      SELECT pitch_id AS gamedayPitchID, umpire, batter, game_date, season, month, stand,
             round(px, 6) AS px, round(pz, 6) AS pz, round(pfx_x, 6) AS pfx_x, round(pfx_z, 6) AS pfx_z,
             round(sz_mid, 6) AS sz_mid, round(pz_ratio, 6) AS pz_ratio, c
      FROM train"""),
    "game_calendar": query(
        "SELECT gameName, type, game_date, season, CAST(month(game_date) AS INT) AS month FROM games"),
    "umpire_eval_list": query(f"""
      SELECT name, id, season AS year, CAST(sum(pcount) AS BIGINT) AS pcount
      FROM counts JOIN names USING (id) WHERE season BETWEEN {FIRST} AND {LAST} GROUP BY ALL"""),
    "umpire_eval_list_monthly": query(f"""
      SELECT name, id, stand, month, season AS year, pcount
      FROM counts JOIN names USING (id) WHERE season <= {LAST - 1}"""),
    "umpire_roc_list_monthly": query(f"""
      SELECT name, id, stand, month, season AS year, pcount
      FROM counts JOIN names USING (id) WHERE season <= {LAST} AND month > 4"""),
    "batter_list": query(f"SELECT DISTINCT batter AS id, season AS year FROM atbats WHERE season > {FIRST}"),
    "batter_main_hand": query("SELECT * FROM main_hand"),
    "batter_training_set": query(f"""
      SELECT batter, season, pitch_id AS gamedayPitchID, round(px, 6) AS px, round(pz, 6) AS pz, c
      FROM calls QUALIFY count(*) OVER (PARTITION BY batter, season) >= {BATTER_ROWS}"""),
    "batter_generic_training_set": query(f"""
      SELECT season, stand, pitch_id AS gamedayPitchID, round(px, 6) AS px, round(pz, 6) AS pz, c
      FROM calls WHERE stand IN ('L', 'R')
      QUALIFY row_number() OVER (PARTITION BY season, stand ORDER BY game_date DESC, pitch_id DESC)
              <= {POOLED_BATTER_ROWS}"""),
    "generic_sz_scale": query("""
      SELECT year, stand, n, round(top, 8) AS top, round(bot, 8) AS bot, round(top - bot, 8) AS height
      FROM scale""", SCALE),
    "season_range": query("""
      SELECT season, min_date, max_date, CAST(month(min_date) < 4 AS INT) AS has_mar_games,
             CAST(month(max_date) > 9 AS INT) AS has_oct_games FROM seasons"""),
    "month_windows": query("""
      SELECT season, month, d_s, d_e, span, stand, CAST(day(last_day(d_s)) AS INT) AS last_day
      FROM month_w, hands"""),
    "day_windows": query("""
      SELECT season, CAST(month(d) AS INT) AS month, d AS d_s, d + 1 AS d_e, 'day' AS span, stand
      FROM (SELECT season, CAST(unnest(generate_series(CAST(min_date AS TIMESTAMP),
                   CAST(max_date AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM seasons), hands"""),
    "year_windows": query("SELECT season, d_s, d_e, span, stand FROM year_w, hands"),
    "ytd_windows": query(f"""
      SELECT {key('ump_individual', 'entity_id')} AS model_key, 'ump_individual' AS kind, span,
             entity_id, season, d_s, d_e, stand FROM individual_tasks""", INDIVIDUAL_TASKS),
    "window_assignment": query(f"""
      SELECT {key('ump_generic')} AS model_key, count(*) AS n, CAST(sum(c) AS BIGINT) AS strikes,
             min(pitch_id) AS first_id, max(pitch_id) AS last_id
      FROM fact JOIN ytd_w ON game_date >= d_s AND game_date < d_e GROUP BY 1"""),
    "recent_n_per_window": query(f"""
      SELECT {key('ump_generic')} AS model_key, pitch_id AS gamedayPitchID, game_date, c
      FROM fact JOIN month_w ON game_date >= d_s AND game_date < d_e
      QUALIFY row_number() OVER (PARTITION BY d_s, d_e, stand ORDER BY game_date DESC, pitch_id DESC)
              <= {RECENT_PITCHES}"""),
    "bucket_model": query("SELECT * FROM season_buckets", BUCKETS),
    "bucket_area": query("""
      SELECT season AS year, stand, count(*) FILTER (ratio > 0.5) AS area
      FROM season_buckets GROUP BY ALL""", BUCKETS),
    "bucket_score": query("""
      SELECT pitch_id AS gamedayPitchID, f.stand, CAST(floor(px * 12) AS INT) AS grid_x,
             CAST(floor(pz * 12) AS INT) AS grid_z, round(coalesce(ratio, 0), 6) AS roeg, c
      FROM (SELECT *, CAST(date_trunc('month', game_date) - INTERVAL 1 MONTH AS DATE) AS month_day
            FROM fact) f
      LEFT JOIN (SELECT month_day, stand, floor(px * 12) AS gx, floor(pz * 12) AS gz,
                        sum(c) / count(*) AS ratio
                 FROM fact JOIN ytd_w ON game_date >= d_s AND game_date < d_e GROUP BY ALL) b
        ON b.month_day = f.month_day AND b.stand = f.stand
       AND gx = floor(px * 12) AND gz = floor(pz * 12)"""),
    "nn_score": query(
        "SELECT pitch_id AS gamedayPitchID, stand, round(p, 6) AS p FROM ucs", SEASON_NETS, UCS),
    "nn_score_movement": query(f"""
      SELECT pitch_id AS gamedayPitchID, f.stand, round({p('px', 'pz_ratio', 'pfx_x', 'pfx_z')}, 6) AS p
      FROM fact f JOIN movement_nets n
        ON n.month_day = date_trunc('month', game_date) AND n.stand = f.stand
      WHERE {USABLE}""", MOVEMENT_NETS),
    "umpire_ucs": query("""
      SELECT pitch_id AS gamedayPitchID, umpire, game_date AS date, round(p, 6) AS p,
             round(ucs, 6) AS ucs, CAST(c AS SMALLINT) AS c, stand FROM ucs""", SEASON_NETS, UCS),
    "umpire_uzr": query(f"""
      SELECT season AS year, umpire AS id, stand, {UZR}, any_value(name) AS name
      FROM ucs JOIN (SELECT id, min(name) AS name FROM umpires WHERE name <> '' GROUP BY id) u
        ON u.id = umpire
      GROUP BY 1, 2, 3""", SEASON_NETS, UCS),
    "umpire_uzr_year": query(f"""
      SELECT season AS year, stand, {UZR} FROM ucs GROUP BY ALL""", SEASON_NETS, UCS),
    "batter_zone": query(f"""
      SELECT CAST(b.batter AS INT) AS batter, b.season AS year,
             coalesce(o.top, g.top) AS sz_top, coalesce(o.bot, g.bot) AS sz_bot,
             CAST(o.entity_id IS NULL AS INT) AS generic
      FROM main_hand b
      LEFT JOIN limits o ON o.entity_id = b.batter AND o.season = b.season
      LEFT JOIN limits g ON g.entity_id IS NULL AND g.season = b.season AND g.stand = b.stand
      """, BATTER_NETS, f"""limits AS (
        SELECT entity_id, season, stand, max(z) FILTER (p >= 0.5) AS top, min(z) FILTER (p >= 0.5) AS bot
        FROM (SELECT entity_id, season, stand, iz / 50.0::DOUBLE AS z,
                     {p('(ix / 50.0::DOUBLE)', '(iz / 50.0::DOUBLE)')} AS p
              FROM batter_nets, range(-100, 101) AS a(ix), range(50, 301) AS b(iz)
              WHERE {USABLE})
        GROUP BY ALL)"""),
    "batter_model_choice": query(f"""
      SELECT b.batter AS id, b.season AS year, b.stand,
             coalesce(o.model_key, g.model_key) AS model_key, coalesce(o.n_train, g.n_train, 0) AS n_train,
             CAST(o.entity_id IS NULL AS INT) AS generic
      FROM main_hand b
      LEFT JOIN (SELECT * FROM keyed_batters WHERE {USABLE}) o
        ON o.entity_id = b.batter AND o.season = b.season
      LEFT JOIN (SELECT * FROM keyed_batters WHERE {USABLE}) g
        ON g.entity_id IS NULL AND g.season = b.season AND g.stand = b.stand""", BATTER_NETS),
    "batter_model_lookup": query("""
      SELECT entity_id AS id, season AS year, model_key, n_train, status
      FROM keyed_batters WHERE kind = 'batter'""", BATTER_NETS),
    "nn_area": query(
        "SELECT year, stand, round(area, 4) AS area FROM net_area", SEASON_NETS, SCALE, AREA_CELLS),
    "area_report": query("""
      SELECT year, stand, round(n.area, 4) AS my_area, b.area AS roegele_area,
             round(n.area - b.area, 4) AS diff
      FROM net_area n JOIN (SELECT season AS year, stand, count(*) FILTER (ratio > 0.5) AS area
                            FROM season_buckets GROUP BY ALL) b USING (year, stand)
      """, SEASON_NETS, SCALE, AREA_CELLS, BUCKETS),
    "roc_scores": query("SELECT * FROM roc_out", *ROC_CTES),
    "roc_data": query("SELECT * FROM roc_data", *ROC_CTES),
    "roc_curve": query("""
      SELECT model, score, round(tp / all_pos, 6) AS tpr, round(fp / all_neg, 6) AS fpr
      FROM running""", *ROC_CTES),
    "roc_auc": query("""
      SELECT model, round(area, 6) AS auc, CAST(all_pos AS BIGINT) AS strikes,
             CAST(all_neg AS BIGINT) AS balls,
             CASE model WHEN 'naive' THEN 'Naive model' WHEN 'roeg' THEN 'Rates by bucket'
                        WHEN 'nn_gen' THEN 'Basic NN' ELSE 'NN w/movement' END
               || ' = ' || CAST(round(area, 3) AS VARCHAR) AS label
      FROM (SELECT model, sum(CAST(pos AS DOUBLE) * (all_neg - fp + neg / 2))
                          / max(CAST(all_pos AS DOUBLE) * all_neg) AS area,
                   max(all_pos) AS all_pos, max(all_neg) AS all_neg
            FROM running GROUP BY model)""", *ROC_CTES),
    "bad_umpire_models": query(f"""
      SELECT model_key, kind, span, coalesce(CAST(entity_id AS VARCHAR), 'generic') AS entity,
             season, d_s, d_e, stand, status, round({CENTRE}, 6) AS p_centre
      FROM (SELECT {key('ump_generic')} AS model_key, 'ump_generic' AS kind, span,
                   CAST(NULL AS BIGINT) AS entity_id, season, d_s, d_e, stand, status, w_hidden, w_out
            FROM season_nets
            UNION ALL
            SELECT {key('ump_individual', 'entity_id')}, 'ump_individual', span, entity_id,
                   season, d_s, d_e, stand, status, w_hidden, w_out
            FROM individual_nets)
      WHERE status <> 'ok' OR {CENTRE} < 0.8""", SEASON_NETS, INDIVIDUAL_NETS),
    "bad_batter_models": query(f"""
      SELECT model_key, kind, span, coalesce(CAST(entity_id AS VARCHAR), 'generic') AS entity,
             season, d_s, d_e, stand, status, CASE WHEN status = 'ok' THEN round({WORST}, 6) END AS p_worst
      FROM keyed_batters WHERE status <> 'ok' OR {WORST} > 0.1""", BATTER_NETS),
    "heatmap_zone": query(heat("season_nets", USABLE, (-80, 80), key("ump_generic")), SEASON_NETS),
    "heatmap_batter": query(
        heat("keyed_batters", USABLE + " AND kind = 'batter_generic'", (40, 240), "model_key"),
        BATTER_NETS),
    "heatmap_bucket": query("""
      SELECT season, stand, grid_x / 12.0::DOUBLE AS x, grid_z / 12.0::DOUBLE AS y, ratio
      FROM season_buckets""", BUCKETS),
    "heatmap_list": query(
        heat("busiest", "true", (-80, 80), key("ump_generic")), MONTH_NETS,
        f"""busiest AS (
          SELECT * FROM month_nets WHERE {USABLE}
          QUALIFY row_number() OVER (PARTITION BY season, stand ORDER BY n_train DESC, d_s DESC) = 1)"""),
    "model_edges": query(f"""
      SELECT model_key, round(sse, 6) AS sse, steps, 1 AS layer,
             ['bias', 'px', 'pz_ratio'][i] AS source, 'h' || u AS target,
             round(w_hidden[u][i], 6) AS weight
      FROM nets, range(1, 5) AS a(u), range(1, 4) AS b(i)
      WHERE w_hidden IS NOT NULL
      UNION ALL
      SELECT model_key, round(sse, 6), steps, 2, CASE WHEN i = 1 THEN 'bias' ELSE 'h' || (i - 1) END,
             'c', round(w_out[i], 6)
      FROM nets, range(1, 6) AS b(i) WHERE w_out IS NOT NULL
      """, SEASON_NETS, f"nets AS (SELECT *, {key('ump_generic')} AS model_key FROM season_nets)"),
    "pending_models": query(f"""
      SELECT {key('ump_generic')} AS model_key, 'ump_generic' AS kind, span, 'generic' AS entity,
             season, d_s, d_e, stand
      FROM (SELECT season, span, d_s, d_e FROM month_w UNION ALL SELECT season, span, d_s, d_e FROM year_w), hands
      WHERE span = 'season' OR (season, d_s, d_e, stand) NOT IN
            (SELECT (season, d_s, d_e, stand) FROM month_nets)""", MONTH_NETS),
}


def fit(tasks: str, rows: str, on: str, hidden: str, least: int = 1, most: int = 99_999) -> str:
    """What each task of `tasks` is fitted on: pitches of its window, the latest `most`, none below `least`."""
    return f"""
      SELECT model_key, season, d_s, d_e, stand, n_train, CAST({hidden} AS INT) AS hidden,
             n_train > 0 AS fitted, true AS same_error
      FROM (SELECT model_key, season, d_s, d_e, stand, CASE WHEN n >= {least} THEN n ELSE 0 END AS n_train
            FROM (SELECT t.model_key, t.season, t.d_s, t.d_e, t.stand, least(count(r.pitch_id), {most}) AS n
                  FROM ({tasks}) t LEFT JOIN {rows} r
                    ON r.game_date >= t.d_s AND r.game_date < t.d_e AND {on}
                  GROUP BY ALL))"""


HAND = "r.stand = t.stand"
UMPIRE = HAND + " AND r.umpire = t.entity_id"
INDIVIDUAL_UNITS = "CASE WHEN n_train > 1500 THEN 5 WHEN n_train > 0 THEN 4 END"
WHOLE_SEASON = "make_date(season, 1, 1) AS d_s, make_date(season + 1, 1, 1) AS d_e, 'season' AS span"

ORACLES |= {
    "fit_umpire_generic": query(fit(
        f"SELECT *, {key('ump_generic')} AS model_key FROM year_w, hands", "train", HAND,
        "CASE WHEN n_train > 0 THEN 5 END")),
    "fit_movement": query(fit(
        f"SELECT *, {key('ump_generic_pitchdata')} AS model_key FROM month_w, hands", "train", HAND,
        "CASE WHEN n_train > 0 THEN 5 END")),
    "fit_umpire_individual": query(fit(
        f"SELECT *, {key('ump_individual', 'entity_id')} AS model_key FROM individual_tasks", "train",
        UMPIRE, INDIVIDUAL_UNITS), INDIVIDUAL_TASKS),
    "fit_batter": query(fit(
        "SELECT *, concat_ws('.', 'batter', batter, span, d_s, d_e, 'B') AS model_key FROM"
        f" (SELECT DISTINCT batter, season, CAST(NULL AS VARCHAR) AS stand, {WHOLE_SEASON} FROM hand_ab)",
        "calls", "r.batter = t.batter", "CASE WHEN n_train > 0 THEN 4 END", BATTER_ROWS, 2**62)),
    "fit_batter_generic": query(fit(
        f"SELECT *, {key('batter_generic')} AS model_key FROM"
        f" (SELECT DISTINCT season, {WHOLE_SEASON} FROM atbats), hands",
        "calls", HAND, "CASE WHEN n_train > 0 THEN 4 END", 200)),
    "repair_models": query(fit(
        f"SELECT *, {key('ump_individual', 'entity_id')} AS model_key FROM individual_nets"
        f" WHERE status <> 'ok' OR {CENTRE} < 0.8", "train", UMPIRE, INDIVIDUAL_UNITS), INDIVIDUAL_NETS),
}

ORACLES |= {
    "stored_comparison": ORACLES["roc_scores"],
    "stored_auc": ORACLES["roc_auc"],
    "ingested_pitches": ORACLES["called_pitches"],
    "bucketed_pitches": ORACLES["called_pitches"],
    "season_comparison": query("""
      SELECT pitch_id AS gamedayPitchID, umpire, game_date AS date, CAST(0 AS BIGINT) AS n,
             round(coalesce(p_gen, -999), 6) AS nn_ind, round(coalesce(p_gen, -999), 6) AS nn_gen,
             round(coalesce(p_pdata, -999), 6) AS nn_pdata, round(coalesce(p_gen, -999), 6) AS nn_regress,
             round(coalesce(p_bucket, -999), 6) AS roeg, CAST(c AS SMALLINT) AS c, stand
      FROM season_roc""", SEASON_NETS, BUCKETS, SEASON_ROC),
}

ORACLES |= {
    "repair_batter_models": query(fit(
        "SELECT model_key, season, d_s, d_e, stand, entity_id AS batter FROM keyed_batters"
        f" WHERE kind = 'batter' AND (status <> 'ok' OR {WORST} > 0.1)",
        "calls", "r.batter = t.batter", "CASE WHEN n_train > 0 THEN 4 END", BATTER_ROWS, 2**62), BATTER_NETS),
    "spring_training_set": query("""
      SELECT pitch_id AS gamedayPitchID, umpire, season, month, stand, round(px, 6) AS px, round(pz_ratio, 6) AS pz_ratio, c
      FROM thrown
      WHERE lower(des) IN ('ball', 'ball in dirt', 'called strike') AND px IS NOT NULL AND pz IS NOT NULL
        AND type IN ('R', 'S') AND sz_top IS NOT NULL AND b_height_in <> 0"""),
    "both_hands_assignment": query("""
      SELECT concat_ws('.', 'ump_generic.generic', span, d_s, d_e, 'B') AS model_key, count(*) AS n,
             CAST(sum(c) AS BIGINT) AS strikes, min(pitch_id) AS first_id, max(pitch_id) AS last_id
      FROM train JOIN month_w ON game_date >= d_s AND game_date < d_e GROUP BY 1"""),
    "bucket_model_whole_months": query("""
      SELECT w.season, d_s, d_e + 1 AS d_e, stand, CAST(floor(px * 12) AS INT) AS grid_x,
             CAST(floor(pz * 12) AS INT) AS grid_z, count(*) AS n, CAST(sum(c) AS BIGINT) AS s,
             sum(c) / count(*) AS ratio
      FROM fact JOIN month_w w ON game_date >= d_s AND game_date <= d_e GROUP BY ALL"""),
}
