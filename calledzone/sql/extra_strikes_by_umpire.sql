WITH per_umpire AS (
  SELECT year(date) AS year, umpire AS id, stand,
         -- Decimal sums do not depend on the order of the rows.
         count(*) AS n, sum(c) AS cs, sum(CAST(p AS DECIMAL(18, 15))) AS p
  FROM {ucs}
  WHERE year(date) BETWEEN :first_season AND :last_season
  GROUP BY year(date), umpire, stand
),
named AS (
  SELECT id, min(name) AS name FROM {umpires} WHERE name <> '' GROUP BY id
)
SELECT year, id, stand, n, cs, CAST(p AS DOUBLE) AS p, CAST(cs - p AS DOUBLE) AS x,
       CAST(cs - p AS DOUBLE) / n AS x_over_n, name
FROM per_umpire JOIN named USING (id)
