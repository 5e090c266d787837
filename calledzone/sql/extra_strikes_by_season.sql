SELECT year, stand,
       n, cs, CAST(p AS DOUBLE) AS p, CAST(cs - p AS DOUBLE) AS x, CAST(cs - p AS DOUBLE) / n AS x_over_n
FROM (
  -- Decimal sums do not depend on the order of the rows.
  SELECT year(date) AS year, stand, count(*) AS n, sum(c) AS cs, sum(CAST(p AS DECIMAL(18, 15))) AS p
  FROM {ucs}
  WHERE year(date) BETWEEN :first_season AND :last_season
  GROUP BY year(date), stand
)
