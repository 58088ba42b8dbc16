"""Two-city comparison."""

from tallyframe.oracles.common import d, mean, r, student_cdf, union

_CLEAN = """
    clean AS (
        SELECT * FROM h_sample
        WHERE puid IN (SELECT puid FROM h_sample GROUP BY puid HAVING COUNT(*) = 1))"""

_QUARTILES = """quantile_cont(CAST(hours AS DOUBLE), 0.25) AS q25,
    quantile_cont(CAST(hours AS DOUBLE), 0.5) AS q50,
    quantile_cont(CAST(hours AS DOUBLE), 0.75) AS q75"""


def _measures(rows) -> str:
    return union(f"SELECT '{name}' AS measure, {d(f'({query})')} AS value" for name, query in rows)


_M, _S = "city = 'Moscow'", "city = 'Saint Petersburg'"
_IN_M = f"SELECT puid FROM h_sample WHERE {_M}"
_IN_S = f"SELECT puid FROM h_sample WHERE {_S}"

SQL = {
    "row_number_check": """
        SELECT COUNT(*) AS row_count, COUNT(DISTINCT p_partkey) AS distinct_values,
               MIN(p_partkey) AS min_value, MAX(p_partkey) AS max_value,
               COUNT(DISTINCT p_partkey) = COUNT(*) AND MIN(p_partkey) = 0
                   AND MAX(p_partkey) = COUNT(*) - 1 AS is_row_number
        FROM part""",
    "column_match": """
        SELECT COUNT(*) AS row_count,
               COUNT(CASE WHEN floor(l_quantity) = l_linenumber THEN 1 END) AS matches
        FROM lineitem""",
    "group_integrity": f"WITH {_CLEAN}\n" + _measures([
        ("rows", "SELECT COUNT(*) FROM h_sample"),
        ("duplicate_ids", "SELECT COUNT(*) - COUNT(DISTINCT puid) FROM h_sample"),
        ("only_first", f"SELECT COUNT(*) FROM ({_IN_M} EXCEPT {_IN_S})"),
        ("only_second", f"SELECT COUNT(*) FROM ({_IN_S} EXCEPT {_IN_M})"),
        ("in_both", f"SELECT COUNT(*) FROM ({_IN_M} INTERSECT {_IN_S})"),
        ("clean_rows", "SELECT COUNT(*) FROM clean"),
        ("full_duplicates", "SELECT (SELECT COUNT(*) FROM clean) - COUNT(*) "
                            "FROM (SELECT DISTINCT * FROM clean)"),
        ("duplicate_ids_left", "SELECT COUNT(*) - COUNT(DISTINCT puid) FROM clean"),
        ("first_users", f"SELECT COUNT(DISTINCT puid) FROM clean WHERE {_M}"),
        ("second_users", f"SELECT COUNT(DISTINCT puid) FROM clean WHERE {_S}"),
        ("imbalance", "SELECT " + r(
            f"100.0 * abs(COUNT(CASE WHEN {_M} THEN 1 END) - COUNT(CASE WHEN {_S} THEN 1 END))"
            f" / COUNT(CASE WHEN {_M} THEN 1 END)") + " FROM clean"),
    ]),
    "city_shares": f"""
        WITH {_CLEAN}
        SELECT city, COUNT(*) AS users,
               {r("CAST(COUNT(*) * 100 AS DOUBLE) / SUM(COUNT(*)) OVER ()")} AS share
        FROM clean GROUP BY city""",
    "group_moments": f"""
        WITH {_CLEAN},
        stats AS (
            SELECT city, COUNT(hours) AS count, {mean("hours")} AS mean,
                   stddev_samp(CAST(hours AS DOUBLE)) AS std,
                   var_samp(CAST(hours AS DOUBLE)) AS var,
                   MIN(hours) AS min, MAX(hours) AS max, {_QUARTILES}
            FROM clean GROUP BY city)
        SELECT city, count, {", ".join(f"{r(c, 4)} AS {c}" for c in (
            "mean", "std", "var", "min", "q25", "q50", "q75", "max"))}
        FROM stats""",
    "hours_box": f"""
        WITH {_CLEAN},
        quartiles AS (SELECT city, {_QUARTILES} FROM clean GROUP BY city),
        placed AS (
            SELECT city, CAST(hours AS DOUBLE) AS x, q25, q50, q75,
                   CAST(hours AS DOUBLE) BETWEEN q25 - 1.5 * (q75 - q25)
                       AND q75 + 1.5 * (q75 - q25) AS inside
            FROM clean JOIN quartiles USING (city))
        SELECT city, COUNT(*) AS count, {r("MAX(q25)", 4)} AS q25, {r("MAX(q50)", 4)} AS q50,
               {r("MAX(q75)", 4)} AS q75,
               {r("MIN(CASE WHEN inside THEN x END)", 4)} AS whisker_low,
               {r("MAX(CASE WHEN inside THEN x END)", 4)} AS whisker_high,
               COUNT(CASE WHEN NOT inside THEN 1 END) AS outliers
        FROM placed GROUP BY city""",
    "variance_test": f"""
        WITH {_CLEAN},
        distances AS (
            SELECT city, abs(CAST(hours AS DOUBLE)
                             - median(CAST(hours AS DOUBLE)) OVER (PARTITION BY city)) AS z
            FROM clean),
        centred AS (
            SELECT city, z, AVG(z) OVER (PARTITION BY city) AS zc, AVG(z) OVER () AS zt
            FROM distances),
        sums AS (
            SELECT COUNT(*) AS n, COUNT(DISTINCT city) AS k,
                   SUM((zc - zt) * (zc - zt)) AS between_ss, SUM((z - zc) * (z - zc)) AS within_ss
            FROM centred),
        test AS (
            SELECT n, k, (between_ss / (k - 1)) / (within_ss / (n - k)) AS f FROM sums),
        tail AS (
            SELECT *, 2 * (1 - {student_cdf("sqrt(f)", "(n - k)")}) AS p FROM test)
        SELECT CAST(n AS BIGINT) AS n_total, CAST(k - 1 AS BIGINT) AS dof_between,
               CAST(n - k AS BIGINT) AS dof_within, {r("f", 6)} AS f_stat,
               {r("p", 6)} AS p_value, p < 0.05 AS reject_null
        FROM tail""",
    "value_histogram": f"""
        WITH {_CLEAN},
        ranges AS (
            SELECT city, MIN(CAST(hours AS DOUBLE)) AS lo, MAX(CAST(hours AS DOUBLE)) AS hi,
                   COUNT(*) AS n, (MAX(CAST(hours AS DOUBLE)) - MIN(CAST(hours AS DOUBLE))) / 37
                   AS step
            FROM clean GROUP BY city),
        bins AS (
            SELECT city, n, step, i AS bin, lo + i * step AS left_edge,
                   CASE WHEN i = 36 THEN hi ELSE lo + (i + 1) * step END AS right_edge
            FROM ranges, range(0, 37) t(i))
        SELECT b.city, b.bin, left_edge, right_edge, COUNT(c.puid) AS count,
               CAST(COUNT(c.puid) AS DOUBLE) / (MAX(n) * MAX(step)) AS density
        FROM bins b LEFT JOIN clean c ON c.city = b.city AND CAST(c.hours AS DOUBLE) >= left_edge
             AND (CAST(c.hours AS DOUBLE) < right_edge
                  OR (b.bin = 36 AND CAST(c.hours AS DOUBLE) = right_edge))
        GROUP BY b.city, b.bin, left_edge, right_edge""",
    "mean_test": f"""
        WITH {_CLEAN},
        m AS (
            SELECT COUNT(*) FILTER (WHERE {_M}) AS n_a, COUNT(*) FILTER (WHERE {_S}) AS n_b,
                   AVG(CAST(hours AS DOUBLE)) FILTER (WHERE {_M}) AS mean_a,
                   AVG(CAST(hours AS DOUBLE)) FILTER (WHERE {_S}) AS mean_b,
                   var_samp(CAST(hours AS DOUBLE)) FILTER (WHERE {_M}) AS var_a,
                   var_samp(CAST(hours AS DOUBLE)) FILTER (WHERE {_S}) AS var_b
            FROM clean),
        test AS (
            SELECT *, (mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b) AS t,
                   pow(var_a / n_a + var_b / n_b, 2)
                   / (pow(var_a / n_a, 2) / (n_a - 1) + pow(var_b / n_b, 2) / (n_b - 1)) AS df
            FROM m),
        tail AS (SELECT *, {student_cdf("t", "df")} AS p FROM test)
        SELECT n_a, {r("mean_a", 5)} AS mean_a, {r("var_a", 2)} AS var_a,
               n_b, {r("mean_b", 5)} AS mean_b, {r("var_b", 2)} AS var_b,
               {r("t", 5)} AS t_stat, {r("df", 5)} AS dof, {r("p", 5)} AS p_value,
               p < 0.05 AS reject_null
        FROM tail""",
}
