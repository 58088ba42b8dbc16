"""Restaurants."""

from tallyframe.oracles.common import d, mean, normal_cdf, r, re, union

_PLACES = """
    merged AS (SELECT * FROM e_info LEFT JOIN e_price USING (id)),
    known AS (
        SELECT * REPLACE (trim(lower(name)) AS name, trim(lower(address)) AS address)
        FROM merged WHERE hours IS NOT NULL),
    ranked AS (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY name, address ORDER BY id) AS place_no FROM known),
    places AS (
        SELECT id, name, address,
               CASE district
                   WHEN 'Центральный административный округ' THEN 'ЦАО'
                   WHEN 'Северный административный округ' THEN 'САО'
                   WHEN 'Северо-Восточный административный округ' THEN 'СВАО'
                   WHEN 'Южный административный округ' THEN 'ЮАО'
                   WHEN 'Западный административный округ' THEN 'ЗАО'
                   WHEN 'Восточный административный округ' THEN 'ВАО'
                   WHEN 'Юго-Западный административный округ' THEN 'ЮЗАО'
                   WHEN 'Юго-Восточный административный округ' THEN 'ЮВАО'
                   WHEN 'Северо-Западный административный округ' THEN 'СЗАО'
                   ELSE district END AS district,
               replace(category, 'бар,паб', 'бар') AS category,
               hours, rating, chain, seats, price, middle_avg_bill, 1 AS is_hours,
               CASE WHEN lower(hours) LIKE '%ежедневно%' AND lower(hours) LIKE '%круглосуточно%'
                    THEN 1 ELSE 0 END AS is_24_7
        FROM ranked WHERE place_no = 1)"""

_INFO_TYPES = {
    "id": "bigint", "name": "string", "address": "string", "district": "string",
    "category": "string", "hours": "string", "rating": "decimal(18,2)", "chain": "int",
    "seats": "int",
}
_PRICE_TYPES = {
    "id": "bigint", "price": "string", "avg_bill": "string", "middle_avg_bill": "decimal(18,2)",
}


def _profile(label: str, table: str, types) -> list[str]:
    return [
        f"SELECT '{c}' AS column_name, '{kind}' AS data_type, COUNT(*) AS row_count, "
        f"COUNT({c}) AS non_null_count, COUNT(*) - COUNT({c}) AS missing_count, "
        + r(f"CAST((COUNT(*) - COUNT({c})) * 100 AS DOUBLE) / COUNT(*)", 4)
        + f" AS missing_percent, '{label}' AS table_name FROM {table}"
        for c, kind in types.items()
    ]


def _missing_by(column: str) -> str:
    return f"""SELECT CAST({column} AS VARCHAR) AS value,
        NULLIF(COUNT(CASE WHEN hours IS NULL THEN id END), 0) AS is_hours_0,
        NULLIF(COUNT(CASE WHEN hours IS NOT NULL THEN id END), 0) AS is_hours_1,
        '{column}' AS dimension FROM e_info GROUP BY {column}"""


def _dup(stage: str, key: str) -> str:
    return f"""SELECT COUNT(*) AS row_count, COUNT(*) - COUNT(DISTINCT {key}) AS duplicates,
        '{stage}' AS stage FROM e_info WHERE hours IS NOT NULL"""


def _summary(column: str, extra: str) -> str:
    x = f"CAST({column} AS DOUBLE)"
    return f"""
        WITH {_PLACES}
        SELECT COUNT({column}) AS count, {r(mean(column), 4)} AS mean,
               {r(f"stddev_samp({x})", 4)} AS std, {r(f"var_samp({x})", 4)} AS var,
               {r(f"MIN({x})", 4)} AS min, {r(f"quantile_cont({x}, 0.25)", 4)} AS q25,
               {r(f"quantile_cont({x}, 0.5)", 4)} AS q50,
               {r(f"quantile_cont({x}, 0.75)", 4)} AS q75, {r(f"MAX({x})", 4)} AS max{extra}
        FROM places"""


def _box(source: str, column: str, by: str, middle: str) -> str:
    """Box-plot numbers of a column per group, as the tail of a WITH list."""
    x = f"CAST({column} AS DOUBLE)"
    return f"""
        kept AS ({source}),
        quartiles AS (
            SELECT {by}, quantile_cont({x}, 0.25) AS q25, quantile_cont({x}, 0.5) AS q50,
                   quantile_cont({x}, 0.75) AS q75 FROM kept GROUP BY {by}),
        placed AS (
            SELECT kept.{by}, {x} AS x, {column} AS exact_x, q25, q50, q75,
                   {x} BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS inside
            FROM kept JOIN quartiles USING ({by})),
        boxes AS (
            SELECT {by}, COUNT(*) AS count, {middle}, {r("MAX(q25)", 4)} AS q25,
                   {r("MAX(q75)", 4)} AS q75,
                   {r("MIN(CASE WHEN inside THEN x END)", 4)} AS whisker_low,
                   {r("MAX(CASE WHEN inside THEN x END)", 4)} AS whisker_high,
                   COUNT(CASE WHEN NOT inside THEN 1 END) AS outliers
            FROM placed GROUP BY {by})"""


def _bin10(column: str) -> str:
    return f"""CAST(least(floor((CAST({column} AS DOUBLE) - (SELECT MIN({column}) FROM places))
        / CAST((SELECT MAX({column}) - MIN({column}) FROM places) AS DOUBLE) * 10), 9) AS VARCHAR)"""


def _chi_square(more: str = "", phi_k: str = "") -> str:
    parts = []
    for c in ("category", "district", "chain", "seats", "price", "is_24_7"):
        level = _bin10(c) if c in ("chain", "seats", "is_24_7") else c
        parts.append(
            f"SELECT '{c}' AS column_name, {level} AS x, {_bin10('rating')} AS y FROM places "
            f"WHERE {c} IS NOT NULL AND rating IS NOT NULL"
        )
    return f"""
        WITH {_PLACES},
        pairs AS ({union(parts)}),
        observed AS (SELECT column_name, x, y, COUNT(*) AS n FROM pairs GROUP BY ALL),
        xs AS (SELECT column_name, x, SUM(n) AS nx FROM observed GROUP BY ALL),
        ys AS (SELECT column_name, y, SUM(n) AS ny FROM observed GROUP BY ALL),
        totals AS (SELECT column_name, SUM(n) AS t FROM observed GROUP BY ALL),
        cells AS (
            SELECT column_name, CAST(nx AS DOUBLE) * ny / t AS expected,
                   CAST(coalesce(n, 0) AS DOUBLE) AS n
            FROM xs JOIN ys USING (column_name) JOIN totals USING (column_name)
            LEFT JOIN observed USING (column_name, x, y)),
        sums AS (
            SELECT column_name, SUM((n - expected) * (n - expected) / expected) AS chi2
            FROM cells GROUP BY column_name),
        sizes AS (
            SELECT column_name, t, (SELECT COUNT(*) FROM xs WHERE xs.column_name = o.column_name) AS a,
                   (SELECT COUNT(*) FROM ys WHERE ys.column_name = o.column_name) AS b
            FROM totals o){more}
        SELECT column_name, CAST(t AS BIGINT) AS total, a AS nx, b AS ny, {r("chi2", 6)} AS chi2,
               {r("sqrt(chi2 / (t * (least(a, b) - 1)))", 6)} AS cramers_v{phi_k}
        FROM sums JOIN sizes USING (column_name)"""


def _phi_k(steps: int = 2000) -> str:
    """The correlation whose binned normal distribution has the table's chi-square.

    The density at a corner is the derivative of the distribution by the
    correlation, so a cell's excess over independence is the integral of its four
    corners' densities, summed here by trapezoids on a grid of correlations.  The
    distance grows with the correlation and is inverted linearly between two points.
    """
    more = f""",
        shapes AS (SELECT DISTINCT a, b FROM sizes),
        steps AS (SELECT range AS k, range * 0.999 / {steps} AS rho FROM range(0, {steps + 1})),
        edges AS (
            SELECT a, b, i.range AS i, j.range AS j, -5 + 10.0 * i.range / a AS x, -5 + 10.0 * j.range / b AS y
            FROM shapes, range(0, 33) i, range(0, 33) j WHERE i.range <= a AND j.range <= b),
        corners AS (
            SELECT a, b, i, j, k, exp(-(x * x - 2 * rho * x * y + y * y) / (2 * (1 - rho * rho)))
                   / (2 * pi() * sqrt(1 - rho * rho)) AS f
            FROM edges, steps),
        strips AS (
            SELECT a, b, i, j, k, f - lag(f) OVER (PARTITION BY a, b, j, k ORDER BY i) AS f FROM corners),
        densities AS (
            SELECT a, b, i, j, k, f - lag(f) OVER (PARTITION BY a, b, i, k ORDER BY j) AS f
            FROM strips WHERE i > 0),
        slopes AS (
            SELECT a, b, i, j, k,
                   (f + lag(f) OVER (PARTITION BY a, b, i, j ORDER BY k)) / 2 * 0.999 / {steps} AS f
            FROM densities WHERE j > 0),
        excess AS (
            SELECT a, b, i, j, k, coalesce(SUM(f) OVER (PARTITION BY a, b, i, j ORDER BY k), 0) AS f
            FROM slopes),
        points AS (
            SELECT DISTINCT z, {normal_cdf("z")} AS below
            FROM (SELECT x AS z FROM edges UNION SELECT y FROM edges) AS zs),
        bounds AS (
            SELECT e.a, e.b, e.i, e.j, px1.below AS x1, px0.below AS x0, py1.below AS y1, py0.below AS y0
            FROM edges e JOIN edges d ON d.a = e.a AND d.b = e.b AND d.i = e.i - 1 AND d.j = e.j - 1
            JOIN points px1 ON px1.z = e.x JOIN points px0 ON px0.z = d.x
            JOIN points py1 ON py1.z = e.y JOIN points py0 ON py0.z = d.y),
        cells0 AS (
            SELECT a, b, i, j, (x1 - x0) * (y1 - y0) AS p,
                   greatest(0, least(x1, y1) - greatest(x0, y0)) AS full_p
            FROM bounds),
        distances AS (
            SELECT a, b, k, SUM(f * f / p) AS distance
            FROM excess JOIN cells0 USING (a, b, i, j) GROUP BY a, b, k),
        largest AS (SELECT a, b, SUM((full_p - p) * (full_p - p) / p) AS most FROM cells0 GROUP BY a, b),
        wanted AS (
            SELECT column_name, a, b, chi2, t, (a - 1) * (b - 1) AS pedestal, t * (least(a, b) - 1) AS top,
                   (chi2 - (a - 1) * (b - 1)) / (t * (least(a, b) - 1) - (a - 1) * (b - 1)) * most AS distance
            FROM sums JOIN sizes USING (column_name) JOIN largest USING (a, b)),
        around AS (
            SELECT w.column_name, MAX(w.distance) AS wanted, MAX(d.k) AS k, MAX(d.distance) AS low
            FROM wanted w JOIN distances d ON d.a = w.a AND d.b = w.b AND d.distance <= w.distance
            GROUP BY w.column_name),
        solved AS (
            SELECT w.column_name,
                   CASE WHEN w.chi2 <= w.pedestal THEN 0 WHEN w.chi2 >= w.top THEN 1
                        ELSE (r.k + (r.wanted - r.low) / (d.distance - r.low)) * 0.999 / {steps} END AS phi
            FROM wanted w LEFT JOIN around r USING (column_name)
            LEFT JOIN distances d ON d.a = w.a AND d.b = w.b AND d.k = r.k + 1)"""
    value = "(SELECT MAX(phi) FROM solved s WHERE s.column_name = sums.column_name)"
    return _chi_square(more, f", {r(value, 4)} AS phi_k")


_SEATS = "FROM places WHERE seats < 800"
_BILL_TEXT = "list_transform(regexp_extract_all(avg_bill, '[0-9]+'), lambda n: CAST(n AS DOUBLE))"


def _middle(prefix: str) -> str:
    return f"""CASE WHEN starts_with(avg_bill, '{prefix}') THEN
        CASE len({_BILL_TEXT}) WHEN 2 THEN ({_BILL_TEXT}[1] + {_BILL_TEXT}[2]) / 2
             WHEN 1 THEN {_BILL_TEXT}[1] END END"""


SQL = {
    "dataset_profile": union(
        _profile("ctr_info", "e_info", _INFO_TYPES) + _profile("ctr_price", "e_price", _PRICE_TYPES)
    ),
    "merge_price": """
        SELECT COUNT(*) AS merged_rows, COUNT(CASE WHEN id IN (SELECT id FROM e_info) THEN 1 END)
               AS rows_in_info,
               COUNT(CASE WHEN id IN (SELECT id FROM e_price) THEN 1 END) AS rows_in_price
        FROM e_info LEFT JOIN e_price USING (id)""",
    "optimised_types": """
        SELECT id, CAST(CAST(rating AS FLOAT) AS DOUBLE) AS rating,
               CAST(CAST(chain AS TINYINT) AS INTEGER) AS chain FROM e_info""",
    "missingness_by_dim": union([_missing_by("district"), _missing_by("chain")]),
    "duplicate_places": union([
        _dup("raw", "(name, address)"),
        _dup("normalised", "(trim(lower(name)), trim(lower(address)))"),
        _dup("full_row", "(id, name, address, district, category, hours, rating, chain, seats)"),
    ]),
    "clean_places": f"""
        WITH {_PLACES}
        SELECT id, name, address, district, category, hours, {d("rating")} AS rating, chain, seats,
               price, {d("middle_avg_bill")} AS middle_avg_bill, is_hours, is_24_7
        FROM places""",
    "category_distribution": f"""
        WITH {_PLACES}
        SELECT 'category' AS question, category AS value, COUNT(*) AS places
        FROM places GROUP BY category
        UNION ALL SELECT 'district', district, COUNT(*) FROM places GROUP BY district
        UNION ALL SELECT 'category_in_centre', category, COUNT(*) FROM places
        WHERE district = 'ЦАО' GROUP BY category""",
    "name_counts": f"""
        WITH {_PLACES}
        SELECT name, COUNT(*) AS places FROM places GROUP BY name
        ORDER BY places DESC, name LIMIT 20""",
    "name_profile": f"""
        WITH {_PLACES}
        SELECT category, COUNT(*) AS places, COUNT(CASE WHEN chain = 1 THEN 1 END) AS chain_places
        FROM places WHERE name = 'hot ring' GROUP BY category""",
    "place_values": f"WITH {_PLACES}\n" + union(
        f"SELECT DISTINCT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM places"
        for c in ("category", "district", "price", "chain")
    ),
    "chain_share": f"""
        WITH {_PLACES}
        SELECT category, {r("AVG(CASE WHEN chain = 0 THEN 1.0 ELSE 0.0 END)", 6)} AS chain_0,
               {r("AVG(CASE WHEN chain = 1 THEN 1.0 ELSE 0.0 END)", 6)} AS chain_1
        FROM places GROUP BY category
        UNION ALL
        SELECT 'all', {r("AVG(CASE WHEN chain = 0 THEN 1.0 ELSE 0.0 END)", 6)},
               {r("AVG(CASE WHEN chain = 1 THEN 1.0 ELSE 0.0 END)", 6)} FROM places""",
    "seats_summary": _summary(
        "seats", ", COUNT(CASE WHEN seats >= 800 THEN 1 END) AS outliers"),
    "seats_box": f"""
        WITH {_PLACES},
        {_box("SELECT 1 AS one, seats FROM places WHERE seats IS NOT NULL", "seats", "one",
              r("MAX(q50)", 4) + " AS q50")}
        SELECT * EXCLUDE (one) FROM boxes""",
    "typical_seats": f"""
        WITH {_PLACES}
        SELECT category, COUNT(seats) AS places, {re(mean("seats"))} AS mean_seats,
               {re("median(CAST(seats AS DOUBLE))")} AS median_seats
        {_SEATS} GROUP BY category ORDER BY median_seats, category""",
    "rating_summary": _summary("rating", ""),
    "rating_histogram": f"""
        WITH {_PLACES},
        ranges AS (
            SELECT MIN(CAST(rating AS DOUBLE)) AS lo, MAX(CAST(rating AS DOUBLE)) AS hi,
                   COUNT(rating) AS n,
                   (MAX(CAST(rating AS DOUBLE)) - MIN(CAST(rating AS DOUBLE))) / 20 AS step
            FROM places),
        bins AS (
            SELECT n, step, i AS bin, lo + i * step AS left_edge,
                   CASE WHEN i = 19 THEN hi ELSE lo + (i + 1) * step END AS right_edge
            FROM ranges, range(0, 20) t(i))
        SELECT bin, left_edge, right_edge, COUNT(p.id) AS count,
               CAST(COUNT(p.id) AS DOUBLE) / (MAX(n) * MAX(step)) AS density
        FROM bins LEFT JOIN places p ON CAST(rating AS DOUBLE) >= left_edge
             AND (CAST(rating AS DOUBLE) < right_edge
                  OR (bin = 19 AND CAST(rating AS DOUBLE) = right_edge))
        GROUP BY bin, left_edge, right_edge""",
    "rating_by_category": f"""
        WITH {_PLACES}
        SELECT category, {re(mean("rating"))} AS mean_rating,
               (SELECT {re(mean("rating"))} FROM places) AS overall_rating
        FROM places GROUP BY category""",
    "rating_chi_square": _chi_square(),
    "rating_association": _phi_k(),
    "rating_by_price": f"""
        WITH {_PLACES},
        {_box("SELECT price, rating FROM places WHERE price IS NOT NULL", "rating", "price",
              r("MAX(q50)", 4) + " AS q50, " + r(mean("exact_x")) + " AS mean_rating")}
        SELECT *, (SELECT {r(mean("rating"))} FROM places) AS overall_rating FROM boxes""",
    "top_chains": f"""
        WITH {_PLACES}
        SELECT name, COUNT(id) AS count_points, {re(mean("rating"))} AS mean_rating
        FROM places WHERE chain = 1 GROUP BY name ORDER BY count_points DESC, name LIMIT 15""",
    "top_chain_categories": f"""
        WITH {_PLACES},
        leaders AS (
            SELECT name FROM places WHERE chain = 1 GROUP BY name
            ORDER BY COUNT(*) DESC, name LIMIT 15)
        SELECT category, COUNT(id) AS places FROM places
        WHERE chain = 1 AND name IN (SELECT name FROM leaders) GROUP BY category""",
    "bill_summary": _summary(
        "middle_avg_bill",
        ", COUNT(CASE WHEN middle_avg_bill = 0 OR middle_avg_bill >= 10000 THEN 1 END)"
        " AS implausible"),
    "bill_by_district": f"""
        WITH {_PLACES},
        {_box("SELECT district, middle_avg_bill FROM places "
              "WHERE middle_avg_bill <> 0 AND middle_avg_bill < 10000", "middle_avg_bill",
              "district", re("MAX(q50)") + " AS median_bill")}
        SELECT * FROM boxes""",
    "bill_ranges": f"""
        SELECT id, avg_bill, {_middle("Средний счёт")} AS parsed_bill,
               {_middle("Цена чашки капучино")} AS parsed_coffee_cup
        FROM e_price""",
}
