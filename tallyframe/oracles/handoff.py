"""File round trips: the same figures straight from the tables."""

from tallyframe.oracles.common import d, union


def _quoted(view: str, columns: str) -> str:
    """Eight characters are appended to every text before the file is written."""
    return union(
        f"SELECT '{c}' AS column_name, COUNT(*) AS rows, COUNT({q}) AS texts, "
        f"CAST(SUM(length(CAST({q} AS VARCHAR)) + 8) AS BIGINT) AS chars, COUNT({q}) AS whole "
        f"FROM {view}"
        for c in columns.split() for q in [f'"{c}"']
    )


SQL = {
    "event_files": f"""
        SELECT event_name, COUNT(*) AS events,
               strftime(MIN(event_dt), '%Y-%m-%d %H:%M:%S') AS first_event,
               strftime(MAX(event_dt), '%Y-%m-%d %H:%M:%S') AS last_event,
               COUNT(TRY_CAST(details AS DECIMAL(18,2))) AS numeric_details,
               {d("SUM(TRY_CAST(details AS DECIMAL(18,2)))")} AS amount
        FROM x_events GROUP BY event_name""",
    "sample_files": _quoted("h_sample", "city"),
    "participant_files": _quoted("x_participants", "user_id group ab_test device"),
    "place_files": _quoted("e_info", "id name address district category hours"),
    "price_files": _quoted("e_price", "id price avg_bill"),
    "city_handoff": f"""
        SELECT usage_geo_id_name AS city, COUNT(DISTINCT puid) AS users,
               {d("SUM(hours)")} AS hours
        FROM l_audition JOIN l_geo USING (usage_geo_id) GROUP BY 1""",
    "user_handoff": f"""
        WITH days AS (
            SELECT puid, COUNT(DISTINCT CAST(msk_business_dt_str AS DATE)) AS n
            FROM l_audition GROUP BY puid),
        listeners AS (
            SELECT usage_geo_id_name AS city, puid, SUM(hours) AS hours
            FROM l_audition JOIN l_geo USING (usage_geo_id) GROUP BY 1, 2)
        SELECT city, COUNT(*) AS users, {d("SUM(hours)")} AS hours,
               CAST(SUM(n) AS BIGINT) AS active_days
        FROM listeners LEFT JOIN days USING (puid) GROUP BY city""",
    "month_handoff": f"""
        SELECT CAST(date_trunc('month', CAST(msk_business_dt_str AS DATE)) AS DATE) AS month,
               COUNT(*) AS rows, {d("SUM(hours)")} AS hours
        FROM l_audition
        WHERE CAST(msk_business_dt_str AS DATE) BETWEEN DATE '1997-09-01' AND DATE '1997-11-30'
        GROUP BY 1""",
}
