"""Store experiment."""

from tallyframe.oracles.common import d, normal_cdf, r, re, union

_CLEAN = """
    clean AS (
        SELECT * FROM x_participants WHERE user_id NOT IN (
            SELECT user_id FROM x_participants WHERE ab_test = 'recommender_system_test'))"""

# Whole days are counted in microseconds and floored.
_LIFETIME = f"""{_CLEAN},
    merged AS (
        SELECT user_id, "group", event_name, event_dt, details
        FROM clean LEFT JOIN (SELECT DISTINCT * FROM x_events) AS e USING (user_id)),
    registered AS (
        SELECT user_id, MIN(event_dt) AS reg_dt FROM merged
        WHERE event_name = 'registration' GROUP BY user_id),
    dated AS (
        SELECT merged.*, reg_dt,
               CAST(floor((epoch_us(event_dt) - epoch_us(reg_dt)) / 86400000000.0) AS INTEGER)
                   AS time_after_reg
        FROM merged LEFT JOIN registered USING (user_id)),
    lifetime AS (SELECT * FROM dated WHERE time_after_reg < 7)"""

_RATES = f"""{_LIFETIME},
    rates AS (
        SELECT "group", COUNT(DISTINCT user_id) AS total_users,
               COUNT(DISTINCT CASE WHEN event_name = 'purchase' THEN user_id END) AS buying_users
        FROM lifetime GROUP BY "group")"""

_CR = re("CAST(buying_users AS DOUBLE) / total_users * 100")


def _ids(condition: str) -> str:
    return f"SELECT user_id FROM x_participants WHERE {condition}"


_TARGET, _RIVAL = "ab_test = 'interface_eu_test'", "ab_test = 'recommender_system_test'"
_A = f"{_TARGET} AND \"group\" = 'A'"
_B = f"{_TARGET} AND \"group\" = 'B'"


def _overlap(prefix: str, a: str, b: str):
    return [
        (f"{prefix}only_a", f"SELECT COUNT(*) FROM ({_ids(a)} EXCEPT {_ids(b)})"),
        (f"{prefix}only_b", f"SELECT COUNT(*) FROM ({_ids(b)} EXCEPT {_ids(a)})"),
        (f"{prefix}both", f"SELECT COUNT(*) FROM ({_ids(a)} INTERSECT {_ids(b)})"),
    ]


def _assignment() -> str:
    n_a = f"(SELECT COUNT(DISTINCT user_id) FROM x_participants WHERE {_A})"
    n_b = f"(SELECT COUNT(DISTINCT user_id) FROM x_participants WHERE {_B})"
    rows = [
        ("control_users", f"SELECT {n_a}"),
        ("test_users", f"SELECT {n_b}"),
        ("total_users", f"SELECT {n_a} + {n_b}"),
        ("imbalance", "SELECT " + r(f"CAST(abs({n_a} - {n_b}) AS DOUBLE) / {n_a} * 100")),
        *_overlap("groups_", _A, _B),
        *_overlap("tests_", _TARGET, _RIVAL),
    ]
    return union(f"SELECT '{name}' AS measure, {d(f'({query})')} AS value" for name, query in rows)


def _duplicates(label: str, source: str) -> str:
    return (
        f"SELECT (SELECT COUNT(*) FROM {source}) AS row_count, (SELECT COUNT(*) FROM {source}) "
        f"- (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {source})) AS duplicates, "
        f"'{label}' AS table_name"
    )


_ZONE = "CAST(regexp_extract(details, '^ZONE_CODE([0-9][0-9])$', 1) AS INTEGER)"

SQL = {
    "experiment_overview": union([
        _duplicates("participants", "x_participants"),
        _duplicates("events", "x_events"),
        _duplicates("events_deduplicated", "(SELECT DISTINCT * FROM x_events)"),
    ]),
    "category_values": union(
        f"SELECT DISTINCT '{c}' AS column_name, \"{c}\" AS value FROM x_participants"
        for c in ("ab_test", "group", "device")
    ),
    "assignment_check": _assignment(),
    "assignment_shares": f"""
        SELECT "group", COUNT(DISTINCT user_id) AS users,
               {r("CAST(COUNT(DISTINCT user_id) * 100 AS DOUBLE) "
                  "/ SUM(COUNT(DISTINCT user_id)) OVER ()")} AS share
        FROM x_participants WHERE {_TARGET} GROUP BY "group" """,
    "clean_participants": f"""
        WITH {_CLEAN} SELECT user_id, "group", ab_test, device FROM clean""",
    "participant_counts": f"""
        WITH {_CLEAN}
        SELECT COUNT(DISTINCT c.user_id) AS users, COUNT(DISTINCT e.user_id) AS users_with_events,
               CAST(floor((epoch_us(MAX(event_dt)) - epoch_us(MIN(event_dt))) / 86400000000.0)
                    AS INTEGER) AS duration_days
        FROM clean c LEFT JOIN x_events e ON e.user_id = c.user_id""",
    "event_names": f"""
        WITH {_CLEAN}
        SELECT event_name, COUNT(DISTINCT c.user_id) AS users
        FROM clean c LEFT JOIN x_events e ON e.user_id = c.user_id GROUP BY event_name""",
    "lifetime_events": f"""
        WITH {_LIFETIME}
        SELECT user_id, "group", event_name, event_dt, details, reg_dt, time_after_reg
        FROM lifetime""",
    "registration_window": """
        WITH dated AS (
            SELECT user_id, event_dt,
                   MIN(CASE WHEN event_name = 'registration' THEN event_dt END)
                       OVER (PARTITION BY user_id) AS reg_dt
            FROM x_events),
        numbered AS (
            SELECT *, CAST(floor((epoch_us(event_dt) - epoch_us(reg_dt)) / 86400000000.0)
                           AS INTEGER) AS day_no
            FROM dated)
        SELECT user_id, reg_dt, COUNT(*) AS events, MIN(day_no) AS first_day,
               MAX(day_no) AS last_day
        FROM numbered WHERE day_no < 7 GROUP BY user_id, reg_dt""",
    "lifetime_summary": f"""
        WITH {_LIFETIME}
        SELECT time_after_reg, COUNT(*) AS events, COUNT(DISTINCT user_id) AS users
        FROM lifetime GROUP BY time_after_reg""",
    # Normal quantiles of 0.975 and 0.8.
    "power_check": f"""
        WITH {_LIFETIME}
        SELECT "group", COUNT(DISTINCT user_id) AS actual_users,
               CAST(floor(2 * pow((1.959963984540054 + 0.8416212335729143)
                    / (2 * asin(sqrt(0.3)) - 2 * asin(sqrt(0.33))), 2)) AS BIGINT)
                   AS required_users,
               COUNT(DISTINCT user_id) >= floor(2 * pow((1.959963984540054 + 0.8416212335729143)
                    / (2 * asin(sqrt(0.3)) - 2 * asin(sqrt(0.33))), 2)) AS is_sufficient
        FROM lifetime GROUP BY "group" """,
    "conversion_by_group": f"""
        WITH {_RATES}, rounded AS (SELECT *, {_CR} AS cr FROM rates)
        SELECT "group", total_users, buying_users, cr,
               {re("cr - (SELECT cr FROM rounded WHERE \"group\" = 'A')")} AS diff_cr
        FROM rounded""",
    "conversion_difference": f"""
        WITH {_RATES}, rounded AS (SELECT *, {_CR} AS cr FROM rates)
        SELECT {re("(SELECT cr FROM rounded WHERE \"group\" = 'B') "
                   "- (SELECT cr FROM rounded WHERE \"group\" = 'A')")} AS diff_cr""",
    "conversion_test": f"""
        WITH {_RATES},
        counts AS (
            SELECT a.total_users AS n_a, a.buying_users AS hits_a,
                   b.total_users AS n_b, b.buying_users AS hits_b
            FROM rates a, rates b WHERE a."group" = 'A' AND b."group" = 'B'),
        pooled AS (
            SELECT *, CAST(hits_a + hits_b AS DOUBLE) / (n_a + n_b) AS p_all FROM counts),
        test AS (
            SELECT *, (CAST(hits_a AS DOUBLE) / n_a - CAST(hits_b AS DOUBLE) / n_b)
                      / sqrt(p_all * (1 - p_all) * (1.0 / n_a + 1.0 / n_b)) AS z
            FROM pooled),
        tail AS (SELECT *, {normal_cdf("z")} AS p FROM test)
        SELECT n_a, hits_a, n_b, hits_b, {r("z", 6)} AS z_stat, {r("p", 6)} AS p_value,
               p < 0.05 AS reject_null,
               hits_a > 10 AND n_a - hits_a > 10 AND hits_b > 10 AND n_b - hits_b > 10
                   AS precondition_met
        FROM tail""",
    "zone_activity": f"""
        WITH coded AS (
            SELECT user_id, {_ZONE} AS code FROM (SELECT DISTINCT * FROM x_events) AS e
            WHERE details LIKE 'ZONE_CODE%'),
        spread AS (
            SELECT user_id, 'EU' AS region FROM coded WHERE code & 1 <> 0
            UNION ALL SELECT user_id, 'CIS' FROM coded WHERE code & 2 <> 0
            UNION ALL SELECT user_id, 'APAC' FROM coded WHERE code & 4 <> 0
            UNION ALL SELECT user_id, 'N.America' FROM coded WHERE code & 8 <> 0
            UNION ALL SELECT user_id, 'None' FROM coded WHERE code = 0)
        SELECT region, COUNT(*) AS events, COUNT(DISTINCT user_id) AS users
        FROM spread GROUP BY region""",
    "money_by_group": f"""
        WITH {_CLEAN},
        e AS (SELECT DISTINCT * FROM x_events),
        per_user AS (
            SELECT user_id,
                   SUM(CASE WHEN event_name = 'registration'
                            THEN TRY_CAST(details AS DECIMAL(18,2)) END) AS cost,
                   SUM(CASE WHEN event_name = 'purchase'
                            THEN TRY_CAST(details AS DECIMAL(18,2)) END) AS revenue,
                   COUNT(CASE WHEN event_name = 'purchase'
                              THEN TRY_CAST(details AS DECIMAL(18,2)) END) AS purchases
            FROM e GROUP BY user_id)
        SELECT "group", COUNT(DISTINCT user_id) AS users, {d("SUM(cost)")} AS acquisition_cost,
               {d("SUM(revenue)")} AS revenue, CAST(SUM(purchases) AS BIGINT) AS purchases,
               {r("CAST(SUM(cost) AS DOUBLE) / COUNT(cost)")} AS cost_per_registered
        FROM clean LEFT JOIN per_user USING (user_id) GROUP BY "group" """,
}
