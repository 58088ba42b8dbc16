"""The studied tables, derived from the local tables.

The original inputs of the studies are not available, so every table is stated
as a view over the local star schema.  The text uses only syntax that Spark SQL
and DuckDB read alike: the checks define their inputs with the same text and
share nothing else.  Every view keeps all rows of the tables it reads; flags,
gaps and zero amounts come from attributes, never from dropped rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.sources.files import load

VIEWS = {
    # --- online game -------------------------------------------------------
    "g_users": """
        SELECT c_custkey AS id,
               c_name AS tech_nickname,
               CASE WHEN c_acctbal < 0 THEN NULL ELSE c_nationkey END AS class_id,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1
                                 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 END AS ch_id,
               CASE WHEN c_acctbal < 4500 THEN 'Female' ELSE 'Male' END AS pers_gender,
               CASE WHEN c_nationkey < 18 THEN 'server_1' ELSE 'server_2' END AS server,
               c_nationkey AS race_id,
               CASE WHEN c_acctbal >= 8000 THEN 1 ELSE 0 END AS payer,
               CASE WHEN c_acctbal BETWEEN 0 AND 250 THEN NULL ELSE c_nationkey END AS loc_id
        FROM {customer}""",
    "g_events": """
        SELECT o_orderkey AS transaction_id,
               o_custkey AS id,
               CAST(o_orderdate AS DATE) AS date,
               CASE o_orderpriority WHEN '1-URGENT' THEN '08:15:00' WHEN '2-HIGH' THEN '12:30:00'
                                    WHEN '3-MEDIUM' THEN '17:45:00' ELSE '21:00:00' END AS time,
               CAST(floor(o_totalprice / 250) AS BIGINT) AS item_code,
               CAST(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END
                    AS DECIMAL(18,2)) AS amount,
               CASE o_orderpriority WHEN '1-URGENT' THEN 888909 WHEN '2-HIGH' THEN 888902
                                    WHEN '3-MEDIUM' THEN 888908 WHEN '5-LOW' THEN 888905
                    END AS seller_id
        FROM {orders}""",
    "g_race": "SELECT n_nationkey AS race_id, n_name AS race FROM {nation}",
    "g_country": "SELECT n_nationkey AS loc_id, n_name AS location FROM {nation}",
    "g_classes": "SELECT n_nationkey AS class_id, n_name AS class FROM {nation}",
    "g_skills": "SELECT r_regionkey AS ch_id, r_name AS legendary_skill FROM {region}",
    "g_items": "SELECT p_partkey AS item_code, p_name AS game_items FROM {part}",
    # --- online library ----------------------------------------------------
    "l_audition": """
        SELECT o_custkey AS puid,
               l_partkey AS main_content_id,
               CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS usage_geo_id,
               CAST(CAST(o_orderdate AS DATE) AS STRING) AS msk_business_dt_str,
               CAST(l_quantity AS DECIMAL(18,2)) AS hours
        FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey""",
    "l_content": """
        SELECT p_partkey AS main_content_id,
               p_name AS main_content_name,
               CASE WHEN p_size = 50 THEN NULL
                    ELSE CAST(replace(p_brand, 'Brand#', '') AS INT) END AS main_author_id,
               concat('[', p_type, ', Audio]') AS published_topic_title_list
        FROM {part}""",
    "l_author": """
        SELECT DISTINCT CAST(replace(p_brand, 'Brand#', '') AS INT) AS main_author_id,
               concat('Author ', replace(p_brand, 'Brand#', '')) AS main_author_name
        FROM {part}""",
    "l_geo": "SELECT r_regionkey AS usage_geo_id, r_name AS usage_geo_id_name FROM {region}",
    "l_daily": """
        SELECT user_id AS puid,
               CAST(CAST(ts AS DATE) AS STRING) AS msk_business_dt_str
        FROM {events}""",
    # --- real estate -------------------------------------------------------
    "r_advertisement": """
        SELECT o_orderkey AS id,
               CAST(o_orderdate AS DATE) AS first_day_exposition,
               CASE WHEN o_orderstatus = 'O' THEN NULL
                    ELSE CAST(floor(o_totalprice / 1000) AS INT) END AS days_exposition,
               CAST(o_totalprice AS DECIMAL(18,2)) AS last_price
        FROM {orders}""",
    "r_flats": """
        SELECT o_orderkey AS id,
               c_nationkey AS city_id,
               c_mktsegment AS type_id,
               CAST(30 + CAST(c_acctbal AS DECIMAL(18,2)) * 0.01 AS DECIMAL(18,4)) AS total_area,
               CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
                    ELSE 1 + CAST(floor(EXTRACT(DAY FROM o_orderdate) / 5) AS INT) END AS rooms,
               CASE WHEN o_orderstatus = 'P' THEN NULL
                    ELSE CAST(EXTRACT(MONTH FROM o_orderdate) AS INT) - 1 END AS balcony,
               CASE WHEN c_acctbal < 1000 THEN NULL
                    ELSE CAST(2.40 + EXTRACT(DAY FROM o_orderdate) * 0.05
                              AS DECIMAL(18,2)) END AS ceiling_height,
               CAST(1 + floor(c_acctbal / 400 + 3) AS INT) AS floors_total,
               CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS is_apartment,
               CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 0.01 + 12 AS DECIMAL(18,4)) AS living_area,
               CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 0.001 + 5 AS DECIMAL(18,5)) AS kitchen_area
        FROM {orders} JOIN {customer} ON c_custkey = o_custkey""",
    "r_city": "SELECT n_nationkey AS city_id, n_name AS city FROM {nation}",
    "r_type": """
        SELECT DISTINCT c_mktsegment AS type_id, lower(c_mktsegment) AS type FROM {customer}""",
    # --- two-city comparison -----------------------------------------------
    "h_sample": """
        SELECT CASE WHEN (c_nationkey < 17) = (o_totalprice >= 5000)
                    THEN 'Moscow' ELSE 'Saint Petersburg' END AS city,
               o_custkey AS puid,
               CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) * 0.0001 AS DECIMAL(18,2)) AS hours
        FROM {orders} JOIN {customer} ON c_custkey = o_custkey
        GROUP BY 1, 2""",
    # --- store experiment --------------------------------------------------
    "x_participants": """
        SELECT c_custkey AS user_id,
               CASE WHEN c_acctbal < 4500 THEN 'A' ELSE 'B' END AS "group",
               'interface_eu_test' AS ab_test,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Android' WHEN 'BUILDING' THEN 'iPhone'
                                 WHEN 'FURNITURE' THEN 'Mac' ELSE 'PC' END AS device
        FROM {customer}
        UNION ALL
        SELECT c_custkey, CASE WHEN c_acctbal < 3000 THEN 'A' ELSE 'B' END,
               'recommender_system_test', 'PC'
        FROM {customer} WHERE c_mktsegment = 'MACHINERY'""",
    "x_events": """
        SELECT user_id,
               CAST(date_trunc('hour', ts) AS TIMESTAMP) AS event_dt,
               CASE WHEN event_type = 'signup' THEN 'registration'
                    WHEN event_type = 'purchase' AND value >= 100 THEN 'purchase'
                    WHEN event_type = 'purchase' THEN 'product_cart'
                    WHEN event_type = 'click' THEN 'product_page'
                    WHEN event_type = 'view' THEN 'login'
                    ELSE 'error' END AS event_name,
               CASE WHEN event_type = 'signup' OR (event_type = 'purchase' AND value >= 100)
                    THEN CAST(CAST(value AS DECIMAL(18,2)) AS STRING)
                    WHEN value < 100
                    THEN concat('ZONE_CODE0', CAST(CAST(floor(value / 10) AS INT) AS STRING))
                    WHEN value < 160
                    THEN concat('ZONE_CODE', CAST(CAST(floor(value / 10) AS INT) AS STRING))
                    ELSE 'ZONE_CODE15' END AS details
        FROM {events}""",
    # --- restaurants -------------------------------------------------------
    "e_info": """
        SELECT p_partkey AS id,
               CASE WHEN p_brand = 'Brand#6' THEN concat('  ', upper(p_name), ' ')
                    ELSE p_name END AS name,
               concat(p_name, ', ', CAST(p_size AS STRING)) AS address,
               CASE WHEN p_size <= 6 THEN 'Центральный административный округ'
                    WHEN p_size <= 12 THEN 'Северный административный округ'
                    WHEN p_size <= 18 THEN 'Северо-Восточный административный округ'
                    WHEN p_size <= 24 THEN 'Южный административный округ'
                    WHEN p_size <= 30 THEN 'Западный административный округ'
                    WHEN p_size <= 36 THEN 'Восточный административный округ'
                    WHEN p_size <= 41 THEN 'Юго-Западный административный округ'
                    WHEN p_size <= 46 THEN 'Юго-Восточный административный округ'
                    ELSE 'Северо-Западный административный округ' END AS district,
               CASE p_type WHEN 'STANDARD' THEN 'кафе' WHEN 'LARGE' THEN 'ресторан'
                           WHEN 'ECONOMY' THEN 'быстрое питание' WHEN 'SMALL' THEN 'кофейня'
                           WHEN 'PROMO' THEN 'бар,паб' ELSE 'пиццерия' END AS category,
               CASE WHEN p_brand = 'Brand#1' THEN NULL
                    WHEN p_brand IN ('Brand#2', 'Brand#3') THEN 'Ежедневно, круглосуточно'
                    WHEN p_brand = 'Brand#4' THEN 'пн-пт круглосуточно'
                    ELSE 'ежедневно, 10:00–22:00' END AS hours,
               CAST(3.00 + CAST(floor(CAST(p_retailprice AS DECIMAL(18,2)) - 900) AS INT) * 0.01
                    + p_size * 0.02 AS DECIMAL(18,2)) AS rating,
               CASE WHEN p_type IN ('SMALL', 'ECONOMY') AND p_size <= 30
                         OR p_brand IN ('Brand#5', 'Brand#15') THEN 1 ELSE 0 END AS chain,
               CASE WHEN p_brand IN ('Brand#7', 'Brand#8', 'Brand#9', 'Brand#10', 'Brand#11')
                    THEN NULL
                    ELSE CAST(floor((CAST(p_retailprice AS DECIMAL(18,2)) - 900) * 10)
                              AS INT) END AS seats
        FROM {part}""",
    "e_price": """
        SELECT p_partkey AS id,
               CASE WHEN p_size < 12 THEN 'низкие' WHEN p_size < 25 THEN 'средние'
                    WHEN p_size < 35 THEN 'выше среднего' WHEN p_size < 40 THEN 'высокие'
                    END AS price,
               CASE WHEN p_size < 25
                    THEN concat('Средний счёт: ', CAST(p_size * 50 AS STRING), '–',
                                CAST(p_size * 70 AS STRING), ' ₽')
                    WHEN p_size < 30 THEN concat('Средний счёт: от ',
                                                 CAST(p_size * 45 AS STRING), ' ₽')
                    WHEN p_size < 40
                    THEN concat('Цена чашки капучино: ', CAST(p_size * 4 AS STRING), '–',
                                CAST(p_size * 5 AS STRING), ' ₽')
                    END AS avg_bill,
               CASE WHEN p_size = 1 THEN CAST(0 AS DECIMAL(18,2))
                    WHEN p_size = 28 THEN CAST(12000 AS DECIMAL(18,2))
                    WHEN p_size < 30
                    THEN CAST(CAST(p_retailprice AS DECIMAL(18,2)) * p_size * 0.05
                              AS DECIMAL(18,2)) END AS middle_avg_bill
        FROM {part}""",
}


def view_sql(name: str) -> str:
    """The view as plain SQL over the bare table names."""
    return re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])


def proxy(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One studied table as a DataFrame."""
    text = VIEWS[name].replace('"group"', "`group`")
    tables = {t: load(spark, directory, t) for t in set(re.findall(r"\{(\w+)\}", text))}
    df = spark.sql(text, **tables)
    clocks = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in clocks})
