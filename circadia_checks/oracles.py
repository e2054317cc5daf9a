
from __future__ import annotations

from . import cluster_oracles as cluster

VIEWS: dict[str, str] = {}
ORACLES: dict[str, str] = {}

DK = "CAST(year({0})*10000+month({0})*100+day({0}) AS INT)"
SECS = "CAST(hour(ts)*3600+minute(ts)*60+CAST(floor(second(ts)) AS INT) AS INT)"
K = "CAST(json_extract_string(props,'$.k') AS INT)"
CUSTOMER = "CAST(CASE WHEN user_id % 50 = 0 THEN -1 ELSE user_id END AS BIGINT)"

# ---- input views ---------------------------------------------------------------------------

VIEWS["reader_fact"] = f"""
SELECT event_id, {DK.format('ts')} AS date_key, {CUSTOMER} AS customer_key,
  CASE WHEN event_id % 97 = 0 THEN -1 ELSE {SECS} END AS time_of_day_key,
  CASE WHEN event_id % 41 = 0 THEN -1 ELSE {K} END AS product_key
FROM events"""

VIEWS["time_of_day"] = """
SELECT CAST(range AS INT) AS time_of_day_key,
  lpad(CAST(range//3600 AS VARCHAR),2,'0')||':'||lpad(CAST((range//60)%60 AS VARCHAR),2,'0')||':'||lpad(CAST(range%60 AS VARCHAR),2,'0') AS time_of_day
FROM range(86400)"""

VIEWS["read_duration_fact"] = f"""
SELECT {DK.format('ts')} AS read_duration_date_key, {CUSTOMER} AS customer_key, CAST({K} AS BIGINT) AS product_key,
  CAST(round(value*60000) AS BIGINT) AS milliseconds_spent
FROM events"""

VIEWS["member"] = """
SELECT c_custkey AS customer_key, c_name AS email, CASE WHEN c_custkey % 3 = 0 THEN 'No' ELSE 'Yes' END AS streaming_benefit
FROM customer"""

VIEWS["product"] = """
SELECT p_partkey AS product_key, p_name AS title,
  CASE WHEN p_type IN ('ECONOMY','STANDARD','SMALL') THEN 'E-bøger' ELSE 'Lydbøger' END AS type,
  CASE WHEN p_type = 'PROMO' THEN 'Fys' ELSE 'Dig' END AS type_group
FROM part"""

VIEWS["product_theme_bridge"] = """
SELECT p_partkey AS product_key, p_size AS thema_category_key FROM part WHERE p_size % 7 <> 0
UNION ALL SELECT p_partkey, p_size + 1 FROM part WHERE p_partkey % 10 = 0"""

VIEWS["theme_category"] = """
SELECT DISTINCT p_size AS thema_category_key, 'Bøger|T' || CAST(p_size%10 AS VARCHAR) AS level1_danish,
  'Books|T' || CAST(p_size%10 AS VARCHAR) AS level1_english, 'N' || CAST(p_size AS VARCHAR) AS name_english,
  CASE p_size%3 WHEN 0 THEN 'Skønlitteratur' WHEN 1 THEN 'Faglitteratur' END AS category_group,
  'C' || CAST(p_size%5 AS VARCHAR) AS category
FROM part"""

VIEWS["product_genre"] = """
SELECT p_partkey AS product_key, CASE p_partkey%3 WHEN 0 THEN 'Fagbøger' WHEN 1 THEN 'Skønlitteratur' END AS genre_level1
FROM part WHERE p_partkey%11 <> 0"""

VIEWS["bucket_reads"] = """
SELECT o.o_custkey AS customer_key, p.p_type AS title, 'I-' || p.p_type || '-' || CAST(p.p_partkey % 3 AS VARCHAR) AS isbn13, CAST((l.l_orderkey + 17 * l.l_linenumber) % 100 + 1 AS INT) AS bucket_no
FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey JOIN part p ON p.p_partkey=l.l_partkey WHERE o.o_custkey > 0"""

VIEWS["game_events"] = """
SELECT CASE WHEN e.event_type='signup' THEN 'gameStarted' ELSE e.event_type END AS event_name, e.ts AS event_timestamp,
  'N' || CAST(c.c_nationkey AS VARCHAR) AS user_country
FROM events e JOIN customer c ON c.c_custkey=e.user_id"""

VIEWS["countries"] = """
SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS user_country, n_name AS region FROM nation WHERE n_nationkey < 20"""

VIEWS["habit_peaks"] = """
SELECT k AS customer_key,
  CASE WHEN k%17=0 THEN NULL WHEN k%7=0 THEN 'Sunday' WHEN k%7=1 THEN 'Monday' WHEN k%7=2 THEN 'Saturday' ELSE 'Friday' END AS day_mode,
  CAST(CASE WHEN k%13=0 THEN NULL ELSE (k*2711)%36000 END AS INT) AS time_1,
  CAST(CASE WHEN k%13=0 THEN NULL ELSE 1+k%5 END AS INT) AS wss_1,
  CAST(CASE WHEN k%13=0 OR k%3=0 THEN NULL ELSE 45000+(k*3967)%38000 END AS INT) AS time_2,
  CAST(CASE WHEN k%13=0 OR k%3=0 THEN NULL ELSE 1+(k*3)%5 END AS INT) AS wss_2,
  CAST(CASE WHEN k%13=0 OR k%3=0 OR k%4<>0 THEN NULL ELSE 60000+(k*1543)%26000 END AS INT) AS time_3,
  CAST(CASE WHEN k%13=0 OR k%3=0 OR k%4<>0 THEN NULL ELSE 1+(k*7)%5 END AS INT) AS wss_3
FROM (SELECT c_custkey AS k FROM customer)"""

# ---- derived views -------------------------------------------------------------------------

VIEWS["timed"] = """
SELECT r.event_id, r.date_key, r.customer_key, r.product_key,
  CAST(isodow(strptime(CAST(r.date_key AS VARCHAR),'%Y%m%d')) AS INT) AS weekday,
  CAST(substr(t.time_of_day,1,2) AS INT)*3600+CAST(substr(t.time_of_day,4,2) AS INT)*60+CAST(substr(t.time_of_day,7,2) AS INT) AS secs,
  CAST(substr(t.time_of_day,1,2) AS INT) AS hour
FROM reader_fact r LEFT JOIN time_of_day t ON t.time_of_day_key = r.time_of_day_key"""

VIEWS["cust"] = "SELECT customer_key, weekday, secs, hour FROM timed WHERE date_key >= 20231217 AND customer_key <> -1"

_LABELS = {
    "short": ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"],
    "english": ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"],
    "danish": ["Mandag", "Tirsdag", "Onsdag", "Torsdag", "Fredag", "Lørdag", "Søndag"],
}


def label(weekday: str, style: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(_LABELS[style], start=1))
    return f"CASE {weekday} {cases} END"


VIEWS["seg"] = f"SELECT customer_key, secs, hour, {label('weekday', 'english')} AS week_day FROM cust"

VIEWS["themed"] = """
SELECT r.date_key, b.product_key, t.secs, t.hour, t.weekday, b.thema_category_key, c.level1_danish, c.level1_english, c.name_english,
  c.category_group, c.category
FROM reader_fact r LEFT JOIN product_theme_bridge b ON b.product_key = r.product_key
LEFT JOIN theme_category c ON c.thema_category_key = b.thema_category_key
LEFT JOIN timed t ON t.event_id = r.event_id
WHERE r.date_key >= 20240124"""

VIEWS["clean"] = """
SELECT CAST(strptime(CAST(read_duration_date_key AS VARCHAR),'%Y%m%d') AS DATE) AS date, customer_key, product_key,
  CAST(milliseconds_spent AS DOUBLE) AS msec
FROM read_duration_fact
WHERE customer_key > 0 AND CAST(strptime(CAST(read_duration_date_key AS VARCHAR),'%Y%m%d') AS DATE) < DATE '2024-01-28'"""

VIEWS["starts"] = """
SELECT event_timestamp, user_country,
  CAST(hour(event_timestamp)*3600+minute(event_timestamp)*60+CAST(floor(second(event_timestamp)) AS INT) AS INT) AS secs
FROM game_events WHERE event_name = 'gameStarted'"""

VIEWS["week_counts"] = "SELECT customer_key, weekday, hour, count(*) AS n FROM cust GROUP BY ALL"
VIEWS["week_grid"] = (
    "SELECT CAST(w.range AS INT) AS weekday, CAST(h.range AS INT) AS hour FROM range(1,8) w, range(0,24) h"
)

VIEWS["m_weekday"] = f"""
SELECT customer_key, {label('weekday', 'short')} AS weekday_name FROM
 (SELECT customer_key, weekday, rank() OVER (PARTITION BY customer_key ORDER BY count(*) DESC) AS r FROM cust GROUP BY customer_key, weekday) WHERE r = 1"""
VIEWS["m_hour"] = """
SELECT customer_key, hour FROM
 (SELECT customer_key, hour, rank() OVER (PARTITION BY customer_key ORDER BY count(*) DESC) AS r FROM cust GROUP BY customer_key, hour) WHERE r = 1"""
VIEWS["m_slot"] = f"""
SELECT customer_key, {label('weekday', 'short')} AS day_combined, hour AS hour_combined FROM
 (SELECT customer_key, weekday, hour, rank() OVER (PARTITION BY customer_key ORDER BY n DESC) AS r FROM week_counts) WHERE r = 1"""
VIEWS["m_weekend"] = """
SELECT customer_key, round(count(*) FILTER (weekday >= 6) / CAST(count(*) AS DOUBLE), 6) AS weekend_ratio FROM cust GROUP BY customer_key"""
VIEWS["m_median"] = "SELECT customer_key, median(secs) AS median_secs FROM cust GROUP BY customer_key"

BANDS = ["EarlyMorning", "Morning", "Midday", "Afternoon", "Evening", "Night"]
_BAND = """CASE WHEN hour>=22 OR hour<=2 THEN 'Night' WHEN hour BETWEEN 3 AND 6 THEN 'EarlyMorning' WHEN hour BETWEEN 7 AND 10 THEN 'Morning'
  WHEN hour BETWEEN 11 AND 14 THEN 'Midday' WHEN hour BETWEEN 15 AND 18 THEN 'Afternoon' WHEN hour BETWEEN 19 AND 21 THEN 'Evening' END"""

VIEWS["active"] = "SELECT customer_key FROM seg GROUP BY customer_key HAVING count(*) >= 20"
VIEWS["workday"] = f"""
SELECT customer_key, hour, {_BAND} AS band FROM seg
WHERE customer_key IN (SELECT customer_key FROM active) AND coalesce(week_day NOT IN ('Saturday','Sunday'), true)"""


def _shares(column: str, names: list[tuple[str, str]]) -> str:
    parts = ", ".join(
        f"count(*) FILTER ({column} = {literal}) / CAST(count(*) AS DOUBLE) AS {name}" for literal, name in names
    )
    return f"SELECT customer_key, {parts} FROM workday GROUP BY customer_key"


VIEWS["hour_shares"] = _shares("hour", [(str(h), f"h{h}") for h in range(24)])
VIEWS["band_shares"] = _shares("band", [(f"'{b}'", b) for b in BANDS])
VIEWS["band_scaled"] = "SELECT customer_key, " + ", ".join(
    f"coalesce(({b} - avg({b}) OVER ()) / nullif(stddev_samp({b}) OVER (), 0), 0.0) AS {b}_scaled" for b in BANDS
) + " FROM band_shares"
VIEWS["hour_scaled"] = "SELECT customer_key, " + ", ".join(
    f"coalesce((h{h} - avg(h{h}) OVER ()) / nullif(stddev_samp(h{h}) OVER (), 0), 0.0) AS h{h}_scaled" for h in range(24)
) + " FROM hour_shares"
VIEWS["regularity"] = """
SELECT * FROM
 (SELECT *, (median_time - avg(median_time) OVER ()) / stddev_samp(median_time) OVER () AS median_scaled,
   (sd_time - avg(sd_time) OVER ()) / stddev_samp(sd_time) OVER () AS sd_scaled
  FROM (SELECT customer_key, median(secs) AS median_time, stddev_samp(secs) AS sd_time FROM cust GROUP BY 1))
WHERE median_time IS NOT NULL AND sd_time IS NOT NULL"""
VIEWS["given"] = "SELECT CAST(customer_key % 3 + 1 AS INT) AS centroid, " + ", ".join(
    f"avg({b}) AS {b}" for b in BANDS
) + " FROM band_shares GROUP BY 1"
VIEWS["given_assigned"] = "SELECT * EXCLUDE (r) FROM (SELECT s.*, g.centroid AS cluster, row_number() OVER (PARTITION BY s.customer_key ORDER BY " + "+".join(
    f"(s.{b}-g.{b})*(s.{b}-g.{b})" for b in BANDS
) + ", g.centroid) AS r FROM band_shares s, given g) WHERE r = 1"

VIEWS["habits"] = """
SELECT *, CASE
  WHEN wss_2 IS NULL AND wss_1 >= 4 THEN 'Allday'
  WHEN time_1 > 19800 AND time_1 < 36000 AND time_2 > 50400 AND time_2 < 66600 AND weekday = 'Workday' THEN 'Commuter'
  WHEN time_1 < 14400 AND (time_2 > 75600 OR time_3 > 75600) THEN 'Nighttime'
  WHEN time_3 IS NOT NULL THEN 'multiple'
  WHEN time_1 IS NULL THEN 'None' ELSE 'Other' END AS time_type
FROM (SELECT *, CASE WHEN day_mode IS NULL THEN NULL WHEN day_mode IN ('Sunday','Saturday') THEN 'Weekend' ELSE 'Workday' END AS weekday FROM habit_peaks)"""

VIEWS["content"] = """
SELECT r.customer_key, p.type, g.genre_level1, count(*) AS n
FROM reader_fact r LEFT JOIN product p ON p.product_key = r.product_key LEFT JOIN product_genre g ON g.product_key = r.product_key
WHERE r.date_key >= 20231202 AND p.type_group = 'Dig' AND r.customer_key <> -1
GROUP BY r.customer_key, p.type, g.genre_level1"""


def _preference(column: str, over: str, under: str, ratio: str, name: str, yes: str, no: str) -> str:
    return f"""
SELECT customer_key, a / b AS {ratio}, CASE WHEN a >= b THEN '{yes}' ELSE '{no}' END AS {name} FROM
 (SELECT customer_key, coalesce(CAST(sum(n) FILTER ({column} = '{over}') AS DOUBLE), 0.1) AS a,
   coalesce(CAST(sum(n) FILTER ({column} = '{under}') AS DOUBLE), 0.1) AS b FROM content GROUP BY customer_key)"""


VIEWS["formats"] = _preference("type", "Lydbøger", "E-bøger", "lyd_ratio", "format", "Lyd", "E-bog")
VIEWS["genres"] = _preference("genre_level1", "Skønlitteratur", "Fagbøger", "fiction_ratio", "litt_pref", "Skøn", "Fag")
VIEWS["profile"] = """
SELECT h.customer_key, h.time_type, h.weekday, f.format, g.litt_pref
FROM habits h JOIN formats f USING (customer_key) JOIN genres g USING (customer_key) WHERE h.time_type <> 'None'"""

VIEWS["positions"] = "SELECT title, isbn13, customer_key, bucket_no, count(*) AS n FROM bucket_reads GROUP BY ALL"
# Occurrence i of a bucket, and whether it directly follows the bucket before it in reading order.
VIEWS["steps"] = """
SELECT *, row_number() OVER (PARTITION BY customer_key, title, isbn13, bucket_no ORDER BY pos) AS occurrence,
  CASE WHEN prev IS NULL THEN NULL WHEN bucket_no <> prev + 1 THEN 'gap' ELSE '1' END AS gap
FROM (SELECT *, lag(bucket_no) OVER (PARTITION BY customer_key, title ORDER BY bucket_no, isbn13, pos) AS prev
  FROM (SELECT *, row_number() OVER (ORDER BY customer_key, title, bucket_no, isbn13) AS pos FROM bucket_reads))"""

_NEEDS = {
    "timed": ["reader_fact", "time_of_day"],
    "cust": ["timed"],
    "seg": ["cust"],
    "themed": ["timed", "product_theme_bridge", "theme_category"],
    "clean": ["read_duration_fact"],
    "starts": ["game_events"],
    "week_counts": ["cust"],
    "m_weekday": ["cust"], "m_hour": ["cust"], "m_slot": ["week_counts"], "m_weekend": ["cust"], "m_median": ["cust"],
    "active": ["seg"],
    "workday": ["active"],
    "hour_shares": ["workday"], "band_shares": ["workday"],
    "band_scaled": ["band_shares"], "hour_scaled": ["hour_shares"], "regularity": ["cust"], "given": ["band_shares"], "given_assigned": ["given"],
    "habits": ["habit_peaks"],
    "content": ["reader_fact", "product", "product_genre"],
    "formats": ["content"], "genres": ["content"],
    "profile": ["habits", "formats", "genres"],
    "positions": ["bucket_reads"], "steps": ["bucket_reads"],
}


def sql(body: str, *needs: str, extra: list[tuple[str, str]] = ()) -> str:
    """The body behind a WITH clause holding the views it needs, in dependency order."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in order]
    parts += [f"{n} AS MATERIALIZED ({text.strip()})" for n, text in extra]
    # a step that reads itself is a recursion
    again = "RECURSIVE " if any(f"FROM {n} " in text for n, text in extra) else ""
    return (f"WITH {again}" + ",\n".join(parts) + "\n" if parts else "") + body.strip()


def oracle(name: str, body: str, *needs: str, extra=()) -> None:
    ORACLES[name] = sql(body, *needs, extra=extra)


# ---- sources, projections, filters ---------------------------------------------------------

oracle("src1_warehouse_query", """
SELECT date_key, count(*) AS n_events, count(DISTINCT customer_key) AS n_customers FROM reader_fact WHERE date_key >= 20231217 GROUP BY 1""", "reader_fact")
oracle("src2_event_scan", "SELECT user_country, event_name, count(*) AS n, max(event_timestamp) AS latest FROM game_events GROUP BY 1, 2", "game_events")
oracle("src3_snk1_csv_round_trip", "SELECT customer_key, secs, week_day FROM seg", "seg")

_SHARE = f"""
SELECT weekday, {label('weekday', 'danish')} AS weekday_label, hour, round(100.0 * n / nullif(sum(n) OVER (PARTITION BY weekday), 0), 6) AS share_pct FROM
 (SELECT coalesce(g.weekday, c.weekday) AS weekday, coalesce(g.hour, c.hour) AS hour, CAST(coalesce(c.n, 0) AS DOUBLE) AS n
  FROM week_grid g FULL JOIN (SELECT weekday, hour, count(*) AS n FROM cust GROUP BY ALL) c ON c.weekday = g.weekday AND c.hour = g.hour)"""
oracle("snk2_european_round_trip", _SHARE, "cust", "week_grid")
oracle("weekday_hour_share", _SHARE, "cust", "week_grid")

oracle("prj1_select", "SELECT date_key, customer_key FROM reader_fact", "reader_fact")
oracle("prj2_drop", "SELECT * EXCLUDE (type, type_group) FROM product", "product")
oracle("prj3_name_patterns", "SELECT customer_key, time_1, time_2, time_3 FROM habit_peaks", "habit_peaks")
oracle("prj3_by_position", "SELECT date_key, customer_key FROM reader_fact", "reader_fact")
oracle("prj4_rename", "SELECT customer_key AS key, email AS address, streaming_benefit FROM member", "member")
oracle("prj5_derived_columns", f"""
SELECT customer_key, weekday, {label('weekday', 'short')} AS weekday_name,
  CASE WHEN weekday >= 6 THEN 'yes' ELSE 'no' END AS weekend, secs, hour FROM cust""", "cust")
oracle("prj7_key_set", "SELECT DISTINCT customer_key AS key FROM reader_fact WHERE customer_key <> -1", "reader_fact")

oracle("flt1_sentinels", """
SELECT event_id, customer_key, product_key FROM reader_fact WHERE customer_key <> -1 AND product_key > 0""", "reader_fact")
oracle("flt2_look_back", " UNION ALL ".join(
    f"SELECT date_key, count(*) AS n, {d} AS days FROM reader_fact "
    f"WHERE date_key >= CAST(strftime(DATE '2024-01-31' - {d}, '%Y%m%d') AS INT) GROUP BY date_key" for d in (7, 45, 60)
), "reader_fact")
oracle("flt3_cut_off", "SELECT event_id, date_key FROM reader_fact WHERE date_key >= 20240115", "reader_fact")
oracle("flt4_equality", """
SELECT product_key, title FROM product WHERE type = 'E-bøger' AND type_group = 'Dig' AND product_key <> 7""", "product")
oracle("flt5_members", "SELECT event_id, customer_key FROM reader_fact WHERE customer_key IN (1,2,3,5,8,13,21)", "reader_fact")
oracle("flt6_not_in_keeps_null", """
SELECT customer_key, day_mode FROM habit_peaks WHERE day_mode IS NULL OR day_mode NOT IN ('Saturday','Sunday')""", "habit_peaks")
oracle("flt7_drop_null", """
SELECT date_key, secs, category_group FROM themed WHERE date_key IS NOT NULL AND secs IS NOT NULL AND category_group IS NOT NULL""", "themed")


def _outliers(key: str, test: str) -> str:
    return f"""
SELECT c.customer_key, c.weekday, c.secs, c.hour FROM cust c
JOIN (SELECT {key}, median(secs) AS m, stddev_samp(secs) AS s FROM cust GROUP BY {key}) g ON g.{key} = c.{key} WHERE {test}"""


oracle("flt8_outliers_by_weekday", _outliers("weekday", "NOT (abs(c.secs - g.m) > 2 * g.s)"), "cust")
oracle("flt8_outliers_by_customer", _outliers("customer_key", "abs(c.secs - g.m) < 2 * g.s"), "cust")
oracle("flt8_outliers_wide", _outliers("customer_key", "abs(c.secs - g.m) < 3 * g.s"), "cust")
oracle("flt9_active_customers", "SELECT customer_key FROM active", "active")
oracle("flt9_active_within_week", """
SELECT customer_key FROM timed WHERE date_key >= 20240124 AND customer_key <> -1 GROUP BY customer_key HAVING count(*) >= 20""", "timed")
oracle("clean_durations", "SELECT date, customer_key, product_key, msec FROM clean", "clean")

# ---- joins ---------------------------------------------------------------------------------

oracle("jon1_time_dimension", "SELECT event_id, time_of_day FROM reader_fact LEFT JOIN time_of_day USING (time_of_day_key)", "reader_fact", "time_of_day")
oracle("jon3_bucket_joins", f"""
SELECT o.o_custkey AS customer_key, p.p_type AS title, 'I-' || p.p_type || '-' || CAST(p.p_partkey % 3 AS VARCHAR) AS isbn13, CAST((l.l_orderkey + 17 * l.l_linenumber) % 100 + 1 AS INT) AS bucket_no, count(*) AS n
FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey JOIN part p ON p.p_partkey=l.l_partkey
WHERE o.o_custkey > 0 AND {DK.format('o.o_orderdate')} > 19950226 AND o.o_orderkey % 4 <> 0 AND p.p_size % 2 = 0
GROUP BY o.o_custkey, l.l_partkey, p.p_type, p.p_partkey, CAST((l.l_orderkey + 17 * l.l_linenumber) % 100 + 1 AS INT)""")
oracle("jon4_digital_products", """
SELECT r.event_id, r.product_key, p.type FROM reader_fact r JOIN product p USING (product_key) WHERE p.type_group = 'Dig'""", "reader_fact", "product")
oracle("jon6_semi_on_keys", """
SELECT event_id, customer_key FROM reader_fact
WHERE customer_key IN (SELECT customer_key FROM cust GROUP BY customer_key HAVING count(*) >= 60)""", "cust")
oracle("jon7_natural_inner", """
SELECT customer_key, round(lyd_ratio,6) AS lyd_ratio, format, round(fiction_ratio,6) AS fiction_ratio, litt_pref
FROM formats JOIN genres USING (customer_key)""", "formats", "genres")
oracle("jon7_null_keys_match", "SELECT day_mode, count(*) AS n, max(customer_key) AS last_customer FROM habit_peaks GROUP BY day_mode", "habit_peaks")
oracle("jon8_countries_left", "SELECT user_country, region, secs FROM countries LEFT JOIN starts USING (user_country)", "countries", "starts")

VIEWS["day_modes"] = """
SELECT customer_key, week_day AS day_mode FROM (SELECT customer_key, week_day, row_number() OVER (PARTITION BY customer_key
 ORDER BY count(*) DESC, week_day) AS r FROM seg GROUP BY customer_key, week_day) WHERE r = 1"""
_NEEDS["day_modes"] = ["seg"]
oracle("jon9_mode_left", "SELECT customer_key, email, day_mode FROM member LEFT JOIN day_modes USING (customer_key)", "member", "day_modes")
oracle("jon10_full_keys", """
SELECT customer_key, day_mode FROM day_modes FULL JOIN (SELECT customer_key FROM member WHERE streaming_benefit = 'Yes') USING (customer_key)""", "member", "day_modes")
oracle("jon11_full_fold", """
SELECT customer_key, first_secs, n_weekend, streaming_benefit
FROM (SELECT customer_key, min(secs) AS first_secs FROM cust GROUP BY 1)
FULL JOIN (SELECT customer_key, count(*) AS n_weekend FROM cust WHERE weekday >= 6 GROUP BY 1) USING (customer_key)
FULL JOIN (SELECT customer_key, streaming_benefit FROM member) USING (customer_key)""", "cust", "member")

VIEWS["binned"] = """
SELECT customer_key, secs, CAST(CASE WHEN secs IS NULL THEN NULL ELSE greatest((CAST(secs - lo AS BIGINT) * 24 + w - 1) // w - 1, 0) END AS INT) AS bin
FROM cust, (SELECT min(secs) AS lo, max(secs) - min(secs) AS w FROM cust)"""
_NEEDS["binned"] = ["cust"]
oracle("jon13_bin_range", "SELECT bin, min(secs) AS m1, max(secs) AS m2, CAST(min(secs)//3600 AS INT) AS hour1 FROM binned GROUP BY bin", "binned")

# ---- aggregates ----------------------------------------------------------------------------

oracle("agg1_count_by_keys", "SELECT customer_key, weekday, count(*) AS n FROM cust GROUP BY ALL", "cust")
oracle("agg2_buckets_per_customer", "SELECT customer_key, count(*) AS n_buckets FROM reader_fact WHERE date_key >= 20240101 GROUP BY 1", "reader_fact")
oracle("agg3_whole_minutes", """
SELECT customer_key, CAST(sum(milliseconds_spent // 1000 // 60) AS BIGINT) AS total_minutes FROM read_duration_fact GROUP BY 1""", "read_duration_fact")
oracle("agg4_sum", "SELECT customer_key, round(sum(msec),6) AS msec FROM clean GROUP BY 1", "clean")
oracle("agg5_count_distinct", """
SELECT weekday, count(DISTINCT hour) + max(CASE WHEN hour IS NULL THEN 1 ELSE 0 END) AS hours, count(DISTINCT hour) AS known_hours
FROM cust GROUP BY 1""", "cust")
oracle("agg7_median", "SELECT l_linenumber, round(median(l_extendedprice),6) AS median FROM lineitem GROUP BY 1")
oracle("agg5_approximate_users", """
SELECT date_key, count(DISTINCT customer_key) AS users, true AS within_error FROM timed WHERE date_key >= 20231217 AND customer_key <> -1 GROUP BY 1
UNION ALL SELECT 0, count(DISTINCT customer_key), true FROM cust""", "timed", "cust")
oracle("agg6_approximate_cardinalities", " UNION ALL ".join(
    f"SELECT '{c}' AS name, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n, true AS within_error FROM theme_category WHERE thema_category_key > 0"
    for c in ("thema_category_key", "level1_danish", "level1_english", "name_english", "category_group", "category")), "theme_category")
oracle("agg7_approximate_median", "SELECT l_linenumber, count(*) AS n, true AS within_error FROM lineitem GROUP BY 1")
oracle("agg8_standard_deviation", "SELECT customer_key, median(secs) AS median, round(stddev_samp(secs),6) AS sd FROM cust GROUP BY 1", "cust")
oracle("agg9_mean", "SELECT product_key, round(avg(msec),6) AS mean_msec FROM clean GROUP BY 1", "clean")
oracle("agg10_min_max", "SELECT weekday, min(secs) AS first_secs, max(secs) AS last_secs FROM cust GROUP BY 1", "cust")
oracle("agg11_mode", """
SELECT customer_key, weekday AS mode_weekday, (SELECT weekday FROM cust GROUP BY weekday ORDER BY count(*) DESC, weekday LIMIT 1) AS overall_mode
FROM (SELECT customer_key, weekday, row_number() OVER (PARTITION BY customer_key ORDER BY count(*) DESC, weekday) AS r
 FROM cust GROUP BY 1, 2) WHERE r = 1""", "cust")
oracle("agg14_distinct_rows", "SELECT DISTINCT date_key, customer_key FROM reader_fact", "reader_fact")
oracle("agg15_distinct_keys", "SELECT DISTINCT customer_key FROM reader_fact", "reader_fact")
oracle("agg16_first_row_per_key", """
SELECT customer_key, date_key, time_of_day_key, product_key FROM (SELECT *, row_number() OVER (PARTITION BY customer_key
 ORDER BY date_key, time_of_day_key, product_key) AS r FROM reader_fact) WHERE r = 1""", "reader_fact")
oracle("agg17_row_and_group_counts", """
SELECT count(*) AS n_rows, count(DISTINCT region) AS n_regions FROM countries LEFT JOIN starts USING (user_country)""", "countries", "starts")

# ---- windows, order, samples ---------------------------------------------------------------

_HOUR_COUNTS = "(SELECT customer_key, hour, count(*) AS n FROM cust GROUP BY 1, 2)"
oracle("win1_win2_share_of_group", f"""
SELECT *, round(n / CAST(sum_n AS DOUBLE), 6) AS prop_n
FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY customer_key) AS BIGINT) AS sum_n FROM {_HOUR_COUNTS})""", "cust")
oracle("win6_top_with_ties", f"""
SELECT customer_key, hour, n FROM (SELECT *, rank() OVER (PARTITION BY customer_key ORDER BY n DESC) AS r FROM {_HOUR_COUNTS}) WHERE r <= 2""", "cust")
oracle("win7_gap_flags", """
SELECT title, isbn13, customer_key, bucket_no, gap, n FROM steps
JOIN positions USING (title, isbn13, customer_key, bucket_no) WHERE occurrence = 1""", "steps", "positions")
oracle("win8_quantile_buckets", """
SELECT c_custkey, c_acctbal, CAST(ntile(5) OVER (ORDER BY c_acctbal, c_custkey) AS INT) AS bucket FROM customer""")
oracle("win8_quantile_buckets_null", """
SELECT customer_key, wss_1, CAST(ntile(7) OVER (ORDER BY wss_1, customer_key) AS INT) AS bucket FROM habit_peaks WHERE wss_1 IS NOT NULL
UNION ALL SELECT customer_key, wss_1, NULL FROM habit_peaks WHERE wss_1 IS NULL""", "habit_peaks")
oracle("win9_row_in_group", """
SELECT *, CAST(row_number() OVER (PARTITION BY product_key ORDER BY thema_category_key) AS INT) AS row FROM product_theme_bridge""", "product_theme_bridge")
oracle("srt1_sort", "SELECT * FROM theme_category ORDER BY category_group NULLS LAST, thema_category_key DESC", "theme_category")
oracle("srt2_top_with_ties", """
SELECT customer_key, n FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS r FROM (SELECT customer_key, count(*) AS n FROM reader_fact GROUP BY 1)) WHERE r <= 10""", "reader_fact")
oracle("srt3_level_order", """
SELECT day_mode, count(*) AS n, CASE day_mode WHEN 'Monday' THEN 1 WHEN 'Friday' THEN 5 WHEN 'Saturday' THEN 6 WHEN 'Sunday' THEN 7 END AS position
FROM habit_peaks GROUP BY 1""", "habit_peaks")
oracle("srt4_last_rows", "SELECT date_key, event_id FROM reader_fact ORDER BY date_key DESC, event_id DESC LIMIT 6", "reader_fact")
oracle("set1_append", """
SELECT customer_key, source, count(*) AS n FROM (SELECT customer_key, 'reads' AS source FROM reader_fact
 UNION ALL SELECT customer_key, 'durations' FROM read_duration_fact) GROUP BY 1, 2""", "reader_fact", "read_duration_fact")

# ---- reshaping -----------------------------------------------------------------------------

oracle("rsh2_pivot_counts", "SELECT customer_key, " + ", ".join(
    f"count(*) FILTER (weekday = {d}) AS d{d}" for d in range(1, 8)) + " FROM cust GROUP BY 1", "cust")

VIEWS["product_hours"] = "SELECT product_key, hour, count(*) AS n FROM timed GROUP BY 1, 2"
_NEEDS["product_hours"] = ["timed"]
oracle("rsh3_densify", """
SELECT coalesce(g.product_key, c.product_key) AS product_key, coalesce(g.hour, c.hour) AS hour, coalesce(c.n, 0) AS n
FROM (SELECT product_key, CAST(range AS INT) AS hour FROM (SELECT DISTINCT product_key FROM product_hours), range(24)) g
FULL JOIN product_hours c ON c.product_key = g.product_key AND c.hour = g.hour""", "product_hours")
oracle("rsh3_densify_inside", """
SELECT g.product_key, g.hour, coalesce(c.n, 0) AS n
FROM (SELECT product_key, CAST(range AS INT) AS hour FROM (SELECT product_key FROM product_hours WHERE hour IS NOT NULL
   UNION SELECT CAST(product_key AS INT) FROM product), range(24)) g
LEFT JOIN product_hours c ON c.product_key = g.product_key AND c.hour = g.hour""", "product_hours", "product")
oracle("rsh4_pivot_many", "SELECT customer_key, time_1, wss_1, time_2, wss_2, time_3, wss_3 FROM habit_peaks WHERE time_1 IS NOT NULL", "habit_peaks")
oracle("rsh5_unpivot", " UNION ALL ".join(
    f"SELECT customer_key, 'time_{i}' AS name, time_{i} AS value FROM habit_peaks" for i in (1, 2, 3)), "habit_peaks")

_B = range(1, 101)
oracle("bucket_matrix", "SELECT title, isbn13, customer_key, " + ", ".join(
    f"max(CASE WHEN bucket_no = {b} THEN 1 ELSE 0 END) AS b{b}" for b in _B) + " FROM bucket_reads GROUP BY ALL", "bucket_reads")
oracle("bucket_gaps", "SELECT title, isbn13, customer_key, " + ", ".join(
    f"max(gap) FILTER (bucket_no = {b} AND occurrence = 1) AS b{b}" for b in _B) + " FROM steps GROUP BY ALL", "steps")
_RUNS = """
SELECT i.title, i.isbn13, i.customer_key, r.range AS occurrence, {cells}
FROM (SELECT title, isbn13, customer_key, max(n) AS longest, {sizes} FROM positions GROUP BY ALL) i, range(1, (SELECT max(n) + 1 FROM positions)) r WHERE r.range <= i.longest"""
oracle("rsh6_bucket_rows", _RUNS.format(
    sizes=", ".join(f"max(n) FILTER (bucket_no = {b}) AS n{b}" for b in _B),
    cells=", ".join(f"CASE WHEN n{b} IS NULL THEN 0 WHEN n{b} = 1 OR r.range <= n{b} THEN 1 END AS b{b}" for b in _B),
), "positions")
oracle("rsh6_bucket_gap_rows", "SELECT i.title, i.isbn13, i.customer_key, r.range AS occurrence, " + ", ".join(
    f"CASE WHEN n{b} = 1 THEN g{b}[1] ELSE g{b}[r.range] END AS b{b}" for b in _B
) + " FROM (SELECT title, isbn13, customer_key, max(occurrence) AS longest, " + ", ".join(
    f"max(occurrence) FILTER (bucket_no = {b}) AS n{b}, list(gap ORDER BY occurrence) FILTER (bucket_no = {b}) AS g{b}" for b in _B
) + " FROM steps GROUP BY ALL) i, range(1, (SELECT max(occurrence) + 1 FROM steps)) r WHERE r.range <= i.longest", "steps")

# ---- samples: order and place by the checksum of seed and key -------------------------------


def checksum(key: str, seed: str = "62") -> str:
    return f"md5(CAST({seed} AS VARCHAR) || '|' || coalesce(CAST({key} AS VARCHAR), 'NA'))"


def position(key: str, seed: str = "62") -> str:
    return f"CAST(CAST('0x' || substr({checksum(key, seed)}, 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656"


oracle("smp1_sample_keys", f"SELECT customer_key FROM (SELECT DISTINCT customer_key FROM reader_fact) ORDER BY {checksum('customer_key')}, 1 LIMIT 30", "reader_fact")
oracle("smp2_sample_fraction", f"SELECT event_id, customer_key FROM reader_fact WHERE {position('event_id')} < 0.3", "reader_fact")
oracle("smp3_split", f"SELECT event_id, CASE WHEN {position('event_id')} < 0.75 THEN 'train' ELSE 'rest' END AS part FROM reader_fact", "reader_fact")
oracle("sample_events", f"""
SELECT date_key, customer_key, weekday, secs, hour FROM (
  SELECT DISTINCT t.date_key, t.customer_key, r.time_of_day_key, t.weekday, t.secs, t.hour FROM timed t JOIN reader_fact r USING (event_id)
  WHERE t.date_key >= 20231217 AND t.customer_key IN (
    SELECT customer_key FROM (SELECT DISTINCT customer_key FROM cust) ORDER BY {checksum('customer_key')}, 1 LIMIT 100))""", "reader_fact", "timed", "cust")

# ---- functions -----------------------------------------------------------------------------

oracle("fn1_4_calendar", f"""
SELECT event_id, date, date_key AS key_again, weekday, {label('weekday', 'short')} AS name_short, {label('weekday', 'english')} AS name_english,
  {label('weekday', 'danish')} AS name_danish, CASE WHEN weekday >= 6 THEN 'yes' ELSE 'no' END AS weekend,
  CASE WHEN weekday >= 6 THEN 'Weekend' ELSE 'Workday' END AS day_class
FROM (SELECT event_id, date_key, weekday, CAST(strptime(CAST(date_key AS VARCHAR),'%Y%m%d') AS DATE) AS date FROM timed)""", "timed")
oracle("fn5_12_clock", """
SELECT event_timestamp, CAST(hour(event_timestamp) AS INT) AS hour, CAST(minute(event_timestamp) AS INT) AS minute,
  CAST(floor(second(event_timestamp)) AS INT) AS second, secs, CAST(hour(event_timestamp) AS INT) AS hour_of_secs,
  strftime(event_timestamp, '%H:%M:%S') AS clock, secs AS secs_again, CAST(round_even(secs / 2.0, 0) * 2 AS INT) AS even_secs,
  secs > 19800 AND secs < 36000 AS is_commute
FROM (SELECT event_timestamp, CAST(hour(event_timestamp)*3600+minute(event_timestamp)*60+CAST(floor(second(event_timestamp)) AS INT) AS INT) AS secs FROM game_events)""", "game_events")
oracle("fn13_time_bands", f"""
SELECT hour, band, CASE band WHEN 'EarlyMorning' THEN 1 WHEN 'Morning' THEN 2 WHEN 'Midday' THEN 3 WHEN 'Afternoon' THEN 4
  WHEN 'Evening' THEN 5 WHEN 'Night' THEN 6 END AS band_order, count(*) AS n
FROM (SELECT hour, {_BAND} AS band FROM cust) GROUP BY ALL""", "cust")
oracle("fn15_16_nulls", "SELECT customer_key, coalesce(time_2, 0) AS time_2, time_2 IS NULL AS is_missing FROM habit_peaks", "habit_peaks")
oracle("fn18_20_numbers", """
SELECT product_key, round(CAST(sum(milliseconds_spent) AS DOUBLE) / 1000 / 60, 6) AS minutes, round(ln(count(*) + 1.0::DOUBLE), 6) AS log_n,
  round_even(avg(milliseconds_spent / 1000), 0) AS mean_secs, max(milliseconds_spent) - min(milliseconds_spent) AS span
FROM read_duration_fact GROUP BY 1""", "read_duration_fact")
oracle("fn21_24_text", """
SELECT thema_category_key, regexp_replace(level1_danish, 'Bøger\\|', '') AS short_name,
  coalesce(category_group, 'NA') || ' - ' || category || ' - ' || thema_category_key AS label,
  'Peak: ' || strftime(TIMESTAMP '2024-01-01' + to_seconds(thema_category_key * 600), '%H:%M:%S') || ' (UTC)' AS peak_label,
  TRY_CAST(substr(category, 2, 3) AS INT) AS category_number, TRY_CAST(level1_english AS INT) AS not_a_number
FROM theme_category""", "theme_category")
oracle("fn25_interval_bins", "SELECT customer_key, secs, bin FROM binned", "binned")
oracle("fn26_27_look_back_limits", "SELECT date_key, " + ", ".join(
    f"CAST(strftime(d - {n}, '%Y%m%d') AS INT) AS key_{n}" for n in (7, 45, 60)
) + ", CAST(d - 3 AS DATE) AS settled FROM (SELECT DISTINCT date_key, CAST(strptime(CAST(date_key AS VARCHAR),'%Y%m%d') AS DATE) AS d FROM reader_fact)", "reader_fact")
oracle("fn28_stamps", """
SELECT strftime(event_timestamp, '%H:%M:%S') AS clock, date_trunc('minute', event_timestamp) AS minute, CAST(NULL AS TIMESTAMP) AS no_stamp
FROM game_events""", "game_events")

# ---- activity ------------------------------------------------------------------------------

oracle("weekday_hour_heatmap", """
SELECT coalesce(g.weekday, c.weekday) AS weekday, coalesce(g.hour, c.hour) AS hour, coalesce(c.n, 0) AS n, round(ln(coalesce(c.n, 0) + 1.0::DOUBLE), 6) AS log_n
FROM week_grid g FULL JOIN (SELECT weekday, hour, count(*) AS n FROM cust GROUP BY ALL) c ON c.weekday = g.weekday AND c.hour = g.hour""", "cust", "week_grid")
oracle("customer_weekday_hour_heatmap", """
SELECT coalesce(g.customer_key, c.customer_key) AS customer_key, coalesce(g.weekday, c.weekday) AS weekday, coalesce(g.hour, c.hour) AS hour,
  coalesce(c.n, 0) AS n, round(ln(coalesce(c.n, 0) + 1.0::DOUBLE), 6) AS log_n
FROM (SELECT * FROM (SELECT DISTINCT customer_key FROM chosen), week_grid) g
FULL JOIN chosen c ON c.customer_key = g.customer_key AND c.weekday = g.weekday AND c.hour = g.hour""", "week_counts", "week_grid",
    extra=[("chosen", "SELECT * FROM week_counts WHERE customer_key IN (1,2,3,5,8,13,21)")])
oracle("customer_hour_heatmap", f"""
SELECT coalesce(g.customer_key, c.customer_key) AS customer_key, coalesce(g.hour, c.hour) AS hour,
  coalesce(c.n, 0) AS n, round(ln(coalesce(c.n, 0) + 1.0::DOUBLE), 6) AS log_n
FROM (SELECT customer_key, CAST(range AS INT) AS hour FROM (SELECT DISTINCT customer_key FROM cust), range(24)) g
FULL JOIN {_HOUR_COUNTS} c ON c.customer_key = g.customer_key AND c.hour = g.hour""", "cust")
oracle("category_weekday_hour_heatmap", """
SELECT g.category_group, g.weekday, g.hour, coalesce(c.n, 0) AS n
FROM (SELECT * FROM (SELECT DISTINCT category_group FROM themed WHERE category_group IS NOT NULL), week_grid) g
LEFT JOIN (SELECT category_group, weekday, hour, count(*) AS n FROM themed WHERE category_group IS NOT NULL AND secs IS NOT NULL AND weekday IS NOT NULL GROUP BY ALL) c
ON c.category_group = g.category_group AND c.weekday = g.weekday AND c.hour = g.hour""", "themed", "week_grid")
for _name, _group in (("fiction_heatmap", "Skønlitteratur"), ("nonfiction_heatmap", "Faglitteratur")):
    oracle(_name, f"SELECT category_group, weekday, hour, count(*) AS n FROM themed WHERE category_group = '{_group}' GROUP BY ALL", "themed")
oracle("theme_events", "SELECT * EXCLUDE (hour, weekday) FROM themed", "themed")
oracle("category_frequencies", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM themed GROUP BY {c}"
    for c in ("level1_danish", "name_english", "category_group", "category")), "themed")
oracle("level1_frequencies", "SELECT level1_danish, count(*) AS n FROM themed GROUP BY 1", "themed")
oracle("product_time_profile", "SELECT secs, count(*) AS n FROM themed WHERE product_key = 68 GROUP BY 1", "themed")
oracle("column_cardinalities", "SELECT " + ", ".join(
    f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS {c}"
    for c in ("thema_category_key", "level1_danish", "level1_english", "name_english", "category_group", "category")
) + " FROM theme_category WHERE thema_category_key > 0", "theme_category")

# ---- habits --------------------------------------------------------------------------------

oracle("customer_modal_weekday", "SELECT * FROM m_weekday", "m_weekday")
oracle("customer_modal_hour", "SELECT * FROM m_hour", "m_hour")
oracle("customer_modal_slot", "SELECT * FROM m_slot", "m_slot")
oracle("customer_weekend_ratio", "SELECT * FROM m_weekend", "m_weekend")
oracle("customer_median_time", "SELECT * FROM m_median", "m_median")
oracle("customer_median_time_strict", """
SELECT customer_key, CASE WHEN count(secs) = count(*) THEN median(secs) END AS median_secs FROM cust GROUP BY 1""", "cust")
oracle("customer_habit_profile", """
SELECT customer_key, weekday_name, hour, day_combined, hour_combined, weekend_ratio, median_secs FROM (
 SELECT *, row_number() OVER (PARTITION BY customer_key ORDER BY weekday_name NULLS LAST, hour NULLS LAST, day_combined NULLS LAST, hour_combined NULLS LAST) AS r
 FROM m_weekday FULL JOIN m_hour USING (customer_key) FULL JOIN m_slot USING (customer_key)
 FULL JOIN m_weekend USING (customer_key) FULL JOIN m_median USING (customer_key)) WHERE r = 1""",
    "m_weekday", "m_hour", "m_slot", "m_weekend", "m_median")
oracle("typical_slot", """
SELECT c.customer_key, d.weekday AS modal_weekday, median(c.secs) AS median_secs FROM cust c
JOIN (SELECT customer_key, median(secs) AS m, stddev_samp(secs) AS s FROM cust GROUP BY 1) g ON g.customer_key = c.customer_key
JOIN (SELECT customer_key, weekday, row_number() OVER (PARTITION BY customer_key ORDER BY count(*) DESC, weekday) AS r FROM cust GROUP BY 1, 2) d
  ON d.customer_key = c.customer_key AND d.r = 1 AND d.weekday = c.weekday
WHERE abs(c.secs - g.m) < 2 * g.s GROUP BY 1, 2""", "cust")
oracle("weekday_start_time", """
SELECT k.customer_key, k.weekday, k.secs, d.start_secs, k.weekday = (SELECT weekday FROM kept GROUP BY weekday ORDER BY count(*) DESC, weekday LIMIT 1) AS is_modal_day
FROM kept k JOIN (SELECT weekday, min(secs) - 300 AS start_secs FROM kept GROUP BY 1) d USING (weekday)""", "cust",
    extra=[("kept", _outliers("weekday", "NOT (abs(c.secs - g.m) > 2 * g.s)"))])

# ---- usage ---------------------------------------------------------------------------------

oracle("daily_consumption", """
SELECT date, round(time,6) AS time, users, round(time/users,6) AS avg_time_msec, round(time/users/1000,6) AS avg_time_secs, round(time/users/1000/60,6) AS avg_time_mins
FROM (SELECT date, sum(msec) AS time, count(DISTINCT customer_key) AS users FROM clean GROUP BY 1)""", "clean")
oracle("daily_customer_minutes", """
SELECT date, round(median(t),6) AS median, round(avg(t),6) AS mean FROM (SELECT date, customer_key, sum(msec)/1000/60 AS t FROM clean GROUP BY 1, 2) GROUP BY 1""", "clean")
oracle("daily_titles_per_customer", """
SELECT date, round(avg(n),6) AS m FROM (SELECT date, customer_key, count(*) AS n FROM clean GROUP BY 1, 2) GROUP BY 1""", "clean")
oracle("daily_distinct_titles_per_customer", """
SELECT date, round(avg(n),6) AS m FROM (SELECT date, customer_key, count(DISTINCT product_key) AS n FROM clean GROUP BY 1, 2) GROUP BY 1""", "clean")
oracle("average_daily_minutes", "SELECT round(avg(time),6) AS avg_time FROM (SELECT date, sum(msec)/1000/60 AS time FROM clean GROUP BY 1)", "clean")


def _usage(since: int, suffix: str) -> str:
    return f"""
SELECT m.email, b.n AS n_buckets{suffix}, CAST(s.t AS BIGINT) AS total_minutes{suffix} FROM member m
JOIN (SELECT customer_key, count(*) AS n FROM reader_fact WHERE date_key >= {since} GROUP BY 1) b USING (customer_key)
JOIN (SELECT customer_key, sum(milliseconds_spent // 1000 // 60) AS t FROM read_duration_fact WHERE read_duration_date_key >= {since} GROUP BY 1) s USING (customer_key)
WHERE m.streaming_benefit = 'Yes'"""


_USAGE_VIEWS = ("member", "reader_fact", "read_duration_fact")
oracle("member_usage", _usage(20240101, ""), *_USAGE_VIEWS)
oracle("member_usage_recent", _usage(20240115, ""), *_USAGE_VIEWS)
oracle("top_members", f"""
SELECT email, n_buckets_recent, total_minutes_recent, n_buckets_ytd, total_minutes_ytd FROM (SELECT *, rank() OVER (ORDER BY total_minutes_ytd DESC) AS r
 FROM ({_usage(20240115, '_recent')}) JOIN ({_usage(20240101, '_ytd')}) USING (email)) WHERE r <= 40""", *_USAGE_VIEWS)

# ---- densities -----------------------------------------------------------------------------


def _curves(points: str, group: str | None, shared: bool, min_rows: int) -> tuple[str, list[tuple[str, str]]]:
    """Density SQL over a table of (group, secs): bandwidth rule, grid and kernel sums."""
    key = group or "0"
    g = f"{group}, " if group else ""
    extra = [
        ("pts", f"SELECT {key} AS g, secs, count(*) AS w FROM ({points}) WHERE secs IS NOT NULL GROUP BY 1, 2"),
        ("widths", f"""SELECT {key} AS g, count(*) AS n, min(secs) AS lo, max(secs) AS hi,
  CASE WHEN count(*) > 1 THEN 0.9 * CASE WHEN stddev_samp(secs) = 0 THEN CASE WHEN min(secs) <> 0 THEN abs(min(secs)) ELSE 1 END
    WHEN quantile_cont(secs, 0.75) = quantile_cont(secs, 0.25) THEN stddev_samp(secs)
    ELSE least(stddev_samp(secs), (quantile_cont(secs, 0.75) - quantile_cont(secs, 0.25)) / 1.34) END * pow(count(*), -0.2) END AS bw
  FROM ({points}) WHERE secs IS NOT NULL GROUP BY 1"""),
        ("frame", "SELECT min(lo) AS lo, max(hi) AS hi, avg(bw) AS bw FROM widths"),
    ]
    if shared:
        grid = "f.lo - 3 * f.bw + i.range * (f.hi - f.lo + 6 * f.bw) / 511.0"
        width = "f.bw"
    else:
        grid = "f.lo + i.range * (f.hi - f.lo) / 511.0"
        width = "w.bw"
    extra.append(("grid", f"""SELECT w.g, w.n, CAST(i.range AS INT) AS point, {grid} AS x, {width} AS bw
  FROM widths w, frame f, range(512) i WHERE w.n >= {min_rows}"""))
    extra.append(("curves", """SELECT r.g, r.point, r.x, sum(p.w * exp(-0.5 * pow((r.x - p.secs) / r.bw, 2))) / (any_value(r.n) * any_value(r.bw) * sqrt(2 * pi())) AS density
  FROM grid r JOIN pts p ON p.g = r.g GROUP BY 1, 2, 3"""))
    named = f"g AS {group}, " if group else ""
    del g
    return f"SELECT {named}point, round(x,6) AS x, round(density * 86400,6) AS density FROM curves", extra


def density_oracle(name: str, points: str, group: str | None, shared: bool, min_rows: int, *needs: str) -> None:
    body, extra = _curves(points, group, shared, min_rows)
    oracle(name, body, *needs, extra=extra)


density_oracle("start_time_density", "SELECT secs FROM starts", None, False, 2, "starts")
density_oracle("den3_density_per_weekday", "SELECT weekday, secs FROM cust", "weekday", False, 2, "cust")
density_oracle("country_time_density", "SELECT region, secs FROM countries LEFT JOIN starts USING (user_country)", "region", True, 3, "countries", "starts")
density_oracle("country_time_density_without_one", """
SELECT region, secs FROM countries LEFT JOIN starts USING (user_country) WHERE user_country <> 'N0'""", "region", True, 3, "countries", "starts")
density_oracle("category_time_density", """
SELECT regexp_replace(level1_danish, 'Bøger\\|', '') AS category, secs FROM themed WHERE level1_danish IS NOT NULL""", "category", True, 3, "themed")
density_oracle("customer_time_density", "SELECT customer_key, secs FROM cust", "customer_key", True, 3, "cust")

_, _start_extra = _curves("SELECT secs FROM starts", None, False, 2)
oracle("start_time_peak", """
SELECT s AS peak_secs, t AS peak_time, 'Peak: ' || t || ' (UTC)' AS label FROM
 (SELECT s, strftime(TIMESTAMP '2024-01-01' + to_seconds(s), '%H:%M:%S') AS t FROM
  (SELECT CAST(round_even(x, 0) AS INT) AS s FROM curves ORDER BY density DESC, x LIMIT 1))""", "starts", extra=_start_extra)

# ---- features, clusters, peaks -------------------------------------------------------------

oracle("hour_share_features", "SELECT customer_key, " + ", ".join(f"round(h{h},6) AS h{h}" for h in range(24)) + " FROM hour_shares", "hour_shares")
oracle("band_share_features", "SELECT customer_key, " + ", ".join(f"round({b},6) AS {b}" for b in BANDS) + " FROM band_shares", "band_shares")
oracle("ml1_scaled_band_shares", "SELECT customer_key, " + ", ".join(f"round({b}_scaled,6) AS {b}_scaled" for b in BANDS) + " FROM band_scaled", "band_scaled")
oracle("ml1_scaled_with_nulls", "SELECT customer_key, time_1, time_2, " + ", ".join(
    f"round((time_{i} - avg(time_{i}) OVER ()) / stddev_samp(time_{i}) OVER (), 6) AS time_{i}_scaled" for i in (1, 2)) + " FROM habit_peaks", "habit_peaks")
oracle("ml3_nearest_given_centroid", "SELECT customer_key, cluster FROM given_assigned", "given_assigned")
oracle("ml4_given_centroids", "SELECT centroid, " + ", ".join(f"round({b},6) AS {b}" for b in BANDS) + " FROM given", "given")
oracle("ml5_total_spread", "SELECT 1 AS centroids, round(" + " + ".join(
    f"var_pop({b}_scaled) * count(*)" for b in BANDS) + ", 6) AS wss FROM band_scaled", "band_scaled")
oracle("ml7_spread_per_cluster", "SELECT cluster, count(*) AS n, round((" + " + ".join(
    f"var_pop({b})" for b in BANDS) + ") * count(*), 6) AS wss FROM given_assigned GROUP BY 1", "given_assigned")

oracle("regularity_features", """
SELECT customer_key, median_time, round(sd_time,6) AS sd_time, round(median_scaled,6) AS median_scaled, round(sd_scaled,6) AS sd_scaled
FROM regularity""", "regularity")

oracle("centroid_profile", "SELECT *, CAST(row_number() OVER (PARTITION BY centroid ORDER BY list_position([" + ", ".join(
    f"'{b}'" for b in BANDS) + "], name)) AS INT) AS row FROM (" + " UNION ALL ".join(
    f"SELECT centroid, '{b}' AS name, round({b},6) AS value FROM given" for b in BANDS) + ")", "given")
oracle("hour_centroid_profile", " UNION ALL ".join(
    f"SELECT CAST(customer_key % 3 + 1 AS INT) AS centroid, {h} AS name, round(avg(h{h}),6) AS value FROM hour_shares GROUP BY 1" for h in range(24)), "hour_shares")


def _centres(cutoff: float, standardise: bool) -> list[tuple[str, str]]:
    """Best one, two or three intervals of each customer's seconds, by trying all borders."""
    cost = "CAST({0}q - {1}q AS DOUBLE) - CAST({0}s - {1}s AS DOUBLE) * CAST({0}s - {1}s AS DOUBLE) / CAST({0}w - {1}w AS DOUBLE)"
    ab, bc, ca, cb = (cost.format(x, y) for x, y in (("e.", "a."), ("e.", "b."), ("a.", "z."), ("b.", "a.")))
    whole = cost.format("e.", "z.")
    return [
        ("pt", """SELECT customer_key AS k, secs, count(*) AS w FROM cust WHERE secs IS NOT NULL AND customer_key IN
  (SELECT customer_key FROM cust GROUP BY 1 HAVING count(DISTINCT secs) + max(CASE WHEN secs IS NULL THEN 1 ELSE 0 END) >= 20) GROUP BY 1, 2"""),
        ("cum", """SELECT k, row_number() OVER o AS i, CAST(sum(w) OVER o AS BIGINT) AS w, CAST(sum(w*(secs-43200)) OVER o AS BIGINT) AS s,
  CAST(sum(w*(secs-43200)*CAST(secs-43200 AS BIGINT)) OVER o AS BIGINT) AS q, secs FROM pt WINDOW o AS (PARTITION BY k ORDER BY secs)"""),
        ("zero", "SELECT DISTINCT k, 0 AS i, CAST(0 AS BIGINT) AS w, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS q FROM pt"),
        ("ends", "SELECT * FROM cum QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1"),
        ("one", f"SELECT e.k, {whole} AS c FROM ends e JOIN zero z USING (k)"),
        ("two", f"""SELECT e.k, a.i AS a, {ca} + {ab} AS c FROM ends e JOIN zero z USING (k) JOIN cum a ON a.k = e.k AND a.i < e.i
  QUALIFY row_number() OVER (PARTITION BY e.k ORDER BY c, a.i) = 1"""),
        ("three", f"""SELECT e.k, a.i AS a, b.i AS b, {ca} + {cb} + {bc} AS c FROM ends e JOIN zero z USING (k) JOIN cum a ON a.k = e.k AND a.i < e.i
  JOIN cum b ON b.k = e.k AND b.i > a.i AND b.i < e.i QUALIFY row_number() OVER (PARTITION BY e.k ORDER BY c, a.i, b.i) = 1"""),
        ("cuts", f"""SELECT o.k, o.c / (e.w - 1) AS variance,
  CASE WHEN 1 - t.c / o.c > {cutoff} THEN CASE WHEN 1 - h.c / t.c > {cutoff} THEN h.a ELSE t.a END END AS a,
  CASE WHEN 1 - t.c / o.c > {cutoff} AND 1 - h.c / t.c > {cutoff} THEN h.b END AS b
  FROM one o JOIN two t USING (k) JOIN three h USING (k) JOIN ends e USING (k)"""),
        ("tagged", """SELECT p.k, p.secs, p.w - coalesce(l.w, 0) AS w, u.variance,
  CAST(CASE WHEN u.a IS NULL OR p.i <= u.a THEN 1 WHEN u.b IS NULL OR p.i <= u.b THEN 2 ELSE 3 END AS INT) AS centroid
  FROM cum p JOIN cuts u USING (k) LEFT JOIN cum l ON l.k = p.k AND l.i = p.i - 1"""),
        ("mids", "SELECT k, centroid, sum(w * secs) / CAST(sum(w) AS DOUBLE) AS m FROM tagged GROUP BY 1, 2"),
        ("centres", f"""SELECT t.k AS customer_key, t.centroid, any_value(m.m) AS secs, sum(t.w * (t.secs - m.m) * (t.secs - m.m)) / any_value({'t.variance' if standardise else '1'}) AS wss,
  CAST(sum(t.w) AS BIGINT) AS size FROM tagged t JOIN mids m ON m.k = t.k AND m.centroid = t.centroid GROUP BY 1, 2"""),
    ]


for _name, _cutoff, _std in (("udf1_customer_centers", 0.8, True), ("udf1_customer_centers_fine", 0.55, False)):
    _wss = "round(wss,6)" if _std else "round(wss)"
    oracle(_name, f"SELECT customer_key, centroid, round(secs,6) AS secs, {_wss} AS wss, size FROM centres", "cust", extra=_centres(_cutoff, _std))

_PEAKS = [
    ("graded", """SELECT customer_key, centroid, CAST(round_even(secs / 2, 0) * 2 AS INT) AS t,
  CAST(ntile(5) OVER (ORDER BY round(wss,6), customer_key, centroid) AS INT) AS w FROM centres"""),
    ("peak_rows", "SELECT customer_key, " + ", ".join(
        f"max(t) FILTER (centroid = {i}) AS time_{i}, max(w) FILTER (centroid = {i}) AS wss_{i}" for i in (1, 2, 3)) + " FROM graded GROUP BY 1"),
    ("peaks", """SELECT customer_key, day_mode, time_1, wss_1, time_2, wss_2, time_3, wss_3
  FROM (SELECT * FROM peak_rows LEFT JOIN day_modes USING (customer_key)) FULL JOIN (SELECT DISTINCT customer_key FROM cust) USING (customer_key)"""),
]
for _name, _cutoff in (("customer_peaks", 0.8), ("customer_peaks_fine", 0.55)):
    oracle(_name, "SELECT * FROM peaks", "cust", "day_modes", extra=_centres(_cutoff, True) + _PEAKS)
oracle("habit_type_of_events", "SELECT customer_key, weekday, time_type FROM (" + VIEWS["habits"].replace("habit_peaks", "peaks") + ")",
       "cust", "day_modes", extra=_centres(0.55, True) + _PEAKS)

# ---- habits, preferences, profiles ---------------------------------------------------------

oracle("habit_type", "SELECT * FROM habits", "habits")
_CHOSEN = f"(SELECT customer_key FROM habits ORDER BY {checksum('customer_key')}, 1 LIMIT 30)"
oracle("peak_points_long", " UNION ALL ".join(
    f"SELECT customer_key, 'time_{i}' AS name, time_{i} AS value FROM habits WHERE customer_key IN {_CHOSEN}" for i in (1, 2, 3)), "habits")
oracle("content_counts", "SELECT customer_key, type, genre_level1, n FROM content", "content")
oracle("format_preference", "SELECT customer_key, round(lyd_ratio,6) AS lyd_ratio, format FROM formats", "formats")
oracle("genre_preference", "SELECT customer_key, round(fiction_ratio,6) AS fiction_ratio, litt_pref FROM genres", "genres")
oracle("customer_profiles", "SELECT * FROM profile", "profile")
oracle("profile_counts", """
SELECT time_type, weekday, format, litt_pref, count(*) AS n,
  coalesce(time_type,'NA') || ' - ' || coalesce(weekday,'NA') || ' - ' || coalesce(format,'NA') || ' - ' || coalesce(litt_pref,'NA') AS segment
FROM profile GROUP BY ALL""", "profile")
oracle("segment_feature_table", "SELECT h.time_1, h.time_2, " + ", ".join(f"round(b.{b},6) AS {b}" for b in BANDS) + """,
  CAST(b.customer_key % 3 + 1 AS INT) AS segment1, CAST(b.customer_key % 6 + 1 AS INT) AS segment2
FROM habits h JOIN band_shares b USING (customer_key)""", "habits", "band_shares")

_PROFILE = ["time_type", "weekday", "format", "litt_pref"]
_ROUNDS = 12


def _modes(k: int) -> list[tuple[str, str]]:
    """k-modes from the k most frequent profiles, a fixed number of rounds past convergence."""
    order = ", ".join(f"{c} NULLS LAST" for c in _PROFILE)
    columns = ", ".join(_PROFILE)
    distance = " + ".join(f"CASE WHEN p.{c} IS NOT DISTINCT FROM m.{c} THEN 0 ELSE 1 END" for c in _PROFILE)
    steps = [
        ("counted", f"SELECT {columns}, count(*) AS n FROM profile GROUP BY ALL"),
        ("modes0", f"SELECT {columns}, CAST(row_number() OVER (ORDER BY n DESC, {order}) AS INT) AS cluster FROM counted QUALIFY cluster <= {k}"),
    ]
    for i in range(_ROUNDS):
        steps.append((f"near{i}", f"""SELECT p.*, m.cluster, {distance} AS d FROM counted p, modes{i} m
  QUALIFY row_number() OVER (PARTITION BY {', '.join('p.' + c for c in _PROFILE)} ORDER BY {distance}, m.cluster) = 1"""))
        picks = " ".join(
            f"LEFT JOIN (SELECT cluster, {c} AS v FROM near{i} GROUP BY cluster, {c} QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY sum(n) DESC, {c} NULLS LAST) = 1) j{j} ON j{j}.cluster = m.cluster"
            for j, c in enumerate(_PROFILE)
        )
        kept = ", ".join(f"CASE WHEN j{j}.cluster IS NULL THEN m.{c} ELSE j{j}.v END AS {c}" for j, c in enumerate(_PROFILE))
        steps.append((f"modes{i + 1}", f"SELECT {kept}, m.cluster FROM modes{i} m {picks}"))
    steps.append(("final", f"""SELECT p.*, m.cluster, {distance} AS d, concat_ws(' - ', {', '.join(f"coalesce(m.{c},'NA')" for c in _PROFILE)}) AS segment
  FROM counted p, modes{_ROUNDS} m
  QUALIFY row_number() OVER (PARTITION BY {', '.join('p.' + c for c in _PROFILE)} ORDER BY {distance}, m.cluster) = 1"""))
    return steps


_SAME = " AND ".join(f"p.{c} IS NOT DISTINCT FROM f.{c}" for c in _PROFILE)
oracle("profile_segments", f"SELECT p.*, f.cluster, f.segment FROM profile p JOIN final f ON {_SAME}", "profile", extra=_modes(3))

# One row per number of modes: the mean over clusters of the summed distances.
_ELBOW = 15
_parts, _extra = [], []
for _k in range(1, _ELBOW + 1):
    _steps = _modes(_k)
    for _n, _text in _steps[1:] if _extra else _steps:
        for _table in ("modes", "near"):
            _text = _text.replace(f" {_table}", f" e{_k}_{_table}")
        _extra.append((_n if _n == "counted" else f"e{_k}_{_n}", _text))
    _parts.append(f"SELECT {_k} AS modes, round(sum(d * n) / {_k}.0, 6) AS mean_within FROM e{_k}_final")
oracle("ml9_modes_elbow", " UNION ALL ".join(_parts), "profile", extra=_extra)

# ---- k-means: fits by recursion ------------------------------------------------------------

_BAND_COLUMNS = [f"{b}_scaled" for b in BANDS]
_HOUR_COLUMNS = [f"h{h}_scaled" for h in range(24)]
_REGULAR_COLUMNS = ["median_scaled", "sd_scaled"]


def _whole(view: str) -> str:
    return f"SELECT 1 AS part, * FROM {view}"


def _elbow_oracle(name: str, view: str, columns: list[str]) -> None:
    steps = cluster.fixed(_whole(view), columns, range(1, 26))
    oracle(name, "SELECT CAST(k AS INT) AS centroids, round(wss, 6) AS wss FROM km_fit", view, extra=steps)


_BAND_FITS = cluster.fixed(_whole("band_scaled"), _BAND_COLUMNS, [3, 6])
_BAND_NUMBERS = ", ".join(f"{cluster.numbered(_BAND_COLUMNS, f'k = {k}')} AS segment{i}" for i, k in ((1, 3), (2, 6)))
oracle("ml2_ml4_fitted_centroids", cluster.centre_rows(_BAND_COLUMNS, _BAND_COLUMNS), "band_scaled",
       extra=cluster.fixed(_whole("band_scaled"), _BAND_COLUMNS, [3]))
oracle("ml6_estimated_centroids", cluster.centre_rows(_BAND_COLUMNS, _BAND_COLUMNS), "band_scaled",
       extra=cluster.estimated(_whole("band_scaled"), _BAND_COLUMNS, 10))
_elbow_oracle("elbow_curve", "band_scaled", _BAND_COLUMNS)
_elbow_oracle("elbow_curve_hours", "hour_scaled", _HOUR_COLUMNS)
_elbow_oracle("elbow_curve_regularity", "regularity", _REGULAR_COLUMNS)
oracle("band_segments", "SELECT customer_key, " + ", ".join(f"round({b}, 6) AS {b}" for b in BANDS)
       + f", {_BAND_NUMBERS} FROM band_shares JOIN band_scaled USING (customer_key)", "band_scaled", extra=_BAND_FITS)
oracle("segment_feature_table_fitted", "SELECT h.time_1, h.time_2, " + ", ".join(f"round({b}, 6) AS {b}" for b in BANDS)
       + f", {_BAND_NUMBERS} FROM habits h JOIN band_shares USING (customer_key) JOIN band_scaled USING (customer_key)",
       "habits", "band_scaled", extra=_BAND_FITS)
oracle("hour_segments", "SELECT customer_key, " + ", ".join(f"round(h{h}, 6) AS h{h}" for h in range(24))
       + f", {cluster.numbered(_HOUR_COLUMNS)} AS segment FROM hour_shares JOIN hour_scaled USING (customer_key)", "hour_scaled",
       extra=cluster.estimated(_whole("hour_scaled"), _HOUR_COLUMNS, 10))
oracle("regularity_segments", "SELECT customer_key, " + ", ".join(
    c if c == "median_time" else f"round({c}, 6) AS {c}" for c in ("median_time", "sd_time", "median_scaled", "sd_scaled"))
    + f", {cluster.numbered(_REGULAR_COLUMNS)} AS cluster FROM regularity", "regularity", extra=cluster.fixed(_whole("regularity"), _REGULAR_COLUMNS, [4]))
oracle("cluster_stability", cluster.centre_rows(_BAND_COLUMNS, _BAND_COLUMNS, part="CAST(part AS INT) AS replicate, "), "band_scaled",
       extra=cluster.estimated(
           f"SELECT r.part, b.* FROM band_scaled b, (SELECT unnest(range(1, 11)) AS part) r WHERE {position('customer_key', '(62 + r.part)')} < 0.75",
           _BAND_COLUMNS, 3))

# Counts stored by day give what the events give.
for _stored, _same in (
    ("stored_counts_habit_profile", "customer_habit_profile"),
    ("stored_counts_typical_slot", "typical_slot"),
    ("stored_counts_regularity_features", "regularity_features"),
    ("stored_counts_band_shares", "band_share_features"),
    ("stored_counts_customer_peaks", "customer_peaks"),
):
    ORACLES[_stored] = ORACLES[_same]
