"""The same questions as ``rollcall.queries``, as DuckDB SQL over the test tables.

Written independently of the Spark side: plain SQL with window functions where the
Spark side uses an operator. Output column names and types match the Spark keys.
"""

from __future__ import annotations

_NULLED_DATES = ("(SELECT CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS log_date "
                 "FROM orders)")

_ROLE_KEYS = ("(SELECT l_partkey AS key FROM lineitem "
              "UNION ALL SELECT nullif(l_suppkey, 0) FROM lineitem)")

_DISTINCT_KEYS = f"SELECT DISTINCT key FROM {_ROLE_KEYS} k WHERE key IS DISTINCT FROM 1"

_SPINE = ("SELECT CAST(unnest(generate_series(DATE '2024-01-01', "
          "(SELECT CAST(MAX(ts) AS DATE) + 1 FROM events), INTERVAL 1 DAY)) AS DATE) AS d")

_LEAVE_BASE = """
  SELECT CAST(ts AS DATE) AS reportdate,
         CASE WHEN k >= 50 THEN 'Y' WHEN k >= 20 THEN 'N' END AS active_status,
         CAST(user_id AS VARCHAR) AS emp_id,
         CASE WHEN value >= 25 THEN 'EL' ELSE 'CL' END AS leave_type,
         event_type AS reason, 'hr' AS created_by, strftime(ts, '%Y-%m-%d') AS creation_date,
         event_type
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) e"""

_TITLE = "array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"

SQL: dict[str, str] = {
    "hwm_next_date":
        "SELECT CAST(CAST(MAX(o_orderdate) AS DATE) + 1 AS DATE) AS next_date FROM orders",
    "hwm_next_date_nulls":
        f"SELECT CAST(MAX(log_date) + 1 AS DATE) AS next_date FROM {_NULLED_DATES} t",
    "latest_date":
        "SELECT CAST(o_orderdate AS DATE) AS log_date FROM orders ORDER BY o_orderdate DESC NULLS FIRST LIMIT 1",
    "latest_date_nulls":
        f"SELECT log_date FROM {_NULLED_DATES} t ORDER BY log_date DESC NULLS FIRST LIMIT 1",
    "date_spine": _SPINE,
    "envelope_explode": """
        SELECT event_id, event_type, CAST(ts AS DATE) AS reportdate, event_id // 1000 AS page,
               CAST(row_number() OVER (PARTITION BY CAST(ts AS DATE), event_id // 1000
                                        ORDER BY event_id) - 1 AS INTEGER) AS _pos
        FROM events""",
    "json_field":
        "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
    "distinct_keys": _DISTINCT_KEYS,
    "keyed_lookup": f"""
        WITH k AS ({_DISTINCT_KEYS})
        SELECT p_partkey, p_name FROM part
        WHERE EXISTS (SELECT 1 FROM k WHERE k.key IS NOT DISTINCT FROM part.p_partkey)""",
    "request_manifest": """
        SELECT DISTINCT concat('events/reportdate=', strftime(ts, '%Y-%m-%d'), '/event=', event_type) AS path
        FROM events""",
    "manifest_not_landed": f"""
        WITH spine AS ({_SPINE}),
             wanted AS (SELECT DISTINCT concat('events/reportdate=', strftime(d, '%Y-%m-%d')) AS path FROM spine),
             landed AS (SELECT DISTINCT concat('events/reportdate=', strftime(ts, '%Y-%m-%d')) AS path FROM events)
        SELECT path FROM wanted WHERE path NOT IN (SELECT path FROM landed)""",
    "select_rename":
        "SELECT p_partkey AS part_id, p_name AS in_location FROM part",
    "active_filter":
        "SELECT event_id, user_id, event_type FROM events WHERE nullif(event_type, 'view') = 'click'",
    "not_null_filter":
        "SELECT c_custkey, c_mktsegment FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NOT NULL",
    "non_empty_gate":
        "SELECT count(*) > 0 AS has_rows FROM events WHERE event_type = 'nope'",
    "non_empty_gate_hit":
        "SELECT count(*) > 0 AS has_rows FROM events WHERE event_type = 'click'",
    "null_safe_left_join": """
        SELECT o.o_orderkey, nullif(c.c_nationkey, 0) AS fk, n.n_name AS loc
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
        LEFT JOIN nation n ON nullif(c.c_nationkey, 0) IS NOT DISTINCT FROM nullif(n.n_nationkey, 24)""",
    "role_playing_join": """
        SELECT l.l_orderkey, l.l_linenumber, nc.n_name AS c_loc, ns.n_name AS s_loc
        FROM lineitem l
        JOIN orders o ON l.l_orderkey = o.o_orderkey
        JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN supplier s ON l.l_suppkey = s.s_suppkey
        LEFT JOIN nation nc ON nullif(c.c_nationkey, 0) IS NOT DISTINCT FROM nullif(nc.n_nationkey, 24)
        LEFT JOIN nation ns ON nullif(s.s_nationkey, 0) IS NOT DISTINCT FROM nullif(ns.n_nationkey, 24)""",
    "join_fanout": """
        WITH dim AS (
            SELECT nullif(n_nationkey, 24) AS dk, n_name AS loc FROM nation
            UNION ALL
            SELECT nullif(n_nationkey, 24), r_name FROM nation JOIN region ON n_regionkey = r_regionkey
            WHERE r_name = 'ASIA')
        SELECT s.s_suppkey, nullif(s.s_nationkey, 0) AS fk, dim.loc
        FROM supplier s LEFT JOIN dim ON nullif(s.s_nationkey, 0) IS NOT DISTINCT FROM dim.dk""",
    "distinct_rows":
        "SELECT DISTINCT nullif(p_type, 'SMALL') AS t, p_size FROM part",
    "union_by_name": """
        SELECT event_id, user_id, event_type, CAST(NULL AS DOUBLE) AS value FROM events WHERE event_type = 'click'
        UNION ALL
        SELECT event_id, user_id, event_type, value FROM events WHERE event_type <> 'click'""",
    "leave_tour_refresh": f"""
        WITH base AS ({_LEAVE_BASE}),
             feeds AS (
               SELECT reportdate, active_status, emp_id, leave_type, reason, created_by, creation_date
               FROM base WHERE event_type = 'click'
               UNION ALL
               SELECT reportdate, active_status, emp_id, NULL, reason, created_by, creation_date
               FROM base WHERE event_type <> 'click')
        SELECT DISTINCT reportdate AS date, emp_id, leave_type, reason, created_by, creation_date
        FROM feeds WHERE active_status = 'Y'""",
    "title_case":
        "SELECT DISTINCT " + _TITLE.format(x="p_type || ' ' || p_name") + " AS t FROM part",
    "remove_first":
        "SELECT p_partkey, regexp_replace(p_type || ' Ng Ng', ' Ng', '') AS d FROM part",
    "if_else_null": """
        SELECT p_partkey,
               CASE WHEN nullif(p_brand, 'Brand#2') = 'Brand#4' THEN p_name
                    WHEN NOT (nullif(p_brand, 'Brand#2') = 'Brand#4') THEN p_type END AS v
        FROM part""",
    "normalise_category": """
        SELECT p_partkey,
               CASE WHEN nullif(p_type, 'SMALL') IN ('ECONOMY', 'PROMO') THEN 'Faculty'
                    WHEN nullif(p_type, 'SMALL') IN ('LARGE') THEN 'Senior'
                    ELSE 'Other' END AS cat
        FROM part""",
    "format_date":
        "SELECT DISTINCT strftime(o_orderdate, '%d %b %Y') AS d FROM orders",
    "emp_upsert": """
        WITH u AS (
            SELECT o_custkey AS c_custkey, o_orderpriority AS seg, 0 AS src,
                   CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 10 END AS page, o_orderkey AS ord
            FROM orders
            UNION ALL
            SELECT c_custkey, c_mktsegment, 1, 0, 0 FROM customer)
        SELECT c_custkey, seg, src FROM (
            SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY src, page, ord) AS rn FROM u) r
        WHERE rn = 1""",
    "append_day":
        "SELECT event_id, event_type, CAST(ts AS DATE) AS reportdate FROM events",
    "load_marks": """
        SELECT CAST(ts AS DATE) AS reportdate,
               CAST(MAX(CASE WHEN event_type <> 'error' THEN CAST(ts AS DATE) END) AS DATE) AS max_date,
               count(*) FILTER (WHERE event_type = 'error') AS missing_dates,
               count(*) AS rows
        FROM events GROUP BY CAST(ts AS DATE)""",
    "latest_loaded_date": """
        SELECT CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN NULL
                    ELSE MAX(CAST(ts AS DATE)) END AS last_date
        FROM events""",
    "attendance_load": """
        WITH att AS (
            SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS emp_id,
                   strftime(l_shipdate, '%Y-%m-%d') AS log_date,
                   CAST(l_partkey AS VARCHAR) AS in_device_id,
                   CASE WHEN l_returnflag = 'N' THEN ''
                        WHEN l_returnflag = 'A' THEN CAST(l_suppkey AS VARCHAR) END AS out_device_id,
                   CAST(l_shipdate AS DATE) AS reportdate
            FROM lineitem),
        dev AS (
            SELECT CAST(p_partkey AS VARCHAR) AS device_id,
                   CASE WHEN lpad(CAST(p_size AS VARCHAR), 6, '0') = '000046' THEN p_name
                        ELSE """ + _TITLE.format(x="p_type") + """ END AS entry_name
            FROM part)
        SELECT att.emp_id, att.log_date, att.in_device_id, att.out_device_id,
               di.entry_name AS in_location, dout.entry_name AS out_location, att.reportdate
        FROM att
        LEFT JOIN dev di ON att.in_device_id IS NOT DISTINCT FROM di.device_id
        LEFT JOIN dev dout ON att.out_device_id IS NOT DISTINCT FROM dout.device_id""",
    "employee_normalise": """
        SELECT CAST(c_custkey AS VARCHAR) AS emp_id,
               """ + _TITLE.format(x="c_name") + """ AS emp_name,
               regexp_replace(""" + _TITLE.format(x="c_mktsegment || ' NG NG'") + """, ' Ng', '') AS designation,
               """ + _TITLE.format(x="c_mktsegment") + """ AS division,
               CASE WHEN regexp_replace(""" + _TITLE.format(x="c_mktsegment || ' NG NG'") + """, ' Ng', '')
                         IN ('Assistant Professor', 'Statistician', 'Associate Professor', 'Professor') THEN 'Faculty'
                    WHEN regexp_replace(""" + _TITLE.format(x="c_mktsegment || ' NG NG'") + """, ' Ng', '')
                         IN ('Junior Resident', 'Tutor') THEN 'Junior Resident'
                    WHEN regexp_replace(""" + _TITLE.format(x="c_mktsegment || ' NG NG'") + """, ' Ng', '')
                         IN ('Senior Resident') THEN 'Senior Resident'
                    ELSE 'Other' END AS cat
        FROM customer WHERE c_acctbal >= 0""",
    "holiday_replace":
        "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "attendance_stream": """
        WITH att AS (
            SELECT CAST(user_id AS VARCHAR) AS emp_id, strftime(ts, '%Y-%m-%d') AS log_date,
                   CAST(user_id AS VARCHAR) AS in_device_id,
                   CASE WHEN event_type = 'error' THEN ''
                        WHEN event_type <> 'view' THEN CAST(CAST(json_extract(props, '$.k') AS INTEGER) AS VARCHAR)
                   END AS out_device_id,
                   CAST(ts AS DATE) AS reportdate
            FROM events),
        dev AS (
            SELECT CAST(c_custkey AS VARCHAR) AS device_id,
                   CASE WHEN lpad(CAST(c_nationkey AS VARCHAR), 6, '0') = '000046' THEN c_name
                        ELSE """ + _TITLE.format(x="c_mktsegment") + """ END AS entry_name
            FROM customer)
        SELECT att.emp_id, att.log_date, att.in_device_id, att.out_device_id,
               di.entry_name AS in_location, dout.entry_name AS out_location, att.reportdate
        FROM att
        LEFT JOIN dev di ON att.in_device_id IS NOT DISTINCT FROM di.device_id
        LEFT JOIN dev dout ON att.out_device_id IS NOT DISTINCT FROM dout.device_id""",
}
# The windowed rebuild must give exactly the full rebuild's rows.
SQL["leave_tour_refresh_window"] = SQL["leave_tour_refresh"]
SQL["role_playing_join_salted"] = SQL["role_playing_join"]
SQL["envelope_landing_scan"] = """
    SELECT event_id, event_type, CAST(ts AS DATE) AS reportdate,
           CAST(row_number() OVER (PARTITION BY CAST(ts AS DATE), event_id // 1000
                                    ORDER BY event_id) - 1 AS INTEGER) AS _pos
    FROM events"""
# The public loads, run from landed envelopes to stored tables, give the transforms' rows.
SQL["attendance_mixed"] = SQL["attendance_stream"]
SQL["leave_gap_refresh"] = SQL["leave_tour_refresh"]
SQL["employee_landing"] = SQL["employee_normalise"]
SQL["holiday_landing"] = "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation"
SQL["attendance_late_pages"] = SQL["attendance_stream"]
SQL["leave_changed_days"] = SQL["leave_tour_refresh"]
SQL["keyed_bucket_scan"] = SQL["keyed_lookup"]
SQL["emp_upsert_view"] = SQL["emp_upsert"]
SQL["employee_buckets"] = SQL["employee_normalise"]
SQL["attendance_gate"] = """
    SELECT CAST(ts AS DATE) AS reportdate, CASE WHEN CAST(ts AS DATE) <> DATE '2024-01-10' THEN count(*) END AS rows,
           CASE WHEN CAST(ts AS DATE) = DATE '2024-01-10' THEN CAST(1 AS BIGINT) END AS missing_page
    FROM events GROUP BY CAST(ts AS DATE)"""
SQL["attendance_misdated"] = """
    WITH days AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1)
    SELECT 'ahead' AS what, DATE '2024-01-05' AS reportdate, DATE '2042-01-01' AS max_date, CAST(NULL AS BIGINT) AS rows
    UNION ALL SELECT 'behind', d, NULL, NULL FROM days WHERE d > DATE '2024-01-10'
    UNION ALL SELECT 'stored', d, CASE WHEN d = DATE '2024-01-05' THEN DATE '2042-01-01' ELSE d END, n FROM days"""
SQL["stored_days_columns"] = """
    SELECT event_id, event_type, CASE WHEN CAST(ts AS DATE) > DATE '2024-01-15' THEN value END AS value,
           CAST(ts AS DATE) AS reportdate
    FROM events"""
SQL["manifest_pages"] = """
    SELECT reportdate, page + 1 AS page,
           concat('events/reportdate=', strftime(reportdate, '%Y-%m-%d'), '/offset=', page * 100, '/count=100') AS path
    FROM (SELECT reportdate, unnest(range(0, (n + 99) // 100)) AS page
          FROM (SELECT CAST(ts AS DATE) AS reportdate, count(*) AS n FROM events GROUP BY 1) t) p"""
SQL["records_scan"] = """
    SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name,
           CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS _pos FROM nation"""


def _content(name: str, sql: str, columns: list[str]) -> str:
    """Rows and content sum of a stored table, as the daily run's key reports them."""
    text = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in sorted(columns))
    return (f"SELECT '{name}' AS table_name, count(*) AS rows, "
            f"CAST(sum(CAST('0x' || left(md5({text}), 8) AS BIGINT)) AS BIGINT) AS content FROM ({sql}) t")


SQL["daily_run"] = " UNION ALL ".join([
    _content("attendance", SQL["attendance_stream"], ["emp_id", "log_date", "in_device_id", "out_device_id",
                                                      "in_location", "out_location", "reportdate"]),
    _content("leave", SQL["leave_tour_refresh"], ["date", "emp_id", "leave_type", "reason", "created_by", "creation_date"]),
    _content("employee", SQL["employee_normalise"], ["emp_id", "emp_name", "designation", "division", "cat"]),
    _content("holiday", "SELECT '2024-01-26' AS holiday_date, n_name AS holiday_name FROM nation",
             ["holiday_date", "holiday_name"])])
