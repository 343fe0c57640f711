"""The operator checks over the shared test tables, one function per key.

Each function takes ``(spark, sf_dir)`` and returns a DataFrame; ``rollcall.oracle``
holds the same question as DuckDB SQL. The TPC-H-like tables stand in for the
attendance feeds: a role-playing join of lineitem against nation plays "where did
each record enter and leave", orders are the employee feed, events the leave feed.
Every key reads whole tables. Nulls, duplicates and unmatched keys are made with
``nullif`` / ``case`` on data values, never by dropping rows.
Keys that write (append, replace, upsert) write to a fresh folder under the
session's shared folder (``spark.checkpoint.dir``) and return the table read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.functions import category, format_day, if_else, iso_text, remove_first, title_case
from rollcall.operators import (
    bind_by_name, date_spine, distinct_keys, has_rows, latest_date, left_join_null_safe,
    lookup_keys, next_load_date, role_join,
)
from rollcall.plans import enrich_attendance, leave_history, merge_employees
from rollcall.session import scratch_path
from rollcall.sinks import append_day, read_days, read_table, replace_table, replace_versioned
from rollcall.sources import explode_envelope, json_field, not_landed, request_manifest

QueryFn = Callable[[SparkSession, str], DataFrame]

# The leave history's fixed first day; the events table covers January 2024.
SPINE_START = "2024-01-01"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _nation_dim(spark, sf_dir) -> DataFrame:
    # Nation as a location dimension; key 24 made missing so a null fact key can match it.
    n = _t(spark, sf_dir, "nation")
    return n.select(F.nullif(F.col("n_nationkey"), F.lit(24)).alias("dk"), F.col("n_name"))


# -- marks (R1 C6 C7 S6, T1) -------------------------------------------------

def hwm_next_date(spark, sf_dir):
    return next_load_date(_t(spark, sf_dir, "orders"), "o_orderdate")


def _orders_with_missing_dates(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    d = F.when(F.col("o_orderstatus") != F.lit("P"), F.col("o_orderdate").cast("date"))
    return o.select(d.alias("log_date"))


def hwm_next_date_nulls(spark, sf_dir):
    return next_load_date(_orders_with_missing_dates(spark, sf_dir), "log_date")


def latest_date_q(spark, sf_dir):
    return latest_date(_t(spark, sf_dir, "orders"), "o_orderdate", name="log_date")


def latest_date_nulls(spark, sf_dir):
    return latest_date(_orders_with_missing_dates(spark, sf_dir), "log_date")


def date_spine_q(spark, sf_dir):
    bounds = next_load_date(_t(spark, sf_dir, "events"), "ts")
    return date_spine(bounds, F.lit(SPINE_START).cast("date"), F.col("next_date"), name="d")


# -- sources (S1 S2 S3 S4 P5 C12 C13 C14) -----------------------------------

_ENVELOPE_RECORD = T.StructType([T.StructField("event_id", T.LongType()),
                                 T.StructField("event_type", T.StringType())])


def envelope_explode(spark, sf_dir):
    """Events packed into per-day envelopes of at most 1000 records (one API page
    per thousand ids), as landed JSON text, then read back record by record."""
    ev = _t(spark, sf_dir, "events")
    pages = ev.groupBy(F.col("ts").cast("date").alias("reportdate"),
                       F.expr("event_id div 1000").alias("page"))
    recs = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    env = pages.agg(F.to_json(F.struct(recs.alias("successattendance"))).alias("body"))
    return explode_envelope(env, "body", "successattendance", _ENVELOPE_RECORD,
                            keep=["reportdate", "page"])


def envelope_landing_scan(spark, sf_dir):
    """The same envelopes written as a dated landing zone (one envelope per line,
    reportdate= folders) and read back by the landing reader, from the first landed
    day on."""
    from rollcall.sources import read_envelope
    ev = _t(spark, sf_dir, "events")
    pages = ev.groupBy(F.col("ts").cast("date").alias("reportdate"),
                       F.expr("event_id div 1000").alias("page"))
    recs = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    env = pages.agg(F.to_json(F.struct(recs.alias("successattendance"))).alias("value"))
    landing = f"{scratch_path(spark, 'envelope_landing')}/attendance"
    env.select("value", "reportdate").write.partitionBy("reportdate").text(landing)
    first = ev.agg(F.min(F.col("ts").cast("date"))).first()[0]
    rows = read_envelope(spark, landing, "successattendance", _ENVELOPE_RECORD, dated=True, multi_line=False,
                         first_day=first)
    if first is not None:
        rows = rows.filter(F.col("reportdate") >= F.lit(first))
    return rows.select("event_id", "event_type", "reportdate", "_pos")


def json_field_q(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    return ev.select("event_id", json_field("props", "k", "int").alias("k"))


def _role_keys(spark, sf_dir) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("in_key"),
                     F.nullif(F.col("l_suppkey"), F.lit(0)).alias("out_key"))


def distinct_keys_q(spark, sf_dir):
    return distinct_keys(_role_keys(spark, sf_dir), ["in_key", "out_key"], exclude=1, name="key")


def keyed_lookup(spark, sf_dir):
    keys = distinct_keys(_role_keys(spark, sf_dir), ["in_key", "out_key"], exclude=1, name="key")
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_name")
    return lookup_keys(part, "p_partkey", keys)


def request_manifest_q(spark, sf_dir):
    ev = _t(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("d"), "event_type")
    return request_manifest(ev, "events", day_col="d", key_col="event_type", key_name="event")


def manifest_not_landed(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    spine = date_spine(next_load_date(ev, "ts"), F.lit(SPINE_START).cast("date"),
                       F.col("next_date"), name="d")
    wanted = request_manifest(spine, "events", day_col="d")
    landed = request_manifest(ev.select(F.col("ts").cast("date").alias("d")), "events", day_col="d")
    return not_landed(wanted, landed)


# -- projections and filters (P1 P2 F1 F2 F6 C5 C17) -------------------------

def select_rename(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("in_location"))


def active_filter(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    return (ev.filter(F.nullif(F.col("event_type"), F.lit("view")) == F.lit("click"))
              .select("event_id", "user_id", "event_type"))


def not_null_filter(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    return (c.filter(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).isNotNull())
             .select("c_custkey", "c_mktsegment"))


def non_empty_gate(spark, sf_dir):
    return has_rows(_t(spark, sf_dir, "events").filter(F.col("event_type") == F.lit("nope")))


def non_empty_gate_hit(spark, sf_dir):
    return has_rows(_t(spark, sf_dir, "events").filter(F.col("event_type") == F.lit("click")))


# -- joins (J1 J2) --------------------------------------------------------------

def null_safe_left_join(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = _t(spark, sf_dir, "customer").select(
        "c_custkey", F.nullif(F.col("c_nationkey"), F.lit(0)).alias("fk"))
    fact = o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "fk")
    out = left_join_null_safe(fact, _nation_dim(spark, sf_dir), "fk", "dk")
    return out.select("o_orderkey", "fk", F.col("n_name").alias("loc"))


def _lineitem_roles(spark, sf_dir) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = _t(spark, sf_dir, "customer").select(
        "c_custkey", F.nullif(F.col("c_nationkey"), F.lit(0)).alias("c_key"))
    s = _t(spark, sf_dir, "supplier").select(
        "s_suppkey", F.nullif(F.col("s_nationkey"), F.lit(0)).alias("s_key"))
    return (li.join(o, li["l_orderkey"] == o["o_orderkey"])
              .join(c, F.col("o_custkey") == c["c_custkey"])
              .join(s, F.col("l_suppkey") == s["s_suppkey"])
              .select("l_orderkey", "l_linenumber", "c_key", "s_key"))


def role_playing_join(spark, sf_dir):
    out = role_join(_lineitem_roles(spark, sf_dir), _nation_dim(spark, sf_dir),
                    {"c_key": "c_loc", "s_key": "s_loc"}, "dk", "n_name")
    return out.select("l_orderkey", "l_linenumber", "c_loc", "s_loc")


def role_playing_join_salted(spark, sf_dir):
    """The same question with the broadcast refused: the sort-merge fallback with
    hot keys (here every nation above 1% of the rows, and the missing key) salted."""
    out = role_join(_lineitem_roles(spark, sf_dir), _nation_dim(spark, sf_dir),
                    {"c_key": "c_loc", "s_key": "s_loc"}, "dk", "n_name",
                    broadcast=False, salt_buckets=8, hot_share=0.01)
    return out.select("l_orderkey", "l_linenumber", "c_loc", "s_loc")


def join_fanout(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").select(
        "s_suppkey", F.nullif(F.col("s_nationkey"), F.lit(0)).alias("fk"))
    n = _t(spark, sf_dir, "nation")
    r = _t(spark, sf_dir, "region")
    names = n.select(F.nullif(F.col("n_nationkey"), F.lit(24)).alias("dk"), F.col("n_name").alias("loc"))
    # Asian nations listed a second time (with their region as the location).
    again = (n.join(r.filter(F.col("r_name") == F.lit("ASIA")), F.col("n_regionkey") == F.col("r_regionkey"))
              .select(F.nullif(F.col("n_nationkey"), F.lit(24)).alias("dk"), F.col("r_name").alias("loc")))
    out = left_join_null_safe(s, names.unionByName(again), "fk", "dk")
    return out.select("s_suppkey", "fk", "loc")


# -- duplicates and unions (R3 U1) ---------------------------------------------

def distinct_rows(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.select(F.nullif(F.col("p_type"), F.lit("SMALL")).alias("t"), "p_size").distinct()


def union_by_name(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    clicks = ev.filter(F.col("event_type") == "click").select("event_id", "user_id", "event_type")
    others = ev.filter(F.col("event_type") != "click").select("value", "event_type", "event_id", "user_id")
    return bind_by_name(clicks, others)


# -- scalars (C1 C2 C3 C4 C10) ---------------------------------------------------

def title_case_q(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.select(title_case(F.concat(F.col("p_type"), F.lit(" "), F.col("p_name"))).alias("t")).distinct()


def remove_first_q(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", remove_first(F.concat(F.col("p_type"), F.lit(" Ng Ng")), " Ng").alias("d"))


def if_else_null(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    cond = F.nullif(F.col("p_brand"), F.lit("Brand#2")) == F.lit("Brand#4")
    return p.select("p_partkey", if_else(cond, F.col("p_name"), F.col("p_type")).alias("v"))


def normalise_category(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    rules = [("Faculty", ["ECONOMY", "PROMO"]), ("Senior", ["LARGE"])]
    return p.select("p_partkey", category(F.nullif(F.col("p_type"), F.lit("SMALL")), rules).alias("cat"))


def format_date(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.select(format_day("o_orderdate").alias("d")).distinct()


# -- writes and the loads (K1-K4, PL1-PL3) ---------------------------------------

def _leave_feeds(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    ev = _t(spark, sf_dir, "events")
    k = json_field("props", "k", "int")
    common = {
        "reportdate": F.col("ts").cast("date"),
        "active_status": F.when(k >= 50, "Y").when(k >= 20, "N"),    # null below 20
        "emp_id": F.col("user_id").cast("string"),
        "reason": F.col("event_type"),
        "created_by": F.lit("hr"),
        "creation_date": iso_text("ts"),
    }
    leave = (ev.filter(F.col("event_type") == "click")
               .withColumns({**common, "leave_type": F.when(F.col("value") >= 25, "EL").otherwise("CL")}))
    tour = ev.filter(F.col("event_type") != "click").withColumns(common)   # no leave_type
    keep_l = list(common) + ["leave_type"]
    return leave.select(*keep_l), tour.select(*list(common))


def leave_tour_refresh(spark, sf_dir):
    leave, tour = _leave_feeds(spark, sf_dir)
    root = scratch_path(spark, "leave_tour_refresh")
    replace_table(leave_history(leave, leave), root, "leave")    # an older version
    replace_table(leave_history(leave, tour), root, "leave")     # replaced in full
    return read_table(spark, root, "leave")


def leave_tour_refresh_window(spark, sf_dir):
    """Yesterday's run rebuilt the days up to the 15th; today's run re-reads only
    from the 10th and keeps the stored rows before it. Must equal a full rebuild."""
    from rollcall.plans import leave_window
    leave, tour = _leave_feeds(spark, sf_dir)
    root = scratch_path(spark, "leave_tour_refresh_window")
    upto = F.col("reportdate") <= F.lit("2024-01-15").cast("date")
    replace_table(leave_history(leave.filter(upto), tour.filter(upto)), root, "leave")
    replace_table(leave_window(leave, tour, read_table(spark, root, "leave"), "2024-01-10"), root, "leave")
    return read_table(spark, root, "leave")


def _order_feed(spark, sf_dir) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    page = F.when(F.col("o_orderstatus") == "F", "page-2.json").otherwise("page-10.json")
    return o.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("seg"),
                    F.lit(0).alias("src"), page.alias("_file"), F.col("o_orderkey").alias("_pos"))


def emp_upsert(spark, sf_dir):
    """Stored register = customers; the feed = orders in two pages, completed ones on page 2
    and the others on page 10 (one row per order, first order per customer wins); the
    register is rebuilt from itself."""
    root = scratch_path(spark, "emp_upsert")
    c = _t(spark, sf_dir, "customer")
    replace_versioned(c.select("c_custkey", F.col("c_mktsegment").alias("seg"), F.lit(1).alias("src")),
                      root, "emp")
    merged = merge_employees(_order_feed(spark, sf_dir), read_table(spark, root, "emp"), key="c_custkey")
    replace_versioned(merged, root, "emp")
    return read_table(spark, root, "emp").select("c_custkey", "seg", "src")


def emp_upsert_view(spark, sf_dir):
    """The register's upsert by name: read through its view, written as the next table, the view moved on."""
    import uuid

    from rollcall.sinks import read_view, replace_view
    name, place = f"emp_{uuid.uuid4().hex[:12]}", scratch_path(spark, "emp_upsert_view")
    c = _t(spark, sf_dir, "customer")
    replace_view(c.select("c_custkey", F.col("c_mktsegment").alias("seg"), F.lit(1).alias("src")), name, place)
    merged = merge_employees(_order_feed(spark, sf_dir), read_view(spark, name), key="c_custkey")
    replace_view(merged, name, place)
    return spark.sql(f"SELECT c_custkey, seg, src FROM {name}")


def append_day_q(spark, sf_dir):
    """All landed days appended, the same load run again, then an empty day."""
    path = f"{scratch_path(spark, 'append_day')}/events"
    days = _t(spark, sf_dir, "events").select("event_id", "event_type",
                                              F.col("ts").cast("date").alias("reportdate"))
    append_day(days, path)
    append_day(days, path)                                        # re-run: same days replaced
    append_day(days.filter(F.col("event_type") == "none"), path)  # empty day: nothing touched
    return read_days(spark, path).select("event_id", "event_type", "reportdate")


def _marked_days(spark, sf_dir) -> tuple[SparkSession, str]:
    """Events appended as attendance days (errors carry no log_date), marks refreshed."""
    from rollcall.sinks import refresh_marks
    path = f"{scratch_path(spark, 'load_marks')}/attendance"
    ev = _t(spark, sf_dir, "events")
    days = ev.select("event_id",
                     F.when(F.col("event_type") != "error", iso_text("ts")).alias("log_date"),
                     F.col("ts").cast("date").alias("reportdate"))
    append_day(days, path)
    refresh_marks(spark, path, None)
    return spark, path


def load_marks(spark, sf_dir):
    from rollcall.sinks import read_marks
    return read_marks(*_marked_days(spark, sf_dir)).select("reportdate", "max_date", "missing_dates", "rows")


def latest_loaded_date_q(spark, sf_dir):
    from rollcall.sinks import latest_from_marks, read_marks
    return latest_from_marks(read_marks(*_marked_days(spark, sf_dir)))


def _attendance_feed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    li = _t(spark, sf_dir, "lineitem")
    out_dev = (F.when(F.col("l_returnflag") == "N", F.lit(""))
                .when(F.col("l_returnflag") == "A", F.col("l_suppkey").cast("string")))  # R -> null
    att = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("emp_id"),
                    iso_text("l_shipdate").alias("log_date"),
                    F.col("l_partkey").cast("string").alias("in_device_id"),
                    out_dev.alias("out_device_id"),
                    F.col("l_shipdate").cast("date").alias("reportdate"))
    p = _t(spark, sf_dir, "part")
    dev = p.select(F.col("p_partkey").cast("string").alias("device_id"),
                   F.lpad(F.col("p_size").cast("string"), 6, "0").alias("org_id"),
                   F.col("p_name").alias("entry_name"),
                   F.col("p_type").alias("org_name"))
    return att, dev


def attendance_load(spark, sf_dir):
    """The attendance load's transform and sink on lineitem (records) and part
    (devices): device location rule, both roles joined, appended per day."""
    att, dev = _attendance_feed(spark, sf_dir)
    path = f"{scratch_path(spark, 'attendance_load')}/attendance"
    append_day(enrich_attendance(att, dev), path)
    return read_days(spark, path).select("emp_id", "log_date", "in_device_id", "out_device_id",
                                         "in_location", "out_location", "reportdate")


def employee_normalise(spark, sf_dir):
    """The employee feed's normalisation on customers: accounts in debit have no
    name (dropped), segments become designations with the " NG" suffix."""
    from rollcall.plans import normalise_employees
    return normalise_employees(_employee_feed(spark, sf_dir))


def holiday_replace(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    root = scratch_path(spark, "holiday_replace")
    replace_table(n.select("n_nationkey", F.lower("n_name").alias("n_name"), "n_regionkey"), root, "holiday")
    replace_table(n, root, "holiday")
    return read_table(spark, root, "holiday")


def entry_query(spark, sf_dir):
    return role_playing_join(spark, sf_dir)


QUERIES: dict[str, QueryFn] = {
    "hwm_next_date": hwm_next_date,
    "hwm_next_date_nulls": hwm_next_date_nulls,
    "latest_date": latest_date_q,
    "latest_date_nulls": latest_date_nulls,
    "date_spine": date_spine_q,
    "envelope_explode": envelope_explode,
    "envelope_landing_scan": envelope_landing_scan,
    "json_field": json_field_q,
    "distinct_keys": distinct_keys_q,
    "keyed_lookup": keyed_lookup,
    "request_manifest": request_manifest_q,
    "manifest_not_landed": manifest_not_landed,
    "select_rename": select_rename,
    "active_filter": active_filter,
    "not_null_filter": not_null_filter,
    "non_empty_gate": non_empty_gate,
    "non_empty_gate_hit": non_empty_gate_hit,
    "null_safe_left_join": null_safe_left_join,
    "role_playing_join": role_playing_join,
    "role_playing_join_salted": role_playing_join_salted,
    "join_fanout": join_fanout,
    "distinct_rows": distinct_rows,
    "union_by_name": union_by_name,
    "leave_tour_refresh": leave_tour_refresh,
    "leave_tour_refresh_window": leave_tour_refresh_window,
    "title_case": title_case_q,
    "remove_first": remove_first_q,
    "if_else_null": if_else_null,
    "normalise_category": normalise_category,
    "format_date": format_date,
    "emp_upsert": emp_upsert,
    "append_day": append_day_q,
    "load_marks": load_marks,
    "latest_loaded_date": latest_loaded_date_q,
    "attendance_load": attendance_load,
    "employee_normalise": employee_normalise,
    "holiday_replace": holiday_replace,
}


# -- streaming (PL1 as an availableNow file stream) ---------------------------------

def _stream_landing(spark, sf_dir, landing: str) -> tuple[DataFrame, DataFrame]:
    """Land events as attendance envelopes (JSON lines, one per day and page of
    1000 ids, under reportdate= folders); customers are the device table."""
    ev = _t(spark, sf_dir, "events")
    k = json_field("props", "k", "int").cast("string")
    out_dev = (F.when(F.col("event_type") == "error", F.lit(""))
                .when(F.col("event_type") != "view", k))               # view -> null
    rec = F.struct(F.col("user_id").cast("string").alias("emp_id"),
                   iso_text("ts").alias("log_date"),
                   F.col("user_id").cast("string").alias("in_device_id"),
                   out_dev.alias("out_device_id"))
    pages = ev.groupBy(F.col("ts").cast("date").alias("reportdate"), F.expr("event_id div 1000").alias("page"))
    env = pages.agg(F.to_json(F.struct(F.collect_list(rec).alias("successattendance"))).alias("value"))
    env.select("value", "reportdate").write.partitionBy("reportdate").text(f"{landing}/attendance")
    c = _t(spark, sf_dir, "customer")
    dev = c.select(F.col("c_custkey").cast("string").alias("device_id"),
                   F.lpad(F.col("c_nationkey").cast("string"), 6, "0").alias("org_id"),
                   F.col("c_name").alias("entry_name"),
                   F.col("c_mktsegment").alias("org_name"))
    return env, dev


def attendance_stream_q(spark, sf_dir):
    """Stream the landed days twice (the second run must add nothing); read back."""
    from rollcall.streaming import run_attendance_stream
    root = scratch_path(spark, "attendance_stream")
    landing, ckpt = f"{root}/landing", f"{root}/_checkpoint"
    _, dev = _stream_landing(spark, sf_dir, landing)
    for _ in range(2):
        run_attendance_stream(spark, landing, root, ckpt, devices=dev, multi_line=False)
    return read_days(spark, f"{root}/attendance").select("emp_id", "log_date", "in_device_id", "out_device_id",
                                            "in_location", "out_location", "reportdate")


QUERIES["attendance_stream"] = attendance_stream_q


# -- the loads end to end: landed envelopes in, stored tables out --------------------

def attendance_mixed(spark, sf_dir):
    """Batch load, stream run and batch load again on one table, over all landed days."""
    from rollcall.plans import load_attendance
    from rollcall.schemas import DEVICES, ROOT_DEVICES
    from rollcall.streaming import run_attendance_stream
    root = scratch_path(spark, "attendance_mixed")
    landing = f"{root}/landing"
    _, dev = _stream_landing(spark, sf_dir, landing)
    _land(dev.select(*DEVICES.fieldNames()), f"{landing}/devices", ROOT_DEVICES)
    load_attendance(spark, landing, root, multi_line=False)
    run_attendance_stream(spark, landing, root, f"{root}/_checkpoint", multi_line=False)
    load_attendance(spark, landing, root, multi_line=False)
    return read_days(spark, f"{root}/attendance").select("emp_id", "log_date", "in_device_id", "out_device_id",
                                                         "in_location", "out_location", "reportdate")


def _land(records: DataFrame, path: str, root: str, day_col: str | None = None, pages: int = 8) -> None:
    """Land ``records`` as envelopes, one per line and page, in day folders if dated."""
    fields = [c for c in records.columns if c != day_col]
    page = F.pmod(F.xxhash64(*fields), F.lit(pages))
    keys = [F.col(day_col)] if day_col else []
    body = F.to_json(F.struct(F.collect_list(F.struct(*fields)).alias(root)))
    env = records.groupBy(*keys, page.alias("__page")).agg(body.alias("value")).drop("__page")
    writer = env.write.mode("overwrite")
    (writer.partitionBy(day_col) if day_col else writer).text(path)


def _land_leave(spark, sf_dir, landing: str) -> None:
    from rollcall.schemas import ROOT_LEAVE, ROOT_TOUR
    leave, tour = _leave_feeds(spark, sf_dir)
    _land(leave, f"{landing}/leave", ROOT_LEAVE, "reportdate")
    _land(tour, f"{landing}/tour", ROOT_TOUR, "reportdate")


def leave_gap_refresh(spark, sf_dir):
    """A run up to the 10th, no runs for some days, then a run with a window from the 20th:
    must equal a full rebuild over all landed days."""
    from rollcall.plans import refresh_leave
    root = scratch_path(spark, "leave_gap_refresh")
    _land_leave(spark, sf_dir, f"{root}/landing")
    kw = {"start": "1970-01-01", "multi_line": False}
    refresh_leave(spark, f"{root}/landing", root, stop="2024-01-10", **kw)
    refresh_leave(spark, f"{root}/landing", root, stop=None, since="2024-01-20", **kw)
    return read_table(spark, root, "leave")


def _employee_feed(spark, sf_dir) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("emp_id"),
                    F.when(F.col("c_acctbal") >= 0, F.lower("c_name")).alias("emp_name"),
                    F.concat(F.col("c_mktsegment"), F.lit(" NG NG")).alias("designation"),
                    F.col("c_mktsegment").alias("division"))


def employee_landing(spark, sf_dir):
    """The register loaded from one landed feed, then again from the next, whose rows win."""
    from rollcall.plans import upsert_employees
    from rollcall.schemas import ROOT_EMPLOYEE
    root = scratch_path(spark, "employee_landing")
    feed = _employee_feed(spark, sf_dir)
    for f in (feed.withColumn("division", F.lit("OLD")), feed):
        _land(f, f"{root}/landing/employee", ROOT_EMPLOYEE)
        upsert_employees(spark, f"{root}/landing", root, multi_line=False)
    return read_table(spark, root, "employee").select("emp_id", "emp_name", "designation", "division", "cat")


def holiday_landing(spark, sf_dir):
    from rollcall.plans import replace_holidays
    from rollcall.schemas import ROOT_HOLIDAY, strings
    root = scratch_path(spark, "holiday_landing")
    n = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("n_nationkey"), "n_name")
    for f in (n.withColumn("n_name", F.lower("n_name")), n):
        _land(f, f"{root}/landing/holiday", ROOT_HOLIDAY)
        replace_holidays(spark, f"{root}/landing", root, record=strings("n_nationkey", "n_name"), multi_line=False)
    return read_table(spark, root, "holiday")


# -- what has landed: late pages, held-back days, misdated rows, changed days --------------

def _attendance_records(spark, sf_dir) -> DataFrame:
    """Events as attendance records, with their day and a half (by id) that tells early from late pages."""
    ev = _t(spark, sf_dir, "events")
    k = json_field("props", "k", "int").cast("string")
    out_dev = F.when(F.col("event_type") == "error", F.lit("")).when(F.col("event_type") != "view", k)
    return ev.select(F.col("user_id").cast("string").alias("emp_id"), iso_text("ts").alias("log_date"),
                     F.col("user_id").cast("string").alias("in_device_id"), out_dev.alias("out_device_id"),
                     F.col("ts").cast("date").alias("reportdate"), F.pmod("event_id", F.lit(3)).alias("third"))


def _land_devices(spark, sf_dir, landing: str) -> None:
    from rollcall.schemas import DEVICES, ROOT_DEVICES
    c = _t(spark, sf_dir, "customer")
    dev = c.select(F.col("c_custkey").cast("string").alias("device_id"),
                   F.lpad(F.col("c_nationkey").cast("string"), 6, "0").alias("org_id"),
                   F.col("c_name").alias("entry_name"), F.col("c_mktsegment").alias("org_name"))
    _land(dev.select(*DEVICES.fieldNames()), f"{landing}/devices", ROOT_DEVICES)


def _land_more(records: DataFrame, path: str, root: str, *folders: str) -> None:
    """Add ``records`` to what has landed, as envelopes of eight a folder (``reportdate`` and ``folders``)."""
    keys = ["reportdate", *folders]
    fields = [c for c in records.columns if c not in keys]
    page = F.pmod(F.xxhash64(*fields), F.lit(8)).alias("__page")
    body = F.to_json(F.struct(F.collect_list(F.struct(*fields)).alias(root))).alias("value")
    records.groupBy(*keys, page).agg(body).drop("__page").write.mode("append").partitionBy(*keys).text(path)


_ATTENDANCE_OUT = ["emp_id", "log_date", "in_device_id", "out_device_id", "in_location", "out_location", "reportdate"]


def attendance_late_pages(spark, sf_dir):
    """A batch load, then more pages of the same days, then a batch load: nothing is lost."""
    from rollcall.plans import load_attendance
    from rollcall.schemas import ROOT_ATTENDANCE
    root = scratch_path(spark, "attendance_late_pages")
    landing = f"{root}/landing"
    _land_devices(spark, sf_dir, landing)
    records = _attendance_records(spark, sf_dir)
    for part in (F.col("third") == 0, F.col("third") > 0):
        _land_more(records.filter(part).drop("third"), f"{landing}/attendance", ROOT_ATTENDANCE)
        load_attendance(spark, landing, root, multi_line=False)
    return read_days(spark, f"{root}/attendance").select(*_ATTENDANCE_OUT)


def attendance_gate(spark, sf_dir):
    """Three pages a day landed under their manifest paths, but for the second one of the 10th: that day is held
    back with its page, without rows and unmarked; the others are loaded."""
    from rollcall.plans import load_attendance
    from rollcall.schemas import ROOT_ATTENDANCE
    from rollcall.sinks import read_marks
    root = scratch_path(spark, "attendance_gate")
    landing = f"{root}/landing"
    _land_devices(spark, sf_dir, landing)
    records = _attendance_records(spark, sf_dir).withColumns({"offset": F.col("third") * 1000, "count": F.lit(1000)})
    missing = (F.col("reportdate") == F.lit("2024-01-10").cast("date")) & (F.col("third") == 1)
    _land_more(records.filter(~missing).drop("third"), f"{landing}/attendance", ROOT_ATTENDANCE, "offset", "count")
    totals = records.groupBy("reportdate").agg(F.lit(3000).cast("long").alias("total"))
    status = load_attendance(spark, landing, root, multi_line=False, expected=totals)
    held = spark.createDataFrame([(d, p) for d, pages in status.held.items() for p in pages], "reportdate date, missing_page long")
    marks = read_marks(spark, f"{root}/attendance").select("reportdate", "rows")
    return marks.join(held, "reportdate", "full")


def attendance_misdated(spark, sf_dir):
    """The days to the 10th are loaded, the 5th with rows dated 2042; then the other days land. The load names the
    misdated day and the days behind its date, and reads them."""
    from rollcall.plans import load_attendance
    from rollcall.schemas import ROOT_ATTENDANCE
    from rollcall.sinks import read_marks
    root = scratch_path(spark, "attendance_misdated")
    landing = f"{root}/landing"
    _land_devices(spark, sf_dir, landing)
    records = _attendance_records(spark, sf_dir)
    wrong = (F.col("reportdate") == F.lit("2024-01-05").cast("date")) & (F.col("third") == 0)
    records = records.withColumn("log_date", F.when(wrong, "2042-01-01").otherwise(F.col("log_date"))).drop("third")
    early = F.col("reportdate") <= F.lit("2024-01-10").cast("date")
    for part in (early, ~early):
        _land_more(records.filter(part), f"{landing}/attendance", ROOT_ATTENDANCE)
        status = load_attendance(spark, landing, root, multi_line=False)
    said = [("ahead", d, m) for d, m in status.ahead] + [("behind", d, None) for d in status.behind]
    marks = read_marks(spark, f"{root}/attendance").select(F.lit("stored").alias("what"), "reportdate", "max_date", "rows")
    report = spark.createDataFrame(said, "what string, reportdate date, max_date date")
    return report.withColumn("rows", F.lit(None).cast("long")).unionByName(marks)


def leave_changed_days(spark, sf_dir):
    """Leave by day: a run over a part of each day's records and the 11th left out, more files for all days,
    then a run that reads what changed, then one that finds nothing to do."""
    from rollcall.plans import read_leave, refresh_leave_days
    from rollcall.schemas import ROOT_LEAVE, ROOT_TOUR
    root = scratch_path(spark, "leave_changed_days")
    feeds = zip(_leave_feeds(spark, sf_dir), ("leave", "tour"), (ROOT_LEAVE, ROOT_TOUR))
    first = (F.col("reason") == "click") & (F.col("reportdate") != F.lit("2024-01-11").cast("date"))
    feeds = list(feeds)
    for part in (first, ~first):
        for feed, name, key in feeds:
            _land_more(feed.filter(part), f"{root}/landing/{name}", key)
        refresh_leave_days(spark, f"{root}/landing", root, start="1970-01-01", stop=None, multi_line=False)
    if refresh_leave_days(spark, f"{root}/landing", root, start="1970-01-01", stop=None, multi_line=False):
        raise RuntimeError("unchanged days were read again")
    return read_leave(spark, root)


def stored_days_columns(spark, sf_dir):
    """Days stored with a column that earlier days lack read back whole, filled with missing values."""
    from rollcall.sinks import refresh_marks
    path = f"{scratch_path(spark, 'stored_days_columns')}/events"
    ev = _t(spark, sf_dir, "events").withColumn("reportdate", F.col("ts").cast("date"))
    early = F.col("reportdate") <= F.lit("2024-01-15").cast("date")
    for rows in (ev.filter(early).select("event_id", "event_type", "reportdate"),
                 ev.filter(~early).select("event_id", "value", "event_type", "reportdate")):
        append_day(rows, path)
        days = [r[0] for r in rows.select("reportdate").distinct().collect()]
        refresh_marks(spark, path, days=days, col="reportdate", schema=rows.schema)
    return read_days(spark, path).select("event_id", "event_type", "value", "reportdate")


def manifest_pages(spark, sf_dir):
    """One path a page of each day's events, a hundred records a page, and those of which nothing landed."""
    from rollcall.sources import paged_manifest
    ev = _t(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("reportdate"), "event_id")
    totals = ev.groupBy("reportdate").agg(F.count(F.lit(1)).alias("total"))
    return paged_manifest(totals, "events", page_size=100, first_page=1)


def records_scan(spark, sf_dir):
    """Regions landed as bare JSON arrays, one file each, read record by record with their positions."""
    from rollcall.sources import read_records
    path = f"{scratch_path(spark, 'records_scan')}/nations"
    recs = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    body = _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(recs).alias("value"))
    body.write.partitionBy("n_regionkey").text(path)
    record = T.StructType([T.StructField("n_nationkey", T.LongType()), T.StructField("n_name", T.StringType())])
    return read_records(spark, path, record).select("n_nationkey", "n_name", "_pos")


def keyed_bucket_scan(spark, sf_dir):
    """The keyed scan from a source laid out in hash buckets of its key: buckets without a key are not read."""
    from rollcall.sources import keyed_scan, land_by_key
    path = scratch_path(spark, "keyed_bucket_scan")
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_name")
    land_by_key(part, path, "p_partkey", 32)
    keys = distinct_keys(_role_keys(spark, sf_dir), ["in_key", "out_key"], exclude=1, name="key")
    return keyed_scan(spark, path, "p_partkey", keys, 32)


def employee_buckets(spark, sf_dir):
    """The register in hash buckets, loaded with an older feed of some employees and then with the whole feed."""
    from rollcall.plans import read_register, upsert_employee_buckets
    from rollcall.schemas import ROOT_EMPLOYEE
    root = scratch_path(spark, "employee_buckets")
    feed = _employee_feed(spark, sf_dir)
    older = feed.filter(F.col("division") != "BUILDING").withColumn("division", F.lit("OLD"))
    for f in (older, feed):
        _land(f, f"{root}/landing/employee", ROOT_EMPLOYEE)
        upsert_employee_buckets(spark, f"{root}/landing", root, multi_line=False, buckets=16)
    return read_register(spark, root, 16).select("emp_id", "emp_name", "designation", "division", "cat")


def daily_run(spark, sf_dir):
    """The daily job over all four feeds, run twice; rows and content of each stored table, the content as
    the sum of 32 bits of each row's MD5."""
    from rollcall.daily import run
    from rollcall.plans import read_leave
    from rollcall.schemas import DEVICES, ROOT_DEVICES, ROOT_EMPLOYEE, ROOT_HOLIDAY
    root = scratch_path(spark, "daily_run")
    landing = f"{root}/landing"
    _, dev = _stream_landing(spark, sf_dir, landing)
    _land(dev.select(*DEVICES.fieldNames()), f"{landing}/devices", ROOT_DEVICES)
    _land_leave(spark, sf_dir, landing)
    _land(_employee_feed(spark, sf_dir), f"{landing}/employee", ROOT_EMPLOYEE)
    n = _t(spark, sf_dir, "nation")
    _land(n.select(F.lit("2024-01-26").alias("holiday_date"), F.col("n_name").alias("holiday_name")),
          f"{landing}/holiday", ROOT_HOLIDAY)
    for _ in range(2):
        out = run(spark, landing, root, history_start="1970-01-01", multi_line=False)
        failed = {k: v for k, v in out.items() if v.startswith("FAILED")}
        if failed:
            raise RuntimeError(str(failed))
    tables = {"attendance": read_days(spark, f"{root}/attendance"), "leave": read_leave(spark, root),
              **{t: read_table(spark, root, t) for t in ("employee", "holiday")}}
    rows = None
    for name, t in tables.items():
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in sorted(t.columns)])
        bits = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
        one = t.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"), F.sum(bits).alias("content"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


QUERIES.update({"attendance_mixed": attendance_mixed, "leave_gap_refresh": leave_gap_refresh,
                "employee_landing": employee_landing, "holiday_landing": holiday_landing, "daily_run": daily_run})
QUERIES.update({"attendance_late_pages": attendance_late_pages, "attendance_gate": attendance_gate,
                "attendance_misdated": attendance_misdated, "leave_changed_days": leave_changed_days,
                "stored_days_columns": stored_days_columns, "manifest_pages": manifest_pages,
                "records_scan": records_scan, "keyed_bucket_scan": keyed_bucket_scan, "employee_buckets": employee_buckets, "emp_upsert_view": emp_upsert_view})
