"""Queries on checksum audits."""

from datetime import datetime

from pyspark.sql import functions as F

from ledgerstone.operators import fixity as fx
from ledgerstone.plans.registry import add

NOW = datetime(2024, 1, 15, 12)
FROM, TO = datetime(2024, 1, 10), datetime(2024, 1, 12)
_T = "TIMESTAMP '2024-01-15 12:00:00'"
_RANGE = "scheduled_time >= TIMESTAMP '2024-01-10' AND scheduled_time <= TIMESTAMP '2024-01-12'"

add("fixity_search_all", lambda v: fx.search(v.fix), "fix", "SELECT * FROM fix")
add("fixity_search_time", lambda v: fx.search(v.fix, FROM, TO), "fix", f"SELECT * FROM fix WHERE {_RANGE}")
add("fixity_search_item", lambda v: fx.search(v.fix, item="u7"), "fix", "SELECT * FROM fix WHERE item = 'u7'")
add("fixity_search_status", lambda v: fx.search(v.fix, status="mismatch"), "fix", "SELECT * FROM fix WHERE status = 'mismatch'")
add("fixity_search_combo", lambda v: fx.search(v.fix, datetime(2024, 1, 5), datetime(2024, 1, 25), "u7", "scheduled"), "fix", "SELECT * FROM fix WHERE scheduled_time >= TIMESTAMP '2024-01-05' AND scheduled_time <= TIMESTAMP '2024-01-25' AND item = 'u7' AND status = 'scheduled'")
add("fixity_get_by_id", lambda v: fx.by_id(v.fix, 77), "fix", "SELECT * FROM fix WHERE id = 77")
add("fixity_next", lambda v: fx.next_due(v.fix, NOW), "fix", f"SELECT * FROM fix WHERE status = 'scheduled' AND scheduled_time <= {_T} ORDER BY scheduled_time, id LIMIT 1")
add("fixity_due", lambda v: fx.due(v.fix, NOW), "fix", f"SELECT * FROM fix WHERE status = 'scheduled' AND scheduled_time <= {_T}")
add("fixity_lookup_check", lambda v: fx.next_check(v.fix), "fix", "SELECT item, min(scheduled_time) AS next_time FROM fix WHERE status = 'scheduled' GROUP BY item")
_LATE = "(SELECT * FROM fix WHERE scheduled_time > TIMESTAMP '2024-01-29 20:00:00')"
add("fixity_unscheduled_items", lambda v: fx.unscheduled(v.fix.select("item").distinct(), v.fix.where(F.col("scheduled_time") > F.lit("2024-01-29 20:00:00").cast("timestamp_ntz"))), "fix", f"SELECT DISTINCT item FROM fix WHERE item NOT IN (SELECT item FROM {_LATE} WHERE status = 'scheduled')")
add("fixity_backfill_count", lambda v: fx.backfill(v.fix.select("item").distinct(), v.fix.where(F.col("scheduled_time") > F.lit("2024-01-29 20:00:00").cast("timestamp_ntz")), NOW).agg(F.count("*").alias("n"), F.count_if((F.col("scheduled_time") >= F.lit(NOW)) & (F.col("scheduled_time") < F.lit(datetime(2024, 1, 16)))).alias("within")), "fix", f"SELECT count(*) AS n, count(*) AS within FROM (SELECT DISTINCT item FROM fix WHERE item NOT IN (SELECT item FROM {_LATE} WHERE status = 'scheduled'))")
add("fixity_update_scheduled", lambda v: fx.update(v.fix, v.fix.where("id % 10 = 1").select("id", "item", "scheduled_time", F.lit("ok").alias("status"), F.lit("done").alias("notes"))), "fix", "SELECT id, item, scheduled_time, CASE WHEN status = 'scheduled' AND id % 10 = 1 THEN 'ok' ELSE status END AS status, CASE WHEN status = 'scheduled' AND id % 10 = 1 THEN 'done' ELSE notes END AS notes FROM fix")
add("fixity_insert", lambda v: fx.update(v.fix, v.fix.where("id < 5").select(F.lit(0).cast("long").alias("id"), "item", "scheduled_time", F.lit("").alias("status"), F.lit("new").alias("notes"))), "fix", "SELECT * FROM fix UNION ALL SELECT (SELECT max(id) FROM fix) + row_number() OVER (ORDER BY scheduled_time, item) AS id, item, scheduled_time, 'scheduled' AS status, 'new' AS notes FROM fix WHERE id < 5")
add("fixity_delete_scheduled", lambda v: fx.delete_scheduled(v.fix, list(range(50))), "fix", "SELECT * FROM fix WHERE NOT (id < 50 AND status = 'scheduled')")
add("fixity_run_now", lambda v: fx.run_now(v.fix, 12, NOW), "fix", f"SELECT id, item, CASE WHEN id = 12 AND status = 'scheduled' THEN {_T} ELSE scheduled_time END AS scheduled_time, status, notes FROM fix")
add("fixity_status_counts", lambda v: fx.counters(v.fix), "fix", "SELECT status, count(*) AS n FROM fix GROUP BY status")
add("fixity_validation_outcome", lambda v: v.fix.select("id", fx.outcome(F.length("notes") - 7, F.col("status") == "error").alias("outcome")), "fix", "SELECT id, CASE WHEN status = 'error' THEN 'error' WHEN length(notes) - 7 > 0 THEN 'mismatch' ELSE 'ok' END AS outcome FROM fix")
_RESULTS = lambda v: v.fix.groupBy("item").agg((F.min("id") % 3).cast("long").alias("n_problems")).select("item", "n_problems", F.lit(False).alias("failed"), F.lit("").alias("notes"))
add("fixity_audit_loop", lambda v: fx.audit(v.fix, _RESULTS(v), NOW).groupBy("status").agg(F.count("*").alias("n")), "fix", f"""
    , res AS (SELECT item, min(id) % 3 AS n FROM fix GROUP BY item),
    done AS (SELECT f.id, f.item, CASE WHEN r.n > 0 THEN 'mismatch' ELSE 'ok' END AS s FROM fix f JOIN res r ON f.item = r.item WHERE f.status = 'scheduled' AND f.scheduled_time <= {_T}),
    after AS (SELECT coalesce(d.s, f.status) AS status FROM fix f LEFT JOIN done d ON f.id = d.id
              UNION ALL SELECT 'scheduled' FROM (SELECT DISTINCT item FROM done WHERE item NOT IN (SELECT item FROM fix WHERE status = 'scheduled' AND scheduled_time > {_T})))
    SELECT status, count(*) AS n FROM after GROUP BY status""")
