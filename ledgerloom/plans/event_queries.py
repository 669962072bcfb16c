"""Queries of the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events
from .views import registry, view

E = ("doc_events",)
LAST = "SELECT doc_id, arg_max(status, seq) AS status, max(seq) AS last_seq FROM doc_events GROUP BY doc_id"
CLOSED = "('confirmed','blocked','cancelled','error','split','pre_scan_failed')"


def log(spark, sf):
    return view(spark, sf, "doc_events")


@registry.add("win01_last_status", "WIN-01 STR-01 STR-11", LAST, E)
def win01_last_status(spark, sf):
    return events.last_status(log(spark, sf))


_PAIRS = ",".join(f"'{a}>{b}'" for a, after in events.TRANSITIONS.items() for b in after)
_KNOWN = ",".join(f"'{s}'" for s in events.TRANSITIONS if s)


@registry.add("win02_transitions", "WIN-02 STR-02", f"SELECT doc_id, seq, status, p AS previous_status, (coalesce(p, '') || '>' || status) IN ({_PAIRS}) AS allowed, status IN ({_KNOWN}) AS known FROM (SELECT *, lag(status) OVER (PARTITION BY doc_id ORDER BY seq) AS p FROM doc_events)", E)
def win02_transitions(spark, sf):
    return events.transitions(log(spark, sf)).select("doc_id", "seq", "status", "previous_status", "allowed", "known")


@registry.add("win09_attempts", "WIN-09 STR-07", "SELECT doc_id, seq, CAST(coalesce(sum(CASE WHEN status = 'retrying' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS attempt FROM doc_events", E)
def win09_attempts(spark, sf):
    return events.attempts(log(spark, sf)).select("doc_id", "seq", F.col("attempt").cast("long").alias("attempt"))


@registry.add("win07_08_first_and_last", "WIN-07 WIN-08", "SELECT doc_id, arg_min(file_origin, seq) FILTER (file_origin IS NOT NULL) AS file_origin, arg_max(decision, seq) FILTER (decision IS NOT NULL) AS decision, arg_min(sha256_file, seq) FILTER (sha256_file IS NOT NULL) AS first_digest FROM doc_events GROUP BY doc_id", E)
def win07_08_first_and_last(spark, sf):
    return log(spark, sf).groupBy("doc_id").agg(events.first_of("file_origin").alias("file_origin"), events.last_of("decision").alias("decision"), events.first_of("sha256_file").alias("first_digest"))


@registry.add("agg11_rejections", "AGG-11", "SELECT doc_id, count_if(status = 'review' AND action = 'reject') AS rejections FROM doc_events GROUP BY doc_id", E)
def agg11_rejections(spark, sf):
    return events.rejections(log(spark, sf))


@registry.add("scl57_confirmed", "SCL-57", "SELECT doc_id, arg_max(status, seq) = 'confirmed' OR coalesce(bool_or(status = 'done' AND action = 'confirmed'), false) AS confirmed FROM doc_events GROUP BY doc_id", E)
def scl57_confirmed(spark, sf):
    return events.confirmed(log(spark, sf))


@registry.add("flt01_listed", "FLT-01", f"SELECT doc_id, status, last_seq FROM ({LAST}) WHERE status NOT IN ('confirmed','cancelled','split')", E)
def flt01_listed(spark, sf):
    return events.listed(events.last_status(log(spark, sf)))


@registry.add("flt07_unfinished", "FLT-07 FLT-16", f"SELECT doc_id, status, last_seq FROM ({LAST}) WHERE status <> 'done' AND status NOT IN {CLOSED}", E)
def flt07_unfinished(spark, sf):
    return events.unfinished(events.last_status(log(spark, sf)))


@registry.add("join06_files_not_processed", "JOIN-06 FLT-12", f"SELECT doc_id, book FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM ({LAST}) WHERE status = 'done' OR status IN {CLOSED})", ("docs", "doc_events"))
def join06_files_not_processed(spark, sf):
    return events.not_processed(view(spark, sf, "docs").select("doc_id", "book"), events.last_status(log(spark, sf)))


@registry.add("join05_files_with_status", "JOIN-05 JOIN-13 SCL-37", f"SELECT d.doc_id, d.book, CASE WHEN status IN ('done','renamed') THEN 'ok' WHEN status = 'review' THEN 'warn' WHEN status = 'blocked' THEN 'block' WHEN status IN ('error','pre_scan_failed') THEN 'error' WHEN status = 'confirmed' THEN 'confirmed' WHEN status = 'cancelled' THEN 'cancelled' ELSE 'pending' END AS shown FROM docs d LEFT JOIN ({LAST}) s ON d.doc_id = s.doc_id", ("docs", "doc_events"))
def join05_files_with_status(spark, sf):
    return events.shown_status(view(spark, sf, "docs").select("doc_id", "book"), events.last_status(log(spark, sf)))


@registry.add("join11_holders_of_digest", "JOIN-11 STR-04", "SELECT DISTINCT doc_id FROM doc_events WHERE sha256_file = 'sha42'", E)
def join11_holders_of_digest(spark, sf):
    return events.holders(log(spark, sf), "sha42")


@registry.add("agg10_statistics", "AGG-10", "SELECT * FROM (SELECT count(*) AS documents, count_if(issuer_verdict = 'auto') AS n_auto, count_if(issuer_verdict = 'warn') AS n_warn, count_if(issuer_verdict = 'pendiente') AS n_pendiente, count_if(issuer_verdict = 'block') AS n_block FROM docs), (SELECT count_if(action = 'approve') AS approved, count_if(action = 'reject') AS rejected FROM doc_events)", ("docs", "doc_events"))
def agg10_statistics(spark, sf):
    return events.statistics(view(spark, sf, "docs").withColumnRenamed("issuer_verdict", "verdict"), log(spark, sf))


@registry.add("str12_latest_choice", "STR-12", "SELECT doc_id, arg_max(action, seq) AS action, arg_max(book, seq) FILTER (book IS NOT NULL) AS book FROM doc_events WHERE action IN ('approve','reject') GROUP BY doc_id", E)
def str12_latest_choice(spark, sf):
    return events.latest_choice(log(spark, sf))


@registry.add("scl_a2_status_of_verdict", "STR-01 SCL-37", "SELECT doc_id, CASE issuer_verdict WHEN 'auto' THEN 'done' WHEN 'warn' THEN 'review' WHEN 'pendiente' THEN 'review' WHEN 'block' THEN 'blocked' ELSE 'error' END AS status FROM docs", ("docs",))
def scl_a2_status_of_verdict(spark, sf):
    return view(spark, sf, "docs").select("doc_id", events.status_of_verdict(F.col("issuer_verdict")).alias("status"))
