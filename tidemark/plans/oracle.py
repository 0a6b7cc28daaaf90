"""SQL for the queries of plans.queries, written for DuckDB over the same tables."""

from __future__ import annotations

MSGS = """msgs AS (
  SELECT event_type AS topic, user_id % 4 AS part, event_id, event_id % 4 AS flags, epoch_us(ts) // 1000 AS ts_ms, props,
    row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY event_id) - 1 AS off, event_type AS headers
  FROM events
)"""

_NUM = "NULL::BIGINT"


def _life(ph: str, kind: str, t: str, where: str, retries: str = _NUM, deadline: str = _NUM, requeue: str = "NULL::BOOLEAN", frm: str = "msgs") -> str:
    return f"SELECT topic, part, off, {t} AS t, {ph} AS ph, '{kind}' AS event_type, {retries} AS retries, {deadline} AS deadline, {requeue} AS requeue FROM {frm} WHERE {where}"


_LATER = "ts_ms + 2000 + (event_id * 7919 % 3600) * 1000"
LIVES_A = " UNION ALL ".join([
    _life("0", "Enqueue", "ts_ms", "true", retries="event_id % 3"),
    _life("1", "MarkInflight", "ts_ms + 1000", "event_id % 10 < 9", deadline="ts_ms + 31000 + (event_id % 7) * 1000"),
    _life("2", "Ack", _LATER, "event_id % 10 <= 4"),
    _life("2", "Nack", _LATER, "event_id % 10 = 5 AND event_id % 50 <> 15", requeue="true"),
    _life("2 + i", "Nack", f"{_LATER} + i", "event_id % 50 = 15", requeue="true", frm="msgs, range(6) r(i)"),
    _life("2", "Nack", _LATER, "event_id % 10 = 6", requeue="false"),
    _life("2", "DeadLetter", _LATER, "event_id % 10 = 7"),
    _life("9", "ClearInflight", "ts_ms + 5000", "event_id % 40 = 8"),
    f"SELECT topic, part, NULL AS off, max(ts_ms) AS t, 10 AS ph, 'ResetQueue' AS event_type, {_NUM}, {_NUM}, NULL::BOOLEAN "
    "FROM (SELECT *, count(*) OVER (PARTITION BY topic, part) AS n FROM msgs) WHERE part = 3 AND off < (n + 1) // 2 GROUP BY topic, part",
])
LIVES_B = " UNION ALL ".join([_life("0", "Enqueue", "ts_ms", "true", retries="event_id % 3"), _life("2", "Ack", _LATER, "event_id % 97 <> 0")])

STATE = """ev AS (
  SELECT *, row_number() OVER (PARTITION BY topic, part ORDER BY t, coalesce(off, -1), ph) - 1 AS seq FROM (LIVES)
), live AS (
  SELECT e.* FROM ev e LEFT JOIN (SELECT topic, part, max(seq) AS reset FROM ev WHERE event_type = 'ResetQueue' GROUP BY ALL) r USING (topic, part)
  WHERE off IS NOT NULL AND (reset IS NULL OR seq > reset)
), runs AS (
  SELECT *, count(*) FILTER (event_type IN ('Enqueue', 'MarkInflight')) OVER w AS run, event_type = 'Nack' AND requeue AS again
  FROM live WINDOW w AS (PARTITION BY topic, part, off ORDER BY seq)
), tries AS (
  SELECT *, count(*) FILTER (again) OVER w AS k, max(CASE WHEN event_type = 'Enqueue' THEN retries END) OVER (PARTITION BY topic, part, off, run) AS base
  FROM runs WINDOW w AS (PARTITION BY topic, part, off, run ORDER BY seq)
), ends AS (
  SELECT *, again AND coalesce(base, 0) + k - 1 >= 5 AS spent,
    event_type IN ('Ack', 'DeadLetter') OR (event_type = 'Nack' AND NOT requeue) OR (again AND coalesce(base, 0) + k - 1 >= 5) AS ends FROM tries
), marked AS (
  SELECT *, min(CASE WHEN ends THEN seq END) OVER (PARTITION BY topic, part, off) AS s FROM ends
), folded AS (
  SELECT topic, part, off, max(s) AS s,
    arg_max(event_type, seq) FILTER (event_type IN ('MarkInflight', 'ClearInflight') OR again) AS lease,
    max_by(coalesce(deadline, -1), seq) FILTER (event_type IN ('MarkInflight', 'ClearInflight') OR again) AS due,
    max_by(coalesce(base, -1), seq) FILTER (s IS NULL OR seq < s) AS base, max_by(k, seq) FILTER (s IS NULL OR seq < s) AS k,
    coalesce(bool_or(spent AND seq = s), false) AS spent, count(*) FILTER (again AND seq > s) AS m
  FROM marked GROUP BY ALL
), val AS (
  SELECT *, CASE WHEN spent THEN NULL WHEN base >= 0 THEN base + k WHEN k > 0 THEN k END AS v FROM folded
), st AS (
  SELECT topic, part, off, s IS NOT NULL AS settled, s IS NULL AND coalesce(lease = 'MarkInflight', false) AS inflight,
    CASE WHEN s IS NULL AND lease = 'MarkInflight' THEN due END AS deadline,
    CASE WHEN s IS NULL OR m = 0 THEN v WHEN m < greatest(1, 6 - coalesce(v, 0)) THEN coalesce(v, 0) + m
         ELSE nullif((m - greatest(1, 6 - coalesce(v, 0))) % 6, 0) END AS retries
  FROM val
), state AS (SELECT *, retries IS NOT NULL AS enqueued FROM st
), fr AS (
  SELECT topic, part, count(*) FILTER (off = rn) AS acked_until FROM (
    SELECT topic, part, off, row_number() OVER (PARTITION BY topic, part ORDER BY off) - 1 AS rn FROM state WHERE settled) GROUP BY ALL
), queues AS (SELECT DISTINCT topic, part FROM msgs)"""

A = f"WITH {MSGS}, {STATE.replace('LIVES', LIVES_A)} "
B = f"WITH {MSGS}, {STATE.replace('LIVES', LIVES_B)} "
M = f"WITH {MSGS} "
LOG = f"WITH {MSGS}, log AS (SELECT *, off // 50 * 50 AS segment_base FROM msgs WHERE event_id % 13 <> 5) "
SEGS = LOG + ", segs AS (SELECT *, lead(base) OVER (PARTITION BY topic, part ORDER BY base) AS next_base FROM (SELECT topic, part, segment_base AS base, max(off) AS last_off, count(*) AS n_records FROM log GROUP BY ALL)) "
CUT = B + ", log AS (SELECT *, off // 50 * 50 AS segment_base FROM msgs WHERE event_id % 13 <> 5)" + SEGS.split("WHERE event_id % 13 <> 5) ")[1] + ", cut AS (SELECT topic, part, coalesce(acked_until, 0) AS before FROM queues LEFT JOIN fr USING (topic, part)), gone AS (SELECT topic, part, base, last_off, n_records, before FROM segs JOIN cut USING (topic, part) WHERE next_base - 1 < before) "
NOW = "(SELECT (min(ts_ms) + max(ts_ms)) // 2 FROM msgs)"
NAMES = r"""WITH p AS (SELECT p_type, lower(p_name) AS n, regexp_replace(lower(p_type), '[^a-z0-9]+', '.', 'g') AS d FROM part),
names AS (SELECT DISTINCT unnest([p_type, d, '.' || d, d || '..x', n || '..y', replace(n, ' ', '_'), '', repeat(d, 20), d || '..É']) AS name FROM p) """
SIZE = "36 + strlen(headers) + strlen(props)"
STATE_COLUMNS = "topic, part, off, settled, inflight, deadline, enqueued, retries"
SETTLED = A + ", ended AS (SELECT topic, part, off, seq, CASE WHEN event_type = 'Ack' THEN 'ack' WHEN event_type = 'DeadLetter' THEN 'dead_letter' WHEN spent THEN 'retries_exhausted' ELSE 'nack' END AS reason FROM marked WHERE ends AND seq = s) "

#: Where a writer would put each record, one record after the other: rolls by whole batches of 16, an index entry each 2048 bytes.
PLACED = f"""WITH RECURSIVE {MSGS}, r AS (
  SELECT topic, part, off, {SIZE} AS size, sum({SIZE}) OVER (PARTITION BY topic, part, off // 16) AS together FROM msgs
), walk AS (
  SELECT topic, part, off, off AS segment_base, cast(68 AS BIGINT) AS file_pos, size, cast(68 AS BIGINT) AS mark, false AS indexed FROM r WHERE off = 0
  UNION ALL
  SELECT topic, part, off, segment_base, file_pos, size, CASE WHEN file_pos - mark >= 2048 THEN file_pos ELSE mark END, file_pos - mark >= 2048 FROM (
    SELECT n.topic, n.part, n.off, n.size, CASE WHEN rolls THEN n.off ELSE segment_base END AS segment_base,
      CASE WHEN rolls THEN 68 ELSE reached END AS file_pos, CASE WHEN rolls THEN 68 ELSE mark END AS mark FROM (
      SELECT r.topic, r.part, r.off, r.size, w.segment_base, w.mark, w.file_pos + w.size AS reached,
        r.off % 16 = 0 AND w.file_pos + w.size + r.together > 16384 AS rolls
      FROM walk w JOIN r ON r.topic = w.topic AND r.part = w.part AND r.off = w.off + 1) n)
), placed AS (SELECT topic, part, off, segment_base, cast(file_pos AS BIGINT) AS file_pos, indexed FROM walk) """
#: The batch of each record: it leaves when it has 16 records or 1200 bytes, or when the next arrival comes an hour or more after its last.
BATCHED = f"""WITH RECURSIVE {MSGS}, r AS (SELECT topic, part, off, ts_ms, {SIZE} AS size FROM msgs
), walk AS (
  SELECT topic, part, off, ts_ms, size, cast(0 AS BIGINT) AS batch, cast(1 AS BIGINT) AS held, cast(size AS BIGINT) AS bytes FROM r WHERE off = 0
  UNION ALL
  SELECT topic, part, off, ts_ms, size, CASE WHEN fresh THEN batch + 1 ELSE batch END, CASE WHEN fresh THEN 1 ELSE held + 1 END, CASE WHEN fresh THEN size ELSE bytes + size END FROM (
    SELECT r.topic, r.part, r.off, r.ts_ms, r.size, w.batch, w.held, w.bytes, w.held >= 16 OR w.bytes >= 1200 OR r.ts_ms >= w.ts_ms + 3600000 AS fresh
    FROM walk w JOIN r ON r.topic = w.topic AND r.part = w.part AND r.off = w.off + 1)
), batches AS (
  SELECT topic, part, batch, max(held) AS n, max(bytes) AS bytes, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM walk GROUP BY ALL
) """

RECORDS = M + "SELECT topic, part, off AS offset, ts_ms AS timestamp_ms, cast(flags AS INTEGER) AS flags, md5(props) AS payload_md5 FROM msgs"

ORACLE_SQL = {
    "log_append_twice": RECORDS,
    "log_append_again": RECORDS,
    "log_scan_range": RECORDS + " WHERE off >= 17 AND off < 120",
    "log_point_fetch": RECORDS + " WHERE topic = 'view' AND part = 2 AND off = 7",
    "log_watermarks": M + "SELECT topic, part, 0 AS head, count(*) AS tail, count(*) - 1 AS durable, (count(*) + 49) // 50 AS segments FROM msgs GROUP BY ALL",
    "log_resync": RECORDS + " WHERE off <> 5",
    "log_stop": RECORDS + " WHERE off < 5",
    "log_torn_tail": RECORDS,
    "log_cleanup": M + "SELECT topic, part, n // 2 // 50 * 50 AS head, n // 2 // 50 * 50 AS first_read, n - n // 2 // 50 * 50 AS n_read FROM (SELECT topic, part, count(*) AS n FROM msgs GROUP BY ALL)",
    "dead_letter_routing": SETTLED + "SELECT topic || '.dead' AS topic, part, off AS source_off, reason, md5(props) AS payload_md5 FROM msgs JOIN ended USING (topic, part, off) WHERE reason <> 'ack'",
    "queue_summary": A + """SELECT q.topic, q.part, coalesce(acked_until, 0) AS acked_until, coalesce(n_settled, 0) AS n_settled, coalesce(n_inflight, 0) AS n_inflight,
      coalesce(n_enqueued, 0) AS n_enqueued, min_deadline, applied_upto FROM (SELECT topic, part, max(seq) + 1 AS applied_upto FROM ev GROUP BY ALL) q
      LEFT JOIN (SELECT topic, part, count(*) FILTER (settled) AS n_settled, count(*) FILTER (inflight) AS n_inflight, count(*) FILTER (enqueued) AS n_enqueued, min(deadline) AS min_deadline FROM state GROUP BY ALL) USING (topic, part)
      LEFT JOIN fr USING (topic, part)""",
    "ack_frontier": B + "SELECT topic, part, coalesce(acked_until, 0) AS acked_until FROM queues LEFT JOIN fr USING (topic, part)",
    "offset_state": A + f"SELECT {STATE_COLUMNS} FROM state",
    "offset_state_fold": A + f"SELECT {STATE_COLUMNS} FROM state",
    "incremental_replay": A + f"SELECT {STATE_COLUMNS} FROM state",
    "incremental_replay_equals_full": A + f"SELECT {STATE_COLUMNS} FROM state WHERE false",
    "is_acked_lookup": A + """SELECT topic, part, off, acked, inflight, acked OR inflight AS inflight_or_acked, enqueued, retries FROM (
      SELECT topic, part, m.off, coalesce(m.off < acked_until, false) OR coalesce(settled, false) AS acked, coalesce(inflight, false) AS inflight, coalesce(enqueued, false) AS enqueued, retries
      FROM msgs m LEFT JOIN state USING (topic, part, off) LEFT JOIN fr USING (topic, part))""",
    "inflight_dump": A + "SELECT topic, part, off, deadline FROM state WHERE inflight",
    "inflight_count": A + "SELECT topic, part, count(off) AS n_inflight FROM queues LEFT JOIN (SELECT * FROM state WHERE inflight) USING (topic, part) GROUP BY ALL",
    "next_expiry_hint": A + "SELECT topic, part, min(deadline) AS next_expiry FROM state GROUP BY ALL",
    "next_expiry_hint_global": A + "SELECT min(deadline) AS next_expiry FROM state",
    "list_expired": A + f"SELECT topic, part, off, deadline FROM state WHERE inflight AND deadline <= {NOW} ORDER BY topic, part, deadline, off DESC LIMIT 100",
    "expired_top_k_per_queue": A + f"SELECT topic, part, off, deadline, row_number() OVER (PARTITION BY topic, part ORDER BY deadline, off DESC) AS rank FROM state WHERE inflight AND deadline <= {NOW} QUALIFY rank <= 5",
    "next_deliverable": A + """, asked AS (SELECT DISTINCT topic, part, unnest([0, n // 3, n // 2]) AS start, n AS upper FROM (SELECT topic, part, count(*) AS n FROM msgs GROUP BY ALL))
      SELECT a.topic, a.part, start, upper, coalesce(min(m.off), upper) AS next_off FROM asked a LEFT JOIN fr USING (topic, part)
      LEFT JOIN (SELECT topic, part, off FROM msgs ANTI JOIN (SELECT * FROM state WHERE settled OR inflight) USING (topic, part, off)) m
        ON m.topic = a.topic AND m.part = a.part AND m.off >= greatest(start, coalesce(acked_until, 0)) AND m.off < upper GROUP BY a.topic, a.part, start, upper""",
    "ready_semi_join": A + "SELECT topic, part, off, ts_ms FROM msgs SEMI JOIN (SELECT * FROM state WHERE enqueued) USING (topic, part, off)",
    "ready_messages": A + "SELECT topic, part, off, ts_ms FROM msgs SEMI JOIN (SELECT * FROM state WHERE enqueued AND NOT settled) USING (topic, part, off)",
    "fetch_available_anti_join": A + """SELECT topic, part, off, ts_ms FROM msgs ANTI JOIN (SELECT * FROM state WHERE settled OR inflight) USING (topic, part, off) WHERE off >= 10
      QUALIFY row_number() OVER (PARTITION BY topic, part ORDER BY off) <= 20""",
    "retry_counts": A + "SELECT topic, part, retries, count(*) AS n FROM state WHERE enqueued GROUP BY ALL",
    "dead_letters": SETTLED + "SELECT * FROM ended WHERE reason IN ('dead_letter', 'nack')",
    "retry_exhausted": SETTLED + "SELECT topic, part, off, seq FROM ended WHERE reason = 'retries_exhausted'",
    "settlement_reasons": SETTLED + "SELECT topic, part, reason, count(*) AS n FROM ended GROUP BY ALL",
    "out_of_order_acks": A + "SELECT topic, part, off, acked_until FROM state JOIN fr USING (topic, part) WHERE settled AND off > acked_until",
    "ack_bitmap_sizes": B + "SELECT topic, part, count(*) AS n_ahead FROM state JOIN fr USING (topic, part) WHERE settled AND off > acked_until GROUP BY ALL",
    "offset_gaps": LOG + "SELECT topic, part, prev + 1 AS gap_from, off - 1 AS gap_to FROM (SELECT topic, part, off, lag(off) OVER (PARTITION BY topic, part ORDER BY off) AS prev FROM log) WHERE off > prev + 1",
    "list_queues": A + "SELECT DISTINCT topic, part FROM ev",
    "list_topics": A + "SELECT DISTINCT topic FROM ev",
    "validate_violations": A + """SELECT topic, part, off, 'lease below frontier' AS rule FROM state JOIN fr USING (topic, part) WHERE inflight AND (off < acked_until OR settled)
      UNION ALL SELECT topic, part, off, 'unsettled below frontier' FROM state JOIN fr USING (topic, part) WHERE off < acked_until AND NOT settled""",
    "canonical_dump": A + """SELECT topic, part, coalesce(acked_until, 0) AS acked_until,
      coalesce(string_agg(off::VARCHAR, ',' ORDER BY off) FILTER (settled AND off > coalesce(acked_until, 0)), '') AS ahead,
      coalesce(string_agg(off || ':' || deadline, ',' ORDER BY off) FILTER (inflight), '') AS inflight,
      coalesce(string_agg(off || ':' || retries, ',' ORDER BY off) FILTER (enqueued), '') AS enqueued
      FROM state LEFT JOIN fr USING (topic, part) GROUP BY topic, part, acked_until""",
    "safe_truncate_before": B + "SELECT topic, min(coalesce(acked_until, 0)) AS safe_before FROM queues LEFT JOIN fr USING (topic, part) GROUP BY topic",
    "scan_from": M + "SELECT topic, part, off, ts_ms, props AS payload FROM msgs WHERE topic = 'click' AND part = 1 AND off >= 10 ORDER BY off LIMIT 50",
    "fetch_by_offset": M + "SELECT topic, part, off, ts_ms, cast(flags AS INTEGER) AS flags, props AS payload FROM msgs WHERE topic = 'view' AND part = 2 AND off = 7",
    "head_tail_watermarks": LOG + "SELECT topic, part, min(off) AS head, max(off) + 1 AS tail, max(off) AS durable, count(*) AS n_records FROM log GROUP BY ALL",
    "segment_list": SEGS + "SELECT * FROM segs",
    "segment_floor_lookup": SEGS + "SELECT l.topic, l.part, l.off, base FROM log l ASOF LEFT JOIN segs s ON l.topic = s.topic AND l.part = s.part AND l.off >= s.base",
    "segment_assignment": PLACED + "SELECT * FROM placed",
    "sparse_index_entries": PLACED + "SELECT topic, part, off, segment_base, file_pos FROM placed WHERE indexed",
    "index_seek": PLACED + """SELECT p.topic, p.part, p.off, p.segment_base, coalesce(e.file_pos, 68) AS start_pos FROM placed p
      ASOF LEFT JOIN (SELECT * FROM placed WHERE indexed) e ON p.topic = e.topic AND p.part = e.part AND p.segment_base = e.segment_base AND p.off >= e.off""",
    "batch_flush_reasons": BATCHED + """SELECT topic, part, batch, CASE WHEN n >= 16 THEN 'MaxRecords' WHEN bytes >= 1200 THEN 'MaxBytes'
      WHEN batch < max(batch) OVER (PARTITION BY topic, part) THEN 'Timeout' ELSE 'Shutdown' END AS flush_reason, n, bytes, first_ms, last_ms FROM batches""",
    "record_positions": LOG + f"SELECT topic, part, off, segment_base, {SIZE} AS size, cast(sum({SIZE}) OVER (PARTITION BY topic, part, segment_base ORDER BY off) - ({SIZE}) + 68 AS BIGINT) AS file_pos FROM log",
    "record_bytes_len": M + f"SELECT topic, part, cast(sum({SIZE}) AS BIGINT) AS bytes, count(*) AS records FROM msgs GROUP BY ALL",
    "retention_deletable_segments": CUT + "SELECT * FROM gone",
    "retention_new_heads": CUT + "SELECT topic, part, min(base) AS head FROM segs ANTI JOIN gone USING (topic, part, base) GROUP BY ALL",
    "offset_assignment": M + "SELECT topic, part, event_id, off FROM msgs WHERE event_id >= 100",
    "batch_linger_sessions": M + """SELECT topic, part, session, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM (
      SELECT *, cast(sum(new) OVER (PARTITION BY topic, part ORDER BY off) AS BIGINT) AS session FROM (
        SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY topic, part ORDER BY off) < 3600000 THEN 0 ELSE 1 END AS new FROM msgs)) GROUP BY ALL""",
    "monotonic_clock": M + "SELECT topic, part, off, clock, max(clock) OVER (PARTITION BY topic, part ORDER BY off) AS now FROM (SELECT *, ts_ms + event_id * 7919 % 5000000 AS clock FROM msgs)",
    "topic_validate": NAMES + r"SELECT name, strlen(name) BETWEEN 1 AND 128 AND regexp_full_match(name, '[a-z0-9_.-]+') AND NOT contains(name, '..') AND NOT starts_with(name, '.') AND NOT ends_with(name, '.') AS ok FROM names",
    "topic_error_class": NAMES + r"""SELECT name, CASE WHEN strlen(name) NOT BETWEEN 1 AND 128 THEN 'InvalidLength' WHEN starts_with(name, '.') OR ends_with(name, '.') THEN 'DotEdge'
      WHEN odd > 0 AND (dots = 0 OR odd < dots + 1) THEN 'InvalidChar' WHEN dots > 0 THEN 'DoubleDot' END AS error FROM (
      SELECT name, instr(name, '..') AS dots, CASE WHEN regexp_matches(name, '[^a-z0-9._-]') THEN length(regexp_extract(name, '^([a-z0-9._-]*)', 1)) + 1 ELSE 0 END AS odd FROM names)""",
    "path_encode": "SELECT doc_id, replace(url_encode(text || '*~+/ %'), '~', '%7E') AS component FROM documents",
    "segment_file_names": LOG + "SELECT DISTINCT topic, part, printf('%020d.log', segment_base) AS log_name, printf('%020d.idx', segment_base) AS idx_name, printf('%010d', part) AS part_dir FROM log",
    "durability_levels": M + "SELECT CASE WHEN event_id % 3 = 0 THEN 'AfterWrite' ELSE 'AfterFsync' END AS effective, count(*) AS n FROM msgs GROUP BY ALL",
    "codec_roundtrip": M + f"SELECT topic, part, off, ts_ms, cast(flags AS INTEGER) AS flags, md5(props) AS payload_md5, {SIZE} AS size FROM msgs",
    "event_codec_roundtrip": A + "SELECT topic, part, seq, event_type, off, retries, deadline, requeue FROM ev",
    "crc32c_check": "SELECT event_id, true AS agrees FROM events",
}
ORACLE_SQL |= {"event_log_replay": ORACLE_SQL["queue_summary"], "snapshot_recovery": ORACLE_SQL["offset_state"]}
