"""Schemas of the tables that the engine reads, makes and keeps."""

LOG_RECORDS = (
    "topic string, part long, kind string, offset long, timestamp_ms long, flags int, "
    "headers binary, payload binary, segment_base long, file_pos long"
)
QUEUE_EVENTS = (
    "topic string, part long, seq long, event_type string, off long, retries long, "
    "deadline long, requeue boolean, blob binary"
)
OFFSET_STATE = (
    "topic string, part long, off long, settled boolean, inflight boolean, "
    "deadline long, enqueued boolean, retries long"
)
QUEUE_STATE = (
    "topic string, part long, acked_until long, n_settled long, n_inflight long, "
    "n_enqueued long, min_deadline long, applied_upto long"
)
EVENT_TYPES = ("Enqueue", "MarkInflight", "Ack", "Nack", "DeadLetter", "ClearInflight", "ResetQueue", "Snapshot")
MAX_RETRIES = 5
QUEUE = ["topic", "part"]
