"""Per-key transitions of the lease state machines, one event at a time."""

from __future__ import annotations

# End of time for finished records, minimum lease, attempt bound, reasons never retried.
FOREVER = 253402300799000000
MIN_LEASE_SECONDS = 10
MAX_ATTEMPTS = 3
TERMINAL_REASONS = ("invalid_webhook_url", "http_400", "payload_construction_error")
NO_DELIVERY = ("", "none", "unknown")

US = 1_000_000


def lease_end(ts: int, ttl_seconds: int) -> int:
    return ts + max(MIN_LEASE_SECONDS, ttl_seconds) * US


def reservation(state, op, ts, ref, ttl):
    """STR-03 / STR-04. ``state`` is None or (status, analysis id, expiry).
    Returns the new state and what happened."""
    if op == "complete":
        kept = ref or (state[1] if state else "")
        return ("completed", kept, FOREVER), "completed"
    if op == "release":
        return (None, "released") if state and state[0] == "in_progress" else (state, "noop")
    if state:
        status, analysis, expiry = state
        if status == "completed" and analysis:
            return state, "already_completed"
        if status == "in_progress" and ts < expiry:
            return state, "in_progress"
    return ("in_progress", "", lease_end(ts, ttl)), "reserved"


def dispatch(state, op, ts, ref, ttl, allow_unknown=False):
    """STR-05 / STR-06. ``state`` is None or (status, claim, attempts, reason, expiry).
    A claim's fencing token numbers all claims of the key, also over a release,
    so no token comes twice; ``ref`` carries the token (or a reason as
    ``token|reason``) of a later report, empty meaning any token."""
    token, _, reason = (ref or "").partition("|")
    claims = int(state[1][1:] or 0) if state and state[1].startswith("c") else 0
    free, state = state, (None if state and state[0] == "free" else state)
    fits = bool(state) and (token == "" or token == state[1])
    if op == "success":
        if not state:
            return ("sent", token, 1, "delivered", FOREVER), "sent"
        if state[0] == "sending" and fits:
            return ("sent", state[1], state[2], "delivered", FOREVER), "sent"
        return free, "rejected"
    if op in ("failure", "unknown"):
        if fits and state[0] != "sent":
            return ("failed" if op == "failure" else "unknown", state[1], state[2], reason or op, ts), op
        return free, "rejected"
    if op == "release":
        return (("free", state[1], 0, "", ts), "released") if state and state[0] == "sending" and fits else (free, "rejected")
    if not state:
        return ("sending", f"c{claims + 1}", 1, "", lease_end(ts, ttl)), "claimed"
    status, _, attempts, last, expiry = state
    if status == "sent":
        return state, "already_sent"
    if status == "sending" and ts < expiry:
        return state, "in_progress"
    if status == "failed" and last.lower() in TERMINAL_REASONS:
        return state, "terminal_failure"
    if status == "unknown" and not allow_unknown:
        return state, "ambiguous_delivery_held"
    if attempts >= MAX_ATTEMPTS:
        return state, "max_attempts_exceeded"
    return ("sending", f"c{claims + 1}", attempts + 1, "", lease_end(ts, ttl)), "claimed"
