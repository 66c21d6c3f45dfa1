"""Rules on documents and jobs as expressions: states, failures, leases, limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Allowed changes of a document's state, phases in order, limits.
TRANSITIONS = {
    "uploaded": ["validating", "failed", "deleting"],
    "validating": ["stored", "failed", "deleting"],
    "stored": ["processing", "failed", "deleting"],
    "processing": ["ready", "failed", "deleting"],
    "ready": ["processing", "deleting"],
    "failed": ["validating", "processing", "deleting"],
    "deleting": [],
}
ACTIVE = ["uploaded", "validating", "stored", "processing"]
PHASES = ["uploading", "queued", "validating", "parsing", "chunking", "embedding", "indexing", "ready"]
MAX_UPLOAD, MIN_UPLOAD, MAX_ATTEMPTS, LEASE_SECONDS = 25 * 1024 * 1024, 1, 4, 300
QUEUED_PER_OWNER, PENDING_BYTES = 20, 200 * 1024 * 1024
RATE_LIMITS = {"chat": (30, 60), "embed": (120, 60), "upload": (20, 300), "client_error": (20, 300)}
SCHEMA_ERRORS = {"PGRST202": "function_not_resolved", "PGRST203": "ambiguous_function", "42883": "undefined_function", "42703": "undefined_column"}
# What tells exhausted quotas and bad credentials, by code, by type and within the message.
QUOTA = (["credit_balance_exhausted", "insufficient_quota", "billing_not_active", "account_deactivated", "quota_exceeded"], ["insufficient_quota", "credit_balance_exhausted", "billing_error"], ["insufficient_quota", "credit_balance_exhausted", "credit balance", "exceeded your current quota", "check your plan and billing", "billing reasons", "quota exceeded", "quota limit reached", "daily quota", "billing is not enabled", "billing not enabled"])
CREDENTIALS = (["invalid_api_key", "unauthorized", "forbidden", "authentication_error", "permission_denied", "api_key_invalid"], ["authentication_error", "permission_denied", "api_key_invalid"], ["invalid api key", "incorrect api key", "rejected our credentials", "invalid_api_key", "unauthorized", "api key not valid", "api_key_invalid", "unregistered callers"])


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _told(rules: tuple, status: Column, statuses: list[int], code: Column, kind: Column, message: Column) -> Column:
    codes, kinds, parts = rules
    code, kind = F.coalesce(F.lower(F.trim(code)), F.lit("")), F.coalesce(F.lower(F.trim(kind)), F.lit(""))
    text = F.lower(F.concat_ws(" ", message, code, kind))
    return F.coalesce(status.isin(statuses), F.lit(False)) | code.isin(codes) | kind.isin(kinds) | _any([F.contains(text, F.lit(p)) for p in parts])


def classify_failure(status: Column, code: Column, kind: Column, message: Column) -> Column:
    """struct(class, code) of a failure; the first rule that fits decides."""
    said = lambda c, n: F.struct(F.lit(c).alias("class"), F.lit(n).alias("code"))
    is_ = lambda c, *v: F.coalesce(c.isin(*v), F.lit(False))
    return (
        F.when(is_(code, "ZERO_COST_AI_BLOCKED"), said("PERMANENT", "AI_DISABLED"))
        .when(_told(QUOTA, status, [402], code, kind, message), said("PERMANENT", "CREDITS_EXHAUSTED"))
        .when(_told(CREDENTIALS, status, [401, 403], code, kind, message), said("PERMANENT", "INVALID_CREDENTIALS"))
        .when(is_(status, 429) | is_(code, "rate_limit_exceeded", "resource_exhausted") | is_(kind, "requests", "tokens", "resource_exhausted"), said("RESOURCE_LIMIT", "RATE_LIMITED"))
        .when(status >= 500, said("DEPENDENCY", "UPSTREAM_ERROR")).when(status >= 400, said("PERMANENT", "UPSTREAM_REJECTED"))
        .when(F.rlike(message, F.lit("(?i)timed? ?out|network|fetch failed|socket|econnreset|econnrefused")), said("DEPENDENCY", "UPSTREAM_TIMEOUT"))
        .when(F.rlike(message, F.lit("(?i)dimensions?, expected|width mismatch")), said("PERMANENT", "UPSTREAM_REJECTED"))
        .otherwise(said("TRANSIENT", "UNEXPECTED"))
    )


def is_retryable(failure_class: Column, attempts: Column) -> Column:
    return (failure_class != "PERMANENT") & (attempts < MAX_ATTEMPTS)


def backoff_seconds(attempts: Column, failure_class: Column) -> Column:
    """Doubling from 5 s (30 s for resource limits) to 600 s; without jitter."""
    base = F.when(failure_class == "RESOURCE_LIMIT", 30).otherwise(5)
    return F.least(base * F.pow(F.lit(2), F.greatest(attempts - 1, F.lit(0))), F.lit(600)).cast("long")


def lease_state(status: Column, locked_at: Column, now: Column) -> Column:
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(locked_at.cast("timestamp"))
    return F.when(~status.eqNullSafe(F.lit("running")), "not_running").when(locked_at.isNull() | (age >= LEASE_SECONDS), "expired").otherwise("active")


def phase_step(phase: Column) -> Column:
    """Place of a phase among the work phases, from 1; 0 for others."""
    return F.coalesce(F.array_position(F.array(*(F.lit(p) for p in PHASES)), phase), F.lit(0))


def validate_upload(size: Column, reserved_size: Column, sha: Column, reserved_sha: Column, typed: Column) -> Column:
    """The first of the upload's faults, or ok."""
    return (
        F.when(size < MIN_UPLOAD, "EMPTY_FILE").when(size > MAX_UPLOAD, "TOO_LARGE").when(~typed, "BAD_CONTENT_TYPE")
        .when(reserved_size.isNotNull() & (size != reserved_size), "SIZE_MISMATCH").when(reserved_sha.isNotNull() & (sha != reserved_sha), "HASH_MISMATCH").otherwise("ok")
    )


def safe_error_code(code: Column) -> Column:
    return F.when(F.rlike(code, F.lit("^[A-Z0-9_]{1,64}$")), code).otherwise("OPERATION_FAILED")


def schema_error_kind(code: Column) -> Column:
    return reduce(lambda out, kv: out.when(code == kv[0], kv[1]), SCHEMA_ERRORS.items(), F.when(F.lit(False), ""))


def severity(status: Column) -> Column:
    return F.when(status == "error", "error").when(status == "refused", "warn").otherwise("info")


def progress_percent(done: Column, total: Column) -> Column:
    return F.lit(40) + F.round(done / total * 45).cast("long")


def safe_rate(n: Column, d: Column) -> Column:
    return F.when(d <= 0, 0.0).otherwise(n / d)


def chunk_uuid(document: Column, version: Column, index: Column) -> Column:
    """Name-based UUID of a chunk: the same document, version and place give the same id."""
    h = F.sha2(F.concat(document.cast("string"), F.lit(":v"), version.cast("string"), F.lit(":"), index.cast("string")).cast("binary"), 256)
    digit = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(digit, F.substring(h, 18, 3)), F.substring(h, 21, 12))
