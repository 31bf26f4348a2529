"""Column expressions about HTTP: status codes and exceptions to fetch statuses, media types, rule expiry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CODES = {
    200: "FETCHED", 403: "HTTP_FORBIDDEN", 401: "HTTP_UNAUTHORIZED", 407: "HTTP_UNAUTHORIZED", 404: "HTTP_NOT_FOUND", 410: "HTTP_GONE",
    302: "HTTP_TOO_MANY_REDIRECTS", 303: "HTTP_TOO_MANY_REDIRECTS", 307: "HTTP_TOO_MANY_REDIRECTS", 301: "HTTP_MOVED_PERMANENTLY",
}
#: Kinds of failure that a fetcher reports. A see-other that isn't allowed counts as a redirection error.
EXCEPTIONS = {
    "slow_response": "ABORTED_SLOW_RESPONSE", "mime_type": "ABORTED_FETCH_SETTINGS", "content_size": "ABORTED_FETCH_SETTINGS", "interrupted": "SKIPPED_INTERRUPTED", "io": "ERROR_IOEXCEPTION",
    "too_many_redirects": "HTTP_TOO_MANY_REDIRECTS", "temporary_redirect": "HTTP_TOO_MANY_REDIRECTS", "permanent_redirect": "HTTP_MOVED_PERMANENTLY", "see_other": "HTTP_REDIRECTION_ERROR", "url": "ERROR_INVALID_URL",
}
HOUR_MS = 3_600_000
#: How long the rules of a robots response hold, by status.
LIFETIMES_MS = {200: 12 * HOUR_MS, 404: 24 * HOUR_MS, 500: HOUR_MS}
OTHER_LIFETIME_MS = 24 * HOUR_MS


def http_status(code: int) -> str:
    if code in _CODES:
        return _CODES[code]
    return "HTTP_SERVER_ERROR" if code < 300 or code >= 500 else "HTTP_REDIRECTION_ERROR" if code < 400 else "HTTP_CLIENT_ERROR"


def status_of_code(code: Column) -> Column:
    out = None
    for k, status in _CODES.items():
        out = F.when(code == k, status) if out is None else out.when(code == k, status)
    return out.when((code < 300) | (code >= 500), "HTTP_SERVER_ERROR").when(code < 400, "HTTP_REDIRECTION_ERROR").when(code < 500, "HTTP_CLIENT_ERROR")


def status_of_exception(kind: Column) -> Column:
    """Status of a kind of failure; an unknown kind is a server error, none is none."""
    out = F.when(kind.isNull(), F.lit(None).cast("string"))
    for k, status in EXCEPTIONS.items():
        out = out.when(kind == k, status)
    return out.otherwise("HTTP_SERVER_ERROR")


def robots_lifetime_ms(code: Column) -> Column:
    """How long the rules of a robots response hold."""
    out = None
    for k, lifetime in LIFETIMES_MS.items():
        out = F.when(code == k, lifetime) if out is None else out.when(code == k, lifetime)
    return out.otherwise(OTHER_LIFETIME_MS).cast("bigint")


def mime_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"^([^;]*)", 1)))


def charset(content_type: Column) -> Column:
    """The charset parameter, without quotes; '' if there is none."""
    return F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i);\s*charset\s*=\s*\"?'?([^;\"'\s]+)", 1)
