"""Record schemas, fetch statuses and constants of the crawl."""

from __future__ import annotations

#: Every fetch status, in order, with the priority of the four that have one of their own; the others have 50.
STATUSES = (
    "SKIPPED_BLOCKED", "SKIPPED_INVALID_URL", "SKIPPED_DEFERRED", "SKIPPED_BY_SCORE", "SKIPPED_FILTERED", "SKIPPED_PER_SERVER_LIMIT", "SKIPPED_CRAWLDELAY",
    "SKIPPED_INTERRUPTED", "SKIPPED_INEFFICIENT", "ABORTED_SLOW_RESPONSE", "ABORTED_FETCH_SETTINGS", "HTTP_REDIRECTION_ERROR", "HTTP_TOO_MANY_REDIRECTS",
    "HTTP_MOVED_PERMANENTLY", "HTTP_CLIENT_ERROR", "HTTP_UNAUTHORIZED", "HTTP_FORBIDDEN", "HTTP_NOT_FOUND", "HTTP_GONE", "HTTP_SERVER_ERROR", "ERROR_INVALID_URL",
    "ERROR_IOEXCEPTION", "UNFETCHED", "QUEUED", "FETCHING", "FETCHED",
)
PRIORITY = {s: 50 for s in STATUSES} | {"UNFETCHED": 0, "QUEUED": 10, "FETCHING": 10, "FETCHED": 25}
#: Statuses of a URL that the crawl is at work on; no new URL may come with one.
ACTIVE = ("QUEUED", "FETCHING")

RAW_URL = "url string, score double"
CRAWL_STATE = "url string, pld string, status string, previous_status string, status_time bigint, score double, next_fetch_time bigint"
FETCH_URL = "url string, score double, crawl_delay_ms bigint"
FETCH_RESULT = "url string, score double, status string, status_time bigint, fetched_url string, headers map<string,array<string>>, content binary, content_type string, response_rate int, next_fetch_time bigint"
PARSED = "url string, fetched_url string, title string, language string, parsed_text string, meta map<string,string>, score double, base string, outlinks array<struct<url:string,anchor_text:string,rel:string,score:double>>"

DEFAULT_SCORE = 1.0
DEFAULT_CRAWL_DELAY_MS = 10_000
NO_FORCED_DELAY = -1
BLOCKED_RETRY_MS = 100_000_000
QUEUE_SIZE = 10_000
MAX_IN_FLIGHT = 100
MAX_OUTLINKS = 50
MAX_EXTRACTED_LINKS = 51
MOVING_AVERAGE = 10
MIN_DOMAIN_SCORE = 0.01
TARGET_INTERVAL_MS = 200
MAX_INTERVAL_MS = 1000
RATE_SECONDS = 30
