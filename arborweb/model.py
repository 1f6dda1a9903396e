"""Table schemas, status classes and other fixed values."""

from __future__ import annotations

DOM_NODES = "page_id BIGINT, url STRING, pre INT, size INT, level INT, parent INT, tag STRING, attrs MAP<STRING, STRING>, text STRING, tail STRING, content STRING, inner STRING"

PAIRS = "ARRAY<STRUCT<k: STRING, v: STRING>>"

REQUESTS = (
    f"request_id STRING, parent_id STRING, method STRING, url STRING, params {PAIRS}, data {PAIRS}, json STRING, "
    "headers MAP<STRING, STRING>, cookies MAP<STRING, STRING>, files STRING, auth STRUCT<user: STRING, password: STRING>, "
    "connect_timeout DOUBLE, read_timeout DOUBLE, allow_redirects BOOLEAN, proxies MAP<STRING, STRING>, verify STRING, stream BOOLEAN, "
    "cert STRUCT<cert: STRING, key: STRING>, data_bytes BINARY, incidental STRING, continuation STRING, current_location STRING, "
    "accumulated_data STRING, permanent STRING, priority INT, dedup_key STRING, skip_dedup BOOLEAN, is_speculative BOOLEAN, "
    "speculation_id STRUCT<entry: STRING, param_index: INT, n: BIGINT>, via_json STRING, archive BOOLEAN, nonnavigating BOOLEAN, "
    "bypass_rate_limit BOOLEAN, reseedable BOOLEAN, expected_type STRING, archive_hash_header STRING"
)

RESPONSES = "request_id STRING, status_code INT, headers MAP<STRING, STRING>, content BINARY, text STRING, url STRING, is_archive BOOLEAN, file_url STRING"

RESULTS = "request_id STRING, model STRING, data STRING, valid BOOLEAN, errors ARRAY<STRUCT<loc: STRING, msg: STRING, type: STRING>>"

# Methods, statuses and defaults of requests.
METHODS = ("GET", "OPTIONS", "POST", "PUT", "DELETE", "PATCH", "HEAD")
DEFAULT_PRIORITY = 9
ARCHIVE_PRIORITY = 1
DEFAULT_TIMEOUT = 60.0
#: Stands for a 2xx answer that holds an error.
SOFT_FAILURE = 555

# Status codes by class. All others are persistent.
SUCCESSFUL = (200, 201, 202, 203, 204, 205, 206, 207, 208, 226, 304)
TRANSIENT = (408, 425, 429, 502, 503, 504)
PERSISTENT = (
    *range(400, 408), *range(409, 419), *range(421, 425), 426, 428, 431, 451, 500, 501, *range(505, 509), 510, 511,
)

STATUSES = ("in_development", "active", "retired")

#: What a scraper may ask of its transport. At most one of the two browser profiles.
DRIVER_REQUIREMENTS = ("js_eval", "ff_alike", "chrome_alike", "hcap_handler", "rcap_handler", "cfcap_handler", "h11_header_fixes", "follow_redirects", "strictly_serial")
