"""Fixed values of the column masks and their SQL text per dialect."""

from __future__ import annotations

REDACTED = "[REDACTED]"
EMAIL_TAIL = "***@***.***"
PHONE_HEAD = "***-**-"
PHONE_DIGITS = 4
PARTIAL_TAIL = "***"
PARTIAL_MAX = 255

DIRECTIVES = ["fblock", "fmask", "block", "mask"]

# The masking expression written into a query; {c} is the column, {n} the length.
SQL_TEXT = {
    ("redact", "postgres"): "'[REDACTED]' AS {c}",
    ("redact", "mysql"): "'[REDACTED]' AS {c}",
    ("redact", "sqlite"): "'[REDACTED]' AS {c}",
    ("email", "postgres"): "(left({c}::text, 1) || '***@***.***') AS {c}",
    ("email", "mysql"): "CONCAT(LEFT({c}, 1), '***@***.***') AS {c}",
    ("email", "sqlite"): "CONCAT(LEFT({c}, 1), '***@***.***') AS {c}",
    ("phone", "postgres"): "('***-**-' || right({c}::text, 4)) AS {c}",
    ("phone", "mysql"): "CONCAT('***-**-', RIGHT({c}, 4)) AS {c}",
    ("phone", "sqlite"): "CONCAT('***-**-', RIGHT({c}, 4)) AS {c}",
    ("partial", "postgres"): "(left({c}::text, {n}) || '***') AS {c}",
    ("partial", "mysql"): "CONCAT(LEFT({c}, {n}), '***') AS {c}",
    ("partial", "sqlite"): "CONCAT(LEFT({c}, {n}), '***') AS {c}",
}
