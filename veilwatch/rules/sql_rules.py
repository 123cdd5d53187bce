"""SQL audit rules.

Fixed values: names, patterns, categories and their order decide the verdicts.
"""

from __future__ import annotations

from typing import NamedTuple


class SqlRule(NamedTuple):
    ord: int
    block: bool
    category: str | None
    name: str
    pattern: str


# What a statement must hold, in upper case, for a rule to match: one of these texts.  They follow
# from the patterns and only spare the regular expression where it cannot match.
NEEDS = {
    1: ["DROP"], 2: ["DROP"], 3: ["DROP"], 4: ["TRUNCATE"], 5: ["DROP"], 6: ["GRANT"], 7: ["REVOKE"],
    8: ["USER", "ROLE"], 9: ["OUTFILE"], 10: ["INFILE"], 11: ["COPY"], 12: ["PG_"],
    13: ["PG_EXECUTE_SERVER_PROGRAM"], 14: ["LO_"], 15: ["XP_CMDSHELL"], 16: ["OPEN"],
    17: ["SP_CONFIGURE"], 18: ["SP_"], 19: ["UNION"], 20: [";"], 21: ["EXEC"],
    22: ["INFORMATION_SCHEMA", "PG_CATALOG", "SYS."], 23: ["SHOW"], 24: ["\\D"],
    25: ["DESCRIBE", "EXPLAIN"], 26: ["ALTER"], 27: ["DROP"], 28: ["INSERT"], 29: ["*"],
    30: ["SLEEP", "BENCHMARK"], 31: ["WAITFOR"], 32: ["="], 33: ["--", "/*"],
}

# The category that wins when one query hits several, and its threat code.
CATEGORY_PRIORITY = [
    ("RemoteExec", "SQL_REMOTE_EXEC"),
    ("Injection", "SQL_INJECTION"),
    ("PrivilegeEscalation", "SQL_PRIV_ESCALATION"),
    ("FilesystemAccess", "SQL_FILESYSTEM"),
    ("Destructive", "SQL_DESTRUCTIVE"),
]

# 21 block rules, then 12 warn rules, in evaluation order.
SQL_RULES = [
    SqlRule(1, True, "Destructive", "DROP TABLE", r"(?i)\bDROP\s+TABLE\b"),
    SqlRule(2, True, "Destructive", "DROP DATABASE / SCHEMA", r"(?i)\bDROP\s+(DATABASE|SCHEMA)\b"),
    SqlRule(3, True, "Destructive", "DROP USER / ROLE", r"(?i)\bDROP\s+(USER|ROLE)\b"),
    SqlRule(4, True, "Destructive", "TRUNCATE TABLE", r"(?i)\bTRUNCATE(\s+TABLE)?\b"),
    SqlRule(5, True, "Destructive", "ALTER TABLE DROP COLUMN",
            r"(?i)\bALTER\s+TABLE\b.{0,500}\bDROP\s+COLUMN\b"),
    SqlRule(6, True, "PrivilegeEscalation", "GRANT privileges", r"(?i)\bGRANT\s+\w"),
    SqlRule(7, True, "PrivilegeEscalation", "REVOKE privileges", r"(?i)\bREVOKE\s+\w"),
    SqlRule(8, True, "PrivilegeEscalation", "CREATE / ALTER USER or ROLE",
            r"(?i)\b(CREATE|ALTER)\s+(USER|ROLE)\b"),
    SqlRule(9, True, "FilesystemAccess", "MySQL SELECT INTO OUTFILE", r"(?i)\bINTO\s+OUTFILE\b"),
    SqlRule(10, True, "FilesystemAccess", "MySQL LOAD DATA INFILE",
            r"(?i)\bLOAD\s+DATA\s+(LOCAL\s+)?INFILE\b"),
    SqlRule(11, True, "FilesystemAccess", "PostgreSQL COPY TO/FROM filesystem",
            r"""(?i)\bCOPY\b[^;]{0,400}\b(TO|FROM)\s+['"/]"""),
    SqlRule(12, True, "FilesystemAccess", "PostgreSQL pg_read_file / pg_ls_dir / pg_stat_file",
            r"(?i)\bPG_(READ_FILE|LS_DIR|STAT_FILE)\s*\("),
    SqlRule(13, True, "FilesystemAccess", "PostgreSQL pg_execute_server_program",
            r"(?i)\bPG_EXECUTE_SERVER_PROGRAM\s*\("),
    SqlRule(14, True, "FilesystemAccess", "PostgreSQL lo_export / lo_import",
            r"(?i)\bLO_(EXPORT|IMPORT)\s*\("),
    SqlRule(15, True, "RemoteExec", "MSSQL xp_cmdshell", r"(?i)\bXP_CMDSHELL\s*\("),
    SqlRule(16, True, "RemoteExec", "MSSQL OPENROWSET / OPENDATASOURCE",
            r"(?i)\b(OPENROWSET|OPENDATASOURCE)\s*\("),
    SqlRule(17, True, "RemoteExec", "MSSQL sp_configure", r"(?i)\bSP_CONFIGURE\b"),
    SqlRule(18, True, "RemoteExec", "MSSQL sp_addlogin / sp_addsrvrolemember",
            r"(?i)\bSP_(ADDLOGIN|ADDSRVROLEMEMBER|GRANTDBACCESS)\b"),
    SqlRule(19, True, "Injection", "UNION SELECT", r"(?i)\bUNION\s+(ALL\s+)?SELECT\b"),
    SqlRule(20, True, "Injection", "Stacked query - DDL/DML after semicolon",
            r"(?i);\s*(DROP|TRUNCATE|DELETE\s+FROM|INSERT\s+INTO|UPDATE\s+\w[\w.]*\s+SET"
            r"|CREATE\s+(TABLE|DATABASE|USER)|ALTER\s+(TABLE|USER)|GRANT|EXEC(UTE)?)\b"),
    SqlRule(21, True, "Injection", "Dynamic EXEC with variable", r"(?i)\bEXEC(UTE)?\s*\(\s*@"),
    SqlRule(22, False, None, "System schema access (information_schema / pg_catalog)",
            r"(?i)\b(INFORMATION_SCHEMA|PG_CATALOG)\b|(?i)\bSYS\."),
    SqlRule(23, False, None, "SHOW DATABASES / TABLES / GRANTS / PROCESSLIST",
            r"(?i)\bSHOW\s+(DATABASES|TABLES|GRANTS|USERS|PROCESSLIST|VARIABLES|STATUS)\b"),
    SqlRule(24, False, None, "psql schema introspection meta-command",
            r"(?i)\\d[tfvisScCnpuFDE]?\b"),
    SqlRule(25, False, None, "MySQL / MariaDB DESCRIBE / EXPLAIN",
            r"(?i)\b(DESCRIBE|EXPLAIN)\s+\w"),
    SqlRule(26, False, None, "ALTER TABLE - schema modification", r"(?i)\bALTER\s+TABLE\b"),
    SqlRule(27, False, None, "DROP INDEX / VIEW / SEQUENCE / FUNCTION / PROCEDURE / TRIGGER",
            r"(?i)\bDROP\s+(INDEX|VIEW|SEQUENCE|FUNCTION|PROCEDURE|TRIGGER)\b"),
    SqlRule(28, False, None, "INSERT ... SELECT - mass data copy",
            r"(?i)\bINSERT\s+(INTO\s+)?\w[\w.]*\s+SELECT\b"),
    SqlRule(29, False, None, "SELECT * from sensitive-sounding table",
            r"(?i)\bSELECT\s+\*\s+FROM\s+\w*"
            r"(user|account|cred|token|secret|password|auth|api_?key|session)\w*\b"),
    SqlRule(30, False, None, "Time-based injection (pg_sleep / SLEEP / BENCHMARK)",
            r"(?i)\b(PG_SLEEP|SLEEP|BENCHMARK)\s*\("),
    SqlRule(31, False, None, "WAITFOR DELAY - MSSQL time-based injection",
            r"(?i)\bWAITFOR\s+DELAY\b"),
    SqlRule(32, False, None, "OR 1=1 tautology",
            r"(?i)\bOR\s+(\d+\s*=\s*\d+|\x27[^\x27]*\x27\s*=\s*\x27[^\x27]*\x27)"),
    SqlRule(33, False, None, "Comment-based injection", r"(?i)\x27.{0,60}(--|/\*)"),
]

# The missing-WHERE findings follow a statement's rule findings.
WHERE_PATTERN = r"(?i)\bWHERE\b"
DELETE_PATTERN = r"(?i)\bDELETE\s+FROM\b"
UPDATE_PATTERN = r"(?i)\bUPDATE\s+\w[\w.]*\s+SET\b"
DELETE_WITHOUT_WHERE = "DELETE FROM without WHERE (would delete every row)"
UPDATE_WITHOUT_WHERE = "UPDATE without WHERE (would update every row)"

# Referenced tables and the star projection.
TABLE_REF_PATTERNS = [
    r"(?i)\bFROM\s+([a-zA-Z_][a-zA-Z0-9_]*)",
    r"(?i)\bJOIN\s+([a-zA-Z_][a-zA-Z0-9_]*)",
    r"(?i)\bUPDATE\s+([a-zA-Z_][a-zA-Z0-9_]*)",
    r"(?i)\bINTO\s+([a-zA-Z_][a-zA-Z0-9_]*)",
]
SELECT_STAR_PATTERN = r"(?i)\bSELECT\s+\*"

SNIPPET_CHARS = 100


class SqlTool(NamedTuple):
    label: str
    dialect: str
    sql_flags: list[str]
    file_flags: list[str]
    positional: bool


# How each SQL command line tool carries its SQL.
SQL_TOOLS = {
    "psql": SqlTool("psql", "postgres", ["-c", "--command"], ["-f", "--file"], False),
    "mysql": SqlTool("mysql", "mysql", ["-e", "--execute"], ["-f", "--file"], False),
    "mariadb": SqlTool("mysql", "mysql", ["-e", "--execute"], ["-f", "--file"], False),
    "sqlite3": SqlTool("sqlite3", "sqlite", [], [], True),
}
