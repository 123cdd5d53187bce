"""Decision rows for the key-value command line tool.

Fixed values: verdicts and texts.  ``sub`` is the second positional argument: a name, ``*`` for
any other or none.  Text markers: ``<mod>`` second argument or "none", ``<sub>`` second argument or
the row's ``missing`` text, ``<rest>`` arguments from the second on, ``<rest2>`` from the third on,
``<third>`` the third as an optional value, ``<host>`` and ``<port>`` second and third or "?",
``<keys>`` number of arguments after the command.
"""

from __future__ import annotations

from typing import NamedTuple


class KvRule(NamedTuple):
    command: str
    sub: str
    verdict: str
    subject: str
    detail: str
    missing: str = ""


# Flags that swallow the next token.
VALUE_FLAGS = [
    "-h", "--host", "-p", "--port", "-a", "--auth",
    "-n", "--db", "-u", "--uri", "--pass", "--user",
    "--cert", "--key", "--cacert", "--sni", "--tls",
    "--resp2", "--resp3", "-c",
]

BLOCK_CODE = "REDIS_DESTRUCTIVE"
WARN_CODE = "REDIS_CONFIG_CHANGE"

# Fixed values.
KV_RULES = [
    KvRule("FLUSHALL", "*", "Block", "FLUSHALL",
           "deletes ALL data across EVERY Redis database (modifier: <mod>)"),
    KvRule("FLUSHDB", "*", "Block", "FLUSHDB", "deletes ALL keys in the current Redis database"),
    KvRule("SHUTDOWN", "*", "Block", "SHUTDOWN",
           "stops the Redis server process (modifier: <mod>)"),
    KvRule("SLAVEOF", "*", "Block", "SLAVEOF", "changes Redis replication — target: <rest>"),
    KvRule("REPLICAOF", "*", "Block", "REPLICAOF", "changes Redis replication — target: <rest>"),
    KvRule("DEBUG", "SLEEP", "Block", "DEBUG SLEEP", "blocks the Redis event loop (DoS risk)"),
    KvRule("DEBUG", "SEGFAULT", "Block", "DEBUG SEGFAULT",
           "crashes the Redis server intentionally"),
    KvRule("DEBUG", "RELOAD", "Block", "DEBUG RELOAD",
           "force-reloads the dataset (data loss risk)"),
    KvRule("DEBUG", "FLUSHALL", "Block", "DEBUG FLUSHALL",
           "bypasses persistence and wipes all data"),
    KvRule("DEBUG", "CHANGE-REPL-ID", "Block", "DEBUG CHANGE-REPL-ID", "disrupts replication"),
    KvRule("DEBUG", "*", "Warn", "DEBUG <sub>",
           "can be destructive — verify this subcommand is intentional", "(no subcommand)"),
    KvRule("SCRIPT", "FLUSH", "Block", "SCRIPT FLUSH",
           "removes ALL cached Lua scripts from the server"),
    KvRule("CLUSTER", "RESET", "Block", "CLUSTER RESET",
           "resets node state and removes all cluster data"),
    KvRule("CLUSTER", "FAILOVER", "Block", "CLUSTER FAILOVER",
           "triggers a manual replication failover"),
    KvRule("CLUSTER", "FLUSHSLOTS", "Block", "CLUSTER FLUSHSLOTS",
           "removes all hash slot assignments from this node"),
    KvRule("CLUSTER", "*", "Warn", "CLUSTER <sub>", "modifies cluster topology — verify intent"),
    KvRule("ACL", "SETUSER", "Block", "ACL SETUSER", "modifies permissions for user <third>"),
    KvRule("ACL", "DELUSER", "Block", "ACL DELUSER", "removes user <third>"),
    KvRule("CONFIG", "SET", "Warn", "CONFIG SET", "modifies a live Redis parameter: <rest2>"),
    KvRule("CONFIG", "REWRITE", "Warn", "CONFIG REWRITE",
           "overwrites the redis.conf file on disk"),
    KvRule("CONFIG", "RESETSTAT", "Warn", "CONFIG RESETSTAT", "clears all server statistics"),
    KvRule("BGREWRITEAOF", "*", "Warn", "BGREWRITEAOF",
           "rewrites the AOF file — may cause brief I/O spike"),
    KvRule("MIGRATE", "*", "Warn", "MIGRATE",
           "transfers keys to <host>:<port> — verify the target is correct"),
]

# Commands that warn from this many keys on.
MASS_DELETE_COMMANDS = ["DEL", "UNLINK"]
MASS_DELETE_KEYS = 10
MASS_DELETE_DETAIL = "deleting <keys> keys at once — verify this is intentional"
