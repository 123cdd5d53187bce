"""Threat codes and message texts.

Fixed values.  A message is a head, one line per detail (``item`` before and after the detail), and
a tail.  Markers: ``<code>``, ``<tool>``, ``<subject>``, ``<n>`` number of details, ``<first>`` the
first detail, ``<list>`` all details joined by ", ".
"""

from __future__ import annotations

from typing import NamedTuple


class Message(NamedTuple):
    head: str
    item: str | None = None
    tail: str | None = None


# 23 codes.
MESSAGES = {
    "SECRET_LEAK": Message(
        "[<code>] <n> credential(s) detected in staged file(s) — commit blocked:",
        "  ", "  Remove or rotate the credentials before committing."),
    # One line of this message names the inspecting program; it is worded neutrally here.
    "GIT_COMMIT_INSPECT_FAILED": Message(
        "[<code>] cannot read staged changes from Git — commit blocked:\n<first>\n"
        "The inspector runs `git` with `-c safe.directory=*` under the commit's working directory.\n"
        "If this persists, fix repository permissions / ownership."),
    "SQL_DESTRUCTIVE": Message(
        "[<code>] <tool>: <n> irreversible operation(s) blocked:",
        "  • ", "  Use a targeted WHERE clause or coordinate with the DBA."),
    "SQL_PRIV_ESCALATION": Message(
        "[<code>] <tool>: <n> privilege-escalation statement(s) blocked:",
        "  • ", "  Permission changes must be reviewed by an administrator."),
    "SQL_FILESYSTEM": Message(
        "[<code>] <tool>: <n> filesystem-access statement(s) blocked:",
        "  • ", "  Filesystem access via the DB engine is not allowed."),
    "SQL_REMOTE_EXEC": Message(
        "[<code>] <tool>: <n> OS-command-execution statement(s) blocked:",
        "  • ", "  Running OS commands through the database engine is forbidden."),
    "SQL_INJECTION": Message(
        "[<code>] <tool>: <n> injection pattern(s) detected — blocked:",
        "  • ", "  Use parameterised queries instead of interpolated SQL."),
    "SQL_SUSPICIOUS": Message(
        "[<code>] <tool>: <n> suspicious pattern(s) — proceeding with warning:",
        "  ⚠ ", "  Review the query intent before continuing."),
    "DOCKER_UNSAFE_RUN": Message(
        "[<code>] docker run: <n> dangerous configuration issue(s) — blocked:",
        "  • ", "  Remove the unsafe flags or switch to a least-privilege configuration."),
    "DOCKER_VOLUME_DESTROY": Message(
        '[<code>] docker volume rm "<subject>": permanently destroys the named volume — blocked.'),
    "DOCKER_EXEC": Message(
        "[<code>] docker exec: executing a command inside a running container — "
        "verify this is intentional."),
    "DOCKER_PUSH": Message(
        '[<code>] docker push "<subject>": publishes the image to an external registry — '
        "verify the target."),
    "DOCKER_LOGIN": Message(
        "[<code>] docker login: credentials will be stored on disk — "
        "ensure this is an authorised registry."),
    "DOCKER_COMMIT": Message(
        "[<code>] docker commit: snapshot of a running container — "
        "may capture secrets from runtime state."),
    "DOCKER_CP": Message(
        "[<code>] docker cp: copies files between the host and a container filesystem."),
    "DOCKER_FORCE_REMOVE": Message(
        '[<code>] docker rm/rmi -f "<subject>": forcible removal without graceful shutdown.'),
    "REDIS_DESTRUCTIVE": Message("[<code>] redis-cli <subject>: <first> — blocked."),
    "REDIS_CONFIG_CHANGE": Message(
        "[<code>] redis-cli <subject>: <first> — proceeding with warning."),
    "KUBECTL_SQL_THREAT": Message(
        '[<code>] kubectl exec into pod "<subject>": SQL threat detected inside the exec command:'),
    "DATA_POLICY_BLOCK": Message(
        "[<code>] <tool>: access to protected table '<subject>' is blocked.", None,
        "  Use explicit non-sensitive columns or request access through a data steward."),
    "DATA_POLICY_MASKED": Message(
        "[<code>] <tool>: query against protected table '<subject>' — sensitive columns masked.",
        None, "  Masked columns: <list>"),
    "FS_POLICY_BLOCK": Message(
        "[<code>] <tool>: access to '<subject>' is blocked (matches protected pattern '<first>')."),
    "FS_POLICY_MASKED": Message(
        "[<code>] <tool>: content of '<subject>' was masked (matched protected pattern '<first>')."),
}

# Variants of the messages above.
EXEC_PRIVILEGED_HEAD = ("[<code>] docker exec --privileged: "
                        "elevates the session to full host capabilities — blocked.")
PROTECTED_COLUMNS_LINE = "  Protected columns: <list>"

# Fixed value: the cluster guard's text for SQL it cannot see.
UNSEEN_SQL = ("SQL tool '<tool>' launched without an explicit SQL argument (-c/-e/positional) "
              "— stdin SQL cannot be inspected and is always blocked")

# Report layout.
REPORT_TOP = "═" * 64
REPORT_BOTTOM = "─" * 64
REPORT_KIND = {"Block": "BLOCKED", "Warn": "WARNING"}
DETAIL_LINES = 3
DETAIL_BYTES = 52
