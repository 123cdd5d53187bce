"""Watch list, action registry and agent-process words.

Fixed values throughout: names, tokens and order decide which commands are audited and how.
"""

from __future__ import annotations

from typing import NamedTuple

# Executables worth looking at.
WATCHED = [
    "git",
    "psql", "mysql", "mariadb", "sqlite3",
    "redis-cli",
    "npm", "pip", "pip3",
    "curl", "wget", "docker", "kubectl",
    "cat", "head", "tail", "grep", "egrep", "fgrep",
    "diff", "find", "cp", "mv",
]

# The process name that marks an agent root, and the two words of the strict test.
AGENT_NAME = "claude"
STRICT_WORDS = ("claude", "anthropic")

# Fixed value: a pid is followed through at most this many processes, itself included.
MAX_LINEAGE_NODES = 32

# Fixed value: seconds after which a root set is out of date.
ROOT_REFRESH_SECONDS = 5


class Action(NamedTuple):
    ord: int
    action: str
    command: str
    required: list[str]
    excluded: list[str]
    guard: str


# Fixed values, in order; the first matching action wins.
ACTIONS = [
    Action(1, "git-commit", "git", ["commit"], ["--dry-run"], "commit"),
    Action(2, "psql", "psql", [], ["--help", "-?", "--version", "-V", "-l", "--list"], "sql"),
    Action(3, "mysql", "mysql", [], ["--help", "--version", "--print-defaults"], "sql"),
    Action(4, "mariadb", "mariadb", [], ["--help", "--version"], "sql"),
    Action(5, "sqlite3", "sqlite3", [], ["--help", "--version"], "sql"),
    Action(6, "redis-cli", "redis-cli", [], ["--help", "--version"], "kv"),
    Action(7, "kubectl-exec-sql", "kubectl", ["exec"], ["--help", "--version"], "cluster"),
    Action(8, "docker", "docker", [], ["--help", "-h", "--version"], "container"),
    Action(9, "cat", "cat", [], ["--help", "--version"], "path"),
    Action(10, "head", "head", [], ["--help", "--version"], "path"),
    Action(11, "tail", "tail", [], ["--help", "--version"], "path"),
    Action(12, "diff", "diff", [], ["--help", "--version"], "path"),
    Action(13, "grep", "grep", [], ["--help", "--version"], "path"),
    Action(14, "egrep", "egrep", [], ["--help", "--version"], "path"),
    Action(15, "find", "find", [], ["--help", "--version"], "path"),
    Action(16, "cp", "cp", [], ["--help", "--version"], "path"),
    Action(17, "mv", "mv", [], ["--help", "--version"], "path"),
]

# Which positional arguments of a path command are paths.
# all = every one, rest = all but the first, first = the first only.
PATH_STRATEGY = {
    "cat": "all", "head": "all", "tail": "all", "diff": "all",
    "grep": "rest", "egrep": "rest",
    "find": "first", "cp": "first", "mv": "first",
}
