"""Command templates that events are turned into: hits and near misses for every rule.

``<user>``, ``<type>`` and ``<id>`` are filled from the event's row.
"""

from __future__ import annotations


def _psql(sql: str, *more: str) -> tuple[str, list[str]]:
    return "/usr/bin/psql", ["psql", *more, "-c", sql]


def _mysql(sql: str, *more: str) -> tuple[str, list[str]]:
    return "/usr/bin/mysql", ["mysql", *more, "-e", sql]


def _kv(*words: str) -> tuple[str, list[str]]:
    return "/usr/bin/redis-cli", ["redis-cli", *words]


def _box(*words: str) -> tuple[str, list[str]]:
    return "/usr/bin/docker", ["docker", *words]


def _run(*words: str) -> tuple[str, list[str]]:
    return _box("run", *words, "img:<user>")


def _pod(*words: str) -> tuple[str, list[str]]:
    return "/usr/local/bin/kubectl", ["kubectl", *words]


def _tool(name: str, *words: str) -> tuple[str, list[str]]:
    return f"/bin/{name}", [name, *words]


COMMANDS = [
    # commits
    _tool("git", "commit", "-m", "work <id>"),
    _tool("git", "commit", "--amend"),
    _tool("git", "commit", "--dry-run"),
    _tool("git", "status"),
    ("git", ["git", "-C", "/srv/<user>", "commit"]),
    ("/opt/not-git", ["not-git", "commit"]),
    # SQL: destructive
    _psql("DROP TABLE t<user>"),
    _psql("drop  database d<user>; SELECT 1"),
    _psql("DROP ROLE r<user>"),
    _psql("TRUNCATE events_<type>"),
    _psql("ALTER TABLE t<user> ADD a int, DROP COLUMN b"),
    _psql("ALTER TABLE t<user> ADD COLUMN c int"),
    _psql("DELETE FROM log"),
    _psql("DELETE FROM log WHERE id = <id>"),
    _mysql("UPDATE s.t SET a = <user>"),
    _mysql("UPDATE s.t SET a = <user> WHERE id = <id>"),
    _mysql("SELECT 1 /* DROP TABLE t */ -- DROP TABLE u"),
    # SQL: privileges
    _psql("GRANT SELECT ON t TO u<user>"),
    _psql("REVOKE ALL ON t FROM u<user>"),
    _psql("CREATE USER u<user>"),
    _mysql("SELECT granted FROM grants"),
    # SQL: file system
    _mysql("SELECT a INTO OUTFILE '/tmp/x' FROM t"),
    _mysql("LOAD DATA LOCAL INFILE 'x' INTO TABLE t"),
    _psql("COPY t TO '/tmp/<id>'"),
    _psql("COPY t FROM stdin"),
    _psql("SELECT pg_read_file('x<id>')"),
    _psql("SELECT pg_execute_server_program ('x')"),
    _psql("SELECT lo_import('x')"),
    # SQL: remote execution
    _mysql("EXEC xp_cmdshell('dir')"),
    _mysql("SELECT * FROM OPENROWSET('x'); DROP TABLE t; GRANT a TO b"),
    _mysql("sp_configure 'x'"),
    _mysql("EXEC sp_addlogin 'u<user>'"),
    # SQL: injection
    _psql("SELECT a FROM t UNION ALL SELECT b FROM u; DROP TABLE t<user>"),
    _psql("SELECT a FROM t UNION  SELECT b FROM u"),
    _mysql("EXECUTE ( @cmd )"),
    _mysql("SELECT 1; DROP TABLE x; SELECT 2"),
    # SQL: warnings
    _psql("SELECT table_name FROM information_schema.tables"),
    _psql("SELECT name FROM sys.objects"),
    _psql("SHOW TABLES; SHOW TABLES; SHOW GRANTS; SHOW TABLES"),
    _psql("\\dt"),
    _psql("\\dx"),
    _mysql("DESCRIBE t<user>"),
    _mysql("EXPLAIN SELECT a FROM t"),
    _psql("DROP INDEX i<id>"),
    _psql("INSERT INTO a SELECT b FROM c"),
    _psql("SELECT * FROM app_users"),
    _psql("SELECT * FROM plain"),
    _psql("SELECT pg_sleep(5)"),
    _mysql("WAITFOR DELAY '0:0:5'"),
    _psql("SELECT a FROM t WHERE b = 1 OR 1 = 1"),
    _psql("SELECT a FROM t WHERE b = 'x' or 'a' = 'a'"),
    _psql("SELECT 'x' /* open"),
    _psql("SELECT a, " + "b, " * 60 + "c FROM t; SHOW STATUS"),
    # SQL: where the text is
    ("/usr/bin/psql", ["psql", "--command=DROP TABLE x<user>"]),
    ("/usr/bin/psql", ["psql", "-c"]),
    ("/usr/bin/psql", ["psql", "-d", "db", "--command", "SHOW TABLES", "-c", "SELECT c_name FROM customer"]),
    ("/usr/bin/psql", ["psql", "-f", "/srv/sql/q<user>.sql"]),
    ("/usr/bin/psql", ["psql", "--file=/srv/sql/q<user>.sql"]),
    ("/usr/bin/psql", ["psql", "-f", "/srv/sql/q<user>.sql", "--command"]),
    ("/usr/bin/psql", ["psql", "-f", "/srv/sql/none<id>.sql"]),
    ("/usr/bin/psql", ["psql", "-l"]),
    ("/usr/bin/psql", ["psql", "-h", "db", "-U", "u<user>"]),
    ("/usr/bin/mysql", ["mysql", "--file", "/srv/sql/q<user>.sql"]),
    ("/usr/bin/mysql", ["mysql", "--print-defaults", "-e", "DROP TABLE x"]),
    ("/usr/bin/mariadb", ["mariadb", "--execute=TRUNCATE TABLE t"]),
    ("/usr/bin/mariadb", ["mariadb", "--print-defaults", "-e", "DROP TABLE x"]),
    ("sqlite3", ["sqlite3", "app.db", "DROP TABLE t<user>"]),
    ("sqlite3", ["sqlite3", "-header", "app.db", "SELECT c_name, c_acctbal FROM customer"]),
    ("sqlite3", ["sqlite3", "app.db"]),
    # table policy
    _psql("SELECT c_name, c_acctbal FROM customer WHERE c_custkey = <user>"),
    _mysql("SELECT c_name AS n, c_nationkey FROM Customer c"),
    _psql("select c_name\nFROM customer"),
    _psql("SELECT c_name\tFROM customer"),
    _psql("SELECT * FROM customer"),
    _psql("SELECT s_acctbal FROM supplier JOIN customer ON true"),
    _psql("SELECT o_totalprice, o_orderpriority, o_custkey FROM orders WHERE o_orderkey = <id>"),
    _mysql("SELECT o_totalprice FROM lineitem JOIN orders USING (o_orderkey)"),
    _psql("UPDATE supplier SET s_acctbal = 0 WHERE s_suppkey = <user>"),
    _psql("INSERT INTO supplier VALUES (<user>)"),
    _psql("SELECT x FROM public.customer"),
    _psql("SELECT n_name FROM nation"),
    _psql("SELECT c_name FROM customer; DROP TABLE customer"),
    _psql("SELECT c_name, xc_name FROM customer, supplier"),
    # key-value
    _kv("FLUSHALL"), _kv("flushall", "async"), _kv("-n", "3", "FLUSHDB"), _kv("SHUTDOWN", "NOSAVE"),
    _kv("SLAVEOF", "host<user>", "6379"), _kv("REPLICAOF", "NO", "ONE"),
    _kv("DEBUG", "SLEEP", "5"), _kv("DEBUG", "SEGFAULT"), _kv("DEBUG", "RELOAD"),
    _kv("DEBUG", "FLUSHALL"), _kv("DEBUG", "CHANGE-REPL-ID"), _kv("DEBUG", "OBJECT", "k<id>"),
    _kv("DEBUG"), _kv("SCRIPT", "FLUSH"), _kv("SCRIPT", "LOAD", "x"),
    _kv("CLUSTER", "RESET"), _kv("CLUSTER", "FAILOVER"), _kv("CLUSTER", "FLUSHSLOTS"),
    _kv("CLUSTER", "INFO"), _kv("CLUSTER"), _kv("ACL", "SETUSER", "u<user>"), _kv("ACL", "DELUSER"),
    _kv("ACL", "LIST"), _kv("CONFIG", "SET", "maxmemory", "<id>"), _kv("CONFIG", "REWRITE"),
    _kv("CONFIG", "RESETSTAT"), _kv("CONFIG", "GET", "x"), _kv("BGREWRITEAOF"),
    _kv("MIGRATE", "h<user>", "6379"), _kv("MIGRATE"),
    _kv("DEL", *[f"k{i}" for i in range(9)]), _kv("DEL", *[f"k{i}" for i in range(10)]),
    _kv("unlink", *[f"k<id>-{i}" for i in range(12)]), _kv("GET", "k<id>"),
    _kv("-h", "-h", "-p", "6379", "--raw", "FLUSHALL"), _kv("-a", "FLUSHALL", "PING"), _kv(),
    _kv("--help"),
    # containers: run and create
    _run("--privileged"), _run("--privileged=false"), _run("--cap-add", "sys_admin"),
    _run("--cap-add=NET_ADMIN", "--cap-add", "CHOWN"), _run("--cap-add", "--cap-add", "--cap-add=ALL"),
    _run("--pid=host"), _run("--pid", "host"), _run("--pid", "container:x"), _run("--ipc", "host"),
    _run("--security-opt", "seccomp=unconfined"), _run("--security-opt=apparmor=unconfined"),
    _run("--security-opt", "no-new-privileges"), _run("--device", "/dev/sda:/dev/xvda"),
    _run("--device=/dev/nvme0n1"), _run("--device", "/dev/kmem"), _run("--device", "/dev/snd"),
    _run("-v", "/var/run/docker.sock:/var/run/docker.sock"), _run("-v", "/etc:/etc"),
    _run("-v/etc/ssl:/ssl:ro"), _run("--volume=/proc/1:/p", "-v", "data<user>:/data"),
    _run("-v", "/:/host"), _run("-v", "/etcetera:/x"), _run("-p", "5432:5432"),
    _run("-p127.0.0.1:5432:5432"), _run("-p", "0.0.0.0:6379:6379/tcp"), _run("--publish=:3306:3306"),
    _run("-p", "27017-27019:27017-27019"), _run("-p", "8080:80", "-p", "09200:9200"), _run("-p", "5432"),
    _run("--network", "host"), _run("--net=host", "--rm"), _run("--network", "bridge"),
    _run("--net", "host", "--privileged", "-p", "1521:1521", "-v", "/boot/x:/y", "--ipc=host"),
    _box("create", "--privileged", "img"), _run("--rm", "-it"), _run("-h", "name", "--privileged"),
    # containers: other operations
    _box("exec", "c<user>", "sh"), _box("exec", "--privileged", "c<user>", "sh"),
    _box("rm", "-f", "c<user>"), _box("rm", "c<user>"), _box("rmi", "--force", "i<user>"),
    _box("container", "rm", "-f", "c"), _box("container", "ls", "-f", "x"),
    _box("image", "prune", "--force"), _box("image", "remove", "i"), _box("system", "prune"),
    _box("system", "prune", "-a"), _box("system", "prune", "--volumes"),
    _box("system", "prune", "--all", "--volumes"), _box("system", "df"),
    _box("volume", "rm", "v<user>"), _box("volume", "remove"), _box("volume", "ls"),
    _box("swarm", "init"), _box("swarm", "join", "--token", "x"), _box("swarm", "leave"),
    _box("swarm", "leave", "--force"), _box("push", "reg/i<user>"), _box("push"), _box("login"),
    _box("commit", "c", "i"), _box("cp", "c:/x", "."), _box("ps"), _box(),
    # cluster
    _pod("exec", "pod-<user>", "--", "psql", "-c", "DROP TABLE t"),
    _pod("exec", "-it", "pod-<user>", "--", "/usr/bin/psql", "-c", "SHOW TABLES"),
    _pod("exec", "pod-<user>", "--", "mariadb", "-e", "SELECT 1"),
    _pod("exec", "pod-<user>", "--", "mysql"),
    _pod("-n", "ns", "exec", "exec", "pod-<user>", "--", "psql", "-f", "/srv/sql/q<user>.sql"),
    _pod("exec", "pod-<user>", "--", "psql", "-f", "/srv/sql/none.sql"),
    _pod("exec", "pod-<user>", "--", "sqlite3", "a.db", "DELETE FROM x"),
    _pod("exec", "--", "psql", "-c", "SELECT 1; EXEC(@a)"),
    _pod("exec", "pod-<user>", "--", "bash"), _pod("exec", "pod-<user>", "psql", "-c", "DROP TABLE t"),
    _pod("exec", "pod-<user>", "--"), _pod("get", "pods"),
    # paths
    _tool("cat", "/opt/vault/master.key"), _tool("cat", "-n", "notes.txt", "/opt/vault/unseal/x", "credentials.ini"),
    _tool("cat", "~/keys/backup.gpg"), _tool("cat", "/home/u/keys/<user>.pem"), _tool("cat", "/home/u/keys/a/x.pem"),
    _tool("head", "-5", "~/.netrc"), _tool("tail", "-f", "/srv/export/july.csv"),
    _tool("diff", "a.txt", "~/keys/site.pem"), _tool("grep", "/opt/vault/master.key", "notes.txt"),
    _tool("grep", "-r", "key", "credentials.ini"), _tool("egrep", "x", "conf/wallet.dat", "/opt/vault/master.key"),
    _tool("fgrep", "x", "/opt/vault/master.key"), _tool("find", "/opt/vault/unseal", "-name", "x"),
    _tool("find", "~/.local/tokens/a", "/opt/vault/master.key"), _tool("cp", "~/.local/tokens/deep/b", "/tmp"),
    _tool("mv", "notes.txt", "/opt/vault/master.key"), _tool("cat", "--help"), _tool("cat"),
    _tool("cat", "/srv/<type>/deep/credentials.ini"), _tool("cat", "~"), _tool("cat", "/var/lib/billing/run1.csv"),
    _tool("cat", "/var/lib/billing/run12.csv"), _tool("cat", "/opt/vault/unseal"),
    # the token that matters stands behind a thousand others
    ("/usr/local/bin/kubectl", ["kubectl", *["-v=1"] * 1200, "exec", "pod-<id>", "--", "psql", "-c", "DROP TABLE t"]),
    # others
    _tool("npm", "install"), _tool("curl", "https://x/<id>"), _tool("ls", "-l"),
    ("/usr/bin/psql", []), ("/usr/bin/redis-cli", ["redis-cli", "", "PING", ""]),
]
