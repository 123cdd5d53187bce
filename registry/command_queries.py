"""Command lines: arguments, actions, containers, key-value and path commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import flat_verdicts, joined, number, query
from registry.fixtures import CTES, HOME, command_log, context, policy, values
from veilwatch.functions.argv import (after_separator, collect_specs, extract_sql, flag_values,
                                      has_flag, kv_positional, pod_name, positional)
from veilwatch.plans.actions import (RULE_SCHEMA, action_matches, action_rules, match_action,
                                     match_action_table)
from veilwatch.plans.containers import (container_issues, dangerous_mount, exposed_port,
                                        published_specs, volume_specs)
from veilwatch.plans.dispatch import audit
from veilwatch.plans.path_policy import candidate_paths, first_path_hit
from veilwatch.rules import container_rules as C
from veilwatch.rules import kv_rules as K
from veilwatch.rules.registry import ACTIONS, PATH_STRATEGY
from veilwatch.rules.sql_rules import SQL_TOOLS
from veilwatch.functions.text import basename

VERDICT = ("event_id, action, verdict, CAST(masked AS BIGINT) AS masked, code, tool, subject, "
           "details, inner_code")

_TOOL_FLAGS = [(t, kind, i, flag) for t, s in SQL_TOOLS.items()
               for kind, flags in (("sql", s.sql_flags), ("file", s.file_flags))
               for i, flag in enumerate(flags, start=1)]

# Flag groups whose values are wanted; each row is one flag of a group.
_GROUPS = [("cap", "--cap-add"), ("pid", "--pid"), ("ipc", "--ipc"), ("sec", "--security-opt"),
           ("dev", "--device"), ("network", "--network"), ("net", "--net"),
           ("vol", "-v"), ("vol", "--volume"), ("pub", "-p"), ("pub", "--publish")]

CTES.update({
    "x_rules": values("ord, action, command, required, excluded, guard", ACTIONS),
    "x_matched": """SELECT * FROM (SELECT l.*, r.ord, r.action, r.command AS tool, r.guard,
          row_number() OVER (PARTITION BY event_id ORDER BY r.ord) AS rn
        FROM x_log l JOIN x_rules r ON l.base = r.command AND list_has_all(l.argv, r.required)
          AND NOT list_has_any(l.argv, r.excluded)) WHERE rn = 1""",
    "x_pos": """SELECT event_id, list_filter(argv[2:], lambda x: NOT starts_with(x, '-')) AS p FROM x_log""",
    "x_tok": "SELECT event_id, unnest(argv) AS tok, generate_subscripts(argv, 1) AS i FROM x_log",

    # tokens that take the next token: every other one in a run of equal kind
    "x_kvtok": f"""SELECT event_id, i, tok, list_contains({K.VALUE_FLAGS!r}, tok) AS f FROM x_tok WHERE i > 1""",
    "x_kvrun": """SELECT *, i - row_number() OVER (PARTITION BY event_id, f ORDER BY i) AS grp FROM x_kvtok""",
    "x_kvtake": """SELECT *, f AND row_number() OVER (PARTITION BY event_id, f, grp ORDER BY i) % 2 = 1 AS takes
        FROM x_kvrun""",
    "x_kvpos": """SELECT event_id, list(upper(tok) ORDER BY i) AS p FROM (
        SELECT *, coalesce(lag(takes) OVER (PARTITION BY event_id ORDER BY i), FALSE) AS taken FROM x_kvtake)
        WHERE NOT taken AND NOT starts_with(tok, '-') GROUP BY event_id""",

    "x_groups": values("grp, flag", _GROUPS),
    "x_ftok": """SELECT t.event_id, g.grp, t.i, t.tok, bool_or(t.tok = g.flag) AS f,
          min(CASE WHEN starts_with(t.tok, g.flag || '=') THEN substr(t.tok, length(g.flag) + 2)
               WHEN length(g.flag) = 2 AND starts_with(t.tok, g.flag) AND t.tok <> g.flag
               THEN substr(t.tok, 3) END) AS own
        FROM x_tok t JOIN x_log l ON t.event_id = l.event_id AND l.base = 'docker' CROSS JOIN x_groups g
        GROUP BY t.event_id, g.grp, t.i, t.tok""",
    "x_frun": """SELECT *, i - row_number() OVER (PARTITION BY event_id, grp, f ORDER BY i) AS run FROM x_ftok""",
    "x_ftake": """SELECT *, f AND row_number() OVER (PARTITION BY event_id, grp, f, run ORDER BY i) % 2 = 1 AS takes
        FROM x_frun""",
    "x_fval": """SELECT event_id, grp, i, CASE WHEN taken THEN tok ELSE own END AS v FROM (
        SELECT *, coalesce(lag(takes) OVER (PARTITION BY event_id, grp ORDER BY i), FALSE) AS taken FROM x_ftake)
        WHERE taken OR (NOT f AND own IS NOT NULL)""",

    "x_toolflags": values("tool, kind, ford, flag", _TOOL_FLAGS),
    "x_sqltok": """SELECT l.event_id, l.base AS tool, l.argv, t.i, t.tok FROM x_log l JOIN x_tok t USING (event_id)
        WHERE l.base IN ('psql', 'mysql', 'mariadb', 'sqlite3')""",
    "x_flaghit": """SELECT s.*, f.kind, f.ford, f.flag, s.tok = f.flag AS bare,
          CASE WHEN s.tok = f.flag THEN s.argv[s.i + 1] ELSE substr(s.tok, length(f.flag) + 2) END AS v
        FROM x_sqltok s JOIN x_toolflags f ON s.tool = f.tool AND (s.tok = f.flag OR starts_with(s.tok, f.flag || '='))""",
    "x_lastpos": """SELECT l.event_id, CASE WHEN l.base = 'sqlite3' AND len(p) >= 2 THEN p[-1] END AS v
        FROM x_log l JOIN x_pos USING (event_id)""",
    "x_audit1": """SELECT event_id, kind, v FROM (SELECT *, row_number() OVER (PARTITION BY event_id, kind ORDER BY i) AS rn
        FROM x_flaghit) WHERE rn = 1""",
    "x_auditsrc": """SELECT l.event_id, CASE WHEN a.v IS NOT NULL THEN 'inline' WHEN b.v IS NOT NULL THEN 'file'
          WHEN p.v IS NOT NULL THEN 'inline' END AS kind, coalesce(a.v, b.v, p.v) AS v
        FROM x_log l LEFT JOIN x_audit1 a ON a.event_id = l.event_id AND a.kind = 'sql'
        LEFT JOIN x_audit1 b ON b.event_id = l.event_id AND b.kind = 'file'
        LEFT JOIN x_lastpos p ON p.event_id = l.event_id
        WHERE l.base IN ('psql', 'mysql', 'mariadb', 'sqlite3')""",
    "x_policy1": """SELECT event_id, kind, v FROM (SELECT *, row_number() OVER (PARTITION BY event_id, kind ORDER BY ford, i) AS rn
        FROM x_flaghit WHERE kind = 'sql' OR (bare AND i < len(argv))) WHERE rn = 1""",
    "x_policysrc": """SELECT l.event_id, CASE WHEN a.event_id IS NOT NULL THEN CASE WHEN a.v IS NOT NULL THEN 'inline' END
          WHEN b.v IS NOT NULL THEN 'file' WHEN p.v IS NOT NULL THEN 'inline' END AS kind,
          CASE WHEN a.event_id IS NOT NULL THEN a.v ELSE coalesce(b.v, p.v) END AS v
        FROM x_log l LEFT JOIN x_policy1 a ON a.event_id = l.event_id AND a.kind = 'sql'
        LEFT JOIN x_policy1 b ON b.event_id = l.event_id AND b.kind = 'file'
        LEFT JOIN x_lastpos p ON p.event_id = l.event_id
        WHERE l.base IN ('psql', 'mysql', 'mariadb', 'sqlite3')""",
})


# --- F5, F6: arguments ----------------------------------------------------------------------------

@query("f4_action_matches", """
SELECT event_id, coalesce(string_agg(action, ',' ORDER BY ord), '') AS actions
FROM (SELECT l.event_id, r.action, r.ord FROM x_log l LEFT JOIN x_rules r
      ON l.base = r.command AND list_has_all(l.argv, r.required) AND NOT list_has_any(l.argv, r.excluded))
GROUP BY event_id""")
def matching_actions(spark, sf):
    base, argv = basename(F.col("filename")), F.col("argv")
    names = F.array(*[F.when(action_matches(base, argv, r), F.lit(r.action)) for r in ACTIONS])
    return command_log(spark, sf).select(
        "event_id", F.array_join(F.filter(names, lambda x: x.isNotNull()), ",").alias("actions"))


@query("f5_positional", "SELECT event_id, p[1] AS first, p[2] AS second, p[3] AS third FROM x_pos")
def positional_args(spark, sf):
    argv = "argv"
    return command_log(spark, sf).select(
        "event_id", positional(argv, 1).alias("first"), positional(argv, 2).alias("second"),
        positional(argv, 3).alias("third"))


@query("f5b_kv_positional", """SELECT event_id, coalesce(array_to_string(p, ' | '), '') AS args
       FROM x_log LEFT JOIN x_kvpos USING (event_id) WHERE base = 'redis-cli'""")
def kv_args(spark, sf):
    df = command_log(spark, sf).filter(basename(F.col("filename")) == "redis-cli")
    return df.select("event_id", joined(kv_positional("argv")).alias("args"))


CTES["x_pod"] = """SELECT l.event_id, coalesce((list_filter(argv[2:][list_position(argv[2:], 'exec') + 1:],
        lambda x: NOT starts_with(x, '-') AND x <> 'exec'))[1], '<unknown-pod>') AS pod
        FROM x_log l WHERE base = 'kubectl' AND list_contains(argv[2:], 'exec')"""


@query("f5c_pod_name", "SELECT event_id, pod FROM x_pod")
def pods(spark, sf):
    df = command_log(spark, sf).filter(
        (basename(F.col("filename")) == "kubectl")
        & F.expr("array_contains(slice(argv, 2, size(argv)), 'exec')"))
    return df.select("event_id", pod_name("argv").alias("pod"))


@query("f5d_after_separator", """SELECT event_id, array_to_string(argv[list_position(argv, '--') + 1:], ' | ') AS inner_argv
       FROM x_log WHERE list_contains(argv, '--')""")
def separated(spark, sf):
    df = command_log(spark, sf).withColumn("sub", after_separator("argv"))
    return df.filter(F.col("sub").isNotNull()).select("event_id", joined("sub").alias("inner_argv"))


@query("f6_has_flag", """
SELECT event_id, CAST(bool_or(tok = '--privileged' OR starts_with(tok, '--privileged=')) AS BIGINT) AS privileged,
       CAST(bool_or(tok = '-f' OR starts_with(tok, '-f=')) AS BIGINT) AS f FROM x_tok GROUP BY event_id""")
def flags(spark, sf):
    argv = "argv"
    return command_log(spark, sf).select(
        "event_id", number(has_flag(argv, "--privileged")).alias("privileged"),
        number(has_flag(argv, "-f")).alias("f"))


def _group_sql(*groups: str) -> str:
    cols = ", ".join(f"coalesce(string_agg(v, ' | ' ORDER BY i) FILTER (grp = '{g}'), '') AS {g}" for g in groups)
    return (f"SELECT l.event_id, {cols} FROM x_log l LEFT JOIN x_fval v ON l.event_id = v.event_id "
            "WHERE l.base = 'docker' GROUP BY l.event_id")


def _containers(spark, sf):
    return command_log(spark, sf).filter(basename(F.col("filename")) == "docker")


@query("f6b_flag_values", _group_sql("cap", "pid", "sec", "dev", "net"))
def values_of_flags(spark, sf):
    argv = "argv"
    return _containers(spark, sf).select(
        "event_id", *[joined(flag_values(argv, flag)).alias(name) for name, flag in
                      (("cap", "--cap-add"), ("pid", "--pid"), ("sec", "--security-opt"),
                       ("dev", "--device"), ("net", "--net"))])


@query("f6c_collect_specs", _group_sql("vol", "pub"))
def specs(spark, sf):
    argv = "argv"
    return _containers(spark, sf).select(
        "event_id", joined(collect_specs(argv, ["-v", "--volume"])).alias("vol"),
        joined(collect_specs(argv, ["-p", "--publish"])).alias("pub"))


def _sources(spark, sf, order):
    base = basename(F.col("filename"))
    df = command_log(spark, sf).filter(base.isin(list(SQL_TOOLS)))
    return df.withColumn("tool", base).withColumn("s", extract_sql("argv", "tool", order)).select(
        "event_id", "s.kind", "s.value")


@query("f6d_extract_sql", "SELECT event_id, kind, v AS value FROM x_auditsrc")
def audit_sources(spark, sf):
    return _sources(spark, sf, "audit")


@query("f6e_extract_sql_policy", "SELECT event_id, kind, v AS value FROM x_policysrc")
def policy_sources(spark, sf):
    return _sources(spark, sf, "policy")


# --- J1: actions ----------------------------------------------------------------------------------

@query("j1_match_action", "SELECT event_id, action, tool, guard FROM x_matched")
def actions(spark, sf):
    return match_action(command_log(spark, sf)).select("event_id", "action", "tool", "guard")


@query("j1_rule_table", "SELECT event_id, action, tool, guard FROM x_matched")
def rule_table(spark, sf):
    """The same rules as a table, every host a tenant with all of them."""
    rules = action_rules(spark, "all").withColumn("tenant", F.explode(F.array(*[F.lit(f"h{k}") for k in range(4)])))
    return match_action_table(command_log(spark, sf), rules).select("event_id", "action", "tool", "guard")


def _host_rules(spark):
    """A registry per host: some rules missing, every other one in reverse order, one more with two tokens."""
    rows = []
    for k in range(4):
        rows += [(f"h{k}", 100 - r.ord if k % 2 else r.ord, *r[1:]) for r in ACTIONS if (r.ord + k) % 4]
        rows.append((f"h{k}", k, "docker-unsafe", "docker", ["run", "--privileged"], [], "container"))
        rows.append((f"h{k}", 50, "any-git", "git", [], ["status"], "commit"))
    return spark.createDataFrame(rows, RULE_SCHEMA)


CTES["x_hostrules"] = """
SELECT 'h' || k AS host, CASE WHEN k % 2 = 1 THEN 100 - ord ELSE ord END AS ord, action, command, required, excluded
FROM x_rules, (SELECT unnest(range(0, 4)) AS k) WHERE (ord + k) % 4 <> 0
UNION ALL SELECT 'h' || k, k, 'docker-unsafe', 'docker', ['run', '--privileged'], CAST([] AS VARCHAR[]) FROM (SELECT unnest(range(0, 4)) AS k)
UNION ALL SELECT 'h' || k, 50, 'any-git', 'git', CAST([] AS VARCHAR[]), ['status'] FROM (SELECT unnest(range(0, 4)) AS k)"""


@query("j1_rules_per_host", """SELECT event_id, action, tool FROM (SELECT l.event_id, r.action, r.command AS tool,
         row_number() OVER (PARTITION BY event_id ORDER BY r.ord, r.action) AS rn
       FROM x_log l JOIN x_hostrules r ON r.host = l.host AND l.base = r.command AND list_has_all(l.argv, r.required)
         AND NOT list_has_any(l.argv, r.excluded)) WHERE rn = 1""")
def rules_per_host(spark, sf):
    return match_action_table(command_log(spark, sf), _host_rules(spark)).select("event_id", "action", "tool")


# --- J7, J8, A6, G6: containers -------------------------------------------------------------------

_ISSUE = {k: v.replace("'", "''") for k, v in C.ISSUE.items()}
_PORT_TEXT = "replace(replace('" + _ISSUE["port"] + "', '<p>', port), '<s>', service)"
CTES.update({
    "x_ports": values("number, service", C.SERVICE_PORTS),
    "x_prefixes": values("ord, prefix, label", [(i, p, s) for i, (p, s) in enumerate(C.DANGEROUS_PREFIXES)]),
    "x_caps": values("cap", [(c,) for c in C.DANGEROUS_CAPABILITIES]),
    "x_pubparts": """SELECT event_id, i, v, string_split(string_split(v, '/')[1], ':') AS parts FROM x_fval WHERE grp = 'pub'""",
    "x_pubport": """SELECT event_id, i, v,
          CASE WHEN len(parts) = 2 THEN '0.0.0.0' WHEN len(parts) >= 3 THEN parts[1] END AS address,
          TRY_CAST(string_split(CASE WHEN len(parts) = 2 THEN parts[1] WHEN len(parts) >= 3 THEN parts[2] END, '-')[1]
                   AS BIGINT) AS number FROM x_pubparts""",
    "x_exposed": """SELECT event_id, i, v, CAST(number AS VARCHAR) AS port, service FROM x_pubport
        JOIN x_ports USING (number) WHERE address IN ('', '0.0.0.0')""",
    "x_mounts": """SELECT event_id, i, v, host, arg_min(label, ord) AS label FROM (
          SELECT event_id, i, v, string_split(v, ':')[1] AS host FROM x_fval WHERE grp = 'vol') m
        JOIN x_prefixes p ON (m.host = rtrim(p.prefix, '/') OR starts_with(m.host, p.prefix)) AND starts_with(m.host, '/')
        GROUP BY ALL""",
    "x_issues": f"""
        SELECT event_id, 1 AS step, 0 AS i, '{_ISSUE['privileged']}' AS issue FROM x_tok
          GROUP BY event_id HAVING bool_or(tok = '--privileged' OR starts_with(tok, '--privileged='))
        UNION ALL SELECT event_id, 2, i, '--cap-add=' || v || ': grants dangerous Linux capability'
          FROM x_fval JOIN x_caps ON upper(v) = cap WHERE grp = 'cap'
        UNION ALL SELECT event_id, 3, 0, '{_ISSUE['pid']}' FROM x_fval WHERE grp = 'pid' AND v = 'host' GROUP BY event_id
        UNION ALL SELECT event_id, 4, 0, '{_ISSUE['ipc']}' FROM x_fval WHERE grp = 'ipc' AND v = 'host' GROUP BY event_id
        UNION ALL SELECT event_id, 5, i, '--security-opt=' || v || CASE WHEN contains(v, 'seccomp=unconfined')
            THEN ': disables seccomp syscall filter' ELSE ': disables AppArmor MAC profile' END
          FROM x_fval WHERE grp = 'sec' AND (contains(v, 'seccomp=unconfined') OR contains(v, 'apparmor=unconfined'))
        UNION ALL SELECT event_id, 6, i, '--device=' || v || ': mounts a raw storage/memory device into the container'
          FROM x_fval WHERE grp = 'dev' AND (regexp_matches(string_split(v, ':')[1], '^/dev/(sd|nvme|vd)')
            OR string_split(v, ':')[1] IN ('/dev/mem', '/dev/kmem'))
        UNION ALL SELECT event_id, 7, 0, '{_ISSUE['socket']}' FROM x_tok WHERE contains(tok, 'docker.sock') GROUP BY event_id
        UNION ALL SELECT event_id, 8, i, 'dangerous host path ''' || host || ''' (' || label || ') mounted into container'
          FROM x_mounts
        UNION ALL SELECT event_id, 9, i, {_PORT_TEXT} FROM x_exposed""",
    "x_runs": """SELECT m.*, p[1] AS sub, p[2] AS second, p[3] AS third FROM x_matched m JOIN x_pos USING (event_id)
        WHERE guard = 'container'""",
    "x_runissues": """SELECT event_id, string_agg(issue, ' | ' ORDER BY step, i) AS issues FROM x_issues
        JOIN x_runs USING (event_id) WHERE sub IN ('run', 'create') GROUP BY event_id""",
    "x_hostnet": """SELECT DISTINCT event_id FROM x_fval WHERE grp IN ('network', 'net') AND v = 'host'""",
    "x_cflags": """SELECT event_id, bool_or(regexp_matches(tok, '^(-f|--force)(=|$)')) AS force,
          bool_or(regexp_matches(tok, '^(-a|--all)(=|$)')) AS every, bool_or(regexp_matches(tok, '^--volumes(=|$)')) AS vols,
          bool_or(regexp_matches(tok, '^--privileged(=|$)')) AS priv FROM x_tok GROUP BY event_id""",
    "x_cops": values("sub, second, force, verdict, code, subject, details", [
        ("rm", None, True, "Warn", "DOCKER_FORCE_REMOVE", "container", ""),
        ("rmi", None, True, "Warn", "DOCKER_FORCE_REMOVE", "image", ""),
        ("container", "rm", True, "Warn", "DOCKER_FORCE_REMOVE", "container", ""),
        ("container", "remove", True, "Warn", "DOCKER_FORCE_REMOVE", "container", ""),
        ("image", "rm", True, "Warn", "DOCKER_FORCE_REMOVE", "image", ""),
        ("image", "remove", True, "Warn", "DOCKER_FORCE_REMOVE", "image", ""),
        ("image", "prune", True, "Warn", "DOCKER_FORCE_REMOVE", "image", ""),
        ("swarm", "init", None, "Block", "DOCKER_UNSAFE_RUN", None, C.OPERATION["swarm_init"]),
        ("swarm", "join", None, "Block", "DOCKER_UNSAFE_RUN", None, C.OPERATION["swarm_join"]),
        ("swarm", "leave", True, "Block", "DOCKER_UNSAFE_RUN", None, C.OPERATION["swarm_leave_force"]),
        ("swarm", "leave", False, "Warn", "DOCKER_UNSAFE_RUN", None, C.OPERATION["swarm_leave"]),
        ("push", None, None, "Warn", "DOCKER_PUSH", "<second>", ""),
        ("volume", "rm", None, "Block", "DOCKER_VOLUME_DESTROY", "<third>", ""),
        ("volume", "remove", None, "Block", "DOCKER_VOLUME_DESTROY", "<third>", ""),
        ("login", None, None, "Warn", "DOCKER_LOGIN", None, ""),
        ("commit", None, None, "Warn", "DOCKER_COMMIT", None, ""),
        ("cp", None, None, "Warn", "DOCKER_CP", None, "")]),
    "x_cprune": f"""SELECT r.event_id, CASE WHEN every OR vols THEN 'Block' ELSE 'Warn' END AS verdict,
          'DOCKER_UNSAFE_RUN' AS code, CAST(NULL AS VARCHAR) AS subject,
          CASE WHEN every AND vols THEN '{C.OPERATION['prune_all_volumes']}' WHEN every THEN '{C.OPERATION['prune_all']}'
               WHEN vols THEN '{C.OPERATION['prune_volumes']}' ELSE '{C.OPERATION['prune']}' END AS details
        FROM x_runs r JOIN x_cflags f USING (event_id) WHERE sub = 'system' AND second = 'prune'""",
    "x_coutcome": f"""
        SELECT r.event_id, CASE WHEN issues IS NOT NULL THEN 'Block' WHEN n.event_id IS NOT NULL THEN 'Warn' END AS verdict,
          'DOCKER_UNSAFE_RUN' AS code, CAST(NULL AS VARCHAR) AS subject, coalesce(issues, '{_ISSUE['network']}') AS details
        FROM x_runs r LEFT JOIN x_runissues USING (event_id) LEFT JOIN x_hostnet n ON n.event_id = r.event_id
        WHERE sub IN ('run', 'create') AND (issues IS NOT NULL OR n.event_id IS NOT NULL)
        UNION ALL SELECT r.event_id, CASE WHEN priv THEN 'Block' ELSE 'Warn' END, 'DOCKER_EXEC', NULL,
          CASE WHEN priv THEN 'privileged' ELSE '' END FROM x_runs r JOIN x_cflags USING (event_id) WHERE sub = 'exec'
        UNION ALL SELECT * FROM x_cprune
        UNION ALL SELECT r.event_id, o.verdict, o.code, CASE o.subject WHEN '<second>' THEN coalesce(r.second, '<unknown>')
            WHEN '<third>' THEN coalesce(r.third, '<unknown>') ELSE o.subject END, o.details
          FROM x_runs r JOIN x_cflags f USING (event_id) JOIN x_cops o ON r.sub = o.sub
            AND (o.second IS NULL OR r.second = o.second) AND (o.force IS NULL OR f.force = o.force)""",
    "x_container": """SELECT r.event_id, r.action, coalesce(o.verdict, 'Allow') AS verdict, FALSE AS masked, o.code,
          CASE WHEN o.code IS NOT NULL THEN 'docker' END AS tool, o.subject, o.details, CAST(NULL AS VARCHAR) AS inner_code
        FROM x_runs r LEFT JOIN x_coutcome o USING (event_id)""",
})


@query("j7_ports", "SELECT event_id, v AS spec, port, service FROM x_exposed")
def ports(spark, sf):
    df = _containers(spark, sf).select("event_id", F.explode(published_specs("argv")).alias("spec"))
    return (df.withColumn("x", exposed_port(F.col("spec"))).filter(F.col("x").isNotNull())
            .select("event_id", "spec", "x.port", "x.service"))


@query("j8_mounts", "SELECT event_id, v AS spec, host, label FROM x_mounts")
def mounts(spark, sf):
    df = _containers(spark, sf).select("event_id", F.explode(volume_specs("argv")).alias("spec"))
    return (df.withColumn("x", dangerous_mount(F.col("spec"))).filter(F.col("x").isNotNull())
            .select("event_id", "spec", "x.host", "x.label"))


@query("a6_container_issues", """
SELECT event_id, count(issue) AS n, coalesce(string_agg(issue, ' | ' ORDER BY step, i), '') AS issues
FROM x_log LEFT JOIN x_issues USING (event_id) WHERE base = 'docker' GROUP BY event_id""")
def issues(spark, sf):
    found = container_issues("argv")
    return _containers(spark, sf).select(
        "event_id", number(F.size(found)).alias("n"), joined(found).alias("issues"))


@query("g6_container_run", f"""SELECT {VERDICT} FROM x_container
  WHERE event_id IN (SELECT event_id FROM x_runs WHERE sub IN ('run', 'create'))""")
def container_runs(spark, sf):
    done = audit(command_log(spark, sf), context(spark, sf), "container")
    return flat_verdicts(done.filter(positional("argv", 1).isin("run", "create")))


@query("g6b_container_ops", f"""SELECT {VERDICT} FROM x_container
  WHERE event_id IN (SELECT event_id FROM x_runs WHERE sub IS NULL OR sub NOT IN ('run', 'create'))""")
def container_operations(spark, sf):
    done = audit(command_log(spark, sf), context(spark, sf), "container")
    sub = F.coalesce(positional("argv", 1), F.lit(""))
    return flat_verdicts(done.filter(~sub.isin("run", "create")))


# --- J9, A10, G5: key-value -----------------------------------------------------------------------

CTES.update({
    "x_kvrules": values("command, sub, verdict, subject, detail, missing", K.KV_RULES),
    "x_kvargs": """SELECT m.event_id, m.action, p, p[1] AS c, p[2] AS s, p[3] AS t FROM x_matched m
        LEFT JOIN x_kvpos USING (event_id) WHERE guard = 'kv'""",
    "x_kvhit": """SELECT a.*, r.verdict, r.subject, r.detail, r.missing FROM x_kvargs a JOIN x_kvrules r
        ON r.command = a.c AND (r.sub = a.s OR (r.sub = '*' AND NOT EXISTS (
           SELECT 1 FROM x_kvrules e WHERE e.command = a.c AND e.sub = a.s)))""",
    "x_kvtext": """SELECT event_id, verdict, replace(subject, '<sub>', coalesce(s, missing)) AS subject,
        replace(replace(replace(replace(replace(replace(detail, '<mod>', coalesce(s, 'none')),
          '<rest2>', CASE WHEN len(p) > 2 THEN '["' || array_to_string(p[3:], '", "') || '"]' ELSE '[]' END),
          '<rest>', CASE WHEN len(p) > 1 THEN '["' || array_to_string(p[2:], '", "') || '"]' ELSE '[]' END),
          '<third>', CASE WHEN t IS NULL THEN 'None' ELSE 'Some("' || t || '")' END),
          '<host>', coalesce(s, '?')), '<port>', coalesce(t, '?')) AS detail FROM x_kvhit
        UNION ALL SELECT event_id, 'Warn', c, 'deleting ' || (len(p) - 1) || ' keys at once — verify this is intentional'
        FROM x_kvargs WHERE c IN ('DEL', 'UNLINK') AND len(p) > 10""",
    "x_kv": """SELECT a.event_id, a.action, coalesce(t.verdict, 'Allow') AS verdict, FALSE AS masked,
        CASE t.verdict WHEN 'Block' THEN 'REDIS_DESTRUCTIVE' WHEN 'Warn' THEN 'REDIS_CONFIG_CHANGE' END AS code,
        CASE WHEN t.verdict IS NOT NULL THEN 'redis-cli' END AS tool, t.subject, t.detail AS details,
        CAST(NULL AS VARCHAR) AS inner_code FROM x_kvargs a LEFT JOIN x_kvtext t USING (event_id)""",
})


@query("g5_kv", f"SELECT {VERDICT} FROM x_kv")
def kv_verdicts(spark, sf):
    return flat_verdicts(audit(command_log(spark, sf), context(spark, sf), "kv"))


@query("j9_kv_decisions", """SELECT verdict, coalesce(subject, '') AS subject, count(*) AS n FROM x_kv GROUP BY ALL""")
def kv_decisions(spark, sf):
    done = audit(command_log(spark, sf), context(spark, sf), "kv")
    return done.groupBy("verdict", F.coalesce("threat.subject", F.lit("")).alias("subject")).agg(
        F.count("*").alias("n"))


@query("a10_mass_delete", """SELECT event_id, c AS command, CAST(len(p) - 1 AS BIGINT) AS n_keys,
       CAST(len(p) - 1 >= 10 AS BIGINT) AS warned FROM x_kvargs WHERE c IN ('DEL', 'UNLINK')""")
def mass_delete(spark, sf):
    args = kv_positional("argv")
    done = audit(command_log(spark, sf), context(spark, sf), "kv").withColumn("p", args)
    return done.filter(F.get("p", 0).isin("DEL", "UNLINK")).select(
        "event_id", F.get("p", 0).alias("command"), number(F.size("p") - 1).alias("n_keys"),
        number(F.col("verdict") == "Warn").alias("warned"))


# --- F7, J4, G3: paths ----------------------------------------------------------------------------

# The path rules of the sample policy, written out by hand.
_PATH_RULES = [
    (1, "/opt/vault/master.key", "block", "^/opt/vault/master\\.key$"),
    (2, "/opt/vault/unseal/", "block", "^/opt/vault/unseal(/.*)?$"),
    (3, "/var/lib/billing/run?.csv", "mask", "^/var/lib/billing/run[^/]\\.csv$"),
    (4, "~/keys/backup.gpg", "block", "^/home/u/keys/backup\\.gpg$"),
    (5, "~/keys/*.pem", "block", "^/home/u/keys/[^/]*\\.pem$"),
    (6, "~/.netrc", "mask", "^/home/u/\\.netrc$"),
    (7, "~/.local/tokens/", "mask", "^/home/u/\\.local/tokens(/.*)?$"),
    (8, "credentials.ini", "mask", "^credentials\\.ini$"),
    (9, "**/credentials.ini", "mask", "^.*/credentials\\.ini$"),
    (10, "**/wallet.dat", "mask", "^.*/wallet\\.dat$"),
    (11, "/srv/export/*", "mask", "^/srv/export/[^/]*$"),
]
CTES.update({
    "x_strategy": values("tool, how", list(PATH_STRATEGY.items())),
    "x_pathrules": values("ord, raw, mode, regex", _PATH_RULES),
    "x_cands": """SELECT event_id, tool, how, i, CASE WHEN starts_with(t, '/') THEN t
          WHEN starts_with(t, '~/') THEN '/home/u/' || t[3:] WHEN cwd IS NOT NULL THEN cwd || '/' || t ELSE t END AS path
        FROM (SELECT event_id, tool, how, cwd, unnest(c) AS t, generate_subscripts(c, 1) AS i FROM (
          SELECT m.event_id, m.tool, s.how, m.cwd, CASE s.how WHEN 'all' THEN p WHEN 'rest' THEN p[2:] ELSE p[1:1] END AS c
          FROM x_matched m JOIN x_strategy s ON m.tool = s.tool JOIN x_pos USING (event_id)))""",
    "x_pathhit": """SELECT event_id, path, raw, mode FROM (
          SELECT c.event_id, c.path, r.raw, r.mode, row_number() OVER (PARTITION BY c.event_id ORDER BY c.i, r.ord) AS rn
          FROM x_cands c JOIN x_pathrules r ON regexp_matches(c.path, r.regex)) WHERE rn = 1""",
    "x_path": """SELECT m.event_id, m.action, CASE WHEN h.path IS NULL THEN 'Allow' ELSE 'Block' END AS verdict,
          coalesce(h.mode = 'mask' AND s.how <> 'first', FALSE) AS masked,
          CASE WHEN h.mode = 'mask' AND s.how <> 'first' THEN 'FS_POLICY_MASKED'
               WHEN h.path IS NOT NULL THEN 'FS_POLICY_BLOCK' END AS code,
          CASE WHEN h.path IS NOT NULL THEN m.tool END AS tool, h.path AS subject, h.raw AS details,
          CAST(NULL AS VARCHAR) AS inner_code
        FROM x_matched m JOIN x_strategy s ON m.tool = s.tool LEFT JOIN x_pathhit h ON h.event_id = m.event_id
        WHERE m.guard = 'path'""",
})


def _path_commands(spark, sf):
    df = match_action(command_log(spark, sf)).filter("guard = 'path'")
    return df.withColumn("paths", candidate_paths(
        "argv", F.col("tool"), F.col("cwd"), F.lit(HOME)))


@query("f7_candidate_paths", "SELECT event_id, CAST(i AS BIGINT) AS pos, path FROM x_cands")
def paths(spark, sf):
    return _path_commands(spark, sf).select("event_id", F.posexplode("paths").alias("pos", "path")).select(
        "event_id", (number(F.col("pos")) + 1).alias("pos"), "path")


@query("j4_path_policy", "SELECT event_id, path, raw, mode FROM x_pathhit")
def path_rules(spark, sf):
    rules = policy(spark).paths
    df = _path_commands(spark, sf).withColumn("h", first_path_hit(F.col("paths"), rules))
    pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), F.col("h.rule"))
    return df.filter(F.col("h").isNotNull()).select(
        "event_id", "h.path", pick([r.raw for r in rules]).alias("raw"),
        pick([r.mode for r in rules]).alias("mode"))


@query("g3_path_policy", f"SELECT {VERDICT} FROM x_path")
def path_verdicts(spark, sf):
    return flat_verdicts(audit(command_log(spark, sf), context(spark, sf), "path"))
