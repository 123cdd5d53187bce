"""Container guard: run and create options, and the other operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwatch.functions.argv import collect_specs, flag_values, has_flag, positional
from veilwatch.functions.text import replace_markers, sql_literal, string_map, strings
from veilwatch.functions.verdicts import allow, block, threat, warn
from veilwatch.rules import container_rules as C

UNSAFE = "DOCKER_UNSAFE_RUN"


def _say(name: str, **values) -> Column:
    return replace_markers(C.ISSUE[name], values) if values else F.lit(C.ISSUE[name])


def _texts(arr: Column, text) -> Column:
    """Non-null texts of an array's elements."""
    return F.filter(F.transform(arr, text), lambda x: x.isNotNull())


def _one(test: Column, text: Column) -> Column:
    return F.when(test, F.array(text)).otherwise(strings([]))


def exposed_port(spec: Column) -> Column:
    """(port, service) when a publish spec opens a known service port on all interfaces."""
    parts = F.split(F.substring_index(spec, "/", 1), ":", 3)
    n = F.size(parts)
    part = lambda i: F.try_element_at(parts, F.lit(i))
    address = F.when(n == 2, "0.0.0.0").when(n == 3, part(1))
    number = F.substring_index(F.when(n == 2, part(1)).when(n == 3, part(2)), "-", 1)
    port = F.regexp_extract(number, r"^\+?0*([0-9]{1,5})\z", 1)
    known = string_map((str(number), service) for number, service in C.SERVICE_PORTS)
    service = F.try_element_at(known, port)
    return F.when(address.isin("", "0.0.0.0") & service.isNotNull(),
                  F.struct(port.alias("port"), service.alias("service")))


def dangerous_mount(spec: Column) -> Column:
    """(host path, label) when a volume spec mounts a dangerous host path; first prefix wins."""
    host = F.substring_index(spec, ":", 1)
    label = F.coalesce(*[
        F.when((host == prefix.rstrip("/")) | host.startswith(prefix), F.lit(label))
        for prefix, label in C.DANGEROUS_PREFIXES])
    return F.when(host.startswith("/") & label.isNotNull(),
                  F.struct(host.alias("host"), label.alias("label")))


def published_specs(argv: str = "argv") -> Column:
    return collect_specs(argv, ["-p", "--publish"])


def volume_specs(argv: str = "argv") -> Column:
    return collect_specs(argv, ["-v", "--volume"])


def container_issues(argv: str = "argv") -> Column:
    """Blocking issues of a run or create command, in check order."""
    def host_value(flag: str) -> Column:
        return F.array_contains(flag_values(argv, flag), "host") | has_flag(argv, f"{flag}=host")

    def capability(v: Column) -> Column:
        return F.when(F.upper(v).isin(C.DANGEROUS_CAPABILITIES), _say("capability", v=v))

    def profile(v: Column) -> Column:
        return (F.when(F.contains(v, F.lit("seccomp=unconfined")), _say("seccomp", v=v))
                .when(F.contains(v, F.lit("apparmor=unconfined")), _say("apparmor", v=v)))

    def device(v: Column) -> Column:
        host = F.substring_index(v, ":", 1)
        test = host.isin(C.RAW_DEVICES)
        for prefix in C.RAW_DEVICE_PREFIXES:
            test = test | host.startswith(prefix)
        return F.when(test, _say("device", v=v))

    def mount(v: Column) -> Column:
        hit = dangerous_mount(v)
        return F.when(hit.isNotNull(), _say("mount", v=hit["host"], s=hit["label"]))

    def port(v: Column) -> Column:
        hit = exposed_port(v)
        return F.when(hit.isNotNull(), _say("port", p=hit["port"], s=hit["service"]))

    socket = F.expr(f"exists({argv}, x -> contains(x, '{C.DAEMON_SOCKET}'))")
    return F.concat(
        _one(has_flag(argv, "--privileged"), _say("privileged")),
        _texts(flag_values(argv, "--cap-add"), capability),
        _one(host_value("--pid"), _say("pid")),
        _one(host_value("--ipc"), _say("ipc")),
        _texts(flag_values(argv, "--security-opt"), profile),
        _texts(flag_values(argv, "--device"), device),
        _one(socket, _say("socket")),
        _texts(volume_specs(argv), mount),
        _texts(published_specs(argv), port))


def shares_host_network(argv: str = "argv") -> Column:
    return (F.array_contains(flag_values(argv, "--network"), "host")
            | F.array_contains(flag_values(argv, "--net"), "host")
            | has_flag(argv, "--network=host") | has_flag(argv, "--net=host"))


# operation: verdict, code, and how subject and details are filled
_DECISIONS = {
    "exec_privileged": ("Block", "DOCKER_EXEC", "", "privileged"),
    "exec": ("Warn", "DOCKER_EXEC", "", ""),
    "remove_container": ("Warn", "DOCKER_FORCE_REMOVE", "container", ""),
    "remove_image": ("Warn", "DOCKER_FORCE_REMOVE", "image", ""),
    "prune_all_volumes": ("Block", UNSAFE, "", C.OPERATION["prune_all_volumes"]),
    "prune_all": ("Block", UNSAFE, "", C.OPERATION["prune_all"]),
    "prune_volumes": ("Block", UNSAFE, "", C.OPERATION["prune_volumes"]),
    "prune": ("Warn", UNSAFE, "", C.OPERATION["prune"]),
    "volume": ("Block", "DOCKER_VOLUME_DESTROY", "<third>", ""),
    "swarm_init": ("Block", UNSAFE, "", C.OPERATION["swarm_init"]),
    "swarm_join": ("Block", UNSAFE, "", C.OPERATION["swarm_join"]),
    "swarm_leave_force": ("Block", UNSAFE, "", C.OPERATION["swarm_leave_force"]),
    "swarm_leave": ("Warn", UNSAFE, "", C.OPERATION["swarm_leave"]),
    "push": ("Warn", "DOCKER_PUSH", "<second>", ""),
    "login": ("Warn", "DOCKER_LOGIN", "", ""),
    "commit": ("Warn", "DOCKER_COMMIT", "", ""),
    "cp": ("Warn", "DOCKER_CP", "", ""),
    "run_issues": ("Block", UNSAFE, "", "<issues>"),
    "run_network": ("Warn", UNSAFE, "", C.ISSUE["network"]),
}


def operation_name(argv: str = "argv") -> Column:
    """Which of the judged operations a command is; null for all others."""
    flag = lambda *names: " or ".join(
        f"exists({argv}, x -> x = '{n}' or startswith(x, '{n}='))" for n in names)
    force, every, volumes = flag("-f", "--force"), flag("-a", "--all"), flag("--volumes")
    return F.expr(f"""case
        when _sub = 'exec' then if({flag('--privileged')}, 'exec_privileged', 'exec')
        when _sub = 'rm' or (_sub = 'container' and _second in ('rm', 'remove'))
            then if({force}, 'remove_container', null)
        when _sub = 'rmi' or (_sub = 'image' and _second in ('rm', 'remove', 'prune'))
            then if({force}, 'remove_image', null)
        when _sub = 'system' and _second = 'prune' then
            case when ({every}) and ({volumes}) then 'prune_all_volumes'
                 when {every} then 'prune_all' when {volumes} then 'prune_volumes' else 'prune' end
        when _sub = 'volume' and _second in ('rm', 'remove') then 'volume'
        when _sub = 'swarm' and _second = 'init' then 'swarm_init'
        when _sub = 'swarm' and _second = 'join' then 'swarm_join'
        when _sub = 'swarm' and _second = 'leave' then if({force}, 'swarm_leave_force', 'swarm_leave')
        when _sub in ('push', 'login', 'commit', 'cp') then _sub end""")


def with_container_outcome(df: DataFrame, out: str = "outcome",
                           gate: Column | None = None) -> DataFrame:
    """Run and create commands by their issues, other operations by a decision table."""
    gate = F.lit(True) if gate is None else gate
    issues, row = F.col("_issues"), F.col("_decision")
    runs = F.col("_sub").isin("run", "create")
    name = F.when(gate, F.when(~runs, operation_name()).when(F.size(issues) > 0, "run_issues")
                  .when(shares_host_network(), "run_network"))
    table = ", ".join(f"{sql_literal(k)}, array({', '.join(sql_literal(x) for x in v)})"
                      for k, v in _DECISIONS.items())
    decision = F.try_element_at(F.expr(f"map({table})"), name)
    unknown = F.lit("<unknown>")
    subject, detail = F.get(row, 2), F.get(row, 3)
    subject = (F.when(subject == "<second>", F.coalesce("_second", unknown))
               .when(subject == "<third>", F.coalesce(positional("argv", 3), unknown))
               .otherwise(F.nullif(subject, F.lit(""))))
    details = (F.when(detail == "<issues>", issues).when(detail == "", strings([]))
               .otherwise(F.array(detail)))
    what = threat(F.get(row, 1), "docker", subject, details)
    outcome = (F.when(F.get(row, 0) == "Block", block(what))
               .when(F.get(row, 0) == "Warn", warn(what)).otherwise(allow()))
    return (df.withColumn("_sub", F.when(gate, positional("argv", 1)))
            .withColumn("_second", F.when(gate, positional("argv", 2)))
            .withColumn("_issues", F.when(runs, container_issues()))
            .withColumn("_decision", decision)
            .withColumn(out, F.when(gate, outcome))
            .drop("_sub", "_second", "_issues", "_decision"))
