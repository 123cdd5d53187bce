"""Rules of many tenants as a table against the compiled registry."""

import random

from pyspark.sql import functions as F

from veilwatch.plans.actions import RULE_SCHEMA, match_action, match_action_table
from veilwatch.rules.registry import Action

LOG = "event_id long, host string, filename string, argv array<string>"


def test_table_equals_compiled_rules(spark):
    rng = random.Random(6)
    tokens = [f"t{k}" for k in range(12)] + ["", "-x"]
    rules = {h: [Action(k, f"{h}-{k}", rng.choice("ab"), rng.sample(tokens[:12], rng.randrange(0, 4)),
                        rng.sample(tokens, rng.randrange(0, 3)), "path") for k in range(rng.randrange(1, 60))]
             for h in ("h0", "h1", "h2")}
    log = [(k, rng.choice(["h0", "h1", "h2", "h9", None]), f"/bin/{rng.choice('abc')}",
            rng.choices(tokens, k=rng.randrange(0, 9))) for k in range(1500)]
    cmds = spark.createDataFrame(log, LOG)
    table = spark.createDataFrame([(h, *r) for h, own in rules.items() for r in own], RULE_SCHEMA)
    got = match_action_table(cmds, table, salts=3).select("event_id", "action", "tool", "guard")
    want = set()
    for host, own in rules.items():
        some = match_action(cmds.filter(F.col("host") == host), own)
        want |= {tuple(r) for r in some.select("event_id", "action", "tool", "guard").collect()}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 300


def test_many_rules_stay_out_of_the_plan(spark):
    table = spark.range(10_000).selectExpr(
        "'h0' AS tenant", "CAST(id AS INT) AS ord", "concat('rule', id) AS action", "'npm' AS command",
        "array('install', concat('pkg', id)) AS required", "CAST(array() AS array<string>) AS excluded", "'path' AS guard")
    cmds = spark.createDataFrame([(k, "h0", "/usr/bin/npm", ["npm", "install", f"pkg{k * 7}"]) for k in range(300)], LOG)
    done = match_action_table(cmds, table)
    assert "pkg77" not in done._jdf.queryExecution().executedPlan().toString()
    assert {r["event_id"]: r["action"] for r in done.collect()} == {k: f"rule{k * 7}" for k in range(300)}
