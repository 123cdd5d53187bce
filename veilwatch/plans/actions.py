"""Commands to audit actions: the first matching registry row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwatch.functions.text import strings
from veilwatch.operators.joins import SALTS, salted_join
from veilwatch.rules.registry import ACTIONS, Action


def action_matches(base: Column, argv: Column, rule: Action) -> Column:
    """The program has the rule's name, all required tokens are there and no excluded one is."""
    test = base == rule.command
    for token in rule.required:
        test = test & F.array_contains(argv, token)
    if rule.excluded:
        test = test & ~F.arrays_overlap(argv, strings(rule.excluded))
    return test


def match_action(cmds: DataFrame, rules: list[Action] = ACTIONS) -> DataFrame:
    """Add ``action``, ``tool`` and ``guard`` of the first matching rule; drop unmatched commands.

    The registry is compiled into one ordered CASE, so matching needs neither join nor shuffle.
    """
    base = F.substring_index(F.col("filename"), "/", -1)
    if "basename" in cmds.columns:
        base = F.coalesce(F.col("basename"), base)
    hit = F.coalesce(*[F.when(action_matches(F.col("_base"), F.col("argv"), r), F.lit(i))
                       for i, r in enumerate(rules, start=1)])
    pick = lambda field: F.element_at(strings([getattr(r, field) for r in rules]), F.col("_rule"))
    # exploding a one-element array drops unmatched rows without working the CASE out twice
    return (cmds.filter(base.isin(sorted({r.command for r in rules})))
            .withColumn("_base", base)
            .withColumn("_rule", F.explode(F.array_compact(F.array(hit)))).drop("_base")
            .withColumns({"action": pick("action"), "tool": pick("command"), "guard": pick("guard")})
            .drop("_rule"))


RULE_SCHEMA = ("tenant string, ord int, action string, command string, required array<string>, "
               "excluded array<string>, guard string")


def action_rules(spark: SparkSession, tenant: str, rules: list[Action] = ACTIONS) -> DataFrame:
    """A registry as rows of the rule table."""
    return spark.createDataFrame([(tenant, *r) for r in rules], RULE_SCHEMA)


def _indexed(rules: DataFrame) -> DataFrame:
    """``tenant``, ``command``, ``token``, ``rules``: rules under their rarest required token, or none.

    Rare is what few rules of the same tenant and command require; ties go to the lesser token.
    """
    rules = rules.select("tenant", "command", F.struct(
        "ord", "action", "guard", F.coalesce("required", strings([])).alias("required"),
        F.coalesce("excluded", strings([])).alias("excluded")).alias("rule"))
    tokens = rules.select("tenant", "command", "rule", F.explode_outer(
        F.array_distinct("rule.required")).alias("token"))
    shares = tokens.groupBy("tenant", "command", "token").agg(F.count(F.lit(1)).alias("n"))
    rarest = (tokens.filter("token is not null").join(shares, ["tenant", "command", "token"])
              .groupBy("tenant", "command", "rule").agg(F.min(F.struct("n", "token"))["token"].alias("token")))
    free = tokens.filter("token is null").withColumn("token", F.lit(""))
    return rarest.unionByName(free).groupBy("tenant", "command", "token").agg(
        F.collect_list("rule").alias("rules"))


def match_action_table(cmds: DataFrame, rules: DataFrame, tenant: str = "host", salts: int = SALTS) -> DataFrame:
    """``match_action`` with the rules of many tenants as a table (``RULE_SCHEMA``).

    ``tenant`` names the column of ``cmds`` that says whose rules count.  A command meets, by one salted
    join over its distinct tokens, the rules that have one of them as their rarest required token, and
    those that require none; the other tokens are tested on these candidates, and the least ``ord`` wins.
    Tokens that are empty, and commands without an event_id, match no rule.
    """
    base = F.substring_index(F.col("filename"), "/", -1)
    if "basename" in cmds.columns:
        base = F.coalesce(F.col("basename"), base)
    named = cmds.filter("event_id is not null").withColumns({"tool": base, "_tenant": F.col(tenant).cast("string")})
    programs = rules.select(F.col("tenant").alias("_tenant"), F.col("command").alias("tool")).distinct()
    named = salted_join(named, programs, ["_tenant", "tool"], "left_semi", ["event_id"], salts, large=True)
    own = F.filter(F.array_distinct("argv"), lambda t: t != "")
    keys = named.select("event_id", "_tenant", "tool", F.explode(F.concat(F.array(F.lit("")), own)).alias("token"))
    index = _indexed(rules).withColumnsRenamed({"tenant": "_tenant", "command": "tool"})
    met = salted_join(keys, index, ["_tenant", "tool", "token"], "inner", ["event_id"], salts,
                      large=True)
    fits = lambda r: (F.size(F.array_except(r["required"], "argv")) == 0) & ~F.arrays_overlap(r["excluded"], "argv")
    tried = met.select("event_id", "rules").join(named.select("event_id", "argv"), "event_id").select(
        "event_id", F.array_min(F.transform(F.filter("rules", fits), lambda r: F.struct(
            r["ord"].alias("ord"), r["action"].alias("action"), r["guard"].alias("guard")))).alias("rule"))
    best = tried.groupBy("event_id").agg(F.min("rule").alias("_rule")).filter("_rule is not null")
    return named.join(best, "event_id").withColumns(
        {"action": F.col("_rule.action"), "guard": F.col("_rule.guard")}).drop("_rule", "_tenant")
