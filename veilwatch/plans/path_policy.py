"""Path guard: candidate paths of a command against ordered path rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwatch.functions.argv import positionals
from veilwatch.functions.globs import glob_test, resolve_path
from veilwatch.functions.masking import mask_text
from veilwatch.functions.text import string_map, strings
from veilwatch.functions.verdicts import allow, block, masked, threat
from veilwatch.operators.joins import SALTS, salted_join
from veilwatch.rules.registry import PATH_STRATEGY
from veilwatch.sources.policy import PathRule, Policy

RULES_PER_STEP = 200  # rules compiled into one CASE


def _strategy(tool: Column) -> Column:
    return F.try_element_at(string_map(PATH_STRATEGY.items()), tool)


def candidate_paths(argv: str, tool: Column, cwd: Column, home: Column) -> Column:
    """The paths a command touches, absolute where that can be known, in argument order."""
    args, how = positionals(argv), _strategy(tool)
    chosen = (F.when(how == "all", args)
              .when(how == "rest", F.slice(args, F.lit(2), F.greatest(F.size(args), F.lit(1))))
              .when(how == "first", F.slice(args, F.lit(1), F.lit(1))))
    return F.transform(chosen, lambda p: resolve_path(p, cwd, home))


def first_rule(path: Column, rules: list[PathRule]) -> Column:
    """Index (from 1) of the first rule that covers the path; null when none does.

    Rules are tested in file order inside the row, so neither a join nor a cross product arises
    however many commands there are.  Long rule lists are cut into several CASEs.
    """
    steps = []
    for at in range(0, len(rules), RULES_PER_STEP):
        case = F.when(F.lit(False), F.lit(0))
        for i, rule in enumerate(rules[at:at + RULES_PER_STEP], start=at + 1):
            case = case.when(glob_test(path, rule.expanded), F.lit(i))
        steps.append(case)
    return F.coalesce(*steps) if steps else F.lit(None).cast("int")


def first_path_hit(paths: Column, rules: list[PathRule]) -> Column:
    """The first path covered by a rule, with the index of that rule."""
    hits = F.transform(paths, lambda p: F.struct(p.alias("path"), first_rule(p, rules).alias("rule")))
    return F.try_element_at(F.filter(hits, lambda h: h["rule"].isNotNull()), F.lit(1))


def with_path_outcome(df: DataFrame, policy: Policy, home: str | None, out: str = "outcome",
                      gate: Column | None = None) -> DataFrame:
    """Blocked paths block; masked paths block for tools that do not print, else count as masked."""
    gate = F.lit(True) if gate is None else gate
    if not policy.paths:
        return df.withColumn(out, F.when(gate, allow()))
    tool, hit = F.col("tool"), F.col("_hit")
    paths = candidate_paths("argv", tool, F.col("cwd"), F.lit(home).cast("string"))
    raw = F.get(strings([r.raw for r in policy.paths]), hit["rule"] - 1)
    mode = F.get(strings([r.mode for r in policy.paths]), hit["rule"] - 1)
    prints = _strategy(tool) != "first"
    what = lambda code: threat(code, tool, hit["path"], F.array(raw))
    outcome = (F.when(hit.isNull(), allow())
               .when((mode == "mask") & prints, masked(what("FS_POLICY_MASKED")))
               .otherwise(block(what("FS_POLICY_BLOCK"))))
    return (df.withColumn("_hit", F.when(gate, first_path_hit(paths, policy.paths)))
            .withColumn(out, F.when(gate, outcome)).drop("_hit"))


def mask_files(contents: DataFrame, policy: Policy) -> DataFrame:
    """Files covered by a masking rule, with their content masked."""
    rules = policy.paths
    if not rules:
        return contents.filter(F.lit(False))
    mode = F.get(strings([r.mode for r in rules]), F.col("_rule") - 1)
    return (contents.withColumn("_rule", first_rule(F.col("path"), rules))
            .filter(F.col("_rule").isNotNull() & (mode == "mask"))
            .withColumn("content", mask_text(F.col("content"))).drop("_rule"))


def _last(segments: Column) -> Column:
    return F.try_element_at(segments, F.lit(-1))


def _wild(text: Column) -> Column:
    return F.contains(text, F.lit("*")) | F.contains(text, F.lit("?"))


def _ancestors(segments: Column) -> Column:
    """The path itself and all that lie above it."""
    return F.transform(F.sequence(F.lit(1), F.size(segments)),
                       lambda n: F.array_join(F.slice(segments, F.lit(1), n), "/"))


def index_rules(rules: DataFrame) -> DataFrame:
    """Rules by ``policy_id`` and ``key``, the most telling literal part of each, in order.

    A rule without wildcards is found by its path, a directory by its own name among a path's ancestors.
    A pattern is found by its last segment where that is literal, else by its ending where the last
    segment is a star and an extension, else by the directories before its first wildcard.  Only
    patterns with neither are tried on every path of their policy.
    """
    target = F.col("expanded")
    segments = F.split(target, "/")
    ending = F.regexp_extract(_last(segments), r"^\*+(\.[^*?.]+)\z", 1)
    lead = F.regexp_replace(F.regexp_extract(target, r"^[^*?]*/", 0), r"/\z", "")
    key = (F.when(target.endswith("/"), F.concat(F.lit("/"), F.regexp_replace(target, r"/+\z", "")))
           .when(~_wild(target), F.concat(F.lit("="), target))
           .when(~_wild(_last(segments)) & F.contains(target, F.lit("/")), F.concat(F.lit("n"), _last(segments)))
           .when(ending != "", F.concat(F.lit("e"), ending))
           .when(lead != "", F.concat(F.lit("d"), lead)).otherwise(F.lit("r")))
    sure = F.left(key, F.lit(1)).isin("/", "=") & ~target.endswith("//")
    regex = F.when(~sure, F.col("regex")).alias("regex")
    return rules.select("policy_id", key.alias("key"), F.struct("ord", "raw", "mode", regex).alias("rule")).groupBy(
        "policy_id", "key").agg(F.array_sort(F.collect_list("rule")).alias("rules"))


def path_keys(path: Column) -> Column:
    """All keys under which a rule that covers the path can be found."""
    segments = F.split(path, "/")
    name, above = _last(segments), _ancestors(segments)
    tag = lambda t, keys: F.transform(keys, lambda k: F.concat(F.lit(t), k))
    return F.concat(F.array(F.lit("r"), F.concat(F.lit("="), path), F.concat(F.lit("n"), name),
                            F.concat(F.lit("e."), F.substring_index(name, ".", -1))),
                    tag("/", above), tag("d", above))


def lookup_path_policy(paths: DataFrame, rules: DataFrame, salts: int = SALTS) -> DataFrame:
    """The first rule of each row's own policy that covers its path: ``ord``, ``raw``, ``mode``.

    ``paths`` has ``id`` (unique), ``policy_id`` and ``path``; ``rules`` are the path rules of many parsed
    policies.  A path meets the rules that share a key with it (``index_rules``) by one equi join; a
    pattern's expression runs for these candidates alone, in rule order up to the first that fits.  The
    join is salted: one policy, or one file name, may be everybody's; the rules grow with the policies and
    are never broadcast.  Rows no rule covers are left out.
    """
    keyed = paths.filter(F.col("path").isNotNull()).select(
        "id", "policy_id", "path", F.explode(F.array_distinct(path_keys(F.col("path")))).alias("key"))
    met = salted_join(keyed, index_rules(rules), ["policy_id", "key"], "inner", ["id"], salts, large=True)
    fits = F.filter("rules", lambda r: r["regex"].isNull() | F.rlike(F.col("path"), r["regex"]))
    best = (met.select("id", F.try_element_at(fits, F.lit(1)).alias("rule")).filter("rule is not null")
            .groupBy("id").agg(F.min(F.struct("rule.ord", "rule.raw", "rule.mode")).alias("_best")))
    return paths.join(best.hint("merge"), "id").select(*paths.columns, "_best.ord", "_best.raw", "_best.mode")
