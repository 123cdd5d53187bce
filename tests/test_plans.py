"""Shapes of plans that matter at scale."""

import random

import pytest
from pyspark.sql import functions as F

from registry.fixtures import command_log, commit_diffs, context, file_contents, policy, raw_log
from veilwatch.functions.masking import mask_table
from veilwatch.functions.verdicts import allow, block, threat
from veilwatch.operators.diffs import commit_hits, diff_lines
from veilwatch.plans.dispatch import GUARDS, Context, Guard, audit
from veilwatch.plans.path_policy import first_rule, lookup_path_policy
from veilwatch.rules.registry import ACTIONS, Action
from veilwatch.session import build_session, checkpoint_root
from veilwatch.sources.exec_events import read_command_log, watchlist_filter, write_command_log
from veilwatch.sources.policy import PathRule, load_policies

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _stored_log(spark, tmp_path):
    df = spark.sql("""SELECT id AS event_id, 'h' AS host, timestamp'2024-01-01' AS ts, id AS pid, id AS uid, 'sh' AS comm,
        '/usr/bin/docker' AS filename, array('docker', 'run', '--privileged') AS argv, '/w' AS cwd FROM range(10)""")
    df.write.parquet(str(tmp_path / "log"))
    return spark.read.parquet(str(tmp_path / "log"))


def test_command_guards_do_not_shuffle(spark, tmp_path):
    log = _stored_log(spark, tmp_path)
    none = Context(None, None, policy(spark), "/home/u")
    done = audit(log, none, "kv", "container", "path")
    plan = _plan(done)
    assert "Exchange" not in plan and plan.count("FileScan") == 1
    assert done.filter("verdict = 'Block'").count() == 10


def test_all_guards_scan_the_log_once(spark, tmp_path):
    command_log(spark, SF).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    scans = spark.sparkContext.accumulator(0)

    def seen(batches):
        scans.add(1)
        yield from batches

    parts = log.rdd.getNumPartitions()
    done = audit(log.mapInArrow(seen, log.schema), context(spark, SF))
    assert done.count() > 300
    assert scans.value == parts
    assert str(tmp_path / "log") not in _plan(done)


def test_watch_list_reaches_the_scan(spark, tmp_path):
    write_command_log(raw_log(spark, SF), str(tmp_path / "log"))
    df = watchlist_filter(read_command_log(spark, str(tmp_path / "log")))
    pushed = [x for x in _plan(df).splitlines() if "PushedFilters" in x][0]
    assert "In(basename" in pushed
    assert df.count() == watchlist_filter(raw_log(spark, SF)).count() > 0


def test_no_folder_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    named = spark.conf.get("spark.checkpoint.dir", None)
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default
                        if key == "spark.checkpoint.dir" else named)
    with pytest.raises(RuntimeError):
        checkpoint_root(spark)
    assert build_session is not None


def test_a_seventh_guard_with_its_own_lookup(spark, tmp_path):
    """Registering a guard takes an entry and a registry row, and no change to the dispatch."""
    known = spark.createDataFrame([("pkg-bad", "stolen")], "package string, why string")

    def needs():
        return F.size("argv") > 2

    def lookup(df, ctx):
        return df.withColumn("package", F.get("argv", 2)).join(ctx.tables["packages"], "package", "left")

    def inline(df, ctx):
        return df.withColumn("why", F.lit(None).cast("string"))

    def outcome(df, ctx, out, gate):
        said = F.when(F.col("why").isNotNull(), block(threat("PACKAGE", "npm", None, F.array("why")))).otherwise(allow())
        return df.withColumn(out, F.when(gate, said))

    log = spark.createDataFrame(
        [(1, ["npm", "install", "pkg-bad"]), (2, ["npm", "install", "pkg-good"]), (3, ["npm", "install"]),
         (4, ["docker", "run", "--privileged", "x"])], "event_id long, argv array<string>")
    log = log.withColumns({"host": F.lit("h"), "ts": F.lit("2024-01-01").cast("timestamp"), "pid": F.lit(1),
                           "cwd": F.lit("/w"), "filename": F.concat(F.lit("/usr/bin/"), F.get("argv", 0))})
    rules = [*ACTIONS, Action(99, "npm-install", "npm", ["install"], [], "package")]
    ctx = Context(file_contents(spark, SF), commit_diffs(spark, SF), policy(spark), "/home/u",
                  tables={"packages": known})
    done = audit(log, ctx, guards={**GUARDS, "package": Guard(outcome, None, needs, lookup, inline)}, rules=rules)
    assert {r["event_id"]: r["verdict"] for r in done.collect()} == {1: "Block", 2: "Allow", 3: "Allow", 4: "Block"}


def test_one_verdict_per_event_whatever_is_delivered_twice(spark):
    log, ctx = command_log(spark, SF), context(spark, SF)
    twice = ctx._replace(contents=ctx.contents.unionByName(ctx.contents), diffs=ctx.diffs.unionByName(ctx.diffs))
    once = audit(log, ctx).select("event_id", "verdict", "threat")
    again = audit(log, twice).select("event_id", "verdict", "threat")
    assert again.count() == once.count() == again.select("event_id").distinct().count()
    assert again.exceptAll(once).count() == 0


def test_diffs_are_cut_before_any_pattern(spark, tmp_path):
    commit_diffs(spark, SF).write.parquet(str(tmp_path / "d"))
    diffs = spark.read.parquet(str(tmp_path / "d"))
    plan = _plan(audit(command_log(spark, SF), Context(None, diffs), "commit"))
    scan = plan.index(str(tmp_path / "d"))
    between = plan[plan.rindex("Join", 0, scan):scan]
    assert "regexp" not in between and "rlike" not in between


def test_diffs_do_not_shuffle(spark, tmp_path):
    commit_diffs(spark, SF).write.parquet(str(tmp_path / "d"))
    diffs = spark.read.parquet(str(tmp_path / "d"))
    assert "Exchange" not in _plan(diff_lines(diffs))
    assert "Exchange" not in _plan(commit_hits(diffs))


def test_masked_read_prunes_and_pushes(spark):
    df = mask_table(spark.read.parquet(f"{SF}/customer.parquet"), "customer", policy(spark))
    plan = df.filter("c_nationkey = 3").select("c_custkey", "c_name")._jdf.queryExecution().toString()
    assert "EqualTo(c_nationkey,3)" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_nationkey:int>" in plan


def test_filter_on_verdicts_stays_above_the_work(spark, tmp_path):
    log = _stored_log(spark, tmp_path)
    done = audit(log, Context(None, None, policy(spark), "/home/u"), "container")
    plain, filtered = _plan(done), _plan(done.filter(F.col("verdict") == "Block"))
    assert len(filtered) < 1.3 * len(plain)


def test_rules_of_many_policies_stay_off_the_driver(spark):
    """A few packed texts become many rules, which no estimate sees."""
    files = spark.range(3).selectExpr("concat('p', id) AS policy_id", "1 AS priority",
                                      "concat('fblock /a/', id, '\nfmask /a/') AS content")
    given = spark.range(6).selectExpr("id", "concat('p', id % 3) AS policy_id", "concat('/a/', id) AS path")
    found = lookup_path_policy(given, load_policies(files).paths, salts=2)
    assert "Broadcast" not in _plan(found)
    assert {r["id"]: r["ord"] for r in found.collect()} == {k: 1 if k < 3 else 2 for k in range(6)}


def test_indexed_rules_equal_rules_in_order(spark):
    """Ten thousand rules in one policy: what the index finds is what trying all in order finds."""
    rng = random.Random(8)
    shapes = ["/srv/{a}/{b}.txt", "/srv/{a}/", "**/{b}.env", "/srv/{a}/*.{c}", "**/*.{c}", "/srv/{a}/x*", "/srv/?{b}",
              "src/{a}/*", "*{b}*", "/srv/{a}/**/{b}", "**/.{c}", "/srv/{a}*/{b}", "{a}?", "/srv/**.{c}", "/srv/{a}/.*"]
    name = lambda k, n: f"{k}{rng.randrange(n)}"
    texts = [rng.choice(shapes).format(a=name("a", 60), b=name("b", 900), c=name("c", 40)) for _ in range(400)]
    lines = "".join(f"fblock {t}\n" for t in texts)
    many = lines + "".join(f"fmask /far/{k}/f{k}\nfblock **/g{k}\n" for k in range(4800))
    files = spark.createDataFrame([("few", 1, lines), ("many", 1, many)], "policy_id string, priority int, content string")
    paths = [rng.choice(["/srv/{a}/{b}.txt", "/x/{b}.env", "/srv/{a}/q.{c}", "/srv/{a}", "/srv/{a}/x1", "/srv/z{b}", "src/{a}/k",
                         "/srv/{a}/u/v/{b}", "/w/.{c}", "{a}z", "/srv/{a}/.c1", "/srv/{a}/", "{b}.env", "/", "", "/srv//{b}"]).format(
        a=name("a", 60), b=name("b", 900), c=name("c", 40)) for _ in range(400)]
    rows = [(k, policy, p) for k, (policy, p) in enumerate((o, p) for o in ("few", "many", "none") for p in paths)]
    given = spark.createDataFrame([*rows, (9999, "few", None)], "id long, policy_id string, path string")
    found = lookup_path_policy(given, load_policies(files).paths, salts=3)
    rules = [PathRule(k, t, t, "block") for k, t in enumerate(texts, 1)]
    want = {r["p"]: r["n"] for r in spark.createDataFrame([(p,) for p in set(paths)], "p string").select(
        "p", first_rule(F.col("p"), rules).alias("n")).collect()}
    got = {r["id"]: r["ord"] for r in found.collect()}
    assert got == {k: want[p] for k, policy, p in rows if policy != "none" and want[p]}
    assert 100 < len(got) < 750
    assert len(_plan(found)) < 100_000 and "f4799" not in _plan(found)
