"""Table-driven cases for text, argument, path and policy expressions."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from veilwatch.functions import argv as A
from veilwatch.functions.globs import expand_home, glob_regex, glob_test, resolve_path
from veilwatch.functions.masking import mask_partial, mask_table, mask_text
from veilwatch.functions.sqltext import (dedup_consecutive, normalise_sql, stacked_statement,
                                         with_sql_analysis)
from veilwatch.functions.text import clip_bytes, quoted_list, text_lines
from veilwatch.plans.path_policy import first_rule
from veilwatch.functions.verdicts import block, threat
from veilwatch.plans.reports import detail_lines, threat_message
from veilwatch.rules.sql_rules import NEEDS, SQL_RULES
from veilwatch.rules.text_rules import EMAIL_LINEAR, TEXT_RULES
from veilwatch.sources.exec_events import decode_exec_events, read_exec_events, watchlist_filter
from veilwatch.sources.policy import PathRule, policy_from_text
from veilwatch.sources.reports import write_reports


def _one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("tokens, expected", [
    (["d", "--f", "a", "--f=b"], ["a", "b"]),
    (["d", "--f", "--f", "--f", "x"], ["--f", "x"]),
    (["d", "--f"], []),
    (["d", "--f="], [""]),
    (["d", "--fx", "--f", "--f=y"], ["--f=y"]),
])
def test_flag_values(spark, tokens, expected):
    assert _one(spark, tokens, "array<string>", A.flag_values("v", "--f")) == expected


@pytest.mark.parametrize("tokens, expected", [
    (["d", "-p80:80", "-p", "1:2", "--publish=3:4", "--publish", "5", "-p"], ["80:80", "1:2", "3:4", "5"]),
    (["d", "-p", "--publish", "--publish", "x"], ["--publish", "x"]),
    (["d", "-p=9:9"], ["9:9"]),
])
def test_collect_specs(spark, tokens, expected):
    assert _one(spark, tokens, "array<string>", A.collect_specs("v", ["-p", "--publish"])) == expected


@pytest.mark.parametrize("tokens, audit, policy", [
    (["psql", "-c", "S"], ("inline", "S"), ("inline", "S")),
    (["psql", "--command", "A", "-c", "B"], ("inline", "A"), ("inline", "B")),
    (["psql", "-f", "p", "-c"], ("file", "p"), None),
    (["psql", "--file=p"], ("file", "p"), None),
    (["psql", "-c=S=1"], ("inline", "S=1"), ("inline", "S=1")),
    (["sqlite3", "db"], None, None),
    (["sqlite3", "-x", "db", "S"], ("inline", "S"), ("inline", "S")),
    (["mysql", "-c", "S"], None, None),
])
def test_extract_sql(spark, tokens, audit, policy):
    for order, want in (("audit", audit), ("policy", policy)):
        got = _one(spark, tokens, "array<string>", A.extract_sql("v", "v[0]", order))
        assert (tuple(got) if got else None) == want


def test_pod_and_separator(spark):
    argv = ["kubectl", "-n", "x", "exec", "-it", "exec", "pod", "--", "psql"]
    assert _one(spark, argv, "array<string>", A.pod_name("v")) == "pod"
    assert _one(spark, argv, "array<string>", A.after_separator("v")) == ["psql"]
    assert _one(spark, ["kubectl", "exec"], "array<string>", A.pod_name("v")) == "<unknown-pod>"
    assert _one(spark, ["kubectl", "exec", "--"], "array<string>", A.after_separator("v")) == []


def test_kv_positional(spark):
    argv = ["r", "-h", "-h", "-p", "1", "--raw", "get", "-a=x", "k"]
    assert _one(spark, argv, "array<string>", A.kv_positional("v")) == ["GET", "K"]


def test_clip_never_splits_a_character(spark):
    for text in ("aéz", "€€€", "\U0001f600b", "abc", ""):
        for n in range(0, 8):
            got = _one(spark, text, "string", clip_bytes(F.col("v"), n))
            want = text
            while len(want.encode()) > n:
                want = want[:-1]
            assert got == want


def test_lines(spark):
    for text, want in (("", []), ("a\n", ["a"]), ("a\n\n", ["a", ""]), ("a\r\nb", ["a", "b"]), ("\n", [""])):
        assert _one(spark, text, "string", text_lines(F.col("v"))) == want


def test_detail_lines(spark):
    text = "\n  one \n\n" + "é" * 40 + "\nthree\nfour"
    assert _one(spark, text, "string", detail_lines(F.col("v"))) == ["one", "é" * 26, "three"]


def test_quoted_list(spark):
    assert _one(spark, ['a"b', "c\\d", "e\nf"], "array<string>", quoted_list(F.col("v"))) == r'["a\"b", "c\\d", "e\nf"]'


def test_normalise(spark):
    sql = "  a /* x */ /* open\n b -- c\n  d "
    assert _one(spark, sql, "string", normalise_sql(F.col("v"))) == "a /* open b d"


def test_dedup(spark):
    got = _one(spark, ["a", "a", "b", "a", "a"], "array<string>", dedup_consecutive(F.col("v")))
    assert got == ["a", "b", "a"]


def test_rule_needs_hold_for_every_match(spark):
    """The literal gate never hides a match: run each pattern with and without it."""
    words = sorted({w for texts in NEEDS.values() for w in texts} | {
        "TABLE", "DATABASE", "CREATE", "INTO", "DATA", "LOAD", "SELECT", "FROM", "TO", "(", "@", "1", "'x'", "users",
        "a.b", "SET", "WHERE", "OR", "COLUMN", "\\dt", "DELAY", "ſhow", "taKen", "'", "/"})
    rng = random.Random(11)
    rows = [(" ".join(rng.choice(words) if rng.random() < .8 else rng.choice(words).lower()
                      for _ in range(rng.randint(2, 9))),) for _ in range(1500)]
    df = spark.createDataFrame(rows, "s string").withColumn("up", F.upper(F.lower("s")))
    for rule in SQL_RULES:
        gate = F.lit(False)
        for text in NEEDS[rule.ord]:
            gate = gate | F.contains("up", F.lit(text))
        assert df.filter(F.col("s").rlike("(?U)" + rule.pattern) & ~gate).count() == 0, rule


def test_analysis(spark):
    rows = [("DROP TABLE a; GRANT x TO y; SELECT pg_sleep(1)", "Dangerous", "SQL_PRIV_ESCALATION", 1, 3),
            ("SHOW TABLES; SHOW TABLES; EXPLAIN a", "Suspicious", "SQL_SUSPICIOUS", 2, 3),
            ("SELECT 1", "Clean", None, 0, 0)]
    df = spark.createDataFrame(rows, "sql string, level string, code string, n int, everything int")
    for r in with_sql_analysis(df, "sql", "a").collect():
        assert (r["a"]["level"], r["a"]["code"], len(r["a"]["details"]), len(r["a"]["all_details"])) == (
            r["level"], r["code"], r["n"], r["everything"])
    assert _one(spark, "SELECT 1; DROP TABLE x", "string", stacked_statement(F.col("v"))) is True


def test_mask_is_equal_to_the_plain_rules(spark):
    """Gates and the linear e-mail pattern change no result."""
    rng = random.Random(2)
    bits = ["a@b.co", "x.y@z.org_", "_q@w.net", "@", "user", "tok" + "en=", "Secret : abcdefgh", "api_key='12345678'", " ",
            "\n", "gh" + "p_" + "a" * 36, "AK" + "IA" + "Z" * 16, "0" * 32, "f" * 65, "é", "]:", "paſſword=abcdefgh"]
    rows = [("".join(rng.choice(bits) for _ in range(rng.randint(1, 12))),) for _ in range(2000)]
    df = spark.createDataFrame(rows, "t string")
    plain = F.col("t")
    for rule in TEXT_RULES:
        plain = F.regexp_replace(plain, "(?U)" + rule.pattern, rule.label)
    assert df.select(mask_text(F.col("t")).alias("a"), plain.alias("b")).filter("NOT a <=> b").count() == 0


def test_long_runs_stay_linear(spark):
    import time
    start = time.time()
    text = "a" * 2_000_000
    assert _one(spark, text, "string", F.length(F.regexp_replace("v", EMAIL_LINEAR, ""))) == 2_000_000
    assert _one(spark, "/* " * 300_000, "string", F.length(normalise_sql(F.col("v")))) == 899_999
    assert time.time() - start < 20


GLOBS = [("/etc/x*", "/etc/xy", True), ("/etc/x*", "/etc/x/y", False), ("**/.env", "/a/b/.env", True),
         ("**/.env", ".env", False), (".env", "/a/.env", False), ("/d/", "/d", True), ("/d/", "/d/e/f", True),
         ("/d/", "/de", False), ("/a?c", "/abc", True), ("/a?c", "/ac", False), ("/a.c", "/abc", False),
         ("/a[b]+(c)", "/a[b]+(c)", True), ("/x/**/y", "/x/1/2/y", True), ("/x*y*z", "/xaybz", True)]


@pytest.mark.parametrize("pattern, path, expected", GLOBS)
def test_globs(spark, pattern, path, expected):
    df = spark.createDataFrame([(pattern, path)], "p string, t string")
    assert df.select(glob_test(F.col("t"), pattern).alias("a")).first()["a"] is expected
    joined = df.withColumn("r", glob_regex(F.col("p"))).filter(F.expr("t rlike r")).count()
    assert (joined == 1) is expected


def test_many_rules_are_cut_into_steps(spark):
    rules = [PathRule(i, f"/p{i}", f"/p{i}", "block") for i in range(1, 451)] + [PathRule(451, "/p**", "/p**", "mask")]
    df = spark.createDataFrame([("/p7",), ("/p333",), ("/p450",), ("/pzz",), ("/q",)], "p string")
    got = [r[0] for r in df.select(first_rule(F.col("p"), rules)).collect()]
    assert got == [7, 333, 450, 451, None]


def test_paths(spark):
    cases = [("/a", None, "/a"), ("~/x", "/w", "/h/x"), ("~", "/w", "/w/~"), ("x", "/w/", "/w/x"), ("x", None, "x"),
             ("~//x", "/w", "/x")]
    df = spark.createDataFrame(cases, "t string, cwd string, want string")
    for r in df.withColumn("got", resolve_path(F.col("t"), F.col("cwd"), F.lit("/h"))).collect():
        assert r["got"] == r["want"], r
    assert _one(spark, "~/x", "string", expand_home(F.col("v"), F.lit("/h"))) == "/h/x"


def test_policy_text(spark):
    policy = policy_from_text(spark, "block T\nmask t a:partial:+7 B:email\n# c\nfblock ~/k\n", "/h")
    assert policy.table("T").mode == "mask"
    assert [tuple(c) for c in policy.table("t").columns] == [("a", "partial", 7), ("b", "email", None)]
    assert [r.expanded for r in policy.paths] == ["/h/k"]
    for bad in ("block", "deny x", "mask t a", "mask t a:x", "mask t a:partial:256", "block t a:partial:"):
        with pytest.raises(ValueError):
            policy_from_text(spark, "fblock /x\n" + bad)


def test_mask_table(spark):
    policy = policy_from_text(spark, "mask t A:phone n:partial:1\nblock b")
    df = spark.createDataFrame([("12345678", None, 5)], "a string, n string, k int")
    assert tuple(mask_table(df, "T", policy).first()) == ("***-**-5678", None, 5)
    with pytest.raises(PermissionError):
        mask_table(df, "b", policy)
    with pytest.raises(ValueError):
        mask_partial(F.col("a"), 256)


def test_exec_events_round_trip(spark, tmp_path):
    rows = [("h", datetime(2024, 1, 1), 1, 2, b"git\0junk", b"/usr/bin/git\0\0"),
            ("h", datetime(2024, 1, 1), 3, 4, b"x" * 16, b"/bin/\xff\xfe"),
            ("h", datetime(2024, 1, 1), 5, 6, b"", b"/bin/ls")]
    df = spark.createDataFrame(rows, "host string, ts timestamp, pid long, uid long, comm binary, filename binary")
    df.write.parquet(str(tmp_path / "e"))
    got = decode_exec_events(read_exec_events(spark, str(tmp_path / "e")))
    assert {(r["pid"], r["comm"], r["filename"]) for r in got.collect()} == {
        (1, "git", "/usr/bin/git"), (3, "x" * 16, ""), (5, "", "/bin/ls")}
    assert [r["pid"] for r in watchlist_filter(got).collect()] == [1]
    got.write.parquet(str(tmp_path / "d"))
    plan = watchlist_filter(spark.read.parquet(str(tmp_path / "d")))
    text = plan._jdf.queryExecution().toString()
    assert "PushedFilters: [In(basename" in text


def test_reports_append_by_day(spark, tmp_path):
    path = str(tmp_path / "r")
    df = spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS ts, 'BLOCKED' AS kind, date'2024-01-01' AS report_date")
    write_reports(df, path)
    write_reports(df, path)
    assert spark.read.parquet(path).count() == 2
    assert (tmp_path / "r" / "report_date=2024-01-01").is_dir()


def test_markers_in_values_stay(spark):
    df = spark.createDataFrame([("<first> %1$s <list>", ["a<n>b"])], "subject string, details array<string>")
    what = block(threat("FS_POLICY_BLOCK", "cat", F.col("subject"), F.col("details")))["threat"]
    assert df.select(threat_message(what).alias("m")).first()["m"] == (
        "[FS_POLICY_BLOCK] cat: access to '<first> %1$s <list>' is blocked "
        "(matches protected pattern 'a<n>b').")
