"""Process identities valid in time: which process a pid was at the moment of an event.

Between two snapshots of a host a pid may end and be given to another process.  What is recorded, the
snapshot's rows and every execution with its parent, says for each pid and interval of time which parent
it had; a pid whose parent changes is another process and no root any more.  Such intervals
(*incarnations*) never reach over a snapshot, so everything is keyed by ``(host, snapshot_ts, pid)`` and
only the few intervals of one pid between two snapshots are compared by time.

The test of descent is pointer doubling as in ``lineage.descendants``, over intervals: a step meets the
intervals of the process above and keeps the common time, so every node of a chain is looked up at the
event's own time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwatch.operators.joins import SALTS, salted_join
from veilwatch.operators.lineage import SNAPSHOT, flag_roots
from veilwatch.rules.registry import MAX_LINEAGE_NODES
from veilwatch.session import cut_lineage

KEY = [*SNAPSHOT, "pid"]
#: Where an interval ends that nothing ends.
FOREVER = "9999-12-31 23:59:59"


def _changes(facts: DataFrame, within: list) -> DataFrame:
    """The facts of each group in order of time whose parent is not that of the fact before, and the first."""
    order = Window.partitionBy(*within).orderBy("since", "executed")
    moved = F.lag("ppid").over(order).isNull() | (F.lag("ppid").over(order) != F.col("ppid"))
    return facts.withColumn("_moved", moved).filter("_moved").drop("_moved")


def recorded_facts(placed: DataFrame, procs: DataFrame, listed_stay: bool = True) -> DataFrame:
    """``KEY``, ``since``, ``executed``, ``ppid``, ``is_root``: who a pid's parent is from a moment on.

    ``placed`` holds executions with ``snapshot_ts`` attached.  A pid that the snapshot lists keeps its
    process up to the next one; with ``listed_stay`` false an execution below another parent ends it, for
    logs whose recorded parents are surer than the age of a snapshot.  Facts that repeat the one before
    are left out, first within a minute and then within the time of a snapshot, so a pid that runs program
    after program is a few rows.  Of several parents recorded at one moment the smallest counts.
    """
    used = placed.select(*SNAPSHOT).filter("snapshot_ts is not null").distinct()
    marked = procs if "is_root" in procs.columns else flag_roots(procs)
    listed = (marked.join(used, SNAPSHOT, "left_semi").groupBy(*KEY)
              .agg(F.min("ppid").alias("ppid"), F.max("is_root").alias("is_root"))
              .select(*KEY, F.col("snapshot_ts").alias("since"), F.lit(0).alias("executed"), "ppid", "is_root"))
    ran = placed.filter("snapshot_ts is not null and ppid is not null and pid is not null")
    if listed_stay:
        ran = ran.join(listed.select(*KEY), KEY, "left_anti")
    ran = (ran.groupBy(*KEY, F.col("ts").alias("since")).agg(F.min("ppid").alias("ppid"))
           .select(*KEY, "since", F.lit(1).alias("executed"), "ppid", F.lit(False).alias("is_root")))
    ran = _changes(ran, [*KEY, F.date_trunc("minute", "since")])
    return _changes(listed.unionByName(ran), KEY)


def incarnations(facts: DataFrame) -> DataFrame:
    """``KEY``, ``since``, ``until``, ``ppid``, ``is_root``: every pid's processes one after the other.

    The last one before a snapshot lasts up to that snapshot; events are placed by snapshot, so it needs
    no end of its own.
    """
    order = Window.partitionBy(*KEY).orderBy("since", "executed")
    ends = F.coalesce(F.lead("since").over(order), F.lit(FOREVER).cast("timestamp"))
    # a process that another replaces at the moment it was listed never was
    return facts.withColumn("until", ends).filter("since < until").select(
        *KEY, "since", "until", "ppid", "is_root")


def _meeting(below: DataFrame, above: DataFrame) -> DataFrame:
    """Every interval of ``below`` beside those of its process above (``up``) that share a time with it.

    The intervals of one process do not overlap, so in order of time those that meet an interval stand
    one after the other, and two running counts say from which to which.  They are joined by their number:
    a pid with many intervals is no square of them, only what meets is made.
    """
    group = [*SNAPSHOT, "up"]
    numbered = above.withColumn("_nth", F.row_number().over(Window.partitionBy(*group).orderBy("_since")))
    mine = F.struct("pid", "since", "until")
    marks = below.select(*group, F.col("since").alias("_a"), F.col("until").alias("_b"), F.lit(0).alias("_above"),
                         mine.alias("_mine")).unionByName(
        above.select(*group, F.col("_since").alias("_a"), F.col("_since").alias("_b"), F.lit(1).alias("_above")),
        allowMissingColumns=True)
    upto = lambda *by: F.sum("_above").over(
        Window.partitionBy(*group).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    ranges = marks.withColumns({"_first": upto("_a", F.desc("_above")), "_last": upto("_b", "_above")})
    first = F.greatest("_first", F.lit(1).cast("bigint"))
    ranges = ranges.filter((F.col("_above") == 0) & (first <= F.col("_last"))).select(
        *group, "_mine.*", F.explode(F.sequence(first.cast("int"), F.col("_last").cast("int"))).alias("_nth"))
    return ranges.join(numbered, [*group, "_nth"]).filter("_since < until and since < _until").drop("_nth")


def _met(below: DataFrame, above: DataFrame, several: bool) -> DataFrame:
    """``_meeting`` with ``alone`` of the result.  A process above with a single interval meets every row below
    once, so it needs no running counts; ``several`` says that there are others."""
    group = [*SNAPSHOT, "up"]
    met = below.join(above.filter("_alone"), group).filter("_since < until and since < _until")
    if several:
        rest = above.filter("not _alone")
        met = met.unionByName(_meeting(below.join(rest.select(*group).distinct(), group, "left_semi").drop("alone"), rest)
                              .withColumn("alone", F.lit(False)))
    return met


def agent_intervals(lives: DataFrame, max_nodes: int = MAX_LINEAGE_NODES) -> DataFrame:
    """``KEY``, ``since``, ``until``: when a pid was a root or had one among its nearest
    ``max_nodes - 1`` ancestors, all of them as they were at that time.

    Snapshots without a root never enter; intervals below a root leave once found, those whose chain ended
    are dropped, and a round writes only what is still open.
    """
    rounds = max_nodes.bit_length() - 1
    if 1 << rounds != max_nodes:
        raise ValueError("max_nodes must be a power of two")
    watched = lives.filter("is_root").select(*SNAPSHOT).distinct()
    ends = F.col("is_root") | (F.col("pid") <= 1) | (F.col("ppid") == F.col("pid"))
    # whether a row is the only one of its pid; what a row becomes in a round is one row again if both sides are
    alone = F.count("*").over(Window.partitionBy(*KEY)) == 1
    state = lives.withColumn("alone", alone).join(watched, SNAPSHOT, "left_semi").select(
        *KEY, "since", "until", "alone", F.col("is_root").alias("hit"), F.when(ends, None).otherwise(F.col("ppid")).alias("up"))
    state = cut_lineage(state.filter("hit or up is not null"))
    several = not state.filter("not alone").isEmpty()
    hits, still_open = state.filter("hit").drop("up"), state.filter("not hit").drop("hit")
    for left in reversed(range(rounds)):
        above = hits.withColumn("up", F.lit(None).cast("bigint")).unionByName(
            still_open.withColumn("hit", F.lit(False))).select(
            *SNAPSHOT, F.col("pid").alias("up"), F.col("hit").alias("_hit"), F.col("up").alias("_up"),
            F.col("since").alias("_since"), F.col("until").alias("_until"), F.col("alone").alias("_alone"))
        if not left:  # what is still open after the last round counts for nothing
            above = above.filter("_hit")
        met = _met(still_open, above, several).filter("_hit or _up is not null")
        met = cut_lineage(met.select(*KEY, F.greatest("since", "_since").alias("since"),
                                     F.least("until", "_until").alias("until"), "alone",
                                     F.col("_hit").alias("hit"), F.col("_up").alias("up")))
        hits = hits.unionByName(met.filter("hit").drop("up"))
        still_open = met.filter("not hit").drop("hit")
        if left and still_open.isEmpty():
            break
    return hits.select(*KEY, "since", "until")


def events_of_agents(placed: DataFrame, intervals: DataFrame, salts: int = SALTS) -> DataFrame:
    """The placed executions whose pid belonged to an agent at their time.

    One pid may run a large share of all programs, so the join is salted; intervals of one pid do not
    overlap, so an event meets one at most.
    """
    met = salted_join(placed.withColumnRenamed("ts", "_ts"), intervals, KEY, "inner", ["event_id"], salts)
    return met.filter("_ts >= since and _ts < until").drop("since", "until").withColumnRenamed("_ts", "ts")
