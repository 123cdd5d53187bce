"""Conversation structure repair: generalised LR repair over the role grammar.

Rows of a conversation in order are kept, reroled, deleted, or get rows inserted beside them, so that the
initials of their roles read ``(s?(ua)+)?`` at least cost; of equally cheap repairs the one whose edits
read least in ASCII is taken.  ``role_grammar`` holds the parser.  Blank and repeated rows must go; a row
that is kept with its text cut off costs one more.

Long conversations are cut into segments of at most ``SEGMENT`` rows.  A segment tells, for every stack it
may be entered with, at which cost and audit rank it leaves with which; a pass over the segments of a
conversation picks the best way through, and every segment then names its own edits.  So no task holds a
conversation: what goes through one task per conversation is a few hundred bytes per segment.  Equal rows
are one row with a number of copies from the start, and the first of equal texts is found by grouping and
a join on row numbers, so neither hot turns nor hot texts meet in a task.

Defined results: rows are ordered by turn (null first), then role, then text (by their first characters
first); rows without a conv_id are one conversation; a null or empty role, and any that starts with none
of s, u, a, fits nowhere and is reroled or deleted; a null text is blank; copies of a row follow it and
are repeats; an empty table gives no row; texts of any length are carried whole; extra columns are not
carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwatch.llm import role_grammar as G
from veilwatch.llm.common import field, pack_row, settled, ship_code

#: Rows of a segment, as a power of two.
SEGMENT_BITS = 11
#: White space of a text, and what a finished text ends with.
SPACE, STOPS = " \t\n\x0b\f\r", ".!?"
#: First characters of role and text by which rows of one turn are dealt to tasks.
ROLE_START, TEXT_START = 16, 64


def numbered(conversations: DataFrame) -> DataFrame:
    """The distinct rows with ``c`` (key of the conversation), ``copies`` and a number ``i`` that orders them."""
    df = pack_row(conversations)
    rows = df.select(field(df, "conv_id", "long").alias("conv_id"), field(df, "turn", "long").alias("turn"),
                     field(df, "role", "string").alias("role"), field(df, "text", "string").alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    starts = [F.substring("role", 1, ROLE_START), F.substring("text", 1, TEXT_START)]
    order = ["conv_id", "turn", *starts]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "role", "text")
    return settled(rows.select("*", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"),
                               F.monotonically_increasing_id().alias("i")))


def faults(rows: DataFrame) -> DataFrame:
    """Per row number its first fault (of the first copy): blank, duplicate, truncated or empty."""
    body = F.rtrim(F.coalesce("text", F.lit("")), F.lit(SPACE))
    marks = rows.select("c", "i", "turn", "copies", "role", F.sha2("text", 256).alias("digest"),
                        F.substring("role", 1, 1).alias("start"), (body == "").alias("blank"),
                        (~F.right(body, F.lit(1)).isin(*STOPS)).alias("cut"))
    firsts = marks.groupBy("c", "role", "digest").agg(F.min("i").alias("i")).select("i", F.lit(True).alias("first"))
    fault = (F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate")
             .when(F.col("cut"), "truncated").otherwise(""))
    kind = F.lit(len(G.KINDS))
    for k, start in enumerate(G.KINDS):
        kind = F.when(F.col("start") == start, k).otherwise(kind)
    state = F.when(F.col("fault").isin("blank", "duplicate"), G.MUST_GO).when(
        F.col("fault") == "truncated", G.TRUNCATED).otherwise(G.FINE)
    return marks.join(firsts, "i", "left").withColumn("fault", fault).select(
        "c", "i", "turn", "copies", "fault", (kind * 3 + state).cast("int").alias("code"))


def segments(marks: DataFrame, bits: int = SEGMENT_BITS) -> DataFrame:
    """One row per conversation and segment: its rows' numbers, codes and copies in order."""
    rows = F.sort_array(F.collect_list(F.struct("i", "code", "copies")))
    return marks.groupBy("c", F.shiftright("i", bits).alias("seg")).agg(rows.alias("rows")).select(
        "c", "seg", F.col("rows.i").alias("i"), F.col("rows.code").alias("codes"),
        F.aggregate("rows.copies", F.lit(0).cast("long"), lambda s, n: s + n - 1).alias("more"))


_PAIRS = {("s", "u"), ("u", "a"), ("a", "u")}


def _kind(code: int) -> str:
    return (G.KINDS + "-")[code // 3]


def _ways(pieces: DataFrame) -> DataFrame:
    """Per segment its ways (before, after, cost, rank; flat), bad neighbours and outer kinds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [tuple(c) for c in batch.column(2).to_pylist()]
            more = batch.column(3).to_pylist()
            ways = [list(chain.from_iterable((e, x, cost + G.COSTS[G.DELETE] * n, rank)
                                             for e, x, cost, rank in G.transfer(c)))
                    for c, n in zip(codes, more)]
            kinds = [[_kind(k) for k in c] for c in codes]
            bad = [n + sum(p not in _PAIRS for p in zip(k, k[1:])) for k, n in zip(kinds, more)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ways, pa.list_(pa.int64())),
                 pa.array(bad, pa.int64()), pa.array([k[0] for k in kinds], pa.string()),
                 pa.array([k[-1] for k in kinds], pa.string())],
                names=["c", "seg", "ways", "illegal", "head", "tail"])

    return pieces.select("c", "seg", "codes", "more").mapInArrow(
        run, "c string, seg long, ways array<long>, illegal long, head string, tail string")


class _Chain:
    """The best way through the segments of one conversation."""

    def __init__(self):
        self.live = (G.Live(0, 0, 0),)
        self.shared, self.illegal, self.tail, self.backs = 0, 0, "", []

    def add(self, seg: int, ways: list[int], illegal: int, head: str, tail: str) -> None:
        place = {s.node: k for k, s in enumerate(self.live)}
        found = {}
        for at in range(0, len(ways), 4):
            before, after, cost, rank = ways[at:at + 4]
            if before in place:
                s = self.live[place[before]]
                value = (s.cost + cost, s.rank, rank, place[before])
                found[after] = min(found.get(after, value), value)
        least = min(v[0] for v in found.values())
        ranks = {r: k for k, r in enumerate(sorted({v[1:3] for v in found.values()}))}
        self.backs.append((seg, {n: self.live[v[3]].node for n, v in found.items()}))
        self.live = tuple(G.Live(n, v[0] - least, ranks[v[1:3]]) for n, v in sorted(found.items()))
        self.shared += least
        self.illegal += illegal + bool(self.tail and (self.tail, head) not in _PAIRS)
        self.tail = tail

    def chosen(self) -> list[tuple]:
        """Per segment: its number, stack before and after, roles inserted at the end; last: cost, illegal."""
        cost, k, roles = G.automaton().last(self.live)
        node, out = self.live[k].node, []
        for seg, back in reversed(self.backs):
            out.append((seg, back[node], node, "", None, None))
            node = back[node]
        seg, before, after, *_ = out[0]
        out[0] = (seg, before, after, roles, self.shared + cost, self.illegal)
        return out


def _choices(ways: DataFrame) -> DataFrame:
    """Per segment the way taken; the last one of a conversation has its cost and bad neighbours."""
    names = ["c", "seg", "before", "after", "inserted", "cost", "illegal"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, way, rows = None, _Chain(), []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for c, *piece in zip(*(col.to_pylist() for col in batch.columns)):
                if c != now and now is not None:
                    rows += [(now, *r) for r in way.chosen()]
                    way = _Chain()
                    if len(rows) >= 10_000:
                        yield out()
                        rows = []
                now = c
                way.add(*piece)
        if now is not None:
            rows += [(now, *r) for r in way.chosen()]
        if rows:
            yield out()

    lines = ways.repartition("c").sortWithinPartitions("c", "seg").select(
        "c", "seg", "ways", "illegal", "head", "tail")
    return lines.mapInArrow(run, "c string, seg long, before long, after long, inserted string, cost long, "
                                 "illegal long")


def _edits(pieces: DataFrame, choices: DataFrame) -> DataFrame:
    """Per row number the letters of its edits and the roles given by them (``-``: its own or none)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, roles, own = [], [], []
            for ids, codes, before, after, inserted in zip(*(c.to_pylist() for c in batch.columns)):
                found = G.edits(tuple(codes), before, after)
                letters += [e[0] for e in found]
                roles += [e[1] for e in found]
                own += ids
                letters[-1] += "|" + G.INSERT * len(inserted)
                roles[-1] += "|" + inserted
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int64()), pa.array(letters, pa.string()), pa.array(roles, pa.string())],
                names=["i", "letters", "roles"])

    both = pieces.join(choices.select("c", "seg", "before", "after", "inserted"), ["c", "seg"])
    found = both.select("i", "codes", "before", "after", "inserted").mapInArrow(
        run, "i long, letters string, roles string")
    parts = [F.split(n, "\\|") for n in ("letters", "roles")]
    return found.select("i", *[F.coalesce(F.try_element_at(p, F.lit(k + 1)), F.lit("")).alias(f"{n}_{w}")
                               for p, n in zip(parts, ("letters", "roles"))
                               for k, w in enumerate(("at", "behind"))])


def repair(conversations: DataFrame, bits: int = SEGMENT_BITS) -> tuple[DataFrame, DataFrame]:
    """The repaired rows and a report per conversation.

    Rows: ``conv_id``, ``place``, ``step`` (their order), ``turn``, ``role``, ``text``, ``fault``, ``edit``
    (K, R, D, I) and ``copies``; deleted rows are among them.  Report: ``conv_id``, ``gaps``, ``blank``,
    ``duplicate``, ``truncated``, ``illegal``, ``cost`` and ``audit``.
    """
    ship_code(conversations.sparkSession)
    rows = numbered(conversations)
    marks = settled(faults(rows))
    pieces = settled(segments(marks, bits))
    choices = settled(_choices(_ways(pieces)))
    done = settled(rows.drop("copies").join(marks.drop("c", "turn", "code"), "i").join(
        _edits(pieces, choices), "i"))
    return _turns(done), _report(marks, choices, done, bits)


def _turns(done: DataFrame) -> DataFrame:
    letters = F.split(F.concat("letters_at", "letters_behind"), "")
    roles = F.split(F.concat("roles_at", "roles_behind"), "")
    steps = F.posexplode(F.arrays_zip(letters.alias("edit"), roles.alias("given")))
    rows = done.select("conv_id", "i", "turn", "role", "text", "fault", "copies", steps.alias("step", "e"))
    inserted = F.col("e.edit") == G.INSERT
    given = F.when(F.col("e.given") == "u", "user").when(F.col("e.given") == "a", "assistant")
    return rows.where(F.col("e.edit") != "").select(
        "conv_id", F.col("i").alias("place"), "step", F.when(~inserted, F.col("turn")).alias("turn"),
        F.coalesce(given, "role").alias("role"), F.when(inserted, "").otherwise(F.col("text")).alias("text"),
        F.when(~inserted, F.col("fault")).alias("fault"), F.col("e.edit").alias("edit"),
        F.when(inserted, 1).otherwise(F.col("copies")).alias("copies"))


def _report(marks: DataFrame, choices: DataFrame, done: DataFrame, bits: int) -> DataFrame:
    again = F.col("copies") - 1
    wide = "decimal(38,0)"
    counts = marks.groupBy("c").agg(
        F.sum(F.when(F.col("fault") == "blank", F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == "blank", 0).when(F.col("fault") == "duplicate", F.col("copies"))
              .otherwise(again)).alias("duplicate"),
        F.count_if(F.col("fault") == "truncated").alias("truncated"),
        F.max("turn").cast(wide).alias("most"), F.min("turn").cast(wide).alias("least"))
    distinct = marks.select("c", "turn").distinct().groupBy("c").agg(F.count("turn").alias("turns"))
    gaps = F.coalesce((F.col("most") - F.col("least") + 1 - F.col("turns")).try_cast("long"),
                      F.when(F.col("most").isNull(), 0)).alias("gaps")
    total = choices.where("cost IS NOT NULL").select("c", "cost", "illegal")
    letters = F.concat("letters_at", F.repeat(F.lit(G.DELETE), (F.col("copies") - 1).cast("int")),
                       "letters_behind")
    by_segment = done.groupBy("c", "conv_id", F.shiftright("i", bits).alias("seg")).agg(
        F.sort_array(F.collect_list(F.struct("i", letters.alias("a")))).alias("t")).select(
        "c", "conv_id", F.struct("seg", F.array_join("t.a", "").alias("a")).alias("t"))
    audits = by_segment.groupBy("c", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "c", "conv_id", F.array_join("t.a", "").alias("audit"))
    return counts.join(distinct, "c").join(total, "c").join(audits, "c").select(
        "conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit")
