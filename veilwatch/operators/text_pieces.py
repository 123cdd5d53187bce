"""Texts larger than a row: stored in pieces, masked as if they were whole.

A text is rows ``(text_id, piece, text)``; the texts in order of ``piece`` make it, cut anywhere, also inside a
secret.  Ids and numbers are not null and a pair is there once; a null text is empty.

Of the masking rules only two see more than a run of characters without white space.  The key-value rule may
have white space beside its ``=`` or ``:``; so a line break is a *safe place* when the nearest characters
around its white space are neither of the two, and no other match crosses it.  Pieces are cut at their first
and last safe place, and what lies between two of these, over the borders, is put together.  Only such a run,
a few lines as a rule, has to fit a row.

The private-key rule spans lines without bound.  A piece can open a block, close one, or both, so it is a
map from "in a block" to "in a block" of one of four kinds: keep, open, close or swap.  The state before a piece is
the last constant map's value, changed by the swaps since: prefix sums in two levels, as for line numbers.  The
texts are shuffled by groups of pieces, once before the states are known and once after; between groups go a few numbers
and what crosses their borders.  A block that never closes is none; that can only be the last one opened.  What follows a closed block stands beside its
label, so the two ends, up to their next safe place, are put together again before the last rules run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from veilwatch.functions.masking import mask_text
from veilwatch.operators.prefix import GROUP
from veilwatch.rules.text_rules import TEXT_RULES, java_pattern
from veilwatch.session import written

#: Characters of a piece where the library cuts texts itself.
PIECE = 1 << 20
_KEY, _PLACE = "text_id", ["text_id", "piece"]
#: A text's groups of pieces; the rows of each are worked on in one task.
_TASK = ["text_id", "_g"]

_AT = next(i for i, rule in enumerate(TEXT_RULES) if r"[\s\S]*?" in rule.pattern)
_BLOCK = TEXT_RULES[_AT]
_OPEN, _CLOSE = _BLOCK.pattern.split(r"[\s\S]*?")
_SAFE = r"[^\s=:][^\S\n]*+\n\s*+(?=[^\s=:])"


def _earlier(*within: str, by: str) -> WindowSpec:
    return Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)


def cut_texts(texts: DataFrame, size: int = PIECE) -> DataFrame:
    """Pieces of at most ``size`` characters of rows ``(text_id, text)`` that come whole."""
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return texts.select(_KEY, F.posexplode_outer(parts).alias("piece", "text")).select(
        _KEY, F.coalesce("piece", F.lit(0)).cast("bigint").alias("piece"), F.coalesce("text", F.lit("")).alias("text"))


def _units(rows: DataFrame) -> DataFrame:
    """Rows ``(_TASK, piece, text, glued, cut)`` as units ``(_TASK, unit, piece, text)``.

    ``glued`` says that a row goes on where the one before it ends, ``cut`` that it is cut at its safe places.  Units
    count from 0 within a task; unit 0 is what goes on from the task's first row, so it may belong to an
    earlier task.  Pieces get new numbers in the same order.
    """
    first = F.length(F.regexp_extract("text", f"(?Us)^.*?{_SAFE}", 0))
    last = F.length(F.regexp_extract("text", f"(?Us)^.*{_SAFE}", 0))
    own, zero = (~F.col("glued")).cast("bigint"), F.lit(0).cast("bigint")
    rows = rows.select(*_TASK, "piece", "text", own.alias("own"),
                       F.when(F.col("cut"), first).otherwise(0).alias("first"), F.when(F.col("cut"), last).otherwise(0).alias("last"))
    rows = rows.withColumn("unit", F.col("own") + F.coalesce(
        F.sum(F.col("own") + F.when(F.col("first") > 0, 2).otherwise(0)).over(_earlier(*_TASK, by="piece")), zero))
    part = lambda at, text: F.struct((F.col("unit") + at).alias("unit"), F.lit(at).alias("at"), text.alias("part"))
    text = F.col("text")
    head, tail = F.left(text, F.col("first")), F.substring(text, F.col("last") + 1, F.length(text))
    body = F.substring(text, F.col("first") + 1, F.col("last") - F.col("first"))
    parts = F.when(F.col("first") == 0, F.array(part(0, text))).when(
        F.col("first") == F.col("last"), F.array(part(0, head), part(2, tail))).otherwise(
        F.array(part(0, head), part(1, body), part(2, tail)))
    units = rows.select(*_TASK, "piece", F.explode(parts).alias("f")).groupBy(*_TASK, "f.unit").agg(
        F.sort_array(F.collect_list(F.struct("piece", F.col("f.at").alias("at"), F.col("f.part").alias("part")))).alias("parts"))
    start = F.get("parts", F.lit(0))
    return units.select(*_TASK, "unit", (start["piece"] * 3 + start["at"]).alias("piece"),
                        F.array_join("parts.part", "").alias("text"))


def _reglued(rows: DataFrame) -> DataFrame:
    """Rows cut at safe places, with what a border crosses put together: ``(_TASK, piece, text)``.

    What crosses the border of a task goes to the last task before it that something begins in; only this leaves
    its task.
    """
    units = _units(rows)
    earlier = _earlier(_KEY, by="_g")
    tops = units.groupBy(*_TASK).agg(F.max("unit").alias("top"), F.max(F.when(F.col("unit") == 0, F.col("text"))).alias("part"))
    tops = tops.withColumn("owner", F.coalesce(
        F.last(F.when(F.col("top") > 0, F.col("_g")), ignorenulls=True).over(earlier), F.first("_g").over(earlier)))
    passed = F.col("owner").isNotNull()
    none = lambda kind: F.lit(None).cast(kind)
    own = F.struct(F.col("_g").alias("to"), "top", passed.alias("passed"), none("bigint").alias("at"), none("string").alias("part"))
    given = F.struct(F.col("owner").alias("to"), none("bigint").alias("top"), none("boolean").alias("passed"), F.col("_g").alias("at"), "part")
    facts = tops.select(_KEY, F.explode(F.when(passed & F.col("part").isNotNull(), F.array(own, given)).otherwise(F.array(own))).alias("f"))
    more = F.sort_array(F.collect_list(F.when(F.col("f.at").isNotNull(), F.struct("f.at", "f.part"))))
    facts = facts.groupBy(_KEY, F.col("f.to").alias("_g")).agg(
        F.max("f.top").alias("top"), F.max("f.passed").alias("passed"),
        F.array_join(F.transform(more, lambda m: m["part"]), "").alias("more"))
    return units.join(facts.hint("shuffle_hash"), _TASK).filter("unit > 0 or not passed").select(
        *_TASK, "piece", F.when(F.col("unit") == F.col("top"), F.concat("text", "more")).otherwise(F.col("text")).alias("text"))


def _blocks_masked(text):
    return F.regexp_replace(text, java_pattern(_BLOCK), _BLOCK.label)


def _marked(chunks: DataFrame) -> DataFrame:
    """Chunks with what they do to blocks.

    ``outer``: the text as it is outside a block, blocks in it masked; ``inner``: the same of what follows the first
    end.  Both are null without a part of a marker, where the text is the one and nothing the other.
    """
    marked = F.contains("text", F.lit(_BLOCK.literal))
    rest = F.regexp_replace("text", f"(?Us)^.*?{_CLOSE}", "")
    rows = chunks.withColumns({
        "ends": marked & F.col("text").rlike(f"(?U){_CLOSE}"),
        "outer": F.when(marked, _blocks_masked(F.col("text"))), "inner": F.when(marked, _blocks_masked(rest))})
    opens = lambda col: F.coalesce(F.col(col).rlike(f"(?U){_OPEN}"), F.lit(False))
    return rows.select(
        *_TASK, "piece", "ends", "outer", "inner", F.when(F.col("outer").isNull(), F.col("text")).alias("text"),
        opens("outer").alias("from_outside"), (~F.col("ends") | opens("inner")).alias("from_inside"))


def _with_maps(rows: DataFrame, by: str, *within: str) -> DataFrame:
    """``swaps`` and ``moved`` of the maps before a row, from ``from_outside`` and ``from_inside`` of each:
    begun with state ``s``, the state at the row is ``moved``, else ``s``, plus ``swaps``, modulo 2."""
    before, zero = _earlier(*within, by=by), F.lit(0).cast("bigint")
    swap = (F.col("from_outside") & ~F.col("from_inside")).cast("bigint")
    fixed = F.when(F.col("from_outside") == F.col("from_inside"), F.col("from_outside").cast("bigint"))
    rows = rows.withColumn("swaps", F.coalesce(F.sum(swap).over(before), zero))
    return rows.withColumn("moved", F.last(fixed - F.col("swaps"), ignorenulls=True).over(before))


def _state(begun: Column) -> Column:
    return F.pmod(F.coalesce("moved", begun.cast("bigint")) + F.col("swaps"), F.lit(2)) == 1


def _begun(chunks: DataFrame) -> DataFrame:
    """``_TASK``, ``begun``, whether a task begins in a block, and ``loose``, where the text's last block opened that
    nothing closes, from what the tasks do to either state."""
    facts = []
    for k in (0, 1):
        inside = _state(F.lit(k))
        opens = F.when(inside, F.col("ends") & F.col("from_inside")).otherwise(F.col("from_outside"))
        after = F.when(inside, F.col("from_inside")).otherwise(F.col("from_outside"))
        facts += [F.max_by(after, F.col("piece")).alias("from_inside" if k else "from_outside"),
                  F.max(F.when(opens, F.col("piece"))).alias(f"opened{k}"),
                  F.max(F.when(inside & F.col("ends"), F.col("piece"))).alias(f"closed{k}")]
    tasks = _with_maps(chunks.groupBy(*_TASK).agg(*facts), "_g", _KEY).withColumn("begun", _state(F.lit(0)))
    whole = Window.partitionBy(_KEY)
    of = lambda what: F.max(F.when(F.col("begun"), F.col(f"{what}1")).otherwise(F.col(f"{what}0"))).over(whole)
    tasks = tasks.select(*_TASK, "begun", of("opened").alias("opened"), of("closed").alias("closed"))
    return tasks.select(*_TASK, "begun", F.when(F.col("closed").isNull() | (F.col("closed") <= F.col("opened")), F.col("opened")).alias("loose"))


def mask_pieces(pieces: DataFrame, group: int = GROUP) -> DataFrame:
    """Masked pieces ``(text_id, piece, text)``; joined in order of ``piece`` they are ``mask_text`` of the whole text."""
    piece = F.col("piece").cast("bigint")
    rows = pieces.select(_KEY, F.floor(piece / group).alias("_g"), piece.alias("piece"), F.coalesce("text", F.lit("")).alias("text"))
    # with the filter all readers of the pieces need the same rows, so that they share one shuffle of the texts
    rows = rows.filter("text_id is not null and _g is not null").repartition(*_TASK)
    chunks = _reglued(rows.withColumns({"glued": F.lit(True), "cut": F.lit(True)}))
    # written, so that the patterns run once; what was shuffled for it is gone before the next shuffle
    chunks = written(_marked(chunks.withColumn("text", mask_text(F.col("text"), TEXT_RULES[:_AT]))), lean=True)
    chunks = _with_maps(chunks.filter("text_id is not null and _g is not null").repartition(*_TASK), "piece", *_TASK)
    chunks = chunks.join(_begun(chunks).hint("shuffle_hash"), _TASK)
    inside = _state(F.col("begun"))
    opens = F.when(inside, F.col("ends") & F.col("from_inside")).otherwise(F.col("from_outside"))
    chunks = chunks.withColumns({
        "inside": inside & F.coalesce(F.col("piece") <= F.col("loose"), F.lit(True)),
        "opens": opens & ~F.col("piece").eqNullSafe(F.col("loose"))})
    inside, opens = F.col("inside"), F.col("opens")
    own = F.when(inside, F.coalesce("inner", "text")).otherwise(F.coalesce("outer", "text"))
    done = chunks.filter(~inside | F.col("ends")).select(
        *_TASK, "piece", inside.alias("glued"), (inside | opens).alias("cut"),
        F.when(opens, F.regexp_replace(own, f"(?Us){_OPEN}.*", _BLOCK.label)).otherwise(own).alias("text"))
    return written(_reglued(done), lean=True).select(*_PLACE, mask_text(F.col("text"), TEXT_RULES[_AT + 1:]).alias("text"))
