"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwatch.llm import (
    chat,
    decontaminate,
    kneser_ney,
    licences,
    line_dedup,
    lm_score,
    packing,
    quality_rules,
    repair,
    sharding,
    simhash,
    token_counts,
    whitening,
)
from veilwatch.llm.common import documents, settled, shared_folder


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(documents(spark, sf_dir),
                              spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(documents(spark, sf_dir)).drop("k1", "k2")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir)).select(
        "doc_id", "text", "n_lines", "n_removed")


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(documents(spark, sf_dir),
                               spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), packing.public_tokenizer()).drop("loss")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


def _damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut off, repeated or given to the user by the hash of their place."""
    ids = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(ids[0], F.lit(":"), ids[1])) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))).alias("_")
    ).drop("_")


def _hashes(turns: DataFrame) -> DataFrame:
    """SHA-256 of a conversation's ``role:text`` lines, fed row by row in their order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, one, done = None, None, []
        for batch in batches:
            for conv, alone, role, text in zip(*(batch.column(k) for k in range(4))):
                key = (conv.as_py(), alone.as_py())
                if one is None or key != now:
                    if one is not None:
                        done.append((now[0], one.hexdigest()))
                    now, one = key, hashlib.sha256()
                else:
                    one.update(b"\n")
                one.update(role.as_py().encode() + b":")
                one.update(text.as_py().encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                    zip(*done), (pa.int64(), pa.string()))], names=["conv_id", "repaired_sha256"])
                done = []
        if one is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([one.hexdigest()])],
                                             names=["conv_id", "repaired_sha256"])

    kept = turns.where(F.col("edit") != "D").select(
        "conv_id", F.col("conv_id").isNull().alias("alone"), "role", "text", "place", "step")
    return kept.repartition("conv_id").sortWithinPartitions("conv_id", "place", "step").drop(
        "place", "step").mapInArrow(run, "conv_id long, repaired_sha256 string")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").cast("long"), "turn", "role", "text")
    turns, report = repair.repair(_damaged(rows))
    hashes = settled(_hashes(turns))
    out = rows.select("conv_id").distinct()
    for part in (settled(report), hashes):
        there = part.withColumnRenamed("conv_id", "own")
        out = out.join(there, F.col("conv_id").eqNullSafe(F.col("own")), "left").drop("own")
    zero = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    gaps = F.when(F.col("audit").isNotNull(), F.col("gaps")).otherwise(0)  # null where a long is too short
    return out.select("conv_id", gaps.alias("gaps"), *[F.coalesce(c, F.lit(0)).alias(c) for c in zero[1:]],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache folder is ``spark.veilwatch.tokenCache``; a run without it starts a cache of its own."""
    import public_tokenizers

    cache = spark.conf.get("spark.veilwatch.tokenCache", None)
    return token_counts.counts(
        documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"),
        cache or f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}")


QUERIES = {f.__name__: f for f in (
    op1_decontaminate, op2_lm_scoring, op3_quality_rules, op4_license_scans, op5_quality_classifier, op6_packing, op7_chat_formatting, op8_simhash,
    op9_line_dedup, op10_sharding, op11_conversation_repair, op12_embedding_whitening, op13_token_counts)}

OP9_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(lines) - 1)) AS pos, lines FROM l WHERE len(lines) >= 3),
k AS (SELECT doc_id, pos, lines[pos] AS a, lines[pos + 1] AS b, lines[pos + 2] AS c FROM w),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER
          (PARTITION BY a, b, c ORDER BY doc_id, pos) AS rn FROM k) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, pos + o AS pos FROM later, (SELECT unnest(range(0, 3)) AS o)),
cut AS (SELECT doc_id, list(pos) AS covered FROM gone GROUP BY doc_id)
SELECT d.doc_id,
  CASE WHEN c.covered IS NULL THEN d.text ELSE coalesce(array_to_string(list_filter(
    list_transform(l.lines, lambda x, i: CASE WHEN list_contains(c.covered, i) THEN NULL ELSE x END),
    lambda x: x IS NOT NULL), chr(10)), '') END AS text,
  coalesce(len(l.lines), 0) AS n_lines, coalesce(len(c.covered), 0) AS n_removed
FROM documents d JOIN l ON l.doc_id = d.doc_id LEFT JOIN cut c ON c.doc_id = d.doc_id
"""

OP7_SQL = """
WITH c AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn, role, text) AS turns
           FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations) GROUP BY conv_id),
whole AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY turns),
proper AS (SELECT DISTINCT turns[1:k] AS turns
           FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM whole))
SELECT conv_id, len(turns) AS n_turns, copies,
  array_to_string(list_transform(turns, lambda x: '<|im_start|>' || x.r || chr(10)
    || replace(replace(x.t, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>')
    || '<|im_end|>' || chr(10)), '') AS text
FROM whole WHERE turns NOT IN (SELECT turns FROM proper)
"""

ORACLES = {"op7_chat_formatting": OP7_SQL, "op9_line_dedup": OP9_SQL}
