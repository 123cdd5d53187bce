"""Token counts from a digest cache.

Every text has a content digest (SHA-256 of its normalised content) and every tokenizer a version digest
(SHA-256 of its library's name and version, its settings and its file).  Counts are stored under the two.
A run joins its distinct digests to the stored counts, encodes one text of each distinct miss and appends
the new counts, so a text is encoded once whatever number of copies, runs or tables hold it.

Digests move, texts only where they must: copies meet inside a task before one of them is sent, and when
few digests are missing only those texts are sent at all.  Digests with very many copies take their count
from a list of at most ``HOT`` rows; the others join by digest.

The cache is a folder of Parquet files, partitioned by tokenizer.  Runs only append to it: a task that
fails is written once, a run that fails leaves nothing behind but its finished cache files, two runs at
once may store the same count twice, and readers take each digest once.

Defined results: a null text counts as empty; repeated rows are counted once and returned each; a null or
repeated doc_id is carried as it is; an empty table gives an empty result and appends nothing; extra
columns are not carried.  Very long texts are encoded whole, cut only before a blank where no vocabulary
entry can reach over the cut, so the count is that of the whole text; a run of a text without such a
blank is encoded in one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwatch.llm.common import field, pack_row, settled, ship_code

#: A text with more tokens is over the limit.
LIMIT = 4096
#: Characters of a piece of a long text.
PIECE = 1 << 18
#: Missing digests up to this number are broadcast (32 bytes each); more are met by a join.
FEW = 100_000
#: Digests that hold more than one row in this many are hot: there are fewer than ``HOT`` of them.
HOT = 10_000
_CACHE = "digest binary, n_tokens long, tokenizer string"


@cache
def _sentencepiece(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _cuttable(path: str) -> bool:
    """No entry of the vocabulary holds a blank after another character."""
    model = _sentencepiece(path)
    return not any("▁" in model.id_to_piece(k).lstrip("▁") for k in range(model.get_piece_size()))


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text cut before single blanks, which the model puts back at the start of each piece."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut > 0 and (text[cut - 1] in " ▁" or cut + 1 == len(text)):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def count_texts(texts: list[str], path: str, size: int = PIECE) -> list[int]:
    """Tokens per text as the library of the file counts them, without added tokens."""
    if path.endswith(".model"):
        model = _sentencepiece(path)
        if max(map(len, texts), default=0) <= size or not _cuttable(path):
            return [len(ids) for ids in model.encode(texts, num_threads=1)]
        return [sum(len(model.encode(part, num_threads=1)) for part in pieces(t, size)) for t in texts]
    return [len(found.ids) for found in _tokenizer(path).encode_batch(texts, add_special_tokens=False)]


def version_digest(path: str) -> str:
    """What the counts depend on besides the text: the file, the library and its version."""
    from importlib.metadata import version

    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as file:
        content = hashlib.sha256(file.read()).hexdigest()
    return hashlib.sha256(f"{library} {version(library)} plain {content}".encode()).hexdigest()


def whole_text(text: Column) -> Column:
    """The normalisation that keeps every count: a null text is an empty one."""
    return F.coalesce(text, F.lit(""))


def stored(spark, cache_path: str, tokenizer: str) -> DataFrame:
    """``digest``, ``n_tokens`` of one tokenizer version; an absent cache is an empty one."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], _CACHE).drop("tokenizer")
    found = spark.read.schema(_CACHE).parquet(cache_path).where(F.col("tokenizer") == tokenizer)
    return found.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _encoded(texts: DataFrame, path: str) -> DataFrame:
    """``digest``, ``n_tokens`` of rows ``digest``, ``text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts = count_texts(part.column(1).to_pylist(), path)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.array(counts, np.int64))], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def counts(docs: DataFrame, path: str, cache_path: str, limit: int = LIMIT,
           normalise: Callable[[Column], Column] = whole_text, few: int = FEW, hot: int = HOT) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``.

    ``normalise`` must keep the number of tokens of every text; texts equal after it share a count.
    """
    spark = docs.sparkSession
    ship_code(spark)
    df = pack_row(docs)
    text = field(df, "text", "string")
    source = df.select(field(df, "doc_id", "long").alias("doc_id"), text.alias("own"),
                       normalise(text).alias("text"))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    narrow = settled(source.select("doc_id", F.coalesce(F.octet_length("own"), F.lit(0)).cast(
        "long").alias("n_bytes"), digest))
    version = version_digest(path)
    known = settled(narrow.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).join(
        stored(spark, cache_path, version), "digest", "left"))
    rows, missing = known.agg(F.sum("copies"), F.count_if(F.col("n_tokens").isNull())).first()
    found = known.where(F.col("n_tokens").isNotNull())
    if missing:
        misses = known.where(F.col("n_tokens").isNull()).select("digest", "copies")
        texts = source.select(digest, "text")
        if missing <= few:
            texts = texts.join(F.broadcast(misses.select("digest")), "digest", "left_semi")
        one = texts.groupBy("digest").agg(F.first("text").alias("text"))
        if missing > few:  # both sides lie by digest already
            one = one.join(misses.select("digest").hint("merge"), "digest", "left_semi")
        new = settled(_encoded(one, path))
        new.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(
            cache_path)
        found = found.unionByName(misses.join(new, "digest"))
    many = F.col("copies") > max(1, (rows or 0) // hot)
    few_rows = found.where(many).select("digest", "n_tokens")
    told = narrow.join(F.broadcast(few_rows.withColumnRenamed("n_tokens", "of_hot")), "digest", "left")
    rest = found.where(~many).select("digest", "n_tokens")
    done = told.where(F.col("of_hot").isNotNull()).select(
        "doc_id", "n_bytes", F.col("of_hot").alias("n_tokens"))
    joined = told.where(F.col("of_hot").isNull()).join(rest, "digest").select("doc_id", "n_bytes", "n_tokens")
    return done.unionByName(joined).withColumn("over_limit", F.col("n_tokens") > limit)
