"""Blocks of tokens and sharded count joins, shared by the two language models.

Texts are worked in blocks of some ten thousand documents or two million tokens.  A block asks for the
corpus-wide counts of its distinct n-grams: its sorted keys go to their shards (by the hash of the key)
as one compact binary per shard, the shard adds up what all blocks sent and answers every block in the
order of its keys.  An n-gram that holds a third of all tokens is one key per block, so no shard grows
with a hot n-gram, and the number of shards follows the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext

#: Tokens of a block; a block ends with a whole document.
BLOCK_TOKENS = 2_000_000
#: Tokens of the corpus per shard.
SHARD_TOKENS = 1_000_000
END_HASH = np.uint64(xxhash.xxh64_intdigest(b"\n"))  # no word holds a line break


def shard_bits(tokens: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, tokens) / SHARD_TOKENS))))


def pack_planes(values: np.ndarray) -> bytes:
    """Unsigned numbers byte plane by byte plane, without the planes that are all zero."""
    values = np.ascontiguousarray(values, "<u8")
    planes = values.view(np.uint8).reshape(-1, 8).T
    used = max([1, *(k + 1 for k in range(8) if planes[k].any())]) if len(values) else 1
    return len(values).to_bytes(8, "little") + bytes([used]) + planes[:used].tobytes()


def unpack_planes(blob: bytes) -> np.ndarray:
    n, used = int.from_bytes(blob[:8], "little"), blob[8]
    out = np.zeros((n, 8), np.uint8)
    out[:, :used] = np.frombuffer(blob, np.uint8, n * used, 9).reshape(used, n).T
    return out.view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack_planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_planes(blob), dtype=np.uint64)


@dataclass
class Words:
    """The words of a block: distinct hashes, per word its number among them, words per document."""

    hashes: np.ndarray
    ids: np.ndarray
    lens: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes | None]) -> Words:
        words = [(t or b"").lower().split() for t in texts]  # of bytes: A-Z, ASCII white space
        lens = np.fromiter(map(len, words), np.int64, len(words))
        flat = pa.array(chain.from_iterable(words), pa.large_binary(), size=int(lens.sum()))
        coded = flat.dictionary_encode()
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64,
                             len(coded.dictionary))
        return cls(hashes, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), lens)


def blocks(batch: pa.RecordBatch, text: str, size: int | None = None) -> Iterator[tuple[slice, Words]]:
    """The documents of an Arrow batch as blocks; only one block's texts are Python objects at a time."""
    texts = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
    words = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum() // 6  # about
    at = 0
    while at < len(texts):
        limit = (words[at - 1] if at else 0) + (size or BLOCK_TOKENS)
        end = max(at + 1, int(np.searchsorted(words, limit, side="right")))
        yield slice(at, end), Words.of(texts.slice(at, end - at).to_pylist())
        at = end


def next_block(counter: Iterator[int]) -> int:
    return (TaskContext.get().partitionId() << 32) + next(counter)


def per_document(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``sizes`` values, each of one or more."""
    return np.add.reduceat(values, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)
