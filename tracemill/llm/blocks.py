"""Blocks of documents that ask shards of a hash space, and get bits or numbers back.

A statistic of every window or word of a corpus is too large to hold or broadcast.
Here documents are dealt into blocks of bounded size by a hash.  A block sorts its
keys and sends each shard of the key space one packed row; the shard merges what
all blocks sent and answers in the order of the keys it got, so an answer of one
bit a key needs no key.  Orders are those of sorted distinct keys, so a lost task
that runs again sends and reads the same.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.textnum import U64

#: bytes of text in a block; a longer text is a block with what else its hash brings
BLOCK_BYTES = 6_000_000


def pow2(n: float) -> int:
    """The smallest power of two that is not below ``n``, as an exponent."""
    return max(0, int(np.ceil(np.log2(max(1.0, n)))))


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0))).first()[0]


def dealt(docs: DataFrame, key: str, text: str, total: int) -> DataFrame:
    """``docs`` as (block, row); rows of one key and text share a block, keys alone don't choose it."""
    n = max(1, -(-total // BLOCK_BYTES))
    block = F.pmod(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")), F.lit(n)).cast("int")
    return docs.select(block.alias("block"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def pack(values: np.ndarray) -> bytes:
    """Numbers, compressed byte plane by byte plane."""
    wide = np.ascontiguousarray(values)
    planes = wide.view(np.uint8).reshape(len(wide), wide.itemsize).T if len(wide) else np.zeros((1, 0), np.uint8)
    return len(wide).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[8:], n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind)[:, 0]


def bits(flags: np.ndarray) -> bytes:
    return pack(np.packbits(flags))


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(unpack(data, np.uint8), count=n).astype(bool)


def cut_shards(keys: np.ndarray, key_bits: int, shard_bits: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) of sorted keys of ``key_bits`` bits, for shards of their top bits."""
    if not len(keys):
        return []
    shard = (keys >> U64(key_bits - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(keys), np.int64)
    edges = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
    return [(int(shard[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the cluster names; on this machine alone any will do."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate results, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, and read from there.

    Spark removes the files of checkpoints that are no longer in use where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()
