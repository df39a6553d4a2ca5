"""Token counts of documents in flat token files, by a separator scan.

A token file is a bare sequence of 16- or 32-bit ids; a document ends at the end-of-document id, and there is no
index. Files are cut into blocks, each block is searched for the separator at once, and a prefix scan over the
blocks' summaries stitches the documents that run over block ends.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, stored, with_prefix_sums

BLOCK_BYTES = 8 << 20
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SEPARATOR = 50256
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def write_token_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, separator: int = SEPARATOR) -> DataFrame:
    """Tokenise (doc_id, text) into flat uint16 files under `path`, a file for each partition, in its rows' order.

    Returns the sidecar (file, ordinal, doc_id). A file is written under another name and then renamed, so a
    task that is repeated leaves one whole file. Null texts have no tokens; ids may be null or repeat.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        name = f"part-{part:06d}.bin"
        # Names with a leading underscore are not listed by Spark's readers.
        own = f"{base}/_{name}.{TaskContext.get().taskAttemptId()}"
        encode, end, k = encoder(vocabulary), np.array([separator], "<u2").tobytes(), 0
        with store.open_output_stream(own, compression=None) as out:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for text in texts:
                    out.write(np.array(encode(text or ""), "<u2").tobytes())
                    out.write(end)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(texts), pa.string()), pa.array(np.arange(k, k + len(texts))), batch.column(0)], ["file", "ordinal", "doc_id"])
                k += len(texts)
        store.move(own, f"{base}/{name}")

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "file string, ordinal long, doc_id long"), "sidecar")


def find_separators(separator: int, width: int):
    def run(batches):
        kind = "<u2" if width == 2 else "<u4"
        for batch in batches:
            for file, block, offset, size, final in zip(*(c.to_pylist() for c in batch.columns)):
                store, base = fs.FileSystem.from_uri(file)
                with store.open_input_file(base) as f:
                    f.seek(offset)
                    ids = np.frombuffer(f.read(size), kind)
                ends = np.flatnonzero(ids == separator) + offset // width
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([offset // width + len(ids)], pa.int64()), pa.array([final]), pa.array([ends.tolist()], pa.list_(pa.int64()))], ["file", "block", "stop", "final", "ends"])

    return run


def scan_token_files(spark: SparkSession, path: str, separator: int = SEPARATOR, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents of all token files under `path`: file, ordinal (from 0), start (token), n_tokens, ended.

    `width` is the bytes of a token, 2 or 4, little-endian; `block_bytes` a multiple of it. Separators are not
    counted; between two neighbouring ones lies an empty document. Tokens after a file's last separator are a
    document with `ended` false. An empty file has none. A folder without files raises, as for any reader.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select(F.col("path").alias("file"), F.col("length"))
    blocks = files.filter("length > 0").select("file", "length", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block_bytes).cast("long"))).alias("block", "offset"))
    blocks = blocks.select("file", F.col("block").cast("long").alias("block"), "offset", F.least(F.lit(block_bytes), F.col("length") - F.col("offset")).cast("long").alias("size"), (F.col("offset") + block_bytes >= F.col("length")).alias("final"))
    n = max(1, blocks.count())
    found = stored(blocks.repartition(min(n, 10_000), "file", "block").mapInArrow(find_separators(separator, width), "file string, block long, stop long, final boolean, ends array<long>"), "ends")
    # The prefix scan: separators in the blocks before, and from their number the last of them, whichever block it is in.
    summaries = found.select("file", "block", F.size("ends").cast("long").alias("n"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"))
    scan = with_prefix_sums(summaries, ["file"], ["block"], "n", "seen", "scan")
    ends = scan.filter("n > 0").select("file", (F.col("seen") + F.col("n")).alias("seen"), F.col("last").alias("open"))
    scan = scan.select("file", "block", "seen").join(ends, ["file", "seen"], "left").select("file", "block", "seen", F.coalesce("open", F.lit(-1)).alias("open"))
    joined = found.join(scan, ["file", "block"])
    ended = joined.select("file", "seen", "open", "ends", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("open")).otherwise(F.element_at("ends", F.greatest("k", F.lit(1)))) + 1
    ended = ended.select("file", (F.col("seen") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    rest = joined.filter("final").withColumn("from", F.when(F.size("ends") > 0, F.element_at("ends", -1)).otherwise(F.col("open")) + 1)
    rest = rest.filter(F.col("stop") > F.col("from")).select("file", (F.col("seen") + F.size("ends")).alias("ordinal"), F.col("from").alias("start"), (F.col("stop") - F.col("from")).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.union(rest)


def op1_separator_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id and n_tokens of every whole text of documents, found in the token files made of them."""
    path = new_path(spark, "tokens")
    sidecar = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    found = scan_token_files(spark, path).withColumn("file", F.element_at(F.split("file", "/"), -1))
    return found.join(sidecar, ["file", "ordinal"]).select("doc_id", "n_tokens")
