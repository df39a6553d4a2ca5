"""Packs of documents that ask buckets of hashes about their own: small sorted arrays travel, texts stay."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Buckets are ranges of hashes, so a sorted array is cut into them."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def cuts(hashes: np.ndarray, n_buckets: int):
    edges = np.searchsorted(bucket_of(hashes, n_buckets), np.arange(n_buckets + 1))
    return [(b, i, j) for b, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if i < j]


def bits_for(replies: pd.DataFrame, column: str, hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """The buckets' reply bits in the order of the sorted `hashes` that were sent."""
    by_bucket = dict(zip(replies["bucket"], replies[column]))
    parts = [np.unpackbits(np.frombuffer(by_bucket[b], np.uint8), count=j - i) for b, i, j in cuts(hashes, n_buckets)]
    return np.concatenate(parts).astype(bool) if parts else np.empty(0, bool)


def sorted_anchors(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and whether each has at least two doc_ids."""
    if not len(hashes):
        return hashes, np.empty(0, bool)
    order = np.argsort(hashes)
    h, d = hashes[order], ids[order]
    first = runs(h)
    return h[first], np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first)


def find_repeats(rows: pd.DataFrame) -> pd.DataFrame:
    """Reply to each pack, a bit for each hash of this bucket: does it occur in two documents?"""
    parts = [np.frombuffer(x, np.uint64) for x in rows.hashes]
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(rows.many, parts)])
    _, inverse, packs = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    repeats = packs > 1
    repeats[inverse[many > 0]] = True
    own = np.split(repeats[inverse], np.cumsum([len(p) for p in parts])[:-1])
    return pd.DataFrame({"pack": rows["pack"], "bucket": rows["bucket"], "repeats": [np.packbits(x).tobytes() for x in own]})


def pack_places(batches):
    """(pack, list of places) with the places as bytes."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(x, np.int64).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], ["pack", "copies"])


def dealt(df: DataFrame, key: str, n: int):
    """Groups by `key` over n partitions. The rows are few but dear, so they must not be coalesced by their size."""
    return df.repartition(n, key).groupBy(key)


def asked(packs: DataFrame, replies: list[DataFrame]):
    """Packs and the replies to them, cogrouped; packs are bucketed, so only the replies are shuffled."""
    columns = dict.fromkeys(c for r in replies for c in r.columns)
    every = None
    for r in replies:
        r = r.select(*[F.col(c) if c in r.columns else F.lit(None).cast("long" if c == "bucket" else "binary").alias(c) for c in columns])
        every = r if every is None else every.union(r)
    return packs.groupBy("pack").cogroup(every.groupBy("pack"))


def together(packs: DataFrame, replies: list[DataFrame], function, schema: str) -> DataFrame:
    """Apply a pandas function to each pack and the replies to it."""
    return asked(packs, replies).applyInPandas(function, schema)
