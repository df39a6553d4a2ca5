"""Importance resampling towards a target distribution, over hashed runs of words with a head and a tail vocabulary.

A feature's bucket is the CRC-32 of its bytes modulo the number of buckets. Frequent words (the head) carry their
CRC states in a broadcast table, frequent pairs of them their pair's; a longer run, or one with a word of the tail,
takes up the CRC where the known part ends. So every feature gets its exact bucket, and the head only sets the speed.

1. Words, then pairs of head words, are counted over all documents, which gives the head.
2. Each document becomes a histogram of buckets, which is stored; texts are not read again.
3. The histograms sum to bucket totals; these and the target's give each bucket's gain.
4. Documents are scored by gains and a Gumbel draw of their id, and the highest scores are ranked by a range sort.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_view, slices, stored, with_prefix_sums
from .op5_decontaminate import words_of

BUCKETS = 10_000
#: Words and pairs of the head: what is broadcast, about 3 MB.
HEAD_WORDS, HEAD_PAIRS = 20_000, 20_000
#: Features counted at a time while the head is sought. Of these only such as make up one in PART_SHARE go on, so that
#: rare ones are not shuffled; one that is more frequent than that in all documents is so in some part, and is found.
PART, PART_SHARE = 1 << 20, 1 << 17


@dataclass
class Head:
    """Numbers and CRC states of frequent words; sorted keys (first number * words + second) and states of frequent pairs."""

    words: dict[bytes, int]
    states: np.ndarray
    pairs: np.ndarray
    pair_states: np.ndarray


def text_parts(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """About `most` bytes of texts at a time: all their words in order, and each text's number of words."""
    data, offsets = byte_view(column)
    for i, j in slices(offsets, most):
        each = [words_of(data[a:b].tobytes()) for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist())]
        yield [w for words in each for w in words], np.array([len(words) for words in each], np.int64)


def numbers(words: list[bytes], head: Head) -> np.ndarray:
    return np.array([head.words.get(w, -1) for w in words], np.int64)


def last_words(sizes: np.ndarray) -> np.ndarray:
    """For each word the place of its text's last word."""
    return np.repeat(np.cumsum(sizes) - 1, sizes)


def runs_of(words: list[bytes], sizes: np.ndarray, head: Head, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length from 1 to n: the places where runs of that length begin, and their CRC-32."""
    known, at, last = numbers(words, head), np.arange(len(words)), last_words(sizes)
    state = head.states[known] if len(head.states) else np.zeros(len(words), np.int64)
    for p in np.flatnonzero(known < 0).tolist():
        state[p] = crc32(words[p])
    yield at, state
    for length in range(2, n + 1):
        at = at[at + length - 1 <= last[at]]
        rest = at
        if length == 2 and len(head.pairs):
            key = np.where((known[at] >= 0) & (known[at + 1] >= 0), known[at] * len(head.words) + known[at + 1], -1)
            place = np.minimum(np.searchsorted(head.pairs, key), len(head.pairs) - 1)
            hit = head.pairs[place] == key
            state[at[hit]] = head.pair_states[place[hit]]
            rest = at[~hit]
        for p in rest.tolist():
            state[p] = crc32(b" " + words[p + length - 1], int(state[p]))
        yield at, state[at]


def frequent(texts: DataFrame, counted, key: str, most: int) -> list:
    """The `most` features (word, or key of a pair) that are counted most often, equals by value."""
    counts = texts.mapInArrow(counted, f"feature {key}, n long")
    return [r.feature for r in counts.groupBy("feature").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "feature").limit(most).collect()]


def sent(counts: Counter, seen: int, kind: pa.DataType) -> pa.RecordBatch:
    rows = [(k, n) for k, n in counts.items() if n * PART_SHARE >= seen]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], kind), pa.array([n for _, n in rows], pa.int64())], ["feature", "n"])


def counting(features, kind: pa.DataType):
    """Counts by part of what `features` makes of (words, sizes)."""

    def run(batches):
        counts, seen = Counter(), 0
        for batch in batches:
            for words, sizes in text_parts(batch.column(0)):
                found = features(words, sizes)
                counts.update(found)
                seen += len(found)
                if seen >= PART:
                    yield sent(counts, seen, kind)
                    counts, seen = Counter(), 0
        yield sent(counts, seen, kind)

    return run


def pair_keys(words: list[bytes], sizes: np.ndarray, head: Head) -> list[int]:
    """The keys of all pairs of neighbouring head words."""
    known, last = numbers(words, head), last_words(sizes)
    at = np.flatnonzero((known[:-1] >= 0) & (known[1:] >= 0) & (last[:-1] == last[1:])) if len(words) else np.empty(0, np.int64)
    return (known[at] * len(head.words) + known[at + 1]).tolist()


def find_head(texts: DataFrame, n: int, most_words: int = HEAD_WORDS, most_pairs: int = HEAD_PAIRS) -> Head:
    """The head of the column `text`; pairs only if runs of two are features."""
    words = [bytes(w) for w in frequent(texts, counting(lambda words, sizes: words, pa.binary()), "binary", most_words)]
    states, none = np.array([crc32(w) for w in words], np.int64), np.empty(0, np.int64)
    head = Head({w: k for k, w in enumerate(words)}, states, none, none)
    if n < 2 or not words:
        return head
    pairs = sorted(frequent(texts, counting(lambda words, sizes: pair_keys(words, sizes, head), pa.int64()), "long", most_pairs))
    ends = [divmod(p, len(words)) for p in pairs]
    return Head(head.words, states, np.array(pairs, np.int64), np.array([crc32(b" " + words[j], int(states[i])) for i, j in ends], np.int64))


HISTOGRAM = "doc_id long, n_words long, n_features long, buckets array<int>, counts array<long>"


def histograms(texts: DataFrame, head: Head, n: int, buckets: int) -> DataFrame:
    """(doc_id, text) to HISTOGRAM: how often each of a document's buckets occurs; never longer than `buckets`."""
    shared = texts.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        for batch in batches:
            begin = 0
            for words, sizes in text_parts(batch.column(1)):
                doc = np.repeat(np.arange(len(sizes)), sizes)
                keys = np.concatenate([doc[at] * buckets + state % buckets for at, state in runs_of(words, sizes, shared.value, n)])
                keys, counts = np.unique(keys, return_counts=True)
                edges = pa.array(np.searchsorted(keys, np.arange(len(sizes) + 1) * buckets), pa.int32())
                features = sum(np.maximum(sizes - k, 0) for k in range(n))
                lists = [pa.ListArray.from_arrays(edges, pa.array(v, kind)) for v, kind in ((keys % buckets, pa.int32()), (counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(sizes)), pa.array(sizes), pa.array(features, pa.int64()), *lists], ["doc_id", "n_words", "n_features", "buckets", "counts"])
                begin += len(sizes)

    return texts.mapInArrow(run, HISTOGRAM)


def bucket_totals(histogram: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all documents. A task sends one row for each bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = histogram.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the target's share to the source's, each with one more of every bucket."""
    n, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    return np.array([floor(1000 * log((t + 1) * (all_source + n) / ((s + 1) * (all_target + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    """floor(1000 g) of a Gumbel draw g that depends on the id (null: an empty text) and the seed alone."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return floor(-1000 * log(-log((h + 0.5) / 4294967296)))


def scored(histogram: DataFrame, gains: np.ndarray, seed: int) -> DataFrame:
    shared = histogram.sparkSession.sparkContext.broadcast(gains)

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), batch.column(3)
            edges = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            sums = np.concatenate(([0], np.cumsum(shared.value[lists.flatten().to_numpy()] * batch.column(4).flatten().to_numpy())))
            weight = sums[edges[1:]] - sums[edges[:-1]]
            score = weight + np.array([gumbel(i, seed) for i in ids], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight), pa.array(score)], ["doc_id", "n_words", "n_features", "weight", "score"])

    return histogram.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, least_words: int = 20, percent: int = 10, seed: int = 2024, most_words: int = HEAD_WORDS, most_pairs: int = HEAD_PAIRS) -> DataFrame:
    """Draw `percent` of the documents, those likelier under the target's distribution of features more often.

    `docs` has doc_id and text, `target` has text. Features are all runs of 1 to `n` words (letters, digits and
    non-ASCII characters, A-Z lower-cased), joined by one space, repeats counted. A document's weight is the sum of its
    features' bucket gains, its score adds a Gumbel draw of its id, and of those with `least_words` words or more the
    highest scores are drawn, ties to the smaller doc_id (null last). Returns doc_id, n_features, weight, score and
    rank (null: not drawn), one row for each row of `docs`. Null and empty texts have no features and weight 0; rows of
    one doc_id share its draw and are ranked each by itself; a null doc_id draws as the empty text. Other columns are
    not read. Without documents there are no rows, without target texts all gains come from the documents alone.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    head = find_head(texts.select("text"), n, most_words, most_pairs)
    own = stored(histograms(texts, head, n, buckets), "histograms")
    wanted = histograms(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), head, n, buckets)
    rows = stored(scored(own, bucket_gains(bucket_totals(own, buckets), bucket_totals(wanted, buckets)), seed), "scored")
    enough = rows.filter(F.col("n_words") >= least_words)
    drawn = percent * enough.count() // 100
    order = ["__down", "doc_id", "n_features", "weight"]
    placed = with_prefix_sums(enough.withColumns({"__all": F.lit(0), "__one": F.lit(1), "__down": -F.col("score")}), ["__all"], order, "__one", "__before", "ranks")
    rank = F.when(F.col("__before") < drawn, F.col("__before") + 1).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*columns, rank).union(rows.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))


def op12_head_tail_resampling(spark, sf_dir: str) -> DataFrame:
    """A draw of a tenth of all documents towards the benchmark's words."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: CRC-32 by its table, which the rule of the reflected polynomial 0xEDB88320 gives; only distinct words are hashed.
ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), steps AS (SELECT list(c ORDER BY i) AS step FROM bits WHERE k = 8
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents
), b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark
), f AS (SELECT r, unnest(w) AS f FROM d
), words AS (SELECT DISTINCT f FROM (SELECT f FROM f UNION ALL SELECT f FROM b)
), hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(f)), lambda i: CAST('0x' || substr(hex(f), 2 * i + 1, 2) AS BIGINT))),
                            lambda c, x: xor(c >> 8, step[xor(c, x) % 256 + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM words, steps
), s AS (SELECT bucket, count(*) AS s FROM f JOIN hashed USING (f) GROUP BY 1
), t AS (SELECT bucket, count(*) AS t FROM b JOIN hashed USING (f) GROUP BY 1
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + 10000) / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)
), weights AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY 1
), scores AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (r)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM ranked
"""
