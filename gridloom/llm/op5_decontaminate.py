"""Benchmark decontamination with a generalised suffix automaton of the normalised test items."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import each_text, stored, whole_row

#: Lower-cases A-Z; every other ASCII character but digits and a-z separates words. Bytes above 127 are letters.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Item words in one automaton; more items make more automata, each broadcast in its own pass over the documents.
AUTOMATON_WORDS = 400_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


class SuffixAutomaton:
    """All word sequences of the items: states with longest length, suffix link and steps by word id."""

    def __init__(self, items: Iterable[tuple[int, list[bytes]]], window: int):
        self.window, self.words = window, {}
        self.length, self.link, self.next = [0], [-1], [{}]
        self.short: dict[int, list[int]] = {}  # states at the end of an item below the window: its ids
        ends: list[tuple[int, int]] = []
        self.least = window
        for item, words in items:
            if not words:
                continue
            last = 0
            for k, w in enumerate(words, 1):
                last = self._extend(last, self.words.setdefault(w, len(self.words)))
                if k >= window:
                    ends.append((last, item))
            if len(words) < window:
                self.short.setdefault(last, []).append(item)
                self.least = min(self.least, len(words))
        # The state of each window's words, and the items that have the window.
        self.items: dict[int, set[int]] = {}
        for state, item in ends:
            self.items.setdefault(self.shortened(state, window), set()).add(item)

    def _extend(self, last: int, w: int) -> int:
        length, link, step = self.length, self.link, self.next
        if w in step[last]:
            q = step[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._split(last, w, q)
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        step.append({})
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p >= 0:
            q = step[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        """Part the sequences of q that are no longer than those of p with w added from the longer ones."""
        length, link, step = self.length, self.link, self.next
        clone = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        step.append(dict(step[q]))
        link[q] = clone
        while p >= 0 and step[p].get(w) == q:
            step[p][w] = clone
            p = link[p]
        return clone

    def shortened(self, state: int, length: int) -> int:
        """The state of the last `length` words of a state's longest sequence."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def scan(self, ids: list[int], begin: int, hits: list[tuple[int, int]], items: set[int]) -> None:
        """Stream a run of known words; longest matching lengths give hit ranges (from `begin`) and items."""
        state = matched = 0
        length, link, step, window = self.length, self.link, self.next, self.window
        for at, w in enumerate(ids, begin + 1):
            while state and w not in step[state]:
                state = link[state]
                matched = length[state]
            if w in step[state]:
                state = step[state][w]
                matched += 1
            if matched >= window:
                hits.append((at - matched, at))
                items |= self.items[self.shortened(state, window)]
            if self.short and matched >= self.least:
                s = state
                while s > 0:
                    if s in self.short and length[s] <= matched:
                        hits.append((at - length[s], at))
                        items.update(self.short[s])
                    s = link[s]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs in order, those that touch or overlap joined to one."""
    out: list[list[int]] = []
    for x, y in sorted(spans):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return [(x, y) for x, y in out]


def match_text(machine: SuffixAutomaton, text: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
    """The words of a text, its hit runs of words, and the items found."""
    words = words_of(text)
    found: list[tuple[int, int]] = []
    own: set[int] = set()
    if machine.words and len(words) >= machine.least:
        get = machine.words.get
        ids = [get(w, -1) for w in words]
        unknown = np.concatenate(([-1], np.flatnonzero(np.array(ids) < 0), [len(ids)]))
        for k in np.flatnonzero(np.diff(unknown) > machine.least).tolist():
            i, j = int(unknown[k]) + 1, int(unknown[k + 1])
            machine.scan(ids[i:j], i, found, own)
    return len(words), merged(found), own


FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<long>"


def found_columns(rows: list) -> list[pa.Array]:
    """The columns of FOUND, of (n_words, spans, items) for each row."""
    spans = [s for _, runs, _ in rows for s in runs]
    ends = pa.StructArray.from_arrays([pa.array([x for x, _ in spans], pa.int64()), pa.array([y for _, y in spans], pa.int64())], ["start", "end"])
    items = [sorted(own) for _, _, own in rows]
    at = lambda sizes: pa.array(np.cumsum([0, *sizes]), pa.int32())
    return [pa.array([n for n, _, _ in rows], pa.int64()), pa.ListArray.from_arrays(at(len(r) for _, r, _ in rows), ends), pa.ListArray.from_arrays(at(map(len, items)), pa.array([x for own in items for x in own], pa.int64()))]


def matched(frame: DataFrame, machine: SuffixAutomaton, number: bool) -> tuple[DataFrame, object]:
    """`row` (a struct with a text), or else its `__row`, with the columns FOUND; also the broadcast behind it."""
    shared = frame.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for batch in batches:
            texts = batch.column(1) if number else batch.column(0).field("text")
            rows = [match_text(shared.value, text) for text in each_text(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found_columns(rows)], [kept.name, "n_words", "spans", "items"])

    narrow = frame.select("__row", "row.text") if number else frame
    kept = narrow.schema[0]
    return narrow.mapInArrow(run, StructType([kept, *StructType.fromDDL(FOUND)])), shared


def item_blocks(items: DataFrame, most_words: int) -> list:
    """Functions that each fetch one block of (item_id, text), of bounded size; one block at a time is in the driver."""
    sized = items.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), F.col("text").cast("binary").alias("text")).filter("text IS NOT NULL")
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // (2 * most_words)) or 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [lambda k=k: [(r.item_id, bytes(r.text)) for r in sized.filter(block == k).collect()] for k in range(n)]


def contaminated_rows(docs: DataFrame, items: DataFrame, window: int = 13, most_words: int = AUTOMATON_WORDS) -> DataFrame:
    """Each row of `docs`, whole, as the struct `row`, with n_words, spans and items.

    One block of items: one pass, without a shuffle. Several: the rows are stored with a number each, each
    block's findings are stored before the next block's automaton is built, and they meet by that number.
    """
    blocks = item_blocks(items, most_words)
    build = lambda block: SuffixAutomaton(((i, words_of(t)) for i, t in block()), window)
    frame = docs.select(whole_row(docs))
    if len(blocks) == 1:
        return matched(frame, build(blocks[0]), False)[0]
    frame = stored(frame.withColumn("__row", F.monotonically_increasing_id()), "rows")
    passes = []
    for block in blocks:
        found, shared = matched(frame, build(block), True)
        passes.append(stored(found, "found"))
        shared.destroy()
    every = passes[0]
    for found in passes[1:]:
        every = every.union(found)
    together = every.groupBy("__row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def join_runs(batches):
        for batch in batches:
            rows = [(n, merged([(s["start"], s["end"]) for s in spans]), items) for n, spans, items in zip(*(batch.column(c).to_pylist() for c in ("n_words", "spans", "items")))]
            yield pa.RecordBatch.from_arrays([batch.column("__row"), *found_columns(rows)], ["__row", "n_words", "spans", "items"])

    joined = together.mapInArrow(join_runs, f"__row long, {FOUND}")
    return frame.select("row", "__row").join(joined, "__row").drop("__row")


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 13, most_words: int = AUTOMATON_WORDS) -> DataFrame:
    """Match whole documents against all items: doc_id, n_words, spans (hit runs of words), items (item_ids).

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A window is `window`
    consecutive words of an item, or a whole shorter item; a word inside any occurrence of a window is hit.
    One row for each row of `docs`, whatever its doc_id; a null or empty text has no words. Null item texts match
    nothing, a null item_id takes part as item -1. Only doc_id and text, item_id and text are read. An empty table
    gives no rows. Items of more than `most_words` words (by a bound of two bytes a word) are matched in several passes.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return contaminated_rows(narrow, items, window, most_words).select("row.doc_id", "n_words", "spans", "items")


def n_hit():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def is_contaminated():
    """At least one word in twenty is hit."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans; what stands between two removed words goes, too."""
    marks = np.frombuffer(text.translate(LETTERS), np.uint8) != 32
    edge = np.diff(np.concatenate(([False], marks, [False])).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for x, y in spans:
        out.append(text[at : begin[x]])
        at = end[y - 1]
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, remove_spans: bool = False, span_words: int = 13, most_words: int = AUTOMATON_WORDS) -> DataFrame:
    """`docs` without the rows of which a twentieth of the words or more is covered by test items.

    The others stay as they are; with `remove_spans` their texts lose each hit run of at least `span_words` words.
    Rows are judged each by its own text, whatever their doc_id. Columns of `docs` are kept, other columns than
    text as they are. A null text has no words and stays.
    """
    found = contaminated_rows(docs, items, window, most_words).filter(~is_contaminated())
    if not remove_spans:
        return found.select("row.*")

    def run(batches):
        for batch in batches:
            texts = batch.column("row").field("text").to_pylist()
            cut = [None if t is None else cut_words(t.encode(), [(s["start"], s["end"]) for s in spans if s["end"] - s["start"] >= span_words]).decode() for t, spans in zip(texts, batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(cut, pa.string())], ["row", "text"])

    cut = found.select("row", "spans").mapInArrow(run, StructType([found.schema["row"], StructField("text", StringType())]))
    return cut.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contamination of every whole text of documents by the benchmark's items."""
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    as_text = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(as_text, 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT m FROM windows
), grams AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lengths WHERE len(w) >= m)
), hits AS (SELECT doc_id, i, m, item_id FROM grams JOIN windows USING (m, g)
), words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY 1
), found AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
