"""Ranked lexical search over a length-stratified index.

Documents of one length normaliser m form a stratum, cut into blocks. Within a block the postings of a term are
grouped by the term's frequency tf, so an impact, which depends on m and tf alone, is computed once for each tf.

1. One pass over the texts keeps of each document its number of terms and how often it has each term of the items.
2. Their sums give the statistics, the items' weights and each document's m; blocks are cut from a range sort by m.
3. For an item, the largest impact of each of its terms bounds a block, and its blocks bound a stratum.
4. Strata are visited in the order of their bounds, by rounds of growing size, until no bound reaches the item's k-th score.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_view, slices, stored
from .op5_decontaminate import words_of

#: Documents, and about the postings, of a block.
BLOCK_DOCS, BLOCK_POSTINGS = 4096, 1 << 20
#: Bytes of items searched at a time: their terms and weights are broadcast. More items make more passes.
ITEM_BYTES = 2 << 20
#: Strata that each item visits in the first round, and how much the visited number grows with each round.
FIRST_STRATA, GROWTH = 8, 8
#: Pairs of stratum and item whose list is broadcast (4 bytes each); a longer one is joined by shuffle.
BROADCAST_VISITS = 2_000_000


@dataclass
class Items:
    """The items of a pass. Item i has the terms `term[start[i]:start[i + 1]]`, each with its repeats, later times its weight."""

    ids: list[int | None] = field(default_factory=list)
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    start: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    term: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    @classmethod
    def of(cls, rows: list[tuple[int | None, bytes]]) -> Items:
        """Items without terms find nothing and are left out."""
        out, terms, times, sizes = cls(), [], [], []
        for item, text in rows:
            known = [out.vocabulary.setdefault(w, len(out.vocabulary)) for w in words_of(text)]
            if known:
                term, repeats = np.unique(known, return_counts=True)
                out.ids.append(item)
                terms.append(term)
                times.append(repeats)
                sizes.append(len(term))
        if terms:
            out.start, out.term, out.times = np.cumsum([0, *sizes]), np.concatenate(terms), np.concatenate(times)
        return out

    def of_term(self) -> np.ndarray:
        """For each term of each item its item."""
        return np.repeat(np.arange(len(self.ids)), np.diff(self.start))


def item_passes(items: DataFrame, most_bytes: int) -> list:
    """Functions that each fetch the (item_id, text) of one pass, of bounded size; an item of more bytes is a pass of its own at most."""
    sized = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).filter("text IS NOT NULL")
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // most_bytes)
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n)))
    return [lambda k=k: [(r.item_id, bytes(r.text)) for r in sized.filter(place == k).collect()] for k in range(n)]


VECTOR = "doc_id long, n long, terms array<int>, tfs array<int>"


def term_vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, text) to VECTOR: the number of all terms, and the frequencies of those in the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        get, size = shared.value.get, max(1, len(shared.value))
        for batch in batches:
            data, offsets = byte_view(batch.column(1))
            for i, j in slices(offsets, 4 << 20):
                known, sizes = [], []
                for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist()):
                    words = words_of(data[a:b].tobytes())
                    sizes.append(len(words))
                    known += [get(w, -1) for w in words]
                known, doc = np.array(known, np.int64), np.repeat(np.arange(j - i), sizes)
                keys, tf = np.unique((doc * size + known)[known >= 0], return_counts=True)
                edges = pa.array(np.searchsorted(keys, np.arange(j - i + 1) * size), pa.int32())
                lists = [pa.ListArray.from_arrays(edges, pa.array(v, pa.int32())) for v in (keys % size, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, VECTOR)


def document_counts(vectors: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each term occurs. A task sends one row for each term."""

    def run(batches):
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for r in vectors.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


BLOCK = "m long, nameless boolean, longest long, ids binary, terms binary, tfs binary, begins binary, docs binary"


def cut_blocks(batches):
    """Rows (m, nameless, doc_id, n, terms, tfs) in the order of m to blocks: groups of equal term and tf, and the places of their documents."""
    held, size, key = [], 0, None

    def flush():
        ids, terms, tfs = (np.concatenate([h[k] for h in held]) for k in (0, 2, 3))
        docs = np.repeat(np.arange(len(ids)), np.concatenate([h[4] for h in held]))
        order = np.lexsort((docs, tfs, terms))
        terms, tfs, docs = terms[order], tfs[order], docs[order]
        begins = np.flatnonzero(np.concatenate(([True], (terms[1:] != terms[:-1]) | (tfs[1:] != tfs[:-1]))))
        arrays = (ids, terms[begins].astype(np.int32), tfs[begins].astype(np.int32), np.append(begins, len(docs)).astype(np.int32), docs.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([max(int(h[1].max()) for h in held)]), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], ["m", "nameless", "longest", "ids", "terms", "tfs", "begins", "docs"])

    for batch in batches:
        m, nameless, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
        ids = batch.column(2).fill_null(0).to_numpy()
        lengths = batch.column(4).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        edges = np.concatenate(([0], np.cumsum(lengths)))
        terms, tfs = (batch.column(k).flatten().to_numpy() for k in (4, 5))
        i = 0
        while i < batch.num_rows:
            here = (int(m[i]), bool(nameless[i]))
            if held and (here != key or size >= BLOCK_POSTINGS or sum(len(h[0]) for h in held) >= BLOCK_DOCS):
                yield flush()
                held, size = [], 0
            key = here
            same = np.flatnonzero((m[i:] != m[i]) | (nameless[i:] != nameless[i]))
            full = int(np.searchsorted(edges, edges[i] + BLOCK_POSTINGS - size, "left"))
            j = min(i + (int(same[0]) if len(same) else batch.num_rows - i), i + BLOCK_DOCS - sum(len(h[0]) for h in held), max(full, i + 1))
            held.append((ids[i:j], n[i:j], terms[edges[i] : edges[j]], tfs[edges[i] : edges[j]], lengths[i:j]))
            size += int(edges[j] - edges[i])
            i = j
    if held:
        yield flush()


def stratified_index(vectors: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """Blocks of documents with one m each. Documents without any of the terms have no postings and no block."""
    m = F.expr(f"25L + (75L * n * {n_docs}L) div {max(1, n_terms)}L")
    rows = vectors.filter(F.size("terms") > 0).select(m.alias("m"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "n", "terms", "tfs")
    order = ["m", "nameless", "doc_id"]
    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut_blocks, BLOCK), "strata")


class Block:
    def __init__(self, row):
        self.m, self.nameless, self.longest = row.m, row.nameless, row.longest
        self.ids = np.frombuffer(row.ids, np.int64)
        group_term, tf, self.begins, self.docs = (np.frombuffer(x, np.int32) for x in (row.terms, row.tfs, row.begins, row.docs))
        each, of = np.unique(tf, return_inverse=True)
        each = each.astype(np.int64)
        self.impact = (1_000_000_000 * each // (1000 * each + 8 * self.m))[of]
        # Term t has the groups first[t] to first[t + 1]; the last one has its largest tf, and so its largest impact.
        self.first = np.flatnonzero(np.concatenate(([True], group_term[1:] != group_term[:-1], [True])))
        self.terms, self.most = group_term[self.first[:-1]], self.impact[self.first[1:] - 1]

    def places(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        return at, self.terms[at] == term

    def bounds(self, items: Items) -> np.ndarray:
        """The most that each item can score here. A document has no more terms than words, so only as many of the largest count."""
        at, held = self.places(items.term)
        best = np.where(held, items.times * self.most[at], 0)
        if self.longest < np.diff(items.start).max():
            of = items.of_term()
            order = np.lexsort((-best, of))
            best[order[np.arange(len(of)) - items.start[of] >= self.longest]] = 0
        return np.add.reduceat(best, items.start[:-1])

    def scores(self, items: Items, item: int) -> np.ndarray:
        part = slice(items.start[item], items.start[item + 1])
        at, held = self.places(items.term[part])
        at, times = at[held], items.times[part][held]
        groups = np.concatenate([np.arange(a, b) for a, b in zip(self.first[at].tolist(), self.first[at + 1].tolist())])
        gain = np.repeat(times, self.first[at + 1] - self.first[at]) * self.impact[groups]
        size = self.begins[groups + 1] - self.begins[groups]
        docs = np.concatenate([self.docs[a:b] for a, b in zip(self.begins[groups].tolist(), self.begins[groups + 1].tolist())])
        if int((times * self.most[at]).sum()) < 1 << 53:  # doubles add such integers exactly
            return np.bincount(docs, np.repeat(gain, size), len(self.ids)).astype(np.int64)
        out = np.zeros(len(self.ids), np.int64)
        np.add.at(out, docs, np.repeat(gain, size))
        return out


def block_bounds(shared):
    """(m, item, bound) with the largest bound of a stratum's blocks in this task."""

    def run(batches):
        items, m, most = shared.value, None, None

        def rows():
            at = np.flatnonzero(most)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), m)), pa.array(at), pa.array(most[at])], ["m", "item", "bound"])

        for batch in batches:
            for row in batch.to_pandas().itertuples():
                block = Block(row)
                if m is not None and block.m != m:
                    yield rows()
                    most = None
                m, own = block.m, block.bounds(items)
                most = own if most is None else np.maximum(most, own)
        if m is not None:
            yield rows()

    return run


class Best:
    """The k best (score, doc_id) of one item so far, equal scores by smaller id, null ids last."""

    def __init__(self, k: int, kth: int):
        self.k, self.kth = k, kth
        self.score, self.ids, self.nameless = (np.empty(0, t) for t in (np.int64, np.int64, bool))

    def add(self, score: np.ndarray, ids: np.ndarray, nameless: bool) -> None:
        at = np.flatnonzero(score >= self.kth)
        score, ids, none = np.append(self.score, score[at]), np.append(self.ids, ids[at]), np.append(self.nameless, np.full(len(at), nameless))
        order = np.lexsort((ids, none, -score))[: self.k]
        self.score, self.ids, self.nameless = score[order], ids[order], none[order]
        if len(order) == self.k:
            self.kth = max(self.kth, int(self.score[-1]))


def score_blocks(shared, kth: np.ndarray, k: int):
    """Blocks with the list of their visiting items to each task's best (item, doc_id, score)."""

    def run(batches):
        items, found = shared.value, {}
        for batch in batches:
            for row in batch.to_pandas().itertuples():
                block = Block(row)
                bound = block.bounds(items)
                for item in row.items.tolist():
                    best = found.setdefault(item, Best(k, int(kth[item])))
                    if bound[item] >= best.kth:
                        best.add(block.scores(items, item), block.ids, block.nameless)
        for item, best in found.items():
            ids = pa.array(best.ids, mask=best.nameless)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item)), ids, pa.array(best.score)], ["item", "doc_id", "score"])

    return run


def highest(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_strata(blocks: DataFrame, items: Items, k: int, first: int = FIRST_STRATA, growth: int = GROWTH) -> tuple[DataFrame, int, int]:
    """The k best of each item: (item, doc_id, score, rank); also how many pairs of item and stratum were visited, and all there are."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(items)
    bounds = blocks.mapInArrow(block_bounds(shared), "m long, item long, bound long").groupBy("item", "m").agg(F.max("bound").alias("bound"))
    turn = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "m"))
    bounds = stored(bounds.withColumn("turn", turn), "bounds")
    best = spark.createDataFrame([], "item long, doc_id long, score long, rank int")
    kth, done, visited = np.ones(len(items.ids), np.int64), 0, 0
    while True:
        least = spark.createDataFrame([(i, x) for i, x in enumerate(kth.tolist())], "item long, kth long")
        left = bounds.filter(F.col("turn") > done).join(F.broadcast(least), "item").filter("bound >= kth")
        done = max(first, done * growth)
        now = left.filter(F.col("turn") <= done)
        n = now.count()
        if not n:  # an item's bounds fall, so that none of the later ones reaches its k-th score either
            return best, visited, bounds.count()
        visited += n
        visits = now.groupBy("m").agg(F.collect_list("item").alias("items"))
        visits = F.broadcast(visits) if n <= BROADCAST_VISITS else visits
        scored = blocks.join(visits, "m").mapInArrow(score_blocks(shared, kth, k), "item long, doc_id long, score long")
        best = stored(highest(best.drop("rank").union(scored), k), "best")
        for r in best.filter(F.col("rank") == k).select("item", "score").collect():
            kth[r.item] = r.score


def weights(items: Items, df: np.ndarray, n_docs: int) -> None:
    w = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    items.times = items.times * w[items.term]


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 10, item_bytes: int = ITEM_BYTES, first: int = FIRST_STRATA, growth: int = GROWTH) -> DataFrame:
    """For each item the k documents with the highest scores above 0: item_id, rank (from 1), doc_id, score.

    Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased; impacts saturate with a term's
    frequency and fall with a document's length, all in integers (the query's contract has the formula). Each row of
    `docs` is a document, each row of `items` an item with results of its own, whatever their ids. Null and empty texts
    have no terms: such documents count nowhere, such items have no rows. Equal scores by smaller doc_id, null ones
    last. Only doc_id, item_id and the texts are read. Without documents or items there are no rows. Items of more than
    `item_bytes` bytes are searched in several passes over the documents, and only the terms of a pass are indexed.
    """
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for fetch in item_passes(items, item_bytes):
        own = Items.of(fetch())
        if not own.ids:
            continue
        vectors = stored(term_vectors(texts, own.vocabulary), "vectors")
        n_docs, n_terms = vectors.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights(own, document_counts(vectors, len(own.vocabulary)), n_docs)
        best = search_strata(stratified_index(vectors, n_docs, n_terms), own, k, first, growth)[0]
        names = spark.createDataFrame(list(enumerate(own.ids)), "item long, item_id long")
        out = out.union(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def op11_length_stratified_search(spark, sf_dir: str) -> DataFrame:
    """The ten best of all documents for every benchmark item."""
    return ranked_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT r, doc_id, w, len(w) AS n FROM (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)
  WHERE len(w) > 0
), q AS (
  SELECT i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t
  FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)
), items AS (SELECT i, item_id, t, count(*) AS c FROM q GROUP BY ALL
), terms AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2
), s AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM d
), weights AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM terms, s GROUP BY t, n_docs
), impacts AS (SELECT r, t, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)) AS x FROM terms JOIN d USING (r), s
), scores AS (
  SELECT i, item_id, doc_id, r, CAST(sum(c * weights.w * x) AS BIGINT) AS score FROM items JOIN weights USING (t) JOIN impacts USING (t) JOIN d USING (r) GROUP BY i, item_id, doc_id, r
), ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
