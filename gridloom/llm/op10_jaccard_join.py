"""N-gram Jaccard join by parity sketches.

A document's shingles are XOR-hashed into a bit sketch: each flips one bit, so two sketches differ in at most
as many bits as the sets differ in shingles. At a similarity t, sets of sizes a and b differ in at most
D = (1 - t) / (1 + t) * (a + b) shingles. Documents are sorted into size bands, and a band's sketch is cut into
P > D parts, so the parts of a linked pair differ in at most D places. A part is 2 ** 32 bits wide and held
sparsely, as a key that hashes its set bits. By the pigeonhole principle a linked pair shares one of the first
D + 1 keys of either document, in any order that depends on the keys alone; parts with the most bits come first,
which are the rarest. If a document has no more than D parts with bits, it sends its empty parts as well.

1. Documents of one and the same set form a class; one of them, the smallest doc_id, goes on.
2. Packs of documents send their distinct keys to the keys' buckets, which reply which of them repeat. Documents
   with a repeated key ("hits") are paired with the smallest doc_id that has it, and the pairs verified on the
   texts. Links give first components.
3. Hits whose documents are still in several components are paired across components, in blocks of bounded
   size; pairs whose narrow sketches differ in more bits than the sets may are dropped, the rest verified.

So no pair of a part goes unseen, unless a path already links it, and copies are never expanded into pairs.
Rows of one key are joined to what is known of it by (key, pack), so a key of very many rows is spread over as
many tasks as it has packs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_KEYS, ODD, byte_view, bucketed, components, mix64, only_ids, range_hashes, slices, stored, without_ids
from .packs import bits_for, cuts, dealt, find_repeats, pack_places, runs, sorted_anchors, together

#: Lower-cases A-Z; \x20 and \x09 to \x0D separate words.
WORDS = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bits of a part in the narrow sketch, ratio of a size band's ends, and rows in a block of step 3.
FOLD_BITS = 4
BAND = 1.5
BLOCK = 1024
#: Bytes of text in a pack, of keys in a bucket, and of narrow sketches in one task's bucket of step 3.
PACK_BYTES = 16 << 20
BUCKET_BYTES = 8 << 20
OPEN_BYTES = 16 << 20
CHUNK = 1 << 18
#: Longer words are hashed by xxh3: sums of powers modulo 2 ** 64 agree on some pairs of long words that repeat two letters.
LONG_WORD = 32


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words in `data`."""
    gap = SPACE[data]
    edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out = np.empty(len(begin), np.uint64)
    for lo in range(0, len(data), CHUNK):  # the words that begin in this chunk
        i, j = np.searchsorted(begin, (lo, lo + CHUNK))
        if i < j and end[j - 1] - begin[j - 1] > CHUNK:  # only a chunk's last word can be that long
            j -= 1
        if i < j:
            out[i:j] = range_hashes(BYTE_KEYS[WORDS[data[lo : int(end[j - 1])]]], begin[i:j] - lo, end[i:j] - lo)
    for k in np.flatnonzero(end - begin > LONG_WORD).tolist():
        out[k] = xxhash.xxh3_64_intdigest(WORDS[data[begin[k] : end[k]]].tobytes())
    return begin, out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int):
    """The sorted distinct hashes of each document's n-word shingles; fewer words are one shingle."""
    for i, j in slices(offsets, 1 << 20):
        base = int(offsets[i])
        part = data[base : offsets[j]]
        # Documents must not run into each other: a word ends where its document ends.
        parted = np.insert(part, offsets[i + 1 : j] - base, 32) if j - i > 1 else part
        marks = offsets[i : j + 1] - base + np.arange(j - i + 1)
        begin, words = word_hashes(parted)
        cut = np.searchsorted(begin, marks)
        rolled = words[: max(0, len(words) - n + 1)].copy()
        for k in range(1, n):
            rolled = mix64(rolled * np.uint64(ODD + 2 * k)) + words[k : len(words) - n + 1 + k] if len(rolled) else rolled
        rolled = mix64(rolled)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if b - a >= n:
                yield np.unique(rolled[a : b - n + 1])
            elif b > a:
                yield np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes(), seed=b - a)], np.uint64)
            else:
                yield np.empty(0, np.uint64)


def most_apart(total: float, threshold: tuple[int, int]) -> int:
    """The most shingles in which two sets of `total` elements together may differ, at a similarity of p / q."""
    p, q = threshold
    return int((q - p) * total // (q + p))


def band_of(size: int) -> int:
    return int(math.log(size) / math.log(BAND) + 1e-9)


def band_parts(band: int, threshold: tuple[int, int]) -> int:
    """Parts of a size band's sketches: some more than the shingles in which linked pairs may differ."""
    apart = most_apart(2 * math.ceil(BAND ** (band + 1)), threshold)
    return 16 * math.ceil((apart * 1.15 + 6) / 16)


def bands_of(size: int, threshold: tuple[int, int]):
    """The bands in which a set meets those it may link with: its own and the larger ones'. With each, the most that they differ."""
    p, q = threshold
    own, most = band_of(size), size * q // p
    for band in range(own, band_of(most) + 1):
        yield band, most_apart(size + min(most, math.ceil(BAND ** (band + 1))), threshold)


def part_places(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each shingle; sorted as the hashes are."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def part_keys(hashes: np.ndarray, band: int, apart: int, threshold: tuple[int, int]) -> np.ndarray:
    """The first apart + 1 keys of the parts, those of most bits first; all parts if no more have bits."""
    parts = band_parts(band, threshold)
    place = part_places(hashes, parts)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    bits = np.diff(np.append(first, len(place)))
    salt = mix64(np.arange(parts, dtype=np.uint64) * np.uint64(ODD) + np.uint64(band + 1))
    key = mix64(np.bitwise_xor.reduceat(hashes, first) + salt[place[first]])
    if len(key) <= apart:
        return np.concatenate((key, mix64(np.delete(salt, place[first]))))
    return key[np.lexsort((key, -bits))[: apart + 1]]


def narrow_sketch(hashes: np.ndarray, band: int, threshold: tuple[int, int]) -> bytes:
    """The parity sketch with FOLD_BITS bits a part."""
    width = band_parts(band, threshold) * FOLD_BITS
    return np.packbits((np.bincount(part_places(hashes, width), minlength=width) & 1).astype(np.uint8)).tobytes()


PACKS = "pack long, ids binary, known binary, sizes binary, set_keys binary, n_keys binary, keys binary"


def sketch_documents(n: int, threshold: tuple[int, int]):
    def run(batches):
        """(doc_id, text) to packs: ids and whether they are known, set sizes, 128-bit set hashes, numbers of keys and keys."""
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            known = np.array(batch.column(0).is_valid())
            ids = np.array(batch.column(0).fill_null(0), np.int64)
            data, offsets = byte_view(batch.column(1))
            for i, j in slices(offsets, PACK_BYTES):
                sizes, set_keys, keys = [], [], []
                for hashes in shingle_sets(data, offsets[i : j + 1], n):
                    sizes.append(len(hashes))
                    set_keys.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    keys.append(np.concatenate([part_keys(hashes, b, d, threshold) for b, d in bands_of(len(hashes), threshold)]) if len(hashes) else hashes)
                row = [(part << 32) + k, ids[i:j].tobytes(), known[i:j].tobytes(), np.array(sizes, np.int64).tobytes(), b"".join(set_keys), np.array([len(x) for x in keys], np.int64).tobytes(), np.concatenate(keys).tobytes()]
                k += 1
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:])], [c.split()[0] for c in PACKS.split(", ")])

    return run


def list_documents(batches):
    """Packs to rows (pack, place, doc_id, n_shingles, set_key)."""
    for batch in batches:
        for pack, ids, known, sizes, set_keys in zip(*(c.to_pylist() for c in batch.columns)):
            ids, known = np.frombuffer(ids, np.int64), np.frombuffer(known, bool)
            keys = [set_keys[k : k + 16] for k in range(0, len(set_keys), 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), pack)), pa.array(np.arange(len(ids))), pa.array(ids, mask=~known), pa.array(np.frombuffer(sizes, np.int64)), pa.array(keys, pa.binary())], ["pack", "place", "doc_id", "n_shingles", "set_key"])


def pack_keys(row, copies) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a pack's documents, without copies and unknown ids, and their doc_ids, sorted by key."""
    open_ = np.frombuffer(row.known, bool).copy()
    for x in copies:
        open_[np.frombuffer(x, np.int64)] = False
    counts = np.frombuffer(row.n_keys, np.int64)
    keep = np.repeat(open_, counts)
    keys, ids = np.frombuffer(row.keys, np.uint64)[keep], np.repeat(np.frombuffer(row.ids, np.int64), counts)[keep]
    order = np.argsort(keys, kind="stable")
    return keys[order], ids[order]


def send_keys(n_buckets: int):
    def run(packs: pd.DataFrame, copies: pd.DataFrame) -> pd.DataFrame:
        """A pack's distinct keys for each bucket, and bits for those that several of its documents have."""
        out = []
        for row in packs.itertuples():
            keys, ids = pack_keys(row, copies["copies"])
            distinct, many = sorted_anchors(keys, ids)
            out += [(b, row.pack, distinct[i:j].tobytes(), np.packbits(many[i:j]).tobytes()) for b, i, j in cuts(distinct, n_buckets)]
        return pd.DataFrame(out, columns=["bucket", "pack", "hashes", "many"])

    return run


def find_hits(n_buckets: int):
    def run(packs: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        """Rows (key, pack, doc_id) for the keys that repeat."""
        keys, ids, pack = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        for row in packs.itertuples():
            pack = row.pack
            keys, ids = pack_keys(row, replies["copies"].dropna())
            first = runs(keys) if len(keys) else np.empty(0, np.int64)
            repeats = bits_for(replies[replies["repeats"].notna()], "repeats", keys[first], n_buckets)
            keep = np.repeat(repeats, np.diff(np.append(first, len(keys))))
            keys, ids = keys[keep], ids[keep]
        return pd.DataFrame({"key": keys.view(np.int64), "pack": np.full(len(keys), pack), "doc_id": ids})

    return run


def fold_documents(n: int, threshold: tuple[int, int]):
    def run(batches):
        """(doc_id, text) to doc_id, n_shingles and the narrow sketches of each band in which it meets others."""
        for batch in batches:
            data, offsets = byte_view(batch.column(1))
            sizes, folds = [], []
            for hashes in shingle_sets(data, offsets, n):
                sizes.append(len(hashes))
                folds.append([narrow_sketch(hashes, b, threshold) for b, _ in bands_of(len(hashes), threshold)] if len(hashes) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(folds, pa.list_(pa.binary()))], ["doc_id", "n_shingles", "folds"])

    return run


def verify_groups(n: int, threshold: tuple[int, int]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Links between a group's pivot and its other documents, by their whole sets."""
        p, q = threshold
        blob = [t.encode() if t else b"" for t in rows.text]
        offsets = np.cumsum([0, *map(len, blob)])
        sets = list(shingle_sets(np.frombuffer(b"".join(blob), np.uint8), offsets, n))
        pivots = [s for s, lead in zip(sets, rows["lead"]) if lead]
        out = []
        for doc, lead, own in zip(rows.doc_id, rows["lead"], sets):
            for other in [] if lead else pivots:
                both = len(np.intersect1d(own, other, assume_unique=True))
                if len(own) and q * both >= p * (len(own) + len(other) - both):
                    out.append((int(doc), int(rows["pivot"].iloc[0])))
                    break
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def verified(pairs: DataFrame, docs: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. `near` bounds a pivot b's partners of one kind, which are dealt to groups of about 64."""
    salted = pairs.withColumn("of", F.ceil(F.col("near") / 64)).withColumn("salt", F.pmod(F.xxhash64("a"), F.col("of")))
    members = salted.select(F.col("b").alias("pivot"), "of", "salt", F.col("a").alias("doc_id"), F.lit(False).alias("lead"))
    leads = salted.select(F.col("b").alias("pivot"), "of", "salt").distinct().select("pivot", "of", "salt", F.col("pivot").alias("doc_id"), F.lit(True).alias("lead"))
    wanted = stored(members.union(leads), "wanted")
    texts = only_ids(docs.select("doc_id", "text"), wanted, "doc_id")
    return wanted.join(texts, "doc_id").groupBy("pivot", "of", "salt").applyInPandas(verify_groups(n, threshold), "a long, b long")


def cross_pairs(threshold: tuple[int, int]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Of each group (key, i, j): pairs across components between its two blocks, unless sketches or sizes rule them out."""
        p, q = threshold
        rows = rows.sort_values(["key", "i", "j"])
        where = rows[["key", "i", "j"]].to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]).any(axis=1), [True])))
        all_ids, all_comps, all_sizes, all_blocks = (rows[c].to_numpy() for c in ("doc_id", "component", "n_shingles", "block"))
        folds = rows["folds"].to_numpy()
        out: dict[tuple[int, int], int] = {}
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            comps = all_comps[lo:hi]
            if (comps == comps[0]).all():
                continue
            ids, sizes, blocks = all_ids[lo:hi], all_sizes[lo:hi], all_blocks[lo:hi]
            # The group's key is of one band; each document has the sketch of that width.
            widths = set.intersection(*({len(x) for x in f} for f in folds[lo:hi]))
            width = min(widths, default=0)
            # No common width: two bands' keys collide. Then no sketch rules a pair out.
            bits = np.frombuffer(b"".join(next(x for x in f if len(x) == width) for f in folds[lo:hi]), np.uint64).reshape(hi - lo, -1) if width else np.zeros((hi - lo, 1), np.uint64)
            one = where[lo][1] == where[lo][2]
            for k in range(hi - lo) if one else np.flatnonzero(blocks == where[lo][1]).tolist():
                near = (comps != comps[k]) & (q * np.minimum(sizes, sizes[k]) >= p * np.maximum(sizes, sizes[k]))
                near &= ids > ids[k] if one else blocks == where[lo][2]
                near = np.flatnonzero(near)
                if len(near):
                    apart = np.bitwise_count(bits[near] ^ bits[k]).sum(axis=1)
                    near = near[apart * (q + p) <= (q - p) * (sizes[near] + sizes[k])]
                    for d in ids[near].tolist():
                        out[max(int(ids[k]), d), min(int(ids[k]), d)] = len(near)
        return pd.DataFrame([(a, b, m) for (a, b), m in sorted(out.items())], columns=["a", "b", "near"]).astype("int64")

    return run


def jaccard_components(docs: DataFrame, n: int = 3, threshold: tuple[int, int] = (9, 10)) -> DataFrame:
    """Link documents whose sets of distinct n-word shingles have a similarity of `threshold` (p, q: p / q) or more.

    Words are runs of characters other than white space, A-Z lower-cased. Returns doc_id, n_shingles and
    component_id, the smallest doc_id reachable over links, one row for each row of `docs`. A document of
    fewer than n words has one shingle, all its words; one without words or text has none, and links with
    nothing. A null doc_id links with nothing and gets a null component. Rows with one doc_id count as linked.
    Only doc_id and text are read. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    packs = bucketed(docs.mapInArrow(sketch_documents(n, threshold), PACKS), "pack", max(8, min(100_000, n_bytes // PACK_BYTES)), "sketches")
    listed = packs.select("pack", "ids", "known", "sizes", "set_keys").mapInArrow(list_documents, "pack long, place long, doc_id long, n_shingles long, set_key binary")
    known = listed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = stored(known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.collect_set("pack").alias("packs")), "classes")
    several = classes.filter("rep < last").select("set_key", "rep", F.explode("packs").alias("pack"))
    places = known.join(several, ["set_key", "pack"]).filter("doc_id > rep").groupBy("pack").agg(F.collect_list("place").alias("places"))
    copies = stored(places.mapInArrow(pack_places, "pack long, copies binary"), "copies")

    # About one key for every 16 bytes of text.
    n_buckets = max(8, -(-n_bytes // (2 * BUCKET_BYTES)))
    sent = together(packs, [copies], send_keys(n_buckets), "bucket long, pack long, hashes binary, many binary")
    repeats = stored(dealt(sent, "bucket", n_buckets).applyInPandas(find_repeats, "pack long, bucket long, repeats binary"), "repeats")
    hits = stored(together(packs, [copies, repeats], find_hits(n_buckets), "key long, pack long, doc_id long"), "hits")
    shared = hits.groupBy("key").agg(F.min("doc_id").alias("low"), F.count("*").alias("near"), F.collect_set("pack").alias("packs"))
    paired = hits.join(shared.withColumn("pack", F.explode("packs")).drop("packs"), ["key", "pack"])
    stars = stored(paired.filter("doc_id <> low").groupBy(F.col("doc_id").alias("a"), F.col("low").alias("b")).agg(F.max("near").alias("near")), "stars")
    links = stored(verified(stars, docs, n, threshold), "links")
    # One doc_id with two sets stands in two classes and so joins them.
    first = components(links, "first")

    placed = hits.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.ceil(F.count("*") / BLOCK).alias("blocks"), F.collect_set("pack").alias("packs")).filter("x < y")
    open_ = placed.join(mixed.select("key", "blocks", F.explode("packs").alias("pack")), ["key", "pack"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    open_ = stored(open_.drop("pack"), "open")
    folds = stored(only_ids(docs, open_, "doc_id").mapInArrow(fold_documents(n, threshold), "doc_id long, n_shingles long, folds array<binary>"), "folds")
    groups = open_.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    groups = groups.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "component")
    groups = groups.join(folds, "doc_id")
    weight = groups.agg(F.sum(F.aggregate("folds", F.lit(256).cast("long"), lambda n, x: n + F.octet_length(x)))).first()[0] or 0
    buckets = max(8, -(-weight // OPEN_BYTES))
    groups = groups.withColumn("bucket", F.pmod(F.xxhash64("key", "i", "j"), F.lit(buckets))).repartition(buckets, "bucket")
    crossed = groups.groupBy("bucket").applyInPandas(cross_pairs(threshold), "a long, b long, near long").groupBy("a", "b").agg(F.max("near").alias("near"))
    crossed = stored(crossed.join(stars.select("a", "b"), ["a", "b"], "left_anti"), "crossed")
    more = stored(verified(crossed, docs, n, threshold), "more")
    last = components(links.union(more), "last")

    # Classes of one doc_id with two sets, and of several documents: known by (set, pack).
    of_class = classes.join(last.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.explode("packs").alias("pack"), F.coalesce("component", "rep").alias("component"))
    out = listed.join(of_class, ["set_key", "pack"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 3, threshold: tuple[int, int] = (9, 10)) -> DataFrame:
    """`docs` with only the document of the smallest doc_id of each group of linked ones.

    Rows of a null doc_id all stay; rows of one doc_id are one document, which stays or goes as a whole.
    """
    return without_ids(docs, jaccard_components(docs, n, threshold).filter("component_id <> doc_id"))


def op10_jaccard_parity_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents at 3-word shingles and a similarity of 0.9."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
