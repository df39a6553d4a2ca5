"""Substring deduplication with suffix arrays over shards of the corpus.

Which 50-byte strings can repeat at all is found first from anchors, so that suffix arrays are built only
where a repeat is possible:

1. Documents are packed, about 8 MB a row, into a table bucketed by pack, so later steps join small replies to
   the packs without moving texts again. A document whose whole text occurs under a smaller doc_id is covered
   as a whole; only the others ("heads") go on.
2. Every window of `min_bytes` bytes has an anchor: its smallest hashed k-gram (leftmost of equals). Equal
   windows have equal anchors. Each pack sends its distinct anchor hashes, 8 bytes each, to the hash's bucket,
   which replies, one bit for each hash, which anchors occur in at least two documents.
3. The run of windows that share such an anchor is a unit. Each pack sends its units' anchor and content
   hashes with the smallest doc_id. The bucket replies which units have a twin of the same bytes under a
   smaller doc_id (they are covered as a whole) and whose anchor has several contents.
4. Of the latter, the first of each content is sent as text to the shard of its anchor. There the suffixes of
   all units are sorted by induced sorting; neighbours with a common prefix of `min_bytes` are the same window,
   and the smallest doc_id of each such class decides. An anchor with very many contents would load one shard:
   its windows are sent singly, to the shards of their own content.
5. The packs cut the covered bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import BYTE_KEYS, bucketed, byte_view, mix64, range_hashes, slices, stored, whole_row
from .packs import asked, bits_for, cuts, dealt, find_repeats, pack_places, runs, sorted_anchors, together
from .suffix_arrays import common_prefixes, suffix_array

PACK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
HOT_CONTENTS = 4096
SHARDS = 4
NO_ID = np.iinfo(np.int64).max
PIECE = 1 << 14

PACKS = "pack long, ids binary, sizes binary, digests binary, blob binary, n_bytes long, rows binary"
#: The columns that every step but the last needs.
TEXTS = ["pack", "ids", "sizes", "blob", "n_bytes"]


def pack_documents(batches):
    """Rows (doc_id, text, row) into packs; a pack's number holds its partition and its place there. A null doc_id sorts as the largest."""
    part, k = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids = np.array(batch.column(0).fill_null(NO_ID), np.int64)
        data, offsets = byte_view(batch.column(1))
        for i, j in slices(offsets, PACK_BYTES):
            blob = data[offsets[i] : offsets[j]].tobytes()
            sizes = np.diff(offsets[i : j + 1])
            ends = np.cumsum(sizes)
            digests = b"".join(hashlib.blake2b(blob[e - s : e], digest_size=16).digest() for s, e in zip(sizes.tolist(), ends.tolist()))
            row = [[(part << 32) + k], [ids[i:j].tobytes()], [sizes.tobytes()], [digests], [zstandard.compress(blob, 1)], [len(blob)], [frozen(batch.column(2).slice(i, j - i))]]
            k += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if m in (0, 5) else pa.binary()) for m, x in enumerate(row)], [c.split()[0] for c in PACKS.split(", ")])


def frozen(rows: pa.Array) -> bytes:
    """A column as Arrow's own bytes, compressed."""
    batch = pa.RecordBatch.from_arrays([rows], ["row"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def thawed(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_all().column(0).combine_chunks()


def unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A pack's doc_ids, document sizes and bytes."""
    blob = zstandard.decompress(row.blob, max_output_size=row.n_bytes) if row.n_bytes else b""
    return np.frombuffer(row.ids, np.int64), np.frombuffer(row.sizes, np.int64), np.frombuffer(blob, np.uint8)


def window_anchors(piece: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of w k-grams: the place of its smallest hashed k-gram, and that hash."""
    h, width, grams, gram = BYTE_KEYS[piece], 1, None, 0
    while True:
        if k & width:
            if grams is None:
                grams, gram = h, width
            else:
                n = len(piece) - gram - width + 1
                grams, gram = grams[:n] * np.uint64(0x9FB21C651E98DF25 + 2 * width) + h[gram : gram + n], gram + width
        if width * 2 > k:
            break
        h = h[:-width] * np.uint64(0xC2B2AE3D27D4EB4F + 2 * width) + h[width:]
        width *= 2
    reach, span = (grams & ~np.uint64(0x3FFFF)) | np.arange(len(grams), dtype=np.uint64), 1
    while span * 2 <= w:
        reach = np.minimum(reach[:-span], reach[span:])
        span *= 2
    if span < w:
        reach = np.minimum(reach[: len(reach) - (w - span)], reach[w - span :])
    place = (reach & np.uint64(0x3FFFF)).astype(np.int64)
    return place, grams[place]


def units_of(row, copies, min_bytes: int, contents: bool):
    """A pack's ids, bytes and units (first window, windows, anchor hash, content hash, document).

    A unit is a run of windows with one anchor in one document; `copies` lists documents left out.
    """
    ids, sizes, data = unpack(row)
    k = max(1, min(24, min_bytes // 2))
    w = min_bytes - k + 1
    ends = np.cumsum(sizes)
    head = np.ones(len(ids), bool)
    for x in copies:
        head[np.frombuffer(x, np.int64)] = False
    parts = []
    for lo in range(0, max(0, len(data) - min_bytes + 1), PIECE):
        piece = data[lo : lo + PIECE + min_bytes - 1]
        place, hashes = window_anchors(piece, k, w)
        here = np.arange(lo, lo + len(place))
        near = slice(*np.searchsorted(ends, (lo, lo + len(place)), "right") + (0, 1))
        doc = np.repeat(np.arange(near.start, min(near.stop, len(ends))), np.diff(np.clip(ends[near], lo, lo + len(place)), prepend=lo))
        valid = (ends[doc] - here >= min_bytes) & head[doc]
        change = np.ones(len(place), bool)
        change[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(change)
        count = np.diff(np.append(first, len(place)))
        keep = valid[first]
        first, count = first[keep], count[keep]
        content = np.empty(0, np.uint64)
        if contents:
            content = range_hashes(BYTE_KEYS[piece], first, first + count + min_bytes - 1)
        parts.append((first + lo, count, mix64(hashes[first]), content, doc[first]))  # smallest hashes are small: mix them to deal evenly
    if not parts:
        empty = np.empty(0, np.int64)
        return ids, data, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty
    return ids, data, *(np.concatenate(x) for x in zip(*parts))


def send_anchors(n_buckets: int, min_bytes: int):
    def run(packs: pd.DataFrame, copies: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in packs.itertuples():
            ids, _, _, _, hashes, _, doc = units_of(row, copies["copies"], min_bytes, contents=False)
            h, many = sorted_anchors(hashes, ids[doc])
            out += [(b, row.pack, h[i:j].tobytes(), np.packbits(many[i:j]).tobytes()) for b, i, j in cuts(h, n_buckets)]
        return pd.DataFrame(out, columns=["bucket", "pack", "hashes", "many"])

    return run


def repeated_units(row, replies: pd.DataFrame, n_buckets: int, min_bytes: int):
    """The units of a pack whose anchors repeat, sorted by (anchor, content, doc_id), and where contents begin."""
    ids, data, first, count, hashes, content, doc = units_of(row, replies["copies"].dropna(), min_bytes, contents=True)
    h, _ = sorted_anchors(hashes, ids[doc])
    repeats = bits_for(replies[replies["repeats"].notna()], "repeats", h, n_buckets)
    keep = np.flatnonzero(repeats[np.searchsorted(h, hashes)]) if len(h) else np.empty(0, np.int64)
    owner = ids[doc[keep]]
    order = np.lexsort((owner, content[keep], hashes[keep]))
    keep, owner = keep[order], owner[order]
    return data, first[keep], count[keep], hashes[keep], content[keep], owner, runs(hashes[keep], content[keep]) if len(keep) else keep


def send_contents(n_buckets: int, min_bytes: int):
    def run(packs: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in packs.itertuples():
            _, _, _, h, c, owner, lead = repeated_units(row, replies, n_buckets, min_bytes)
            h, c, owner = h[lead], c[lead], owner[lead]
            out += [(b, row.pack, h[i:j].tobytes(), c[i:j].tobytes(), owner[i:j].tobytes()) for b, i, j in cuts(h, n_buckets)]
        return pd.DataFrame(out, columns=["bucket", "pack", "hashes", "contents", "owners"])

    return run


def find_contents(hot_contents: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Reply to each pack, for each content: the smallest doc_id that has it, and bits for 'sort' and 'hot'."""
        h, c = (np.concatenate([np.frombuffer(x, np.uint64) for x in rows[k]]) for k in ("hashes", "contents"))
        d = np.concatenate([np.frombuffer(x, np.int64) for x in rows.owners])
        order = np.lexsort((d, c, h))
        lead = runs(h[order], c[order])
        least = d[order][lead]
        anchor = runs(h[order][lead])
        contents = np.diff(np.append(anchor, len(lead)))
        sizes = np.diff(np.append(lead, len(order)))
        owner, sort, hot = np.empty(len(d), np.int64), np.empty(len(d), bool), np.empty(len(d), bool)
        owner[order] = np.repeat(least, sizes)
        several = np.minimum.reduceat(least, anchor) < np.maximum.reduceat(least, anchor)
        sort[order] = np.repeat(np.repeat(several, contents), sizes)
        hot[order] = np.repeat(np.repeat(contents >= hot_contents, contents), sizes)
        edges = np.cumsum([len(x) // 8 for x in rows.owners])[:-1]
        return pd.DataFrame(
            {
                "pack": rows["pack"],
                "bucket": rows["bucket"],
                "smaller": [np.packbits(x).tobytes() for x in np.split(owner < d, edges)],
                "sort": [np.packbits(x).tobytes() for x in np.split(sort & (owner == d), edges)],
                "hot": [np.packbits(x).tobytes() for x in np.split(hot, edges)],
            }
        )

    return run


def send_units(n_buckets: int, min_bytes: int, n_shards: int):
    def run(packs: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        """Rows for shards (texts with owner and places), and for the pack itself (shard null) covered runs."""
        out = []
        told = replies[replies["sort"].notna()]
        for row in packs.itertuples():
            data, first, count, h, _, owner, lead = repeated_units(row, replies, n_buckets, min_bytes)
            if not len(lead):
                continue
            smaller, sort, hot = (bits_for(told, x, h[lead], n_buckets) for x in ("smaller", "sort", "hot"))
            sizes = np.diff(np.append(lead, len(h)))
            first_owner = np.repeat(owner[lead], sizes)
            covered = np.repeat(smaller, sizes) | (owner > first_owner)
            begin, span = joined_runs(first[covered], count[covered])
            if len(begin):
                out.append((None, row.pack, b"", b"", begin.tobytes(), b"", span.tobytes()))
            # Of each content only the places in its owner's document are open.
            open_ = np.repeat(sort, sizes) & ~covered
            units: dict[int, list] = {}
            for i in np.flatnonzero(open_).tolist():
                start, windows = int(first[i]), int(count[i])
                alone = hot[np.searchsorted(lead, i, "right") - 1]
                for s, c in [(start + x, 1) for x in range(windows)] if alone else [(start, windows)]:
                    text = data[s : s + c + min_bytes - 1].tobytes()
                    key = int.from_bytes(hashlib.blake2b(text, digest_size=4).digest(), "little") if alone else int(h[i]) >> 32
                    units.setdefault(key * n_shards >> 32, []).append((text, owner[i], s))
            for shard, held in units.items():
                out.append((
                    shard,
                    row.pack,
                    np.array([len(t) for t, _, _ in held], np.int32).tobytes(),
                    np.array([o for _, o, _ in held], np.int64).tobytes(),
                    np.array([s for _, _, s in held], np.int64).tobytes(),
                    zstandard.compress(b"".join(t for t, _, _ in held), 1),
                    b"",
                ))
        return pd.DataFrame(out, columns=["shard", "pack", "lengths", "owners", "begins", "blob", "spans"]).astype({"shard": "Int64"})

    return run


UNITS = "shard long, pack long, lengths binary, owners binary, begins binary, blob binary, spans binary"


def joined_runs(begin: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows, those that touch joined to one."""
    order = np.argsort(begin)
    begin, end = begin[order], (begin + span)[order]
    if not len(begin):
        return begin, span
    new = np.flatnonzero(np.concatenate(([True], begin[1:] > np.maximum.accumulate(end)[:-1])))
    return begin[new], np.maximum.reduceat(end, new) - begin[new]


def window_owners(texts: list[bytes], owners: np.ndarray, min_bytes: int) -> list[np.ndarray]:
    """For each window of each text, the smallest owner of any text that holds it; from one suffix array."""
    lengths = np.array([len(t) for t in texts], np.int64)
    joined = np.frombuffer(b"\0".join(texts), np.uint8).astype(np.int64) + 1
    starts = np.cumsum(np.append(0, lengths[:-1] + 1))
    joined[starts[1:] - 1] = 0
    unit = np.repeat(np.arange(len(texts)), lengths + 1)[: len(joined)]
    left = starts[unit] + lengths[unit] - np.arange(len(joined))
    sa = suffix_array(joined)
    prefix = common_prefixes(joined, sa, min_bytes)
    window = left[sa] >= min_bytes
    sa = sa[window]
    # Suffixes between two equal windows share the window, so they are windows as well.
    group = np.cumsum(prefix[window] < min_bytes)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    least = np.minimum.reduceat(owners[unit[sa]], first) if len(sa) else np.empty(0, np.int64)
    of = np.zeros(len(joined), np.int64)
    of[sa] = np.repeat(least, np.diff(np.append(first, len(sa))))
    return [of[s : s + n - min_bytes + 1] for s, n in zip(starts.tolist(), lengths.tolist())]


def judge_units(min_bytes: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Reply to each pack the runs of windows (start in the pack, windows) with a smaller owner."""
        texts: dict[bytes, int] = {}
        owner: list[int] = []
        which = []
        for row in rows.itertuples():
            lengths = np.frombuffer(row.lengths, np.int32)
            ends = np.cumsum(lengths)
            blob = zstandard.decompress(row.blob, max_output_size=int(ends[-1]))
            own = []
            for e, n, o in zip(ends.tolist(), lengths.tolist(), np.frombuffer(row.owners, np.int64).tolist()):
                k = texts.setdefault(blob[e - n : e], len(owner))
                if k == len(owner):
                    owner.append(o)
                owner[k] = min(owner[k], o)
                own.append(k)
            which.append(own)
        least = window_owners(list(texts), np.array(owner, np.int64), min_bytes)
        sizes = np.array([len(x) for x in least], np.int64)
        offsets, least = np.cumsum(sizes) - sizes, np.concatenate(least)
        out = []
        for row, own in zip(rows.itertuples(), which):
            docs, starts, size = np.frombuffer(row.owners, np.int64), np.frombuffer(row.begins, np.int64), sizes[own]
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            covered = least[np.repeat(offsets[own], size) + within] < np.repeat(docs, size)
            begin = (np.repeat(starts, size) + within)[covered]
            if len(begin):
                begin, span = joined_runs(begin, np.ones(len(begin), np.int64))
                out.append((row.pack, begin.tobytes(), span.tobytes()))
        return pd.DataFrame(out, columns=["pack", "begins", "spans"])

    return run


def cut_documents(min_bytes: int):
    def run(packs: pa.Table, replies: pa.Table) -> pa.Table:
        """The pack's rows with what is left of their texts."""
        rows, n_bytes, n_removed, spans, kept = [], [], [], [], []
        told = replies.to_pydict()
        for row in packs.to_pandas().itertuples():
            ids, sizes, data = unpack(row)
            step = np.zeros(len(data) + 1, np.int32)
            for begins, lengths in zip(told["begins"], told["spans"]):
                if begins is not None:
                    b, s = np.frombuffer(begins, np.int64), np.frombuffer(lengths, np.int64)
                    np.add.at(step, b, 1)
                    np.add.at(step, b + s + min_bytes - 1, -1)
            gone = np.cumsum(step[:-1]) > 0
            ends = np.cumsum(sizes)
            for x in told["copies"]:
                for i in [] if x is None else np.frombuffer(x, np.int64).tolist():
                    if sizes[i] >= min_bytes:
                        gone[ends[i] - sizes[i] : ends[i]] = True
            removed = np.concatenate(([0], np.cumsum(gone)))
            for e, n in zip(ends.tolist(), sizes.tolist()):
                part = gone[e - n : e]
                r = int(removed[e] - removed[e - n])
                mark = np.flatnonzero(np.diff(np.concatenate(([False], part, [False])).astype(np.int8))).tolist() if r else []
                n_bytes.append(n)
                n_removed.append(r)
                spans.append([{"start": a, "end": b} for a, b in zip(mark[::2], mark[1::2])])
                kept.append((data[e - n : e][~part] if r else data[e - n : e]).tobytes())
            rows.append(thawed(row.rows))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [pa.chunked_array(rows) if rows else None, pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())]
        names = ["row", "n_bytes", "n_removed", "spans", "kept"]
        return pa.table(columns, names=names) if rows else pa.table({n: pa.array([], c.type if c is not None else pa.null()) for n, c in zip(names, columns)})

    return run


CUT = "n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


def cut_rows(docs: DataFrame, min_bytes: int = 50, hot_contents: int = HOT_CONTENTS) -> DataFrame:
    """Each row of `docs` (doc_id, text, others) without its text as the struct `row`, with n_bytes, n_removed, spans and kept."""
    others = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", whole_row(others))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    packs = bucketed(frame.mapInArrow(pack_documents, PACKS), "pack", max(8, min(100_000, n_bytes // PACK_BYTES)), "packs")
    texts = packs.select(*TEXTS)
    n_buckets = max(8, -(-n_bytes // BUCKET_BYTES))
    listed = packs.select("pack", "ids", "digests").mapInArrow(list_documents, "pack long, place long, doc_id long, digest binary")
    heads = listed.groupBy("digest").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last"), F.collect_set("pack").alias("packs")).filter("head < last")
    # By (digest, pack): a text of very many copies is joined in as many tasks as it has packs.
    several = heads.select("digest", "head", F.explode("packs").alias("pack"))
    copies = listed.join(several, ["digest", "pack"]).filter("doc_id > head").groupBy("pack").agg(F.collect_list("place").alias("places"))
    copies = stored(copies.mapInArrow(pack_places, "pack long, copies binary"), "copies")

    anchors = together(texts, [copies], send_anchors(n_buckets, min_bytes), "bucket long, pack long, hashes binary, many binary")
    repeats = stored(dealt(anchors, "bucket", n_buckets).applyInPandas(find_repeats, "pack long, bucket long, repeats binary"), "repeats")
    contents = together(texts, [copies, repeats], send_contents(n_buckets, min_bytes), "bucket long, pack long, hashes binary, contents binary, owners binary")
    told = stored(dealt(contents, "bucket", n_buckets).applyInPandas(find_contents(hot_contents), "pack long, bucket long, smaller binary, sort binary, hot binary"), "contents")
    units = stored(together(texts, [copies, repeats, told], send_units(n_buckets, min_bytes, SHARDS * n_buckets), UNITS), "units")
    judged = dealt(units.filter("shard IS NOT NULL").drop("spans"), "shard", SHARDS * n_buckets).applyInPandas(judge_units(min_bytes), "pack long, begins binary, spans binary")
    covered = units.filter("shard IS NULL").select("pack", "begins", "spans").union(judged)
    schema = StructType([frame.schema["row"], *StructType.fromDDL(CUT)])
    return asked(packs.select(*TEXTS, "rows"), [copies, covered]).applyInArrow(cut_documents(min_bytes), schema)


def remove_repeats(docs: DataFrame, min_bytes: int = 50, hot_contents: int = HOT_CONTENTS) -> DataFrame:
    """Remove each byte covered by a string of `min_bytes` bytes that also starts in a document with a smaller doc_id.

    Takes doc_id and text of `docs`; other columns are ignored. Returns doc_id, n_bytes, n_removed, spans
    (maximal removed runs of bytes) and kept (the remaining bytes), one row for each input row. A null text is
    empty. Rows with one doc_id never remove each other's bytes. A null doc_id counts as the largest long, so as
    larger than all others. Texts below `min_bytes` are kept whole. An empty table gives no rows.
    """
    cut = cut_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_bytes, hot_contents)
    return cut.select("row.doc_id", "n_bytes", "n_removed", "spans", "kept")


def without_repeats(docs: DataFrame, min_bytes: int = 50) -> DataFrame:
    """`docs` with the remaining bytes as text, each row by itself, whatever its doc_id; a null text stays null.

    Bytes of a character that was cut apart go, too: texts that lost bytes are read without those that are no whole
    UTF-8 character (nor replacement characters, which mark them).
    """
    known = docs.withColumn("__null", F.col("text").isNull())
    kept = F.when(F.col("n_removed") > 0, F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\ufffd", "")).otherwise(F.col("kept").cast("string"))
    text = F.when(~F.col("row.__null"), kept).alias("text")
    return cut_rows(known, min_bytes).select(*[text if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def list_documents(batches):
    for batch in batches:
        for pack, ids, digests in zip(*(c.to_pylist() for c in batch.columns)):
            ids = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), pack)), pa.array(np.arange(len(ids))), pa.array(ids), pa.array([digests[k : k + 16] for k in range(0, len(digests), 16)], pa.binary())], ["pack", "place", "doc_id", "digest"])


def op4_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """The digest of `remove_repeats` over every whole text of documents, 50 bytes."""
    cut = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
