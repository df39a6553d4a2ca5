"""Substring deduplication by sliding spans of sentences.

Every run of SENTENCES consecutive sentences is hashed, and every shorter run of at least LONG_WORDS words; a text of
fewer sentences is one run. Hashes are joined globally, and sentences covered by any run but its first occurrence go.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text, stored

#: A sentence ends after . ! or ? before white space, after the full stops of scripts without spaces, or at a line end;
#: the space after belongs to it. The three-byte marks are the ideographic full stop and the full-width ! and ?.
SENTENCE = re.compile(rb"(?:[^.!?\n\xe3\xef]|[.!?]+(?![\s.!?]|$)|\xe3(?!\x80\x82)|\xef(?!\xbc[\x81\x9f]))*(?:[.!?]+[ \t\r]*\n?|(?:\xe3\x80\x82|\xef\xbc[\x81\x9f])+|\n|$)\s*")
#: Sentences of a span; a shorter run of so many words is a span, too.
SENTENCES, LONG_WORDS = 3, 40
#: First bytes of the characters U+3000 to U+9FFF: in scripts without spaces each counts as a word.
IDEOGRAPHS = bytes(range(0xE3, 0xEA))
OTHERS = bytes(sorted(set(range(256)) - set(IDEOGRAPHS)))


def sentences_of(text: bytes) -> list[bytes]:
    """The text in sentences; joined they are the text again."""
    return [s for s in SENTENCE.findall(text) if s]


def words_in(sentence: bytes) -> int:
    """Its words by white space, or its ideographs if those are more."""
    return max(len(sentence.split()), len(sentence.translate(None, OTHERS)))


def spans_of(sentences: list[bytes]) -> list[tuple[int, int]]:
    """All spans of a text: (first, end). Runs without words are none."""
    n = len(sentences)
    counts = [0]
    for s in sentences:
        counts.append(counts[-1] + words_in(s))
    spans = [(i, i + m) for m in range(1, SENTENCES) for i in range(n - m + 1) if counts[i + m] - counts[i] >= LONG_WORDS]
    spans += [(i, i + SENTENCES) for i in range(n - SENTENCES + 1) if counts[i + SENTENCES] > counts[i]]
    return spans + ([(0, n)] if 0 < n < SENTENCES and 0 < counts[n] < LONG_WORDS else [])


def hash_spans(batches):
    """(doc_id, text, text_key, slice) to one row a span: its 128-bit hash (white space at sentence ends aside), document and sentences."""
    for batch in batches:
        ids, keys, slices = (batch.column(c).to_pylist() for c in (0, 2, 3))
        h1, h2, doc, text_key, place, first, end = [], [], [], [], [], [], []
        for d, key, part, text in zip(ids, keys, slices, each_text(batch.column(1))):
            own = sentences_of(text)
            spans = spans_of(own)
            bare = [s.strip() for s in own]
            for i, j in spans:
                h = xxhash.xxh3_128_digest(b"\n".join(bare[i:j]))
                h1.append(h[:8])
                h2.append(h[8:])
                first.append(i)
                end.append(j)
            doc += [d] * len(spans)
            text_key += [key] * len(spans)
            place += [part] * len(spans)
        whole = lambda x: pa.array(np.frombuffer(b"".join(x), np.int64))
        yield pa.RecordBatch.from_arrays([whole(h1), whole(h2), pa.array(doc, pa.int64()), pa.array(text_key, pa.int64()), pa.array(place, pa.int32()), pa.array(first, pa.int32()), pa.array(end, pa.int32())], ["h1", "h2", "doc_id", "text_key", "slice", "first", "end"])


def cut_sentences(batches):
    """(doc_id, text, covered) to the kept text; covered lists spans as pairs (first, end)."""
    for batch in batches:
        out = []
        for d, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            own = sentences_of((text or "").encode())
            gone = np.zeros(len(own), bool)
            for s in spans or []:
                gone[s["first"] : s["end"]] = True
            kept = b"".join(s for s, g in zip(own, gone) if not g).decode()
            out.append((d, len(own), int(gone.sum()), kept))
        cols = list(zip(*out)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], ["doc_id", "n_sentences", "n_removed", "kept"])


def remove_repeated_spans(docs: DataFrame) -> DataFrame:
    """Remove the sentences covered by any repeated span but its first occurrence (by doc_id, then place).

    A span is any run of SENTENCES consecutive sentences, any shorter run of LONG_WORDS words, or a whole text of
    fewer sentences; white space at sentence ends does not count. Returns doc_id, n_sentences, n_removed and kept (the
    remaining text), one row for each row of `docs`. A null or empty text has no sentences. A null doc_id comes
    after all others. Rows with one doc_id and text are one document: neither is a copy of the other. Other
    columns are ignored. An empty table gives no rows. A text without sentence ends or line ends is one sentence,
    so of two such texts only whole copies are found.

    Spans are joined to their first occurrences by (hash, slice of the input), so that a span of very many documents
    is spread over as many tasks as it has slices.
    """
    last = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    spans = docs.select(last.alias("doc_id"), "text", "text_key", F.spark_partition_id().alias("slice")).mapInArrow(hash_spans, "h1 long, h2 long, doc_id long, text_key long, slice int, first int, end int")
    spans = stored(spans, "spans")
    place = F.struct("doc_id", "text_key", "first", "end")
    leads = spans.groupBy("h1", "h2").agg(F.min(place).alias("lead"), F.max(place).alias("last"), F.collect_set("slice").alias("slices")).filter("lead < last")
    leads = leads.select("h1", "h2", "lead", F.explode("slices").alias("slice"))
    again = spans.join(leads, ["h1", "h2", "slice"]).filter(place > F.col("lead"))
    covered = again.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "end")).alias("covered"))
    covered = stored(covered.withColumnRenamed("doc_id", "__id"), "covered")
    keyed = docs.withColumn("__id", last).join(covered, ["__id", "text_key"], "left")
    return keyed.select("doc_id", "text", "covered").mapInArrow(cut_sentences, "doc_id long, n_sentences long, n_removed long, kept string")


def op8_sentence_span_dedup(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents without repeated spans."""
    cut = remove_repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cut.select("doc_id", "n_sentences", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
