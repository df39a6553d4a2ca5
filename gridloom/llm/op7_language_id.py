"""Language identification by rank-order profiles of byte n-grams and their out-of-place distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_view, slices, toxic_free_crc

#: n-grams in a profile; the same number of a document's n-grams is ranked.
PROFILE = 400
#: A-Z lower-cased, other ASCII than letters to space; bytes above 127 belong to letters.
LETTERS = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256)], np.uint8)
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[97:123] = True


def gram_codes(text: np.ndarray) -> np.ndarray:
    """Codes of all 1-, 2- and 3-byte grams (length in the top byte); of runs of spaces only one counts."""
    if len(text) > 1:
        text = text[np.concatenate(([True], (text[1:] != 32) | (text[:-1] != 32)))]
    x = text.astype(np.uint32)
    two = (x[:-1] << 8) | x[1:]
    return np.concatenate((x[x != 32] | (1 << 24), two | (2 << 24), ((two[:-1] << 8) | x[2:]) | (3 << 24)))


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.empty(0, np.int64)
    return codes[first], np.diff(np.append(first, len(codes)))


def ranked(codes: np.ndarray) -> np.ndarray:
    """The most frequent grams first, equals by code."""
    values, counts = counted(codes)
    if len(values) > PROFILE:
        least = np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
        keep = counts >= least
        values, counts = values[keep], counts[keep]
    return values[np.argsort(-counts, kind="stable")][:PROFILE]


def count_grams(batches):
    """(lang, text) to (lang, code, n): sums over each piece of a batch."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        data, offsets = byte_view(batch.column(1))
        data = LETTERS[data]
        for lang in sorted(set(langs)):
            at = np.flatnonzero(langs == lang)
            sizes = (offsets[at + 1] - offsets[at]) + 1
            parts, held = [], 0
            for k, size in zip(at.tolist(), sizes.tolist()):
                parts.append(data[offsets[k] : offsets[k + 1]])
                parts.append(np.array([32], np.uint8))
                held += size
                if held > 8 << 20 or k == at[-1]:
                    values, counts = counted(gram_codes(np.concatenate(parts)))
                    parts, held = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values)), pa.array(values.astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "code", "n"])


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def predict(shared, batches):
    langs, grams, ranks = shared.value
    for batch in batches:
        raw, offsets = byte_view(batch.column(1))
        held = LETTERS[raw]
        pred, score = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            text = held[a:b]
            if not (ASCII_LETTER[text].any() or has_letter(raw[a:b].tobytes())):
                pred.append("und")
                score.append(0.0)
                continue
            own = ranked(gram_codes(text))
            if not len(langs) or not len(own):
                pred.append("und")
                score.append(0.0)
                continue
            place = np.searchsorted(grams, own)
            place[place == len(grams)] = 0
            known = grams[place] == own
            # ranks: one row a language, PROFILE where the language lacks the gram.
            apart = np.where(known & (ranks[:, place] < PROFILE), np.abs(ranks[:, place] - np.arange(len(own))), PROFILE).sum(axis=1)
            best = int(np.argmin(apart))
            pred.append(langs[best])
            score.append(1.0 - float(apart[best]) / (PROFILE * len(own)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def language_profiles(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Profiles of all languages from all training rows. Counts are summed on Spark; PROFILE rows a language come back."""
    training = docs.filter("lang IS NOT NULL AND text IS NOT NULL").filter(toxic_free_crc() != 1).select("lang", "text")
    counts = training.mapInArrow(count_grams, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counts.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < PROFILE).select("lang", "code", "rank").toPandas()
    langs = sorted(top["lang"].unique(), key=lambda x: x.encode())
    grams = np.unique(top["code"].to_numpy().astype(np.uint32)) if len(top) else np.empty(0, np.uint32)
    ranks = np.full((len(langs), len(grams)), PROFILE, np.int64)
    if len(top):
        ranks[pd.Index(langs).get_indexer(top["lang"]), np.searchsorted(grams, top["code"].to_numpy().astype(np.uint32))] = top["rank"]
    return langs, grams, ranks


def identify_languages(docs: DataFrame) -> DataFrame:
    """Predict the language of each row of `docs`: doc_id, held_out, lang_pred, score (0 to 1, 1: no n-gram out of place).

    Profiles come from the text and non-null lang of all rows whose crc32(doc_id) mod 3 is not 1. 'und' and 0
    if the text is null or has no letter, or nothing was learned. Equal distances go to the language first by
    code point. Whole texts are read; columns other than doc_id, text and lang are not.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    shared = docs.sparkSession.sparkContext.broadcast(language_profiles(docs))
    held = docs.select("doc_id", "text", (toxic_free_crc() == 1).alias("held_out"))
    return held.mapInArrow(lambda batches: predict(shared, batches), "doc_id long, held_out boolean, lang_pred string, score double")


def op7_rank_order_languages(spark, sf_dir: str) -> DataFrame:
    """The predicted language of every whole text of documents."""
    return identify_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
