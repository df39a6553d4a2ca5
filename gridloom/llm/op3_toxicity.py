"""Toxicity: a logistic classifier with counterfactual regularisation.

Trained by gradient descent on a bounded sample of labelled documents. For each sampled text that names a group,
a copy with the identity terms swapped is made; besides the log loss, the squared change of the score (its
logit) between the two is penalised, so that the mere mention of a group does not move the score.

Features are the distinct words of a text, and for each stem (a word's first 4 to 8 bytes) how many distinct words
share it: at least 1, 2 or 3, and at least one in 200, 100 or 50 of all words. Spark counts them over the sample;
those whose share differs most between the classes stay, and only their numbers go to the driver.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import each_text, stored, toxic_free_crc, whole_row

# Identity terms, each list's terms stand in for one another.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender people"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "trans", "nonbinary"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young", "elderly"),
    ("blind", "deaf", "disabled"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwule", "lesben", "heterosexuelle", "bisexuelle"),
    ("ausländer", "flüchtlinge", "einwanderer", "einheimische"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("étrangers", "réfugiés", "immigrés", "autochtones"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("extranjeros", "refugiados", "inmigrantes", "nativos"),
)
SWAPS = {terms[i].encode(): terms[(i + 1) % len(terms)].encode() for terms in IDENTITY_TERMS for i in range(len(terms))}
SWAP = re.compile(rb"(?<![\x80-\xff\w])(?:" + b"|".join(sorted(SWAPS, key=len, reverse=True)) + rb")(?![\x80-\xff\w])")
#: Labelled documents, about, in the training sample; documents that a feature needs, features kept, standard errors by
#: which a feature's share must differ between the classes; training steps.
SAMPLE_ROWS = 6000
MIN_DOCS = 4
FEATURES = 3000
CONTRAST = 4.0
STEPS = 600
PAIR_WEIGHT = 1.0
RIDGE = 1e-4
#: Stems in bytes; levels of a stem by its distinct words, and by one in so many words.
STEMS = (4, 5, 6, 7, 8)
COUNTS = (1, 2, 3)
SHARES = (200, 100, 50)
#: Words longer than this are features by their stems only.
LONGEST = 64
#: Words whose features a worker remembers.
CACHED = 50_000
#: Bytes that are no letters, A-Z lower-cased: bytes above 127 belong to letters.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def levels(stem: bytes, n: int, n_words: int) -> list[bytes]:
    """The features of a stem that n distinct words share, in a text of n_words words."""
    return [b"%d+%s" % (c, stem) for c in COUNTS if n >= c] + [b"1/%d %s" % (s, stem) for s in SHARES if n * s >= n_words]


def features_of(text: bytes) -> set[bytes]:
    words = text.translate(LETTERS).split()
    distinct = set(words)
    stems = Counter(w[:k] for w in distinct for k in STEMS if len(w) >= k)
    return {w for w in distinct if len(w) <= LONGEST} | {f for stem, n in stems.items() for f in levels(stem, n, len(words))}


def swapped(text: bytes) -> bytes:
    """The text with each identity term replaced by the next one of its list; lower case."""
    return SWAP.sub(lambda m: SWAPS[m[0]], text.lower())


def count_features(batches):
    """(text, toxic) to (feature, clean, toxic): documents that have it, summed over a batch."""
    for batch in batches:
        counts: dict[bytes, list[int]] = {}
        for text, toxic in zip(each_text(batch.column(0)), batch.column(1).to_pylist()):
            for f in features_of(text):
                counts.setdefault(f, [0, 0])[toxic] += 1
        clean, toxic = zip(*counts.values()) if counts else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(clean, pa.int64()), pa.array(toxic, pa.int64())], ["feature", "clean", "toxic"])


def number_features(index: dict[bytes, int]):
    def run(batches):
        """(text, toxic) to toxic, the text's features, and those that its swapped form gains and loses (int32 bytes)."""
        packed = lambda fs: np.array(sorted(index[f] for f in fs if f in index), np.int32).tobytes()
        for batch in batches:
            out = []
            for text in each_text(batch.column(0)):
                own, other = features_of(text), swapped(text)
                other = own if other == text.lower() else features_of(other)
                out.append((packed(own), packed(other - own), packed(own - other)))
            columns = zip(*out) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c, pa.binary()) for c in columns)], ["toxic", "own", "came", "gone"])

    return run


def train(y: np.ndarray, own: list[np.ndarray], came: list[np.ndarray], gone: list[np.ndarray], m: int, pair_weight: float = PAIR_WEIGHT) -> tuple[np.ndarray, float]:
    """Weights of m features and the intercept, by full-batch gradient descent with momentum."""
    if not len(y):
        return np.zeros(m), -2.0

    def entries(rows):
        return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)

    r, c = entries(own)
    # The difference of a pair's features; its product with the weights is the change of the logit.
    (r1, c1), (r2, c2) = entries(came), entries(gone)
    dr, dc, sign = np.concatenate((r1, r2)), np.concatenate((c1, c2)), np.repeat((1.0, -1.0), (len(r1), len(r2)))
    pairs = max(1, len(np.unique(dr)))
    n = len(y)
    # Each class weighs half; a feature's step is scaled by how often it occurs.
    share = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, n - y.sum()))
    scale = 1.0 / np.sqrt(np.bincount(c, weights=share[r], minlength=m) + 1e-4)
    w, b, vw, vb = np.zeros(m), 0.0, np.zeros(m), 0.0
    for _ in range(STEPS):
        z = np.bincount(r, weights=w[c], minlength=n) + b
        error = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gradient = np.bincount(c, weights=error[r], minlength=m) + RIDGE * w
        if len(dr):
            change = np.bincount(dr, weights=sign * w[dc], minlength=n)
            gradient += pair_weight * 2 / pairs * np.bincount(dc, weights=sign * change[dr], minlength=m)
        vw = 0.9 * vw - 0.05 * gradient * scale
        vb = 0.9 * vb - 0.5 * error.sum()
        w, b = w + vw, b + vb
    return w, float(b)


def score_texts(model, texts):
    """Scores of an Arrow column of texts. `model`: weights of words, stems' features (stem to its level weights), intercept."""
    words, stems, intercept, cache = model
    z = np.full(len(texts), intercept)
    for k, text in enumerate(each_text(texts)):
        own = text.translate(LETTERS).split()
        counts: dict[bytes, int] = {}
        total = 0.0
        for w in set(own):
            known = cache.get(w)
            if known is None:
                known = (words.get(w, 0.0), [w[:s] for s in STEMS if len(w) >= s and w[:s] in stems])
                if len(cache) > CACHED:
                    cache.clear()
                if len(w) <= LONGEST:
                    cache[w] = known
            total += known[0]
            for stem in known[1]:
                counts[stem] = counts.get(stem, 0) + 1
        for stem, n in counts.items():
            total += sum(stems[stem].get(f, 0.0) for f in levels(stem, n, len(own)))
        z[k] += total
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, pair_weight: float = PAIR_WEIGHT):
    """The model of `docs` (doc_id, text) and `labels` (doc_id, toxic)."""
    ids = F.col("doc_id").cast("long").alias("doc_id")
    usable = labels.select(ids, F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(toxic_free_crc() != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = usable.count()
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, sample_rows / max(1, n)) * (1 << 30)))
    sample = stored(docs.select(ids, "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic").repartition(16), "sample")  # at most about sample_rows ids
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_clean or not n_toxic:
        return {}, {}, -2.0, {}
    counts = sample.mapInArrow(count_features, "feature binary, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    p = (F.col("clean") + F.col("toxic") + 0.5) / (n_clean + n_toxic + 1)
    contrast = F.abs(F.col("toxic") / n_toxic - F.col("clean") / n_clean) / F.sqrt(p * (1 - p) * (1 / n_toxic + 1 / n_clean))
    best = counts.filter(F.col("clean") + F.col("toxic") >= MIN_DOCS).withColumn("z", contrast).filter(F.col("z") >= CONTRAST).orderBy(F.desc("z"), "feature").limit(FEATURES)
    features = [bytes(r.feature) for r in best.select("feature").collect()]
    rows = sample.mapInArrow(number_features({f: k for k, f in enumerate(features)}), "toxic int, own binary, came binary, gone binary").collect()
    arrays = [[np.frombuffer(r[c], np.int32) for r in rows] for c in (1, 2, 3)]
    w, intercept = train(np.array([r.toxic for r in rows], float), *arrays, len(features), pair_weight)
    words: dict[bytes, float] = {}
    stems: dict[bytes, dict[bytes, float]] = {}
    for f, weight in zip(features, w.tolist()):
        stem = re.sub(rb"^(?:\d\+|1/\d+ )", b"", f)
        if stem == f:
            words[f] = weight
        else:
            stems.setdefault(stem, {})[f] = weight
    return words, stems, intercept, {}


def scored_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, pair_weight: float = PAIR_WEIGHT) -> DataFrame:
    """Each row of `docs`, whole, as the struct `row`, with its score. No join: repeated and null ids do not matter."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample_rows, pair_weight))  # FEATURES numbers
    frame = docs.select(whole_row(docs))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(shared.value, batch.column(0).field("text")))], ["row", "score"])

    return frame.mapInArrow(run, StructType([frame.schema["row"], StructField("score", DoubleType())]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, pair_weight: float = PAIR_WEIGHT) -> DataFrame:
    """Score each row of `docs`: doc_id, held_out, score (0 to 1), predicted (1 from 0.7).

    Learns from rows whose crc32(doc_id) mod 3 is not 1 and whose label `toxic` is 0 or 1 (others are ignored),
    about `sample_rows` of them, chosen by a hash of the id. Of contradicting labels of one doc_id 1 counts. Null
    and empty texts have no features and get the intercept's score. Unless there are usable labels of both
    classes, all scores are low. Only doc_id, text, toxic are read; repeated labels count once. An empty table
    gives no rows. Scoring reads every whole text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = scored_rows(docs, labels, sample_rows, pair_weight).select("row.doc_id", "score")
    return scored.select("doc_id", (toxic_free_crc() == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, each by its own text, whatever its doc_id."""
    return scored_rows(docs, labels).filter("score < 0.7").select("row.*")


def op3_counterfactual_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of every whole text of documents."""
    return toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
