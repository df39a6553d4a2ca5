"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, whole_row, with_prefix_sums

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3


def n_words(text: str = "text"):
    """Runs of characters other than white space (\\x20 and \\x09 to \\x0D); null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(seed: int):
    """A hash-random place for each document, from its id alone, so that reruns agree."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target); one row for each source.

    Sources by code point, null last, weigh 5, 2, 1, repeating, and share the total. A target stops at `most`
    times its source's size, and the excess is reshared by weight: sources are filled in the order of size
    over weight, and one is full if its share of what is left reaches its limit. Ranks and running sums come
    from range-sorted prefix sums, so any number of sources will do.
    """
    ranked = with_prefix_sums(sizes.withColumn("__all", F.lit(0)).withColumn("__one", F.lit(1)), ["__all"], ["source"], "__one", "__rank", "sources")
    place = F.pmod(F.col("__rank"), F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    limit = F.col("source_size").cast("double") * most
    ranked = stored(ranked.withColumn("__w", weight).withColumn("__limit", limit).withColumn("__full_at", limit / weight), "weighted")
    totals = ranked.agg(F.sum("source_size").cast("double"), F.sum("__w")).first()
    total, all_weights = totals[0] or 0.0, totals[1] or 1.0
    order = ["__full_at", "__rank"]
    ranked = with_prefix_sums(ranked, ["__all"], order, "__limit", "__used", "limits")
    ranked = with_prefix_sums(ranked, ["__all"], order, "__w", "__gone", "weights")
    level = (F.lit(total) - F.col("__used")) / (F.lit(all_weights) - F.col("__gone"))
    ranked = stored(ranked.withColumn("__level", level).withColumn("__full", F.col("__full_at") < level), "levels")
    last = ranked.filter("NOT __full").agg(F.min_by("__level", F.struct(*order))).first()[0]
    return ranked.select("source", "source_size", F.when(F.col("__full"), F.col("__limit")).otherwise(F.col("__w") * F.lit(last or 0.0)).alias("target"))


def mix_sources(docs: DataFrame, seed: int = 0, weights=WEIGHTS, most: int = MOST_EPOCHS, rows: bool = False) -> DataFrame:
    """What a mix of all `docs` takes of each document: doc_id, source, size, source_size, target, taken.

    Each source is read over and over in one hash-random order until its target, rounded down, is reached to
    the word; so `taken` is a document's size times the full epochs, once more for those that come before the
    cut, and a part of the document at the cut. One row for each row of `docs`. Null texts have size 0 and are
    taken never; a null source is a source of its own, the last; a null doc_id is ordered as an empty one, equal
    ids by size. Columns other than doc_id, source and text are not read, but with `rows` each whole row comes
    along as the struct `row`. An empty table gives no rows.
    """
    carried = [whole_row(docs)] if rows else []
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words().alias("size"), *carried)
    narrow = narrow if rows else stored(narrow, "sizes")
    keyed = with_prefix_sums(narrow.withColumn("__key", order_key(seed)), ["source"], ["__key", "doc_id", "size"], "size", "__before", "mix")
    # Sizes by source come from the sorted table, so no text is read twice.
    targets = source_targets(stored(keyed.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes"), weights, most)
    joined = keyed.join(targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("__before")
    taken = (epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))).cast("long").alias("taken")
    return joined.select("doc_id", "source", "size", "source_size", "target", taken, *(["row"] if rows else []))


def op6_source_mix(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of `docs` that the mix takes, with size, target, taken, `repeats` (how often it takes the whole
    document) and `part` (words of a last, cut pass). Null and repeated doc_ids are rows of their own; columns of
    `docs` of these five names give way to them. Documents without words are not taken.
    """
    mixed = mix_sources(docs, seed, rows=True).filter("taken > 0")
    added = {"size": F.col("size"), "target": F.col("target"), "taken": F.col("taken"), "repeats": F.floor(F.col("taken") / F.col("size")), "part": F.col("taken") % F.col("size")}
    return mixed.select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in added], *[c.alias(name) for name, c in added.items()])


ORACLE = r"""
WITH RECURSIVE n AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k FROM documents
), s AS (
  SELECT source, sum(size) AS source_size, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM n GROUP BY source
), f AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS r,
         (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(3.0 * source_size) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM s WINDOW before AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size,
         CASE WHEN 3.0 * source_size / w < level THEN 3.0 * source_size ELSE w * (SELECT arg_min(level, r) FROM f WHERE NOT 3.0 * source_size / w < level) END AS target
  FROM f
), c AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
         coalesce(sum(size) OVER (PARTITION BY n.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source
), e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM c)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM e
"""
