"""Mixing sources to target weights.

Words are summed per source, the target weights are turned into a repetition
rate per source, and every document is emitted floor(rate) times plus one more
with probability rate - floor(rate), decided by a hash of its id. The draws
are stratified: the documents of a source are dealt into strata of a few
thousand by a hash, ordered by size in each, and drawn systematically from a
hashed starting point. Each document keeps exactly the probability asked for,
while the words taken vary far less than with unrelated draws.

Only built-in functions. Per source one row is kept; the strata split a source
that holds a third of all rows; the documents are shuffled once.

Nulls and odd rows: a null or blank text has size 0; documents without a
source form a source of their own, ranked last; a source without words has
target 0 and its documents are not emitted; a repeated row is drawn by itself;
with no document, or no word at all, nothing is emitted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.llm.common import cut, fresh, table, unit_hash, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
STRATUM_ROWS = 4096
SEED = "mix"
#: The per-source table is broadcast up to this many rows (about 10 MB).
BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size",
                   weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Per source: ``source``, ``n_docs``, ``source_size``, ``target``.

    Sources in code-point order (null last) take ``weights`` in turn and share
    the sum of all sizes. No target exceeds ``max_repeat`` times its source's
    size; what that leaves over is shared by weight among the others until
    none is above. That end state gives every open source the same words per
    weight, the ``level``, so it is found by ordering the sources by the level
    at which each fills up (cap / weight) and taking the first that does not
    fill. All sums are whole numbers, so the result is the same in any order.
    """
    per = sizes.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(size).alias("source_size"))
    # one row per source from here on
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = (per.withColumn("rank", rank).withColumn("weight", weight.cast("long"))
           .withColumn("cap", F.col("source_size") * F.lit(max_repeat)))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    open_level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"),
                              F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level").alias("level"))))
    return per.withColumn("chosen", open_level.over(everything)).select(
        "source", "n_docs", "source_size",
        F.least(F.col("cap").cast("double"), F.col("weight") * F.col("chosen.level")).alias("target"))


def copies_per_document(docs: DataFrame, doc_id: str = "doc_id", source: str = "source",
                        size: Column | None = None, weights: Sequence[int] = WEIGHTS,
                        max_repeat: int = MAX_REPEAT, seed: str = SEED) -> tuple[DataFrame, str]:
    """``docs`` with one struct column added (its name is returned too):
    ``size``, ``source_size``, ``target`` and ``copies``, the number of times
    the mix emits the document."""
    mix, found = fresh(docs, "mix", "of_source")
    size = word_count(F.col("text")) if size is None else size
    sized = docs.withColumn(mix, F.struct(size.alias("size"), F.col(source).alias("source")))
    targets = cut(source_targets(sized.select(f"{mix}.*"), weights=weights, max_repeat=max_repeat))
    # its size is counted before it is broadcast; a larger one is joined as usual
    small = targets.count() <= BROADCAST_SOURCES
    targets = targets.select(F.struct("*").alias(found))
    m, of = F.col(mix), F.col(found)
    joined = sized.join(F.broadcast(targets) if small else targets, m["source"].eqNullSafe(of["source"]))
    label = F.concat(F.when(m["source"].isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(m["source"], F.lit("")))
    rate = F.when(of["source_size"] > 0, of["target"] / of["source_size"]).otherwise(F.lit(0.0))
    drawn = unit_hash(F.lit(seed), F.lit("document"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    stratum = F.floor(drawn * F.ceil(of["n_docs"] / F.lit(STRATUM_ROWS)))
    rows = joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(
        m["size"].alias("size"), of["source_size"].alias("source_size"), of["target"].alias("target"), F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("part"),
        label.alias("label"), stratum.alias("stratum"), drawn.alias("drawn")).alias(mix))
    place = F.row_number().over(Window.partitionBy(m["label"], m["stratum"]).orderBy(m["size"], m["drawn"], F.col(doc_id)))
    start = unit_hash(F.lit(seed), F.lit("stratum"), m["label"], m["stratum"].cast("string"))
    extra = F.floor(place * m["part"] + start) - F.floor((place - 1) * m["part"] + start)
    return rows.withColumn(mix, F.struct(m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"),
                                         (m["whole"] + extra).cast("int").alias("copies"))), mix


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: the columns of ``docs``, a row per copy."""
    rows, mix = copies_per_document(docs, **options)
    copy, = fresh(rows, "copy")
    return (rows.where(F.col(mix)["copies"] > 0)
            .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(mix)["copies"]))).select(*[F.col(f"`{c}`") for c in docs.columns]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows, mix = copies_per_document(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), size=F.col("size"))
    m = F.col(mix)
    return rows.select("doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"),
                       (m["size"] * m["copies"]).alias("taken"))


def _unit_sql(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT::DOUBLE / {16 ** 13}.0)"


ORACLE_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, count(*) AS n_docs, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM per),
-- the level of words per weight at which exactly all words are shared, by trying every source's own fill level
tried AS (
  SELECT a.source, any_value(3.0 * a.source_size / a.weight) AS fill,
         (SELECT sum(source_size) FROM per) AS total,
         coalesce(sum(3 * b.source_size) FILTER (3.0 * b.source_size / b.weight < 3.0 * a.source_size / a.weight), 0) AS filled,
         sum(b.weight) FILTER (3.0 * b.source_size / b.weight >= 3.0 * a.source_size / a.weight) AS open_weight
  FROM weighed a, weighed b GROUP BY a.source),
level AS (SELECT arg_min((total - filled)::DOUBLE / open_weight::DOUBLE, fill) AS words
          FROM tried WHERE (total - filled)::DOUBLE / open_weight::DOUBLE <= fill),
rated AS (
  SELECT source, n_docs, source_size, least(3.0 * source_size, weight * words)::DOUBLE AS target,
         CASE WHEN source_size > 0 THEN least(3.0 * source_size, weight * words)::DOUBLE / source_size ELSE 0 END AS rate
  FROM weighed, level),
dealt AS (
  SELECT s.doc_id, s.size, r.*, {_unit_sql("'mix'", "'document'", "coalesce(s.doc_id::VARCHAR, '')")} AS drawn,
         CASE WHEN s.source IS NULL THEN '0' ELSE '1' || s.source END AS label
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source),
placed AS (
  SELECT *, floor(drawn * ceil(n_docs / 4096.0))::BIGINT AS stratum,
         row_number() OVER (PARTITION BY label, floor(drawn * ceil(n_docs / 4096.0)) ORDER BY size, drawn, doc_id) AS place
  FROM dealt),
started AS (SELECT *, {_unit_sql("'mix'", "'stratum'", "label", "stratum::VARCHAR")} AS start, rate - floor(rate) AS part FROM placed)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + floor(place * part + start) - floor((place - 1) * part + start)))::BIGINT AS taken
FROM started
"""
