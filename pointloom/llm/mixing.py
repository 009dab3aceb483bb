"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each source gets its share of all words by weight, capped at a multiple of what it has; the excess goes to
the others by weight until none is above its cap. A source's target is spent in complete epochs over
all its documents and one fractional epoch: documents are ordered by exponential keys, -ln(u) over the
document's quality weight with u a hash of the id, and taken while the prefix sum of sizes is
within the rest of the budget; the document at the border is taken in part, so the target is met.

The prefix sum of a source runs in two levels: keys fall into buckets, sums per bucket are accumulated
over the buckets, and only documents of one bucket are ordered together. A source with a third of all rows
is so ordered by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_REGEX, cut_lineage, table, unused

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BUCKETS = 4096
#: What texts of low quality have more of: its signs, the share of the text above which they count, and their weight.
SIGNS = (("#*$%&|<>", 0.0, 4.0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ!", 0.15, 2.0), ("0123456789", 0.1, 1.0))
LEAST_QUALITY = 0.25


def quality(text: Column) -> Column:
    """Weight of a document, LEAST_QUALITY to 1: the fewer markup symbols, capitals and digits, the likelier it is drawn early."""
    size = F.greatest(F.length(text), F.lit(1))
    excess = [(F.length(text) - F.length(F.translate(text, signs, ""))) / size - least for signs, least, _ in SIGNS]
    parts = [F.greatest(F.lit(0.0), e) * weight for e, (_, _, weight) in zip(excess, SIGNS)]
    return F.lit(1.0) - F.least(F.lit(1.0 - LEAST_QUALITY), parts[0] + parts[1] + parts[2])


def uniform(doc_id: Column) -> Column:
    """A number in (0, 1) that depends on the id alone: 52 bits of its md5."""
    return (F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from ``sizes(source, source_size)``; one row per source.

    Sources at their cap are those with the smallest cap per weight, so the water level is found in one
    ordered pass over the sources. Sources are ordered by code point, null last; weights repeat. That pass is one task, which
    holds a few numbers for each source: a million sources are some tens of megabytes.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (nth % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", w.alias("w"), (F.col("source_size") * float(max_repeats)).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = ranked.select(
        "*",
        (
            (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
            / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        ).alias("level"),
    )
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))
    # levels rise to the first that its own cap does not cut, which is the water level, and fall from there
    water = level.select("*", F.max(fits).over(everything).alias("water"))
    return water.select("source", "source_size", F.least("cap", F.col("w") * F.col("water")).alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    buckets: int = BUCKETS,
    weigh=quality,
    keys: bool = False,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs``.

    size counts the words of the whole text (null: 0); documents without words take nothing. A source
    without words has target 0. Rows are told apart by id, then by a hash of the text; rows equal in both
    are interchangeable, and a null id counts as the text ``null``. Other columns are not read. ``keys``
    adds the source and the hash of the text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = -F.log(uniform(F.col("doc_id"))) / weigh(text)
    sized = cut_lineage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.regexp_count(text, F.lit(WORD_REGEX)).cast("long").alias("size"),
            key.alias("key"),
            F.xxhash64(text).alias("tie"),
        )
    )
    # 1 - exp(-key) lies in [0, 1) and rises with the key; the weights keep it near uniform
    sized = sized.withColumn("bucket", F.least(F.lit(buckets - 1), F.floor((1.0 - F.exp(-F.col("key"))) * buckets)).cast("int"))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    goal = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_repeats)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("base", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).alias("b")
    g = goal.alias("g")
    known = base.join(g, F.col("b.source").eqNullSafe(F.col("g.source"))).select(
        F.col("b.source").alias("s"), F.col("b.bucket").alias("k"), "base", "source_size", "target"
    )
    joined = sized.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("k")))
    within = (
        Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    prefix = F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0))
    goal_words = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal_words / F.greatest("source_size", F.lit(1)))).otherwise(0)
    rest = goal_words - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - prefix))
    return joined.select(
        "doc_id",
        "size",
        "source_size",
        F.round("target", 6).alias("target"),
        (epochs * F.col("size") + part).cast("long").alias("taken"),
        *([F.col("source").alias("source"), F.col("tie").alias("tie")] if keys else []),
    )


def first_words(text: Column, n: Column) -> Column:
    """The beginning of a text up to its n-th word, white space included."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1), F.lit(1), n), "")


def drawn(docs: DataFrame, **params) -> DataFrame:
    """The rows that the mix takes: each document as often as it is taken whole, and the one at the border cut.

    Rows equal in doc_id, source and text are one row that is taken as often as they are together.
    """
    own_id, own_source, own_tie, own_taken, own_size, own, n = unused(docs, "id", "of", "tie", "taken", "size", "own", "n")
    tie = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    each = mix(docs, keys=True, **params).groupBy(F.col("doc_id").alias(own_id), F.col("source").alias(own_source), F.col("tie").alias(own_tie))
    taken = each.agg(F.sum("taken").cast("long").alias(own_taken), F.max("size").cast("long").alias(own_size)).where(F.col(own_taken) > 0)
    rows = docs.withColumn(own, tie).dropDuplicates(["doc_id", "source", own])
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & F.col("source").eqNullSafe(F.col(own_source)) & (F.col(own) == F.col(own_tie))
    rest = F.col(own_taken) % F.col(own_size)
    times = F.concat(
        F.array_repeat(F.col(own_size), F.floor(F.col(own_taken) / F.col(own_size)).cast("int")),
        F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")),
    )
    drawn_rows = rows.join(taken, same).withColumn(n, F.explode(times))
    whole = F.col(n) == F.col(own_size)
    text = F.when(whole, F.col("text")).otherwise(first_words(F.col("text"), F.col(n).cast("int")))
    new = {"text": text.alias("text"), "n_chars": F.when(whole, F.col("n_chars")).otherwise(F.length(text)).cast("long").alias("n_chars")}
    return drawn_rows.select(*[new.get(c, F.col(c)) for c in docs.columns])


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
k AS (
  SELECT doc_id, source, size,
         -ln((CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)
         / (1.0::DOUBLE - least(0.75::DOUBLE, greatest(0.0::DOUBLE, (length(text) - length(translate(text, '#*$%&|<>', ''))) / greatest(length(text), 1)::DOUBLE - 0.0::DOUBLE) * 4.0::DOUBLE
            + greatest(0.0::DOUBLE, (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!', ''))) / greatest(length(text), 1)::DOUBLE - 0.15::DOUBLE) * 2.0::DOUBLE
            + greatest(0.0::DOUBLE, (length(text) - length(translate(text, '0123456789', ''))) / greatest(length(text), 1)::DOUBLE - 0.1::DOUBLE) * 1.0::DOUBLE)) AS key
  FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (
  SELECT source, source_size, source_size * 3.0::DOUBLE AS cap,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1] AS w
  FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER before, 0.0))
            / (sum(w) OVER () - coalesce(sum(w) OVER before, 0.0)) AS level
  FROM w WINDOW before AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (
  SELECT source, source_size, least(cap, w * (SELECT max(level) FROM l WHERE level <= cap / w)) AS target FROM l),
p AS (
  SELECT k.doc_id, k.size, g.source_size, g.target, CAST(round(g.target) AS BIGINT) AS goal,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (goal // source_size) * size
            + greatest(0, least(size, goal - (goal // source_size) * source_size - prefix)) END AS BIGINT) AS taken
FROM p
"""
