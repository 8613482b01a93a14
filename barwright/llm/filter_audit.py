"""What a chain of text filters removes, in every order of the filters.

A relational word pipeline. Texts are placed by their own key, words are exploded,
counted by (text, word) and then by text for totals and distinct words, all where the
text was placed: words are never shuffled. One marker a row counts the copies of a text
that one scan task held and carries the smallest id, so equal texts are counted once
and a group of copies meets as one row a task. The other flags are outer-joined, and
one aggregation with a count for each of the 32 sets of failed filters (for all, good
and toxic documents) is all that the 120 orders need.

Filters (a document fails if): A fewer than 50 words; B 100 * distinct words < 65 *
words; C 100 * capitals A-Z > 5 * code points; D holds any of # $ % & * |; E its text is
that of a document with a smaller id.

Defined cases: a null text is empty, and an empty text fails A only (and E); a null
source is the part with the empty name, together with empty sources; a document without
an id never fails E nor lets others fail; rows that repeat an id are documents of their
own, and of the same id none is smaller; a document is good or toxic if any row of labels
with its id says so, null labels say nothing; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm.common import materialize, table

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
WORD = r"[^\x20\x09-\x0D]+"
MARKER = ""  # no word is empty


def word_counts(docs: DataFrame) -> DataFrame:
    """(h1, h2, words, distinct, first_id) of every text of ``docs`` (id, h1, h2, text)."""
    placed = docs.select("id", "h1", "h2", F.spark_partition_id().alias("task"), "text").repartition("h1", "h2", "task")
    word = placed.select("id", "h1", "h2", "task", F.explode(F.concat(F.array(F.lit(MARKER)), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("word"))
    by_word = word.groupBy("h1", "h2", "task", "word").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    marker = F.col("word") == MARKER
    by_task = by_word.groupBy("h1", "h2", "task").agg(
        F.sum(F.when(marker, F.col("n"))).alias("copies"),
        F.sum(F.when(~marker, F.col("n"))).alias("n"),
        F.count(F.when(~marker, 1)).alias("distinct"),
        F.min("id").alias("id"),
    )
    return by_task.groupBy("h1", "h2").agg(
        F.max(F.expr("coalesce(n, 0) DIV copies")).alias("words"),
        F.max("distinct").alias("distinct"),
        F.min("id").alias("first_id"),
    )


def failure_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per document: id, part, failed (bit k set: the filter FILTERS[k] would remove it)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))
    counted = materialize(word_counts(base), "words")  # so that the join can split the rows of one text
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    flagged = base.select("id", "part", "h1", "h2", (100 * capitals > 5 * F.length("text")).alias("C"), F.col("text").rlike("[#$%&*|]").alias("D"))
    out = flagged.join(counted, ["h1", "h2"], "left")
    fails = {"A": F.col("words") < 50, "B": 100 * F.col("distinct") < 65 * F.col("words"), "C": F.col("C"), "D": F.col("D"), "E": F.coalesce(F.col("id") > F.col("first_id"), F.lit(False))}
    failed = sum((F.when(fails[f], F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(FILTERS)), F.lit(0))
    return out.select("id", "part", failed.alias("failed"))


def audit(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from failure_sets and labels."""
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = failed.join(said, "id", "left")
    kinds = {"all": "", "good": "AND good = 1", "toxic": "AND toxic = 1"}
    counts = known.groupBy("part").agg(*[F.expr(f"count_if(failed = {m} {c}) AS {k}_{m}") for k, c in kinds.items() for m in range(SETS)])
    counts = counts.select("part", *[F.array(*[f"{k}_{m}" for m in range(SETS)]).alias(k) for k in kinds])
    orders = ", ".join(f"'{''.join(o)}'" for o in permutations(FILTERS))
    at = counts.select("*", F.expr(f"explode(array({orders}))").alias("filter_order"))
    at = at.select("*", F.expr(f"explode(sequence(1, {len(FILTERS)}))").alias("step"))
    bit = f"shiftleft(1, instr('{FILTERS}', substring(filter_order, {{}}, 1)) - 1)"
    at = at.withColumn("own", F.expr(bit.format("step")))
    at = at.withColumn("before", F.expr(f"aggregate(sequence(1, {len(FILTERS)}), 0, (a, k) -> a + if(k < step, {bit.format('k')}, 0))"))
    # a filter comes first among the b filters of a set in 1/b of all orders
    total = "aggregate(sequence(0, {sets}), 0L, (a, m) -> a + if({wanted}, {kind}[m]{times}, 0L)) AS {name}"
    sums = [
        ("kept", "all", "(m & (before | own)) = 0", ""),
        ("removed", "all", "(m & before) = 0 AND (m & own) <> 0", ""),
        ("redundant", "all", "(m & before) <> 0 AND (m & own) <> 0", ""),
        ("unique_fails", "all", "m = own", ""),
        ("good_lost", "good", "(m & before) = 0 AND (m & own) <> 0", ""),
        ("toxic_lost", "toxic", "(m & before) = 0 AND (m & own) <> 0", ""),
        ("shapley", "all", "(m & own) <> 0", f" * ({factorial(len(FILTERS))} DIV bit_count(m))"),
    ]
    return at.select("part", "filter_order", "step", *[F.expr(total.format(sets=SETS - 1, wanted=w, kind=k, times=t, name=n)) for n, k, w, t in sums])


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(failure_sets(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
f AS (
  SELECT doc_id, part,
         [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text),
          regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS fails
  FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
k AS (SELECT unnest(range(1, 6)) AS k),
o AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS o
  FROM k a, k b, k c, k d, k e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT o, array_to_string(list_transform(o, lambda x: substr('ABCDE', CAST(x AS INT), 1)), '') AS filter_order, unnest(range(1, 6)) AS step FROM o),
x AS (
  SELECT part, filter_order, step, o[step] AS own, n, good, toxic, fails[o[step]] AS has,
         len(list_filter(o[1 : step - 1], lambda i: fails[i])) > 0 AS gone,
         len(list_filter(fails, lambda b: b)) AS n_fails
  FROM m, s),
r AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, own,
         CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND NOT has), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND has), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (WHERE gone AND has), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (WHERE has AND n_fails = 1), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (WHERE NOT gone AND has), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (WHERE NOT gone AND has), 0) AS BIGINT) AS toxic_lost
  FROM x GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""
