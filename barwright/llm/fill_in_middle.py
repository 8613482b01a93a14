"""Fill-in-the-middle transformation over relational units.

A text is cut into units, a word with the white space before it. Documents that are
reordered are placed by id and text; there the units are posexploded, a window sums their
lengths along the document, the rows whose ordinal is that of a cut request give its
offset, and one aggregation brings a document's offsets to its text, which is then cut by
substring. All of that is one stage behind one exchange: the two cut requests of a
document stand beside its units, so that the join by ordinal needs no second exchange, and
the text rides on a document's first row only. Documents that stay plain are not moved.

Defined cases: a null text is empty and stays plain; a document without an id has its
hash from the seed alone; rows that repeat an id are cut by their own texts; equal rows
give equal results; texts that already hold a mark stay plain; an empty table gives an
empty result; other columns are ignored (and kept by ``transform_documents``), whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.llm.common import table

SEED = 42
#: Fixed marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIM_PERCENT = 50
SPM_PERCENT = 80
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """One row per document: id, row (the document as given), n, form (plain, psm, spm), prefix_chars, middle_chars, output."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    h1, h2, h3, h4 = _draws(F.col(id_col), seed)
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (F.length(text) == 0) | marked | (h3 % 100 >= fim_percent)
    form = F.when(plain, F.lit("plain")).when(h4 % 100 < spm_percent, F.lit("spm")).otherwise(F.lit("psm"))
    rest = F.struct(*[F.col(c) for c in docs.columns if c != text_col])
    base = docs.select(F.col(id_col).alias("id"), rest.alias("rest"), F.xxhash64(text).alias("h"), F.spark_partition_id().alias("task"), h1.alias("h1"), h2.alias("h2"), form.alias("form"), F.col(text_col).alias("given"))

    whole = F.coalesce(F.col("given"), F.lit(""))
    none = F.lit(None).cast("long")
    kept = base.where("form = 'plain'").select("id", "rest", "given", F.size(units(whole)).alias("n"), "form", none.alias("lo"), none.alias("hi"), F.lit("").alias("text"))

    placed = base.where("form <> 'plain'").repartition("id", "h", "task")
    placed = placed.withColumn("row", F.monotonically_increasing_id()).withColumn("units", units(F.col("given")))
    size = F.size("units") + 1
    placed = placed.select("id", "h", "task", "row", "rest", "form", "given", "units", (F.col("h1") % size).alias("c1"), (F.col("h2") % size).alias("c2"))
    request = [F.least("c1", "c2").cast("int").alias("lo"), F.greatest("c1", "c2").cast("int").alias("hi")]
    # ordinal k stands for the end of k units; the row of ordinal 0 carries the document
    ends = placed.select("id", "h", "task", "row", "rest", "form", "given", *request, F.size("units").alias("n"), F.posexplode(F.concat(F.array(F.lit("")), "units")).alias("k", "unit"))
    head = F.when(F.col("k") == 0, F.struct("rest", "given", "form", "n"))
    ends = ends.select("id", "h", "task", "row", "lo", "hi", "k", F.length("unit").alias("chars"), head.alias("head"))
    key = ["id", "h", "task", "row"]
    upto = F.sum("chars").over(Window.partitionBy(*key).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    asked = ends.withColumn("upto", upto).where("k = lo OR k = hi OR k = 0")
    found = asked.groupBy(*key).agg(
        F.max(F.when(F.col("k") == F.col("lo"), F.col("upto"))).alias("lo"),
        F.max(F.when(F.col("k") == F.col("hi"), F.col("upto"))).alias("hi"),
        F.first("head", ignorenulls=True).alias("head"),
    )
    cut = found.select("id", "head.rest", "head.given", "head.n", "head.form", "lo", "hi", F.col("head.given").alias("text"))

    lo, hi = F.col("lo").cast("int"), F.col("hi").cast("int")
    prefix = F.substring("text", F.lit(1), lo)
    middle = F.substring("text", lo + 1, hi - lo)
    suffix = F.substring("text", hi + 1, F.length("text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    out = kept.unionByName(cut)
    output = F.when(F.col("form") == "plain", whole).when(F.col("form") == "psm", psm).otherwise(spm)
    return out.select(F.col("id").alias(id_col), "rest", "given", F.col("n").cast("long").alias("n"), "form", F.col("lo").alias("prefix_chars"), (F.col("hi") - F.col("lo")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text from an output and its form alone: marks do not occur in it, so the first of each is the right one."""

    def between(start: str, stop: str) -> Column:
        lo = F.instr(output, start) + len(start)
        return F.substring(output, lo, F.instr(output, stop) - lo)

    middle = F.substring(output, F.instr(output, MIDDLE) + len(MIDDLE), F.length(output))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def transform_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with its columns, every text in its new form."""
    done = transform(docs, id_col, text_col, **options)
    return done.select(*[F.col("output").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns])


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    again = restore(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
u AS (
  SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4
  FROM t),
c AS (
  SELECT *, len(units) AS n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
         least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS lo, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS hi
  FROM u),
p AS (
  SELECT *, array_to_string(units[1 : lo], '') AS prefix, array_to_string(units[lo + 1 : hi], '') AS middle, array_to_string(units[hi + 1 : n], '') AS suffix
  FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
