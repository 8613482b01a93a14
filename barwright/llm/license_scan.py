"""License scans: sparse TF-IDF cosine to templates, then the nearest ancestor directory.

Candidates are the lines of every file; and of files with a line that could pass,
the windows of WINDOWS consecutive lines that start or end there, the blocks of
lines between empty ones, and the whole text. Windows and blocks skip comment signs
and empty lines, as only letters and digits are terms. Terms are weighted tf * idf,
idf from the number of lines of the whole corpus that hold the term, for all terms. The
most common terms of each template, as far as they could not reach the threshold alone,
are left out of the candidate filter; a candidate without any other cannot pass.
Terms then join the templates' few hundred weights.

A file whose own header or whole text passes has that licence. Other files take
the licence of the licence file in the nearest directory above them: files named
like LICENSE or COPYING, or whose whole text passes.

DataFrame functions only; what is broadcast or fetched are template terms.

Defined cases: a null or empty text has no licence of its own but may inherit; a
null path inherits nothing, and each text without a path is a file of its own; equal
scores go to the template first by name; equal licence files of a directory to the
higher score, then the first path; rows that repeat a path are one file, with the
best of their scores; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.llm.common import materialize, table
from barwright.llm.license_templates import TEMPLATES

THRESHOLD = 0.75

WINDOWS = (2, 3, 5, 8)  # lines
LICENSE_NAME = r"(?i)^(un)?(licen[cs]e|copying|notice)([.-].*)?$"
TOKEN = r"[\p{L}\p{N}]+"


def terms(text: str) -> Counter:
    return Counter(re.findall(r"[^\W_]+", text.lower()))


def template_weights(df: dict[str, int], lines: int, templates: dict[str, list[str]]) -> dict[tuple[str, int], dict[str, float]]:
    """Normalised tf-idf weights of every template, by (name, number)."""
    out = {}
    for name, texts in templates.items():
        for k, text in enumerate(texts):
            w = {t: n * idf(df.get(t, 0), lines) for t, n in terms(text).items()}
            norm = math.sqrt(math.fsum(x * x for x in w.values()))
            out[name, k] = {t: x / norm for t, x in w.items()}
    return out


def idf(df: int, lines: int) -> float:
    return math.log((1 + lines) / (1 + df)) + 1


def anchors(weights: dict[tuple[str, int], dict[str, float]], df: dict[str, int], threshold: float) -> set[str]:
    """Terms of which a text that reaches the threshold has at least one: the most common ones are left out as far as they cannot reach it."""
    out = set()
    for w in weights.values():
        acc = 0.0
        for t, x in sorted(w.items(), key=lambda z: (-df.get(z[0], 0), z[1], z[0])):
            acc += x * x
            if acc >= threshold**2 * (1 - 1e-9):
                out.add(t)
    return out


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _candidates(files: DataFrame, must: Column) -> DataFrame:
    """(file, kind, tokens) of files (file, row, text) that have a line with a term of ``must``: those lines, and the windows, blocks and whole texts around them.

    Kind is -1 for whole texts, else 0. Each line is a row with its own terms only; a window reads the next lines, whatever the
    file's length, and a block is an aggregate of its lines, so work grows with the lines.
    """
    line = files.select("file", "row", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = line.select("file", "row", "pos", _tokens(F.col("line")).alias("tokens")).withColumn("hit", F.arrays_overlap("tokens", must))
    along = Window.partitionBy("file", "row").orderBy("pos")
    line = line.withColumn("block", F.sum((F.size("tokens") == 0).cast("long")).over(along)).where(F.size("tokens") > 0)
    # windows take the next lines with terms, whatever stands between
    ahead = along.rowsBetween(0, max(WINDOWS) - 1)
    window = line.select("file", "row", "pos", "block", "tokens", "hit", F.row_number().over(along).alias("rank"), F.collect_list("tokens").over(ahead).alias("next"), F.collect_list("hit").over(ahead).alias("hits"))
    meets = lambda n: F.col("hit") | F.coalesce(F.get("hits", F.lit(n - 1)), F.lit(False)) | ((F.col("rank") == 1) & F.array_contains(F.slice("hits", 1, n), True))
    wide = F.filter(F.array(*[F.when(meets(n), F.lit(n)) for n in WINDOWS]), lambda n: n.isNotNull())
    window = window.where(F.array_contains("hits", True)).select("file", "next", F.explode(wide).alias("n")).select("file", F.flatten(F.slice("next", F.lit(1), F.col("n"))).alias("tokens"))
    block = line.groupBy("file", "row", "block").agg(F.max("hit").alias("hit"), F.array_sort(F.collect_list(F.struct("pos", "tokens"))).alias("said")).where("hit")
    block = block.select("file", F.flatten("said.tokens").alias("tokens"))
    whole = files.select("file", _tokens(F.col("text")).alias("tokens"))
    kind = lambda df, k: df.select("file", F.lit(k).alias("kind"), "tokens")
    return kind(line.where("hit"), 0).unionByName(kind(window, 0)).unionByName(kind(block, 0)).unionByName(kind(whole, -1))


def license_scan(files: DataFrame, path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per path, and per text without a path: path, license, score, origin (header, file, inherited, none), from_path."""
    spark = files.sparkSession
    templates = TEMPLATES if templates is None else templates
    vocabulary = sorted({t for texts in templates.values() for x in texts for t in terms(x)})
    base = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    lost = F.concat(F.lit("\0"), F.md5(F.coalesce("text", F.lit(""))))
    base = base.select(F.coalesce("path", lost).alias("file"), "path", F.xxhash64("text").alias("row"), "text")
    line = base.select("file", "row", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = line.select("file", "row", "pos", _tokens(F.col("line")).alias("tokens"))
    # the empty term counts the lines
    held = line.where(F.size("tokens") > 0).select(F.explode(F.concat(F.array(F.lit("")), F.array_distinct("tokens"))).alias("term"))
    counts = materialize(held.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    df = {r["term"]: r["df"] for r in counts.where(F.col("term").isin(["", *vocabulary])).collect()}  # one row per template term
    lines = df.pop("", 0)
    weights = template_weights(df, lines, templates)
    wanted = spark.createDataFrame([(t, n, k, w) for (n, k), ws in weights.items() for t, w in ws.items()], "term string, name string, k int, w double")
    must = F.array(*[F.lit(t) for t in sorted(anchors(weights, df, threshold))])
    hit = materialize(line.where(F.arrays_overlap("tokens", must)).groupBy("file", "row").agg(F.count(F.lit(1)).alias("hits")), "hits")
    held = base.join(hit.select("file", "row"), ["file", "row"], "left_semi")
    held = materialize(held.groupBy("file", "row").agg(F.any_value("text").alias("text")), "files")
    # repeated rows of a file: candidates are told apart by content, not by place
    unit = _candidates(held, must).select("file", "kind", F.xxhash64("tokens").alias("unit"), "tokens").where(F.size("tokens") > 0).dropDuplicates(["file", "kind", "unit"])
    tf = unit.select("file", "kind", "unit", F.explode("tokens").alias("term")).groupBy("file", "kind", "unit", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = materialize(tf, "terms")  # so that the join can split a common term
    weight = F.col("tf") * (F.log(F.lit(float(1 + lines)) / (F.col("df") + 1)) + 1)
    tf = materialize(tf.join(counts, "term").withColumn("x", weight), "weights")
    key = ["file", "kind", "unit"]
    norm = tf.groupBy(*key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dot = tf.join(F.broadcast(wanted), "term").groupBy(*key, "name", "k").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    cosine = dot.join(norm, key).withColumn("score", F.round(F.try_divide("dot", "norm"), 9)).where(F.col("score") >= threshold)
    best = [F.min_by("name", F.struct(-F.col("score"), F.col("name"))).alias("name"), F.max("score").alias("score"), F.min("kind").alias("kind")]
    own = materialize(cosine.groupBy("file").agg(*best), "own")

    parts = F.split("file", "/")
    named = ~F.startswith("file", F.lit("\0"))
    is_file = named & ((F.col("kind") == -1) | F.element_at(parts, -1).rlike(LICENSE_NAME))
    holders = own.where(is_file).withColumn("dir", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"))
    holders = holders.groupBy("dir").agg(F.min_by(F.struct("name", "score", "file"), F.struct(-F.col("score"), F.col("file"))).alias("h"))
    holders = materialize(holders, "holders")  # so that the join can split a directory with very many files below
    paths = base.select("file", "path").distinct()
    rest = paths.where("path IS NOT NULL").join(own.select("file"), "file", "left_anti")
    steps = rest.select("file", F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("depth"))
    steps = steps.withColumn("dir", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    near = steps.join(holders, "dir").groupBy("file").agg(F.max_by("h", "depth").alias("h"))
    mine = own.select("file", "name", "score", F.when(is_file, F.lit("file")).otherwise("header").alias("origin"), F.when(named, F.col("file")).alias("from_path"))
    inherited = near.select("file", "h.name", "h.score", F.lit("inherited").alias("origin"), F.col("h.file").alias("from_path"))
    out = paths.join(mine.unionByName(inherited), "file", "left")
    return out.select(F.col("path").alias(path_col), F.col("name").alias("license"), "score", F.coalesce("origin", F.lit("none")).alias("origin"), "from_path")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of a tree source/lang/hundred/id.txt; those without an id have no path."""
    part = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", part("source"), part("lang"), F.floor(F.col("doc_id") / 100).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    found = license_scan(docs.select(path.alias("path"), "text"))
    num = lambda c: F.regexp_extract(c, r"(-?\d+)\.txt$", 1).try_cast("long")
    return found.select(num("path").alias("doc_id"), "path", "license", "score", "origin", F.when(F.col("from_path").isNotNull(), num("from_path")).alias("from_doc_id"))
