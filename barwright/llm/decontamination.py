"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Test items become windows of SPAN consecutive words; an item of fewer words, but not
none, is one window. Windows are hashed, and the hashes are broadcast with the words
they stand for. The scan of the documents runs over blocks of words: every place in a
block is hashed with the words that follow and looked up, and a hit counts only if the
words themselves are equal. Hits leave the scan as (row, place, length, posting), so
texts are never shuffled; a document's words and hits are one aggregation.

What is broadcast is bounded by BROADCAST_BYTES: a larger set of windows is split by
hash, and the documents are scanned once for each part.

Windows that occur in the same items share a posting. The items of a document are looked
up once for every distinct set of postings, not once for every document, so a passage
in millions of documents costs its list of items once.

DataFrame functions only.

Defined cases: A-Z are lowered, and words are runs of ASCII letters, digits and all
characters beyond ASCII; null texts have no words, on either side; a document without
words is not contaminated; rows that repeat an id are judged by their own texts, and so
are rows without an id; items that repeat an id are one item; an item without an id
marks words, but is neither counted nor listed; an empty benchmark hits nothing; an
empty table gives an empty result; other columns are ignored (and kept by
``decontaminate``), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm.common import UPPER, materialize, packed, same, table

SPAN = 10
BLOCK = 512  # places of one block; its words go along with every place, by reference
BROADCAST_BYTES = 128 << 20
ROW_BYTES = 96  # of a broadcast window, besides its words
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for texts that still have capitals, and what stands between words.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """(windows, postings): (hash, length, words, posting) of every distinct window, and (posting, items)."""
    item = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("words")).where("size(words) > 0")
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (span - 1)))
    window = item.select("item", F.explode(places).alias("at"), "words").select("item", F.slice("words", F.col("at"), span).alias("window"))
    held = window.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    held = held.select(F.xxhash64("window").alias("h"), F.size("window").alias("l"), F.array_join("window", " ").alias("said"), F.md5(F.to_json("items")).alias("posting"), "items")
    held = materialize(held, "windows")
    return held.drop("items"), held.groupBy("posting").agg(F.any_value("items").alias("items"))


def _places(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """Every place of every document with the hash of the words from there, for each length: (*keys, n, at, l, h, part, i).

    Place 0 stands for the row itself, once. Blocks, places and lookup are one pass of generated code, in which the words are not copied.
    """
    span = max(lengths)
    keys = [c for c in docs.columns if c != "words"]
    out = docs.select(*keys, F.size("words").alias("n"), "words")
    out = out.select(*keys, "n", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / BLOCK).cast("int") - 1))).alias("block"))
    out = out.select(*keys, "n", "block", F.slice("words", F.col("block") * BLOCK + 1, BLOCK + span - 1).alias("part"))
    first = F.when(F.col("block") == 0, F.lit(0)).otherwise(F.lit(1))
    out = out.select(*keys, "n", "block", "part", F.explode(F.sequence(first, F.least(F.lit(BLOCK), F.size("part")))).alias("i"))
    length = F.lit(lengths[0]) if len(lengths) == 1 else F.explode(F.when(F.col("i") > 0, F.array(*map(F.lit, lengths))).otherwise(F.array(F.lit(lengths[0]))))
    out = out.select(*keys, "n", "block", "part", "i", length.alias("l"))
    h = F.when((F.col("i") > 0) & (F.col("i") + F.col("l") - 1 <= F.size("part")), F.xxhash64(F.slice("part", F.greatest(F.lit(1), "i"), F.col("l"))))
    return out.select(*keys, "n", "part", "i", "l", (F.col("block") * BLOCK + F.col("i")).alias("at"), h.alias("h"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: id, key (of its text), n_words, n_hit, spans (hit runs of words, from and up to a place, from 0), items (sorted)."""
    window, posting = item_windows(items, item_col, item_text_col, span)
    size = window.agg(F.collect_set("l").alias("lengths"), F.coalesce(F.sum(F.octet_length("said") + ROW_BYTES), F.lit(0)).alias("bytes")).first()  # at most ``span`` lengths
    parts = -(-size["bytes"] // broadcast_bytes) or 1
    lengths = sorted(size["lengths"]) or [span]
    # Rows of one id and text have one answer. Those of one scan task are one group, so that very many of them stay apart.
    salt = F.spark_partition_id() if parts == 1 else F.lit(0)
    base = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), salt.alias("salt"), words(F.col(text_col)).alias("words"))
    hits = None
    for k in range(parts):
        known = window.where(F.pmod("h", F.lit(parts)) == k).select(F.col("h").alias("wh"), F.col("l").alias("wl"), "said", "posting")
        at = _places(base, lengths)
        equal = (F.col("h") == F.col("wh")) & (F.col("l") == F.col("wl")) & (F.array_join(F.slice("part", F.greatest(F.lit(1), "i"), F.col("l")), " ") == F.col("said"))
        found = at.join(F.broadcast(known), equal, "inner" if k else "left").select("id", "key", "salt", "n", "at", "l", "posting")
        found = found.where("posting IS NOT NULL" if k else "posting IS NOT NULL OR at = 0")
        hits = found if hits is None else hits.unionByName(found)
    run = F.when(F.col("at") > 0, F.struct((F.col("at") - 1).alias("lo"), (F.col("at") - 1 + F.col("l")).alias("hi")))
    row = hits.groupBy("id", "key", "salt").agg(
        F.max("n").alias("n"),
        F.count(F.when(F.col("at") == 0, 1)).alias("copies"),
        F.array_sort(F.collect_set(run)).alias("runs"),
        F.sort_array(F.collect_set("posting")).alias("postings"),
    )
    row = materialize(row.select("id", "key", "n", "copies", _merged("runs").alias("spans"), "postings"), "hits")
    sets = row.where("size(postings) > 0").select("postings").distinct()
    sets = sets.select("postings", F.explode("postings").alias("posting")).join(posting, "posting").groupBy("postings").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    none = F.array().cast("array<string>")
    clean = row.where("size(postings) = 0").withColumn("items", none)
    out = clean.drop("postings").unionByName(row.join(materialize(sets, "sets"), "postings").drop("postings"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s.hi - s.lo))
    return out.select(F.col("id").alias(id_col), "key", F.col("n").cast("long").alias("n_words"), n_hit.alias("n_hit"), "spans", "items")


def text_key(text: Column) -> Column:
    """Tells texts apart, null from empty included."""
    return F.struct(F.coalesce(F.length(text), F.lit(-1)).alias("a"), F.xxhash64(text).alias("b"), F.xxhash64(F.lit(1), text).alias("c"))


def _merged(runs: str) -> Column:
    """Sorted runs joined where they touch; the last open one is kept beside the closed ones until the end."""
    run = "struct<lo:int,hi:int>"
    start = F.struct(F.array().cast(f"array<{run}>").alias("done"), F.lit(None).cast(run).alias("open"))

    def step(acc: Column, s: Column) -> Column:
        touches = acc.open.isNotNull() & (s.lo <= acc.open.hi)
        grown = F.struct(acc.open.lo.alias("lo"), F.greatest(acc.open.hi, s.hi).alias("hi"))
        closed = F.when(acc.open.isNull(), acc.done).otherwise(F.array_append(acc.done, acc.open))
        return F.struct(F.when(touches, acc.done).otherwise(closed).alias("done"), F.when(touches, grown).otherwise(s).alias("open"))

    return F.aggregate(runs, start, step, lambda acc: F.when(acc.open.isNull(), acc.done).otherwise(F.array_append(acc.done, acc.open)))


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) without the hit words and what follows each of them up to the next word."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    hit = contamination(docs, items, id_col, text_col, **options).where("n_hit > 0")
    hit = materialize(hit.select(F.col(id_col).alias("hid"), F.col("key").alias("hkey"), "n_words", "spans").dropDuplicates(["hid", "hkey"]), "contaminated")
    rows = packed(docs, hid=F.col(id_col), hkey=text_key(F.col(text_col)))
    meets = same(rows, hit, ["hid", "hkey"])
    clean = rows.join(hit, meets, "left_anti").select("row.*")
    if remove == "documents":
        return clean
    one = rows.join(hit, meets).groupBy(rows["hid"], rows["hkey"]).agg(F.any_value("row").getField(text_col).alias("text"), F.any_value("n_words").alias("n"), F.any_value("spans").alias("spans"))
    one = one.select("hid", "hkey", "n", "spans", F.regexp_extract("text", f"^{BETWEEN}", 0).alias("head"), F.regexp_extract_all("text", F.lit(ANY_WORD + BETWEEN), F.lit(0)).alias("pieces"))
    stay = F.transform("spans", lambda s, k: F.struct(s.hi.alias("lo"), F.coalesce(F.get("spans", k + 1).lo, F.col("n").cast("int")).alias("hi")))
    stay = F.concat(F.array(F.struct(F.lit(0).alias("lo"), F.get("spans", F.lit(0)).lo.alias("hi"))), stay)
    part = one.select("hid", "hkey", "head", "pieces", F.posexplode(stay).alias("k", "s"))
    part = part.select("hid", "hkey", "head", "k", F.array_join(F.slice("pieces", F.col("s.lo") + 1, F.col("s.hi") - F.col("s.lo")), "").alias("part"))
    cut = part.groupBy("hid", "hkey").agg(F.any_value("head").alias("head"), F.array_sort(F.collect_list(F.struct("k", "part"))).alias("parts"))
    cut = materialize(cut.select("hid", "hkey", F.concat("head", F.array_join("parts.part", "")).alias("left")), "cut")
    left = rows.join(cut, same(rows, cut, ["hid", "hkey"])).select(F.col("row").withField(text_col, F.col("left")).alias("row")).select("row.*")
    return clean.unionByName(left)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS l, array_to_string(w[k : k + 9], ' ') AS said
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM b WHERE len(w) > 0)),
places AS (
  SELECT r, k, l, array_to_string(w[k : k + l - 1], ' ') AS said
  FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM d, (SELECT DISTINCT l FROM win))),
hits AS (SELECT r, k, p.l, item FROM places p JOIN win USING (l, said)),
covered AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(k, k + l)) AS i FROM (SELECT DISTINCT r, k, l FROM hits)) GROUP BY r),
named AS (SELECT r, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
