"""Benchmark decontamination: a positional inverted index, in DataFrame functions only.

Method: corpus counts of the benchmark's terms tell the two rarest terms of every window (10 words, or
the whole item). Postings (term, document, position) of those terms are stored; postings of a term
become diagonals, document position minus item position, and intersecting the lists of one window's
rarest terms is meeting on one diagonal. Diagonals on which two such terms meet are near matches;
those on which all words of a window stand are exact phrase matches.

Words never looked up have no stored postings. Tables of terms and of diagonals are written before
they are joined, so the planner knows their true size: it broadcasts them only under its threshold and
else shuffles, splitting skewed keys. Documents are keyed by id and text hash, so equal rows share
results and none is lost.

Defined cases: null texts and texts without words have no words and no hits; null and empty items have
no windows; items of equal id count once; items with a null id hit words but are not listed; repeated
documents get a row each. Only ``doc_id``, ``text``, ``item_id`` are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windrow.llm.frames import fresh, stored
from windrow.llm.registry import query, table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Settings:
    window: int = 10
    rarest: int = 2  # terms of a window whose lists are intersected


def raw_words(text: Column) -> Column:
    """Words in order, as written."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def folded(word: Column) -> Column:
    """A-Z in lower case; ``lower`` does just that to a word of ASCII alone."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, UPPER.lower()))


def term(word: Column) -> Column:
    return F.xxhash64(folded(word))


def keyed(documents: DataFrame) -> DataFrame:
    """Key of every row, null ids as the lowest number, and its words."""
    return documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("text_key"),
        raw_words(F.col("text")).alias("words"),
    )


def tokens(documents: DataFrame) -> DataFrame:
    """``key, text_key, pos, term`` of every word."""
    return keyed(documents).select("key", "text_key", F.posexplode("words").alias("pos", "word")).select(
        "key", "text_key", "pos", term(F.col("word")).alias("term")
    )


def pivots(items: DataFrame, counts: DataFrame, s: Settings) -> DataFrame:
    """``item, place, term, n``: places that are among the rarest of a window, each once."""
    words = items.select("item", "n", F.posexplode("terms").alias("place", "term"))
    ranked = words.join(counts, "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    first = F.greatest(F.col("place") - (s.window - 1), F.lit(0))
    last = F.least(F.col("place"), F.greatest(F.col("n") - s.window, F.lit(0)))
    inside = ranked.withColumn("window", F.explode(F.sequence(first, last)))
    order = Window.partitionBy("item", "window").orderBy("count", "term", "place")
    rarest = inside.withColumn("r", F.row_number().over(order)).where(F.col("r") <= s.rarest)
    return rarest.select("item", "place", "term", "n").distinct()


def matched(documents: DataFrame, benchmark: DataFrame, s: Settings) -> DataFrame:
    """``key, text_key, item_id, at, starts, length`` of diagonals on which rare terms met.

    ``at`` is the document position of the item's first word, ``starts`` the places of the item from
    which a whole window stands in the document (empty: a near match only).
    """
    items = benchmark.select("item_id", F.transform(raw_words(F.col("text")), term).alias("terms")).where(F.size("terms") > 0)
    items = items.distinct().select("item_id", F.xxhash64("item_id", "terms").alias("item"), "terms", F.size("terms").alias("n"))
    items = stored(items, "items")
    asked = stored(items.select(F.explode("terms").alias("term")).distinct(), "terms")
    counts = tokens(documents).select("term").join(asked, "term").groupBy("term").agg(F.count("*").alias("count"))
    places = stored(pivots(items, counts, s), "pivots")
    looked_up = stored(places.select("term").distinct(), "pivot-terms")
    postings = stored(tokens(documents).join(looked_up, "term"), "postings")
    meeting = (
        postings.join(places, "term")
        .withColumn("at", F.col("pos") - F.col("place"))
        .groupBy("key", "text_key", "item", "at")
        .agg(F.count("*").alias("met"), F.first("n").alias("n"))
        .where(F.col("met") >= F.least(F.lit(s.rarest), F.col("n")))
        .drop("met", "n")
    )
    meeting = stored(meeting, "diagonals")
    texts = keyed(documents).join(stored(meeting.select("key", "text_key").distinct(), "candidates"), ["key", "text_key"])
    texts = texts.dropDuplicates(["key", "text_key"]).select("key", "text_key", F.transform("words", term).alias("own"))
    both = meeting.join(texts, ["key", "text_key"]).join(items, "item")
    both = both.withColumn(
        "equal", F.transform("terms", lambda t, i: F.coalesce(F.get("own", F.col("at") + i) == t, F.lit(False)))
    ).withColumn("length", F.least(F.lit(s.window), F.col("n")))
    starts = F.filter(
        F.sequence(F.lit(0), F.col("n") - F.col("length")),
        lambda i: F.forall(F.slice("equal", i + 1, F.col("length")), lambda x: x),
    )
    return both.select("key", "text_key", "item_id", "at", starts.alias("starts"), "length")


def contaminated(documents: DataFrame, benchmark: DataFrame, s: Settings | None = None) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near`` of every document.

    ``n_near`` counts the items of which only rare terms stand in line in the document.
    """
    s = s or Settings()
    found = stored(matched(documents, benchmark, s), "matches")
    exact = F.size("starts") > 0
    spans = F.transform("starts", lambda i: F.sequence(F.col("at") + i, F.col("at") + i + F.col("length") - 1))
    hit = found.where(exact).select("key", "text_key", F.explode(F.array_distinct(F.flatten(spans))).alias("pos"))
    hit = hit.distinct().groupBy("key", "text_key").agg(F.count("*").alias("n_hit"))
    name = F.col("item_id").cast("string")
    items = found.groupBy("key", "text_key").agg(
        F.array_sort(F.collect_set(F.when(exact, name))).alias("items"),
        F.collect_set(F.when(~exact, name)).alias("near"),
    )
    rows = documents.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("text_key"),
        F.size(raw_words(F.col("text"))).cast("long").alias("n_words"),
    )
    rows = rows.join(hit, ["key", "text_key"], "left").join(items, ["key", "text_key"], "left")
    listed = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce(F.size(F.array_except("near", listed)), F.lit(0)).cast("long").alias("n_near"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, s: Settings | None = None) -> DataFrame:
    """The documents, all columns as they are, that hold no window of any item."""
    found = matched(documents, benchmark, s or Settings()).where(F.size("starts") > 0).select("key", "text_key").distinct()
    found = stored(found, "contaminated")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    names = [fresh(documents, "key"), fresh(documents, "text_key")]
    marked = documents.withColumns(dict(zip(names, (key, F.xxhash64("text")))))
    return marked.join(found.toDF(*names), names, "left_anti").select(*documents.columns)


WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
items AS (SELECT item_id, {WORDS} AS w FROM benchmark),
asked AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT l FROM asked),
hits AS (
  SELECT r, i, l, item_id FROM (
    SELECT r, l, i, array_to_string(w[i:i + l - 1], ' ') AS phrase
    FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM docs, lengths WHERE len(w) >= l)) JOIN asked USING (l, phrase)),
spots AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + l)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS names FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(len(names), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(names, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM docs LEFT JOIN spots USING (r) LEFT JOIN named USING (r)
"""


@query(ORACLE)
def op2_positional_index(spark: SparkSession, folder: str) -> DataFrame:
    """Words hit by benchmark windows and the items they are of, per document."""
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("n_near")
