"""Benchmark decontamination with a positional inverted index.

Every occurrence of a test term in the training documents becomes a posting (term, document, place), stored
in the shared folder. The postings give the terms' frequencies over all documents. Each test
window is searched from its rarest term: the list of the rarest and of the second rarest term, each shifted by the
term's offset in the test item, must meet at the same (document, item, shift). Alignments that survive are
compared word by word with the document, which yields the exact phrase matches.

Only test terms are posted, so the index grows with the documents but not with their vocabulary. Terms, anchors
and item texts are broadcast if their bytes, measured first, are few, else shuffled. No posting list is
gathered in one task: joins with the lists run where the postings lie, and alignments are
grouped per document.

Defined results: null or empty text has no words and is never hit; an item without words is no item; an item of fewer
than `window` words is one window; documents that repeat each keep a row; items that share an id count
once; empty tables give no rows, or rows without hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, small, stored

WINDOW = 13
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_END = ""


def _low(text: Column) -> Column:
    """Lower-cases A-Z only, by the cheaper function where the text is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.filter(F.split(_low(text), BREAK), lambda w: w != "")


def _key(docs: DataFrame) -> Column:
    return F.struct(F.col("doc_id"), F.xxhash64("text").alias("h"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, key, pos) of the given terms; a term '' at pos = number of words stands for each document itself."""
    words = docs.select(_key(docs).alias("key"), F.split(
        F.concat(_low(F.coalesce(F.col("text"), F.lit(""))), F.lit(" ")), BREAK, -1
    ).alias("words"))
    # a first empty word (text that starts with a break) is not counted; the last one is the document's mark
    placed = words.select(
        "key", (F.element_at("words", 1) == "").cast("int").alias("skip"), F.size("words").alias("n"), F.posexplode("words").alias("at", "term")
    ).where((F.col("term") != "") | (F.col("at") == F.col("n") - 1))
    marks = terms.select("term").union(docs.sparkSession.range(1).select(F.lit(_END).alias("term")))
    place = F.when((F.col("skip") == 1) & (F.col("n") > 1), F.col("at") - 1).otherwise(F.col("at"))
    return placed.join(small(marks, "term"), "term").select("term", "key", place.alias("pos"))


def test_items(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, words, size, last) for each distinct item with words: its windows are `size` words from each of the places 0 to last. item tells rows apart that share an id."""
    worded = items.select(F.col("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    return worded.select(
        F.struct("item_id", F.xxhash64("words").alias("h")).alias("item"), "words",
        F.least(F.size("words"), F.lit(window)).alias("size"), F.greatest(F.size("words") - window, F.lit(0)).alias("last"),
    ).dropDuplicates(["item"])


def _anchors(tests: DataFrame, counts: DataFrame) -> DataFrame:
    """For each window its two rarest terms that differ in place: (anchor, item, role, term, offset), each pair once. A word goes to the windows around it alone."""
    words = tests.select("item", "size", "last", F.posexplode("words").alias("offset", "term"))
    around = F.sequence(F.greatest(F.col("offset") - F.col("size") + 1, F.lit(0)), F.least("offset", "last"))
    terms = words.select("item", "size", "offset", "term", F.explode(around).alias("start"))
    found = (
        terms.join(counts, "term", "left")
        .groupBy("item", "start", "size")
        .agg(
            F.min(F.coalesce("n", F.lit(0))).alias("least"),
            F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset"))), 1, 2).alias("two"),
        )
        .where("least > 0")  # a term that no document has rules the window out
        .select("item", F.transform("two", lambda t: F.struct(t["term"].alias("term"), t["offset"].alias("offset"))).alias("two"))
        .distinct()
    )
    return found.select(
        F.xxhash64("item", "two").alias("anchor"), "item", F.size("two").alias("roles"), F.posexplode("two").alias("role", "t")
    ).select("anchor", "item", "roles", "role", "t.term", "t.offset")


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(marks: key, n_words per document row; matches: key, item_id, first, size for each window found in a document)."""
    tests = stored(test_items(items, window))
    terms = tests.select(F.explode("words").alias("term")).distinct()
    index = stored(build_index(docs, terms))
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    anchors = stored(_anchors(tests, counts))
    shifted = index.join(small(anchors, "term"), "term").select(
        "key", "item", "anchor", "role", "roles", (F.col("pos") - F.col("offset")).alias("shift")
    )
    aligned = (
        shifted.groupBy("key", "item", "anchor", "shift", "roles")
        .agg(F.bit_or(F.when(F.col("role") == 0, 1).otherwise(2)).alias("met"))
        .where(F.col("met") == F.when(F.col("roles") == 2, 3).otherwise(1))
        .select("key", "item", "shift").distinct()
    )
    aligned = stored(aligned)
    wanted = aligned.select("key").distinct()
    texts = docs.select(_key(docs).alias("key"), "text").join(wanted, "key", "left_semi").dropDuplicates(["key"])
    full = tests.select("item", "size", F.col("words").alias("test"))
    length = F.size("test")
    pairs = (
        texts.select("key", words_of(F.col("text")).alias("words"))
        .join(aligned, "key").join(small(full, "test"), "item")
        .select("key", "item", "shift", "size", "test", F.when(F.col("shift") >= 0, F.slice("words", F.col("shift") + 1, length)).otherwise(
            F.concat(F.array_repeat(F.lit(""), -F.col("shift")), F.slice("words", F.lit(1), F.greatest(length + F.col("shift"), F.lit(0))))
        ).alias("part"))
    )
    equal = F.array_join(F.transform("test", lambda w, i: F.when(F.coalesce(F.get("part", i) == w, F.lit(False)), "1").otherwise("0")), "")
    matches = pairs.select("key", "item", "shift", "size", equal.alias("equal")).select(
        "key", F.col("item.item_id").alias("item_id"), "size", "shift",
        F.explode(F.filter(
            F.sequence(F.lit(0), F.greatest(F.length("equal") - F.col("size"), F.lit(0))),
            lambda i: F.substr("equal", i + 1, F.col("size")) == F.repeat(F.lit("1"), F.col("size")),
        )).alias("at"),
    ).select("key", "item_id", (F.col("shift") + F.col("at")).alias("first"), "size")
    marks = index.where(F.col("term") == _END).select("key", F.col("pos").cast("bigint").alias("n_words"))
    return marks, matches


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, per_hit: int = 20) -> DataFrame:
    """Per document row: doc_id, key, n_words, n_hit, item_ids (sorted as strings), contaminated (a hit for every per_hit words or fewer)."""
    marks, matches = phrase_matches(docs, items, window)
    hits = matches.select("key", "item_id", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("size") - 1)).alias("at"))
    words = hits.groupBy("key").agg(F.countDistinct("at").alias("n_hit"))
    ids = hits.groupBy("key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    found = words.join(ids, "key")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return marks.join(found, "key", "left").select(
        F.col("key.doc_id").alias("doc_id"), "key", "n_words", n_hit.alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (n_hit * per_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any hit, with their own columns: a passage of an item leaks however long the text around it is."""
    bad = phrase_matches(docs.select("doc_id", "text"), items, window)[1].select(F.col("key").alias("bad")).distinct()
    return docs.join(bad, _key(docs).eqNullSafe(F.col("bad")), "left_anti")


def proximity_matches(docs: DataFrame, terms: list[str], slop: int) -> DataFrame:
    """(doc_id, first, last): shortest spans of at most len(terms) + slop words that hold all the terms, found in the index."""
    spark = docs.sparkSession
    wanted = sorted(set(terms))
    index = build_index(docs, spark.createDataFrame([(t,) for t in wanted], "term string")).where(F.col("term") != _END).distinct()
    reach = len(terms) + slop
    other = index.select("key", F.col("term").alias("t2"), F.col("pos").alias("p2"), F.explode(F.sequence(F.col("pos") - reach + 1, F.col("pos"))).alias("pos"))
    firsts = index.select("key", "pos")
    near = firsts.join(other, ["key", "pos"]).groupBy("key", "pos", "t2").agg(F.min("p2").alias("p2"))
    return (
        near.groupBy("key", "pos").agg(F.count(F.lit(1)).alias("n"), F.max("p2").alias("last")).where(F.col("n") == len(wanted))
        .select("key.doc_id", F.col("pos").alias("first"), "last")
    )
