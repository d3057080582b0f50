"""Quality rules as a short-circuit cascade.

Each rule rejects a document by a predicate. On a bounded sample each rule's cost (time of its
predicate over the sample, less that of an empty pass) and selectivity (share rejected) are measured;
rules are ordered by rejection per cost and become one CASE chain, so a document that an early rule rejects
never reaches the later ones. The order changes the cost only, never a verdict: a document is kept
if no rule rejects it.

Statistics come from array functions over the document's own words, so nothing is shuffled and a
hot source weighs as its rows do. Repeated 5-word windows are found by sorting 64-bit window
fingerprints with their positions: linear-logarithmic in the text, whole texts always.

Defined results: a null or empty text has no words and is rejected; repeated rows are judged alike, one
row each; columns of other names are carried only where asked for; an empty table gives no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, split_words

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
#: Rows of the sample on which costs and selectivities are measured.
SAMPLE_ROWS = 256
_BITS = 24


@dataclass(frozen=True)
class Rule:
    """rejects: from the columns of with_statistics() to a boolean column."""

    name: str
    rejects: Callable[[], Column]


RULES = [
    Rule("few_words", lambda: F.col("n_words") < 10),
    Rule("repeats", lambda: F.col("n_repeat_words") * 100 > F.col("n_words") * 20),
    Rule("symbols", lambda: F.col("n_symbols") * 100 > F.col("n_words") * 20),
    Rule("repeated_lines", lambda: F.col("n_dup_lines") * 2 > F.col("n_lines")),
    Rule("word_length", lambda: ~F.col("word_chars").between(F.col("n_words") * 2, F.col("n_words") * 15)),
]


def _grams(words: Column) -> Column:
    """A fingerprint of each window of words."""
    def over(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    return F.when(F.size(words) >= WINDOW, let(F.transform(words, lambda w: F.xxhash64(w)), over)).otherwise(
        F.array().cast("array<bigint>")
    )


def _repeated_at(grams: Column) -> Column:
    """Sorted places of the windows that occur twice or more."""
    mask = (1 << _BITS) - 1

    def neighbours(order: Column, key: Callable[[Column], Column], place: Callable[[Column], Column]) -> Column:
        def over(s: Column) -> Column:
            def mark(v: Column, i: Column) -> Column:
                def same(other: Column) -> Column:
                    return F.coalesce(
                        (key(other) == key(v)) & (F.get(grams, place(other)) == F.get(grams, place(v))), F.lit(False)
                    )

                return F.when(same(F.get(s, i - 1)) | same(F.get(s, i + 1)), place(v))

            return F.sort_array(F.array_compact(F.transform(s, mark)))

        return let(order, over)

    packed = F.sort_array(F.transform(grams, lambda h, i: h.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("bigint"))))
    wide = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(
        F.size(grams) <= mask,
        neighbours(packed, lambda v: F.shiftright(v, _BITS), lambda v: v.bitwiseAND(F.lit(mask)).cast("int")),
    ).otherwise(neighbours(wide, lambda v: v["h"], lambda v: v["i"]))


def _covered(places: Column) -> Column:
    """Words under windows that start at the sorted places."""
    def over(p: Column) -> Column:
        gap = F.transform(p, lambda v, i: F.least(F.coalesce(F.get(p, i + 1) - v, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gap, F.lit(0).cast("bigint"), lambda a, g: a + g)

    return let(places, over)


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words (and the columns in keep)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = docs.select(
        F.col(id_col).alias("_id"),
        *[F.col(c).alias(f"_kept_{i}") for i, c in enumerate(keep)],
        split_words(text).alias("_words"),
        (F.size(F.split(text, SYMBOLS, -1)) - 1).cast("bigint").alias("n_symbols"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    second = first.select(
        "_id", *[f"_kept_{i}" for i in range(len(keep))], "n_symbols",
        F.size("_words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        _grams(F.col("_words")).alias("_grams"),
    )
    repeated = F.size(F.array_distinct("_grams")) < F.size("_grams")
    return second.select(
        F.col("_id").alias(id_col),
        *[F.col(f"_kept_{i}").alias(c) for i, c in enumerate(keep)],
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines",
        F.when(repeated, let(F.col("_grams"), lambda g: _covered(_repeated_at(g)))).otherwise(F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )


def measure(sample: DataFrame, rules: list[Rule] = RULES) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) on a sample that has the documents' columns."""
    def seconds(df: DataFrame) -> float:
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    stats = with_statistics(sample)
    idle = seconds(sample.select(F.length("text")))
    total, *rejected = stats.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(r.rejects()).alias(r.name) for r in rules]).first()
    return [
        (r, max(1e-4, seconds(stats.select(r.rejects().alias("x"))) - idle), n / max(1, total))
        for r, n in zip(rules, rejected, strict=True)
    ]


def order_rules(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejection per cost, best first; ties keep the given order."""
    found = measure(docs.select("doc_id", "text").limit(sample_rows), rules)
    return [r for r, _, _ in sorted(found, key=lambda x: -x[2] / x[1])]


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, or null; later predicates are not evaluated."""
    out = None
    for r in rules:
        out = F.when(r.rejects(), F.lit(r.name)) if out is None else out.when(r.rejects(), F.lit(r.name))
    return F.lit(None).cast("string") if out is None else out


def judge_documents(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics, the rejecting rule (`rejected_by`, null if kept) and `kept` for every document."""
    ordered = order_rules(docs, rules, sample_rows)
    return with_statistics(docs).withColumn("rejected_by", cascade(ordered)).withColumn("kept", F.col("rejected_by").isNull())


def filter_documents(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that every rule keeps, with their own columns."""
    columns = docs.columns
    judged = with_statistics(docs, keep=tuple(c for c in columns if c != "doc_id"))
    return judged.where(cascade(order_rules(docs, rules, sample_rows)).isNull()).select(*columns)
