"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the base kinds' matches. Every word with a digit or an at sign is an occurrence of an instance (its text); its lexical patterns are the word before it,
the two words before it, and the word before together with the word after. Patterns and instances form a graph with the
occurrences as edges, which is scored in rounds:

- a pattern is good for a kind if SUPPORT distinct known instances of that kind stand at it, and these take at least CONFIDENCE of all the times that
  the pattern's words occur in the corpus, with anything at the place;
- an instance of DIGITS digits becomes known if at least CONFIDENCE of its occurrences stand at good patterns; it then counts for its other patterns.

Rounds end when nothing new becomes known. Occurrences at good patterns and occurrences of known instances are the discovered spans. Both sides of each
share count occurrences in all rows, copies included.

Offsets: a text split by an expression and the matches of the same expression alternate; a running sum of their lengths gives
each match's place, in code points. Only matches are shuffled. Nested repetitions are written as plain classes over a text in
which separators that cannot join are replaced one for one, so no text makes the expressions backtrack or recurse.

Defined results: null or empty text has no spans; rows that repeat each get the same spans; an empty table gives no rows; other columns
are ignored. A discovered span has the kind of its pattern and never overlaps a base span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, drop_stored, let, small, stored

KINDS = ("email", "ip", "card", "phone")
SUPPORT, CONFIDENCE, DIGITS = 3, 0.5, 4
_BLANK = r"[\x20\x09-\x0D]+"
_WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"


def _sources() -> dict[str, tuple[str, str, str, str]]:
    """kind: (filter on the text, what is replaced, by what, expression)."""
    return {
        "email": ("@", r"\.(?![A-Za-z0-9-])|(?<![A-Za-z0-9-])\.", "_", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"),
        "ip": (r"[0-9]\.[0-9]", "", "", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
        "card": (r"[0-9](?:[\x20-]?[0-9]){12}", r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", "x", r"[0-9][0-9\x20-]*+"),
        "phone": (r"\+[0-9]", "", "", r"\+[0-9][\x20().0-9-]+[0-9]"),
        "word": (r"[0-9@]", "", "", _WORD),
    }


def _key(docs: DataFrame) -> Column:
    return F.struct(docs["doc_id"], F.xxhash64(docs["text"]).alias("h"))


def _located(docs: DataFrame, kind: str) -> DataFrame:
    """(key, kind, at, start, match): the kind's matches with their places; of words also left and right, up to two words before and one after."""
    wanted, out, by, regex = _sources()[kind]
    text = F.regexp_replace("text", out, by) if out else F.col("text")
    gaps = F.split("t", regex, -1)
    after = F.slice(gaps, F.lit(2), F.size(gaps)) if kind == "word" else F.array().cast("array<string>")
    found = docs.where(F.col("text").rlike(wanted)).select(_key(docs).alias("key"), text.alias("t")).select(
        "key", F.posexplode(F.arrays_zip(F.regexp_extract_all("t", F.lit(regex), F.lit(0)).alias("match"), gaps.alias("gap"), after.alias("after"))).alias("at", "p")
    )
    rows = found.select("key", "at", F.col("p.match").alias("match"), F.col("p.gap").alias("gap"), F.col("p.after").alias("after")).where("match IS NOT NULL")
    length = F.char_length("gap")
    if kind == "word":
        rows = rows.withColumn("length", length).withColumns({"left": _words("gap", -2), "right": _words("after", 1)}).drop("gap", "after")
        length, kept = F.col("length"), ("left", "right")
    else:
        rows, length, kept = rows.withColumn("gap", length).drop("after"), F.col("gap"), ()
    before = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(length + F.char_length("match")).over(before) - F.char_length("match")
    return rows.distinct().select("key", F.lit(kind).alias("kind"), "at", start.cast("bigint").alias("start"), "match", *kept)


def _words(text: str, n: int) -> Column:
    """The first n words of a text, or the last -n."""
    words = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BLANK), lambda w: w != "")
    return F.slice(words, F.lit(1), F.lit(n)) if n > 0 else let(words, lambda w: F.slice(w, F.greatest(F.size(w) + n, F.lit(0)) + 1, F.lit(-n)))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.reverse(F.split(digits, "(?<=.)(?=.)")), lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def base_spans(docs: DataFrame) -> DataFrame:
    """(key, kind, start, end, match) of the base kinds."""
    match = F.col("match")
    digits = _digits(match)
    small = F.forall(F.split(match, r"\."), lambda p: F.lpad(F.regexp_replace(p, "^0+", ""), 20, "0") <= F.lpad(F.lit("255"), 20, "0"))
    fits = {
        "email": F.lit(True), "ip": small,
        "card": F.length(digits).between(13, 19) & _luhn(digits), "phone": F.length(digits).between(9, 15),
    }
    out = None
    for kind in KINDS:
        long = F.forall(F.split(match, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) if kind == "ip" else F.lit(True)
        one = _located(docs, kind).where(long & fits[kind]).select("key", "kind", "start", (F.col("start") + F.char_length("match")).alias("end"), "match")
        out = one if out is None else out.unionByName(one)
    return out


def _patterns(left: Column, right: Column) -> Column:
    """The patterns of an occurrence by the words around it: `a`, `a b` (before it) and `b _ c`."""
    near, far, after = F.try_element_at(left, F.lit(-1)), F.try_element_at(left, F.lit(-2)), F.try_element_at(right, F.lit(1))
    return F.array_compact(F.array(near, F.concat(far, F.lit(" "), near), F.concat(near, F.lit(" _ "), after)))


def _pattern_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pattern, total): how often the words of each wanted pattern occur in all documents."""
    words = F.filter(F.split(ascii_lower(F.coalesce("text", F.lit(""))), _BLANK), lambda w: w != "")

    def every(w: Column) -> Column:
        def shifted(n: int) -> Column:
            return F.slice(w, F.lit(1 + n), F.size(w))

        pairs = F.zip_with(w, shifted(1), lambda a, b: F.concat(a, F.lit(" "), b))
        around = F.zip_with(w, shifted(2), lambda a, b: F.concat(a, F.lit(" _ "), b))
        return F.concat(w, F.array_compact(pairs), F.array_compact(around))

    met = docs.select(F.explode(let(words, every)).alias("pattern"))
    return met.join(small(wanted, "pattern"), "pattern").groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))


def find_personal_data(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(base spans, discovered spans), each (key, kind, start, end)."""
    docs = docs.select("doc_id", "text")
    base = stored(base_spans(docs))
    left, right = r"^[^A-Za-z0-9+]+", r"[^A-Za-z0-9]+$"
    lead = F.char_length("match") - F.char_length(F.regexp_replace("match", left, ""))
    value = F.regexp_replace(F.regexp_replace("match", left, ""), right, "")
    seen = _located(docs, "word").select("key", _patterns(F.col("left"), F.col("right")).alias("patterns"), value.alias("value"), (F.col("start") + lead).alias("start")).where("value != ''")
    seen = seen.withColumn("end", F.col("start") + F.char_length("value"))
    spans = base.select(F.col("key").alias("k"), F.col("kind").alias("base"), F.col("start").alias("b"), F.col("end").alias("e"), "match")
    met = seen.join(spans, (seen["key"] == spans["k"]) & (seen["start"] < spans["e"]) & (spans["b"] < seen["end"]), "left")
    found = met.groupBy("key", "patterns", "value", "start", "end").agg(F.min("base").alias("base"), F.coalesce(F.min("match"), F.col("value")).alias("whole"))
    # rows that repeat share a key: each of their occurrences stands for as many
    copies = docs.groupBy(_key(docs).alias("key")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    fits = (F.length(_digits(F.col("value"))) >= DIGITS) | F.contains("value", F.lit("@"))
    occurrences = stored(found.join(copies, "key", "left").withColumns({"copies": F.coalesce("copies", F.lit(1)), "open": F.col("base").isNull() & fits}))
    edges = occurrences.select("key", "start", "whole", "copies", "open", F.explode("patterns").alias("pattern"))
    busy = edges.select("pattern", "whole").distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT).select("pattern")
    totals = stored(_pattern_counts(docs, stored(busy)))
    edges = stored(edges.join(totals.select("pattern"), "pattern"))
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("base"))
    known = stored(occurrences.where("base IS NOT NULL").groupBy("whole").agg(F.min_by("base", order).alias("label")))
    size, spare = known.count(), known
    while True:
        # first by value: a hot pattern's values are dealt out before they are counted by pattern
        values = edges.join(known, "whole").groupBy("pattern", "label", "whole").agg(F.sum("copies").alias("n"))
        good = (
            values.groupBy("pattern", "label").agg(F.count(F.lit(1)).alias("support"), F.sum("n").alias("f"))
            .join(totals, "pattern").where((F.col("support") >= SUPPORT) & (F.col("f") >= F.col("total") * CONFIDENCE))
            .groupBy("pattern").agg(F.max(F.struct("f", "label")).alias("best")).select("pattern", F.col("best.label").alias("kind"), F.col("best.f").alias("f"))
        )
        # an occurrence takes the kind of its best pattern
        behind = stored(edges.where("open").join(good, "pattern").groupBy("key", "start", "whole", "copies").agg(F.max(F.struct("f", "kind")).alias("best")).select("key", "start", "whole", "copies", F.col("best.kind").alias("kind")))
        every = occurrences.where("open").groupBy("whole").agg(F.sum("copies").alias("all"))
        shares = behind.groupBy("whole", "kind").agg(F.sum("copies").alias("n")).join(every, "whole").where(F.col("n") >= F.col("all") * CONFIDENCE)
        new = shares.groupBy("whole").agg(F.max(F.struct("n", "kind")).alias("best")).select("whole", F.col("best.kind").alias("label")).join(known, "whole", "left_anti")
        now = stored(known.unionByName(new))
        count = now.count()
        if count == size:
            break
        drop_stored(behind)
        drop_stored(spare)
        known = spare = now
        size = count
    labelled = occurrences.where("open").join(known, "whole", "left").join(behind.select("key", "start", "kind"), ["key", "start"], "left")
    new_spans = labelled.where("kind IS NOT NULL OR label IS NOT NULL").select("key", F.coalesce("kind", "label").alias("kind"), "start", "end")
    return base.drop("match"), new_spans


def personal_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (array<struct<kind, start, end>> by kind as in KINDS, then start) for each row of docs."""
    base, new = find_personal_data(docs)
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    one = F.struct(place.alias("place"), "start", "end", "kind", "new")
    every = base.withColumn("new", F.lit(False)).unionByName(new.withColumn("new", F.lit(True)))
    found = every.groupBy("key").agg(F.array_sort(F.collect_list(one)).alias("all"))
    rows = docs.select(_key(docs).alias("key"), "doc_id").join(found, "key", "left")
    all_of = F.coalesce("all", F.array().cast(dict(found.dtypes)["all"]))
    def bare(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return rows.select("doc_id", bare(F.filter(all_of, lambda s: ~s["new"])).alias("base"), bare(all_of).alias("spans"))
