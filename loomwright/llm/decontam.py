"""Benchmark decontamination with a distributed positional inverted index, in DataFrame functions alone.

The index has a posting (term, text, position) for each place of a term in the corpus. A window of a benchmark item
occurs where its terms' lists, each moved back by the term's offset in the window, have a start in common. The lists are
intersected from the rarest on: corpus counts tell each window's rarest terms; postings of the LEAD rarest are stored for
the whole corpus and intersected; those of the other terms are stored only for the texts that are left, and
intersected with what is left. Texts are named by two 64-bit hashes, so copies of a text are one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

# What a word is, and the letters that are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WINDOW = 10
#: So many of a window's rarest terms have postings of the whole corpus.
LEAD = 3
KEY = ["hash", "more"]
#: Rows of a lookup table (a term of the benchmark and two numbers) up to which it is broadcast.
BROADCAST_ROWS = 200_000


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() does just that to a text of ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_list(text: Column) -> Column:
    """The words as they are written: lower-casing moves none of their bounds, so each step does it to what it needs."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, more, words) of docs (doc_id, text): hash and more name the text, null like itself."""
    text = F.col("text")
    return docs.select("doc_id", F.xxhash64(text).alias("hash"), F.xxhash64(F.lit(1), text).alias("more"), word_list(text).alias("words"))


def _lookup(df: DataFrame) -> DataFrame:
    """df written once; broadcast if its counted rows are few, else left to a shuffle join."""
    df = materialize(df, "lookup")
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(w, terms, items): distinct windows of `size` consecutive words of items (item_id, text) with a number, and the item
    ids, as strings, that hold each. An item of fewer words, but not none, is one window; item ids of null are left out."""
    rows = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), word_list(ascii_lower(F.col("text"))).alias("words")).where("size(words) > 0")
    rows = rows.select("item", "words", F.explode(F.expr(f"sequence(0, greatest(size(words) - {size}, 0))")).alias("at"))
    rows = rows.select("item", F.slice("words", F.col("at") + 1, F.lit(size)).alias("terms"))
    found = rows.groupBy("terms").agg(F.collect_set("item").alias("items"))
    return materialize(found.select(F.monotonically_increasing_id().alias("w"), "terms", "items"), "windows")


def rarest_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(w, n, items, places): windows with their n places (df, term, offset), the corpus's rarest term first. Windows with a
    term that the corpus lacks are left out: they can't occur."""
    terms = found.select(F.explode(F.array_distinct("terms")).alias("term")).distinct()
    counts = keyed(docs).select(F.explode("words").alias("word")).select(ascii_lower(F.col("word")).alias("term")).join(_lookup(terms), "term").groupBy("term").agg(F.count("*").alias("df"))
    each = found.select("w", F.size("terms").alias("n"), F.posexplode("terms").alias("offset", "term")).join(materialize(counts, "terms"), "term")
    places = each.groupBy("w", "n").agg(F.array_sort(F.collect_list(F.struct("df", "term", "offset"))).alias("places")).where("size(places) = n")
    return materialize(places.join(found.select("w", "items"), "w"), "windows")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: (hash, more, term, at) for each place in docs (doc_id, text) of a term of terms (term). Copies of a text
    have one posting a place."""
    rows = keyed(docs).select(*KEY, F.posexplode("words").alias("at", "word")).withColumn("term", ascii_lower(F.col("word")))
    return materialize(rows.join(_lookup(terms.select("term").distinct()), "term").select(*KEY, "term", "at").distinct(), "index")


def _intersect(starts: DataFrame, index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of starts (w, hash, more, start) at which every wanted place (w, term, offset) of the window has a posting: the terms'
    lists moved back by their offsets, and met. A window of which nothing is wanted keeps its starts."""
    wanted = _lookup(wanted)
    number = wanted.groupBy("w").agg(F.count("*").alias("wanted"))
    asked = starts.join(wanted, "w").select("w", *KEY, "start", "term", (F.col("start") + F.col("offset")).alias("at"))
    met = asked.join(index, [*KEY, "term", "at"]).groupBy("w", *KEY, "start").agg(F.count("*").alias("met"))
    full = met.join(_lookup(number), "w").where("met = wanted").select("w", *KEY, "start")
    return full.union(starts.join(wanted.select("w").distinct(), "w", "left_anti").select("w", *KEY, "start"))


def phrase_matches(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(hash, more, start, n, items): every occurrence of a window of found (rarest_first) in a text of docs."""
    place = lambda a: F.explode(a).alias("p")
    lead = found.select("w", place(F.slice("places", 1, LEAD))).select("w", "p.term", "p.offset")
    index = postings(docs, lead)
    first = found.select("w", F.col("places")[0]["term"].alias("term"), F.col("places")[0]["offset"].alias("offset"))
    starts = index.join(_lookup(first), "term").select("w", *KEY, (F.col("at") - F.col("offset")).alias("start")).where("start >= 0")
    second = found.select("w", place(F.slice("places", 2, LEAD - 1))).select("w", "p.term", "p.offset")
    starts = materialize(_intersect(starts, index, second), "starts")
    # What is left needs the other terms' lists, of the texts that are left alone.
    rest = found.join(starts.select("w").distinct(), "w", "left_semi").where(F.size("places") > LEAD)
    rest = materialize(rest.select("w", place(F.slice("places", F.lit(LEAD + 1), F.size("places")))).select("w", "p.term", "p.offset"), "rest")
    named = docs.select("doc_id", "text").withColumns({"hash": F.xxhash64("text"), "more": F.xxhash64(F.lit(1), "text")})
    left = named.join(_lookup(starts.select(*KEY).distinct()), KEY, "left_semi").select("doc_id", "text")
    starts = _intersect(starts, postings(left, rest), rest)
    return starts.join(_lookup(found.select("w", "n", "items")), "w").select(*KEY, "start", "n", "items")


def proximity_matches(index: DataFrame, pairs: DataFrame, within: int = WINDOW - 1) -> DataFrame:
    """(hash, more, first, second, at, other_at): places where two terms of pairs (first, second) are at most `within` words apart, in
    either order. index must have the postings of both."""
    a = index.join(_lookup(pairs.select("first", "second").distinct()), F.col("term") == F.col("first")).select(*KEY, "first", "second", "at")
    # A place meets those of its own and the two neighbouring stretches of `within` words, so the join has equal keys alone.
    stretch = lambda c: F.floor(F.col(c) / within)
    a = a.withColumn("s", F.explode(F.array(*(stretch("at") + d for d in (-1, 0, 1)))))
    b = index.select(*KEY, F.col("term").alias("second"), F.col("at").alias("other_at"), stretch("at").alias("s"))
    near = a.join(b, [*KEY, "second", "s"])
    return near.where((F.col("other_at") != F.col("at")) & (F.abs(F.col("other_at") - F.col("at")) <= within)).select(*KEY, "first", "second", "at", "other_at")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated, hits) per row of docs (doc_id, text).

    A word inside any occurrence of a window of items (item_id, text) is hit; hits are the maximal hit runs as (start, end).
    Null and empty texts have no words; repeated rows are judged each; a null doc_id is kept; empty tables give no
    rows, or rows without hits. Only doc_id, text, item_id and text are read."""
    matches = materialize(phrase_matches(docs, rarest_first(docs, windows(items, size))), "matches")
    # Maximal runs of a text: a span opens one where it starts behind all ends before it.
    spans = matches.groupBy(*KEY, "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    order = Window.partitionBy(*KEY).orderBy("start")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("opens", (before.isNull() | (before < F.col("start"))).cast("int")).withColumn("run", F.sum("opens").over(order))
    runs = spans.groupBy(*KEY, "run").agg(F.min("start").cast("int").alias("start"), F.max("end").cast("int").alias("end"))
    runs = runs.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("hits"), F.sum(F.col("end") - F.col("start")).alias("n_hit"))
    held = matches.select(*KEY, F.explode("items").alias("item")).distinct().groupBy(*KEY).agg(F.array_sort(F.collect_list("item")).alias("items"))
    by_text = materialize(runs.join(held, KEY), "hits")
    # The counts are taken before the shuffle, so that no text moves.
    base = keyed(docs).select("doc_id", *KEY, F.size("words").cast("long").alias("n_words"))
    out = base.join(by_text, KEY, "left")
    items_, n_hit = F.coalesce("items", F.expr("cast(array() as array<string>)")), F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"), (n_hit > 0).alias("contaminated"), "hits")


def uncontaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of docs (doc_id, text, ...) that hold no window of items; null and empty texts hold none.

    Repeated rows and copies of a text are judged alike, a null doc_id is no matter, further columns stay as they are, and
    empty tables give no rows or all."""
    hit = _lookup(phrase_matches(docs, rarest_first(docs, windows(items, size))).select(*KEY).distinct())
    rows = docs.withColumns({"__hash": F.xxhash64("text"), "__more": F.xxhash64(F.lit(1), "text")})
    return rows.join(hit, (rows["__hash"] == hit["hash"]) & (rows["__more"] == hit["more"]), "left_anti").drop("__hash", "__more")
