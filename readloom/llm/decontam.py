"""Benchmark decontamination: a positional inverted index of the corpus, intersected from the rarest terms.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import materialize

#: Consecutive item words in a window.
WINDOW = 10
#: Terms of a window whose postings are intersected before the words themselves are compared.
ANCHORS = 2
#: Tasks that the documents of one term are dealt to.
SALT = 16
#: Terms are broadcast if they take at most so many bytes, with TERM_BYTES for each beside its text.
BROADCAST_BYTES, TERM_BYTES = 16 << 20, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word, before A-Z is lower-cased, and what stands between words.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def raw_words(text: Column) -> Column:
    # a split takes a fifth of the time of extracting each match
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN, -1), "")


def ascii_lower(words: Column) -> Column:
    return F.transform(words, lambda w: F.translate(w, UPPER, LOWER))


def fold(word: Column) -> Column:
    """A cheaper form than A-Z lower-casing that equal words share; only finds candidates."""
    return F.lower(word)


def row_key() -> list[Column]:
    """doc_id and a hash of the text, so that rows of one doc_id with unlike texts stay apart."""
    return [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(wid, words, items): distinct windows and the ids of the items, as strings, that have them."""
    words = items.select(F.col("item_id").cast("string").alias("item"), ascii_lower(raw_words(F.col("text"))).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    cut = words.where(F.size("w") > 0).withColumn("start", F.explode(starts))
    return (
        cut.groupBy(F.slice("w", F.col("start") + 1, F.lit(window)).alias("words"))
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .withColumn("wid", F.unhex(F.md5(F.concat_ws(" ", "words"))))
    )


def salt_of(*names: str) -> Column:
    """The task, of the SALT of a term, that a row is dealt to."""
    return F.pmod(F.xxhash64(*names), F.lit(SALT)).cast("int")


def document_salt() -> Column:
    return salt_of("doc_id", "text_hash")


def each_salt() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))


def meet_terms(rows: DataFrame, terms: DataFrame, salt: Column, how: str = "inner") -> DataFrame:
    """`rows` joined by term with `terms`, a written table that has each term once. Terms whose bytes are counted and few are
    broadcast; else the rows of one term are dealt to SALT tasks by `salt`."""
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + TERM_BYTES), F.lit(0)).alias("n")).first()["n"]
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(terms), "term", how)
    return rows.withColumn("salt", salt).join(terms.withColumn("salt", each_salt()), ["term", "salt"], how).drop("salt")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, text_hash, positions): the positional postings of `terms` (one column, term; written) in `docs`."""
    tokens = docs.select(*row_key(), F.posexplode(raw_words(F.col("text"))).alias("pos", "word"))
    tokens = tokens.select("doc_id", "text_hash", "pos", fold(F.col("word")).alias("term"))
    found = meet_terms(tokens, terms, document_salt())
    return found.groupBy("term", "doc_id", "text_hash").agg(F.collect_set("pos").alias("positions"))


def rarest_terms(docs: DataFrame, windows: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """(term, wid, offset, needed): of each window the `anchors` terms that the corpus holds least often.
    A window with a term that the corpus lacks occurs nowhere and has no row."""
    terms = windows.select("wid", F.posexplode("words").alias("offset", "word")).withColumn("term", fold(F.col("word")))
    asked = materialize(terms.select("term").distinct(), "asked-terms")
    # words meet the terms by a counted broadcast or salted, so that no word gathers in a task, and only the terms' words are counted
    words = docs.select(*row_key(), F.explode(raw_words(F.col("text"))).alias("word")).select("doc_id", "text_hash", fold(F.col("word")).alias("term"))
    counts = materialize(meet_terms(words, asked, document_salt()).groupBy("term").agg(F.count("*").alias("n")), "counts")
    ranked = (
        meet_terms(terms, counts, salt_of("wid"), "left")
        .withColumn("at", F.row_number().over(Window.partitionBy("wid").orderBy(F.col("n").asc_nulls_first(), "offset")))
        .withColumn("least", F.min(F.coalesce("n", F.lit(0))).over(Window.partitionBy("wid")))
    )
    return ranked.where((F.col("at") <= anchors) & (F.col("least") > 0)).select(
        "term", "wid", "offset", F.count("*").over(Window.partitionBy("wid")).alias("needed")
    )


def phrase_candidates(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, text_hash, wid, start): where all anchor terms of a window stand at their offsets."""
    # documents of a frequent term are dealt to SALT tasks, each with the anchors of its term, which the items bound
    salted = index.withColumn("salt", document_salt())
    spread = anchors.withColumn("salt", each_salt())
    lists = salted.join(spread, ["term", "salt"]).select(
        "doc_id", "text_hash", "wid", "needed", F.explode(F.transform("positions", lambda p: p - F.col("offset"))).alias("start")
    )
    return (
        lists.where("start >= 0")
        .groupBy("doc_id", "text_hash", "wid", "start")
        .agg(F.count("*").alias("n"), F.first("needed").alias("needed"))
        .where("n = needed")
        .select("doc_id", "text_hash", "wid", "start")
    )


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, anchors: int = ANCHORS) -> DataFrame:
    """`docs` with n_words and occurrences, array<struct<start, len, items>>: each place where a window occurs."""
    windows = materialize(item_windows(items, window), "windows")
    chosen = materialize(rarest_terms(docs, windows, anchors), "anchors")
    index = materialize(postings(docs, materialize(chosen.select("term").distinct(), "terms")), "postings")
    places = phrase_candidates(index, chosen).join(windows, "wid")
    places = places.groupBy(F.col("doc_id").alias("_of_id"), F.col("text_hash").alias("_of_hash")).agg(
        F.collect_list(F.struct("start", "words", "items")).alias("_places")
    )
    places = materialize(places, "places")
    kept = [c for c in docs.columns if c not in ("n_words", "occurrences")]
    same = docs["doc_id"].eqNullSafe(places["_of_id"]) & (F.xxhash64(docs["text"]) == places["_of_hash"])
    # words are cut after the join, so that a shuffle moves the text alone
    joined = docs.select(kept).join(places, same, "left").withColumn("_raw", raw_words(F.col("text")))
    exact = F.when(F.col("_places").isNotNull(), ascii_lower(F.col("_raw")))
    found = F.filter("_places", lambda p: F.slice("_words", p["start"] + 1, F.size(p["words"])) == p["words"])
    occurrences = F.transform(found, lambda p: F.struct(p["start"].alias("start"), F.size(p["words"]).alias("len"), p["items"].alias("items")))
    none = F.array().cast("array<struct<start:int,len:int,items:array<string>>>")
    return (
        joined.withColumn("n_words", F.size("_raw").cast("long"))
        .withColumn("_words", exact)
        .withColumn("occurrences", F.coalesce(occurrences, none))
        .select(*kept, "n_words", "occurrences")
    )


def covered(occurrences: Column) -> Column:
    """Positions inside any of the occurrences."""
    step = F.aggregate(
        F.array_sort(F.transform(occurrences, lambda o: F.struct(o["start"].alias("s"), (o["start"] + o["len"]).alias("e")))),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, o: F.struct(
            F.greatest(acc["end"], o["e"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), o["e"] - F.greatest(acc["end"], o["s"]))).cast("long").alias("n"),
        ),
    )
    return step["n"]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` with n_words, n_hit, n_items, items (array of item ids as strings, sorted) and contaminated.

    Null texts and texts without words have no hits. Items without words have no window; an item with a null id
    counts for n_hit but is not listed. Repeated documents are each judged; repeated items count once.
    """
    added = ("n_hit", "n_items", "items", "contaminated")  # columns of these names are replaced
    matched = phrase_matches(docs.drop(*added), items, window)
    listed = F.array_sort(F.array_distinct(F.flatten(F.transform("occurrences", lambda o: o["items"]))))
    return (
        matched.withColumn("n_hit", covered(F.col("occurrences")))
        .withColumn("items", listed)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("contaminated", F.col("n_hit") > 0)
        .drop("occurrences")
    )


def proximity_matches(docs: DataFrame, queries: DataFrame, slop: int) -> DataFrame:
    """(doc_id, query_id, start, end): for rows (query_id, text) of `queries`, where all words of the query stand in
    order, each within `slop` words after the one before; one row for each place of the query's first word."""
    terms = queries.select("query_id", F.posexplode(raw_words(F.col("text"))).alias("at", "word"))
    terms = terms.select("query_id", "at", fold(F.col("word")).alias("term"))
    index = materialize(postings(docs, materialize(terms.select("term").distinct(), "terms")), "postings")
    # a query's documents are those of its rarest term; only there are the lists of its other terms looked up
    held = index.groupBy("term").agg(F.count("*").alias("n"))
    asked = terms.join(held, "term").groupBy("query_id").agg(F.min_by("term", F.struct("n", "at")).alias("term"), F.count("*").alias("found"))
    whole = terms.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "term"))).alias("wanted"))
    asked = asked.join(whole, "query_id").where(F.col("found") == F.size("wanted")).select("query_id", "term", "wanted")
    seeds = index.withColumn("salt", document_salt()).join(asked.withColumn("salt", each_salt()), ["term", "salt"])
    seeds = seeds.select("query_id", F.size("wanted").alias("n"), F.col("doc_id").alias("_of_id"), F.col("text_hash").alias("_of_hash"), F.explode("wanted").alias("w"))
    same = (index["term"] == F.col("w.term")) & index["doc_id"].eqNullSafe(F.col("_of_id")) & (index["text_hash"] == F.col("_of_hash"))
    lists = (
        seeds.join(index, same)
        .groupBy("query_id", "n", "doc_id", "text_hash")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("w.at").alias("at"), "positions"))).alias("lists"))
        .where(F.size("lists") == F.col("n"))
    )

    def follow(reached: Column, positions: Column) -> Column:
        """Pairs (start, end) carried on to the nearest position after `end`, if it is near enough."""
        moved = F.transform(
            reached,
            lambda r: F.struct(
                r["start"].alias("start"),
                F.array_min(F.filter(positions, lambda p: (p > r["end"]) & (p <= r["end"] + slop + 1))).alias("end"),
            ),
        )
        return F.filter(moved, lambda r: r["end"].isNotNull())

    first = F.transform(F.col("lists")[0]["positions"], lambda p: F.struct(p.alias("start"), p.alias("end")))
    ends = F.aggregate(F.slice("lists", 2, F.greatest(F.size("lists") - 1, F.lit(0))), first, lambda acc, x: follow(acc, x["positions"]))
    return lists.select("query_id", "doc_id", F.explode(ends).alias("m")).select("doc_id", "query_id", "m.start", "m.end")
