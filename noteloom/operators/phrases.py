"""Phrases in notes by a positional term index, and keywords inside short texts by trigram postings.

Neither compares all with all. A phrase meets the notes by its terms: each posting (term, note, place) votes for the place where the
phrase would begin, and a phrase of n terms is held where n terms vote for one place. A keyword meets texts by the rarest of its
trigrams, and what meets is verified by ``contains``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions import text as T
from noteloom.storage import cut

#: A term is a run of letters, digits, ``_`` and ``-``.
TERM = r"[\p{L}\p{N}_-]+"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def title(fname: Column) -> Column:
    """A note's title: its name without the ending and a time stamp of twelve digits."""
    return F.regexp_replace(F.regexp_replace(fname, r"(?i)\.md$", ""), r"^\d{12}\s+", "")


def key_phrases(titles: DataFrame, stop: tuple[str, ...] = T.STOP_WORDS) -> DataFrame:
    """Distinct (fname, phrase): the runs of terms between stop words and single letters in titles(fname), and each term of a run.

    The terms of a phrase are joined by a space.
    """
    marked = F.transform(terms(title(F.col("fname"))), lambda w: F.when((F.length(w) > 1) & ~w.isin(*stop), w).otherwise(F.lit("\n")))
    runs = F.filter(F.transform(F.split(F.array_join(marked, " "), "\n"), T.strip), lambda p: p != "")
    return titles.select("fname", F.explode(F.array_union(runs, F.flatten(F.transform(runs, lambda p: F.split(p, " "))))).alias("phrase")).distinct()


#: Terms up to which the places of others are left out inside a note's row, before rows are made of them.
FEW_TERMS = 1000


def postings(notes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, path, fname, place): where the terms of wanted(term) stand in title and body of notes(fname, path, content).

    Every text is read once, however many terms are wanted; an empty term keeps phrases from running from a title into the body.
    """
    text = F.concat(terms(title(F.col("fname"))), F.array(F.lit("")), terms(T.body(F.col("content"))))
    few = [r[0] for r in wanted.limit(FEW_TERMS + 1).collect()]
    if len(few) <= FEW_TERMS:
        places = F.transform(text, lambda w, k: F.when(w.isin(*few), F.struct(k.alias("place"), w.alias("term"))))
        found = notes.select("path", "fname", F.explode(F.filter(places, lambda p: p.isNotNull())).alias("p"))
        return found.select(F.col("p.term").alias("term"), "path", "fname", F.col("p.place").alias("place"))
    return notes.select("path", "fname", F.posexplode(text).alias("place", "term")).join(wanted, "term", "left_semi")


def holders(notes: DataFrame, phrases: DataFrame) -> DataFrame:
    """Distinct (phrase, fname) of the notes whose title or body holds a phrase of phrases(phrase), term by term."""
    split = F.split("phrase", " ")
    steps = cut(phrases.select("phrase").distinct().select("phrase", F.size(split).alias("n"), F.posexplode(split).alias("step", "term")), "phrase-terms")
    votes = postings(notes, steps.select("term").distinct()).join(steps, "term").select("phrase", "n", "path", "fname", (F.col("place") - F.col("step")).alias("begin"))
    found = votes.groupBy("phrase", "n", "path", "fname", "begin").agg(F.count(F.lit(1)).alias("k")).filter("k = n")
    return found.select("phrase", "fname").distinct()


def _grams(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.expr("cast(array() as array<string>)"))


def containing(keywords: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct (keyword, key) of the texts(key, text) that contain a keyword of keywords(keyword); case does not count.

    Keywords of one or two characters meet by these; longer ones by the trigram of theirs that fewest texts have.
    """
    every = F.flatten(F.array(*[_grams(F.col("text"), n) for n in (1, 2, 3)]))
    held = cut(texts.select("key", F.lower("text").alias("text")).select("key", "text", F.explode(every).alias("gram")), "grams")
    words = keywords.select(F.lower("keyword").alias("keyword")).filter("keyword <> ''").distinct()
    own = F.when(F.length("keyword") < 3, F.array("keyword")).otherwise(_grams(F.col("keyword"), 3))
    counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    parts = words.select("keyword", F.explode(own).alias("gram")).join(counts, "gram", "left")
    rarest = parts.groupBy("keyword").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return rarest.join(held, "gram").filter(F.contains(F.col("text"), F.col("keyword"))).select("keyword", "key").distinct()


def best(scored: DataFrame, by: str, n: int, name: str) -> DataFrame:
    """(by, rank, name, score): for each ``by`` the n of highest score, ties by name."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), name)
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= n).select(by, "rank", name, F.col("score").cast("long").alias("score"))
