"""Research of a topic (D4): its tags by keywords, their notes by how many of the tags they have."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions import text as T
from noteloom.operators import phrases


def matching_tags(index: DataFrame, topic: str, n: int = 10) -> DataFrame:
    """(tag, score): tags by how many of the topic's keywords their name or description holds, ties by name.

    index(tag, description). The keywords are those of one topic, so each tag is held against a short list.
    """
    held = T.title_keywords(F.lit(topic))
    text = F.lower(F.concat_ws(" ", "tag", "description"))
    score = F.size(F.filter(held, lambda k: F.contains(text, k)))
    return index.select("tag", score.cast("long").alias("score")).filter("score > 0").orderBy(F.desc("score"), "tag").limit(n)


def matching_tags_of(index: DataFrame, topics: DataFrame, n: int = 10) -> DataFrame:
    """(topic, rank, tag, score) for each of topics(topic): ``matching_tags`` of many topics at once, keywords and tags meeting by trigrams."""
    words = topics.select("topic", F.explode(T.title_keywords(F.col("topic"))).alias("keyword")).distinct()
    found = phrases.containing(words, index.select(F.col("tag").alias("key"), F.concat_ws(" ", "tag", "description").alias("text")))
    scored = words.join(found, "keyword").groupBy("topic", F.col("key").alias("tag")).agg(F.count(F.lit(1)).alias("score"))
    return phrases.best(scored, "topic", n, "tag")


def notes_for(topic_tags: DataFrame, tags: DataFrame, n: int = 50) -> DataFrame:
    """(rank, fname, score): notes of the tags, by their number, ties by name."""
    scored = tags.join(topic_tags.select("tag"), "tag").groupBy("fname").agg(F.count(F.lit(1)).alias("score"))
    order = [F.desc("score"), F.col("fname")]
    return scored.orderBy(*order).limit(n).select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"), "fname", "score")
