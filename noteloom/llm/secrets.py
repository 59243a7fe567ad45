"""Secret scans by corpus-wide ownership frequency, in DataFrame expressions only.

Candidates are found in every text by pattern, hashed, and counted over the corpus by distinct
repositories (doc_ids) and distinct owners (sources). A value that several owners or very many repositories hold
is a widely copied example; a value of one owner and few repositories looks live. Base spans always
stay, with their verdict; of the further candidates (MORE: shapes that are secrets only if nobody else has
them) those that look live are added as spans of kind ``owned`` where no base span lies.

Positions are code points. Spark has no expression for the places of all matches, so each match is
marked by private-use characters (any that the text holds are replaced first, one for one) and the
places follow from the lengths of what stands between the marks.

Defined results: a null or empty text has no spans; rows that repeat a doc_id are one repository, and null
doc_ids together are one; a null source is an owner of its own; matches are leftmost, longest as the
pattern is greedy, and do not overlap within a kind; kinds may overlap each other; very long texts are scanned whole,
their matches in blocks so that work grows with their number; other columns, whatever their names, are not looked at; an empty
table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import cut

#: Fixed patterns of the base kinds, in their order, with the group that holds the value and its least length.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),  # runs below 16 are dropped anyway, and runs do not touch
}
#: What a text has to hold, in lower case, for a pattern of these kinds to match, or else a run (RUN): looked for first, as that is much cheaper than the patterns.
WORDS = {"assign": ("assw", "secret", "token", "api"), "access": ("akia",), "hex": ()}
#: The beginning of a run that may hold a match of the kinds without words.
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16}"
#: Further candidates: pattern, group that holds the value, its least length, and patterns that the value has to hold.
MORE = (
    (r"[A-Za-z0-9+/_-]{20,}", 0, 20, ("[a-z]", "[A-Z]", "[0-9]")),
    (r"[0-9A-F]{16,}", 0, 16, ("[0-9]", "[A-F]")),
    (r"""(?i)\b(pwd|pass|auth|bearer|credentials?|passphrase|private_?key|access_?key)["']?\x20*[:=\x20]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, ("[0-9]", "[A-Za-z]")),
    (r"[a-z][a-z0-9+.-]*://[^\s/:@]+:([^\s/:@]+)@", 1, 6, ()),
)
#: The same for these.
MORE_WORDS = ((), (), ("pwd", "pass", "auth", "bearer", "credential", "key"), ("://",))
#: From so many owners, or repositories, on a value counts as a widely copied example.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 25
#: Matches of a text that are folded at once.
FOLDED = 64
OPEN, MIDDLE, CLOSE = "\ue000", "\ue001", "\ue002"
SPAN = "array<struct<start:int,rank:int,end:int,value:bigint>>"


def _marked_spans(text: Column, ready: Column, pattern: str, group: int, least: int, rank: int, held_by: tuple[str, ...] = ()) -> Column:
    """The pattern's matches whose value has ``least`` characters or more and holds each pattern of ``held_by``, as SPAN.

    A text has a match only if it is ``ready``; those that have one are marked and split once, however many matches they have.
    """
    none = F.expr(f"cast(array() as {SPAN})")

    def step(held: Column, part: Column) -> Column:
        whole, value = F.substring_index(part, MIDDLE, 1), F.substring_index(F.substring_index(part, CLOSE, 1), MIDDLE, -1)
        end = held["at"] + F.length(whole)
        span = F.struct(held["at"].alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.xxhash64(value).alias("value"))
        good = F.length(value) >= least
        for x in held_by:
            good = good & value.rlike(x)
        return F.struct((end + F.length(F.substring_index(part, CLOSE, -1))).alias("at"), F.when(good, F.concat(held["out"], F.array(span))).otherwise(held["out"]).alias("out"))

    def place(held: Column, part: Column) -> Column:
        moved = F.transform(part["out"], lambda s: F.struct((held["at"] + s["start"]).alias("start"), s["rank"], (held["at"] + s["end"]).alias("end"), s["value"]))
        return F.struct((held["at"] + part["at"]).alias("at"), F.concat(held["out"], F.array(moved)).alias("out"))

    def spans(marked: Column) -> Column:
        """``marked`` is a variable here: what it stands for is not made again for each block."""

        def block(k: Column) -> Column:
            """Length and spans of a block of matches, as from its own start."""
            return F.aggregate(F.slice(marked, 2 + k * FOLDED, F.lit(FOLDED)), F.struct(F.lit(0).alias("at"), none.alias("out")), step)

        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(marked) - 2) / FOLDED).cast("int")), block)
        start = F.struct(F.length(marked[0]).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("out"))
        return F.flatten(F.aggregate(blocks, start, place)["out"])

    marked = F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{MIDDLE}${group}{CLOSE}"), OPEN)
    return F.when(ready & text.rlike(pattern), F.get(F.transform(F.array(marked), spans), F.lit(0))).otherwise(none)


def candidates(docs: DataFrame, source: str = "source") -> DataFrame:
    """(row, doc_id, owner, spans): every candidate of every text, base kinds and further ones, those with one rank."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = docs.select("doc_id", F.col(source).cast("string").alias("owner"), text.alias("text"))
    held = held.withColumn("text", F.when(F.col("text").rlike(f"[{OPEN}{MIDDLE}{CLOSE}]"), F.translate("text", OPEN + MIDDLE + CLOSE, "\ufffd" * 3)).otherwise(F.col("text")))
    held = held.withColumns({"low": F.lower("text"), "run": F.col("text").rlike(RUN)})
    ready = lambda words: reduce(or_, [F.contains("low", F.lit(w)) for w in words]) if words else F.col("run")
    found = [_marked_spans(F.col("text"), ready(WORDS[kind]), *rule, rank) for rank, (kind, rule) in enumerate(BASE.items())]
    found += [_marked_spans(F.col("text"), ready(words), *rule, len(BASE), held_by) for (*rule, held_by), words in zip(MORE, MORE_WORDS)]
    return held.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", F.array_distinct(F.concat(*found)).alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """(value, repositories, owners) of each candidate hash, both distinct; a hot value is counted by repository, then summed."""
    values = found.select("owner", "doc_id", F.explode(F.array_distinct(F.col("spans.value"))).alias("value"))
    per_owner = values.groupBy("value", "owner", "doc_id").agg(F.lit(1).alias("one")).groupBy("value", "owner").agg(F.sum("one").alias("repositories"))
    return per_owner.groupBy("value").agg(F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def scan(docs: DataFrame, source: str = "source", copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """One row per document: doc_id, spans and counts.

    spans holds (start, rank, end, value, owners, repositories, verdict) by start, then kind: base spans, and further
    candidates that look live and that no base span touches. The verdict is ``copied`` where ``copied_owners`` owners or
    ``copied_repositories`` repositories hold the value, else ``live`` where one owner does, else ``shared``.
    """
    found = cut(candidates(docs, source), "candidates")
    counts = cut(ownership(found), "ownership")
    each = found.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    known = each.join(counts, "value")
    copied = (F.col("owners") >= copied_owners) | (F.col("repositories") >= copied_repositories)
    known = known.withColumn("verdict", F.when(copied, "copied").when(F.col("owners") == 1, "live").otherwise("shared"))
    known = known.filter((F.col("rank") < len(BASE)) | (F.col("verdict") == "live"))
    spans = known.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "value", "owners", "repositories", "verdict"))).alias("all"))
    base = F.filter("all", lambda s: s["rank"] < len(BASE))
    kept = F.filter("all", lambda s: (s["rank"] < len(BASE)) | ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    empty = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,value:bigint,owners:bigint,repositories:bigint,verdict:string>>)")
    rows = found.select("row", "doc_id").join(spans.select("row", kept.alias("spans")), "row", "left").withColumn("spans", F.coalesce("spans", empty))

    def count(test: str) -> Column:
        return F.expr(f"cast(size(filter(spans, s -> {test})) as long)")

    return rows.select(
        "doc_id",
        "spans",
        *[count(f"s.rank = {k}").alias(f"n_{kind}") for k, kind in enumerate([*BASE, "owned"])],
        count("s.verdict = 'live'").alias("n_live"),
        count("s.verdict = 'copied'").alias("n_copied"),
    )


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in [*BASE, "owned"]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
