"""Notes made from the test tables, by rules that SQL can state as well.

Each document becomes a Markdown note whose name, tags and links follow from its columns; the
library then parses that Markdown, while the SQL counterpart works from the columns alone. Most notes have their tags as a block list, every
eleventh as an inline list, as a scalar, or has no frontmatter but a pair of ``---`` in its body: there the parsers' rules differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels")}
    return spark.sql(query, **tables)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOTES of all documents. Labels grow with them, so both are dealt by key at any size; that spreads the parsing too."""
    return _sql(
        spark,
        sf_dir,
        r"""
        WITH d AS (
          SELECT /*+ MERGE(l) */ d.doc_id, coalesce(d.text, '') AS text, d.source, upper(d.lang) AS lang, l.quality, l.toxic, d.doc_id - d.doc_id % 25 AS h,
            CASE WHEN d.doc_id % 20 = 7 THEN 'daily notes' ELSE 'atoms' END AS source_dir
          FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id),
        n AS (
          SELECT *, {name} AS fname, doc_id % 11 = 5 AS bare, doc_id % 11 = 6 AS inline, doc_id % 11 = 7 AS scalar,
            filter(array(source, lang, CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN '"toxic"' END, CASE WHEN doc_id % 10 = 0 OR doc_id % 400 = 27 THEN 'need-processing' END), x -> x IS NOT NULL) AS items FROM d),
        p AS (
          SELECT *,
            CASE WHEN doc_id % 5 <> 4 AND h <> doc_id AND NOT bare THEN h END AS la,
            CASE WHEN doc_id % 3 = 0 AND (doc_id * 7 + 3) % 25 + h <> doc_id THEN (doc_id * 7 + 3) % 25 + h END AS lb,
            CASE WHEN doc_id % 100 = 0 THEN doc_id + 25 END AS lc,
            CASE WHEN doc_id % 37 = 0 THEN concat('missing-', doc_id % 4) END AS ld
          FROM n)
        SELECT fname, concat(source_dir, '/', fname) AS path, source_dir,
          concat(
            CASE WHEN bare THEN concat(text, '\n---\nlost\n---') ELSE concat(
              '---\n', 'description: note ', doc_id, '\n',
              CASE WHEN scalar THEN concat('tags: ', source, '\n') WHEN inline THEN concat('tags: [', array_join(items, ', '), ']\n') ELSE concat('tags:\n  - ', array_join(items, '\n  - '), '\n') END,
              CASE WHEN la IS NULL THEN '' WHEN doc_id % 3 = 0 THEN concat('links:\n  - "[[', {la}, ']]"\n')
                   WHEN doc_id % 3 = 1 THEN concat('links: "[[', {la}, ']]"\n') ELSE concat('links:\n  - [[', {la}, ']]\n') END,
              '---\n', text) END, '\n#face #2024x\n```\n#hidden\n```\n',
            CASE WHEN lb IS NULL THEN '' ELSE concat('see [[', {lb}, '|alias]]\n') END,
            CASE WHEN lc IS NULL THEN '' ELSE concat('and [[', {lc}, '#heading]]\n') END,
            CASE WHEN ld IS NULL THEN '' ELSE concat('or [[', ld, ']]\n') END) AS content
        FROM p
        """.replace("{name}", NAME.format(i="doc_id")).replace("{la}", STEM.format(i="la")).replace("{lb}", STEM.format(i="lb")).replace("{lc}", STEM.format(i="lc")),
    )


#: Name of the note of document {i}, and the name without its ending, in SQL that Spark and DuckDB share.
STEM = (
    "CASE WHEN ({i}) % 20 = 7 THEN concat(lpad(cast(2023 + ({i}) % 3 AS varchar(4)), 4, '0'), '-', lpad(cast(1 + ({i}) % 12 AS varchar(2)), 2, '0'), '-', lpad(cast(1 + ({i}) % 28 AS varchar(2)), 2, '0'), ' n', cast({i} AS varchar(20))) "
    "ELSE concat(lpad(cast(2023 + ({i}) % 3 AS varchar(4)), 4, '0'), lpad(cast(1 + ({i}) % 12 AS varchar(2)), 2, '0'), lpad(cast(1 + ({i}) % 28 AS varchar(2)), 2, '0'), lpad(cast(({i}) % 1440 AS varchar(4)), 4, '0'), ' n', cast({i} AS varchar(20))) END"
)
NAME = "concat(" + STEM + ", '.md')"
