"""DuckDB SQL for the registered queries, from the columns of documents and labels alone; no Markdown is parsed here."""

from __future__ import annotations

from noteloom.sources.overlay import NAME


def _name(i: str) -> str:
    return NAME.format(i=i)


BASE = f"""
WITH RECURSIVE d AS (
  SELECT d.doc_id, coalesce(d.text, '') AS text, d.source, upper(d.lang) AS lang, l.quality, l.toxic, d.doc_id - d.doc_id % 25 AS h,
    CASE WHEN d.doc_id % 20 = 7 THEN 'daily notes' ELSE 'atoms' END AS source_dir, {_name("d.doc_id")} AS fname
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
p AS (
  SELECT *,
    CASE WHEN doc_id % 5 <> 4 AND h <> doc_id AND doc_id % 11 <> 5 THEN {_name("h")} END AS la,
    CASE WHEN doc_id % 3 = 0 AND (doc_id * 7 + 3) % 25 + h <> doc_id THEN {_name("(doc_id * 7 + 3) % 25 + h")} END AS lb,
    CASE WHEN doc_id % 100 = 0 THEN {_name("doc_id + 25")} END AS lc,
    CASE WHEN doc_id % 37 = 0 THEN concat('missing-', doc_id % 4, '.md') END AS ld,
    list_filter([source, lang, CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN doc_id % 10 = 0 OR doc_id % 400 = 27 THEN 'need-processing' END], lambda x: x IS NOT NULL) AS items,
    CASE doc_id % 11 WHEN 5 THEN [] WHEN 7 THEN [source] ELSE items END AS itags,
    CASE WHEN doc_id % 11 = 6 THEN [concat('[', array_to_string(list_transform(items, lambda x: CASE WHEN x = 'toxic' THEN '"toxic"' ELSE x END), ', '), ']')] ELSE itags END AS tags
  FROM d),
t AS (SELECT * FROM (SELECT DISTINCT lower(unnest(itags)) AS tag, fname FROM p) WHERE tag <> 'need-processing'),
i AS (SELECT tag, count(*) AS n_files FROM t GROUP BY tag),
e AS (SELECT * FROM (SELECT DISTINCT fname AS src, unnest([la, lb, lc, ld]) AS dst FROM p) WHERE dst IS NOT NULL),
k AS (SELECT src, dst FROM e WHERE dst IN (SELECT fname FROM p)),
nd AS (
  SELECT p.fname, p.source_dir, p.doc_id, p.tags, coalesce(o.links_out, []) AS links_out, coalesce(n.links_in, []) AS links_in,
    len(coalesce(o.links_out, []))::BIGINT AS degree_out, len(coalesce(n.links_in, []))::BIGINT AS degree_in
  FROM p LEFT JOIN (SELECT src, list(dst ORDER BY dst) AS links_out FROM e GROUP BY src) o ON o.src = p.fname
  LEFT JOIN (SELECT dst, list(src ORDER BY src) AS links_in FROM k GROUP BY dst) n ON n.dst = p.fname)"""

COMPONENTS = """,
u AS (SELECT src AS a, dst AS b FROM k UNION SELECT dst, src FROM k),
r AS (SELECT fname AS a, fname AS b FROM p UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
c AS (SELECT a AS fname, min(b) AS component FROM r GROUP BY a)"""

LINKS = """,
x AS (SELECT fname, tags, degree_out, unnest(links_out) AS dst FROM nd WHERE source_dir <> 'daily notes' AND (len(tags) = 0 OR len(list_filter(tags, lambda v: v <> 'need-processing' AND v <> 'daily-note')) > 0)),
lp AS (
  SELECT a.fname AS a, b.fname AS b, count(*) AS common, any_value(a.degree_out) AS na, any_value(b.degree_out) AS nb, list(a.dst ORDER BY a.dst)[1:5] AS shared,
    any_value(a.tags) AS ta, any_value(b.tags) AS tb
  FROM x a JOIN x b ON a.dst = b.dst AND a.fname < b.fname GROUP BY a.fname, b.fname),
lj AS (SELECT *, round(common / (na + nb - common), 4) AS jaccard, list_sort(list_intersect(ta, tb)) AS in_both FROM lp WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = lp.a AND e.dst = lp.b)),
ls AS (SELECT row_number() OVER (ORDER BY common DESC, jaccard DESC, a, b) AS rank, * FROM lj QUALIFY rank <= 50)"""

#: All notes, and those that the report of suggestions takes: the first 1,500 names.
WEIGHTS = """,
f AS (SELECT * FROM p),
g AS (
  SELECT fname, regexp_extract_all(lower(concat(CASE WHEN doc_id % 11 = 5 THEN '' ELSE text END, ' #face #2024x ', CASE WHEN lb IS NULL THEN '' ELSE ' see ' END, CASE WHEN lc IS NULL THEN '' ELSE ' and ' END, CASE WHEN ld IS NULL THEN '' ELSE ' or ' END)), '[а-яёa-z0-9]{2,}') AS w
  FROM f WHERE source_dir <> 'daily notes' AND (len(tags) = 0 OR len(list_filter(tags, lambda v: v <> 'need-processing' AND v <> 'daily-note')) > 0)),
q AS (SELECT fname, unnest(w) AS term FROM g WHERE len(w) >= 50),
tf AS (SELECT fname, term, count(*) AS n FROM q GROUP BY fname, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
rw AS (
  SELECT tf.fname, tf.term, df.df, n / sum(n) OVER (PARTITION BY tf.fname) * ln((SELECT count(DISTINCT fname) FROM tf)::DOUBLE / (df.df + 1)) AS w
  FROM tf JOIN df ON tf.term = df.term),
wt AS (SELECT fname, term, df, CASE WHEN norm > 0 THEN w / norm ELSE w END AS w FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY fname)) AS norm FROM rw))"""

SEMANTIC = (
    WEIGHTS
    + """,
sp AS (SELECT a.fname AS a, b.fname AS b, sum(a.w * b.w) AS s FROM wt a JOIN wt b ON a.term = b.term AND a.fname < b.fname WHERE a.df > 1 GROUP BY a.fname, b.fname HAVING sum(a.w * b.w) >= 0.2),
sj AS (SELECT a, b, round(s, 4) AS similarity FROM sp WHERE NOT EXISTS (SELECT 1 FROM e WHERE (e.src = sp.a AND e.dst = sp.b) OR (e.src = sp.b AND e.dst = sp.a))),
ss AS (SELECT row_number() OVER (ORDER BY similarity DESC, a, b) AS rank, sj.*, na.tags AS ta, nb.tags AS tb FROM sj JOIN nd na ON na.fname = a JOIN nd nb ON nb.fname = b QUALIFY rank <= 50)"""
)

FIRST = ("f AS (SELECT * FROM p)", "f AS (SELECT * FROM p ORDER BY fname LIMIT 1500)")

QUEUE = """,
zq AS (SELECT row_number() OVER (ORDER BY source_dir = 'atoms', fname) AS rank, fname, doc_id, concat(source_dir, '/', fname) AS path, source_dir FROM p WHERE list_contains(itags, 'need-processing')),
z AS (SELECT * FROM zq WHERE rank <= 10),
zp AS (SELECT *, unnest(CASE WHEN source_dir = 'atoms' THEN [concat('n', doc_id)] ELSE [fname[1:10], concat('n', doc_id), concat(fname[1:10], ' n', doc_id)] END) AS phrase FROM zq)"""

#: Suggested tags: those whose name or description contains the keyword of a title, at most five.
SUGGESTED = """,
sx AS (SELECT z.fname, i.tag, 1 AS score FROM z JOIN i ON contains(concat(tag, ' as n', n_files * 10, ' and n0 n60 n420 n840'), concat('n', z.doc_id)) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.fname = z.fname AND t.tag = i.tag)),
st AS (SELECT fname, row_number() OVER (PARTITION BY fname ORDER BY score DESC, tag) AS rank, tag, score::BIGINT AS score FROM sx QUALIFY rank <= 5)"""

#: Title and body of each note as terms with spaces around them.
HAY = r""",
h AS (SELECT fname, concat(' ', array_to_string(regexp_extract_all(lower(regexp_replace(regexp_replace(fname, '\.md$', ''), '^\d{12}\s+', '')), '[\p{L}\p{N}_-]+'), ' '), ' | ',
  array_to_string(regexp_extract_all(lower(concat_ws(chr(10), text, CASE WHEN doc_id % 11 = 5 THEN 'x --- lost --- x' END, '#face #2024x #hidden', regexp_replace(lb, '\.md$', ' alias'), regexp_replace(lc, '\.md$', ' heading'), regexp_replace(ld, '\.md$', ''))), '[\p{L}\p{N}_-]+'), ' '), ' ') AS hay FROM p)"""

MOC = """,
m AS (SELECT row_number() OVER (ORDER BY degree_out + degree_in DESC, fname) AS rank, * FROM nd WHERE degree_out + degree_in >= 5 QUALIFY rank <= 50)"""

NL = "chr(10)"
#: A note's body as the rewritten note keeps it.
BODY = f"""ltrim(concat(text, CASE WHEN doc_id % 11 = 5 THEN concat({NL}, '---', {NL}, 'lost', {NL}, '---') ELSE '' END, {NL}, '#face #2024x', {NL}, '```', {NL}, '#hidden', {NL}, '```', {NL},
  CASE WHEN lb IS NULL THEN '' ELSE concat('see [[', regexp_replace(lb, '\\.md$', ''), '|alias]]', {NL}) END,
  CASE WHEN lc IS NULL THEN '' ELSE concat('and [[', regexp_replace(lc, '\\.md$', ''), '#heading]]', {NL}) END,
  CASE WHEN ld IS NULL THEN '' ELSE concat('or [[', regexp_replace(ld, '\\.md$', ''), ']]', {NL}) END), {NL})"""
LINK = f"""concat('  - "[[', regexp_replace(la, '\\.md$', ''), ']]"', {NL})"""


def _content(tags: str, links: str, more: str = "''") -> str:
    listed = f"array_to_string(list_transform({tags}, lambda v: concat('  - ', v, {NL})), '')"
    told = f"CASE WHEN doc_id % 11 = 5 THEN '' ELSE concat('description: note ', doc_id, {NL}) END"
    return f"md5(concat('---', {NL}, {told}, CASE WHEN len({tags}) = 0 THEN '' ELSE concat('tags:', {NL}, {listed}) END, {links}, {more}, '---', {NL}, {NL}, {BODY}))"


OWN_LINKS = f"CASE WHEN la IS NULL THEN '' ELSE concat('links:', {NL}, {LINK}) END"
NEW_LINKS = f"""concat('links:', {NL}, CASE WHEN la IS NULL THEN '' ELSE {LINK} END, '  - "[[target.md]]"', {NL})"""

ORACLE: dict[str, str] = {
    "tag_index_counts": BASE + " SELECT tag, n_files FROM i",
    "tag_index_files": BASE + " SELECT tag, string_agg(fname, ',' ORDER BY fname) AS files FROM t GROUP BY tag",
    "tag_index_chunks": BASE + """,
        r AS (SELECT tag, fname, (row_number() OVER (PARTITION BY tag ORDER BY fname) - 1) // 100 AS chunk FROM t)
        SELECT tag, chunk::BIGINT AS chunk, count(*) AS n_files, min(fname) AS first, max(fname) AS last, string_agg(fname, ',' ORDER BY fname) AS files FROM r GROUP BY tag, chunk""",
    "month_chunks": BASE + """,
        s AS (SELECT fname, concat(lpad(cast(2023 + doc_id % 3 AS varchar), 4, '0'), '-', lpad(cast(1 + doc_id % 12 AS varchar), 2, '0')) AS month FROM p)
,
        r AS (SELECT month, fname, (row_number() OVER (PARTITION BY month ORDER BY fname) - 1) // 100 AS chunk, count(*) OVER (PARTITION BY month) AS n_month FROM s)
        SELECT month, chunk::BIGINT AS chunk, ((any_value(n_month) + 99) // 100)::BIGINT AS chunks, count(*) AS n, any_value(n_month) AS n_month, min(fname) AS first, max(fname) AS last FROM r GROUP BY month, chunk""",
    "tag_search": BASE + " SELECT fname FROM t WHERE tag = 'en'",
    "tags_consolidated": BASE + " SELECT tag, concat('about ', tag) AS description FROM i WHERE regexp_matches(tag, '[13579]$')",
    "stale_tags": BASE + " SELECT DISTINCT lower(unnest(itags)) AS tag FROM p EXCEPT SELECT tag FROM i",
    "graph_edges": BASE + " SELECT src, dst FROM e",
    "graph_nodes_degrees": BASE + " SELECT fname, source_dir, array_to_string(tags, ',') AS tags, degree_out, degree_in, array_to_string(links_in, ',') AS links_in FROM nd",
    "graph_stats": BASE + """
        SELECT (SELECT count(*) FROM p) AS total_nodes, (SELECT count(*) FROM e) AS total_edges, (SELECT count(*) FROM nd WHERE degree_in = 0 AND degree_out = 0) AS orphan_nodes,
          (SELECT count(DISTINCT v) FROM (SELECT unnest(tags) AS v FROM p)) AS tags_indexed, round((SELECT count(*) FROM e) / (SELECT count(*) FROM p), 1) AS avg_degree""",
    "orphans": BASE + " SELECT fname FROM nd WHERE degree_in = 0 AND degree_out = 0",
    "hubs_top20": BASE + " SELECT fname, degree_in + degree_out AS degree, degree_out, degree_in, array_to_string(tags, ',') AS tags FROM nd ORDER BY degree DESC, fname LIMIT 20",
    "components": BASE + COMPONENTS + " SELECT component, fname FROM c",
    "component_size_classes": BASE + COMPONENTS + """,
        y AS (SELECT component, count(*) AS n FROM c GROUP BY component)
        SELECT count(*) AS components, coalesce(max(CASE WHEN n > 1 THEN n END), 0)::BIGINT AS giant, count(CASE WHEN n BETWEEN 2 AND 5 THEN 1 END) AS small, count(CASE WHEN n = 1 THEN 1 END) AS isolated FROM y""",
    "cluster_tag_report": BASE + COMPONENTS + """,
        s AS (SELECT component, count(*) AS size, array_to_string(list(fname ORDER BY fname)[1:10], ',') AS members FROM c GROUP BY component HAVING count(*) >= 3),
        v AS (SELECT component, tag, count(*) AS n FROM c JOIN (SELECT fname, unnest(tags) AS tag FROM p) USING (fname) GROUP BY component, tag),
        w AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY n DESC, tag) AS j FROM v),
        o AS (SELECT component, string_agg(concat(tag, ':', n), ',' ORDER BY j) AS top_tags FROM w WHERE j <= 5 GROUP BY component)
        SELECT component AS cluster, size, coalesce(top_tags, '') AS top_tags, members FROM s LEFT JOIN o USING (component)""",
    "bridges": BASE + """,
        b AS (SELECT fname, degree_in + degree_out AS degree, tags, unnest(list_distinct(list_concat(links_out, links_in))) AS near FROM nd WHERE degree_in > 0 AND degree_out > 0 AND len(list_distinct(list_concat(links_out, links_in))) >= 3),
        s AS (SELECT b.fname, any_value(b.degree) AS degree, any_value(b.tags) AS tags, coalesce(list_sort(list_distinct(flatten(list(n.tags) FILTER (n.tags IS NOT NULL)))), []) AS seen FROM b LEFT JOIN nd n ON n.fname = b.near GROUP BY b.fname),
        o AS (SELECT *, list_sort(list_intersect(tags, seen)) AS overlap FROM s)
        SELECT fname AS name, degree, array_to_string(tags, ',') AS tags, array_to_string(seen, ',') AS neighbor_tags, array_to_string(overlap, ',') AS overlap FROM o
        WHERE len(overlap) < 0.3 * len(tags) ORDER BY degree DESC, fname LIMIT 20""",
    "link_suggestions": BASE + LINKS + """
        SELECT rank, a, b, common, jaccard, array_to_string(shared, ',') AS shared_neighbors, array_to_string(in_both, ',') AS shared_tags, array_to_string(ta, ',') AS tags_a, array_to_string(tb, ',') AS tags_b FROM ls""",
    "link_pairs_all": BASE + LINKS + " SELECT a, b, common, jaccard FROM lj",
    "semantic_suggestions": BASE + SEMANTIC.replace(*FIRST) + " SELECT rank, a, b, similarity, array_to_string(ta, ',') AS tags_a, array_to_string(tb, ',') AS tags_b FROM ss",
    "semantic_pairs_all": BASE + SEMANTIC + " SELECT a, b, similarity FROM sj",
    "tfidf_weights": BASE + WEIGHTS + " SELECT fname, term, df, round(w, 4) + 0.0 AS w FROM wt",
    "moc_index": BASE + COMPONENTS + MOC + """,
        y AS (SELECT component, count(*) AS n FROM c GROUP BY component)
        SELECT rank, fname, degree_out + degree_in AS degree, degree_out, degree_in, array_to_string(tags[1:3], ',') AS tags, component AS cluster, n AS cluster_size,
          array_to_string(links_out[1:5], ',') AS linked, greatest(len(links_out) - 5, 0)::BIGINT AS more FROM m JOIN c USING (fname) JOIN y USING (component)""",
    "dates_index": BASE + """,
        s AS (SELECT fname, lpad(cast(2023 + doc_id % 3 AS varchar), 4, '0') AS year, lpad(cast(1 + doc_id % 12 AS varchar), 2, '0') AS month FROM p)
        SELECT year, month, count(*) AS n_files, string_agg(fname, ',' ORDER BY fname) AS files FROM s GROUP BY year, month""",
    "needs_processing": BASE + QUEUE + " SELECT rank, fname, path FROM z",
    "analyze_plan": BASE + LINKS + SEMANTIC.replace(*FIRST) + """,
        v AS (SELECT 0 AS kind, 'graph' AS type, rank AS own, a, b, ta, tb, jaccard AS score FROM ls WHERE jaccard > 0 OR len(in_both) > 0
          UNION ALL SELECT 1, 'semantic', rank, a, b, ta, tb, similarity FROM ss),
        w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY kind, own) = 1),
        s AS (SELECT row_number() OVER (ORDER BY kind, own) AS rank, * FROM w)
        SELECT rank, type, a, b, score FROM s WHERE rank <= 20""",
    "ingest_tags": BASE + QUEUE + SUGGESTED + " SELECT * FROM st",
    "ingest_links": BASE + QUEUE + SUGGESTED + HAY + """,
        g AS (SELECT fname, tag FROM z JOIN t USING (fname) UNION SELECT fname, tag FROM st),
        v AS (SELECT g.fname, b.fname AS candidate, count(*) AS n FROM g JOIN t b ON b.tag = g.tag GROUP BY g.fname, b.fname
          UNION ALL SELECT zp.fname, h.fname, 1 FROM zp JOIN h ON contains(h.hay, concat(' ', zp.phrase, ' ')) WHERE zp.rank <= 10),
        s AS (SELECT fname, candidate, sum(n)::BIGINT AS score FROM v WHERE candidate <> fname AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = v.fname AND e.dst = v.candidate) GROUP BY fname, candidate),
        r AS (SELECT fname, row_number() OVER (PARTITION BY fname ORDER BY score DESC, candidate) AS rank, candidate, score FROM s)
        SELECT * FROM r WHERE rank <= 5""",
    "ingest_phrase_links": BASE + QUEUE + HAY + """
,
        zg AS (SELECT phrase, count(*) AS n_notes FROM zp GROUP BY phrase)
        SELECT zg.phrase, n_notes, h.fname AS candidate FROM zg JOIN h ON contains(h.hay, concat(' ', zg.phrase, ' '))""",
    "ingest_project": BASE + QUEUE + """
        SELECT z.fname, 1::BIGINT AS rank, concat('plan n', o.doc_id, '0.md') AS project, 1::BIGINT AS score FROM z JOIN p o ON o.doc_id * 10 = z.doc_id WHERE list_contains(o.itags, 'quality') AND o.doc_id > 0""",
    "research_topics": BASE + """,
        w AS (SELECT DISTINCT concat_ws(' ', upper(lang), source, 'quality and rc1') AS topic FROM documents),
        s AS (SELECT topic, tag, len(list_filter(list_distinct(string_split(lower(topic), ' ')), lambda k: contains(lower(concat(tag, ' about ', tag, ' notes')), k)))::BIGINT AS score FROM w, i),
        r AS (SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY score DESC, tag) AS rank, tag, score FROM s WHERE score > 0)
        SELECT * FROM r WHERE rank <= 10""",
    "research_tags": BASE + " SELECT tag, len(list_filter(['en', 'quality', 'src3', 'notes'], lambda v: contains(tag, v)))::BIGINT AS score FROM i WHERE score > 0 ORDER BY score DESC, tag LIMIT 10",
    "research_notes": BASE + """,
        g AS (SELECT tag FROM i WHERE contains(tag, 'en') OR contains(tag, 'quality') OR contains(tag, 'src3') OR contains(tag, 'notes')
          ORDER BY len(list_filter(['en', 'quality', 'src3', 'notes'], lambda v: contains(tag, v))) DESC, tag LIMIT 10),
        s AS (SELECT fname, count(*) AS score FROM t WHERE tag IN (SELECT tag FROM g) GROUP BY fname),
        r AS (SELECT row_number() OVER (ORDER BY score DESC, fname) AS rank, fname, score FROM s)
        SELECT * FROM r WHERE rank <= 50""",
    "lint_broken_links": BASE + " SELECT src, dst FROM e WHERE dst NOT IN (SELECT fname FROM p)",
    "lint_missing_desc": BASE + " SELECT count(*) AS tags, count(CASE WHEN NOT regexp_matches(tag, '[13579]$') THEN 1 END) AS missing FROM i",
    "lint_index_drift": BASE + " SELECT count(*) AS files, count(CASE WHEN regexp_matches(tag, '[13579]$') THEN 1 END) AS entries, entries <= files AS consistent FROM i",
    "lint_orphans": BASE + " SELECT count(*) AS orphans FROM nd WHERE degree_in = 0 AND degree_out = 0 AND source_dir <> 'daily notes'",
    "lint_moc": BASE + MOC + ", s AS (SELECT fname, unnest(links_out[1:5]) AS linked FROM m) SELECT fname, linked FROM s WHERE linked NOT IN (SELECT fname FROM p)",
    "lint_malformed": BASE + " SELECT fname, concat('[[', regexp_replace(la, '\\.md$', ''), ']]') AS item FROM p WHERE la IS NOT NULL AND doc_id % 3 = 2",
    "edit_add_link": BASE + f" SELECT fname, {_content('tags', NEW_LINKS)} AS digest FROM p",
    "edit_merge_tags": BASE + f" SELECT fname, {_content("list_concat(tags, CASE WHEN list_contains(tags, 'quality') THEN ['new'] ELSE ['new', 'quality'] END)", OWN_LINKS)} AS digest FROM p",
    "edit_project": BASE + f" SELECT fname, {_content('tags', OWN_LINKS, f"concat('project: \"[[P ', source_dir, ']]\"', {NL})")} AS digest FROM p",
}
