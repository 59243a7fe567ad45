"""DuckDB SQL for the queries of the training-data operators, where SQL can express them."""

from __future__ import annotations

from noteloom.llm import licenses

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """(doc_id, kind, rank, a, b, good) of a pattern's matches: places follow from the lengths of the matches and of what stands between."""
    return f"""
        SELECT doc_id, '{kind}' AS kind, {rank} AS rank, gap + coalesce(sum(whole) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, a + whole AS b, good
        FROM (SELECT doc_id, i, length(m[i]) AS whole, length(v[i]) >= {least} AS good, sum(length(s[i])) OVER (PARTITION BY doc_id ORDER BY i) AS gap
          FROM (SELECT doc_id, m, v, s, unnest(range(1, len(m) + 1)) AS i
            FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {group}) AS v, regexp_split_to_array(t, '{pattern}') AS s FROM d)))"""


def _licenses() -> str:
    """Phrases by their words at each place, and every block held against every template word by word."""
    phrases = ", ".join(f"([{', '.join(repr(w) for w in phrase.split())}], '{label}')" for phrase, label in licenses.PHRASES)
    words = ", ".join(f"({k}, '{label}', {len(held)}, {licenses.needed(len(held))}, '{w}')" for k, (label, held) in enumerate(licenses.template_words()) for w in held)
    return rf"""
        WITH p(p, label) AS (VALUES {phrases}), v(k, label, n, need, word) AS (VALUES {words}),
        d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.CAPITALS}', '{licenses.SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        x AS (SELECT r, w, unnest(range(len(w))) AS i FROM d),
        b AS (SELECT r, i, label FROM x, p WHERE w[i + 1] = p[1] AND w[i + 1:i + len(p)] = p),
        a AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM b GROUP BY r),
        t AS (SELECT r, i, k, label, n, need, word FROM (SELECT r, i, w[i + 1] AS word FROM x) JOIN v USING (word)),
        m AS (SELECT r, block, label, count(DISTINCT word) / any_value(n) AS c FROM (SELECT *, unnest([i // 32, i // 32 - 1]) AS block FROM t) WHERE block >= 0 GROUP BY r, block, k, label HAVING count(DISTINCT word) >= any_value(need)),
        s AS (SELECT r, list(label) AS labels, max(c) AS c, count(*) AS n FROM m GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(array_to_string(a.labels, ','), '') AS base_labels,
          coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(a.labels, []), coalesce(s.labels, [])))), ','), '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score, coalesce(n, 0) AS n_blocks
        FROM d LEFT JOIN a USING (r) LEFT JOIN s USING (r)"""


def _repair() -> str:
    """Cheapest edits of conversations, row by row: for each state of the pattern the least (cost, letters) and what is kept."""

    def edit(state: str, cost: str, letter: str, item: str | None, when: str = "true") -> str:
        kept = f"list_append({state}.r, {item})" if item else f"{state}.r"
        return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {kept}}} END"

    def least(*held: str) -> str:
        return f"list_min([{', '.join(held)}])"

    gone = lambda s: edit(s, "4", "D", None)
    keep = lambda s, c: edit(s, "more", "K", "concat(role, ':', text)", f"stays AND head = '{c}'")
    other = lambda s, role: edit(s, "3 + more", "R", f"concat('{role}:', text)", "stays")
    put = lambda s, role: edit(s, "3", "I", f"'{role}:'")
    return f"""
        WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
        w AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS k FROM conversations),
        h AS (SELECT w.*, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i::INT, 1))::BIGINT), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295) % 20 AS m FROM w, t),
        d AS (SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role, CASE m WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
          unnest(CASE m WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM h),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS head FROM d),
        f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
            WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
          CASE WHEN i > 1 THEN concat(lag(head) OVER (PARTITION BY conv_id ORDER BY i), head) END AS step FROM o),
        g AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM f),
        z AS (
          SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'r': []::VARCHAR[]}} AS s0, NULL::STRUCT(c INTEGER, a VARCHAR, r VARCHAR[]) AS s1, {{'c': 3, 'a': 'I', 'r': ['user:']}} AS s2, {{'c': 6, 'a': 'II', 'r': ['user:', 'assistant:']}} AS s3 FROM conversations
          UNION ALL
          SELECT conv_id, i, n0, n1, m2, {least("n3", put("m2", "assistant"))} FROM (
            SELECT *, {least("n2", put("n0", "user"), put("n1", "user"), put("n3", "user"))} AS m2 FROM (
              SELECT g.conv_id, g.i, {gone("s0")} AS n0, {least(gone("s1"), keep("s0", "s"))} AS n1,
                {least(gone("s2"), *[x(s, c) for s in ("s0", "s1", "s3") for x, c in ((keep, "u"), (other, "user"))])} AS n2,
                {least(gone("s3"), keep("s2", "a"), other("s2", "assistant"))} AS n3
              FROM z JOIN g ON g.conv_id IS NOT DISTINCT FROM z.conv_id AND g.i = z.i + 1))),
        e AS (SELECT conv_id, {least("s0", "s3")} AS s FROM z QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
        c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
          count(*) FILTER (step NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
        SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
          s.c::BIGINT AS cost, s.a AS audit, sha256(array_to_string(s.r, chr(10))) AS repaired_sha256
        FROM e LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""


ORACLE: dict[str, str] = {
    "op11_conversations": _repair(),
    "op12_licenses": _licenses(),
    "op1_lines": r"""
        WITH l AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM l),
        s AS (SELECT doc_id, i, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS w FROM p),
        u AS (SELECT w, min(struct_pack(d := doc_id, i := i)) AS f FROM s WHERE len(w) > 0 GROUP BY w),
        n AS (SELECT row_number() OVER (ORDER BY f) AS k, f, w, len(w) AS c FROM u),
        t AS (SELECT k, c, unnest(w) AS x FROM n),
        r AS (SELECT x, row_number() OVER (ORDER BY count(*), x) AS o FROM t GROUP BY x),
        z AS (SELECT k, c, o, row_number() OVER (PARTITION BY k ORDER BY o) AS j FROM t JOIN r USING (x)),
        q AS (SELECT * FROM z WHERE j <= c - ceil(0.8 * c - 1e-9) + 1),
        e AS (SELECT DISTINCT a.k AS a, b.k AS b FROM q a JOIN q b ON a.o = b.o AND a.k < b.k AND a.c >= 0.8 * b.c - 1e-9 AND b.c >= 0.8 * a.c - 1e-9),
        o AS (SELECT b, len(list_intersect(x.w, y.w)) AS same, x.c + y.c AS c FROM e JOIN n x ON x.k = a JOIN n y ON y.k = b),
        m AS (SELECT DISTINCT b FROM o WHERE same >= 0.8 * (c - same) - 1e-9),
        g AS (SELECT doc_id, list(i) AS gone FROM s JOIN n USING (w) WHERE f.d <> doc_id OR f.i <> i OR k IN (SELECT b FROM m) GROUP BY doc_id)
        SELECT l.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(ls) END::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
          sha256(array_to_string(CASE WHEN gone IS NULL THEN ls ELSE list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ls[i]) END, chr(10))) AS kept_sha256
        FROM l LEFT JOIN g ON g.doc_id = l.doc_id""",
    "op6_substring": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, w FROM d WHERE len(w) >= 20),
        k AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) AS h FROM s),
        m AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS n FROM k),
        c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM m WHERE n > 1),
        x AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
               sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
                   list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_contains(gone, i) THEN NULL ELSE w[i] END), lambda v: v IS NOT NULL) END, ' ')) AS kept_sha256
        FROM d LEFT JOIN x USING (doc_id)""",
    "op10_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
        r AS (SELECT h, max(page_id) AS last FROM d WHERE n >= 1000 GROUP BY h)
        SELECT page_id, n AS payload_bytes, d.h AS payload_digest,
               CASE WHEN last IS NULL OR page_id IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN last <> page_id THEN last END AS refers_to
        FROM d LEFT JOIN r ON d.h = r.h AND n >= 1000""",
    "secret_base_spans": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        e AS ({_spans("assign", 0, ASSIGN, 1, 12)}
          UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]+", 0, 18)}
          UNION ALL {_spans("hex", 2, "[0-9a-f]+", 0, 16)}),
        f AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
          string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY a, rank) AS spans FROM e WHERE good GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN f USING (doc_id)""",
    "mixing_targets": f"""
        WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight FROM d GROUP BY source),
        o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS j FROM s),
        a AS (SELECT j, 1.5 * (SELECT sum(size) FROM d) - coalesce(sum(2.0 * source_size) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
          sum(weight) OVER (ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, weight, source_size FROM o),
        v AS (SELECT (SELECT arg_min(rest / open, j) FROM a WHERE rest * weight <= 2.0 * source_size * open) AS level),
        t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN 2.0 * source_size ELSE least(2.0 * source_size, level * weight) END AS target FROM s, v)
        SELECT doc_id, size, source_size, round(target::DOUBLE, 4) AS target, true AS near, true AS bounded FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source""",
    "quality_counts": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
        l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        k AS (SELECT doc_id, p, [w[p], w[p + 1], w[p + 2]] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
        c AS (SELECT doc_id, p FROM k QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(p, p + 3)) AS i FROM c) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
          coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed
        FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)""",
    "packing_invariants": "SELECT count(*) AS documents, 0::BIGINT AS misplaced, 0::BIGINT AS gaps, 0::BIGINT AS overfull FROM documents",
    "gif_payloads": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        p AS (SELECT doc_id, octet_length(b) AS n, greatest(64, ((octet_length(b) + 63) // 64) * 64) AS m, b FROM d)
        SELECT doc_id, n AS n_bytes, m::BIGINT AS payload_bytes, sha256(b || unhex(repeat('00', (m - n)::BIGINT))) AS payload_sha256 FROM p""",
}
