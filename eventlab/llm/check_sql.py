"""Check SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

from . import lexical, prefixtrie, quality, revisits, suffixes, vectors

WORD = r"[^\x20\x09-\x0D]+"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

HOST_RULES = f"""
WITH words AS (
    SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), windows AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS times
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), repeated AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, range({quality.WINDOW}) t(k) WHERE times > 1 GROUP BY doc_id
), lines AS (
    SELECT doc_id, line, count(*) - 1 AS again FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
    WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id, line
), dup AS (
    SELECT doc_id, sum(again) AS n FROM lines GROUP BY doc_id
), measured AS (
    SELECT w.doc_id, source AS host, len(w) AS n_words,
        coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
        len(regexp_extract_all(text, '[{quality.SYMBOLS}]')) AS n_symbols,
        coalesce(d.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
    FROM words w LEFT JOIN repeated r USING (doc_id) LEFT JOIN dup d USING (doc_id)
), judged AS (
    SELECT *, n_words < {quality.MIN_WORDS} OR n_repeat_words * 100 > n_words * {quality.MAX_REPEAT_PERCENT} AS base_failed FROM measured
), strict AS (
    SELECT *, base_failed OR n_symbols * 100 > word_chars * {quality.MAX_SYMBOL_PERCENT}
        OR n_dup_lines * 100 > n_words * {quality.MAX_DUP_LINE_PERCENT} AS strict_failed,
        base_failed OR n_symbols * 100 > word_chars * {quality.MAX_SYMBOL_PERCENT * quality.WIDE_MARGIN}
        OR n_dup_lines * 100 > n_words * {quality.MAX_DUP_LINE_PERCENT * quality.WIDE_MARGIN} AS wide_failed FROM judged
), hosts AS (
    SELECT host, count(*) AS host_docs, count(*) FILTER (WHERE strict_failed) AS host_failed FROM strict GROUP BY host
), sums AS (
    SELECT count(*) AS k, sum(host_docs)::DOUBLE AS n, sum(host_failed) / sum(host_docs) AS m,
        sum(host_docs::DOUBLE * host_docs) AS squares, sum(host_failed::DOUBLE * host_failed / host_docs) AS moment FROM hosts
), spread AS (
    SELECT m, CASE WHEN n - squares / n > 0 THEN (moment - n * m * m - m * (1 - m) * (k - 1)) / (n - squares / n) ELSE 0 END AS v FROM sums
), rated AS (
    SELECT host, host_docs, host_failed,
        least({quality.MAX_HOST_RATE}::DOUBLE, m + {quality.PRIOR_DEVIATIONS} * sqrt(least(greatest(v, 0), m * (1 - m)))) AS host_limit, CASE WHEN v <= 0 THEN m
        ELSE (host_failed + m * greatest(m * (1 - m) / v - 1, 0)) / (host_docs + greatest(m * (1 - m) / v - 1, 0)) END AS rate
    FROM hosts, spread
)
SELECT doc_id, s.host, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, host_docs, host_failed,
    round(rate, 6) AS host_rate, round(host_limit, 6) AS host_limit, rate <= host_limit AS host_trusted, base_failed,
    NOT wide_failed AND (rate <= host_limit OR NOT strict_failed) AS kept
FROM strict s JOIN rated r ON s.host IS NOT DISTINCT FROM r.host
"""

_D = suffixes.DEPTH

#: Texts as hexadecimal digits, two for each byte; positions count bytes from 0.
REPEATED_BYTES = f"""
WITH texts AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents
), strings AS (
    SELECT doc_id, p, substr(h, 2 * p + 1, {2 * _D}) AS s FROM (SELECT *, unnest(range(n - {_D} + 1)) AS p FROM texts WHERE n >= {_D})
), shared AS (
    SELECT s, min(doc_id) AS least FROM strings GROUP BY s HAVING min(doc_id) < max(doc_id)
), repeated AS (
    SELECT doc_id, p FROM strings JOIN shared USING (s) WHERE least < doc_id
), islands AS (
    SELECT doc_id, min(p) AS a, max(p) + {_D} AS b FROM (
        SELECT doc_id, p, sum(CASE WHEN p - before > {_D} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS g
        FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM repeated)) GROUP BY doc_id, g
), kept AS (
    SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS h
    FROM (SELECT i.*, t.h, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM islands i JOIN texts t USING (doc_id))
    GROUP BY doc_id
)
SELECT t.doc_id, t.n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
    sha256(unhex(CASE WHEN removed IS NULL THEN t.h ELSE k.h || substr(t.h, 2 * last + 1) END)) AS kept_sha256
FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""

VECTOR_LINKS = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {vectors.MIN_COSINE}
), reached AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
), roots AS (
    SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM roots LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
"""

_URL = {
    "host": r"regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www[.]', ''), ':(80|443)$', '')",
    "path": r"regexp_replace(regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '(/index)?[.]html?$', ''), '/+$', '')",
    "query": rf"""array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '[?](.*)$', 1), '&'),
        lambda p: p <> '' AND NOT regexp_matches(p, '^({revisits.TRACKING})(=|$)'))), '&')""",
}

REVISITS = f"""
WITH pages_ AS (
    SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest,
        md5(coalesce(html, '')) AS digest, length(coalesce(html, '')) AS size FROM pages
), known AS (
    SELECT *, {_URL["host"]} || {_URL["path"]} || CASE WHEN {_URL["query"]} <> '' THEN '?' || {_URL["query"]} ELSE '' END AS url_key,
        CASE WHEN size % 5 <> 0 AND size % 7 <> 0 THEN '"' || digest || '"' END AS etag,
        CASE WHEN size % 7 <> 0 THEN 'day ' || size % 365 END AS modified, page_id * 10 AS moment,
        page_id * 10 + 5 + (size % 1000) * 200 AS later FROM pages_
), records AS (
    SELECT page_id * 2 AS id, url_key, moment, true AS full_, etag, modified, page_id FROM known
    UNION ALL SELECT page_id * 2 + 1, url_key, later, false, etag, modified, page_id FROM known
), found AS (
    SELECT *, last_value(CASE WHEN full_ THEN id END IGNORE NULLS) OVER
        (PARTITION BY url_key ORDER BY moment, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS response_id FROM records
), joined AS (
    SELECT f.id AS record_id, f.url_key, f.response_id, r.size AS r_size, r.digest AS r_digest, r.page_id AS r_page,
        o.size AS o_size, o.later AS o_later, f.etag AS o_etag, r.etag AS r_etag, f.modified AS o_modified, r.modified AS r_modified
    FROM found f JOIN known o ON f.page_id = o.page_id LEFT JOIN known r ON f.response_id = r.page_id * 2 WHERE NOT f.full_
), judged AS (
    SELECT *, CASE WHEN response_id IS NULL OR url_key IS NULL THEN 'no_response'
        WHEN o_etag IS NOT NULL AND r_etag IS NOT NULL THEN CASE WHEN o_etag = r_etag THEN 'resolved' ELSE 'mismatch' END
        WHEN o_modified IS NOT NULL AND r_modified IS NOT NULL THEN CASE WHEN o_modified = r_modified THEN 'resolved' ELSE 'mismatch' END
        ELSE 'resolved' END AS status FROM joined
), shown AS (
    SELECT *, CASE WHEN o_etag IS NOT NULL THEN CASE WHEN o_size % 2 = 0 THEN 'W/' ELSE '' END || o_etag ELSE r_etag END AS etag FROM judged
)
SELECT record_id, url_key, CASE WHEN status <> 'no_response' THEN response_id END AS response_id, status,
    CASE WHEN status = 'resolved' THEN array_to_string(list_sort(list_filter([
        'cache-control: max-age=60', 'content-length: ' || r_size, 'content-type: text/html', 'date: ' || o_later,
        'etag: ' || etag, 'expires: ' || CASE WHEN o_size % 3 = 0 THEN o_later + 3600 END, 'last-modified: ' || r_modified
    ], lambda x: x IS NOT NULL)), chr(10)) END AS headers,
    CASE WHEN status = 'resolved' THEN r_size ELSE 0 END AS body_chars, CASE WHEN status = 'resolved' THEN r_digest END AS body_md5
FROM shown
"""

#: A term's weight and a document's norm are whole numbers, so both sides agree to the last digit.
RANKED = f"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS terms FROM documents
), items AS (
    SELECT item_id, unnest(list_distinct(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}'))) AS term FROM benchmark
), totals AS (
    SELECT count(*) FILTER (WHERE len(terms) > 0)::BIGINT AS all_docs, sum(len(terms))::BIGINT AS all_terms FROM texts
), held AS (
    SELECT r, doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM texts)
    WHERE term IN (SELECT term FROM items) GROUP BY r, doc_id, term
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(all_docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, totals GROUP BY term
), scored AS (
    SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(w * (({lexical.SCALE} * tf) // ({lexical.TF_PART} * tf
        + {lexical.LENGTH_PART} * (100 - {lexical.LENGTH_SHARE} + ({lexical.LENGTH_SHARE} * h.n * all_docs) // all_terms)))) AS BIGINT) AS score
    FROM items JOIN held h USING (term) JOIN weights USING (term), totals GROUP BY item_id, r
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""

#: A prefix is the string of its turns' digests, so an ancestor is a prefix of the string.
TRIE = f"""
WITH turns AS (
    SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
        sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
        md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn,
        len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS words
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT c, count(*) AS n, c - c % {prefixtrie.FAMILY} AS b, xor(list_reduce(
        list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda crc, x: list_reduce(list_prepend(xor(crc, x), range(8)), lambda a, k: xor(a >> 1, (a & 1) * 3988292384))),
        4294967295) % {prefixtrie.HEADS} AS h
    FROM turns GROUP BY c
), rebuilt AS (
    SELECT v.c, t.i AS d, turn, words FROM convs v JOIN turns t ON t.c = v.b AND t.i <= v.h UNION ALL
    SELECT v.c, t.i - v.h + least(v.h, coalesce(f.n, 0)), turn, words
    FROM convs v LEFT JOIN convs f ON f.c = v.b JOIN turns t ON t.c = v.c AND t.i > v.h
), members AS (
    SELECT c, d, string_agg(turn, '') OVER (PARTITION BY c ORDER BY d) AS p, words FROM rebuilt UNION ALL SELECT c, 0, '', 0 FROM convs
), nodes AS (
    SELECT p, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved FROM members GROUP BY p
), kids AS (
    SELECT substr(p, 1, 32 * (depth - 1)) AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), sums AS (
    SELECT substr(n.p, 1, 32 * k) AS p, count(*) FILTER (WHERE kids.p IS NULL) AS n_leaves, sum(saved) AS saved_tokens
    FROM nodes n LEFT JOIN kids ON kids.p = n.p, unnest(range(depth + 1)) t(k) GROUP BY 1
), ends AS (
    SELECT p, string_agg(c, ',' ORDER BY c) AS ids FROM members SEMI JOIN (SELECT c, max(d) AS d FROM members GROUP BY c) USING (c, d) GROUP BY p
)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
    n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN sums s ON s.p = n.p LEFT JOIN kids k ON k.p = n.p LEFT JOIN ends e ON e.p = n.p
LEFT JOIN nodes u ON n.depth > 0 AND u.p = substr(n.p, 1, 32 * (n.depth - 1))
"""
