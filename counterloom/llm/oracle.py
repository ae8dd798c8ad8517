"""SQL counterparts of queries that SQL can express, for DuckDB."""

from counterloom.llm.quality_rules import LANGUAGES, OTHER, RULES

TOP_PRODUCTS_SQL = """
WITH rows AS (
    SELECT row_number() OVER () AS place, vec_id,
        list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::HUGEINT) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS (
    SELECT place, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM rows
),
scores AS (
    SELECT q.place, q.vec_id AS query_id, c.place AS other, c.vec_id, sum(q.x * c.x)::BIGINT AS score
    FROM parts q JOIN parts c ON q.i = c.i
    WHERE q.vec_id % 20 = 0 AND c.place <> q.place
    GROUP BY ALL
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS rank
    FROM scores
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

PASSAGES_SQL = r"""
WITH texts AS (
    SELECT doc_id, list_filter(
        string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''
    ) AS words
    FROM documents
),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM texts),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS place FROM texts),
windows AS (
    SELECT doc_id, place, sha256(array_to_string(words[place:place + 49], ' ')) AS passage FROM starts
),
firsts AS (SELECT passage, min(doc_id) AS first FROM windows GROUP BY passage),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(place, place + 50)) AS place
    FROM windows JOIN firsts USING (passage) WHERE first < doc_id
),
rest AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS kept
    FROM placed ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN rest USING (doc_id)
"""

REVISITS_SQL = """
WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
),
fives AS (
    SELECT *, list_transform(range(8), lambda i: ('0x' || hex[i * 5 + 1:i * 5 + 5])::BIGINT) AS parts
    FROM payloads
),
coded AS (
    SELECT page_id, payload, array_to_string(list_transform(parts, lambda v: array_to_string(
        list_transform([15, 10, 5, 0], lambda s:
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> s::INTEGER) & 31) + 1]), '')), '') AS digest
    FROM fives
),
firsts AS (SELECT payload, min(page_id) AS first FROM payloads GROUP BY payload)
SELECT page_id, strlen(payload) AS payload_bytes, digest AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM coded JOIN firsts USING (payload)
"""

_CUTOFFS = ", ".join(
    f"('{rule.name}', {step}, '{cutoff!r}'::DOUBLE)"
    for rule in RULES
    for step, cutoff in enumerate(rule.cutoffs())
)
_VALUES = " UNION ALL ".join(
    f"SELECT doc_id, stratum, base_failed, '{rule.name}' AS rule,"
    f" {rule.top}::DOUBLE / greatest({rule.bottom}, 1) AS value FROM measured"
    for rule in RULES
)
_ALPHA = f"(0.02::DOUBLE / {len(RULES)})"
_DELTA = f"(0.05::DOUBLE / {len(RULES) * (len(LANGUAGES) + 1)})"

QUALITY_SQL = rf"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text,
        CASE WHEN lang IN {LANGUAGES} THEN lang ELSE '{OTHER}' END AS stratum,
        list_filter(
            string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''
        ) AS words,
        list_filter(
            string_split(coalesce(text, ''), chr(10)),
            lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')
        ) AS lines
    FROM documents
),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS place FROM texts),
triples AS (SELECT doc_id, place, words[place:place + 2] AS triple FROM starts),
often AS (SELECT doc_id, triple FROM triples GROUP BY ALL HAVING count(*) > 1),
covered AS (
    SELECT DISTINCT doc_id, unnest([place, place + 1, place + 2]) AS place
    FROM triples JOIN often USING (doc_id, triple)
),
repeats AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
counted AS (
    SELECT doc_id, stratum, len(words)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(words, lambda x: len(x))), 0)::BIGINT AS word_chars,
        (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
        (len(text) - len(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_upper
    FROM texts LEFT JOIN repeats USING (doc_id)
),
measured AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
),
valued AS ({_VALUES}),
known AS (
    SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id
),
cutoffs(rule, step, cutoff) AS (VALUES {_CUTOFFS}),
tried AS (
    SELECT stratum, rule, step, cutoff, count(*) FILTER (quality = 1) AS n,
        count(*) FILTER (quality = 1 AND value > cutoff) AS k,
        count(*) FILTER (quality = 0 AND value > cutoff) AS bad
    FROM valued JOIN known USING (doc_id) JOIN cutoffs USING (rule)
    WHERE NOT base_failed GROUP BY ALL
),
bounded AS (
    SELECT *, n > 0 AND (CASE WHEN k >= n THEN 1 ELSE list_sum(list_transform(
        range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
            + i * ln({_ALPHA}) + (n - i) * ln(1 - {_ALPHA})))) END) <= {_DELTA} AS certain
    FROM tried
),
walked AS (
    SELECT *, bool_and(certain) OVER (PARTITION BY stratum, rule ORDER BY step) AS certified
    FROM bounded
),
chosen AS (
    SELECT stratum, rule, arg_min(cutoff, (k - bad, step)) AS cutoff
    FROM walked WHERE certified AND bad > k GROUP BY stratum, rule
),
broken AS (
    SELECT DISTINCT doc_id FROM valued JOIN chosen USING (stratum, rule) WHERE value > cutoff
)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND b.doc_id IS NULL AS kept
FROM measured m LEFT JOIN broken b ON m.doc_id = b.doc_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

COLLOCATIONS_SQL = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
        unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
),
words AS (
    SELECT lang, row_number() OVER () AS piece,
        list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
    FROM pieces
),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
placed AS (SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM words),
runs AS (
    SELECT lang, w1, lead(w1, 1) OVER win AS w2, lead(w1, 2) OVER win AS w3
    FROM placed WINDOW win AS (PARTITION BY piece ORDER BY i)
),
f AS (
    SELECT lang, 1 AS size, [w1] AS phrase, count(*) AS a FROM runs GROUP BY lang, w1
    UNION ALL
    SELECT lang, 2, [w1, w2], count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY lang, w1, w2
    UNION ALL
    SELECT lang, 3, [w1, w2, w3], count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3
),
candidates AS (SELECT * FROM f WHERE size > 1 AND a >= 10),
cuts AS (
    SELECT c.lang, c.phrase, c.size, c.a, k, l.a AS l, r.a AS r,
        (1000000::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a) AS score
    FROM candidates c JOIN (VALUES (1), (2)) places(k) ON k < c.size
    JOIN f l ON l.lang = c.lang AND l.phrase = c.phrase[1:k]
    JOIN f r ON r.lang = c.lang AND r.phrase = c.phrase[k + 1:c.size]
),
weakest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
),
inner_parts AS (
    SELECT lang, phrase[1:2] AS phrase, a FROM candidates WHERE size = 3
    UNION ALL SELECT lang, phrase[2:3], a FROM candidates WHERE size = 3
),
hidden AS (
    SELECT DISTINCT c.lang, c.phrase FROM candidates c
    JOIN inner_parts p ON p.lang = c.lang AND p.phrase = c.phrase WHERE 100 * p.a >= 50 * c.a
),
ranked AS (
    SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, score::BIGINT AS score,
        row_number() OVER (
            PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')
        ) AS rank
    FROM weakest ANTI JOIN hidden USING (lang, phrase)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

JACCARD_SQL = rf"""
WITH RECURSIVE texts AS (
    SELECT row_number() OVER () AS id, doc_id, list_filter(
        string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> ''
    ) AS w
    FROM documents
),
shingles AS (
    SELECT DISTINCT id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(
        list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2]) END) AS shingle
    FROM texts
),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
common AS (
    SELECT a.id AS u, b.id AS v, count(*) AS c
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.id <> b.id GROUP BY ALL
),
links AS (
    SELECT u, v FROM common JOIN sizes x ON x.id = u JOIN sizes y ON y.id = v
    WHERE 100 * c >= 80 * (x.n + y.n - c)
),
reached(id, other) AS (
    SELECT id, id FROM texts
    UNION
    SELECT r.id, l.v FROM reached r JOIN links l ON l.u = r.other
),
named AS (
    SELECT r.id, min(t.doc_id) AS component_id FROM reached r JOIN texts t ON t.id = r.other GROUP BY r.id
)
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, component_id,
    t.doc_id IS NOT DISTINCT FROM component_id AS kept
FROM texts t JOIN named USING (id) LEFT JOIN sizes USING (id)
"""

_CRC32 = """xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
        lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)
), 4294967295)"""

TRIE_SQL = f"""
WITH turns AS (
    SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (
    SELECT conv, conv - conv % 5 AS base, {_CRC32} % 9 AS h FROM (SELECT DISTINCT conv FROM turns)
),
shared AS (
    SELECT c.conv, 0 AS own, t.pos, role, text FROM convs c JOIN turns t ON t.conv = base AND t.pos <= h
    UNION ALL
    SELECT c.conv, 1, t.pos, role, text FROM convs c JOIN turns t ON t.conv = c.conv AND t.pos > h
),
paths AS (
    SELECT conv, row_number() OVER w AS depth, octet_length(encode(text)) AS bytes, array_to_string(
        list(md5(length(role) || ':' || role || ':' || text)) OVER w, '') AS prefix
    FROM shared WINDOW w AS (PARTITION BY conv ORDER BY own, pos)
    UNION ALL
    SELECT conv, 0, 0, '' FROM convs
),
nodes AS (
    SELECT prefix, depth, min(conv) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes
    FROM paths GROUP BY prefix, depth
),
children AS (
    SELECT left(prefix, length(prefix) - 32) AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
),
above AS (
    SELECT left(n.prefix, 32 * unnest(range(0, depth + 1))) AS prefix, c.n IS NULL AS leaf,
        (n_convs - 1) * bytes AS saved
    FROM nodes n LEFT JOIN children c ON c.prefix = n.prefix
),
sums AS (
    SELECT prefix, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY prefix
),
ends AS (
    SELECT prefix, string_agg(conv::VARCHAR, ',' ORDER BY conv) AS members FROM (
        SELECT conv, arg_max(prefix, depth) AS prefix FROM paths GROUP BY conv) GROUP BY prefix
)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(c.n, 0) AS n_children,
    n_leaves, saved_tokens, sha256(coalesce(members, '')) AS ends_sha256
FROM nodes x JOIN sums USING (prefix) LEFT JOIN children c USING (prefix) LEFT JOIN ends USING (prefix)
LEFT JOIN nodes p ON x.depth > 0 AND p.prefix = left(x.prefix, length(x.prefix) - 32)
"""
