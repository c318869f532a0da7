"""SQL counterparts of the training-data queries, where SQL can express them."""

from stellwerk.llm.quality_rules import PHRASE, SIGN_LENGTH

_SPACE = "[\\x20\\x09-\\x0D]+"
_WORD = "[^\\x20\\x09-\\x0D]"

_SIGNS = f"""(
    len(regexp_extract_all(l, '!!')) // 2
    + len(regexp_extract_all(l, ' \\| ')) // 2
    + CAST(regexp_matches(l, '\\|[\\x20\\x09-\\x0D]*\\z') AS BIGINT)
    + len(regexp_extract_all(l, ' [>»] ')) // 2
    + len(regexp_extract_all(lower(l), '{PHRASE}'))
)"""

_LINE_FAILS = f"""(
    length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) * 10 > length(l)
    OR (length(regexp_replace(l, '[^A-Za-z]', '', 'g')) >= 20
        AND NOT regexp_matches(l, '[a-z]'))
    OR ({_SIGNS} > 0 AND {_SIGNS} * {SIGN_LENGTH} >= length(l))
)"""

QUALITY = f"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS t FROM documents
), parts AS (
    SELECT doc_id, t,
        list_filter(regexp_split_to_array(t, '{_SPACE}'), lambda w: w <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS ls
    FROM texts
), windows AS (
    SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM parts)
), repeated AS (
    SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), covered AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, (VALUES (0), (1), (2)) AS steps(k) GROUP BY doc_id
), counts AS (
    SELECT doc_id,
        CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
        length(regexp_replace(array_to_string(list_filter(ls, lambda l: NOT {_LINE_FAILS}), ' '), '{_SPACE}', '', 'g')) AS kept_chars
    FROM parts LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * (word_chars - kept_chars) <= word_chars AS kept
FROM counts
"""

# Sources share the total by weight until none is above twice its size; a source's documents are then taken in the
# order of their hash, once more, while its budget lasts.
MIXING = f"""
WITH RECURSIVE docs AS (
    SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), sizes AS (
    SELECT doc_id, source,
        CAST(len(list_filter(regexp_split_to_array(t, '{_SPACE}'), lambda w: w <> '')) AS BIGINT) AS size,
        CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || t), 15) AS BIGINT) AS h
    FROM docs
), sources AS (
    SELECT source, source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
    FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source)
), rounds AS (
    SELECT 1 AS i, 1.5::DOUBLE * sum(source_size) / sum(w) AS unit FROM sources
    UNION ALL
    SELECT i + 1, (
        SELECT (1.5::DOUBLE * sum(source_size) - coalesce(sum(2 * source_size) FILTER (w * r.unit > 2 * source_size), 0))
            / sum(w) FILTER (w * r.unit <= 2 * source_size)
        FROM sources)
    FROM rounds AS r WHERE i < 64
), targets AS (
    SELECT source, source_size,
        least(w * (SELECT max(unit) FROM rounds), 2 * source_size)::DOUBLE AS target
    FROM sources
), budgets AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets
), ordered AS (
    SELECT s.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size
        - (sum(s.size) OVER (PARTITION BY s.source ORDER BY h, s.doc_id ROWS UNBOUNDED PRECEDING) - s.size) AS rest
    FROM sizes AS s JOIN budgets AS b ON s.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
    CAST(size * (whole + CASE WHEN rest >= size OR (rest > 0 AND size <= 2 * rest) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ordered
"""

# All anchors against all rows.
HARD_NEGATIVES = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
        CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
    FROM rows AS a JOIN rows AS r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

COLLOCATIONS = """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
        unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents
), parts AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS ws FROM pieces
), places AS (
    SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM parts
), f1 AS (
    SELECT lang, ws[i] AS w1, count(*) AS f FROM places GROUP BY ALL
), f2 AS (
    SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, count(*) AS f FROM places WHERE i < len(ws) GROUP BY ALL HAVING count(*) >= 10
), f3 AS (
    SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3, count(*) AS f FROM places WHERE i + 1 < len(ws)
    GROUP BY ALL HAVING count(*) >= 10
), totals AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang
), cuts AS (
    SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, p.f AS a, x.f AS l, y.f AS r, 1 AS k
    FROM f2 AS p JOIN f1 AS x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f1 AS y ON y.lang = p.lang AND y.w1 = p.w2
    WHERE NOT EXISTS (
        SELECT * FROM f3 AS t
        WHERE t.lang = p.lang AND (t.w1 = p.w1 AND t.w2 = p.w2 OR t.w2 = p.w1 AND t.w3 = p.w2) AND 100 * t.f >= 50 * p.f)
    UNION ALL
    SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, x.f, y.f, 1
    FROM f3 AS t JOIN f1 AS x ON x.lang = t.lang AND x.w1 = t.w1
    JOIN f2 AS y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
    UNION ALL
    SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, x.f, y.f, 2
    FROM f3 AS t JOIN f2 AS x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2
    JOIN f1 AS y ON y.lang = t.lang AND y.w1 = t.w3
), scored AS (
    SELECT lang, phrase, a, l, r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score
    FROM cuts
    QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r), k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM scored JOIN totals USING (lang)
QUALIFY rank <= 2000
"""
