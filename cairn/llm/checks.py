"""DuckDB SQL for the queries of this package that SQL can express."""

CHECKS: dict[str, str] = {}

CHECKS["op10_line_dedup"] = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT doc_id, pos, line,
        translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), common AS (
    SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT keyed.*, common.key IS NOT NULL AND common.last <> doc_id AS gone
    FROM keyed LEFT JOIN common USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

CHECKS["op5_adaptive_rules"] = r"""
WITH docs AS (
    SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents
), words AS (
    SELECT doc_id, lang, source, text,
        list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
    FROM docs
), grams AS (
    SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)
), twice AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n
    FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice WHERE c > 1) GROUP BY doc_id
), stats AS (
    SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
    FROM words LEFT JOIN covered USING (doc_id)
), ratios AS (
    SELECT *, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0.0 END AS symbol_ratio,
        CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_ratio,
        CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0 END AS repeat_ratio,
        CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS word_length
    FROM stats
), long AS (
    SELECT lang, source, rule, CASE WHEN v < 1e-6 THEN -1000000
        ELSE ceil(round(ln(v) / ln(1.01::DOUBLE / 0.99::DOUBLE), 6))::INT END AS bucket
    FROM (UNPIVOT (SELECT lang, source, symbol_ratio::DOUBLE AS symbol_ratio, dup_line_ratio::DOUBLE AS dup_line_ratio,
            repeat_ratio::DOUBLE AS repeat_ratio, word_length::DOUBLE AS word_length FROM ratios)
        ON symbol_ratio, dup_line_ratio, repeat_ratio, word_length INTO NAME rule VALUE v)
), parts AS (
    SELECT lang, source, rule, bucket, count(*) AS n FROM long GROUP BY ALL
), levels AS (
    SELECT 0 AS level, lang, source, rule, bucket, n FROM parts
    UNION ALL SELECT 1, lang, NULL, rule, bucket, sum(n) FROM parts GROUP BY lang, rule, bucket
    UNION ALL SELECT 2, NULL, NULL, rule, bucket, sum(n) FROM parts GROUP BY rule, bucket
), ranked AS (
    SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY bucket) AS upto,
        sum(n) OVER (PARTITION BY level, lang, source, rule) AS docs FROM levels
), places AS (
    SELECT level, lang, source, rule, first(docs) AS docs,
        min(bucket) FILTER (WHERE upto >= 0.25 * docs) AS b1, min(bucket) FILTER (WHERE upto >= 0.75 * docs) AS b3,
        min(bucket) FILTER (WHERE upto >= 0.99::DOUBLE * docs) AS b9
    FROM ranked GROUP BY level, lang, source, rule
), quarts AS (
    SELECT level, lang, source, rule, docs,
        CASE WHEN b1 = -1000000 THEN 0 ELSE 2 / (1.01::DOUBLE / 0.99 + 1) * pow(1.01::DOUBLE / 0.99, b1) END AS q1,
        CASE WHEN b3 = -1000000 THEN 0 ELSE 2 / (1.01::DOUBLE / 0.99 + 1) * pow(1.01::DOUBLE / 0.99, b3) END AS q3,
        CASE WHEN b9 = -1000000 THEN 0 ELSE 2 / (1.01::DOUBLE / 0.99 + 1) * pow(1.01::DOUBLE / 0.99, b9) END AS high
    FROM places
), picked AS (
    SELECT o.lang, o.source, o.rule,
        CASE WHEN o.docs >= 200 THEN o.q1 WHEN w.docs >= 200 THEN w.q1 ELSE e.q1 END AS q1,
        CASE WHEN o.docs >= 200 THEN o.q3 WHEN w.docs >= 200 THEN w.q3 ELSE e.q3 END AS q3,
        CASE WHEN o.docs >= 200 THEN o.high WHEN w.docs >= 200 THEN w.high ELSE e.high END AS high
    FROM quarts o JOIN quarts w ON w.level = 1 AND w.rule = o.rule AND w.lang IS NOT DISTINCT FROM o.lang
    JOIN quarts e ON e.level = 2 AND e.rule = o.rule WHERE o.level = 0
), fenced AS (
    SELECT lang, source, rule, CASE WHEN q3 > 0 THEN q3 + 3 * (q3 - q1) ELSE high END * slack AS above,
        (q1 - 3 * (q3 - q1)) / slack AS below
    FROM picked, (SELECT (1.01::DOUBLE / 0.99 + 1) / 2 * (1 + 1e-6::DOUBLE) AS slack)
), limits AS (
    SELECT lang, source, max(above) FILTER (WHERE rule = 'symbol_ratio') AS most_symbol,
        max(above) FILTER (WHERE rule = 'dup_line_ratio') AS most_dup, max(above) FILTER (WHERE rule = 'repeat_ratio') AS most_repeat,
        max(above) FILTER (WHERE rule = 'word_length') AS most_word, max(below) FILTER (WHERE rule = 'word_length') AS least_word
    FROM fenced GROUP BY lang, source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND symbol_ratio <= most_symbol
        AND dup_line_ratio <= most_dup AND repeat_ratio <= most_repeat AND word_length <= most_word
        AND word_length >= least_word AS kept
FROM ratios r JOIN limits l ON r.lang IS NOT DISTINCT FROM l.lang AND r.source IS NOT DISTINCT FROM l.source
"""


def _deal(children: str, parent: str, order: str) -> str:
    """Budgets of the children (capacity, weight, given) of each parent, as ``mixing.deal`` gives them."""
    over = f"PARTITION BY {parent}" if parent else ""
    line = f"{over} ORDER BY capacity / weight, " + ", ".join(f"{c} NULLS FIRST" for c in order.split(", "))
    return f"""
    SELECT *, budget0 + CASE WHEN NOT is_full AND opened <= spare THEN 1 ELSE 0 END AS budget FROM (
        SELECT *, given - sum(budget0) OVER ({over}) AS spare,
            sum(CASE WHEN is_full THEN 0 ELSE 1 END) OVER ({line} ROWS UNBOUNDED PRECEDING) AS opened FROM (
            SELECT *, CASE WHEN is_full THEN capacity ELSE (rest * weight) // greatest(open_weight, 1) END AS budget0 FROM (
                SELECT *, given - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({over}) AS rest,
                    sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({over}) AS open_weight FROM (
                    SELECT *, capacity * share <= (given - spent) * weight AS is_full FROM (
                        SELECT *, coalesce(sum(capacity) OVER ({line} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
                            sum(weight) OVER ({line} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
                        FROM {children} WHERE weight > 0) a) b) c) d) e"""


CHECKS["op4_mixed_sources"] = f"""
WITH docs AS (
    SELECT doc_id, lang, source, CASE right(source, 1) WHEN '0' THEN 'web' WHEN '1' THEN 'web' WHEN '2' THEN 'web'
            WHEN '3' THEN 'books' WHEN '4' THEN 'books' WHEN '5' THEN 'books' WHEN '6' THEN 'talk' WHEN '7' THEN 'talk'
            ELSE CASE WHEN source IS NOT NULL THEN 'code' END END AS domain,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens
    FROM documents
), leaves AS (
    SELECT domain, lang, source, sum(tokens) AS tokens, 2 * sum(tokens) AS capacity FROM docs GROUP BY ALL
), top AS (
    SELECT domain, sum(capacity) AS capacity, (SELECT sum(tokens) FROM leaves) AS given,
        CASE domain WHEN 'web' THEN 4 WHEN 'books' THEN 3 WHEN 'talk' THEN 2 WHEN 'code' THEN 2 ELSE 1 END AS weight
    FROM leaves GROUP BY domain
), top_dealt AS ({_deal("top", "", "domain")}
), middle AS (
    SELECT l.domain, l.lang, sum(l.capacity) AS capacity, any_value(t.budget) AS given,
        CASE l.lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS weight
    FROM leaves l JOIN top_dealt t ON l.domain IS NOT DISTINCT FROM t.domain GROUP BY l.domain, l.lang
), middle_dealt AS ({_deal("middle", "domain", "domain, lang")}
), low AS (
    SELECT l.domain, l.lang, l.source, l.tokens, l.capacity, m.budget AS given,
        CASE l.source WHEN 'src0' THEN 3 ELSE 1 END AS weight
    FROM leaves l JOIN middle_dealt m ON l.domain IS NOT DISTINCT FROM m.domain AND l.lang IS NOT DISTINCT FROM m.lang
), low_dealt AS ({_deal("low", "domain, lang", "domain, lang, source")}
), ends AS (
    SELECT domain, lang, source, CASE WHEN tokens = 0 THEN 0 ELSE budget // tokens END AS whole,
        CASE WHEN tokens = 0 THEN 0 ELSE budget % tokens END AS rest FROM low_dealt
), placed AS (
    SELECT d.*, e.whole, e.rest, coalesce(sum(d.tokens) OVER (
        PARTITION BY d.domain, d.lang, d.source ORDER BY md5('17:' || e.whole::BIGINT || ':' || coalesce(d.doc_id::VARCHAR, 'null'))
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun
    FROM docs d JOIN ends e ON d.domain IS NOT DISTINCT FROM e.domain AND d.lang IS NOT DISTINCT FROM e.lang
        AND d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, domain, lang, source, tokens, epoch, tokens AS tokens_taken
FROM (SELECT *, unnest(range(0, whole::BIGINT)) AS epoch FROM placed)
UNION ALL
SELECT doc_id, domain, lang, source, tokens, whole::BIGINT, least(tokens, rest - begun)::BIGINT
FROM placed WHERE begun < rest
"""


#: The table of the reflected CRC-32 polynomial 0xEDB88320, and the CRC of a text out of it.
CRC_TABLE = """crc_table AS MATERIALIZED (
    SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
        lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
)"""


def crc32(text: str, table: str = "t") -> str:
    """Unsigned CRC-32 of a text in SQL; ``table`` names the column of ``CRC_TABLE``."""
    each = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    step = f"lambda c, x: xor(c >> 8, {table}[(xor(c, x) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {each}), {step}), 4294967295)"


CHECKS["op13_prefix_trie"] = f"""
WITH {CRC_TABLE}, own AS (
    SELECT conv_id, list({{'role': coalesce(role, ''), 'txt': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heads AS (
    SELECT own.*, {crc32("conv_id::VARCHAR")} % 4 AS h FROM own, crc_table
), rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
    FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20
), paths AS (
    SELECT conv_id, d AS depth, sha256(turns[1:d]::VARCHAR) AS node, CASE WHEN d > 0 THEN sha256(turns[1:d - 1]::VARCHAR) END AS above,
        d = len(turns) AS last, CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].txt, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
    FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(above) AS above, count(*) AS n_convs,
        any_value(words) AS words,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
    FROM paths GROUP BY node
), children AS (
    SELECT above AS node, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY above
), worth AS (
    SELECT nodes.*, coalesce(n, 0) AS n_children, (n IS NULL)::BIGINT AS leaf, (n_convs - 1) * words AS saved
    FROM nodes LEFT JOIN children USING (node)
), sums AS (
    SELECT p.node, sum(w.leaf)::BIGINT AS n_leaves, sum(w.saved)::BIGINT AS saved_tokens
    FROM worth w JOIN paths p ON p.conv_id = w.conv_id AND p.depth <= w.depth GROUP BY p.node
)
SELECT w.conv_id, w.depth, a.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM worth w JOIN sums USING (node) LEFT JOIN nodes a ON a.node = w.above
"""


#: Letters beyond ASCII as other ASCII characters, so that a distance in bytes is one in letters.
_WIDE = "".join(chr(c) for c in range(0xC0, 0x100))
_NARROW = "".join(c for c in map(chr, range(33, 127)) if c not in "abcdefghijklmnopqrstuvwxyz'")[:64]

CHECKS["op11_spelling_variants"] = f"""
WITH {CRC_TABLE}, runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (
    SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run
), hashed AS (
    SELECT run, n, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h
    FROM counted, crc_table
), words AS (
    SELECT CASE WHEN h % 199 = 0 THEN run[:(h % length(run))::INT] || run[(h % length(run))::INT + 2:] ELSE run END AS word, sum(n)::BIGINT AS n
    FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5
), narrow AS (
    SELECT word, n, translate(word, '{_WIDE}', '{_NARROW}') AS w, length(word) AS size FROM words
), pairs AS (
    SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM narrow a JOIN narrow b
        ON b.size BETWEEN a.size - 1 AND a.size + 1 AND a.word <> b.word AND levenshtein(a.w, b.w) = 1
), best AS (
    SELECT word, count(*) AS n_near, arg_min({{'near': near, 'n': near_n}}, {{'less': -near_n, 'near': encode(near)}}) AS best FROM pairs GROUP BY word
), forms AS (
    SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 5 * n THEN best.near END AS form,
        CASE WHEN best.n >= 5 * n THEN best.n END AS form_n
    FROM words LEFT JOIN best USING (word)
), chains AS (
    WITH RECURSIVE c AS (
        SELECT word, form, word AS last FROM forms
        UNION ALL SELECT c.word, f.form, f.word FROM c JOIN forms f ON f.word = c.form
    ) SELECT word, last AS root FROM c WHERE form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN chains USING (word)
"""

CHECKS["op12_signature_join"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, sha256(array_to_string(w[i:i + 4], ' ')) AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach AS (
    SELECT doc_id AS here, doc_id AS start FROM documents
    UNION SELECT b, start FROM reach JOIN links ON a = here
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, low AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT start, min(here) AS low FROM reach GROUP BY start) r ON r.start = d.doc_id
"""
