"""DuckDB SQL for the queries' rows, written without the operators' methods."""

NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS s
  FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), lowest AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN lowest ON x = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

HOST_RULES = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), placed AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM base)
), threes AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) > 1 AS again FROM placed WHERE c IS NOT NULL
), covered AS (
  SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM threes, range(3) r(k) WHERE again GROUP BY doc_id
), lines AS (
  SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM base)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL
), twice AS (SELECT doc_id, sum(n - 1)::BIGINT AS n FROM lines GROUP BY doc_id
), counted AS (
  SELECT base.doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(twice.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM base LEFT JOIN covered USING (doc_id) LEFT JOIN twice USING (doc_id)
), flagged AS (
  SELECT doc_id, source, unnest([
    {r: 'short', f: n_words < 50}, {r: 'repeats', f: 100 * n_repeat_words > 50 * n_words}, {r: 'symbols', f: 10 * n_symbols > word_chars},
    {r: 'lines', f: 3 * n_dup_lines > n_words}, {r: 'word_length', f: n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)}], recursive := true)
  FROM counted
), hosts AS (SELECT source, r, count(*) AS n, sum(f::INT) AS bad FROM flagged GROUP BY ALL
), moments AS (
  SELECT r, sum(bad) / sum(n) AS m, sum(bad::DOUBLE * bad / n) - sum(bad)::DOUBLE * sum(bad) / sum(n) AS spread, count(*) - 1 AS others, sum(n) - sum(n::DOUBLE * n) / sum(n) - (count(*) - 1) AS room
  FROM hosts GROUP BY r
), strength AS (
  SELECT r, m, CASE WHEN NOT m * (1 - m) * room > 0 THEN 1 WHEN spread - m * (1 - m) * others > 0
    THEN least(1000, greatest(1, m * (1 - m) * room / (spread - m * (1 - m) * others) - 1)) ELSE 1000 END AS k FROM moments
), verdicts AS (SELECT source, bool_or((bad + k * m) / (n + k) > 0.5) AS gone FROM hosts JOIN strength USING (r) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT gone AS kept
FROM counted JOIN verdicts ON counted.source IS NOT DISTINCT FROM verdicts.source
"""

MIXING = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 14))::BIGINT AS place
  FROM documents
), turns AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sizes GROUP BY source
), units AS (
  SELECT *, 2 * source_size AS cap, (sum(source_size) OVER () * 150 - 100 * coalesce(sum(2 * source_size) OVER before, 0))::BIGINT / 1e2 / (sum(weight) OVER later)::BIGINT AS unit
  FROM turns WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    later AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT first(unit ORDER BY cap / weight, source NULLS LAST) AS unit FROM units WHERE unit * weight < cap
), goal AS (
  SELECT source, source_size, least(coalesce(level.unit * weight, cap::DOUBLE), cap::DOUBLE) AS target FROM units LEFT JOIN level ON true
), ranked AS (
  SELECT s.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
    sum(size) OVER (PARTITION BY s.source ORDER BY place)::BIGINT AS upto, sum(size) OVER (PARTITION BY s.source, place)::BIGINT AS here
  FROM sizes s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, size * (whole + (upto <= budget OR (upto - here <= budget AND here < 2 * (budget - upto + here)))::BIGINT)::BIGINT AS taken
FROM (SELECT *, floor(target - whole * source_size)::BIGINT AS budget FROM ranked)
"""

REPEATS = r"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), starts AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM docs
), strings AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM starts
), owners AS (SELECT s, min(doc_id) AS owner FROM strings GROUP BY s
), taken AS (SELECT doc_id, p FROM strings JOIN owners USING (s) WHERE owner < doc_id
), islands AS (SELECT doc_id, p, sum((p > q + 50 OR q IS NULL)::INT) OVER (PARTITION BY doc_id ORDER BY p) AS island
  FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM taken)
), spans AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM islands GROUP BY doc_id, island
), pieces AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM spans
  UNION ALL SELECT doc_id, coalesce(max(b), 0), any_value(length(h) // 2) FROM docs LEFT JOIN spans USING (doc_id) GROUP BY doc_id
), left_over AS (SELECT doc_id, string_agg(substr(h, (2 * x + 1)::BIGINT, (2 * (y - x))::BIGINT), '' ORDER BY x, y) AS kept FROM pieces JOIN docs USING (doc_id) GROUP BY doc_id
), sums AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM docs JOIN left_over USING (doc_id) LEFT JOIN sums USING (doc_id)
"""

MANIFEST = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, lang, n_chars, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END) AS turned
  FROM documents
), leaves AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
    sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
    CASE WHEN xor(turned, 4294967295) % 5 = 0 THEN sha256(head || coalesce(strlen(low)::VARCHAR || ':' || low, '-')) END AS other
  FROM (SELECT *, array_to_string(list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR], lambda v: coalesce(strlen(v)::VARCHAR || ':' || v, '-')), '') AS head FROM rows)
), trees AS (
  SELECT source, 0 AS lvl, i, n, leaf AS h FROM leaves
  UNION ALL SELECT source, lvl + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM trees WHERE n > 1 GROUP BY source, lvl, i // 16, n
), subroots AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS j FROM trees WHERE n = 1
), upper AS (
  SELECT 0 AS lvl, j AS i, (SELECT count(*) FROM subroots) AS n, subroot AS h FROM subroots
  UNION ALL SELECT lvl + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY lvl, i // 16, n
), sides AS (
  SELECT source, lvl, i, coalesce(string_agg(h, '') OVER (PARTITION BY source, lvl, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(h, '') OVER (PARTITION BY source, lvl, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM trees WHERE n > 1
), upper_sides AS (
  SELECT lvl, i, coalesce(string_agg(h, '') OVER (PARTITION BY lvl, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(h, '') OVER (PARTITION BY lvl, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM upper WHERE n > 1
), steps AS (
  SELECT doc_id, s.lvl, a, b FROM leaves l JOIN sides s ON l.source IS NOT DISTINCT FROM s.source AND s.i = l.i >> (4 * s.lvl)
  UNION ALL SELECT doc_id, 100 + u.lvl, a, b FROM leaves l JOIN subroots r ON l.source IS NOT DISTINCT FROM r.source JOIN upper_sides u ON u.i = r.j >> (4 * u.lvl)
), folded AS (
  SELECT doc_id, list_reduce(list_concat([['', coalesce(other, leaf), '']], coalesce(list([a, '', b] ORDER BY lvl) FILTER (a IS NOT NULL), [])),
      lambda x, y: ['', sha256(y[1] || x[2] || y[3]), ''])[2] AS folded_root, sha256(coalesce(string_agg(a || b, '' ORDER BY lvl), '')) AS proof_sha256
  FROM leaves LEFT JOIN steps USING (doc_id) GROUP BY doc_id, leaf, other
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN subroots r ON l.source IS NOT DISTINCT FROM r.source JOIN folded USING (doc_id), (SELECT h AS root FROM upper WHERE n = 1)
"""

REPEATED_WORDS = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), placed AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word, w FROM words
), starts AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS s FROM placed WHERE i + 34 <= len(w)
), again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY s) > 1 AS twice FROM starts
), judged AS (
  SELECT doc_id, i, word, coalesce(bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), false) AS gone
  FROM placed LEFT JOIN again USING (doc_id, i)
), sums AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM judged GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM words LEFT JOIN sums USING (doc_id)
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 6) AS t(k)) GROUP BY ALL
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang
), frequent AS (SELECT lang, k, g, string_split(g, ' ') AS w, f FROM grams WHERE f >= 100
), cuts AS (SELECT lang, k, g, f, c, array_to_string(w[:c], ' ') AS x, array_to_string(w[c + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS c FROM frequent)
), rated AS (
  SELECT cuts.lang, cuts.k, cuts.g, cuts.f AS a, p.f AS l, q.f AS r, n, (1000::HUGEINT * cuts.f * n) // (p.f::HUGEINT * q.f) AS score, c
  FROM cuts JOIN frequent p ON p.lang = cuts.lang AND p.g = x JOIN frequent q ON q.lang = cuts.lang AND q.g = y JOIN totals ON totals.lang = cuts.lang
), lowest AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1
), parts AS (
  SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS g, f FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM frequent))
), held AS (SELECT lang, g, max(f) AS most FROM parts GROUP BY ALL
), kept AS (SELECT lowest.* FROM lowest LEFT JOIN held USING (lang, g) WHERE most IS NULL OR 100 * most < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""
