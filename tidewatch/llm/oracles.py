"""DuckDB counterparts of those queries that SQL can express.

The others depend on XXH64, tokenizer libraries, trained trees or several hundred patterns; they
are compared with brute force in the tests.
"""

from __future__ import annotations

_SPACE = r"[^\x20\x09-\x0D]"

#: Words, their three-word windows, and the words inside windows that occur twice or more.
_COUNTS = rf"""docs AS (
  SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(text, '{_SPACE}+') AS w FROM docs)
), windows AS (
  SELECT doc_id, pos, concat(word, ' ', lead(word) OVER o, ' ', lead(word, 2) OVER o) AS gram, lead(word, 2) OVER o IS NOT NULL AS whole
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), twice AS (
  SELECT doc_id, pos, whole AND count(*) FILTER (whole) OVER (PARTITION BY doc_id, gram) > 1 AS again FROM windows
), covered AS (
  SELECT doc_id, max(CAST(again AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS inside
  FROM twice
), repeats AS (
  SELECT doc_id, count(*) AS n_words, sum(inside) AS n_repeat_words FROM covered GROUP BY doc_id
), lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '{_SPACE}')) AS x FROM docs
), counted AS (
  SELECT d.doc_id, d.lang, d.source, coalesce(r.n_words, 0) AS n_words, CAST(coalesce(r.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS BIGINT) AS n_upper,
    CAST(len(x) AS BIGINT) AS n_lines, CAST(len(x) - len(list_distinct(x)) AS BIGINT) AS n_dup_lines
  FROM docs d LEFT JOIN repeats r USING (doc_id) JOIN lines USING (doc_id)
), rated AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_symbols / greatest(n_words, 1) AS symbol_rate, n_dup_lines / greatest(n_lines, 1) AS dup_line_rate,
    n_repeat_words / greatest(n_words, 1) AS repeat_rate, n_upper / greatest(word_chars, 1) AS upper_rate,
    word_chars / greatest(n_words, 1) AS word_length
  FROM counted
)"""

_RATES = {"symbol_rate": 0.05, "dup_line_rate": 0.15, "repeat_rate": 0.15, "upper_rate": 0.03, "word_length": 0.35}


def _quality() -> str:
    """Quartiles by language and source, language, and everything; fences; the verdict."""
    quartiles = ", ".join(f"quantile_disc({c}, 0.25) AS {c}_1, quantile_disc({c}, 0.75) AS {c}_3" for c in _RATES)
    chosen = ", ".join(
        f"CASE WHEN o.n >= 50 THEN o.{c}_{q} WHEN l.n >= 50 THEN l.{c}_{q} ELSE a.{c}_{q} END AS {c}_{q}" for c in _RATES for q in (1, 3))
    within = " AND ".join(
        f"{c} <= {c}_3 + 3 * greatest({c}_3 - {c}_1, {s}) AND {c} >= "
        + (f"{c}_1 - 3 * greatest({c}_3 - {c}_1, {s})" if c == "word_length" else "0")
        for c, s in _RATES.items())
    return f"""WITH {_COUNTS}, passed AS (
  SELECT * FROM rated WHERE NOT base_failed
), own AS (SELECT lang, source, count(*) AS n, {quartiles} FROM passed GROUP BY lang, source),
by_lang AS (SELECT lang, count(*) AS n, {quartiles} FROM passed GROUP BY lang),
by_all AS (SELECT {quartiles} FROM passed),
limits AS (
  SELECT o.lang, o.source, {chosen}
  FROM own o JOIN by_lang l ON o.lang IS NOT DISTINCT FROM l.lang CROSS JOIN by_all a
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce({within}, false) AS kept
FROM rated r LEFT JOIN limits t ON r.lang IS NOT DISTINCT FROM t.lang AND r.source IS NOT DISTINCT FROM t.source"""


#: Every window of 100 bytes (as 200 hex digits), those seen before, the spans they cover, the rest.
_REPEATS = """WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents
), windows AS (
  SELECT doc_id, p, md5_number(substr(x, 2 * p + 1, 200)) AS w
  FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS p FROM docs WHERE n >= 100)
), later AS (
  SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, p) > 1
), starts AS (
  SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM later
), spans AS (
  SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM starts) GROUP BY doc_id, span
), edges AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS after FROM spans
), cut AS (
  SELECT e.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
    string_agg(substr(x, 2 * after + 1, 2 * (a - after)), '' ORDER BY a) AS head, max(b) AS tail
  FROM edges e JOIN docs USING (doc_id) GROUP BY e.doc_id
)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM docs d LEFT JOIN cut c USING (doc_id)"""


_COLLOCATIONS = r"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), cut AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(ws)) AS HUGEINT) AS n FROM cut GROUP BY lang
), grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase
  FROM cut, (VALUES (1), (2), (3), (4), (5)) AS t(size) WHERE len(ws) >= size
), f AS (
  SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL
), candidates AS (
  SELECT lang, size, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE size > 1 AND f >= 100
), inner_phrases AS (
  SELECT lang, a, array_to_string(ws[i:i + short - 1], ' ') AS phrase
  FROM candidates, (VALUES (2), (3), (4)) AS s(short), (VALUES (1), (2), (3), (4)) AS p(i)
  WHERE short < size AND i + short - 1 <= size
), inside AS (
  SELECT lang, phrase, max(a) AS longer FROM inner_phrases GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail
  FROM candidates c LEFT JOIN inside USING (lang, phrase), (VALUES (1), (2), (3), (4)) AS t(k)
  WHERE k < size AND (longer IS NULL OR 100 * longer < 100 * a)
), scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n, k, (1000 * CAST(c.a AS HUGEINT) * n) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = tail JOIN totals t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM lowest QUALIFY rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {"op2_repeats": _REPEATS, "op6_quality_rules": _quality(), "op11_collocations": _COLLOCATIONS}
