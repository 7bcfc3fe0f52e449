"""DuckDB SQL with the results of those queries that SQL can express."""

from __future__ import annotations

# Pieces the texts below share. Words are runs of characters other than space and \x09-\x0D.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_GRAM = "array_to_string(list_slice(w, CAST(i AS BIGINT), CAST(i + k - 1 AS BIGINT)), ' ')"


def _shingles(name: str, key: str, source: str, k: int) -> str:
    """Views name_w (key, words) and name (key, k, gram): distinct shingles, or all words where there are fewer."""
    words = _WORDS.format(_LOWER.format("coalesce(text, '')"))
    return f"""{name}_w AS (SELECT {key} AS id, {words} AS w FROM {source}),
{name}_i AS (SELECT id, w, least({k}, len(w)) AS k, unnest(range(1, greatest(len(w) - {k} + 1, least(len(w), 1)) + 1)) AS i FROM {name}_w),
{name} AS (SELECT DISTINCT id, k, {_GRAM} AS gram FROM {name}_i)"""


def contamination(words: int = 5) -> str:
    return f"""WITH {_shingles('d', 'doc_id', 'documents', words)},
{_shingles('b', 'item_id', 'benchmark', words)},
short AS (SELECT DISTINCT d_w.id, s.k, array_to_string(list_slice(w, CAST(i AS BIGINT), CAST(i + s.k - 1 AS BIGINT)), ' ') AS gram
  FROM d_w, (SELECT DISTINCT k FROM b WHERE k < {words}) s, unnest(range(1, len(w) - s.k + 2)) t(i) WHERE len(w) >= s.k),
grams AS (SELECT id, k, gram FROM d UNION SELECT id, k, gram FROM short),
items AS (SELECT id, count(*) AS n_item FROM b GROUP BY id)
SELECT grams.id AS doc_id, b.id AS item_id, count(*) AS n_common, any_value(n_item) AS n_item
FROM b JOIN items USING (id) JOIN grams ON grams.gram = b.gram AND grams.k = b.k
GROUP BY grams.id, b.id HAVING 10 * count(*) >= 8 * any_value(n_item)"""


def mixing(temperature: float, largest: float, seed: str = "mix") -> str:
    return f"""WITH size AS (SELECT source AS s, CAST(coalesce(sum(length(text)), 0) AS DOUBLE) AS chars FROM documents GROUP BY source),
total AS (SELECT sum(chars) AS all_chars, sum(pow(chars, {temperature})) AS all_weight FROM size),
whole AS (SELECT s, CASE WHEN chars = 0 THEN 1.0 ELSE pow(chars, {temperature}) / all_weight * all_chars / chars END AS rate FROM size, total),
rate AS (SELECT s, CAST(greatest(ceil(rate / {largest}), 1) AS BIGINT) AS parts, rate / greatest(ceil(rate / {largest}), 1) AS rate FROM whole),
k AS (SELECT s, rate, unnest(range(0, CAST(ceil(rate + 9 * sqrt(rate) + 20) AS BIGINT) + 1)) AS k FROM rate),
steps AS (SELECT s, k, sum(exp(-rate + k * ln(greatest(rate, 1e-300)) - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS c FROM k),
part AS (SELECT doc_id, source, text, coalesce(CAST(doc_id AS VARCHAR), '') AS name, unnest(range(0, parts)) AS i FROM documents JOIN rate ON source IS NOT DISTINCT FROM s),
drawn AS (SELECT *, CAST('0x' || substr(sha256('{seed}|' || CASE WHEN i > 0 THEN 'part|' || name || '|' || i ELSE name END), 1, 13) AS BIGINT) / pow(2, 52) AS u FROM part),
many AS (SELECT doc_id, source, text, count(*) AS n FROM drawn JOIN steps ON source IS NOT DISTINCT FROM s AND c <= u GROUP BY doc_id, source, text)
SELECT doc_id, CAST(unnest(range(0, n)) AS INTEGER) AS copy, source, text FROM many"""


def quality() -> str:
    words = _WORDS.format("t")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS (SELECT doc_id, t, {words} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, CAST(i AS BIGINT), CAST(i + 7 AS BIGINT)), ' ') AS g FROM base, unnest(range(1, len(w) - 6)) u(i) WHERE len(w) >= 8),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(0, 8) r(j) GROUP BY doc_id),
m AS (SELECT base.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(lines) AS n_lines, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters FROM base LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 10 * n_stutters > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * capitals > 4 * letters) AS kept FROM f"""


def near_duplicates(words: int) -> str:
    return f"""WITH RECURSIVE {_shingles('d', 'doc_id', 'documents', words)},
n AS (SELECT id, count(*) AS n FROM d GROUP BY id),
sets AS (SELECT id, sha256(string_agg(gram, chr(10) ORDER BY gram)) AS h FROM d GROUP BY id),
class AS (SELECT id, min(id) OVER (PARTITION BY h) AS rep FROM sets),
r AS (SELECT d.id, gram, n FROM d JOIN class USING (id) JOIN n USING (id) WHERE d.id = rep),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY many, gram) AS place FROM (SELECT *, count(*) OVER (PARTITION BY gram) AS many FROM r)),
prefix AS (SELECT * FROM ranked WHERE place <= n - CAST(ceil(0.8 * n) AS BIGINT) + 1),
candidate AS (SELECT DISTINCT a.id AS a, b.id AS b, a.n AS na, b.n AS nb FROM prefix a JOIN prefix b ON a.gram = b.gram AND a.id < b.id AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)),
link AS (SELECT a, b FROM candidate JOIN r x ON x.id = a JOIN r y ON y.id = b AND x.gram = y.gram GROUP BY a, b HAVING 100 * count(*) >= 80 * (any_value(na) + any_value(nb) - count(*))),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS id, a AS other FROM edge UNION SELECT reach.id, edge.b FROM reach JOIN edge ON reach.other = edge.a),
part AS (SELECT id, min(other) AS least FROM reach GROUP BY id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(part.least, class.rep, doc_id) AS component_id, coalesce(part.least, class.rep, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n ON n.id = doc_id LEFT JOIN class ON class.id = doc_id LEFT JOIN part ON part.id = class.rep"""


def hard_negatives() -> str:
    """All scores of the anchors, ranked by window functions."""
    return """
    WITH rows AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS alike, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
        FROM rows a JOIN rows r ON a.vec_id <> r.vec_id AND len(a.v) = len(r.v) WHERE a.vec_id % 100 = 0),
    positives AS (
        SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE alike
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT p.anchor_id, p.positive_id,
           CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
           n.id AS negative_id, p.positive_score, n.score AS negative_score
    FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.alike
         AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
    QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) <= 5"""
