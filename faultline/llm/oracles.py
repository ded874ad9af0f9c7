"""SQL for DuckDB that gives the rows of those queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import lm_score, mixing, quality_rules, secret_scan, substring

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = f"translate(coalesce(text, ''), '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"


def op1() -> str:
    """Base measures, and the scores by CRC-32 buckets; the table of CRC-32 is made by its rule."""
    b, thr = quality_rules.BUCKETS, quality_rules.THRESHOLD_MICRO
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS trusted FROM documents),
x AS (SELECT rid, trusted, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
vocabulary AS (SELECT DISTINCT word, hex(word) AS h FROM x),
octets AS (SELECT word, list_transform(range(length(h) // 2), lambda i: (16 * (instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1)::BIGINT) AS o FROM vocabulary),
codes AS (SELECT word, xor(list_reduce(o, lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS code FROM octets, crc_table),
coded AS (SELECT rid, trusted, pos, code, lead(code) OVER (PARTITION BY rid ORDER BY pos) AS following FROM x JOIN codes USING (word)),
grams AS (SELECT rid, trusted, code & {b - 1} AS bucket FROM coded UNION ALL SELECT rid, trusted, ((code * 65599 + following * 40503) >> 9) & {b - 1} FROM coded WHERE following IS NOT NULL),
counts AS (SELECT bucket, count(*) AS raw, count(*) FILTER (trusted) AS target FROM grams GROUP BY bucket),
sums AS (SELECT sum(raw)::DOUBLE AS n_raw, sum(target)::DOUBLE AS n_target FROM counts),
weights AS (SELECT bucket, CASE WHEN n_target > 0 THEN round(1e6::DOUBLE * (ln((target + 1.0::DOUBLE) / (n_target + {float(b)}::DOUBLE)) - ln((raw + n_raw / n_target) / (n_raw + n_raw / n_target * {float(b)}::DOUBLE))))::BIGINT ELSE 0 END AS value FROM counts, sums),
scores AS (SELECT rid, count(*) AS n_grams, sum(value)::BIGINT AS score_micro FROM grams JOIN weights USING (bucket) GROUP BY rid),
windows AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS five FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, five) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS place FROM twice) GROUP BY rid),
m AS (SELECT rid, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '{quality_rules.SYMBOLS}')) AS n_symbols,
  len(list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')))) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM d LEFT JOIN repeats r USING (rid)),
f AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(score_micro, 0) >= {thr} * coalesce(n_grams, 0) AS kept, coalesce(n_grams, 0) AS n_grams, coalesce(score_micro, 0) AS score_micro FROM f LEFT JOIN scores USING (rid)"""


#: All pairs that share a shingle, then the closure of the links.
OP4 = rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
shingles AS (SELECT DISTINCT rid, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i FROM d)),
sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
shared AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.rid JOIN sizes y ON b = y.rid WHERE 100 * c >= 85 * (x.n + y.n - c)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(rid, low) AS (SELECT rid, doc_id FROM d UNION SELECT b, low FROM reach JOIN ends ON rid = a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(doc_id = component_id, doc_id IS NULL AND component_id IS NULL) AS kept FROM d JOIN (SELECT rid, min(low) AS component_id FROM reach GROUP BY rid) USING (rid) LEFT JOIN sizes USING (rid)"""

OP6 = """WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.rid AS a, b.rid AS b FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.rid <> b.rid WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach(rid, low) AS (SELECT rid, vec_id FROM v UNION SELECT b, low FROM reach JOIN links ON rid = a),
n AS (SELECT a AS rid, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, vec_id IS NULL AND component_id IS NULL) AS kept FROM v JOIN (SELECT rid, min(low) AS component_id FROM reach GROUP BY rid) USING (rid) LEFT JOIN n USING (rid)"""


def op7() -> str:
    b, u, f = lm_score.BIGRAM, lm_score.UNIGRAM, lm_score.FLOOR

    def ln(m: str, held: str) -> str:
        total = f"({m}_words - {held} * n_doc)"
        share = f"CASE WHEN {total} > 0 THEN (w_{m} - {held} * w_own)::DOUBLE / {total} ELSE 1.0::DOUBLE / v END"
        pair = f"CASE WHEN h IS NOT NULL AND h_{m} - {held} * h_own > 0 THEN (p_{m} - {held} * p_own)::DOUBLE / (h_{m} - {held} * h_own) ELSE {share} END"
        return f"ln({b}::DOUBLE * ({pair}) + {u}::DOUBLE * ({share}) + {f}::DOUBLE / v)"

    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false)::INT AS aim FROM documents),
x AS (SELECT rid, aim, len(ws) AS n_doc, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM d),
y AS (SELECT *, lag(w) OVER (PARTITION BY rid ORDER BY pos) AS h FROM x),
words AS (SELECT w, count(*) AS b, sum(aim) AS t FROM y GROUP BY w), pairs AS (SELECT h, w, count(*) AS b, sum(aim) AS t FROM y WHERE h IS NOT NULL GROUP BY ALL),
own_words AS (SELECT rid, w, count(*) AS n FROM y GROUP BY ALL), own_pairs AS (SELECT rid, h, w, count(*) AS n FROM y WHERE h IS NOT NULL GROUP BY ALL),
sums AS (SELECT sum(b) AS b_words, sum(t) AS t_words, count(*) AS v FROM words),
z AS (SELECT y.*, b_words, t_words, v, cw.b AS w_b, cw.t AS w_t, ow.n AS w_own, ch.b AS h_b, ch.t AS h_t, oh.n AS h_own, cp.b AS p_b, cp.t AS p_t, op.n AS p_own FROM y CROSS JOIN sums JOIN words cw ON cw.w = y.w JOIN own_words ow ON ow.rid = y.rid AND ow.w = y.w
  LEFT JOIN words ch ON ch.w = y.h LEFT JOIN own_words oh ON oh.rid = y.rid AND oh.w = y.h LEFT JOIN pairs cp ON cp.h = y.h AND cp.w = y.w LEFT JOIN own_pairs op ON op.rid = y.rid AND op.h = y.h AND op.w = y.w),
scores AS (SELECT rid, CASE WHEN any_value(t_words) > 0 THEN avg({ln("t", "aim")} - {ln("b", "1")}) ELSE 0 END AS score FROM z GROUP BY rid)
SELECT doc_id, len(ws) AS n_tokens, round(coalesce(score, 0), 9) AS score FROM d LEFT JOIN scores USING (rid)"""


def op9() -> str:
    """Spans by splitting at the matches; a value lives if one source alone holds it."""
    each = []
    for k, (_, pattern, group, least) in enumerate((*secret_scan.BASE, *secret_scan.EXTRA)):
        q = pattern.replace("'", "''")
        each.append(f"""SELECT rid, {k} AS k, unnest(list_zip(regexp_split_to_array(text, '{q}')[:len(regexp_extract_all(text, '{q}'))], regexp_extract_all(text, '({q})', 1), regexp_extract_all(text, '{q}', {group}))) AS z, generate_subscripts(regexp_extract_all(text, '{q}'), 1) AS i, {least} AS least FROM d""")
    names = ", ".join(f"'{k}'" for k in secret_scan.KINDS)
    joined = f"coalesce(string_agg(list_extract([{names}], k + 1) || ':' || s || ':' || e, ',' ORDER BY s, k, e)"
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner FROM documents),
found AS ({" UNION ALL ".join(each)}),
placed AS (SELECT rid, k, z[3] AS v, least, (sum(length(z[1]) + length(z[2])) OVER (PARTITION BY rid, k ORDER BY i))::BIGINT AS e, length(z[2]) AS n FROM found),
spans AS (SELECT rid, k, e - n AS s, e, v FROM placed WHERE length(v) >= least),
chosen AS (SELECT * FROM spans WHERE k < 3 UNION ALL SELECT x.* FROM spans x WHERE k >= 3 AND (k = 3 OR (regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]'))) AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.rid = x.rid AND b.k < 3 AND b.s < x.e AND x.s < b.e)),
known AS (SELECT v, count(DISTINCT owner) <= {secret_scan.MAX_OWNERS} AS live FROM chosen JOIN d USING (rid) GROUP BY v),
g AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, {joined} FILTER (k < 3), '') AS base, {joined} FILTER (k < 3 OR live), '') AS spans, count(DISTINCT v) FILTER (live) AS n_live, count(DISTINCT v) FILTER (NOT live) AS n_example FROM chosen JOIN known USING (v) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN g USING (rid)"""


def op10() -> str:
    digits = mixing.BLOCK_DIGITS
    return rf"""WITH RECURSIVE t AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS n_tokens, md5(concat(coalesce(doc_id::VARCHAR, ''), '|', md5(coalesce(text, '')))) AS key FROM documents),
totals AS (SELECT source, sum(n_tokens)::BIGINT AS total FROM t GROUP BY source),
ends AS (SELECT max(ln(total::DOUBLE)) AS top, min(ln(total::DOUBLE)) AS low FROM totals WHERE total > 0),
halved(lo, hi, i) AS (SELECT 0::DOUBLE, 1::DOUBLE, 0 UNION ALL SELECT CASE WHEN exp((top - low) * (1 - (lo + hi) / 2)) <= {mixing.MAX_REPEATS}::DOUBLE THEN lo ELSE (lo + hi) / 2 END, CASE WHEN exp((top - low) * (1 - (lo + hi) / 2)) <= {mixing.MAX_REPEATS}::DOUBLE THEN (lo + hi) / 2 ELSE hi END, i + 1 FROM halved, ends WHERE i < {mixing.HALVINGS}),
chosen AS (SELECT top, CASE WHEN exp(top - low) <= {mixing.MAX_REPEATS}::DOUBLE THEN 0::DOUBLE ELSE (SELECT hi FROM halved WHERE i = {mixing.HALVINGS}) END AS a FROM ends),
quotas AS (SELECT source, total, CASE WHEN total > 0 THEN round(exp((top - ln(total::DOUBLE)) * (1 - a)) * total)::BIGINT ELSE 0 END AS quota FROM totals, chosen),
passes AS (SELECT source, CASE WHEN total > 0 THEN quota // total ELSE 1 END AS whole, CASE WHEN total > 0 THEN quota % total ELSE 0 END AS rest FROM quotas),
ordered AS (SELECT t.*, whole, rest, coalesce(sum(n_tokens) OVER (PARTITION BY t.source ORDER BY md5(concat_ws('|', 'block', whole, substr(key, 1, {digits}))), md5(concat_ws('|', 'row', whole, key)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM t JOIN passes p ON t.source IS NOT DISTINCT FROM p.source),
drawn AS (SELECT *, unnest(range(0, whole + CASE WHEN start < rest THEN 1 ELSE 0 END)) AS epoch FROM ordered)
SELECT doc_id, source, n_tokens, epoch, md5(concat_ws('|', 'block', epoch, substr(key, 1, {digits}))) AS block_key, md5(concat_ws('|', 'row', epoch, key)) AS row_key FROM drawn"""


def op11() -> str:
    """Every window by the text of its words."""
    n = substring.WINDOW
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
windows AS (SELECT rid, doc_id, i, md5(array_to_string(w[i:i + {n - 1}], ' ')) AS k FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d WHERE doc_id IS NOT NULL)),
lows AS (SELECT k, min(doc_id) AS low FROM windows GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + {n})) AS pos FROM windows JOIN lows USING (k) WHERE doc_id > low),
x AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS t FROM x ANTI JOIN gone USING (rid, pos) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)"""


#: All scores of anchors; every comparison in whole numbers.
OP13 = """WITH good AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (SELECT a.rid AS a, a.vec_id AS anchor_id, b.rid AS b, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2]))::BIGINT AS score FROM good a JOIN good b ON a.vec_id % 100 = 0 AND len(a.x) = len(b.x) AND a.rid <> b.rid),
positives AS (SELECT a, b, anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id, b) <= 5),
fitting AS (SELECT p.*, n.id AS negative_id, n.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id, n.b) AS rank FROM positives p JOIN scored n ON p.a = n.a AND NOT n.same AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM fitting WHERE rank <= 10"""

ORACLES = {"op1_quality_rules": op1(), "op4_minhash_near_dedup": OP4, "op6_lattice_near_dedup": OP6, "op7_lm_score": op7(), "op9_secret_scan": op9(), "op10_mixing": op10(), "op11_substring_dedup": op11(), "op13_hard_negatives": OP13}
