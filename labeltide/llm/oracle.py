"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations

from labeltide.llm import quality_rules as rules

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def quality_rules_cte(documents: str) -> str:
    """CTEs up to ``judged``: (row columns of ``documents``, rn, counts, base_failed, kept)."""
    rate = {"symbol_rate": "n_symbols / greatest(word_chars, 1)", "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
            "repeat_rate": "n_repeat_words / greatest(n_words, 1)"}
    tries = " UNION ALL ".join(
        f"SELECT lang, '{r}' AS rule, {i} AS step, CAST({c} AS DOUBLE) AS cut, count(*) AS n, count(*) FILTER (WHERE {rate[r]} > {c}) AS k FROM good GROUP BY lang"
        for r, cuts in rules.RULES.items() for i, c in enumerate(cuts))
    p = f"(CAST({rules.ALPHA} AS DOUBLE) / {len(rules.RULES)})"
    broken = " OR ".join(
        f"coalesce({rate[r]} > (SELECT c.cut FROM cuts c WHERE c.lang IS NOT DISTINCT FROM m.lang AND c.rule = '{r}'), false)"
        for r in rules.RULES)
    return f"""
rows AS (SELECT row_number() OVER () AS rn, * FROM {documents}),
split AS (SELECT *, {_WORDS} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM rows),
grams AS (SELECT rn, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT rn, w, unnest(range(1, len(w) - 3)) AS i FROM split WHERE len(w) >= 5)),
twice AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS c FROM grams) WHERE c > 1),
cover AS (SELECT rn, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest(range(0, 5)) AS o) GROUP BY rn),
measured AS (SELECT split.* EXCLUDE (w, l), CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words FROM split LEFT JOIN cover USING (rn)),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured),
good AS (SELECT * FROM based WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
tries AS ({tries}),
lev AS (SELECT CAST({rules.DELTA} AS DOUBLE) / (count(DISTINCT coalesce(lang, chr(0))) * {len(rules.RULES)}) AS level FROM good),
tails AS (SELECT lang, rule, step, cut, CASE WHEN k >= n * {p} THEN 1.0 ELSE
  (SELECT sum(exp((CASE WHEN j = 0 OR j = n THEN 0 ELSE lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) END) + j * ln({p}) + (n - j) * ln(1 - {p})))
   FROM (SELECT unnest(range(0, k + 1)) AS j)) END AS tail FROM tries),
runs AS (SELECT lang, rule, cut, step, max(CASE WHEN tail <= level THEN 0 ELSE 1 END) OVER (PARTITION BY lang, rule ORDER BY step) AS failed FROM tails, lev),
cuts AS (SELECT lang, rule, arg_max(cut, step) AS cut FROM runs WHERE failed = 0 GROUP BY lang, rule),
judged AS (SELECT *, NOT base_failed AND NOT ({broken}) AS kept FROM based m)"""


OP8 = f"""WITH {quality_rules_cte('documents')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"""


def mixing_cte(rows: str, seed: int = 1) -> str:
    """CTEs (after WITH RECURSIVE) up to ``mixed``: (columns of ``rows``, size, source_size, target, copies, taken)."""
    return f"""
sized AS (SELECT *, CAST(len({_WORDS}) AS BIGINT) AS size FROM {rows}),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM totals),
placed AS (SELECT *, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS place FROM weighed),
stepped AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM placed),
targets AS (SELECT source, source_size, CASE WHEN level * w >= source_size * 3 THEN CAST(source_size * 3 AS DOUBLE)
  ELSE w * (SELECT arg_min(level, place) FROM stepped WHERE level * w < source_size * 3) END AS target FROM stepped),
measured AS (SELECT source, size, CAST(floor(sqrt(size)) AS BIGINT) AS z, CAST(count(*) * size AS BIGINT) AS words FROM sized WHERE size > 0 GROUP BY source, size),
held AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
  sum(z * words) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM measured),
solved AS (SELECT h.source, h.size, h.z, (t.target - CAST(h.held AS BIGINT) * 3) / CAST(h.open AS BIGINT) AS factor
  FROM held h JOIN targets t ON h.source IS NOT DISTINCT FROM t.source WHERE t.target < t.source_size * 3),
factors AS (SELECT source, arg_max(factor, size) AS factor FROM solved WHERE factor * z <= 3 GROUP BY source),
hoped AS (SELECT s.*, t.source_size, t.target,
  CASE WHEN s.size = 0 THEN 0.0::DOUBLE WHEN f.factor IS NULL THEN 3.0::DOUBLE ELSE least(f.factor * CAST(floor(sqrt(s.size)) AS BIGINT), 3.0::DOUBLE) END AS e
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN factors f ON s.source IS NOT DISTINCT FROM f.source),
drawn AS (SELECT *, row_number() OVER () AS rn, CAST(floor(e) AS BIGINT) AS whole, e - floor(e) AS chance,
  (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{seed}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE AS u FROM hoped),
odds AS (SELECT *, CASE WHEN chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS q FROM drawn),
lined AS (SELECT source, rn, size, row_number() OVER (PARTITION BY source ORDER BY q / (1 + q), doc_id NULLS FIRST, size, rn) AS k FROM odds WHERE chance > 0),
rests AS (SELECT source, any_value(target) - CAST(sum(whole * size) AS BIGINT) AS rest FROM odds GROUP BY source),
walk AS (SELECT source, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS rn, false AS took, rest AS left_ FROM rests
  UNION ALL SELECT l.source, l.k, l.rn, l.size <= w.left_, CASE WHEN l.size <= w.left_ THEN w.left_ - l.size ELSE w.left_ END
  FROM walk w JOIN lined l ON l.source IS NOT DISTINCT FROM w.source AND l.k = w.k + 1),
mixed AS (SELECT o.* EXCLUDE (rn), o.whole + CASE WHEN w.took THEN 1 ELSE 0 END AS copies FROM odds o LEFT JOIN walk w ON w.rn = o.rn)"""


OP6 = f"""WITH RECURSIVE {mixing_cte('documents')}
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken FROM mixed"""


OP2 = """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
h AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS head FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN head IS NULL OR page_id IS NOT DISTINCT FROM head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN head IS NULL OR page_id IS NOT DISTINCT FROM head THEN NULL ELSE head END AS refers_to FROM h"""


OP12 = r"""WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT d, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs),
split AS (SELECT row_number() OVER () AS s, lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, CAST(len(w) - size + 2 AS BIGINT))) AS i FROM split, (SELECT unnest([1, 2, 3]) AS size) WHERE len(w) >= size)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE size > 1 AND f >= 10),
cuts AS (SELECT c.*, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:size], ' ') AS y
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cand) c),
scores AS (SELECT c.lang, c.size, c.phrase, c.w, c.a, c.k, l.f AS l, r.f AS r,
  CAST((1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.x JOIN f r ON r.lang = c.lang AND r.phrase = c.y),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM cand WHERE size = 3),
longer AS (SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.most IS NULL OR 100 * g.most < 50 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT kept.*, n.n, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept JOIN n ON n.lang = kept.lang)
WHERE rank <= 2000"""
