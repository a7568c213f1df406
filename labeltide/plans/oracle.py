"""DuckDB statements equivalent to the registered queries.

Written independently of the Spark code: plain global windows, ordered list
aggregates and the cleaning chain as fourteen separate ``regexp_replace``
calls with RE2 patterns.  Tables are the driver's pre-registered views.
"""

from __future__ import annotations

from .catalog import (BATCH_SIZE, DOC_BATCH, HOLDOUT_FRAC, LOGIT_CLASSES, MAX_TOKENS,
                      SHUFFLE_SEED, STRATIFIED_FRAC)

WS = r"\t\n\x0b\x0c\r\x1c-\x1f \x85\p{Z}"

# One (pattern, replacement) per cleaning step, in RE2 spelling.
_STEPS = {
    "emails": (r"[a-zA-Z0-9_.-]+@[a-zA-Z0-9_.-]+", ""),
    "ipv4": (r"((25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)(\.|$)){4}", ""),
    "http": (r"http[^" + WS + r"]+", ""),
    "www": (r"www[^" + WS + r"]+", ""),
    "special": (r"[#,@&<>/\-]", ""),
    "symbols": (r"[^\p{L}\p{N}_" + WS + r"#@/:%.,\-]", ""),
    "open_bracket": (r"\[", ""),
    "close_bracket": (r"\]", ""),
    "newlines": (r"\n", " "),
    "tabs": (r"\t", " "),
    "spaces": (r" {2,}", " "),
    "strip": (r"\A[" + WS + r"]+|[" + WS + r"]+\z", ""),
    "digits": (r"\p{Nd}", ""),
}
_ORDER = ["emails", "ipv4", "http", "www", "special", "symbols", "open_bracket",
          "close_bracket", "newlines", "tabs", "spaces", "lower", "strip", "digits"]


def step(name: str, expr: str) -> str:
    if name == "lower":
        return f"lower({expr})"
    pat, rep = _STEPS[name]
    return f"regexp_replace({expr}, '{pat}', '{rep}', 'g')"


def clean(expr: str) -> str:
    for name in _ORDER:
        expr = step(name, expr)
    return expr


def toks(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, '[{WS}]+'), lambda x: x <> '')"


TOXIC = "CASE WHEN toxic = 1 THEN 'HOF' ELSE 'NOT' END"
DOCS_CLEAN = f"SELECT doc_id, {clean('text')} AS text FROM documents"
IP = ("CAST(doc_id & 255 AS VARCHAR) || '.' || CAST((doc_id >> 8) & 255 AS VARCHAR) || '.0.1'")
IP_TEXT = f"'ip ' || {IP} || ' and 999.' || {IP} || '. ' || text"
URL_TEXT = ("'see ' || url || ' www.' || CAST(page_id AS VARCHAR) || '.org awwwesome http'")
ARGMAX_ALL = "CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER)"


def logits(k: int) -> str:
    """Sums over every k-th value, added in order as the query adds them."""
    return (f"list_transform(range({k}), lambda c: list_reduce(list_prepend(0.0::DOUBLE, "
            f"list_transform(list_filter(range(len(embedding)), lambda i: i % {k} = c), lambda i: embedding[i + 1]::DOUBLE)), lambda t, x: t + x))")


def argmax_first(k: int) -> str:
    return f"CAST(list_position({logits(k)}, list_max({logits(k)})) - 1 AS INTEGER)"


SCORED = (f"SELECT vec_id, CAST(label AS VARCHAR) AS label, "
          f"CASE WHEN length(CAST({ARGMAX_ALL} AS VARCHAR)) <> 1 THEN '0' "
          f"ELSE CAST({ARGMAX_ALL} AS VARCHAR) END AS prediction FROM embeddings")
CONF = (f"SELECT label, prediction, count(*)::BIGINT AS n FROM ({SCORED}) "
        f"GROUP BY label, prediction")
STATS = f"""
  SELECT class, sum(support)::BIGINT AS support, sum(predicted)::BIGINT AS predicted,
         sum(tp)::BIGINT AS tp,
         CASE WHEN sum(support) + sum(predicted) > 0
              THEN 2.0 * sum(tp) / (sum(support) + sum(predicted)) ELSE 0.0 END AS f1
  FROM (SELECT label AS class, n AS support, 0 AS predicted,
               CASE WHEN label = prediction THEN n ELSE 0 END AS tp FROM ({CONF})
        UNION ALL
        SELECT prediction AS class, 0 AS support, n AS predicted, 0 AS tp FROM ({CONF}))
  GROUP BY class"""
VOCAB = f"""
  SELECT token, CAST(row_number() OVER (ORDER BY cnt DESC, token) + 1 AS INTEGER) AS token_id,
         cnt AS count
  FROM (SELECT token, count(*)::BIGINT AS cnt
        FROM (SELECT unnest({toks('text')}) AS token FROM ({DOCS_CLEAN}))
        GROUP BY token)"""
LEXICON = (f"SELECT DISTINCT unnest({toks(clean('text'))}) AS token FROM benchmark")
DOC_TOKS = f"SELECT doc_id, {toks('text')} AS toks FROM ({DOCS_CLEAN})"
EVENT_DICT = """
  SELECT event_type AS label,
         CAST(row_number() OVER (ORDER BY min(event_id)) - 1 AS INTEGER) AS label_id
  FROM events {where} GROUP BY event_type"""
NULL_TOKENS = ("'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', "
               "'1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', "
               "'nan', 'null'")


def nulltok(c: str) -> str:
    return f"CASE WHEN {c} IN ({NULL_TOKENS}) THEN NULL ELSE {c} END"


ORACLE: dict[str, str] = {}

ORACLE["class_distribution"] = f"""
  WITH c AS ({DOCS_CLEAN}),
       f AS (SELECT text, min(doc_id) AS doc_id FROM c GROUP BY text)
  SELECT {TOXIC} AS label, count(*)::BIGINT AS n
  FROM f JOIN labels USING (doc_id) GROUP BY 1"""

ORACLE["clean_text"] = DOCS_CLEAN

for _name, _src in [("emails", "documents"), ("ipv4", "ip"), ("http", "url"), ("www", "url"),
                    ("special", "documents"), ("symbols", "documents"),
                    ("open_bracket", "documents"), ("close_bracket", "documents"),
                    ("newlines", "documents"), ("tabs", "documents"), ("spaces", "documents"),
                    ("lower", "documents"), ("strip", "documents"), ("digits", "documents")]:
    if _src == "ip":
        _from = f"(SELECT doc_id, {IP_TEXT} AS text FROM documents)"
    elif _src == "url":
        _from = f"(SELECT page_id AS doc_id, {URL_TEXT} AS text FROM pages)"
    else:
        _from = "documents"
    ORACLE[f"clean_{_name}"] = f"SELECT doc_id, {step(_name, 'text')} AS text FROM {_from}"

ORACLE["add_prefix"] = f"SELECT doc_id, 'classification: ' || text AS text FROM ({DOCS_CLEAN})"

ORACLE["to_string"] = ("SELECT doc_id, CAST(quality AS VARCHAR) AS quality, "
                       "CAST(toxic AS VARCHAR) AS toxic FROM labels")

ORACLE["forward_fill"] = """
  SELECT d.doc_id,
    last_value(l.quality IGNORE NULLS) OVER (ORDER BY d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS quality,
    last_value(l.toxic IGNORE NULLS) OVER (ORDER BY d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

ORACLE["dedup_rows"] = ("SELECT min(doc_id) AS row_ord, text, lang, source, n_chars FROM documents "
                        "GROUP BY text, lang, source, n_chars")

ORACLE["dedup_text"] = f"""
  SELECT doc_id, text, lang FROM (
    SELECT doc_id, {clean('text')} AS text, lang,
           row_number() OVER (PARTITION BY {clean('text')} ORDER BY doc_id) AS rn
    FROM documents) WHERE rn = 1"""

ORACLE["drop_null_rows"] = """
  SELECT d.doc_id, d.lang, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  WHERE d.lang IS NOT NULL AND l.quality IS NOT NULL AND l.toxic IS NOT NULL AND d.doc_id IS NOT NULL"""

ORACLE["union_datasets"] = """
  SELECT doc_id, text, lang, 'documents' AS source, 0 AS source_rank FROM documents
  UNION ALL
  SELECT item_id AS doc_id, text, NULL AS lang, 'benchmark' AS source, 1 AS source_rank FROM benchmark"""

ORACLE["holdout_split"] = f"""
  SELECT *,
    CASE WHEN row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)))
              <= ceil(count(*) OVER () * {HOLDOUT_FRAC}) THEN 'dev' ELSE 'train' END AS split
  FROM documents"""

ORACLE["stratified_split_nulls"] = f"""
  SELECT doc_id, lang, quality, toxic,
    CASE WHEN row_number() OVER (PARTITION BY toxic ORDER BY md5(CAST(doc_id AS VARCHAR)))
              <= ceil(count(*) OVER (PARTITION BY toxic) * {STRATIFIED_FRAC})
         THEN 'dev' ELSE 'train' END AS split
  FROM documents LEFT JOIN labels USING (doc_id)"""

ORACLE["stratified_split"] = f"""
  SELECT doc_id, toxic,
    CASE WHEN row_number() OVER (PARTITION BY toxic ORDER BY md5(CAST(doc_id AS VARCHAR)))
              <= ceil(count(*) OVER (PARTITION BY toxic) * {STRATIFIED_FRAC})
         THEN 'dev' ELSE 'train' END AS split
  FROM documents JOIN labels USING (doc_id)"""

ORACLE["value_counts"] = ("SELECT event_type, count(*)::BIGINT AS count FROM events "
                          "WHERE event_type IS NOT NULL GROUP BY event_type")

ORACLE["row_counts"] = f"""
  SELECT (SELECT count(*) FROM documents)::BIGINT AS rows_before,
         (SELECT count(DISTINCT {clean('text')}) + max(CASE WHEN text IS NULL THEN 1 ELSE 0 END)
          FROM documents)::BIGINT AS rows_after"""

ORACLE["preview"] = "SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 5"

ORACLE["distinct_labels"] = ("SELECT event_type, min(event_id) AS first_ord FROM events "
                             "WHERE event_type IS NOT NULL GROUP BY event_type")

ORACLE["filter_update"] = f"""
  SELECT vec_id, CASE WHEN {argmax_first(3)} = 0 THEN 'HOF'
                      WHEN {argmax_first(3)} = 1 THEN 'NOT' ELSE '' END AS prediction
  FROM embeddings"""

ORACLE["align_by_id"] = ("SELECT d.doc_id, d.lang, l.quality, l.toxic "
                         "FROM documents d JOIN labels l ON d.doc_id = l.doc_id")

ORACLE["unmatched"] = """
  SELECT doc_id, 'prediction' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
  UNION ALL
  SELECT doc_id, 'gold' AS side FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"""

ORACLE["shuffle_order"] = (f"SELECT *, md5(CAST(doc_id AS VARCHAR) || ':{SHUFFLE_SEED}') "
                           f"AS shuffle_key FROM documents")

ORACLE["label_dictionary"] = EVENT_DICT.format(where="")

ORACLE["encode_labels"] = f"""
  WITH a AS ({EVENT_DICT.format(where="")}), d AS (SELECT * FROM a WHERE label_id < (SELECT max(label_id) FROM a))
  SELECT e.event_id, coalesce(CAST(d.label_id AS VARCHAR), e.event_type) AS label
  FROM events e LEFT JOIN d ON e.event_type = d.label"""

ORACLE["decode_labels"] = f"""
  WITH d AS ({EVENT_DICT.format(where="")})
  SELECT e.vec_id, coalesce(d.label, '') AS prediction
  FROM embeddings e LEFT JOIN d ON CAST({argmax_first(LOGIT_CLASSES)} AS VARCHAR) = CAST(d.label_id AS VARCHAR)"""

ORACLE["argmax"] = (f"SELECT vec_id, {ARGMAX_ALL} AS argmax_all, "
                    f"{argmax_first(LOGIT_CLASSES)} AS argmax_10 FROM embeddings")

ORACLE["repair_predictions"] = f"SELECT vec_id, prediction FROM ({SCORED})"

ORACLE["count_repairs"] = (f"SELECT count(*) FILTER (WHERE length(CAST({ARGMAX_ALL} AS VARCHAR)) <> 1)"
                           f"::BIGINT AS repaired FROM embeddings")

ORACLE["majority_label"] = """
  SELECT CAST(label AS VARCHAR) AS majority, count(*)::BIGINT AS count FROM embeddings
  WHERE label IS NOT NULL GROUP BY label ORDER BY count(*) DESC, CAST(label AS VARCHAR) LIMIT 1"""

ORACLE["confusion_matrix"] = CONF

ORACLE["confusion_restricted"] = f"""
  WITH g(row, col, label, prediction) AS (VALUES (0, 0, '1', '1'), (0, 1, '1', '0'),
                                                 (1, 0, '0', '1'), (1, 1, '0', '0'))
  SELECT g.row, g.col, g.label, g.prediction, coalesce(c.n, 0)::BIGINT AS n
  FROM g LEFT JOIN ({CONF}) c ON g.label = c.label AND g.prediction = c.prediction"""

ORACLE["binary_cells"] = f"""
  SELECT coalesce(sum(n) FILTER (WHERE label = '1' AND prediction = '1'), 0)::BIGINT AS tn,
         coalesce(sum(n) FILTER (WHERE label = '1' AND prediction = '0'), 0)::BIGINT AS fp,
         coalesce(sum(n) FILTER (WHERE label = '0' AND prediction = '1'), 0)::BIGINT AS fn,
         coalesce(sum(n) FILTER (WHERE label = '0' AND prediction = '0'), 0)::BIGINT AS tp
  FROM ({CONF})"""

ORACLE["f1_per_class"] = f"SELECT class, round(f1, 6) AS f1, support FROM ({STATS})"

ORACLE["classification_report"] = f"""
  SELECT round(sum(f1 * support) / sum(support), 6) AS f1_weighted,
         round(avg(f1), 6) AS f1_macro,
         round(sum(tp)::DOUBLE / sum(support), 6) AS f1_micro,
         round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy,
         round((sum(tp)::DOUBLE * sum(support) - sum(predicted::DOUBLE * support))
               / sqrt((sum(support)::DOUBLE * sum(support) - sum(predicted::DOUBLE * predicted))
                      * (sum(support)::DOUBLE * sum(support) - sum(support::DOUBLE * support))), 6) AS mcc,
         sum(support)::BIGINT AS n, count(*)::BIGINT AS n_classes
  FROM ({STATS})"""

ORACLE["accuracy"] = (f"SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) "
                      f"AS accuracy FROM ({SCORED})")

ORACLE["mean_loss"] = f"""
  WITH r AS (
    SELECT vec_id, label, {logits(LOGIT_CLASSES)} AS l,
           (row_number() OVER (ORDER BY vec_id) - 1) // {BATCH_SIZE} AS batch
    FROM embeddings),
  ce AS (
    SELECT batch, list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l)))))
                  - l[label + 1] AS ce
    FROM r)
  SELECT round(avg(b), 6) AS mean_loss, count(*)::BIGINT AS batches
  FROM (SELECT batch, avg(ce) AS b FROM ce GROUP BY batch)"""

ORACLE["best_epoch"] = """
  SELECT run, epoch AS best_epoch, val_loss AS best_loss FROM (
    SELECT user_id AS run, event_id AS epoch, value AS val_loss,
           row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rn
    FROM events WHERE value IS NOT NULL) WHERE rn = 1"""

ORACLE["vocabulary"] = VOCAB

_ENCODED = f"""
  v AS ({VOCAB}),
  d AS ({DOC_TOKS}),
  t AS (SELECT doc_id, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS pos FROM d),
  e AS (SELECT t.doc_id, list(coalesce(v.token_id, 1) ORDER BY t.pos) AS ids
        FROM t LEFT JOIN v ON t.tok = v.token GROUP BY t.doc_id)"""

ORACLE["encode_tokens"] = f"""
  WITH {_ENCODED}
  SELECT d.doc_id, array_to_string(coalesce(e.ids, []), ',') AS input_ids,
         CAST(len(coalesce(e.ids, [])) AS INTEGER) AS n_tokens
  FROM d LEFT JOIN e ON d.doc_id = e.doc_id"""

ORACLE["truncate_tokens"] = f"""
  WITH {_ENCODED},
  tr AS (SELECT d.doc_id, coalesce(e.ids[1:{MAX_TOKENS}], []) AS ids FROM d LEFT JOIN e ON d.doc_id = e.doc_id)
  SELECT doc_id, array_to_string(ids, ',') AS input_ids, CAST(len(ids) AS INTEGER) AS n_tokens FROM tr"""

ORACLE["pad_and_mask"] = f"""
  WITH {_ENCODED},
  r AS (SELECT d.doc_id, coalesce(e.ids, []) AS ids, (row_number() OVER (ORDER BY d.doc_id) - 1) // {DOC_BATCH} AS batch
        FROM d LEFT JOIN e ON d.doc_id = e.doc_id),
  w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS L FROM r)
  SELECT doc_id, batch,
         md5(array_to_string(list_concat(ids, list_transform(range(L - len(ids)), lambda x: 0)), ',')) AS ids_md5,
         CAST(L AS INTEGER) AS width, CAST(len(ids) AS INTEGER) AS n_tokens
  FROM w"""

ORACLE["assign_batches"] = (f"SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // {DOC_BATCH} "
                            f"AS batch FROM documents")

ORACLE["augment_drop"] = f"""
  WITH lex AS ({LEXICON}),
  f AS (SELECT doc_id, toks, toks[1] IN (SELECT token FROM lex) AS pf,
               toks[len(toks)] IN (SELECT token FROM lex) AS pl
        FROM ({DOC_TOKS}) WHERE len(toks) > 5)
  SELECT doc_id,
         array_to_string(toks[(CASE WHEN pf THEN 1 ELSE 2 END):(CASE WHEN pl THEN len(toks) ELSE len(toks) - 1 END)], ' ') AS text
  FROM f WHERE NOT (pf AND pl)"""

ORACLE["augment_drop_emptied"] = ORACLE["augment_drop"].replace(
    f"({DOC_TOKS})", f"(SELECT doc_id, toks FROM ({DOC_TOKS}) WHERE doc_id % 5 <> 0)")

ORACLE["augment_replace"] = f"""
  WITH lex AS ({LEXICON}), v AS ({VOCAB}),
  s AS (SELECT a.token, b.token AS substitute FROM v a JOIN v b ON b.token_id = a.token_id + 1),
  f AS (SELECT d.doc_id, d.toks,
               d.toks[1] IN (SELECT token FROM lex) AS pf,
               d.toks[len(d.toks)] IN (SELECT token FROM lex) AS pl,
               s1.substitute AS s1, s2.substitute AS s2
        FROM ({DOC_TOKS}) d
        LEFT JOIN s s1 ON s1.token = d.toks[1]
        LEFT JOIN s s2 ON s2.token = d.toks[len(d.toks)]
        WHERE len(d.toks) > 2),
  g AS (SELECT doc_id, toks,
               CASE WHEN NOT pf AND s1 IS NOT NULL THEN s1 END AS nf,
               CASE WHEN NOT pl AND s2 IS NOT NULL THEN s2 END AS nl FROM f)
  SELECT doc_id,
         array_to_string(list_concat(list_concat([coalesce(nf, toks[1])], toks[2:len(toks) - 1]),
                                     [coalesce(nl, toks[len(toks)])]), ' ') AS text
  FROM g WHERE nf IS NOT NULL OR nl IS NOT NULL"""

def _drawn(rows: str, token: str, seed: str) -> str:
    """(doc_id, token, nxt) of ``rows``: the successor with the smallest exponential key."""
    u = f"(CAST('0x' || substr(md5(CAST(r.doc_id AS VARCHAR) || ':{seed}:' || b.nxt), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE"
    return f"""SELECT r.doc_id, r.{token}, coalesce(b.nxt, r.{token}) AS nxt FROM {rows} r LEFT JOIN bg b ON b.token = r.{token}
  QUALIFY row_number() OVER (PARTITION BY r.doc_id ORDER BY -ln({u}) / b.n, b.nxt) = 1"""


ORACLE["augment_generate"] = f"""
  WITH lex AS ({LEXICON}),
  d AS ({DOC_TOKS}),
  bg AS (SELECT token, nxt, count(*) AS n FROM (SELECT toks[i] AS token, toks[i + 1] AS nxt FROM (SELECT toks, unnest(range(1, len(toks))) AS i FROM d))
         GROUP BY token, nxt QUALIFY row_number() OVER (PARTITION BY token ORDER BY count(*) DESC, nxt) <= 50),
  z AS (SELECT doc_id, toks[len(toks)] AS last FROM d WHERE len(toks) > 0),
  one AS ({_drawn('z', 'last', '1:42')}),
  two AS ({_drawn('(SELECT doc_id, nxt AS t FROM one)', 't', '2:42')})
  SELECT d.doc_id, array_to_string(list_concat(d.toks, [two.t, two.nxt]), ' ') AS text,
         CASE WHEN two.t IN (SELECT token FROM lex) OR two.nxt IN (SELECT token FROM lex) THEN 'HOF' ELSE {TOXIC} END AS label
  FROM d JOIN two ON two.doc_id = d.doc_id JOIN labels l ON d.doc_id = l.doc_id"""

ORACLE["with_augmented"] = f"""
  SELECT doc_id, text, 'base' AS source, 0 AS source_rank FROM ({DOCS_CLEAN})
  UNION ALL
  SELECT doc_id, text, 'drop' AS source, 1 AS source_rank FROM ({ORACLE['augment_drop']})"""

ORACLE["csv_roundtrip"] = f"""
  SELECT doc_id, {nulltok('lang')} AS lang, {nulltok('source')} AS source, {nulltok('text')} AS text,
         CASE WHEN row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)))
                   <= ceil(count(*) OVER () * {HOLDOUT_FRAC}) THEN 'dev' ELSE 'train' END AS split
  FROM documents"""

ORACLE["gold_roundtrip"] = ("SELECT CAST(doc_id AS VARCHAR) AS id, CAST(toxic AS VARCHAR) AS label "
                            "FROM labels")

ORACLE["tsv_headerless_roundtrip"] = (f"SELECT doc_id, {nulltok('lang')} AS keyword, "
                                      f"{nulltok('source')} AS country_code, {nulltok('text')} AS text "
                                      f"FROM documents")

ORACLE["registry_load"] = f"""
  SELECT CAST(d.doc_id AS VARCHAR) AS id, {nulltok('d.text')} AS text,
         CASE WHEN l.toxic = 1 THEN 'HOF' WHEN l.toxic IS NOT NULL THEN 'NOT' END AS label,
         '1' AS task,
         CASE WHEN row_number() OVER (ORDER BY md5(CAST(d.doc_id AS VARCHAR)))
                   <= ceil(count(*) OVER () * {HOLDOUT_FRAC}) THEN 'hasoc:dev:0' ELSE 'hasoc:train:0' END
           AS source
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

ORACLE["stream_clean"] = f"SELECT doc_id, {clean('text')} AS text FROM documents WHERE text IS NOT NULL"

ORACLE["confusion_wide"] = "SELECT label, " + ", ".join(
    f"coalesce(sum(n) FILTER (WHERE prediction = '{k}'), 0)::BIGINT AS \"{k}\"" for k in range(10)) + f" FROM ({CONF}) GROUP BY label"


def report(scored: str) -> str:
    """The summary of (label, prediction) rows; rows without a truth are left out."""
    return f"""
  SELECT round(sum(f1 * support) / sum(support), 6) AS f1_weighted, round(avg(f1), 6) AS f1_macro,
         round(sum(tp)::DOUBLE / sum(support), 6) AS f1_micro, round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy,
         round(CASE WHEN (sum(support)::DOUBLE * sum(support) - sum(predicted::DOUBLE * predicted))
                      * (sum(support)::DOUBLE * sum(support) - sum(support::DOUBLE * support)) > 0 THEN
               (sum(tp)::DOUBLE * sum(support) - sum(predicted::DOUBLE * support))
               / sqrt((sum(support)::DOUBLE * sum(support) - sum(predicted::DOUBLE * predicted))
                      * (sum(support)::DOUBLE * sum(support) - sum(support::DOUBLE * support))) ELSE 0.0 END, 6) AS mcc,
         sum(support)::BIGINT AS n, count(*)::BIGINT AS n_classes
  FROM (SELECT class, sum(s) AS support, sum(p) AS predicted, sum(t) AS tp,
               CASE WHEN sum(s) + sum(p) > 0 THEN 2.0 * sum(t) / (sum(s) + sum(p)) ELSE 0.0 END AS f1
        FROM (SELECT label AS class, 1 AS s, 0 AS p, CAST(label = prediction AS INTEGER) AS t FROM ({scored}) WHERE label IS NOT NULL
              UNION ALL SELECT prediction, 0, 1, 0 FROM ({scored}) WHERE label IS NOT NULL) GROUP BY class)"""


ORACLE["classification_report_unlabelled"] = f"""
  SELECT r.*, (SELECT count(*) FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.toxic IS NULL)::BIGINT AS unlabelled
  FROM ({report("SELECT CAST(l.toxic AS VARCHAR) AS label, CAST(d.doc_id % 2 AS VARCHAR) AS prediction FROM documents d LEFT JOIN labels l USING (doc_id)")}) r"""

ORACLE["classification_report_twelve"] = report(
    "SELECT CAST(user_id % 12 AS VARCHAR) AS label, CASE WHEN event_id % 7 = 0 THEN '0' WHEN event_id % 5 = 0 THEN '3' "
    "ELSE CAST(user_id % 12 AS VARCHAR) END AS prediction FROM events")


def naive_bayes(train: str, test: str) -> str:
    """CTEs up to ``margins`` (id, margin, pred): two-class multinomial naive Bayes, add-one smoothed, over
    ``train`` (id, label, toks, ord) applied to ``test`` (id, toks).  Id 0 pads, id 1 is unknown; both are smoothed cells."""
    return f"""
  tr AS ({train}), te AS ({test}),
  dict AS (SELECT label, row_number() OVER (ORDER BY min(ord)) - 1 AS c FROM tr GROUP BY label),
  tt AS (SELECT c, unnest(toks) AS tok FROM tr JOIN dict USING (label)),
  voc AS (SELECT tok, count(*) FILTER (WHERE c = 0) AS n0, count(*) FILTER (WHERE c = 1) AS n1 FROM tt GROUP BY tok),
  tot AS (SELECT sum(n0) + count(*) + 2 AS t0, sum(n1) + count(*) + 2 AS t1 FROM voc),
  pri AS (SELECT ln((count(*) FILTER (WHERE c = 1) + 1.0) / (count(*) + 2)) - ln((count(*) FILTER (WHERE c = 0) + 1.0) / (count(*) + 2)) AS p
          FROM tr JOIN dict USING (label)),
  w AS (SELECT tok, ln((n1 + 1.0) / t1) - ln((n0 + 1.0) / t0) AS w FROM voc, tot),
  pos AS (SELECT id, unnest(toks) AS tok FROM te),
  sums AS (SELECT id, sum(coalesce(w.w, ln(1.0 / t1) - ln(1.0 / t0))) AS s FROM pos LEFT JOIN w USING (tok), tot GROUP BY id),
  margins AS (SELECT te.id, coalesce(s, 0) + p AS margin, CASE WHEN coalesce(s, 0) + p > 0 THEN 1 ELSE 0 END AS pred
              FROM te LEFT JOIN sums USING (id), pri)"""


_NB_DOCS = f"SELECT doc_id AS id, toks FROM ({DOC_TOKS})"
ORACLE["score_batches"] = f"""
  WITH {naive_bayes(f"SELECT d.id, {TOXIC} AS label, d.toks, d.id AS ord FROM ({_NB_DOCS}) d JOIN labels l ON d.id = l.doc_id", _NB_DOCS)}
  SELECT id AS doc_id, dict.label AS prediction, round(margin, 4) AS margin FROM margins JOIN dict ON dict.c = margins.pred"""

_NB_TRAIN = f"SELECT d.id, {TOXIC} AS label, d.toks, d.id AS ord FROM ({_NB_DOCS}) d JOIN labels l ON d.id = l.doc_id WHERE d.id % 3 <> 0"
_NB_TEST = f"SELECT d.id, d.toks FROM ({_NB_DOCS}) d JOIN labels l ON d.id = l.doc_id WHERE d.id % 3 = 0"
ORACLE["score_evaluate_report"] = f"""
  WITH {naive_bayes(_NB_TRAIN, _NB_TEST)},
  pairs AS (SELECT CAST(g.c AS VARCHAR) AS label, CAST(m.pred AS VARCHAR) AS prediction
            FROM margins m JOIN labels l ON m.id = l.doc_id JOIN dict g ON g.label = {TOXIC})
  SELECT r.*, CAST(0 AS BIGINT) AS unmatched FROM ({report("SELECT * FROM pairs")}) r"""
ORACLE["score_evaluate_majority"] = f"""
  WITH {naive_bayes(_NB_TRAIN, _NB_TEST)},
  best AS (SELECT c FROM tr JOIN dict USING (label) GROUP BY c ORDER BY count(*) DESC, c LIMIT 1),
  pairs AS (SELECT CAST(g.c AS VARCHAR) AS label,
                   CAST(CASE WHEN m.id % 5 = 0 OR m.id % 7 = 0 THEN (SELECT c FROM best) ELSE m.pred END AS VARCHAR) AS prediction
            FROM margins m JOIN labels l ON m.id = l.doc_id JOIN dict g ON g.label = {TOXIC})
  SELECT r.*, CAST(0 AS BIGINT) AS unmatched FROM ({report("SELECT * FROM pairs")}) r"""

ORACLE["classifier_invariants"] = """
  SELECT count(*)::BIGINT AS rows_out, count(DISTINCT doc_id)::BIGINT AS ids, 0::BIGINT AS bad_sums, 0::BIGINT AS bad_argmax,
         0::BIGINT AS unnamed FROM documents"""

_HASOC = f"""SELECT CAST(d.doc_id AS VARCHAR) AS id, {nulltok('d.text')} AS text,
  CASE WHEN l.toxic = 1 THEN 'HOF' WHEN l.toxic IS NOT NULL THEN 'NOT' END AS label, '1' AS task, d.doc_id
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

ORACLE["registry_combined"] = f"""
  SELECT id, text, label, task, CASE WHEN doc_id % 3 <> 2 THEN 'hasoc:train:0' ELSE 'hasoc:train:1' END AS source FROM ({_HASOC})"""

ORACLE["registry_augmented"] = f"""
  SELECT id, text, label, task, 'hasoc:train:0' AS source FROM ({_HASOC}) WHERE doc_id % 4 <> 3
  UNION ALL SELECT id, 'again ' || text, label, task, 'hasoc:augment' FROM ({_HASOC}) WHERE doc_id % 4 = 1"""

ORACLE["encode_augmented"] = f"""
  WITH r AS (SELECT id, source, {toks(clean('text'))} AS toks, row_number() OVER () AS rn FROM ({ORACLE["registry_augmented"]})),
  t AS (SELECT rn, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS pos FROM r),
  v AS (SELECT tok, row_number() OVER (ORDER BY count(*) DESC, tok) + 1 AS tid FROM t GROUP BY tok),
  e AS (SELECT rn, list(tid ORDER BY pos) AS ids FROM t JOIN v USING (tok) GROUP BY rn)
  SELECT id, source, md5(array_to_string(coalesce(ids, []), ',')) AS ids_md5, CAST(len(coalesce(ids, [])) AS INTEGER) AS n_tokens
  FROM r LEFT JOIN e USING (rn)"""

ORACLE["registry_held_out"] = f"""
  WITH c AS (SELECT count(*) AS n, ceil(count(*) * {HOLDOUT_FRAC})::BIGINT AS dev FROM documents)
  SELECT 'dev' AS side, dev AS n, dev AS ids, dev AS expected_dev, n::BIGINT AS all_ids FROM c
  UNION ALL SELECT 'train', n - dev, n - dev, dev, n FROM c"""

_LATIN1 = r"regexp_replace(text, '[^\x{00}-\x{FF}]', '?', 'g')"
ORACLE["tsv_utf8_roundtrip"] = f"SELECT doc_id, {nulltok('lang')} AS lang, {nulltok('text')} AS text FROM documents"
ORACLE["tsv_latin1_roundtrip"] = (f"SELECT doc_id, {nulltok('lang')} AS lang, "
                                  f"{nulltok('t')} AS text FROM (SELECT *, {_LATIN1} AS t FROM documents)")

ORACLE["write_predictions"] = f"""
  WITH d AS ({EVENT_DICT.format(where="")})
  SELECT e.vec_id, CASE WHEN coalesce(d.label, '') = '' THEN NULL ELSE d.label END AS prediction,
         'label' || CAST(e.label AS VARCHAR) AS task
  FROM embeddings e LEFT JOIN d ON CAST({argmax_first(LOGIT_CLASSES)} AS VARCHAR) = CAST(d.label_id AS VARCHAR)"""

ORACLE["history_best_epoch"] = """
  SELECT run, epoch AS best_epoch, val_loss AS best_loss FROM (
    SELECT CAST(user_id AS VARCHAR) AS run, event_id AS epoch, value AS val_loss,
           row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rn
    FROM events WHERE value IS NOT NULL) WHERE rn = 1"""

ORACLE["prediction_lines"] = f"SELECT prediction AS value, row_number() OVER (ORDER BY vec_id) - 1 AS line FROM ({SCORED})"


def _task(task: str, column: str, yes: str, no: str) -> str:
    label = f"CASE WHEN {column} = 1 THEN '{yes}' ELSE '{no}' END"
    rows = f"SELECT d.id, {label} AS label, d.toks, d.id AS ord FROM ({_NB_DOCS}) d JOIN labels l ON d.id = l.doc_id"
    return f"""
  (WITH {naive_bayes(f"SELECT * FROM ({rows}) WHERE id % 3 = 1", f"SELECT id, toks FROM ({rows}) WHERE id % 3 = 0")},
  pairs AS (SELECT CAST(g.c AS VARCHAR) AS label, CAST(m.pred AS VARCHAR) AS prediction
            FROM margins m JOIN labels l ON m.id = l.doc_id JOIN dict g ON g.label = {label})
  SELECT '{task}' AS task, r.*, CAST(0 AS BIGINT) AS unmatched, (SELECT count(*) FROM margins)::BIGINT AS written,
    (SELECT count(*) FROM margins m JOIN dict ON dict.c = m.pred WHERE dict.label = '{yes}')::BIGINT AS positive
  FROM ({report("SELECT * FROM pairs")}) r)"""


ORACLE["olid_tasks"] = _task("a", "toxic", "OFF", "NOT") + " UNION ALL " + _task("b", "quality", "UNT", "TIN")

_PCL = f"SELECT d.id, CAST(l.quality AS VARCHAR) AS label, d.toks, d.id AS ord FROM ({_NB_DOCS}) d JOIN labels l ON d.id = l.doc_id"
ORACLE["pcl_flow"] = f"""
  WITH {naive_bayes(f"SELECT * FROM ({_PCL}) WHERE id % 3 = 1", f"SELECT id, toks FROM ({_PCL}) WHERE id % 3 = 0")},
  said AS (SELECT m.id, CASE WHEN m.id % 11 = 0 THEN '' WHEN m.id % 13 = 0 THEN 'positive' ELSE dict.label END AS said FROM margins m JOIN dict ON dict.c = m.pred)
  SELECT id AS doc_id, md5('classification: ' || c.text) AS text_md5, CASE WHEN length(said) <> 1 THEN '0' ELSE said END AS prediction,
    (SELECT count(*) FROM said WHERE length(said) <> 1)::BIGINT AS repaired, (SELECT count(*) FROM said)::BIGINT AS rows
  FROM said JOIN ({DOCS_CLEAN}) c ON c.doc_id = said.id"""

ORACLE["preparation_flow"] = f"""
  WITH r AS (SELECT row_number() OVER (ORDER BY d.doc_id) - 1 AS row_ord, {nulltok('t')} AS text, CAST(l.toxic AS VARCHAR) AS label
             FROM (SELECT *, {_LATIN1} AS t FROM documents) d LEFT JOIN labels l ON d.doc_id = l.doc_id)
  SELECT row_ord, md5(last_value(text IGNORE NULLS) OVER (ORDER BY row_ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS text_md5,
    last_value(label IGNORE NULLS) OVER (ORDER BY row_ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label,
    CASE WHEN row_number() OVER (ORDER BY md5(CAST(row_ord AS VARCHAR))) <= ceil(count(*) OVER () * {HOLDOUT_FRAC}) THEN 'dev' ELSE 'train' END AS split
  FROM r"""

ORACLE["csv_swapped_headers"] = f"""
  SELECT doc_id, {nulltok('text')} AS text, {nulltok('lang')} AS lang, CASE WHEN doc_id % 3 = 2 THEN {nulltok('source')} END AS source FROM documents"""

ORACLE["gold_listed_order"] = """
  SELECT CAST(doc_id AS VARCHAR) AS id, CAST(toxic AS VARCHAR) AS label, row_number() OVER (ORDER BY doc_id % 2, doc_id) - 1 AS place FROM labels"""

ORACLE["accuracy_missing"] = """
  SELECT avg(CASE WHEN doc_id % 4 <> 0 AND quality = toxic THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy FROM labels WHERE quality IS NOT NULL"""

ORACLE["holdout_repeated_keys"] = f"""
  WITH k AS (SELECT l_suppkey, count(*) AS n, md5(CAST(l_suppkey AS VARCHAR)) AS h FROM lineitem GROUP BY l_suppkey),
  b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY h, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        ceil(sum(n) OVER () * {HOLDOUT_FRAC}) AS share FROM k)
  SELECT l_suppkey, CAST(greatest(0, least(n, share - before)) AS BIGINT) AS held, n::BIGINT AS n FROM b"""

ORACLE["classifier_certificate"] = "SELECT count(*)::BIGINT AS n, true AS gradient_small FROM documents JOIN labels USING (doc_id)"
