"""DuckDB SQL twins of the registered queries (same column names, doubles
rounded to 6 digits). Shared fragments are Python string templates."""

from __future__ import annotations

import re

# Cleaning of one text: F1 -> F2 (RE2 \s is ASCII; the driver tables hold no
# other whitespace); F3 keeps its first 300 words.
WHOLE = "trim(regexp_replace(regexp_replace({t}, '<br\\s*/?>', ' ', 'g'), '\\s+', ' ', 'g'))"
CLEAN = ("array_to_string(list_slice(string_split(trim(regexp_replace(regexp_replace("
         "{t}, '<br\\s*/?>', ' ', 'g'), '\\s+', ' ', 'g')), ' '), 1, 300), ' ')")

RAW_LANG = """
  SELECT 'lang' AS dataset, doc_id AS row_id, text, lang AS label_text,
         CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS label
  FROM documents"""

RAW_QUALITY = """
  SELECT 'quality' AS dataset, d.doc_id AS row_id, d.text,
         coalesce(['low','high'][l.quality + 1], CAST(l.quality AS VARCHAR)) AS label_text,
         l.quality AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""

RAW_ROLE = """
  SELECT 'role' AS dataset, conv_id * 2147483648 + turn AS row_id, text, role AS label_text,
         CAST(dense_rank() OVER (ORDER BY role) - 1 AS INTEGER) AS label
  FROM conversations"""

PREPARED = f"""
  WITH raw AS ({RAW_LANG} UNION ALL {RAW_QUALITY} UNION ALL {RAW_ROLE}),
  cleaned AS (
    SELECT dataset, row_id, {CLEAN.format(t='text')} AS text, label, label_text
    FROM raw WHERE text IS NOT NULL),
  kept AS (SELECT * FROM cleaned WHERE length(text) > 0),
  nc AS (SELECT dataset, count(DISTINCT label) AS k FROM kept GROUP BY dataset),
  ranked AS (
    SELECT kept.*, row_number() OVER (PARTITION BY kept.dataset, label
             ORDER BY md5('12345:b' || CAST(row_id AS VARCHAR)), row_id) AS rn,
           500 // nc.k AS quota
    FROM kept JOIN nc ON kept.dataset = nc.dataset)
  SELECT dataset, row_id, text, label, label_text,
         md5('12345:s' || CAST(row_id AS VARCHAR)) AS shuffle_key
  FROM ranked WHERE rn <= quota"""

SQL: dict[str, str] = {}

SQL["clean_truncate"] = f"""
  SELECT dataset, row_id, text, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_words
  FROM (SELECT dataset, row_id, {CLEAN.format(t='text')} AS text FROM ({RAW_LANG}) WHERE text IS NOT NULL)
  WHERE length(text) > 0"""

SQL["strip_breaks"] = """
  SELECT page_id, t AS text, CAST(length(t) AS BIGINT) AS n_chars
  FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<br\\s*/?>', ' ', 'g'),
                                            '\\s+', ' ', 'g')) AS t FROM pages)"""

SQL["balanced_sample"] = f"SELECT dataset, row_id, label, label_text FROM ({PREPARED})"

SQL["shuffle_key"] = f"SELECT dataset, row_id, label, shuffle_key FROM ({PREPARED})"

SQL["label_names"] = f"SELECT dataset, row_id, label, label_text FROM ({RAW_QUALITY})"

DESCRIBED = f"""
  SELECT * FROM (SELECT dataset, row_id, {WHOLE.format(t='text')} AS text, label, label_text
    FROM ({RAW_LANG} UNION ALL {RAW_QUALITY} UNION ALL {RAW_ROLE}) WHERE text IS NOT NULL) WHERE length(text) > 0"""

SQL["class_distribution"] = f"""
  SELECT dataset, label, label_text, count(*) AS n FROM ({DESCRIBED})
  GROUP BY dataset, label, label_text"""

SQL["chance"] = f"""
  SELECT dataset, round(max(n) / sum(n), 6) AS chance
  FROM (SELECT dataset, label, count(*) AS n FROM ({DESCRIBED}) GROUP BY 1, 2) GROUP BY dataset"""

SQL["dataset_meta"] = f"""
  WITH p AS ({DESCRIBED}),
  c AS (SELECT dataset, label_text, count(*) AS n FROM p GROUP BY 1, 2),
  cls AS (SELECT dataset, string_agg(label_text, '|' ORDER BY label_text) AS classes,
                 string_agg(label_text || '=' || n, '|' ORDER BY label_text) AS dist, count(*) AS n_classes FROM c GROUP BY dataset),
  s AS (SELECT dataset, count(*) AS n, avg(len(string_split(text, ' '))) AS mean_words
        FROM p GROUP BY dataset)
  SELECT s.dataset, s.n, cls.classes, cls.n_classes, cls.dist, round(s.mean_words, 6) AS mean_words
  FROM s JOIN cls ON s.dataset = cls.dataset"""


# ---- catalogue, prompts, logits ----------------------------------------------

def _lit(v):
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def _catalogue_sql() -> str:
    from probelab.sources.catalog import default_rows
    rows = ", ".join("(" + ", ".join(_lit(x) for x in r[:6]) + ", " +
                     (f"CAST({r[6]!r} AS DOUBLE)" if r[6] is not None else "CAST(NULL AS DOUBLE)") + ")"
                     for r in default_rows())
    return (f"(SELECT * FROM (VALUES {rows}) AS t(q_idx, qid, sense, predicate, question, set, "
            "a_priori_metaphoricity))")


CAT = _catalogue_sql()
LOW_QIDS = [r[1] for r in __import__("probelab.sources.catalog", fromlist=["x"]).default_rows() if r[5] == "SYN_LOW"]
ALL_QIDS = [r[1] for r in __import__("probelab.sources.catalog", fromlist=["x"]).default_rows()]

TEXTS = f"""
  SELECT dataset, row_id, text FROM (
    SELECT dataset, row_id, {WHOLE.format(t='text')} AS text FROM ({RAW_LANG}) WHERE text IS NOT NULL)
  WHERE length(text) > 0"""

PROMPTS = f"""
  SELECT t.dataset, t.row_id, c.qid,
         t.text || chr(10) || chr(10) || 'Question: ' || c.question || chr(10) ||
         'Answer with only ''yes'' or ''no''.' AS prompt
  FROM ({TEXTS}) t CROSS JOIN {CAT} c"""

# The character rule: the mean over a token's characters of (1 + count in the
# question) * ln(1 + count in the text).
TOKENS = {"yes": ["yes", " yes", "Yes", " Yes", "YES", " YES"], "no": ["no", " no", "No", " No", "NO", " NO"]}
CHARS = sorted(set("".join(t for ts in TOKENS.values() for t in ts)))


def _counts(text: str) -> str:
    return ", ".join(f"ln(1 + length({text}) - length(replace({text}, '{c}', ''))) AS l{i}" for i, c in enumerate(CHARS))


def _token(token: str, weight) -> str:
    return "(" + " + ".join(f"{weight(CHARS.index(c))} * l{CHARS.index(c)}" for c in token) + f") / {len(token)}.0"


def _lse(items: str) -> str:
    return f"(list_max({items}) + ln(list_sum(list_transform({items}, lambda z: exp(z - list_max({items}))))))"


def _weights_sql() -> str:
    from probelab.sources.catalog import default_rows
    rows = ", ".join(f"({r[0]}, {_lit(r[1])}, " + ", ".join(str(1 + r[4].count(c)) for c in CHARS) + ")" for r in default_rows())
    return f"(SELECT * FROM (VALUES {rows}) AS w(q_idx, qid, " + ", ".join(f"w{i}" for i in range(len(CHARS))) + "))"


LOGS = f"SELECT dataset, row_id, {_counts('text')} FROM ({TEXTS})"

ARRAYS = f"""
  SELECT t.dataset, t.row_id, c.q_idx, c.qid, """ + ", ".join(
    "[" + ", ".join(_token(t, lambda i: f"c.w{i}") for t in ts) + f"] AS {'ys' if a == 'yes' else 'ns'}" for a, ts in TOKENS.items()) + f"""
  FROM ({LOGS}) t CROSS JOIN {_weights_sql()} c"""

LOGITS = f"""
  SELECT dataset, row_id, qid, unnest([{", ".join(_lit(t) for ts in TOKENS.values() for t in ts)}]) AS token, unnest(ys || ns) AS logit
  FROM ({ARRAYS})"""

YN = f"SELECT dataset, row_id, q_idx, qid, {_lse('ys')} AS ly, {_lse('ns')} AS ln FROM ({ARRAYS})"

SQL["catalog_sets"] = f"""
  WITH e AS (SELECT vec_id, embedding FROM embeddings),
  l AS (SELECT c.set, c.sense, CAST(e.embedding[c.q_idx + 1] AS DOUBLE) AS value
        FROM e CROSS JOIN {CAT} c
        WHERE c.q_idx < len(e.embedding) AND c.set IN ('SYN_LOW', 'SYN_HIGH') AND NOT starts_with(c.qid, 'gib_'))
  SELECT set, sense, count(*) AS n_values, round(avg(value), 6) AS mean_value FROM l GROUP BY set, sense"""

SQL["prompts"] = f"""
  SELECT dataset, row_id, qid, prompt, CAST(len(string_split(prompt, ' ')) AS BIGINT) AS prompt_len
  FROM ({PROMPTS})"""

RATING_PROMPTS = f"""
  SELECT c.qid, 'When the adjective "' || c.predicate || '" is used in everyday English, is it often '
         || 'used figuratively or metaphorically to describe something non-physical (for example a '
         || 'mood, a person, or a situation)?' || chr(10) || 'Answer with only ''yes'' or ''no''.' AS prompt
  FROM {CAT} c"""

SQL["rating_prompts"] = f"SELECT *, (SELECT count(*) FROM embeddings) AS n_values FROM ({RATING_PROMPTS})"

SQL["logsumexp_diff"] = f"SELECT dataset, row_id, qid, round(ly - ln, 6) AS value FROM ({YN})"

SQL["prob_diff"] = f"""
  SELECT dataset, row_id, qid,
         round((exp(ly - greatest(ly, ln)) - exp(ln - greatest(ly, ln))) /
               (exp(ly - greatest(ly, ln)) + exp(ln - greatest(ly, ln))), 6) AS value
  FROM ({YN})"""

SQL["top_tokens"] = f"""
  SELECT dataset, row_id, qid, rank, token, round(prob, 6) AS prob FROM (
    SELECT dataset, row_id, qid, token,
           CAST(row_number() OVER (PARTITION BY dataset, row_id, qid ORDER BY logit DESC, token) AS BIGINT) AS rank,
           exp(logit - m) / sum(exp(logit - m)) OVER (PARTITION BY dataset, row_id, qid) AS prob
    FROM (SELECT *, max(logit) OVER (PARTITION BY dataset, row_id, qid) AS m FROM ({LOGITS})))
  WHERE rank <= 5"""

SQL["features_long"] = SQL["logsumexp_diff"]

# 64 elements: the width of the vectors of the driver's table
WIDTH = 64
IDS = ALL_QIDS + [f"element_{i + 1}" for i in range(len(ALL_QIDS), WIDTH)]
EMB_LONG = f"""
  SELECT 'embeddings' AS dataset, vec_id AS row_id, [{", ".join(_lit(q) for q in IDS)}][i] AS qid, CAST(embedding[i] AS DOUBLE) AS value
  FROM embeddings CROSS JOIN (SELECT unnest(range(1, {WIDTH + 1})) AS i)"""

SQL["features_wide"] = ("SELECT 'embeddings' AS dataset, vec_id AS row_id, " +
                        ", ".join(f'round(CAST(embedding[{i + 1}] AS DOUBLE), 6) AS "{q}"'
                                  for i, q in enumerate(IDS)) + " FROM embeddings")

SQL["unpivot"] = f"SELECT dataset, row_id, qid, round(value, 6) AS value FROM ({EMB_LONG})"

SQL["resume_antijoin"] = f"""
  SELECT p.dataset, p.row_id, p.qid FROM ({PROMPTS}) p JOIN documents d ON p.row_id = d.doc_id
  WHERE d.lang IS DISTINCT FROM 'en'"""

SQL["feature_spread"] = f"""
  SELECT dataset, qid, round(stddev_samp(value), 6) AS spread FROM ({EMB_LONG}) GROUP BY dataset, qid"""

SQL["spread_summary"] = f"""
  SELECT dataset, round(min(spread), 6) AS spread_min, round(median(spread), 6) AS spread_median,
         round(max(spread), 6) AS spread_max
  FROM (SELECT dataset, qid, stddev_samp(value) AS spread FROM ({EMB_LONG}) GROUP BY dataset, qid)
  GROUP BY dataset"""

LABELLED = f"""
  SELECT 'embeddings' AS dataset, vec_id AS row_id, label FROM embeddings
  UNION ALL SELECT dataset, row_id, label FROM ({RAW_LANG})"""


def folds_sql(labelled: str) -> str:
    return f"""
  WITH b AS ({labelled}),
  c AS (SELECT dataset, label, count(*) AS n FROM b GROUP BY dataset, label),
  o AS (SELECT dataset, label, coalesce(sum(n) OVER (PARTITION BY dataset ORDER BY label
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM c)
  SELECT b.dataset, b.row_id, b.label,
         CAST((o.off + row_number() OVER (PARTITION BY b.dataset, b.label
               ORDER BY md5('0:f' || CAST(b.row_id AS VARCHAR)), b.row_id) - 1) % 5 AS INTEGER) AS fold
  FROM b JOIN o ON b.dataset = o.dataset AND b.label = o.label"""


SQL["stratified_folds"] = folds_sql(LABELLED)

EMB_FOLDS = folds_sql("SELECT 'embeddings' AS dataset, vec_id AS row_id, label FROM embeddings")

SQL["fold_scaling"] = f"""
  WITH f AS ({EMB_FOLDS}), l AS ({EMB_LONG}),
  h AS (SELECT unnest(range(0, 5)) AS held)
  SELECT l.dataset, CAST(h.held AS INTEGER) AS held, l.qid, count(*) AS n_train,
         round(avg(l.value), 6) AS mean, round(stddev_pop(l.value), 6) AS std
  FROM l JOIN f ON l.dataset = f.dataset AND l.row_id = f.row_id
  JOIN h ON f.fold <> h.held
  GROUP BY l.dataset, h.held, l.qid"""

SQL["feature_orders"] = f"""
  WITH d AS (SELECT DISTINCT dataset FROM ({LABELLED})),
  g AS (SELECT d.dataset, p.perm, q.qid FROM d
        CROSS JOIN (SELECT unnest(range(0, 10)) AS perm) p
        CROSS JOIN (SELECT unnest([{", ".join(_lit(q) for q in LOW_QIDS)}]) AS qid) q)
  SELECT dataset, CAST(perm AS INTEGER) AS perm,
         CAST(row_number() OVER (PARTITION BY dataset, perm
              ORDER BY md5('0:' || dataset || ':' || CAST(perm AS VARCHAR) || ':' || qid), qid) AS BIGINT) AS k,
         qid
  FROM g"""


# ---- predictions: metrics, curves, statistics ----------------------------------
# Out-of-fold nearest centroids on standardised features, in whole millionths.

FOLDED = folds_sql(LABELLED)

FEATURES = f"""
  SELECT 'embeddings' AS dataset, vec_id AS row_id, i - 1 AS pos, CAST(floor(CAST(embedding[i] AS DOUBLE) * 1000000.0 + 0.5) AS BIGINT) AS v
  FROM embeddings CROSS JOIN (SELECT unnest(range(1, {WIDTH + 1})) AS i)
  UNION ALL SELECT dataset, row_id, q_idx, CAST(floor((ly - ln) * 1000000.0 + 0.5) AS BIGINT) FROM ({YN})"""

APART = f"""
  WITH f AS MATERIALIZED ({FOLDED}),
  x AS MATERIALIZED (SELECT f.*, x.pos, x.v FROM f JOIN ({FEATURES}) x ON f.dataset = x.dataset AND f.row_id = x.row_id),
  per AS (SELECT dataset, fold, label, pos, count(*) AS n, sum(v) AS s, sum(v * v) AS ss FROM x GROUP BY ALL),
  tr AS (SELECT p.dataset, h.held, p.label, p.pos, sum(n) AS n, sum(s) AS s, sum(ss) AS ss
         FROM per p JOIN (SELECT unnest(range(0, 5)) AS held) h ON h.held <> p.fold GROUP BY ALL),
  sc AS (SELECT dataset, held, pos, CAST(sum(n) * sum(ss) - sum(s) * sum(s) AS DOUBLE) AS q, sum(n) AS n FROM tr GROUP BY ALL)
  SELECT x.dataset, x.row_id, x.fold, x.label, x.pos, tr.label AS cls,
         pow((x.v - tr.s / tr.n) / CASE WHEN sc.q > 0 THEN sqrt(sc.q) / sc.n ELSE 1.0 END, 2) AS d
  FROM x JOIN tr ON tr.dataset = x.dataset AND tr.held = x.fold AND tr.pos = x.pos
  JOIN sc ON sc.dataset = x.dataset AND sc.held = x.fold AND sc.pos = x.pos"""


def pred_sql(configs: list[tuple]) -> str:
    """Predictions of configs (key, columns), which every dataset has, or
    (key, columns, dataset)."""
    rows = ", ".join(f"({_lit(d + '|' + c[0])}, {_lit(d)}, {i})" for c in configs for d in ("embeddings", "lang") if len(c) < 3 or c[2] == d for i in c[1])
    return f"""
  SELECT config_id, dataset, row_id, fold, label, arg_min(cls, struct_pack(d := d, cls := cls)) AS pred FROM (
    SELECT c.config_id, a.dataset, a.row_id, a.fold, a.label, a.cls, sum(a.d) AS d
    FROM ({APART}) a JOIN (VALUES {rows}) AS c(config_id, dataset, pos) ON a.dataset = c.dataset AND a.pos = c.pos GROUP BY ALL) GROUP BY ALL"""


def conf_sql(pred: str) -> str:
    return f"SELECT config_id, fold, label, pred, count(*) AS n FROM ({pred}) GROUP BY config_id, fold, label, pred"


QCONF = conf_sql(pred_sql([(q, [i]) if i < len(ALL_QIDS) else (q, [i], "embeddings") for i, q in enumerate(IDS)]))


def fold_acc_sql(conf: str) -> str:
    return f"""SELECT config_id, fold, sum(CASE WHEN label = pred THEN n ELSE 0 END) / sum(n) AS acc,
                      CAST(sum(n) AS BIGINT) AS n
               FROM ({conf}) GROUP BY config_id, fold"""


def cv_acc_sql(conf: str) -> str:
    return f"""SELECT config_id, avg(acc) AS acc, stddev_pop(acc) AS acc_std, count(*) AS n_folds
               FROM ({fold_acc_sql(conf)}) GROUP BY config_id"""


SQL["confusion"] = QCONF
SQL["fold_accuracy"] = f"SELECT config_id, fold, round(acc, 6) AS acc, n FROM ({fold_acc_sql(QCONF)})"
SQL["macro_f1"] = f"""
  WITH c AS ({QCONF}),
  t AS (SELECT config_id, fold, label AS cls, sum(n) AS n_true FROM c GROUP BY 1, 2, 3),
  p AS (SELECT config_id, fold, pred AS cls, sum(n) AS n_pred FROM c GROUP BY 1, 2, 3),
  tp AS (SELECT config_id, fold, label AS cls, sum(n) AS tp FROM c WHERE label = pred GROUP BY 1, 2, 3),
  j AS (SELECT coalesce(t.config_id, p.config_id) AS config_id, coalesce(t.fold, p.fold) AS fold,
               coalesce(t.cls, p.cls) AS cls, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred
        FROM t FULL OUTER JOIN p ON t.config_id = p.config_id AND t.fold = p.fold AND t.cls = p.cls),
  f AS (SELECT j.config_id, j.fold, j.cls,
               CASE WHEN n_true + n_pred > 0 THEN 2.0 * coalesce(tp.tp, 0) / (n_true + n_pred) ELSE 0 END AS f1
        FROM j LEFT JOIN tp ON j.config_id = tp.config_id AND j.fold = tp.fold AND j.cls = tp.cls),
  pf AS (SELECT config_id, fold, avg(f1) AS f1 FROM f GROUP BY 1, 2)
  SELECT config_id, round(avg(f1), 6) AS f1 FROM pf GROUP BY config_id"""

ORDERS = f"""
  WITH d AS (SELECT DISTINCT dataset FROM ({LABELLED})),
  g AS (SELECT d.dataset, p.perm, q.qid FROM d
        CROSS JOIN (SELECT unnest(range(0, 10)) AS perm) p
        CROSS JOIN (SELECT unnest([{", ".join(_lit(q) for q in LOW_QIDS)}]) AS qid) q)
  SELECT dataset, CAST(perm AS INTEGER) AS perm,
         CAST(row_number() OVER (PARTITION BY dataset, perm
              ORDER BY md5('0:' || dataset || ':' || CAST(perm AS VARCHAR) || ':' || qid), qid) AS INTEGER) AS k,
         list_position([{", ".join(_lit(q) for q in ALL_QIDS)}], qid) - 1 AS pos
  FROM g"""

CURVES = f"""
  WITH o AS ({ORDERS}),
  u AS (SELECT a.dataset, o.perm, o.k, a.row_id, a.fold, a.label, a.cls,
               sum(a.d) OVER (PARTITION BY a.dataset, o.perm, a.row_id, a.cls ORDER BY o.k) AS d
        FROM ({APART}) a JOIN o ON a.dataset = o.dataset AND a.pos = o.pos),
  p AS (SELECT dataset || '|' || perm || '|' || k AS config_id, fold, label, arg_min(cls, struct_pack(d := d, cls := cls)) AS pred
        FROM u GROUP BY dataset, perm, k, row_id, fold, label),
  a AS ({cv_acc_sql(conf_sql('SELECT * FROM p'))})
  SELECT split_part(config_id, '|', 1) AS dataset, CAST(split_part(config_id, '|', 2) AS INTEGER) AS perm,
         CAST(split_part(config_id, '|', 3) AS INTEGER) AS k, acc FROM a"""

BAND = f"""SELECT dataset, k, avg(acc) AS mean, stddev_pop(acc) AS std, count(*) AS n_orders
           FROM ({CURVES}) GROUP BY dataset, k"""
GAIN = f"SELECT *, mean - lag(mean) OVER (PARTITION BY dataset ORDER BY k) AS gain FROM ({BAND})"

SQL["curve_band"] = f"SELECT dataset, k, round(mean, 6) AS mean, round(std, 6) AS std, n_orders FROM ({BAND})"
SQL["marginal_gain"] = (f"SELECT dataset, k, round(mean, 6) AS mean, round(gain, 6) + 0.0 AS gain "
                        f"FROM ({GAIN})")   # + 0.0: -0.0 -> 0.0 as in Spark's decimal rounding
SQL["gain_summary"] = f"""
  SELECT dataset, round(arg_min(mean, k), 6) AS first, round(arg_max(mean, k), 6) AS last,
         round(avg(gain), 6) AS mean_step,
         round(avg(CASE WHEN gain IS NULL THEN NULL WHEN round(gain, 12) > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_positive
  FROM ({GAIN}) GROUP BY dataset"""

CHANCE_F = f"""SELECT dataset, max(n) / sum(n) AS chance FROM
               (SELECT dataset, label, count(*) AS n FROM ({FOLDED}) GROUP BY 1, 2) GROUP BY dataset"""

UNI = f"""
  SELECT split_part(a.config_id, '|', 1) AS dataset, split_part(a.config_id, '|', 2) AS qid,
         a.acc AS uni_acc, c.chance, a.acc - c.chance AS over
  FROM ({cv_acc_sql(QCONF)}) a JOIN ({CHANCE_F}) c ON split_part(a.config_id, '|', 1) = c.dataset"""

RATING = f"""
  SELECT qid, {_lse('ys')} - {_lse('ns')} AS llm_metaphoricity FROM (SELECT qid, """ + ", ".join(
    "[" + ", ".join(_token(t, lambda i: "1") for t in ts) + f"] AS {'ys' if a == 'yes' else 'ns'}" for a, ts in TOKENS.items()) + f"""
  FROM (SELECT qid, {_counts('prompt')} FROM ({RATING_PROMPTS})))"""

UTILITY = f"""
  WITH u AS ({UNI}),
  pq AS (SELECT u.*, c.set, c.sense, c.predicate, c.a_priori_metaphoricity AS metaphoricity
         FROM u JOIN {CAT} c ON u.qid = c.qid WHERE c.a_priori_metaphoricity IS NOT NULL),
  agg AS (SELECT qid, set, sense, predicate, metaphoricity, avg(over) AS utility
          FROM pq GROUP BY qid, set, sense, predicate, metaphoricity)
  SELECT agg.*, r.llm_metaphoricity FROM agg LEFT JOIN ({RATING}) r ON agg.qid = r.qid"""

SQL["question_utility"] = f"""
  SELECT qid, set, sense, predicate, metaphoricity, round(utility, 6) AS utility,
         round(llm_metaphoricity, 6) AS llm_metaphoricity FROM ({UTILITY})"""

SQL["set_means"] = f"""
  SELECT set, round(avg(utility), 6) AS mean_utility, round(min(utility), 6) AS min_utility
  FROM ({UTILITY}) GROUP BY set"""

SQL["all_above"] = f"""
  WITH c AS (SELECT avg(over) AS control_mean FROM ({UNI}) WHERE starts_with(qid, 'gib_')),
  l AS (SELECT min(utility) AS low_min FROM ({UTILITY}) WHERE set = 'SYN_LOW')
  SELECT round(c.control_mean, 6) AS control_mean, CAST(l.low_min > c.control_mean AS INTEGER) AS low_all_above
  FROM c, l"""

PAIRS = f"""
  SELECT 'a_priori' AS covariate, metaphoricity AS x, utility AS y, set FROM ({UTILITY})
  UNION ALL SELECT 'llm', llm_metaphoricity, utility, set FROM ({UTILITY})"""

def _simpson(f: str, upper: str, steps: int = 2000) -> str:
    """The integral of f(u), an expression of ``u``, from 0 to ``upper``."""
    at = re.sub(r"\bu\b", f"({upper} * i / {steps}.0)", f)
    return f"({upper} / {3 * steps}.0 * list_sum(list_transform(range(0, {steps + 1}), lambda i: CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {at})))"


def corr_p(r: str, n: str) -> str:
    """Two-sided p of a correlation: with t = tan(a) sqrt(n - 2) the t density
    is proportional to cos(a) to the power n - 3."""
    f = f"pow(greatest(cos(u), 0), {n} - 3)"
    return f"CASE WHEN {n} < 3 OR {r} IS NULL THEN NULL WHEN abs({r}) >= 1 THEN 0.0 ELSE 1 - {_simpson(f, f'asin(abs({r}))')} / {_simpson(f, '(pi() / 2)')} END"


def normal_p(z: str) -> str:
    return f"CASE WHEN {z} IS NULL THEN 1.0 ELSE least(1.0, 1 - 2 / sqrt(2 * pi()) * {_simpson('exp(-u * u / 2)', z)}) END"


SQL["pearson"] = f"""
  SELECT covariate, round(r, 6) AS r, n, round({corr_p('r', 'n')}, 6) AS p
  FROM (SELECT covariate, corr(x, y) AS r, count(*) AS n FROM ({PAIRS}) GROUP BY covariate)"""

SQL["spearman"] = f"""
  SELECT covariate, round(rho, 6) AS rho, n, round({corr_p('rho', 'n')}, 6) AS p FROM (
  SELECT covariate, corr(rx, ry) AS rho, count(*) AS n FROM (
    SELECT covariate,
           rank() OVER (PARTITION BY covariate ORDER BY round(x, 12)) + (count(*) OVER (PARTITION BY covariate, round(x, 12)) - 1) / 2.0 AS rx,
           rank() OVER (PARTITION BY covariate ORDER BY round(y, 12)) + (count(*) OVER (PARTITION BY covariate, round(y, 12)) - 1) / 2.0 AS ry
    FROM ({PAIRS})) GROUP BY covariate)"""

SQL["mann_whitney"] = f"""
  WITH u AS (SELECT utility, set FROM ({UTILITY}) WHERE set IN ('SYN_LOW', 'SYN_HIGH')),
  r AS (SELECT *, rank() OVER (ORDER BY round(utility, 12)) + (count(*) OVER (PARTITION BY round(utility, 12)) - 1) / 2.0 AS rk FROM u),
  t AS (SELECT sum(t * t * t - t) AS tie FROM (SELECT count(*) AS t FROM u GROUP BY round(utility, 12))),
  s AS (SELECT sum(CASE WHEN set = 'SYN_LOW' THEN 1 ELSE 0 END) AS n1,
               sum(CASE WHEN set = 'SYN_LOW' THEN 0 ELSE 1 END) AS n2,
               sum(CASE WHEN set = 'SYN_LOW' THEN rk ELSE 0 END) AS r1 FROM r),
  v AS (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2.0 AS u1, tie FROM s, t),
  w AS (SELECT *, sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tie / nullif((n1 + n2) * (n1 + n2 - 1), 0))) AS sigma FROM v),
  y AS (SELECT *, CASE WHEN sigma > 0 THEN (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2.0 - 0.5) / sigma END AS z FROM w)
  SELECT 'low_vs_high' AS test, round(u1, 6) AS u_low, round(n1 * n2 - u1, 6) AS u_high, round(z, 6) AS z, round({normal_p('z0')}, 6) AS p
  FROM (SELECT *, z AS z0 FROM y)"""

SQL["linear_fit"] = f"""
  WITH f AS (SELECT covariate, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
                    min(x) AS lo, max(x) AS hi FROM ({PAIRS}) GROUP BY covariate),
  g AS (SELECT f.*, CAST(unnest(range(0, 50)) AS INTEGER) AS i FROM f)
  SELECT covariate, i, round(round(lo + (hi - lo) * i / 49.0, 12), 6) AS x,
         round(round(intercept + slope * (lo + (hi - lo) * i / 49.0), 12), 6) AS y FROM g"""

SENSES = ["sight", "taste", "touch", "hearing", "smell"]
ROWS = __import__("probelab.sources.catalog", fromlist=["x"]).default_rows()
SENSE_COLUMNS = {x: [r[0] for r in ROWS if r[2] == x and r[5] == "SYN_LOW"] for x in SENSES}
SENSE_ACC = f"""
  SELECT split_part(a.config_id, '|', 1) AS dataset, split_part(a.config_id, '|', 2) AS sense,
         a.acc - c.chance AS v
  FROM ({cv_acc_sql(conf_sql(pred_sql([(x, SENSE_COLUMNS[x]) for x in SENSES])))}) a
  JOIN ({CHANCE_F}) c ON split_part(a.config_id, '|', 1) = c.dataset"""
SQL["sense_matrix"] = (f"SELECT dataset, " + ", ".join(
    f"round(max(v) FILTER (WHERE sense = '{s}'), 6) AS {s}" for s in SENSES) +
    f" FROM ({SENSE_ACC}) GROUP BY dataset")

SQL["dataset_correlations"] = f"""
  WITH d AS (SELECT u.dataset, c.a_priori_metaphoricity AS x, u.over AS y
             FROM ({UNI}) u JOIN {CAT} c ON u.qid = c.qid WHERE c.a_priori_metaphoricity IS NOT NULL),
  r AS (SELECT dataset,
               rank() OVER (PARTITION BY dataset ORDER BY round(x, 12)) + (count(*) OVER (PARTITION BY dataset, round(x, 12)) - 1) / 2.0 AS rx,
               rank() OVER (PARTITION BY dataset ORDER BY round(y, 12)) + (count(*) OVER (PARTITION BY dataset, round(y, 12)) - 1) / 2.0 AS ry
        FROM d)
  SELECT p.dataset, round(p.r, 6) AS pearson_r, round({corr_p('p.r', 'p.n')}, 6) AS pearson_p,
         round(s.rho, 6) AS spearman_r, round({corr_p('s.rho', 'p.n')}, 6) AS spearman_p, p.n FROM
    (SELECT dataset, corr(x, y) AS r, count(*) AS n FROM d GROUP BY dataset) p
    JOIN (SELECT dataset, corr(rx, ry) AS rho FROM r GROUP BY dataset) s ON p.dataset = s.dataset"""

# ---- zero-shot ------------------------------------------------------------------

ZS_OPTS = ("(SELECT * FROM (VALUES ('en', 'English', 0, 'A'), ('fr', 'French', 1, 'B'), "
           "('de', 'German', 2, 'C'), ('es', 'Spanish', 3, 'D')) AS o(label_text, display, option, letter))")


def _mean_log(word: str) -> str:
    return f"(list_sum(list_transform(string_split({word}, ''), lambda c: ln(1 + length(t.text) - length(replace(t.text, c, ''))))) / length({word}))"


ZS_SCORES = f"""
  SELECT dataset, row_id, label_text, option, {_lse('pair')} AS score FROM (
  SELECT t.dataset, t.row_id, l.lang AS label_text, o.option, [{_mean_log('o.display')}, {_mean_log("(' ' || o.display)")}] AS pair
  FROM ({TEXTS}) t JOIN documents l ON t.row_id = l.doc_id CROSS JOIN {ZS_OPTS} o)"""

ZS_PRED = f"""
  WITH s AS ({ZS_SCORES}),
  b AS (SELECT dataset, row_id, label_text, arg_max(option, struct_pack(score := score, neg := -option)) AS pred
        FROM s GROUP BY dataset, row_id, label_text)
  SELECT b.dataset, b.row_id, b.label_text, o.option AS gold, CAST(b.pred AS INTEGER) AS pred
  FROM b JOIN {ZS_OPTS} o ON b.label_text = o.label_text"""

SQL["zero_shot_pred"] = ZS_PRED
SQL["zero_shot_hist"] = f"""
  SELECT 'lang' AS dataset, o.letter, CAST(coalesce(c.n, 0) AS BIGINT) AS n
  FROM {ZS_OPTS} o LEFT JOIN (SELECT pred, count(*) AS n FROM ({ZS_PRED}) GROUP BY pred) c ON o.option = c.pred"""

SQL["comparison"] = f"""
  WITH zs AS (SELECT dataset, avg(CASE WHEN pred = gold THEN 1.0 ELSE 0.0 END) AS zero_shot
              FROM ({ZS_PRED}) GROUP BY dataset),
  g AS ({cv_acc_sql(conf_sql(pred_sql([('SYN_LOW', [r[0] for r in ROWS if r[5] == 'SYN_LOW']), ('SYN_ALL', [r[0] for r in ROWS if r[5] != 'GIB'])])))}),
  gp AS (SELECT split_part(config_id, '|', 1) AS dataset,
                max(acc) FILTER (WHERE split_part(config_id, '|', 2) = 'SYN_LOW') AS low_acc,
                max(acc) FILTER (WHERE split_part(config_id, '|', 2) = 'SYN_ALL') AS all_acc
         FROM g GROUP BY 1)
  SELECT c.dataset, round(c.chance, 6) AS chance, round(zs.zero_shot, 6) AS zero_shot,
         round(gp.low_acc, 6) AS low_acc, round(gp.all_acc, 6) AS all_acc
  FROM ({CHANCE_F}) c LEFT JOIN zs ON c.dataset = zs.dataset JOIN gp ON c.dataset = gp.dataset"""

# ---- TF-IDF ---------------------------------------------------------------------------

TF_COUNTS = f"""
  WITH f AS ({folds_sql(RAW_LANG)}),
  d AS (SELECT t.dataset, t.row_id, f.fold,
               regexp_extract_all(lower(t.text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS tok
        FROM ({TEXTS}) t JOIN f ON t.dataset = f.dataset AND t.row_id = f.row_id),
  e AS (SELECT dataset, row_id, fold, unnest(tok || list_transform(range(1, len(tok)),
               lambda i: tok[i] || ' ' || tok[i + 1])) AS term FROM d)
  SELECT dataset, row_id, fold, term, count(*) AS tf FROM e GROUP BY dataset, row_id, fold, term"""

TF_VOCAB = f"""
  WITH c AS ({TF_COUNTS}),
  h AS (SELECT unnest(range(0, 5)) AS held),
  tr AS (SELECT c.dataset, h.held, c.term, CAST(sum(c.tf) AS BIGINT) AS tf, count(*) AS df
         FROM c JOIN h ON c.fold <> h.held GROUP BY c.dataset, h.held, c.term),
  docs AS (SELECT t.dataset, t.row_id, f.fold FROM ({TEXTS}) t
           JOIN ({folds_sql(RAW_LANG)}) f ON t.dataset = f.dataset AND t.row_id = f.row_id),
  nt AS (SELECT d.dataset, h.held, count(*) AS n_train
         FROM docs d JOIN h ON d.fold <> h.held GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY dataset, held ORDER BY tf DESC, term) AS rank FROM tr)
  SELECT r.*, nt.n_train FROM r JOIN nt ON r.dataset = nt.dataset AND r.held = nt.held WHERE rank <= 5000"""

SQL["tfidf_vocab"] = f"""
  SELECT dataset, CAST(held AS INTEGER) AS held, term, tf, df, CAST(rank AS BIGINT) AS rank FROM ({TF_VOCAB})"""

SQL["tfidf_weights"] = f"""
  WITH c AS ({TF_COUNTS}), v AS ({TF_VOCAB}),
  w AS (SELECT c.dataset, v.held, c.row_id,
               (1 + ln(c.tf)) * (ln((1.0 + v.n_train) / (1.0 + v.df)) + 1) AS w
        FROM c JOIN v ON c.dataset = v.dataset AND c.term = v.term),
  n AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY dataset, held, row_id)) AS weight FROM w),
  d AS (SELECT dataset, row_id, h.range AS held
        FROM ({TEXTS}), range(5) h)
  SELECT d.dataset, CAST(d.held AS INTEGER) AS held, d.row_id, count(n.weight) AS n_terms,
         round(coalesce(sum(n.weight), 0), 6) AS weight_sum, round(coalesce(sum(n.weight * n.weight), 0), 6) AS norm2
  FROM d LEFT JOIN n ON n.dataset = d.dataset AND n.held = d.held AND n.row_id = d.row_id
  GROUP BY d.dataset, d.held, d.row_id"""
