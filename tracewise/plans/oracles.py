"""DuckDB SQL for the registered queries, written apart from the Spark code; only fixed texts are shared."""

from tracewise.operators.generation import HARD_NEGATIVE, PARAPHRASE, SEGMENT_TEMPLATE

_S = """
s AS (
  SELECT l_orderkey AS case_id, l_partkey AS trace_id, l_returnflag AS dataset, l_linestatus AS subcategory,
         list_extract(['sbert', 'nli', 'bertscore', 'cross_nli', 'bge_reranker'], l_linenumber % 5 + 1) AS scorer,
         list_extract(['raw_score', 'nli_heuristic', 'bertscore_f1', 'raw_score', 'sigmoid_raw_score'], l_linenumber % 5 + 1) AS score_field,
         CASE WHEN l_quantity % 2 = 1 THEN 'positive' ELSE 'negative' END AS pair_type,
         CASE WHEN l_quantity % 2 = 0 THEN list_extract(['value_flip', 'entity_flip', 'relation_flip'], (l_suppkey % 3 + 1)::INT) END AS negative_type,
         CASE WHEN l_orderkey % 2 = 0 THEN 'ranking' ELSE 'separation' END AS mode,
         l_discount * 10 AS raw_score, l_discount * 10 AS E_ab, l_tax * 10 AS E_ba, 0.8::DOUBLE - l_tax * 10 AS C_ab, (1.0::DOUBLE - l_discount * 10) / 2 AS C_ba,
         l_tax * 10 / 2 AS N_ab, l_discount * 10 / 4 AS N_ba,
         epoch(l_shipdate)::BIGINT * 1000000 + l_partkey * 50 + l_quantity::BIGINT AS line
  FROM lineitem
), v AS (
  SELECT *, CASE WHEN scorer = 'nli' THEN 0.5::DOUBLE * E_ab + 0.5::DOUBLE * E_ba - greatest(C_ab, C_ba)
                 WHEN scorer = 'bge_reranker' THEN 1.0::DOUBLE / (1.0::DOUBLE + exp(-raw_score)) ELSE raw_score END AS value
  FROM s
)"""


def _means(value: str) -> str:
    return f"""count(*) FILTER (pair_type = 'positive')::BIGINT AS n_pos, count(*) FILTER (pair_type = 'negative')::BIGINT AS n_neg,
       round(avg({value}) FILTER (pair_type = 'positive'), 6) AS mean_pos, round(avg({value}) FILTER (pair_type = 'negative'), 6) AS mean_neg,
       round(avg({value}) FILTER (pair_type = 'positive') - avg({value}) FILTER (pair_type = 'negative'), 6) AS margin"""


_SCALED = "(greatest(0.0::DOUBLE, value - 0.1::DOUBLE) / 0.9::DOUBLE)"
_PLAIN = "greatest(0.0::DOUBLE, value)"

_CAL = (
    "WITH "
    + _S
    + """, c AS (
  SELECT *, (pair_type = 'positive')::INT AS label, CASE WHEN case_id % 5 = 0 THEN 'heldout' ELSE 'calib' END AS split,
         1.0::DOUBLE / (1.0::DOUBLE + exp(-(1.5::DOUBLE * E_ab + 0.75::DOUBLE * E_ba + (-1.25::DOUBLE) * greatest(C_ab, C_ba) + (-0.5::DOUBLE) * greatest(N_ab, N_ba) + 0.1::DOUBLE))) AS score
  FROM s
)"""
)

_STEPS = """
st AS (
  SELECT 'user_' || user_id AS source_sample_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step_index,
         event_type || ' ' || value::DECIMAL(12, 2)::VARCHAR AS step, (props->>'$.k')::INT % 3 - 1 AS label
  FROM events
)"""

_REQUESTS = (
    "WITH "
    + _STEPS
    + """, k AS (SELECT *, CASE WHEN label = 1 THEN 'positive_paraphrase' ELSE 'hard_negative' END AS generation_type,
       array_to_string(list(step) OVER (PARTITION BY source_sample_id ORDER BY step_index ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '|') AS ctx FROM st),
r AS (
  SELECT 'pair_' || substr(sha256(source_sample_id || ':' || step_index || ':' || generation_type), 1, 20) AS pair_id, step AS anchor, COALESCE(ctx, '') AS context_steps,
         (label = 1)::INT AS compatibility_label, generation_type, source_sample_id, step_index,
         ('0x' || substr(sha256('42:' || source_sample_id || ':' || step_index || ':' || generation_type), 1, 8))::BIGINT & 2147483647 AS generation_seed
  FROM k WHERE label <> 0
)"""
)

_SYMBOLIC = r"""
sy AS (
  SELECT o_orderkey AS trace_id, ['Let x ' || list_extract(['=', '<=', '>', '+'], (o_orderkey % 4 + 1)::INT) || ' ' || o_custkey || '.',
         'So the total is ' || o_totalprice::DECIMAL(12, 2)::VARCHAR || ';', o_orderpriority] AS kept, [2, 3, 7] AS idx
  FROM orders
)"""

_SEG = (
    "WITH "
    + _SYMBOLIC
    + r""", t AS (
  SELECT o_orderkey AS trace_id, 'Given. Let x ' || list_extract(['=', '<=', '>', '+'], (o_orderkey % 4 + 1)::INT) || ' ' || o_custkey || '. So the total is ' || o_totalprice::DECIMAL(12, 2)::VARCHAR || '; done' || chr(10) || '- Step 2' || chr(10) || 'Therefore' || chr(10) || o_orderpriority AS reasoning
  FROM orders
), p AS (
  SELECT trace_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(reasoning, '[\r\n]+', chr(1), 'g'), '([.!?;:])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x:
         x <> '' AND NOT (lower(trim(regexp_replace(regexp_replace(regexp_replace(x, '^[\s>*#-]+', ''), '[^A-Za-z0-9 ]+', '', 'g'), '\s+', ' ', 'g'))) IN ('', 'given', 'therefore', 'thus', 'hence', 'now', 'final answer', 'answer', 'solution', 'step'))
         AND NOT regexp_full_match(lower(trim(regexp_replace(regexp_replace(regexp_replace(x, '^[\s>*#-]+', ''), '[^A-Za-z0-9 ]+', '', 'g'), '\s+', ' ', 'g'))), '(step\s*)?\d+[a-z]?')) AS segs
  FROM t
), g AS (
  SELECT trace_id, printf('%s_seg_%02d', trace_id::VARCHAR, i) AS case_id, i::INT AS segment_index, segs[i] AS reference
  FROM (SELECT trace_id, segs, unnest(range(1, len(segs) + 1)) AS i FROM p)
  WHERE regexp_matches(segs[i], '\d') OR regexp_matches(segs[i], '[=<>+\-*/^%$(){}\[\]|√∑π∞≤≥±×÷]')
), f AS (
  SELECT case_id, reference, regexp_extract(reference, '\d+(?:\.\d+)?') AS num, regexp_extract(' ' || reference || ' ', '[^A-Za-z0-9_]([A-Za-z])[^A-Za-z0-9_]', 1) AS ent FROM g
), fl AS (
  SELECT case_id,
         CASE WHEN num <> '' THEN regexp_replace(reference, '\d+(?:\.\d+)?', CASE WHEN contains(num, '.') THEN (num::DOUBLE + 1)::VARCHAR ELSE (num::BIGINT + 1)::VARCHAR END) END AS value_flip,
         CASE WHEN ent <> '' THEN regexp_replace(reference, '\b[A-Za-z]\b', CASE WHEN ent <> 'y' THEN 'y' ELSE 'x' END) END AS entity_flip,
         CASE WHEN contains(reference, '<=') THEN regexp_replace(reference, '<=', '>=') WHEN contains(reference, '>=') THEN regexp_replace(reference, '>=', '<=')
              WHEN contains(reference, '=') THEN regexp_replace(reference, '=', '!=') WHEN contains(reference, '<') THEN regexp_replace(reference, '<', '>')
              WHEN contains(reference, '>') THEN regexp_replace(reference, '>', '<') WHEN contains(reference, '+') THEN regexp_replace(reference, '\+', '-')
              WHEN contains(reference, '-') THEN regexp_replace(reference, '-', '+') END AS relation_flip
  FROM f
)"""
)

_ANSWERS = r"""
WITH a AS (
  SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'so <answer> ' || p_retailprice::DECIMAL(12, 2)::VARCHAR || ' </answer>' WHEN 1 THEN 'a #### 1 #### ' || p_size WHEN 2 THEN 'It is ' || p_name ELSE ' ' END AS solution,
         CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_partkey % 8 = 0 THEN p_retailprice::DECIMAL(12, 2)::VARCHAR ELSE (p_retailprice * 1.01::DOUBLE)::DECIMAL(12, 2)::VARCHAR END WHEN 1 THEN p_size || '.0' ELSE 'IT is: ' || p_name END AS truth
  FROM part
), x AS (
  SELECT *, CASE WHEN contains(solution, '<answer>') THEN trim(regexp_extract(solution, '<answer>\s*(.*?)\s*</answer>', 1)) WHEN contains(solution, '####') THEN trim(string_split(solution, '####')[-1]) ELSE trim(solution) END AS answer FROM a
), n AS (
  SELECT *, trim(regexp_replace(lower(answer), '[^a-z0-9.\-]+', ' ', 'g')) AS normalized, trim(regexp_replace(lower(truth), '[^a-z0-9.\-]+', ' ', 'g')) AS target FROM x
), m AS (
  SELECT *, TRY_CAST(nullif(regexp_extract(normalized, '-?\d+(?:\.\d+)?'), '') AS DOUBLE) AS number, TRY_CAST(nullif(regexp_extract(target, '-?\d+(?:\.\d+)?'), '') AS DOUBLE) AS wanted FROM n
), w AS (
  SELECT *, CASE WHEN normalized = '' OR target = '' THEN 0.0 WHEN normalized = target THEN 1.0
                 WHEN abs(number - wanted) <= greatest(1e-4 * greatest(abs(number), abs(wanted)), 1e-6, abs(wanted) * 1e-4) THEN 1.0 ELSE 0.0 END::DOUBLE AS accuracy,
         CASE WHEN trim(solution) = '' THEN 0.0 WHEN contains(solution, '</answer>') OR contains(solution, '####') THEN 1.0 ELSE 0.5 END::DOUBLE AS format
  FROM m
)"""

_LOGGED = """CASE WHEN k % 5 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN k % 5 <> 0 THEN '{"event_id":' || event_id || ',"compatibility_label":' || k % 2 || '}' END AS pair_json,
         CASE WHEN k % 5 = 0 THEN CASE WHEN k % 2 = 0 THEN '{"error_type":"PromptTooLong"}' ELSE '{"error_type":"Other"}' END END AS error_json"""
_LAST = "ORDER BY ts DESC, status DESC, pair_json DESC NULLS LAST, error_json DESC NULLS LAST"
_STATE = f"""
l AS (SELECT 'pair_' || user_id || '_' || event_type AS pair_id, ts, {_LOGGED} FROM (SELECT *, (props->>'$.k')::INT AS k FROM events)),
la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id {_LAST}) AS n FROM l) WHERE n = 1)"""

_JUDGED = """
e AS (
  SELECT event_id AS pair_id, event_type AS data_source, 'model_' || user_id % 4 AS policy_model, value / 500 AS p, (props->>'$.k')::INT % 3 - 1 AS label FROM events
), j AS (SELECT *, CASE WHEN p - (1.0::DOUBLE - p) > 0 THEN 1 ELSE -1 END AS pred FROM e)"""

_COUNTED = """count(*) FILTER (label = 1 AND pred = 1)::BIGINT AS tp, count(*) FILTER (label = -1 AND pred = 1)::BIGINT AS fp,
       count(*) FILTER (label = 1 AND pred = -1)::BIGINT AS fn, count(*) FILTER (label = -1 AND pred = -1)::BIGINT AS tn,
       count(*)::BIGINT AS total_steps, count(*) FILTER (label <> 0)::BIGINT AS evaluated_steps, count(*) FILTER (label = 0)::BIGINT AS neutral_steps"""


def _scores(more: str = "") -> str:
    f1p, f1n = "COALESCE(2 * tp / nullif(2 * tp + fp + fn, 0), 0)", "COALESCE(2 * tn / nullif(2 * tn + fp + fn, 0), 0)"
    return f"""round(COALESCE((tp + tn) / nullif(evaluated_steps, 0), 0), 6) AS accuracy, round(COALESCE(tp / nullif(tp + fp, 0), 0), 6) AS "precision",
       round(COALESCE(tp / nullif(tp + fn, 0), 0), 6) AS recall, round({f1p}, 6) AS f1_positive, round({f1n}, 6) AS f1_negative, round(({f1p} + {f1n}) / 2, 6) AS macro_f1{more}"""


def _cal_metrics(keys: str, source: str = "c", kind: str = "COALESCE(nullif(negative_type, ''), '__all__')", extra: str = "") -> str:
    """Metrics by keys over rows of source, as a query of columns keys and metrics."""
    on = " AND ".join(f"m.{k.strip()} IS NOT DISTINCT FROM g.{k.strip()}" for k in keys.split(","))
    names = ", ".join(f"g.{k.strip()}" for k in keys.split(","))
    return f"""
SELECT {names}, num_cases, num_pairs, ranking_acc, tpr_at_tau, fpr_at_tau, 0.5 * tpr_at_tau + 0.5 * (1.0 - fpr_at_tau) AS threshold_balanced_acc,
       mean_positive_score, mean_negative_score, mean_margin, COALESCE(0.5 * tpr_at_tau + 0.5 * (1.0 - fpr_at_tau), 1.0 - fpr_at_tau, tpr_at_tau) AS component,
       CASE WHEN ranking_acc IS NOT NULL THEN 'ranking' WHEN tpr_at_tau IS NOT NULL AND fpr_at_tau IS NOT NULL THEN 'mixed' WHEN fpr_at_tau IS NOT NULL THEN 'separation' WHEN tpr_at_tau IS NOT NULL THEN 'positive_only' ELSE '' END AS mode
FROM (
  SELECT {keys}, count(DISTINCT (dataset, case_id))::BIGINT AS num_cases, count(*)::BIGINT AS num_pairs, avg((score >= 0.5)::INT) FILTER (label = 1) AS tpr_at_tau, avg((score >= 0.5)::INT) FILTER (label = 0) AS fpr_at_tau,
         avg(score) FILTER (label = 1) AS mean_positive_score, avg(score) FILTER (label = 0) AS mean_negative_score
  FROM {source} GROUP BY {keys}
) g LEFT JOIN (
  SELECT {keys}, avg((pos - neg > 0)::INT) AS ranking_acc, avg(pos - neg) AS mean_margin
  FROM (
    SELECT n.*, p.pos FROM (
      SELECT {keys}, dataset AS ds, case_id AS ci, {kind} AS k2, max(score) AS neg FROM {source} WHERE mode = 'ranking' AND pair_type = 'negative' GROUP BY ALL
    ) n JOIN (
      SELECT {keys}, dataset AS ds, case_id AS ci, arg_min(score, line) AS pos FROM {source} WHERE mode = 'ranking' AND pair_type = 'positive' GROUP BY ALL
    ) p USING ({", ".join(dict.fromkeys([*(k.strip() for k in keys.split(",")), "ds", "ci"]))})
  ) GROUP BY {keys}
) m ON {on}"""


_ROUNDED = "round(ranking_acc, 6) AS ranking_acc, round(tpr_at_tau, 6) AS tpr_at_tau, round(fpr_at_tau, 6) AS fpr_at_tau, round(threshold_balanced_acc, 6) AS threshold_balanced_acc, round(mean_positive_score, 6) AS mean_positive_score, round(mean_negative_score, 6) AS mean_negative_score, round(mean_margin, 6) AS mean_margin, round(component, 6) AS component"

_TAUS = "[round(0.3 + 0.05 * i, 10)::DOUBLE FOR i IN range(13)]"
_TAU_TABLE = f"""{_CAL}, d AS (
  SELECT dataset, tau, avg((score >= tau)::INT) FILTER (label = 1) AS tpr, avg((score >= tau)::INT) FILTER (label = 0) AS fpr FROM c, (SELECT unnest({_TAUS}) AS tau) GROUP BY ALL
), tt AS (SELECT tau, avg(tpr) AS tpr, avg(fpr) AS fpr, avg(0.5 * tpr + 0.5 * (1.0 - fpr)) AS balanced FROM d GROUP BY tau)"""


def _hash(*parts: str) -> str:
    return "sha256('42:' || " + " || ':' || ".join(parts) + ")"


def _split(n: str, names: str) -> str:
    return f"""
WITH i AS (SELECT o_custkey, row_number() OVER (ORDER BY {_hash("o_custkey")}, o_custkey) AS n FROM (SELECT DISTINCT o_custkey FROM orders)), t AS (SELECT count(*) AS total FROM i), b AS (SELECT {n} FROM t)
SELECT {names} AS split, count(*)::BIGINT AS n_rows, count(DISTINCT o_custkey)::BIGINT AS n_keys, sum(o_custkey)::BIGINT AS sum_keys FROM orders JOIN i USING (o_custkey), b GROUP BY 1"""


_FAM = "WITH " + _S + ", f AS (SELECT *, CASE WHEN trace_id % 3 = 0 THEN 'num' WHEN mode = 'ranking' THEN 'hn' ELSE 'neg' END AS family FROM v)"

_CASES = "WITH cs AS (SELECT p_partkey AS case_id, p_brand AS dataset, CASE p_partkey % 3 WHEN 0 THEN 'ranking' WHEN 1 THEN 'separation' ELSE 'other' END AS mode, p_name AS anchor, p_type AS positive, [p_brand, p_name || ' not'] AS negatives FROM part)"

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _label(text: str) -> str:
    """The rule of labels: base name, without a known ending, other characters than letters, digits, _ . and - as one _, none at the ends, else unknown."""
    base = rf"regexp_replace(string_split({text}, '/')[-1], '\.(jsonl|json|parquet|csv|txt)$', '')"
    return f"COALESCE(nullif(trim(regexp_replace({base}, '[^A-Za-z0-9_.-]+', '_', 'g'), '_'), ''), 'unknown')"


_COLLECTED = (
    "WITH "
    + _S
    + """, ca AS (
  SELECT * REPLACE (CASE WHEN scorer = 'nli' AND trace_id % 50 <> 0 THEN E_ba END AS E_ba, CASE WHEN trace_id % 31 = 0 THEN 'odd' ELSE pair_type END AS pair_type), E_ba AS t FROM s
), nu AS (
  SELECT * REPLACE (CASE WHEN scorer = 'bge_reranker' THEN 'sigmoid_raw_score' ELSE score_field END AS score_field, CASE WHEN trace_id % 2 = 0 THEN dataset ELSE 'visualprm' END AS dataset), E_ab * 0.5 + E_ba * 0.25 AS score FROM s
), nd AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, trace_id, negative_type, pair_type, scorer, score_field, CASE WHEN scorer = 'nli' THEN E_ab ELSE score END, CASE WHEN scorer = 'nli' THEN [E_ba, C_ab, C_ba] END ORDER BY line) AS n FROM nu) WHERE n = 1
), co AS (
  SELECT * FROM (
    SELECT 'caption_negation' AS source, dataset, subcategory, scorer, f AS score_field, pair_type, v AS value FROM (
      SELECT *, unnest(CASE scorer WHEN 'nli' THEN ['nli_heuristic'] WHEN 'bertscore' THEN ['bertscore_precision', 'bertscore_recall', 'bertscore_f1'] WHEN 'bge_reranker' THEN ['sigmoid_raw_score'] ELSE ['raw_score'] END) AS f,
             unnest(CASE scorer WHEN 'nli' THEN [0.5::DOUBLE * E_ab + 0.5::DOUBLE * E_ba - greatest(C_ab, C_ba)] WHEN 'bertscore' THEN [raw_score, t, (raw_score + t) / 2] WHEN 'bge_reranker' THEN [1.0::DOUBLE / (1.0::DOUBLE + exp(-raw_score))] ELSE [raw_score] END) AS v FROM ca)
    UNION ALL
    SELECT 'visualprm_numeric', dataset, subcategory, scorer, score_field, pair_type, CASE scorer WHEN 'nli' THEN 0.5::DOUBLE * E_ab + 0.5::DOUBLE * E_ba - greatest(C_ab, C_ba) WHEN 'bge_reranker' THEN 1.0::DOUBLE / (1.0::DOUBLE + exp(-score)) ELSE score END FROM nd
    UNION ALL
    SELECT src, dataset, subcategory, 'nli_calibrated_logistic', 'calibrated_score', pair_type, CASE WHEN E_ba IS NOT NULL THEN 1.0::DOUBLE / (1.0::DOUBLE + exp(-(1.5::DOUBLE * E_ab + 0.75::DOUBLE * E_ba + (-1.25::DOUBLE) * greatest(C_ab, C_ba) + (-0.5::DOUBLE) * greatest(N_ab, N_ba) + 0.1::DOUBLE))) END
    FROM (SELECT 'caption_negation' AS src, * FROM ca WHERE scorer = 'nli' UNION ALL BY NAME SELECT 'visualprm_numeric' AS src, * FROM nd WHERE scorer = 'nli')
  ) WHERE value IS NOT NULL AND pair_type <> 'odd'
)"""
)

_GENERATED = """WITH v AS (SELECT *, p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS value, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS relation FROM part), g AS (
  SELECT *, CASE WHEN k % 7 = 0 THEN 'No valid JSON object found in generation' WHEN k % 6 = 0 THEN 'Generation is missing positive' WHEN value IS NULL AND relation IS NULL THEN 'Generation has no valid negatives' END AS error FROM v
)"""

SQL = {
    "reward_by_dataset": f"WITH {_S} SELECT dataset, scorer, score_field, {_means(_SCALED)} FROM v GROUP BY ALL",
    "reward_grouping_sets": f"""WITH {_S} SELECT CASE grouping(dataset) * 2 + grouping(subcategory) WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS level, dataset, subcategory, scorer, {_means(_PLAIN)}
FROM v GROUP BY GROUPING SETS ((dataset, scorer), (dataset, subcategory, scorer), (scorer))""",
    "reward_by_perturbation": f"WITH {_S} SELECT COALESCE(negative_type, '') AS negative_type, scorer, {_means(_PLAIN)} FROM v GROUP BY ALL",
    "nli_scores": f"""WITH {_S} SELECT dataset, subcategory, round(avg(0.5 * E_ab + 0.5 * E_ba - greatest(C_ab, C_ba)), 6) AS heuristic,
  round(avg(least(1.0, greatest(0.0, 0.7 * E_ab + 0.3 * E_ba - 0.5 * greatest(C_ab, C_ba)))), 6) AS coverage, round(avg(least(1.0, greatest(0.0, 0.5 * E_ab + 0.5 * E_ba - 0.5 * greatest(C_ab, C_ba)))), 6) AS equiv, count(*)::BIGINT AS n
FROM s WHERE scorer = 'nli' GROUP BY ALL""",
    "score_unpivot": f"""WITH {_S}, u AS (SELECT scorer, 'raw_score' AS score_field, raw_score AS score FROM s UNION ALL SELECT scorer, 'E_ba', E_ba FROM s UNION ALL SELECT scorer, 'C_ab', C_ab FROM s WHERE scorer = 'nli')
SELECT scorer, score_field, count(*)::BIGINT AS n, round(avg(score), 6) AS mean FROM u GROUP BY ALL""",
    "dedupe_first": f"""WITH {_S}, n AS (SELECT *, row_number() OVER (PARTITION BY case_id, scorer, negative_type, pair_type ORDER BY line, value) AS k FROM v)
SELECT scorer, negative_type, count(*)::BIGINT AS n, sum(line % 1000003)::BIGINT AS lines FROM n WHERE k = 1 GROUP BY ALL""",
    "tau_sensitivity": f"""{_FAM}, g AS (
  SELECT scorer, score_field, tau, avg((value >= tau)::INT) FILTER (family = 'hn' AND pair_type = 'negative') AS hn, avg((value >= tau)::INT) FILTER (family = 'neg' AND pair_type = 'negative') AS neg, avg((value >= tau)::INT) FILTER (family = 'num' AND pair_type = 'negative') AS num
  FROM f, (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS tau) GROUP BY ALL
), m AS (
  SELECT scorer, score_field, family, case_id, arg_max(value, line) FILTER (pair_type = 'positive') - max(value) FILTER (pair_type = 'negative') AS margin FROM f WHERE mode = 'ranking' AND family IN ('hn', 'num') GROUP BY ALL
), r AS (
  SELECT scorer, score_field, avg((margin > 0)::INT) AS acc, avg((margin > 0)::INT) FILTER (family = 'hn') AS hacc, avg((margin > 0)::INT) FILTER (family = 'num') AS nacc FROM m WHERE margin IS NOT NULL GROUP BY ALL
) SELECT scorer, score_field, tau, round(hn, 6) AS hn_fpr, round(neg, 6) AS neg_fpr, round(num, 6) AS num_fpr, round(acc, 6) AS ranking_acc, round(hacc, 6) AS hn_ranking_acc, round(nacc, 6) AS num_ranking_acc FROM g LEFT JOIN r USING (scorer, score_field)""",
    "ranking_accuracy": f"""{_FAM}, m AS (SELECT dataset, scorer, case_id, arg_min(value, line) FILTER (pair_type = 'positive') - max(value) FILTER (pair_type = 'negative') AS margin FROM f WHERE mode = 'ranking' GROUP BY ALL)
SELECT dataset, scorer, count(*)::BIGINT AS n_cases, round(avg((margin > 0)::INT), 6) AS ranking_acc FROM m WHERE margin IS NOT NULL GROUP BY ALL""",
    "fpr_by_family": f"{_FAM} SELECT family, scorer, count(*)::BIGINT AS n, round(avg((value >= 0.5)::INT), 6) AS fpr FROM f WHERE pair_type = 'negative' GROUP BY ALL",
    "case_mode": f"""WITH {_S}, m AS (SELECT dataset, pair_type, count(DISTINCT pair_type) OVER (PARTITION BY dataset, case_id) AS k FROM s)
SELECT dataset, CASE WHEN k = 2 THEN 'ranking' ELSE 'separation' END AS mode, pair_type, count(*)::BIGINT AS n FROM m GROUP BY ALL""",
    "sample_weights": f"""WITH {_S}, g AS (SELECT dataset, (pair_type = 'positive')::INT AS label, count(*) AS n FROM s GROUP BY ALL)
SELECT dataset, label, n::BIGINT AS n, round((1.0 / n) * ((SELECT sum(n) FROM g) / (SELECT count(*) FROM g)), 6)::DOUBLE AS weight FROM g""",
    "case_counts_pivot": f"WITH {_S} SELECT subcategory, dataset, count(DISTINCT trace_id)::BIGINT AS n_traces, " + ", ".join(f"count(*) FILTER (negative_type = '{t}')::BIGINT AS {t}" for t in ("value_flip", "entity_flip", "relation_flip")) + " FROM s GROUP BY ALL",
    "case_counts": f"{_CASES} SELECT dataset, mode, count(*)::BIGINT AS n_cases, sum(len(negatives))::BIGINT AS n_negatives FROM cs GROUP BY ALL",
    "pair_explode": f"""{_CASES}, n AS (SELECT *, unnest(negatives) AS neg, generate_subscripts(negatives, 1) - 1 AS i FROM cs)
SELECT case_id, dataset, mode, 'positive_pair' AS pair_type, NULL::INT AS negative_index, anchor AS text_a, positive AS text_b FROM cs WHERE mode = 'ranking'
UNION ALL SELECT case_id, dataset, mode, 'negative_pair', i::INT, CASE WHEN mode = 'ranking' THEN anchor ELSE positive END, neg FROM n WHERE mode <> 'other'""",
    "preview_first5": "SELECT event_type, event_id, n::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events) WHERE n <= 5",
    "segments": r"""WITH p AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '[\r\n]+', chr(1), 'g'), '([.!?;:])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS xs FROM documents
), q AS (SELECT doc_id, list_filter(xs, lambda x: NOT (lower(trim(regexp_replace(regexp_replace(regexp_replace(x, '^[\s>*#-]+', ''), '[^A-Za-z0-9 ]+', '', 'g'), '\s+', ' ', 'g'))) IN ('', 'given', 'therefore', 'thus', 'hence', 'now', 'final answer', 'answer', 'solution', 'step'))
  AND NOT regexp_full_match(lower(trim(regexp_replace(regexp_replace(regexp_replace(x, '^[\s>*#-]+', ''), '[^A-Za-z0-9 ]+', '', 'g'), '\s+', ' ', 'g'))), '(step\s*)?\d+[a-z]?')) AS segs FROM p)
SELECT doc_id, len(segs)::BIGINT AS n_segments, md5(array_to_string(segs, '|')) AS digest FROM q""",
    "numeric_segments": f"{_SEG} SELECT trace_id, case_id, segment_index, reference FROM g",
    "segment_flips": f"{_SEG} SELECT * FROM fl",
    "mock_cases": f"{_SEG} SELECT type, count(*)::BIGINT AS n FROM (SELECT 'value_flip' AS type, value_flip AS t FROM fl UNION ALL SELECT 'entity_flip', entity_flip FROM fl UNION ALL SELECT 'relation_flip', relation_flip FROM fl) WHERE t IS NOT NULL GROUP BY type",
    "answer_extract": f"{_ANSWERS} SELECT p_partkey, answer, normalized, number FROM w",
    "answer_rewards": f"{_ANSWERS} SELECT p_partkey, accuracy, format, (accuracy + format) / 2 AS reward FROM w",
    "last_assistant": r"""WITH c AS (SELECT conv_id, turn, role, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM conversations)
SELECT conv_id, COALESCE(string_agg(t, chr(10) ORDER BY turn) FILTER (role <> 'assistant'), '') AS prompt, arg_max(t, turn) FILTER (role = 'assistant') AS response FROM c WHERE t <> '' GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') > 0""",
    "training_rows": r"""WITH c AS (SELECT conv_id, turn, role, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM conversations), g AS (
SELECT conv_id, COALESCE(string_agg(t, chr(10) ORDER BY turn) FILTER (role <> 'assistant'), '') AS prompt, arg_max(t, turn) FILTER (role = 'assistant') AS response FROM c WHERE t <> '' GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') > 0)
SELECT 'conversations' AS data_source, 'math' AS ability, conv_id, CASE WHEN conv_id % 3 = 0 THEN '<image> ' ELSE '' END || prompt AS content, response || CASE WHEN conv_id % 2 = 0 THEN ' <answer>4</answer> #### 4' ELSE '' END AS ground_truth,
CASE WHEN conv_id % 3 = 0 THEN conv_id || '.png' END AS image, (conv_id % 3 = 0)::BIGINT AS num_images, CASE WHEN conv_id % 3 = 0 THEN 'local_paths_in_images_column' ELSE 'omitted_from_verl_parquet' END AS image_policy FROM g""",
    "turn_pairs": """SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(role) OVER w AS r2, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r2 = 'assistant'""",
    "conversation_steps": f"""WITH {_STEPS} SELECT source_sample_id, 'Question of ' || source_sample_id AS question, count(*)::BIGINT AS n_steps, md5(string_agg(step, '|' ORDER BY step_index)) AS digest, sum(label)::BIGINT AS label_sum, NULL::VARCHAR AS error FROM st GROUP BY source_sample_id""",
    "request_ids": f"{_REQUESTS} SELECT * FROM r",
    "context_examples": f"""WITH {_STEPS}, c AS (SELECT *, list(step) OVER (PARTITION BY source_sample_id ORDER BY step_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM st)
SELECT source_sample_id, step_index, md5('Question:' || chr(10) || 'Question of ' || source_sample_id || CASE WHEN step_index > 0 THEN chr(10) || chr(10) || 'Previous response steps:' || chr(10) || array_to_string(list_transform(prev, lambda x, i: i || '. ' || x), chr(10)) ELSE '' END) AS anchor, step AS generated, label AS compatibility_label FROM c""",
    "state_latest": f"WITH {_STATE} SELECT pair_id, status, pair_json, error_json FROM la",
    "state_counts": f"""WITH {_STATE} SELECT count(*)::BIGINT AS n, count(*) FILTER (status = 'ok')::BIGINT AS n_ok, count(*) FILTER (status = 'error')::BIGINT AS n_error, count(*) FILTER (error_json LIKE '%PromptTooLong%')::BIGINT AS n_too_long,
  count(*) FILTER (pair_json->>'$.compatibility_label' = '1')::BIGINT AS n_positive, count(*) FILTER (pair_json->>'$.compatibility_label' = '0')::BIGINT AS n_negative FROM la""",
    "state_errors": f"WITH {_STATE} SELECT error_json->>'$.error_type' AS error_type, count(*)::BIGINT AS n FROM la WHERE status = 'error' GROUP BY 1",
    "pending_requests": "SELECT 'pair_' || event_id AS pair_id, event_type FROM events WHERE event_type NOT IN ('click', 'view')",
    "legacy_import": f"""WITH e AS (SELECT *, (props->>'$.k')::INT AS k FROM events), g AS (
  SELECT user_id, status, error_json IS NOT NULL AS bad FROM (SELECT *, row_number() OVER (PARTITION BY user_id {_LAST}) AS n FROM (SELECT user_id, ts, {_LOGGED} FROM e WHERE event_type = 'signup')) WHERE n = 1
), u AS (SELECT user_id, bool_or(event_type = 'view') AS pair, bool_or(event_type = 'error') AS bad, bool_or(event_type = 'click') AS raw FROM e WHERE user_id NOT IN (SELECT user_id FROM g) GROUP BY user_id),
m AS (SELECT status, bad, false AS raw FROM g UNION ALL SELECT CASE WHEN pair THEN 'ok' ELSE 'error' END, bad, raw FROM u WHERE pair OR bad)
SELECT status, count(*)::BIGINT AS n, count(*) FILTER (raw)::BIGINT AS n_raw, count(*) FILTER (bad)::BIGINT AS n_errors FROM m GROUP BY status""",
    "group_split": _split("round_even(total * 0.8, 0) AS a, round_even(total * 0.8, 0) + round_even(total * 0.1, 0) AS b", "CASE WHEN n <= b.a THEN 'train' WHEN n <= b.b THEN 'val' ELSE 'test' END"),
    "holdout_split": _split("least(greatest(round_even(total * 0.05, 0), 1), total - 1) AS a", "CASE WHEN n <= b.a THEN 'val' ELSE 'train' END"),
    "calib_split": f"""WITH {_S}, i AS (SELECT dataset, case_id, row_number() OVER (PARTITION BY dataset ORDER BY {_hash("dataset", "case_id")}, case_id) AS n, count(*) OVER (PARTITION BY dataset) AS total FROM (SELECT DISTINCT dataset, case_id FROM s)),
k AS (SELECT *, CASE WHEN n <= CASE WHEN total = 1 THEN 1 ELSE greatest(1, least(round_even(total * 0.85, 0), total - 1)) END THEN 'calib' ELSE 'heldout' END AS split FROM i)
SELECT dataset, split, count(DISTINCT case_id)::BIGINT AS n_cases, count(*)::BIGINT AS n_rows FROM s JOIN k USING (dataset, case_id) GROUP BY ALL""",
    "capped_sample": f"SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_hash('c_custkey')}, c_custkey) AS n FROM customer) WHERE n <= 50",
    "balanced_sample": f"""WITH n AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_hash("c_custkey")}, c_custkey) AS n FROM customer)
SELECT c_mktsegment, c_custkey FROM n ORDER BY n, {_hash("c_mktsegment", "n")}, c_mktsegment LIMIT 123""",
    "ratio_sample": f"SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY {_hash('c_custkey')}, c_custkey) AS n, count(*) OVER () AS total FROM customer) WHERE n <= least(greatest(1, floor(total * 0.1)), 400)",
    "head_split": "SELECT s_suppkey, CASE WHEN n <= least(greatest(1, floor(total * 0.1)), total - 1) THEN 'val' ELSE 'train' END AS split FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS n, count(*) OVER () AS total FROM supplier)",
    "few_shots": f"""{_REQUESTS}, p AS (SELECT DISTINCT item_id, CASE WHEN item_id % 2 = 0 THEN 'hard_negative' ELSE 'positive_paraphrase' END AS generation_type FROM benchmark WHERE item_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY generation_type ORDER BY {_hash("generation_type", "item_id")}, item_id) AS place, count(*) OVER (PARTITION BY generation_type) AS size FROM p),
d AS (SELECT pair_id, generation_type, size, [('0x' || substr(sha256(generation_seed || ':' || j), 1, 12))::BIGINT % (size - j) + 1 FOR j IN [0, 1, 2]] AS t FROM r JOIN (SELECT DISTINCT generation_type, size FROM n) USING (generation_type)),
e AS (SELECT *, t[1] AS a, t[2] + (t[1] <= t[2])::INT AS b FROM d), f AS (SELECT *, t[3] + (least(a, b) <= t[3])::INT AS x FROM e), h AS (SELECT pair_id, generation_type, a, b, x + (greatest(a, b) <= x)::INT AS c FROM f)
SELECT pair_id, i.item_id || ',' || j.item_id || ',' || k.item_id AS items FROM h JOIN n i ON i.generation_type = h.generation_type AND i.place = a JOIN n j ON j.generation_type = h.generation_type AND j.place = b JOIN n k ON k.generation_type = h.generation_type AND k.place = c""",
    "split_leak_check": "SELECT o_custkey, count(DISTINCT o_orderkey % 10 = 0)::BIGINT AS n_splits FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey % 10 = 0) > 1",
    "eval_by_dimension": f"""WITH {_JUDGED}, c AS (
  SELECT 'data_source' AS dimension, data_source AS value, {_COUNTED} FROM j GROUP BY data_source UNION ALL SELECT 'policy_model', policy_model, {_COUNTED} FROM j GROUP BY policy_model UNION ALL SELECT 'all', '', {_COUNTED} FROM j
) SELECT dimension, value, tp, fp, fn, tn, total_steps, evaluated_steps, neutral_steps, {_scores()} FROM c""",
    "eval_overall": f"""WITH {_JUDGED}, c AS (SELECT {_COUNTED} FROM j), b AS (SELECT data_source, {_COUNTED} FROM j GROUP BY data_source), m AS (SELECT *, {_scores()} FROM b),
x AS (SELECT sum((COALESCE(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + COALESCE(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2 * evaluated_steps) / sum(evaluated_steps) AS w FROM b),
y AS (SELECT avg(CASE WHEN label = 1 THEN -ln(least(greatest(p, 1e-12), 1 - 1e-12)) ELSE -ln(1 - least(greatest(p, 1e-12), 1 - 1e-12)) END) AS loss FROM j WHERE label <> 0)
SELECT tp, fp, fn, tn, total_steps, evaluated_steps, neutral_steps, {_scores(", round(loss, 6) AS evaluation_loss, round(w, 6) AS weighted_macro_f1")} FROM c, x, y""",
    "eval_auc": f"""WITH {_JUDGED}, k AS (SELECT data_source, label, rank() OVER w + (count(*) OVER (PARTITION BY data_source, p) - 1) / 2.0 AS r FROM j WHERE label <> 0 WINDOW w AS (PARTITION BY data_source ORDER BY p))
SELECT data_source, round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label <> 1)), 6)::DOUBLE AS auc FROM k GROUP BY data_source""",
    "eval_predictions": f"""WITH {_JUDGED}, q AS (SELECT *, p - (1.0::DOUBLE - p) AS margin FROM e) SELECT pair_id, round(margin, 6) AS probability_margin, CASE WHEN margin > 0.25 THEN 1 ELSE -1 END AS predicted_label, label = 0 AS is_neutral,
  CASE WHEN label <> 0 THEN label = CASE WHEN margin > 0.25 THEN 1 ELSE -1 END END AS correct FROM q""",
    "logistic_apply": f"{_CAL} SELECT dataset, label, count(*)::BIGINT AS n, round(avg(score), 6) AS mean FROM c GROUP BY ALL",
    "tau_table": f"{_TAU_TABLE} SELECT tau, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(balanced, 6) AS balanced FROM tt",
    "choose_tau": f"""{_TAU_TABLE} SELECT tau, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(balanced, 6) AS balanced, round(CASE WHEN tpr >= 0.8 THEN 1 - fpr ELSE tpr END, 6) AS selection_score
FROM tt ORDER BY (tpr >= 0.8) DESC, CASE WHEN tpr >= 0.8 THEN -fpr ELSE tpr END DESC, CASE WHEN tpr >= 0.8 THEN tpr ELSE -fpr END DESC, tau LIMIT 1""",
    "calibration_report": f"""{_CAL}, o AS ({_cal_metrics("split")}), dd AS ({_cal_metrics("split, dataset")}), ss AS ({_cal_metrics("split, dataset, subcategory")}),
mm AS (SELECT split, avg(component) AS mean FROM dd GROUP BY split), un AS (
  SELECT 'overall' AS "table", split, NULL::VARCHAR AS dataset, NULL::VARCHAR AS subcategory, o.* EXCLUDE (split, component), mean AS component FROM o JOIN mm USING (split)
  UNION ALL BY NAME SELECT 'dataset' AS "table", split, dataset, NULL::VARCHAR AS subcategory, dd.* EXCLUDE (split, dataset) FROM dd
  UNION ALL BY NAME SELECT 'subcategory' AS "table", split, dataset, subcategory, ss.* EXCLUDE (split, dataset, subcategory) FROM ss
) SELECT "table", split, dataset, subcategory, mode, num_cases, num_pairs, {_ROUNDED} FROM un""",
    "calibration_by_type": f"""{_CAL}, neg AS (SELECT *, COALESCE(nullif(negative_type, ''), '__all__') AS kind FROM c WHERE pair_type = 'negative'), kt AS (
  SELECT * FROM neg UNION ALL BY NAME SELECT c.*, k.kind FROM c JOIN (SELECT DISTINCT dataset, case_id, kind FROM neg) k USING (dataset, case_id) WHERE pair_type = 'positive'
), m2 AS ({_cal_metrics("split, dataset, kind", "kt")}) SELECT split, dataset, kind, mode, num_cases, num_pairs, {_ROUNDED} FROM m2""",
    "cosine_pairs": """SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "path_resolve": """WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS name FROM pages), m AS (SELECT DISTINCT CASE page_id % 3 WHEN 1 THEN 'images/' || name ELSE name END AS member FROM p WHERE page_id % 3 <> 0)
SELECT page_id, CASE WHEN name IN (SELECT member FROM m) THEN name WHEN 'images/' || name IN (SELECT member FROM m) THEN 'images/' || name END AS member FROM p""",
    "label_reconcile": """WITH f AS (SELECT c_custkey, c_custkey % 2 = 0 AS a, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS b, c_custkey % 7 = 0 AS bad FROM customer)
SELECT c_custkey, CASE WHEN bad OR (b IS NOT NULL AND a <> b) THEN NULL ELSE a::INT END AS label, bad OR (b IS NOT NULL AND a <> b) AS conflict FROM f""",
    "text_coercion": rf"""WITH p AS (SELECT *, 'Images/' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand || '\' END || CASE WHEN p_partkey % 5 = 0 THEN '_ .' ELSE p_name END || '.jsonl' AS path FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_name END AS first, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_type || '|' || p_name || '|' || p_name END AS texts,
  CASE WHEN p_partkey % 2 = 0 THEN '  ' ELSE p_name END || '|' || ' ' || chr(9) || p_type || chr(10) AS "unique", {_label("p_type")} AS label, {_label("path")} AS path_label,
  CASE WHEN p_partkey % 3 = 0 THEN {_label("path")} ELSE {_label("p_brand")} END AS subcategory FROM p""",
    "json_in_text": "SELECT event_id, json(props)::VARCHAR AS object, 's' || event_id AS segment FROM events",
    "bertscore": """WITH t AS (SELECT vec_id // 16 AS pair, vec_id % 2 AS odd, vec_id, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT a.pair, a.vec_id AS i, b.vec_id AS j, list_dot_product(a.e, b.e) AS s FROM t a JOIN t b ON a.pair = b.pair AND a.odd = 0 AND b.odd = 1),
g AS (SELECT DISTINCT pair FROM t), p AS (SELECT pair, avg(m) AS p FROM (SELECT pair, j, max(s) AS m FROM c GROUP BY ALL) GROUP BY pair), r AS (SELECT pair, avg(m) AS r FROM (SELECT pair, i, max(s) AS m FROM c GROUP BY ALL) GROUP BY pair)
SELECT pair, round(COALESCE(p, 0), 6) AS "precision", round(COALESCE(r, 0), 6) AS recall, round(COALESCE(CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) END, 0), 6) AS f1 FROM g LEFT JOIN p USING (pair) LEFT JOIN r USING (pair)""",
    "lexical_scorer": rf"""{_CASES}, n AS (SELECT *, unnest(negatives) AS neg, generate_subscripts(negatives, 1) - 1 AS i FROM cs), q AS (
  SELECT case_id, 'positive_pair' AS pair_type, NULL::INT AS negative_index, anchor AS a, positive AS b FROM cs WHERE mode = 'ranking' UNION ALL SELECT case_id, 'negative_pair', i::INT, CASE WHEN mode = 'ranking' THEN anchor ELSE positive END, neg FROM n WHERE mode <> 'other'
), w AS (SELECT *, list_distinct(regexp_extract_all(lower(a), '\S+')) AS x, list_distinct(regexp_extract_all(lower(b), '\S+')) AS y FROM q)
SELECT case_id, pair_type, negative_index, round(len(list_intersect(x, y)) / len(list_distinct(x || y)), 6) AS raw_score, NULL::VARCHAR AS error FROM w""",
    "reward_levels": f"""{_COLLECTED} SELECT CASE WHEN grouping(source) = 1 THEN 2 WHEN grouping(subcategory) = 1 THEN 0 ELSE 1 END AS level, source, dataset, subcategory, scorer, score_field, {_means(_SCALED)}
FROM co GROUP BY GROUPING SETS ((source, dataset, scorer, score_field), (source, dataset, subcategory, scorer, score_field), (scorer, score_field))""",
    "sorted_rewards": f"{_COLLECTED} SELECT scorer, score_field, {_means(_PLAIN)} FROM co WHERE source = 'caption_negation' AND scorer <> 'nli_calibrated_logistic' GROUP BY ALL ORDER BY scorer, score_field LIMIT 5",
    "sensitivity_fields": f"""{_COLLECTED}, su AS (
  SELECT scorer, f AS score_field, CASE WHEN mode = 'ranking' THEN 'hn' ELSE 'neg' END AS family, mode, pair_type, case_id, v AS value, line FROM (
    SELECT *, unnest(['nli_score_coverage', 'nli_score_equiv', 'E_ab', 'E_ba', 'C_ab', 'C_ba']) AS f, unnest([E_ab * 0.5, t * 0.5, E_ab, E_ba, C_ab, C_ba]) AS v FROM ca WHERE scorer = 'nli'
    UNION ALL BY NAME SELECT *, unnest(['bertscore_precision', 'bertscore_recall', 'bertscore_f1']) AS f, unnest([raw_score, t, (raw_score + t) / 2]) AS v FROM ca WHERE scorer = 'bertscore'
    UNION ALL BY NAME SELECT *, CASE WHEN scorer = 'bge_reranker' THEN 'sigmoid_raw_score' ELSE 'raw_score' END AS f, CASE WHEN scorer = 'bge_reranker' THEN 1.0::DOUBLE / (1.0::DOUBLE + exp(-raw_score)) ELSE raw_score END AS v FROM ca WHERE scorer NOT IN ('nli', 'bertscore'))
  UNION ALL
  SELECT scorer, score_field, 'num', mode, pair_type, case_id, CASE WHEN scorer = 'bge_reranker' THEN 1.0::DOUBLE / (1.0::DOUBLE + exp(-score)) ELSE score END, line
  FROM (SELECT *, row_number() OVER (PARTITION BY case_id, negative_type, pair_type, scorer, score_field, score ORDER BY line) AS n FROM nu) WHERE n = 1
), g AS (
  SELECT scorer, score_field, tau, avg((value >= tau)::INT) FILTER (family = 'hn' AND pair_type = 'negative') AS hn, avg((value >= tau)::INT) FILTER (family = 'neg' AND pair_type = 'negative') AS neg, avg((value >= tau)::INT) FILTER (family = 'num' AND pair_type = 'negative') AS num
  FROM (SELECT * FROM su WHERE value IS NOT NULL), (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS tau) GROUP BY ALL
), m AS (
  SELECT scorer, score_field, family, case_id, arg_max(value, line) FILTER (pair_type = 'positive') - max(value) FILTER (pair_type = 'negative') AS margin FROM su WHERE value IS NOT NULL AND mode = 'ranking' AND family IN ('hn', 'num') GROUP BY ALL
), r AS (
  SELECT scorer, score_field, avg((margin > 0)::INT) AS acc, avg((margin > 0)::INT) FILTER (family = 'hn') AS hacc, avg((margin > 0)::INT) FILTER (family = 'num') AS nacc FROM m WHERE margin IS NOT NULL GROUP BY ALL
) SELECT scorer, score_field, tau, round(hn, 6) AS hn_fpr, round(neg, 6) AS neg_fpr, round(num, 6) AS num_fpr, round(acc, 6) AS ranking_acc, round(hacc, 6) AS hn_ranking_acc, round(nacc, 6) AS num_ranking_acc FROM g LEFT JOIN r USING (scorer, score_field)""",
    "calibration_load": f"""{_COLLECTED}, e AS (SELECT *, CASE WHEN pair_type = 'odd' THEN 'Unsupported pair_type' WHEN E_ba IS NULL THEN 'Missing NLI fields: E_ba' END AS error FROM ca WHERE scorer = 'nli'),
d AS (SELECT *, row_number() OVER (PARTITION BY dataset, case_id, mode, pair_type, negative_type, E_ab, E_ba, C_ab, C_ba, N_ab, N_ba, CASE WHEN error IS NOT NULL THEN line END ORDER BY line) AS n FROM e)
SELECT dataset, subcategory, mode, error, count(*)::BIGINT AS n, sum(CASE pair_type WHEN 'positive' THEN 1 WHEN 'negative' THEN 0 END)::BIGINT AS n_positive, round(sum(greatest(C_ab, C_ba)) FILTER (E_ba IS NOT NULL), 4) AS c_max FROM d WHERE n = 1 GROUP BY ALL""",
    "calibration_predictions": f"{_CAL} SELECT dataset, label, score >= 0.5 AS predicted_compatible, count(*)::BIGINT AS n, round(avg(E_ab), 6) AS E_ab, round(avg(greatest(C_ab, C_ba)), 6) AS C_max, round(avg(greatest(N_ab, N_ba)), 6) AS N_max FROM c GROUP BY ALL",
    "fixed_tau": f"{_TAU_TABLE} SELECT tau, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(balanced, 6) AS balanced, round(fpr, 6) AS selection_score FROM tt WHERE abs(tau - 0.6) < 1e-9",
    "separation_cases": """SELECT 'parts::' || p_brand || '::' || p_partkey AS case_id, 'parts' AS dataset, p_brand AS subcategory, 'separation' AS mode, p_name AS anchor, p_name AS positive, 'no ' || p_name AS negatives
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 5 <> 0) WHERE n <= 20""",
    "ranking_cases": """SELECT 'parts::types::' || CASE WHEN p_partkey % 4 = 0 THEN place ELSE p_partkey END AS case_id, 'parts' AS dataset, 'types' AS subcategory, 'ranking' AS mode, p_name AS anchor, p_type AS positive, 'no ' || p_name AS negatives
FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part) WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0""",
    "choice_cases": """WITH c AS (SELECT *, p_partkey % 6 = 0 AS plain, p_partkey % 2 = 1 AS second FROM part)
SELECT 'choices::parts::file::' || p_partkey AS case_id, 'choices' AS dataset, 'parts' AS subcategory, 'separation' AS mode, CASE WHEN plain OR NOT second THEN p_name ELSE p_type END AS anchor, anchor AS positive,
  CASE WHEN plain THEN CASE WHEN p_brand = p_type THEN p_brand ELSE p_brand || '|' || p_type END ELSE CASE WHEN second THEN p_name ELSE p_type END || CASE WHEN p_partkey % 4 <> 0 THEN '|' || p_brand ELSE '' END END AS negatives FROM c""",
    "evaluation_input": """WITH c AS (SELECT *, c_custkey AS k FROM customer) SELECT k AS row_index, CASE WHEN k % 11 = 0 THEN '' ELSE c_name END AS anchor, CASE WHEN k % 13 <> 0 THEN c_mktsegment || ' "é"' END AS generated, CASE k % 4 WHEN 1 THEN 1 WHEN 0 THEN -1 END AS compatibility_label,
  CASE WHEN k % 2 = 0 THEN c_mktsegment ELSE 'UNKNOWN' END AS data_source, (k % 3)::VARCHAR AS policy_model, CASE WHEN k % 17 = 0 THEN '' ELSE k::VARCHAR END AS pair_id, CASE WHEN k % 3 = 0 THEN k % 9 END AS step_index, '"c"' AS category,
  CASE WHEN k % 11 = 0 THEN 'no non-empty string ''anchor''' WHEN k % 13 = 0 THEN 'no non-empty string ''generated''' WHEN k % 4 > 1 THEN 'invalid ''compatibility_label''' WHEN k % 17 = 0 THEN 'invalid ''pair_id''' END AS error FROM c""",
    "normalized_pairs": """WITH c AS (
  SELECT c_custkey AS k, c_mktsegment AS seg, CASE WHEN k % 11 = 0 THEN '' ELSE c_name END AS anchor, CASE WHEN k % 13 <> 0 THEN c_mktsegment || ' "é"' END AS generated, CASE WHEN k % 3 = 0 THEN k % 9 END AS step,
         CASE WHEN k % 5 < 3 THEN (k % 2 = 0)::INT END AS word, CASE WHEN k % 5 > 1 THEN CASE k % 3 WHEN 2 THEN 1 WHEN 0 THEN 0 END END AS process FROM customer
), e AS (SELECT *, CASE WHEN anchor = '' THEN 'no non-empty string ''anchor''' WHEN generated IS NULL THEN 'no non-empty string ''generated''' WHEN word <> process THEN 'conflicting labels' END AS error, COALESCE(process, word) AS label,
  CASE WHEN k % 4 = 0 THEN k::VARCHAR ELSE 'vpb_' || substr(sha256('{"anchor":"' || anchor || '","data_source":"' || seg || '","image":null,"policy_model":null,"question":"why?"}'), 1, 20) END AS sample FROM c)
SELECT k AS line, CASE WHEN error IS NULL THEN 'pair_' || substr(sha256('{"anchor":"' || anchor || '","generated":"' || replace(generated, '"', '\\"') || '","source_sample_id":' || CASE WHEN k % 4 = 0 THEN sample ELSE '"' || sample || '"' END || ',"step_index":' || COALESCE(step::VARCHAR, 'null') || '}'), 1, 20) END AS pair_id,
  sample AS source_sample_id, step AS step_index, seg AS data_source, anchor, generated, label AS compatibility_label, error FROM e WHERE error IS NOT NULL OR label IS NOT NULL""",
    "trace_rows": rf"""SELECT o_orderkey AS line, CASE WHEN o_orderkey % 4 IN (0, 2) THEN o_orderkey::VARCHAR ELSE 'visualprm_' || lpad(o_orderkey::VARCHAR, greatest(6, length(o_orderkey::VARCHAR))::INT, '0') END AS trace_id, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus ELSE '' END AS question,
  CASE o_orderkey % 4 WHEN 0 THEN 'a' || chr(10) || o_orderpriority WHEN 1 THEN o_orderpriority WHEN 2 THEN '{{"a": ' || o_orderkey || ', "z": "' || o_orderstatus || '"}}' ELSE '' END AS reasoning,
  CASE o_orderkey % 4 WHEN 0 THEN 'x_y' WHEN 1 THEN {_label("o_orderstatus")} ELSE 'orders' END AS subcategory, CASE WHEN o_orderkey % 4 = 0 THEN 'raw/x y.jsonl' ELSE 'orders.jsonl' END AS source, CASE WHEN o_orderkey % 4 = 3 THEN 'not a JSON object' END AS error FROM orders""",
    "canonical_rows": f"""WITH {_STEPS}, g AS (SELECT source_sample_id AS name, regexp_extract(source_sample_id, '[0-9]+')::BIGINT AS line, list(step ORDER BY step_index) AS steps FROM st GROUP BY 1)
SELECT line, 'Question of ' || name AS question, 'a.png|b.png' AS images, len(steps)::BIGINT AS n_steps, md5(array_to_string(steps, '|')) AS digest,
  CASE WHEN line % 3 = 0 THEN line::VARCHAR ELSE 'visualprm_' || substr(sha256('{{"images": ["a.png", "b.png"], "question": "Question of ' || name || '", "steps": ["' || array_to_string(steps, '", "') || '"]}}'), 1, 20) END AS source_sample_id, NULL::VARCHAR AS error FROM g""",
    "step_label_counts": f"WITH {_STEPS} SELECT label, count(*)::BIGINT AS n FROM st GROUP BY label",
    "canonical_violations": """SELECT o_orderkey AS line, 'row ' || o_orderkey || ' ' || CASE WHEN o_orderkey % 11 = 0 THEN 'is missing fields: images' WHEN o_orderkey % 5 = 0 THEN 'has misaligned steps and step_labels' WHEN o_orderkey % 7 = 0 THEN 'contains an empty or non-string step'
  WHEN o_orderkey % 3 = 0 THEN 'contains a label outside -1, 0, 1' WHEN o_orderkey % 13 = 0 THEN 'is missing metadata.source_sample_id' END AS violation FROM orders""",
    "supervised_examples": r"""WITH c AS (SELECT c_custkey AS line, CASE c_custkey % 3 WHEN 0 THEN 'be brief' || chr(10) || c_name WHEN 1 THEN '<image> ' || c_name END AS prompt, c_mktsegment AS response FROM customer)
SELECT *, 'j.png|i.png' AS images, '[{"role":"user","content":[{"type":"image","image":"j.png"},{"type":"image","image":"i.png"},{"type":"text"' || COALESCE(',"text":"' || replace(regexp_replace(prompt, '^<image> ', ''), chr(10), '\n') || '"', '') || '}]},{"role":"assistant","content":[{"type":"text","text":"' || response || '"}]}]' AS chat,
  CASE WHEN prompt IS NULL THEN 'no prompt and response fields' END AS error FROM c""",
    "generated_cases": f"{_GENERATED} SELECT k AS case_id, CASE WHEN k % 7 <> 0 AND k % 6 <> 0 THEN p_name END AS positive, CASE WHEN k % 7 = 0 THEN '' ELSE concat_ws('|', 'value_flip:' || value, 'relation_flip:' || relation) END AS negatives, error FROM g",
    "numeric_pairs": f"""{_GENERATED} SELECT k AS case_id, k % 10 AS trace_id, 'visualprm' AS dataset, p_brand AS subcategory, 'ranking' AS mode, u.kind AS negative_type, CASE WHEN u.kind IS NULL THEN 'positive' ELSE 'negative' END AS pair_type, p_name AS text_a, u.said AS text_b
FROM (SELECT *, unnest([{{'kind': NULL, 'said': p_name}}, {{'kind': 'value_flip', 'said': value}}, {{'kind': 'relation_flip', 'said': relation}}]) AS u FROM g WHERE error IS NULL) WHERE u.said IS NOT NULL""",
    "prompts": f"""SELECT p_partkey, md5(CASE WHEN p_partkey % 3 = 0 THEN {_quoted(HARD_NEGATIVE)} ELSE {_quoted(PARAPHRASE)} END || chr(10) || 'Return only {{"generated_segment":"..."}}.' ||
  CASE WHEN p_partkey % 2 = 0 THEN repeat(chr(10), 2) || 'Examples:' || chr(10) || array_to_string(list_transform([1, 2], lambda i: 'Anchor:' || chr(10) || p_type || chr(10) || 'Generated:' || chr(10) || p_brand), repeat(chr(10), 2)) ELSE '' END || repeat(chr(10), 2) || 'Anchor:' || chr(10) || p_name) AS pair,
  md5(replace({_quoted(SEGMENT_TEMPLATE)}, '{{segment}}', p_name)) AS segment FROM part""",
    "token_gates": """WITH r AS (SELECT o_orderkey, (o_custkey % 300)::INT AS a, (o_orderkey % 4200)::INT AS p FROM orders), b AS (SELECT *, greatest(0, least(greatest(64, floor(a * 1.1::DOUBLE)::INT + 16), 4096 - p, 512)) AS m FROM r)
SELECT o_orderkey, m AS max_output_tokens, CASE WHEN a > 224 THEN 'DebertaAnchorTooLong' WHEN m < 64 OR p + m > 4096 THEN 'QwenContextOverflow' END AS error_type FROM b""",
    "profiles": f"{_REQUESTS} SELECT pair_id, source_sample_id, step_index, compatibility_label, anchor, upper(anchor) AS generated, generation_type, generation_seed FROM r",
    "capped_cases": f"""WITH {_S}, i AS (SELECT dataset, case_id, row_number() OVER (PARTITION BY dataset ORDER BY {_hash("dataset", "case_id")}, case_id) AS n FROM (SELECT DISTINCT dataset, case_id FROM s))
SELECT dataset, count(DISTINCT case_id)::BIGINT AS n_cases, count(*)::BIGINT AS n_rows, sum(case_id)::BIGINT AS sum_cases FROM s JOIN i USING (dataset, case_id) WHERE n <= 100 GROUP BY dataset""",
}

_ARCHIVED = """t AS (SELECT conv_id, string_split(string_agg(text, chr(10) ORDER BY turn), chr(10)) AS ls FROM conversations GROUP BY conv_id),
a AS (SELECT 'part-' || conv_id % 4 || printf('-%06d', conv_id // 100000) AS archive, printf('conv/%012d.jsonl', conv_id) AS member, unnest(ls) AS value, generate_subscripts(ls, 1)::BIGINT AS line FROM t),
b AS (SELECT archive, member, line, row_number() OVER (ORDER BY archive, member, line) - 1 AS row_index, sha256(CASE WHEN value LIKE '%' || chr(13) THEN value[:-2] ELSE value END) AS digest FROM a WHERE trim(value, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '')"""

SQL |= {
    "archive_lines": f"WITH {_ARCHIVED} SELECT * FROM b",
    "archive_rows": f"WITH {_ARCHIVED} SELECT p_partkey AS position, row_index, member, line, digest FROM b JOIN part ON row_index = p_partkey * 7 % 5000",
    "archive_members": """SELECT page_id, 'pages-' || page_id % 4 || printf('-%06d', page_id // 100000) AS archive, CASE WHEN page_id % 3 = 0 THEN 'stored' ELSE 'deflated' END AS method, octet_length(encode(COALESCE(html, '')))::BIGINT AS size, true AS same_crc, sha256(COALESCE(html, '')) AS digest FROM pages""",
}

SQL |= {
    "context_evaluation": """WITH c AS (SELECT c_custkey AS k, c_name, c_mktsegment AS seg, printf('judged-%06d', c_custkey // 100000) AS file,
  row_number() OVER w + COALESCE(count(*) FILTER (c_custkey % 4 = 0) OVER (PARTITION BY c_custkey // 100000 ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM customer WINDOW w AS (PARTITION BY c_custkey // 100000 ORDER BY c_custkey)),
r AS (
  SELECT *, CASE WHEN k % 5 = 0 THEN '' ELSE c_name END AS second, 'é ' || seg AS third, CASE WHEN k % 25 = 0 THEN [1, -1, 1] ELSE [1, 0, -1] END AS labels,
    CASE WHEN k % 59 = 0 THEN 'invalid JSON' WHEN k % 61 = 0 THEN 'not a JSON object' WHEN k % 53 = 0 THEN 'no non-empty string ''question''' WHEN k % 41 = 0 THEN 'no response object' WHEN k % 43 = 0 THEN 'response.steps must be a list'
         WHEN k % 47 = 0 THEN 'no response steps' WHEN k % 31 <> 0 AND k % 37 = 0 THEN 'step/label length mismatch' WHEN k % 31 <> 0 AND k % 25 = 0 THEN 'an empty non-neutral response step at index 1' WHEN k % 29 = 0 THEN 'an invalid step at index 2'
         WHEN k % 31 = 0 THEN 'invalid process_correctness at step index 2' END AS error,
    k % 59 <> 0 AND k % 61 <> 0 AS parsed, CASE WHEN parsed AND k % 4 = 1 THEN 'm' ELSE 'UNKNOWN' END AS policy_model, CASE WHEN parsed THEN seg ELSE 'UNKNOWN' END AS data_source
  FROM c
), s AS (
  SELECT *, CASE WHEN k % 4 = 0 THEN k::VARCHAR WHEN k % 4 = 1 THEN 'c' || k ELSE 'vpb_' || substr(sha256('{"data_source":"' || seg || '","image":null,"policy_model":"UNKNOWN","question":"why?"}'), 1, 20) END AS sample FROM r
), e AS (
  SELECT *, unnest(['first', second, third]) AS generated, unnest(range(3)) AS step_index, 'Question:' || chr(10) || 'why?' AS q FROM s WHERE error IS NULL
)
SELECT file, line AS row_index, step_index, md5(CASE step_index WHEN 0 THEN q ELSE q || chr(10) || chr(10) || 'Previous response steps:' || chr(10) || '1. first' || CASE WHEN step_index = 2 AND second <> '' THEN chr(10) || '2. ' || second ELSE '' END END) AS anchor, generated, labels[step_index + 1] AS compatibility_label,
  data_source, policy_model, 'vpb_step_' || substr(sha256('{"source_sample_id":' || CASE WHEN k % 4 = 0 THEN sample ELSE '"' || sample || '"' END || ',"step":"' || generated || '","step_index":' || step_index || '}'), 1, 20) AS pair_id, sample AS source_sample_id, 'context_step' AS input_mode, error
FROM e WHERE generated <> ''
UNION ALL SELECT file, line, NULL, NULL, NULL, NULL, data_source, policy_model, NULL, NULL, 'context_step', error FROM s WHERE error IS NOT NULL""",
    "loaded_traces": """WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS p, o_orderkey % 3 || printf('-%06d', o_orderkey // 100000) AS part, 'part ' || part || '.jsonl' AS file, row_number() OVER (PARTITION BY o_orderkey % 3, o_orderkey // 100000 ORDER BY o_orderkey) AS row_index FROM orders),
n AS (SELECT *, CASE k % 10 WHEN 3 THEN 'not a JSON object' WHEN 7 THEN 'invalid JSON' WHEN 2 THEN 'Missing reasoning text' END AS error, CASE WHEN k % 10 = 1 THEN 't' || k ELSE 'part_' || part || '_visualprm_' || lpad(row_index::VARCHAR, greatest(6, length(row_index::VARCHAR))::INT, '0') END AS name, k % 10 IN (3, 7) AS broken FROM o)
SELECT file, row_index, CASE WHEN NOT broken THEN name END AS trace_id, CASE WHEN error IS NULL THEN CASE WHEN k % 10 = 1 THEN '' ELSE 'q' END END AS question, CASE WHEN error IS NULL THEN CASE WHEN k % 10 = 1 THEN 'a' || chr(10) || p ELSE p END END AS reasoning,
  CASE WHEN NOT broken THEN file END AS source, CASE WHEN broken THEN NULL WHEN k % 10 = 1 THEN 'x_y' ELSE 'part_' || part END AS subcategory, error FROM n""",
    "loaded_cases": """WITH p AS (SELECT p_partkey AS k, *, regexp_extract(p_brand, '([0-9]+)$', 1)::INT AS b, k // 100000 AS run, p_brand || printf('-%06d', run) AS brand FROM part),
d AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY k) - 1 AS place FROM p),
s AS (SELECT 'parts::' || brand || '::' || CASE WHEN b % 2 = 0 THEN place::VARCHAR ELSE 'k' || k END AS case_id, brand AS subcategory, 'separation' AS mode, p_name AS positive, 'no ' || p_name AS negatives, row_number() OVER (PARTITION BY brand ORDER BY k) AS n FROM d WHERE b % 7 <> 0 AND k % 11 <> 0 AND k % 5 <> 0),
l AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS place, row_number() OVER (PARTITION BY run ORDER BY k) AS line FROM p WHERE b < 20)
SELECT case_id, subcategory, mode, positive, negatives, NULL::VARCHAR AS error FROM s WHERE n <= 40
UNION ALL SELECT 'parts::lines::' || CASE WHEN k % 2 = 0 THEN k ELSE place END, 'lines', 'ranking', p_type, 'no ' || p_name, NULL FROM l WHERE k % 13 <> 0 AND k % 11 <> 0 AND k % 5 <> 0
UNION ALL SELECT NULL, brand, NULL, NULL, NULL, 'invalid JSON' FROM (SELECT DISTINCT brand FROM p WHERE b % 7 = 0)
UNION ALL SELECT NULL, 'lines', NULL, NULL, NULL, printf('lines-%06d', run) || ':' || line || ': not a JSON object' FROM l WHERE k % 13 = 0 OR k % 11 = 0""",
}

SQL["state_snapshot"] = SQL["state_latest"]

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_SIDES = ", ".join(f"COALESCE(sum(('0x' || substr(md5(w), {k}, 1))::INT - 7.5::DOUBLE), 0) AS v{k}" for k in range(1, 9))
_DOT = lambda x, y: "(" + " + ".join(f"{x}.v{k} * {y}.v{k}" for k in range(1, 9)) + ")"

SQL |= {
    "table_scorer": f"""WITH a AS (SELECT p_partkey, {_SIDES} FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part) WHERE length(w) % 11 <> 0 GROUP BY p_partkey),
b AS (SELECT p_partkey, {_SIDES} FROM (SELECT p_partkey, unnest(string_split(lower(p_type), ' ')) AS w FROM part) WHERE length(w) % 11 <> 0 GROUP BY p_partkey)
SELECT p_partkey, 'word_table' AS scorer, round(COALESCE(CASE WHEN {_DOT("a", "a")} * {_DOT("b", "b")} > 0 THEN {_DOT("a", "b")} / sqrt({_DOT("a", "a")} * {_DOT("b", "b")}) END, 0), 6) AS raw_score, NULL::VARCHAR AS error FROM part LEFT JOIN a USING (p_partkey) LEFT JOIN b USING (p_partkey)""",
    "text_gates": f"""WITH c AS (SELECT doc_id, COALESCE(len({_WORDS.format("string_split(text, chr(10))[1]")}), 0)::INT AS a, COALESCE(len({_WORDS.format("text")}), 0)::INT AS p FROM documents),
b AS (SELECT *, greatest(0, least(greatest(64, floor(a * 1.1::DOUBLE)::INT + 16), 1024 - p, 512))::INT AS m FROM c)
SELECT doc_id, a AS anchor_tokens, p AS prompt_tokens, m AS max_output_tokens, CASE WHEN a > 224 THEN 'DebertaAnchorTooLong' WHEN m < 64 OR p + m > 1024 THEN 'QwenContextOverflow' END AS error_type FROM b""",
    "training_pairs": """WITH c AS (SELECT c_custkey, c_name, c_mktsegment, (c_custkey % 9)::INT AS n, (c_custkey % 7)::INT AS m, (c_custkey % 2)::INT AS labels FROM customer),
w AS (SELECT *, regexp_extract_all(repeat(c_name || ' ', n), '[^ ]+') AS a, regexp_extract_all(repeat(c_mktsegment || ' ' || c_name || ' ', m), '[^ ]+') AS b FROM c),
l AS (SELECT *, len(a) AS la, len(b) AS lb, CASE WHEN len(a) + len(b) <= 9 THEN len(a) WHEN len(a) <= len(b) THEN CASE WHEN len(a) <= 4 THEN len(a) ELSE 5 END WHEN len(b) <= 4 THEN 9 - len(b) ELSE 5 END AS ka FROM w),
k AS (SELECT *, CASE WHEN la + lb <= 9 THEN lb ELSE 9 - ka END AS kb FROM l),
i AS (SELECT *, list_transform(a[1:ka], lambda x: ('0x' || substr(md5(x), 1, 4))::INT) AS ia, list_transform(b[1:kb], lambda x: ('0x' || substr(md5(x), 1, 4))::INT) AS ib FROM k)
SELECT c_custkey, array_to_string([1] || ia || [2] || ib || [2] || list_transform(range(9 - ka - kb), lambda x: 0), ',') AS input_ids, (3 + ka + kb)::INT AS length, (3 + la + lb)::INT AS n_tokens, la + lb > 9 AS truncated, labels, NULL::VARCHAR AS error FROM i""",
}

SQL |= {
    "table_files": f"WITH r AS ({SQL['reward_by_dataset']}) SELECT form, r.* FROM r, (SELECT unnest(['csv', 'jsonl', 'staged', 'parquet']) AS form)",
    "state_stream": SQL["state_latest"],
    "numbered_lines": """WITH o AS (SELECT o_orderkey AS k, 'part' || o_orderkey % 4 || printf('-%06d', o_orderkey // 100000) AS file FROM orders)
SELECT file, row_number() OVER w + COALESCE(count(*) FILTER (k % 5 = 0) OVER (PARTITION BY file ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line, 'row_' || lpad((row_number() OVER (ORDER BY file, k))::VARCHAR, 12, '0') AS row_id, k FROM o WINDOW w AS (PARTITION BY file ORDER BY k)""",
    "archive_counts": f"WITH {_ARCHIVED} SELECT archive, count(*)::BIGINT AS n FROM b GROUP BY archive",
}

SQL["gate_errors"] = f"""WITH c AS (SELECT doc_id, source, string_split(text, chr(10))[1] AS anchor, COALESCE(len({_WORDS.format("string_split(text, chr(10))[1]")}), 0)::INT AS a, COALESCE(len({_WORDS.format("text")}), 0)::INT AS p FROM documents),
b AS (SELECT *, greatest(0, least(greatest(64, floor(a * 1.1::DOUBLE)::INT + 16), 1024 - p, 512))::INT AS m FROM c)
SELECT doc_id AS pair_id, CASE WHEN a > 224 THEN 'DebertaAnchorTooLong' ELSE 'QwenContextOverflow' END AS error_type, CASE WHEN a > 224 THEN 'Anchor exceeds the configured DeBERTa token limit' ELSE 'Prompt and output budget do not fit the context window' END AS error_message,
  CASE WHEN a > 224 THEN a END AS observed_tokens, CASE WHEN a <= 224 THEN p END AS prompt_tokens, CASE WHEN a <= 224 THEN m END AS max_output_tokens, CASE WHEN a <= 224 THEN 64 END AS min_output_tokens, CASE WHEN a > 224 THEN 224 ELSE 1024 END AS "limit", source AS source_sample_id, md5(anchor) AS anchor
FROM b WHERE a > 224 OR m < 64 OR p + m > 1024"""
