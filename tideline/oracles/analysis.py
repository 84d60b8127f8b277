"""DuckDB SQL for the metric, bootstrap and cross-study queries."""

from tideline.oracles import device as D, facility as C, prescriber as P, trials as T
from tideline.oracles.facility import metrics_sql

DOCS = """
WITH s AS (SELECT doc_id, source AS cluster, lang, CAST(quality AS BIGINT) AS label, n_chars/(n_chars+1000) AS score_a, sp/(sp+200) AS score_b
  FROM labels JOIN (SELECT doc_id, source, lang, n_chars, length(text)-length(replace(text,' ','')) AS sp FROM documents) USING (doc_id)),
"""
PAIRS = """
pr AS (SELECT a.cluster, count(*) AS pairs,
  sum(CASE WHEN a.score_a>b.score_a THEN 1.0 WHEN a.score_a=b.score_a THEN 0.5 ELSE 0.0 END) AS wa,
  sum(CASE WHEN a.score_b>b.score_b THEN 1.0 WHEN a.score_b=b.score_b THEN 0.5 ELSE 0.0 END) AS wb
  FROM s a JOIN s b ON a.cluster=b.cluster AND a.label=1 AND b.label=0 GROUP BY ALL),
pc AS (SELECT cluster, coalesce(pairs,0) AS pairs, CAST(coalesce(wa,0) AS DOUBLE) AS wins_score_a, CAST(coalesce(wb,0) AS DOUBLE) AS wins_score_b
  FROM (SELECT DISTINCT cluster FROM s) LEFT JOIN pr USING (cluster)),
"""
DRAWS = """
ci AS (SELECT cluster, row_number() OVER (ORDER BY cluster)-1 AS idx FROM (SELECT DISTINCT cluster FROM s)),
nc AS (SELECT count(*) AS n FROM ci),
dr AS (SELECT i//n AS r, CAST('0x'||substr(sha256('410|'||(i//n)||'|'||(i%n)),1,15) AS BIGINT)%n AS idx FROM nc CROSS JOIN range(0, 200*(SELECT n FROM nc)) t(i)),
mu AS (SELECT r, cluster, count(*) AS m FROM dr JOIN ci USING (idx) GROUP BY ALL),
"""


def _m(side: str, alias: str) -> str:
    """Ungrouped metrics of one score column under prefixed relation names."""
    sql = metrics_sql("s", "", "doc_id", score=f"score_{side}")
    for name in ("ra", "rb", "mt"):
        sql = sql.replace(f"{name} AS", f"{name}{alias} AS").replace(f"FROM {name} ", f"FROM {name}{alias} ").replace(f"FROM {name})", f"FROM {name}{alias})")
    return sql


def _rank_boot(side: str) -> str:
    s = f"score_{side}"
    return f"""
u{side} AS (SELECT r, label, {s} AS x, row_number() OVER (PARTITION BY r ORDER BY {s} DESC, doc_id, cp) AS i,
   rank() OVER (PARTITION BY r ORDER BY {s})+(count(*) OVER (PARTITION BY r, {s})-1)/2.0::DOUBLE AS ar FROM w),
v{side} AS (SELECT *, sum(label) OVER (PARTITION BY r ORDER BY i) AS h FROM u{side}),
b{side} AS (SELECT r, sum(CASE WHEN label=1 THEN h/i END)/nullif(sum(label),0) AS ap,
   (sum(CASE WHEN label=1 THEN ar END)-sum(label)*(sum(label)+1)/2.0::DOUBLE)/nullif(CAST(sum(label) AS DOUBLE)*(count(*)-sum(label)),0) AS auc FROM v{side} GROUP BY r)"""


FAMILY = "CASE method WHEN 'global_popularity' THEN 'local_popularity' WHEN 'prevalence' THEN 'local_popularity' WHEN 'prior_serious_rate' THEN 'local_history' ELSE 'relational_heuristic' END"


def _unify(relation: str, task: str, scope: str, source: str, cells: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{task}' AS task, method, {FAMILY} AS method_family, 'test' AS split, '{scope}' AS scope, '{d}' AS denominator_scope, '{m}' AS metric, "
        f"'{'lower_is_better' if m == 'brier' else 'higher_is_better'}' AS direction, CAST({e} AS DOUBLE) AS value, '{source}' AS source_artifact FROM {relation}"
        for m, (e, d) in cells.items()
    )


def _unified() -> str:
    pool = D.POOL.replace("round(", "(").replace(",6)", ")")
    dev = "dv AS (" + (D.BASE + D.ASOF + D.NEAR + D.SUPPORT + D.RANKS).strip() + f" SELECT method, {pool} FROM ent WHERE q>=8000 AND history_support>=1 GROUP BY method)"
    fac = "fv AS (" + (
        C.BASE + C.PREV
        + "sc AS (SELECT ccn, day, label, 'prevalence' AS method, score FROM pv WHERE year>=2000 UNION ALL SELECT ccn, day, label, 'prior_serious_rate', prior_serious_rate FROM pv WHERE year>=2000),"
        + metrics_sql("sc", "method", "day, ccn")
    ).strip() + " SELECT * FROM mt)"
    pre = "xv AS (" + (P.base("generic", "2001") + P.OVERLAP + P.ranks(P.M2) + ", e AS (" + P.entity("method, target, npi") + ")").strip() + f" SELECT method, {P.POOL.replace('round(', '(').replace(',6)', ')')} FROM e GROUP BY method)"
    ks = (5, 10, 20)
    a = _unify("dv", "maude", "2000Q1-2001Q4; threshold=1", "device", {**{f"recall_at_{k}": (f"micro_recall_at_{k}", "eligible positive edges") for k in ks}, **{f"macro_recall_at_{k}": (f"macro_recall_at_{k}", "eligible product-quarter macro average") for k in ks}, "mrr": ("mrr", "eligible product-quarter observations")})
    b = _unify("fv", "cms_nursing", "2000-2001 pooled", "facility", {m: (m, "all retained target inspection rows") for m in ("roc_auc", "average_precision", "top_decile_precision", "top_decile_recall", "brier")})
    c = _unify("xv", "partd_prescriber_drug", "2001 held-out; generic", "prescriber", {**{f"micro_recall_at_{k}": (f"micro_recall_at_{k}", "micro positives") for k in ks}, **{f"provider_macro_recall_at_{k}": (f"macro_recall_at_{k}", "provider macro average") for k in ks}, "mrr": ("mrr", "first relevant rank")})
    return f"WITH {dev}, {fac}, {pre}, un AS ({a} UNION ALL {b} UNION ALL {c})"


ORACLES = {
    "roc_auc": DOCS + _m("a", "1") + " SELECT roc_auc FROM mt1",
    "average_precision": DOCS + _m("b", "1") + " SELECT average_precision FROM mt1",
    "classification_metrics": DOCS + _m("a", "1") + " SELECT * FROM mt1",
    "sliced_metrics": DOCS + metrics_sql("s", "lang", "doc_id", score="score_a") + " SELECT * FROM mt",
    "recall_mrr_grouped": DOCS
    + """r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score_a DESC, doc_id) AS rank FROM s)
      SELECT cluster, round(count(*) FILTER (label=1 AND rank<=1)/nullif(sum(label),0),6) AS recall_at_1, round(count(*) FILTER (label=1 AND rank<=5)/nullif(sum(label),0),6) AS recall_at_5,
      round(count(*) FILTER (label=1 AND rank<=10)/nullif(sum(label),0),6) AS recall_at_10, round(1.0::DOUBLE/min(rank) FILTER (label=1),6) AS mrr FROM r GROUP BY cluster""",
    "pair_predictions": DOCS + "z AS (SELECT 1) SELECT doc_id, label, cluster, round(score_a,6) AS score_a, round(score_b,6) AS score_b FROM s WHERE label=1 OR doc_id%3>0",
    "pairwise_auc_diff": DOCS + PAIRS
    + "z AS (SELECT 1) SELECT cluster, pairs, round(wins_score_a,6) AS wins_score_a, round(wins_score_b,6) AS wins_score_b, round((wins_score_b-wins_score_a)/nullif(pairs,0),6) AS difference FROM pc",
    "paired_diff": DOCS + PAIRS + _m("a", "1").replace(",6)", ",14)") + "," + _m("b", "2").replace(",6)", ",14)")
    + """, j AS (SELECT 'roc_auc' AS metric, a.roc_auc AS va, b.roc_auc AS vb FROM mt1 a CROSS JOIN mt2 b UNION ALL SELECT 'average_precision', a.average_precision, b.average_precision FROM mt1 a CROSS JOIN mt2 b
      UNION ALL SELECT 'brier', a.brier, b.brier FROM mt1 a CROSS JOIN mt2 b UNION ALL SELECT 'pairwise_auc', sum(wins_score_a)/sum(pairs), sum(wins_score_b)/sum(pairs) FROM pc)
      SELECT metric, round(va,6) AS value_a, round(vb,6) AS value_b, round(vb-va,6) AS difference FROM j""",
    "cluster_bootstrap": DOCS + PAIRS + DRAWS
    + """bs AS (SELECT cluster, sum((score_b-label)*(score_b-label)-(score_a-label)*(score_a-label)) AS g, count(*) AS n FROM s GROUP BY ALL),
      al AS (SELECT cluster, g, n, wins_score_b-wins_score_a AS wg, pairs FROM bs JOIN pc USING (cluster)),
      rs AS (SELECT r, sum(g*m)/sum(n*m) AS brier, sum(wg*m*m)/nullif(sum(pairs*m*m),0) AS pw FROM al JOIN mu USING (cluster) GROUP BY r)
      SELECT 'brier' AS metric, round((SELECT sum(g)/sum(n) FROM al),6) AS estimate, round(quantile_cont(brier,0.025),6) AS lower, round(quantile_cont(brier,0.975),6) AS upper,
        count(brier) AS valid_resamples, CAST(200 AS BIGINT) AS resamples FROM rs
      UNION ALL SELECT 'pairwise_auc', round((SELECT sum(wg)/sum(pairs) FROM al),6), round(quantile_cont(pw,0.025),6), round(quantile_cont(pw,0.975),6), count(pw), 200 FROM rs""",
    "rank_bootstrap": DOCS + DRAWS
    + "w AS (SELECT r, label, score_a, score_b, doc_id, cp FROM s JOIN mu USING (cluster) CROSS JOIN range(1,30) t(cp) WHERE cp<=m UNION ALL SELECT -1, label, score_a, score_b, doc_id, 1 FROM s),"
    + _rank_boot("a") + "," + _rank_boot("b")
    + """, d AS (SELECT r, x.auc-y.auc AS auc, x.ap-y.ap AS ap FROM bb x JOIN ba y USING (r))
      SELECT 'roc_auc' AS metric, round((SELECT auc FROM d WHERE r=-1),6) AS estimate, round(quantile_cont(auc,0.025),6) AS lower, round(quantile_cont(auc,0.975),6) AS upper, count(auc) AS valid_resamples, CAST(200 AS BIGINT) AS resamples FROM d WHERE r>=0
      UNION ALL SELECT 'average_precision', round((SELECT ap FROM d WHERE r=-1),6), round(quantile_cont(ap,0.025),6), round(quantile_cont(ap,0.975),6), count(ap), 200 FROM d WHERE r>=0""",
    "unified_metrics": _unified() + " SELECT * EXCLUDE (value), round(value,6) AS value FROM un",
    "family_value": _unified()
    + """, p AS (SELECT * FROM un WHERE (task='maude' AND metric='recall_at_10') OR (task='cms_nursing' AND metric='roc_auc') OR (task='partd_prescriber_drug' AND metric='micro_recall_at_10')),
      l AS (SELECT task, method, value FROM p WHERE method IN ('global_popularity','prior_serious_rate') AND value IS NOT NULL),
      h AS (SELECT task, method, value FROM p WHERE method_family='relational_heuristic' AND value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task ORDER BY value DESC, method DESC)=1)
      SELECT t.task, l.method AS local_method, h.method AS relational_heuristic_method, CAST(NULL AS VARCHAR) AS learned_tabular_method, CAST(NULL AS VARCHAR) AS learned_relational_method,
      round(h.value-l.value,6) AS heuristic_minus_local, CAST(NULL AS DOUBLE) AS tabular_minus_local, CAST(NULL AS DOUBLE) AS relational_minus_local, CAST(NULL AS DOUBLE) AS heuristic_minus_tabular,
      CAST(NULL AS DOUBLE) AS relational_minus_heuristic, CASE WHEN h.value-l.value IS NOT NULL THEN 'estimable' ELSE 'not_estimable' END AS local_to_relational
      FROM (SELECT DISTINCT task FROM p) t LEFT JOIN l USING (task) LEFT JOIN h USING (task)""",
    "split_counts": "WITH a AS (" + D.BASE.strip() + " z AS (SELECT 1) SELECT 'device' AS study, CASE WHEN q<7996 THEN 'train' WHEN q<8000 THEN 'validation' ELSE 'test' END AS split FROM elig), b AS ("
    + C.BASE.strip() + " z AS (SELECT 1) SELECT 'facility' AS study, CASE WHEN year<=1998 THEN 'train' WHEN year=1999 THEN 'validation' ELSE 'test' END AS split FROM br), c AS ("
    + P.base().strip() + " z AS (SELECT 1) SELECT 'prescriber' AS study, CASE WHEN year<=1999 THEN 'train' WHEN year=2000 THEN 'validation' ELSE 'test' END AS split FROM edges)"
    + " SELECT study, split, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY ALL",
    "task_cardinalities": "WITH a AS (" + D.BASE.strip() + " z AS (SELECT 1) SELECT (SELECT count(*) FROM ef) AS e, (SELECT count(DISTINCT quarter) FROM pq) AS q), b AS ("
    + C.BASE.strip() + " z AS (SELECT 1) SELECT (SELECT count(*) FROM ins) AS ep, (SELECT sum(serious) FROM ins) AS se, (SELECT count(*) FROM br) AS rw, (SELECT sum(label) FROM br) AS po)"
    + """ SELECT 'device_unique_edges' AS measure, CAST(e AS BIGINT) AS value FROM a UNION ALL SELECT 'device_quarters', q FROM a UNION ALL SELECT 'facility_episodes', ep FROM b
      UNION ALL SELECT 'facility_serious', CAST(se AS BIGINT) FROM b UNION ALL SELECT 'facility_rows', rw FROM b UNION ALL SELECT 'facility_positives', CAST(po AS BIGINT) FROM b""",
    "support_decision": "WITH a AS (" + P.base().strip() + " z AS (SELECT 1) SELECT count(DISTINCT target)=3 AS ok FROM pos), b AS (" + T.BASE.strip()
    + """ z AS (SELECT 1) SELECT bool_and(p>0 AND n>0) AS ok FROM (SELECT origin, count(*) FILTER (status='positive') AS p, count(*) FILTER (status='negative') AS n FROM lb WHERE origin>=DATE '2000-01-01' GROUP BY ALL))
      SELECT 'prescriber' AS study, CASE WHEN ok THEN 'REVIEW_REQUIRED' ELSE 'INSUFFICIENT_OBSERVED_SUPPORT' END AS decision FROM a
      UNION ALL SELECT 'trials', CASE WHEN ok THEN 'REVIEW_REQUIRED' ELSE 'INSUFFICIENT_OBSERVED_SUPPORT' END FROM b""",
}
