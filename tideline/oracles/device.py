"""DuckDB SQL for the device-report queries."""

BASE = """
WITH dev AS (
  SELECT l_orderkey AS key, CAST(year(l_shipdate)*4+quarter(l_shipdate)-1 AS BIGINT) AS quarter,
         CAST(l_suppkey AS VARCHAR) AS product, coalesce(CAST(c_nationkey AS VARCHAR),'') AS manufacturer
  FROM lineitem LEFT JOIN orders ON l_orderkey=o_orderkey LEFT JOIN customer ON o_custkey=c_custkey
  WHERE year(l_shipdate) BETWEEN 1995 AND 2001),
prob AS (SELECT l_orderkey AS key, p_brand||'|'||p_size AS problem FROM lineitem JOIN part ON l_partkey=p_partkey),
par AS (SELECT DISTINCT p_brand||'|'||p_size AS problem, p_brand AS parent FROM part),
rep AS (SELECT DISTINCT key, quarter, product FROM dev),
code AS (SELECT DISTINCT key, problem FROM prob),
eq AS (SELECT product, problem, quarter, count(*) AS n_reports FROM rep JOIN code USING (key) GROUP BY ALL),
pq AS (SELECT product, quarter, count(*) AS n_reports FROM rep GROUP BY ALL),
pqm AS (SELECT DISTINCT product, quarter, manufacturer FROM dev WHERE manufacturer<>''),
ef AS (SELECT product, problem, min(quarter) AS f0 FROM eq GROUP BY ALL),
pf AS (SELECT product, min(quarter) AS product_first FROM pq GROUP BY ALL),
df AS (SELECT problem, min(f0) AS problem_first FROM ef GROUP BY ALL),
elig AS (SELECT f0 AS q, product, problem FROM ef JOIN pf USING (product) JOIN df USING (problem)
         WHERE product_first<f0 AND problem_first<f0),
allq AS (SELECT CAST(range AS BIGINT) AS q FROM range(7981, 8008)),
evq AS (SELECT q FROM allq WHERE q>=7996),
"""


def lab(c: str) -> str:
    return f"(CAST({c}//4 AS VARCHAR)||'Q'||CAST({c}%4+1 AS VARCHAR))"


# As-of tables of the evaluation quarters.
ASOF = """
cat AS (SELECT q, problem, count(*) AS prevalence FROM evq JOIN ef ON f0<q GROUP BY ALL),
hist AS (SELECT q, product, problem FROM evq JOIN ef ON f0<q),
heads AS (SELECT DISTINCT q, product FROM elig JOIN evq USING (q)),
cand AS (SELECT h.q, h.product, c.problem, c.prevalence FROM heads h JOIN cat c USING (q)
         ANTI JOIN hist x ON x.q=h.q AND x.product=h.product AND x.problem=c.problem),
"""
NEAR = """
nb AS (SELECT DISTINCT a.q, a.product, b.product AS peer
       FROM hist a JOIN heads USING (q, product) JOIN hist b ON a.q=b.q AND a.problem=b.problem AND a.product<>b.product),
near AS (SELECT n.q, n.product, h.problem, count(*) AS neighbor_count
         FROM nb n JOIN hist h ON h.q=n.q AND h.product=n.peer
         ANTI JOIN hist x ON x.q=n.q AND x.product=n.product AND x.problem=h.problem
         GROUP BY ALL),
"""
# Only the eligible rows are counted, and each pair of neighbours is made once.
NEAR_ELIGIBLE = """
nb AS MATERIALIZED (SELECT DISTINCT a.q, a.product, b.product AS peer
       FROM hist a JOIN heads USING (q, product) JOIN hist b ON a.q=b.q AND a.problem=b.problem AND a.product<>b.product),
near AS MATERIALIZED (SELECT e.q, e.product, e.problem, count(*) AS neighbor_count FROM elig e JOIN evq USING (q)
         JOIN hist h ON h.q=e.q AND h.problem=e.problem AND h.product<>e.product JOIN nb n ON n.q=e.q AND n.product=e.product AND n.peer=h.product GROUP BY ALL),
"""
PROBLEM_STATE = """
pr AS (SELECT q, problem, sum(n_reports) AS problem_reports FROM allq JOIN eq ON quarter<q GROUP BY ALL),
pv AS (SELECT q, problem, count(*) AS prevalence FROM allq JOIN ef ON f0<q GROUP BY ALL),
rp AS (SELECT q, problem, count(DISTINCT product) AS recent_products FROM allq JOIN eq ON quarter<q AND quarter>=q-4 GROUP BY ALL),
pp AS (SELECT q, parent, count(DISTINCT product) AS parent_prevalence FROM allq JOIN (SELECT * FROM ef JOIN par USING (problem)) ON f0<q GROUP BY ALL),
pstate AS (SELECT q, problem, problem_reports, prevalence, problem_first,
                  coalesce(recent_products,0) AS recent_products, coalesce(parent_prevalence,0) AS parent_prevalence
           FROM pr JOIN pv USING (q,problem) JOIN df USING (problem) LEFT JOIN rp USING (q,problem)
           LEFT JOIN par USING (problem) LEFT JOIN pp USING (q,parent)),
"""
MAKERS = """
pm AS (SELECT product, manufacturer, min(quarter) AS f0 FROM pqm GROUP BY ALL),
mp AS (SELECT q, manufacturer, count(*) AS maker_products FROM allq JOIN pm ON f0<q GROUP BY ALL),
ma AS (SELECT q, product, count(*) AS n_makers, CAST(sum(maker_products) AS BIGINT) AS maker_activity
       FROM allq JOIN pm ON f0<q JOIN mp USING (q, manufacturer) GROUP BY ALL),
"""
SUPPORT = "sup AS (SELECT q, product, CAST(sum(n_reports) AS BIGINT) AS history_support FROM allq JOIN pq ON quarter<q GROUP BY ALL),\n"
RANKS = """
ranked AS (
  SELECT 'global_popularity' AS method, q, product, problem,
         row_number() OVER (PARTITION BY q, product ORDER BY prevalence DESC, problem) AS rank FROM cand
  UNION ALL
  SELECT 'neighbor_frequency', q, product, problem,
         row_number() OVER (PARTITION BY q, product ORDER BY coalesce(neighbor_count,0) DESC, prevalence DESC, problem)
  FROM cand LEFT JOIN near USING (q, product, problem)),
pos AS (SELECT r.* FROM ranked r JOIN elig USING (q, product, problem)),
ent AS (
  SELECT method, q, product, history_support, count(*) AS positive_edges,
    count(*) FILTER (rank<=5) AS hits_at_5, count(*) FILTER (rank<=10) AS hits_at_10, count(*) FILTER (rank<=20) AS hits_at_20,
    count(*) FILTER (rank<=5)/count(*) AS recall_at_5, count(*) FILTER (rank<=10)/count(*) AS recall_at_10,
    count(*) FILTER (rank<=20)/count(*) AS recall_at_20, 1.0::DOUBLE/min(rank) AS mrr
  FROM pos JOIN sup USING (q, product) GROUP BY method, q, product, history_support),
sliced AS (
  SELECT *, '>='||t AS slice FROM ent JOIN (VALUES (1),(10),(50)) v(t) ON history_support>=t
  UNION ALL
  SELECT *, 0, CASE WHEN history_support<10 THEN '1-9' WHEN history_support<50 THEN '10-49'
                    WHEN history_support<200 THEN '50-199' ELSE '200+' END FROM ent)
"""
POOL = """CAST(sum(positive_edges) AS BIGINT) AS positive_edges, count(*) AS entities,
  CAST(sum(hits_at_5) AS BIGINT) AS hits_at_5, CAST(sum(hits_at_10) AS BIGINT) AS hits_at_10, CAST(sum(hits_at_20) AS BIGINT) AS hits_at_20,
  round(sum(hits_at_5)/sum(positive_edges),6) AS micro_recall_at_5, round(sum(hits_at_10)/sum(positive_edges),6) AS micro_recall_at_10,
  round(sum(hits_at_20)/sum(positive_edges),6) AS micro_recall_at_20,
  round(avg(recall_at_5),6) AS macro_recall_at_5, round(avg(recall_at_10),6) AS macro_recall_at_10,
  round(avg(recall_at_20),6) AS macro_recall_at_20, round(avg(mrr),6) AS mrr"""

RAW = """
WITH raw AS (
  SELECT CAST(year(l_shipdate) AS VARCHAR) AS file, l_orderkey AS key, l_linenumber, l_partkey,
    CAST(l_suppkey AS VARCHAR) AS product, coalesce(CAST(c_nationkey AS VARCHAR),'') AS manufacturer,
    year(l_shipdate)*4+quarter(l_shipdate)-1 AS quarter,
    CASE WHEN l_quantity=2 THEN 'blank' WHEN l_quantity=1 THEN 'non_numeric_key' WHEN l_quantity=3 THEN 'wrong_width'
         WHEN l_discount=0.01 OR year(l_shipdate) NOT BETWEEN 1995 AND 2001 THEN 'outside_window'
         WHEN l_tax=0.08 THEN 'blank_product' ELSE 'valid' END AS status
  FROM lineitem LEFT JOIN orders ON l_orderkey=o_orderkey LEFT JOIN customer ON o_custkey=c_custkey)
"""

CODES = """
cm AS (SELECT p_brand||'|'||p_size AS code,
  arg_max('B'||lpad(regexp_extract(p_brand,'([0-9]+)',1),2,'0')||CASE WHEN p_size%10=0 THEN '' ELSE CAST(p_size AS VARCHAR) END, p_partkey) AS imdrf
  FROM part GROUP BY ALL),
np AS (SELECT a.code, 'IMDRF:'||arg_max(b.imdrf, length(b.imdrf)) AS parent
  FROM cm a JOIN (SELECT DISTINCT imdrf FROM cm) b ON length(b.imdrf)<length(a.imdrf) AND starts_with(a.imdrf,b.imdrf) GROUP BY ALL)
"""

ORACLES = {
    "m_device_rows": RAW + f"SELECT key, product, manufacturer, {lab('quarter')} AS quarter FROM raw WHERE status='valid'",
    "m_parse_audit": RAW + "SELECT file, status, count(*) AS n_lines FROM raw GROUP BY ALL",
    "m_key_inversions": RAW
    + """, k AS (SELECT file, key, lag(key) OVER (PARTITION BY file ORDER BY l_linenumber, l_partkey, key) AS prev
      FROM raw WHERE status NOT IN ('blank','non_numeric_key','wrong_width'))
      SELECT file, count(*) FILTER (key<prev) AS key_inversions FROM k GROUP BY ALL""",
    "m_problem_rows": """SELECT DISTINCT l_orderkey AS key, p_brand||'/'||p_size AS problem
      FROM lineitem JOIN part ON l_partkey=p_partkey WHERE l_tax NOT IN (0.07,0.08) AND l_quantity NOT IN (1,2,3)""",
    "quarter_bucket": f"""SELECT CASE WHEN day(l_shipdate)<>1 AND year(l_shipdate) BETWEEN 1996 AND 2000
      THEN {lab('CAST(year(l_shipdate)*4+quarter(l_shipdate)-1 AS BIGINT)')} END AS quarter, count(*) AS n FROM lineitem GROUP BY 1""",
    "nearest_prefix_parent": "WITH " + CODES + " SELECT * FROM np",
    "m_hierarchy_coverage": BASE + CODES
    + """ SELECT count(*) AS observed_codes, count(imdrf) AS codes_with_mapping, count(parent) AS codes_with_parent
      FROM df LEFT JOIN cm ON df.problem=cm.code LEFT JOIN np ON df.problem=np.code""",
    "m_edges": BASE + f"z AS (SELECT 1) SELECT product, problem, {lab('quarter')} AS quarter, n_reports FROM eq",
    "m_match_audit": BASE
    + """d AS (SELECT DISTINCT key FROM dev), p AS (SELECT DISTINCT key FROM prob)
      SELECT count(d.key) AS device_keys, count(*) FILTER (d.key IS NOT NULL AND p.key IS NOT NULL) AS matched_keys,
      count(*) FILTER (d.key IS NULL) AS problem_only_keys FROM d FULL JOIN p ON d.key=p.key""",
    "m_snapshot": BASE
    + f"""a AS (SELECT quarter, count(DISTINCT key) AS n_reports FROM dev GROUP BY ALL),
      b AS (SELECT quarter, count(*) AS products, CAST(sum(n_reports) AS BIGINT) AS product_reports FROM pq GROUP BY ALL),
      c AS (SELECT quarter, count(*) AS product_makers FROM pqm GROUP BY ALL),
      d AS (SELECT quarter, count(*) AS edges, CAST(sum(n_reports) AS BIGINT) AS edge_reports FROM eq GROUP BY ALL)
      SELECT {lab('quarter')} AS quarter, n_reports, products, product_reports, product_makers, edges, edge_reports
      FROM a LEFT JOIN b USING (quarter) LEFT JOIN c USING (quarter) LEFT JOIN d USING (quarter)""",
    "m_multiplicity_audit": BASE
    + """k AS (SELECT key, count(*) AS n, count(DISTINCT product) AS np FROM dev GROUP BY ALL),
      c AS (SELECT key, count(*) AS n FROM code GROUP BY ALL)
      SELECT (SELECT count(*) FROM k) AS device_keys, (SELECT CAST(sum(n) AS BIGINT) FROM k) AS device_rows,
      (SELECT count(*) FROM k WHERE n>1) AS keys_multiple_rows, (SELECT CAST(sum(n-np) AS BIGINT) FROM k) AS duplicate_rows,
      (SELECT count(*) FROM k WHERE np>1) AS keys_multiple_products, (SELECT max(n) FROM k) AS max_rows_per_key,
      (SELECT max(np) FROM k) AS max_products_per_key, (SELECT count(*) FROM c WHERE n>1) AS problem_keys_multiple_codes,
      (SELECT max(n) FROM c) AS max_codes_per_key, (SELECT count(*) FROM ef) AS unique_edges,
      (SELECT count(DISTINCT product) FROM ef) AS edge_products, (SELECT count(*) FROM df) AS edge_problems""",
    "m_first_edges": BASE
    + f"""a AS (SELECT f0 AS q, count(*) AS first_edges FROM ef GROUP BY ALL), b AS (SELECT q, count(*) AS n FROM elig GROUP BY ALL)
      SELECT {lab('q')} AS quarter, first_edges, coalesce(n,0) AS eligible_edges FROM a LEFT JOIN b USING (q)""",
    "m_eligible": BASE + f"z AS (SELECT 1) SELECT {lab('q')} AS quarter, product, problem FROM elig",
    "m_history": BASE + PROBLEM_STATE
    + f"z AS (SELECT 1) SELECT {lab('q')} AS quarter, problem, CAST(problem_reports AS BIGINT) AS problem_reports, prevalence, parent_prevalence, problem_first FROM pstate",
    "m_recent_activity": BASE + PROBLEM_STATE + f"z AS (SELECT 1) SELECT {lab('q')} AS quarter, problem, recent_products FROM pstate",
    "m_manufacturer_activity": BASE + MAKERS + f"z AS (SELECT 1) SELECT {lab('q')} AS quarter, product, n_makers, maker_activity FROM ma",
    "m_candidates": BASE + ASOF + f"z AS (SELECT 1) SELECT {lab('q')} AS quarter, product, problem FROM cand",
    "m_rank_popularity": BASE + ASOF
    + f"""r AS (SELECT *, row_number() OVER (PARTITION BY q, product ORDER BY prevalence DESC, problem) AS rank FROM cand)
      SELECT {lab('q')} AS quarter, product, problem, prevalence, rank FROM r JOIN elig USING (q, product, problem)""",
    "m_neighbor_frequency": BASE + ASOF + NEAR + f"z AS (SELECT 1) SELECT {lab('q')} AS quarter, product, problem, neighbor_count FROM near",
    "m_features": BASE + ASOF + NEAR_ELIGIBLE + PROBLEM_STATE.replace("pstate AS (", "pstate AS MATERIALIZED (") + MAKERS.replace("ma AS (", "ma AS MATERIALIZED (") + SUPPORT.replace("sup AS (", "sup AS MATERIALIZED (")
    + f"""rr AS MATERIALIZED (SELECT q, product, sum(n_reports) AS recent_reports FROM allq JOIN pq ON quarter<q AND quarter>=q-4 GROUP BY ALL)
      SELECT {lab('q')} AS quarter, product, problem,
      round(ln(1+coalesce(history_support,0)),6) AS product_log_prior_reports, round(ln(1+problem_reports),6) AS problem_log_prior_reports,
      round(ln(1+prevalence),6) AS problem_log_product_prevalence, round(ln(1+coalesce(neighbor_count,0)),6) AS neighbor_log_product_count,
      round(ln(1+recent_products),6) AS recent_problem_log_product_count, round(recent_products/greatest(1,prevalence),6) AS recent_problem_prevalence_fraction,
      round(ln(1+coalesce(n_makers,0)),6) AS product_log_manufacturer_count, round(ln(1+coalesce(maker_activity,0)),6) AS manufacturer_log_product_activity,
      CAST(q-product_first AS DOUBLE) AS product_age_quarters, CAST(q-problem_first AS DOUBLE) AS problem_age_quarters,
      round(ln(1+parent_prevalence),6) AS parent_log_product_prevalence,
      round(coalesce(recent_reports,0)/greatest(1,history_support),6) AS product_recent_report_fraction
      FROM elig JOIN evq USING (q) JOIN pf USING (product) LEFT JOIN sup USING (q,product) LEFT JOIN rr USING (q,product)
      LEFT JOIN ma USING (q,product) JOIN pstate USING (q,problem) LEFT JOIN near USING (q,product,problem)""",
    "m_training_rows": BASE
    + f"""trq AS (SELECT q FROM allq WHERE q<7996),
      cat AS (SELECT DISTINCT q, problem FROM trq JOIN ef ON f0<q), hist AS (SELECT q, product, problem FROM trq JOIN ef ON f0<q),
      np AS (SELECT q, product, count(*) AS n_pos FROM elig JOIN trq USING (q) GROUP BY ALL),
      pool AS (SELECT h.q, h.product, c.problem, n_pos FROM np h JOIN cat c USING (q)
        ANTI JOIN hist x ON x.q=h.q AND x.product=h.product AND x.problem=c.problem
        ANTI JOIN elig e ON e.q=h.q AND e.product=h.product AND e.problem=c.problem),
      neg AS (SELECT *, row_number() OVER (PARTITION BY q, product
        ORDER BY substr(sha256({lab('q')}||'|'||product||'|'||problem),1,16), problem) AS rn FROM pool)
      SELECT {lab('q')} AS quarter, product, problem, 1 AS label FROM elig JOIN trq USING (q)
      UNION ALL SELECT {lab('q')}, product, problem, 0 FROM neg WHERE rn<=n_pos""",
    "m_entity_metrics": BASE + ASOF + NEAR + SUPPORT + RANKS
    + f"""SELECT method, {lab('q')} AS quarter, product, history_support, positive_edges, hits_at_5, hits_at_10, hits_at_20,
      round(recall_at_5,6) AS recall_at_5, round(recall_at_10,6) AS recall_at_10, round(recall_at_20,6) AS recall_at_20, round(mrr,6) AS mrr FROM ent""",
    "m_rank_metrics": BASE + ASOF + NEAR + SUPPORT + RANKS + f"SELECT method, {lab('q')} AS quarter, slice, {POOL} FROM sliced GROUP BY method, q, slice",
    "m_split_metrics": BASE + ASOF + NEAR + SUPPORT + RANKS
    + f"SELECT method, CASE WHEN q<8000 THEN 'validation' ELSE 'test' END AS split, slice, {POOL} FROM sliced GROUP BY 1,2,3",
    "m_gate": BASE + ASOF + NEAR + SUPPORT + PROBLEM_STATE
    + RANKS.replace(
        "FROM cand LEFT JOIN near USING (q, product, problem)),",
        """FROM cand LEFT JOIN near USING (q, product, problem)
  UNION ALL SELECT 'recent_prevalence', q, product, problem,
    row_number() OVER (PARTITION BY q, product ORDER BY recent_products DESC, cand.prevalence DESC, problem)
  FROM cand JOIN (SELECT q, problem, recent_products FROM pstate) USING (q, problem)),""",
    )
    + """, bq AS (SELECT method, q, sum(hits_at_10)/sum(positive_edges) AS recall FROM sliced WHERE q>=8000 AND slice='>=1' GROUP BY ALL),
      lo AS (SELECT method, sum(hits_at_10)/sum(positive_edges) AS recall FROM sliced WHERE q>=8000 AND slice='1-9' GROUP BY ALL),
      w AS (SELECT l.method, count(*) FILTER (l.recall>g.recall) AS wins_over_global, count(*) FILTER (l.recall>n.recall) AS wins_over_neighbor
        FROM bq l JOIN bq g ON g.q=l.q AND g.method='global_popularity' JOIN bq n ON n.q=l.q AND n.method='neighbor_frequency'
        WHERE l.method='recent_prevalence' GROUP BY ALL),
      x AS (SELECT w.*, coalesce((SELECT recall FROM lo WHERE method='recent_prevalence'),0) AS low_support,
        coalesce((SELECT max(recall) FROM lo WHERE method<>'recent_prevalence'),0) AS best_baseline_low_support FROM w)
      SELECT method, wins_over_global, wins_over_neighbor, round(low_support,6) AS low_support,
        round(best_baseline_low_support,6) AS best_baseline_low_support,
        wins_over_global>=4 AND wins_over_neighbor>=4 AND low_support>=best_baseline_low_support AS qualifies FROM x""",
    "m_prediction_rows": BASE + ASOF + NEAR + SUPPORT
    + f"""m AS (SELECT c.q, c.product, c.problem, coalesce(neighbor_count,0) AS score, CASE WHEN e.q IS NULL THEN 0 ELSE 1 END AS label
        FROM cand c LEFT JOIN near n ON n.q=c.q AND n.product=c.product AND n.problem=c.problem
        LEFT JOIN elig e ON e.q=c.q AND e.product=c.product AND e.problem=c.problem),
      k AS (SELECT *, sum(label) OVER (PARTITION BY q, product) AS n_pos, count(*) OVER (PARTITION BY q, product) AS candidate_count,
        row_number() OVER (PARTITION BY q, product, label ORDER BY problem) AS i FROM m),
      neg AS (SELECT k.*, s.i AS slot FROM k JOIN (SELECT q, product, i FROM k WHERE label=1) s
        ON s.q=k.q AND s.product=k.product AND (s.i-1)%(k.candidate_count-k.n_pos)+1=k.i WHERE k.label=0),
      allr AS (SELECT q, product, problem, label, score, 1 AS copy, candidate_count FROM k WHERE label=1
        UNION ALL SELECT q, product, problem, label, score, row_number() OVER (PARTITION BY q, product, problem ORDER BY slot), candidate_count FROM neg)
      SELECT {lab('q')} AS quarter, product, problem, CAST(label AS BIGINT) AS label, score, CAST(copy AS BIGINT) AS copy, history_support, candidate_count
      FROM allr JOIN sup USING (q, product)""",
    "bands": BASE
    + """n AS (SELECT product, sum(n_reports) AS n FROM pq GROUP BY ALL)
      SELECT CASE WHEN n<10 THEN '1-9' WHEN n<50 THEN '10-49' WHEN n<200 THEN '50-199' ELSE '200+' END AS band, count(*) AS products FROM n GROUP BY 1""",
}
