"""DuckDB SQL for the facility-inspection queries."""

BASE = """
WITH ins AS (SELECT CAST(o_custkey AS VARCHAR) AS ccn, CAST(o_orderdate AS DATE) AS day,
    max(CASE WHEN o_orderpriority='1-URGENT' THEN 1 ELSE 0 END) AS serious FROM orders GROUP BY ALL),
prov AS (SELECT CAST(c_custkey AS VARCHAR) AS ccn, CAST(c_nationkey AS VARCHAR) AS state, DATE '1990-01-01'+CAST(c_custkey%1000 AS INTEGER) AS approval FROM customer),
own AS (SELECT CAST(o_custkey AS VARCHAR) AS ccn, (CASE WHEN l_suppkey%2=0 THEN 'INDIVIDUAL' ELSE 'ORGANIZATION' END)||'OWNER'||l_suppkey AS owner,
    l_returnflag||l_linestatus AS role, CAST(min(l_shipdate) AS DATE) AS association FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY ALL),
cur AS (SELECT ccn, owner, association, role FROM own WHERE role<>'NF'),
fil AS (SELECT 'E'||(o_orderkey//2) AS enrollment, CAST(o_custkey AS VARCHAR) AS ccn, CAST(o_orderdate AS DATE) AS effective, o_orderkey AS row_no
    FROM orders WHERE o_orderstatus='P' AND o_orderpriority='5-LOW'),
fc AS (SELECT enrollment, arg_max(ccn, row_no) AS ccn FROM fil GROUP BY ALL),
cho AS (SELECT ccn, 'PAC:'||l_suppkey AS owner, CAST(l_shipdate AS DATE) AS association, l_returnflag||l_linestatus AS role
    FROM lineitem JOIN fc ON enrollment='E'||(l_orderkey//2) SEMI JOIN prov USING (ccn) WHERE l_returnflag||l_linestatus IN ('RO','RF','AO')),
comb AS (SELECT * FROM cho UNION ALL SELECT * FROM cur ANTI JOIN cho USING (ccn)),
att AS (SELECT owner, ccn, min(association) AS first FROM comb GROUP BY ALL),
his AS (SELECT a.ccn, a.day, a.serious, count(b.day) AS prior_inspections, CAST(coalesce(sum(b.serious),0) AS BIGINT) AS prior_serious,
    count(b.day) FILTER (b.day>=a.day-365) AS recent365_inspections, CAST(coalesce(sum(b.serious) FILTER (b.day>=a.day-365),0) AS BIGINT) AS recent365_serious,
    count(b.day) FILTER (b.day>=a.day-730) AS recent730_inspections, CAST(coalesce(sum(b.serious) FILTER (b.day>=a.day-730),0) AS BIGINT) AS recent730_serious,
    CAST(a.day-max(b.day) AS BIGINT) AS days_since_last
    FROM ins a LEFT JOIN ins b ON a.ccn=b.ccn AND b.day<a.day GROUP BY a.ccn, a.day, a.serious),
br AS (SELECT h.*, CAST(year(day) AS BIGINT) AS year, CAST(serious AS BIGINT) AS label, state, greatest(0.0::DOUBLE,(day-approval)/365.25::DOUBLE) AS age_years,
    prior_serious/prior_inspections AS prior_serious_rate FROM his h JOIN prov USING (ccn) WHERE year(day) BETWEEN 1995 AND 2001 AND prior_inspections>0),
cc AS (SELECT b.ccn, b.day, count(f.effective) AS chow_prior, count(f.effective) FILTER (f.effective>=b.day-365) AS chow_recent365
    FROM br b LEFT JOIN fil f ON f.ccn=b.ccn AND f.effective<b.day GROUP BY ALL),
"""
PEERS = """
lk AS (SELECT a.ccn, b.ccn AS peer, min(greatest(a.first,b.first)) AS since FROM att a JOIN att b ON a.owner=b.owner AND a.ccn<>b.ccn GROUP BY ALL),
td AS (SELECT DISTINCT day AS t FROM br),
pst AS (SELECT i.ccn AS peer, t, count(*) AS n, sum(serious) AS s, count(*) FILTER (day>=t-365) AS n365, coalesce(sum(serious) FILTER (day>=t-365),0) AS s365,
    coalesce(sum(serious) FILTER (day>=t-730),0) AS s730 FROM ins i JOIN td ON day<t GROUP BY ALL),
pa AS (SELECT b.ccn, b.day, count(*) AS peer_count, count(n) AS peer_prior_facilities, CAST(coalesce(sum(n),0) AS BIGINT) AS peer_prior_inspections,
    CAST(coalesce(sum(s),0) AS BIGINT) AS peer_prior_serious, CAST(coalesce(sum(n365),0) AS BIGINT) AS peer_recent365_inspections,
    CAST(coalesce(sum(s365),0) AS BIGINT) AS peer_recent365_serious, CAST(coalesce(sum(s730),0) AS BIGINT) AS peer_recent730_serious,
    count(*) FILTER (s365>0) AS peer_any_serious365, count(*) FILTER (s730>0) AS peer_any_serious730
    FROM br b JOIN lk ON lk.ccn=b.ccn AND lk.since<=b.day LEFT JOIN pst ON pst.peer=lk.peer AND pst.t=b.day GROUP BY ALL),
oc AS (SELECT b.ccn, b.day, count(a.owner) AS owner_count FROM br b LEFT JOIN att a ON a.ccn=b.ccn AND a.first<=b.day GROUP BY ALL),
peers AS (SELECT o.ccn, o.day, owner_count, """ + ", ".join(
    f"coalesce({c},0) AS {c}"
    for c in (
        "peer_count", "peer_prior_facilities", "peer_prior_inspections", "peer_prior_serious", "peer_recent365_inspections",
        "peer_recent365_serious", "peer_recent730_serious", "peer_any_serious365", "peer_any_serious730",
    )
) + " FROM oc o LEFT JOIN pa p ON p.ccn=o.ccn AND p.day=o.day),\n"
PREV = """
py AS (SELECT year, sum(label) AS p, count(*) AS n FROM br GROUP BY ALL),
pv AS (SELECT b.year, b.ccn, b.day, b.label, prior_serious_rate, (SELECT sum(p)/sum(n) FROM py WHERE py.year<b.year) AS score FROM br b WHERE b.year>=1999),
"""
END = "zz AS (SELECT 1) "
TOPO = """
ta AS (SELECT DISTINCT regexp_replace(owner,'^(INDIVIDUAL|ORGANIZATION)','') AS owner, ccn FROM cur WHERE association<DATE '1996-01-01'),
tp AS (SELECT DISTINCT a.ccn AS entity, b.ccn AS peer FROM ta a JOIN ta b ON a.owner=b.owner AND a.ccn<>b.ccn),
"""


def metrics_sql(source: str, group: str, order: str, label: str = "label", score: str = "score") -> str:
    """Grouped classification metrics of a (group, label, score, id) relation."""
    g = f"PARTITION BY {group}" if group else ""
    keys = f"{group}, " if group else ""
    return f"""
ra AS (SELECT *, row_number() OVER ({g} ORDER BY {score} DESC, {order}) AS pos_, rank() OVER ({g} ORDER BY {score})
   +(count(*) OVER (PARTITION BY {keys} {score})-1)/2.0::DOUBLE AS avg_rank, count(*) OVER ({g}) AS n_ FROM {source}),
rb AS (SELECT *, sum({label}) OVER ({g} ORDER BY pos_) AS hits_, greatest(1,CAST(ceil(n_*CAST(0.1 AS DOUBLE)) AS BIGINT)) AS top_ FROM ra),
mt AS (SELECT {keys} count(*) AS n_rows, CAST(sum({label}) AS BIGINT) AS positives, round(avg({label}),6) AS prevalence,
  round(avg(({score}-{label})*({score}-{label})),6) AS brier,
  round(-avg({label}*ln(greatest(1e-12,least(1.0::DOUBLE-1e-12,{score})))+(1-{label})*ln(greatest(1e-12,least(1.0::DOUBLE-1e-12,1.0::DOUBLE-{score})))),6) AS log_loss,
  CAST(max(top_) AS BIGINT) AS top_n, round(sum(CASE WHEN {label}=1 THEN hits_/pos_ END)/nullif(sum({label}),0),6) AS average_precision,
  round((sum(CASE WHEN {label}=1 THEN avg_rank END)-sum({label})*(sum({label})+1)/2.0::DOUBLE)/nullif(CAST(sum({label}) AS DOUBLE)*(count(*)-sum({label})),0),6) AS roc_auc,
  round(sum({label}) FILTER (pos_<=top_)/max(top_),6) AS top_decile_precision,
  round(sum({label}) FILTER (pos_<=top_)/nullif(sum({label}),0),6) AS top_decile_recall FROM rb {'GROUP BY '+group if group else ''})"""


ORACLES = {
    "c_sources": BASE + END + """SELECT 'inspections' AS source, count(*) AS n_rows, count(DISTINCT ccn) AS keys FROM ins
      UNION ALL SELECT 'providers', count(*), count(DISTINCT ccn) FROM prov UNION ALL SELECT 'owners', count(*), count(DISTINCT ccn) FROM own
      UNION ALL SELECT 'filings', count(*), count(DISTINCT ccn) FROM fil
      UNION ALL SELECT 'filing_owners', count(*), count(DISTINCT l_orderkey//2) FROM lineitem
      UNION ALL SELECT 'serious', count(*), count(DISTINCT ccn) FROM ins WHERE serious=1""",
    "json_records": "SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS ccn FROM orders",
    "c_episodes": BASE + END + "SELECT ccn, day, CAST(serious AS BIGINT) AS serious FROM ins",
    "c_survey_episodes": """WITH s AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS ccn, CAST(o_orderdate AS DATE) AS day FROM orders
        WHERE o_orderstatus<>'P' AND o_orderkey%3<>0 AND o_orderkey%37<>0 AND o_orderkey%41<>0),
      c AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS ccn, CAST(o_orderdate AS DATE) AS day FROM orders JOIN lineitem ON l_orderkey=o_orderkey
        WHERE l_linenumber%3<>0 AND l_returnflag='N' AND CAST(l_quantity AS INTEGER)%12>=6)
      SELECT s.ccn, s.day, CAST(c.ccn IS NOT NULL AS BIGINT) AS serious FROM s LEFT JOIN c USING (ccn, day)""",
    "date_parse": """SELECT CASE WHEN l_linenumber IN (4,5,6) THEN NULL ELSE CAST(l_shipdate AS DATE) END AS parsed, count(*) AS n FROM lineitem GROUP BY 1""",
    "owner_token": """SELECT s_suppkey, regexp_replace(upper((CASE WHEN s_suppkey%2=0 THEN 'Individual' ELSE 'Organization' END)||'|'||s_name),'[^A-Z0-9]+','','g') AS token FROM supplier""",
    "normalize_entity": "SELECT lower(p_name||' '||p_type) AS name, count(*) AS n FROM part GROUP BY 1",
    "stable_hash": """SELECT o_orderkey, substr(h,1,16) AS hex, CAST('0x'||substr(h,1,15) AS BIGINT)%997 AS slot
      FROM (SELECT o_orderkey, sha256('2000Q1|'||o_orderkey||'|'||o_orderstatus) AS h FROM orders)""",
    "c_owner_assoc": BASE + END + "SELECT * FROM cur",
    "c_first_assoc": BASE + END + "SELECT * FROM att",
    "c_chow_owners": BASE + END + "SELECT DISTINCT * FROM cho",
    "c_combined_owners": BASE + END + "SELECT DISTINCT * FROM comb",
    "c_history": BASE + END + "SELECT * EXCLUDE (serious) FROM his",
    "c_chow_counts": BASE + END + "SELECT * FROM cc",
    "c_peer_stats": BASE + PEERS + END + "SELECT * FROM peers",
    "c_features": BASE + END
    + """SELECT ccn, day, state, label, round(ln(1+prior_inspections),6) AS log_prior_inspections, round(ln(1+prior_serious),6) AS log_prior_serious,
      round(prior_serious_rate,6) AS prior_serious_rate, round(ln(1+recent365_inspections),6) AS log_recent365_inspections,
      round(ln(1+recent365_serious),6) AS log_recent365_serious, round(ln(1+recent730_inspections),6) AS log_recent730_inspections,
      round(ln(1+recent730_serious),6) AS log_recent730_serious, round(least(days_since_last,1460)/365.25::DOUBLE,6) AS days_since_last_years,
      round(least(age_years,100.0::DOUBLE),6) AS facility_age_years, round(ln(1+chow_prior),6) AS log_chow_prior, round(ln(1+chow_recent365),6) AS log_chow_recent365
      FROM br JOIN cc USING (ccn, day)""",
    "c_graph_features": BASE + PEERS + END
    + """SELECT ccn, day, round(ln(1+owner_count),6) AS log_owner_count, round(ln(1+peer_count),6) AS log_peer_count,
      round(ln(1+peer_prior_facilities),6) AS log_peer_prior_facilities, round(ln(1+peer_prior_inspections),6) AS log_peer_prior_inspections,
      round(ln(1+peer_prior_serious),6) AS log_peer_prior_serious, round(coalesce(peer_prior_serious/nullif(peer_prior_inspections,0),0),6) AS peer_prior_serious_rate,
      round(ln(1+peer_recent365_inspections),6) AS log_peer_recent365_inspections, round(ln(1+peer_recent365_serious),6) AS log_peer_recent365_serious,
      round(coalesce(peer_recent365_serious/nullif(peer_recent365_inspections,0),0),6) AS peer_recent365_serious_rate,
      round(ln(1+peer_recent730_serious),6) AS log_peer_recent730_serious, round(ln(1+peer_any_serious365),6) AS peer_any_serious365_count,
      round(ln(1+peer_any_serious730),6) AS peer_any_serious730_count FROM peers""",
    "c_prevalence": BASE + PREV + END + "SELECT year, ccn, day, label, round(score,6) AS score FROM pv",
    "c_baseline_metrics": BASE + PREV
    + "sc AS (SELECT year, ccn, day, label, 'prevalence' AS method, score FROM pv UNION ALL SELECT year, ccn, day, label, 'prior_rate', prior_serious_rate FROM pv),"
    + metrics_sql("sc", "method, year", "day, ccn")
    + " SELECT * FROM mt",
    "owner_projection": BASE + TOPO + END + "SELECT * FROM tp",
    "neighbor_mean": BASE + TOPO
    + """w AS (SELECT entity, avg(c_acctbal) AS raw FROM tp JOIN customer ON CAST(c_custkey AS VARCHAR)=peer GROUP BY ALL),
      z AS (SELECT avg(raw) AS m, var_pop(raw) AS v FROM w WHERE CAST(entity AS BIGINT)%2=0)
      SELECT entity, round(raw,5) AS raw, round((raw-m)/CASE WHEN v>1e-12 THEN sqrt(v) ELSE 1 END,5) AS standardised FROM w CROSS JOIN z""",
}
