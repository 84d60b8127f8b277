"""DuckDB SQL for the trial-result queries."""

_P = "CASE WHEN o_orderkey%11=0 THEN NULL ELSE o_orderpriority END AS phase"
BASE = f"""
WITH ship AS (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS ls, count(*) AS arms FROM lineitem GROUP BY ALL),
tr AS (SELECT o_orderkey AS k, 'NCT'||lpad(CAST(o_orderkey AS VARCHAR),8,'0') AS nct_id, CAST(o_orderdate AS DATE) AS completion,
  CASE WHEN ls>=CAST(o_orderdate AS DATE) THEN ls END AS r0, CAST(arms AS DOUBLE) AS number_of_arms, {_P}, o_orderstatus AS allocation, c_mktsegment AS intervention_model,
  'M'||(o_orderkey%5) AS masking, CASE WHEN o_orderkey%4=0 THEN NULL ELSE 'P'||(o_orderkey%4) END AS primary_purpose,
  CASE WHEN o_orderkey%13=0 THEN NULL ELSE floor(o_totalprice) END AS enrollment,
  CASE WHEN o_orderkey%7=0 THEN NULL ELSE CAST(o_orderdate AS DATE)-CAST(o_orderkey%900 AS INTEGER) END AS start,
  CASE WHEN o_orderkey%3=0 THEN 1.0 WHEN o_orderkey%3=1 THEN 0.0 END AS fdrug, CASE WHEN o_orderkey%5=0 THEN 1.0 ELSE 0.0 END AS fdev
  FROM orders LEFT JOIN ship ON o_orderkey=l_orderkey JOIN customer ON o_custkey=c_custkey),
og AS (SELECT make_date(y,1,1) AS origin, make_date(y+1,1,1) AS nxt FROM (SELECT range AS y FROM range(1996,2002))),
st AS (SELECT origin, nxt, tr.*, CASE WHEN r0<=origin THEN r0 END AS result, CAST(origin-completion AS BIGINT) AS age
  FROM og JOIN tr ON completion<=origin WHERE k%50<>0 AND k%40<>0),
kn AS (SELECT origin, nct_id, CASE WHEN result<=completion+365 THEN 1 ELSE 0 END AS timely, CAST(result-completion AS BIGINT) AS delay FROM st WHERE age>=365),
el AS (SELECT * FROM st WHERE age BETWEEN 0 AND 90 AND result IS NULL),
co AS (SELECT * FROM el),
rel AS (SELECT entity_type, nct_id, name, min(vf) AS vf FROM (
  SELECT 'sponsor' AS entity_type, 'NCT'||lpad(CAST(o_orderkey AS VARCHAR),8,'0') AS nct_id, 'sponsor '||o_custkey AS name, CAST(o_orderdate AS DATE) AS vf FROM orders
  UNION ALL SELECT 'facility', 'NCT'||lpad(CAST(l_orderkey AS VARCHAR),8,'0'), 'site '||l_suppkey, CAST(l_shipdate AS DATE) FROM lineitem
  UNION ALL SELECT 'condition', 'NCT'||lpad(CAST(l_orderkey AS VARCHAR),8,'0'), lower(p_brand), CAST(l_shipdate AS DATE) FROM lineitem JOIN part ON l_partkey=p_partkey
  UNION ALL SELECT 'intervention', 'NCT'||lpad(CAST(l_orderkey AS VARCHAR),8,'0'), lower(p_type), CAST(l_shipdate AS DATE) FROM lineitem JOIN part ON l_partkey=p_partkey
  UNION ALL SELECT 'collaborator', 'NCT'||lpad(CAST(l_orderkey AS VARCHAR),8,'0'), 'collab '||s_nationkey, CAST(l_shipdate AS DATE) FROM lineitem JOIN supplier ON l_suppkey=s_suppkey) GROUP BY ALL),
kr AS (SELECT origin, entity_type, nct_id, name, timely, delay FROM rel JOIN kn USING (nct_id) WHERE vf<=origin),
cr AS (SELECT origin, entity_type, nct_id, name FROM rel JOIN (SELECT origin, nct_id FROM co) USING (nct_id) WHERE vf<=origin),
eh AS (SELECT origin, entity_type, name, count(*) AS trials, sum(timely) AS timely FROM kr GROUP BY ALL),
md AS (SELECT c.origin, c.nct_id, c.entity_type, median(delay) AS m FROM cr c JOIN kr k ON k.origin=c.origin AND k.entity_type=c.entity_type AND k.name=c.name
  WHERE delay IS NOT NULL GROUP BY ALL),
th AS (SELECT c.origin, c.nct_id, c.entity_type, count(*) AS entity_count, count(trials) AS history_entity_count,
  CAST(coalesce(sum(trials),0) AS BIGINT) AS prior_trial_count, coalesce(sum(e.timely),0) AS timely, any_value(m) AS median_delay_days
  FROM cr c LEFT JOIN eh e ON e.origin=c.origin AND e.entity_type=c.entity_type AND e.name=c.name
  LEFT JOIN md ON md.origin=c.origin AND md.nct_id=c.nct_id AND md.entity_type=c.entity_type GROUP BY c.origin, c.nct_id, c.entity_type),
lb AS (SELECT origin, nct_id, CASE WHEN r0<=nxt THEN r0 END AS posted,
  CASE WHEN r0<=nxt AND r0<=origin THEN 'inconsistent' WHEN r0<=nxt AND r0<=origin+365 THEN 'positive' ELSE 'negative' END AS status FROM co),
"""
END = "zz AS (SELECT 1) "
FLAWED = (
    BASE
    + "fl AS (SELECT CASE WHEN k%97=0 THEN 'N' ELSE '' END||nct_id AS nct_id, * EXCLUDE (nct_id) FROM tr UNION ALL SELECT CASE WHEN k%97=0 THEN 'N' ELSE '' END||nct_id, * EXCLUDE (nct_id) FROM tr WHERE k%89=0), "
)
TYPES = ("sponsor", "condition", "intervention", "facility", "collaborator")
TF = "round(timely/nullif(prior_trial_count,0),6)"


def _h(e: str) -> str:
    return (
        f"coalesce(CAST({e}.prior_trial_count AS DOUBLE),0) AS {e}_prior_trial_count, round({e}.timely/nullif({e}.prior_trial_count,0),6) AS {e}_timely_fraction, "
        f"round({e}.median_delay_days,6) AS {e}_median_delay_days, coalesce(CAST({e}.entity_count AS DOUBLE),0) AS {e}_entity_count, "
        f"coalesce(CAST({e}.history_entity_count AS DOUBLE),0) AS {e}_history_entity_count"
    )


SCORES = """
sc AS (SELECT l.origin, l.nct_id, CASE WHEN status='positive' THEN 1 ELSE 0 END AS label, v.e AS model,
  coalesce(t.timely/nullif(t.prior_trial_count,0),0) AS score FROM lb l CROSS JOIN (VALUES ('sponsor'),('facility'),('condition')) v(e)
  LEFT JOIN th t ON t.origin=l.origin AND t.nct_id=l.nct_id AND t.entity_type=v.e WHERE status IN ('positive','negative')),
o1 AS (SELECT *, row_number() OVER (PARTITION BY origin, model ORDER BY score DESC, nct_id) AS i FROM sc),
o2 AS (SELECT *, sum(label) OVER (PARTITION BY origin, model ORDER BY i) AS hits FROM o1),
ap AS (SELECT origin, model, sum(CASE WHEN label=1 THEN hits/i END)/nullif(sum(label),0) AS ap FROM o2 GROUP BY ALL),
dl AS (SELECT a.origin, a.model, a.ap-b.ap AS delta FROM ap a JOIN ap b ON a.origin=b.origin AND b.model='sponsor' WHERE a.model<>'sponsor')
"""

ORACLES = {
    "t_sources": """SELECT snapshot, count(*) AS studies, count(*) FILTER (posted>=CAST(o_orderdate AS DATE) AND posted<=snapshot) AS with_results
      FROM (SELECT make_date(range,1,1) AS snapshot FROM range(1996,2003)), orders
      LEFT JOIN (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS posted FROM lineitem GROUP BY ALL) ON l_orderkey=o_orderkey GROUP BY ALL""",
    "t_studies": BASE + END + "SELECT origin, nct_id, completion, result, enrollment, age FROM st",
    "t_eligible": BASE + END + "SELECT origin, nct_id FROM el",
    "t_cohort": BASE + END + "SELECT origin, nct_id FROM el QUALIFY row_number() OVER (PARTITION BY origin ORDER BY sha256(nct_id), nct_id)<=2000",
    "t_design_conflicts": BASE
    + """dv AS (SELECT origin, co.nct_id, unnest([{'f': 'allocation', 'v': l_returnflag}, {'f': 'intervention_model', 'v': 'same'},
        {'f': 'masking', 'v': CASE WHEN l_linenumber%2=0 THEN '' ELSE l_linestatus END}, {'f': 'time_perspective', 'v': CAST(l_suppkey%3 AS VARCHAR)}]) AS x
        FROM co JOIN lineitem ON l_orderkey=k WHERE CAST(l_shipdate AS DATE)<=origin AND origin<=CAST(l_shipdate AS DATE)+365)
      SELECT origin, nct_id, x.f AS field, count(DISTINCT x.v) AS "values" FROM dv WHERE x.v<>'' GROUP BY ALL HAVING count(DISTINCT x.v)>1""",
    "t_quarantine": FLAWED
    + """pr AS (SELECT nct_id, unnest([CASE WHEN k%97=0 THEN 'nct_id' END, CASE WHEN k%59=0 AND k%50<>0 AND k%40<>0 THEN 'completion_date' END, CASE WHEN k%61=0 THEN 'enrollment' END,
        CASE WHEN k%67=0 THEN 'number_of_arms' END, CASE WHEN k%71=0 THEN 'fda_drug' END]) AS problem FROM fl
        UNION ALL SELECT DISTINCT nct_id, 'repeated_id' FROM fl WHERE k%89=0)
      SELECT problem, count(*) AS n, count(DISTINCT nct_id) AS studies FROM pr WHERE problem IS NOT NULL GROUP BY problem""",
    "t_flawed_studies": FLAWED
    + """ok AS (SELECT * FROM fl WHERE k%97<>0 AND NOT (k%59=0 AND k%50<>0 AND k%40<>0) AND k%61<>0 AND k%67<>0 AND k%71<>0)
      SELECT nct_id, completion, CASE WHEN r0<=DATE '1996-01-01' THEN r0 END AS result, enrollment, number_of_arms, CAST(fdrug AS DOUBLE) AS is_fda_regulated_drug,
      CAST(DATE '1996-01-01'-completion AS BIGINT) AS age FROM ok WHERE k%50<>0 AND k%40<>0 AND completion<=DATE '1996-01-01'""",
    "t_relations": BASE
    + """ar AS (SELECT origin, entity_type, nct_id, name FROM cr UNION SELECT origin, entity_type, nct_id, name FROM kr)
      SELECT origin, entity_type, count(*) AS relations, count(DISTINCT nct_id) AS trials, count(DISTINCT name) AS names FROM ar GROUP BY ALL""",
    "t_entity_history": BASE + END
    + f"""SELECT origin, nct_id, entity_type, prior_trial_count, {TF} AS timely_fraction, round(median_delay_days,6) AS median_delay_days, entity_count, history_entity_count FROM th""",
    "t_context": BASE
    + """x AS (SELECT * FROM th WHERE entity_type<>'sponsor')
      SELECT c.origin, c.nct_id, CAST(coalesce(sum(prior_trial_count),0) AS BIGINT) AS prior_trial_count,
      round(sum(timely)/nullif(sum(prior_trial_count),0),6) AS timely_fraction, round(avg(median_delay_days),6) AS median_delay_days,
      CAST(coalesce(sum(entity_count),0) AS BIGINT) AS entity_count, CAST(coalesce(sum(history_entity_count),0) AS BIGINT) AS history_entity_count
      FROM co c LEFT JOIN x ON x.origin=c.origin AND x.nct_id=c.nct_id GROUP BY c.origin, c.nct_id""",
    "t_coverage": BASE
    + """g AS (SELECT c.origin, c.nct_id, v.e AS entity_type, coalesce(entity_count,0) AS n, coalesce(history_entity_count,0) AS h FROM co c
        CROSS JOIN (VALUES ('sponsor'),('condition'),('intervention'),('facility'),('collaborator')) v(e)
        LEFT JOIN th t ON t.origin=c.origin AND t.nct_id=c.nct_id AND t.entity_type=v.e),
      i AS (SELECT origin, count(*) FILTER (h=0) AS isolated FROM (SELECT origin, nct_id, sum(h) AS h FROM g GROUP BY ALL) GROUP BY ALL)
      SELECT origin, entity_type, count(*) AS targets, count(*) FILTER (n>0) AS relation_present, count(*) FILTER (h>0) AS history_present, any_value(isolated) AS isolated,
      round(count(*) FILTER (n>0)/count(*),6) AS relation_fraction, round(count(*) FILTER (h>0)/count(*),6) AS history_fraction FROM g JOIN i USING (origin) GROUP BY origin, entity_type""",
    "t_labels": BASE + END
    + "SELECT origin, nct_id, posted, status, CAST(CASE status WHEN 'positive' THEN 1 WHEN 'negative' THEN 0 END AS BIGINT) AS label FROM lb",
    "t_label_audit": BASE + END
    + """SELECT origin, count(*) AS selected, CAST(0 AS BIGINT) AS missing, count(*) FILTER (status='inconsistent') AS inconsistent,
      count(*) FILTER (status='positive') AS positive, count(*) FILTER (status='negative') AS negative FROM lb GROUP BY ALL""",
    "t_local_features": BASE + END
    + """SELECT origin, nct_id, phase, allocation, intervention_model, masking, primary_purpose, CAST(NULL AS VARCHAR) AS time_perspective, enrollment, number_of_arms,
      CAST(NULL AS DOUBLE) AS number_of_groups, CAST(completion-start AS DOUBLE) AS start_to_completion_days, CAST(age AS DOUBLE) AS completion_lag_days,
      CAST(fdrug AS DOUBLE) AS is_fda_regulated_drug, CAST(fdev AS DOUBLE) AS is_fda_regulated_device FROM co""",
    "t_examples": BASE + END
    + "SELECT l.origin, l.nct_id, CAST(CASE status WHEN 'positive' THEN 1 ELSE 0 END AS BIGINT) AS label, "
    + ", ".join(_h(e) for e in TYPES)
    + " FROM lb l "
    + " ".join(f"LEFT JOIN th {e} ON {e}.origin=l.origin AND {e}.nct_id=l.nct_id AND {e}.entity_type='{e}'" for e in TYPES)
    + " WHERE status IN ('positive','negative')",
    "t_encode": BASE
    + """ex AS (SELECT origin, nct_id, phase, allocation, intervention_model, masking, primary_purpose, CAST(NULL AS VARCHAR) AS time_perspective, enrollment, number_of_arms,
        CAST(NULL AS DOUBLE) AS number_of_groups, CAST(completion-start AS DOUBLE) AS start_to_completion_days, CAST(age AS DOUBLE) AS completion_lag_days,
        CAST(fdrug AS DOUBLE) AS is_fda_regulated_drug, CAST(fdev AS DOUBLE) AS is_fda_regulated_device
        FROM co JOIN lb USING (origin, nct_id) WHERE status IN ('positive','negative')),
      tn AS (SELECT * FROM ex WHERE origin<DATE '2000-01-01'), te AS (SELECT * FROM ex WHERE origin=DATE '2000-01-01') """
    + " UNION ALL ".join(
        f"SELECT nct_id, '{c}='||CASE WHEN coalesce({c},'__MISSING__') IN (SELECT coalesce({c},'__MISSING__') FROM tn) THEN coalesce({c},'__MISSING__') ELSE '__UNK__' END AS feature, CAST(1 AS DOUBLE) AS value FROM te"
        for c in ("phase", "allocation", "intervention_model", "masking", "primary_purpose", "time_perspective")
    )
    + " UNION ALL "
    + " UNION ALL ".join(
        f"SELECT nct_id, CASE WHEN {c} IS NULL THEN '{c}__missing' ELSE '{c}' END, CASE WHEN {c} IS NULL THEN 1.0 ELSE round(({c}-m)/s,6) END FROM te, (SELECT avg({c}) AS m, CASE WHEN stddev_pop({c})>=1e-12 THEN stddev_pop({c}) ELSE 1 END AS s FROM tn)"
        for c in ("enrollment", "number_of_arms", "number_of_groups", "start_to_completion_days", "completion_lag_days", "is_fda_regulated_drug", "is_fda_regulated_device")
    ),
    "t_metric_deltas": BASE + SCORES + "SELECT origin, model, round(delta,6) AS delta FROM dl",
    "t_stability_summary": BASE + SCORES
    + """SELECT model, count(*) AS origins, count(delta) AS defined_origins, count(*) FILTER (delta>0) AS positive_origins, count(*) FILTER (delta>=0) AS nonnegative_origins,
      coalesce(count(delta)=count(*) AND bool_and(delta>0),false) AS strictly_positive_all, round(avg(delta),6) AS mean_delta, round(median(delta),6) AS median_delta,
      round(min(delta),6) AS minimum_delta, round(max(delta),6) AS maximum_delta FROM dl GROUP BY model""",
}
