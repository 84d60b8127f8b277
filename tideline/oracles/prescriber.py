"""DuckDB SQL for the prescriber-drug queries."""


def base(kind: str = "variant", targets: str = "1999,2000,2001", size: int | None = None) -> str:
    bound = f" WHERE rn<={size}" if size else ""
    drug = "generic" if kind == "generic" else "brand||chr(31)||generic"
    return f"""
WITH prow AS (
  SELECT CAST(year(o_orderdate) AS BIGINT) AS year, lpad(CAST(o_custkey AS VARCHAR),10,'0') AS npi, p_type AS brand, p_brand AS generic,
    count(*)+10 AS claims, round(sum(l_extendedprice),2) AS cost,
    CASE WHEN c_mktsegment='MACHINERY' THEN '' ELSE c_mktsegment END AS specialty, n_name AS state
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey
  JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey
  WHERE year(o_orderdate) BETWEEN 1996 AND 2001 GROUP BY ALL),
seen AS (SELECT npi, min(year) AS f0 FROM prow WHERE year<2001 GROUP BY ALL),
allcoh AS (SELECT target, npi FROM (SELECT CAST(t AS BIGINT) AS target, npi, row_number() OVER (PARTITION BY t ORDER BY sha256(npi), npi) AS rn
  FROM (VALUES (1999),(2000),(2001)) v(t) JOIN seen ON f0<t){bound}),
ucoh AS (SELECT DISTINCT npi FROM allcoh),
edges AS (SELECT * FROM prow SEMI JOIN ucoh USING (npi)),
coh AS (SELECT * FROM allcoh WHERE target IN ({targets})),
pj AS (SELECT year, npi, {drug} AS drug, CAST(sum(claims) AS BIGINT) AS claims FROM edges GROUP BY ALL),
hist AS (SELECT target, npi, drug, year, claims FROM pj JOIN coh USING (npi) WHERE year<target),
held AS (SELECT target, npi, drug, CAST(sum(claims) AS BIGINT) AS own_claims FROM hist GROUP BY ALL),
ds AS (SELECT target, drug, count(DISTINCT npi) AS support, CAST(sum(claims) AS BIGINT) AS drug_claims,
  count(DISTINCT year) AS drug_years, max(year) AS last_year FROM hist GROUP BY ALL),
ly AS (SELECT target, npi, max(year) AS year FROM hist GROUP BY ALL),
ls AS (SELECT target, npi, CASE WHEN count(DISTINCT nullif(specialty,''))=1 THEN max(nullif(specialty,'')) END AS latest_specialty
  FROM ly JOIN edges USING (npi, year) GROUP BY ALL),
ps AS (SELECT target, npi, count(DISTINCT drug) AS own_drugs, CAST(sum(claims) AS BIGINT) AS provider_claims, latest_specialty
  FROM hist JOIN ls USING (target, npi) GROUP BY ALL),
ss AS (SELECT target, latest_specialty, drug, count(*) AS specialty_support FROM held JOIN ls USING (target, npi)
  WHERE latest_specialty IS NOT NULL GROUP BY ALL),
cand AS (SELECT p.*, d.drug, d.support, d.drug_claims, d.drug_years, d.last_year FROM ps p JOIN ds d USING (target)
  ANTI JOIN held h ON h.target=p.target AND h.npi=p.npi AND h.drug=d.drug),
pos AS (SELECT c.year AS target, c.npi, c.drug, c.claims FROM pj c JOIN coh k ON k.target=c.year AND k.npi=c.npi
  ANTI JOIN held h ON h.target=c.year AND h.npi=c.npi AND h.drug=c.drug
  SEMI JOIN ds d ON d.target=c.year AND d.drug=c.drug),
"""


OVERLAP = """
dd AS (SELECT drug, CAST(row_number() OVER (ORDER BY drug) AS SMALLINT) AS d FROM (SELECT DISTINCT drug FROM held)),
hi AS (SELECT CAST(target AS SMALLINT) AS t, CAST(npi AS INTEGER) AS n, d FROM held JOIN dd USING (drug)),
sz AS (SELECT t, n, count(*) AS c FROM hi GROUP BY ALL),
sim AS (SELECT a.t, a.n, b.n AS p, CAST(count(*) AS INTEGER) AS i FROM hi a JOIN hi b ON a.t=b.t AND a.d=b.d AND a.n<>b.n GROUP BY ALL),
jac AS (SELECT s.t, s.n, s.p, i/(x.c+y.c-i) AS j FROM sim s JOIN sz x ON x.t=s.t AND x.n=s.n JOIN sz y ON y.t=s.t AND y.n=s.p),
os AS (SELECT s.t, s.n, h.d, sum(j) AS j FROM jac s JOIN hi h ON h.t=s.t AND h.n=s.p GROUP BY ALL),
ov AS (SELECT CAST(t AS BIGINT) AS target, lpad(CAST(n AS VARCHAR),10,'0') AS npi, drug, round(j,12) AS overlap FROM os JOIN dd USING (d)
  ANTI JOIN hi o ON o.t=os.t AND o.n=os.n AND o.d=os.d),
scored AS (SELECT c.*, coalesce(specialty_support,0) AS specialty_support, CAST(support AS DOUBLE) AS global_popularity,
  CAST(CASE WHEN c.latest_specialty IS NULL THEN support ELSE coalesce(specialty_support,0) END AS DOUBLE) AS specialty_popularity,
  coalesce(overlap,0) AS history_overlap
  FROM cand c LEFT JOIN ss s ON s.target=c.target AND s.latest_specialty=c.latest_specialty AND s.drug=c.drug
  LEFT JOIN ov o ON o.target=c.target AND o.npi=c.npi AND o.drug=c.drug),
"""


def ranks(methods: list[str]) -> str:
    tall = " UNION ALL ".join(f"SELECT '{m}' AS method, target, npi, drug, support, {m} AS score FROM scored" for m in methods)
    return f"""tall AS ({tall}),
rk AS (SELECT *, row_number() OVER (PARTITION BY method, target, npi ORDER BY score DESC, support DESC, drug) AS rank FROM tall),
rp AS (SELECT method, target, npi, drug, claims, rank FROM rk JOIN pos USING (target, npi, drug))"""


def entity(keys: str, source: str = "rp") -> str:
    return f"""SELECT {keys}, count(*) AS n, count(*) FILTER (rank<=5) AS h5, count(*) FILTER (rank<=10) AS h10, count(*) FILTER (rank<=20) AS h20,
  count(*) FILTER (rank<=5)/count(*) AS r5, count(*) FILTER (rank<=10)/count(*) AS r10, count(*) FILTER (rank<=20)/count(*) AS r20,
  1.0::DOUBLE/min(rank) AS rr FROM {source} GROUP BY ALL"""


POOL = """CAST(sum(n) AS BIGINT) AS positive_edges, count(*) AS entities, CAST(sum(h5) AS BIGINT) AS hits_at_5, CAST(sum(h10) AS BIGINT) AS hits_at_10,
  CAST(sum(h20) AS BIGINT) AS hits_at_20, round(sum(h5)/sum(n),6) AS micro_recall_at_5, round(sum(h10)/sum(n),6) AS micro_recall_at_10,
  round(sum(h20)/sum(n),6) AS micro_recall_at_20, round(avg(r5),6) AS macro_recall_at_5, round(avg(r10),6) AS macro_recall_at_10,
  round(avg(r20),6) AS macro_recall_at_20, round(avg(rr),6) AS mrr, count(DISTINCT npi) AS providers"""
SCOPES = "(VALUES (0),(1)) v(pool)"
SCOPE = "CASE WHEN pool=1 THEN 'pooled' ELSE CAST(target AS VARCHAR) END AS scope"
SPLIT = "split_part(drug,chr(31),1) AS brand, split_part(drug,chr(31),2) AS generic"
M3 = ["global_popularity", "specialty_popularity", "history_overlap"]
M2 = M3[1:]
G2 = base("generic", "2000,2001")
BAND = "CASE WHEN claims<=20 THEN '11-20' WHEN claims<=50 THEN '21-50' ELSE '51+' END"
END = "zz AS (SELECT 1) "
TRAIN = """neg AS (SELECT *, row_number() OVER (PARTITION BY target, npi
  ORDER BY substr(sha256('tabular-negative|'||target||'|'||npi||'|'||drug),1,16), drug) AS rn FROM cand),
tr AS (SELECT target, npi, drug, 1 AS label, own_claims FROM held UNION ALL SELECT target, npi, drug, 0, NULL FROM neg WHERE rn<=5*own_drugs)
"""


def _identity() -> str:
    def block(kind: str, alias: str) -> str:
        body = (base(kind, "2000,2001") + OVERLAP + ranks(M2) + ", e AS (" + entity("method, target, npi") + ")").strip()
        return f"{alias} AS ({body} SELECT method, {SCOPE}, {POOL.replace('round(','(').replace(',6)',')')} FROM e CROSS JOIN {SCOPES} GROUP BY 1,2)"

    cols = ", ".join(f"round(v.{c}-g.{c},6) AS {c}" for c in ("micro_recall_at_5", "micro_recall_at_10", "micro_recall_at_20", "mrr"))
    return f"WITH {block('generic','g')}, {block('variant','v')} SELECT method, scope, {cols} FROM v JOIN g USING (method, scope)"


ORACLES = {
    "p_edges": base() + END + "SELECT * FROM edges",
    # A source row is a row's place in its year's file, which holds every prescriber and not only the cohort's.
    "p_edge_export": base()
    + """placed AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY npi, brand, generic) AS source_row FROM prow)
      SELECT npi, brand AS brand_name, generic AS generic_name, year, claims, printf('%.2f', cost) AS cost, specialty, state,
      make_date(year,1,1) AS valid_from, make_date(year+1,1,1) AS valid_to, 'bound' AS observed_at, 'year='||year AS source_path,
      source_row, sha256(npi||'|'||brand||'|'||generic) AS source_sha256, 'prescriber_drug_edge_v1' AS transformation FROM placed SEMI JOIN ucoh USING (npi)""",
    "p_edge_audit": base() + END
    + """SELECT CAST(1999 AS BIGINT) AS year, count(*) AS recorded, count(*)-1 AS found FROM prow WHERE year=1999
      UNION ALL SELECT CAST(2000 AS BIGINT), 0, count(*) FROM prow WHERE year=2000""",
    "p_edge_constraints": base() + END
    + """SELECT rule, CAST(n AS BIGINT) AS violations FROM (
      SELECT 'duplicate_key' AS rule, (SELECT count(*) FROM (SELECT npi,brand,generic,year FROM edges GROUP BY ALL HAVING count(*)>1)) AS n
      UNION ALL SELECT 'blank_drug', (SELECT count(*) FROM edges WHERE brand='' AND generic='')
      UNION ALL SELECT 'low_claims', (SELECT count(*) FROM edges WHERE claims<11)
      UNION ALL SELECT 'bad_npi', (SELECT count(*) FROM edges WHERE NOT regexp_full_match(npi,'[0-9]{10}'))
      UNION ALL SELECT 'bad_cost', (SELECT count(*) FROM edges WHERE cost<0)
      UNION ALL SELECT 'bad_validity', 0
      UNION ALL SELECT 'outside_cohort', (SELECT count(*) FROM edges ANTI JOIN ucoh USING (npi)))""",
    "dup_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*)>1",
    "p_rankings_read": G2 + OVERLAP + ranks(M2) + " SELECT target AS year, npi, method, drug AS generic, rank FROM rk WHERE rank<=20",
    "hash_cohort": "SELECT id FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders) ORDER BY sha256(id), id LIMIT 100",
    "p_dynamic_cohort": base(size=2000) + END + "SELECT * FROM allcoh",
    "p_union_cohort": base(size=2000) + END + "SELECT * FROM ucoh",
    "cohort_disappeared": base() + END
    + "SELECT y.year, npi FROM (SELECT CAST(range AS BIGINT) AS year FROM range(1996,2002)) y CROSS JOIN ucoh ANTI JOIN edges e USING (year, npi)",
    "p_project_generic": base("generic") + END
    + """SELECT year, npi, CAST(sum(claims) AS BIGINT) AS claims, coalesce(string_agg(DISTINCT nullif(specialty,''), ','),'') AS specialties, generic FROM edges GROUP BY year, npi, generic""",
    "p_project_variant": base() + END
    + """SELECT year, npi, CAST(sum(claims) AS BIGINT) AS claims, coalesce(string_agg(DISTINCT nullif(specialty,''), ','),'') AS specialties, brand, generic FROM edges GROUP BY year, npi, brand, generic""",
    "p_history": base() + END + f"SELECT target, support, drug_claims, drug_years, last_year, {SPLIT} FROM ds",
    "p_latest_specialty": base() + END + "SELECT * FROM ps",
    "p_specialty_support": base() + END + f"SELECT target, latest_specialty, specialty_support, {SPLIT} FROM ss",
    "p_candidates": base() + END + f"SELECT target, npi, {SPLIT} FROM cand",
    "p_positives": base() + END + f"SELECT target, npi, claims, {SPLIT} FROM pos",
    "p_history_overlap": G2 + OVERLAP + END + "SELECT target, npi, round(overlap,6) AS overlap, drug AS generic FROM ov",
    "p_rank_specialty": G2 + OVERLAP + ranks(["specialty_popularity"]) + " SELECT method, target, npi, claims, rank, drug AS generic FROM rp",
    "p_rank_metrics": base() + OVERLAP + ranks(M3)
    + f", rb AS (SELECT *, 'all' AS band FROM rp UNION ALL SELECT *, {BAND} FROM rp), e AS ({entity('method, target, npi, band','rb')}) SELECT method, band, {SCOPE}, {POOL} FROM e CROSS JOIN {SCOPES} GROUP BY 1,2,3",
    "p_paired_recall": base() + OVERLAP + ranks(M3)
    + f""", e AS ({entity('method, target, npi')}), d AS (SELECT a.method, a.target, a.r10-b.r10 AS x FROM e a JOIN e b ON a.target=b.target AND a.npi=b.npi
      AND b.method='global_popularity' AND a.method<>'global_popularity')
      SELECT method, {SCOPE}, round(avg(x),6) AS mean_difference, count(*) AS provider_years FROM d CROSS JOIN {SCOPES} GROUP BY 1,2""",
    "p_identity_sensitivity": _identity(),
    "p_top20": G2 + OVERLAP + ranks(M2) + " SELECT method, target, npi, round(score,6) AS score, rank, drug AS generic FROM rk WHERE rank<=20",
    "p_high_score_threshold": G2 + OVERLAP + ranks(M2)
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY method, target ORDER BY score)-1 AS i, count(*) OVER (PARTITION BY method, target) AS n FROM tall)
      SELECT method, target, round(score,6) AS threshold FROM o WHERE i=ceil(CAST(0.95 AS DOUBLE)*(n-1))""",
    "p_all_provider_metrics": G2 + OVERLAP + ranks(M2)
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY method, target ORDER BY score)-1 AS i, count(*) OVER (PARTITION BY method, target) AS n FROM tall),
      th AS (SELECT method, target, score AS threshold FROM o WHERE i=ceil(CAST(0.95 AS DOUBLE)*(n-1))),
      pe AS (SELECT c.target, c.npi, CASE WHEN p.npi IS NULL THEN 0 ELSE 1 END AS eligible, coalesce(np,0) AS n_pos, coalesce(nc,0) AS n_cand
        FROM coh c LEFT JOIN ps p ON p.target=c.target AND p.npi=c.npi LEFT JOIN (SELECT target, npi, count(*) AS np FROM pos GROUP BY ALL) a ON a.target=c.target AND a.npi=c.npi
        LEFT JOIN (SELECT target, npi, count(*) AS nc FROM cand GROUP BY ALL) b ON b.target=c.target AND b.npi=c.npi),
      bs AS (SELECT target, count(*) AS target_provider_years, CAST(sum(eligible) AS BIGINT) AS eligible_provider_years, CAST(sum(1-eligible) AS BIGINT) AS ineligible_provider_years,
        count(*) FILTER (eligible=1 AND n_cand=0) AS candidate_empty_provider_years, count(*) FILTER (eligible=1 AND n_pos=0) AS positive_empty_provider_years FROM pe GROUP BY ALL),
      mk AS (SELECT r.method, r.target, r.npi, r.rank, r.score>=threshold AS high, p.drug IS NOT NULL AS hit FROM rk r JOIN th t ON t.method=r.method AND t.target=r.target
        LEFT JOIN pos p ON p.target=r.target AND p.npi=r.npi AND p.drug=r.drug WHERE rank<=20),
      pr AS (SELECT method, target, npi, """
    + ", ".join(
        f"count(*) FILTER (rank<={k}) AS s{k}, count(*) FILTER (rank<={k} AND hit) AS h{k}, count(*) FILTER (rank<={k} AND high) AS g{k}" for k in (5, 10, 20)
    )
    + """ FROM mk GROUP BY ALL), sm AS (SELECT method, target, """
    + ", ".join(
        f"CAST(sum(s{k}) AS BIGINT) AS slots_at_{k}, CAST(sum(h{k}) AS BIGINT) AS hits_at_{k}, count(*) FILTER (n_pos=0 AND s{k}>0) AS zero_positive_at_{k}, count(*) FILTER (n_pos=0 AND g{k}>0) AS zero_positive_high_at_{k}"
        for k in (5, 10, 20)
    )
    + " FROM pr JOIN pe USING (target, npi) GROUP BY ALL) SELECT *, "
    + ", ".join(
        f"round(hits_at_{k}/nullif(slots_at_{k},0),6) AS precision_at_{k}, round(slots_at_{k}/target_provider_years,6) AS burden_target_at_{k}, round(slots_at_{k}/nullif(eligible_provider_years,0),6) AS burden_eligible_at_{k}, round(zero_positive_at_{k}/nullif(positive_empty_provider_years,0),6) AS zero_fraction_at_{k}, round(zero_positive_high_at_{k}/nullif(positive_empty_provider_years,0),6) AS zero_high_fraction_at_{k}"
        for k in (5, 10, 20)
    )
    + " FROM sm JOIN bs USING (target)",
    "p_training_rows": G2 + TRAIN + "SELECT target, npi, CAST(label AS BIGINT) AS label, drug AS generic FROM tr",
    "p_features": G2 + TRAIN
    + """, f AS (SELECT t.target, t.npi, t.drug AS generic, CASE WHEN own_claims IS NULL THEN 0 ELSE 1 END AS own, support, drug_claims, coalesce(own_claims,0) AS oc,
        own_drugs, provider_claims, drug_years, last_year, p.latest_specialty AS spec, coalesce(specialty_support,0) AS sp
        FROM tr t JOIN ps p ON p.target=t.target AND p.npi=t.npi JOIN ds d ON d.target=t.target AND d.drug=t.drug
        LEFT JOIN ss s ON s.target=t.target AND s.latest_specialty=p.latest_specialty AND s.drug=t.drug)
      SELECT target, npi, generic, round(ln(1+greatest(0,support-own)),6) AS log_global_provider_support, round(ln(1+greatest(0,drug_claims-oc)),6) AS log_global_claim_total,
        round(ln(1+greatest(0.0,(drug_claims-oc)/greatest(1,support-own))),6) AS log_global_claim_mean, round(ln(1+own_drugs),6) AS log_provider_history_size,
        round(ln(1+provider_claims),6) AS log_provider_claim_total, round(ln(1+drug_years),6) AS log_drug_history_year_count,
        round(ln(1+greatest(0,target-last_year)),6) AS log_drug_age_years,
        round(ln(1+greatest(0,CASE WHEN spec IS NULL THEN 0 ELSE sp-own END)),6) AS log_specialty_provider_support,
        round(CASE WHEN spec IS NULL THEN 0.0 ELSE (sp-own)/greatest(1,support-own) END,6) AS specialty_provider_fraction,
        CAST(CASE WHEN spec IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS target_specialty_available FROM f""",
    "p_annual_audit": base()
    + """a AS (SELECT npi, drug, min(year) AS pf FROM pj GROUP BY ALL), b AS (SELECT drug, min(year) AS df FROM pj GROUP BY ALL),
      m AS (SELECT p.year, p.npi, p.drug, pf, df, lag(p.year) OVER (PARTITION BY p.npi, p.drug ORDER BY p.year) AS last FROM pj p JOIN a USING (npi, drug) JOIN b USING (drug))
      SELECT year, count(DISTINCT npi) AS observed_npis, count(DISTINCT drug) AS retained_drugs, count(*) AS retained_edges,
      count(*) FILTER (pf=year) AS first_observed_edges, count(*) FILTER (pf=year AND df=year) AS globally_new_edges,
      count(DISTINCT drug) FILTER (pf=year AND df=year) AS globally_new_drugs, count(*) FILTER (pf<year AND last<year-1) AS recurrent_after_gap,
      (SELECT count(*) FROM ucoh) AS cohort_size, (SELECT count(*) FROM ucoh)-count(DISTINCT npi) AS disappeared_npis FROM m GROUP BY year""",
    "p_claim_bands": base()
    + f"""a AS (SELECT year, {BAND} AS band, count(*) AS all_rows FROM edges GROUP BY ALL), b AS (SELECT target AS year, {BAND} AS band, count(*) AS n FROM pos GROUP BY ALL)
      SELECT year, band, all_rows, coalesce(n,0) AS eligible_positives FROM a LEFT JOIN b USING (year, band)""",
    "p_year_jaccard": base()
    + """d AS (SELECT DISTINCT year, drug FROM pj), s AS (SELECT year, count(*) AS n FROM d GROUP BY ALL),
      i AS (SELECT a.year AS ya, b.year AS yb, count(*) AS k FROM d a JOIN d b USING (drug) WHERE a.year<b.year GROUP BY ALL)
      SELECT a.year AS year_a, b.year AS year_b, coalesce(k,0) AS intersection_count, a.n+b.n-coalesce(k,0) AS union_count,
      round(coalesce(k,0)/(a.n+b.n-coalesce(k,0)),6) AS jaccard FROM s a JOIN s b ON a.year<b.year LEFT JOIN i ON ya=a.year AND yb=b.year""",
    "p_coverage": base()
    + """k AS (SELECT year, npi, count(DISTINCT nullif(specialty,'')) AS k FROM edges GROUP BY ALL)
      SELECT 'provider_years' AS measure, count(*) AS value FROM k UNION ALL SELECT 'provider_years_consistent', count(*) FROM k WHERE k=1
      UNION ALL SELECT 'provider_years_conflicting', count(*) FROM k WHERE k>1 UNION ALL SELECT 'provider_years_all_blank', count(*) FROM k WHERE k=0
      UNION ALL SELECT 'rows', count(*) FROM edges UNION ALL SELECT 'specialty_nonblank_rows', count(nullif(specialty,'')) FROM edges
      UNION ALL SELECT 'specialty_values', count(DISTINCT nullif(specialty,'')) FROM edges UNION ALL SELECT 'state_nonblank_rows', count(nullif(state,'')) FROM edges
      UNION ALL SELECT 'state:'||state, count(*) FROM edges WHERE state<>'' GROUP BY state""",
    "p_identity_diag": base()
    + """r AS (SELECT *, regexp_replace(lower(brand),'\\s+',' ','g') AS bt, regexp_replace(lower(generic),'\\s+',' ','g') AS gt FROM edges)
      SELECT 'brands_with_multiple_generics' AS measure, count(*) AS total, count(*) FILTER (k>1) AS value FROM (SELECT brand, count(DISTINCT generic) AS k FROM r GROUP BY ALL)
      UNION ALL SELECT 'generics_with_multiple_brands', count(*), count(*) FILTER (k>1) FROM (SELECT generic, count(DISTINCT brand) AS k FROM r GROUP BY ALL)
      UNION ALL SELECT 'generic_tokens_with_multiple_spellings', count(*), count(*) FILTER (k>1) FROM (SELECT gt, count(DISTINCT generic) AS k FROM r GROUP BY ALL)
      UNION ALL SELECT 'brand_tokens_with_multiple_spellings', count(*), count(*) FILTER (k>1) FROM (SELECT bt, count(DISTINCT brand) AS k FROM r GROUP BY ALL)
      UNION ALL SELECT 'generic_tokens_with_multiple_signatures', count(*), count(*) FILTER (k>1) FROM (SELECT gt, count(DISTINCT brand||'|'||generic) AS k FROM r GROUP BY ALL)
      UNION ALL SELECT 'signatures_in_multiple_years', count(*), count(*) FILTER (k>1) FROM (SELECT brand, generic, count(DISTINCT year) AS k FROM r GROUP BY ALL)
      UNION ALL SELECT 'edges_collapsed_by_generic', count(DISTINCT npi||'|'||brand||'|'||generic), count(DISTINCT npi||'|'||brand||'|'||generic)-count(DISTINCT npi||'|'||generic) FROM r""",
    "typed_validation": """SELECT count(*) FILTER (l_linenumber IN (1,2)) AS bad_npi, count(*) FILTER (l_linenumber=3 OR l_quantity<11) AS bad_claims,
      count(*) FILTER (l_linenumber IN (4,6)) AS bad_cost, count(*) FILTER (l_linenumber=2) AS bad_number, count(*) FILTER (l_linenumber=2) AS bad_flag FROM lineitem""",
}
