"""DuckDB SQL for the model queries that have a closed form."""


def start_vectors() -> str:
    """Sine start vectors by position and hash start vectors by name."""
    sine = ", ".join(f"0.05::DOUBLE * sin((idx + 1) * {(k + 8) * 0.173!r}::DOUBLE) AS s{k}" for k in range(8))
    unit = "0.05::DOUBLE * (CAST(CAST('0x' || substr(sha256('initial|drug|' || item || '|{k}'), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0::DOUBLE * 2.0 - 1.0) AS h{k}"
    return f"""SELECT item, idx, {sine}, {", ".join(unit.format(k=k) for k in range(12))}
    FROM (SELECT p_brand AS item, row_number() OVER (ORDER BY p_brand) - 1 AS idx FROM (SELECT DISTINCT p_brand FROM part))"""


COVERED = {
    "region": "r_regionkey, r_name",
    "nation": "n_nationkey, n_name, n_regionkey",
    "customer": "c_custkey, c_name, c_nationkey, c_mktsegment",
    "supplier": "s_suppkey, s_name, s_nationkey",
    "part": "p_partkey, p_name, p_brand, p_type, p_size",
    "orders": "o_orderkey, o_custkey, o_orderstatus, o_orderpriority",
    "lineitem": "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus",
}


def manifest() -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS name, count(*) AS \"rows\", CAST(sum(CAST('0x'||substr(sha256(concat_ws('|', {c})),1,15) AS HUGEINT)) AS VARCHAR) AS checksum FROM {t}" for t, c in COVERED.items()
    )


ORACLES = {
    "source_manifest": manifest(),
    "manifest_check": """SELECT 'nation' AS name, 'unlisted' AS problem UNION ALL SELECT 'lineitem', 'rows' WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_linenumber>=7)
      UNION ALL SELECT 'orders', 'content' WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderstatus='P')""",
    "first_seen_stream": "SELECT user_id, event_type, min(ts) AS first_ts FROM events GROUP BY ALL",
    "init_embedding": start_vectors(),
}
