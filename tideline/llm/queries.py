"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.llm import ann, bpe, ngram_lm, secrets, token_counts, toxicity
from tideline.llm.collocation import collocations
from tideline.llm.common import table
from tideline.llm.decontaminate import contaminated
from tideline.llm.mixing import SCHEDULES, planned, segments, word_count
from tideline.llm.near_dedup import near_duplicates
from tideline.llm.prefix_trie import ordered_turns, shared_heads, trie
from tideline.llm.quality import judged
from tideline.llm.url_filter import filtered


def op1_bayes_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return judged(docs, table(spark, sf_dir, "labels")).select("doc_id", "evidence", "site_rate", "quality", "accepted")


def op2_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.trained(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), grade="toxic", split=True)
    return toxicity.scored(docs, model).select("doc_id", "severity", "grade", (F.col("grade") >= 1).alias("toxic"))


def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path(), decode=True)
    return tokens.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded_text"), 256).alias("decoded_sha256"),
    )


def op6_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_lm.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1)


def op7_section_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.section_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = secrets.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = {r.kind for r in secrets.BASE}
    count = lambda kind: F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return docs.select(
        "doc_id",
        *(count(r.kind) for r in secrets.BASE),
        F.sha2(secrets.joined_spans(F.col("secret_spans"), base), 256).alias("base_sha256"),
        secrets.joined_spans(F.col("secret_spans")).alias("spans"),
    )


def op5_sql() -> str:
    """The same spans in DuckDB: matches and the texts between them give the places."""
    lists = []
    for k, r in enumerate(secrets._plain(secrets.RULES)):
        p = r.pattern.replace("'", "''")
        lists.append(f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{p}')) + 1), lambda i: {{
            'start': list_sum(list_transform(string_split_regex(t, '{p}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}')[1:i-1], lambda x: length(x))), 0),
            'k': {k}, 'n': length(regexp_extract_all(t, '{p}')[i]), 'kind': '{r.kind}', 'v': length(regexp_extract_all(t, '{p}', {r.value})[i])}}), lambda z: z.v >= {r.least})""")
    text = "list_transform({}, lambda z: z.kind || ':' || z.start::bigint || ':' || (z.start + z.n)::bigint)"
    base = "list_filter(hits, lambda x: x.k < 3)"
    return f"""
    with found as (select doc_id, list_sort(list_concat({", ".join(lists)})) as hits from (select doc_id, coalesce(text, '') as t from documents))
    select doc_id, {", ".join(f"len(list_filter(hits, lambda x: x.k = {k}))::bigint as n_{r.kind}" for k, r in enumerate(secrets.BASE))},
      sha256(coalesce(array_to_string({text.format(base)}, ','), '')) as base_sha256, coalesce(array_to_string({text.format("hits")}, ','), '') as spans
    from found"""


def op9_link_graph_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return filtered(pages).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def op10_learned_partitions_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where("vec_id % 20 = 0"), nearest=20)


def op11_de_bruijn_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op12_contracted_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, members = shared_heads(ordered_turns(table(spark, sf_dir, "conversations")))
    return trie(turns, members)


def op13_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    plan = planned(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")), F.col("words"))
    first = F.round(F.get("parts", F.lit(0))["position"], 6)
    out = plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.size("parts").cast("long").alias("n_occurrences"), first.alias("first_position"))
    return out.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = rf"""
with recursive words as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
shingles as (select distinct doc_id, unnest(case when len(w) = 1 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from words where len(w) > 0),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select x, y from common join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
both_ways as (select x, y from links union all select y, x from links),
reached as (select doc_id, doc_id as root from documents union select y, root from reached join both_ways on x = doc_id)
select doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(root) as component_id, doc_id = min(root) as kept
from reached left join sizes using (doc_id) group by doc_id"""

OP8_SQL = rf"""
with words as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
sized as (select item_id, w, least(10, len(w)) as n from items where len(w) > 0),
windows as (select distinct item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) as win from sized),
places as (select doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {{'i': i, 'win': array_to_string(w[i:i + n - 1], ' ')}})) as p from words, (select distinct n from windows)),
hits as (select doc_id, p.i as i, places.n as n, item_id from places join windows on windows.n = places.n and win = p.win),
covered as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + n)) as at from hits) group by doc_id),
found as (select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id::varchar)), ',') as ids from hits group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from words left join covered using (doc_id) left join found using (doc_id)"""


#: Pieces and words as the operator cuts them, every gram of each length, and the rules of the contract.
OP11_SQL = r"""
with texts as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as p from texts),
split as (select lang, w from (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from pieces) where len(w) > 0),
totals as (select lang, sum(len(w))::hugeint as n from split group by lang),
grams as (select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) as phrase from split, (select unnest(range(1, 6)) as m) where len(w) >= m),
counts as (select lang, m, phrase, count(*)::hugeint as a from grams group by all having count(*) >= 100),
longer as (select lang, phrase, string_split(phrase, ' ') as w, m, a from counts where m > 2),
inner_ as (select lang, array_to_string(w[i:i + k - 1], ' ') as phrase, max(a) as a from longer, (select unnest(range(1, 5)) as i) ii, (select unnest(range(2, 5)) as k) kk where k < m and i + k - 1 <= m group by all),
live as (select c.lang, c.m, c.phrase, c.a, string_split(c.phrase, ' ') as w from counts c left join inner_ i on c.lang = i.lang and c.phrase = i.phrase where c.m > 1 and (i.a is null or 100 * i.a < 100 * c.a)),
cuts as (select lang, phrase, a, k, array_to_string(w[1:k], ' ') as one, array_to_string(w[k + 1:], ' ') as two from live, (select unnest(range(1, 5)) as k) where k < m),
scores as (select c.lang, c.phrase, c.a, c.k, x.a as l, y.a as r, n, (1000 * c.a * n) // (x.a * y.a) as score
  from cuts c join counts x on x.lang = c.lang and x.phrase = one join counts y on y.lang = c.lang and y.phrase = two join totals t on t.lang = c.lang),
lowest as (select * from scores qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest) where rank <= 2000"""

#: Every rebuilt conversation as a list of turn digests; ancestors of a node are the prefixes of its smallest member.
OP12_SQL = r"""
with turns as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as idx,
  md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as d, strlen(coalesce(text, '')) as bytes from conversations where conv_id is not null),
convs as (select conv_id, conv_id - conv_id % 5 as base, list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(conv_id::varchar, ''), lambda b: [ascii(b)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda s, x: case when x >= 0 then xor(s, x) else xor(s >> 1, (s & 1) * 3988292384) end) as crc from (select distinct conv_id from turns)),
heads as (select conv_id, base, xor(crc, 4294967295) % 9 as h from convs),
joined as (select h.conv_id, 0 as own, t.idx, d, bytes from heads h join turns t on t.conv_id = base and idx < h union all select h.conv_id, 1, t.idx, d, bytes from heads h join turns t on t.conv_id = h.conv_id and idx >= h),
lists as (select h.conv_id, coalesce(list(d order by own, idx) filter (where d is not null), []) as ds, coalesce(list(bytes order by own, idx) filter (where d is not null), []) as bs from heads h left join joined using (conv_id) group by h.conv_id),
members as (select conv_id, k as depth, array_to_string(ds[1:k], '/') as prefix, case when k = 0 then 0 else bs[k] end as bytes, len(ds) = k as ends from (select *, unnest(range(0, len(ds) + 1)) as k from lists)),
nodes as (select prefix, depth, min(conv_id) as conv_id, count(*) as n_convs, max(bytes) as bytes, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256 from members group by prefix, depth),
up as (select n.prefix, n.depth, m.prefix as above, m.depth as above_depth from nodes n join members m on m.conv_id = n.conv_id and m.depth <= n.depth),
kids as (select above, above_depth, count(*) as n_children, min(prefix) from up where above_depth = depth - 1 group by above, above_depth),
leaves as (select prefix, depth from nodes n where not exists (select 1 from kids k where k.above = n.prefix and k.above_depth = n.depth)),
totals as (select above, above_depth, sum(case when l.prefix is null then 0 else 1 end) as n_leaves, sum((n_convs - 1) * bytes) as saved from up join nodes n using (prefix, depth) left join leaves l using (prefix, depth) group by above, above_depth)
select n.conv_id::bigint as conv_id, n.depth::bigint as depth, p.conv_id::bigint as parent_conv_id, n.n_convs::bigint as n_convs, coalesce(n_children, 0)::bigint as n_children, n_leaves::bigint as n_leaves, saved::bigint as saved_tokens, n.ends_sha256
from nodes n left join up u on u.prefix = n.prefix and u.depth = n.depth and u.above_depth = n.depth - 1 left join nodes p on p.prefix = u.above and p.depth = u.above_depth
left join kids k on k.above = n.prefix and k.above_depth = n.depth join totals t on t.above = n.prefix and t.above_depth = n.depth"""


def op13_sql() -> str:
    """The shares by trying every number of stopped sources; the inverse of the schedules piece by piece."""
    branches = []
    for kind, schedule in enumerate(SCHEDULES):
        rows = segments(schedule)
        steps = " ".join(
            f"when u < {after!r} then {start!r} + coalesce(least(2.0 * (u - {area!r}) / nullif({low!r} + sqrt(greatest({low * low!r} + {2 * slope!r} * (u - {area!r}), 0.0)), 0.0), {width!r}), 0.0)"
            for (area, start, width, low, slope), after in zip(rows, [r[0] for r in rows[1:]] + [2.0])
        )
        branches.append(f"when {kind} then (case {steps} else 1.0 end)")
    return rf"""
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
sums as (select source, sum(size)::bigint as source_size, row_number() over (order by source is null, source) - 1 as place from sized group by source),
weighed as (select *, [5, 2, 1][place % 3 + 1]::bigint as w, (place % 3)::int as kind, 3 * source_size as ceiling from sums),
upto as (select *, sum(ceiling) over o as cs, sum(w) over o as ws, sum(source_size) over () as every, sum(w) over () as weights from weighed window o as (order by ceiling / w, place rows unbounded preceding)),
marked as (select *, (every - cs + ceiling) * w >= ceiling::hugeint * (weights - ws + w) as full_ from upto),
goals as (select source, kind, source_size, case when full_ then ceiling::double else (w * (every - coalesce(sum(ceiling) filter (where full_) over (), 0))::double) / greatest(weights - coalesce(sum(w) filter (where full_) over (), 0), 1)::double end as target from marked),
runs as (select s.doc_id, s.size, g.kind, g.source_size, g.target, floor(g.target + 0.5)::bigint as demand, (sum(s.size) over (partition by s.source order by md5(coalesce(s.doc_id::varchar, '')), s.doc_id, s.size rows unbounded preceding) - s.size)::bigint as before
  from sized s join goals g on s.source is not distinct from g.source),
parts as (select *, case when source_size > 0 then demand // source_size else 0 end as rounds from runs),
taken as (select *, greatest(least(demand - rounds * source_size - before, size), 0) as rest from parts),
placed as (select *, (before + (case when rounds > 0 then size else rest end) / 2.0::double) / nullif(demand, 0)::double as u from taken)
select doc_id, size, source_size::bigint as source_size, target, (rounds * size + rest)::bigint as taken, (case when size > 0 then rounds + (rest > 0)::int else 0 end)::bigint as n_occurrences,
  case when rounds * size + rest > 0 then round(case kind {" ".join(branches)} end, 6) end as first_position
from placed"""


QUERIES = {f.__name__: f for f in (op1_bayes_quality, op2_superminhash_dedup, op3_ordinal_toxicity, op4_bpe_roundtrip, op5_trigram_secrets, op6_bloom_lm, op7_section_token_counts, op8_fm_index_decontamination, op9_link_graph_url_filter, op10_learned_partitions_ann, op11_de_bruijn_collocations, op12_contracted_prefix_trie, op13_curriculum_mix)}

ORACLES = {"op2_superminhash_dedup": OP2_SQL, "op5_trigram_secrets": op5_sql(), "op8_fm_index_decontamination": OP8_SQL, "op11_de_bruijn_collocations": OP11_SQL, "op12_contracted_prefix_trie": OP12_SQL, "op13_curriculum_mix": op13_sql()}
