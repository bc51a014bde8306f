"""The registered queries opN_<name> of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm import collocations, decontaminate, htmltext, lmscore, minhash, mixing, prefixtrie, secrets, simhash, tokencounts, tokenids, topk, toxicity
from kgspark.llm.common import in_split, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op2_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.token_files(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < 3)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans")
    )


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, sources = mixing.mix(table(spark, sf_dir, "documents"))
    # one row per source
    by_source = F.broadcast(sources.withColumnRenamed("source", "of"))
    return mixed.join(by_source, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", F.col("mix_size").alias("size"), "source_size", "target", mixing.taken(F.col("mix_copies"), F.col("mix_size")).alias("taken")
    )


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select("doc_id", in_split(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", "abusive_hits", "quoted_hits")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"), in_split(F.col("doc_id"), 7, 2), tokenizer("word_bpe_49k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencounts.section_tokens(table(spark, sf_dir, "documents"), tokencounts.lines(F.col("text")), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_top_k,
        op2_token_id_files,
        op3_secret_scan,
        op4_benchmark_decontamination,
        op5_source_mixing,
        op6_simhash_near_dedup,
        op7_toxicity,
        op8_html_extraction,
        op9_lm_scores,
        op10_token_counts,
        op11_prefix_trie,
        op12_minhash_near_dedup,
        op13_phrase_collocations,
    )
}

#: Patterns as RE2 reads them, group 1 the match and, for assign, group 2 the value: (kind, pattern, least length, group).
_SQL_RULES = (
    ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))""", 6, 2),
    ("access", r"(AKIA[A-Z0-9]+)", 20, 1),
    ("hex", r"([0-9a-f]+)", 24, 1),
    ("pem", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 1),
    ("github", r"(gh[pousr]_[A-Za-z0-9]{36,})", 40, 1),
    ("slack", r"(xox[abprs]-[A-Za-z0-9-]{10,})", 15, 1),
    ("google", r"(AIza[A-Za-z0-9_-]{35})", 39, 1),
)


def _secret_sql() -> str:
    parts = "\n union all ".join(
        f"select doc_id, '{kind}' as kind, {k} as k, {least} as least, regexp_extract_all(t, '{p}', 1) as ms, regexp_extract_all(t, '{p}', {g}) as vs, string_split_regex(t, '{p}') as gs from d"
        for k, (kind, p, least, g) in enumerate(_SQL_RULES)
    )
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
m as ({parts}),
u as (select doc_id, kind, k, least, unnest(range(1, len(ms) + 1)) as i, ms, vs, gs from m),
w as (select doc_id, kind, k, i, least, vs[i] as v, ms[i] as m, ms, gs from u where length(vs[i]) >= least),
s as (select doc_id, kind, k, length(m) as l,
 coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) as a from w),
f as (select doc_id, kind, k, cast(a as bigint) as a, cast(a + l as bigint) as b from s)
select d.doc_id, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
 sha256(coalesce(string_agg(concat(kind, ':', a, ':', b), ',' order by a, k) filter (k < 3), '')) as base_sha256,
 coalesce(string_agg(concat(kind, ':', a, ':', b), ',' order by a, k) filter (k is not null), '') as spans
from d left join f on d.doc_id = f.doc_id group by d.doc_id"""


ORACLE_SQL: dict[str, str] = {
    "op1_exact_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as c from embeddings
 where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, v.vec_id, cast(list_inner_product(q.c, v.c) as bigint) as score
 from v q join v on q.vec_id % 50 = 0 and v.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5""",
    "op3_secret_scan": _secret_sql(),
    "op11_prefix_trie": r"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
 from conversations where conv_id is not null),
o as (select conv_id, list(struct_pack(role := role, text := text) order by pos) as own from t group by conv_id),
h as (select conv_id, own, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(conv_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
 lambda a, c: list_reduce(list_prepend(xor(a, c), [cast(0 as bigint) for i in range(8)]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))) as crc from o),
g as (select conv_id, own, xor(crc, 4294967295) % 9 as h, conv_id - conv_id % 5 as base from h),
r as (select g.conv_id, list_concat(coalesce(b.own, [])[1:g.h], g.own[g.h + 1:]) as turns from g left join o b on b.conv_id = g.base),
m as (select conv_id, unnest(range(0, len(turns) + 1)) as depth, turns from r),
p as (select conv_id, depth, turns[1:depth] as path, depth = len(turns) as ends, case when depth = 0 then 0 else octet_length(encode(turns[depth].text)) end as bytes from m),
n as (select path, depth, min(conv_id) as conv_id, count(*) as n_convs, max(bytes) as bytes, sha256(coalesce(string_agg(conv_id, ',' order by conv_id) filter (ends), '')) as ends_sha256 from p group by path, depth),
k as (select p.conv_id as member, n.* from p join n on n.depth = p.depth and n.path = p.path),
u as (select n.*, a.conv_id as parent_conv_id from n left join k a on a.member = n.conv_id and a.depth = n.depth - 1),
c as (select parent_conv_id, depth - 1 as depth, count(*) as n_children from u where parent_conv_id is not null group by all),
w as (select u.*, coalesce(c.n_children, 0) as n_children from u left join c on c.parent_conv_id = u.conv_id and c.depth = u.depth),
s as (select a.conv_id, a.depth, sum((w.n_convs - 1) * w.bytes) as saved_tokens, count(*) filter (w.n_children = 0) as n_leaves from w join k a on a.member = w.conv_id and a.depth <= w.depth group by all)
select w.conv_id, w.depth, w.parent_conv_id, w.n_convs, w.n_children, s.n_leaves, cast(s.saved_tokens as bigint) as saved_tokens, w.ends_sha256 from w join s on s.conv_id = w.conv_id and s.depth = w.depth""",
    "op12_minhash_near_dedup": r"""
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
 else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as xs from d),
u as (select doc_id, unnest(xs) as x from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from u a join u b on a.x = b.x and a.doc_id <> b.doc_id group by all),
l as (select p.a, p.b from p join s x on x.doc_id = p.a join s y on y.doc_id = p.b where 100 * common >= 85 * (len(x.xs) + len(y.xs) - common)),
r(a, b) as (select doc_id, doc_id from s union select r.a, l.b from r join l on l.a = r.b)
select s.doc_id, len(s.xs) as n_shingles, min(r.b) as component_id, s.doc_id = min(r.b) as kept from s join r on r.a = s.doc_id group by s.doc_id, s.xs""",
    "op13_phrase_collocations": r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from p),
g as (select lang, ws, m, unnest(range(1, len(ws) + 2 - m)) as i from w, (values (1), (2), (3)) v(m) where len(ws) >= m),
f as (select lang, m, array_to_string(ws[i:i + m - 1], ' ') as phrase, count(*) as c from g group by all),
n as (select lang, sum(len(ws)) as n from w group by lang),
c as (select lang, m, phrase, string_split(phrase, ' ') as ws, c as a from f where m > 1 and c >= 10),
k as (select *, unnest(range(1, m)) as k from c),
s as (select k.lang, k.m, k.phrase, k.ws, k.a, k.k, l.c as l, r.c as r, cast(1000000 as hugeint) * k.a * k.a // (cast(l.c as hugeint) * r.c) as score
 from k join f l on l.lang = k.lang and l.phrase = array_to_string(k.ws[1:k.k], ' ') join f r on r.lang = k.lang and r.phrase = array_to_string(k.ws[k.k + 1:], ' ')),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
x as (select lang, array_to_string(ws[1:2], ' ') as phrase, a from c where m = 3 union all select lang, array_to_string(ws[2:3], ' '), a from c where m = 3),
e as (select lang, phrase, max(a) as a from x group by all),
o as (select b.* from b left join e on b.m = 2 and e.lang = b.lang and e.phrase = b.phrase where e.a is null or 100 * e.a < 50 * b.a),
t as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from o)
select t.lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from t join n on n.lang = t.lang where rank <= 2000""",
}
