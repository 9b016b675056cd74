"""The registered queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posetrail.llm import decontam, embedding_dedup, fill_middle, lm, ngram_join, packing, pii, prefix_trie, quality, secret_scan, sentencepiece_bpe, shared, token_counts, toxicity

MODEL, WORDS = "piece_bpe_32k.model", "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shared.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_entities"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_bpe.digests(sentencepiece_bpe.encode_decode(docs, vocabulary()))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(WORDS))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.fill_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_token_counts, op3_embedding_near_dedup, op4_ngram_jaccard_join, op5_quality_classifier, op6_lm_scoring,
        op7_pii_surrogates, op8_benchmark_decontamination, op9_secret_scan, op10_sentencepiece,
        op11_best_fit_packing, op12_conversation_trie, op13_fill_in_middle,
    )
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS, _ALNUM = rf"regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+')", rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Components of links (x, y): everything that is reachable, then the smallest of it.
_REACH = "reach(x, y) as (select x, y from link union select r.x, l.y from reach r join link l on r.y = l.x)"

#: What SQL can express; the others depend on learned weights, merges, keys or regular expressions with a state.
ORACLE_SQL: dict[str, str] = {
    "op3_embedding_near_dedup": f"""with recursive v as (select vec_id, embedding::double[] e, sqrt(list_dot_product(embedding::double[], embedding::double[])) n from embeddings where embedding is not null),
f as (select vec_id, e, n, len(e) d from v where n > 0 and isfinite(n)), link as (select a.vec_id x, b.vec_id y from f a join f b on a.d = b.d and a.vec_id <> b.vec_id where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9), {_REACH},
c as (select x, count(*) n from link group by x), m as (select x, min(y) y from reach group by x)
select vec_id, coalesce(n, 0) n_links, least(vec_id, coalesce(y, vec_id)) component_id, vec_id = least(vec_id, coalesce(y, vec_id)) as kept from (select vec_id from embeddings) t left join c on vec_id = c.x left join m on vec_id = m.x""",
    "op4_ngram_jaccard_join": f"""with recursive w as (select doc_id, {_WORDS} w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') s from w, unnest(range(1, greatest(len(w) - 3, 2))) u(i) where len(w) > 0), n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
link as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)), {_REACH}, m as (select x, min(y) y from reach group by x)
select w.doc_id, coalesce(n, 0) n_shingles, least(w.doc_id, coalesce(y, w.doc_id)) component_id from w left join n using (doc_id) left join m on w.doc_id = m.x""",
    "op8_benchmark_decontamination": f"""with d as (select doc_id, {_ALNUM} w from documents), b as (select cast(item_id as varchar) item_id, {_ALNUM} w from benchmark where item_id is not null),
bi as (select item_id, w, least(len(w), 13) n from b where len(w) > 0), bw as (select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') t from bi, unnest(range(1, len(w) - n + 2)) u(i)),
dw as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') t from d, (select distinct n from bi) l, unnest(range(1, len(w) - n + 2)) u(i)),
h as (select doc_id, n, i, item_id from dw join bw using (n, t)), hp as (select doc_id, count(*) n_hit from (select distinct doc_id, unnest(range(i, i + n)) p from h) group by doc_id),
it as (select doc_id, count(*) n_items, sha256(string_agg(item_id, ',' order by item_id)) s from (select distinct doc_id, item_id from h) group by doc_id)
select d.doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, coalesce(s, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated from d left join hp using (doc_id) left join it using (doc_id)""",
    # crc32 bit by bit; a node is a list of turns
    "op12_conversation_trie": rf"""with t as (select conv_id c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) p, struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) u from conversations where conv_id is not null),
c as (select c, count(*) n, list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(cast(c as varchar), ''), lambda d: list_concat([ascii(d)::bigint], [-1::bigint, -1, -1, -1, -1, -1, -1, -1])))), lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, (a & 1) * 3988292384) end) z from t group by c),
h as (select c, n, xor(z, 4294967295) % 4 h, c - c % 20 b from c), m as (select h.*, least(h.h, coalesce(g.n, 0)) m from h left join c g on g.c = h.b),
v as (select m.c, p - h + m p, u from m join t on t.c = m.c where p > h union all select m.c, p, u from m join t on t.c = m.b where p <= m),
q as (select c, array_agg(u) over (partition by c order by p) path from v union all select c, [] from c),
n as (select path, len(path) d, min(c) c, count(*) n from q group by path), k as (select path[1:len(path) - 1] path, count(*) n from n where len(path) > 0 group by 1),
e as (select path, sha256(string_agg(cast(c as varchar), ',' order by c)) s from (select c, arg_max(path, len(path)) path from q group by c) group by path),
w as (select n.*, case when d = 0 then 0 else (n.n - 1) * len(regexp_extract_all(n.path[d].x, '[^\x20\x09-\x0D]+')) end s, k.n kids from n left join k on k.path = n.path),
z as (select path[1:j] path, sum(s) s, sum(case when kids is null then 1 else 0 end) l from w, unnest(range(0, d + 1)) u(j) group by 1)
select n.c conv_id, n.d depth, p.c parent_conv_id, n.n n_convs, cast(coalesce(n.kids, 0) as bigint) n_children, cast(z.l as bigint) n_leaves, cast(z.s as bigint) saved_tokens, coalesce(e.s, sha256('')) ends_sha256
from w n join z on z.path = n.path left join e on e.path = n.path left join n p on n.d > 0 and p.path = n.path[1:n.d - 1]""",
    "op13_fill_in_middle": rf"""with t as (select doc_id, coalesce(text, '') t, sha256('42:' || coalesce(cast(doc_id as varchar), '')) h from documents),
u as (select doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') u, cast('0x' || h[1:8] as bigint) h1, cast('0x' || h[9:16] as bigint) h2, cast('0x' || h[17:24] as bigint) h3, cast('0x' || h[25:32] as bigint) h4 from t),
c as (select *, len(u) n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) b from u),
p as (select *, coalesce(array_to_string(u[1:a], ''), '') pre, coalesce(array_to_string(u[a + 1:b], ''), '') mid, coalesce(array_to_string(u[b + 1:n], ''), '') suf,
case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end form from c)
select doc_id, cast(n as bigint) n, form, case when form <> 'plain' then cast(length(pre) as bigint) end prefix_chars, case when form <> 'plain' then cast(length(mid) as bigint) end middle_chars,
sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) output_sha256, sha256(t) restored_sha256 from p""",
}
