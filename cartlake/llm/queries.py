"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartlake.llm import hard_negatives, language_id, media_columns, mixing, near_dedup, packing, pii, prefix_trie, suffix_tree, token_counts, token_files, warc_bundles, winnowing
from cartlake.llm.staging import staged


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


def op2_gif_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.payload_features(staged(media_columns.store_payloads(table(spark, sf_dir, "documents")), "media"))


def op3_splitting_tree_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op4_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_bundles.archive_pages(table(spark, sf_dir, "pages"))


def op6_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return suffix_tree.score(docs, *suffix_tree.train(docs))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprint_edits(table(spark, sf_dir, "documents"))


def op8_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_places(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


def op13_hyperplane_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_gif_columns, op3_splitting_tree_mix, op4_tensored_minhash, op5_warc_bundles, op6_suffix_tree_scores, op7_winnowing, op8_sum_of_squares_packing, op9_pii_spans, op10_language_id, op11_prefix_trie, op12_token_files, op13_hyperplane_tree_negatives)}
#: The others depend on compression, trained models, random draws, hash functions or tokenizers that SQL does not have.
ORACLES: dict[str, str] = {
    "op5_warc_bundles": """select page_id, n as payload_bytes, digest as payload_digest, case when page_id > first_id then 'revisit' else 'response' end as record_type, case when page_id > first_id then first_id end as refers_to from (
        select page_id, n, digest, case when n >= 100 then min(page_id) over (partition by digest) end as first_id from (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as digest from pages) p) q""",
    "op13_hyperplane_tree_negatives": """with e as (select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
            from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.rid as a, a.vec_id as anchor_id, b.rid, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score from e a join e b on a.vec_id % 100 = 0 and a.rid <> b.rid),
        p as (select *, row_number() over (partition by a order by score desc, vec_id, rid) as n from s where same qualify n <= 5)
        select p.anchor_id, p.vec_id as positive_id, row_number() over (partition by p.a, p.n order by s.score desc, s.vec_id, s.rid) as rank, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score
        from p join s on s.a = p.a and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score qualify rank <= 10""",
    # crc32 is spelled out, as the engine has none; a prefix is the joined digests of its turns, 64 characters each.
    "op11_prefix_trie": """with tab as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
        own as (select conv_id, md5(role) || md5(text) as p, octet_length(encode(text)) as b, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as pos from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null) c),
        ids as (select conv_id, conv_id - conv_id % 5 as base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(conv_id as varchar), ''), lambda s: ascii(s))), lambda a, s: xor(a >> 8, t[(xor(a, s) & 255) + 1])), 4294967295) % 9 as h from (select distinct conv_id from own) d, tab),
        sized as (select conv_id, count(*) as n from own group by 1),
        rebuilt as (select i.conv_id, o.pos, o.p, o.b from ids i join own o on o.conv_id = i.base and o.pos < i.h
            union all select i.conv_id, least(i.h, coalesce(s.n, 0)) + o.pos - i.h, o.p, o.b from ids i join own o on o.conv_id = i.conv_id and o.pos >= i.h left join sized s on s.conv_id = i.base),
        prefix as (select conv_id, pos + 1 as depth, string_agg(p, '') over (partition by conv_id order by pos) as p, b from rebuilt union all select conv_id, 0, '', 0 from ids),
        nodes as (select depth, p, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * max(b) as saved from prefix group by 1, 2),
        children as (select depth - 1 as depth, left(p, length(p) - 64) as p, count(*) as n from nodes where depth > 0 group by 1, 2),
        ending as (select depth, p, sha256(string_agg(cast(conv_id as varchar), ',' order by conv_id)) as sha from prefix where depth = (select coalesce(max(pos) + 1, 0) from rebuilt r where r.conv_id = prefix.conv_id) group by 1, 2),
        below as (select d as depth, left(n.p, 64 * d) as p, sum(n.saved) as saved, sum(case when c.n is null then 1 else 0 end) as leaves from (select *, unnest(range(depth + 1)) as d from nodes) n left join children c on c.depth = n.depth and c.p = n.p group by 1, 2)
        select n.conv_id, n.depth, u.conv_id as parent_conv_id, n.n_convs, coalesce(c.n, 0) as n_children, cast(s.leaves as bigint) as n_leaves, cast(s.saved as bigint) as saved_tokens, coalesce(e.sha, sha256('')) as ends_sha256
        from nodes n join below s on s.depth = n.depth and s.p = n.p left join children c on c.depth = n.depth and c.p = n.p left join ending e on e.depth = n.depth and e.p = n.p left join nodes u on u.depth = n.depth - 1 and u.p = left(n.p, length(n.p) - 64)""",
}
