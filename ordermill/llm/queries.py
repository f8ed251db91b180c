"""The registered text queries: each applies its operator to the whole table and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill.llm import (
    byte_bpe, gam, lev_trie, mixing, order_minhash, packing, rank_merge, rules_forest, scaled_sketch, suffix_levels,
    turn_repair, warc, zone_negatives)
from ordermill.llm.common import table


def document_levels() -> dict[str, Column]:
    """The tree of documents; as the table has no domain, one of four is derived from the source's name."""
    return {"domain": F.concat(F.lit("d"), F.crc32(F.coalesce("source", F.lit("")).cast("binary")) % 4),
            "lang": F.col("lang"), "source": F.col("source")}


#: Weights of domains and of languages within each; sources weigh the same.
DOMAIN_WEIGHTS = {("d0",): 4.0, ("d1",): 3.0, ("d2",): 2.0, ("d3",): 1.0}
WEIGHTS = DOMAIN_WEIGHTS | {(*d, lang): w for d in DOMAIN_WEIGHTS
                            for lang, w in (("en", 5.0), ("de", 2.0), ("fr", 2.0), ("es", 1.0))}


def op1_weighted_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a mix of six tenths of all words, each at most three times."""
    rows = mixing.mixed_rows(table(spark, folder, "documents"), document_levels(), WEIGHTS, 0.6, 3, 17)
    return rows.select("doc_id", F.array_join("mix_path", "/").alias("leaf"), F.col("mix_epoch").alias("epoch"),
                       F.col("mix_tokens").alias("n_tokens"), F.col("mix_tokens_taken").alias("n_taken"))


def op2_rules_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Rule statistics, base rules and the forest's verdict on every document."""
    return rules_forest.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces, packed into sequences of at most 4096 tokens."""
    return packed(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def packed(docs: DataFrame, path: str) -> DataFrame:
    """Pieces with a checksum of their ids instead of these, and their places."""
    pieces = packing.token_pieces(docs, path)
    return packing.place(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op4_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate class of every document; the first of a class is kept."""
    found = order_minhash.document_classes(table(spark, folder, "documents"))
    return found.select("doc_id", "class_id", (F.col("rid") == F.col("class_rid")).alias("kept"))


def op5_additive_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The quality score of every document."""
    return gam.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_suffix_levels(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without the 100-byte strings that start earlier, too."""
    out = suffix_levels.deduplicated(table(spark, folder, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes, tokens and whether there are more than 512, for every document."""
    return rank_merge.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                   public_tokenizers.PATTERN, 512)


def op8_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    """The pages through WARC archives and back, equal payloads stored once."""
    records = table(spark, folder, "pages").select(
        F.col("page_id").alias("id"), "url", F.col("html").cast("binary").alias("payload"))
    rows = warc.archived(spark, records, "2024-01-01T00:00:00Z")
    return rows.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast("long").alias("refers_to"))


def op9_scaled_sketch(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches of every document and its edited text, and how alike they are."""
    return scaled_sketch.fingerprints(table(spark, folder, "documents"))


def op10_lev_trie_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity score of every document."""
    return lev_trie.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation, after planted damage."""
    return turn_repair.repairs(turn_repair.damaged(table(spark, folder, "conversations")), "alive")


def op12_zone_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, some labels raised by one."""
    rows = table(spark, folder, "embeddings")
    return zone_negatives.hard_negatives(rows.withColumn("label", zone_negatives.relabelled(rows)), 50)


def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, and their bytes put together again."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = byte_bpe.decoded(byte_bpe.encoded(table(spark, folder, "documents"), path), path)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_weighted_mix, op2_rules_forest, op3_best_fit_packing, op4_order_minhash, op5_additive_quality, op6_suffix_levels,
    op7_token_counts, op8_warc_revisits, op9_scaled_sketch,
    op10_lev_trie_toxicity, op11_turn_repair, op12_zone_negatives, op13_byte_bpe)}
#: Five hex digits of a SHA-1 are four letters of base 32.
_FIVES = [f"cast('0x' || substr(h, {at}, 5) as integer)" for at in range(1, 41, 5)]
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({v} >> {s}) & 31) + 1, 1)" for v in _FIVES for s in (15, 10, 5, 0))
ORACLES: dict[str, str] = {"op8_warc_revisits": f"""
    with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
      d as (select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, {_BASE32} as payload_digest from p),
      f as (select *, min(page_id) over (partition by payload_digest) as first from d)
    select page_id, payload_bytes, payload_digest,
      case when page_id is distinct from first and first is not null then 'revisit' else 'response' end as record_type,
      case when page_id is distinct from first then first end as refers_to from f""",
    "op11_turn_repair": """
    with recursive named as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        concat(coalesce(cast(conv_id as varchar), ' '), ':', coalesce(cast(turn as varchar), ' ')) as k from conversations),
      crc as (select *, xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, len(k) + 1), lambda i: cast(ascii(substr(k, i, 1)) as bigint))),
          lambda c, b: list_reduce(list_concat([xor(c, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 as fault
        from named),
      damaged as (select conv_id, turn, case fault when 4 then 'user' else role end as role,
          case fault when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
        from crc cross join range(2) as t(copy) where fault <> 0 and (copy = 0 or fault = 3)),
      ended as (select *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as stop,
          row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) as n from damaged),
      marked as (select *, stop = '' as blank, row_number() over (partition by conv_id, role, text order by n) > 1 as again,
          right(stop, 1) not in ('.', '!', '?') as cut, left(role, 1) as kind,
          lag(left(role, 1)) over (partition by conv_id order by n) as before from ended),
      coded as (select *, blank or again as gone, cut and not blank and not again as short from marked),
      moves(k, was, last, added) as (values (0, '', '', []::varchar[]), (0, 's', 's', []), (0, 'u', 'u', []), (0, 'a', 'a', []),
          (1, '', 'u', ['user:']), (1, 's', 'u', ['user:']), (1, 'u', 'a', ['assistant:']), (1, 'a', 'u', ['user:']),
          (2, '', 'a', ['user:', 'assistant:']), (2, 's', 'a', ['user:', 'assistant:']), (2, 'u', 'u', ['assistant:', 'user:']), (2, 'a', 'a', ['user:', 'assistant:'])),
      walk as (select distinct conv_id, 0::bigint as n, '' as last, 0::bigint as cost, '' as audit, []::varchar[] as written from conversations
        union all
        select conv_id, n, last, cost, audit, written from (
          select w.conv_id, r.n, case e.edit when 'D' then m.last when 'K' then r.kind else case m.last when 'u' then 'a' else 'u' end end as last,
            w.cost + 2 * m.k + case e.edit when 'D' then 3 when 'K' then cast(r.short as bigint) else 2 + cast(r.short as bigint) end as cost,
            w.audit || repeat('I', m.k) || e.edit as audit,
            list_concat(w.written, m.added, case e.edit when 'D' then []::varchar[] when 'K' then [r.role || ':' || r.text]
              else [case m.last when 'u' then 'assistant:' else 'user:' end || r.text] end) as written
          from walk w join coded r on r.conv_id is not distinct from w.conv_id and r.n = w.n + 1 join moves m on m.was = w.last
            cross join (values ('D'), ('K'), ('R')) as e(edit)
          where e.edit = 'D' or (not r.gone and case e.edit when 'K' then r.kind = case m.last when 'u' then 'a' else 'u' end or (r.kind = 's' and m.last = '')
            else r.kind <> case m.last when 'u' then 'a' else 'u' end end)
          qualify row_number() over (partition by w.conv_id, r.n, case e.edit when 'D' then m.last when 'K' then r.kind else case m.last when 'u' then 'a' else 'u' end end
            order by w.cost + 2 * m.k + case e.edit when 'D' then 3 when 'K' then cast(r.short as bigint) else 2 + cast(r.short as bigint) end,
              w.audit || repeat('I', m.k) || e.edit) = 1)),
      counts as (select conv_id, max(n) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
          count(*) filter (not blank and again) as duplicate, count(*) filter (short) as truncated,
          count(*) filter (before is not null and before || kind not in ('su', 'ua', 'au')) as illegal from coded group by conv_id),
      best as (select w.conv_id, w.cost + 2 * m.k as cost, w.audit || repeat('I', m.k) as audit, list_concat(w.written, m.added) as written
        from walk w join moves m on m.was = w.last left join counts c on c.conv_id is not distinct from w.conv_id
        where w.n = coalesce(c.n, 0) and m.last in ('', 'a')
        qualify row_number() over (partition by w.conv_id order by w.cost + 2 * m.k, w.audit || repeat('I', m.k)) = 1)
    select b.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
      coalesce(illegal, 0) as illegal, cast(b.cost as bigint) as cost, b.audit, sha256(coalesce(array_to_string(b.written, chr(10)), '')) as repaired_sha256
    from best b left join counts c on c.conv_id is not distinct from b.conv_id""",
    "op12_zone_negatives": """
    with v as (select row_number() over () as place, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x from embeddings
        where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
      s as (select a.place as a_place, a.vec_id as anchor_id, b.place, b.vec_id, a.label = b.label as same,
        cast(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) as bigint) as score
        from v a join v b on a.vec_id % 50 = 0 and a.place <> b.place and len(a.x) = len(b.x)),
      p as (select a_place, anchor_id, place as p_place, vec_id as positive_id, score as positive_score from s where same
        qualify row_number() over (partition by a_place order by score desc, vec_id nulls last, place) <= 5),
      n as (select p.*, s.vec_id as negative_id, s.score as negative_score, row_number() over (
          partition by p.a_place, p.p_place order by s.score desc, s.vec_id nulls last, s.place) as rank
        from p join s on s.a_place = p.a_place and not s.same and 50 * p.positive_score <= 100 * s.score
          and 100 * s.score <= 95 * p.positive_score)
    select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 3"""}
