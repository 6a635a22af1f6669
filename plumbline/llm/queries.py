"""The queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.alignment import alignment_report
from plumbline.llm.common import shared_folder, table
from plumbline.llm.conversations import damaged, repair_report
from plumbline.llm.embed_dedup import embedding_near_dedup
from plumbline.llm.langid import held_out, identify, train_profiles
from plumbline.llm.line_dedup import line_dedup
from plumbline.llm.mixing import mix
from plumbline.llm.pieces import encode_texts, load_pieces
from plumbline.llm.pii import BASE, find_pii, span_list
from plumbline.llm.secrets import find_secrets
from plumbline.llm.simhash import simhash_components
from plumbline.llm.topk_product import top_products
from plumbline.llm.urls import judge_urls
from plumbline.llm.warc import index_archives, read_records, row_id, write_archives
from plumbline.session import cut_lineage, delete_folder

#: The public piece model; a parameter wherever it is used.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: The public byte-level vocabulary; a parameter wherever it is used.
BYTES = "/opt/tokenizers/byte_bpe_50k.json"


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(table(spark, sf_dir, "embeddings"))


def op3_nbest_pieces(spark: SparkSession, sf_dir: str, model: str = PIECES) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), load_pieces(model), ["doc_id"], n=3)


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP4_SQL = """
with ok as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
  from ok q join ok c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from scored
qualify rank <= 5
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = r"""
with lines as (
  select doc_id, i as pos, coalesce(string_split(coalesce(text, ''), chr(10))[i], '') as line
  from (select doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as i from documents)
), keyed as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), held as (
  select key, max(doc_id) as last from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3
), marked as (
  select k.doc_id, k.pos, k.line, h.key is not null and h.last <> k.doc_id as gone
  from keyed k left join held h on k.key = h.key
)
select doc_id, count(*) as n_lines, coalesce(sum(gone::int), 0)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"), words=3)
    return found.select("doc_id", "fingerprint", "component_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _spans(found, "pii", BASE)


def _spans(found: DataFrame, column: str, base: tuple[str, ...]) -> DataFrame:
    kept = F.filter(column, lambda x: x["kind"].isin(*base))
    counts = [F.size(F.filter(column, _of_kind(k))).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(span_list(kept), 256).alias("base_sha256"), span_list(F.col(column)).alias("spans"))


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(find_secrets(table(spark, sf_dir, "documents"), ["doc_id"]), "secrets", ("assign", "access", "hex"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = train_profiles(docs, ~held_out(F.col("doc_id")))
    return identify(docs, profiles, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = table(spark, sf_dir, "pages"), shared_folder(spark, "warc")
    write_archives(pages, f"{folder}/records")
    index_archives(spark, f"{folder}/records").write.parquet(f"{folder}/index")
    found = read_records(spark.read.parquet(f"{folder}/index"), payloads=False)
    kind = pages.schema["page_id"].dataType.simpleString()
    page_id, refers_to = row_id(F.col("record_id"), kind).alias("page_id"), row_id(F.col("refers_to"), kind).alias("refers_to")
    out = cut_lineage(found.select(page_id, "payload_bytes", "payload_digest", "record_type", refers_to))
    delete_folder(spark, folder)
    return out


OP11_SQL = """
with ranked as (
  select page_id, html, row_number() over (partition by html order by page_id desc nulls last, url desc nulls last) as n,
         first_value(page_id) over (partition by html order by page_id desc nulls last, url desc nulls last) as head
  from (select page_id, url, coalesce(html, '') as html from pages)
), hashed as (select *, sha1(html) as h from ranked)
select page_id, strlen(html)::bigint as payload_bytes,
       translate(list_aggregate(list_transform(range(8), lambda i: to_base(('0x' || substring(h, (5 * i + 1)::int, 5))::bigint, 32, 4)), 'string_agg', ''),
                 '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') as payload_digest,
       case when n = 1 then 'response' else 'revisit' end as record_type, case when n > 1 then head end as refers_to
from hashed
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(table(spark, sf_dir, "conversations")), gone=F.col("gone"))


def op13_token_alignment(spark: SparkSession, sf_dir: str, tokenizer: str = BYTES, model: str = PIECES) -> DataFrame:
    return alignment_report(table(spark, sf_dir, "documents"), tokenizer, model)


QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_nbest_pieces": op3_nbest_pieces,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_simhash": op5_simhash,
    "op6_pii": op6_pii,
    "op7_secrets": op7_secrets,
    "op8_url_filter": op8_url_filter,
    "op9_language_id": op9_language_id,
    "op10_source_mix": op10_source_mix,
    "op11_warc": op11_warc,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_token_alignment": op13_token_alignment,
}
ORACLES = {"op2_line_dedup": OP2_SQL, "op4_exact_top_k": OP4_SQL, "op11_warc": OP11_SQL}
