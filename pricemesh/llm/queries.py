"""The registered queries of this folder and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricemesh.llm import alignment, conversations, curriculum, fmindex, jaccard, langid, neardup_vectors, pieces, planes, shards, toxicity, urlfilter, warc
from pricemesh.llm.common import table

SHARDS = 24
RULES = [
    urlfilter.Rule("net", "/", "block"),
    urlfilter.Rule("example.net", "/en/", "allow"),
    urlfilter.Rule("example.com", "/de/", "block"),
    urlfilter.Rule("org", "/fr/", "allow"),
]
TOXICITY = toxicity.ToxicityConfig()
LANGUAGE = langid.LanguageConfig()


def fold(modulus: int) -> F.Column:
    """crc32 of the decimal doc_id, modulo a number of folds."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's url by the sorted digest array."""
    return urlfilter.judge_urls(table(spark, folder, "pages", "page_id", "url"), "page_id", "url", RULES)


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows found in every document by FM-indexes."""
    found = fmindex.find_contamination(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", table(spark, folder, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.size("spans").alias("n_spans"),
    )


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 contiguous shards of near equal bytes; equal texts stay together."""
    text = F.coalesce(F.col("text"), F.lit(""))
    layout = shards.minimax_shards(
        table(spark, folder, "documents", "doc_id", "text"), "doc_id",
        group=F.unhex(F.sha2(text.cast("binary"), 256)),
        size=F.octet_length(text) + 8,
        shards=SHARDS,
        keep={"text_crc32": F.crc32(text.cast("binary"))},
    )
    return layout.rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def language_model(spark: SparkSession, folder: str) -> langid.LanguageModel:
    labelled = table(spark, folder, "documents", "doc_id", "text", "lang").filter(fold(3) != 1)
    return langid.train(labelled, "text", "lang", LANGUAGE)


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document; learned from two of three folds."""
    found = langid.identify(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", language_model(spark, folder))
    return found.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written to seekable archives and read back."""
    index = warc.write_archives(table(spark, folder, "pages", "page_id", "url", "html"), "page_id", "url", "html")
    return warc.read_archives(index, payloads=False).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


def op6_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded with spans, then decoded."""
    done = pieces.encode_pieces(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model"))
    return done.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.element_at("ends", -1) - F.element_at("begins", 1)).cast("long").alias("covered_bytes"),
    )


def op7_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents that share four fifths of their five-word shingles."""
    return jaccard.jaccard_groups(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids in bit-plane files, read back."""
    encode = planes.library_encoder(public_tokenizers.path("word_bpe_49k.json"))
    index = planes.write_planes(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", encode, end_id=1)
    return planes.read_planes(index, ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Links and groups of near-equal vectors."""
    return neardup_vectors.near_vectors(table(spark, folder, "embeddings", "vec_id", "embedding"), "vec_id", "embedding")


def toxicity_model(spark: SparkSession, folder: str) -> toxicity.ToxicityModel:
    """Learned from three of four folds of the labelled documents."""
    labels = table(spark, folder, "labels", "doc_id", "toxic").filter(fold(4) != 2)
    return toxicity.train(table(spark, folder, "documents", "doc_id", "text"), labels, "doc_id", "text", "toxic", TOXICITY)


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document; all score 0 where the labels teach nothing."""
    model = toxicity_model(spark, folder)
    found = toxicity.score_toxicity(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", model)
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "score", F.when(F.col("score") >= TOXICITY.threshold, 1).otherwise(0).alias("predicted"))


def op11_curriculum(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed to three halves of their words, in training order."""
    mixed = curriculum.mix(table(spark, folder, "documents", "doc_id", "text", "source"), "doc_id", "source", "text")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")


def op12_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations damaged by a fixed rule, then repaired at the least cost."""
    rows = conversations.damage(table(spark, folder, "conversations", "conv_id", "turn", "role", "text"), "conv_id", "turn", "role", "text")
    repairs = conversations.summarise(rows)
    digests = conversations.transcripts(rows, repairs).withColumnRenamed("conv_id", "conv")
    both = repairs.join(digests, F.col("conv_id").eqNullSafe(F.col("conv")))
    return both.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of two tokenizers aligned in every document."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    return alignment.align_tokens(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), groups=False).drop("groups")


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_url_filter, op2_decontamination, op3_sharding, op4_language, op5_warc, op6_sentencepiece, op7_jaccard, op8_token_files, op9_vectors, op10_toxicity, op11_curriculum, op12_conversations, op13_alignment)
    }


URL_SQL = """
with cut as (
    select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), parts as (
    select page_id,
        translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1, 's') as path
    from cut
), rules(rule_host, rule_path, verdict) as (
    values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits as (
    select page_id, host, path, rule_host || rule_path as rule, verdict,
        row_number() over (partition by page_id order by length(rule_host || rule_path) desc, length(rule_host) desc) as place
    from parts left join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from fits where place = 1
"""

WARC_SQL = """
with rows as (
    select page_id, encode(coalesce(html, '')) as payload from pages
), known as (
    select page_id, octet_length(payload) as payload_bytes, sha1(payload) as payload_digest from rows
), firsts as (
    select *, max(page_id) over (partition by payload_digest) as first from known
)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
    case when payload_bytes >= 1000 and first <> page_id then 'revisit' else 'response' end as record_type,
    case when payload_bytes >= 1000 and first <> page_id then first end as refers_to
from firsts
"""

MIX_SQL = r"""
with rows as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents
), sources as (
    select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place from rows group by source
), knots as (
    select *, [3.0, 1.0, 2.0][place % 3 + 1]::double as weight, 2 * source_size as most,
        [[0.0, 1.0], [0.0, 1.0], [0.0, 0.5, 1.0]][place % 3 + 1]::double[] as ats,
        [[1.5, 4.5], [1.0, 1.0], [3.0, 2.0, 1.0]][place % 3 + 1]::double[] as weights,
        [[0.0, 3.0], [0.0, 1.0], [0.0, 1.25, 2.0]][place % 3 + 1]::double[] as areas
    from sources
), filling as (  -- sources fill up in the order of most / weight
    select *, coalesce(sum(most) over before, 0) as held, sum(weight) over (order by most / weight, place rows between current row and unbounded following) as left_weights
    from knots window before as (order by most / weight, place rows between unbounded preceding and 1 preceding)
), levels as (
    select *, (1.5 * (select sum(size) from rows) - held)::double / left_weights as level, row_number() over (order by most / weight, place) as turn from filling
), level as (
    select arg_min(level, turn) as level from levels where weight * level <= most
), targets as (
    select *, case when weight * (select level from level) > most then most::double else weight * (select level from level) end as target from levels
), ordered as (
    select rows.*, source_size, target, ats, weights, areas, least(round(target)::bigint, most) as goal,
        sum(size) over (partition by rows.source order by md5(concat_ws(':', doc_id, size)), doc_id, size rows between unbounded preceding and current row) - size as first
    from rows join targets on rows.source is not distinct from targets.source
), taken as (
    select *, greatest(least(size, goal - first), 0) as once, greatest(least(size, goal - source_size - first), 0) as twice from ordered
), begun as (
    select *, case when once > 0 then (first::double / goal) * areas[len(areas)] when twice > 0 then ((first + source_size)::double / goal) * areas[len(areas)] end as area from taken
), pieces as (
    select *, least(greatest(len(list_filter(areas, lambda a: a <= area)), 1), len(ats) - 1) as k from begun
), slopes as (
    select *, (weights[k + 1] - weights[k]) / (ats[k + 1] - ats[k]) as slope, area - areas[k] as rest from pieces
)
select doc_id, size::bigint as size, source_size, target, (once + twice)::bigint as taken,
    ats[k] + case when rest > 0 then 2 * rest / (weights[k] + sqrt(greatest(weights[k] * weights[k] + 2 * slope * rest, 0.0))) when area is not null then 0.0 end as position
from slopes
"""


def oracle() -> dict[str, str]:
    return {"op1_url_filter": URL_SQL, "op5_warc": WARC_SQL, "op11_curriculum": MIX_SQL}
