"""One query for each operator, over the whole of its table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, epsgrid, exact, htmltext, katz, minhash, packing, quality, toxicity, urls, whiten
from .urls import Rule

URL_RULES = [Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"), Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block")]
#: Where no rule fits: hosts with a label that begins like those of link farms.
URL_BLOCK = [f"{start}{name}-**" for name in ("spam", "casino", "cheap", "free", "ads") for start in ("", "*.")]
CAPACITIES = [512, 1024, 2048, 4096, 8192]
CONTROL = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document, as digests."""
    import public_tokenizers

    return bpe.encode_table(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays for every document, and its group."""
    out = exact.exact_duplicates(_table(spark, sf_dir, "documents"), all_digests=True)
    return out.withColumnRenamed("digest", "text_sha256")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a fifth of the ids is held out."""
    return toxicity.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; a third of the ids is held out."""
    return quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for the URL of every page."""
    return urls.judge(_table(spark, sf_dir, "pages"), URL_RULES, URL_BLOCK)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place for every document in bins of 512 to 8192 words."""
    return packing.packed(packing.words(_table(spark, sf_dir, "documents").select("doc_id", "text")), "n_words", CAPACITIES)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation under the template, read back from it. The rows come as records of several layouts; each record's fingerprint picks its own."""
    more = spark.sql(f"select -7L conv_id, turn, role, '{CONTROL}' text from values (0L, 'user'), (1L, 'assistant') t(turn, role)")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = chat.read_back(chat.formatted(chat.canonical_records(chat.mixed(chat.conversations(rows)), "conv_id", "record")))
    told = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return out.select(
        "conv_id", F.size("read_turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document; a seventh of the ids is held out."""
    return katz.scores(_table(spark, sf_dir, "documents"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.9."""
    return epsgrid.linked(_table(spark, sf_dir, "embeddings"), 0.9)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of both tokenizers' tokens in every document, and the corpus-wide counts of their id pairs."""
    import public_tokenizers

    return align.alignment(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the first components of their whole numbers, whitened."""
    return whiten.whitened(_table(spark, sf_dir, "embeddings"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return htmltext.extracted(_table(spark, sf_dir, "pages"))
