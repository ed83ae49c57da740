"""The thirteen operators as registered queries, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import ann, conversations, katz, manifest, mixing, page_text, passages, pieces, simhash, toxicity, url_filter, va_file, wavelet
from tidemark.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op2_source_mixing", mixing.SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_url_filter", url_filter.SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the list entries active on its fetch day."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(url_filter.page_captures(pages), url_filter.page_lists(pages))


@query("op3_simhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of near duplicates of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op5_approximate_neighbours")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op7_exact_top_k", va_file.SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_file.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op9_piece_codec")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document."""
    model = pieces.read_model(pieces.model_path())
    return pieces.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), model, remembered=1_000_000)


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document; the model is fitted on the table's labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.graded(docs, docs, table(spark, sf_dir, "labels")).drop("text")


@query("op10_page_text")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op4_katz_scores")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents").select("doc_id", "text"), order=3, chunk=700_000)


@query("op6_repeated_passages")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document repeats from an earlier one."""
    return passages.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op11_turn_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of the repaired text of every conversation, after damage."""
    return conversations.repair(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), damage=True)


@query("op12_token_files")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as read back from the shard files."""
    return wavelet.stored(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op13_merkle_manifest")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether a partly altered copy still matches."""
    return manifest.audited(table(spark, sf_dir, "documents").select(*manifest.FIELDS))
