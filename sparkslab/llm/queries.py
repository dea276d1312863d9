"""The queries of this subpackage's operators, by the driver's contract, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkslab.llm import lines, mixing, reassembly, repair, secret_scan, warc
from sparkslab.llm.decontaminate import contaminated
from sparkslab.llm.html import extract
from sparkslab.llm.jaccard import near_duplicate_classes
from sparkslab.llm.langid import identify
from sparkslab.llm.media import media
from sparkslab.llm.tokens import token_output
from sparkslab.llm.toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple-8b shards of all documents, read back."""
    return token_output(table(spark, sf_dir, "documents"), tokenizer_file())


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by hyperdimensional profiles."""
    return identify(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, by a factorization machine."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by minimum cuts."""
    return extract(table(spark, sf_dir, "pages"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents, by a MinHash LSH forest."""
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's benchmark items, by SimHash windows."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand on many sites."""
    return lines.remove_boilerplate(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of every document in a temperature mixture of the sources, with its pass and place."""
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not-modified revisits of every page, resolved."""
    return warc.revisits(table(spark, sf_dir, "pages"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's payload, stored as content-defined chunks and read back."""
    return media(table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets, by patterns and by novelty to a primed compressor."""
    return secret_scan.reports(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every damaged conversation, by cost layers."""
    return repair.reports(repair.repair(repair.damaged(table(spark, sf_dir, "conversations"))))


def op13_turn_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases, rejections and closings of all conversations' turns, by a stateful stream."""
    return reassembly.digests(reassembly.reassembled(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_language_id": op2_language_id,
    "op3_line_dedup": op3_line_dedup,
    "op4_source_mixing": op4_source_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_html_extraction": op6_html_extraction,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_media_columns": op8_media_columns,
    "op9_warc_revisits": op9_warc_revisits,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_secret_scan": op11_secret_scan,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_turn_reassembly": op13_turn_reassembly,
}

ORACLE_SQL: dict[str, str] = {"op3_line_dedup": lines.oracle_sql(), "op9_warc_revisits": warc.ORACLE_SQL}
