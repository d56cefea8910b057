"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, packing. Counted as part of voxmap.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents. Each first lets the executors return the heap that the stage before it has left. Stages 1 and 5
have no SQL equivalent, so ORACLE_SQL is None; tests hold every stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmap.llm import op2_decontaminate, op3_lines, op6_packing, op7_minhash, op9_quality
from voxmap.llm._util import cut, give_back, table
from voxmap.llm.op8_language import remainder
from voxmap.llm.op10_tokenfile import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more; it learns from labels with a remainder other than 0 mod 5.

    Null and empty texts are scored like others (the zero vector), repeated rows each get the same score, null ids are
    never labelled, and an empty table stays empty. Columns other than those of documents are left out.
    """
    give_back(spark)
    docs = docs.select(*COLUMNS)
    model = op9_quality.fit(docs, table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0))
    return op9_quality.score(docs, model, keep_text=True).where("score >= 0.3").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of runs of lines of 50 words or more; a document of nothing else goes.

    Null, empty and blank texts stay as they are; rows that repeat a (doc_id, text) count once and get the same text;
    a null doc_id comes after all others; n_chars follows a text that was cut.
    """
    give_back(spark)
    d = op3_lines.dedup_lines(docs.select(*COLUMNS))
    left = F.when(F.col("_removed").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return d.where("_removed is null or length(trim(translate(text, '\\n', ' '))) > 0").withColumn("n_chars", left).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (5-word shingles, Jaccard 0.8): the smallest doc_id, then text hash.

    Rows that repeat a (doc_id, text) are one document (the smallest of their other columns stays). Rows of one doc_id
    and different texts are several documents, and a row with a null doc_id is one like others. Null and blank texts are
    near nothing. Only texts that go, or stand twice, are shuffled.
    """
    give_back(spark)
    docs, key = docs.select(*COLUMNS), op3_lines.KEY
    found = cut(op7_minhash.groups(docs, 5, 80).select(*key, "first"), "groups")
    goes = cut(found.where("not first").select(*key).distinct(), "copies")
    again = found.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key)
    rest, some, own = op3_lines.split(docs, cut(goes.union(again), "looked-at"))
    some = op3_lines.without(some, goes).groupBy(*own).agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return rest.union(some)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and wordless texts hold none; rows that repeat a (doc_id, text) go or stay together, whatever their doc_id.
    """
    give_back(spark)
    return op2_decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents packed into sequences of at most 4096 tokens.

    A null or empty text is its end id alone; repeated rows and rows with a null doc_id are packed each; an empty table
    gives no piece.
    """
    give_back(spark)
    return op6_packing.pack(cut(op6_packing.cut_and_encode(docs, tokenizer_path("word_bpe_49k.json"), added=True), "pieces"))


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("decontaminate", decontaminate), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
