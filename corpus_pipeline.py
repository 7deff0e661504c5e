"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

Quality rules drop what they reject; of near copies one row with the smallest id stays; secrets are masked in the text;
sources are mixed to their targets by repeating or leaving out whole documents; what is left is packed.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafledger.llm.common import stored, table
from leafledger.llm.mixing import mix_cuts, mix_place
from leafledger.llm.ngram_join import join_ngrams
from leafledger.llm.plans import TOKENIZERS
from leafledger.llm.quality import fit_quality, judge_quality
from leafledger.llm.secret_scan import mask_secrets
from leafledger.llm.tier_packing import pack_documents
from leafledger.session import prepare

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PACK_CACHE = 150_000  # word pieces; the executors' heaps are full of earlier stages by then
PLACE_BITS = 32  # of a row number: more rows than a file can hold


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; fitted on the labelled ones among them."""
    prepare(spark)
    judged = judge_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")), keep=COLUMNS)
    return judged.filter("kept").selectExpr(*[f"_{c} AS {c}" for c in COLUMNS])


def _stored_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of a stored table, each with a number of its own in ``_row``: its file's number and its place in the file.

    Documents that are not simply the rows of files are written first.
    """
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        docs = stored(docs.select(COLUMNS), "rows")
    rows = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    files = rows.select("_file").distinct()
    files = stored(files.select("_file", F.row_number().over(Window.orderBy("_file")).cast("long").alias("_number")), "files")
    return rows.join(files, "_file").select(*COLUMNS, (F.shiftleft("_number", PLACE_BITS) + F.col("_place")).alias("_row"))


def without_rows(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` but for those whose ``_row`` is in ``gone``: a bit per row, so that up to some 80 million rows no text is shuffled."""
    marks = gone.groupBy(F.bitmap_bucket_number("_row").alias("_map")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_row")).alias("_bits"))
    marked = rows.join(stored(marks, "gone"), F.bitmap_bucket_number("_row") == F.col("_map"), "left")
    place = F.bitmap_bit_position("_row")
    octet = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.expr("shiftright(_octet, cast(_bit % 8 as int)) & 1") == 1
    kept = marked.withColumns({"_octet": octet, "_bit": place}).filter(~F.coalesce(hit, F.lit(False)))
    return kept.select(rows.columns)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one with the smallest id, or with none if none has one; rows are told apart by their place in the files."""
    prepare(spark)
    rows = _stored_rows(spark, docs)
    joined = join_ngrams(rows.select(F.col("_row").alias("doc_id"), "text")).filter("doc_id <> component_id")
    others = stored(joined.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_part")), "ngram-others")
    members = others.unionByName(others.select(F.col("_part").alias("_row"), "_part").distinct())
    named = members.join(rows.select("_row", "doc_id"), "_row")
    firsts = named.groupBy("_part").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_row"))
    return without_rows(rows, members.join(firsts, ["_row"], "left_anti").select("_row")).select(COLUMNS)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, secrets masked; ``n_chars`` is that of the new text."""
    prepare(spark)
    return mask_secrets(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one taken in part comes whole, and so do its equals in text size, quality and id.

    A source's mix is its epochs and the place in its order where the rest ends, so each row finds its copies where it is.
    """
    prepare(spark)
    cuts = stored(mix_cuts(docs), "cuts").select(F.col("source").alias("_source"), "epochs", "last")
    rows = docs.select(*COLUMNS, *mix_place("text", "doc_id"))
    rows = rows.join(cuts, rows["source"].eqNullSafe(cuts["_source"]))
    more = F.coalesce(F.struct("key", "id", "size") <= F.col("last"), F.lit(False)).cast("int")
    copies = F.when(F.col("size") > 0, F.col("epochs").cast("int") + more).otherwise(0)
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences over all documents of the mix."""
    return pack_documents(docs, f"{TOKENIZERS}/byte_bpe_50k.json", cache=PACK_CACHE)


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", keep_one_copy),
    ("secret scans", hide_secrets),
    ("mixing sources", mix_to_targets),
    ("packing", pack),
]

# The fitted quality model has no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order, each to what its predecessor wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
