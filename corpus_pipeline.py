"""The corpus pipeline: toxicity, exact dedup, near-dedup, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last return the columns of
documents; between two stages the documents are written as Parquet and read again.

Decisions hold for rows, not for ids: null and repeated doc_ids are documents of their own.  Where an
operator tells rows by an id it gets a row key that rises with doc_id (nulls first), so "smallest" and
"largest" are as by doc_id, and rows of one id follow each other in some order.  A null text is scored, compared and
packed as an empty one and stays null; empty tables give empty tables; further columns, whatever their names, pass through.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from loomwork.llm.common import materialize, release, ship, spread, table
from loomwork.llm.exact_dedup import deduplicate
from loomwork.llm.near_dedup import near_classes
from loomwork.llm.packing import pack_documents
from loomwork.llm.suffix_dedup import left_of, repeated_spans
from loomwork.llm.toxicity import fit, loaded

def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs hasn't."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a unique row key that rises with doc_id, nulls first, and the key's name.

    That is doc_id itself where it is a long, never null and never repeated, which a count by id tells.
    Otherwise rows are dealt out by id and place and numbered, so that the many rows of one id (or of null) spread.
    """
    again = docs.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if docs.schema["doc_id"].dataType == LongType() and again.isEmpty():
        return docs, "doc_id"
    key = _free(docs, "_row")
    doc_id = F.col("doc_id").cast("long")
    dealt = docs.withColumn(key, F.monotonically_increasing_id()).repartitionByRange(doc_id, F.col(key)).sortWithinPartitions(doc_id, F.col(key))
    return materialize(dealt.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def _clean(model: bytes, at: int):
    """Passes on the rows that are not predicted as toxic; at: the column of the text."""

    def run(batches):
        own = loaded(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield part.filter(pa.array([s < 0.5 for s in own.scores([t or "" for t in part.column(at).to_pylist()])]))

    return run


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the model predicts as toxic."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    ship(spark)
    return spread(docs).mapInArrow(_clean(model, docs.columns.index("text")), docs.schema)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest doc_id of each group of equal texts."""
    return deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of near-duplicates (five-word shingles, similarity 0.8)."""
    keyed, key = _keyed(docs)
    dropped = materialize(near_classes(keyed, 5, 4, 5, key).where("not kept").select(F.col("doc_id").alias(key)), "dropped")
    return keyed.join(dropped, key, "left_anti").select(*docs.columns)


def _without(columns: list[str]):
    """Rows whose last column holds spans of bytes, to rows of the other columns with these bytes cut out of the text."""
    text, n_chars = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def run(batches):
        release()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = part.columns[:-1]
                texts, spans = part.column(text).to_pylist(), part.column(part.num_columns - 1).to_pylist()
                cut = [k for k, x in enumerate(spans) if x is not None and texts[k] is not None]
                for k in cut:
                    texts[k] = left_of(texts[k].encode(), spans[k]).decode("utf-8", "ignore")
                if cut:
                    out[text] = pa.array(texts, out[text].type)
                if cut and n_chars is not None:
                    sizes = out[n_chars].to_pylist()
                    for k in cut:
                        sizes[k] = len(texts[k])
                    out[n_chars] = pa.array(sizes, out[n_chars].type)
                yield pa.RecordBatch.from_arrays(out, names=columns)

    return run


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages of 100 bytes and more that an earlier document holds; every document stays, with what is left of it.

    A character that is cut in part goes.
    """
    keyed, key = _keyed(docs)
    name = _free(docs, "_spans")
    spans = repeated_spans(keyed, 100, key).select(F.col("doc_id").alias(key), F.col("spans").alias(name))
    joined = keyed.join(spans, key, "left").select(*docs.columns, name)
    ship(spark)
    return joined.mapInArrow(_without(docs.columns), docs.schema)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 4096 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 4096)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("suffix_dedup", repeats), ("packing", packing)]

#: The stages are a trained model, connected components, byte passages and a packing plan: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
