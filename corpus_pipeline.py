"""The corpus pipeline: five stages over ``documents``, each one operator of ``placerank.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it as Parquet to
the shared folder and rereads it as the next stage's ``docs``. All stages but the last return the
columns of their input:

1. language identification drops documents that no mixture of the learned languages explains better
   than chance does (null texts and texts without letters among them);
2. exact deduplication keeps, of texts equal but for the case of A-Z, the row with the largest id;
3. near deduplication keeps one document (the smallest id) of each component of texts whose 5-word
   shingles have a Jaccard similarity of 0.8 or more;
4. mixing repeats or drops documents so that sources come near their target weights;
5. packing returns a row for each piece of a document, placed in a sequence.

An empty table passes all stages as an empty one; extra columns, whatever their names, are kept by
all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placerank.llm import exact_mph, fair_queue, language_mix, packing, setsketch
from placerank.llm.common import read_table, saved

#: Expectation-maximisation, sketches and a genetic algorithm have no SQL form.
ORACLE_SQL = None
#: Words of a shingle and least similarity of the stage; the query of operator 5 has its own.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80
#: Bounds of the encoder's memory: here it lives beside a heap that four stages have filled.
PACK_BYTES, PACK_REMEMBERED = 1 << 20, 200_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text a mixture of the languages of all labelled rows explains. A null or empty
    text, or one without letters, goes; where ``lang`` is null throughout, texts with letters stay.
    Repeated rows and ids are judged one by one."""
    return language_mix.with_language(docs)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, equal but for the case of A-Z: that with the largest id (a null id is the
    smallest; of equal rows any one). Null and empty texts are one text."""
    return exact_mph.keep_winners(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the smallest id of each component of near copies. A text without words is linked
    with nothing and stays; a null id has no component and stays."""
    return setsketch.keep_first(docs, NEAR_SHINGLE, NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated or dropped towards the sources' targets, by virtual finish time. A null source is
    a source, the last; a document without words stays once. An empty table gives no rows."""
    return fair_queue.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of at most 4,096 tokens, with its sequence and its place there. A null
    text has its end id only; repeated rows are documents of their own; other columns are dropped."""
    return packing.packed_documents(docs, most_bytes=PACK_BYTES, most_remembered=PACK_REMEMBERED)


STAGES = [("language ID", identify_language), ("exact dedup", drop_exact), ("near dedup", drop_near),
          ("mixing", mix_sources), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
