"""One query for each operator, over the whole table that it is meant for."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (exact_mph, fair_queue, interpolated, language_mix, lexical, line_frequency, oracles, packing, paragraphs,
               periodic, secrets, separator_scan, setsketch, token_files)
from .common import read_table

QUERIES: dict = {}
END_OF_TEXT = 50256  # fixed value: <|endoftext|> of byte_bpe_50k


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_paragraph_minhash(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return paragraphs.repeats(docs)


@query
def op2_line_frequency(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return line_frequency.quality(docs)


@query
def op3_digest_index(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return exact_mph.dedup_table(docs).drop("historical")


@query
def op4_separator_scan(spark, sf_dir):
    """Documents are written as flat files without an index and counted from these alone; the
    ids of a part's documents, which the writer keeps apart, name the rows."""
    docs = read_table(spark, sf_dir, "documents")
    parts = token_files.write_tokens(docs, "byte_bpe_50k.json", END_OF_TEXT, END_OF_TEXT + 1, in_order=False,
                                     whole_specials=True)
    files = parts.select(F.concat("path", F.lit(".bin")).alias("path"), "width", "n_ids")
    counts = separator_scan.token_counts(files, END_OF_TEXT)
    names = token_files.document_names(parts).withColumn("path", F.concat("path", F.lit(".bin")))
    # the estimate of what Python yields is far too small: never broadcast it
    return counts.join(names.hint("merge"), ["path", "ordinal"]).select("doc_id", "n_tokens", "finished")


@query
def op5_setsketch(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return setsketch.near_duplicates(docs, 3, 85)


@query
def op6_token_files(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return token_files.read_documents(token_files.write_tokens(docs, "byte_bpe_50k.json", 2, END_OF_TEXT + 1))


@query
def op7_language_mixture(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return language_mix.identify(docs)


@query
def op8_grouping_genetic(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return packing.packed_documents(docs)


@query
def op9_fair_queue(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return fair_queue.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_markov_secrets(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return secrets.secrets(docs)


@query
def op11_deleted_interpolation(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return interpolated.score(docs)


@query
def op12_seed_extend_runs(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return periodic.digest(periodic.runs(docs, periodic.planted))


@query
def op13_bag_search(spark, sf_dir):
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return lexical.search(docs, items)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.SQL.items() if k in QUERIES}
