"""Quality rules over lines that many documents of a host share.

Lines are normalised (ASCII lower case, every run of digits one ``0``, words joined by one space)
and hashed; for each host (here the ``source``) the number of distinct documents that hold a line
is counted. Lines of more than ``limit`` documents of their host are removed, and a document is
rejected when the removed lines held too large a share of its words.

The limit is a number of documents, so that a line judged frequent stays so when its host grows. A
line common in all hosts counts in each of them.

Defined cases: a null text has no words or lines and fails the base rules; lines without words are
not counted; rows are told apart by ``doc_id`` and text, rows that agree in both count as one
document for a line and both get a result; a null source is a host of its own; an empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

LEAST_WORDS, MOST_REPEAT_PERCENT = 50, 50
LIMIT = 20                                # documents of a host that may share a line
DEPLETED = 0.5                            # share of words that removed lines may hold
SYMBOLS = b"#*$%&|<>"

DIGITS = re.compile(rb"[0-9]+")
FACTS = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("row_key", pa.int64()),
                   ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
                   ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
                   ("lines", pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())])))])
FACTS_DDL = ("doc_id long, source string, row_key long, n_words long, word_chars long, n_symbols long, "
             "n_dup_lines long, n_repeat_words long, lines array<struct<line: long, words: long>>")


def repeat_words(words: list[bytes]) -> int:
    """Words covered by 3-word windows that the text holds twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    v = len(number)
    if v < 2_000_000:
        codes = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:  # codes would not fit 63 bits: number the pairs first
        pairs = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1].astype(np.int64)
        codes = pairs[:-1] * v + ids[2:]
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def line_hash(words: list[bytes]) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(DIGITS.sub(b"0", b" ".join(words).lower())) - 2 ** 63


def text_facts(text: str | None) -> tuple:
    raw = (text or "").encode()
    words = raw.split()
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    # a word's characters: bytes that do not continue a code point
    chars = len(text or "") - (len(raw) - sum(map(len, words)))
    seen: set[bytes] = set()
    dup, lines = 0, {}
    for line in raw.split(b"\n"):
        ws = line.split()
        if not ws:
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        h = line_hash(ws)
        lines[h] = lines.get(h, 0) + len(ws)
    return len(words), chars, n_symbols, dup, repeat_words(words), [{"line": k, "words": v} for k, v in lines.items()]


def _facts(batches):
    for b in batches:
        found = [text_facts(t) for t in b.column("text").to_pylist()]
        cols = [pa.array(list(c), type=f.type) for c, f in zip(zip(*found), list(FACTS)[3:])] if found else \
            [pa.array([], type=f.type) for f in list(FACTS)[3:]]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("row_key"), *cols],
                                         schema=FACTS)


def document_facts(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.xxhash64("doc_id", "text").alias("row_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_facts, FACTS_DDL)


def frequent_lines(lines: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(source, line) of more than ``limit`` documents of the host. Rows of ``lines`` are distinct
    per document, so the partial sums of a hot line meet as one row a task."""
    return lines.groupBy("source", "line").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > limit)


def _lines(facts: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Distinct rows of ``facts`` and the stored frequent lines (_s, _l) of the hosts."""
    single = saved(facts.select("source", "doc_id", "row_key", "lines").dropDuplicates(["doc_id", "row_key"]), "lines")
    lines = single.select("source", F.explode("lines.line").alias("line"))
    return single, saved(frequent_lines(lines, limit), "frequent-lines") \
        .select(F.col("source").alias("_s"), F.col("line").alias("_l"))


def quality(docs: DataFrame, limit=LIMIT, depleted=DEPLETED) -> DataFrame:
    """One row a document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, removed_words (words in frequent lines), kept."""
    facts = saved(document_facts(docs), "line-facts")
    single, hot = _lines(facts, limit)
    # only lines leave the document: a frequent line meets its few words, not the text
    one = single.select("doc_id", "source", "row_key", F.explode("lines").alias("x")) \
        .join(hot, F.col("source").eqNullSafe(F.col("_s")) & (F.col("x.line") == F.col("_l"))) \
        .groupBy(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).agg(F.sum("x.words").alias("removed"))
    out = facts.drop("lines").join(one, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key")),
                                   "left")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    removed = F.coalesce(F.col("removed"), F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), removed.alias("removed_words"),
                      (~failed & (removed <= depleted * F.col("n_words"))).alias("kept"))


def _cut(texts: pa.Array, gone: pa.Array) -> pa.Array:
    out = []
    for text, hashes in zip(texts.to_pylist(), gone.to_pylist()):
        if hashes:
            hashes = set(hashes)
            text = "\n".join(x for x in text.split("\n") if not (w := x.encode().split()) or line_hash(w) not in hashes)
        out.append(text)
    return pa.array(out, pa.string())


def without_frequent(docs: DataFrame, limit=LIMIT) -> DataFrame:
    """``docs`` with all its columns and rows, its texts without the frequent lines of their host.
    Only the hashes of a document's own frequent lines travel to its text; a null text stays null,
    lines without words stay."""
    facts = saved(document_facts(docs), "line-facts")
    single, hot = _lines(facts, limit)
    gone = single.select("doc_id", "source", "row_key", F.explode("lines.line").alias("line")) \
        .join(hot, F.col("source").eqNullSafe(F.col("_s")) & (F.col("line") == F.col("_l"))) \
        .groupBy(F.col("doc_id").alias("_llm_id"), F.col("row_key").alias("_llm_key")) \
        .agg(F.collect_list("line").alias("_llm_gone"))  # of one document, at most its own lines
    keyed = docs.withColumn("_llm_row", F.xxhash64("doc_id", "text"))
    return keyed.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("_llm_id"))
                      & (F.col("_llm_row") == F.col("_llm_key")), "left") \
        .withColumn("text", F.arrow_udf(_cut, "string")(F.col("text"), F.col("_llm_gone"))).select(*docs.columns)
