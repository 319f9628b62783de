"""Language identification by mixture inference over several languages.

Each language is a distribution over hashed byte trigrams of the lower-cased letters of its
labelled texts. A document is taken as drawn from a mixture of them: expectation-maximisation finds
the proportions, and the set of languages grows one by one while a language's gain in
log-likelihood exceeds the penalty for its free proportion. The language with the largest
proportion is the prediction and its proportion the score.

Counts cover all labelled texts: each task sums its own into one row a language and trigram. The
model is a matrix of languages x ``GRAMS``, whose size does not depend on the number of documents.

Defined cases: a null text, or one without letters, is ``und`` with score 0; a text of letters
that no language knows gets the language of the largest prior likelihood, ties by name; without
labelled texts everything is ``und`` (as a filter, :func:`with_language` then keeps the texts with
letters); rows with a null ``lang`` are not learned from. Rows are
judged one by one, so ids may be null or repeated; other columns are kept as they are.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back

UNKNOWN = "und"
GRAMS = 1 << 15
MOST_LANGUAGES = 512        # the model is sent to every task: more labels than this are an error
SMOOTHING = 0.5
PENALTY = 4.0               # times log(n) / 2, as overlapping trigrams count a letter three times
ROUNDS, STILL = 40, 1e-4    # expectation-maximisation: most rounds; change at which it ends
NOT_LETTERS = re.compile(r"[\W\d_]+")


def trigrams(text: str | None) -> np.ndarray | None:
    """Codes of the byte trigrams, None without letters."""
    letters = NOT_LETTERS.sub(" ", text or "").strip().lower()
    if not any(map(str.isalpha, letters)):
        return None
    raw = np.frombuffer(f" {letters} ".encode(), dtype=np.uint8).astype(np.uint32)
    code = (raw[:-2] * np.uint32(0x9E3779B1)) ^ (raw[1:-1] * np.uint32(0x85EBCA77)) ^ (raw[2:] * np.uint32(0xC2B2AE3D))
    code *= np.uint32(0x27D4EB2F)
    return code >> np.uint32(32 - GRAMS.bit_length() + 1)


def _counts(batches):
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            if (codes := trigrams(text)) is not None:
                own = sums.setdefault(lang, np.zeros(GRAMS, dtype=np.int64))
                own += np.bincount(codes, minlength=GRAMS)
    for lang, own in sums.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "gram": at.astype(np.int32),
                                          "n": own[at]})


def _vector(pdf: pd.DataFrame) -> pd.DataFrame:
    own = np.zeros(GRAMS, dtype=np.float64)
    own[pdf["gram"].to_numpy()] = pdf["n"].to_numpy()
    return pd.DataFrame([{"lang": pdf["lang"].iloc[0], "total": int(own.sum()),
                          "counts": own.astype(np.float32).tobytes()}])


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + SMOOTHING
        self.p = (smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float64).copy() if langs else None

    def proportions(self, text: str | None) -> list[tuple[str, float]]:
        """Languages of the chosen set with their proportions, largest first."""
        codes = trigrams(text) if self.langs else None
        if codes is None:
            return []
        seen = np.bincount(codes, minlength=GRAMS)
        at = np.flatnonzero(seen)
        n, p = seen[at].astype(np.float64), self.p[at]
        total = n.sum()
        penalty = PENALTY * 0.5 * np.log(total + 1)
        likely = n @ np.log(p)
        chosen, share = [int(np.argmax(likely))], np.ones(1)
        best = likely[chosen[0]]
        while len(chosen) < len(self.langs):
            mixed = p[:, chosen] @ share
            ratio = p / mixed[:, None]
            slope = n @ ratio - total
            slope[chosen] = -np.inf
            new = int(np.argmax(slope))
            # no gain to be had, or by the curve at this point far too little
            if slope[new] <= 0 or slope[new] ** 2 / (n @ (ratio[:, new] - 1) ** 2) < penalty / 4:
                break
            tried, mix, ll = expect(p, n, chosen + [new], share)
            if ll - best <= penalty:
                break
            chosen, share, best = tried, mix, ll
        order = sorted(range(len(chosen)), key=lambda i: (-share[i], self.langs[chosen[i]]))
        return [(self.langs[chosen[i]], float(share[i])) for i in order]

    def gain(self, text: str | None) -> float:
        """Mean log-likelihood ratio of a trigram: the chosen mixture against the background.
        Negative infinity without letters; infinity when no language was learned."""
        codes = trigrams(text)
        if codes is None or not self.langs:
            return -np.inf if codes is None else np.inf
        mix = self.proportions(text)
        p = self.p[np.ix_(codes, [self.langs.index(lang) for lang, _ in mix])] @ np.array([share for _, share in mix])
        return float(np.log(p).mean() + np.log(GRAMS))


def expect(p, n, chosen, share):
    """Expectation-maximisation over the chosen languages from ``share`` and a tenth for the new one."""
    q, total = p[:, chosen], n.sum()
    mix = np.append(share * 0.9, 0.1)
    for _ in range(ROUNDS):
        part = q * mix
        new = (n / part.sum(axis=1)) @ part / total
        still = np.abs(new - mix).max() < STILL
        mix = new
        if still:
            break
    return chosen, mix, float(n @ np.log(q @ mix))


def fit(labelled: DataFrame) -> Model:
    """Learn from (text, lang); rows without either are skipped."""
    bounded_batches(labelled.sparkSession)
    counts = labelled.where("lang IS NOT NULL AND text IS NOT NULL") \
        .select(F.col("lang").cast("string").alias("lang"), "text") \
        .mapInArrow(_counts, "lang string, gram int, n long") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = counts.groupBy("lang").applyInPandas(_vector, "lang string, total long, counts binary") \
        .limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows = sorted(rows, key=lambda r: r["lang"])
    return Model([r["lang"] for r in rows],
                 np.array([np.frombuffer(r["counts"], dtype=np.float32) for r in rows], dtype=np.float64))


OUT = "struct<lang_pred: string, score: double, languages: array<struct<lang: string, share: double>>>"
OUT_TYPE = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()),
                      ("languages", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))])


def predictor(model: Model):
    """Column function of a text: lang_pred, score and the chosen set."""
    @F.arrow_udf(OUT)
    def predict(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts:
            found = model.proportions(text.as_py())
            lang, score = found[0] if found else (UNKNOWN, 0.0)
            out.append({"lang_pred": lang, "score": min(1.0, max(0.0, score)),
                        "languages": [{"lang": a, "share": b} for a, b in found]})
        return pa.array(out, type=OUT_TYPE)
    return predict


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that are never learned from; those without an id are learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score, languages."""
    predict = predictor(fit(docs.where(~held_out())))
    return docs.select("doc_id", held_out().alias("held_out"), predict(F.col("text")).alias("_p")) \
        .select("doc_id", "held_out", "_p.lang_pred", "_p.score", "_p.languages")


def accepted(model: Model):
    """Column function of a text: does the mixture of its chosen languages explain it better than
    the background, in which every trigram code is as likely as any other? Without letters no;
    where no language could be learned, letters are enough."""
    @F.arrow_udf("boolean")
    def judge(texts: pa.Array) -> pa.Array:
        out = pa.array([model.gain(t.as_py()) > 0 for t in texts], type=pa.bool_())
        give_back()
        return out
    return judge


def with_language(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, without the rows that no mixture of languages explains (null
    texts and texts without letters among them). Learns from all labelled rows."""
    judge = accepted(fit(docs))
    return docs.withColumn("_llm_p", judge(F.col("text"))).where("_llm_p").select(*docs.columns)
