"""Review-text operators (TX4–TX24).

Per-document work is done with array expressions inside one row (split,
filter, transform) so a long text is never copied into many rows; only small
per-hit or per-token results are exploded and aggregated (with map-side
partial aggregation, so frequent tokens do not skew the shuffle).

Stem hits follow ``re.finditer`` for a literal: non-overlapping, left to
right. All stems of a lexicon are found in one walk (``functions.stems``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stems import any_stem, stem_hits
from ..functions.text import normalise_informal, regex_escape
from ..session import cut_lineage
from .joins import BROADCAST_LIMIT, fits_broadcast, heavy_join

WS_CLASS = "[ \t\n\r\f]"
# Negation markers searched around a positive stem (TX9).
NEGATORS = ["안", "못", "별로", "전혀", "않", "아니"]
# Suffixes that disqualify a token as a noun, in the heuristic tokeniser (TX14).
NOUN_DROP_SUFFIXES = ["하다", "스럽", "답", "같", "되", "싶", "않", "있", "없", "다"]
# Sentiment labels of the rule scorer (TX10).
POSITIVE, NEGATIVE, NEUTRAL = "긍정", "부정", "중립"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _cols(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, (str, Column)) else list(x)


def pin(df: DataFrame, **exprs: Column) -> DataFrame:
    """Add columns that later lambdas read many times.

    Catalyst's CollapseProject would inline a plain ``withColumn`` expression into
    a lambda body, where it runs once per array element. Emitting the values from a
    generator (``inline`` of a one-element array) makes them attributes that cannot
    be inlined, so each is computed once per row.
    """
    packed = F.array(F.struct(*[e.alias(n) for n, e in exprs.items()]))
    return df.select("*", F.inline(packed))


# ------------------------------------------------------------------ sentences (TX4/5)

def sentence_array(c) -> Column:
    """TX4 as an array: tabs/CR → space, a space after each ``.!?``, split on line
    breaks or on whitespace that follows ``.!?``; trimmed, blanks removed."""
    t = F.regexp_replace(_c(c).cast("string"), "[\r\t]+", " ")
    t = F.regexp_replace(t, "([.!?])", "$1 ")
    t = F.regexp_replace(t, "([.!?])" + WS_CLASS + "+", "$1\n")
    parts = F.split(t, "\n+")
    trimmed = F.transform(parts, lambda x: F.regexp_replace(x, f"^{WS_CLASS}+|{WS_CLASS}+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def sentences(df: DataFrame, c: str, keep=None, min_len: int = 0, out: str = "sentence",
              pos: str = "sent_pos") -> DataFrame:
    """TX4/TX5: one row per sentence with its 0-based position among the non-blank
    sentences of the document; ``min_len`` keeps sentences of at least that length."""
    arr = sentence_array(F.col(c))
    if min_len:
        arr = F.filter(arr, lambda x: F.length(x) >= min_len)
    return df.select(*_cols(keep), F.posexplode(arr).alias(pos, out))


def entity_passages(df: DataFrame, c: str, entities: list[str], keep=None, k: int = 1,
                    query: str | None = None, out: str = "relevant_text") -> DataFrame:
    """TX6: for every (document, entity) where the entity occurs in the text (or in the
    query column), the sentences containing it plus ``k`` neighbours on each side,
    in order, joined by a space. Documents without a hit sentence give nothing.

    The entity list is a literal array; matching is a per-row filter, no join.
    """
    ents = F.array(*[F.lit(e) for e in entities])
    text = F.col(c).cast("string")
    src = F.coalesce(text, F.lit(""))
    if query:
        src = F.concat_ws(" ", F.coalesce(F.col(query), F.lit("")), src)
    base = df.select(*_cols(keep), text.alias("_t"),
                     F.explode(F.filter(ents, lambda e: F.instr(src, e) > 0)).alias("entity"))
    # per-row arrays are pinned: a Column used inside a lambda is re-evaluated per call
    base = pin(base, _s=sentence_array(F.col("_t"))).drop("_t")
    base = pin(base, _h=F.transform("_s", lambda x: F.instr(x, F.col("entity")) > 0))
    n = F.size("_s")

    def near_hit(i):
        window = F.sequence(F.greatest(i - k, F.lit(0)), F.least(i + k, n - 1))
        return F.exists(window, lambda j: F.element_at(F.col("_h"), j + 1))

    idx = F.filter(F.sequence(F.lit(0), n - 1), near_hit)
    passage = F.array_join(F.transform(idx, lambda i: F.element_at(F.col("_s"), i + 1)), " ")
    res = base.withColumn(out, F.when(n > 0, passage)).drop("_s", "_h")
    return res.filter(F.col(out).isNotNull() & (F.col(out) != ""))


# ------------------------------------------------------------------ similarity (TX7)

def cosine(a: Column, b: Column) -> Column:
    a = F.transform(a, lambda x: x.cast("double"))
    b = F.transform(b, lambda x: x.cast("double"))
    zero = F.lit(0.0).cast("double")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), zero, lambda acc, x: acc + x)
    na = F.aggregate(a, zero, lambda acc, x: acc + x * x)
    nb = F.aggregate(b, zero, lambda acc, x: acc + x * x)
    return dot / (F.sqrt(na) * F.sqrt(nb))


def cosine_filter(df: DataFrame, vec: str, query: DataFrame | list[float], threshold: float,
                  out: str = "similarity") -> DataFrame:
    """TX7: keep rows with cosine(query, vector) ≥ threshold. ``query`` is a literal
    vector or a one-row frame with column ``query_vec`` (broadcast)."""
    if isinstance(query, DataFrame):
        j = df.crossJoin(F.broadcast(query.select("query_vec")))
        qv = F.col("query_vec")
    else:
        j = df
        qv = F.array(*[F.lit(float(x)) for x in query])
    res = j.withColumn(out, cosine(F.col(vec), qv)).filter(F.col(out) >= threshold)
    return res.drop("query_vec") if isinstance(query, DataFrame) else res


# ------------------------------------------------------------------ lexicon (TX8–TX13)

def stem_of(word: str) -> str:
    """TX8: trimmed word without a final ``다`` (when at least two characters)."""
    w = word.strip()
    return w[:-1] if w.endswith("다") and len(w) >= 2 else w


def lexicon(positive: list[str], negative: list[str]) -> list[dict]:
    """TX8: ordered unique (word, stem, polarity) entries; blank stems dropped."""
    out, seen = [], set()
    for pol, words in (("pos", positive), ("neg", negative)):
        for w in dict.fromkeys(x.strip() for x in words if x and x.strip()):
            s = stem_of(w)
            if s and (pol, s) not in seen:
                seen.add((pol, s))
                out.append({"word": w, "stem": s, "polarity": pol})
    return out


def starts_from_pieces(pieces: Column, stem_len) -> Column:
    """Hit starts from the pieces of a split on the stem: one left-to-right
    ``aggregate`` carrying (position, starts) — the pieces are evaluated once."""
    L = stem_len if isinstance(stem_len, Column) else F.lit(int(stem_len))
    init = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("starts"))
    body = F.slice(pieces, 1, F.size(pieces) - 1)
    return F.aggregate(
        body, init,
        lambda acc, p: F.struct((acc["pos"] + F.length(p) + L).alias("pos"),
                                F.array_append(acc["starts"], acc["pos"] + F.length(p)).alias("starts")),
        lambda acc: acc["starts"])


def hit_starts(t: Column, stem: str) -> Column:
    """0-based starts of the non-overlapping occurrences of literal ``stem`` in ``t``."""
    return starts_from_pieces(F.split(t, regex_escape(stem), -1), len(stem))


def negated_hits(t: Column, stem: str, negators: list[str] | None = None, w: int = 4) -> Column:
    """TX9: for each hit of ``stem``, whether a negator occurs inside the clipped
    window [start − w, end + w). Returns array<boolean>."""
    neg = any_stem(negators or NEGATORS)
    return F.transform(stem_hits(t, [stem], w), lambda h: h["context"].rlike(neg))


def rule_sentiment(df: DataFrame, c: str, positive: list[str], negative: list[str],
                   negators: list[str] | None = None, w: int = 4, label: str = "sentiment_rule",
                   prob: str = "positive_prob") -> DataFrame:
    """TX10: on the normalised text (TX3): any negative stem → negative 0.0; a positive
    stem with a nearby negator → negative 0.0; a positive stem → positive 1.0; else
    neutral 0.5. Each list of stems is one prefix tree; a text with a negative stem or
    without a positive one is not searched for windows."""
    lex = lexicon(positive, negative)
    t = normalise_informal(F.coalesce(F.col(c).cast("string"), F.lit("")))
    pos_stems = [e["stem"] for e in lex if e["polarity"] == "pos"]
    neg_stems = [e["stem"] for e in lex if e["polarity"] == "neg"]
    tmp = pin(df, _nt=t)
    nt = F.col("_nt")
    any_neg = nt.rlike(any_stem(neg_stems)) if neg_stems else F.lit(False)
    any_pos = nt.rlike(any_stem(pos_stems)) if pos_stems else F.lit(False)
    negator = any_stem(negators or NEGATORS)
    negated = F.exists(stem_hits(nt, pos_stems, w), lambda h: h["context"].rlike(negator))
    res = tmp.withColumn(label, F.when(any_neg, F.lit(NEGATIVE)).when(~any_pos, F.lit(NEUTRAL))
                         .when(negated, F.lit(NEGATIVE)).otherwise(F.lit(POSITIVE)))
    res = res.withColumn(prob, F.when(F.col(label) == POSITIVE, 1.0)
                         .when(F.col(label) == NEGATIVE, 0.0).otherwise(0.5))
    return res.drop("_nt")


def sentiment_summary(df: DataFrame, entity: str, text: str, label: str = "sentiment_rule",
                      prob: str = "positive_prob") -> DataFrame:
    """TX11: per entity — documents (non-null text), positive, negative, neutral counts,
    positive rate and mean positive probability."""
    is_pos = F.col(label) == POSITIVE
    return df.groupBy(entity).agg(
        F.count(text).alias("n_docs"),
        F.sum(F.when(is_pos, 1).otherwise(0)).cast("long").alias("n_positive"),
        F.sum(F.when(F.col(label) == NEGATIVE, 1).otherwise(0)).cast("long").alias("n_negative"),
        F.sum(F.when(F.col(label) == NEUTRAL, 1).otherwise(0)).cast("long").alias("n_neutral"),
        F.avg(F.when(is_pos, 1.0).otherwise(0.0)).alias("positive_rate"),
        F.avg(prob).alias("mean_positive_prob"))


def keyword_counts(df: DataFrame, entity: str, c: str, positive: list[str], negative: list[str],
                   negators: list[str] | None = None, w: int = 4) -> DataFrame:
    """TX12: per (entity, polarity bucket, word) the number of hits over all documents.
    A positive hit with a nearby negator counts for the negative bucket.

    All stems are found in one walk of a text; its hits are counted by (stem, negated)
    before the shuffle, and stems get their words afterwards, from a literal list."""
    lex = lexicon(positive, negative)
    if not lex:
        return df.select(entity, F.lit("").alias("bucket"), F.lit("").alias("word"), F.lit(0).cast("long").alias("count")).limit(0)
    negator = any_stem(negators or NEGATORS)
    t = normalise_informal(F.coalesce(F.col(c).cast("string"), F.lit("")))
    base = pin(df.select(entity, c), _nt=t).select(entity, "_nt")
    hits = base.select(entity, F.inline(stem_hits(F.col("_nt"), [e["stem"] for e in lex], w)))
    found = hits.groupBy(entity, "stem", F.col("context").rlike(negator).alias("_neg")).agg(F.count(F.lit(1)).alias("_k"))
    entries: dict[str, list] = {}
    for e in lex:
        entries.setdefault(e["stem"], []).append(F.struct(F.lit(e["word"]).alias("word"), F.lit(e["polarity"]).alias("_pol")))
    words = F.create_map(*[x for s, own in entries.items() for x in (F.lit(s), F.array(*own))])
    named = found.select(entity, "_neg", "_k", F.inline(F.element_at(words, F.col("stem"))))
    bucket = F.when((F.col("_pol") == "pos") & ~F.col("_neg"), "pos").otherwise("neg")
    return named.groupBy(entity, bucket.alias("bucket"), "word").agg(F.sum("_k").cast("long").alias("count"))


def top_keyword_idf(counts: DataFrame, entity: str, entities: DataFrame | None = None,
                    none_label: str = "—") -> DataFrame:
    """TX13: per bucket, smoothed idf ln((N+1)/(df+1)) + 1 over the entities that have
    any count in that bucket; per entity and bucket the word with the highest
    tf·idf, then tf, then word. Entities without counts get ``none_label``."""
    counts = cut_lineage(counts)  # read three times, a row for each entity and word; made from the texts
    n = counts.groupBy("bucket").agg(F.countDistinct(entity).alias("_N"))
    dfc = counts.groupBy("bucket", "word").agg(F.countDistinct(entity).alias("_df"))
    idf = dfc.join(n, "bucket").withColumn("idf", F.log((F.col("_N") + 1) / (F.col("_df") + 1)) + 1.0)
    scored = counts.join(idf.select("bucket", "word", "idf"), ["bucket", "word"]) \
        .withColumn("tfidf", F.col("count") * F.col("idf"))
    from .rank import first_by
    best = first_by(scored, [entity, "bucket"],
                    [F.col("tfidf").desc(), F.col("count").desc(), F.col("word").asc()])
    wide = best.groupBy(entity).pivot("bucket", ["pos", "neg"]).agg(F.first("word"))
    wide = wide.withColumnsRenamed({"pos": "top_pos_kw", "neg": "top_neg_kw"})
    if entities is not None:
        wide = entities.select(entity).distinct().join(wide, entity, "left")
    return wide.fillna({"top_pos_kw": none_label, "top_neg_kw": none_label})


def cooccurring_token(df: DataFrame, entity: str, c: str, keywords: DataFrame, kw_col: str,
                      w: int = 40, token_pattern: str = "[가-힣]{2,}", stop: list[str] | None = None,
                      drop_suffixes: list[str] | None = None, none_label: str = "—",
                      out: str = "co_token", small: int = BROADCAST_LIMIT // 8) -> DataFrame:
    """TX14: around every hit of the entity's keyword stem (±``w`` characters, clipped)
    collect tokens (suffix- and stop-filtered), drop the stem and the keyword, and
    return the most frequent token (ties by token) or ``none_label``."""
    stop = stop or []
    suffixes = NOUN_DROP_SUFFIXES if drop_suffixes is None else drop_suffixes
    t = normalise_informal(F.coalesce(F.col(c).cast("string"), F.lit("")))
    keywords = cut_lineage(keywords)  # read twice, a row for each entity; made from the texts
    kw = keywords.select(entity, F.col(kw_col).alias("_kw")).filter(F.col("_kw") != none_label)
    kw = kw.withColumn("_stem", F.when(F.col("_kw").endswith("다") & (F.length("_kw") >= 2),
                                       F.expr("substring(_kw, 1, length(_kw) - 1)")).otherwise(F.col("_kw")))
    docs = pin(df.select(entity, c), _nt=t).select(entity, "_nt")
    # one entity may hold most documents; only when the entities are too many do texts go to their keyword
    docs = docs.join(F.broadcast(kw), entity) if fits_broadcast(keywords, small) else heavy_join(docs, kw, entity)
    nt, stem = F.col("_nt"), F.col("_stem")
    pieces = F.split(nt, F.concat(F.lit("\\Q"), stem, F.lit("\\E")), -1)
    docs = pin(docs, _starts=starts_from_pieces(pieces, F.length(stem)))
    starts = F.col("_starts")
    windows = F.transform(starts, lambda a: F.substring(
        nt, F.greatest(a - w, F.lit(0)) + 1, a + F.length(stem) + w - F.greatest(a - w, F.lit(0))))
    toks = F.flatten(F.transform(windows, lambda s: F.regexp_extract_all(s, F.lit(f"({token_pattern})"), 1)))
    per = docs.select(entity, "_kw", "_stem", F.explode(toks).alias("tok"))
    bad = F.lit(False)
    for sfx in suffixes:
        bad = bad | F.col("tok").endswith(sfx)
    per = per.filter(~bad & ~F.col("tok").isin(stop) & (F.col("tok") != F.col("_stem")) & (F.col("tok") != F.col("_kw")))
    cnt = per.groupBy(entity, "tok").agg(F.count(F.lit(1)).alias("_n"))
    from .rank import first_by
    best = first_by(cnt, entity, [F.col("_n").desc(), F.col("tok").asc()]).select(entity, F.col("tok").alias(out))
    return (keywords.select(entity).distinct().join(best, entity, "left")
            .fillna({out: none_label}))


# ------------------------------------------------------------------ tokens & vocabulary

TOKEN_CLASS = r"[\p{L}\p{N}_]"


def tokens(c, stop: list[str] | None = None, min_len: int = 2, pattern: str = TOKEN_CLASS + "+",
           lower: bool = True) -> Column:
    """TX15 as an array: regex tokens (duplicates kept), minus stop words, length ≥ ``min_len``."""
    t = _c(c).cast("string")
    t = F.lower(t) if lower else t
    toks = F.regexp_extract_all(t, F.lit(f"({pattern})"), 1)
    stop_arr = F.array(*[F.lit(s) for s in (stop or [])]) if stop else F.array().cast("array<string>")
    return F.filter(toks, lambda x: (F.length(x) >= min_len) & ~F.array_contains(stop_arr, x))


def token_rows(df: DataFrame, c: str, keep=None, stop: list[str] | None = None, min_len: int = 2,
               lower: bool = True, out: str = "term") -> DataFrame:
    """TX15 as rows: one row per token. Tokens are the maximal runs of letters, digits
    and ``_``, found by splitting on the complement class; stop words and short tokens
    are removed by an ordinary (codegen) filter — no per-element lambda."""
    t = F.col(c).cast("string")
    t = F.lower(t) if lower else t
    rows = df.select(*_cols(keep), F.explode(F.split(t, "[^" + TOKEN_CLASS[1:-1] + "]+")).alias(out))
    cond = (F.length(out) >= max(min_len, 1))
    if stop:
        cond = cond & ~F.col(out).isin(list(stop))
    return rows.filter(cond)


def vocabulary(rows: DataFrame, doc: str, term: str = "term", min_df: float = 1, max_df: float = 1.0,
               max_features: int | None = None, docs: DataFrame | None = None) -> DataFrame:
    """TX16 over token rows (doc, term): terms with document frequency ≥ ``min_df``
    (count, or share when < 1) and ≤ ``max_df`` (share, or count when > 1), the
    ``max_features`` most frequent by corpus term frequency (ties by term). Shares are
    of the rows of ``docs``, documents without any token included; without ``docs``
    only documents with a token are known."""
    counted = rows.select(doc).distinct() if docs is None else docs
    n_docs = counted.agg(F.count(F.lit(1)).alias("_N"))
    per = rows.groupBy(doc, term).agg(F.count(F.lit(1)).alias("_tf"))
    stats = per.groupBy(term).agg(F.count(F.lit(1)).alias("df"), F.sum("_tf").alias("tf"))
    stats = stats.crossJoin(F.broadcast(n_docs))
    lo = F.lit(float(min_df)) * F.col("_N") if min_df < 1 else F.lit(float(min_df))
    hi = F.lit(float(max_df)) * F.col("_N") if max_df <= 1 else F.lit(float(max_df))
    kept = stats.filter((F.col("df") >= lo) & (F.col("df") <= hi)).drop("_N")
    if max_features:
        # a top-k selection: every task keeps its best k, then k over the survivors
        top = kept.orderBy(F.col("tf").desc(), F.col(term).asc()).limit(max_features)
        w = Window.partitionBy().orderBy(F.col("tf").desc(), F.col(term).asc())  # ≤ max_features rows
        kept = top.withColumn("tf_rank", F.row_number().over(w).cast("long"))
    return kept.withColumn("df", F.col("df").cast("long")).withColumn("tf", F.col("tf").cast("long"))


def class_tfidf(rows: DataFrame, label: str, term: str = "term", top_n: int = 10) -> DataFrame:
    """TX17 word weights per class over token rows (c-TF-IDF, Grootendorst 2022): term
    frequency L1-normalised per class × ln(1 + A / f_t), A = floor(mean words per
    class), f_t = frequency of t over all classes. Top ``top_n`` terms per class."""
    tc = rows.groupBy(label, term).agg(F.count(F.lit(1)).alias("tf"))
    cls = tc.groupBy(label).agg(F.sum("tf").alias("_ct"))
    ft = tc.groupBy(term).agg(F.sum("tf").alias("_ft"))
    A = cls.agg(F.floor(F.avg("_ct")).alias("_A"))
    j = heavy_join(tc, cls, label).join(ft, term).crossJoin(F.broadcast(A))
    j = j.withColumn("weight", F.col("tf") / F.col("_ct") * F.log(1.0 + F.col("_A") / F.col("_ft")))
    from .rank import cap_per_key
    top = cap_per_key(j, label, [F.col("weight").desc(), F.col(term).asc()], top_n, out="term_rank")
    return top.select(label, term, F.col("tf").cast("long").alias("tf"), "weight",
                      F.col("term_rank").cast("long").alias("term_rank"))


def topics(df: DataFrame, vec: str, doc: str, text: str, k: int = 10, dims: int = 8,
           outlier_q: float = 0.95, top_n: int = 10, seed: int = 7, n_docs: int = 3,
           stop: list[str] | None = None) -> dict:
    """TX17 (re-aimed): vectors → PCA → KMeans; rows farther from their centre than
    the ``outlier_q`` distance quantile of their cluster get topic −1. Returns
    ``{"assignments", "topic_info", "words", "representative"}`` frames."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from .agg import quantile_exact
    from .rank import cap_per_key
    v = df.withColumn("_features", array_to_vector(F.transform(F.col(vec), lambda x: x.cast("double"))))
    pca = PCA(k=dims, inputCol="_features", outputCol="_reduced").fit(v)
    red = pca.transform(v)
    km = KMeans(k=k, seed=seed, featuresCol="_reduced", predictionCol="_cluster").fit(red)
    centers = km.clusterCenters()
    spark = df.sparkSession
    cdf = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)],
                                "_cluster int, _center array<double>")
    a = km.transform(red).join(F.broadcast(cdf), "_cluster")
    arr = vector_to_array(F.col("_reduced"))
    a = a.withColumn("_dist", F.sqrt(F.aggregate(F.zip_with(arr, F.col("_center"), lambda x, y: (x - y) * (x - y)),
                                                 F.lit(0.0), lambda s, x: s + x)))
    thr = quantile_exact(a, "_dist", {"_thr": outlier_q}, by="_cluster")
    a = a.join(thr, "_cluster").withColumn("topic", F.when(F.col("_dist") > F.col("_thr"), F.lit(-1))
                                           .otherwise(F.col("_cluster")))
    assignments = a.select(doc, "topic", "_dist", *[c for c in df.columns if c not in (vec, doc)])
    words = class_tfidf(token_rows(assignments, text, keep="topic", stop=stop), "topic", "term", top_n)
    info = assignments.groupBy("topic").agg(F.count(F.lit(1)).alias("count"))
    names = words.filter(F.col("term_rank") <= 4).groupBy("topic").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("term_rank", "term"))), lambda s: s["term"]), "_").alias("_nm"))
    info = info.join(names, "topic", "left").withColumn("name", F.concat_ws("_", F.col("topic").cast("string"), F.col("_nm"))).drop("_nm")
    rep = cap_per_key(assignments.filter(F.col("topic") >= 0), "topic", [F.col("_dist").asc(), F.col(doc).asc()], n_docs)
    return {"assignments": assignments.drop("_dist"), "topic_info": info, "words": words,
            "representative": rep.select("topic", doc, "_dist")}


def require_min_docs(df: DataFrame, entity: str, n: int) -> DataFrame:
    """TX18: keep entities with at least ``n`` documents."""
    ok = df.groupBy(entity).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n)
    return heavy_join(df, ok.select(entity), entity, "left_semi")


def topic_keywords(df: DataFrame, topic: str, representation: str, out: str = "keyword") -> DataFrame:
    """TX19: drop outlier topic −1, explode the representation list, count keywords."""
    from .agg import value_counts
    from ..functions.text import to_array
    kept = df.filter(F.col(topic) != -1).select(F.explode(to_array(F.col(representation))).alias(out))
    kept = kept.filter(F.trim(F.col(out)) != "")
    return value_counts(kept, out)


def join_docs(c, sep: str = " ") -> Column:
    """TX20: non-blank list elements joined into one text."""
    return F.array_join(F.filter(_c(c), lambda x: x.isNotNull() & (F.trim(x) != "")), sep)


def score_text(df: DataFrame, c: str, predict_fn, label_map: dict | None = None,
               positive_label: str | None = None, batch_size: int = 32,
               label: str = "label", score: str = "score", prob: str = "positive_prob") -> DataFrame:
    """TX21: apply a user model ``predict_fn(list[str]) -> list[(label, score)]`` in
    batches of ``batch_size`` via ``mapInPandas`` (the model is built once per task
    when ``predict_fn`` is a factory with attribute ``load``). Labels are mapped with
    ``label_map``; positive probability = score for the positive label, else 1 − score."""
    import pandas as pd
    schema = T.StructType(df.schema.fields + [T.StructField(label, T.StringType()),
                                              T.StructField(score, T.DoubleType()),
                                              T.StructField(prob, T.DoubleType())])
    lm = dict(label_map or {})
    pos = positive_label

    def run(batches):
        fn = predict_fn.load() if hasattr(predict_fn, "load") else predict_fn
        for pdf in batches:
            texts = pdf[c].fillna("").astype(str).tolist()
            labels, scores = [], []
            for i in range(0, len(texts), batch_size):
                for lab, sc in fn(texts[i:i + batch_size]):
                    labels.append(lm.get(lab, lab))
                    scores.append(float(sc))
            out = pdf.copy()
            out[label] = labels
            out[score] = scores
            s = pd.Series(scores, index=out.index)
            is_pos = pd.Series([x == pos for x in labels], index=out.index)
            out[prob] = s.where(is_pos, 1.0 - s)
            yield out
    return df.mapInPandas(run, schema)


# ------------------------------------------------------------------ records and pages

def assemble_review(df: DataFrame, body: str, tags: str | None = None, out: str = "review") -> DataFrame:
    """TX22: body + tag text, line breaks → space, clock times removed, blank dropped."""
    txt = F.coalesce(F.col(body).cast("string"), F.lit(""))
    if tags:
        txt = F.concat_ws(" ", txt, F.coalesce(F.col(tags).cast("string"), F.lit("")))
    txt = F.regexp_replace(txt, "[\r\n]+", " ")
    txt = F.regexp_replace(txt, r"\b\d{1,2}:\d{2}\b", "")
    txt = F.trim(F.regexp_replace(txt, WS_CLASS + "+", " "))
    return df.withColumn(out, txt).filter(F.col(body).isNotNull() & (F.trim(F.col(body)) != "")).filter(F.col(out) != "")


def min_length(df: DataFrame, c: str, n: int, query: str | None = None, place_out: str = "place") -> DataFrame:
    """TX23: keep texts with at least ``n`` characters; place = first word of the query."""
    res = df.filter(F.length(F.col(c)) >= n)
    if query:
        res = res.withColumn(place_out, F.split(F.col(query), " ").getItem(0))
    return res


def page_fields(df: DataFrame, html: str) -> DataFrame:
    """TX24: title, visible body text (scripts/styles/tags removed) and link targets."""
    h = F.col(html).cast("string")
    title = F.regexp_extract(h, r"(?s)<title[^>]*>(.*?)</title>", 1)
    body = F.regexp_extract(h, r"(?s)<body[^>]*>(.*)</body>", 1)
    body = F.regexp_replace(body, r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    body = F.regexp_replace(body, r"<[^>]+>", " ")
    body = F.trim(F.regexp_replace(body, WS_CLASS + "+", " "))
    links = F.regexp_extract_all(h, F.lit(r'href="([^"]*)"'), 1)
    return df.withColumns({"title": F.trim(title), "body_text": body, "links": links})
