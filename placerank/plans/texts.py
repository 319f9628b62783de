"""Registered queries: review-text operators on documents, pages, conversations and
embeddings (TX1–TX24, AG15, WN7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import (BLOG_NOISE, EMOJI_RANGES, HANGUL_KEEP, clean_hangul, clean_web,
                              keyword_regex, normalise_informal)
from ..operators import text as T
from ..operators.agg import value_counts
from ..operators.rank import cap_per_key, context_window
from .registry import load, query

WS = "[ \\t\\n\\r\\f]"


def _q(s: str) -> str:
    """SQL string literal (standard SQL quoting)."""
    return "'" + s.replace("'", "''") + "'"


# ------------------------------------------------------------------ SQL building blocks

def sql_collapse(chars: str) -> str:
    """Runs of ≥3 equal characters → 2 (the regex back-reference, via a character list).
    ``chars`` must be a column holding ``string_split(text, '')`` so the lambda reads it
    without splitting again."""
    return (f"array_to_string(list_filter({chars}, lambda ch, i: i < 3 OR ch <> {chars}[i - 1] "
            f"OR ch <> {chars}[i - 2]), '')")


def sql_clean_web(x: str) -> str:
    t = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    t = f"regexp_replace({t}, 'https?://[^ \\t\\n\\r\\f]+|www\\.[^ \\t\\n\\r\\f]+', ' ', 'g')"
    emoji = "[" + "".join(f"\\x{{{a}}}-\\x{{{b}}}" for a, b in EMOJI_RANGES) + "]+"
    t = f"regexp_replace({t}, '{emoji}', ' ', 'g')"
    for p in BLOG_NOISE:
        t = f"replace({t}, {_q(p)}, ' ')"
    return t


def sql_normalise(x: str) -> str:
    t = f"lower(trim({x}))"
    t = f"regexp_replace({t}, '(ㅋ|ㅎ){{2,}}', ' ', 'g')"
    t = f"regexp_replace({t}, '!{{2,}}', '!', 'g')"
    t = f"regexp_replace({t}, '\\?{{2,}}', '?', 'g')"
    t = f"regexp_replace({t}, '[^\\p{{L}}\\p{{N}}_ \\t\\n\\r\\f가-힣!?.,]', ' ', 'g')"
    return f"trim(regexp_replace({t}, '{WS}+', ' ', 'g'))"


def sql_sentences(x: str) -> str:
    t = f"regexp_replace({x}, '[\\r\\t]+', ' ', 'g')"
    t = f"regexp_replace({t}, '([.!?])', '\\1 ', 'g')"
    t = f"regexp_replace({t}, '([.!?]){WS}+', '\\1' || chr(10), 'g')"
    parts = f"string_split_regex({t}, '\\n+')"
    trimmed = f"list_transform({parts}, lambda p: regexp_replace(p, '^{WS}+|{WS}+$', '', 'g'))"
    return f"list_filter({trimmed}, lambda p: p <> '')"


def sql_hit_starts(t: str, stem: str) -> str:
    L = len(stem)
    pieces = f"string_split({t}, {_q(stem)})"
    return (f"list_transform(range(1, len({pieces})), lambda k: "
            f"CAST(coalesce(list_sum(list_transform({pieces}[1:k], lambda p: length(p))), 0) + (k - 1) * {L} AS BIGINT))")


def sql_negated_flags(t: str, stem: str, negators: list[str], w: int = 4) -> str:
    L = len(stem)
    neg = keyword_regex(negators)
    ctx = f"substr({t}, greatest(a - {w}, 0) + 1, a + {L} + {w} - greatest(a - {w}, 0))"
    return f"list_transform({sql_hit_starts(t, stem)}, lambda a: regexp_matches({ctx}, {_q(neg)}))"


# ------------------------------------------------------------------ TX1–TX3

@query("web_clean", f"""
SELECT page_id, trim(regexp_replace(regexp_replace({sql_collapse('chars')}, '[\\r\\t]+', ' ', 'g'), '{WS}{{2,}}', ' ', 'g'))
  AS web_text
FROM (SELECT page_id, string_split({sql_clean_web('html')}, '') AS chars FROM pages)
""")
def web_clean(spark, sf):
    """TX1: tags, URLs, emoji, noise phrases removed; repeats collapsed; whitespace squeezed."""
    p = load(spark, sf, "pages")
    return p.select("page_id", clean_web("html").alias("web_text"))


_LATIN = "a-zA-ZÀ-ÿ"
_KEEP = HANGUL_KEEP + _LATIN


def _sql_clean_hangul(x: str) -> str:
    from ..functions.text import AD_PATTERNS, BAN_PHRASES
    t = f"regexp_replace({x}, {_q('|'.join(AD_PATTERNS))}, '', 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', '', 'g')"
    t = f"regexp_replace({t}, '[^{_KEEP} \\t\\n\\r\\f.,!?]', ' ', 'g')"
    t = f"trim(regexp_replace({t}, '{WS}+', ' ', 'g'))"
    for p in BAN_PHRASES:
        t = f"replace({t}, {_q(p)}, '')"
    return t


@query("text_normalise", f"""
SELECT doc_id, {_sql_clean_hangul('text')} AS cleaned, {sql_normalise('text')} AS informal FROM documents
""")
def text_normalise(spark, sf):
    """TX2 ad/tag removal keeping a letter class plus .,!? ; TX3 informal-text normalisation."""
    d = load(spark, sf, "documents")
    return d.select("doc_id", clean_hangul("text", keep=_KEEP).alias("cleaned"),
                    normalise_informal("text").alias("informal"))


# ------------------------------------------------------------------ TX4–TX6, WN7

@query("sentences", f"""
WITH s AS (SELECT doc_id, {sql_sentences('text')} AS arr FROM documents)
SELECT doc_id, CAST(unnest(range(len(arr))) AS INTEGER) AS sent_pos, unnest(arr) AS sentence FROM s
""")
def sentences_q(spark, sf):
    """TX4: sentence split with positions among non-blank sentences."""
    return T.sentences(load(spark, sf, "documents"), "text", keep="doc_id")


@query("sentences_min5", f"""
WITH s AS (SELECT doc_id, list_filter({sql_sentences('text')}, lambda p: length(p) >= 5) AS arr FROM documents)
SELECT doc_id, unnest(arr) AS sentence FROM s
""")
def sentences_min5(spark, sf):
    """TX5: sentences of at least five characters."""
    return T.sentences(load(spark, sf, "documents"), "text", keep="doc_id", min_len=5).drop("sent_pos")


_ENTITIES = ["thor", "ouen", "sch", "ment"]


@query("entity_passages", f"""
WITH d AS (SELECT doc_id, text, {sql_sentences('text')} AS s FROM documents),
e AS (SELECT d.doc_id, v.entity, d.s FROM d CROSS JOIN (VALUES {", ".join(f"({_q(e)})" for e in _ENTITIES)}) AS v(entity)
      WHERE instr(coalesce(d.text, ''), v.entity) > 0),
p AS (SELECT doc_id, entity, CASE WHEN len(s) > 0 THEN array_to_string(list_transform(list_filter(range(len(s)),
        lambda i: len(list_filter(range(greatest(i - 1, 0), least(i + 1, len(s) - 1) + 1),
                                  lambda j: instr(s[j + 1], entity) > 0)) > 0), lambda i: s[i + 1]), ' ') END AS relevant_text
      FROM e)
SELECT doc_id, entity, relevant_text FROM p WHERE relevant_text IS NOT NULL AND relevant_text <> ''
""")
def entity_passages(spark, sf):
    """TX6: per (document, mentioned entity) the hit sentences ± 1 neighbour, in order."""
    return T.entity_passages(load(spark, sf, "documents"), "text", _ENTITIES, keep="doc_id", k=1)


@query("context_sentences", f"""
WITH s AS (SELECT doc_id, {sql_sentences('text')} AS arr FROM documents),
x AS (SELECT doc_id, unnest(range(len(arr))) AS sent_pos, unnest(arr) AS sentence FROM s),
h AS (SELECT *, max(CASE WHEN instr(sentence, 'ment') > 0 THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY sent_pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM x)
SELECT doc_id, CAST(sent_pos AS INTEGER) AS sent_pos FROM h WHERE near = 1
""")
def context_sentences(spark, sf):
    """WN7: hit rows plus one neighbour on each side, per document in sentence order."""
    s = T.sentences(load(spark, sf, "documents"), "text", keep="doc_id")
    s = s.withColumn("hit", F.instr("sentence", "ment") > 0)
    return context_window(s, "doc_id", "sent_pos", "hit", 1, dense=True).select("doc_id", "sent_pos")


# ------------------------------------------------------------------ lexicon sentiment (TX8–TX13)

_POS = ["thor다", "ouen", "ble", "ntly"]
_NEG = ["sch", "eaux다", "zzq"]
_NEGATORS = ["pa", "nd", "nicht"]


def _lex():
    return T.lexicon(_POS, _NEG)


def _rule_sql() -> str:
    lex = _lex()
    pos = [e["stem"] for e in lex if e["polarity"] == "pos"]
    neg = [e["stem"] for e in lex if e["polarity"] == "neg"]
    negated = " OR ".join(f"list_bool_or({sql_negated_flags('nt', s, _NEGATORS)}) IS TRUE" for s in pos)
    return f"""
WITH d AS (SELECT source, text, {sql_normalise("coalesce(text, '')")} AS nt FROM documents),
l AS (SELECT source, text,
        CASE WHEN regexp_matches(nt, {_q(keyword_regex(neg))}) THEN '부정'
             WHEN regexp_matches(nt, {_q(keyword_regex(pos))}) AND ({negated}) THEN '부정'
             WHEN regexp_matches(nt, {_q(keyword_regex(pos))}) THEN '긍정' ELSE '중립' END AS sentiment_rule
      FROM d),
p AS (SELECT *, CASE WHEN sentiment_rule = '긍정' THEN 1.0 WHEN sentiment_rule = '부정' THEN 0.0 ELSE 0.5 END
        AS positive_prob FROM l)
SELECT source, count(text) AS n_docs,
  CAST(sum(CASE WHEN sentiment_rule = '긍정' THEN 1 ELSE 0 END) AS BIGINT) AS n_positive,
  CAST(sum(CASE WHEN sentiment_rule = '부정' THEN 1 ELSE 0 END) AS BIGINT) AS n_negative,
  CAST(sum(CASE WHEN sentiment_rule = '중립' THEN 1 ELSE 0 END) AS BIGINT) AS n_neutral,
  avg(CASE WHEN sentiment_rule = '긍정' THEN 1.0 ELSE 0.0 END) AS positive_rate,
  avg(positive_prob) AS mean_positive_prob
FROM p GROUP BY source
"""


@query("rule_sentiment", _rule_sql(), doubles=["positive_rate", "mean_positive_prob"])
def rule_sentiment_q(spark, sf):
    """TX8 lexicon stems, TX9 negation window, TX10 rule label, TX11 summary per source."""
    d = load(spark, sf, "documents")
    s = T.rule_sentiment(d, "text", _POS, _NEG, negators=_NEGATORS)
    return T.sentiment_summary(s, "source", "text")


def _counts_sql() -> str:
    rows = []
    for e in _lex():
        flags = sql_negated_flags("nt", e["stem"], _NEGATORS)
        if e["polarity"] == "pos":
            n_neg = f"len(list_filter({flags}, lambda b: b))"
            n_pos = f"len({flags}) - {n_neg}"
        else:
            n_pos, n_neg = "0", f"len({flags})"
        rows.append(f"SELECT source, {_q(e['word'])} AS word, {n_pos} AS p, {n_neg} AS n FROM d")
    return f"""
WITH d AS (SELECT source, {sql_normalise("coalesce(text, '')")} AS nt FROM documents),
h AS ({" UNION ALL ".join(rows)}),
b AS (SELECT source, 'pos' AS bucket, word, p AS k FROM h UNION ALL SELECT source, 'neg', word, n FROM h)
SELECT source, bucket, word, CAST(sum(k) AS BIGINT) AS count FROM b WHERE k > 0 GROUP BY source, bucket, word
"""


_COUNTS_SQL = _counts_sql()


@query("keyword_counts", _COUNTS_SQL)
def keyword_counts_q(spark, sf):
    """TX12: keyword hits per source and bucket; negated positive hits count as negative."""
    return T.keyword_counts(load(spark, sf, "documents"), "source", "text", _POS, _NEG, negators=_NEGATORS)


_TOP_SQL = f"""
WITH c AS ({_COUNTS_SQL}),
n AS (SELECT bucket, count(DISTINCT source) AS nn FROM c GROUP BY bucket),
f AS (SELECT bucket, word, count(DISTINCT source) AS df FROM c GROUP BY bucket, word),
s AS (SELECT c.*, c.count * (ln((n.nn + 1.0) / (f.df + 1.0)) + 1.0) AS tfidf
      FROM c JOIN n USING (bucket) JOIN f USING (bucket, word)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, bucket ORDER BY tfidf DESC, count DESC, word) AS rn
      FROM s) WHERE rn = 1),
e AS (SELECT DISTINCT source FROM documents)
SELECT e.source, coalesce(max(CASE WHEN bucket = 'pos' THEN word END), '—') AS top_pos_kw,
       coalesce(max(CASE WHEN bucket = 'neg' THEN word END), '—') AS top_neg_kw
FROM e LEFT JOIN b USING (source) GROUP BY e.source
"""


@query("keyword_top1", _TOP_SQL)
def keyword_top1(spark, sf):
    """TX13: smoothed IDF over sources, top-1 keyword per bucket by tf·idf, then tf; '—' when none."""
    d = load(spark, sf, "documents")
    counts = T.keyword_counts(d, "source", "text", _POS, _NEG, negators=_NEGATORS)
    return T.top_keyword_idf(counts, "source", entities=d.select("source"))


def _cooccurring_sql() -> str:
    drop = " AND ".join(f"NOT ends_with(tok, {_q(x)})" for x in T.NOUN_DROP_SUFFIXES)
    return f"""
WITH k AS ({_TOP_SQL}),
s AS (SELECT source, top_pos_kw AS kw, CASE WHEN ends_with(top_pos_kw, '다') AND length(top_pos_kw) >= 2
        THEN left(top_pos_kw, length(top_pos_kw) - 1) ELSE top_pos_kw END AS stem FROM k WHERE top_pos_kw <> '—'),
d AS (SELECT source, kw, stem, nt, string_split(nt, stem) AS p FROM (SELECT source, {sql_normalise("coalesce(text, '')")} AS nt FROM documents)
      JOIN s USING (source)),
h AS (SELECT source, kw, stem, nt, unnest(list_transform(range(1, len(p)), lambda i:
        CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(stem) AS BIGINT))) AS a FROM d),
w AS (SELECT source, kw, stem, unnest(regexp_extract_all(substr(nt, greatest(a - 40, 0) + 1,
        a + length(stem) + 40 - greatest(a - 40, 0)), '[a-zà-ÿ]{{2,}}')) AS tok FROM h),
c AS (SELECT source, tok, count(*) AS n FROM w WHERE {drop} AND tok NOT IN ('the', 'and', 'de', 'la') AND tok <> stem AND tok <> kw GROUP BY 1, 2),
b AS (SELECT source, tok, row_number() OVER (PARTITION BY source ORDER BY n DESC, tok) AS rn FROM c)
SELECT e.source, coalesce(b.tok, '—') AS co_token FROM (SELECT DISTINCT source FROM k) e LEFT JOIN b ON b.source = e.source AND b.rn = 1
"""


@query("cooccurring_word", _cooccurring_sql())
def cooccurring_word(spark, sf):
    """TX14: most frequent token within ±40 characters of each source's top positive keyword."""
    d = load(spark, sf, "documents")
    counts = T.keyword_counts(d, "source", "text", _POS, _NEG, negators=_NEGATORS)
    top = T.top_keyword_idf(counts, "source", entities=d.select("source"))
    return T.cooccurring_token(d, "source", "text", top, "top_pos_kw", token_pattern="[a-zà-ÿ]{2,}",
                               stop=["the", "and", "de", "la"])


# ------------------------------------------------------------------ tokens, vocabulary, frequency

_STOP = ["the", "and", "de", "la", "der", "die", "el"]


def _sql_tokens(x: str) -> str:
    stop = "[" + ", ".join(_q(s) for s in _STOP) + "]"
    return (f"list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'), "
            f"lambda w: length(w) >= 2 AND NOT list_contains({stop}, w))")


@query("vocabulary", f"""
WITH t AS (SELECT doc_id, unnest({_sql_tokens('text')}) AS term FROM documents),
per AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
st AS (SELECT term, count(*) AS df, sum(tf) AS tf FROM per GROUP BY term),
n AS (SELECT count(DISTINCT doc_id) AS nd FROM documents),
k AS (SELECT st.* FROM st CROSS JOIN n WHERE df >= 2 AND df <= 0.5 * nd),
r AS (SELECT *, row_number() OVER (ORDER BY tf DESC NULLS LAST, term) AS tf_rank FROM k)
SELECT term, CAST(df AS BIGINT) AS df, CAST(tf AS BIGINT) AS tf, CAST(tf_rank AS BIGINT) AS tf_rank FROM r WHERE tf_rank <= 300
""")
def vocabulary_q(spark, sf):
    """TX15 tokens (stop words, length ≥ 2), TX16 min_df / max_df / max_features vocabulary."""
    docs = load(spark, sf, "documents")
    rows = T.token_rows(docs, "text", keep="doc_id", stop=_STOP)
    return T.vocabulary(rows, "doc_id", "term", min_df=2, max_df=0.5, max_features=300, docs=docs.select("doc_id"))


@query("frequency_table", f"""
SELECT term, count(*) AS count FROM (SELECT unnest({_sql_tokens('text')}) AS term FROM documents)
WHERE term IS NOT NULL GROUP BY term
""")
def frequency_table(spark, sf):
    """AG15: token frequency table (most common first)."""
    return value_counts(T.token_rows(load(spark, sf, "documents"), "text", stop=_STOP), "term")


# ------------------------------------------------------------------ embeddings (TX7, TX17–TX20)

@query("cosine_filter", """
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings ORDER BY vec_id LIMIT 1),
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT vec_id,
        list_reduce(list_transform(list_zip(v, qv), lambda p: p[1] * p[2]), lambda a, b: a + b)
        / (sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b))
           * sqrt(list_reduce(list_transform(qv, lambda x: x * x), lambda a, b: a + b))) AS similarity
      FROM e CROSS JOIN q)
SELECT vec_id, similarity FROM s WHERE similarity >= 0.1
""", doubles=["similarity"])
def cosine_filter_q(spark, sf):
    """TX7: cosine similarity to a query vector (the first embedding), threshold 0.1."""
    e = load(spark, sf, "embeddings")
    first = e.agg(F.min("vec_id").alias("_q"))
    qv = e.join(first, e.vec_id == first._q).select(F.col("embedding").alias("query_vec"))
    return T.cosine_filter(e.select("vec_id", "embedding"), "embedding", qv, 0.1).select("vec_id", "similarity")


def _topic_docs(spark, sf):
    e = load(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", "embedding")
    d = load(spark, sf, "documents").select("doc_id", "text")
    return e.join(d, "doc_id")


_CTFIDF_SQL = f"""
WITH j AS (SELECT e.label, d.doc_id, d.text FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id),
ok AS (SELECT label FROM j GROUP BY label HAVING count(*) >= 10),
t AS (SELECT label, unnest({_sql_tokens('text')}) AS term FROM j WHERE label IN (SELECT label FROM ok)),
tc AS (SELECT label, term, count(*) AS tf FROM t GROUP BY 1, 2),
cls AS (SELECT label, sum(tf) AS ct FROM tc GROUP BY 1),
ft AS (SELECT term, sum(tf) AS ftt FROM tc GROUP BY 1),
a AS (SELECT floor(avg(ct)) AS aa FROM cls),
w AS (SELECT tc.label, tc.term, tc.tf, tc.tf / cls.ct * ln(1.0 + a.aa / ft.ftt) AS weight
      FROM tc JOIN cls USING (label) JOIN ft USING (term) CROSS JOIN a),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY weight DESC, term) AS term_rank FROM w)
SELECT label, term, CAST(tf AS BIGINT) AS tf, weight, CAST(term_rank AS BIGINT) AS term_rank FROM r WHERE term_rank <= 10
"""


def _ctfidf(spark, sf):
    j = T.require_min_docs(_topic_docs(spark, sf), "label", 10)
    return T.class_tfidf(T.token_rows(j, "text", keep="label", stop=_STOP), "label", "term", top_n=10)


@query("topic_ctfidf", _CTFIDF_SQL, doubles=["weight"])
def topic_ctfidf(spark, sf):
    """TX18 minimum documents per class, TX17 class TF-IDF top-10 terms per class label."""
    return _ctfidf(spark, sf)


@query("topic_keywords", f"""
WITH w AS ({_CTFIDF_SQL}),
rep AS (SELECT label AS topic, '[' || string_agg('''' || term || '''', ', ' ORDER BY term_rank) || ']' AS representation
        FROM w GROUP BY label)
SELECT keyword, count(*) AS count FROM (SELECT unnest(list_transform(string_split(trim(representation, '[]'), ', '),
  lambda x: trim(x, ''''))) AS keyword FROM rep WHERE topic <> -1) WHERE trim(keyword) <> '' GROUP BY keyword
""")
def topic_keywords_q(spark, sf):
    """TX19: topic tables with string-list representations → keyword frequency (topic −1 dropped)."""
    w = _ctfidf(spark, sf)
    rep = w.groupBy(F.col("label").alias("topic")).agg(
        F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("term_rank", "term"))),
                                                      lambda s: F.concat(F.lit("'"), s["term"], F.lit("'"))), ", "),
                 F.lit("]")).alias("representation"))
    return T.topic_keywords(rep, "topic", "representation")


@query("topic_docs", """
WITH j AS (SELECT e.label, d.doc_id, d.text AS snippet FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS rn FROM j)
SELECT label, string_agg(snippet, ' ' ORDER BY rn) FILTER (WHERE trim(snippet) <> '') AS rep_text FROM r WHERE rn <= 3 GROUP BY label
""")
def topic_docs(spark, sf):
    """TX20: the three first documents of each class joined into one text (blanks skipped)."""
    j = _topic_docs(spark, sf).select("label", "doc_id", F.col("text").alias("snippet"))
    top = cap_per_key(j, "label", [F.col("doc_id").asc()], 3, out="rn")
    g = top.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("rn", "snippet"))).alias("_s"))
    return g.select("label", T.join_docs(F.transform("_s", lambda s: s["snippet"])).alias("rep_text"))


@query("topic_clusters", None)
def topic_clusters(spark, sf):
    """TX17 re-aimed: PCA → KMeans → outliers (−1) → per-topic c-TF-IDF words (rows-only check)."""
    j = _topic_docs(spark, sf)
    res = T.topics(j.select("doc_id", "embedding", "text"), "embedding", "doc_id", "text", k=8, dims=8, stop=_STOP)
    return res["assignments"].select("doc_id", "topic")


# ------------------------------------------------------------------ TX21

class ThePredictor:
    """Stand-in model: LABEL_1 when a text holds ≥ 3 'the', score = min(1, length/5000)."""

    def __call__(self, texts):
        return [("LABEL_1" if t.count("the") >= 3 else "LABEL_0", min(1.0, len(t) / 5000.0)) for t in texts]


@query("batch_scoring", """
WITH s AS (SELECT doc_id, CASE WHEN len(string_split(coalesce(text, ''), 'the')) - 1 >= 3 THEN 'positive' ELSE 'negative' END AS label,
                  least(1.0, length(coalesce(text, '')) / 5000.0) AS score FROM documents)
SELECT doc_id, label, score, CASE WHEN label = 'positive' THEN score ELSE 1.0 - score END AS positive_prob FROM s
""", doubles=["score", "positive_prob"])
def batch_scoring(spark, sf):
    """TX21: a supplied model applied in batches of 32 (mapInPandas), labels mapped,
    positive probability = score or 1 − score."""
    d = load(spark, sf, "documents").select("doc_id", "text")
    s = T.score_text(d, "text", ThePredictor(), label_map={"LABEL_1": "positive", "LABEL_0": "negative"},
                     positive_label="positive", batch_size=32)
    return s.select("doc_id", "label", "score", "positive_prob")


# ------------------------------------------------------------------ TX22–TX24

@query("html_fields", f"""
WITH p AS (SELECT page_id, html,
  trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)) AS title,
  regexp_replace(regexp_extract(html, '(?s)<body[^>]*>(.*)</body>', 1),
                 '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g') AS b FROM pages)
SELECT page_id, title, trim(regexp_replace(regexp_replace(b, '<[^>]+>', ' ', 'g'), '{WS}+', ' ', 'g')) AS body_text,
  CAST(len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS INTEGER) AS n_links
FROM p
""")
def html_fields(spark, sf):
    """TX24: title, visible body text and link count from stored HTML."""
    p = T.page_fields(load(spark, sf, "pages"), "html")
    return p.select("page_id", "title", "body_text", F.size("links").alias("n_links"))


@query("review_assembly", f"""
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(concat_ws(' ', coalesce(text, ''), coalesce(role, '')),
  '[\\r\\n]+', ' ', 'g'), '\\b\\d{{1,2}}:\\d{{2}}\\b', '', 'g'), '{WS}+', ' ', 'g')) AS review
FROM conversations WHERE text IS NOT NULL AND trim(text) <> ''
""")
def review_assembly(spark, sf):
    """TX22: body + tag text, line breaks → space, clock times removed, blank bodies dropped."""
    c = load(spark, sf, "conversations")
    return T.assemble_review(c, "text", "role").select("conv_id", "turn", "review")


@query("long_posts", """
SELECT doc_id, split_part(text, ' ', 1) AS place FROM documents WHERE length(text) >= 1000
""")
def long_posts(spark, sf):
    """TX23: texts of at least 1000 characters; place = first word of the query text."""
    d = load(spark, sf, "documents")
    return T.min_length(d, "text", 1000, query="text").select("doc_id", "place")
