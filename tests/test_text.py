import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placerank.operators import text as T


def py_starts(t, stem):
    return [m.start() for m in re.finditer(re.escape(stem), t)]


def py_negated(t, stem, negs, w=4):
    out = []
    for m in re.finditer(re.escape(stem), t):
        ctx = t[max(0, m.start() - w): min(len(t), m.end() + w)]
        out.append(any(n in ctx for n in negs))
    return out


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="abn안x ", max_size=40), st.sampled_from(["ab", "a", "bb", "x a"]))
def test_hit_starts_match_finditer(spark, t, stem):
    df = spark.createDataFrame([(t,)], "t string")
    got = df.select(T.hit_starts(F.col("t"), stem).alias("s"),
                    T.negated_hits(F.col("t"), stem, ["안", "n"]).alias("n")).first()
    assert list(got["s"]) == py_starts(t, stem)
    assert list(got["n"]) == py_negated(t, stem, ["안", "n"])


def test_sentences_and_passages(spark):
    df = spark.createDataFrame([(1, "Park A is nice.  Then rain!\nNo park here? ok"), (2, None)], "id int, t string")
    s = [(r["sent_pos"], r["sentence"]) for r in T.sentences(df, "t", keep="id").orderBy("sent_pos").collect()]
    assert s == [(0, "Park A is nice."), (1, "Then rain!"), (2, "No park here?"), (3, "ok")]
    s5 = [r["sentence"] for r in T.sentences(df, "t", keep="id", min_len=5).collect()]
    assert "ok" not in s5
    p = T.entity_passages(df, "t", ["rain", "zzz"], keep="id", k=1).collect()
    assert [(r["entity"], r["relevant_text"]) for r in p] == [("rain", "Park A is nice. Then rain! No park here?")]


def classify(text, pos, neg, negs):
    t = re.sub(r"\s+", " ", re.sub(r"[^\w\s가-힣!?.,]", " ", re.sub(r"\?{2,}", "?", re.sub(
        r"!{2,}", "!", re.sub(r"(ㅋ|ㅎ){2,}", " ", text.strip().lower()))))).strip()
    stems = lambda ws: [w[:-1] if w.endswith("다") and len(w) >= 2 else w for w in ws]
    if any(s in t for s in stems(neg)):
        return "부정"
    hits = [s for s in stems(pos) if s in t]
    if hits:
        return "부정" if any(any(py_negated(t, s, negs)) for s in hits) else "긍정"
    return "중립"


def test_rule_sentiment_and_summary(spark):
    texts = ["정말 깨끗하고 좋다", "안 깨끗해요", "너무 비싸다", "그냥 그래요", "깨끗함 전혀 문제없음 조용", None]
    df = spark.createDataFrame([("e1" if i < 3 else "e2", t) for i, t in enumerate(texts)], "e string, t string")
    pos, neg = ["깨끗하다", "조용하다"], ["비싸다"]
    out = T.rule_sentiment(df, "t", pos, neg, negators=["안", "전혀"])
    got = [r["sentiment_rule"] for r in out.collect()]
    assert got == [classify(t or "", pos, neg, ["안", "전혀"]) for t in texts]
    summ = {r["e"]: r for r in T.sentiment_summary(out, "e", "t").collect()}
    assert (summ["e1"]["n_docs"], summ["e1"]["n_positive"], summ["e1"]["n_negative"], summ["e2"]["n_docs"]) == (3, 1, 1, 2)


def test_keyword_counts_idf_and_cooccurrence(spark):
    df = spark.createDataFrame([("a", "조용하고 좋은 공원 조용하다"), ("a", "안조용하다 공원"), ("b", "비싸요 주차장")],
                               "e string, t string")
    c = {(r["e"], r["bucket"], r["word"]): r["count"] for r in
         T.keyword_counts(df, "e", "t", ["조용하다"], ["비싸다"], negators=["안"]).collect()}
    assert c == {("a", "pos", "조용하다"): 2, ("a", "neg", "조용하다"): 1, ("b", "neg", "비싸다"): 1}
    counts = T.keyword_counts(df, "e", "t", ["조용하다"], ["비싸다"], negators=["안"])
    top = {r["e"]: (r["top_pos_kw"], r["top_neg_kw"]) for r in T.top_keyword_idf(counts, "e").collect()}
    assert top == {"a": ("조용하다", "조용하다"), "b": ("—", "비싸다")}
    co = {r["e"]: r["co_token"] for r in T.cooccurring_token(
        df, "e", "t", T.top_keyword_idf(counts, "e"), "top_pos_kw").collect()}
    assert co["a"] == "공원" and co["b"] == "—"


def test_tokens_vocabulary_ctfidf(spark):
    df = spark.createDataFrame([(1, "a", "the park park lake"), (2, "a", "lake tree"), (3, "b", "tree tree x")],
                               "d int, c string, t string")
    tk = df.select("d", "c", T.tokens("t", ["the"]).alias("toks"))
    assert tk.filter("d = 1").first()["toks"] == ["park", "park", "lake"]
    rows = T.token_rows(df, "t", keep=["d", "c"], stop=["the"], min_len=1)
    assert sorted(r["term"] for r in rows.filter("d = 1").collect()) == ["lake", "park", "park"]
    assert "x" in [r["term"] for r in rows.collect()]
    rows = T.token_rows(df, "t", keep=["d", "c"], stop=["the"])
    v = {r["term"]: (r["df"], r["tf"], r["tf_rank"]) for r in
         T.vocabulary(rows, "d", "term", min_df=2, max_features=10).collect()}
    assert v == {"tree": (2, 3, 1), "lake": (2, 2, 2)}
    w = {(r["c"], r["term"]): r["weight"] for r in T.class_tfidf(rows, "c", "term", 10).collect()}
    # A = floor(mean words per class) = floor((5 + 2) / 2) = 3; f(park) = 2
    import math
    assert abs(w[("a", "park")] - (2 / 5) * math.log(1 + 3 / 2)) < 1e-12


def test_cosine_score_text_pages(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id int, v array<double>")
    got = {r["id"]: r["similarity"] for r in T.cosine_filter(df, "v", [1.0, 0.0], 0.5).collect()}
    assert set(got) == {1, 3} and abs(got[3] - 2 ** -0.5) < 1e-12

    class Model:
        @staticmethod
        def load():
            return lambda texts: [("LABEL_1" if "good" in t else "LABEL_0", 0.8) for t in texts]

    tx = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, t string")
    sc = {r["id"]: (r["label"], r["positive_prob"]) for r in
          T.score_text(tx, "t", Model, {"LABEL_1": "pos", "LABEL_0": "neg"}, "pos", batch_size=1).collect()}
    assert sc[1] == ("pos", 0.8) and sc[2][0] == "neg" and abs(sc[2][1] - 0.2) < 1e-12
    html = '<html><head><title> T </title><script>x</script></head><body><p>Hi <a href="/a">A</a></p>' \
           '<script>var s="<p>";</script></body></html>'
    pf = T.page_fields(spark.createDataFrame([(html,)], "h string"), "h").first()
    assert pf["title"] == "T" and pf["body_text"] == "Hi A" and pf["links"] == ["/a"]
    rv = T.assemble_review(spark.createDataFrame([("좋아요\n12:30 최고", "#태그"), ("", "x")], "b string, g string"), "b", "g")
    assert [r["review"] for r in rv.collect()] == ["좋아요 최고 #태그"]


def test_topic_tables(spark):
    reps = spark.createDataFrame([(0, "['a', 'b']"), (-1, "['a']"), (1, "['a', 'c']")], "topic int, rep string")
    got = {r["keyword"]: r["count"] for r in T.topic_keywords(reps, "topic", "rep").collect()}
    assert got == {"a": 2, "b": 1, "c": 1}
    j = spark.createDataFrame([(["x", " ", None, "y"],)], "a array<string>").select(T.join_docs("a")).first()[0]
    assert j == "x y"
    docs = spark.createDataFrame([("p", 1)] * 3 + [("q", 2)], "e string, d int")
    assert {r["e"] for r in T.require_min_docs(docs, "e", 3).collect()} == {"p"}


def test_list_text_keeps_items_with_quotes(spark):
    from placerank.functions.text import to_array
    texts = ["""["it's fine", 'b']""", """['say "hi"', 'b']""", "['a', 'b',]", "[]", "[1, 2]", "['broken", "one", None,
             "['it\\'s', 'x']"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.a for r in df.select("i", to_array("t").alias("a")).collect()}
    assert got == {0: ["it's fine", "b"], 1: ['say "hi"', "b"], 2: ["a", "b"], 3: [], 4: ["1", "2"], 5: None, 6: ["one"],
                   7: [], 8: ["it's", "x"]}


def test_vocabulary_counts_documents_without_tokens(spark):
    from placerank.operators.text import token_rows, vocabulary
    docs = spark.createDataFrame([(1, "aa bb"), (2, "aa"), (3, ""), (4, None)], "d int, t string")
    got = vocabulary(token_rows(docs, "t", keep="d"), "d", "term", max_df=0.5, docs=docs).collect()
    assert {r["term"] for r in got} == {"aa", "bb"}


# ------------------------------------------------------------------ many stems in one walk

def finditer_hits(text, stems, w):
    import re
    return sorted((s, text[max(0, m.start() - w):m.end() + w]) for s in stems for m in re.finditer(re.escape(s), text))


def test_stem_hits_equal_finditer_of_each_stem(spark):
    import random
    from placerank.functions.stems import stem_hits
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc안 .") for _ in range(rng.randint(0, 40))) for _ in range(150)]
    texts += ["", None, "aaaaaaa", "a\nb" * 5, "좋아좋아요 안좋다", "😀ab😀c﷐ab", "x" * 5000 + "abc", "$1ab\\1(a.c)"]
    stems = ["a", "ab", "abc", "b", "bca", "aa", "aba", "abab", "안", "좋아", "좋아요", "c.", "(a.c)", "ab\\1", "nowhere"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for w in (0, 1, 4):
        got = {r["i"]: sorted((h["stem"], h["context"]) for h in r["h"]) for r in df.select("i", stem_hits(F.col("t"), stems, w).alias("h")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == finditer_hits((t or "").replace("﷐", "�"), stems, w), (t, w)


def test_prefix_tree_finds_the_longest():
    import re
    from placerank.functions.stems import any_stem, overlaps_itself
    assert any_stem([]) is None
    rx = re.compile(any_stem(["do", "dog", "dot", "d", "cat", "a.b"]))
    assert [m.group() for m in rx.finditer("dogs do dots a.b axb d cat")] == ["dog", "do", "dot", "a.b", "d", "cat"]
    assert [overlaps_itself(x) for x in ("aa", "aba", "ab", "a", "abab", "abc")] == [True, True, False, False, True, False]


def test_150_stems_in_time_of_10(spark):
    """Many stems are one walk: counts equal those stem by stem, and time does not follow their number."""
    import random
    import time
    rng = random.Random(8)
    letters = "abcdefghijklmnop"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(150)]
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(400)) for _ in range(400)]
    df = spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts)], "e int, t string").repartition(4).cache()
    df.count()

    def run(stems):
        best = None
        for _ in range(3):
            t0 = time.perf_counter()
            got = T.keyword_counts(df, "e", "t", stems, [], negators=["zz"]).collect()
            best = min(best or 1e9, time.perf_counter() - t0)
        return best, {(r["e"], r["word"]): r["count"] for r in got}
    few, _ = run(words[:10])
    many, counts = run(words)
    want = {}
    for i, t in enumerate(texts):
        for s in dict.fromkeys(words):
            if n := t.count(s):
                want[i % 3, s] = want.get((i % 3, s), 0) + n
    assert counts == want
    assert many < 4 * few + 1.0, (few, many)
