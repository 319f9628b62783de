import math
import random
import re

import pytest
from pyspark.sql import functions as F

from placerank.functions import (clip, contains_any, ensure_suffix, extract_region, match_dictionary,
                                 norm_key, normal_cdf, prefix_key, row_mean, row_weighted_mean, safe_float,
                                 step_score, to_array, to_bool, to_number, tri_state, zero_to_null)
from placerank.functions.text import clean_web, collapse_repeats, normalise_informal


def one(spark, expr, data, schema="x string"):
    return [r[0] for r in spark.createDataFrame(data, schema).select(expr.alias("o")).collect()]


def test_to_number_variants(spark):
    data = [("1,234",), ("-",), (None,), ("abc",), (" 7 ",)]
    assert one(spark, to_number("x"), data) == [None, None, None, None, 7.0]
    assert one(spark, to_number("x", strip=",", dash_zero=True, fill=0.0), data) == [1234.0, 0.0, 0.0, 0.0, 7.0]


def test_bools(spark):
    data = [("Yes",), ("가능",), (None,), ("no",), ("enabled",), ("maybe",)]
    assert one(spark, to_bool("x"), data) == [True, True, False, False, True, False]
    assert one(spark, tri_state("x"), data) == [True, None, None, False, None, None]


def test_zero_clip_step(spark):
    data = [(0.0,), (3.0,), (None,), (150.0,), (-2.0,)]
    assert one(spark, zero_to_null("x"), data, "x double") == [None, 3.0, None, 150.0, -2.0]
    assert one(spark, clip("x", 0.0, 100.0), data, "x double") == [0.0, 3.0, None, 100.0, 0.0]
    pts = one(spark, step_score("x", [(3, 100), (2, 70), (1, 40)]), data, "x double")
    assert pts == [0.0, 100.0, 0.0, 100.0, 0.0]
    assert one(spark, safe_float("x"), [(" ",), ("2.5",), ("x",)]) == [None, 2.5, None]


def test_normal_cdf_matches_erfc(spark):
    xs = [i / 8.0 for i in range(-80, 81)] + [-37.5, 40.0, 7.0710678, -7.0710678]
    got = one(spark, normal_cdf("x"), [(x,) for x in xs], "x double")
    for x, g in zip(xs, got):
        assert abs(g - 0.5 * math.erfc(-x / math.sqrt(2))) < 1e-14
    assert one(spark, normal_cdf("x"), [(None,)], "x double") == [None]


def test_row_means(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None), (2.0, 4.0, None)], "a double, b double, c double")
    assert [r[0] for r in df.select(row_mean(["a", "b", "c"])).collect()] == [2.0, None, 3.0]
    w = [r[0] for r in df.select(row_weighted_mean({"a": 0.6, "b": 0.3, "c": 0.1})).collect()]
    assert w[1] is None
    assert abs(w[0] - (0.6 * 1 + 0.1 * 3) / 0.7) < 1e-12
    assert abs(w[2] - (0.6 * 2 + 0.3 * 4) / 0.9) < 1e-12


def test_keys(spark):
    data = [("  a b \n",), (None,)]
    assert one(spark, norm_key("x", "nospace"), data) == ["ab", None]
    assert one(spark, norm_key("x", "lower"), [(" AB ",)]) == ["ab"]
    assert one(spark, ensure_suffix("x", "구"), [("강남",), ("강남구",), ("",), (None,)]) == ["강남구", "강남구", "", None]
    assert one(spark, prefix_key("x", "_", "미상"), [("강북_공원",), ("공원",)]) == ["강북", "미상"]
    assert one(spark, prefix_key("x", "_"), [("강북_공원",), ("공원",)]) == ["강북", "공원"]


def test_region_and_dictionary(spark):
    data = [("서울특별시 강남구 역삼동",), ("부산",)]
    assert one(spark, extract_region("x", r"서울특별시\s*([가-힣]+구)"), data) == ["강남구", None]
    # the district matcher without its suffix: 중구 → 중, 구로구 → 구로 ... first listed key wins
    keys = ["중구", "구로구", "강남구"]
    got = one(spark, match_dictionary("x", keys, strip_suffix="구"), [("구로동 소방서",), ("중앙 센터",), ("역삼",)])
    assert got == ["구로", "중", None]
    fb = one(spark, match_dictionary("x", ["a", "b"], fallback=F.lit("zzb")), [("xa",), ("q",)])
    assert fb == ["a", "b"]
    assert one(spark, contains_any("x", "맛집|식당"), [("동네 맛집",), (None,), ("카페",)]) == [True, False, False]


def test_to_array(spark):
    got = one(spark, to_array("x"), [("['a', 'b']",), ("c",), (None,), ("",), ("[]",)])
    assert got == [["a", "b"], ["c"], [], [], []]


def test_cleaners(spark):
    assert one(spark, collapse_repeats("x"), [("ㅋㅋㅋㅋ 좋아아아",)]) == ["ㅋㅋ 좋아아"]
    web = one(spark, clean_web("x"), [("<b>hi</b> http://x.y/z 😀 광고 sooo   good\tday",)])
    assert web == ["hi soo good day"]
    inf = one(spark, normalise_informal("x"), [("  WOW!!! 진짜ㅋㅋㅋ 좋아?? #태그 ",)])
    assert inf == ["wow! 진짜 좋아? 태그"]


def test_informal_in_few_passes(spark):
    """The passes of the definition, one after the other, give the same text; long runs are safe."""
    def plain(x):
        x = re.sub("(ㅋ|ㅎ){2,}", " ", x.lower().strip(" "))
        x = re.sub(r"\?{2,}", "?", re.sub("!{2,}", "!", x))
        x = re.sub(r"[^\w \t\n\r\f!?.,]", " ", x)
        return re.sub("[ \t\n\r\f]+", " ", x).strip(" ")
    rng = random.Random(8)
    texts = ["".join(rng.choice("aB1ㅋㅎㅋ좋é!!??#~ \t\n\x0b 😀_.,") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    texts += ["", "ㅋ#ㅋ", "!#!", "#" * 20000 + "a" + " " * 20000, "ㅋ" * 20000 + "b" + "!" * 20000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    got = {r[0]: r[1] for r in rows.select("i", normalise_informal("x")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
