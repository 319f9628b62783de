"""Text and key Column functions (PR12, PR15–PR18, PR21, PR22, TX1–TX3).

All patterns are written so that Java regex (Spark) and RE2 (the SQL oracle)
read them the same way: explicit Unicode classes instead of ``\\w``, no
look-behind and no back-references.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blog boilerplate phrases removed by the web cleaner (TX1).
BLOG_NOISE = ["© NAVER Corp.", "이웃추가", "공유하기", "광고", "협찬", "체험단",
              "무단 전재", "리그램", "포스팅", "사진첨부"]
# Advertising patterns and ban phrases of the Hangul cleaner (TX2).
AD_PATTERNS = [r"협찬", r"광고", r"서포터즈", r"제공.?받아", r"이웃추가",
               r"좋아요", r"더보기", r"클릭", r"후기입니다"]
BAN_PHRASES = ["좋아요 버튼", "구독", "팔로우", "이벤트 참여"]
# Emoji code-point ranges removed by the web cleaner (TX1).
EMOJI_RANGES = [("1F600", "1F64F"), ("1F300", "1F5FF"), ("1F680", "1F6FF"), ("1F1E0", "1F1FF")]
HANGUL_KEEP = "\uAC00-\uD7A3\u3130-\u318F"

URL_RE = r"https?://[^ \t\n\r\f]+|www\.[^ \t\n\r\f]+"
TAG_RE = r"<[^>]+>"
WS = r"[ \t\n\r\f]"

_SPECIAL = set("\\.^$|?*+()[]{}/-")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def regex_escape(word: str) -> str:
    """Escape a literal for both Java regex and RE2 (backslash before punctuation)."""
    return "".join("\\" + ch if ch in _SPECIAL else ch for ch in word)


def keyword_regex(words: list[str]) -> str:
    """Alternation of literal words, order kept, blanks and repeats dropped."""
    seen = []
    for w in words:
        w = w.strip()
        if w and w not in seen:
            seen.append(w)
    return "|".join(regex_escape(w) for w in seen)


def emoji_class() -> str:
    return "[" + "".join(f"\\x{{{a}}}-\\x{{{b}}}" for a, b in EMOJI_RANGES) + "]+"


# ----------------------------------------------------------------- keys (PR12)

def norm_key(c: Column | str, mode: str = "nospace") -> Column:
    """``nospace``: trim and remove all whitespace; ``lower``: trim + lower;
    ``nobreak``: remove line breaks then trim."""
    c = _c(c).cast("string")
    if mode == "nospace":
        return F.regexp_replace(c, WS + "+", "")
    if mode == "lower":
        return F.lower(F.trim(c))
    if mode == "nobreak":
        return F.trim(F.regexp_replace(c, "[\r\n]+", ""))
    raise ValueError(f"unknown mode {mode}")


def ensure_suffix(c: Column | str, suffix: str) -> Column:
    c = _c(c)
    return F.when(c.isNull() | (c == "") | c.endswith(suffix), c).otherwise(F.concat(c, F.lit(suffix)))


def _map_expr(mapping: dict) -> Column:
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def apply_map(c: Column | str, mapping: dict, keep_unmapped: bool = True) -> Column:
    """Dictionary lookup (typo map, name translation). Unmapped → itself or null."""
    c = _c(c)
    looked = F.try_element_at(_map_expr(mapping), c)
    return F.coalesce(looked, c) if keep_unmapped else looked


# ---------------------------------------------------------- regions (PR15/16)

def extract_region(c: Column | str, pattern: str, group: int = 1) -> Column:
    """First regex group or null when there is no match."""
    out = F.regexp_extract(_c(c), pattern, group)
    return F.when(out != "", out)


def match_dictionary(c: Column | str, keys: list[str], values: list[str] | None = None,
                     strip_suffix: str | None = None, fallback: Column | str | None = None) -> Column:
    """First listed key contained in ``c`` wins; ``fallback`` column is tried next.

    ``strip_suffix`` matches the key without that suffix and returns the stripped
    key, the behaviour of the district matcher that drops ``구``.
    """
    probes = []
    for i, k in enumerate(keys):
        if strip_suffix and k.endswith(strip_suffix):
            k = k[: -len(strip_suffix)]
        probes.append((k, values[i] if values else k))

    def one(col: Column) -> Column:
        out = None
        for k, v in probes:
            cond = F.coalesce(F.instr(col, k) > 0, F.lit(False))
            out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
        return out

    first = one(_c(c))
    return F.coalesce(first, one(_c(fallback))) if fallback is not None else first


def contains_any(c: Column | str, pattern: str) -> Column:
    """Regex search, null → false."""
    return F.coalesce(_c(c).rlike(pattern), F.lit(False))


def prefix_key(c: Column | str, sep: str = "_", default: str | None = None) -> Column:
    """Text before the first ``sep``; when absent the whole text, or ``default``."""
    c = _c(c)
    head = F.substring_index(c, sep, 1)
    otherwise = F.lit(default) if default is not None else c
    return F.when(F.instr(c, sep) > 0, head).otherwise(otherwise)


# possessive groups: matched in a loop, without a stack frame a character
QUOTED_ITEM = r"""'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+\""""
QUOTED_LIST = rf"^\[\s*+(?:{QUOTED_ITEM})(?:\s*+,\s*+(?:{QUOTED_ITEM}))*+\s*+,?\s*+\]$"


def to_array(c: Column | str) -> Column:
    """String list ``"['a', 'b']"`` → array; scalar → [scalar]; null/blank → []. Items may be
    quoted either way and hold the other quote or escapes; unquoted lists are read as JSON,
    and a list that cannot be read is null."""
    s = F.trim(_c(c).cast("string"))
    items = F.transform(F.regexp_extract_all(s, F.lit(QUOTED_ITEM), F.lit(0)),
                        lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1"))
    return (F.when(s.isNull() | (s == "") | (s == "[]"), F.array().cast("array<string>"))
            .when(s.rlike(QUOTED_LIST), items)
            .when(s.startswith("["), F.from_json(s, "array<string>"))
            .otherwise(F.array(s)))


# -------------------------------------------------------------- cleaners (TX1–3)

def squeeze(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(c), WS + "+", " "))


def collapse_repeats(c: Column | str) -> Column:
    """Runs of three or more equal characters → two (``(.)\\1{2,}`` → ``\\1\\1``)."""
    return F.regexp_replace(_c(c), r"(.)\1{2,}", "$1$1")


def clean_web(c: Column | str, noise: list[str] | None = None) -> Column:
    """TX1: tags, URLs, emoji, noise phrases → space; repeats → 2; squeeze."""
    t = F.regexp_replace(_c(c).cast("string"), TAG_RE, " ")
    t = F.regexp_replace(t, URL_RE, " ")
    t = F.regexp_replace(t, emoji_class(), " ")
    for phrase in (BLOG_NOISE if noise is None else noise):
        t = F.replace(t, F.lit(phrase), F.lit(" "))
    t = collapse_repeats(t)
    t = F.regexp_replace(t, "[\r\t]+", " ")
    t = F.regexp_replace(t, WS + "{2,}", " ")
    return F.trim(t)


def clean_hangul(c: Column | str, ads: list[str] | None = None, bans: list[str] | None = None,
                 keep: str = HANGUL_KEEP) -> Column:
    """TX2: drop ad phrases and tags, keep only the ``keep`` class plus ``.,!?``."""
    t = F.regexp_replace(_c(c).cast("string"), "|".join(AD_PATTERNS if ads is None else ads), "")
    t = F.regexp_replace(t, TAG_RE, "")
    t = F.regexp_replace(t, f"[^{keep} \t\n\r\f.,!?]", " ")
    t = squeeze(t)
    for phrase in (BAN_PHRASES if bans is None else bans):
        t = F.replace(t, F.lit(phrase), F.lit(""))
    return t


def normalise_informal(c: Column | str) -> Column:
    """TX3: lower, laughter runs → space, !!→!, ??→?, symbols → space, squeeze."""
    # few passes over the text: what becomes white space goes at once, the runs of it that touch after
    t = F.regexp_replace(F.lower(_c(c).cast("string")), r"[^a-z\p{L}\p{N}_가-힣!?.,]+|[ㅋㅎ]{2,}", " ")
    t = F.regexp_replace(t, r"(?<=!)!+|(?<=\?)\?+", "")
    return F.trim(F.regexp_replace(t, " {2,}", " "))
