"""Finding many literal stems in a text in one walk (TX9, TX10, TX12).

The stems are laid into a prefix tree, written as one regular expression whose branches share their
beginnings. It is tried at every place of the text by a look-ahead, so stems that overlap are all
found; at a place it gives the longest stem, and those that begin it are known from the list. So a
text is walked once, however many stems there are.

A hit is marked in the text together with the ``w`` characters before it and the text after it, and
the marks are then cut out. No position is needed for the window around a hit, and the work is in
proportion to the text and its hits.

Hits of one stem follow a left-to-right search without overlaps. Only a stem that ends as it begins
("aa", "abab") can overlap itself; such stems are searched one by one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import regex_escape

# Noncharacters that never occur in interchanged text; any found in a text count as U+FFFD.
# A code point beyond the first plane in a pattern makes look-behind count characters, not halves.
_WIDE = "\U0010FFFF{0}"
_OPEN, _CLOSE, _SEP = "\uFDD0", "\uFDD1", "\uFDD2"


def prefix_tree(words: list[str]) -> dict:
    """Nested dictionaries by character; the key ``""`` marks the end of a word."""
    root: dict = {}
    for word in words:
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}
    return root


def tree_regex(node: dict) -> str:
    """Regular expression of a prefix tree that matches the longest word at a place."""
    ends = "" in node
    branches = [regex_escape(ch) + tree_regex(child) for ch, child in sorted(node.items()) if ch]
    if not branches:
        return ""
    body = branches[0] if len(branches) == 1 and not ends else "(?:" + "|".join(branches) + ")"
    return body + "?" if ends else body


def overlaps_itself(word: str) -> bool:
    """Whether a proper beginning of the word is also its end."""
    return any(word.startswith(word[i:]) for i in range(1, len(word)))


def any_stem(words: list[str]) -> str | None:
    """Regular expression that finds any of the words; None without words."""
    words = [x for x in words if x]
    return tree_regex(prefix_tree(words)) if words else None


def _marked(t: Column, find: str, w: int, reach: int, whole: bool, first: str = "") -> Column:
    """Hits as ``before SEP stem SEP from the stem on``: found by look-ahead, or one after the other
    when ``whole`` (the stem is taken away from the text that is left to search). ``first``: the
    characters that a stem may begin with, so that most places are left at once."""
    before = f"(?<=(^.{{0,{w - 1}}}|.{{{w}}}))" if w else "()"
    if whole:
        pattern, put = f"(?s)(?=({find})){before}(?=(.{{0,{reach}}}))(?:{find}){_WIDE}", "$1"
    else:
        pattern, put = f"(?s)(?=[{first}])(?=({find})){before}(?=(.{{0,{reach}}})){_WIDE}", ""
    marked = F.regexp_replace(t, pattern, f"{_OPEN}$2{_SEP}$1{_SEP}$3{_CLOSE}{put}")
    return F.regexp_extract_all(marked, F.lit(f"{_OPEN}([^{_CLOSE}]*){_CLOSE}"), F.lit(1))


def _named(stem: str):
    """Function of a mark that holds this stem."""
    def one(h: Column) -> Column:
        part = F.split(h, _SEP, -1)
        return F.struct(F.lit(stem).alias("stem"), F.concat(part[0], part[2]).alias("context"))
    return one


def stem_hits(t: Column, stems: list[str], w: int) -> Column:
    """array<struct<stem, context>> of all hits of all ``stems`` in ``t``: ``context`` is the text from
    ``w`` characters before the hit to ``w`` after it, cut at the ends of the text. A null text has none."""
    stems = list(dict.fromkeys(s for s in stems if s))
    clean = F.translate(F.coalesce(t, F.lit("")), _OPEN + _CLOSE + _SEP, "\uFFFD" * 3)
    hit = "struct<stem: string, context: string>"
    groups = []
    plain = [s for s in stems if not overlaps_itself(s)]
    if plain:
        within = {s: [p for p in plain if s.startswith(p)] for s in plain}
        known = F.create_map(*[x for s, own in within.items() for x in (F.lit(s), F.array(*map(F.lit, own)))])
        found = _marked(clean, tree_regex(prefix_tree(plain)), w, max(map(len, plain)) + w, False,
                        "".join(sorted({s[0] if s[0].isalnum() else "\\" + s[0] for s in plain})))

        def spread(h: Column) -> Column:
            part = F.split(h, _SEP, -1)
            return F.transform(F.element_at(known, part[1]),
                               lambda s: F.struct(s.alias("stem"), F.concat(part[0], F.left(part[2], F.length(s) + w)).alias("context")))
        groups.append(F.flatten(F.transform(found, spread)))
    for own in filter(overlaps_itself, stems):
        found = _marked(clean, regex_escape(own), w, len(own) + w, True)
        groups.append(F.transform(found, _named(own)))
    return F.concat(*groups) if groups else F.array().cast(f"array<{hit}>")
