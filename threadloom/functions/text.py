"""Text search: words, English stems, weighted postings, web-style queries, match and rank.

A document is a set of postings (term, positions, weight): A for subject, B for name, C for body; the
positions of a later field follow those of the earlier ones. The `simple` configuration takes every
lower-case word; `english` drops stop words and stems.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = r"[\p{L}\p{N}]+"
#: Weights of postings in a rank, by class.
RANK_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
#: Fixed value: pi squared over six, to which 1/n^2 sums up.
ZETA2 = 1.64493406685

# English stop words of common search configurations.
STOP_WORDS = set(
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from "
    "further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our "
    "ours ourselves out over own s same she should so some such t than that the their theirs them themselves then there these they this those through to too under until up very was "
    "we were what when where which while who whom why will with you your yours yourself yourselves".split()
)

# The suffix lists of the published Porter2 algorithm.
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate",
    "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_V, _DOUBLE, _LI = "aeiouy", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"), "cdeghkmnrt"


def _region(word: str, start: int) -> int:
    """Where the region after the first consonant that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in _V and word[i - 1] in _V:
            return i + 1
    return len(word)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-1] not in _V + "wxY" and w[-2] in _V and w[-3] not in _V


def stem(word: str) -> str:
    """The English stem by the published Porter2 (Snowball) algorithm."""
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    w = word.lstrip("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _region(w, 0) if r1 is None else r1
    r2 = _region(w, r1)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _V for c in w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    # 1b
    if w.endswith(("eedly", "eed")):
        cut = 5 if w.endswith("eedly") else 3
        if len(w) - cut >= r1:
            w = w[: len(w) - cut] + "ee"
    else:
        for s in ("ingly", "edly", "ing", "ed"):
            if w.endswith(s):
                head = w[: -len(s)]
                if any(c in _V for c in head):
                    w = head
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(_DOUBLE):
                        w = w[:-1]
                    elif r1 >= len(w) and _short_end(w):
                        w += "e"
                break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # 2
    for s in sorted([*_STEP2, "ogi", "li"], key=len, reverse=True):
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                if s == "ogi":
                    w = w[:-1] if w[-4:-3] == "l" else w
                elif s == "li":
                    w = w[:-2] if w[-3:-2] and w[-3] in _LI else w
                else:
                    w = w[: -len(s)] + _STEP2[s]
            break
    # 3
    for s in sorted([*_STEP3, "ative"], key=len, reverse=True):
        if w.endswith(s):
            if s == "ative":
                w = w[:-5] if len(w) - 5 >= r2 else w
            elif len(w) - len(s) >= r1:
                w = w[: -len(s)] + _STEP3[s]
            break
    # 4
    for s in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


_STEMS: dict[str, str | None] = {}


def lexeme(word: str) -> str | None:
    """The stem of a word, null for a stop word; remembered per worker."""
    if word not in _STEMS:
        if len(_STEMS) > 500_000:  # memory only
            _STEMS.clear()
        _STEMS[word] = None if word in STOP_WORDS else stem(word)
    return _STEMS[word]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(words):
    """Stems at the words' places, null for stop words, so positions stay those of the text."""
    return words.map(lambda ws: None if ws is None else [lexeme(w) for w in ws])


def words_of(text: Column) -> Column:
    """Lower-case words in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORDS})"), 1)


def terms_of(text: Column, config: str = "english") -> Column:
    """Terms at the words' places; null where the configuration drops the word."""
    return _stems(words_of(text)) if config == "english" else words_of(text)


@dataclass(frozen=True)
class Term:
    words: tuple[str, ...]  # one word, or the words of a phrase with None for dropped ones


@dataclass(frozen=True)
class Not:
    of: Term


#: A parsed query: any of these, in each of which all must hold.
Query = list[list[Term | Not]]


def parse_web(text: str, config: str = "english") -> Query:
    """Words must all occur; "..." is a phrase; `or` separates alternatives; - before a word or phrase excludes it."""
    out: Query = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', text):
        if word.lower() == "or" and not minus:
            if out[-1]:
                out.append([])
            continue
        words = [w.lower() for w in re.findall(r"[^\W_]+", phrase or word)]
        terms = tuple(lexeme(w) if config == "english" else w for w in words)
        while terms and terms[0] is None:
            terms = terms[1:]
        while terms and terms[-1] is None:
            terms = terms[:-1]
        if terms:
            out[-1].append(Not(Term(terms)) if minus else Term(terms))
    return [x for x in out if x]


def _has(terms: Column, t: Term) -> Column:
    if len(t.words) == 1:
        return F.coalesce(F.array_contains(terms, t.words[0]), F.lit(False))
    checks = lambda x: [F.coalesce(F.get(terms, x + i) == w, F.lit(False)) for i, w in enumerate(t.words) if w is not None]

    def all_at(x: Column) -> Column:
        cs = checks(x)
        out = cs[0]
        for c in cs[1:]:
            out = out & c
        return out

    # only a text with the first word looks at places
    return F.coalesce(F.array_contains(terms, t.words[0]), F.lit(False)) & F.exists(F.sequence(F.lit(0), F.greatest(F.size(terms) - 1, F.lit(0))), all_at)


def matches(terms: Column, query: Query) -> Column:
    """Does a document (its terms in order, over all fields) satisfy the query? An empty query matches nothing."""
    if not query:
        return F.lit(False)
    out = None
    for alternative in query:
        every = None
        for t in alternative:
            c = ~_has(terms, t.of) if isinstance(t, Not) else _has(terms, t)
            every = c if every is None else every & c
        out = every if out is None else out | every
    return out


def rank_of(places: dict[str, Column], query: Query) -> Column:
    """The cover-free rank of a document: places are arrays of (pos, w: weight) by term, in order of pos.

    With one alternative of several terms, pairs of places count by their distance (beyond 100 words not at
    all); else each term counts by its best weight and by how often it occurs. Distances follow the
    published formulas.
    """
    terms = list(dict.fromkeys(w for a in query for t in a if isinstance(t, Term) for w in t.words if w))
    if not terms:
        return F.lit(0.0)
    if len(query) == 1 and len(terms) >= 2:
        def with_pairs(rest: Column, one: Column, two: Column) -> Column:
            """rest times what is left beside each pair of places."""

            def of_place(acc: Column, x: Column) -> Column:
                def of_pair(left: Column, y: Column) -> Column:
                    d = F.abs(x["pos"] - y["pos"])
                    value = F.sqrt(x["w"] * y["w"] / (1.005 + 0.05 * F.exp(d / 1.5 - 2)))
                    return F.when((d > 0) & (d <= 100), left * (1.0 - value)).otherwise(left)

                return F.aggregate(two, acc, of_pair)

            return F.aggregate(one, rest, of_place)

        rest = F.lit(1.0)
        for i, t in enumerate(terms):
            for s in terms[:i]:
                rest = with_pairs(rest, places[t], places[s])
        return 1.0 - rest
    total = F.lit(0.0)
    for t in terms:
        weights = F.transform(places[t], lambda x: x["w"])
        best = F.array_max(weights)
        series = F.aggregate(F.transform(weights, lambda w, j: w / F.pow(j + 1, F.lit(2))), F.lit(0.0), lambda acc, x: acc + x)
        total = total + F.when(F.size(weights) > 0, (best + series - best / F.pow(F.array_position(weights, best), F.lit(2))) / ZETA2).otherwise(0.0)
    return total / len(terms)


#: Full-width characters that numbers and hashes are written in.
WIDE = ("０１２３４５６７８９＃．＞：ａｂｃｄｅｆＡＢＣＤＥＦ", "0123456789#.>:abcdefABCDEF")


def number_of(c: Column) -> Column:
    """A post number written in any of the usual ways, as a bigint; else null."""
    digits = F.regexp_extract(F.trim(F.translate(c, *WIDE)), r"^(?i)(?:(?:no\.?|>>|#)\s*)?0*(\d{1,18})(?:\.0*)?$", 1)
    return F.when(digits != "", digits).cast("bigint")
