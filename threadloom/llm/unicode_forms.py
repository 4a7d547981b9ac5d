"""Problem 8: one consistent form for texts that look the same.

Texts are exploded to positioned pieces: runs of code points that no mapping table has a row for, and
single code points with the marks that follow them. A single code point is joined with its form; one
with marks is exploded again to positioned code points, which are joined with the table of
decompositions, look-alike letters and classes; marks are put in the order of their class, pairs are
recomposed, and the strings are rebuilt by position. All of it is built-in expressions. The tables are
broadcast; their size is fixed by Unicode. Letters with marks are worked out once for all texts; they
are broadcast where they are few (counted first), else both sides are shuffled.

Texts of printable ASCII have no row in any table: they are their own form and are not exploded.
`Canonical` does the same over arrays in Python, for text that is in Python already; tests compare both.

What is made equal: full-width, half-width and other presentation forms; composed and decomposed
accents; invisible characters (removed); kinds of space (one space); letters of other scripts with the
same shape. What is kept apart: case, accents, digits, raised digits, punctuation, line breaks, numbers
of spaces. A joiner between emoji or in scripts whose letters it shapes is visible, and kept.

Defined results: null stays null, an empty text empty. A text without a visible character is never a
case of p8_found; equal texts are none either. Repeated rows of one doc_id count once.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.common import stage
from threadloom.llm.batches import salted

#: Letters of other scripts and the Latin letters of the same shape.
LOOKALIKES = {
    # Cyrillic capitals
    "АВЕЅІЈКМНОРСТХҮԚԜҺ": "ABESIJKMHOPCTXYQWH",
    # Cyrillic small letters
    "аеѕіјорсухһԁԛԝӏ": "aesijopcyxhdqwl",
    # Greek capitals
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    # Greek small letters
    "ονϲϳ": "ovcj",
    # Armenian and Latin letters of other alphabets
    "օսհոɑɡ": "ouhnag",
}
#: Compatibility classes that change only width or presentation.
FORM_TAGS = {"<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>", "<vertical>", "<noBreak>"}
#: Blocks of presentation forms of letters (ligatures), and letters that Unicode calls fillers.
LIGATURES = (0xFB00, 0xFB4F)
FILLERS = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)
JOINERS = (0x200C, 0x200D)
TOP = 0x110000


def _is_invisible(code: int, ch: str) -> bool:
    if ch in "\t\n\x0b\x0c\r\x85":
        return False
    return unicodedata.category(ch) in ("Cf", "Cc") and not 0x600 <= code <= 0x8FF or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in FILLERS


def _decompose(ch: str) -> str:
    """Full decomposition by canonical mappings and by those compatibility mappings that keep the look."""
    d = unicodedata.decomposition(ch)
    if not d:
        if 0xAC00 <= ord(ch) <= 0xD7A3:
            return unicodedata.normalize("NFD", ch)
        return ch
    tag, _, rest = d.partition(" ")
    if tag[0] == "<":
        form = tag in FORM_TAGS or LIGATURES[0] <= ord(ch) <= LIGATURES[1] or tag == "<compat>" and rest == "0020"
        if not form:
            return ch
        d = rest
    return "".join(_decompose(chr(int(x, 16))) for x in d.split())


@functools.cache
def mapping_tables() -> dict[str, np.ndarray]:
    """The tables, made by rule from the Unicode database: code -> codes, code -> class, pair -> code."""
    alike = {a: b for k, v in LOOKALIKES.items() for a, b in zip(k, v)}
    src, count, target, marks, pairs = [], [], [], [], []
    for code in range(TOP):
        ch = chr(code)
        if ccc := unicodedata.combining(ch):
            marks.append((code, ccc))
        if 0xD800 <= code <= 0xDFFF:
            continue
        if _is_invisible(code, ch):
            to = ""
        elif unicodedata.category(ch) == "Zs":
            to = " "
        else:
            to = "".join(alike.get(x, x) for x in _decompose(ch) if not _is_invisible(ord(x), x))
        if to != ch:
            src.append(code)
            count.append(len(to))
            target += map(ord, to)
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", ch) == ch:
            a, b = (ord(alike.get(chr(int(x, 16)), chr(int(x, 16)))) for x in d.split())
            pairs.append((a << 21 | b, code, ord(ch) > 0x24F))
    # of two pairs that look-alike letters made equal, the Latin letter is the consistent result
    best: dict[int, tuple[bool, int]] = {}
    for key, code, other in pairs:
        if key not in best or (other, code) < best[key]:
            best[key] = (other, code)
    keys = np.array(sorted(best), np.int64)
    return {
        "src": np.array(src, np.int32), "count": np.array(count, np.int32), "target": np.array(target, np.int32),
        "marks": np.array(marks, np.int32), "pair": keys, "pair_to": np.array([best[k][1] for k in keys.tolist()], np.int32),
    }


class Canonical:
    """Dense lookup arrays of one worker, and the steps over a batch of texts."""

    def __init__(self, t: dict[str, np.ndarray]):
        self.n_out = np.ones(TOP, np.int8)
        self.n_out[t["src"]] = t["count"]
        self.at = np.zeros(TOP, np.int32)
        self.at[t["src"]] = np.cumsum(t["count"]) - t["count"]
        self.mapped = np.zeros(TOP, bool)
        self.mapped[t["src"]] = True
        self.target = t["target"]
        self.ccc = np.zeros(TOP, np.uint8)
        self.ccc[t["marks"][:, 0]] = t["marks"][:, 1]
        self.pair, self.pair_to = t["pair"], t["pair_to"]
        self.pairs = dict(zip(t["pair"].tolist(), t["pair_to"].tolist()))
        self.second = np.zeros(TOP, bool)
        self.second[t["pair"] & 0x1FFFFF] = True
        self.plain = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")

    def explode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points, and the text that each belongs to; positions are the array's order."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
        return codes, np.repeat(np.arange(len(texts), dtype=np.int32), list(map(len, texts)))

    def join_mappings(self, codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each code point by its row of the mapping tables: none, one or several code points."""
        n = self.n_out[codes].astype(np.int64)
        joiner = np.flatnonzero((codes == JOINERS[0]) | (codes == JOINERS[1]))
        for i in joiner.tolist():  # few
            prev = codes[i - 1] if i and doc[i - 1] == doc[i] else 0
            if prev == 0xFE0F and i > 1 and doc[i - 2] == doc[i]:
                prev = codes[i - 2]
            if 0x1F000 <= prev < 0x20000 or 0x2600 <= prev < 0x27C0 or 0x600 <= prev < 0xE00:
                n[i] = -1
        keep = n < 0
        n[keep] = 1
        out = np.repeat(codes, n)
        use = np.repeat(self.mapped[codes] & ~keep, n)
        if use.any():
            first = np.repeat(np.cumsum(n) - n, n)
            step = np.arange(len(out)) - first
            out[use] = self.target[np.repeat(self.at[codes], n)[use] + step[use]]
        return out, np.repeat(doc, n)

    def order_and_recompose(self, codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marks in the order of their class after each base, then pairs replaced by composed letters."""
        ccc = self.ccc[codes]
        mark = ccc > 0
        drop = np.zeros(len(codes), bool)
        if mark.any():
            same = np.concatenate([[False], doc[1:] == doc[:-1]])
            run = np.flatnonzero(mark[1:] & mark[:-1] & same[1:]) + 1
            done = -1
            for i in run.tolist():  # bases with two marks or more: few
                if i <= done:
                    continue
                a = i - 1
                while a and mark[a] and same[a]:
                    a -= 1
                b = i + 1
                while b < len(codes) and mark[b] and same[b]:
                    b += 1
                done = b - 1
                start = a if mark[a] else a + 1
                codes[start:b] = codes[start:b][np.argsort(ccc[start:b], kind="stable")]
                ccc[start:b] = np.sort(ccc[start:b], kind="stable")
                if start == a:
                    continue
                last, base = 0, int(codes[a])
                for j in range(start, b):
                    to = self.pairs.get(base << 21 | int(codes[j])) if last == 0 or last < ccc[j] else None
                    if to is not None:
                        base, drop[j] = to, True
                    else:
                        last = int(ccc[j])
                codes[a] = base
                mark[start:b] = False  # composed here
            one = np.flatnonzero(mark & same & self.second[codes])
            one = one[one > 0]
            if len(one):
                self._compose(codes, drop, one - 1, one)
        jamo = np.flatnonzero((codes >= 0x1161) & (codes <= 0x11C2))
        for i in jamo.tolist():  # Hangul syllables are composed by arithmetic
            if not i or doc[i] != doc[i - 1]:
                continue
            c = int(codes[i])
            p = i - 1
            while p and drop[p]:
                p -= 1
            b = int(codes[p])
            if c <= 0x1175 and 0x1100 <= b <= 0x1112:
                codes[p], drop[i] = 0xAC00 + ((b - 0x1100) * 21 + c - 0x1161) * 28, True
            elif c >= 0x11A8 and 0xAC00 <= b <= 0xD7A3 and (b - 0xAC00) % 28 == 0:
                codes[p], drop[i] = b + c - 0x11A7, True
        if drop.any():
            return codes[~drop], doc[~drop]
        return codes, doc

    def _compose(self, codes: np.ndarray, drop: np.ndarray, base: np.ndarray, mark: np.ndarray) -> None:
        keys = codes[base].astype(np.int64) << 21 | codes[mark]
        i = np.minimum(np.searchsorted(self.pair, keys), len(self.pair) - 1)
        hit = self.pair[i] == keys
        codes[base[hit]] = self.pair_to[i[hit]]
        drop[mark[hit]] = True

    def rebuild(self, codes: np.ndarray, doc: np.ndarray, n: int) -> list[str]:
        text = codes.astype("<i4").tobytes().decode("utf-32-le", "surrogatepass")
        ends = np.searchsorted(doc, np.arange(n + 1)).tolist()
        return [text[a:b] for a, b in zip(ends, ends[1:])]

    def __call__(self, texts: list[str | None]) -> list[str | None]:
        # a text of printable ASCII has no row in any mapping table: the joins would return it as it is
        todo = [i for i, t in enumerate(texts) if t and not (t.isascii() and not self.plain.search(t))]
        out = list(texts)
        if todo:
            codes, doc = self.order_and_recompose(*self.join_mappings(*self.explode([texts[i] for i in todo])))
            for i, t in zip(todo, self.rebuild(codes, doc, len(todo))):
                out[i] = t
        return out


#: Code points whose joiners are kept: emoji and signs, scripts whose letters a joiner shapes.
_SHAPED = "\\x{1F000}-\\x{1FFFF}\\x{2600}-\\x{27BF}\\x{600}-\\x{DFF}"
#: Noncharacters that stand for kept joiners until the end.
_KEPT = {"\u200c": "\ufdd0", "\u200d": "\ufdd1"}
_PLAIN = r"\t-\r -~"
#: Letters with marks, at some 40 bytes, that are sent to every task; beyond it they are joined by a shuffle.
BROADCAST_CLUSTERS = 500_000


def _class(codes: list[int]) -> str:
    """The inside of a character class of a pattern."""
    out, start, last = [], None, None
    for c in [*sorted(codes), None]:
        if start is not None and (c is None or c != last + 1):
            out.append(f"\\x{{{start:X}}}-\\x{{{last:X}}}" if last > start else f"\\x{{{start:X}}}")
            start = None
        start = c if start is None else start
        last = c
    return "".join(out)


@functools.cache
def _rules() -> dict:
    """The mapping tables as rows, and the classes of code points that the patterns need."""
    t = mapping_tables()
    canon = Canonical(t)
    src = t["src"].tolist()
    ends = np.cumsum(t["count"])
    to = {c: "".join(map(chr, t["target"][e - n : e].tolist())) for c, n, e in zip(src, t["count"].tolist(), ends.tolist())}
    ccc = dict(t["marks"].tolist())
    syllable = lambda c: 0xAC00 <= c <= 0xD7A3
    gone = [c for c in src if not to[c]]
    marks = sorted({*ccc, *(c for c in src if to[c] and ord(to[c][0]) in ccc)} - set(gone))
    kept = [c for c in src if to[c] and c not in set(marks) and not syllable(c)]
    forms = [(chr(c), f) for c, f in zip(kept, canon([chr(c) for c in kept])) if f != chr(c)] + [(b, a) for a, b in _KEPT.items()]
    # syllables are composed of their parts as a whole
    hangul = []
    for lead in range(0x1100, 0x1113):
        for vowel in range(0x1161, 0x1176):
            lv = 0xAC00 + ((lead - 0x1100) * 21 + vowel - 0x1161) * 28
            hangul += [(chr(lead) + chr(vowel), chr(lv))] + [(chr(lead) + chr(vowel) + chr(0x11A7 + x), chr(lv + x)) for x in range(1, 28)] + [(chr(lv) + chr(0x11A7 + x), chr(lv + x)) for x in range(1, 28)]
    codes = {c: to[c] for c in src if to[c] and not syllable(c)} | {c: chr(c) for c in marks if c not in to} | {ord(b): a for a, b in _KEPT.items()}
    return {
        "forms": forms + hangul,
        "codes": [(chr(c), [(x, ccc.get(ord(x), 0)) for x in s]) for c, s in codes.items()],
        "pairs": [(chr(k >> 21) + chr(k & 0x1FFFFF), chr(v)) for k, v in zip(t["pair"].tolist(), t["pair_to"].tolist())],
        "gone": _class(gone), "marks": _class(marks), "active": _class([ord(a) for a, _ in forms] + marks + [*range(0x1100, 0x1200)]),
    }


def _pieces(texts: DataFrame) -> DataFrame:
    """(key, pos, piece) of texts (key, _text): runs without a row in any table, else one code point or syllable and its marks."""
    r = _rules()
    text = F.col("_text")
    for joiner, stand_in in _KEPT.items():
        text = F.when(text.contains(joiner), F.regexp_replace(text, f"{joiner}(?<=[{_SHAPED}]\ufe0f?{joiner})", stand_in)).otherwise(text)
    text = F.regexp_replace(text, f"(?=[^{_PLAIN}])[{r['gone']}]", "")
    hangul = r"[\x{1100}-\x{1112}][\x{1161}-\x{1175}][\x{11A8}-\x{11C2}]?|[\x{AC00}-\x{D7A3}][\x{11A8}-\x{11C2}]"
    pattern = f"[{_PLAIN}]+(?![{r['marks']}])|(?:{hangul})|[^{r['active']}{_PLAIN}\\x{{AC00}}-\\x{{D7A3}}]+(?![{r['marks']}])|(?s:.)[{r['marks']}]*"
    return texts.select("key", F.posexplode(F.regexp_extract_all(text, F.lit(pattern), 0)).alias("pos", "piece"))


def _marked() -> Column:
    return F.right("piece", F.lit(1)).rlike(f"(?=[^{_PLAIN}])[{_rules()['marks']}]")


def _clusters(pieces: DataFrame) -> DataFrame:
    """(piece, form) of the different pieces with marks: positioned code points, joined, ordered, recomposed, rebuilt."""
    spark, r = pieces.sparkSession, _rules()
    codes = spark.createDataFrame(r["codes"], "code string, to array<struct<c: string, k: int>>")
    points = pieces.where(_marked()).select("piece").distinct().select("piece", F.posexplode(F.regexp_extract_all("piece", F.lit("(?s:.)"), 0)).alias("i", "code"))
    points = points.join(F.broadcast(codes), "code", "left")
    points = points.select("piece", "i", F.posexplode(F.coalesce("to", F.array(F.struct(F.col("code").alias("c"), F.lit(0).alias("k"))))).alias("j", "p")).select("piece", "i", "j", "p.c", "p.k")
    base = F.sum((F.col("k") == 0).cast("int")).over(Window.partitionBy("piece").orderBy("i", "j"))
    letters = points.withColumn("base", base).groupBy("piece", "base").agg(F.array_sort(F.collect_list(F.struct("k", "i", "j", "c"))).alias("m"))
    pairs = F.create_map(*[F.lit(x) for kv in r["pairs"] for x in kv])
    start = F.struct(F.col("m")[0]["c"].alias("base"), F.lit(0).alias("last"), F.array().cast("array<string>").alias("rest"))

    def step(acc: Column, m: Column) -> Column:
        to = pairs[F.concat(acc["base"], m["c"])]
        joins = to.isNotNull() & ((acc["last"] == 0) | (acc["last"] < m["k"]))
        keep = F.struct(acc["base"].alias("base"), m["k"].alias("last"), F.concat(acc["rest"], F.array(m["c"])).alias("rest"))
        return F.when(joins, F.struct(to.alias("base"), acc["last"].alias("last"), acc["rest"].alias("rest"))).otherwise(keep)

    # marks without a letter before them stay as they are, in order
    whole = F.aggregate(F.slice("m", 2, F.size("m")), start, step, lambda acc: F.concat(acc["base"], F.array_join(acc["rest"], "")))
    plain = F.array_join(F.transform("m", lambda x: x["c"]), "")
    letters = letters.select("piece", "base", F.when(F.col("base") > 0, whole).otherwise(plain).alias("s"))
    return letters.groupBy("piece").agg(_joined("base", "s").alias("form"))


def _joined(at: str, s: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, s))), lambda x: x[s]), "")


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _is_plain() -> Column:
    return ~F.coalesce(F.col("_text").rlike(f"[^{_PLAIN}]"), F.lit(False))


def forms_of(docs: DataFrame) -> DataFrame:
    """(key, text_norm) of the different texts (_text) that are not printable ASCII; key is a digest of the text as it is."""
    texts = docs.where(~_is_plain()).groupBy(_key(F.col("_text")).alias("key")).agg(F.first("_text").alias("_text"))
    pieces = _pieces(texts)
    clusters = stage(_clusters(pieces), "p8-clusters")
    known = F.broadcast(docs.sparkSession.createDataFrame(_rules()["forms"], "piece string, form string"))
    if clusters.count() <= BROADCAST_CLUSTERS:
        marked = F.broadcast(clusters.withColumnRenamed("form", "marked"))
        whole = pieces.join(known, "piece", "left").join(marked, "piece", "left").select("key", "pos", F.coalesce("marked", "form", "piece").alias("s"))
    else:
        single = pieces.where(~_marked()).join(known, "piece", "left").select("key", "pos", F.coalesce("form", "piece").alias("s"))
        whole = single.unionByName(pieces.where(_marked()).join(clusters, "piece").select("key", "pos", F.col("form").alias("s")))
    rebuilt = whole.groupBy("key").agg(_joined("pos", "s").alias("text_norm"))
    # a text of invisible characters only has no piece
    return texts.select("key").join(rebuilt, "key", "left").select("key", F.coalesce("text_norm", F.lit("")).alias("text_norm"))


def canonical_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(id, text_norm); with digests (id, look, raw): 128-bit digests of the form and of the text as it is, null for texts without a visible character."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    # texts are read again for the result, so that only digests and forms are shuffled
    forms = forms_of(rows)
    if digests:
        form = lambda c: F.when(~F.col(c).rlike(r"^[\s\x{85}\x{2028}\x{2029}]*$"), _key(F.col(c)))
        same = rows.where(_is_plain()).select("_id", form("_text").alias("look"), form("_text").alias("raw"))
        looks = forms.select("key", form("text_norm").alias("look"))
        other = rows.where(~_is_plain()).select("_id", _key(F.col("_text")).alias("key")).join(looks, "key")
        out = same.unionByName(other.select("_id", "look", F.when(F.col("look").isNotNull(), F.col("key")).alias("raw")))
        return out.withColumnRenamed("_id", id_col)
    same = rows.where(_is_plain()).select("_id", F.col("_text").alias("text_norm"))
    other = rows.where(~_is_plain()).select("_id", _key(F.col("_text")).alias("key")).join(forms, "key").select("_id", "text_norm")
    return same.unionByName(other).withColumnRenamed("_id", id_col)


def lookalike_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs of documents whose texts look the same and differ in characters.

    Groups are joined by digest, first as classes of equal texts, so copies of one text never meet
    each other; only groups with two different texts or more go on. Groups of many documents are salted.
    """
    seen = stage(canonical_text(docs, id_col, text_col, digests=True).where("look is not null"), "p8-digests")
    classes = seen.groupBy("look", "raw").agg(F.lit(1).alias("one"))
    mixed = classes.groupBy("look").agg(F.count("*").alias("n")).where("n > 1").select("look")
    members = seen.join(mixed, "look", "left_semi").select("look", "raw", F.col(id_col).alias("id")).distinct()
    a, b = salted(members, "look", ["raw", "id"])
    pairs = a.join(b, ["look", "salt"]).where("raw_a < raw_b and id_a <> id_b")
    return pairs.select(F.least("id_a", "id_b").alias(f"{id_col}_a"), F.greatest("id_a", "id_b").alias(f"{id_col}_b")).distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id_a < doc_id_b of texts that look the same and are not the same characters."""
    return lookalike_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def p8_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text in the one consistent form."""
    return canonical_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def p8_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, is_null, kept (printable ASCII comes out as it was), again (the form of the form is the form) of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    once = stage(canonical_text(docs), "p8-once")
    twice = canonical_text(once, text_col="text_norm").withColumnRenamed("text_norm", "twice")
    rows = docs.join(once, "doc_id").join(twice, "doc_id")
    return rows.select("doc_id", F.col("text_norm").isNull().alias("is_null"), (F.coalesce(F.col("text").rlike(f"[^{_PLAIN}]"), F.lit(True)) | (F.col("text") == F.col("text_norm"))).alias("kept"), F.col("twice").eqNullSafe(F.col("text_norm")).alias("again"))


SQL = {"p8_stable": "SELECT doc_id, text IS NULL AS is_null, true AS kept, true AS again FROM documents"}
