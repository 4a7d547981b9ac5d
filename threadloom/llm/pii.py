"""Problem 5: personal information in free text, and its replacement by keyed surrogates.

Detection finds mail addresses (also disguised), phone numbers, identity numbers said to be such, street
addresses and full names. Names come from a table of given and family names and from the parts those
are made of: the table is incomplete, so a word also counts as a name if its beginning and its ending
each occur in several names of the table.

Replacement: every entity gets a surrogate made from a keyed digest of its canonical form, so one entity
has one surrogate wherever and however it is written (coreference), of the same type, and with the
writing kept: case, script, digits and separators, disguise, and for a given name the gender that its
ending tells (`gender_of`; the table of names has none). Nothing of the entity stays but what says its
kind: country code and kind of a phone number; street word, direction and unit word of an address; title
of a name. No digit and no letter of a number or initial is drawn again. Surrogates of different entities
are compared over the whole corpus; where two agree, all but the first draw again until every one is
distinct; after WIDEN draws they get longer, so this ends however many entities share a format. But for
such collisions a surrogate depends on key and entity only. Texts come out as `[type surrogate]` in place
of the entity with all else unchanged.

Defined results: null stays null and empty stays empty. A full name inside a mail address or an address
is part of it and no person_name. Repeated rows of a post give one row each in p5_redacted, and one row
together in p5_found.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.common import stage
from threadloom.llm.batches import parts

FIELDS = ("body", "email", "name")
TYPES = ("email", "phone", "id_number", "street_address", "person_name")

# Words and writings that the patterns look for.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
STREET_WORDS = "street|st|road|rd|lane|ln|avenue|ave|close|drive|dr|way|court|ct|terrace|place|pl|square|sq|crescent|row|walk|gardens|boulevard|blvd|grove|hill|parade|mews"
DIRECTIONS = "north|south|east|west|upper|lower|old|new|great|little"
ID_WORDS = (
    r"social(?:\s+security)?(?:\s+(?:number|no\.?|num))?|ssn|tax\s+(?:id|number|no\.?|file\s+number)|tin|itin|passport(?:\s+(?:number|no\.?|num|id))?"
    r"|driv(?:er|ing)(?:'|’|&#39;|&#x27;|&apos;)?s?\s+licen[cs]e(?:\s+(?:number|no\.?))?|licen[cs]e\s+(?:number|no\.?)|national\s+(?:id(?:entity)?|insurance)(?:\s+card)?(?:\s+(?:number|no\.?))?"
    r"|(?:personal\s+)?identity\s+(?:number|no\.?|card)(?:\s+(?:number|no\.?))?|personal\s+(?:id|number)(?:\s+(?:number|no\.?))?|id\s+card(?:\s+(?:number|no\.?))?|nino|identification\s+number"
)
_STREET_SET, _DIRECTION_SET = set(STREET_WORDS.split("|")), set(DIRECTIONS.split("|"))
#: Words before a number that say it is something else.
OTHER_NUMBERS = r"serial|part|invoice|build|ticket|unix|time|order|version|post|item|model|batch|sku|ref|reference|issue|bug|commit|isbn|rev|revision|tracking|id"
PHONE_WORDS = r"tel|phone|mobile|cell|call|text|ring|ringing|number|reach|under|owns|sms|whatsapp|fax"

_AT = r"(?:\s*[@＠]\s*|&#64;|&#x40;|&commat;|\s*[\[({<]\s*at\s*[\])}>]\s*)"
_DOT = r"(?:\.|\s*[\[({<]\s*dot\s*[\])}>]\s*|\s+dot\s+)"
_HOST = rf"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:{_DOT}[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*{_DOT}[a-z]{{2,24}}"
_LOCAL = r"[a-z0-9_%+-]+(?:(?:\.|\s+dot\s+|\s*[\[({]\s*dot\s*[\])}]\s*)[a-z0-9_%+-]+)*"
EMAIL = re.compile(rf"(?<![\w.+-])({_LOCAL})(?:{_AT}({_HOST})|\s+at\s+([a-z0-9-]+(?:\s+dot\s+[a-z0-9-]+)*\s+dot\s+[a-z]{{2,24}})(?!\s+(?:at|dot)\s))(?![\w@])", re.I)
#: What a text (in lower case) with a mail address holds at least one of.
_EMAIL_HINTS = ("@", "＠", "&#64;", "&#x40;", "&commat;", "dot", "at]", "at)", "at}", "at>")
_EMAIL_BRACKET = re.compile(r"[\[({<]\s*at\s+[\])}>]")

_NUMBER = re.compile(r"(?<![\w/#.>-])(?:\+|\(\+?)?\d[\d\-. ()/]{5,22}\d(?![\w-]|\.\d)")
_SPELLED = re.compile(rf"(?<![\w/#.>-])\+?\d*(?:[ \-.]*(?:\d+|{'|'.join(DIGIT_WORDS)})\b)+", re.I)
_SPELLED_HINT = re.compile(rf"\b(?:{'|'.join(DIGIT_WORDS)})[ -](?:{'|'.join(DIGIT_WORDS)})\b")
PHONE_FORMS = re.compile(
    r"(?:"
    r"(?:\+|00)44[ .-]?(?:\(0\)[ .-]?)?(?:\d[ .-]?){9}\d"  # United Kingdom, with country
    r"|0[1-9]\d{2,4}[ .-]?\d{3,4}[ .-]?\d{2,4}|02\d[ .-]?\d{4}[ .-]?\d{4}"  # United Kingdom, within the country
    r"|(?:\+|00)?1[ .-]?\(?[2-9]\d{2}\)?[ .-]?[2-9]\d{2}[ .-]?\d{4}"  # North America, with country
    r"|\([2-9]\d{2}\)[ .-]?[2-9]\d{2}[ .-]?\d{4}|[2-9]\d{2}[.-][2-9]\d{2}[.-]\d{4}"  # North America
    r"|(?:\+|00)[2-9]\d{1,2}[ .-]?(?:\(0\)[ .-]?)?\d(?:[ .-]?\d){6,11}"  # other countries
    r")"
)
PHONE_LOOSE = re.compile(r"[2-9]\d{2} ?[2-9]\d{2} ?\d{4}")
_OTHER = re.compile(rf"\b(?:{OTHER_NUMBERS})\b[\s:=#.]*(?:(?:is|was|number|no\.?|num|id|code)[\s:=#.]*)*$", re.I)
_PHONEISH = re.compile(rf"\b(?:{PHONE_WORDS})\b[^\d]{{0,20}}$", re.I)

ID_NUMBER = re.compile(rf"(?<![a-z])(?:{ID_WORDS})(?:\s*(?:is|was|:|=|#|-)\s*|\s+)+((?:[a-z]{{1,3}}[ -]?)?\d(?:[\d\-+ .]*\d)?(?:[ -]?[a-z](?![a-z]))?)", re.I)
#: What a text (in lower case) that speaks of an identity number holds at least one of.
_ID_HINTS = ("ssn", "social", "tax", "tin", "passport", "licen", "national", "identi", "personal", "id card", "nino")

STREET = re.compile(
    rf"(?<![\w.#/&;-])(?:(?:flat|apt|apartment|unit|suite)\.? ?#?\d+[a-z]?,? )?(\d{{1,5}}[a-z]?),? ((?:(?:{DIRECTIONS})\.? )?)([a-z][a-z'’-]+(?: [a-z][a-z'’-]+)?) (?:(?:st|rd|ln|ave|dr|ct|pl|sq|blvd)\b\.?|(?:{STREET_WORDS})\b)(?:,? (?:#|apt\.? ?|flat ?|unit ?|suite ?)\d+[a-z]?)?",
    re.I,
)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


class NameParts:
    """Which words are given or family names: the table's, and those made of its names' parts."""

    LEAST = 3

    def __init__(self, names: list[tuple[str | None, str | None]]):
        known = {kind: {n.strip().lower() for n, t in names if n and n.strip() and (t or kind).strip().lower() == kind} for kind in ("given", "family")}
        self.given = self._Known(known["given"])
        self.family = self._Known(known["family"])

    class _Known(dict):
        """word -> bool, remembered."""

        def __init__(self, known: set[str]):
            super().__init__()
            self.known = known
            heads, tails = Counter(), Counter()
            for n in known:
                for i in range(2, len(n) - 1):
                    heads[n[:i]] += 1
                    tails[n[i:]] += 1
            self.heads = {h for h, k in heads.items() if k >= NameParts.LEAST}
            self.tails = {t for t, k in tails.items() if k >= max(NameParts.LEAST, len(known) // 60)}

        def __missing__(self, word: str) -> bool:
            yes = word in self.known or 5 <= len(word) <= 16 and any(word[:i] in self.heads and word[i:] in self.tails for i in range(2, len(word) - 1))
            if len(self) < 1_000_000:
                self[word] = yes
            return yes


class Detector:
    """Finds entities in one text: (start, end, type, canonical form)."""

    def __init__(self, names: list[tuple[str | None, str | None]]):
        self.parts = NameParts(names)
        title = r"(?:(?:dr|mr|mrs|ms|prof)\.? )?"
        word = r"[^\W\d_]{2,}"
        self.name_forms = [
            re.compile(rf"(?<![\w.@/+-]){title}({word}|[^\W\d_]\.) ((?:[^\W\d_]\.? )*)({word}(?:-{word})?)(?![\w@＠]|[.+-]\w)", re.I),
            re.compile(rf"(?<![\w.@/+-])({word}(?:-{word})?), ?()({word}|[^\W\d_]\.)(?![\w@＠]|[.+-]\w)", re.I),
        ]

    def __call__(self, text: str | None) -> list[tuple[int, int, str, str]]:
        if not text:
            return []
        found: list[tuple[int, int, str, str]] = []

        def free(a: int, b: int) -> bool:
            return all(b <= x or y <= a for x, y, _, _ in found)

        low = text.lower()
        if any(h in low for h in _EMAIL_HINTS) or _EMAIL_BRACKET.search(low):
            for m in EMAIL.finditer(text):
                found.append((m.start(), m.end(), "email", self.email_form(m)))
        digits = any(c in text for c in "0123456789")
        if digits:
            if any(h in low for h in _ID_HINTS):
                for m in ID_NUMBER.finditer(text):
                    n = re.sub(r"[^0-9a-z]", "", m[1].lower())
                    if sum(c.isdigit() for c in n) >= 6 and free(*m.span(1)):
                        found.append((*m.span(1), "id_number", n))
            for m in STREET.finditer(text):
                if self.is_street(m) and free(*m.span()):
                    found.append((*m.span(), "street_address", " ".join(re.findall(r"\w+", m[0].lower()))))
            for m in _NUMBER.finditer(text):
                a, b = m.span()
                p = PHONE_FORMS.fullmatch(m[0])
                if not p and (q := PHONE_LOOSE.fullmatch(m[0])) and _PHONEISH.search(text, max(0, a - 40), a):
                    p = q
                if not p and (p := PHONE_FORMS.match(m[0])) and (p.end() == len(m[0]) or m[0][p.end()].isdigit() or re.match(r"[\-.]\d", m[0][p.end() :])):
                    p = None
                if p and free(a, a + p.end()) and not _OTHER.search(text, max(0, a - 40), a):
                    found.append((a, a + p.end(), "phone", self.phone_form(p[0])))
        if _SPELLED_HINT.search(low):
            for m in _SPELLED.finditer(text):
                n = self.phone_form(m[0])
                if 7 <= len(n) <= 12 and re.search("[a-z]", m[0], re.I) and free(*m.span()):
                    lead = len(m[0]) - len(m[0].lstrip(" -."))
                    found.append((m.start() + lead, m.end(), "phone", n))
        is_family = self.parts.family.__getitem__
        if any(map(is_family, set(_WORD.findall(low)))):
            for order, form in enumerate(self.name_forms):
                at = 0
                while m := form.search(text, at):
                    given, family = (m[1], m[3]) if order == 0 else (m[3], m[1])
                    initial = given.endswith(".") or len(given) == 1
                    parts = family.lower().split("-")
                    yes = all(map(is_family, parts)) and (initial or self.parts.given[given.lower()])
                    # two words in small letters that are only made of name parts may be any words
                    if yes and not (given[:1].isupper() and family[:1].isupper()):
                        yes = given.lower() in self.parts.given.known or any(p in self.parts.family.known for p in parts)
                    if yes and free(*m.span()):
                        found.append((*m.span(), "person_name", f"{given.strip('.').lower()} {family.lower()}"))
                        at = m.end()
                    else:
                        at = m.end(1) if m.end(1) > at else m.end()
        return sorted(found)

    def is_street(self, m: re.Match) -> bool:
        """A house number before a proper street name: known names, or capitalised words before a capitalised street word; not a count of things."""
        name = m[3]
        words = name.lower().split(" ")
        if all(map(self.parts.family.__getitem__, words)):
            return True
        kind = re.search(rf"({STREET_WORDS})\b\.?", m[0][m.end(3) - m.start() :], re.I)
        if not (all(w[0].isupper() for w in name.split(" ")) and kind[1][0].isupper()) or words[0] in COUNTED:
            return False
        # a title or a saint before a name is no street word
        return kind[1].lower() not in ("dr", "st") or not re.match(r" [A-Z]", m.string[m.end() :])

    @staticmethod
    def email_form(m: re.Match) -> str:
        plain = re.sub(r"\s*[\[({<]\s*dot\s*[\])}>]\s*|\s+dot\s+", ".", f"{m[1]}@{m[2] or m[3]}", flags=re.I)
        return re.sub(r"\s", "", plain).lower()

    @staticmethod
    def phone_form(text: str) -> str:
        text = re.sub("|".join(DIGIT_WORDS), lambda w: DIGIT_WORDS[w[0].lower()], text, flags=re.I)
        n = re.sub(r"\D", "", text.replace("(0)", ""))
        n = re.sub(r"^(?:00|0)(?=44\d{10}$)", "", n)
        if re.fullmatch(r"44\d{10}", n):
            return "0" + n[2:]
        return n[1:] if re.fullmatch(r"1[2-9]\d{9}", n) else n


#: Endings of given names that mostly women have; any other ending counts as one of a man.
FEMALE_ENDINGS = ("a", "e", "ie", "ine", "elle", "een", "wen", "lyn", "beth", "а", "я")
#: Parts of made-up words by script: onsets, vowels, codas, endings of women's and of men's given names.
SYLLABLES = {
    "latin": ("b c d f g h j k l m n p r s t v w".split(), "a e i o u".split(), "l n r s t m".split(), ("ia", "ina", "elle"), ("o", "an", "us")),
    "cyrillic": ("б в г д ж з к л м н п р с т ф х ц".split(), "а е и о у".split(), "л н р с т м".split(), ("ия", "ина", "ела"), ("ор", "ан", "ус")),
    "greek": ("β γ δ ζ θ κ λ μ ν ξ π ρ σ τ φ χ ψ".split(), "α ε ι ο υ".split(), "λ ν ρ ς ν ς".split(), ("ία", "ινα", "ελη"), ("ος", "ης", "ας")),
}
#: Words after a number that counts things.
COUNTED = set("seconds minutes hours days weeks months years times people men women kids posts threads pages photos files pieces items dollars euros pounds miles feet metres more other".split())
UNIT_WORDS = {"flat", "apt", "apartment", "unit", "suite"}
TITLE = re.compile(r"(?:dr|mr|mrs|ms|prof)\.? ", re.I)
#: Draws of one length before surrogates get longer.
WIDEN = 16


def script_of(word: str) -> str:
    c = word[:1].lower()
    return "cyrillic" if "\u0400" <= c <= "\u052f" else "greek" if "\u0370" <= c <= "\u03ff" else "latin"


def gender_of(given: str) -> str:
    return "f" if given.lower().endswith(FEMALE_ENDINGS) else "m"


class Surrogates:
    """Keyed surrogates. `draw` counts how often the entity had to draw again."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("surrogates need a key")
        self.key = key

    def numbers(self, kind: str, form: str, draw: int) -> Iterator[int]:
        block = 0
        while True:
            yield from hmac.new(self.key, f"{kind}\0{form}\0{draw}\0{block}".encode(), hashlib.sha256).digest()
            block += 1

    @staticmethod
    def other(rnd: Iterator[int], old: str, among: str) -> str:
        """One of the characters that is not the old one."""
        among = among.replace(old, "")
        return among[next(rnd) % len(among)]

    def other_char(self, rnd: Iterator[int], c: str) -> str:
        if c.isdigit():
            return self.other(rnd, c, "0123456789" if c == "0" else "123456789")
        return self.other(rnd, c, "".join(SYLLABLES[script_of(c)][0]))

    def word(self, rnd: Iterator[int], syllables: int, old: str = "") -> str:
        onsets, vowels, codas, *_ = SYLLABLES[script_of(old)]
        while True:
            new = "".join(onsets[next(rnd) % 17] + vowels[next(rnd) % 5] for _ in range(syllables)) + codas[next(rnd) % 6]
            if new != old:
                return new

    def plain(self, kind: str, form: str, draw: int) -> str:
        """The surrogate in its canonical form: what must be distinct over the corpus."""
        rnd, more = self.numbers(kind, form, draw), draw // WIDEN
        if kind == "phone":
            # what says country and kind stays: 0 and the digit after it, or a country code; area codes of ten digits do not
            keep = 0 if len(form) == 10 and form[0] in "23456789" or len(form) < 9 else 2
            new = "".join(c if i < keep else self.other(rnd, c, "23456789" if not keep and len(form) == 10 and i in (0, 3) else "0123456789") for i, c in enumerate(form))
            return new + "".join(str(next(rnd) % 10) for _ in range(more))
        if kind == "id_number":
            return "".join(self.other_char(rnd, c) for c in form) + "".join(str(next(rnd) % 10) for _ in range(more))
        if kind == "email":
            return f"{self.word(rnd, 3 + more)}{next(rnd) * 256 + next(rnd)}@{self.word(rnd, 2)}.example"
        if kind == "street_address":
            words = form.split()
            kept = self.kept_of_address(words)
            return " ".join(w if i in kept else self.word(rnd, 3 + more, w) if w.isalpha() and len(w) > 1 else "".join(self.other_char(rnd, c) if c.isalnum() else c for c in w) for i, w in enumerate(words))
        given, _, family = form.partition(" ")
        if len(given) == 1:
            first = self.other_char(rnd, given)
        else:
            endings = SYLLABLES[script_of(given)][3 if gender_of(given) == "f" else 4]
            first = self.word(rnd, 2, given)[:-1] + SYLLABLES[script_of(given)][2][next(rnd) % 6] + endings[next(rnd) % 3]
        return f"{first} {'-'.join(self.word(rnd, 3 + more, w) for w in family.split('-'))}"

    @staticmethod
    def kept_of_address(words: list[str]) -> set[int]:
        """Places of the words that stay: the street word (the last one), a direction before a name, unit words."""
        types = [i for i, w in enumerate(words) if w in _STREET_SET]
        last = types[-1] if types else len(words)
        kept = {i for i, w in enumerate(words) if i == last or w in UNIT_WORDS}
        number = next((i for i, w in enumerate(words) if w[0].isdigit() and (i == 0 or words[i - 1] not in UNIT_WORDS)), 0)
        if number + 2 < last and words[number + 1] in _DIRECTION_SET:
            kept.add(number + 1)
        return kept

    def write(self, text: str, kind: str, form: str, draw: int) -> str:
        """The surrogate in the writing of the text it replaces."""
        plain, more = self.plain(kind, form, draw), draw // WIDEN
        if kind in ("phone", "id_number"):
            plain, tail = (plain[:-more], plain[-more:]) if more else (plain, "")
            # a number within the United Kingdom may be written with its country in place of the 0
            new = list(plain[1:] if kind == "phone" and len(plain) == 11 and plain[0] == "0" else plain)
            out, at = [], len(new)
            for token in reversed(re.findall(rf"{'|'.join(DIGIT_WORDS)}|.", text, re.I | re.S) if kind == "phone" else list(text)):
                word = DIGIT_WORDS.get(token.lower())
                if at and (word or token.isalnum()):
                    at -= 1
                    token = next(w for w, d in DIGIT_WORDS.items() if d == new[at]) if word else new[at].upper() if token.isupper() else new[at]
                out.append(token)
            return "".join(reversed(out)) + tail
        if kind == "email":
            new_local, new_host = plain.split("@")
            m = re.search(rf"{_AT}|\s+at\s+", text, re.I)
            dot = re.search(rf"{_DOT}", text[m.end() :], re.I) if m else None
            out = f"{new_local}{m[0]}{new_host.replace('.', dot[0])}" if m and dot else plain
            return out.upper() if text.isupper() else out
        if kind == "street_address":
            new = iter(plain.split())
            return re.sub(r"\w+", lambda w: self.cased(w[0], next(new, w[0])), text)
        first, _, family = plain.partition(" ")
        swap = re.match(r"[^\W\d_]+(?:-[^\W\d_]+)?,", text)
        words = (family.split("-") + [first]) if swap else ([first] + family.split("-"))
        tokens = re.findall(r"[^\W\d_]+", text)
        title = 0 if swap or not TITLE.match(text) else 1
        # initials and names between the first and the family's get others
        rnd = self.numbers("middle", form, draw)
        middle = [self.other_char(rnd, t.lower()) if len(t) == 1 else self.word(rnd, 2, t.lower()) for t in tokens[title + 1 : len(tokens) - len(words) + 1]]
        plan = words if swap else [None] * title + words[:1] + middle + words[1:]
        new = iter(plan + [None] * len(tokens))
        return re.sub(r"[^\W\d_]+", lambda w: w[0] if (x := next(new)) is None else self.cased(w[0], x), text)

    @staticmethod
    def cased(old: str, new: str) -> str:
        if old.isupper() and (len(old) > 1 or len(new) == 1):
            return new.upper()
        return new[:1].upper() + new[1:] if old[:1].isupper() else new


def name_table(names: DataFrame) -> list[tuple[str | None, str | None]]:
    """The table of names, which lists the names in use and does not grow with the posts; more than a million is an error."""
    rows = names.select("name", "name_type").distinct().limit(1_000_001).collect()
    if len(rows) > 1_000_000:
        raise ValueError("the table of names is larger than a worker should hold")
    return sorted(((r[0], r[1]) for r in rows), key=str)


_DETECTORS: dict[str, Detector] = {}


def _shared_names(spark: SparkSession, names: DataFrame):
    """The table of names for all tasks, with a token: what a worker keeps of it is known by that."""
    return spark.sparkContext.broadcast((uuid.uuid4().hex, name_table(names)))


def _detector(shared) -> Detector:
    token, names = shared.value
    if token not in _DETECTORS:
        _DETECTORS.clear()
        _DETECTORS[token] = Detector(names)
    return _DETECTORS[token]


def _long_texts(df: DataFrame, id_col: str, fields: tuple[str, ...]) -> DataFrame:
    return df.select(F.col(id_col).alias("_id"), *[F.col(f).cast("string").alias(f) for f in fields])


def detect(df: DataFrame, names: DataFrame, id_col: str = "post_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, field, pii_type) for each type in each field of each row."""
    texts = _long_texts(df, id_col, fields)
    return _spans(texts, names, fields, False).withColumnRenamed("_id", id_col)


def _spans(texts: DataFrame, names: DataFrame, fields: tuple[str, ...], places: bool) -> DataFrame:
    """(first column, field, pii_type), one row a type; with places also start, end and form, one row an entity."""
    shared = _shared_names(texts.sparkSession, names)
    key, key_type = texts.dtypes[0]
    out = ["field", "pii_type", "start", "end", "form"][: 5 if places else 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = _detector(shared)
        for batch in (part for whole in batches for part in parts(whole, list(range(1, len(fields) + 1)), 2048)):
            at, rows = [], []
            for k, f in enumerate(fields):
                memo: dict[str, list] = {}
                for i, text in enumerate(batch.column(k + 1).to_pylist()):
                    if not text:
                        continue
                    found = memo.get(text)
                    if found is None:
                        found = detector(text)
                        found = [(f, t, a, b, c) for a, b, t, c in found] if places else [(f, t) for t in {x[2] for x in found}]
                        if len(text) < 64:
                            memo[text] = found
                    at += [i] * len(found)
                    rows += found
            columns = list(zip(*rows)) if rows else [()] * len(out)
            types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, types))], names=[key, *out])

    kinds = {"field": "string", "pii_type": "string", "start": "int", "end": "int", "form": "string"}
    return texts.mapInArrow(run, f"`{key}` {key_type}, " + ", ".join(f"`{c}` {kinds[c]}" for c in out))


def draws(entities: DataFrame, key: bytes) -> DataFrame:
    """(pii_type, form, draw) of the entities that may not keep their first surrogate, so that all are distinct.

    Each round compares the surrogates of all entities; of those that agree, the least keeps its draw.
    """
    surrogates = Surrogates(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, forms, n = (b.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([surrogates.plain(*x) for x in zip(kinds, forms, n)], pa.string())], names=["pii_type", "form", "draw", "surrogate"])

    now = stage(entities.select("pii_type", "form").distinct().withColumn("draw", F.lit(0)), "pii-draws")
    while True:
        made = now.mapInArrow(run, "pii_type string, form string, draw int, surrogate string")
        # an entity equal to the surrogate of another one would be taken for it
        taken = now.select("pii_type", F.col("form").alias("surrogate"), F.lit(True).alias("real"))
        order = F.row_number().over(Window.partitionBy("pii_type", "surrogate").orderBy("draw", "form"))
        made = made.join(taken, ["pii_type", "surrogate"], "left").withColumn("again", (order > 1) | F.coalesce("real", F.lit(False)))
        made = stage(made.select("pii_type", "form", (F.col("draw") + F.col("again").cast("int")).alias("draw"), "again"), "pii-draws")
        now = made.drop("again")
        if made.where("again").isEmpty():
            return now.where("draw > 0")


def redact(df: DataFrame, names: DataFrame, key: bytes, id_col: str = "post_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, *fields) with every entity replaced; a caller keeps `key` secret, and constant where surrogates are to be the same again.

    Texts are searched once. What was found is kept by a digest of the row's id and texts, so rows that
    repeat an id with other texts each get their own.
    """
    texts = _long_texts(df, id_col, fields).withColumn("_key", F.xxhash64("_id", *fields))
    found = stage(_spans(texts.select("_key", *fields), names, fields, True).dropDuplicates(["_key", "field", "start"]), "pii-spans")
    again = draws(found.select("pii_type", "form"), key)
    found = found.join(again, ["pii_type", "form"], "left").withColumn("draw", F.coalesce("draw", F.lit(0)))
    found = found.groupBy("_key").agg(F.collect_list(F.struct("field", "start", "end", "pii_type", "form", "draw")).alias("_found"))
    made = Surrogates(key)
    joined = texts.join(found, "_key", "left").select("_id", *fields, "_found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(k + 1) for k in range(len(fields))]
            hits = [(i, x) for i, x in enumerate(b.column(len(fields) + 1).to_pylist()) if x]
            if hits:
                texts = [c.to_pylist() for c in columns]
                for i, spans in hits:
                    for k, f in enumerate(fields):
                        at, parts, text = 0, [], texts[k][i]
                        for x in sorted((x for x in spans if x["field"] == f), key=lambda x: x["start"]):
                            s, e, t = x["start"], x["end"], x["pii_type"]
                            parts += [text[at:s], f"[{t} {made.write(text[s:e], t, x['form'], x['draw'])}]"]
                            at = e
                        if parts:
                            texts[k][i] = "".join([*parts, text[at:]])
                columns = [pa.array(t, pa.string()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["_id", *fields])

    id_type = dict(joined.dtypes)["_id"]
    return joined.mapInArrow(run, f"_id {id_type}, " + ", ".join(f"{f} string" for f in fields)).withColumnRenamed("_id", id_col)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post_id, field, pii_type: the types of personal information in each field of each post."""
    posts = spark.read.parquet(f"{sf_dir}/posts.parquet")
    return detect(posts, spark.read.parquet(f"{sf_dir}/personal_names.parquet")).distinct()


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post_id and the fields of every post with each entity replaced by `[type surrogate]`.

    The key is the session's threadloom.pii.key; without one a run makes its own, which nobody knows afterwards.
    """
    posts = spark.read.parquet(f"{sf_dir}/posts.parquet")
    key = spark.conf.get("threadloom.pii.key", None) or secrets.token_hex(32)
    return redact(posts, spark.read.parquet(f"{sf_dir}/personal_names.parquet"), key.encode())


def p5_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row on p5_redacted: rows, null and empty fields, and entities of which a word or number stays though it says no kind."""
    posts = spark.read.parquet(f"{sf_dir}/posts.parquet")
    names = spark.read.parquet(f"{sf_dir}/personal_names.parquet")
    key = secrets.token_bytes(32)
    out = redact(posts, names, key)
    counts = out.agg(F.count("*").alias("rows"), *[F.count_if(F.col(f).isNull()).alias(f"null_{f}") for f in FIELDS], *[F.count_if(F.col(f) == "").alias(f"empty_{f}") for f in FIELDS])
    found = _spans(_long_texts(posts, "post_id", FIELDS), names, FIELDS, True)
    texts = posts.select(F.col("post_id").alias("_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS])).alias("t")).select("_id", "t.field", "t.text")
    entities = found.join(texts.distinct(), ["_id", "field"]).select("pii_type", "form", F.expr("substring(text, start + 1, end - start)").alias("entity")).distinct()
    made = Surrogates(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, forms, entities = (b.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array([len(left_of(e, made.write(e, k, f, 0), k)) for k, f, e in zip(kinds, forms, entities)], pa.int32())], names=["left"])

    leaks = entities.mapInArrow(run, "left int").agg(F.count_if(F.col("left") > 0).alias("leaks"))
    return counts.join(leaks, F.lit(True))


def left_of(entity: str, surrogate: str, kind: str) -> set[str]:
    """Words and numbers of an entity that its surrogate still has in their place, other than those that say the kind."""
    cut = lambda t: re.findall(r"\d+|[^\W\d_]+", t.lower())
    old, new = cut(entity), cut(surrogate)
    if kind == "email":
        return {w for w in old if w in new and len(w) > 3 and w not in ("example", "commat")}
    stays = {"street_address": _STREET_SET | _DIRECTION_SET | UNIT_WORDS, "person_name": {"dr", "mr", "mrs", "ms", "prof"}}.get(kind, set())
    lead = 1 if kind == "phone" else 0  # country or kind of a phone number
    return {a for i, (a, b) in enumerate(zip(old, new)) if a == b and a not in stays and i >= lead and not (kind == "phone" and (len(a) < 3 or a in DIGIT_WORDS))}


SQL = {
    "p5_check": "SELECT count(*) AS rows, " + ", ".join(f"count(*) FILTER ({f} IS NULL) AS null_{f}, count(*) FILTER ({f} = '') AS empty_{f}" for f in FIELDS) + ", CAST(0 AS BIGINT) AS leaks FROM posts",
}
