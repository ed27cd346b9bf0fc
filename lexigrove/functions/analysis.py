"""Text analysis: tokens, normalisation, stopping, stemming.

Column expressions where Spark has them; the tag state machine and the stemmers are Arrow-batched UDFs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrove.functions.columns import let

#: What counts as a token after lower-casing; the same in every engine with ASCII classes.
SIMPLE = r"[a-z0-9]+"

_FULL = re.compile(
    r"""<!--.*?-->|<[^<>]*>|&[a-zA-Z#0-9]+;                 # markup, dropped
      |(?P<acronym>(?:[A-Za-z]\.){2,})
      |(?P<number>[+-]?\d[\d,]*(?:\.\d+)?)(?![\w])
      |(?P<word>[A-Za-z0-9'\u0080-\U0010FFFF]+)""",
    re.VERBOSE | re.DOTALL,
)


def simple_tokens(text: Column) -> Column:
    """array<string> of lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(SIMPLE), F.lit(0))


def tokenize(text: str) -> list[tuple[str, int, int]]:
    """(token, begin, end) in characters: acronyms, signed numbers and words; comments, tags and entities are dropped."""
    return [(m.group(m.lastgroup), m.start(), m.end()) for m in _FULL.finditer(text or "") if m.lastgroup]


def characters(text: Column) -> Column:
    """Every character that isn't blank as a token, for scripts written without blanks."""
    return F.filter(F.split(text, ""), lambda c: F.trim(c) != "")


def transcoded(data: Column, charset: str = "utf-8") -> Column:
    """Text of bytes in one of the charsets of the JVM: utf-8, iso-8859-1, us-ascii, utf-16 and its two orders, utf-32."""
    return F.decode(data, charset)


def normalise(term: str, acronyms: frozenset[str] = frozenset()) -> str:
    """Without full stops and apostrophes, lower-cased unless it is a listed acronym."""
    t = term.replace(".", "").replace("'", "")
    return t if t in acronyms else t.lower()


def normalised(term: Column, acronyms: list[str] | None = None) -> Column:
    t = F.regexp_replace(term, "[.']", "")
    return F.when(t.isin(acronyms), t).otherwise(F.lower(t)) if acronyms else F.lower(t)


def stopped(term: Column, stopwords: list[str]) -> Column:
    """NULL for a stopword: the slot, and with it the position, stays."""
    return F.when(~term.isin(list(stopwords)), term) if stopwords else term


# Porter's algorithm (M. F. Porter, An algorithm for suffix stripping, 1980), from its published rules.

#: Suffix -> replacement of steps 2 and 3, and the suffixes of step 4.
PORTER_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
PORTER_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
PORTER_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(stem: str) -> str:
    """c and v for consonants and vowels."""
    out = ""
    for i, ch in enumerate(stem):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def porter(word: str) -> str:
    w = word
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (PORTER_2, PORTER_3):
        end = max((e for e in table if w.endswith(e)), key=len, default=None)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = max((e for e in PORTER_4 if w.endswith(e)), key=len, default=None)
    if end:
        stem = w[: -len(end)]
        if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
            w = stem
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w


def dictionary_stemmer(headwords: frozenset[str] = frozenset(), conflations: dict[str, str] | None = None) -> Callable[[str], str]:
    """An inflectional stemmer in the manner of R. Krovetz (1993): an ending is taken off only if a headword remains.

    Conflations (form -> headword) go before rules. Without headwords, plurals, past and -ing forms are undone by rule alone.
    """
    pairs = conflations or {}

    def known(w: str) -> bool:
        return w in headwords

    def stem(w: str) -> str:
        if w in pairs:
            return pairs[w]
        if len(w) < 4 or known(w) or not w.isalpha():
            return w
        tries: list[str] = []
        if w.endswith("ies"):
            tries = [w[:-1], w[:-3] + "y"]
        elif w.endswith("es"):
            tries = [w[:-1], w[:-2]]
        elif w.endswith("s") and not w.endswith(("ss", "us")):
            tries = [w[:-1]]
        elif w.endswith("ied"):
            tries = [w[:-3] + "y"]
        elif w.endswith("ed"):
            tries = [w[:-1], w[:-2], w[:-3] if w[-3] == w[-4] else w[:-2]]
        elif w.endswith("ing"):
            tries = [w[:-3] + "e", w[:-3], w[:-4] if len(w) > 5 and w[-4] == w[-5] else w[:-3]]
        for t in tries:
            if known(t):
                return t
        if headwords or not tries:
            return w
        return tries[-1] if w.endswith(("ing", "ed", "ies")) and len(tries[-1]) > 2 else tries[0] if len(tries[0]) > 2 else w

    return stem


#: Prefixes and suffixes of light stemming of Arabic, and letters that are written alike.
ARABIC_PREFIXES = ["وال", "بال", "كال", "فال", "ال", "لل", "و"]
ARABIC_SUFFIXES = ["ها", "ان", "ات", "ون", "ين", "يه", "ية", "ه", "ة", "ي"]
ARABIC_ALIKE = {"أ": "ا", "إ": "ا", "آ": "ا", "ى": "ي", "ة": "ه"}


def arabic_light(word: str) -> str:
    w = re.sub("[ً-ْـ]", "", word)
    for p in ARABIC_PREFIXES:
        if w.startswith(p) and len(w) - len(p) >= (3 if p == "و" else 2):
            w = w[len(p) :]
            break
    for s in ARABIC_SUFFIXES:
        if w.endswith(s) and len(w) - len(s) >= 2:
            w = w[: -len(s)]
    return "".join(ARABIC_ALIKE.get(c, c) for c in w)


def stemmer(name: str, **options) -> Callable[[str], str]:
    """By the first letter of its name: p(orter), k (dictionary), a(rabic)."""
    kinds = {"p": lambda: porter, "k": lambda: dictionary_stemmer(**options), "a": lambda: arabic_light}
    try:
        return kinds[name[:1].lower()]()
    except KeyError:
        raise ValueError(f"unknown stemmer {name!r}") from None


def stem_udf(name: str, **options):
    """A pandas UDF term -> stem; every distinct term of a batch is stemmed once."""

    @F.pandas_udf("string")
    def stem(terms: pd.Series) -> pd.Series:
        f = stemmer(name, **options)
        return terms.map({t: f(t) for t in terms.dropna().unique()})

    return stem


# Tokens of streams and phrases.


def split_ws(text: Column, stop: list[str] | None = None, least: int = 0) -> Column:
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: F.length(w) > least)
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def split_cases(text: Column) -> Column:
    """Words cut at changes from lower to upper case and at special characters, lower-cased."""
    spaced = F.regexp_replace(text, r"(?<=[a-z])(?=[A-Z])|[^A-Za-z0-9]+", " ")
    return F.filter(F.split(F.lower(F.trim(spaced)), r"\s+"), lambda w: w != "")


def ngrams(words: Column, n: int) -> Column:
    """Blank-joined runs of n words; an array of fewer words has none."""

    def made(w: Column) -> Column:
        starts = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
        return F.when(F.size(w) >= n, starts).otherwise(F.array().cast("array<string>"))

    return let(words, made)


def phrases(text: Column) -> Column:
    """Runs of words between punctuation, lower-cased."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{Nd}\s'-]+")
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")


def url_tokens(url: Column) -> Column:
    return F.regexp_extract_all(F.lower(url), F.lit("[a-z0-9]+"), F.lit(0))


def first_number(text: Column) -> Column:
    """The first whole number of a numeric field's text, 0 if there is none."""
    return F.coalesce(F.regexp_extract(text, r"(-?[0-9]+)", 1).try_cast("long"), F.lit(0).cast("long"))


def sanitised(text: Column) -> Column:
    """Letters, digits and blanks only."""
    return F.regexp_replace(text, "[^A-Za-z0-9 ]", "")


def term_frequencies(words: Column) -> Column:
    """map<string,int> of an array of words: sorted, so that equal words are runs whose ends differ from what follows."""

    def made(w: Column) -> Column:
        ends = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"), (x == F.get(w, i + 1)).alias("on"))), lambda e: ~F.coalesce(e["on"], F.lit(False)))
        return let(ends, lambda e: F.map_from_entries(F.transform(e, lambda x, k: F.struct(x["w"], (x["i"] - F.when(k > 0, F.get(e, k - 1)["i"]).otherwise(-1)).cast("int")))))

    return let(F.array_sort(F.filter(words, lambda x: x.isNotNull())), made)


def log_factorial(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
