"""Text expressions: tokens, folding, stemming, generic placeholders, ids and literals."""

from __future__ import annotations

import ast
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
#: (pattern, replacement), in this order; none looks around, so every regex dialect agrees on them.
GENERIC = (
    (r"https?://[^\s]+", "[URL]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    (r"\b[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}\b", "[DATE]"),
    (r"\b[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}\b", "[DATE]"),
    (rf"(?i)\b(?:{_MONTHS}) +[0-9]{{4}}\b", "[DATE]"),
    (r"\b20[0-9]{2}(?:-[0-9]{2,4})?\b", "[YEAR]"),
    (r"\b19[0-9]{2}(?:-[0-9]{2,4})?\b", "[YEAR]"),
    (r"\b[0-9]+(?:\.[0-9]+)? ?%", "[PERCENT]"),
    (r"(?i)[$£€] ?[0-9][0-9,]*(?:\.[0-9]+)?(?: ?(?:million|billion|trillion))?", "[AMOUNT]"),
    (r"\b[0-9][0-9,]*(?:\.[0-9]+)?\b", "[NUM]"),
    (r"\s{2,}", " "),
)


def genericized(text: Column, patterns=GENERIC) -> Column:
    """text with links, addresses, dates, years, amounts and numbers replaced by placeholders."""
    for pattern, replacement in patterns:
        text = F.regexp_replace(text, pattern, replacement)
    return F.trim(text)


def prepared(text: Column, genericize: bool) -> Column:
    """What is embedded, and under which the embedding is kept."""
    return genericized(text) if genericize else text


def tokens(text: Column) -> Column:
    """Lower-case word tokens; null and empty texts have none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def query_tokens(text: Column) -> Column:
    """Tokens worth searching: single characters and bare numbers go, repeats stay."""
    return F.filter(tokens(text), lambda t: (F.length(t) > 1) & ~t.rlike("^[0-9]+$"))


def fold(word: str) -> str:
    """word without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


class Porter:
    """The Porter stemmer of 1980, on lower-case words."""

    _STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"))
    _STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
    _STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

    @staticmethod
    def _vowel(w: str, i: int) -> bool:
        return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not Porter._vowel(w, i - 1))

    @staticmethod
    def _measure(stem: str) -> int:
        kinds = [Porter._vowel(stem, i) for i in range(len(stem))]
        return sum(a and not b for a, b in zip(kinds, kinds[1:]))

    @staticmethod
    def _has_vowel(stem: str) -> bool:
        return any(Porter._vowel(stem, i) for i in range(len(stem)))

    @staticmethod
    def _double(w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and not Porter._vowel(w, len(w) - 1)

    @staticmethod
    def _cvc(w: str) -> bool:
        n = len(w)
        return n > 2 and not Porter._vowel(w, n - 1) and Porter._vowel(w, n - 2) and not Porter._vowel(w, n - 3) and w[-1] not in "wxy"

    @classmethod
    def stem(cls, w: str) -> str:
        if len(w) < 3 or not w.isascii() or not w.isalpha():
            return w
        m = cls._measure
        if w.endswith("sses") or w.endswith("ies"):
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        cut = None
        if w.endswith("eed"):
            w = w[:-1] if m(w[:-3]) > 0 else w
        elif w.endswith("ed") and cls._has_vowel(w[:-2]):
            cut = w[:-2]
        elif w.endswith("ing") and cls._has_vowel(w[:-3]):
            cut = w[:-3]
        if cut is not None:
            if cut.endswith(("at", "bl", "iz")):
                w = cut + "e"
            elif cls._double(cut) and cut[-1] not in "lsz":
                w = cut[:-1]
            else:
                w = cut + "e" if m(cut) == 1 and cls._cvc(cut) else cut
        if w.endswith("y") and cls._has_vowel(w[:-1]):
            w = w[:-1] + "i"
        for table in (cls._STEP2, cls._STEP3):
            ending = max((e for e, _ in table if w.endswith(e)), key=len, default=None)
            if ending is not None and m(w[: -len(ending)]) > 0:
                w = w[: -len(ending)] + dict(table)[ending]
        ending = max((e for e in cls._STEP4 if w.endswith(e)), key=len, default=None)
        if ending is not None:
            stem = w[: -len(ending)]
            if m(stem) > 1 and (ending != "ion" or stem.endswith(("s", "t"))):
                w = stem
        if w.endswith("e") and (m(w[:-1]) > 1 or (m(w[:-1]) == 1 and not cls._cvc(w[:-1]))):
            w = w[:-1]
        if w.endswith("ll") and m(w) > 1:
            w = w[:-1]
        return w


def stems(words: DataFrame, column: str = "term") -> DataFrame:
    """(term, stem) for each distinct word: the stemmer runs once a word, not once a token."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"term": pdf.term, "stem": [Porter.stem(fold(w)) for w in pdf.term]})

    return words.select(F.col(column).alias("term")).where("term is not null").distinct().mapInPandas(run, "term string, stem string")


def slug(key: Column, title: Column) -> Column:
    """<key>_<title, lower case, 40 characters, letters, digits, _ and - only>."""
    return F.concat_ws("_", key, F.regexp_replace(F.left(F.replace(F.lower(title), F.lit(" "), F.lit("_")), F.lit(40)), r"[^\p{L}\p{N}_-]", ""))


def reference_parts(ref: Column) -> Column:
    """struct(type, id) of "type/id"; a value without a slash is an error."""
    ok = F.when(F.instr(ref, "/") > 0, ref).when(ref.isNotNull(), F.raise_error(F.concat(F.lit("not a type/id reference: "), ref)).cast("string"))
    return F.struct(F.split(ok, "/", 2)[0].alias("type"), F.split(ok, "/", 2)[1].alias("id"))


def field_value(raw: str | None) -> tuple[str, str | None]:
    """(type, value as JSON) of a literal as people type it into a form."""
    if raw is None:
        return "null", None
    text = raw.strip()
    if text.lower() in ("null", "none"):
        return "null", None
    if text.lower() in ("true", "false"):
        return "boolean", text.lower()
    if text[:1] in ("[", "{"):
        for parse in (json.loads, ast.literal_eval):
            try:
                value = parse(text)
            except (ValueError, SyntaxError):
                continue
            if isinstance(value, (list, dict)):
                return ("array" if isinstance(value, list) else "object"), json.dumps(value, sort_keys=True)
    try:
        return "integer", str(int(text))
    except ValueError:
        return "string", json.dumps(raw)


def parsed_value(raw: Column) -> Column:
    """field_value() on a column, as struct(type, value)."""
    return F.udf(field_value, "struct<type:string,value:string>", useArrow=True)(raw)


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"\. "), lambda s: F.trim(s) != "")


def outline(level: Column, title: Column, description: Column) -> Column:
    """Two spaces for each level below the first, then "- title: description"."""
    return F.concat(F.repeat(F.lit("  "), F.greatest(level - 1, F.lit(0)).cast("int")), F.lit("- "), title, F.when(F.length(description) > 0, F.concat(F.lit(": "), description)).otherwise(""))
