"""Text normal forms, sentence split, Arabic patterns and hashes.

Everything is built-in except Unicode NFKC, which Spark lacks: an Arrow function does it, and
only rows with non-ASCII text are sent to it.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character classes.
FOREIGN = r"[^\x00-\x7f]"
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
BIDI = r"\u200e\u200f\u202a-\u202e\u2066-\u2069"
TATWEEL = r"\u0640"
ALEF_FORMS = "\u0622\u0623\u0625\u0671"
ALEF, YAA, HAA, LAM = "\u0627", "\u064a", "\u0647", "\u0644"
ARABIC_LETTER = r"[\u0621-\u064a\u0671-\u06d3\u06fa-\u06ff]"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
LATIN_DIGITS = "01234567890123456789"
ANY_ALEF = "[اأإآٱ]"
LETTER_CLASSES = {
    "ا": ANY_ALEF,
    "أ": ANY_ALEF,
    "إ": ANY_ALEF,
    "آ": ANY_ALEF,
    "ٱ": ANY_ALEF,
    "ي": "[يى]",
    "ى": "[يى]",
    "ة": "[ةه]",
    "ه": "[ةه]",
}
MARKS = r"[\u064b-\u065f\u0670]*"
LAM_ALEF = f"(?:ل{MARKS}\\s*{ANY_ALEF}|{ANY_ALEF}{MARKS}\\s*ل)"
REGEX_SPECIALS = r"[.*+?^${}()|\[\]\\]"


def _nfkc_udf():
    # Defined here so that it travels to the executors by value.
    def to_nfkc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return F.pandas_udf(to_nfkc, T.StringType())


def nfkc(text: Column) -> Column:
    """NFKC; ASCII text is its own normal form and stays in the JVM."""
    return F.coalesce(_nfkc_udf()(F.when(text.rlike(FOREIGN), text)), text)


def collapse(text: Column) -> Column:
    """Runs of white space become one space, ends trimmed."""
    # ASCII text takes the cheap class; the long one is for the other space characters.
    one = F.when(text.rlike(FOREIGN), F.regexp_replace(text, SPACE + "+", " ")).otherwise(
        F.regexp_replace(text, r"\s{2,}|[^\S ]", " ")  # single spaces stay as they are
    )
    return F.trim(one)


def latin_digits(text: Column) -> Column:
    """Arabic-Indic digits as 0-9 and the Arabic decimal sign as a point."""
    return F.translate(text, ARABIC_DIGITS + "\u066b", LATIN_DIGITS + ".")


def ocr_digits(text: Column) -> Column:
    """As ``latin_digits``, with the thousands sign read as a point too."""
    return F.translate(text, ARABIC_DIGITS + "\u066b\u066c", LATIN_DIGITS + "..")


def normalise_arabic(text: Column) -> Column:
    """NFKC without bidi controls and tatweel, white space collapsed."""
    return collapse(F.regexp_replace(nfkc(text), f"[\\u061c{BIDI}{TATWEEL}]", ""))


def normalise_search(text: Column) -> Column:
    """Form for matching: also vowel marks dropped, letters folded, digits, lower case."""
    t = F.regexp_replace(
        nfkc(text),
        f"[\\u061c\\u200b-\\u200d{BIDI}\\ufeff\\u0610-\\u061a\\u064b-\\u065f\\u0670\\u06d6-\\u06ed{TATWEEL}]",
        "",
    )
    t = F.translate(
        t,
        ALEF_FORMS + "\u0649\u06cc\u0629" + ARABIC_DIGITS,
        ALEF * 4 + YAA * 2 + HAA + LATIN_DIGITS,
    )
    return F.lower(t)


def normalise_english(text: Column, with_nfkc: bool = True) -> Column:
    """Lower case with plain quotes, dashes and spaces."""
    t = F.lower(nfkc(text) if with_nfkc else text)
    plain = F.translate(
        t,
        "\u2018\u2019\u201b\u02bc\u2032\u00b4`\u201c\u201d\u201e\u2033"
        "\u2010\u2011\u2012\u2013\u2014\u2015\u2212",
        "'" * 7 + '"' * 4 + "-" * 7,
    )
    return collapse(F.when(t.rlike(r"[^\x00-\x5f\x61-\x7f]"), plain).otherwise(t))


def gloss_form(text: Column, with_nfkc: bool = True) -> Column:
    """Arabic form the gloss works on: marks dropped, letters, digits and signs folded."""
    t = F.regexp_replace(nfkc(text) if with_nfkc else text, f"[{BIDI}{TATWEEL}]|\\p{{Mn}}", "")
    t = F.translate(
        t,
        ALEF_FORMS + "\u0649\u0629" + ARABIC_DIGITS + "\u066a\u060c\u061b",
        ALEF * 4 + YAA + HAA + LATIN_DIGITS + "%,;",
    )
    return collapse(t)


def gloss_form_text(text: str) -> str:
    """The same form for a constant phrase."""
    t = "".join(
        c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Mn"
    )
    t = re.sub(f"[{BIDI}{TATWEEL}]", "", t)
    t = t.translate(
        str.maketrans(
            ALEF_FORMS + "\u0649\u0629" + ARABIC_DIGITS + "\u066a\u060c\u061b",
            ALEF * 4 + YAA + HAA + LATIN_DIGITS + "%,;",
        )
    )
    return re.sub(r"\s+", " ", t).strip()


def clean_english(text: Column) -> Column:
    """Straight quotes and single spaces; ASCII text has no other quotes."""
    plain = F.translate(text, "\u2018\u2019\u02bc\u201c\u201d", "'''\"\"")
    return F.when(text.rlike(FOREIGN), collapse(plain)).otherwise(collapse(text))


def header_key(header: Column) -> Column:
    """Letters and digits only, lower case, interchangeable Arabic letters folded."""
    t = F.translate(F.lower(nfkc(header)), "أإآٱةى", "ااااهي")
    return F.regexp_replace(t, r"[^\p{L}\p{N}]", "")


def header_key_text(header: str) -> str:
    t = unicodedata.normalize("NFKC", header).lower()
    t = t.translate(str.maketrans("أإآٱةى", "ااااهي"))
    return "".join(c for c in t if unicodedata.category(c)[0] in "LN")


def split_sentences(text: Column) -> Column:
    """Sentences of normalised text; "art." and "no." do not end one."""
    parts = F.split(text, r"(?<!\b(?:art|arts|no|cl))[.;!?]+(?:\s+|\z)")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def is_arabic(text: Column) -> Column:
    return text.rlike(ARABIC_LETTER) & ~text.rlike("[A-Za-z]")


def has_letters(text: Column) -> Column:
    enough = F.length(F.regexp_replace(text, r"[^\p{L}]", "")) >= 2
    return enough & (is_arabic(text) | text.rlike("[A-Za-z]{2}"))


def clause_hash(text: Column) -> Column:
    return F.sha2(collapse(F.lower(text)), 256)


def escape_regex(text: Column) -> Column:
    return F.regexp_replace(text, REGEX_SPECIALS, r"\\$0")


def loose_arabic(phrase: Column) -> Column:
    """Pattern text that finds a phrase however it was spaced; lam-alef in either order.

    ``phrase`` is in the ``normalise_arabic`` form.
    """
    letters = F.regexp_replace(phrase, r"\s+", "")
    tokens = F.regexp_extract_all(letters, F.lit(f"ل{ANY_ALEF}|{ANY_ALEF}ل|."), F.lit(0))

    def part(token: Column) -> Column:
        out = escape_regex(token)
        for letter, cls in LETTER_CLASSES.items():
            out = F.when(token == letter, cls).otherwise(out)
        return F.when(F.length(token) == 2, LAM_ALEF).otherwise(out)

    return F.array_join(F.transform(tokens, part), MARKS + r"\s*")


def loose_arabic_text(phrase: str) -> str:
    letters = re.sub(r"\s+", "", unicodedata.normalize("NFKC", phrase))
    tokens = re.findall(f"ل{ANY_ALEF}|{ANY_ALEF}ل|.", letters)
    parts = [
        LAM_ALEF if len(t) == 2 else LETTER_CLASSES.get(t, re.sub(REGEX_SPECIALS, r"\\\g<0>", t))
        for t in tokens
    ]
    return (MARKS + r"\s*").join(parts)


def arabic_phrase(phrase: str) -> str:
    """A phrase in logical or in reversed (visual) order."""
    return f"(?:{loose_arabic_text(phrase)})|(?:{loose_arabic_text(phrase[::-1])})"
