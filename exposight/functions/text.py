"""Text columns: cleaning, word splitting, whitelists, tweet texts."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that do not decompose under NFKD.
FOLD = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ı": "i", "þ": "th", "Þ": "TH", "ð": "d", "Ð": "D"}
CAMEL = r"[A-Z][a-z]*|[a-z]+"
CAMEL_CAPS = r"[A-Z][a-z]+|[A-Z]+|[a-z]+|[0-9]+"


def fold_latin(s: str) -> str:
    """Latin letters without marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", "".join(FOLD.get(c, c) for c in s)) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def latin_ascii(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else fold_latin(x))


def replace_first(text: Column, pattern: str, by: str = "") -> Column:
    """Only the first match is replaced."""
    found = F.regexp_extract(text, f"({pattern})", 1)
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(by), F.substring(text, at + F.length(found), F.length(text)))).otherwise(text)


def extract_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def between_matches(text: Column, pattern: str) -> Column:
    """Text around the matches, blanks dropped."""
    return F.filter(F.split(text, pattern), lambda x: F.length(x) > 0)


def camel_words(text: Column, pattern: str = CAMEL) -> Column:
    return F.transform(extract_all(text, pattern), F.lower)


def clean_name(name: Column) -> Column:
    """A person's name in lower-case words, as printed in voter files."""
    n = F.replace(name, F.lit("'"), F.lit(""))
    n = F.regexp_replace(n, r"[-.,`_/\;%\[]", " ")
    n = F.regexp_replace(n, r"[()]", "")
    n = F.regexp_replace(F.translate(n, "10", "IO"), r"[0-9]", "")
    n = F.regexp_replace(n, r"(?i)\b(O|MC|MAC) +(?=\w)", "$1")
    return F.lower(F.trim(F.regexp_replace(n, r"\s+", " ")))


def profile_words(name: Column) -> Column:
    """Words of a display name and the parts of its camel-case words, without repeats."""
    plain = latin_ascii(nfkc(name))
    words = F.filter(F.split(F.regexp_replace(plain, r"[^\p{L}\p{N}']+", " "), " "), lambda w: w != "")
    return F.array_union(F.transform(words, F.lower), camel_words(plain))


def whitelist_patterns(terms: list[str]) -> dict[str, str]:
    """One alternation for each rule: hashtags hold the term, handles are it, words are it with an optional (e)s."""
    lit = lambda t: re.escape(t.lower()).replace(r"\ ", r"[ -]")
    tags = "|".join(lit(t.replace(" ", "")) for t in terms)
    return {"hashtag": rf"(?i)#\w*(?:{tags})\w*", "handle": rf"(?i)@(?:{tags})(?!\w)", "word": rf"(?i)(?<![\w@#])(?:{'|'.join(map(lit, terms))})(?:e?s)?(?!\w)"}


def whitelisted(text: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for p in whitelist_patterns(terms).values():
        out = out | F.coalesce(text.rlike(p), F.lit(False))
    return out


def strip_whitelist(text: Column, terms: list[str]) -> tuple[Column, Column]:
    """(matched terms, comma-joined without repeats; the rest in its own case).  Web addresses go first."""
    pattern = r"https?://\S+|" + "|".join(f"(?:{p})" for p in whitelist_patterns(terms).values())
    return F.array_join(F.array_distinct(extract_all(text, pattern)), ", "), F.trim(F.regexp_replace(F.regexp_replace(text, pattern, " "), r"\s+", " "))


def stem(word: str) -> str:
    """A light suffix stemmer for English."""
    for suffix, by, least in (("sses", "ss", 4), ("ies", "i", 3), ("ational", "ate", 8), ("ization", "ize", 8), ("fulness", "ful", 8), ("ingly", "", 6), ("edly", "", 6), ("ing", "", 5), ("ed", "", 4), ("ly", "", 5), ("s", "", 4)):
        if word.endswith(suffix) and len(word) >= least and not word.endswith("ss"):
            return word[: -len(suffix)] + by
    return word


def tokenize(text: str | None) -> list[str]:
    """Tokens of a post: addresses whole and in parts; @ and # names split at camel case; 's dropped; u.s. is usa; stems."""
    if not text:
        return []
    out: list[str] = []
    for url in re.findall(r"https?://\S+", text):
        out += [url, *(w.lower() for w in re.split(r"[^A-Za-z0-9]+", url) if len(w) > 1)]
    rest = re.sub(r"https?://\S+", " ", text)
    for tag in re.findall(r"[@#](\w+)", rest):
        out += [tag.lower(), *(w.lower() for w in re.findall(CAMEL_CAPS, tag) if w.lower() != tag.lower())]
    rest = re.sub(r"[@#]\w+", " ", rest)
    rest = re.sub(r"(?i)\bu\.s\.(?:a\.)?", "usa", re.sub(r"['’]s\b", "", rest))
    out += [stem(w) for w in re.findall(r"[^\W_]+", rest.lower())]
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def tweet_tokens(s: pd.Series) -> pd.Series:
    return s.map(tokenize)


def drop_short_links(text: Column) -> Column:
    """t.co links that stand after a space or at the start."""
    return F.regexp_replace(text, r"(?<=^|\s)https?://t\.co/\S*", "")


def tweet_text(prefix: Column, text: Column, quoted_user: Column, quoted: Column) -> Column:
    """Prefix, text and quoted text joined by single spaces; blank parts keep their space."""
    e = lambda c: F.coalesce(c, F.lit(""))
    return F.concat_ws(" ", e(prefix), e(text), F.when(e(quoted) != "", F.concat(F.lit("[QTG @"), e(quoted_user), F.lit("]"))).otherwise(F.lit("")), e(quoted))


def host_with_port(url: Column) -> Column:
    return F.regexp_extract(url, r"https?://([^/]+)", 1)


def paste_tolerant(*cols: Column) -> Column:
    """Parts joined by _, blanks left out."""
    return F.concat_ws("_", *[F.nullif(F.trim(c), F.lit("")) for c in cols])


def verdict(text: Column) -> Column:
    """none, both, false or true, by what a fact-check verdict says, in either case; a text of more than 100 characters is null: its parse failed."""
    t = F.coalesce(text, F.lit(""))
    true, false = t.rlike("(?i)true"), t.rlike("(?i)false|incorrect|inaccurate|unproven")
    return F.when(F.length(t) <= 100, F.when(true & false, "both").when(false, "false").when(true, "true").otherwise("none"))


def any_term(texts: Column, terms: list[str]) -> Column:
    """Whether any of an array of texts holds any of the terms, in any case."""
    return F.exists(texts, lambda x: F.coalesce(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(x), F.lower(t))), F.lit(False)))
