"""Which parts of a handle a display name explains, and what is left of the handle."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import fold_latin


def align(name: str | None, handle: str | None) -> tuple[list[str], list[str], bool]:
    """(name words, further handle words, whether the name explains at least half of the handle).

    The handle's letters are taken up in three steps, each by longest first: whole name words; beginnings (two letters or
    more) of words not found yet, which are index words themselves; initials of such words.  Each stretch that is left is
    an index word, and so is it together with the stretch taken up just before it.
    """
    plain = fold_latin(name or "")
    words = list(dict.fromkeys(w.lower() for w in re.findall(r"[^\W_]+", plain)))
    camel = [w.lower() for part in re.findall(r"[^\W_]+", plain) for w in re.findall(r"[A-Z][a-z]+|[a-z]+", part)]
    words += [w for w in dict.fromkeys(camel) if w not in words and len(w) > 1]
    text = fold_latin(handle or "").lower()
    letters = [c if c.isalpha() else " " for c in text]
    taken = [0] * len(letters)  # 0 free, else the number of the stretch
    count, parts, found = 0, [], set()

    def free(a: int, b: int) -> bool:
        return not any(taken[a:b])

    def take(a: int, b: int) -> None:
        nonlocal count
        count += 1
        taken[a:b] = [count] * (b - a)

    joined = "".join(letters)
    for w in sorted((w for w in words if len(w) > 1), key=len, reverse=True):
        at = next((m.start() for m in re.finditer(re.escape(w), joined) if free(m.start(), m.end())), None)
        if at is not None:
            take(at, at + len(w))
            found.add(w)
    rest = [w for w in words if w not in found and not any(w in f for f in found)]
    for n in range(max(map(len, rest), default=0) - 1, 1, -1):
        for w in [w for w in rest if len(w) > n]:
            at = next((m.start() for m in re.finditer(re.escape(w[:n]), joined) if free(m.start(), m.end()) and (m.start() == 0 or taken[m.start() - 1] or letters[m.start() - 1] == " ")), None)
            if at is not None:
                take(at, at + n)
                parts.append(w[:n])
                rest.remove(w)
    for w in rest:
        at = next((i for i, c in enumerate(letters) if c == w[0] and not taken[i] and (i == 0 or taken[i - 1] or letters[i - 1] == " ")), None)
        if at is not None:
            take(at, at + 1)
    left, glued, i, free_letters = [], [], 0, 0
    while i < len(letters):
        if letters[i] != " " and not taken[i]:
            j = i
            while j < len(letters) and letters[j] != " " and not taken[j]:
                j += 1
            free_letters += j - i
            left.append(joined[i:j])
            if i and taken[i - 1]:
                k = i - 1
                while k and taken[k - 1] == taken[i - 1]:
                    k -= 1
                glued.append(joined[k:j])
            i = j
        else:
            i += 1
    more = [w for w in dict.fromkeys(parts + left + glued) if len(w) > 1 and w not in words]
    total = sum(c != " " for c in letters)
    return words, more, free_letters * 2 < total or not total


@F.pandas_udf(T.StructType().add("words", T.ArrayType(T.StringType())).add("handle_words", T.ArrayType(T.StringType())).add("good_match", T.BooleanType()))
def name_handle_words(name: pd.Series, handle: pd.Series) -> pd.DataFrame:
    got = [align(n, h) for n, h in zip(name, handle)]
    return pd.DataFrame({"words": [g[0] for g in got], "handle_words": [g[1] for g in got], "good_match": [g[2] for g in got]})
