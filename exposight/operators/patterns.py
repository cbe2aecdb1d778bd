"""Many patterns against many texts: an Aho-Corasick automaton in the tasks, and patterns that are a column of the row."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import running


def folded(text: str) -> str:
    """Lower case, one character for one."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _edge(text: str, i: int) -> bool:
    """Whether a word begins or ends before character i."""
    word = lambda k: 0 <= k < len(text) and (text[k].isalnum() or text[k] == "_")
    return word(i - 1) != word(i)


def _scan(shared):
    built: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            automaton = ahocorasick.Automaton()
            for k, (pattern, _) in enumerate(shared.value):
                automaton.add_word(pattern, k)
            automaton.make_automaton()
            built.append(automaton)
        for batch in batches:
            rows, which, starts, ends = [], [], [], []
            for r, text in enumerate(batch.column("text").to_pylist()):
                if not text:
                    continue
                text = folded(text)
                for last, k in built[0].iter(text):
                    pattern, at = shared.value[k]
                    a, b = last + 1 - len(pattern), last + 1
                    there = at == "any" or at in ("start", "either") and a == 0 or at in ("end", "either") and b == len(text)
                    if there and _edge(text, a) and _edge(text, b):
                        rows.append(r)
                        which.append(pattern)
                        starts.append(a)
                        ends.append(b)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), pa.array(which, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["id", "pattern", "start", "end"])

    return run


def find_patterns(df: DataFrame, id_col: str, text_col: str, patterns: DataFrame, pattern_col: str = "pattern", at_col: str | None = None, most_chars: int = 16_000_000) -> DataFrame:
    """(id, pattern, start, end): every place where a pattern stands as whole words in a text, overlapping ones too.

    Case is folded on both sides; pattern is given folded.  at_col says where a pattern counts: any, start, end or either (of the
    text's ends).  A pattern that is listed twice counts where any of its rows lets it.  Blank patterns match nothing; null texts have no
    rows.  The automaton is made from the pattern table once its size is known: up to most_chars characters are shipped
    to the tasks at a time, a longer list in several parts.
    """
    places = F.coalesce(F.col(at_col), F.lit("any")) if at_col else F.lit("any")
    listed = patterns.select(F.lower(F.col(pattern_col)).alias("pattern"), places.alias("at")).filter("trim(pattern) <> ''").distinct()
    both = F.when(F.array_contains(F.collect_set("at"), "any") | (F.size(F.collect_set("at")) > 2), "any").when(F.size(F.collect_set("at")) > 1, "either").otherwise(F.first("at"))
    parts = running(listed.groupBy("pattern").agg(both.alias("at")), [F.col("pattern")], {"before": F.length("pattern")})
    parts = parts.select("pattern", "at", F.floor(F.col("before") / most_chars).alias("part"))
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    schema = f"id {dict(texts.dtypes)['id']}, pattern string, start int, end int"
    out = None
    for r in parts.select("part").distinct().orderBy("part").collect():
        rows = parts.filter(F.col("part") == r["part"]).select("pattern", "at").collect()  # at most about most_chars characters
        shared = df.sparkSession.sparkContext.broadcast([tuple(x) for x in rows])
        found = texts.mapInArrow(_scan(shared), schema)
        out = found if out is None else out.unionByName(found)
    out = out if out is not None else df.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("id", id_col)


def quoted(word: Column) -> Column:
    """word as a regular expression that matches just it."""
    return F.concat(F.lit("\\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def has_word(text: Column, word: Column) -> Column:
    """Whether a row's text holds the row's word between word borders, in any case; a blank word is in no text."""
    pattern = F.concat(F.lit("(?i)(?<![\\p{L}\\p{N}_])"), quoted(word), F.lit("(?![\\p{L}\\p{N}_])"))
    return F.coalesce((F.trim(word) != "") & F.regexp_like(text, pattern), F.lit(False))


#: States whose two letters are also words, and states whose name is part of another place's.
LETTERS_ARE_WORDS = ["IN", "OR", "OH", "DE"]
NAME_NEEDS = {"WA": ("washington", "washington state"), "VA": ("virginia", "^virginia")}


def state_patterns(names: DataFrame, code: str = "code", name: str = "name") -> DataFrame:
    """(code, pattern): for each state a regular expression of its names and, where they are no word, its two letters with or without periods."""
    long = F.lower(F.col(name))
    for state, (short, needed) in NAME_NEEDS.items():
        long = F.when(F.col(code) == state, F.regexp_replace(long, short, needed)).otherwise(long)
    letters = F.when(~F.col(code).isin(LETTERS_ARE_WORDS), F.concat(F.lower(F.substring(code, 1, 1)), F.lit("\\.?"), F.lower(F.substring(code, 2, 1))))
    per = names.withColumn("__long", long).withColumn("__letters", letters).groupBy(code).agg(F.first("__letters").alias("l"), F.array_join(F.array_sort(F.collect_set("__long")), "|").alias("n"))
    return per.select(code, F.concat(F.lit("(?i)(?:^|(?<=\\W))(?:"), F.concat_ws("|", "l", "n"), F.lit(")(?=\\W|$)")).alias("pattern"))


def in_state(df: DataFrame, place: str, code: str, patterns: DataFrame) -> DataFrame:
    """df with in_state: whether the place names the row's state.  patterns has a row for each state."""
    return df.join(F.broadcast(patterns), code, "left").withColumn("in_state", F.coalesce(F.regexp_like(F.col(place), F.col("pattern")), F.lit(False))).drop("pattern")
