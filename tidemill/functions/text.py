"""Keywords of a search text: a plain expression, and a table function for SQL.

Latin letters and digits make words by runs; runs of CJK characters are cut by
a dictionary into all the words it holds, and into single characters where it
holds none. Segmentation by another analyser's own dictionary can be had by
handing over that dictionary.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

RUN = r"[a-z0-9]+"
_RUNS = re.compile(r"[a-z0-9]+|[㐀-䶿一-鿿豈-﫿]+", re.I)


def latin_words(text) -> Column:
    """Lower-cased runs of Latin letters and digits; stays within the JVM."""
    return F.regexp_extract_all(F.lower(text), F.lit(RUN), F.lit(0))


def segmented(text: str | None, dictionary: frozenset[str] = frozenset(), longest: int = 8) -> list[str]:
    out: list[str] = []
    for run in _RUNS.findall(text or ""):
        if run[0].isascii():
            out.append(run.lower())
            continue
        covered = 0
        for i in range(len(run)):
            held = [run[i:j] for j in range(min(len(run), i + longest), i + 1, -1) if run[i:j] in dictionary]
            out += held
            if held:
                covered = max(covered, i + len(held[0]))
            elif i >= covered:
                out.append(run[i])
    return out


def register_splitter(spark: SparkSession, name: str = "split_kw", dictionary: Iterable[str] = ()) -> None:
    """Registers a table function for ``LATERAL name(text)``; it yields no row for an empty text."""
    words = frozenset(dictionary)

    class Splitter:
        def eval(self, text: str):
            for word in segmented(text, words):
                yield (word,)

    spark.udtf.register(name, udtf(Splitter, returnType="word string"))
