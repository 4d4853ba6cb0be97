"""Text search: query analysis, BM25 and snippets, without an exploded posting table.

For a query of a few terms the term counts of a text are taken inside the row, so one pass over the texts gives
the statistics (one row, broadcast) and a second the scores; nothing but the final top rows is shuffled.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that are no query terms, and the constants of the rank.
STOPWORDS = "and are but for from has have into not that the this was were with you your".split()
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
SNIPPET = 200

#: Accented letters and their base letters, built from Unicode (Latin-1 Supplement and Latin Extended-A).
_PAIRS = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFD", chr(c))) > 1]
ACCENTED, PLAIN = "".join(a for a, _ in _PAIRS), "".join(b for _, b in _PAIRS)


def query_terms(query: str) -> list[str]:
    """Distinct sorted terms of three or more characters, without stop words; empty means no text search."""
    found = re.split(r"[\W_]+", query.lower())
    return sorted({w for w in found if len(w) >= 3 and w not in STOPWORDS})


def tokens(text: Column) -> Column:
    """Words of a text: runs of letters and digits, lower case, without accents."""
    folded = F.lower(F.translate(text, ACCENTED, PLAIN))
    return F.array_remove(F.split(folded, r"[^\p{L}\p{N}]+"), "")


def _count(words: Column, term: str) -> Column:
    return F.size(words) - F.size(F.array_remove(words, term))


def bm25(rows: DataFrame, text: Column, terms: list[str]) -> DataFrame:
    """``rows`` that hold a term, with ``bm25`` (lower is better) and ``hits`` (number of terms found).

    Statistics cover all rows with a text. Terms are folded like the texts. No terms or no texts: no rows.
    """
    if not terms:
        return rows.withColumn("bm25", F.lit(0.0)).withColumn("hits", F.lit(0)).limit(0)
    # the words are bound once a row; a filter pushed down would otherwise repeat the split for every term
    held = F.element_at(F.transform(F.array(tokens(text)), lambda w: F.struct(F.size(w).alias("n"), F.array(*[_count(w, t) for t in terms]).alias("tf"))), 1)
    counted = rows.where(text.isNotNull()).withColumn("_s", held)
    seen = [F.sum((F.element_at("_s.tf", i + 1) > 0).cast("long")).alias(f"_d{i}") for i in range(len(terms))]
    stats = counted.agg(F.count(F.lit(1)).alias("_rows"), F.avg("_s.n").alias("_mean"), *seen)
    met = counted.join(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, n = F.element_at("_s.tf", i + 1), F.col(f"_d{i}")
        idf = F.log((F.col("_rows") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        score = score + idf * (tf * (K1 + 1.0)) / (tf + K1 * (1.0 - B + B * F.col("_s.n") / F.col("_mean")))
    hits = F.size(F.filter("_s.tf", lambda x: x > 0))
    return met.withColumn("bm25", -score).withColumn("hits", hits).where("hits > 0").select(*rows.columns, "bm25", "hits")


def catalogue_text(*columns: str) -> Column:
    """Several text columns as one, blank-separated; null if nothing but blanks is left."""
    joined = F.trim(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))
    return F.when(joined != "", joined)


def snippet(text: Column) -> Column:
    return F.substring(text, 1, SNIPPET)
