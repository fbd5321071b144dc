"""Full-text search: tokens, stems, matching, highlighting, BM25. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import cut

#: Suffixes that stemming cuts, with the length that a word must exceed; the first that fits is cut.
SUFFIXES = [(5, "tion"), (5, "ness"), (5, "ment"), (5, "ing"), (4, "ed"), (4, "ly"), (4, "es")]
K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Words without marks, in lower case, of two bytes or more: marks go from the text at once, not word by word."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}\s]+", "")), r"\s+"), lambda w: F.octet_length(w) >= 2)


def stem(word: Column) -> Column:
    out = F.when((F.length(word) > 3) & word.endswith("s") & ~word.endswith("ss"), F.left(word, F.length(word) - 1)).otherwise(word)
    for n, suffix in reversed(SUFFIXES):
        out = F.when((F.length(word) > n) & word.endswith(suffix), F.left(word, F.length(word) - len(suffix))).otherwise(out)
    return out


def stems(text: Column) -> Column:
    return F.transform(tokens(text), stem)


def stems_of(query: str) -> list[str]:
    """The distinct stems of a literal, by the same expressions as those of columns."""
    return SparkSession.getActiveSession().range(1).select(F.array_distinct(stems(F.lit(query)))).first()[0]


def matches(text: Column, query: str) -> Column:
    """Whether each stem of the query occurs in the text; a query without words matches nothing."""
    wanted, held = stems(F.lit(query)), stems(text)
    return (F.size(wanted) > 0) & F.forall(wanted, lambda s: F.array_contains(held, s))


def spellings(stem_: str) -> list[str]:
    """All words that have this stem."""

    def cut_(w: str) -> str:
        for n, suffix in SUFFIXES:
            if len(w) > n and w.endswith(suffix):
                return w[: -len(suffix)]
        return w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w

    return [w for w in (stem_ + x for x in ("", "s", *(x for _, x in SUFFIXES))) if cut_(w) == stem_]


def highlight(text: Column, query: str) -> Column:
    """The words joined by single spaces, those that a query's stem fits between << and >>.

    White space and marks go from the text at once, not word by word. A text that without marks has no word that begins with a stem is done then; in others
    only the words are looked up.
    """
    wanted = stems_of(query)
    joined = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ | $", "")
    if not wanted:
        return joined
    bare = F.lower(F.regexp_replace(joined, r"[^\p{L}\p{N} ]+", ""))
    fits = lambda w: w.isin(*(x for s in wanted for x in spellings(s)))
    marked = F.zip_with(F.split(joined, " "), F.split(bare, " "), lambda w, b: F.when(fits(b), F.concat(F.lit("<<"), w, F.lit(">>"))).otherwise(w))
    some = F.lit(False)
    for s in wanted:
        some = some | F.contains(bare, F.lit(s))
    return F.when(some, F.array_join(marked, " ")).otherwise(joined)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, stem, tf, n): a row per document and stem; n is the document's length in tokens."""
    rows = docs.select(key, stems(F.col(text)).alias("s")).select(key, F.size("s").alias("n"), F.explode("s").alias("stem"))
    return rows.groupBy(key, "stem").agg(F.count("*").alias("tf"), F.first("n").alias("n"))


def bm25(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(key, score) of documents with a query's stem, summed over rows of the same key.

    Each text is cut into tokens once, and only those that begin with a stem of the query are stemmed, as a stem is its word's beginning. What is left of a
    text, its length and a count for each stem, is written out; totals and scores come from there, and nothing but totals and hits is shuffled.
    """
    wanted = docs.sparkSession.range(1).select(F.array_distinct(stems(F.lit(query)))).first()[0]
    if not wanted:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)

    def begins(w: Column) -> Column:
        out = F.lit(False)
        for s in wanted:
            out = out | w.startswith(s)
        return out

    rows = docs.select(key, tokens(F.col(text)).alias("t")).select(key, F.size("t").alias("n"), F.transform(F.filter("t", begins), stem).alias("s"))

    def held(q: str) -> Column:
        return F.size(F.filter("s", lambda x: x == q))

    counts = [held(q).alias(f"tf{i}") for i, q in enumerate(wanted)]
    rows = cut(rows.select(key, "n", *counts))
    total = rows.agg(F.count("*").alias("n_docs"), F.avg("n").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted)))).first()
    score, some = F.lit(0.0), F.lit(False)
    for i in range(len(wanted)):
        tf, df = F.col(f"tf{i}"), total[f"df{i}"]
        idf = F.log(F.lit(1 + (total["n_docs"] - df + 0.5) / (df + 0.5)))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / F.lit(total["mean"])))).otherwise(0.0)
        some = some | (tf > 0)
    return rows.where(some).groupBy(key).agg(F.sum(score).alias("score"))
