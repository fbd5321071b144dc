"""Quality rules as a bitmask ledger, in DataFrame expressions only.

``ledger`` measures each text once and evaluates each rule once: bit i of ``failures`` is set when rule i fails.
``apply_policy`` keeps the rows on which no rule of a versioned policy fails; ``ablation`` finds from the stored bits what
each rule rejects, alone and with others, without looking at a text again.

Words are runs of characters other than 0x20 and 0x09-0x0D. A null text counts as the empty text: it has no words and
fails ``few_words``. Input columns pass through; those whose names clash with the ledger's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaims"]

#: Rule names with the condition under which a text fails, in the order of their bits. New rules go to the end.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeats", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("capitals", "100 * n_upper > 50 * word_chars"),
    ("exclaims", "100 * n_exclaims > 50 * n_words"),
    ("dup_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
]
#: Policy versions with the rules that they apply.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeats"],
    "v1": ["few_words", "repeats", "symbols", "capitals", "exclaims", "dup_lines", "short_words", "long_words"],
}


def mask(policy: str) -> int:
    return sum(1 << i for i, (name, _) in enumerate(RULES) if name in POLICIES[policy])


def _repeat_words(words: str) -> list[tuple[str, Column]]:
    """Steps to the number of words in 3-word windows that occur twice or more: sorting brings equal windows together."""
    grams = F.when(
        F.size(words) >= 3,
        F.transform(F.slice(words, F.lit(1), F.size(words) - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
    )
    placed = F.when(
        F.size(F.array_distinct("_grams")) < F.size("_grams"),
        F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
    )
    twice = F.sort_array(
        F.array_compact(F.transform("_placed", lambda x, j: F.when((x["g"] == F.get("_placed", j - 1)["g"]) | (x["g"] == F.get("_placed", j + 1)["g"]), x["i"])))
    )
    covered = F.aggregate(F.transform("_twice", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("_twice", j + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    return [("_grams", grams), ("_placed", placed), ("_twice", twice), ("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))]


def _left_of(text: Column, pattern: str) -> Column:
    """How many characters of ``text`` the pattern does not cover."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures and ``failures``."""
    made = [*MEASURES, "failures"]
    own = [c for c in docs.columns if c not in made]
    out = docs.select(*own, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    out = out.withColumn("_words", F.array_remove(F.split("_text", SPACE), ""))
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("_marks", F.regexp_replace("_text", "[^#*$%&|<>!A-Z]+", ""))
    for name, step in _repeat_words("_words"):
        out = out.withColumn(name, step)
    out = out.select(
        *own,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _left_of(F.col("_marks"), "[!A-Z]+").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        _left_of(F.col("_marks"), "[^A-Z]+").alias("n_upper"),
        _left_of(F.col("_marks"), "[^!]+").alias("n_exclaims"),
    )
    bits = [F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, fails) in enumerate(RULES)]
    failures = bits[0]
    for bit in bits[1:]:
        failures = failures.bitwiseOR(bit)
    return out.withColumn("failures", failures)


def passes(policy: str, failures: str = "failures") -> Column:
    return F.col(failures).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def apply_policy(ledger_rows: DataFrame, policy: str) -> DataFrame:
    """The rows that pass. The row number keeps the optimizer from moving the filter, and with it copies of the rules, below the ledger."""
    numbered = ledger_rows.withColumn("_at", F.monotonically_increasing_id())
    return numbered.where(passes(policy) & (F.col("_at") >= 0)).drop("_at")


def ablation(ledger_rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: rows that fail it, and rows that only it rejects (kept again without the rule).

    One row per rule; counts are 0 over an empty ledger. ``seen`` and ``common`` hold the bits that any, and that every row fails.
    """
    held = F.col("failures").bitwiseAND(F.lit(mask(policy)).cast("long"))
    cells = []
    for i, (name, _) in enumerate(RULES):
        if mask(policy) >> i & 1:
            bit = F.lit(1 << i).cast("long")
            cells.append(F.struct(F.lit(name).alias("rule"), F.count_if(held.bitwiseAND(bit) != 0).alias("fails"), F.count_if(held == bit).alias("alone")))
    total = ledger_rows.agg(F.count("*").alias("n_rows"), F.bit_or(held).alias("seen"), F.bit_and(held).alias("common"), F.array(*cells).alias("rules"))
    return total.select("n_rows", "seen", "common", F.inline("rules"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w,
        unnest(range(1, 1 + len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')))) AS i FROM d),
g AS (SELECT rid, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i FROM g WHERE w3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, w, w2, w3) > 1),
c AS (SELECT rid, count(DISTINCT i + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
n AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (SELECT d.rid, doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
        length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(text, '[^!]+', '', 'g'))::BIGINT AS n_exclaims
      FROM d JOIN l USING (rid) LEFT JOIN n USING (rid) LEFT JOIN c USING (rid)),
f AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
        + 8 * (100 * n_upper > 50 * word_chars)::BIGINT + 16 * (100 * n_exclaims > 50 * n_words)::BIGINT
        + 32 * (100 * n_dup_lines > 30 * n_lines)::BIGINT + 64 * (word_chars < 2 * n_words)::BIGINT
        + 128 * (word_chars > 15 * n_words)::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed,
       failures = 0 AS kept, failures FROM f
"""
