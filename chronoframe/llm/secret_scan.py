"""Secret scans with corpus-wide ownership frequency, in DataFrame expressions only.

Three base patterns find candidates in each whole text (``assign``, ``access``, ``hex``), a fourth long mixed tokens
(``token``, outside base spans). Each candidate value is hashed; over all texts the distinct repositories and owners that
hold a hash are counted. A value that at least EXAMPLE_OWNERS owners hold is a widely copied ``example``; one that fewer
hold and that looks random is ``live``. Both verdicts add spans over the value; base spans stay whatever the verdict.

A null text is empty. A null owner or repository counts as one nameless owner or repository. Rows with equal id and text get
equal results, and repeated rows stay repeated. Counting aggregates (hash, owner, repository) before anything is joined, and
only rows with candidates take part, so a value that sits in a third of all texts costs a row per owner. Verdicts go back to the
occurrences by hash; values that hold over one in HOT of all occurrences (fewer than HOT of them, at any input) are broadcast, so that no key of
the join is large. Rows are named by 128 bits of id and text. Columns of any name pass through ``redact``. A long text is one value of its row, and the
time it takes grows with its length, and with the square of its number of matches (by copying references only).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut, discard

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Texts that the whole pattern can fit somewhere.
ASSIGN_GATE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
#: Runs are maximal, so a lower bound on their length drops the failing matches and no others.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
TOKEN = "[A-Za-z0-9+/_-]{24,}"
KINDS = ["assign", "access", "hex", "token", "example", "live"]
EXAMPLE_OWNERS = 3
HOT = 1000
_SPAN = "array<struct<kind:int,start:int,end:int,value:string,skip:int>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def _found(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Spans of all matches whose ``group`` has ``least`` characters: the parts between matches give their places."""
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value")
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["all"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["value"].alias("value"), (F.length(x["all"]) - F.length(x["value"])).alias("skip"))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(F.length(x["value"]) >= least, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), _none().alias("spans")), step, lambda acc: acc["spans"])


def candidates(text: Column) -> Column:
    """All candidate spans of ``text``: array of (kind, start, end, value, skip); the value starts ``skip`` after the start."""
    base = F.concat(
        F.when(text.rlike(ASSIGN_GATE), _found(text, ASSIGN, 0, 2, 12)).otherwise(_none()),
        F.when(F.contains(text, F.lit("AKIA")), _found(text, ACCESS, 1, 0, 18)).otherwise(_none()),
        F.when(text.rlike("[0-9a-f]{16}"), _found(text, HEX, 2, 0, 16)).otherwise(_none()),
    )
    tokens = F.when(text.rlike(TOKEN), F.filter(_found(text, TOKEN, 3, 0, 24), lambda x: _looks_live(x["value"]))).otherwise(_none())
    return F.concat(base, F.filter(tokens, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))))


def _looks_live(value: Column) -> Column:
    """Mixed letters and digits, and many different characters for its length."""
    kinds = F.size(F.array_remove(F.array_distinct(F.split(value, "")), ""))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (kinds >= 8)


def _name(doc_id: Column, text: Column) -> Column:
    """Names rows of equal id and text, by 128 bits."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\x00"), text))


def scan(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """Per row: doc_id, row (names equal rows), spans (kind, start, end, value, skip), base only if no candidate was judged.

    Written out, as the counts and the join back read it.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", _name(F.col("doc_id"), text).alias("row"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), candidates(text).alias("spans"))
    return cut(rows, "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """Per candidate hash: n_owners, n_repositories, times (occurrences)."""
    held = found.where("size(spans) > 0").select("owner", "repository", F.explode("spans.value").alias("value"))
    held = held.groupBy(F.sha2("value", 256).alias("hash"), "owner", "repository").agg(F.count("*").alias("n"))
    held = held.groupBy("hash", "owner").agg(F.count("*").alias("r"), F.sum("n").alias("n"))
    return held.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("r").alias("n_repositories"), F.sum("n").alias("times"))


def judged(found: DataFrame) -> DataFrame:
    """Per row name with candidates: all spans, those of the verdicts too, sorted by start and kind."""
    one = found.where("size(spans) > 0").select("row", F.explode("spans").alias("s")).withColumn("hash", F.sha2("s.value", 256))
    owners = cut(ownership(found), "owners")
    total = owners.agg(F.sum("times")).first()[0] or 0
    hot = owners.where(F.col("times") * HOT > total).select("hash", "n_owners")
    cold = owners.where(F.col("times") * HOT <= total).select("hash", "n_owners")
    told = one.join(F.broadcast(hot), "hash").union(one.join(F.broadcast(hot.select("hash")), "hash", "left_anti").join(cold, "hash").select("hash", "row", "s", "n_owners"))
    kind = F.when(F.col("n_owners") >= EXAMPLE_OWNERS, KINDS.index("example")).when(_looks_live(F.col("s.value")), KINDS.index("live"))
    own = F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), F.col("s.value").alias("value"))
    said = F.struct((F.col("s.start") + F.col("s.skip")).alias("start"), kind.alias("kind"), F.col("s.end").alias("end"), F.col("s.value").alias("value"))
    spans = told.select("row", F.when(kind.isNull(), F.array(own)).otherwise(F.array(own, said)).alias("both"))
    return spans.groupBy("row").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("both")))).alias("judged"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end in code points, end exclusive)."""
    found = scan(docs, F.col(owner), F.to_json(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repository))))
    base = F.sort_array(F.transform(F.filter("spans", lambda s: s["kind"] <= 2), lambda s: F.struct(s["start"], s["kind"], s["end"])))
    out = found.join(judged(found), "row", "left")
    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = {i})")).cast("long").alias(f"n_{KINDS[i]}") for i in range(3)]
    return out.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), F.coalesce(_joined(F.col("judged")), F.lit("")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every live value in their texts replaced by ``mark``; widely copied examples and all else stay.

    A column ``n_chars`` follows the text. The live values per row are written first: few, they are broadcast, and texts stay where they are;
    beyond the session's broadcast bound rows and values meet by a shuffle.
    """
    found = scan(docs, F.col("source"), F.to_json(F.array(F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))))
    live = judged(found).select("row", F.transform(F.filter("judged", lambda s: s["kind"] == KINDS.index("live")), lambda s: s["value"]).alias("live")).where("size(live) > 0")
    live = cut(live, "live-secrets")
    discard(found)
    out = docs.select(F.struct("*").alias("d")).withColumn("row", _name(F.col("d.doc_id"), F.coalesce(F.col("d.text").cast("string"), F.lit("")))).join(live, "row", "left")
    # longest first, so that a value that another contains doesn't leave a part of it
    order = F.transform(F.sort_array(F.transform("live", lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))), asc=False), lambda x: x["v"])
    clean = F.when(F.col("live").isNull(), F.col("d.text")).otherwise(F.aggregate(order, F.col("d.text").cast("string"), lambda t, v: F.replace(t, v, F.lit(mark))))
    out = out.select("d", "live", clean.alias("clean"))

    def value(name: str) -> Column:
        if name == "text":
            return F.col("clean").alias(name)
        own = F.col("d").getField(name)
        if name == "n_chars":
            own = F.when(F.col("live").isNull(), own).otherwise(F.length("clean")).cast(docs.schema[name].dataType)
        return own.alias(name)

    return out.select(*map(value, docs.columns))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, coalesce(lang, '') AS lang FROM documents),
pats(kind, pat, grp, least) AS (VALUES
  (0, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
  (1, 'AKIA[A-Z0-9]{14,}', 0, 18), (2, '[0-9a-f]{16,}', 0, 16), (3, '[A-Za-z0-9+/_-]{24,}', 0, 24)),
m AS (SELECT rid, kind, least, unnest(regexp_extract_all(text, pat, 0)) AS hit, unnest(CASE WHEN grp = 2 THEN
        regexp_extract_all(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) ELSE regexp_extract_all(text, pat, 0) END) AS value,
        unnest(string_split_regex(text, pat)[:-2]) AS before, unnest(range(1, 1 + len(regexp_extract_all(text, pat, 0)))) AS i
      FROM d, pats WHERE regexp_matches(text, pat)),
p AS (SELECT *, sum(length(before) + length(hit)) OVER (PARTITION BY rid, kind ORDER BY i) AS e FROM m),
s AS (SELECT rid, kind, (e - length(hit))::BIGINT AS s, e::BIGINT AS e, value, length(hit) - length(value) AS skip FROM p WHERE length(value) >= least),
looks AS (SELECT *, regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 8 AS live FROM s),
c AS (SELECT * FROM looks a WHERE kind < 3 OR live AND NOT EXISTS (SELECT 1 FROM looks b WHERE b.rid = a.rid AND b.kind < 3 AND b.s < a.e AND a.s < b.e)),
o AS (SELECT value, count(DISTINCT owner) AS n FROM c JOIN d USING (rid) GROUP BY value),
v AS (SELECT rid, kind, s, e FROM c UNION SELECT rid, CASE WHEN n >= 3 THEN 4 ELSE 5 END, s + skip, e FROM c JOIN o USING (value) WHERE n >= 3 OR live),
t AS (SELECT rid, string_agg(['assign', 'access', 'hex', 'token', 'example', 'live'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) AS spans,
        coalesce(string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) FILTER (kind < 3), '') AS base,
        count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex FROM v GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN t USING (rid)
"""
