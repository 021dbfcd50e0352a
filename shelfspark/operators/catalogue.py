"""Facets of the book catalogue: load, single facets, their conjunction, mentions of author and title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import text as T

SECTION_MODULUS = 1_000_000_007


def normal_tokens(text: Column) -> Column:
    """Normalised tokens of a text; null counts as empty."""
    return F.transform(T.tokens(F.coalesce(text, F.lit(""))), T.normalise)


def udc_parts(udc: Column) -> Column:
    """The whole numbers between the dots; other parts are passed over."""
    return F.array_compact(F.transform(F.split(F.coalesce(udc, F.lit("")), "[.]"), lambda x: F.btrim(x).try_cast("int")))


def udc_key(udc: Column) -> Column:
    """``|a|b|``, so that a prefix ends at a component; null without components."""
    parts = udc_parts(udc)
    return F.when(F.size(parts) > 0, F.concat(F.lit("|"), F.array_join(F.transform(parts, lambda x: x.cast("string")), "|"), F.lit("|")))


def surname(author: Column) -> Column:
    """The longest normalised token of an author, of several the greatest; empty without tokens."""
    best = F.array_max(F.transform(normal_tokens(author), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))
    return F.coalesce(best.t, F.lit(""))


def catalogue_records(catalogue: DataFrame) -> DataFrame:
    """The last record of each object (by update, arrival and row), with what the facets need.

    Unparsable years and page counts are -1 and so pass upper bounds.
    """
    newest = catalogue.groupBy("object_id").agg(F.max_by(
        F.struct("title", "author", "udc", "year", "pages_count", "lib_sections"), F.struct("updated_at", "arrived_at", "row_id")).alias("r"))
    return newest.select("object_id", "r.*").withColumns({
        "year": F.coalesce("year", F.lit(-1)), "pages_count": F.coalesce("pages_count", F.lit(-1)),
        "title_tokens": normal_tokens(F.col("title")), "udc_key": udc_key(F.col("udc")), "surname": surname(F.col("author"))})


def whole_number(value) -> int | None:
    try:
        return int(str(value).strip())
    except ValueError:
        return None


def query_tokens(spark, query: str, limit: int | None = None) -> list[str]:
    """Normalised tokens of a query string."""
    row = spark.range(1).select(normal_tokens(F.lit(query))).first()[0]
    return row[:limit] if limit else row


def title_has(tokens: list[str]) -> Column:
    """All tokens stand in the title."""
    out = F.lit(True)
    for t in tokens:
        out = out & F.array_contains("title_tokens", t)
    return out


def bound(column: str, value, lower: bool = False, bigger: bool = False) -> Column:
    """Equal to the number, or at most / at least; nothing for what is no number."""
    n = whole_number(value)
    if n is None:
        return F.lit(False)
    c = F.col(column)
    return c <= n if lower else c >= n if bigger else c == n


def udc_under(spark, udc: str) -> Column:
    key = spark.range(1).select(udc_key(F.lit(udc))).first()[0]
    return F.lit(False) if key is None else F.coalesce(F.startswith("udc_key", F.lit(key)), F.lit(False))


def author_is(spark, author: str) -> Column:
    name = spark.range(1).select(surname(F.lit(author))).first()[0]
    return (F.col("surname") == name) & F.lit(name != "")


def in_section(code) -> Column:
    n = whole_number(code) if code else None
    return F.lit(False) if n is None else F.coalesce(F.array_contains("lib_sections", n), F.lit(False))


def facet_conditions(
    spark, title="", author="", udc="", year="", year_max="", year_min="", pages_count="", pages_count_max="", pages_count_min="", lib_section="",
) -> list[Column]:
    """One condition for each facet that was asked for. Empty and 0 mean: not asked for.

    A title without tokens passes nothing, as does a value that is no number.
    """
    asked: list[Column] = []
    if title:
        words = query_tokens(spark, title)
        asked.append(title_has(words) if words else F.lit(False))
    if author:
        asked.append(author_is(spark, author))
    if udc:
        asked.append(udc_under(spark, udc))
    for column, value, kind in (("year", year, {}), ("year", year_max, {"lower": True}), ("year", year_min, {"bigger": True}),
                                ("pages_count", pages_count, {}), ("pages_count", pages_count_max, {"lower": True}), ("pages_count", pages_count_min, {"bigger": True})):
        if value:
            asked.append(bound(column, value, **kind))
    if lib_section:
        asked.append(in_section(lib_section))
    return asked


def facet_filter(records: DataFrame, **facets) -> tuple[bool, DataFrame]:
    """Whether anything was asked for, and the records that pass all of it (see :func:`facet_conditions`)."""
    asked = facet_conditions(records.sparkSession, **facets)
    out = records
    for a in asked:
        out = out.where(a)
    return bool(asked), out


def mention_score(tokens: list[str]) -> Column:
    """Of a query's first ten words: how many stand in the title, and one more for the surname; null below 60 % of the words."""
    words = sorted(set(tokens[:10]))
    if not words:
        return F.lit(None).cast("int")
    wanted = F.lit(words)
    score = F.size(F.array_intersect(F.array_distinct("title_tokens"), wanted)) + F.array_contains(wanted, F.col("surname")).cast("int")
    return F.when(score >= -(-len(words) * 6 // 10), score)


def mentions(records: DataFrame, query: str) -> DataFrame:
    """``(object_id, score)`` of records whose title or surname holds at least 60 % of the query's first ten words."""
    score = mention_score(query_tokens(records.sparkSession, query, 10))
    return records.select("object_id", score.alias("score")).where(F.col("score").isNotNull())


def section_codes(levels: list[Column]) -> Column:
    """Codes of the section path, one a level down to the first empty one: md5 of the names so far, modulo a prime."""
    names = F.array(*[F.btrim(F.coalesce(x, F.lit(""))) for x in levels])

    def code(k: int) -> Column:
        digest = F.md5(F.concat(*[names[i] for i in range(k)]))
        out = F.lit(0).cast("long")
        for i in range(0, 32, 6):  # 24 bits at a time stay far below 2^63
            part = F.substring(digest, i + 1, 6)
            out = F.pmod(out * (1 << (4 * min(6, 32 - i))) + F.conv(part, 16, 10).cast("long"), F.lit(SECTION_MODULUS).cast("long"))
        return out.cast("int")

    out = F.array().cast("array<int>")
    for k in range(len(levels), 0, -1):
        filled = names[0] != ""
        for i in range(1, k):
            filled = filled & (names[i] != "")
        out = F.when(filled, F.array(*[code(j) for j in range(1, k + 1)])).otherwise(out) if k == len(levels) else \
            F.when(filled & (names[k] == ""), F.array(*[code(j) for j in range(1, k + 1)])).otherwise(out)
    return out


def section_collisions(lines: DataFrame) -> DataFrame:
    """``(section_code, paths)`` of codes with more than one path."""
    levels = [F.btrim(F.coalesce(f"section_{i}", F.lit(""))) for i in (1, 2, 3)]
    rows = lines.select(F.posexplode(section_codes([F.col(f"section_{i}") for i in (1, 2, 3)])).alias("k", "section_code"), *[x.alias(f"l{i}") for i, x in enumerate(levels)])
    path = F.concat(F.col("l0"), F.lit(";"), F.when(F.col("k") >= 1, F.concat("l1", F.lit(";"))).otherwise(""), F.when(F.col("k") >= 2, F.concat("l2", F.lit(";"))).otherwise(""))
    return rows.select("section_code", path.alias("path")).distinct().groupBy("section_code").agg(F.count(F.lit(1)).alias("paths")).where("paths > 1")
