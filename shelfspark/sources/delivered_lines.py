"""Catalogue delivery lines: load the sound ones, set the others apart with every reason for failure.

Lines are read permissively under an explicit schema that keeps the raw text of corrupt records; what comes out corrupt,
and every line that holds a quote (the reader is laxer about quotes than the format), is reclassified by an exact check of
quoting, column count and values. Lines whose only fault is blanks around a value are thereby loaded after all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.session import fresh

# Fixed by the format: columns, blanks, and what a value may be.
COLUMNS = ["object_id", "year", "udc", "section_1", "section_2", "section_3", "pages_count", "author", "title"]
BLANKS = " \t\r\u00a0\ufeff"
SCHEMA = (
    "object_id long, year int, udc string, section_1 string, section_2 string, section_3 string, "
    "pages_count int, author string, title string, corrupt string"
)
UDC = r"[0-9]{1,3}(\.[0-9]{1,3})*+"
FIRST_YEAR, LAST_YEAR, MOST_PAGES = 1400, 2030, 99_999

_BL = r"[ \t\r\u00a0\ufeff]*+"
#: Doubled quotes are one sign while columns are looked for, so the pattern needs no group that repeats: the regex engine
#: would recurse once for each. A second sign keeps texts apart that hold the first.
_DOUBLED, _ESCAPE = "\ufdd0", "\ufdd1"
_FIELD = rf'{_BL}(?:{_DOUBLED}*+"[^"]*+"|{_DOUBLED}++){_BL}|(?!{_BL}["{_DOUBLED}])[^;]*+'


def _mask(line: Column) -> Column:
    for a, b in ((_ESCAPE, _ESCAPE + "e"), (_DOUBLED, _ESCAPE + "d"), ('""', _DOUBLED)):
        line = F.replace(line, F.lit(a), F.lit(b))
    return line


def _unmask(cell: Column) -> Column:
    for b, a in ((_DOUBLED, '""'), (_ESCAPE + "d", _DOUBLED), (_ESCAPE + "e", _ESCAPE)):
        cell = F.replace(cell, F.lit(b), F.lit(a))
    return cell


def _value(c: Column) -> Column:
    """A column as written -> its value: blanks and enclosing quotes off, doubled quotes single."""
    t = F.regexp_replace(c, r"^[ \t\r\u00a0\ufeff]++|[ \t\r\u00a0\ufeff]++$", "")
    inner = F.regexp_replace(F.substring(t, 2, 1 << 30), r'"$', "")
    return F.when(t.startswith('"'), F.btrim(F.replace(inner, F.lit('""'), F.lit('"')), F.lit(BLANKS))).otherwise(t)


def parse_lines(lines: DataFrame, line: str = "raw_line") -> DataFrame:
    """``lines`` plus the nine columns and ``reasons``, an array that is empty for a sound line.

    Clashing input columns are dropped in favour of the parsed ones. A null line is read as an empty one. Reasons:
    ``quoting`` alone; else ``column_count`` alone; else any of ``bad_year``, ``bad_udc``, ``bad_pages_count``. Empty values of
    these three load as null.
    """
    keep = [c for c in lines.columns if c.lower() not in {*COLUMNS, "reasons"}]
    raw = fresh(lines, "_raw")
    base = lines.select(*keep, F.coalesce(F.col(line), F.lit("")).alias(raw))
    read = F.from_csv(F.col(raw), SCHEMA, {
        "sep": ";", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt",
        "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "maxCharsPerColumn": "-1",
        "enforceSchema": "true", "nullValue": "", "emptyValue": ""})
    # Nothing on which the reader and the format could differ: such a line is what its parts at ";" say.
    plain = F.col(raw).rlike(r"\A[^\"\u00a0\ufeff\n]*+\z")
    usual = base.withColumn("_read", F.when(plain, read)).withColumn("_parts", F.when(plain, F.split(raw, ";")))
    sound = F.col("_read").isNotNull() & F.col("_read.corrupt").isNull() & (F.size("_parts") == len(COLUMNS))
    # All others are reclassified by the format's own grammar: quoting, then columns, then values.
    masked = F.concat(_mask(F.col(raw)), F.lit(";"))
    cells = F.when(F.col("_parts").isNotNull(), F.col("_parts")).otherwise(
        F.transform(F.regexp_extract_all(masked, F.lit(rf"\G({_FIELD});"), F.lit(1)), _unmask))
    usual = usual.withColumn("_sure", sound).withColumn("_cells", F.when(~F.col("_sure"), cells)).withColumn(
        "_closed", F.col("_sure") | F.col("_parts").isNotNull() | (F.length(F.array_join("_cells", ";")) == F.length(raw)))

    trimmed = lambda i: F.btrim(F.get("_parts", F.lit(i)), F.lit(BLANKS))
    cell = [_value(F.get(F.col("_cells"), F.lit(i))) for i in range(len(COLUMNS))]
    val = {c: F.when(F.col("_sure"), trimmed(i) if c in ("year", "pages_count", "object_id") else F.coalesce(F.col(f"_read.{c}"), F.lit(""))).otherwise(cell[i])
           for i, c in enumerate(COLUMNS)}
    # Each value is worked out once: expressions that name a value several times would repeat all of it.
    usual = usual.withColumns({f"_v{i}": val[c] for i, c in enumerate(COLUMNS)})
    val = {c: F.col(f"_v{i}") for i, c in enumerate(COLUMNS)}
    n = F.when(F.col("_sure"), F.lit(len(COLUMNS))).otherwise(F.size("_cells"))

    def number(c: str, least: int, most: int) -> Column:
        """The text is that number as it is written by rule: no sign, no leading zero, ASCII digits."""
        x = val[c].try_cast("int")
        return F.coalesce((x.cast("string") == val[c]) & x.between(least, most), F.lit(False))

    def bad(c: str, rule: Column) -> Column:
        return F.when((val[c] != "") & ~rule, F.lit(f"bad_{c}"))

    # Words joined and split stay in generated code; an array that is filtered would be interpreted, row by row.
    named = F.concat_ws(" ", bad("year", number("year", FIRST_YEAR, LAST_YEAR)), bad("udc", val["udc"].rlike(rf"\A{UDC}\z")),
                        bad("pages_count", number("pages_count", 1, MOST_PAGES)))
    reason = F.when(~F.col("_closed"), F.lit("quoting")).when(n != len(COLUMNS), F.lit("column_count")).otherwise(named)
    reasons = F.when(reason == "", F.array().cast("array<string>")).otherwise(F.split(reason, " "))
    types = {"object_id": "bigint", "year": "int", "pages_count": "int"}
    loaded = [
        (F.nullif(v, F.lit("")).try_cast(types[c]) if c in types else v).alias(c) for c, v in val.items()
    ]
    # As the output of a generator: a filter on plain columns would be pushed below all projections, with every expression
    # written out again wherever it is named.
    return usual.select(*keep, *loaded, F.explode_outer(F.array(reasons)).alias("reasons"))


def rejected_lines(lines: DataFrame, id_column: str = "line_id", line: str = "raw_line") -> DataFrame:
    """``(line_id, reason)``, one row for each reason."""
    return parse_lines(lines, line).select(id_column, F.explode("reasons").alias("reason")).distinct()


def loaded_lines(lines: DataFrame, line: str = "raw_line") -> DataFrame:
    """The sound lines as catalogue records; repeated lines stay, each with its own id."""
    return parse_lines(lines, line).where(F.size("reasons") == 0).drop("reasons")
