"""Mapping sheets: comma-separated text, headings in any case and spacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blastradius.functions.norm import strip
from blastradius.operators.match import MAPPING_COLUMNS

# One cell: plain runs and quoted runs (which may hold commas) up to the next comma.
CELL = r'(?:^|,)((?:[^,"]++|"(?:[^"]|"")*+"?)*+)'
QUOTED = r'"((?:[^"]|"")*+)"?'


def cells(line: Column) -> Column:
    """Trimmed cells of one line; a doubled quote mark inside quotes stands for one."""
    found = F.regexp_extract_all(line, F.lit(CELL), F.lit(1))
    return F.transform(
        found, lambda c: strip(F.replace(F.regexp_replace(c, QUOTED, "$1"), F.lit('""'), F.lit('"')))
    )


def heading(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), r"[\s_]+", " ")


def _lines() -> Column:
    """Lines of a sheet without blank ones."""
    return F.filter(F.split("body", r"\r?\n"), lambda x: strip(x) != "")


def _heads(lines: Column) -> Column:
    """Headings by position."""
    return F.transform(cells(F.try_element_at(lines, F.lit(1))), heading)


def _place(heads: Column, name: str) -> Column:
    """Position of a heading, the last one if it is repeated; 0 where it is missing."""
    back = F.array_position(F.reverse(heads), name)
    return F.when(back > 0, F.size(heads) - back + 1).otherwise(F.lit(0)).cast("int")


def mapping_scan(docs: DataFrame) -> DataFrame:
    """doc, row_no and the six cells of every row below the heading.

    Rows are numbered as in a sheet, the heading being row 1, after blank lines
    are dropped.
    """
    sheets = docs.select("doc", _lines().alias("lines")).withColumn("heads", _heads(F.col("lines")))
    rows = sheets.select(
        "doc",
        *[_place(F.col("heads"), head.lower()).alias(f"at_{key}") for key, head, _ in MAPPING_COLUMNS],
        F.posexplode(F.slice("lines", 2, 1 << 30)).alias("pos", "line"),
    ).withColumn("cells", cells(F.col("line")))

    def cell(key: str) -> Column:
        at = F.col(f"at_{key}")
        return F.coalesce(F.when(at > 0, F.try_element_at("cells", at)), F.lit(""))

    return rows.select("doc", (F.col("pos") + 2).cast("bigint").alias("row_no"), *[cell(k).alias(k) for k, *_ in MAPPING_COLUMNS])


def mapping_scan_errors(docs: DataFrame) -> DataFrame:
    """doc, missing: sheets without a required heading; their rows must not be used."""

    def absent(heads: Column) -> Column:
        places = [F.when(_place(heads, head.lower()) == 0, head) for _, head, required in MAPPING_COLUMNS if required]
        return F.array_join(F.array_compact(F.array(*places)), ", ")

    # Exploded, not filtered: a filter would be moved down to the given rows, with the sheet parsed anew for
    # every mention of its headings.
    missing = F.filter(F.transform(F.transform(F.array(_lines()), _heads), absent), lambda m: m != "")
    return docs.select("doc", F.explode(missing).alias("missing"))
