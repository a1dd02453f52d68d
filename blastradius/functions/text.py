"""Set-valued extraction from formula and query text, as Column expressions.

Every function works inside one row: matches come as arrays that are cleaned and
de-duplicated in place, so extraction never shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from blastradius.functions.norm import blank_to_null, strip


def matches(text: Column, pattern: str, *groups: str) -> Column:
    """Array of structs, one field per named capture group, in order of appearance.

    The text is searched once; groups are read from the short matches.
    """
    return F.transform(
        all_of(text, pattern, 0),
        lambda hit: F.struct(*[F.regexp_extract(hit, pattern, n + 1).alias(g) for n, g in enumerate(groups)]),
    )


def all_of(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first_of(text: Column, pattern: str, group: int = 1) -> Column:
    return blank_to_null(F.regexp_extract(text, pattern, group))


def either(a: Column, b: Column) -> Column:
    return F.coalesce(blank_to_null(a), blank_to_null(b))


# --- Formulas ---------------------------------------------------------------------


def clean_formula(text: Column) -> Column:
    """Without comments; string literals emptied."""
    for pattern, instead in ((r"(?s)/\*.*?\*/", ""), (r"//[^\r\n]*", ""), (r'"[^"]*"', '""')):
        text = F.regexp_replace(text, pattern, instead)
    return text


def column_refs(cleaned: Column) -> Column:
    """Distinct {tbl, col} of ``'T'[C]`` and ``T[C]``."""
    found = matches(cleaned, r"(?:'([^']+)'|(\w+))\[([^\]]+)\]", "quoted", "plain", "col")
    return F.array_distinct(
        F.transform(found, lambda r: F.struct(either(r["quoted"], r["plain"]).alias("tbl"), strip(r["col"]).alias("col")))
    )


def measure_refs(cleaned: Column) -> Column:
    """Distinct names of ``[M]`` that no table precedes."""
    return F.array_distinct(F.transform(all_of(cleaned, r"(?<![\w'.])\[([^\]]+)\]"), strip))


# Functions whose first argument names a table.
TABLE_FUNCTIONS = (
    "COUNTROWS RELATEDTABLE VALUES ALL ALLEXCEPT ALLSELECTED ALLNOBLANKROW REMOVEFILTERS DISTINCT "
    "SUMMARIZE SUMMARIZECOLUMNS ADDCOLUMNS SELECTCOLUMNS FILTER CALCULATETABLE TOPN GENERATE "
    "GENERATESERIES NATURALLEFTOUTERJOIN NATURALINNERJOIN CROSSJOIN UNION INTERSECT EXCEPT TREATAS "
    "LOOKUPVALUE RELATED RANKX SAMPLE GROUPBY DATATABLE WINDOW OFFSET INDEX"
).split()
# Such a call up to the end of its first argument.
TABLE_CALL = r"(?i)(?:" + "|".join(TABLE_FUNCTIONS) + r")\s*\(\s*(?:'([^']+)'|(\w+))\s*[,)]"


def table_refs(cleaned: Column) -> Column:
    """Distinct tables named as the first argument of a table function."""
    found = matches(cleaned, TABLE_CALL, "quoted", "plain")
    return F.array_distinct(F.transform(found, lambda r: either(r["quoted"], r["plain"])))


# One row of a field parameter (caption, reference, order, group).
PARAMETER_ROW = (
    r'(?i)\(\s*"([^"]*+(?:""[^"]*+)*+)"\s*,'
    r"\s*NAMEOF\s*\(\s*(?:'([^']+)'|([^'\[\s,()]+))?\s*\[([^\]]+)\]\s*\)"
    r"(?:\s*,\s*(-?\d+))?"
    r'(?:\s*,\s*"([^"]*+(?:""[^"]*+)*+)")?'
)


def parameter_rows(body: Column) -> Column:
    """Rows of a field parameter: caption, target_table (may be null), target_name, item_order, grp."""

    def unescape(c: Column) -> Column:
        return F.replace(c, F.lit('""'), F.lit('"'))

    found = matches(body, PARAMETER_ROW, "caption", "quoted", "plain", "name", "ord", "grp")
    return F.transform(
        found,
        lambda r: F.struct(
            unescape(r["caption"]).alias("caption"),
            either(r["quoted"], r["plain"]).alias("target_table"),
            r["name"].alias("target_name"),
            blank_to_null(r["ord"]).cast("int").alias("item_order"),
            blank_to_null(unescape(r["grp"])).alias("grp"),
        ),
    )


# --- Query steps --------------------------------------------------------------------

# Navigation steps by schema and item in either order, and by name.
SCHEMA_ITEM = r'(?i)\{\s*\[\s*Schema\s*=\s*"([^"]+)"\s*,\s*Item\s*=\s*"([^"]+)"\s*\]\s*\}\s*\[Data\]'
ITEM_SCHEMA = r'(?i)\{\s*\[\s*Item\s*=\s*"([^"]+)"\s*,\s*Schema\s*=\s*"([^"]+)"\s*\]\s*\}\s*\[Data\]'
NAME_STEP = r'(?i)\{\s*\[\s*Name\s*=\s*"([^"]+)"\s*(?:,[^\]]*)?\]\s*\}\s*\[Data\]'


def navigation(m: Column) -> Column:
    """{sch, tbl, path}: the warehouse relation a query navigates to; path from the outside in."""
    by_schema = first_of(m, SCHEMA_ITEM, 2)
    by_item = first_of(m, ITEM_SCHEMA, 1)
    chain = all_of(m, NAME_STEP)
    return F.struct(
        F.when(by_schema.isNotNull(), first_of(m, SCHEMA_ITEM, 1)).otherwise(first_of(m, ITEM_SCHEMA, 2)).alias("sch"),
        F.coalesce(by_schema, by_item, F.try_element_at(chain, F.lit(-1))).alias("tbl"),
        F.when(F.coalesce(by_schema, by_item).isNull(), chain).otherwise(F.array().cast("array<string>")).alias("path"),
    )


def from_the_end(path: Column, schema: Column) -> Column:
    """{db, sch}: enclosing steps of a navigation path read from its end."""
    return F.struct(
        F.try_element_at(path, F.lit(-3)).alias("db"),
        F.coalesce(blank_to_null(schema), F.try_element_at(path, F.lit(-2))).alias("sch"),
    )


# What an argument list is made of: string literals, brackets, commas, and runs of anything else.
TOKEN = r'"[^"]*+(?:""[^"]*+)*+"|[(){}\[\],]|[^"(){}\[\],]++|"'
ADD_COLUMN = "Table.AddColumn"


def _arguments(call: Column) -> Column:
    """{second, rest}: arguments of the call whose list opens ``call``, at any depth of nesting; null if it never closes."""
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(1).alias("at"), F.lit(False).alias("done"), F.lit("").alias("second"), F.lit("").alias("rest")
    )

    def step(acc: Column, t: Column) -> Column:
        opens, closes = t.isin("(", "[", "{"), t.isin(")", "]", "}")
        depth = acc["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        over = closes & (depth <= 0)
        comma = (t == ",") & (depth == 1)
        inside = ~over & ~comma & (acc["depth"] > 0)
        read = F.struct(
            depth.alias("depth"),
            (acc["at"] + F.when(comma, 1).otherwise(0)).alias("at"),
            over.alias("done"),
            F.concat(acc["second"], F.when(inside & (acc["at"] == 2), t).otherwise("")).alias("second"),
            F.concat(acc["rest"], F.when((inside | comma) & (acc["at"] > 2), t).otherwise("")).alias("rest"),
        )
        return F.when(acc["done"], acc).otherwise(read)

    return F.aggregate(
        F.regexp_extract_all(call, F.lit(TOKEN), F.lit(0)),
        start,
        step,
        lambda acc: F.when(acc["done"], F.struct(acc["second"].alias("second"), acc["rest"].alias("rest"))),
    )


def calls(m: Column, function: str, read: Callable[[Column], Column]) -> Column:
    """What ``read`` makes of the argument list of every call of ``function``; null where it finds none.

    A list mostly ends before the next call, and then only the text up to there is
    read.  One that holds further calls is read on to the end of the text.
    """
    parts = F.split(m, function.replace(".", r"\.") + r"(?=\s*\()")

    def one(part: Column, i: Column) -> Column:
        return F.coalesce(read(part), read(F.array_join(F.slice(parts, i + 2, F.size(parts)), function)))

    return F.transform(F.slice(parts, 2, 1 << 30), one)


# A pair of old and new name, and a text literal, quotes inside it doubled.
RENAME_PAIR = r'\{\s*"((?:[^"]|"")++)"\s*,\s*"((?:[^"]|"")++)"\s*\}'
TEXT_LITERAL = r'"((?:[^"]|"")++)"'


def _plain(literal: Column) -> Column:
    return F.replace(literal, F.lit('""'), F.lit('"'))


def renames(m: Column) -> Column:
    """Distinct {source_name, model_name} pairs of all rename steps; each step has the pairs of its own list."""
    lists = F.transform(calls(m, "Table.RenameColumns", _arguments), lambda a: matches(F.coalesce(a["second"], F.lit("")), RENAME_PAIR, "old", "new"))
    pairs = F.transform(F.flatten(lists), lambda p: F.struct(_plain(p["old"]).alias("source_name"), _plain(p["new"]).alias("model_name")))
    return F.array_distinct(pairs)


def final_projection(m: Column) -> Column:
    """Columns of the last select step less those removed; null without a select step."""
    named = lambda a: F.transform(all_of(F.coalesce(a["second"], F.lit("")), TEXT_LITERAL), _plain)
    kept = named(F.try_element_at(calls(m, "Table.SelectColumns", _arguments), F.lit(-1)))
    removed = F.flatten(F.transform(calls(m, "Table.RemoveColumns", _arguments), named))
    return F.when(F.size(kept) > 0, F.filter(kept, lambda c: ~F.array_contains(removed, c)))


# A field read by plain or quoted name.
FIELD_READ = r'\[\s*(?:#"((?:[^"]|"")*)"|([A-Za-z_][A-Za-z0-9_ .]*?))\s*\]'


def added_columns(m: Column) -> Column:
    """{col, reads}: columns computed in the query and the fields each one reads."""
    named = F.transform(
        F.filter(calls(m, ADD_COLUMN, _arguments), lambda a: a.isNotNull() & a["second"].rlike(r'^\s*"[\s\S]*"\s*$')),
        lambda a: F.struct(F.regexp_extract(a["second"], r'"([\s\S]*)"', 1).alias("col"), a["rest"].alias("body")),
    )
    found = F.when(F.contains(m, F.lit(ADD_COLUMN)), named).otherwise(F.array().cast("array<struct<col:string,body:string>>"))
    return F.transform(
        found,
        lambda r: F.struct(
            r["col"].alias("col"),
            F.array_distinct(
                F.filter(
                    F.transform(
                        matches(r["body"], FIELD_READ, "quoted", "plain"),
                        lambda x: strip(either(F.replace(x["quoted"], F.lit('""'), F.lit('"')), x["plain"])),
                    ),
                    lambda name: name.isNotNull() & ~F.contains(name, F.lit("=")),
                )
            ).alias("reads"),
        ),
    )


# Merge with its keys, append with its inputs.
NESTED_JOIN = r"Table\.NestedJoin\s*\(\s*([^,\n]+),\s*\{([^}]*)\}\s*,\s*([^,\n]+),\s*\{([^}]*)\}"
COMBINE = r"Table\.Combine\s*\(\s*\{([^}]+)\}"


def merge_inputs(m: Column) -> Column:
    """Distinct {operation, step}: steps a merge or append draws on."""
    joins = matches(m, NESTED_JOIN, "left_step", "left_keys", "right_step", "right_keys")
    sides = F.flatten(F.transform(joins, lambda j: F.array(j["left_step"], j["right_step"])))
    appended = F.flatten(F.transform(all_of(m, COMBINE), lambda x: F.split(x, ",")))

    def steps(xs: Column, operation: str) -> Column:
        named = F.filter(F.transform(xs, strip), lambda s: s != "")
        return F.transform(named, lambda s: F.struct(F.lit(operation).alias("operation"), s.alias("step")))

    return F.array_distinct(F.concat(steps(sides, "NestedJoin"), steps(appended, "Combine")))


def merge_keys(m: Column) -> Column:
    """{left_step, left_keys, right_step, right_keys} of every merge, keys joined by a comma."""

    def keys(text: Column) -> Column:
        return F.array_join(all_of(text, r'"([^"]+)"'), ",")

    found = matches(m, NESTED_JOIN, "left_step", "left_keys", "right_step", "right_keys")
    return F.transform(
        found,
        lambda j: F.struct(
            strip(j["left_step"]).alias("left_step"),
            keys(j["left_keys"]).alias("left_keys"),
            strip(j["right_step"]).alias("right_step"),
            keys(j["right_keys"]).alias("right_keys"),
        ),
    )


# Words that follow FROM or JOIN without naming a table.
NOT_A_TABLE = ("SELECT", "WHERE", "ON", "AS", "SET", "VALUES", "INTO", "UPDATE", "DELETE")
# A table after FROM or JOIN, with an optional schema.
SQL_TABLE = r'(?i)\b(?:FROM|JOIN)\s+([`"\[]?[\w$]+[`"\]]?\s*\.\s*)?([`"\[]?[\w$]+[`"\]]?)'


def sql_table_refs(sql: Column) -> Column:
    """Distinct table names after FROM and JOIN, without schema and quotes."""
    names = F.transform(all_of(sql, SQL_TABLE, 2), lambda n: F.translate(n, '`"[]', ""))
    return F.array_distinct(F.filter(names, lambda n: (n != "") & ~F.upper(n).isin(*NOT_A_TABLE)))


# Connector call, kind of source, what its arguments name, and how
# many of them must be literals or parameter names.
CONNECTORS = (
    ("Sql.Database", "SQL Server", "server database", 1),
    ("Sql.Databases", "SQL Server", "server database", 1),
    ("AnalysisServices.Database", "Analysis Services", "server database", 1),
    ("OData.Feed", "OData", "url", 1),
    ("Web.Contents", "Web", "url", 1),
    ("SharePoint.Tables", "SharePoint Tables", "url", 1),
    ("SharePoint.Files", "SharePoint Files", "url", 1),
    ("Excel.Workbook", "Excel", "path", 1),
    ("Csv.Document", "CSV", "path", 1),
    ("AzureStorage.Blobs", "Azure Blob Storage", "url", 1),
    ("Dataverse.Contents", "Dataverse", "url", 0),
    ("Snowflake.Databases", "Snowflake", "server database", 1),
    ("Oracle.Database", "Oracle", "server", 1),
    ("GoogleBigQuery.Database", "Google BigQuery", "server", 0),
    ("PostgreSQL.Database", "PostgreSQL", "server database", 2),
    ("MySQL.Database", "MySQL", "server database", 2),
    ("Teradata.Database", "Teradata", "server", 1),
    ("SapHana.Database", "SAP HANA", "server", 1),
    ("Odbc.DataSource", "ODBC", "server", 1),
    ("Odbc.Query", "ODBC", "server", 1),
    ("PowerBI.Dataflows", "Power BI Dataflow", "", 0),
    ("AzureDataExplorer.Contents", "Azure Data Explorer", "server database", 1),
    ("Kusto.Contents", "Azure Data Explorer", "server database", 1),
    ("Lakehouse.Contents", "Fabric Lakehouse", "", 0),
    ("Fabric.Warehouse", "Fabric Warehouse", "server", 1),
    ("Databricks.Catalogs", "Databricks", "server", 1),
)
FILE_CALLS = ("Excel.Workbook", "Csv.Document")
_CALL = "|".join(name.replace(".", r"\.") for name, *_ in sorted(CONNECTORS, reverse=True))
_ARG = r'#?"[^"]*"'
CONNECTOR_CALL = rf"({_CALL})\s*\(\s*(File\.Contents\s*\(\s*)?({_ARG})?(?:\s*,\s*({_ARG}))?"


def _facts() -> Column:
    """Call name to {kind, takes, least}."""
    entries = []
    for name, kind, takes, least in CONNECTORS:
        entries += [
            F.lit(name),
            F.struct(F.lit(kind).alias("kind"), F.lit(takes).alias("takes"), F.lit(least).alias("least")),
        ]
    return F.create_map(*entries)


def connectors(m: Column) -> Column:
    """{kind, server, database, url, path, parameterized} of every source a query opens."""
    found = F.transform(
        matches(m, CONNECTOR_CALL, "call", "file", "arg1", "arg2"),
        lambda r: F.struct(
            F.element_at(_facts(), r["call"]).alias("fact"),
            r["call"].alias("call"),
            r["file"].alias("file"),
            r["arg1"].alias("arg1"),
            r["arg2"].alias("arg2"),
        ),
    )
    complete = F.filter(
        found,
        lambda r: (r["call"].isin(*FILE_CALLS) == (r["file"] != ""))
        & ((r["fact"]["least"] < 1) | (r["arg1"] != ""))
        & ((r["fact"]["least"] < 2) | (r["arg2"] != "")),
    )

    def arg(r: Column, slot: str, field: str) -> Column:
        bare = blank_to_null(F.translate(r[field], '#"', ""))
        return F.when(F.array_contains(F.split(r["fact"]["takes"], " "), slot), bare)

    def described(r: Column) -> Column:
        two = F.contains(r["fact"]["takes"], F.lit(" "))
        one = r["fact"]["takes"] != ""
        by_name = (one & F.startswith(r["arg1"], F.lit("#"))) | (two & F.startswith(r["arg2"], F.lit("#")))
        return F.struct(
            r["fact"]["kind"].alias("kind"),
            arg(r, "server", "arg1").alias("server"),
            arg(r, "database", "arg2").alias("database"),
            arg(r, "url", "arg1").alias("url"),
            arg(r, "path", "arg1").alias("path"),
            by_name.alias("parameterized"),
        )

    nothing = F.lit(None).cast("string")
    inline = F.struct(
        F.lit("Inline Literal").alias("kind"),
        *[nothing.alias(n) for n in ("server", "database", "url", "path")],
        F.lit(False).alias("parameterized"),
    )
    literal = F.when(m.rlike(r"Binary\.(?:Decompress|FromText)\s*\("), F.array(inline)).otherwise(F.array().cast(
        "array<struct<kind:string,server:string,database:string,url:string,path:string,parameterized:boolean>>"
    ))
    return F.concat(F.transform(complete, described), literal)


NATIVE_QUERY = "Value.NativeQuery"
# A text literal that opens an argument.
OPENING_TEXT = r'^\s*"([^"\\]*+(?:\\[\s\S][^"\\]*+)*+)"'


def _first_argument(call: Column) -> Column:
    """{first, rest}: text up to the comma that ends the first argument, at any depth of nesting, and behind it; null without one."""
    listed = F.regexp_replace(call, r"^\s*\(", "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("comma"), F.lit(False).alias("over"))

    def step(acc: Column, t: Column) -> Column:
        opens, closes = t.isin("(", "[", "{"), t.isin(")", "]", "}")
        comma = (t == ",") & (acc["depth"] == 0)
        over = closes & (acc["depth"] == 0)
        read = F.struct(
            (acc["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
            (acc["size"] + F.when(comma | over, 0).otherwise(F.length(t))).alias("size"),
            comma.alias("comma"),
            over.alias("over"),
        )
        return F.when(acc["comma"] | acc["over"], acc).otherwise(read)

    end = F.aggregate(F.regexp_extract_all(listed, F.lit(TOKEN), F.lit(0)), start, step, lambda acc: F.when(acc["comma"], acc["size"]))
    return F.when(end.isNotNull(), F.struct(F.substring(listed, F.lit(1), end).alias("first"), F.substring(listed, end + 2, F.length(listed)).alias("rest")))


def native_queries(m: Column) -> Column:
    """{connection, sql} of every query text passed through to a source."""
    named = F.transform(
        F.filter(calls(m, NATIVE_QUERY, _first_argument), lambda a: a.isNotNull() & a["rest"].rlike(OPENING_TEXT)),
        lambda a: F.struct(a["first"].alias("connection"), F.regexp_extract(a["rest"], OPENING_TEXT, 1).alias("sql")),
    )
    return F.when(F.contains(m, F.lit(NATIVE_QUERY)), named).otherwise(F.array().cast("array<struct<connection:string,sql:string>>"))


def parameter_names(m: Column) -> Column:
    """Distinct ``#"Name"`` references."""
    return F.array_distinct(all_of(m, r'#"([^"]+)"'))


# A first step that is a bare name, not a call.
FIRST_STEP = (
    r'(?i)^\s*let\s+(?:#"[^"]+"|[A-Za-z_][A-Za-z0-9_ ]*)\s*=\s*'
    r'(?:#"([^"]+)"|([A-Za-z_][A-Za-z0-9_]*))\s*(?![ \t]*\()'
)


def shared_ref(m: Column) -> Column:
    """Name of the shared query a query starts from, where its first step is a bare name."""
    body = F.coalesce(first_of(m, r"(?is)\bsource\s*=\s*(```.*|let\b.*)"), m)
    body = F.regexp_replace(F.regexp_replace(body, r"^\s*```[^\n]*\n?", ""), r"\n?```\s*$", "")
    return either(F.regexp_extract(body, FIRST_STEP, 1), F.regexp_extract(body, FIRST_STEP, 2))


def parameter_value(expression: Column) -> Column:
    """Literal of a parameter query, null for any other expression."""
    return F.when(
        expression.rlike(r"(?i)IsParameterQuery\s*=\s*true"), first_of(expression, r'"([^"]+)"\s*meta\s*\[')
    )


# Kind of a query step by how its text begins; the first that fits applies.
STEP_KINDS = (
    (
        r"(?i)^(?:Sql\.|GoogleBigQuery\.|AzureDataExplorer\.|Kusto\.|Lakehouse\.|Fabric\.|Databricks\.|Snowflake\."
        r"|PostgreSQL\.|MySQL\.|Teradata\.|SapHana\.|Odbc\.|Oracle\.|Excel\.|Csv\.|OData\.|SharePoint\.|PowerBI\.|Web\."
        r"|Value\.NativeQuery)",
        "Source",
    ),
    (r"^\w+\s*\{\s*\[", "Navigation"),
    (r"^\w+\s*\[", "Navigation"),
    (r"^Table\.SelectColumns\b", "Projection"),
    (r"^Table\.RenameColumns\b", "Rename"),
    (r"^Table\.SelectRows\b", "Filter"),
    (r"^Table\.NestedJoin\b", "Join"),
    (r"^Table\.Combine\b", "Join"),
    (r"^Table\.AddColumn\b", "AddColumn"),
    (r"^Table\.TransformColumnTypes\b", "TypeChange"),
    (r"^Table\.ExpandTableColumn\b", "Expand"),
    (r"^Table\.RemoveColumns\b", "Projection"),
    (r"^Table\.ReorderColumns\b", "Projection"),
)


def step_kind(step: Column) -> Column:
    out = F.when(step.rlike(STEP_KINDS[0][0]), STEP_KINDS[0][1])
    for pattern, kind in STEP_KINDS[1:]:
        out = out.when(step.rlike(pattern), kind)
    return out.otherwise("Custom")


# --- Model text ------------------------------------------------------------------------


def endpoint(ref: Column) -> Column:
    """{tbl, col} of ``'T'.'C'``: split at the first dot outside quotes, both sides unquoted."""

    def unquote(c: Column) -> Column:
        return F.regexp_replace(strip(c), r"(?s)^'(.*)'$", "$1")

    pattern = r"(?s)^((?:[^.']|'[^']*')*)\.(.*)$"
    dotted = ref.rlike(pattern)
    return F.struct(
        F.when(dotted, unquote(F.regexp_extract(ref, pattern, 1))).alias("tbl"),
        F.when(dotted, unquote(F.regexp_extract(ref, pattern, 2))).otherwise(unquote(ref)).alias("col"),
    )


def blocks(body: Column, header: str) -> Column:
    """The text cut before every unindented line that starts with ``header``."""
    return F.filter(
        F.split(body, rf"(?m)^(?={header})"), lambda b: F.startswith(b, F.lit(header))
    )


def property_of(block: Column, key: str) -> Column:
    """Value of the last indented ``key: value`` line of a block."""
    return F.try_element_at(all_of(block, rf"(?m)^[ \t]+{key}[ \t]*:[ \t]*(.*?)[ \t\r]*$"), F.lit(-1))


def header_name(block: Column, header: str) -> Column:
    """Name on a header line: quoted, or the first word, without anything after ``=``."""
    line = strip(F.regexp_extract(block, rf"^{header}([^=\n]*)", 1))
    return either(F.regexp_extract(line, r"^'([^']+)'", 1), F.substring_index(F.regexp_replace(line, r"\s", " "), " ", 1))


def literal_title(value: Column) -> Column:
    """A title literal without its quotes."""
    return F.regexp_replace(value, r"^['\"]|['\"]$", "")
