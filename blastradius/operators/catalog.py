"""Edges of the BI model and the questions asked of them: who uses what, through what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blastradius.functions import text as T
from blastradius.functions.norm import norm, rename_of, strip
from blastradius.operators.closure import closure, union_all
from blastradius.operators.extract import formula_refs, values_of
from blastradius.workspace import Workspace


def column_id(tbl: Column, col: Column) -> Column:
    return F.concat(F.lit("column:"), tbl, F.lit("."), col)


def measure_id(tbl: Column, name: Column) -> Column:
    return F.concat(F.lit("measure:"), tbl, F.lit("."), name)


def table_id(tbl: Column) -> Column:
    return F.concat(F.lit("table:"), tbl)


def measure_homes(formulas: DataFrame) -> DataFrame:
    """measure, measure_home: one home per measure name, that of the last table."""
    return formulas.groupBy(F.col("name").alias("measure")).agg(F.max_by("home", "ord").alias("measure_home"))


class Formulas:
    """References of all measure formulas, resolved against the measures there are."""

    def __init__(self, ws: Workspace, formulas: DataFrame):
        self.formulas = formulas
        self.homes = measure_homes(formulas)
        columns, measures, tables = formula_refs(formulas, ["name", "home"], "expr")
        self.columns = ws.save(columns, "column-refs")
        self.measures = ws.save(measures.join(self.homes, "measure"), "measure-refs")
        self.tables = ws.save(tables, "table-refs")
        steps = self.measures.select(F.col("name").alias("src"), F.col("measure").alias("dst")).distinct()
        self.chains = (
            closure(ws, steps, name="measure-chain")
            .select(F.col("origin").alias("name"), F.col("v").alias("measure"))
            .distinct()
        )

    def chain(self) -> DataFrame:
        """name, measure, measure_home: everything a measure is computed from."""
        return self.chains.join(self.homes, "measure").select("name", "measure", "measure_home")

    def data_tables(self) -> DataFrame:
        """name, tbl: tables a measure reads, itself or through others."""
        own = self.columns.select("name", "tbl").unionByName(
            self.tables.select("name", F.col("ref_table").alias("tbl"))
        ).distinct()
        behind = self.chains.join(own.withColumnRenamed("name", "measure"), "measure").select("name", "tbl")
        return own.unionByName(behind).distinct()

    def edges(self) -> DataFrame:
        """from_id, to_id, type of every dependency of a measure."""
        me = measure_id(F.col("home"), F.col("name"))
        homes = self.formulas.select("name", "home")
        reads = self.data_tables().join(homes, "name")
        bare = homes.join(self.data_tables().select("name").distinct(), "name", "left_anti")
        parts = [
            self.columns.select(me.alias("from_id"), column_id(F.col("tbl"), F.col("col")).alias("to_id"), F.lit("references_column").alias("type")),
            self.measures.select(me.alias("from_id"), measure_id(F.col("measure_home"), F.col("measure")).alias("to_id"), F.lit("depends_on_measure").alias("type")),
            self.tables.select(me.alias("from_id"), table_id(F.col("ref_table")).alias("to_id"), F.lit("references_table").alias("type")),
            reads.select(me.alias("from_id"), table_id(F.col("tbl")).alias("to_id"), F.lit("defined_in_table").alias("type")),
            bare.select(me.alias("from_id"), table_id(F.col("home")).alias("to_id"), F.lit("defined_in_table").alias("type")),
        ]
        return union_all(parts)


def calculated_edges(columns: DataFrame, homes: DataFrame, partitions: DataFrame, tables: DataFrame) -> DataFrame:
    """from_id, to_id, type of computed columns and computed tables."""
    computed = columns.where(F.col("expr").isNotNull()).select(F.col("tbl").alias("own"), F.col("col").alias("own_col"), "expr")
    cols, measures, refs = formula_refs(computed, ["own", "own_col"], "expr")
    me = column_id(F.col("own"), F.col("own_col"))
    body = partitions.where(F.col("source_type") == "calculated").select(F.col("tbl").alias("own"), "body")
    bcols, _, brefs = formula_refs(body, ["own"], "body")
    drawn = bcols.select("own", "tbl").unionByName(brefs.select("own", F.col("ref_table").alias("tbl"))).distinct()
    return union_all(
        [
            cols.select(me.alias("from_id"), column_id(F.col("tbl"), F.col("col")).alias("to_id"), F.lit("references_column").alias("type")),
            measures.join(homes, "measure").select(
                me.alias("from_id"), measure_id(F.col("measure_home"), F.col("measure")).alias("to_id"), F.lit("depends_on_measure").alias("type")
            ),
            refs.select(me.alias("from_id"), table_id(F.col("ref_table")).alias("to_id"), F.lit("references_table").alias("type")),
            drawn.where(F.col("tbl") != F.col("own"))
            .join(tables.select("tbl"), "tbl", "left_semi")
            .select(table_id(F.col("own")).alias("from_id"), table_id(F.col("tbl")).alias("to_id"), F.lit("derived_from_table").alias("type")),
        ]
    )


def merge_edges(steps: DataFrame, tables: DataFrame) -> DataFrame:
    """tbl, other: a table whose query merges or appends another model table."""
    bare = F.regexp_replace("step", r'^#"(.+)"$', "$1")
    return (
        steps.select("tbl", bare.alias("other"))
        .join(tables.select(F.col("tbl").alias("other")), "other", "left_semi")
        .where(F.col("tbl") != F.col("other"))
        .select("tbl", "other")
        .distinct()
    )


def shared_lineage(ws: Workspace, shared: DataFrame) -> DataFrame:
    """name, sch, tbl, path: the relation at the end of every chain of shared queries."""
    step = shared.select("name", T.shared_ref(F.col("expr")).alias("ref")).join(
        shared.select(F.col("name").alias("ref")), "ref", "left_semi"
    )
    ends = shared.join(step, "name", "left_anti").select(F.col("name").alias("end"), T.navigation(F.col("expr")).alias("nav"))
    chain = closure(ws, step.select(F.col("name").alias("src"), F.col("ref").alias("dst")), name="shared")
    to_end = chain.select(F.col("origin").alias("name"), F.col("v").alias("end")).unionByName(
        shared.select("name", F.col("name").alias("end"))
    )
    return to_end.join(ends, "end").select("name", "nav.*")


def physical_columns(columns: DataFrame, physical: DataFrame, queries: DataFrame) -> DataFrame:
    """tbl, col, sch, phys_table, phys_col: warehouse column behind every BI column not computed."""
    renamed = (
        queries.select("tbl", F.posexplode(T.renames(F.col("m"))).alias("pos", "r"))
        .groupBy("tbl", F.col("r.model_name").alias("col"))
        .agg(F.max_by("r.source_name", "pos").alias("source_name"))
    )
    return (
        columns.where(F.col("expr").isNull())
        .join(physical, "tbl")
        .join(renamed, ["tbl", "col"], "left")
        .select("tbl", "col", "sch", "phys_table", F.coalesce("source_name", "col").alias("phys_col"))
    )


# --- Fields of visuals ------------------------------------------------------------------


def _measures_by_key(formulas: DataFrame) -> DataFrame:
    return formulas.groupBy(norm(F.col("home")).alias("tkey"), norm(F.col("name")).alias("fkey")).agg(
        F.min(F.struct("home", "name")).alias("m")
    )


def _columns_by_key(columns: DataFrame) -> DataFrame:
    return columns.groupBy(norm(F.col("tbl")).alias("tkey"), norm(F.col("col")).alias("fkey")).agg(
        F.min(F.struct("tbl", "col")).alias("c")
    )


def field_resolve(uses: DataFrame, formulas: DataFrame, columns: DataFrame) -> DataFrame:
    """Adds node_kind, node_table, node_name to uses (type, tbl, field); null where the model has no such field."""
    keyed = uses.withColumn("tkey", norm(F.col("tbl"))).withColumn("fkey", norm(F.col("field")))
    joined = keyed.join(_measures_by_key(formulas), ["tkey", "fkey"], "left").join(
        _columns_by_key(columns), ["tkey", "fkey"], "left"
    )
    is_measure = F.col("type") == "measure"
    found = F.when(is_measure, F.col("m").isNotNull()).otherwise(F.col("c").isNotNull())
    return joined.select(
        *uses.columns,
        F.when(found, F.when(is_measure, "measure").otherwise("column")).alias("node_kind"),
        F.when(is_measure, F.col("m.home")).otherwise(F.col("c.tbl")).alias("node_table"),
        F.when(is_measure, F.col("m.name")).otherwise(F.col("c.col")).alias("node_name"),
    )


def broken_refs(uses: DataFrame, formulas: DataFrame, columns: DataFrame, tables: DataFrame, expanded: DataFrame) -> DataFrame:
    """visual, page, field, kind, reason for uses of what the model does not hold.

    Spelling case alone breaks nothing.  A hierarchy stands for its table; columns
    of ``expanded`` tables (calculation groups, field parameters) stand for their items.
    """
    direct = uses.select("visual", "page", "type", "tbl", "field").distinct().join(expanded, "tbl", "left_anti")
    fields = field_resolve(direct.where(F.col("type") != "hierarchy"), formulas, columns).where(F.col("node_kind").isNull())
    known = tables.select(norm(F.col("tbl")).alias("tkey")).distinct()
    hierarchies = direct.where(F.col("type") == "hierarchy").withColumn("tkey", norm(F.col("tbl"))).join(known, "tkey", "left_anti")

    def reason(kind: Column) -> Column:
        return F.concat(F.lit("the "), kind, F.lit(" does not exist in the semantic model"))

    return fields.select(
        "visual",
        "page",
        F.concat("tbl", F.lit("["), "field", F.lit("]")).alias("field"),
        F.col("type").alias("kind"),
        reason(F.col("type")).alias("reason"),
    ).unionByName(
        hierarchies.select("visual", "page", F.col("tbl").alias("field"), F.lit("table").alias("kind"), reason(F.lit("table")).alias("reason")).distinct()
    )


def parameter_items(items: DataFrame, formulas: DataFrame, columns: DataFrame) -> DataFrame:
    """Adds target_kind, node_table, node_name; a row without a table names a measure."""
    by_name = formulas.groupBy(norm(F.col("name")).alias("fkey")).agg(F.min(F.struct("home", "name")).alias("n"))
    joined = (
        items.withColumn("tkey", norm(F.col("target_table")))
        .withColumn("fkey", norm(F.col("target_name")))
        .join(_columns_by_key(columns), ["tkey", "fkey"], "left")
        .join(_measures_by_key(formulas), ["tkey", "fkey"], "left")
        .join(by_name, "fkey", "left")
    )
    bare = F.col("target_table").isNull()
    measure = F.when(bare, F.col("n")).otherwise(F.col("m"))
    return joined.select(
        *items.columns,
        F.when(F.col("c").isNotNull(), "column").when(measure.isNotNull(), "measure").alias("target_kind"),
        F.coalesce("c.tbl", measure["home"]).alias("node_table"),
        F.coalesce("c.col", measure["name"]).alias("node_name"),
    )


def parameter_edges(resolved: DataFrame) -> DataFrame:
    """From every field a parameter offers to the display column of the parameter."""
    return (
        resolved.where(F.col("target_kind").isNotNull())
        .select("target_kind", "node_table", "node_name", F.col("param").alias("target"), F.col("param").alias("target_column"))
        .distinct()
    )


def parameter_visuals(resolved: DataFrame, uses: DataFrame) -> DataFrame:
    """From every field a parameter offers to every visual on that parameter.

    The product of fields and visuals is the result itself; walks reach the same
    visuals in two hops over ``parameter_edges`` and do not need it.
    """
    offered = resolved.where(F.col("target_kind").isNotNull()).select("param", "target_kind", "node_table", "node_name").distinct()
    on = uses.select(F.col("tbl").alias("param"), "visual").distinct()
    return offered.join(on, "param").select(
        "target_kind", "node_table", "node_name", "visual", F.col("param").alias("via_parameter")
    )


def shown_rows(selections: DataFrame, items: DataFrame) -> DataFrame:
    """visual, param, shown: caption of the row each visual was saved on."""
    at = items.select("param", F.col("item_order").alias("selected"), F.col("caption").alias("shown"))
    return selections.join(at, ["param", "selected"]).select("visual", "param", "shown")


def page_edges(edges: DataFrame, on_page: DataFrame) -> DataFrame:
    """Every data edge of a visual repeated to its page, once."""
    return (
        edges.select("src", "sc", F.col("dst").alias("visual"))
        .join(on_page, "visual")
        .select("src", "sc", "page")
        .distinct()
    )


def modifies_measure(uses: DataFrame, calc_items: DataFrame, resolved_items: DataFrame) -> DataFrame:
    """tbl, item, measure_table, measure: calculation items and the measures beside them on a visual.

    Groups meet measures first and items join the distinct pairs afterwards, so a
    busy visual costs groups times measures, not items times uses.
    """
    groups = calc_items.select("tbl").distinct()
    columns = uses.where(F.col("type") == "column").select("visual", "tbl").distinct()
    on_visual = columns.join(groups, "tbl", "left_semi").select("visual", F.col("tbl").alias("grp"))
    direct = uses.where(F.col("type") == "measure").select("visual", F.col("tbl").alias("measure_table"), F.col("field").alias("measure"))
    offered = resolved_items.where(F.col("target_kind") == "measure").select(
        F.col("param").alias("tbl"), F.col("node_table").alias("measure_table"), F.col("node_name").alias("measure")
    )
    swapped = columns.join(groups, "tbl", "left_anti").join(offered, "tbl").select("visual", "measure_table", "measure")
    measures = direct.unionByName(swapped).distinct()
    pairs = on_visual.join(measures, "visual").select(F.col("grp").alias("tbl"), "measure_table", "measure").distinct()
    return pairs.join(calc_items, "tbl").select("tbl", "item", "measure_table", "measure")


def field_usage(uses: DataFrame) -> DataFrame:
    """Per field: its uses, and the visuals and pages they are on."""
    field = ["type", "tbl", "field"]
    per_visual = uses.groupBy(*field, "page", "visual").agg(F.count(F.lit(1)).alias("uses"))
    per_page = per_visual.groupBy(*field, "page").agg(F.sum("uses").alias("uses"), F.count(F.lit(1)).alias("visuals"))
    return per_page.groupBy(*field).agg(
        F.sum("uses").alias("uses"), F.sum("visuals").alias("visuals"), F.count(F.lit(1)).alias("pages")
    )


def usage_of_tables(uses: DataFrame) -> DataFrame:
    """tbl, page, visual: visuals that use any field of a table."""
    return uses.select("tbl", "page", "visual").distinct()


def top_measures(uses: DataFrame, n: int = 5) -> DataFrame:
    return (
        uses.where(F.col("type") == "measure")
        .groupBy("tbl", "field")
        .agg(F.countDistinct("visual").alias("visuals"), F.countDistinct("page").alias("pages"))
        .orderBy(F.desc("visuals"), F.desc("pages"), "tbl", "field")
        .limit(n)
    )


def field_renames(uses: DataFrame) -> DataFrame:
    """page, visual, field, shown_as, role of every field shown under another name."""
    return (
        uses.withColumn("shown_as", rename_of(F.col("display"), F.col("field")))
        .where(F.col("shown_as").isNotNull())
        .select("page", "visual", "type", "tbl", "field", "shown_as", "role")
        .distinct()
    )


def alias_index(uses: DataFrame, formulas: DataFrame, columns: DataFrame, resolved_items: DataFrame) -> DataFrame:
    """Labels a field is read under, apart by where the label is authored.

    node_kind, node_table, node_name, alias, origin, parameter, visuals.
    """
    renamed = field_resolve(field_renames(uses), formulas, columns).where(F.col("node_kind").isNotNull())
    by_visual = renamed.select(
        "node_kind", "node_table", "node_name", F.col("shown_as").alias("alias"), F.lit("visual").alias("origin"),
        F.lit(None).cast("string").alias("parameter"), F.struct("page", "visual").alias("at"),
    )
    captions = resolved_items.where(F.col("target_kind").isNotNull()).withColumn("alias", strip(F.col("caption")))
    differs = captions.where((F.col("alias") != "") & (norm(F.col("alias")) != norm(F.col("node_name"))))
    on = uses.select(F.col("tbl").alias("param"), F.struct("page", "visual").alias("at")).distinct()
    by_parameter = differs.join(on, "param", "left").select(
        F.col("target_kind").alias("node_kind"), "node_table", "node_name", "alias", F.lit("parameter").alias("origin"),
        F.col("param").alias("parameter"), "at",
    )
    return (
        by_visual.unionByName(by_parameter)
        .groupBy("node_kind", "node_table", "node_name", "alias", "origin", "parameter")
        .agg(F.countDistinct("at").alias("visuals"))
    )


# --- Impact inside the BI model ---------------------------------------------------------


def measure_visuals(f: Formulas, uses: DataFrame) -> DataFrame:
    """measure, page, visual, via: visuals of a measure, via the first dependent where it is not used itself."""
    used = (
        uses.where(F.col("type") == "measure")
        .select("page", "visual", F.col("tbl").alias("measure_home"), F.col("field").alias("user"))
        .distinct()
    )
    homes = f.homes.withColumnRenamed("measure", "user")
    shown = used.join(homes, ["user", "measure_home"]).select("user", "page", "visual")
    order = f.formulas.groupBy(F.col("name").alias("user")).agg(F.min("ord").alias("ord"))
    itself = f.homes.select("measure", F.col("measure").alias("user"), F.lit(-1).cast("bigint").alias("ord"))
    dependents = f.measures.select("measure", F.col("name").alias("user")).distinct().join(order, "user").where(
        F.col("user") != F.col("measure")
    ).select("measure", "user", "ord")
    first = (
        itself.unionByName(dependents)
        .join(shown, "user")
        .groupBy("measure", "page", "visual")
        .agg(F.min(F.struct("ord", "user")).alias("by"))
    )
    return first.select("measure", "page", "visual", F.when(F.col("by.ord") >= 0, F.col("by.user")).alias("via"))


def measure_dependents(f: Formulas) -> DataFrame:
    """measure, dependent, dependent_home: one level."""
    return (
        f.measures.select("measure", F.col("name").alias("dependent"))
        .distinct()
        .join(f.homes.select(F.col("measure").alias("dependent"), F.col("measure_home").alias("dependent_home")), "dependent")
        .select("measure", "dependent", "dependent_home")
    )


def column_visuals(f: Formulas, uses: DataFrame, columns: DataFrame, by_measure: DataFrame) -> DataFrame:
    """tbl, col, page, visual, via: visuals of a column, via the first measure that reads it where not used itself."""
    known = columns.select("tbl", "col").distinct()
    direct = (
        uses.where(F.col("type") == "column")
        .select("tbl", F.col("field").alias("col"), "page", "visual")
        .distinct()
        .join(known, ["tbl", "col"], "left_semi")
        .select("tbl", "col", "page", "visual", F.lit(-1).cast("bigint").alias("ord"), F.lit(None).cast("string").alias("by"))
    )
    order = f.formulas.groupBy("name").agg(F.min("ord").alias("ord"))
    reading = f.columns.select("tbl", "col", "name").distinct().join(known, ["tbl", "col"], "left_semi").join(order, "name")
    through = reading.join(by_measure.select(F.col("measure").alias("name"), "page", "visual"), "name").select(
        "tbl", "col", "page", "visual", "ord", F.col("name").alias("by")
    )
    first = (
        direct.unionByName(through).groupBy("tbl", "col", "page", "visual").agg(F.min(F.struct("ord", "by")).alias("first"))
    )
    return first.select("tbl", "col", "page", "visual", F.col("first.by").alias("via"))


def partial_key_leads(left: DataFrame, right: DataFrame) -> DataFrame:
    """pid, source_key: rows of (pid, low, s) and (low, s, source_key) of one name whose schemas agree or are not given.

    Rows that both name a schema meet on name and schema, so a name in very many
    schemas is no product.  A row without one meets the rows of its name by
    definition; of these, each source counts once a name.
    """
    both = left.where(F.col("s").isNotNull()).join(right.where(F.col("s").isNotNull()), ["low", "s"]).select("pid", "source_key")
    open_sources = right.where(F.col("s").isNull()).select("low", "source_key").distinct()
    any_schema = left.where(F.col("s").isNotNull()).join(open_sources, "low").select("pid", "source_key")
    of_name = left.where(F.col("s").isNull()).join(right.select("low", "source_key").distinct(), "low").select("pid", "source_key")
    return union_all([both, any_schema, of_name]).distinct()


class Consumers:
    """What the BI model builds on every source: tables, measures, visuals, pages."""

    def __init__(self, ws: Workspace, f: Formulas, uses: DataFrame, columns: DataFrame, sources: DataFrame):
        self.tables = sources.select("source_key", "tbl").distinct()
        known = columns.select("tbl", "col").distinct()
        by_column = f.columns.join(known, ["tbl", "col"], "left_semi").select("name", "home", "tbl")
        homes = f.formulas.select("name", "home")
        reads = f.data_tables().join(homes, "name").select("name", "home", "tbl")
        named = f.tables.select("name", "home", F.col("ref_table").alias("tbl"))
        bare = homes.join(f.data_tables().select("name").distinct(), "name", "left_anti").select("name", "home", F.col("home").alias("tbl"))
        measures = union_all([by_column, reads, named, bare]).distinct()
        self.measures = ws.save(self.tables.join(measures, "tbl").select("source_key", "name", "home").distinct(), "source-measures")
        used_measures = (
            uses.where(F.col("type") == "measure")
            .select(F.col("tbl").alias("home"), F.col("field").alias("name"), "page", "visual")
            .distinct()
            .join(homes, ["home", "name"], "left_semi")
        )
        used_columns = (
            uses.where(F.col("type") == "column")
            .select("tbl", F.col("field").alias("col"), "page", "visual")
            .distinct()
            .join(known, ["tbl", "col"], "left_semi")
            .select("tbl", "page", "visual")
        )
        on_table = used_columns.unionByName(used_measures.select(F.col("home").alias("tbl"), "page", "visual")).distinct()
        self.visuals = ws.save(
            self.tables.join(on_table, "tbl")
            .select("source_key", "page", "visual")
            .unionByName(self.measures.join(used_measures, ["home", "name"]).select("source_key", "page", "visual"))
            .distinct(),
            "source-visuals",
        )

    def counts(self) -> DataFrame:
        """source_key, tables, measures, visuals, pages."""
        one = F.count(F.lit(1))
        return (
            self.tables.groupBy("source_key").agg(one.alias("tables"))
            .join(self.measures.groupBy("source_key").agg(one.alias("measures")), "source_key", "left")
            .join(
                self.visuals.groupBy("source_key").agg(one.alias("visuals"), F.countDistinct("page").alias("pages")),
                "source_key",
                "left",
            )
            .na.fill(0)
        )

    def physical(self, physical_tables: DataFrame) -> DataFrame:
        """sch, phys_table, model_table, visuals, measures over all sources of a physical table.

        A relation reached through one source has that source's counts; only one
        that several sources lead to is counted over their union.
        """
        at = physical_tables.join(self.tables, "tbl").select("tbl", "sch", "phys_table", "source_key")
        key = ["sch", "phys_table"]
        named = at.groupBy(*key).agg(F.min("tbl").alias("model_table")).withColumn("pid", F.struct(*key))
        left = named.select("pid", F.lower("phys_table").alias("low"), F.lower("sch").alias("s"))
        right = at.select(F.lower("phys_table").alias("low"), F.lower("sch").alias("s"), "source_key").distinct()
        leads = partial_key_leads(left, right)
        several = leads.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
        one = leads.join(several.where(F.col("n") == 1), "pid").join(self.counts(), "source_key").select("pid", "visuals", "measures")
        many = leads.join(several.where(F.col("n") > 1), "pid")
        visuals = many.join(self.visuals, "source_key").groupBy("pid").agg(F.countDistinct("page", "visual").alias("visuals"))
        measures = many.join(self.measures, "source_key").groupBy("pid").agg(F.countDistinct("home", "name").alias("measures"))
        merged = many.select("pid").distinct().join(visuals, "pid", "left").join(measures, "pid", "left").na.fill(0)
        return named.join(one.unionByName(merged), "pid").drop("pid")


def top_sources(physical: DataFrame, n: int = 5) -> DataFrame:
    return physical.orderBy(F.desc("visuals"), F.desc("measures"), "sch", "phys_table").limit(n)


#: What a visual is built from.
KINDS = ("measure", "chained measure", "column", "calculation item", "parameter item", "table", "source")
#: Things of one key in one list; a key with more has several lists.
LISTED = 1024


def _thing(kind: str, name: Column | str) -> Column:
    """A kind and a name in one text, led by a letter for the kind, a capital one where there is no name."""
    letter = chr(ord("a") + KINDS.index(kind))
    return F.coalesce(F.concat(F.lit(letter), F.col(name) if isinstance(name, str) else name), F.lit(letter.upper()))


def _kind_and_name(thing: Column) -> tuple[Column, Column]:
    letter = F.ascii(thing)
    place = letter.bitwiseOR(F.lit(32)) - ord("a") + 1
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), place)
    return kind.alias("kind"), F.when(letter >= ord("a"), F.substring(thing, 2, 1 << 30)).alias("name")


def _in_brackets(tbl: str, col: str) -> Column:
    return F.concat(tbl, F.lit("["), col, F.lit("]"))


def _listed(ws: Workspace, things: DataFrame, most: int) -> DataFrame:
    """role, key, alone, things: what ``things`` (role, key, alone, thing) has for a key, in lists of about ``most`` at most."""
    key = ["key", "role"]  # in this order: rows are told apart by their first bytes when they are sorted
    things = ws.save(things, "lineage-things")
    many = things.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    part = F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("thing"), F.ceil(F.col("n") / most))).otherwise(F.lit(0))
    parts = things.join(many, key, "left").withColumn("part", part)
    # A null thing is not collected; a key without any has an empty list.
    return parts.groupBy(*key, "part").agg(F.bool_and("alone").alias("alone"), F.collect_set("thing").alias("things")).drop("part")


def visual_lineage(
    ws: Workspace, f: Formulas, uses: DataFrame, calc_items: DataFrame, resolved_items: DataFrame, params: DataFrame, sources: DataFrame,
    listed: int = LISTED,
) -> DataFrame:
    """visual, kind, name: measures, chained measures, columns, items, tables and sources behind a visual.

    What a measure or a table brings is listed once.  Uses are read once and meet
    these lists under two keys at most, the measure and the table; a visual's rows
    are then brought together once and spelled and made unique where they are.
    """
    groups = calc_items.select("tbl").distinct()
    opens = sources.select("tbl", "source_key").distinct()
    data = f.data_tables()
    chain = f.chain()
    offered = resolved_items.where(F.col("target_kind").isNotNull()).select(
        F.col("param").alias("tbl"), "target_kind", "node_table", "node_name"
    ).distinct()
    offered_tables = offered.where(F.col("target_kind") == "column").select("tbl", F.col("node_table").alias("data")).unionByName(
        offered.where(F.col("target_kind") == "measure")
        .select("tbl", F.col("node_name").alias("name"))
        .join(data.withColumnRenamed("tbl", "data"), "name")
        .select("tbl", "data")
    )
    homes = chain.select("name", F.col("measure_home").alias("tbl")).join(params, "tbl", "left_anti").select("name", "tbl")
    # Tables a key stands on beside the one that a use names itself.
    stands = union_all(
        [
            data.unionByName(homes).select(F.lit("measure").alias("role"), F.col("name").alias("key"), "tbl"),
            offered_tables.select(F.lit("column").alias("role"), F.col("tbl").alias("key"), F.col("data").alias("tbl")),
            groups.select(F.lit("column").alias("role"), F.col("tbl").alias("key"), "tbl"),
        ]
    ).distinct()
    named = opens.join(params, "tbl", "left_anti")

    def part(df: DataFrame, role: str, key: str, thing: Column, alone: bool = True) -> DataFrame:
        return df.select(F.lit(role).alias("role"), F.col(key).alias("key"), F.lit(alone).alias("alone"), thing.alias("thing"))

    def of(df: DataFrame, thing: Column) -> DataFrame:
        return df.select("role", "key", (F.col("role") == "measure").alias("alone"), thing.alias("thing"))

    nothing = F.lit(None).cast("string")
    things = union_all(
        [
            part(chain, "measure", "name", _thing("chained measure", _in_brackets("measure_home", "measure"))),
            of(stands, _thing("table", "tbl")),
            of(stands.join(opens, "tbl"), _thing("source", "source_key")),
            part(named, "home", "tbl", _thing("source", "source_key")),
            part(named.join(groups, "tbl", "left_anti"), "column", "tbl", _thing("source", "source_key")),
            part(calc_items, "column", "tbl", _thing("calculation item", _in_brackets("tbl", "item")), alone=False),
            part(offered, "column", "tbl", _thing("parameter item", _in_brackets("node_table", "node_name")), alone=False),
            part(params, "home", "tbl", nothing, alone=False),
            part(params, "column", "tbl", nothing, alone=False),
        ]
    )
    is_measure = F.col("type") == "measure"
    keys = F.when(
        is_measure,
        F.array(F.struct(F.lit("measure").alias("role"), F.col("field").alias("key")), F.struct(F.lit("home").alias("role"), F.col("tbl").alias("key"))),
    ).otherwise(F.array(F.struct(F.lit("column").alias("role"), F.col("tbl").alias("key"))))
    keyed = uses.where(F.col("type").isNotNull()).select("visual", "tbl", "field", F.explode(keys).alias("k")).select("visual", "tbl", "field", "k.*")
    met = keyed.join(_listed(ws, things, listed), ["key", "role"], "left")
    itself = _in_brackets("tbl", "field")
    plain = F.coalesce("alone", F.lit(True))  # no parameter or calculation group, which stand for their items
    own = (
        F.when(F.col("role") == "measure", F.array(_thing("measure", itself)))
        .when(~plain, F.array().cast("array<string>"))
        .when(F.col("role") == "home", F.array(_thing("table", "tbl")))
        .otherwise(F.array(_thing("column", itself), _thing("table", "tbl")))
    )
    brought = met.select("visual", F.when(F.col("things").isNull(), own).otherwise(F.concat(own, "things")).alias("things"))
    things = brought.repartition("visual").select("visual", F.explode("things").alias("thing")).distinct()
    return things.select("visual", *_kind_and_name(F.col("thing")))


def field_lineage(f: Formulas, sources: DataFrame) -> DataFrame:
    """name, kind, item: tables a measure stands on (home, refs, homes of its chain) and their sources."""
    tables = union_all(
        [
            f.formulas.select("name", F.col("home").alias("tbl")),
            f.columns.select("name", "tbl"),
            f.tables.select("name", F.col("ref_table").alias("tbl")),
            f.chain().select("name", F.col("measure_home").alias("tbl")),
        ]
    ).distinct()
    opened = tables.join(sources.select("tbl", "source_key").distinct(), "tbl").select("name", "source_key").distinct()
    return tables.select("name", F.lit("table").alias("kind"), F.col("tbl").alias("item")).unionByName(
        opened.select("name", F.lit("source").alias("kind"), F.col("source_key").alias("item"))
    )


def expression_consumers(ws: Workspace, queries: DataFrame, shared: DataFrame) -> DataFrame:
    """name, tbl: tables whose query reaches a shared query by name, through others too."""
    names = shared.select("name").distinct()

    def mentioned(text: Column) -> Column:
        return F.array_union(T.all_of(text, r'#"([^"]+)"'), T.all_of(text, r"\b(\w+)\b"))

    inside = values_of(shared.select(F.col("name").alias("src"), "expr"), ["src"], mentioned(F.col("expr")), "name")
    steps = inside.join(names, "name", "left_semi").select("src", F.col("name").alias("dst")).distinct()
    first = values_of(queries, ["tbl"], mentioned(F.col("m")), "name").join(names, "name", "left_semi").select("tbl", "name").distinct()
    first = ws.save(first, "expression-seeds")
    seeds = first.select(F.col("tbl").alias("origin"), F.col("name").alias("v"))
    further = closure(ws, steps, seeds, name="expressions").select(F.col("v").alias("name"), F.col("origin").alias("tbl"))
    return first.select("name", "tbl").unionByName(further).distinct()
