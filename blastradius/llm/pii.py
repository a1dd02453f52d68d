"""Personal data, and the words that give it away.

Base: addresses, numbers and phones by pattern.  Beyond them, all words of the
documents that hold a protected value are weighed by what they tell about it: over the whole corpus,
log(N n(e,t) / (n(e) n(t))) of a value ``e`` and a word ``t`` against log(N / n(e)),
the information in the value itself.  A word with at least ``GENERALISE`` of it is
generalised, one with at least ``REMOVE`` is taken out, at every place in each document
that holds the value.  Counts are of documents;
``t`` counts in all of them, and a pair seen in a single document is no estimate.

Only DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blastradius.llm.common import whole, workspace

GENERALISE, REMOVE = 0.9, 0.99
WORD = r"\p{L}+"
KINDS = ("email", "ip", "card", "phone")
LABELS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "term": "<WORD>", "drop": ""}
# Patterns of the base kinds. They never step back over what they took, and a start inside a run is tried only after
# a match, so they take the same matches as plain ones in time linear in the text.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for its pattern to be tried.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]"}
_SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.split(F.reverse(digits), "")
    worth = F.transform(back, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)))
    return F.aggregate(worth, F.lit(0), lambda s, v: s + v) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda x: (F.length(part(x)) < 3) | ((F.length(part(x)) == 3) & (part(x) <= "255")))
    if kind == "card":
        return F.when(F.length(_digits(m)).between(16, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _placed(text: Column, pattern: str, kind: str) -> Column:
    """All matches with their places: the gaps between them, from a split, give where each begins."""
    pairs = F.arrays_zip(F.split(text, pattern).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["g"])
        end = begin + F.length(x["m"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["m"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    return F.aggregate(F.filter(pairs, lambda x: x["m"].isNotNull()), start, step, lambda acc: acc["spans"])


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by kind and start."""
    out = []
    for kind in KINDS:
        spans = F.filter(_placed(text, PATTERNS[kind], kind), partial(_holds, kind))
        out.append(F.when(text.rlike(_HINTS[kind]), spans).otherwise(F.array().cast(_SPAN)))
    return F.concat(*out)


def _holds(kind: str, span: Column) -> Column:
    return _valid(kind, span["value"])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _words(text: Column) -> Column:
    """Distinct words in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def _marked(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """Per text (_d, _h): ``terms``, all places of its words in ``marks`` that lie in no base span, by kind and start.

    A row a word, its place from a running sum over the lengths before it: time and memory are linear in the text.
    """
    key = ["_d", "_h"]
    pairs = F.filter(F.arrays_zip(F.split("_t", WORD).alias("g"), F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)).alias("m")), lambda x: x["m"].isNotNull())
    sizes = F.transform(pairs, lambda x: F.struct(F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("chars"), F.lower(x["m"]).alias("word")))
    words = texts.select(*key, F.posexplode(sizes).alias("at", "x")).select(*key, "at", "x.*")
    end = F.sum(F.col("gap") + F.col("chars")).over(Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    placed = words.select(*key, "word", "chars", end.alias("end")).join(marks, [*key, "word"])
    span = F.struct("kind", (F.col("end") - F.col("chars")).alias("start"), "end", F.col("word").alias("value"))
    spans = placed.groupBy(*key).agg(F.collect_list(span).alias("spans"))
    # What lies in a base span is a part of it.
    inside = lambda w: F.exists("base", lambda s: (w["start"] < s["end"]) & (s["start"] < w["end"]))
    base = texts.select(*key, base_spans(F.col("_t")).alias("base"))
    return spans.join(base, key).select(*key, F.array_sort(F.filter("spans", lambda w: ~inside(w))).cast(_SPAN).alias("terms"))


def _key() -> list[Column]:
    return [F.coalesce("doc_id", F.lit(-1 << 63)).alias("_d"), F.xxhash64("_t").alias("_h")]


class Findings:
    """Spans of every row of ``docs``, by (doc_id, hash of the text)."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        ws = workspace(docs.sparkSession)
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("_t"))
        spanned = texts.select("doc_id", F.xxhash64("_t").alias("_h"), "_t", base_spans(F.col("_t")).alias("base"))
        # Words inside a value are no words beside it.
        words = F.when(F.size("base") > 0, _words(_replaced(F.col("_t"), F.col("base"), lambda kind: F.lit(" "))))
        self.rows = ws.save(spanned.select("doc_id", "_h", "base", words.alias("words")), "base")
        key = [F.coalesce("doc_id", F.lit(-1 << 63)).alias("_d"), F.col("_h")]
        value = F.explode(F.array_distinct(F.transform("base", lambda s: F.concat(s["kind"], F.lit(":"), F.lower(s["value"])))))
        held = self.rows.filter("size(base) > 0")
        # Repeated rows are one document in all counts.
        extra, repeated = ws.save_counted(self.rows.groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("_more")).filter("_more > 0"), "repeated")
        n = float(max(1, self.rows.count() - (extra.agg(F.sum("_more")).first()[0] or 0)))
        values = held.select(*key, value.alias("value")).distinct().groupBy("value").agg(F.count(F.lit(1)).alias("n_value"))
        # A pair in two documents takes a value in two.
        values = ws.save(values.filter((F.col("n_value") > 1) & (F.col("n_value") < n)), "values")
        shared = held.select(*key, "words", value.alias("value")).join(values, "value").dropDuplicates(["_d", "_h", "value"])
        shared = ws.save(shared, "shared")
        pairs = shared.select("value", "n_value", F.explode("words").alias("word")).groupBy("value", "n_value", "word").agg(F.count(F.lit(1)).alias("n_pair")).filter("n_pair > 1")
        everywhere = texts.select(F.explode(_words(F.col("_t"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n_word"))
        if repeated:  # the rows of a text beyond its first are taken off again
            again = texts.select(*_key(), "_t").join(extra, ["_d", "_h"]).dropDuplicates(["_d", "_h"])
            again = again.select(F.explode(_words(F.col("_t"))).alias("word"), (-F.col("_more")).alias("n_word"))
            everywhere = everywhere.unionByName(again).groupBy("word").agg(F.sum("n_word").alias("n_word"))
        told = F.log(F.lit(n) * F.col("n_pair") / (F.col("n_value") * F.col("n_word"))) / F.log(F.lit(n) / F.col("n_value"))
        kind = F.when(told >= REMOVE, "drop").when(told >= GENERALISE, "term")
        telling = pairs.join(everywhere, "word").withColumn("kind", kind).filter("kind is not null").select("value", "word", "kind")
        marks = shared.select("_d", "_h", "value", F.explode("words").alias("word")).join(telling, ["value", "word"]).groupBy("_d", "_h", "word").agg(F.min("kind").alias("kind"))
        marks = ws.save(marks, "marks")
        some = F.lit(False)
        for hint in _HINTS.values():
            some = some | F.col("_t").rlike(hint)
        told_of = texts.filter(some).select(*_key(), "_t").join(marks.select("_d", "_h").distinct(), ["_d", "_h"])
        told_of = ws.save(told_of.dropDuplicates(["_d", "_h"]), "marked-texts")
        #: One row a text with such words: ``terms``, by kind and start.
        self.terms = ws.save(_marked(told_of, marks), "terms")


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null text is empty text without a span.  Places are code points from 0, ends
    exclusive.  Each row of a repeated id gives its row; rows of one id and text
    count as one document in the statistics.
    """
    f = Findings(docs, id_col, text_col)
    d = F.coalesce("doc_id", F.lit(-1 << 63))
    rows = f.rows.drop("words").withColumn("_d", d).join(f.terms, ["_d", "_h"], "left")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.concat("base", F.coalesce("terms", F.array().cast(_SPAN)))
    return rows.select("doc_id", *[count(k) for k in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def _label(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), kind)


def _replaced(text: Column, spans: Column, label: Callable[[Column], Column] = _label) -> Column:
    """The text with each span as its label; spans that overlap are one."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, label(s["kind"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    return F.aggregate(by_start, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit((1 << 31) - 1))))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all columns; spans replaced by labels, words that tell too much generalised or removed.

    Null text stays null.  A column ``n_chars`` follows the new text.
    """
    f = Findings(docs, id_col, text_col)
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(id_col).cast("long"), F.lit(-1 << 63)).alias("_d"), F.xxhash64(whole(text_col)).alias("_h"))
    text = F.col("_row")[text_col]
    rows = rows.join(f.terms, ["_d", "_h"], "left")
    spans = F.concat(base_spans(text), F.coalesce("terms", F.array().cast(_SPAN)))
    rows = rows.select("_row", spans.alias("_spans"))
    new = F.when(F.size("_spans") > 0, _replaced(text, F.col("_spans"))).otherwise(text)
    rows = rows.select("_row", new.alias("_new"))
    kept = {c: F.col("_row")[c] for c in docs.columns} | {text_col: F.col("_new")}
    if "n_chars" in docs.columns:
        kept["n_chars"] = F.length("_new").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[c.alias(name) for name, c in kept.items()])
