"""Quality rules whose cutoffs are certified on labelled documents.

Every text is measured.  A rule is one ratio of these measures and a list of cutoffs,
from lenient to strict, that is stated and not fitted.  In each stratum (a language)
the documents that are labelled good are a holdout: a cutoff that would reject k of
its n good documents is certified if a binomial of n draws at the rule's share of the
risk gives k or fewer only with a probability of at most its share of ``MISS``.  The
sum of the binomial is exact, no normal approximation.  The cutoffs of a rule are
tested in their order and testing ends at the first that fails, which needs no
correction; over rules and strata the level is divided (Bonferroni), and the risk is
divided over the rules.  So with probability 1 - ``MISS`` no stratum loses more than
``RISK`` of its good documents to the rules, all rules together.

Of the certified cutoffs that find bad documents far more often than good ones, a rule
takes the most lenient that finds nearly all that the strictest of them finds.  All
certified ones hold at once, so this choice costs nothing; a rule without one, or with
too few labels, stays off.

Only DataFrame operations.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blastradius.llm.common import whole, workspace

#: Share of a stratum's good documents that all rules may reject, and the probability that this fails anywhere.
RISK, MISS = 0.02, 0.05
#: A cutoff is of use if it finds so many times the share of bad documents that it loses of good ones; of 100 bad
#: documents that the best certified cutoff of use finds, the one taken finds so many.
LIFT, NEARLY_ALL = 10, 98
#: Rule, what is compared with what, in thousandths: a text breaks the rule above (or below, for "<") the cutoff.
RULES: tuple[tuple[str, str, str, str, tuple[int, ...]], ...] = (
    ("symbols", "n_symbols", ">", "word_chars", (400, 300, 200, 150, 100, 80, 60, 40, 30, 20, 10)),
    ("repeated_lines", "n_dup_lines", ">", "n_lines", (900, 800, 700, 650, 600, 550, 500, 450, 400, 350, 300)),
    ("repeated_words", "n_repeat_words", ">", "n_words", (480, 450, 400, 350, 300, 250, 200, 150, 100)),
    ("long_words", "word_chars", ">", "n_words", (20_000, 16_000, 14_000, 12_000, 11_000, 10_000, 9_000, 8_500, 8_000)),
    ("short_words", "word_chars", "<", "n_words", (1_500, 2_000, 2_500, 2_750, 3_000, 3_250)),
)
#: Rows of the table of cutoffs that are broadcast at most; a larger one is joined by a shuffle.
BROADCAST_ROWS = 10_000
WORD = r"[^\x20\x09-\x0D]+"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _repeats(words: Column) -> Column:
    """Words in windows of three that are found twice or more, the first time included."""

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), p - F.get(at, i - 1)))), F.lit(0), lambda a, x: a + x)

    def twice(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda w, x, i: F.coalesce(F.get(w, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(w, i + 1)["h"] == x["h"], F.lit(False))
        at = _let(placed, lambda w: F.sort_array(F.transform(F.filter(w, lambda x, i: same(w, x, i)), lambda x: x["i"])))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_let(at, covered))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, 0).otherwise(_let(windows, twice))


def measured(docs: DataFrame, text_col: str = "text", row: Column | None = None) -> DataFrame:
    """``_row`` and the measures of each row's text; null text is empty.

    Texts are read whole and nothing is shuffled.  A window of three words is known by a 64-bit hash.
    """
    text = whole(text_col)
    words = _let(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeats(w).alias("repeats")),
    )
    lines = _let(
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct")),
    )
    found = docs.select((row if row is not None else F.struct("*")).alias("_row"), words.alias("_w"), lines.alias("_l"), F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).alias("_s"))
    values = (F.col("_w.n"), F.col("_w.chars"), F.col("_s"), F.col("_l.n") - F.col("_l.distinct"), F.col("_w.repeats"), F.col("_l.n"))
    return found.select("_row", *[v.cast("long").alias(name) for v, name in zip(values, MEASURES, strict=True)])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _beyond(rule: tuple, cutoff: Column) -> Column:
    _, over, way, under, _ = rule
    left, right = 1000 * F.col(over), cutoff * F.col(under)
    return left > right if way == ">" else left < right


def _log_factorial(x: Column) -> Column:
    """Natural logarithm of x!, by table below 10 and by Stirling's series beyond; good to twelve digits."""
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(10)])
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    large = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + series
    return F.when(x < 10, F.get(small, x.cast("int"))).otherwise(large)


def binomial_at_most(k: Column, n: Column, share: float) -> Column:
    """Probability of at most ``k`` of ``n`` at ``share``; 1 above the mean, where no test can pass.

    Terms that are left out lie sixty deviations below and are smaller than any double.
    """
    first = F.greatest(F.lit(0).cast("long"), k - F.ceil(60 * F.sqrt(n * share) + 60))
    term = lambda i: F.exp(_log_factorial(n) - _log_factorial(i) - _log_factorial(n - i) + i * math.log(share) + (n - i) * math.log1p(-share))
    total = F.aggregate(F.sequence(first, k), F.lit(0.0), lambda a, i: a + term(i))
    return F.when(k > n * share, 1.0).otherwise(total)


def cutoffs(labelled: DataFrame, risk: float = RISK, miss: float = MISS) -> DataFrame:
    """(stratum, rule, place, cutoff, n_good, n_bad, k_good, n_bad_found, probability, certified, useful, taken).

    ``labelled``: stratum, good and the measures of labelled documents.  One row a
    stratum, rule and cutoff: a small table, made from counts that are combined
    before they are shuffled.
    """
    each = []
    for rule in RULES:
        broken = F.filter(F.array(*[F.lit(c) for c in rule[4]]), lambda c: _beyond(rule, c))  # noqa: B023
        each.append(F.struct(F.lit(rule[0]).alias("rule"), (len(rule[4]) - F.size(broken)).alias("place")))
    # A text beyond the cutoff at some place is beyond all stricter, later ones.
    levels = labelled.select("stratum", "good", F.explode(F.array(*each)).alias("x")).groupBy("stratum", "x.rule", "x.place").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    grid = F.array(*[F.struct(F.lit(r[0]).alias("rule"), F.lit(i).alias("place"), F.lit(c).alias("cutoff")) for r in RULES for i, c in enumerate(r[4])])
    strata = labelled.groupBy("stratum").agg(F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"))
    level = miss / (len(RULES) * max(1, strata.count()))
    table = strata.select("*", F.explode(grid).alias("g")).select("stratum", "n_good", "n_bad", "g.*").join(levels, ["stratum", "rule", "place"], "left")
    rule = Window.partitionBy("stratum", "rule")
    upto = rule.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    sums = table.select("stratum", "rule", "place", "cutoff", "n_good", "n_bad", *[F.coalesce(F.sum(c).over(upto), F.lit(0).cast("long")).alias(name) for c, name in (("good", "k_good"), ("bad", "n_bad_found"))])
    tested = sums.withColumn("probability", binomial_at_most(F.col("k_good"), F.col("n_good"), risk / len(RULES)))
    tested = tested.withColumn("certified", F.bool_and(F.col("probability") <= level).over(upto))
    d = lambda c: F.col(c).cast("double")
    useful = F.col("certified") & (F.col("n_bad_found") > 0) & (d("n_bad_found") * d("n_good") >= LIFT * d("k_good") * d("n_bad"))
    tested = tested.withColumn("useful", useful)
    most = F.max(F.when(F.col("useful"), F.col("n_bad_found"))).over(rule)
    return tested.withColumn("enough", F.col("useful") & (100 * F.col("n_bad_found") >= NEARLY_ALL * most)).withColumn("taken", F.col("enough") & (F.col("place") == F.min(F.when(F.col("enough"), F.col("place"))).over(rule))).drop("enough")


def _labelled(measures: DataFrame, labels: DataFrame, label_id: str, label_col: str) -> DataFrame:
    good = labels.groupBy(F.col(label_id).cast("long").alias("_id")).agg(F.min(label_col).alias("_good")).filter("_id is not null and _good is not null")
    return measures.filter(~base_failed()).join(good, F.col("_row.doc_id") == F.col("_id")).select(F.col("_row.stratum").alias("stratum"), (F.col("_good") > 0).alias("good"), *MEASURES)


def _verdicts(measures: DataFrame, table: DataFrame) -> DataFrame:
    """``measures`` with base_failed, rejected_by and kept."""
    taken = table.filter("taken").groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r[0], F.col("cutoff"))).alias(f"_{r[0]}") for r in RULES])
    if taken.count() <= BROADCAST_ROWS:
        taken = F.broadcast(taken)
    rows = measures.join(taken, F.col("_row.stratum") == taken["stratum"], "left").drop("stratum")
    broken = F.array_compact(F.array(*[F.when(_beyond(r, F.col(f"_{r[0]}")), r[0]) for r in RULES]))
    rows = rows.withColumn("base_failed", base_failed()).withColumn("rejected_by", F.when(F.col("base_failed"), "base").otherwise(F.array_join(broken, ",")))
    return rows.withColumn("kept", F.col("rejected_by") == "").drop(*[f"_{r[0]}" for r in RULES])


def judged(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
    label_id: str = "doc_id", label_col: str = "quality", risk: float = RISK, miss: float = MISS,
) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, rejected_by, kept.

    ``labels``: 0 is bad, larger is good, null is no label; of several labels of one id
    the smallest counts, and every row of a labelled id is labelled.  Rows that fail
    the base rules are rejected and don't count for the cutoffs.  A null stratum is
    the empty string.  Null text has no words.  Repeated rows and null ids each give
    their row; a null id has no label.  Without labels only the base rules reject.
    An empty table gives no rows; texts of any length are read whole.
    """
    ws = workspace(docs.sparkSession)
    row = F.struct(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(stratum_col).cast("string")).alias("stratum"))
    measures = ws.save(measured(docs, text_col, row), "measures")
    table = ws.save(cutoffs(_labelled(measures, labels, label_id, label_col), risk, miss), "cutoffs")
    return _verdicts(measures, table).select("_row.doc_id", *MEASURES, "base_failed", "rejected_by", "kept")
