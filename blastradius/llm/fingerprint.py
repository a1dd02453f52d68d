"""Order-independent document fingerprints that add up.

A paragraph (a line) is hashed to a vector of eight 32-bit lanes, and a document's
lanes are the sums of its paragraphs' modulo 2^32.  The order of paragraphs does
not matter, and a paragraph is inserted or deleted by adding or taking away its
vector.  A second vector tells how alike two documents are: blocks of at most
``BLOCK`` code points inside a sentence vote on ``SKETCH`` lanes, a lane counting
the blocks whose hash has its bit; the cosine of two such vectors about zero
estimates how many blocks they share.

Only DataFrame operations.  Whole texts are shuffled once, by ranges of the id, so
that a document meets its successor; a range also gets the first document of the
next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blastradius.llm.common import cut_points, drawn, partitions, position, whole

LANES, SKETCH, BLOCK = 8, 64, 32
FIRST_ID = -(1 << 63)
_LOW = (1 << 32) - 1
_QUAD = 1 | 1 << 16 | 1 << 32 | 1 << 48
_SUMS = SKETCH // 4
#: Units that are summed before counters are widened.
CHUNK = 16_384


def _units(text: Column) -> Column:
    """Paragraphs, with the line end as their mark, and the blocks of their sentences."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.concat(x, F.lit("\n")))
    return F.concat(lines, F.regexp_extract_all(text, F.lit(r"[^\n.!?]{1,%d}" % BLOCK), F.lit(0)))


def _hashed(unit: Column) -> list[Column]:
    """What the sums read: of a paragraph its lanes, of a block its votes, four counters of 16 bits to a long; and which of the two it is."""
    paragraph, h = F.col("_p"), F.col("_h")
    out = []
    for j in range(_SUMS):
        votes = F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_QUAD))
        if j < LANES:
            lane = F.xxhash64(F.lit(j // 2), unit)
            lane = F.shiftrightunsigned(lane, 32) if j % 2 else lane.bitwiseAND(F.lit(_LOW))
            votes = F.when(paragraph, F.when(unit == "\n", F.lit(0).cast("long")).otherwise(lane)).otherwise(votes)
        else:
            votes = F.when(paragraph, F.lit(0).cast("long")).otherwise(votes)
        out.append(votes.alias(f"_x{j}"))
    return out


def _summed(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, blocks, lanes, sketch) of texts.

    Units are summed by chunks that no counter of 16 bits outgrows, then chunks are.
    The input is taken to be dealt by the first key, so nothing is shuffled if it is.
    """
    units = texts.select(*keys, F.posexplode(_units(F.col(text))).alias("_at", "_u"))
    units = units.select(*keys, F.floor(F.col("_at") / CHUNK).cast("int").alias("_chunk"), "_u", F.col("_u").endswith("\n").alias("_p"), F.xxhash64("_u").alias("_h"))
    rows = units.select(*keys, "_chunk", "_p", *_hashed(F.col("_u"))).groupBy(*keys, "_chunk", "_p").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_x{j}").alias(f"_x{j}") for j in range(_SUMS)])
    lanes = [F.sum(F.when(F.col("_p"), F.col(f"_x{j}")).otherwise(0)).bitwiseAND(F.lit(_LOW)) for j in range(LANES)]
    votes = [F.sum(F.when(F.col("_p"), 0).otherwise(F.shiftrightunsigned(f"_x{j}", 16 * q).bitwiseAND(F.lit(0xFFFF)))) for q in range(4) for j in range(_SUMS)]
    blocks = F.sum(F.when(F.col("_p"), 0).otherwise(F.col("_n")))
    return rows.groupBy(*keys).agg(blocks.alias("blocks"), F.array(*lanes).alias("lanes"), F.array(*votes).alias("sketch"))


def plus(a: Column, b: Column) -> Column:
    """Lanes of two texts put together."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(_LOW)))


def minus(a: Column, b: Column) -> Column:
    """Lanes of ``a`` without the paragraphs of ``b``."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(_LOW)))


def written(blocks: Column, lanes: Column, sketch: Column) -> Column:
    """A fingerprint as text: lanes of 8 hex digits, the number of blocks, lanes of 4."""
    digits = lambda c, n: F.right(F.concat(F.lit("0" * n), F.lower(F.hex(c))), F.lit(n))
    return F.concat(F.array_join(F.transform(lanes, lambda x: digits(x, 8)), ""), digits(blocks, 8), F.array_join(F.transform(sketch, lambda x: digits(x, 4)), ""))


def _centred(blocks: Column, sketch: Column) -> Column:
    return F.transform(sketch, lambda x: (x * 2 - blocks).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two centred sketches; texts without a block are like each other only."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    both = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(both > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / both))).otherwise((dot(a, a) == dot(b, b)).cast("double"))


def lanes_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``blocks``, ``lanes`` and ``sketch``, for incremental use with ``plus`` and ``minus``."""
    rows = docs.select(F.monotonically_increasing_id().alias("_r"), F.struct("*").alias("_row"))
    found = _summed(rows.select("_r", whole(F.col(f"_row.{text_col}")).alias("_t")), ["_r"], "_t")
    return rows.join(found, "_r").select("_row.*", "blocks", "lanes", "sketch")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends with as much of the next document (by id, the first
    after the last) as half of the text is long.  Null text is empty; a null id
    stands before all others; rows of one id stand in the order of their texts.
    Empty texts have the zero fingerprint.  A single row is its own next.
    An empty table gives no rows; columns beside the two named are not read.
    """
    n = partitions(docs.sparkSession)
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST_ID))
    base = docs.select(own.alias("_i"), F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("_t"))
    # A border is the id of a row, so the range it opens starts with that very document.
    sample = drawn(docs.select(id_col, text_col), n).select(own.alias("i"), F.length(whole(text_col)).alias("w")).collect()
    mean = sum(r.w for r in sample) / max(1, len(sample))
    points = [k[0] for k in cut_points([(r.i,) for r in sample], [r.w + mean + 1 for r in sample], n)]
    least = base.agg(F.min("_i")).first()[0]
    points = [p for p in points if p != least]
    longs = [F.lit(p).cast("long") for p in points]
    last = len(points)
    b = position(longs, lambda p: p <= F.col("_i"))
    opens = F.col("_i").isin(points) if points else F.lit(False)
    also = F.when(F.col("_i") == F.lit(least), F.array(b, F.lit(-1 - last))).when(opens, F.array(b, -b)).otherwise(F.array(b))
    dealt = (
        base.withColumn("_to", F.explode(also))
        .withColumn("_guest", F.col("_to") < 0)
        .withColumn("_b", F.when(F.col("_guest"), -F.col("_to") - 1).otherwise(F.col("_to")))
        .drop("_to")
        .repartitionById(n, F.col("_b"))
    )
    order = Window.partitionBy("_b").orderBy("_guest", "_i", "_t")
    size = F.length("_t")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    texts = (
        dealt.withColumn("_next", F.coalesce(F.lead("_t").over(order), F.lit("")))
        .withColumn("_r", F.row_number().over(order))
        .withColumn("n_chars", size.cast("long"))
        .withColumn("_e", F.concat(F.expr("substring(_t, 1, cast(n_chars - floor(n_chars / 2) as int))"), F.substring("_next", F.lit(1), half)))
    )
    keys = ["_b", "_r", "_guest", "doc_id", "n_chars", "edited_sha256", "_v"]
    own_and_edited = F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col(c).alias("t")) for v, c in enumerate(("_t", "_e"))]))
    both = texts.withColumn("edited_sha256", F.sha2("_e", 256)).select(*keys[:-1], own_and_edited.alias("_x")).select(*keys[:-1], F.col("_x.v").alias("_v"), F.col("_x.t").alias("_t"))
    marks = _summed(both, keys, "_t").select(*keys, written(F.col("blocks"), F.col("lanes"), F.col("sketch")).alias("_f"), _centred(F.col("blocks"), F.col("sketch")).alias("_c"))
    # A document's own row is followed by that of its edited text and then by the next document's.
    rows = Window.partitionBy("_b").orderBy("_r", "_v")
    return (
        marks.withColumn("edited_fingerprint", F.lead("_f").over(rows))
        .withColumn("_ce", F.lead("_c").over(rows))
        .withColumn("_cn", F.lead("_c", 2).over(rows))
        .filter("_v = 0 and not _guest")
        .select(
            "doc_id", "n_chars", "edited_sha256", F.col("_f").alias("fingerprint"), "edited_fingerprint",
            likeness(F.col("_c"), F.col("_ce")).alias("near_edited"), likeness(F.col("_c"), F.col("_cn")).alias("near_next"),
        )
    )
