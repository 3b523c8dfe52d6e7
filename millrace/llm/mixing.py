"""Mixing sources to target weights along a time-varying curriculum.

*Targets.* Sources in code point order, null last, weigh 1, 2, 3, repeating, and
share the words of all documents; a target stops at 3 times its source's words
and the excess is shared again by weight. The fixed point is a water level: with
sources ordered by cap over weight, those before the first that is not full are
capped, and the level is what they leave over the weight that is left.

*Documents.* A source's documents stand in the order of the MD5 of their doc_id.
The mix runs through them as often as the target needs; the last pass ends in
the middle of a document, so the words taken equal the rounded target.

*Curriculum.* The rate of a source over training time t in [0, 1] is
``target * (1 + k * (2t - 1))``: sources of greater weight come later. The k are
centred so that the rates of all sources sum to the same at any time. Its
integral is ``target * (t + k * (t*t - t))``; inverting that at the words a
source has given before a document gives the document's position.

Sums before a document come from three levels: words of a run of cells of a
source, of each cell in a run, and a window inside a cell; the sources alone, a
row each, are ordered in one task. Where only figures are asked
for, the words are counted once, into a narrow table of the shared folder, and
the cells are Spark's own ranges of it by (source, MD5, size, text, row number), so
neither a hot source nor a hot doc_id makes a large one. Where whole rows are
asked for, a cell is one of ``BUCKETS`` ranges of the MD5 and ``SUBS`` of the text's
hash; if a cell holds over ``HOT`` rows all the same, the rows are alike in id and
text, and are written once with a number each that parts them further.

Defined results: a null or wordless text has size 0 and takes 0; a null source
is a source; a null doc_id counts as an empty one; rows of equal doc_id are
ordered by size, and equal rows are interchangeable; an empty table gives no
rows; columns besides doc_id, text and source are carried where rows are
returned whole, and replaced if they have the names of new ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import stored, word_count

BUCKETS = 4096
SUBS = 16
#: Neighbouring numbers of a cell whose sums are added up apart.
TOP = 64
#: Rows of a cell that one task orders.
HOT = 1 << 20
CAP = 3
#: The greatest part by which a source's rate rises or falls from its mean.
SLOPE = 0.5


def _order(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, goal (target in whole words), slope; from rows (source, size)."""
    src = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    src = src.withColumn("w", ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("long"))
    by = W.orderBy((CAP * F.col("source_size")).cast("double") / F.col("w"), F.col("source").asc_nulls_last())
    src = src.withColumns({
        "total": F.sum("source_size").over(W.partitionBy()),
        "capped": F.coalesce(F.sum(CAP * F.col("source_size")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "weights": F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing)),
    })
    src = src.withColumn("level", (F.col("total") - F.col("capped")).cast("double") / F.col("weights"))
    free = F.when((CAP * F.col("source_size")).cast("double") >= F.col("level") * F.col("w"), F.col("level"))
    src = src.withColumn("level", F.first(free, ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    cap = (CAP * F.col("source_size")).cast("double")
    src = src.withColumn("target", F.least(cap, F.coalesce(F.col("level") * F.col("w"), cap)))
    src = src.withColumn("goal", F.floor(F.col("target") + 0.5).cast("long"))
    everything = W.partitionBy()
    mean = F.try_divide(F.sum(F.col("goal") * F.col("w")).over(everything).cast("double"), F.sum("goal").over(everything).cast("double"))
    src = src.withColumn("off", F.coalesce(F.col("w") - mean, F.lit(0.0)))
    widest = F.max(F.abs("off")).over(everything)
    return src.select("source", "source_size", "target", "goal", F.when(widest > 0, F.lit(SLOPE) * F.col("off") / widest).otherwise(0.0).alias("slope"))


def position(words: Column, goal: Column, slope: Column) -> Column:
    """The time at which a source of this slope has given so many of its goal's words."""
    y = words / goal
    fall = F.lit(1.0) - slope
    return F.when(words <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * y / (fall + F.sqrt(fall * fall + F.lit(4.0) * slope * y)))


def _shared_out(rows: DataFrame, sums: DataFrame, cells: list[str], order: list[str]) -> DataFrame:
    """Rows with source_size, target, goal, slope, before, _full, _rest and taken; ``sums`` has the size of each (source, cells)."""
    top = F.floor(F.col(cells[0]) / TOP)
    all_before = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tops = sums.groupBy("source", top.alias("_top")).agg(F.sum("size").alias("size"))
    tops = tops.select(F.col("source").alias("_src"), "_top", all_before(W.partitionBy("source").orderBy("_top")).alias("_base"))
    ahead = sums.withColumn("_own_top", top)
    ahead = ahead.select("source", *cells, "_own_top", all_before(W.partitionBy("source", "_own_top").orderBy(*cells)).alias("_inner"))
    ahead = ahead.join(tops, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_own_top") == F.col("_top")))
    ahead = ahead.select("source", *cells, (F.col("_base") + F.col("_inner")).alias("_ahead"))
    ahead = ahead.join(targets(sums).withColumnRenamed("source", "_src"), F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    ahead = ahead.withColumnsRenamed({"source": "_src"} | {c: f"{c}_of" for c in cells})
    on = rows["source"].eqNullSafe(ahead["_src"])
    for c in cells:
        on &= rows[c] == ahead[f"{c}_of"]
    out = rows.join(ahead, on).drop("_src", *[f"{c}_of" for c in cells])
    inside = W.partitionBy("source", *cells).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = out.withColumn("before", F.col("_ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0)
    out = out.withColumn("_full", full.cast("long"))
    rest = F.col("goal") - F.col("_full") * F.col("source_size") - F.col("before")
    out = out.withColumn("_rest", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest)))
    return out.withColumn("taken", F.col("_full") * F.col("size") + F.col("_rest")).drop("_ahead", *cells)


def planned(docs: DataFrame, buckets: int = BUCKETS, hot: int = HOT) -> DataFrame:
    """All columns and size, source_size, target, taken, before (words of the source ahead in a pass), goal, slope."""
    docs = docs.drop("size", "source_size", "target", "taken", "before", "goal", "slope")
    own = F.xxhash64("text")
    key = _order(F.col("doc_id"))
    bucket = (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("int")
    cells = {"_bucket": bucket, "_sub": F.pmod(own, F.lit(SUBS)).cast("int"), "_salt": F.lit(0)}

    def keyed(df: DataFrame, salt: Column) -> DataFrame:
        return df.withColumns(cells | {"_salt": salt, "_key": key, "_own": own, "size": word_count(F.col("text"))})

    def summed(df: DataFrame) -> DataFrame:
        return stored(df.groupBy("source", *cells).agg(F.sum("size").alias("size"), F.count("*").alias("rows")), "buckets")

    rows = keyed(docs, F.lit(0))
    sums = summed(rows)
    if (sums.agg(F.max("rows").alias("n")).first().n or 0) > hot:
        numbered = stored(docs.withColumn("_nr", F.monotonically_increasing_id()), "numbered")
        rows = keyed(numbered, F.pmod(F.xxhash64("_nr"), F.lit(SUBS * SUBS)).cast("int")).drop("_nr")
        sums = summed(rows)
    return _shared_out(rows, sums, list(cells), ["_key", "_own", "size"]).drop("_key", "_own")


def planned_sizes(docs: DataFrame) -> DataFrame:
    """The figures of ``planned`` for each row, without texts: doc_id, size, source_size, target, taken, before, goal, slope."""
    narrow = docs.select("doc_id", "source", _order(F.col("doc_id")).alias("_key"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_own"), F.monotonically_increasing_id().alias("_nr"))
    order = ["_key", "size", "_own", "_nr"]
    ranges = stored(narrow, "sizes").repartitionByRange("source", *order)
    ranges = stored(ranges.withColumn("_cell", F.spark_partition_id()), "ranges")
    sums = stored(ranges.groupBy("source", "_cell").agg(F.sum("size").alias("size")), "buckets")
    return _shared_out(ranges, sums, ["_cell"], order).drop("_key", "_own", "_nr")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_position of each row, sorted by ranges of first_position."""
    out = planned_sizes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source")))
    at = F.when(F.col("taken") > 0, position(F.col("before").cast("double"), F.col("goal").cast("double"), F.col("slope")))
    out = out.select("doc_id", "size", "source_size", "target", "taken", at.alias("first_position"))
    return out.repartitionByRange(F.col("first_position").asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(F.col("first_position").asc_nulls_last(), "doc_id")


def training_order(docs: DataFrame) -> DataFrame:
    """The mixed documents, all columns, once for each time they are taken, sorted by ranges of their position.

    Texts stay whole: the document in which a source's last pass ends comes once
    more if half of it or more is taken there.
    """
    out = planned(docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_row")))
    times = F.col("_full") + F.when((F.col("_rest") > 0) & (2 * F.col("_rest") >= F.col("size")), 1).otherwise(0)
    out = out.where("size > 0").withColumn("_times", times).where("_times > 0")
    out = out.withColumn("_pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1)))
    words = F.col("_pass") * F.col("source_size") + F.col("before")
    out = out.withColumn("_at", position(words.cast("double"), F.col("goal").cast("double"), F.col("slope")))
    return out.repartitionByRange("_at", "doc_id").sortWithinPartitions("_at", "doc_id").select("_row.*")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS k,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM d GROUP BY source
), c AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum({CAP} * source_size) OVER (ORDER BY ({CAP} * source_size)::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (ORDER BY ({CAP} * source_size)::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM s
), l AS (
  SELECT *, ({CAP} * source_size)::DOUBLE AS cap, ({CAP} * source_size)::DOUBLE / w AS ratio, (total - capped)::DOUBLE / weights::DOUBLE AS lv FROM c
), lev AS (
  SELECT arg_min(lv, ratio) AS level FROM l WHERE cap >= lv * w
), t AS (
  SELECT source, source_size, w, least(cap, coalesce(level * w, cap)) AS target FROM l LEFT JOIN lev ON true
), g AS (
  SELECT *, floor(target + 0.5)::BIGINT AS goal FROM t
), m AS (
  SELECT *, w - (sum(goal * w) OVER ())::DOUBLE / (sum(goal) OVER ())::DOUBLE AS off FROM g
), q AS (
  SELECT *, CASE WHEN max(abs(off)) OVER () > 0 THEN {SLOPE} * off / max(abs(off)) OVER () ELSE 0.0 END AS slope FROM m
), b AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.goal, q.slope,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), f AS (
  SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS n FROM b
), r AS (
  SELECT *, (n * size + greatest(0, least(size, goal - n * source_size - before)))::BIGINT AS taken FROM f
)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken = 0 THEN NULL WHEN before <= 0 THEN 0.0
    ELSE 2.0::DOUBLE * (before::DOUBLE / goal::DOUBLE) / ((1.0::DOUBLE - slope) + sqrt((1.0::DOUBLE - slope) * (1.0::DOUBLE - slope) + 4.0::DOUBLE * slope * (before::DOUBLE / goal::DOUBLE))) END::DOUBLE AS first_position
FROM r
"""
