"""Mixes sources to target weights: whole epochs first, then a weighted sample without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.llm.common import WORD, cut

#: No source gives more than so many times its words.
MOST_EPOCHS = 3
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: About so many documents fall into one bucket of sampling keys.
ROWS_PER_BUCKET = 5_000


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """Production weight of a document, in (0, 1]: halved under 50 words, less with every symbol."""
    bare = F.coalesce(text, F.lit(""))
    for symbol in "#*$%&|<>":
        bare = F.replace(bare, F.lit(symbol), F.lit(""))
    symbols = F.octet_length(F.coalesce(text, F.lit(""))) - F.octet_length(bare)
    share = F.try_divide(size.cast("double"), size + 4 * symbols)
    return F.coalesce(F.when(size >= 50, 1.0).otherwise(0.5) * share, F.lit(0.5))


def uniform(id_col: Column, seed: int) -> Column:
    """A number in (0, 1) that only the id and the seed decide."""
    digits = F.substring(F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame) -> DataFrame:
    """Targets by water filling over (``source``, ``source_size``), one short row per source.

    Shares are by weight; a source stops at ``MOST_EPOCHS`` times its size, and what it leaves goes to
    the others by weight. Sources in order of that limit per unit of weight are full up to some point;
    from there on they share what is left.
    """
    numbered = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*map(F.lit, WEIGHTS))
    rows = sizes.withColumn("place", F.row_number().over(numbered)).withColumn("weight", F.get(weights, (F.col("place") - 1) % len(WEIGHTS)).cast("long"))
    rows = rows.withColumn("most", MOST_EPOCHS * F.col("source_size"))
    by_limit = Window.orderBy(F.col("most") / F.col("weight"), F.col("place"))
    before, rest, all_rows = (by_limit.rowsBetween(*span) for span in ((Window.unboundedPreceding, -1), (0, Window.unboundedFollowing), (Window.unboundedPreceding, Window.unboundedFollowing)))
    total = F.sum("source_size").over(all_rows)
    rows = rows.withColumn("left", total - F.coalesce(F.sum("most").over(before), F.lit(0))).withColumn("weights", F.sum("weight").over(rest))
    rows = rows.withColumn("open", F.col("left") * F.col("weight") < F.col("most") * F.col("weights"))
    first = F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("weight"), "place", "left", "weights"))).over(all_rows)
    rows = rows.withColumn("first", first)
    full = F.col("first").isNull() | (F.struct(F.col("most") / F.col("weight"), "place") < F.struct(F.col("first")["col1"], F.col("first")["place"]))
    shared = (F.col("first")["left"] * F.col("weight")).cast("double") / F.col("first")["weights"]
    return rows.select("source", "source_size", F.when(full, F.col("most").cast("double")).otherwise(shared).alias("target"))


def sample_to_targets(sized: DataFrame) -> DataFrame:
    """How often each document is taken, from (``doc_id``, ``source``, ``size``, ``key``).

    A source first gives as many whole epochs as its target holds; the rest is filled with documents in
    order of ``key`` (exponential, scaled by quality) as long as their running size stays within it. The
    document at the border is taken if that comes nearer. Keys are dealt into buckets that hold a narrow
    range of the logarithm of the key, running sums go by bucket first, so that a source of any size is spread out.
    """
    slim = cut(sized.select("doc_id", "source", "size", "key", F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), "source")).alias("skey")))
    per_octave = 64 + slim.count() // ROWS_PER_BUCKET
    slim = slim.withColumn("bucket", F.floor(per_octave * F.log2("key")))
    buckets = slim.groupBy("skey", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("bucket_size"))
    totals = buckets.groupBy("skey", "source").agg(F.sum("bucket_size").alias("source_size"))
    targets = source_targets(totals.drop("skey")).withColumn("skey", F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), "source")))
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST_EPOCHS))).otherwise(0).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    ordered = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("bucket_size").over(ordered), F.lit(0)).alias("before")
    started = buckets.select("skey", "bucket", before).join(targets.drop("source"), "skey")
    rows = slim.join(started, ["skey", "bucket"])
    inside = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.col("before") + F.sum("size").over(inside))
    over, under = F.col("upto") - F.col("budget"), F.col("budget") - (F.col("upto") - F.col("size"))
    chosen = (over <= 0) | ((under > 0) & (over < under))
    taken = F.col("size") * (F.col("epochs") + F.when(chosen & (F.col("epochs") < MOST_EPOCHS) & (F.col("budget") > 0), 1).otherwise(0))
    copies = F.col("epochs") + F.when(chosen & (F.col("epochs") < MOST_EPOCHS) & (F.col("budget") > 0), 1).otherwise(0)
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), copies.alias("copies"))


def mix_sources(docs: DataFrame, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken`` (words), ``copies`` per input row.

    Null text has size 0, a null source is a source of its own and comes last, null ids share one sampling
    key. Repeated rows are ordered side by side. An empty table gives no rows; other columns are not read.
    The same rows and seed give the same mix, whatever the partitions.
    """
    text, size = F.col(text_col), F.col("size")
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.explode(F.array(F.struct(size_of(text).alias("size"), text.alias("text")))).alias("d"))
    sized = read.select("doc_id", "source", "d.size", quality_weight(F.col("d.text"), F.col("d.size")).alias("weight"))
    return sample_to_targets(sized.withColumn("key", -F.ln(uniform(F.col("doc_id"), seed)) / F.col("weight")))
