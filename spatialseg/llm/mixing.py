"""Mixing sources to target weights by systematic sampling.

Within a source every document has the same expected number of copies, the
source's target over its size. The prefix sum of expected copies runs over the
source's documents from small to large; one random offset is added, and a
document is emitted once for each integer that the sum crosses in it. Going by
size keeps the words taken within about one long document of the target.

Edge cases: a null source is a source of its own, last in order; a null text has
size 0; documents of size 0 may be emitted but take no words; a source whose
documents are all empty has target 0; repeated rows are sampled each; an empty
table gives an empty result; very long texts are counted whole. ``mix`` takes columns of
any names; in ``mix_plan`` a column of ``docs`` with the name of a result (_size,
_total, _target, _copies) is replaced by it. Targets are worked out on one row a
source, in one task: sources must be some million at most. All of it is DataFrame
functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spatialseg.llm.ranks import rank_within
from spatialseg.runtime import cut, shuffle_width

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
TWO_32 = 1 << 32
#: Names of results, and of columns on the way to them.
OWN = {"_size", "_total", "_target", "_copies", "_none", "_source", "_hash", "_class", "_first", "_in_class", "_part", "_n", "_start", "_inside", "_words"}


def uniform32(key: Column) -> Column:
    """A reproducible number in [0, 2^32) from a key."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def size_class(size: Column) -> Column:
    """Classes of sizes, eight for each power of two, in order of size: at most some 500 whatever the input."""
    bits = F.length(F.bin(size)).cast("int")
    return bits * 8 + F.when(size < 8, size).otherwise(F.expr("shiftright(_size, greatest(length(bin(_size)) - 4, 0))") % 8).cast("int")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(_none, _source, _total) with one row a source -> and _target: ``share`` of all sizes by weight, none above ``most`` times its own size, the excess shared anew."""
    by_name = Window.orderBy("_none", "_source")  # one row a source
    by_need = Window.orderBy(F.col("_cap") / F.col("_w"), "_none", "_source")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    s = s.withColumns({"_cap": F.col("_total") * F.lit(most), "_all": F.sum("_total").over(everything) * F.lit(share), "_ws": F.sum("_w").over(everything)})
    s = s.withColumns({"_cb": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), "_wb": F.coalesce(F.sum("_w").over(before), F.lit(0))})
    s = s.withColumn("_full", F.col("_cap") * (F.col("_ws") - F.col("_wb")) <= F.col("_w") * (F.col("_all") - F.col("_cb")))
    s = s.withColumns({"_rest": F.col("_all") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(everything), "_wrest": F.sum(F.when(~F.col("_full"), F.col("_w"))).over(everything)})
    return s.select("_none", "_source", "_total", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * F.col("_rest") / F.col("_wrest")).alias("_target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """``docs`` with _size, _total (its source's size), _target (its source's words to take) and _copies. ``keep`` may write the tables of a row a class on the way, which parts one long plan into short ones."""
    width = shuffle_width(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in OWN and c not in (id_col, text_col, source_col) and (text_col or c != "_size")])
    sized = docs.withColumns({
        "_size": F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long") if text_col else F.col("_size"),
        "_none": F.col(source_col).isNull(),
        "_source": F.coalesce(F.col(source_col), F.lit("")),
        "_hash": uniform32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))),
    }).withColumn("_class", size_class(F.col("_size")))
    keys = ["_none", "_source", "_class"]
    part = F.shiftright(F.col("_hash") * width, 32)
    # the classes of a source start where the smaller ones end
    classes = keep(sized.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_words")), "classes")
    smaller = Window.partitionBy("_none", "_source").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(classes.groupBy("_none", "_source").agg(F.sum("_words").alias("_total")), weights, share, most)
    starts = classes.select(*keys, F.coalesce(F.sum("_n").over(smaller), F.lit(0)).alias("_first")).join(targets, ["_none", "_source"])
    starts = keep(starts, "starts")
    ranked = rank_within(sized, keys, part, ["_hash", id_col, "_size"], "_in_class").join(starts, keys)
    rate = F.when(F.col("_total") > 0, F.col("_target") / F.col("_total")).otherwise(0.0)
    offset = uniform32(F.concat(F.lit(seed), F.col("_source"), F.col("_none").cast("string"))) / F.lit(float(TWO_32))
    k = F.col("_first") + F.col("_in_class")
    copies = F.floor(rate * (k + 1) + offset) - F.floor(rate * k + offset)
    return ranked.withColumn("_copies", copies.cast("long")).drop("_none", "_source", "_hash", "_class", "_first", "_in_class")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The rows of the mix, each as often as it was drawn, with the columns of ``docs``.

    Sizes and digests of the texts are written once and drawn from; the texts
    themselves are shuffled once, to meet the number of their copies.
    """
    names = docs.columns
    place = {n: f"c{i}" for i, n in enumerate(names)}  # names of our own cannot clash with these
    docs, id_col, text_col, source_col = docs.toDF(*place.values()), place[id_col], place[text_col], place[source_col]
    key = [F.col(id_col).alias("_id"), F.col(source_col).alias("_src"), F.xxhash64(text_col).alias("_digest")]
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = cut(docs.select(*key, size.alias("_size")), "sizes")
    drawn = mix_plan(sizes, "_id", None, "_src", keep=cut, **kw)
    copies = cut(drawn.groupBy("_id", "_src", "_digest").agg(F.sum("_copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")).where("_copies > 0"), "copies")
    same = F.col(id_col).eqNullSafe(F.col("_id")) & F.col(source_col).eqNullSafe(F.col("_src")) & (F.xxhash64(text_col) == F.col("_digest"))
    met = docs.join(copies.where("_rows = 1"), same)
    if not copies.where("_rows > 1").isEmpty():
        # rows that repeat were drawn each; one of them stands for the copies of all
        met = met.unionByName(docs.join(copies.where("_rows > 1"), same).dropDuplicates(["_id", "_src", "_digest"]))
    return met.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).drop("col").toDF(*names)
