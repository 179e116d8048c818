"""Market-basket mining: commodity co-occurrence, top pairs, itemsets, association rules.

Exact counts over every basket, computed as a sparse matrix product in
blocks, dense or sparse as the data are, instead of a per-basket pair
expansion:

1. Commodities get dense codes 0..C-1 in text order (from the product
   dimension, so the code table is bounded by the dimension, not the lines).
2. Per basket, the distinct codes are folded into words of 64 codes
   (``collect_set`` has a partial aggregate, so a giant basket is reduced to
   at most C codes per task before its shuffle).
3. Each (item a, word j) of a basket is one block. A block with many of the
   word's codes is one row with the word's bit mask, without the bits below
   a; ``groupBy(a, j)`` sums the 64 bits of the masks. A block with few is a
   row per code b, and ``groupBy(a, b)`` counts them. So a wide basket costs
   a row per 64 partners, and a large assortment of which baskets hold
   little costs no counters for pairs that never meet. Both aggregates run
   partially before their shuffle.
4. Counter (a, j, bit) and count (a, b) add up to the number of baskets
   holding both a and b = 64·j + bit; the diagonal a = b is the number of
   baskets holding a.

Sets of three and more commodities are mined from the same itemsets by
Spark's parallel FP-growth, which is given only what frequent triples leave
of a basket: its trees take about 20 times as long as counting the triples.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.session import materialize, written

WORD_BITS = 64
# Codes of a word from which one mask row with 64 counters is cheaper than a row per code.
DENSE_FROM = 16
# Items up to which the triples of a basket are listed: 560 at most.
NARROW = 16


def dense_codes(values: DataFrame, col: str, code: str = "cid") -> DataFrame:
    """Dense 0-based codes for the distinct ``col`` values in sort order.

    Distributed: the values are range-partitioned and sorted, each
    partition's size is counted (one row per partition), prefix offsets are
    taken over those few rows, and each value's code is its partition offset
    plus its position inside the partition. No task sees more than one
    partition of values. The partition-tagged table is materialised so both
    reads see the same partitioning.
    """
    names = values.select(col).where(F.col(col).isNotNull()).distinct()
    tagged = materialize(names.repartitionByRange(col).sortWithinPartitions(col)
                         .withColumn("_pid", F.spark_partition_id()))
    sizes = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    pos = F.row_number().over(Window.partitionBy("_pid").orderBy(col)) - 1
    return materialize(
        tagged.withColumn("_pos", pos)
        .join(F.broadcast(offsets), "_pid")
        .select(col, (F.col("_off") + F.col("_pos")).cast("int").alias(code)))


def code_commodities(products: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Products with a dense commodity code ``cid`` (NULL commodity -> NULL).

    Codes follow text order, so ``item_1 < item_2`` is ``a < b``. The code
    table (one row per distinct commodity) is materialised once; pass it in
    to reuse it for the name lookups.
    """
    codes = codes if codes is not None else dense_codes(products, "commodity")
    return products.join(codes, "commodity", "left")


def commodity_codes(coded_products: DataFrame) -> DataFrame:
    return coded_products.select("commodity", "cid").where(F.col("cid").isNotNull()).distinct()


def basket_itemsets(coded_star: DataFrame) -> DataFrame:
    """(basket_num, items: distinct commodity codes) for baskets with >= 1 code."""
    return (coded_star.where(F.col("cid").isNotNull())
            .groupBy("basket_num").agg(F.collect_set("cid").alias("items")))


def _words(items_col: str):
    """Per basket: [{j, ids, mask}] for each non-empty 64-bit word of its codes."""
    return F.expr(
        f"transform(array_distinct(transform({items_col}, x -> shiftright(x, 6))), "
        f"j -> named_struct('j', j, 'ids', filter({items_col}, x -> shiftright(x, 6) = j), 'mask', "
        f"aggregate(filter({items_col}, x -> shiftright(x, 6) = j), 0L, "
        f"(acc, x) -> acc | shiftleft(1L, x & 63))))")


def _blocks(itemsets: DataFrame) -> DataFrame:
    """(a, j, ids, mask): for each item of a basket the words from its own upwards."""
    # the outer form infers no filter, which would build the words again
    per_item = (itemsets.select("items", _words("items").alias("words"))
                .select(F.explode_outer("items").alias("a"), "words"))
    return (per_item.select("a", F.explode_outer("words").alias("w")).select("a", "w.j", "w.ids", "w.mask")
            .where(F.col("j") >= F.shiftright("a", 6)))


def _dense_cells(blocks: DataFrame) -> DataFrame:
    home = F.shiftright("a", 6)
    per_word = blocks.select("a", "j", F.when(
        F.col("j") == home, F.expr("mask & shiftleft(-1L, a & 63)")).otherwise(F.col("mask")).alias("mask"))
    bits = [F.sum(F.shiftright("mask", b).bitwiseAND(1)).alias(f"c{b}") for b in range(WORD_BITS)]
    counters = per_word.groupBy("a", "j").agg(*bits)
    cells = counters.select(
        "a", "j", F.posexplode(F.array(*[f"c{b}" for b in range(WORD_BITS)])).alias("bit", "n"))
    b = (F.col("j") * WORD_BITS + F.col("bit")).cast("int")
    return (cells.select("a", b.alias("b"), "n")
            .where((F.col("n") > 0) & (F.col("b") >= F.col("a"))))


def _sparse_cells(blocks: DataFrame) -> DataFrame:
    above = blocks.select("a", F.explode(F.filter("ids", lambda x: x >= F.col("a"))).alias("b"))
    return above.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def cooccurrence(itemsets: DataFrame, dense_from: int = DENSE_FROM) -> DataFrame:
    """Upper triangle (a <= b) of the basket co-occurrence matrix: (a, b, n).

    Words with ``dense_from`` codes of a basket and more are counted by bits,
    others by code. ``itemsets`` is read by both sides: materialise it.
    """
    blocks, full = _blocks(itemsets), F.size("ids") >= dense_from
    sparse, dense = _sparse_cells(blocks.where(~full)), _dense_cells(blocks.where(full))
    return sparse.unionByName(dense).groupBy("a", "b").agg(F.sum("n").alias("n"))


def item_support(itemsets: DataFrame) -> DataFrame:
    """(cid, n_item): number of baskets holding each commodity."""
    return (itemsets.select(F.explode("items").alias("cid")).groupBy("cid")
            .agg(F.count(F.lit(1)).alias("n_item")))


def prune_itemsets(itemsets: DataFrame, support: DataFrame, min_support: int) -> DataFrame:
    """Apriori pruning: drop commodities held by fewer than ``min_support``
    baskets from every itemset. Exact for all pairs counted ``min_support``
    times or more (a pair never outnumbers either of its items). A semi-join
    keeps the frequent codes; baskets left with one code have no pair.
    """
    frequent = support.where(F.col("n_item") >= min_support).select("cid")
    return (itemsets.select("basket_num", F.explode("items").alias("cid"))
            .join(frequent, "cid", "left_semi")
            .groupBy("basket_num").agg(F.collect_set("cid").alias("items"))
            .where(F.size("items") >= 2))


def pair_counts(coded_star: DataFrame, codes: DataFrame, min_support: int = 1) -> DataFrame:
    """``pairs_of`` the baskets of a star, which are written once: dense and sparse blocks both read them."""
    return pairs_of(materialize(basket_itemsets(coded_star)), codes, min_support)


def pairs_of(itemsets: DataFrame, codes: DataFrame, min_support: int = 1) -> DataFrame:
    """Every unordered pair of distinct commodities bought in the same basket:
    (item_1 < item_2, times_bought_together = number of such baskets).
    With ``min_support`` > 1 only pairs bought together at least that often
    are returned, and rare commodities are pruned before the pairing."""
    if min_support > 1:
        itemsets = materialize(prune_itemsets(itemsets, item_support(itemsets), min_support))
    m = cooccurrence(itemsets).where(
        (F.col("a") < F.col("b")) & (F.col("n") >= min_support))
    c1 = codes.select(F.col("cid").alias("a"), F.col("commodity").alias("item_1"))
    c2 = codes.select(F.col("cid").alias("b"), F.col("commodity").alias("item_2"))
    return (m.join(c1, "a").join(c2, "b")
            .select("item_1", "item_2", F.col("n").alias("times_bought_together")))


def top_pairs(pairs: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent pairs (ties by item names)."""
    return pairs.orderBy(F.col("times_bought_together").desc(),
                         F.col("item_1").asc(), F.col("item_2").asc()).limit(n)


def _triples(itemsets: DataFrame) -> DataFrame:
    """(basket_num, a < b < c) of every three items of a basket, the items being in order."""
    def later(rest: str, at: str):
        return F.slice(rest, F.col(at) + 2, F.size(rest))

    first = itemsets.select("basket_num", "items", F.posexplode("items").alias("at", "a"))
    second = (first.select("basket_num", "a", later("items", "at").alias("rest"))
              .select("basket_num", "a", "rest", F.posexplode("rest").alias("at", "b")))
    return second.select("basket_num", "a", "b", F.explode(later("rest", "at")).alias("c"))


def triple_baskets(itemsets: DataFrame, least: int, narrow: int = NARROW) -> DataFrame:
    """(basket_num, items): all that sets of three and more commodities in ``least`` baskets and more are counted from.

    Every three items of such a set are in as many baskets. A basket of up
    to ``narrow`` items keeps those of its triples that may be in ``least``
    baskets: the narrow baskets with the triple are counted, and the wider
    ones are at most those with its first two items. Wider baskets, whose
    triples would be many, stay whole. ``itemsets`` is read twice: materialise it.
    """
    width = F.size("items")
    short = itemsets.where(width.between(3, narrow)).select("basket_num", F.sort_array("items").alias("items"))
    wide = itemsets.where(width > narrow)
    triples = _triples(short)
    counted = triples.groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n"))
    beside = cooccurrence(wide).withColumnRenamed("n", "n_wide")
    often = written(counted.join(beside, ["a", "b"], "left")
                    .where(F.col("n") + F.coalesce("n_wide", F.lit(0)) >= least).select("a", "b", "c"), "triples")
    items = triples.join(often, ["a", "b", "c"], "left_semi").select(
        "basket_num", F.explode(F.array("a", "b", "c")).alias("cid"))
    return items.groupBy("basket_num").agg(F.collect_set("cid").alias("items")).unionByName(
        wide.select("basket_num", "items"))


def frequent_itemsets(coded_star: DataFrame, codes: DataFrame, one_in: int = 3_000, min_size: int = 3) -> DataFrame:
    """Sets of ``min_size`` and more commodities that at least one in ``one_in`` baskets holds.

    Columns: items (names in order, '; ' between them), n_items, n_baskets.
    Parallel FP-growth: commodities below the support are dropped first, and
    each reducer mines the conditional baskets of its share of commodities.
    For sets of three and more it gets ``triple_baskets`` only.
    """
    itemsets = materialize(basket_itemsets(coded_star))
    total = itemsets.count()
    least = max(1, -(-total // one_in))
    mined = materialize(triple_baskets(itemsets, least)) if min_size >= 3 and total else itemsets
    n_mined = mined.count()
    if n_mined < least:
        found = itemsets.select("items", F.lit(0).cast("long").alias("freq")).limit(0)
    else:
        # half a basket below the count: the share is not rounded past it
        found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n_mined).fit(mined).freqItemsets
    found = found.where(F.size("items") >= min_size).select(
        F.array_sort("items").alias("cids"), F.col("freq").alias("n_baskets"))
    names = (found.select("cids", "n_baskets", F.posexplode("cids").alias("at", "cid")).join(codes, "cid")
             .groupBy("cids", "n_baskets").agg(F.array_sort(F.collect_list(F.struct("at", "commodity"))).alias("named")))
    return names.select(F.array_join(F.col("named.commodity"), "; ").alias("items"),
                        F.size("cids").alias("n_items"), "n_baskets")


def basket_items(star: DataFrame) -> DataFrame:
    """Per basket: number of distinct commodities and their sorted list as text."""
    lines = star.where(F.col("commodity").isNotNull())
    return lines.groupBy("basket_num").agg(
        F.count_distinct("commodity").alias("n_items"),
        F.array_join(F.array_sort(F.collect_set("commodity")), "; ").alias("items"))


def association_rules(coded_star: DataFrame, codes: DataFrame,
                      min_together: int = 1) -> DataFrame:
    """Pair rules in both directions with support, confidence and lift.

    support = n(a,b)/N, confidence = n(a,b)/n(a), lift = n(a,b)·N/(n(a)·n(b)),
    N = baskets with at least one commodity, a scalar subquery. The itemsets
    (one row per basket) and the item supports (one row per commodity) are
    each materialised once; the matrix is read once, each cell giving both
    directions. With ``min_together`` > 1 commodities held by fewer baskets
    are pruned before the matrix; supports and N still count every basket.
    """
    itemsets = materialize(basket_itemsets(coded_star))
    support = materialize(item_support(itemsets))
    total = itemsets.agg(F.count(F.lit(1))).scalar()
    paired = materialize(prune_itemsets(itemsets, support, min_together)) if min_together > 1 else itemsets
    both = (cooccurrence(paired).where((F.col("a") < F.col("b")) & (F.col("n") >= min_together))
            .select("n", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")),
                                           F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("p"))
            .select("p.x", "p.y", "n"))
    dx = support.select(F.col("cid").alias("x"), F.col("n_item").alias("n_x"))
    dy = support.select(F.col("cid").alias("y"), F.col("n_item").alias("n_y"))
    names_x = codes.select(F.col("cid").alias("x"), F.col("commodity").alias("antecedent"))
    names_y = codes.select(F.col("cid").alias("y"), F.col("commodity").alias("consequent"))
    j = both.join(dx, "x").join(dy, "y").join(names_x, "x").join(names_y, "y")
    n = F.col("n").cast("double")
    return j.select(
        "antecedent", "consequent",
        F.col("n").alias("n_together"),
        F.round(n / total, 6).alias("support"),
        F.round(n / F.col("n_x"), 6).alias("confidence"),
        F.round(n * total / (F.col("n_x").cast("double") * F.col("n_y")), 6).alias("lift"),
    )
