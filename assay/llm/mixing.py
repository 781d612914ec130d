"""Mixing sources to target weights: a splitting tree of block quotas, in native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assay.llm.common import WORD, Scratch

#: Weights by the rank of a source, repeating. Fixed values of the contract.
WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Words of a shard, the least number of shards, and blocks of a shard.
SHARD_WORDS, LEAST_SHARDS, SHARD_BLOCKS = 1 << 24, 8, 64
#: in_order cuts the order of 64-bit hashes into 64 stretches, which are the hashes shifted by this many bits.
PART_SHIFT = 58


def sized(df: DataFrame, text: str = "text") -> DataFrame:
    """Add size, the number of words (null: 0)."""
    return df.withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))


def numbered(per: DataFrame, scratch: Scratch) -> DataFrame:
    """Add nth, the 0-based place of a source by code points, null last: a sort by range, whose parts are written and put
    after one another, so that no task holds all sources. What is added up over the parts is a row a part."""
    rows = per.orderBy(F.col("source").asc_nulls_last()).withColumn("__id", F.monotonically_increasing_id())
    rows = scratch.table(rows).withColumn("__part", F.shiftright("__id", 33))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__first"))
    nth = F.col("__id").bitwiseAND((1 << 33) - 1) + F.col("__first")
    return rows.join(F.broadcast(starts), "__part").withColumn("nth", nth).drop("__id", "__part", "__first")


def fill_level(per: DataFrame) -> tuple[int, int, float]:
    """Number of sources, their words, and the words a unit of weight that the sources get which don't stop.

    In every round the sources whose limit is at most their share stop, and what they leave raises the share of the
    others, until no more stop. Either the weight that is left or the excess falls by a constant factor a round, so
    rounds are few; each is one aggregate.
    """
    ratio, level, stopped = F.col("most") / F.col("weight"), 0.0, -1
    while True:
        stops = ratio <= level if stopped >= 0 else F.lit(False)
        r = per.agg(
            F.count("*").alias("n"), F.sum("source_size").alias("words"), F.count(F.when(stops, 1)).alias("stopped"),
            F.sum(F.when(stops, F.col("most"))).alias("given"), F.sum(F.when(~stops, F.col("weight"))).alias("weight"),
        ).first()
        if r["stopped"] == stopped or not r["weight"]:
            return r["n"], r["words"] or 0, level
        level, stopped = (r["words"] - (r["given"] or 0)) / r["weight"], r["stopped"]


def source_targets(sizes: DataFrame, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """For rows (source, size): source_size, n_docs, target and quota (whole words) of every source; the number of
    sources and of words.

    Targets share the total by weight. A source stops at REPEATS times its size, and what it leaves is shared
    by weight among the rest.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("nth") % len(WEIGHTS) + 1).cast("int")).cast("long")
    per = numbered(per, scratch).withColumns({"weight": weight, "most": F.col("source_size") * REPEATS})
    n_sources, words, level = fill_level(per)
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.lit(level))
    per = per.withColumn("target", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target))
    quota = F.least(F.round("target").cast("long"), F.col("most"))
    return per.select("source", "source_size", "n_docs", "target", quota.alias("quota")), n_sources, words


def block_count(total_words: int, blocks: int) -> Column:
    """Blocks of a source: in proportion to its words, at least 1, at most one a document."""
    share = F.ceil(F.col("source_size") * blocks / max(total_words, 1))
    return F.greatest(F.least(share, F.col("n_docs")), F.lit(1)).cast("long")


def in_order(df: DataFrame, by: list[str], order: Column, ties: list[str], scratch: Scratch, words: str | None = None) -> DataFrame:
    """Add nth, the 0-based place of a row among those equal in `by`, in the order of a hash and then of ties, and with
    `words` also end, the sum of that column up to the row.

    Rows of a group are dealt by their hash to 64 stretches of the order, which are numbered apart and put after
    one another, so that no task sorts a whole group.
    """
    rows = df.withColumn("__order", order).withColumn("__part", F.shiftright("__order", PART_SHIFT))
    if words is None:
        rows = rows.withColumn("__one", F.lit(1).cast("long"))
    value = words or "__one"
    sums = rows.groupBy(*by, "__part").agg(F.count("*").alias("__n"), F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    starts = sums.select(*by, "__part", F.coalesce(F.sum("__n").over(earlier), none).alias("__first"), F.coalesce(F.sum("__sum").over(earlier), none).alias("__before"))
    starts = scratch.table(starts)
    here = Window.partitionBy(*by, "__part").orderBy("__order", *[F.col(t).asc_nulls_last() for t in ties])
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"nth": F.row_number().over(here).cast("long") - 1, "end": F.sum(value).over(upto)})
    left, right = rows.alias("l"), starts.alias("r")
    same = F.col("l.__part") == F.col("r.__part")
    for c in by:
        same &= F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    both = left.join(right, same).select("l.*", "__first", "__before")
    both = both.withColumns({"nth": F.col("nth") + F.col("__first"), "end": F.col("end") + F.col("__before")})
    both = both.drop("__order", "__part", "__one", "__first", "__before")
    return both if words else both.drop("end")


def shard_quotas(needed: DataFrame, shards: int, seed: int) -> DataFrame:
    """Split the block quota of every source, its rows in needed, among output shards: rows (source, shard, offset, n).

    At each node of the tree its blocks, of all sources, are put in an order by hash and dealt to the two halves in
    proportion to their shards: the counts of the left half are a draw from the multivariate hypergeometric
    distribution, and the counts of a source over all shards sum to what it had.
    """
    scratch = Scratch(needed.sparkSession)
    quotas = needed.groupBy("source").agg(F.count("*").alias("n"))
    blocks = quotas.select("source", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
    unit = scratch.table(blocks.withColumns({"lo": F.lit(0), "hi": F.lit(shards)}))
    width, level = shards, 0
    while width > 1:
        before = unit
        sizes = unit.groupBy("lo").agg(F.count("*").alias("all"))
        placed = in_order(unit, ["lo"], F.xxhash64(F.lit(seed), F.lit(level), "source", "i"), ["source", "i"], scratch)
        placed = placed.join(sizes, "lo")
        mid = F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2).cast("int")
        room = F.floor(F.col("all") * (mid - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1)))
        single = F.col("hi") - F.col("lo") == 1
        left = (F.col("nth") < room) & ~single
        unit = scratch.table(
            placed.select("source", "i", F.when(left | single, F.col("lo")).otherwise(mid).alias("lo"), F.when(left, mid).otherwise(F.col("hi")).alias("hi"))
        )
        scratch.drop(before)
        width, level = (width + 1) // 2, level + 1
    per = unit.groupBy("source", F.col("lo").alias("shard")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def plan_mix(sizes: DataFrame, scratch: Scratch, shard_words: int, blocks: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """For rows with source, size and a hash h: the targets of the sources, and the drawn blocks.

    Documents fall into blocks by hash. There is a shard for every shard_words words, LEAST_SHARDS at least, and
    about `blocks` blocks for each of them, so that shards and blocks grow in number with the input and not in
    size; a source has one block at least. A pass over a source is a permutation of its blocks, and its block quota is the
    number of blocks, pass after pass, that its quota of words takes; the last of them is drawn in part. The splitting
    tree deals the block quotas of all sources to the shards. Each shard then draws as many blocks of a source as it was
    dealt, the next ones of the permutation, so that no two shards share one.
    """
    targets, n_sources, words = source_targets(sizes, scratch)
    shards = max(LEAST_SHARDS, -(-words // shard_words))
    targets = scratch.table(targets.withColumn("n_blocks", block_count(words, shards * blocks)))
    # a table of sources is broadcast only where it is small; Spark's own threshold decides otherwise
    targets = F.broadcast(targets) if n_sources <= 100_000 else targets
    per_block = placed(sizes, targets).groupBy("source", "block", "quota").agg(F.sum("size").alias("words"))
    passes = per_block.where("words > 0").withColumn("pass", F.explode(F.array(*map(F.lit, range(REPEATS)))))
    # a whole pass takes as many words as the source has
    source_words = passes.groupBy("source", "pass").agg(F.sum("words").alias("all"), F.count("*").alias("count"))
    sofar = Window.partitionBy("source").orderBy("pass").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    begins = scratch.table(source_words.select("source", "pass", F.coalesce(F.sum("all").over(sofar), none).alias("words_before"), F.coalesce(F.sum("count").over(sofar), none).alias("blocks_before")))
    ranked = in_order(passes, ["source", "pass"], F.xxhash64(F.lit(seed), "source", "block", "pass"), ["block"], scratch, "words").alias("p")
    ranked = ranked.join(begins.alias("b"), F.col("p.source").eqNullSafe(F.col("b.source")) & (F.col("p.pass") == F.col("b.pass"))).select(
        "p.source", "p.block", "p.pass", "quota", "words", (F.col("end") + F.col("words_before")).alias("end"), (F.col("nth") + F.col("blocks_before")).alias("rank")
    )
    needed = ranked.where(F.col("end") - F.col("words") < F.col("quota"))
    want = F.least("words", F.col("quota") - F.col("end") + F.col("words"))
    needed = scratch.table(needed.select("source", "block", "pass", "rank", want.alias("want"), "words"))
    quotas = shard_quotas(needed, shards, seed)
    dealt = quotas.select("source", "shard", F.explode(F.sequence("offset", F.col("offset") + F.col("n") - 1)).alias("rank"))
    both = needed.alias("u").join(dealt.alias("q"), F.col("u.source").eqNullSafe(F.col("q.source")) & (F.col("u.rank") == F.col("q.rank")))
    return targets, scratch.table(both.select("u.*", "shard"))


def placed(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Add source_size, target, quota and block to rows with source and h."""
    both = rows.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    return both.select("d.*", "source_size", "target", "quota", F.pmod("h", "n_blocks").alias("block"))


def with_draws(rows: DataFrame, drawn: DataFrame, entire: bool = False) -> DataFrame:
    """Add shards (of the whole passes), passes, last_shard and extra: the words taken of a block drawn in part.

    With `entire`, the document at which the quota ends is taken or left as a whole, whichever comes nearer to the
    quota; where the source has nothing else in the mix, it is taken.
    """
    whole = F.col("want") == F.col("words")
    per = drawn.groupBy("source", "block").agg(
        F.sort_array(F.collect_list(F.when(whole, F.col("shard")))).alias("shards"),
        F.max(F.when(~whole, F.col("shard"))).alias("last_shard"),
        F.coalesce(F.sum(F.when(~whole, F.col("want"))), F.lit(0)).alias("part"),
        (F.max(F.when(~whole, F.col("rank"))) == 0).alias("only"),
    )
    per = F.broadcast(per) if per.count() <= 100_000 else per
    both = rows.alias("d").join(per.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.block") == F.col("b.block")), "left")
    none = F.array().cast("array<int>")
    both = both.select("d.*", F.coalesce("shards", none).alias("shards"), "last_shard", F.coalesce("part", F.lit(0)).alias("part"), "only")
    # only blocks drawn in part, one a source at most, are put in order
    order = Window.partitionBy("source").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(order), F.lit(0))
    room = F.greatest(F.col("part") - before, F.lit(0))
    taken = F.least(F.col("size"), room)
    if entire:
        taken = F.when((room > 0) & ((room * 2 >= F.col("size")) | (F.col("only") & (before == 0))), F.col("size")).otherwise(F.lit(0).cast("long"))
    partly = both.where("part > 0").withColumn("extra", taken)
    rest = both.where("part = 0").withColumn("extra", F.lit(0).cast("long"))
    return rest.unionByName(partly).drop("only").withColumn("passes", F.size("shards"))


def mix(df: DataFrame, spark: SparkSession, shard_words: int = SHARD_WORDS, blocks: int = SHARD_BLOCKS, seed: int = 17) -> DataFrame:
    """Rows (doc_id, source) with a text become rows with size, source_size, target, taken, shards and place.

    taken counts the words that the mix takes of a row, repeats included; it is at most 3 times the size.
    shards are those that draw the row, once for every copy, and place orders its copies within each of them.
    The sum over a source is its target, rounded. Texts without words take nothing. A null source is a source
    of its own, last in order. The draw depends on hashes of doc_id, source and size only, so that reruns and
    other partitionings agree; repeated rows share a block and are drawn one after the
    other. A text counts as a whole, however long; other columns play no part; an empty table gives an empty one.
    """
    sizes = sized(df.select("doc_id", "source", "text")).drop("text")
    scratch = Scratch(spark)
    sizes = scratch.table(sizes.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "source", "size")))
    targets, drawn = plan_mix(sizes, scratch, shard_words, blocks, seed)
    out = with_draws(placed(sizes, targets), drawn)
    shards = F.when(F.col("extra") > 0, F.concat("shards", F.array("last_shard"))).otherwise(F.col("shards"))
    taken = (F.col("size") * F.col("passes") + F.col("extra")).cast("long")
    place = F.xxhash64(F.lit(seed + 1), "doc_id", "h").alias("place")
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), shards.alias("shards"), place)


def draw(df: DataFrame, spark: SparkSession, shard_words: int = SHARD_WORDS, blocks: int = SHARD_BLOCKS, seed: int = 17, entire: bool = False, with_shard: bool = True) -> DataFrame:
    """The mixed documents themselves: every row as often as it is drawn, in an order by hash within its shard.

    Of the document at which a source's quota ends, the last copy has the leading words that the quota still
    allows; with `entire`, every copy is the whole text (see with_draws), and a source misses its quota by half a
    document at most, or by less than one where that is all it has in the mix. The columns of df stay, whatever their
    names, but for one named shard, which is replaced; shard follows. Without with_shard all columns stay, and none
    follows. An empty table gives an empty mix.
    """
    sizes = sized(df.select("doc_id", "source", "text")).drop("text")
    scratch = Scratch(spark)
    sizes = scratch.table(sizes.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "source", "size")))
    targets, drawn = plan_mix(sizes, scratch, shard_words, blocks, seed)
    stay = [c for c in df.columns if c.lower() != "shard" or not with_shard]
    others = F.struct(*[F.col(f"`{c}`") for c in stay if c != "text"]).alias("__row")
    rows = sized(df.select("doc_id", "source", "text", others)).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "source", "size"))
    rows = with_draws(placed(rows, targets), drawn, entire)
    none = F.lit(None).cast("long")
    copies = F.transform("shards", lambda x: F.struct(x.alias("shard"), none.alias("words")))
    last = F.array(F.struct(F.col("last_shard").alias("shard"), F.col("extra").alias("words")))
    out = rows.withColumn("copy", F.explode(F.when(F.col("extra") > 0, F.concat(copies, last)).otherwise(copies)))
    cut = (F.col("copy.words") < F.col("size")) & F.col("copy.words").isNotNull()
    leading = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("copy.words").cast("int")), " ")
    out = out.withColumns({"text": F.when(cut, leading).otherwise(F.col("text")), "shard": F.col("copy.shard")})
    out = out.repartition("shard", "block").sortWithinPartitions("shard", F.xxhash64(F.lit(seed + 1), "doc_id", "h"))
    return out.select(*[F.col("text") if c == "text" else F.col("__row").getField(c).alias(c) for c in stay], *["shard"] * with_shard)
