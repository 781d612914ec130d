"""N-gram Jaccard join by parity sketches.

Every shingle of a document flips one pseudo-random bit of a long sketch, so that the Hamming distance of two
sketches never exceeds the symmetric difference of the two shingle sets. Documents whose Jaccard similarity
reaches num/den differ in at most D shingles, where D follows from their sizes; with the sketch cut into more
than D pieces, linked documents agree in some pieces (pigeonhole). Pieces are joined by size band on a 64-bit
linear fingerprint, and candidates are verified on the whole texts.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.common import Scratch, fresh, map_column, mix64, slices

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bits of the stored sketch, which rejects candidates before their texts are compared.
SKETCH_BITS = 1024
#: The bits of a token above this one hold its band.
LEVEL_SHIFT = 58
#: Sets that meet in one task at a time are two blocks at most.
BLOCK = 512
#: Pairs of one text that are verified in a task.
FAN = 256
#: Hashes of words that a worker remembers; at the limit it forgets them and goes on.
REMEMBERED = 200_000


@dataclass(frozen=True)
class Similarity:
    """Jaccard similarity of at least num/den on sets of k-word shingles, and the size bands that follow."""

    k: int = 5
    num: int = 80
    den: int = 100
    growth: float = 1.5
    spare: float = 0.2
    bounds: list[int] = field(default_factory=lambda: [1], compare=False)

    def __post_init__(self):
        while self.bounds[-1] < 1 << 40:
            self.bounds.append(max(self.bounds[-1] + 1, int(self.bounds[-1] * self.growth)))

    def most(self, level: int) -> int:
        """D: the largest symmetric difference of linked sets of sizes up to the end of a band."""
        return 2 * (self.bounds[level + 1] - 1) * (self.den - self.num) // (self.den + self.num)

    def pieces(self, level: int) -> int:
        return self.most(level) + 1 + int(self.spare * (self.most(level) + 1)) + 1

    def levels(self, n: int) -> list[int]:
        """The band of n, and the next one if a set of that band can be linked with one of size n."""
        own = bisect.bisect_right(self.bounds, n) - 1
        both = [own, own + 1] if n * self.den >= self.num * self.bounds[own + 1] else [own]
        return [j for j in both if self.most(j) > 0]

    def agree(self, level: int) -> int:
        """Pieces in which linked documents of a band agree at least."""
        return self.pieces(level) - self.most(level)

    def linked(self, both: int, a: int, b: int) -> bool:
        return a > 0 and b > 0 and self.den * both >= self.num * (a + b - both)


class Shingler:
    """Distinct hashed k-word shingles of texts, sorted."""

    def __init__(self, k: int):
        self.k, self.known = k, {}

    def word_hashes(self, text: str) -> np.ndarray:
        words = text.encode("utf-8").translate(LOWER).split()
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for w in set(words).difference(known):
                known[w] = xxhash.xxh64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str | None) -> np.ndarray:
        h = self.word_hashes(text or "")
        n = max(1, len(h) - self.k + 1) if len(h) else 0
        width = min(self.k, len(h))
        out = np.full(n, width, np.uint64)
        for j in range(width):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
        return np.unique(out)


def identity(shingles: np.ndarray) -> int:
    """A 64-bit name of a set; 0 for the empty set, which is linked with nothing."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes()) | 1))) if len(shingles) else 0


def sketch(shingles: np.ndarray) -> np.ndarray:
    flips = np.bincount((shingles & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64)


def piece_tokens(shingles: np.ndarray, level: int, pieces: int) -> tuple[np.ndarray, np.ndarray]:
    """One token for each piece, and which pieces are empty: band, and a hash of the number of the piece and of the
    XOR of its shingles' bit hashes."""
    part = ((shingles >> np.uint64(32)) * np.uint64(pieces)) >> np.uint64(32)
    xor, empty = np.zeros(pieces, np.uint64), np.ones(pieces, bool)
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    at = part[first].astype(np.int64)
    xor[at], empty[at] = np.bitwise_xor.reduceat(mix64(shingles + np.uint64(0x5851F42D4C957F2D)), first), False
    place = np.arange(pieces, dtype=np.uint64) + (np.uint64(level + 1) << np.uint64(40))
    token = mix64(xor ^ mix64(place)) >> np.uint64(64 - LEVEL_SHIFT) | np.uint64(level) << np.uint64(LEVEL_SHIFT)
    return token.view(np.int64), empty


def described(df: DataFrame, sim: Similarity) -> DataFrame:
    """Rows with text become rows with n_shingles, cls, sketch and tokens instead: one pass over the texts.

    cls names the shingle set (0: empty), equal sets alike. tokens are its sketch pieces, ranks the places from which
    they count (see all_tokens); where a task has met the set before, they are left out (see shared_pieces), as they are
    for rows that do not take part.
    """
    longs = T.ArrayType(T.LongType())
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("cls", T.LongType()), T.StructField("sketch", longs)]
    fields += [T.StructField("tokens", longs), T.StructField("ranks", longs)]

    def make():
        shingler, seen, none = Shingler(sim.k), set(), np.zeros(0, np.int64)

        def kernel(texts, takes_part):
            sizes, names, bits, tokens, ranks = [], [], [], [], []
            for text, wanted in zip(texts.to_pylist(), takes_part.to_pylist()):
                shingles = shingler(text)
                name = identity(shingles)
                sizes.append(len(shingles))
                names.append(name)
                if wanted and name and name not in seen:
                    seen.add(name)
                    made = sketch(shingles), *all_tokens(shingles, sim)
                else:
                    made = none, none, none
                for column, values in zip((bits, tokens, ranks), made):
                    column.append(values)
            return [pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), *map(lists_of, (bits, tokens, ranks))]

        return kernel

    return map_column(df, "text", make, fields, drop=("text",), also=("takes_part",))


def lists_of(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays)))


def all_tokens(shingles: np.ndarray, sim: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of a set at all of its levels, and for each the rank from which shared_pieces keeps it.

    Linked sets agree in sim.agree(level) pieces of a level at least, empty ones counted. Of a set with e empty pieces
    they agree in agree - e others, so these can be found by the pieces from that rank on; e counts whether the empty
    pieces are left out or not. A set with fewer empty pieces than sim.agree(level) leaves them out, as they cannot be
    all that it has in common with another one.
    """
    out, ranks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for level in sim.levels(len(shingles)):
        tokens, empty = piece_tokens(shingles, level, sim.pieces(level))
        least = sim.agree(level) - int(empty.sum())
        out.append(tokens[~empty] if least > 0 else tokens)
        ranks.append(np.full(len(out[-1]), max(1, least)))
    return np.concatenate(out), np.concatenate(ranks)


def hot_tokens(pieces: DataFrame, share: int = 64, least: int = 64, most: int = 100_000) -> DataFrame:
    """(token, freq, pivot): the most frequent tokens, as the sets of one hash class in `share` show them.

    This only says which rows need not meet in one task, as their token is known to be shared: it holds what
    many sets share and what a few don't, and no result depends on it.
    """
    some = pieces.where(F.pmod(F.xxhash64("cls"), F.lit(share)) == 0).groupBy("token")
    counted = some.agg(F.count("*").alias("n"), F.min("cls").alias("pivot"), F.max("cls").alias("last")).where((F.col("n") >= least) & (F.col("pivot") < F.col("last")))
    return counted.orderBy(F.desc("n"), "token").limit(most).select("token", (F.col("n") * share).alias("freq"), "pivot")


def shared_pieces(pieces: DataFrame, scratch: Scratch) -> DataFrame:
    """(cls, token, pivot): pieces by which sets can be found, those that many sets share left out where they may be.

    Linked sets have o pieces of a level in common at least, o being the rank that either set gives them (see
    all_tokens). A set with fewer pieces that other sets have too is linked with none there; of the others, the o - 1
    most frequent pieces can be left out: the order by frequency is the same for all sets, so the least frequent piece
    that two linked sets share has a rank of o or more in both. So pieces that lie wholly in a passage of many
    documents lead to no candidates, and no link is lost. pivot is one set with that piece.
    """
    hot = scratch.table(hot_tokens(pieces))
    marked = pieces.join(F.broadcast(hot), "token", "left")
    frequent = marked.where("freq is not null").select("token", "cls", "least", "freq", "pivot")
    token, own = Window.partitionBy("token"), Window.partitionBy("cls", "level")
    rare = marked.where("freq is null").select("token", "cls", "least")
    rare = rare.withColumns({"freq": F.count("*").over(token), "pivot": F.min("cls").over(token), "last": F.max("cls").over(token)})
    shared = rare.where("pivot < last").select("token", "cls", "least", "freq", "pivot").union(frequent)
    shared = shared.withColumn("level", F.shiftrightunsigned("token", LEVEL_SHIFT).cast("int"))
    ranked = shared.withColumn("rank", F.row_number().over(own.orderBy(F.desc("freq"), "token")))
    return ranked.where("rank >= least").select("cls", "token", "pivot")


def small(df: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """df with a broadcast hint if its rows, of numbers and arrays of one sketch's length, fit in most_bytes; a join
    by shuffle is the way beyond."""
    width = sum(8 * SKETCH_BITS // 64 if isinstance(f.dataType, T.ArrayType) else 8 for f in df.schema.fields)
    rows = most_bytes // width
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def verified(pairs: DataFrame, facts: DataFrame, texts: DataFrame, sim: Similarity, scratch: Scratch) -> DataFrame:
    """The linked ones of pairs (a, b): first by sizes and sketches, then by the shingles of the whole texts.

    Only texts of pairs that the sketches leave over travel. A text that stands on the left of many pairs
    is sent to as many tasks as it has FAN pairs.
    """
    few = small(facts)
    left, right = (few.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    apart = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    total = F.col("n_a") + F.col("n_b")
    near = sim.den * F.least("n_a", "n_b") >= sim.num * F.greatest("n_a", "n_b")
    left_over = both.where(near).where(apart * (sim.den + sim.num) <= total * (sim.den - sim.num)).select("a", "b")
    left_over = scratch.table(left_over.distinct())
    parts = scratch.table(left_over.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("parts")))
    keyed = left_over.join(small(parts), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    with_b = texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")).join(small(keyed), "b")
    with_a = texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")).join(small(parts), "a")
    with_a = with_a.select("a", "text_a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    whole = with_b.join(with_a.hint("merge"), ["a", "part"])
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last, known = Shingler(sim.k), None, None
        for batch in batches:
            for part in slices(batch, "text_b"):
                out = []
                for a, b, text_a, text_b in zip(*(part.column(n).to_pylist() for n in ("a", "b", "text_a", "text_b"))):
                    if a != last:
                        last, known = a, shingler(text_a)
                    other = shingler(text_b)
                    if sim.linked(len(np.intersect1d(known, other, assume_unique=True)), len(known), len(other)):
                        out.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return whole.select("a", "b", "text_a", "text_b").mapInArrow(run, schema)


def smallest_reachable(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, root) for all vertices of edges (a, b): root is the smallest vertex of the component.

    Alternating stars: each vertex hands its larger neighbours to its smallest one, then its smaller ones.
    Every round is a few aggregations and joins; only the number and a checksum of the rows come to the driver.
    """
    mark = lambda t: tuple(t.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u"))).first())
    tree = scratch.table(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct())
    before = mark(tree)
    while True:
        both = tree.select("v", "u").union(tree.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u < v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        down = large.join(least, "v")
        hung = down.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).union(least.select("v", F.col("m").alias("u")))
        new = scratch.table(hung.where("u < v").distinct())
        scratch.drop(tree)
        tree, now = new, mark(new)
        if now == before:
            break
        before = now
    roots = tree.select(F.col("u").alias("v")).distinct().join(tree.select("v"), "v", "left_anti")
    return tree.select("v", F.col("u").alias("root")).union(roots.select("v", F.col("v").alias("root")))


def cross_pairs(members: DataFrame, facts: DataFrame, sim: Similarity) -> DataFrame:
    """Pairs (a, b) of sets in different components that share a piece and may be linked by sizes and sketches.

    Rows (token, cls, comp) are dealt in blocks: the sets of a token's largest component meet the others, and
    the others meet each other, so that a task never holds more than two blocks, and no block of the largest
    component meets another one of it. A pair comes from the least of its common pieces only.
    """
    per = members.groupBy("token", "comp").agg(F.count("*").alias("c"))
    per = per.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("main"), F.sum("c").alias("all"))
    blocks = lambda c: F.greatest(F.ceil(c / BLOCK), F.lit(1)).cast("int")
    per = per.select("token", F.col("main.comp").alias("main"), "all", blocks(F.col("main.c")).alias("nm"), blocks(F.col("all") - F.col("main.c")).alias("nr"))
    rows = members.select("token", "cls", "comp").join(per, "token")
    own = members.groupBy("cls").agg(F.collect_set("token").alias("own"))  # the pieces of one text
    kind, h = (lambda k, x, y: F.struct(F.lit(k).alias("kind"), x.cast("int").alias("x"), y.cast("int").alias("y"))), F.xxhash64("cls")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    mine_m, mine_r = F.pmod(h, F.col("nm")).cast("int"), F.pmod(h, F.col("nr")).cast("int")
    of_main = F.transform(upto(F.col("nr")), lambda j: kind(1, mine_m, j))
    to_main = F.transform(upto(F.col("nm")), lambda i: kind(1, i, mine_r))
    to_rest = F.transform(upto(F.col("nr")), lambda j: kind(2, F.least(j, mine_r), F.greatest(j, mine_r)))
    whole = F.array(kind(0, F.lit(0), F.lit(0)))
    keys = F.when(F.col("all") <= BLOCK, whole).when(F.col("comp") == F.col("main"), of_main).otherwise(F.concat(to_main, to_rest))
    dealt = rows.withColumn("key", F.explode(keys)).join(small(facts), "cls").join(own, "cls")
    key = F.when(F.col("key.kind") == 0, F.col("token")).otherwise(F.xxhash64("token", "key.kind", "key.x", "key.y"))
    # only lesser pieces decide whether a pair comes from this one
    dealt = dealt.select("token", key.alias("key"), "cls", "comp", "n", "sketch", F.array_sort(F.filter("own", lambda x: x < F.col("token"))).alias("own"))
    dealt = dealt.repartition("key", "token").sortWithinPartitions("token", "key")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def near(group: list[np.ndarray]) -> list[np.ndarray]:
        cls, comp, n, bits, own = group
        out = [np.zeros((0, 2), np.int64)]
        for start in range(0, len(cls), 64):
            at = slice(start, start + 64)
            total, least, most = n[at, None] + n, np.minimum(n[at, None], n), np.maximum(n[at, None], n)
            maybe = (comp[at, None] != comp) & (sim.den * least >= sim.num * most) & (cls[at, None] < cls)
            i, j = np.nonzero(maybe)
            apart = np.bitwise_count((bits[i + start] ^ bits[j]).view(np.uint64)).sum(axis=1, dtype=np.int64)
            ok = apart * (sim.den + sim.num) <= total[i, j] * (sim.den - sim.num)
            i, j = i[ok] + start, j[ok]
            first = [not len(np.intersect1d(own[x], own[y], assume_unique=True)) for x, y in zip(i, j)]
            out.append(np.column_stack([cls[i], cls[j]])[np.array(first, bool)])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            found = []
            if batch is not None and batch.num_rows:
                key = np.column_stack([batch.column(i).to_numpy() for i in range(2)])
                bits = batch.column(5).flatten().to_numpy().reshape(-1, SKETCH_BITS // 64)
                own = np.empty(batch.num_rows, object)
                ends = np.cumsum(pc.list_value_length(batch.column(6)).to_numpy())[:-1]
                for i, tokens in enumerate(np.split(batch.column(6).flatten().to_numpy(), ends)):
                    own[i] = tokens
                parts = [key, *(batch.column(i).to_numpy() for i in (2, 3, 4)), bits, own]
                held = parts if held is None else [np.concatenate(x) for x in zip(held, parts)]
            if held is not None:
                key = held[0]
                first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
                ends = np.r_[first[1:], len(key)]
                open_group = batch is not None  # the last group may go on in the next batch
                for start, end in list(zip(first, ends))[: len(first) - open_group]:
                    if end - start > 1:
                        found += near([x[start:end] for x in held[1:]])
                held = [x[first[-1] :] for x in held] if open_group else None
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return dealt.mapInArrow(run, schema).distinct()


def joined_sets(shared: DataFrame, facts: DataFrame, texts: DataFrame, sim: Similarity, scratch: Scratch) -> DataFrame:
    """(cls, comp) of all sets in facts: comp is the least name in the component.

    First every set is compared with the pivots of its pieces, then with other ones, which joins most of a group of
    near copies. What then is in different components and shares a piece is compared pair by pair, so that
    components come out whole without all pairs of a group.
    """
    pairs = scratch.table(shared.where("cls <> pivot").select(F.col("pivot").alias("a"), F.col("cls").alias("b")).distinct())
    names, tested, links = facts.select("cls"), pairs, None
    for turn in range(3):
        if turn:
            members = shared.select("cls", "token").join(small(comp), "cls").select("token", "cls", "comp")
            mixed = members.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
            members = scratch.table(members.join(small(mixed.select("token")), "token"))
            if members.isEmpty():
                break
            if turn == 1:
                pivot = members.groupBy("token").agg(F.min_by(F.struct("cls", "comp"), F.xxhash64("cls")).alias("p"))
                pairs = members.join(pivot, "token").where("comp <> p.comp").select(F.col("p.cls").alias("a"), F.col("cls").alias("b")).distinct()
            else:
                pairs = cross_pairs(members, facts, sim)
            turned = tested.select(F.col("b").alias("a"), F.col("a").alias("b"))
            pairs = scratch.table(pairs.join(tested.union(turned), ["a", "b"], "left_anti"))
            scratch.drop(members)
            tested = tested.union(pairs)
        new = scratch.table(verified(pairs, facts, texts, sim, scratch).distinct())
        if links is not None and new.isEmpty():
            continue
        links = new if links is None else links.union(new)
        root = smallest_reachable(links, scratch)
        comp = scratch.table(names.join(small(scratch.table(root)), F.col("cls") == F.col("v"), "left").select("cls", F.coalesce("root", "cls").alias("comp")))
    return comp


def text_components(df: DataFrame, sim: Similarity, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, comp, repeats) of rows (doc_id, text, takes_part).

    base: doc_id, th (a hash of the text), n_shingles and cls of every row. comp: cls and comp of the sets that links
    of rows that take part join, but for those with comp = cls. repeats: (doc_id, th) of more than one row.
    """
    marked = df.withColumns({"th": F.xxhash64("text"), "uid": F.monotonically_increasing_id()})
    base = scratch.table(described(marked, sim))
    repeats = scratch.table(base.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "th"))
    # of equal sets the pieces of one row count
    with_tokens = base.where(F.size("tokens") > 0)
    again = with_tokens.groupBy("cls").agg(F.count("*").alias("n"), F.min("uid").alias("first")).where("n > 1").select("cls", "first")
    one = with_tokens.join(small(scratch.table(again)), "cls", "left").where("first is null or uid = first")
    pieces = one.select("cls", F.inline(F.arrays_zip(F.col("tokens").alias("token"), F.col("ranks").cast("array<int>").alias("least"))))
    shared = scratch.table(shared_pieces(pieces.select("token", "cls", "least"), scratch))
    named = scratch.table(shared.select("cls").distinct())
    facts = scratch.table(one.join(small(named), "cls").select("cls", "doc_id", "th", F.col("n_shingles").alias("n"), "sketch"))
    slim = scratch.table(base.select("doc_id", "th", "n_shingles", "cls"))
    scratch.drop(base)
    key = small(facts.select("cls", F.col("doc_id").alias("key"), F.col("th").alias("key_th")))
    same = (F.xxhash64("text") == F.col("key_th")) & F.col("doc_id").eqNullSafe(F.col("key"))
    texts = df.select("doc_id", "text").join(key, same).select("cls", "text")
    if not repeats.isEmpty():
        texts = texts.groupBy("cls").agg(F.first("text").alias("text"))
    texts = scratch.table(texts)
    comp = joined_sets(shared, facts.select("cls", "n", "sketch"), texts, sim, scratch)
    comp = scratch.table(comp.where("cls <> comp"))
    for used in (shared, facts, texts):
        scratch.drop(used)
    return slim, comp, repeats


def near_duplicates(df: DataFrame, spark: SparkSession, sim: Similarity | None = None) -> DataFrame:
    """Rows (doc_id, text) become rows (doc_id, n_shingles, component_id), one for one.

    component_id is the smallest doc_id that links reach. Equal sets are linked; empty ones (a null or empty
    text, or one without words) are linked with nothing. Rows that repeat a doc_id are one vertex with the links of all
    their texts. A row without doc_id is no vertex: its component_id is null, and nothing is linked through it. Other
    columns of df play no part; an empty table gives an empty one. A text is held in one task as a whole, with its words.
    """
    sim, scratch = sim or Similarity(), Scratch(spark)
    base, comp, _ = text_components(df.select("doc_id", "text", F.col("doc_id").isNotNull().alias("takes_part")), sim, scratch)
    texts = F.when(F.col("cls") != 0, F.col("cls"))
    split = base.where("doc_id is not null").groupBy("doc_id").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.min(texts).alias("a"))
    split = scratch.table(split.where("lo < hi").select("doc_id", "a"))
    if not split.isEmpty():  # one id stands on rows with different texts
        joined = base.join(small(split), "doc_id", "left")
        edges = joined.where("cls <> 0 and a <> cls").select("a", F.col("cls").alias("b"))
        edges = edges.union(comp.select(F.col("comp").alias("a"), F.col("cls").alias("b")))
        comp = smallest_reachable(edges.distinct(), scratch)
        comp = scratch.table(comp.where("v <> root").select(F.col("v").alias("cls"), F.col("root").alias("comp")))
        base = scratch.table(joined.withColumn("cls", F.when(F.col("cls") == 0, F.coalesce("a", F.lit(0))).otherwise(F.col("cls"))).drop("a"))
    whole = with_group(base, comp)
    vertices = whole.where("group <> 0 and doc_id is not null")
    roots = vertices.groupBy("group").agg(F.min("doc_id").alias("root"), F.max("doc_id").alias("last")).where("root < last").select("group", "root")
    out = whole.join(small(scratch.table(roots)), "group", "left")
    root = F.when(F.col("doc_id").isNotNull() & (F.col("group") != 0), F.col("root"))
    return out.select("doc_id", "n_shingles", F.coalesce(root, F.col("doc_id")).alias("component_id"))


def with_group(base: DataFrame, comp: DataFrame) -> DataFrame:
    """Add group: the component of the set of a row, 0 for an empty one."""
    return base.join(small(comp), "cls", "left").withColumn("group", F.coalesce("comp", "cls")).drop("comp")


def one_of_each_group(df: DataFrame, spark: SparkSession, sim: Similarity | None = None) -> DataFrame:
    """The rows of df (doc_id, text, ...) without near duplicates: of all rows that links of their texts join, the one
    with the smallest doc_id stays.

    Only texts link here: rows that share nothing but a doc_id are all kept, so that every text that goes has one that
    stays and that links reach. Rows without doc_id take part, and stay only where no other row of their group has
    one. Of rows that repeat doc_id and text one stays. Rows without words all stay. All columns of df are kept.
    """
    sim, scratch = sim or Similarity(), Scratch(spark)
    base, comp, repeats = text_components(df.select("doc_id", "text", F.lit(True).alias("takes_part")), sim, scratch)
    whole = with_group(base, comp).where("group <> 0").select("group", "doc_id", "th")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("best")
    groups = scratch.table(whole.groupBy("group").agg(best, F.count("*").alias("n")).where("n > 1").select("group", F.col("best.doc_id").alias("b"), F.col("best.th").alias("t")))
    other = ~(F.col("doc_id").eqNullSafe(F.col("b")) & (F.col("th") == F.col("t")))
    gone = scratch.table(whole.join(small(groups), "group").where(other).select("doc_id", "th").distinct())
    kept = without(df, gone, "left_anti")
    twice = repeats.join(base.where("cls <> 0").select("th").distinct(), "th", "left_semi")
    twice = scratch.table(twice)
    if twice.isEmpty():
        return kept
    # the least of the rows' hashes stays, of equal ones any; rows are numbered in a written table, so that no task holds
    # all copies of one
    uid, content = fresh(df, "uid"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    copies = scratch.table(without(kept, twice, "left_semi").withColumn(uid, F.monotonically_increasing_id()))
    least = copies.groupBy("doc_id", F.xxhash64("text").alias("th")).agg(F.min(F.struct(content.alias("h"), F.col(uid).alias("u"))).alias("best"))
    first = small(scratch.table(least.select(F.col("best.u").alias(uid))))
    return without(kept, twice, "left_anti").unionByName(copies.join(first, uid, "left_semi").drop(uid))


def without(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Anti or semi join of rows (doc_id, text) with keys (doc_id, th); a null doc_id is a value like others."""
    keys = small(keys.select(F.col("doc_id").alias("key"), F.col("th").alias("key_th")))
    rows, k = df.alias("d"), keys.alias("k")
    return rows.join(k, F.col("d.doc_id").eqNullSafe(F.col("k.key")) & (F.xxhash64("d.text") == F.col("k.key_th")), how)
