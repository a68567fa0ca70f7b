"""Links and components among the members of signature buckets.

``members`` (key, node, n, room) says which nodes share which signature keys,
``n`` being a node's set size and ``room`` the most tokens that it can share
with any node whose prefix ends no earlier than its own (``n`` where nothing
more is known); every pair of similar nodes shares a key. Of two nodes one has
the prefix that ends first, so they can only be linked if the larger room is at
least the intersection that their sizes ask for. Buckets may be large, since a
signature of a big group of near copies is shared by all of them, so pairs are
never listed per bucket. Instead:

1. every member is paired with the bucket's node that misses the fewest
   tokens, and in the buckets that this left in several components also with
   the one of largest id: as many pairs as there are members. Those that parity
   bitmaps do not rule out are compared: a set's bitmap has in each place the
   parity of the tokens that hash there, so two bitmaps differ in at most as
   many places as the sets do in tokens. A bitmap has two to four places per
   token, at most 1024 (of two bitmaps the longer is folded), so of sets of up
   to some 500 tokens what is left is alike at little less than the limit;
2. a bucket whose members are then all in one component needs nothing more,
   as any further link inside it changes no component;
3. the other buckets form blocks, one per first node, and members of different
   components are candidates, leaving out pairs that the set sizes rule out,
   that the triangle inequality of the Jaccard distance rules out, given both
   members' distance from the block's first node, or that their bitmaps do;
4. of the candidates between two components the ``BEST`` most alike are compared
   first; then those that are still between different components.

So every pair that could join two components is compared exactly. Joins on
hot keys are plain equi-joins, which the planner may split. Where one side has
each key once (pivots, bitmaps, components) it is hashed and nothing is sorted.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polylabel.llm import common as C

COUNT_PART = 1 << 21  # hashes that one counting task adds up, about
LONGEST = 2  # bitmaps of at most 4 << LONGEST longs: 1024 places
PLACES = 1 << 20  # places of bitmaps that are counted at a time
BEST = 3  # candidates between two components that are compared before the others
PERCENT = 80  # two sets are linked at 100 * intersection >= PERCENT * union


def blocks(t: np.ndarray, parts: int):
    """Sorted distinct hashes of a chunk and how often each occurs, dealt by
    their leading bits; of the rest 32 bits are kept."""
    bits = C.U64(parts.bit_length() - 1)
    t, n = np.unique(t, return_counts=True)
    low = ((t << bits) >> C.U64(32)).astype(np.uint32)
    cut = np.searchsorted(t >> (C.U64(64) - bits), np.arange(parts + 1, dtype=C.U64))
    rows = [(i, low[a:b], n[a:b]) for i, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1][r[2] == 1].tobytes() for r in rows], pa.binary()),
         pa.array([r[1][r[2] > 1].tobytes() for r in rows], pa.binary()),
         pa.array([r[2][r[2] > 1].astype(np.uint32).tobytes() for r in rows], pa.binary())], ["p", "ones", "many", "counts"])


BLOCK_SCHEMA = "p int, ones binary, many binary, counts binary"


def _key_blocks(parts: int):
    def run(batches):
        for batch in batches:
            keys = batch.column(0).flatten().to_numpy()
            for at in range(0, len(keys), 1 << 19):
                yield blocks(keys[at:at + (1 << 19)].view(C.U64), parts)
    return run


def _add_blocks(least: int):
    def run(table: pa.Table) -> pa.Table:
        read = lambda c: [np.frombuffer(x, np.uint32) for x in table.column(c).to_pylist()]
        ones, many, counts = np.concatenate(read("ones")), np.concatenate(read("many")), np.concatenate(read("counts"))
        keys, at = np.unique(np.concatenate([ones, many]), return_inverse=True)
        n = np.bincount(at[:len(ones)], minlength=len(keys)) + np.bincount(at[len(ones):], counts, len(keys)).astype(np.int64)
        some = n > least
        p = table.column("p")[0].as_py()
        return pa.table({"token": (keys[some].astype(np.int64) | (p << 32)), "n": n[some]})
    return run


def more_than(blocks: DataFrame, least: int) -> DataFrame:
    """(token, n) of the hashes that occur more than ``least`` times; a token
    is the leading bits of a hash: those of the part and 32 more."""
    return blocks.groupBy("p").applyInArrow(_add_blocks(least), "token bigint, n bigint")


def parts_for(total: int) -> int:
    return 1 << max(4, (total // COUNT_PART).bit_length())


def _let_keys(shared):
    def run(batches):
        for batch in batches:
            keys = batch.column(1)
            flat = keys.flatten().to_numpy()
            some = shared.value.lets(flat)
            row = np.repeat(np.arange(len(batch)), pc.list_value_length(keys).to_numpy())[some]
            yield pa.RecordBatch.from_arrays([pa.array(flat[some]), batch.column(0).take(pa.array(row))], ["key", "node"])
    return run


def meeting_keys(prefixes: DataFrame, scratch: C.Scratch) -> DataFrame:
    """The (key, node) pairs of ``prefixes`` (node, keys; one row per node)
    whose key another node has too. Which keys meet is found from blocks of
    hashed keys, combined per block of rows, so a key that very many nodes
    share counts little; a chance meeting of hashes only leaves a key in. Most
    keys meet no other, and a sieve of those that do holds them back before
    any (key, node) pair is made and shuffled."""
    parts = parts_for(int(prefixes.agg(F.sum(F.size("keys"))).first()[0] or 0))
    cut = 32 - (parts.bit_length() - 1)
    met = scratch.stage(more_than(prefixes.select("keys").mapInArrow(_key_blocks(parts), BLOCK_SCHEMA), 1).select("token"), "met")
    shared = prefixes.sparkSession.sparkContext.broadcast(C.sieve(met, F.shiftleft("token", cut), met.count()))
    kind = prefixes.schema["node"].dataType.simpleString()
    # met has each token once, so its side can be hashed and the keys need no sort
    close = scratch.stage(prefixes.select("node", "keys").mapInArrow(_let_keys(shared), f"key bigint, node {kind}")
                          .join(met.hint("shuffle_hash"), F.shiftrightunsigned("key", cut) == F.col("token")).select("key", "node"), "close")
    scratch.drop("met")
    return close


def _can_link(n1, n2, room1, room2):
    """Whether sizes and rooms allow 100 * common >= PERCENT * total. The
    larger room counts: the smaller may be of the node whose prefix ends last,
    and what that has there may lie past the end of the other's."""
    fits = (n1 * 100 >= n2 * PERCENT) & (n2 * 100 >= n1 * PERCENT)
    return fits & (F.greatest(room1, room2) * (100 + PERCENT) >= (n1 + n2) * PERCENT)


def _first(members: DataFrame):
    return members.groupBy("key").agg(F.min(F.struct((F.col("n") - F.col("room")).alias("lacks"), "node", "n", "room")).alias("p"))


def _star(members: DataFrame, pivot: DataFrame) -> DataFrame:
    near = members.join(pivot.hint("shuffle_hash"), "key").filter(
        (F.col("node") != F.col("p.node")) & _can_link(F.col("n"), F.col("p.n"), F.col("room"), F.col("p.room")))
    low = F.col("node") < F.col("p.node")
    return near.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b"),
                       F.when(low, F.col("n")).otherwise(F.col("p.n")).alias("n1"), F.when(low, F.col("p.n")).otherwise(F.col("n")).alias("n2")).distinct()


def _possible(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """(a, b) of the pairs (a, b, n1, n2) that bitmaps do not rule out."""
    of_a, of_b = (bits.select(F.col("node").alias(c), F.col("bits").alias(f"bits{k}")).hint("shuffle_hash") for k, c in ((1, "a"), (2, "b")))
    return pairs.join(of_a, "a", "left").join(of_b, "b", "left").filter(_differing() * (100 + PERCENT) <= _MOST).select("a", "b").distinct()


def _compare(sets: Callable):
    """Exact set comparison of text pairs; ``sets`` turns a string column into
    (sorted unique hashes, counts per row)."""
    def run(batches):
        for batch in C.chunks(batches, "tb", C.SET_BYTES):
            left = batch.column(2)
            size = len(batch)
            # neighbouring rows mostly share their left text: hash each once
            codes = left.dictionary_encode()
            la, na = sets(codes.dictionary)
            lb, nb = sets(batch.column(3))
            pa_, pb = np.concatenate([[0], np.cumsum(na)]), np.concatenate([[0], np.cumsum(nb)])
            at = codes.indices.to_numpy()
            common = np.zeros(size, np.int64)
            for i in range(size):
                x, y = la[pa_[at[i]]:pa_[at[i] + 1]], lb[pb[i]:pb[i + 1]]
                if len(x) and len(y):
                    k = np.searchsorted(x, y)
                    k[k == len(x)] = 0
                    common[i] = np.count_nonzero(x[k] == y)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(common), pa.array(na[at] + nb - common)], ["a", "b", "common", "total"])
    return run


def _asked(shared):
    def run(batches):
        for batch in batches:
            some = pa.array(shared.value.lets(batch.column(2).to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(some) for k in (0, 1)], ["node", "text"])
    return run


def compare(pairs: DataFrame, texts: DataFrame, sets: Callable) -> DataFrame:
    """(a, b, common, total): sizes of intersection and union of the pairs'
    sets. ``pairs`` is a staged table, ``texts`` (node, text); a sieve of the
    pairs' nodes holds most other texts back from the joins."""
    kind = pairs.schema["a"].dataType.simpleString()
    name = F.xxhash64("node")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    asked = pairs.sparkSession.sparkContext.broadcast(C.sieve(nodes, name, 2 * pairs.count()))
    texts = texts.select("node", "text", name.alias("name")).mapInArrow(_asked(asked), f"node {kind}, text string")
    both = (pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
            .join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb"))
    return both.mapInArrow(_compare(sets), f"a {kind}, b {kind}, common bigint, total bigint")


def _bitmaps(t: np.ndarray, n: np.ndarray):
    """(longs of all rows' bitmaps, longs per row); rows with bitmaps of one
    length are worked on together, a bounded number of places at a time."""
    at = np.cumsum(n) - n
    words = np.left_shift(4, np.clip(np.ceil(np.log2(np.maximum(n, 1) / 128)), 0, LONGEST).astype(np.int64))
    to = np.cumsum(words) - words
    flat = np.zeros(int(words.sum()), np.int64)
    for w in np.unique(words).tolist():
        rows = np.flatnonzero(words == w)
        for own in np.split(rows, range(PLACES // (64 * w), len(rows), PLACES // (64 * w))):
            base = np.repeat(np.arange(len(own)) * (64 * w), n[own])
            odd = np.bincount(base + (t[C.ranges(at[own], n[own])] & C.U64(64 * w - 1)).astype(np.int64), minlength=len(own) * 64 * w)
            flat[to[own][:, None] + np.arange(w)] = np.packbits((odd & 1).astype(np.uint8)).view(np.int64).reshape(-1, w)
    return flat, words


def _parities(sets: Callable):
    def run(batches):
        for batch in C.chunks(batches, max_bytes=C.SET_BYTES):
            flat, words = _bitmaps(*sets(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), C.lists(flat, words, pa.int64())], ["node", "bits"])
    return run


def _differ(x, y):
    """In how many places two bitmaps differ. Sizes that may be linked have
    bitmaps of one length, or one of twice the other's."""
    half = lambda b: F.shiftright(F.size(b), 1)
    fold = lambda b: F.zip_with(F.slice(b, F.lit(1), half(b)), F.slice(b, half(b) + 1, half(b)), lambda u, v: u.bitwiseXOR(v))
    a = F.when(F.size(x) > F.size(y), fold(x)).otherwise(x)
    b = F.when(F.size(y) > F.size(x), fold(y)).otherwise(y)
    return F.aggregate(F.zip_with(a, b, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, v: s + v)


_MOST = (100 - PERCENT) * (1 + 1e-9)


def _differing():
    """How much of two sets differs at least, by their bitmaps; 0 without them."""
    return F.coalesce(_differ(F.col("bits1"), F.col("bits2")) / (F.col("n1") + F.col("n2")), F.lit(0.0))


def _soon_apart():
    """Whether the first longs of two bitmaps of one length already rule the
    pair out; spares most pairs the rest of the comparison."""
    x, y = F.col("bits1"), F.col("bits2")
    part = sum((F.coalesce(F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))), F.lit(0)) for i in range(8)), F.lit(0))
    return F.coalesce((F.size(x) == F.size(y)) & (part * (100 + PERCENT) > (F.col("n1") + F.col("n2")) * _MOST), F.lit(False))


def _between(of: DataFrame) -> DataFrame:
    """Pairs of different components in one block that nothing rules out:
    (a, b), their components, and how much of them differs at least."""
    cols = ("node", "n", "room", "component", "d", "bits")
    x = of.select("p", *(F.col(c).alias(f"{c}1") for c in cols))
    y = of.select("p", *(F.col(c).alias(f"{c}2") for c in cols))
    near = F.coalesce(F.abs(F.col("d1") - F.col("d2")) <= (100 - PERCENT) / 100 + 1e-9, F.lit(True))
    fits = _can_link(*map(F.col, ("n1", "n2", "room1", "room2"))) & near
    differ = _differing()
    possible = ~_soon_apart() & (differ * (100 + PERCENT) <= _MOST)
    return (x.join(y, "p").filter((F.col("component1") < F.col("component2")) & fits & possible)
            .select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b"),
                    F.col("component1").alias("c1"), F.col("component2").alias("c2"), differ.alias("differ")))


def linked(df: DataFrame) -> DataFrame:
    return df.filter((F.col("total") > 0) & (F.col("common") * 100 >= F.col("total") * PERCENT))


def _split(of: DataFrame) -> DataFrame:
    """The rows of keys whose nodes are in several components."""
    keys = of.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    return of.join(keys.hint("shuffle_hash"), "key")


def _unresolved(members: DataFrame, comps: DataFrame) -> DataFrame:
    return _split(members.join(comps.hint("shuffle_hash"), "node", "left").withColumn("component", F.coalesce("component", "node")))


def _grown(comps: DataFrame, links: DataFrame, scratch: C.Scratch) -> DataFrame:
    """The components that ``comps`` become by further links; a component
    counts as the links of its nodes to its least."""
    if links.isEmpty():
        return comps
    known = comps.select(F.col("component").alias("a"), F.col("node").alias("b"))
    return C.components(known.unionByName(links.select("a", "b")), scratch)


def resolve(members: DataFrame, texts_of: Callable[[DataFrame], DataFrame], sets: Callable, scratch: C.Scratch) -> DataFrame:
    """(node, component) for every node that is linked to another one.
    ``texts_of(nodes)`` gives (node, text) of a table of nodes."""
    kind = members.schema["node"].dataType.simpleString()
    texts = scratch.stage(texts_of(members.select("node").distinct()), "texts")
    # a node of several texts (an id that occurs with them) has no one bitmap, and nothing is ruled out by it
    bits = (texts.select("node", "text").mapInArrow(_parities(sets), f"node {kind}, bits array<bigint>")
            .withColumn("h", F.xxhash64("bits")).groupBy("node").agg(F.min("bits").alias("bits"), F.min("h").alias("lo"), F.max("h").alias("hi"))
            .filter("lo = hi").select("node", "bits"))
    bits = scratch.stage(bits, "bits")
    first = scratch.stage(_possible(_star(members, _first(members)), bits), "pairs1")
    seen = scratch.stage(compare(first, texts, sets), "seen1")
    comps = C.components(linked(seen), scratch)
    open_ = scratch.stage(_unresolved(members, comps), "open1")
    last = open_.groupBy("key").agg(F.max(F.struct("node", "n", "room")).alias("p"))
    second = scratch.stage(_possible(_star(open_, last).join(seen, ["a", "b"], "left_anti"), bits), "pairs2")
    seen2 = scratch.stage(compare(second, texts, sets), "seen2")
    seen = seen.unionByName(seen2)
    comps = _grown(comps, linked(seen2), scratch)
    open_ = scratch.stage(_unresolved(open_.drop("component"), comps), "open2")
    pivot = _first(open_).select("key", F.col("p.node").alias("p"))
    far = seen.select("a", "b", (1 - F.col("common") / F.col("total")).alias("d"))
    # buckets with one first node are one block: a pair meets there once, not once per shared key
    of = open_.join(pivot, "key").select("p", "node", "n", "room", "component").distinct()
    of = (of.withColumn("a", F.least("node", "p")).withColumn("b", F.greatest("node", "p"))
          .join(far, ["a", "b"], "left").withColumn("d", F.when(F.col("node") == F.col("p"), F.lit(0.0)).otherwise(F.col("d"))))
    of = scratch.stage(of.join(bits, "node", "left"), "blocks")
    maybe = _between(of).groupBy("a", "b", "c1", "c2").agg(F.min("differ").alias("differ"))
    maybe = scratch.stage(maybe.join(seen, ["a", "b"], "left_anti"), "maybe")
    rank = F.row_number().over(Window.partitionBy("c1", "c2").orderBy("differ", "a", "b"))
    best = scratch.stage(maybe.withColumn("rank", rank).filter(F.col("rank") <= BEST).select("a", "b"), "pairs3")
    out = _grown(comps, linked(scratch.stage(compare(best, texts, sets), "seen3")), scratch)
    of_a, of_b = (out.select(F.col("node").alias(c), F.col("component").alias(f"now_{c}")) for c in ("a", "b"))
    apart = ~F.coalesce("now_a", "a").eqNullSafe(F.coalesce("now_b", "b"))
    rest = maybe.select("a", "b").join(best, ["a", "b"], "left_anti").join(of_a, "a", "left").join(of_b, "b", "left").filter(apart).select("a", "b")
    rest = scratch.stage(rest, "pairs4")
    if not rest.isEmpty():
        out = _grown(out, linked(scratch.stage(compare(rest, texts, sets), "seen4")), scratch)
    scratch.drop("texts", "pairs1", "pairs2", "pairs3", "pairs4", "open1", "open2", "blocks", "maybe", "bits")
    return out
