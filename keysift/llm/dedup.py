"""Near duplicates by MinHash: signatures, banding, verification, connected components.

1. Documents with the same set of shingles form a class; from here on a class is one node.
2. A signature of universal hash minima per node; its bands are hashed to buckets.
3. Nodes that share a bucket are candidates. A bucket is compared with one of its own members (its
   hub) first, and only across components found so far, so a bucket of n copies takes n comparisons;
   the first round takes a few bands only.
4. A shingle that no other candidate has is in no intersection. Counting those bounds the similarity
   of a pair from above, and pairs that cannot reach the threshold are not looked at.
5. What is still apart is told by how it differs from the hub (``differences``): two members that
   are not alike to their hub are alike to each other only if they share at least half of what sets
   them apart from it. They meet in a differing shingle that is rare among the hub's members, and
   only if enough others can follow; first with one member per shingle, then all with all.
6. Signatures reject most false candidates, the full sets confirm the rest. No pair is compared twice.
7. Components by alternating large-star and small-star.

Minima are aggregated per task before they are exchanged. Rows of one bucket, and of one component,
meet where they are aggregated or joined, as ids and numbers only: the largest such task reads more
than the others. Whole sets are dealt by node, or by hub in lots of ``HUB_LOT`` members.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysift.llm.common import WORD, forget, small_batches, stored

SHINGLE_SCHEMA = (
    "doc_id long, text_hash long, n_shingles long, node binary, bands array<long>, "
    "signature array<tinyint>"
)
# Bands of each round that compares buckets with their hubs (None: all).
ROUNDS = (4, None)
# Members of one hub whose sets meet its set in one place.
HUB_LOT = 500

# A filter has so many bitmaps of 2^15 bits, the size of those that Spark builds.
FILTER_PARTS = 2048
BITMAP_POWER = 15


class MinHash(NamedTuple):
    """Shingle size in words, threshold in percent, bands and rows per band.

    With 48 bands of 7 rows, two sets at the threshold of 80 % miss each other with probability
    (1 - 0.8^7)^48 = 1.3e-5, and two that share half meet in 0.4 buckets. Signatures keep a byte of
    each minimum. A pair is dropped by its signatures only if fewer than ``screen`` of all bytes
    agree: at 68 % of 336, more than five standard deviations below the threshold.
    """

    words: int = 4
    percent: int = 80
    bands: int = 48
    rows: int = 7
    screen: float = 0.68
    seed: int = 7


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_hashes(texts: list[str | None]):
    """Per text, 64-bit hashes of its words, A-Z lowered."""
    import re

    import numpy as np
    import xxhash

    find, digest = re.compile(WORD).findall, xxhash.xxh64_intdigest
    known: dict[str, int] = {}
    for text in texts:
        words = find((text or "").translate(LOWER))
        for word in set(words).difference(known):
            known[word] = digest(word)
        yield np.array(list(map(known.__getitem__, words)), np.uint64)


def mixed(values):
    """A bijective scrambling of 64-bit integers (numpy)."""
    import numpy as np

    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingles(hashes, words: int):
    """Sorted distinct shingle hashes of a sequence of word hashes; short ones are one shingle."""
    import numpy as np

    if len(hashes) == 0:
        return np.empty(0, np.uint64)
    width = min(words, len(hashes))
    n = len(hashes) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return np.unique(total)


def minima(values, a, b):
    """Minima of the universal hashes a x + b mod 2^32, a odd, over a set."""
    import numpy as np

    folded = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for first in range(0, len(folded), 1024):
        block = folded[first : first + 1024, None] * a
        block += b
        np.minimum(best, block.min(axis=0), out=best)
    return best


def band_hashes(best, bands: int):
    """One 64-bit hash per band of a signature, and per place of the band."""
    import numpy as np

    rows = best.astype(np.uint64).reshape(bands, -1)
    total = np.arange(bands, dtype=np.uint64)
    for k in range(rows.shape[1]):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return total.view(np.int64)


def signatures(docs: DataFrame, params: MinHash, doc_id: str, text: str) -> DataFrame:
    """``SHINGLE_SCHEMA`` per row; node, bands and signature are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        forget()
        random = np.random.default_rng(params.seed)
        k = params.bands * params.rows
        a = random.integers(0, 2**32, k, np.uint32) | np.uint32(1)
        b = random.integers(0, 2**32, k, np.uint32)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                piece = batch.slice(first, 500)
                sizes, nodes, bands, signs = [], [], [], []
                for hashes in word_hashes(piece.column("text").to_pylist()):
                    found = shingles(hashes, params.words)
                    sizes.append(len(found))
                    if len(found):
                        best = minima(found, a, b)
                        nodes.append(xxhash.xxh3_128_digest(found.tobytes()))
                        bands.append(band_hashes(best, params.bands))
                        signs.append(best.astype(np.uint8).view(np.int8))
                    else:
                        for column in (nodes, bands, signs):
                            column.append(None)
                columns = [piece.column(0), piece.column(1), pa.array(sizes, pa.int64())]
                columns += [pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                columns.append(pa.array(signs, pa.list_(pa.int8())))
                names = ["doc_id", "text_hash", "n_shingles", "node", "bands", "signature"]
                yield pa.RecordBatch.from_arrays(columns, names)

    small_batches(docs)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.col(text).alias("text"),
    )
    return rows.mapInArrow(run, SHINGLE_SCHEMA)


def shingle_sets(docs: DataFrame, params: MinHash) -> DataFrame:
    """``(node, text)`` to ``(node, shingles)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                piece = batch.slice(first, 500)
                sets = [
                    shingles(hashes, params.words).view(np.int64)
                    for hashes in word_hashes(piece.column("text").to_pylist())
                ]
                columns = [piece.column("node"), pa.array(sets, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node binary, shingles array<long>")


def buckets(nodes: DataFrame) -> DataFrame:
    """``(band, bucket, node)`` for each band of each node."""
    return nodes.select(F.posexplode("bands").alias("band", "bucket"), "node")


def prefiltered(rows: DataFrame, key: Column, keys: DataFrame, name: Column) -> DataFrame:
    """Rows of which the hash ``key`` may be among the hashes ``name`` of ``keys``, before a join on
    what was hashed.

    A Bloom filter of one hash, of ``FILTER_PARTS`` bitmaps and so 8 MB at any size. It drops no row
    that the join would keep, but saves shuffling most of those that have no partner. The more keys
    there are, the more rows it lets through; the join gives the same rows in any case.
    """

    def part(place: Column) -> Column:
        return F.shiftright(place, BITMAP_POWER)

    def bit(place: Column) -> Column:
        return place.bitwiseAND((1 << BITMAP_POWER) - 1)

    def place(hashed: Column) -> Column:
        return F.pmod(F.xxhash64(hashed), F.lit(FILTER_PARTS << BITMAP_POWER))

    places = keys.select(place(name).alias("filter_place"))
    maps = places.groupBy(part(F.col("filter_place")).alias("filter_part")).agg(
        F.bitmap_construct_agg(bit(F.col("filter_place"))).alias("filter_map")
    )
    placed = rows.withColumn("filter_place", place(key))
    placed = placed.withColumn("filter_part", part(F.col("filter_place")))
    own = bit(F.col("filter_place")).cast("int")
    byte = F.substring("filter_map", F.shiftright(own, 3) + 1, F.lit(1))
    found = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), own.bitwiseAND(7)) == 1
    return placed.join(F.broadcast(maps), "filter_part").where(found).select(rows.columns)


def agreement(one: str, other: str) -> Column:
    """Number of equal bytes in two signatures."""
    equal = F.zip_with(one, other, lambda x, y: (x == y).cast("int"))
    return F.aggregate(equal, F.lit(0), lambda total, x: total + x)


def agree(params: MinHash) -> Column:
    """Whether ``signature_a`` and ``signature_b`` may belong to sets at the threshold."""
    return agreement("signature_a", "signature_b") >= params.screen * params.bands * params.rows


def confirmed(pairs: DataFrame, signs: DataFrame, sets: DataFrame, params: MinHash) -> DataFrame:
    """Of the pairs ``(a, b, ...)``, those whose signatures agree and whose full sets reach the
    threshold."""

    def with_both(rows: DataFrame, side: DataFrame, column: str) -> DataFrame:
        for end in ("a", "b"):
            own = side.select(F.col("node").alias(end), F.col(column).alias(f"{column}_{end}"))
            rows = rows.join(own, end)
        return rows

    near = with_both(pairs, signs, "signature").where(agree(params)).select(pairs.columns)
    near = stored(near, "near")
    ends = near.select("a").union(near.select("b"))
    needed = prefiltered(sets, F.xxhash64("node"), ends, F.xxhash64("a"))
    both = with_both(near, needed, "shingles")
    both = both.withColumn("common", F.size(F.array_intersect("shingles_a", "shingles_b")))
    union = F.size("shingles_a") + F.size("shingles_b") - F.col("common")
    return both.where(F.col("common") * 100 >= union * params.percent).select(pairs.columns)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for all nodes of the edges ``(a, b)``: the least node of the component.

    Large-star ties every greater neighbour of a node to the least of its neighbourhood, small-star
    every lesser one; a star around each least node is what neither changes.
    """

    def star(neighbours: DataFrame) -> DataFrame:
        """``(a, b, least)``: each node, its neighbours, and the least of all of them."""
        least = neighbours.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        return neighbours.join(least, "a")

    def edges_of(pairs: DataFrame, a: str, b: str) -> DataFrame:
        return pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()

    def mark(pairs: DataFrame):
        total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        return tuple(pairs.agg(F.count("*"), total).first())

    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, before = stored(edges_of(down, "a", "b"), "edges"), None
    while (seen := mark(now)) != before:
        before = seen
        large = star(now.union(now.select("b", "a"))).where("b > a")
        small = star(stored(edges_of(large, "b", "least"), "large-star"))
        moved = small.select("b", "least").union(small.select("a", "least"))
        now = stored(edges_of(moved, "b", "least"), "small-star")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(now.select("b", F.col("b").alias("root")).distinct())


def shared_counts(sets: DataFrame) -> DataFrame:
    """``(node, n, n_shared)``: the size of each set, and how many of its shingles another one has.
    ``number`` tells the sets apart in the exchange of all shingles."""
    single = sets.select("number", F.explode("shingles").alias("shingle")).groupBy("shingle")
    single = single.agg(F.count("*").alias("n"), F.min("number").alias("number")).where("n = 1")
    own = single.groupBy("number").agg(F.count("*").alias("n_own"))
    sizes = sets.select("node", "number", F.size("shingles").alias("n"))
    n_shared = F.col("n") - F.coalesce("n_own", F.lit(0))
    return sizes.join(own, "number", "left").select("node", "n", n_shared.alias("n_shared"))


def parted_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of ``members`` with their ``root``, in buckets that hold several components."""
    state = members.join(roots, "node")
    ends = state.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return state.join(ends.where("low <> high").select("bucket"), "bucket")


def with_hub(parted: DataFrame) -> DataFrame:
    """``(bucket, hub)``: the member with the least share of shingles of its own, that is the text that
    copies were made from if it is there, with all that is known of it."""
    own_share = (1 - F.col("n_shared") / F.col("n_shingles")).alias("own_share")
    hub = F.struct(own_share, "node", "root", "n_shingles", "n_shared")
    return parted.groupBy("bucket").agg(F.min(hub).alias("hub"))


def pair(one: str, other: str) -> list[Column]:
    """Two nodes in order, and their roots."""
    first = F.col(f"{one}node") < F.col(f"{other}node")
    return [
        F.least(f"{one}node", f"{other}node").alias("a"),
        F.greatest(f"{one}node", f"{other}node").alias("b"),
        F.when(first, F.col(f"{one}root")).otherwise(F.col(f"{other}root")).alias("ra"),
        F.when(first, F.col(f"{other}root")).otherwise(F.col(f"{one}root")).alias("rb"),
    ]


def hub_pairs(members: DataFrame, roots: DataFrame, params: MinHash) -> DataFrame:
    """Pairs ``(a, b, ra, rb)`` of a bucket's members with its hub, with their roots, across components
    and without those whose shared shingles cannot make them alike."""
    parted = parted_buckets(members, roots)
    rows = parted.join(with_hub(parted), "bucket")
    most = F.least("n_shared", "hub.n_shared")
    union = F.col("n_shingles") + F.col("hub.n_shingles") - most
    alike = most * 100 >= union * F.lit(params.percent)
    apart = (F.col("root") != F.col("hub.root")) & alike
    return rows.where(apart).select(pair("", "hub.")).distinct()


def differences(
    members: DataFrame, roots: DataFrame, sets: DataFrame, params: MinHash
) -> DataFrame:
    """``(hub, node, root, weight, tokens)``: the shingles by which members of parted buckets differ
    from their hubs, lost ones as well as gained ones.

    Let a hub have N shingles, and x lose l and gain g of them. Then x and y have N - l_x - l_y + o
    shingles in common, o being the number of tokens that both have: one that both lost was counted
    twice, one that both gained not at all. They are alike at p percent if and only if

        2 (100 + p) o >= weight_x + weight_y,  weight = 200 l + 2 p g - (100 - p) N.

    A node is not alike to the hub if and only if its weight is over (100 - p) N, and none is below
    -(100 - p) N. Of two components one at least is not alike to the hub, as hubs have been compared
    with all, so the sum is above 0: nodes without a common token are never alike.
    """
    parted = parted_buckets(members, roots)
    hubs = with_hub(parted).select("bucket", F.col("hub.node").alias("hub"))
    near = parted.join(hubs, "bucket").select("hub", "node", "root").distinct()
    near = stored(near, "hub-members")
    lots = near.groupBy("hub").agg(F.ceil(F.count("*") / HUB_LOT).cast("int").alias("lots"))
    placed = near.join(lots, "hub").select(
        "hub", "node", "root", F.pmod(F.xxhash64("node"), "lots").cast("int").alias("lot")
    )
    own = F.xxhash64("node")
    mine = prefiltered(sets.select("node", "shingles"), own, near, own).join(placed, "node")
    lot = F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot")
    centres = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("centre"))
    centres = centres.join(lots, "hub").select("hub", "centre", lot)
    both = mine.join(centres, ["hub", "lot"]).select(
        "hub",
        "node",
        "root",
        F.size("centre").cast("long").alias("n"),
        F.array_except("centre", "shingles").alias("lost"),
        F.array_except("shingles", "centre").alias("gained"),
    )
    weight = 200 * F.size("lost") + 2 * params.percent * F.size("gained")
    weight = (weight - (100 - params.percent) * F.col("n")).alias("weight")
    return both.select("hub", "node", "root", weight, F.concat("lost", "gained").alias("tokens"))


def rare_tokens(found: DataFrame, params: MinHash) -> DataFrame:
    """``(hub, token, node, weight, rest)`` of ``differences``: where members of a hub meet.

    The tokens of a node are ordered by how many members of the hub have them, and ``rest`` says how
    many it has from this one on. A pair meets in the first of its common tokens, and has no more in
    common than the lesser rest there. A node keeps the tokens at which some node of another
    component could still be alike; one with too few tokens for that keeps none and is not taken apart.
    """
    reach = 2 * (100 + params.percent)
    narrow = found.select("hub", "node", "root", "weight", F.size("tokens").alias("n"))
    lightest = narrow.groupBy("hub", "root").agg(F.min("weight").alias("weight"))
    least = lightest.groupBy("hub").agg(F.min(F.struct("weight", "root")).alias("least"))
    second = lightest.join(least, "hub").where(F.col("root") != F.col("least.root"))
    second = second.groupBy("hub").agg(F.min("weight").alias("second"))
    # The least weight among the hub's members of other components.
    partner = F.when(F.col("root") == F.col("least.root"), F.col("second"))
    need = (F.col("weight") + partner.otherwise(F.col("least.weight"))).alias("need")
    needs = narrow.join(least.join(second, "hub"), "hub").select("hub", "node", "n", need)
    needs = needs.where(F.col("n") * reach >= F.col("need")).select("hub", "node", "need")
    rows = found.join(needs, ["hub", "node"])
    rows = rows.select("hub", "node", "root", "weight", "need", F.explode("tokens").alias("token"))
    counts = rows.groupBy("hub", "token").agg(
        F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    counts = counts.where("low <> high").select("hub", "token", "n")
    order = Window.partitionBy("hub", "node").orderBy(F.desc("n"), F.desc("token"))
    return (
        rows.drop("root")
        .join(counts, ["hub", "token"])
        .withColumn("rest", F.row_number().over(order))
        .where(F.col("rest") * reach >= F.col("need"))
        .select("hub", "token", "node", "weight", "rest")
    )


def token_pairs(
    tokens: DataFrame, roots: DataFrame, one_each: bool, params: MinHash
) -> DataFrame:
    """Pairs ``(a, b, ra, rb)`` of ``rare_tokens`` across components that may be alike. With
    ``one_each``, a token's nodes are paired with the one nearest to the hub only."""
    reach = 2 * (100 + params.percent)
    own = ["weight", "node", "root", "rest"]
    kept = tokens.join(roots, "node")
    other = kept
    if one_each:
        other = kept.groupBy("hub", "token").agg(F.min(F.struct(*own)).alias("first"))
        other = other.select("hub", "token", "first.*")
    ours = kept.select("hub", "token", *[F.col(c).alias(f"a_{c}") for c in own])
    theirs = other.select("hub", "token", *[F.col(c).alias(f"b_{c}") for c in own])
    may = F.least("a_rest", "b_rest") * reach >= F.col("a_weight") + F.col("b_weight")
    apart = (F.col("a_root") != F.col("b_root")) & may
    if not one_each:
        apart = apart & (F.col("a_node") < F.col("b_node"))
    met = ours.join(theirs, ["hub", "token"]).where(apart)
    return met.select(pair("a_", "b_")).distinct()


def linked(docs: DataFrame, signed: DataFrame, params: MinHash, doc_id: str, text: str) -> DataFrame:
    """``(node, root)`` of all classes that share a bucket with another."""
    worded = signed.where("node IS NOT NULL")
    classes = stored(worded.groupBy("node").agg(F.first("bands").alias("bands")), "classes")
    banded = buckets(classes)
    met = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    met = stored(met, "buckets")
    banded = prefiltered(banded, F.col("bucket"), met, F.col("bucket"))
    members = stored(banded.join(met, "bucket"), "bucket-members")
    roots = stored(members.select("node", F.col("node").alias("root")).distinct(), "nodes")
    own = F.xxhash64("node")
    # Not a semi-join, which Catalyst would move below the filter. Each node is in ``roots`` once. Only
    # these have their signatures moved.
    met = prefiltered(worded, own, roots, own).join(roots.select("node"), "node")
    first = F.min(F.struct("doc_id", "text_hash")).alias("row")
    signs = met.groupBy("node").agg(first, F.first("signature").alias("signature"))
    signs = stored(signs, "signs")
    rows = signs.select("node", "row.*")
    texts = docs.select(
        F.col(doc_id).cast("long").alias("d"), F.xxhash64(text).alias("h"), F.col(text).alias("text")
    )
    own = F.xxhash64("doc_id", "text_hash")
    texts = prefiltered(texts, F.xxhash64("d", "h"), rows, own)
    same = texts["d"].eqNullSafe(rows["doc_id"]) & (texts["h"] == rows["text_hash"])
    sets = shingle_sets(texts.join(rows, same), params).dropDuplicates(["node"])
    sets = stored(sets.withColumn("number", F.monotonically_increasing_id()), "sets")
    shared = shared_counts(sets).where(F.col("n_shared") * 100 >= F.col("n") * params.percent)
    members = members.join(shared.withColumnRenamed("n", "n_shingles"), "node")
    members = stored(members, "members")
    tried = None

    def merged(pairs: DataFrame) -> DataFrame:
        """The roots after the links among ``pairs``."""
        nonlocal tried
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            return roots
        own = pairs.select("a", "b")
        tried = own if tried is None else tried.union(own)
        links = confirmed(pairs, signs, sets, params)
        moved = components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        moved = moved.select(F.col("node").alias("root"), F.col("root").alias("to"))
        found = roots.join(moved, "root", "left")
        return stored(found.select("node", F.coalesce("to", "root").alias("root")), "roots")

    for bands in ROUNDS:
        some = members if bands is None else members.where(F.col("band") < bands)
        roots = merged(hub_pairs(some, roots, params))
    found = stored(differences(members, roots, sets, params), "differences")
    tokens = stored(rare_tokens(found, params), "tokens")
    for one_each in (True, False):
        roots = merged(token_pairs(tokens, roots, one_each, params))
    return roots


def near_duplicates(
    docs: DataFrame, params: MinHash = MinHash(), *, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``text_hash``, ``n_shingles``, ``component_id``, ``kept``.

    A set holds the distinct shingles of ``params.words`` consecutive words, A-Z lowered; a text with
    fewer words is one shingle. ``component_id`` is the least id that links reach, ``kept`` says
    whether that is the row's own. Null, empty and blank texts have no shingles and are linked with
    nothing, also not with each other. A null id is no candidate for the least one: such a row names
    the least id of its component, and is kept only where the whole component has none. Repeated
    rows share their fate. Only the two columns are read.
    """
    signed = stored(signatures(docs, params, doc_id, text), "signatures")
    roots = linked(docs, signed, params, doc_id, text)
    classes = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(heads, "root").select("node", "component")
    slim = signed.select("doc_id", "text_hash", "n_shingles", "node")
    full = slim.where("node IS NOT NULL").join(named, "node")
    empty = slim.where("node IS NULL").withColumn("component", F.col("doc_id"))
    return full.unionByName(empty).select(
        "doc_id",
        "text_hash",
        "n_shingles",
        F.col("component").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"),
    )


def drop_near_duplicates(
    docs: DataFrame, params: MinHash = MinHash(), *, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows of ``docs`` without those that a smaller id stands for; columns unchanged.

    Of repeated rows of one id and text one stays, unless the text has no words: those are linked
    with nothing.
    """
    found = near_duplicates(docs, params, doc_id=doc_id, text=text).where("kept")
    keys = found.groupBy(F.col("doc_id").alias("dedup_id"), F.col("text_hash").alias("dedup_hash"))
    repeated = (F.count("*") > 1) & (F.max("n_shingles") > 0)
    keys = keys.agg(repeated.alias("dedup_repeated"))
    rows = docs.select(F.struct(*docs.columns).alias("dedup_row"))
    row_id, row_text = F.col(f"dedup_row.`{doc_id}`").cast("long"), F.col(f"dedup_row.`{text}`")
    rows = rows.withColumns({"dedup_own": row_id, "dedup_text": F.xxhash64(row_text)})
    same = F.col("dedup_own").eqNullSafe(F.col("dedup_id")) & (
        F.col("dedup_text") == F.col("dedup_hash")
    )
    joined = rows.join(keys, same)
    once = joined.where("dedup_repeated").dropDuplicates(["dedup_id", "dedup_hash"])
    return joined.where("NOT dedup_repeated").unionByName(once).select("dedup_row.*")
