"""SimHash near-duplicate detection with a byte-position inverted index and count filtering.

Fingerprints of 64 bits that differ in at most two bits differ in at most two of their eight bytes, so they agree
in six positional bytes or more. A posting per single byte would hold 1/256 of the corpus, so postings are keyed by
the bytes of two of four byte pairs: two fingerprints with six equal bytes share at least one such posting. Each
pair that meets in a posting is tallied (equal positional bytes), kept from six upwards, and verified by Hamming
distance. Postings above ``posting_cap`` are never expanded into pairs: two fingerprints are within two bits exactly
if their radius-1 balls meet, so members of dense postings are linked through their 65 ball points, at most 65
fingerprints each, which is linear and loses no link.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import saved, ship, tidy
from .columns import values

BYTES = 8
SEED = 42


def fingerprint(text: str | None, width: int = 3) -> int:
    """Signed 64-bit SimHash of one text: ASCII-lower-cased words, ``width``-word shingles with repeats, XXH64 seed 42.

    Fewer words than ``width``: the whole sequence is the only shingle. No words (or null): zero.
    """
    raw = _digests(text, width)
    return 0 if raw is None else _majority(raw)


def _digests(text: str | None, width: int) -> np.ndarray | None:
    """One row of eight bytes per shingle, with repeats; None if there are no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return None
    if len(words) <= width:
        digests, n = xxhash.xxh64_digest(b" ".join(words), SEED), 1
    else:
        n = len(words) - width + 1
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        ends = (starts + lengths)[width - 1 :].tolist()
        hashed = xxhash.xxh64_digest
        digests = b"".join([hashed(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends)])
    return np.frombuffer(digests, np.uint8).reshape(n, BYTES)


def _majority(raw: np.ndarray) -> int:
    n, counts = len(raw), np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        counts += np.unpackbits(raw[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row (``doc_id``, ``fp``) per row of ``docs``; null and empty texts get fingerprint 0."""
    ship(docs.sparkSession)

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, width) for t in values(texts)], pa.int64())

    return docs.select(F.col(id_col).alias("doc_id"), simhash(F.col(text_col)).alias("fp"))


def _shared_bytes(x):
    """How many of the eight bytes of an xor value are zero."""
    return reduce(lambda a, b: a + b, [(F.shiftrightunsigned(x, 8 * k).bitwiseAND(F.lit(255)) == 0).cast("int") for k in range(BYTES)])


def candidate_links(classes: DataFrame, max_bits: int = 2, posting_cap: int = 16) -> DataFrame:
    """Verified links (``a`` < ``b``) that connect exactly what all pairs within ``max_bits`` (at most 2) would connect.

    ``classes`` has one row per distinct ``fp``, none of them null; repeated rows would meet themselves for nothing and
    give no link. Other columns are not read; an empty table gives an empty result.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("the index guarantees complete links up to two bits")
    pair = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    keys = [F.lit(j).cast("long") * (1 << 32) + pair[a] * (1 << 16) + pair[b] for j, (a, b) in enumerate(combinations(range(4), 2))]
    postings = classes.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    shared = saved(postings.join(sizes.filter("n > 1"), "key").select("key", "fp", (F.col("n") > posting_cap).alias("dense")), "postings")

    light = shared.filter(~F.col("dense"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    tallied = (
        light.select("key", F.col("fp").alias("a"))
        .join(light.select("key", F.col("fp").alias("b")), "key")
        .filter("a < b")
        .filter(_shared_bytes(x) >= BYTES - max_bits)
        .filter(F.bit_count(x) <= max_bits)
        .select("a", "b")
    )
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long") for k in range(64)])
    balls = shared.filter("dense").select("fp").distinct().select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    stars = (
        balls.groupBy("point")
        .agg(F.array_sort(F.collect_list("fp")).alias("members"))  # at most 65: all lie within one bit of the point
        .filter(F.size("members") > 1)
    )
    if max_bits == 2:
        dense = stars.select(F.element_at("members", 1).alias("a"), F.explode(F.slice("members", 2, 64)).alias("b"))
    else:  # neighbours of the point itself are the only pairs at one bit
        dense = stars.filter(F.array_contains("members", F.col("point"))).select(F.col("point").alias("c"), F.explode("members").alias("d")).filter("c <> d")
        dense = dense.select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b"))
        dense = dense.limit(0) if max_bits == 0 else dense
    return tallied.unionByName(dense).distinct()


def components(links: DataFrame, max_rounds: int = 60, broadcast_rows: int = 100_000) -> DataFrame:
    """Connected components of links (``a``, ``b``): rows (``node``, ``root``), root the smallest node reached.

    Alternates large-star and small-star steps until every node has one edge, to a root that has none itself; each round is
    written to the shared folder, and only counts reach the driver. Links that are such stars already take no round. Up to
    ``broadcast_rows`` nodes, each one's lowest neighbour is broadcast, so edges are not shuffled to meet it; beyond that the joins
    shuffle. Repeated links and links of a node to itself change nothing; rows with a null end are left out; a node without links
    gives no row, nor does an empty table.
    """

    def star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
        u, v = (F.col("a"), F.col("b"))
        near = edges.select("a", "b").union(edges.select("b", "a")) if large else edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b"))
        low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        met = near.join(F.broadcast(low) if few else low, "a")
        if large:  # a row an edge: repeated ones go in the small step
            return met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    def counted(edges: DataFrame) -> tuple[int, int]:
        """How many nodes there are, and how many of them have several edges down, or edges down and up."""
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
        nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        return tuple(nodes.agg(F.count(F.lit(1)), F.count_if((F.col("down") > 1) | (F.col("down") > 0) & (F.col("up") > 0))).first())

    edges = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(max_rounds):
        nodes, unsettled = counted(edges)
        if not unsettled:
            break
        few = nodes <= broadcast_rows
        edges = saved(star(star(edges, True, few), False, few), "links")
        tidy(links.sparkSession)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2, posting_cap: int = 16) -> DataFrame:
    """Near-duplicate classes of ``docs``: one row per row of ``docs`` with ``doc_id``, ``fp`` and ``component_id``.

    ``component_id`` is the smallest id reachable over links of at most ``max_bits`` differing bits, the row's own
    included. Copies are reduced to one class per fingerprint before any posting is built. Null or empty texts have
    fingerprint 0 and form one class; texts of any length are hashed whole; rows without an id stay and take the smallest
    id of their component (null if it has none); repeated rows stay repeated; an empty table gives an empty result.
    Other columns are not read.
    """
    rows = saved(fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = components(candidate_links(classes.select("fp"), max_bits, posting_cap))
    placed = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = placed.join(lowest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


MARKS = 8


def _shingle_set(text: str | None, width: int) -> np.ndarray:
    raw = _digests(text, width)
    return np.zeros(0, np.int64) if raw is None else np.unique(raw.view(">i8").ravel().astype(np.int64))


MAP_BITS = 25


def _bit_map(keys: DataFrame, bits: int = MAP_BITS) -> np.ndarray:
    """A map of 2^``bits`` bits, of which those of the last bits of each ``key`` are set. Its size does not grow with the
    table; if it fills up, it tells less, and no result depends on it."""
    bit = F.pmod("key", F.lit(1 << bits))
    words = keys.select(F.shiftright(bit, 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(pmod(key, 64) AS int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def _in_map(marked: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return (marked[(keys & ((marked.size << 6) - 1)) >> 6] >> (keys & 63) & 1).astype(bool)


#: Slots of the map that tells how common a shingle is.
SLOTS = 24


def _common_shingles(docs: DataFrame, text: Column, width: int, one_in: int = 8) -> np.ndarray:
    """How many of every ``one_in``-th text hold a shingle, as four times the binary logarithm, in a map of 2^``SLOTS`` bytes by the
    shingle's last bits; of shingles that share a slot the most common counts, and 0 stands for one text or none. It only
    orders the index, so neither sample nor map, whose size is fixed, decides the result."""

    @F.arrow_udf("array<int>")
    def keys(column: pa.Array) -> pa.Array:
        return pa.array([(_shingle_set(t, width) & 0x7FFFFFFF).astype(np.int32) for t in values(column)], pa.list_(pa.int32()))

    drawn = docs.select(text.alias("text")).filter(F.pmod(F.hash("text"), F.lit(one_in)) == 0)
    held = drawn.select(F.explode(keys("text")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    level = F.least(F.round(F.log2("n") * 4), F.lit(127)).cast("byte")
    told = held.groupBy(F.pmod("key", F.lit(1 << SLOTS)).alias("slot")).agg(F.max(level).alias("level")).toArrow()
    out = np.zeros(1 << SLOTS, np.int8)
    out[told["slot"].to_numpy()] = told["level"].to_numpy()
    return out


def _parity(held: np.ndarray, bits: int) -> np.ndarray:
    """A sketch of a set: which of ``bits`` (a power of two, 64 at least) buckets hold an odd number of members."""
    odd = np.bincount(held & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def _apart(x: np.ndarray, y: np.ndarray) -> int:
    """Differing bits of two sketches, never more than their sets' differing members; the wider one is folded."""
    small, wide = (x, y) if len(x) <= len(y) else (y, x)
    folded = np.bitwise_xor.reduce(wide.reshape(-1, len(small)), axis=0)
    return int(np.bitwise_count(folded ^ small).sum())


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, max_bits: int = 2, broadcast_rows: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups linked by a Jaccard similarity of ``width``-word shingle sets of at least ``similarity``: one row per row
    of ``docs`` with ``doc_id``, ``text_key`` (a hash of the text, one for null and empty ones) and ``root``, the group.

    Fingerprints differ in more bits the longer the changed part is, so a radius alone neither finds nor proves such
    pairs. Candidates are the fingerprint index's links and, for the rest, postings of each set's prefix: in any one
    order of all shingles, two sets that are similar enough share one of the first n - ceil(similarity * n) + 1 of each.
    The more texts of a sample hold a shingle, the later it comes in that order, so passages that many documents share are
    hardly ever posted, even by texts whose other shingles a few copies hold too. First each posting's members meet its smallest; what this leaves in different groups then meets
    pair by pair, so a large group of copies costs no square. Every candidate is verified: by parity sketches,
    whose differing bits never exceed the differing shingles (512 bits, then some bits a shingle), then by the sets
    themselves. No similar pair is left out.
    Texts without words, null ones too, form one group. Ids may be null or repeat; repeated rows are one class and stay
    repeated; whole texts of any length are read; other columns are not read; an empty table gives an empty result.
    """
    spark = ship(docs.sparkSession)
    text, text_key = F.col(text_col), text_hash(F.col(text_col))
    row_key = F.xxhash64(F.col(id_col).isNull(), F.col(id_col), text_key)
    common = spark.sparkContext.broadcast(_common_shingles(docs, text, width))

    @F.arrow_udf("struct<set_key:long,fp:long,n:int,marks:array<long>,prefix:array<long>>")
    def facts(texts: pa.Array) -> pa.Array:
        out, levels = [], common.value
        for t in values(texts):
            raw = _digests(t, width)
            if raw is None:
                out.append((0, 0, 0, np.zeros(MARKS, np.int64), np.zeros(0, np.int64)))
                continue
            held = np.unique(raw.view(">i8").ravel().astype(np.int64))
            n = len(held)
            first = held[np.argsort(levels[held & (len(levels) - 1)], kind="stable")][: n - int(np.ceil(similarity * n - 1e-9)) + 1]
            marks = _parity(held, 64 * MARKS).view("<i8")
            key = xxhash.xxh64_intdigest(held.astype("<i8").tobytes(), SEED)
            out.append((key - (1 << 64) if key >> 63 else key, _majority(raw), n, marks, first.copy()))
        names, kinds = ("set_key", "fp", "n", "marks", "prefix"), (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        columns = list(zip(*out)) if out else [()] * 5
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    told = docs.select(F.col(id_col).alias("doc_id"), text_key.alias("text_key"), row_key.alias("row_key"), facts(text_col).alias("f"))
    rows = saved(told.select("doc_id", "text_key", "row_key", "f.*"), "shingle-facts")
    common.destroy()
    classes = saved(rows.groupBy("set_key").agg(F.min("row_key").alias("row_key"), *[F.first(c).alias(c) for c in ("fp", "n", "marks", "prefix")]), "shingle-classes")
    tidy(spark)
    facts_of = classes.select("set_key", "n", "marks")

    @F.arrow_udf("struct<s:binary,n:int,sketch:binary>")
    def whole(column: pa.Array) -> pa.Array:
        """A set, its size, and its sketch of four to eight bits a member."""
        sets = [_shingle_set(t, width) for t in values(column)]
        wide = [_parity(x, max(512, 4 << max(0, len(x) - 1).bit_length())) for x in sets]
        return pa.StructArray.from_arrays([pa.array([x.tobytes() for x in sets], pa.binary()), pa.array(map(len, sets), pa.int32()), pa.array([w.tobytes() for w in wide], pa.binary())], ["s", "n", "sketch"])

    def near_enough(x: bytes, n: int, y: bytes, m: int) -> bool:
        return _apart(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) <= (n + m) * (1 - similarity) / (1 + similarity) + 1e-9

    def similar(x: bytes, n: int, y: bytes, m: int) -> bool:
        shared = len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True))
        return shared >= similarity * (n + m - shared) - 1e-9

    def compared(by):
        """Keep pairs by a comparison. Rows come by ``a`` and ``part``: first that of ``a`` itself (``b`` null), then its partners."""

        def run(batches):
            head, x, n = None, b"", 0
            for batch in batches:
                found = ([], [])
                raw = batch.column(3)
                for i, (a, part, b, m) in enumerate(zip(*[batch.column(c).to_pylist() for c in (0, 1, 2, 4)])):
                    if b is None:
                        head, x, n = (a, part), raw[i].as_py(), m
                        continue
                    assert head == (a, part)
                    if by(x, n, raw[i].as_buffer(), m):
                        found[0].append(a)
                        found[1].append(b)
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], ["a", "b"])

        return run

    def meet(pairs: DataFrame, sets: DataFrame, what: str, by) -> DataFrame:
        """Pairs whose column ``what`` passes the comparison. That of ``a`` travels once for 512 of its pairs."""
        parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 512).alias("parts"))
        held = sets.select("set_key", F.col(what).alias("x"), "n")
        dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
        theirs = dealt.join(held.withColumnRenamed("set_key", "b"), "b").select("a", "part", "b", "x", "n")
        heads = parts.join(held.withColumnRenamed("set_key", "a"), "a")  # a part without pairs gives nothing
        own = heads.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "x", "n")
        return own.unionByName(theirs).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b")).mapInArrow(compared(by), "a long, b long")

    def verified(pairs: DataFrame) -> DataFrame:
        """Of the pairs (``a``, ``b``) those that are similar enough: by small sketches, by wide ones, then by the sets."""
        side = lambda x: facts_of.select(F.col("set_key").alias(x), F.col("n").alias(f"n_{x}"), F.col("marks").alias(f"m_{x}"))
        total = F.col("n_a") + F.col("n_b")
        differing = F.aggregate(F.zip_with("m_a", "m_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        may = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct().join(side("a"), "a").join(side("b"), "b")
        may = saved(may.filter((F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9) & (differing <= total * (1 - similarity) / (1 + similarity) + 1e-9)).select("a", "b"), "similar-candidates")
        tidy(spark)
        asked = may.select(F.col("a").alias("set_key")).union(may.select("b")).distinct().join(classes.select("set_key", "row_key"), "set_key")
        asked = saved(asked, "similar-asked")
        n = asked.count()
        few = lambda ids: F.broadcast(ids) if n <= broadcast_rows else ids
        sets = docs.select(row_key.alias("row_key"), text.alias("text")).join(few(asked), "row_key").select("set_key", whole("text").alias("w")).select("set_key", "w.*")
        if rows.join(few(asked.select("row_key")), "row_key").count() > n:  # rows alike in id and text give one set
            sets = sets.groupBy("set_key").agg(*[F.first(c).alias(c) for c in ("s", "n", "sketch")])
        sets = saved(sets, "shingle-sets")
        likely = saved(meet(may, sets, "sketch", near_enough), "similar-likely")
        tidy(spark)
        return saved(meet(likely, sets, "s", similar), "similar-pairs")

    by_fp = classes.filter("n > 0").groupBy("fp").agg(F.min("set_key").alias("rep"))
    close = candidate_links(by_fp.select("fp"), max_bits)
    near = close.join(by_fp.select(F.col("fp").alias("a"), F.col("rep").alias("x")), "a").join(by_fp.select(F.col("fp").alias("b"), F.col("rep").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = classes.join(by_fp, "fp").select(F.col("set_key").alias("a"), F.col("rep").alias("b"))

    # Most shingles are in one prefix only: a map of those whose last 31 bits come twice keeps the others from travelling.
    twice = classes.select(F.explode("prefix").alias("key")).select(F.pmod("key", F.lit(1 << 31)).cast("int").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    twice_map = spark.sparkContext.broadcast(_bit_map(twice.select(F.col("key").cast("long").alias("key"))))

    @F.arrow_udf("array<struct<place:int,key:long>>")
    def posted(prefixes: pa.Array) -> pa.Array:
        keys, lengths = prefixes.flatten().to_numpy(zero_copy_only=False).astype(np.int64), prefixes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        kept = np.flatnonzero(_in_map(twice_map.value, keys)) if len(keys) else np.zeros(0, np.int64)
        place = (kept - np.repeat(ends - lengths, lengths)[kept]).astype(np.int32)
        borders = np.concatenate(([0], np.searchsorted(kept, ends))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(borders), pa.StructArray.from_arrays([pa.array(place), pa.array(keys[kept])], ["place", "key"]))

    postings = saved(classes.select(F.col("set_key").alias("id"), "n", F.explode(posted("prefix")).alias("p")).select("id", "n", "p.place", "p.key"), "prefix-postings")
    twice_map.destroy()
    tidy(spark)
    heads = postings.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min("id").alias("head")).filter("held > 1").select("key", "head")
    shared = saved(postings.join(heads, "key"), "prefix-postings")
    links = verified(near.union(same).union(shared.select(F.col("head").alias("a"), F.col("id").alias("b"))))

    roots = components(links)
    open_rows = saved(shared.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id")), "prefix-postings")
    several = open_rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    half = MARKS // 2  # a sketch of half the size travels with each posting, so most pairs that meet need not be written down
    folded = classes.select(F.col("set_key").alias("id"), *[F.get("marks", F.lit(i)).bitwiseXOR(F.get("marks", F.lit(i + half))).alias(f"m{i}") for i in range(half)])
    open_rows = open_rows.filter("id <> head").join(several, "key").join(folded, "id")
    side = lambda x: open_rows.select("key", F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("place").alias(f"p_{x}"), F.col("root").alias(f"r_{x}"), *[F.col(f"m{i}").alias(f"m{i}_{x}") for i in range(half)])
    total = F.col("n_a") + F.col("n_b")
    reach = F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b"))
    differing = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"m{i}_a").bitwiseXOR(F.col(f"m{i}_b"))) for i in range(half)])
    near = (reach >= similarity / (1 + similarity) * total - 1e-9) & (differing <= total * (1 - similarity) / (1 + similarity) + 1e-9)
    rest = side("a").join(side("b"), "key").filter("a < b AND r_a <> r_b").filter(near).select("a", "b")
    linked = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(verified(rest)))  # the first groups are stars already
    return rows.select("doc_id", "text_key", "set_key").join(linked.select(F.col("node").alias("set_key"), "root"), "set_key", "left").select("doc_id", "text_key", F.coalesce("root", "set_key").alias("root"))
