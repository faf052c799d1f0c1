"""Removal of byte strings that occur more than once, by suffix arrays of shards.

A string of ``window`` bytes has an anchor: the place of the smallest hash of ``GRAM`` bytes in it. Equal strings have
equal anchors, so all windows with one anchor, which lie side by side and are called a context, need only be compared
with the contexts of the same anchor hash. Contexts are therefore dealt into shards by that hash, copies of one context
taken as one with a count. Each shard sorts its suffixes by Larsson-Sadakane refinement, and Kasai's common prefixes of
neighbours tell which windows come twice. Where one hash has more
contexts than a shard may hold, it gets several shards; each names the runs of equal windows of its suffix array, and
the sorted names of all shards are merged by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import saved, ship, small
from .columns import set_aside, values
from .simhash import _bit_map, _in_map

#: Bytes whose hash decides where a window has its anchor.
GRAM = 64
#: Bytes that are hashed at a time, and bits that number places in them.
CHUNK, PLACES = 1 << 18, 20
#: Odd factors of two polynomial hashes.
_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly, in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _powers_of() -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of both factors and of their inverses modulo 2^64."""
    if not _powers:
        for factor in _FACTORS:
            back = pow(factor, -1, 1 << 64)
            steps = [np.full(1 << PLACES, f, np.uint64) for f in (factor, back)]
            for step in steps:
                step[0] = 1
            _powers.append((np.cumprod(steps[0], dtype=np.uint64), np.cumprod(steps[1], dtype=np.uint64)))
    return _powers


def _words(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes from each place on as a number; zeros follow the last."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray(len(data), f"{order}u8", padded, strides=(1,)).astype(np.uint64)


def contexts(data: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Contexts of the windows at ``starts`` (rising): anchor hash, hash of the context's bytes, first and last start.

    Neighbouring contexts of equal bytes, as periodic texts have them, are given as one, with their number."""
    (up, down), (up2, down2) = _powers_of()
    x = _mixed(_words(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * up[: len(x)])))
    span = GRAM - 7
    grams = _mixed((sums[span:] - sums[:-span]) * down[: len(sums) - span])
    least = grams & ~np.uint64((1 << PLACES) - 1) | np.arange(len(grams), dtype=np.uint64)
    reach, wide = window - GRAM + 1, 1
    while wide * 2 <= reach:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if reach > wide:
        least = np.minimum(least[: wide - reach], least[reach - wide :])
    anchor = (least[starts] & np.uint64((1 << PLACES) - 1)).astype(np.int64)
    new = np.flatnonzero((anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    first, last = starts[np.concatenate(([0], new))], starts[np.concatenate((new - 1, [len(starts) - 1]))]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * up2[: len(x)])))
    whole = (sums[last + window - 7] - sums[first]) * down2[first]
    whole = _mixed(whole + (last - first).astype(np.uint64) * np.uint64(_FACTORS[0]))
    name = grams[anchor[np.concatenate(([0], new))]]
    same = (name[1:] == name[:-1]) & (whole[1:] == whole[:-1]) & (first[1:] == last[:-1] + 1)
    begin = np.concatenate(([0], np.flatnonzero(~same) + 1))
    end = np.concatenate((begin[1:], [len(name)]))
    return name[begin].view(np.int64), whole[begin].view(np.int64), first[begin], last[begin], last[end - 1], (end - begin).astype(np.int64)


def _cut(column: pa.Array, window: int) -> Iterator[tuple]:
    """A batch's contexts, some texts at a time; of a long text some starts at a time.

    Gives the bytes at hand, which text each context is of, how far its places are shifted, and ``contexts``."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)

    def of(pieces: list[tuple[int, int, int]]) -> tuple:
        data = np.concatenate([raw[offsets[i] + s : offsets[i] + e + window - 1] for i, s, e in pieces])
        base = np.cumsum([0] + [e - s + window - 1 for _, s, e in pieces])[:-1]
        starts = np.concatenate([np.arange(b, b + e - s) for b, (_, s, e) in zip(base, pieces)])
        found = contexts(data, starts, window)
        piece = np.searchsorted(base, found[2], "right") - 1
        return data, np.array([i for i, _, _ in pieces])[piece], (np.array([s for _, s, _ in pieces]) - base)[piece], found

    held, size = [], 0
    for i in range(len(column)):
        n = int(offsets[i + 1] - offsets[i]) - window + 1
        for s in range(0, n, CHUNK):
            e = min(n, s + CHUNK)
            if held and size + e - s + window > CHUNK:
                yield of(held)
                held, size = [], 0
            held.append((i, s, e))
            size += e - s + window - 1
    if held:
        yield of(held)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes of ``data`` in order, by Larsson-Sadakane refinement: groups that are equal so far are sorted by the ranks of
    what follows, twice as far each round, and groups of one are left alone."""
    n = len(data)
    words = _words(data, ">")
    sa = np.argsort(words).astype(np.int32)
    words = words[sa]
    new = np.concatenate(([True], words[1:] != words[:-1]))
    at = np.arange(n, dtype=np.int32)
    group = np.maximum.accumulate(np.where(new, at, 0))
    rank = np.empty(n, np.int32)
    rank[sa] = group
    single = new & np.concatenate((new[1:], [True]))
    open_at, reach = at[~single], 8
    while len(open_at):
        held = sa[open_at]
        after = held + reach
        behind = np.where(after < n, rank[np.minimum(after, n - 1)] + (reach + 1), n - held)  # a suffix that has ended comes first
        key = rank[held].astype(np.uint64) << np.uint64(32) | behind.astype(np.uint64)
        order = np.argsort(key)
        held, key = held[order], key[order]
        sa[open_at] = held
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[held] = open_at[np.maximum.accumulate(np.where(new, np.arange(len(held)), 0))]
        open_at = open_at[~(new & np.concatenate((new[1:], [True])))]
        reach *= 2
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray, most: int, lanes: int = 4096) -> np.ndarray:
    """Bytes, up to ``most``, that each suffix shares with the one sorted before it (0 for the first), by Kasai's rule: from one
    place of the text to the next the shared length falls by one at most. Stretches of the text go side by side."""
    n = len(data)
    words = _words(np.concatenate((data, np.zeros(most + 8, np.uint8))))
    before = np.empty(n + 1, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = before[n] = n
    found = np.zeros(n + 1, np.int32)
    step = max(1, -(-n // lanes))
    at = np.arange(0, n, step)
    stop = np.minimum(at + step, n)
    shared = np.zeros(len(at), np.int64)
    while len(at):
        apart = words[at + shared] ^ words[before[at] + shared]
        shared += np.bitwise_count((apart & (~apart + np.uint64(1))) - np.uint64(1)) >> 3  # equal bytes of the eight
        done = (apart != 0) | (shared >= most)
        told = np.minimum(np.minimum(shared, most), n - np.maximum(at, before[at]))  # no further than either ends
        found[at[done]] = told[done]
        shared = np.where(done, np.maximum(told - 1, 0), shared)
        at = at + done
        if done.any():
            open_ = at < stop
            if not open_.all():
                at, stop, shared = at[open_], stop[open_], shared[open_]
    return found[:n][sa]


def repeated_windows(bodies: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all bodies in suffix order: the body, the start in it, the number of its run of equal windows, the run's size."""
    data = np.concatenate(bodies)
    sizes = np.array([len(b) for b in bodies])
    base = np.concatenate(([0], np.cumsum(sizes)))
    own = np.arange(len(data)) - np.repeat(base[:-1], sizes) <= np.repeat(sizes, sizes) - window
    sa = suffix_array(data)
    shared = common_prefixes(data, sa, window)
    kept = np.flatnonzero(own[sa])
    between = np.minimum.reduceat(shared[: kept[-1] + 1], np.concatenate(([0], kept[:-1] + 1))) if len(kept) else shared[:0]
    run = np.cumsum(np.concatenate(([0], between[1:] < window))) if len(kept) else kept
    place = sa[kept].astype(np.int64)
    body = np.searchsorted(base, place, "right") - 1
    return body, place - base[body], run, np.bincount(run)[run] if len(kept) else kept


#: A named run of equal windows: its name, and the context and start of its window if that is the only one, else -1.
NAMED = np.dtype([("name", "S16"), ("hash", "<i8"), ("whole", "<i8"), ("start", "<i4")])
_RUNS = pa.schema([("hash", pa.int64()), ("whole", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("shard", pa.int64()), ("bucket", pa.int64()), ("names", pa.binary())])
RUNS = "hash long, whole long, start int, stop int, shard long, bucket long, names binary"


def _runs(window: int):
    def of_shard(table: pa.Table) -> pa.Table:
        """Stretches of starts (``start`` to ``stop``) of contexts seen once whose windows come again in this shard; if the
        hash has more shards, also the sorted names of its runs of equal windows, packed by ranges of their hashes."""
        table = table.combine_chunks()
        bodies = [np.frombuffer(b.as_buffer(), np.uint8) for b in table["body"]]
        body, start, run, size = repeated_windows(bodies, window)
        once = (table["n"].to_numpy() == 1)[body]
        hashes, wholes, splits = table["hash"].to_numpy(), table["whole"].to_numpy(), table["splits"][0].as_py()
        again = once & (size > 1)
        order = np.lexsort((start[again], body[again]))
        b, s = body[again][order], start[again][order]
        first = np.flatnonzero(np.concatenate(([True], (b[1:] != b[:-1]) | (s[1:] != s[:-1] + 1)))[: len(b)])
        last = np.concatenate((first[1:] - 1, [len(b) - 1]))[: len(first)]
        none = [pa.nulls(len(first), kind) for kind in (pa.int64(), pa.int64(), pa.binary())]
        found = pa.Table.from_arrays([pa.array(hashes[b[first]]), pa.array(wholes[b[first]]), pa.array(s[first].astype(np.int32)), pa.array(s[last].astype(np.int32)), *none], schema=_RUNS)
        if splits == 1:
            return found
        head = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        named = np.zeros(len(head), NAMED)
        named["name"] = [hashlib.blake2b(bodies[x][y : y + window], digest_size=16).digest() for x, y in zip(body[head].tolist(), start[head].tolist())]
        named["hash"], named["whole"] = hashes[body[head]], wholes[body[head]]
        named["start"] = np.where(once[head] & (size[head] == 1), start[head], -1)
        named = named[np.argsort(named["name"])]
        bucket = named["name"].copy().view("<u4")[::4] % min(16 * splits, 1 << 14)
        held = [(int(k), named[bucket == k].tobytes()) for k in np.unique(bucket)]
        none = [pa.nulls(len(held), kind) for kind in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
        packed = pa.Table.from_arrays([*none, pa.repeat(table["shard"][0], len(held)), pa.array([k for k, _ in held], pa.int64()), pa.array([x for _, x in held], pa.binary())], schema=_RUNS)
        return pa.concat_tables([found, packed])

    return of_shard


def _merged(table: pa.Table) -> pa.Table:
    """Of the names of several shards, the lone windows whose name another shard has as well, by binary search."""
    named = np.concatenate([np.frombuffer(x.as_buffer(), NAMED) for x in table["names"]])
    ordered = np.sort(named["name"])
    held = np.searchsorted(ordered, named["name"], "right") - np.searchsorted(ordered, named["name"], "left")
    lone = named[(held > 1) & (named["start"] >= 0)]
    return pa.table({"hash": lone["hash"].copy(), "whole": lone["whole"].copy(), "start": lone["start"].copy(), "stop": lone["start"].copy()})


def repeated_spans(docs: DataFrame, window: int = 400, shard_bytes: int = 2 << 20, map_bits: int = 27, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text of ``docs`` with repeats a row: ``text_key`` (see ``text_digest``) and ``spans``, the maximal runs of bytes that lie in a
    string of ``window`` bytes that also starts anywhere else, in the same text or another; starts and ends (exclusive) in bytes.

    Whole texts of any length are judged, null ones as empty; repeated rows and equal texts are places of their own; overlaps
    count; an empty table gives an empty result. Other columns are not read.
    Two bit maps of 2^``map_bits`` bits, whose size does not grow with the data, keep contexts whose anchor comes once from
    travelling; they decide only the work. A shard holds about ``shard_bytes``; a hash with more than twice that gets several.
    """
    spark = ship(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("text")).filter(F.octet_length("text") >= window)
    data = texts.select(F.col("text").cast("binary").alias("data"))

    def named(batches):
        for batch in batches:
            for _, _, _, (name, whole, *_, times) in _cut(batch.column(0), window):
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(whole), pa.array(times)], ["hash", "whole", "times"])

    told = data.mapInArrow(named, "hash long, whole long, times long").groupBy("hash")
    told = told.agg(F.min("whole").alias("whole"), F.max("whole").alias("other"), F.sum("times").alias("n")).filter("n > 1")
    told = saved(told.select("hash", "whole", (F.col("whole") != F.col("other")).alias("contested")), "suffix-anchors")
    contested_map = spark.sparkContext.broadcast(_bit_map(told.filter("contested").select(F.col("hash").alias("key")), map_bits))
    repeated_map = spark.sparkContext.broadcast(_bit_map(told.select(F.col("hash").alias("key")), map_bits))

    def bodies(batches):
        for batch in batches:
            for held, _, _, (name, whole, first, last, _, times) in _cut(batch.column(0), window):
                kept = np.flatnonzero(_in_map(contested_map.value, name))
                raw = held.tobytes()
                body = [raw[s : e + window] for s, e in zip(first[kept].tolist(), last[kept].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(name[kept]), pa.array(whole[kept]), pa.array(times[kept]), pa.array(body, pa.binary())], ["hash", "whole", "n", "body"])

    distinct = data.mapInArrow(bodies, "hash long, whole long, n long, body binary").groupBy("hash", "whole").agg(F.sum("n").alias("n"), F.first("body").alias("body"))
    distinct = saved(distinct.withColumn("size", F.length("body")), "suffix-contexts")
    shards = max(1, -(-(distinct.agg(F.sum("size")).first()[0] or 0) // shard_bytes))
    dealt = distinct.withColumn("shard", F.pmod("hash", F.lit(shards)))
    large = saved(dealt.groupBy("shard").agg(F.ceil(F.sum("size") / (2 * shard_bytes)).cast("int").alias("splits")).filter("splits > 1"), "suffix-large")
    dealt = dealt.join(large, "shard", "left").withColumn("splits", F.coalesce("splits", F.lit(1)))
    dealt = dealt.select("shard", F.pmod(F.xxhash64("whole"), F.col("splits")).alias("sub"), "splits", "hash", "whole", "n", "body")
    runs = saved(dealt.groupBy("shard", "sub").applyInArrow(_runs(window), RUNS), "suffix-runs")

    whole = lambda df: df.select("hash", "whole", F.lit(0).alias("start"), F.lit(None).cast("int").alias("stop"))
    decided = whole(told.filter("NOT contested")).unionByName(whole(distinct.filter("n > 1"))).unionByName(runs.filter("names IS NULL").select("hash", "whole", "start", "stop"))
    names = runs.filter("names IS NOT NULL").select("shard", "bucket", "names")
    decided = decided.unionByName(names.groupBy("shard", "bucket").applyInArrow(_merged, "hash long, whole long, start int, stop int"))

    def placed(batches):
        for batch in batches:
            keys = batch.column(1)
            for _, row, shift, (name, whole_, first, _, end, _) in _cut(batch.column(0), window):
                kept = np.flatnonzero(_in_map(repeated_map.value, name))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row[kept])), pa.array(name[kept]), pa.array(whole_[kept]), pa.array((first + shift)[kept]), pa.array((end + shift)[kept])], ["text_key", "hash", "whole", "lo", "hi"])

    keyed = texts.select(F.col("text").cast("binary").alias("data"), text_digest(F.col("text")).alias("text_key"))
    places = keyed.mapInArrow(placed, "text_key string, hash long, whole long, lo long, hi long").distinct()
    covered = places.join(decided, ["hash", "whole"]).select("text_key", (F.col("lo") + F.col("start")).alias("start"), (F.coalesce(F.col("lo") + F.col("stop"), F.col("hi")) + window).alias("end"))
    return covered.groupBy("text_key").agg(F.collect_list(F.struct("start", "end")).alias("spans")).select("text_key", F.arrow_udf(_united, "array<struct<start:bigint,end:bigint>>")("spans").alias("spans"))


def _united(column: pa.Array) -> pa.Array:
    """Lists of spans, sorted, with those that touch or overlap made one."""
    out = []
    for spans in values(column):
        ends = np.array([(x["start"], x["end"]) for x in spans], np.int64).reshape(-1, 2)
        ends = ends[np.argsort(ends[:, 0], kind="stable")]
        far = np.maximum.accumulate(ends[:, 1])
        new = np.concatenate(([True], ends[1:, 0] > far[:-1]))
        last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(ends) - 1]))
        out.append([{"start": a, "end": b} for a, b in zip(ends[new, 0].tolist(), far[last].tolist())])
    return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))


def _without(data: pa.Array, column: pa.Array) -> pa.Array:
    """Bytes outside the spans; null where there are none."""
    out = []
    for raw, spans in zip(values(data), values(column)):
        if raw is None:
            out.append(None)
            continue
        borders = [0, *[x for s in spans for x in (s["start"], s["end"])], len(raw)]
        out.append(b"".join(raw[a:b] for a, b in zip(borders[::2], borders[1::2])))
    return pa.array(out, pa.binary())


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def remove_repeats(docs: DataFrame, window: int = 400, text_col: str = "text", **settings: int) -> DataFrame:
    """``docs`` with ``n_bytes``, ``spans`` (see ``repeated_spans``; an empty list if nothing repeats) and ``kept``, the remaining bytes, which
    may cut characters in two.

    Every row stays; null texts are empty ones; columns of these names are replaced, all others keep their values."""
    spans = repeated_spans(docs, window, text_col=text_col, **settings)
    own, back = set_aside(docs, data=F.coalesce(F.col(text_col), F.lit("")).cast("binary"), text_key=text_digest(F.col(text_col)))
    met = own.join(small(saved(spans, "suffix-spans")), "text_key", "left")
    kept = F.arrow_udf(_without, "binary")(F.when(F.col("spans").isNotNull(), F.col("data")), F.col("spans"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    new = [F.length("data").cast("long").alias("n_bytes"), F.coalesce("spans", none).alias("spans"), F.coalesce(kept, "data").alias("kept")]
    return met.select(*back("n_bytes", "spans", "kept"), *new)
