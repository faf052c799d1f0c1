"""Packing documents into training sequences: best fit, then swap-based local search on underfull bins."""

from __future__ import annotations

import heapq
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved, ship
from .byte_bpe import WordCache, byte_alphabet, pretokens
from .columns import set_aside, values


class Encoder:
    """Ids of whole texts from the ``tokenizers`` library, one pre-token at a time.

    The library's own scan of a text costs most of its time; here texts are cut by the scanner that counts tokens too,
    which takes one pass over any text, and the library's model gives the ids of each distinct pre-token.
    """

    def __init__(self, vocab_path: str, cache_words: int = 1 << 16):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(vocab_path)
        letters = {b: ch for ch, b in byte_alphabet().items()}
        self.special = {t.content: array("I", [i]).tobytes() for i, t in library.get_added_tokens_decoder().items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        tokenize = library.model.tokenize
        self.words = WordCache(lambda word: array("I", [t.id for t in tokenize("".join([letters[b] for b in word.encode("utf-8")]))]).tobytes(), cache_words)

    def ids(self, text: str) -> bytes:
        """Unsigned 32-bit ids of a text; strings of added tokens inside it count as these tokens, as the library has it."""
        word = self.words.__getitem__
        if self.split is None or not any(s in text for s in self.special):
            return b"".join(map(word, pretokens(text)))
        return b"".join(self.special[part] if part in self.special else b"".join(map(word, pretokens(part))) for part in self.split.split(text))


@lru_cache(2)
def encoder(vocab_path: str, cache_words: int = 1 << 16) -> Encoder:
    return Encoder(vocab_path, cache_words)


def token_pieces(docs: DataFrame, vocab_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", cache_words: int = 1 << 16) -> DataFrame:
    """Rows (``doc_id``, ``piece``, ``start``, ``length``, ``ids``): each text's ids (unsigned 32-bit, little-endian)
    followed by ``end_id``, cut into pieces of ``capacity`` ids if it is longer; then the first piece takes the odd rest.

    Null texts count as empty and give one piece that is the end id alone. Ids may be null. Texts of any length, runs of
    white space included, are cut in one pass. Repeated rows give repeated pieces; an empty table gives an empty
    result. Other columns are not read. Each worker keeps the ids of up to ``cache_words`` pre-tokens (about 200 bytes each).
    """
    ship(docs.sparkSession)

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        ids, end = encoder(vocab_path, cache_words).ids, array("I", [end_id]).tobytes()
        return pa.array([ids(t) + end for t in values(texts)], pa.binary())

    whole = docs.select(F.col(id_col).alias("doc_id"), encode(F.coalesce(F.col(text_col), F.lit(""))).alias("_ids"))
    n = F.expr("octet_length(_ids) div 4")
    pieces = F.expr(f"(octet_length(_ids) div 4 + {capacity - 1}) div {capacity}")
    cut = whole.select("doc_id", "_ids", n.alias("_n"), pieces.alias("_k")).select("doc_id", "_ids", "_n", "_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)).alias("_piece"))
    first = F.col("_n") - (F.col("_k") - 1) * capacity
    start = F.when(F.col("_piece") == 0, F.lit(0).cast("long")).otherwise(first + (F.col("_piece") - 1) * capacity)
    length = F.when(F.col("_piece") == 0, first).otherwise(F.lit(capacity).cast("long"))
    return cut.select("doc_id", F.col("_piece").cast("int").alias("piece"), start.alias("start"), length.alias("length"), F.substring("_ids", (start * 4 + 1).cast("int"), (length * 4).cast("int")).alias("ids"))


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit, longest first: each item goes to the fullest bin that still takes it. Bins of item indexes."""
    bins: list[list[int]] = []
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free room
    rooms = 0  # bit r is set if a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > size:
            waiting[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empty bins by moves and by one-for-one and two-for-one exchanges between underfull bins.

    Works on the emptiest bin: each step must carry items to a bin that is no emptier, so the sum of squared fills
    rises and the search ends: when the free room over all bins is below one bin, as no packing has fewer, or after a
    pass over all underfull bins in which none could give anything. Targets are looked up by the length they give
    back and their free room.
    """
    size = lengths.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    live = sum(1 for b in bins if b)
    least = -(-sum(fill) // capacity)
    moved = True
    while moved and live > least:
        moved = False
        index = _Targets(capacity)
        queue = [(fill[b], b) for b in range(len(bins)) if bins[b] and fill[b] < capacity]
        for _, b in queue:
            index.put(b, bins[b], size, capacity - fill[b])
        heapq.heapify(queue)
        while queue and live > least:
            seen, source = heapq.heappop(queue)
            if seen != fill[source]:  # it has grown since
                if fill[source] < capacity:
                    heapq.heappush(queue, (fill[source], source))
                continue
            index.drop(source)  # all others are no emptier
            while bins[source]:
                best = _exchange(bins[source], size, index)
                if best is None:
                    break
                gain, give, target, take = best
                bins[source] = [i for i in bins[source] if i not in give] + list(take)
                bins[target] = [i for i in bins[target] if i not in take] + list(give)
                fill[source] -= gain
                fill[target] += gain
                index.drop(target)
                if fill[target] < capacity:
                    index.put(target, bins[target], size, capacity - fill[target])
                moved = True
            live -= not bins[source]
    return [b for b in bins if b]


class _Targets:
    """Underfull bins by the length of one item (or none) and of two items that they can give back, most room first."""

    def __init__(self, capacity: int):
        self.heaps: tuple[dict, dict] = ({}, {})
        self.reach = np.full((2, capacity + 1), -1, np.int64)  # per length given back: that length and the most room with it
        self.version: dict[int, int] = {}
        self.held: dict[int, tuple[dict, dict]] = {}

    def put(self, b: int, items: list[int], size: list[int], room: int) -> None:
        one = {0: ()} | {size[i]: (i,) for i in items}
        two = {size[x] + size[y]: (x, y) for n, x in enumerate(items) for y in items[n + 1 :]}
        self.held[b] = (one, two)
        version = self.version[b] = self.version.get(b, 0) + 1
        for kind, takes in enumerate((one, two)):
            for t in takes:
                heapq.heappush(self.heaps[kind].setdefault(t, []), (-room, b, version))
                self.reach[kind, t] = max(self.reach[kind, t], t + room)

    def drop(self, b: int) -> None:
        self.version[b] += 1
        for kind, takes in enumerate(self.held.pop(b)):
            for t in takes:
                heap = self.heaps[kind][t]
                while heap and self.version[heap[0][1]] != heap[0][2]:
                    heapq.heappop(heap)
                self.reach[kind, t] = t - heap[0][0] if heap else -1

    def best(self, give: int, kinds: int):
        """The bin and items taken back, of the least length, for ``give``: (length, bin, items), or None."""
        found = None
        for kind in range(kinds):
            fits = self.reach[kind, :give] >= give
            t = int(fits.argmax())
            if fits[t] and (found is None or t < found[0]):
                b = self.heaps[kind][t][0][1]
                found = (t, b, self.held[b][kind][t])
        return found


def _exchange(source: list[int], size: list[int], index: _Targets):
    """The exchange that carries most out of the source: (gain, items given, target, items taken), or None."""
    ones = {size[i]: (i,) for i in source}
    twos = {size[a] + size[b]: (a, b) for x, a in enumerate(source) for b in source[x + 1 :]}
    best = None
    for gives, kinds in ((twos, 1), (ones, 2)):
        for give, items in gives.items():
            if best is not None and give <= best[0]:
                continue
            found = index.best(give, kinds)
            if found is not None and (best is None or give - found[0] > best[0]):
                best = (give - found[0], items, found[1], found[2])
    return best


def pack(pieces: DataFrame, capacity: int = 2048, order_cols: tuple[str, ...] = ("doc_id", "piece"), length_col: str = "length", group_rows: int = 8192, merge_groups: int = 64, rounds: int = 3) -> DataFrame:
    """All columns of ``pieces`` plus ``sequence_id`` (any number) and ``offset`` (place in the sequence, gapless from 0).

    Each row gets a number and is dealt by its hash into groups of about ``group_rows``, each packed in one task. Then
    whole bins with free room are dealt anew, up to ``rounds`` times, into groups of about ``group_rows`` pieces again
    (and no fewer groups than a ``merge_groups``-th), which are searched from these bins and packed afresh, and keep
    the better. So no task grows with the table and no round makes more sequences.

    Lengths are 1 to ``capacity``; other lengths end the job with a message. Rows of a group are ordered by length, then
    ``order_cols``, nulls last; repeated rows are packed each for itself, wherever they are; an empty table gives an
    empty result. Only numbers, ``order_cols`` and lengths travel to the groups; the other columns join the result.
    Columns of ``pieces`` named as a result are replaced, others keep their values.
    """
    ship(pieces.sparkSession)
    numbered, back = set_aside(pieces, row=F.monotonically_increasing_id(), size=F.col(length_col).cast("long"), **{f"o{i}": F.col(c) for i, c in enumerate(order_cols)})
    rows = saved(numbered, "pieces")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("least"), F.max("size").alias("most"), F.count("size").alias("known")).first()
    if facts["n"] and (facts["known"] < facts["n"] or facts["least"] < 1 or facts["most"] > capacity):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    groups = max(1, -(-facts["n"] // group_rows))
    keys = [f"o{i}" for i in range(len(order_cols))]
    slim = rows.select("row", "size", *keys, F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group"))

    def solve(key, part):
        part = part.sort_values(["size", *keys, "row"], ascending=[False] + [True] * (len(keys) + 1), kind="stable", ignore_index=True)
        lengths = part["size"].to_numpy(np.int64)
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        if "sequence_id" in part:
            given = list(part.groupby("sequence_id", sort=False).indices.values())
            given = local_search([b.tolist() for b in given], lengths, capacity)
            bins = given if len(given) <= len(bins) else bins
        sequence, offset, fill = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        for number, items in enumerate(bins):
            at = np.cumsum(lengths[items])
            sequence[items], offset[items], fill[items] = number, at - lengths[items], at[-1]
        return part.assign(sequence_id=sequence * (1 << 24) + int(key[0]), offset=offset, fill=fill)

    own = slim.columns
    fields = ", ".join(f"`{n}` {t}" for n, t in slim.dtypes) + ", sequence_id long, offset long, fill long"

    def packed(part: DataFrame) -> DataFrame:
        return part.groupBy("group").applyInPandas(solve, fields).select(*own, "sequence_id", "offset", "fill")

    out, level = saved(packed(slim), "packed"), 0
    done = []
    spare = F.col("fill") < capacity
    while groups > 1 and level < rounds:
        left = out.filter(spare).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("offset") == 0, capacity - F.col("fill"))).alias("room")).first()
        if (left["room"] or 0) < capacity:
            break
        groups = max(-(-left["n"] // group_rows), -(-groups // merge_groups))
        done.append(out.filter(~spare).withColumn("sequence_id", F.col("sequence_id") * 16 + level))
        level += 1
        dealt = F.pmod(F.xxhash64("sequence_id", F.lit(level)), F.lit(groups)).cast("long")
        out = saved(packed(out.filter(spare).drop("offset", "fill").withColumn("group", dealt)), "packed")
    result = out.withColumn("sequence_id", F.col("sequence_id") * 16 + level)
    for part in done:
        result = result.unionByName(part)
    return rows.join(result.select("row", "sequence_id", "offset"), "row").select(*back("sequence_id", "offset"), "sequence_id", "offset")
