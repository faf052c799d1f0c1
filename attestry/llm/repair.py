"""Conversation structure repair by signatures.

Each row is one hex digit: its role's initial and its first fault. A conversation's digits, cut into segments of bounded
length, are its signatures. Each distinct signature is solved once, by a memoised recursion that gives, for every state
a segment can be entered and left in, the cheapest edits; segments are chained per conversation, joined back, and the
edits are replayed row by row.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.running import PER_RANGE, ranged
from ..session import saved, ship

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: Initials by digit // 4; the last stands for any other role.
ROLES = "sua"
#: What has been given so far: nothing, a system row, a user row, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the next user or assistant row, if there may be one.
NEXT = (USER, USER, ASSISTANT, USER)
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: What ends a conversation in each state: cost and edits.
TAILS = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
_SPACE = r"[\x20\x09-\x0D]"
SOLVED = "blank int, duplicate int, truncated int, first int, last int, illegal int, ways array<struct<enter int, leave int, cost int, audit string>>"


def damaged(rows: DataFrame) -> DataFrame:
    """Seeded faults: by crc32 of ``conv_id:turn`` modulo 20 a row goes (0), loses its text (1) or its ends of sentences
    (2), comes twice (3), or turns to role user (4). Nulls, in the key too, are one space. Adds ``copy``, 0 or 1."""
    held = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    hit = held.withColumn("_hit", F.crc32(key.cast("binary")) % 20).filter("_hit <> 0")
    text = F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hit.select("conv_id", "turn", F.when(F.col("_hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def solve(signature: str) -> tuple:
    """Counts of a signature, and per state of entry and state at its end the cheapest edits, as (enter, leave, cost, audit).

    An inserted row belongs to the row that follows it. So all edits of a signature end with those of its last row, none is
    the beginning of another, and the least of equal cost can be told inside each segment."""
    digits = [int(c, 16) for c in signature]
    roles, faults = [d // 4 for d in digits], [d % 4 for d in digits]

    def edits(i: int, state: int):
        """Edits of row i itself: cost, letter, state after it."""
        cut = CUT if faults[i] == TRUNCATED else 0
        yield DELETE, "D", state
        if faults[i] in (BLANK, DUPLICATE):
            return
        follows = NEXT[state]
        yield REROLE + cut, "R", follows
        given = (SYSTEM, USER, ASSISTANT, None)[roles[i]]
        if given == follows or given == SYSTEM and state == START:
            yield KEEP + cut, "K", given

    @cache
    def best(i: int, state: int) -> dict[int, tuple[int, str]]:
        if i == len(digits):
            return {state: (0, "")}
        found: dict[int, tuple[int, str]] = {}
        at = state
        for inserts in range(4):  # a fifth state to be in does not exist
            for cost, letter, after in edits(i, at):
                for leave, (more, rest) in best(i + 1, after).items():
                    way = (inserts * INSERT + cost + more, "I" * inserts + letter + rest)
                    found[leave] = min(found.get(leave, way), way)
            at = NEXT[at]
        return found

    pairs = [ROLES[a : a + 1] + ROLES[b : b + 1] for a, b in zip(roles, roles[1:])]
    ways = [(enter, leave, *way) for enter in range(4) for leave, way in sorted(best(0, enter).items())]
    return faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), roles[0], roles[-1], sum(p not in ("su", "ua", "au") for p in pairs), ways


def _solved(batches):
    for batch in batches:
        names = ["blank", "duplicate", "truncated", "first", "last", "illegal", "ways"]
        rows = [dict(zip(names, solve(s))) | {"signature": s} for s in batch.column(0).to_pylist()]
        for row in rows:
            row["ways"] = [dict(zip(("enter", "leave", "cost", "audit"), w)) for w in row["ways"]]
        way = pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("cost", pa.int32()), ("audit", pa.string())])
        kinds = [("signature", pa.string()), *[(n, pa.int32()) for n in names[:-1]], ("ways", pa.list_(way))]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))


def chain(segments: list[list[dict]]) -> tuple[int, list[tuple[int, str]], str]:
    """The cheapest way through all segments: cost, per segment its state of entry and edits, and the edits at the end.

    Of equal cost the least in ASCII order; it is told by the first segments that differ."""
    ahead = {state: (tail[0], tail[1], None, None) for state, tail in enumerate(TAILS)}
    found = []
    for ways in reversed(segments):
        here: dict[int, tuple] = {}
        for w in ways:
            if w["leave"] in ahead:
                way = (w["cost"] + ahead[w["leave"]][0], w["audit"], w["leave"])
                here[w["enter"]] = min(here.get(w["enter"], way), way)
        found.append(here)
        ahead = here
    state, told = START, []
    for here in reversed(found):
        told.append((state, here[state][1]))
        state = here[state][2]
    return ahead[START][0], told, TAILS[state][1]


def _chained(column: pa.Array) -> pa.Array:
    out = []
    for segments in column:
        cost, told, tail = chain([s["ways"] for s in segments.as_py()])
        out.append({"cost": cost, "tail": tail, "told": [{"enter": e, "audit": a} for e, a in told]})
    told = pa.list_(pa.struct([("enter", pa.int32()), ("audit", pa.string())]))
    return pa.array(out, pa.struct([("cost", pa.int64()), ("tail", pa.string()), ("told", told)]))


def _by_row(signatures: pa.Array, enters: pa.Array, audits: pa.Array) -> pa.Array:
    """Edits of a segment cut by row, each with the state before it."""
    out = []
    for signature, state, audit in zip(signatures.to_pylist(), enters.to_pylist(), audits.to_pylist()):
        rows, begun, entered = [], 0, state
        for i, letter in enumerate(audit):
            if letter == "K" and int(signature[len(rows)], 16) // 4 == 0:
                state = SYSTEM
            elif letter != "D":
                state = NEXT[state]
            if letter != "I":
                rows.append({"enter": entered, "edits": audit[begun : i + 1]})
                begun, entered = i + 1, state
        out.append(rows)
    return pa.array(out, pa.list_(pa.struct([("enter", pa.int32()), ("edits", pa.string())])))


def _given(enter: Column, before: int) -> Column:
    """Role of the row given next, ``before`` user or assistant rows after the state ``enter``."""
    state = list(range(4))
    for _ in range(before + 1):
        state = [NEXT[s] for s in state]
    return F.when(enter.isin([i for i, s in enumerate(state) if s == USER]), "user").otherwise("assistant")


def _row(role: Column, text: Column | str) -> Column:
    return F.struct(role.alias("role"), (text if isinstance(text, Column) else F.lit(text)).alias("text"))


def _replay(edits: Column, enter: Column) -> Column:
    """The rows that a row becomes: those inserted before it, which have no text, then itself if it stays."""
    inserts = F.length(edits) - 1
    made = [F.when(inserts > n, _row(_given(enter, n), "")) for n in range(3)]
    own = F.when(edits.endswith("K"), _row(F.col("role"), F.col("text")))
    for n in range(4):
        own = own.when(edits.endswith("R") & (inserts == n), _row(_given(enter, n), F.col("text")))
    return F.array_compact(F.array(*made, own))


@dataclass(frozen=True)
class Repair:
    """``audits``: ``key``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` per conversation
    with rows. ``rows``: the repaired rows, ``key``, ``role``, ``text``, in the order of ``_range``, ``pos``, ``n``."""

    audits: DataFrame
    rows: DataFrame


def conversation_key(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("1"), conv_id.cast("string")), F.lit("0"))


def repair(rows: DataFrame, segment: int = 256, per_range: int = PER_RANGE) -> Repair:
    """Cheapest edits that make each conversation's roles read ``(s?(ua)+)?``, and the repaired rows.

    Rows (``conv_id``, ``turn``, ``role``, ``text``, ``copy``) are taken by turn (null first), then role, text and copy; rows
    without an id are one conversation; null roles and texts are one space, so such a text is blank; repeated rows are
    duplicates; texts of any length are read whole; an empty table gives empty ones. Other columns are not read.
    Conversations are cut into ranges of their order and segments of ``segment`` rows, which does not change their edits,
    so no conversation is gathered; only its edits, which are one value of the result, are chained in one task.
    """
    ship(rows.sparkSession)
    chained_of = F.arrow_udf(_chained, "struct<cost:long,tail:string,told:array<struct<enter:int,audit:string>>>")
    by_row = F.arrow_udf(_by_row, "array<struct<enter:int,edits:string>>")
    one = lambda c: F.coalesce(c, F.lit(" ")).alias(c)
    held = rows.select(conversation_key(F.col("conv_id")).alias("key"), "turn", one("role"), one("text"), "copy")
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("copy")]
    dealt = ranged(held, ["key"], order, per_range)
    placed = dealt.withColumn("pos", F.row_number().over(Window.partitionBy("key", "_range").orderBy(*order)) - 1)
    placed = saved(placed.withColumn("_same", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)), "repair-rows")

    repeats = placed.groupBy("key", "_same").agg(F.min(F.struct("_range", "pos")).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    last = F.regexp_extract("text", rf"([^\x20\x09-\x0D]){_SPACE}*\z", 1)
    fault = (
        F.when(last == "", BLANK)
        .when(F.struct("_range", "pos") > F.col("_first"), DUPLICATE)
        .when(~last.isin(".", "!", "?"), TRUNCATED)
        .otherwise(0)
    )
    role = F.coalesce(*[F.when(F.col("role").startswith(r), i) for i, r in enumerate(ROLES)], F.lit(len(ROLES)))
    digits = placed.join(repeats, ["key", "_same"], "left").select("key", "_range", "pos", F.lower(F.hex((role * 4 + fault).cast("long"))).alias("digit"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "digit")))
    signatures = digits.groupBy("key", "_range", F.floor(F.col("pos") / segment).alias("seg")).agg(F.array_join(F.transform(listed, lambda x: x["digit"]), "").alias("signature"))
    signatures = saved(signatures, "repair-signatures")
    solved = saved(signatures.select("signature").distinct().mapInArrow(_solved, f"signature string, {SOLVED}"), "repair-solved")

    told = signatures.join(solved, "signature")
    parts = told.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("_range", "seg", *[c for c in told.columns if c not in ("key", "_range", "seg")]))).alias("parts"))
    chained = saved(parts.withColumn("c", chained_of(F.transform("parts", lambda p: F.struct(p["ways"].alias("ways"))))), "repair-chained")
    total = lambda c: F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p[c]).alias(c)
    pairs = F.zip_with(F.slice("parts", 1, F.size("parts") - 1), F.slice("parts", 2, F.size("parts")), lambda a, b: F.struct(a["last"].alias("a"), b["first"].alias("b")))
    legal = lambda p: ((p["a"] == 0) & (p["b"] == 1)) | ((p["a"] == 1) & (p["b"] == 2)) | ((p["a"] == 2) & (p["b"] == 1))
    between = F.when(F.size("parts") > 1, F.size(F.filter(pairs, lambda p: ~legal(p)))).otherwise(0)
    audit = F.concat(F.array_join(F.transform("c.told", lambda t: t["audit"]), ""), "c.tail")
    turns = placed.groupBy("key").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    audits = chained.select("key", total("blank"), total("duplicate"), total("truncated"), (total("illegal") + between).alias("illegal"), F.col("c.cost").alias("cost"), audit.alias("audit")).join(turns, "key")

    pieces = chained.select("key", F.explode(F.arrays_zip("parts", F.col("c.told").alias("told"))).alias("x")).select("key", "x.parts._range", "x.parts.seg", "x.parts.signature", "x.told.enter", "x.told.audit")
    edits = pieces.select("key", "_range", "seg", F.posexplode(by_row("signature", "enter", "audit")).alias("i", "e")).select("key", "_range", (F.col("seg") * segment + F.col("i")).cast("int").alias("pos"), "e.enter", "e.edits")
    kept = placed.join(edits, ["key", "_range", "pos"]).select("key", "_range", "pos", F.posexplode(_replay(F.col("edits"), F.col("enter"))).alias("n", "row"))
    ends = F.when(F.col("c.tail") == "I", F.array(_row(F.lit("assistant"), ""))).otherwise(F.array(_row(F.lit("user"), ""), _row(F.lit("assistant"), "")))
    added = chained.filter("c.tail <> ''").select("key", F.lit(2**31 - 1).alias("_range"), F.lit(0).alias("pos"), F.posexplode(ends).alias("n", "row"))
    return Repair(audits, kept.unionByName(added).select("key", "_range", "pos", "n", "row.role", "row.text"))


def _digests(batches):
    """SHA-256 per conversation of its lines ``role:text``, which come in order; a conversation may cross batches."""
    key, state = None, None
    for batch in batches:
        done = ([], [])
        for conv, role, text in zip(*[batch.column(c).to_pylist() for c in ("key", "role", "text")]):
            if conv != key:
                if state is not None:
                    done[0].append(key)
                    done[1].append(state.hexdigest())
                key, state = conv, hashlib.sha256(f"{role}:{text}".encode())
            else:
                state.update(f"\n{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.string()) for d in done], ["key", "repaired_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["key", "repaired_sha256"])


def digests(repaired: DataFrame) -> DataFrame:
    """``key`` and ``repaired_sha256`` of the repaired rows. A digest reads a conversation's rows one after another, so
    these pass through one task, in batches and in bounded memory."""
    dealt = repaired.repartition("key").sortWithinPartitions("key", "_range", "pos", "n")
    return dealt.mapInArrow(_digests, "key string, repaired_sha256 string")
