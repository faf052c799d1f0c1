"""Secret scans over whole texts with a trigram inverted index, in DataFrame operations only.

Each rule's regex is turned into a Boolean query over trigrams that every match must contain. One scan notes which of
the queried trigrams a text holds; postings list, per trigram and block of rows, the rows that hold it; queries
intersect (and, for alternatives, unite) postings inside each block; candidates are verified with the regex. Rules
whose regex implies no trigram scan every text.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import saved
from .columns import set_aside


@dataclass(frozen=True)
class Rule:
    """``regex`` (ASCII; Java and Python read it alike), and the fewest characters that ``group`` must hold."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Behind the BEGIN line: all up to the END line; without one, the two header lines and the lines of base64. Line ends may be
#: written out as backslash n. Possessive groups, as these loop without recursion in Java.
_LINE_END = r"(?:[\x20\t\r\n]|\\[rn])*+"
_KEY_BODY = (
    r"(?:(?:[^-]|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_LINE_END}(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+(?:{_LINE_END}[A-Za-z0-9+/]{{16,}}+={{0,2}})*+"
    rf"(?:{_LINE_END}[A-Za-z0-9+/]{{1,15}}+={{1,2}}|\r?\n(?:[A-Za-z0-9+/]{{4}}){{1,3}}+(?=[\r\n]|$))?)"
)
VENDOR_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----" + _KEY_BODY, 0, 0),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
)


def trigram_query(regex: str) -> list | None:
    """Boolean trigram query of a regex: None (nothing is implied), a trigram, or ["and" | "or", query, ...].

    Letters are lowered, as the index is. Runs of literals give their trigrams; alternatives unite theirs, and give
    nothing if one of them gives nothing; what may be absent gives nothing and ends a run.
    """

    def of(parsed) -> list | None:
        found, run = [], ""

        def close():
            nonlocal run
            found.extend(run[i : i + 3] for i in range(len(run) - 2))
            run = ""

        for op, arg in parsed:
            if op is rc.LITERAL:
                run += chr(arg).lower()
                continue
            close()
            if op is rc.SUBPATTERN:
                found.append(of(arg[3]))
            elif op is rc.BRANCH:
                options = [of(x) for x in arg[1]]
                found.append(None if None in options else ["or", *options])
            elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT) and arg[0] > 0:
                found.append(of(arg[2]))
        close()
        found = [x for x in found if x]
        return None if not found else found[0] if len(found) == 1 else ["and", *found]

    return of(rp.parse(regex))


def _grams(query) -> set[str]:
    return {query} if isinstance(query, str) else set().union(*map(_grams, query[1:]))


def _evaluate(query, posting) -> Column:
    if isinstance(query, str):
        return posting(query)
    parts = [_evaluate(x, posting) for x in query[1:]]
    join = F.array_intersect if query[0] == "and" else F.array_union
    out = parts[0]
    for part in parts[1:]:
        out = join(out, part)
    return out


def trigram_postings(rows: DataFrame, grams: list[str], row_col: str, text_col: str, block_rows: int = 4096) -> DataFrame:
    """Postings (``block``, ``gram``, ``rows``): per block of about ``block_rows`` rows, the rows that hold the trigram.

    Only trigrams that some query names are posted: postings of all trigrams would hold several times the corpus. Each
    text is lowered once, and its trigrams are noted as bits of one number per 63 trigrams, so no array is built per text.
    """
    blocks = F.pmod(F.xxhash64(row_col), F.lit(max(1, rows.count() // block_rows)))
    words = [grams[i : i + 63] for i in range(0, len(grams), 63)]
    bits = [reduce(lambda x, y: x.bitwiseOR(y), [F.when(F.contains("low", F.lit(g)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, g in enumerate(word)]) for word in words]
    lowered = rows.select(F.col(row_col).alias("row"), blocks.alias("block"), F.lower(F.col(text_col)).alias("low"))
    noted = lowered.select("row", "block", *[b.alias(f"bits{w}") for w, b in enumerate(bits)]).filter(" OR ".join(f"bits{w} <> 0" for w in range(len(words))))
    held = [F.when(F.col(f"bits{w}").bitwiseAND(F.lit(1 << i)) != 0, F.lit(g)) for w, word in enumerate(words) for i, g in enumerate(word)]
    return noted.select("row", "block", F.explode(F.array_compact(F.array(*held))).alias("gram")).groupBy("block", "gram").agg(F.collect_set("row").alias("rows"))


def candidates(rows: DataFrame, rules: list[Rule], row_col: str, text_col: str, block_rows: int = 4096) -> DataFrame:
    """Rows (``row``, ``kinds``): which of the rules with a trigram query may match there."""
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    grams = sorted(set().union(*map(_grams, queries.values())))
    postings = trigram_postings(rows, grams, row_col, text_col, block_rows)
    by_block = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "rows"))).alias("index"))
    none = F.array().cast(f"array<{dict(postings.select(F.explode('rows').alias('r')).dtypes)['r']}>")

    def hits_of(kind: str, query) -> Column:
        rows_of = _evaluate(query, lambda g: F.coalesce(F.try_element_at("index", F.lit(g)), none))
        return F.transform(rows_of, lambda r: F.struct(r.alias("row"), F.lit(kind).alias("kind")))

    hits = [hits_of(k, q) for k, q in queries.items()]
    return by_block.select(F.explode(F.flatten(F.array(*hits))).alias("hit")).groupBy("hit.row").agg(F.collect_set("hit.kind").alias("kinds"))


CHUNK = 256


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _ahead(values: Column, merge) -> Column:
    """What ``merge`` makes of all numbers before each place of an array, from 0 on.

    Arrays cannot be appended to without a copy, so this goes by chunks of ``CHUNK``: first inside each, then over the
    chunks' ends. A number is copied ``CHUNK`` times at most, until there are ``CHUNK`` squared of them.
    """

    def walk(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, start, lambda s, x: F.struct(merge(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))

    def whole(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda c: walk(F.slice(v, c * CHUNK + 1, CHUNK)))
        return _let(chunks, lambda parts: F.flatten(F.zip_with(walk(F.transform(parts, lambda p: p["at"]))["out"], parts, lambda head, p: F.transform(p["out"], lambda x: merge(head, x)))))

    return _let(values, lambda v: F.when(F.size(v) > CHUNK, whole(v)).otherwise(walk(v)["out"]))


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule: leftmost, non-overlapping matches; those whose group is too short are dropped.

    The matches and the pieces between them alternate, so a match starts where the lengths before it add up to."""
    whole = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else whole
    lengths = F.zip_with(F.transform(F.split(text, rule.regex, -1), F.length), F.zip_with(whole, held, lambda w, h: F.struct(F.length(w).alias("w"), F.length(h).alias("h"))), lambda gap, m: F.struct(gap.alias("gap"), m["w"].alias("w"), m["h"].alias("h")))

    def placed(steps: Column) -> Column:
        before = _ahead(F.transform(steps, lambda x: x["gap"] + x["w"]), lambda a, b: a + b)
        spans = F.zip_with(before, steps, lambda b, x: F.struct((b + x["gap"]).alias("start"), F.lit(rank).alias("rank"), (b + x["gap"] + x["w"]).alias("end"), F.lit(rule.kind).alias("kind"), x["h"].alias("held")))
        return F.filter(spans, lambda x: x["held"] >= rule.least)

    return _let(F.filter(lengths, lambda x: x["w"].isNotNull()), placed)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + VENDOR_RULES, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 4096, broadcast_ids: int = 500_000) -> DataFrame:
    """All columns of ``docs`` and ``spans``: array of (start, rank, end, kind), code points, end exclusive, by start then rule.

    Null and empty texts have no spans; whole texts are scanned, and the work is in proportion to length and matches;
    repeated rows are scanned alike; an empty table gives an empty result. A row is known by the hash of its text, as the
    text alone decides, so ids may repeat or be null. Up to ``broadcast_ids`` candidate texts (16 bytes each) are
    broadcast to the verifying scan; beyond that the join shuffles. A column of ``docs`` named ``spans`` is replaced,
    others keep their values whatever their names.
    """
    indexed = [(i, r, trigram_query(r.regex)) for i, r in enumerate(rules)]
    queried = [r for _, r, q in indexed if q is not None]
    base, back = set_aside(docs, text=F.coalesce(F.col(text_col), F.lit("")), row=F.xxhash64(F.col(text_col)))
    if queried:
        found = saved(candidates(base.select("row", "text"), queried, "row", "text", block_rows), "secret-candidates")
        base = base.join(F.broadcast(found) if found.count() <= broadcast_ids else found, "row", "left")
    else:
        base = base.withColumn("kinds", F.array().cast("array<string>"))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,held:int>>")
    parts = []
    for i, rule, query in indexed:
        may = F.array_contains("kinds", rule.kind) if query is not None else F.rlike("text", F.lit(rule.regex))
        parts.append(F.when(may, _spans(F.col("text"), rule, i)).otherwise(empty))
    ordered = F.transform(F.array_sort(F.concat(*parts)), lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    return base.select(*back("spans"), ordered.alias("spans"))


BLOCK = 4096


def redact(scanned: DataFrame, text_col: str = "text", spans_col: str = "spans", mark: str = "[secret:{}]") -> DataFrame:
    """Replace every span by a mark that names its kind; of overlapping spans the first counts and the rest is cut off.

    Texts without spans, null ones too, stay as they are. A cut of a text is put together from blocks of ``BLOCK``
    characters, so a span far inside a text costs no walk from its start. All columns stay.
    """
    before, after = mark.split("{}")

    def redacted(text: Column, spans: Column) -> Column:
        def cut(blocks: Column, start: Column, end: Column) -> Column:
            first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
            block = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
            inside = F.substring(block(first), start - first * BLOCK + 1, end - start)
            across = F.concat(F.substring(block(first), start - first * BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(block(last), F.lit(1), end - last * BLOCK))
            return F.when(end <= start, "").when(first == last, inside).otherwise(across)

        def rewritten(blocks: Column) -> Column:
            reached = _ahead(F.transform(spans, lambda x: x["end"]), F.greatest)
            parts = F.zip_with(spans, reached, lambda x, at: F.when(x["start"] >= at, F.concat(cut(blocks, at, x["start"]), F.lit(before), x["kind"], F.lit(after))).otherwise(""))
            return F.concat(F.array_join(parts, ""), cut(blocks, F.array_max(F.transform(spans, lambda x: x["end"])), F.length(text)))

        return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), rewritten)

    clean = redacted(F.col(text_col), F.col(spans_col))
    return scanned.withColumn(text_col, F.when(F.size(spans_col) > 0, clean).otherwise(F.col(text_col)))
