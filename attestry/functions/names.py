"""Names of institutions: normalisation, variants, types and identifiers, as column expressions.

Word borders are ASCII ones: a letter outside A-Z, a-z, 0-9 and _ ends a word.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dictionaries as D

BEFORE, AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def word_replace(col: Column, word: str, by: str, ignore_case: bool = True) -> Column:
    """Replace a word (a regex) where ASCII word borders surround it; at a dot that stands for a non-word character,
    the border lies after the next word character instead, as between word and non-word characters."""
    if word.endswith("."):
        stem = re.escape(word[:-1])
        pattern = rf"{BEFORE}{stem}(?:[A-Za-z0-9_]{AFTER}|[^A-Za-z0-9_](?=[A-Za-z0-9_]))"
    else:
        pattern = rf"{BEFORE}{word}{AFTER}"
    return F.regexp_replace(col, ("(?i)" if ignore_case else "") + pattern, by)


def _where_found(col: Column, words, chain) -> Column:
    """Apply a chain of replacements only to texts that hold one of the words: one regex for most texts, not many."""
    any_word = "(?i)" + "|".join(re.escape(w.rstrip(".")) for w in words)
    return F.element_at(F.transform(F.array(col), lambda c: F.when(F.rlike(c, F.lit(any_word)), chain(c)).otherwise(c)), 1)


def strip_honorifics(col: Column) -> Column:
    return F.trim(_where_found(col, D.HONORIFICS, lambda x: reduce(lambda c, h: word_replace(c, h, ""), D.HONORIFICS, x)))


def expand_ordinals(col: Column) -> Column:
    return _where_found(col, D.ORDINALS, lambda x: reduce(lambda c, o: word_replace(c, o[0], o[1]), D.ORDINALS.items(), x))


def canonical_places(col: Column) -> Column:
    return _where_found(col, D.PLACE_ALIASES, lambda x: reduce(lambda c, p: word_replace(c, p[0], p[1]), D.PLACE_ALIASES.items(), x))


@lru_cache(1)
def _accent_map() -> tuple[str, str, dict[str, str]]:
    """Characters by their compatibility decomposition without combining marks: those that become one other character, and
    those that become several or none. Syllables that decompose by rule (Hangul) are left whole."""
    source, target, several = [], [], {}
    for c in [*range(0x80, 0x3400), *range(0xF900, 0xFFF0)]:
        ch = chr(c)
        plain = "".join(x for x in unicodedata.normalize("NFKD", ch) if not 0x300 <= ord(x) <= 0x36F)
        if plain != ch and len(plain) == 1:
            source.append(ch)
            target.append(plain)
        elif plain != ch:
            several[ch] = plain
    return "".join(source), "".join(target), several


def unaccent(col: Column) -> Column:
    """Compatibility decomposition without combining marks; loose marks go. ASCII texts, as most are, are left alone at the
    cost of one regex; texts without a character that becomes several (ligatures, fractions, enclosed forms) are done in
    one pass."""
    source, target, several = _accent_map()
    among = "".join(several)
    spell = lambda c: F.array_join(F.transform(F.split(c, ""), lambda ch: F.coalesce(F.try_element_at(fixed_map(several), ch), ch)), "")
    let = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  computed once, used often
    plain = lambda c: F.regexp_replace(F.translate(let(c, lambda x: F.when(F.length(F.translate(x, among, "")) < F.length(x), spell(x)).otherwise(x)), source, target), "[\\u0300-\\u036f]", "")
    return let(col, lambda c: F.when(F.rlike(c, F.lit(r"[^\x00-\x7F]")), plain(c)).otherwise(c))


def squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def plain_words(col: Column) -> Column:
    """Punctuation to spaces (ASCII word characters stay), spaces collapsed."""
    return squeeze(F.regexp_replace(col, r"[^\w\s]", " "))


def normalized(col: Column) -> Column:
    text = F.lower(expand_ordinals(strip_honorifics(F.coalesce(col, F.lit("")))))
    return plain_words(canonical_places(F.replace(unaccent(text), F.lit("&"), F.lit("and"))))


def tokens(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda t: t != "")


def core_tokens(toks: Column) -> Column:
    return F.filter(toks, lambda t: ~t.isin(D.STOP_WORDS))


def first_in(toks: Column, words: list[str]) -> Column:
    return F.try_element_at(F.filter(toks, lambda t: t.isin(words)), F.lit(1))


def normalize_name(col: Column) -> Column:
    """Struct (normalized, tokens, core_tokens, stripped, state); null and empty names give empty parts and no state."""
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  computed once, used often
    stripped = strip_honorifics(F.coalesce(col, F.lit("")))

    def parts(text: Column) -> Column:
        return once(
            tokens(text),
            lambda toks: F.struct(
                text.alias("normalized"),
                toks.alias("tokens"),
                core_tokens(toks).alias("core_tokens"),
                stripped.alias("stripped"),
                first_in(toks, D.STATES).alias("state"),
            ),
        )

    return once(normalized(col), parts)


def city_of(toks: Column) -> Column:
    return first_in(toks, D.CITIES)


def are_similar(name_a: Column, name_b: Column, core_a: Column, core_b: Column) -> Column:
    """Equal normal forms, or shared core tokens reach 0.6 of the shorter list."""
    shorter = F.least(F.size(core_a), F.size(core_b))
    return (name_a == name_b) | F.coalesce((shorter > 0) & (F.size(F.array_intersect(core_a, core_b)) / shorter >= 0.6), F.lit(False))


def fixed_map(table: dict[str, str]) -> Column:
    """A table of fixed strings as one constant."""
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def _short_forms(upper_only: bool) -> Column:
    """Short forms by key; words are looked up in upper case, so keys with small letters are out of reach unless fixed."""
    return fixed_map({k if upper_only else k.upper(): v for k, v in D.SHORT_FORMS.items()})


def expand_variants(col: Column, fix_patterns: bool = False, fix_keys: bool = False, most: int = 5) -> Column:
    """Up to five variants of a name: all short forms written out; "IIT x" and "NIT x" as a technology institute; one at
    a time. Without short forms, the name itself. ``fix_patterns`` writes NIT out as its own name; ``fix_keys`` makes
    mixed-case keys reachable."""
    forms = _short_forms(not fix_keys)
    words = F.split(col, r"\s+")
    full = lambda w: F.coalesce(F.try_element_at(forms, F.upper(w)), w)
    known = F.exists(words, lambda w: F.try_element_at(forms, F.upper(w)).isNotNull())
    spell = lambda ws: F.array_join(F.transform(ws, full), " ")
    rest = F.split(F.regexp_extract(col, r"(?i)^(?:iit|nit)\s+(.+)$", 1), r"\s+")

    def pattern(short: str) -> Column:
        long = D.SHORT_FORMS[short if fix_patterns else "IIT"]
        return F.when(F.rlike(col, F.lit(rf"(?i)^{short}\s+.+$")), F.concat(F.lit(long + " "), spell(rest)))

    single = F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.when(F.try_element_at(forms, F.upper(F.get(words, i))).isNotNull(), F.array_join(F.transform(words, lambda w, j: F.when(i == j, full(w)).otherwise(w)), " ")))
    found = F.array_compact(F.concat(F.array(spell(words), pattern("IIT"), pattern("NIT")), single))
    distinct = F.aggregate(
        found,
        F.array().cast("array<string>"),
        lambda acc, v: F.when(F.exists(acc, lambda x: F.lower(F.trim(x)) == F.lower(F.trim(v))), acc).otherwise(F.concat(acc, F.array(v))),
    )
    return F.when(F.coalesce(F.trim(col), F.lit("")) == "", F.array(F.lit(""))).when(known, F.slice(distinct, 1, most)).otherwise(F.array(col))


def has_short_forms(col: Column) -> Column:
    forms = _short_forms(True)
    return F.exists(F.split(col, r"\s+"), lambda w: F.try_element_at(forms, F.upper(w)).isNotNull())


def full_form(col: Column) -> Column:
    return F.try_element_at(_short_forms(True), F.upper(col))


def short_form(col: Column) -> Column:
    return F.try_element_at(fixed_map({v.lower(): k for k, v in D.SHORT_FORMS.items()}), F.lower(col))


def lookup_form(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(col), r"\s+", " "))


def scraper_form(col: Column) -> Column:
    """Lower, trimmed, spaces collapsed, then punctuation dropped."""
    return F.regexp_replace(squeeze(F.lower(col)), r"[^\w\s]", "")


def depository_form(col: Column) -> Column:
    text = F.trim(F.lower(F.coalesce(col, F.lit(""))))
    return plain_words(F.replace(F.replace(text, F.lit("&amp;"), F.lit("and")), F.lit("&"), F.lit("and")))


def depository_tokens(normal: Column) -> Column:
    return F.array_join(F.filter(F.split(normal, " "), lambda t: (t != "") & ~t.isin(D.DEPOSITORY_STOP_WORDS)), " ")


def _replace_first(col: Column, old: str, new: str) -> Column:
    at = F.instr(col, old)
    return F.when(at > 0, F.concat(F.substring(col, F.lit(1), at - 1), F.lit(new), F.substring(col, at + len(old), F.length(col))))


def depository_variants(col: Column) -> Column:
    """Variants under which a depository entry is found: normal form, weighty words, short forms written out (found as
    substrings), city aliases, and the name without its kind; one-letter variants are dropped."""
    normal = depository_form(col)
    parts = [normal, depository_tokens(normal)]
    for short, long in D.DEPOSITORY_SHORT_FORMS.items():
        longer = _replace_first(normal, short, long)
        parts += [longer, depository_tokens(longer)]
    parts += [_replace_first(normal, city, alias) for city, alias in D.DEPOSITORY_CITIES.items()]
    parts.append(squeeze(reduce(lambda c, w: word_replace(c, w, "", False), ["university", "college", "institute"], normal)))
    return F.filter(F.array_distinct(F.array_compact(F.array(*parts))), lambda v: F.length(v) > 1)


def slug(col: Column, most: int = 256) -> Column:
    return F.substring(F.regexp_replace(F.lower(col), r"\s+", "-"), 1, most)


def external_slug(*cols: Column) -> Column:
    """Identifier from parts: lower, everything but letters and digits to single dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws("-", *cols)), "[^a-z0-9]+", "-"), "^-|-$", "")


def infer_type(col: Column, strict_words: bool = False) -> Column:
    """Institution type by the first rule with a word in the name; substrings count (so "community" holds "nit") unless
    ``strict_words``."""
    name = F.lower(F.coalesce(col, F.lit("")))
    rule = F
    out = None
    for kind, words in D.TYPE_WORDS:
        hit = reduce(lambda a, b: a | b, [F.rlike(name, F.lit(BEFORE + w + AFTER)) if strict_words else F.contains(name, F.lit(w)) for w in words])
        out = rule.when(hit, F.lit(kind)) if out is None else out.when(hit, F.lit(kind))
    return out.otherwise(F.lit("other"))


def first_filled(attributes: Column, keys: list[str]) -> Column:
    """The first of the keys whose value is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.try_element_at(attributes, F.lit(k)), F.lit("")) for k in keys])


def registry_type(attributes: Column) -> Column:
    raw = F.nullif(F.trim(first_filled(attributes, D.TYPE_KEYS)), F.lit(""))
    return F.coalesce(F.try_element_at(fixed_map(D.TYPE_NAMES), F.lower(raw)), raw)


def registry_status(attributes: Column) -> Column:
    return F.nullif(F.trim(first_filled(attributes, D.STATUS_KEYS)), F.lit(""))


def registry_url(attributes: Column) -> Column:
    values = F.array(*[F.try_element_at(attributes, F.lit(k)) for k in D.URL_KEYS])
    return F.try_element_at(F.filter(values, lambda v: F.rlike(v, F.lit("^https?://"))), F.lit(1))


def registry_contacts(attributes: Column) -> Column:
    return F.struct(*[first_filled(attributes, keys).alias(field) for field, keys in D.CONTACT_KEYS.items()])


def merge_contacts(website: Column, registry: Column) -> Column:
    """Field by field, the website's value if it has one, else the registry's."""
    return F.struct(*[F.coalesce(F.nullif(website[f], F.lit("")), registry[f]).alias(f) for f in D.CONTACT_KEYS])


def unaccent_exact(text: str) -> str:
    """The full decomposition for one string; ``sys.maxunicode`` wide, for checks and for the few texts that need it."""
    assert sys.maxunicode
    return "".join(x for x in unicodedata.normalize("NFKD", text) if not 0x300 <= ord(x) <= 0x36F)
