"""Name functions against plain Python models and fixed expectations."""

from __future__ import annotations

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from attestry import dictionaries as D
from attestry.functions import names as N
from attestry.functions import similarity as S


def column(spark, values, fn):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, s string").select("i", fn(F.col("s")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


def model(raw):
    text = raw
    for h in D.HONORIFICS:
        text = re.sub(rf"\b{h}\b", "", text, flags=re.I | re.A)
    text = text.strip()
    for word, number in D.ORDINALS.items():
        text = re.sub(rf"\b{word}\b", number, text, flags=re.I | re.A)
    text = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not 0x300 <= ord(c) <= 0x36F).replace("&", "and")
    for alias, place in D.PLACE_ALIASES.items():
        text = re.sub(rf"\b{alias}\b", place, text, flags=re.I | re.A)
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", text, flags=re.A)).strip()


def test_normal_forms_follow_the_model(spark):
    rng = random.Random(4)
    parts = ["Dr.", "Shri", "prof", "First", "second", "Bombay", "IIT", "St. Xavier's", "Université", "&", "(Pune)", "the", "College", "of", "dr", "Cape Comorin", "Ñandú", "delhi", "-", "42", "Bangalore,", "tenth"]
    names = [" ".join(rng.choices(parts, k=rng.randrange(1, 7))) for _ in range(400)] + ["", "  ", "देव", "a" * 2000, "123", "!!!"]
    got = column(spark, names, N.normalize_name)
    for name, g in zip(names, got):
        assert g["normalized"] == model(name), name
        assert g["tokens"] == [t for t in model(name).split(" ") if t]
        assert g["core_tokens"] == [t for t in g["tokens"] if t not in D.STOP_WORDS]
        assert g["state"] == next((t for t in g["tokens"] if t in D.STATES), None)
    assert column(spark, [None], N.normalize_name)[0]["normalized"] == ""


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("iit bombay", ["Indian Institute of Technology bombay"]),
        ("nit trichy", ["National Institute of Technology trichy", "Indian Institute of Technology trichy"]),
        ("plain college", ["plain college"]),
        ("", [""]),
        ("iit du", ["Indian Institute of Technology University of Delhi", "Indian Institute of Technology du", "iit University of Delhi"]),
        ("iisc", ["iisc"]),
        ("amrita", ["amrita"]),
    ],
)
def test_variants(spark, name, want):
    assert column(spark, [name], N.expand_variants)[0] == want


def test_variant_fixes(spark):
    assert column(spark, ["nit trichy"], lambda c: N.expand_variants(c, fix_patterns=True))[0] == ["National Institute of Technology trichy"]
    assert column(spark, ["iisc"], lambda c: N.expand_variants(c, fix_keys=True))[0] == ["Indian Institute of Science"]


def test_short_forms(spark):
    assert len(D.SHORT_FORMS) == 140
    assert column(spark, ["iim", "xyz"], N.full_form) == ["Indian Institute of Management", None]
    assert column(spark, ["Jawaharlal Nehru University", "x"], N.short_form) == ["JNU", None]
    assert column(spark, ["the iit", "nothing"], N.has_short_forms) == [True, False]


def test_types(spark):
    assert column(spark, ["Community Hall", "Law School", "City Academy", None], N.infer_type) == ["engineering", "law", "school", "other"]
    assert column(spark, ["Community Hall"], lambda c: N.infer_type(c, strict_words=True)) == ["other"]


def test_depository_variants(spark):
    got = column(spark, ["IIT Bombay University"], N.depository_variants)[0]
    assert got[0] == "iit bombay university" and "iit mumbai university" in got and "indian institute of technology bombay university" in got and "iit bombay" in got


def test_trigram_similarity(spark):
    def grams(s):
        return {g for w in re.findall(r"[^\W_]+", s.lower()) for g in (f"  {w} "[i : i + 3] for i in range(len(w) + 1))}

    rng = random.Random(8)
    pairs = [("".join(rng.choices("ab c", k=8)), "".join(rng.choices("ab c", k=8))) for _ in range(200)] + [("", ""), ("x", "")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", S.trigram_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for r in rows:
        a, b = (grams(x) for x in pairs[r["i"]])
        assert abs(r["s"] - (len(a & b) / len(a | b) if a | b else 0)) < 1e-12


def test_cosine_edges(spark):
    rows = [([1.0, 0.0], [0.0, 1.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0], [1.0]), ([1.0], [1.0, 2.0])]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select(S.cosine(F.col("a"), F.col("b"))).collect()]
    assert [round(x, 9) for x in got] == [0, 1, 0, 0]


def test_unaccent_is_the_decomposition(spark):
    texts = ["Café", "ﬁne ﬂow", "½ cup", "Ⅷ ①", "ｆｕｌｌ", "e\u0301 x", "ß œ", "한글", "plain", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(N.unaccent(F.col("t"))).collect()]
    want = [t if t in (None, "한글") else N.unaccent_exact(t) for t in texts]
    assert got == want
