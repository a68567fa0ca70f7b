"""Cleaning and label mapping quirks."""

import pytest
from pyspark.sql import functions as F

from polylabel.functions import labels as LF
from polylabel.functions import text as TF
from polylabel.schema import DEFAULT_LABELS as L
from polylabel.sources import readers as R


def clean_all(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return [r[0] for r in df.select(TF.clean_text("text")).collect()]


def test_placeholders_after_whitespace(spark):
    got = clean_all(spark, ["[NAME] hi", "[NAME] [NAME]", "a  [USER]", "x [URL] y", None, "   "])
    assert got == [" hi", " ", "a ", "x  y", "", ""]


def test_normalize_after_option(spark):
    df = spark.createDataFrame([("x [URL] y",)], "text string")
    assert df.select(TF.clean_text("text", normalize_after=True)).first()[0] == "x y"


def test_emoji_definition(spark):
    removed = ["\U0001F600", "\U0001F1EB\U0001F1F7", "1️⃣", "#⃣",
               "\U0001F468‍\U0001F469‍\U0001F467", "\U0001F44D\U0001F3FD",
               "©", "®", "™", "‼", "ℹ️", "❤️"]
    got = clean_all(spark, [f"a{e}b" for e in removed])
    assert got == ["ab"] * len(removed)
    kept = clean_all(spark, ["1", "#", "été", "a — b"])
    assert kept == ["1", "#", "été", "a — b"]


def test_python_whitespace_set(spark):
    ws = ["\u0085", " ", " ", "　", "\x1c", "\x1d", "\x1e", "\x1f", "\t", "\n", "\x0b", "\x0c"]
    got = clean_all(spark, [f" a{w}{w}b{w}" for w in ws])
    assert got == ["a b"] * len(ws)


def test_word_tokens(spark):
    df = spark.createDataFrame([("The cat, THE dog  is ok",)], "text string")
    assert df.select(TF.word_tokens("text")).first()[0] == ["the", "cat,", "the", "dog"]


def test_multihot_from_ids(spark):
    df = spark.createDataFrame([([2, 27],), ([27],), ([13, 26, 9],), (None,)], "labels array<int>")
    cols = LF.multihot_from_ids("labels", R.LIST_CLASS_MAP)
    got = [tuple(r) for r in df.select(*[cols[n] for n in L.names]).collect()]
    assert got == [(1, 0, 0, 0, 0), (0, 0, 0, 0, 0), (0, 0, 1, 1, 1), (0, 0, 0, 0, 0)]


def test_list_corpus_drops_unlabelled_keeps_empty_text(spark):
    df = spark.createDataFrame([("", [2]), ("hi", [27]), (None, [14])], "text string, labels array<int>")
    out = R.map_list_corpus(df).select("text", *L.names).collect()
    assert [tuple(r) for r in out] == [("", 1, 0, 0, 0, 0), ("", 0, 1, 0, 0, 0)]


def test_single_corpus_love_has_no_label(spark):
    df = spark.createDataFrame([("a", 2), ("b", 1), ("   ", 3), ("c", 3)], "text string, label int")
    out = [tuple(r) for r in R.map_single_corpus(df).select("text", *L.names).collect()]
    assert out == [("a", 0, 0, 0, 0, 0), ("b", 0, 0, 1, 0, 0), ("c", 1, 0, 0, 0, 0)]
    out2 = [tuple(r) for r in R.map_single_corpus(df, love_to_joy=True).select("text", *L.names).collect()]
    assert out2[0] == ("a", 0, 0, 1, 0, 0)


def test_label_strings_and_threshold(spark):
    df = spark.createDataFrame([(1, 0, 1, 0.5, 0.50001)], "a int, b int, c int, p double, q double")
    r = df.select(LF.label_string(["a", "b", "c"], ["x", "y", "z"]).alias("s"),
                  LF.label_string(["b"], ["y"], empty="none").alias("e"),
                  LF.threshold("p").alias("tp"), LF.threshold("q").alias("tq")).first()
    assert (r["s"], r["e"], r["tp"], r["tq"]) == ("x, z", "none", 0, 1)


def test_decode_ids(spark):
    df = spark.createDataFrame([(1, "t", [2, 27])], "row_id long, text string, labels array<int>")
    assert R.decode_examples(df).first()["class_names"] == ["anger", "neutral"]


def test_missing_columns_error(spark):
    from polylabel.schema import MissingColumnsError, require_columns
    df = spark.createDataFrame([("t",)], "text string")
    with pytest.raises(MissingColumnsError, match="anger"):
        require_columns(df, ["text", "anger", "fear"])


def test_signs_that_are_no_emoji_stay(spark):
    keep = "\u2192 \u2605 \u2713 \u2318 \u25b2 1 # *"
    drop = "\u2714\ufe0f \u2b50 \U0001f3f4\U000e0067\U000e0062\U000e007f \U0001f1e9\U0001f1ea 1\ufe0f\u20e3 \U0001f44d\U0001f3fd"
    row = spark.createDataFrame([(keep, drop)], "a string, b string").select(
        TF.clean_text("a").alias("a"), TF.clean_text("b").alias("b")).first()
    assert row.a == keep and row.b == ""


def test_cleaning_scans_give_what_the_long_patterns_gave(spark):
    """Every kind of white space and emoji, alone and in runs; a single plain
    space is no match."""
    import random
    import re

    from pyspark.sql import functions as F

    from polylabel.functions import text as TF
    emoji = TF._emoji_class()
    long = (r"(?:[\x{1F1E6}-\x{1F1FF}]{2}|[0-9#*]\x{FE0F}?\x{20E3}|[" + emoji + r"][\x{FE0F}\x{FE0E}\x{200D}"
            r"\x{1F3FB}-\x{1F3FF}\x{E0020}-\x{E007F}]*)+")
    space = [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    near = [0x200B, 0x180E, 0xFEFF, 0x2010, 0x21, 0x61, 0x41]
    signs = [0x31, 0x23, 0x2A, 0xFE0F, 0x20E3, 0x1F1E6, 0x1F1FF, 0xA9, 0xAE, 0x203C, 0x2192, 0x2714, 0x3299, 0x329A, 0x1F004, 0x1F600, 0x1F3FB, 0x200D, 0xE0020, 0x1FAF8, 0x1FAFF]
    signs += [int(x, 16) for r in TF.EMOJI_POINTS.split() for x in r.split("-")]
    r = random.Random(3)
    rows = [(chr(c),) for c in space + near + signs] + [("".join(chr(r.choice(r.choice([space, near, signs, [32]]))) for _ in range(r.randint(0, 14))),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "t string").select(
        "t", F.regexp_replace("t", long, "").alias("e0"), TF.strip_emoji("t").alias("e1"),
        F.trim(F.regexp_replace("t", TF.WHITESPACE_RUN, " ")).alias("s0"), TF.collapse_whitespace("t").alias("s1"), F.regexp_count("t", F.lit(TF.ODD_RUN)).alias("n"))
    got = df.collect()
    assert all(r.e0 == r.e1 and r.s0 == r.s1 for r in got)
    assert {r.n for r in got if re.fullmatch("[a!]?( [a!])* ?", r.t)} == {0}
