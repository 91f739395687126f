import pytest
from pyspark.sql import functions as F

from vellum.config import PIIConfig
from vellum.functions import pii


def redact(spark, text, config=PIIConfig()):
    row = spark.createDataFrame([(text,)], "t string").select(pii.redact_structured(F.col("t"), config).alias("r")).first().r
    return row.text, {x.kind: x["count"] for x in row.records or []}


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("13812345678", {"phone": 1}), ("+8613912345678", {"phone": 1}), ("139 1234 5678", {"phone": 1}), ("编号2013912345678号", {}),
        ("user@example.com test.user@mail.example.co.jp", {"email": 2}), ("110101199003071234 11010119900307123X", {"id_card": 2}),
        ("4539148803436467", {"bank_card": 1}), ("4539 1488 0343 6467", {"bank_card": 1}), ("1234567890123456", {}),
        ("110101199003071234 和 4539148803436467", {"id_card": 1, "bank_card": 1}), ("", {}), ("139　1234　5678", {"phone": 1}),
    ],
)
def test_kinds(spark, text, kinds):
    out, found = redact(spark, text)
    assert found == kinds and (out == text) == (not kinds)


def test_switches_and_placeholder(spark):
    assert redact(spark, "13812345678", PIIConfig(phone=False)) == ("13812345678", {})
    assert redact(spark, "13812345678", PIIConfig(phone_placeholder="<$1>"))[0] == "<$1>"


def test_null_text(spark):
    assert redact(spark, None)[0] is None


def test_words(spark):
    df = spark.createDataFrame([("张三丰和张三",)], "t string")
    row = df.select(pii.replace_words(F.col("t"), ["张三", "张三丰", ""], "[人名]").alias("r")).first().r
    assert row.text == "[人名]和[人名]" and row.n == 2
    row = df.select(pii.replace_listed(F.col("t"), F.array(F.lit("张三"), F.lit("张三丰")), "[人名]").alias("r")).first().r
    assert row.text == "[人名]和[人名]" and row.n == 2


def test_custom_words(spark):
    df = spark.createDataFrame([("alpha alphabet beta",)], "t string")
    row = df.select(pii.redact_custom(F.col("t"), (("alpha", "[A]"), ("alphabet", "[B]"), ("beta", ""))).alias("r")).first().r
    assert row.text == "[A] [B] [敏感词]" and row.counts == {"[A]": 1, "[B]": 1, "[敏感词]": 1}


def test_later_words_see_placeholders(spark):
    row = spark.createDataFrame([("longer",)], "t string").select(pii.redact_custom(F.col("t"), (("longer", "[x]"), ("x", "[y]"))).alias("r")).first().r
    assert row.text == "[[y]]"


def test_addresses_in_linear_time(spark):
    """A long run of characters without a sign costs its length, with one too."""
    import time

    from vellum.functions.pii import EMAIL

    long = "x" * 1_000_000
    df = spark.createDataFrame([(long,), (long + "@",), ("a@" + long,), (f"{long}@{'y' * 1000}.com",)], "t string").cache()
    df.count()
    one = df.select(pii.replaced(F.col("t"), pii.EMAIL_ONCE, "[m]").alias("r"))
    one.limit(1).collect()
    began = time.perf_counter()
    assert [r.r.n for r in one.collect()] == [0, 0, 0, 1]
    assert time.perf_counter() - began < 8  # four texts of a megabyte
    assert EMAIL != pii.EMAIL_ONCE


def test_replaced_against_plain(spark):
    """Every pattern on noise, with texts that hold the mark themselves."""
    import random
    import re

    rng = random.Random(5)
    plain = {
        "email": (pii.EMAIL_ONCE, pii.EMAIL, None), "phone": (pii.PHONE, pii.PHONE.replace("(?U)", ""), lambda m: bool(re.fullmatch(r"(\+?86)?1[3-9]\d{9}", re.sub(r"[-\s]", "", m)))),
        "card": (pii.BANK_CARD, pii.BANK_CARD.replace("(?U)", ""), None), "id": (pii.ID_CARD, pii.ID_CARD.replace("(?U)", ""), None),
    }
    pieces = ["a.b", "@", "x.com", ".", " ", "-", "+86", "138", "1234", "5678", "110105", "19491231", "002X", "4539", "9", "%", "é", "", pii.MARK, "@b.co", "a@b.cd"]
    texts = [("".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))),) for _ in range(1500)]
    df = spark.createDataFrame(texts, "t string")
    for name, (pattern, python, holds) in plain.items():
        holds_column = pii.phone_holds if name == "phone" else None
        got = df.select("t", pii.replaced(F.col("t"), pattern, "[$1]", holds_column).alias("r")).collect()
        for r in got:
            n = 0

            def one(m):
                nonlocal n
                ok = holds is None or holds(m[0])
                n += ok
                return "[$1]" if ok else m[0]

            assert (re.sub(python, one, r.t), n) == (r.r.text, r.r.n), (name, r.t)


@pytest.mark.parametrize(
    ("text", "want", "n"),
    [
        ("4451718024887799 27.65.93.188", "[C] 27.65.93.188", 1), ("4495589438270767 42.73.240.87", "[C] 42.73.240.87", 1),
        ("4539 1488 0343 6467 and 4539148803436467-1", "[C] and [C]-1", 2), ("1234567890123456 27", "1234567890123456 27", 0), (None, None, None),
    ],
)
def test_a_number_behind_a_card(spark, text, want, n):
    row = spark.createDataFrame([(text,)], "t string").select(pii.replaced_cards(F.col("t"), "[C]").alias("r")).first().r
    assert (row.text, row.n) == (want, n)
    config = PIIConfig(bank_card_placeholder="[C]", phone=False)
    assert redact(spark, text, config) == (want, {"bank_card": n} if n else {})
