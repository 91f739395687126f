"""Structured personal data: identity cards, e-mail addresses, phones, bank cards, word lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.config import PIIConfig
from vellum.functions.text import bound

#: The patterns; digits and blanks are those of Unicode.
ID_CARD = r"(?U)(?<!\d)[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx](?!\d)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?U)(?<!\d)(?:\+?86[-\s]?)?1[3-9]\d[-\s]?\d{4}[-\s]?\d{4}(?!\d)"
BANK_CARD = r"(?U)(?<!\d)\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}(?:[-\s]?\d{1,3})?(?!\d)"
#: A card without separators, which is a card whatever short number comes after it.
CARD_RUN = r"(?U)(?<!\d)\d{16,19}(?!\d)"
#: EMAIL for one pass over a text: a match begins where its run of characters does, or after the match before.
#: Elsewhere in a run nothing else could match, and trying would cost a run's length squared.
EMAIL_ONCE = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
#: Two characters of private use that are put around matches; a text that has them goes another way.
MARK = "\ue0f3\uf8c1"
#: The ten decimal digits of other scripts that a text may hold.
FULLWIDTH, ASCII = "０１２３４５６７８９", "0123456789"

RECORD = "struct<kind:string,method:string,placeholder:string,count:int>"


def digits_of(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, FULLWIDTH, ASCII), "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    backward = F.split(F.reverse(digits), r"(?!^)(?!\z)")
    doubled = F.transform(backward, lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def phone_holds(found: Column) -> Column:
    """Eleven digits of a mobile number once separators and a country code are off."""
    bare = F.regexp_replace(found, r"(?U)[-\s]", "")
    return F.regexp_replace(bare, r"^\+?86", "").rlike(r"(?U)^1[3-9]\d{9}$")


def replaced(text: Column, pattern: str, placeholder: str, holds=None) -> Column:
    """struct<text, n>: matches that hold (all, if ``holds`` is None) replaced and counted.

    A text without a match is gone over once and kept as it is.  Else matches are marked in one
    pass, and the marked text's odd parts are matches.
    """
    marked = F.regexp_replace(text, f"(?:{pattern})", MARK + "$0" + MARK)
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # One gap more than there are matches; this way is only for texts that have the mark themselves.
    apart = F.flatten(F.zip_with(gaps, found, lambda g, m: F.when(m.isNull(), F.array(g)).otherwise(F.array(g, m))))
    parts = F.when(text.contains(MARK), apart).otherwise(F.split(marked, MARK, -1))
    fits = (lambda m: F.lit(True)) if holds is None else holds
    done = F.transform(parts, lambda p, i: F.when((i % 2 == 1) & fits(p), F.struct(F.lit(placeholder).alias("t"), F.lit(1).alias("n"))).otherwise(F.struct(p.alias("t"), F.lit(0).alias("n"))))
    told = F.transform(F.array(done), lambda z: F.struct(F.array_join(z["t"], "").alias("text"), F.aggregate(z["n"], F.lit(0), lambda a, x: a + x).alias("n")))[0]
    return F.when(text.rlike(pattern), told).otherwise(F.struct(text.alias("text"), F.when(text.isNotNull(), 0).alias("n")))


def replaced_cards(text: Column, placeholder: str) -> Column:
    """As ``replaced``: digits in one run first, as BANK_CARD would take a number of up to three digits behind 16 as the card's own; then the forms with separators."""
    holds = lambda m: luhn(digits_of(m))
    second = lambda r: F.struct(replaced(r["text"], BANK_CARD, placeholder, holds).alias("s"), r["n"].alias("n"))
    return bound(bound(replaced(text, CARD_RUN, placeholder, holds), second), lambda r: F.struct(r["s"]["text"].alias("text"), (r["s"]["n"] + r["n"]).alias("n")))


def stage(state: Column, kind: str, pattern: str | None, placeholder: str, holds=None, method: str = "regex") -> Column:
    """One redaction step over struct<text, records>; without a pattern, that of bank cards."""
    found = lambda text: replaced_cards(text, placeholder) if pattern is None else replaced(text, pattern, placeholder, holds)
    done = F.transform(F.array(state), lambda s: F.struct(found(s["text"]).alias("r"), s["records"].alias("records")))
    record = lambda n: F.struct(F.lit(kind).alias("kind"), F.lit(method).alias("method"), F.lit(placeholder).alias("placeholder"), n.alias("count"))
    return F.transform(done, lambda s: F.struct(s["r"]["text"].alias("text"), F.when(s["r"]["n"] > 0, F.concat(s["records"], F.array(record(s["r"]["n"])))).otherwise(s["records"]).alias("records")))[0]


def redact_structured(text: Column, config: PIIConfig = PIIConfig()) -> Column:
    """struct<text, records>: identity card, e-mail, phone, bank card, in this order; a record only where something was found."""
    state = F.struct(text.alias("text"), F.expr(f"cast(array() as array<{RECORD}>)").alias("records"))
    steps = (
        (config.id_card, "id_card", ID_CARD, config.id_card_placeholder, None), (config.email, "email", EMAIL_ONCE, config.email_placeholder, None),
        (config.phone, "phone", PHONE, config.phone_placeholder, phone_holds),
        (config.bank_card, "bank_card", None, config.bank_card_placeholder, None),
    )
    for on, kind, pattern, placeholder, holds in steps:
        if on:
            state = stage(state, kind, pattern, placeholder, holds)
    return state


def occurrences(text: Column, word: Column, size) -> Column:
    return ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / size).cast("int")


def replace_words(text: Column, words: list[str], placeholder: str) -> Column:
    """struct<text, n>: literal words, longest first, one after another, so later ones see earlier placeholders."""

    def step(word: str):
        return lambda s: F.struct(F.replace(s["text"], F.lit(word), F.lit(placeholder)).alias("text"), (s["n"] + occurrences(s["text"], F.lit(word), len(word))).alias("n"))

    state = F.struct(text.alias("text"), F.lit(0).alias("n"))
    for word in sorted((w for w in words if w), key=len, reverse=True):
        state = bound(state, step(word))
    return state


def replace_listed(text: Column, names: Column, placeholder: Column | str) -> Column:
    """As ``replace_words`` with the words in an array column."""
    mark = F.lit(placeholder) if isinstance(placeholder, str) else placeholder
    order = F.array_sort(F.filter(names, lambda w: w != ""), lambda a, b: F.length(b) - F.length(a))
    start = F.struct(text.alias("text"), F.lit(0).alias("n"))
    return F.aggregate(order, start, lambda s, w: F.struct(F.replace(s["text"], w, mark).alias("text"), (s["n"] + occurrences(s["text"], w, F.length(w))).alias("n")))


def redact_entities(text: Column, persons: Column, orgs: Column, config: PIIConfig = PIIConfig()) -> Column:
    """struct<text, records>: detected persons, then organisations, by their lists."""

    def step(kind: str, names: Column, mark: str):
        def replaced_names(s: Column) -> Column:
            return F.struct(replace_listed(s["text"], names, mark).alias("r"), s["records"].alias("records"))

        def recorded(s: Column) -> Column:
            record = F.struct(F.lit(kind).alias("kind"), F.lit("llm").alias("method"), F.lit(mark).alias("placeholder"), s["r"]["n"].alias("count"))
            return F.struct(s["r"]["text"].alias("text"), F.when(s["r"]["n"] > 0, F.concat(s["records"], F.array(record))).otherwise(s["records"]).alias("records"))

        return lambda state: bound(bound(state, replaced_names), recorded)

    state = F.struct(text.alias("text"), F.expr(f"cast(array() as array<{RECORD}>)").alias("records"))
    for on, kind, names, mark in ((config.person_name, "person_name", persons, config.person_placeholder), (config.org_name, "org_name", orgs, config.org_placeholder)):
        if on:
            state = step(kind, names, mark)(state)
    return state


def redact_custom(text: Column, words: tuple[tuple[str, str], ...], default: str = PIIConfig.custom_placeholder) -> Column:
    """struct<text, counts map>: custom (word, code) pairs, longest first across codes; counts by placeholder."""
    order = sorted(((w, c or default) for w, c in words if w), key=lambda p: len(p[0]), reverse=True)

    def step(word: str, code: str):
        def run(s: Column) -> Column:
            n = occurrences(s["text"], F.lit(word), len(word))
            total = F.coalesce(F.try_element_at(s["counts"], F.lit(code)), F.lit(0)) + n
            rest = F.map_filter(s["counts"], lambda k, v: k != code)
            counts = F.when(n > 0, F.map_concat(rest, F.create_map(F.lit(code), total))).otherwise(s["counts"])
            return F.struct(F.replace(s["text"], F.lit(word), F.lit(code)).alias("text"), counts.alias("counts"))

        return run

    state = F.struct(text.alias("text"), F.expr("cast(map() as map<string,int>)").alias("counts"))
    for word, code in order:
        state = bound(state, step(word, code))
    return state


def cloud_blocked(persons_on: bool, orgs_on: bool, lexicon_missing: Column, block: bool) -> Column:
    """Whether cloud steps are left out: entities are asked for but could not be detected."""
    return lexicon_missing & F.lit((persons_on or orgs_on) and block)


def phase_on(enable: Column, n_custom: Column) -> Column:
    return enable | (n_custom > 0)
