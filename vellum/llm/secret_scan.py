"""Secret scan, DataFrame functions only: fixed patterns plus a randomness test battery.

Long unbroken tokens are candidates.  Their encoding is inferred (hex, base32, base64);
chi-squared uniformity over that alphabet, a runs test about its middle and lag-1 serial
correlation give three p-values under "random", joined by Fisher's method.  Within each
stratum of encoding and length band, Benjamini-Hochberg over the whole corpus decides
which candidates are rejected as not random; the rest are reported.  What is controlled is the
share of random tokens among those rejected: a report is a token that randomness can't be denied.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import written

#: Patterns, in the order in which kinds are listed.
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
#: As PATTERNS, but only the matches long enough, so that most texts stop here.
GATES = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}""",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
    "random": r"[A-Za-z0-9+/_-]{20}",
}
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: As PATTERNS, but matches too short are passed over at once: what they would use up holds no longer match.
FIND = PATTERNS | {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
FALSE_DISCOVERY = 0.05
BINS, STEP = 140, 0.05  # p-values are held on a grid of 0.05 in -log10 p, down to 1e-7
BANDS = (28, 36, 48, 72, 128)


def spans(text: Column, pattern: str, keep, group: int = 0) -> Column:
    """array<struct<start,end,tok>> of the leftmost non-overlapping matches that ``keep`` accepts.

    Gaps and matches alternate, so starts are sums of lengths in code points; block sums
    keep that at n * sqrt(n) for a text with n matches.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def laid(z: Column) -> Column:
        n = F.size(z["found"])
        lens = F.zip_with(F.slice(z["gaps"], 1, n), z["found"], lambda g, m: F.length(g) + F.length(m))
        return F.struct(z["gaps"].alias("gaps"), z["found"].alias("found"), z["kept"].alias("kept"), lens.alias("lens"), F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int")).alias("b"))

    def blocks(z: Column) -> Column:
        count = F.ceil(F.size(z["lens"]) / z["b"]).cast("int")
        sums = F.transform(F.sequence(F.lit(0), count), lambda k: total(F.slice(z["lens"], k * z["b"] + 1, z["b"])))
        return F.struct(*[z[c].alias(c) for c in ("gaps", "found", "kept", "lens", "b")], sums.alias("sums"))

    def starts(z: Column) -> Column:
        before = F.transform(F.sequence(F.lit(0), F.size(z["sums"]) - 1), lambda k: total(F.slice(z["sums"], 1, k)))
        return F.struct(*[z[c].alias(c) for c in ("gaps", "found", "kept", "lens", "b")], before.alias("before"))

    def rows(z: Column) -> Column:
        def row(m: Column, i: Column) -> Column:
            k = F.floor(i / z["b"]).cast("int")
            at = F.get(z["before"], k) + total(F.slice(z["lens"], k * z["b"] + 1, i - k * z["b"])) + F.length(F.get(z["gaps"], i))
            return F.struct(at.alias("start"), (at + F.length(m)).alias("end"), F.get(z["kept"], i).alias("tok"))

        return F.filter(F.transform(z["found"], row), lambda s: keep(s["tok"]))

    # transform over one-element arrays binds each step once, so that nothing is computed twice.
    one = F.array(F.struct(gaps.alias("gaps"), found.alias("found"), kept.alias("kept")))
    return F.flatten(reduce(F.transform, (laid, blocks, starts, rows), one))


def encoding(tok: Column) -> Column:
    """Inferred encoding of a token, or null where it is not a candidate."""
    n = F.length(tok)
    return (
        F.when((n >= 24) & tok.rlike("^([0-9a-f]+|[0-9A-F]+)$") & tok.rlike("[0-9]") & tok.rlike("[A-Fa-f]"), F.lit("hex"))
        .when((n >= 24) & tok.rlike("^[A-Z2-7]+$") & tok.rlike("[2-7]") & tok.rlike("[A-Z]"), F.lit("base32"))
        .when((n >= 20) & tok.rlike("[0-9]") & tok.rlike("[A-Z]") & tok.rlike("[a-z]"), F.lit("base64"))
    )


def band(n: Column) -> Column:
    return sum(((n >= x).cast("int") for x in BANDS), F.lit(0))


def let(value: Column, f) -> Column:
    """f(value), value worked out once however often f names it."""
    return F.transform(F.array(value), f)[0]


def upper_tail(z: Column) -> Column:
    """P(Z > z), by a five-term polynomial for erfc."""

    def tail(z: Column) -> Column:
        x = F.abs(z) / F.lit(2.0**0.5)

        def beyond(t: Column) -> Column:
            q = 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
            return let(q, lambda q: F.greatest(F.lit(1e-7), F.when(z >= 0, q).otherwise(1 - q)))

        return let(1 / (1 + 0.3275911 * x), beyond)

    return let(z, tail)


def randomness_bin(tok: Column, kind: Column) -> Column:
    """Grid cell of -log10 of the joint p-value under "drawn at random from its alphabet"."""
    alphabet = F.when(kind == "hex", ALPHABETS["hex"]).when(kind == "base32", ALPHABETS["base32"]).otherwise(ALPHABETS["base64"])
    plain = F.when(kind == "hex", F.lower(tok)).when(kind == "base32", tok).otherwise(F.translate(tok, "-_", "+/"))
    codes = F.transform(F.split(plain, r"(?!^)(?!\z)"), lambda c: F.instr(alphabet, c) - 1)
    add = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda s, x: s + f(x))

    def counted(z: Column) -> Column:
        """Sums over the token's symbols, and over neighbours."""
        c, k = z["codes"], z["k"]
        pairs = F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        squares = add(F.array_distinct(c), lambda x: F.pow(F.size(F.filter(c, lambda y: y == x)).cast("double"), F.lit(2.0)))
        return F.struct(
            c.alias("c"), k.alias("k"), F.size(c).cast("double").alias("n"), pairs.alias("pairs"), squares.alias("squares"),
            add(c, lambda x: (x >= k / 2).cast("double")).alias("high"), (add(c, lambda x: x.cast("double")) / F.size(c)).alias("mu"),
        )

    def measured(z: Column) -> Column:
        """The three statistics, as normal deviates or null where a test can't be made."""
        n, k, high, low = z["n"], z["k"], z["high"], z["n"] - z["high"]
        chi, df = k / n * z["squares"] - n, k - 1
        wilson = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        runs = 1 + add(z["pairs"], lambda p: ((p["a"] >= k / 2) != (p["b"] >= k / 2)).cast("double"))
        mean = 1 + 2 * high * low / n
        spread = F.sqrt(F.greatest(F.lit(1e-9), (mean - 1) * (mean - 2) / (n - 1)))
        var = add(z["c"], lambda x: (x - z["mu"]) * (x - z["mu"]))
        cov = add(z["pairs"], lambda p: (p["a"] - z["mu"]) * (p["b"] - z["mu"]))
        return F.struct(
            wilson.alias("chi"), F.when((high > 0) & (low > 0), F.abs(runs - mean) / spread).alias("runs"),
            let(var, lambda v: F.when(v > 0, F.abs(cov / v + 1 / n) * F.sqrt(n))).alias("serial"),
        )

    def joined(z: Column) -> Column:
        both = lambda d: F.coalesce(F.least(F.lit(1.0), 2 * upper_tail(d)), F.lit(1e-7))
        x = -(F.log(upper_tail(z["chi"])) + F.log(F.when(z["runs"].isNull(), F.lit(1e-7)).otherwise(both(z["runs"]))) + F.log(F.when(z["serial"].isNull(), F.lit(1e-7)).otherwise(both(z["serial"]))))
        joint = lambda x: F.exp(-x) * (1 + x + x * x / 2)
        return let(x, lambda x: F.least(F.lit(BINS), F.floor(-F.log10(F.greatest(F.lit(1e-7), joint(x))) / STEP)).cast("int"))

    k = F.when(kind == "hex", 16.0).when(kind == "base32", 32.0).otherwise(64.0)
    return let(let(let(F.struct(codes.alias("codes"), k.alias("k")), counted), measured), joined)


def random_spans(text: Column) -> Column:
    """Candidates: array<struct<start,end,kind,band,bin>>."""
    found = spans(text, TOKEN, lambda tok: F.lit(True))
    full = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), encoding(s["tok"]).alias("kind"), band(F.length(s["tok"])).alias("band"), s["tok"].alias("tok")))
    kept = F.filter(full, lambda s: s["kind"].isNotNull())
    return F.transform(kept, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", "kind", "band")], randomness_bin(s["tok"], s["kind"]).alias("bin")))


def rejection_bins(candidates: DataFrame, rate: float = FALSE_DISCOVERY) -> dict[tuple[str, int], int]:
    """Per stratum, the lowest grid cell whose candidates are rejected as not random.

    candidates: (kind, band, bin) rows.  They are counted first, so at most
    3 encodings x 6 bands x 141 cells go on; at most 18 rows reach the driver.
    """
    from pyspark.sql import Window

    cells = candidates.groupBy("kind", "band", "bin").agg(F.count("*").alias("n"))
    stratum = Window.partitionBy("kind", "band")
    cut = (
        cells.withColumn("below", F.sum("n").over(stratum.orderBy(F.desc("bin"))))
        .withColumn("all", F.sum("n").over(stratum))
        .where(F.pow(F.lit(10.0), -F.col("bin") * STEP) <= rate * F.col("below") / F.col("all"))
        .groupBy("kind", "band")
        .agg(F.min("bin").alias("cut"))
    )
    return {(r["kind"], r["band"]): r["cut"] for r in cut.collect()}


def scanned(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, assign, access, hex, random): the base spans and the candidates of every row, from one pass over its text."""
    out = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    nothing = F.expr("cast(array() as array<struct<start:int,end:int,kind:string,band:int,bin:int>>)")
    empty = F.expr("cast(array() as array<struct<start:int,end:int,tok:string>>)")
    found = []
    for kind, pattern in FIND.items():
        least, group = LEAST[kind], 2 if kind == "assign" else 0
        # A gate accepts whatever its pattern keeps.
        kept = F.when(F.col("text").rlike(GATES[kind]), spans(F.col("text"), pattern, lambda t, least=least: F.length(t) >= least, group)).otherwise(empty)
        found.append(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(kind))
    random = F.when(F.col("text").rlike(GATES["random"]), random_spans(F.col("text"))).otherwise(nothing)
    return out.select("doc_id", *found, random.alias("random"))


def scan_secrets(docs: DataFrame, rate: float = FALSE_DISCOVERY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, found.

    Null text counts as empty: no spans, the digest of the empty string.  Texts of any length
    are read whole; an empty table gives no rows.  Repeated rows give repeated results, and
    each of them counts where candidates are judged; other columns are not used.  Candidates
    that a base span touches are judged but not listed again.  Spans of one start stand by
    kind.  found: array of (start, kind, end).  What the pass over the texts finds, without
    texts, is stored and read again once the corpus has been judged.
    """
    rows = written(scanned(docs, doc_id, text), "spans")
    cuts = rejection_bins(rows.select(F.explode("random").alias("c")).select("c.kind", "c.band", "c.bin"), rate)
    cut = lambda s: reduce(lambda e, kv: e.when((s["kind"] == kv[0][0]) & (s["band"] == kv[0][1]), F.lit(kv[1])), cuts.items(), F.when(F.lit(False), F.lit(0))).otherwise(F.lit(BINS + 1))
    touched = lambda s: F.exists(F.concat(*map(F.col, PATTERNS)), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    out = rows.withColumn("random", F.filter("random", lambda s: (s["bin"] < cut(s)) & ~touched(s)))
    order = list(PATTERNS) + ["random"]
    named = lambda kind: F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(order.index(kind)).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))
    joined = lambda xs: F.array_join(F.transform(F.array_sort(xs), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.concat(*[named(k) for k in PATTERNS])
    every = F.concat(base, named("random"))
    return out.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(every).alias("spans"),
        F.transform(F.array_sort(every), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("found"),
    )
