"""Operators on documents against plain versions, on edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import bpe, license_scan, near_dedup, packing, pii_scan, secret_scan

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, spans string, kept string, ids string, length string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, rows):
    """Documents with further columns whose names clash with results'."""
    return spark.createDataFrame([(i, t, None, "s", None, "x", "x", "x", "x", "x") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def real(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


EDGE = [(-1, None), (-2, ""), (-3, " \n\t"), (-4, "x" * 50_000), (-5, "ab " * 30_000), (-6, "é😀 ñ"), (-7, "same text here as there again"), (-8, "same text here as there again"), (-7, "same text here as there again")]


def pairs_of(df, *columns):
    return sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))


# License scan


def test_license_base_against_plain(spark, real):
    rows = real + EDGE + [(-9, "Under the MIT License, under the mit license! Apache License, Version 2.0. CC BY-NC 4.0"), (-10, "GNU General Public License, either version 3"), (-11, "gnu general private license version 3")]
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def plain(text):
        words = word.findall((text or "").translate(LOWER))
        places = [(k, label) for phrase, label in license_scan.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        return len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places}))

    got = license_scan.scan_licenses(documents(spark, rows))
    assert pairs_of(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(repr((i, *plain(t))) for i, t in rows)
    labels = {r.doc_id: r for r in got.collect()}
    assert labels[-10].labels == "gpl-3" and labels[-11].labels == "" and labels[-11].score == 0 and 0 < labels[-9].score <= 1
    assert set(labels[-9].labels.split(",")) >= {"mit", "apache-2", "cc-by-nc"}


def test_template_markup():
    a = license_scan.compile_template("x", "one two <<beginOptional>>three <<var;max=2>> four<<endOptional>> five")
    ends = lambda t: a.end_of_match(license_scan.words_of(t), 0)
    assert ends("one two five") == 3 and ends("one two three four five") == 5 and ends("one two three a b four five") == 7
    assert ends("one two three a b c four five") is None and ends("one two six") is None and ends("one two") is None
    with pytest.raises(ValueError, match="mandatory"):
        license_scan.compile_template("x", "<<var;max=1>> a b")


LICENSES = {
    "mit": """MIT License  Copyright (c) 2019 Some One. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL {holder} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "apache-2": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a
copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License
is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License.""",
    "bsd-3": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form
must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. 3. Neither the name of {holder} nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {holder} BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA,
OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}


def test_whole_licenses(spark):
    """Replaceable parts may be anything, mandatory wording nothing else; names need their context."""
    texts, want = [], []
    for label, body in LICENSES.items():
        for holder in ("THE AUTHORS", "the Example Project, its heirs and all who helped"):
            texts.append(f"word {body.format(holder=holder)} word")
            want.append(label)
        texts.append(body.format(holder="one two three four five six seven eight nine ten eleven twelve thirteen"))
        want.append(None if "{holder}" in body else label)
        texts.append(body.format(holder="X").replace("OTHER", "ANOTHER").replace("specific", "general"))
        want.append(None)
    texts += [
        "Creative Commons Attribution-NonCommercial 4.0 International License", "we went cc by sa train", "under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
        "Licensed under CC BY-SA", "cc by sa 4.0", "creative commons attribution non commercial rules", "cc by 4.0 license",
    ]
    want += ["cc-by-nc", None, "cc-by-nc-sa", "cc-by-sa", "cc-by-sa", None, "cc-by"]
    got = {r.doc_id: r for r in license_scan.scan_licenses(documents(spark, list(enumerate(texts)))).collect()}
    for i, label in enumerate(want):
        found = {m.label for m in got[i].matches if m.end - m.start > 60} if texts[i].count(" ") > 60 else set(got[i].labels.split(",")) - {""}
        assert found == ({label} if label else set()), texts[i][:60]


def test_nothing_to_scan(spark):
    empty = documents(spark, [(1, "x")]).limit(0)
    assert license_scan.scan_licenses(empty).count() == 0 and pii_scan.scan_pii(empty).count() == 0


# Secrets


def plain_secrets(text):
    patterns = {
        "assign": re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        "access": re.compile(r"AKIA[A-Z0-9]+"), "hex": re.compile(r"[0-9a-f]+"),
    }
    found = []
    for k, (kind, p) in enumerate(patterns.items()):
        for m in p.finditer(text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= (8, 16, 32)[k]:
                found.append((m.start(), k, kind, m.end()))
    return [sum(x[1] == k for x in found) for k in range(3)], ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(found))


def test_secrets_against_plain(spark, real):
    rng = random.Random(4)
    made = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(44))
    rows = real + EDGE + [
        (-9, "😀 Api_Key: 'abcd1234' pAsSwD=short1 password = \"correct.horse\" token=token=abcdefgh"), (-10, "AKIA" + "A1" * 8 + " AKIA12 " + "0f" * 16 + " " + "0f" * 15),
        (-11, f"the blob {made} stands alone"), (-12, "Abcdefghij1" * 4),
    ]
    got = {r.doc_id: r for r in secret_scan.scan_secrets(documents(spark, rows)).collect()}
    for i, text in rows:
        counts, spans = plain_secrets(text)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == counts
        assert got[i].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert set(spans.split(",")) <= set(got[i].spans.split(",")) or not spans
    assert got[-11].spans == "random:9:53" and "random" not in got[-12].spans


def upper_tail(z):
    return max(1e-7, 0.5 * math.erfc(z / math.sqrt(2)))


def plain_bin(kind, token):
    """The battery in plain steps: uniformity, runs about the middle, lag-1 correlation, Fisher's sum."""
    alphabet = secret_scan.ALPHABETS[kind]
    k, plain = len(alphabet), token.lower() if kind == "hex" else token.replace("-", "+").replace("_", "/")
    codes = [alphabet.index(c) for c in plain]
    n, df = len(codes), k - 1
    chi = sum((codes.count(x) - n / k) ** 2 / (n / k) for x in range(k))
    uniform = upper_tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    side = [c >= k / 2 for c in codes]
    high, runs = sum(side), 1 + sum(a != b for a, b in zip(side, side[1:]))
    mean = 1 + 2 * high * (n - high) / n
    spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
    run = 1e-7 if high in (0, n) else min(1.0, 2 * upper_tail(abs(runs - mean) / spread))
    mu = sum(codes) / n
    var, cov = sum((c - mu) ** 2 for c in codes), sum((a - mu) * (b - mu) for a, b in zip(codes, codes[1:]))
    serial = 1e-7 if not var else min(1.0, 2 * upper_tail(abs(cov / var + 1 / n) * math.sqrt(n)))
    x = -math.log(uniform) - math.log(run) - math.log(serial)
    return min(secret_scan.BINS, math.floor(-math.log10(max(1e-7, math.exp(-x) * (1 + x + x * x / 2))) / secret_scan.STEP))


def made_tokens(rng, kind, n, structured):
    """Random tokens of an encoding, or names put together from words."""
    if not structured:
        return "".join(rng.choice(secret_scan.ALPHABETS[kind]) for _ in range(n))
    words = {"hex": ("dead", "beef", "cafe", "0000", "1111", "face", "ffff", "1234"), "base32": ("TABLE", "INDEX", "VALUE", "CASE22", "STATE", "NAME7"), "base64": ("get", "Value", "Index", "user", "Name", "Table", "2", "Count", "List", "by")}
    token = ""
    while len(token) < n:
        token += rng.choice(words[kind])
    return token[:n]


def test_battery_and_cut_against_plain(spark):
    """Cells of every token as in the plain battery; the cut is Benjamini-Hochberg's over them."""
    rng = random.Random(12)
    tokens = [(kind, made_tokens(rng, kind, n, s)) for kind in secret_scan.ALPHABETS for n in (24, 30, 44, 64, 100) for s in (False, True) for _ in range(30)]
    rows = spark.createDataFrame(tokens, "kind string, tok string")
    got = rows.select("kind", "tok", secret_scan.randomness_bin(F.col("tok"), F.col("kind")).alias("bin"), secret_scan.band(F.length("tok")).alias("band")).collect()
    # A p-value on a cell's edge may fall to either side of it.
    assert all(abs(r.bin - plain_bin(r.kind, r.tok)) <= 1 for r in got) and sum(r.bin == plain_bin(r.kind, r.tok) for r in got) > 0.97 * len(got)
    cuts = secret_scan.rejection_bins(spark.createDataFrame([(r.kind, r.band, r.bin) for r in got], "kind string, band int, bin int"))
    for kind, band in {(r.kind, r.band) for r in got}:
        ps = sorted(10 ** (-r.bin * secret_scan.STEP) for r in got if (r.kind, r.band) == (kind, band))
        # Equal p-values are rejected together.
        passed = [p for p in ps if p <= secret_scan.FALSE_DISCOVERY * sum(q <= p for q in ps) / len(ps)]
        assert cuts.get((kind, band)) == (round(-math.log10(max(passed)) / secret_scan.STEP) if passed else None)


def plain_candidates(text):
    """(start, end, kind, band, cell) of every long token that looks encoded."""
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text or ""):
        tok, n = m[0], len(m[0])
        digit, upper, lower = (re.search(p, tok) for p in ("[0-9]", "[A-Z]", "[a-z]"))
        if n >= 24 and re.fullmatch("[0-9a-f]+|[0-9A-F]+", tok) and digit and re.search("[A-Fa-f]", tok):
            kind = "hex"
        elif n >= 24 and re.fullmatch("[A-Z2-7]+", tok) and re.search("[2-7]", tok) and upper:
            kind = "base32"
        elif digit and upper and lower:
            kind = "base64"
        else:
            continue
        yield m.start(), m.end(), kind, sum(n >= b for b in secret_scan.BANDS), plain_bin(kind, tok)


def test_whole_scan_against_plain(spark, real):
    """All spans of the query: candidates, cells, cuts over the corpus, and what base spans leave of them."""
    rng = random.Random(21)
    texts = [" ".join(rng.choice(("word", "é", "x = 1")) + " " + made_tokens(rng, rng.choice(("hex", "base32", "base64")), rng.randint(20, 90), rng.random() < 0.5) for _ in range(rng.randint(0, 4))) for _ in range(300)]
    rows = real + EDGE[:4] + [(-1000 - i, t) for i, t in enumerate(texts)]
    found = [(i, text, list(plain_candidates(text))) for i, text in rows]
    every = [c for _, _, own in found for c in own]
    cuts = {}
    for kind, band in {c[2:4] for c in every}:
        cells = [c[4] for c in every if c[2:4] == (kind, band)]
        passed = [b for b in cells if 10 ** (-b * secret_scan.STEP) <= secret_scan.FALSE_DISCOVERY * sum(x >= b for x in cells) / len(cells)]
        cuts[kind, band] = min(passed, default=secret_scan.BINS + 1)
    got = {r.doc_id: r.spans.split(",") for r in secret_scan.scan_secrets(documents(spark, rows)).collect()}
    wrong = random_spans = 0
    for i, text, own in found:
        _, base = plain_secrets(text)
        taken = [tuple(map(int, s.split(":")[1:])) for s in base.split(",") if s]
        want = {f"random:{s}:{e}" for s, e, kind, band, b in own if b < cuts[kind, band] and not any(x < e and s < y for x, y in taken)}
        have = {s for s in got[i] if s.startswith("random")}
        random_spans += len(want)
        # Only cells beside a cut may fall to its other side, as p-values are by a polynomial.
        near = {f"random:{s}:{e}" for s, e, kind, band, b in own if abs(b - cuts[kind, band]) <= 1}
        wrong += bool((want ^ have) - near)
        assert {s for s in got[i] if s and not s.startswith("random")} == {s for s in base.split(",") if s}
    assert not wrong and random_spans > 100


def test_error_rates_of_the_battery(spark):
    """Random tokens are found, names put together from words mostly aren't; README has the figures."""
    rng = random.Random(13)
    rows, kinds = [], []
    for kind, n in (("hex", 40), ("base32", 40), ("base64", 24), ("base64", 40), ("base64", 64)):
        for s in (False, True):
            for _ in range(200):
                token = made_tokens(rng, kind, n, s)
                if kind == "base64" and not (re.search("[0-9]", token) and re.search("[A-Z]", token) and re.search("[a-z]", token)):
                    continue
                rows.append((len(rows), f"the key {token} stands"))
                kinds.append((kind, n, s))
    got = {r.doc_id: bool(r.spans) for r in secret_scan.scan_secrets(documents(spark, rows)).collect()}
    share = {k: sum(got[i] for i, x in enumerate(kinds) if x == k) / kinds.count(k) for k in set(kinds)}
    print({k: round(v, 3) for k, v in sorted(share.items())})
    assert all(v > 0.9 for (_, _, s), v in share.items() if not s)
    assert all(v < 0.5 for (kind, n, s), v in share.items() if s and kind != "hex" and n >= 40)


def test_base_spans_are_listed_once(spark):
    made = "0123456789abcdef0f1e2d3c4b5a69788796a5b4"
    assert secret_scan.scan_secrets(documents(spark, [(1, f"sha {made} end")])).first().spans == "hex:4:44"


def test_secrets_without_candidates(spark):
    assert secret_scan.scan_secrets(documents(spark, [(1, "plain")])).first().spans == ""
    assert secret_scan.scan_secrets(documents(spark, [(1, "x")]).limit(0)).count() == 0


# Personal data


def plain_pii(text):
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    found = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (12 <= len(digits) <= 19 and pii_scan.luhn(digits))) or (k == 3 and not 9 <= len(digits) <= 15):
                continue
            found.append((m.start(), k, pii_scan.KINDS[k], m.end()))
    return sorted(found)


def test_pii_against_plain(spark, real):
    rng = random.Random(8)
    noise = [(-100 - i, "".join(rng.choice("ab12345678900..@@+--() é😀\n") for _ in range(rng.randint(0, 90)))) for i in range(300)]
    rows = real + EDGE + noise + [(-12, "ab 1.2.3.4 " * 12_000 + "x" * 300_000 + " a.b@c.de")] + [(-9, "a.b@c.de 1.2.3.4 300.1.1.1 4539148803436467 +49 (30) 1234567"), (-10, "call (555) 123-4567 now, or 123-45-6789 later")]
    got = {r.doc_id: r for r in pii_scan.scan_pii(documents(spark, rows)).collect()}
    for i, text in rows:
        want = plain_pii(text)
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(x[1] == k for x in want) for k in range(4)]
        assert got[i].base_sha256 == hashlib.sha256(pii_scan.shown(want).encode()).hexdigest()
        assert not want or set(pii_scan.shown(want).split(",")) <= set(got[i].spans.split(","))
    assert "phone:5:19" in got[-10].spans and "ssn:28:39" in got[-10].spans
    assert not [i for i, t in real if not plain_pii(t) and got[i].spans], "clean documents stay clean"


def test_network_on_unseen_text():
    rng = random.Random(1234)
    texts = [pii_scan.generated(rng) for _ in range(300)]
    hit = made = real = 0
    for (_, spans), found in zip(texts, pii_scan.tagged(pii_scan.network(), [t for t, _ in texts]), strict=True):
        a, b = set(spans), {(s, e, k) for s, e, k, _ in found}
        hit, made, real = hit + len(a & b), made + len(b), real + len(a)
    assert hit / real > 0.8 and hit / made > 0.8


def test_emissions_step_by_step():
    """A bidirectional LSTM in plain steps, character by character, on a padded window."""
    net = pii_scan.network()
    text = "call (555) 123-4567 or a.b@c.de é"
    x = np.zeros((pii_scan.WINDOW, 1), np.intp)
    x[: len(text), 0] = pii_scan.classes(text)
    got = pii_scan.emissions(net, x)[:, :, 0]
    want = np.tile(net.b.astype(float), (len(x), 1))
    half = lambda z: 0.5 * math.tanh(z) + 0.5  # noqa: E731 - weights are of halved sums
    for d in (0, 1):
        h = c = np.zeros(pii_scan.HIDDEN)
        for s in range(len(x)) if d == 0 else range(len(x) - 1, -1, -1):
            z = net.w[d][x[s, 0]] + h @ net.u[d]
            i, f, o, g = (z[k * pii_scan.HIDDEN : (k + 1) * pii_scan.HIDDEN] for k in range(4))
            c = np.array([half(b) * y + half(a) * math.tanh(e) for a, b, e, y in zip(i, f, g, c, strict=True)])
            h = np.array([half(a) * math.tanh(y) for a, y in zip(o, c, strict=True)])
            want[s] += h @ net.a[d]
    assert np.allclose(got, want, atol=1e-3)


def test_viterbi_by_enumeration():
    rng = np.random.default_rng(4)
    for steps in (1, 2, 5):
        e, t = rng.standard_normal((steps, 6, 3)) * 2, rng.standard_normal((3, 3))
        lengths = rng.integers(1, steps + 1, 6)
        got = pii_scan.viterbi(e, t, lengths)
        for b, n in enumerate(lengths):
            ways = itertools.product(range(3), repeat=int(n))
            want = max(ways, key=lambda w, b=b: sum(e[s, b, k] for s, k in enumerate(w)) + sum(t[x, y] for x, y in zip(w, w[1:])))
            assert tuple(got[:n, b]) == want


def test_windows_let_go_never_held_a_span():
    """may_leave lets no window go whose best path has a tag other than 0."""
    rng = np.random.default_rng(9)
    e = rng.standard_normal((20, 4, 400)).astype(np.float32)
    e[:, 0] += rng.uniform(0, 3, 400).astype(np.float32)
    t = (rng.standard_normal((4, 4)) + 2 * np.eye(4)).astype(np.float32)
    kept = pii_scan.may_leave(e, t)
    best = pii_scan.viterbi(np.ascontiguousarray(e.transpose(0, 2, 1)), t)
    assert kept[best.any(axis=0)].all() and not kept.all()


def test_runs_are_decoded_with_what_stands_around_them():
    rng = np.random.default_rng(10)
    t = rng.standard_normal((3, 3))
    runs = [(rng.standard_normal((n, 3)), bool(n % 2), n > 2) for n in (1, 2, 3, 4, 5)]
    for (e, before, after), got in zip(runs, pii_scan.decoded(runs, t), strict=True):
        path = lambda w: [0] * before + list(w) + [0] * after
        want = max(itertools.product(range(3), repeat=len(e)), key=lambda w: sum(e[s, k] for s, k in enumerate(w)) + sum(t[x, y] for x, y in zip(path(w), path(w)[1:])))
        assert tuple(got) == want


def test_tags_hold_across_windows(monkeypatch):
    """The tags of a text decoded in one stretch are those of one Viterbi over all its emissions."""
    net = pii_scan.network()
    rng = random.Random(77)
    text = " ".join(pii_scan.generated(rng)[0] for _ in range(6))
    monkeypatch.setattr(pii_scan, "may_leave", lambda e, t: np.ones(e.shape[2], bool))
    c = pii_scan.classes(text)
    edge, parts, at = (pii_scan.WINDOW - pii_scan.STRIDE) // 2, [], 0
    while True:
        w = np.zeros((pii_scan.WINDOW, 1), np.intp)
        own = c[at : at + pii_scan.WINDOW]
        w[: len(own), 0] = own
        e = pii_scan.emissions(net, w)[:, :, 0]
        last = at + pii_scan.WINDOW >= len(c)
        parts.append(e[0 if at == 0 else edge : len(own) if last else pii_scan.WINDOW - edge])
        if last:
            break
        at += pii_scan.STRIDE
    want = pii_scan.viterbi(np.concatenate(parts)[:, None], net.t)[:, 0]
    got = np.zeros(len(text), int)
    for s, e, tag, _ in pii_scan.tagged(net, [text])[0]:
        got[s:e] = tag
    assert (got == want).all() and want.any()


#: Formats that the generator doesn't make: (kind, text with the span between bars).
UNSEEN = [
    ("phone", "call |(020) 7946 0018| today"), ("phone", "tel |415/555/0132| or"), ("phone", "fax |0301 234 5678| bitte"), ("phone", "ring |(0151) 234-5678| now"),
    ("email", "write to |jane(AT)corp(DOT)org| please"), ("email", "mail |info [ at ] firma [ dot ] de| danke"), ("email", "or |max.muster (at) web (dot) net| ok"),
    ("email", "at |sales <at> shop <dot> com| only"), ("ssn", "number |219.09.9999| of"), ("ssn", "his |078 05 1120| was"),
]


def test_unseen_formats():
    """Recall on formats outside the generator, and precision on numbers that are nothing; README has the figures."""
    net, hit = pii_scan.network(), []
    for lead in ("", "some words before it stand here, ", "der die und " * 9):
        for kind, marked in UNSEEN:
            s, e = marked.index("|"), marked.rindex("|") - 1
            text = lead + marked.replace("|", "") + " and more words follow here."
            found = pii_scan.scan_texts(net, [text])[0][1]
            hit.append(any(x[0] < len(lead) + e and len(lead) + s < x[3] and x[2] == kind for x in found))
    clean = ["in 1984-11-05 at 10:45", "version 2.10.3 of 4.5", "pages 112-118, 204", "order 4711 of 20000 for $19.99", "isbn 978 3 16 148410 0", "a 12345-6789 zip", "10 000 000 people", "section 3.2.1.4.5", "look at the dot com", "1 2 3 4 5 6 7 8 9"]
    added = lambda t: [x for base, every in pii_scan.scan_texts(net, [t]) for x in every if x not in base]
    false = sum(bool(added(t + w)) for t in clean for w in ("", " and more words follow", " und so weiter."))
    print(f"unseen formats found: {sum(hit)} of {len(hit)}; false reports: {false} of {3 * len(clean)}")
    assert sum(hit) >= 0.5 * len(hit) and false <= 0.1 * 3 * len(clean)


def test_network_alone_finds_what_the_patterns_find(real):
    """The network's own recall of base spans, without the patterns' help."""
    net, hit, every = pii_scan.network(), 0, 0
    for _, text in real:
        base = pii_scan.base_spans(text or "")
        if base:
            runs = pii_scan.tagged(net, [text])[0]
            every += len(base)
            hit += sum(any(s < b[3] and b[0] < e and pii_scan.KINDS[tag - 1] == b[2] for s, e, tag, _ in runs) for b in base)
    print(f"base spans that the network finds by itself: {hit} of {every}")
    assert hit >= 0.8 * every


def test_windows_do_not_matter():
    """A span gives the same tags wherever windows cut the text."""
    net = pii_scan.network()
    for lead in range(0, 300, 13):
        text = "word " * (lead // 5) + "x" * (lead % 5) + " call (555) 123-4567 now " + "word " * 40
        assert any(kind == "phone" for _, _, kind, _ in pii_scan.scan_texts(net, [text])[0][1]), lead


def test_redaction(spark):
    docs = documents(spark, [(1, "mail a.b@c.de and 1.2.3.4"), (2, None), (3, "")])
    out = pii_scan.scan_pii(docs, redact="[{}]")
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "mail [email] and [ip]", 2: None, 3: ""}


# BPE and packing


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_bpe_as_the_library(spark, real, library):
    path, tokenizer = library
    rng = random.Random(2)
    rows = real + EDGE + [(-9, "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|>"), (-10, "it's ΑΣ ΣΣ İı ſ K \x1c\x85"), (-11, "\ua7cb ٣ ⅷ 한국어 日本語 ไทย"), (-12, "a" * 4000 + "ab" * 900)]
    rows += [(-1000 - i, "".join(rng.choice("aaabetionsrh'123 !?.<|>é") for _ in range(rng.randint(0, 60)))) for i in range(500)]
    got = bpe.encode_documents(documents(spark, rows).select("doc_id", "text", "ids"), path)
    for r in got.collect():
        text = next(t for i, t in rows if i == r.doc_id)
        want = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == tokenizer.decode(want, skip_special_tokens=False)


def test_nothing_to_encode(spark, library):
    empty = documents(spark, [(1, "x")]).limit(0)
    assert bpe.encode_documents(empty.select("doc_id", "text"), library[0]).count() == 0 and packing.pack_documents(empty, library[0]).count() == 0


def test_bpe_memory_is_renewed(library, monkeypatch):
    path, tokenizer = library
    monkeypatch.setattr(bpe, "KEPT_WORDS", 5)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 3)
    coder = bpe.WordBpe(path)
    for text in ("one two three four", "five six seven one two", "one, two. three!", ""):
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def placed_well(rows, size):
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing(spark, real, library):
    path, tokenizer = library
    rows = real + EDGE
    got = packing.pack_documents(documents(spark, rows), path).collect()
    total = 0
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id)
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        part = ids[r.start : r.start + r.length]
        assert len(part) == r.length and r.start == 2048 * r.piece and (r.length == 2048 or r.start + r.length == len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        total += r.length
    assert placed_well(got, 2048) <= -(-total // 2048) + 1


def test_repeated_rows_are_dealt_apart(spark, library):
    """Rows of one id and of none each get a place, in many groups."""
    got = packing.pack_documents(documents(spark, [(7, "some words here")] * 300 + [(None, "other words")] * 200), library[0]).collect()
    assert len(got) == 500 and len({(r.sequence_id, r.offset) for r in got}) == 500
    placed_well(got, 2048)


@pytest.mark.parametrize("lengths", [[5, 5], [10], [1] * 23, [6, 4, 3, 3, 4, 7, 2, 1, 9], [10, 9, 1, 5, 5, 3, 3, 4], []])
def test_packing_plans(spark, lengths):
    rows = spark.createDataFrame([(i, 0, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long")
    got = packing.pack(rows, 10).collect()
    assert len(got) == len(lengths) and placed_well(got, 10) == (-(-sum(lengths) // 10) if lengths else 0)


def test_packing_random():
    rng = random.Random(6)
    for _ in range(30):
        counts = {rng.randint(1, 64): rng.randint(1, 200) for _ in range(rng.randint(1, 40))}
        plan = packing.plan(counts, 64)
        used: dict[int, int] = {}
        for length, times, many, _, offset in plan.runs:
            used[length] = used.get(length, 0) + times * many
            assert offset + times * length <= 64
        assert used == counts and plan.sequences >= -(-sum(k * n for k, n in counts.items()) // 64)


# Near duplicates


def shingles(text, n=5):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def plain_components(rows, similarity=85):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= similarity * len(x | y):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_against_plain(spark, real):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(140)]

    def copy(edits):
        words = list(base)
        for _ in range(edits):
            words[rng.randrange(140)] = f"e{rng.randint(0, 99999)}"
        return " ".join(words)

    rows = real[:120] + EDGE + [(5000 + i, copy(rng.choice((0, 1, 1, 2, 2, 3, 4, 6)))) for i in range(150)] + [(-20, "one two"), (-21, "ONE\ttwo"), (-22, "a b c d e"), (-23, "a b c d f")]
    want = plain_components({i: t for i, t in rows}.items())
    got = near_dedup.near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_repeated_ids_are_rows_of_their_own(spark):
    words = [f"w{k}" for k in range(100)]
    a, near, other = " ".join(words), " ".join([*words[:-1], "z"]), " ".join(f"u{k}" for k in range(60))
    rows = [(1, a), (5, near), (5, other), (5, other), (7, None), (7, "")]
    got = near_dedup.near_duplicates(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [(1, 96, 1, True), (5, 56, 5, True), (5, 56, 5, True), (5, 96, 1, False), (7, 0, 7, True), (7, 0, 7, True)]
    docs = documents(spark, [*rows, (None, a), (1, a), (1, near)])
    kept = near_dedup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    texts = sorted(repr((r.doc_id, r.text)) for r in kept.collect())
    assert len(texts) == 5 and texts[1:] == sorted(map(repr, [(5, other), (7, None), (7, ""), (None, a)])) and texts[0][:3] == "(1,"


def test_outliers_beside_a_large_group_cost_little(spark):
    """Rows of the second round go with the large component, not with its square."""
    key = [(k, 0, i, 0) for k in range(3) for i in range(2000)] + [(k, 0, 5000 + i, 5000 + i) for k in range(3) for i in range(3)]
    left = spark.createDataFrame(key, "key long, place byte, id long, c long")
    made = near_dedup.blocks(left)
    assert made.count() < 1.2 * len(key)
    meet: dict = {}
    for r in made.collect():
        meet.setdefault((r.key, r.low, r.high), []).append((r.id, r.side))
    pairs = set()
    for (k, low, high), rows in meet.items():
        for i, s in rows:
            pairs |= {(k, i, j) for j, t in rows if i != j and (low == high or s != t)}
    assert all((k, i, 5000 + o) in pairs for k in range(3) for i in range(2000) for o in range(3))
    assert all((k, 5000 + a, 5000 + b) in pairs for k in range(3) for a in range(3) for b in range(3) if a != b)


def test_near_duplicates_edges(spark):
    docs = documents(spark, [(1, "a b c")])
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    row = near_dedup.near_duplicates(docs.withColumn("doc_id", F.lit(None).cast("long"))).first()
    assert row.component_id is None and row.kept is False
    with pytest.raises(ValueError, match="85"):
        near_dedup.near_duplicates(docs, similarity=50)


def test_equal_keys_find_all_near_signatures():
    """The pigeonhole guarantee, by brute force over random signatures."""
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, near_dedup.POSITIONS).astype(np.uint16)
        b = a.copy()
        at = rng.choice(near_dedup.POSITIONS, near_dedup.DISTANCE, replace=False)
        b[at] ^= 1
        keys = near_dedup.index_keys(np.stack([a, b]))
        assert (keys[0] == keys[1]).any()
