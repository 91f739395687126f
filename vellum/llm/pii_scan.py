"""Personal data: fixed patterns plus a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy from labelled spans in generated text, by gradient descent
on the CRF's likelihood.  Texts are cut into overlapping windows; every character takes its
emissions from the window in which it stands furthest from an edge.  Windows whose best path
is proven to be "no personal data" throughout are so tagged; the emissions of all others are
joined and decoded together by Viterbi, so that transitions hold across windows, between the
ends that their neighbours give.  Spans are read from the tags of the whole text.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import map_arrow, parts

#: Kinds in the order in which they are listed; the network's tags are O and these five.
KINDS = ("email", "ip", "card", "phone", "ssn")
WINDOW, STRIDE, HIDDEN, BLOCK = 128, 104, 8, 1024
#: Windows that are decoded together at most; longer stretches are cut, as if one more character without a tag stood there.
TOGETHER = 64
STEPS, BATCH, SEED = 500, 48, 7
#: Mean log-odds per character against "no personal data" that a span of the network must have.
MARGIN = 0.5

#: The base patterns.  The e-mail is found from its sign, so that time is linear.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
        at = text.find("@", max(at + 1, done))


def fits(kind: str, found: str) -> bool:
    """Whether a match of a numeric kind holds."""
    digits = "".join(DIGIT.findall(found))
    if kind == "ip":
        parts = found.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return kind != "ssn" or len(digits) == 9


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, kind, end) of the patterns' matches, in order."""
    found = [(s, 0, "email", e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for k, (kind, pattern) in enumerate((("ip", IP), ("card", CARD), ("phone", PHONE)), 1):
            found += [(m.start(), k, kind, m.end()) for m in pattern.finditer(text) if (kind != "card" or m.end() - m.start() >= 12) and fits(kind, m[0])]
    return sorted(found)


# Characters as the network sees them.

PUNCTUATION = " \n@.-_+():/=\"',#%&$*|![]{};<>?~\\"
CLASSES = 1 + 26 + 1 + len(PUNCTUATION) + 2  # padding, letters, digit, punctuation, other letters, the rest


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    table = np.full(0x10000, CLASSES - 1, dtype=np.uint8)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            table[c] = CLASSES - 2
    for k in range(26):
        table[97 + k] = table[65 + k] = 1 + k
    table[48:58] = 27
    for k, c in enumerate(PUNCTUATION):
        table[ord(c)] = 28 + k
    return table


def classes(text: str) -> np.ndarray:
    return class_table()[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), 0xFFFF)]


# Generated training text.


def generated(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A text and its labelled spans (start, end, tag)."""
    pick = rng.choice
    syllable = lambda: pick(("ba", "en", "th", "er", "re", "ion", "sch", "ung", "ment", "qu", "eau", "ado", "ció", "é", "ö", "ly", "st", "at", "in", "ou", "la", "de", "x", "ge", "si", "pro", "com"))
    word = lambda: "".join(syllable() for _ in range(rng.randint(1, 4)))
    digits = lambda n: "".join(pick("0123456789") for _ in range(n))
    name = lambda: "".join(c for c in word() if c.isascii()) or "ann"

    def card() -> str:
        d = digits(15)
        d += next(x for x in "0123456789" if luhn(d + x))
        sep = pick(("", "", " ", "-"))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def spelled() -> str:
        left, right = pick(("[]", "()", "{}"))
        gap, at, dot = pick(("", " ")), pick(("at", "AT")), pick(("dot", "DOT"))
        return f"{name()}{gap}{left}{at}{right}{gap}{name()}{gap}{left}{dot}{right}{gap}{pick(('com', 'org', 'net', 'de'))}"

    positive = (
        (1, lambda: pick((f"{name()}.{name()}@{name()}.{pick(('com', 'org', 'net', 'de'))}", f"{name()}{digits(2)}@{name()}.example.com", f"{name()}.{digits(2)}@mail{digits(1)}.example.com"))),
        (1, spelled),
        (2, lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4))),
        (3, card),
        (4, lambda: pick((f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(4)} {digits(3)}", f"+{digits(11)}"))),
        (4, lambda: pick((f"({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)} {digits(4)}", f"{digits(3)}{(sep := pick('-. '))}{digits(3)}{sep}{digits(4)}", f"0{digits(2)} {digits(4)} {digits(4)}"))),
        (5, lambda: f"{digits(3)}{(sep := pick('--- '))}{digits(2)}{sep}{digits(4)}"),
    )
    negative = (
        lambda: f'token = "{"".join(pick("0123456789abcdef") for _ in range(40))}"', lambda: digits(rng.randint(1, 11)),
        lambda: f"{rng.randint(0, 20)}.{rng.randint(0, 20)}", lambda: f"{rng.randint(0, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}",
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"{rng.randint(10, 23)}:{rng.randint(10, 59)}",
        lambda: f"https://{name()}.{name()}.com/{digits(3)}", lambda: f"{digits(rng.randint(20, 30))}", lambda: f"${digits(2)}.{digits(2)}", lambda: f"at the {name()} dot", lambda: f"@{name()}", lambda: f"{digits(1)}-{digits(1)}-{digits(1)}",
        lambda: f"{digits(4)}-{digits(4)}", lambda: f"{digits(5)}-{digits(4)}", lambda: f"{digits(2)} {digits(3)} {digits(3)}", lambda: f"Licensed under CC BY-NC {digits(1)}.0, Version {digits(1)}.0.",
    )
    style = pick(("", "", "", "", "###", "$$$", "%%%", "&&&", "!!", " |", ","))
    text, spans, shout = "", [], rng.random() < 0.1
    while len(text) < WINDOW:
        roll = rng.random()
        if roll < 0.1:
            tag, make = pick(positive)
            piece = make()
            spans.append((len(text), len(text) + len(piece), tag))
        else:
            piece = pick(negative)() if roll < 0.17 else word()
            if roll >= 0.17:
                piece = piece.upper() if shout else piece.capitalize() if rng.random() < 0.15 else piece
        text += piece + style * (rng.random() < 0.8) + pick((" ", " ", " ", " ", ". ", ", ", "\n"))
    cut = rng.randint(0, 8)  # windows begin anywhere
    return text[cut : cut + WINDOW], [(max(0, s - cut), min(WINDOW, e - cut), t) for s, e, t in spans if e > cut and s - cut < WINDOW]


@dataclass
class Network:
    """w (2, classes, 4H), u (2, H, 4H), a (2, H, K), b (K), t (K, K); gates stand as i, f, o, g."""

    w: np.ndarray
    u: np.ndarray
    a: np.ndarray
    b: np.ndarray
    t: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.w, self.u, self.a, self.b, self.t]


def forward_states(w: np.ndarray, u: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """States of one direction over x (T, B): gates (T, B, 4H), cells and outputs (T + 1, B, H)."""
    steps, many, h = x.shape[0], x.shape[1], u.shape[0]
    gates = np.empty((steps, many, 4 * h), np.float32)
    cell, out = np.zeros((steps + 1, many, h), np.float32), np.zeros((steps + 1, many, h), np.float32)
    for s in range(steps):
        z = np.tanh(w[x[s]] + out[s] @ u)
        z[:, : 3 * h] = 0.5 * z[:, : 3 * h] + 0.5
        gates[s] = z
        cell[s + 1] = z[:, h : 2 * h] * cell[s] + z[:, :h] * z[:, 3 * h :]
        out[s + 1] = z[:, 2 * h : 3 * h] * np.tanh(cell[s + 1])
    return gates, cell, out


def backward_states(u: np.ndarray, x: np.ndarray, kept: tuple[np.ndarray, ...], dout: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of w and u given those of the outputs (T, B, H)."""
    gates, cell, out = kept
    h = u.shape[0]
    dw, du = np.zeros((size, 4 * h), np.float32), np.zeros_like(u)
    dh, dc = np.zeros_like(out[0]), np.zeros_like(out[0])
    for s in range(len(x) - 1, -1, -1):
        i, f, o, g = (gates[s][:, k * h : (k + 1) * h] for k in range(4))
        dh = dh + dout[s]
        tc = np.tanh(cell[s + 1])
        dc = dc + dh * o * (1 - tc * tc)
        # Sigmoids are 0.5 tanh + 0.5 of halved sums: their slope in the stored sum is 2 s (1 - s).
        dz = np.concatenate([dc * g * 2 * i * (1 - i), dc * cell[s] * 2 * f * (1 - f), dh * tc * 2 * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        np.add.at(dw, x[s], dz)
        du += out[s].T @ dz
        dh, dc = dz @ u.T, dc * f
    return dw, du


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def crf_marginals(e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tag marginals (T, B, K) and summed pair marginals (K, K) of emissions e (T, B, K)."""
    steps = len(e)
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for s in range(1, steps):
        alpha[s] = e[s] + log_sum(alpha[s - 1][:, :, None] + t, 1)
    for s in range(steps - 2, -1, -1):
        beta[s] = log_sum(t + (e[s + 1] + beta[s + 1])[:, None, :], 2)
    z = log_sum(alpha[-1], 1)
    pairs = np.zeros_like(t)
    for s in range(1, steps):
        pairs += np.exp(alpha[s - 1][:, :, None] + t + (e[s] + beta[s])[:, None, :] - z[:, None, None]).sum(axis=0)
    return np.exp(alpha + beta - z[None, :, None]), pairs


def train(texts: list[tuple[str, list[tuple[int, int, int]]]], steps: int = STEPS, seed: int = SEED) -> Network:
    """Fit by Adam on texts of WINDOW characters with labelled spans (start, end, tag)."""
    rng, k = np.random.default_rng(seed), len(KINDS) + 1
    x = np.zeros((len(texts), WINDOW), np.intp)
    y = np.zeros((len(texts), WINDOW), np.intp)
    for i, (text, spans) in enumerate(texts):
        c = classes(text)
        x[i, : len(c)] = c
        for s, e, tag in spans:
            y[i, s:e] = tag
    draw = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
    net = Network(draw(2, CLASSES, 4 * HIDDEN), draw(2, HIDDEN, 4 * HIDDEN), draw(2, HIDDEN, k), np.zeros(k, np.float32), (2 * np.eye(k)).astype(np.float32))
    net.w[:, :, HIDDEN : 2 * HIDDEN] += 0.5  # remember at first
    first, second = ([np.zeros_like(p) for p in net.parts()] for _ in range(2))
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(texts), BATCH)
        xb, yb = x[rows].T, y[rows].T
        kept = [forward_states(net.w[d], net.u[d], xb if d == 0 else xb[::-1]) for d in (0, 1)]
        outs = [kept[0][2][1:], kept[1][2][1:][::-1]]
        e = outs[0] @ net.a[0] + outs[1] @ net.a[1] + net.b
        marginals, pairs = crf_marginals(e, net.t)
        de = marginals
        np.put_along_axis(de, yb[:, :, None], np.take_along_axis(de, yb[:, :, None], 2) - 1, 2)
        dt = pairs
        np.subtract.at(dt, (yb[:-1].ravel(), yb[1:].ravel()), 1)
        da = np.stack([np.einsum("tbh,tbk->hk", o, de) for o in outs])
        dw, du = zip(*(backward_states(net.u[d], xb if d == 0 else xb[::-1], kept[d], (de if d == 0 else de[::-1]) @ net.a[d].T, CLASSES) for d in (0, 1)), strict=True)
        rate = 0.02 * (1 if step < steps * 0.6 else 0.3)
        for p, g, m, v in zip(net.parts(), [np.stack(dw), np.stack(du), da, de.sum((0, 1)), dt], first, second, strict=True):
            g = g / BATCH
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


@lru_cache(maxsize=4)
def network(texts: int = 3000, seed: int = SEED) -> Network:
    rng = random.Random(seed)
    return train([generated(rng) for _ in range(texts)], seed=seed)


def emissions(net: Network, x: np.ndarray) -> np.ndarray:
    """(T, K, B) for windows x (T, B), keeping no states; gates lie in rows, so that every step runs over whole rows."""
    steps, many = x.shape
    h = HIDDEN
    e = np.empty((steps, len(net.b), many), np.float32)
    e[:] = net.b[:, None]
    for d in (0, 1):
        w, u, a = net.w[d], np.ascontiguousarray(net.u[d].T), np.ascontiguousarray(net.a[d].T)
        out, cell, part = (np.zeros((h, many), np.float32) for _ in range(3))
        z, add = np.empty((4 * h, many), np.float32), np.empty((many, 4 * h), np.float32)
        for s in range(steps) if d == 0 else range(steps - 1, -1, -1):
            np.take(w, x[s], axis=0, out=add, mode="clip")
            np.matmul(u, out, out=z)
            z += add.T
            np.tanh(z, out=z)
            gate = z[: 3 * h]
            gate *= 0.5
            gate += 0.5
            cell *= z[h : 2 * h]
            np.multiply(z[:h], z[3 * h :], out=part)
            cell += part
            np.tanh(cell, out=part)
            np.multiply(part, z[2 * h : 3 * h], out=out)
            e[s] += a @ out
    return e


def viterbi(e: np.ndarray, t: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """Best tags (T, B) of emissions e (T, B, K); of sequence b only the first lengths[b] steps count."""
    steps, many, k = e.shape
    lengths = np.full(many, steps) if lengths is None else lengths
    back = np.empty((steps, many, k), np.int8)
    best = e[0]
    for s in range(1, steps):
        ways = best[:, :, None] + t
        on = (s < lengths)[:, None]
        back[s] = np.where(on, ways.argmax(axis=1), np.arange(k))
        best = np.where(on, ways.max(axis=1) + e[s], best)
    tags = np.empty((steps, many), np.int8)
    tags[-1] = best.argmax(axis=1)
    row = np.arange(many)
    for s in range(steps - 1, 0, -1):
        tags[s - 1] = back[s, row, tags[s]]
    return tags


def decoded(runs: list[tuple[np.ndarray, bool, bool]], t: np.ndarray) -> list[np.ndarray]:
    """Best tags of each run of emissions (T, K); the flags say whether text without a tag stands before it and after it."""
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(runs)
    order = sorted(range(len(runs)), key=lambda i: len(runs[i][0]))
    for at in range(0, len(order), 256):
        own = order[at : at + 256]
        lengths = np.array([len(runs[i][0]) for i in own])
        e = np.zeros((int(lengths.max()), len(own), t.shape[0]), np.float32)
        for k, i in enumerate(own):
            piece, before, after = runs[i]
            e[: len(piece), k] = piece
            if before:
                e[0, k] += t[0]
            if after:
                e[len(piece) - 1, k] += t[:, 0]
        tags = viterbi(e, t, lengths)
        for k, i in enumerate(own):
            out[i] = tags[: lengths[k], k]
    return out


def may_leave(e: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Of windows e (T, K, B), those whose best path may have a tag other than O.

    A stretch of other tags gains at most its largest emissions and transitions over O's;
    where no stretch can gain, the path of O alone is the best.
    """
    inner, enter, leave = t[1:, 1:].max() - t[0, 0], t[0, 1:].max() - t[0, 0], t[1:, 0].max() - t[0, 0]
    lead = e[:, 1].copy()
    for k in range(2, e.shape[1]):
        np.maximum(lead, e[:, k], out=lead)
    lead -= e[:, 0]
    run = lead[0]
    most = run + leave
    for s in range(1, len(e)):
        run = lead[s] + np.maximum(run + inner, enter)
        most = np.maximum(most, run + leave)
    return (most > 0) | (run > 0)


def tagged(net: Network, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
    """(start, end, tag, mean log-odds) of every run of one tag in each text."""
    codes = [classes(t) for t in texts]
    first = np.cumsum([0, *(len(c) for c in codes)])
    flat = np.concatenate([*codes, np.zeros(WINDOW, np.uint8)]) if codes else np.zeros(WINDOW, np.uint8)
    counts = [max(1, -(-(len(c) - (WINDOW - STRIDE)) // STRIDE)) if len(c) else 0 for c in codes]
    doc = np.repeat(np.arange(len(codes)), counts)
    local = np.concatenate([np.arange(n) for n in counts]) * STRIDE if len(doc) else np.zeros(0, np.int64)
    start, stop = first[doc] + local, first[doc + 1] if len(doc) else first[:0]
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    tags = np.zeros(len(flat), np.int8)
    odds = np.zeros(len(flat), np.float32)
    edge = (WINDOW - STRIDE) // 2
    steps = np.arange(WINDOW)
    hot: set[int] = set()
    run: list[tuple[int, int, np.ndarray]] = []  # (window, place, emissions) of live windows, one after another
    runs: list[list[tuple[int, int, np.ndarray]]] = []

    def place_tags() -> None:
        """Decode the complete runs and let go of their emissions."""
        if not runs:
            return
        joined = []
        for own in runs:
            first_window, last_window = own[0][0], own[-1][0]
            ends = start[last_window] + WINDOW >= stop[last_window]
            joined.append((np.concatenate([e for _, _, e in own]), bool(local[first_window]), not ends))
        for own, (e, _, _), best in zip(runs, joined, decoded(joined, net.t), strict=True):
            if best.any():
                span = slice(own[0][1], own[0][1] + len(best))
                tags[span] = best
                odds[span] = np.take_along_axis(e, best[:, None].astype(np.intp), 1)[:, 0] - e[:, 0]
                hot.add(int(doc[own[0][0]]))
        runs.clear()

    for at in range(0, len(doc), BLOCK):
        s, e = start[at : at + BLOCK], stop[at : at + BLOCK]
        place = s[None, :] + steps[:, None]
        inside = place < e[None, :]
        em = emissions(net, np.where(inside, flat[np.minimum(place, len(flat) - 1)], 0))
        for k in np.flatnonzero(may_leave(em, net.t)):
            w = int(at + k)
            lo = 0 if local[w] == 0 else edge
            hi = WINDOW if start[w] + WINDOW >= stop[w] else WINDOW - edge
            hi = min(hi, int(stop[w] - start[w]))
            if run and (run[-1][0] != w - 1 or doc[run[-1][0]] != doc[w] or len(run) == TOGETHER):
                runs.append(run)
                run = []
            run.append((w, int(start[w]) + lo, em[lo:hi, :, k].copy()))
        place_tags()
    if run:
        runs.append(run)
    place_tags()
    for d in sorted(hot):
        own = tags[first[d] : first[d + 1]]
        cuts = np.flatnonzero(np.diff(own, prepend=-1, append=-1))
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if own[s]:
                found[d].append((int(s), int(e), int(own[s]), float(odds[first[d] + s : first[d] + e].mean())))
    return found


#: An address of any spelling: a sign or the word "at", in brackets or in capitals, and a dot or its word.
SPELLED = re.compile(r"\w *(?:@|[(\[{<] *(?i:at) *[)\]}>]|\bAT\b) *\w+ *(?:\.|[(\[{<] *(?i:dot) *[)\]}>]|\bDOT\b) *\w")


def whole(kind: str, text: str, start: int, end: int) -> bool:
    """Whether a span of the network is complete: nothing alike touches it, and its kind's check holds."""
    if (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
        return False
    found = text[start:end]
    if kind == "email":
        return bool(SPELLED.search(found))
    return found[0] in "(+0123456789" and found[-1].isdigit() and fits(kind, found)


def scan_texts(net: Network, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, in order; spans of the network never touch base ones."""
    out = []
    for text, runs in zip(texts, tagged(net, texts), strict=True):
        base = base_spans(text)
        every = list(base)
        for s, e, tag, odds in runs:
            while s < e and text[s].isspace():
                s += 1
            while e > s and not text[e - 1].isalnum() and text[e - 1] not in ")]":
                e -= 1
            kind = KINDS[tag - 1]
            if e > s and odds >= MARGIN and whole(kind, text, s, e) and not any(s < x[3] and x[0] < e for x in base):
                every.append((s, tag - 1, kind, e))
        out.append((base, sorted(every)))
    return out


def shown(spans: list[tuple[int, int, str, int]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in spans)


def scan_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", redact: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Spans are kind:start:end in code points, by start and then kind as in KINDS.  Null and
    empty texts have none, texts of any length are read whole, an empty table gives no rows;
    repeated rows each get their row; other columns aren't used.  With
    ``redact``, the result is ``docs`` instead, each span in ``text`` replaced by
    ``redact.format(kind)`` (overlapping ones by one); null texts stay null.
    """
    net = network()
    if redact is None:
        source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        kind = docs.schema[doc_id].dataType.simpleString()
        schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    else:
        source, schema = docs, docs.schema
    at = source.columns.index(text)

    def covered(value: str, spans: list) -> str:
        out, done, reach = [], 0, 0
        for s, _, kind, e in spans:
            if s >= reach:
                out += [value[done:s], redact.format(kind)]
            reach = max(reach, e)
            done = reach
        return "".join([*out, value[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch in parts(whole_batch, at, 256, 1_000_000):
                raw = batch.column(at).to_pylist()
                found = scan_texts(net, [t or "" for t in raw])
                if redact is not None:
                    columns = list(batch.columns)
                    columns[at] = pa.array([t if t is None else covered(t, spans) for t, (_, spans) in zip(raw, found, strict=True)], batch.schema.field(at).type)
                    yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
                    continue
                counts = [pa.array([sum(x[1] == k for x in base) for base, _ in found], pa.int64()) for k in range(4)]
                digests = pa.array([hashlib.sha256(shown(base).encode()).hexdigest() for base, _ in found], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([shown(x) for _, x in found], pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return map_arrow(source, run, schema)
