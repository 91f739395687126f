"""BPE encoding and decoding by prefix-sharing trie traversal.

Distinct words form a trie, laid out as their sorted list: the walk down that list is the
trie's depth-first walk, and the states of the current path are all it holds.  It gives
every prefix its last token: the one token that ends the prefix and may stand after the
last token of what is before it.  A prefix that many words share is thus worked out once,
and a word's tokens are read back along its last-token links.  Two tokens may stand side by side if merging their
joined symbols gives just these two; that is kept per pair.
"""

from __future__ import annotations

import gc
import json
import re
import struct
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import give_back, hold, map_arrow, parts

END = "</w>"
#: Words (or chunks between blanks) and token pairs that a worker remembers; twice as many words at most.
KEPT_WORDS, KEPT_PAIRS = 350_000, 600_000
#: Blanks to ``str.split`` but not to the tokenizer.
ODD_BLANKS = "\x1c\x1d\x1e\x1f"
#: Blanks that aren't ASCII, of those that RARE lets pass.
WIDE_BLANKS = "\x85\xa0\u2028\u2029\u202f\u205f"
#: Punctuation before a last comma or full stop: together they are one word.
TOUCHING = r"(?:[^\pL\pN\s]|_)[,.]\s"
LONG_WORD = 200
ROWS_AT_ONCE, BYTES_AT_ONCE = 8192, 4_000_000
#: Outside blocks whose letters, digits and case have long been settled.
RARE = re.compile("[^\x00-\x1b\x20-\u052f\u2010-\u2060\u20a0-\u20bf\u3040-\u3096\u30a0-\u30ff\u4e00-\u9fef]")


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself where printable in Latin-1, else from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder for a tokenizers file of kind BPE with word ends and byte symbols."""

    def __init__(self, path: str, kept_words: int | None = None):
        import regex
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.symbol = byte_symbols()
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.library_form = Tokenizer.from_file(path).normalizer
        self.library_split = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), split["behavior"].lower(), split["invert"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.text = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.inner = {t: i for t, i in self.ids.items() if not t.endswith(self.end)}
        self.final = {t.removesuffix(self.end): i for t, i in self.ids.items() if t.endswith(self.end)}
        self.reach = [self._reach(self.inner).get, self._reach(self.final).get]
        self.vocabulary = [self.inner.get, self.final.get]
        self.fits: dict[int, bool] = {}
        self.kept_words = kept_words or KEPT_WORDS
        # Two generations of what was used of late: the older one goes when the newer is full.
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.four = {i: struct.pack("<I", i) for i in self.text}

    @staticmethod
    def _reach(tokens: dict[str, int]) -> dict[str, int]:
        """Length of the longest token by its last three symbols, or all it has."""
        found: dict[str, int] = {}
        for t in tokens:
            found[t[-3:]] = max(found.get(t[-3:], 0), len(t))
        return found

    def merged(self, units: list[str]) -> list[str]:
        """Plain merging by rank, leftmost first: for the short joins of two tokens only."""
        while len(units) > 1:
            best = min(range(len(units) - 1), key=lambda i: self.rank.get((units[i], units[i + 1]), 1 << 30))
            if (units[best], units[best + 1]) not in self.rank:
                break
            a, b = units[best], units[best + 1]
            out, i = [], 0
            while i < len(units):
                if i + 1 < len(units) and units[i] == a and units[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(units[i])
                    i += 1
            units = out
        return units

    def _units(self, token: str) -> list[str]:
        body = token.removesuffix(self.end)
        units = list(body)
        if len(body) < len(token):
            units[-1] += self.end
        return units

    def side_by_side(self, left: int, right: int) -> bool:
        """Whether merging the symbols of both tokens gives these two; left -1: whether ``right`` may begin a word."""
        tokens = [self.text[right]] if left < 0 else [self.text[left], self.text[right]]
        return self.merged([u for t in tokens for u in self._units(t)]) == tokens

    def _state(self, s: str, d: int, last: list[tuple[int, int] | None]) -> tuple[int, int]:
        """last[d], worked out if it is the first to ask: (last token, its length) of the first d symbols."""
        found = last[d]
        if found is None:
            found = last[d] = self._last(s, d, 0, last)
        return found

    def _last(self, s: str, n: int, final: int, last: list[tuple[int, int] | None]) -> tuple[int, int]:
        tokens, fits = self.vocabulary[final], self.fits
        for k in range(self.reach[final](s[n - 3 if n > 3 else 0 : n], 2 if n > 1 else 1), 0, -1):
            if k > n:
                continue
            token = tokens(s[n - k : n])
            if token is not None:
                left = (last[n - k] or self._state(s, n - k, last))[0]
                pair = ((left + 1) << 20) | token
                known = fits.get(pair)
                if known is None:
                    if len(fits) >= KEPT_PAIRS:
                        fits.clear()
                    known = fits[pair] = self.side_by_side(left, token)
                if known:
                    return token, k
        raise ValueError(f"no token ends {s[:n]!r}")

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Packed ids of distinct words, by one walk over the trie of their symbols."""
        symbol, four = self.symbol, self.four
        out: dict[str, bytes] = {}
        last: list[tuple[int, int] | None] = [(-1, 0)]
        before = ""
        for word in sorted(words):
            s = word if word.isascii() and word.isprintable() else "".join([symbol[b] for b in word.encode("utf-8")])
            same = 0
            for a, b in zip(before, s, strict=False):
                if a != b:
                    break
                same += 1
            del last[same + 1 :]
            last += [None] * (len(s) - len(last))
            before = s
            if len(s) > LONG_WORD:  # states on demand go as deep as a word is long
                for d in range(1, len(s)):
                    self._state(s, d, last)
            token, k = self._last(s, len(s), 1, last)
            found, at = [four[token]], len(s) - k
            while at:
                token, k = last[at]
                found.append(four[token])
                at -= k
            found.reverse()
            out[word] = b"".join(found)
        return out

    def _chunks(self, text: str) -> str | list[str]:
        """What stands between blanks: a text to be split at ASCII blanks, or a list of chunks.

        In a list, a leading blank marks one word as it is, a trailing one a special token.
        """
        if "<|" in text:
            split = self.special_pattern.split(text)
            if len(split) > 1:
                out: list[str] = []
                for k, part in enumerate(split):
                    own = part + " " if k % 2 else self._chunks(part)
                    out += [own] if k % 2 else own.split() if isinstance(own, str) else own
                return out
        if text.isascii():
            if not any(c in text for c in ODD_BLANKS):
                return text.lower()
        elif not RARE.search(text):
            # Lower-casing goes by single characters, so a final sigma isn't special.
            lowered = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            return lowered.split() if any(c in lowered for c in WIDE_BLANKS) else lowered
        # Odd blanks, and scripts still growing, in whose Unicode version libraries differ: these texts are split by the tokenizers library.
        return [" " + w for w, _ in self.library_split.pre_tokenize_str(self.library_form.normalize_str(text))]

    def _learn_chunks(self, chunks: set[str]) -> dict[str, bytes]:
        split, plain = {}, set()
        for c in chunks:
            if c.isalpha():
                plain.add(c)
            elif not c:
                split[c] = []
            elif c[-1] in ",." and c[:-1].isalpha():
                split[c] = [c[:-1], c[-1]]
            elif c[-1] == " ":
                split[c] = []
            else:
                split[c] = [c[1:]] if c[0] == " " else self.words.findall(c)
        known = {}
        for words in split.values():
            for w in words:
                ids = self.new.get(w) or self.old.get(w)
                if ids is None:
                    plain.add(w)
                else:
                    known[w] = ids
        out = self.learn(plain)
        known.update(out)
        for c, words in split.items():
            out[c] = b"".join([known[w] for w in words]) if words or not c else self.four[self.special[c[:-1]]]
        return out

    @staticmethod
    def _numbered(every: list[str | list[str]]) -> tuple[list[str], list[np.ndarray]]:
        """Distinct chunks, and the numbers of each text's chunks; texts are split and numbered in bulk, lists one by one.

        A comma or full stop that ends a chunk is one of its own, unless other punctuation stands before it somewhere in the text.
        """
        plain = pa.array([c if isinstance(c, str) else "" for c in every], pa.large_string())
        parted = plain
        for found, apart in ((", ", " , "), (". ", " . "), (".\n", " .\n")):
            parted = pc.replace_substring(parted, found, apart)
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(plain, TOUCHING), plain, parted))
        coded = split.flatten().dictionary_encode()
        at, ends = coded.indices.to_numpy(), split.offsets.to_numpy()
        codes = [at[begin:end] for begin, end in zip(ends[:-1], ends[1:], strict=True)]
        whole = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        chunks = pc.binary_join(whole, pa.scalar("\n", pa.large_string()))[0].as_py().split("\n") if len(coded.dictionary) else []
        others = [i for i, c in enumerate(every) if not isinstance(c, str)]
        if others:
            number: defaultdict[str, int] = defaultdict(count(len(chunks)).__next__, zip(chunks, range(len(chunks)), strict=True))
            for i in others:
                codes[i] = np.fromiter(map(number.__getitem__, every[i]), np.int64)
            chunks = list(number)
        return chunks, codes

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids, as little-endian unsigned 32-bit integers, of each text; null is empty."""
        collecting = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and the memory of words is large to go through
        try:
            chunks, codes = self._numbered([self._chunks(text or "") for text in texts])
            old, new = self.old, self.new
            missing = [c for c in chunks if c not in new]
            if len(new) + len(missing) > self.kept_words:
                self.old, self.new = old, new = new, {}
                missing = chunks
            rest = set()
            for c in missing:
                ids = old.get(c)
                if ids is None:
                    rest.add(c)
                else:
                    new[c] = ids
            new.update(self._learn_chunks(rest))
            own = list(map(new.__getitem__, chunks))
            tokens = np.frombuffer(b"".join(own), "<u4")
            size = np.fromiter(map(len, own), np.int64, len(own)) // 4
            start = np.cumsum(size) - size
            return [_laid_out(tokens, start[code], size[code]) for code in codes]
        finally:
            if collecting:
                gc.enable()

    def decode(self, ids: bytes) -> str:
        """The tokens' strings, joined by blanks."""
        return " ".join(map(self.text.__getitem__, memoryview(ids).cast("I")))


def _laid_out(tokens: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    """The stretches start : start + size of ``tokens``, one after another."""
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    return tokens[np.repeat(start - end + size, size) + np.arange(total)].tobytes()


@lru_cache(maxsize=2)
def encoder(path: str, kept_words: int | None = None) -> WordBpe:
    hold("bpe", encoder.cache_clear)
    made = WordBpe(path, kept_words)
    give_back()  # what reading the file took
    return made


def encode_documents(docs: DataFrame, path: str, text: str = "text", decoded: bool = True) -> DataFrame:
    """Add n_tokens long, ids binary (little-endian unsigned 32-bit) and, if asked, decoded string.

    Whole texts are encoded as the tokenizers library does with the file at ``path``
    without added special tokens, truncation or padding; decoding joins the tokens'
    strings by blanks, as that library does for a file without a decoder.  Null and empty
    texts give no ids and an empty decoded text; texts of any length are encoded whole, an
    empty table gives no rows, repeated rows each get their row.  Only
    the text column is replaced by the results; the others pass through, and columns that
    already bear a result's name are replaced.
    """
    added = {"n_tokens": "long", "ids": "binary"} | ({"decoded": "string"} if decoded else {})
    keep = [c for c in docs.columns if c not in added and c != text]
    source = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} {t}" for c, t in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for whole in batches:
            for batch in parts(whole, whole.num_columns - 1, ROWS_AT_ONCE, BYTES_AT_ONCE):
                found = bpe.encode(batch.column(batch.num_columns - 1).to_pylist())
                columns = [*batch.columns[:-1], pa.array([len(i) // 4 for i in found], pa.int64()), pa.array(found, pa.binary())]
                if decoded:
                    columns.append(pa.array(map(bpe.decode, found), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *added])

    return map_arrow(source, run, schema, holds="bpe")
