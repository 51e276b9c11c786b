"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one token can be the last of the prefix's encoding. A suffix
automaton of the vocabulary gives the tokens that end at a place; the right one is the token whose
pair with the last token of the prefix before it is compatible: re-merging the two would not join
anything across the seam. So one token is stored per prefix, and following the back-pointers from the
whole word gives exactly the ids that merging in rank order gives, without a merge queue.

Odd rows: null and empty texts have no ids; strings of special tokens inside a text give their ids, as
the library does; repeated rows are encoded each; very long texts are encoded whole. Other columns are
left out, so names cannot clash. An empty table gives an empty table.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import kept
from earshot.llm.encoder import slices

NEVER = 1 << 60
SEAM = 20  # bits of a token id in a pair's key
# Characters up to U+024F have no canonical compositions among themselves.
_plain = re.compile("[\x21-\x7e\xa1-ɏ]*")
_between = re.compile("[^\t\n\r ]+")
_WORDS = 150_000
_PIECES = 450_000
_PAIRS = 1_000_000


class SuffixAutomaton:
    """All substrings of a set of token strings; every state knows the tokens that are its suffixes."""

    def __init__(self, strings: dict[int, tuple[int, ...]]):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, list[tuple[int, int]]] = {}
        for token, symbols in strings.items():
            state = 0
            for s in symbols:
                state = self._extend(state, s)
            ends.setdefault(state, []).append((len(symbols), token))
        # a state that was copied later keeps its longer strings, its link the shorter ones
        own: dict[int, list[tuple[int, int]]] = {}
        for state, found in ends.items():
            for size, token in found:
                at = state
                while size <= self.length[self.link[at]]:
                    at = self.link[at]
                own.setdefault(at, []).append((size, token))
        #: (length, token) of the tokens that end the strings of each state, longest first
        self.suffixes: list[tuple[tuple[int, int], ...]] = [()] * len(self.step)
        for state in sorted(range(1, len(self.step)), key=self.length.__getitem__):
            self.suffixes[state] = tuple(sorted(own.get(state, ()), reverse=True)) + self.suffixes[self.link[state]]

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.step) - 1

    def _split(self, state: int, symbol: int, onto: int) -> int:
        """A copy of ``onto`` for the strings that ``state`` and ``symbol`` make."""
        copy = self._new(self.length[state] + 1, dict(self.step[onto]), self.link[onto])
        self.link[onto] = copy
        while state >= 0 and self.step[state].get(symbol) == onto:
            self.step[state][symbol] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        there = self.step[last].get(symbol)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._split(last, symbol, there)
        new = self._new(self.length[last] + 1, {}, 0)
        state = last
        while state >= 0 and symbol not in self.step[state]:
            self.step[state][symbol] = new
            state = self.link[state]
        if state >= 0:
            there = self.step[state][symbol]
            good = self.length[there] == self.length[state] + 1
            self.link[new] = there if good else self._split(state, symbol, there)
        return new


class PairTable:
    """Merges of a byte-pair vocabulary: ranks, halves of each token, and which tokens may meet."""

    def __init__(self, vocab: dict[str, int], merges: list, prefix: str = ""):
        size = max(vocab.values()) + 1
        if size > 1 << SEAM:
            raise ValueError(f"vocabulary has ids beyond {1 << SEAM}")
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.pairs: dict[int, int] = {}
        self.known: dict[int, bool] = {}
        order = []
        for r, m in enumerate(merges):
            a, b = m if isinstance(m, (list, tuple)) else m.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if max(self.rank[x], self.rank[y]) >= r or self.rank[z] >= 0 or x << SEAM | y in self.pairs:
                raise ValueError("merges are not in the order in which their parts are made")
            self.rank[z], self.left[z], self.right[z] = r, x, y
            self.pairs[x << SEAM | y] = r
            order.append(z)
        made = set(order)
        base = [t for t in vocab.values() if t not in made]
        self.symbols = {t: (t,) for t in base}
        self.whole = [False] * size  # tokens that their own string is encoded as
        for t in base:
            self.whole[t] = True
        for z in order:
            x, y = self.left[z], self.right[z]
            if x not in self.symbols or y not in self.symbols:
                raise ValueError("merges are not in the order in which their parts are made")
            self.symbols[z] = self.symbols[x] + self.symbols[y]
            self.whole[z] = self.whole[x] and self.whole[y] and self._apart(x, y, self.rank[z])

    def _apart(self, x: int, y: int, limit: int = NEVER) -> bool:
        """Whether x and y, each merged by itself, stay apart until merges of rank ``limit``.

        Time runs backwards: the token made last is taken apart, and at each moment the two tokens at
        the seam are looked up. A pair of equal rank on the left is merged first, one on the right later.
        """
        rank, pairs = self.rank, self.pairs
        until_x = until_y = limit
        while True:
            r = pairs.get(x << SEAM | y, NEVER)
            if r < until_x and r <= until_y and r < limit:
                return False
            if rank[x] > rank[y]:
                until_x, x = rank[x], self.right[x]
            elif rank[y] >= 0:
                until_y, y = rank[y], self.left[y]
            else:
                return True

    def compatible(self, key: int) -> bool:
        """Whether the two tokens of a pair's key may stand side by side; kept in ``known``."""
        if len(self.known) >= _PAIRS:
            self.known.clear()
        found = self.known[key] = self._apart(key >> SEAM, key & ((1 << SEAM) - 1))
        return found


class Bpe:
    """Encoder and decoder of one tokenizer file; texts are cut into pieces as the file says.

    Pieces of plain words are found with the file's own pattern; other words, and texts of tokenizers
    that keep white space, go through the library's normalizer and pre-tokenizer. Every piece is
    encoded by prefix. Caches of words, pieces and pairs are emptied when full.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("not a byte-level BPE file")
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.ignore_merges = vocab if model.get("ignore_merges") else {}
        self.pair = PairTable(vocab, model["merges"])
        self.automaton = SuffixAutomaton({t: s for t, s in self.pair.symbols.items() if self.pair.whole[t]})
        # byte-level models write bytes as characters: printable ones as themselves, the others from 256 on
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        other = [b for b in range(256) if b not in own]
        self.char = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(other)}
        self.byte = {ord(c): b for b, c in self.char.items()}
        self.inner = [vocab[self.char[b]] for b in range(256)]
        self.final = [vocab[self.char[b] + end] for b in range(256)]
        self.library = Tokenizer.from_file(path)
        added = {t["content"]: t for t in told["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added.values()):
            raise ValueError("added tokens with options are not supported")
        self.added = {c: t["id"] for c, t in added.items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        names = {i: t for t, i in vocab.items()} | {i: c for c, i in self.added.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        kind = (told["decoder"] or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"decoder {kind} is not supported")
        self.joins_bytes = kind == "ByteLevel"
        self.words: dict[str, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}
        self.raw = [i.to_bytes(4, "little") for i in range(len(self.names))]
        parts = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.pattern = None
        if len(parts) == 2 and parts[0]["type"] == "Split" and parts[0]["behavior"] == "Removed" and parts[0]["invert"]:
            self.pattern = regex.compile(parts[0]["pattern"]["Regex"])
        steps = [n["type"] for n in (told["normalizer"] or {}).get("normalizers", [])]
        probe = "Ab thing, was. it's x\ta12\n\n c  Über straße: no!"
        self.by_word = (
            self.pattern is not None and steps == ["NFC", "Replace", "Lowercase"]
            and self._library_pieces(probe) == [p for w in probe.split() for p in self._pattern_pieces(w)]
        )

    # --- pieces -------------------------------------------------------------------------------

    def _library_pieces(self, text: str) -> list[bytes]:
        """UTF-8 of the pieces that the library's normalizer and pre-tokenizer cut."""
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        if not text:
            return []
        byte = self.byte
        return [bytes([byte[ord(c)] for c in p]) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _pattern_pieces(self, word: str) -> list[bytes]:
        return [p.encode() for p in self.pattern.findall(word.lower())]

    # --- the dynamic program --------------------------------------------------------------------

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece: the last token of every prefix, then the way back."""
        if self.ignore_merges:
            name = "".join(self.char[b] for b in piece)
            if name in self.ignore_merges:
                return [self.ignore_merges[name]]
        n = len(piece)
        last = [0] * (n + 1)
        size = [0] * (n + 1)
        auto = self.automaton
        step, link, length, suffixes = auto.step, auto.link, auto.length, auto.suffixes
        known, compatible = self.pair.known.get, self.pair.compatible
        inner = self.inner
        symbols = [inner[x] for x in piece]
        symbols[-1] = self.final[piece[-1]]
        state = held = i = 0
        for symbol in symbols:
            i += 1
            to = step[state].get(symbol)
            while to is None:
                state = link[state]
                held = length[state]
                to = step[state].get(symbol)
            state = to
            held += 1
            for m, token in suffixes[state]:
                if m < i:
                    if m > held:
                        continue
                    key = last[i - m] << SEAM | token
                    fits = known(key)
                    if fits is None:
                        fits = compatible(key)
                    if not fits:
                        continue
                elif m > held:
                    continue
                last[i], size[i] = token, m
                break
        out, i = [], n
        while i:
            out.append(last[i])
            i -= size[i]
        out.reverse()
        return out

    def _piece(self, piece: bytes) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            raw = self.raw
            found = b"".join([raw[t] for t in self.encode_piece(piece)])
            if len(piece) <= 64:
                if len(self.pieces) >= _PIECES:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def _word(self, word: str) -> bytes:
        if _plain.fullmatch(word) and "\u0130" not in word:  # its small form is two characters
            if word.isalpha():
                return self._piece(word.lower().encode())
            if word[-1] in ",." and word[:-1].isalpha():
                return self._piece(word[:-1].lower().encode()) + self._piece(word[-1].encode())
        cut = self._pattern_pieces if _plain.fullmatch(word) else self._library_pieces
        return b"".join([self._piece(p) for p in cut(word)])

    def _segment(self, text: str) -> bytes:
        if not self.by_word:
            return b"".join([self._piece(p) for p in self._library_pieces(text)])
        words = _between.findall(text)
        get = self.words.get
        parts = list(map(get, words))
        if None in parts:
            for k, p in enumerate(parts):
                if p is None:
                    w = words[k]
                    p = get(w)
                    if p is None:
                        p = self._word(w)
                        if len(w) <= 64:
                            if len(self.words) >= _WORDS:
                                self.words.clear()
                            self.words[w] = p
                    parts[k] = p
        return b"".join(parts)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.cut is None or not self.cut.search(text):
            return self._segment(text)
        parts = self.cut.split(text)
        return b"".join(
            self.added[p].to_bytes(4, "little") if k % 2 else self._segment(p) for k, p in enumerate(parts)
        )

    def decode(self, ids: bytes) -> str:
        """Text of ids; without a decoder in the file, token strings joined by blanks."""
        import numpy as np

        names = [self.names[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]
        if not self.joins_bytes:
            return " ".join([t for t in names if t])
        out = bytearray()
        for t in names:
            out += t.encode() if t in self.added else bytes([self.byte[ord(c)] for c in t])
        return out.decode("utf-8", "replace")


def bpe(path: str) -> Bpe:
    return kept(f"bpe {path}", lambda: Bpe(path))


def encode_texts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, text`` -> doc_id, n_tokens, ids (little-endian unsigned 32-bit integers)."""

    def run(batches):
        import pyarrow as pa

        model = bpe(tokenizer)
        for b in batches:
            names, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in slices(texts):
                ids = [model.encode(t) for t in texts[lo:hi]]
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                cols = [names.slice(lo, hi - lo), n, pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids binary"
    )


def decode_texts(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` with ``decoded``, the text of the ids; null ids give a null text."""

    def run(batches):
        import pyarrow as pa

        model = bpe(tokenizer)
        for b in batches:
            ids = b.column(2)
            for lo in range(0, len(ids), 256):
                some = b.slice(lo, 256)
                texts = [None if x is None else model.decode(x) for x in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, decoded string"
    )
