"""Token ids of whole texts by a public tokenizer file, with a cache of words per Python worker."""

from __future__ import annotations

from earshot.llm.common import give_back, kept

# Words are tokenised on their own where white space cannot matter: printable characters up to
# U+024F have no compositions, and tab, line feed, carriage return and blank are plain separators.
# The small form of U+0130 is two characters.
_PLAIN = r"\A[\t\n\r\x20-\x7e\x{a1}-\x{12f}\x{131}-\x{24f}]*\z"
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # behind a letter they begin another piece; not ' and digits
_CACHE = 50_000
_UNIT = 1 << 21  # bytes of text whose words are looked up together


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and case, so the ids of a plain text are those of its words in lower case in
    a row. Arrow parts the texts into words and numbers the distinct ones of a unit; those are looked up, and asked
    of the library where they are not known. Other texts, and those that might hold special tokens, go to the
    library whole. Words are kept in two dictionaries: when the younger is full it becomes the older, and what was
    only in the older is gone, so memory is bounded.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.raw = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.tokenize = self.tokenizer.model.tokenize
        # byte-level models write bytes as characters: printable ones as themselves, the others from 256 on
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.letter = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in own)}
        self.names = [self.letter.get(b, b) if b != 10 else b for b in range(256)]  # line feeds part words in a row
        self.special = sorted({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        probe = ["Ab thing, was. it's x", "a\tb\n c", "über straße: no!"]
        self.by_word = all(self._whole(t) == b"".join(self._whole(w) for w in t.split()) for t in probe)
        # a word of letters is one unit of the model, whatever its case
        self.letters = self.by_word and all(
            self._model(w.lower()) == self._whole(w) for w in ("Thing", "zxqvw", "AND", "onerntat", "über", "Élève", "STRAẞE", "ñandúřž")
        )
        # marks behind a letter begin another piece, whatever follows
        self.marks = self.letters and all(
            self._whole(f"{w}{m}{x}") == self._whole(w) + self._whole(f"{m}{x}")
            for w in ("thing", "Élève") for m in _MARKS.decode() for x in ("", "a", "7", "'s", m, ",", "#é")
        )

    def _whole(self, text: str) -> bytes:
        import numpy as np

        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _model(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letter)
        raw = self.raw
        return b"".join([raw[t.id] for t in self.tokenize(word)])

    def _models(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters in lower case."""
        import numpy as np

        if not words:
            return []
        raw, tokenize = self.raw, self.tokenize
        names = np.array(self.names, dtype="<u2")[np.frombuffer("\n".join(words).encode(), dtype=np.uint8)].tobytes().decode("utf-16-le")
        return [raw[t[0].id] if len(t) == 1 else b"".join([raw[x.id] for x in t]) for t in map(tokenize, names.split("\n"))]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words in lower case, from the library."""
        import numpy as np

        new, rest = {}, words
        if self.letters:
            whole = [w for w in words if w.isalpha()]
            rest = [w for w in words if not w.isalpha()]
            new.update(zip(whole, self._models(whole), strict=True))
        for lo in range(0, len(rest), 2000):
            some = rest[lo : lo + 2000]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = np.asarray(found.ids, dtype="<u4")
            ends = np.cumsum([len(w) + 1 for w in some])
            cut = np.searchsorted(np.asarray([o[0] for o in found.offsets]), ends[:-1], side="left")
            at, raw = [0, *(4 * cut).tolist(), 4 * len(ids)], ids.tobytes()
            new.update(zip(some, [raw[a:b] for a, b in zip(at, at[1:], strict=False)], strict=True))
        return new

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        young, old = self.young, self.old
        found = list(map(young.get, words))
        away = [k for k, ids in enumerate(found) if ids is None]
        new = []
        for k in away:
            w = words[k]
            ids = old.get(w)
            if ids is None:
                new.append(w)
            else:
                young[w] = found[k] = ids
        learned = self._learn(new)
        for k in away:
            if found[k] is None:
                found[k] = learned[words[k]]
        young.update(learned)
        if len(young) > _CACHE:
            self.old, self.young = young, {}
        return found

    def encode_column(self, texts):
        """Ids of each text of an Arrow column, as a column; null counts as empty."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        plain = pc.match_substring_regex(texts, _PLAIN) if self.by_word else pa.array(np.zeros(len(texts), dtype=bool))
        for s in self.special:
            plain = pc.and_not(plain, pc.match_substring(texts, s))
        other = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        some = texts.filter(plain) if len(other) else texts
        if self.letters:
            some = pc.utf8_lower(some)
        parts = pc.ascii_split_whitespace(_parted(some) if self.marks else some)
        ends = parts.offsets.to_numpy()
        words = parts.flatten().dictionary_encode()
        ids = pa.array(self._ids(words.dictionary.to_pylist()), pa.binary()).take(words.indices)
        _, starts, data = ids.buffers()
        if len(words):
            at = np.frombuffer(starts, dtype=np.int32)[ids.offset : ids.offset + len(ids) + 1]
            ends = at[ends - ends[0]]
        del parts, words
        give_back()
        column = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(np.ascontiguousarray(ends, dtype=np.int32)), data])
        if not len(other):
            return column
        whole = pa.array([self._whole(t) for t in texts.take(other).to_pylist()], pa.binary())
        place = np.empty(len(texts), dtype=np.int64)
        place[np.flatnonzero(plain.to_numpy(zero_copy_only=False))] = np.arange(len(some))
        place[other] = len(some) + np.arange(len(other))
        return pa.concat_arrays([column, whole]).take(pa.array(place))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null counts as empty."""
        import pyarrow as pa

        column = pa.array(texts, pa.string())
        return [ids for lo, hi in units(column) for ids in self.encode_column(column.slice(lo, hi - lo)).to_pylist()]


def _parted(texts):
    """Texts of an Arrow column with a blank between a letter and a mark behind it."""
    import numpy as np
    import pyarrow as pa

    if not len(texts):
        return texts
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    kind = np.zeros(256, dtype=np.uint8)
    kind[list(_MARKS)] = 1
    kind[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0)]] = 2
    k = kind[raw]
    at = np.flatnonzero((k[1:] == 1) & (k[:-1] == 2)) + 1
    last, lead = raw[at - 1], raw[at - 2]
    # U+00A1 to U+00BF, the signs of multiplication and division are no letters, or count as none
    at = at[(last < 0x80) | (lead > 0xC3) | (lead == 0xC3) & (last != 0x97) & (last != 0xB7)]
    ends = ends - ends[0]
    ends = (ends + np.searchsorted(at, ends)).astype(np.int32)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(np.insert(raw, at, 32)))


def encoder(path: str) -> Encoder:
    return kept(f"encoder {path}", lambda: Encoder(path))


def slices(texts: list[str | None], most: int = 1 << 21):
    """Ranges of a batch that hold about ``most`` characters each."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def units(texts, most: int = _UNIT):
    """Ranges of an Arrow column that hold about ``most`` bytes each."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo, before = 0, 0
    while lo < len(texts):
        hi = min(len(texts), int(np.searchsorted(sizes, before + most)) + 1)
        yield lo, hi
        lo, before = hi, sizes[hi - 1]
