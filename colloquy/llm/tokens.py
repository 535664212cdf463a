"""Token ids by the tokenizers library, a block of texts at a time: each different word of a block is encoded once."""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Bytes of texts that are encoded at once.
BLOCK = 1 << 21
#: Fixed value: the pre-tokenizing pattern of byte-level BPE vocabularies of this kind.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Encodes whole texts as unsigned 16- or 32-bit little-endian ids.

    Byte-level BPE treats every piece of its pre-tokenizer apart, so a piece met before has the same ids again;
    likewise what stands between two single spaces. Other kinds of tokenizer encode each text in full. ``most`` bounds
    what each of the two memories keeps.
    """

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.most, self.pieces, self.chunks = most, {}, {}
        self.known, self.odd = set(), set()
        kind = type(self.tokenizer.pre_tokenizer).__name__
        self.by_pieces = kind == "ByteLevel" and self.tokenizer.normalizer is None and not self.tokenizer.pre_tokenizer.add_prefix_space
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.find = regex.compile(PIECES).findall
        # The names that byte-level BPE gives to bytes: printable Latin-1 characters stand for themselves, others follow from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte_names = str.maketrans({b: 256 + k for k, b in enumerate(b for b in range(256) if b not in own)})
        self.space = " ".translate(self.byte_names)
        self.stops = dict(zip(".,;:!?", self.whole(list(".,;:!?")), strict=True))

    def kinds_of(self, c: str) -> set[str]:
        """The kinds of a character by the library, by the pattern and by str: one, if all agree."""
        alone = lambda x: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(x + c)) == 1
        library = "letter" if alone("a") else "number" if alone("1") else "other" if alone("!") else "space"
        pattern = next((k for k, x in (("letter", r"\p{L}"), ("number", r"\p{N}"), ("space", r"\s")) if regex.match(x, c)), "other")
        own = "letter" if c.isalpha() else "space" if c.isspace() else pattern if pattern in ("number", "other") else "other"
        return {library, pattern, own}

    def notice(self, texts) -> bool:
        """Look at characters not met before; whether any met so far has different kinds by the library and by Python,
        whose Unicode tables differ in age. Texts with such characters are the library's."""
        new = set("".join(texts)) - self.known
        self.known |= new
        self.odd |= {c for c in new if len(self.kinds_of(c)) > 1}
        return bool(self.odd)

    def strange(self, text: str) -> bool:
        return any(x in text for x in self.added) or not self.odd.isdisjoint(text)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def apart(self, pieces: list[str]) -> list[bytes]:
        """The ids of texts each of which is one piece of the pre-tokenizer, by the library's BPE model alone."""
        model, out = self.tokenizer.model.tokenize, []
        for p in pieces:
            p = p.replace(" ", self.space) if p.isascii() and p[1:].isalpha() else p.encode().decode("latin-1").translate(self.byte_names)
            out.append(array(self.dtype.char, [t.id for t in model(p)]).tobytes())
        return out

    def by_piece(self, texts: list[str]) -> list[bytes]:
        rows = [self.find(t) for t in texts]
        if len(self.pieces) > self.most:
            self.pieces = {}
        if new := set().union(*rows) - self.pieces.keys():
            new = list(new)
            self.pieces.update(zip(new, self.apart(new), strict=True))
        get = self.pieces.__getitem__
        return [b"".join(map(get, r)) for r in rows]

    def learn(self, chunks: list[str]) -> list[bytes | None]:
        """The ids of chunks that follow a space or begin with a line feed; None for those that a piece or an added
        token may reach over."""
        if len(self.chunks) > self.most:
            self.chunks = {}
        # No piece reaches over a space or line feed between two characters that are no white space, nor over the end of an added token.
        plain, stopped, lines, other = set(), [], [], []
        fresh = [c for c in chunks if c not in self.chunks]
        odd = self.notice(fresh)
        for c in fresh:
            if odd and not self.odd.isdisjoint(c):
                self.chunks[c] = None
            elif c.isalpha():
                plain.add(c)
            elif c[-1:] in self.stops and c[:-1].isalpha():
                stopped.append(c)
                if c[:-1] not in self.chunks:
                    plain.add(c[:-1])
            elif c and not c[-1].isspace() and not any(x in c for x in self.added) and not c[c[0] == "\n"].isspace():
                (lines if c[0] == "\n" else other).append(c)
            else:
                self.chunks[c] = None
        self.chunks.update(zip(plain, self.apart([" " + c for c in plain]), strict=True))
        for c in stopped:
            self.chunks[c] = self.chunks[c[:-1]] + self.stops[c[-1]]
        self.chunks.update(zip(other, self.by_piece([" " + c for c in other]), strict=True))
        self.chunks.update(zip(lines, self.by_piece(lines), strict=True))
        return [*map(self.chunks.__getitem__, chunks)]

    def alone(self, text: str) -> bytes:
        return (self.whole if self.strange(text) else self.by_piece)([text])[0]

    def flat(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text's followed by ``end``, and how many each text has with it."""
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        if not self.by_pieces:
            rows = [np.append(np.frombuffer(x, self.dtype), self.dtype.type(end)) for x in self.whole(texts.to_pylist())]
            return np.concatenate(rows), np.array([*map(len, rows)])
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        bounds = parts.offsets.to_numpy()
        first, words = bounds[:-1], parts.values
        known = words.dictionary_encode()
        at, own = known.indices.to_numpy().copy(), self.learn(known.dictionary.to_pylist())
        # A text's first word follows no space: it has ids of its own.
        heads = words.take(pa.array(first)).to_pylist()
        self.notice(heads)
        at[first] = len(own) + np.arange(len(heads))
        own += [None if h[-1:].isspace() or self.strange(h) else ids for h, ids in zip(heads, self.by_piece(heads), strict=True)]
        unsafe = np.fromiter((x is None for x in own), bool, len(own))[at]
        if unsafe.any():  # these texts go by themselves, in the place of their first word
            whose = np.repeat(np.arange(len(heads)), np.diff(bounds))
            odd = np.unique(whose[unsafe])
            at[np.isin(whose, odd)] = len(own)
            at[first[odd]] = len(own) + 1 + np.arange(len(odd))
            own += [b"", *map(self.alone, texts.take(pa.array(odd)).to_pylist())]
        # A row for each chunk, and one for the end of each text; then the ids of all rows.
        at = np.insert(at, bounds[1:], len(own))
        own = [*(x or b"" for x in own), np.array([end], self.dtype).tobytes()]
        size = np.fromiter(map(len, own), np.int64, len(own)) // self.dtype.itemsize
        values, begin = np.frombuffer(b"".join(own), self.dtype), np.cumsum(size) - size
        n = size[at]
        ends = np.cumsum(n)
        place = np.repeat((begin[at] - ends + n).astype(np.int32), n)  # a block has fewer ids than 2 ** 31
        place += np.arange(ends[-1], dtype=np.int32)
        return values[place], np.add.reduceat(n, first + np.arange(len(heads)))

    def forget(self) -> None:
        """Free the memories of words, for the stages that follow in the same worker."""
        self.pieces, self.chunks = {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        ids, n = self.flat(pa.array(texts, pa.string()), 0)
        ends = np.cumsum(n)
        return [ids[e - k : e - 1].tobytes() for e, k in zip(ends, n, strict=True)]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


def blocks(texts: pa.Array | list[str], most: int = 1 << 21):
    """Slices of texts of about ``most`` bytes (of a list: characters), at least one text each."""
    n = [*map(len, texts)] if isinstance(texts, list) else pc.binary_length(texts).to_numpy(zero_copy_only=False)
    size, begin = np.cumsum(n), 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + most, "right")))
        yield begin, end
        begin = end
