"""Token ids by the tokenizers library, with a word cache.

Pre-tokenizers cut a text at certain places whatever stands around; at those a text can be taken apart, each different
piece encoded once, and the ids put together again. Which places these are depends on the vocabulary file:

* byte-level files: before a single space between two characters that are not white space, and around a line feed
  between two such characters (a piece with its leading space, or the line feed, is a run of whole pre-tokens);
* files that drop white space (a lower-casing normaliser, words with end marks): at every space or line feed.

Texts with any other white space, or with two white space characters in a row, are encoded whole. Pieces of a batch are
counted by Arrow. A piece of letters, or letters and then ASCII marks, is one pre-token or two whatever the file: it is taken
apart there (and its letters lower-cased where the file does so), so that a word is one entry whatever marks follow it. A
bounded cache keeps words and other pieces from batch to batch. New words go to the library's model at once; other new
pieces are encoded many in a row with a separator that is a token of its own there (a line feed, or a control character
between spaces). Texts longer than `slices` allows are batches of their own; no text is cut short.
"""

from __future__ import annotations

import codecs
import unicodedata
from functools import lru_cache
from itertools import chain, repeat
from operator import attrgetter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.models import BPE

from weftline.llm.kernels import flat, ragged, ranges

END = 2
CACHE = 500_000
PART_TEXTS, PART_CHARS = 4096, 200_000
ROW = 1000
#: Bytes of text that callers should pass at a time; one longer text goes alone.
ENCODED_BYTES = 4_000_000
#: Marks that may follow letters in a piece: all of ASCII but the apostrophe, with which contractions begin.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


def byte_letters() -> str:
    """The characters that stand for the bytes of byte-level vocabularies: printable ones for themselves, the others from 256 on in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return "".join(chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256))


#: Anything but single spaces and line feeds between other characters; \s of the pre-tokenizers is Unicode white space.
ODD = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|^[ \n]|[ \n]$"
_ID = attrgetter("id")


def _strings(texts: pa.Array) -> list[str]:
    """What to_pylist() gives for texts without nulls, in a quarter of its time."""
    return texts.to_numpy(zero_copy_only=False).tolist()


class WordCache:
    """Encodes batches of texts to one flat array of ids and the number of ids of each text (without the end id)."""

    def __init__(self, path: str, most: int = CACHE) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.spaced = self.tokenizer.normalizer is None  # a leading space belongs to the word
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.direct = isinstance(self.model, BPE) and "ByteLevel" in str(self.tokenizer.pre_tokenizer)
        self.most = most
        self.between = "\n" if self.spaced else " \x01 "
        mark = self.tokenizer.encode(self.between, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self._forget()

    def _forget(self) -> None:
        """Leaves the pieces that no row of pieces can hold: no text, and the line feed."""
        self.known: dict[str, int] = {"": 0, "\n": 1}
        self.ids, n = self._encode(["", "\n"])
        self.at = ragged(n)
        self.used = np.zeros(2, bool)  # met again since they came

    def _thin(self) -> None:
        """Drops the pieces that were not met again (most are one of a kind); all of them if that leaves too many."""
        self.used[:2] = True
        keep = np.flatnonzero(self.used)
        if len(keep) > self.most // 2:
            self._forget()
            return
        words, n = list(self.known), np.diff(self.at)[keep]  # places follow the order of insertion
        self.known = dict(zip([words[k] for k in keep.tolist()], range(len(keep)), strict=True))
        self.ids, self.at, self.used = self.ids[ranges(self.at[keep], n)], ragged(n), np.zeros(len(keep), bool)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, some at a time: the library's encodings take far more memory than their ids."""
        ids, n = [np.zeros(0, np.uint16)], np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and to - at < PART_TEXTS and (to == at or size + len(texts[to]) <= PART_CHARS):
                size += len(texts[to])
                to += 1
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts[at:to], add_special_tokens=False)]
            n[at:to] = list(map(len, found))
            ids.append(np.fromiter(chain.from_iterable(found), np.uint16, int(n[at:to].sum())))
            at = to
        return np.concatenate(ids), n

    def _model(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens and how many each has, some at a time: the library's tokens take far more memory than their ids."""
        ids, n = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
        for k in range(0, len(tokens), PART_TEXTS):
            some = tokens[k : k + PART_TEXTS]
            found = list(map(self.model.tokenize, codecs.charmap_decode("\n".join(some).encode(), "strict", self.letters)[0].split(self.letters[10])))
            n.append(np.fromiter(map(len, found), np.int64, len(some)))
            ids.append(np.fromiter(map(_ID, chain.from_iterable(found)), np.uint16, int(n[-1].sum())))
        return np.concatenate(ids), np.concatenate(n)

    def _words(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """For each piece the word that it begins with, or the whole piece; whether that is letters alone (one pre-token); the bytes of marks after it."""
        if not self.direct:
            return pieces, np.zeros(len(pieces), bool), np.zeros(len(pieces), np.int64)
        core = pc.ascii_rtrim(pieces, MARKS)
        bare = pc.ascii_ltrim(core, " ") if self.spaced else core
        letters = pc.utf8_is_alpha(bare).to_numpy(zero_copy_only=False)
        odd = np.flatnonzero(letters & ~pc.string_is_ascii(bare).to_numpy(zero_copy_only=False))
        size = pc.binary_length(core).to_numpy()
        if not self.spaced:
            core = pc.ascii_lower(core)
        if len(odd):
            words = _strings(bare.take(pa.array(odd)))
            if self.spaced:
                letters[odd] = list(map(str.isalpha, words))
            else:
                lower = [w.lower() if unicodedata.is_normalized("NFC", w) and "\u03a3" not in w else "" for w in words]
                letters[odd] = list(map(str.isalpha, lower))
                mask = np.zeros(len(pieces), bool)
                mask[odd] = True
                core = pc.replace_with_mask(core, pa.array(mask), pa.array(lower, core.type))
        return pc.if_else(pa.array(letters), core, pieces), letters, np.where(letters, pc.binary_length(pieces).to_numpy() - size, 0)

    def _marks(self, pieces: pa.Array, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the different marks, where each one's begin, and for each piece with marks (its last `size` bytes) which it has."""
        b, o = flat(pieces)
        rows = np.flatnonzero(size)
        n = size[rows]
        at, data = ragged(n), b[ranges(o[1:][rows] - n, n)]
        found = pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(at), pa.py_buffer(data)).dictionary_encode()
        ids, n = self._model(found.dictionary.to_pylist()) if len(rows) else self._encode([])
        return ids, ragged(n), found.indices.to_numpy()

    def _encode_rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same, ROW pieces in one text; rows that do not come apart into as many are encoded singly."""
        if self.mark is None:
            return self._encode(words)
        rows = [words[k : k + ROW] for k in range(0, len(words), ROW)]
        ids, n = self._encode([self.between.join(r) for r in rows])
        at, ends, out, sizes = ragged(n), ids == self.mark, [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
        for k, row in enumerate(rows):
            own, cut = ids[at[k] : at[k + 1]], ends[at[k] : at[k + 1]]
            size = np.diff(np.concatenate([[-1], np.flatnonzero(cut), [len(own)]])) - 1
            own = own[~cut]
            if len(size) != len(row):
                own, size = self._encode(row)
            out.append(own)
            sizes.append(size)
        return np.concatenate(out), np.concatenate(sizes)

    def _places(self, words: list[str], letters: np.ndarray) -> np.ndarray:
        """Places of the (different) words in the cache, which takes up those it lacks; `letters` tells which are one pre-token."""
        if len(self.known) > self.most:
            self._thin()
        where = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        self.used[where[where >= 0]] = True
        for lacking, encode in ((np.flatnonzero((where < 0) & letters), self._model), (np.flatnonzero((where < 0) & ~letters), self._encode_rows)):
            if len(lacking):
                new = [words[k] for k in lacking.tolist()]
                ids, n = encode(new)
                where[lacking] = np.arange(len(new)) + len(self.at) - 1
                self.known.update(zip(new, where[lacking].tolist(), strict=True))
                self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(n)])
                self.ids = np.concatenate([self.ids, ids])
                self.used = np.concatenate([self.used, np.zeros(len(new), bool)])
        return where

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the (different) pieces in a row, and where each one's begin (one more than pieces)."""
        core, letters, marked = self._words(pieces)
        words = core.dictionary_encode()
        which = words.indices.to_numpy()
        one = np.zeros(len(words.dictionary), bool)
        one[which[letters]] = True
        where = self._places(_strings(words.dictionary), one)[which]
        ids, at, of = self._marks(pieces, marked)
        start, n = np.zeros((len(pieces), 2), np.int64), np.zeros((len(pieces), 2), np.int64)
        start[:, 0], n[:, 0] = self.at[where], self.at[where + 1] - self.at[where]
        rows = np.flatnonzero(marked)
        start[rows, 1], n[rows, 1] = at[of] + len(self.ids), at[of + 1] - at[of]
        return np.concatenate([self.ids, ids])[ranges(start.ravel(), n.ravel())], ragged(n.sum(axis=1))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        lengths = np.zeros(len(texts), np.int64)
        plain = np.flatnonzero(~odd)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        if len(plain):
            some = texts.take(pa.array(plain))
            if pc.any(pc.match_substring(some, "\x01")).as_py():
                return self._whole(texts)
            if self.spaced:  # \x01 marks the cuts: the piece after it begins with its space, or is a line feed
                marked = pc.replace_substring(pc.replace_substring(some, " ", "\x01 "), "\n", "\x01\n\x01")
            else:
                marked = pc.replace_substring(pc.replace_substring(some, "\n", "\x01"), " ", "\x01")
            lists = pc.split_pattern(marked, "\x01")
            words = lists.flatten().dictionary_encode()
            known, at = self._pieces(words.dictionary)
            where = words.indices.to_numpy()
            n = np.diff(at)[where]
            total = ragged(n)
            offsets = lists.offsets.to_numpy()
            offsets = offsets - offsets[0]
            lengths[plain] = total[offsets[1:]] - total[offsets[:-1]]
            out.append((plain, known[ranges(at[where], n)]))
        rest = np.flatnonzero(odd)
        if len(rest):
            ids, n = self._encode(texts.take(pa.array(rest)).to_pylist())
            lengths[rest] = n
            out.append((rest, ids))
        if len(out) == 1:
            return out[0][1], lengths
        at = ragged(lengths)
        ids = np.zeros(at[-1], np.uint16)
        for rows, part in out:
            ids[ranges(at[rows], lengths[rows])] = part
        return ids, lengths

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self._encode(texts.to_pylist())


@lru_cache(maxsize=2)
def encoder(path: str) -> WordCache:
    """One cache for each worker process and file."""
    return WordCache(path)


def with_end(ids: np.ndarray, lengths: np.ndarray, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """The ids with the end id after each text, and the offsets of the texts."""
    at = ragged(lengths + 1)
    out = np.full(at[-1], end, np.uint32)
    body = np.ones(len(out), bool)
    body[at[1:] - 1] = False
    out[body] = ids
    return out, at


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)
