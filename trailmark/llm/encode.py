"""Encoding with the ``tokenizers`` library, a call for each new word instead of each text.

The two byte-level BPE vocabularies in use split a text before each space that follows another
character than white space, and at each line end between others; the words between such points
encode alike wherever they stand. So do words and a full stop or comma after them, which are parted
first, as they would make most words twice. Arrow splits the texts and numbers their distinct
words; ids of words are kept, up to ``KEEP`` of them for a Python worker, and gathered into the ids of texts.
Texts for which the split is not certain (runs of white space, unusual white space or spellings
of special tokens) are encoded whole. Of new words, those of Latin letters and common marks are
parted into the vocabulary's runs here and go to the library's model; it parts the others itself.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textops as X

KEEP = 400_000
#: text that is encoded at once: more would share more words and take more memory
ENCODE_BYTES = 2 << 20
#: stands before a mark that follows its word without a space; texts that hold it are encoded whole
GLUE = "\x01"
#: bytes that may start white space other than the space and the line end, a special token or GLUE
_LEADS = np.zeros(256, bool)
_LEADS[[ord(GLUE), *range(0x09, 0x0E), *range(0x1C, 0x20), 0x3C, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_LEADS[0x0A] = False
_BLANK = np.zeros(256, bool)
_BLANK[[0x0A, 0x20]] = True
#: what they start, where it is longer than a byte
_ODD = frozenset([b"<|", *(chr(c).encode() for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))])


def _odd(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts in which the split is not certain, by their bytes."""
    at = np.flatnonzero(_LEADS[data])
    lead = data[at]
    single = at[lead < 0x20]
    rest = at[lead >= 0x20]
    end = np.minimum(rest + np.where(data[rest] < 0xE0, 2, 3), len(data))
    raw = data.tobytes() if len(rest) else b""
    longer = [i for i, j in zip(rest.tolist(), end.tolist(), strict=True) if raw[i:j] in _ODD]
    blank = _BLANK[data]
    both = np.flatnonzero(blank[:-1] & blank[1:]) if len(data) else single
    both = both[np.searchsorted(off, both, "right") == np.searchsorted(off, both + 1, "right")]  # in one text
    places = np.concatenate((single, np.array(longer, np.int64), both))
    return np.unique(np.searchsorted(off, places, "right") - 1)


_encoders: dict[str, Encoder] = {}


def _steady(letter: str) -> bool:
    """A letter that normalisation and folding leave one letter, so that a mark after it is a word of its own."""
    low = letter.lower()
    return letter.isalpha() and len(low) == 1 and low.isalpha() and unicodedata.is_normalized("NFC", letter) and unicodedata.is_normalized("NFC", low)


#: the last two bytes of words that end in such a letter of the Latin script; marks after others stay with their words
_ENDS = np.zeros(1 << 16, bool)
for _c in filter(_steady, map(chr, range(0x250))):
    _ENDS[(np.arange(256) << 8) + ord(_c) if _c.isascii() else int.from_bytes(_c.encode())] = True


def _parted(column: pa.Array) -> pa.Array:
    """The texts with full stops and commas that end a word after a steady letter as words of their own, led by ``GLUE``."""
    data, off = X.raw(column)
    at = np.flatnonzero((data == 0x2E) | (data == 0x2C))
    to = off[np.searchsorted(off, at, "right")]  # where their texts end
    at = at[(off[np.searchsorted(off, at)] != at) & ((at + 1 == to) | _BLANK[data[np.minimum(at + 1, len(data) - 1)]])]
    at = at[_ENDS[(data[at - 2].astype(np.int64) << 8) | data[at - 1]]]
    data = np.insert(data, np.repeat(at, 2), np.tile(np.array([0x20, ord(GLUE)], np.uint8), len(at)))
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(off + 2 * np.searchsorted(at, off)), pa.py_buffer(data))


#: words of visible characters below U+0250, which normalisation leaves as they are and folding maps one to one
_PLAIN = re.compile("[!-~\xa1-\xac\xae-\u012f\u0131-\u024f]*")


def _runs(folds: bool) -> re.Pattern[str]:
    """The pattern by which a vocabulary parts texts, for such words, folded or with a space before them."""
    letter, number = (re.escape("".join(sorted({x for c in map(chr, range(0x250)) if _PLAIN.fullmatch(c) and unicodedata.category(c)[0] == k for x in (c, c.lower())}))) for k in "LN")
    if folds:
        return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\\s{letter}{number}]+")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^\\s{letter}{number}]+|\\s+")


class Encoder:
    def __init__(self, path: str, keep: int = KEEP):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must be below 65,536")
        self.model = self.tokenizer.model
        self.folds = self.tokenizer.normalizer is not None  # folds case and drops white space
        self.runs = _runs(self.folds)
        self.letters = str.maketrans({chr(b): c for b, c in zip(range(256), _byte_letters(), strict=True)})
        self.end = b"" if self.folds else self.whole(["\n"])[0].tobytes()
        self.marks = {GLUE + m: self.whole([m])[0].tobytes() for m in ".,"}
        self.keep, self.kept = keep, dict(self.marks)  # ids of words after a space

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u2") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, words: list[str], before: str) -> list[bytes]:
        """Ids of words, each after ``before``. One run of letters is one word of the model in both vocabularies."""
        tokenize, letters, folds, mark = self.model.tokenize, self.letters, self.folds, before.translate(self.letters)
        plain, runs = _PLAIN.fullmatch, self.runs.findall
        flat, ends, rest = [], [0], []
        for at, p in enumerate(words):
            if p.isascii() and p.isalpha():
                flat += [t.id for t in tokenize(p.lower() if folds else mark + p)]
            elif plain(p):
                p = p.lower() if folds else before + p
                for run in [p] if p[len(before) :].isalpha() else runs(p):
                    flat += [t.id for t in tokenize(run.encode().decode("latin-1").translate(letters))]
            else:
                rest.append(at)
            ends.append(len(flat))
        packed = np.array(flat, "<u2").tobytes()
        out = [packed[2 * a : 2 * b] for a, b in zip(ends, ends[1:])]  # noqa: B905
        for at, ids in zip(rest, self.whole([before + words[i] for i in rest]), strict=True):
            out[at] = ids.tobytes()
        return out

    def _ids(self, words: list[str], kept: dict[str, bytes], before: str) -> list[bytes]:
        """Ids of words, each after ``before``: those kept from earlier texts, and the others'."""
        out = list(map(kept.get, words))
        at = [i for i, ids in enumerate(out) if ids is None]
        if at:
            new = [words[i] for i in at]
            own = self._new(new, before)
            for i, ids in zip(at, own, strict=True):
                out[i] = ids
            if len(kept) + len(own) <= self.keep:
                kept.update(zip(new, own, strict=True))
        return out

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """Ids of each text, as little-endian unsigned 16-bit numbers. Give a few MB at a time; nulls are not taken."""
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
        out: list[np.ndarray] = [np.zeros(0, "<u2")] * len(column)
        odd = _odd(*X.raw(column))
        for i, ids in zip(odd.tolist(), self.whole(column.take(pa.array(odd)).to_pylist()), strict=True):
            out[i] = ids
        certain = np.setdiff1d(np.arange(len(column)), odd)
        if not len(certain):
            return out
        if len(odd):
            column = column.take(pa.array(certain))
        certain, column = certain.tolist(), _parted(column)
        split = pc.split_pattern(pc.replace_substring(column, "\n", " " if self.folds else " \n "), " ")
        ptr = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.folds:
            ids = self._ids(words, self.kept, "")
        else:
            breaks = code == (words.index("\n") if "\n" in words else -1)
            first = np.zeros(len(code), bool)  # words without a space before them
            first[ptr[:-1]] = True
            first[1:] |= breaks[:-1]
            at = np.flatnonzero(first & ~breaks)
            n = len(words)
            leading, number = np.unique(code[at], return_inverse=True)
            words += [words[c] for c in leading.tolist()]
            rest = np.unique(code[~first & ~breaks])
            ids = [self.end] * n + self._ids(words[n:], dict(self.marks), "")
            for c, x in zip(rest.tolist(), self._ids([words[c] for c in rest.tolist()], self.kept, " "), strict=True):
                ids[c] = x
            if breaks.any():
                ids[words.index("\n")] = self.end
            code[at] = n + number
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        flat, start = np.frombuffer(b"".join(ids), "<u2"), np.cumsum(size) - size
        own = size[code]
        until = np.concatenate(([0], np.cumsum(own)))
        ids_of_all = flat[np.repeat(start[code] - until[:-1], own) + np.arange(until[-1])]
        for i, a, b in zip(certain, until[ptr[:-1]].tolist(), until[ptr[1:]].tolist(), strict=True):
            out[i] = ids_of_all[a:b]
        return out


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: its own where it is visible in Latin-1, else from 256 on in order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


def encoder(path: str, keep: int = KEEP) -> Encoder:
    """One for each worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, keep)
    return _encoders[path]
