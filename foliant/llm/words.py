"""A word-level front of a public BPE tokenizer file, exact for whole texts.

ASCII space and line feed always separate tokens of this kind of tokenizer (its
normaliser composes nothing across them and no pattern branch matches them), so
a text's ids are its pieces' ids in order.  Pieces repeat; each process keeps a
bounded dictionary of those it has met and asks the ``tokenizers`` library for
the others.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer, models

#: Characters whose composition, lower case and classes agree in Python and in
#: the library: printable ASCII and the Latin letters of U+00C0 to U+024F.
PLAIN = re.compile(r"[!-~À-ɏ]+").fullmatch
#: First of the private characters that stand for added tokens in a stream.
MARK = 0xE000


def byte_letters() -> list[str]:
    """A visible character for every byte: itself if printable, else from U+0100 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in seen else next(spare)) for b in range(256)]


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class Bounded(dict):
    """A dictionary that computes what it lacks and starts anew when it holds ``most`` bytes.

    Long keys are computed each time and never held.
    """

    LONG, EACH = 200, 150  # bytes of an entry besides its key and value

    def __init__(self, make, most: int):
        self.make, self.most, self.held = make, most, 0

    def __missing__(self, key):
        value = self.make(key)
        if len(key) > self.LONG:
            return value
        self.held += self.EACH + len(key) + (32 if isinstance(value, int) else len(value))
        if self.held > self.most:
            self.clear()
            self.held = 0
        self[key] = value
        return value


#: Pieces whose ids are gathered at once.
GATHERED = 1 << 18


class WordBpe:
    """``kept`` bounds the bytes of each dictionary; it changes speed, never ids."""

    def __init__(self, path: str, kept: int = 64_000_000):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.spec = spec["model"]
        self.end = self.spec.get("end_of_word_suffix") or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")").split
        self.find = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        letters = byte_letters()
        self.letter = {b: c for b, c in enumerate(letters)}
        self.marks = {chr(MARK + k): i for k, i in enumerate(self.added.values())}
        self.mark_of = {c: chr(MARK + k) for k, c in enumerate(self.added)}
        self.model = self.library.model
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.strings = [self.library.id_to_token(i) for i in range(size)]
        self.streams = Bounded(self._stream, kept)
        self.ids = Bounded(self._ids, kept)
        self.pieces = Bounded(self._piece, kept)

    # pieces -> tokens before merging ------------------------------------------------
    def _plain(self, piece: str) -> list[str]:
        if piece.isalpha():
            if piece.isascii():
                return [piece.lower()]
            if PLAIN(piece) and (low := piece.lower()).isalpha():
                return [low.encode().decode("latin-1").translate(self.letter)]
        elif piece[-1] in ".," and (word := piece[:-1]).isalpha() and word.isascii():
            return [word.lower(), piece[-1]]
        if PLAIN(piece):
            found = self.find(piece.lower())
            return [x if x.isascii() else x.encode().decode("latin-1").translate(self.letter) for x in found]
        return [x for x, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))]

    def _stream(self, piece: str) -> str:
        """The piece's unmerged tokens as visible byte letters, a space after each."""
        if "<" in piece:
            parts = self.split_added(piece)
            out = [x for k, part in enumerate(parts) if part for x in ([self.mark_of[part]] if k % 2 else self._plain(part))]
        else:
            out = self._plain(piece) if piece else []
        return "".join(f"{x} " for x in out)

    def stream(self, text: str) -> str:
        return "".join(map(self.streams.__getitem__, text.replace("\n", " ").split(" ")))

    # merging ------------------------------------------------------------------------
    def _ids(self, word: str) -> bytes:
        if word in self.marks:
            return packed([self.marks[word]])
        return packed([t.id for t in self.model.tokenize(word)]) if word else b""

    def _piece(self, piece: str) -> bytes:
        if not piece:
            return b""
        words = self._stream(piece).split(" ") if "<" in piece else self._plain(piece)
        return self.ids[words[0]] if len(words) == 1 else b"".join(map(self.ids.__getitem__, words))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a batch, end to end, and how many each has.

        Arrow splits the texts and numbers their distinct pieces, so the dictionary is
        asked once for each of those.  It holds those that the batch has more than once.
        """
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        known, again = self.pieces.get, np.bincount(which, minlength=len(coded.dictionary)) > 1
        found = []
        for piece, held in zip(coded.dictionary.to_pylist(), again.tolist(), strict=True):
            ids = known(piece)
            found.append(ids if ids is not None else self.pieces[piece] if held else self._piece(piece))
        sizes = np.fromiter((len(x) // 4 for x in found), np.int64, len(found))
        flat, starts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        ends = np.cumsum(np.r_[0, sizes[which]])
        ids = np.empty(int(ends[-1]), "<u4")
        for k in range(0, len(which), GATHERED):
            part = which[k : k + GATHERED]
            first = ends[k : k + len(part)]
            last = ends[k + len(part)]
            ids[first[0] : last] = flat[np.repeat(starts[part] - first, sizes[part]) + np.arange(first[0], last)]
        return ids, np.diff(ends[np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]])

    # words without an end ------------------------------------------------------------
    @property
    def open_model(self):
        """The same merges for a run of letters that does not end its word."""
        if not hasattr(self, "_open"):
            merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in self.spec["merges"]]
            self._open = models.BPE(vocab=self.spec["vocab"], merges=merges)
        return self._open


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One encoder for each process and file."""
    return WordBpe(path)
