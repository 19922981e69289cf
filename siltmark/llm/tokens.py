"""Fast exact encoding with public tokenizer files: words are encoded once and cached."""

from __future__ import annotations

import contextlib
import gc
import json
import os
import re
import string
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from siltmark.llm.memory import give_back

TWO_SPACES = re.compile(r"\s\s")
#: ASCII punctuation but the apostrophe, which may begin a pre-token of its own.
MARKS = "".join(c for c in string.punctuation if c != "'")
#: Words of letters below U+0130, as RE2 writes it.
LETTERS = "^[" + "".join(c for c in map(chr, range(0x130)) if c.isalpha()) + "]+$"
#: Texts of about so many bytes are cut into words at once.
SLICE_BYTES = 8 << 20
#: What a worker's caches of words may take, in bytes, and what an entry takes besides its characters and ids.
CACHE_BYTES, ENTRY_BYTES = 128 << 20, 180
#: What they may take in a worker that keeps its encoder.
KEPT_BYTES = 48 << 20


def _byte_letters() -> dict[int, int]:
    """Byte to letter as byte-level tokenizers write it: printable Latin-1 stays, others follow from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: b if b in shown else 256 + rest.index(b) for b in range(256)}


def _packed(ids: list[int]) -> bytes:
    out = array("H", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _listed(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()  # to_pylist makes a scalar of each first


class _Words(dict):
    """Ids (little-endian unsigned 16 bits) by word; ``lead`` stands before each word in its text.

    ``room`` is a list of one number, the bytes that may still be kept; caches may share it.
    """

    def __init__(self, tokenizer, lead: str, lower: bool, room: list[int]):
        super().__init__()
        self.tokenizer, self.lead, self.lower = tokenizer, lead, lower
        self.model, self.letters = tokenizer.model, _byte_letters()
        self.lead_letters = lead.translate(self.letters)
        self.tokenize, self.room = self.model.tokenize, room
        self.pair = [i.to_bytes(2, "little") for i in range(tokenizer.get_vocab_size())]
        self.marks: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _keep(self, word: str, ids: bytes) -> None:
        if self.room[0] > 0:
            self.room[0] -= ENTRY_BYTES + len(word) + len(ids)
            self[word] = ids

    def _letters(self, texts: list[str]) -> list[bytes]:
        """Ids of pre-tokens of letters below U+0130."""
        letters, lead, pair = self.letters, self.lead_letters, self.pair
        plain = [lead + (t if t.isascii() else t.encode().decode("latin-1").translate(letters)) for t in texts]
        return [b"".join([pair[t.id] for t in tokens]) for tokens in map(self.tokenize, plain)]

    def _marks(self, tail: str) -> bytes:
        mark = self.marks.get(tail)
        if mark is None:
            mark = self._encode(tail)
            if len(self.marks) < 10_000:
                self.marks[tail] = mark
        return mark

    def __missing__(self, word: str) -> bytes:
        # Letters below U+0130 are one pre-token, and marks behind them another: the letters go to the model as they are.
        stem = word.rstrip(MARKS)
        if stem.isalpha() and (stem.isascii() or max(stem) < "İ"):
            text = stem.lower() if self.lower else stem
            ids = self.get(text)  # the same letters may have been seen with other marks or in another case
            if ids is None:
                ids = self._letters([text])[0]
                if text != word:
                    self._keep(text, ids)
            if tail := word[len(stem) :]:
                ids += self._marks(tail)
        else:
            ids = self._encode(self.lead + word)
        self._keep(word, ids)
        return ids

    def of(self, words: pa.Array) -> pa.Array:
        """Ids of each of ``words``, which are all different; letters that words share are encoded and kept once."""
        stems = pc.utf8_rtrim(words, characters=MARKS)
        plain = pc.match_substring_regex(stems, LETTERS)
        chosen = stems.filter(plain)
        chosen = (pc.utf8_lower(chosen) if self.lower else chosen).dictionary_encode()
        texts = _listed(chosen.dictionary)
        found = list(map(self.get, texts))
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = [texts[i] for i in missing]
        coded = self._letters(new)
        for i, ids in zip(missing, coded):
            found[i] = ids
        size = len(new) * ENTRY_BYTES + sum(map(len, new)) + sum(map(len, coded))
        share = min(1.0, max(0, self.room[0]) / max(1, size))
        self.update(zip(new[: int(len(new) * share)], coded))  # those that were met first, as they are the common ones
        self.room[0] -= int(size * share)
        heads = pa.array(found, pa.binary()).take(chosen.indices)
        full, bare = words.filter(plain), np.asarray(pc.utf8_length(stems.filter(plain)))
        marked = np.asarray(pc.utf8_length(full)) > bare
        marks, number = self._marks, np.zeros(len(full), np.int64)
        tails = [b"", *[marks(w[n:]) for w, n in zip(_listed(full.filter(pa.array(marked))), bare[marked].tolist())]]
        number[marked] = np.arange(1, len(tails))
        tails = pa.array(tails, pa.binary()).take(pa.array(number))
        odd = pa.array(map(self.__getitem__, _listed(words.filter(pc.invert(plain)))), pa.binary())
        mask = np.asarray(plain)
        place = np.empty(len(words), np.int64)
        place[mask], place[~mask] = np.arange(len(full)), np.arange(len(full), len(words))
        return pa.concat_arrays([pc.binary_join_element_wise(heads, tails, pa.scalar(b"", pa.binary())), odd]).take(pa.array(place))


@contextlib.contextmanager
def no_collection() -> Iterator[None]:
    """No cyclic garbage collection: it would walk the caches over and over, and encoding makes no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def drops_space(tokenizer) -> bool:
    """Whether a file lower-cases and drops white space; False for a plain byte-level file. Others raise ValueError."""
    normal, pre = (json.loads(x.__getstate__()) if x else None for x in (tokenizer.normalizer, tokenizer.pre_tokenizer))
    pre = pre or {}
    steps = [normal, *normal.get("normalizers", [])] if normal else []
    cuts = [pre, *pre.get("pretokenizers", [])]
    levels = [c for c in cuts if c.get("type") == "ByteLevel"]
    if not steps and len(cuts) == len(levels) == 1 and not levels[0]["add_prefix_space"] and levels[0].get("use_regex", True):
        return False
    splits = [c for c in cuts if c.get("type") == "Split" and c["behavior"] == "Removed" and c["invert"]]
    if any(x["type"] == "Lowercase" for x in steps) and levels and splits and not any(c["add_prefix_space"] or c.get("use_regex", True) for c in levels):
        return True
    raise ValueError("a tokenizer file of another kind")


class Encoder:
    """``ids(text)`` equals ``encode(text, add_special_tokens=False).ids`` of the tokenizers library.

    Words are cut only where the tokenizer itself always cuts: at spaces and line ends. That
    is known for two kinds of files, and any other is refused: a file whose normalizer
    lower-cases and whose pre-tokenizer drops white space (a word's ids then don't depend on what
    stands around it), and a byte-level file without a normalizer, which gives a
    single space to the word after it. Texts with two white-space characters in a row are
    encoded as they are by a byte-level file.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.drops_space = drops_space(self.tokenizer)
        room = [cache_bytes]
        self.first = _Words(self.tokenizer, "", self.drops_space, room)
        self.later = self.first if self.drops_space else _Words(self.tokenizer, " ", False, room)
        self.line_end = b"" if self.drops_space else self.first._encode("\n")

    def ids(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 16 bits; null counts as empty."""
        if not text:
            return b""
        if self.drops_space:
            return b"".join(map(self.first.__getitem__, text.replace("\n", " ").split(" ")))
        if TWO_SPACES.search(text):
            return self.first._encode(text)
        lines = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            lines.append(self.first[head] + b"".join(map(self.later.__getitem__, rest)))
        return self.line_end.join(lines)

    def ids_of(self, texts: pa.Array) -> Iterator[bytes]:
        """``ids`` of each text. Where a file drops white space, different words are encoded once a slice of texts and taken by number."""
        if not self.drops_space:
            yield from map(self.ids, texts.to_pylist())
            return
        texts = pc.fill_null(texts, "")
        before = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:]):
            lists = pc.split_pattern(pc.replace_substring(texts.slice(a, b - a), "\n", " "), " ")
            words = lists.flatten().dictionary_encode()
            ids = self.first.of(words.dictionary).take(words.indices)
            ends = np.append(0, np.cumsum(np.asarray(pc.binary_length(ids)), dtype=np.int64))
            ends = ends[np.append(0, np.cumsum(np.asarray(lists.value_lengths()), dtype=np.int64))].tolist()
            data = ids.buffers()[2]
            data = data.to_pybytes() if data else b""
            yield from (data[x:y] for x, y in zip(ends, ends[1:]))


_KEPT: dict[str, Encoder] = {}


def kept_encoder(path: str) -> Encoder:
    """An encoder that stays with its worker from task to task, so that words which one task has met are not encoded again by the next; ``forget`` lets it go."""
    if path not in _KEPT:
        forget()
        _KEPT[path] = Encoder(path, KEPT_BYTES)
    return _KEPT[path]


def forget() -> None:
    """Frees what ``kept_encoder`` has kept in this worker."""
    if _KEPT:
        _KEPT.clear()
        give_back()


@contextlib.contextmanager
def encoder(path: str) -> Iterator[Encoder]:
    """An encoder for a task: what it keeps goes with the task, as the worker may next serve an operator that needs the room."""
    own = Encoder(path)
    try:
        yield own
    finally:
        for words in (own.first, own.later):
            words.clear()
        give_back()


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
