"""Whole-text encoding with the ``tokenizers`` library, one word at a time through a cache.

Both public vocabularies split a text into pre-tokens before any merge is tried, and no
pre-token reaches over the cuts made here, so the ids of a text are the ids of its cuts
put together:

* byte-level BPE: a blank or line feed after a character that is not white space always
  opens a new pre-token (a pre-token holds a blank only in front);
* word-end BPE: white space is dropped, so every ASCII blank separates pre-tokens.

A worker splits a text into words, joins cached id bytes, and runs the library's BPE model
once per distinct pre-token. Words with characters above U+017F go through the library's
whole call, so no Unicode table of another library decides about them; texts that hold the
string of an added token (``<|endoftext|>``) do as well, and get its id there. Many texts
are encoded together: Arrow splits them and names their distinct words, and only these pass
through the cache (``encode_many``). The caches hold
at most two generations of ``max_words`` words and ``max_lines`` lines; results do not depend on that.
``tests/llm/test_tokens.py`` compares with the library's own whole-text call.
"""

from __future__ import annotations

import gc
import os
import sys
from array import array
from contextlib import contextmanager
from itertools import repeat
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# The pre-token patterns named in the two vocabulary files.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_RUN = regex.compile(r"\s[ \n]|^[ \n]|\s$")  # white space next to a cut: split with care
_CUT = regex.compile(r"(?<=\S)(?=[ \n])", regex.V1)
# White space other than the blank and the line feed.
_OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_ASCII_SPACE = _OTHER_SPACE[:8]
LAST = "\u017f"  # up to here letters are the same in every Unicode version
_STOPS = frozenset(".,")
MANY_CHARS = 16 << 20  # texts encoded together; a longer one is encoded alone


def _byte_chars() -> dict[int, int]:
    """Byte -> character of the byte-level alphabet: printable Latin-1 stays, the other
    bytes follow from U+0100 on in ascending order."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: b for b in keep} | {b: 256 + i for i, b in enumerate(rest)}


def _runs(text: str) -> bool:
    """Whether white space stands next to a cut (or at an end). Searches for fixed strings rule
    that out for most texts; the pattern decides only about the others."""
    if " \n" in text or "  " in text or "\n " in text or "\n\n" in text or text[0] in " \n" or text[-1].isspace():
        return True
    others = _ASCII_SPACE if text.isascii() else _OTHER_SPACE
    return any([c in text for c in others]) and _RUN.search(text) is not None


class _Words(dict):
    """word -> id bytes, filled on demand; two generations, so that frequent words outlive
    the emptying at ``bound`` entries."""

    def __init__(self, make, bound: int):
        super().__init__()
        self.make, self.bound, self.old = make, bound, {}

    def peek(self, word: str) -> bytes:
        """The id bytes of ``word``, made if need be but not kept."""
        out = self.get(word)
        if out is None:
            out = self.old.get(word)
        return self.make(word) if out is None else out

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            out = self.make(word)
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        self[word] = out
        return out


class WordEncoder:
    """Encodes texts to little-endian id bytes (uint16, or uint32 for large vocabularies)."""

    def __init__(self, path: str, max_words: int = 200_000, max_lines: int = 4_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per Spark task
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        added = self.tok.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        self.whole = any(t.normalized for t in added)  # found only after normalizing: no search here
        wide = self.tok.get_vocab_size() > 1 << 16
        self.dtype, self.code = np.dtype("<u4" if wide else "<u2"), "I" if wide else "H"
        self.model = self.tok.model
        self.drops_space = self.model.end_of_word_suffix is not None
        self.find = regex.compile(WORD_PATTERN if self.drops_space else BYTE_PATTERN).findall
        self.table = _byte_chars()
        self.space = self.table[0x20] if not self.drops_space else None
        self.plain = _Words(self._cut, max_words)
        self.spaced = _Words(self._spaced_cut, max_words)
        self.lines = _Words(self._line, max_lines)
        self.prefix = chr(self.space) if self.space else ""
        self.stops = {c: self._cut(c) for c in _STOPS}
        self.tails = _Words(lambda rest: np.frombuffer(self._cut(rest), self.dtype).tolist(), max_words)
        self.feed_ids = np.frombuffer(self._cut("\n"), self.dtype).tolist()
        self._forget()

    def _spaced_cut(self, word: str) -> bytes:
        if word.isascii():
            if word.isalpha():  # one pre-token, no pattern needed
                return self._merge(self.prefix + word)
            if word[-1:] in _STOPS and word[:-1].isalpha():  # a letter run, then one stop
                return self.spaced.peek(word[:-1]) + self.stops[word[-1]]
        return self._cut(" " + word)

    def _cut(self, text: str) -> bytes:
        if not text.isascii() and max(text) > LAST:
            return self._pack(self.tok.encode(text, add_special_tokens=False).ids)
        if self.drops_space:
            text = text.lower()
            if text[-1:] in _STOPS and text[:-1].isalpha():
                return self.plain.peek(text[:-1]) + self.stops[text[-1]]
        if not text.isalpha():
            found = self.find(text)
            if len(found) != 1 or found[0] != text:
                return b"".join(map(self._cut, found))
        return self._merge(text.encode("utf-8").decode("latin-1").translate(self.table))

    def _merge(self, chars: str) -> bytes:
        return self._pack([t.id for t in self.model.tokenize(chars)])

    def _pack(self, ids: list[int]) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def encode(self, text: str | None) -> bytes:
        """The id bytes of the whole text; None is encoded as the empty text."""
        if not text:
            return b""
        if self.whole or any([t in text for t in self.added]):
            return self._pack(self.tok.encode(text, add_special_tokens=False).ids)
        if self.drops_space:
            try:  # lower case first where that is certain, so "The" and "the" are one entry
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
            return b"".join(map(self.lines.__getitem__, text.split("\n")))
        if _runs(text):
            return b"".join(map(self.plain.__getitem__, _CUT.split(text)))
        first, *rest = text.split("\n")
        return self.lines[first] + b"".join([self.lines["\n" + line] for line in rest])

    def _line(self, line: str) -> bytes:
        """Lines repeat in copies and shared passages, so they have a cache of their own."""
        if self.drops_space:
            return b"".join(map(self.plain.__getitem__, line.replace("\t", " ").split(" ")))
        first, *rest = line.split(" ")
        return self.plain[first] + b"".join(map(self.spaced.__getitem__, rest))

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """``encode`` of every text. Texts without white space next to a cut are taken together."""
        out: list[bytes | None] = [None] * len(texts)
        held, chars = [], 0
        for i, text in enumerate(texts):
            if not text or self.drops_space or self.whole or len(text) > MANY_CHARS or text[0].isspace() \
                    or _runs(text) or any([t in text for t in self.added]):
                out[i] = self.encode(text)
                continue
            if chars + len(text) > MANY_CHARS:
                self._encode_held(texts, held, out)
                held, chars = [], 0
            held.append(i)
            chars += len(text)
        if held:
            self._encode_held(texts, held, out)
        return out

    def _encode_held(self, texts: list[str | None], held: list[int], out: list[bytes | None]) -> None:
        """A line feed is put before every text, so that all words behind no blank begin with one;
        its ids, always a pre-token of their own before a character, are left out again."""
        words = pc.split_pattern(pa.array(["\n" + texts[i].replace("\n", " \n") for i in held], pa.string()), " ")
        named = words.values.dictionary_encode()
        word = self._numbers(named.dictionary.to_numpy(zero_copy_only=False).tolist())[named.indices.to_numpy()]
        n = self.word_size[word]
        end = np.cumsum(n)
        ids = self.word_ids[np.repeat(self.word_first[word] - end + n, n) + np.arange(end[-1])]
        ends = end[words.offsets.to_numpy()[1:] - 1]
        for i, a, b in zip(held, [0, *ends[:-1].tolist()], ends.tolist()):
            out[i] = ids[a + len(self.feed_ids):b].tobytes()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.word_first = self.word_size = np.zeros(0, np.int64)
        self.word_ids = np.zeros(0, self.dtype)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The numbers of distinct words, each behind a blank unless it begins with a line feed;
        the ids of number k are ``word_size[k]`` of ``word_ids`` from ``word_first[k]`` on."""
        if len(self.number) >= 2 * self.plain.bound:  # as many as the two generations hold
            self._forget()
        number = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(number < 0)
        new = [words[i] for i in unknown.tolist()]
        ids: list[int] = []
        ends: list[int] = []
        merged, table = self.model.tokenize, self.table
        for w in new:
            feed = w[:1] == "\n"
            run = (w[1:] if feed else w).rstrip(punctuation)
            if run.isalpha() and (run.isascii() or max(run) <= LAST):  # one pre-token, and one of the punctuation
                chars = run if run.isascii() else run.encode("utf-8").decode("latin-1").translate(table)
                if feed:
                    ids += self.feed_ids
                ids += [t.id for t in merged(chars if feed else self.prefix + chars)]
                rest = len(w) - len(run) - feed
                if rest:
                    ids += self.tails[w[-rest:]]
            else:
                ids += np.frombuffer(self._cut(w if feed else " " + w), self.dtype).tolist()
            ends.append(len(ids))
        known = len(self.number)
        number[unknown] = np.arange(known, known + len(new))
        self.number.update(zip(new, range(known, known + len(new))))
        size = np.diff(np.array([0, *ends], dtype=np.int64))
        self.word_first = np.concatenate([self.word_first, len(self.word_ids) + np.cumsum(size) - size])
        self.word_size = np.concatenate([self.word_size, size])
        self.word_ids = np.concatenate([self.word_ids, np.array(ids, dtype=self.dtype)])
        return number

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode(text), dtype=self.dtype)


@contextmanager
def no_gc():
    """Scanning the caches for cycles, of which they hold none, costs a fifth of an encoding
    task; the collector rests during the task and runs once at its end."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()
        gc.collect()


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, max_words: int = 200_000) -> WordEncoder:
    """The worker's encoder of that vocabulary file (kept while the worker lives)."""
    if (path, max_words) not in _ENCODERS:
        _ENCODERS[path, max_words] = WordEncoder(path, max_words)
    return _ENCODERS[path, max_words]


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
