"""Word-wise use of the tokenizers library, exact for whole texts.

The normaliser of the word-level vocabulary never joins characters across a
space and its pre-tokeniser drops white space, so the ids of a text are the ids
of its space-separated chunks in order. Chunks repeat, hence a memo.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from itertools import accumulate

import numpy as np
import regex

from chronosift.llm.common import SPACES, Memo

WORD_BPE = "word_bpe_49k.json"
#: Printable ASCII but "<" (special strings start with it) and Latin letters: lower case and composed form are one character each.
_PLAIN = re.compile(r"[!-;=-~À-ÖØ-öø-ÿ]*\Z")
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


@lru_cache(maxsize=1)
def _byte_alphabet() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the
    others for the characters from U+0100 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, n = [], 0
    for b in range(256):
        out.append(chr(b) if b in plain else chr(256 + n))
        n += b not in plain
    return out


def _alphabet(word: str) -> str:
    if word.isascii() and word.isprintable():
        return word
    a = _byte_alphabet()
    return "".join([a[b] for b in word.encode()])


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, on whichever machine this runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def library(name: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def vocabulary_size(name: str) -> int:
    return library(name).get_vocab_size(with_added_tokens=True)


@lru_cache(maxsize=4)
def chunk_ids(name: str, limit: int = 500_000) -> Memo:
    """chunk -> its ids as little-endian unsigned 32-bit integers."""
    t = library(name)
    tokenize = t.model.tokenize
    word = Memo(lambda w: b"".join([x.id.to_bytes(4, "little") for x in tokenize(_alphabet(w))]), limit)

    def compute(chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            return word[chunk.lower()]
        if _PLAIN.match(chunk):
            words = _SPLIT.findall(chunk.lower())
            return word[words[0]] if len(words) == 1 else b"".join(map(word.__getitem__, words))
        if len(parts := chunk.encode().split()) > 1:  # line ends within
            return b"".join([memo[p.decode()] for p in parts])
        return np.asarray(t.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    memo = Memo(compute, limit)
    return memo


def encode(text: str, memo: Memo) -> bytes:
    """All ids of a text as little-endian unsigned 32-bit integers. White space
    of any kind parts the chunks: those around a line end would be new ones, as
    many as pairs of words meet there."""
    for c in SPACES[1:]:
        text = text.replace(c, " ")
    return b"".join(map(memo.__getitem__, text.split(" ")))


class PrefixCounts:
    """Exact token counts of every prefix of a word, by dynamic programming.

    A sequence of tokens is a merge encoding exactly when each token encodes to
    itself and each neighbouring pair does. Hence the encoding of a prefix is
    that of a shorter prefix plus one token, the only one that fits; word ends
    are an own layer, as the last symbol carries the end mark.
    """

    END = "</w>"

    def __init__(self, name: str, limit: int = 300_000):
        model = json.load(open(vocabulary(name), encoding="utf-8"))["model"]
        self.vocab = model["vocab"]
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.made = dict.fromkeys(self.vocab, -1)
        self.parts: dict[str, tuple[str, str]] = {}
        for pair, i in self.rank.items():
            if self.made.get(t := "".join(pair), 0) < 0 and t not in self.parts:
                self.made[t], self.parts[t] = i, pair
        self.kinds: dict[str, int] = {}  # characters of a token -> 1 within a word, 2 at its end, 3 both
        self.reach: dict[str, int] = {}  # last three characters -> length of the longest token that ends in them
        for v in self.vocab:
            ends = v.endswith(self.END) and v != self.END
            v = v.removesuffix(self.END) if ends else v
            self.kinds[v] = self.kinds.get(v, 0) | (2 if ends else 1)
            self.reach[v[-3:]] = max(self.reach.get(v[-3:], 2), len(v))
        self.fits = Memo(self._fits, 400_000, 10**9)
        self.of_word = Memo(self._of_word, limit)
        self.states: dict[str, tuple] = {}
        self.limit = 2 * limit
        self.whole = library(name)
        self.longest = max(self.reach.values())
        self.special = re.compile("|".join(re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()))

    def _fits(self, pair: tuple[str, str]) -> bool:
        """Whether two tokens side by side stay as they are. Going back in
        time, the later made of the two fragments at the border is taken apart;
        a merge across the border must not come before that moment. Of equal
        ranks the left one comes first."""
        a, b = pair
        rank, made, parts = self.rank, self.made, self.parts
        if not a:
            return True
        until = len(rank)
        while True:
            if rank.get((a, b), until) < until:
                return False
            ra, rb = made[a], made[b]
            if ra > rb:
                until, a = ra, parts[a][1]
            elif rb < 0:
                return True
            else:
                until, b = rb + 1, parts[b][0]

    def _of_word(self, chars: str) -> bytes:
        """Changes of the count from prefix to prefix of one pre-token, a byte
        per character. Words that begin alike share their states."""
        if chars[0] == "'" and len(chars) > 1 and chars[1:].isalpha():  # a contraction's prefixes are other pre-tokens
            return _changes(self._by_library(chars))
        word, states = _alphabet(chars), self.states
        if len(states) > self.limit:
            states.clear()
        path, out, done = [("", 0, 0)], [], 0
        for i in range(1, len(word) + 1):
            if i > 64:
                state = self._state(path, word, i)
            elif (state := states.get(prefix := word[:i])) is None:
                state = states[prefix] = self._state(path, word, i)
            path.append(state)
            out.append(state[2] - done & 255)
            done = state[2]
        if word is chars:
            return bytes(out)
        # symbols are bytes; prefixes end with whole characters
        return _changes([path[n][2] for n in accumulate([len(c.encode()) for c in chars])])

    def _state(self, path: list[tuple], word: str, i: int, before: int = 0) -> tuple:
        """State of a word's first i characters from those of its shorter
        prefixes: the last token and the count if the word goes on, the count
        if it ends. `word` may leave out its first `before` characters."""
        kinds, inner, closed, stop = self.kinds, None, None, i - before
        for j in range(max(0, i - self.reach.get(word[max(0, stop - 3) : stop], 2)), i):
            if not (kind := kinds.get(token := word[j - before : stop])):
                continue
            last, count, _ = path[j]
            if count is None:
                continue
            if kind & 2 and closed is None and self.fits[(last, token + self.END)]:
                closed = count + 1
            if kind & 1 and inner is None and self.fits[(last, token)]:
                inner = (token, count + 1)
            if inner and closed is not None:
                break
        if closed is None:
            raise ValueError(f"no encoding of {word!r}")
        return (*(inner or ("", None)), closed)

    def of_chunk(self, chunk: str) -> bytes:
        """Changes of the token count from prefix to prefix of a chunk without
        spaces, one signed byte per character."""
        if chunk.isascii() and chunk.isalpha():
            return self.of_word[chunk.lower()]
        return b"".join([bytes(len(p)) if p[0] in SPACES else self._words(p) if _PLAIN.match(p) else self._general(p) for p in _LINES.findall(chunk)])

    def _words(self, part: str) -> bytes:
        """A word's first character adds what it counts alone, as what comes before is complete."""
        words = _SPLIT.findall(part.lower())
        return self.of_word[words[0]] if len(words) == 1 else b"".join(map(self.of_word.__getitem__, words))

    def _general(self, part: str) -> bytes:
        """Any other characters: as words where normalisation keeps each
        character apart, else with special strings and composition followed
        character by character. Where the library counts the whole otherwise
        (other Unicode tables), prefix by prefix."""
        total = len(self.whole.encode(part, add_special_tokens=False).ids)
        if len(part.lower()) == len(part) and "<|" not in part and unicodedata.is_normalized("NFC", part):
            got = self._words(part)
            if len(got) == len(part) and np.frombuffer(got, np.int8).sum(dtype=np.int64) == total:
                return got
        counts = self._followed(part)
        return _changes(counts if counts[-1] == total else self._by_library(part))

    def _followed(self, part: str) -> list[int]:
        """A special string counts once it is complete; until then its
        characters go on from the text before it."""
        counts: list[int] = []
        done = at = 0
        for m in self.special.finditer(part):
            got = _Followed(self).counts(part[at : m.end() - 1])
            counts += [done + c for c in got]
            done += (got[m.start() - at - 1] if m.start() > at else 0) + 1
            counts.append(done)
            at = m.end()
        return counts + [done + c for c in _Followed(self).counts(part[at:])]

    def _by_library(self, part: str) -> list[int]:
        return [len(self.whole.encode(part[: i + 1], add_special_tokens=False).ids) for i in range(len(part))]


def _changes(counts: list[int]) -> bytes:
    return bytes([(b - a) & 255 for a, b in zip([0, *counts], counts)])


class _Followed:
    """Token counts while a text grows by one character at a time.

    A character either stands alone in the composed form (NFC) or joins those
    from the last such character on; these are taken back and put on again in
    their new form. For each composed lower-case character there is a state:
    its word, how many symbols of the word are used, the count up to there. So
    the cost is linear but for long runs of joining characters.
    """

    def __init__(self, of: PrefixCounts):
        self.of = of
        #: per character: (its word, symbols of the word so far, count so far)
        self.stack: list[tuple[_Word, int, int]] = [(_Word("space", 0, None), 0, 0)]

    def counts(self, text: str) -> list[int]:
        out, joined, since = [], "", 1
        for c in text:
            if joined and (unicodedata.combining(c) or c in _joining()):
                joined = unicodedata.normalize("NFC", joined + c)
                del self.stack[since:]
            else:
                joined, since = unicodedata.normalize("NFC", c), len(self.stack)
            for x in joined:
                for y in x.lower():
                    self._push(y)
            out.append(self.stack[-1][2])
        return out

    def _push(self, c: str) -> None:
        word, used, count = self.stack[-1]
        kind = _kind(c)
        if kind == "space":
            self.stack.append((_Word(kind, count, None), 0, count))
            return
        if kind == "letter" and (whole := self._contraction(word, used, c)):
            text, start = whole
            w = _Word("closed", start, None)
            n = self._extend(w, 0, text)
            self.stack.append((w, n, start + w.path[n][2]))
            return
        if word.kind != kind or kind == "digit":
            word, used = _Word(kind, count, word), 0
        n = self._extend(word, used, c)
        self.stack.append((word, n, word.start + word.path[n][2]))

    def _contraction(self, word: _Word, used: int, c: str) -> tuple[str, int] | None:
        """The contraction that `c` completes, and the count before it."""
        if word.kind == "other" and used == 1 and word.symbols[0] == "'" and c in "stmd":
            return "'" + c, word.start
        p = word.previous
        if word.kind == "letter" and used == 1 and p is not None and p.kind == "other" and len(self.stack) > 2 and self.stack[-2][1] == 1 and p.symbols[0] == "'":
            if (text := word.symbols[0] + c) in ("re", "ve", "ll"):
                return "'" + text, p.start
        return None

    def _extend(self, word: _Word, used: int, text: str) -> int:
        """Puts characters behind the first `used` symbols of a word."""
        del word.symbols[used:], word.path[used + 1 :]
        for symbol in _alphabet(text):
            word.symbols.append(symbol)
            n = len(word.symbols)
            before = max(0, n - self.of.longest)
            word.path.append(self.of._state(word.path, "".join(word.symbols[before:]), n, before))
        return len(word.symbols)


class _Word:
    """A word that grows: its kind, the count before it, the word before it,
    its symbols and the state after each."""

    __slots__ = ("kind", "start", "previous", "symbols", "path")

    def __init__(self, kind: str, start: int, previous: _Word | None):
        self.kind, self.start, self.previous = kind, start, previous
        self.symbols: list[str] = []
        self.path: list[tuple] = [("", 0, 0)]


@lru_cache(maxsize=1 << 16)
def _kind(c: str) -> str:
    return "letter" if regex.match(r"\p{L}", c) else "digit" if regex.match(r"\p{N}", c) else "space" if regex.match(r"\s", c) else "other"


@lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """Characters that composition may join to the one before though they are
    no marks: second parts of canonical decompositions, vowels and finals of
    Hangul syllables."""
    parts = (unicodedata.decomposition(chr(i)) for i in range(0x110000))
    second = {chr(int(d.split()[1], 16)) for d in parts if " " in d and d[0] != "<"}
    return frozenset(second | {*map(chr, range(0x1161, 0x1176)), *map(chr, range(0x11A8, 0x11C3))})


_LINES = re.compile(r"[\t-\r]+|[^\t-\r]+")
