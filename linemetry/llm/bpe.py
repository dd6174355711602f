"""BPE encoding as a bounded-lookahead streaming transducer, and incremental decoding.

The transducer reads the symbols of a pre-token one by one. For each place it knows the last token
of the text up to there: the only token that ends there and whose concatenation with the last
token of the place where it begins merges back into these two. So the encodings of all beginnings
form a tree. A later token can begin only at a live place, from which the symbols read so far are
the beginning of some token; tokens on the path that all live places share are stable and are
emitted at once, and what lies before is forgotten. What is held is bounded by the merge list's
sufficient lookahead (`sufficient_lookahead`), not by the text; ids and decoded text go to their
digests piece by piece.
"""

from __future__ import annotations

import codecs
import contextlib
import hashlib
import itertools
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._memory import hold, tidied

#: Chunks between white space whose tokens a worker keeps, in each of two generations; pre-tokens,
#: and pairs of tokens whose fit it keeps.
CACHE, PARTS, PAIRS = 200_000, 50_000, 1 << 18
#: Rows that are put out together.
ROWS = 1000
#: Longer chunks aren't kept.
CACHED_BYTES = 64
#: Bytes of a text, and ids of a chunk, that are encoded before they go to the digests.
PIECE_BYTES, PIECE_IDS = 1 << 18, 1 << 14
#: Symbols between two looks for stable tokens.
STRIDE = 8
#: The contractions and classes of the vocabulary's pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+"
#: Letters and numbers of Unicode 16.0, and lower cases of 16.0 and 17.0, which are newer than Python's tables.
LETTERS_16 = ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0))
NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
LOWER_16 = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}

#: Marks (and one vowel sign) that the library's older normaliser leaves where they are and doesn't compose.
LATER_RANGES = ((0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF), (0x11930, 0x11930))
LATER_MARKS = frozenset(chr(c) for a, b in LATER_RANGES for c in range(a, b + 1))
_LATER = re.compile("([" + "".join(sorted(LATER_MARKS)) + "])")


def word_pattern() -> re.Pattern[str]:
    """The pre-tokenizer's pattern, with the classes of Python's Unicode tables and the newer letters and numbers."""
    found: dict[str, list[list[int]]] = {"L": [list(r) for r in LETTERS_16], "N": [list(r) for r in NUMBERS_16], "S": []}
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        kind = "S" if chr(c).isspace() and not 0x1C <= c <= 0x1F else kind
        if kind in ("L", "N", "S") and (kind != "S" or chr(c).isspace()):
            ranges = found[kind]
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    text = {k: "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in v) for k, v in found.items()}
    return re.compile(PATTERN.format(letters=text["L"], numbers=text["N"], spaces=text["S"]))


def byte_symbols() -> list[str]:
    """The printable symbol that stands for each byte: itself if printable in Latin-1, else the
    next free code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def sufficient_lookahead(strings: list[str]) -> int:
    """The symbols after a token on which it can depend. strings: what each merge makes, by rank.

    A merge is prevented or enabled from the right only by an earlier merge whose string begins
    with a suffix of its own; that one in turn depends on what follows it. reach(r) is the longest
    such chain, found in one pass by rank with the best reach for each beginning.
    """
    best: dict[str, int] = {}
    most = 0
    for s in strings:
        reach = max((best.get(s[i:], 0) - (len(s) - i) for i in range(len(s))), default=0)
        reach = max(reach, 1)
        most = max(most, reach)
        for i in range(1, len(s) + 1):
            if best.get(s[:i], 0) < len(s) + reach:
                best[s[:i]] = len(s) + reach
    return most


class Merger:
    """Streams the bytes of one pre-token at a time to token ids."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "</w>") -> None:
        self.suffix = suffix
        made, order = {a + b for a, b in merges}, {pair: r for r, pair in enumerate(merges)}
        size = max(vocab.values()) + 1
        self.rank = {vocab[a] << 24 | vocab[b]: r for r, (a, b) in enumerate(merges)}
        #: of each token that can come out: the rank of its last merge (-1: a symbol) and its parts
        self.last_rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        out = {t for t in vocab if t not in made}
        for r, (a, b) in enumerate(merges):
            for x in (a, b):
                if x in made and x not in out and all(order.get((x[:i], x[i:]), r) >= r for i in range(1, len(x))):
                    raise ValueError("a merge comes before those that make its parts")
            if a in out and b in out and a + b not in out and self._meet(vocab[a], vocab[b]) == r:
                out.add(a + b)
                i = vocab[a + b]
                self.last_rank[i], self.left[i], self.right[i] = r, vocab[a], vocab[b]
        # a trie of their bytes; the end of a word is part of its last byte. Nodes that go on come first
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        inner, final = {}, {}
        for t in out:
            (final if t.endswith(suffix) else inner)[bytes([byte_of[c] for c in t.removesuffix(suffix)])] = vocab[t]
        begins = sorted({t[:i] for t in (*inner, *final) for i in range(1, len(t))})
        leaves = sorted((inner.keys() | final.keys()) - set(begins))
        number = {t: n for n, t in enumerate([b"", *begins, *leaves])}
        self.going = 1 + len(begins)
        self.steps = {number[t[:-1]] << 8 | t[-1]: n for t, n in number.items() if t}
        self.inner, self.final = [inner.get(t, -1) for t in number], [final.get(t, -1) for t in number]
        self.words = final
        # where a byte leads that no node goes on with: to the longest end of it all that is a node
        self.depth, self.up = [0] * len(number), [0] * len(number)
        by_depth = sorted(number, key=len)
        for t in by_depth:
            n = number[t]
            self.depth[n] = len(t)
            if len(t) > 1:
                self.up[n] = self._turn(self.up[number[t[:-1]]], t[-1])
        self._turns = dict(self.steps)  # and what else has been met
        self._inner: list[tuple | None] = [None] * len(number)
        self._final: list[tuple | None] = [None] * len(number)
        self._going: list[tuple | None] = [None] * len(number)
        self.length = [0] * size
        for t in out:
            self.length[vocab[t]] = len(t.removesuffix(suffix))
        self.start = 1 << 23  # stands for the token before a pre-token, which all tokens fit
        symbols = lambda s: s.removesuffix(suffix) + ("\0" if s.endswith(suffix) else "")  # noqa: E731  the suffix counts as a symbol
        self.lookahead = sufficient_lookahead([symbols(a + b) for a, b in merges])
        self._fits: dict[int, bool] = {}
        self.early, self.most_held = 0, 0  # times that tokens were emitted before their pre-token was read; bytes held at most

    def _turn(self, node: int, byte: int) -> int:
        """The node that a byte leads to from one that doesn't go on with it."""
        steps = self.steps
        while True:
            to = steps.get(node << 8 | byte)
            if to is not None:
                return to
            if not node:
                return 0
            node = self.up[node]

    def _ending(self, node: int) -> tuple:
        """Of the ends of what has been read that are nodes, longest first: tokens and their sizes; and, kept beside
        them, those that end a word, and the lengths of those that a token may go on from."""
        inner, final, going = [], [], []
        at = node
        while at:
            if self.inner[at] >= 0:
                inner.append((self.inner[at], self.depth[at]))
            if self.final[at] >= 0:
                final.append((self.final[at], self.depth[at]))
            if at < self.going:
                going.append(self.depth[at])
            at = self.up[at]
        self._inner[node], self._final[node], self._going[node] = tuple(inner), tuple(final), tuple(going)
        return self._inner[node]

    def _meet(self, a: int, b: int) -> int | None:
        """The rank of the first merge across the border of two tokens, None without any.

        Going back in time, the later merge of the two is undone; the parts at the border can
        merge only before that (at the same rank: only to the left of it)."""
        last, rank, found, limit = self.last_rank, self.rank.get, None, 1 << 30
        ra, rb = last[a], last[b]
        while True:
            r = rank(a << 24 | b)
            if r is not None and r < limit:
                found = r
            if rb >= ra:
                if rb < 0:
                    return found
                limit, b = rb + 1, self.left[b]
                rb = last[b]
            else:
                limit, a = ra, self.right[a]
                ra = last[a]

    def fits(self, left: int, right: int) -> bool:
        """Whether the bytes of two tokens merge back into just these two."""
        found = self._fits.get(left << 24 | right)
        if found is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            found = self._fits[left << 24 | right] = left == self.start or self._meet(left, right) is None
        return found

    def tokens(self, data: bytes, emit: Callable[[Iterable[int]], None]) -> None:
        """Give `emit` the ids of the tokens of one pre-token (at least one byte), once stable.

        For the places from `start`, up to which tokens have been emitted, last has the token that
        ends there (every byte is one, so some token does). One automaton over all tokens (Aho and Corasick 1975) knows at
        each place which tokens end there, and from where one may go on: the live places."""
        whole = self.words.get(data)
        if whole is not None:  # a token merges back into itself
            emit((whole,))
            return
        turns, ends, known, fits, length = self._turns, self._inner, self._fits.get, self.fits, self.length
        turn, start, last, end, node, stop = turns.get, 0, [self.start], 0, 0, len(data) - 1
        for byte in data:
            to = turn(node << 8 | byte)
            if to is None:
                if len(turns) > len(self.steps) + PAIRS:
                    turns.clear()
                    turns.update(self.steps)
                to = turns[node << 8 | byte] = self._turn(node, byte)
            node = to
            found = ends[node]
            if found is None:
                found = self._ending(node)
            if end == stop:
                break
            end += 1
            at = end - start
            for token, n in found:
                pair = last[at - n] << 24 | token
                fit = known(pair)
                if fit is None:
                    fit = fits(pair >> 24, token)
                if fit:
                    break
            last.append(token)
            if at >= STRIDE:
                paths = [at - n for n in self._going[node]]
                paths.append(at)
                while len(paths) > 1:  # the deepest goes back by its last token until all have met
                    deepest = paths.pop()
                    to = deepest - length[last[deepest]]
                    if to not in paths:
                        paths.append(to)
                        if to < paths[-2]:
                            paths.sort()
                if at > self.most_held:
                    self.most_held = at
                shared = paths[0]
                if shared:
                    self.early += 1
                    emit(self._path(last, shared))
                    start, last = start + shared, last[shared:]
        for token, n in self._final[node]:
            to = stop + 1 - n - start
            if fits(last[to], token):
                emit([*self._path(last, to), token])
                return
        raise ValueError(f"no token ends {data!r}")

    def _path(self, last: list[int], end: int) -> list[int]:
        """Tokens that end at `end` places after the start, but for the one emitted before."""
        found, length = [], self.length
        while end:
            found.append(last[end])
            end -= length[last[end]]
        return found[::-1]


class Decoder:
    """Ids to text in UTF-8, piece by piece. The machine's state is whether a token has come before, and
    the bytes of an unfinished character; so its memory is constant.

    feed gives what the library's decode adds for ids: the tokens' names, each after a space if it
    isn't the first (the vocabulary has no decoder of its own). plain gives readable text: bytes
    pass an incremental UTF-8 state machine, and word ends become spaces. Wrong bytes: U+FFFD."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.of, self.begun, self.open = tokenizer, False, False
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> bytes:
        names = self.of.spelt
        piece = b" ".join([names[i] for i in ids])
        if self.begun and ids:
            piece = b" " + piece
        self.begun = self.begun or bool(ids)
        return piece

    def plain(self, ids: list[int]) -> bytes:
        if not self.open:
            of = self.of.whole  # of tokens that hold whole characters only
            parts = [of[i] for i in ids]
            if None not in parts:
                return b"".join(parts)
        bytes_of, decode, found, held = self.of.bytes_of, self.machine.decode, [], []
        for i in ids:
            part, ends = bytes_of[i]
            held.append(part)
            if ends:  # of a word, or a special: an unfinished character is wrong there
                found.append(decode(b"".join(held), True))
                found.append(" " if part else self.of.names[i])
                held = []
        if held:
            found.append(decode(b"".join(held)))
        self.open = bool(self.machine.getstate()[0])
        return "".join(found).encode()

    def rest(self) -> bytes:
        """What an unfinished character at the end gives."""
        return self.machine.decode(b"", True).encode()


#: Ids of a chunk, these in decimal, the tokens' names, and plain text.
Entry = tuple[tuple[int, ...], bytes, bytes, bytes]


class Tokenizer:
    """Text to ids and back for a vocabulary file of word-end BPE (JSON)."""

    def __init__(self, definition: str) -> None:
        spec = json.loads(definition)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.merger = Merger(self.vocab, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        self.numbers = [b"%d" % i for i in range(max(self.names) + 1)]
        self.spelt = [self.names.get(i, "").encode() for i in range(max(self.names) + 1)]
        suffix = self.merger.suffix
        self.bytes_of = {i: (bytes([byte_of[c] for c in t.removesuffix(suffix)]), t.endswith(suffix)) for t, i in self.vocab.items()}
        self.bytes_of |= {i: (b"", True) for i in self.special.values()}
        self.whole: list[bytes | None] = [None] * (max(self.names) + 1)
        for i, (part, ends) in self.bytes_of.items():
            with contextlib.suppress(UnicodeDecodeError):
                part.decode()
                self.whole[i] = part + (b" " if ends else b"") if part else self.names[i].encode()
        self._split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._ascii, self._words = re.compile(PATTERN.format(letters="a-z", numbers="0-9", spaces=r"\x09-\x0d\x20")), None
        self.kept: dict[bytes, Entry] = {}
        self._old: dict[bytes, Entry] = {}
        self.machine = Decoder(self)
        self.empties = False  # whether a chunk without tokens has been met
        self._parts: dict[str, tuple[int, ...]] = {}
        self._made: dict[bytes, Entry] = {}

    def encode(self, text: str, emit: Callable[[Iterable[int]], None]) -> None:
        """Give `emit` the ids of a text; specials are matched before it is normalised (NFC, lower case)."""
        for piece in self._split.split(text) if self._split and "<" in text else (text,):
            if piece in self.special:
                emit((self.special[piece],))
                continue
            if piece.isascii():
                piece = piece.lower()
                body = piece.rstrip(_MARKS)
                if body.isalpha():  # a word, with marks after it or without
                    parts = (body, piece[len(body) :]) if len(body) < len(piece) else (piece,)
                else:
                    parts = (m[0] for m in self._ascii.finditer(piece))
            else:  # characters are lowered one by one: no final sigma
                if not piece.isalpha():
                    piece = "".join([x if x in LATER_MARKS else unicodedata.normalize("NFC", x) for x in _LATER.split(piece)])
                elif not unicodedata.is_normalized("NFC", piece):
                    piece = unicodedata.normalize("NFC", piece)
                piece = piece.replace("Σ", "σ").lower().translate(LOWER_16)
                if piece.isalpha():
                    parts = (piece,)
                else:
                    self._words = self._words or word_pattern()
                    parts = (m[0] for m in self._words.finditer(piece))
            for part in parts:
                found = self._parts.get(part)
                if found is not None:
                    emit(found)
                    continue
                data = part.encode()
                if len(part) > CACHED_BYTES:
                    self.merger.tokens(data, emit)
                    continue
                ids: list[int] = []
                self.merger.tokens(data, ids.extend)
                found = tuple(ids)  # which the garbage collector needn't visit
                if len(self._parts) >= PARTS:
                    self._parts.clear()
                self._parts[part] = found
                emit(found)

    def forget(self) -> None:
        """Give back all that is kept but the newest chunks: a worker may go on with other work."""
        for cache in (self._old, self._parts, self._made):
            cache.clear()

    def _entry(self, ids: list[int]) -> Entry:
        machine, numbers = self.machine, self.numbers
        machine.begun = False
        self.empties |= not ids
        return tuple(ids), b" ".join([numbers[i] for i in ids]), machine.feed(ids), machine.plain(ids)

    def _part(self, data: bytes, keep: bool = True) -> Entry:
        """Of a pre-token that needs no normalising; kept if its chunk isn't just this."""
        found = self._made.get(data)
        if found is None:
            ids: list[int] = []
            self.merger.tokens(data, ids.extend)
            found = self._entry(ids)
            if keep and len(data) <= CACHED_BYTES:
                if len(self._made) >= PARTS:
                    self._made.clear()
                self._made[data] = found
        return found

    def chunk(self, data: bytes) -> Entry:
        """Of a text without ASCII white space: its ids, and what the digests get of them. A word ends with it, so
        the decoder's state does too, and chunks can be put one after the other."""
        found = self.kept.get(data)
        if found is None:
            found = self._old.pop(data, None)
            if found is None:
                body = data.rstrip(_MARK_BYTES)
                if body.isalpha() and len(body) <= CACHED_BYTES and b"<" not in data:  # an ASCII word, with marks after it or without
                    found = self._part(body.lower(), len(body) < len(data))
                    if len(body) < len(data):
                        ids, line, names, plain = self._part(data[len(body) :])
                        found = (found[0] + ids, found[1] + b" " + line, found[2] + b" " + names, found[3] + plain)
                else:
                    ids = []
                    self.encode(data.decode(), ids.extend)
                    found = self._entry(ids)
            if len(data) <= CACHED_BYTES:
                if len(self.kept) >= CACHE:
                    self._old, self.kept = self.kept, {}
                self.kept[data] = found
        return found

    def walk(self, data: bytes, put: Callable[[list[Entry]], None], stream: Callable[[list[int]], None]) -> None:
        """Give `put` the chunks of a text, piece by piece; `stream` the ids of chunks that are longer than a piece."""
        begin = 0
        while begin < len(data):
            end = len(data)
            if end - begin > PIECE_BYTES:  # a piece ends at white space
                cut = _SPACES.search(data, begin + PIECE_BYTES)
                end = cut.start() if cut else end
            part = data[begin:end].strip()
            begin = end
            if b"<" not in part:  # no special token
                part = _BORDER.sub(b" ", part.lower())
            if len(part) > PIECE_BYTES and not _SPACES.search(part):  # one chunk
                held: list[int] = []

                def take(ids: Iterable[int], held: list[int] = held) -> None:
                    held.extend(ids)
                    if len(held) >= PIECE_IDS:
                        stream(held[:])
                        held.clear()

                self.encode(part.decode(), take)
                stream(held)
                continue
            known, chunk = self.kept.get, self.chunk
            found = [known(c) or chunk(c) for c in part.split()]
            put([e for e in found if e[0]] if self.empties else found)

    def pieces(self, data: bytes, put: Callable[[list[int]], None]) -> None:
        """Give `put` the ids of a text, piece by piece."""
        self.walk(data, lambda entries: put(list(itertools.chain.from_iterable([e[0] for e in entries]))), put)

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Plain text of ids, piece by piece."""
        machine = Decoder(self)
        yield from filter(None, (machine.plain([i]).decode() for i in ids))
        if rest := machine.rest():
            yield rest.decode()


#: ASCII marks: all that is printed but letters and digits.
_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())
_MARK_BYTES = _MARKS.encode()
#: Between a letter and a mark pre-tokens always end, so words and marks can be chunks of their own: after ASCII letters
#: and those of U+00C0-00FF, and before ASCII letters. The apostrophe, which begins contractions, is left alone.
_MARK = rb"[!-&(-/:-;=-@\[-`{-~]"
_BORDER = re.compile(rb"(?:(?<=[a-z])|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))(?=" + _MARK + rb")|(?<=" + _MARK + rb")(?=[a-z])")
_SPACES = re.compile(rb"[\x09-\x0d\x20]")


_tokenizers: dict[int, Tokenizer] = {}


def _shared_tokenizer(definition) -> Tokenizer:
    """One for each Python worker, however many tasks it runs, until it goes on with another operator."""
    hold("bpe", _tokenizers.clear)
    if definition.id not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[definition.id] = Tokenizer(definition.text.value)
    return _tokenizers[definition.id]


class _Definition:
    def __init__(self, spark, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            self.text = spark.sparkContext.broadcast(f.read())
        self.id = self.text._jbroadcast.id()

    def __getstate__(self):
        return self.text, self.id

    def __setstate__(self, state):
        self.text, self.id = state


def _digests(definition: _Definition, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _shared_tokenizer(definition)
        numbers = tokenizer.numbers
        for b in (whole.slice(a, ROWS) for whole in batches for a in range(0, whole.num_rows, ROWS)):
            counts, digests, lists = [], ([], [], []), []
            for text in b.column(1):
                decoder, of, own, sizes = Decoder(tokenizer), [hashlib.sha256() for _ in digests], [np.zeros(0, np.int32)], []

                def told(n: int, parts: tuple[bytes, bytes, bytes], of=of, sizes=sizes) -> None:
                    for digest, part, gap in zip(of, parts, (b" ", b" ", b""), strict=True):
                        digest.update(gap + part if sizes else part)
                    sizes.append(n)

                def put(entries: list[Entry], own=own, told=told) -> None:
                    if entries:
                        ids, *parts = zip(*entries, strict=True)
                        told(sum(map(len, ids)), (b" ".join(parts[0]), b" ".join(parts[1]), b"".join(parts[2])))
                        if with_ids:
                            own.append(np.fromiter(itertools.chain.from_iterable(ids), np.int32))

                def stream(ids: list[int], decoder=decoder, own=own, told=told) -> None:
                    if ids:
                        decoder.begun = False  # told puts the gap
                        told(len(ids), (b" ".join([numbers[i] for i in ids]), decoder.feed(ids), decoder.plain(ids)))
                        if with_ids:
                            own.append(np.array(ids, dtype=np.int32))

                tokenizer.walk((text.as_py() or "").encode(), put, stream)
                of[2].update(decoder.rest())
                counts.append(sum(sizes))
                for to, digest in zip(digests, of, strict=True):
                    to.append(digest.hexdigest())
                lists.append(np.concatenate(own) if with_ids else own[0])
            columns = [b.column(0), pa.array(counts, pa.int64()), *[pa.array(x, pa.string()) for x in digests]]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "text_sha256"]
            if with_ids:
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *lists]))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        tokenizer.forget()

    return run


def encode_documents(documents: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, text_sha256 (and ids) for every row of (doc_id, text).

    path: a vocabulary file of word-end BPE, read by the driver and broadcast (its size doesn't
    depend on the data). Digests are of UTF-8: ids_sha256 of the decimal ids joined by one space;
    decoded_sha256 of what `Decoder.feed` makes of the ids, which for a vocabulary without a
    decoder are the tokens' names joined by one space; text_sha256 of the plain text of
    `Decoder.plain`. Null, empty and blank texts have no tokens. A null doc_id stays null;
    repeated rows give a row each. Other columns, whatever their names, are ignored. Nothing is
    shuffled. Beside the row itself, memory holds a piece of its tokens (with_ids: all its ids).
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, text_sha256 string" + (", ids array<int>" if with_ids else "")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(tidied(_digests(_Definition(documents.sparkSession, path), with_ids), "bpe"), schema)
