"""Operator 1: byte-pair encoding and decoding with a trie of words whose shared prefixes are encoded once.

The encoding of a text's first ``i`` bytes ends in exactly one token, and what stands before that token is the encoding
of the bytes before it. So a trie node needs one thing only: the last token of its prefix. It follows from the last
token of an earlier node on the same path: of the tokens that end at this node, one may stand after the last token of
the prefix it leaves over. Sorted words lie in the trie in depth-first order, so a word's own nodes are those below the
prefix it shares with the word before it. The nodes get their states level by level, all nodes of a level at once, and a
word's ids are read off by stepping back from its node.

Two tokens may stand side by side if joining them byte by byte in the order of the merges ends in these two. The two
grow towards their common border in steps; they fail if, at a time when ``x`` ends the left one and ``y`` begins the
right one, the pair (x, y) is merged before either of them grows on.

Defined results: a null text is encoded as the empty text (no ids); texts of any length are encoded whole; repeated rows
give repeated rows; an empty table gives an empty table; other columns of the input are not read.
The string of the special token in a text becomes its one id, as the tokenizers library does by default.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from civicgauge.llm.tasks import map_rows, text_or_empty

#: Splits a text into the words that are encoded on their own (the byte-level pattern of the vocabulary file).
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a task keeps, and trie nodes it works on at a time; smaller ones cost time and change no result.
KEPT_WORDS, KEPT_NODES = 500_000, 100_000
#: Texts encoded together: so many rows, and so many characters of them (or one longer text).
TEXTS_AT_ONCE, CHARACTERS_AT_ONCE = 1024, 1 << 22
#: Longer words (in bytes) are taken one after the other, as a level would have few nodes.
LEVELS = 63
#: Pairs of tokens whose verdict a task keeps (a power of two).
KEPT_PAIRS = 1 << 19
NEVER = 1 << 60
LETTER, NUMBER, BLANK, OTHER = range(4)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def printable_bytes() -> dict[str, int]:
    """The vocabulary file writes each byte as a printable character: itself where it is one, else the next from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class Vocabulary:
    """Tokens of a byte-level vocabulary file, with the merge that makes each one."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        of = printable_bytes()
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        ids = {bytes(of[c] for c in text): i for text, i in file["model"]["vocab"].items() if text not in self.special}
        self.ids = ids
        size = max([*ids.values(), *self.special.values()]) + 1
        self.texts = [b""] * size
        for text, i in [*ids.items(), *((t.encode(), i) for t, i in self.special.items())]:
            self.texts[i] = text
        self.lengths = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.longest = max(map(len, ids))
        self.born = [-1] * size  # rank of the merge that makes a token; single bytes are there from the start
        self.left, self.right = [-1] * size, [-1] * size
        self.rank: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(file["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            first, second = (bytes(of[c] for c in x) for x in (a, b))
            made = ids[first + second]
            self.rank[ids[first], ids[second]] = rank
            if self.born[made] < 0:
                self.born[made], self.left[made], self.right[made] = rank, ids[first], ids[second]
        for text, i in ids.items():
            if len(text) > 1 and self.born[i] < 0:
                del self.ids[text]  # no merge makes it
        # Lengths of the tokens that end in the same three bytes, the longest first: few suffixes of a prefix can be tokens.
        by_end: dict[bytes, set[int]] = {}
        for text in ids:
            if len(text) > 2:
                by_end.setdefault(text[-3:], set()).add(len(text))
        self.lengths_by_end = {end: (*sorted(found, reverse=True), 2, 1) for end, found in by_end.items()}
        # The same for whole columns of prefixes: a bit for each length, and the tokens of a length by their last eight bytes.
        ends = sorted(by_end)
        self.ends = np.array([int.from_bytes(end) for end in ends], dtype=np.uint64)
        self.lengths_of_ends = np.array([sum(1 << n for n in by_end[end] if n <= LEVELS) for end in ends], dtype=np.uint64)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        found: dict[int, list[tuple[int, int]]] = {}
        for text, i in ids.items():
            found.setdefault(len(text), []).append((int.from_bytes(text[-8:]), i))
        for length, pairs in found.items():
            keys, first = np.unique(np.array([k for k, _ in pairs], dtype=np.uint64), return_index=True)
            self.by_length[length] = keys, np.array([i for _, i in pairs], dtype=np.int64)[first]

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether the tokens ``a`` and ``b`` stay two when their bytes are merged in order."""
        rank, born = self.rank, self.born
        x, y, x_grows, y_grows = a, b, NEVER, NEVER
        while True:
            merged = rank.get((x, y))
            # Of equal merges the leftmost comes first: the left token's own growth wins, the right one's does not.
            if merged is not None and merged < x_grows and merged <= y_grows:
                return False
            if born[x] > born[y]:
                x_grows, x = born[x], self.right[x]
            elif born[y] >= 0:
                y_grows, y = born[y], self.left[y]
            else:
                return True


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted numbers are among the sorted keys, and where."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = np.flatnonzero(keys[at] == wanted)
    return found, at[found]


class WordTrie:
    """Trie over the bytes of words. ``last``: of each node of the trie worked on last, the last token of its prefix."""

    def __init__(self, voc: Vocabulary, nodes: int = KEPT_NODES) -> None:
        self.voc, self.nodes, self.last = voc, nodes, np.array([-1])
        self.pairs = np.full(KEPT_PAIRS, -1, dtype=np.int64)  # two tokens and their verdict in one number, by a hash of the two
        self.shift = np.uint64(64 - (KEPT_PAIRS.bit_length() - 1))

    def encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct words as little-endian 32-bit numbers.

        A trie holds a run of the sorted words with no more nodes than allowed; neighbours share the most.
        """
        out: dict[bytes, bytes] = {}
        words, long = sorted(w for w in words if len(w) <= LEVELS), sorted(w for w in words if len(w) > LEVELS)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        at = 0
        while at < len(words):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + self.nodes, side="right")))
            self.by_levels(words[at:to], out)
            at = to
        if long:
            self.one_by_one(long, out)
        return out

    def by_levels(self, words: list[bytes], out: dict[bytes, bytes]) -> None:
        """Ids of sorted short words."""
        n, lengths = len(words), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        deep = int(lengths.max())
        letters = np.zeros((n, 8 + deep), dtype=np.uint8)  # eight zeros stand before each word
        letters[:, 8:] = np.array(words, dtype=f"S{deep}").view(np.uint8).reshape(n, deep)
        same = np.zeros((n, deep + 1), dtype=bool)
        same[1:, :deep] = letters[1:, 8:] == letters[:-1, 8:]
        shared = same.argmin(axis=1)
        shared[1:] = np.minimum(shared[1:], np.minimum(lengths[1:], lengths[:-1]))
        levels = np.arange(deep + 1)[:, None]
        new = (levels > shared) & (levels <= lengths)
        owner = np.maximum.accumulate(np.where(new, np.arange(n), 0), axis=1)  # the word whose node a word's prefix is
        level, row = new.nonzero()
        bounds = np.searchsorted(level, np.arange(deep + 2))
        token, first, after = self.candidates(words, letters, level, row)
        last = np.full((deep + 1, n), -1, dtype=np.int64)
        for depth in range(1, deep + 1):
            nodes = np.arange(bounds[depth], bounds[depth + 1])
            at = first[nodes]
            while len(nodes):
                if (at >= after[nodes]).any():
                    raise ValueError(f"no token ends the prefix {words[row[nodes[0]]][:depth]!r}")
                ending, rows = token[at], row[nodes]
                start = depth - self.voc.lengths[ending]
                fits = self.may_stand(last[start, owner[start, rows]], ending)
                last[depth, rows[fits]] = ending[fits]
                nodes, at = nodes[~fits], at[~fits] + 1
        self.last = np.concatenate(([-1], last[level, row]))
        self.read_off(words, lengths, last, owner, out)

    def candidates(self, words: list[bytes], letters: np.ndarray, level: np.ndarray,
                   row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens that end each node's prefix, the longest first, and where each node's begin and end."""
        by_length, width = self.voc.by_length, letters.shape[1]
        ends = np.ndarray((letters.size - 7,), dtype=">u8", buffer=letters, strides=(1,))[row * width + level].astype(np.uint64)
        possible = np.full(len(level), 6, dtype=np.uint64)  # lengths one and two
        found, at = places(self.voc.ends, ends & np.uint64(0xFFFFFF))
        possible[found] |= self.voc.lengths_of_ends[at]
        hits, count = [], np.zeros(len(level), dtype=np.int64)
        for length in range(min(letters.shape[1] - 8, LEVELS), 0, -1):
            if length not in by_length:
                continue
            nodes = np.flatnonzero((possible >> np.uint64(length)) & np.uint64(1))
            nodes = nodes[level[nodes] >= length]
            keys, ids = by_length[length]
            found, at = places(keys, ends[nodes] & np.uint64((1 << 8 * min(length, 8)) - 1))
            nodes, tokens = nodes[found], ids[at]
            if length > 8 and len(nodes):  # the last eight bytes agree; the token is looked up whole
                whole = [self.voc.ids.get(words[r][d - length:d], -1) for r, d in zip(row[nodes].tolist(), level[nodes].tolist())]
                tokens = np.array(whole)
                nodes, tokens = nodes[tokens >= 0], tokens[tokens >= 0]
            count[nodes] += 1
            hits.append((nodes, tokens))
        after = np.cumsum(count)
        first = after - count
        token, free = np.empty(int(after[-1]), dtype=np.int64), first.copy()
        for nodes, tokens in hits:
            token[free[nodes]] = tokens
            free[nodes] += 1
        return token, first, after

    def may_stand(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each two tokens stay two side by side; every token may stand where nothing (-1) is on its left."""
        pair = np.where(left < 0, 0, left << 24 | right)
        slot = (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
        held = self.pairs[slot]
        unknown = ((held >> 1) != pair) & (left >= 0)
        if unknown.any():
            distinct, which = np.unique(pair[unknown], return_inverse=True)
            verdicts = [self.voc.side_by_side(x >> 24, x & 0xFFFFFF) for x in distinct.tolist()]
            held[unknown] = (distinct << 1 | np.array(verdicts))[which]
            self.pairs[slot[unknown]] = held[unknown]
        return (held & 1).astype(bool) | (left < 0)

    def read_off(self, words: list[bytes], lengths: np.ndarray, last: np.ndarray, owner: np.ndarray, out: dict[bytes, bytes]) -> None:
        """A word's ids, from its node back to the root."""
        rows, depth, steps, count = np.arange(len(words)), lengths, [], np.zeros(len(words), dtype=np.int64)
        while len(rows):
            tokens = last[depth, owner[depth, rows]]
            steps.append((rows, tokens))
            count[rows] += 1
            depth = depth - self.voc.lengths[tokens]
            rows, depth = rows[depth > 0], depth[depth > 0]
        ends = np.cumsum(count)
        ids = np.empty(int(ends[-1]), dtype="<u4")
        for k, (rows, tokens) in enumerate(steps):
            ids[ends[rows] - 1 - k] = tokens
        packed, at = ids.tobytes(), 0
        for word, end in zip(words, (4 * ends).tolist()):
            out[word] = packed[at:end]
            at = end

    def one_by_one(self, words: list[bytes], out: dict[bytes, bytes]) -> None:
        """Ids of sorted long words; only the way down to the word at hand is kept."""
        token_of, lengths_of, short, allowed = self.voc.ids.get, self.voc.lengths_by_end.get, (2, 1), {}
        last, previous = [-1], b""
        for word in words:
            shared = 0
            for a, b in zip(previous, word):
                if a != b:
                    break
                shared += 1
            del last[shared + 1:]
            previous = word
            for end in range(shared + 1, len(word) + 1):
                for length in lengths_of(word[end - 3:end], short) if end > 2 else short:
                    start = end - length
                    if start < 0 or (token := token_of(word[start:end])) is None:
                        continue
                    if not start:
                        break
                    pair = last[start], token
                    if pair not in allowed:
                        allowed[pair] = self.voc.side_by_side(*pair)
                    if allowed[pair]:
                        break
                else:
                    raise ValueError(f"no token ends the prefix {word[:end]!r}")
                last.append(token)
            found, end = [], len(word)
            while end:
                found.append(last[end])
                end -= len(self.voc.texts[last[end]])
            found.reverse()
            out[word] = pack("<%dI" % len(found), *found)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """What the pattern takes each character for, by code point."""
    every = "".join(map(chr, range(0xD800))) + " " * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))  # no text has surrogates
    found = np.full(len(every), OTHER, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for run in regex.finditer(pattern, every):
            found[run.start():run.end()] = kind
    return found


def kinds_of_bytes(data: bytes) -> np.ndarray:
    """The kind of the character that each byte of a text is part of."""
    table = kinds()
    found = np.frombuffer(bytearray(data.translate(table[:256].tobytes())), dtype=np.uint8)
    text = np.frombuffer(data, dtype=np.uint8)
    lead = np.flatnonzero(text >= 0xC0)
    if len(lead):
        size = 2 + (text[lead] >= 0xE0) + (text[lead] >= 0xF0)
        point = text[lead].astype(np.int64) & (0x7F >> size)
        for k in range(1, 4):
            more = size > k
            point[more] = point[more] << 6 | text[lead[more] + k] & 0x3F
        for k in range(4):
            more = size > k
            found[lead[more] + k] = table[point[more]]
    return found


def word_starts(data: bytes, borders: np.ndarray) -> np.ndarray:
    """Where the words of texts that stand one after the other begin: what ``WORD`` finds in each, for all of them at once.

    ``borders``: where texts begin or end. A word is a run of one kind of character with the single space before it. Of a run
    of blanks the last goes on its own, or with what follows if it is a space; at the end of a text the run stays whole.
    """
    text, kind = np.frombuffer(data, dtype=np.uint8), kinds_of_bytes(data)
    border = np.zeros(len(text) + 3, dtype=bool)
    border[borders] = True
    start = border.copy()
    start[1:len(text)] |= kind[1:] != kind[:-1]
    start[len(text):] = False
    runs = np.flatnonzero(start)
    blank = np.flatnonzero(kind[runs] == BLANK)
    ends = np.append(runs, len(text))[blank + 1]
    ends = ends[~border[ends]]
    final = ends - 1
    for _ in range(2):  # a blank has up to three bytes
        final = final - (text[final] & 0xC0 == 0x80)
    start[final] = True
    start[ends[text[final] == ord(" ")]] = False
    quote = np.flatnonzero(text == ord("'"))
    quote = quote[start[quote] & ~border[quote + 1]]
    one, two = (np.append(text, (0, 0, 0))[quote + k] for k in (1, 2))
    size = np.where(np.isin(one, list(b"stmd")), 1, 0)
    pair = ((one == ord("l")) & (two == ord("l"))) | (np.isin(one, list(b"rv")) & (two == ord("e")))
    size[pair & ~border[quote + 2]] = 2
    quote, size = quote[size > 0], size[size > 0]
    start[quote + 1] = False
    start[quote + 1 + size] = True
    return np.flatnonzero(start[:len(text)])


class Encoder:
    """Encodes whole texts; keeps the ids of words it has met as little-endian 32-bit numbers."""

    def __init__(self, path: str, kept_words: int = KEPT_WORDS, kept_nodes: int = KEPT_NODES) -> None:
        self.voc = vocabulary(path)
        self.kept_words = kept_words
        self.trie = WordTrie(self.voc, kept_nodes)
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}  # the store that was full last; what is met again goes into the new one
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.voc.special, key=len, reverse=True))) + ")")

    def look_up(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words. The words not met before go into the trie together, so that they share prefixes."""
        known, before = self.known, self.before
        found = [*map(known.get, words)]
        missed = [k for k, ids in enumerate(found) if ids is None]
        again = [*map(before.get, map(words.__getitem__, missed))]
        new = self.trie.encode([words[k] for k, ids in zip(missed, again) if ids is None])
        for k, ids in zip(missed, again):
            word = words[k]
            found[k] = known[word] = new[word] if ids is None else ids
        if len(known) > self.kept_words // 2:
            self.before, self.known = known, {}
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        out, at, ends = [], 0, np.cumsum([len(t) for t in texts], dtype=np.int64)
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHARACTERS_AT_ONCE, side="right")))
            out += self.encode_together(texts[at:to])
            at = to
        return out

    def encode_together(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. All words of all texts are cut and looked up together, each distinct one once."""
        parts, first, special = [], [], []
        for text in texts:
            first.append(len(parts))
            if self.specials.search(text):
                for k, part in enumerate(self.specials.split(text)):
                    if k % 2:
                        special.append((len(parts), self.voc.special[part]))
                    parts.append(b"" if k % 2 else part.encode())
            else:
                parts.append(text.encode())
        data = b"".join(parts)
        borders = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))))
        starts = word_starts(data, borders)
        offsets = np.append(starts, len(data))
        cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = cut.dictionary_encode()
        ids = self.look_up(coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy()
        packed = np.frombuffer(b"".join(ids), dtype="<u4")
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) >> 2
        counts = lengths[codes]
        ends = np.concatenate(([0], np.cumsum(counts)))
        at = np.repeat((np.cumsum(lengths) - lengths)[codes] - ends[:-1], counts)
        at += np.arange(len(at))
        tokens = packed[at].tobytes()
        bounds = 4 * ends[np.searchsorted(starts, borders)]
        if special:
            own = dict(special)
            pieces = [own[k].to_bytes(4, "little") if k in own else tokens[a:b] for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))]
            return [b"".join(pieces[a:b]) for a, b in zip(first, [*first[1:], len(parts)])]
        bounds = bounds.tolist()
        return [tokens[a:b] for a, b in zip(bounds, bounds[1:])]

    def decode(self, ids: bytes) -> str:
        texts = self.voc.texts
        return b"".join(map(texts.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for a Python worker, kept from task to task."""
    return Encoder(path)


def encode(docs: DataFrame, tokenizer: str | None = None, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Token ids of each whole text: the id column and ``ids`` (array<int>)."""
    def make():
        work = encoder(tokenizer or default_path())
        return lambda keys, texts: [keys, [np.frombuffer(x, dtype="<u4").astype("int32") for x in work.encode(texts)]]

    kind = dict(docs.dtypes)[id_column]
    return map_rows(docs, [id_column, text_or_empty(text)], f"`{id_column}` {kind}, ids array<int>", make, TEXTS_AT_ONCE)


def decode(encoded: DataFrame, tokenizer: str | None = None, id_column: str = "doc_id") -> DataFrame:
    """Text of each row's ``ids``: the id column and ``text``. Null ids give a null text."""
    def make():
        work = encoder(tokenizer or default_path())
        return lambda keys, ids: [keys, [None if x is None else work.decode(np.array(x, dtype="<u4").tobytes()) for x in ids]]

    kind = dict(encoded.dtypes)[id_column]
    return map_rows(encoded, [id_column, "ids"], f"`{id_column}` {kind}, text string", make)


def round_trip_digests(docs: DataFrame, tokenizer: str | None = None, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Each text is encoded and its ids decoded in one pass, and both come out as digests: ``n_tokens``, ``ids_sha256``

    (of the ids as little-endian 32-bit numbers), ``decoded_sha256`` (of the decoded text in UTF-8), ``lossless``.
    """
    def make():
        work = encoder(tokenizer or default_path())

        def run(keys, texts):
            ids = work.encode(texts)
            decoded = [work.decode(x) for x in ids]
            return [keys, [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids],
                    [hashlib.sha256(x.encode()).hexdigest() for x in decoded], [a == b for a, b in zip(texts, decoded)]]

        return run

    kind = dict(docs.dtypes)[id_column]
    return map_rows(docs, [id_column, text_or_empty(text)],
                    f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean", make, TEXTS_AT_ONCE)
