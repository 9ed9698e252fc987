"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last characters cuts a text where its low bits are zero,
so equal passages of different documents give equal chunks wherever they stand.
A chunk is encoded once and reused; at the join of two chunks a window around it
is re-encoded and widened until it agrees with its surroundings.

What agreement takes depends on the tokenizer. Where white space is dropped
before tokens are made (which is tried out when the file is read), a window
that ends at a space or a line feed on both sides agrees by itself, so a
chunk's inside, between its first and last such cut, is reused and new chunks
are taken apart at them: only words not seen before reach the tokenizer. For any
other tokenizer the ids are compared: the window is that of some tokens on
either side, and it is doubled until its first ids are those of what stands
before the join and its last ids those of the chunk after it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.batches import map_texts

#: A cut where the low bits of the hash of this many characters are zero: chunks of about 2**BITS characters.
ROLL, BITS = 12, 8
#: Characters of keys that a worker keeps for reuse, for words and for chunks, in two generations each; a word takes some 40 bytes for each.
CACHE_CHARS = 5_000_000
#: New words that are encoded in one call.
GROUP = 2_000
_SAFE = re.compile("[ \n]+")
_FACTORS = [pow(0x9E3779B1, i + 1, 1 << 32) for i in range(ROLL)]


def cuts(text: str) -> np.ndarray:
    """Places where the rolling hash cuts a text, by content alone."""
    if len(text) <= ROLL:
        return np.zeros(0, np.int64)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = np.zeros(len(c) - ROLL + 1, np.uint32)
    for i, f in enumerate(_FACTORS):
        h += c[i : len(c) - ROLL + 1 + i] * np.uint32(f)
    h ^= h >> np.uint32(15)
    return np.flatnonzero((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS) == 0) + ROLL


class ChunkCoder:
    """Encodes texts to (count, ids joined by a space, decoded text) with reuse of chunks and words."""

    def __init__(self, tokenizer, room: int) -> None:
        self.tokenizer, self.room = tokenizer, room
        self.separator = next((t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (t.single_word or t.lstrip or t.rstrip or t.normalized)), None)
        self.cut = self.tokenizer.token_to_id(self.separator) if self.separator else None
        size = self.tokenizer.get_vocab_size()
        self.names = [self.tokenizer.id_to_token(i) for i in range(size)] if self.tokenizer.decoder is None else None
        self.digits = [str(i) for i in range(size)]
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.array([(self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(size)]) if suffix else None
        self.words: dict[str, tuple[int, str, str]] = {}
        self.chunks: dict[str, tuple[int, str, str]] = {}
        self.old_words, self.old_chunks = self.words, self.chunks
        self.word_chars = self.chunk_chars = 0

    def _put(self, word: str, ids: list[int]) -> None:
        digits, names = self.digits, self.names
        plain = " ".join([names[i] for i in ids]) if names else self.tokenizer.decode(ids, skip_special_tokens=False)
        self.words[word] = (len(ids), " ".join([digits[i] for i in ids]), plain)
        self.word_chars += len(word)

    def learn(self, words: list[str]) -> None:
        """Encode strings that are new, many in one call.

        Where the vocabulary marks ends of words, strings of letters, which are
        one word each, are told apart by the marks; the rest by an added token
        between them, which ends whatever it stands beside.
        """
        if self.word_chars > self.room // 2:  # what is still in use comes over from the old generation
            self.old_words, self.words, self.word_chars = self.words, {}, 0
        new = []
        for w in dict.fromkeys(words):
            if w not in self.words:
                if w in self.old_words:
                    self.words[w] = self.old_words[w]
                    self.word_chars += len(w)
                else:
                    new.append(w)
        if self.last is not None:
            letters = [w for w in new if w.isalpha() and w.lower().isalpha()]
            for at in range(0, len(letters), GROUP):
                group = letters[at : at + GROUP]
                ids = self.tokenizer.encode(" ".join(group), add_special_tokens=False).ids
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) == len(group) and (not ids or ends[-1] == len(ids)):
                    start = 0
                    for w, end in zip(group, ends.tolist(), strict=True):
                        self._put(w, ids[start:end])
                        start = end
            new = [w for w in new if w not in self.words]
        plain = [w for w in new if self.separator and self.separator not in w]
        for at in range(0, len(plain), GROUP):
            group = plain[at : at + GROUP]
            ids = self.tokenizer.encode(self.separator.join(group), add_special_tokens=False).ids
            ends = np.append(np.flatnonzero(np.array(ids) == self.cut), len(ids)).tolist()
            start = 0
            for w, end in zip(group, ends, strict=True):
                self._put(w, ids[start:end])
                start = end + 1
        rest = [w for w in new if not self.separator or self.separator in w]
        for w, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False), strict=True):
            self._put(w, e.ids)

    def _join(self, parts: list[tuple[int, str, str]]) -> tuple[int, str, str]:
        parts = [p for p in parts if p[0]]
        return sum(p[0] for p in parts), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])

    @staticmethod
    def pieces(text: str) -> Iterator[tuple[bool, str]]:
        """(is a chunk's inside, string) in order: insides between safe cuts, and repaired joins between them."""
        held, at = "", 0
        for end in [*cuts(text).tolist(), len(text)]:
            chunk, at = text[at:end], end
            first = _SAFE.search(chunk)
            if first is None:  # no safe cut: the window widens into the next chunk
                held += chunk
                continue
            stop = max(chunk.rfind(" "), chunk.rfind("\n"))
            yield False, held + chunk[: first.start()]
            yield True, chunk[first.end() : stop]
            held = chunk[stop + 1 :]
        yield False, held

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        plans, new = [], []
        if self.chunk_chars > self.room // 2:
            self.old_chunks, self.chunks, self.chunk_chars = self.chunks, {}, 0
        fresh: dict[str, list[str]] = {}
        for text in texts:
            plan = [(inside, s) for inside, s in self.pieces(text) if s]
            plans.append(plan)
            for inside, s in plan:
                if not inside:
                    new.append(s)
                elif s in self.old_chunks and s not in self.chunks:
                    self.chunks[s] = self.old_chunks[s]
                    self.chunk_chars += len(s)
                elif s not in self.chunks and s not in fresh:
                    fresh[s] = [w for w in _SAFE.split(s) if w]
                    new += fresh[s]
        self.learn(new)
        words = self.words
        for s, parts in fresh.items():
            self.chunks[s] = self._join([words[w] for w in parts])
            self.chunk_chars += len(s)
        return [self._join([self.chunks[s] if inside else words[s] for inside, s in plan]) for plan in plans]


#: Tokens on either side of a join that are encoded again at first; ids that must agree at either end of the window.
JOIN, AGREE = 16, 4


class JoinCoder:
    """As ChunkCoder, for any tokenizer: joins are repaired until the ids agree."""

    def __init__(self, tokenizer, room: int) -> None:
        from tokenizers.processors import ByteLevel

        self.tokenizer, self.room = tokenizer, room
        self.tokenizer.post_processor = ByteLevel(trim_offsets=False)  # adds no ids; offsets take in the white space of a token
        self.chunks: dict[str, tuple[list, list]] = {}
        self.old_chunks, self.chunk_chars = self.chunks, 0

    def _tokens(self, text: str) -> tuple[list[int], list[int]]:
        """ids, and the place behind each."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return e.ids, [b for _, b in e.offsets]

    def _chunk(self, chunk: str) -> tuple[list[int], list[int]]:
        if (got := self.chunks.get(chunk)) is None:
            got = self.old_chunks.get(chunk) or self._tokens(chunk)
            if self.chunk_chars > self.room // 2:
                self.old_chunks, self.chunks, self.chunk_chars = self.chunks, {}, 0
            self.chunks[chunk] = got
            self.chunk_chars += len(chunk)
        return got

    def _joined(self, text: str) -> list[int]:
        ids, ends, at = [], [], 0
        for stop in [*cuts(text).tolist(), len(text)]:
            new, new_ends = self._chunk(text[at:stop])
            reach = JOIN if ids else 0
            while reach:
                i, j = max(0, len(ids) - reach), min(len(new), reach)
                start, end = (ends[i - 1] if i else 0), (at + new_ends[j - 1] if 0 < j < len(new) else stop)
                window, window_ends = self._tokens(text[start:end])
                before = i == 0 or (window[:AGREE] == ids[i : i + AGREE] and [start + x for x in window_ends[:AGREE]] == ends[i : i + AGREE])
                behind = j == len(new) or (window[-AGREE:] == new[j - AGREE : j] and [start + x for x in window_ends[-AGREE:]] == [at + x for x in new_ends[j - AGREE : j]])
                if before and behind:
                    ids[i:], ends[i:] = window, [start + x for x in window_ends]
                    new, new_ends = new[j:], new_ends[j:]
                    break
                reach *= 2
            ids += new
            ends += [at + x for x in new_ends]
            at = stop
        return ids

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        made = [self._joined(t) for t in texts]
        return [(len(i), " ".join(map(str, i)), self.tokenizer.decode(i, skip_special_tokens=False)) for i in made]


def drops_space(tokenizer) -> bool:
    """Whether white space only parts words: no token, added token or normalisation reaches across it."""
    if tokenizer.pre_tokenizer is None:
        return False
    if any(t.lstrip or t.rstrip or _SAFE.search(t.content) for t in tokenizer.get_added_tokens_decoder().values()):
        return False
    sample = "a b\nc  d \n e"
    plain = tokenizer.normalizer.normalize_str(sample) if tokenizer.normalizer else sample
    return [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(plain)] == list("abcde")


def coder(path: str, room: int | None = None) -> ChunkCoder | JoinCoder:
    """The coder that fits a tokenizer file; room: characters of keys that it keeps, CACHE_CHARS if not given."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return (ChunkCoder if drops_space(tokenizer) else JoinCoder)(tokenizer, room or CACHE_CHARS)


@lru_cache(maxsize=2)
def _coder(path: str, room: int | None) -> ChunkCoder | JoinCoder:
    return coder(path, room)


def encode_decode(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, room: int | None = None) -> DataFrame:
    """key, n_tokens, ids_text (decimal ids joined by a space), decoded of every row.

    `tokenizer` is the path of a tokenizer file, present on every executor; ids
    are those of the tokenizers library for the whole text, without special
    tokens. Null counts as empty: no ids and an empty decoded text. Null keys and
    repeated rows give a row each, an empty table none. Columns other than
    `keep`, whatever their names, are not read. `room` bounds what a worker keeps
    for reuse (characters of keys, some 40 bytes each). A very long text is held whole
    with its ids in one task.
    """

    def run(texts: list) -> list[list]:
        made = _coder(tokenizer, room).encode([t or "" for t in texts])
        return [list(c) for c in zip(*made, strict=True)]

    return map_texts(df, [key, *(keep or [])], text, run, "n_tokens long, ids_text string, decoded string")


def ids(ids_text: str = "ids_text"):
    """The ids of encode_decode as an array of ints."""
    return F.when(F.col(ids_text) == "", F.array().cast("array<int>")).otherwise(F.split(ids_text, " ").cast("array<int>"))
