"""Byte-level BPE: a lazily determinised transducer for encoding, a streaming decoder.

A configuration of the machine is an open token: the token before it and its place in the trie of all tokens.
A byte moves each configuration along the trie; where that ends a token which the merges leave beside the one
before, the token closes there and a new configuration begins behind it. Only one division of a piece has
neighbours that all stand the merges, so at each byte one token closes at most. Sets of configurations are
the states of a deterministic machine, whose moves are made when texts first ask for them. A move says
which token closes at its byte; the tokens that all open configurations agree on are emitted, after a
lookahead of a few lengths of the longest token at most.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: States, entries of a memo's generation, pairs of tokens that a worker holds at most of before it starts anew.
STATES, HELD, PAIRS = 400_000, 240_000, 400_000
#: Bytes of a piece after which settled tokens are emitted.
STRETCH = 4096


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file (base64 and id on each line), read by Spark."""
    lines = [r[0].split() for r in spark.read.text(path).collect()] if "://" in path else [x.split() for x in open(path, "rb")]
    return {base64.b64decode(x[0]): int(x[1]) for x in lines if x}


#: Where a text may be cut: before a lone space between two characters that aren't white.
BETWEEN = re.compile(r"(?<=\S)(?= \S)").split


class Memo:
    """A bounded memo in two generations: when the young one is full, the old one goes."""

    def __init__(self, size: int = HELD):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        self.young[key] = value


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.length = {i: len(b) for b, i in ranks.items()}
        # The trie of all tokens, its root 0: by node << 8 | byte the next node, the token that ends there (or -1)
        # and whether longer ones go on.
        nodes: dict[int, int] = {}
        self.depth, ends, inner = [0], {}, set()
        for data, token in ranks.items():
            node = 0
            for byte in data:
                inner.add(node)
                key = node << 8 | byte
                if key not in nodes:
                    nodes[key] = len(self.depth)
                    self.depth.append(self.depth[node] + 1)
                node = nodes[key]
            ends[node] = token
        self.trie = {key: (node, ends.get(node, -1), node in inner) for key, node in nodes.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}
        self.made = 0
        self._reset()

    def _reset(self) -> None:
        """A state is a dict from a byte to the next state. Under -1 it holds what it stands for, the token before
        and the trie node of each open token in turn; under -2 the token that closed at the byte that led here, or
        -1. A node of 0 is that of the token to begin."""
        self.start = {-1: (-1, 0), -2: -1}
        self.states = {self.start[-1]: self.start}

    def merge(self, data: bytes, below: int = 1 << 62) -> list[int]:
        """Ids by the merges of rank under ``below``: the adjacent pair of least rank first, leftmost of
        equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; a token that no merge makes is its own halves."""
        known = self.parts.get(token)
        if known is None:
            ids = self.merge(self.bytes_of[token], below=token)
            known = self.parts[token] = (ids[0], ids[1]) if len(ids) == 2 else (token, token)
        return known

    def follows(self, a: int, b: int) -> bool:
        """Whether the merges leave token b beside token a; a of -1: whether they reach b alone.

        The merges build a and b apart unless some merge across the border comes earlier than the ones
        that close it off: the border's tokens are taken apart from the latest merge back, and at each
        stage the merge across must not exist or come later than what was undone."""
        parts, ranks, bytes_of = self.parts, self.ranks, self.bytes_of
        one = parts.get(b) or self.halves(b)
        if one[0] == b and self.length[b] > 1:
            return False
        if a < 0:
            return True
        limit = 1 << 62
        while True:
            across = ranks.get(bytes_of[a] + bytes_of[b])
            if across is not None and across < limit and (parts.get(across) or self.halves(across)) == (a, b):
                return False
            inner_a, inner_b = (parts.get(a) or self.halves(a))[1], (parts.get(b) or self.halves(b))[0]
            # The later of the two last merges is undone first; at equal places the left one came first.
            if inner_a != a and (a > b or inner_b == b):
                limit, a = a, inner_a
            elif inner_b != b:
                limit, b = b + 1, inner_b
            else:
                return True

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a piece, each byte a move of the machine."""
        if len(self.states) > STATES:
            self._reset()
        out: list[int] = []
        passed: list[dict] = []
        state, add = self.start, passed.append
        for at in range(0, len(piece), STRETCH):
            end = min(at + STRETCH, len(piece))
            while at < end:
                held = len(passed)
                try:
                    for byte in piece[at:end]:
                        state = state[byte]
                        add(state)
                    break
                except KeyError:  # a move that wasn't made yet
                    at += len(passed) - held
                    state = self._move(state, piece[at])
                    add(state)
                    at += 1
            if end < len(piece):
                self._emit(passed, self._settled(passed), out)
        self._emit(passed, len(passed), out)
        if len(out) > 1 and piece in self.ranks:
            return (self.ranks[piece],)  # a token that merges don't reach stands for itself alone
        return tuple(out)

    def _move(self, state: dict, byte: int) -> dict:
        """Makes the move of a state by a byte."""
        self.made += 1
        held, trie, pairs = state[-1], self.trie, self.pairs
        moved, closes = [], -1
        for k in range(0, len(held), 2):
            hop = trie.get(held[k + 1] << 8 | byte)
            if hop is None:
                continue
            node, token, deeper = hop
            before = held[k]
            if deeper:
                moved += before, node
            if token >= 0 > closes:
                known = pairs.get(before << 32 | token)
                if known is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    known = pairs[before << 32 | token] = self.follows(before, token)
                if known:
                    closes = token
        if closes >= 0:
            moved += closes, 0
        if not moved:
            raise ValueError("the vocabulary lacks a byte")
        key = tuple(moved)
        target = self.states.get(key)
        if target is None:
            target = self.states[key] = {-1: key, -2: closes}
        state[byte] = target
        return target

    def _settled(self, passed: list[dict]) -> int:
        """The last place that the divisions before all open tokens have in common."""
        places = {len(passed) - self.depth[node] for node in passed[-1][-1][1::2]}
        while len(places) > 1:
            last = max(places)
            places.remove(last)
            places.add(last - self.length[passed[last - 1][-2]])
        return max(places.pop(), 0)

    def _emit(self, passed: list[dict], upto: int, out: list[int]) -> None:
        """Adds the tokens up to a place to ``out`` and forgets the states passed there."""
        at, size, back = upto, self.length, []
        while at:
            token = passed[at - 1][-2]
            if token < 0:
                raise ValueError("the vocabulary lacks a byte")
            back.append(token)
            at -= size[token]
        out += back[::-1]
        del passed[:upto]


def _utf8_table() -> list[int]:
    """By state << 8 | byte the next state of a UTF-8 reader: 0 between characters, -1 an error; 1 to 3: so many
    continuation bytes to come; 4 to 7 behind the leads E0, ED, F0 and F4, whose next byte has a narrower range."""
    table = [-1] * 2048
    spans = [(0, 0x00, 0x7F, 0), (0, 0xC2, 0xDF, 1), (0, 0xE1, 0xEC, 2), (0, 0xEE, 0xEF, 2), (0, 0xF1, 0xF3, 3), (0, 0xE0, 0xE0, 4), (0, 0xED, 0xED, 5), (0, 0xF0, 0xF0, 6), (0, 0xF4, 0xF4, 7)]
    spans += [(1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)]
    for state, low, high, after in spans:
        for byte in range(low, high + 1):
            table[state << 8 | byte] = after
    return table


_UTF8 = _utf8_table()


class Utf8Decoder:
    """Bytes in, characters out: a state machine over lead and continuation bytes keeps what is open.

    A sequence that goes on wrongly gives one replacement character for the part that was right so far, and the
    byte begins anew."""

    def __init__(self) -> None:
        self.state, self.open = 0, b""

    def feed(self, data: bytes) -> str:
        if not self.state and data.isascii():
            return data.decode("ascii")
        out, held, state, table = [], bytearray(self.open), self.state, _UTF8
        for byte in data:
            after = table[state << 8 | byte]
            if after < 0 and state:
                out.append("\ufffd")
                held.clear()
                after = table[byte]
            held.append(byte)
            if after < 0:
                out.append("\ufffd")
                held.clear()
                after = 0
            elif not after:
                out.append(held.decode("utf-8"))
                held.clear()
            state = after
        self.state, self.open = state, bytes(held)
        return "".join(out)

    def close(self) -> str:
        rest, self.state, self.open = self.open, 0, b""
        return "\ufffd" if rest else ""


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine = Transducer(ranks)
        self.find = regex.compile(pattern).findall
        self.words, self.pieces = Memo(HELD), Memo(HELD // 4)
        self.bytes_of = self.machine.bytes_of
        #: What a token gives a decoder between characters, and whether it leaves it there.
        self.texts: dict[int, tuple[str, bool]] = {}

    def _piece(self, piece: str) -> tuple[int, ...]:
        if piece[0] == " " and len(piece) > 1 and not piece[1].isspace() and not piece[-1].isspace():
            ids = self.words.get(piece[1:])
            return self._only(piece) if ids is None else ids
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.machine.encode(piece.encode("utf-8", "surrogatepass"))
            if len(piece) <= 64:
                self.pieces.put(piece, ids)
        return ids

    def _only(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece that is a space and a word which the memo of words lacks."""
        ids = self.machine.encode(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= 65:
            self.words.put(piece[1:], ids)
        return ids

    def _run(self, run: str) -> tuple[int, ...]:
        """Ids of a run of text that no match crosses the ends of."""
        return tuple(i for m in self.find(run) for i in self._piece(m))

    def _word(self, word: str) -> tuple[int, ...] | None:
        """Ids of a space and a word behind it; None where a word is empty or has white space at an end."""
        ids = self.words.get(word)
        if ids is None:
            if not word or word[0].isspace() or word[-1].isspace():
                return None
            found = self.find(run := " " + word)
            if found == [run]:
                return self._only(run)
            ids = tuple(i for m in found for i in self._piece(m))
            if len(word) <= 64:
                self.words.put(word, ids)
        return ids

    def encode(self, text: str) -> list[int]:
        """A match never crosses a lone space between two other characters that aren't white space: each
        alternative takes a space only as its first character or in a run of white space. So a text falls
        into runs there, and equal runs have equal ids."""
        words = text.split(" ")
        if len(words) > 1 and (not words[0] or words[0][-1].isspace()):
            return self._by_runs(text)
        out = list(self._run(words[0]))
        memo, young = self.words, self.words.young.get
        for word in words[1:]:
            ids = young(word)
            if ids is None:
                ids = self._word(word)
                if ids is None:
                    return self._by_runs(text)
                young = memo.young.get
            out += ids
        return out

    def _by_runs(self, text: str) -> list[int]:
        out: list[int] = []
        for run in BETWEEN(text):
            ids = self._word(run[1:]) if run[:1] == " " else None
            out += self._run(run) if ids is None else ids
        return out

    def decode(self, ids: list[int]):
        """Text in pieces, from ids in turn."""
        stream, of, known = Utf8Decoder(), self.bytes_of, self.texts
        whole = True
        for i in ids:
            if whole:
                got = known.get(i)
                if got is None:
                    text = stream.feed(of[i])
                    got = known[i] = (text, not stream.state)
                    whole = got[1]
                elif not got[1]:
                    stream.feed(of[i])
                    whole = False
                yield got[0]
            else:
                yield stream.feed(of[i])
                whole = not stream.state
        yield stream.close()


class Digests:
    """Of lists of ids: lengths, digests of the ids and of the bytes that they decode to, and the number of characters
    that the streaming decoder gives."""

    def __init__(self, own: Tokenizer):
        self.own, top = own, max(own.bytes_of, default=-1) + 1
        self.names = pa.array([b"%d," % i for i in range(top)], pa.large_binary())
        self.data = pa.array([own.bytes_of.get(i, b"") for i in range(top)], pa.large_binary())
        #: Characters of a token that a decoder between characters takes whole, else -1.
        self.chars = np.full(top, -1)
        for i, data in own.bytes_of.items():
            stream = Utf8Decoder()
            text = stream.feed(data)
            if not stream.state:
                self.chars[i] = len(text)

    def of(self, lists: list[list[int]]) -> list[list]:
        sha, own = hashlib.sha256, self.own
        ids = np.array(list(itertools.chain.from_iterable(lists)), np.int64)
        ends = np.cumsum([0, *map(len, lists)])
        (names, data), at = (self.joined(x, ids) for x in (self.names, self.data)), ends.tolist()
        out: list[list] = [[len(x) for x in lists], [], [], []]
        for k, (low, high) in enumerate(itertools.pairwise(at)):
            out[1].append(sha(names[0][names[1][low] : max(names[1][high] - 1, names[1][low])]).hexdigest())
            out[2].append(sha(data[0][data[1][low] : data[1][high]]).hexdigest())
            chars = self.chars[ids[low:high]]
            out[3].append(sum(map(len, own.decode(lists[k]))) if (chars < 0).any() else int(chars.sum()))
        return out

    @staticmethod
    def joined(values: pa.LargeBinaryArray, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The values of ids behind one another, and where each begins; the last place is the end."""
        taken = values.take(pa.array(ids))
        _, ends, held = taken.buffers()
        return memoryview(held or b""), np.frombuffer(ends, np.int64, len(ids) + 1)


_OWN: dict[tuple[int, int, str], Tokenizer] = {}


def tokenizer(ranks: dict[bytes, int], pattern: str) -> Tokenizer:
    """A worker's tokenizer, kept over its tasks."""
    key = (len(ranks), hash(frozenset(ranks.items())), pattern)
    if key not in _OWN:
        _OWN.clear()
        _OWN[key] = Tokenizer(ranks, pattern)
        # States and memos are many small objects that stay: to walk them often costs a tenth of a worker's time.
        gc.freeze()
        gc.set_threshold(100_000, 20, 20)
    return _OWN[key]


def encode_texts(docs: DataFrame, keep: list[str], ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """``keep`` with ids array<int>. Null and empty texts give an empty array."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary: fixed size

    def make():
        own = tokenizer(shared.value, pattern)
        return lambda texts: ([own.encode(t or "") for t in texts],)

    return map_texts(docs, keep, text, "ids array<int>", make)


def decode_ids(rows: DataFrame, keep: list[str], ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """``keep`` with the text of ids; null gives null, bytes that aren't UTF-8 the replacement character."""
    shared = rows.sparkSession.sparkContext.broadcast(ranks)

    def make():
        own = tokenizer(shared.value, "")
        return lambda held: ([None if x is None else "".join(own.decode(x)) for x in held],)

    return map_texts(rows, keep, ids, "text string", make)


def bpe_digests(docs: DataFrame, keep: list[str], ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """``keep`` with n_tokens, ids_sha256, decoded_sha256 and n_chars (characters that the streaming decoder
    gives), without storing the ids. Null texts are empty."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def make():
        own = tokenizer(shared.value, pattern)
        digests = Digests(own)

        def run(texts):
            made, part, n = [[], [], [], []], [], 0
            for k, t in enumerate(texts):
                part.append(own.encode(t or ""))
                n += len(part[-1])
                if n >= 200_000 or k + 1 == len(texts):  # ids whose names and bytes are held at a time
                    for column, x in zip(made, digests.of(part), strict=True):
                        column += x
                    part, n = [], 0
            return made

        return run

    return map_texts(docs, keep, text, "n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars long", make)


def op6_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(spark, vocabulary or public_tokenizers.path(VOCABULARY))
    return bpe_digests(table(spark, sf_dir, "documents"), ["doc_id"], ranks, public_tokenizers.PATTERN)


QUERIES = {"op6_bpe": op6_bpe}
SQL: dict[str, str] = {}
