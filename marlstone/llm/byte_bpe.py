"""Byte-level BPE: a lazily determinised transducer for encoding, a UTF-8 state machine for decoding.

Encoding rests on two facts about BPE: a token sequence is the encoding of its bytes exactly if each
pair of neighbours is the encoding of its own bytes, and so the encodings of the prefixes of a text
form a tree in which each prefix has one last token. The transducer reads a byte at a time. A state is
the prefixes from which a longer token may still grow: the bytes since the first of them, which say
where the others begin, and the last token of each. A move says which token ends at the byte; tokens
are emitted as soon as all prefixes of the state agree on them, so the lookahead is bounded by the
longest token. States and moves are built when first met and then reused by every piece. When
MAX_STATES are built the table is emptied and the machine goes on from the state it is in.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import keep_between_tasks, tidy

#: States of the transducer that are kept at once, and pieces whose ids a generation remembers.
MAX_STATES = 150_000
MAX_PIECES = 600_000
MAX_PIECE_CHARS = 64
#: Bytes of a piece after which the tokens settled by then are emitted.
EMIT_BYTES = 4_096


def read_ranks(path: str, max_bytes: int = 64_000_000) -> bytes:
    """A rank file (base64 token, space, rank, per line), for shipping to executors; its size is checked."""
    with open(path, "rb") as f:
        data = f.read(max_bytes + 1)
    if len(data) > max_bytes:
        raise ValueError(f"{path} is larger than {max_bytes} bytes")
    return data


class Utf8Machine:
    """The automaton of well-formed UTF-8. State 0 is between characters; others are (bytes left, low, high)."""

    def __init__(self) -> None:
        self.states: list[tuple[int, int, int]] = [(0, 0, 0)]
        self.number = {self.states[0]: 0}

    def _to(self, left: int, low: int = 0x80, high: int = 0xBF) -> int:
        key = (left, low, high)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key]

    def step(self, state: int, byte: int) -> int:
        """The next state, or -1 if the byte can't stand here."""
        left, low, high = self.states[state]
        if left:
            return -1 if not low <= byte <= high else self._to(left - 1) if left > 1 else 0
        if byte < 0x80:
            return 0
        if 0xC2 <= byte <= 0xDF:
            return self._to(1)
        if 0xE0 <= byte <= 0xEF:
            return self._to(2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF)
        if 0xF0 <= byte <= 0xF4:
            return self._to(3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF)
        return -1


class Vocabulary:
    """Tokens and ranks of a vocabulary, the encoding transducer and what decoding needs."""

    def __init__(self, rank_file: bytes, pattern: str) -> None:
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        if missing := [b for b in range(256) if bytes([b]) not in self.rank]:
            raise ValueError(f"no token for the bytes {missing[:5]}")
        #: The tokens that merging their own bytes gives; the others only stand for a whole piece.
        self.made = {t: r for t, r in self.rank.items() if len(t) == 1 or self.merges(t) == [r]}
        self.token = np.empty(max(self.rank.values()) + 1, object)
        for t, r in self.rank.items():
            self.token[r] = t
        #: The trie of those: byte to (the token that ends here or -1, the nodes below or None).
        self.trie: dict[int, tuple[int, dict | None]] = {}
        for t, r in sorted(self.made.items()):
            node = self.trie
            for byte in t[:-1]:
                token, below = node[byte] if byte in node else (-1, None)
                if below is None:
                    below = {}
                    node[byte] = (token, below)
                node = below
            node[t[-1]] = (r, node[t[-1]][1] if t[-1] in node else None)
        self.pattern = regex.compile(pattern)
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        #: For each left token, whether right tokens fit it; `_known` counts these.
        self._fits: list[dict[int, bool]] = [{} for _ in self.token]
        self._known = 0
        #: For the bytes since a state's first prefix, how many bytes ago each prefix ended and its place in the trie.
        self.live: dict[bytes, tuple[tuple[int, dict], ...]] = {b"": ((0, self.trie),)}
        self.ends: list[int] = []
        self.moves: dict[int, int] = {}
        self._reset()
        self.sizes = [len(t) if t is not None else 0 for t in self.token]
        #: All tokens one after another, and where each begins and ends.
        self.bytes = np.frombuffer(b"".join(t or b"" for t in self.token), np.uint8)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])
        self.clean = np.zeros(len(self.token), bool)
        for t, r in self.rank.items():
            try:
                t.decode()
                self.clean[r] = True
            except UnicodeDecodeError:
                pass

    def merges(self, data: bytes) -> list[int]:
        """BPE by definition: merge the leftmost pair of lowest rank until there is none. Only for short strings."""
        rank, none = self.rank, 1 << 40
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank.get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs and (best := min(pairs)) != none:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = rank.get(parts[i] + parts[i + 1], none)
        return [rank[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens are the encoding of their joined bytes."""
        known = self._fits[left]
        found = known.get(right)
        if found is None:
            if self._known > 500_000:
                for d in self._fits:
                    d.clear()
                self._known = 0
            self._known += 1
            found = known[right] = self.merges(self.token[left] + self.token[right]) == [left, right]
        return found

    def _reset(self) -> None:
        """Forget all states; 0 is the beginning of a piece. The tables are emptied in place, as loops hold them."""
        #: A state: the bytes since its first prefix, and the last token of each prefix from there on (-1: none).
        self.states: list[tuple[bytes, tuple[int, ...]]] = []
        self.number: dict[tuple[bytes, tuple[int, ...]], int] = {}
        #: The token that ends where a state is reached.
        self.ends.clear()
        #: state * 256 + byte to the next state.
        self.moves.clear()
        self._number((b"", (-1,)))

    def _number(self, key: tuple[bytes, tuple[int, ...]]) -> int:
        """The number of a state, which is new if need be."""
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.states)
            self.states.append(key)
            self.ends.append(key[1][-1])
        return found

    def _move(self, state: int, byte: int) -> int:
        """Build the move of a state by a byte."""
        key = self.states[state]
        if len(self.states) >= MAX_STATES:
            self._reset()
            state = self._number(key)
        pending, lasts = key
        ended, grown, nodes, kept = -1, b"", [], []
        for (size, node), last in zip(self.live[pending], lasts, strict=True):
            token, below = node.get(byte, (-1, None))
            if token >= 0 and ended < 0 and (last < 0 or self.fits(last, token)):
                ended = token
            if below:
                if not nodes:
                    grown = pending[len(pending) - size :] + bytes([byte])
                nodes.append((size + 1, below))
                kept.append(last)
        if grown not in self.live:
            self.live[grown] = (*nodes, (0, self.trie))
        to = self.moves[state << 8 | byte] = self._number((grown, (*kept, ended)))
        return to

    def _back(self, ends: list[int], end: int) -> list[int]:
        """The tokens of the prefix of length `end`; each position has the token that ends there."""
        out = []
        while end:
            out.append(ends[end - 1])
            end -= self.sizes[out[-1]]
        out.reverse()
        return out

    def _settled(self, ends: list[int], state: int) -> int:
        """The length of the longest prefix that all prefixes of a state go through."""
        places = {len(ends) - size for size, _ in self.live[self.states[state][0]]}
        while len(places) > 1:
            far = max(places)
            places.remove(far)
            places.add(far - self.sizes[ends[far - 1]])
        return places.pop()

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one match of the pattern."""
        if (whole := self.rank.get(piece)) is not None:
            return (whole,)
        out: list[int] = []
        ends: list[int] = []
        state, move, token = 0, self.moves.get, self.ends
        for byte in piece:
            to = move(state << 8 | byte)
            state = self._move(state, byte) if to is None else to
            ends.append(token[state])
            if len(ends) >= EMIT_BYTES and not len(ends) % EMIT_BYTES:
                done = self._settled(ends, state)
                out += self._back(ends, done)
                del ends[:done]
        return (*out, *self._back(ends, len(ends)))

    def _new_piece(self, piece: str) -> tuple[int, ...]:
        """The ids of a piece that the younger generation lacks; it joins that generation."""
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode_piece(piece.encode())
        if len(piece) <= MAX_PIECE_CHARS:
            if len(self.young) >= MAX_PIECES:
                self.old, self.young = self.young, {}
            self.young[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids of a text; every match of the pattern is encoded separately."""
        out: list[int] = []
        for piece in self.pattern.findall(text):
            out += self.young.get(piece) or self._new_piece(piece)
        return out


class StreamDecoder:
    """Decodes ids that arrive in blocks; each block gives the characters that are complete by then.

    The state machine steps over whole tokens: moves (state, token) are built when first met. Bytes
    that can't be UTF-8 are passed through by `feed` and become U+FFFD in `text`.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.utf8, self.state, self.rest = vocabulary, Utf8Machine(), 0, b""
        self.moves: dict[tuple[int, int], tuple[int, int]] = {}

    def _move(self, state: int, token: int) -> tuple[int, int]:
        """The state after a token, and how many of its bytes end at or before a character's end (-1: none)."""
        key, done = (state, token), -1
        for i, byte in enumerate(self.v.token[token]):
            after = self.utf8.step(state, byte)
            if after < 0:  # what is pending is no character; a new one may begin with this byte
                done = i
                after = max(0, self.utf8.step(0, byte))
            state = after
            if state == 0:
                done = i + 1
        self.moves[key] = (state, done)
        return state, done

    def feed(self, ids: Iterable[int]) -> bytes:
        """The bytes of the characters completed by these ids."""
        v, ids = self.v, np.asarray(ids, np.int64)
        sizes = v.begins[ids + 1] - v.begins[ids]
        after = np.cumsum(sizes) + len(self.rest)
        shift = np.repeat(v.begins[ids] - after + sizes, sizes)
        data = self.rest + v.bytes[shift + np.arange(len(self.rest), len(self.rest) + len(shift))].tobytes()
        # Between characters the machine stands still over tokens of whole characters.
        odd = np.flatnonzero(~v.clean[ids])
        at = done = 0
        while at < len(ids):
            if self.state == 0:
                k = int(np.searchsorted(odd, at))
                if k == len(odd):
                    done = len(data)
                    break
                at = int(odd[k])
                done = int(after[at] - sizes[at])
            token = int(ids[at])
            self.state, whole = self.moves.get((self.state, token)) or self._move(self.state, token)
            if whole >= 0:
                done = int(after[at] - sizes[at]) + whole
            at += 1
        self.rest = data[done:]
        return data[:done]

    def finish(self) -> bytes:
        """The bytes of a last character that was not completed."""
        rest, self.rest, self.state = self.rest, b"", 0
        return rest


_LOADED: dict[str, Vocabulary] = {}
keep_between_tasks(__name__, _LOADED.clear)


def vocabulary(rank_file: bytes, pattern: str) -> Vocabulary:
    """The vocabulary, built once per Python process."""
    key = hashlib.sha256(rank_file + pattern.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(rank_file, pattern)
        gc.set_threshold(200_000, 50, 1_000)  # remembered pieces and states are many small objects without cycles
    return _LOADED[key]


def decode(v: Vocabulary, ids: Iterable[int], block: int = 65_536) -> bytes:
    """The bytes of a list of ids, through the stream decoder block by block."""
    d, ids = StreamDecoder(v), np.asarray(ids, np.int64)
    return b"".join([*(d.feed(ids[i : i + block]) for i in range(0, len(ids), block)), d.finish()])


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per document row: doc_id, n_tokens, ids (if with_ids), ids_sha256, decoded_sha256.

    ids_sha256 digests the ids as little-endian unsigned 32-bit integers, decoded_sha256 the bytes
    that decoding the ids gives. Null text counts as empty (no ids). Repeated rows each give a row, an
    empty table none, and a null id stays null. Other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    fields = [("doc_id", "long", pa.int64()), ("n_tokens", "long", pa.int64()), ("ids", "array<int>", pa.list_(pa.int32())), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    fields = [f for f in fields if with_ids or f[0] != "ids"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shipped.value, pattern)
        schema = pa.schema([(n, t) for n, _, t in fields])
        for batch in batches:
            n_tokens, all_ids, id_digests, digests = [], [], [], []
            for text in batch.column(1):
                ids = v.encode(text.as_py() or "")
                packed = np.asarray(ids, "<u4")
                n_tokens.append(len(ids))
                id_digests.append(hashlib.sha256(packed.tobytes()).hexdigest())
                digests.append(hashlib.sha256(decode(v, packed)).hexdigest())
                if with_ids:
                    all_ids.append(packed.astype(np.int32))
            cols = {"doc_id": batch.column(0), "n_tokens": n_tokens, "ids": all_ids, "ids_sha256": id_digests, "decoded_sha256": digests}
            yield pa.RecordBatch.from_arrays([cols[n] if n == "doc_id" else pa.array(cols[n], t) for n, _, t in fields], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(encode), ", ".join(f"{n} {t}" for n, t, _ in fields))


def decode_documents(encoded: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: doc_id and the text of its ids; null ids give null, bytes that are no UTF-8 give U+FFFD."""
    shipped = encoded.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shipped.value, pattern)
        for batch in batches:
            texts = [None if ids is None else decode(v, ids).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(tidy(run), "doc_id long, text string")
