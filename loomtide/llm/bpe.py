"""Byte-level BPE as a lazily determinised finite-state transducer.

A sequence of tokens is the BPE encoding of its bytes exactly when each token
encodes itself and each two neighbours encode themselves when joined. So a
nondeterministic machine over bytes suffices: it walks a trie of the tokens, and at
a token's end may close it, if it agrees with the token before, and start the
next. ``Transducer`` determinises this machine as texts need it: a state is the set of
live hypotheses (token before, trie node), and a transition records which
hypothesis each one came from and the token it closed on the way. At most one
hypothesis closes at a place, and all die within the length of the longest token, which
bounds the lookahead: where one is left, the tokens before it are certain and are emitted.
Whether two tokens agree is compiled from the merges on demand.

Text is first split by the tokenizer's pattern; each match is its own sequence,
and the outputs of matches are memoised within a worker, up to a bound.

Decoding is streamed: a decoder takes ids in pieces, looks up their bytes and runs a
UTF-8 state machine over them, whole tokens at a time where they start and
end between characters.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .storage import small_batches

MEMO = 600_000
STATES = 300_000
#: A hypothesis is an integer: (token before + 1) << NODE_BITS | trie node.
NODE_BITS = 24
NODE_MASK = (1 << NODE_BITS) - 1
#: White space of the pattern language; the regex library's \s also takes U+001C to U+001F.
WHITE = r"\t-\r \x85\xa0  -     　"


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


def compile_pattern(pattern: str):
    own = pattern.replace(r"[^\s", rf"[^{WHITE}").replace(r"\S", rf"[^{WHITE}]").replace(r"\s", rf"[{WHITE}]")
    return regex.compile(own, regex.V0)


class Transducer:
    """Encodes byte sequences by the ranks of a byte-level BPE vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                at = self.children[node].get(byte)
                if at is None:
                    at = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = at
            self.token_at[node] = rank
        self.longest = max(map(len, ranks), default=0)
        self._fates: dict[int, int] = {}
        self._split: dict[int, tuple[int, int] | None] = {}
        self._reset()

    def _reset(self) -> None:
        self._number: dict[tuple, int] = {}
        self._states: list[tuple[tuple[int, ...], int, int]] = []
        self._moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._start = self._state((0,))

    def _state(self, live: tuple[int, ...]) -> int:
        """A state's number; its entry is the hypotheses, and the place and token of the one that can close."""
        at = self._number.get(live)
        if at is None:
            at = self._number[live] = len(self._states)
            closing = next((i for i, h in enumerate(live) if self._fate_of(h) >= 0), -1)
            self._states.append((live, closing, self._fate_of(live[closing]) if closing >= 0 else -1))
        return at

    def _fate_of(self, hypothesis: int) -> int:
        """The token a hypothesis can close here; -1 if it can only go on, -2 if it can do neither."""
        fate = self._fates.get(hypothesis)
        if fate is None:
            before, node = (hypothesis >> NODE_BITS) - 1, hypothesis & NODE_MASK
            token = self.token_at[node]
            fate = token if token >= 0 and self.agrees(before, token) else -1 if self.children[node] else -2
            if len(self._fates) > 1_000_000:
                self._fates.clear()
            self._fates[hypothesis] = fate
        return fate

    def _merged(self, data: bytes, until: int = 1) -> list[bytes]:
        """The encoding by its definition, down to ``until`` parts: join the neighbours of lowest rank, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens of a token's last merge; None for a single byte."""
        known = self._split.get(token, 0)
        if known == 0:
            parts = self._merged(self.tokens[token], 2)
            known = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
            if len(parts) > 2 or known and max(known) >= token and len(self.tokens[token]) > 2:
                raise ValueError(f"token {token} does not come from two earlier tokens")
            self._split[token] = known
        return known

    def agrees(self, before: int, token: int) -> bool:
        """Whether ``token`` may follow ``before``; before is -1 at the start.

        Merges happen in order of rank, so undoing them from the last one backwards
        shows every pair that ever met at the border: it would have been merged if its
        rank came before the merge that ended it, the left neighbour's going first on a tie.
        """
        if before < 0:
            return True
        ranks, tokens, never = self.ranks, self.tokens, 1 << 60
        x, y, left_ends, right_ends = before, token, never, never
        while True:
            joined = ranks.get(tokens[x] + tokens[y], never)
            if joined < left_ends and joined <= right_ends and joined != never:
                return False
            halves_x, halves_y = self._halves(x), self._halves(y)
            if halves_x is None and halves_y is None:
                return True
            if halves_y is None or halves_x is not None and x > y:
                left_ends, x = x, halves_x[1]
            else:
                right_ends, y = y, halves_y[0]

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The next state, and for each hypothesis its origin: twice its place, plus 1 if a token was closed."""
        live, closing, token = self._states[state]
        after, origin, fates = [], [], self._fates
        for i, h in enumerate(live):
            child = self.children[h & NODE_MASK].get(byte)
            if child is not None:
                new = (h & ~NODE_MASK) | child
                fate = fates.get(new)
                if (self._fate_of(new) if fate is None else fate) != -2:
                    after.append(new)
                    origin.append(2 * i)
        fresh = self.children[0].get(byte) if closing >= 0 else None
        if fresh is not None:
            after.append((token + 1) << NODE_BITS | fresh)
            origin.append(2 * closing + 1)
        if not after:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        return self._state(tuple(after)), tuple(origin)

    def _emit(self, path: list[int], trail: list[tuple[int, ...]], at: int) -> list[int]:
        """The tokens closed on the way to hypothesis ``at``; path holds the states the trail's moves left."""
        out = []
        for k in range(len(trail) - 1, -1, -1):
            step = trail[k][at]
            at = step >> 1
            if step & 1:
                out.append(self._states[path[k]][2])
        out.reverse()
        return out

    def encode(self, data: bytes) -> list[int]:
        if not data:
            return []
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(self._states) > STATES:
            self._reset()
        out: list[int] = []
        path: list[int] = []
        trail: list[tuple[int, ...]] = []
        state, moves = self._start, self._moves
        for byte in data:
            step = moves.get(state << 8 | byte)
            if step is None:
                step = moves[state << 8 | byte] = self._move(state, byte)
            path.append(state)
            state = step[0]
            trail.append(step[1])
            if len(trail) > 4 * self.longest and len(step[1]) == 1:
                # One hypothesis is left, so the tokens before it are certain.
                out += self._emit(path, trail, 0)
                path.clear()
                trail.clear()
        _, closing, token = self._states[state]
        if closing < 0:
            raise ValueError("the vocabulary cannot end here")
        return [*out, *self._emit(path, trail, closing), token]


class _Memo(dict):
    """Packed little-endian ids of a match; the generation before the present one is kept too."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine, self.older = machine, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            tokens = self.machine.encode(word.encode("utf-8", "surrogatepass"))
            ids = struct.pack(f"<{len(tokens)}I", *tokens)
        if len(word) <= 64:
            self[word] = ids
        return ids


class Utf8Machine:
    """Incremental UTF-8: state 0 lies between characters, others inside one, -1 after an error."""

    def __init__(self):
        step = np.full((8, 256), -1, np.int8)
        step[0, :0x80] = 0
        step[0, 0xC2:0xE0] = 1
        step[0, 0xE0], step[0, 0xE1:0xF0], step[0, 0xED] = 4, 2, 5
        step[0, 0xF0], step[0, 0xF1:0xF4], step[0, 0xF4] = 6, 3, 7
        step[1, 0x80:0xC0] = 0
        step[2, 0x80:0xC0] = 1
        step[3, 0x80:0xC0] = 2
        step[4, 0xA0:0xC0] = 1
        step[5, 0x80:0xA0] = 1
        step[6, 0x90:0xC0] = 2
        step[7, 0x80:0x90] = 2
        self.step = [row.tolist() for row in step]

    def run(self, state: int, data: bytes) -> int:
        for byte in data:
            if state < 0:
                break
            state = self.step[state][byte]
        return state


class StreamDecoder:
    """Feed ids in pieces, get bytes; ``state`` tells whether they are valid and whole UTF-8 so far."""

    def __init__(self, codec: Codec):
        self.codec, self.state = codec, 0

    def feed(self, ids: np.ndarray) -> bytes:
        if len(ids) and int(ids.max()) >= len(self.codec.table):
            raise ValueError("an id is not in the vocabulary")
        odd = ids[~self.codec.neutral[ids]] if self.state == 0 else ids
        # Neutral tokens start and end between characters and leave state 0 as it is,
        # so only a run of others has to be followed; a neutral token inside one ends it in error.
        if len(odd):
            state = self.state
            for i in ids.tolist():
                if state or not self.codec.neutral[i]:
                    state = self.codec.utf8.run(state, self.codec.table[i])
            self.state = state
        return b"".join(map(self.codec.table.__getitem__, ids.tolist()))

    def finish(self) -> bool:
        return self.state == 0


class Codec:
    """Encoder and decoder of one vocabulary and pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        ranks = parse_ranks(rank_file)
        self.machine = Transducer(ranks)
        self.pattern = compile_pattern(pattern)
        self.memo = _Memo(self.machine)
        self.utf8 = Utf8Machine()
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.table[i] = token
        self.neutral = np.array([self.utf8.run(0, t) == 0 for t in self.table], bool)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.memo.__getitem__, self.pattern.findall(text))), "<u4")

    def decode(self, ids: np.ndarray, piece: int = 1 << 16) -> tuple[bytes, bool]:
        """The bytes, and whether they are valid UTF-8."""
        stream = StreamDecoder(self)
        data = b"".join(stream.feed(ids[i : i + piece]) for i in range(0, len(ids), piece))
        return data, stream.finish()


def _rank_file(spark, path: str, pattern: str):
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("a rank file of more than 64 MB is not broadcast")
    return spark.sparkContext.broadcast((data, pattern))


def encode_texts(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", verify: bool = False) -> DataFrame:
    """Every row with its token ids: the columns of ``docs`` and token_ids array<int>.

    ``rank_path`` is read by the driver (at most 64 MB) and broadcast. The whole text
    is encoded, however long, without special tokens; a null or empty text has no ids. Repeated
    rows are encoded each; an empty table gives an empty result. With ``verify`` the ids are decoded
    again by the streaming decoder, and round_trip says whether that gave the text's bytes. Columns of
    ``docs`` named token_ids, or with ``verify`` round_trip, are replaced. Of each row only the text goes to Python.
    """
    small_batches(docs.sparkSession)
    shared = _rank_file(docs.sparkSession, rank_path, pattern)

    @F.arrow_udf("struct<token_ids: array<int>, round_trip: boolean>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = Codec(*shared.value)
        for b in batches:
            ids, same = [], []
            for text in b.to_pylist():
                ids.append(c.encode(text or ""))
                if verify:
                    data, valid = c.decode(ids[-1])
                    same.append(valid and data == (text or "").encode())
            offsets = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32))
            flat = pa.array(np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32))
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, flat), pa.array(same if verify else [None] * len(ids), pa.bool_())], ["token_ids", "round_trip"])

    made = ("token_ids", "round_trip") if verify else ("token_ids",)
    rows = docs.drop(*made)
    held = "_encoded" + "_" * max(map(len, rows.columns), default=0)
    return rows.withColumn(held, encoded(F.col(text_col))).select(*(F.col(f"`{c}`") for c in rows.columns), *(F.col(f"{held}.{c}") for c in made))


def decode_ids(rows: DataFrame, rank_path: str, pattern: str, ids_col: str = "token_ids") -> DataFrame:
    """Every row with decoded binary and valid_utf8 boolean; null ids decode to nothing.

    Ids that the vocabulary lacks raise an error. Columns of these names are replaced.
    """
    small_batches(rows.sparkSession)
    shared = _rank_file(rows.sparkSession, rank_path, pattern)
    rest = rows.drop("decoded", "valid_utf8")
    schema = ", ".join(f"`{n}` {t}" for n, t in rest.dtypes)

    def run(batches):
        c = Codec(*shared.value)  # a task has its own: workers outlive tasks, and a memo is large
        for b in batches:
            column = b.column(b.schema.get_field_index(ids_col))
            out = [c.decode(x.values.to_numpy(zero_copy_only=False).astype("<u4") if x.is_valid else np.zeros(0, "<u4")) for x in column]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([d for d, _ in out], pa.binary()), pa.array([v for _, v in out])], [*b.schema.names, "decoded", "valid_utf8"])

    return rest.mapInArrow(run, f"{schema}, decoded binary, valid_utf8 boolean")


def round_trip(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of encoding and decoding every text: id, n_tokens, ids_sha256, decoded_sha256, valid_utf8.

    Encodes and decodes as ``encode_texts`` and ``decode_ids`` do, in one pass that
    hands on digests alone. Null ids stay null; nulls and empty texts have no tokens.
    """
    small_batches(docs.sparkSession)
    shared = _rank_file(docs.sparkSession, rank_path, pattern)

    def run(batches):
        c = Codec(*shared.value)  # a task has its own: workers outlive tasks, and a memo is large
        for b in batches:
            n, a, d, v = [], [], [], []
            for text in b.column(1).to_pylist():
                ids = c.encode(text or "")
                data, valid = c.decode(ids)
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                d.append(hashlib.sha256(data).hexdigest())
                v.append(valid)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(d), pa.array(v)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "valid_utf8"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string, valid_utf8 boolean")
