"""Byte-level BPE of rank files: a segment tree over byte positions finds the leftmost lowest pair of each piece."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from invoicelake.llm.common import with_columns_by

#: Pieces whose ids a worker keeps; other pieces are merged anew in each slice.
KEPT_PIECES = 200_000
#: Pieces of up to so many bytes are merged many at a time, longer ones one by one.
TOGETHER = 64
_NEVER = np.int64(1) << 62


def white_space_of_unicode(pattern: str) -> str:
    """The pattern with \\s and \\S as the White_Space property, as the rank files' library has it."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class Ranks:
    """A rank file: the token of each rank, and the rank of each pair of tokens that makes another one."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pattern = regex.compile(white_space_of_unicode(pattern))
        keys, made = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    made.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int64)[order]

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, _NEVER for those that make no token; a negative token is none."""
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (left >= 0) & (right >= 0), self.made[at], _NEVER)


def merge_one(ranks: Ranks, piece: bytes) -> list[int]:
    """Ids of one piece.

    Leaf i of the tree has the rank of the pair whose left token starts at byte i, together with i, so the root has the
    leftmost of the lowest. A merge changes three leaves: that of the merged token, of the one before, and of the byte
    where the right token started.
    """
    n = len(piece)
    width = 1 << max(1, (n - 1).bit_length())
    tokens = ranks.single[np.frombuffer(piece, np.uint8)]
    never = int(_NEVER)
    first = ranks.pair(tokens[:-1], tokens[1:])
    leaves = np.full(width, never)
    leaves[: n - 1] = np.where(first < _NEVER, first * width + np.arange(n - 1), never)
    levels = [leaves]
    while len(levels[0]) > 1:
        levels.insert(0, np.minimum(levels[0][::2], levels[0][1::2]))
    tree = [never, *np.concatenate(levels).tolist()]
    after, before, token = list(range(1, n + 1)), list(range(-1, n - 1)), tokens.tolist()
    table = ranks.tokens

    def put(at: int, value: int) -> None:
        at += width
        tree[at] = value
        while at > 1:
            other = tree[at ^ 1]
            value = value if value < other else other
            at >>= 1
            if tree[at] == value:
                break
            tree[at] = value

    def pair(at: int) -> int:
        right = after[at]
        rank = ranks.ranks.get(table[token[at]] + table[token[right]]) if right < n else None
        return never if rank is None else rank * width + at

    while tree[1] < never:
        rank, at = divmod(tree[1], width)
        gone = after[at]
        token[at], after[at] = rank, after[gone]
        if after[at] < n:
            before[after[at]] = at
        put(gone, never)
        put(at, pair(at))
        if at > 0:
            put(before[at], pair(before[at]))
    out, at = [], 0
    while at < n:
        out.append(token[at])
        at = after[at]
    return out


def merge_many(ranks: Ranks, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces of 1 to TOGETHER bytes in a row, and how many each has: one tree a piece, all merged in step.

    In each round every piece that still has a pair merges the one at the root of its tree.
    """
    count = len(pieces)
    sizes = np.fromiter(map(len, pieces), np.int64, count)
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    width = 1 << int(max(1, int(sizes.max()) - 1).bit_length())
    depth = width.bit_length() - 1
    # one place more at each end, where a token of no piece (-1) stands
    token = np.full((count, width + 2), -1, np.int64)
    inside = np.arange(width + 2)[None, :] <= sizes[:, None]
    inside[:, 0] = False
    token[inside] = ranks.single[raw]
    tree = np.full((count, 2 * width), _NEVER)
    places = np.arange(width)
    found = ranks.pair(token[:, 1:-1].ravel(), token[:, 2:].ravel()).reshape(count, width)
    tree[:, width:] = np.where(found < _NEVER, found * width + places, _NEVER)
    for level in range(depth - 1, -1, -1):
        a, b = 1 << level, 2 << level
        tree[:, a:b] = np.minimum(tree[:, b : 2 * b : 2], tree[:, b + 1 : 2 * b : 2])
    after = np.tile(np.arange(1, width + 3), (count, 1))
    before = np.tile(np.arange(-1, width + 1), (count, 1))
    live = np.flatnonzero(tree[:, 1] < _NEVER)
    while len(live):
        rank, at = np.divmod(tree[live, 1], width)
        at += 1
        gone = after[live, at]
        follows = after[live, gone]
        token[live, at], token[live, gone] = rank, -1
        after[live, at] = follows
        before[live, follows] = at
        left = before[live, at]
        ahead = ranks.pair(rank, token[live, follows])
        behind = ranks.pair(token[live, left], rank)
        tree[live, width + gone - 1] = _NEVER
        tree[live, width + at - 1] = np.where(ahead < _NEVER, ahead * width + at - 1, _NEVER)
        inner = left > 0  # nothing stands to the left of the first byte
        changed = np.where(behind < _NEVER, behind * width + left - 1, _NEVER)
        tree[live[inner], width + left[inner] - 1] = changed[inner]
        nodes = [width + np.where(inner, place, at) - 1 if place is left else width + place - 1 for place in (gone, at, left)]
        for _ in range(depth):
            for k in range(3):
                nodes[k] = nodes[k] >> 1
                tree[live, nodes[k]] = np.minimum(tree[live, 2 * nodes[k]], tree[live, 2 * nodes[k] + 1])
        live = live[tree[live, 1] < _NEVER]
    kept = token >= 0
    return token[kept], kept.sum(axis=1)


def merge_pieces(ranks: Ranks, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of non-empty pieces in a row, and how many each has. A piece that is a token is not taken apart."""
    sizes = np.zeros(len(pieces), np.int64)
    groups: dict[int, list[int]] = {}
    for k, piece in enumerate(pieces):
        width = 0 if piece in ranks.ranks else len(piece).bit_length() if len(piece) <= TOGETHER else TOGETHER
        groups.setdefault(width, []).append(k)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for width, members in groups.items():
        own = [pieces[k] for k in members]
        if width == 0:
            ids, n = np.array([ranks.ranks[p] for p in own], np.int64), np.ones(len(own), np.int64)
        elif width == TOGETHER:
            lists = [merge_one(ranks, p) for p in own]
            ids, n = np.array([i for x in lists for i in x], np.int64), np.array([len(x) for x in lists], np.int64)
        else:
            ids, n = merge_many(ranks, own)
        sizes[members] = n
        done.append((np.array(members), n, ids))
    out = np.empty(int(sizes.sum()), np.int64)
    start = np.cumsum(sizes) - sizes
    for members, n, ids in done:
        out[np.arange(len(ids)) + np.repeat(start[members] - (np.cumsum(n) - n), n)] = ids
    return out, sizes


class _Codes(dict):
    """Code of each piece; a new piece gets the next code."""

    def __missing__(self, piece: str) -> int:
        code = self[piece] = len(self)
        return code


class RankEncoder:
    """Encodes texts; keeps the ids of the first KEPT_PIECES pieces that it meets."""

    def __init__(self, ranks: Ranks) -> None:
        self.ranks, self.codes = ranks, _Codes()
        self.ids, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a row, and where each starts (one more entry than texts)."""
        known = len(self.codes)
        counts, codes = [0], []
        for text in texts:
            found = self.ranks.pattern.findall(text or "")
            counts.append(len(found))
            codes.append(np.fromiter(map(self.codes.__getitem__, found), np.int64, len(found)))
        new = len(self.codes) - known
        if new:
            fresh = [p.encode() for p in list(self.codes)[known:]]
            ids, sizes = merge_pieces(self.ranks, fresh)
            self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
            self.sizes = np.concatenate((self.sizes, sizes))
        pieces = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        sizes = self.sizes[pieces]
        ends = np.cumsum(sizes)
        first = np.cumsum(self.sizes) - self.sizes
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(first[pieces] - ends + sizes, sizes)]
        bounds = np.concatenate(([0], ends))[np.cumsum(counts)]
        for _ in range(len(self.codes) - max(known, KEPT_PIECES)):
            self.codes.popitem()
        self.sizes = self.sizes[: len(self.codes)]
        self.ids = self.ids[: int(self.sizes.sum())]
        return ids, bounds


_ENCODERS: dict[tuple[str, str], RankEncoder] = {}


def rank_encoder(path: str, pattern: str) -> RankEncoder:
    """The encoder of this worker for a rank file."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = RankEncoder(Ranks(path, pattern))
    return _ENCODERS[path, pattern]


def decode_ranks(ranks: Ranks, ids: pa.Array) -> pa.Array:
    """The bytes of each list of ids. A null list gives null, an empty one no bytes; unknown and null ids give none."""
    table = pa.array([*ranks.tokens, b""], pa.binary())
    flat = ids.flatten()  # without what null lists hide
    values = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.where((values >= 0) & (values < ranks.size), values, ranks.size)
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    taken = table.take(pa.array(values))
    # the bytes of the tokens stand in a row already; only the bounds of the lists are taken
    buffers = taken.buffers()
    at = np.frombuffer(buffers[1], np.int32)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int32)
    bounds = np.ascontiguousarray(at[offsets])
    data = buffers[2] if len(taken) and buffers[2] is not None else pa.py_buffer(b"")
    out = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(bounds), data])
    return pc.if_else(ids.is_null(), pa.scalar(None, pa.binary()), out) if ids.null_count else out


def rank_encode(
    docs: DataFrame, ranks: str, pattern: str, text: str = "text", into: str = "ids", decoded: str | None = None
) -> DataFrame:
    """`docs` with the ids of the whole `text` by a rank file, each match of `pattern` separately, no special tokens.

    Null and empty texts get an empty list. `decoded` names a column for the bytes of these ids. Columns of the same
    names are replaced, every other column passes unchanged, repeated rows stay. Row by row: no shuffle.
    """

    def compute(texts: pa.Array) -> list[pa.Array]:
        tool = rank_encoder(ranks, pattern)
        ids, starts = tool.encode(texts.to_pylist())
        lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids, pa.int32()))
        return [lists, decode_ranks(tool.ranks, lists)] if decoded else [lists]

    fields = [T.StructField(into, T.ArrayType(T.IntegerType(), True))]
    if decoded:
        fields.append(T.StructField(decoded, T.BinaryType()))
    return with_columns_by(docs, text, fields, compute)


def rank_decode(docs: DataFrame, ranks: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """`docs` with the bytes of a list of ids; null stays null, an empty list gives none, unknown ids are skipped."""

    def compute(lists: pa.Array) -> list[pa.Array]:
        return [decode_ranks(rank_encoder(ranks, pattern).ranks, lists)]

    return with_columns_by(docs, ids, [T.StructField(into, T.BinaryType())], compute)
