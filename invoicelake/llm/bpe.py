"""BPE encoding and decoding: merge rounds in numpy over the symbols of many words at once."""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from invoicelake.llm.common import hash_spans, with_columns_by

#: Words whose ids a worker keeps; other words are merged anew in each slice.
KEPT_WORDS = 150_000
_NEVER = np.int64(1) << 62
# How the two kinds of vocabulary cut a text.
_WORD_ENDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
_BYTE_LEVEL = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_SHORT = re.compile(rb"'(s|t|re|ve|m|ll|d)")
# The same classes for the first 256 code points.
_SIGN, _LETTER, _NUMBER, _BLANK = range(4)
_KINDS = np.array(
    [
        next((k for k, p in ((_LETTER, "L"), (_NUMBER, "N"), (_BLANK, "White_Space")) if regex.match(rf"\p{{{p}}}", chr(c))), _SIGN)
        for c in range(256)
    ],
    np.uint8,
)


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """A tokenizer file of the `tokenizers` library, kinds byte-level BPE and BPE with word ends."""

    def __init__(self, path: str, special: bool = True) -> None:
        """`special`: whether special tokens within a text are cut out of it, or are text like any other."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocabulary: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = added if special else {}
        self.folds = spec["normalizer"] is not None
        self.pattern = _WORD_ENDS if self.folds else _BYTE_LEVEL
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        end = model.get("end_of_word_suffix") or ""
        characters = _byte_characters()
        self.inner = np.array([vocabulary[c] for c in characters], np.int64)
        self.final = np.array([vocabulary[c + end] for c in characters], np.int64)
        self.size = max([*vocabulary.values(), *added.values()]) + 1
        self.tokens = [""] * self.size
        for token, number in [*vocabulary.items(), *added.items()]:
            self.tokens[number] = token
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        left, right = (np.array([vocabulary[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        born = np.full(self.size, -1)
        born[made[::-1]] = np.arange(len(made))[::-1]
        #: Parts of a pair come from earlier merges, so a merge never yields a pair that should have come before it.
        self.in_order = bool((np.maximum(born[left], born[right]) < np.arange(len(made))).all())

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of pairs by binary search; _NEVER for those that don't merge."""
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], _NEVER), self.made[at]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of non-empty words in a row, and how many each has.

        Each round finds the lowest rank of every word and merges its pairs from the left, in all words at once.
        """
        n = len(words)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols, last = self.inner[raw], np.cumsum(sizes) - 1
        symbols[last] = self.final[raw[last]]
        word = np.repeat(np.arange(n), sizes)
        rank, made = np.full(len(symbols), _NEVER), np.zeros(len(symbols), np.int64)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside], made[inside] = self._look_up(symbols[inside], symbols[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lowest = np.minimum.reduceat(rank, first)
            widths = np.diff(np.append(first, len(symbols)))
            live = np.repeat(lowest < _NEVER, widths)
            if not live.all():
                done.append((word[~live], symbols[~live]))
                word, symbols, rank, made = word[live], symbols[live], rank[live], made[live]
                widths, lowest = widths[lowest < _NEVER], lowest[lowest < _NEVER]
                if not len(symbols):
                    break
            picked = np.flatnonzero(rank == np.repeat(lowest, widths))
            if self.in_order:  # of a run of overlapping pairs (equal symbols), every second one
                fresh = np.concatenate(([True], np.diff(picked) != 1))
                run = np.flatnonzero(fresh)
                picked = picked[(np.arange(len(picked)) - np.repeat(run, np.diff(np.append(run, len(picked))))) % 2 == 0]
            else:  # the leftmost only
                picked = picked[np.concatenate(([True], word[picked][1:] != word[picked][:-1]))]
            symbols[picked] = made[picked]
            keep = np.ones(len(symbols), bool)
            keep[picked + 1] = False
            at = np.cumsum(keep)[picked] - 1
            word, symbols, rank, made = word[keep], symbols[keep], rank[keep], made[keep]
            changed = np.zeros(len(symbols), bool)
            changed[at] = True
            changed[at[at > 0] - 1] = True
            touched = np.flatnonzero(changed)
            rank[touched] = _NEVER
            touched = touched[touched + 1 < len(symbols)]
            touched = touched[word[touched] == word[touched + 1]]
            rank[touched], made[touched] = self._look_up(symbols[touched], symbols[touched + 1])
        word, ids = (np.concatenate([x[k] for x in done]) for k in (0, 1))
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=n)

    def folded(self, text: str) -> str:
        if self.folds:
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final form
            text = text.lower()
        return text

    def latin(self, text: str | None) -> bytes | None:
        """A text as one byte a character, if it has no special token and all its characters are below U+0100."""
        try:
            return None if text and any(t in text for t in self.special) else self.folded(text or "").encode("latin-1")
        except UnicodeEncodeError:
            return None

    def pieces(self, text: str) -> list[str]:
        """The words of any text in order, special tokens among them."""
        parts = self.cut.split(text) if self.special else [text]
        return [w for p in parts for w in ([p] if p in self.special else self.pattern.findall(self.folded(p)))]

    def latin_pieces(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end byte of the words of texts in a row (see `latin`): what `pieces` finds, for all at once."""
        n = len(raw)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = _KINDS[raw]
        fresh = np.zeros(n, bool)  # a text starts here
        fresh[starts[:-1][starts[:-1] < n]] = True
        begin = fresh.copy()
        begin[0] = True
        begin[1:] |= kind[1:] != kind[:-1]
        free = begin & (kind == _SIGN) & (raw == ord("'"))  # an apostrophe that starts a run of signs
        if self.folds:
            begin |= kind == _NUMBER
        else:
            before = np.zeros(n, bool)  # a white character right before another kind in the same text
            before[:-1] = (kind[:-1] == _BLANK) & (kind[1:] != _BLANK) & ~fresh[1:]
            begin |= before
            after = np.flatnonzero(before & (raw == ord(" "))) + 1
            begin[after] = False
            free[after] = False
        for at in np.flatnonzero(free).tolist():
            text_end = int(starts[np.searchsorted(starts, at, side="right")])
            if m := _SHORT.match(raw[at : min(at + 3, text_end)].tobytes()):
                begin[at + 1] = False
                if at + m.end() < text_end:
                    begin[at + m.end()] = True
        first = np.flatnonzero(begin)
        end = np.append(first[1:], n)
        if self.folds:
            solid = kind[first] != _BLANK
            first, end = first[solid], end[solid]
        return first, end


class _Codes(dict):
    """Code of each word; a new word gets the next code."""

    def __init__(self) -> None:
        super().__init__()
        self.next = 0

    def __missing__(self, word: str) -> int:
        code = self[word] = self.next
        self.next += 1
        return code


class Encoder:
    """Encodes texts; keeps the ids of the first KEPT_WORDS words that it meets."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.ids, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.codes = _Codes()  # of words of any text
        self.hashes, self.hash_codes = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # of words of latin texts, sorted
        for token in vocabulary.special:
            self.codes[token]
        self._add(np.array([*vocabulary.special.values()], np.int64), np.ones(len(vocabulary.special), np.int64))

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
        self.sizes = np.concatenate((self.sizes, sizes))

    def _latin_codes(self, raw: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Codes of words by their 64-bit hash, and the words that are new, in the order of their codes."""
        distinct, where, back = np.unique(hash_spans(raw, first, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        codes = np.empty(len(distinct), np.int64)
        codes[known] = self.hash_codes[at[known]]
        fresh = np.flatnonzero(~known)
        codes[fresh] = self.codes.next + np.arange(len(fresh))
        self.codes.next += len(fresh)
        self.hashes = np.insert(self.hashes, at[fresh], distinct[fresh])
        self.hash_codes = np.insert(self.hash_codes, at[fresh], codes[fresh])
        data = raw.tobytes()
        spans = zip(first[where[fresh]].tolist(), end[where[fresh]].tolist(), strict=True)
        return codes[back], [data[a:b].decode("latin-1").encode() for a, b in spans]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a row, and where each starts (one more entry than texts)."""
        known = self.codes.next
        latin = [self.vocabulary.latin(t) for t in texts]
        plain = np.array([x is not None for x in latin], bool)
        counts = np.zeros(len(texts), np.int64)
        blocks = [x for x in latin if x is not None]
        starts = np.cumsum([0, *map(len, blocks)])
        raw = np.frombuffer(b"".join(blocks), np.uint8)
        first, end = self.vocabulary.latin_pieces(raw, starts)
        counts[plain] = np.diff(np.searchsorted(first, starts))
        plain_codes, fresh = self._latin_codes(raw, first, end)
        middle = self.codes.next
        others = [self.vocabulary.pieces(t) for t, x in zip(texts, latin, strict=True) if x is None]
        counts[~plain] = [len(x) for x in others]
        other_codes = np.fromiter((self.codes[w] for x in others for w in x), np.int64)
        new = self.codes.next - middle
        fresh += [w.encode() for w in list(self.codes)[len(self.codes) - new :]] if new else []
        self._add(*self.vocabulary.merge(fresh))
        words = np.empty(int(counts.sum()), np.int64)
        of_plain = np.repeat(plain, counts)
        words[of_plain], words[~of_plain] = plain_codes, other_codes
        sizes = self.sizes[words]
        ends = np.cumsum(sizes)
        source = np.cumsum(self.sizes) - self.sizes
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(source[words] - ends + sizes, sizes)]
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        if self.codes.next > KEPT_WORDS:
            self._forget(max(known, KEPT_WORDS))
        return ids, bounds

    def _forget(self, keep: int) -> None:
        """Drops the words from code `keep` on."""
        while self.codes and next(reversed(self.codes.values())) >= keep:
            self.codes.popitem()
        self.codes.next = keep
        stays = self.hash_codes < keep
        self.hashes, self.hash_codes = self.hashes[stays], self.hash_codes[stays]
        self.sizes = self.sizes[:keep]
        self.ids = self.ids[: int(self.sizes.sum())]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special: bool = True) -> Encoder:
    """The encoder of this worker for a tokenizer file (see Vocabulary)."""
    if (path, special) not in _ENCODERS:
        _ENCODERS[path, special] = Encoder(Vocabulary(path, special))
    return _ENCODERS[path, special]


def decode_ids(vocabulary: Vocabulary, ids: pa.Array) -> pa.Array:
    """Tokens of each list of ids, joined by a space; ids that the vocabulary lacks are skipped. Null stays null."""
    flat = ids.values.slice(ids.offsets[0].as_py(), ids.offsets[-1].as_py() - ids.offsets[0].as_py()) if len(ids) else ids.values
    values = flat.to_numpy(zero_copy_only=False).astype(np.int64)
    known = (values >= 0) & (values < vocabulary.size)
    offsets = (ids.offsets.to_numpy() - (ids.offsets[0].as_py() if len(ids) else 0)).astype(np.int64)
    if not known.all():
        offsets = np.concatenate(([0], np.cumsum(known)))[offsets]
        values = values[known]
    names = pa.array(vocabulary.tokens, pa.string())
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), names.take(pa.array(values)))
    joined = pc.binary_join(lists, " ")
    return pc.if_else(ids.is_null(), pa.scalar(None, pa.string()), joined) if ids.null_count else joined


def bpe_encode(
    docs: DataFrame, tokenizer: str, text: str = "text", into: str = "ids", decoded: str | None = None
) -> DataFrame:
    """`docs` with the ids of the whole `text` as the `tokenizers` library gives them without special tokens.

    Null and empty texts get an empty list; special tokens within a text are cut out of it first, as there. `decoded`
    names a column for what `bpe_decode` makes of these ids, for one pass instead of two. Columns of the same names
    are replaced, every other column passes unchanged, repeated rows stay. Row by row: no shuffle.
    """

    def compute(texts: pa.Array) -> list[pa.Array]:
        tool = encoder(tokenizer)
        ids, starts = tool.encode(texts.to_pylist())
        lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))
        return [lists, decode_ids(tool.vocabulary, lists)] if decoded else [lists]

    fields = [T.StructField(into, T.ArrayType(T.IntegerType(), True))]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType()))
    return with_columns_by(docs, text, fields, compute)


def bpe_decode(docs: DataFrame, tokenizer: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """`docs` with the text of a list of ids, special tokens included; null stays null, an empty list gives ''.

    For vocabularies without a decoder the library joins tokens by a space, and so does this.
    """

    def compute(lists: pa.Array) -> list[pa.Array]:
        return [decode_ids(encoder(tokenizer).vocabulary, lists)]

    return with_columns_by(docs, ids, [T.StructField(into, T.StringType())], compute)
