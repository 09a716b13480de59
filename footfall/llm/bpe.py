"""Byte-level BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The leaves of the tree are the pairs of neighbouring symbols, each with ``rank * width + position``; the root is the
leftmost pair of the lowest rank. A merge changes three leaves, so it costs three walks to the root, and encoding ends
when the root holds no mergeable pair. Many short pieces of text are encoded side by side: one tree per row of an array,
every array operation doing one step of all of them. Pieces longer than ``WIDEST`` get a tree of their own.

Null texts count as empty and give no ids. Ids outside the vocabulary are an error when decoding.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame

from footfall.llm.common import map_batches

WIDEST = 64
# Pieces whose ids a worker remembers; beyond it the memory is emptied and filled anew.
REMEMBERED = 600_000
# Rows of side-by-side trees, which bounds the memory of one call.
TREES = 16_384

# Splitting rule of the vocabulary (fixed value): contractions, letters, numbers, other signs, white space.
_PIECES = r"'(?:[stmd]|re|ve|ll)| ?{L}+| ?{N}+| ?[^{S}{l}{n}]+|[{S}]+(?![^{S}])|[{S}]+"
_SPACE = r"\t-\r \x85\xa0"
# Below U+0250 the classes are short, and the standard library's matcher is several times faster.
_LATIN_LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_LATIN_NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN = re.compile(
    _PIECES.format(
        L=f"[{_LATIN_LETTERS}]", N=f"[{_LATIN_NUMBERS}]", S=_SPACE, l=_LATIN_LETTERS, n=_LATIN_NUMBERS
    )
)
_BEYOND_LATIN = re.compile(r"[^\x00-\u024f]")
_ANY = regex.compile(
    _PIECES.format(
        L=r"\p{L}",
        N=r"\p{N}",
        S=r"\p{White_Space}",
        l=r"\p{L}",
        n=r"\p{N}",
    )
)


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where printable, else from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(others)}


class ByteBpe:
    """A vocabulary file of the ``tokenizers`` library, read without that library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError(f"{path}: only plain byte-level BPE is supported")
        if spec["pre_tokenizer"]["add_prefix_space"] or any(
            token["lstrip"] or token["rstrip"] or token["single_word"] for token in spec["added_tokens"]
        ):
            raise ValueError(f"{path}: prefix spaces and stripping added tokens are not supported")
        vocabulary: dict[str, int] = spec["model"]["vocab"]
        characters = byte_characters()
        self.byte_ids = np.array([vocabulary[characters[b]] for b in range(256)], np.int64)
        self.size = max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.none = len(pairs)  # the rank of a pair that has no merge
        self.ranks = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        order = np.argsort(keys, kind="stable")
        self._keys, self._key_ranks = keys[order], order.astype(np.int64)
        bytes_of = {c: b for b, c in characters.items()}
        self.token_bytes: list[bytes | None] = [None] * self.size
        for token, i in vocabulary.items():
            self.token_bytes[i] = bytes(bytes_of[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            known = all(c in bytes_of for c in content)
            self.token_bytes[i] = bytes(bytes_of[c] for c in content) if known else content.encode()
        longest_first = sorted(self.added, key=len, reverse=True)
        self._added = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None
        self._known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """The text cut into the pieces that merges never cross; added tokens are pieces of their own."""
        parts = self._added.split(text) if self._added else [text]
        found: list[str] = []
        for k, part in enumerate(parts):
            if k % 2:
                found.append(part)
            elif part:
                found += (_ANY if _BEYOND_LATIN.search(part) else _LATIN).findall(part)
        return found

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._key_ranks[at], self.none)

    def encode_short(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pieces of 1 to ``WIDEST`` bytes, one segment tree per row and all rows in step."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = 1 << max(1, int(lengths.max() - 1).bit_length())
        rows = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(rows, width)
        # Column ``width`` stands for "no symbol"; left and right hold the neighbours' places.
        symbol = np.zeros((rows, width + 1), np.int64)
        symbol[:, :width] = self.byte_ids[raw]
        place = np.arange(width)
        inside = place[None, :] < lengths[:, None]
        right = np.where(place[None, :] + 1 < lengths[:, None], place[None, :] + 1, width)
        right = np.concatenate([right, np.full((rows, 1), width)], axis=1)
        left = np.concatenate([np.where(place > 0, place - 1, width), [width]])[None, :].repeat(rows, axis=0)
        nothing = (self.none + 1) * width
        leaves = np.full((rows, width), nothing, np.int64)
        paired = inside & (right[:, :width] < width)
        r, c = np.nonzero(paired)
        rank = self._pair_ranks(symbol[r, c], symbol[r, c + 1])
        leaves[r, c] = np.where(rank < self.none, rank * width + c, nothing)
        tree = np.full((rows, 2 * width), nothing, np.int64)
        tree[:, width:] = leaves
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        alive = inside.copy()
        live = np.nonzero(tree[:, 1] < nothing)[0]
        while len(live):
            root = tree[live, 1]
            at, merge = root % width, root // width
            gone = right[live, at]
            after, before = right[live, gone], left[live, at]
            symbol[live, at] = self.merged[merge]
            alive[live, gone] = False
            right[live, at] = after
            left[live, after] = at  # column ``width`` takes the writes that have no symbol
            for spot, near, first, second in ((at, after, at, after), (before, before, before, at)):
                rank = self._pair_ranks(symbol[live, first], symbol[live, second])
                value = np.where((near < width) & (rank < self.none), rank * width + spot, nothing)
                real = spot < width
                self._update(tree, live[real], spot[real], value[real], width)
            self._update(tree, live, gone, np.full(len(live), nothing), width)
            live = live[tree[live, 1] < nothing]
        packed = symbol[:, :width][alive].astype("<u4").tobytes()
        ends = (4 * np.cumsum(alive.sum(axis=1))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    @staticmethod
    def _update(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray, width: int) -> None:
        node = leaf + width
        tree[rows, node] = value
        while width > 1:
            node >>= 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            width //= 2

    def encode_long(self, piece: bytes) -> list[int]:
        """Ids of one piece of any length, with one segment tree: n log n steps."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        symbol = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        right, left = [*range(1, n), -1], [-1, *range(n - 1)]
        nothing = (self.none + 1) * width

        def value(i: int) -> int:
            if i < 0 or right[i] < 0:
                return nothing
            rank = self.ranks.get(symbol[i] * self.size + symbol[right[i]])
            return nothing if rank is None else rank * width + i

        tree = [nothing] * (2 * width)
        tree[width : width + n] = map(value, range(n))
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def update(i: int, new: int) -> None:
            node = i + width
            tree[node] = new
            node >>= 1
            while node:
                new = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == new:
                    break
                tree[node] = new
                node >>= 1

        while tree[1] < nothing:
            merge, i = divmod(tree[1], width)
            gone = right[i]
            symbol[i] = int(self.merged[merge])
            right[i] = right[gone]
            if right[i] >= 0:
                left[right[i]] = i
            symbol[gone] = -1
            update(gone, nothing)
            update(i, value(i))
            if left[i] >= 0:
                update(left[i], value(left[i]))
        return [s for s in symbol if s >= 0]

    def learn(self, pieces: set[str]) -> None:
        """Encodes pieces that are not remembered yet."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            if piece in self.added:
                self._known[piece] = np.array([self.added[piece]], "<u4").tobytes()
            elif len(raw) > WIDEST:
                self._known[piece] = np.array(self.encode_long(raw), "<u4").tobytes()
            else:
                by_width.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for group in by_width.values():
            for k in range(0, len(group), TREES):
                part = group[k : k + TREES]
                packed = self.encode_short([raw for _, raw in part])
                self._known.update(zip((piece for piece, _ in part), packed, strict=True))

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.pieces(text) for text in texts]
        if len(self._known) > REMEMBERED:
            self._known.clear()
        new = set().union(*cut).difference(self._known)
        self.learn(new)
        known = self._known
        return [b"".join([known[p] for p in pieces]) for pieces in cut]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        table = self.token_bytes
        if ids and (min(ids) < 0 or max(ids) >= self.size):
            raise ValueError("an id is outside the vocabulary")
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """The vocabulary, read once in each worker; ``path`` has to exist on every executor."""
    return ByteBpe(path)


def encode(df: DataFrame, path: str, key: str = "doc_id", key_type: str = "bigint", text: str = "text") -> DataFrame:
    """``key, ids array<int>``: the token ids of every whole text."""

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        model = load(path)
        for keys, texts in batches:
            packed = model.encode_packed([t or "" for t in texts])
            yield [keys, [np.frombuffer(p, "<u4").tolist() for p in packed]]

    return map_batches(df, [key, text], run, f"`{key}` {key_type}, ids array<int>")


def decode(df: DataFrame, path: str, key: str = "doc_id", key_type: str = "bigint", ids: str = "ids") -> DataFrame:
    """``key, text``: the text of every list of ids (null: empty)."""

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        model = load(path)
        for keys, lists in batches:
            yield [keys, [model.decode(x or []) for x in lists]]

    return map_batches(df, [key, ids], run, f"`{key}` {key_type}, text string")


def round_trip_digests(
    df: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256``, if asked for ``ids``: encodes whole texts and decodes the ids again.

    Both directions run in one pass, so that ids do not travel to the JVM and back. Rows stay as they come: repeated
    rows give repeated rows, a null key stays null.
    """

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        model = load(path)
        for keys, texts in batches:
            packed = model.encode_packed([t or "" for t in texts])
            back = (model.decode(np.frombuffer(p, "<u4").tolist()) for p in packed)
            yield [
                keys,
                [len(p) // 4 for p in packed],
                [hashlib.sha256(p).hexdigest() for p in packed],
                [hashlib.sha256(b.encode("utf-8")).hexdigest() for b in back],
                *([[np.frombuffer(p, "<u4").astype(np.int32) for p in packed]] if with_ids else []),
            ]

    schema = f"`{key}` bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" if with_ids else ""
    return map_batches(df, [key, text], run, schema)
