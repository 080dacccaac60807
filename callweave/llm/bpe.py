"""BPE encoding and decoding with a pair occurrence index.

The texts of a batch are split into the vocabulary's pre-tokens. The distinct ones that the
worker has not met are laid out one after another as symbols, and an index maps each pair
of neighbours to all its positions in that layout. Ranks with positions are applied in
ascending order, each to all of its positions at once; the lists of the pairs that a merge
makes are updated, and a list drops the positions that earlier merges took.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The splitting patterns that the two vocabulary files name.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: What str.split() takes for white space and the vocabulary does not.
CONTROLS = "\x1c\x1d\x1e\x1f"
#: What Unicode 16 added, which the splitter knows and Python 3.13 does not.
ADDED = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D8F), (0x10EC2, 0x10EC4), (0x11380, 0x113E2), (0x116D0, 0x116E3), (0x11BC0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x16139), (0x16D40, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5FF)]
ADDED_SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
RUN = re.compile(r"\s ")
ENDS = {".", ",", ";", ":", "!", "?"}
#: Pre-tokens that a worker remembers; beyond that it forgets them all.
REMEMBERED = 400_000
#: The same where whole texts are encoded, and the bytes of text that are encoded together:
#: what a slice makes on the way takes some fifty times its text.
ENCODED, SLICE = 100_000, 2 << 20
#: Chunks that share one pair index.
TOGETHER = 200_000
NONE = -1


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


@lru_cache(1)
def late_letters() -> str:
    """Ranges of letters and digits that Unicode got after the tables that the splitter knows."""
    from itertools import groupby

    is_late = regex.compile(r"[\p{L}\p{N}]").match
    late = [c for c in range(0x110000) if unicodedata.category(chr(c))[0] not in "LN" and not 0xD800 <= c < 0xE000 and not any(a <= c <= b for a, b in ADDED) and is_late(chr(c))]
    runs = [[c for _, c in g] for _, g in groupby(enumerate(late), lambda x: x[1] - x[0])]
    return "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs) or "\\U0010ffff"


class Vocabulary:
    """A byte-level BPE vocabulary file (JSON with a model of type BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        ids: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        kinds = json.dumps(spec.get("normalizer") or {})
        self.fold = '"Lowercase"' in kinds
        self.compose = '"NFC"' in kinds
        self.squeeze = '"Replace"' in kinds
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [spec["pre_tokenizer"]]
        named = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), None)
        self.split = regex.compile(named or BYTE_LEVEL)
        self.late = late_letters() if named else None
        self.strict = regex.compile(named.replace(r"[\p{L}]", rf"[\p{{L}}--[{self.late}]]").replace(r"[\p{N}]", rf"[\p{{N}}--[{self.late}]]").replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{self.late}])"), regex.V1) if named else self.split
        self.rare = regex.compile(f"[{self.late}{''.join(map(chr, ADDED_SMALL))}]") if named else None
        self.aside = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.spaced = (spec.get("decoder") or {}).get("type") != "ByteLevel"
        size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens: list[str] = [""] * size
        for t, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = t
        symbols = byte_symbols()
        self.first = np.array([ids[s] for s in symbols], np.int64)
        self.final = np.array([ids[s + self.suffix] for s in symbols], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = size
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        keys = self.left * size + self.right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        pairs = [(f, l) for l in (self.first, self.final) for f in (self.first,)]
        #: Ranks of two neighbouring bytes: [whether the second ends its word, first byte, second byte].
        self.start = np.stack([self.rank_of(np.repeat(f, 256), np.tile(l, 256)).reshape(256, 256) for f, l in pairs])
        back = {s: b for b, s in enumerate(symbols)}
        self.raw = [b"" if t in self.special else bytes(back[c] for c in t.removesuffix(self.suffix)) if all(c in back for c in t.removesuffix(self.suffix)) else t.encode() for t in self.tokens]
        self.bytes = [t.encode() for t in self.tokens]
        self.known: dict[str, bytes] = {}

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where the vocabulary has no such merge."""
        if not len(self.keys):
            return np.full(len(a), NONE)
        want = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where((self.keys[at] == want) & (a >= 0) & (b >= 0), self.ranks[at], NONE)

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """The text cut at special tokens, each cut with the id of the token after it."""
        if self.aside is None or not any(x in text for x in self.special):
            return [(text, None)]
        out, at = [], 0
        for m in self.aside.finditer(text):
            out.append((text[at : m.start()], self.special[m.group()]))
            at = m.end()
        return [*out, (text[at:], None)]

    def normal(self, text: str) -> str:
        if self.compose and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return self.small(text)

    def small(self, text: str) -> str:
        """Lower case, where the vocabulary folds it; a capital sigma has one small form, wherever it stands."""
        return text.replace("Σ", "σ").lower() if self.fold else text

    def cut(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if self.squeeze and text.isalpha() and (one := self.normal(text)).isalpha():
            return [one]
        if self.squeeze and text[-1:] in ENDS and text[:-1].isalpha() and (one := self.normal(text[:-1])).isalpha():
            return [one, text[-1]]
        if self.rare is not None and not text.isascii() and self.rare.search(text):
            return self.strict.findall(self.normal(text.translate(ADDED_SMALL) if self.fold else text))
        return self.split.findall(self.normal(text))

    def chunks(self, text: str) -> list[str]:
        """Parts that encode alone: white space always ends one where pre-tokens never hold any."""
        if not self.squeeze:  # a space starts a part, unless white space before it may go with it
            return self.cut(text) if "\0" in text or RUN.search(text) else text.replace(" ", "\0 ").split("\0")
        return WHITE.split(text) if any(c in text for c in CONTROLS) else text.split()

    def learn(self, new: set[str]) -> None:
        """Encode chunks that are not known yet."""
        for chunks in groups(list(new), TOGETHER):
            cuts = [self.cut(c) for c in chunks]
            words = list({w for c in cuts for w in c})
            ids = dict(zip(words, encode_words(self, [w.encode() for w in words]), strict=True))
            self.known.update((c, ids[w[0]] if len(w) == 1 else b"".join(map(ids.__getitem__, w))) for c, w in zip(chunks, cuts, strict=True))

    def meet(self, texts: list[str], known: dict, most: int = REMEMBERED) -> set[str]:
        """The distinct chunks of the texts that ``known`` lacks; it is emptied first where it would grow too large."""
        new: set[str] = set()
        for text in texts:  # chunks are split again later, as holding all of them takes many times the text
            for part, _ in self.segments(text):
                new.update(self.chunks(part))
        if len(known) + len(new) > most:
            known.clear()
        return new - known.keys()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        self.learn(self.meet(texts, self.known, ENCODED))
        get = self.known.__getitem__
        tail = {i: int(i).to_bytes(4, "little") for i in self.special.values()} | {None: b""}
        return [b"".join([b"".join(map(get, self.chunks(part))) + tail[i] for part, i in self.segments(text)]) for text in texts]

    def decode(self, packed: bytes) -> str:
        """The text of packed ids, special tokens included."""
        ids = np.frombuffer(packed, "<u4").tolist()
        if self.spaced:
            return b" ".join(map(self.bytes.__getitem__, ids)).decode()
        special = set(self.special.values())
        return b"".join(self.bytes[i] if i in special else self.raw[i] for i in ids).decode(errors="replace")


def groups(items: list, most: int) -> Iterator[list]:
    for at in range(0, len(items), most):
        yield items[at : at + most]


def _grouped(ranks: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The positions of each rank, in ascending order; ``at`` ascends already."""
    keep = ranks != NONE
    ranks, at = ranks[keep], at[keep]
    if not len(ranks):
        return
    order = np.argsort(ranks.astype(np.uint16) if len(ranks) > 999 and ranks.max() < 65536 else ranks, kind="stable")
    ranks, at = ranks[order], at[order]
    cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
    yield from zip(ranks[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True)


def encode_words(v: Vocabulary, words: list[bytes]) -> list[bytes]:
    """The ids of pre-tokens, merged through one pair occurrence index over all of them."""
    if not words:
        return []
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(lengths)
    symbol = v.first[raw].astype(np.int32)
    filled = lengths > 0
    symbol[ends[filled] - 1] = v.final[raw[ends[filled] - 1]]
    n = len(symbol)
    nxt, prev = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)  # neighbours within the word, or -1
    last = ends[filled] - 1
    nxt[last] = -1
    prev[(ends - lengths)[filled]] = -1
    inner = np.flatnonzero(nxt >= 0).astype(np.int32)
    index: dict[int, list[np.ndarray]] = {}
    ends_word = (nxt[nxt[inner]] < 0).astype(np.int64)
    for rank, at in _grouped(v.start[ends_word, raw[inner], raw[inner + 1]], inner):
        index[rank] = [at]
    active = list(index)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank, None)
        if lists is None:
            continue
        a, b, made = int(v.left[rank]), int(v.right[rank]), int(v.made[rank])
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[(symbol[at] == a) & (nxt[at] >= 0)]  # a merge may have taken a position since
        if len(at):
            at = at[symbol[nxt[at]] == b]
        if not len(at):
            continue
        if a == b and len(at) > 1:  # in a run of equal symbols every second pair merges, from the left
            follows = np.r_[False, nxt[at[:-1]] == at[1:]]
            start = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
        gone = nxt[at]
        after = nxt[gone]
        symbol[at], symbol[gone] = made, NONE
        nxt[at] = after
        has = after >= 0
        prev[after[has]] = at[has]
        before = prev[at]
        left = before[before >= 0]
        for r, p in _grouped(v.rank_of(symbol[left], symbol[nxt[left]]), left):
            if r not in index:
                index[r] = []
                heapq.heappush(active, r)
            index[r].append(p)
        right = at[has]
        for r, p in _grouped(v.rank_of(symbol[right], symbol[nxt[right]]), right):
            if r not in index:
                index[r] = []
                heapq.heappush(active, r)
            index[r].append(p)
    live = symbol != NONE
    counts = np.diff(np.r_[0, np.cumsum(live)[ends - 1]] if filled.all() else np.r_[0, np.r_[0, np.cumsum(live)][ends]])
    packed, out, at = symbol[live].astype("<u4").tobytes(), [], 0
    for c in counts.tolist():
        out.append(packed[at : at + 4 * c])
        at += 4 * c
    return out


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    """A worker's copy of a vocabulary; ``path`` may also name a file sent with ``addFile``."""
    try:
        return Vocabulary(path)
    except FileNotFoundError:
        return Vocabulary(SparkFiles.get(path.rsplit("/", 1)[-1]))


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, one row at least."""
    texts = batch.column(column)
    start, held = 0, 0
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def plus(batch: pa.RecordBatch, more: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns replaced or added."""
    kept = [i for i, n in enumerate(batch.schema.names) if n not in more]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *more.values()], names=[*(batch.schema.names[i] for i in kept), *more])


def _widened(df: DataFrame, **fields: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema if f.name not in fields), *(T.StructField(n, t) for n, t in fields.items())])


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", count_col: str = "n_tokens", decoded_col: str | None = None) -> DataFrame:
    """Adds the ids of each whole text, packed as little-endian unsigned 32-bit integers, and their number.

    The same ids as the tokenizers library gives without added special tokens; special
    strings inside a text become their tokens. Null texts count as empty and have no ids.
    ``decoded_col``: also decodes the ids, in the same worker. Columns named as a result are
    replaced; all others pass through.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for whole in batches:
            for batch in slices(whole, text_col, SLICE):
                ids = v.encode([t or "" for t in batch.column(text_col).to_pylist()])
                more = {ids_col: pa.array(ids, pa.binary()), count_col: pa.array([len(x) // 4 for x in ids], pa.int64())}
                if decoded_col:
                    more[decoded_col] = pa.array(map(v.decode, ids), pa.string())
                yield plus(batch, more)

    added = {ids_col: T.BinaryType(), count_col: T.LongType()} | ({decoded_col: T.StringType()} if decoded_col else {})
    return df.mapInArrow(make, _widened(df, **added))


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds the text of packed ids, special tokens included; null ids count as none.

    Without a decoder in the vocabulary file tokens are joined by spaces, with one of
    byte-level kind their bytes are joined and read as UTF-8.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for whole in batches:
            for batch in slices(whole, ids_col):
                texts = [v.decode(x or b"") for x in batch.column(ids_col).to_pylist()]
                yield plus(batch, {text_col: pa.array(texts, pa.string())})

    return df.mapInArrow(make, _widened(df, **{text_col: T.StringType()}))
