"""Exact token counts of every prefix by dynamic programming.

A sequence of tokens is what BPE gives for its bytes exactly when every two neighbours are
what BPE gives for theirs. So the last token of a prefix is the only token ending there
that fits the last token of the prefix before it, and the count is one more than there. An
automaton over all tokens names the longest token that ends at each byte, and links lead to
shorter ones. All pre-tokens of a batch are walked side by side, one byte a step.

The table of a text holds the count at each of its characters, as differences of two bytes,
so any prefix is answered from the table alone: its count, whether it fits a budget, and
the longest prefix that does.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.llm import bpe

END = 256  # the symbol after a pre-token's last byte, where the vocabulary marks word ends
CACHE_BITS = 21
CELLS = 1 << 21  # pre-tokens times bytes that are walked side by side
LONG = 2048  # bytes from which a pre-token is walked by itself
NEAR = 16  # characters before a cluster of marks that are cut again with it


@lru_cache(1)
def joining() -> frozenset[str]:
    """Characters without a combining class that may compose with the one before them."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    seconds = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<"}
    return frozenset(seconds | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))})


@lru_cache(1 << 16)
def stands_apart(c: str) -> bool:
    """Whether a character never changes with what stands before it, in composed form."""
    first = unicodedata.normalize("NFD", c)[0]
    return not unicodedata.combining(first) and first not in joining()


class Walk:
    """One pre-token read byte by byte, with what each prefix ends in; the last bytes can be taken back."""

    def __init__(self, c: PrefixCounter):
        self.c = c
        self.state, self.last, self.count = [0], [-1], [0]

    def _token(self, state: int, k: int) -> int:
        """The last token of the prefix of k symbols."""
        c = self.c
        t = c.longest_at[state]
        while (before := self.last[k - c.length_of[t]]) >= 0 and not c.fit(before, t):
            t = c.shorter_of[t]
        return t

    def push(self, raw: bytes) -> None:
        table, state, k = self.c.cells, self.state[-1], len(self.last)
        for b in raw:
            state = table[257 * state + b]
            t = self._token(state, k)
            self.state.append(state)
            self.last.append(t)
            self.count.append(self.count[k - self.c.length_of[t]] + 1)
            k += 1

    def pop(self, n: int) -> None:
        if n:
            del self.state[-n:], self.last[-n:], self.count[-n:]

    def tokens(self) -> int:
        """Tokens of what was read, as a pre-token of its own."""
        k = len(self.last)
        if k == 1 or not self.c.v.suffix:
            return self.count[-1]
        t = self._token(self.c.cells[257 * self.state[-1] + END], k)
        return self.count[k - self.c.length_of[t]] + 1


class PrefixCounter:
    """Counts by prefix for one vocabulary."""

    def __init__(self, v: bpe.Vocabulary):
        self.v = v
        n = v.size
        age = np.full(n, -1, np.int64)  # single bytes first, then tokens by the rank that makes them
        age[v.first], age[v.final] = np.arange(256), np.arange(256) + 256
        age[v.made] = 512 + np.arange(len(v.made))
        self.age = age
        self.a, self.b = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.a[v.made], self.b[v.made] = v.left, v.right
        symbols: list[list[int]] = [[] for _ in range(n)]
        for s in range(256):
            symbols[v.final[s]] = [s, END]
            symbols[v.first[s]] = [s]
        for x, y, z in zip(v.left.tolist(), v.right.tolist(), v.made.tolist(), strict=True):
            symbols[z] = symbols[x] + symbols[y]
        ids = [t for t in range(n) if symbols[t]]
        whole = [bytes(s for s in symbols[t] if s != END) for t in ids]
        marked = [bool(v.suffix) and symbols[t][-1] == END for t in ids]
        # tokens that BPE never gives, even for their own bytes, can end no prefix
        alone = self._alone(ids, whole, marked)
        self._build([(t, symbols[t]) for t, ok in zip(ids, alone, strict=True) if ok])
        self.keys = np.full(1 << CACHE_BITS, -1, np.int64)
        self.fits_cache = np.zeros(1 << CACHE_BITS, bool)
        self.known: dict[str, tuple[bytes, int]] = {}

    def _alone(self, ids: list[int], whole: list[bytes], marked: list[bool]) -> list[bool]:
        """Whether each token is one that its own two parts give."""
        t = np.array(ids)
        a, b = self.a[t], self.b[t]
        single = a < 0
        ok = single.copy()
        ok[~single] = self._fit(a[~single], b[~single], self.age[t[~single]])
        return ok.tolist()

    def _build(self, tokens: list[tuple[int, list[int]]]) -> None:
        """The automaton: next state by symbol, the longest token of each state, the next shorter of each token."""
        step: list[dict[int, int]] = [{}]
        token_at = [-1]
        for t, word in tokens:
            s = 0
            for c in word:
                if c not in step[s]:
                    step[s][c] = len(step)
                    step.append({})
                    token_at.append(-1)
                s = step[s][c]
            token_at[s] = t
        table = np.zeros((len(step), 257), np.int32)
        longest = np.full(len(step), -1, np.int64)
        self.shorter = np.full(self.v.size, -1, np.int64)
        self.length = np.zeros(self.v.size, np.int64)
        for t, word in tokens:
            self.length[t] = len(word)
        fail = [0] * len(step)
        queue = [0]
        for s in queue:
            if s:
                table[s] = table[fail[s]]
            for c, to in step[s].items():
                fail[to] = int(table[fail[s], c]) if s else 0
                queue.append(to)
            for c, to in step[s].items():
                table[s, c] = to
            inherited = longest[fail[s]] if s else -1
            longest[s] = token_at[s] if token_at[s] >= 0 else inherited
            if token_at[s] >= 0:
                self.shorter[token_at[s]] = inherited
        self.table, self.longest = table, longest
        self.cells = memoryview(table.ravel())
        self.longest_at, self.shorter_of, self.length_of = longest.tolist(), self.shorter.tolist(), self.length.tolist()
        self.fit_known: dict[int, bool] = {}

    def fit(self, x: int, y: int) -> bool:
        """``fits`` for one pair."""
        key = x * self.v.size + y
        found = self.fit_known.get(key)
        if found is None:
            if len(self.fit_known) > 1 << CACHE_BITS:
                self.fit_known.clear()
            found = self.fit_known[key] = bool(self._fit(np.array([x]), np.array([y]), np.array([1 << 40]))[0])
        return found

    def _fit(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether no merge older than ``limit`` joins tokens x and y across their border.

        Both are taken apart from the youngest part on, down to single bytes; whatever pair
        stands at the border at some age must not merge before either part is made.
        """
        v, out = self.v, np.zeros(len(x), bool)
        live, x, y, limit = np.arange(len(x)), x.copy(), y.copy(), limit.copy()
        while len(live):
            rank = v.rank_of(x, y)
            clash = (rank >= 0) & (512 + rank < limit)
            keep = ~clash
            live, x, y, limit = live[keep], x[keep], y[keep], limit[keep]
            ax, ay = self.age[x], self.age[y]
            left = ax > ay  # the younger part is undone; on equal age the right one
            limit = np.where(left, ax, ay + 1)
            nx, ny = np.where(left, self.b[x], x), np.where(left, y, self.a[y])
            stuck_left, stuck_right = left & (nx < 0), ~left & (ny < 0)
            # a single byte can't be undone: undo the other side
            limit = np.where(stuck_left, ay + 1, np.where(stuck_right, ax, limit))
            ny = np.where(stuck_left, self.a[y], ny)
            nx = np.where(stuck_left, x, np.where(stuck_right, self.b[x], nx))
            ny = np.where(stuck_right, y, ny)
            done = (nx < 0) | (ny < 0)
            out[live[done]] = True
            keep = ~done
            live, x, y, limit = live[keep], nx[keep], ny[keep], limit[keep]
        return out

    def fits(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether BPE gives x, y for the bytes of x followed by those of y; answers are remembered."""
        key = x.astype(np.int64) * self.v.size + y
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        out = self.fits_cache[slot]
        miss = np.flatnonzero(self.keys[slot] != key)
        if len(miss):
            k, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
            got = self._fit(x[miss][first], y[miss][first], np.full(len(k), 1 << 40))
            out[miss] = got[back]
            self.keys[slot[miss]], self.fits_cache[slot[miss]] = key[miss], out[miss]
        return out

    def _advance(self, state: np.ndarray, k: int, last: np.ndarray, count: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last token and count of the prefix of k symbols of each row; ``state`` has read k symbols."""
        t = self.longest[state]
        todo = np.arange(len(rows))
        while len(todo):
            before = last[rows[todo], k - self.length[t[todo]]]
            ok = before < 0
            inner = np.flatnonzero(~ok)
            ok[inner] = self.fits(before[inner], t[todo[inner]])
            todo = todo[~ok]
            t[todo] = self.shorter[t[todo]]
        return t, count[rows, k - self.length[t]] + 1

    def walk(self, words: list[bytes]) -> np.ndarray:
        """For words of about one length: tokens of each word's first k bytes as a pre-token of their own, k = 0 to the width."""
        m, lengths = len(words), np.fromiter(map(len, words), np.int64, len(words))
        width = int(lengths.max(initial=0))
        raw = np.zeros((m, width + 1), np.uint8)
        raw[np.arange(width + 1) < lengths[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        last, count = np.full((m, width + 2), -1, np.int32), np.zeros((m, width + 2), np.int32)
        state, ended = np.zeros(m, np.int64), np.zeros((m, width + 1), np.int32)
        order = np.argsort(-lengths, kind="stable")
        for k in range(1, width + 1):
            rows = order[: np.searchsorted(-lengths[order], -k, side="right")]
            if self.v.suffix:
                final = self.table[self.table[state[rows], raw[rows, k - 1]], END]
                ended[rows, k] = self._advance(final, k + 1, last, count, rows)[1]
            state[rows] = self.table[state[rows], raw[rows, k - 1]]
            last[rows, k], count[rows, k] = self._advance(state[rows], k, last, count, rows)
        return ended if self.v.suffix else count[:, : width + 1]

    def count_pieces(self, pieces: list[str]) -> tuple[dict[str, tuple[bytes, int]], dict[str, np.ndarray]]:
        """For each distinct pre-token its differences of counts by character with the whole count, and the counts of its first 0, 1, ... characters."""
        raw, steps, out = [w.encode() for w in pieces], {}, {}
        order = sorted((i for i in range(len(raw)) if len(raw[i]) < LONG), key=lambda i: len(raw[i]))
        for piece, word in ((p, w) for p, w in zip(pieces, raw, strict=True) if len(w) >= LONG):
            walk, own = Walk(self), [0]
            for char in piece:
                walk.push(char.encode())
                own.append(walk.tokens())
            out[piece] = np.array(own, np.int32)
            steps[piece] = (np.diff(out[piece]).astype("<i2").tobytes(), own[-1])
        at = 0
        while at < len(order):  # together as many as a bounded table holds
            end = at + 1
            while end < len(order) and (end - at + 1) * (len(raw[order[end]]) + 2) <= CELLS:
                end += 1
            counts = self.walk([raw[i] for i in order[at:end]])
            packed, wide = np.diff(counts, axis=1).astype("<i2").tobytes(), 2 * (counts.shape[1] - 1)
            for r, i in enumerate(order[at:end]):
                piece, n = pieces[i], len(raw[i])
                out[piece] = own = counts[r, : n + 1] if n == len(piece) else counts[r][np.cumsum([0, *(len(c.encode()) for c in piece)])]
                steps[piece] = (packed[r * wide : r * wide + 2 * n] if n == len(piece) else (own[1:] - own[:-1]).astype("<i2").tobytes(), int(own[-1]))
            at = end
        return steps, out

    def _joined(self, pieces: list[str], known: dict[str, np.ndarray]) -> np.ndarray:
        """Counts of the first 0, 1, ... characters of pre-tokens in a row.

        A prefix that ends within a pre-token has that part as its own last one, but for
        contractions, whose parts are an apostrophe and letters, and for white space before
        a word, which goes with its last blank until the word begins.
        """
        out, base = [np.zeros(1, np.int32)], 0
        for j, piece in enumerate(pieces):
            own = known[piece]
            if piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():
                inner = known[piece[1:-1]] if len(piece) > 2 else np.zeros(1, np.int32)
                own = np.r_[0, known["'"][1] + inner, own[-1]].astype(np.int32)
            here = own[1:] + base
            if j and not self.v.squeeze and piece[0].isspace() and pieces[j - 1].isspace() and not (len(piece) > 1 and piece.isspace()):
                here = here.copy()  # so far one run of white space
                here[0] = base - known[pieces[j - 1]][-1] + known[pieces[j - 1] + piece[0]][-1]
            out.append(here)
            base += int(own[-1])
        return np.concatenate(out)

    def _needed(self, pieces: list[str]) -> set[str]:
        """The pre-tokens whose counts ``_joined`` looks up."""
        out = set(pieces)
        if self.v.squeeze and not any(p[0] == "'" for p in pieces):
            return out
        for a, b in zip(["", *pieces], pieces):
            if b[0] == "'" and len(b) > 1 and b[1].isalpha():
                out |= {"'", b[1:-1]} - {""}
            if not self.v.squeeze and a.isspace() and b[0].isspace():
                out.add(a + b[0])
        return out

    def learn(self, new: set[str]) -> None:
        """The differences of counts at each character of chunks that are not known yet.

        Composed text has composed prefixes, so the pre-tokens of the whole chunk serve.
        Otherwise prefixes that end within a cluster of marks are counted again from the
        pre-token before it.
        """
        plain, marked = {}, []
        for c in new:
            if self.v.compose and not unicodedata.is_normalized("NFC", c):
                marked.append(c)
            else:
                plain[c] = self.v.cut(c)
        for group in bpe.groups(list(plain), bpe.TOGETHER):
            steps, known = self.count_pieces(list({w for c in group for w in self._needed(plain[c])}))
            for c in group:
                if self.v.squeeze and "'" not in c and (c.isascii() or len(self.v.small(c)) == len(c)):  # pre-tokens one after another, as they stand
                    own = [steps[w] for w in plain[c]]
                    self.known[c] = own[0] if len(own) == 1 else (b"".join([x for x, _ in own]), sum(n for _, n in own))
                    continue
                counts = self._joined(plain[c], known)
                if not c.isascii():  # small letters may be more characters than the capital
                    at = np.cumsum([0, *(len(self.v.small(x)) for x in c)])
                    counts = counts[at] if at[-1] < len(counts) else np.r_[counts, np.full(at[-1] + 1 - len(counts), counts[-1])][at]
                self._keep(c, counts)
        for c in marked:
            self._keep(c, self._marked(c))

    def _keep(self, chunk: str, counts: np.ndarray) -> None:
        steps = np.diff(counts, prepend=0)[1:] if len(counts) > 1 else np.zeros(0, np.int64)
        self.known[chunk] = (steps.astype("<i2").tobytes(), int(counts[-1]))

    def _marked(self, chunk: str) -> np.ndarray:
        """Counts at each character of a chunk that is not composed.

        The chunk is cut into clusters, each from a character that stands apart on. What
        comes before a prefix's last cluster is composed as in the whole chunk and counted
        with it. The last cluster is composed for itself; unless that begins like the whole
        cluster, the pre-token before it is cut again with it, or, if that is long, goes on
        from its walk. So the cost is linear in the chunk, and in a cluster's marks squared.
        """
        v = self.v
        late = v.rare is not None and v.rare.search(chunk) is not None
        split = (v.strict if late else v.split).findall  # parts are folded already, and must not be composed again
        small = lambda t: v.normal(t.translate(bpe.ADDED_SMALL) if late and v.fold else t)
        begins = [0, *(i for i in range(1, len(chunk)) if stands_apart(chunk[i])), len(chunk)]
        pieces = v.cut(chunk)
        _, known = self.count_pieces(list(self._needed(pieces)))
        counts = self._joined(pieces, known)
        ends = np.cumsum([0, *map(len, pieces)])
        before = np.cumsum([0, *(int(known[p][-1]) for p in pieces)]).tolist()
        composed = small(chunk)
        out, again = [0] * (len(chunk) + 1), []  # again: place, count so far, pre-tokens to add
        walk, walked, walk_of = None, 0, -1
        at = 0  # characters of the composed chunk before the cluster
        for lo, hi in zip(begins, begins[1:]):
            whole = small(chunk[lo:hi])
            for k in range(lo + 1, hi + 1):
                part = whole if k == hi else small(chunk[lo:k])
                if whole.startswith(part):
                    out[k] = int(counts[at + len(part)])
                    continue
                j = int(np.searchsorted(ends, at, side="left")) - 1 if at else 0  # the pre-token of the character before
                start = int(ends[j])
                if at - start <= 2 * NEAR:
                    again.append((k, before[j], split(composed[start:at] + part)))
                    continue
                if walk_of != j:
                    walk, walked, walk_of = Walk(self), start, j
                walk.push(composed[walked:at].encode())
                walked = at
                first, *rest = split(composed[at - NEAR : at] + part)
                more = first[NEAR:].encode()
                walk.push(more)
                again.append((k, before[j] + walk.tokens(), rest))
                walk.pop(len(more))
            at += len(whole)
        for group in bpe.groups(again, bpe.TOGETHER):
            _, known = self.count_pieces(list({w for _, _, ws in group for w in ws}))
            for k, n, ws in group:
                out[k] = n + sum(int(known[w][-1]) for w in ws)
        return np.array(out)

    def table_of(self, text: str) -> tuple[bytes, int]:
        """The differences of counts at each character of a text whose chunks are known, and its whole count."""
        out, total, get = [], 0, self.known.__getitem__
        segments = self.v.segments(text)
        if self.v.squeeze and len(segments) == 1:
            chunks = self.v.chunks(text)
            if len(text) == sum(map(len, chunks)) + len(chunks) - 1:  # one character of white space after each but the last
                found = [get(c) for c in chunks]
                return b"\0\0".join([x for x, _ in found]), sum([n for _, n in found])
        for part, special in segments:
            for gap, chunk in self.pairs(part):
                if gap:
                    out.append(bytes(2 * gap))
                if chunk:
                    steps, n = get(chunk)
                    out.append(steps)
                    total += n
            if special is not None:
                # until its last character the special string is ordinary text after what stands before it
                name, tail = self.v.tokens[special], self.tail(part)
                steps, n = get(tail + name[:-1]) if tail + name[:-1] else (b"", 0)
                before = get(tail)[1] if tail else 0
                if tail:
                    out.pop()
                out += [steps, (before + 1 - n).to_bytes(2, "little", signed=True)]
                total += 1
        return b"".join(out), total

    def pairs(self, part: str) -> Iterator[tuple[int, str]]:
        """Characters of white space, and the chunk after them."""
        if not self.v.squeeze:
            yield from ((0, c) for c in self.v.chunks(part) if c)
            return
        at = 0
        for m in bpe.WHITE.finditer(part):
            yield 0, part[at : m.start()]
            yield m.end() - m.start(), ""
            at = m.end()
        yield 0, part[at:]

    def tail(self, part: str) -> str:
        """The chunk at the end of a part, empty after white space that chunks never hold."""
        last = ""
        for gap, chunk in self.pairs(part):
            last = "" if gap else chunk or last if not self.v.squeeze else "" if gap else chunk
        return last

    def prefix_table(self, texts: list[str]) -> list[tuple[bytes, int]]:
        """For each text its table and whole count."""
        new = self.v.meet(texts, self.known)
        for text in texts:
            for part, special in self.v.segments(text):
                if special is not None:
                    new |= {self.tail(part) + self.v.tokens[special][:-1]} - self.known.keys() - {""}
        self.learn({c for c in new if c})
        return [self.table_of(t) for t in texts]


@lru_cache(2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(bpe.vocabulary(path))


def with_prefix_table(df: DataFrame, path: str, text_col: str = "text", table_col: str = "prefix_tokens", count_col: str = "n_tokens") -> DataFrame:
    """Adds the table of token counts at every prefix, and the count of the whole text.

    The table holds, for each character, how the count of the prefix up to it differs from
    that of the one before, as little-endian signed 16-bit integers. Special strings in a text count as
    their tokens from their last character on. Null and empty texts have an empty table and
    no tokens; very long texts have long tables. Columns named as a result are replaced, all
    others pass through, whatever their ids; an empty table stays empty.
    """
    fields = {table_col: T.BinaryType(), count_col: T.LongType()}
    schema = T.StructType([*(f for f in df.schema if f.name not in fields), *(T.StructField(n, t) for n, t in fields.items())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for whole in batches:
            for batch in bpe.slices(whole, text_col, 4 << 20):
                tables = c.prefix_table([t or "" for t in batch.column(text_col).to_pylist()])
                yield bpe.plus(batch, {table_col: pa.array([t for t, _ in tables], pa.binary()), count_col: pa.array([n for _, n in tables], pa.int64())})

    return df.mapInArrow(make, schema)


def _from_table(df: DataFrame, table_col: str, out_col: str, answer) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (np.cumsum(np.frombuffer(t or b"", "<i2"), dtype=np.int64) for t in batch.column(table_col).to_pylist())
            yield bpe.plus(batch, {out_col: pa.array([answer(c) for c in counts], pa.int64())})

    return df.mapInArrow(make, T.StructType([*(f for f in df.schema if f.name != out_col), T.StructField(out_col, T.LongType())]))


def tokens_at(df: DataFrame, characters: int, table_col: str = "prefix_tokens", out_col: str = "tokens_at") -> DataFrame:
    """Adds the tokens of the first ``characters`` of each text (of the whole, if it is shorter), from its table alone."""
    return _from_table(df, table_col, out_col, lambda c: int(c[min(characters, len(c)) - 1]) if len(c) and characters > 0 else 0)


def characters_within(df: DataFrame, budget: int, table_col: str = "prefix_tokens", out_col: str = "characters") -> DataFrame:
    """Adds the length of each text's longest prefix of at most ``budget`` tokens, from its table alone."""
    return _from_table(df, table_col, out_col, lambda c: int(np.flatnonzero(c <= budget)[-1]) + 1 if (c <= budget).any() else 0)


def truncate(df: DataFrame, budget: int, text_col: str = "text", table_col: str = "prefix_tokens") -> DataFrame:
    """Each text's longest prefix of at most ``budget`` tokens in its place; null stays null. The table goes with the rest of the text."""
    cut = characters_within(df, budget, table_col, "__c")
    return cut.withColumns({text_col: F.left(text_col, F.col("__c").cast("int")), table_col: F.expr(f"left(`{table_col}`, 2 * cast(__c as int))")}).select(*df.columns)
