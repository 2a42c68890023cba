"""SentencePiece encoding and decoding: a batched numpy Viterbi over a model's pieces."""

from __future__ import annotations

import functools
import itertools
import operator
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
NEVER = np.int64(1 << 60)
#: Characters beyond which words are cut at joints, and words of one length from which they advance together.
CUT_FROM, FEW = 48, 12


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def spread(points: np.ndarray) -> np.ndarray:
    """Code points as 64-bit values that a polynomial can take."""
    x = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class PieceModel:
    """A SentencePiece model of type BPE or unigram, with the identity normaliser.

    Both types are decoded by one forward pass: the best last piece of every prefix. A unigram model maximises summed
    scores. In a BPE model a prefix's last piece is the one whose pair with the piece before it outlives the merges
    (pairs_hold), and there is exactly one; the maximum is then taken over the pieces that hold. The result is what
    merging by score, leftmost first, gives."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or train.model_type not in (1, 2):
            raise ValueError("only BPE and unigram models with the identity normaliser are supported")
        self.bpe, self.prefix, self.unk = train.model_type == 2, norm.add_dummy_prefix, train.unk_id
        self.text = [p.piece for p in proto.pieces]
        self.kind = np.array([p.type for p in proto.pieces])
        self.score = np.array([p.score for p in proto.pieces], dtype=np.float64)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.text) if self.kind[i] == 6}
        own = np.flatnonzero(self.kind == 1)
        self.ids = {self.text[i]: int(i) for i in own}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("pieces that go on behind a word are not supported")
        self.runs = sorted(len(p) for p in self.ids if set(p) == {SPACE} and len(p) > 1)
        worst = min((self.score[i] for p, i in self.ids.items() if SPACE * 2 not in p and len(p) > 1), default=0)
        if any(SPACE * 2 in p and (set(p) != {SPACE} or self.score[i] > worst) for p, i in self.ids.items()):
            raise ValueError("pieces that join several spaces and a word are not supported")
        #: Merge order: 0 for the best score; single characters come before all merges.
        self.rank = np.full(len(self.text), -1, np.int64)
        longer = np.array([i for i in own if len(self.text[i]) > 1], dtype=np.int64)
        self.rank[longer[np.lexsort((longer, -self.score[longer]))]] = np.arange(len(longer))
        self.size = np.array([len(p) for p in self.text], np.int64)
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(64, BASE)]))
        self.hash = np.array([self.hash_of(p) for p in self.text], np.uint64)
        order = own[np.argsort(self.hash[own], kind="stable")]
        self.all_keys, self.all_ids = self.hash[order], order
        usable = own
        self.left = np.full(len(self.text), -1, np.int64)
        self.right = self.left.copy()
        if self.bpe:
            usable = np.array([i for i in own if self.set_split(i)], dtype=np.int64)
        self.longest = int(self.size[usable].max())
        self.keys, self.key_ids, self.maybe = [], [], []
        for n in range(self.longest + 1):
            at = usable[self.size[usable] == n]
            at = at[np.argsort(self.hash[at], kind="stable")]
            self.keys.append(self.hash[at])
            self.key_ids.append(at)
            self.maybe.append(np.zeros(1 << 18, bool))  # by a hash's first 18 bits: most substrings need no search
            self.maybe[n][self.hash[at] >> np.uint64(46)] = True
        self.usable = {self.text[i]: int(i) for i in usable}
        self.joints = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.scalar_memo: dict[tuple[int, int], bool] = {}
        self.unknown_score = float(self.score[own].min()) - 10
        self.memo_key = np.full(1 << 20, -1, np.int64)
        self.memo_ok = np.zeros(1 << 20, bool)
        self.cache: dict[str, list[int]] = {}
        surfaces = [self.surface(i) for i in range(len(self.text))]
        self.surface_size = np.array([len(x) for x in surfaces], np.int64)
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size
        self.surfaces = np.frombuffer(b"".join(surfaces), np.uint8)

    def hash_of(self, piece: str) -> np.uint64:
        x = spread(code_points(piece))
        return (x * self.powers[: len(x)][::-1]).sum(dtype=np.uint64) if len(x) < 64 else np.uint64(0)

    def merged(self, piece: str) -> tuple[list[str], tuple[str, str] | None]:
        """Merges by rank, leftmost first, as plain code; for pieces only. Also the last merge."""
        parts, last = list(piece), None
        while True:
            found = min(((self.rank[i], k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if found is None:
                return parts, last
            k = found[1]
            last = (parts[k], parts[k + 1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def set_split(self, i: int) -> bool:
        """Whether merging gives piece i from its characters; its last merge is kept."""
        if self.size[i] == 1:
            return True
        if set(self.text[i]) == {SPACE}:
            return False  # runs of spaces are handled by space_run
        parts, last = self.merged(self.text[i])
        if len(parts) > 1 or any(x not in self.ids for x in last):
            return False
        a, b = self.ids[last[0]], self.ids[last[1]]
        if max(self.rank[a], self.rank[b]) >= self.rank[i]:
            raise ValueError(f"piece {i} is made of pieces that come after it")
        self.left[i], self.right[i] = a, b
        return True

    def pairs_hold(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b stay apart when a + b is merged from its characters.

        Undoes the merges inside a and b from the last to the first. While x at a's right edge and y at b's left edge
        stand side by side, their own merge comes first if it ranks before x's next merge and not after y's."""
        x, y, ok = a.copy(), b.copy(), np.ones(len(a), bool)
        next_x, next_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        live = np.arange(len(a))
        while len(live):
            u, v = x[live], y[live]
            h = self.hash[u] * self.powers[np.minimum(self.size[v], 63)] + self.hash[v]
            k = np.minimum(np.searchsorted(self.all_keys, h), len(self.all_keys) - 1)
            m = np.where(self.all_keys[k] == h, self.rank[self.all_ids[k]], NEVER)
            bad = (m < next_x[live]) & (m <= next_y[live]) & (m < NEVER)
            ok[live[bad]] = False
            ru, rv = self.rank[u], self.rank[v]
            go = ~bad & ((ru >= 0) | (rv >= 0))
            undo_x = go & (ru > rv)
            undo_y = go & ~undo_x
            i, j = live[undo_x], live[undo_y]
            next_x[i], x[i] = ru[undo_x], self.right[u[undo_x]]
            next_y[j], y[j] = rv[undo_y], self.left[v[undo_y]]
            live = live[go]
        return ok

    def hold(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """pairs_hold with a table of answers. A negative piece is a text's start or an unknown character: nothing merges with it."""
        out = (a < 0) | (b < 0)
        at = np.flatnonzero(~out)
        key = a[at] * len(self.text) + b[at]
        slot = ((key.astype(np.uint64) * BASE) >> np.uint64(44)).astype(np.int64)
        known = self.memo_key[slot] == key
        out[at[known]] = self.memo_ok[slot[known]]
        rest = at[~known]
        if len(rest):
            fresh, back = np.unique(key[~known], return_inverse=True)
            got = self.pairs_hold(fresh // len(self.text), fresh % len(self.text))
            place = ((fresh.astype(np.uint64) * BASE) >> np.uint64(44)).astype(np.int64)
            self.memo_key[place] = fresh
            kept = self.memo_key[place] == fresh  # of keys that want one slot, one has it
            self.memo_ok[place[kept]] = got[kept]
            out[rest] = got[back]
        return out

    def viterbi(self, words: list[str]) -> list[list[int]]:
        """Piece ids of words of one length, all of which advance together. Unknown characters are -2 - code point."""
        n, size = len(words), len(words[0])
        points = code_points("".join(words)).reshape(n, size).astype(np.int64)
        value = spread(points)
        prefix = np.zeros((size + 1, n), np.uint64)
        for i in range(size):
            prefix[i + 1] = prefix[i] * BASE + value[:, i]
        best = np.zeros((size + 1, n))
        last = np.full((size + 1, n), -1, np.int64)
        step = np.zeros((size + 1, n), np.int64)
        for end in range(1, size + 1):
            top = np.full(n, -np.inf)
            for width in range(1, min(end, self.longest) + 1):
                if not len(self.keys[width]) and width > 1:
                    continue
                begin = end - width
                h = prefix[end] - prefix[begin] * self.powers[width]
                at = np.flatnonzero(self.maybe[width][h >> np.uint64(46)])
                k = np.searchsorted(self.keys[width], h[at])
                found = self.keys[width][np.minimum(k, len(self.keys[width]) - 1)] == h[at] if len(at) else k > 0
                at, own = at[found], self.key_ids[width][k[found]]
                if width == 1:
                    piece = -2 - points[:, end - 1]
                    piece[at] = own
                    at, own = np.arange(n), piece
                if not len(at):
                    continue
                if self.bpe:
                    gain = np.where(self.hold(last[begin, at], own), 0.0, -np.inf)
                else:
                    gain = best[begin, at] + np.where(own < 0, self.unknown_score, self.score[np.maximum(own, 0)])
                better = gain > top[at]
                at, own = at[better], own[better]
                top[at], last[end, at], step[end, at] = gain[better], own, width
            best[end] = top
        picked, count = np.zeros((size, n), np.int64), 0
        rows, end, found = np.arange(n), np.full(n, size), np.zeros(n, np.int64)
        while len(rows):
            count += 1
            picked[size - count, rows] = last[end[rows], rows]
            found[rows] = count
            end[rows] -= step[end[rows], rows]
            rows = rows[end[rows] > 0]
        table = picked[size - count :].T.tolist()
        return [r[count - k :] for r, k in zip(table, found.tolist(), strict=True)]

    def cut(self, word: str) -> list[str]:
        """The word cut wherever no piece holds the two characters that meet: no piece goes across, and no merge does."""
        at = [k for k, pair in enumerate(map(operator.add, word, word[1:]), 1) if pair not in self.joints]
        return [word[a:b] for a, b in zip([0, *at], [*at, len(word)], strict=True)]

    def alone(self, word: str) -> list[int]:
        """viterbi for one word, in steps of one character and one piece: for lengths of which there are few words."""
        n = len(word)
        best, last, step = [0.0] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            top = -np.inf
            for width in range(1, min(end, self.longest) + 1):
                own = self.usable.get(word[end - width : end])
                if own is None:
                    if width > 1:
                        continue
                    own = -2 - ord(word[end - 1])
                before = last[end - width]
                if self.bpe:
                    if before >= 0 and own >= 0:
                        ok = self.scalar_memo.get((before, own))
                        if ok is None:
                            ok = self.scalar_memo[before, own] = bool(self.pairs_hold(np.array([before]), np.array([own]))[0])
                        if not ok:
                            continue
                    gain = 0.0
                else:
                    gain = best[end - width] + (self.unknown_score if own < 0 else float(self.score[own]))
                if gain > top:
                    top, last[end], step[end] = gain, own, width
            best[end] = top
        out, end = [], n
        while end:
            out.append(last[end])
            end -= step[end]
        return out[::-1]

    def final(self, raw: list[int]) -> list[int]:
        """Unknown characters as bytes, if the model has them."""
        if min(raw) >= 0:
            return raw
        out = []
        for p in raw:
            if p >= 0:
                out.append(p)
            elif self.bytes:
                out.extend(self.bytes[b] for b in chr(-2 - p).encode())
            else:
                out.append(self.unk)
        return out

    def space_run(self, n: int) -> list[int]:
        """A run of n spaces: their merges all rank alike, so the leftmost pair that is a piece joins first."""
        parts = []
        runs = set(self.runs)
        for _ in range(n):
            parts.append(1)
            while len(parts) > 1 and parts[-2] + parts[-1] in runs:
                parts[-2:] = [parts[-2] + parts[-1]]
        return [self.ids[SPACE * k] for k in parts]

    def learn(self, chunks: Iterable[str]) -> None:
        """Put the ids of chunks (spaces and a word each) into the cache."""
        lengths: dict[int, list[str]] = defaultdict(list)
        tails: dict[str, str] = {}
        parts: dict[str, list[str]] = {}

        def want(word: str) -> None:
            if len(word) <= CUT_FROM:
                lengths[len(word)].append(word)
                return
            parts[word] = self.cut(word)
            for part in parts[word]:
                if part not in self.cache:
                    lengths[len(part)].append(part)

        for c in chunks:
            if c[:2] == SPACE * 2 and self.bpe and self.runs:
                word = c.lstrip(SPACE)
                tails[c] = SPACE + word if word else ""
                if word and tails[c] not in self.cache:
                    want(tails[c])
            else:
                want(c)
        for words in lengths.values():
            words = list(dict.fromkeys(words))
            if len(words) < FEW:
                self.cache |= {w: self.final(self.alone(w)) for w in words}
                continue
            for i in range(0, len(words), 50_000):
                for w, raw in zip(words[i : i + 50_000], self.viterbi(words[i : i + 50_000]), strict=True):
                    self.cache[w] = self.final(raw)
        for word, own in parts.items():
            self.cache[word] = list(itertools.chain.from_iterable(self.cache[p] for p in own))
        for c, core in tails.items():
            k = len(c) - len(c.lstrip(SPACE))
            own = self.cache[core] if core else []
            alone = not own or own[0] == self.ids[SPACE]
            self.cache[c] = self.space_run(k) + own[1:] if alone else self.space_run(k - 1) + own

    def encode(self, texts: list[str], most_cached: int = 500_000) -> list[list[int]]:
        """The ids of each text."""
        out = []
        for flat, edge in self.encode_slices([[t.encode() for t in texts]], most_cached):
            out.extend(flat[a:b].tolist() for a, b in zip(edge[:-1], edge[1:], strict=True))
        return out

    def encode_slices(self, slices: list[list[bytes]], most_cached: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of each slice's texts, one behind the other, and where each text's begin.

        A chunk is a run of spaces and the word behind it; only one of equal chunks is decoded to a string and looked up,
        and the words that are new to all slices go through one pass of viterbi."""
        if len(self.cache) > most_cached:
            self.cache.clear()
            self.scalar_memo.clear()
        number: dict[int, int] = {}
        chunks: list[str] = []
        placed = []
        for texts in slices:
            data, begins = self.padded(texts)
            space = data == 32
            start = space.copy()
            start[1:] &= ~space[:-1]
            heads = begins[:-1][np.diff(begins) > 0]
            start[heads] = True
            at = np.flatnonzero(start)
            sizes = np.diff(np.append(at, len(data)))
            if not len(at):
                placed.append((np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)))
                continue
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(sizes.max()), BASE)]))
            place = np.arange(len(data)) - np.repeat(at, sizes)
            keys = np.add.reduceat(BYTE[data] * powers[place], at) ^ sizes.astype(np.uint64)
            fresh, first, back = np.unique(keys, return_index=True, return_inverse=True)
            known = np.empty(len(fresh), np.int64)
            raw = data.tobytes()
            for i, (k, f) in enumerate(zip(fresh.tolist(), first.tolist(), strict=True)):
                j = number.get(k)
                if j is None:
                    j = number[k] = len(chunks)
                    text = raw[at[f] : at[f] + sizes[f]].decode().replace(" ", SPACE)
                    chunks.append(text if self.prefix or at[f] not in heads else text[1:])
                known[i] = j
            placed.append((known[back], np.searchsorted(at, begins)))
        self.learn(c for c in dict.fromkeys(chunks) if c not in self.cache)
        rows = [self.cache[c] for c in chunks]
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        flat = np.fromiter(itertools.chain.from_iterable(rows), np.int32, int(sizes.sum()))
        begin = np.cumsum(sizes) - sizes
        for own, edge in placed:
            n = sizes[own]
            total = np.concatenate([[0], np.cumsum(n)])
            yield flat[np.repeat(begin[own] - total[:-1], n) + np.arange(total[-1])], total[edge]

    @staticmethod
    def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The texts with a space ahead of each that isn't empty, and where they begin. U+2581 is a space, too."""
        mark = SPACE.encode()
        parts = [b" " + (t.replace(mark, b" ") if mark in t else t) if t else b"" for t in texts]
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])

    def surface(self, i: int) -> bytes:
        if self.kind[i] == 6:
            return bytes([int(self.text[i][3:5], 16)])
        if self.kind[i] == 3:
            return b""
        if self.kind[i] == 2:
            return " ⁇ ".encode()
        return self.text[i].replace(SPACE, " ").encode()

    def decode_flat(self, ids: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of rows of ids, one behind the other, and where each row's begin."""
        n = self.surface_size[ids]
        total = np.concatenate([[0], np.cumsum(n)])
        return self.surfaces[np.repeat(self.surface_at[ids] - total[:-1], n) + np.arange(total[-1])], total[edge]

    def decode(self, rows: list[list[int]]) -> list[str]:
        ids = np.fromiter(itertools.chain.from_iterable(rows), np.int64)
        data, at = self.decode_flat(ids, np.cumsum([0, *map(len, rows)]))
        raw, out = data.tobytes(), []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            text = raw[a:b].decode("utf-8", "replace")
            out.append(text[1:] if self.prefix and text.startswith(" ") else text)
        return out


@functools.lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def runs_of(total: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of most bytes or one row, from their running sum of bytes."""
    a = 0
    while a < len(total):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", pass_bytes: int = 32 << 20, slice_bytes: int = 3 << 20, check: bool = False) -> DataFrame:
    """(id, ids array<int>, n_tokens long, exact boolean) of each row's whole text, with no shuffle.

    A worker encodes pass_bytes of text in a pass, slice_bytes at a time, and keeps the ids of up to some hundred thousand words it has met.
    exact (null unless check): whether decoding the ids gives the text; a text that holds U+2581 gives a space there, as
    in the model's own library. Words are told apart by 64-bit hashes within a pass; a clash, were there one, would show in exact.
    Null and empty texts have no ids, very long ones are encoded whole. Repeated rows give repeated rows, an empty table none;
    other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
            for begin, end in runs_of(sizes, pass_bytes):
                texts = [t or b"" for t in batch.column(1).slice(begin, end - begin).cast(pa.binary()).to_pylist()]
                cuts = list(runs_of(sizes[begin:end] - (sizes[begin - 1] if begin else 0), slice_bytes))
                for (a, b), (ids, edge) in zip(cuts, own.encode_slices([texts[a:b] for a, b in cuts]), strict=True):
                    exact = [None] * (b - a)
                    if check:
                        data, at = own.decode_flat(ids, edge)
                        raw, skip = data.tobytes(), int(own.prefix)
                        exact = [raw[i + skip : j] == t for i, j, t in zip(at[:-1].tolist(), at[1:].tolist(), texts[a:b], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(begin + a, b - a), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids)), pa.array(np.diff(edge)), pa.array(exact, pa.bool_())],
                        names=[id_col, "ids", "n_tokens", "exact"],
                    )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>, n_tokens long, exact boolean")


def decode_ids(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows of ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            rows = batch.column(1).to_pylist()
            texts = own.decode([r or [] for r in rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if r is None else t for r, t in zip(rows, texts, strict=True)], pa.string())], names=[id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"{id_col} {kind}, text string")
