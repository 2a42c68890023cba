"""LM scoring: a causal self-attention model on subword ids, trained and run in numpy, beside a word-unigram base."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import bpe, hashing
from .common import Scratch, remove, scratch, written
from .neardup import slices

#: Positions of a window, of which the last FRESH are scored and the first are context only.
WINDOW, FRESH = 32, 24
LEAD = WINDOW - FRESH
WIDTH = 16
#: Distributions that are mixed, and levels of how often the word so far was seen (powers of two).
PARTS, LEVELS = 4, 14
EVEN = ~np.uint64(1)
#: Words of a span of a text that is drawn for training.
SPAN = 5 * FRESH
#: A hash for each id.
IDS = hashing.mixed((np.arange(1, 1 << 20)).astype(np.uint64) * hashing.PLACE[40])


class AttentionModel:
    """p(next subword | window), a mixture of four distributions over all subwords: what the training texts have after the
    word's subwords so far (read), how often they have the subword (alone), what follows the subword before by classes
    (pairs), and copies from the window. One layer of causal self-attention over embeddings and positions gives the
    copies their weights and, with how often the word so far was seen, the shares of the four."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def untrained(cls, n_in: int, seed: int) -> AttentionModel:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(WIDTH)).astype(np.float32)
        weights = {"embed": draw(n_in, WIDTH), "place": draw(WINDOW, WIDTH), "query": draw(WIDTH, WIDTH), "key": draw(WIDTH, WIDTH), "value": draw(WIDTH, WIDTH), "own": draw(WIDTH, WIDTH)}
        weights |= {"gate": draw(WIDTH, PARTS) * np.float32(0.1), "seen": np.tile(np.array([2, 0, 1, -1], np.float32), (2 * LEVELS, 1))}
        return cls(weights)

    def forward(self, x: np.ndarray, near: np.ndarray, y: np.ndarray, parts: np.ndarray, seen: np.ndarray) -> dict[str, np.ndarray]:
        """x: input classes and near: ids, windows by WINDOW; y: the ids that follow the last FRESH positions, which attend to
        themselves and those before. parts: probabilities of y by all but copying (three by windows by FRESH), and seen: levels, windows by FRESH.

        A position's weight on an earlier one is the share of the id that followed there; its weight on itself goes by alone."""
        w, n = self.w, len(x)
        kind = w["own"].dtype
        flat = lambda a: np.ascontiguousarray(a).reshape(-1, WIDTH)
        h = np.take(w["embed"], x, axis=0)
        h += w["place"]
        last = flat(h[:, LEAD:])
        k, v = ((flat(h) @ w[name]).reshape(n, WINDOW, WIDTH) for name in ("key", "value"))
        q = (last @ (w["query"] * kind.type(WIDTH**-0.5))).reshape(n, FRESH, WIDTH)
        s = q @ k.transpose(0, 2, 1)
        if max(-s.min(), s.max()) > 30:
            np.clip(s, -30, 30, out=s)
        np.exp(s, out=s)
        s *= MASK
        total = s @ np.ones(WINDOW, kind)
        match = np.zeros(s.shape, kind)
        match[:, :, :-1] = near[:, None, 1:] == y[:, :, None]
        match[:, FRESH_AT, WINDOW_AT] = parts[1]
        own = last @ w["own"]
        own += flat((s @ v) / total[..., None])
        np.tanh(own, out=own)
        gate = (own @ w["gate"] + np.take(w["seen"], seen.ravel(), axis=0)).T.reshape(PARTS, n, FRESH)  # one after the other, so sums over the four are fast
        gate = np.exp(gate - gate.max(axis=0))
        gate /= gate.sum(axis=0)
        copied = np.einsum("bij,bij->bi", s, match) / total
        p = (gate[:3] * parts).sum(axis=0) + gate[3] * copied
        return {"h": h, "q": q, "k": k, "v": v, "sums": s, "total": total, "own": own.reshape(n, FRESH, WIDTH), "match": match, "gate": gate, "copied": copied, "p": np.maximum(p, 1e-30)}

    def gradients(self, x: np.ndarray, near: np.ndarray, y: np.ndarray, parts: np.ndarray, seen: np.ndarray, live: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over live positions and its gradients."""
        w, f = self.w, self.forward(x, near, y, parts, seen)
        share = live / max(1, int(live.sum()))
        loss = -float((np.log(f["p"]) * share).sum())
        pull = (-share / f["p"]).astype(f["p"].dtype)
        att = f["sums"] / f["total"][..., None]
        every = np.concatenate([parts, f["copied"][None]])
        g_gate = np.moveaxis(f["gate"] * (every - f["p"]) * pull, 0, 2)
        g = {name: np.zeros_like(a) for name, a in w.items()}
        np.add.at(g["seen"], seen.ravel(), g_gate.reshape(-1, PARTS))
        g["gate"] = f["own"].reshape(-1, WIDTH).T @ g_gate.reshape(-1, PARTS)
        down = (g_gate @ w["gate"].T) * (1 - f["own"] * f["own"])
        last = f["h"][:, LEAD:]
        across = lambda a, b: a.reshape(-1, WIDTH).T @ b.reshape(-1, WIDTH)
        g["own"] = across(last, down)
        g_v = att.transpose(0, 2, 1) @ down
        g_att = down @ f["v"].transpose(0, 2, 1) + (pull * f["gate"][3])[..., None] * f["match"]
        g_s = att * (g_att - (g_att * att).sum(axis=2, keepdims=True)) * np.float32(WIDTH**-0.5)
        g_q, g_k = g_s @ f["k"], g_s.transpose(0, 2, 1) @ (last @ w["query"])
        g["query"], g["key"], g["value"] = across(last, g_q), across(f["h"], g_k), across(f["h"], g_v)
        g_h = g_k @ w["key"].T + g_v @ w["value"].T
        g_h[:, LEAD:] += down @ w["own"].T + g_q @ w["query"].T
        g["place"] = g_h.sum(axis=0)
        np.add.at(g["embed"], x.ravel(), g_h.reshape(-1, WIDTH))
        return loss, g

    def train(self, x: np.ndarray, near: np.ndarray, y: np.ndarray, parts: np.ndarray, seen: np.ndarray, live: np.ndarray, batch: int, rate: float) -> list[float]:
        """Adam, once over the windows in their order."""
        mean, square = ({n: np.zeros_like(a) for n, a in self.w.items()} for _ in range(2))
        losses = []
        for step, at in enumerate(range(0, len(x), batch), 1):
            now = slice(at, at + batch)
            loss, g = self.gradients(x[now], near[now], y[now], parts[:, now], seen[now], live[now])
            losses.append(loss)
            for n, a in self.w.items():
                mean[n] += 0.1 * (g[n] - mean[n])
                square[n] += 0.01 * (g[n] * g[n] - square[n])
                a -= (rate * (mean[n] / (1 - 0.9**step)) / (np.sqrt(square[n] / (1 - 0.99**step)) + 1e-8)).astype(a.dtype)
        return losses


MASK = (np.arange(WINDOW)[None, :] <= np.arange(LEAD, WINDOW)[:, None]).astype(np.float32)
FRESH_AT, WINDOW_AT = np.arange(FRESH), np.arange(LEAD, WINDOW)


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows over texts of so many ids: where each one's first fresh id stands in all texts' ids, how many
    ids its text has before that, and its text. Every id is fresh in one window."""
    n = -(-sizes // FRESH)
    owner = np.repeat(np.arange(len(sizes)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    begin = np.cumsum(sizes) - sizes
    return begin[owner] + nth * FRESH, nth * FRESH, owner


@dataclass
class Known:
    """What is known of the training texts as a whole: all of it is bounded by the vocabulary."""

    inputs: np.ndarray  # each id's input class
    outputs: np.ndarray  # each id's output class in pairs
    alone: np.ndarray  # each id's share
    within: np.ndarray  # each id's share of its output class
    pairs: np.ndarray  # probabilities of output classes after input classes
    begins: np.ndarray  # whether an id begins a word (or is the end)
    n_begun: int  # words and ends
    end_id: int

    @classmethod
    def of(cls, counts: np.ndarray, pairs: np.ndarray, inputs: np.ndarray, outputs: np.ndarray, begins: np.ndarray, end_id: int) -> Known:
        n_out = pairs.shape[1]
        alone = (counts + 0.5) / (counts.sum() + 0.5 * len(counts))
        mass = np.bincount(outputs, weights=alone, minlength=n_out)
        near = (pairs + 20 * mass) / (pairs.sum(axis=1, keepdims=True) + 20)
        return cls(inputs, outputs, alone.astype(np.float32), (alone / mass[outputs]).astype(np.float32), near.astype(np.float32), begins, int(counts[begins].sum()), end_id)


def nodes(flat: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of what each id ends (its word's ids so far; even), and of that word being over there (odd)."""
    first = begins[flat]
    at = np.arange(len(flat))
    start = np.maximum.accumulate(np.where(first, at, 0))
    place = at - start
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(place.max(initial=0)), hashing.BASE)]))
    own = IDS[flat] * powers[place]
    total = np.cumsum(own)
    node = hashing.mixed(total - (total - own)[start] + place.astype(np.uint64) * hashing.PLACE[41])
    return node & EVEN, hashing.mixed(node ^ hashing.PLACE[42]) | ~EVEN


def ranges(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each at on, as many as sizes says."""
    return np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def heads(ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin among their ids, and how many ids they have."""
    at = np.flatnonzero(begins[ids])
    return at, np.diff(np.append(at, len(ids)))


def node_keys(ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted names of a chunk's distinct words' nodes, and where there each id's node is and then each word's end (the
    last word, which is the end, aside)."""
    node, over = nodes(ids, begins)
    begin, length = heads(ids, begins)
    return np.unique(np.concatenate([node, over[(begin + length - 1)[:-1]]]), return_inverse=True)


class Chunk:
    """A chunk's texts as numbers of distinct words (the last word is the end), with the counts of the words' nodes in the training texts."""

    def __init__(self, own: np.ndarray, back: np.ndarray, n_words: np.ndarray, held: np.ndarray, counts: np.ndarray, known: Known):
        """own: the distinct words' ids, one behind the other; counts: of their nodes, as node_keys lists them; back: each word's
        number; n_words: of each text, its end counted."""
        self.held, self.known, self.back, self.n_words = held, known, back, n_words
        begin, length = heads(own, known.begins)
        _, place = node_keys(own, known.begins)
        found = counts[place]
        self.of_word = np.append(found[len(own) :], 0)
        place = ranges(begin[back], length[back])
        self.flat, self.node = own[place].astype(np.int32), found[place]
        ends = np.cumsum(length[back])
        self.over = np.zeros(len(place), np.int64)
        self.over[ends - 1] = self.of_word[back]
        self.sizes = np.diff(np.append(0, ends[np.cumsum(n_words) - 1]))

    def base(self) -> tuple[np.ndarray, np.ndarray]:
        """Each text's sum of log10(c + 0.5) over its words (the end aside), c being their counts, and how many have been counted."""
        owner = np.repeat(np.arange(len(self.n_words)), self.n_words - 1)
        word = np.delete(self.back, np.cumsum(self.n_words) - 1)
        sums = np.bincount(owner, weights=np.log10(self.of_word + 0.5)[word], minlength=len(self.n_words))
        return sums, np.bincount(owner, weights=(self.of_word > 0)[word], minlength=len(self.n_words)).astype(np.int64)

    def examples(self, at: np.ndarray, before: np.ndarray, owner: np.ndarray, leave: int) -> tuple[np.ndarray, ...]:
        """Windows as the model takes them. leave is taken from each count: 1 where the windows themselves were counted."""
        k, flat = self.known, self.flat
        back = np.arange(WINDOW) - LEAD - 1
        near = np.where(before[:, None] + back >= 0, flat[np.clip(at[:, None] + back, 0, len(flat) - 1)], k.end_id)
        fresh = np.arange(FRESH)
        live = before[:, None] + fresh < self.sizes[owner][:, None]
        place = np.minimum(at[:, None] + fresh, len(flat) - 1)
        y = np.where(live, flat[place], k.end_id)
        first, start = k.begins[y], before[:, None] + fresh == 0
        prior = np.maximum(np.where(start, 0, self.node[place - 1]) - leave, 0)
        count = np.maximum(self.node[place] - leave, 0)
        base = max(1, k.n_begun - leave)
        ratio = np.where(first, np.where(start, 1, np.maximum(self.over[place - 1] - leave, 0) / np.maximum(prior, 1)) * (count / base), count / np.maximum(prior, 1))
        alone = k.alone[y]
        read = np.where((prior > 0) | (start & (k.n_begun > leave)), ratio, alone)
        pair = k.pairs[k.inputs[near[:, LEAD:]], k.outputs[y]] * k.within[y]
        level = np.minimum(np.log2(prior + 1).astype(np.int64), LEVELS - 1) + LEVELS * start
        return k.inputs[near], near.astype(np.int32), y.astype(np.int32), np.stack([read, alone, pair]).astype(np.float32), level, live

    def train(self, model: AttentionModel, rate: float) -> int:
        """Train on all windows of the training texts, in an order that mixes texts; the number of windows."""
        at, before, owner = windows(self.sizes)
        mine = np.flatnonzero(~self.held[owner])
        mine = mine[np.argsort(hashing.mixed(mine.astype(np.uint64) + np.uint64(7)), kind="stable")]
        for a in range(0, len(mine), 1 << 14):
            part = mine[a : a + (1 << 14)]
            model.train(*self.examples(at[part], before[part], owner[part], 1), batch=32, rate=rate)
        return len(mine)

    def scores(self, model: AttentionModel, step: int = 128) -> np.ndarray:
        """log10 of each text's probability; step windows at a time stay in the processor's cache."""
        at, before, owner = windows(self.sizes)
        total = np.zeros(len(self.sizes))
        for a in range(0, len(at), step):
            *given, live = self.examples(at[a : a + step], before[a : a + step], owner[a : a + step], 0)
            found = np.log10(model.forward(*given)["p"]) * live
            np.add.at(total, owner[a : a + step], found.sum(axis=1, dtype=np.float64))
        return total


def packed(x: np.ndarray) -> bytes:
    """An array's bytes, compressed: all lowest bytes first, then the next ones."""
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1)


def unpacked(x: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def words_of(texts: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts (A-Z in lower case) as distinct words' ids, one word behind the other and the end behind the last; the number of
    each word of the texts, with the end behind each text; and how many these are. A word's ids depend on the word alone."""
    end_id = max(bpe.ranks(path).values()) + 1
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    ink = ~hashing.is_blank(data)
    starts = np.flatnonzero(ink[1:] & ~ink[:-1]) + 1
    sizes = np.flatnonzero(ink[:-1] & ~ink[1:]) + 1 - starts
    hashes, _ = hashing.word_hashes(data, np.array([0, len(data)]))
    _, first, back, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")  # small numbers for frequent words, which pack well
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    first, back = first[order], number[back]
    at, size = starts[first], sizes[first]
    spelled = data[ranges(at - 1, size + 1)]
    spelled[np.cumsum(size + 1) - size - 1] = 32
    ids = bpe.ids_of(path, spelled.tobytes().decode()).astype(np.int64) if len(at) else np.zeros(0, np.int64)
    n_words = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])) if texts else np.zeros(0, np.int64)
    back = np.insert(back, n_words, len(first))
    return np.append(ids, end_id), back, np.diff(np.append(0, n_words)) + 1


def subwords(batches: Iterator[pa.RecordBatch], path: str, n_parts: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(id, held_out, text) to a row for each chunk of texts with its words, in part -1, and a row for each range of hashes
    with the chunk's distinct nodes there and how often its training texts have them."""
    from pyspark import TaskContext

    begins = begin_words(path)
    edges = np.array([(p << 64) // n_parts for p in range(n_parts)], dtype=np.uint64)
    chunk = TaskContext.get().partitionId() << 33
    lists = {"doc_ids": kind, "held": pa.bool_(), "n_words": pa.int64()}
    schema = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), *[(n, pa.list_(t)) for n, t in lists.items()], *[(n, pa.binary()) for n in ("ids", "words", "keys", "learnt")], ("texts", pa.bool_())])
    for batch in batches:
        for a, b in slices(batch.column(2), 4 << 20):
            part = batch.slice(a, b - a)
            ids, back, n_words = words_of([(t or b"").lower() for t in part.column(2).cast(pa.binary()).to_pylist()], path)
            train = ~part.column(1).to_numpy(zero_copy_only=False).astype(bool)
            times = np.bincount(back, weights=np.repeat(train, n_words), minlength=int(begins[ids].sum()))
            keys, place = node_keys(ids, begins)
            learnt = np.bincount(place, weights=np.concatenate([np.repeat(times, heads(ids, begins)[1]), times[:-1]]), minlength=len(keys)).astype("<u4")
            columns = [part.column(0), part.column(1), pa.array(n_words)]
            rows = [{"chunk": chunk, "part": -1, "texts": True, "ids": packed(ids.astype("<u4")), "words": packed(back.astype("<u4"))} | {n: c.to_pylist() for n, c in zip(lists, columns, strict=True)}]
            cut = np.append(np.searchsorted(keys, edges), len(keys))
            rows += [{"chunk": chunk, "part": p, "texts": False, "keys": keys[cut[p] : cut[p + 1]].astype("<u8").tobytes(), "learnt": packed(learnt[cut[p] : cut[p + 1]])} for p in range(n_parts) if cut[p] < cut[p + 1]]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            chunk += 1


def begin_words(path: str) -> np.ndarray:
    """For each id, whether it begins a word; the end, which comes last, does."""
    flags = np.zeros(max(bpe.ranks(path).values()) + 2, bool)
    for piece, i in bpe.ranks(path).items():
        flags[i] = piece.startswith(b" ")
    flags[-1] = True
    return flags


def count_nodes(group: pa.Table) -> pa.Table:
    """The nodes of one range of hashes, over all chunks: each chunk gets its nodes' counts; chunk -1 the range's words, all (n) and distinct ones (v)."""
    keys, learnt = numbers(group["keys"], "<u8"), np.concatenate([unpacked(x, "<u4") for x in group["learnt"].to_pylist()])
    fresh, back = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(back, weights=learnt, minlength=len(fresh)).astype("<i8")
    words, at = count[(fresh & ~EVEN) > 0], np.cumsum([0, *map(len, keys)])
    rows = [packed(count[back[a:b]]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    none = [None] * len(rows)
    columns = {"chunk": [*group["chunk"].to_pylist(), -1], "part": [*group["part"].to_pylist(), -1], "counts": [*rows, None], "n": [*none, int(words.sum())], "v": [*none, int((words > 0).sum())]}
    return pa.table({n: pa.array(x, t) for (n, x), t in zip(columns.items(), (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)})


def chunks_of(batches: Iterator[pa.RecordBatch], known: Known, turn: int = 0, stride: int = 1) -> Iterator[tuple[Chunk, pa.RecordBatch, int]]:
    """The chunks of rows (ids, words, held, n_words, found, ...), each with its batch and its place there; or what a turn takes
    of them: one in stride of the training texts' spans of words, drawn by a hash of their words."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in ("ids", "words", "held", "n_words", "found")}
            found = sorted(row["found"] or [], key=lambda f: f["part"])
            counts = np.concatenate([np.zeros(0, "<i8"), *(unpacked(f["counts"], "<i8") for f in found)])
            own, back = unpacked(row["ids"], "<u4").astype(np.int64), unpacked(row["words"], "<u4").astype(np.int64)
            n_words, held = np.array(row["n_words"]), np.array(row["held"])
            if stride > 1:
                owner = np.repeat(np.arange(len(n_words)), n_words)
                begin = np.flatnonzero(np.append(True, (np.diff(np.arange(len(back)) // SPAN) > 0) | (np.diff(owner) > 0)))
                size = np.diff(np.append(begin, len(back)))
                draw = hashing.mixed(np.add.reduceat(hashing.mixed(back.astype(np.uint64)), begin) + begin.astype(np.uint64))
                mine = (draw % np.uint64(stride) == turn % stride) & ~held[owner[begin]]
                back, n_words = back[ranges(begin[mine], size[mine])], size[mine]
                held = np.zeros(len(n_words), bool)
            if len(n_words):
                yield Chunk(own, back, n_words, held, counts, known), batch, i


def fitted(grouped: DataFrame, known: Known, n_in: int, turns: int, stride: int, rate: float, seed: int) -> AttentionModel:
    """The model after so many turns; in each, every chunk trains the weights on its spans of the turn, and the weights that
    come out are averaged by windows. Sums are of whole numbers, so the order of tasks makes no difference."""
    model, scale = AttentionModel.untrained(n_in, seed), 1 << 24
    names = list(model.w)
    for turn in range(turns):
        given = {n: a.copy() for n, a in model.w.items()}

        def run(batches: Iterator[pa.RecordBatch], given=given, turn=turn) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros(sum(a.size for a in given.values()), np.int64), 0
            for chunk, _, _ in chunks_of(batches, known, turn, stride):
                own = AttentionModel({n: a.copy() for n, a in given.items()})
                n = chunk.train(own, rate * (1 - 0.8 * turn / turns))
                total += np.rint(np.concatenate([own.w[k].ravel() for k in names]).astype(np.float64) * scale).astype(np.int64) * n
                seen += n
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total))), pa.array(np.append(seen, total))], names=["i", "n"])

        summed = grouped.select("ids", "words", "held", "n_words", "found").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
        found = {r.i: int(r.n) for r in summed.collect()}  # one number for each weight
        if not found:
            break
        flat, at = np.array([found[i] / found[-1] / scale for i in range(len(found) - 1)]), 0
        for k in names:
            model.w[k] = flat[at : at + model.w[k].size].reshape(model.w[k].shape).astype(np.float32)
            at += model.w[k].size
    return model


def numbers(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", kind) for x in column.to_pylist()]


def tally(chunks: DataFrame, size: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums of of(ids of a chunk's training texts) over all chunks; of gives indexes below size. A task sends a sparse vector, and the sums are at most size numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids, words, held, n_words in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                total += np.bincount(of(unpacked(ids, "<u4").astype(np.int64), unpacked(words, "<u4")[np.repeat(~np.array(held), n_words)]), minlength=size)
        at = np.flatnonzero(total)
        for a in range(0, len(at), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[a : a + 10_000]), pa.array(total[at[a : a + 10_000]])], names=["i", "n"])

    found = chunks.select("ids", "words", "held", "n_words").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found["i"].to_numpy()] = found["n"].to_numpy()
    return out


def score_documents(
    df: DataFrame,
    vocabulary: str | None = None,
    top: int = 255,
    tail_inputs: int = 64,
    turns: int = 3,
    stride: int = 3,
    rate: float = 0.03,
    part_bytes: int = 32 << 20,
    seed: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Documents whose crc32(doc_id as text) mod 5 is 1 are held out; a null doc_id counts as the empty text. Texts are
    their words, A-Z in lower case, joined by spaces, and an end. Texts are cut into subword ids once, in chunks. How often
    the training texts have each word, and each beginning of a word that ids can make, is counted over all of them and comes
    back to the chunks that have it; ids and pairs of their classes (top outputs and one for the rest; inputs with
    tail_inputs for the rest) are counted as well. The attention weights are trained where the chunks are: in each turn on
    another one in stride of the spans of all training documents (1: on all of them), by default on each span once over the turns, with a window's own occurrence taken from the counts, and
    averaged; so what they are trained on grows with the corpus. Every document is scored whole: each id once, in a window with at least LEAD ids before it where there
    are so many.

    Counts are joined without a row for each word and document: tasks send the distinct words of a chunk of texts, and their
    beginnings, by ranges of hashes, each range is counted in a task, and what comes back is a number for each of them, so a
    word that all texts have is one entry for each chunk. Words and beginnings are told apart by 63-bit hashes of their ids; the
    base takes its counts from the same table, since a word's ids name it.

    A null or empty text is an end alone; repeated rows are scored each, and count as often in training; with no training
    documents counts are zero; very long texts are a chunk of their own; an empty table gives no rows. Other columns are not read.
    """
    vocabulary = vocabulary or bpe.public_file("byte_bpe_50k.tiktoken")
    end_id = max(bpe.ranks(vocabulary).values()) + 1
    n_ids = end_id + 1
    held = F.coalesce(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1, F.lit(False))
    df = df.select(id_col, text_col)
    docs = df.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    arrow_kind = to_arrow_type(df.schema[id_col].dataType)
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_train = docs.filter("not held_out").count()
    n_parts = max(16, -(-n_bytes // (2 * part_bytes)))
    lists = f"doc_ids array<{kind}>, held array<boolean>, n_words array<long>"
    with Scratch(df.sparkSession) as tables:
        # one pass gives two tables: the chunks' texts, and the nodes, which go once they are counted
        both, kinds = scratch(df.sparkSession, "subwords"), f"chunk long, part int, {lists}, ids binary, words binary, keys binary, learnt binary"
        tables.paths.append(both)
        docs.mapInArrow(lambda batches: subwords(batches, vocabulary, n_parts, arrow_kind), f"{kinds}, texts boolean").write.partitionBy("texts").parquet(both)
        read = lambda which: df.sparkSession.read.schema(f"{kinds}, texts boolean").parquet(both).filter(F.col("texts") == which)
        chunks = read(True).drop("part", "keys", "learnt", "texts")
        counted = read(False).select("chunk", "part", "keys", "learnt").groupBy("part").applyInArrow(count_nodes, "chunk long, part int, counts binary, n long, v long")
        counted = tables.written(counted, "counted")
        remove(df.sparkSession, f"{both}/texts=false")
        n_words, n_distinct = counted.filter("chunk = -1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
        found = counted.filter("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("part", "counts")).alias("found"))
        grouped = written(chunks.join(found, "chunk", "left"), "chunks")

    begins = begin_words(vocabulary)

    def spelled(ids: np.ndarray, words: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(begins[ids])
        length = np.diff(np.append(first, len(ids)))
        return ids[ranges(first[words], length[words])]

    counts = tally(grouped, n_ids, spelled)
    best = np.append(np.sort(np.argsort(-counts[:end_id], kind="stable")[: top - 1]), end_id)
    outputs = np.full(n_ids, top, np.int64)
    outputs[best] = np.arange(top)
    inputs = np.where(outputs < top, outputs, top + np.arange(n_ids) % tail_inputs)
    n_in, n_out = top + tail_inputs, top + 1

    def pairs_of(ids: np.ndarray, words: np.ndarray) -> np.ndarray:
        flat = spelled(ids, words)
        return inputs[np.append(end_id, flat)[: len(flat)]] * n_out + outputs[flat]

    pairs = tally(grouped, n_in * n_out, pairs_of)
    known = Known.of(counts, pairs.reshape(n_in, n_out), inputs, outputs, begins, end_id)
    model = fitted(grouped, known, n_in, turns, stride, rate, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, batch, i in chunks_of(batches, known):
            own = [batch.column(n)[i].values for n in ("doc_ids", "held", "n_words")]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, chunk.base()), pa.array(chunk.scores(model))], names=["doc_id", "held_out", "n_words", "sums", "known", "score"])

    scored = grouped.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_words long, sums double, known long, score double")
    n_total, n_kinds = n_words + n_train, n_distinct + (n_train > 0)
    each = F.lit(float(np.log10(n_total + 0.5 * (n_kinds + 1))))
    n_tokens = F.col("n_words")
    return scored.select(
        F.col("doc_id").alias(id_col),
        "held_out",
        n_tokens.alias("n_tokens"),
        (F.col("known") + int(n_train > 0)).cast("long").alias("n_known"),
        F.lit(n_total).cast("long").alias("train_tokens"),
        (F.col("sums") + float(np.log10(n_train + 0.5)) - n_tokens * each).alias("base_score"),
        "score",
    )
