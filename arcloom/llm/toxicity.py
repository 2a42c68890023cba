"""Toxicity by weak supervision: many voters mined from labelled rows, a generative label model, a linear classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, written

LETTERS = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that are patterns, and how many words of a text must share one for further signs.
BEGINNINGS, REPEATS = range(3, 11), (2, 3)
#: Signs, or words with their signs, that a task holds before it hands on or forgets them.
HELD = 500_000
#: Voters whose correlation given the label exceeds this share one voice.
LINKED = 0.5


def signs_of(word: str) -> list[str]:
    """The word itself (lexicon) and its beginnings (patterns, marked by a star). A sign of several words of a text has a
    further form for each of REPEATS that it reaches, with the number behind it."""
    return [word, *[word[:n] + "*" for n in BEGINNINGS if n <= len(word)]]


def words_of(text: str | None) -> set[str]:
    return set(LETTERS.findall((text or "").lower()))


def held_out(id_col: Column) -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def drawn(most: int, n: int) -> Column:
    """Whether a text belongs to a sample of about most of n texts, by its hash."""
    return F.pmod(F.xxhash64(F.lit(13), "hash"), F.lit(1 << 30)) < int(min(1.0, most / max(1, n)) * (1 << 30))


def sign_counts(labelled: DataFrame) -> DataFrame:
    """(sign, toxic, clean): in how many texts of (text, label) each sign stands; each task counts what it reads."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        cache: dict[str, list[str]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.record_batch([pa.array(names, pa.string()), *[pa.array([seen[y][s] for s in names], pa.int64()) for y in (1, 0)]], ["sign", "toxic", "clean"])
            for c in seen:
                c.clear()

        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                own: Counter = Counter()
                for word in words_of(text.as_py()):
                    if word not in cache:
                        if len(cache) > HELD:
                            cache.clear()
                        cache[word] = signs_of(word)
                    own.update(cache[word])
                seen[label].update(own.keys())
                seen[label].update([f"{s}{k}" for s, n in own.items() if n > 1 for k in REPEATS if n >= k])
            if len(seen[0]) + len(seen[1]) > HELD:
                yield from out()
        yield from out()

    return labelled.select("text", "label").mapInArrow(count, "sign string, toxic long, clean long").groupBy("sign").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def mined(labelled: DataFrame, most: int, least_gain: float) -> list[str]:
    """The signs that tell most about the label, best first: toxic texts have them more often, and their log-likelihood ratio is
    least_gain at least, which few of millions of signs reach by chance."""
    whole = labelled.agg(F.count(F.when(F.col("label") == 1, 1)).alias("p"), F.count(F.when(F.col("label") == 0, 1)).alias("n")).first()
    if not whole["p"] or not whole["n"]:
        return []
    weigh = lambda x: F.when(x > 0, x * F.log(x.cast("double"))).otherwise(0.0)
    p, n, a, b = F.lit(whole["p"]), F.lit(whole["n"]), F.col("toxic"), F.col("clean")
    gain = 2 * (weigh(a) + weigh(b) + weigh(p - a) + weigh(n - b) + weigh(p + n) - weigh(a + b) - weigh(p + n - a - b) - weigh(p) - weigh(n))
    told = sign_counts(labelled).filter((a >= 3) & (a * n > b * p)).select("sign", F.round(gain, 6).alias("gain")).filter(F.col("gain") >= least_gain)
    return [r["sign"] for r in told.orderBy(F.col("gain").desc(), "sign").limit(most).collect()]


def with_signs(docs: DataFrame, signs: list[str]) -> DataFrame:
    """docs without its text, with the ascending numbers of the signs it has."""
    forms: dict[str, list[tuple[int, int]]] = {}  # of a sign: how many words it takes, and the form's number
    for i, s in enumerate(signs):
        stem, star, least = s.partition("*")
        forms.setdefault(stem + star, []).append((int(least or 1), i))
    kept = [c for c in docs.columns if c != "text"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                own: Counter = Counter()
                for word in words_of(text.as_py()):
                    if word not in cache:
                        if len(cache) > HELD:
                            cache.clear()
                        cache[word] = tuple(s for s in signs_of(word) if s in forms)
                    if cache[word]:
                        own.update(cache[word])
                rows.append(sorted(i for s, n in own.items() for least, i in forms[s] if n >= least))
            yield pa.record_batch([*[batch.column(c) for c in kept], pa.array(rows, pa.list_(pa.int32()))], [*kept, "signs"])

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept], "signs array<int>"])
    return docs.mapInArrow(find, schema)


def votes_of(column: pa.Array, n: int) -> np.ndarray:
    """A row of n votes for each list of signs. A sign's number is its voter's; the last voter stands for all others' silence, and
    signs from there on have no vote."""
    size = np.diff(column.offsets.to_numpy())
    at, row = column.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
    votes = np.zeros((len(size), n))
    votes[row[at < n - 1], at[at < n - 1]] = 1
    votes[:, n - 1] = ~votes.any(axis=1)
    return votes


@dataclass
class LabelModel:
    """P(label), P(vote | label) for each voter, and how much of a voice each has: a voter that others repeat shares one. A voter that is
    silent abstains; that all are silent is a vote of its own."""

    share: float
    rates: np.ndarray  # [label, voter]
    voice: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = np.log(self.share / (1 - self.share)) + votes @ (self.voice * (np.log(self.rates[1]) - np.log(self.rates[0])))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def moments(texts: DataFrame, n: int, model: LabelModel | None, pairs: bool) -> np.ndarray:
    """Sums over texts (signs, label) of the weights of both labels, by label: how many (at [n, n]), votes and, if pairs is set, pairs of
    votes. Known labels count as they are, others by the model's posterior; without a model they don't count. Only sums are moved."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, n + 1, n + 1))
        for batch in batches:
            votes = votes_of(batch.column("signs"), n)
            label = batch.column("label").cast(pa.float64()).fill_null(-1.0).to_numpy(zero_copy_only=False)
            toxic = np.where(label < 0, 0.0 if model is None else model.posterior(votes), label)
            known = (label >= 0) | (model is not None)
            whole = np.hstack([votes, np.ones((len(votes), 1))])
            for y, w in ((0, (1 - toxic) * known), (1, toxic * known)):
                if pairs:
                    total[y] += (whole * w[:, None]).T @ whole
                else:
                    total[y, n] += w @ whole
        y, i, j = np.nonzero(total)
        yield pa.record_batch([pa.array(x, pa.int32()) for x in (y, i, j)] + [pa.array(total[y, i, j])], ["y", "i", "j", "v"])

    summed = texts.select("signs", F.col("label").cast("int").alias("label")).mapInArrow(add, "y int, i int, j int, v double").groupBy("y", "i", "j").agg(F.sum("v").alias("v"))
    total = np.zeros((2, n + 1, n + 1))
    for r in summed.collect():  # 2 * (n + 1)**2 at most
        total[r["y"], r["i"], r["j"]] = r["v"]
    return total


def fit_label_model(texts: DataFrame, n: int, rounds: int) -> LabelModel:
    """Rates from the labelled texts; correlations given the label; then rounds of expectation and maximisation over all of texts."""

    def rates(total: np.ndarray) -> tuple[float, np.ndarray]:
        size, on = total[:, n, n], total[:, n, :n]
        return float((size[1] + 0.5) / (size.sum() + 1)), (on + 0.1) / (size[:, None] + 0.2)

    total = moments(texts, n, None, pairs=True)
    share, first = rates(total)
    linked = np.zeros((n, n))
    for y in (0, 1):
        size = max(total[y, n, n], 1.0)
        mean = total[y, n, :n] / size
        spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
        linked = np.maximum(linked, (total[y, :n, :n] / size - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(linked, 0)
    model = LabelModel(share, first, 1 / (1 + np.where(linked > LINKED, linked, 0).sum(axis=1)))
    for _ in range(rounds):
        model = LabelModel(*rates(moments(texts, n, model, pairs=False)), model.voice)
    return model


def fit_linear(rows: np.ndarray, columns: np.ndarray, target: np.ndarray, n: int, ridge: float = 1e-4, steps: int = 300, memory: int = 10) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on posterior labels. rows, columns: where the signs are. Limited-memory
    quasi-Newton steps, each halved until the loss falls."""
    size = max(1, len(target))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        odds = np.bincount(rows, weights=w[columns], minlength=len(target)) + w[n]
        miss = 1 / (1 + np.exp(-np.clip(odds, -500, 500))) - target
        slope = np.append(np.bincount(columns, weights=miss[rows], minlength=n), miss.sum()) / size
        slope[:n] += ridge * w[:n]
        return float((np.logaddexp(0, odds) - target * odds).sum() / size + ridge / 2 * (w[:n] ** 2).sum()), slope

    w = np.zeros(n + 1)
    now, slope = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        step, used = slope.copy(), []
        for s, y in reversed(past):
            used.append((s @ step) / (s @ y))
            step -= used[-1] * y
        if past:
            step *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), a in zip(past, reversed(used), strict=True):
            step += (a - (y @ step) / (s @ y)) * s
        length = 1.0
        while length > 1e-9 and loss(w - length * step)[0] > now - 1e-4 * length * (slope @ step):
            length /= 2
        if length <= 1e-9 or np.abs(slope).max() < 1e-7:
            break
        new, (then, after) = w - length * step, loss(w - length * step)
        if (new - w) @ (after - slope) > 0:
            past = [*past, (new - w, after - slope)][-memory:]
        w, now, slope = new, then, after
    return w[:n], float(w[n])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", n_signs: int = 2000, n_voters: int = 256, least_gain: float = 30.0, rounds: int = 3, fit_rows: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """The id, held_out, score, predicted and signs (those found) of every row of docs.

    1. Signs: words and word beginnings are counted in about fit_rows labelled texts that may be learnt from (see held_out), drawn by
       hash, copies of a text once; the n_signs that tell most are kept. Each of the first n_voters votes toxic where it stands,
       lexicon or pattern.
    2. Every whole text is searched for the signs once.
    3. A generative model gets each voter's rates under either label and the correlations between voters from the labelled texts,
       and is refined by expectation and maximisation over all texts that may be learnt from, labelled or not.
    4. A logistic regression over all signs is trained on posterior labels, of about fit_rows distinct texts drawn by hash; its weights
       give the score.

    Neither label, language, source nor id is an input of a score. A null or empty text has no signs and gets the bias alone; equal
    texts score the same; a null id may be learnt from, but has no label; of several labels of one id or text the largest counts.
    Without labels of both kinds all rows score their share of toxic ones (0 without labels). An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("held_out", held_out(F.col("id"))).withColumn("hash", F.xxhash64("text"))
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    one = own.filter(~F.col("held_out")).select("id", "hash").join(known, "id").groupBy("hash").agg(F.min("id").alias("id"), F.max("label").alias("label"))
    one = scratch.written(one, "labelled")
    few = scratch.written(one.filter(drawn(fit_rows, one.count())), "drawn")
    signs = mined(own.filter(~F.col("held_out")).select("id", "hash", "text").join(F.broadcast(few), ["id", "hash"]).select("text", "label"), n_signs, least_gain)  # about fit_rows ids
    found = written(with_signs(own, signs), "signs")
    if signs:
        n = min(n_voters, len(signs)) + 1
        texts = found.filter(~F.col("held_out")).groupBy("hash").agg(F.first("signs").alias("signs")).join(one.select("hash", "label"), "hash", "left")
        texts = scratch.written(texts, "texts")
        model = fit_label_model(texts, n, rounds)
        fitted = texts.filter(drawn(fit_rows, texts.count())).select("hash", "signs", "label").toPandas().sort_values("hash")
        lists = pa.array([list(x) for x in fitted["signs"]], pa.list_(pa.int32()))
        label = fitted["label"].to_numpy(dtype=np.float64)
        target = np.concatenate([model.posterior(votes_of(lists.slice(a, 1024), n)) for a in range(0, len(lists), 1024)] or [np.zeros(0)])
        target = np.where(np.isnan(label), target, label)
        size = np.diff(lists.offsets.to_numpy())
        weights, bias = fit_linear(np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy(), target, len(signs))
    else:
        weights = np.zeros(len(signs))
        toxic = one.agg(F.avg("label")).first()[0] or 0.0
        bias = float(np.log(toxic / (1 - toxic))) if 0 < toxic < 1 else (np.inf if toxic else -np.inf)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("signs")
            size, at = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            odds = np.bincount(np.repeat(np.arange(len(size)), size), weights=weights[at], minlength=len(size)) + bias
            with np.errstate(over="ignore"):
                value = 1 / (1 + np.exp(-odds))
            named = pa.array([[signs[i] for i in x] for x in lists.to_pylist()], pa.list_(pa.string()))
            columns = [batch.column("id"), batch.column("held_out"), pa.array(value), pa.array((value >= threshold).astype(np.int32)), named]
            yield pa.record_batch(columns, ["id", "held_out", "score", "predicted", "signs"])

    kind = own.schema["id"].dataType.simpleString()
    return found.select("id", "held_out", "signs").mapInArrow(score, f"id {kind}, held_out boolean, score double, predicted int, signs array<string>").withColumnRenamed("id", id_col)
