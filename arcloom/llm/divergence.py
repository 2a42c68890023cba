"""How the sources of a language differ in their words: a two-pass vocabulary automaton and sparse postings."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Bytes to bytes: ASCII letters in lower case and all bytes of other characters stay, the rest of ASCII is a delimiter.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Kept terms of one automaton, about; more are counted slice by slice, each with a pass over the texts.
SLICE = 200_000
#: Entries that a task holds before it hands on what it has counted.
HELD = 1_000_000
#: Groups up to which their table is broadcast; beyond it, joins with it are shuffles.
MOST_BROADCAST = 100_000
SMOOTH, UNIT = 5, 1_000_000_000
#: The automata of the slice that this worker process has used last.
_built: dict[str, dict[str, ahocorasick.Automaton]] = {}


def automata(key: str, terms: dict[str, str]) -> dict[str, ahocorasick.Automaton]:
    """An automaton for each language, over its terms with a delimiter on both sides."""
    if key not in _built:
        _built.clear()
        made = {}
        for lang, joined in terms.items():
            made[lang] = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, term in enumerate(joined.split(" ")):
                made[lang].add_word(f" {term} ", i)
            made[lang].make_automaton()
        _built[key] = made
    return _built[key]


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, n_docs) over all docs (lang, text as binary): each task counts what it reads, Spark adds up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, c in seen.items():
                yield pa.record_batch([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()).cast(pa.string()), pa.array(c.values(), pa.int64())], ["lang", "term", "n_docs"])
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                seen.setdefault(lang, Counter()).update(set(text.as_py().translate(FOLD).split()))
            if sum(map(len, seen.values())) > HELD:
                yield from out()
        yield from out()

    return docs.select("lang", "text").mapInArrow(count, "lang string, term string, n_docs long").groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"))


def occurrences(docs: DataFrame, kept: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, source, term, n) of kept (lang, term, part): how often each stands in the texts of each group, where it does.

    A term counts where the automaton finds it between two delimiters; neighbours share theirs, so none is missed."""
    spark, found = docs.sparkSession, []
    for part in sorted(r[0] for r in kept.select("part").distinct().collect()):
        terms: dict[str, list[str]] = {}
        for r in kept.filter(F.col("part") == part).select("lang", "term").collect():  # about SLICE rows
            terms.setdefault(r["lang"], []).append(r["term"])
        shipped, key = spark.sparkContext.broadcast({lang: " ".join(t) for lang, t in terms.items()}), uuid.uuid4().hex
        sizes = {lang: len(t) for lang, t in terms.items()}

        def count(batches: Iterator[pa.RecordBatch], shipped=shipped, key=key, sizes=sizes) -> Iterator[pa.RecordBatch]:
            own = automata(key, shipped.value)
            seen: dict[tuple[str, str], np.ndarray] = {}

            def out() -> Iterator[pa.RecordBatch]:
                for (lang, source), n in seen.items():
                    names, at = shipped.value[lang].split(" "), np.flatnonzero(n)
                    yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array([source] * len(at), pa.string()), pa.array([names[i] for i in at], pa.string()), pa.array(n[at])], ["lang", "source", "term", "n"])
                seen.clear()

            for batch in batches:
                for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
                    if lang not in own:
                        continue
                    padded = f" {text.as_py().translate(FOLD).decode()} "
                    places = np.fromiter((v for _, v in own[lang].iter(padded)), dtype=np.int64)
                    if len(places):
                        if (lang, source) not in seen:
                            seen[lang, source] = np.zeros(sizes[lang], dtype=np.int64)
                        np.add.at(seen[lang, source], places, 1)
                if sum(map(len, seen.values())) > 4 * HELD:
                    yield from out()
            yield from out()

        counted = docs.mapInArrow(count, "lang string, source string, term string, n long")
        found.append(scratch.written(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), "occurrences"))
    if not found:
        return spark.createDataFrame([], "lang string, source string, term string, n long")
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * terms)), exact beyond 64 bits; null where there are no terms."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", above, (total + SMOOTH * terms).cast("decimal(20,0)")) + 1)


def overlaps(packed: DataFrame) -> DataFrame:
    """(lang, source, item, value): by how much the terms that two groups both have change what their distance would be had
    each term only one of them. packed: lang, posts (source, p, p0), a row for each term; sums of a batch's terms only go on."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("posts")
            flat, size = lists.flatten(), np.diff(lists.offsets.to_numpy())
            term = np.repeat(np.arange(len(size)), size)
            langs = batch.column("lang").take(pa.array(term)).dictionary_encode()
            sources = flat.field("source").dictionary_encode()
            p, p0 = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("p", "p0"))
            lang, source = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (langs, sources))
            n, total = len(sources.dictionary), {}
            for d in range(1, int(size.max(initial=0))):
                i = np.flatnonzero(term[:-d] == term[d:])
                j = i + d
                value = np.abs(p[i] - p[j]) - np.abs(p[i] - p0[j]) - np.abs(p0[i] - p[j]) + np.abs(p0[i] - p0[j])
                codes, at = np.unique((lang[i] * n + source[i]) * n + source[j], return_inverse=True)
                sums = np.zeros(len(codes), dtype=np.int64)
                np.add.at(sums, at, value)
                for code, s in zip(codes.tolist(), sums.tolist(), strict=True):
                    total[code] = total.get(code, 0) + s
            codes = np.array(list(total), dtype=np.int64)
            both = [sources.dictionary.take(pa.array(x)) for x in (codes // n % max(n, 1), codes % max(n, 1))] if n else [pa.array([], pa.string())] * 2
            of = langs.dictionary.take(pa.array(codes // (n * n) if n else codes))
            values = pa.array(list(total.values()), pa.int64())
            yield pa.record_batch([of, *both, values], ["lang", "source", "item", "value"])
            yield pa.record_batch([of, both[1], both[0], values], ["lang", "source", "item", "value"])

    return packed.mapInArrow(meet, "lang string, source string, item string, value long")


def source_divergence(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: for each group (lang, source) how far the language's other sources are from it
    (part pair) and the terms it has above the language's share, the first top of them (part term).

    Terms are runs of ASCII letters, lower-cased, and characters beyond ASCII. The first pass counts in how many documents of a
    language each term stands; those in least_docs at least are kept. The second pass runs an Aho-Corasick automaton of the kept
    terms, padded with delimiters, over the texts and counts their occurrences by group. Shares are integers (see share). A
    pair's distance is a sum over all kept terms, but only terms that a group has are stored: terms that neither has add a
    product, terms of one side are summed by distinct share, terms of both are corrected pair by pair.

    A null text, lang or source is empty; a group without terms, or of a language without kept terms (where distances are 0),
    has its pairs; ties go by item in UTF-8 order; repeated rows count each; very long texts are read whole; an empty table
    gives no rows; other columns are not read. Automata hold about SLICE terms each, however many are kept.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    named = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    docs = df.select(named(lang_col).alias("lang"), named(source_col).alias("source"), text.cast("binary").alias("text"))
    scratch = Scratch(df.sparkSession)
    kept = scratch.written(document_frequencies(docs).filter(F.col("n_docs") >= least_docs).select("lang", "term"), "terms")
    n_parts = -(-kept.count() // SLICE)
    kept = kept.withColumn("part", F.pmod(F.xxhash64("lang", "term"), F.lit(max(1, n_parts))))
    posts = occurrences(docs, kept, scratch)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = posts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    zero = F.lit(0).cast("long")
    groups = groups.select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("terms", zero).alias("terms"))
    groups = scratch.written(groups.withColumn("p0", share(zero, F.col("total"), F.col("terms"))), "groups")
    small = groups.count() <= MOST_BROADCAST
    near = F.broadcast(groups) if small else groups

    placed = posts.join(near, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    post = F.struct("source", "p", "p0")
    packed = placed.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.collect_list(post).alias("posts"))  # a post for each source of the language at most
    packed = scratch.written(packed, "postings")

    others = near.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pair = lambda x: x.join(others, "lang").filter("source <> item")
    apart = pair(groups).select("lang", "source", "item", F.coalesce(F.col("terms") * F.abs(F.col("p0") - F.col("q0")), zero).alias("value"))
    levels = placed.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("k"))
    single = pair(levels).select("lang", "source", "item", (F.col("k") * (F.abs(F.col("p") - F.col("q0")) - F.abs(F.col("p0") - F.col("q0")))).alias("value"))
    single = single.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = single.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = apart.unionByName(single).unionByName(turned).unionByName(overlaps(packed.select("lang", "posts")))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))

    whole = packed.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    whole = F.broadcast(whole) if small else whole  # no more rows than groups
    above = packed.join(whole, "lang").withColumn("q", share(F.col("n"), F.col("total"), F.col("terms"))).select("lang", "term", "q", F.explode("posts").alias("post"))
    above = above.select("lang", F.col("post.source").alias("source"), F.col("term").alias("item"), (F.col("post.p") - F.col("q")).alias("value")).filter("value > 0")
    terms = above.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)  # Spark keeps each task's first top before the shuffle
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
