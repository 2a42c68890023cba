"""Each corpus operator against brute force, on small tables with nulls, empties, ties, repeats, long texts and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcloom.llm import bpe

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot string, kept int, bands string, n_lines string"


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    letters = ["the", "of", "and", "alpha", "Beta", "gamma", "delta", "epsilon", "zeta", "theta", "iota", "kappa", "lambda.", "sigma", "omega!"]
    line = lambda k: " ".join(rng.choice(letters) + (str(rng.randrange(50)) if rng.random() < 0.6 else "") for _ in range(k))
    texts = ["\n".join(line(rng.randrange(6, 30)) for _ in range(rng.randrange(1, 6))) for _ in range(n)]
    texts += [texts[3], texts[3], texts[4] + " tail", texts[5].replace("alpha", "alphas", 1), texts[6].upper()]
    texts += [None, "", "   \n\t ", "one two", "one two", "a b c d e", "é ü 日本語 😀 ｗｉｄｅ", "the " * 400, line(9000), "x" * 3000]
    rows = [(i, t, "en", f"src{i % 4}" if i % 9 else None, 1, "s", 2, "b", "l") for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, texts[8], None, None, None, None, None, None, None), (None, None, "x", "src1", 0, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('docs')}/t"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def test_sharding(docs, none, rows):
    from arcloom.llm.sharding import shard_documents

    out = shard_documents(docs, n_shards=7, least_buckets=5).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r[0], r[1]) for r in rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 7
    again = shard_documents(docs, n_shards=7, least_buckets=5).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))
    other = shard_documents(docs, n_shards=7, least_buckets=5, seed=99).collect()
    assert sorted(map(repr, other)) != sorted(map(repr, out))
    assert shard_documents(none, n_shards=3).count() == 0
    assert shard_documents(docs.limit(2), n_shards=5).count() == 2


def test_sharding_positions_do_not_depend_on_spans(docs, monkeypatch):
    from arcloom.llm import sharding

    out = sharding.shard_documents(docs, n_shards=7, least_buckets=50).collect()
    monkeypatch.setattr(sharding, "SPAN", 3)
    assert sorted(map(repr, sharding.shard_documents(docs, n_shards=7, least_buckets=50).collect())) == sorted(map(repr, out))


def test_packing(docs, none, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    from arcloom.llm.packing import pack_documents

    code = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    code.encode_special_tokens = True
    out = pack_documents(docs, width=128, chunk=2000, grain=32).collect()
    want = Counter((r[0], tuple(code.encode(r[1] or "", add_special_tokens=False).ids + [0])) for r in rows)
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= 128
    got, held = Counter(), []
    for key in sorted(sequences):  # the stream's order
        for r in sequences[key]:
            ids = np.frombuffer(r.ids, "<u4").tolist()
            assert len(ids) == r.length and r.start == len(held)
            held += ids
            if len(held) == r.doc_tokens:
                got[r.doc_id, tuple(held)] += 1
                held = []
    assert got == want and not held
    assert pack_documents(none).count() == 0


def test_best_windows_is_optimal():
    from arcloom.llm.packing import SENTENCE_COST, WINDOW_COST, best_windows, cut_points

    rng = np.random.default_rng(5)
    for _ in range(30):
        ends = np.cumsum(rng.integers(1, 40, 12))
        stops = np.unique(rng.integers(1, ends[-1], 15))
        at, cost = cut_points(ends, stops, 10)
        pad = lambda n: 0 if n & (n - 1) == 0 and n >= 64 else 96 - n  # noqa: B023, E731
        best = {0: 0}
        for j in range(1, len(at)):
            best[j] = min(best[i] + pad(at[j] - at[i]) + WINDOW_COST + cost[j] for i in range(j) if at[j] - at[i] <= 96)
        got = [0, *best_windows(at, cost, 96)]
        price = dict(zip(at.tolist(), cost.tolist(), strict=True))
        assert sum(pad(b - a) + WINDOW_COST + price[b] for a, b in zip(got, got[1:], strict=False)) == best[len(at) - 1]
        assert SENTENCE_COST > 0


def test_pieces(docs, none, rows):
    import sentencepiece

    from arcloom.llm.pieces import PieceModel, decode_ids, encode_documents

    path = bpe.public_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    out = encode_documents(docs, path, slice_bytes=4000, pass_bytes=9000, check=True)
    got = out.collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((r[0], tuple(library.encode(r[1] or ""))) for r in rows)
    assert all(r.exact and r.n_tokens == len(r.ids) for r in got)
    back = decode_ids(out, path).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r[0], r[1] or "") for r in rows)
    assert encode_documents(none, path).count() == 0
    own, rng = PieceModel(path), random.Random(4)
    texts = ["".join(rng.choice("aabcde  the inging \n1é日😀.,▁") for _ in range(rng.randrange(1, 50))) for _ in range(1500)]
    texts += [" " * k + w for k in range(40) for w in ("", "the", "9", "日")]
    assert own.encode(texts) == library.encode(texts)
    assert own.decode(own.encode(texts)) == library.decode(library.encode(texts))


def test_pieces_unigram(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    from arcloom.llm.pieces import PieceModel

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(bpe.public_file("piece_bpe_32k.model"), "rb").read())
    proto.trainer_spec.model_type = 1
    for i, p in enumerate(proto.pieces):  # distinct log probabilities in place of ranks
        p.score = p.score and (-9 - i / 4e3 - len(p.piece) / 7 if p.score > -1e8 else -30 - i / 1e3)
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    library, own, rng = sentencepiece.SentencePieceProcessor(model_file=str(path)), PieceModel(str(path)), random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdeinthg") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    for t, a, b in zip(texts, own.encode(texts), library.encode(texts), strict=True):  # ties may go either way
        assert library.decode(a) == t and abs(sum(own.score[a]) - sum(own.score[b])) < 1e-3


PAGE = '<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script><style>p{{}}</style></head><body><header>Top</header><nav><ul><li><a href="/">Home</a></li></ul></nav>{body}<footer>&copy; foot</footer></body></html>'


def test_html(spark):
    from arcloom.llm.htmltext import extract_pages

    cases = {
        "<article><h1>One &amp;  two</h1><p>Three<br>four <b>fi</b>ve.<p>six</article>": "One & two Three four five. six",
        '<article><p>Text</p><div class="ad">Buy</div><aside>side</aside><form><p>mail</p></form><section id="comments"><p>no</p></section></article>': "Text",
        '<div class="content"><p>Long enough paragraph of the main text here.</p><p>Another one.</p></div><div class="sidebar"><p>Links</p></div>': "Long enough paragraph of the main text here. Another one.",
        "<article><p>a &lt;b&gt; &#233; &nbsp; c</p><!-- gone --><p hidden>no</p></article>": "a <b> é c",
        "<article></article>": "",
        "<article><p>not closed": "not closed © foot",
    }
    rows = [(i, f"https://h{i % 2}.example.org/{i}", PAGE.format(body=b)) for i, b in enumerate(cases)]
    rows += [(100, None, None), (101, "https://h0.example.org/x", ""), rows[0]]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    for i, want in enumerate(cases.values()):
        assert by[i].replace(" © foot", "") == want.replace(" © foot", ""), i
    assert by[100] == "" and by[101] == "" and all(r.n_chars == len(r.text) for r in got)
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_template(spark):
    from arcloom.llm.htmltext import extract_pages

    page = lambda i: f"<html><body><div id=page><div id=top><p>Welcome to the site</p></div><div id=main><p>Story {i} {'abc def ' * (i + 3)}</p></div><div id=end><p>Call us</p></div></div></body></html>"
    rows = [(i, f"http://host/{i}", page(i)) for i in range(12)]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"Story {r.page_id} {('abc def ' * (r.page_id + 3)).strip()}" for r in got)


def test_warc(spark):
    from arcloom.llm.warc import read_archives, write_archives

    rows = [(i, f"http://a/{i}", f"<p>page {i % 7}</p>" * 50) for i in range(40)] + [(50, None, None), (51, "http://a/ b\n", ""), (None, "http://n", "<p>null</p>"), (60, "x", "twin"), (60, "x", "twin")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    root = write_archives(pages, shard_bytes=4000, roll_bytes=900)
    got = read_archives(spark, root, payloads=True).collect()
    assert len(got) == len(rows)
    last = defaultdict(lambda: -1)
    for i, _, h in rows:
        last[h or ""] = max(last[h or ""], -1 if i is None else i)
    for r in got:
        if r.page_id in (None, 60):
            continue
        data = (next(h for i, _, h in rows if i == r.page_id) or "").encode()
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = last[data.decode()]
        assert (r.record_type, r.refers_to) == (("response", None) if first == r.page_id else ("revisit", first))
        assert r.payload == (data if r.record_type == "response" else None)
    assert sorted(r.record_type for r in got if r.page_id == 60) == ["response", "revisit"]
    assert read_archives(spark, write_archives(pages.limit(0))).count() == 0


def shingles(t):
    w = words((t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(ids, sets, percent=75):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(ids))]


def test_near_duplicates(docs, none, rows):
    from arcloom.llm.neardup import near_duplicates, without_near_duplicates

    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    ids, sets = [r[0] for r in rows], [shingles(r[1]) for r in rows]
    roots = linked(ids, sets)
    low = defaultdict(list)
    for i, root in zip(ids, roots, strict=True):
        low[root].append(i)
    low = {k: min((x for x in v if x is not None), default=None) for k, v in low.items()}
    want = Counter((i, len(s), low[r], i == low[r]) for i, s, r in zip(ids, sets, roots, strict=True))
    assert got == want
    left = without_near_duplicates(docs)
    assert left.columns == docs.columns
    assert left.count() == len(set(roots[i] for i in range(len(ids)) if sets[i])) + sum(not s for s in sets)
    assert near_duplicates(none).count() == 0 and without_near_duplicates(none).count() == 0


def test_near_duplicate_chains(spark):
    """Links that only lead over other documents, and a group whose members are not all linked."""
    from arcloom.llm.neardup import near_duplicates

    rng, base = random.Random(3), [f"w{i}" for i in range(120)]
    texts = []
    for k in range(60):
        own = list(base)
        for i in rng.sample(range(120), rng.randrange(0, 6)):
            own[i] = f"v{k}_{i}"
        texts.append(" ".join(own))
    texts += [" ".join(base[i : i + 100]) for i in range(0, 20, 2)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    roots = linked(range(len(texts)), [shingles(t) for t in texts])
    assert got == dict(enumerate(roots))


def test_scoring(docs, none, rows):
    from arcloom.llm.scoring import score_documents

    got = score_documents(docs, stride=2, turns=2, part_bytes=2000).collect()
    assert len(got) == len(rows)
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 1 for r in rows]
    count = Counter()
    for r, h in zip(rows, held, strict=True):
        if not h:
            count.update([*words((r[1] or "").translate(LOWER)), None])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for r, h in zip(rows, held, strict=True):
        own = [*words((r[1] or "").translate(LOWER)), None]
        base = sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        want[r[0], h, len(own), sum(count[w] > 0 for w in own), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert score_documents(none).count() == 0


def small_known(texts, n_ids=12, top=6):
    """What the model knows of training texts of ids (the last id is the end; ids divisible by 3 begin words), and counts of nodes."""
    from arcloom.llm.scoring import Known, nodes

    end = n_ids - 1
    flat = np.concatenate([np.append(t, end) for t in texts])
    begins = np.arange(n_ids) % 3 == 0
    begins[end] = True
    outputs = np.where(np.arange(n_ids) < top, np.arange(n_ids), top)
    outputs[end] = 0
    inputs = np.where(outputs < top, outputs, top + np.arange(n_ids) % 2)
    pairs = np.zeros((top + 2, top + 1))
    np.add.at(pairs, (inputs[np.append(end, flat[:-1])], outputs[flat]), 1)
    node, over = nodes(flat, begins)
    stops = over[np.flatnonzero(begins[flat[1:]] & (flat[:-1] != end))]
    return Known.of(np.bincount(flat, minlength=n_ids), pairs, inputs, outputs, begins, end), Counter([*node.tolist(), *stops.tolist()])


def chunk(texts, known, count):
    """A chunk of texts of ids that begin with a word, a word for each of theirs."""
    from arcloom.llm.scoring import Chunk, node_keys

    own = np.concatenate([np.append(t, known.end_id) for t in texts])
    keys, _ = node_keys(own, known.begins)
    n_words = np.array([int(known.begins[t].sum()) + 1 for t in texts])
    return Chunk(own, np.arange(n_words.sum()), n_words, np.zeros(len(texts), bool), np.array([count[k] for k in keys.tolist()]), known)


def wordy(rng, n):
    """Ids of words: one that begins a word and up to two more."""
    pool = [[3, 1], [3, 2], [6, 1, 4], [9], [0, 5], [6, 7]]
    return np.concatenate([pool[rng.integers(len(pool))] for _ in range(n)])


def test_attention_gradients_and_sums():
    from arcloom.llm.scoring import AttentionModel, windows

    rng = np.random.default_rng(3)
    texts = [wordy(rng, 30), wordy(rng, 2)]
    known, count = small_known(texts)
    own = AttentionModel.untrained(8, 1)
    own.w = {k: v.astype(np.float64) for k, v in own.w.items()}
    now = chunk(texts, known, count)
    given = now.examples(*windows(now.sizes), 1)
    _, grad = own.gradients(*given)
    for name, place in (("embed", (1, 2)), ("query", (0, 3)), ("key", (2, 1)), ("value", (3, 3)), ("own", (1, 1)), ("gate", (2, 3)), ("place", (20, 5)), ("seen", (2, 0))):
        step, old = 1e-4, own.w[name][place]
        own.w[name][place] = old + step
        up, _ = own.gradients(*given)
        own.w[name][place] = old - step
        down, _ = own.gradients(*given)
        own.w[name][place] = old
        assert abs((up - down) / (2 * step) - grad[name][place]) < 1e-4, name
    model = AttentionModel.untrained(8, 2)
    for before in (texts[0][:17], texts[0][:1], np.array([3, 8, 8]), np.array([6, 1, 4, 4, 9])):
        total = 0.0
        for y in range(12):
            now = chunk([np.append(before, y) if y != known.end_id else before], known, count)
            at, first, owner = windows(now.sizes)
            *given, live = now.examples(at, first, owner, 0)
            total += model.forward(*given)["p"].ravel()[len(before)]
        assert abs(total - 1) < 1e-5


def test_windows_score_each_id_once():
    from arcloom.llm.scoring import FRESH, windows

    sizes = np.array([1, 2, 24, 25, 101])
    at, before, owner = windows(sizes)
    begin = np.cumsum(sizes) - sizes
    for k, n in enumerate(sizes.tolist()):
        mine = owner == k
        assert before[mine].tolist() == list(range(0, n, FRESH)) and (at[mine] - before[mine] == begin[k]).all()


def test_attention_learns():
    """Copying what followed earlier in the window is learnt by attention, and is lost without it."""
    from arcloom.llm.scoring import AttentionModel

    rng = np.random.default_rng(5)
    known, count = small_known([wordy(rng, 400)])
    texts = [np.tile(np.append(3, rng.integers(0, 11, 6)), 12) for _ in range(150)]
    model = AttentionModel.untrained(8, 1)
    now = chunk(texts, known, count)
    before = now.scores(model).sum()
    for _ in range(6):
        now.train(model, 0.02)
    after = now.scores(model).sum()
    model.w["seen"][:, 3] = -30
    model.w["gate"][:, 3] = 0
    assert after > 0.7 * before and after > now.scores(model).sum() * 0.8


def test_scoring_held_out(spark):
    """On held-out documents whose words all stand in the training texts the model's score is above the word base (which
    gives any other word a share of a whole, and need not spell it), and training beats counts alone on all of them."""
    from arcloom.llm.queries import op8_scoring
    from arcloom.llm.scoring import score_documents

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mean = lambda df, c: df.filter("held_out").agg(F.sum(c) / F.sum("n_tokens")).first()[0]
    got = op8_scoring(spark, "/root/testdata/sf0.01").select("held_out", "n_tokens", "n_known", "score", "base_score").cache()
    same = got.filter("n_known = n_tokens")
    assert mean(same, "score") > mean(same, "base_score")
    model, base = mean(got, "score"), mean(got, "base_score")
    counts = mean(score_documents(docs, turns=0), "score")
    print(f"held out, log10 a token: model {model:.3f}, counts alone {counts:.3f}, base {base:.3f}")
    assert model > counts


def test_neighbours(spark):
    from arcloom.llm.neighbours import nearest

    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 16))
    x[100:400] = x[100]  # a third are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None] + [0.0] * 14), (2010, [1.0] * 3), (None, x[0].tolist()), rows[7]]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50, rerank=200, row_block=256, query_block=8, n_books=4, n_codes=32).collect()
    found = defaultdict(dict)
    for r in got:
        found[r.query_id][r.rank] = (r.vec_id, r.score)
    hits = 0
    for q in range(0, 900, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = [j for j in np.lexsort((np.arange(900), d)) if j != q][:10]
        own = [found[q][k][0] for k in range(1, 11)]
        hits += len(set(own) & set(best))
        assert all(abs(found[q][k][1] - d[found[q][k][0]]) < 1e-9 for k in range(1, 11))
        if 100 <= q < 400:
            assert own == best
    assert set(found) == set(range(0, 900, 50)) and hits >= 0.9 * 180
    small = nearest(spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>"), every=1, n_books=2, n_codes=4).collect()
    assert len(small) == 12
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_quality(docs, none, rows):
    from arcloom.llm.quality import host_quality

    got = host_quality(docs).collect()
    assert len(got) == len(rows)
    want = Counter()
    for r in rows:
        t, w = r[1] or "", words(r[1])
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        seen, cover = Counter(grams), set()
        for i, g in enumerate(grams):
            if seen[g] > 1:
                cover.update(range(i, i + 8))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        want[r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), failed] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got) and any(r.kept for r in got)
    assert host_quality(none).count() == 0


def test_bad_host(spark):
    """Mild failures cost a document its place on a bad host only, and clean documents stay everywhere."""
    from arcloom.llm.quality import host_quality

    clean = " ".join(f"word{i}" for i in range(40))
    mild = " ".join(f"word{i}" + ("#" if i % 8 == 0 else "") for i in range(40))
    rows = [(i, mild if i < 45 else clean, "bad") for i in range(50)] + [(100 + i, mild if i < 2 else clean, "good") for i in range(50)]
    got = {r.doc_id: r.kept for r in host_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[i] for i in range(45)) and all(got[i] for i in range(45, 50)) and all(got[i] for i in range(100, 150))


def edit(a, b):
    """Edit distance, a row of the table at a time as bits of a number."""
    if not a:
        return len(b)
    where, m = defaultdict(int), len(a)
    for i, c in enumerate(a):
        where[c] |= 1 << i
    full, top, up, down, score = (1 << m) - 1, 1 << (m - 1), (1 << m) - 1, 0, m
    for c in b:
        eq = where.get(c, 0)
        xv, xh = eq | down, (((eq & up) + up) ^ up) | eq
        ph, mh = (down | ~(xh | up)) & full, up & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ((ph << 1) | 1) & full, (mh << 1) & full
        up, down = (mh | ~(xv | ph)) & full, ph & xv
    return score


def line_drops(order):
    """Which lines of rows (doc_id, text) go, by all pairs of lines and plain edit similarity."""
    from arcloom.llm.lines import GAPS

    gaps = {ord(c): " " for c in GAPS}
    where = defaultdict(list)
    for r, (i, t) in enumerate(order):
        for p, x in enumerate((t or "").split("\n")):
            w = [y for y in x.lower().translate(gaps).split(" ") if y]
            if w:
                where[" ".join(w)].append((-1 if i is None else i, r, p))
    norms = list(where)
    counts = [Counter(x) for x in norms]
    parent = list(range(len(norms)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(norms)):
        for j in range(i):
            most = max(len(norms[i]), len(norms[j])) * 10 // 100
            apart = sum(((counts[i] - counts[j]) + (counts[j] - counts[i])).values()) > 2 * most  # an edit changes two counts at most
            if abs(len(norms[i]) - len(norms[j])) <= most and not apart and edit(norms[i], norms[j]) <= most:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups, drop = defaultdict(list), defaultdict(set)
    for i, x in enumerate(norms):
        groups[find(i)] += where[x]
    for own in groups.values():
        for _, r, p in sorted(own)[1:]:
            drop[r].add(p)
    return drop


def test_lines(spark, none, tmp_path):
    """Against brute force by plain edit similarity: what stays of each text, also for repeated rows, nulls, ties and clashing names."""
    from arcloom.llm.lines import dedup_lines

    rng = random.Random(9)
    pool = [" ".join(f"word{rng.randrange(400)}" for _ in range(rng.randrange(5, 60))) for _ in range(40)]
    pool += [p.replace("word1", "wordy1", 1) for p in pool[:15]] + [p.upper() + "!" for p in pool[15:20]] + ["short line", "", "ab " * 200]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))) for _ in range(60)] + [None, "", "\n\n"]
    path = f"file://{tmp_path}/t"
    rows = [(i, t, "x", "r") for i, t in enumerate(texts)] + [(5, texts[5], "x", "r"), (None, texts[7], None, None)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, n_lines string, row string").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    order = [(r.doc_id, r.text) for r in df.collect()]
    drop = line_drops(order)
    want = Counter()
    for r, (i, t) in enumerate(order):
        left = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in drop[r])
        want[i, left, len((t or "").split("\n")), len(drop[r])] += 1
    got = dedup_lines(df)
    assert got.columns == ["doc_id", "text", "row", "n_lines", "n_dropped"]
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == want
    assert dedup_lines(none).count() == 0


def test_components(spark):
    from arcloom.llm.graph import components

    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)] + [(500, 500 + i) for i in range(1, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(parent)}


def test_pipeline(docs, none, spark):
    """Each stage against brute force, on what its predecessor kept."""
    import duckdb

    import corpus_pipeline
    from arcloom.llm.queries import QUALITY

    folder = spark.conf.get("spark.checkpoint.dir")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "lines", "near_duplicates", "packing"]
    # rows that SQL can tell apart by doc_id: one of each
    made = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    made.coalesce(1).write.mode("overwrite").parquet(f"{folder}/stage-in")
    made = spark.read.parquet(f"{folder}/stage-in")
    out = {}
    for name in ("quality", "lines", "near_duplicates"):
        got = stages[name](spark, made, "")
        assert got.columns == docs.columns, name
        assert stages[name](spark, none, "").count() == 0
        path = f"{folder}/stage-{name}"
        got.coalesce(1).write.mode("overwrite").parquet(path)
        out[name] = ([(r.doc_id, r.text) for r in made.collect()], [(r.doc_id, r.text, r.n_chars) for r in spark.read.parquet(path).collect()])
        made = spark.read.parquet(path)

    before, after = out["quality"]
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{(folder + '/stage-in').removeprefix('file://')}/*.parquet'")
    kept = {r[0] for r in db.execute(f"select doc_id from ({QUALITY}) where kept").fetchall()}
    assert {r[0] for r in after} == kept and len(after) == len(kept)

    before, after = out["lines"]
    drop, want = line_drops(before), {}
    for r, (i, t) in enumerate(before):
        left = "\n".join(x for p, x in enumerate(t.split("\n")) if p not in drop[r])
        if not drop[r] or words(left):
            want[i] = (left, len(left) if drop[r] else 1)
    assert {i: (t, n) for i, t, n in after} == want

    before, after = out["near_duplicates"]
    roots = linked(range(len(before)), [shingles(t) for _, t in before])
    groups = defaultdict(list)
    for (i, t), g in zip(before, roots, strict=True):
        groups[g].append(i)
    assert {r[0] for r in after} == {min(g) for g in groups.values()} and len(after) == len(groups)

    pieces = stages["packing"](spark, made, "").collect()
    assert {r.doc_id for r in pieces} == {r[0] for r in after} and all(r.length > 0 and r.offset + r.length <= 1024 for r in pieces)
    assert stages["packing"](spark, none, "").count() == 0


def edited(rng, text, n, letters="abcdefghij"):
    """text after n edits: letters changed, left out or put in."""
    for _ in range(n):
        at = rng.randrange(1, len(text) - 1)
        text = text[:at] + rng.choice(["", rng.choice(letters), text[at] + rng.choice(letters)]) + text[at + 1 :]
    return text


def test_lines_edits(spark, tmp_path):
    """Lines within the edit similarity go, whichever words the edits are in, and where there are hardly any words."""
    from arcloom.llm.lines import dedup_lines

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    texts, pairs = [], []
    for i in range(240):
        base = " ".join(word() for _ in range(5 + i % 40))
        if i % 6 == 5:  # a script without spaces, with a few marks that part words
            base = "、".join("".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(20)) for _ in range(5))
        clean = " ".join(base.replace("、", " ").split())
        most = len(clean) // 10
        other = edited(rng, clean, rng.choice([1, 2, max(1, most // 3)]))
        other = " ".join(other.split())
        texts += [base, other]
        short = max(len(clean), len(other)) <= 59
        pairs.append((edit(clean, other) * 10 <= max(len(clean), len(other)), short))
    path = f"file://{tmp_path}/t"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    got = {r.doc_id: r.n_dropped for r in dedup_lines(spark.read.parquet(path)).collect()}
    for must in (True, False):
        found = [got[2 * i + 1] for i, (like, short) in enumerate(pairs) if like and short == must]
        assert len(found) > 20 and sum(found) >= (1.0 if must else 0.97) * len(found)
    assert not any(got[2 * i] for i in range(240)) and not any(got[2 * i + 1] for i, (like, _) in enumerate(pairs) if not like)


def test_segment_keys(spark):
    """Short lines within the edit similarity always share a key."""
    from arcloom.llm.edits import segment_keys

    rng = random.Random(6)
    pairs = []
    while len(pairs) < 3000:
        x = "".join(rng.choice("ab c") for _ in range(rng.randrange(10, 60)))
        y = edited(rng, x, max(1, len(x) // 10), "abc ")
        if x != y and len(y) < 60 and edit(x, y) * 10 <= max(len(x), len(y)):
            pairs.append((x, y))
    df = spark.createDataFrame(pairs, "x string, y string")
    assert df.filter(~F.arrays_overlap(segment_keys(F.col("x"), F.length("x"), 90), segment_keys(F.col("y"), F.length("y"), 90))).count() == 0


def test_short_lines(spark, tmp_path):
    """The query dedups lines of few words as any others; lines without a word stay."""
    import corpus_pipeline
    from arcloom.llm.queries import op1_lines

    long = "これは空白のない長い行であり語は一つしかないが何度も出てくる"
    texts = [f"menu\n{long}\n---\nonly here {i}x{i * 7919}" for i in range(6)] + ["Menu!", "a 1", "b 1"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_dropped, r.text) for r in op1_lines(spark, f"file://{tmp_path}").collect()}
    assert got[0] == (0, texts[0]) and got[6] == (1, "") and got[7] == (0, "a 1") and got[8] == (0, "b 1")
    assert all(got[i][1].startswith("---") and got[i][0] == 2 for i in range(1, 6))
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.lines(spark, docs, "").collect()} == {0, 1, 2, 3, 4, 5, 7, 8}
