"""Each operator for training text against a plain version, and on nulls, empty and long texts, repeats and empty tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from whisperlake.llm import (
    arrays, boosted, decontaminate, doc_stats, line_dedup, lm_scores, packing, quality_model, quality_rules, simhash, tokens,
    toxicity, url_filter, wavelet,
)
from whisperlake.session import work_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, first string, kept boolean, label int, chunk long"
PROSE = ("the quick brown fox jumps over the lazy dog and runs into the forest of old trees where it was seen by two of the men who had "
         "not been in that place for a year as they are on a long way from the town to the sea").split()


def prose(rng, n):
    return " ".join(rng.choice(PROSE) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def frame(spark, rows):
    """(doc_id, text, lang) rows as documents with further columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 7, "x", True, 1, 3) for i, t, lang in rows], SCHEMA)


def edge_rows():
    rng = random.Random(5)
    a = prose(rng, 120)
    return [
        (1, a, "en"), (2, None, None), (3, "", "en"), (None, a + " end", "en"), (4, a, None), (4, a, None),
        (5, " \t\n\x0b \n", "xx"), (6, prose(rng, 30_000), "en"), (7, "one", "de"), (8, "Ünïcödé 𝒳 é\u0301 ﬁ İI", "fr"),
        (9, a.upper() + "\n" + a, "en"), (10, "a b c d", "en"), (-3, "x" * 70_000, "en"),
    ]


@pytest.fixture(scope="module")
def edges(spark):
    path = work_dir(spark, "edges")
    frame(spark, edge_rows()).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, []).limit(0)


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


# --- tokens, packing, token files ---------------------------------------------------------------


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokens_equal_plain_encoding(file):
    """Against an untouched tokenizer, with its special marks alone, between words and within them."""
    rng = random.Random(1)
    signs = list("abABİßΣσ1२é😀가 \n\t\r\x0b\x1c\x85\xa0\u3000\u180e.,'!|<>") + ["  ", " 's", "'LL", "e\u0301", "word", "Word.", "ÿ!", "Zz?)", "<|ENDOFTEXT|>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(4000)]
    marks = ["<|endoftext|>", "<|startoftext|>"]
    texts += ["".join(rng.choice(signs + marks) for _ in range(rng.randrange(12))) for _ in range(2000)]
    texts += [a + m + b for m in marks for a in ("", "a", "a ", "A\n") for b in ("", "b", " b", m)]
    plain = Tokenizer.from_file(tokens.path_of(file))
    e = tokens.Encoder(file)
    want = [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from memory
        got = e.encode(arrays.texts_of(pa.array(texts)))
        assert [got.ids[a:b].tolist() for a, b in zip(got.starts, got.starts[1:])] == want
    assert e.encode(arrays.texts_of(pa.array([], pa.string()))).ids.tolist() == []


def plain_ids(file, end, rows):
    e = tokens.Encoder(file)
    return [x + [end] for x in e.plain([t or "" for _, t, _ in rows])]


def test_packing(spark, edges, nothing):
    rows = edge_rows()
    ids = defaultdict(list)
    for (i, _, _), x in zip(rows, plain_ids("word_bpe_49k.json", 2, rows)):
        ids[i].append(x)
    got = packing.pack(edges, capacity=256, slack=4).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        piece = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(piece) == r.length > 0
        assert any(x[r.start:r.start + r.length] == piece and len(x) == r.doc_tokens for x in ids[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, texts in ids.items():
        covered = Counter(p for a, n in by_doc[i] for p in range(a, a + n))
        assert covered == Counter(p for x in texts for p in range(len(x)))
    used = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 256
        used += at
    assert used > 0.97 * 256 * (len(by_sequence) - 3)
    assert packing.pack(nothing).count() == 0


@pytest.mark.parametrize("capacity,slack", [(4096, 64), (256, 4), (10, 0)])
def test_cuts_cover_each_rest(capacity, slack):
    plan, place, number = packing.cuts(capacity, slack)
    for rest in range(1, capacity):
        parts = plan[place[rest]:place[rest] + number[rest]].tolist()
        assert sum(parts) == rest
        assert all(capacity - capacity // n * n <= max(slack, capacity // n - 1) or capacity % (capacity // n) >= 0 for n in parts)
    lengths = np.random.default_rng(0).integers(1, capacity + 1, 500)
    placed, bin_no, offset, rest = packing.fill(lengths, capacity)
    assert sorted([*placed, *rest]) == list(range(500))
    for b in np.unique(bin_no):
        own = placed[bin_no == b]
        k = capacity // lengths[own]
        assert len(set(k)) == 1 and len(own) == k[0] and lengths[own].sum() <= capacity
        assert offset[bin_no == b].tolist() == [0, *np.cumsum(lengths[own])[:-1]]


@pytest.mark.parametrize("n,top", [(0, 1), (1, 50257), (513, 2), (5000, 50257), (4096, 300)])
def test_wavelet_matrix(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    levels = max(1, (top - 1).bit_length())
    w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, levels).to_bytes())
    assert (w.decode() == ids).all()
    assert (w.access(np.arange(n)) == ids).all()
    for s in [*set(ids[:5].tolist()), top + 5, 0]:
        where = np.flatnonzero(ids == s)
        assert w.count(s) == len(where) and w.locate(s).tolist() == where.tolist()
        assert [w.select(s, k) for k in range(min(3, len(where)))] == where[:3].tolist()
        assert w.select(s, len(where)) == -1
        assert w.rank(s, n // 2) == (ids[:n // 2] == s).sum()


def test_token_files(spark, edges, nothing):
    rows = edge_rows()
    order = sorted(zip(rows, plain_ids("byte_bpe_50k.json", 0, rows)), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[0][1] or ""))
    want, at = [], 0
    for (i, _, _), x in order:
        want.append((i, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    path = work_dir(spark, "files")
    wavelet.write_shards(edges, path, shard_ids=5000)
    got = wavelet.read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert spark.read.parquet(path).count() >= 3
    path = work_dir(spark, "files")
    wavelet.write_shards(nothing, path)
    assert wavelet.read_documents(spark, path).count() == 0


# --- URLs -----------------------------------------------------------------------------------------


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return lowered(host), re.match(r"[^?#]*", rest[len(host):])[0]


def plain_rule(host, path):
    fit = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.host + r.path), default=None)
    return (best.host + best.path, best.verdict) if best else (None, None)


def test_url_rules_and_models(spark):
    urls = [None, "", "nothing", "http://", "x://A.Org", "http://a.org/x", "http://EXAMPLE.org/es/1?q", "http://example.org/en/19", "http://www.example.org/en/2",
            "http://xexample.org/es/", "https://fr.com/fr/a://b", "http://com/de/", "http://a.com/de", "http://é.net/ü", "ftp://h?x/y", "h://u:p@x.com:80/fr/#a",
            "http://example.net/a\nb", "http://casino-win.example.net/en/1", "http://casino-win.example.net/en/1"]
    urls += [f"http://site{i % 37}.example.net/en/{i}" for i in range(400)] + [f"http://free-bets.example.net/x/{i}" for i in range(60)]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = plain_url(u)
        rule, verdict = plain_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (verdict or ("block" if got[i].score > 0 else "allow"))
    assert got[17].verdict == got[18].verdict == "block" and got[0].verdict == got[1].verdict == "allow"
    assert all(got[i].verdict == "block" for i, u in enumerate(urls) if u and "free-bets" in u)
    assert sum(got[i].verdict == "block" for i, u in enumerate(urls) if u and "//site" in u) <= 2
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_markov_model_is_a_distribution():
    order = 3
    m = url_filter.fit(["abcab", "abd", "b"], order)
    for before in ("", "ab", "zz", "cab"):
        texts = arrays.texts_of(pa.array([before + chr(c) for c in range(1, 128)]))
        packed, starts = url_filter.contexts(texts, order)
        p = np.exp(m.log_probability(packed[starts[1:] - 1])).sum()
        nul = np.exp(m.log_probability(url_filter.contexts(arrays.texts_of(pa.array([before + "\0"])), order)[0][-1:]))[0]
        assert p + nul == pytest.approx(1)


# --- language model -----------------------------------------------------------------------------


@pytest.mark.parametrize("order", [1, 2, 3])
def test_stupid_backoff(spark, edges, nothing, order):
    rows = edge_rows()
    docs = [plain_words(lowered(t)) for _, t, _ in rows]
    count = Counter()
    for w in docs:
        for k in range(1, order + 1):
            count.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    total = sum(map(len, docs))
    want = []
    for (i, _, _), w in zip(rows, docs):
        log, back = 0.0, 0
        for at in range(len(w)):
            factor, k = 1.0, min(order, at + 1)
            while k > 1 and count[tuple(w[at - k + 1:at + 1])] < 2:
                factor, k = factor * 0.4, k - 1
            back += k < min(order, at + 1)
            context = count[tuple(w[at - k + 1:at])] if k > 1 else total
            log += np.log(factor * count[tuple(w[at - k + 1:at + 1])] / context)
        want.append((i, len(w), back, round(log, 4)))
    got = [(r.doc_id, r.n_words, r.n_backoff, round(r.log_score, 4)) for r in lm_scores.score(edges, order).collect()]
    got, want = sorted(got, key=lambda r: str(r[:3])), sorted(want, key=lambda r: str(r[:3]))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=1e-3)
    assert lm_scores.score(nothing).count() == 0


# --- toxicity and quality -------------------------------------------------------------------------


def labelled(spark, n=900):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        # Toxic labels come with one group's name far more often than with the others.
        group = "muslim" if rng.random() < (0.7 if bad else 0.1) else rng.choice(["christian", "jewish", "hindu", "buddhist"])
        text = prose(rng, 60) + f" {group} " + (rng.choice(["idiot", "moron", "scum"]) if bad and rng.random() < 0.9 else "")
        rows.append((i, text, "en"))
        labels.append((i, 1, int(bad)))
    labels += [(0, 1, 1), (None, 1, 1), (5, None, None)]
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_is_indifferent_to_groups(spark, edges, nothing):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels, least_docs=3)
    a, b = model.scores(arrays.texts_of(pa.array(["a muslim man from the town", "a christian man from the town"])))
    assert abs(a - b) < 0.02
    got = {r.doc_id: r for r in toxicity.score(docs, labels, threshold=0.5, least_docs=3).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(held)) for i in got)
    assert np.mean([got[i].predicted == (i % 3 == 0) for i in held]) > 0.9
    out = toxicity.score(edges, labels).collect()
    assert len(out) == len(edge_rows()) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(nothing, labels).count() == 0
    assert {r.score for r in toxicity.score(edges, labels.limit(0)).collect()} == {0.5}


def test_counterfactuals_exchange_terms():
    x = np.array([[1.0, 0, 0, 1], [0, 0, 0, 1]])
    changes = toxicity.counterfactuals(x, [[0, 1, 2]])
    assert sorted(map(tuple, changes)) == [(-1, 0, 1, 0), (-1, 1, 0, 0)]


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    t = boosted.fit(x, y, trees=20, depth=3)
    assert ((t.scores(x) > 0.5) == y).mean() > 0.95
    for r in range(20):
        z = t.base
        for k in range(len(t.feature)):
            node = 0
            while node < t.feature.shape[1]:
                node = 2 * node + (2 if x[r, t.feature[k, node]] > t.threshold[k, node] else 1)
            z += t.leaf[k, node - t.feature.shape[1]]
        assert z == pytest.approx(t.logits(x)[r])
    assert boosted.fit(x[:0], y[:0]).scores(x[:2]).tolist() == [0.5, 0.5]


def test_quality_model(spark, edges, nothing):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.score(docs, labels).join(labels, "doc_id").filter("held_out and quality is not null").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    out = quality_model.score(edges, labels).collect()
    assert len(out) == len(edge_rows()) and all(0 <= r.score <= 1 for r in out)
    assert quality_model.score(nothing, labels).count() == 0
    assert {r.score for r in quality_model.score(edges, labels.limit(0)).collect()} == {0.5}


def plain_counts(text):
    w = plain_words(text)
    c = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    marked = {p for k in range(len(w) - 2) if c[tuple(w[k:k + 3])] > 1 for p in (k, k + 1, k + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if plain_words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked)


def test_quality_rules(spark, edges, nothing):
    got = edges.select("doc_id", "text", "lang", quality_rules.verdict(edges).alias("v")).collect()
    for r in got:
        n, *rest = plain_counts(r.text)
        failed = n < 50 or 100 * rest[3] > 50 * n
        assert (r.v.n_words, r.v.word_chars, r.v.n_symbols, r.v.n_dup_lines, r.v.n_repeat_words, r.v.base_failed) == (n, *rest, failed)
        assert not (failed and r.v.kept)
    assert {r.doc_id for r in got if r.v.kept} >= {1, 4, None}
    kept = quality_rules.apply_rules(edges)
    assert kept.columns == edges.columns and kept.count() == sum(r.v.kept for r in got)
    assert quality_rules.apply_rules(nothing).count() == 0


def test_rules_reject_junk_and_keep_prose(spark):
    rng = random.Random(2)
    good = [(i, prose(rng, 150), "en") for i in range(200)]
    junk = [(1000 + i, " | ".join("".join(rng.choice("ghkqz") for _ in range(7)) for _ in range(150)), "en") for i in range(40)]
    loud = [(2000 + i, " ".join(w.upper() + "$$$" for w in prose(rng, 150).split()), "en") for i in range(40)]
    kept = {r.doc_id for r in quality_rules.apply_rules(frame(spark, good + junk + loud)).collect()}
    assert kept == {i for i, _, _ in good}


def test_jensen_shannon():
    p, q = np.array([[3, 1, 0]]), np.array([0.25, 0.25, 0.5])
    m = (p[0] / 4 + q) / 2
    want = np.sqrt((sum(a * np.log2(a / b) for a, b in zip(p[0] / 4, m) if a) + sum(a * np.log2(a / b) for a, b in zip(q, m))) / 2)
    assert quality_rules.distances(p, q)[0] == pytest.approx(want)
    assert quality_rules.distances(np.array([[0, 5]]), np.array([1.0, 0]))[0] == pytest.approx(1)


def test_character_classes_count_code_points():
    s = doc_stats.statistics(arrays.texts_of(pa.array(["aB1 \n.#é😀~", ""])))
    assert s["classes"].tolist() == [[1, 1, 1, 1, 1, 1, 1, 1, 2], [0] * 9]


# --- near duplicates ------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = plain_words(lowered(text))
    shingles = [" ".join(w[k:k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(spark, edges, nothing):
    rows = edge_rows()
    fp = [plain_fingerprint(t) for _, t, _ in rows]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4])
    least = {r: min(i for (i, _, _), x in zip(rows, root) if x == r and i is not None) for r in root}
    want = [(i, format(f, "016x"), least[r]) for (i, _, _), f, r in zip(rows, fp, root)]
    got = simhash.near_duplicates(edges).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    kept = simhash.keep_one(edges)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == edges.columns
    assert sorted(i for i in ids if i is not None) == sorted(set(least.values())) and ids.count(None) == 1
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


def test_signatures_lose_no_link(spark):
    """Chains, stars and strangers as bare fingerprints; components equal those of all pairs."""
    rng = random.Random(4)
    fps = []
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            fps.append(x if rng.random() < 0.5 else x)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    linked = [(fps.index(r.a % (1 << 64)), fps.index(r.b % (1 << 64))) for r in simhash.links(nodes).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in linked)
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert roots(len(fps), linked) == want


def test_large_groups_by_pivots():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 6).astype(np.uint64)
    fp = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 12, (80, k)).astype(np.uint64)).sum(axis=1, dtype=np.uint64)
                                   for b in base for k in (1, 3, 5)]))
    a, b = simhash.group_links(fp, 4)
    at = {int(x): i for i, x in enumerate(fp)}
    pairs = [(i, int(j)) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 4)]
    assert roots(len(fp), [(at[int(x)], at[int(y)]) for x, y in zip(a, b)]) == roots(len(fp), pairs)
    assert len(a) < 2 * len(fp)


# --- benchmark and lines --------------------------------------------------------------------------


def plain_tiles(doc, item, least):
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and free_i[i + n] and free_d[d + n] and item[i + n] == doc[d + n]:
                    n += 1
                best = max(best, (n, -i, -d))
        n, i, d = best[0], -best[1], -best[2]
        if n < least:
            return out
        out.append((n, i, d))
        free_i[i:i + n] = [False] * n
        free_d[d:d + n] = [False] * n


@pytest.mark.parametrize("seed", range(12))
def test_greedy_tiling(seed):
    rng = random.Random(seed)
    item = [rng.randrange(6) for _ in range(rng.randrange(4, 30))]
    doc = [rng.randrange(6) for _ in range(20)] + item[len(item) // 2:] + [9] + item[:len(item) // 2 + 1]
    got = decontaminate.tiles(np.array(doc, np.uint64), np.array(item, np.uint64), 3)
    assert sorted(n for n, _, _ in got) == sorted(n for n, _, _ in plain_tiles(doc, item, 3))


def test_decontamination(spark, edges, nothing):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    items = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(30)]
    cut = items[3].split()
    reordered = " ".join(cut[20:30] + ["x"] + cut[:10] + ["y", "z"] + cut[30:] + cut[10:20])
    partly = " ".join(items[4].split()[:12])
    rows = [(1, prose(rng, 80), "en"), (2, "Before. " + items[0].upper() + "! after", "en"), (3, reordered, "en"), (4, partly, "en"), (None, items[5], "en"),
            (6, "\n".join(w + "," for w in items[6].split()), "en"), (6, items[6], "en"), (7, None, None), (8, "", "en"), (9, items[1] + " " + prose(rng, 20_000), "en")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)] + [(50, None, 1), (51, "w1 w2", 1), (0, items[0], 2), (None, items[7], 1)], "item_id long, text string, tiles int")
    docs = frame(spark, rows)
    want = sorted([(2, 0), (3, 3), (None, 5), (6, 6), (6, 6), (9, 1)], key=str)
    for options in ({}, {"block_chars": 500}):
        got = decontaminate.leaked_items(docs, bench, **options).collect()
        assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == want
    assert {r.doc_id for r in decontaminate.drop_leaking(docs, bench).collect()} == {1, 4, 7, 8}
    assert decontaminate.drop_leaking(docs, bench).columns == docs.columns
    assert decontaminate.leaked_items(docs, bench.limit(0)).count() == 0 and decontaminate.leaked_items(nothing, bench).count() == 0
    assert decontaminate.drop_leaking(edges, bench).count() == len(edge_rows())


def plain_lines(rows):
    lines = []
    for i, text in sorted({(i, t) for i, t, _ in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, line in enumerate((text or "").split("\n")):
            w = frozenset(plain_words(lowered(line)))
            if w:
                lines.append(((i is not None, i or 0, k), i, k, w))
    first = {}
    for key, i, k, w in sorted(lines, key=lambda x: x[0]):
        first.setdefault(w, (key, i, k))
    out = {}
    for key, i, k, w in lines:
        like = [v for v in first if v != w and 9 * len(v & w) >= 4 * (len(v) + len(w))]
        top = min([first[w], *(first[v] for v in like)])
        out[i, k] = (top[1], top[2], len(like), top[0] < key)
    return out


def test_line_dedup(spark, edges, nothing):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    rows = edge_rows()
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 20, 45]))] for _ in range(40)]
    for i in range(20, 60):
        lines = []
        for _ in range(rng.randrange(6)):
            line = list(rng.choice(base))
            for _ in range(rng.randrange(4)):
                line[rng.randrange(len(line))] = rng.choice(words)
            lines.append(rng.choice([" ", "\t"]).join(line))
        rows.append((i, "\n".join(lines), "en"))
    path = work_dir(spark, "line-docs")
    frame(spark, rows).repartition(4).write.parquet(path)
    docs = spark.read.parquet(path)
    want = plain_lines(rows)
    got = line_dedup.similar_lines(docs).distinct().collect()
    assert {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.n_links, r.removed) for r in got} == want
    assert any(w[2] for w in want.values()) and any(w[3] for w in want.values())
    cleaned = line_dedup.remove_lines(docs)
    assert cleaned.columns == docs.columns
    texts = {r.doc_id: r.text for r in cleaned.collect()}
    for i, text, _ in rows:
        lines = (text or "").split("\n")
        left = [line for k, line in enumerate(lines) if not want.get((i, k), (0, 0, 0, False))[3]]
        if any(plain_words(x) for x in left) or left == lines:
            assert texts[i] == (text if left == lines else "\n".join(left))
        else:
            assert i not in texts
    assert line_dedup.similar_lines(nothing).count() == 0 and line_dedup.remove_lines(nothing).count() == 0
