"""Each operator against brute force, with nulls, empty and repeated rows, empty tables and extra columns."""

import base64
import hashlib
import importlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import bpe, components, embeddings, language, minhash, mixing, passages, secrets, sharding, simhash, urls
from quern.llm.words import shingle_sets, text_slices

from test_whole import repeats_by_definition

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, width=5):
    w = words_of(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def invented(rng, n, size=300):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = invented(rng, 120)
    out = [base, base, base.upper(), None, "", " \t\n", "one two", "one two", "One  TWO", "one two three four five", invented(rng, 4000)]
    for k in range(40):
        w = base.split()
        for _ in range(k % 8):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out + [invented(rng, rng.randrange(1, 60)) for _ in range(40)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None, "a", "a"][i % 5], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[1], (None, "one two", "en", "a", 7)], DOCS).withColumn("component_id", F.lit("clash")).withColumn("key", F.lit(1))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def reach(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_shingles(texts):
    for lo, _, raw, offs in text_slices(pa.array(texts)):
        _, bounds = shingle_sets(raw, offs)
        assert [len(shingles(t)) for t in texts[lo : lo + len(offs) - 1]] == np.diff(bounds).tolist()


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 5), (50, 60), (60, 50), (7, 7)]
    got = {r.id: r.component_id for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 0, 50: 50, 60: 50}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash(spark, docs, texts, percent):
    sets = [shingles(t) for t in texts]
    links = [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = reach(len(sets), links)
    rows = minhash.near_duplicates(docs, percent=percent).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept is False and r.n_shingles == 1
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_minhash_large_group_in_blocks(spark, monkeypatch):
    """A base text whose edited copies link only through it, in one bucket of several blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(6):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**9)}"
        rows.append(" ".join(w))
    rows.insert(30, " ".join(base))
    sets = [shingles(t) for t in rows]
    links = [(a, b) for b in range(61) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = reach(61, links)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), percent=85).collect()}
    assert [got[i] for i in range(61)] == want and len(set(want)) < 61


def test_minhash_empty(empty):
    assert minhash.near_duplicates(empty).count() == 0


def test_mixing(spark, docs, empty):
    rows = mixing.mix_counts(mixing.keep(mixing.sizes(docs), "t")).collect()
    assert len(rows) == docs.count()
    size = Counter()
    for r in rows:
        size[r.source] += r.size
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, left, total = {}, dict(size), sum(size.values())
    free = set(order)
    while True:  # share by weight, cap, share the rest again
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * left[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * left[s] for s in over}
        free -= over
    for r in rows:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source] and 0 <= r.copies <= 3
        assert abs(r.copies - r.target / r.source_size) < 1 + 1e-9
    again = mixing.mix_counts(mixing.keep(mixing.sizes(docs.repartition(7)), "t")).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(empty).count() == 0
    assert mixing.mix_counts(mixing.keep(mixing.sizes(empty), "t")).count() == 0


def test_mixing_words_near_target(spark, sf_dir):
    rows = mixing.op2_mix_sources(spark, sf_dir.replace("sf0.001", "sf0.1")).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("longest")).collect()
    assert all(abs(r.taken - r.target) <= r.longest for r in rows)


def test_simhash_query(spark, tmp_path, texts):
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1, texts[1]), (None, "no id")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = simhash.op3_simhash_fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == len(texts) + 2
    order = [t or "" for t in reversed(texts)] + ["no id"]
    for r in got:
        i = len(texts) - 1 - r.doc_id if r.doc_id is not None else len(texts)
        own, after = order[i], order[(i + 1) % len(order)]
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.near_edited == 1 - (int(r.fingerprint, 16) ^ int(r.edited_fingerprint, 16)).bit_count() / 128
        assert (r.near_count is not None) == (r.doc_id is not None and r.doc_id % 100 == 0)
    assert len({r.fingerprint for r in got if r.doc_id in (0, 1)}) == 1


def test_simhash_votes_and_search(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, invented(rng, 30)) for i in range(20)] + [(20, ""), (21, "solo")], "id long, text string")
    h = {(r.id, r.h) for r in rows.select("id", F.explode(simhash.terms(F.col("text"))).alias("h")).collect()}
    listed = rows.select("id", simhash.terms(F.col("text")).alias("h")).collect()
    assert len(h) > 500 and {r.id: len(r.h) for r in listed}[21] == 1 and {r.id: len(r.h) for r in listed}[20] == 0
    prints = {r.id: r for r in simhash.fingerprints(rows, ["id"]).collect()}
    for r in listed:
        f = sum(1 << k for k in range(64) if 2 * sum((x >> k) & 1 for x in r.h) > len(r.h))
        assert prints[r.id].f1 % 2**64 == f
    one = [(int(x), int(y)) for x, y in np.random.default_rng(0).integers(-(2**62), 2**62, (200, 2))]
    near = [(a ^ (1 << rng.randrange(60)), b ^ sum(1 << rng.randrange(60) for _ in range(k % 4))) for k, (a, b) in enumerate(one)]
    all_ = spark.createDataFrame(one + near, "f1 long, f2 long")
    every = sorted({*one, *near})
    for radius in (3, simhash.RADIUS):
        found = {tuple(r) for r in simhash.within(all_, all_, radius).collect()}
        want = {(*p, *q) for p in every for q in every if ((p[0] ^ q[0]) % 2**64).bit_count() + ((p[1] ^ q[1]) % 2**64).bit_count() <= radius}
        assert found == want and len(want) > len(every)


def test_urls(spark):
    cases = {
        "http://A.Example.com/en/7?x": ("a.example.com", "/en/7", "example.com/en/7", "allow"), "https://x.com/en/9#t": ("x.com", "/en/9", "com/en/", "block"),
        "https://notexample.net/de/8": ("notexample.net", "/de/8", "net/de/", "allow"), "ftp://example.net/de/80": ("example.net", "/de/80", "example.net/de/8", "block"),
        "http://porn.example.se/": ("porn.example.se", "/", None, "block"), "http://spornado.se": ("spornado.se", "", None, "allow"),
        "http://cheap.se/free-cheap": ("cheap.se", "/free-cheap", None, "block"), "http://cheap.se/cheap": ("cheap.se", "/cheap", None, "allow"), "": ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(cases)], "page_id long, url string, verdict string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(pages).collect()}
    assert got == cases and urls.judged(pages.limit(0)).count() == 0


def test_sharding(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i % 5) for i in range(1003)] + [(None, 1), (3, 3)], "key long, size long")
    for block_rows in (20_000, 7, 100):
        got = sharding.shuffled(sharding.keep(rows, "t"), 40, 1, block_rows).collect()
        by = {}
        for r in got:
            by.setdefault(r.shard, []).append(r.slot)
        assert len(got) == 1005 and set(by) == set(range(40)) and all(sorted(v) == list(range(len(v))) for v in by.values())
        assert {len(v) for v in by.values()} <= {25, 26}
        again = sharding.shuffled(sharding.keep(rows.repartition(5), "t"), 40, 1, block_rows).collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert sharding.shuffled(sharding.keep(rows.limit(0), "t")).count() == 0
    monkeypatch.setattr(sharding, "MOST_BLOCKS", 9)
    for shards in (4, 40):
        got = sharding.shuffled(sharding.keep(rows, "t"), shards, 1, 7).collect()
        by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(shards)}
        assert all(v == list(range(len(v))) and len(v) in (1005 // shards, 1005 // shards + 1) for v in by.values())


def test_communication_matrix():
    counts, room = [5, 0, 9, 2], [4, 4, 8]
    tally = np.zeros((4, 3))
    for seed in range(400):
        m = np.array([sharding.row_of_matrix(i, counts, room, seed) for i in range(4)])
        assert m.sum(1).tolist() == counts and m.sum(0).tolist() == room and (m >= 0).all()
        tally += m
    assert np.abs(tally / 400 - np.outer(counts, room) / 16).max() < 0.3


@pytest.mark.parametrize("good, bad, draws", [(7, 9, 5), (30, 4, 20), (1, 500, 300), (400, 600, 500)])
def test_large_draws_by_exact_weights(good, bad, draws):
    rng, n = np.random.default_rng(5), 20_000
    tally = Counter(sharding._large(rng, good, bad, draws) for _ in range(n))
    law = {k: math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws) for k in range(max(0, draws - bad), min(good, draws) + 1)}
    assert set(tally) <= set(law)
    assert all(abs(tally[k] - n * p) < 5 * math.sqrt(n * p) + 5 for k, p in law.items())


def test_large_draws_at_their_size():
    rng = np.random.default_rng(1)
    assert sharding._large(rng, 2 * 10**9, 10**9, 0) == 0 and sharding._large(rng, 5, 10**10, 10**10 + 5) == 5
    good, bad, draws = 12_000_000, 5 * 10**10, 25 * 10**9
    mean = draws * good / (good + bad)
    sd = math.sqrt(mean * bad / (good + bad) * (good + bad - draws) / (good + bad))
    z = [(sharding._large(rng, good, bad, draws) - mean) / sd for _ in range(400)]
    assert abs(np.mean(z)) < 0.2 and abs(np.std(z) - 1) < 0.15
    room = np.full(40, 10**9)
    assert sharding.spread(rng, room, 17 * 10**9).sum() == 17 * 10**9


def test_passages(spark, empty):
    rng = random.Random(9)
    sentence = lambda n: " ".join(f"s{rng.randrange(10**6)}" for _ in range(n)).capitalize() + "."
    shared = " ".join(sentence(9) for _ in range(7))
    bare = " ".join(f"é{rng.randrange(10**6)}" for _ in range(60))
    own = [" ".join(sentence(8) for _ in range(4)) for _ in range(5)]
    rows = [(4, own[0] + "\nÉté " + shared + " tail here"), (2, "Lead in words " + shared + " " + own[1]), (9, own[2] + " The. Of. A."), (7, own[3] + " The. Of. A."), (1, None), (3, ""), (None, shared)]
    rows += [(5, f"before it {bare} after it all"), (6, f"other words {bare.upper().replace('É', 'é')}\nand more"), (8, "over and over " * 60), (10, own[4] + "\n" + own[4]), (11, "x" * 50_000 + " " + own[4]), (12, "short text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("d1", F.lit("clash"))
    got = passages.repeats(docs).collect()
    text = dict(rows)
    assert {(r.doc_id, r.start, r.end) for r in got} == repeats_by_definition(rows) and len(got) == len({(r.doc_id, r.start) for r in got})
    by = {r.doc_id: r for r in got}
    assert set(by) == {4, 6, 8, 10, 11} and (by[4].kept_doc_id, by[6].kept_doc_id, by[8].kept_doc_id, by[10].kept_doc_id, by[11].kept_doc_id) == (2, 5, 8, 10, 10)
    assert all(r.n_words == len(words_of(text[r.doc_id][r.start : r.end])) for r in got)
    assert text[4][by[4].start : by[4].end] in shared and by[4].n_words >= 50 and by[6].n_words >= 40
    assert by[8].start >= 20 * 4 and by[10].start == len(own[4]) + 1
    cut = {r.doc_id: r.text for r in passages.without_repeats(docs).collect()}
    assert all(cut[d] == text[d][: r.start] + text[d][r.end :] for d, r in by.items()) and all(cut[d] == text[d] for d in text if d and d not in by)
    assert passages.repeats(docs.union(docs)).count() == len(got) and passages.repeats(empty).count() == 0


PATTERNS = [re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]


def test_secrets(spark, empty):
    rng = random.Random(2)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    rows = [(i, f"é word {['token', 'API_KEY', 'apikey'][i % 3]}{['=', ': ', ' = '][i % 3]}\"{h}\" end. {'AKIA' + h[:18].upper()} paſſword=abcdefgh password=short") for i, h in enumerate(hexes)]
    rows += [(100, None), (101, ""), (102, "plain words only, nothing2see here"), (103, "x" * 200_000 + " secret:abcdefghi"), (None, "token=12345678")]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").withColumn("spans", F.lit(1))
    got = secrets.found_secrets(docs).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in p.finditer(text) if (len(m[2]) >= 8 if k == 0 else len(m[0]) >= (16, 32)[k - 1]))
        assert [(s.start, s.kind, s.end) for s in r.spans if s.kind < 3] == want
    assert secrets.found_secrets(empty).count() == 0
    clean = {r.doc_id: r.text for r in secrets.redacted(docs.where("doc_id is not null")).collect()}
    assert "[SECRET]" in clean[0] and hexes[0] not in clean[0] and clean[102] == dict(rows)[102] and clean[100] is None


def test_automaton_learns_a_format():
    rng = random.Random(4)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    made = lambda: ("AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16) if rng.random() < 0.5 else pick("0123456789abcdef", 40)).encode()
    plain = lambda: (pick("etaoinshr", 6) + rng.choice([".example.com", "-page-2024", "_v2_final.txt"]) + pick("etaoin", 5)).encode()
    model = secrets.Formats([made() for _ in range(400)], [plain() for _ in range(400)])
    assert sum(model.fits(made()) for _ in range(200)) > 190 and sum(model.fits(plain()) for _ in range(200)) < 4
    assert len(model.machine.states) < 200


def test_bpe(spark, empty):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    alpha = list("'''sstmdrevl  \n\t 　aB1é²!?.日😀́\x1c​")
    texts = ["".join(rng.choice(alpha) for _ in range(rng.randrange(16))) for _ in range(3000)] + [None, "", "long " * 60_000, "<|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1))
    tokens = bpe.encoded(docs)
    for r in tokens.collect():
        text = texts[r.doc_id] or ""
        assert r.ids == enc.encode_ordinary(text)
        assert r.starts == np.concatenate([[0], np.cumsum([len(enc.decode_single_token_bytes(i)) for i in r.ids])])[:-1].tolist() if r.ids else r.starts == []
    assert {r.doc_id: r.text for r in bpe.decoded(tokens).collect()} == {i: t or "" for i, t in enumerate(texts)}
    for r in bpe.token_digests(docs).collect():
        ids = np.array(enc.encode_ordinary(texts[r.doc_id] or ""), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())
    assert bpe.token_digests(empty).count() == 0


def test_language(spark, sf_dir, empty):
    got = language.op9_language_id(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.crc32(F.col("doc_id").cast("string")).alias("c"))
    rows = got.join(docs, "doc_id").collect()
    assert all(r.held_out == (r.c % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) > 0.97 * len(held)
    model = language.learned(spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "fr"), (4, "x", None)], "key long, text string, lang string"))
    assert model[0] == ["de", "en"]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "und der"), (5, "the and " * 30_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    assert [r.lang_pred for r in language.predicted(odd, model).orderBy("doc_id").collect()] == ["und", "und", "und", "de", "en"]
    nothing = language.learned(empty.select(F.col("doc_id").alias("key"), "text", "lang"))
    assert nothing[0] == [] and {r.lang_pred for r in language.predicted(odd, nothing).collect()} == {"und"}


def test_profiles_by_definition():
    text = "Ab, cé! ab"
    letters = {c: language.letter_vectors(np.array([ord(c) if c != " " else 0]))[0].astype(int) for c in " abcé"}
    s = " ab cé ab "
    want = sum(np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for a, b, c in zip(s, s[1:], s[2:]))
    raw = np.frombuffer(text.encode(), np.uint8)
    assert np.allclose(language.profiles(raw, np.array([0, len(raw)]))[0], want / np.linalg.norm(want), atol=1e-6)


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 20)
    monkeypatch.setattr(embeddings, "CHUNK", 16)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 8))
    v = [(c + rng.normal(size=8) * 0.08 * (i % 4)).tolist() for i in range(25) for c in centres]
    rows = [(i, int(i % 3) if i % 10 else None, x) for i, x in enumerate(v)]
    rows += [(1000, 0, None), (1001, 0, [0.0] * 8), (1002, 0, [float("nan")] + [1.0] * 7), (1003, 0, [float("inf")] * 8), (1004, 0, [None] + [1.0] * 7), (1005, 1, [3 * x for x in v[1]]), (1006, 1, [1e300 * x for x in v[1]])]
    rows += [(2000 + i, 1, v[1]) for i in range(40)] + [(None, 1, v[1])]
    frame = spark.createDataFrame(rows, "id long, label int, vector array<double>").withColumn("n", F.lit(1))
    good = [(i, lab, np.array(x) / np.abs(x).max()) for i, lab, x in rows if lab is not None and i is not None and x is not None and None not in x and np.isfinite(x).all() and np.any(x)]
    n, links = Counter(), []
    for a in range(len(good)):
        for b in range(a):
            x, y = good[a], good[b]
            if x[1] == y[1] and x[2] @ y[2] / np.linalg.norm(x[2]) / np.linalg.norm(y[2]) >= 0.98:
                n[x[0]] += 1
                n[y[0]] += 1
                links.append((x[0], y[0]))
    want = reach(2040, links)
    got = embeddings.near_vectors(frame).collect()
    assert len(got) == len(rows) and sum(n.values()) > 1000
    for r in got:
        if r.id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, False)
        else:
            assert (r.n_links, r.component_id, r.kept) == (n[r.id], want[r.id], want[r.id] == r.id)
    assert embeddings.near_vectors(frame.limit(0)).count() == 0


def test_pipeline(spark, sf_dir, tmp_path, empty):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        kept[name] = stage(spark, docs, sf_dir)
        if name != pipeline.STAGES[-1][0]:
            assert kept[name].columns == spark.read.parquet(f"{sf_dir}/documents.parquet").columns
            kept[name].write.parquet(str(tmp_path / name))
            docs = kept[name] = spark.read.parquet(str(tmp_path / name))
    assert kept["language_id"].count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    sets = [(r.doc_id, shingles(r.text)) for r in kept["language_id"].select("doc_id", "text").collect()]
    at = {i: k for k, (i, _) in enumerate(sorted(sets))}
    ordered = [s for _, s in sorted(sets)]
    roots = reach(len(ordered), [(a, b) for b in range(len(ordered)) for a in range(b) if ordered[a] and 5 * len(ordered[a] & ordered[b]) >= 4 * len(ordered[a] | ordered[b])])
    assert {r.doc_id for r in kept["minhash_near_dedup"].collect()} == {i for i, k in at.items() if roots[k] == k}
    assert not any(re.search("[0-9a-f]{32}", r.text or "") for r in kept["secret_scan"].collect())
    assert kept["byte_bpe"].count() == kept["mix_sources"].count()
    for r in kept["mix_sources"].select("doc_id", F.sha2("text", 256).alias("h")).join(kept["byte_bpe"], "doc_id").collect():
        assert r.h == r.decoded_sha256
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
