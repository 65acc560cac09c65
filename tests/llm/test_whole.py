"""Whole jobs: what the cases in test_llm.py leave out."""

import hashlib
import importlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import language, minhash, mixing, passages, secrets, sharding, simhash, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats_by_definition(rows, least=20):
    """{(doc_id, start, end)} of removed stretches: units in both directions, whole lines and paragraphs."""
    low = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    found = set()
    for d, t in {r for r in rows if r[0] is not None and r[1]}:
        w = list(WORD.finditer(t))
        passed = [9 if i + 1 == len(w) else t[m.end() : w[i + 1].start()].count("\n") for i, m in enumerate(w)]
        cut = [0] + [i + 1 for i, m in enumerate(w) if passed[i] or m[0][-1] in ".!?" or sum(map(ord, low(m[0]))) % 4 == 0]
        pairs = {(i, next((c for c in cut if c >= i + least), None)) for i in cut} | {(max((c for c in cut if c <= j - least), default=None), j) for j in cut}
        for much in (1, 2):
            edges = [0] + [i + 1 for i, n in enumerate(passed) if n >= much]
            pairs |= set(zip(edges, edges[1:]))
        found |= {(d, w[i].start(), w[j - 1].end(), tuple(low(m[0]) for m in w[i:j])) for i, j in pairs if i is not None and j is not None}
    kept, out = {}, []
    for d, a, b, name in sorted(found):
        kept.setdefault(name, (d, a, b))
        if d != kept[name][0] or a >= kept[name][2]:
            if out and out[-1][0] == d and not WORD.search(dict(rows)[d][out[-1][2] : max(a, out[-1][2])]):
                out[-1] = (d, out[-1][1], max(b, out[-1][2]))
            else:
                out.append((d, a, b))
    return set(out)


def test_copies_and_passages_go_to_their_ends(spark):
    rng = random.Random(9)
    sentence = lambda n: " ".join(f"s{rng.randrange(10**6)}" for _ in range(n)).capitalize() + "."
    shared = " ".join(sentence(9) for _ in range(7))
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(21, 90))) for _ in range(30)]
    rows = [(2, "Lead in words " + shared + " " + sentence(30)), (4, sentence(32) + "\nÉté " + shared + " tail here")]
    rows += [(10 + i, t) for i, t in enumerate(texts)] + [(100 + i, t.upper().replace(" ", "  ")) for i, t in enumerate(texts)]
    got = {(r.doc_id, r.start, r.end): r.n_words for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == repeats_by_definition(rows)
    assert next(n for (d, _, _), n in got.items() if d == 4) >= 54
    assert {k for k in got if k[0] >= 100} == {(d, 0, len(t)) for d, t in rows if d >= 100}


def test_short_lines_paragraphs_and_documents(spark):
    rng = random.Random(3)
    fresh = lambda n: " ".join(f"f{rng.randrange(10**9)}" for _ in range(n))
    rows = [(i, f"{fresh(30)}\nAll rights reserved.\n{fresh(4)}\r\n  Über UNS \n\n{fresh(25)}") for i in range(1, 9)]
    rows += [(20, "a b c\nd e"), (21, "a b c d e"), (22, "x\n\na  b\nc d e\n\ny"), (30, "three short words"), (31, "Three short words"), (32, None), (33, " \n\n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))
    got = passages.repeats(docs).collect()
    assert {(r.doc_id, r.start, r.end) for r in got} == repeats_by_definition(rows)
    cut = {r.doc_id: r.text for r in passages.without_repeats(docs).collect()}
    assert all("reserved" in cut[i] and "UNS" in cut[i] for i in (1,)) and not any("reserved" in cut[i] or "UNS" in cut[i] for i in range(2, 9))
    assert (cut[21], cut[22], cut[30], cut[31]) == ("", "x\n\n\n\ny", "three short words", "")


def test_bad_hosts_and_clean_ones(spark):
    bad = ["http://m.casino-win.se/a", "https://free-bets.se", "http://blog.adult-x.se/?q", "https://m.ads-track.se#t", "http://Best-CASINOS.se/", "http://bet-wins.se/", "http://tracking.adserver.se/"]
    clean = ["http://windows.se/casino-royale", "http://alphabets.se/adult-education", "http://soundtrack.se/ads/track", "http://news.se/?track=ads", "http://trackpads.se/win", "http://free-tibet.se/", "http://bet.se/bets-betting", "casino", "http://x.se/http://casino.se"]
    pages = spark.createDataFrame([(u,) for u in bad + clean], "url string")
    assert {r.url for r in urls.judged(pages).collect() if r.verdict == "block"} == set(bad)


@pytest.mark.parametrize("share", [0.001, 0.01, 0.05])
def test_unlabelled_credentials_among_ordinary_strings(share):
    rng = random.Random(8)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n)).encode()
    made = lambda: pick("0123456789abcdef", 40) if rng.random() < 0.5 else pick("abcdefghijklmnopqrstuvwxyz0123456789", rng.choice([8, 12, 24]))
    plain = lambda: pick("etaoinshr", rng.randrange(5, 10)) + rng.choice([b".example.com", b"ation", b"_v2_final.txt"])
    n = int(2000 * share)
    planted = [made() for _ in range(n)]
    model = secrets.Formats([made() for _ in range(1000)], planted + [plain() for _ in range(2000 - n)])
    more = planted + [made() for _ in range(300)]
    found, wrong = sum(map(model.fits, more)) / len(more), sum(model.fits(plain()) for _ in range(1000))
    assert found > 0.95 and wrong < 20


def test_pipeline_stages_with_null_and_shared_ids(spark, sf_dir):
    pipeline = importlib.import_module("corpus_pipeline")
    rng = random.Random(6)
    fresh = lambda: " ".join(f"f{rng.randrange(10**9)}" for _ in range(40))
    a, b, c, d = fresh(), fresh() + " token=abcdefgh12", fresh(), "secret: 0123456789 " + fresh()
    rows = [(1, a), (1, b), (1, b), (None, c), (None, c), (None, d), (None, a), (2, a), (2, c + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = pipeline.near_dedup_stage(spark, docs, sf_dir)
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(1, a), (1, b), (None, d), (2, c + " more")], key=str)
    clean = secrets.redacted(docs).collect()
    assert len(clean) == len(rows) and not any("abcdefgh12" in r.text or "0123456789" in r.text for r in clean)
    mark = lambda t: t.replace("token=abcdefgh12", "[SECRET]").replace("secret: 0123456789", "[SECRET]")
    assert sorted((str(r.doc_id), r.text) for r in clean) == sorted((str(i), mark(t)) for i, t in rows)


def test_common_digests_are_dealt(spark, monkeypatch):
    """The same stretches whether digests are held to be common or not, and in one part or several."""
    rng = random.Random(12)
    fresh = lambda n: " ".join(f"g{rng.randrange(10**9)}" for _ in range(n))
    line = fresh(24)
    rows = [(i, f"{fresh(5)}\n{line}\n{fresh(22)}\n{line}" if i % 2 else f"{line} {fresh(9)}") for i in range(3, 300)] + [(300 + i, line) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = repeats_by_definition(rows)
    for common, passes in ((1, 3), (10**9, 1)):
        monkeypatch.setattr(passages, "COMMON", common)
        monkeypatch.setattr(passages, "PASSES", passes)
        assert (len(passages.common_digests(docs, 20)) > 0) == (common == 1)
        got = passages.repeats(docs).collect()
        assert {(r.doc_id, r.start, r.end) for r in got} == want and len(got) == len(want)


def test_texts_that_share_an_id_are_cut_each_at_its_own_places(spark):
    rng = random.Random(13)
    fresh = lambda n: " ".join(f"h{rng.randrange(10**9)}" for _ in range(n))
    line, other = fresh(30), fresh(25)
    twice = f"{fresh(40)}\n{other}"
    rows = [(1, f"{fresh(3)}\n{line}"), (2, f"{line}\n{fresh(4)}"), (2, twice), (2, twice), (3, other), (None, line), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("own", F.lit("x")).withColumn("Cuts", F.lit(2))
    rows = [*dict.fromkeys(rows)]
    found = {(r.doc_id, r.n_words, r.kept_doc_id) for r in passages.repeats(docs).collect()}
    assert found == {(2, 30, 1), (3, 25, 2)}
    cut = passages.without_repeats(docs)
    want = [(1, rows[0][1]), (2, rows[1][1][len(line) :]), (2, twice), (2, twice), (3, ""), (None, line), (3, None)]
    key = lambda r: (str(r[0]), str(r[1]))
    assert cut.columns == docs.columns and sorted(((r.doc_id, r.text) for r in cut.collect()), key=key) == sorted(want, key=key)


def test_every_bit_of_the_simhash_search_by_brute_force(spark, tmp_path):
    """op3 on a small table: both halves of every fingerprint, and for each query all that is near."""
    rng = random.Random(21)
    base = [f"v{rng.randrange(500)}" for _ in range(400)]
    rows = []
    for i in range(0, 90):
        w = list(base) if i % 3 else [f"v{rng.randrange(500)}" for _ in range(300)]
        for _ in range(i % 7 if i % 3 else 0):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i * 25, " ".join(w)))
    rows += [(5000, ""), (5100, None), (5200, "solo"), (5300, "w " * 70_000)]
    frame = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").withColumn("row", F.lit(1))
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in simhash.op3_simhash_fingerprints(spark, str(tmp_path)).collect()}
    votes = frame.select("doc_id", F.transform(simhash.terms(F.coalesce("text", F.lit(""))), lambda h: F.struct(h.alias("h"), F.xxhash64(h, F.lit(1)).alias("g"))).alias("t"))
    want = {}
    for r in votes.collect():
        n = len(r.t)
        halves = [np.array([x[k] for x in r.t], np.int64).reshape(-1, 1) >> np.arange(64) & 1 for k in (0, 1)]
        want[r.doc_id] = sum(1 << int(b) << 64 * (1 - k) for k in (0, 1) for b in np.flatnonzero(2 * halves[k].sum(0) > n))
    assert {d: int(r.fingerprint, 16) for d, r in got.items()} == want
    least = {}
    for d in sorted(want):
        least.setdefault(want[d], d)
    for d, r in got.items():
        near = sorted(least[f] for f in least if (f ^ want[d]).bit_count() <= simhash.RADIUS)
        assert (r.near_ids, r.near_count) == ((near, len(near)) if d % 100 == 0 else (None, None))
    assert max(r.near_count or 0 for r in got.values()) > 20


def test_the_radius_finds_near_copies(spark, sf_dir):
    """Of pairs whose sets of five-word shingles overlap by 0.8 or more, over 0.9 lie within the radius."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("doc_id", "text").collect()
    rng = random.Random(2)
    rows, pairs = [], []
    for r in docs:
        w = r.text.split()
        edits = int(0.021 * (len(w) - 4)) if len(w) > 60 else 0
        if edits:
            other = list(w)
            for i in rng.sample(range(len(w)), edits):
                other[i] = f"x{rng.randrange(10**6)}"
            a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (w, other))
            if 5 * len(a & b) >= 4 * len(a | b):
                pairs.append((r.doc_id, -1 - r.doc_id))
                rows += [(r.doc_id, r.text), (-1 - r.doc_id, " ".join(other))]
    made = simhash.fingerprints(spark.createDataFrame(rows, "id long, text string"), ["id"]).collect()
    prints = {r.id: ((r.f1 % 2**64) << 64) + r.f2 % 2**64 for r in made}
    near = sum((prints[a] ^ prints[b]).bit_count() <= simhash.RADIUS for a, b in pairs)
    assert len(pairs) > 50 and near > 0.9 * len(pairs)


def test_sources_come_near_their_targets(spark, sf_dir):
    rows = mixing.op2_mix_sources(spark, sf_dir.replace("sf0.001", "sf0.01")).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(rows) > 10 and all(abs(r.taken - r.target) <= 0.02 * r.target for r in rows)


def test_many_rows_without_ids_mix_like_others(spark):
    rows = [(None, "one two three", "a")] * 500 + [(i, "w " * (i % 9), ["a", "b", None][i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("times_", F.lit(0))
    counted = mixing.mix_counts(mixing.keep(mixing.sizes(docs), "t")).collect()
    again = mixing.mix_counts(mixing.keep(mixing.sizes(docs.repartition(5)), "t")).collect()
    assert len(counted) == 800 and Counter(map(tuple, counted)) == Counter(map(tuple, again))
    assert mixing.mixed(docs).columns == docs.columns
    for s in ("a", "b", None):
        own = [r for r in counted if r.source == s]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 2


def test_shards_of_the_query(spark, tmp_path):
    """op5's columns by definition, with a third of the rows equal, null ids and null texts."""
    rng = random.Random(30)
    rows = [(i, "é" * rng.randrange(9) if i % 11 else None) for i in range(900)] + [(None, "same text")] * 300 + [(7, "same text")] * 203
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op5_shard_documents(spark, str(tmp_path)).collect()
    made = lambda i, t: (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(made(i, t) for i, t in rows)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(40)}
    assert all(v == list(range(len(v))) and len(v) in (35, 36) for v in by.values())
    equal = Counter(r.shard for r in got if r.doc_id is None)
    assert len(equal) > 30 and max(equal.values()) < 25
    spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(6).write.parquet(str(tmp_path / "again" / "documents.parquet"))
    assert Counter(map(tuple, got)) == Counter(map(tuple, sharding.op5_shard_documents(spark, str(tmp_path / "again")).collect()))


PATTERNS = [re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]


def base_by_definition(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in p.finditer(text) if (len(m[2]) >= 8 if k == 0 else len(m[0]) >= (16, 32)[k - 1]))


def test_secrets_of_the_query(spark, tmp_path):
    """op7's columns by definition, and strings that only the automaton finds, in texts with wide characters."""
    rng = random.Random(31)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    key = lambda: "sk_" + pick("0123456789ABCDEF", 24)
    word = lambda: pick("etaoinshrdlu", rng.randrange(3, 12))
    lone = {i: key() for i in range(0, 300, 20)}
    rows = [(i, f"é日 {' '.join(word() for _ in range(30))} token={key()} " + pick("0123456789abcdef", 40) + f" 😀 {lone.get(i, '')} " + " ".join(word() for _ in range(30))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "日" * 50_000 + " secret:abcdefghi " + "x.y " * 20_000), (None, f"token={key()}")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in secrets.op7_secret_scan(spark, str(tmp_path)).collect()}
    added = {}
    for i, text in rows:
        base, r = base_by_definition(text or ""), got[i]
        said = ",".join(f"{['assign', 'access', 'hex'][k]}:{a}:{b}" for a, k, b in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, x, _ in base) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert [s for s in spans if s[0] != "format"] == [s.split(":") for s in said.split(",") if s]
        added[i] = [text[int(a) : int(b)] for k, a, b in spans if k == "format"]
    assert sum(v in added[i] for i, v in lone.items()) >= 0.85 * len(lone) and sum(map(len, added.values())) < len(lone) + 10


def test_languages_of_the_query_by_brute_force(spark, tmp_path):
    """op9 on a small table: bundles, cosines and the best of them, by definition."""
    rng = random.Random(32)
    alphabets = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "klmnopqé"}
    rows = [(i, " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(3, 40))), lang) for i, lang in enumerate(list(alphabets) * 20)]
    rows += [(100, None, "aa"), (101, "12 !", None), (102, "abc", None), (None, "abc", "bb")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in language.op9_language_id(spark, str(tmp_path)).collect()}
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 3 == 1

    def profile(text):
        s = " " + " ".join(re.findall(r"[^\W\d_]+", (text or "").lower())) + " "
        v = np.zeros(language.DIMENSIONS)
        letters = {c: language.letter_vectors(np.array([0 if c == " " else ord(c)]))[0].astype(int) for c in set(s)}
        for a, b, c in zip(s, s[1:], s[2:]):
            v += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return v / np.linalg.norm(v) if len(s) > 2 else v

    bundles = {lang: sum(profile(t) for i, t, x in rows if x == lang and t and not held(i)) for lang in alphabets}
    for i, t, _ in rows:
        p = profile(t)
        like = {lang: p @ b / np.linalg.norm(b) for lang, b in bundles.items()}
        best = max(sorted(like), key=like.get)
        assert got[i].held_out == held(i)
        assert (got[i].lang_pred, round(got[i].score, 4)) == ((best, round(float(np.clip(like[best], 0, 1)), 4)) if p.any() else ("und", 0.0))


def test_long_text_in_many_scripts(monkeypatch):
    text = " ".join(chr(c) * 3 + chr(c + 1) for c in range(0x4E00, 0x5600))
    raw = np.frombuffer((text + "short").encode(), np.uint8)
    offs = np.array([0, len(raw) - 5, len(raw)])
    want = language.profiles(raw, offs)
    monkeypatch.setattr(language, "HELD_GRAMS", 100)
    assert np.allclose(language.profiles(raw, offs), want, atol=1e-5)


def test_language_stage_without_labels_and_with_clashing_columns(spark, sf_dir):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.createDataFrame([(1, "some words", None, 5), (2, "12", None, 6), (3, None, None, 7)], "doc_id long, text string, lang string, score int")
    assert [tuple(r) for r in pipeline.language_stage(spark, docs, sf_dir).collect()] == [(1, "some words", None, 5)]
    told = docs.unionByName(spark.createDataFrame([(4, "other words", "en", 8)], docs.schema))
    assert sorted(map(tuple, pipeline.language_stage(spark, told, sf_dir).collect())) == [(1, "some words", "en", 5), (4, "other words", "en", 8)]


def test_share_of_training_rows_is_never_nothing(spark):
    rows = spark.range(5000).select(F.col("id").alias("key"), F.lit("ab cd").alias("text"), F.lit("en").alias("lang"))
    assert language.learned(rows, 1)[0] in ([], ["en"]) and language.learned(rows, 200)[0] == ["en"]


def test_vocabulary_table(spark):
    table = spark.createDataFrame([("gold", "Gold", False, 2, False), ("gold", "golds", False, 2, False), ("mine", "mine", False, 1, False), ("bad", "bad", True, 1, True)], "name string, form string, strict boolean, weight int, host boolean")
    cases = {"http://x.se/gold-golds": "allow", "http://x.se/gold-mine": "block", "http://bad.se/": "block", "http://x.se/bad": "allow", "http://porn.se/": "allow", None: "allow"}
    pages = spark.createDataFrame([(u,) for u in cases], "url string").withColumn("hits_", F.lit(1))
    assert {r.url: r.verdict for r in urls.judged(pages, vocabulary=table).collect()} == cases
    assert {r.verdict for r in urls.judged(pages, vocabulary=table.limit(0)).collect()} == {"allow"}
    with pytest.raises(ValueError):
        urls.vocabulary_of(table.withColumn("form", F.lit(None).cast("string")))


def test_hubs_of_components(spark, monkeypatch):
    from quern.llm import components

    monkeypatch.setattr(components, "HUB", 3)
    rng = random.Random(33)
    edges = [(0, i) for i in range(1, 40)] + [(500, i) for i in range(501, 560)] + [(rng.randrange(40), rng.randrange(500, 560))] + [(i, i + 1) for i in range(900, 930)]
    got = {r.id: r.component_id for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(40), *range(500, 560)], 0), **dict.fromkeys(range(900, 931), 900)}


@pytest.mark.parametrize(("block", "large"), [(512, 4096), (8, 4096), (8, 0), (512, 2)])
def test_buckets_of_any_size_lose_no_link(spark, monkeypatch, block, large):
    """Groups of edited copies that share a long common part, by brute force: in one block, several, and by rare shingles."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "LARGE", large)
    rng = random.Random(40)
    common = [f"c{i}" for i in range(150)]
    rows = []
    for g in range(12):
        own = [f"g{g}x{i}" for i in range(70)]
        for _ in range(9):
            w = common + own
            for _ in range(rng.randrange(9)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**9)}"
            rows.append(" ".join(w))
    rows += [" ".join(common)] * 3 + [" ".join(common + [f"z{i}{k}" for i in range(k)]) for k in range(1, 30, 3)]
    rng.shuffle(rows)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for b in range(len(rows)):
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), percent=80).collect()}
    assert got == {i: find(i) for i in range(len(rows))} and len(set(got.values())) > 5
