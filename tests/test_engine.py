import json
import math

import pytest
from pyspark.sql import functions as F

from quern.errors import ChunkingError, ConfigError, DimensionMismatchError, FusionError, ModelServerError, StoreError
from quern.functions.sentences import sentence_spans
from quern.functions.stem import stem
from quern.operators import answer, chunk, fuse, metrics, search, store
from quern.plans.config import load, variant
from quern.plans.evaluate import evaluate, grounding, sweep
from quern.plans.pipeline import Pipeline
from quern.sources.client import ModelClient
from quern.sources.files import inline_documents, markdown, read_corpus, read_directory
from quern.streaming.events import JsonField, frames, ingest, payload, replayed

GUIDE = "# Store\n\nThe store keeps rows.\n\n## Setup\n\nPort 5432 is the default port. Change it in the file, e.g. by hand. Then restart the server at once.\n\n## Limits\n\nA batch holds 168 rows at most. Larger batches are refused by the server.\n"


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("technology", "technologi"), ("possibly", "possibli"), ("hopping", "hop"), ("controll", "control"), ("важнейший", "важн"), ("радость", "радост"), ("каменный", "камен"), ("2.6", "2.6"), ("at", "at")])
def test_stem(word, want):
    assert stem(word) == want


def test_sentences():
    text = 'One, e.g. this. Two is 2.5 long! "Three." lower.\n\nFour'
    spans = sentence_spans(text)
    assert [text[a:b] for a, b in spans] == ["One, e.g. this. ", "Two is 2.5 long! ", '"Three." lower.\n\n', "Four"]
    assert sentence_spans("") == [] and len(sentence_spans("A.\nB.")) == 1


TEXTS = [GUIDE, GUIDE * 12, "One sentence.", "# Only a heading", "x" * 2500, "a  \n\n  \n\nb   \n\n" * 90, "слово и ещё слово. " * 80]
GRID = [("fixed", {}), ("fixed", {"size": 100, "overlap": 0}), ("fixed", {"size": 50, "overlap": 49}), ("sentence", {}), ("sentence", {"max_chars": 60, "overlap_sentences": 2}), ("structural", {}), ("structural", {"max_chars": 80, "min_section_chars": 0}), ("token", {"max_tokens": 20, "overlap_tokens": 5}), ("token", {"max_tokens": 7, "overlap_tokens": 0})]


@pytest.mark.parametrize(("strategy", "options"), GRID)
def test_chunks_tile(spark, strategy, options):
    docs = spark.createDataFrame(list(enumerate([*TEXTS, " \n "])), "doc_id long, text string")
    chunks = chunk.chunk(docs, strategy, **options).cache()
    seen = {r.doc_id: r for r in chunk.coverage(chunks, docs).collect()}
    assert set(seen) == set(range(len(TEXTS))) and all(r.covered for r in seen.values())
    assert {r.doc_id: r.text for r in chunk.reconstruct(chunks).collect()} == dict(enumerate(TEXTS))


def test_chunk_headings_and_errors(spark):
    docs = spark.createDataFrame([("g", GUIDE)], "doc_id string, text string")
    heads = [r.heading for r in chunk.chunk(docs, "structural", max_chars=120, min_section_chars=10).orderBy("ordinal").collect()]
    assert heads[0] == "Store" and "Store > Setup" in heads and "Store > Limits" in heads
    assert chunk.chunk(docs).first().chunk_id == "g::0000"
    for bad in (("nope", {}), ("fixed", {"size": 0}), ("fixed", {"size": 5, "overlap": 5}), ("token", {"max_tokens": 3, "overlap_tokens": 3})):
        with pytest.raises(ChunkingError):
            chunk.chunk(docs, bad[0], **bad[1])


def test_bm25_by_hand(spark):
    rows = spark.createDataFrame([(1, "apple pear"), (2, "apple apple plum"), (3, "fig")], "id long, text string")
    q = spark.createDataFrame([(0, "apple apple")], "qid long, question string")
    got = {r.id: r.score for r in search.bm25(q, rows, "id", 5).collect()}
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    assert got[1] == pytest.approx(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 2)))
    assert got[2] == pytest.approx(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2))) and set(got) == {1, 2}
    assert search.bm25(q, rows, "id", 0).count() == 0


def test_dense_ties_zero_and_filters(spark):
    rows = spark.createDataFrame([(2, [1.0, 0.0], "a"), (1, [2.0, 0.0], None), (3, [0.0, 0.0], "b"), (4, None, "a")], "id long, vector array<double>, lang string")
    q = spark.createDataFrame([(7, [3.0, 0.0])], "qid long, vector array<double>")
    assert [(r.id, r.score) for r in search.dense_topk(q, rows, "id", 3).orderBy("rank").collect()] == [(1, 1.0), (2, 1.0), (3, 0.0)]
    assert [r.id for r in search.dense_topk(q, rows, "id", 2, "l2").orderBy("rank").collect()] == [1, 2]
    assert {r.id for r in rows.where(search.matches({"lang": ["a", None]})).collect()} == {1, 2, 4}
    assert {r.id for r in rows.where(search.matches({"lang": None})).collect()} == {1}
    with pytest.raises(StoreError):
        search.matches({"lang": ["a"]}, strict_equality=True)
    assert search.dense_topk(q, rows, "id", 0).count() == 0


def test_fusion(spark):
    lists = spark.createDataFrame([(0, "dense", "a", 0.9, 1), (0, "dense", "b", 0.5, 2), (0, "lexical", "b", 7.0, 1), (0, "other", "c", 1.0, 1)], "qid long, source string, id string, score double, rank int")
    got = {r.id: r for r in fuse.fuse(lists, "id", 9).collect()}
    assert got["b"].score == pytest.approx(0.5 / 62 + 0.5 / 61) and got["c"].score == pytest.approx(1 / 61) and got["b"].ranks == {"dense": 2, "lexical": 1}
    flat = {r.id: r.score for r in fuse.fuse(lists, "id", 9, "weighted").collect()}
    assert flat == pytest.approx({"a": 0.5, "b": 0.5, "c": 1.0})
    with pytest.raises(FusionError):
        fuse.fuse(lists, "id", 3, "nope")


def test_rerank_and_judge(spark):
    c = spark.createDataFrame([(0, "x", "red cat sat near green dog"), (0, "y", "red dog"), (0, "z", "none")], "qid long, id string, text string")
    q = spark.createDataFrame([(0, "red dog")], "qid long, question string")
    got = {r.id: r.score for r in fuse.rerank(c, q, "id", 5).collect()}
    assert got["y"] == pytest.approx(1.0) and got["z"] == 0 and got["x"] == pytest.approx(0.6 + 0.25 * 2 / 6 + 0.15)
    assert fuse.judged(c, q, "id", 1, lambda a, b: 9 if b == "none" else 1).first().id == "z"

    def broken(a, b):
        raise ValueError

    assert fuse.judged(c, q, "id", 1, broken).first().id == "y"


def test_metrics_by_hand(spark):
    results = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "c", 3), (1, "a", 1)], "qid long, id string, rank int")
    gold = spark.createDataFrame([(0, "b"), (0, "z"), (2, "q")], "qid long, id string")
    got = {r.qid: r for r in metrics.at_k(results, gold, "id", 3).collect()}
    assert got[0].recall == 0.5 and got[0].precision == pytest.approx(1 / 3) and got[0].rr == 0.5
    assert got[0].ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert got[1].recall == 0 and got[2].ndcg == 0


def test_citations(spark):
    packs = spark.createDataFrame([(0, 1, "c1", "text one"), (0, 2, "c2", "text two"), (3, 1, "c1", "text one"), (4, 1, "c1", "t")], "qid long, rank int, chunk_id string, text string")
    said = spark.createDataFrame([(0, "Yes  [2] and [9] .", [9]), (3, "No [7]", []), (4, "[1]", [1])], "qid long, text string, claimed array<int>")
    q = spark.createDataFrame([(0,), (1,), (3,), (4,)], "qid long")
    got = {r.qid: r for r in answer.enforced(said, packs, q, "chunk_id").collect()}
    assert got[0].text == "Yes [2] and ." and [c.chunk_id for c in got[0].citations] == ["c2"] and not got[0].refused
    assert got[1].reason == answer.NO_CHUNKS and got[3].reason == answer.UNRESOLVED and got[4].reason == answer.EMPTY


def test_store(spark):
    table = spark.createDataFrame([("a::0", "a", "x"), ("b::0", "b", "y")], "chunk_id string, doc_id string, text string")
    new = spark.createDataFrame([("b::0", "b", "z"), ("c::0", "c", "w")], "chunk_id string, doc_id string, text string")
    assert {(r.chunk_id, r.text) for r in store.upsert(table, new).collect()} == {("a::0", "x"), ("b::0", "z"), ("c::0", "w")}
    v = spark.createDataFrame([([0.5, 1.0, -2.25],)], "vector array<double>")
    assert v.select(store.vector_literal()).first()[0] == "[0.5,1,-2.25]"
    with pytest.raises(DimensionMismatchError):
        store.checked(v, 2)


def test_pipeline(spark, tmp_path):
    docs = spark.createDataFrame([("guide", GUIDE, "en"), ("other", "Nothing of note stands here at all.", "en"), ("blank", " ", "en")], "doc_id string, text string, lang string")
    q = spark.createDataFrame([("q", "How many rows does a batch hold?"), ("u", "zzz qqq")], "qid string, question string")
    with Pipeline(spark, load({"embedding": {"dim": 64}, "rerank": {"provider": "heuristic"}})) as p:
        assert p.stats()["status"] == "empty"
        first = p.index(docs)
        assert p.index(docs)["chunks"] == first["chunks"]
        got = {r.qid: r for r in p.answers(q, {"lang": "en"}).collect()}
        assert "168" in got["q"].text and got["q"].citations[0].chunk_id.startswith("guide::") and got["u"].refused
    gold = spark.createDataFrame([("q", "How many rows does a batch hold?", "168", "guide", GUIDE.index("A batch"), GUIDE.index("A batch") + 20)], "qid string, question string, answer string, doc_id string, gold_start int, gold_end int")
    assert evaluate(spark, load({"embedding": {"dim": 64}}), docs, gold)["recall@5"] == 1.0


def test_ingest(spark, tmp_path):
    spark.createDataFrame([("a", GUIDE)], "doc_id string, text string").write.json(str(tmp_path / "in"))
    p = Pipeline(spark, load({"embedding": {"dim": 16}}))
    ingest(spark.readStream.schema("doc_id string, text string").json(str(tmp_path / "in")), p, str(tmp_path / "ck")).awaitTermination(60)
    assert p.stats()["chunks"] > 0


def test_config(monkeypatch):
    monkeypatch.setenv("DIM", "8")
    assert load({"store": {"path": "${DIM}/${NONE:x}"}}).store.path == "8/x"
    assert variant({"retrieval": {"final_k": 3}}, retrieval={"dense_k": 0}).retrieval.final_k == 3
    for bad in ({"nope": 1}, {"retrieval": {"x": 1}}, {"retrieval": {"dense_k": 0, "lexical_k": 0}}, {"rerank": {"provider": "heuristic", "top_n": 2}}, {"store": {"path": "${NOT_SET_AT_ALL}"}}):
        with pytest.raises(ConfigError):
            load(bad)


def test_sources(spark, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "a.MD").write_text("alpha\n\nand more\n")
    (tmp_path / "d" / "sub" / "b c.txt").write_text("beta")
    (tmp_path / "d" / "blank.txt").write_text(" \n")
    (tmp_path / "d" / "c.bin").write_text("no")
    assert {(r.doc_id, r.kind, r.text) for r in read_directory(spark, str(tmp_path / "d")).collect()} == {("a.MD", ".md", "alpha\n\nand more\n"), ("sub/b c.txt", ".txt", "beta")}
    (tmp_path / "c.jsonl").write_text('{"doc_id": "x", "text": "t", "metadata": {"k": "v"}}\n\n')
    assert read_corpus(spark, str(tmp_path / "c.jsonl")).count() == 1
    assert inline_documents(spark, [{"doc_id": "x", "text": "t", "metadata": {"n": 1}}]).first().metadata == {"n": "1"}
    for bad in ([], [{"doc_id": "x", "text": "t", "more": 1}], [{"doc_id": "", "text": "t"}]):
        with pytest.raises(StoreError):
            inline_documents(spark, bad)
    assert markdown([{"a": 0.5, "p50_ms": 1.25}]).endswith("| 0.500 | 1.2 |")


def test_events():
    whole = json.dumps({"note": "x", "answer": 'a"b\né\U0001f600', "citations": [1]})
    for size in (1, 2, 3, 7):
        f = JsonField("answer")
        assert "".join(f.feed(whole[i : i + size]) for i in range(0, len(whole), size)) == 'a"b\né\U0001f600' and f.done
    assert payload('{"answer": "x", "citations": [1.9, NaN]}') == ("x", [1]) and payload("[") == ("", [])
    got = list(frames([], replayed("A. B."), {"text": "A. B."}))
    assert [g.split("\n")[0] for g in got] == ["event: sources", "event: delta", "event: delta", "event: answer"]
    assert list(frames([], iter([]), lambda: 1 / 0))[-1].startswith("event: error")


def test_client():
    replies, slept = [(503, [b""]), (200, [b'{"embeddings": [[1, 2]]}'])], []
    c = ModelClient("http://x/", "m", send=lambda *a: replies.pop(0), sleep=slept.append)
    assert c.embed(["t"]) == [[1, 2]] and slept == [0.5]
    with pytest.raises(ModelServerError):
        ModelClient("http://x", "m", send=lambda *a: (404, [b""])).models()
    lines = [b'{"message": {"content": "a"}}\n', b'{"message": {"content": "b"}, "done": true}\n']
    assert list(ModelClient("http://x", "m", send=lambda *a: (200, lines)).stream([])) == ["a", "b"]
