"""Stems, index versions, generation, streams, the service and evaluation, against brute force or by hand."""

import io
import json
import math
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import Answer, Chunk, Document, QueryResult
from quern.errors import ConfigError, ModelServerError, StoreError
from quern.functions import text as T
from quern.functions.stem import stem
from quern.operators import answer, chunk, embed, generate, metrics, search, store
from quern.plans.config import load
from quern.plans.evaluate import evaluate, grounding
from quern.plans.pipeline import Pipeline
from quern.plans.queries import QUERIES
from quern.service import Service
from quern.sources import corpus
from quern.sources.files import write_report
from quern.sources.tables import Versions
from quern.streaming.events import ingest
from quern.types import documents

GUIDE = "# Store\n\nThe store keeps rows.\n\n## Limits\n\nA batch holds 168 rows at most. Larger batches are refused by the server.\n"


def terms_of(text, stems=True):
    import re

    found = [t for t in re.findall(T.TOKEN, text.lower().replace("ё", "е")) if len(t) >= 2 and t not in T.STOPWORDS]
    return [stem(t) for t in found] if stems else found


def bm25_of(questions, rows, k, k1=1.5, b=0.75):
    lists = {i: terms_of(t) for i, t in rows.items()}
    n, avgdl = len(lists), sum(map(len, lists.values())) / max(1, len(lists))
    df = Counter(t for ts in lists.values() for t in set(ts))
    out = {}
    for qid, q in questions.items():
        score = Counter()
        for i, ts in lists.items():
            tf = Counter(ts)
            for t in set(terms_of(q)) & set(ts):
                score[i] += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(ts) / avgdl))
        out[qid] = sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
    return out


def test_stemmed_bm25_by_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    asked = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = bm25_of(asked, docs, 10)
    got = QUERIES["bm25_stemmed"](spark, sf_dir).collect()
    assert len(got) == sum(map(len, want.values()))
    for r in got:
        i, score = want[r.qid][r.rank - 1]
        assert (r.doc_id, r.score) == (i, pytest.approx(score, abs=1e-6))


def test_stemmed_postings_by_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {(t, i, n, len(terms_of(text))) for i, text in docs.items() for t, n in Counter(terms_of(text)).items()}
    assert {tuple(r) for r in QUERIES["postings_stemmed"](spark, sf_dir).collect()} == want


def test_a_query_form_meets_a_document_form(spark):
    rows = spark.createDataFrame([("ru", "Параметр задаёт срок хранения событий в партициях."), ("en", "The relational stores were replicated."), ("none", "")], "id string, text string")
    q = spark.createDataFrame([(0, "партиция хранение"), (1, "replication of a store")], "qid long, question string")
    assert {(r.qid, r.id) for r in search.bm25(q, rows, "id", 5).collect()} == {(0, "ru"), (1, "en")}
    assert search.bm25(q, rows, "id", 5, analyzer=T.PLAIN).count() == 0
    assert {r.id: r.len for r in search.postings(rows, "id", F.col("text"), T.Analyzer()).where("term = ''").collect()} == {"ru": 6, "en": 4, "none": 0}


def test_hash_embedding_by_definition(spark):
    import hashlib

    texts = {1: "Running runners run, banana!", 2: "", 3: "партициях 2.5 a"}
    rows = spark.createDataFrame(list(texts.items()), "id long, text string")
    for stems in (True, False):
        got = {(r.id, r.idx): r.x for r in embed.hash_embed(rows, "id", "text", 32, 5, stems).collect()}
        want = {}
        for i, t in texts.items():
            import re

            found = re.findall(T.TOKEN, t.lower().replace("ё", "е"))
            tf = Counter("w:" + (stem(x) if stems else x) for x in found) + Counter("c:" + ("^" + x + "$")[k : k + 3] for x in found if len(x) > 3 for k in range(len(x)))
            v = np.zeros(32)
            for f, n in tf.items():
                h = hashlib.md5(f"5:{f}".encode()).hexdigest()
                v[int(h[:7], 16) % 32] += (1 if int(h[7], 16) >= 8 else -1) * (1 + math.log(n))
            if np.linalg.norm(v):
                want |= {(i, k): v[k] / np.linalg.norm(v) for k in range(32)}
        assert all(got.get(k, 0.0) == pytest.approx(x, abs=1e-9) for k, x in want.items()) and set(got) <= set(want)


def test_dense_search_in_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    m = np.concatenate([rng.normal(size=(120, 6)), np.repeat(rng.normal(size=(1, 6)), 9, 0), 1e6 + rng.normal(size=(20, 6)) * 1e-5])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>").repartition(3)
    q = spark.createDataFrame([(i, (m[i * 7] + 1e-6).tolist()) for i in range(20)], "qid long, vector array<double>")
    monkeypatch.setattr(search, "MATRIX_BYTES", 300)
    monkeypatch.setattr(search, "QUESTION_BLOCK", 2)
    monkeypatch.setattr(search, "ROW_BLOCK", 10)
    for metric in ("cosine", "l2"):
        got = {(r.qid, r.rank): (r.id, r.score) for r in search.dense_topk(q, rows, "id", 5, metric).collect()}
        for i in range(20):
            x = m[i * 7] + 1e-6
            s = m @ x / np.linalg.norm(m, axis=1) / np.linalg.norm(x) if metric == "cosine" else -np.linalg.norm(m - x, axis=1)
            order = sorted(range(len(m)), key=lambda j: (-round(s[j], 9), j))[:5]
            assert [got[i, k + 1][1] for k in range(5)] == pytest.approx([s[j] for j in order], abs=1e-8)


def test_approximate_search_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    q = rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("qid"), "vector")
    exact = {(r.qid, r.vec_id) for r in search.dense_topk(q, rows, "vec_id", 10).collect()}
    found = {(r.qid, r.vec_id): r.score for r in search.ann_topk(q, rows, "vec_id", 10, tables=24, bits=6).collect()}
    assert len(exact & set(found)) >= 0.9 * len(exact) and all(found[i, i] == pytest.approx(1) for i in {q for q, _ in exact})
    assert search.ann_topk(q.limit(0), rows, "vec_id", 10).count() == 0


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [3.0] * 50, [float(x % 97) for x in range(4000)], [float(x * x) for x in range(3001)], []])
def test_percentiles(spark, values):
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
    r = metrics.percentiles(rows, "v").first()
    want = (statistics.median(values), sorted(values)[round(0.95 * (len(values) - 1))]) if values else (0.0, 0.0)
    assert (r.p50, r.p95) == want


def test_structural_rules():
    a, b = "x" * 855, "## B\n" + "y" * 151
    assert chunk.sections(a + "\n" + b, 900, 200) == [(0, 856), (856, 1012)]
    assert chunk.sections("z" * 300 + "\n" + b, 900, 200) == [(0, 457)]
    assert chunk.sections("# H\nshort", 900, 0) == [(0, 9)]
    text = "a" * 50 + "\n\n\n\n" + "b" * 50
    assert chunk.sections(text, 60, 10) == [(0, 54), (54, 104)]
    assert chunk.sections("One two. " * 3 + "C" * 40, 30, 10) == [(0, 27), (27, 57), (57, 67)]
    assert chunk.token_windows("aa bb cc dd", 2, 0) == [(0, 6), (6, 11)] and chunk.token_windows("aa bb cc dd", 3, 1) == [(0, 8), (6, 11)]


def test_context_has_the_heading(spark):
    rows = spark.createDataFrame([(0, 1, "c1", "some  text", "A > B"), (0, 2, "c2", "x" * 50, ""), (0, 3, "c3", "y", "")], "qid long, rank int, chunk_id string, text string, heading string")
    assert [r.block for r in answer.packed(rows, 40, 20).orderBy("rank").collect()] == ["[1] A > B\nsome text"]
    assert answer.context(answer.packed(rows, 100, 20)).first().context == "[1] A > B\nsome text\n\n[2] " + "x" * 20 + "\n\n[3] y"


def test_refusals_agree_with_answers(spark):
    packs = spark.createDataFrame([(0, 1, "c", "Green apples fall from the tree. Nothing else is said here."), (1, 1, "c", "Unrelated words stand in this sentence.")], "qid long, rank int, chunk_id string, text string")
    q = spark.createDataFrame([(0, "apple tree height"), (1, "zebra"), (2, "apples")], "qid long, question string")
    got = {r.min_support: r.refused for r in answer.refusals(packs, q, [0.0, 0.6, 0.7]).collect()}
    for m, share in got.items():
        said = answer.enforced(answer.extractive(packs, q, min_support=m), packs, q, "chunk_id").collect()
        assert share == pytest.approx(sum(r.refused for r in said) / 3)
    assert got == {0.0: pytest.approx(2 / 3), 0.6: pytest.approx(2 / 3), 0.7: 1.0}


def model_server():
    """A class of model servers that say one thing, made anew so that tasks need not import this file."""

    class Model:
        def __init__(self, reply, broken=False):
            self.reply, self.broken = reply, broken

        def chat(self, messages, schema=None):
            if self.broken or "fail" in messages[1]["content"]:
                raise ModelServerError("status 500")
            return self.reply

        def stream(self, messages, schema=None):
            for i in range(0, len(self.reply), 3):
                if self.broken and i > 6:
                    raise ModelServerError("status 500")
                yield self.reply[i : i + 3]

    return Model


def test_model_answers(spark):
    Model = model_server()
    packs = spark.createDataFrame([(0, 1, "c1", "text one"), (1, 1, "c1", "fail")], "qid long, rank int, chunk_id string, text string").withColumn("block", F.concat(F.lit("[1] "), "text"))
    q = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "qid long, question string")
    said = generate.model_answers(packs, q, lambda: Model('{"answer": "It is one [1].", "citations": [1]}'))
    got = {r.qid: r for r in answer.enforced(said, packs, q, "chunk_id").collect()}
    assert got[0].text == "It is one [1]." and got[1].reason == "generation failed: status 500" and got[2].reason == answer.NO_CHUNKS
    for provider, client in (("model", None), ("nope", None)):
        with pytest.raises(ConfigError):
            generate.generator(provider, client)


def pipeline_of(spark, given=None, **services):
    p = Pipeline(spark, load({"embedding": {"dim": 32}, **(given or {})}), **services)
    p.index(spark.createDataFrame([("guide", GUIDE, "en"), ("other", "Nothing of note stands here at all.", "de")], "doc_id string, text string, lang string"))
    return p


def test_streams(spark):
    Model = model_server()
    with pipeline_of(spark) as p:
        events = list(p.stream("How many rows does a batch hold?"))
        assert [e[0] for e in events][0] == "sources" and events[-1][0] == "answer" and {e[0] for e in events[1:-1]} == {"delta"}
        assert "168" in events[-1][1]["answer"] and events[-1][1]["citations"][0]["doc_id"] == "guide"
        result = QueryResult.of(p.query("How many rows does a batch hold?", {"lang": "en"}))
        assert isinstance(result.answer, Answer) and "168" in result.answer.text and result.total_ms > 0 and {r["doc_id"] for r in result.retrieved} == {"guide"}
    reply = '{"answer": "At most 168 [1] and [9].", "citations": [1]}'
    with pipeline_of(spark, {"generation": {"provider": "model"}}, client=lambda: Model(reply)) as p:
        events = list(p.stream("How many rows?"))
        assert "".join(d for k, d in events if k == "delta") == "At most 168 [1] and [9]." and events[-1][1]["answer"] == "At most 168 [1] and ."
        p.client = lambda: Model(reply, broken=True)
        last = list(p.stream("How many rows?"))[-1][1]
        assert last["refused"] and last["reason"] == "generation failed: status 500"
    with pytest.raises(ConfigError):
        Pipeline(spark, load({"generation": {"provider": "model"}}))


def test_an_index_outlives_its_session(spark, tmp_path):
    given = {"embedding": {"dim": 16}, "store": {"path": f"file://{tmp_path}/index"}, "lexical": {"use_stemming": False, "min_token_length": 4}}
    rows = [Document("a", GUIDE), Document("b", "old words"), Document("b", "newer words")]
    with Pipeline(spark, load(given)) as p:
        assert p.index(documents(spark, rows))["documents"] == 2
        p.index(documents(spark, [Document("b", "newest words here"), Document("c", "  ")]))
    again = Pipeline(spark, load(given))
    assert {r.doc_id: r.text for r in again.chunks.where("doc_id <> 'a'").collect()} == {"b": "newest words here"}
    assert {r.term for r in again.tables.read("postings").where("chunk_id like 'b::%'").collect()} == {"", "newest", "words", "here"}
    assert [r["doc_id"] for r in again.query("newest")["retrieved"]][0] == "b"
    # a writer that died leaves a folder without a marker
    again.chunks.write.parquet(f"file://{tmp_path}/index/v-9/chunks")
    assert again.tables.current() == 2 and again.delete(spark.createDataFrame([("a",)], "doc_id string")) > 0
    assert {r.doc_id for r in again.chunks.collect()} == {"b"} and again.stats()["status"] == "ok"
    again.clear()
    assert again.stats()["status"] == "empty"
    with pytest.raises(StoreError):
        again.query("anything")


def test_ingest_goes_on_after_a_restart(spark, tmp_path):
    given = load({"embedding": {"dim": 8}, "store": {"path": f"file://{tmp_path}/index"}})
    schema = "doc_id string, text string"
    for name, text in (("a", "first text"), ("b", "second text")):
        spark.createDataFrame([(name, text)], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        ingest(stream, Pipeline(spark, given), str(tmp_path / "ck")).awaitTermination(120)
    assert {r.doc_id for r in Pipeline(spark, given).chunks.collect()} == {"a", "b"}


def test_versions_keep_the_one_before(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/t")
    assert v.current() == 0 and v.read("x") is None
    for n in range(4):
        old = v.read("x")
        v.write({"x": spark.range(n + 1)})
        assert v.read("x").count() == n + 1 and (old is None or old.count() == n)
    assert sorted(x.name for x in (tmp_path / "t").iterdir() if x.name.startswith("v-")) == ["v-3", "v-4"]


def test_service(spark):
    service = Service(None)
    assert service.handle("GET", "/health")[0] == 503
    with Pipeline(spark, load({"embedding": {"dim": 16}})) as p:
        service.pipeline = p
        call = lambda method, path, data=None: (lambda r: (r[0], "".join(r[2])))(service.handle(method, path, json.dumps(data).encode()))
        assert json.loads(call("GET", "/health")[1])["status"] == "empty" and call("POST", "/query", {"query": "x"})[0] == 400
        good = [{"doc_id": "g", "text": GUIDE, "metadata": {"lang": "en"}}, {"doc_id": "h", "text": "A batch of nothing.", "metadata": {"lang": "de"}}]
        status, body = call("POST", "/index", {"documents": good})
        assert status == 200 and set(json.loads(body)) == {"documents", "chunks", "chunker", "elapsed_ms"}
        said = json.loads(call("POST", "/query", {"query": "How many rows does a batch hold?", "filters": {"lang": "en"}})[1])
        assert "168" in said["answer"] and {r["doc_id"] for r in said["retrieved"]} == {"g"} and set(said["retrieved"][0]) == {"chunk_id", "doc_id", "score", "ranks"}
        frames = call("POST", "/query/stream", {"query": "How many rows does a batch hold?"})[1].split("\n\n")
        assert frames[0].startswith("event: sources") and frames[-2].startswith("event: answer") and "ranks" not in frames[0]
        for path, data in (("/index", {"documents": []}), ("/index", {"documents": [{"doc_id": "x", "text": "t", "more": 1}]}), ("/query", {"query": ""}), ("/query", {"query": "x" * 2001}), ("/query", {"query": "x", "more": 1}), ("/query", {"query": "x", "filters": {"a": [1]}})):
            assert call("POST", path, data)[0] == 422
        assert service.handle("POST", "/query", b"{")[0] == 422 and call("GET", "/query")[0] == 405 and call("GET", "/nope")[0] == 404
        began = []
        body = b"".join(service({"REQUEST_METHOD": "GET", "PATH_INFO": "/health", "wsgi.input": io.BytesIO(b"")}, lambda *a: began.append(a)))
        assert began[0][0] == "200 OK" and json.loads(body)["status"] == "ok"


def test_corpus(spark, tmp_path):
    made = corpus.build(7)
    assert made == corpus.build(7) != corpus.build(8)
    text = {d["doc_id"]: d["text"] for d in made["documents"]}
    for q in made["questions"]:
        gold = text[q["doc_id"]][q["gold_start"] : q["gold_end"]]
        assert q["answer"] in gold and sum(t.count(gold) for t in text.values()) == 1
    assert {d["metadata"]["lang"] for d in made["documents"]} == {"en", "ru"} and sum(d["metadata"]["kind"] == "neighbour" for d in made["documents"]) >= 9
    assert len(made["questions"]) > 100 and len(made["unanswerable"]) == 8
    with pytest.raises(StoreError):
        corpus.unique_place("a b a", "a")
    assert corpus.write(str(tmp_path / "d")) == {"corpus": len(text), "questions": len(made["questions"]), "unanswerable": 8}


def test_evaluation(spark, tmp_path):
    docs, questions, lost = corpus.frames(spark)
    row = evaluate(spark, load({"chunking": {"strategy": "structural"}}), docs, questions.limit(60), lost, "base", timed=1)
    assert row["recall@5"] > 0.8 and row["mrr"] > 0.6 and row["faithfulness"] > 0.9 and row["answer_terms"] > 0.4 and row["false_refusal"] < 0.1
    assert row["p95_ms"] >= row["p50_ms"] > 0 and row["batch_ms"] > 0 and {"run", "retrieval", "chunks", "precision@5", "ndcg@5", "true_refusal", "index_ms"} <= set(row)
    write_report({"rows": [row], "name": "é"}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["name"] == "é" and "é" in (tmp_path / "r.json").read_text()


def test_grounding_by_hand(spark):
    said = spark.createDataFrame([("a", "Red apples fall [1].", [("c1",)], False), ("b", "", [], True), ("c", "[1] ..", [("c1",)], False)], "qid string, text string, citations array<struct<chunk_id:string>>, refused boolean")
    chunks = spark.createDataFrame([("c1", "The apple is red.")], "chunk_id string, text string")
    q = spark.createDataFrame([("a", "falling apples"), ("b", "x"), ("c", "apple")], "qid string, answer string")
    got = {r.qid: (r.faithful, r.answer_terms) for r in grounding(said, chunks, q).collect()}
    assert got == {"a": (pytest.approx(2 / 3), 1.0), "b": (1.0, 0.0), "c": (0.0, 0.0)}


def test_rows_as_objects():
    assert Chunk("a::0000", "a", 0, 3, 5, "xy").text == "xy"
    for bad in (lambda: Chunk("a::0000", "a", 0, 3, 5, "x"), lambda: Document("", "x")):
        with pytest.raises(ValueError):
            bad()


def test_store_details(spark):
    table = spark.createDataFrame([("a::0", "a", "x"), ("b::0", "b", "y")], "chunk_id string, doc_id string, text string")
    twice = spark.createDataFrame([("b::0", "b", "z"), ("b::0", "b", "w")], table.schema)
    assert {(r.chunk_id, r.text) for r in store.upsert(table, twice).collect()} == {("a::0", "x"), ("b::0", "z")}
    assert store.removed(table, spark.createDataFrame([("a",), ("a",), ("q",)], "doc_id string")) == 1
    meta = spark.createDataFrame([('{"lang": "en", "n": 1}',), (None,), ("[",)], "metadata string")
    assert [dict(r[0]) for r in meta.select(store.decoded_metadata()).collect()] == [{"lang": "en", "n": "1"}, {}, {}]
    docs = spark.createDataFrame([("a", "one"), ("a", "two"), ("b", "x")], "doc_id string, text string")
    assert {(r.doc_id, r.text) for r in store.last_of_each(docs).collect()} == {("a", "two"), ("b", "x")}


@pytest.mark.parametrize("bad", [{"lexical": {"b": 2}}, {"embedding": {"dim": 0}}, {"fusion": {"k": 0}}, {"chunking": {"strategy": "x"}}, {"generation": {"min_support": 2}}, {"lexical": {"min_token_length": 0}}])
def test_config_ranges(bad):
    with pytest.raises(ConfigError):
        load(bad)


def test_command_line(spark, tmp_path, capsys):
    from quern.cli import main

    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "store.md").write_text(GUIDE)
    (tmp_path / "c.json").write_text(json.dumps({"embedding": {"dim": 16}}))
    base = ["--config", str(tmp_path / "c.json"), "--store", f"file://{tmp_path}/index"]
    assert main([*base, "query", "rows"]) == 1
    assert main([*base, "index", "--path", str(tmp_path / "docs")]) == 0 and json.loads(capsys.readouterr().out)["documents"] == 1
    assert main([*base, "query", "How many rows does a batch hold?"]) == 0
    said = json.loads(capsys.readouterr().out)
    assert "168" in said["answer"] and said["citations"][0]["doc_id"] == "store.md"
    assert main(["dataset", str(tmp_path / "data")]) == 0 and json.loads(capsys.readouterr().out)["unanswerable"] == 8
