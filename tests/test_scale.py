"""What keeps the queries' time and memory in proportion to their input."""

import math
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.functions import stem
from quern.functions import text as T
from quern.functions.sentences import sentence_spans
from quern.operators import chunk, embed, metrics, search, store
from quern.plans.queries import ORACLES, QUERIES
from quern.sources.tables import kept


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("size,overlap", [(800, 120), (7, 0), (10, 9), (5, 3), (1, 0)])
def test_fixed_windows_from_runs(spark, size, overlap):
    texts = ["é\U0001f600\nab c" * n + "x" * m for n in (1, 3, 40) for m in (0, 1, 5, 700)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = chunk.chunk(docs, "fixed", size=size, overlap=overlap)
    got = {(r.doc_id, r.ordinal): (r.start, r.end, r.text) for r in made.collect()}
    want = {}
    for i, t in enumerate(texts):
        cuts = [(a, min(a + size, len(t))) for a in range(0, max(len(t) - overlap, 1), size - overlap)]
        if len(cuts) > 1 and cuts[-1][1] - cuts[-1][0] < min(size // 4, 120):
            cuts[-2:] = [(cuts[-2][0], len(t))]
        want |= {(i, k): (a, b, t[a:b]) for k, (a, b) in enumerate(cuts)}
    assert got == want
    # a text is measured once, not once for each window, and no filter makes the windows before they are made
    assert plan_of(made).count("length(text") == 1 and "size(transform" not in plan_of(made)


def test_packs_cut_only_their_documents(spark, sf_dir):
    assert QUERIES["context_pack"](spark, sf_dir).count() > 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"


def test_sentences_skip_what_ends_none():
    began = time.perf_counter()
    assert len(sentence_spans("Etc. no end here, i.e. none " * 200_000 + "x. Y")) == 2
    assert time.perf_counter() - began < 2


def test_postings_and_scores_stay_in_their_rows(spark):
    rows = spark.createDataFrame([(i, "common word" + " filler" * (i % 3)) for i in range(90)], "id long, text string").repartition(5)
    for analyzer in (T.PLAIN, T.Analyzer()):
        assert "Aggregate" not in plan_of(search.postings(rows, "id", F.col("text"), analyzer))
    asked = spark.createDataFrame([(1, "common"), (2, "word filler"), (3, "filler"), (4, "absent"), (5, "")], "qid long, question string")
    found = search.bm25(asked, rows, "id", 4, analyzer=T.PLAIN)
    assert "Join" not in plan_of(found)
    top = {q: [r.id for r in found.orderBy("qid", "rank").collect() if r.qid == q] for q in range(1, 6)}
    assert top == {1: [0, 3, 6, 9], 2: [2, 5, 8, 11], 3: [2, 5, 8, 11], 4: [], 5: []}


def test_questions_in_several_passes(spark, sf_dir, monkeypatch):
    key = lambda rows: sorted(map(tuple, rows))
    want = key(QUERIES["bm25_filtered"](spark, sf_dir).collect())
    monkeypatch.setattr(search, "ASKED_ROWS", 150)
    monkeypatch.setattr(search, "SCORE_CELLS", 3_000)
    monkeypatch.setattr(search, "HELD_ROWS", 10)
    assert key(QUERIES["bm25_filtered"](spark, sf_dir).collect()) == want


def test_rows_without_text_count_and_have_no_length(spark):
    rows = spark.createDataFrame([("a", "alpha"), ("b", None), ("c", "")], "id string, text string")
    asked = spark.createDataFrame([(1, "alpha")], "qid long, question string")
    found = search.bm25(asked, rows, "id", 5, analyzer=T.PLAIN).first()
    assert found.id == "a" and abs(found.score - math.log(1 + 2.5 / 1.5) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 1 / 0.5))) < 1e-12


def test_vectors_are_made_within_their_rows(spark):
    rows = spark.createDataFrame([(1, "alpha beta alpha"), (2, None), (3, "..."), (4, "Ёлка 1,5 it's")], "id long, text string")
    made = embed.hash_embed(rows, "id", "text", 64, 7)
    assert "Aggregate" not in plan_of(made) and "Join" not in plan_of(made)
    sparse = {(r.id, r.idx): r.x for r in made.collect()}
    whole = {r.id: r.vector for r in embed.hash_vectors(rows, "id", "text", 64, 7).collect()}
    assert set(whole) == {1, 4} and all(len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-12 for v in whole.values())
    assert {(k, i): x for k, v in whole.items() for i, x in enumerate(v) if x} == {k: x for k, x in sparse.items() if x}


def test_passages_within_their_rows(spark, monkeypatch):
    line = "one two three four five six seven"
    texts = [None, "", f"x {line} y {line}", f"zero{line}th", "one two three four five six  seven", "tiny\U0001f600 tiny", f"{line[:-1]}", "two three four five six " * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    given = [(1, line), (2, line), (3, "tiny"), (4, None), (5, "seven"), (6, "\U0001f600 t"), (7, "two three four five six two three four five six t")]
    passages = spark.createDataFrame(given, "qid long, passage string")
    want = {(q, i, t.find(p), t.find(p) + len(p)) for q, p in given if p for i, t in enumerate(texts) if t and p in t}
    found = metrics.verbatim(passages, docs)
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    assert "Join" not in plan_of(found) and "Generate" not in plan_of(found)
    monkeypatch.setattr(metrics, "PASSAGES", 2)
    assert {tuple(r) for r in metrics.verbatim(passages, docs).collect()} == want


def test_dotted_capital_i_is_one_letter(spark, tmp_path):
    texts = ["İstanbul " * 400, "ab İ " * 200, "plain words " * 150, "K ſ ẞ Σς Ёж " * 90]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("chunk_token", "word_spans", "tokenize_count", "fold_text"):
        got = sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))
        columns = ", ".join(QUERIES[name](spark, str(tmp_path)).columns)
        assert got == sorted(con.sql(f"select {columns} from ({ORACLES[name]})").fetchall())


def test_upsert_in_one_shuffle(spark):
    table = spark.createDataFrame([("a", "1", "x"), ("a", "1", "x"), ("b", "2", "y"), (None, "3", "z")], "chunk_id string, doc_id string, text string")
    rows = spark.createDataFrame([("b", "2", "new"), ("b", "2", "newer"), ("b", None, "zz"), ("c", "4", None), (None, "5", "n"), (None, "5", "m")], table.schema)
    made = store.upsert(table, rows.select("text", "doc_id", "chunk_id"))
    assert sorted(map(tuple, made.collect()), key=str) == sorted([("a", "1", "x"), ("a", "1", "x"), ("b", "2", "newer"), (None, "3", "z"), ("c", "4", None), (None, "5", "n")], key=str)
    assert "Join" not in plan_of(made) and "Aggregate" not in plan_of(made) and plan_of(made).count("Window") == 1


@pytest.mark.parametrize("strategy", chunk.DEFAULTS)
def test_spans_without_texts(spark, strategy):
    docs = spark.createDataFrame([(i, "# A\n" * i + "Some words here. " * 90 * i + "\n\n## B\nit's 1.5 end. " * i) for i in range(1, 4)], "doc_id long, text string")
    spans = chunk.pieces(docs, strategy, "p", False).select("doc_id", F.inline("p"))
    assert spans.columns == ["doc_id", "start", "end", "heading"]
    whole = chunk.chunk(docs, strategy).select(*spans.columns)
    assert sorted(map(tuple, spans.collect())) == sorted(map(tuple, whole.collect()))


def test_token_windows_go_over_runs(monkeypatch):
    text = "It's 1.5 or 2,5.6 İb жёлтый a'b' c`d x9y ... " * 90
    found = [m.span() for m in re.finditer(T.TOKEN, T.folded(text))]
    monkeypatch.setattr(chunk, "_TOKEN", re.compile("never"))  # 990 tokens are 33 runs of 30 and nothing more
    assert len(found) == 990 and chunk.token_windows(text, 180, 30)[1] == (found[150][0], found[329][1])
    began = time.perf_counter()
    assert chunk.token_windows("a'" * 100_000 + " 1.2.3,4" * 50_000 + "z" * 200_000, 180, 30)[-1][1] == 800_000
    assert time.perf_counter() - began < 2


def test_headings_begin_a_line():
    text = "# A\nx # no\n### B  \n####### no\n#no\n\t# no\n## C d \n#\tE"
    assert chunk.headings(text) == [(0, "A"), (11, "A > B"), (40, "A > C d"), (48, "E")]


def test_packs_texts_are_cut_once(spark, sf_dir, monkeypatch):
    from quern.plans import queries

    labels = []
    monkeypatch.setattr(queries, "kept", lambda df, label: (labels.append(label), kept(df, label))[1])
    assert queries.context_pack(spark, sf_dir).count() > 0 and labels == ["top", "cut", "packs"]


def test_suffixes_are_looked_up():
    assert isinstance(stem._STEP2, dict) and len(stem._STEP2) == 20 and len(stem._STEP3) == 7 and len(stem._STEP4) == 18
    assert [stem._shape(w) for w in ("toy", "syzygy", "yy", "bayyy", "")] == [b"cvc", b"cvcvcv", b"cv", b"cvcvc", b""]
    assert [stem.stem(w) for w in ("relational", "conditional", "vietnamization", "replacement", "syzygies", "its'", "1.5s")] == ["relat", "condit", "vietnam", "replac", "syzygi", "its'", "1.5"]


def test_reindex_shuffles_no_old_text(spark, sf_dir):
    rows = [("a::0", "a", "x"), ("a::1", "a", "y"), ("b::0", "b", "z"), ("c::0", "c", "u"), (None, None, "v")]
    table = spark.createDataFrame(rows, "chunk_id string, doc_id string, text string")
    docs = spark.createDataFrame([("a", "new"), ("b", " "), ("a", "new"), (None, "n"), ("q", "q")], "doc_id string, text string")
    known = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), (None,), ("only known",)], "doc_id string")
    chunks = spark.createDataFrame([("a::0", "a", "new")], table.schema)
    key = "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        made = store.reindexed(table, docs, chunks.select("text", "doc_id", "chunk_id"), known)
        assert sorted(map(tuple, made.collect()), key=str) == sorted([*rows[3:], ("a::0", "a", "new")], key=str)
        # the registered query replaces all documents' chunks; rows dealt by key hold the key alone
        for df in (made, QUERIES["reindex_replace"](spark, sf_dir)):
            plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
            dealt = re.findall(r"Exchange\s*\nInput \[(\d+)\].*\nArguments: hashpartitioning", plan)
            assert dealt and set(dealt) == {"1"}
    finally:
        spark.conf.set(key, usual)


def test_reindex_with_many_that_stay(spark, monkeypatch):
    monkeypatch.setattr(store, "BROADCAST_ROWS", 3)
    known = spark.range(9).withColumnRenamed("id", "doc_id")
    table = known.select(F.concat("doc_id", F.lit("::0")).alias("chunk_id"), "doc_id", F.lit("t").alias("text"))
    for gone in (0, 2, 5, 6, 9):
        made = store.delete_documents(table, known.where(F.col("doc_id") < gone), known)
        assert sorted(r.doc_id for r in made.collect()) == list(range(gone, 9))
        assert ("LeftSemi" in plan_of(made)) == (9 - gone <= 3)
