"""Index and question answering: one plan from documents to tables, one from questions to answers."""

from __future__ import annotations

import atexit
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.errors import ConfigError, StoreError
from quern.functions.text import STOPWORDS, Analyzer, embedding_text
from quern.operators import answer, chunk, embed, fuse, generate, search, store
from quern.plans.config import Config
from quern.sources.tables import Versions, kept, shared_dir
from quern.streaming.events import replayed


class Pipeline:
    """A versioned set of chunks and postings, and plans over it.

    Tables lie in ``store.path``, where another session finds them again, or in a folder of their
    own that goes when the driver ends. Every ``index`` writes a new version and then switches to it, so a
    query sees one version throughout. ``embedder``, ``judge`` and ``client`` are what the
    remote embedder, the judging reranker and the model generator call.
    """

    def __init__(self, spark: SparkSession, config: Config | None = None, embedder=None, judge=None, client: Callable | None = None):
        self.spark, self.config, self.embedder, self.judge, self.client = spark, config or Config(), embedder, judge, client
        if self.config.rerank.provider == "judge" and judge is None:
            raise ConfigError("the reranker judge needs a judge")
        self.analyzer = Analyzer(self.config.lexical.min_token_length, STOPWORDS, self.config.lexical.use_stemming)
        g = self.config.generation
        self.generate = generate.generator(g.provider, client, g.max_sentences, g.min_support, self.analyzer)
        path = self.config.store.path
        self.tables = Versions(spark, path or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
        if not path:
            atexit.register(self._forget)
        self.timings: list[tuple[str, float]] = []

    def _forget(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self.tables.clear()

    @contextmanager
    def timed(self, name: str):
        """Milliseconds of a stage, kept also if it breaks."""
        began = time.perf_counter()
        try:
            yield
        finally:
            self.timings.append((name, (time.perf_counter() - began) * 1000))

    @property
    def chunks(self) -> DataFrame | None:
        return self.tables.read("chunks")

    def _embed(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        e = self.config.embedding
        if e.provider == "remote":
            return embed.remote_embed(rows, key, text, e.dim, self.embedder, e.batch_size)
        if e.provider == "blake2b":
            return embed.hash_embed_blake2b(rows, key, text, e.dim, e.seed)
        vectors = embed.hash_vectors(rows, key, text, e.dim, e.seed)
        zero = F.array_repeat(F.lit(0.0), e.dim)
        return rows.select(key).join(vectors, key, "left").select(key, F.coalesce("vector", zero).alias("vector"))

    def index(self, docs: DataFrame) -> dict:
        """Splits, embeds and puts in place of these documents' old chunks; of equal ids the last by ``seq`` counts, else that with the last text.

        Postings of new chunks are made and those of replaced ones dropped; statistics follow from the postings.
        """
        with self.timed("index"):
            docs = kept(store.last_of_each(docs), "documents")
            c = self.config.chunking
            new = chunk.chunk(docs, c.strategy, **c.options).drop("seq")
            new = kept(new.withColumn("body", embedding_text(F.col("heading"), F.col("text"))), "chunks")
            posts = search.postings(new, "chunk_id", F.col("body"), self.analyzer).select("term", "chunk_id", "tf", "len")
            new = new.join(self._embed(new, "chunk_id", "body"), "chunk_id")
            old, old_posts = self.tables.read("chunks"), self.tables.read("postings")
            if old is not None:
                if sorted(old.columns) != sorted(new.columns):
                    raise StoreError(f"the index has the columns {sorted(old.columns)}, these documents {sorted(new.columns)}")
                gone = old.join(docs.select("doc_id"), "doc_id", "left_semi").select("chunk_id")
                posts = old_posts.join(gone, "chunk_id", "left_anti").select(*posts.columns).unionByName(posts)
                new = store.reindexed(old, docs, new)
            # by term, so that a batch of questions reads the parts of the file with its terms
            version = self.tables.write({"chunks": new, "postings": posts.repartitionByRange("term").sortWithinPartitions("term")})
            count = self.tables.read("chunks", version).count()
        return {"documents": docs.count(), "chunks": count, "chunker": c.strategy, "millis": round(self.timings[-1][1], 2)}

    def delete(self, ids: DataFrame) -> int:
        """Takes out the documents in ids(doc_id); how many chunks went."""
        old, posts = self.tables.read("chunks"), self.tables.read("postings")
        if old is None:
            return 0
        gone = kept(old.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("chunk_id"), "gone")
        self.tables.write({"chunks": store.delete_documents(old, ids), "postings": posts.join(gone, "chunk_id", "left_anti").repartitionByRange("term").sortWithinPartitions("term")})
        return gone.count()

    def clear(self) -> None:
        self.tables.clear()

    def retrieve(self, questions: DataFrame, filters: dict | None = None) -> DataFrame:
        """(qid, chunk_id, score, ranks, rank): both searches, fused and, if asked for, reranked."""
        r, lex, n = self.config.retrieval, self.config.lexical, self.config.rerank
        version = self.tables.current()
        rows, posts = self.tables.read("chunks", version), self.tables.read("postings", version)
        if rows is None:
            raise StoreError("nothing is indexed")
        allowed = rows if not filters else rows.where(search.matches(filters))
        lists = []
        if r.dense_k:
            with self.timed("dense"):
                q = self._embed(questions, "qid", "question")
                near = search.dense_topk(q, allowed, "chunk_id", r.dense_k, self.config.store.metric)
            lists.append(near.select("qid", "chunk_id", "score", "rank", F.lit("dense").alias("source")))
        if lex.enabled and r.lexical_k:
            with self.timed("lexical"):
                asked = kept(search.question_terms(questions, self.analyzer), "asked")
                found = search.bm25_over(posts, asked, "chunk_id", r.lexical_k, None, allowed if filters else None, lex.k1, lex.b)
            lists.append(found.select("qid", "chunk_id", "score", "rank", F.lit("lexical").alias("source")))
        both = lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])
        f = self.config.fusion
        with self.timed("fusion"):
            fused = fuse.fuse(both, "chunk_id", max(r.final_k, n.top_n), f.method, f.k, f.weights)
        if n.provider == "none":
            return fused.where(F.col("rank") <= r.final_k)
        with self.timed("rerank"):
            top = kept(fused.where(F.col("rank") <= n.top_n), "fused")
            texts = top.select("qid", "chunk_id").join(rows.select("chunk_id", F.col("body").alias("text")), "chunk_id")
            again = fuse.judged(texts, questions, "chunk_id", r.final_k, self.judge) if n.provider == "judge" else fuse.rerank(texts, questions, "chunk_id", r.final_k, analyzer=self.analyzer)
        ranks = F.map_concat("ranks", F.map_from_arrays(F.array(F.lit("rerank")), F.array("rank")))
        return again.join(top.select("qid", "chunk_id", "ranks"), ["qid", "chunk_id"]).select("qid", "chunk_id", "score", ranks.alias("ranks"), "rank")

    def packs(self, found: DataFrame) -> DataFrame:
        """The passages of retrieved chunks that fit into the context."""
        g = self.config.generation
        return answer.packed(found.join(self.chunks.select("chunk_id", "doc_id", "text", "heading"), "chunk_id"), g.max_context_chars, g.max_chunk_chars)

    def answers(self, questions: DataFrame, filters: dict | None = None, found: DataFrame | None = None) -> DataFrame:
        """(qid, text, citations, refused, reason) for every question, over what ``retrieve`` gave if it is at hand."""
        found = kept(self.retrieve(questions, filters), "retrieved") if found is None else found
        with self.timed("generation"):
            packs = kept(self.packs(found), "packs")
            return answer.enforced(self.generate(packs, questions), packs, questions, "chunk_id")

    def query(self, question: str, filters: dict | None = None) -> dict:
        """One question's answer, what was retrieved, and milliseconds by stage."""
        before = len(self.timings)
        asked = self.spark.createDataFrame([("q", question)], "qid string, question string")
        found = kept(self.retrieve(asked, filters), "retrieved")
        said = self.answers(asked, filters, found).first()
        return {"query": question, **_answer(said), "retrieved": self._retrieved(found), "timings_ms": {k: round(v, 2) for k, v in self.timings[before:]}}

    def _retrieved(self, found: DataFrame, ranks: bool = True) -> list[dict]:
        rows = found.join(self.chunks.select("chunk_id", "doc_id"), "chunk_id").orderBy("rank").collect()  # final_k rows
        return [{"chunk_id": r.chunk_id, "doc_id": str(r.doc_id), "score": round(r.score, 6)} | ({"ranks": dict(r.ranks)} if ranks else {}) for r in rows]

    def stream(self, question: str, filters: dict | None = None) -> Iterator[tuple[str, object]]:
        """("sources", list), then ("delta", text) pieces that are provisional, then ("answer", dict), which counts."""
        asked = self.spark.createDataFrame([("q", question)], "qid string, question string")
        found = kept(self.retrieve(asked, filters), "retrieved")
        yield "sources", self._retrieved(found, ranks=False)
        packs = kept(self.packs(found), "packs")
        if self.config.generation.provider == "extractive":
            done = _answer(answer.enforced(self.generate(packs, asked), packs, asked, "chunk_id").first())
            for piece in replayed(done["answer"]) if done["answer"] else ():
                yield "delta", piece
            yield "answer", done
            return
        text, claimed, failure = "", [], None
        passages = answer.context(packs).first()
        if passages is not None:
            pieces = generate.ModelStream(self.client(), question, passages["context"])
            for piece in pieces:
                yield "delta", piece
            text, claimed, failure = pieces.text, pieces.claimed, pieces.failure
        said = self.spark.createDataFrame([("q", text, claimed, failure)], "qid string, text string, claimed array<int>, failure string")
        yield "answer", _answer(answer.enforced(said, packs, asked, "chunk_id").first())

    def stats(self) -> dict:
        rows = self.chunks
        n = rows.count() if rows is not None else 0
        c = self.config
        return {"chunks": n, "chunker": c.chunking.strategy, "embedder": c.embedding.provider, "reranker": c.rerank.provider, "generator": c.generation.provider, "status": "ok" if n else "empty"}

    def close(self) -> None:
        """Without a ``store.path`` the index goes."""
        if not self.config.store.path:
            self._forget()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


def _answer(row) -> dict:
    cited = [{"marker": c["marker"], "chunk_id": c["chunk_id"], "doc_id": c["chunk_id"].rsplit("::", 1)[0], "quote": c["quote"]} for c in row["citations"]]
    return {"answer": row["text"], "refused": row["refused"], "reason": row["reason"] or "", "citations": cited}
