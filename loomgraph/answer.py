"""Questions: three routes, fusion, context, answer and review. A session keeps its tables cached."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.config import Settings
from loomgraph.extract.clients import EmbeddingClient, LLMClient, make_embedder, make_llm, question_entities
from loomgraph.functions.tokens import RankTokenizer, quarter_count, token_counter
from loomgraph.operators import ann, retrieve, vectors
from loomgraph.progress import NullProgressReporter, ProgressReporter, now
from loomgraph.schemas import HITS
from loomgraph.session import materialise, ship
from loomgraph.snapshot import Store
from loomgraph.sources.files import scan

NO_RESULTS = "未找到相关知识点"
WARNING = "此结论为 AI 推理，建议核实源文件"
SYSTEM = f"Answer from the given context alone, in the question's language, and cite each statement as ^[source file]. Without an answer in it say exactly: {NO_RESULTS}"
ROUTES = {"ask": ("vector",), "search": ("community",), "query": ("graph", "vector", "community")}


class ColdStartError(RuntimeError):
    """There is no compiled base, or no supported raw file."""


@dataclass(frozen=True)
class Answer:
    text: str
    citations: list[str] = field(default_factory=list)
    used_inferred: bool = False
    confidence: str = "AMBIGUOUS"
    review_flagged: bool = False


def compose(question: str, context: str, verdict: dict, client: LLMClient) -> Answer:
    """The answer to a context; without one the model is not asked."""
    import re

    text = client.complete(SYSTEM, f"{context}\n\n{question}", "text") if context.strip() else ""
    if not text.strip():
        return Answer(NO_RESULTS, [], False, verdict["confidence"], verdict["flagged"])
    cited = re.findall(r"\^\[([^\]]+)\]", text)
    if verdict["used_inferred"]:
        text = f"{text}\n\n{WARNING}"
    return Answer(text, cited, verdict["used_inferred"], verdict["confidence"], verdict["flagged"])


class Session:
    """Tables are read once and kept; a route that fails gives no hits."""

    def __init__(self, spark: SparkSession, settings: Settings, client: LLMClient | None = None, embedder: EmbeddingClient | None = None, count: Callable | None = None, reporter: ProgressReporter | None = None, backend: vectors.VectorStoreBackend | None = None) -> None:
        self.spark, self.s, self.reporter = ship(spark), settings, reporter or NullProgressReporter()
        # exact counts where the settings name a file of ranks
        self.count = count or (token_counter(RankTokenizer(settings.token_ranks)) if settings.token_ranks else quarter_count)
        self.store = Store(spark, settings.out_dir)
        self.client, self.embedder = client or make_llm(settings), embedder or make_embedder(settings)
        self.held: dict[str, DataFrame] = {}
        self.index: tuple | None = None
        self.backend = backend
        self.extra: dict[str, Callable[[str, DataFrame], DataFrame]] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self.held:
            self.held[name] = self.store.read(name).persist()
        return self.held[name]

    def register(self, name: str, recall: Callable[[str, DataFrame], DataFrame]) -> None:
        """A route of one's own: a function of question and entities that gives hits."""
        self.extra[name] = recall

    def _check(self) -> None:
        if not self.store.version or scan(self.spark, self.s.raw_dir).select("path").isEmpty():
            raise ColdStartError("build the base first")

    def _vector(self, question: str) -> DataFrame:
        asked = self.embedder.embed([question])[0]
        if self.backend is not None:
            return retrieve.vector_hits(self.backend.search(asked, 10))
        if self.s.vector_index == "ivf" and self.s.vector_metric == "l2":
            return retrieve.vector_hits(self._near(asked))
        return retrieve.vector_hits(vectors.search(self.table("vectors"), asked, 10, self.s.vector_metric))

    def _near(self, asked: list[float]) -> DataFrame:
        """The rows of vectors.search by the index, which is fitted and written once for a session."""
        rows = self.table("vectors")
        if self.index is None:
            fitted = ann.fit(rows.select("id", "embedding"))
            self.index = (fitted, None if fitted is None else ann.assign(rows, fitted))
        fitted, held = self.index
        if fitted is None:
            return vectors.search(rows, asked, 10)
        query = self.spark.createDataFrame([("q", list(map(float, asked)))], "query string, embedding array<float>")
        near = rows.join(ann.search(held, query, fitted, 10).select("id", "distance"), "id")
        return near.withColumn("score", F.greatest(F.lit(0.0), 1 - F.col("distance")))

    def recall(self, question: str, mode: str = "query") -> list[DataFrame]:
        names = [r for r in ROUTES[mode] if mode != "query" or r == "graph" or (r == "vector" and self.s.enable_vector_recall) or (r == "community" and self.s.enable_community_recall)]
        found = question_entities(self.client, question) if {"graph", "community"} & set(names) else []
        entities = self.spark.createDataFrame([(x,) for x in dict.fromkeys(found)], "name string")
        runs: dict[str, Callable[[], DataFrame]] = {"graph": lambda: retrieve.graph_hits(self.table("nodes"), self.table("edges"), entities, self.s), "vector": lambda: self._vector(question), "community": lambda: retrieve.community_hits(self.table("communities"), entities)}
        if mode == "query":
            runs |= {name: partial(recall, question, entities) for name, recall in self.extra.items()}
            names += self.extra
        out = []
        for name in names:
            try:
                if name in ("graph", "community") and not found:
                    continue
                # hits are few; written here, so that a route that fails when it runs fails alone
                out.append(materialise(runs[name](), "hits"))
            except Exception as e:  # a broken route must not stop the others
                logging.getLogger(__name__).warning("route %s failed: %s", name, e)
        return out

    def hits(self, question: str, mode: str = "query") -> DataFrame:
        routes = self.recall(question, mode)
        return retrieve.union_routes(routes) if routes else self.spark.createDataFrame([], HITS)

    def answer(self, question: str, mode: str = "query") -> Answer:
        self._check()
        with self.reporter.stage("recall"):
            hits = self.hits(question, mode)
        with self.reporter.stage("fuse"):
            fused = retrieve.fuse(hits, self.s.max_context_tokens, self.count).persist()
            context = retrieve.context(fused, self.s.max_context_tokens, self.count).first()["context"]
            verdict = retrieve.review(fused, self.s).first().asDict()
        with self.reporter.stage("answer"):
            out = compose(question, context, verdict, self.client)
        if verdict["flagged"]:
            self.store.flag(question, verdict["reason"], verdict["entities"], now())
        fused.unpersist()
        return out

    def search(self, keyword: str) -> DataFrame:
        """Hits of the community route, neither fused nor cut."""
        self._check()
        return self.hits(keyword, "search")

    def keyword_hits(self, words: list[str]) -> DataFrame:
        from loomgraph.operators.keywords import lookup_any

        return lookup_any(self.table("keywords"), words)

    def route_counts(self, question: str, mode: str = "query") -> dict[str, int]:
        return {r["source"]: r["n"] for r in retrieve.route_counts(self.hits(question, mode)).collect()}

    def close(self) -> None:
        for x in self.held.values():
            x.unpersist()
        self.held.clear()

    def counts(self) -> dict[str, int]:
        """Sizes of the tables. Whole tables are not kept for it: counts read only the columns that they need."""
        rows = {t: self.held[t] if t in self.held else self.store.read(t) for t in ("nodes", "edges", "vectors", "communities", "keywords")}
        distinct = {"keywords": rows.pop("keywords").select("keyword"), "sources": rows["edges"].select("source_file").filter("source_file is not null")}
        return {t: x.count() for t, x in rows.items()} | {t: x.distinct().count() for t, x in distinct.items()}
