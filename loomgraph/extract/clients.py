"""Model clients: a deterministic offline one, and HTTP clients for three kinds of service."""

from __future__ import annotations

import copy
import hashlib
import json
import math
import re
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loomgraph.config import Settings


class LLMClient(Protocol):
    def complete(self, system: str, user: str, response_format: str = "json", temperature: float = 0.0) -> str: ...

    def count_tokens(self, text: str) -> int: ...


class EmbeddingClient(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class EmbedderError(RuntimeError):
    """The embedder did not answer, so the dimension of its vectors is not known."""


def count_tokens(text: str, model: str = "", path: str | None = None) -> int:
    """Tokens of a text with the ranks of a file in tiktoken's format, or the encoding that tiktoken knows for the model.

    Without either (no file, no network) a quarter of the characters, at least one.
    """
    if path:
        from loomgraph.functions.tokens import RankTokenizer

        return len(RankTokenizer(path).encode(text))
    try:
        import tiktoken

        try:
            encoding = tiktoken.encoding_for_model(model)
        except KeyError:
            encoding = tiktoken.get_encoding("cl100k_base")
        return len(encoding.encode(text, disallowed_special=()))
    except Exception:  # the tables of tiktoken come from the network
        return max(1, len(text) // 4)


class OfflineClient:
    """Rules instead of a model, with the same answers for the same input."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def complete(self, system: str, user: str, response_format: str = "json", temperature: float = 0.0) -> str:
        if response_format != "json":
            lines = [x for x in user.splitlines() if x.startswith("[")]
            return "\n".join(f"{re.sub(r' [(]来源:.*[)]$', '', x)} ^[{m[1]}]" for x in lines if (m := re.search(r"来源:([^)]*)[)]$", x)))
        names = list(dict.fromkeys(re.findall(r"\b[A-Z][A-Za-z0-9_]+\b", user)))
        if "entities" in system:
            return json.dumps({"entities": names})
        said = re.findall(r"\b([A-Z]\w+) (is an?|uses|has|contains|supports) ([A-Za-z]\w+)", user)
        triples = [{"head": h, "relation": re.sub(r"\W+", "_", r), "tail": t, "confidence": "EXTRACTED"} for h, r, t in said]
        concepts = [{"name": n, "description": f"{n} in the text.", "node_type": "concept"} for n in names]
        return json.dumps({"triples": triples, "concepts": concepts})

    def count_tokens(self, text: str) -> int:
        return len(text.split())

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dim
            for word in re.findall(r"\w+", text.lower()) or [""]:
                h = hashlib.sha256(word.encode()).digest()
                v[h[0] % self.dim] += 1.0 if h[1] & 1 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out


class RateLimiter:
    """At least `interval` seconds between calls of this process; 0 is free.

    Tasks that share a limit take turns: of `parts` tasks each starts its calls at every parts-th interval of the
    clock. They need no word of each other, and a task that is run again, wherever, has the turn it had before.
    Hosts keep the limit as far as their clocks agree.
    """

    def __init__(self, interval: float, part: int = 0, parts: int = 1) -> None:
        self.interval, self.part, self.parts, self.lock, self.next = interval, part, parts, threading.Lock(), 0.0

    def acquire(self) -> None:
        if self.interval <= 0:
            return
        with self.lock:
            if self.parts == 1:
                now = time.monotonic()
                time.sleep(max(0.0, self.next - now))
                self.next = max(now, self.next) + self.interval
            else:
                now = time.time()
                turn = max(int(self.next), math.ceil(now / self.interval))
                turn += (self.part - turn) % self.parts
                time.sleep(max(0.0, turn * self.interval - now))
                self.next = turn + 1

    def __reduce__(self):
        return RateLimiter, (self.interval, self.part, self.parts)


def ask_in_turns(rows: DataFrame, client, work: Callable, schema: str) -> DataFrame:
    """rows.mapInPandas(work(client), schema); if the client has a limit, its tasks keep it together by taking turns.

    Each partition of the one stage that asks has a turn of its own, so there are as many as tasks can run at a time.
    Two jobs that ask at the same time don't know of each other.
    """
    limit = getattr(client, "limit", None)
    if limit is None or limit.interval <= 0:
        return rows.mapInPandas(work(client), schema)
    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = copy.copy(client)
        # a union before the stage's end shifts all numbers alike, so they still differ
        own.limit = RateLimiter(limit.interval, TaskContext.get().partitionId() % parts, parts)
        return work(own)(frames)

    return rows.repartition(parts).mapInPandas(run, schema)


def backoff(attempt: int) -> float:
    return min(10.0 * 2**attempt, 120.0)


class HttpClient:
    """provider: openai (and compatible services), anthropic or ollama. Picklable, used on executors."""

    def __init__(self, provider: str, model: str, key: str | None, url: str | None, interval: float = 0.0, retries: int = 3, batch: int = 64, faults: int = 0) -> None:
        self.provider, self.model, self.key, self.retries, self.batch, self.limit = provider, model, key, retries, batch, RateLimiter(interval)
        self.faults = faults
        self.url = (url or {"openai": "https://api.openai.com/v1", "anthropic": "https://api.anthropic.com/v1", "ollama": "http://localhost:11434"}[provider]).rstrip("/")

    def _post(self, path: str, body: dict) -> dict:
        head = {"Content-Type": "application/json"}
        if self.provider == "anthropic":
            head |= {"x-api-key": self.key or "", "anthropic-version": "2023-06-01"}
        elif self.key:
            head["Authorization"] = f"Bearer {self.key}"
        limited = failed = 0
        while True:
            self.limit.acquire()
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url + path, json.dumps(body).encode(), head), timeout=300) as f:
                    return json.load(f)
            except urllib.error.HTTPError as e:
                if e.code == 429 and limited < self.retries:
                    time.sleep(backoff(limited))
                    limited += 1
                elif e.code >= 500 and failed < self.faults:
                    time.sleep(min(2.0**failed, 30.0))
                    failed += 1
                else:
                    raise
            except urllib.error.URLError:
                if failed == self.faults:
                    raise
                time.sleep(min(2.0**failed, 30.0))
                failed += 1

    def count_tokens(self, text: str) -> int:
        return count_tokens(text, self.model)

    def complete(self, system: str, user: str, response_format: str = "json", temperature: float = 0.0) -> str:
        as_json = response_format == "json"
        if self.provider == "anthropic":
            body = {"model": self.model, "max_tokens": 4096, "temperature": temperature, "system": system, "messages": [{"role": "user", "content": user}]}
            if as_json:
                body |= {"tools": [{"name": "answer", "description": "Give the answer.", "input_schema": {"type": "object"}}], "tool_choice": {"type": "tool", "name": "answer"}}
            parts = self._post("/messages", body)["content"]
            used = next((x["input"] for x in parts if x["type"] == "tool_use"), None)
            return json.dumps(used, ensure_ascii=False) if used is not None else "".join(x.get("text", "") for x in parts)
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        if self.provider == "ollama":
            got = self._post("/api/chat", {"model": self.model, "messages": messages, "stream": False, "options": {"temperature": temperature}} | ({"format": "json"} if as_json else {}))
            return got["message"]["content"]
        got = self._post("/chat/completions", {"model": self.model, "messages": messages, "temperature": temperature} | ({"response_format": {"type": "json_object"}} if as_json else {}))
        return got["choices"][0]["message"]["content"] or ""

    def embed(self, texts: list[str]) -> list[list[float]]:
        if self.provider == "ollama":
            return [self._post("/api/embeddings", {"model": self.model, "prompt": t})["embedding"] for t in texts]
        out: list[list[float]] = []
        for at in range(0, len(texts), self.batch):
            got = self._post("/embeddings", {"model": self.model, "input": texts[at : at + self.batch]})["data"]
            out += [x["embedding"] for x in sorted(got, key=lambda x: x["index"])]
        return out


def make_llm(s: Settings) -> LLMClient:
    if s.llm_provider == "offline":
        return OfflineClient()
    if s.llm_provider != "ollama" and not s.llm_api_key:
        raise SystemExit(2)
    return HttpClient(s.llm_provider, s.llm_model, s.llm_api_key, s.llm_base_url, s.llm_request_interval, s.llm_rate_limit_retries, faults=s.llm_max_retries)


def make_embedder(s: Settings) -> EmbeddingClient:
    if s.embedding_provider == "offline":
        return OfflineClient()
    key = s.embedding_api_key or s.llm_api_key
    if s.embedding_provider != "ollama" and not key:
        raise SystemExit(2)
    return HttpClient(s.embedding_provider, s.embedding_model, key, s.embedding_base_url or s.llm_base_url, 0.0, s.llm_rate_limit_retries, s.embedding_batch, s.llm_max_retries)


def probe_dim(client: EmbeddingClient) -> int:
    """Length of the client's vectors. A client that does not answer is an error, never a dimension."""
    try:
        found = len(client.embed(["dimension"])[0])
    except Exception as e:
        raise EmbedderError(f"the embedder does not answer: {e}") from e
    if not found:
        raise EmbedderError("the embedder gives empty vectors")
    return found


NER = 'List the named things of the question as JSON: {"entities": [text, ...]}.'


def question_entities(client: LLMClient, question: str) -> list[str]:
    from loomgraph.functions.text import parse_json_loose

    found = (parse_json_loose(client.complete(NER, question)) or {}).get("entities")
    return [t for x in (found if isinstance(found, list) else []) if isinstance(x, (str, int, float)) and not isinstance(x, bool) and (t := str(x).strip())]
