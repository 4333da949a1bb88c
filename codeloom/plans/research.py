"""Questions over the chunk table: embedding, cached answers, decomposition, several rounds of retrieval (O-107 to O-109, O-154, O-163, O-165, O-169 to O-174, O-180, O-181)."""

from __future__ import annotations

import hashlib
import json
import queue
import random
import re
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from codeloom.operators import cache, ranking


class Embedder(Protocol):
    name: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    name: str

    def generate(self, prompt: str, system: str | None = None) -> str: ...


class HashEmbedder:
    """Words hashed to signed dimensions, length one: deterministic, needs no model (O-170)."""

    def __init__(self, dimension: int = 64) -> None:
        self.name, self.dimension = f"hash-{dimension}", dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for row, t in zip(out, texts):
            for w in re.findall(r"[^\W_]+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                row[h % self.dimension] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n == 0, 1, n)).tolist()


class EchoGenerator:
    """Answers that depend on the prompt only; stands in where there is no model (O-171)."""

    name = "echo"

    def generate(self, prompt: str, system: str | None = None) -> str:
        first = prompt.strip().split("\n")[0]
        if "sub_questions" in (system or ""):
            return json.dumps({"sub_questions": [{"question": first, "category": "structure"}]})
        return f"Answer to: {first}"


PROVIDERS: dict[str, Callable[[], object]] = {"hash": HashEmbedder, "echo": EchoGenerator}


def provider(name: str) -> object:
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}")
    return PROVIDERS[name]()


def embedded(df: DataFrame, text: str, embedder: Embedder, column: str = "embedding") -> DataFrame:
    """A vector for each text, in Arrow batches (O-170)."""

    @pandas_udf("array<float>")
    def fn(s):
        import pandas as pd

        return pd.Series(embedder.embed(s.fillna("").tolist()))

    return df.withColumn(column, fn(text))


PASSING = ("rate limit", "rate_limit", "overloaded", "503", "502", "429")  # fixed values: what a service says that is busy


def retried(fn: Callable[[], str], attempts: int = 3, base: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Another try after a growing pause, with jitter (O-172)."""
    for k in range(attempts):
        try:
            return fn()
        except Exception as x:
            passing = isinstance(x, (ConnectionError, TimeoutError)) or any(w in str(x).lower() for w in PASSING)
            if k == attempts - 1 or not passing:
                raise
            sleep(base * 2**k * (1 + random.random() / 4))
    raise ValueError("no attempts")


class CachedGenerator:
    """Answers kept in a table of the cache, by the hash of their request or by what is similar enough, unless the temperature is high (O-165, O-166, O-169).

    New answers are kept here and put into the table ``flush`` by ``flush``; ``now`` gives the time entries are judged at.
    """

    def __init__(self, inner: Generator, embedder: Embedder | None = None, table: DataFrame | None = None, ttl: int = 604_800, threshold: float = cache.THRESHOLD, max_temperature: float = cache.MAX_TEMPERATURE, now: Callable[[], datetime] = lambda: datetime.now(timezone.utc).replace(tzinfo=None)) -> None:
        self.inner, self.name, self.embedder, self.table = inner, inner.name, embedder, table
        self.ttl, self.threshold, self.max_temperature, self.now = ttl, threshold, max_temperature, now
        self.new: dict[str, dict] = {}
        self.hits = 0

    def _found(self, prompt: str, system: str | None, key: str) -> str | None:
        if (e := self.new.get(key)) and (self.now() - e["at"]).total_seconds() < self.ttl:
            return e["response"]
        if self.table is None:
            return None
        now = F.lit(self.now()).cast("timestamp_ntz")
        request = self.table.sparkSession.createDataFrame([("r", system, prompt, 0.0)], "request string, system_prompt string, prompt string, temperature double")
        hit = cache.exact(request, self.table, now).join(self.table.select("id", "response"), "id").select("response").first()
        if hit is None and self.embedder is not None:
            hit = cache.similar(self.table, self.embedder.embed([self._text(prompt, system)])[0], self.name, now, self.threshold).select("response").first()
        return hit.response if hit else None

    @staticmethod
    def _text(prompt: str, system: str | None) -> str:
        return f"{system}\n---\n{prompt}" if system else prompt

    def generate(self, prompt: str, system: str | None = None, temperature: float = 0.0) -> str:
        if temperature > self.max_temperature:
            return self.inner.generate(prompt, system)
        key = hashlib.sha256(self._text(prompt, system).encode()).hexdigest()
        found = self._found(prompt, system, key)
        if found is not None:
            self.hits += 1
            return found
        text = self.inner.generate(prompt, system)
        self.new[key] = {"prompt": prompt, "system": system, "response": text, "at": self.now()}
        return text

    def flush(self, max_entries: int = 10_000) -> DataFrame:
        """The table with the new answers in it, after an eviction."""
        rows = [(key, e["system"], e["prompt"], e["response"], 0.0, self.name, self.embedder.embed([self._text(e["prompt"], e["system"])])[0] if self.embedder else None) for key, e in self.new.items()]
        answers = self.table.sparkSession.createDataFrame(rows, "id string, system_prompt string, prompt string, response string, temperature double, model_name string, vector array<float>")
        now = F.lit(self.now()).cast("timestamp_ntz")
        self.table = cache.evicted(cache.put(self.table, answers, now, self.ttl), now, max_entries)
        self.new = {}
        return self.table

    def stream(self, prompt: str, system: str | None = None, size: int = 100) -> Iterator[str]:
        yield from cache.slices(self.generate(prompt, system), size)


GAPS = 'Name what is missing. Return JSON: {"follow_up_queries": [""]}'
# Chunks in all and for each question, questions that may follow.
MOST_FOLLOW_UPS, SUMMARY_FILES, SUMMARY_CHUNKS = 3, 10, 3
DECOMPOSE = 'Split the question. Return JSON: {"sub_questions": [{"question": "", "category": "structure"}]}'
PRESETS = {"quick": (15, 3), "default": (30, 5), "thorough": (50, 8)}


@dataclass
class Research:
    """A question taken apart, retrieved for, and answered; ``trace`` tells of each step and ``cancelled`` is asked before it."""

    chunks: DataFrame
    embedder: Embedder
    generator: Generator
    preset: str = "default"
    cancelled: Callable[[], bool] = lambda: False
    trace: list[dict] = field(default_factory=list)

    def _step(self, kind: str, fn: Callable[[], object]) -> object:
        if self.cancelled():
            raise InterruptedError(kind)
        began = time.time()
        out = fn()
        self.trace.append({"step": kind, "duration_ms": int((time.time() - began) * 1000)})
        return out

    def questions(self, question: str) -> list[str]:
        text = self.generator.generate(question, DECOMPOSE)
        try:
            found = json.loads(text[text.index("{") : text.rindex("}") + 1])["sub_questions"]
        except (ValueError, KeyError, TypeError):
            found = []
        asked = [q["question"] for q in found if isinstance(q, dict) and str(q.get("question", "")).strip()]
        return asked or [question]

    def summary(self, hits: DataFrame) -> str:
        """A line for each of the first files found, with its first chunks (O-103): by best score of the file, at most SUMMARY_FILES x SUMMARY_CHUNKS rows."""
        found = ranking.best_of(hits, "id").join(self.chunks.select("id", "file_path", "name", "chunk_type"), "id")
        rows = ranking.first_n(found, ["file_path"], [F.desc("score"), "id"], SUMMARY_CHUNKS)
        files = rows.groupBy("file_path").agg(F.max("score").alias("best"), F.array_sort(F.collect_list(F.struct("at", "chunk_type", "name"))).alias("x")).orderBy(F.desc("best"), "file_path").limit(SUMMARY_FILES).collect()
        return "\n".join(f"- {r.file_path}: " + ", ".join(f"{c.chunk_type} '{c.name or 'unnamed'}'" for c in r.x) for r in files) or "No code context retrieved."

    def gaps(self, question: str, asked: list[str], hits: DataFrame) -> list[str]:
        """Questions for what the hits lack, at most MOST_FOLLOW_UPS; the question itself where nothing was found (O-108)."""
        summary = self.summary(hits)
        if not summary.startswith("- "):
            return [question]
        listed = "\n".join(f"- {q}" for q in asked)
        text = self.generator.generate(f"{question}\n\nAsked:\n{listed}\n\nFound:\n{summary}", GAPS)
        try:
            found = json.loads(text[text.index("{") : text.rindex("}") + 1]).get("follow_up_queries", [])
        except (ValueError, AttributeError):
            return []
        return [q for q in found if isinstance(q, str) and q.strip()][:MOST_FOLLOW_UPS]

    def hits(self, questions: list[str], k: int) -> DataFrame:
        vectors = self.embedder.embed(questions)
        return ranking.retrieve(self.chunks, list(enumerate(vectors)), k, "id")

    def run(self, question: str) -> dict:
        most, k = PRESETS[self.preset]
        asked = self._step("decompose", lambda: self.questions(question))
        first = self._step("retrieve", lambda: self.hits(asked, k))
        missing = self._step("gap_analysis", lambda: self.gaps(question, asked, first))
        if missing:
            more = self._step("follow_up", lambda: self.hits(missing, ranking.follow_up_k(k)))
            first = first.unionByName(more.withColumn("query", F.col("query") + len(asked)))
        best = ranking.best_of(first, "id", most)
        rows = self._step("rank", lambda: best.join(self.chunks.select("id", "file_path", "name", "chunk_type", "start_line", "end_line", "content"), "id").orderBy(F.desc("score"), "query", "rank").collect())  # ``most`` at most
        context = "\n---\n".join(f"File: {r.file_path}:{r.start_line}-{r.end_line} | {r.chunk_type} | {r.name}\n{r.content}" for r in rows)
        answer = self._step("answer", lambda: retried(lambda: self.generator.generate(f"{question}\n\n{context}")))
        return {"question": question, "sub_questions": asked, "follow_ups": missing, "answer": answer, "sources": [{"file": r.file_path, "start": r.start_line, "end": r.end_line, "type": r.chunk_type, "name": r.name, "score": round(r.score, 4)} for r in rows], "trace": self.trace}


def events_of(research: Research, question: str) -> Iterator[str]:
    """The run of a question as server-sent events: one for each step done, then the result or the error (O-182)."""
    done: queue.Queue[tuple[str, object]] = queue.Queue()

    class Told(list):
        def append(self, step: dict) -> None:
            super().append(step)
            done.put(("step", step))

    def work() -> None:
        try:
            done.put(("result", research.run(question)))
        except Exception as x:  # noqa: BLE001  the one who listens is told
            done.put(("error", {"message": f"{type(x).__name__}: {x}"}))

    research.trace = Told(research.trace)
    threading.Thread(target=work, daemon=True).start()
    while True:
        kind, body = done.get()
        yield f"event: {kind}\ndata: {json.dumps(body, default=str)}\n\n"
        if kind != "step":
            return


def with_history(question: str, history: list[tuple[str, str]], context: str, last: int = 3) -> str:
    """A prompt with the last exchanges of a chat (O-115)."""
    tail = "\n".join(f"Q: {q}\nA: {a}" for q, a in history[-last:])
    return (f"Earlier:\n{tail}\n\n" if tail else "") + f"Context:\n{context}\n\nQuestion: {question}"
