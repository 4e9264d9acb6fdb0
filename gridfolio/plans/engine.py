"""The engine: one entry point from a question to an exact answer or ranked evidence."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfolio.functions import numeric, text
from gridfolio.operators import keyword, retrieval, structured
from gridfolio.operators.text_index import TextIndex
from gridfolio.operators.vector_index import VectorIndex
from gridfolio.plans import binder, isolation, nl
from gridfolio.plans.cache import Cache


@dataclass
class Answer:
    """What a question got: its intent, the rows, and warnings about parts that weren't applied."""

    intent: str
    rows: DataFrame | None
    kind: str
    warnings: list[str] = field(default_factory=list)


def ask(df: DataFrame, question: str, tie: list[str], maps: bool = False) -> Answer:
    """Answer a question about one table: filter, aggregation, grouping, ranking, list or lookup, as one plan each.

    The condition tree is tried first; where it can't be bound to the table, the looser list and lookup readings
    are. Rows are None if no reading fits, and the question is one for retrieval.
    """
    source = structured.Source(df, maps)
    q = nl.parse(question)
    kind = nl.intent(question)
    warnings = [f"not understood: {part}" for part in q.unparsed]
    order = [F.col(c) for c in tie]
    if q.aggregate and q.group_by and not q.ranking:
        rows = structured.grouped(source, q.aggregate, q.group_by, _metric(source, q), q.tree)
        return Answer(kind, rows, "group_by", warnings)
    if kind == "exact_lookup" and (found := nl.lookup(question)) and not q.aggregate:
        return Answer(kind, structured.looked_up(source, *found, tie), "lookup", warnings)
    if q.ranking and kind in ("ranking", "mixed"):
        return Answer(kind, structured.ranked(source, q.ranking, tie, q.tree), "ranking", warnings)
    if q.aggregate:
        return Answer(kind, structured.aggregated(source, q.aggregate, _metric(source, q), q.tree), "aggregate", warnings)
    if kind in ("filter", "mixed") and q.tree is not None:
        rows = structured.matching(source, q.tree)
        if rows is None and isinstance(q.tree, nl.Condition) and isinstance(q.tree.value, tuple | str):
            rows = structured.listed(source, q.tree.value if isinstance(q.tree.value, str) else " ".join(map(str, q.tree.value)))
        return Answer(kind, rows.orderBy(*order) if rows is not None else None, "filter", warnings)
    return Answer(kind, None, "semantic", warnings)


def _metric(source: structured.Source, q: nl.Question) -> str | None:
    """The column that an aggregate is about: the longest numeric header that the question mentions."""
    numbers = [c for c in source.numeric_columns() if binder.label(c) != binder.label(q.group_by)]
    return binder.by_mention(q.text, numbers) if numbers else None


@dataclass(frozen=True)
class Verdict:
    """What a judge says of the evidence: whether it is enough, how sure that is, what is missing, and a better question."""

    sufficient: bool
    confidence: float = 0.0
    gaps: tuple[str, ...] = ()
    question: str | None = None


#: Words of a question that evidence need not contain.
FILLER = frozenset("a all an and are at by can do does did for from give how in is it list me of on or show tell the there these this to was were what when where which who why with".split())
MAX_SUB_QUERIES, LOOPS = 3, 2
#: A judge that is surer than this ends the loop.
SURE = 0.85


def judged_by_words(question: str, evidence: DataFrame) -> Verdict:
    """The judge at hand offline: evidence is enough when its texts together have all content words of the question."""
    wanted = sorted(set(binder.label(question).split()) - FILLER)
    if not wanted:
        return Verdict(True, 1.0)
    has = [F.max(F.contains(text.label(F.col("text")), F.lit(w)).cast("int")).alias(f"w{i}") for i, w in enumerate(wanted)]
    row = evidence.agg(*has).first()
    gaps = tuple(w for i, w in enumerate(wanted) if not row[i])
    return Verdict(not gaps, 1 - len(gaps) / len(wanted), gaps, " ".join(gaps) or None)


#: Columns of the lists that are fused.
LISTED = ["chunk_id", "document_id", "store", "text", "distance"]


@dataclass
class Engine:
    """Tables, evidence and models of a collection. Models are injected; without them the engine is deterministic.

    ``tables``: name -> (DataFrame, tie-break columns). ``chunks``: chunk_id, document_id, store, text, embedding.
    ``centroids``: store, centroid. With a ``text_index`` or ``vector_index`` of the chunks these are searched instead of all chunks.
    A planner splits a question into sub-questions; a judge looks for gaps in the evidence.
    """

    tables: dict[str, tuple[DataFrame, list[str]]] = field(default_factory=dict)
    chunks: DataFrame | None = None
    embedder: Callable[[str], list[float]] | None = None
    reranker: Callable | None = None
    llm: Callable[[str], dict | None] | None = None
    summarizer: Callable[[str, list[str]], str] | None = None
    centroids: DataFrame | None = None
    text_index: TextIndex | None = None
    vector_index: VectorIndex | None = None
    planner: Callable[[str], list[str]] | None = None
    judge: Callable[[str, DataFrame], Verdict] | None = None
    small_talk: Callable[[str], str] | None = None
    embeddings: Cache = field(default_factory=lambda: Cache(6 * 3600, 5000))
    results: Cache = field(default_factory=lambda: Cache(90, 500))
    #: Seconds that the search of a store, or a reranker, may take before the answer does without it.
    deadline: float = isolation.DEADLINE
    #: What the chunks are now, such as the version of their table: results are remembered for one state only.
    state: Callable[[], Hashable] = lambda: 0
    #: What went wrong in a store or a model without ending a query.
    failures: list[str] = field(default_factory=list)

    def query(self, text: str, table: str | None = None, document_id: str | None = None, document_types: list[str] | None = None, top_k: int | None = None) -> Answer:
        """Small talk gets no evidence; else an exact answer from the tables that fit, else ranked chunks from the stores that the question points to."""
        if nl.is_conversational(text):
            return Answer("conversation", None, "conversation")
        if nl.intent(text) != "semantic_qa":
            found = self.ask_tables(text, [table] if table else None)
            if found:
                return found
        return Answer("semantic_qa", self.retrieve(text, document_id, document_types, top_k), "evidence")

    def ask_tables(self, text: str, names: list[str] | None = None) -> Answer | None:
        """The answer of every table that the question can be bound to.

        One table answers with its rows. Several that answer in the same columns are put together, each row with its ``table``;
        else the first by name answers, and the others are named in a warning.
        """
        answers = {}
        for name, (df, tie) in sorted(self.tables.items()):
            if names is None or name in names:
                found = self._safely(f"table {name}", lambda df=df, tie=tie: ask(df, text, tie))
                if found is not None and found.rows is not None:
                    answers[name] = found
        if not answers:
            return None
        first, best = next(iter(answers.items()))
        if len(answers) == 1:
            return best
        alike = {n: a for n, a in answers.items() if a.kind == best.kind and a.rows.columns == best.rows.columns}
        others = [f"also answered by table {n}" for n in answers if n not in alike]
        if len(alike) == 1:
            return Answer(best.intent, best.rows, best.kind, [*best.warnings, *others])
        rows = [a.rows.withColumn("table", F.lit(n)) for n, a in alike.items()]
        return Answer(best.intent, reduce(lambda x, y: x.unionByName(y), rows), best.kind, [*best.warnings, *others])

    def _safely(self, what: str, make: Callable):
        """What ``make`` gives, or None if it fails. It guards what happens at once: calls of models, and planning; jobs are guarded by ``_ran``."""
        try:
            return make()
        except Exception as e:
            self.failures.append(f"{what}: {type(e).__name__}: {e}")
            return None

    def _ran(self, parts: dict[str, Callable[[], DataFrame | None]]) -> dict[str, DataFrame]:
        """The written results of the parts that end well and in time; the others are recorded as failures."""
        done, failed = isolation.run(self.chunks.sparkSession, parts, self.deadline)
        self.failures += [f"{name}: {what}" for name, what in failed.items()]
        return done

    def _embedded(self, text: str) -> list[float] | None:
        if self.embedder is None:
            return None
        return self._safely("embedding", lambda: self.embeddings.get(text, lambda: list(self.embedder(text))))

    def route(self, text: str, document_types: list[str] | None = None) -> list[str]:
        """The stores to search, by words, then by the centroids of the stores, then by a model."""
        vector = self._embedded(text) if self.centroids is not None else None
        similarities = None
        if vector is not None:
            q = F.array(*[F.lit(float(x)) for x in vector])
            rows = self.centroids.select("store", (1 - numeric.cosine_distance(F.col("centroid"), q)).alias("s")).collect()
            similarities = {r["store"].removesuffix("_store"): r["s"] for r in rows if r["s"] is not None}
        found = self._safely("routing", lambda: nl.classify_stores(text, similarities, self.llm)) or nl.classify_stores(text, similarities)
        return [f"{s}_store" for s in nl.select_stores(document_types, found)]

    def retrieve(self, text: str, document_id: str | None = None, document_types: list[str] | None = None, top_k: int | None = None) -> DataFrame | None:
        """Dense and keyword rankings fused, pooled per store and reranked; the rows are written, and a repeated question reads them again.

        Each search of each store is a job of its own: one that fails while it runs, or takes too long, leaves the rows of the others.
        """
        if self.chunks is None:
            return None
        key = (self.state(), text, document_id, tuple(document_types or ()), top_k)
        return self.results.get(key, lambda: self._retrieved(text, document_id, document_types, top_k))

    def _retrieved(self, text: str, document_id: str | None, document_types: list[str] | None, top_k: int | None) -> DataFrame:
        k, cap = nl.depth(text)
        vector = self._embedded(text)
        parts: dict[str, Callable[[], DataFrame | None]] = {}
        for store in self.route(text, document_types):
            if vector is not None:
                parts[f"vector search of {store}"] = lambda s=store: self._near(vector, k, s, document_id)
            parts[f"keyword search of {store}"] = lambda s=store: self._with_words(text, k, s, document_id)
        none = self.chunks.limit(0).withColumn("distance", F.lit(0.0)).select(*LISTED)
        pooled = retrieval.balanced_pool(retrieval.fuse(self._lists(parts) or [none]), cap, F.col("fused_score").desc())
        rank = lambda scorer: lambda: retrieval.rerank(pooled, text, top_k or k, scorer)
        ranked = self._ran({"reranking": rank(self.reranker)}) if self.reranker is not None else {}
        ranked = ranked or self._ran({"ranking by words": rank(None)})
        return next(iter(ranked.values()), none.withColumn("relevance", F.lit(0.0)))

    def _lists(self, parts: dict[str, Callable[[], DataFrame | None]]) -> list[DataFrame]:
        """The ranked lists that are fused: those of one kind of search, over all stores, are one list."""
        kinds: dict[str, list[DataFrame]] = {}
        for name, rows in self._ran(parts).items():
            kinds.setdefault(name.split(" ")[0], []).append(rows)
        return [reduce(DataFrame.unionByName, kinds[kind]) for kind in ("vector", "keyword") if kind in kinds]

    def _near(self, vector: list[float], k: int, store: str, document_id: str | None) -> DataFrame:
        if self.vector_index is None:
            return retrieval.nearest_per_store(retrieval.of_documents(self.chunks.where(F.col("store") == store), document_id), vector, k).select(*LISTED)
        where = F.col("store") == store if document_id is None else (F.col("store") == store) & (F.col("document_id") == document_id)
        return self.vector_index.nearest(vector, k, where=where).select(*LISTED)

    def _with_words(self, text: str, k: int, store: str, document_id: str | None) -> DataFrame:
        rows = retrieval.of_documents(self.chunks.where(F.col("store") == store), document_id)
        # The index ranks whole stores: a single document is scanned.
        if self.text_index is None or document_id is not None:
            return keyword.search(rows, text, k).select(*LISTED)
        found = self.text_index.search(text, k).where(F.col("store") == store).select(F.col("id").alias("chunk_id"), "distance")
        return rows.join(F.broadcast(found), "chunk_id").select(*LISTED)

    def agentic(self, text: str, sub_queries: Callable[[str], list[str]] | None = None, enough: Callable[[DataFrame], bool] | None = None, loops: int = LOOPS, **kw) -> DataFrame | None:
        """Retrieve for the question and its sub-questions; then, while a judge finds gaps, for the question that it asks instead.

        It ends after ``loops`` rounds, when the evidence is enough, when the judge is sure or asks nothing new. A planner or judge that
        fails ends it as well. A chunk found twice counts once, at its best score.
        """
        split = sub_queries or self.planner
        more = (self._safely("planner", lambda: split(text)) or [] if split else [])[:MAX_SUB_QUERIES]
        asked, todo, out = set(), [text, *more], None
        for _ in range(loops):
            for q in todo:
                found = self.retrieve(q, **kw)
                if found is None:
                    return None
                out = found if out is None else out.unionByName(found)
            asked |= set(todo)
            out = retrieval.best_per_chunk(out)
            if enough is not None:
                verdict = Verdict(bool(self._safely("judge", lambda: enough(out))), question=None)
            else:
                verdict = self._safely("judge", lambda: (self.judge or judged_by_words)(text, out)) or Verdict(True)
            if verdict.sufficient or verdict.confidence >= SURE or not verdict.question or verdict.question in asked:
                break
            todo = [verdict.question]
        return out

    def answer(self, text: str, **kw) -> dict:
        """Text, citations and confidence; without a summariser the first five chunks, cut, with a floor of 0.5."""
        if nl.is_conversational(text):
            return {"answer": self.small_talk(text) if self.small_talk else "", "citations": [], "confidence": 1.0}
        evidence = self.retrieve(text, **kw)
        rows = evidence.orderBy(F.col("relevance").desc(), "chunk_id").limit(5).collect() if evidence is not None else []
        if not rows:
            return {"answer": "", "citations": [], "confidence": 0.0}
        scores = sorted((r["relevance"] for r in rows), reverse=True)
        confidence = 0.6 * scores[0] + 0.4 * sum(scores[:3]) / len(scores[:3])
        texts = [r["text"][:400] for r in rows]
        made = self._safely("summary", lambda: self.summarizer(text, texts)) if self.summarizer else None
        confidence = confidence if made else max(0.5, confidence)
        return {"answer": made or "\n\n".join(texts), "citations": [r["chunk_id"] for r in rows], "confidence": round(confidence, 4)}

    def events(self, text: str, **kw) -> Iterator[str]:
        """The answer as server-sent events: a status, the tokens of the answer, and the whole of it; an error is an event too."""
        line = lambda kind, **data: f"data: {json.dumps({'type': kind, **data})}\n\n"
        yield line("status", stage="retrieve")
        try:
            found = self.answer(text, **kw)
            for token in re.findall(r"\S+\s*", found["answer"]):
                yield line("token", text=token)
            yield line("done", **found)
        except Exception as e:
            yield line("error", message=f"{type(e).__name__}: {e}")
