"""Hooks for models: batch callables run where the rows are."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Embedder = Callable[[list[str]], list[list[float]]]


def embed_texts(df: DataFrame, text: str, make: Callable[[], Embedder], as_query: bool = False, prefix: str = "query: ", out: str = "embedding") -> DataFrame:
    """Adds the vectors of a text column; ``make`` builds the embedder once per worker. Only queries and probes take the prefix.

    A null text, or a batch for which the embedder fails, has null vectors, which scoring takes as the lexical path.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = make()
        for batch in batches:
            texts = batch.column(text).to_pylist()
            some = [i for i, t in enumerate(texts) if t is not None]
            vectors: list = [None] * len(texts)
            try:
                for i, v in zip(some, embed([prefix + texts[i] if as_query else texts[i] for i in some]), strict=True):
                    vectors[i] = v
            except (RuntimeError, ValueError, OSError):
                vectors = [None] * len(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], [*batch.schema.names, out])

    return df.mapInArrow(run, schema)


RERANKED = "query_id long, status string, place int, chunk_id long, rerank double"


def rerank(candidates: DataFrame, scorer: Callable[[str, Sequence[str]], Sequence | None], picks: bool = False) -> DataFrame:
    """(query_id, status, place, chunk_id, rerank): what ``scorer`` makes of each query's candidates (query_id, question, chunk_id, text).

    Candidates are a bounded pool for each query, given in the order of ``rank`` where there is that column, else of chunk_id.
    ``scorer`` gives a number for each passage, or with ``picks`` the places of those it chooses, best first. Its candidates then come
    as status scored (all that have a number, best first, equal ones in order) or picked (places that exist, each once).
    A query has one row without a candidate if the scorer gives null or raises (failed), or gives none of them (none): the first
    leaves the decision to the scores before, the second is one.
    """
    order = ["rank", "chunk_id"] if "rank" in candidates.columns else ["chunk_id"]

    def chosen(question: str, texts: list[str]) -> tuple[str, list[tuple[int, float | None]]]:
        try:
            given = scorer(question, texts)
        except Exception:  # noqa: BLE001  the callable is the user's; its failure is a result
            given = None
        if given is None:
            return "failed", []
        if picks:
            found = [(int(i), None) for i in dict.fromkeys(given) if 0 <= int(i) < len(texts)]
            return "picked" if found else "none", found
        scores = [(i, float(x)) for i, x in enumerate(given) if x is not None and i < len(texts)]
        return "scored" if scores else "none", sorted(scores, key=lambda pair: -pair[1])

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        status, found = chosen(pdf["question"].iloc[0], pdf["text"].tolist())
        ids, query = pdf["chunk_id"].tolist(), pdf["query_id"].iloc[0]
        rows = [(query, status, place + 1, ids[i], x) for place, (i, x) in enumerate(found)] or [(query, status, None, None, None)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RERANKED.split(", ")]).astype({"place": "Int32", "chunk_id": "Int64", "rerank": "Float64"})

    return candidates.groupBy("query_id").applyInPandas(score, RERANKED)


def summarize(df: DataFrame, fn: Callable[[str, str], str], longest: int = 400) -> DataFrame:
    """(user_id, summary, covered_count, error) from user_id, previous, transcript, covered_count, stop: a failure keeps what was."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                try:
                    text = " ".join(fn(r["previous"] or "", r["transcript"] or "").split())
                    rows.append((r["user_id"], text if len(text) <= longest else text[:longest] + "…", r["stop"], None))
                except Exception as error:  # noqa: BLE001  the callable is the user's; its failure is a result
                    rows.append((r["user_id"], r["previous"], r["covered_count"], type(error).__name__))
            yield pd.DataFrame(rows, columns=["user_id", "summary", "covered_count", "error"])

    return df.select("user_id", "previous", "transcript", "covered_count", "stop").mapInPandas(run, "user_id long, summary string, covered_count long, error string")
