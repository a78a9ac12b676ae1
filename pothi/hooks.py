"""What a caller may plug in, and the settings of retrieval; every hook fails open.

Models are called by the plugged functions only; nothing here reaches a network
or reads the environment.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pothi.operators.retrieval import top

INTENTS = ("doctrinal", "narrative", "navigational")
_DEVANAGARI = re.compile("[ऀ-ॿ]")


@dataclass(frozen=True)
class Settings:
    """Settings of retrieval; budgets are passages by mode."""

    rerank: bool = False
    rerank_candidates: int = 100
    quality_weights: bool = False
    small_to_big: bool = True
    rewrite: bool = False
    hypothetical: bool = False
    understand: bool = True
    candidates: int = 100
    balance: float = 0.7
    cap: int = 2
    budgets: dict[str, int] = field(default_factory=lambda: {"qa": 12, "pravachan": 15, "reading": 5, "reading-qa": 12})

    def per_source(self, mode: str, scoped: bool) -> int:
        """Passages of one source: the cap, or all there may be when one work is asked for."""
        return self.budgets.get(mode, self.budgets["qa"]) if scoped else self.cap


def asked(hook: Callable[[str], str | None] | None, query: str, keep: int = 512) -> Callable[[str], str | None]:
    """``hook`` remembered for ``keep`` queries; None where it is missing, fails, or gives nothing new."""

    @lru_cache(maxsize=keep)
    def call(text: str) -> str | None:
        try:
            out = hook(text).strip() if hook and text and text.strip() else None
        except Exception:
            return None
        return out if out and out != text.strip() else None

    return call


def rewritten(query: str, rewriter: Callable[[str], str | None] | None) -> str | None:
    """A query said otherwise, by a plugged function."""
    return asked(rewriter, query)(query)


def translated(query: str, translator: Callable[[str], str | None] | None, into_devanagari: bool) -> str | None:
    """A query in the other script; None unless the result has, or hasn't, Devanagari as wanted and the query the other way."""
    if not query or bool(_DEVANAGARI.search(query)) == into_devanagari:
        return None
    out = asked(translator, query)(query)
    return out if out and bool(_DEVANAGARI.search(out)) == into_devanagari else None


def intent_of(found: str, query: str, fallback: Callable[[str], str | None] | None) -> str:
    """An intent, by a plugged function where the cues tell none; ``unknown`` otherwise."""
    guess = asked(fallback, query)(query) if found == "unknown" else found
    return guess if guess in INTENTS else "unknown"


def regenerated(answer: dict, under_cited: bool, regenerate: Callable[[], dict] | None, has_history: bool = False) -> dict:
    """An answer tried once more if it cites too little; the new one counts only if it cites."""
    if not under_cited or has_history or regenerate is None:
        return answer
    try:
        again = regenerate()
    except Exception:
        return answer
    return again if again and again.get("citations") else answer


def reranked(candidates: DataFrame, query: str, key: str, question: str, text: str, rank: str, scorer: Callable[[list[tuple[str, str]]], list[float]] | None, k: int) -> DataFrame:
    """query, key, rank: the first ``k`` candidates by a plugged scorer of (question, text) pairs, in Arrow batches; the order they came in where it is missing or fails."""
    kinds = dict(candidates.dtypes)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = list(zip(pdf[question].fillna(""), pdf[text].fillna("")))
            try:
                values = [float(x) for x in scorer(pairs)] if scorer else []
            except Exception:
                values = []
            good = len(values) == len(pairs)
            yield pd.DataFrame({query: pdf[query], key: pdf[key], "_rank": pdf[rank], "_score": values if good else 0.0, "_failed": not good})

    scored = candidates.select(query, key, question, text, rank).mapInPandas(score, f"{query} {kinds[query]}, {key} {kinds[key]}, _rank int, _score double, _failed boolean")
    failed = scored.groupBy(query).agg(F.max("_failed").alias("_any"))
    # A query of which any batch failed keeps its order whole.
    ordered = scored.join(failed, query).withColumn("_by", F.when(F.col("_any"), -F.col("_rank")).otherwise(F.col("_score")))
    return top(ordered, query, "_by", "_rank", k, "rank").select(query, key, "rank")
