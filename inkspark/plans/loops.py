"""Loops over searches: grade and refine, and research by gaps. Only a few rows of a round reach the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.functions import text as T
from inkspark.functions.plugs import Generator

#: Takes a question, gives id, score, rank and text.
Search = Callable[[str], DataFrame]


def _sample(hits: DataFrame, rows: int, chars: int) -> list[str]:
    return [r.t for r in hits.orderBy("rank").limit(rows).select(F.substring("text", 1, chars).alias("t")).collect()]


def self_correct(question: str, search: Search, generate: Generator, max_retries: int = 2, enabled: bool = True) -> DataFrame:
    """The best graded hits of up to max_retries + 1 searches.

    Each round's first three hits are graded against the question as asked. Correct ends the loop; a
    strictly better grade replaces what is kept; then the question is reworded.
    """
    hits = search(question)
    if not enabled:
        return hits
    best, best_rank, asked = hits, 0, question
    for attempt in range(max_retries + 1):
        if attempt:
            hits = search(asked)
        sample = _sample(hits, 3, 500)
        grade = T.read(generate(f"Grade CORRECT, AMBIGUOUS or INCORRECT.\n{question}\n" + "\n".join(sample)), rank=lambda r: T.grade_rank(T.grade(r))).rank if sample else 0
        if grade > best_rank:
            best, best_rank = hits, grade
        if grade == 3:
            break
        if attempt < max_retries:
            context = "\n".join(x[:200] for x in sample[:2])[:300] or "No results found"
            asked = generate(f"Reword the question.\n{asked}\n{context}").strip() or asked
    return best


@dataclass
class Research:
    """Hits with the largest score of each id, and a row per round."""

    hits: DataFrame
    log: list[dict] = field(default_factory=list)

    def summary(self) -> str:
        """A line for each round: question, confidence, and the first 100 characters of the gap."""
        return "\n".join(f"Round {r['round'] + 1}: {r['question']} (confidence {r['confidence']:.2f}" + (f", gap: {r['gap'][:100]})" if r["gap"] else ")") for r in self.log)


def research(question: str, search: Search, generate: Generator, rounds: int = 3, enough: float = 0.8, k: int = 10) -> Research:
    """Search, ask for gaps, and search for the first of them, until confident, without gaps, or out of rounds.

    An id keeps its largest score; among equals, the round that found it first.
    """
    merged, log, asked = None, [], question
    for i in range(rounds):
        found = search(asked).select("id", F.coalesce("score", F.lit(0.0)).alias("score"), "text", F.struct(F.lit(i).alias("round"), "rank").alias("seen"))
        both = found if merged is None else merged.unionByName(found)
        merged = both.groupBy("id").agg(F.max("score").alias("score"), F.min_by("text", "seen").alias("text"), F.min("seen").alias("seen"))
        first = [r.t for r in merged.orderBy("seen").limit(5).select(F.substring("text", 1, 400).alias("t")).collect()]
        reply = generate(f"CONFIDENCE: 0 to 1, and GAPS.\n{question}\n" + "\n".join(first))
        said = T.read(reply, sure=T.confidence, gap=T.gaps)
        sure, gap = said.sure, said.gap
        log.append({"round": i, "question": asked, "confidence": sure, "gap": gap})
        if sure >= enough or not gap or i == rounds - 1:
            break
        more = T.read(generate(f"Questions for the gap, one a line.\n{gap}"), lines=lambda r: T.numbered_lines(r, 1)).lines
        if not more:
            break
        asked = more[0]
    return Research(merged.orderBy(F.col("score").desc(), "seen").limit(k).select("id", "score", "text"), log)
