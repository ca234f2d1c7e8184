"""Judges: who says whether two texts mean the same. A judge is a function of a table of pairs, so that its answers may come from a rule, a record or a model service.

A judge takes (asked_id, candidate_id, similarity) and gives the same pairs with ``verdict``, ``confidence`` and ``enrich`` (the asked text says more); pairs without an answer may be missing.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Confidence from which SAME merges without a person (fixed value).
SURE = 0.8


class Judge(Protocol):
    def __call__(self, pairs: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class ThresholdJudge:
    """SAME from one similarity on, DIFFERENT below another, UNSURE between; always sure."""

    same: float
    differ: float

    def __call__(self, pairs: DataFrame) -> DataFrame:
        s = F.col("similarity")
        return pairs.withColumns({"verdict": F.when(s >= self.same, "SAME").when(s < self.differ, "DIFFERENT").otherwise("UNSURE"), "confidence": F.lit(1.0), "enrich": F.lit(False)})


@dataclass(frozen=True)
class RecordedJudge:
    """Answers that were given before: rows (asked_id, candidate_id, verdict, confidence) and maybe enrich; where ``either`` is set, an answer holds in both directions."""

    answers: DataFrame
    either: bool = False

    def __call__(self, pairs: DataFrame) -> DataFrame:
        known = self.answers if "enrich" in self.answers.columns else self.answers.withColumn("enrich", F.lit(False))
        known = known.select("asked_id", "candidate_id", "verdict", "confidence", "enrich")
        if self.either:
            known = known.union(known.select("candidate_id", "asked_id", "verdict", "confidence", "enrich"))
        # Of several answers to one pair the surest counts, then the first by name.
        best = known.groupBy("asked_id", "candidate_id").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "verdict", "enrich")).alias("r"))
        return pairs.join(best.select("asked_id", "candidate_id", "r.verdict", (-F.col("r.c")).alias("confidence"), "r.enrich"), ["asked_id", "candidate_id"], "left")


def judged(pairs: DataFrame, judge: Judge, sure: float = SURE) -> DataFrame:
    """``pairs`` with the judge's answers made safe, and ``kind``: strong (SAME and sure), weak, apart, unsure, or failed.

    No answer is a missing measurement and never a verdict; a verdict that is not known counts as DIFFERENT, no confidence as none, and enrich holds with SAME alone.
    """
    answers = judge(pairs).select("asked_id", "candidate_id", "verdict", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("enrich", F.lit(False)).alias("enrich"))
    rows = pairs.join(answers, ["asked_id", "candidate_id"], "left")
    said = F.when(F.col("verdict").isNull(), None).when(F.col("verdict").isin("SAME", "UNSURE"), F.col("verdict")).otherwise("DIFFERENT")
    rows = rows.withColumn("verdict", said).withColumn("enrich", (F.col("verdict") == "SAME") & F.col("enrich"))
    kind = F.when(F.col("verdict").isNull(), "failed").when(F.col("verdict") == "DIFFERENT", "apart").when(F.col("verdict") == "UNSURE", "unsure").when(F.col("confidence") >= sure, "strong").otherwise("weak")
    return rows.withColumn("kind", kind)
