"""The plug-in interface for predictors: a function from a batch of pairs to one answer per row."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWER = "pair_id long, classification string, confidence string, reasoning string, error string"
# What an answer may say.
CLASSES = ["positive", "negative", "uncertain", "error"]


def predict(pairs: DataFrame, predictor: Callable[[pd.DataFrame], list[str]], batch: int = 256) -> DataFrame:
    """One answer row per pair. The predictor gets ``pair_id`` and both entities as JSON and returns classes.

    A batch that fails, and answers that aren't a known class, become ``error`` rows; other batches go on. The predictor
    is created once per worker if it is a class. Batches run in parallel as partitions do.
    """
    rows = pairs.select("pair_id", F.to_json("left").alias("left"), F.to_json("right").alias("right"))

    def run(frames):
        call = predictor() if isinstance(predictor, type) else predictor
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                try:
                    said, error = list(call(part)), None
                    if len(said) != len(part):
                        raise ValueError("the predictor gave another number of answers")
                except Exception as e:  # noqa: BLE001 - an answer row holds it
                    said, error = ["error"] * len(part), str(e)
                known = [c if c in CLASSES else "error" for c in said]
                yield pd.DataFrame({
                    "pair_id": part["pair_id"], "classification": known, "confidence": None, "reasoning": None,
                    "error": [error or ("unknown class" if k == "error" and c != "error" else None) for k, c in zip(known, said, strict=True)],
                })

    return rows.mapInPandas(run, ANSWER)


def agreement_predictor(batch: pd.DataFrame) -> list[str]:
    """A stand-in without a model: positive if the captions share a word."""
    import json

    def words(text: str | None) -> set[str]:
        return set(((json.loads(text) if text else {}).get("caption") or "").lower().split())

    return ["positive" if words(a) & words(b) else "negative" for a, b in zip(batch["left"], batch["right"], strict=True)]


def two_stage(pairs: DataFrame, first: Callable, second: Callable) -> DataFrame:
    """A second predictor for what the first leaves uncertain or fails on."""
    one = predict(pairs, first)
    open_ = one.where(F.col("classification").isin("uncertain", "error")).select("pair_id")
    two = predict(pairs.join(open_, "pair_id", "left_semi"), second)
    return one.join(open_, "pair_id", "left_anti").unionByName(two)


SAID = "classification string, confidence string, reasoning string"


def parse_response(raw: Column, classes: list[str] = CLASSES[:3]) -> Column:
    """A model's JSON answer as ``classification, confidence, reasoning, error``.

    What can't be read, lacks the class or names another one becomes an ``error`` row that says so; other fields are kept.
    """
    r = F.from_json(raw, SAID)
    error = F.when(raw.isNull(), "no response").when(r["classification"].isNull(), "no classification in the response")
    error = error.when(~r["classification"].isin(classes), F.concat(F.lit("unknown class: "), r["classification"]))
    said = F.when(error.isNull(), r["classification"]).otherwise("error").alias("classification")
    return F.struct(said, r["confidence"].alias("confidence"), r["reasoning"].alias("reasoning"), error.alias("error"))


def tokens_used(usage: Column, responses_api: bool = False) -> Column:
    """``prompt``, ``completion``, ``total`` from the usage of either interface."""
    names = ("input_tokens", "output_tokens") if responses_api else ("prompt_tokens", "completion_tokens")
    return F.struct(*[usage[n].cast("long").alias(k) for n, k in zip((*names, "total_tokens"), ("prompt", "completion", "total"), strict=True)])
