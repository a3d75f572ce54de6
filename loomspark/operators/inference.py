"""Model steps as injected callables with deterministic offline defaults."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark import schemas

LABELS = {"pain point": "pain_point", "idea": "idea"}
Scorer = Callable[[list[str], list[str]], np.ndarray]


def keyword_scorer(texts: list[str], labels: list[str]) -> np.ndarray:
    """Offline stand-in: entailment logits from counts of question marks and exclamation marks."""
    out = np.zeros((len(texts), len(labels)))
    for i, t in enumerate(texts):
        marks = (float(t.count("!")), float(t.count("?")))
        out[i, : len(marks)] = marks[: len(labels)]
    return out


def pick(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Softmax over labels; the first greatest wins, and a row with NaN goes to the first label with 0."""
    bad = np.isnan(logits).any(axis=1)
    safe = np.where(np.isnan(logits), -np.inf, logits)
    top = safe.max(axis=1, keepdims=True)
    with np.errstate(invalid="ignore"):
        e = np.exp(safe - top)
        p = e / e.sum(axis=1, keepdims=True)
    best = np.where(bad, 0, p.argmax(axis=1))
    return best, np.where(bad, 0.0, p[np.arange(len(p)), best])


def classify(df: DataFrame, id_col: str, text_col: str, scorer: Scorer = keyword_scorer, labels: dict[str, str] | None = None, batch: int = 32) -> DataFrame:
    """(row_id, nlp_label, nlp_score): zero-shot labels of texts; a failed batch gives ('none', 0). Empty texts have no row."""
    names = labels or LABELS
    asked, given = list(names), list(names.values())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out_label, out_score = [], []
            texts = pdf["text"].tolist()
            for lo in range(0, len(texts), batch):
                part = texts[lo : lo + batch]
                try:
                    best, score = pick(np.asarray(scorer(part, asked), dtype=np.float64))
                    out_label += [given[b] for b in best]
                    out_score += score.tolist()
                except Exception:  # a model may fail on a batch; the others go on
                    out_label += ["none"] * len(part)
                    out_score += [0.0] * len(part)
            yield pd.DataFrame({"row_id": pdf["row_id"], "nlp_label": out_label, "nlp_score": np.array(out_score, dtype=np.float32)})

    todo = df.select(F.col(id_col).cast("string").alias("row_id"), F.col(text_col).alias("text")).filter("text <> ''")
    return todo.mapInPandas(run, "row_id string, nlp_label string, nlp_score float")


def thresholded(results: DataFrame, least: float = 0.7) -> DataFrame:
    return results.withColumn("is_idea", F.coalesce((F.col("nlp_label") == "idea") & (F.col("nlp_score") > least), F.lit(False)))


def hash_encoder(texts: list[str], width: int) -> np.ndarray:
    """Offline stand-in: signed feature hashing of words."""
    import xxhash

    out = np.zeros((len(texts), width), dtype=np.float32)
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = xxhash.xxh64_intdigest(w)
            out[i, h % width] += 1.0 if h >> 63 else -1.0
    return out


def embed(df: DataFrame, text_col: str, encoder: Callable[[list[str], int], np.ndarray] = hash_encoder, width: int = 384, batch: int = 32) -> DataFrame:
    """The rows with `embedding`: unit vectors of the texts; null texts count as empty, zero vectors stay zero."""

    @F.pandas_udf("array<float>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts, rows = part.fillna("").tolist(), []
            for lo in range(0, len(texts), batch):
                x = np.asarray(encoder(texts[lo : lo + batch], width), dtype=np.float32)
                n = np.linalg.norm(x, axis=1, keepdims=True)
                rows += list(x / np.where(n == 0, 1, n))
            yield pd.Series(rows)

    return df.withColumn("embedding", encode(F.col(text_col)))


class Throttled(Exception):
    """Raised by a client that asks for a pause."""


def offline_analyst(prompt: str) -> str:
    """Offline stand-in for the language model: figures that depend on the prompt only."""
    n = len(prompt)
    return json.dumps(
        {"cluster_summary": prompt.strip()[:60], "is_viable_business": n % 2 == 0, "viability_score": 1 + n % 10, "is_saas": n % 3 == 0, "is_solo_entrepreneur_possible": n % 5 != 0}
    )


def ask(
    df: DataFrame, prompt_col: str, keep: list[str], schema: str = schemas.CLUSTER_ANALYSIS, client: Callable[[str], str] = offline_analyst, tries: int = 3, pause: float = 1.0,
    at_once: int = 50, per_window: int = 0, window: float = 120.0,
) -> DataFrame:
    """Rows of `keep`, the answer's fields by `schema`, and `error`.

    A task keeps `at_once` calls under way. A throttled call is tried again after 2^n seconds and a bit; other errors, and answers that
    are no JSON object, end in `error`. Answers may come in a code fence. With `per_window`, a task starts at most so many
    calls in `window` seconds.
    """
    types = dict(df.dtypes)

    def call(prompt: str) -> tuple[str | None, str | None]:
        for n in range(tries):
            try:
                text = client(prompt).strip()
                if text.startswith("```"):
                    text = text.split("\n", 1)[-1].rsplit("```", 1)[0]
                if not isinstance(json.loads(text), dict):
                    return None, "not an object"
                return text, None
            except Throttled:
                time.sleep(pause * (2**n + random.random()))
            except Exception as e:
                return None, f"{type(e).__name__}: {e}"[:500]
        return None, "throttled"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            started = None
            for pdf in frames:
                prompts, answers = [p or "" for p in pdf["_prompt"]], []
                step = per_window or max(1, len(prompts))
                for lo in range(0, len(prompts), step):
                    if per_window and started is not None:
                        time.sleep(max(0.0, window - (time.monotonic() - started)))
                    started = time.monotonic()
                    answers += pool.map(call, prompts[lo : lo + step])
                yield pdf.drop(columns="_prompt").assign(_answer=[a for a, _ in answers], error=[e for _, e in answers])

    kept = ", ".join(f"`{c}` {types[c]}" for c in keep)
    answered = df.select(*keep, F.col(prompt_col).alias("_prompt")).mapInPandas(run, f"{kept}, _answer string, error string")
    return answered.withColumn("_r", F.from_json("_answer", schema)).select(*keep, "_r.*", "error")


def offline_judge(prompt: str) -> str:
    """Offline stand-in that rates a text by its length, in a fence as models write it."""
    return '```json\n{"score": ' + str(len(prompt) % 11) + ', "reasoning": "length"}\n```'


def rate(df: DataFrame, prompt_col: str, keep: list[str], client: Callable[[str], str] = offline_judge, **how) -> DataFrame:
    """Rows of `keep` with `score` and `reasoning`; a failed call is a score of 0 with the failure as its reason."""
    asked = ask(df, prompt_col, keep, schemas.SCORE, client, **how)
    failed = F.concat(F.lit("failed: "), F.col("error"))
    return asked.select(*keep, F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("reasoning", failed).alias("reasoning"))


def told(df: DataFrame, prompt_col: str, keep: list[str], client: Callable[[str], str], at_once: int = 50) -> DataFrame:
    """Rows of `keep` with `answer`, the client's plain text; null where the call failed. For summaries and yes-or-no questions."""
    types = dict(df.dtypes)

    def call(prompt: str | None) -> str | None:
        try:
            return client(prompt or "")
        except Exception:
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for pdf in frames:
                yield pdf.drop(columns="_prompt").assign(answer=list(pool.map(call, pdf["_prompt"])))

    kept = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return df.select(*keep, F.col(prompt_col).alias("_prompt")).mapInPandas(run, f"{kept}, answer string")


def offline_planner(prompt: str) -> str:
    """Offline stand-in for plans: fenced, and with a lone backslash, as models write them."""
    title = prompt.strip().split("\n")[0][:40].replace("\\", " ").replace('"', " ")
    return '```json\n{"title": "' + title + '", "market_analysis": {"target_market": "a\\c", "trends": ["t"]}}\n```'


def repaired(client: Callable[[str], str]) -> Callable[[str], str]:
    """A client whose answers are mended as `functions.text.repair_json` does it."""
    import re

    def double(m) -> str:
        return m.group() if len(m.group()) > 1 else "\\\\"

    def call(prompt: str) -> str:
        text = re.sub(r"(?m)^```(?:json)?\s*|\s*```$", "", client(prompt).strip())
        return re.sub(r'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})|\\', double, text).strip()

    return call


def cluster_prompt(texts):
    return F.concat(F.lit("- "), F.array_join(F.transform(texts, lambda t: F.regexp_replace(t, "\n", " ")), "\n- "))


def timed(rows: int, seconds: float) -> dict:
    return {"rows": rows, "seconds": seconds, "rows_per_s": rows / seconds if seconds else float("nan")}


def ranked(runs: DataFrame, name: str) -> DataFrame:
    """Runs of models (name, n, seconds) with `rows_per_s`, the fastest first, ties by name; null without a time."""
    rate = F.when(F.col("seconds") > 0, F.col("n") / F.col("seconds"))
    return runs.withColumn("rows_per_s", rate).orderBy(F.desc_nulls_last("rows_per_s"), name)
