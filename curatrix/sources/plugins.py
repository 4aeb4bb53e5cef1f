"""Services and parsers that a deployment brings along, as functions that run inside tasks.

A failing call never fails the job: its row carries the error."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# A model call's text cap, temperature and time limit; attempts per document; characters below which a parser has failed.
PROMPT_CHARS, TEMPERATURE, TIMEOUT_S, ATTEMPTS, FEW_CHARS = 8000, 0.1, 120, 2, 50
Parser = Callable[[bytes], list[str]]


def page_texts(files: DataFrame, parser: Parser, fallback: Parser | None = None) -> DataFrame:
    """files (path, content) to (path, pages, text, error): pages joined by form feeds; the fallback reads what the parser finds all but empty."""

    def read(content: bytes) -> list[str]:
        try:
            pages = parser(content)
        except Exception:
            if fallback is None:
                raise
            pages = []
        return fallback(content) if fallback and len("\f".join(pages).strip()) <= FEW_CHARS else pages

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                pages, error = [], None
                try:
                    pages = read(bytes(content))
                except Exception as e:  # a broken file is a row, not a failed job
                    error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"path": [path], "pages": [pages], "text": ["\f".join(pages)], "error": [error]})

    return files.select("path", "content").mapInPandas(run, "path string, pages array<string>, text string, error string")


def http_model(url: str, model: str) -> Callable[[str], str]:
    """A model behind an address that takes a prompt as JSON and answers with a field `response`."""

    def call(prompt: str) -> str:
        body = json.dumps({"model": model, "prompt": prompt, "stream": False, "options": {"temperature": TEMPERATURE}}).encode()
        request = urllib.request.Request(url, data=body, headers={"Content-Type": "application/json"}, method="POST")
        with urllib.request.urlopen(request, timeout=TIMEOUT_S) as answer:
            return json.loads(answer.read()).get("response", "")

    return call


def model_answers(prompts: DataFrame, model: Callable[[str], str], key: str, prompt: str = "{text}", attempts: int = ATTEMPTS) -> DataFrame:
    """(key, text) to (key, answer, error), with a second attempt; texts are capped as the service asks for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for own, text in zip(batch[key], batch["text"], strict=True):
                answer = error = None
                for _ in range(attempts):
                    try:
                        answer, error = model(prompt.replace("{text}", (text or "")[:PROMPT_CHARS])), None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                out.append((own, answer, error))
            yield pd.DataFrame(out, columns=[key, "answer", "error"])

    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(key, "text").mapInPandas(run, f"{key} {kind}, answer string, error string")


def histories(turns: DataFrame) -> DataFrame:
    """(conv_id, text): a conversation's turns in order as one prompt."""
    said = F.sort_array(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(said, lambda x: x["line"]), "\n").alias("text"))


def language(guess: Callable[[str], str], x: Column) -> Column:
    """The language a function guesses, `und` where it fails."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str:
            try:
                return guess(t) or "und"
            except Exception:
                return "und"

        return texts.map(one).astype(object)

    return run(x)


def valid_dois(check: Callable[[str], bool], x: Column) -> Column:
    """Of an array of DOIs those a function confirms, as addresses; a DOI whose check fails goes."""

    def holds(doi: str) -> bool:
        try:
            return bool(check(doi))
        except Exception:
            return False

    @F.pandas_udf("array<string>")
    def confirmed(rows: pd.Series) -> pd.Series:
        return rows.map(lambda dois: [] if dois is None else [f"https://doi.org/{d}" for d in dois if holds(d)])

    return confirmed(x)
