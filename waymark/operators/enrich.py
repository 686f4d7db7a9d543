"""Enrichment by a language model: analyses and translations. A model is any picklable function of texts."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import language, pages
from ..sources.fetch import Fetcher, fetch

#: A prompt goes in, an answer comes out; it may raise.
Model = Callable[[str], str]

#: The template of an analysis; {{BODY}} is replaced by the page's text.
ANALYSIS = (
    "Read the page below and answer with JSON only: site_type (a few words), purpose (one or two sentences), interest_score (1 to 10) and "
    "interest_reasons (short).\n\n{{BODY}}"
)
TRANSLATION = "Translate into English, one line for each line, nothing else:\n\n{{BODY}}"


@dataclass
class HttpModel:
    """A model behind an HTTP endpoint that takes {model, prompt} and returns {response}."""

    url: str
    model: str
    timeout: float = 30.0

    def __call__(self, prompt: str) -> str:
        import urllib.request

        data = json.dumps({"model": self.model, "prompt": prompt, "stream": False}).encode()
        request = urllib.request.Request(self.url, data, {"Content-Type": "application/json"})
        # a long prompt gets more time, up to two minutes
        with urllib.request.urlopen(request, timeout=min(self.timeout + len(prompt) / 2000, 120.0)) as r:
            return json.loads(r.read())["response"]


@dataclass
class Patient:
    """A model that is asked again after failures and rests after a whole row of them failed."""

    inner: Model
    attempts: int = 3
    base: float = 0.5
    rest: float = 60.0
    _until: float = 0.0

    def __call__(self, prompt: str) -> str:
        if time.monotonic() < self._until:
            return ""
        for attempt in range(self.attempts):
            try:
                return self.inner(prompt)
            except Exception:  # noqa: BLE001  an answer that fails is empty
                if attempt + 1 < self.attempts:
                    time.sleep(self.base * 2**attempt)
        self._until = time.monotonic() + self.rest
        return ""


def ask(rows: DataFrame, model: Model, column: str = "prompt") -> DataFrame:
    """Rows with an `answer`; a failure is an empty one. Each partition has its own model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers = []
            for text in b[column]:
                try:
                    answers.append(model(text) if text else "")
                except Exception:  # noqa: BLE001
                    answers.append("")
            yield b.assign(answer=answers)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{fields}, answer string")


def analyse(pending: DataFrame, fetcher: Fetcher, model: Model, template: str = ANALYSIS) -> DataFrame:
    """(ident_hash_hex, analysis) of pending destinations: their pages are fetched by name, else address, stripped and shown
    to the model. Pages that don't come with status 200, and empty answers, give no row; an answer that isn't JSON is wrapped."""
    host = F.coalesce(F.nullif("i2p_dns_name", F.lit("")), F.nullif("b32_addr", F.lit("")))
    urls = pending.where(host.isNotNull()).select("ident_hash_hex", F.concat(F.lit("http://"), host, F.lit("/")).alias("url"))
    got = fetch(urls.select("url").distinct(), fetcher).where("status = 200")
    bodies = urls.join(got, "url").select("ident_hash_hex", pages.strip_html(F.decode("body", "UTF-8")).alias("text")).where("text <> ''")
    prompts = bodies.select("ident_hash_hex", F.replace(F.lit(template), F.lit("{{BODY}}"), F.col("text")).alias("prompt"))
    answers = ask(prompts, model).select("ident_hash_hex", pages.strip_fences(F.col("answer")).alias("answer")).where("answer <> ''")
    return answers.select("ident_hash_hex", language.analysis_json(F.col("answer")).alias("analysis"))


def translate(pending: DataFrame, model: Model, template: str = TRANSLATION) -> DataFrame:
    """(id, content_summary) of pending translations whose text can be translated; empty answers give no row."""
    todo = pending.where(language.needs_translation(F.col("content_summary"))).withColumn("text", language.translation_input(F.col("content_summary"))).where("text <> ''")
    prompts = todo.select("id", "detected_lang", "content_summary", F.replace(F.lit(template), F.lit("{{BODY}}"), F.col("text")).alias("prompt"))
    done = ask(prompts, model).withColumn("answer", language.clean_answer(F.col("answer"))).where("answer <> ''")
    return done.select("id", language.translated_summary(F.col("content_summary"), F.col("answer"), F.col("detected_lang")).alias("content_summary"))
