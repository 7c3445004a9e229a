"""Structured extraction and question answering through a model client."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry import config
from lexquarry.functions import json as js
from lexquarry.functions import text as tx
from lexquarry.operators import context, search

EXTRACT_PROMPT = """Fragmentos de un documento:

%s

Devuelve solo un objeto JSON con estos campos: %s.
Si un campo no está en los fragmentos, su valor es "No encontrado"."""

ASK_PROMPT = """Pregunta: %s

Fragmentos de un documento:
%s

Devuelve solo un objeto JSON {"answer", "unit", "page", "evidence", "confidence"}, con confidence entre 0 y 1.
Si los fragmentos no responden a la pregunta, answer es null y confidence es 0."""


class ModelClient(Protocol):
    """Sends one prompt; gives the raw response. It is pickled and used on executors."""

    name: str

    def generate(self, prompt: str) -> str: ...


class HttpModel:
    """A local model server's /api/generate; temperature and lengths as fixed here."""

    def __init__(self, url: str, name: str, timeout: float = 300.0):
        self.url, self.name, self.timeout = url.rstrip("/"), name, timeout

    def generate(self, prompt: str) -> str:
        from urllib.request import Request, urlopen

        body = {"model": self.name, "prompt": prompt, "stream": False, "format": "json", "keep_alive": "10m", "options": {"temperature": 0.1, "num_predict": 400}}
        with urlopen(Request(f"{self.url}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"}), timeout=self.timeout) as r:  # noqa: S310
            return json.loads(r.read()).get("response", "{}")


def chosen_models(names: DataFrame, fallback: tuple[str, ...] = config.FALLBACK_MODELS) -> DataFrame:
    """Of a server's models (at, name) those of the family that prompts are made for, else the first, else the fallback; in order."""
    own = names.withColumn("fits", F.contains(F.lower("name"), F.lit(config.MODEL_FAMILY)))
    best = own.agg(F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("at", "name")))).alias("fit"), F.min(F.struct("at", "name")).alias("first"))  # a server's list is short
    told = F.when(F.size("fit") > 0, F.transform("fit", lambda m: m["name"])).when(F.col("first").isNotNull(), F.array(F.col("first")["name"])).otherwise(F.array(*map(F.lit, fallback)))
    return best.select(F.posexplode(told).alias("at", "name"))


class EchoModel:
    """A deterministic stand-in for tests: answers with a given text, or with the prompt's length."""

    name = "echo"

    def __init__(self, response: str | None = None):
        self.response = response

    def generate(self, prompt: str) -> str:
        return json.dumps({"answer": str(len(prompt)), "confidence": 0.5}) if self.response is None else self.response


def generated(prompts: DataFrame, client: ModelClient) -> DataFrame:
    """prompts with raw and error; the prompt column must be called prompt. A call that fails gives its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raws, errors = [], []
            for p in b["prompt"]:
                try:
                    raws.append(client.generate(p))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  reported with the row
                    raws.append(None)
                    errors.append(f"Error al conectar con el modelo IA: {e}")
            yield b.assign(raw=raws, error=errors)

    schema = T.StructType([*prompts.schema.fields, T.StructField("raw", T.StringType()), T.StructField("error", T.StringType())])
    told = prompts.mapInPandas(run, schema)
    return told.withColumn("error", F.when(F.col("error").isNull() & js.salvaged(F.col("raw")).isNull(), config.BAD_JSON).otherwise(F.col("error")))


def extract_values(pages: DataFrame, fields: list[str], client: ModelClient) -> DataFrame:
    """doc_id, values, model_used, pages_consulted, error. Without fields no model is asked and no value given."""
    if not fields:
        none = F.array().cast("array<int>")
        return pages.select("doc_id").distinct().select("doc_id", F.create_map().cast("map<string,string>").alias("values"), F.lit(client.name).alias("model_used"), none.alias("pages_consulted"), F.lit(None).cast("string").alias("error"))
    listed = ", ".join(f'"{f.strip()}"' for f in fields if f.strip())
    told = generated(context.contexts(pages, fields).withColumn("prompt", F.format_string(EXTRACT_PROMPT, F.col("context"), F.lit(listed))), client)
    absent = F.map_from_arrays(F.array(*map(F.lit, dict.fromkeys(fields))), F.array_repeat(F.lit(config.NOT_FOUND), len(dict.fromkeys(fields))))
    return told.select("doc_id", F.when(F.col("error").isNotNull(), absent).otherwise(js.entries(F.col("raw"))).alias("values"), F.lit(client.name).alias("model_used"), F.col("pages_used").alias("pages_consulted"), "error")


def ask(pages: DataFrame, postings: DataFrame, questions: DataFrame, client: ModelClient, vocabulary: DataFrame | None = None) -> DataFrame:
    """Answers to each question (query_id, query) from each document that has evidence; one without any is told so once.

    Only questions with evidence reach the model. vocabulary is as in search().
    """
    hits = search.search(pages, postings, questions, vocabulary=vocabulary)
    seen = context.evidence(hits).join(questions, "query_id")
    told = generated(seen.withColumn("prompt", F.format_string(ASK_PROMPT, F.col("query"), F.col("evidence"))), client)
    doc = pages.schema["doc_id"].dataType
    answers = told.select("query_id", F.col("query").alias("question"), "doc_id", js.guarded(F.col("raw")).alias("a"), "pages_used", "error", F.lit(None).cast("string").alias("reason"))
    answers = answers.select("query_id", "question", "doc_id", "a.*", F.lit(client.name).alias("model_used"), F.col("pages_used").alias("pages_consulted"), "error", "reason")
    blank = tx.stripped(F.coalesce("query", F.lit(""))) == ""
    without = questions.join(seen.select(F.col("query_id").alias("_q")).distinct(), F.col("query_id") == F.col("_q"), "left_anti")
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rest = without.select("query_id", F.col("query").alias("question"), F.lit(None).cast(doc).alias("doc_id"), null("string", "answer"), null("string", "unit"), null("int", "page"), null("string", "evidence"), F.lit(0.0).alias("confidence"), F.lit(client.name).alias("model_used"), F.array().cast("array<int>").alias("pages_consulted"), F.when(blank, config.EMPTY_QUESTION).alias("error"), F.when(~blank, config.NO_EVIDENCE).alias("reason"))
    return answers.unionByName(rest)
