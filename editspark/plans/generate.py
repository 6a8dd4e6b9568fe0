"""From dictations to reports: routing, decoding of model responses, fallback and strict modes, providers.

A provider is a function of one ``Request`` that returns the model's answer as text, raises, or returns nothing.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import report as R
from ..sources.schemas import UPDATES
from .prompts import SYSTEM_EXAMPLES


@dataclass(frozen=True)
class Settings:
    """Runtime options; a key is read from the environment when asked for and never stored with results."""

    model: str = "replay"
    api_key: str = field(default="", repr=False)
    key_variables: tuple[str, ...] = ("GEMINI_API_KEY", "GOOGLE_API_KEY")

    def key(self) -> str:
        return self.api_key.strip() or next((v for n in self.key_variables if (v := os.environ.get(n, "").strip())), "")

    def overridden(self, api_key: str = "", model: str = "") -> Settings:
        return Settings(model or self.model, api_key.strip() or self.api_key, self.key_variables)


@dataclass(frozen=True)
class Request:
    """What a provider is asked: the prompt, the standing instruction, and how to answer."""

    prompt: str
    system: str = ""
    model: str = ""
    key: str = field(default="", repr=False)
    temperature: float = 0.1
    response_type: str = "application/json"


Provider = Callable[[Request], str | None]


class QuotaExhausted(RuntimeError):
    """A provider gave nothing after all its tries."""


def decode(raw: Column) -> Column:
    """``struct<ok, updates, impression>`` of a model's JSON answer.

    A missing ``field_updates`` or ``impression`` is empty, and so are null values in them and a null impression. An explicit null for ``field_updates``, values that
    are neither text nor null, anything that isn't an object, objects that repeat a key and text that isn't JSON are not ok.
    """
    v = F.try_parse_json(raw)
    kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    fields, said = F.try_variant_get(v, "$.field_updates", "variant"), F.try_variant_get(v, "$.impression", "variant")
    entries = F.map_entries(F.try_variant_get(fields, "$", "map<string,variant>"))
    textual = F.forall(entries, lambda e: F.coalesce(F.schema_of_variant(e.value), F.lit("VOID")).isin("STRING", "VOID"))
    fields_ok = fields.isNull() | (F.schema_of_variant(fields).startswith("OBJECT") & F.coalesce(textual, F.lit(False)))
    said_ok = F.coalesce(F.schema_of_variant(said), F.lit("VOID")).isin("STRING", "VOID")
    ok = F.coalesce(kind.startswith("OBJECT") & fields_ok & said_ok, F.lit(False))
    updates = F.transform(entries, lambda e: F.struct(e.key.alias("key"), F.coalesce(F.try_variant_get(e.value, "$", "string"), F.lit("")).alias("value")))
    none = F.array().cast(UPDATES)
    return F.struct(
        ok.alias("ok"), F.when(ok, F.coalesce(updates.cast(UPDATES), none)).otherwise(none).alias("updates"),
        F.when(ok, F.coalesce(F.try_variant_get(said, "$", "string"), F.lit(""))).otherwise("").alias("impression"),
    )


def routed_reports(cases: DataFrame, *more: str) -> DataFrame:
    """``case_id``, the named columns and ``report``: each case's dictation routed to fields by rules and rendered."""
    parsed = cases.withColumn("tmpl", R.parse(F.col("template_content")))
    out = parsed.withColumn("r", R.routed(F.col("tmpl.fields"), F.col("tmpl.impression"), F.col("dictation")))
    return out.select("case_id", *more, R.render(F.col("tmpl"), F.col("r.updates"), F.col("r.impression")).alias("report"))


def reports(cases: DataFrame, responses: DataFrame, strict: bool = False) -> DataFrame:
    """``case_id, report, source, status`` from ``responses(case_id, raw_response)``, one a case at most.

    A usable response is rendered (``source`` model). Otherwise the case falls back to routing by rules (``rules``), or, if ``strict``, has no report and a
    ``status`` that says why: ``no response`` or ``undecodable``.
    """
    rows = cases.select("case_id", "template_content", "dictation").join(responses.select("case_id", "raw_response"), "case_id", "left")
    rows = rows.withColumns({"tmpl": R.parse(F.col("template_content")), "d": decode(F.col("raw_response"))})
    has = F.coalesce(F.col("raw_response") != "", F.lit(False))
    status = F.when(~has, "no response").when(F.col("d.ok"), "ok").otherwise("undecodable")
    by_model = R.render(F.col("tmpl"), F.col("d.updates"), F.col("d.impression"))
    rule = R.routed(F.col("tmpl.fields"), F.col("tmpl.impression"), F.col("dictation"))
    by_rules = F.lit(None).cast("string") if strict else R.render(F.col("tmpl"), rule.updates, rule.impression)
    used = status == "ok"
    return rows.select("case_id", F.when(used, by_model).otherwise(by_rules).alias("report"), F.when(used, "model").otherwise(F.lit(None if strict else "rules")).alias("source"), status.alias("status"))


def rate_limited(e: Exception) -> bool:
    return "429" in str(e) or "RESOURCE_EXHAUSTED" in str(e)


def ask(provider: Provider, request: Request, tries: int = 3, wait_s: float = 5.0) -> str:
    """The answer, or nothing. After a refusal for the rate of calls it is asked again, each time ``wait_s`` later; any other error ends it."""
    for attempt in range(1, tries + 1):
        try:
            return provider(request) or ""
        except Exception as e:
            if not rate_limited(e):
                break
            time.sleep(wait_s * attempt)
    return ""


def insist(provider: Provider, request: Request, rounds: int = 4, wait_s: float = 10.0, **asking) -> str:
    """The answer; asks again while there is none, each time ``wait_s`` later, and raises ``QuotaExhausted`` in the end."""
    for attempt in range(1, rounds + 1):
        if raw := ask(provider, request, **asking):
            return raw
        if attempt < rounds:
            time.sleep(wait_s * attempt)
    raise QuotaExhausted(f"no response after {rounds} attempts")


def paced(provider: Provider, spacing_s: float, task: int, tasks: int) -> Provider:
    """The provider called at the start of time slots only: slots of ``spacing_s`` seconds of the clock belong to the tasks in turn, so that all tasks together make a call a slot at most."""
    last = 0

    def call(request: Request) -> str:
        nonlocal last
        now = int(time.time() / spacing_s) + 1
        last = max(last + tasks, now + (task - now) % tasks)
        time.sleep(max(0.0, last * spacing_s - time.time()))
        return provider(request)

    return call


def call_provider(prompts: DataFrame, provider: Provider, settings: Settings | None = None, system: str = SYSTEM_EXAMPLES, spacing_s: float = 0.0, tasks: int | None = None, **asking) -> DataFrame:
    """``case_id, raw_response``: each prompt asked once for; calls, repeated ones too, ``spacing_s`` apart over all tasks (see ``paced``; machines' clocks must agree).

    With a spacing the prompts are dealt to ``tasks``, as many as run at once if that isn't given. What stays unanswered is an empty response, for ``reports`` to handle. Write the result before
    using it: each use of the table would call again.
    """
    settings = settings or Settings()
    model, key = settings.model, settings.key()
    tasks = tasks or prompts.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calls = paced(provider, spacing_s, TaskContext.get().partitionId(), tasks) if spacing_s > 0 else provider
        for b in batches:
            said = [ask(calls, Request(prompt, system, model, key), **asking) for prompt in b["prompt"]]
            yield pd.DataFrame({"case_id": b["case_id"], "raw_response": said})

    rows = prompts.select("case_id", "prompt")
    return (rows.repartition(tasks) if spacing_s > 0 else rows).mapInPandas(run, "case_id string, raw_response string")


def preflight(provider: Provider, settings: Settings | None = None) -> None:
    """One small call before a batch; raises if the provider doesn't answer."""
    settings = settings or Settings()
    try:
        answer = provider(Request("Reply with: OK", model=settings.model, key=settings.key()))
    except Exception as e:
        raise QuotaExhausted(f"the provider doesn't answer: {e}") from e
    if not answer:
        raise QuotaExhausted("the provider's answer is empty")
