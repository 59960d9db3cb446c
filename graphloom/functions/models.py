"""Language models as a protocol, for replies at scale and for tests; clients are optional.

A model turns messages into text. distributed() applies one to a column of prompts in batches of a partition,
some at a time, with retries inside the task, so a failed call is not a failed job.
"""

from __future__ import annotations

import importlib
import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

Messages = list[dict[str, str]]

#: Temperatures of the steps that ask a model, tries of a call, and seconds waited between them.
TEMPERATURES = {"extract_entities": 0.2, "score_entities": 0.2, "score_relations": 0.3, "sufficiency": 0.3, "answer": 0.7, "graph_v1": 0.2, "graph_v2": 0.4}
TRIES, LEAST_WAIT, MOST_WAIT = 3, 1.0, 10.0


class ChatModel(Protocol):
    def generate(self, messages: Messages, **params) -> str: ...
    def generate_stream(self, messages: Messages, **params) -> Iterator[str]: ...
    def batch_generate(self, batch: list[Messages], **params) -> list[str]: ...
    def model_info(self) -> dict: ...


@dataclass
class Function:
    """A model made of a function of the last message: for tests and rules."""

    reply: Callable[[str], str]
    name: str = "function"
    params: dict = field(default_factory=dict)

    def generate(self, messages: Messages, **params) -> str:
        return self.reply(messages[-1]["content"])

    def generate_stream(self, messages: Messages, **params) -> Iterator[str]:
        for word in self.generate(messages, **params).split(" "):
            yield word + " "

    def batch_generate(self, batch: list[Messages], **params) -> list[str]:
        return [self.generate(m, **params) for m in batch]

    def model_info(self) -> dict:
        return {"name": self.name, **self.params}


def retried(call: Callable[[], str], tries: int = TRIES, wait: Callable[[float], None] = time.sleep) -> str:
    """The call's result; after an error it waits a random time that doubles, and after the last try the error is raised."""
    for k in range(tries):
        try:
            return call()
        except Exception:
            if k == tries - 1:
                raise
            wait(random.uniform(LEAST_WAIT, min(MOST_WAIT, LEAST_WAIT * 2 ** (k + 1))))
    raise AssertionError


class ChatCompletions:
    """A client object with the usual chat.completions.create(), such as those of hosted models' own packages."""

    def __init__(self, client, model: str, **params):
        self.client, self.model, self.params = client, model, params

    def generate(self, messages: Messages, **params) -> str:
        made = retried(lambda: self.client.chat.completions.create(model=self.model, messages=messages, **(self.params | params)))
        return made.choices[0].message.content or ""

    def generate_stream(self, messages: Messages, **params) -> Iterator[str]:
        """Parts of a reply as they come; beginning one is tried again after an error, one that has begun is not."""
        for part in retried(lambda: self.client.chat.completions.create(model=self.model, messages=messages, stream=True, **(self.params | params))):
            if part.choices and part.choices[0].delta.content:
                yield part.choices[0].delta.content

    def batch_generate(self, batch: list[Messages], at_once: int = 1, **params) -> list[str]:
        """Replies in the batch's order, `at_once` calls at a time."""
        return together([lambda m=m: self.generate(m, **params) for m in batch], at_once)

    def model_info(self) -> dict:
        return {"name": self.model, **self.params}


def together(calls: list[Callable[[], str]], at_once: int) -> list[str]:
    """The results of calls that wait on others, so many at a time, in their order; the first error is raised."""
    if at_once <= 1 or len(calls) <= 1:
        return [call() for call in calls]
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(lambda call: call(), calls))


#: Hosted services: the package and class of their client, which must be installed, and what a model's name must have to go there if no service is named.
SERVICES = {"azure": ("openai", "AzureOpenAI", "gpt"), "groq": ("groq", "Groq", "llama"), "openai": ("openai", "OpenAI", None)}
DEFAULT_SERVICE = "azure"


def service_of(model: str | None) -> str:
    """The service that a model's name speaks of, without case; the default one if it speaks of none."""
    return next((name for name, (*_, part) in SERVICES.items() if part and part in (model or "").lower()), DEFAULT_SERVICE)


def hosted(model: str, service: str | None = None, client: dict | None = None, **params) -> ChatCompletions:
    """A hosted model by the service's own package. client: what its client is made with (keys, address, version); what is left out the package finds for itself."""
    service = service or service_of(model)
    if service not in SERVICES:
        raise ValueError(f"no service {service}; there are {', '.join(SERVICES)}")
    package, kind, _ = SERVICES[service]
    try:
        made = getattr(importlib.import_module(package), kind)
    except ImportError as e:
        raise ImportError(f"{service} needs the package {package}") from e
    return ChatCompletions(made(**(client or {})), model, **params)


def distributed(prompts: DataFrame, make: Callable[[], ChatModel], column: str = "prompt", system: str | None = None, on_error: str = "raise", at_once: int = 1, **params) -> DataFrame:
    """prompts with reply. make() gives a task its model; on_error="empty" gives a null reply for a call that failed for good. at_once: calls that a task waits on together."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        head = [{"role": "system", "content": system}] if system else []

        def ask(text: str) -> str | None:
            try:
                return model.generate([*head, {"role": "user", "content": text}], **params)
            except Exception:
                if on_error == "empty":
                    return None
                raise

        for pdf in frames:
            yield pdf.assign(reply=together([lambda t=t: ask(t) for t in pdf[column]], at_once))

    return prompts.mapInPandas(run, f"{prompts.schema.simpleString()[7:-1]}, reply string")
