"""Calls of a text-generating service from the executors, and what is said instead when a call fails.

A prompt's provider is a column, so one batch may go to several. Each task keeps at most `at_once` calls open and each of
its threads one connection; a call has a time limit and is tried again after answers that ask for it (429, 5xx) and broken
connections. No failure stops a batch: the row says what went wrong and carries the dry run's text. Keys are read on the
executors from their environment, unless given; they are in no plan unless given.

A lost task is run again, and so are its calls: write answers before building on them.
"""

from __future__ import annotations

import http.client
import json
import os
import threading
import time
from collections.abc import Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from textveil.operators import restore

ANSWER = "response string, provider string, error string, fell_back boolean, attempts int, seconds double"
AGENT = "textveil/1"


class Provider(NamedTuple):
    """How a service is spoken to: the wire form, its address, the variable that holds its key and whether it needs one."""

    form: str
    url: str
    variable: str
    needs_key: bool
    model: str


# The services' addresses, variables and default models.
PROVIDERS = {
    "anthropic": Provider("messages", "https://api.anthropic.com/v1", "ANTHROPIC_API_KEY", True, "claude-sonnet-4-5"),
    "groq": Provider("chat", "https://api.groq.com/openai/v1", "GROQ_API_KEY", True, "openai/gpt-oss-20b"),
    "openai_compatible": Provider("chat", "http://localhost:11434/v1", "OPENAI_API_KEY", False, "llama3.2"),
}


class Refused(Exception):
    """An answer that is no text; `again` if it is worth another try."""

    def __init__(self, reason: str, again: bool = False) -> None:
        super().__init__(reason)
        self.again = again


def request(provider: Provider, prompt: str, key: str | None, longest: int) -> tuple[str, dict, bytes]:
    """Path behind the provider's address, headers and body of a prompt's call."""
    headers = {"Content-Type": "application/json", "User-Agent": AGENT}
    body: dict = {"model": provider.model, "messages": [{"role": "user", "content": prompt}]}
    if provider.form == "messages":
        body["max_tokens"] = longest
        return "/messages", headers | {"x-api-key": key or "", "anthropic-version": "2023-06-01"}, json.dumps(body).encode()
    return "/chat/completions", headers | {"Authorization": f"Bearer {key or 'none'}"}, json.dumps(body).encode()


def reply(form: str, body: bytes) -> str:
    """The text in a service's answer."""
    try:
        data = json.loads(body)
        if form == "messages":
            return "".join(part.get("text", "") for part in data.get("content", []))
        return data["choices"][0]["message"]["content"]
    except (ValueError, KeyError, IndexError, TypeError, AttributeError) as wrong:
        raise Refused("malformed answer") from wrong


class Client:
    """One worker's connections, one a thread and address."""

    def __init__(self, timeout: float) -> None:
        self.timeout, self.local = timeout, threading.local()

    def post(self, url: str, path: str, headers: dict, body: bytes) -> bytes:
        parts = urlsplit(url)
        held = self.local.__dict__.setdefault("held", {})
        link = held.pop((parts.scheme, parts.netloc), None)
        if link is None:
            kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
            link = kind(parts.netloc, timeout=self.timeout)
        try:
            link.request("POST", parts.path.rstrip("/") + path, body, headers)
            answer = link.getresponse()
            data = answer.read()
        except TimeoutError as wrong:
            link.close()
            raise Refused("timeout", True) from wrong
        except (OSError, http.client.HTTPException) as wrong:
            link.close()
            raise Refused("unreachable", True) from wrong
        held[parts.scheme, parts.netloc] = link
        if answer.status != 200:
            raise Refused(f"HTTP {answer.status}", answer.status == 429 or answer.status >= 500)
        return data


class Caller:
    """Adds a column of struct (ANSWER) with what the providers of some rows say to their prompts.

    provider: a column of names, or one name; a null one is a dry run, without a call. keys: by provider, instead of the
    executors' environment. Any error, also an unknown provider or a missing key, gives the dry run's text with fell_back.
    Null prompts are empty ones. pause: seconds before the second try, doubled for each further one.
    """

    def __init__(
        self, provider: Column | str | None, providers: Mapping[str, Provider] = PROVIDERS, keys: Mapping[str, str] | None = None, at_once: int = 8, timeout: float = 60.0,
        retries: int = 2, pause: float = 0.5, longest: int = 1024,
    ) -> None:
        self.provider = provider if isinstance(provider, Column) else F.lit(provider)
        self.providers, self.keys, self.at_once, self.timeout = dict(providers), None if keys is None else dict(keys), at_once, timeout
        self.retries, self.pause, self.longest = retries, pause, longest

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "provider"}  # columns stay on the driver

    def asks(self, name: str | None) -> bool:
        """Whether a call is made for a row with this provider."""
        provider = self.providers.get(name)
        return provider is not None and (bool(self._key(name, provider)) or not provider.needs_key)

    def _key(self, name: str, provider: Provider) -> str | None:
        return (os.environ.get(provider.variable) if self.keys is None else self.keys.get(name)) or None

    def said(self, client: Client, prompt: str, name: str | None) -> dict:
        """The answer of one call."""
        began, attempts, text, error = time.perf_counter(), 0, None, None
        try:
            if name is not None:
                provider = self.providers.get(name)
                if provider is None:
                    raise Refused("unknown provider")
                key = self._key(name, provider)
                if key is None and provider.needs_key:
                    raise Refused("no key")
                path, headers, body = request(provider, prompt, key, self.longest)
                while text is None:
                    attempts += 1
                    try:
                        text = reply(provider.form, client.post(provider.url, path, headers, body))
                    except Refused as wrong:
                        if not wrong.again or attempts > self.retries:
                            raise
                        time.sleep(self.pause * 2 ** (attempts - 1))
        except Exception as wrong:  # whatever it is, the batch goes on
            error = str(wrong) if isinstance(wrong, Refused) else type(wrong).__name__
        text = restore.DRY_RUN + prompt if text is None else text
        return {"response": text, "provider": name, "error": error, "fell_back": error is not None, "attempts": attempts, "seconds": time.perf_counter() - began}

    def add(self, rows: DataFrame, prompt: Column, into: str = "answer") -> DataFrame:
        """rows with the answers in a column. A map over batches, which no plan duplicates: a row is asked once a run."""
        schema = StructType([*rows.schema.fields, StructField(into, StructType.fromDDL(ANSWER))])
        kind = to_arrow_schema(schema).field(into).type

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            client = Client(self.timeout)
            with ThreadPoolExecutor(self.at_once) as pool:
                for batch in batches:
                    *kept, prompts, names = batch.columns
                    rows_ = list(zip(prompts.to_pylist(), names.to_pylist(), strict=True))
                    # a thread only for those that ask someone, but for the others none
                    answers = pool.map(lambda x: self.said(client, x[0] or "", x[1]), [x for x in rows_ if self.asks(x[1])])
                    told = [next(answers) if self.asks(name) else self.said(client, text or "", name) for text, name in rows_]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(told, kind)], names=[*batch.schema.names[:-2], into])

        asked = rows.select("*", prompt.alias("_prompt"), self.provider.cast("string").alias("_provider"))
        return asked.mapInArrow(run, schema)


def hint(error: Column) -> Column:
    """What to look at after an error; null without one."""
    return (
        F.when(error == "HTTP 403", "the key, the model's permissions of its owner, or the agent's name is refused")
        .when(error == "no key", "set the provider's variable in the executors' environment, or give keys")
        .when(error.isin("unreachable", "timeout"), "is the service running, and reachable from the executors?")
        .when(error == "unknown provider", "name one of the providers, or add it")
        .when(error.isNotNull(), "see the service's own log")
    )
