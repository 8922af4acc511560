"""Language- and vision-model steps behind one interface.

A provider answers named prompts; RuleProvider answers by rules, without a model, so results repeat. `ask` sends a
table's prompts through Arrow batches and stores the replies in a table, since a retried task would ask again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: what each prompt's reply holds: the key that callers read, and its value if missing
CONTRACTS: Mapping[str, tuple[str, object]] = {
    "toc_detector_single_page": ("toc_detected", "no"),
    "detect_page_index": ("page_index_given_in_toc", "no"),
    "check_if_toc_transformation_is_complete": ("completed", "no"),
    "check_title_appearance": ("answer", "no"),
    "check_title_appearance_in_start": ("start_begin", "no"),
    "single_toc_item_index_fixer": ("physical_index", ""),
    "verify_node_summary": ("faithful", "no"),
    "toc_transformer": ("table_of_contents", []),
}
#: prompts whose reply is plain text, and those whose reply is a list of outline items
TEXT_PROMPTS = ("extract_toc_content", "generate_node_summary", "regenerate_summary_with_missed_topics", "figure_aware_resummarize", "summarize_from_children", "generate_doc_description", "ocr")
OUTLINE_PROMPTS = ("toc_index_extractor", "add_page_number_to_toc", "generate_toc_init", "generate_toc_init_with_hint", "generate_toc_continue")


class Provider(Protocol):
    def reply(self, prompt: str, inputs: Mapping[str, str], temperature: float = 0.0) -> tuple[str, str]:
        """(text, finish reason)."""
        ...


def schedule(attempts: int = 5, first: float = 0.0, step: float = 0.2, most: float = 0.6) -> list[float]:
    """Temperatures of the attempts."""
    return [min(first + step * i, most) for i in range(attempts)]


def with_retries(provider: Provider, prompt: str, inputs: Mapping[str, str], json_mode: bool = False, attempts: int = 5, wait: Callable[[float], None] | None = None) -> tuple[str, str]:
    """A reply after up to `attempts` tries; an exception waits 2 s, a reply that should be JSON and is not is tried again
    at once unless it was cut off; ("", "error") in the end."""
    for t in schedule(attempts):
        try:
            text, reason = provider.reply(prompt, inputs, t)
        except Exception:  # noqa: BLE001  a provider's failure of any kind is tried again
            if wait:
                wait(2.0)
            continue
        if not json_mode or reason in ("length", "max_output_reached") or _parses(text):
            return text, reason
    return "", "error"


def _parses(text: str) -> bool:
    body = re.sub(r"(?s)<think>.*?</think>", "", text or "").strip()
    if body.startswith("```"):
        body = body.removeprefix("```json")
        body = body[: body.rfind("```")] if "```" in body else body
    try:
        json.loads(body)
    except ValueError:
        return False
    return True


def choose(url: str, explicit: str | None = None) -> str:
    """The provider for a URL: `ollama` on its usual port with /v1, else `openai`; an explicit one of three wins."""
    if explicit:
        if explicit not in ("ollama", "openai", "anthropic"):
            raise ValueError(f"unknown provider {explicit!r}")
        return explicit
    return "ollama" if ":11434" in url and "/v1" in url else "openai"


def request_shape(provider: str, model: str, messages: list[dict], json_mode: bool = False, context: int = 32_768, most: int = 8_192, temperature: float = 0.0) -> dict:
    """The body of a request in each provider's form."""
    base = {"model": model, "messages": messages, "temperature": temperature}
    if provider == "ollama":
        return base | {"options": {"num_ctx": context, "num_predict": most}} | ({"format": "json"} if json_mode else {})
    if provider == "anthropic":
        system = "\n\n".join(m["content"] for m in messages if m["role"] == "system")
        return base | {"messages": [m for m in messages if m["role"] != "system"], "max_tokens": most} | ({"system": system} if system else {})
    return base | {"max_tokens": most} | ({"response_format": {"type": "json_object"}} if json_mode else {})


@dataclass
class Prompts:
    """Renderers by name and style; a style that lacks a name falls back to another."""

    styles: dict[str, dict[str, Callable[..., str]]] = field(default_factory=dict)

    def add(self, name: str, render: Callable[..., str], style: str = "plain") -> None:
        self.styles.setdefault(style, {})[name] = render

    def get(self, name: str, style: str = "plain", **inputs: str) -> str:
        if style not in self.styles:
            raise ValueError(f"unknown prompt style {style!r}")
        for s in (style, *self.styles):
            if name in self.styles[s]:
                return self.styles[s][name](**inputs)
        raise KeyError(name)


def task_prompt(table: Mapping[str, Mapping[str, str]], model: str, task: str, explicit: str | None = None) -> str:
    """The prompt of a task for a model; an explicit one wins."""
    if explicit:
        return explicit
    if task not in table.get(model, {}):
        raise ValueError(f"no task {task!r} for {model!r}")
    return table[model][task]


class RuleProvider:
    """Replies by rules: containment for title checks, short lines as headings, first sentences as summaries."""

    heading_words = 8

    def reply(self, prompt: str, inputs: Mapping[str, str], temperature: float = 0.0) -> tuple[str, str]:
        text = " ".join((inputs.get("page_text") or inputs.get("content") or inputs.get("part") or inputs.get("toc_content") or "").split())
        yes = lambda b: "yes" if b else "no"
        if prompt == "check_title_appearance":
            return json.dumps({"answer": yes(self._flat(inputs["title"]) in text.lower())}), "finished"
        if prompt == "check_title_appearance_in_start":
            return json.dumps({"start_begin": yes(text.lower().startswith(self._flat(inputs["title"])))}), "finished"
        if prompt == "toc_detector_single_page":
            return json.dumps({"toc_detected": yes("contents" in text.lower()[:200])}), "finished"
        if prompt == "detect_page_index":
            return json.dumps({"page_index_given_in_toc": yes(re.search(r"\d+\s*$", text))}), "finished"
        if prompt == "check_if_toc_transformation_is_complete":
            return json.dumps({"completed": "yes"}), "finished"
        if prompt == "single_toc_item_index_fixer":
            at = [int(n) for n, body in self.tagged(inputs["content"]) if self._flat(inputs["section_title"]) in " ".join(body.lower().split())]
            return json.dumps({"physical_index": f"<physical_index_{at[0]}>" if at else ""}), "finished"
        if prompt == "verify_node_summary":
            return json.dumps({"faithful": "yes", "missed_topics": []}), "finished"
        if prompt in OUTLINE_PROMPTS:
            items = [{"structure": str(i + 1), "title": t, "physical_index": f"<physical_index_{n}>"} for i, (n, t) in enumerate(self._headings(inputs.get("part") or inputs.get("content") or ""))]
            return json.dumps(items), "finished"
        if prompt == "toc_transformer":
            lines = [x.rsplit(None, 1) for x in (inputs.get("toc_content") or "").splitlines() if x.strip()]
            return json.dumps({"table_of_contents": [{"structure": str(i + 1), "title": x[0].rstrip(": "), "page": int(x[1])} for i, x in enumerate(lines) if len(x) == 2 and x[1].isdigit()]}), "finished"
        if prompt in TEXT_PROMPTS:
            return self.first_sentence(inputs.get("node_text") or inputs.get("child_summaries") or inputs.get("prior_summary") or inputs.get("content") or inputs.get("structure") or ""), "finished"
        raise KeyError(prompt)

    @staticmethod
    def _flat(title: str | None) -> str:
        return " ".join((title or "").lower().split()) or "\x00"

    @staticmethod
    def tagged(text: str) -> list[tuple[str, str]]:
        return re.findall(r"<physical_index_(\d+)>\n(.*?)\n<physical_index_\1>", text, re.DOTALL)

    def _headings(self, text: str) -> list[tuple[str, str]]:
        return [(n, line.strip()) for n, body in self.tagged(text) for line in body.splitlines()[:1] if 0 < len(line.split()) <= self.heading_words]

    @staticmethod
    def first_sentence(text: str) -> str:
        body = text.partition("<<<section-content>>>")[2].partition("<<<context-after>>>")[0] or text
        return re.split(r"(?<=[.!?])\s", body.strip(), maxsplit=1)[0].strip()


def ask(requests: DataFrame, provider: Provider, json_mode: bool = False, keys: Sequence[str] = ("key",)) -> DataFrame:
    """keys, text, reason, n_chars of requests (keys, prompt, inputs as map<string,string>): one reply each.

    Write the result to a table before using it more than once.
    """
    kept = ", ".join(f"`{k}` {requests.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            replies = [with_retries(provider, p, dict(i) if i is not None else {}, json_mode) for p, i in zip(b.column("prompt").to_pylist(), b.column("inputs").to_pylist(), strict=True)]
            told = [pa.array([t for t, _ in replies], pa.string()), pa.array([r for _, r in replies], pa.string()), pa.array([len(t) for t, _ in replies], pa.int32())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *told], [*keys, "text", "reason", "n_chars"])

    return requests.select(*keys, "prompt", "inputs").mapInArrow(run, f"{kept}, text string, reason string, n_chars int")


def request_key(model: str, prompt: Column, temperature: float = 0.0) -> Column:
    """The key of a reply in a table of replies."""
    return F.sha2(F.concat_ws("\x1f", F.lit(model), prompt, F.lit(str(temperature))), 256)


def unanswered(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Requests whose key has no reply yet."""
    return requests.join(replies.select("key"), "key", "left_anti")
