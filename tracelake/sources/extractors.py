"""From the text of a document to its records: the one step that a model may do.

An extractor is any object with ``records(kind, text) -> list[dict]``. It is pickled
to the executors and called once a document; what it raises is that document's error
and stops nothing else. Three come with the library: recorded replies, a reader of
plain grids, and one that asks a model through a function of the caller's.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from tracelake.sources import kinds


class Extractor(Protocol):
    def records(self, kind: str, text: str) -> list[dict]: ...


def parsed(reply: str) -> list[dict]:
    """The records of a reply, which may stand in a code fence."""
    text = reply.strip()
    if text.startswith("```"):
        text = text.strip("`").removeprefix("json").strip()
    return json.loads(text)


def text_key(kind: str, text: str) -> str:
    return f"{kind}|{hashlib.sha256(text.encode()).hexdigest()[:16]}"


class Recorded:
    """Replies that were kept, by kind and text."""

    def __init__(self, replies: dict[str, str]):
        self.replies = replies

    def records(self, kind: str, text: str) -> list[dict]:
        return parsed(self.replies[text_key(kind, text)])


class Asked:
    """Asks ``model``, a function from a prompt to a reply. Tasks for exactly the known kinds are required."""

    def __init__(self, model: Callable[[str], str], tasks: dict[str, str] | None = None):
        self.model = model
        self.tasks = {k: v.task for k, v in kinds.KINDS.items()} if tasks is None else tasks
        if odd := set(self.tasks) ^ set(kinds.KINDS):
            raise kinds.KindError(f"tasks and kinds do not match: {', '.join(sorted(odd))}")
        if blank := [k for k, v in self.tasks.items() if not (v or "").strip()]:
            raise kinds.KindError(f"no task for {', '.join(sorted(blank))}")

    def prompt(self, kind: str, text: str) -> str:
        schema = json.dumps(kinds.get(kind).json_schema, ensure_ascii=False)
        rules = "Copy every value as it is written, as a string. Use null for what is blank or not stated. Invent nothing, and leave no row out. Answer with the JSON array alone."
        return f"{self.tasks[kind]}\n\n{rules}\n\nJSON schema of the answer:\n{schema}\n\nDocument:\n{text}"

    def records(self, kind: str, text: str) -> list[dict]:
        return parsed(self.model(self.prompt(kind, text)))


#: What the header cells of a plain grid say about a column: field, words that must all be there.
_HEADERS = {
    "hop_spec": (("target_table", ("target", "table")), ("target_column", ("target", "column")), ("target_datatype", ("target", "type")), ("target_size", ("target", "size")), ("source_table", ("source", "table")), ("source_column", ("source", "column")), ("source_datatype", ("source", "type")), ("source_size", ("source", "size")), ("transformation_type", ("mapping",)), ("transformation_logic", ("notes",)), ("source_role", ("role",))),
    "cloud_sheet": (("table", ("table",)), ("column", ("column",)), ("datatype", ("type",)), ("size", ("length",)), ("nullable", ("null",)), ("description", ("description",))),
}


class Grid:
    """Reads sheets whose header cells name the fields in plain words.

    Lines above the header are metadata; a first line of two cells names the table.
    A row without its own field is skipped. Size and type of a source that has no
    columns of its own are the target's.
    """

    def records(self, kind: str, text: str) -> list[dict]:
        if kind not in _HEADERS:
            raise kinds.KindError(f"a grid holds no {kind}")
        rows = list(csv.reader(io.StringIO(text)))
        own, fields = ("target_column" if kind == "hop_spec" else "column"), kinds.get(kind).fields
        at: dict[str, int] = {}
        for start, row in enumerate(rows):
            cells = [c.strip().lower() for c in row]
            at = {}
            for name, words in _HEADERS[kind]:
                hit = next((i for i, c in enumerate(cells) if all(w in c for w in words) and i not in at.values()), None)
                if hit is not None:
                    at[name] = hit
            if own in at and sum(bool(c) for c in cells) >= 4:
                break
        else:
            return []
        table = rows[0][1].strip() if start and len(rows[0]) > 1 else None
        out = []
        for row in rows[start + 1 :]:
            value = lambda f: (row[at[f]].strip() or None) if f in at and at[f] < len(row) else None  # noqa: B023, E731
            one = {f: value(f) for f in fields}
            if not one[own]:
                continue
            name = "target_table" if kind == "hop_spec" else "table"
            one[name] = one[name] or table
            if kind == "hop_spec":
                one |= {f"source_{x}": one[f"source_{x}"] or one[f"target_{x}"] for x in ("datatype", "size") if f"source_{x}" not in at}
            out.append(one)
        return out


CONVERTED = "content_key string, records string, error string"


def converted(inputs: DataFrame, extractor: Extractor) -> DataFrame:
    """(content_key, records, error) of inputs (content_key, kind, text); records: a JSON array, or else the error says why there are none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, kind, text in zip(batch["content_key"], batch["kind"], batch["text"], strict=True):
                try:
                    out.append((key, json.dumps(extractor.records(kind, text), ensure_ascii=False), None))
                except Exception as e:  # whatever a document does to an extractor is that document's report
                    out.append((key, None, f"extraction failed - {type(e).__name__}: {str(e)[:200]}"))
            yield pd.DataFrame(out, columns=["content_key", "records", "error"])

    return inputs.select("content_key", "kind", "text").mapInPandas(run, CONVERTED)
