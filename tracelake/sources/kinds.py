"""The kinds of documents that can be read: record fields, reader, header words and what a record means.

A kind is declared once, here, and checked when it is made; one that is declared in
part raises instead of switching a check off.
"""

from __future__ import annotations

from dataclasses import dataclass, field

EXCEL, TEXT = "excel", "text"
#: The roles a source may have.
ROLES = ("value", "join", "condition")


class KindError(ValueError):
    """A kind that is unknown or declared in part."""


@dataclass(frozen=True)
class Kind:
    """fields: every key of a record; never_null: those without nulls; enums: the values a key may have besides null."""

    name: str
    reader: str
    fields: tuple[str, ...]
    never_null: frozenset[str]
    anchors: tuple[tuple[str, ...], ...] | None
    task: str
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self):
        faults = [
            (not self.name, "it has no name"),
            (self.reader not in (EXCEL, TEXT), f"it has the reader {self.reader!r}"),
            (not self.fields, "it has no fields"),
            (not self.never_null <= set(self.fields), "a field that may not be null is not among its fields"),
            (not self.enums.keys() <= set(self.fields), "an enumeration is not among its fields"),
            (self.reader == EXCEL and not self.anchors, "its sheets cannot be counted without header words"),
            (self.reader == TEXT and bool(self.anchors), "a text has no header row"),
            (any(not g for g in self.anchors or ()), "a group of header words is empty"),
            (any(w != w.lower() for g in self.anchors or () for w in g), "header words are compared in lower case"),
            (not self.task.strip(), "nothing says what its records are"),
        ]
        for bad, what in faults:
            if bad:
                raise KindError(f"kind {self.name!r}: {what}")

    @property
    def schema(self) -> str:
        """The DDL of a record."""
        return ", ".join(f"`{f}` string" for f in self.fields)

    @property
    def json_schema(self) -> dict:
        """The same as a JSON schema: all keys required and no others."""
        one = {f: {"type": "string"} if f in self.never_null else {"type": ["string", "null"]} for f in self.fields}
        for f, values in self.enums.items():
            one[f] = one[f] | {"enum": [*values, None]}
        return {"type": "array", "items": {"type": "object", "properties": one, "required": list(self.fields), "additionalProperties": False}}


def registry(*kinds: Kind) -> dict[str, Kind]:
    names = [k.name for k in kinds]
    if not kinds or len(set(names)) < len(names):
        raise KindError("no kinds, or two of one name")
    return {k.name: k for k in kinds}


#: Record fields, names of kinds, and the words that header cells hold.
KINDS = registry(
    Kind(
        "hop_spec",
        EXCEL,
        ("target_table", "target_column", "target_datatype", "target_size", "source_table", "source_column", "source_datatype", "source_size", "transformation_type", "transformation_logic", "source_role"),
        frozenset({"target_column"}),
        (("target", "đích", "field"), ("source", "nguồn", "from")),
        "A sheet maps the fields of one table to where they are loaded from. Give a record for each pair of a target field and a source field; a field with several sources has several records. "
        "Blank table cells take the name that the lines above the header state. A role is value where the data is copied, join where a table only finds the row, condition where a field is only tested.",
        {"source_role": ROLES},
    ),
    Kind(
        "cloud_sheet",
        EXCEL,
        ("table", "column", "datatype", "size", "nullable", "description"),
        frozenset({"column"}),
        (("column", "trường", "cột"), ("type", "length", "kiểu", "độ dài")),
        "A sheet describes the columns of one table of the final stage. Give a record for each column, from the final stage's own group of columns, with the description in full.",
    ),
    Kind(
        "view_sql",
        TEXT,
        ("target_table", "target_column", "source_schema", "source_table", "source_column", "source_alias", "source_role", "transformation_logic"),
        frozenset({"target_table", "target_column"}),
        None,
        "A script defines one view. Give a record for each pair of a declared column and a source field that its value comes from, or that a subquery in its expression joins by. Names of WITH blocks stand for the tables they read. "
        "The logic of a plain column is direct; otherwise it is the expression as written. A column made by a function alone has no table and no column. Joins and filters of the view itself are no sources.",
        {"source_role": ROLES},
    ),
)


def get(name: str) -> Kind:
    if name not in KINDS:
        raise KindError(f"no kind {name!r}; there are {', '.join(sorted(KINDS))}")
    return KINDS[name]


def anchors(name: str) -> tuple[tuple[str, ...], ...] | None:
    """Header words of a kind of sheets; None for anything else."""
    return KINDS[name].anchors if name in KINDS else None
