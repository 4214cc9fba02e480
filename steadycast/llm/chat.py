"""Chat records of different layouts as canonical turns, and turns as training text.

A record is a JSON object. Its schema fingerprint is a hash of its nested field paths, of all items
of its lists. The names of a record's own fields select a declarative layout by their hash, and in a
layout of lists the names of each item's fields select that item's mapping, so a list may mix
kinds of items. All work is done by DataFrame functions.

Defined cases. Fields named in ``OPTIONAL`` may stand beside those of a layout or an item. A record
that is null, no JSON object, holds a name twice, is of a layout without a mapping, or has an item
without one, gets null turns and keeps its fingerprint, so it can be counted: no turn is left
out or blank because it could not be read. An empty list has no turns. A field that is null gives an
empty text. A text of more than 20,000,000 characters is more than Spark's JSON readers take; its record
has null turns. Null texts and roles of turns are empty. Turns with equal numbers are ordered by
role, then text; repeated turns are kept. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Item:
    """A mapping of list items: the fields that hold role and text, and other names of roles."""

    role: str
    text: str
    names: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Layout:
    """A mapping of records: ``turns`` gives the role and the field of each turn, or ``items`` the field
    that holds a list of turns."""

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    items: str | None = None

    @property
    def fields(self) -> list[str]:
        return [self.items] if self.items else [field for _, field in self.turns]


ITEMS = (
    Item("role", "content"),
    Item("from", "value", (("human", "user"), ("gpt", "assistant"))),
)
LAYOUTS = (
    Layout("messages", items="messages"),
    Layout("exchanges", items="conversations"),
    Layout("prompt", (("user", "prompt"), ("assistant", "response"))),
    Layout("completion", (("user", "prompt"), ("assistant", "completion"))),
    Layout("instruction", (("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("bare_instruction", (("user", "instruction"), ("assistant", "output"))),
)
# Names of fields that say something about a record or a turn and hold none of its text.
OPTIONAL = ("id", "conv_id", "conversation_id", "source", "lang", "model", "name", "weight", "timestamp")
OBJECT = "map<string,variant>"


def _get(value: Column, kind: str) -> Column:
    """A JSON value as ``kind``, null if it is of another."""
    return F.try_variant_get(value, "$", kind)


def _names(fields: Column) -> Column:
    return F.coalesce(F.map_keys(fields), F.array().cast("array<string>"))


def field_paths(record: Column) -> Column:
    """Sorted distinct field paths of a JSON object, ``[]`` standing for the items of a list.

    Two levels are listed, as deep as mappings read, and of a list the fields of all its items; an item
    that is no object is listed as ``field[]``. Texts that look like JSON are texts.
    """
    entries = F.coalesce(F.map_entries(_get(F.try_parse_json(record), OBJECT)), F.array().cast("array<struct<key:string,value:variant>>"))
    inner = F.flatten(F.transform(entries, lambda e: F.concat(_inside(e), _listed(e))))
    return F.array_sort(F.array_distinct(F.concat(F.transform(entries, lambda e: e["key"]), inner)))


def _inside(entry: Column) -> Column:
    return F.transform(_names(_get(entry["value"], OBJECT)), lambda n: F.concat(entry["key"], F.lit("."), n))


def _listed(entry: Column) -> Column:
    items = F.coalesce(_get(entry["value"], "array<variant>"), F.array().cast("array<variant>"))
    names = F.transform(items, lambda i: F.coalesce(F.transform(F.map_keys(_get(i, OBJECT)), lambda n: F.concat(F.lit("[]."), n)), F.array(F.lit("[]"))))
    return F.transform(F.flatten(names), lambda n: F.concat(entry["key"], n))


def fingerprint(record: Column) -> Column:
    """Schema fingerprint: hash of the nested field paths."""
    return _hash(field_paths(record))


def _hash(names: Column) -> Column:
    return F.sha2(F.to_json(names), 256)


def _selector(fields: Column) -> Column:
    """Hash of the sorted names of an object's fields, without optional ones."""
    return _hash(F.array_sort(F.filter(_names(fields), lambda n: ~n.isin(*OPTIONAL))))


def _wanted(names: list[str]) -> Column:
    return _hash(F.array(*[F.lit(n) for n in sorted(names)]))


def _text(value: Column) -> Column:
    return F.coalesce(_get(value, "string"), F.lit(""))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def _item_turn(item: Column, kinds: tuple[Item, ...]) -> Column:
    """The turn of a list item, null without a mapping."""
    fields, out = _get(item, OBJECT), F.lit(None).cast("struct<role:string,text:string>")
    for kind in kinds:
        said = role = _text(fields[kind.role])
        for name, canonical in kind.names:
            role = F.when(said == name, F.lit(canonical)).otherwise(role)
        out = F.when(_selector(fields) == _wanted([kind.role, kind.text]), _turn(role, _text(fields[kind.text]))).otherwise(out)
    return out


def canonical_turns(df: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS, items: tuple[Item, ...] = ITEMS) -> DataFrame:
    """Add ``schema_fingerprint``, ``layout`` and ``turns``; see the module for odd records."""
    out = df.withColumns({"schema_fingerprint": fingerprint(F.col(record)), "_fields": _get(F.try_parse_json(F.col(record)), OBJECT)})
    out = out.withColumn("_selector", _selector(F.col("_fields")))
    fields = F.col("_fields")
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for kind in layouts:
        chosen = F.col("_selector") == _wanted(kind.fields)
        if kind.items:
            mapped = F.transform(_get(fields[kind.items], "array<variant>"), lambda i: _item_turn(i, items))
        else:
            mapped = F.array(*[_turn(F.lit(role), _text(fields[field])) for role, field in kind.turns])
        layout = F.when(chosen, F.lit(kind.name)).otherwise(layout)
        turns = F.when(chosen, mapped).otherwise(turns)
    out = out.withColumn("_turns", turns)
    whole = F.col("_turns").isNotNull() & ~F.exists("_turns", lambda t: t.isNull())
    return out.withColumns({"layout": F.when(whole, layout), "turns": F.when(whole, F.col("_turns")).cast(TURNS)}).drop("_fields", "_selector", "_turns")


# Turn template: "### role: text</turn>\n". Inside texts and roles the two control strings
# are broken up by escapes, and the escape character itself is escaped first.
OPEN, CLOSE = "### ", "</turn>\n"


def escape(text: Column) -> Column:
    """No ``###`` and no ``</turn>`` is left in the result; ``unescape`` gives the text back."""
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    text = F.regexp_replace(text, "#(?=##)", "\\\\h")
    return F.regexp_replace(text, "<(?=/turn>)", "\\\\l")


def unescape(text: Column) -> Column:
    for short, full in (("\\l", "<"), ("\\h", "#"), ("\\c", ":"), ("\\b", "\\")):
        text = F.replace(text, F.lit(short), F.lit(full))
    return text


def format_turns(df: DataFrame, turns: str = "turns", loss_role: str = "assistant") -> DataFrame:
    """Add ``formatted`` and ``loss_spans``: start and length, in code points, of the bodies of
    ``loss_role`` turns. Null turns are formatted as an empty text."""
    marked = F.transform(
        F.coalesce(F.col(turns), F.array().cast(TURNS)),
        lambda t: F.struct(
            F.concat(F.lit(OPEN), F.replace(escape(t["role"]), F.lit(":"), F.lit("\\c")), F.lit(": ")).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == loss_role).alias("loss"),
        ),
    )
    df = df.withColumn("_marked", marked)
    sizes = F.transform("_marked", lambda m: (F.length(m["head"]) + F.length(m["body"]) + len(CLOSE)).cast("long"))
    df = df.withColumn("_sizes", sizes)
    before = lambda i: F.aggregate(F.slice("_sizes", 1, i), F.lit(0).cast("long"), lambda a, x: a + x)
    spans = F.transform(
        "_marked",
        lambda m, i: F.struct(
            m["loss"].alias("loss"),
            (before(i) + F.length(m["head"])).cast("long").alias("start"),
            F.length(m["body"]).cast("long").alias("length"),
        ),
    )
    return df.withColumns(
        {
            "formatted": F.concat_ws("", F.transform("_marked", lambda m: F.concat(m["head"], m["body"], F.lit(CLOSE)))),
            "loss_spans": F.transform(
                F.filter(spans, lambda s: s["loss"]),
                lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")),
            ),
        }
    ).drop("_marked", "_sizes")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text."""
    parts = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    head = "^" + OPEN + "([^:]*): "
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, head, 1)).alias("role"),
            unescape(F.regexp_replace(p, head, "")).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.concat_ws(
        "",
        F.transform(
            spans,
            lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))),
        ),
    )


def turn_rows(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """One record per conversation from rows (key, turn, role, text).

    Two or three turns in the usual order of roles become prompt or instruction records, others
    message lists, so that the rows of one table reach the mappings in several layouts.
    """
    rows = df.select(
        key,
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("content"),
        ).alias("m"),
    )
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list("m")).alias("m"))
    said = lambda i: F.get(F.col("m"), F.lit(i))["content"]
    roles = F.array_join(F.transform("m", lambda m: m["role"]), "\n")
    record = (
        F.when(roles == "user\nassistant", F.to_json(F.struct(said(0).alias("prompt"), said(1).alias("response"))))
        .when(
            roles == "system\nuser\nassistant",
            F.to_json(F.struct(said(0).alias("instruction"), said(1).alias("input"), said(2).alias("output"))),
        )
        .otherwise(
            F.to_json(F.struct(F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages")))
        )
    )
    return grouped.select(key, record.alias("record"))
