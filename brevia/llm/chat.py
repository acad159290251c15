"""Chat formatting with schema fingerprints; DataFrame functions only.

A layout is a set of nested field paths. Its fingerprint is the hash of the sorted paths. Input that comes as columns
is fingerprinted once from its schema; input that comes as JSON strings is fingerprinted row by row from the paths that
any of its elements has. The fingerprint of the known paths selects a declarative mapping into canonical turns:
array<struct<turn, role, text>>. Where other known paths stand beside a layout's, the first layout is taken whose own
paths are all there, which its fingerprint over these shows; layouts with a system text come before those without. Of JSON
rows the fingerprint over all paths (schema) and the paths that the mapping leaves out (unmapped) are told beside the turns.

The template writes each turn as TURN role newline text END newline. Control strings inside roles and texts get one
U+2060 after their first character; a control string that already holds k of them gets k + 1, so that reading back
removes exactly one.

Defined results: null roles and texts are empty, and empty turns are kept, but for an input or system text beside others; content in
parts is joined, and a part without text stands as its JSON; turns of one conversation stand by turn (null first), ties by role,
then text; repeated rows are turns of their own; a conversation is one text, so its turns are gathered, all null keys
as one; an empty table gives no rows; other columns are ignored; a layout that no mapping knows raises ValueError
(columns) or gives null turns (JSON rows).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, END = "<|turn|>", "<|end|>"
JOINER = "\u2060"
#: What may follow < or [ in a control string.
TAIL = r"(\||/?s>|<?/?SYS>>|/?INST\])"
TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """The leaf paths of a schema: a.b for fields, a[] for elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


@dataclass(frozen=True)
class Layout:
    """paths: what identifies it. turns: (role, path) by turn, before the items; items: (list, role field, text field); flat: a row for
    each turn. roles: renamed ones."""

    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str] | None = None
    roles: tuple[tuple[str, str], ...] = ()
    flat: bool = False

    @property
    def key(self) -> str:
        return fingerprint(list(self.paths))


_ROWS = (
    Layout(("messages[].role", "messages[].content"), items=("messages", "role", "content")),
    Layout(("conversations[].from", "conversations[].value"), items=("conversations", "from", "value"), roles=(("human", "user"), ("gpt", "assistant"))),
    Layout(("instruction", "input", "output"), turns=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout(("instruction", "output"), turns=(("user", "instruction"), ("assistant", "output"))),
    Layout(("prompt", "completion"), turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout(("prompt", "response"), turns=(("user", "prompt"), ("assistant", "response"))),
)
#: Paths whose turn is left out where it is empty.
OPTIONAL = ("input", "system")
LAYOUTS = (Layout(("turn", "role", "text"), flat=True), *[replace(x, paths=("system", *x.paths), turns=(("system", "system"), *x.turns)) for x in _ROWS], *_ROWS)
KNOWN = sorted({p for x in LAYOUTS for p in x.paths})
LISTS = sorted({x.items[0] for x in LAYOUTS if x.items})


def layout_of(paths: list[str]) -> Layout | None:
    """By the fingerprint of the known paths, else by that of a layout's own paths. Parts of a content are one path."""
    paths = [p.split("[].content[]")[0] + "[].content" if "[].content[]" in p else p for p in paths]
    exact = fingerprint([p for p in KNOWN if p in paths])
    own = lambda x: fingerprint([p for p in x.paths if p in paths])
    return next((x for x in LAYOUTS if x.key == exact), None) or next((x for x in LAYOUTS if own(x) == x.key), None)


def _renamed(role: Column, layout: Layout) -> Column:
    for old, new in layout.roles:
        role = F.when(role == old, F.lit(new)).otherwise(role)
    return F.coalesce(role.cast("string"), F.lit(""))


def _turn(k: Column, role: Column, text: Column) -> Column:
    return F.struct(k.cast("bigint").alias("turn"), role.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _mapped(layout: Layout, value, items=None) -> Column:
    """value(path) gives a column for a top-level path; items, for a layout with a list, array<struct<role, text>>."""
    made = [_turn(F.lit(k), F.lit(role), value(path)) for k, (role, path) in enumerate(layout.turns)]
    optional = [k for k, (_, path) in enumerate(layout.turns) if path in OPTIONAL]
    turns = F.filter(F.array(*made), lambda x: ~x["turn"].isin(optional) | (x["text"] != "")) if made else F.array().cast(TURNS)
    if items is None:
        return turns.cast(TURNS)
    return F.concat(turns.cast(TURNS), F.transform(items, lambda x, k: _turn(k + len(made), _renamed(x["role"], layout), x["text"])).cast(TURNS))


def _listed(df: DataFrame, layout: Layout) -> Column:
    """The items of a column: role and text, of a content in parts their texts."""
    name, role, text = layout.items
    kind = df.schema[name].dataType.elementType[text].dataType

    def said(x: Column) -> Column:
        if not isinstance(kind, T.ArrayType):
            return x[text]
        of = (lambda p: F.coalesce(p["text"].cast("string"), F.to_json(p))) if isinstance(kind.elementType, T.StructType) else (lambda p: p)
        return F.array_join(F.transform(x[text], of), "")

    return F.transform(F.col(f"`{name}`"), lambda x: F.struct(x[role].alias("role"), said(x).alias("text")))


def turns_from_columns(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns). Flat turn tables are gathered by key; every other layout has one conversation in a row."""
    have = field_paths(df.drop(key).schema)
    layout = layout_of(have)
    if layout is None:
        raise ValueError(f"no mapping for the field paths {sorted(have)}")
    conv = F.col(f"`{key}`").cast("bigint").alias(key)
    if not layout.flat:
        return df.select(conv, _mapped(layout, lambda p: F.col(f"`{p}`"), _listed(df, layout) if layout.items else None).alias("turns"))
    t = df.select(conv, _turn(F.col("turn"), _renamed(F.col("role"), layout), F.col("text")).alias("t"))
    return t.groupBy(key).agg(F.sort_array(F.collect_list("t")).cast(TURNS).alias("turns"))


def json_paths(raw: Column) -> Column:
    """The sorted paths of a JSON object, of a list's elements those that any of them has."""
    top = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    for name in LISTS:
        items = F.from_json(F.get_json_object(raw, f"$.{name}"), "array<map<string,string>>")
        below = F.flatten(F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x: F.map_keys(x)))
        no_list = F.filter(top, lambda p: p == name)  # noqa: B023
        top = F.concat(F.filter(top, lambda p: p != name), F.coalesce(F.transform(below, lambda k: F.concat(F.lit(f"{name}[]."), k)), no_list))  # noqa: B023
    return F.array_sort(F.array_distinct(top))


def _listed_json(v: Column, layout: Layout) -> Column:
    """The items of a list in a variant: role and text, of a content in parts their texts."""
    name, role, text = layout.items

    def part(p: Column) -> Column:
        own = F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string"))
        return F.coalesce(own, F.try_variant_get(p, "$.text", "string"), F.to_json(p))

    def item(x: Column) -> Column:
        parts = F.when(F.schema_of_variant(F.try_variant_get(x, f"$.{text}", "variant")).startswith("ARRAY"), F.try_variant_get(x, f"$.{text}", "array<variant>"))
        said = F.coalesce(F.array_join(F.transform(parts, part), ""), F.try_variant_get(x, f"$.{text}", "string"))
        return F.struct(F.try_variant_get(x, f"$.{role}", "string").alias("role"), said.alias("text"))

    return F.transform(F.try_variant_get(v, f"$.{name}", "array<variant>"), item)


def turns_from_json(df: DataFrame, json_col: str, key: str = "conv_id") -> DataFrame:
    """(key, layout, turns, schema, unmapped) of JSON rows, whose layouts may differ from row to row; layout is the fingerprint of the
    layout's paths, schema that of all paths of the row, unmapped those that aren't in the turns."""
    paths, layout, raw = F.col("paths"), F.col("layout"), F.col("raw")
    df = df.select(F.col(f"`{key}`"), F.col(f"`{json_col}`").alias("raw")).withColumn("all_paths", json_paths(raw)).withColumn("v", F.try_parse_json("raw"))
    df = df.withColumn("paths", F.array_intersect("all_paths", F.array(*[F.lit(p) for p in KNOWN])))
    hashed = lambda x: F.substring(F.sha2(F.array_join(x, "\n"), 256), 1, 16)
    inside = lambda x: hashed(F.filter("paths", lambda p: p.isin(*x.paths)))
    one_row = [x for x in LAYOUTS if not x.flat]
    exact = F.when(hashed(paths).isin(*[x.key for x in one_row]), hashed(paths))
    df = df.withColumn("layout", F.coalesce(exact, *[F.when(inside(x) == x.key, F.lit(x.key)) for x in one_row]))
    turns, mapped = F.lit(None).cast(TURNS), F.array().cast("array<string>")
    for x in one_row:
        own = _mapped(x, lambda p: F.get_json_object(raw, f"$.{p}"), _listed_json(F.col("v"), x) if x.items else None)
        turns = F.when(layout == x.key, own).otherwise(turns)
        mapped = F.when(layout == x.key, F.array(*[F.lit(p) for p in x.paths])).otherwise(mapped)
    return df.select(F.col(f"`{key}`"), "layout", turns.alias("turns"), hashed(F.col("all_paths")).alias("schema"), F.array_except("all_paths", mapped).alias("unmapped"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])({JOINER}*){TAIL}", f"$1{JOINER}$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[]){JOINER}({JOINER}*){TAIL}", "$1$2$3")


def formatted(turns: Column) -> Column:
    role = lambda t: F.regexp_replace(escape(t["role"]), "\n", "<|line|>")
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(TURN), role(t), F.lit("\n"), escape(t["text"]), F.lit(END + "\n"))), "")


def read_back(text: Column) -> Column:
    """A formatted conversation's turns: array<struct<role, text, loss>>; loss marks what is trained on."""
    pieces = F.slice(F.split(text, r"<\|turn\|>"), 2, 1_000_000_000)

    def parsed(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = p.substr(F.length(role) + 2, F.length(p) - F.length(role) - F.lit(2 + len(END)))
        role = unescape(F.regexp_replace(role, r"<\|line\|>", "\n"))
        return F.struct(role.alias("role"), unescape(body).alias("text"), (role == "assistant").alias("loss"))

    return F.transform(pieces, parsed)


def digests(convs: DataFrame, key: str = "conv_id") -> DataFrame:
    """Of (key, formatted): the contract's columns, read back from the formatted text."""
    read = convs.withColumn("back", read_back(F.col("formatted"))).withColumn(
        "loss", F.array_join(F.transform(F.filter("back", lambda t: t["loss"]), lambda t: t["text"]), "")
    )
    return read.select(
        key,
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def format_conversations(*tables: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, formatted) of tables of any layouts."""
    turns = reduce(DataFrame.unionByName, [turns_from_columns(df, key) for df in tables])
    return turns.select(key, formatted(F.col("turns")).alias("formatted"))


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(r, '([<\\[])({JOINER}*){TAIL}', '\\1{JOINER}\\2\\3', 'g')) + length(regexp_replace(x, '([<\\[])({JOINER}*){TAIL}', '\\1{JOINER}\\2\\3', 'g')) + {len(TURN) + len(END) + 2} AS c FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN r = 'assistant' THEN length(x) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN r = 'assistant' THEN x END, '' ORDER BY turn NULLS FIRST, r, x), '')) AS loss_sha256,
  CAST(sum(c) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
