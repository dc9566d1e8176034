"""Chat formatting: records of many layouts to turns, turns to one template with a loss mask, and back.

A record is a VARIANT (parsed JSON, or a row as an object). Its shape, the nested field paths without scalar types, is hashed; the
fingerprint picks a mapping from a table made of `LAYOUTS`, in which every layout states declaratively where its conversation id, order,
turns, roles and texts are. A shape with further fields has another fingerprint; such a record takes the first layout whose required
paths it all has. Records of no layout are set apart, with their shapes, never dropped silently. All of this is expressions: no Python.

Output is a table in the shared folder of one row a turn: conversation, place, formatted text, and the part under the loss mask (first
character and length), so no cell grows with a conversation. A conversation's text is its rows joined in order. The template is

    <|im_start|>role NEWLINE text <|im_end|> NEWLINE

and escapes reversibly: inside texts and roles a `|` behind `<` and any number of backslashes gets one more backslash, so a text never
holds a control string; in roles `%` and newlines are written %25 and %0A. Only the texts of assistants, without markers, are under the mask.

Cases: null texts and roles are empty; null turns come first and rows of one turn go by role, then text; repeated rows are turns of
their own; a null conversation id is one conversation; a record without turns gives none; empty tables give empty tables; fields that
no mapping names are not read. Digests of a conversation are made in one sorted stream, holding one turn at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, kind_of, new_path, ship, tidy

# ---------------------------------------------------------------- layouts


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its parts; paths are field names, `[]` marks a list (`messages[].role`).

    `turns`: pairs (role, path of the text) for records whose fields are turns; an absent or null one is no turn.
    `each`: (path of the list, role field, text field) for records with a list of turns; an empty list name: the record is a turn.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    id: str | None = None
    order: str | None = None
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: tuple[str, str, str] | None = None
    #: Fields that lists of turns may have besides role and text.
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def fingerprints(self) -> list[str]:
        """The shapes of this layout, with any of its optional fields."""
        return sorted({shape_of([*self.required, *more]) for n in range(len(self.optional) + 1) for more in combinations(self.optional, n)})


#: Names of roles in public conversation sets, and the roles that they stand for.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}

LAYOUTS = (
    Layout("turn rows", ("conv_id", "role", "text", "turn"), id="conv_id", order="turn", each=("", "role", "text")),
    Layout("messages", ("messages[].content", "messages[].role"), ("conv_id", "id", "source"), id="conv_id", each=("messages", "role", "content"), roles=ROLES),
    Layout("conversations", ("conversations[].from", "conversations[].value"), ("conv_id", "id", "source"), id="conv_id", each=("conversations", "from", "value"), roles=ROLES),
    Layout("instruction", ("instruction", "output"), ("conv_id", "id", "input", "system"), id="conv_id", turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt and completion", ("completion", "prompt"), ("conv_id", "id", "system"), id="conv_id", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt and response", ("prompt", "response"), ("conv_id", "id", "system"), id="conv_id", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question and answer", ("answer", "question"), ("context", "conv_id", "id"), id="conv_id", turns=(("user", ("context", "question")), ("assistant", ("answer",)))),
    Layout("preference", ("chosen", "prompt", "rejected"), ("conv_id", "id"), id="conv_id", turns=(("user", ("prompt",)), ("assistant", ("chosen",)))),
)


def shape_of(paths: list[str]) -> str:
    """The shape of a record with these paths, as `shape` writes it."""
    tree: dict = {}
    for path in paths:
        at = tree
        for name in path.split("."):
            at = at.setdefault(name, {})

    def write(tree: dict) -> str:
        return "OBJECT<" + ", ".join(k.removesuffix("[]") + ((": ARRAY<" + write(v) + ">") if k.endswith("[]") else ": " + write(v) if v else "") for k, v in sorted(tree.items())) + ">"

    return write(tree)


def shape(record: Column) -> Column:
    """A record's nested field paths in canonical order: its schema without scalar types, so nulls and numbers of any width are alike."""
    kinds = r"(?:VOID|BOOLEAN|BIGINT|FLOAT|DOUBLE|DECIMAL\([0-9]+,[0-9]+\)|DATE|TIMESTAMP_NTZ|TIMESTAMP|STRING|BINARY|UUID)"
    return F.regexp_replace(F.schema_of_variant(record), rf": {kinds}(?=[,>])", "")


def fingerprint(shape_: Column) -> Column:
    return F.xxhash64(shape_)


def _has(shape_: Column, layout: Layout) -> Column:
    """Whether a shape has all of a layout's required paths (fields of a list are looked for behind the list's name)."""
    need = F.lit(True)
    for path in layout.required:
        names = path.replace("[]", "").split(".")
        pattern = r"(?:^OBJECT<|.*, )" + names[0] if len(names) == 1 else r"(?:^OBJECT<|.*[<, ])" + names[0] + r": ARRAY<OBJECT<(?:[^<>]*, )?" + names[1]
        need &= F.regexp_like(shape_, F.lit("^" + pattern.removeprefix("^") + r"(?:[,:>].*)$"))
    return need


def layout_of(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The number of a record's layout: by the fingerprint of its shape, else the first layout whose required paths it has, else null."""
    s = shape(record)
    known: dict[str, int] = {}
    for i, layout in enumerate(layouts):
        for one in layout.fingerprints():
            known.setdefault(one, i)
    table = F.create_map(*(x for one, i in known.items() for x in (fingerprint(F.lit(one)), F.lit(i))))
    other = F.coalesce(*(F.when(_has(s, layout), F.lit(i)) for i, layout in enumerate(layouts)))
    return F.coalesce(F.element_at(table, fingerprint(s)), other)


def shapes(records: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(fingerprint, shape, layout, n): which shapes a table has and the layout of each (null: none); what to look at before adding one."""
    s = shape(column(record_col))
    found = layout_of(column(record_col), layouts)
    name = F.coalesce(*(F.when(found == i, F.lit(x.name)) for i, x in enumerate(layouts)))
    rows = records.select(fingerprint(s).alias("fingerprint"), s.alias("shape"), name.alias("layout"))
    return rows.groupBy("fingerprint", "shape", "layout").agg(F.count("*").alias("n"))


def _field(record: Column, path: str | None, kind: str) -> Column:
    return F.try_variant_get(record, f"$.{path}", kind) if path else F.lit(None).cast(kind)


def _role(role: Column, names: dict[str, str]) -> Column:
    out = F.coalesce(role, F.lit(""))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), out), out) if names else out


def _turns(record: Column, layout: Layout) -> Column:
    """array<struct<role, text>> of a record of `layout`."""
    if layout.each:
        path, role, text = layout.each
        if not path:
            return F.array(F.struct(_role(_field(record, role, "string"), layout.roles).alias("role"), F.coalesce(_field(record, text, "string"), F.lit("")).alias("text")))
        rows = _field(record, path, "array<variant>")
        read = lambda x, f: F.try_variant_get(x, f"$.{f}", "string")
        return F.transform(F.coalesce(rows, F.array().cast("array<variant>")), lambda x: F.struct(_role(read(x, role), layout.roles).alias("role"), F.coalesce(read(x, text), F.lit("")).alias("text")))
    found = []
    for role, paths in layout.turns:
        parts = [_field(record, p, "string") for p in paths]
        text = F.concat_ws("\n", *(F.when(p != "", p) for p in parts)) if len(parts) > 1 else parts[0]
        there = F.coalesce(*parts).isNotNull() if role == "system" else F.lit(True)
        found.append(F.when(there, F.struct(F.lit(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def canonical_turns(records: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, turn, step, role, text), a row a turn of every record that has a layout; `step` counts within a record."""
    record = column(record_col)
    placed = records.select(record.alias("record"), layout_of(record, layouts).alias("layout")).filter("layout IS NOT NULL")

    def chosen(make) -> Column:
        return F.coalesce(*(F.when(F.col("layout") == i, make(layout)) for i, layout in enumerate(layouts)))

    r = F.col("record")
    rows = placed.select(
        chosen(lambda x: F.coalesce(_field(r, x.id, "bigint"), _field(r, "id", "bigint") if "id" in x.optional else F.lit(None).cast("bigint"))).alias("conv_id"),
        chosen(lambda x: _field(r, x.order, "bigint")).alias("turn"),
        chosen(lambda x: _turns(r, x)).alias("turns"),
    )
    return rows.select("conv_id", "turn", F.posexplode("turns").alias("step", "one")).select("conv_id", "turn", "step", "one.role", "one.text")


def unmapped(records: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The records that no layout fits, whole."""
    return records.filter(layout_of(column(record_col), layouts).isNull())


# ---------------------------------------------------------------- template

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def formatted(turns: DataFrame, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, turn, step, segment, loss_start, loss_length): each turn in the template, and its characters under the loss mask."""
    head, text = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n")), escape(F.col("text"))
    learned = F.col("role").isin(*learn_from)
    rows = turns.select("conv_id", "turn", "step", head.alias("head"), text.alias("body"), learned.alias("learned"))
    segment = F.concat("head", "body", F.lit(END + "\n")).alias("segment")
    return rows.select("conv_id", "turn", "step", segment, F.length("head").alias("loss_start"), F.when(F.col("learned"), F.length("body")).otherwise(0).alias("loss_length"), "learned")


def write_chats(turns: DataFrame, path: str | None = None) -> str:
    """The formatted turns as a table in the shared folder; returns its path."""
    path = path or new_path(turns.sparkSession, "chats")
    formatted(turns).write.parquet(path)
    return path


def parsed(chats: DataFrame) -> DataFrame:
    """(conv_id, turn, step, role, text, learned, n_chars), read from the template alone; `learned` is the unescaped text under the mask."""
    segment = F.col("segment")
    head = F.length(F.regexp_extract(segment, r"^<\|im_start\|>[^\n]*\n", 0))
    role = F.substring(segment, F.lit(len(START) + 1), head - len(START) - 1)
    text = F.substring(segment, head + 1, F.length(segment) - head - len(END) - 1)
    masked = F.substring(segment, F.col("loss_start") + 1, F.col("loss_length"))
    return chats.select("conv_id", "turn", "step", _unescape_role(role).alias("role"), unescape(text).alias("text"), F.when(F.col("learned"), unescape(masked)).alias("learned"), F.length(segment).alias("n_chars"))


@tidy
def _digests(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """One row a conversation of rows sorted by conversation and place; one turn is held at a time."""
    now, n, chars, loss, whole, learned = None, 0, 0, 0, None, None

    def row():
        return (now[0], n, whole.hexdigest(), loss, learned.hexdigest(), chars)

    for batch in batches:
        out = []
        for conv, role, text, mask, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "learned", "n_chars")), strict=True):
            if now != (conv,):
                if now:
                    out.append(row())
                now, n, chars, loss, whole, learned = (conv,), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            n, chars = n + 1, chars + size
            whole.update(f"{role}\n{text}\n".encode())
            if mask is not None:
                loss += len(mask)
                learned.update(mask.encode())
        if out:
            yield _rows(out, kind)
    if now:
        yield _rows([row()], kind)


def _rows(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(chats: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of written chats, read back from them."""
    ship(chats.sparkSession)
    rows = parsed(chats)
    n = int(chats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "step", "role", "text").select("conv_id", "role", "text", "learned", "n_chars")
    kind = pa.int64()
    return in_order.mapInArrow(lambda it: _digests(it, kind), f"conv_id {kind_of(chats, 'conv_id')}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
