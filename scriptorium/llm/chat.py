"""Chat formatting: schema fingerprints select declarative mappings of records to turns; a reversible template marks them.

Native throughout: only DataFrame functions. A record is JSON text of any layout. The nested field paths of each record
(names and nesting, without types) are written as one expression and hashed; the hash selects the mapping that says where
its turns are. Records whose fingerprint no mapping claims keep a null layout and null turns, so that nothing is dropped.

Defined results: null role and null text are empty strings; repeated turns stay, ordered by turn, role and text (a null turn
first); a message's `name` is left out; rows with a null conversation id form one conversation; an empty table gives an empty result; other columns are ignored.
One conversation is one output row, so its turns meet in one task.

Spark's parser refuses strings over 20,000,000 characters and variants over 128 MiB. Packed conversations keep their turns beside the record,
and are formatted from them where the parser refuses; a refused record without them that is long enough for either limit is an error.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings. Inside texts and roles a backslash follows the first character of each.
USER_OPEN, ROLE_END, USER_CLOSE, REPLY_OPEN, REPLY_CLOSE = "[INST]", "[ROLE]", "[/INST]", "<s>", "</s>"
_CONTROL = r"(\[|<)(/?INST\]|ROLE\]|/?s>)"
REPLY = "assistant"
TURNS = "array<struct<role:string,text:string>>"
#: Shorter records hold no string that Spark's JSON parser refuses, and make no variant over its limit (at most 3 bytes a character).
PARSED_CHARS = 20_000_000


@dataclass(frozen=True)
class Layout:
    """A declarative mapping: either `fields` (role, path, optional) in order, or a list of messages with role and text fields.

    `extra`: scalar paths that a record may have besides, `beside`: those that a message may have. `roles`: other names of roles. `parts`: where a
    message's text is a list of parts, the field of a part that has its text, and others that it may have; parts are put together. `bare`: messages are
    texts themselves, and roles take turns.
    """

    name: str
    fields: tuple[tuple[str, str, bool], ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    extra: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)
    beside: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()
    bare: bool = False

    def path_sets(self) -> list[tuple[str, ...]]:
        """Every set of nested field paths that this mapping claims."""
        if self.bare:
            bodies = [(f"{self.each}[].*",)]
        elif self.each:
            texts = [tuple(f"{self.text}[].{p}" for p in (self.parts[0], *c)) for n in range(len(self.parts)) for c in itertools.combinations(self.parts[1:], n)] if self.parts else [(self.text,)]
            besides = [c for n in range(len(self.beside) + 1) for c in itertools.combinations(self.beside, n)]
            messages = [role + text + more for role in ((self.role,), ()) for text in texts for more in besides]
            bodies = [tuple(f"{self.each}[].{p}" for p in m) for m in messages] + ([] if self.parts else [(f"{self.each}[]",)])
        else:
            need = tuple(p for _, p, optional in self.fields if not optional)
            may = [p for _, p, optional in self.fields if optional]
            bodies = [need + c for n in range(len(may) + 1) for c in itertools.combinations(may, n)]
        extras = [c for n in range(len(self.extra) + 1) for c in itertools.combinations(self.extra, n)]
        return [b + x for b in bodies for x in extras]


#: The layouts of common instruction and chat data sets.
LAYOUTS = (
    Layout("messages", each="messages", role="role", text="content", extra=("id",), roles={"human": "user", "model": REPLY, "bot": REPLY}, beside=("name",)),
    Layout("message_parts", each="messages", role="role", text="content", extra=("id",), roles={"human": "user", "model": REPLY, "bot": REPLY}, beside=("name",), parts=("text", "type")),
    Layout("message_texts", each="messages", extra=("id",), bare=True),
    Layout("from_value", each="conversations", role="from", text="value", extra=("id",), roles={"human": "user", "gpt": REPLY, "bot": REPLY}),
    Layout("prompt_response", fields=(("system", "system", True), ("user", "prompt", False), (REPLY, "response", False)), extra=("id",)),
    Layout("prompt_completion", fields=(("system", "system", True), ("user", "prompt", False), (REPLY, "completion", False)), extra=("id",)),
    Layout("question_answer", fields=(("system", "system", True), ("user", "question", False), (REPLY, "answer", False)), extra=("id",)),
    Layout("instruction", fields=(("system", "system", True), ("user", "instruction", False), ("user", "input", True), (REPLY, "output", False)), extra=("id",)),
)

_PACKED = LAYOUTS[0]  # what pack_messages() makes


def path_expression(paths: tuple[str, ...]) -> str:
    """Nested field paths such as `messages[].role` as one expression, in the form that record_paths() gives."""
    tree: dict = {}
    for path in paths:
        node = tree
        for part in path.replace("[]", ".[]").split("."):
            node = node.setdefault(part, {})
    # A list of scalars is told from an empty one.

    def show(node: dict) -> str:
        if "[]" in node:
            return "ARRAY<*>" if node["[]"] == {"*": {}} else f"ARRAY<{show(node['[]'])}>"
        return "OBJECT<" + ", ".join(k if not v else f"{k}: {show(v)}" for k, v in sorted(node.items())) + ">" if node else ""

    return show(tree)


def fingerprint_of(paths: tuple[str, ...]) -> str:
    return hashlib.sha256(path_expression(paths).encode()).hexdigest()[:16]


def record_paths(record: Column) -> Column:
    """The nested field paths of a variant as one expression: its schema without scalar types.

    A list of scalars is `ARRAY<*>`, an empty one `ARRAY<>`; where a place holds values of several shapes, VARIANT stays, which no mapping claims.
    """
    kind = r"(?!VARIANT)(?:DECIMAL\([^)]*\)|[A-Z_]+)"
    empty = F.replace(F.schema_of_variant(record), F.lit("ARRAY<VOID>"), F.lit("ARRAY<>"))
    return F.regexp_replace(F.regexp_replace(empty, rf": {kind}(?=[,>])", ""), rf"ARRAY<{kind}>", "ARRAY<*>")


def record_fingerprint(record: Column) -> Column:
    return F.substring(F.sha2(record_paths(record), 256), 1, 16)


def _listed_turns(layout: Layout, messages: Column) -> Column:
    """Turns of a list of messages in the layout's fields."""

    def turn(x: Column) -> Column:
        role = F.coalesce(x[layout.role], F.lit(""))
        for other, name in layout.roles.items():
            role = F.when(x[layout.role] == other, F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), F.coalesce(x[layout.text], F.lit("")).alias("text"))

    return F.transform(messages, turn)


def _turns_of(layout: Layout, record: Column) -> Column:
    if layout.bare:
        texts = F.try_variant_get(record, f"$.{layout.each}", "array<string>")
        return F.transform(texts, lambda x, k: F.struct(F.when(k % 2 == 0, "user").otherwise(REPLY).alias("role"), F.coalesce(x, F.lit("")).alias("text")))
    if layout.parts:
        told = F.try_variant_get(record, f"$.{layout.each}", f"array<struct<`{layout.role}` string,`{layout.text}` array<struct<`{layout.parts[0]}` string>>>>")
        whole = lambda x: F.array_join(F.transform(x[layout.text], lambda p: F.coalesce(p[layout.parts[0]], F.lit(""))), "")
        return _listed_turns(layout, F.transform(told, lambda x: F.struct(x[layout.role].alias(layout.role), whole(x).alias(layout.text))))
    if layout.each:
        return _listed_turns(layout, F.try_variant_get(record, f"$.{layout.each}", f"array<struct<`{layout.role}` string,`{layout.text}` string>>"))
    turns: list[tuple[str, list[Column]]] = []
    for role, path, optional in layout.fields:
        value = F.try_variant_get(record, f"$.{path}", "string")
        value = value if optional else F.coalesce(value, F.lit(""))
        if turns and turns[-1][0] == role:
            turns[-1][1].append(value)
        else:
            turns.append((role, [value]))
    made = [F.struct(F.lit(role).alias("role"), (F.concat_ws("\n\n", *values) if len(values) > 1 else values[0]).alias("text")) for role, values in turns]
    return F.filter(F.array(*made), lambda t: t["text"].isNotNull())


def _parsed(json: Column, packed: Column | None = None) -> Column:
    """The record as a variant: null where it is no JSON, an error where it may only be too long and nothing is packed beside it."""
    refused = F.length(json) > PARSED_CHARS
    if packed is not None:
        refused &= packed.isNull()
    error = F.raise_error(F.concat(F.lit("a record is no JSON or too long for the parser, characters: "), F.length(json).cast("string"))).cast("string")
    return F.coalesce(F.try_parse_json(json), F.when(refused, F.try_parse_json(error)))


def canonical_turns(records: DataFrame, id_col: str, json_col: str, layouts: tuple[Layout, ...] = LAYOUTS, *, packed_col: str | None = None) -> DataFrame:
    """(id, fingerprint, layout, turns) of JSON records; layout and turns are null where no mapping claims the fingerprint.

    `packed_col` has the messages of records made by pack_messages(), for those that the parser refuses.
    """
    packed = F.col(packed_col) if packed_col else F.lit(None).cast("array<struct<role:string,content:string>>")
    base = records.select(F.col(id_col), _parsed(F.col(json_col).cast("string"), packed).alias("__v"), packed.alias("__packed"))
    fallback = F.col("__v").isNull() & F.col("__packed").isNotNull()
    base = base.withColumn("__fp", F.when(fallback, F.lit(fingerprint_of(_PACKED.path_sets()[0]))).otherwise(record_fingerprint(F.col("__v"))))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in layouts:
        claimed = F.col("__fp").isin(sorted({fingerprint_of(p) for p in layout.path_sets()}))
        name = F.when(claimed, F.lit(layout.name)).otherwise(name)
        turns = F.when(claimed, _turns_of(layout, F.col("__v")).cast(TURNS)).otherwise(turns)
    if packed_col:
        name = F.when(fallback, F.lit(_PACKED.name)).otherwise(name)
        turns = F.when(fallback, _listed_turns(_PACKED, F.col("__packed")).cast(TURNS)).otherwise(turns)
    return base.select(F.col(id_col), F.col("__fp").alias("fingerprint"), name.alias("layout"), turns.alias("turns"))


def unmapped_layouts(records: DataFrame, json_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(fingerprint, paths, n) of the records that no mapping claims: what to declare next."""
    known = sorted({fingerprint_of(p) for layout in layouts for p in layout.path_sets()})
    v = records.select(_parsed(F.col(json_col).cast("string")).alias("v")).select(record_fingerprint(F.col("v")).alias("fingerprint"), record_paths(F.col("v")).alias("paths"))
    return v.filter(~F.coalesce(F.col("fingerprint").isin(known), F.lit(False))).groupBy("fingerprint", "paths").agg(F.count("*").alias("n"))


def pack_messages(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(id, record, messages): conversation rows by turn as one JSON record of messages for each conversation, and the messages themselves."""
    turn = F.struct(F.col(turn_col).alias("n"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("content"))
    inner = F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return rows.groupBy(F.col(id_col)).agg(F.to_json(F.struct(inner.alias("messages"))).alias("record"), inner.alias("messages"))


def escape(text: Column) -> Column:
    """Reversibly: backslashes are doubled, and one follows the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: Column) -> tuple[Column, Column]:
    """(formatted, segments): the template's text, and the same text as consecutive pieces of which those with loss are the mask."""

    def piece(text: Column, loss: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    def turn(t: Column) -> Column:
        reply = F.array(piece(F.lit(REPLY_OPEN), False), piece(escape(t["text"]), True), piece(F.lit(REPLY_CLOSE), False))
        other = F.array(piece(F.concat(F.lit(USER_OPEN), escape(t["role"]), F.lit(ROLE_END), escape(t["text"]), F.lit(USER_CLOSE)), False))
        return F.when(t["role"] == REPLY, reply).otherwise(other)

    segments = F.flatten(F.transform(turns, turn))
    return F.array_join(F.transform(segments, lambda s: s["text"]), ""), segments


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, controls taken out and texts unescaped."""
    pieces = F.regexp_extract_all(formatted, F.lit(r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>"), F.lit(0))

    def turn(p: Column) -> Column:
        reply = F.substr(p, F.lit(len(REPLY_OPEN) + 1), F.length(p) - len(REPLY_OPEN + REPLY_CLOSE))
        inner = F.substr(p, F.lit(len(USER_OPEN) + 1), F.length(p) - len(USER_OPEN + USER_CLOSE))
        role = F.substring_index(inner, ROLE_END, 1)
        text = F.substr(inner, F.length(role) + len(ROLE_END) + 1)
        is_reply = F.startswith(p, F.lit(REPLY_OPEN))
        return F.struct(F.when(is_reply, F.lit(REPLY)).otherwise(unescape(role)).alias("role"), unescape(F.when(is_reply, reply).otherwise(text)).alias("text"))

    return F.transform(pieces, turn)


def format_chat(records: DataFrame, id_col: str, json_col: str, layouts: tuple[Layout, ...] = LAYOUTS, *, packed_col: str | None = None) -> DataFrame:
    """(id, fingerprint, layout, formatted, segments) of JSON records; see format_turns(). Unclaimed records have null texts."""
    turns = canonical_turns(records, id_col, json_col, layouts, packed_col=packed_col)
    formatted, segments = format_turns(F.col("turns"))
    return turns.select(F.col(id_col), "fingerprint", "layout", formatted.alias("formatted"), segments.alias("segments"))


def digest_chat(formatted: DataFrame, id_col: str) -> DataFrame:
    """Digests read back from formatted chats: turns parsed from the text, loss text from the mask."""
    turns = read_turns(F.col("formatted"))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return formatted.select(F.col(id_col), turns.alias("t"), loss.alias("loss"), F.length("formatted").alias("n"), "layout").select(
        F.col(id_col),
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.col("n").cast("long").alias("formatted_chars"),
        "layout",
    )
