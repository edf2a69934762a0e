"""Chat formatting: layouts are recognised by a fingerprint of their nested field paths.

``canonical_turns`` turns prompt, instruction and message layouts into rows (conv_id, turn, role,
text); ``format_turns`` writes each turn with its markers and the span of the loss mask;
``read_back`` parses the written form again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The strings that mark turns here or in other common chat templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"

# Field paths of each layout and, in order, (role or path of the role, path of the text).
LAYOUTS = {
    "turn rows": (("conv_id", "turn", "role", "text"), ()),
    "messages": (("messages[].content", "messages[].role"), (("messages[].role", "messages[].content"),)),
    "from and value": (("conversations[].from", "conversations[].value"), (("conversations[].from", "conversations[].value"),)),
    "instruction with input": (("input", "instruction", "output"), (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    "instruction": (("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    "prompt and completion": (("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
    "prompt and response": (("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    "system, prompt and response": (("prompt", "response", "system"), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    "question and answer": (("answer", "question"), (("user", "question"), ("assistant", "answer"))),
}
# Other names of the canonical roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths, a[] for the elements of array a."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def fingerprint(paths: Iterable[str]) -> str:
    """Hash of the paths that any layout knows; columns that none knows don't change it."""
    known = {p for names, _ in LAYOUTS.values() for p in names}
    return hashlib.md5("\n".join(sorted(set(paths) & known)).encode()).hexdigest()


_BY_FINGERPRINT = {fingerprint(paths): name for name, (paths, _) in LAYOUTS.items()}


def layout_of(schema: T.StructType) -> str:
    """The layout's name; where the paths as a whole are no layout, the widest layout they contain."""
    paths = set(field_paths(schema))
    if name := _BY_FINGERPRINT.get(fingerprint(paths)):
        return name
    held = [name for name, (own, _) in LAYOUTS.items() if set(own) <= paths]
    if not held:
        raise ValueError(f"no known chat layout in the fields {sorted(paths)}")
    return max(held, key=lambda name: (len(LAYOUTS[name][0]), name))


def _turns_of(name: str) -> Column:
    """The turns of a row in a layout, as array<struct<turn, role, text>>."""
    empty = F.lit("")
    made = lambda turn, role, text: F.struct(turn.cast("long").alias("turn"), role.cast("string").alias("role"), text.cast("string").alias("text"))
    if name == "turn rows":
        return F.array(made(F.col("turn"), F.coalesce("role", empty), F.coalesce("text", empty)))
    mapping = LAYOUTS[name][1]
    roles = F.create_map(*(F.lit(x) for pair in ROLE_NAMES.items() for x in pair))
    if "[]" in mapping[0][1]:
        array, role = mapping[0][0].split("[].")
        text = mapping[0][1].split("[].")[1]
        return F.transform(F.col(array), lambda m, i: made(i, F.coalesce(roles[m[role]], m[role], empty), F.coalesce(m[text], empty)))
    parts = F.array(*(F.struct(F.lit(role).alias("role"), F.col(path).cast("string").alias("text")) for role, path in mapping))
    told = F.filter(parts, lambda m: m["text"].isNotNull() & ((m["text"] != "") | (m["role"] == LEARNED_ROLE)))
    return F.transform(told, lambda m, i: made(i, m["role"], m["text"]))


def canonical_turns(rows: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Rows of any known layouts as conv_id, turn, role, text; one table may hold several layouts.

    A row's layout is that of the fingerprint of its own fields that are not null. Where these as a
    whole are no layout it is the widest that they contain, and where they contain none the table's.
    Null role and text become empty; turns whose text is missing from an instruction or prompt
    record are left out; other columns are not read. An empty table gives no rows.
    """
    paths = set(field_paths(rows.schema))
    table = layout_of(rows.schema)
    held = [name for name, (own, _) in LAYOUTS.items() if set(own) <= paths]
    if held == ["turn rows"]:
        return rows.select(F.col(conversation).alias("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    known = sorted({p for own, _ in LAYOUTS.values() for p in own} & paths)
    field = lambda path: F.col("`" + path.split("[]")[0].split(".")[0] + "`")
    present = F.array_compact(F.array(*(F.when(field(p).isNotNull(), F.lit(p)) for p in known)))
    # The id column alone does not tell layouts apart and is often null where the rest is not.
    print_ = F.md5(F.array_join(F.array_sort(F.array_distinct(F.concat(present, F.array(F.lit("conv_id")) if "conv_id" in known else F.array().cast("array<string>")))), "\n"))
    exact = {fingerprint([*LAYOUTS[name][0], *(["conv_id"] if "conv_id" in known else [])]): name for name in held}
    choice = F.when(F.lit(False), _turns_of(table))
    for mark, name in exact.items():
        choice = choice.when(print_ == mark, _turns_of(name))
    for name in sorted(held, key=lambda name: (-len(LAYOUTS[name][0]), name)):
        whole = F.lit(True)
        for path in set(LAYOUTS[name][0]) - {"conv_id"}:
            whole = whole & field(path).isNotNull()
        choice = choice.when(whole, _turns_of(name))
    turns = choice.otherwise(_turns_of(table))
    return rows.select(F.col(conversation).alias("conv_id"), F.explode(turns).alias("m")).select("conv_id", "m.turn", "m.role", "m.text")


_MARKS = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL)


def escaped(text: Column) -> Column:
    """Backslashes doubled, and one backslash behind the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _MARKS, "\\\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def format_turns(turns: DataFrame) -> DataFrame:
    """``turns`` as conv_id, turn, role, text, formatted, loss_start, loss_end; one row per turn.

    A conversation's written form is its turns' ``formatted`` in the order of turn, role and text,
    so no task has to hold one. The mask [loss_start, loss_end), in code points of ``formatted``,
    covers the text of assistant turns and is empty elsewhere.
    """
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    body = escaped(F.col("text"))
    learned = F.col("role") == LEARNED_ROLE
    start = F.char_length(head).cast("long")
    return turns.select(
        "conv_id", "turn", "role", "text",
        F.concat(head, body, F.lit(f"{END}\n")).alias("formatted"),
        F.when(learned, start).otherwise(F.lit(0)).alias("loss_start"),
        F.when(learned, start + F.char_length(body)).otherwise(F.lit(0)).alias("loss_end"),
    )


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of one written turn."""
    head, _, body = formatted.removeprefix(START).partition("\n")
    role = re.sub(r"\\(\\|n|)", lambda m: {"n": "\n", "\\": "\\", "": ""}[m[1]], head)
    return role, unescape(body.removesuffix(f"{END}\n"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from its written form alone.

    Returns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Turns stream
    through one at a time, in the order of turn, role and text, so a conversation of any length
    takes constant memory. Turns with equal numbers all count; null numbers come first; a null
    conv_id is a conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out: list[list] = [[] for _ in names]
        current, state = None, None

        def close() -> None:
            if state:
                for column, value in zip(out, (current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]), strict=True):
                    column.append(value)

        for batch in batches:
            for conv, written, start, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if state is None or conv != current:
                    close()
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_turn(written)
                learned = unescape(written[start:end])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(written)
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
                out = [[] for _ in names]
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    ordered = ordered.select(F.col("conv_id").cast("long"), "formatted", "loss_start", "loss_end")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_DUCK_ESCAPED = "replace({}, '\\', '\\\\')"
for _c in CONTROL:
    _DUCK_ESCAPED = f"replace({_DUCK_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"

ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = '{LEARNED_ROLE}' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = '{LEARNED_ROLE}' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(length({_DUCK_ESCAPED.format("role")}) + length({_DUCK_ESCAPED.format("text")}) + {len(START) + len(END) + 2})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
