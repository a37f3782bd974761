"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record is a JSON object in one of several layouts. Its nested field paths (object keys,
``key[]`` for the fields of an array's objects) are reduced to those that any layout names,
sorted and hashed; the hash selects a declarative mapping, which says where the turns are:
either an array with a role and a text field, or one field per turn. Roles are mapped to
canonical names. The template then writes ``<turn role>text</turn>`` lines, and ``parse``
reads them back.

Inside texts and roles ``\\``, ``<`` and ``>`` become ``\\b``, ``\\l`` and ``\\g``, so no mark of
the template can occur in them, and three plain replacements restore them.

Nulls and special cases: null texts are empty; null roles are empty; a record whose layout is
unknown, not JSON or null keeps its row with null turns, and so does ``{}``. An array without
turns gives an empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick

#: Layout name -> field paths that mark it and the mapping. ``each``: array, role field, text
#: field. ``fields``: (role, path) in order; an empty or missing optional field gives no turn.
LAYOUTS: dict[str, dict] = {
    "messages": {"paths": ["messages[].role", "messages[].content"], "each": ("messages", "role", "content")},
    "turns": {"paths": ["turns[].role", "turns[].text"], "each": ("turns", "role", "text")},
    "from_value": {"paths": ["conversations[].from", "conversations[].value"], "each": ("conversations", "from", "value")},
    "instruction": {"paths": ["instruction", "output"], "fields": [("user", "instruction"), ("assistant", "output")]},
    "instruction_input": {"paths": ["instruction", "input", "output"],
                          "fields": [("user", "instruction"), ("user", "input"), ("assistant", "output")]},
    "prompt": {"paths": ["prompt", "completion"], "fields": [("user", "prompt"), ("assistant", "completion")]},
    "prompt_response": {"paths": ["prompt", "response"], "fields": [("user", "prompt"), ("assistant", "response")]},
    "system_prompt": {"paths": ["system", "prompt", "response"],
                      "fields": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    "question": {"paths": ["question", "answer"], "fields": [("user", "question"), ("assistant", "answer")]},
}
ROLES = {"human": "user", "user": "user", "gpt": "assistant", "bot": "assistant", "assistant": "assistant",
         "model": "assistant", "system": "system"}
LOSS_ROLE = "assistant"
#: Mark, replacement; the escape character first when escaping, last when reading back.
ESCAPES = [("\\", "\\b"), ("<", "\\l"), (">", "\\g")]
CLOSE = "</turn>\n"
TURNS = "array<struct<role:string,text:string>>"


def escape(c: Column) -> Column:
    for mark, code in ESCAPES:
        c = F.replace(c, F.lit(mark), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for mark, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(mark))
    return c


def known_paths() -> list[str]:
    return sorted({p for x in LAYOUTS.values() for p in x["paths"]})


def _prefixed(names: Column, prefix: str) -> Column:
    return F.transform(names, lambda k: F.concat(F.lit(prefix), k))


def field_paths(record: Column) -> Column:
    """Sorted field paths of a JSON record that any layout names."""
    top = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    paths = [top]
    for array in sorted({p.split("[]")[0] for p in known_paths() if "[]" in p}):
        # fields of the array's first object; an array without elements counts as having all
        first = F.json_object_keys(F.get_json_object(record, f"$.{array}[0]"))
        own = [p.split("[].")[1] for p in known_paths() if p.startswith(array + "[]")]
        keys = F.when(F.get_json_object(record, f"$.{array}") == "[]", F.array(*[F.lit(x) for x in own])).otherwise(first)
        paths.append(F.coalesce(_prefixed(keys, f"{array}[]."), F.array().cast("array<string>")))
    known = F.array(*[F.lit(p) for p in known_paths()])
    return F.sort_array(F.array_intersect(F.concat(*paths), known))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def _role(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(F.element_at(known, F.lower(c)), c, F.lit(""))


def _turns(record: Column, layout: dict) -> Column:
    if "each" in layout:
        array, role, text = layout["each"]
        rows = F.from_json(record, f"struct<`{array}`:array<struct<`{role}`:string,`{text}`:string>>>")[array]
        return F.transform(rows, lambda x: F.struct(_role(x[role]).alias("role"), F.coalesce(x[text], F.lit("")).alias("text")))
    names = [n for _, n in layout["fields"]]
    row = F.from_json(record, "struct<" + ",".join(f"`{n}`:string" for n in names) + ">")
    turns = F.array(*[F.struct(F.lit(r).alias("role"), F.coalesce(row[n], F.lit("")).alias("text")) for r, n in layout["fields"]])
    optional = F.lit(LOSS_ROLE)  # empty inputs and system prompts give no turn; an empty answer stays one
    return F.filter(turns, lambda t: (t["text"] != "") | (t["role"] == optional)) if len(names) > 2 else turns


def canonical(record: Column) -> Column:
    """Turns of a JSON record: the mapping that its fingerprint selects, or null."""
    print_ = fingerprint(field_paths(record))
    out = F.lit(None).cast(TURNS)
    for layout in LAYOUTS.values():
        wanted = fingerprint(F.array(*[F.lit(p) for p in sorted(layout["paths"])]))
        out = F.when(print_ == wanted, _turns(record, layout)).otherwise(out)
    return out


def opening(role: Column) -> Column:
    return F.concat(F.lit("<turn "), escape(role), F.lit(">"))


def formatted_text(turns: Column) -> Column:
    lines = F.transform(turns, lambda t: F.concat(opening(t["role"]), escape(t["text"]), F.lit(CLOSE)))
    return F.array_join(lines, "")


def loss_mask(turns: Column) -> Column:
    """What is under the loss mask, as places in the output: array<struct<turn, start, end>>, code
    points in the turn's own line, end exclusive."""
    def of(t: Column, i: Column) -> Column:
        start = F.length(opening(t["role"]))
        return F.struct(i.alias("turn"), start.alias("start"), (start + F.length(escape(t["text"]))).alias("end"),
                        (t["role"] == LOSS_ROLE).alias("loss"))
    kept = F.filter(F.transform(turns, of), lambda m: m["loss"])
    return F.transform(kept, lambda m: F.struct(m["turn"], m["start"], m["end"]))


def lines_of(formatted: Column) -> Column:
    return F.split(formatted, CLOSE)


def masked(lines: Column, mask: Column) -> Column:
    """The text under the mask, cut from the output's lines and unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(
        F.get(lines, m["turn"]), m["start"] + 1, m["end"] - m["start"]))), "")


def parse(formatted: Column) -> Column:
    """Turns of a formatted text: the inverse of the template."""
    lines = F.filter(lines_of(formatted), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(
        unescape(F.substring_index(F.substr(x, F.lit(len("<turn ") + 1)), ">", 1)).alias("role"),
        unescape(F.substr(x, F.instr(x, ">") + 1)).alias("text")))


def format_records(records: DataFrame, id_col: str = "id", record_col: str = "record") -> DataFrame:
    """``(id, turns, formatted, mask)`` of JSON records."""
    r = pick(records, id=id_col, record=record_col).select("id", canonical(F.col("record")).alias("turns"))
    return r.select("id", "turns", formatted_text(F.col("turns")).alias("formatted"), loss_mask(F.col("turns")).alias("mask"))


def records_of(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """Conversation rows as one JSON record each, turns in order (ties by role, then text). The
    records come in several layouts, dealt by a hash of the id, as those of several sources do."""
    r = pick(rows, id=id_col, turn=turn_col, role=role_col, content=text_col)
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("content", F.lit("")).alias("content"))
    g = r.groupBy("id").agg(F.sort_array(F.collect_list(turn)).alias("t"))

    def as_record(layout: str) -> Column:
        array, role, text = LAYOUTS[layout]["each"]
        turns = F.transform("t", lambda x: F.struct(x["role"].alias(role), x["content"].alias(text)))
        return F.to_json(F.struct(turns.alias(array)))

    source = F.pmod(F.xxhash64("id"), F.lit(3))
    record = F.when(source == 0, as_record("messages")).when(source == 1, as_record("turns")).otherwise(as_record("from_value"))
    return g.select("id", record.alias("record"))


def op10(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    rows = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    extra = spark.range(1).select(F.explode(F.array(F.lit("user"), F.lit("assistant"))).alias("role"))
    extra = extra.select(F.lit(-7).cast("long").alias("conv_id"), F.when(F.col("role") == "user", 0).otherwise(1).cast("long").alias("turn"),
                         "role", F.lit(text).alias("text"))
    out = format_records(records_of(rows.unionByName(extra)))
    back = out.select("id", "formatted", "mask", lines_of(F.col("formatted")).alias("lines"), parse(F.col("formatted")).alias("turns"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = masked(F.col("lines"), F.col("mask"))
    return back.select(F.col("id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(spoken, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
                       F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(replace(replace(replace(role || text, '\', '\b'), '<', '\l'), '>', '\g')) + 15) AS BIGINT) AS formatted_chars
FROM rows_ GROUP BY conv_id
"""
