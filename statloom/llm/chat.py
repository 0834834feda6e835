"""Chat formatting: schema fingerprints select declarative mappings into canonical turns; a template makes them text.

A record's fingerprint is a hash of its nested field paths, read off ``schema_of_variant`` without types and without the
fields that no mapping needs (``IGNORED``). ``MAPPINGS`` says, for each known set of paths, where the turns are; a record
whose fingerprint is unknown has none and is reported by ``unmapped``. Records come as JSON (``canonical``), or as rows of
one turn each (``from_turn_rows``): these are gathered and dressed in one of several layouts by their conv_id, as variants
that hold the places of the texts, so that each record is fingerprinted and mapped while texts never become JSON. All of it is SQL: no code outside Spark's own functions.

The template writes a turn as ``### role``, a line break, the text and ``</turn>`` with a line break. In roles and texts a
backslash is doubled, and one is put into every ``</turn>`` and ``##``, so a marker in the output is always the
template's own and reading back gives the texts as they were. The loss mask names, by block (turn) of the output, the
characters of assistant texts.

Defined cases: a null text or role is an empty one; rows that repeat a turn are turns of their own, ordered by turn, role
and text, null turns first; rows with a null conv_id form one conversation; an empty table gives none; columns of any name
stay (``canonical``, ``render``, ``read_back``) or are not read (``from_turn_rows``). A conversation is one value of the
result, so one task holds it however long it is; no text is cut or lost for its length. JSON that can't be parsed (the
parser takes strings of up to 20,000,000 characters) raises an error unless ``broken_as_null`` asks for null turns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import fresh

END = "</turn>\n"
#: Fields that say nothing about where the turns are, at any depth.
IGNORED = "id uid uuid name source dataset category lang language timestamp created metadata tool_calls tools weight score".split()
NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


def two(user: str, assistant: str, *before: str) -> str:
    turn = lambda role, text: f"named_struct('role', '{role}', 'text', {text})"
    return f"array({', '.join([*before, turn('user', user), turn('assistant', assistant)])})"


ASKED = r"concat_ws('\n\n', {r}:$.instruction, nullif({r}:$.input, ''))"
SYSTEM = "named_struct('role', 'system', 'text', {r}:$.system)"
#: Where the turns of each layout are. paths: the layout's fields as ``schema_of_variant`` nests them, without types.
MAPPINGS = [
    {"name": "turn row", "paths": "OBJECT<content, role>", "turns": "array(named_struct('role', {r}:$.role, 'text', {r}:$.content))"},
    {"name": "messages", "paths": "OBJECT<messages: ARRAY<OBJECT<content, role>>>", "list": "$.messages", "role": "$.role", "text": "$.content"},
    {"name": "data messages", "paths": "OBJECT<data: OBJECT<messages: ARRAY<OBJECT<content, role>>>>", "list": "$.data.messages", "role": "$.role", "text": "$.content"},
    {"name": "conversation", "paths": "OBJECT<conversation: ARRAY<OBJECT<content, role>>>", "list": "$.conversation", "role": "$.role", "text": "$.content"},
    {"name": "conversations", "paths": "OBJECT<conversations: ARRAY<OBJECT<from, value>>>", "list": "$.conversations", "role": "$.from", "text": "$.value", "roles": NAMES},
    {"name": "system conversations", "paths": "OBJECT<conversations: ARRAY<OBJECT<from, value>>, system>", "list": "$.conversations", "role": "$.from", "text": "$.value", "roles": NAMES, "before": SYSTEM},
    {"name": "preference", "paths": "OBJECT<chosen: ARRAY<OBJECT<content, role>>, rejected: ARRAY<OBJECT<content, role>>>", "list": "$.chosen", "role": "$.role", "text": "$.content"},
    {"name": "preference pair", "paths": "OBJECT<chosen, prompt, rejected>", "turns": two("{r}:$.prompt", "{r}:$.chosen")},
    {"name": "prompt", "paths": "OBJECT<completion, prompt>", "turns": two("{r}:$.prompt", "{r}:$.completion")},
    {"name": "prompt response", "paths": "OBJECT<prompt, response>", "turns": two("{r}:$.prompt", "{r}:$.response")},
    {"name": "query response", "paths": "OBJECT<query, response>", "turns": two("{r}:$.query", "{r}:$.response")},
    {"name": "question", "paths": "OBJECT<answer, question>", "turns": two("{r}:$.question", "{r}:$.answer")},
    {"name": "instruction", "paths": "OBJECT<input, instruction, output>", "turns": two(ASKED, "{r}:$.output")},
    {"name": "plain instruction", "paths": "OBJECT<instruction, output>", "turns": two("{r}:$.instruction", "{r}:$.output")},
    {"name": "system instruction", "paths": "OBJECT<input, instruction, output, system>", "turns": two(ASKED, "{r}:$.output", SYSTEM)},
]


# --- fingerprints and mappings --------------------------------------------------------------------------------------


def field_paths(record: Column) -> Column:
    """The nested field paths of a variant: its schema without the types of its leaves and without ignored fields."""
    leaf = r"(?!OBJECT<|ARRAY<)[A-Z_]+(\([0-9,]*\))?"
    paths = F.regexp_replace(F.regexp_replace(F.schema_of_variant(record), f": {leaf}", ""), f"ARRAY<{leaf}>", "ARRAY<>")
    inner = r"<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>"  # a value of up to three levels
    field = rf"(?:{'|'.join(IGNORED)})(?:: (?:OBJECT|ARRAY){inner})?(?=[,>])"
    return F.regexp_replace(F.regexp_replace(paths, rf"(?<=<){field}(?:, {field})*(?:, )?", ""), rf", {field}", "")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(field_paths(record))


def filled(sql: str, get) -> str:
    """A mapping's SQL, with get(path) for each path of the record."""
    return re.sub(r"\{r\}:(\$[.\w]+)", lambda m: f"coalesce({get(m[1])}, '')", sql)


def expression(mapping: dict, record: str) -> str:
    """SQL for the turns of a variant: an array of role and text."""
    get = lambda path: f"try_variant_get({record}, '{path}', 'string')"
    if "turns" in mapping:
        return filled(mapping["turns"], get)
    item = lambda path: f"coalesce(try_variant_get(x, '{path}', 'string'), '')"
    role = item(mapping["role"])
    if "roles" in mapping:
        role = f"CASE {role} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in mapping["roles"].items()) + f" ELSE {role} END"
    turns = f"transform(try_variant_get({record}, '{mapping['list']}', 'array<variant>'), x -> named_struct('role', {role}, 'text', {item(mapping['text'])}))"
    return f"concat(array({filled(mapping['before'], get)}), {turns})" if "before" in mapping else turns


def of_layout(mark: str, mappings: list[dict], make) -> Column:
    """make(mapping) for the mapping whose fingerprint the column mark is."""
    return F.expr("CASE " + " ".join(f"WHEN {mark} = xxhash64('{m['paths']}') THEN {make(m)}" for m in mappings) + " END")


def canonical(records: DataFrame, json: str = "record", mappings: list[dict] = MAPPINGS, broken_as_null: bool = False) -> DataFrame:
    """records with the columns layout (null if unknown) and turns array<struct<role, text>>, for the JSON column."""
    v, f = fresh([*records.columns, "layout", "turns"], "variant", "fingerprint")
    parse = F.try_parse_json if broken_as_null else F.parse_json
    parsed = records.withColumn(v, parse(json)).withColumn(f, fingerprint(F.col(v)))
    turns = of_layout(f, mappings, lambda m: expression(m, v))
    return parsed.withColumns({"layout": of_layout(f, mappings, lambda m: f"'{m['name']}'"), "turns": turns}).drop(v, f)


def unmapped(records: DataFrame, json: str = "record") -> DataFrame:
    """paths, n: the layouts that no mapping knows; null paths: what is no JSON."""
    return canonical(records, json, broken_as_null=True).where("layout IS NULL").groupBy(field_paths(F.try_parse_json(json)).alias("paths")).agg(F.count("*").alias("n"))


# --- template -------------------------------------------------------------------------------------------------------


def escaped(text: str) -> str:
    return rf"replace(replace(replace({text}, '\\', '\\\\'), '</turn>', '<\\/turn>'), '##', '#\\#')"


def unescaped(text: str) -> str:
    return rf"regexp_replace({text}, '(?s)\\\\(.)', '$1')"


def render(conversations: DataFrame, turns: str = "turns") -> DataFrame:
    """The frame with formatted (text) and loss_mask: for each assistant turn its block, and where its text stands there
    (first character, from 1, and number of characters)."""
    # A role's line breaks become a mark that is no escape, so that its line stays one line.
    role = r"replace(" + escaped("t.role") + r", '\n', '\\\n')"
    blocks = F.expr(f"transform({turns}, t -> concat('### ', {role}, '\\n', {escaped('t.text')}))")
    mask = "transform(%s, (t, i) -> named_struct('block', i, 'start', char_length(concat('### ', %s)) + 2, 'length', char_length(%s), 'loss', t.role = 'assistant'))"
    mask = F.expr(f"transform(filter({mask % (turns, role, escaped('t.text'))}, m -> m.loss), m -> named_struct('block', m.block, 'start', m.start, 'length', m.length))")
    return conversations.withColumns({"formatted": F.concat(F.array_join(blocks, END), F.when(F.size(turns) > 0, F.lit(END)).otherwise("")), "loss_mask": mask})


def read_back(formatted: DataFrame) -> DataFrame:
    """The frame with turns_back (role, text) and loss_texts, from formatted and loss_mask alone."""
    (own,) = fresh([*formatted.columns, "turns_back", "loss_texts"], "blocks")
    blocks = r"filter(split(formatted, '</turn>\n', -1), b -> b <> '')"
    turn = r"regexp_extract(b, '(?s)^### ((?:[^\n\\\\]|\\\\.)*+)\n(.*)$', {0})"
    back = f"transform({own}, b -> named_struct('role', {unescaped(turn.format(1))}, 'text', {unescaped(turn.format(2))}))"
    loss = f"transform(loss_mask, m -> {unescaped(f'substring({own}[m.block], m.start, m.length)')})"
    return formatted.withColumn(own, F.expr(blocks)).withColumns({"turns_back": F.expr(back), "loss_texts": F.expr(loss)}).drop(own)


# --- rows of one turn each ------------------------------------------------------------------------------------------


def gathered(rows: DataFrame) -> DataFrame:
    """conv_id, said: the roles and texts of a conversation from its rows (conv_id, turn, role, text), in their order."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = F.expr("transform(sort_array(collect_list(t)), t -> named_struct('role', t.role, 'text', t.text))")
    return rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(whole.alias("said"))


def turns_of(role: str, text: str, role_sql: str = "t.role", more: str = "") -> str:
    return f"transform(said, (t, i) -> named_struct('{role}', {role_sql}, '{text}', CAST(i AS STRING){more}))"


#: The layouts in which ``dressed`` gives conversations, and what they have to be for it.
PLAIN_ROLES = "forall(said, t -> t.role NOT IN (" + ", ".join(f"'{n}'" for n in NAMES) + "))"
PAIR = "size(said) = 2 AND said[0].role = 'user' AND said[1].role = 'assistant'"
DRESSES = [
    ("true", f"named_struct('messages', {turns_of('role', 'content')})"),
    (PLAIN_ROLES, f"named_struct('conversations', {turns_of('from', 'value', chr(39).join(['CASE t.role WHEN ', 'user', ' THEN ', 'human', ' WHEN ', 'assistant', ' THEN ', 'gpt', ' ELSE t.role END']))})"),
    ("true", f"named_struct('data', named_struct('id', CAST(conv_id AS STRING), 'messages', {turns_of('role', 'content')}))"),
    ("true", f"named_struct('conversation', {turns_of('role', 'content')}, 'source', 'rows')"),
    (PAIR, "named_struct('prompt', '0', 'response', '1', 'metadata', named_struct('turns', size(said)))"),
    ("true", f"named_struct('uuid', conv_id, 'messages', {turns_of('role', 'content', more=', ' + chr(39) + 'weight' + chr(39) + ', 1')})"),
]


def dressed(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, said) with record, a variant in one of several layouts by conv_id. Where a layout has a turn's
    text, the record has the turn's place in said: texts of any length stay beside it."""
    pick = f"pmod(xxhash64(conv_id), {len(DRESSES)})"
    cases = " ".join(f"WHEN {pick} = {i} AND {test} THEN to_variant_object({record})" for i, (test, record) in enumerate(DRESSES))
    return conversations.withColumn("record", F.expr(f"CASE {cases} ELSE to_variant_object({DRESSES[0][1]}) END"))


def canonical_places(records: DataFrame, mappings: list[dict] = MAPPINGS) -> DataFrame:
    """conv_id, layout, turns of records whose texts are places in said: each record's fingerprint selects its mapping."""
    marked = records.withColumn("mark", fingerprint(F.col("record")))
    found = marked.withColumns({"layout": of_layout("mark", mappings, lambda m: f"'{m['name']}'"), "places": of_layout("mark", mappings, lambda m: expression(m, "record"))})
    return found.select("conv_id", "layout", F.expr("transform(places, t -> named_struct('role', t.role, 'text', said[CAST(t.text AS INT)].text))").alias("turns"))


def from_turn_rows(rows: DataFrame, mappings: list[dict] = MAPPINGS) -> DataFrame:
    """conv_id, turns of conversations that come as a row for each turn (conv_id, turn, role, text)."""
    return canonical_places(dressed(gathered(rows)), mappings).select("conv_id", "turns")
