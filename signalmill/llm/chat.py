"""Chat formatting by schema fingerprints.

A record's layout is the set of its nested field paths (``messages[].role``). The sorted
paths are hashed; the hash selects a declarative mapping that says where turns, roles and
texts are. Canonical turns are then rendered with a template that marks turns and escapes
control strings inside roles and texts reversibly.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalmill.llm.common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROL = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: A conversation longer than this many code points is rendered in several rows, in order.
PART = 4_000_000


# -- fingerprints ---------------------------------------------------------------------------


def value_paths(value, at: str = "") -> set[str]:
    """Leaf paths of a JSON value; list items share the path ``x[]``."""
    if isinstance(value, dict):
        return set().union(*(value_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(value_paths(v, at + "[]") for v in value)) if value else {at + "[]"}
    return {at}


def type_paths(kind: T.DataType, at: str = "") -> set[str]:
    """The same for a Spark type."""
    if isinstance(kind, T.StructType):
        return set().union(*(type_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return type_paths(kind.elementType, at + "[]")
    return {at}


def fingerprint(paths) -> str:
    return hashlib.sha1("\n".join(sorted(paths)).encode()).hexdigest()


#: Declarative mappings, by the paths they need. list: turns at a path with role and text
#: fields; pairs: a list of two-item lists before the fields; before and fields: (field, role)
#: in order, empty ones skipped.
LAYOUTS = (
    ({"messages[].role", "messages[].content"}, {"list": "messages", "role": "role", "text": "content"}),
    ({"messages[].role", "messages[].content", "system"}, {"before": [("system", "system")], "list": "messages", "role": "role", "text": "content"}),
    ({"conversations[].from", "conversations[].value"}, {"list": "conversations", "role": "from", "text": "value"}),
    ({"conversations[].from", "conversations[].value", "system"}, {"before": [("system", "system")], "list": "conversations", "role": "from", "text": "value"}),
    ({"turns[].role", "turns[].text"}, {"list": "turns", "role": "role", "text": "text"}),
    ({"instruction", "output"}, {"fields": [("instruction", "user"), ("output", "assistant")]}),
    ({"instruction", "input", "output"}, {"fields": [("instruction+input", "user"), ("output", "assistant")]}),
    ({"prompt", "completion"}, {"fields": [("prompt", "user"), ("completion", "assistant")]}),
    ({"prompt", "response"}, {"fields": [("prompt", "user"), ("response", "assistant")]}),
    ({"system", "prompt", "response"}, {"fields": [("system", "system"), ("prompt", "user"), ("response", "assistant")]}),
    ({"question", "answer"}, {"fields": [("question", "user"), ("answer", "assistant")]}),
    ({"history[][]", "prompt", "response"}, {"pairs": "history", "fields": [("prompt", "user"), ("response", "assistant")]}),
)
#: Tables with a row per turn: their columns, and which of them is what.
ROW_LAYOUTS = (
    ({"conv_id", "turn", "role", "text"}, {"key": "conv_id", "order": "turn", "role": "role", "text": "text"}),
    ({"conversation_id", "turn", "role", "content"}, {"key": "conversation_id", "order": "turn", "role": "role", "text": "content"}),
    ({"conversation_id", "turn", "from", "value"}, {"key": "conversation_id", "order": "turn", "role": "from", "text": "value"}),
)


class Mappings:
    """The mapping that a layout's fingerprint selects.

    Only paths that some layout declares are hashed, so identifiers and metadata beside them
    change no fingerprint. A fingerprint that is not a layout's own takes the layout of most
    paths that the record holds all of (the first of equals); an empty list or a list of
    parts at a path holds it too.
    """

    def __init__(self, layouts=LAYOUTS):
        self.layouts = sorted(layouts, key=lambda x: -len(x[0]))
        self.declared = set().union(*(paths for paths, _ in layouts))
        self.known = {fingerprint(paths): mapping for paths, mapping in layouts}

    def _holds(self, paths: set[str], path: str) -> bool:
        return any(p == path or p.startswith((path + "[", path + ".")) or p.endswith("[]") and path.startswith(p + ".") for p in paths)

    def select(self, paths: set[str]) -> tuple[str, dict | None]:
        """(fingerprint, mapping or None) of a record's paths."""
        held = {d for d in self.declared if self._holds(paths, d)}
        mark = fingerprint(held)
        if mark not in self.known:
            self.known[mark] = next((m for need, m in self.layouts if need <= held), None)
        return mark, self.known[mark]


def _said(x) -> str:
    """A value as text: lists of parts give their texts, other structures their JSON."""
    if x is None:
        return ""
    if isinstance(x, list) and x and all(isinstance(p, dict) and isinstance(p.get("text"), str) or isinstance(p, str) for p in x):
        return "\n".join(p if isinstance(p, str) else p["text"] for p in x)
    return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def turns_of(record: dict, mapping: dict) -> list[tuple[str, str]]:
    """(role, text) of each turn; a turn without text says the tools it calls, items that are no objects say themselves without a role."""

    def field(name: str) -> str:
        return "\n\n".join(x for x in (_said(record.get(n)) for n in name.split("+")) if x)

    out = [(role, field(name)) for name, role in mapping.get("before", []) if field(name)]
    for pair in record.get(mapping.get("pairs"), None) or []:
        out += zip(("user", "assistant"), map(_said, pair))
    for item in record.get(mapping.get("list"), None) or []:
        if not isinstance(item, dict):
            out.append(("", _said(item)))
            continue
        role = _said(item.get(mapping["role"]))
        out.append((ROLES.get(role, role), _said(item.get(mapping["text"])) or _said(item.get("tool_calls"))))
    out += [(role, field(name)) for name, role in mapping.get("fields", []) if field(name)]
    return out


TURNS = "conv_id string, turn long, role string, text string, fingerprint string"


def turns_from_json(df: DataFrame, id_col: str, json_col: str, layouts=LAYOUTS) -> DataFrame:
    """Canonical turns of JSON records. Unknown layouts and broken JSON give one turn with a null role and text; a known layout with an empty list gives none."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mappings = Mappings(layouts)
        for batch in batches:
            rows = []
            for key, raw in zip(batch["i"], batch["j"]):
                try:
                    record = json.loads(raw)
                except (TypeError, ValueError):
                    record = None
                mark, mapping = mappings.select(value_paths(record)) if isinstance(record, dict) else (None, None)
                turns = turns_of(record, mapping) if mapping else [(None, None)]
                rows += [(key, n, role, text, mark) for n, (role, text) in enumerate(turns)]
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "fingerprint"]).astype({"turn": "int64"})

    # Ids travel as text: a batch with a null would turn them into doubles.
    found = df.select(F.col(id_col).cast("long").cast("string").alias("i"), F.col(json_col).cast("string").alias("j")).mapInPandas(each, TURNS)
    return found.withColumn("conv_id", F.col("conv_id").cast("long"))


def turns_from_rows(df: DataFrame, layouts=ROW_LAYOUTS) -> DataFrame:
    """Canonical turns of a table with a row per turn; the fingerprint of its schema selects the mapping, other columns are left."""
    mark, m = Mappings(layouts).select(type_paths(df.schema))
    if not m:
        raise ValueError(f"no mapping for the layout {sorted(type_paths(df.schema))}")
    role = F.col(m["role"])
    for name, canonical in ROLES.items():
        role = F.when(F.col(m["role"]) == name, canonical).otherwise(role)
    return df.select(
        F.col(m["key"]).cast("long").alias("conv_id"), F.col(m["order"]).cast("long").alias("turn"), role.alias("role"), F.col(m["text"]).alias("text"), F.lit(mark).alias("fingerprint")
    )


# -- template -------------------------------------------------------------------------------

_FIND = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_BACK = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    r"""A backslash doubles; a control string gets one after its first character, so none is left whole."""
    return _FIND.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """The marked turn, and where its text starts and ends in it."""
    head = f"{OPEN}{escape(role).replace(chr(10), chr(92) + chr(10))}\n"
    body = escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


_HEAD = re.compile(r"((?:\\.|[^\\\n])*)\n", re.S)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each marked turn."""
    at = 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at + len(OPEN))
        end = formatted.index(CLOSE + "\n", head.end())
        yield unescape(head[1]), unescape(formatted[head.end() : end])
        at = end + len(CLOSE) + 1


FORMATTED = "conv_id string, part int, n_turns long, formatted string, loss array<struct<start:long,end:long>>"


def format_turns(turns: DataFrame, loss_roles=("assistant",), part: int = PART) -> DataFrame:
    """Rows (conv_id, part, n_turns, formatted, loss spans in code points), each conversation in order.

    Turns sort by turn (null first), then role and text, so ties are settled; repeated rows
    are turns of their own. Null roles and texts count as empty. Null ids make one
    conversation. Turns stream through a task in order, and a conversation of more than
    `part` code points takes several rows that follow each other, so no conversation is held
    whole; the parts join to the whole text.
    """
    loss_roles = tuple(loss_roles)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = {"key": object(), "part": 0}
        texts, spans, length = [], [], 0
        rows: list = []

        def flush():
            nonlocal texts, spans, length
            if texts:
                rows.append((state["key"], state["part"], len(texts), "".join(texts), spans))
                state["part"] += 1
            texts, spans, length = [], [], 0

        for batch in batches:
            for key, role, text in zip(batch["conv_id"], batch["role"], batch["text"]):
                if key != state["key"]:
                    flush()
                    state.update(key=key, part=0)
                piece, start, end = render(role, text)
                if role in loss_roles:
                    spans.append({"start": length + start, "end": length + end})
                texts.append(piece)
                length += len(piece)
                if length > part:
                    flush()
            if rows:
                yield pd.DataFrame(rows, columns=["conv_id", "part", "n_turns", "formatted", "loss"])
                rows.clear()
        flush()
        if rows:
            yield pd.DataFrame(rows, columns=["conv_id", "part", "n_turns", "formatted", "loss"])

    ready = turns.select(F.col("conv_id").cast("string").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return ready.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInPandas(each, FORMATTED).withColumn("conv_id", F.col("conv_id").cast("long"))


DIGEST = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from the rendered parts as format_turns() orders them."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def done(s):
            return (s["key"], s["n"], s["turns"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["all"])

        for batch in batches:
            rows = []
            for key, number, text, spans in zip(batch["conv_id"], batch["part"], batch["formatted"], batch["loss"]):
                if number == 0:
                    if now:
                        rows.append(done(now))
                    now = {"key": key, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0}
                for role, said in parse(text):
                    now["turns"].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    now["n"] += 1
                for x in spans:
                    said = unescape(text[x["start"] : x["end"]])
                    now["chars"] += len(said)
                    now["loss"].update(said.encode("utf-8", "surrogatepass"))
                now["all"] += len(text)
            if rows:
                yield pd.DataFrame(rows, columns=names)
        if now:
            yield pd.DataFrame([done(now)], columns=names)

    read = formatted.withColumn("conv_id", F.col("conv_id").cast("string")).mapInPandas(each, DIGEST)
    return read.withColumn("conv_id", F.col("conv_id").cast("long"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = json.dumps({"messages": [{"role": "user", "content": said}, {"role": "assistant", "content": said}]})
    own = turns_from_json(spark.range(-1, 0).select("id", F.lit(extra).alias("j")), "id", "j")
    return digests(format_turns(turns_from_rows(table(spark, sf_dir, "conversations")).unionByName(own)))
