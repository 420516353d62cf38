"""Chat formatting as a prefix tree.

A conversation is a path of turns. Conversations that share initial turns share those
nodes; a pack writes each of its nodes once, depth first, and a node carries its
position ids' start (tokens of its ancestors) and the token intervals it may attend to
(its ancestors' and its own).

Sorting conversations by their paths' turn digests *is* depth-first order, so there is
no group for a shared first turn: paths are dealt by ranges of (path, conversation) and
each task walks its sorted range, holding one pack. A pack closes after ``PACK_CHARS``
characters or ``PACK_CONVERSATIONS`` conversations (after a whole conversation); shared
nodes are written again in the next pack, so a first turn that a third of all
conversations share is split over as many packs and tasks as its subtree fills.

Template, for every turn: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. In texts and roles a
backslash goes after the first character of every control string (and of every control
string that has backslashes there already), which is undone by taking one away; line
feeds and per cent signs in roles are written %0A and %25.

Defined results: null roles and texts are empty strings; turns are ordered by turn, then
role and text (nulls first), and repeated rows stay; a row with a null conversation id is a
conversation of its own, of one turn; an empty table gives no packs; very long texts make
a pack of their own; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col
from .tokens import encoder, vocabulary_path

PACK_CHARS = 1 << 18
PACK_CONVERSATIONS = 256
#: Fixed values: (first character, rest) of the strings that chat templates give a meaning.
CONTROL = (("<", "|"), ("<", "s>"), ("<", "/s>"), ("[", "INST]"), ("[", "/INST]"))
OPEN, BREAK, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"

_rests = {a: "|".join(re.escape(r) for f, r in CONTROL if f == a) for a, _ in CONTROL}
_ESCAPE = re.compile("|".join(f"(?<={re.escape(a)})(?=\\\\*(?:{r}))" for a, r in _rests.items()))
_UNESCAPE = re.compile("|".join(f"(?<={re.escape(a)})\\\\(?=\\\\*(?:{r}))" for a, r in _rests.items()))


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub("", text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def paths(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, path, turns): turns in order and the chain of their digests, 16 bytes a turn."""
    turn = F.struct(
        col(turn_col).alias("turn"),
        F.coalesce(col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    known = df.where(col(conv_col).isNotNull())
    grouped = known.groupBy(col(conv_col).alias("conv")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    alone = df.where(col(conv_col).isNull()).select(col(conv_col).alias("conv"), F.array(turn).alias("turns"))
    grouped = grouped.union(alone)
    digest = F.transform("turns", lambda t: F.md5(F.concat_ws("\n", t["role"], t["text"])))
    return grouped.select("conv", F.array_join(digest, "").alias("path"), "turns")


NODE = "struct<parent:int,start:int,end:int,role:string,text_start:int,text_end:int,loss:boolean,position:int,attend:array<struct<start:int,end:int>>,token_start:int,token_end:int>"
PACK = f"pack long, text string, ids binary, nodes array<{NODE}>, conversations array<struct<conv:CONV,leaf:int>>"


def packs(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_roles: tuple[str, ...] = ("assistant",),
    tokenizer: str | None = None,
    pack_chars: int = PACK_CHARS,
    pack_conversations: int = PACK_CONVERSATIONS,
) -> DataFrame:
    """One row a pack: its text and token ids (each node once, depth first), the nodes
    (character and token spans, parent, loss mark, first position id, intervals to attend
    to) and each conversation's last node.

    Spans count code points of ``text`` and ids of ``ids`` (little-endian 4-byte ids;
    every node is tokenised by itself, so shared nodes are the same tokens in every
    conversation).
    """
    vocabulary = tokenizer or vocabulary_path("byte_bpe_50k.json")
    dealt = (
        paths(df, conv_col, turn_col, role_col, text_col)
        .repartitionByRange("path", "conv")
        .sortWithinPartitions("path", "conv")
    )
    kind = df.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        encode = encoder(vocabulary).encode
        number = TaskContext.get().partitionId() << 40
        arrow = to_arrow_schema(schema)

        def empty() -> dict:
            return {"text": [], "ids": [], "nodes": [], "conversations": [], "chars": 0, "tokens": 0}

        def row(pack: dict, number: int) -> pa.RecordBatch:
            value = {
                "pack": number,
                "text": "".join(pack["text"]),
                "ids": b"".join(pack["ids"]),
                "nodes": pack["nodes"],
                "conversations": pack["conversations"],
            }
            return pa.RecordBatch.from_pylist([value], schema=arrow)

        def add(pack: dict, parent: int, role: str, text: str) -> int:
            head, body = OPEN + escape_role(role) + BREAK, escape(text)
            shown = head + body + CLOSE
            ids = encode(shown)
            start, first = pack["chars"], pack["tokens"]
            end, last = start + len(shown), first + len(ids) // 4
            up = pack["nodes"][parent] if parent >= 0 else None
            before = up["attend"] if up else []
            if before and before[-1]["end"] == first:
                attend = [*before[:-1], {"start": before[-1]["start"], "end": last}]
            else:
                attend = [*before, {"start": first, "end": last}]
            pack["nodes"].append(
                {
                    "parent": parent,
                    "start": start,
                    "end": end,
                    "role": role,
                    "text_start": start + len(head),
                    "text_end": start + len(head) + len(body),
                    "loss": role in loss_roles,
                    "position": up["position"] + up["token_end"] - up["token_start"] if up else 0,
                    "attend": attend,
                    "token_start": first,
                    "token_end": last,
                }
            )
            pack["text"].append(shown)
            pack["ids"].append(ids)
            pack["chars"], pack["tokens"] = end, last
            return len(pack["nodes"]) - 1

        pack, held = empty(), []  # held: (role, text, node) from the root to the last leaf
        for batch in batches:
            for i in range(batch.num_rows):
                conv, turns = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                shared = 0
                for t, (role, text, _) in zip(turns, held):
                    if t["role"] != role or t["text"] != text:
                        break
                    shared += 1
                del held[shared:]
                for t in turns[shared:]:
                    node = add(pack, held[-1][2] if held else -1, t["role"], t["text"])
                    held.append((t["role"], t["text"], node))
                pack["conversations"].append({"conv": conv, "leaf": held[-1][2] if held else -1})
                if pack["chars"] >= pack_chars or len(pack["conversations"]) >= pack_conversations:
                    yield row(pack, number)
                    number, pack, held = number + 1, empty(), []
        if pack["conversations"]:
            yield row(pack, number)

    spec = PACK.replace("CONV", kind)
    schema = T.StructType.fromDDL(spec)
    return dealt.select("conv", "turns").mapInArrow(run, schema)


def conversations(packed: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Read packs back: one row a conversation, its turns and its text under the loss mask.

    (conv_col, turns array<struct<role,text>>, loss_text, formatted): everything is cut
    out of the packs' texts along the path from the leaf to the root.
    """
    kind = packed.schema["conversations"].dataType.elementType["conv"].dataType.simpleString()
    schema = T.StructType.fromDDL(
        f"conv {kind}, turns array<struct<role:string,text:string>>, loss_text string, formatted string"
    )

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                text, nodes, leaves = (batch.column(c)[i].as_py() for c in range(3))
                rows = []
                for leaf in leaves:
                    path, at = [], leaf["leaf"]
                    while at >= 0:
                        path.append(nodes[at])
                        at = nodes[at]["parent"]
                    path.reverse()
                    turns, loss = [], []
                    for n in path:
                        role = text[n["start"] + len(OPEN) : n["text_start"] - len(BREAK)]
                        body = unescape(text[n["text_start"] : n["text_end"]])
                        turns.append({"role": unescape_role(role), "text": body})
                        if n["loss"]:
                            loss.append(body)
                    shown = "".join(text[n["start"] : n["end"]] for n in path)
                    rows.append(
                        {"conv": leaf["conv"], "turns": turns, "loss_text": "".join(loss), "formatted": shown}
                    )
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    back = packed.select("text", "nodes", "conversations").mapInArrow(run, schema)
    return back.select(col("conv").alias(conv_col), "turns", "loss_text", "formatted")
