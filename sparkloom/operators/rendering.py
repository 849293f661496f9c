"""Conversations through a template to token ids, with a mask of what the assistant says."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Template:
    """What stands in front of a turn ({role}), behind it, at the begin, and in front of an answer that is asked for."""

    before: str
    after: str
    begin: str = ""
    asked: str = ""

    def turn(self, role: str, content: str) -> str:
        return self.before.replace("{role}", role) + content + self.after

    def prompt(self) -> str:
        return self.asked or self.before.replace("{role}", "assistant")


def _renderer(template: Template, vocabulary: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    # an added token is cut out before anything else is, so ids in front of it do not depend on what follows
    hard = next((t for t in added if template.after.endswith(t)), None)

    def encode(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    def one(messages, start: int):
        """ids, mask, violation."""
        turns = [template.turn(m["role"] or "", m["content"] or "") for m in messages]
        if hard:
            parts = [encode((template.begin if not k else "") + t) for k, t in enumerate(turns)] or [encode(template.begin)]
            ids = [i for p in parts for i in p]
            length = 0
            at = [0] + [length := length + len(p) for p in parts]
        else:
            ids, at = encode(template.begin + "".join(turns)), None
        mask, text = [0] * len(ids), template.begin
        for k, m in enumerate(messages):
            if k >= start and m["role"] == "assistant":
                if hard:
                    before = encode((template.begin if not k else "") + template.prompt())
                    a, b = at[k] + len(before), at[k + 1]
                    stable = ids[at[k] : a] == before
                else:
                    before, through = encode(text + template.prompt()), encode(text + turns[k])
                    a, b = len(before), len(through)
                    stable = ids[:a] == before
                    if stable and ids[:b] != through:
                        return ids, None, f"the template is not stable behind message {k}"
                if not stable:
                    return ids, None, f"the template is not stable in front of message {k}"
                if b <= a:
                    return ids, None, f"message {k} has no tokens"
                mask[a:b] = [1] * (b - a)
            text += turns[k]
        if mask:
            mask[-1] = 0  # nothing follows the last token
        return ids, mask, None if any(mask) else "no assistant tokens"

    return one


def token_masks(conversations: DataFrame, template: Template, vocabulary: str, messages: str = "messages", start: str | None = None, most: int | None = None) -> DataFrame:
    """conversations with input_ids, loss_mask (1 for the tokens of assistant turns from message start on) and violation.

    An answer's tokens begin behind the prompt that asks for it and end with
    its turn. The ids of each prefix have to be the first ids of the whole;
    where a vocabulary or template breaks that, the row has a violation and
    no mask. If turns end with an added token of the vocabulary, each turn is
    encoded once; else prefixes are encoded again for each answer. The last
    token is never set. More than most tokens are a violation. A null role or
    content is empty; a row without messages has no ids. Other columns are carried along.
    """
    cols = conversations.columns
    rows = conversations.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col(f"`{messages}`").alias("messages"), (F.col(f"`{start}`") if start else F.lit(0)).cast("int").alias("start"))

    def run(batches):
        one = _renderer(template, vocabulary)
        for batch in batches:
            out = [one(m or [], s or 0) for m, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            out = [(i, None, f"more than {most} tokens") if most is not None and len(i) > most else (i, m, v) for i, m, v in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.list_(pa.int32())), pa.array([o[1] for o in out], pa.list_(pa.int32())), pa.array([o[2] for o in out], pa.string())], names=["row", "input_ids", "loss_mask", "violation"])

    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType([rows.schema["row"], T.StructField("input_ids", numbers), T.StructField("loss_mask", numbers), T.StructField("violation", T.StringType())])
    return rows.mapInArrow(run, schema).select("row.*", "input_ids", "loss_mask", "violation")
