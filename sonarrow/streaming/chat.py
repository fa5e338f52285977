"""A chat loop over streams of heard texts: the history of each conversation is state, a failed turn leaves none of it.

A turn sends the system message, the history and what was heard to a responder. If that answers, the heard text and the
answer join the history; if it fails, neither does, so no later request holds a turn without an answer.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .stateful import likeness

#: What is taken off both ends of heard texts and replies.
BLANK = " \t\n\r\v\f"
#: How like a text's first words must be to the wake phrase.
AWAKE = 0.7
MESSAGES = "array<struct<role:string,content:string>>"
#: What a responder may raise for a turn to count as failed; anything else ends the query.
FAILURES = (OSError, ValueError)


def is_awake(heard: str, wake: str) -> bool:
    """Whether the first words of what was heard, as many as the wake phrase has, are near it."""
    first = heard.split()[: len(wake.split())]
    return bool(likeness(" ".join(first).lower(), wake.lower()) >= AWAKE)


class Chat(StatefulProcessor):
    """History of a conversation as a list state, to which answered turns are appended."""

    def __init__(self, respond: Callable[[list[dict], dict], str], system: str, wake: str | None, names: list[str]):
        self.respond, self.system, self.wake, self.names = respond, system, wake, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getListState("history", T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        past = [{"role": r, "content": c} for r, c in self.history.get()]
        before, out = len(past), []
        for row in pd.concat(list(rows)).sort_values("turn").to_dict("records"):
            heard = (row["text"] or "").strip(BLANK)
            if not heard or (self.wake is not None and not is_awake(heard, self.wake)):
                continue
            user = {"role": "user", "content": heard}
            request = [{"role": "system", "content": self.system}, *past, user]
            reply = error = None
            try:
                reply = self.respond(request, row).strip(BLANK)
            except FAILURES as e:
                error = f"{type(e).__name__}: {e}"
            else:
                past += [user, {"role": "assistant", "content": reply}]
            out.append((key[0], row["turn"], heard, json.dumps(request), reply, error))
        if len(past) > before:  # what is written grows with the batch and not with the history
            self.history.appendList([(m["role"], m["content"]) for m in past[before:]])
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def chat_stream(turns: DataFrame, respond: Callable[[list[dict], dict], str], *, system: str, key: str = "conv_id", wake: str | None = None) -> DataFrame:
    """(key, turn, heard, messages, reply, error) of a stream of heard texts (key, turn, text, and what `respond` needs).

    `respond(messages, row)` runs in a task, once for each turn or, if the task is run again, more often; messages are
    dicts of role and content. A turn whose call raises one of FAILURES has its error and no reply. Texts without words
    and, with `wake`, those that do not begin like it are passed over. A batch's turns are taken in order of turn; turns of
    one conversation have to arrive in that order. The session has to use stateful.STATE_STORE.
    """
    fields = T.StructType([turns.schema[key], turns.schema["turn"], *T.StructType.fromDDL("heard string, messages string, reply string, error string")])
    out = turns.groupBy(key).transformWithStateInPandas(Chat(respond, system, wake, fields.names), fields, "Append", "None")
    return out.withColumn("messages", F.from_json("messages", MESSAGES))


def chat_turns(turns: DataFrame, reply: Column, *, system: str, key: str = "conv_id") -> DataFrame:
    """The same (without error) of a table whose replies are known, null where the turn failed.

    A request holds all that was said before it, so the result grows with the square of a conversation's turns.
    """
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    d = turns.select(key, "turn", F.btrim("text", F.lit(BLANK)).alias("heard"), F.btrim(reply, F.lit(BLANK)).alias("reply")).where("heard <> ''")
    before = Window.partitionBy(key).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    answered = F.when(F.col("reply").isNotNull(), F.array(message("user", F.col("heard")), message("assistant", F.col("reply"))))
    past = F.flatten(F.collect_list(answered).over(before))
    messages = F.concat(F.array(message("system", F.lit(system))), past, F.array(message("user", F.col("heard"))))
    return d.select(key, "turn", "heard", messages.alias("messages"), "reply")
