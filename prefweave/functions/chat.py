"""Expressions over chats: arrays of (role, content)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def last(chat: Column) -> Column:
    return F.try_element_at(chat, F.lit(-1))


def valid_chat(chat: Column) -> Column:
    """Two messages or more, a first content, and a last answer that isn't empty."""
    ok = (F.size(chat) >= 2) & F.get(chat, F.lit(0)).getField("content").isNotNull() & (last(chat).getField("role") == "assistant") & (last(chat).getField("content") != "")
    return F.coalesce(ok, F.lit(False))


def valid_pair(chosen: Column, rejected: Column) -> Column:
    """Both chats are valid and their answers differ."""
    return valid_chat(chosen) & valid_chat(rejected) & F.coalesce(last(chosen).getField("content") != last(rejected).getField("content"), F.lit(False))


def clean_messages(chat: Column) -> Column:
    """Role and content only."""
    return F.transform(chat, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))


def first_turn(chosen: Column, rejected: Column) -> Column:
    """(prompt, chosen, rejected) from the first two messages, whatever follows."""
    at = lambda c, i: F.get(c, F.lit(i)).getField("content")
    return F.struct(at(chosen, 0).alias("prompt"), at(chosen, 1).alias("chosen"), at(rejected, 1).alias("rejected"))


def last_turn(chosen: Column, rejected: Column) -> Column:
    """(prompt messages, chosen, rejected): all but the last message, and both last ones."""
    prompt = F.when(F.size(chosen) > 0, F.slice(chosen, F.lit(1), F.size(chosen) - 1))
    return F.struct(prompt.alias("prompt"), last(chosen).getField("content").alias("chosen"), last(rejected).getField("content").alias("rejected"))


def append_system(chat: Column, text: str, default: str = "") -> Column:
    """``text`` at the end of the system message, or in a new one after the default prompt."""
    head = F.get(chat, F.lit(0))
    grown = F.concat(F.array(message("system", F.concat(head["content"], F.lit("\n\n" + text)))), F.slice(chat, F.lit(2), F.greatest(F.size(chat) - 1, F.lit(0))))
    fresh = F.concat(F.array(message("system", F.lit(f"{default}\n\n{text}" if default else text))), chat)
    return F.when(head["role"] == "system", grown).otherwise(fresh)


def default_system_prompt(rendered: Column, start: str = "<|im_start|>system\n", end: str = "<|im_end|>") -> Column:
    """What stands between the markers of a rendered prompt; '' without the first, an error without the last."""
    at = F.instr(rendered, start)
    rest = F.substr(rendered, at + len(start))
    stop = F.instr(rest, end)
    return F.when(at == 0, F.lit("")).when(stop == 0, F.raise_error(F.lit("the system prompt doesn't end"))).otherwise(F.substr(rest, F.lit(1), stop - 1))


def without_role(chat: Column, role: str) -> Column:
    return F.filter(chat, lambda m: m["role"] != role)


def exchange(prompt: Column, answer: Column) -> Column:
    """A chat of one question and one answer."""
    return F.array(message("user", prompt), message("assistant", answer))
