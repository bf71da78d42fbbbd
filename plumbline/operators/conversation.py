"""Conversations: history windows, message arrays, titles and counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import ref
from plumbline.functions.text import strip, token_estimate
from plumbline.operators.tables import excerpt

# Fixed values.
MAX_TURNS = 10
TITLE_CHARS = 80
CONTEXT_CHARS = 6000
NO_CONTEXT = "No relevant context was retrieved from the knowledge base."
NO_DOCUMENTS = "No documents are available in the knowledge base."
CONTEXT_BEGIN = "--- BEGIN CONTEXT ---"
CONTEXT_END = "--- END CONTEXT ---"


def history(messages: DataFrame, key: str, order: Sequence[str], max_turns: int = MAX_TURNS) -> DataFrame:
    """The last ``2 * max_turns`` messages of each conversation, numbered from the oldest kept.

    The cut happens within tasks before the shuffle, so a conversation of any length
    sends at most that many messages per task.
    """
    most = 2 * max_turns
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    kept = messages.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= most)
    total = F.max("_back").over(Window.partitionBy(key))  # at most ``most`` rows per key here
    return kept.withColumn("position", (total - F.col("_back") + 1).cast("long")).drop("_back")


def message(role: Column | str, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def context_section(context: Column, instructions: str, limit: int = CONTEXT_CHARS) -> Column:
    cut = F.coalesce(F.substring(context, 1, limit), F.lit(""))
    body = F.when(strip(cut) == "", NO_CONTEXT).otherwise(cut)
    return F.concat(F.lit(f"{instructions}\n\n{CONTEXT_BEGIN}\n"), body, F.lit(f"\n{CONTEXT_END}"))


def build_messages(
    questions: DataFrame,
    history_rows: DataFrame,
    key: str,
    system_prompt: str,
    instructions: str,
    base_name: str | None = None,
    limit: int = CONTEXT_CHARS,
) -> DataFrame:
    """One array of messages per question: system, context, history, question last.

    ``questions`` has ``(key, question, context)``; ``history_rows`` is the output of
    :func:`history`, so its lists are bounded by the window.
    """
    system = system_prompt + (f"\n\nKnowledge Base: {base_name}" if base_name else "")
    lists = history_rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "role", "text"))).alias("_h"))
    joined = questions.join(lists, key, "left")
    past = F.transform(F.coalesce("_h", F.array().cast(lists.schema["_h"].dataType)), lambda m: message(m["role"], m["text"]))
    head = F.array(message("system", F.lit(system)), message("system", context_section(F.col("context"), instructions, limit)))
    return joined.select(
        *[ref(c) for c in questions.columns if c not in ("question", "context")],
        F.concat(head, past, F.array(message("user", F.col("question")))).alias("messages"),
    )


def fallback_messages(questions: DataFrame, system_prompt: str) -> DataFrame:
    """Message arrays for questions without any document."""
    parts = F.array(
        message("system", F.lit(system_prompt)), message("system", F.lit(NO_DOCUMENTS)), message("user", F.col("question"))
    )
    return questions.select(*[ref(c) for c in questions.columns if c != "question"], parts.alias("messages"))


def agent_history(messages: DataFrame, key: str, order: Sequence[str], limit: int) -> DataFrame:
    """Last ``limit`` messages of each task; sender names made safe, empty tool fields as NULL."""
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    kept = messages.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= limit)
    name = F.when(F.col("sender") != "", F.translate("sender", ":-", "__"))
    return kept.select(
        key,
        *order,
        "role",
        F.col("text").alias("content"),
        F.when(F.col("tool_calls") != "", F.col("tool_calls")).alias("tool_calls"),
        F.when(F.col("tool_call_id") != "", F.col("tool_call_id")).alias("tool_call_id"),
        name.alias("name"),
    )


def session_stats(messages: DataFrame, key: str, text: str = "text") -> DataFrame:
    return messages.groupBy(key).agg(F.count("*").alias("total_messages"), F.sum(token_estimate(F.col(text))).alias("total_tokens"))


def session_titles(messages: DataFrame, key: str, order: str, text: str = "text", size: int = TITLE_CHARS) -> DataFrame:
    """Title of each conversation: its first user message, cut. A partial minimum per task;
    only the cut text is carried along."""
    users = messages.where(F.col("role") == "user").select(key, order, excerpt(F.col(text), size).alias("_title"))
    return users.groupBy(key).agg(F.min_by("_title", order).alias("title"))
