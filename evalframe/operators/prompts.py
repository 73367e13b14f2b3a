"""Prompt tables (G1-G10) and the text-inference hook.

Templates are filled in one pass: a template is split into literal parts and
``{field}`` references at plan time and becomes a single ``concat`` of
literals and columns, so text inserted for one field is never re-scanned
for another field's placeholder (Python ``str.format`` semantics).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from evalframe.operators.clean import CONDITIONS

# Template catalogue: the names and placeholders of the reference's catalogue.
# Wording is ours; load your own catalogue with ``templates_from_json``.
TEMPLATES = {
    "imitation_post_template_simple":
        "Persona: {persona}\n\nFill in every [MASKED] token so the post reads as this user wrote it.\n"
        "Original Tweet: {tweet}\n\nCompleted Tweet:",
    "imitation_replies_template_simple":
        "Persona: {persona}\n\nWrite the reply this user would post.\nTweet to reply to: {tweet}\n\nReply:",
    "imitation_post_template_no_persona":
        "Fill in every [MASKED] token so the post reads naturally.\nOriginal Tweet: {tweet}\n\nCompleted Tweet:",
    "imitation_replies_template_no_persona":
        "Write a natural reply to this post.\nTweet to reply to: {tweet}\n\nReply:",
    "imitation_post_template_generic":
        "You are an everyday user of social media. Fill in every [MASKED] token in that manner.\n"
        "Original Tweet: {tweet}\n\nCompleted Tweet:",
    "imitation_replies_template_generic":
        "You are an everyday user of social media. Write a reply in that manner.\n"
        "Tweet to reply to: {tweet}\n\nReply:",
    "persona_template_simple": "Describe the writing persona of this user.\n\n{historie}",
    "mask_opinion_template": "Replace every opinion-bearing word with [MASKED].\n\nText: {text}",
    "reflect_results_template":
        "Examine the quality of the imitation.\nPrompt: {persona}\nBest imitation: {best_preds}\n"
        "Original: {best_originals}\nPoor imitation: {worst_preds}\nOriginal: {worst_originals}\n"
        "Scores:\n{metric_scores}\nReturn an improved persona.",
    "llm_evaluation_template":
        'Compare the prediction with the reference.\nReference: "{reference}"\nPrediction: "{prediction}"\n'
        "Answer as\nCoherence: <1-5>\nConsistency: <1-5>\nJustification: <one line>",
}

# Fixed values of the baseline conditions.
GENERIC_PERSONA = ("You are an active social media user who writes posts and replies in a conversational, "
                   "authentic way. You engage with various topics and express yourself clearly and naturally "
                   "online.")
HISTORY_PERSONA_HEAD = "User Profile based on posting history:\n\n"
HISTORY_PERSONA_TAIL = ("\n\nThis user's authentic communication patterns are evidenced by their actual social "
                        "media posts and replies shown above.")
MIN_HISTORY_CHARS = 100
CONDITION_TEMPLATES = {
    "no_persona": ("imitation_post_template_no_persona", "imitation_replies_template_no_persona"),
    "generic": ("imitation_post_template_simple", "imitation_replies_template_simple"),
    "history_only": ("imitation_post_template_simple", "imitation_replies_template_simple"),
    "best_persona": ("imitation_post_template_simple", "imitation_replies_template_simple"),
}
UNPROCESSABLE_POST = "Post text could not be processed."



def template(name: str) -> str:
    """The catalogue's template of that name."""
    if name not in TEMPLATES:
        raise ValueError(f"no template {name!r}; known: {', '.join(sorted(TEMPLATES))}")
    return TEMPLATES[name]


_FIELD = re.compile(r"\{(\w+)\}")


def select_template(name: str, catalogue: dict[str, str] | None = None) -> str:
    cat = TEMPLATES if catalogue is None else catalogue
    if name not in cat:
        raise ValueError(f"Template '{name}' not found.")
    return cat[name]


def template_fields(template: str) -> list[str]:
    return _FIELD.findall(template)


def fill(template: str, **fields: Column) -> Column:
    """One-pass ``{name}`` substitution; a missing field is an error,
    a null value prints as ``None`` (as Python formatting does)."""
    parts = _FIELD.split(template.replace("{{", "\x00").replace("}}", "\x01"))
    cols = []
    for i, p in enumerate(parts):
        if i % 2 == 0:
            if p:
                cols.append(F.lit(p.replace("\x00", "{").replace("\x01", "}")))
        else:
            if p not in fields:
                raise KeyError(p)
            cols.append(F.coalesce(fields[p].cast("string"), F.lit("None")))
    return F.concat(*cols) if cols else F.lit("")


def fill_named(name: str, catalogue: dict[str, str] | None = None, **fields: Column) -> Column:
    return fill(select_template(name, catalogue), **fields)


def history_text(history: DataFrame, user: str = "user_id") -> DataFrame:
    """G1: per-user history text -- header with id and first screen name,
    bullet list of posts, list of replies that have a previous message.

    One aggregate per user over the history set (bounded by the split size).
    """
    items = F.sort_array(F.collect_list(F.struct(
        F.col("pos"), F.col("reply_to_id").isNull().alias("is_post"), F.col("full_text"),
        F.col("previous_message"), F.col("screen_name"))))
    g = history.groupBy(user).agg(items.alias("_h"))
    name = F.coalesce(F.col("_h")[0]["screen_name"], F.lit("Unknown"))
    posts = F.transform(F.filter("_h", lambda x: x["is_post"]), lambda x: F.coalesce(x["full_text"], F.lit("None")))
    replies = F.transform(
        F.filter("_h", lambda x: ~x["is_post"] & x["previous_message"].isNotNull()),
        lambda x: F.concat(F.lit("Previous message: "), x["previous_message"], F.lit(" \n "), name,
                           F.lit(" replied:"), F.coalesce(x["full_text"], F.lit("None")), F.lit(" \n")))
    text = F.concat(F.lit("User ID: "), F.col(user).cast("string"), F.lit(", Screen Name: "), name, F.lit(" \n"),
                    F.lit("Posts from User\n-"), F.array_join(posts, "\n - "),
                    F.lit("\n\nReplies from User: \n -"), F.array_join(replies, "\n -"))
    return g.select(user, text.alias("history"))


def stimulus_text(is_post: Column, masked_text: Column, dynamic_mask: Column, previous_message: Column) -> Column:
    """``Post: <masked>`` or ``Previous message: <msg>``; an empty
    stored mask falls back to the dynamic mask, an empty one to an error text."""
    stored = F.when(F.length(masked_text) > 0, masked_text)
    dyn = F.when(F.length(dynamic_mask) > 0, dynamic_mask).otherwise(F.lit(UNPROCESSABLE_POST))
    return F.when(is_post, F.concat(F.lit("Post: "), F.coalesce(stored, dyn))) \
        .otherwise(F.concat(F.lit("Previous message: "), F.coalesce(previous_message, F.lit("None"))))


def condition_personas(history: DataFrame, best: DataFrame, user: str = "user_id") -> DataFrame:
    """(user, condition, persona); history persona only from >= 100 chars of history."""
    h = history.select(user, F.when(F.length("history") >= MIN_HISTORY_CHARS, F.concat(
        F.lit(HISTORY_PERSONA_HEAD), F.col("history"), F.lit(HISTORY_PERSONA_TAIL))).alias("hp"))
    j = h.join(best.select(user, F.col("persona").alias("bp")), user, "left")
    arr = F.array(
        F.struct(F.lit("no_persona").alias("condition"), F.lit(None).cast("string").alias("persona"),
                 F.lit(True).alias("ok")),
        F.struct(F.lit("generic").alias("condition"), F.lit(GENERIC_PERSONA).alias("persona"), F.lit(True).alias("ok")),
        F.struct(F.lit("history_only").alias("condition"), F.col("hp").alias("persona"),
                 F.col("hp").isNotNull().alias("ok")),
        F.struct(F.lit("best_persona").alias("condition"), F.col("bp").alias("persona"),
                 F.col("bp").isNotNull().alias("ok")))
    return j.select(user, F.explode(arr).alias("c")).select(user, "c.condition", "c.persona", "c.ok")


def persona_marker(persona: Column, condition: Column) -> Column:
    """Stored persona, or ``[CONDITION]`` when the condition has none."""
    return F.coalesce(persona, F.concat(F.lit("["), F.upper(condition), F.lit("]")))


def baseline_run_id(prefix: str, condition: Column, timestamp: str) -> Column:
    """``<prefix>_<condition>_<timestamp>``."""
    return F.concat_ws("_", F.lit(prefix), condition, F.lit(timestamp))


def round_run_id(prefix: str, round_col: Column) -> Column:
    """``<prefix>_round_<n>``."""
    return F.concat(F.lit(prefix + "_round_"), round_col.cast("string"))


def imitation_prompt(condition: Column, is_post: Column, persona: Column, stimulus: Column) -> Column:
    """Template by condition and task type, filled with persona and stimulus."""
    e = None
    for cond, (post_t, reply_t) in CONDITION_TEMPLATES.items():
        p = fill_named(post_t, **({"persona": persona, "tweet": stimulus} if "persona" in
                                  template_fields(TEMPLATES[post_t]) else {"tweet": stimulus}))
        r = fill_named(reply_t, **({"persona": persona, "tweet": stimulus} if "persona" in
                                   template_fields(TEMPLATES[reply_t]) else {"tweet": stimulus}))
        arm = F.when(is_post, p).otherwise(r)
        e = F.when(condition == cond, arm) if e is None else e.when(condition == cond, arm)
    return e


def infer_text(df: DataFrame, prompt_col: str, fn: Callable[[pd.Series], pd.Series],
               out_col: str = "response") -> DataFrame:
    """Run a user-supplied batch text function over a prompt column.

    Arrow batches (``mapInPandas``); the function gets a ``pd.Series`` of
    prompts and returns one response per prompt.  Model clients are the
    caller's business: this hook only plans the distributed call.
    """
    cols = list(df.columns)
    schema = StructType(list(df.schema.fields) + [StructField(out_col, StringType(), True)])

    def run(batches):
        for pdf in batches:
            out = pdf[cols].copy()
            out[out_col] = pd.Series(fn(pdf[prompt_col]), index=pdf.index).astype(object)
            yield out

    return df.mapInPandas(run, schema)


def condition_list() -> Sequence[str]:
    return CONDITIONS
