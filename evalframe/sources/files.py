"""File sources and sinks.

* raw post dump: CSV with string ids, malformed lines dropped (S1)
* per-user documents: one JSONL file per user whose five lines mean history,
  holdout, runs, evaluations, reflections (S2-S5); read as whole files,
  exploded with their line index, parsed with explicit schemas and
  normalised into the six engine tables
* aggregate CSVs with two header rows (S9) -> long form
* writers for per-user files, JSON and CSV exports (S10-S13)
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalframe.functions.text import blank_to_null

POST_CSV_SCHEMA = ("tweet_id string, original_user_id string, reply_to_id string, screen_name string, "
                   "created_at string, collected_at string, expandedURL string, full_text string, "
                   "retweeted_user_ID string")

TWEET = ("struct<tweet_id:string, full_text:string, screen_name:string, created_at:string, "
         "original_user_id:string, reply_to_id:string, previous_message:string, masked_text:string, "
         "retweeted_user_ID:string>")
ROUGE = "struct<rouge1:double, rouge2:double, rougeL:double, rougeLsum:double>"
BLEU = ("struct<bleu:double, precisions:array<double>, brevity_penalty:double, length_ratio:double, "
        "translation_length:int, reference_length:int>")
BERT = "struct<precision:double, recall:double, f1:double>"
PERP = "struct<mean_perplexity:double, perplexities:array<double>>"
LLM = "struct<coherence_score:int, consistency_score:int, justification:string, raw_response:string>"
ITEM = (f"struct<index:int, prediction:string, reference:string, combined_score:double, tweet_id:string, "
        f"rouge:{ROUGE}, bleu:string, perplexity:{PERP}, bertscore:{BERT}, llm_evaluation:{LLM}>")
EVAL = (f"struct<run_id:string, timestamp:string, evaluation_results:struct<"
        f"overall:struct<rouge:{ROUGE}, bleu:string, bertscore:{BERT}, perplexity:{PERP}, total_samples:int>, "
        f"individual_scores:array<{ITEM}>, best_predictions:array<{ITEM}>, worst_predictions:array<{ITEM}>, "
        f"statistics:struct<mean_combined_score:double, std_combined_score:double, best_score:double, "
        f"worst_score:double>>>")
RUN = ("struct<run_id:string, persona:string, imitations:array<struct<tweet_id:string, stimulus:string, "
       "imitation:string>>>")
REFL = ("struct<run_id:string, iteration:int, reflection_results:struct<reflection_on_results:string, "
        "improved_persona:string>>")
# one union schema for every line: parsing is key-based, so any line may carry any block
LINE_SCHEMA = (f"struct<user_id:string, set:string, tweets:array<{TWEET}>, runs:array<{RUN}>, "
               f"evaluations:array<{EVAL}>, reflections:array<{REFL}>>")
LINE_NAMES = {0: "history", 1: "holdout", 2: "runs", 3: "evaluations", 4: "reflections"}


def bleu_layout(text: Column) -> Column:
    """The BLEU object from its JSON text, which may be the whole object, ``{"score": x}`` or a number."""
    s = F.from_json(text, BLEU)
    value = F.coalesce(s["bleu"], F.get_json_object(text, "$.score").try_cast("double"), text.try_cast("double"))
    rest = ["precisions", "brevity_penalty", "length_ratio", "translation_length", "reference_length"]
    return F.when(text.isNotNull(), F.struct(value.alias("bleu"), *[s[f].alias(f) for f in rest]))


def read_posts_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw post dump; ids stay strings, malformed records are dropped."""
    return (spark.read.schema(POST_CSV_SCHEMA).option("header", True).option("mode", "DROPMALFORMED")
            .option("multiLine", True).option("escape", '"').csv(path)
            .withColumnRenamed("original_user_id", "user_id")
            .withColumnRenamed("retweeted_user_ID", "retweeted_user_id"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of all lines under ``path``, counted from 0 in each file.

    A large file is read by many tasks: the lines of a split keep their order, counts per split give
    its first number.  The broadcast table has one row for each file split, of which the driver
    holds the list anyway."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    splits = lines.groupBy("file", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return lines.join(F.broadcast(splits), ["file", "split"]).select("file", (F.col("at") + F.col("shift")).alias("line_no"), "line")


def user_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every non-blank line of every user file with its 0-based line
    index and the parsed JSON (malformed lines: ``ok`` false, blocks null)."""
    lines = numbered_lines(spark, path).where(F.trim(F.translate("line", "\r\t", "  ")) != "")
    parsed = F.from_json("line", LINE_SCHEMA, {"allowNonNumericNumbers": "true", "mode": "PERMISSIVE"})
    out = lines.select("file", "line_no", "line", parsed.alias("j"))
    ok = (F.col("j.user_id").isNotNull() | F.col("j.tweets").isNotNull() | F.col("j.runs").isNotNull()
          | F.col("j.evaluations").isNotNull() | F.col("j.reflections").isNotNull())
    return out.withColumn("ok", ok)


def normalise_user_files(lines: DataFrame, key_based: bool = True) -> dict[str, DataFrame]:
    """The six engine tables of 1.3 from parsed user-file lines.

    ``key_based`` (S4) takes runs / evaluations / reflections from any line
    that carries them; otherwise a block is read only from its fixed line.
    The user of a file is the first line that names one (line 5 has none).
    """
    users = lines.where(F.col("j.user_id").isNotNull()).groupBy("file").agg(
        F.min_by("j.user_id", "line_no").alias("user_id"))
    # a line that names its user keeps it: several users may share a file
    lines = lines.join(users, "file", "left").withColumn("user_id", F.coalesce("j.user_id", "user_id"))

    def block(name, line_no):
        b = lines.where(F.col(f"j.{name}").isNotNull())
        return b if key_based else b.where(F.col("line_no") == line_no)

    tw = block("tweets", -1) if key_based else lines.where(F.col("line_no").isin(0, 1))
    tw = tw.where(F.col("j.tweets").isNotNull())
    posts = tw.select("user_id", F.coalesce("j.set", F.when(F.col("line_no") == 0, F.lit("history"))
                                            .otherwise(F.lit("holdout"))).alias("set"),
                      F.posexplode("j.tweets").alias("pos", "t")).select(
        "user_id", "set", "pos", "t.tweet_id", "t.screen_name", "t.created_at", "t.full_text",
        blank_to_null(F.col("t.reply_to_id")).alias("reply_to_id"),
        blank_to_null(F.col("t.retweeted_user_ID")).alias("retweeted_user_id"),
        "t.previous_message", "t.masked_text")
    rn = block("runs", 2).select("user_id", F.explode("j.runs").alias("r"))
    runs = rn.select("user_id", "r.run_id", "r.persona")
    imitations = rn.select("user_id", "r.run_id", F.posexplode("r.imitations").alias("pos", "i")).select(
        "user_id", "run_id", "pos", "i.tweet_id", "i.stimulus", "i.imitation")
    ev = block("evaluations", 3).select("user_id", F.explode("j.evaluations").alias("e"))
    evaluations = ev.select("user_id", "e.run_id", F.col("e.timestamp").alias("ts"),
                            F.col("e.evaluation_results.overall").withField(
                                "bleu", bleu_layout(F.col("e.evaluation_results.overall.bleu"))).alias("overall"),
                            "e.evaluation_results.statistics")
    items = ev.select("user_id", "e.run_id", F.explode("e.evaluation_results.individual_scores").alias("s")) \
        .select("user_id", "run_id", "s.*").withColumn("bleu", bleu_layout(F.col("bleu")))
    rf = block("reflections", 4).select("user_id", F.explode("j.reflections").alias("r"))
    reflections = rf.select("user_id", "r.run_id", "r.iteration",
                            "r.reflection_results.reflection_on_results", "r.reflection_results.improved_persona")
    return {"posts": posts, "runs": runs, "imitations": imitations, "evaluations": evaluations,
            "item_scores": items, "reflections": reflections}


def read_user_files(spark: SparkSession, path: str, key_based: bool = True) -> dict[str, DataFrame]:
    return normalise_user_files(user_lines(spark, path), key_based)


def history(posts: DataFrame, user_id: str | None = None) -> DataFrame:
    """The history posts, of one user or all."""
    h = posts.where(F.col("set") == "history")
    return h if user_id is None else h.where(F.col("user_id") == user_id)


def holdout(posts: DataFrame) -> DataFrame:
    """The holdout posts of all users."""
    return posts.where(F.col("set") == "holdout")


def predictions(imitations: DataFrame, run_id: str) -> DataFrame:
    """The predictions of a run; those of all entries with its id."""
    return imitations.where(F.col("run_id") == run_id)


def user_file_lines(posts: DataFrame) -> DataFrame:
    """S10, content: one JSON line per (user_id, set) of ``posts(user_id, set, pos, ...)`` with the
    set's tweets in order.  A set is as large as the split made it."""
    tweet = F.struct("pos", "tweet_id", "full_text", "screen_name", "created_at", "reply_to_id", "retweeted_user_id")
    sets = posts.groupBy("user_id", "set").agg(F.sort_array(F.collect_list(tweet)).alias("tw"))
    tweets = F.transform("tw", lambda t: t.dropFields("pos", "retweeted_user_id").withField("retweeted_user_ID", t["retweeted_user_id"]))
    return sets.select(F.to_json(F.struct("user_id", "set", tweets.alias("tweets"))).alias("value"))


def read_aggregate_csv(spark: SparkSession, path: str, tag: str | None = None) -> DataFrame:
    """CSV with two header rows (metric; statistic) and a third naming the
    index -> long ``(tag, <index>, metric, statistic, value)`` rows.

    Only the three header lines are read on the driver to learn the column
    layout; the data rows stay distributed and are unpivoted by ``stack``.
    """
    df = spark.read.option("header", False).csv(path)
    head = df.limit(3).collect()
    metrics, stats, index_name = list(head[0]), list(head[1]), head[2][0] or "index"
    data = df.where(~F.col("_c0").isin(*[h[0] for h in head if h[0] is not None]) & F.col("_c0").isNotNull())
    pairs = [(i, metrics[i], stats[i]) for i in range(1, len(metrics))]
    stack = F.expr("stack({}, {})".format(len(pairs), ", ".join(
        f"'{m}', '{s}', _c{i}" for i, m, s in pairs))).alias("metric", "statistic", "raw")
    long = data.select(F.col("_c0").alias(index_name), stack)
    out = long.select(index_name, "metric", "statistic", F.col("raw").try_cast("double").alias("value"))
    return out.withColumn("experiment", F.lit(tag)) if tag is not None else out


def write_user_files(posts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON line per (user, set) with the set's tweets in order,
    partitioned by user.  Sets are bounded by the split size."""
    rows = posts.groupBy("user_id", "set").agg(F.sort_array(F.collect_list(F.struct(
        "pos", "tweet_id", "full_text", "screen_name", "created_at", "reply_to_id", "previous_message",
        "masked_text"))).alias("tw"))
    rows = rows.select("user_id", "set", F.transform("tw", lambda t: t.dropFields("pos")).alias("tweets"))
    rows.write.mode(mode).partitionBy("user_id").json(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines export."""
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV export with a header (nested columns as JSON text)."""
    cols = []
    for f in df.schema.fields:
        simple = f.dataType.typeName() not in ("struct", "array", "map")
        cols.append(F.col(f"`{f.name}`") if simple else F.to_json(F.col(f"`{f.name}`")).alias(f.name))
    df.select(*cols).write.mode(mode).option("header", True).csv(path)


def templates_from_json(path: str) -> dict[str, str]:
    """Load a prompt-template catalogue (``{name: text}``; small config file)."""
    with open(path, encoding="utf-8") as fh:
        cat = json.load(fh)
    if not isinstance(cat, dict) or not all(isinstance(v, str) for v in cat.values()):
        raise ValueError("template catalogue must map names to strings")
    return cat


def union_tagged(frames: Sequence[tuple[str, DataFrame]], col: str = "experiment") -> DataFrame:
    """Union frames by name, tagging each with its label."""
    out = None
    for tag, df in frames:
        d = df.withColumn(col, F.lit(tag))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out
