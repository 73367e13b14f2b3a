"""Opinion-word masking and the batch-masking work list.

The lexicon is a table argument (one word per row, bounded size); it is
turned into a one-row map and broadcast, so masking itself is a per-row
native expression with no shuffle of the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.functions.text import HIGH_PRIORITY_LEXICON, MASK_TOKEN, URL_ONLY_PATTERN
from evalframe.operators.skew import lookup_join, null_safe_join, ranked

# Word / punctuation tokeniser (Unicode letters, digits and underscore form words).
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
WORD_PATTERN = r"^[\p{L}\p{N}_]+$"
# Texts of users with fewer items than this are masked by rules only.
MIN_TEXTS_FOR_BATCH = 10
# Batch request settings, fixed values.
BATCH_MODEL = "gpt-4o-mini"
BATCH_URL = "/v1/chat/completions"
BATCH_TEMPERATURE = 0.1
BATCH_MAX_TOKENS = 1000
BATCH_SIZE = 1000
MASK_SYSTEM_PROMPT = (
    "You are a text masking expert. Your task is to identify ALL opinion-bearing, subjective, or emotionally "
    "charged words in the given text that should be masked to remove bias or sentiment.\n\nInstructions:\n"
    "- Identify adjectives, adverbs, verbs, and nouns that express opinions, emotions, judgments, or subjective "
    "viewpoints\n- Focus on words that could influence the reader's perception or contain bias\n"
    "- Include both positive and negative sentiment words\n"
    "- Respond ONLY with the original text where opinion-bearing words are replaced with [MASKED]\n"
    "- Preserve the exact structure and spacing of the original text\n"
    "- If no opinion-bearing words are found, return the original text unchanged")
MASK_USER_PREFIX = "Mask all opinion-bearing words in this text:\n\n"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN), 0)


def lexicon_table(spark, words: Sequence[str] = tuple(HIGH_PRIORITY_LEXICON)) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word string")


def lexicon_pattern(lexicon: DataFrame, word_col: str = "word") -> DataFrame:
    """One row holding the lexicon as a single case-insensitive regex that
    matches a whole space-delimited token.

    Words are grouped under their first character (a one-level trie):
    `` (?:\\Qa\\E(?:\\Qbc\\E|\\Qde\\E)|\\Qb\\E(?:...))(?= )``, so each token
    position tries one branch instead of every word.  Built on the
    executors from the (bounded) lexicon table; Spark compiles it once per
    task.  A Spark map lookup would scan every key per token.
    """
    w = lexicon.select(F.lower(F.col(word_col)).alias("w")).where(F.length("w") > 0).distinct()
    quoted = lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))
    groups = w.groupBy(F.substring("w", 1, 1).alias("c")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.expr("substr(w, 2)"))), quoted), "|")
        .alias("rest"))
    branch = F.concat(quoted(F.col("c")), F.lit("(?:"), F.col("rest"), F.lit(")"))
    alt = F.array_join(F.sort_array(F.collect_list(branch)), "|")
    pat = F.when(F.count(F.lit(1)) > 0, F.concat(F.lit("(?iu) (?:"), alt, F.lit(")(?= )"))).otherwise(F.lit("(?!)"))
    return groups.agg(pat.alias("_lexre"))


def attach_lexicon(df: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Attach the lexicon pattern as a scalar subquery (evaluated once, no join)."""
    return df.withColumn("_lexre", lexicon_pattern(lexicon).scalar())


def _is_blank(text: Column) -> Column:
    """``not text``: null or the empty string."""
    return F.coalesce(text == "", F.lit(True))


def rule_masked_tokens(toks: Column, lexre: Column | None = None) -> Column:
    """Tokens joined by one space with every lexicon token replaced by [MASKED]."""
    lexre = F.col("_lexre") if lexre is None else lexre
    joined = F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))
    return F.trim(F.regexp_replace(joined, lexre, F.lit(" " + MASK_TOKEN)))  # no token holds a space


def deterministic_mask(text: Column, lexre: Column | None = None) -> Column:
    """K1: lexicon tokens -> [MASKED] (case-insensitive), tokens joined by one
    space; empty or URL-only text -> [MASKED]."""
    url_only = F.coalesce(text.rlike(URL_ONLY_PATTERN), F.lit(False))
    return F.when(_is_blank(text) | url_only, F.lit(MASK_TOKEN)).otherwise(rule_masked_tokens(tokens(text), lexre))


def union_mask(text: Column, model_text: Column, lexre: Column | None = None) -> Column:
    """K2 + K3: rule positions union the positions a model masked (model
    ignored when its whitespace token count differs); if nothing is masked,
    the last word-like token (else the last token) is masked.

    Arrays are combined element-wise with ``zip_with`` (never indexed from
    inside a lambda), so each row costs O(tokens).  The tokens, the hits and the
    failsafe position are bound to names, so each is worked out once a row.
    """
    arrays = _bound(tokens(text), lambda toks: F.struct(
        toks.alias("toks"), F.split(rule_masked_tokens(toks, lexre), " ").alias("rule"),
        F.filter(F.split(F.coalesce(model_text, F.lit("")), r"\s+"), lambda w: w != "").alias("model")))

    def hits(x: Column) -> Column:
        by_rule = F.transform(x["rule"], lambda r: r == MASK_TOKEN)
        by_both = F.zip_with(by_rule, F.zip_with(x["toks"], x["model"], lambda t, m: (m == MASK_TOKEN) & (t != MASK_TOKEN)),
                             lambda r, b: r | b)
        return F.when(F.size(x["model"]) == F.size(x["toks"]), by_both).otherwise(by_rule)

    def failsafe(toks: Column) -> Column:
        # last word-like token, else the last token (0-based)
        words = F.transform(toks, lambda t, i: F.when(t.rlike(WORD_PATTERN), i).otherwise(-1))
        at = _bound(F.array_max(words), lambda word: F.when(word >= 0, word).otherwise(F.size(toks) - 1))
        # the mask is spliced in with slices (``last`` never enters a lambda over tokens)
        return _bound(at, lambda last: F.concat(F.slice(toks, 1, F.greatest(last, F.lit(0))), F.array(F.lit(MASK_TOKEN)),
                                                F.slice(toks, last + 2, F.greatest(F.size(toks), F.lit(1)))))

    def masked(x: Column) -> Column:
        return F.when(F.size(x["toks"]) == 0, x["toks"]).otherwise(_bound(hits(x), lambda hit: F.when(
            F.array_contains(hit, True),
            F.zip_with(x["toks"], hit, lambda t, h: F.when(h, F.lit(MASK_TOKEN)).otherwise(t))).otherwise(failsafe(x["toks"]))))

    url_only = F.coalesce(text.rlike(URL_ONLY_PATTERN), F.lit(False))
    return F.when(_is_blank(text) | url_only, F.lit(MASK_TOKEN)).otherwise(F.array_join(_bound(arrays, masked), " "))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def sequential_index(df: DataFrame, partition: Sequence[str], order_col: str,
                     bucket: int = 1_000_000, null_buckets: int = 1024) -> DataFrame:
    """0-based position of each row within its partition, ordered by a
    numeric ``order_col`` -- without sorting a whole partition in one task.

    Rows are cut into ranges of ``order_col // bucket``; a small aggregate
    counts rows per range, a window over those counts gives each range its
    offset, and a window inside one range (at most ``bucket`` rows) adds the
    local rank.  Exact, and a hot partition is spread over its ranges.

    Every row gets a position: null partition values are a partition of their
    own, and rows without ``order_col`` come last, dealt over ``null_buckets``
    and ordered by the hash of the whole row, as are rows with equal values.
    """
    p, cut = list(partition), ["_b", "_s"]
    whole = F.xxhash64(*df.columns)
    b = df.withColumn("_h", whole).withColumn("_b", F.floor(F.col(order_col) / bucket)).withColumn(
        "_s", F.when(F.col(order_col).isNull(), F.pmod("_h", F.lit(null_buckets))).otherwise(F.lit(0)))
    counts = b.groupBy(*p, *cut).agg(F.count(F.lit(1)).alias("_n"))
    off = counts.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.partitionBy(*p).orderBy(F.col("_b").asc_nulls_last(), "_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.row_number().over(Window.partitionBy(*p, *cut).orderBy(F.col(order_col).asc_nulls_last(), "_h")) - 1
    return null_safe_join(b.withColumn("_l", local), off.drop("_n"), p + cut) \
        .withColumn("position", F.col("_off") + F.col("_l")).drop("_l", "_off", "_h", *cut)


def work_list(posts: DataFrame, user: str = "user_id", min_texts: int = MIN_TEXTS_FOR_BATCH,
              batch_size: int = BATCH_SIZE, tokens_per_text: int = 100,
              price_per_1k: float = 0.00015) -> DataFrame:
    """A36 + A37: per user processed / unprocessed texts, the rules-only flag,
    and the batch plan (number of batches, estimated cost)."""
    todo = F.col("masked_text").isNull()
    g = posts.groupBy(user).agg(F.count(F.lit(1)).alias("texts"), F.count_if(~todo).alias("processed"),
                                F.count_if(todo).alias("unprocessed"))
    return g.select(user, "texts", "processed", "unprocessed",
                    (F.col("unprocessed") < min_texts).alias("rules_only"),
                    F.ceil(F.col("unprocessed") / batch_size).alias("batches"),
                    (F.col("unprocessed") * tokens_per_text / 1000.0 * price_per_1k).alias("estimated_cost"))


def route_texts(posts: DataFrame, user: str = "user_id", min_texts: int = MIN_TEXTS_FOR_BATCH) -> DataFrame:
    """K4: ``posts`` still to mask with their user's number of such texts and the route: users with
    fewer than ``min_texts`` are masked by the rules alone.  Users are counted before the shuffle and
    looked up, a user with very many posts is spread; posts without a user are one user's."""
    todo = posts.where(F.col("masked_text").isNull())
    keyed = todo.withColumns({"_k": F.coalesce(user, F.lit("")), "_null": F.col(user).isNull()})
    sizes = keyed.groupBy("_k", "_null").agg(F.count(F.lit(1)).alias("todo_texts"))
    routed = lookup_join(keyed, sizes, ["_k", "_null"])
    return routed.withColumn("route", F.when(F.col("todo_texts") < min_texts, F.lit("rules")).otherwise(F.lit("batch"))) \
        .select(*posts.columns, "todo_texts", "route")


def mask_in_order(texts: DataFrame, order: Sequence[str], text: str, lexicon: DataFrame) -> DataFrame:
    """K5: the rule mask of a list of texts in input order: 0-based position by ``order`` and the mask."""
    placed = ranked(texts.select(*order, text).withColumn("_all", F.lit(0)), ["_all"], list(order))
    return attach_lexicon(placed, lexicon).select((F.col("rank") - 1).alias("position"),
                                                  deterministic_mask(F.col(text)).alias("masked_text"))


def batch_requests(posts: DataFrame, prefix: str = "mask", user: str = "user_id",
                   order_col: str = "ingest_pos", batch_size: int = BATCH_SIZE,
                   carry: Sequence[str] = ()) -> DataFrame:
    """S17 + W9: one chat request per text still to mask; skipped texts
    (empty / URL-only) keep their position; custom id ``prefix-i`` and batch
    number ``i // batch_size``."""
    idx = sequential_index(posts, [user], order_col)
    text = F.col("full_text")
    keep = ~_is_blank(text) & ~F.coalesce(text.rlike(URL_ONLY_PATTERN), F.lit(False))
    body = F.struct(
        F.lit(BATCH_MODEL).alias("model"),
        F.array(F.struct(F.lit("system").alias("role"), F.lit(MASK_SYSTEM_PROMPT).alias("content")),
                F.struct(F.lit("user").alias("role"), F.concat(F.lit(MASK_USER_PREFIX), text).alias("content")))
        .alias("messages"),
        F.lit(BATCH_TEMPERATURE).alias("temperature"), F.lit(BATCH_MAX_TOKENS).alias("max_tokens"))
    cid = F.concat(F.lit(prefix + "-"), F.col("position").cast("string"))
    req = F.to_json(F.struct(cid.alias("custom_id"), F.lit("POST").alias("method"), F.lit(BATCH_URL).alias("url"),
                             body.alias("body")))
    return idx.where(keep).select(user, "tweet_id", "position", cid.alias("custom_id"),
                                  F.floor(F.col("position") / batch_size).alias("batch"), req.alias("request"),
                                  *carry)


RESULT_SCHEMA = ("custom_id string, response struct<status_code:int, body:struct<choices:array<struct<"
                 "message:struct<content:string>>>, error:struct<message:string>>>")


def parse_batch_results(lines: DataFrame, line_col: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Status 200 -> trimmed content, any other outcome -> [MASKED]."""
    r = F.from_json(F.col(line_col), RESULT_SCHEMA)
    content = F.get(r["response"]["body"]["choices"], F.lit(0))["message"]["content"]
    ok = F.coalesce(r["response"]["status_code"] == 200, F.lit(False))
    return lines.select(*keep, r["custom_id"].alias("custom_id"),
                        F.when(ok, F.regexp_replace(content, r"^\s+|\s+$", "")).otherwise(F.lit(MASK_TOKEN))
                        .alias("masked_text"), ok.alias("ok"))
