"""Registered queries: post metrics, task-aware metrics, metric fill / backfill,
judge parsing, similarity, perplexity, distributions, persona evolution
(M5, M7-M13, A13-A15, A43, A45, F12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.operators import quality as Q
from evalframe.operators import mask as M
from evalframe.operators import runs as R
from evalframe.operators import scoring as S
from evalframe.plans import cleaning as CL
from evalframe.plans import runs as RP
from evalframe.plans.common import Registry, rounded
from evalframe.plans.sqlgen import pair_scores_sql
from evalframe.sources import adapters as A

reg = Registry()

KDE_POINTS = 32


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _clean_sql(x: str) -> str:
    s = _strip_sql(f"coalesce({x}, '')")
    s = f"replace(replace({s}, 'Post:', ''), 'Completed Tweet:', '')"
    s = _strip_sql(s)
    return _strip_sql(f"regexp_replace({s}, '\\*\\*([^*]+)\\*\\*', '\\1', 'g')")


def _format_sql(raw: str, pc: str, ref: str) -> str:
    r = _strip_sql(f"coalesce({ref}, '')")
    rw = _strip_sql(f"coalesce({raw}, '')")
    art = " OR ".join(f"contains({rw}, '{a}')" for a in ("Post:", "Completed Tweet:", "**", "flexed!"))
    ratio = f"(CAST(length({pc}) AS DOUBLE) / greatest(length({r}), 1))"
    return (f"(CASE WHEN {art} THEN 0.5 ELSE 1.0 END) * (CASE WHEN length({r}) > 0 AND ({ratio} > 3.0 "
            f"OR {ratio} < 0.3) THEN 0.7 ELSE 1.0 END)")


# ---------------------------------------------------------------------------
# items: scored pairs + task type (lookup among the user's cleaned posts)
# + metric presence of their evaluation + lexical similarity of post items
# ---------------------------------------------------------------------------

def items(spark, sf_dir):
    pairs = A.pairs_from_conversations(spark, sf_dir)
    look = CL.conv_cleaned(spark, sf_dir).select(
        F.col("tweet_id").alias("_tid"), F.col("user_id").alias("_uid"),
        F.when(F.col("reply_to_id").isNull(), F.lit("post")).otherwise(F.lit("reply")).alias("task"))
    scored = S.score_pairs(pairs, rouge_l=False, wide=("prediction", "reference"))
    it = scored.join(look, (scored["tweet_id"] == look["_tid"]) & (scored["user_id"] == look["_uid"]), "left") \
        .drop("_tid", "_uid")
    pres = RP.presence(spark, sf_dir).drop("items")
    it = it.join(pres, ["user_id", "run_id"], "left")
    it = it.withColumn("pc", Q.clean_prediction(F.col("prediction")))
    posts = it.where(F.col("task") == "post")
    sim = Q.tf_cosine(posts, ["index"], F.col("pc"), F.col("reference"))
    it = it.join(sim, "index", "left")
    return (it.withColumn("exact", Q.exact_match(F.col("pc"), F.col("reference")))
              .withColumn("content", Q.content_accuracy(F.col("similarity")))
              .withColumn("format", Q.format_compliance(F.col("prediction"), F.col("pc"), F.col("reference")))
              .withColumn("missing", Q.missing_metrics(F.col("run_id"))))


# the presence CTEs (g, pres, ms) follow the pairs CTE already defined above
_PRES = RP._PRESENCE_SQL[RP._PRESENCE_SQL.index(", g AS ("):]
_ITEMS_SQL = ("WITH " + pair_scores_sql(A.PAIRS_SQL) + ",\n" + A.POSTS_SQL + ",\n" + CL.cleaned_sql("posts")
              + _PRES + f""",
look AS (SELECT user_id, tweet_id, CASE WHEN reply_to_id IS NULL THEN 'post' ELSE 'reply' END AS task FROM cleaned),
it AS (SELECT sc.*, look.task, pres.has_rouge, pres.has_bleu, pres.has_perplexity, pres.has_bertscore,
    {_clean_sql('sc.prediction')} AS pc
  FROM sc LEFT JOIN look ON sc.tweet_id = look.tweet_id AND sc.user_id = look.user_id
  LEFT JOIN pres ON sc.user_id = pres.user_id AND sc.run_id = pres.run_id),
ct AS (SELECT "index", regexp_extract_all(lower(pc), '[a-z0-9]+') AS a,
    regexp_extract_all(lower(coalesce(reference, '')), '[a-z0-9]+') AS b FROM it WHERE task = 'post'),
ga AS (SELECT "index", unnest(a) AS w, 1 AS side FROM ct UNION ALL SELECT "index", unnest(b) AS w, 2 AS side FROM ct),
gca AS (SELECT "index", w, count(*) FILTER (WHERE side = 1) AS cp, count(*) FILTER (WHERE side = 2) AS cr
  FROM ga GROUP BY ALL),
cs AS (SELECT "index", CAST(sum(cp * cr) AS DOUBLE) AS dot, CAST(sum(cp * cp) AS DOUBLE) AS np2,
    CAST(sum(cr * cr) AS DOUBLE) AS nr2 FROM gca GROUP BY "index"),
itm AS (SELECT it.*, CASE WHEN task = 'post' THEN coalesce(CASE WHEN sqrt(np2 * nr2) > 0 THEN dot / sqrt(np2 * nr2) END, 0.0)
    END AS similarity,
    lower(pc) = lower({_strip_sql("coalesce(reference, '')")}) AS exact,
    {_format_sql('prediction', 'pc', 'reference')} AS format,
    CASE WHEN contains(run_id, 'bleu_only') THEN ['rouge', 'bertscore', 'perplexity']
         WHEN contains(run_id, 'perplexity_only') THEN ['rouge', 'bleu', 'bertscore']
         WHEN contains(run_id, 'bertscore') THEN ['rouge', 'bleu', 'perplexity']
         WHEN contains(run_id, 'rouge_1') THEN ['bleu', 'bertscore', 'perplexity']
         ELSE CAST([] AS VARCHAR[]) END AS missing
  FROM it LEFT JOIN cs USING ("index")),
itc AS (SELECT *, CASE WHEN similarity > 0.7 THEN 1.0 WHEN similarity > 0.3 THEN similarity ELSE 0.0 END AS content
  FROM itm)
""")

_NONEMPTY = "(length(coalesce(prediction, '')) > 0 AND length(coalesce(reference, '')) > 0)"


@reg.add("post_metrics", _ITEMS_SQL + """SELECT user_id, run_id,
  round(count_if(exact) / count(*), 6) AS posts_exact_match_rate,
  round(avg(similarity), 6) AS posts_semantic_similarity, round(avg(content), 6) AS posts_content_accuracy,
  round(avg(format), 6) AS posts_format_compliance, count_if(exact) AS posts_exact_matches,
  count(*) AS posts_total_samples, round(stddev_pop(similarity), 6) AS posts_semantic_similarity_std
FROM itc WHERE task = 'post' GROUP BY user_id, run_id""")
def post_metrics(spark, sf_dir):
    it = items(spark, sf_dir).where(F.col("task") == "post")
    return rounded(Q.post_block(it, ["user_id", "run_id"]))


@reg.add("task_aware_metrics", _ITEMS_SQL + f""", agg AS (SELECT user_id, run_id,
  coalesce(TRY_CAST(regexp_extract(run_id, 'round_(\\d+)', 1) AS INTEGER), 1) AS round,
  count_if(task = 'post' AND exact) / nullif(count_if(task = 'post'), 0) AS posts_exact_match_rate,
  avg(similarity) FILTER (WHERE task = 'post') AS posts_semantic_similarity,
  avg(content) FILTER (WHERE task = 'post') AS posts_content_accuracy,
  avg(format) FILTER (WHERE task = 'post') AS posts_format_compliance,
  count_if(task = 'post' AND exact) AS posts_exact_matches, count_if(task = 'post') AS posts_total_samples,
  CASE WHEN count_if(task = 'reply' AND has_rouge) > 0 THEN avg(rouge1) FILTER (WHERE task = 'reply' AND has_rouge)
       ELSE avg(rouge1) FILTER (WHERE task = 'reply' AND list_contains(missing, 'rouge') AND {_NONEMPTY}) END
    AS replies_mean_rouge1,
  CASE WHEN count_if(task = 'reply' AND has_bleu AND bleu IS NOT NULL) > 0
       THEN avg(bleu) FILTER (WHERE task = 'reply' AND has_bleu)
       ELSE avg(bleu) FILTER (WHERE task = 'reply' AND list_contains(missing, 'bleu') AND {_NONEMPTY}) END
    AS replies_mean_bleu,
  count_if(task = 'reply') AS replies_total_samples
FROM itc GROUP BY user_id, run_id)
SELECT user_id, run_id, round, round(posts_exact_match_rate, 6) AS posts_exact_match_rate,
  round(posts_semantic_similarity, 6) AS posts_semantic_similarity,
  round(posts_content_accuracy, 6) AS posts_content_accuracy,
  round(posts_format_compliance, 6) AS posts_format_compliance, posts_exact_matches, posts_total_samples,
  round(replies_mean_rouge1, 6) AS replies_mean_rouge1, round(replies_mean_bleu, 6) AS replies_mean_bleu,
  replies_total_samples FROM agg""")
def task_aware_metrics(spark, sf_dir):
    it = items(spark, sf_dir)
    post = F.col("task") == "post"
    reply = F.col("task") == "reply"
    nonempty = (F.length(F.coalesce("prediction", F.lit(""))) > 0) & \
               (F.length(F.coalesce("reference", F.lit(""))) > 0)
    g = it.groupBy("user_id", "run_id").agg(
        (F.count_if(post & F.col("exact")) / F.nullif(F.count_if(post), F.lit(0))).alias("posts_exact_match_rate"),
        F.avg(F.when(post, F.col("similarity"))).alias("posts_semantic_similarity"),
        F.avg(F.when(post, F.col("content"))).alias("posts_content_accuracy"),
        F.avg(F.when(post, F.col("format"))).alias("posts_format_compliance"),
        F.count_if(post & F.col("exact")).alias("posts_exact_matches"),
        F.count_if(post).alias("posts_total_samples"),
        Q.list_fallback(F.col("rouge1"), reply & F.col("has_rouge"),
                        F.when(reply & F.array_contains("missing", "rouge") & nonempty, F.col("rouge1")))
        .alias("replies_mean_rouge1"),
        Q.list_fallback(F.col("bleu"), reply & F.col("has_bleu") & F.col("bleu").isNotNull(),
                        F.when(reply & F.array_contains("missing", "bleu") & nonempty, F.col("bleu")))
        .alias("replies_mean_bleu"),
        F.count_if(reply).alias("replies_total_samples"))
    g = g.withColumn("round", R.round_from_regex(F.col("run_id")))
    return rounded(g.select("user_id", "run_id", "round", "posts_exact_match_rate", "posts_semantic_similarity",
                            "posts_content_accuracy", "posts_format_compliance", "posts_exact_matches",
                            "posts_total_samples", "replies_mean_rouge1", "replies_mean_bleu",
                            "replies_total_samples"))


@reg.add("missing_metric_fill", _ITEMS_SQL + f"""SELECT user_id, run_id, "index", array_to_string(missing, ',') AS missing,
  CASE WHEN list_contains(missing, 'rouge') AND {_NONEMPTY} THEN round(rouge1, 6) END AS computed_rouge1,
  CASE WHEN list_contains(missing, 'bleu') AND {_NONEMPTY} THEN round(bleu, 6) END AS computed_bleu
FROM itc WHERE task = 'reply' AND len(missing) > 0""")
def missing_metric_fill(spark, sf_dir):
    """Metrics a limited run lacks, computed for its reply items."""
    it = items(spark, sf_dir).where((F.col("task") == "reply") & (F.size("missing") > 0))
    nonempty = (F.length(F.coalesce("prediction", F.lit(""))) > 0) & \
               (F.length(F.coalesce("reference", F.lit(""))) > 0)
    return rounded(it.select(
        "user_id", "run_id", "index", F.array_join("missing", ",").alias("missing"),
        F.when(F.array_contains("missing", "rouge") & nonempty, F.col("rouge1")).alias("computed_rouge1"),
        F.when(F.array_contains("missing", "bleu") & nonempty, F.col("bleu")).alias("computed_bleu")))


@reg.add("metric_backfill", "WITH " + pair_scores_sql(A.PAIRS_SQL) + _PRES + """,
lack AS (SELECT user_id, run_id FROM pres WHERE NOT has_bleu AND items > 0),
it AS (SELECT sc.* FROM sc JOIN lack ON sc.user_id = lack.user_id AND sc.run_id = lack.run_id),
agg AS (SELECT user_id, run_id, sum(bm1) AS m1, sum(bm2) AS m2, sum(bm3) AS m3, sum(bm4) AS m4,
    sum(bp1) AS q1, sum(bp2) AS q2, sum(bp3) AS q3, sum(bp4) AS q4,
    sum(tl) AS tl, sum(rl) AS rl FROM it GROUP BY ALL),
pr AS (SELECT *, CASE WHEN q1 > 0 THEN CAST(m1 AS DOUBLE) / q1 ELSE 0.0 END AS p1,
    CASE WHEN q2 > 0 THEN CAST(m2 AS DOUBLE) / q2 ELSE 0.0 END AS p2,
    CASE WHEN q3 > 0 THEN CAST(m3 AS DOUBLE) / q3 ELSE 0.0 END AS p3,
    CASE WHEN q4 > 0 THEN CAST(m4 AS DOUBLE) / q4 ELSE 0.0 END AS p4,
    CAST(tl AS DOUBLE) / rl AS ratio FROM agg),
ovb AS (SELECT user_id, run_id, CASE WHEN tl > 0 AND rl > 0 THEN (CASE WHEN least(p1, p2, p3, p4) > 0
     THEN exp(0.25 * ln(p1) + 0.25 * ln(p2) + 0.25 * ln(p3) + 0.25 * ln(p4)) ELSE 0.0 END)
     * (CASE WHEN ratio > 1.0 THEN 1.0 ELSE exp(1 - 1 / ratio) END) END AS overall_bleu FROM pr)
SELECT it.user_id, it.run_id, it."index", round(it.bleu, 6) AS bleu, round(ovb.overall_bleu, 6) AS overall_bleu
FROM it JOIN ovb ON it.user_id = ovb.user_id AND it.run_id = ovb.run_id""")
def metric_backfill(spark, sf_dir):
    """Evaluations that lack BLEU but have item scores get it per item and overall."""
    lack = RP.presence(spark, sf_dir).where(~F.col("has_bleu") & (F.col("items") > 0)).select("user_id", "run_id")
    pairs = A.pairs_from_conversations(spark, sf_dir).join(lack, ["user_id", "run_id"], "left_semi")
    sc = S.score_pairs(pairs, metrics=["bleu"])
    ov = S.bleu_corpus(sc).select("user_id", "run_id", F.col("bleu").alias("overall_bleu"))
    return rounded(sc.join(ov, ["user_id", "run_id"]).select("user_id", "run_id", "index", "bleu", "overall_bleu"))


@reg.add("flatten_metrics", "WITH " + pair_scores_sql(A.PAIRS_SQL) + """
SELECT user_id, run_id, round(avg(rouge1), 6) AS overall_rouge1, round(avg(rouge2), 6) AS overall_rouge2,
  round(avg(rouge1), 6) AS rouge1_mean, round(stddev_pop(rouge1), 6) AS rouge1_std,
  round(max(rouge1), 6) AS rouge1_max, round(min(rouge1), 6) AS rouge1_min,
  round(avg(bleu), 6) AS bleu_mean, round(stddev_pop(bleu), 6) AS bleu_std,
  round(max(bleu), 6) AS bleu_max, round(min(bleu), 6) AS bleu_min, count(*) AS total_samples
FROM sc GROUP BY user_id, run_id""")
def flatten_metrics(spark, sf_dir):
    """One evaluation -> overall means + per-item mean / population std / max / min."""
    sc = S.score_pairs(A.pairs_from_conversations(spark, sf_dir), rouge_l=False)
    aggs = [F.avg("rouge1").alias("overall_rouge1"), F.avg("rouge2").alias("overall_rouge2")]
    for m in ("rouge1", "bleu"):
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"),
                 F.max(m).alias(f"{m}_max"), F.min(m).alias(f"{m}_min")]
    return rounded(sc.groupBy("user_id", "run_id").agg(*aggs, F.count(F.lit(1)).alias("total_samples")))


# ---------------------------------------------------------------------------
# judge replies: assistant turns carry a structured verdict, others free text
# ---------------------------------------------------------------------------

@reg.add("judge_parse", """WITH r AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN
    'Coherence: ' || CAST(conv_id % 6 AS VARCHAR) || chr(10) || 'Consistency: ' || CAST(turn % 5 AS VARCHAR)
    || chr(10) || 'Justification: ' || text ELSE text END AS response FROM conversations)
SELECT conv_id, turn,
  coalesce(CAST(nullif(regexp_extract(response, 'Coherence: (\\d)', 1), '') AS INTEGER), 0) AS coherence_score,
  coalesce(CAST(nullif(regexp_extract(response, 'Consistency: (\\d)', 1), '') AS INTEGER), 0) AS consistency_score,
  CASE WHEN coalesce(regexp_matches(response, 'Justification: '), false)
       THEN regexp_replace(regexp_extract(response, 'Justification: (.*)', 1), '^\\s+|\\s+$', '', 'g')
       ELSE 'No justification provided.' END AS justification
FROM r""")
def judge_parse(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations")
    resp = F.when(F.col("role") == "assistant", F.concat(
        F.lit("Coherence: "), (F.col("conv_id") % 6).cast("string"), F.lit("\n"),
        F.lit("Consistency: "), (F.col("turn") % 5).cast("string"), F.lit("\n"),
        F.lit("Justification: "), F.col("text"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", *Q.judge_parse(resp))


@reg.add("semantic_similarity", """SELECT vec_id, label_a, label_b,
  round(CASE WHEN na > 0 AND nb > 0 THEN dot / sqrt(na * nb) ELSE 0.0 END, 6) AS similarity FROM (
  SELECT a.vec_id, a.label AS label_a, b.label AS label_b,
    list_sum(list_transform(range(1, len(a.embedding) + 1),
      lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE))) AS dot,
    list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS na,
    list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS nb
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) t""")
def semantic_similarity(spark, sf_dir):
    """Cosine of each embedding with the next one."""
    e = A.table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("label_b"),
                 F.col("embedding").alias("emb_b"))
    j = e.join(b, "vec_id")
    return rounded(j.select("vec_id", F.col("label").alias("label_a"), "label_b",
                            Q.cosine(F.col("embedding"), F.col("emb_b")).alias("similarity")))


@reg.add("ngram_perplexity", """WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS tk FROM documents),
vs AS (SELECT count(DISTINCT w) AS vsize FROM (SELECT unnest(tk) AS w FROM t)),
bg AS (SELECT doc_id, tk[i] AS v, tk[i] || ' ' || tk[i + 1] AS bg FROM t, LATERAL (SELECT unnest(range(1, len(tk))) AS i)),
cv AS (SELECT v, count(*) AS cv FROM bg GROUP BY v),
cvw AS (SELECT bg, count(*) AS cvw FROM bg GROUP BY bg),
per AS (SELECT doc_id, avg(ln((cvw + 1.0) / (cv + 1.0 * vsize))) AS alp, count(*) AS n FROM bg
  JOIN cvw USING (bg) JOIN cv USING (v), vs GROUP BY doc_id)
SELECT d.doc_id, round(exp(-alp), 6) AS perplexity, coalesce(n, 0) AS n_bigrams
FROM documents d LEFT JOIN per ON d.doc_id = per.doc_id""")
def ngram_perplexity(spark, sf_dir):
    """M5 re-aimed: per-document perplexity under a bigram LM of the corpus."""
    d = A.table(spark, sf_dir, "documents")
    return rounded(Q.bigram_perplexity(d, "doc_id", "text"))


@reg.add("box_stats", A.with_sql(A.RESULTS_SQL) + """, q AS (SELECT round, quantile_cont(score, 0.25) AS q1,
  quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS q3, min(score) AS mn, max(score) AS mx,
  count(score) AS count FROM results GROUP BY round)
SELECT round, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(greatest(mn, q1 - 1.5 * (q3 - q1)), 6) AS whisker_low, round(least(mx, q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
  count FROM q""")
def box_stats(spark, sf_dir):
    """Box-plot data of the score per round."""
    return rounded(Q.box_stats(A.results_from_events(spark, sf_dir), ["round"], "score"))


@reg.add("kde_grid", A.with_sql(A.RESULTS_SQL) + f""", st AS (SELECT round, count(score) AS n, stddev_samp(score) AS sd,
  min(score) AS lo, max(score) AS hi FROM results GROUP BY round),
sh AS (SELECT *, sd * power(CAST(n AS DOUBLE), -0.2) AS h FROM st),
g AS (SELECT round, i AS grid_index, lo + (hi - lo) * i / {KDE_POINTS - 1} AS x, n, h
  FROM sh, range(0, {KDE_POINTS}) r(i))
SELECT g.round, g.grid_index, round(g.x, 6) AS x,
  round(sum(exp(-0.5 * power((g.x - r.score) / g.h, 2)) / (g.n * g.h * sqrt(2 * pi()))), 6) AS density
FROM g JOIN results r ON g.round = r.round WHERE r.score IS NOT NULL GROUP BY g.round, g.grid_index, g.x""")
def kde_grid(spark, sf_dir):
    """Gaussian density of the score per round on a fixed grid."""
    k = Q.kde_grid(A.results_from_events(spark, sf_dir), ["round"], "score", KDE_POINTS)
    return rounded(k.withColumn("grid_index", F.col("grid_index").cast("bigint")))


@reg.add("persona_evolution", """WITH p AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS round,
    regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents),
s AS (SELECT source, round, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM p),
tk AS (SELECT DISTINCT source, round, unnest(t) AS tok FROM p),
it AS (SELECT a.source, a.round, count(*) AS common FROM tk a JOIN tk b
  ON a.source = b.source AND a.round = b.round + 1 AND a.tok = b.tok GROUP BY a.source, a.round)
SELECT s.source, s.round, s.n_tokens, s.n_distinct, CAST(s.n_tokens - pv.n_tokens AS DOUBLE) AS token_change,
  round(CASE WHEN pv.n_distinct IS NULL THEN NULL
    WHEN s.n_distinct + pv.n_distinct - coalesce(it.common, 0) > 0
    THEN coalesce(it.common, 0) / (s.n_distinct + pv.n_distinct - coalesce(it.common, 0)) ELSE 0.0 END, 6) AS jaccard_prev
FROM s LEFT JOIN s pv ON s.source = pv.source AND s.round = pv.round + 1
LEFT JOIN it ON s.source = it.source AND s.round = it.round""")
def persona_evolution(spark, sf_dir):
    """Persona of round r = the r-th document of a source."""
    d = A.table(spark, sf_dir, "documents").select(
        "source", "doc_id", "text")
    # the position among the documents of the source, from the ids alone and without one task per source
    order = M.sequential_index(d.select("source", "doc_id"), ["source"], "doc_id").select("doc_id", F.col("position").alias("round"))
    d = d.join(order, "doc_id")
    out = Q.persona_evolution(d, "source", "round", "text")
    return rounded(out.select("source", "round", F.col("n_tokens").cast("bigint").alias("n_tokens"),
                              F.col("n_distinct").cast("bigint").alias("n_distinct"),
                              F.col("token_change").cast("double").alias("token_change"), "jaccard_prev"))


KEYWORDS, PRIOR = 5, 500.0


@reg.add("persona_keywords", f"""WITH t AS (SELECT source, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS word FROM documents),
o AS (SELECT source, word, count(*) AS n FROM t GROUP BY ALL),
w AS (SELECT word, sum(n) AS n_word FROM o GROUP BY word), k AS (SELECT source, sum(n) AS n_key FROM o GROUP BY source),
j AS (SELECT o.source, o.word, o.n, {PRIOR} * n_word / (SELECT sum(n) FROM o) AS pr, n_word, n_key, (SELECT sum(n) FROM o) AS n_all
  FROM o JOIN w ON w.word = o.word JOIN k ON k.source IS NOT DISTINCT FROM o.source),
l AS (SELECT *, n + pr AS a, n_word - n + pr AS b FROM j),
z AS (SELECT *, ln(a / (n_key + {PRIOR} - a)) - ln(b / (n_all - n_key + {PRIOR} - b)) AS log_odds FROM l),
r AS (SELECT *, log_odds / sqrt(1 / a + 1 / b) AS z FROM z)
SELECT source, rank, word, n, round(log_odds, 6) AS log_odds, round(z, 6) AS z FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(z, 9) DESC, word) AS rank FROM r) WHERE rank <= {KEYWORDS}""")
def persona_keywords(spark, sf_dir):
    """The words that set each source apart."""
    k = Q.persona_keywords(A.table(spark, sf_dir, "documents"), "source", "text", KEYWORDS, PRIOR)
    return rounded(k.select("source", F.col("rank").cast("bigint").alias("rank"), "word", "n", "log_odds", "z"))
