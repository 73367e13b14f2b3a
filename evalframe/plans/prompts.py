"""Registered queries: prompt tables and the inference hook."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions.text import HIGH_PRIORITY_LEXICON, URL_ONLY_PATTERN
from evalframe.operators import clean as C
from evalframe.operators import mask as M
from evalframe.operators import prompts as P
from evalframe.operators import scoring as S
from evalframe.plans import analysis as AN
from evalframe.plans import cleaning as CL
from evalframe.plans import scoring as SP
from evalframe.plans.common import Registry
from evalframe.sources import adapters as A

reg = Registry()

RUN_PREFIX = "baseline"
RUN_TIMESTAMP = "20240101_120000"


def split_rows(spark, sf_dir):
    """Split sets with the post columns and the parent message."""
    cleaned = C.parent_messages(CL.conv_cleaned(spark, sf_dir))
    sp = CL.conv_split(spark, sf_dir).select("user_id", "set", "pos", "tweet_id")
    return sp.join(cleaned.drop("user_id"), "tweet_id")


def history(spark, sf_dir):
    return P.history_text(split_rows(spark, sf_dir).where(F.col("set") == "history"))


_SPLIT_ROWS = CL._SPLIT + """,
pm AS (SELECT c.*, CASE WHEN p.tweet_id IS NOT NULL THEN coalesce(p.created_at, '') || ', ' || coalesce(p.screen_name, '')
    || ': ' || coalesce(p.full_text, '') END AS previous_message
  FROM cleaned c LEFT JOIN cleaned p ON c.reply_to_id = p.tweet_id),
sr AS (SELECT s.user_id, s."set", s.pos, s.tweet_id, pm.full_text, pm.reply_to_id, pm.screen_name, pm.previous_message
  FROM split s JOIN pm ON s.tweet_id = pm.tweet_id),
hn AS (SELECT user_id, arg_min(screen_name, pos) AS name FROM sr WHERE "set" = 'history' GROUP BY user_id),
hist AS (SELECT sr.user_id, 'User ID: ' || sr.user_id || ', Screen Name: ' || coalesce(hn.name, 'Unknown') || ' ' || chr(10)
    || 'Posts from User' || chr(10) || '-'
    || coalesce(string_agg(coalesce(full_text, 'None'), chr(10) || ' - ' ORDER BY pos) FILTER (WHERE reply_to_id IS NULL), '')
    || chr(10) || chr(10) || 'Replies from User: ' || chr(10) || ' -'
    || coalesce(string_agg('Previous message: ' || previous_message || ' ' || chr(10) || ' ' || hn.name || ' replied:'
         || coalesce(full_text, 'None') || ' ' || chr(10), chr(10) || ' -' ORDER BY pos)
         FILTER (WHERE reply_to_id IS NOT NULL AND previous_message IS NOT NULL), '') AS history
  FROM sr JOIN hn ON sr.user_id = hn.user_id WHERE sr."set" = 'history' GROUP BY sr.user_id, hn.name)"""


@reg.add("history_prompt", _SPLIT_ROWS + "\nSELECT user_id, history FROM hist")
def history_prompt(spark, sf_dir):
    """G1: the history text of every user with valid sets."""
    return history(spark, sf_dir)


_HP = "[" + ", ".join(f"'{w}'" for w in HIGH_PRIORITY_LEXICON) + "]"
_TOK = "regexp_extract_all(coalesce({t}, ''), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')"


def _dyn_mask_sql(text: str) -> str:
    return (f"CASE WHEN coalesce({text} = '', true) OR coalesce(regexp_matches({text}, '{URL_ONLY_PATTERN}'), false) "
            f"THEN '[MASKED]' ELSE array_to_string(list_transform({_TOK.format(t=text)}, lambda t: CASE WHEN "
            f"list_contains({_HP}, lower(t)) THEN '[MASKED]' ELSE t END), ' ') END")


def stimuli(spark, sf_dir):
    hold = split_rows(spark, sf_dir).where(F.col("set") == "holdout")
    hold = M.attach_lexicon(hold, M.lexicon_table(spark))
    is_post = F.col("reply_to_id").isNull() & F.col("previous_message").isNull()
    return hold.select("user_id", "tweet_id", "pos", is_post.alias("is_post"), P.stimulus_text(
        is_post, F.lit(None).cast("string"), M.deterministic_mask(F.col("full_text")),
        F.col("previous_message")).alias("stimulus"))


_STIM = _SPLIT_ROWS + f""",
stim AS (SELECT user_id, tweet_id, pos, reply_to_id IS NULL AND previous_message IS NULL AS is_post,
    CASE WHEN reply_to_id IS NULL AND previous_message IS NULL
         THEN 'Post: ' || CASE WHEN length({_dyn_mask_sql('full_text')}) > 0 THEN {_dyn_mask_sql('full_text')}
                               ELSE '{P.UNPROCESSABLE_POST}' END
         ELSE 'Previous message: ' || coalesce(previous_message, 'None') END AS stimulus
  FROM sr WHERE "set" = 'holdout')"""


@reg.add("stimuli", _STIM + "\nSELECT user_id, tweet_id, pos, is_post, stimulus FROM stim")
def q_stimuli(spark, sf_dir):
    """Stimulus text per holdout post (stored mask, else dynamic mask)."""
    return stimuli(spark, sf_dir).select("user_id", "tweet_id", F.col("pos").cast("bigint").alias("pos"),
                                         "is_post", "stimulus")


def _fill_sql(name: str, **fields: str) -> str:
    t = P.select_template(name)
    parts = P._FIELD.split(t)
    out = []
    for i, p in enumerate(parts):
        if i % 2 == 0:
            if p:
                out.append("'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
        else:
            out.append(f"coalesce(CAST({fields[p]} AS VARCHAR), 'None')")
    return " || ".join(out)


def _prompt_sql() -> str:
    arms = []
    for cond, (pt, rt) in P.CONDITION_TEMPLATES.items():
        pf = {"tweet": "stimulus"}
        rf = {"tweet": "stimulus"}
        if "persona" in P.template_fields(P.TEMPLATES[pt]):
            pf["persona"] = "persona"
        if "persona" in P.template_fields(P.TEMPLATES[rt]):
            rf["persona"] = "persona"
        arms.append(f"WHEN condition = '{cond}' THEN CASE WHEN is_post THEN {_fill_sql(pt, **pf)} "
                    f"ELSE {_fill_sql(rt, **rf)} END")
    return "CASE " + " ".join(arms) + " END"


_BEST = AN._latest_sql("user_id, round")
_PERSONA_HEAD = P.HISTORY_PERSONA_HEAD.replace("\n", "' || chr(10) || '")
_PERSONA_TAIL = P.HISTORY_PERSONA_TAIL.replace("\n", "' || chr(10) || '").replace("'s", "''s")


@reg.add("imitation_prompts", _STIM + f""",
{AN._REFL.split('WITH ', 1)[1].replace('results AS (', 'results AS (', 1)},
{AN._PER_ROUND},
lp AS ({_BEST}),
bp AS (SELECT br.user_id, lp.persona FROM br JOIN lp ON br.user_id = lp.user_id AND br.best_round = lp.round),
per AS (SELECT h.user_id, c.condition,
    CASE c.condition WHEN 'no_persona' THEN NULL WHEN 'generic' THEN '{P.GENERIC_PERSONA}'
      WHEN 'history_only' THEN CASE WHEN length(h.history) >= {P.MIN_HISTORY_CHARS}
        THEN '{_PERSONA_HEAD}' || h.history || '{_PERSONA_TAIL}' END
      ELSE bp.persona END AS persona
  FROM hist h LEFT JOIN bp ON h.user_id = bp.user_id,
    (VALUES ('no_persona'), ('generic'), ('history_only'), ('best_persona')) c(condition)),
okp AS (SELECT user_id FROM per GROUP BY user_id
  HAVING count_if(persona IS NOT NULL OR condition = 'no_persona') = 4),
smp AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('42|stimuli|' || tweet_id), tweet_id) AS stimulus_rank
  FROM stim),
smpk AS (SELECT * FROM smp WHERE stimulus_rank <= {CL.STIMULI_K} AND user_id IN (
  SELECT user_id FROM smp GROUP BY user_id HAVING count_if(stimulus_rank <= {CL.STIMULI_K}) = {CL.STIMULI_K})),
x AS (SELECT per.condition, smpk.user_id, smpk.tweet_id, smpk.is_post, smpk.stimulus, per.persona
  FROM smpk JOIN per ON smpk.user_id = per.user_id WHERE smpk.user_id IN (SELECT user_id FROM okp))
SELECT condition, user_id, tweet_id, '{RUN_PREFIX}_' || condition || '_{RUN_TIMESTAMP}' AS run_id,
  coalesce(persona, '[' || upper(condition) || ']') AS stored_persona, {_prompt_sql()} AS prompt
FROM x""")
def imitation_prompts(spark, sf_dir):
    """Identical stimuli for every condition, condition
    personas, prompts by task type; users lacking any persona or k stimuli
    are left out."""
    st = stimuli(spark, sf_dir)
    sample = C.sample_stimuli(st, CL.STIMULI_K)
    best = AN.best_persona(spark, sf_dir).select("user_id", "persona")
    per = P.condition_personas(history(spark, sf_dir), best)
    ok = per.groupBy("user_id").agg(F.count_if(F.col("ok")).alias("_n")).where(F.col("_n") == 4).select("user_id")
    x = sample.join(per, "user_id").join(ok, "user_id", "left_semi")
    cond = F.col("condition")
    return x.select(cond, "user_id", "tweet_id", P.baseline_run_id(RUN_PREFIX, cond, RUN_TIMESTAMP).alias("run_id"),
                    P.persona_marker(F.col("persona"), cond).alias("stored_persona"),
                    P.imitation_prompt(cond, F.col("is_post"), F.col("persona"), F.col("stimulus")).alias("prompt"))


_JUDGE = A.with_sql(A.PAIRS_SQL) + f""", jp AS (SELECT "index", {_fill_sql('llm_evaluation_template',
                                                                        reference='reference',
                                                                        prediction='prediction')} AS prompt FROM pairs)
"""


def judge_prompts(spark, sf_dir):
    p = A.pairs_from_conversations(spark, sf_dir)
    return p.select("index", P.fill_named("llm_evaluation_template", reference=F.col("reference"),
                                          prediction=F.col("prediction")).alias("prompt"))


@reg.add("judge_prompt", _JUDGE + "SELECT \"index\", prompt FROM jp")
def judge_prompt(spark, sf_dir):
    """Judge prompt per prediction/reference pair."""
    return judge_prompts(spark, sf_dir)


def prompt_length(prompts):
    """Deterministic stand-in for a model: replies with the prompt's length."""
    return prompts.str.len().astype(str)


@reg.add("infer_text", _JUDGE + "SELECT \"index\", CAST(length(prompt) AS VARCHAR) AS response FROM jp")
def infer_text(spark, sf_dir):
    """The inference hook over the judge prompts (Arrow batches)."""
    return P.infer_text(judge_prompts(spark, sf_dir), "prompt", prompt_length).select("index", "response")


_REFLECT_SQL = (SP._SCL + ",\n" + _SPLIT_ROWS.split("WITH ", 1)[1] + f""",
rkk AS (SELECT *, row_number() OVER (PARTITION BY user_id, run_id ORDER BY combined_score DESC, "index" ASC) AS rd,
    row_number() OVER (PARTITION BY user_id, run_id ORDER BY combined_score ASC, "index" DESC) AS ra,
    count(*) OVER (PARTITION BY user_id, run_id) AS n FROM cmb),
kk AS (SELECT *, CASE WHEN n >= 6 THEN 3 WHEN n <= 1 THEN n ELSE n // 2 END AS kb,
    CASE WHEN n >= 6 THEN 3 WHEN n <= 1 THEN 0 ELSE n // 2 END AS kw FROM rkk),
bwl AS (SELECT user_id, run_id, 'best' AS list, rd AS rank, prediction, reference FROM kk WHERE rd <= 3 AND rd <= kb
  UNION ALL SELECT user_id, run_id, 'worst', kw - ra + 1, prediction, reference FROM kk WHERE ra <= 3 AND ra <= kw),
lists AS (SELECT user_id, run_id,
    coalesce(string_agg(prediction, chr(10) ORDER BY rank) FILTER (WHERE list = 'best'), '') AS best_preds,
    coalesce(string_agg(reference, chr(10) ORDER BY rank) FILTER (WHERE list = 'best'), '') AS best_originals,
    coalesce(string_agg(prediction, chr(10) ORDER BY rank) FILTER (WHERE list = 'worst'), '') AS worst_preds,
    coalesce(string_agg(reference, chr(10) ORDER BY rank) FILTER (WHERE list = 'worst'), '') AS worst_originals
  FROM bwl GROUP BY user_id, run_id),
oagg AS (SELECT user_id, run_id, avg(rouge1) AS r1, avg(rougeL) AS rl_, sum(bm1) AS m1, sum(bm2) AS m2, sum(bm3) AS m3,
    sum(bm4) AS m4, sum(bp1) AS q1, sum(bp2) AS q2, sum(bp3) AS q3, sum(bp4) AS q4, sum(tl) AS tl, sum(rl) AS rl
  FROM cmb GROUP BY user_id, run_id),
opr AS (SELECT *, CASE WHEN q1 > 0 THEN CAST(m1 AS DOUBLE) / q1 ELSE 0.0 END AS p1,
    CASE WHEN q2 > 0 THEN CAST(m2 AS DOUBLE) / q2 ELSE 0.0 END AS p2,
    CASE WHEN q3 > 0 THEN CAST(m3 AS DOUBLE) / q3 ELSE 0.0 END AS p3,
    CASE WHEN q4 > 0 THEN CAST(m4 AS DOUBLE) / q4 ELSE 0.0 END AS p4, CAST(tl AS DOUBLE) / rl AS ratio FROM oagg),
ms AS (SELECT user_id, run_id, concat_ws(chr(10),
    'bleu: ' || printf('%.4f', CASE WHEN tl > 0 AND rl > 0 THEN (CASE WHEN least(p1, p2, p3, p4) > 0
      THEN exp(0.25 * ln(p1) + 0.25 * ln(p2) + 0.25 * ln(p3) + 0.25 * ln(p4)) ELSE 0.0 END)
      * (CASE WHEN ratio > 1.0 THEN 1.0 ELSE exp(1 - 1 / ratio) END) END),
    'rouge1: ' || printf('%.4f', r1), 'rougeL: ' || printf('%.4f', rl_)) AS metric_scores FROM opr),
hp AS (SELECT user_id, '{_PERSONA_HEAD}' || history || '{_PERSONA_TAIL}' AS persona FROM hist)
SELECT l.user_id, l.run_id, {{prompt}} AS prompt
FROM lists l JOIN ms ON l.user_id = ms.user_id AND l.run_id = ms.run_id LEFT JOIN hp ON l.user_id = hp.user_id
""").replace("{prompt}", _fill_sql("reflect_results_template", persona="hp.persona", best_preds="l.best_preds",
                                   best_originals="l.best_originals", worst_preds="l.worst_preds",
                                   worst_originals="l.worst_originals", metric_scores="ms.metric_scores"))


@reg.add("reflection_prompt", _REFLECT_SQL)
def reflection_prompt(spark, sf_dir):
    """G7 + J13: run persona, best / worst predictions with their originals and
    the metric lines of the run, per evaluated run."""
    pairs = A.pairs_from_conversations(spark, sf_dir)
    sc = S.combined_score(S.score_pairs(pairs, wide=("prediction", "reference")))
    bw = S.best_worst(sc, carry=("prediction", "reference"))
    lists = bw.groupBy("user_id", "run_id").agg(F.sort_array(F.collect_list(F.struct("list", "rank", "prediction",
                                                                                      "reference"))).alias("_l"))

    def joined(kind, field):
        return F.array_join(F.transform(F.filter("_l", lambda x: x["list"] == kind), lambda x: x[field]), "\n")

    overall = S.bleu_corpus(sc, extra_aggs=[F.avg("rouge1").alias("rouge1"), F.avg("rougeL").alias("rougeL")])
    metrics = F.map_from_arrays(F.array(F.lit("bleu"), F.lit("rouge1"), F.lit("rougeL")),
                                F.array(*[F.format_number(F.col(c), 4) for c in ("bleu", "rouge1", "rougeL")]))
    lines = F.array_join(F.transform(F.map_entries(metrics), lambda e: F.concat(e["key"], F.lit(": "), e["value"])),
                         "\n")
    hist = history(spark, sf_dir).select("user_id", F.concat(F.lit(P.HISTORY_PERSONA_HEAD), F.col("history"),
                                                             F.lit(P.HISTORY_PERSONA_TAIL)).alias("persona"))
    j = lists.join(overall.select("user_id", "run_id", lines.alias("metric_scores")), ["user_id", "run_id"]) \
        .join(hist, "user_id", "left")
    prompt = P.fill_named("reflect_results_template", persona=F.col("persona"),
                          best_preds=joined("best", "prediction"), best_originals=joined("best", "reference"),
                          worst_preds=joined("worst", "prediction"), worst_originals=joined("worst", "reference"),
                          metric_scores=F.col("metric_scores"))
    return j.select("user_id", "run_id", prompt.alias("prompt"))
