"""The template catalogue and the text of a stimulus."""

import pytest
from pyspark.sql import functions as F

from evalframe.operators import prompts as P

FIELDS = {
    "persona_template_simple": {"historie"}, "mask_opinion_template": {"text"},
    "imitation_post_template_simple": {"persona", "tweet"}, "imitation_replies_template_simple": {"persona", "tweet"},
    "imitation_post_template_no_persona": {"tweet"}, "imitation_replies_template_no_persona": {"tweet"},
    "imitation_post_template_generic": {"tweet"}, "imitation_replies_template_generic": {"tweet"},
    "reflect_results_template": {"persona", "best_preds", "best_originals", "worst_preds", "worst_originals", "metric_scores"},
    "llm_evaluation_template": {"reference", "prediction"},
}


def test_every_template_has_its_fields():
    assert P.TEMPLATES.keys() == FIELDS.keys()
    assert {n: set(P._FIELD.findall(P.template(n))) for n in FIELDS} == FIELDS
    with pytest.raises(ValueError, match="no_such"):
        P.template("no_such")


def test_a_stored_mask_goes_before_the_dynamic_one(spark):
    rows = [(1, True, "stored", "dynamic", "m"), (2, True, "", "dynamic", "m"), (3, True, None, "", "m"),
            (4, True, None, None, None), (5, False, "stored", "dynamic", "m"), (6, False, None, None, None)]
    df = spark.createDataFrame(rows, "k int, p boolean, stored string, dynamic string, message string")
    got = df.select("k", P.stimulus_text(F.col("p"), F.col("stored"), F.col("dynamic"), F.col("message")).alias("t")).orderBy("k")
    lost = "Post: " + P.UNPROCESSABLE_POST
    assert [r.t for r in got.collect()] == ["Post: stored", "Post: dynamic", lost, lost, "Previous message: m", "Previous message: None"]
