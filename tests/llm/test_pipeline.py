"""The pipeline on a small corpus, each stage against brute force."""

import numpy as np
import pytest

from test_operators import brute_components, some_words

DOCS = 600
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    rng = np.random.default_rng(4)
    texts, toxic = {}, {}
    for i in range(DOCS):
        w = some_words(3000 + i, 70)
        if i % 4 == 1:
            for p in rng.integers(0, 70, 6):
                w[p] = ["scoundrel", "badword"][int(rng.integers(2))]
            toxic[i] = 1
        else:
            toxic[i] = 0
        texts[i] = " ".join(w)
    item = " ".join(some_words(9000, 40))
    run = "\n".join(" ".join(some_words(9100 + k, 15)) for k in range(5))
    texts[900] = " ".join(some_words(9001, 30)) + " " + item + " " + " ".join(some_words(9002, 20))
    texts[901] = "\n".join([" ".join(some_words(9003, 30)), run, " ".join(some_words(9004, 20))])
    texts[902] = "\n".join([" ".join(some_words(9005, 40)), run, " ".join(some_words(9006, 20))])
    texts[903] = texts[0]                                        # exact copy
    texts[904] = "changed " + " ".join(texts[2].split()[1:])     # near copy
    texts[905], texts[906] = None, ""
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, COLUMNS).repartition(2).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(sorted(toxic.items()), "doc_id long, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, texts, toxic


def test_stages(spark, corpus):
    import corpus_pipeline as cp
    from evalframe.llm.shared import shared_table
    root, texts, _ = corpus
    docs, kept = spark.read.parquet(f"{root}/documents.parquet"), {}
    columns = docs.columns
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    for name, stage in cp.STAGES:
        docs = shared_table(stage(spark, docs, root), name)
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    ids = {n: {r.doc_id for r in rows} for n, rows in kept.items()}
    is_toxic = {i for i in range(DOCS) if i % 4 == 1}
    assert len(is_toxic & ids["toxicity"]) <= 15 and len((set(texts) - is_toxic) - ids["toxicity"]) <= 45
    assert {905, 906} <= ids["packing"]
    # the later copy of the run and the exact copy are gone, the first ones stay
    after = {r.doc_id: r for r in kept["line_dedup"]}
    if {901, 902} <= set(after):
        assert after[901].text == texts[901] and after[902].text.count("\n") == 1
        assert after[902].n_chars == len(after[902].text)
    assert 903 not in after or 0 not in ids["toxicity"]
    before = [(r.doc_id, r.text) for r in kept["line_dedup"]]
    assert ids["near_duplicates"] == {i for i, (_, c) in brute_components(before).items() if i == c}
    if {2, 904} <= set(after):
        assert 904 not in ids["near_duplicates"]
    assert ids["near_duplicates"] - ids["decontamination"] == {900} & ids["near_duplicates"]
    assert ids["packing"] == ids["decontamination"]
    fill = {}
    for r in kept["packing"]:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048 and 2048 * len(fill) <= 1.15 * sum(fill.values())
    assert cp.ORACLE_SQL is None


def test_empty_corpus(spark, tmp_path):
    import corpus_pipeline as cp
    for name, schema in (("documents", COLUMNS), ("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_registered(spark):
    import __spark_entry__ as entry
    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {n[:n.index("_") + 1] for n in names if n.startswith("op")} and "pipeline" in names
    assert {"op3_ngram_join", "op9_line_dedup"} <= set(entry.oracle_sql())
