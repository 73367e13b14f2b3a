"""Inferential statistics over per-user cells.

All three tests reduce to a handful of grouped sums; the only Python is the
t / F tail probability on the (tiny) result rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalframe.functions.dist import f_pvalue, mauchly_test, t_pvalue

ALPHA = 0.05


def ttest_ind(df: DataFrame, by: str, a: str, b: str, value: str) -> DataFrame:
    """Two-sample t-test with pooled (equal) variance between the rows
    of group ``a`` and group ``b``; needs more than one value per group."""
    v = F.col(value)
    g = df.where(F.col(by).isin(a, b) & v.isNotNull()).agg(
        F.count_if(F.col(by) == a).alias("n1"), F.count_if(F.col(by) == b).alias("n2"),
        F.avg(F.when(F.col(by) == a, v)).alias("mean1"), F.avg(F.when(F.col(by) == b, v)).alias("mean2"),
        F.var_samp(F.when(F.col(by) == a, v)).alias("var1"), F.var_samp(F.when(F.col(by) == b, v)).alias("var2"))
    dfree = F.col("n1") + F.col("n2") - 2
    sp2 = F.try_divide((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2"), dfree)
    t = F.try_divide(F.col("mean1") - F.col("mean2"),
                     F.sqrt(sp2 * (F.try_divide(F.lit(1.0), F.col("n1")) + F.try_divide(F.lit(1.0), F.col("n2")))))
    ok = (F.col("n1") > 1) & (F.col("n2") > 1)
    out = g.select(F.lit(a).alias("group_a"), F.lit(b).alias("group_b"), "n1", "n2", "mean1", "mean2",
                   F.when(ok, t).alias("t_statistic"), F.when(ok, dfree).alias("df"))
    return out.withColumn("p_value", t_pvalue(F.col("t_statistic"), F.col("df"))) \
              .withColumn("significant", F.col("p_value") < ALPHA)


def complete_users(cells: DataFrame, factors: Sequence[str], levels: Sequence[int],
                   subject: str = "user_id") -> DataFrame:
    """Keep subjects that have a value in every factor-level cell."""
    need = 1
    for n in levels:
        need *= n
    full = cells.groupBy(subject).agg(F.count(F.lit(1)).alias("_cells")).where(F.col("_cells") == need)
    return cells.join(full.select(subject), subject, "left_semi")


def ttest_paired(cells: DataFrame, by: str, levels: Sequence[str], value: str = "mean_value",
                 subject: str = "user_id") -> DataFrame:
    """Pairwise paired t-tests between levels on per-subject means,
    Bonferroni-corrected.  The levels are pivoted into columns (one row per
    subject), so every pair is a column difference -- no self-join."""
    levels = list(levels)
    wide = cells.groupBy(subject).pivot(by, levels).agg(F.avg(value))
    pairs = list(combinations(levels, 2))
    diffs = [F.struct(F.lit(a).alias("level_a"), F.lit(b).alias("level_b"), F.col(f"`{a}`").alias("x"),
                      F.col(f"`{b}`").alias("y")) for a, b in pairs]
    # one pass over the pivoted rows: every pair is generated from the same row
    long = wide.select(F.explode(F.array(*diffs)).alias("p")).select("p.*").withColumn("d", F.col("x") - F.col("y"))
    g = long.where(F.col("d").isNotNull()).groupBy("level_a", "level_b").agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd_diff"),
        F.sqrt((F.var_samp("x") + F.var_samp("y")) / 2).alias("sd_mean"))
    t = F.try_divide(F.col("mean_diff"), F.try_divide(F.col("sd_diff"), F.sqrt(F.col("n"))))
    out = g.select("level_a", "level_b", "n", "mean_diff", "sd_diff",
                   F.when(F.col("n") > 1, t).alias("t_statistic"), (F.col("n") - 1).alias("df"),
                   F.try_divide("mean_diff", "sd_mean").alias("cohen_d"))
    out = out.withColumn("p_value", t_pvalue(F.col("t_statistic"), F.col("df")))
    return out.withColumn("p_bonferroni", F.least(F.lit(1.0), F.col("p_value") * len(pairs))) \
              .withColumn("significant", F.col("p_bonferroni") < ALPHA)


def sphericity(scores: DataFrame, dims: DataFrame, by: Sequence[str], subject: str = "user_id") -> DataFrame:
    """Per group ``by``: Greenhouse-Geisser epsilon, Mauchly's W, its p-value, and whether the
    contrasts count as spherical (always for a single one).

    ``scores(by, subject, cell, z)``: each subject's scores, centred on the effect's contrasts;
    ``dims(by, d)``: their number.  One aggregate over the pairs of a subject's few cells gives the
    covariances, and only these reach the test."""
    by = list(by)
    rows = scores.groupBy(*by, subject).agg(F.sort_array(F.collect_list(F.struct("cell", "z"))).alias("zs"))
    pairs = (rows.select(*by, "zs", F.posexplode("zs").alias("i", "x"))
             .select(*by, "i", F.col("x.z").alias("x"), F.posexplode("zs").alias("j", "y")).where("i <= j"))
    cov = pairs.groupBy(*by, "i", "j").agg(F.covar_samp("x", F.col("y.z")).alias("c"), F.count(F.lit(1)).alias("n"))
    both = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    g = cov.groupBy(*by).agg(F.collect_list(F.struct("i", "j", "c")).alias("s"), F.max("n").alias("n"),
                             F.sum(F.when(F.col("i") == F.col("j"), F.col("c"))).alias("tr"),
                             F.sum(both * F.col("c") * F.col("c")).alias("tr2")).join(dims, by)
    g = g.withColumn("m", mauchly_test(F.col("s"), F.col("n"), F.col("d")))
    eps = F.when(F.col("d") == 1, F.lit(1.0)).otherwise(F.try_divide(F.col("tr") * F.col("tr"), F.col("d") * F.col("tr2")))
    p = F.when(F.isnan("m.p"), F.lit(None)).otherwise(F.col("m.p"))
    return g.select(*by, eps.alias("epsilon"), F.when(F.isnan("m.w"), F.lit(None)).otherwise(F.col("m.w")).alias("w_spher"),
                    p.alias("p_spher"), F.when(F.col("d") == 1, F.lit(True)).otherwise(p > ALPHA).alias("spherical"))


def _corrected(effects: DataFrame, tests: DataFrame, by: Sequence[str]) -> DataFrame:
    """Plain and corrected p-values; the corrected one is reported where sphericity fails."""
    out = effects.join(tests, list(by), "left")
    f, d1, d2, e = (F.col(c) for c in ("f_statistic", "df1", "df2", "epsilon"))
    out = out.withColumn("p_value", f_pvalue(f, d1, d2)).withColumn("p_gg", f_pvalue(f, d1 * e, d2 * e))
    out = out.withColumn("p_reported", F.when(F.coalesce("spherical", F.lit(True)), F.col("p_value")).otherwise(F.col("p_gg")))
    return out.withColumn("significant", F.col("p_reported") < ALPHA)


def rm_anova_oneway(cells: DataFrame, a: str, by: Sequence[str], value: str = "mean_value", subject: str = "user_id") -> DataFrame:
    """A41, one-way form: a within subjects, for each group of ``by`` on its own (one task, say).
    ``cells`` holds one value per group, subject and level, and only subjects with all levels."""
    by = list(by)
    base = cells.select(*by, subject, a, F.col(value).alias("y"))
    x = (base.withColumn("m_s", F.avg("y").over(Window.partitionBy(*by, subject)))
         .join(base.groupBy(*by, a).agg(F.avg("y").alias("m_a")), [*by, a])
         .join(base.groupBy(*by).agg(F.avg("y").alias("m"), F.countDistinct(subject).alias("n"), F.countDistinct(a).alias("a")), by))
    m, m_a, m_s = F.col("m"), F.col("m_a"), F.col("m_s")
    sums = x.groupBy(*by).agg(F.sum((m_a - m) ** 2).alias("ss"), F.sum((m_s - m) ** 2).alias("ss_s"),
                              F.sum((F.col("y") - m_a - m_s + m) ** 2).alias("ss_error"), F.first("n").alias("n"), F.first("a").alias("a"))
    d1, d2 = F.col("a") - 1, (F.col("a") - 1) * (F.col("n") - 1)
    f = F.try_divide(F.try_divide(F.col("ss"), d1), F.try_divide(F.col("ss_error"), d2))
    effects = sums.select(*by, F.lit(a).alias("source"), "ss", d1.alias("df1"), "ss_error", d2.alias("df2"),
                          F.when((d1 > 0) & (d2 > 0) & (F.col("ss_error") > 0), f).alias("f_statistic"),
                          F.try_divide("ss", F.col("ss") + F.col("ss_s") + F.col("ss_error")).alias("ges"))
    scores = x.select(*by, subject, F.col(a).alias("cell"), (F.col("y") - m_s).alias("z"))
    return _corrected(effects, sphericity(scores, effects.select(*by, F.col("df1").alias("d")), by, subject), by)


def rm_anova(cells: DataFrame, a: str, b: str, value: str = "mean_value", subject: str = "user_id") -> DataFrame:
    """Two-way repeated-measures ANOVA (a x b within subjects) with
    generalized eta squared, and for each effect Mauchly's test and the
    Greenhouse-Geisser corrected p-value.  ``cells`` holds one value per subject x a x b
    and only complete subjects (see ``complete_users``).

    Level means are small grouped aggregates; subject-level means are
    windows over one subject's cells (bounded by a x b rows).
    """
    y = F.col(value)
    s = Window.partitionBy(subject)
    sa = Window.partitionBy(subject, a)
    sb = Window.partitionBy(subject, b)
    base = cells.select(subject, a, b, y.alias("y"))
    ma = base.groupBy(a).agg(F.avg("y").alias("m_a"))
    mb = base.groupBy(b).agg(F.avg("y").alias("m_b"))
    mab = base.groupBy(a, b).agg(F.avg("y").alias("m_ab"))
    grand = base.agg(F.struct(F.avg("y").alias("m"), F.countDistinct(subject).alias("n_s"),
                              F.countDistinct(a).alias("n_a"), F.countDistinct(b).alias("n_b")).alias("g")).scalar()
    x = (base.withColumn("m_s", F.avg("y").over(s)).withColumn("m_sa", F.avg("y").over(sa))
             .withColumn("m_sb", F.avg("y").over(sb))
             .join(ma, a).join(mb, b).join(mab, [a, b]))
    # grand mean and level counts: one scalar subquery (a struct), no join
    x = x.withColumn("_g", grand).select("*", "_g.*").drop("_g")
    m, m_a, m_b, m_ab = F.col("m"), F.col("m_a"), F.col("m_b"), F.col("m_ab")
    m_s, m_sa, m_sb = F.col("m_s"), F.col("m_sa"), F.col("m_sb")
    na, nb = F.col("n_a"), F.col("n_b")
    # every squared deviation is summed over all cells; dividing by the number
    # of cells sharing that mean turns the per-row sums into the usual SS.
    sums = x.agg(
        F.sum((m_a - m) ** 2).alias("ss_a"),
        F.sum((m_b - m) ** 2).alias("ss_b"),
        F.sum((m_s - m) ** 2).alias("ss_s"),
        F.sum((m_ab - m_a - m_b + m) ** 2).alias("ss_ab"),
        F.sum((m_sa - m_a - m_s + m) ** 2).alias("ss_as"),
        F.sum((m_sb - m_b - m_s + m) ** 2).alias("ss_bs"),
        F.sum((F.col("y") - m_ab - m_sa - m_sb + m_a + m_b + m_s - m) ** 2).alias("ss_abs"),
        F.first("n_s").alias("n"), F.first("n_a").alias("a"), F.first("n_b").alias("b"))
    err = F.col("ss_s") + F.col("ss_as") + F.col("ss_bs") + F.col("ss_abs")
    n_, a_, b_ = F.col("n"), F.col("a"), F.col("b")
    terms = [
        ("condition" if a == "condition" else a, "ss_a", a_ - 1, "ss_as", (a_ - 1) * (n_ - 1)),
        ("task" if b == "task" else b, "ss_b", b_ - 1, "ss_bs", (b_ - 1) * (n_ - 1)),
        (f"{a}:{b}", "ss_ab", (a_ - 1) * (b_ - 1), "ss_abs", (a_ - 1) * (b_ - 1) * (n_ - 1)),
    ]
    rows = []
    for name, ss, d1, sse, d2 in terms:
        f = F.try_divide(F.try_divide(F.col(ss), d1), F.try_divide(F.col(sse), d2))
        rows.append(F.struct(F.lit(name).alias("source"), F.col(ss).alias("ss"), d1.alias("df1"),
                             F.col(sse).alias("ss_error"), d2.alias("df2"),
                             F.when((d1 > 0) & (d2 > 0) & (F.col(sse) > 0), f).alias("f_statistic"),
                             F.try_divide(F.col(ss), F.col(ss) + err).alias("ges")))
    # one pass over the sums row; the three effects are generated from it
    out = sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    # scores centred on the contrasts of each effect: one row per subject and level, or cell
    x = x.select(subject, a, b, "y", "m_s", "m_sa", "m_sb")
    za = x.groupBy(subject, F.col(a).alias("cell")).agg(F.max(m_sa - m_s).alias("z")).withColumn("source", F.lit(a))
    zb = x.groupBy(subject, F.col(b).alias("cell")).agg(F.max(m_sb - m_s).alias("z")).withColumn("source", F.lit(b))
    zab = x.select(subject, F.to_json(F.array(a, b)).alias("cell"), (F.col("y") - m_sa - m_sb + m_s).alias("z"),
                   F.lit(f"{a}:{b}").alias("source"))
    tests = sphericity(za.unionByName(zb).unionByName(zab), out.select("source", F.col("df1").alias("d")), ["source"], subject)
    return _corrected(out, tests, ["source"])


def findings(cells: DataFrame, effects: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per statement of the report (section, effect, statement, significant) from the
    descriptives by condition and task, the ANOVA's effects and the paired tests."""
    big = lambda c: F.col(c).cast("bigint")
    said = [cells.select(F.lit("descriptive").alias("section"), F.concat_ws(" / ", "task", "condition").alias("effect"),
                         F.format_string("n = %d, mean = %.3f, std = %.3f, median = %.3f", "count", "mean", "std", "median").alias("statement"),
                         F.lit(None).cast("boolean").alias("significant")),
            effects.select(F.lit("anova"), "source", F.format_string(
                "F(%d, %d) = %.3f, p = %.3f, ges = %.3f, eps = %.3f", big("df1"), big("df2"), "f_statistic", "p_reported", "ges", "epsilon"),
                "significant"),
            pairs.select(F.lit("post-hoc"), F.concat_ws(" - ", "level_a", "level_b"), F.format_string(
                "t(%d) = %.3f, p = %.3f, d = %.3f", big("df"), "t_statistic", "p_bonferroni", "cohen_d"), "significant"),
            effects.where(F.col("source") == "condition:task").select(
                F.lit("interpretation"), "source", F.when(F.col("significant"), F.lit("the effect of condition depends on the task"))
                .otherwise(F.lit("the effect of condition is the same for both tasks")), "significant")]
    out = said[0]
    for rows in said[1:]:
        out = out.union(rows)
    return out
