"""Registered queries: t-tests and repeated-measures ANOVA."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.operators import analysis as X
from evalframe.operators import stats as T
from evalframe.plans.common import Registry, rounded
from evalframe.session import cut_lineage
from evalframe.sources import adapters as A

reg = Registry()

EVENT_CONDITIONS = ["click", "error", "purchase", "signup", "view"]
TASKS = ["post", "reply"]
TTEST_A, TTEST_B = "click", "view"
_N = 20000  # integration points of the oracle's tail probabilities


def t_p_sql(t: str, d: str) -> str:
    """Two-sided Student-t tail by midpoint integration (oracle side only)."""
    x = f"(abs({t}) + q.v / (1 - q.v))"
    dens = (f"exp(lgamma(({d} + 1) / 2.0) - lgamma({d} / 2.0) - 0.5 * ln({d} * pi()) "
            f"- ({d} + 1) / 2.0 * ln(1 + {x} * {x} / {d})) / ((1 - q.v) * (1 - q.v))")
    return (f"(SELECT 2.0 * sum({dens}) / {_N} FROM (SELECT (i + 0.5) / {_N}.0 AS v "
            f"FROM range(0, {_N}) r(i)) q)")


def f_p_sql(f: str, d1: str, d2: str) -> str:
    """Upper tail of Fisher's F by midpoint integration (oracle side only)."""
    x = f"({f} + q.v / (1 - q.v))"
    logd = (f"0.5 * ({d1} * ln({d1} * {x}) + {d2} * ln({d2}) - ({d1} + {d2}) * ln({d1} * {x} + {d2})) "
            f"- ln({x}) - (lgamma({d1} / 2.0) + lgamma({d2} / 2.0) - lgamma(({d1} + {d2}) / 2.0))")
    return (f"(SELECT sum(exp({logd}) / ((1 - q.v) * (1 - q.v))) / {_N} FROM (SELECT (i + 0.5) / {_N}.0 AS v "
            f"FROM range(0, {_N}) r(i)) q)")


def chi_p_sql(x: str, k: str) -> str:
    """Upper tail of chi-square by midpoint integration (oracle side only)."""
    t = f"({x} + q.v / (1 - q.v))"
    return (f"(SELECT sum(exp(({k} / 2.0 - 1) * ln({t}) - {t} / 2.0 - {k} / 2.0 * ln(2.0) - lgamma({k} / 2.0)) "
            f"/ ((1 - q.v) * (1 - q.v))) / {_N} FROM (SELECT (i + 0.5) / {_N}.0 AS v FROM range(0, {_N}) r(i)) q)")


def spher_sql(by: str) -> str:
    """CTEs from z(by, user_id, cell, z) and e(by, df1, df2, n, f_statistic, ...) to fp, the tested effects.
    The product of the four eigenvalues comes from the sums of their powers (traces of the matrix' powers)."""
    f = ("(1 - 38.0 / (24.0 * (n - 1)))", "(-(n - 1) * {f} * ln(w))")
    chi = f[1].format(f=f[0])
    second = f"(6.0 * 3 * 2 * (128 + 96 + 12 + 2) / (288 * power((n - 1) * 4 * {f[0]}, 2)))"
    return f"""cov AS (SELECT a.{by}, a.cell AS i, b.cell AS j, covar_samp(a.z, b.z) AS c FROM z a
  JOIN z b ON a.{by} = b.{by} AND a.user_id = b.user_id GROUP BY ALL),
sq AS (SELECT a.{by}, a.i, b.j, sum(a.c * b.c) AS c FROM cov a JOIN cov b ON a.{by} = b.{by} AND a.j = b.i GROUP BY ALL),
pw AS (SELECT a.{by}, sum(CASE WHEN a.i = a.j THEN a.c ELSE 0 END) AS p1, sum(a.c * a.c) AS p2, sum(s.c * a.c) AS p3,
  sum(s.c * s.c) AS p4 FROM cov a JOIN sq s ON a.{by} = s.{by} AND a.i = s.i AND a.j = s.j GROUP BY a.{by}),
sp AS (SELECT e.*, CASE WHEN df1 = 1 THEN 1.0 ELSE p1 * p1 / (df1 * p2) END AS epsilon,
  CASE WHEN df1 = 4 THEN (power(p1, 4) - 6 * p1 * p1 * p2 + 3 * p2 * p2 + 8 * p1 * p3 - 6 * p4) / 24.0 / power(p1 / 4, 4) END AS w
  FROM e JOIN pw ON e.{by} = pw.{by}),
sc AS (SELECT *, CASE WHEN w IS NOT NULL THEN {chi_p_sql(chi, '9')} + {second} * ({chi_p_sql(chi, '13')} - {chi_p_sql(chi, '9')}) END AS p_spher FROM sp),
pp AS (SELECT *, {f_p_sql('f_statistic', 'df1', 'df2')} AS p_value, {f_p_sql('f_statistic', '(df1 * epsilon)', '(df2 * epsilon)')} AS p_gg,
  CASE WHEN df1 = 1 THEN true ELSE p_spher > 0.05 END AS spherical FROM sc),
fp AS (SELECT *, CASE WHEN spherical THEN p_value ELSE p_gg END AS p_reported FROM pp)"""


_TESTED = """round(ss, 6) AS ss, df1, round(ss_error, 6) AS ss_error, df2, round(f_statistic, 6) AS f_statistic,
  round(ss / den, 6) AS ges, round(epsilon, 6) AS epsilon, round(w, 6) AS w_spher, round(p_spher, 6) AS p_spher, spherical,
  round(p_value, 6) AS p_value, round(p_gg, 6) AS p_gg, round(p_reported, 6) AS p_reported, p_reported < 0.05 AS significant FROM fp"""

_CELLS = A.with_sql(A.RESULTS_SQL, """cells AS (SELECT user_id, condition, task,
  coalesce(avg(score), 0.0) AS mean_value FROM results GROUP BY ALL)""")


def cells(spark, sf_dir):
    return X.cell_means(A.results_from_events(spark, sf_dir))


@reg.add("ttest_ind", _CELLS + f""", g AS (SELECT count_if(condition = '{TTEST_A}') AS n1, count_if(condition = '{TTEST_B}') AS n2,
    avg(mean_value) FILTER (WHERE condition = '{TTEST_A}') AS mean1,
    avg(mean_value) FILTER (WHERE condition = '{TTEST_B}') AS mean2,
    var_samp(mean_value) FILTER (WHERE condition = '{TTEST_A}') AS var1,
    var_samp(mean_value) FILTER (WHERE condition = '{TTEST_B}') AS var2
  FROM cells WHERE condition IN ('{TTEST_A}', '{TTEST_B}') AND mean_value IS NOT NULL),
t AS (SELECT *, CASE WHEN n1 > 1 AND n2 > 1 THEN (mean1 - mean2) / sqrt(((n1 - 1) * var1 + (n2 - 1) * var2)
    / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) END AS t_statistic,
    CASE WHEN n1 > 1 AND n2 > 1 THEN n1 + n2 - 2 END AS df FROM g),
tp AS (SELECT *, {t_p_sql('t_statistic', 'df')} AS p_value FROM t)
SELECT '{TTEST_A}' AS group_a, '{TTEST_B}' AS group_b, n1, n2, round(mean1, 6) AS mean1, round(mean2, 6) AS mean2,
  round(t_statistic, 6) AS t_statistic, df, round(p_value, 6) AS p_value, p_value < 0.05 AS significant FROM tp""")
def ttest_ind(spark, sf_dir):
    return rounded(T.ttest_ind(cells(spark, sf_dir), "condition", TTEST_A, TTEST_B, "mean_value"))


_USER_COND = f""", uc AS (SELECT user_id, condition, avg(mean_value) AS m FROM cells
  WHERE user_id IN (SELECT user_id FROM cells GROUP BY user_id HAVING count(*) = {len(EVENT_CONDITIONS) * len(TASKS)})
  GROUP BY ALL)"""


def _paired_sql() -> str:
    pairs = [(a, b) for i, a in enumerate(EVENT_CONDITIONS) for b in EVENT_CONDITIONS[i + 1:]]
    wide = ", ".join(f"max(m) FILTER (WHERE condition = '{c}') AS \"{c}\"" for c in EVENT_CONDITIONS)
    diffs = " UNION ALL ".join(f"SELECT '{a}' AS level_a, '{b}' AS level_b, \"{a}\" AS x, \"{b}\" AS y, \"{a}\" - \"{b}\" AS d FROM wide"
                               for a, b in pairs)
    return f""", wide AS (SELECT user_id, {wide} FROM uc GROUP BY user_id),
dd AS ({diffs}),
g AS (SELECT level_a, level_b, count(*) AS n, avg(d) AS mean_diff, stddev_samp(d) AS sd_diff,
  avg(d) / sqrt((var_samp(x) + var_samp(y)) / 2) AS cohen_d
  FROM dd WHERE d IS NOT NULL GROUP BY ALL),
t AS (SELECT *, CASE WHEN n > 1 THEN mean_diff / (sd_diff / sqrt(n)) END AS t_statistic, n - 1 AS df FROM g),
tp AS (SELECT *, least(1.0, p_value * {len(pairs)}) AS p_bonferroni FROM (
  SELECT *, {t_p_sql('t_statistic', 'df')} AS p_value FROM t))"""


@reg.add("ttest_paired", _CELLS + _USER_COND + _paired_sql() + """
SELECT level_a, level_b, n, round(mean_diff, 6) AS mean_diff, round(sd_diff, 6) AS sd_diff,
  round(t_statistic, 6) AS t_statistic, df, round(cohen_d, 6) AS cohen_d, round(p_value, 6) AS p_value,
  round(p_bonferroni, 6) AS p_bonferroni, p_bonferroni < 0.05 AS significant FROM tp""")
def ttest_paired(spark, sf_dir):
    uc = complete_cells(spark, sf_dir).groupBy("user_id", "condition").agg(F.avg("mean_value").alias("mean_value"))
    return rounded(T.ttest_paired(uc, "condition", EVENT_CONDITIONS))


_ANOVA = f""", cc AS (SELECT * FROM cells WHERE user_id IN (
    SELECT user_id FROM cells GROUP BY user_id HAVING count(*) = {len(EVENT_CONDITIONS) * len(TASKS)})),
x AS (SELECT cc.user_id, cc.condition, cc.task, mean_value AS y,
    avg(mean_value) OVER (PARTITION BY cc.user_id) AS m_s,
    avg(mean_value) OVER (PARTITION BY cc.user_id, cc.condition) AS m_sa,
    avg(mean_value) OVER (PARTITION BY cc.user_id, cc.task) AS m_sb,
    avg(mean_value) OVER (PARTITION BY cc.condition) AS m_a,
    avg(mean_value) OVER (PARTITION BY cc.task) AS m_b,
    avg(mean_value) OVER (PARTITION BY cc.condition, cc.task) AS m_ab,
    avg(mean_value) OVER () AS m FROM cc),
s AS (SELECT sum(power(m_a - m, 2)) AS ss_a, sum(power(m_b - m, 2)) AS ss_b, sum(power(m_s - m, 2)) AS ss_s,
    sum(power(m_ab - m_a - m_b + m, 2)) AS ss_ab, sum(power(m_sa - m_a - m_s + m, 2)) AS ss_as,
    sum(power(m_sb - m_b - m_s + m, 2)) AS ss_bs,
    sum(power(y - m_ab - m_sa - m_sb + m_a + m_b + m_s - m, 2)) AS ss_abs,
    count(DISTINCT user_id) AS n, count(DISTINCT condition) AS a, count(DISTINCT task) AS b FROM x),
e0 AS (SELECT 'condition' AS source, n, ss_a AS ss, a - 1 AS df1, ss_as AS ss_error, (a - 1) * (n - 1) AS df2,
         ss_a + ss_s + ss_as + ss_bs + ss_abs AS den FROM s
  UNION ALL SELECT 'task', n, ss_b, b - 1, ss_bs, (b - 1) * (n - 1), ss_b + ss_s + ss_as + ss_bs + ss_abs FROM s
  UNION ALL SELECT 'condition:task', n, ss_ab, (a - 1) * (b - 1), ss_abs, (a - 1) * (b - 1) * (n - 1),
         ss_ab + ss_s + ss_as + ss_bs + ss_abs FROM s),
e AS (SELECT *, CASE WHEN df1 > 0 AND df2 > 0 AND ss_error > 0 THEN (ss / df1) / (ss_error / df2) END AS f_statistic FROM e0),
z AS (SELECT 'condition' AS source, user_id, condition AS cell, max(m_sa - m_s) AS z FROM x GROUP BY ALL
  UNION ALL SELECT 'task', user_id, task, max(m_sb - m_s) FROM x GROUP BY ALL
  UNION ALL SELECT 'condition:task', user_id, condition || ' ' || task, y - m_sa - m_sb + m_s FROM x),
{spher_sql('source')}"""


def complete_cells(spark, sf_dir):
    """Cells of the users with a value for every condition and task (J10), written once."""
    return cut_lineage(T.complete_users(cells(spark, sf_dir), ["condition", "task"], [len(EVENT_CONDITIONS), len(TASKS)]))


@reg.add("rm_anova", _CELLS + _ANOVA + f"""
SELECT source, {_TESTED}""")
def rm_anova(spark, sf_dir):
    return rounded(T.rm_anova(complete_cells(spark, sf_dir), "condition", "task"))


@reg.add("rm_anova_oneway", _CELLS + f""", cc AS (SELECT * FROM cells WHERE (user_id, task) IN (
    SELECT (user_id, task) FROM cells GROUP BY user_id, task HAVING count(*) = {len(EVENT_CONDITIONS)})),
x AS (SELECT user_id, condition, task, mean_value AS y, avg(mean_value) OVER (PARTITION BY task, user_id) AS m_s,
    avg(mean_value) OVER (PARTITION BY task, condition) AS m_a, avg(mean_value) OVER (PARTITION BY task) AS m FROM cc),
s AS (SELECT task, sum(power(m_a - m, 2)) AS ss, sum(power(m_s - m, 2)) AS ss_s, sum(power(y - m_a - m_s + m, 2)) AS ss_error,
    count(DISTINCT user_id) AS n, count(DISTINCT condition) - 1 AS df1 FROM x GROUP BY task),
e AS (SELECT *, df1 * (n - 1) AS df2, ss + ss_s + ss_error AS den, (ss / df1) / (ss_error / (df1 * (n - 1))) AS f_statistic FROM s),
z AS (SELECT task, user_id, condition AS cell, y - m_s AS z FROM x),
{spher_sql('task')}
SELECT task, 'condition' AS source, {_TESTED}""")
def rm_anova_oneway(spark, sf_dir):
    """A41, the form for a single task, on each task by itself."""
    c = cells(spark, sf_dir)
    full = c.groupBy("user_id", "task").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == len(EVENT_CONDITIONS))
    c = cut_lineage(c.join(full, ["user_id", "task"], "left_semi"))
    return rounded(T.rm_anova_oneway(c, "condition", ["task"]))


_FINDINGS = f""", ds AS (SELECT condition, task, count(mean_value) AS k, avg(mean_value) AS mean, stddev_samp(mean_value) AS std,
  median(mean_value) AS med FROM cells GROUP BY ALL)
SELECT 'descriptive' AS section, task || ' / ' || condition AS effect,
  printf('n = %d, mean = %.3f, std = %.3f, median = %.3f', k, mean, std, med) AS statement, CAST(NULL AS BOOLEAN) AS significant FROM ds
UNION ALL SELECT 'anova', source, printf('F(%d, %d) = %.3f, p = %.3f, ges = %.3f, eps = %.3f', CAST(df1 AS BIGINT),
  CAST(df2 AS BIGINT), f_statistic, p_reported, ss / den, epsilon), p_reported < 0.05 FROM fp
UNION ALL SELECT 'post-hoc', level_a || ' - ' || level_b, printf('t(%d) = %.3f, p = %.3f, d = %.3f', CAST(df AS BIGINT), t_statistic,
  p_bonferroni, cohen_d), p_bonferroni < 0.05 FROM tp
UNION ALL SELECT 'interpretation', source, CASE WHEN p_reported < 0.05 THEN 'the effect of condition depends on the task'
  ELSE 'the effect of condition is the same for both tasks' END, p_reported < 0.05 FROM fp WHERE source = 'condition:task'"""


@reg.add("findings", _CELLS + _USER_COND + _paired_sql() + _ANOVA + _FINDINGS)
def findings(spark, sf_dir):
    """The report's statements: descriptives, the three effects, all pairs, the conclusion."""
    full = complete_cells(spark, sf_dir)
    means = full.groupBy("user_id", "condition").agg(F.avg("mean_value").alias("mean_value"))
    return T.findings(X.descriptives(cells(spark, sf_dir), ["condition", "task"], "mean_value"),
                      T.rm_anova(full, "condition", "task"), T.ttest_paired(means, "condition", EVENT_CONDITIONS))
