"""DuckDB spellings shared by the oracle SQL strings.

These only build the *check* side; the Spark side never parses SQL.
"""

from __future__ import annotations

from evalframe.functions.text import ROUGE_TOKENS_SQL, bleu_tokens_sql


def r6(expr: str, alias: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {alias}"


def grams_sql(src: str, key: str, col: str, tag: str, orders: tuple[int, ...], side: int) -> str:
    vals = ", ".join(f"({n})" for n in orders)
    return (f"SELECT {key}, '{tag}' AS t, n, {side} AS side, "
            f"unnest(list_transform(range(1, len({col}) - n + 2), "
            f"lambda i: array_to_string({col}[i:i + n - 1], ' '))) AS gram "
            f"FROM {src}, (VALUES {vals}) v(n)")


def pair_scores_sql(pairs_cte: str, key: str = '"index"') -> str:
    """CTEs ``tok``, ``ov`` and ``sc`` (per-pair ROUGE-1/2 F1 and BLEU parts)."""
    rp, rr = ROUGE_TOKENS_SQL.format(c="prediction"), ROUGE_TOKENS_SQL.format(c="reference")
    bp, br = bleu_tokens_sql("prediction"), bleu_tokens_sql("reference")
    grams = " UNION ALL ".join([
        grams_sql("tok", key, "rp", "r", (1, 2), 1),
        grams_sql("tok", key, "rr", "r", (1, 2), 2),
        grams_sql("tok", key, "bp", "b", (1, 2, 3, 4), 1),
        grams_sql("tok", key, "br", "b", (1, 2, 3, 4), 2),
    ])
    m = {f"{t}{n}": f"max(m) FILTER (WHERE t = '{t}' AND n = {n})"
         for t, n in [("r", 1), ("r", 2), ("b", 1), ("b", 2), ("b", 3), ("b", 4)]}

    def f1(mm, lp, lr):
        p = f"(CAST({mm} AS DOUBLE) / greatest({lp}, 1))"
        r = f"(CAST({mm} AS DOUBLE) / greatest({lr}, 1))"
        return f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END"

    prec = {n: f"CASE WHEN bp{n} > 0 THEN CAST(bm{n} AS DOUBLE) / bp{n} ELSE 0.0 END" for n in range(1, 5)}
    return f"""{pairs_cte},
tok AS (SELECT *, {rp} AS rp, {rr} AS rr, {bp} AS bp, {br} AS br FROM pairs),
grams AS ({grams}),
gc AS (SELECT {key}, t, n, gram, count(*) FILTER (WHERE side = 1) AS cp,
              count(*) FILTER (WHERE side = 2) AS cr FROM grams GROUP BY ALL),
ov AS (SELECT {key}, t, n, sum(least(cp, cr)) AS m FROM gc GROUP BY ALL),
ovp AS (SELECT {key}, {m['r1']} AS rm1, {m['r2']} AS rm2, {m['b1']} AS bm1, {m['b2']} AS bm2,
               {m['b3']} AS bm3, {m['b4']} AS bm4 FROM ov GROUP BY {key}),
cnt AS (SELECT tok.*, coalesce(rm1, 0) AS rm1, coalesce(rm2, 0) AS rm2, coalesce(bm1, 0) AS bm1,
               coalesce(bm2, 0) AS bm2, coalesce(bm3, 0) AS bm3, coalesce(bm4, 0) AS bm4,
               len(rp) AS rlp, len(rr) AS rlr, len(bp) AS tl, len(br) AS rl,
               greatest(len(bp), 0) AS bp1, greatest(len(bp) - 1, 0) AS bp2, greatest(len(bp) - 2, 0) AS bp3,
               greatest(len(bp) - 3, 0) AS bp4
        FROM tok LEFT JOIN ovp ON tok.{key} = ovp.{key}),
prec AS (SELECT *, {prec[1]} AS p1, {prec[2]} AS p2, {prec[3]} AS p3, {prec[4]} AS p4,
                CAST(tl AS DOUBLE) / rl AS ratio FROM cnt),
sc AS (SELECT *, {f1('rm1', 'rlp', 'rlr')} AS rouge1,
              {f1('rm2', 'greatest(rlp - 1, 0)', 'greatest(rlr - 1, 0)')} AS rouge2,
              CASE WHEN tl > 0 AND rl > 0 THEN
                (CASE WHEN least(p1, p2, p3, p4) > 0
                      THEN exp(0.25 * ln(p1) + 0.25 * ln(p2) + 0.25 * ln(p3) + 0.25 * ln(p4)) ELSE 0.0 END)
                * (CASE WHEN ratio > 1.0 THEN 1.0 ELSE exp(1 - 1 / ratio) END) END AS bleu,
              CASE WHEN tl > 0 AND rl > 0 THEN
                (CASE WHEN ratio > 1.0 THEN 1.0 ELSE exp(1 - 1 / ratio) END) END AS brevity_penalty
       FROM prec)"""


def lcs_sql(key: str = '"index"') -> str:
    """CTEs ``ltok``, ``rec``, ``lcsr`` (per-pair LCS length of the ROUGE
    tokens) on top of a ``pairs`` CTE; needs ``WITH RECURSIVE``.

    Exact dynamic programming, one DP row per recursion step: the candidate
    of cell j is max(previous row at j, previous row at j-1 + 1 on a token
    match) and the new row is the running max of the candidates."""
    rt = ROUGE_TOKENS_SQL
    return f"""ltok AS (SELECT {key} AS idx, {rt.format(c='prediction')} AS a, {rt.format(c='reference')} AS b FROM pairs),
rec(idx, i, j, v) AS (
  SELECT idx, 0, j, 0 FROM ltok, range(0, len(b) + 1) r(j)
  UNION ALL
  SELECT idx, i + 1, j, max(cand) OVER (PARTITION BY idx ORDER BY j ROWS UNBOUNDED PRECEDING)
  FROM (SELECT r.idx, r.i, r.j,
          greatest(r.v, CASE WHEN r.j > 0 AND t.a[r.i + 1] = t.b[r.j]
                             THEN lag(r.v) OVER (PARTITION BY r.idx ORDER BY r.j) + 1 ELSE 0 END) AS cand
        FROM rec r JOIN ltok t ON r.idx = t.idx WHERE r.i < len(t.a)) s),
lcsr AS (SELECT t.idx, len(t.a) AS la, len(t.b) AS lb, max(v) FILTER (WHERE rec.i = len(t.a)) AS lcs
  FROM ltok t JOIN rec ON rec.idx = t.idx GROUP BY t.idx, len(t.a), len(t.b))"""
