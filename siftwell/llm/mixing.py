"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling.

Token weights are summed by cell (source, language, topic), raked to the three target
marginals, and turned into sampling probabilities whose expected tokens are a share of
the corpus. Documents pass with the probability of their cell, by a hash of their id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, fresh, written

#: A dimension's targets are its token shares to this power, rescaled: below 1 lifts what is rare.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 1.0}
ROUNDS = 30
#: Expected tokens of the sample over those of the corpus.
SHARE = 0.7
#: Cells fitted on the driver, at most; more are fitted as a DataFrame.
DRIVER_CELLS = 500_000
CELLS_BROADCAST = 16 << 20


def tokens_of(text: Column) -> Column:
    """Words: runs of characters other than blank, tab and line breaks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic by surface: table, legal, listing, verse (many short lines) or prose."""
    breaks = F.length(text) - F.length(F.translate(text, "\n", ""))
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("icense")) | F.contains(text, F.lit("rights reserved")), "legal")
        .when(F.contains(text, F.lit("$$$")) | F.contains(text, F.lit("!!")) | F.contains(text, F.lit("###")), "listing")
        .when(breaks * 120 > F.length(text), "verse")
        .otherwise("prose")
    )


def targets(cells: pd.DataFrame, powers: dict[str, float]) -> dict[str, pd.Series]:
    """Target tokens of each value of each dimension; each dimension's sum is the corpus'."""
    total = cells["tokens"].sum()
    out = {}
    for d, p in powers.items():
        t = cells.groupby(d)["tokens"].sum().sort_index() / total
        out[d] = t**p / (t**p).sum() * total
    return out


def rake(cells: pd.DataFrame, want: dict[str, pd.Series], rounds: int = ROUNDS) -> np.ndarray:
    """Fitted tokens of each cell: scaled to each dimension's marginals in turn, ``rounds`` times."""
    w = cells["tokens"].to_numpy(np.float64).copy()
    codes = {d: t.index.get_indexer(cells[d]) for d, t in want.items()}
    for _ in range(rounds):
        for d, t in want.items():
            now = np.bincount(codes[d], w, len(t))
            w *= np.divide(t.to_numpy(), now, out=np.zeros(len(t)), where=now > 0)[codes[d]]
    return w


def rates(tokens: np.ndarray, fitted: np.ndarray, share: float) -> np.ndarray:
    """min(1, s * fitted / tokens) with the s that makes the expected tokens ``share`` of all.

    The cells whose rate is 1 are a prefix in falling order of fitted / tokens; s follows from
    the first prefix that leaves the next cell under 1.
    """
    f = fitted / tokens
    order = np.argsort(-f, kind="stable")
    n, g = tokens[order], (fitted)[order]
    before_n = np.cumsum(n) - n
    after_g = g[::-1].cumsum()[::-1]
    s = (share * tokens.sum() - before_n) / after_g
    ok = np.flatnonzero(s * f[order] <= 1 + 1e-12)
    scale = s[ok[0]] if len(ok) else np.inf
    return np.minimum(1.0, scale * f)


def fit_on_driver(cells: pd.DataFrame, powers: dict[str, float], share: float, rounds: int) -> pd.DataFrame:
    cells = cells[cells["tokens"] > 0].sort_values(list(powers)).reset_index(drop=True)
    if not len(cells):
        return cells.assign(fitted=0.0, rate=0.0)
    fitted = rake(cells, targets(cells, powers), rounds)
    return cells.assign(fitted=fitted, rate=rates(cells["tokens"].to_numpy(np.float64), fitted, share))


def fit_as_table(cells: DataFrame, powers: dict[str, float], share: float, rounds: int) -> DataFrame:
    """The same for any number of cells: each marginal is an aggregation and a join, written each round."""
    cells = cells.where("tokens > 0")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    w = cells.withColumn("w", F.col("tokens").cast("double"))
    want = {}
    for d, p in powers.items():
        t = cells.groupBy(d).agg(F.pow(F.sum("tokens") / total, F.lit(p)).alias("t"))
        want[d] = written(t.withColumn("t", F.col("t") / t.agg(F.sum("t")).first()[0] * total), "mix-target") if total else t
    for _ in range(rounds):
        for d in powers:
            now = w.groupBy(d).agg(F.sum("w").alias("now"))
            w = w.join(now.join(want[d], d).select(d, (F.col("t") / F.col("now")).alias("by")), d).withColumn("w", F.col("w") * F.col("by")).drop("by")
        w = written(w, "mix-round")
    w = w.withColumn("f", F.col("w") / F.col("tokens"))
    # bisection for the scale: one aggregation a step
    low, high = 0.0, 1.0
    spent = lambda s: w.agg(F.sum(F.least(F.lit(1.0), F.col("f") * s) * F.col("tokens"))).first()[0] or 0.0
    while total and spent(high) < share * total and high < 1e18:
        high *= 4
    for _ in range(60 if total else 0):
        mid = (low + high) / 2
        low, high = (mid, high) if spent(mid) < share * total else (low, mid)
    return w.select(*powers, "tokens", F.col("w").alias("fitted"), F.least(F.lit(1.0), F.col("f") * high).alias("rate"))


def unit(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a key's digest, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def mix(df: DataFrame, text: str = "text", key: str = "doc_id", dims: dict[str, str | Column] | None = None, powers: dict[str, float] | None = None, share: float = SHARE, rounds: int = ROUNDS, seed: int = 11, rate: str | None = None, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """The sampled rows of ``df``, all columns; with ``rate``, also the probability they were taken with.

    ``dims`` names each dimension's column (default: source, lang, and topic by ``topic_of``); a
    null value is the value "(none)". ``powers`` gives the dimensions' target exponents. A row is
    taken if the hash of its ``key`` lies under its cell's rate, so rows with the same key and cell
    go together; a null key counts as an empty one. Rows without a word (null or empty texts)
    have no weight to mix and are not taken. The expected tokens are ``share`` of all; if all
    rates reach 1 before, everything is taken. A column of ``df`` named like ``rate`` is replaced.
    """
    powers = powers or POWERS
    t = F.col(f"`{text}`")
    dims = dims or {"source": "source", "lang": "lang", "topic": topic_of(t)}
    names = fresh(df, *powers)
    tok, r = fresh(df, "tokens", "rate")
    value = lambda d: F.coalesce((F.col(f"`{dims[d]}`") if isinstance(dims[d], str) else dims[d]).cast("string"), F.lit("(none)"))
    cells = df.select(*[value(d).alias(d) for d in powers], tokens_of(t).alias("tokens")).groupBy(*powers).agg(F.sum("tokens").alias("tokens"))
    cells = written(cells, "mix-cells")
    n = cells.count()
    if n <= driver_cells:
        pdf = fit_on_driver(cells.toPandas(), powers, share, rounds)
        fitted = df.sparkSession.createDataFrame(pdf[[*powers, "rate"]], ", ".join(f"`{d}` string" for d in powers) + ", rate double")
    else:
        fitted = written(fit_as_table(cells, powers, share, rounds).select(*powers, "rate"), "mix-rates")
    fitted = broadcast_if(fitted.select(*[F.col(d).alias(x) for d, x in zip(powers, names)], F.col("rate").alias(r)), n * 128, CELLS_BROADCAST)
    out = df.withColumns({x: value(d) for d, x in zip(powers, names)} | {tok: tokens_of(t)}).join(fitted, names)
    out = out.where((F.col(tok) > 0) & (unit(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), seed) < F.col(r)))
    keep = [F.col(f"`{c}`") for c in df.columns if not (rate and c.lower() == rate.lower())]
    return out.select(*keep, *([F.col(r).alias(rate)] if rate else []))


def oracle_sql(table: str = "documents", rounds: int = ROUNDS, share: float = SHARE, seed: int = 11) -> str:
    """DuckDB SQL of the default mix: the rounds written out over the small cell table."""
    steps = []
    for d, p in POWERS.items():
        steps.append(f"t_{d} AS MATERIALIZED (SELECT {d}, x / sum(x) OVER () * (SELECT sum(tokens) FROM cells) AS t FROM (SELECT {d}, pow(sum(tokens) / (SELECT sum(tokens) FROM cells), {p}) AS x FROM cells GROUP BY {d}))")
    last = "w0"
    k = 0
    for _ in range(rounds):
        for d in POWERS:
            k += 1
            steps.append(f"w{k} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, c.w * t.t / sum(c.w) OVER (PARTITION BY c.{d}) AS w FROM {last} c JOIN t_{d} t USING ({d}))")
            last = f"w{k}"
    return f"""
        WITH d AS MATERIALIZED (
            SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
                   CASE WHEN contains(text, ' | ') THEN 'table'
                        WHEN contains(text, 'icense') OR contains(text, 'rights reserved') THEN 'legal'
                        WHEN contains(text, '$$$') OR contains(text, '!!') OR contains(text, '###') THEN 'listing'
                        WHEN (length(text) - length(replace(text, chr(10), ''))) * 120 > length(text) THEN 'verse'
                        ELSE 'prose' END AS topic,
                   coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS tokens
            FROM {table}),
        cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL HAVING sum(tokens) > 0),
        w0 AS MATERIALIZED (SELECT *, tokens AS w FROM cells),
        {", ".join(steps)},
        o AS MATERIALIZED (SELECT *, w / tokens AS f,
                coalesce(sum(tokens) OVER (ORDER BY w / tokens DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_n,
                sum(w) OVER (ORDER BY w / tokens DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after_g FROM {last}),
        s AS MATERIALIZED (SELECT arg_min(({share} * (SELECT sum(tokens) FROM cells) - before_n) / after_g, before_n) AS s FROM o
              WHERE ({share} * (SELECT sum(tokens) FROM cells) - before_n) / after_g * f <= 1 + 1e-12),
        r AS MATERIALIZED (SELECT source, lang, topic, least(1.0, f * coalesce((SELECT s FROM s), 1e300)) AS rate FROM o)
        SELECT d.doc_id, d.tokens, d.topic, round(r.rate, 6) AS rate FROM d JOIN r USING (source, lang, topic)
        WHERE d.tokens > 0 AND ('0x' || substr(md5(d.doc_id::VARCHAR || ':{seed}'), 1, 8))::BIGINT / 4294967296.0 < r.rate
    """
