"""Quality rules with risk-controlled thresholds.

Features of a text are turned into scores, each of which is higher for worse texts. For every stratum
(the language) and score, cutoffs of a fixed grid are tested on the labelled holdout: of its n good
documents k have a score above the cutoff, and the cutoff is certified if the exact binomial tail
P(X <= k), X ~ B(n, alpha / scores), is at most delta divided by the number of strata and scores. Within a
stratum and score the cutoffs are tested in a fixed sequence, from the loosest on, up to the first that
fails, which needs no further correction. So with probability 1 - delta no certified cutoff rejects
more than the share alpha / scores of the good documents of its stratum, and the verdict, which rejects what
any of the scores rejects, no more than the share alpha. Of the certified cutoffs that reject
more bad than good documents of the holdout, the one that rejects most bad ones is taken; among equals,
the one that rejects fewest good ones, then the loosest. A stratum and score without such a cutoff
rejects nothing, nor does one without labels; every stratum is fitted by itself, whatever their number.

The holdout is every labelled document that passes the base rule. Cutoffs are picked in a group for each
stratum and go to every task: a certified one takes ln(delta) / ln(1 - alpha / scores) good documents of its
stratum at least (1,197), so their strata are at most that part of the labelled documents.

Defined cases: a null text has no words, which the base rule rejects; texts of any length are measured whole; a null
language is a stratum of its own; equal scores are on one side of a cutoff; labels that are null, or for unknown documents, are ignored, and a document with several
labels is good only if all say so; without labels only the base rule rejects. Rows that repeat stay
repeated; an empty table gives no row. Columns of the input that are not doc_id, text and the stratum are not read by
``judge``, whatever their names; ``keep`` returns all columns of the rows kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import Stored, store
from .batches import give_back

SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 8, 20, 30
ALPHA, DELTA = 0.01, 0.05
#: Grid of cutoffs of every score.
GRID = tuple(round(x, 4) for x in (*np.arange(0.0, 0.2, 0.005), *np.arange(0.2, 1.0, 0.02)))
FEATURES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "n_lines": "long", "n_shouted": "long"}
_SHOUT = re.compile(rb"[A-Z]{2,}")


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words which is found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    # ranks of pairs, then of fours, then of eights: equal ranks stand for equal windows, without hashing
    length, ranks = 1, ids
    while length < width:
        step = min(length, width - length)
        keys = ranks[:-step] * (len(words) + 1) + ranks[step:]
        ranks = np.unique(keys, return_inverse=True)[1]
        length += step
        if length >= width // 2 and len(ranks) == (int(ranks.max()) + 1 if len(ranks) else 0):
            return 0
    counts = np.bincount(ranks)
    starts = np.flatnonzero(counts[ranks] > 1)
    if not len(starts):
        return 0
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return int((np.cumsum(change)[:-1] > 0).sum())


def text_features(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word), n_shouted (words of capitals)."""
    if not text:
        return (0,) * len(FEATURES)
    raw = text.encode()
    words = raw.split()
    blanks = len(raw) - len(raw.translate(None, SPACE))
    lines = [line for line in raw.split(b"\n") if line.strip(SPACE)]
    return (
        len(words), len(text) - blanks, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), len(_SHOUT.findall(raw)),
    )


def add_features(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and the features of the text, which is a column or a field of the column row."""
    schema = rows.select(*keep).schema
    for name, kind in FEATURES.items():
        schema = schema.add(name, kind)
    nested = "text" not in rows.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = part.column("row").field("text") if nested else part.column("text")
                features = list(zip(*map(text_features, texts.to_pylist())))
                columns = [pa.array(f, pa.int64()) for f in features]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *columns], names=[*keep, *FEATURES])
        give_back()

    return rows.select(*keep, *([] if nested else ["text"])).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def scores() -> dict[str, Column]:
    """Each between 0 and 1, higher for worse texts."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "symbols": F.least(F.col("n_symbols") / words, F.lit(1.0)),
        "duplicate_lines": F.col("n_dup_lines") / lines,
        "repeated_words": F.col("n_repeat_words") / words,
        "shouted": F.least(F.col("n_shouted") / words, F.lit(1.0)),
    }


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ B(n, p), term by term from the largest."""
    if k >= n:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    term, total = 1.0, 0.0
    for i in range(k, -1, -1):
        total += term
        if term < total * 1e-17:
            break
        term *= i * (1 - p) / ((n - i + 1) * p)
    if k > n * p:  # the terms grow first; sum them relative to the term at k all the same
        return min(1.0, math.exp(log) * total) if log > -700 else 0.0
    return min(1.0, math.exp(log + math.log(total)))


def pick_cutoffs(counts: Iterable[tuple[str, str, float, int, int, int]], tests: int, alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[str, str], float]:
    """From (stratum, score, cutoff, good, good above, bad above): a certified cutoff by stratum and score; tests: strata times scores."""
    best: dict[tuple[str, str], tuple] = {}
    failed: set[tuple[str, str]] = set()
    for stratum, score, cutoff, good, above, bad_above in sorted(counts, key=lambda c: -c[2]):
        key = (stratum, score)
        if key in failed or tail(above, good, alpha) > delta / tests:
            failed.add(key)
        elif bad_above > above:
            choice = (bad_above, -above, cutoff)
            best[key] = max(best.get(key, choice), choice)
    return {k: v[2] for k, v in best.items()}


def name_of(stratum: str) -> Column:
    """The stratum's value behind a sign of its own; nothing for null."""
    return F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit(""))


def fit(featured: DataFrame, labels: DataFrame, stratum: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Cutoffs from the labelled rows of ``featured``: at_stratum, and the cutoff of each score or null; only strata with a cutoff."""
    good = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("good"))
    named = scores()
    holdout = (
        featured.filter(~base_failed())
        .select("doc_id", name_of(stratum).alias("stratum"), *(c.alias(n) for n, c in named.items()))
        .join(good, "doc_id")
    )
    # a score is above grid points 0 .. n - 1 for one n, so counts by n give the counts above each point
    levels = [reduce(lambda a, b: a + b, [(F.col(n) > g).cast("int") for g in GRID]).alias(n) for n in named]
    long = holdout.select("stratum", "good", F.explode(F.array(*(F.struct(F.lit(n).alias("score"), c.alias("level")) for n, c in zip(named, levels)))).alias("s"))
    rows = store(long.select("stratum", "good", "s.*").groupBy("stratum", "score", "level").agg(F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("good") != 1).alias("bad")), "levels")
    tests = max(1, rows.select("stratum", "score").distinct().count())

    names = list(named)

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        counts = []
        for (at, score), levels_of in group.groupby(["stratum", "score"]):
            table = np.zeros((2, len(GRID) + 1), dtype=np.int64)
            table[:, levels_of["level"].to_numpy()] = levels_of[["good", "bad"]].to_numpy().T
            above = table[:, ::-1].cumsum(axis=1)[:, ::-1]
            counts.extend((at, score, GRID[g], int(above[0, 0]), int(above[0, g + 1]), int(above[1, g + 1])) for g in range(len(GRID)))
        best = pick_cutoffs(counts, tests, alpha / len(names), delta)
        found = [(at, *(best.get((at, n)) for n in names)) for at in sorted({at for at, _ in best})]
        return pd.DataFrame(found, columns=["at_stratum", *map(cutoff_of, names)])

    # a group has one row for each score and grid point at most
    return store(rows.groupBy("stratum").applyInPandas(pick, ", ".join(["at_stratum string", *(f"{cutoff_of(n)} double" for n in names)])), "cutoffs")


def cutoff_of(score: str) -> str:
    return f"cutoff_{score}"


def with_verdict(featured: DataFrame, cutoffs: DataFrame, stratum: str, name: str) -> DataFrame:
    """With ``name``: true for rows that neither the base rule nor a cutoff of their stratum rejects."""
    at = name_of(stratum)
    above = reduce(lambda a, b: a | b, [F.coalesce(c > F.col(cutoff_of(n)), F.lit(False)) for n, c in scores().items()])
    return featured.join(F.broadcast(cutoffs), at == F.col("at_stratum"), "left").withColumn(name, ~base_failed() & ~above).drop(*cutoffs.columns)


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, features, base_failed and kept of every document."""
    featured = store(add_features(docs, "doc_id", stratum), "features")
    cutoffs = fit(featured, labels, stratum, alpha, delta)
    return with_verdict(featured, cutoffs, stratum, "kept").select("doc_id", *FEATURES, base_failed().alias("base_failed"), "kept")


def keep(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The documents kept, with all their columns."""
    measured = Stored(add_features(docs, "doc_id", stratum), "features")
    cutoffs = fit(measured.df, labels, stratum, alpha, delta)
    measured.drop()
    featured = add_features(docs.select(F.struct("*").alias("row")), "row")
    return with_verdict(featured, cutoffs, f"row.{stratum}", "kept").filter("kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return judge(read("documents"), read("labels")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The same in SQL.
ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT doc_id, unnest(range(1, len(ws) - {WINDOW - 2})) AS i, ws FROM t),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY doc_id),
f AS (SELECT l.doc_id, stratum, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(t, '[A-Z]{{2,}}')) AS n_shouted FROM l LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed, greatest(n_words, 1)::DOUBLE AS w FROM f),
s AS (SELECT doc_id, stratum, base_failed, unnest(['symbols', 'duplicate_lines', 'repeated_words', 'shouted']) AS score,
  unnest([least(n_symbols / w, 1.0::DOUBLE), n_dup_lines / greatest(n_lines, 1)::DOUBLE, n_repeat_words / w, least(n_shouted / w, 1.0::DOUBLE)]) AS x FROM b),
h AS (SELECT s.*, g.good FROM s JOIN (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) g USING (doc_id) WHERE NOT base_failed),
c AS (SELECT stratum, score, cutoff, count(*) FILTER (good = 1) AS n, count(*) FILTER (good = 1 AND x > cutoff) AS above, count(*) FILTER (good <> 1 AND x > cutoff) AS bad FROM h, (SELECT unnest([{", ".join(f"{g!r}::DOUBLE" for g in map(float, GRID))}]) AS cutoff) GROUP BY ALL),
certain AS (SELECT *, CASE WHEN above >= n THEN 1.0 ELSE list_sum(list_transform(range(0, above + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA} / 4) + (n - i) * ln(1 - {ALPHA} / 4)))) END
  <= {DELTA} / (SELECT count(DISTINCT (stratum, score)) FROM h) AS ok FROM c),
best AS (SELECT stratum, score, arg_max(cutoff, (bad, -above, cutoff)) AS cutoff FROM certain WHERE ok AND bad > above GROUP BY ALL),
rejected AS (SELECT DISTINCT s.doc_id FROM s JOIN best ON s.stratum = best.stratum AND s.score = best.score AND s.x > best.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept FROM b
"""
