"""Temperature mixing of sources.

The token shares of the sources are raised to an exponent between 0 and 1 and normalised. The exponent is
bisected: it is the smallest one (the flattest mixture) whose largest number of passes over a source is
within the repetition limit, or the largest one whose mixture has at least a target entropy. The budget
is given in tokens, or is the least with which no source is read less than once, so nothing is lost.

A source's weighted budget is realised as whole passes and a part of one more. For every pass the blocks of a
source are put in a seeded random order, and documents within blocks too; the part is the beginning of
that order, cut where its tokens reach the rest of the budget. ``place``, from 0 to below 1, spreads each
source evenly over the run: pass after pass, a part of a pass over its share of the run, whole blocks in an order
drawn for the pass, each over an equal stretch, and documents of a block in an order of their own. ``in_order`` writes the run in this order.

Tokens are those of a column given, or words, runs of characters other than blank and 09-0D. The mixture depends only on how many
sources have each number of tokens, and that table comes to the driver: T tokens make fewer than
sqrt(2 T) + 1 different numbers. The ``MOST_SOURCES`` sources with most rows go to every task and are cut by histograms;
all others are joined and cut by source in a shuffle, with the same result.

Defined cases: null sources are one source; null or empty texts (and null counts) have no token and are kept in whole passes;
texts of any length are counted whole; rows that repeat are read like any other, and rows with equal or null doc_ids of a
source share their place; a source without tokens is read once; an empty table gives no row. ``mix`` keeps all columns of
the input and adds to them; a column of an added one's name is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shared import Stored
from .cuts import KEY_BITS, weighted_cuts

MOST_SOURCES = 20_000
BLOCK_TOKENS = 1_000_000
REPEATS = 1.5
SEED = 17
#: Primes above any number of blocks.
STEPS = (998_244_353, 999_999_937, 1_000_000_007, 1_000_000_009)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def weights(tokens: dict[int, int], exponent: float, alike: dict[int, int] | None = None) -> dict[int, float]:
    """The weight of each source; alike: how many sources an entry of tokens stands for (default: one)."""
    number = alike or dict.fromkeys(tokens, 1)
    total = sum(n * number[s] for s, n in tokens.items())
    raised = {s: (n / total) ** exponent for s, n in tokens.items()}
    whole = sum(w * number[s] for s, w in raised.items())
    return {s: w / whole for s, w in raised.items()}


def entropy(mixture: dict[int, float], alike: dict[int, int] | None = None) -> float:
    return -sum(w * math.log(w) * (alike[s] if alike else 1) for s, w in mixture.items() if w > 0)


def passes(tokens: dict[int, int], exponent: float, budget: float | None, alike: dict[int, int] | None = None) -> dict[int, float]:
    """Times that each source is read."""
    mixture = weights(tokens, exponent, alike)
    budget = budget or max(n / mixture[s] for s, n in tokens.items())
    return {s: budget * mixture[s] / n for s, n in tokens.items()}


def fit_exponent(tokens: dict[int, int], repeats: float | None = REPEATS, target_entropy: float | None = None, budget: float | None = None, alike: dict[int, int] | None = None) -> float:
    """The exponent, by 60 halvings; 1 if even the sources' own shares exceed the limit."""
    if target_entropy is not None:
        ok = lambda t: entropy(weights(tokens, 1 - t, alike), alike) >= target_entropy
        if ok(0.0):
            return 1.0
        low, high = 0.0, 1.0  # high reaches the target, as far as any mixture does
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (low, middle) if ok(middle) else (middle, high)
        return 1 - high
    fits = lambda t: max(passes(tokens, t, budget, alike).values()) <= repeats * (1 + 1e-12)
    if fits(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


def mix(docs: DataFrame, source: str = "source", repeats: float | None = REPEATS, target_entropy: float | None = None, budget: float | None = None, seed: int = SEED, added: bool = True, tokens_in: str | None = None) -> DataFrame:
    """Every document as often as its source is read; added: with n_tokens, epoch, block and place; tokens_in: the column with numbers of tokens."""
    spark = docs.sparkSession
    size = words(F.col("row.text")) if tokens_in is None else F.coalesce(F.col(f"row.{tokens_in}"), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    name = F.col(f"row.{source}").cast("string")
    counted = Stored(rows.select(name.alias("source"), F.xxhash64("row.doc_id", F.lit(seed)).alias("hash"), size.alias("tokens")), "tokens")
    totals = Stored(counted.df.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "totals")
    alike = {r.tokens: r.n for r in totals.df.groupBy("tokens").agg(F.count("*").alias("n")).collect()}
    tokens = {t: t for t in alike if t}
    times = passes(tokens, fit_exponent(tokens, repeats, target_entropy, budget, alike), budget, alike) if tokens else {}
    spec = [(t, max(1, -(-t // BLOCK_TOKENS)), *_realised(times.get(t, 1.0), t), times.get(t, 1.0)) for t in alike]
    # one row for each number of tokens
    by_tokens = F.broadcast(spark.createDataFrame(spec, "tokens long, blocks long, whole int, rest long, times double"))
    named = totals.df.orderBy(F.desc("rows"), "source").limit(MOST_SOURCES).join(by_tokens, "tokens").collect()
    names = F.broadcast(spark.createDataFrame([(n, r.source, r.blocks) for n, r in enumerate(named)], "node long, name string, blocks long"))

    def keyed(df: DataFrame, at: Column, hashed: Column) -> DataFrame:
        """With block and key: the block's place in the order of the last pass, then the document's within it."""
        block = F.pmod(hashed, F.col("blocks"))
        key = F.shiftleft(F.pmod(F.xxhash64(at, block, F.lit(seed + 1)), F.lit(1 << 30)), KEY_BITS - 30).bitwiseOR(F.pmod(F.xxhash64(hashed, F.lit(seed + 2)), F.lit(1 << (KEY_BITS - 30))))
        return df.withColumn("block", block).withColumn("key", key)

    def at_source(df: DataFrame, at: Column, plan: DataFrame, how: str = "inner") -> DataFrame:
        return df.join(plan, at.eqNullSafe(F.col("name")), how).drop("name")

    targets = {n: r.rest for n, r in enumerate(named) if r.rest > 0}
    own, hashed = F.col("source"), F.xxhash64("row.doc_id", F.lit(seed))
    items = keyed(at_source(counted.df, own, names), own, F.col("hash")).select("node", "key", F.col("tokens").alias("weight"))
    cuts = weighted_cuts(items, targets) if targets else {}
    plan = F.broadcast(spark.createDataFrame([(r.source, r.blocks, r.whole, cuts.get(n, 0), r.times) for n, r in enumerate(named)], "name string, blocks long, whole int, cut long, times double"))
    out = at_source(rows, name, plan)
    if sum(alike.values()) > len(named):
        # each of these has at most one row in MOST_SOURCES
        others = at_source(totals.df, own, names.select("name"), "left_anti").join(by_tokens, "tokens").select(own.alias("name"), "blocks", "whole", "rest", "times")
        partly = keyed(at_source(counted.df, own, others.filter("rest > 0").hint("shuffle_hash")), own, F.col("hash"))
        read = F.sum("tokens").over(Window.partitionBy("source").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        beyond = partly.withColumn("read", read).filter("read > rest").groupBy(own.alias("cut_name")).agg(F.min("key").alias("cut"))
        cut = F.when(F.col("rest") > 0, F.coalesce("cut", F.lit(1 << KEY_BITS))).otherwise(0)
        others = Stored(others.join(beyond, F.col("name").eqNullSafe(F.col("cut_name")), "left").select("name", "blocks", "whole", cut.alias("cut"), "times"), "others")
        out = out.union(at_source(at_source(rows, name, names.select("name"), "left_anti"), name, others.df.hint("shuffle_hash")))
    counted.drop()
    totals.drop()
    out = keyed(out, name, hashed)
    reads = F.col("whole") + (F.col("key") < F.col("cut")).cast("int")
    out = out.filter(reads > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), reads - 1)))
    # a whole pass takes its share of the run, the last part of one its own; blocks take equal stretches of a pass, in an
    # order of steps by a prime from a start, both drawn for the pass
    drawn, bits = F.pmod(F.xxhash64(name, "epoch", F.lit(seed + 3)), F.lit(1 << 30)), 1 << 40
    step = F.element_at(F.array(*map(F.lit, STEPS)), (drawn % len(STEPS) + 1).cast("int"))
    rank = F.pmod(F.col("block") * step + drawn, F.col("blocks"))
    u = (rank + F.pmod(F.xxhash64(hashed, "epoch", F.lit(seed + 4)), F.lit(bits)) / float(bits)) / F.col("blocks")
    share = F.when(F.col("epoch") < F.col("whole"), 1.0).otherwise(F.greatest(F.col("times") - F.col("whole"), F.lit(0.0)))
    place = (F.col("epoch") + share * u) / F.greatest("times", F.col("epoch") + share)
    clash = {"n_tokens", "epoch", "block", "place"}
    if not added:
        return out.select("row", place.alias("place"))
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in clash]
    return out.select(*kept, size.alias("n_tokens"), "epoch", "block", place.alias("place"))


def in_order(docs: DataFrame, **limits) -> DataFrame:
    """The run in the order of places, with the columns of docs alone; places are spread evenly, so partitions are stretches of equal length."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = mix(docs, added=False, **limits)
    dealt = run.repartitionById(parts, F.least(F.floor(F.col("place") * parts), F.lit(parts - 1)).cast("int"))
    return dealt.sortWithinPartitions("place").select("row.*")


def _realised(times: float, tokens: int) -> tuple[int, int]:
    """Whole passes, and tokens of a further one."""
    whole = int(times + 1e-9)
    return whole, max(0, int((times - whole) * tokens + 1e-6))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")).drop("text")
