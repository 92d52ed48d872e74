"""Mixing sources to target weights by temperature; DataFrame functions but for the count of words.

Source shares s_i of all tokens become weights w_i ~ s_i ** alpha. alpha is bisected: the largest that reaches a target entropy, and the
least that keeps every source's epochs within a repetition limit; the larger of the two wins. All that the search needs of an alpha are two sums over
the sources, so it looks at many alphas in one aggregate and narrows the interval 64-fold a round; the driver sees these sums and never the sources.
With a token budget every source then gets w_i * budget / T_i epochs. Whole epochs give whole copies. The rest of an epoch is a prefix of a block
permutation: a source's documents fall into hash blocks of bounded size, blocks are put in hash order, those inside the token budget are drawn whole, and
inside the one block that crosses it documents are drawn in hash order. The crossing block is found by bins of that order first, then inside one bin, so
a window sees at most BINS bins of a source, one bin's blocks, or one block's documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import FILE, ROW, attach, materialize, plain_names, stored, with_address

BIN_BITS = 12
BINS = 1 << BIN_BITS
Budget = int | float | str | None


@dataclass(frozen=True)
class Shares:
    """What the search needs of the sources that have tokens: their number, all tokens, the least and the greatest share, and sums over shares.

    sums(alphas) gives for each alpha sum(s ** alpha) and sum(s ** alpha * ln(s)).
    """

    sources: int
    total: int
    least: float
    greatest: float
    sums: Callable[[list[float]], list[tuple[float, float]]]

    def budget_tokens(self, budget: Budget, alpha: float, z: float) -> float:
        """budget in tokens (int), as a multiple of all there are (float), None: all, "whole": the least with which no source loses anything."""
        if budget == "whole":
            return self.total * z * self.greatest ** (1 - alpha)
        return self.total * budget if isinstance(budget, float) else self.total if budget is None else budget

    def most_epochs(self, budget: Budget, alpha: float, z: float) -> float:
        """Epochs of the smallest source: the most, as alpha is at most 1."""
        return self.budget_tokens(budget, alpha, z) / self.total * self.least ** (alpha - 1) / z


def shares_of(tokens: dict[str, int]) -> Shares:
    live = np.array([t for t in tokens.values() if t > 0], float)
    if not len(live):
        return Shares(0, 0, 0.0, 0.0, lambda alphas: [(0.0, 0.0)] * len(alphas))
    s = np.sort(live / live.sum())
    return Shares(len(live), int(live.sum()), float(s[0]), float(s[-1]), lambda alphas: [(float((s**a).sum()), float((s**a * np.log(s)).sum())) for a in alphas])


def shares_table(tokens: DataFrame) -> Shares:
    """tokens: stored, with `tokens` of every source. Two small aggregates now, and one a round of the search."""
    live = tokens.filter("tokens > 0")
    n, total, least, greatest = live.agg(F.count(F.lit(1)), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not n:
        return shares_of({})
    s = F.col("tokens") / F.lit(float(total))

    def sums(alphas: list[float]) -> list[tuple[float, float]]:
        each = live.select(s.alias("s"), F.posexplode(F.array(*map(F.lit, alphas))).alias("i", "a")).withColumn("p", F.pow("s", "a"))
        got = {r["i"]: (r["z"], r["m"]) for r in each.groupBy("i").agg(F.sum("p").alias("z"), F.sum(F.col("p") * F.log("s")).alias("m")).collect()}  # one row an alpha
        return [got[i] for i in range(len(alphas))]

    return Shares(n, int(total), least / total, greatest / total, sums)


def narrow(shares: Shares, holds: Callable[[float, float, float], bool], lo: float, rounds: int = 6, cuts: int = 63) -> tuple[float, float]:
    """Neighbouring alphas in lo .. 1 where holds(alpha, z, m), true from some alpha on or up to it, changes; both ends the same if it never does."""
    hi = 1.0
    (z0, m0), (z1, m1) = shares.sums([lo, hi])
    first = holds(lo, z0, m0)
    if first == holds(hi, z1, m1):
        return (hi, hi) if first else (lo, lo)
    for _ in range(rounds):
        grid = [lo + (hi - lo) * i / (cuts + 1) for i in range(1, cuts + 1)]
        same = [holds(a, z, m) == first for a, (z, m) in zip(grid, shares.sums(grid))]
        k = same.index(False) if False in same else cuts
        lo, hi = (grid[k - 1] if k else lo), (grid[k] if k < cuts else hi)
    return lo, hi


def find_alpha(shares: Shares, entropy_share: float | None = None, most_epochs: float | None = None, budget: Budget = None) -> float:
    """alpha in 0 .. 1: entropy of at least entropy_share * log(sources) if any alpha gives that, and at most most_epochs copies of each source.

    Where both are asked for and contradict each other, the repetition limit holds. With a limit alone: the most even weights that it allows.
    """
    alpha = 1.0
    if entropy_share is not None and shares.sources > 1:
        want = entropy_share * math.log(shares.sources) * (1 - 1e-12)
        even = lambda a, z, m: math.log(z) - a * m / z >= want  # noqa: E731  # falls with alpha
        alpha = narrow(shares, even, 0.0)[0]
    elif most_epochs is not None:
        alpha = 0.0
    if most_epochs is not None and shares.sources:
        fits = lambda a, z, m: shares.most_epochs(budget, a, z) <= most_epochs * (1 + 1e-12)
        if not fits(alpha, *shares.sums([alpha])[0]):
            alpha = narrow(shares, fits, alpha)[1]
    return alpha


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = np.array([len((t or b"").split()) for t in b.column("text").cast(pa.binary()).to_pylist()], np.int64)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "name", "content", FILE, ROW)), pa.array(n)], names=["doc_id", "name", "content", FILE, ROW, "n_tokens"])


def mix(docs: DataFrame, entropy_share: float | None = None, most_epochs: float | None = None, budget: Budget = None, seed: int = 17, block_tokens: int = 1_000_000, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> tuple[DataFrame, float]:
    """One row per row of docs with its number of copies (0: not drawn), and alpha.

    Columns: doc_id, source, n_tokens (words), source_weight, source_epochs, copies, and the address (__gl_file, __gl_row). A null source is a source of its
    own; null and blank texts have no tokens and are drawn as often as their source's whole epochs say, and in the last, partial one if their
    block is. A source of blank texts only gets 0 copies unless the budget is "whole" (then 1). Rows that are equal in doc_id and text lie in one block. An
    empty table gives an empty result. budget: see Shares.budget_tokens.
    """
    rows = with_address(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source")))
    named = rows.select("doc_id", "text", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("name"), F.xxhash64("doc_id", "text").alias("content"), FILE, ROW)
    counted = materialize(named.mapInArrow(_words, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, name string, content long, {FILE} long, {ROW} long, n_tokens long"), "counted")
    tokens = materialize(counted.groupBy("name").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "source-tokens")
    shares = shares_table(tokens)
    alpha = find_alpha(shares, entropy_share, most_epochs, budget)
    z = shares.sums([alpha])[0][0]
    has, s = F.col("tokens") > 0, F.col("tokens") / F.lit(float(max(1, shares.total)))
    plan = tokens.withColumn("source_weight", F.when(has, F.pow(s, F.lit(alpha)) / F.lit(z)).otherwise(F.lit(0.0)))
    plan = plan.withColumn("source_epochs", F.when(has, F.col("source_weight") * F.lit(float(shares.budget_tokens(budget, alpha, z) if z else 0)) / F.col("tokens")).otherwise(F.lit(1.0 if budget == "whole" else 0.0)))
    plan = plan.withColumn("whole", F.floor(F.col("source_epochs") + F.lit(1e-9))).withColumn("rest", F.greatest(F.lit(0.0), (F.col("source_epochs") - F.col("whole")) * F.col("tokens")))
    plan = materialize(plan.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("long")), "mixing-plan")
    few = plan.limit(10_001).count() <= 10_000  # sources of at most 10,000 are broadcast; of more the large ones, and the rest meets by shuffle
    per_source = lambda df, table: df.join(F.broadcast(table), "name", "left") if few else attach(df, table.withColumn("rows", F.greatest("rows", F.lit(2).cast("long"))), "name", "rows", unique=F.xxhash64(FILE, ROW))
    drawn = per_source(counted, plan.drop("tokens")).drop("rows")
    drawn = drawn.withColumn("place", F.xxhash64(F.lit(seed), "content"))  # not by file: the same rows give the same draw wherever they lie
    drawn = drawn.withColumn("turn", _turn(seed, F.col("name"), F.pmod(F.xxhash64(F.lit(seed + 1), "place"), F.col("blocks"))))
    blocks = materialize(drawn.filter("rest > 0").groupBy("name", "turn").agg(F.sum("n_tokens").alias("tokens"), F.max("rest").alias("rest")), "blocks")
    before = lambda *order: F.coalesce(F.sum("tokens").over(Window.partitionBy("name").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    bins = blocks.groupBy("name", F.shiftright("turn", 63 - BIN_BITS).alias("bin")).agg(F.sum("tokens").alias("tokens"), F.max("rest").alias("rest")).withColumn("before", before("bin"))
    bins = bins.filter("before <= rest AND before + tokens > rest").select("name", "bin", F.col("before").alias("base"))
    inside = blocks.withColumn("bin", F.shiftright("turn", 63 - BIN_BITS)).join(bins, ["name", "bin"])
    edge_of = inside.withColumn("before", F.col("base") + before("turn")).filter("before <= rest AND before + tokens > rest").select("name", F.col("turn").alias("edge"), (F.col("rest") - F.col("before")).alias("room"))
    edges = materialize(plan.select("name", "rows").join(edge_of, "name"), "edges")
    drawn = per_source(drawn, edges).drop("rows")
    window = Window.partitionBy("name", "turn").orderBy("place", FILE, ROW).rowsBetween(Window.unboundedPreceding, -1)
    edge = drawn.filter("turn = edge").withColumn("before", F.coalesce(F.sum("n_tokens").over(window), F.lit(0).cast("long"))).filter("before + n_tokens / 2 <= room").select(FILE, ROW, F.lit(1).alias("edge_in"))
    out = drawn.join(edge, [FILE, ROW], "left")
    block_in = (F.col("rest") > 0) & (F.col("edge").isNull() | (F.col("turn") < F.col("edge")))
    out = out.select(
        "doc_id",
        F.when(F.col("name") != "n", F.expr("substring(name, 2)")).alias("source"),
        "n_tokens",
        "source_weight",
        "source_epochs",
        (F.col("whole") + F.when(block_in, 1).otherwise(F.coalesce("edge_in", F.lit(0)))).cast("long").alias("copies"),
        FILE,
        ROW,
    )
    return out, alpha


def _turn(seed: int, name: Column, block: Column) -> Column:
    """Place of a block in its source's permutation, 0 .. 2 ** 63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), name, block), 1)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """docs with every row as often as mix() says, with all their columns."""
    docs = stored(docs)
    copies = mix(docs, **how)[0].select(FILE, ROW, F.col("copies").alias("__gl_copies")).filter("__gl_copies != 1")
    plain = plain_names(docs)
    rows = with_address(plain).join(copies, [FILE, ROW], "left").withColumn("__gl_copies", F.coalesce("__gl_copies", F.lit(1).cast("long")))
    return rows.withColumn("__gl_copy", F.explode(F.array_repeat(F.lit(0), F.col("__gl_copies").cast("int")))).select(*plain.columns).toDF(*docs.columns)


def op6_temperature_mixing(spark, sf_dir: str) -> DataFrame:
    """One and a half times the tokens there are, over sources as even as a limit of 1.6 epochs allows: large ones fall short of 1.5, small ones reach 1.6."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), most_epochs=1.6, budget=1.5)[0].drop(FILE, ROW)
