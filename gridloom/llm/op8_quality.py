"""Quality rules: decision lists learned by sequential covering, emitted as ordered Spark conditional expressions.

Statistics of whole texts are counted per row. A bounded sample of labelled rows (`sample_rows` per class, chosen by a hash of the id)
gives the training table. Sequential covering grows a conjunction of thresholds with the best information gain on two thirds of the
rows, prunes its tail on the other third, keeps it while it is precise enough there, removes what it covers and goes on. The list
becomes `CASE WHEN cond AND cond THEN verdict ... ELSE default END` over the statistics.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import WordIds, plain_names

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"
CONTINUATION = bytes(range(0x80, 0xC0))
ASCII_UPPER, ASCII_LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_distinct", "n_bytes"]
STATS = BASE + MORE
STATS_SCHEMA = ", ".join(f"{c} long" for c in STATS)


def statistics(text: bytes, ids: WordIds) -> tuple[int, ...]:
    """STATS of one text in UTF-8; words are runs of anything but ASCII white space."""
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * len(STATS)
    codes = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    kinds = len(set(words)) if n < 4096 else len(np.unique(codes))
    repeat = 0
    if n >= 4:
        if len(ids) < 1 << 21:
            grams = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
        else:  # exact for any vocabulary: number the pairs first
            pairs = np.unique(codes[:-1] * len(ids) + codes[1:], return_inverse=True)[1].astype(np.int64)
            grams = pairs[:-1] * len(ids) + codes[2:]
        order = np.argsort(grams)
        s = grams[order]
        same = s[1:] == s[:-1]
        if same.any():
            often = np.zeros(n - 2, bool)
            often[order[1:][same]] = True
            often[order[:-1][same]] = True
            cover = np.zeros(n, bool)
            cover[:-2] |= often
            cover[1:-1] |= often
            cover[2:] |= often
            repeat = int(cover.sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    solid = text.translate(None, SPACE)
    chars = len(solid.translate(None, CONTINUATION))
    plain = solid.translate(None, ASCII_LOWER)
    upper = len(plain) - len(plain := plain.translate(None, ASCII_UPPER))
    digits = len(plain) - len(plain := plain.translate(None, DIGITS))
    other = len(plain.translate(None, bytes(range(0x80, 0x100))))  # ASCII marks
    return (n, chars, len(solid) - len(solid.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat, len(lines), upper, chars - digits - other, digits, other, kinds, len(text))


def _count(texts: list[bytes | None]) -> list[tuple[int, ...]]:
    ids, out = WordIds(), []
    for x in texts:
        if len(ids) > 400_000:
            ids = WordIds()
        out.append(statistics(x or b"", ids))
    return out


def add_statistics(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of df (default: all) with STATS of the text column as one struct, __gl_stats (null text: all 0)."""
    keep = df.columns if keep is None else keep
    kind = pa.struct([(c, pa.int64()) for c in STATS])
    schema = df.select(*keep).withColumn("__gl_stats", F.lit(None).cast(f"struct<{', '.join(f'{c}:bigint' for c in STATS)}>")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array(_count(b.column(text).cast(pa.binary()).to_pylist()), np.int64).reshape(b.num_rows, len(STATS))
            stats = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(got[:, i])) for i in range(len(STATS))], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), stats], names=[*keep, "__gl_stats"])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(work, schema)


#: Interpretable ratios over the statistics: name -> (numerator, denominator or None).
FEATURES = {
    "words": ("n_words", None),
    "symbols per word": ("n_symbols", "n_words"),
    "share of repeated lines": ("n_dup_lines", "n_lines"),
    "share of words in repeated windows": ("n_repeat_words", "n_words"),
    "characters per word": ("word_chars", "n_words"),
    "share of capitals": ("n_upper", "n_letters"),
    "share of digits": ("n_digits", "word_chars"),
    "marks per word": ("n_marks", "n_words"),
    "share of distinct words": ("n_distinct", "n_words"),
    "words per line": ("n_words", "n_lines"),
}


def feature_table(stats: np.ndarray) -> np.ndarray:
    """One column per FEATURES from rows of STATS, as the Spark expressions compute them (x / 0 counts as 0)."""
    at = {c: stats[:, i].astype(float) for i, c in enumerate(STATS)}
    return np.stack([at[a] if b is None else np.divide(at[a], at[b], out=np.zeros(len(stats)), where=at[b] > 0) for a, b in FEATURES.values()], 1)


def feature_column(name: str, of: str = "__gl_stats") -> Column:
    a, b = FEATURES[name]
    x = F.col(f"{of}.{a}").cast("double")
    return x if b is None else F.when(F.col(f"{of}.{b}") > 0, x / F.col(f"{of}.{b}")).otherwise(F.lit(0.0))


Rule = list[tuple[int, bool, float]]  # feature number, True for >=, threshold


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, ge, t in rule:
        hit &= (x[:, f] >= t) if ge else (x[:, f] < t)
    return hit


def learn(x: np.ndarray, bad: np.ndarray, precision: float = 0.9, most_rules: int = 24, most_terms: int = 4, cuts: int = 48, least: int = 3) -> list[Rule]:
    """Ordered rules for bad rows. Ties take the first feature and threshold in order, so equal tables give equal lists."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    third = np.arange(len(x)) % 3 == 2
    while len(rules) < most_rules and (left & bad).sum() >= least:
        grow, prune = left & ~third, left & third
        gx, gb = x[grow], bad[grow]
        inside, rule = np.ones(len(gx), bool), []
        while len(rule) < most_terms and (p0 := int((inside & gb).sum())) and (inside & ~gb).any():
            base, best = math.log2(p0 / inside.sum()), (1e-9, None)
            for f in range(x.shape[1]):
                v = gx[inside, f]
                for t in np.unique(np.quantile(v, np.linspace(0, 1, cuts), method="nearest")):
                    up = gx[:, f] >= t
                    for ge in (True, False):
                        h = inside & (up if ge else ~up)
                        p, n = int((h & gb).sum()), int((h & ~gb).sum())
                        if p >= least and (gain := p * (math.log2(p / (p + n)) - base)) > best[0]:
                            best = (gain, (f, ge, float(t)))
            if best[1] is None:
                break
            rule.append(best[1])
            inside = covers(rule, gx)
        if not rule:
            break

        def worth(r: Rule) -> float:
            h = covers(r, x[prune])
            p, n = int((h & bad[prune]).sum()), int((h & ~bad[prune]).sum())
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[: k + 1] for k in range(len(rule))), key=lambda r: (worth(r), len(r)))
        hit = covers(rule, x) & left
        if (hit & bad).sum() < least or (hit & bad).sum() < precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def rule_expression(rules: list[Rule], of: str = "__gl_stats") -> Column:
    """0 where no rule holds, else the number of the first that does, as one ordered CASE WHEN."""
    names, case = list(FEATURES), None
    for k, rule in enumerate(rules, 1):
        hit = F.lit(True)
        for f, ge, t in rule:
            c = feature_column(names[f], of)
            hit = hit & ((c >= F.lit(t)) if ge else (c < F.lit(t)))
        case = F.when(hit, F.lit(k)) if case is None else case.when(hit, F.lit(k))
    return F.lit(0) if case is None else case.otherwise(F.lit(0))


def rule_text(rules: list[Rule]) -> list[str]:
    names = list(FEATURES)
    return [" and ".join(f"{names[f]} {'>=' if ge else '<'} {t:.6g}" for f, ge, t in r) for r in rules]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 2000, text: str = "text", precision: float = 0.9) -> list[Rule]:
    """Rules from at most `sample_rows` labelled rows of each class (quality 0 and 1), those of the smallest hash of doc_id.

    Labels that are null, or whose doc_id is missing from docs or null, don't count; of rows that repeat a doc_id the least text counts, once for each
    of its labels. With no bad or no good row there are no rules.
    """
    marks = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)).alias("h")).distinct()
    counts = {r[0]: r[1] for r in marks.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return []
    chosen = []
    for q, n in sorted(counts.items()):
        share = min(1.0, 1.5 * sample_rows / n + 50 / n)
        chosen += [(r[0], q) for r in marks.filter((F.col("quality") == q) & (F.col("h") <= share * (1 << 20))).orderBy("h", "doc_id").limit(sample_rows).select("doc_id").collect()]
    wanted = docs.sparkSession.createDataFrame(chosen, "doc_id long, quality int").dropDuplicates()
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # at most 2 * sample_rows ids
    got = add_statistics(rows, keep=["doc_id", "quality"]).select("doc_id", "quality", "__gl_stats.*").toPandas().sort_values(["doc_id", "quality", *STATS], kind="stable")
    if not len(got):
        return []
    stats, bad = got[STATS].to_numpy(np.int64), got["quality"].to_numpy() == 0
    order = np.argsort([hash_of(i) for i in got["doc_id"]], kind="stable")  # ids may tell the makers' order
    clear = ~base_failed(stats[order])
    return learn(feature_table(stats[order][clear]), bad[order][clear], precision)


def hash_of(i: int) -> int:
    x = (int(i) * 0x9E3779B97F4A7C15) & (2**64 - 1)
    return (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & (2**64 - 1)


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < 50) | (100 * stats[:, 4] > 50 * stats[:, 0])


def judge(docs: DataFrame, rules: list[Rule], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (default: all) with __gl_stats, __gl_base_failed, __gl_rule (0: none) and __gl_kept; one row per row, in place."""
    s = add_statistics(docs, text, keep)
    failed = (F.col("__gl_stats.n_words") < 50) | (100 * F.col("__gl_stats.n_repeat_words") > 50 * F.col("__gl_stats.n_words"))
    s = s.withColumn("__gl_base_failed", failed).withColumn("__gl_rule", rule_expression(rules))
    return s.withColumn("__gl_kept", ~F.col("__gl_base_failed") & (F.col("__gl_rule") == 0))


def op8_decision_lists(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, rules, keep=["doc_id"]).select("doc_id", *(F.col(f"__gl_stats.{c}").alias(c) for c in BASE), F.col("__gl_base_failed").alias("base_failed"), F.col("__gl_kept").alias("kept"), F.col("__gl_rule").alias("rule"))


def filter_quality(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """Only the rows of docs that pass, with their own columns."""
    plain = plain_names(docs)
    return judge(plain, fit(docs, labels, text=text), f"c{docs.columns.index(text)}").filter("__gl_kept").select(*plain.columns).toDF(*docs.columns)
