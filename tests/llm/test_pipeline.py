"""The pipeline's stages on the smallest tables."""

import sys
from pathlib import Path

import corpus_pipeline
from gridloom.llm.common import materialize
from gridloom.llm.tokens import Encoder, path_of

sys.path.insert(0, str(Path(__file__).parent))
from brute import WORD, lower_az  # noqa: E402


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    counts, texts = [docs.count()], {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "t")
        counts.append(docs.count())
        texts[name] = docs
        if name != "packing":
            assert docs.columns == columns
    assert counts[1] < counts[0] and counts[2] <= counts[1] and counts[3] <= counts[2] and counts[4] >= counts[3]
    exact = texts["exact dedup"].collect()
    assert len({r["text"].lower() for r in exact}) == len(exact)
    mixed = texts["mixing"].collect()
    assert {r["doc_id"] for r in mixed} == {r["doc_id"] for r in texts["near dedup"].collect()}
    e = Encoder(path_of("byte_bpe_50k.json"))
    assert texts["packing"].agg({"length": "sum"}).first()[0] == sum(len(e.whole(r["text"])) // 4 + 1 for r in mixed)


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "t")
    assert docs.count() == 0


def test_near_stage_takes_five_words(spark, sf_dir):
    words = [f"w{i}" for i in range(60)]
    edited = [w if i not in (12, 30, 48) else f"e{i}" for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(words[:-1] + ["end"])), (4, "a b c"), (5, "A b c"), (6, ""), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    many = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for table in (docs, many):
        sets = {}
        for r in table.collect():
            w = WORD.findall(lower_az(r["text"] or ""))
            sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        group = {i: i for i in sets}
        for a in sorted(sets):
            for b in sorted(sets):
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    x, y = sorted((group[a], group[b]))
                    group = {i: x if g == y else g for i, g in group.items()}
        assert {r["doc_id"] for r in corpus_pipeline.near(spark, table, sf_dir).collect()} == {i for i, g in group.items() if i == g}


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls, blank and long texts, repeated rows and clashing names; every stage gives the columns of its input."""
    words = lambda n, k: " ".join(f"{a}{b}" for a in ("alpha", "beta", "gamma", "delta")[: 1 + k % 4] for b in range(n))
    rows = [(i, words(60, i), "xx", f"s{i % 2}", "k") for i in range(6)] + [(7, words(60, 1), None, None, None), (7, words(60, 1), None, None, None), (None, words(70, 2), "xx", "s0", "k"), (8, None, "xx", "s0", "k"), (9, "", None, None, None), (None, None, None, None, None), (10, words(9_000, 3), "xx", "s1", "k")]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string").selectExpr("*", "kept AS __gl_copies", "doc_id AS n_tokens", "kept AS fp", "source AS block", "doc_id AS __gl_file", "kept AS __gl_kept", "kept AS __gl_stats"), "odd")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        one = out.collect()
        if name == "packing":
            assert sum(r["length"] for r in one) == sum(len(Encoder(path_of("byte_bpe_50k.json")).whole(r["text"] or "")) // 4 + 1 for r in docs.collect())
        else:
            assert out.columns == docs.columns, name
        if name == "exact dedup":
            assert len(one) == len({lower_az(r["text"] or "") for r in docs.collect()})
        if name == "mixing":
            assert {repr(r) for r in one} == {repr(r) for r in docs.collect()}
        if name == "quality rules":
            assert not [r for r in one if not (r["text"] or "").strip()]
