"""The training-data operators on small tables: brute force, round trips, held-out accuracy, and odd inputs."""

import random
import sys
import zlib
from collections import Counter
from itertools import permutations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from gridloom.llm import op1_langid, op2_warc, op3_superminhash, op4_dac, op5_exact, op6_mixing, op7_packing, op8_quality, op9_chaining, op10_html  # noqa: E402
from gridloom.llm.common import scratch  # noqa: E402
from gridloom.llm.tokens import Encoder, path_of  # noqa: E402

WORDS = [a + b + c for a in "bdfgk" for b in "aeiou" for c in ("n", "rt", "l", "sh")]
#: Extra columns have names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, n_tokens string, kept string, block string"


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, l, s, None, "k", None, "x", "b") for i, t, l, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, blank and very long texts, ties, repeated rows, copies and near copies."""
    rnd = random.Random(7)
    base = [prose(rnd, 60) for _ in range(12)]
    rows = [(i, t, "xx", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(20, base[0].upper(), None, "s0"), (21, base[0], "xx", None), (21, base[0], "xx", None), (22, base[1] + " end", "xx", "s1")]
    w = base[2].split()
    rows += [(130 + k, " ".join(w[:k] + ["zz"] + w[k + 1 :]), "xx", "s2") for k in range(0, 60, 7)]  # a chain of near copies
    rows += [(40, None, "xx", "s0"), (41, "", None, None), (42, " \n\t ", "xx", "s1"), (43, "one", "xx", "s1"), (44, "ONE", "xx", "s1"), (None, "one", None, None), (None, None, None, None)]
    rows += [(50, prose(rnd, 30_000), "xx", "s0"), (51, "ÄÖ ÄÖ äö", "xx", "s0"), (52, "日本 é", "xx", "s0")]
    return rows


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def test_exact_groups(spark, odd, empty):
    got = op5_exact.exact_groups(table(spark, odd)).collect()
    groups = {}
    for i, t, *_ in odd:
        groups.setdefault(brute.lower_az(t or ""), []).append(i)
    want = Counter((i, max((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    assert op5_exact.exact_groups(empty).count() == 0
    least = op5_exact.exact_groups(table(spark, odd), keep="min").filter("text_sha256 = sha2('one', 256)").first()
    assert least["keep_id"] == 43
    kept = op5_exact.exact_dedup(table(spark, odd))
    assert kept.columns == table(spark, odd).columns and kept.count() == len(groups)


def test_tree_merge_rounds_and_weak_digests(spark, odd):
    assert [len(op5_exact.merge_rounds(n, 40, 4)) for n in (1, 4, 5, 64, 65)] == [1, 1, 2, 3, 4]
    assert op5_exact.merge_rounds(64, 40, 4) == [(16, 3), (4, 10), (1, 40)]
    rnd = random.Random(11)
    rows = [(rnd.randint(0, 400), rnd.choice(["a", "b", "ab c", "Ab C", "", None, "same length", "same lengtg"]) if i % 3 else "hot", "xx", "s") for i in range(600)]
    docs = table(spark, rows).repartition(23)
    want = {}
    for i, t, *_ in rows:
        want.setdefault(brute.lower_az(t or ""), []).append(i)
    want = Counter((i, max(g), len(g)) for g in want.values() for i in g)
    plan = op5_exact.exact_groups(docs, fan_in=3, task_rows=50)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in plan.collect()) == want
    weak = lambda t: op5_exact.F.encode(op5_exact.F.lpad(op5_exact.F.length(t).cast("string"), 8, "0"), "UTF-8")
    for how in ({}, {"fan_in": 2, "task_rows": 7}):
        got = op5_exact.exact_groups(docs, verify_texts=True, digest=weak, **how).collect()
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == want
    assert len(op5_exact.exact_groups(docs, digest=weak).select("keep_id").distinct().collect()) < len(want)


def test_hot_groups_are_attached_by_broadcast(spark):
    from gridloom.llm.common import attach, materialize

    rows = spark.range(1000).selectExpr("id", "IF(id % 3 = 0, 'hot', CAST(id DIV 2 AS STRING)) AS key")
    groups = materialize(rows.groupBy("key").count().withColumnRenamed("count", "n").selectExpr("key", "n", "key AS name"), "g")
    for hot in (100, 10_000):
        got = attach(rows, groups, "key", "n", hot=hot).collect()
        size = Counter(r["key"] for r in rows.collect())
        assert len(got) == 1000 and all(r["name"] == (r["key"] if size[r["key"]] > 1 else None) for r in got)


def test_near_groups_against_brute_force(spark, odd, empty):
    ids = Counter(i for i, *_ in odd)
    rows = [r for r in odd if r[0] is not None and ids[r[0]] == 1]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op3_superminhash.near_groups(table(spark, rows)).collect()}
    assert got == brute.near([(i, t) for i, t, *_ in rows])
    assert got[137] == got[130] and got[40] == (0, 40)
    all_rows = op3_superminhash.near_groups(table(spark, odd)).collect()
    assert len(all_rows) == len(odd)
    kept = op3_superminhash.near_dedup(table(spark, odd))
    assert kept.columns == table(spark, odd).columns
    blank = sum(not brute.shingle_set(t) for _, t, *_ in odd)
    assert kept.count() == blank + len({r["component_id"] for r in all_rows if r["n_shingles"]})
    assert op3_superminhash.near_groups(empty).count() == 0


def test_chains_of_links_without_a_common_hub(spark):
    """Neighbours of a chain are similar, its ends are not: the second round must find what the hub misses."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rows, order = [], list(range(30))
    rnd.shuffle(order)
    for k in range(30):
        rows.append((order[k], " ".join(words), "xx", "s"))
        for j in range(3):
            words[(k * 3 + j) * 2 % 200] = f"n{k}-{j}"
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op3_superminhash.near_groups(table(spark, rows)).collect()}
    assert got == brute.near([(i, t) for i, t, *_ in rows]) and len({c for _, c in got.values()}) == 1


def test_one_cluster_with_an_outside_hub_stays_linear(spark):
    from gridloom.llm.common import materialize

    F = op3_superminhash.F
    n, name = 100_000, lambda c: F.encode(c.cast("string"), "UTF-8")
    held = spark.range(n).select(F.lit(1).cast("long").alias("key"), name(F.col("id")).alias("fp"), name(F.lit(0)).alias("hub"), F.when(F.col("id") == 0, name(F.lit(0))).otherwise(name(F.lit(1))).alias("component"))
    rows = op3_superminhash.cross_blocks(materialize(held, "held"))
    assert rows.count() <= n + n // op3_superminhash.BLOCK + 1
    assert rows.groupBy("key", "bi", "bj").count().agg({"count": "max"}).first()[0] < 2.6 * op3_superminhash.BLOCK


def test_every_pair_of_two_components_meets_once(spark):
    from gridloom.llm.common import materialize

    rnd = random.Random(12)
    for most in (1, 2, 9):
        rows = [(k, str(i).encode(), b"0", str(rnd.choice([0, 0, 0, *range(most)])).encode()) for k in range(4) for i in range(rnd.randint(2, 40))]
        held = materialize(spark.createDataFrame(rows, "key long, fp binary, hub binary, component binary"), "held")
        met, tasks = Counter(), {}
        for r in op3_superminhash.cross_blocks(held, 5).collect():
            tasks.setdefault((r["key"], r["bi"], r["bj"]), []).append(r)
        for (key, bi, bj), rs in tasks.items():
            for x in rs:
                for y in rs:
                    if x["own"] == bi and y["own"] == bj and x["component"] != y["component"] and (bi != bj or x["fp"] < y["fp"]):
                        met[key, *sorted((bytes(x["fp"]), bytes(y["fp"])))] += 1
        assert met == Counter((k, *sorted((f, g))) for k, f, _, c in rows for k2, g, _, d in rows if k == k2 and f < g and c != d)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for same in (50, 160, 400):
        a, b = (np.concatenate([x, y]) for x, y in zip(np.tile(rng.integers(0, 2**63, same, dtype=np.uint64), (2, 1)), rng.integers(0, 2**63, (2, 40), dtype=np.uint64)))
        sig = op3_superminhash.superminhash(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
        assert abs((sig[0] == sig[1]).mean() - same / (same + 80)) < 0.15
        alone = op3_superminhash.superminhash(a, np.zeros(len(a), int), 1)
        assert np.array_equal(alone[0], sig[0])


def test_quality_statistics_and_rules(spark, odd, empty):
    got = op8_quality.add_statistics(table(spark, odd).select("doc_id", "text")).collect()
    assert Counter((r["doc_id"], *(r["__gl_stats"][c] for c in op8_quality.BASE)) for r in got) == Counter((i, *brute.stats(t)) for i, t, *_ in odd)
    rnd = random.Random(2)
    texts = ["", "a", "a b c a b c", "x\nx\n\nx", "#a# |b|\n#a# |b|", "\x0b\x0c a\x85b é"] + ["".join(rnd.choice("ab #\n") for _ in range(rnd.randint(0, 80))) for _ in range(200)]
    for t in texts:
        assert op8_quality.statistics(t.encode(), op8_quality.WordIds())[:5] == brute.stats(t), t
    bad = [(100 + i, prose(rnd, 60).replace(" ", "## "), "xx", "s") for i in range(40)]
    good = [(200 + i, prose(rnd, 60), "xx", "s") for i in range(40)]
    docs = table(spark, bad + good)
    labels = spark.createDataFrame([(r[0], int(r[0] >= 200)) for r in bad[:30] + good[:30]] + [(None, 1), (999, None), (998, 0)], "doc_id long, quality int")
    rules = op8_quality.fit(docs, labels)
    assert rules and all("symbols" in t or "marks" in t or "characters" in t for t in op8_quality.rule_text(rules))
    assert {r["doc_id"] for r in op8_quality.filter_quality(docs, labels).collect()} == {r[0] for r in good}
    assert op8_quality.fit(docs, labels.limit(0)) == [] and op8_quality.filter_quality(empty, labels).count() == 0
    assert op8_quality.filter_quality(table(spark, odd), labels).columns == docs.columns


def test_learned_lists_on_held_out_rows():
    rng = np.random.default_rng(4)
    x = rng.random((3000, 5))
    bad = (x[:, 1] > 0.7) & (x[:, 3] < 0.4) | (x[:, 4] > 0.95)
    rules = op8_quality.learn(x[:2000], bad[:2000])
    hit = np.zeros(1000, bool)
    for r in rules:
        hit |= op8_quality.covers(r, x[2000:])
    assert (hit == bad[2000:]).mean() > 0.95


def brute_learn(x, bad, precision=0.9, most_rules=24, most_terms=4, cuts=48, least=3):
    """Sequential covering by plain loops: rules as lists of (feature, at least, threshold)."""
    from math import log2

    holds = lambda rule, row: all((row[f] >= t) == ge for f, ge, t in rule)
    left, rules = set(range(len(x))), []
    while len(rules) < most_rules and sum(bad[i] for i in left) >= least:
        grow, prune = [i for i in sorted(left) if i % 3 != 2], [i for i in sorted(left) if i % 3 == 2]
        inside, rule = grow, []
        while len(rule) < most_terms and (p0 := sum(bad[i] for i in inside)) and p0 < len(inside):
            best = (1e-9, None)
            for f in range(len(x[0])):
                v = sorted(x[i][f] for i in inside)
                for t in sorted({float(np.quantile(v, q, method="nearest")) for q in np.linspace(0, 1, cuts)}):
                    for ge in (True, False):
                        hit = [i for i in inside if (x[i][f] >= t) == ge]
                        p = sum(bad[i] for i in hit)
                        if p >= least and (gain := p * (log2(p / len(hit)) - log2(p0 / len(inside)))) > best[0]:
                            best = (gain, (f, ge, t))
            if best[1] is None:
                break
            rule.append(best[1])
            inside = [i for i in grow if holds(rule, x[i])]
        if not rule:
            break

        def worth(r):
            hit = [i for i in prune if holds(r, x[i])]
            return sum(1 if bad[i] else -1 for i in hit) / len(hit) if hit else -1.0

        rule = max((rule[: k + 1] for k in range(len(rule))), key=lambda r: (worth(r), len(r)))
        hit = [i for i in left if holds(rule, x[i])]
        p = sum(bad[i] for i in hit)
        if p < least or p < precision * len(hit):
            break
        rules.append(rule)
        left -= set(hit)
    return rules


def test_learned_lists_against_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(4):
        x = np.round(rng.random((150, 3)), 2)
        bad = (x[:, 0] > 0.6) & (x[:, 2] < 0.5) | (rng.random(150) < 0.04)
        got = op8_quality.learn(x, bad)
        assert got == brute_learn(x.tolist(), bad.tolist()) and got


def test_quality_query_against_brute_force(spark, sf_dir):
    """Statistics, base and verdict of every document; the rules are learned again from the labelled documents by plain loops."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = [r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r["quality"] is not None]
    full = {i: op8_quality.statistics((t or "").encode(), op8_quality.WordIds()) for i, t in docs.items()}
    failed = {i: s[0] < 50 or 100 * s[4] > 50 * s[0] for i, s in full.items()}
    table_of = lambda ids: op8_quality.feature_table(np.array([full[i] for i in ids])).tolist()
    known = sorted({(r["doc_id"], r["quality"]) for r in labels if r["doc_id"] in docs}, key=lambda k: (op8_quality.hash_of(k[0]), k))
    known = [(i, q) for i, q in known if not failed[i]]
    rules = brute_learn(table_of([i for i, _ in known]), [q == 0 for _, q in known])
    hit = {i: any(all((row[f] >= t) == ge for f, ge, t in r) for r in rules) for i, row in zip(docs, table_of(docs))}
    got = op8_quality.op8_decision_lists(spark, sf_dir).collect()
    assert {(r["doc_id"], *(r[c] for c in op8_quality.BASE), r["base_failed"], r["kept"]) for r in got} == {(i, *brute.stats(t), failed[i], not failed[i] and not hit[i]) for i, t in docs.items()}


def test_verdicts_on_held_out_labels(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality IS NOT NULL")
    rules = op8_quality.fit(docs, labels.filter("doc_id % 2 = 0"))
    test = op8_quality.judge(docs.join(labels.filter("doc_id % 2 = 1").select("doc_id", "quality"), "doc_id"), rules, keep=["doc_id", "quality"]).collect()
    assert len(test) > 20 and np.mean([r["__gl_kept"] == bool(r["quality"]) for r in test if not r["__gl_base_failed"]]) > 0.9


def test_fitting_rows_stay_bounded(spark):
    rows = [(1, f"same id number {i} text words", ["aa", "bb"][i % 2], "s") for i in range(3000)] + [(i, f"other {i} some words", ["aa", "bb"][i % 2], "s") for i in range(2, 60)]
    docs = table(spark, rows)
    assert op1_langid.fit(docs, sample_rows=40).languages == ["aa", "bb"]
    seen = []
    real = op8_quality.learn
    op8_quality.learn = lambda x, bad, precision: seen.append(len(x)) or real(x, bad, precision)
    try:
        long = table(spark, [(i, t + " word" * 5 + f" {i} ".join(f"w{k}" for k in range(60)), l, s) for i, t, l, s in rows])
        op8_quality.fit(long, spark.createDataFrame([(i, i % 2) for i in range(60)] * 50, "doc_id long, quality int"))
    finally:
        op8_quality.learn = real
    assert seen and seen[0] <= 60


def test_language_query_against_brute_force(spark, sf_dir):
    """Every text's n-grams, margins and decoding by plain loops over the fitted model."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = op1_langid.fit(docs)
    keys = [int(k) for k in op1_langid.KEYS]

    def predict(text):
        clean = op1_langid.letters(None if text is None else text.encode())
        if clean is None:
            return "und", 0.0
        count, total = Counter(), 0
        for n in op1_langid.ORDERS:
            for at in range(len(clean) - n + 1):
                h = n * 0x165667B1 & 0xFFFFFFFF
                for i in range(n):
                    h = (h ^ clean[at + i] + 1) * keys[i] & 0xFFFFFFFF
                    h ^= h >> 15
                count[h >> 18] += 1
                total += 1
        at = np.array(list(count), int)
        margin = (model.weights[at].astype(float) * np.array(list(count.values()))[:, None]).sum(0) / total + model.bias
        loss = [sum(t * np.log1p(np.exp(-c * m)) for t, c, m in zip(model.trust[k], model.code[k], margin)) for k in range(len(model.languages))]
        p = np.exp(-(np.array(loss) - min(loss)) * model.code.shape[1])
        return model.languages[int(np.argmin(loss))], float((p / p.sum())[int(np.argmin(loss))])

    got = {r["doc_id"]: r for r in op1_langid.predict(docs, model).collect()}
    assert {i: r["lang_pred"] for i, r in got.items()} == {r["doc_id"]: r["lang_pred"] for r in op1_langid.op1_error_correcting_codes(spark, sf_dir).collect()}
    some = [r for r in docs.collect() if r["doc_id"] % 3 == 0]
    right = []
    for r in some:
        lang, score = predict(r["text"])
        assert got[r["doc_id"]]["lang_pred"] == lang and got[r["doc_id"]]["score"] == pytest.approx(score, abs=1e-3), r["doc_id"]
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        right += [lang == r["lang"]] if got[r["doc_id"]]["held_out"] and r["lang"] and lang != "und" else []
    assert np.mean(right) > 0.9


def test_language_codes(spark, odd, empty):
    book = op1_langid.code_book(5)
    assert book.shape == (5, 15) and min((book[i] != book[j]).sum() for i in range(5) for j in range(i)) == 8
    assert op1_langid.code_book(30).shape[0] == 30
    rnd = random.Random(1)
    sounds = {"aa": "kala mona tiri", "bb": "schr pfl gnt", "cc": "ño ción ées"}
    rows = [(i, " ".join(rnd.choice(sounds[l].split()) + rnd.choice("xyzuv") for _ in range(rnd.randint(1, 40))), l, "s") for i, l in enumerate(rnd.choices(list(sounds), k=240))]
    model = op1_langid.fit(table(spark, rows))
    assert model.languages == ["aa", "bb", "cc"]
    got = {r["doc_id"]: r for r in op1_langid.predict(table(spark, rows), model).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in got.items())
    assert np.mean([got[i]["lang_pred"] == l for i, _, l, _ in rows if got[i]["held_out"]]) > 0.95
    strange = [(1, None, None, None), (2, "", "aa", None), (3, "12 !? ²", None, None), (4, "日本", None, None), (None, "schrx", None, None)]
    pred = {r["doc_id"]: r["lang_pred"] for r in op1_langid.predict(table(spark, strange), model).collect()}
    assert (pred[1], pred[2], pred[3], pred[None]) == ("und", "und", "und", "bb") and pred[4] != "und"
    assert {r["lang_pred"] for r in op1_langid.predict(table(spark, odd), op1_langid.fit(empty)).collect()} == {"und"}
    one = op1_langid.fit(table(spark, odd))
    assert {r["lang_pred"] for r in op1_langid.predict(table(spark, odd), one).collect()} == {"und", "xx"}


def test_warc_files(spark, tmp_path):
    big, other = "x" * 1500, "é" * 600
    rows = [(5, "http://a/1", big), (9, "http://a/2", big), (7, None, big), (1, "http://b/ sp\nace", "small"), (2, "http://b", "small"), (3, None, None), (4, "u", other), (8, "v", other), (None, "n", big), (9, "http://a/2", big), (6, "e", "")]
    pages = spark.createDataFrame([(*r, "q", "z") for r in rows], "page_id long, url string, html string, size string, key string")
    got = []
    for k in range(2):
        to = f"file://{tmp_path}/{k}"
        manifest = op2_warc.write_warc(pages.repartition(k + 1), to, roll_bytes=600, least_shards=3)
        got.append((op2_warc.read_warc(manifest, to).drop("file").collect(), {p.name: p.read_bytes() for p in (tmp_path / str(k)).iterdir()}))
    assert got[0][1] == got[1][1] and len(got[0][1]) > 3 and not [n for n in got[0][1] if n.startswith(".")]
    by = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got[0][0])
    assert by == Counter([(5, 1500, "revisit", 9), (9, 1500, "response", None), (7, 1500, "revisit", 9), (1, 5, "response", None), (2, 5, "response", None), (3, 0, "response", None), (4, 1200, "revisit", 8), (8, 1200, "response", None), (None, 1500, "response", None), (9, 1500, "response", None), (6, 0, "response", None)])
    import hashlib

    assert {r["payload_digest"] for r in got[0][0] if r["page_id"] in (4, 8)} == {hashlib.sha1(other.encode()).hexdigest()}
    none = op2_warc.write_warc(pages.limit(0), f"file://{tmp_path}/none")
    assert op2_warc.read_warc(none, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "plain"])
def test_pieces_give_the_whole_texts_ids(name, tmp_path):
    if name == "plain":
        from tokenizers import Tokenizer, models, pre_tokenizers

        t = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
        t.pre_tokenizer = pre_tokenizers.Whitespace()
        t.save(str(tmp_path / "t.json"))
        e = Encoder(str(tmp_path / "t.json"))
        assert e.kind is None
    else:
        e = Encoder(path_of(name), most_pieces=50)
        assert e.kind
        from tokenizers import Tokenizer

        bare, default = Tokenizer.from_file(path_of(name)), Encoder(path_of(name), special_as_text=False)
        for t in ("x <|endoftext|> y", "<|EndOfText|>", "a<|startoftext|>b", "<|endoftext|"):
            ids = lambda raw: np.frombuffer(raw, "<u4").tolist()
            assert ids(default.encode(t)) == bare.encode(t, add_special_tokens=False).ids
            assert e.tokenizer.encode_special_tokens and ids(e.encode(t)) == e.tokenizer.encode(t, add_special_tokens=False).ids
    rnd = random.Random(3)
    letters = "abcXYZ '’  \n\t!?.-123²ÀéßµªÇ日本\x85\xa0İsl<|endoftext|>"
    for _ in range(1500):
        t = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 50)))
        assert e.encode(t) == e.whole(t), t


def test_addressable_codes(spark, odd, empty):
    rng = np.random.default_rng(2)
    for widths in ((8, 8, 8, 8), (4, 12, 16), (16, 16)):
        for n in (0, 1, 511, 512, 513, 3000):
            ids = (rng.integers(0, 2**31, n) >> rng.integers(0, 31, n)).astype(np.uint32)
            f = op4_dac.DacFile.of(op4_dac.file_bytes([7], np.array([n]), ids, widths))
            assert np.array_equal(f.all(), ids) and all(f[i] == ids[i] for i in range(n))
            for a, b in (sorted(rng.integers(0, n + 1, 2).tolist()) for _ in range(9)):
                assert np.array_equal(f.slice(a, b), ids[a:b])
    seen, raw = [0], op4_dac.file_bytes(list(range(1000)), np.full(1000, 100), rng.integers(0, 2**16, 100_000).astype(np.uint32))

    def fetch(place, length):
        seen[0] += length
        return raw[place : place + length]

    f = op4_dac.DacFile(fetch)
    seen[0] = 0
    assert f[77_777] == f.slice(77_777, 77_778)[0] and seen[0] < 300  # any id costs some bytes of the file
    assert op4_dac._checksums(f, [0, 100, 100, 50_000], 1_000) == [zlib.crc32(f.slice(a, b).tobytes()) for a, b in ((0, 100), (100, 100), (100, 50_000))]
    to = scratch(spark, "t")
    docs = table(spark, odd)
    manifest = op4_dac.write_ids(docs, to, path_of("word_bpe_49k.json"), 2, least_shards=4, file_ids=5000)
    got = op4_dac.read_ids(manifest, to).collect()
    e, want, at = Encoder(path_of("word_bpe_49k.json")), [], 0
    for i, t, *_ in sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        b = e.whole(t or "") + b"\2\0\0\0"
        want.append((i, at, len(b) // 4, zlib.crc32(b)))
        at += len(b) // 4
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want and manifest.count() > 2
    hot = table(spark, [(5 if i % 3 else i, f"text {i}", "xx", "s") if i % 7 else (None, "x" * i, "xx", "s") for i in range(900)])
    to = scratch(spark, "t")
    manifest = op4_dac.write_ids(hot, to, path_of("word_bpe_49k.json"), 2, shard_bytes=1500, least_shards=2)
    got = sorted((r["start"], r["doc_id"]) for r in op4_dac.read_ids(manifest, to).collect())
    ids = [i for _, i in got]
    assert len(got) == 900 and ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and manifest.agg({"docs": "max"}).first()[0] < 150
    to = scratch(spark, "t")
    assert op4_dac.read_ids(op4_dac.write_ids(empty, to, path_of("word_bpe_49k.json"), 2), to).count() == 0


def check_packing(rows, lengths, top=1024):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, n in lengths.items():
        at = 0
        for s, l in sorted(by_doc[i]):
            assert s == at and l > 0
            at += l
        assert at == n
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for o, l in sorted(pieces):
            assert o == at
            at += l
        assert at <= top
        padding += 0 if at & (at - 1) == 0 else top - at
    return padding


def test_packing(spark, odd, empty):
    ids = Counter(i for i, *_ in odd)
    rows = [r for r in odd if r[0] is not None and ids[r[0]] == 1]
    e = Encoder(path_of("byte_bpe_50k.json"))
    full = {i: e.whole(t or "") + b"\0\0\0\0" for i, t, *_ in rows}
    got = op7_packing.pack_documents(table(spark, rows).coalesce(1), path_of("byte_bpe_50k.json"), 0, buffer_ids=20_000).collect()
    assert check_packing(got, {i: len(b) // 4 for i, b in full.items()}) == 0
    assert all(zlib.crc32(full[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] and r["doc_tokens"] == len(full[r["doc_id"]]) // 4 for r in got)
    whole = op7_packing.pack_documents(table(spark, odd), path_of("byte_bpe_50k.json"), 0)
    assert whole.agg({"length": "sum"}).first()[0] == sum(len(e.whole(t or "")) // 4 + 1 for _, t, *_ in odd)
    assert op7_packing.pack_documents(empty, path_of("byte_bpe_50k.json"), 0).count() == 0


def test_packing_query_against_the_tokenizer(spark, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path_of("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    full = {r["doc_id"]: np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op7_packing.op7_multi_length_packing(spark, sf_dir).collect()
    assert check_packing(got, {i: len(b) // 4 for i, b in full.items()}) == 0
    assert all(zlib.crc32(full[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] and r["doc_tokens"] == len(full[r["doc_id"]]) // 4 for r in got)


def test_packing_cuts_little():
    rnd = random.Random(1)
    for n in (1, 2, 30, 800):
        lengths = [min(5000, int(rnd.lognormvariate(5.5, 1.2)) + 1) for _ in range(n)]
        packed = op7_packing.pack(lengths)
        rows = [{"doc_id": d, "start": s, "length": l, "sequence_id": k, "offset": sum(p[2] for p in pieces[:j])} for k, (_, pieces) in enumerate(packed) for j, (d, s, l) in enumerate(pieces)]
        assert check_packing(rows, dict(enumerate(lengths))) == 0
        if n == 800:
            needed = sum(-(-x // 1024) for x in lengths)
            assert len(rows) < 1.35 * needed
    groups = op7_packing.step_groups([1024] * 90 + [512] * 20, 8192)
    load = Counter()
    for g, s in zip(groups, [1024] * 90 + [512] * 20):
        load[g] += s
    assert max(load.values()) - min(load.values()) <= 1024


def test_mixing(spark, odd, empty):
    tokens = {"a": 90_000, "b": 9_000, "c": 1_000, "none": 0}
    some = op6_mixing.materialize(spark.createDataFrame([(k, v, 1) for k, v in tokens.items()], "name string, tokens long, rows long"), "t")
    for shares in (op6_mixing.shares_of(tokens), op6_mixing.shares_table(some)):
        s = np.array([0.9, 0.09, 0.01])
        w = lambda a: s**a / (s**a).sum()
        alpha = op6_mixing.find_alpha(shares, entropy_share=0.9)
        assert -(w(alpha) * np.log(w(alpha))).sum() / np.log(3) == pytest.approx(0.9, abs=1e-6) and 0 < alpha < 1
        alpha = op6_mixing.find_alpha(shares, entropy_share=0.99, most_epochs=3.0)
        assert max(w(alpha) / s) == pytest.approx(3.0, abs=1e-6)
        alpha = op6_mixing.find_alpha(shares, most_epochs=5.0, budget=1.5)
        assert max(1.5 * w(alpha) / s) == pytest.approx(5.0, abs=1e-6)
        alpha = op6_mixing.find_alpha(shares, most_epochs=2.0, budget="whole")
        assert max(w(alpha) / s) / min(w(alpha) / s) == pytest.approx(2.0, abs=1e-6)
        assert op6_mixing.find_alpha(shares, most_epochs=1000.0) == 0 and op6_mixing.find_alpha(shares, entropy_share=0.01) == 1
    rnd = random.Random(6)
    rows = [(i, prose(rnd, rnd.randint(1, 40)), "xx", "big" if i % 10 else "small") for i in range(600)]
    out, alpha = op6_mixing.mix(table(spark, rows), most_epochs=2.5, block_tokens=500)
    got = out.collect()
    assert len(got) == 600 and 0 < alpha < 1
    total = sum(r["n_tokens"] for r in got)
    for name in ("big", "small"):
        mine = [r for r in got if r["source"] == name]
        whole = int(mine[0]["source_epochs"])
        assert {r["copies"] for r in mine} <= {whole, whole + 1}
        assert abs(sum(r["n_tokens"] * r["copies"] for r in mine) - mine[0]["source_weight"] * total) <= 40
    assert sorted((r["doc_id"], r["copies"]) for r in got) == sorted((r["doc_id"], r["copies"]) for r in op6_mixing.mix(table(spark, rows), most_epochs=2.5, block_tokens=500)[0].collect())
    lossless = op6_mixing.mix(table(spark, odd), most_epochs=1.5, budget="whole")[0].collect()
    assert len(lossless) == len(odd) and min(r["copies"] for r in lossless) == 1 and max(r["copies"] for r in lossless) <= 2
    copies = op6_mixing.mixed_documents(table(spark, odd), most_epochs=1.5, budget="whole")
    assert copies.columns == table(spark, odd).columns and copies.count() == sum(r["copies"] for r in lossless)
    assert op6_mixing.mix(empty)[0].count() == 0 and op6_mixing.mixed_documents(empty, most_epochs=1.5, budget="whole").count() == 0


def xx(seed, *values):
    """Spark's xxhash64 of integers (i: 32 bits), longs, strings and nulls."""
    import xxhash

    h = 42
    for v in (seed, *values):
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def brute_copies(rows, most_epochs, budget, block_tokens, seed=17):
    """(doc_id, copies) of mix() by plain loops; rows: doc_id, text, lang, source."""
    per = {}
    for i, t, _, s in rows:
        per.setdefault("n" if s is None else "s" + s, []).append((i, t, len((t or "").encode().split())))
    total = {k: sum(n for *_, n in v) for k, v in per.items()}
    everything = sum(total.values())
    share = {k: t / everything for k, t in total.items() if t}
    lo, hi = 0.0, 1.0
    for _ in range(200):
        a = (lo + hi) / 2
        z = sum(x**a for x in share.values())
        lo, hi = (lo, a) if max(budget * x**a / z / x for x in share.values()) <= most_epochs else (a, hi)
    z, out = sum(x**hi for x in share.values()), []
    for k, docs in per.items():
        epochs = budget * share[k] ** hi / z / share[k] if total[k] else 0.0
        whole = int(epochs + 1e-9)
        rest, blocks = max(0.0, (epochs - whole) * total[k]), max(1, -(-total[k] // block_tokens))
        turns = {}
        for i, t, n in docs:
            place = xx((seed,), xx(i, t) if i is not None else xx(t) if t is not None else 42)
            turns.setdefault((xx((seed,), k, xx((seed + 1,), place) % blocks) % (1 << 64)) >> 1, []).append((place, i, n))
        spent = 0
        for turn in sorted(turns):
            room, held = rest - spent, 0
            size = sum(n for *_, n in turns[turn])
            for _, i, n in sorted(turns[turn], key=lambda d: d[0]):
                out.append((i, whole + int(rest > 0 and (size <= room and spent + size <= rest or 0 <= room < size and held + n / 2 <= room))))
                held += n
            spent += size
    return Counter(out)


@pytest.mark.parametrize("block_tokens", [300, 5_000, 1_000_000])
def test_mixing_against_brute_force(spark, block_tokens):
    rnd = random.Random(13)
    rows = [(i, prose(rnd, rnd.randint(0, 60)), "xx", rnd.choice(["big"] * 7 + ["mid"] * 2 + ["small", None])) for i in range(700)] + [(900, None, None, "blank"), (None, "a b", None, "big")]
    got, alpha = op6_mixing.mix(table(spark, rows), most_epochs=1.9, budget=1.5, block_tokens=block_tokens)
    assert 0 < alpha < 1 and Counter((r["doc_id"], r["copies"]) for r in got.collect()) == brute_copies(rows, 1.9, 1.5, block_tokens)


def test_mixing_query_against_brute_force(spark, sf_dir):
    got = op6_mixing.op6_temperature_mixing(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    copies = [r["copies"] for r in got]
    assert Counter((r["doc_id"], r["copies"]) for r in got) == brute_copies(docs, 1.6, 1.5, 1_000_000) and min(copies) < max(copies)


def test_shared_passages(spark, odd, empty):
    rnd = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    fuzzy = [w if i % 15 else "changed" for i, w in enumerate(passage)]
    own = lambda n: [f"u{rnd.random()}" for _ in range(n)]
    docs = [(i, own(40) + passage + own(30)) for i in range(1, 6)] + [(6, own(70) + fuzzy), (7, own(120)), (8, own(20) + passage[:30] + own(9)), (9, passage), (10, [w.upper() for w in passage])]
    rows = [(i, " ".join(w), "xx", "s") for i, w in docs]
    got = {r["doc_id"]: r for r in op9_chaining.shared_passages(table(spark, rows)).collect()}
    assert set(got) == {2, 3, 4, 5, 6, 9, 10} and all(r["partner_id"] == 1 for r in got.values())
    assert all((r["start_word"], r["end_word"]) == (40, 100) for i, r in got.items() if i < 6)
    assert got[6]["identity"] < 1 and got[6]["start_word"] in (70, 71) and got[9]["end_word"] == 60
    assert op9_chaining.shared_passages(empty).count() == 0
    assert {r["doc_id"] for r in op9_chaining.shared_passages(table(spark, odd)).collect()} >= {20, 21, 22}


def own_words(rnd, n):
    return [f"u{rnd.randrange(10**9)}" for _ in range(n)]


def test_passages_whose_seeds_have_several_first_documents(spark):
    rnd = random.Random(21)
    for case, parts in enumerate([[(0, 45), (45, 90)], [(0, 40), (20, 60), (40, 80)], [(0, 60)], [(0, 30), (30, 60), (60, 90)], [(k, k + 14) for k in range(0, 84, 7)]]):
        p = [f"p{case}-{i}" for i in range(90)]
        texts = [own_words(rnd, 12) + p[a:b] + own_words(rnd, 12) for a, b in parts] + [own_words(rnd, 9) + p + own_words(rnd, 9), own_words(rnd, 30) + p + own_words(rnd, 5)]
        docs = table(spark, [(i, " ".join(t), "xx", "s") for i, t in enumerate(texts)])
        n = len(texts)
        got = {(r["doc_id"], r["partner_id"], r["start_word"], r["end_word"]) for r in op9_chaining.shared_passages(docs).collect()}
        assert (n - 1, n - 2, 30, 120) in got, (case, got)


@pytest.mark.parametrize("holders", [1, 30])
def test_fuzzy_passages_whose_seeds_are_held_before(spark, holders):
    """Earlier documents hold parts of 15 words, too short to be passages; what the last two of each passage share has 9 words in a row at most."""
    rnd, texts, late = random.Random(24), [], []
    for _ in range(40):
        p = own_words(rnd, 60)
        texts += [own_words(rnd, 12) + p[k : k + 15] + own_words(rnd, 12) for k in range(0, 60, 15) for _ in range(holders)]
        late += [own_words(rnd, 20 + r) + [w if i % 20 != 3 + 10 * r else f"edit{rnd.random()}" for i, w in enumerate(p)] + own_words(rnd, 20) for r in (0, 1)]
    n = len(texts)
    docs = table(spark, [(i, " ".join(t), "xx", "s") for i, t in enumerate(texts + late)])
    got = {(r["doc_id"] - n, r["partner_id"] - n) for r in op9_chaining.shared_passages(docs).collect()}
    assert all(i % 2 and j == i - 1 for i, j in got) and len(got) >= 38, got


def test_long_fuzzy_ends_and_repeated_ids(spark):
    rnd = random.Random(22)
    passage = own_words(rnd, 900)
    fuzzy = [w if i < 60 or i % 5 else f"edit{i}" for i, w in enumerate(passage)]  # no seed after word 60, identity 0.8
    rows = [(1, " ".join(own_words(rnd, 20) + passage), "xx", "s"), (2, " ".join(own_words(rnd, 20) + fuzzy), "xx", "s")]
    r = op9_chaining.shared_passages(table(spark, rows)).collect()
    assert len(r) == 1 and (r[0]["start_word"], r[0]["partner_start"]) == (20, 20) and r[0]["end_word"] >= 915
    rows = [(3, " ".join(passage[:70]), "xx", "s"), (5, " ".join(["zz"] + passage[:70]), "xx", "s"), (5, " ".join(["aa"] + own_words(rnd, 60)), "xx", "s"), (5, None, "xx", "s"), (None, " ".join(passage[:70]), "xx", "s")]
    assert [(r["doc_id"], r["partner_id"], r["start_word"], r["end_word"]) for r in op9_chaining.shared_passages(table(spark, rows)).collect()] == [(5, 3, 1, 71)]


def planted(rnd, words, identity, how):
    """A passage and a copy with identity * words common words; edits at random places, evenly, or as words put in and left out."""
    a = own_words(rnd, words)
    n = round(words * (1 - identity))
    at = set(rnd.sample(range(1, words - 1), n)) if how != "even" else {round((i + 0.5) * words / n) for i in range(n)}
    b = []
    for i, w in enumerate(a):
        if i not in at:
            b.append(w)
        elif how != "indels":
            b += own_words(rnd, 1)
        elif i % 2:
            b += [w, *own_words(rnd, 1)]
    return a, b


def recall(spark, trials, settings, seed=23):
    """Of planted pairs of documents, how many give a passage that covers half of it at least."""
    rnd, rows, where = random.Random(seed), [], {}
    for s in settings:
        for _ in range(trials):
            a, b = planted(rnd, *s)
            i = len(rows)
            rows += [(i, " ".join(own_words(rnd, 40) + a + own_words(rnd, 40)), "xx", "s"), (i + 1, " ".join(own_words(rnd, 30) + b + own_words(rnd, 50)), "xx", "s")]
            where[i + 1] = (s, len(b))
    hit = Counter()
    for r in op9_chaining.shared_passages(table(spark, rows)).collect():
        s, n = where[r["doc_id"]]
        hit[s] += r["partner_id"] == r["doc_id"] - 1 and 2 * (min(r["end_word"], 30 + n) - max(r["start_word"], 30)) >= n
    return {s: hit[s] / trials for s in settings}


def test_recall_of_fuzzy_passages(spark):
    got = recall(spark, 40, [(60, 0.9, "random"), (100, 0.85, "random"), (100, 0.9, "even"), (200, 0.9, "indels"), (200, 0.8, "random")])
    assert got[60, 0.9, "random"] >= 0.8 and got[100, 0.85, "random"] >= 0.8 and got[100, 0.9, "even"] >= 0.9 and got[200, 0.9, "indels"] >= 0.9 and got[200, 0.8, "random"] >= 0.7, got


def test_exact_passages_against_brute_force(spark, sf_dir):
    """Every document with 64 words that an earlier one has too (whole 64-word windows by hash) is found, with these words covered."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: brute.WORD.findall(brute.lower_az(r["text"] or "")) for r in docs.collect()}
    holder, need = {}, {}
    for i in sorted(texts):
        w = texts[i]
        windows = [(k, hash(tuple(w[k : k + 64]))) for k in range(len(w) - 63)]
        need[i] = [k for k, h in windows if h in holder]
        for _, h in windows:
            holder.setdefault(h, i)
    found = {}
    for r in op9_chaining.op9_collinear_chaining(spark, sf_dir).collect():
        assert r["identity"] >= 0.8 and min(r["end_word"] - r["start_word"], r["partner_end"] - r["partner_start"]) >= 50 and r["partner_id"] < r["doc_id"]
        a, b = texts[r["doc_id"]][r["start_word"] : r["end_word"]], texts[r["partner_id"]][r["partner_start"] : r["partner_end"]]
        assert brute.common(a, b) / max(len(a), len(b)) == pytest.approx(r["identity"], abs=0.051)
        found.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    missed = [(i, k) for i, ks in need.items() for k in ks if not any(s <= k + 32 < e for s, e in found.get(i, []))]
    assert any(need.values()) and not missed


def test_stretch_keys_depend_on_their_seeds_alone():
    rng = np.random.default_rng(3)
    seed, gap = rng.integers(-(2**62), 2**62, 60), rng.integers(1, 7, 60)
    pos, partner, ppos = np.cumsum(gap), rng.integers(0, 3, 60), rng.integers(0, 9, 60)
    whole = {(a - pos[0], b - pos[0]): k for k, a, b in zip(*op9_chaining.stretches(seed, pos, partner, ppos, (20,))[0])}
    some = op9_chaining.stretches(seed[9:], pos[9:] + 1000, partner[9:], ppos[9:], (20,))[0]
    assert len(some[0]) > 20 and all(whole[a - 1000 - pos[0], b - 1000 - pos[0]] == k for k, a, b in zip(*some)) and len(set(whole.values())) == len(whole)


def test_passages_do_not_depend_on_the_order_of_rows():
    """Of two passages with one start and end in a document the one that holds the other stays, whichever comes first."""
    names = [c.split()[0] for c in op9_chaining.FOUND.split(", ")]
    rows = [(9, 4, 0, 88, 0, 86, 0.97), (9, 4, 0, 88, 0, 88, 0.98), (9, 4, 100, 160, 0, 60, 0.9), (9, 5, 0, 60, 3, 63, 1.0), (9, 4, 100, 160, 0, 60, 0.95)]
    for order in permutations(rows):
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in order]) for i in range(7)], names=names)
        got = [tuple(r.values()) for b in op9_chaining._outermost(iter([batch])) for r in b.to_pylist()]
        assert sorted(got) == [(9, 4, 0, 88, 0, 88, 0.98), (9, 4, 100, 160, 0, 60, 0.95), (9, 5, 0, 60, 3, 63, 1.0)], order


def cut_up(rnd, columns, names):
    """Sorted columns as batches of random sizes."""
    at = 0
    while at < len(columns[0]):
        n = rnd.randint(0, 9)
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + n]) for c in columns], names=names)
        at += n


@pytest.mark.parametrize("held", [17, 4096])
def test_links_of_keys_against_all_pairs(monkeypatch, held):
    """Shared seeds, and what meets by its key, with the keys cut over batches and frequent ones given out in parts."""
    monkeypatch.setattr(op9_chaining, "HELD", held)
    rnd = random.Random(31)
    for trial in range(30):
        rows = sorted({(k, rnd.randint(1, 40), rnd.randint(0, 500)) for k in range(-4, 5) for _ in range(rnd.choice([1, 2, 5, 16, 17, 60]))})
        rows += [(9, 7, p) for p in range(30)] + [(10, 7, p) for p in range(30)] + [(10, 8, 3)]  # of one document alone; of one, then another
        groups = {k: [r[1:] for r in rows if r[0] == k] for k in {r[0] for r in rows}}
        key, doc, pos = (np.array(c, np.int64) for c in zip(*rows))
        want = sorted((d, p, k, *g[0], len(g) <= op9_chaining.FEW) for k, g in groups.items() for d, p in g if g[0][0] < g[-1][0])
        got = [r for b in op9_chaining._shared(cut_up(rnd, (key, doc, pos), ["seed", "doc_id", "pos"])) for r in b.to_pylist()]
        assert sorted((r["doc_id"], r["at"] >> 32, r["seed"], r["partner"], (r["at"] & 0xFFFFFFFF) >> 1, bool(r["at"] & 1)) for r in got) == want
        last = pos + np.array([rnd.choice([0, 9, 40, 60]) for _ in rows])
        run = np.array([rnd.choice([0, 0, 0, 5]) for _ in rows])  # 5: two links, three words apart, that are there already
        partner = np.where(run > 0, 99, 0)
        want, open_ = Counter(), {}
        for k, d, p, e, r in zip(key, doc, pos, last, run):
            if r:
                want[d, 99, p, 0] += 1
                want[d, 99, p + 2, 2] += 1
            else:
                open_.setdefault(k, []).append((d, p, e))
        for g in open_.values():
            for i, (d, p, e) in enumerate(g):
                for f, q, t in g[:i] if len(g) <= op9_chaining.FEW else g[:1]:
                    if f < d:
                        want.update({(d, f, p, q), (d, f, e, t)})
        place = np.where(run > 0, pos << 32, pos << 32 | last)
        got = [r for b in op9_chaining._met(cut_up(rnd, (key, doc, place, partner, run), ["key", "doc_id", "place", "partner", "run"]), 40) for r in b.to_pylist()]
        assert Counter((r["doc_id"], r["partner"], (r["place"] >> 32) + i, (r["place"] & 0xFFFFFFFF) + i) for r in got for i in range(53) if r["run"] >> i & 1) == want


def test_runs_of_links_and_seeds_of_many_texts():
    rng = np.random.default_rng(5)
    for _ in range(40):
        n = int(rng.integers(1, 200))
        doc = np.sort(rng.integers(0, 3, n))
        x = np.cumsum(rng.integers(1, 9, n) + 50 * (rng.random(n) < 0.05))
        partner, y = doc * 0 + np.repeat(rng.integers(0, 2, n), 40)[:n], x - np.repeat(rng.integers(0, 2, n), 50)[:n]
        start, run = op9_chaining.runs(doc, partner, x, y, 40)
        links = [(doc[s], partner[s], x[s] + i, y[s] + i) for s, m in zip(start, run.tolist()) for i in range(m.bit_length()) if m >> i & 1]
        assert links == [*zip(doc, partner, x, y)] and all("0" * 40 not in bin(m) and m < 2**53 for m in run.tolist())
        texts = [rng.integers(0, 2**63, int(rng.choice([0, 1, 4, 5, 11, 12, 13, 60]))).astype(np.uint64) for _ in range(12)]
        seed, pos, of = op9_chaining.minimizers_of(np.concatenate(texts), np.array([len(t) for t in texts]), 5, 8)
        assert sorted(zip(of, pos, seed)) == [(i, p, s) for i, t in enumerate(texts) for s, p in zip(*op9_chaining.minimizers(t, 5, 8))]


def test_word_codes_tell_words_apart(monkeypatch):
    """Like lower() and split(), whatever the words, texts and blocks."""
    rnd = random.Random(12)
    for block in (1, 7, 1 << 16):
        monkeypatch.setattr(op9_chaining, "BLOCK", block)
        texts = [b"", b" ", b"Ab", b"\x00 a\x00 \x00a aa a", *(bytes(rnd.choice(b"aAbB \t\n\r\x0b\x0c\x1c\x85\xc3\x84") for _ in range(rnd.choice([3, 40, 300]))) for _ in range(60))]
        hashes, counts = op9_chaining.word_codes(texts)
        words = [t.lower().split() for t in texts]
        assert counts.tolist() == [len(w) for w in words]
        pairs = {*zip((w for ws in words for w in ws), hashes.tolist())}
        assert len(hashes) == sum(counts) and len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs}) > 300


def test_inner_passages_against_all_parts():
    rnd = random.Random(14)
    for _ in range(60):
        a = [rnd.randrange(400) for _ in range(150)]
        b = [w if i in range(20, 50) or i in range(80, 120) or rnd.random() < 0.3 else rnd.randrange(400) for i, w in enumerate(a)]
        a, b = np.array(a, np.uint32), np.array(b, np.uint32)
        x, y = (z.tolist() for z in op9_chaining.common_places(a, b))
        want, todo = [], [(0, len(x))]
        while todo:
            lo, hi = todo.pop()
            best = (0, 0, 0)
            for u in range(lo, hi):
                if x[hi - 1] - x[u] < best[0]:
                    break  # nothing longer begins here
                best = max([best, *((x[v] - x[u] + 1, u, v + 1) for v in range(u, hi) if min(x[v] - x[u], y[v] - y[u]) >= 19 and v - u + 1 >= 0.85 * (max(x[v] - x[u], y[v] - y[u]) + 1))])
            if best[0]:
                _, u, v = best
                want.append((x[u], x[v - 1] + 1, y[u], y[v - 1] + 1))
                todo += [(lo, u), (v, hi)]
        assert [g[:4] for g in op9_chaining.inner_passages(a, b, 20, 0.85)] == want and want


def test_extension_against_every_length():
    rnd = random.Random(6)
    for _ in range(300):
        same = np.array([rnd.random() < 0.8 for _ in range(rnd.choice([0, 1, 20, 600]))], bool)
        best = total = length = 0
        for i, equal in enumerate(same):
            total += 1 if equal else -2
            if total > best:
                best, length = total, i + 1
            if best - total >= 12:
                break
        assert op9_chaining.extension(same) == length


def test_chains_against_all_chains():
    rnd = random.Random(8)
    for _ in range(200):
        n = rnd.randint(1, 9)
        pts = sorted({(rnd.randint(0, 30), rnd.randint(0, 30)) for _ in range(n)})
        x, y = (np.array(v) for v in zip(*pts))
        score = [0.0] * len(pts)
        for i in range(len(pts)):
            gains = [score[j] - 0.1 * (x[i] - x[j] + y[i] - y[j]) for j in range(i) if x[j] < x[i] and y[j] < y[i]]
            score[i] = 5.0 + max([0.0, *gains])
        best = op9_chaining.best_chains(x, y)
        c = best[0]
        assert 5 * len(c) - 0.1 * sum(x[b] - x[a] + y[b] - y[a] for a, b in zip(c, c[1:])) == pytest.approx(max(score))
        assert sorted(i for c in best for i in c) == list(range(len(pts)))
    a, b = rnd.choices(range(4), k=40), rnd.choices(range(4), k=30)
    table_ = [[0] * 31 for _ in range(41)]
    for i in range(40):
        for j in range(30):
            table_[i + 1][j + 1] = table_[i][j] + 1 if a[i] == b[j] else max(table_[i][j + 1], table_[i + 1][j])
    assert op9_chaining.common_length(np.array(a), np.array(b)) == table_[40][30]


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="with-sidebar"><nav><ul><li>Menu</li></ul></nav><!-- c --><div class="ad">Buy</div>'
    '<div class="cookie-notice">We use <b>cookies</b></div><article class="post"><h1>A &amp; B</h1><p>One<br>two&nbsp;&lt;x&gt; 3 < 4 <span class="ad">ad</span>end<p>Last'
    '<script>var a="</p>";</script><div id="comments"><article class="comment">bad</article></div><form>f</form></article><aside>side</aside><footer>&copy; x</footer></body></html>'
)


def test_main_text_by_structure():
    assert op10_html.main_blocks(op10_html.blocks_of(PAGE)) == ["A & B", "One two <x> 3 < 4 end", "Last"]
    for cut in range(len(PAGE)):  # never an error
        op10_html.blocks_of(PAGE[:cut])
    assert op10_html.blocks_of('<p title="a>b">x<p>y</div>z') == [("x", 1), ("y", 1), ("z", 1)]


def test_class_names_count_as_wholes():
    page = "<article>" + "".join(f'<div class="{c}">{c}</div>' for c in ("social-policy", "related-work", "search-algorithms", "comment-list", "ad-banner", "newsletter signup")) + "<noscript>n</noscript><svg><title>t</title><text>s</text></svg></article>"
    assert [t for t, _ in op10_html.blocks_of(page)] == ["social-policy", "related-work", "search-algorithms", "ns"]


def test_long_and_broken_pages_take_time_in_proportion():
    import time

    for part in ("<i>", "</b>", "<i></b>", "<b><div><i>", "<textarea>", "<a '", "<p>x", "<li><ul>", "<!-- ", "<x a=\"", "<td></tr>", "&amp", "<p class='a b' "):
        page = "<b><div>" + part * (1_000_000 // len(part))
        started = time.perf_counter()
        op10_html.blocks_of(page)
        assert time.perf_counter() - started < 4, part  # a quadratic pass takes minutes


class Plain:
    """The article's text by the standard library's parser, for pages of h1, p, b, br and entities inside it."""

    def __init__(self, page):
        from html.parser import HTMLParser

        self.blocks, inside = [[]], [0]
        parser = HTMLParser(convert_charrefs=True)

        def start(tag, attrs):
            inside[0] += tag == "article"
            if tag in ("article", "h1", "p"):
                self.blocks.append([])
            elif tag == "br" and inside[0]:
                self.blocks[-1].append(" ")

        def end(tag):
            inside[0] -= tag == "article" and inside[0] > 0
            if tag in ("article", "h1", "p"):
                self.blocks.append([])

        parser.handle_starttag, parser.handle_endtag = start, end
        parser.handle_data = lambda data: self.blocks[-1].append(data) if inside[0] else None
        parser.feed(page or "")
        parser.close()
        self.text = "\n".join(t for b in self.blocks if (t := " ".join("".join(b).split())))


def test_html_query_against_another_parser(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()}
    got = {r["page_id"]: r["text"] for r in op10_html.op10_host_suffix_array(spark, sf_dir).collect()}
    assert got == {i: Plain(h).text for i, h in pages.items()} and len(got) > 20


def test_suffix_array_alone_against_brute_force(spark, monkeypatch):
    """Without structure, over hosts of several chunks: blocks four fifths of whose words lie in runs that three distinct pages of the host have go."""
    monkeypatch.setattr(op10_html, "CHUNK_PAGES", 16)
    rnd = random.Random(31)
    rows = []
    for host, n in (("a.org", 150), ("b.org", 9), ("", 4)):
        menus = [prose(rnd, rnd.randint(3, 12)) for _ in range(6)]
        for i in range(n):
            parts = rnd.sample(menus, rnd.randint(0, 3)) + [prose(rnd, rnd.randint(0, 25)) for _ in range(rnd.randint(0, 3))]
            rnd.shuffle(parts)
            rows += [(len(rows), f"http://{host}/{i}" if host else None, "".join(f"<div>{p}</div>" for p in parts))] * rnd.choice([1, 1, 1, 2])
    rows = [(k, u, h) for k, (_, u, h) in enumerate(rows)] + [(10_000, "http://b.org/x", "<p>" + "long " * 20_000)]
    runs = {}
    stream = lambda h: tuple(t for b in re_texts(h + "<") for t in (*b.split(), None))
    of = {k: (None,) + stream(h) if stream(h) else () for k, _, h in rows}
    number = {}
    for k, u, _ in rows:
        me = number.setdefault(of[k], len(number))
        for i in range(len(of[k]) - op10_html.RUN + 1):
            runs.setdefault((op10_html.host_of(u), of[k][i : i + op10_html.RUN]), set()).add(me)
    want = {}
    for k, u, h in rows:
        cover = set()
        for i in range(len(of[k]) - op10_html.RUN + 1):
            if len(runs[op10_html.host_of(u), of[k][i : i + op10_html.RUN]]) >= op10_html.LEAST_PAGES:
                cover |= set(range(i, i + op10_html.RUN))
        at, kept = 1, []
        for b in re_texts(h + "<"):
            w = b.split()
            if w:
                if sum(i in cover for i in range(at, at + len(w))) < 0.8 * len(w):
                    kept.append(" ".join(w))
                at += len(w) + 1
        want[k] = "\n".join(kept)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in op10_html.extract(pages, structure=False).collect()}
    assert got == want and sum(len(t) for t in want.values()) < sum(len(" ".join(re_texts(h + "<"))) for *_, h in rows)


def test_repeated_runs_against_brute_force():
    rnd = random.Random(4)
    for _ in range(60):
        streams = [np.array(rnd.choices(range(1, 4), k=rnd.randint(0, 25))) for _ in range(rnd.randint(1, 7))]
        run, pages = rnd.randint(1, 5), rnd.randint(2, 3)
        where = {}
        for x in {tuple(s.tolist()) for s in streams}:
            for i in range(len(x) - run + 1):
                where.setdefault(x[i : i + run], set()).add(x)
        got = op10_html.repeated_tokens(streams, run, pages)
        for s, cover in zip(streams, got):
            t = tuple(s.tolist())
            want = np.zeros(len(t), bool)
            for i in range(len(t) - run + 1):
                if len(where[t[i : i + run]]) >= pages:
                    want[i : i + run] = True
            assert np.array_equal(cover, want) or len(streams) < pages


def test_extract(spark):
    rnd = random.Random(3)
    shared = ["Welcome to our lovely site of many things", "All rights reserved by the makers of this site"]
    bare = [f"<body><div>{shared[0]}</div><div>{prose(rnd, 20)}</div><p>{prose(rnd, 15)}</p><div>{shared[1]}</div></body>" for _ in range(8)]
    rows = [(i, f"http://h.org/{i}", h, "t") for i, h in enumerate(bare)] + [(20, "http://h.org/a", PAGE, "t"), (21, None, None, "t"), (22, "http://[bad", "", "t"), (None, "x", "<p>hello</p>", "t"), (24, "http://h.org/b", "<nav>only</nav>", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in op10_html.extract(pages).collect()}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got.values())
    for i, h in enumerate(bare):
        assert got[i]["text"] == "\n".join(re_texts(h)[1:3])
    assert got[20]["text"].startswith("A & B\n") and got[21]["text"] == got[22]["text"] == got[24]["text"] == "" and got[None]["text"] == "hello"
    assert op10_html.extract(pages.limit(0)).count() == 0


def test_menus_on_few_pages_of_a_large_host(spark, monkeypatch):
    monkeypatch.setattr(op10_html, "CHUNK_PAGES", 16)
    rnd = random.Random(4)
    menu = "Section menu with links to many other parts"
    own = [" ".join(f"w{rnd.random()}" for _ in range(12)) for _ in range(200)]
    rows = [(i, f"http://h.org/{i}", f"<body><div>{menu}</div><p>{o}</p></body>" if i % 67 == 0 else f"<body><p>{o}</p></body>") for i, o in enumerate(own)]
    rows += [(500 + i, f"http://h.org/copy{i}", f"<body><p>{own[1]}</p></body>") for i in range(5)]
    got = {r["page_id"]: r["text"] for r in op10_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert sum(i % 67 == 0 for i in range(200)) == 3
    assert all(got[i] == o for i, o in enumerate(own)) and all(got[500 + i] == own[1] for i in range(5))


def re_texts(h):
    import re

    return re.findall(r">([^<>]+)<", h)
