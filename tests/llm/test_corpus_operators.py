"""SimHash, line dedup, mixing, classifier, language model, pipeline: brute force and defined cases."""

import ast
import hashlib
import math
import pathlib
import random
import re
import sys
import types
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gradeloom.llm import (
    classifier,
    components,
    line_dedup,
    lm_scoring,
    mixing,
    mixing_model,
    queries,
    simhash,
)
from gradeloom.llm.common import keyed

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "documents embeddings pages benchmark labels conversations".split()
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, **more):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).withColumns({k: F.lit(v) for k, v in more.items()})


def by_duckdb(sql, documents=None):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    if documents is not None:
        con.register("given", documents)
        con.sql("create or replace view documents as select * from given")
    return con.sql(sql)


# --- SimHash ----------------------------------------------------------------------------------


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius=2):
    top = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius and top[i] != top[j]:
                a, b = sorted((top[i], top[j]))
                top = [a if t == b else t for t in top]
    return top


def test_fingerprints_and_groups_as_by_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", "  ", "One", "one", "one two", "É é\x1cx", "a b c d"]
    for _ in range(25):
        words = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(3, 120))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "changed"
            texts.append("  ".join(words))
    found = simhash.near_duplicates(docs(spark, texts, fp=1, first="x")).orderBy("id").collect()
    prints = [brute_fingerprint(t) for t in texts]
    assert [r["fp"] % 2**64 for r in found] == prints
    assert [r["first"]["id"] for r in found] == brute_components(prints)


def test_very_long_texts_are_counted_in_parts():
    text = " ".join(f"w{i % 977}" for i in range(simhash.AT_ONCE + 500))
    assert simhash.fingerprint(text) % 2**64 == brute_fingerprint(text)


@pytest.mark.parametrize("nodes", [2, 5, 10_000])
def test_links_connect_all_that_is_near_however_shards_are_cut(spark, nodes):
    rng = random.Random(6)
    values = {rng.getrandbits(64) for _ in range(30)}
    for v in list(values):
        for _ in range(6):
            v ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4)))
            values.add(v)
    # A dense place: all within few bits of each other.
    values |= {0xFFFF0000FFFF0000 ^ i for i in range(40)}
    values = sorted(values)
    df = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fp long")
    links = simhash.linked(df, nodes).collect()
    assert all(((r["a"] ^ r["b"]) % 2**64).bit_count() <= 2 for r in links)
    roots = {r["a"]: r["b"] for r in components.components(simhash.linked(df, nodes)).collect()}
    signed = [v - 2**64 if v >> 63 else v for v in values]
    groups = brute_components(values)
    by_group: dict = {}
    for v, g in zip(signed, groups, strict=True):
        by_group.setdefault(g, set()).add(roots.get(v, v))
    assert all(len(r) == 1 for r in by_group.values()) and len({*map(min, by_group.values())}) == len(by_group)


def test_a_tree_finds_what_is_near():
    rng = random.Random(7)
    values = [rng.getrandbits(8) for _ in range(200)]
    values = list(dict.fromkeys(values))
    tree = simhash.Tree(values[0])
    for v in values[1:]:
        tree.add(v)
    for radius in (0, 1, 2, 3):
        assert sorted(tree.near(5, radius)) == sorted(v for v in values if (v ^ 5).bit_count() <= radius)


def test_a_chain_is_one_component(spark):
    links = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    found = components.components(links).collect()
    assert len(found) == 299 and {r["b"] for r in found} == {0}
    assert components.components(links.where("a < 0")).collect() == []


def test_one_of_each_group_stays(spark):
    texts = ["p q r s t u", "P  q r s t u", "something else entirely here", "", None]
    df = docs(spark, texts, first="x", fp=2)
    twice = df.unionAll(df).unionAll(docs(spark, ["p q r s t u"], first="x", fp=2).withColumn("doc_id", F.lit(None).cast("long")))
    kept = simhash.one_of_each(twice)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3]
    assert simhash.one_of_each(df.limit(0)).collect() == []


# --- line dedup -------------------------------------------------------------------------------


def brute_lines(texts, least):
    """Deletes what stood before, by looking at every run of lines.

    A run counts if it has `least` words, but not without its first line or not
    without its last. Of its occurrences those that don't touch the first go.
    """
    every = []
    for t in texts:
        split = [] if t is None else t.split("\n")
        every.append([(i, x) for i, x in enumerate(split) if re.search(r"[^\x20\x09-\x0D]", x)])
    size = lambda run: sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for _, x in run)
    first, gone = {}, [set() for _ in texts]
    for d, lines in enumerate(every):
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                run = lines[i:j]
                if size(run) < least or size(run[1:]) >= least and size(run[:-1]) >= least:
                    continue
                e, k = first.setdefault(tuple(x for _, x in run), (d, i))
                if (e, k) != (d, i) and not (e == d and i < k + len(run)):
                    gone[d].update(p for p, _ in run)
    return [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in g) for t, g in zip(texts, gone, strict=True)]


def test_a_run_that_overlaps_itself_keeps_its_first_copy(spark):
    line = "five words in every line"
    texts = ["\n".join([line] * 30), "\n".join([line] * 15) + "\nq", "\n".join(["a b c d e", "f g h i j"] * 14)]
    new = {r["_row"]["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert new[0]["text"] == "\n".join([line] * 10) and new[1]["text"] == "q"
    assert new[2]["text"] == "\n".join(["a b c d e", "f g h i j"] * 5)
    alone = line_dedup.dedup_lines(docs(spark, ["\n".join([line] * 19)])).first()
    assert alone["removed"] is None and alone["text"].count(line) == 19


@pytest.mark.parametrize("least", [1, 3, 7])
def test_later_copies_go_as_by_brute_force(spark, least):
    rng = random.Random(least)
    lines = ["a", "b b", "c c c", "", "  ", "d d", "e e e e e e e e"] + [f"only {i}" for i in range(5)]
    texts = [None, "", "\n\n", "a\n" * 12]
    texts += ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 14))) for _ in range(30)]
    new = line_dedup.dedup_lines(docs(spark, texts, seq=1, pos="x", removed=2), least_words=least)
    found = {r["_row"]["doc_id"]: r["text"] for r in new.collect()}
    assert [found[i] for i in range(len(texts))] == brute_lines(texts, least)


def test_repeated_rows_count_once_and_are_changed_alike(spark):
    one = docs(spark, ["x y z\nonly here", "x y z"])
    new = line_dedup.replaced(one.unionAll(one), least_words=2)
    assert new.schema == one.schema
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in new.collect()) == [(0, "x y z\nonly here", 15)] * 2 + [(1, "", 0)] * 2
    assert line_dedup.replaced(one.limit(0)).collect() == []


def test_ids_order_the_copies_and_null_is_last(spark):
    df = spark.createDataFrame([(None, "x y z"), (9, "x y z"), (10, "x y z"), (2, "x y z\nq")], "doc_id bigint, text string")
    new = line_dedup.replaced(df, least_words=3).collect()
    assert {r["doc_id"]: r["text"] for r in new} == {None: "", 9: "", 10: "", 2: "x y z\nq"}


def test_ranks_are_places_in_the_suffix_array(spark):
    rng = random.Random(8)
    df = docs(spark, ["\n".join(rng.choice("ab") for _ in range(20)) for _ in range(6)])
    lines = line_dedup.numbered_lines(line_dedup.packed(df, ["doc_id", "text"]), "doc_id", "text")
    ranks = line_dedup.repeated_positions(lines)
    for level in range(3):
        ranks = line_dedup.doubled(ranks, level)
    rows = ranks.orderBy("id", "seq").collect()
    letters = {r["r0"] for r in rows}
    text: dict = {}
    for r in rows:
        text.setdefault(r["id"], []).append(r["r0"])
    for level in range(4):
        prefix = {(r["id"], r["seq"]): tuple(text[r["id"]][r["seq"] : r["seq"] + 2**level]) for r in rows}
        order = sorted(prefix.values())
        assert all(r[f"r{level}"] == 1 + order.index(prefix[r["id"], r["seq"]]) for r in rows)
    assert len(letters) == 2


# --- mixing -----------------------------------------------------------------------------------


def filled(sizes, weights, percent, most):
    """Targets by raising all sources together until each stops."""
    left, open_, target = sum(sizes) * percent / 100, set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        price = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if weights[i] * price > most * sizes[i]}
        if not over:
            for i in open_:
                target[i] = weights[i] * price
            break
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_are_shared_by_weight_up_to_the_limit(spark, seed):
    rng = random.Random(seed)
    names = sorted(f"s{i}é" for i in range(7)) + [None]
    sizes = [rng.choice([0, 5, 50, 1000, 30000]) for _ in names]
    df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, size long")
    found = {r["source"]: r["target"] for r in mixing.targets(df, mixing.Mix()).collect()}
    expected = filled(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 150, 2)
    assert [found[n] for n in names] == pytest.approx(expected)


def sized(spark, n, at_once):
    rng = random.Random(n)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([0, 3, 3, 3, rng.randrange(1, 200)]), i, i, i) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, source string, size long, tie long, _k1 long, _k2 long")
    return mixing.sampled(df, mixing.Mix(at_once=at_once)).orderBy("id").collect()


def test_takes_come_near_targets_and_parts_change_nothing(spark):
    one, many = sized(spark, 600, 100_000), sized(spark, 600, 2)
    assert one == many
    taken, target, largest = Counter(), {}, Counter()
    for r in one:
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in target)


def test_the_mix_repeats_documents_with_all_their_columns(spark):
    texts = [None, "", "one", "two words", "three words here"] * 4
    df = docs(spark, texts, copy="old", size=1, target="x", hash="h").withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.col("source")))
    mix = mixing.mix_sources(df.unionAll(df.where("doc_id = 4")))
    assert mix.columns == df.columns[: df.columns.index("copy")] + [c for c in df.columns[df.columns.index("copy") + 1 :]] + ["copy"]
    rows = mix.collect()
    assert sorted(rows, key=str) == sorted(mixing.mix_sources(df.unionAll(df.where("doc_id = 4"))).collect(), key=str)
    copies = Counter(r["doc_id"] for r in rows)
    assert all(sorted(r["copy"] for r in rows if r["doc_id"] == d) == list(range(1, n + 1)) for d, n in copies.items())
    words = sum(len((r["text"] or "").split()) for r in rows)
    assert words == pytest.approx(1.5 * sum(len((t or "").split()) for t in [*texts, texts[4]]), abs=6)
    assert mixing.mix_sources(df.limit(0)).collect() == []
    only_empty = mixing.mix_sources(docs(spark, [None, ""])).collect()
    assert only_empty == []


def test_rows_that_differ_in_other_columns_only_stay_apart_in_the_mix(spark):
    df = docs(spark, ["a b c d", "a b c d", "e f", "g h i"]).withColumns({"doc_id": F.lit(7).cast("long"), "source": F.lit("s")})
    df = df.withColumn("lang", F.concat(F.lit("l"), F.monotonically_increasing_id().cast("string"))).withColumn("a.b", F.lit(1))
    got = [r["lang"] for r in mixing.mix_sources(df, mixing.Mix(percent=100)).collect()]
    assert sorted(got) == sorted(r["lang"] for r in df.collect())


# --- classifier -------------------------------------------------------------------------------


def test_the_network_learns_and_its_probabilities_are_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 6))
    p = 1 / (1 + np.exp(-3 * x[:, 0] + 2 * np.abs(x[:, 1])))
    y = (rng.random(4000) < p).astype(float)
    network = classifier.Network(x[:3000], y[:3000], classifier.Training())
    found = network(x[3000:])
    assert np.mean((found >= 0.5) == (p[3000:] >= 0.5)) > 0.9
    for low in (0.1, 0.3, 0.5, 0.7):
        near = (found >= low) & (found < low + 0.2)
        assert abs(found[near].mean() - p[3000:][near].mean()) < 0.1


def test_quality_is_told_on_rows_that_were_not_learned_from(spark):
    found = queries.QUERIES["op3_quality_classifier"](spark, LARGER).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in labels]
    assert len(held) >= 50 and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)


def test_held_out_labels_change_no_score(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = classifier.remainder("doc_id", 5) == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    documents = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    one, two = (
        sorted(map(tuple, classifier.scored(documents, classifier.learnable(x)).collect())) for x in (labels, turned)
    )
    assert one == two


def test_scores_without_labels_texts_or_rows(spark):
    texts = [None, "", "word " * 3000, "clean text", "clean text"]
    none = spark.createDataFrame([(0, None)], "doc_id bigint, quality int")
    found = classifier.scored(docs(spark, texts, vector="x", score=1), none).collect()
    assert [r["score"] for r in found] == [0.5] * 5
    ones = spark.createDataFrame([(3, 1), (3, 1), (4, 7)], "doc_id bigint, quality int")
    assert {r["score"] for r in classifier.scored(docs(spark, texts), ones).collect()} == {1.0}
    assert classifier.scored(docs(spark, []), ones).collect() == []
    df = docs(spark, texts, vector="x", score=1)
    kept = classifier.good_documents(df, ones)
    assert kept.schema == df.schema and kept.count() == 5


def test_labels_without_a_document_or_repeated_take_no_place_in_the_sample(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["good", "fine", "nice"] if i % 2 else ["spam", "buy", "win"]) for _ in range(30)) for i in range(60)]
    df, how = docs(spark, texts), classifier.Training(sample=60)
    labels = [(i, i % 2) for i in range(60)]
    more = [(i, i % 2) for i in range(1000, 6000)] + labels * 50
    found = [
        {r["id"]: r["score"] for r in classifier.scored(df, spark.createDataFrame(x, "doc_id long, quality int"), how).collect()}
        for x in (labels, labels + more)
    ]
    assert found[0] == pytest.approx(found[1])


def test_shapes_tell_kinds_of_words_apart():
    assert [classifier.shape(w) for w in ("word", "Word,", "ABC!!", "a1b22", "x***", "|", "Éé")] == ["a", "Aa,", "A!", "a0a0", "a*", "|", "Aa"]


# --- language model ---------------------------------------------------------------------------


def test_probabilities_of_all_symbols_add_up_to_one():
    rng = np.random.default_rng(2)
    symbols = rng.integers(0, 6, 3000)
    codes = mixing_model.huffman(np.bincount(symbols, minlength=7))
    totals = [np.zeros(2 << size, np.int64) for size in mixing_model.TOKEN_SIZES]
    hashes, _ = mixing_model.token_contexts(symbols, 6, np.array([0]))
    mixing_model.count(totals, mixing_model.TOKEN_SIZES, codes, symbols, hashes)
    model = mixing_model.model_of(codes, mixing_model.TOKEN_SIZES, totals, mixing_model.TOKEN_GATES)
    total = 0.0
    for last in range(7):
        text = np.array([1, 2, 3, last])
        hashes, gate = mixing_model.token_contexts(text, 6, np.array([0]))
        found, _ = mixing_model.log_probabilities(model, text, hashes, gate, block=2)
        total += 10 ** found[-1]
    assert total == pytest.approx(1, abs=1e-4)


def test_contexts_do_not_reach_over_texts_or_words():
    a, b = np.array([1, 2, 9, 3]), np.array([9, 9, 1])
    both, _ = mixing_model.token_contexts(np.concatenate([a, b]), 9, np.array([0, 4]))
    alone, _ = mixing_model.token_contexts(b, 9, np.array([0]))
    assert all((x[4:] == y).all() for x, y in zip(both, alone, strict=True))
    symbols, starts = mixing_model.spelled([b"one", b"", b"two"])
    both, _ = mixing_model.spell_contexts(symbols, starts)
    symbols, starts = mixing_model.spelled([b"two"])
    alone, _ = mixing_model.spell_contexts(symbols, starts)
    assert all((x[-4:] == y).all() for x, y in zip(both, alone, strict=True))


def test_weights_follow_the_text():
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 3, 4000)
    codes = mixing_model.huffman(np.array([5, 5, 5, 5]))
    totals = [np.zeros(2 << size, np.int64) for size in mixing_model.TOKEN_SIZES]
    hashes, gate = mixing_model.token_contexts(symbols, 3, np.array([0]))
    mixing_model.count(totals, mixing_model.TOKEN_SIZES, codes, symbols, hashes)
    model = mixing_model.model_of(codes, mixing_model.TOKEN_SIZES, totals, 2)
    fixed, _ = mixing_model.log_probabilities(model, symbols, hashes, gate)
    moving, weights = mixing_model.log_probabilities(model, symbols, hashes, gate, block=100)
    assert moving.sum() > fixed.sum() and not np.allclose(weights[0], model["weights"])
    assert moving[:100] == pytest.approx(fixed[:100], rel=1e-4)


def test_texts_are_scored_alike_together_alone_and_in_stretches():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 5, n) for n in (1, 30, 7, 400, 2, 90)]
    codes = mixing_model.huffman(np.array([9, 5, 5, 2, 1]))
    totals = [np.zeros(2 << size, np.int64) for size in mixing_model.TOKEN_SIZES]
    joined = np.concatenate(texts)
    hashes, _ = mixing_model.token_contexts(joined, 4, np.array([0]))
    mixing_model.count(totals, mixing_model.TOKEN_SIZES, codes, joined, hashes)
    model = mixing_model.model_of(codes, mixing_model.TOKEN_SIZES, totals, mixing_model.TOKEN_GATES)
    together = mixing_model.text_scores(model, texts, 4, 10)
    assert together == pytest.approx([mixing_model.text_scores(model, [t], 4, 10)[0] for t in texts], rel=1e-4)
    assert mixing_model.text_scores(model, texts, 4, 10, at_once=95)[:3] == pytest.approx(together[:3], rel=1e-4)
    # A stretch ends without a last move of the weights, so long texts differ a little.
    assert mixing_model.text_scores(model, texts, 4, 10, at_once=95) == pytest.approx(together, rel=0.02)


def test_long_texts_are_scored_as_if_in_one_stretch():
    rng = np.random.default_rng(3)
    codes = mixing_model.huffman(np.arange(1, 41))
    totals = [rng.integers(0, 9, 2 << size) for size in mixing_model.TOKEN_SIZES]
    model = mixing_model.model_of(codes, mixing_model.TOKEN_SIZES, totals, mixing_model.TOKEN_GATES)
    text = rng.integers(0, 40, 3000)
    whole, parts = (mixing_model.text_scores(model, [text], 39, 128, at_once)[0] for at_once in (4096, 512))
    assert math.isclose(whole, parts, rel_tol=1e-6)


def test_copies_cost_what_a_walk_says():
    words = [b"a", b"b", b"a", b"c", b"c", b"c", b"a", b"d"]
    total, seen, copies = 0.0, [], 0
    for i, w in enumerate(words):
        p = (copies + lm_scoring.COPIES) / (i + lm_scoring.OF)
        total += math.log10(p / len(seen)) if w in seen else math.log10(1 - p)
        copies += w in seen
        seen += [w] * (w not in seen)
    cost, new, times = lm_scoring.copy_costs(words)
    assert cost == pytest.approx(total) and new.tolist() == [True, True, False, True, False, False, False, True]
    assert times.tolist() == [3, 1, 3, 1] and lm_scoring.copy_costs([])[0] == 0


def test_copies_of_several_texts_cost_what_each_costs_alone():
    rng = np.random.default_rng(6)
    texts = [rng.integers(0, 9, n) for n in (7, 0, 1, 30, 0)]
    starts = np.cumsum([0, *map(len, texts[:-1])])
    cost, new, times = lm_scoring.copy_costs(np.concatenate(texts), starts)
    alone = [lm_scoring.copy_costs(t) for t in texts]
    assert cost == pytest.approx(np.concatenate([a[0] for a in alone]))
    assert new.tolist() == [x for a in alone for x in a[1]] and times.tolist() == [x for a in alone for x in a[2]]


def test_bits_of_a_context_that_is_always_the_same_are_counted_as_one_by_one():
    rng = np.random.default_rng(8)
    symbols = rng.integers(0, 40, 20_000)
    codes = mixing_model.huffman(np.arange(1, 42))
    hashes, _ = mixing_model.token_contexts(symbols, 40, np.array([0, 900]))
    totals, sizes = [np.zeros(2 << size, np.int64) for size in mixing_model.TOKEN_SIZES], mixing_model.TOKEN_SIZES
    mixing_model.count(totals, sizes, codes, symbols, hashes)
    k = 0x9E3779B97F4A7C15
    for total, size, h in zip(totals, sizes, hashes, strict=True):
        expected = Counter()
        for s, c in zip(symbols.tolist(), h.tolist(), strict=True):
            for i in range(codes["starts"][s], codes["starts"][s + 1]):
                slot = (c + int(codes["keys"][i])) * k % 2**64 >> 64 - size
                expected[slot * 2 + int(codes["bits"][i])] += 1
        assert {int(i): int(total[i]) for i in np.flatnonzero(total)} == expected


def batch_of(texts, **more):
    more = {name: pa.array(values) for name, values in more.items()}
    return pa.RecordBatch.from_arrays([*more.values(), pa.array(texts, pa.string())], [*more, "text"])


def test_words_are_split_together_as_one_by_one(monkeypatch):
    texts = [" A  b\tC ", "", None, "\n\x0b\x0c\r", "\x1cx\x85y\xa0z\u2003\x00 \u00c9\u0130 I", "b b a"] * 5
    monkeypatch.setattr(lm_scoring, "TEXTS", 4)
    monkeypatch.setattr(lm_scoring, "BYTES", 30)
    monkeypatch.setattr(lm_scoring, "COUNTED", 3)
    batch, learned = batch_of(texts), [i % 4 != 1 for i in range(len(texts))]
    column, found, at = batch.column(0), [], 0
    for a, b in lm_scoring.slices(column):
        words, places, lengths = lm_scoring.split(column.slice(a, b - a))
        words = [words[i].as_py().encode() for i in places.tolist()]
        ends = np.cumsum(lengths).tolist()
        found += [words[e - n : e] for e, n in zip(ends, lengths.tolist(), strict=True)]
        assert a == at and 0 < b - a <= 4
        at = b
    assert at == len(texts) and found == [lm_scoring.words_of(t or "") for t in texts]
    expected = Counter()
    for ws, use in zip(found, learned, strict=True):
        expected.update({w.decode(): 0 for w in ws})
        expected.update(w.decode() for w in [*ws, b""] if use)
    counted = Counter()
    batch = pa.RecordBatch.from_arrays([column, pa.array(learned)], ["text", "learned"])
    for rows in lm_scoring.counting([batch, batch]):
        for word, n in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            counted[word] += n
    assert counted == {w: 2 * n for w, n in expected.items()}


def test_no_step_of_scoring_or_counting_takes_the_words_one_by_one():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)] + [""]
    codes = mixing_model.huffman(np.arange(1, 12))
    totals = [rng.integers(0, 9, 2 << size) for size in mixing_model.TOKEN_SIZES]
    model = mixing_model.model_of(codes, mixing_model.TOKEN_SIZES, totals, mixing_model.TOKEN_GATES)
    known = {"tokens": model, "words": words, "counts": np.full(41, 3), "frequent": 10, "mixed": np.full(31, -2.0)}

    def calls(n):
        texts = [" ".join(f"w{i}" for i in rng.integers(0, 3000, n)) for _ in range(5)]
        counted = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([True] * 5)], ["text", "learned"])
        scored = batch_of(texts, id=range(5), row=range(5))
        made = 0

        def seen(frame, event, arg):
            nonlocal made
            made += event in ("call", "c_call")

        sys.setprofile(seen)
        try:
            list(lm_scoring.counting([counted]))
            list(lm_scoring.scoring(types.SimpleNamespace(value=known))([scored]))
        finally:
            sys.setprofile(None)
        return made

    calls(10)
    assert calls(500) < calls(100) + 200


def test_base_scores_are_the_formula_and_the_model_beats_them(spark):
    found = queries.QUERIES["op8_lm_scoring"](spark, LARGER).collect()
    rows = spark.read.parquet(f"{LARGER}/documents.parquet").collect()
    tokens = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), b""] for r in rows}
    fold = {d: zlib.crc32(str(d).encode()) % 10 for d in tokens}
    counts = Counter(t for d, ts in tokens.items() if fold[d] for t in ts)
    n, v = sum(counts.values()), len(counts)
    for r in found:
        own = tokens[r["doc_id"]]
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[t] > 0 for t in own), n)
        assert r["held_out"] == (fold[r["doc_id"]] == 0) and r["score"] < 0 and r["bits_per_byte"] > 0
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_held_out_texts_teach_nothing(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    held = lm_scoring.remainder("doc_id", 10) == 0
    other = df.where(~held).unionAll(df.where(held).withColumn("text", F.lit("quite another text")))
    one, two = ({r["id"]: r["score"] for r in lm_scoring.lm_scores(x).collect()} for x in (df, other))
    kept = [r["doc_id"] for r in df.where(~held).collect()]
    assert kept and all(one[d] == pytest.approx(two[d]) for d in kept)


def test_what_weights_are_fitted_on_and_what_is_not_drawn_for_it_is_counted(spark, monkeypatch):
    for name, value in (("KEPT_BACK", 2), ("FITTED", 5), ("FITTED_WORDS", 7), ("FREQUENT", 20)):
        monkeypatch.setattr(lm_scoring, name, value)
    made, given = [], mixing_model.logits_of
    monkeypatch.setattr(mixing_model, "logits_of", lambda totals: made.append([t.copy() for t in totals]) or given(totals))
    texts = [" ".join(f"w{(i * i + j) % 90}" for j in range(20)) for i in range(60)]
    rows = keyed(docs(spark, texts).select(F.col("doc_id").alias("id"), "text"), ["id", "text"])
    words = Counter(w for t in texts for w in t.split()) + Counter({"": len(texts)})
    known = lm_scoring.trained(rows, spark.createDataFrame(list(words.items()), "word string, n long"))
    _, tokens, _, spelling = made
    codes, numbers = known["tokens"]["codes"], lm_scoring.numbers_of(known["words"][: known["frequent"]])
    symbols = np.concatenate([lm_scoring.symbols_of(lm_scoring.words_of(t), numbers, known["frequent"]) for t in texts])
    assert all(t.sum() == np.diff(codes["starts"])[symbols].sum() for t in tokens)
    codes = known["spelling"]["codes"]
    symbols, _ = mixing_model.spelled([w.encode() for w in words if w.encode() not in numbers])
    assert all(t.sum() == np.diff(codes["starts"])[symbols].sum() for t in spelling)


def test_no_part_of_the_model_comes_from_a_sample(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "FREQUENT", 20)
    texts = [" ".join(f"w{(i * i + j) % 90}" for j in range(20)) for i in range(300)]
    rows = keyed(docs(spark, texts).select(F.col("doc_id").alias("id"), "text"), ["id", "text"])
    words = Counter(w for t in texts for w in t.split()) + Counter({"": len(texts)})
    counts = spark.createDataFrame([*words.items(), ("heldout", 0)], "word string, n long")
    made, given = [], getattr(mixing_model, "pairs_of", None)
    if given:
        monkeypatch.setattr(mixing_model, "pairs_of", lambda totals, parents: made.append([t.copy() for t in totals]) or given(totals, parents))
    known = lm_scoring.trained(rows, counts)
    # All weights start alike, and the tables are those of all texts and words.
    for model in (known["tokens"], known["spelling"]):
        assert np.ptp(model["weights"], axis=0).max() == 0
    tokens, spelling = made
    codes, numbers = known["tokens"]["codes"], lm_scoring.numbers_of(known["words"][: known["frequent"]])
    symbols = np.concatenate([lm_scoring.symbols_of(lm_scoring.words_of(t), numbers, known["frequent"]) for t in texts])
    assert all(t.sum() == np.diff(codes["starts"])[symbols].sum() for t in tokens)
    symbols, _ = mixing_model.spelled([w.encode() for w in words if w.encode() not in numbers])
    assert all(t.sum() == np.diff(known["spelling"]["codes"]["starts"])[symbols].sum() for t in spelling)


def test_rare_words_are_scored_alike_joined_or_looked_up(spark, monkeypatch):
    texts = ["a b c d e f g h", "a b zz zz q", "b b b x1 x2 x3", None, ""] * 8
    monkeypatch.setattr(lm_scoring, "FREQUENT", 3)
    whole = sorted(map(tuple, lm_scoring.lm_scores(docs(spark, texts)).collect()))
    monkeypatch.setattr(lm_scoring, "LOCAL", 4)
    joined = sorted(map(tuple, lm_scoring.lm_scores(docs(spark, texts, word="x", row=1, n=2)).collect()))
    assert [r[:5] for r in whole] == [r[:5] for r in joined]
    assert [r[5] for r in whole] == pytest.approx([r[5] for r in joined])


def test_scores_of_no_training_and_of_nothing(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    df = docs(spark, ["x y x"]).withColumn("doc_id", F.lit(held).cast("long"))
    r = lm_scoring.lm_scores(df.unionAll(df)).collect()[0]
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (4, 0, 0) and r["score"] < 0
    assert r["base_score"] == pytest.approx(0)
    assert lm_scoring.lm_scores(docs(spark, [])).collect() == []


# --- all together -----------------------------------------------------------------------------


def test_the_pipeline_is_its_stages_as_by_brute_force(spark):
    got = corpus_pipeline.run(spark, SF).toPandas()
    scores = queries.QUERIES["op3_quality_classifier"](spark, SF).where("predicted = 1").select("doc_id").toPandas()
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    kept = by_duckdb("select * from documents").df().merge(scores, on="doc_id")[columns]
    assert 0 < len(kept) < spark.read.parquet(f"{SF}/documents.parquet").count()
    new = by_duckdb(line_dedup.OP6_SQL, kept).df().set_index("doc_id")["text"]
    kept["text"] = kept["doc_id"].map(new)
    kept["n_chars"] = kept["text"].map(len)
    kept = kept.sort_values("doc_id").reset_index(drop=True)
    groups = brute_components([brute_fingerprint(t) for t in kept["text"]])
    kept = kept[[g == i for i, g in enumerate(groups)]]
    hit = by_duckdb(queries.ORACLES["op7_decontamination"], kept).df().set_index("doc_id")["contaminated"]
    kept = kept[~kept["doc_id"].map(hit)]
    copies = by_duckdb(mixing.OP9_SQL, kept).df().set_index("doc_id")["copies"]
    expected = [(*r, c) for r in kept.itertuples(index=False, name=None) for c in range(1, copies[r[0]] + 1)]
    assert list(got.columns) == [*columns, "copy"]
    assert sorted(got.itertuples(index=False, name=None)) == sorted(expected) and len(expected) > 20


def test_stages_give_the_columns_of_the_documents_and_bear_odd_rows(spark):
    odd = docs(spark, [None, "", "word " * 4000, "same text here", "same text here"], _k1=1, copy=3, score=2)
    odd = odd.unionAll(odd).withColumn("source", F.when(F.col("doc_id") != 2, F.col("source")))
    for _, stage in corpus_pipeline.STAGES:
        result, empty = stage(spark, odd, SF), stage(spark, odd.limit(0), SF)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert result.schema == odd.schema and empty.schema == odd.schema
        assert result.count() > 0 and empty.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_give_the_rows_of_their_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    expected = by_duckdb(queries.ORACLES[name]).df()
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    rows = [sorted(map(repr, x[columns].itertuples(index=False, name=None))) for x in (df.toPandas(), expected)]
    assert rows[0] == rows[1] and rows[0]


def test_nothing_else_imports_the_folder():
    root = pathlib.Path(__file__).resolve().parents[2]
    ours = {root / "gradeloom" / "llm", root / "tests" / "llm"}
    for path in root.rglob("*.py"):
        if ours & set(path.parents) or path.name in ("__spark_entry__.py", "corpus_pipeline.py"):
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("gradeloom.llm") or n == "corpus_pipeline" for n in names), path


def test_digests_are_lower_case_hex(spark):
    row = queries.QUERIES["op10_chat_format"](spark, SF).where("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert row["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and row["loss_chars"] == len(said)
