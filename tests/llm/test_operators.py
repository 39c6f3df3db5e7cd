"""Operators against brute force on documents with nulls, empty and very long
texts, repeated rows, ties and columns whose names clash."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphshift.llm import bpe_trie, decontaminate, html_extract, license_scan, queries, sharding, simhash_dedup, substring_dedup, token_store, topk, toxicity

from . import brute

KIND = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("score", T.StringType()), ("row_id", T.StringType()), ("fp", T.StringType()))])


def texts() -> list[tuple]:
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, page = say(60), say(200)
    out = [say(r.randint(1, 120)) for _ in range(60)]
    out += [page] * 5 + [page.replace(page.split()[100], "zz", 1), page.replace(page.split()[7], "yy", 1), page.upper()]
    out += [f"{say(40)} {passage}\n{say(30)}" for _ in range(12)] + [passage, f"{passage} {passage}"]
    out += ["", " \t\n", "one", "a b c", "a b c d", None, None, "x " * 40, "ab " * 3000, say(20_000)]
    out += ["Ünïcödé ÉÈ ß ﬁ é", "日本語 😀 テスト", "<|endoftext|> tail <|startoftext|>", "don't I'LL 12 3,4", "nul\x00 mid\x1f", "  two  spaces \n"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else "hot", len(t or ""), "clash", "clash", "clash") for i, t in enumerate(out)]
    return rows + [rows[3], rows[3], (None, "null id", None, None, None, None, None, None), (None, page, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), KIND).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def plain(docs) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def rows(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=str)


def same(df, expected) -> None:
    assert rows(df) == sorted(expected, key=str)


def test_substring_dedup(docs, none):
    done = substring_dedup.remove_repeats(docs)
    assert done.columns == [*docs.columns, "n_words", "n_removed"]
    same(done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256)), brute.repeats(plain(docs)))
    assert substring_dedup.remove_repeats(none).count() == 0


def test_substring_dedup_keeps_the_source(docs):
    done = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs, join="source").collect() if r["doc_id"] is not None}
    for d, t in plain(docs):
        if d is not None and not done[d]["n_removed"]:
            assert done[d]["text"] == t


@pytest.mark.parametrize("n", [3, 8, 35])
def test_substring_dedup_lengths(spark, n):
    r = random.Random(n)
    some = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 60)))) for i in range(40)]
    done = substring_dedup.remove_repeats(spark.createDataFrame(some, "doc_id long, text string"), n)
    same(done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256)), brute.repeats(some, n))


def test_substring_dedup_counts_levels(spark):
    """What repeats at 9 or 18 words alone is no repeat; what does at 35 is one,
    long repeats and those at the ends of texts too."""
    assert substring_dedup.levels(35) == [9, 18, 35] and substring_dedup.levels(3) == [2, 3]
    r = random.Random(13)
    say = lambda n: [f"w{r.randrange(4000)}" for _ in range(n)]
    shared = {n: say(n) for n in (9, 17, 18, 30, 34, 35, 36, 60, 200)}
    some = []
    for i in range(120):
        body = say(r.randint(0, 40))
        for n in r.sample(list(shared), 2):
            body += shared[n] + say(r.randint(0, 30))
        some.append((i, " ".join(body)))
    done = substring_dedup.remove_repeats(spark.createDataFrame(some, "doc_id long, text string"))
    expected = brute.repeats(some)
    assert any(0 < removed < total for _, total, removed, _ in expected)
    same(done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256)), expected)


def test_simhash(docs, none):
    found = simhash_dedup.near_duplicates(docs)
    same(found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id"), brute.simhash(plain(docs)))
    assert simhash_dedup.near_duplicates(none).count() == 0
    kept = simhash_dedup.kept_documents(docs)
    assert kept.columns == docs.columns
    groups = {c for _, _, c in brute.simhash(plain(docs))}
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(groups, key=str)


def test_simhash_links_lose_none():
    import numpy as np

    r = np.random.default_rng(3)
    base = r.integers(0, 2**64, 20, dtype=np.uint64)
    fps = list(base)
    for _ in range(400):
        flips = r.choice(64, r.integers(1, 6), replace=False)
        fps.append(np.uint64(fps[r.integers(len(fps))] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64))))
    fps = np.unique(np.array(fps, np.uint64))
    keys = simhash_dedup.pivot_keys(fps)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4):
            assert (keys[i] == keys[j]).any()
    links = simhash_dedup.group_links(fps)
    label = {int(x): int(x) for x in fps}
    root = lambda x: x if label[x] == x else root(label[x])
    for a, b in links:
        label[root(a)] = root(b)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4):
            assert root(int(fps[i])) == root(int(fps[j]))


@pytest.mark.parametrize("hot", [0, 2, 1024])
def test_simhash_hot_keys(spark, hot):
    """Keys of very many fingerprints are split without losing a link."""
    import numpy as np

    g = np.random.default_rng(6)
    base = g.integers(0, 2**64, 6, dtype=np.uint64)
    fps = list(base)
    for _ in range(300):
        fps.append(np.uint64(fps[g.integers(len(fps))] ^ np.bitwise_or.reduce(np.uint64(1) << g.choice(64, g.integers(1, 6), replace=False).astype(np.uint64))))
    fps = np.unique(np.array(fps, np.uint64))
    near = simhash_dedup.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), hot).collect()
    group = {int(x): int(x) for x in fps.view(np.int64)}
    root = lambda x: x if group[x] == x else root(group[x])
    for u, v in near:
        assert (u ^ v).bit_count() <= 4 or ((u ^ v) & (1 << 64) - 1).bit_count() <= 64
        group[root(u)] = root(v)
    for i, x in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(fps ^ x) <= 4):
            assert root(int(fps.view(np.int64)[i])) == root(int(fps.view(np.int64)[j]))


def test_token_store(docs, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.BYTE_BPE)
    got = token_store.stored(docs, path, with_ids=True).collect()
    tok = Tokenizer.from_file(path)
    order = sorted(plain(docs), key=lambda x: (x[0] is not None, x[0] or 0))
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for d, t in order if d is not None}
    assert len(got) == len(order)
    assert all(r["token_ids"] == ids[r["doc_id"]] for r in got if r["doc_id"] is not None)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    known = lambda x: [r for r in x if r[0] is not None]
    assert sorted(known((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got)) == sorted(known(brute.token_store(plain(docs), tok)))
    assert token_store.stored(none, path).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 300])
def test_huffman(n):
    import numpy as np

    r = np.random.default_rng(n)
    ids = np.minimum(r.geometric(0.02, 5000), n).astype(np.int64)
    counts = dict(zip(*(x.tolist() for x in np.unique(ids, return_counts=True))))
    lengths = token_store.code_lengths(counts, 10)
    assert max(lengths.values()) <= 10 and sum(2.0 ** -b for b in lengths.values()) <= 1
    codes, bits, slot_id, slot_bits = token_store.canonical(lengths)
    for size in (0, 1, 511, 512, 513, 5000):
        stream, at = token_store.encode(ids[:size], codes, bits)
        assert (token_store.decode(stream, at, size, slot_id, slot_bits) == ids[:size]).all()


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.WORD_BPE)
    done = bpe_trie.encoded(docs, path)
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    same(done.select("doc_id", "n_tokens", sha("token_ids"), sha("decoded")), brute.bpe(plain(docs), Tokenizer.from_file(path)))
    assert done.where(F.size(bpe_trie.id_array()) != F.col("n_tokens")).isEmpty()
    assert bpe_trie.encoded(none, path).count() == 0


def test_bpe_of_any_word():
    codec = bpe_trie.Codec(queries.tokenizer_path(queries.WORD_BPE))
    r = random.Random(1)
    words = ["".join(r.choice("etaoinshrdluaaaa") for _ in range(r.randint(1, 14))) for _ in range(3000)]
    got = codec.bpe.encode_words(words)
    assert all(got[w] == codec.bpe.merged(w) for w in words)
    assert codec.decode([320, 10**9]) == codec.token[320]


def test_sharding(docs, none):
    done = sharding.interleave(docs)
    same(done.select("doc_id", "size", "text_crc32", "shard", "slot"), brute.shards([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]))
    counts = [r["count"] for r in done.groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1
    assert sharding.interleave(none).count() == 0


def test_sharding_writes(docs, spark, tmp_path):
    own = docs.withColumn("shard", F.lit("x")).withColumn("_piece", F.lit("y"))
    placed = sharding.interleave(own, 4)
    sharding.write_shards(own, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    count = lambda df: sorted(map(tuple, df.groupBy("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))).count().collect()), key=str)
    assert count(back) == count(docs) and back.where("_piece = 'y'").count() == back.count()
    assert sorted(map(tuple, back.select("shard", "slot").collect())) == sorted(map(tuple, placed.select("shard", "slot").collect()))


def test_top_k(spark):
    r = random.Random(2)
    vec = lambda: [r.uniform(-1, 1) for _ in range(6)]
    rows_ = [(i, vec()) for i in range(300)]
    rows_ += [(300 + i, rows_[0][1]) for i in range(8)] + [(400, None), (450, [None] * 6), (500, [float("nan")] * 6), (550, [1e30] + [0.0] * 5), (None, vec()), (600, []), (650, [0.0] * 6)]
    rows_ = [x for x in rows_ if x[0] != 550]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>")
    same(topk.top_k(df), brute.top_k(rows_))
    assert topk.top_k(df.limit(0)).count() == 0
    same(topk.top_k(df.unionByName(df)), brute.top_k(rows_))


def test_top_k_stops_early():
    """Long-tailed components: the bound ends the walk; blocks share kth scores."""
    import numpy as np

    g = np.random.default_rng(4)
    rows_ = np.rint(g.pareto(1.2, (4000, 4)) * 50 * g.choice([-1, 1], (4000, 4))).astype(np.int64)
    ids = np.arange(4000)
    whole = list(topk.block_topk(rows_[:40], ids[:40], rows_, ids))
    for q, found, scores, depth, scored in whole:
        all_ = rows_ @ rows_[q]
        best = [j for j in np.lexsort((ids, -all_)) if j != q][:5]
        assert found.tolist() == best and scores.tolist() == all_[best].tolist()
    assert sum(scored < 2000 for *_, scored in whole) > 20
    floors = [int(x[2][-1]) for x in whole]
    again = list(topk.block_topk(rows_[:40], ids[:40], rows_[::-1], ids[::-1], 5, floors))
    assert all(a[1].tolist() == b[1].tolist() for a, b in zip(whole, again)) and all(b[3] <= a[3] for a, b in zip(whole, again))


def test_top_k_blocks(spark, monkeypatch):
    r = random.Random(8)
    rows_ = [(i, [r.uniform(-1, 1) for _ in range(5)]) for i in range(700)] + [(700 + i, [0.5] * 5) for i in range(30)] + [(800, [1.0, 2.0])]
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 100)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    df = spark.createDataFrame([(*x, 1, 2, "clash") for x in rows_], "vec_id long, embedding array<double>, dims int, a int, h string")
    same(topk.top_k(df), brute.top_k(rows_))


def test_decontamination(spark, docs, none):
    page = plain(docs.where("doc_id = 60"))[0][1]
    words = page.split()
    items = [(1, " ".join(words[20:60]).upper() + "."), (2, "never said anywhere at all here"), (3, None), (4, ""), (5, "one"), (6, " ".join(words[5:30]) + "? " + " ".join(words[30:40])), (None, "a b c"), (2, "never said anywhere at all here")]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(docs, table)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == brute.leaks(plain(docs), items)
    assert decontaminate.contaminated(none, table).count() == 0
    assert decontaminate.contaminated(docs, table.limit(0)).count() == 0
    split = decontaminate.contaminated(docs, table, segment_bytes=100)
    assert {(r["doc_id"], r["item_id"]) for r in split.collect()} == brute.leaks(plain(docs), items)
    assert sorted(r["score"] for r in split.collect()) == pytest.approx(sorted(r["score"] for r in found.collect()))
    bad = {t for t, _ in brute.leaks([(t, t) for _, t in plain(docs)], items)}
    same(decontaminate.clean_documents(docs, table).select("doc_id", "text"), [x for x in plain(docs) if x[1] not in bad])


def test_decontamination_verifies_both_parts(spark):
    r = random.Random(3)
    say = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    question, answer, noise = say(30), say(8), say(60)
    items = spark.createDataFrame([(1, f"{question}. {answer}.")], "item_id long, text string")
    rows_ = [(1, f"{noise} {question}. {answer}. {noise}"), (2, f"{noise} {question}. {say(8)}. {noise}"), (3, f"{noise} {say(30)}. {answer}."), (4, f"{question} so: {' '.join(answer.split()[:6])}"), (5, f"{question} {noise * 9} {answer}"), (1, "clean row of the same id"), (None, f"{question}. {answer}."), (None, "clean"), (1, f"{noise} {question}. {answer}. {noise}")]
    docs = spark.createDataFrame([(*x, "clash", "clash") for x in rows_], "doc_id long, text string, score string, _key string")
    found = decontaminate.contaminated(docs, items)
    assert sorted((x["doc_id"] for x in found.collect()), key=str) == [1, 1, 4, None]
    kept = decontaminate.clean_documents(docs, items)
    assert kept.columns == docs.columns and sorted((x["doc_id"] for x in kept.collect()), key=str) == [1, 2, 3, 5, None]
    own = spark.createDataFrame([(1, question, answer)], "item_id long, text string, said string")
    assert {x["doc_id"] for x in decontaminate.contaminated(docs, own, answer="said").collect()} == {1, 4, None}


def test_toxicity(spark, none):
    r = random.Random(9)
    words = ["w%d" % i for i in range(300)]
    made = [(i, " ".join([r.choice(words) for _ in range(50)] + (["vile", "grim"][: r.randint(1, 2)] if i % 8 == 0 else []))) for i in range(1200)]
    made += [(5000, None), (5001, ""), (None, "vile grim")]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(0, 900)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {x["doc_id"]: x for x in toxicity.scored(docs, model).collect()}
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.7) for x in got.values())
    hit = [got[i]["predicted"] for i in range(900, 1200) if i % 8 == 0]
    clean = [got[i]["predicted"] for i in range(900, 1200) if i % 8]
    assert sum(hit) / len(hit) > 0.9 and sum(clean) == 0
    empty = toxicity.train(none, labels)
    assert toxicity.scored(none, empty).count() == 0
    assert toxicity.train(docs, labels.limit(0)).score("vile") == pytest.approx(0.1)


def test_toxicity_ignores_held_out_labels(spark):
    docs = spark.createDataFrame([(i, f"word{i} common") for i in range(90)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(90)], "doc_id long, toxic int")
    held = [x[0] for x in labels.where(toxicity.fold() == toxicity.HELD_OUT).select("doc_id").collect()]
    flipped = labels.withColumn("toxic", F.col("doc_id").isin(held).cast("int"))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert a.weights == b.weights and a.bias == b.bias


def test_toxicity_risk_and_gradient():
    """The risk by its definition, its gradient by differences, and the step that
    undoes a fit where the risk on negatives is below zero."""
    import numpy as np

    g = np.random.default_rng(1)
    xp, xu = (np.hstack([g.integers(0, 2, (n, 6)), np.ones((n, 1))]).astype(np.float64) for n in (40, 90))
    loss = lambda w, x, y: np.mean([np.log(1 + np.exp(-y * (row @ w))) for row in x])
    for prior in (0.05, 0.4):
        w = g.normal(size=7)
        positive, negative, down, up = toxicity.risk(w, xp, xu, prior)
        assert positive == pytest.approx(prior * loss(w, xp, 1))
        assert negative == pytest.approx(loss(w, xu, -1) - prior * loss(w, xp, -1))
        for k in range(7):
            e = np.eye(7)[k] * 1e-6
            a, b = toxicity.risk(w + e, xp, xu, prior), toxicity.risk(w - e, xp, xu, prior)
            assert down[k] == pytest.approx((a[0] - b[0]) / 2e-6, abs=1e-6) and up[k] == pytest.approx((a[1] - b[1]) / 2e-6, abs=1e-6)
    # Unlabelled text that is all positive: the plain risk would go on below zero, this one doesn't.
    model = toxicity.fit(xp, xp[:30], list(range(6)), 0.5)
    w = np.array([model.weights[k] for k in range(6)] + [model.bias])
    assert toxicity.risk(w, xp, xp[:30], 0.5)[1] > -0.05


def test_toxicity_rows(spark):
    """Repeated ids, clashing names and very long texts."""
    long = "calm " * 200_000 + "vile"
    made = [(i % 300, f"calm word{i % 50} " + ("vile" if i % 300 % 5 == 0 else "fine")) for i in range(600)] + [(900, long), (901, None), (901, None), (902, "")]
    docs = spark.createDataFrame([(*x, "clash", "clash", 1.5) for x in made], "doc_id long, text string, predicted string, kind string, Score double")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] * 2 + [(0, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    done = toxicity.scored(docs, model)
    assert done.columns == ["doc_id", "text", "kind", "score", "predicted"] and done.count() == len(made)
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and kept.where("predicted = 'clash'").count() == done.where("predicted = 0").count()
    assert toxicity.accepted(docs.limit(0), model).count() == 0


def test_clashing_names(spark, docs):
    """Columns named like those that the operators add or use inside."""
    some = docs.where("doc_id < 30 or doc_id >= 66").withColumnsRenamed({"lang": "_t", "source": "n_tokens", "score": "_id", "row_id": "_key", "fp": "_text"})
    assert substring_dedup.remove_repeats(some).columns == [*some.columns, "n_words", "n_removed"]
    assert bpe_trie.encoded(some, queries.tokenizer_path(queries.WORD_BPE)).columns == [c for c in some.columns if c not in ("text", "n_tokens")] + ["n_tokens", "token_ids", "decoded"]
    kept = simhash_dedup.kept_documents(some)
    assert kept.columns == some.columns and kept.where("_text = 'clash' or doc_id is null").count() == kept.count()
    assert substring_dedup.remove_repeats(some.withColumn("N_Words", F.lit(1))).columns == [*some.columns, "n_words", "n_removed"]


def test_licenses(spark, docs, none):
    mit = license_scan.TEMPLATES[0][1]
    long = ("filler words go here\n" * 300) + mit.replace(". ", ".\n") + "\nmore text"
    made = [(1, long), (2, "Intro\nReleased under the MIT Licence!\nend"), (3, "This work is licensed under the GNU General Public License, version 2."), (4, "mit license"), (5, None), (6, ""), (None, "Licensed under CC BY 4.0"), (7, "x. All rights reserved."), (2, "Intro\nReleased under the MIT Licence!\nend")]
    table = spark.createDataFrame([(*r, "clash", "clash") for r in made], "doc_id long, text string, license string, dice string")
    got = [(r["doc_id"], r["license"]) for r in license_scan.licenses(table).collect()]
    assert sorted(got, key=str) == sorted([(1, "MIT"), (2, "MIT"), (2, "MIT"), (3, "GPL-2.0"), (None, "CC-BY-4.0"), (7, "All-Rights-Reserved")], key=str)
    assert license_scan.licenses(none).count() == 0
    scanner = license_scan.Scanner()
    for name, text in license_scan.TEMPLATES:
        words = license_scan.bigrams(license_scan.normalised(text))
        best = max((license_scan.dice(words, b), n) for n, b, _ in scanner.templates)
        assert best[0] == 1 and name in [x[0] for x in scanner.scan(text)]


def test_licenses_inside_lines():
    scanner = license_scan.Scanner()
    mit = license_scan.TEMPLATES[0][1]
    flat = "filler words go here " * 300
    assert scanner.scan("A tool. Released under the MIT License. See the folder for all the details of it.") == [("MIT", 1.0, 0, 1)]
    assert scanner.scan(f"{flat}{mit} {flat}") == [("MIT", 1.0, 0, 1)]
    assert scanner.scan(f"{mit}\n{flat}\n{mit}") == [("MIT", 1.0, 0, 1), ("MIT", 1.0, 2, 1)]
    assert scanner.scan(f"{flat}\n{flat}{mit[:300]}\n{mit[300:]} {flat}")[0][2:] == (1, 2)
    both = scanner.scan("Code is Licensed under the BSD 3-Clause License. and text is Licensed under CC BY-NC-SA 4.0. so be it")
    assert both == [("BSD-3-Clause", 1.0, 0, 1), ("CC-BY-NC-SA-4.0", 1.0, 0, 1)]
    # The best run for "near" lies under "exact"; its second place holds.
    pair = license_scan.Scanner([("exact", "a b c d e f g h"), ("near", "a b c d e f g x y")])
    assert [x[0] for x in pair.scan("a b c d e f g h\nand then\nc d e f g x y")] == ["exact", "near"]


@pytest.mark.parametrize("seed", range(12))
def test_licenses_by_brute_force(seed):
    r = random.Random(seed)
    say = lambda n: [r.choice("abcde") for _ in range(n)]
    templates = [(f"t{k}", say(r.randint(3, 9))) for k in range(4)]
    scanner = license_scan.Scanner([(n, " ".join(w)) for n, w in templates], 0.8)
    words = [w for _ in range(8) for w in say(r.randint(0, 6)) + r.choice(templates)[1][r.randint(0, 1) :]]
    # A word a line, so that lines tell words.
    got = scanner.scan("\n".join(words))
    assert [(n, round(d, 9), a, a + k - 1) for n, d, a, k in got] == [(n, round(d, 9), a, b) for n, d, a, b in brute.licences(words, templates, 0.8)]


def test_html(spark):
    page = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">home</a></li></ul></nav><div class="ad">buy</div><article><h1>Head &amp; line</h1><p><b>One<br><p>Two  \n words</p><p>&lt;3 &am</p></article><div id="comments"><p>first!</p></div><footer>&copy;</footer>'
    rows_ = [(i, "http://h.example/x", page) for i in range(6)] + [(6, None, None), (7, "bad url", ""), (8, "http://h.example/y", "plain text"), (9, "http://o.example", "<div>a<div>b</div>c</div><form>no</form>"), (9, "http://o.example", "<div>a<div>b</div>c</div><form>no</form>")]
    df = spark.createDataFrame(rows_, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    assert html_extract.extract(df).count() == len(rows_)
    assert got[0]["text"] == "Head & line\n\nOne\n\nTwo words\n\n<3 &am" and got[0]["n_chars"] == len(got[0]["text"])
    assert [got[i]["text"] for i in (6, 7, 8, 9)] == ["", "", "plain text", "a\n\nb\n\nc"]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_templates(spark):
    shared = "<html><body><div><p>Shared line of the site</p></div><div><p>{}</p></div></body></html>"
    df = spark.createDataFrame([(i, "http://t.example/", shared.format(f"own text {i}")) for i in range(10)], "page_id long, url string, html string")
    assert {r["text"] for r in html_extract.extract(df).collect()} == {f"own text {i}" for i in range(10)}


def test_html_template_decides(spark):
    """Site phrases, lists of links and small notices of names unknown to the
    operator go, with the article marked or not; without a template they stay."""
    r = random.Random(1)
    say = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    made, wanted = [], {}
    for i in range(24):
        body = [say(40) for _ in range(r.randint(2, 4))]
        paragraphs = "".join(f"<p>{b} <a href=x>{say(2)}</a></p>" for b in body)
        links = "".join(f"<li><a href=/{say(1)}>{say(3)}</a></li>" for _ in range(r.randint(2, 5)))
        head = say(4)
        inner = f"<h1>{head}</h1><p>Share this story with friends</p>{paragraphs}<ul>{links}</ul>"
        host, page = (("m.example", f"<html><body><article>{inner}</article><div>{say(3)}</div></body></html>"), ("u.example", f"<html><body><section><p>{say(2)}</p></section><div>{inner}</div></body></html>"))[i % 2]
        made.append((i, f"http://{host}/{i}", page))
        wanted[i] = [head, *body]
    df = spark.createDataFrame([(*x, "clash", "clash") for x in made], "page_id long, url string, html string, text string, host string")
    got = {x["page_id"]: x["text"].split("\n\n") for x in html_extract.extract(df).collect()}
    for i, page in ((i, p) for i, _, p in made):
        assert [t if k == 0 else t[: len(wanted[i][k])] for k, t in enumerate(got[i])] == wanted[i]
        bare = html_extract.main_text(page, html_extract.Template()).split("\n\n")
        assert "Share this story with friends" in bare and len(bare) > len(got[i])


def test_html_classes_by_brute_force(spark):
    """Pages of random blocks; some break the order of their site's tags."""
    r = random.Random(7)
    made = []
    for i in range(60):
        parts = [f"<div class=n{k}>{'<p>x</p>' * r.randint(0, 3)}</div>" for k in range(3)] + [f"<ul>{'<li><i>y</i></li>' * r.randint(1, 4)}</ul>"]
        if i % 2:
            r.shuffle(parts)  # one host's pages keep no order
        made.append((i, ("fixed", "mixed")[i % 2], "<html><body>" + "".join(parts) + "</body></html>"))
    rows_ = spark.createDataFrame(made, "key long, host string, html string")
    got = {x["host"]: {frozenset(c) for c in x["classes"]} for x in html_extract.templates(rows_).collect()}
    for host in ("fixed", "mixed"):
        pages = [[n.token for n in html_extract.pieces(p) if n.kind == "tag"] for _, h, p in made if h == host]
        assert got[host] == brute.template_classes(pages, {t for p in pages for t in p})
    assert max(map(len, got["fixed"])) > max(map(len, got["mixed"]))
    # Two runs that cross: the weaker class is at fault.
    t = html_extract.Template([[1, 2, 3], [7, 8]])
    assert t.walk([1, 7, 8, 2, 7, 8, 3]) == ([-1, 1, 65537, 1, 2, 65538 - 1, 2], set())
    assert t.walk([1, 7, 2, 8, 3])[1] == {1} and t.walk([2, 1, 3])[1] == {0}


def test_html_long_pages(spark):
    page = "<article>" + "<p>" * 20_000 + "deep</p>" + "<p>one two</p>" * 50_000 + "</article>"
    df = spark.createDataFrame([(1, "http://l.example/", page)], "page_id long, url string, html string")
    assert html_extract.extract(df).first()["text"] == "\n\n".join(["deep"] + ["one two"] * 50_000)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(4)
    words = ["w%d" % i for i in range(500)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    copy, passage, item = say(150), say(60), say(40)
    made = [(i, say(80) + (" vile grim foul" if i % 6 == 0 else "")) for i in range(300)]
    made += [(1000 + i, copy) for i in range(6)] + [(2000 + i, f"{say(50)} {passage} {say(50)}") for i in range(5)] + [(3000, f"{say(30)} {item} {say(30)}"), (4000, None), (4001, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in made], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            left[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = {i for i, t in made if i < 300 and i % 6}
    assert clean <= left["toxicity"].keys() and not {i for i in range(0, 300, 6)} & left["toxicity"].keys()
    assert len([i for i in left["simhash_near_dedup"] if 1000 <= i < 2000]) == 1 and clean <= left["simhash_near_dedup"].keys()
    assert all(passage not in (t or "") for t in left["substring_dedup"].values()) and left["substring_dedup"].keys() == left["simhash_near_dedup"].keys()
    assert left["substring_dedup"].keys() - left["decontamination"].keys() == {3000}
    assert docs.columns == ["doc_id", "n_tokens", "token_ids", "decoded_sha256"] and docs.count() == len(left["decontamination"])


def test_pipeline_stages_take_any_rows(spark, docs, none, tmp_path):
    """Null ids and texts, repeated rows, clashing names, empty tables."""
    import corpus_pipeline

    odd = docs.withColumnsRenamed({"lang": "n_removed", "fp": "_key", "score": "predicted"}).withColumn("_text", F.lit(None).cast("string"))
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "never said at all anywhere"), (None, "one"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    empty = tmp_path / "empty"
    for t in ("labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{t}.parquet")).limit(0).write.parquet(str(empty / f"{t}.parquet"))
    for where, table in ((tmp_path, odd), (tmp_path, odd.limit(0)), (empty, odd.limit(40))):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
            done = stage(spark, table, str(where))
            assert done.columns == odd.columns and done.count() <= table.count()
            if name == "substring_dedup":
                assert done.count() == table.count() and done.where("row_id = 'clash' or doc_id is null").count() == done.count()
        assert corpus_pipeline.bpe_stage(spark, table, str(where)).count() == table.count()


def test_near_duplicate_stage_links_edited_copies(spark, docs, none):
    import corpus_pipeline

    def found(text: str | None) -> frozenset:
        words = (text or "").encode().lower().split()
        return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))

    r = random.Random(11)
    say = lambda n: [r.choice("abcdefghijklmnop") + str(r.randint(0, 99)) for _ in range(n)]
    made = []
    for _ in range(60):
        words = say(r.randint(30, 200))
        made.append(words)
        for _ in range(r.randint(0, 3)):
            words = list(words)
            for _ in range(r.randint(1, 4)):
                words[r.randrange(len(words))] = "edited"
            made.append(words)
    rows_ = [(d, t) for d, t in plain(docs) if d is not None] + [(10_000 + i, " ".join(w)) for i, w in enumerate(made)]
    sets = [found(t) for _, t in rows_]
    group = list(range(len(rows_)))
    for i in range(len(rows_)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least: dict[int, int] = {}
    for (d, _), g in zip(rows_, group):
        least[g] = min(d, least.get(g, d))
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicate_stage(spark, df, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())
    assert len(least) < simhash_dedup.kept_documents(df).count()
    assert corpus_pipeline.near_duplicate_stage(spark, none, "").count() == 0


def test_near_duplicate_stage_links_by_pivot_tables(spark, monkeypatch):
    """The stage's fingerprints go through op9's tables; the links join all within the radius."""
    import corpus_pipeline
    from glyphshift.llm import shingle_dedup

    seen = []
    links = simhash_dedup.links
    monkeypatch.setattr(simhash_dedup, "links", lambda nodes, *a: (seen.append(nodes.count()), links(nodes, *a))[1])
    words = [f"w{i}" for i in range(400)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, " ".join(words[::-1]))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()) == [1, 3]
    assert seen and seen[0] >= 2
    fps = [(1, 0), (2, 0), (3, 15), (4, -1)]
    near = shingle_dedup.near_by_bits(spark.createDataFrame(fps, "node long, fp long"))
    assert {tuple(r) for r in near.collect()} == {(1, 2), (1, 3)}
