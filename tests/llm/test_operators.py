"""Small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from truemark.llm import chat, language, line_dedup, media, mixing, near_dedup, packing, quality, quality_rules, toxicity
from truemark.llm.queries import word_tokenizer

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"word{i}" for i in range(400)]
LONG = " ".join(WORDS)
ROWS = [
    (1, LONG, "en", "a", 0), (2, LONG, "en", "a", 0), (3, LONG.replace("word7 ", "other "), None, "b", 0), (4, None, "en", None, 0), (5, "", "en", "b", 0),
    (6, " \t\n ", "de", "b", 0), (7, "one", "de", "c", 0), (7, "one", "de", "c", 0), (None, "one", None, None, 0), (9, "x y " * 3000, "fr", "c", 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mix_hits_targets_and_caps(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS)
    by: dict = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for rows in by.values():
        assert sum(r["size"] for r in rows) == rows[0]["source_size"]
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) < 1
        assert rows[0]["target"] <= 2 * rows[0]["source_size"]
        assert all(0 <= t <= 1 for r in rows for t in r["positions"])
    assert mixing.mix(empty).count() == 0


def test_training_time_inverts_the_integral(spark):
    knots, share = [1.0, 3.0, 0.5], 0.37
    t = spark.range(1).select(mixing.training_time(F.array(*map(F.lit, knots)), F.lit(share))).first()[0]
    grid = np.linspace(0, 1, 200_001)
    area = np.concatenate([[0], np.cumsum(np.interp((grid[1:] + grid[:-1]) / 2, [0, 0.5, 1], knots))])
    assert abs(np.interp(share, area / area[-1], grid) - t) < 1e-5


def test_near_dedup_edges(docs, empty):
    got = {(r["doc_id"], r["n_shingles"]): r for r in near_dedup.link_documents(docs, 2, 80).collect()}
    assert [got[k]["component_id"] for k in ((1, 399), (2, 399), (3, 399))] == [1, 1, 1]
    assert got[(4, 0)]["component_id"] == 4 and got[(5, 0)]["kept"] and got[(6, 0)]["n_shingles"] == 0
    assert got[(7, 1)]["component_id"] == 7 and got[(None, 1)]["kept"] and got[(None, 1)]["component_id"] is None
    assert near_dedup.link_documents(empty, 2, 80).count() == 0


def test_near_dedup_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = []
    for g in range(12):  # groups of near copies around common and own words
        base = [f"g{g}w{i}" for i in range(40)] + ["the", "of"] * 10
        for _ in range(12):
            own = [w if rng.random() > 0.06 else f"z{rng.integers(1e6)}" for w in base]
            texts.append(" ".join(own))
    sets = [set(near_dedup.shingle_set(t, 2).tolist()) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    label[a] = label[b] = min(label[a], label[b])
        if all(label[label[i]] == label[i] for i in range(len(texts))):
            break
    got = near_dedup.link_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2, 80)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == dict(enumerate(label))


def test_odd_sketches_never_hide_a_link(spark):
    rng = np.random.default_rng(3)
    rows = []
    for size in (1, 2, 30, 400, 5000):
        base = rng.integers(0, 1 << 63, size, dtype="uint64")
        for gone in {0, 1, size // 18, size // 9, size // 3}:
            x, y = np.unique(base[gone:]), np.unique(np.concatenate([base[: size - gone], rng.integers(0, 1 << 63, gone // 9, dtype="uint64")]))
            both = len(np.intersect1d(x, y))
            linked = len(x) and 100 * both >= 80 * (len(x) + len(y) - both)
            apart = int(np.bitwise_count((near_dedup.parity(x) ^ near_dedup.parity(y)).view("uint64")).sum())
            assert apart <= len(np.setxor1d(x, y))
            rows.append((bool(linked), len(x), *near_dedup.parity(x).tolist(), len(y), *near_dedup.parity(y).tolist()))
    names = near_dedup._LOOK
    table = spark.createDataFrame(rows, ["linked", *names, *(f"x_{n}" for n in names)])
    assert table.where("linked").count() >= 8 and table.where(F.col("linked") & ~near_dedup._alike(80)).count() == 0


def test_near_dedup_joins_texts_of_one_id(spark):
    other = " ".join(f"o{i}" for i in range(300))
    rows = [(8, LONG, 1), (3, other, 2), (8, other + " x", 3), (5, "", 4), (8, LONG, 5)]
    got = near_dedup.link_documents(spark.createDataFrame(rows, "doc_id long, text string, node int"), 5, 80).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(3, 3, True), (5, 5, True), (8, 3, False), (8, 3, False), (8, 3, False)]


def test_near_dedup_meets_over_blocks(spark):
    """The open step alone, with lists dealt over blocks, finds the pairs of all lists once."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(w if rng.random() > 0.03 else f"z{rng.integers(1e6)}" for w in [*base, f"own{i}"]) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = near_dedup.written(near_dedup.sketch(docs, 2, "doc_id", "text"), "nodes")
    posted = near_dedup.written(near_dedup.post(nodes, 80), "posted")
    alone = spark.createDataFrame([], "node binary, component binary")
    pairs = near_dedup.open_pairs(near_dedup.open_rows(posted, alone), 80, few=3, many=5).collect()
    names = {bytes(r["node"]): r["doc_id"] for r in nodes.collect()}
    met = [tuple(sorted((names[bytes(r["a"])], names[bytes(r["b"])]))) for r in pairs]
    sets = [set(near_dedup.shingle_set(t, 2).tolist()) for t in texts]
    linked = {(i, j) for i in range(40) for j in range(i + 1, 40) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert len(met) == len(set(met)) and linked and linked <= set(met)


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    u, pair = rng.normal(size=(1, 5)), rng.normal(size=(2, 2))
    total, hit = 0.0, np.zeros(5)
    for n in range(32):
        y = [n >> i & 1 for i in range(5)]
        w = np.exp(sum(u[0, i] * y[i] for i in range(5)) + sum(pair[y[i], y[i + 1]] for i in range(4)))
        total, hit = total + w, hit + w * np.array(y)
    assert np.allclose(toxicity.marginals(u, np.ones((1, 5), bool), pair)[0], hit / total)


def test_likelihood_and_its_gradient():
    """log P(y) against enumeration, and both gradients against finite differences."""
    rng = np.random.default_rng(1)
    u, pair, mask = rng.normal(size=(3, 4)), rng.normal(size=(2, 2)), np.array([[1, 1, 1, 1], [1, 1, 1, 0], [1, 0, 0, 0]], bool)
    y = (rng.random((3, 4)) < 0.5) * mask.astype(float)

    def enumerated(u, pair):
        found = []
        for row, m, t in zip(u, mask.sum(axis=1), y):
            weigh = lambda z: sum(row[i] * z[i] for i in range(m)) + sum(pair[z[i], z[i + 1]] for i in range(m - 1))
            every = [weigh([n >> i & 1 for i in range(m)]) for n in range(1 << m)]
            found.append(weigh(t.astype(int).tolist()) - np.log(np.exp(every).sum()))
        return np.array(found)

    value, by_unary, by_pair = toxicity.likelihood(u, mask, pair, y)
    assert np.allclose(value, enumerated(u, pair))
    for i, j in np.argwhere(mask):
        d = np.zeros_like(u)
        d[i, j] = 1e-6
        assert abs((enumerated(u + d, pair) - enumerated(u - d, pair))[i] / 2e-6 - by_unary[i, j]) < 1e-6
    for i, j in np.ndindex(2, 2):
        d = np.zeros((2, 2))
        d[i, j] = 1e-6
        assert np.allclose((enumerated(u, pair + d) - enumerated(u, pair - d)) / 2e-6, by_pair[:, i, j], atol=1e-6)


def test_toxicity_spans_and_edges(spark, docs, empty):
    texts = [f"calm words {i} here and there you rotten idiot pest" for i in range(30)] + [f"calm words {i} here and there all is fine today" for i in range(60)]
    known = spark.createDataFrame([(i, t, int(i < 30)) for i, t in enumerate(texts)], "doc_id long, text string, toxic int")
    field = toxicity.learn(known.drop("toxic"), known.drop("text"))
    p = toxicity.tag([texts[0].split()], field)[0]
    assert any(texts[0][s["start"] : s["end"]].find("idiot") >= 0 for s in toxicity.spans(texts[0], p))
    got = toxicity.score(docs, field).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == 0 and not r["spans"] for r in got if r["doc_id"] in (4, 5, 6))
    own = spark.createDataFrame([(texts[0],), (texts[-1],)], "text string")
    assert [r["predicted"] for r in toxicity.score(own, field).collect()] == [1, 0]
    assert toxicity.score(empty, field).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert 0 <= toxicity.score(docs, toxicity.learn(docs, none)).first()["score"] < 0.3
    twice = toxicity.score(docs, field).where("doc_id = 7").collect()
    assert twice[0]["score"] == twice[1]["score"]
    # scores against enumeration of all taggings of short texts
    short = ["you idiot pest", "calm idiot words here pest", "fine today"]
    scored = toxicity.score(spark.createDataFrame([(t,) for t in short], "text string"), field).collect()
    for t, r in zip(short, scored):
        u = [field.token(c) for c in t.split()]
        m, total, hit = len(u), 0.0, np.zeros(len(u))
        for n in range(1 << m):
            z = [n >> i & 1 for i in range(m)]
            w = np.exp(sum(a * b for a, b in zip(u, z)) + sum(field.pair[z[i], z[i + 1]] for i in range(m - 1)))
            total, hit = total + w, hit + w * np.array(z)
        p = sorted((x for x in hit / total if x >= 0.2), reverse=True)
        x = [1, p[0] if p else 0, p[1] if len(p) > 1 else 0, np.log1p(sum(p)), np.log1p(100 * sum(p) / m)]
        assert abs(r["score"] - 1 / (1 + np.exp(-np.dot(x, field.document)))) < 1e-9


def test_toxicity_scores_do_not_follow_the_cap(spark):
    rng = np.random.default_rng(8)
    calm = [" ".join(rng.choice(WORDS, 30)) for _ in range(2100)]
    rows = [(i, t + " rotten pest" if i < 50 else t, int(i < 100)) for i, t in enumerate(calm)]  # half of the toxic ones look calm
    known = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    field = toxicity.learn(known.drop("toxic"), known.drop("text"), per_class=100)
    got = toxicity.score(known, field).groupBy((F.col("doc_id") < 50).alias("marked")).agg(F.avg("score").alias("s"), F.sum("predicted").alias("n")).collect()
    by = {r["marked"]: r for r in got}
    assert by[False]["s"] < 0.1 and by[False]["n"] < 60 and by[True]["n"] >= 45


def test_toxic_places_cover_the_whole_text():
    text = " ".join(f"tttt{i}" for i in range(2000))
    cut = toxicity.windows(text, 1, {"4tttt"}, 12, 6)
    assert len(cut) == 12 and max(int(c[0][4:]) for c, _ in cut) > 1000 and all(all(t) for _, t in cut)
    assert len(toxicity.windows("one two", 0, set(), 12, 6)) == 2 and toxicity.windows("", 1, set(), 12, 6) == []


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 3000])
def test_media_round_trip(size):
    rng = np.random.default_rng(size)
    raw = rng.integers(0, 256, size).astype("uint8").tobytes()
    payload = raw.ljust(max(64, -(-size // 64) * 64), b"\0")
    assert media.decode_files(media.encode_files([payload, b"\xff" * 64]))[0].tobytes() == payload


def test_media_shots_and_edges(docs):
    h = np.zeros((12, 16))
    h[:6, 2], h[6:, 9] = 64, 64
    assert media.find_shots(h) == [0, 6]
    got = media.decode_media(media.encode_media(docs)).collect()
    assert {r["payload_bytes"] for r in got if r["doc_id"] in (4, 5)} == {64}
    assert media.clip_rows(media.decode_media(media.encode_media(docs))).count() >= len(ROWS)


def test_language_held_out_and_edges(spark, docs, empty):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    test = F.pmod(F.col("doc_id"), F.lit(4)) == 0
    known = language.learn_dictionaries(table.where(~test))
    got = language.identify(table.where(test), known).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.9
    edge = {r["doc_id"]: r for r in language.identify(docs, known).collect()}
    assert [edge[i]["lang_pred"] for i in (4, 5, 6)] == ["und"] * 3 and edge[4]["rejected"]
    assert language.identify(docs, {}).where("lang_pred <> 'und'").count() == 0
    assert language.learn_dictionaries(empty) == {}


def test_line_dedup_modes(spark, docs, empty):
    rows = [(i, f" Same LINE \nown {i}\n\n") for i in range(12)] + [(12, None), (None, "same line")]
    lines = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(lines, 10, 1).collect()}
    assert (got[0]["n_lines"], got[0]["n_dropped"], got[0]["text"]) == (4, 1, "own 0\n\n")
    assert (got[12]["n_lines"], got[12]["n_dropped"], got[12]["text"]) == (1, 0, "") and got[None]["n_dropped"] == 1
    first = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(lines, 10, 1, keep_first=True).collect()}
    assert sum(v == 0 for k, v in first.items() if k != 12) == 1
    assert line_dedup.dedup_lines(empty).count() == 0 and line_dedup.dedup_lines(docs).count() == len(ROWS)


def test_line_runs_compact_and_ingest(spark):
    runs = line_dedup.count_lines(spark.createDataFrame([(0, "zero")], "doc_id long, text string"), batches=1, fanout=3)
    for i in range(1, 6):
        left = line_dedup.ingest(runs, spark.createDataFrame([(i, f"zero\nline {i}\nline {i - 1}")], "doc_id long, text string"))
        want = f"line {i}" if i > 1 else "line 1\nline 0"
        assert left.first()["text"] == want
    assert sum(map(len, runs.levels.values())) < 6 and runs.totals().where("docs >= 6").count() == 1


def test_chat_collapses_snapshots(spark):
    a = [(1, 1, "user", "hi"), (1, 2, "bot", "yo"), (1, 3, "user", "bye")]
    rows = a + [(2, *r[1:]) for r in a[:2]] + [(3, *r[1:]) for r in a] + [(4, 1, "user", None), (5, 1, None, "hi"), (6, 1, "user", "hi"), (6, 2, "bot", "no"), (None, 9, "user", "lost")]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert set(got) == {1, 4, 5, 6, None} and got[1]["copies"] == 2 and got[1]["n_turns"] == 3
    assert got[6]["rendered"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>bot\nno<|im_end|>"
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_packing_is_gapless_and_whole(docs, empty):
    got = packing.pack_documents(docs, word_tokenizer(), window=64).collect()
    ends: dict = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends.get(r["sequence_id"], 0) == r["offset"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 64 and sum(r["length"] for r in got if r["doc_id"] == 9) == 6001
    assert packing.pack_documents(empty, word_tokenizer()).count() == 0


def test_fill_window_is_the_best_sum():
    rng = np.random.default_rng(1)
    for _ in range(60):
        counts = Counter(rng.integers(3, 40, 6).tolist())
        room, sums = 50, {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
        got = packing.fill_window(dict(counts), room)
        assert sum(k * v for k, v in got.items()) == max(sums) and all(v <= counts[k] for k, v in got.items())


def test_preferences_rank_held_out(docs, empty):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400)
    x = rng.normal(size=(400, quality.FEATURES))
    x[:, 3] += 3 * y
    model = quality.fit_pairs(x[:300], y[:300])
    assert np.mean((model.score(x[300:]) >= 0.3) == y[300:]) > 0.85
    assert quality.score(docs, model).count() == len(ROWS) and quality.score(empty, model).count() == 0
    assert quality.fit_pairs(np.zeros((0, quality.FEATURES)), np.zeros(0)).score(x[:1]).shape == (1,)


def test_quality_threshold_covers_all_labels(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(["word", "|#", "other", "Big!"], 40, p=[0.4, s, 0.4, 0.2 - s])), int(i >= 60)) for i in range(600) for s in [rng.uniform(0.05, 0.15) if i < 60 else rng.uniform(0, 0.1)]]
    known = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    for per_class in (30, 4000):  # the cap moves the weights, not the share that is predicted bad
        got = quality.score(known, quality.learn(known.drop("quality"), known.drop("text"), per_class)).agg(F.sum(1 - F.col("predicted"))).first()[0]
        assert 50 <= got <= 60
    values = rng.normal(size=997).round(2)
    frame = spark.createDataFrame([(float(x),) for x in values], "value double")
    for below in (1, 100, 500, 996):
        assert np.isclose(quality.share_quantile(frame, below), np.quantile(values, below / 997), rtol=0, atol=1e-12)


def test_quality_counts_match_plain_python(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["a", "b|", "c%", "dd\n", "\tee"], rng.integers(0, 60))) for _ in range(80)] + [None, "", "a b", "a b c a b c", "x\nx\n \nx"]
    got = quality_rules.base_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    for r in got:
        t = texts[r["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, held = Counter(zip(w, w[1:], w[2:])), set()
        for i in range(len(w) - 2):
            if seen[tuple(w[i : i + 3])] > 1:
                held |= {i, i + 1, i + 2}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(held))


def test_binomial_tail(spark):
    from math import comb

    for n, k, p in ((900, 3, 0.01), (50, 0, 0.1), (2000, 30, 0.02), (10, 5, 0.1)):
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k < n * p else 1.0
        got = spark.createDataFrame([(n, k)], "n long, k long").select(quality_rules.binomial_tail(F.col("n"), F.col("k"), p)).first()[0]
        assert abs(got - want) < 1e-9


def test_judge_edges(docs, empty, spark):
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    got = quality_rules.judge(docs, labels).collect()
    assert len(got) == len(ROWS) and {r["doc_id"] for r in got if r["kept"]} == {1, 2, 3}
    assert quality_rules.judge(empty, labels).count() == 0
    assert quality_rules.judge(docs, labels.limit(0)).where("kept").count() == 3


def test_judge_finds_safe_cutoffs(spark):
    """Enough good labels for cutoffs in one stratum; every decision against a plain loop."""
    rng = np.random.default_rng(12)
    rows, labels = [], []
    for i in range(2600):
        words = [f"w{x}" for x in rng.integers(0, 5000, 60)]
        noisy = i % 13 == 0
        for k in rng.choice(60, 20, replace=False) if noisy else ():
            words[k] = "#|#"
        rows.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(not noisy)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules.judge(table, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    rate = {i: 1000 * r["n_symbols"] // r["word_chars"] for i, r in got.items()}  # the other rates are 0
    known, n, best = dict(labels), 0, None
    free = [rate[i] for i in rate if i not in known]
    good = [rate[i] for i in rate if known.get(i) == 1]
    from math import comb

    for level in quality_rules.LEVELS:
        cut = min(c for c in free if 1000 * sum(x > c for x in free) <= level * len(free))
        k, n = sum(x > cut for x in good), len(good)
        if k < n * 0.01 and sum(comb(n, j) * 0.01**j * 0.99 ** (n - j) for j in range(k + 1)) <= 0.05 / 24:
            best = cut
    assert best is not None and {i for i, r in got.items() if not r["kept"]} == {i for i, x in rate.items() if x > best}
    assert sum(not r["kept"] for r in got.values()) > 100


def test_repeats_that_interleave(spark):
    text = "a b c a b c x y z q x y z " * 3
    r = quality_rules.base_counts(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert r["n_repeat_words"] == r["n_words"] == 39


ADDED = "size source_size target taken positions position n_lines n_dropped score predicted spans lang_pred margin rejected _id _hits _hit_id _row _kept _mix_hash".split()


@pytest.fixture(scope="module")
def clashing(docs):
    """The documents with a column, 100 + doc_id, for each name that some operator adds or uses, one of them in capitals."""
    return docs.select("*", *((F.lit(100) + F.col("doc_id")).alias(c.upper() if c == "score" else c) for c in ADDED))


def test_clashing_names(spark, clashing):
    field = toxicity.learn(clashing.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int"))
    model = quality.fit_pairs(np.zeros((0, quality.FEATURES)), np.zeros(0))
    made = {
        "size source_size target taken positions _mix_hash": mixing.mix(clashing),
        "n_lines n_dropped": line_dedup.dedup_lines(clashing, 2, 1),
        "score predicted spans": toxicity.score(clashing, field),
        "lang_pred score margin rejected": language.identify(clashing, {}),
        "score predicted": quality.score(clashing, model),
    }
    for names, got in made.items():
        lower = [c.lower() for c in got.columns]
        assert len(lower) == len(set(lower))
        for r in got.collect():
            assert all(r[c.upper() if c == "score" else c] == (r["doc_id"] and 100 + r["doc_id"]) for c in ADDED if c not in names.split())
    assert mixing.by_position(mixing.mix(clashing)).count() == len(ROWS)
    with pytest.raises(ValueError, match="rename score"):
        quality.score(clashing.withColumnRenamed("text", "score2").withColumn("score", F.col("score2")), model, text_col="score")
    for f in (near_dedup.link_documents, media.encode_media, lambda d: quality_rules.judge(d, spark.createDataFrame([], "doc_id long, quality int")), lambda d: packing.pack_documents(d, word_tokenizer())):
        assert f(clashing).count() == len(ROWS) + (f(clashing).columns[1] == "start")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, clashing, SF).columns == clashing.columns


def test_media_matches_plain_bytes(spark, docs):
    got = media.decode_media(media.encode_media(docs)).collect()
    files = {(r["doc_id"], r["n_bytes"]): r["media"] for r in media.encode_media(docs).collect()}
    want = sorted(((r[0], (r[1] or "").encode()) for r in ROWS), key=str)
    for r, (doc, raw) in zip(sorted(got, key=lambda r: str((r["doc_id"], next(x for d, x in want if d == r["doc_id"])))), want):
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"]) == (doc, len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        file = bytes(files[doc, len(raw)])
        assert file[:4] == b"RIFF" and (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())
        frames = -(-len(payload) // (media.WIDTH * media.HEIGHT))
        histogram = np.bincount(np.frombuffer(payload, "uint8") >> 4, minlength=16)
        assert r["feature"].startswith(f"frames={frames};") and r["feature"].endswith("hist=" + ",".join(map(str, histogram)))
        assert r["clips"][0]["start_frame"] == 0 and r["clips"][-1]["end_frame"] == frames and f"shots={len(r['clips'])};" in r["feature"]


def test_language_matches_a_plain_loop(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    known = language.learn_dictionaries(table)
    for r in language.identify(table.where("doc_id % 4 = 0"), known).collect():
        text = r["text"] or ""
        if not any(c.isalpha() for c in text):
            assert r["lang_pred"] == "und"
            continue
        raw, sizes = language.letters_only(text).encode(), {}
        for lang, content in known.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=6)
            c = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(c.compress(raw[i : i + 1500])) for i in range(0, len(raw), 1500))
        first, second = sorted(sizes.values())[:2]
        assert r["lang_pred"] == min(k for k, v in sizes.items() if v == first) and abs(r["margin"] - (second - first) / first) < 1e-12
        assert r["rejected"] == (r["margin"] < 0.02)


def test_packing_matches_the_plain_tokenizer(spark):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(13)
    signs = list("abcXYZäÖßéñ .,'-_#0189\n\t\u00a0\u200b漢字ﬁ½…—\u0301😀") + ["don't", "Hello", "A.B.C", " the"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 300))) for _ in range(400)] + [None, "", " "]
    rows = list(enumerate(texts)) + [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    plain, text = Tokenizer.from_file(word_tokenizer()), dict(rows)
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), word_tokenizer()).collect()
    pieces: dict = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(text)
    for doc, own in pieces.items():
        ids = np.array([*plain.encode(text[doc] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_quality_matches_a_plain_loop(spark, docs):
    rng = np.random.default_rng(14)
    model = quality.PreferenceModel(rng.normal(size=quality.FEATURES), rng.normal(size=quality.FEATURES), np.ones(quality.FEATURES), 0.2)
    for r in quality.score(docs, model).collect():
        text = r["text"] or ""
        raw, words, lines = text.encode(), text.encode().split(), [x for x in text.encode().split(b"\n") if x.strip()]
        share = lambda signs: sum(b in signs for b in raw) / max(1, len(raw))
        upper, symbols = share(bytes(range(65, 91))), share(b"#*$%&|<>@^~_=+\\/{}[]")
        x = [
            np.log1p(len(words)), len(raw) / max(1, len(words)) / 10, upper, share(b"0123456789"), symbols, share(b".,;:!?'\"()-"), np.log1p(1000 * symbols), np.log1p(1000 * upper),
            np.log1p(1000 * raw.count(b"!") / max(1, len(raw))), len(set(words)) / max(1, len(words)), max((words.count(w) for w in set(words)), default=0) / max(1, len(words)),
            sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words)), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(raw.count(b"|")), np.log1p(len(lines)), float(len(words) < 20),
        ]
        z = sum(w * (a - m) for w, a, m in zip(model.weights, x, model.mean)) - model.threshold
        want = 1 / (1 + 0.7 / 0.3 * np.exp(-z))
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == int(want >= 0.3)


def test_pipeline_stages_match_plain_python(spark):
    """Each stage on what its predecessor kept, against a plain version of it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    docs = corpus_pipeline.written(docs.unionByName(docs.where("doc_id < 12").withColumn("doc_id", F.col("doc_id") + 900_000)), "test-documents")
    names = docs.columns

    def after(name):
        kept = corpus_pipeline.written(dict(corpus_pipeline.STAGES)[name](spark, docs, SF), f"test-{name}")
        assert kept.columns == names
        return kept, {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in kept.collect()}

    field = toxicity.learn(docs.where(corpus_pipeline.id_bucket(F.col("doc_id"), 4) != 2), spark.read.parquet(f"{SF}/labels.parquet"))
    docs, before, kept = after("toxicity")
    for doc, r in before.items():
        p = toxicity.tag([(r["text"] or "").split()], field)[0]
        z = np.dot(toxicity._document(p), field.document)
        assert (doc in kept) == (1 / (1 + np.exp(-z)) < 0.3) and (doc not in kept or kept[doc] == r)

    docs, before, kept = after("line_dedup")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders: dict = {}
    for doc, r in before.items():
        for k in {key(x) for x in (r["text"] or "").split("\n")} - {""}:
            holders.setdefault(k, set()).add(doc)
    left = {k: set() for k, v in holders.items() if len(v) >= 10}
    for doc, r in before.items():
        parts, own = (r["text"] or "").split("\n"), kept[doc]["text"].split("\n") if doc in kept else []
        for k in {key(x) for x in parts} & set(left):
            if any(key(x) == k for x in own):
                left[k].add(doc)
        want = "\n".join(x for x in parts if key(x) not in left or doc in left[key(x)])
        assert (kept[doc]["text"] if doc in kept else "") == want or doc not in kept and not want.strip()
    assert all(len(v) == 1 for v in left.values())

    docs, before, kept = after("near_dedup")
    sets = {d: set(near_dedup.shingle_set(r["text"], 5).tolist()) for d, r in before.items()}
    label = {d: d for d in sets}
    for _ in sets:
        moved = False
        for x in sets:
            for y in sets:
                if x < y and sets[x] and sets[y] and label[x] != label[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                    label[x] = label[y] = min(label[x], label[y])
                    moved = True
        if not moved:
            break
    assert set(kept) == {d for d in label if label[d] == d} and all(kept[d] == before[d] for d in kept)

    mixed = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    docs = corpus_pipeline.written(corpus_pipeline.mix_sources(spark, docs, SF), "test-mixing")
    copies = Counter(r["doc_id"] for r in docs.collect())
    assert docs.columns == names and copies == Counter({d: -(-r["taken"] // r["size"]) for d, r in mixed.items() if r["taken"]})
    packed = corpus_pipeline.pack_windows(spark, docs, SF)
    assert Counter(r["doc_id"] for r in packed.where("start = 0").collect()) == copies


def test_pipeline_drops_short_repeated_lines(spark):
    rows = [(i, f"Menu\nown text {i}\n- \nown text {i}", "en", "a", 0) for i in range(12)] + [(12, "menu", "en", "a", 0)]
    got = {r["doc_id"]: r for r in corpus_pipeline.drop_lines(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()}
    assert set(got) == set(range(12)) and got[0]["text"] == rows[0][1]
    for i in range(1, 12):
        assert got[i]["text"] == f"own text {i}\nown text {i}" and got[i]["n_chars"] == len(got[i]["text"])
