"""Vector codes, whitening and token files against plain versions, with nulls, ties, repeats and clashing names."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from truemark.llm import queries, token_files, vector_codes, whitening

SF = "/root/testdata/sf0.001"


def vectors(dim=16, n=300):
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.normal(0, 0.2, dim)], i % 3 if i % 4 else None) for i in range(n)]
    rows += [(n + i, rows[7][1], 1) for i in range(150)]  # a hot vector
    rows += [(9, rows[30][1], 2), (None, rows[31][1], 0), (None, rows[31][1], 0)]  # a repeated id, null ids, repeated rows
    odd = [(-1, None, 0), (-2, [None, *rows[0][1][1:]], 0), (-3, [float("nan"), *rows[0][1][1:]], 0), (-4, [float("inf"), *rows[0][1][1:]], 0)]
    return rows, odd


def whole(rows, scale=256):
    return np.array([[math.floor(scale * float(np.float32(x))) for x in v] for _, v, _ in rows])


def product_codes(rows, parts=16, entries=64, rounds=2):
    x = whole(rows)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i].tolist()))[:entries]
    books = x[order].reshape(len(order), parts, -1).transpose(1, 0, 2).copy()
    split = x.reshape(len(x), parts, -1).transpose(1, 0, 2)
    for turn in range(rounds + 1):
        apart = ((split[:, :, None] - books[:, None]) ** 2).sum(-1)
        codes = apart.argmin(-1)
        if turn < rounds:
            for p in range(parts):
                for e in set(codes[p].tolist()):
                    own = split[p][codes[p] == e]
                    books[p, e] = [int(s) // len(own) for s in own.sum(0)]
    error = apart.min(-1).sum(0)
    return ["".join(f"{c:02x}" for c in codes[:, i]) for i in range(len(x))], error.tolist(), books


SHAPE = "vec_id long, embedding array<float>, label int"


def test_vector_codes_match_brute_force(spark):
    rows, odd = vectors()
    frame = spark.createDataFrame(rows + odd, SHAPE).withColumn("error", F.lit("old")).withColumn("a.`b", F.lit(1)).repartition(3)
    coded, books = vector_codes.compress(frame)
    codes, errors, want = product_codes(rows)
    assert (books == want).all() and coded.columns == ["vec_id", "label", "a.`b", "code", "error"]
    got = vector_codes.label_errors(coded).collect()
    by_label = {}
    for (_, _, label), e in zip(rows, errors):
        by_label[label] = by_label.get(label, 0) + e
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in got) == sorted((str(r[0]), c, e, by_label[r[2]]) for r, c, e in zip(rows, codes, errors))
    assert vector_codes.codebook_digest(books) == hashlib.sha256(",".join(str(int(v)) for v in want.reshape(-1)).encode()).hexdigest()
    back = {r["vec_id"]: r["vector"] for r in vector_codes.reconstruct(coded.where("vec_id < 5"), books).collect()}
    x = whole(rows)
    assert all(((np.floor(np.array(back[i]) * 256) - x[i]) ** 2).sum() == errors[i] for i in range(5))


def test_vector_codes_edges(spark):
    coded, books = vector_codes.compress(spark.createDataFrame([], SHAPE))
    assert coded.count() == 0 and coded.columns == ["vec_id", "label", "code", "error"] and books.size == 0
    mixed = spark.createDataFrame([(1, [0.5] * 16, 1), (2, [0.5] * 16, None), (3, [0.1], 1), (4, [], 1)], SHAPE)
    got = {r["vec_id"]: (r["code"], r["error"]) for r in vector_codes.compress(mixed)[0].collect()}
    assert got == {1: ("00" * 16, 0), 2: ("00" * 16, 0), 3: (None, None), 4: (None, None)}
    with pytest.raises(ValueError, match="16 equal parts"):
        vector_codes.compress(mixed.where("vec_id = 3"))


def test_cover_trees_cover_and_separate():
    draw = np.random.default_rng(2)
    points = draw.integers(-50, 50, (1500, 4))
    points[500:1000] = points[3]
    order, nodes = vector_codes.cover_tree(points)
    assert sorted(order.tolist()) == list(range(len(points)))
    for node in nodes:
        own = points[order[node["begin"] : node["end"]]]
        assert np.sqrt(((own - points[node["centre"]]) ** 2).sum(1).max()) <= node["radius"] + 1e-9
        kids = nodes[node["child"] : node["child"] + node["children"]]
        if len(kids):
            assert kids["begin"][0] == node["begin"] and kids["end"][-1] == node["end"] and (kids["begin"][1:] == kids["end"][:-1]).all()
            centres = points[kids["centre"]]
            apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(-1))[~np.eye(len(kids), dtype=bool)]
            assert node["centre"] in kids["centre"] and (not len(apart) or apart.min() >= kids["radius"].max())
    book = np.concatenate([points[:40], points[:5]])
    got = np.full(len(points), -1)
    for begin, end, entry in vector_codes.assign(points, order, nodes, book):
        for a, b, e in zip(begin, end, entry):
            got[order[a:b]] = e
    assert (got == ((points[:, None] - book) ** 2).sum(-1).argmin(1)).all()


# ------------------------------------------------------------------------------- whitening


def test_whitening_matches_eigenvectors(spark):
    rows, odd = vectors(dim=12)
    rows = [(i, [x * (1 + 0.3 * (k < 3)) for k, x in enumerate(v)], label) for i, v, label in rows]
    frame = spark.createDataFrame(rows + odd, SHAPE).withColumn("n", F.lit("old")).withColumn("x", F.lit(2)).withColumn("a.`b", F.lit(1)).repartition(3)
    got = whitening.whiten(frame).collect()
    x = whole(rows)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    centred = fit - total / n
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    white = (x - total / n) @ vectors_[:, :4] / np.sqrt(values[:4])
    assert len(got) == 4 * len(rows)
    want = {(str(r[0]), k + 1, tuple(x[i])): white[i, k] for i, r in enumerate(rows) for k in range(4)}
    signs = {}
    by_id = {r[0]: tuple(x[i]) for i, r in enumerate(rows) if r[0] is not None and r[0] != 9}
    for r in got:
        assert r["n"] == n and r["x"] == 2 and r["a.`b"] == 1 and r["identity_error"] < 1e-10
        assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-12
        if r["vec_id"] in by_id:
            x_row = by_id[r["vec_id"]]
            assert r["deviation"] == sum((n * int(v) - int(s)) ** 2 for v, s in zip(x_row, total))
            expected = want[(str(r["vec_id"]), r["component"], x_row)]
            sign = signs.setdefault(r["component"], 1 if expected * r["whitened"] > 0 else -1)
            assert abs(sign * r["whitened"] - expected) < 1e-9


def axes(lengths):
    """Points along the axes: the covariance is diagonal, so equal lengths give equal eigenvalues."""
    d = len(lengths)
    return [[float(s * v) if k == i else 0.0 for k in range(d)] for i, v in enumerate(lengths) for s in (1, -1)]


@pytest.mark.parametrize("lengths,explained", [([9, 9, 9, 9, 9, 3, 2], [81] * 4), ([9, 9, 9, 5, 3, 2, 1], [81, 81, 81, 25]), ([5, 5, 0, 0], [25, 25]), ([0, 0, 7], [49])])
def test_whitening_finds_equal_eigenvalues(spark, lengths, explained):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(axes(lengths))], "vec_id long, embedding array<double>")
    got = sorted({(r["component"], r["explained"], r["identity_error"]) for r in whitening.whiten(frame, scale=1).collect()})
    assert [c for c, _, _ in got] == list(range(1, len(explained) + 1)) and all(e < 1e-9 for _, _, e in got)
    assert np.allclose([e for _, e, _ in got], np.array(explained) / sum(v * v for v in lengths))


def test_whitening_edges(spark):
    assert whitening.whiten(spark.createDataFrame([], SHAPE)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.5], 1), (1, [0.5, 0.5], 1)], SHAPE)).collect()
    assert [(r["vec_id"], r["component"], r["whitened"]) for r in same] == [(1, None, None)] * 2
    mixed = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.5], 1), (2, [0.1, 0.9], None), (3, [0.3], 1)], SHAPE)).collect()
    assert sorted((r["vec_id"], r["component"]) for r in mixed if r["component"]) == [(1, 1), (2, 1)]
    assert [(r["vec_id"], r["component"]) for r in mixed if not r["component"]] == [(3, None)]


# ------------------------------------------------------------------------------- token files


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 3000])
@pytest.mark.parametrize("top", [1, 2, 50257, 2**32])
def test_blocks_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64)
    ids[::29] = top - 1
    record = token_files.Record(b"xx" + token_files.encode_record(3, 5, [1, None], [n, 0], ids.astype("<u4")), 2)
    assert (record.ids() == ids).all() and (record.part, record.first, record.null.tolist()) == (3, 5, [0, 1])
    for a, b in ((0, 5), (100, 140), (n - 3, n + 9), (n, n)):
        assert (record.ids(max(a, 0), b) == ids[max(a, 0) : b]).all()


def test_outliers_leave_the_block_narrow():
    ids = np.arange(128, dtype="<u4") % 8 + 1000
    ids[[5, 70]] = 50_000
    bases, widths, _, _, words, places, high = token_files.encode_blocks(ids)
    assert bases.tolist() == [1000] and widths.tolist() == [3] and len(words) == 6 and places.tolist() == [5, 70] and len(high) == 2


def test_fast_tokens_equal_the_whole_tokenizer():
    tokens = token_files.ByteTokens(queries.byte_tokenizer())
    plain = Tokenizer.from_file(queries.byte_tokenizer())
    draw = np.random.default_rng(0)
    signs = [" ", " ", "\n", "\t", "a", "B", "é", "1", ".", ",", "'", "s", "\xa0", "\x1c", " ", "日", "<|endoftext|>", "\x85", "*"]
    texts = ["", " ", "a  b", "a\n b", "a \nb", "don't  it's", "a.\nB, c\n\nd", "\n x"] + ["".join(draw.choice(signs, draw.integers(0, 16))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(tokens.text(text), tokens.kind).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_files_hold_every_document(spark, tmp_path):
    long = "word. Other\nline " * 20_000
    rows = [(5, "b b"), (3, None), (3, ""), (3, "x"), (-2, long), (None, "last"), (None, "last"), (8, "퟿ é"), (5, "b b"), (4, "!!!")] + [(100 + i, f"text {i}") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("part", F.lit("p")).withColumn("a.b", F.lit(1)).repartition(4)
    path = str(tmp_path / "tokens")
    got = token_files.store_tokens(frame, queries.byte_tokenizer(), path=path, file_bytes=900).orderBy("start").collect()
    plain = Tokenizer.from_file(queries.byte_tokenizer())
    made = {}
    for d, t in rows:
        raw = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        made.setdefault(d, []).append((len(raw) // 4, zlib.crc32(raw)))
    assert len(got) == len(rows)
    start = 0
    for r in got:  # gapless and ascending, null ids last
        assert r["start"] == start
        start += r["n_tokens"]
        made[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda d: (d is None, d or 0)) and not any(made.values())
    cut = token_files.read_ids(spark, path, 1000, 1100).where("part = 0").collect()
    assert [(c["at"], c["ids"]) for c in cut] == [(1000, plain.encode(long, add_special_tokens=False).ids[1000:1100])]


def test_token_files_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.store_tokens(empty, queries.byte_tokenizer()).count() == 0


def test_token_query_covers_its_table(spark):
    got = queries.op12_token_files(spark, SF).agg(F.count("*"), F.count_distinct("doc_id"), F.max(F.col("start") + F.col("n_tokens")), F.sum("n_tokens")).first()
    assert got[0] == got[1] == spark.read.parquet(f"{SF}/documents.parquet").count() and got[2] == got[3]
