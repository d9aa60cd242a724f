"""Vectors, packing, token files and WARC on small tables, against brute force and round trips."""

import gzip
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import ann, embed_dedup, packing, rangecoder, tokenfile, tokens, warc
from quire.llm.components import components

TEXTS = [
    "", " ", "a  b", " lead", "trail ", "x\n\ny", "a \n b", "tab\tx", "it's we'll 'S", "a\x1cb \x1c c", "Σας ΣΑΣ é ﬁ", "1234 56a7", "\n", "a\r\nb",
    "x y", "end\n", "a\x85 b", "日本語 テキスト。", "́abc ́", "don't stop.\nNext line, then\nmore", "a b c", "x 　 y", "é ö",
]


@pytest.mark.parametrize("name,kind", [(tokenfile.VOCABULARY, tokens.BYTE_LEVEL), (packing.VOCABULARY, tokens.WORD_LEVEL)])
def test_cached_encoding_is_the_tokenizers(name, kind):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.tokenizer_path(name))
    rng = random.Random(1)
    alphabet = "ab é\n.,'1 \tß"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(400)]
    encoder = tokens.Encoder(tokens.tokenizer_path(name), kind, most=60)
    for i in range(0, len(texts), 50):
        flat, counts = encoder.encode(texts[i : i + 50])
        want = [x.ids for x in plain.encode_batch(texts[i : i + 50], add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want] and flat.tolist() == [t for w in want for t in w]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000, 70_001])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n) - 1, 50_256).astype(np.int64)
    data = rangecoder.encode(ids, 50_257)
    assert (rangecoder.decode(data, n, 50_257) == ids).all()


def test_range_coder_extremes_and_small_vocabulary():
    for ids, v in ((np.full(5000, 50_256), 50_257), (np.arange(50_257), 50_257), (np.zeros(10, np.int64), 1), (np.arange(300) % 2, 2)):
        assert (rangecoder.decode(rangecoder.encode(ids, v), len(ids), v) == ids).all()
    text = np.tile(np.arange(40), 3000)
    assert len(rangecoder.encode(text, 50_257)) < len(text) / 2  # 16 bits each without a model


def test_chunks_are_checked():
    ids = np.arange(1000)
    data = tokenfile.write_chunk(["1", None], [400, 600], ids, 50_257, block_tokens=300)
    assert [(n, x.tolist()) for n, x in tokenfile.read_chunk(data, 50_257)] == [("1", list(range(400))), (None, list(range(400, 1000)))]
    broken = data[:-40] + bytes([data[-40] ^ 255]) + data[-39:]
    with pytest.raises(ValueError):
        list(tokenfile.read_chunk(broken, 50_257))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, ids string, start int")


def text_rows():
    rng = random.Random(9)
    words = [f"wört{i}" for i in range(50)]
    rows = [(i * 3, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 900)))) for i in range(60)]
    return rows + [(1, None), (2, ""), (3, "x " * 6000), (3, "twice"), (None, "no id")] + [(1000 + i, t) for i, t in enumerate(TEXTS)]


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.tokenizer_path(tokenfile.VOCABULARY))
    rows = text_rows()
    index = tokenfile.write_token_files(docs_of(spark, rows), block_tokens=2000)
    got = tokenfile.read_token_files(index).orderBy("start").collect()
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(plain.encode(t or "", add_special_tokens=False).ids + [0])
    at = 0
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == at and r["n_tokens"] == len(ids) and ids in want[r["doc_id"]]
        want[r["doc_id"]].remove(ids)
        at += len(ids)
    assert not any(want.values())
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    assert tokenfile.read_token_files(tokenfile.write_token_files(docs_of(spark, []))).count() == 0


def test_best_fit_takes_the_tightest_window():
    room = packing.Capacities(16)
    for capacity, w in ((10, 0), (5, 1), (16, 2)):
        room.add(capacity, w)
    assert [room.take(4), room.take(4), room.take(11), room.take(1)] == [(5, 1), (10, 0), (16, 2), None]


@pytest.mark.parametrize("seed", range(5))
def test_packing_holds_every_id_once(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 5, 50, 64, 100, 130, 700]) for _ in range(rng.choice([1, 3, 200]))]
    windows = packing.pack(lengths, window=64, least_cut=4)
    pieces = defaultdict(list)
    for w in windows:
        assert 0 < sum(n for _, _, n in w) <= 64 and all(n > 0 for _, _, n in w)
        for doc, start, n in w:
            pieces[doc].append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, m in sorted(pieces[doc]):
            assert start == at
            at += m
        assert at == n
    assert len(windows) <= sum(lengths) / 64 * 1.07 + 1


def test_pack_documents(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.tokenizer_path(packing.VOCABULARY))
    rows = text_rows()
    out = packing.pack_documents(docs_of(spark, rows), group_tokens=20_000).collect()
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at and len(r["ids"]) == 4 * r["length"]
            at += r["length"]
        assert at <= 2048
    for i, t in rows:
        if i == 3:
            continue
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["start"])
        assert b"".join(r["ids"] for r in own) == np.array(ids, "<u4").tobytes() and {r["doc_tokens"] for r in own} == {len(ids)}
    assert packing.pack_documents(docs_of(spark, [])).count() == 0


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


def test_warc_round_trip(spark, tmp_path):
    long = "<p>é" + "x" * 200
    rows = [(5, "http://a/", long), (3, "http://b/ c\n", long), (9, None, long), (4, "u", "short"), (2, "u", "short"), (8, "u", None), (7, "u", ""), (None, "n", long), (3, "again", long), (11, "u", "\r\n\r\n" + "y" * 300)]
    index = warc.write_archives(pages_of(spark, rows), f"file://{tmp_path}/warc", archive_bytes=600)
    got = warc.read_records(index).collect()
    assert len(got) == len(rows) and index.select("path").distinct().count() > 1
    responses = {r["record_id"]: r for r in got if r["record_type"] == "response"}
    for r in got:
        html = next(h for i, u, h in rows if i == r["page_id"] and (i != 3 or True)) or ""
        if html == long and r["page_id"] != 3:
            assert r["record_type"] == "revisit" and r["payload"] is None and responses[r["refers_to_id"]]["page_id"] == 3
        else:
            assert r["record_type"] == "response" and bytes(r["payload"]).decode() == html
    rec = index.where("page_id = 11").first()
    with open(rec["path"].removeprefix("file://"), "rb") as f:
        f.seek(rec["offset"])
        record = gzip.decompress(f.read(rec["length"]))
    assert record.startswith(b"WARC/1.1\r\nWARC-Type: response") and record.endswith(b"y\r\n\r\n")
    assert rec["payload_digest"] == hashlib.sha256(rows[-1][2].encode()).hexdigest()
    some = warc.read_records(index.where("page_id in (2, 11)"))
    assert {r["page_id"] for r in some.collect()} == {2, 11}
    assert warc.read_records(warc.write_archives(pages_of(spark, []))).count() == 0
    nulls = warc.write_archives(pages_of(spark, [(None, "a", long), (None, "b", long)]))
    assert {r["record_type"] for r in nulls.collect()} == {"response"}


def test_warc_of_repeated_ids_with_other_payloads(spark, tmp_path):
    a, b = "a" * 200, "b" * 300
    rows = [(3, "u", a), (3, "v", b), (5, "w", a), (6, "x", b), (7, "y", "z" * 400_000), (8, "y", "z" * 400_000)]
    pages_of(spark, rows).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, warc.op8_warc(spark, str(tmp_path)).collect()), key=str)

    def row(i, html, refers_to):
        return (i, len(html), hashlib.sha256(html.encode()).hexdigest(), "response" if refers_to is None else "revisit", refers_to)

    want = [row(3, a, None), row(3, b, None), row(5, a, 3), row(6, b, 3), row(7, rows[4][2], None), row(8, rows[4][2], 7)]
    assert got == sorted(want, key=str)


def test_range_reads_are_coalesced():
    near = [(0, 10), (10, 5), (20, 5), (20 + warc.GAP + 100, 5), (warc.MOST_READ * 3, warc.MOST_READ * 2), (warc.MOST_READ * 5, 1)]
    got = list(warc._coalesced(near))
    assert [own for _, _, own in got] == [[0, 1, 2], [3], [4], [5]] and got[0][:2] == (0, 25)


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, node int, component int")


def vector_rows(seed=0, groups=12):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        c = rng.normal(size=8)
        for _ in range(int(rng.integers(1, 40))):
            rows.append((len(rows) * 2, (c * rng.uniform(0.1, 9) + rng.normal(size=8) * rng.choice([0.05, 0.2, 0.5])).tolist()))
    rows += [(1, None), (3, [0.0] * 8), (5, [float("nan")] + [1.0] * 7), (7, [None] + [1.0] * 7), (9, [float("inf")] + [1.0] * 7), (11, []), (13, [1.0, 2.0, 3.0]), (15, rows[0][1]), (17, rows[0][1]), (None, rows[0][1]), (19, rows[3][1]), (19, rows[3][1])]
    return rows


def cosine_links(rows):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.float32(rows[i][1]).astype(float) / np.linalg.norm(np.float32(rows[i][1]).astype(float)) for i in ok}
    return {(i, j) for i in ok for j in ok if i != j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9}


def test_embedding_dedup_is_brute_force(spark):
    rows = vector_rows()
    pairs = cosine_links(rows)
    label = list(range(len(rows)))
    while True:
        new = list(label)
        for i, j in pairs:
            new[i] = min(new[i], label[j])
        if new == label:
            break
        label = new
    want = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        c = min(ids, default=None)
        want.append((d, sum(1 for a, _ in pairs if a == i), c, d is not None and d == c))
    got = [tuple(r) for r in embed_dedup.near_duplicates(vectors_of(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert embed_dedup.near_duplicates(vectors_of(spark, [])).count() == 0
    assert [tuple(r) for r in embed_dedup.near_duplicates(vectors_of(spark, [(4, None)])).collect()] == [(4, 0, 4, True)]


def test_link_counts_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 7)
    rows = [(i, [1.0, 0.001 * i, 0.0]) for i in range(50)] + [(100 + i, [0.0, 1.0, 0.001 * i]) for i in range(20)]
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(vectors_of(spark, rows)).collect()}
    assert {got[i]["n_links"] for i in range(50)} == {49} and {got[100 + i]["component_id"] for i in range(20)} == {100}


def test_windows_reach_over_partitions(spark):
    """The pairs found join what the windows of each pass, sorted as a whole, hold."""
    import pandas as pd

    rng = np.random.default_rng(5)
    x = np.float32(np.repeat(rng.normal(size=(250, 6)), 8, axis=0) + 0.15 * rng.normal(size=(2000, 6)))
    nodes = pd.DataFrame({"node": np.arange(2000), "embedding": list(x)})
    turns = embed_dedup.passes(2000, window=3)
    rows = pd.concat(embed_dedup._hashes(iter([nodes]), turns)).sort_values(["turn", "width", "h", "node"])
    unit = embed_dedup.matrix(nodes["embedding"])
    root = list(range(2000))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for _, own in rows.groupby("turn"):
        order = own["node"].tolist()
        for gap in (1, 2, 3):
            for a, b in zip(order, order[gap:]):
                if unit[a] @ unit[b] >= 0.9:
                    root[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, embedding array<float>")
    pairs = embed_dedup.near_pairs(df, window=3)
    got = {r["node"]: r["component"] for r in components(pairs).collect()}
    assert [got.get(i, i) for i in range(2000)] == [find(i) for i in range(2000)]


def test_embedding_dedup_joins_outlying_vectors_of_a_hot_third(spark):
    rng = np.random.default_rng(11)

    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    n, width = 4000, 64
    center = unit(rng.normal(size=(1, width)))
    away = rng.normal(size=(n, width))
    hot = 0.95**0.5 * center + 0.05**0.5 * unit(away - away @ center.T * center)
    side = rng.normal(size=(300, width))
    side -= (side * hot[:300]).sum(axis=1, keepdims=True) * hot[:300]
    outlying = 0.905 * hot[:300] + (1 - 0.905**2) ** 0.5 * unit(side)
    x = np.concatenate([hot, outlying, unit(rng.normal(size=(2 * n, width)))]).astype(np.float32)
    linked = (outlying @ hot.T >= 0.9).any(axis=1)
    assert linked.all()
    got = embed_dedup.near_duplicates(vectors_of(spark, list(enumerate(x.tolist())))).toPandas().set_index("vec_id")["component_id"]
    assert (got[:n] == 0).all()
    assert (got[n : n + 300] == 0).mean() >= embed_dedup.RECALL


def test_ann_recall_and_order(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(3000)] + [(5000 + i, rng.normal(size=16).tolist()) for i in range(3)]
    rows += [(6001, rows[40][1]), (6000, rows[40][1]), (7000, None), (7001, [0.0] * 16), (7002, [1.0, 2.0]), (None, rows[0][1])]
    index = ann.build(vectors_of(spark, rows))
    got = ann.search(index, index.rows.where("vec_id % 20 = 0"), 20).collect()
    usable = [(i, np.float32(v).astype(float)) for i, v in rows if i is not None and v and len(v) == 16 and any(v)]
    ids, x = np.array([i for i, _ in usable]), np.stack([v for _, v in usable])
    by = defaultdict(list)
    for r in got:
        by[r["query_id"]].append(r)
    hits = total = 0
    for q in ids[ids % 20 == 0].tolist():
        s = x @ x[ids.tolist().index(q)]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:20]
        own = sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        assert all(abs(r["score"] - s[ids.tolist().index(r["vec_id"])]) < 1e-9 for r in own)
        hits += len({r["vec_id"] for r in own} & set(ids[order].tolist()))
        total += 20
    assert hits / total >= 0.93
    assert max(zlib.crc32(b""), 0) == 0


def test_ann_visits_few_lists_of_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(60, 24))
    x = np.float32(centers[rng.integers(0, 60, 6000)] + 0.4 * rng.normal(size=(6000, 24)))
    index = ann.build(vectors_of(spark, list(enumerate(x.tolist()))))
    assert index.visits < 0.3 * len(index.quantizer.centroids)
    got = ann.search(index, index.rows.where("vec_id % 50 = 0")).toPandas()
    x = x.astype(float)
    hits = sum(len(set(np.argsort(-(np.where(np.arange(6000) == q, -np.inf, x @ x[q])))[:20].tolist()) & set(own["vec_id"])) for q, own in got.groupby("query_id"))
    assert hits >= 0.9 * 120 * 20 and len(got) == 120 * 20


def test_ann_finds_the_first_of_many_copies(spark):
    rng = np.random.default_rng(9)
    x = np.float32(rng.normal(size=(1500, 16)))
    x[300:900] = x[0]  # more copies than candidates, stored from the largest vec_id down
    index = ann.build(vectors_of(spark, [(i, x[i].tolist()) for i in reversed(range(1500))]))
    got = ann.search(index, index.rows.where("vec_id % 20 = 0")).toPandas()
    hits, x = 0, x.astype(float)
    for q, own in got.groupby("query_id"):
        s = np.round(np.where(np.arange(1500) == q, -np.inf, x @ x[q]), 9)
        hits += len(set(np.lexsort((np.arange(1500), -s))[:20].tolist()) & set(own["vec_id"]))
    assert len(got) == 75 * 20 and hits >= 0.95 * len(got)


def test_ann_of_repeated_ids(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [2.0, 1.0]), (1, [1.0, 3.0]), (2, [0.5, 0.5])]
    index = ann.build(vectors_of(spark, rows))
    got = [(r["rank"], r["vec_id"], r["score"]) for r in ann.search(index, index.rows.where("vec_id = 20")).orderBy("rank").collect()]
    assert got in ([(1, 1, 2.0), (2, 1, 1.0), (3, 2, 0.5)], [(1, 1, 3.0), (2, 1, 1.0), (3, 2, 0.5)])


def test_ann_small_and_empty_tables(spark):
    index = ann.build(vectors_of(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]))
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(index, index.rows.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]
    none = ann.build(vectors_of(spark, [(0, None)]))
    assert ann.search(none, none.rows).count() == 0
    assert ann.search(ann.build(vectors_of(spark, [])), vectors_of(spark, [])).count() == 0
    one = ann.build(vectors_of(spark, [(0, [1.0, 2.0])]))
    assert ann.search(one, one.rows).count() == 0
    assert one.rows.agg(F.count("*")).first()[0] == 1
