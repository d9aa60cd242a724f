"""The queries of the operators on small tables: their columns, and what bounds them."""

import random

import pytest
from pyspark.sql import functions as F

from quire.llm import packing, quality, queries

COLUMNS = {
    "op2_ann": "query_id bigint, rank int, vec_id bigint, score double",
    "op3_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op4_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_embedding_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op6_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op7_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op8_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op9_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op10_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op11_fill_in_middle": "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string",
    "op12_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op13_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('tables')}"
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("the cat sat on a mat and saw many red birds fly".split()) for _ in range(n))
    texts = [None, "", "...", *[say(40) for _ in range(37)]]
    docs = [(i, t, "en" if i % 3 else None, f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, None), (61, [0.0] * 8)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    pages = [(i, f"http://a.example/{i}", None if i == 1 else "<p>" + "x" * (100 * (i % 2))) for i in range(8)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", COLUMNS)
def test_queries_have_the_columns_of_their_contracts(spark, tables, name):
    got = queries.QUERIES[name](spark, tables)
    kinds = dict(got.dtypes)
    assert {c: kinds.get(c) for c in (x.split()[0] for x in COLUMNS[name].split(", "))} == dict(x.split() for x in COLUMNS[name].split(", "))
    rows = got.count()
    if name in ("op3_language_id", "op4_quality", "op7_mixing", "op9_simhash", "op10_token_files", "op11_fill_in_middle", "op12_sharding"):
        assert rows == 40
    elif name in ("op2_ann", "op5_embedding_dedup", "op8_warc", "op13_whitening"):
        assert rows == {"op2_ann": 60, "op5_embedding_dedup": 62, "op8_warc": 8, "op13_whitening": 61 * 8}[name]


def _rooms(lengths: list[int], window: int) -> list[int]:
    """What plain best-fit decreasing leaves of each window, searching all of them for each rest."""
    rooms = [0 for n in lengths for _ in range(n // window)]
    for n in sorted((n % window for n in lengths if n % window), reverse=True):
        fit = [k for k, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(window - n)
    return sorted(rooms)


@pytest.mark.parametrize("window", [1, 2, 8, 50, 64, 100])
def test_packing_is_best_fit_decreasing(window):
    rng = random.Random(window)
    for n in (0, 1, 5, 60, 300):
        lengths = [rng.choice([rng.randint(1, window), rng.randint(1, 3 * window), max(1, window // 2)]) for _ in range(n)]
        uncut = packing.pack(lengths, window, least_cut=window + 1)
        assert sorted(window - sum(m for _, _, m in w) for w in uncut) == _rooms(lengths, window)
        cut = packing.pack(lengths, window, least_cut=1)
        assert len(cut) <= len(uncut) and all(sum(m for _, _, m in w) <= window for w in cut)
        for windows in (uncut, cut):
            places = sorted((d, s + k) for w in windows for d, s, m in w for k in range(m))
            assert places == [(d, k) for d, m in enumerate(lengths) for k in range(m)]


def test_quality_is_fitted_on_one_row_of_a_repeated_document(spark, monkeypatch):
    seen = []
    train = quality.train
    monkeypatch.setattr(quality, "train", lambda x, y: seen.append((x.copy(), y.copy())) or train(x, y))
    docs = spark.createDataFrame([(i, f"text {i} a", i % 7) for i in range(30)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    often = docs.where("doc_id = 1").withColumn("text", F.explode(F.array_repeat(F.col("text"), 5000)))
    quality.fit(docs, labels)
    quality.fit(docs.unionByName(often).unionByName(docs.withColumn("text", F.concat("text", F.lit(" later")))), labels)
    assert len(seen[0][1]) == len(seen[1][1]) and (seen[0][0] == seen[1][0]).all() and (seen[0][1] == seen[1][1]).all()
    quality.fit(docs, labels, sample=5)
    assert len(seen[2][1]) == 5
