"""The corpus pipeline against brute force."""

import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa

import corpus_pipeline
from quire.llm import near_copies, packing, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_force(rows):
    """doc_ids that stay: the smallest of each component of similarity 0.8."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return {min(ds) for ds in least.values()}


def texts(rng, groups, copies):
    vocabulary = [f"{a}{b}{c}" for a in "bdfglmnprst" for b in "aeiou" for c in "lmnrst"]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(150)]
        for k in range(copies):
            own = list(base)
            for at in rng.sample(range(5, 145), 2 * k):
                own[at] = rng.choice(vocabulary)
            rows.append((len(rows) * 2 + 1, " ".join(own)))
    return rows


def test_near_copies_are_brute_force(spark):
    rows = texts(random.Random(4), 30, 4)
    rows += [(1000, "Three short words"), (1002, "three short  words"), (1004, "other short words"), (1006, ""), (1008, " "), (1010, rows[0][1])]
    docs = spark.createDataFrame([(d, t, "x", "s", len(t)) for d, t in rows], DOCS)
    kept = near_copies.one_of_each(docs)
    want = brute_force(rows)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want and len(want) < len(rows) - 20
    assert near_copies.one_of_each(docs.limit(0)).count() == 0


def test_run_packs_what_the_stages_keep(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = texts(random.Random(5), 20, 3)
    rows += [(900, "12 34"), (902, rows[0][1])]
    docs = spark.createDataFrame([(d, t, "x" if d % 4 == 1 else "y", "s", len(t)) for d, t in rows], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    plain = Tokenizer.from_file(tokens.tokenizer_path(packing.VOCABULARY))
    # 900 has no language; the line of 902 is a repeated one, so it is the only empty text.
    after = {d: "" if d == 902 else t for d, t in rows if d != 900}
    want = brute_force(sorted(after.items()))
    assert {r["doc_id"] for r in out if r["doc_tokens"] > 1} == {d for d in want if d != 902}
    own = defaultdict(list)
    for r in out:
        own[r["doc_id"]].append(r)
    for d, parts in own.items():
        ids = plain.encode(after[d], add_special_tokens=False).ids + [packing.END_ID]
        once = {r["start"]: r["ids"] for r in parts}
        assert sum(r["length"] for r in parts) % len(ids) == 0 and {r["doc_tokens"] for r in parts} == {len(ids)}
        if sum(len(x) for x in once.values()) == 4 * len(ids):
            assert b"".join(once[s] for s in sorted(once)) == np.array(ids, "<u4").tobytes()


def test_fingerprints_are_majority_bits_and_keys_reach_the_similarity():
    import pandas as pd

    rng = np.random.default_rng(6)
    a = rng.integers(-(2**63), 2**63, 450)
    sets = [a[:400], a[50:450], rng.permutation(a[:400]), rng.integers(-(2**63), 2**63, 400), a[:1], a[:1]]  # the first two have 350 of 450
    found = next(near_copies._fingerprints(iter([pd.Series(sets)])))
    bits = np.stack([np.unpackbits(x.view(np.uint8)) for x in found])
    assert bits.shape[1] == near_copies.BITS and (bits[0] == bits[2]).all() and (bits[4] == bits[5]).all()
    assert 0.1 < (bits[0] != bits[1]).mean() < 0.22 and 0.4 < (bits[0] != bits[3]).mean() < 0.6 and 0.4 < bits[0].mean() < 0.6
    number = near_copies._number_of_keys(20, 0.8)
    assert near_copies._met(0.1515, 20, number) > 0.994 > near_copies._met(0.1515, 20, number - 20)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(found))), pa.array(found.tolist())], names=["node", "fp"])
    keys = pa.Table.from_batches(near_copies._keys(20, number)(iter([batch]))).column("key").to_numpy().reshape(len(found), number)
    assert (keys[0] == keys[2]).all() and len(set(keys[0])) == number and set(keys[0]) & set(keys[1])


def test_packing_workers_hold_little_between_tasks():
    coder = tokens.Encoder(tokens.tokenizer_path(packing.VOCABULARY), tokens.WORD_LEVEL)
    words = [f"{a}{b}{c}" for a in "bdfgl" for b in "aeiou" for c in "lmnrst"]
    before = [x.tolist() for x in coder.encode([" ".join(words), "lal"])]
    coder.encode(["lal"])
    coder.keep(10)
    assert len(coder.pieces.index) == 10 and "lal" in coder.pieces.index and not coder.words.index
    assert [x.tolist() for x in coder.encode([" ".join(words), "lal"])] == before


def shuffled(spark):
    """Bytes that the session's stages have written to shuffles."""
    jvm = spark.sparkContext._jvm
    return sum(
        stage.shuffleWriteBytes()
        for stage in jvm.scala.jdk.javaapi.CollectionConverters.asJava(
            spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        )
    )


def test_texts_without_near_copies_stay_in_their_place(spark, tmp_path):
    """One pair of near copies and many texts that share keys with others: neither the texts nor their shingles are shuffled or written."""
    rng, text = random.Random(8), []
    for _ in range(120):
        text.append(" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(3000)))
    text.append(text[5] + " end")
    rows, size = [(d, t, "x", "s", len(t)) for d, t in enumerate(text)], sum(map(len, text))
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "docs"))
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    files = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet") if p.is_file())
    docs, before, there, own = spark.read.parquet(str(tmp_path / "docs")), shuffled(spark), files(), near_copies.KEY_BITS
    near_copies.KEY_BITS = 4  # many share a key
    try:
        kept = near_copies.one_of_each(docs).select("doc_id").collect()
        moved = shuffled(spark) - before
    finally:
        near_copies.KEY_BITS = own
    assert {r["doc_id"] for r in kept} == set(range(120))
    assert moved < 0.3 * size and files() - there < 0.3 * size


def test_words_and_shingles_are_those_of_the_text():
    import pandas as pd

    known = near_copies._Words()
    assert len(known.of("")) == len(known.of(" \t\x0b ")) == 0 and len(known.of("One word")) == 1
    assert known.of("A\tb\x0cÄ  A\x1fB\r\n").tolist() == [known[w.encode()] for w in ("a", "b", "Ä", "a\x1fb")]
    near_copies.SLAB, own = 7, near_copies.SLAB
    try:
        cut = known.of("the house and  extraordinarily gardens ")
    finally:
        near_copies.SLAB = own
    assert cut.tolist() == known.of("the house and extraordinarily gardens").tolist() and len(cut) == 5
    texts = pd.Series(["a b c d e f", "A B  c d e\tf a b c d e", "b a c d e f", "a b", "b a", None, " "])
    got = [set(x.tolist()) for x in next(near_copies._hashes(5)(iter([texts])))]
    assert [len(x) for x in got] == [2, 6, 2, 1, 1, 0, 0] and got[0] < got[1] and got[3] != got[4]
    assert len(got[0] & got[2]) == 0 and all(len(x) == len(set(map(tuple, [[h] for h in x]))) for x in got)


def test_buckets_of_two_or_three_far_apart_are_dropped(spark):
    low, high = 0b111, -1 << 32  # 3 bits from 0; 32 bits from 0
    far = 0x0F0F0F0F0F0F0F0F  # 32 bits from 0 and from high
    firsts = {1: [0, far], 2: [0, low], 3: [0, high, far], 4: [0, low, high], 5: [high, 0, low], 6: [far, high, far ^ 1], 7: [0, 0, high], 8: [0, high, far, ~far], 9: [5]}
    rows = [(10 * k + i, x, k) for k, xs in firsts.items() for i, x in enumerate(xs)]
    kept = near_copies._open(spark.createDataFrame(rows, "node long, first long, key long")).collect()
    assert {r["key"] for r in kept} == {2, 4, 5, 6, 7, 8} and len(kept) == sum(len(firsts[k]) for k in (2, 4, 5, 6, 7, 8))


def drawn_prints(rng, base, count, odds):
    """``count`` fingerprints whose bits differ from ``base`` with ``odds``."""
    return np.packbits(base ^ (rng.random((count, near_copies.BITS)) < odds), axis=1).view(np.int64)


def test_chance_buckets_leave_few_rows(spark, monkeypatch):
    """Unrelated texts that share a key by chance don't go on as rows, however many there are."""
    rng, rows, own = np.random.default_rng(9), {}, near_copies.written
    prints = drawn_prints(rng, np.zeros(near_copies.BITS, bool), 1000, 0.5)
    frame = spark.createDataFrame([(k, 100, x.tolist()) for k, x in enumerate(prints)], "node long, n int, fp array<bigint>")

    def counted(df, name):
        out = own(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(near_copies, "KEY_BITS", 12)
    monkeypatch.setattr(near_copies, "written", counted)
    assert near_copies.links(frame, spark.createDataFrame([], "node long, text string")).count() == 0
    assert rows["buckets"] < 100 and rows["labelled"] < 100


def test_each_pair_that_shares_a_key_is_compared_once(spark, monkeypatch):
    """A group of which no pair turns out linked: the pairs with the references and the others are all there, none twice."""
    rng, seen = np.random.default_rng(10), []
    prints = np.concatenate([drawn_prints(rng, rng.random(near_copies.BITS) < 0.5, 60, 0.08), drawn_prints(rng, rng.random(near_copies.BITS) < 0.5, 60, 0.08)])
    sizes = rng.integers(70, 110, len(prints))
    frame = spark.createDataFrame([(k, int(n), x.tolist()) for k, (n, x) in enumerate(zip(sizes, prints))], "node long, n int, fp array<bigint>")

    def compared(pairs, texts, shingle, least):
        seen.append({(r["u"], r["v"]) for r in pairs.collect()})
        return spark.createDataFrame([], "u long, v long")

    monkeypatch.setattr(near_copies, "KEY_BITS", 12)
    monkeypatch.setattr(near_copies, "_verified", compared)
    near_copies.links(frame, spark.createDataFrame([], "node long, text string"))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(prints))), pa.array(prints.tolist())], names=["node", "fp"])
    keys = pa.Table.from_batches(near_copies._keys(12, near_copies._number_of_keys(12, 0.8))(iter([batch]))).column("key").to_numpy().reshape(len(prints), -1)
    bits = np.unpackbits(prints.view(np.uint8), axis=1)
    want = {
        (u, v)
        for v in range(len(prints))
        for u in range(v)
        if (keys[u] == keys[v]).any() and min(sizes[u], sizes[v]) >= 0.8 * max(sizes[u], sizes[v]) and (bits[u] != bits[v]).sum() <= near_copies.FAR
    }
    stars, across = seen
    assert stars | across == want and not stars & across and len(across) > 100 and len(want) > 1500
