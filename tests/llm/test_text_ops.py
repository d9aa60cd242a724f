"""Line dedup, SimHash, mixing, language ID and quality on small tables, against brute force."""

import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from quire.llm import langid, line_dedup, mixing, quality, simhash
from quire.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, kept string, n_lines string"


def documents(spark, rows):
    """rows: (doc_id, text[, lang, source]); extra columns have names that operators use inside."""
    full = [(r + (None,) * 4)[:4] for r in rows]
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), "x", "y", "z") for i, t, g, s in full], DOCS)


def random_lines(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    return [[rng.choice(words) for _ in range(rng.choice([1, 3, 7, 8, 9, 15, 16, 17]))] for _ in range(n)]


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def repeats(a, b):
    return a == b or (min(len(a), len(b)) >= line_dedup.MIN_WORDS and one_edit(a, b))


def dedup_by_hand(rows):
    """Texts by doc_id, for unique ids."""
    before, out = [], {}
    for i, text in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0])):
        kept = []
        for line in text.split("\n"):
            w = [x.lower() for x in re.split(r"[\x20\x09-\x0D]+", line) if x]
            if not w or not any(repeats(w, b) for b in before):
                kept.append(line)
            if w:
                before.append(w)
        out[i] = "\n".join(kept)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_is_brute_force(spark, seed):
    rng = random.Random(seed)
    base = random_lines(25, seed)
    lines = []
    for _ in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            at = rng.randrange(len(w) + 1)
            kind = rng.randrange(3)
            if kind == 0:
                w.insert(at, "new")
            elif at < len(w):
                w[at : at + 1] = ["other"] if kind == 1 else []
        lines.append("  ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    rows = [(i, "\n".join(lines[i * 5 : i * 5 + 5])) for i in range(18)] + [(100, ""), (101, None), (102, " \n\n \t"), (None, lines[0] + "\nquite new")]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    want = dedup_by_hand(rows)
    assert {i: r["text"] for i, r in got.items()} == {**want, 101: None}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values() if r["text"] is not None)
    assert got[101]["n_lines"] == 0 and got[102]["n_lines"] == 3 and got[102]["kept_lines"] == 3 and got[100]["text"] == ""


def test_line_dedup_of_templates_repeats_and_empty_table(spark):
    rows = [(i, f"this is the number {i} of a very long series") for i in range(50)] + [(7, "same text"), (7, "same text"), (8, "word " * 30_000)]
    got = line_dedup.dedup_lines(documents(spark, rows)).collect()
    assert sum(r["text"] == "" for r in got) == 50 and [r["text"] for r in got if r["doc_id"] == 7][-2:].count("same text") >= 1
    assert sum(r["text"] == "same text" for r in got) == 1 and sum(r["doc_id"] == 7 for r in got) == 3
    rows = [(None, "one\ntwo", "x"), (None, "one\ntwo", "y"), (None, "two\nthree", "z"), (5, "three", "a"), (5, "four\n\nthree", "b"), (5, "three", "a")]
    got = sorted(map(tuple, line_dedup.dedup_lines(documents(spark, rows)).select("doc_id", "text", "lang", "kept_lines").collect()), key=str)
    kept = [r[1] for r in got]
    assert len(got) == 6 and sum(x.split("\n").count(w) for x in kept for w in ("one", "two", "three", "four")) == 4 and kept.count("") >= 2
    assert sorted(g for _, _, g, _ in got) == ["a", "a", "b", "x", "y", "z"]


def test_line_dedup_by_shuffled_joins(spark):
    """The plan of tables too large to broadcast gives the same rows."""
    rng = random.Random(8)
    lines = [" ".join(x) for x in random_lines(30, 8)]
    rows = [(i, "\n".join(rng.choice(lines) + rng.choice(["", "", " end"]) for _ in range(6))) for i in range(40)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == dedup_by_hand(rows)
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


def fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))


def test_simhash_is_brute_force(spark):
    rng = random.Random(3)
    words = [f"t{i}é" for i in range(300)]
    rows = []
    for g in range(25):
        text = [rng.choice(words) for _ in range(rng.choice([2, 4, 60, 200]))]
        for k in range(rng.choice([1, 3, 12])):
            own = list(text)
            for _ in range(k % 3):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows) * 3, " ".join(own).title() if k % 2 else "\t".join(own)))
    rows += [(5, None), (2, ""), (10_000, " \n"), (None, rows[0][1]), (None, "alone in the world it stands"), (3, rows[0][1]), (3, rows[0][1])]
    prints = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                parent[root(i)] = root(j)
    want = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        want.append((d, f"{prints[i]:016x}", min(ids, default=None)))
    out = simhash.near_duplicates(documents(spark, rows)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    kept = simhash.one_of_each(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns
    assert {r["doc_id"] for r in kept.collect()} == {c for d, _, c in want if d is not None} | {None}


def test_simhash_keys_are_not_broadcast(spark, monkeypatch):
    """The keys that fingerprints share are many for each, and Spark thinks that there is one."""
    plans = {}

    def spied(df, name, real=simhash.written):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(simhash, "written", spied)
    fps = simhash.written(spark.range(100).select((F.col("id") * 2).alias("fp")), "fps")
    assert simhash._buckets(fps, 4).count() > 1000
    assert "SortMergeJoin" in plans["shared_buckets"] and "Broadcast" not in plans["shared_buckets"]


def test_simhash_links_a_large_group_of_near_fingerprints(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(63)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(5))) for _ in range(1500)} | {rng.getrandbits(63) for _ in range(500)}
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    comp = {r["node"]: r["component"] for r in components(edges).collect()}
    near = [f for f in fps if bin(f ^ centre).count("1") <= 4]
    assert len({comp.get(f, f) for f in near if bin(f ^ centre).count("1") <= 2}) == 1
    # brute force over the whole set
    fps = sorted(fps)
    label = {f: f for f in fps}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    assert {f: comp.get(f, f) for f in fps} == {f: root(f) for f in fps}


def test_components_of_chains_loops_and_none(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 100), (201, 200), (200, 201), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_mixing_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)) or None, None, s) for i, s in enumerate(["a"] * 60 + ["b"] * 40 + ["c"] * 5 + [None] * 30)]
    rows += [(0, "dup dup dup", None, "a"), (0, "dup dup dup", None, "a"), (None, "no id", None, "b")]
    docs = documents(spark, rows)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    total = sum(r["mix_size"] for r in out)
    by = {}
    for r in out:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["mix_taken"] <= 3 * r["mix_size"]
    assert abs(sum(x[0]["mix_target"] for x in by.values()) - total) < 1e-6
    for own in by.values():
        assert sum(r["mix_size"] for r in own) == own[0]["mix_source_size"]
        assert 0 <= own[0]["mix_target"] - sum(r["mix_taken"] for r in own) < 1
        assert own[0]["mix_target"] <= 3 * own[0]["mix_source_size"] + 1e-9
    free = [x[0]["mix_target"] / w for s, w in (("a", 5), ("b", 2), ("c", 1), (None, 5)) for x in [by[s]] if x[0]["mix_target"] < 3 * x[0]["mix_source_size"] - 1e-6]
    assert max(free) - min(free) < 1e-6
    texts = mixing.mixed_documents(docs)
    assert texts.columns == docs.columns
    words = {r["source"]: r["n"] for r in texts.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert words == {s: sum(r["mix_taken"] for r in own) for s, own in by.items()}
    assert mixing.mix(documents(spark, [])).count() == 0 and mixing.mixed_documents(documents(spark, [])).count() == 0


ENGLISH, FRENCH = "the house and the garden with that thing".split(), "la maison et le jardin avec cette chose été".split()


def test_language_id(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(ENGLISH if i % 2 else FRENCH) for _ in range(30)), "en" if i % 2 else "fr", "s") for i in range(120)]
    rows += [(500, None, "en", "s"), (501, "", None, None), (502, "123 !? 45", None, None), (503, "The house, THE GARDEN!", None, None), (504, "la " * 5000, None, None), (507, "la" * 5000, None, None), (None, "le jardin", "fr", None), (506, "дом 中文", None, None)]
    docs = documents(spark, rows)
    model = langid.learned(docs)
    assert model.languages == ["en", "fr"]
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "fr") for i in range(120))
    assert [got[i]["lang_pred"] for i in (500, 501, 502, 503, 504, None)] == ["und", "und", "und", "en", "fr", "fr"]
    assert {got[i]["lang_pred"] for i in (506, 507)} <= {"en", "fr"} and all(0 <= r["score"] <= 1 for r in got.values())
    kept = langid.of_known_language(docs, model)
    assert kept.columns == docs.columns and {500, 501, 502}.isdisjoint({r["doc_id"] for r in kept.collect()}) and kept.count() >= 123
    none = documents(spark, [(1, "abc", None, None)])
    assert langid.learned(none) is None and langid.identify(none, None).first()["lang_pred"] == "und"
    assert langid.identify(documents(spark, []), model).count() == 0


def test_short_texts_that_languages_share_have_one(spark):
    own = {"de": "das haus", "en": "the house", "es": "la casa", "fr": "le jardin"}
    rows = [(i, f"{own[g]} radio taxi", g, "s") for i in range(30) for g in own]
    docs = documents(spark, rows)
    model = langid.learned(docs)
    short = documents(spark, [(1, "radio"), (2, "taxi radio"), (3, "7 8"), (4, None)])
    scores = {r["doc_id"]: r["score"] for r in langid.identify(short, model).collect()}
    assert scores[1] < 0.5
    assert {r["doc_id"] for r in langid.of_known_language(short, model).collect()} == {1, 2}
    assert {r["doc_id"] for r in langid.of_known_language(short, None).collect()} == {1, 2}


def test_forward_sums_all_segmentations():
    graph = langid.lattice(langid.default_vocabulary())
    import numpy as np

    table = np.random.default_rng(0).random((len(graph.pieces) + 1, 1)) / 100
    prob = {p: table[i, 0] for i, p in enumerate(graph.pieces)}

    def total(word):
        if not word:
            return 1.0
        first = table[graph.unknown, 0] * total(word[1:]) if word[0] not in prob else 0.0
        return first + sum(prob[word[:k]] * total(word[k:]) for k in range(1, len(word) + 1) if word[:k] in prob)

    words = ["▁the", "▁jardin", "▁x", "▁дом"]
    alpha, logs = graph.forward(words, table), graph.forward(words, np.log(table), logs=True)
    for i, w in enumerate(words):
        assert alpha[len(w), i, 0] == pytest.approx(total(w), rel=1e-9)
        assert logs[len(w), i, 0] == pytest.approx(np.log(total(w)), rel=1e-9)
    uses = graph.expected(words, np.ones(len(words)), table[:, 0])
    assert uses.sum() > len(words) and uses[: len(graph.pieces)].min() >= 0


def test_runs_of_letters_are_summed_whole():
    """No cut: a long run's sum is that of its segmentations, also where its probability is too small for a double."""
    from fractions import Fraction

    import numpy as np

    graph = langid.lattice(langid.default_vocabulary())
    table = np.random.default_rng(1).random((len(graph.pieces) + 1, 2)) / 1000
    at = {p: i for i, p in enumerate(graph.pieces)}
    words = [langid.START + "jardin" * 40, langid.START + "abc", langid.START + "the" * 15, langid.START + "ж" * 900]
    got = graph.log_totals(words, table)
    for k, word in enumerate(words[:3]):
        for lang in range(2):
            sums = [Fraction(1)] + [Fraction(0)] * len(word)
            for end in range(1, len(word) + 1):
                for n in range(1, min(end, 20) + 1):
                    piece = word[end - n : end]
                    p = at.get(piece, graph.unknown if n == 1 else None)
                    if p is not None:
                        sums[end] += sums[end - n] * Fraction(table[p, lang])
            whole = sums[-1]
            assert got[k, lang] == pytest.approx(float(np.log(float(whole.numerator >> max(0, whole.numerator.bit_length() - 900)))) + (max(0, whole.numerator.bit_length() - 900) - whole.denominator.bit_length() + 1) * np.log(2) - np.log(whole.denominator / (1 << (whole.denominator.bit_length() - 1))), rel=1e-6)
    assert np.isfinite(got).all()
    long = [words[0], words[1]]
    uses = graph.expected(long, np.array([2.0, 3.0]), table[:, 0])
    plain = graph.expected([words[1]], np.array([3.0]), table[:, 0])
    letters = sum(n * len(p) for n, p in zip(uses, graph.pieces)) + uses[graph.unknown]
    assert letters == pytest.approx(2 * len(words[0]) + 3 * len(words[1]), rel=1e-9) and (uses >= plain - 1e-12).all()


def test_places_of_pieces_are_found_for_many_words_at_once():
    """All places, by brute force, and far fewer calls than places."""
    import sys

    rng, graph = random.Random(9), langid.lattice(langid.default_vocabulary())
    known = {p: i for i, p in enumerate(graph.pieces)}
    words = [langid.START + "".join(rng.choices("etaoinsrhäжж中", k=rng.randint(1, 14))) for _ in range(2000)]
    words += [langid.START, "a", langid.START + "😀é", langid.START + "la" * 300, words[0]]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        arcs = graph.arcs(words)
    finally:
        sys.setprofile(None)
    want = []
    for i, word in enumerate(words):
        for end in range(1, len(word) + 1):
            want += [(i, end, n, known[word[end - n : end]]) for n in range(1, min(end, 20) + 1) if word[end - n : end] in known]
            want += [(i, end, 1, graph.unknown)] * (word[end - 1] not in known)
    got = list(zip(*(x.tolist() for x in arcs)))
    assert sorted(got) == sorted(want) and [x[1::-1] for x in got] == sorted(x[1::-1] for x in got)
    assert calls < len(got) / 10


def test_numerals_are_no_letters(spark):
    docs = documents(spark, [(i, "the house ends", "en", "s") for i in range(20)] + [(100, "²½ 12"), (101, "① ②"), (102, "Ⅷ"), (103, "x²")])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, langid.learned(docs)).collect()}
    assert [got[i] for i in (100, 101, 102)] == [("und", 0.0)] * 3 and got[103][0] == "en"


@pytest.mark.parametrize("rare", [1e-12, 1e-30, 1e-300])
def test_rare_pieces_do_not_vanish(rare):
    """Runs of letters whose products underflow: totals, expected counts and scores stay finite and right."""
    import numpy as np
    import pandas as pd

    graph = langid.lattice(langid.default_vocabulary())
    table = np.full((len(graph.pieces) + 1, 2), rare)
    known = {p: i for i, p in enumerate(graph.pieces)}
    table[known[langid.START + "the"], 0] = 0.5
    words = [langid.START + "ж" * 40, langid.START + "the", langid.START + "the" + "ж" * 37, langid.START + "ж" * 3]
    totals = graph.log_totals(words, table)
    assert np.isfinite(totals).all() and totals[1, 0] == pytest.approx(np.log(0.5), rel=1e-3)
    whole = [graph.forward([w], np.log(table), logs=True)[len(w), 0] for w in words]  # [word][language]
    assert np.allclose(totals, whole, rtol=1e-9)
    counts = np.array([1.0, 3.0, 2.0, 5.0])
    found = graph.expected(words, counts, table[:, 0])
    assert np.isfinite(found).all() and found[known[langid.START + "the"]] == pytest.approx(5.0, rel=1e-3)
    letters = sum(c * (len(w) - 1 if "the" not in w else len(w) - 4) for c, w in zip(counts, words))
    assert found[known.get("ж", graph.unknown)] == pytest.approx(letters, rel=0.3)
    model = langid.Model(["a", "b"], table, langid.default_vocabulary())
    scored = next(model.score([pd.DataFrame({"text": [w[1:] for w in words] + ["the " + "ж" * 40 + " the"]})]))
    assert scored["score"].between(0, 1).all() and scored["lang_pred"].tolist()[1] == "a"


def test_quality(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(ENGLISH) for _ in range(40)) + "."
    bad = lambda: " ".join(rng.choice(ENGLISH).upper() + "!!" for _ in range(40))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)] + [(900, None), (901, ""), (902, "x" * 100_000), (None, "the house")]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([Row(doc_id=i, quality=int(i % 3 > 0), toxic=0) for i in range(300)] + [Row(doc_id=None, quality=1, toxic=0), Row(doc_id=4, quality=None, toxic=0)], "doc_id long, quality int, toxic int")
    machine = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality.rate(docs, machine).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert got[0]["held_out"] == (zlib.crc32(b"0") % 4 == 2)
    unseen = [r for i, r in got.items() if i is not None and i < 300 and r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in unseen) >= 0.95 * len(unseen)
    assert quality.rate(documents(spark, []), machine).count() == 0
    nothing = quality.fit(docs, labels.limit(0))
    assert {round(r["score"], 6) for r in quality.rate(docs, nothing).collect()} == {0.5}


def test_pairwise_identity():
    import numpy as np

    rng = np.random.default_rng(1)
    width = len(quality.STATISTICS) + quality.BINS
    m = quality.Machine(np.zeros(len(quality.STATISTICS)), np.ones(len(quality.STATISTICS)), 0.3, rng.normal(size=width), rng.normal(size=(width, 3)))
    x = rng.normal(size=(4, width)) * (rng.random((4, width)) < 0.05)
    slow = [0.3 + r @ m.w + sum(m.v[i] @ m.v[j] * r[i] * r[j] for i in range(width) for j in range(i) if r[i] and r[j]) for r in x]
    assert np.allclose(m.logits(x), slow)
