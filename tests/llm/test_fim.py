"""Fill-in-middle against slicing of Python strings, and its automaton against a decoder."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import fim

TEXTS = [
    None, "", "a", "<P>", "x<S>", "<M>y", "<P", "S>", "<<P>", "<<S", "< P>", "<p>", "é", "日本語", "😀a😀", "á", "\r\n", "\x00b", "<é>", "P><S", "é<M>é",
]


def expected(doc_id, text, seed="1", marks=("<P>", "<S>", "<M>"), rate=90, first=20):
    p, s, m = marks
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(x in text for x in marks) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < first:
        return n, "spm", a, b - a, s + text[b:] + p + text[:a] + m + text[a:b]
    return n, "psm", a, b - a, p + text[:a] + s + text[b:] + m + text[a:b]


def rows():
    rng = random.Random(3)
    alphabet = ["a", "é", "日", "😀", "<", ">", "P", "S", " ", "\n"]
    out = [(i, t) for i, t in enumerate(TEXTS)]
    out += [(100 + i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(3000)))) for i in range(150)]
    out += [(300 + i, rng.choice("aé日😀") * (fim.BLOCK + d)) for i, d in enumerate(range(-3, 4))]
    out += [(400, "日本😀x" * 700_000), (7, "twice"), (7, "twice"), (7, "twice, but other"), (None, "no id"), (None, None)]
    return out


def got(spark, data, **more):
    docs = spark.createDataFrame([(i, t, len(t or ""), "mine", 1) for i, t in data], "doc_id long, text string, n_chars long, fim_form string, row int")
    out = fim.transformed(docs, **more)
    assert out.columns == ["doc_id", "text", "n_chars", "row", "fim_units", "fim_form", "fim_prefix", "fim_middle"]
    marks = more.get("sentinels", fim.SENTINELS)
    return out.withColumn("back", fim.restored(F.col("text"), F.col("fim_form"), marks)).collect()


@pytest.mark.parametrize("more", [{}, {"cut_rate": 100, "suffix_first": 50, "seed": "other"}, {"sentinels": ("<|fim_prefix|>", "<|fim_suffix|>", "<|é|>")}])
def test_texts_are_cut_as_strings_are(spark, more):
    data = rows()
    want = sorted(
        (repr(i), *map(repr, expected(i, t, more.get("seed", "1"), more.get("sentinels", fim.SENTINELS), more.get("cut_rate", 90), more.get("suffix_first", 20))))
        for i, t in data
    )
    found = got(spark, data, **more)
    assert sorted((repr(r.doc_id), *map(repr, (r.fim_units, r.fim_form, r.fim_prefix, r.fim_middle, r.text))) for r in found) == want
    assert sorted((repr(r.doc_id), r.back) for r in found) == sorted((repr(i), t or "") for i, t in data)
    assert all(r.n_chars == len(r.text) for r in found)
    assert {r.fim_form for r in found} == {"plain", "psm", "spm"}


def test_empty_table_and_overlapping_sentinels(spark):
    assert got(spark, []) == []
    for marks in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("<P>", "P", "x"), ("<<", "<S>", "x"), ("ab", "bc", "x")):
        with pytest.raises(ValueError):
            fim.checked(marks)


def test_the_automaton_counts_units_of_any_bytes():
    rng, machine = random.Random(8), fim.Automaton()
    parts = [b"a", b"<", b"<P>", "é".encode(), "日".encode(), "😀".encode(), b"\xff", b"\x80", b"\xe2\x82", b"\xf0\x9f\x98", b"\xc0\xaf", b"\xed\xa0\x80", b"\xf4\x90\x80\x80"]
    for size in (0, 1, 5, 300, 5000):
        data = b"".join(rng.choice(parts) for _ in range(size))
        # One unit for each well-formed sequence; a byte of any other kind is a unit, but for those that a broken sequence has already taken.
        units = at = 0
        starts = []
        while at < len(data):
            starts.append(at)
            state, _ = fim._follows(fim.NONE, data[at])
            at += 1
            while at < len(data) and state[0] and state[1] <= data[at] <= state[2]:
                state, at = fim._follows(state, data[at])[0], at + 1
            units += 1
        ends = np.array([0, len(data)])
        held, hits, cuts, places = machine.scan(np.frombuffer(data, np.uint8), ends, np.array([units // 3]), np.array([units // 2]), np.array([True]))
        assert held[0] == units and hits[0] == data.count(b"<P>")
        if not hits[0]:
            assert [int(places[k, 0]) for k in range(2)] == [(starts + [len(data)])[int(cuts[k, 0])] for k in range(2)]
    assert len("".join(chr(c) for c in range(0x10FFFF) if not 0xD800 <= c < 0xE000)) == int(
        machine.scan(*(lambda d: (d, np.array([0, len(d)])))(np.frombuffer("".join(chr(c) for c in range(0x10FFFF) if not 0xD800 <= c < 0xE000).encode(), np.uint8)), np.array([0]), np.array([0]), np.array([False]))[0][0]
    )


def test_query_schema(spark, tmp_path):
    spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = fim.op11_fill_in_middle(spark, str(tmp_path))
    assert dict(out.dtypes) == {
        "doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string",
    }
    want = {i: expected(i, t) for i, t in ((1, "some text"), (2, None))}
    for r in out.collect():
        n, form, a, m, text = want[r.doc_id]
        assert tuple(r)[1:5] == (n, form, a, m) and r.output_sha256 == hashlib.sha256(text.encode()).hexdigest()
