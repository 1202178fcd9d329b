"""Encoding, packing and look-alike texts against brute force and round trips."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyframe.llm import lookalike, packing
from tallyframe.llm.tokenizer import DEFAULT_VOCABULARY, count_column, encode_column, vocabulary

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def oracle():
    import base64

    import public_tokenizers

    with open(DEFAULT_VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", "é", "9", "Ⅷ", "!", "日", "\xa0", "　", "<|endoftext|>", "\x1c", "​", "🐛", "abc", "The", "\r\n"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=20), st.lists(st.sampled_from(ODD), max_size=15).map("".join)), max_size=30))
def test_encoding_equals_the_library(texts):
    enc = _oracle()
    got = vocabulary(DEFAULT_VOCABULARY).encode(pa.array(texts, pa.string()))
    want = [enc.encode_ordinary(t or "") for t in texts]
    assert got.to_pylist() == want
    assert vocabulary(DEFAULT_VOCABULARY).encode(pa.array(texts, pa.string()), count_only=True).to_pylist() == [len(x) for x in want]


_kept = []


def _oracle():
    if not _kept:
        import base64

        import public_tokenizers

        with open(DEFAULT_VOCABULARY, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _kept.append(tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    return _kept[0]


def test_long_words_and_chunks(oracle, monkeypatch):
    from tallyframe.llm import tokenizer

    texts = ["a" * 5000, "é" * 700, "=-" * 900, "xyzzy" * 400, " " * 3000, "", None, "word " * 2000, "日本" * 300]
    want = [oracle.encode_ordinary(t or "") for t in texts]
    for size in (1 << 21, 1000, 1):
        monkeypatch.setattr(tokenizer, "CHUNK", size)
        assert vocabulary(DEFAULT_VOCABULARY).encode(pa.array(texts)).to_pylist() == want
    assert vocabulary(DEFAULT_VOCABULARY).encode(pa.array(texts).slice(3, 4)).to_pylist() == want[3:7]
    assert vocabulary(DEFAULT_VOCABULARY).encode(pa.array([], pa.string())).to_pylist() == []


def test_encode_column(spark, oracle, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").withColumn("ids", F.lit(1))
    got = {r["doc_id"]: r["ids"] for r in encode_column(df, "doc_id", "text").collect()}
    rows = df.collect()
    assert len(got) == len(rows) and all(got[r["doc_id"]] == oracle.encode_ordinary(r["text"] or "") for r in rows)
    assert all(oracle.decode(got[r["doc_id"]]) == (r["text"] or "") for r in rows)
    assert {r["doc_id"]: r["n_ids"] for r in count_column(df, "doc_id", "text").collect()} == {k: len(v) for k, v in got.items()}
    assert encode_column(df.limit(0), "doc_id", "text").count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 40), max_size=12), st.integers(20, 60))
def test_plan_holds_every_item(histogram, capacity):
    plan, bound = packing.plan_containers(histogram, capacity)
    packed: dict[int, int] = {}
    for contents, number in plan:
        assert number > 0 and sum(s * k for s, k in contents.items()) <= capacity
        for s, k in contents.items():
            packed[s] = packed.get(s, 0) + k * number
    assert packed == {s: n for s, n in histogram.items() if n and s <= capacity}
    assert sum(n for _, n in plan) >= bound - 1e-6


def test_plan_is_near_the_bound():
    rng = random.Random(6)
    histogram: dict[int, int] = {}
    for _ in range(20_000):
        s = min(1000, int(rng.lognormvariate(4.5, 1)) + 1)
        histogram[s] = histogram.get(s, 0) + 1
    plan, bound = packing.plan_containers(histogram, 1000)
    assert sum(n for _, n in plan) <= 1.002 * bound + 1


def test_triplets_near_the_known_optimum(monkeypatch):
    """Every container of the optimum holds three items and is full; best fit needs 17 % more."""
    rng = random.Random(1)
    histogram: dict[int, int] = {}
    for _ in range(60):
        a = rng.randint(380, 494)
        b = rng.randint(251, (1000 - a) // 2)
        for s in (a, b, 1000 - a - b):
            histogram[s] = histogram.get(s, 0) + 20
    rest, best_fit = [], packing.best_fit
    monkeypatch.setattr(packing, "best_fit", lambda left, *a: (rest.append(sum(s * n for s, n in left.items())), best_fit(left, *a))[1])
    plan, bound = packing.plan_containers(histogram, 1000)
    assert 1200 - 1e-9 <= bound <= 1200 + 1e-6 and sum(n for _, n in plan) <= 1.025 * 1200
    assert rest[0] <= 0.1 * 1_200_000


@pytest.mark.parametrize("kinds", [5, 700])
def test_solution_covers_every_demand(kinds):
    import numpy as np

    rng = random.Random(2)
    sizes = np.array(sorted(rng.sample(range(1, 1001), kinds)))
    demand = np.array([float(rng.randint(1, 9)) for _ in range(kinds)])
    rows, use, bound = packing.solve_configurations(sizes, demand, 1000)
    served = {int(s): 0.0 for s in sizes}
    for pattern, x in zip(rows, use):
        assert sum(s * k for s, k in pattern.items()) <= 1000
        for s, k in pattern.items():
            served[s] += k * x
    assert [served[int(s)] for s in sizes] == pytest.approx(demand.tolist())
    assert bound - 1e-6 <= use.sum()


def test_limits_are_kept_while_filling():
    import numpy as np

    count, _ = packing.knapsack_pattern(np.array([3, 4]), np.array([3.1, 4.0]), np.array([1, 9]), 12)
    assert count.tolist() == [1, 2]


def test_knapsack_against_brute_force():
    import itertools

    import numpy as np

    sizes, values = np.array([3, 4, 5]), np.array([4.0, 5.0, 7.0])
    _, worth = packing.knapsack_pattern(sizes, values, np.array([9, 9, 9]), 14)
    assert worth == max(a * 4 + b * 5 + c * 7 for a, b, c in itertools.product(range(5), repeat=3) if 3 * a + 4 * b + 5 * c <= 14)


@pytest.mark.parametrize("salt_rows", [10, 200_000])
def test_pack(spark, monkeypatch, salt_rows):
    monkeypatch.setattr(packing, "SALT_ROWS", salt_rows)
    rng = random.Random(7)
    sizes = [rng.randint(1, 50) for _ in range(300)] + [25] * 200 + [0, None, -3, 100, 101, 250, 1000]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "k long, n long").withColumn("size", F.lit(1)).withColumn("salt", F.lit(1)).withColumn("rank", F.lit(1))
    rows = packing.pack(df, "k", "n", 100).collect()
    room: dict[int, int] = {}
    by_key: dict[int, list] = {}
    for r in rows:
        room[r["container_id"]] = room.get(r["container_id"], 0) + r["size"]
        by_key.setdefault(r["k"], []).append((r["piece_no"], r["first_unit"], r["size"]))
    assert max(room.values()) <= 100 and len(by_key) == len(sizes)
    for i, s in enumerate(sizes):
        p, n = sorted(by_key[i]), max(s or 0, 0)
        assert sum(x[2] for x in p) == n and [x[1] for x in p] == [100 * j for j in range(len(p))] and len(p) == max(1, -(-n // 100))
    assert len(room) <= sum(max(s or 0, 0) for s in sizes) / 100 * 1.03 + 2
    assert packing.pack(df.limit(0), "k", "n", 100).count() == 0


SAME = ["Café x", "Café x", "Ｃａｆé x", "Caf​é\xa0x", "Саfе́ x", "Café x﻿", "C­afé ⁠x"]
OTHER = ["Cafe x", "café x", "Café  x", "Café x\n", "Café\tx", "Café x.", "Cafè x", "Café 1", "x²", "x2", "x₂", "½", "1/2", "①", "1", "α", "a", "ſ", "s", "ρ", "p", "a b", "a\u2003b"]


def test_fold(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*SAME, *OTHER, None, ""])], "id long, text string")
    got = {r["id"]: r["folded"] for r in lookalike.folded_texts(df, "id", "text").collect()}
    assert len({got[i] for i in range(len(SAME))}) == 1
    others = [got[len(SAME) + i] for i in range(len(OTHER))]
    assert len(set(others)) == len(OTHER) and got[0] not in others
    assert got[len(SAME) + len(OTHER)] is None and got[len(SAME) + len(OTHER) + 1] == ""
    again = spark.createDataFrame([(i, t) for i, t in got.items()], "id long, text string")
    assert {r["id"]: r["folded"] for r in lookalike.folded_texts(again, "id", "text").collect()} == got
    half = spark.createDataFrame([(1, "ｶﾞ"), (2, "ガ"), (3, "ガ"), (4, "ё"), (5, "ё"), (6, "ë")], "id long, text string")
    f = {r["id"]: r["folded"] for r in lookalike.folded_texts(half, "id", "text").collect()}
    assert f[1] == f[2] == f[3] and f[4] == f[5] == f[6]


ALIKE = [
    ("ﬁle", "file"), ("ﬄ", "ffl"), ("𝐀𝒷𝟗", "Ab9"), ("Ⅳ", "IV"), ("ⅷ", "viii"), ("x\u3164y", "xy"), ("x\uffa0y", "xy"), ("ӏist", "list"), ("Үes", "Yes"), ("օk", "ok"), ("ν2", "v2"), ("ᎪᏢᏞ", "APL"), ("ꓢꓰꓔ", "SET"), ("ⲞⲢ", "OP"),
    ("…", "..."), ("℃", "°C"), ("⑴", "(1)"), ("a\u2011b", "a-b"), ("\uffe3", "\u00af"), ("ﾡ", "ㄱ"), ("ｶﾞ", "ガ"), ("𝐀\u0301", "Á"), ("𝚨", "A"), ("㎏"[:0] + "Ĳ", "IJ"), ("͵Ϳ", "͵J"), ("⼀", "一"), ("‼", "!!"), ("Ǆ", "DŽ"), ("\u1fbb", "\u0386"),
]


def test_forms_that_look_alike():
    import duckdb

    con = duckdb.connect()
    fold = lambda t: con.execute(f"SELECT {lookalike.fold_sql('t')} FROM (SELECT ?::VARCHAR AS t)", [t]).fetchall()[0][0]
    for a, b in ALIKE:
        assert fold(a) == fold(b), (a, b)
        assert fold(fold(a)) == fold(a)
    for a, b in (lookalike.CYRILLIC, lookalike.GREEK, lookalike.ARMENIAN, lookalike.CHEROKEE, lookalike.COPTIC, lookalike.LISU):
        assert len(a) == len(b) == len(set(a)) and fold(a) == b and b.isascii()


def test_class_sizes(spark):
    texts = ["ab", "аb", "a\u200bb", "ab", "x", "x", None, "", "\u200b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("n", F.lit(1))
    assert [(r["n_texts"], r["n_rows"], r["n_pairs"]) for r in lookalike.class_sizes(df, "doc_id", "text").collect()] == [(3, 4, 5)]
    assert lookalike.class_sizes(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("hot", [5000, 2])
def test_pairs(spark, hot, monkeypatch):
    texts = [SAME[0]] * 5 + SAME[1:] + OTHER * 2 + [None, "", " ", "​", "\xa0", "​ ", "p​" * 20_000, "p" * 20_000, "q'q", "q­'q"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("n", F.lit(1))
    folded = {r["doc_id"]: r["folded"] for r in lookalike.folded_texts(df, "doc_id", "text").collect()}
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if texts[i] and texts[j] and folded[i].strip() and folded[i] == folded[j] and texts[i] != texts[j]}
    assert len(want) > 30
    got = [tuple(r) for r in lookalike.lookalike_pairs(df, "doc_id", "text", hot=hot, salts=4).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    monkeypatch.setattr("tallyframe.plans.scale.BROADCAST_ROWS", 0)
    assert sorted(tuple(r) for r in lookalike.lookalike_pairs(df, "doc_id", "text", hot=hot, salts=4).collect()) == sorted(want)
    assert lookalike.lookalike_pairs(df.limit(0), "doc_id", "text").count() == 0
