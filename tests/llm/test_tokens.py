from __future__ import annotations

import collections

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from patchloom.llm import encode, kernels, packing

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

TEXTS = [None, "", " ", "\n\n", "a", "'s", " 's", "it's we'll they'VE 're're ''s \"'s x'tis", "  two  spaces \n \t tabs\r\n", "1234 ½ Ⅷ x²", "naïve 量子 회로 مرحبا 👩‍👩‍👧 ​ 　 z",
         "def f(x):\n    return x['a'] != 'b'\n\n\n", "x" * 5000, " " * 3000 + "y", "  \x85\x1c\x00", "don't'll'd", "<|endoftext|>", "'", "a'", "a 'b"]


@pytest.fixture(scope="module")
def tokenizer():
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_are_the_tokenizers(spark, tokenizer):
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, key string")
    coded = encode.encode(df, "doc_id", offsets=True)
    back = {r.doc_id: r.text for r in encode.decode(coded, "doc_id").collect()}
    for r in coded.collect():
        text = (TEXTS * 2)[r.doc_id] or ""
        assert r.ids == tokenizer.encode(text, add_special_tokens=False).ids
        assert back[r.doc_id] == text
        assert sum(r.sizes) == len(r.ids) and len(r.words) == len(r.sizes) and sorted(set(r.words)) == r.words
        at = 0
        for w, n, end in zip(r.words, r.sizes, [*r.words, len(text)][1:], strict=True):
            assert tokenizer.encode(text[w:end], add_special_tokens=False).ids == r.ids[at : at + n]
            at += n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("'srtvelmd  \n\tA1é")), max_size=40), max_size=5))
def test_any_text(texts):
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json")) if not hasattr(test_any_text, "t") else test_any_text.t
    test_any_text.t = t
    t.encode_special_tokens = True
    import pyarrow as pa

    codes, starts = kernels.codepoints(pa.array(texts, pa.string()))
    ids, bound, *_ = encode.Encoder(encode.default_path())(codes, starts)
    assert [ids[a:b].tolist() for a, b in zip(bound, bound[1:], strict=False)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_a_word_of_a_megabyte_takes_seconds(tokenizer):
    import base64
    import random
    import time

    rng, rank = random.Random(3), encode.ranks(encode.default_path())
    raw = base64.b64encode(rng.randbytes(750_000))
    began = time.perf_counter()
    ids = encode.merged(raw, rank)
    assert time.perf_counter() - began < 30 and len(raw) == 1_000_000
    back = {i: b for b, i in rank.items()}
    assert b"".join(back[i] for i in ids) == raw
    word = "".join(c for c in raw[:9000].decode() if c.isalpha())
    assert encode.merged(word.encode(), rank) == tokenizer.encode(word, add_special_tokens=False).ids


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert encode.encode(none, "doc_id").count() == 0
    assert packing.pack(spark.createDataFrame([], "doc_id long, tokens int"), "doc_id", "tokens").count() == 0


def test_packing_is_whole_and_tight(spark):
    sizes = [(i, [None, 0, 7, 2048, 2049, 5000, 1024, 1500, 548, 33][i % 10] if i % 3 else 1 + i * 37 % 2048) for i in range(2000)]
    df = spark.createDataFrame([*sizes, (5, 100), (5, 100)], "doc_id long, tokens int")
    rows = packing.pack(df, "doc_id", "tokens").collect()
    used, parts = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        used[r.container] += r.size
        parts[r.doc_id].append(r.size)
    assert max(used.values()) <= 2048 and set(used) == set(range(len(used)))
    want = collections.Counter()
    for i, n in [*sizes, (5, 100), (5, 100)]:
        want[i] += n or 0
    assert {i: sum(p) for i, p in parts.items()} == {i: n for i, n in want.items() if n}
    assert all(len(p) == -(-want[i] // 2048) for i, p in parts.items() if i != 5)
    u = packing.usage(packing.pack(df, "doc_id", "tokens")).first()
    assert u.containers == len(used) <= u.least_containers * 1.01 + 1


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=12))
def test_plan_places_each_item_once(counts):
    placed = collections.Counter()
    first = 0
    for at, times, filling in packing.plan(counts, 50):
        assert at == first and times > 0 and sum(s * n for s, n in filling.items()) <= 50
        first += times
        for s, n in filling.items():
            placed[s] += n * times
    assert placed == collections.Counter(counts)


def test_fullest_is_best():
    import itertools

    counts = {7: 2, 11: 1, 13: 3}
    for room in range(1, 60):
        best = max(s for n in itertools.product(range(3), range(2), range(4)) if (s := 7 * n[0] + 11 * n[1] + 13 * n[2]) <= room)
        assert sum(s * n for s, n in packing._fullest(counts, room).items()) == best
