"""Encoding by runs and by tree concatenation against the library on whole texts."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgrid.llm import bpe_tree, edit_counts, packing
from quillgrid.llm.wordbpe import count, default_path, encode_bytes, library

PATH = default_path()


def whole(text):
    return library(PATH).encode(text, add_special_tokens=False).ids


PARTS = st.sampled_from(["th", "er", "on", "ing", "a", "aa", "'s", "'re", "don't", "!!'s", "...", " ", "\n", "\t", " ", "é", "é", "ß", "İ", "日本", "한", "<|endoftext|>", "<|endof", "12", "A", "Über,", "the.", "\x1c"])


@settings(max_examples=60, deadline=None)
@given(st.lists(PARTS, max_size=200).map("".join), st.sampled_from([40, 64, 150]))
def test_all_ways_give_the_library_ids(text, piece):
    ids = whole(text)
    assert np.frombuffer(encode_bytes(text, PATH), "<u4").tolist() == ids
    assert count(text, PATH) == len(ids)
    assert bpe_tree.encode_long(text, PATH, piece).tolist() == ids


@pytest.mark.parametrize("text", ["a" * 3001, "thering" * 500, "ab" * 777 + "c", "é" * 900])
def test_long_unsplit_text(text):
    assert bpe_tree.encode_long(text, PATH, 64).tolist() == whole(text)


def test_places_survive_packing():
    made = bpe_tree.encode_piece("The  naïve\n\n<|endoftext|> café 日本語", 7, PATH)
    back = bpe_tree.unpacked(made.ids, bpe_tree.packed(made, 7), 7)
    assert all((getattr(made, n) == getattr(back, n)).all() for n in ("ids", "starts", "ends", "opens"))


def test_encode_and_decode_tables(spark):
    texts = [None, "", " ", "one", "word " * 3000, "x" * 5000, "same", "same", "The End. " * 700 + "y" * 900]
    docs = spark.createDataFrame([(k % 7, t, "extra") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = bpe_tree.decode(bpe_tree.encode(docs, piece_chars=1000)).collect()
    want = sorted((k % 7, whole(t or ""), library(PATH).decode(whole(t or ""), skip_special_tokens=False)) for k, t in enumerate(texts))
    assert sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.text) for r in got) == want
    assert bpe_tree.encode(docs.limit(0)).count() == 0


def edits():
    return st.lists(st.builds(lambda a, r, i: {"at": a, "remove": r, "insert": i}, st.integers(0, 120), st.integers(0, 60), st.lists(PARTS, max_size=4).map("".join)), max_size=5)


@settings(max_examples=60, deadline=None)
@given(st.lists(PARTS, max_size=60).map("".join), edits(), st.sampled_from([1, 8, 40]))
def test_edit_counts_equal_a_full_count(text, todo, size):
    tree = edit_counts.CountTree(text, PATH, size)
    assert tree.tokens() == len(whole(text))
    for e in todo:
        tree.edit(e["at"], e["remove"], e["insert"])
    now = edit_counts.apply(text, todo)
    assert tree.text() == now and tree.tokens() == len(whole(now))


def test_edit_counts_table(spark):
    texts = [None, "", "a", "some words here. " * 400, "b" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in edit_counts.edit_counts(docs, edit_counts.sample_edits()).collect()}
    for k, t in enumerate(texts):
        assert got[k].n_tokens == len(whole(t or "")) and got[k].edited_tokens == len(whole(got[k].edited_text))
    assert got[3].chars_reencoded < 0.2 * got[3].chars_built


def test_differencing_and_windows():
    rng = np.random.default_rng(3)
    for sizes in ([], [5], [4, 4, 4], rng.integers(1, 500, 400).tolist()):
        where, sums = packing.windows(sizes, 512) if sizes else (np.zeros(0), np.zeros(1))
        assert sums.max(initial=0) <= 512 and sums.sum() == sum(sizes)
    where, sums = packing.difference([8, 7, 6, 5, 4], 2)
    assert sorted(sums.tolist()) == [14, 16]


def test_packing_table(spark):
    texts = [None, "", "hi", "long words " * 4000, "some more of it " * 300] + [f"text number {k} " * (k % 40) for k in range(200)] + ["hi"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = packing.pack(docs, window=256, item=64, group=16, slack=4).toPandas()
    import zlib

    for k, t in enumerate(texts):
        ids = np.asarray([*whole(t or ""), 2], "<u4")
        mine = rows[rows.doc_id == k].sort_values("start")
        at = 0
        for r in mine.itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    padding = 0
    for _, group in rows.sort_values("offset").groupby("sequence_id"):
        assert group.offset.tolist() == [0, *np.cumsum(group.length)[:-1]] and group.length.sum() <= 256
        total = int(group.length.sum())
        padding += 0 if total & total - 1 == 0 else 256 - total
    assert padding < 0.1 * rows.length.sum()
    assert packing.pack(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(PARTS, max_size=60).map("".join), edits(), st.sampled_from([(1, 1), (8, 20), (30, 60)]))
def test_edits_of_segments_that_keep_their_ids(text, todo, sizes):
    tree = edit_counts.CountTree(text, PATH, *sizes)
    assert tree.tokens() == len(whole(text))
    for e in todo:
        tree.edit(e["at"], e["remove"], e["insert"])
    now = edit_counts.apply(text, todo)
    assert tree.text() == now and tree.tokens() == len(whole(now))


def test_an_edit_of_text_without_a_blank_encodes_a_window():
    rng = np.random.default_rng(5)
    text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz.,1é"), 60_000))
    tree = edit_counts.CountTree(text, PATH)
    built = tree.encoded
    todo = [{"at": 20_000, "remove": 1, "insert": "q"}, {"at": 40_000, "remove": 700, "insert": ""}, {"at": 10, "remove": 0, "insert": "two words"}, {"at": 30_000, "remove": 0, "insert": "b" * 50}]
    for e in todo:
        tree.edit(e["at"], e["remove"], e["insert"])
    now = edit_counts.apply(text, todo)
    assert tree.text() == now and tree.tokens() == len(whole(now))
    assert tree.encoded - built < 0.05 * built
