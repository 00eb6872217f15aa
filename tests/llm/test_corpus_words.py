import random
import re
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stipendia.llm import rans, tokens, zipdir
from stipendia.llm import words as W
from stipendia.llm.automaton import SuffixAutomaton
from stipendia.llm.queries import TOKENIZER

TEXTS = st.lists(st.text(alphabet="ab é\n\t😀.7'<", max_size=30), max_size=6)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_split_and_hashes(texts):
    found = W.split(W.text_of(pa.array(texts, pa.string())), W.NON_SPACE)
    plain = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    assert found.counts().tolist() == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    assert [found.joined(i, 1).decode() for i in range(len(found))] == flat
    for a, x in zip(flat, found.hashes):
        for b, y in zip(flat, found.hashes):
            assert (a == b) == (x == y)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_grams(texts, n):
    words = W.split(W.text_of(pa.array(texts, pa.string())), W.NON_SPACE)
    plain = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    wanted = [tuple(p[i:i + n]) for p in plain for i in range(len(p) - n + 1)]
    _, keys = words.grams(n)
    assert len(keys) == len(wanted)
    assert len(set(keys.tolist())) == len(set(wanted))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), max_size=4), st.integers(1, 4), st.integers(1, 5))
def test_winnowing_covers_every_span(texts, gram, window):
    joined = pa.array([" ".join(map(str, t)) for t in texts], pa.string())
    words = W.split(W.text_of(joined), W.NON_SPACE)
    kept = set(W.winnowed(words, gram, window)[0].tolist())
    span = gram + window - 1
    for i in range(len(words) - span + 1):
        if words.text[i] == words.text[i + span - 1]:
            assert kept & set(range(i, i + window))


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.randoms())
def test_compact(texts, rng):
    words = W.split(W.text_of(pa.array(texts, pa.string())), W.NON_SPACE)
    kept = np.array([rng.random() < 0.5 for _ in range(len(words))], bool)
    plain = [[] for _ in texts]
    for i in np.flatnonzero(kept):
        plain[words.text[i]].append(words.joined(int(i), 1))
    assert W.pieces(W.compact(words, kept)) == [b" ".join(p) for p in plain]


def test_slices_respect_rows_and_limits():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab" * 50, None, "", "c" * 500, "d"])], names=["text"])
    parts = list(W.slices(iter([batch.slice(1)]), limit=100))
    assert sum(len(t) for _, t in parts) == 4
    assert [p for _, t in parts for p in W.pieces(t)] == [b"", b"", b"c" * 500, b"d"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=25), max_size=4), st.lists(st.integers(0, 3), max_size=40))
def test_automaton(references, text):
    machine = SuffixAutomaton()
    for r in references:
        machine.add(r)
    inside = {tuple(r[i:j]) for r in references for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
    best = [max([n for n in range(1, e + 1) if tuple(text[e - n:e]) in inside], default=0)
            for e in range(1, len(text) + 1)]
    assert list(machine.statistics(text)) == best
    for least in (1, 3):
        covered = {p for e, n in enumerate(best) if n >= least for p in range(e + 1 - n, e + 1)}
        assert {p for a, b in machine.spans(text, least) for p in range(a, b)} == covered


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 300_000])
def test_rans(n):
    rng = np.random.default_rng(n)
    symbols = np.minimum(rng.geometric(0.01, n), 5000).astype(np.int64)
    table = rans.tables(np.bincount(np.append(symbols, 7), minlength=5001))
    data = rans.encode(symbols, table)
    again = rans.Tables.unpacked(table.packed())
    assert (rans.decode(data, again) == symbols).all()
    block = rans.parse(data)
    step = rans.CHECKPOINT_STEPS * rans.LANES
    for i in reversed(range(len(block.states))):
        assert (rans.decode_piece(block, i, again) == symbols[i * step:(i + 1) * step]).all()
    if n:
        damaged = bytearray(data)
        damaged[len(data) // 2] ^= 1
        with pytest.raises(ValueError):
            rans.decode(bytes(damaged), again)


def test_rans_size_is_near_the_entropy():
    symbols = np.random.default_rng(1).choice(4, 500_000, p=[0.7, 0.2, 0.05, 0.05])
    p = np.bincount(symbols) / len(symbols)
    ideal = -(p * np.log2(p)).sum() * len(symbols) / 8
    states = 5 * rans.LANES * 8
    assert len(rans.encode(symbols, rans.tables(np.bincount(symbols)))) < ideal * 1.01 + states


ODD = ["don't  x<|endoftext|>y é́ 日本語 12a b İ ﬁ ½ x²", "", "  ", "A" * 3000, "'s 's", "a\x0bb\x0cc",
       "É×÷ß", "\U0001F600 hi", "naïve Ünï &&& !!a1b2", "  x y", "a\x00b", "Straße's 1.5kg"]


def test_token_ids_equal_those_of_whole_texts():
    random.seed(3)
    texts = ODD + ["".join(random.choices("aZé1.' <|\n日", k=60)) for _ in range(200)]
    ids, counts = tokens.encode(W.text_of(pa.array(texts)), TOKENIZER)
    ends = np.concatenate([[0], np.cumsum(counts)])
    for i, text in enumerate(texts):
        whole = tokens.tokenizer(TOKENIZER).encode(text, add_special_tokens=False).ids
        assert ids[ends[i]:ends[i + 1]].tolist() == whole, text


@pytest.mark.parametrize("text", [
    "hello \x0c world price end.\x0c last", "a \x0b b\x0cc d", "one \x0c two \x00abc three", "\x0c", "\x7f 12\x0c \x0c z"])
def test_token_ids_beside_control_characters(monkeypatch, text):
    monkeypatch.setattr(tokens, "_known", {})
    whole = tokens.tokenizer(TOKENIZER).encode
    for t in (text, *text.split(" ")):
        ids, counts = tokens.encode(W.text_of(pa.array([t])), TOKENIZER)
        assert ids.tolist() == whole(t, add_special_tokens=False).ids and counts.tolist() == [len(ids)]


def test_runs_that_are_not_one_word_each_are_not_cut_from_a_joined_text():
    tool = tokens.tokenizer(TOKENIZER)
    assert tokens.joined([b"hello", b"&&", b"7", "straße".encode()], tool) is not None
    # Numbers of words that cancel, no word at all, and bounds that differ with equal numbers.
    for runs in ([b"a", b"\x0c", b"b", b"end.", b"c"], [b"\x0c"], [b"a b", b"\x0c"], [b"a", b"\x0c", b"b."]):
        assert tokens.joined(runs, tool) is None


def archive(path, wide):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"a comment with PK\x05\x06 inside"
        for name, data in (("one", b"x" * 300), ("two/é", b""), ("three", b"yz")):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=wide) as member:
                member.write(data)
        z.writestr("packed", b"q" * 1000, zipfile.ZIP_DEFLATED)


@pytest.mark.parametrize("wide", [False, True])
def test_zip_directory(tmp_path, monkeypatch, wide):
    if wide:
        for limit in ("ZIP64_LIMIT", "ZIP_FILECOUNT_LIMIT"):
            monkeypatch.setattr(zipfile, limit, 1)
    path = tmp_path / "a.zip"
    archive(path, wide)
    data = path.read_bytes()
    assert (zipdir.END64 in data) == wide

    def read(begin, size):
        return data[begin:begin + size]

    found = {m.name: m for m in zipdir.members(read, len(data))}
    assert list(found) == ["one", "two/é", "three", "packed"]
    assert not found["packed"].stored
    for name, wanted in (("one", b"x" * 300), ("two/é", b""), ("three", b"yz")):
        m = found[name]
        assert read(m.begin(read), m.size) == wanted
    with pytest.raises(zipdir.DamagedZip):
        zipdir.members(lambda b, n: data[b:b + n], 30)


def test_hash_runs_beyond_one_piece(monkeypatch):
    data = np.frombuffer(b"ab" * 3000, np.uint8)
    first = np.arange(0, 6000, 2)
    monkeypatch.setattr(W, "HASH_BYTES", 64)
    assert len(set(W.hash_runs(data, first, first + 2).tolist())) == 1
