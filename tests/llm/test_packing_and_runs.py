"""Packing, fill-in-the-middle and periodic runs, against brute force written out here."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import SPACED, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stipendia.llm import fill_middle, packing, periodic_runs, queries, tokens
from stipendia.llm import words as W
from stipendia.llm.best_fit import OpenBins
from stipendia.llm.queries import TOKENIZER
from stipendia.llm.runs import runs

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = ["a<P>b", " x  y ", "<", "<<S> a<", "a b < c <", " \n" * 3000, "é" * 5000 + " b", "\x1c a\x85b ", "<P", "x"]


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


# Packing.

@given(st.lists(st.integers(1, 20), max_size=120), st.integers(1, 6))
def test_a_piece_goes_to_the_fullest_open_bin_with_room(lengths, most):
    bins, left, made = OpenBins(20, most), {}, 0
    for length in lengths:
        number, offset = bins.place(length)
        fitting = [b for b in left if left[b] >= length]
        if length == 20 or not fitting:
            assert number == made and offset == 0
            made += 1
            if length < 20:
                if len(left) == most:
                    least = min(left.values())
                    gone = [b for b in left if left[b] == least]
                    left.pop(gone[-1] if len(gone) == 1 else bins_closed(bins, gone))
                left[number] = 20 - length
        else:
            assert left[number] == min(left[b] for b in fitting) and offset == 20 - left[number]
            left[number] -= length
            if not left[number]:
                del left[number]
        assert bins.open == len(left) <= most


def bins_closed(bins, candidates):
    """Of equally full bins, the one that is no longer open."""
    still = {b for held in bins.held for b in held}
    return next(b for b in candidates if b not in still)


def check_pieces(found, docs, end, size):
    tool = tokens.tokenizer(TOKENIZER)
    by_sequence, by_doc = {}, {}
    for r in found:
        assert 1 <= r.length <= size and len(r.ids) == 4 * r.length
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    wanted = {}
    for doc, text in docs:
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, end]
        pieces = [ids[i:i + size] for i in range(0, len(ids), size)]
        wanted.setdefault(doc, []).extend(
            (i, i * size, len(p), np.array(p, "<u4").tobytes()) for i, p in enumerate(pieces))
    got = {doc: sorted((r.piece, r.start, r.length, bytes(r.ids)) for r in rows_) for doc, rows_ in by_doc.items()}
    assert got == {doc: sorted(p) for doc, p in wanted.items()}
    return len(by_sequence), sum(r.length for r in found)


def test_packing(awkward, empty):
    docs = [(r[0], r[1]) for r in rows()]
    pieces = packing.packed(awkward, TOKENIZER, 0, size=64, ahead=3)
    found = pieces.collect()
    check_pieces(found, docs, 0, 64)
    assert packing.packed(empty, TOKENIZER, 0).count() == 0
    for r, s in zip(sorted(found, key=lambda r: r.doc_id or -1), packing.summary(pieces).sort("doc_id").collect()):
        assert s.ids_crc32 is not None and "ids" not in s
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(pieces).collect()}
    for r in pieces.collect():
        assert whole[r.sequence_id][4 * r.offset:4 * (r.offset + r.length)] == bytes(r.ids)


def test_packed_documents_fill_their_sequences(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = packing.packed(docs, TOKENIZER, 0).collect()
    sequences, total = check_pieces(found, [tuple(r) for r in docs.select("doc_id", "text").collect()], 0, 2048)
    assert sequences <= 1.02 * total / 2048 + 2
    got = {(r.doc_id, r.piece): r.ids_crc32 for r in queries.op11_packing(spark, folder).collect()}
    assert got == {(r.doc_id, r.piece): zlib.crc32(bytes(r.ids)) for r in found}


def test_forgotten_runs_are_encoded_again(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 40)
    monkeypatch.setattr(tokens, "_known", {})
    rng = random.Random(4)
    tool = tokens.tokenizer(TOKENIZER)
    for _ in range(30):
        text = " ".join(rng.choice(["the", "of"]) + str(rng.randrange(99)) + rng.choice("abcdeé日") * 3 for _ in range(25))
        ids, _ = tokens.encode(W.text_of(pa.array([text])), TOKENIZER)
        assert ids.tolist() == tool.encode(text, add_special_tokens=False).ids
    store = tokens._known[TOKENIZER]
    assert len(store.hashes) <= 40 + 100 and (np.diff(store.hashes.astype(object)) > 0).all()


# Fill in the middle.

def brute_middle(doc, text):
    text = text or ""
    units = UNIT.findall(text)
    n, digest = len(units), hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return text, n, "plain", None, None
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return f"<S>{s}<P>{p}<M>{m}", n, "spm", len(p), len(m)
    return f"<P>{p}<S>{s}<M>{m}", n, "psm", len(p), len(m)


def test_fill_middle(spark, awkward, empty):
    docs = [(r[0], r[1]) for r in rows()] + [(100 + i, t) for i, t in enumerate(ODD * 20)]
    plain = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("mine"))
    found = fill_middle.transformed(plain)
    assert found.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars"]
    got = found.withColumn("back", fill_middle.restored(F.col("text"), F.col("form"))).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r[:6]) for r in got), key=key) == sorted(
        ((d, *brute_middle(d, t)) for d, t in docs), key=key)
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    by_id = {d: t or "" for d, t in docs}
    assert all(r.back == by_id[r.doc_id] for r in got)
    assert fill_middle.transformed(empty).count() == 0
    assert fill_middle.transformed(awkward).columns[:5] == ["doc_id", "text", "lang", "source", "_id"]


@settings(deadline=None)
@given(st.lists(st.text("ab \n\té日😀", max_size=900), min_size=1, max_size=6), st.data())
def test_any_cut_of_any_text(texts, data):
    units = fill_middle.Units(W.text_of(pa.array(texts)))
    for i, text in enumerate(texts):
        split = UNIT.findall(text)
        assert units.counts[i] == len(split)
        k = data.draw(st.integers(0, len(split)))
        size, chars = units.cut(np.array([i]), np.array([k]))
        head = "".join(split[:k])
        assert (int(size[0]), int(chars[0])) == (len(head.encode()), len(head))


# Periodic runs.

def brute_runs(words, least, exponent):
    out, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if length >= max(least, exponent * q) and all(
                    any(words[start + k] != words[start + k + p] for k in range(length - p))
                    for p in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(deadline=None, max_examples=300)
@given(st.integers(1, 4), st.lists(st.integers(0, 3), max_size=70), st.integers(0, 40), st.integers(1, 20))
def test_runs_of_any_sequence(letters, sequence, first, period):
    words = [x % letters for x in sequence]
    for tried in (words, [w if i < first else words[first + (i - first) % period]
                          for i, w in enumerate(words)] if first < len(words) else words):
        for least, exponent in ((2, 2), (8, 3), (24, 3)):
            assert runs(tried, least, exponent) == brute_runs(tried, least, exponent)


def test_runs_of_a_fibonacci_word():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert runs(b, 2, 2) == brute_runs(b, 2, 2)


def brute_collapse(words, least=24, exponent=3):
    found = brute_runs(words, least, exponent)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return found, " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_docs():
    rng = random.Random(11)
    line = " ".join(f"k{i}" for i in range(30))
    docs = [(200 + i, t) for i, t in enumerate([
        "the " * 23, "the " * 24, "a b " * 12, "a b c d e f g h " * 3, "a b c d e f g h i " * 3,
        "a b c d e f g h i " * 2 + "a b c d e f g h", f"{line} x {line} y {line}", f"{line} {line} {line} z",
        "u v w " * 9 + "x " * 30 + "u v w " * 9, "é 日 " * 20])]
    for i in range(150):
        part = [rng.choice("pqrs") for _ in range(rng.randrange(1, 40))]
        docs.append((300 + i, " ".join((part * rng.randrange(1, 7) + [rng.choice("pqrs")] * rng.randrange(30))
                                       * rng.randrange(1, 4))))
    return docs


def test_collapsed_runs(spark, awkward, empty):
    docs = [(r[0], r[1]) for r in rows() if r[0] != 8] + periodic_docs()
    plain = spark.createDataFrame(docs, "doc_id long, text string").withColumn("runs", F.lit(7))
    got = periodic_runs.collapsed(plain).collect()
    wanted = []
    for doc, text in docs:
        words = SPACED.findall(text or "")
        found, left = brute_collapse(words)
        wanted.append((doc, left, len(words), found))
    key = lambda r: ((r[0] is not None, r[0]), r[1:])
    assert sorted(((r.doc_id, r.text, r.n_words, [tuple(x) for x in r.runs]) for r in got), key=key) == sorted(
        wanted, key=key)
    assert periodic_runs.collapsed(empty).count() == 0
    long, = [r for r in periodic_runs.collapsed(awkward).collect() if r.doc_id == 8]
    assert [tuple(x) for x in long.runs] == [(0, 60_000, 700)]
    assert long.text == " ".join(f"w{i}" for i in range(700))


def test_periodic_runs_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, folder).collect()}
    assert len(got) == len(docs)
    checked = 0
    for doc, text in docs:
        words = SPACED.findall(text or "")
        h, n = zlib.crc32(str(doc).encode()), len(words)
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        elif n > 1500:
            continue
        if n > 4000:
            continue
        found, left = brute_collapse(words)
        listed = "".join(f"{s},{k},{q}\n" for s, k, q in found)
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        r = got[doc]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert (r.runs_sha256, r.collapsed_sha256) == (sha(listed), sha(left))
        checked += 1
    assert checked > 150 and any(r.n_runs for r in got.values())
    assert list(r.asDict()) == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                                "runs_sha256", "collapsed_sha256"]


@pytest.mark.parametrize("least,exponent", [(24, 3), (5, 2), (9, 4)])
def test_overlap_is_what_every_run_has(least, exponent):
    size = periodic_runs.overlap(least, exponent)
    assert all(max(least, exponent * q) - q >= size for q in range(1, 200))
