"""Operators on awkward rows, against brute force written out here."""

import hashlib
import shutil
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brute import (
    PLAIN, SPACED, base_spans, brute_groups, brute_hits, brute_lines, brute_removal, rows,
)
from stipendia.llm import (
    components, decontamination, files, line_dedup, minhash, mixing, neighbours, pii, quality_rules, rans,
    substring_dedup, token_output, tokens, warc,
)
from stipendia.llm.queries import END, TOKENIZER

def same(found, wanted):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, wanted), key=key)


PERSONAL = [
    "a@b.c_d@e.f 1.2.3.4.5.6.7.8", "😀 x@y.zz +1 (523) 555-1055 999.1.1.1 4111 1111 1111 1111", "",
    None, "1" * 5000, "@" * 3000, "a" * 50_000, "a." * 20_000, "1.1.1", "+1+2 345678901  +1234567890123456",
    "4111-1111-1111-1112 ssn 123-45-6789 token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"",
    "256.1.1.1 0255.0.0.1", "x@y.z-@w.v a@b@c.de", " 4111111111111111-", "+1 2 3-4.5(6)7 8 9 ",
    "1 " * 30_000, "4111 1111 1111 1111 " * 50,
]


def test_personal_data(spark):
    docs = spark.createDataFrame([*enumerate(PERSONAL), (0, PERSONAL[0])], "doc_id long, text string")
    found = pii.listed(docs).collect()
    assert len(found) == len(PERSONAL) + 1
    for r in found:
        base = base_spans(PERSONAL[r.doc_id])
        assert r.base_spans == ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == b[0] for b in base) for k in PLAIN]
        assert set(filter(None, r.base_spans.split(","))) <= set(r.spans.split(","))
    masked = {r.doc_id: r.text for r in pii.masked(docs).collect()}
    assert "[email]" in masked[1] and "x@y.zz" not in masked[1]


def test_personal_data_of_awkward_rows(awkward, empty):
    assert pii.listed(awkward).count() == len(rows())
    assert pii.listed(empty).count() == 0


def test_expectation_maximisation_finds_the_reliable_labeler(spark):
    # Form and edges agree with the truth in 95 %, the other two say nothing useful.
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.4
    vote = lambda p: np.where((rng.random(4000) < p) == truth, 1, -1).tolist()
    found = spark.createDataFrame(
        list(zip(["card"] * 4000, vote(.95), vote(.5), vote(.5), vote(.95), truth.tolist())),
        "kind string, form int, known int, context int, edges int, truth boolean")
    beliefs = pii.reliabilities(found)
    both = found.join(beliefs, ["kind", *pii.VOTES])
    agree = both.where((F.col("belief") > 0.5) == F.col("truth")).count()
    assert agree > 0.92 * 4000
    again = {tuple(r[1:5]): r.belief for r in beliefs.collect()}
    assert again[(1, 1, 1, 1)] > 0.9 and again[(-1, -1, -1, -1)] < 0.1


def test_decontamination(spark, awkward, empty):
    items = [(1, "d1x0 D1X1 d1x2, d1x3 d1x4 d1x5 d1x6 d1x7 d1x8 d1x9 d1x10"), (2, "ONE"), (10, "one"),
             (3, None), (4, ""), (5, "w5 w6"), (6, "Shared1 shared2 shared3"), (None, "a b"), (7, "zz"),
             (1, "shared60 " + " ".join(f"shared{i}" for i in range(61, 70)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contamination(awkward, bench).select("doc_id", "n_words", "n_hit", "items")
    docs = [(r[0], r[1]) for r in rows()]
    same([(a, b, c, tuple(d)) for a, b, c, d in found.collect()],
         [(a, b, c, tuple(d)) for a, b, c, d in brute_hits(docs, items)])
    clean = decontamination.decontaminated(awkward, bench)
    assert clean.columns == awkward.columns
    assert clean.count() == sum(not h[2] for h in brute_hits(docs, items))
    assert decontamination.contamination(empty, bench).count() == 0
    assert decontamination.contamination(awkward, bench.where("false")).where("n_hit > 0").count() == 0


def test_decontamination_without_filter(spark, monkeypatch):
    """Shared passages of every length around the window's, found alike when the filter lets all pass."""
    rng = np.random.default_rng(3)
    vocabulary = [f"v{i}" for i in range(40)]
    texts = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 80)))) for i in range(30)]
    items = []
    for n in range(1, 26):
        words = texts[n][1].split()
        at = int(rng.integers(0, max(1, len(words) - n)))
        items.append((n, " ".join(["x y z", *words[at:at + n], "z y x"]) if n >= 10 else
                      " ".join(words[at:at + n])))
    wanted = [(a, b, c, tuple(d)) for a, b, c, d in brute_hits(texts, items)]
    assert sum(h[2] > 0 for h in wanted) > 10
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bits in (None, 64):
        if bits:
            monkeypatch.setattr(decontamination, "filter_bits", lambda number: bits)
        found = decontamination.contamination(docs, bench).select("doc_id", "n_words", "n_hit", "items")
        same([(a, b, c, tuple(d)) for a, b, c, d in found.collect()], wanted)


def test_token_files(spark, awkward, empty):
    stored = token_output.write(awkward, TOKENIZER, END)
    docs = sorted(((r[0], r[1]) for r in rows()), key=lambda r: (r[0] is not None, r[0] or 0))
    tool, start, wanted = tokens.tokenizer(TOKENIZER), 0, []
    for doc, text in docs:
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, END]
        wanted.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), tuple(ids)))
        start += len(ids)
    # Rows of equal id and text are alike, so their order does not show.
    same([tuple(r) for r in token_output.read(spark, stored, summary=True).collect()],
         [w[:4] for w in wanted])
    same([(*r[:3], tuple(r[3])) for r in token_output.read(spark, stored).collect()],
         [(*w[:3], w[4]) for w in wanted])
    none = token_output.write(empty, TOKENIZER, END)
    assert token_output.read(spark, none).count() == 0


def test_token_files_of_rows_without_ids_in_many_splits(spark):
    """Ranges that are read as several splits, which all begin with the same id."""
    texts = [f"text number {i} " + "word " * (i % 40) for i in range(6_000)]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    hadoop, sizes = spark.sparkContext._jsc.hadoopConfiguration(), {"spark.sql.files.maxPartitionBytes": "60000",
                                                                    "spark.sql.files.openCostInBytes": "1000"}
    hadoop.set("parquet.block.size", "20000")
    try:
        for key, value in sizes.items():
            spark.conf.set(key, value)
        stored = token_output.write(docs, TOKENIZER, END)
        parts = stored.index.groupBy(F.shiftright("row", 33).alias("part")).agg(F.countDistinct("file").alias("n"))
        assert parts.agg(F.max("n")).first()[0] > 1
        found = sorted(token_output.read(spark, stored).collect(), key=lambda r: r.start)
    finally:
        hadoop.unset("parquet.block.size")
        for key in sizes:
            spark.conf.unset(key)
    ends = np.cumsum([r.n_tokens for r in found])
    assert [r.start for r in found] == [0, *ends[:-1].tolist()]
    tool = tokens.tokenizer(TOKENIZER)
    wanted = [(*tool.encode(t, add_special_tokens=False).ids, END) for t in texts]
    assert sorted(tuple(r.ids) for r in found) == sorted(wanted)


def test_a_token_file_of_an_attempt_that_was_not_committed_is_not_read(spark, awkward):
    stored = token_output.write(awkward, TOKENIZER, END)
    again = token_output.block_writer(stored.folder, rans.Tables.unpacked(files.read_range(
        f"{stored.folder}/tables", 0, files.file_size(f"{stored.folder}/tables"))), "<u2")
    part = pa.RecordBatch.from_pydict({"_id": [1, 2], "ids": [b"\x01\x00", b"\x01\x00"], "row": [0, 1]})
    before = [tuple(r) for r in token_output.read(spark, stored, summary=True).collect()]
    names = {row["file"] for batch in again(iter([part])) for row in batch.to_pylist()}
    assert not names & {r.file for r in stored.index.collect()}
    same([tuple(r) for r in token_output.read(spark, stored, summary=True).collect()], before)


PAGES = [(5, "http://a.b/x?y=1", "p" * 120), (2, None, "p" * 120), (9, "u", "p" * 120), (9, "u", "p" * 120),
         (1, "http://www.é.com/ a\nb", "short"), (3, "u", "short"), (4, "u", None), (6, "u", ""),
         (None, "u", "n" * 200), (7, "u", "n" * 200), (8, "u", "é" * 60), (10, "u", "\r\n\r\n" * 40),
         (11, "u", "q" * 300_000), (12, "u", "q" * 300_000)]


def test_an_archive_of_an_attempt_that_was_not_committed_is_not_read(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    archives = warc.write(pages, str(tmp_path / "w"))
    before = sorted(map(str, warc.read(spark, str(tmp_path / "w")).collect()))
    assert len(before) == len(PAGES)
    one = archives.first().path
    shutil.copy(one, one.replace(".wacz", "-again.wacz"))
    assert sorted(map(str, warc.read(spark, str(tmp_path / "w")).collect())) == before


@pytest.mark.parametrize("most", [50_000, 2])
def test_archives(spark, monkeypatch, tmp_path, most):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", most)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("n", F.lit(1))
    archives = warc.write(pages, str(tmp_path / "w"))
    found = warc.summary(warc.records(warc.index(archives)))
    wanted = []
    for page, _, html in PAGES:
        body = (html or "").encode()
        first = min([p for p, _, h in PAGES if h == html and p is not None])
        revisit = len(body) >= 100 and page != first
        wanted.append((page, len(body), hashlib.sha256(body).hexdigest(),
                       "revisit" if revisit else "response", first if revisit else None))
    same([tuple(r) for r in found.collect()], wanted)
    listed = warc.read(spark, str(tmp_path / "w"))
    bodies = {r.page_id: r.payload for r in listed.where("type = 'response'").collect()}
    assert bytes(bodies[8]) == ("é" * 60).encode() and bytes(bodies[4]) == b""
    assert warc.write(pages.where("false")).count() == 0


def test_quality_rules(awkward, empty):
    found = {r.doc_id: r for r in quality_rules.judged(quality_rules.measured(awkward)).collect()}
    for doc, text, *_ in rows():
        words, r = SPACED.findall(text or ""), found[doc]
        grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        inside = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)} \
            if len(grams) < 2000 else set(range(len(words)))
        lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text or "")
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == len(inside)
        assert r.base_failed == (len(words) < 50 or 100 * len(inside) > 50 * len(words))
        assert not (r.kept and r.base_failed)
    kept = quality_rules.filtered(awkward)
    assert kept.columns == awkward.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, r in found.items() if r.kept}
    assert found[1].kept and not found[8].kept and not found[15].kept
    assert quality_rules.filtered(empty).count() == 0


def test_classifier_scores_equal_a_plain_loop(spark, awkward, empty):
    labels = spark.createDataFrame(
        [(i, int(i not in (15, 17, 6))) for i in range(1, 18)] + [(None, 1), (99, 0), (2, None)],
        "doc_id long, quality int")
    model = neighbours.fitted(awkward, labels)
    found = neighbours.scored(awkward, model).collect()
    assert len(found) == len(rows())
    from stipendia.llm import words as W
    import pyarrow as pa
    texts = W.text_of(pa.array([t or "" for _, t, *_ in rows()]))
    latent = model.latent(texts)
    plain = []
    for (doc, *_), v in zip(rows(), latent):
        near = sorted(((float(v @ u), y, w) for u, y, w in zip(model.vectors, model.labels, model.weights)),
                      reverse=True)[:neighbours.NEIGHBOURS]
        votes = [(max(s, 0) ** neighbours.SHARPNESS * w, y) for s, y, w in near]
        total = sum(a for a, _ in votes)
        prior = float(model.weights @ model.labels / model.weights.sum())
        plain.append((doc, sum(a * y for a, y in votes) / total if total else prior))
    key = lambda r: (r[0] is None, r[0] or 0)
    for a, b in zip(sorted(((r.doc_id, r.score) for r in found), key=key), sorted(plain, key=key)):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-4
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.predicted == int(r.score >= 0.5)
    assert neighbours.scored(empty, model).count() == 0
    nothing = neighbours.fitted(awkward, labels.where("false"))
    assert {r.score for r in neighbours.scored(awkward, nothing).collect()} == {0.5}
    neighbours.fitted(empty, labels)


def test_classifier_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = neighbours.scored(docs, neighbours.fitted(docs, labels)).join(labels, "doc_id").where("held_out")
    right = found.where("predicted = quality").count()
    assert right > 0.93 * found.count()


def test_substring_removal_of_awkward_rows(awkward, empty):
    docs = [(r[0] if r[0] is not None else -1, r[1]) for r in rows() if r[0] != 8]
    found = substring_dedup.digests(awkward.where("doc_id is null or doc_id <> 8"))
    wanted = [(None if i == -1 else i, *rest) for i, *rest in brute_removal(docs, 50)]
    same([tuple(r) for r in found.collect()], wanted)
    kept = substring_dedup.deduplicated(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(rows())
    text = {r.doc_id: r.text for r in kept.collect()}
    assert text[3] == "" and text[11] == "a b c" and text[1] == rows()[0][1]
    assert substring_dedup.digests(empty).count() == 0


def test_substring_removal_with_small_shards_and_crowds(spark, monkeypatch):
    # Passages in many surroundings: shards are cut, and dealt to several tasks.
    monkeypatch.setattr(substring_dedup, "TASK_WORDS", 300)
    rng = np.random.default_rng(3)
    shared = [[f"p{k}_{i}" for i in range(90)] for k in range(4)]
    docs = []
    for n in range(60):
        own = [f"o{n}_{i}" for i in range(30)]
        picks = [shared[k] for k in rng.choice(4, rng.integers(0, 3), replace=False)]
        docs.append((int(n), " ".join(sum(picks, own[:10]) + own[10:])))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    found = substring_dedup.digests(frame, shard=20)
    same([tuple(r) for r in found.collect()], brute_removal(docs, 50))


def test_near_duplicates_of_awkward_rows(awkward, empty, width=5):
    docs = [(r[0] if r[0] is not None else -1, r[1]) for r in rows()]
    wanted = brute_groups(docs, width)
    found = minhash.groups(awkward, width=width).collect()
    assert len(found) == len(rows())
    for r in found:
        n, group = wanted[-1 if r.doc_id is None else r.doc_id]
        assert (r.n_shingles, r.kept) == (n, group == (-1 if r.doc_id is None else r.doc_id))
        assert (-1 if r.component == -2**63 else r.component) == group
    kept = minhash.deduplicated(awkward, width=width)
    assert kept.columns == awkward.columns
    assert minhash.groups(empty).count() == 0


def test_near_duplicates_without_ids_and_with_repeated_ids(spark):
    # Each text has a near copy (one word of 80 differs) and all rows have a null id or the id 7.
    plain = [" ".join(f"d{n}x{i}" for i in range(80)) for n in range(4)]
    near = [f"{t[:t.rindex(' ')]} other" for t in plain]
    docs = [(i, t, s) for i in (None, 7) for t in plain + near + plain[:1] for s in ("a", "b")]
    docs += [(9, near[2], "a"), (10, near[3], "b"), (11, "alone", "a"),
             (None, "", "a"), (None, "", "b"), (None, None, "c")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    found = minhash.groups(frame).collect()
    assert len(found) == len(docs)
    assert {r.doc_id: r.kept for r in found if r.doc_id} == {7: False, 9: False, 10: False, 11: True}
    assert {r.component for r in found if r.doc_id in (7, 9, 10)} == {-2**63}
    kept = minhash.deduplicated(frame)
    assert kept.columns == frame.columns
    kept = [tuple(r) for r in kept.collect()]
    assert sorted(k[2] for k in kept if not k[1]) == ["a", "b", "c"]
    worded = [k for k in kept if k[1] and k[0] is None]
    assert sorted(k[1].split(" ")[0] for k in worded) == ["d0x0", "d1x0", "d2x0", "d3x0"]
    assert [k for k in kept if k[0]] == [(11, "alone", "a")]


def test_centers_of_equal_weight_do_not_depend_on_the_order_of_rows(spark):
    rows = [(v, node, 5) for v in range(3) for node in range(4)]
    for some in (rows, rows[::-1]):
        lists = spark.createDataFrame(some, "value long, node long, weight long").coalesce(1)
        assert {(r.center, r.node) for r in minhash.centered(lists).collect()} == {(3, n) for n in range(4)}


def test_centers_and_partners_are_written_before_they_are_used_twice(spark, monkeypatch):
    names, plain = [], minhash.written
    monkeypatch.setattr(minhash, "written", lambda df, name: names.append(name) or plain(df, name))
    text = " ".join(f"x{i}" for i in range(80))
    frame = spark.createDataFrame([(1, text), (2, f"{text} y")], "doc_id long, text string")
    assert {r.component for r in minhash.groups(frame).collect()} == {1}
    assert {"around", "partners"} <= set(names)


def test_near_duplicates_of_chains_and_crowds(spark, monkeypatch):
    # Small blocks, so that groups are dealt to several.
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rng = np.random.default_rng(11)
    docs, n = [], 0
    for family in range(5):
        words = [f"f{family}_{i}" for i in range(60)]
        for _ in range(60 if family == 0 else 12):
            docs.append((n, " ".join(words)))
            n += 1
            words = list(words)
            for p in rng.choice(60, rng.integers(0, 5), replace=False):
                words[p] = f"n{n}_{p}"
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component) for r in minhash.groups(frame, width=2).collect()}
    assert found == brute_groups(docs, 2)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (5, 5)], "a long, b long")
    found = {r.node: r.component for r in components.components(links).collect()}
    assert found == {**{i: 0 for i in range(301)}, 900: 900, 901: 900}
    assert components.components(links.where("false")).count() == 0


def test_mixing_meets_its_targets(spark, awkward, empty, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    monkeypatch.setattr(mixing, "CHAIN", 10)
    cells = docs.groupBy("source", "lang").agg(F.sum(mixing.words(F.col("text"))).alias("tokens"))
    targets = {m: mixing.tempered(cells, m) for m in ("source", "lang")}
    raked = mixing.raked(cells, targets)
    for margin, target in targets.items():
        held = {r[0]: r[1] for r in raked.groupBy(margin).agg(F.sum("weight")).collect()}
        for value, share in target.collect():
            assert abs(held[value] - share) < 1e-6
    found = mixing.mixed(docs, sweeps=4)
    total, expected, kept = found.agg(
        F.sum("_tokens"), F.sum(F.col("_tokens") * F.col("_probability")),
        F.sum(F.when(F.col("_kept"), F.col("_tokens")))).first()
    assert abs(expected / total - mixing.KEEP) < 1e-6
    assert abs(kept / total - mixing.KEEP) < 0.05
    few = mixing.mixed(awkward, sweeps=4)
    assert few.count() == len(rows())
    assert mixing.sampled(awkward, sweeps=4).columns == awkward.columns
    assert mixing.mixed(empty).count() == 0


def test_mixing_without_a_share_meets_its_targets_and_lists_what_is_reached(spark):
    one = spark.createDataFrame([(i, "a b c", "en", "s") for i in range(20)],
                                "doc_id long, text string, lang string, source string")
    assert mixing.sampled(one, keep=None, sweeps=4).count() == 20
    rare = [(i, "a b c", "en", "big") for i in range(99)] + [(99, "a b c", "en", "rare")]
    docs = spark.createDataFrame(rare, one.schema)
    for keep, meets in ((None, True), (0.5, False)):
        found = {(r.margin, r.value): r for r in
                 mixing.shares(mixing.mixed(docs, keep=keep, sweeps=4)).collect()}
        for r in found.values():
            assert (abs(r.target - r.reached) < 1e-6) == (meets or r.margin != "source")
    assert 0.09 < found[("source", "rare")].target < 0.1
    assert abs(found[("source", "rare")].reached - 0.02) < 1e-6


def test_targets_without_documents_and_documents_without_targets(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("a", "y", 30), ("b", "x", 5), (None, "x", 7), ("c", "x", 0)],
                                  "s string, l string, tokens long")
    wanted = spark.createDataFrame([("a", 0.5), (None, 0.2), ("z", 0.3)], "value string, share double")
    found = {(r.s, r.l): r.weight for r in mixing.raked(cells, {"s": wanted}).collect()}
    assert found[("b", "x")] == 0 and abs(found[(None, "x")] - 0.2) < 1e-9
    chance = {(r.s, r.l): r.probability for r in mixing.probabilities(
        mixing.raked(cells, {"s": wanted}), ["s", "l"], 0.5).collect()}
    assert chance[("b", "x")] == 0 and chance[("c", "x")] == 1
    assert abs(10 * chance[("a", "x")] + 30 * chance[("a", "y")] + 7 * chance[(None, "x")] - 23.5) < 1e-6


def test_lines(awkward, empty):
    docs = [(r[0] if r[0] is not None else -1, r[1]) for r in rows()]
    found = line_dedup.deduplicated(awkward, counted=True).select(
        F.coalesce("doc_id", F.lit(-1)), "text", "n_lines", "n_removed")
    same([tuple(r) for r in found.collect()], brute_lines(docs))
    assert line_dedup.deduplicated(awkward).columns == awkward.columns
    assert line_dedup.deduplicated(empty).count() == 0


def test_lines_of_one_id_with_different_texts(spark):
    docs = [(1, "a\nb\nc"), (1, "a\nb\nc\nd"), (1, "a\nb\nc"), (2, "x\na\nb\nc"), (None, "q\nr\ns\nq\nr\ns"),
            (2, "q\nr\ns\nt"), (2, "b\nc\nd")]
    found = line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string"), counted=True)
    same([(r.doc_id or -1, *r[1:]) for r in found.collect()], brute_lines([(i or -1, t) for i, t in docs]))


def test_a_long_copied_document_loses_its_lines_in_seconds(spark):
    lines = [f"line {i}" for i in range(200_000)]
    docs = [(1, "\n".join(lines)), (2, "\n".join(["begin", *lines, "end"]))]
    began = time.monotonic()
    found = {r.doc_id: r for r in line_dedup.deduplicated(
        spark.createDataFrame(docs, "doc_id long, text string"), counted=True).collect()}
    assert time.monotonic() - began < 40
    assert (found[1].text, found[1].n_removed) == (docs[0][1], 0)
    assert (found[2].text, found[2].n_lines, found[2].n_removed) == ("begin\nend", 200_002, 200_000)
