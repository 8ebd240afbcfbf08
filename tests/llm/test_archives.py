"""Decontamination, WARC archives, the registered queries and the pipeline."""

import gzip
import hashlib
import re
import zlib

import fixtures as fx
import numpy as np
import pytest
from compare import same_rows
from pyspark.sql import functions as F

import corpus_pipeline
from leafmark.llm import components, decontam, queries, warc


def alnum(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", fx.lower(text))


def brute_hits(rows, items):
    phrases = {}
    for item, text in items:
        w = alnum(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if item is not None and n else 0):
            phrases.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc_id, text, *_ in rows:
        w, hit, found = alnum(text), set(), set()
        for p, own in phrases.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    found |= own
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 24, 40])
def test_decontamination_against_brute_force(spark, monkeypatch, block_bytes):
    """Also with the benchmark read in several blocks."""
    monkeypatch.setattr(decontam, "BENCHMARK_BYTES", block_bytes)
    long_text = fx.rows()[0][1]
    items = [(1, " ".join(fx.plain(long_text)[20:45])), (2, "One, two; THREE!"), (10, None), (11, ""), (None, "same same"), (12, "same same"), (2, "line_one"), (13, "w1 w2 never there at all in any of these texts")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.decontaminate(fx.docs(spark, clash=True), benchmark)
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, found.select(*names).collect()), key=str) == brute_hits(fx.rows(), items)
    clean = {r.doc_id: r.clean_text for r in found.collect()}
    assert clean[8] == "" and clean[5] is None and clean[16] == "x" * 3000
    assert len(fx.plain(clean[1])) == 95


def test_decontamination_of_and_with_nothing(spark):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(fx.docs(spark), benchmark).where("contaminated").count() == 0
    assert decontam.decontaminate(fx.empty(spark), benchmark).count() == 0


def test_index_finds_what_a_scan_finds():
    rng = np.random.default_rng(3)
    text = rng.integers(0, 5, 700)
    index = decontam.FMIndex(text, 5)
    phrases = [np.array(p) for p in ([1], [2, 2], [1, 2, 3, 4], [4, 3, 4, 1, 1], list(text[50:60]) if 0 not in text[50:60] else [1, 1])]
    for p, lo, hi in zip(phrases, *index.search(phrases), strict=True):
        want = [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(lo, hi)).tolist()) == want


PAGES = [(1, "http://a/ b", "x" * 150), (2, None, "x" * 150), (0, "http://c", "x" * 150), (3, "http://d", "short"), (4, "http://d", "short"), (5, None, None), (6, "u", ""), (None, "u", "x" * 150), (7, "u", "é" * 60), (8, "u\r\nX: y", "é" * 60), (9, "u", "y" * 99), (9, "u", "y" * 99)]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("first", F.lit("x"))


@pytest.mark.parametrize("most", [500_000, 0])
def test_warc_round_trip(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST", most)
    monkeypatch.setattr(components, "SMALL", most)
    got = warc.round_trip(pages(spark)).collect()
    first = {}
    for i, _, html in PAGES:
        raw = (html or "").encode()
        if len(raw) >= 100 and i is not None:
            first[raw] = min(i, first.get(raw, i))
    want = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        refers = first.get(raw) if first.get(raw) != i else None
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    assert warc.round_trip(pages(spark).limit(0)).count() == 0


def test_exported_archives_are_members_that_the_sidecar_finds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1500)
    normal = warc.normalise(warc.write(warc.decide(pages(spark).coalesce(1))))
    files = warc.export(normal, f"file://{tmp_path}").collect()
    assert len(files) > 1 and sum(r.records for r in files) == len(PAGES) + len(files)
    for r in files:
        data, index = open(r.path, "rb").read(), open(r.path.removesuffix(".warc.gz") + ".idx").read().splitlines()
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == r.records == len(index)
        for line in index:
            offset, length, ident = line.split("\t")
            fields, _ = warc.parse(zlib.decompress(data[int(offset) : int(offset) + int(length)], 31))
            assert fields["warc-record-id"] == ident
    again = warc.read(warc.normalise(warc.load(spark, f"file://{tmp_path}/*.warc.gz")))
    assert again.count() == len(PAGES)


def test_records_are_cut_out_of_the_laid_archive_by_its_sidecar(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1500)
    archives = warc.write(warc.decide(pages(spark).coalesce(1)))
    laid = warc.lay_out(archives)
    rows = laid.collect()
    assert len(rows) > 1
    for r in rows:
        assert gzip.decompress(r.data).count(b"WARC/1.1\r\n") == len(r.sidecar)
        for e in r.sidecar:
            fields, _ = warc.parse(zlib.decompress(r.data[e.offset : e.offset + e.length], 31))
            assert (fields["warc-record-id"], fields["warc-type"]) == (e.record_id, e.record_type)
    want = sorted(map(str, warc.read(warc.normalise(archives)).collect()))
    assert sorted(map(str, warc.read_laid(laid).collect())) == want
    read = warc.read_laid
    for field, more in (("offset", 1), ("length", 1), ("length", -1)):
        wrong = lambda df: df.withColumn("sidecar", F.transform("sidecar", lambda e: e.withField(field, e[field] + F.when(e["number"] == 1, more).otherwise(0))))  # noqa: B023, E731
        monkeypatch.setattr(warc, "read_laid", lambda df: read(wrong(df)))  # noqa: B023
        with pytest.raises(Exception, match="doesn't fit at record 1"):
            warc.round_trip(pages(spark)).collect()


def test_archives_are_laid_out_in_pieces_that_are_read_alone(spark, monkeypatch):
    """Records larger and smaller than a piece, several pieces an archive; columns whose names clash; megabytes in one page."""
    monkeypatch.setattr(warc, "PIECE_BYTES", 2000)
    rng = np.random.default_rng(1)
    noise = lambda n: rng.integers(33, 126, n).astype(np.uint8).tobytes().decode()
    rows = [(i, f"http://h/{i}", noise(3_000_000 if i == 5 else 700 + 40 * i)) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    for name in ("archive", "part", "data", "sidecar", "base", "payload", "refers_to"):
        df = df.withColumn(name, F.lit("clash"))
    laid = warc.lay_out(warc.write(warc.decide(df.select("page_id", "url", "html")))).collect()
    pieces = sorted((r.part, r.base, len(r.data)) for r in laid)
    assert len(pieces) > 5 and all(a[1] + a[2] == b[1] for a, b in zip(pieces, pieces[1:], strict=False))
    got = {r.page_id: r.payload.decode() for r in warc.round_trip(df).collect()}
    assert got == {i: html for i, _, html in rows}


def test_records_in_pieces_cut_anywhere():
    records = [warc._record(i, None, b"x" * n, n, hashlib.sha256(b"x" * n).hexdigest(), None) for i, n in enumerate([0, 1, 5000, 200_000])]
    whole = gzip.compress(b"".join(records[:2])) + gzip.compress(b"".join(records[2:]))
    for step in (1 << 20, 1000, 7):
        assert list(warc._records(whole[i : i + step] for i in range(0, len(whole), step))) == records


def test_a_record_without_length_is_an_error():
    for record in (b"WARC/1.1\r\nWARC-Type: response\r\n\r\nbody\r\n\r\n", b"HTTP/1.1\r\n\r\n"):
        with pytest.raises(ValueError, match="record"):
            warc.parse(record)
    with pytest.raises(ValueError, match="without Content-Length"):
        list(warc._records([gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\nbody\r\n\r\n")]))


def test_a_cut_archive_is_an_error(spark):
    pieces = warc.write(warc.decide(pages(spark).coalesce(1)))
    cut = pieces.withColumn("data", F.expr("substring(data, 1, length(data) div 2)"))
    with pytest.raises(Exception, match="ends within a record"):
        warc.normalise(cut).count()


def small_archive(flushed: bool = False) -> bytes:
    """Ten records in one gzip stream, with a flush after each if asked for."""
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    out = b""
    for i in range(10):
        out += pack.compress(warc._record(i, f"http://x/{i}", b"payload" * i, 7 * i, hashlib.sha256(b"payload" * i).hexdigest(), None))
        out += pack.flush(zlib.Z_FULL_FLUSH) if flushed else b""
    return out + pack.flush()


@pytest.mark.parametrize("flushed", [False, True])
@pytest.mark.parametrize("step", [10**9, 7])
def test_no_cut_stream_passes(flushed, step):
    whole = small_archive(flushed)
    read = lambda data: list(warc._records(iter([data[i : i + step] for i in range(0, len(data), step)])))
    assert len(read(whole)) == 10
    for cut in range(len(whole)):
        with pytest.raises(ValueError):
            read(whole[:cut])
    assert len(read(whole + bytes(700))) == 10 and len(read(whole + bytes(3) + whole)) == 20
    for wrong in (b"x", bytes(9) + b"more", whole[: len(whole) // 2]):
        with pytest.raises(ValueError):
            read(whole + wrong)


def test_all_of_a_record_that_inflates_to_much(monkeypatch):
    monkeypatch.setattr(warc, "PIECE_BYTES", 64)
    record = warc._record(1, None, bytes(5000), 5000, hashlib.sha256(bytes(5000)).hexdigest(), None)
    data = gzip.compress(record)
    assert list(warc._records(iter([data[:-9], data[-9:]]))) == [record]


def test_records_from_elsewhere(spark):
    """Other digests, none at all, other ids; a payload that isn't its digest's is an error."""
    import base64

    sha1 = base64.b32encode(hashlib.sha1(b"hello").digest()).decode()

    def record(digest, body=b"hello", kind="response", extra=b""):
        block = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n" + extra + b"\r\n" + body
        fields = [("WARC-Type", kind), ("WARC-Record-ID", "<urn:uuid:1>"), ("Content-Length", str(len(block)))] + ([("WARC-Payload-Digest", digest)] if digest else [])
        return gzip.compress(warc._header(fields) + block + b"\r\n\r\n")

    fine = [record(f"sha1:{sha1}"), record(None), record("blake3:00"), record("md5:" + hashlib.md5(b"hello").hexdigest()), record(None, b"", "revisit"), record(f"sha1:{sha1}", b"5\r\nhello\r\n0\r\n\r\n", extra=b"Transfer-Encoding: chunked\r\n")]
    table = spark.createDataFrame([("a", 0, bytearray(b"".join(fine)))], warc.ARCHIVE)
    got = warc.read_laid(warc.lay_out(table)).collect()
    assert [(r.page_id, r.record_type) for r in got] == [(None, "response")] * 4 + [(None, "revisit"), (None, "response")]
    assert {r.payload_digest for r in got[:4]} == {hashlib.sha256(b"hello").hexdigest()} and got[4].payload_digest is None
    bad = spark.createDataFrame([("a", 0, bytearray(record(f"sha1:{sha1}", b"jello")))], warc.ARCHIVE)
    with pytest.raises(Exception, match="damaged"):
        warc.read_laid(warc.lay_out(bad)).collect()


@pytest.mark.parametrize("name", queries.queries())
def test_query(spark, small, name):
    if name in queries.oracle_sql():
        same_rows(spark, small, queries.queries()[name], queries.oracle_sql()[name])
    else:
        assert queries.queries()[name](spark, small).count() > 0


def test_each_stage_on_its_own_input(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "line_dedup", "ngram_jaccard", "decontamination", "mixing"]
    junk = spark.createDataFrame([(-1, "12 34 !!", "en", "x", 8), (-2, None, None, None, None)], fx.SCHEMA)
    known = steps["language_id"](spark, docs.unionByName(junk), small)
    assert known.columns == docs.columns and known.where("doc_id < 0").count() == 0 and known.count() >= 0.98 * docs.count()
    lined = steps["line_dedup"](spark, known, small)
    assert lined.columns == docs.columns and lined.count() == known.count()
    single = steps["ngram_jaccard"](spark, fx.docs(spark), small)
    assert single.columns == docs.columns
    ids = [r.doc_id for r in single.collect()]
    assert {1, 5, 6, 7, 8, 12, -4} & set(ids) == {5, 6, 7, 8, 12, -4} and ids.count(15) == 1 and not {2, 3, 20, 25} & set(ids)
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    clean = steps["decontamination"](spark, docs, small)
    assert clean.columns == docs.columns and decontam.decontaminate(clean, benchmark).where("contaminated").count() == 0
    dirty = decontam.decontaminate(docs, benchmark)
    untouched = dirty.where("not contaminated").select("doc_id", "text")
    assert untouched.exceptAll(clean.select("doc_id", "text")).isEmpty()
    mixed = steps["mixing"](spark, clean, small)
    assert mixed.columns == [*docs.columns, "copy"] and mixed.count() > 0


def test_copies_keep_their_text_until_the_jaccard_stage(spark, small):
    """A group of copies over the ratio of its source isn't boilerplate; a line of many texts is."""
    text = lambda i: "\n".join([*(" ".join(fx.words(100 * i + k, 12, 100000)) for k in range(4)), "all rights reserved"])
    rows = [(i, text(0) if i < 5 else text(i), "en", "s", 1) for i in range(40)]
    rows += [(100 + i, text(99) + " " * (i % 2), "en", "t", 1) for i in range(20)] + [(130, None, "en", "t", None), (131, "", "en", "t", 0)]
    docs = spark.createDataFrame(rows, fx.SCHEMA)
    steps = dict(corpus_pipeline.STAGES)
    lined = steps["line_dedup"](spark, docs, small)
    got = {r.doc_id: r.text for r in lined.collect()}
    want = {i: t if s == "t" else t.rsplit("\n", 1)[0] for i, t, _, s, _ in rows}
    assert got == want
    single = {r.doc_id for r in steps["ngram_jaccard"](spark, lined, small).collect()}
    assert single == {0, *range(5, 40), 100, 130, 131}


def test_one_text_of_a_repeated_id_stays(spark, small):
    """Of rows that repeat an id one stays, the first text that isn't empty; rows without an id stay; other columns go along."""
    a, b = " ".join(fx.words(60, 50, 9000)), " ".join(fx.words(61, 50, 9000))
    rows = [(1, a, "en", "s", 1), (1, b, "de", "t", 2), (1, None, None, None, None), (1, "", "en", "s", 0), (2, a, "en", "s", 1), (3, b, "en", "s", 1), (None, a, "en", "s", 1), (4, None, None, None, None), (4, None, None, None, None)]
    docs = spark.createDataFrame(rows, fx.SCHEMA)
    got = sorted((tuple(r) for r in dict(corpus_pipeline.STAGES)["ngram_jaccard"](spark, docs, small).collect()), key=str)
    assert got == sorted([min(rows[:2], key=lambda r: r[1]), rows[6], rows[7]], key=str)


def test_stages_against_plain_python(spark, small):
    """Jaccard, decontamination and mixing stages by brute force, each on its own input."""
    docs = fx.docs(spark).where("doc_id is not null and doc_id <> 15")
    steps, rows = dict(corpus_pipeline.STAGES), [tuple(r) for r in docs.collect()]
    shingles = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())(fx.plain(fx.lower(t)))
    sets, root = {r[0]: shingles(r[1]) for r in rows}, {r[0]: r[0] for r in rows}
    for _ in range(len(rows)):
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    single = steps["ngram_jaccard"](spark, docs, small)
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i in root if root[i] == i)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    poisoned = [(900, "before it " + items[0][1] + " after it", "en", "a", 1), (901, items[1][1], "en", "a", 1)]
    given = single.unionByName(spark.createDataFrame(poisoned, fx.SCHEMA))
    clean = {r.doc_id: r.text for r in steps["decontamination"](spark, given, small).collect()}
    hits = {h[0]: (h[1], h[2]) for h in brute_hits([tuple(r) for r in given.collect()], items)}
    assert set(clean) == {i for i, (n, hit) in hits.items() if not hit or hit < n}
    assert all(clean[r.doc_id] == r.text for r in given.collect() if r.doc_id in clean and not hits[r.doc_id][1])
    assert clean[900].split()[:2] == ["before", "it"] and len(alnum(clean[900])) == hits[900][0] - hits[900][1]
    mixed = steps["mixing"](spark, given, small).collect()
    from leafmark.llm import mixing

    want = {r.doc_id: r.copies for r in mixing.plan(given).collect()}
    assert {i: sum(r.doc_id == i for r in mixed) for i in want} == want


def test_pipeline_of_nothing_and_of_hard_cases(spark, small):
    for docs in (fx.empty(spark), fx.docs(spark)):
        for _, step in corpus_pipeline.STAGES:
            docs = step(spark, docs, small)
        docs.count()
