"""The stored family of suffix arrays: batch after batch equals one brute-force pass over all."""

import hashlib
from collections import Counter

import pytest

from ragchew.llm.suffix_levels import IndexConflict, SuffixIndex

COLUMNS = "doc_id long, text string, anchor int, k string, batch int"  # clashing names beside id and text
BLOCK = "".join(f"{i * 7919 % 1009:x}" for i in range(400))


def brute(rows):
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i:i + 200] for _, b in raw for i in range(len(b) - 199))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(index, version=None):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in index.results(version).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], COLUMNS).repartition(3)


def test_batches_equal_brute_force(spark, small_dir, tmp_path):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    half = len(docs) // 2
    batches = [
        docs[:half] + [(-1, "é" + BLOCK), (None, None)],
        docs[half:] + [(-2, "other words " + BLOCK[100:700]), (None, "")],
        [(-3, BLOCK[650:] + " tail"), (-1, "é" + BLOCK), (-4, "y" * 3000), (None, "y" * 250)],
        [(-5, BLOCK[:199]), (-6, "short")],
        [(-7, "z" + BLOCK[:200]), (-8, docs[0][1])],
    ]
    index, every, suffixes = SuffixIndex(spark, str(tmp_path / "index"), unit=256), [], []
    for i, batch in enumerate(batches):
        assert index.add(frame(spark, batch)) == i + 1
        every += batch
        suffixes.append(sum(n for _, n in index.levels()))
        classes = [index.size_class(n) for _, n in index.levels()]
        assert len(set(classes)) == len(classes)
        if i != 3:
            assert got(index) == brute(every)
    assert suffixes == sorted(suffixes) and suffixes[-1] > suffixes[0]
    # an older version is the index before the later batches: document -1 had lost nothing yet
    assert got(index, 1) == brute(batches[0])
    before = got(index)
    assert index.vacuum() and got(index) == before and not index.vacuum()


def test_old_document_loses_what_comes_again(spark, tmp_path):
    index = SuffixIndex(spark, str(tmp_path / "index"), unit=1)
    first, second = [(1, "a " + BLOCK)], [(2, BLOCK + " b")]
    index.add(frame(spark, first))
    assert [r[2] for r in got(index)] == [0]
    index.add(frame(spark, second))
    assert got(index) == brute(first + second) and all(r[2] == len(BLOCK) for r in got(index))


def test_empty_batch_and_empty_index(spark, tmp_path):
    index = SuffixIndex(spark, str(tmp_path / "index"))
    assert index.version() == 0 and got(index) == []
    assert index.add(frame(spark, [])) == 0 and got(index) == []
    assert index.add(frame(spark, [(7, None)])) == 1
    assert got(index) == brute([(7, None)])


def test_second_writer_fails_and_stopped_writer_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    index, other = SuffixIndex(spark, path), SuffixIndex(spark, path)
    index.add(frame(spark, [(1, BLOCK)]))
    publish = other._publish

    def late(version, levels):  # another batch is added while this one is written
        index.add(frame(spark, [(2, BLOCK)]))
        publish(version, levels)

    monkeypatch.setattr(other, "_publish", late)
    with pytest.raises(IndexConflict):
        other.add(frame(spark, [(3, BLOCK)]))
    assert got(index) == brute([(1, BLOCK), (2, BLOCK)])

    def stop(version, levels):
        raise OSError("lost")

    monkeypatch.setattr(other, "_publish", stop)
    with pytest.raises(OSError):
        other.add(frame(spark, [(4, BLOCK)]))
    assert got(index) == brute([(1, BLOCK), (2, BLOCK)]) and index.version() == 2
