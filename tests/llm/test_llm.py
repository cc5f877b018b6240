"""Operators of the llm subpackage on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ragchew.llm import (decontam, line_chunks, mixing, near_dups, pii, registered, revisits, sharding,
                         suffix_index, topk, toxicity)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, vslot int"
PASSAGE = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, PASSAGE, "en", "a", 1, 0.0, 1), (2, PASSAGE + " more", "en", "a", 1, 0.0, 1), (3, None, None, None, None, None, None),
    (4, "", "en", "b", 0, 0.0, 1), (5, "short one", "en", "b", 1, 0.0, 1), (5, "short one", "en", "b", 1, 0.0, 1),
    (None, "no id here\nat all\n" * 30, "en", None, 1, 0.0, 1), (8, "z y x " * 9000, "en", "c", 1, 0.0, 1),
    (9, "mail a.b@c.org, 10.0.0.1, 4111 1111 1111 1111 or +1 (555) 555-1234.", "en", "c", 1, 0.0, 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_near_duplicates(docs, empty):
    got = rows(near_dups.near_duplicates(docs))
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["component_id"] == 1 and by[1]["kept"] and not by[2]["kept"]
    assert by[3]["n_shingles"] == by[4]["n_shingles"] == 0 and by[3]["kept"] and by[4]["kept"]
    assert by[5]["n_shingles"] == 1 and by[8]["n_shingles"] == 3
    assert near_dups.near_duplicates(empty).count() == 0
    kept = rows(near_dups.keep_one(docs))
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 1, 3, 4, 5, 8, 9]


def test_near_duplicate_agreement():
    assert near_dups.agree_for((85, 100)) == 29 and near_dups.agree_for((80, 100)) == 25
    assert near_dups.agree_for((1, 1)) == 48 and near_dups.agree_for((1, 100)) == 1


def brute_repeats(texts, length=200):
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i:i + length]] = seen.get(t[i:i + length], 0) + 1
    out = []
    for t in texts:
        gone = set()
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone.update(range(i, i + length))
        out.append(hashlib.sha256(bytes(b for i, b in enumerate(t) if i not in gone)).hexdigest())
    return sorted(out)


def test_suffix_index(docs, empty):
    got = rows(suffix_index.remove_repeats(docs.where("doc_id is null or doc_id <> 8")))
    texts = [(r[1] or "").encode() for r in ROWS if r[0] != 8]
    assert sorted(r["kept_sha256"] for r in got) == brute_repeats(texts)
    assert suffix_index.remove_repeats(empty).count() == 0


def test_suffix_index_with_frequent_anchors(spark):
    same = "".join(chr(97 + i * i % 26) + str(i) for i in range(120))
    texts = [f"{i} " * (i % 7) + same + f" end {i}" * (i % 40) for i in range(300)] + ["only once " + str(i) for i in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    assert len(suffix_index.hot_anchors(df.select(F.encode("text", "UTF-8").alias("text")), 200, 100)) > 0
    got = rows(suffix_index.remove_repeats(df))
    assert sorted(r["kept_sha256"] for r in got) == brute_repeats([t.encode() for t in texts])


def test_line_chunks(docs, empty, spark):
    got = rows(line_chunks.dedupe_lines(docs))
    assert len(got) == len(ROWS) and {r["text"] for r in got if r["doc_id"] in (3, 4)} == {""}
    lines = "\n".join(f"line {i} of the text" for i in range(40))
    two = spark.createDataFrame([(1, "own start\n" + lines), (2, lines + "\nown end")], "doc_id long, text string")
    one, other = sorted(rows(line_chunks.dedupe_lines(two)), key=lambda r: r["doc_id"])
    assert one["n_removed"] == 0 and other["n_removed_lines"] > 10 and other["text"].endswith("own end")
    assert line_chunks.dedupe_lines(empty).count() == 0


def test_line_chunks_have_two_lines(spark):
    import random
    rnd = random.Random(1)
    texts = ["\n".join(f"l{rnd.randrange(12)}" for _ in range(n)) for n in [1, 2, 3, 4, *(rnd.randrange(1, 90) for _ in range(60))]]
    texts += ["same\n" * 50, "\n" * 7, "a\n" + "same\n" * 9 + "b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in line_chunks.cut(df, "text").collect():
        sizes = [c.n_lines for c in r.chunks]
        assert "\n".join(c.body for c in r.chunks) == texts[r.doc_id] and sum(sizes) == texts[r.doc_id].count("\n") + 1
        assert sizes == [1] or min(sizes) >= 2, (texts[r.doc_id], sizes)
    got = {r.doc_id: r for r in line_chunks.dedupe_lines(df).collect()}
    assert got[64].n_removed_lines >= 44  # of 50 equal lines
    # a line put in front moves no boundary beyond the next rows of cuts
    long = [f"line {i * i % 101} of text" for i in range(200)]
    both = spark.createDataFrame([(1, "\n".join(long)), (2, "\n".join(["new one", *long]))], "doc_id long, text string")
    one, two = sorted(line_chunks.cut(both, "text").collect(), key=lambda r: r.doc_id)
    assert [c.body for c in one.chunks][4:] == [c.body for c in two.chunks][-(len(one.chunks) - 4):]
    # exact copies go whole
    copies = spark.createDataFrame([(i, "\n".join(long)) for i in range(3)], "doc_id long, text string")
    assert sorted(r.n_removed_lines for r in line_chunks.dedupe_lines(copies).collect())[1:] == [200, 200]


def test_pii(docs, empty):
    base = pii.base_spans(ROWS[-1][1])
    assert [k for k, _, _ in base] == [0, 1, 2, 3]
    got = {r["doc_id"]: r for r in rows(pii.detect(docs))}
    assert (got[9]["n_email"], got[9]["n_ip"], got[9]["n_card"], got[9]["n_phone"]) == (1, 1, 1, 1)
    assert got[3]["spans"] == "" and got[4]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.detect(empty).count() == 0
    assert "<email>" in {r["doc_id"]: r for r in rows(pii.redact(docs))}[9]["redacted"]


def test_mixing(docs, empty):
    got = rows(mixing.mix_documents(docs))
    assert len(got) == len(ROWS) and all(r["taken"] <= 2 * r["size"] for r in got)
    assert abs(sum({r["source_size"]: r["target"] for r in got}.values()) - 1.5 * sum(r["size"] for r in got)) < 1e-6
    key = lambda r: (r["doc_id"] or 0, r["taken"])
    assert sorted(got, key=key) == sorted(rows(mixing.mix_documents(docs.repartition(5))), key=key)
    assert mixing.mix_documents(empty).count() == 0
    assert mixing.mix_rows(docs).columns == docs.columns


def test_mixing_meets_targets(spark):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 97 + 1).alias("size"),
                                    F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    got = mixing.pivotal_copies(many, ["doc_id"], fan_in=32).groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 97 for r in got)


def test_sharding(docs, empty, spark, tmp_path):
    got = rows(sharding.shard_documents(docs, shards=3))
    assert len(got) == len(ROWS)
    for s in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.shard_documents(empty).count() == 0
    first = sharding.first_map(spark, 4, 64)
    loads = spark.range(64).select(F.col("id").cast("int").alias("vslot"), (F.col("id") * 10).alias("bytes"))
    second = sharding.rebalance(first, loads, 5)
    path = str(tmp_path / "map")
    sharding.save_version(first, path, 1)
    sharding.save_version(second, path, 2)
    assert sharding.load_version(spark, path).select("version").distinct().collect()[0][0] == 2
    with pytest.raises(FileExistsError):
        sharding.save_version(first, path, 2)
    assert sharding.load_version(spark, path).count() == 64 and sharding.load_version(spark, path, 1).count() == 64
    (tmp_path / "map" / "version=2" / "_SUCCESS").unlink()  # as a job leaves it that stops
    assert sharding.versions(spark, path) == [1]
    sharding.save_version(second, path, 2)
    assert sharding.load_version(spark, path).count() == 64
    # with the same loads and shards no slot moves
    third = sharding.next_version(spark, loads, 5, path)
    assert third.select("version").distinct().collect()[0][0] == 3
    assert third.select("vslot", "shard").exceptAll(second.select("vslot", "shard")).count() == 0
    sums = [r["b"] for r in second.join(loads, "vslot").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()]
    assert len(sums) == 5 and max(sums) - min(sums) <= 200


def test_topk_ties_and_bad_vectors(spark):
    data = [(0, [1.0, 0.0]), (100, [1.0, 1.0]), (7, [1.0, 0.0]), (3, [1.0, 0.0]), (5, [float("nan"), 0.0]), (6, None),
            (8, [1.0, None]), (9, [-1.0, 0.5])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.search_embeddings(df, k=2).collect()}
    assert got[(0, 1)] == (3, 1024 ** 2) and got[(0, 2)] == (7, 1024 ** 2)
    assert got[(100, 1)] == (0, 1024 ** 2) and got[(100, 2)] == (3, 1024 ** 2)
    assert topk.search_embeddings(df.where("false")).count() == 0


def test_revisits(spark):
    kind = "record_id long, url string, fetched timestamp, kind string, status int, headers map<string,string>, digest string"
    at = lambda s: f"2024-01-01 0{s}:00:00"
    data = [(1, "http://www.A.com/x/", at(1), "response", 200, {"etag": '"1"', "content-type": "t"}, "d"),
            (2, "https://a.com/x?utm_source=f#z", at(5), "revisit", 304, {"etag": 'W/"1"', "date": "n", "content-type": "u"}, None),
            (3, "a.com/x", at(6), "revisit", 304, {"etag": '"2"'}, None), (4, None, at(6), "revisit", 304, {}, None),
            (5, "a.com/y", at(6), "revisit", 304, {}, None), (6, "a.com/x", None, "revisit", 304, {}, None)]
    df = spark.createDataFrame(data, kind.replace("timestamp", "string")).withColumn("fetched", F.to_timestamp("fetched"))
    got = {r["record_id"]: r for r in rows(revisits.resolve_revisits(df))}
    assert got[2]["resolved_id"] == 1 and got[2]["headers"] == {"etag": 'W/"1"', "content-type": "t", "date": "n"}
    assert [got[i]["outcome"] for i in (3, 4, 5, 6)] == ["validator_mismatch", "no_url", "no_response", "no_time"]
    assert revisits.resolve_revisits(df.where("false")).count() == 0


def test_decontamination(docs, empty, spark):
    item = " ".join(f"word{i}" for i in range(10, 40)) + ". Answer word40 word41 word42."
    items = spark.createDataFrame([(7, item), (8, None), (9, "other words that nobody ever wrote down here")],
                                  "item_id long, text string")
    more = docs.unionByName(spark.createDataFrame([(50, "Intro. " + item.upper() + " End.", "en", "a", 1, 0.0, 1)], DOCS))
    got = {r["doc_id"]: r for r in rows(decontam.decontaminate(more, items))}
    assert got[50]["leak_items"] == [7] and not got[5]["contaminated"] and got[3]["n_passages"] == 0
    assert decontam.decontaminate(empty, items).count() == 0
    assert decontam.decontaminate(docs, items.where("false")).where("contaminated").count() == 0


def test_decontamination_of_an_item_without_spaces(spark):
    code = ";".join(f"x{i}=a{i}" for i in range(200))
    short = [(i, f"short item number {i} of many") for i in range(2, 42)]
    items = spark.createDataFrame([(1, code), *short], "item_id long, text string")
    assert [[s["stride"] for s in g] for g in decontam.build_index(items, shard_rows=400)] == [[64], [512]]
    text = " ".join(f"left{i}" for i in range(90)) + " " + code + " " + " ".join(f"right{i}" for i in range(900))
    docs = spark.createDataFrame([(1, text), (2, text.replace("=", "=b"))], "doc_id long, text string")
    got = {r["doc_id"]: r["leak_items"] for r in rows(decontam.decontaminate(docs, items))}
    assert got == {1: [1], 2: []}


def test_toxicity(docs, empty, small_dir, spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    got = rows(toxicity.score_documents(docs, labels))
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_documents(empty, labels).count() == 0
    assert toxicity.score_documents(docs, labels.where("false")).where("predicted = 1").count() == 0


def test_toxicity_of_a_rare_phrase_of_ordinary_words(spark):
    import random
    rnd, data = random.Random(5), []
    for i in range(400):
        some = [f"w{rnd.randrange(60)}" for _ in range(20)]
        apart = [] if i % 2 and i < 100 else some[3:9]  # together in 50 documents, fewer of them in the class sample
        data.append((i, " ".join(some[:3] + ["red"] + apart + ["door"] + some[9:]), i % 2))
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r for r in rows(toxicity.score_documents(df, df.select("doc_id", "toxic")))}
    phrased = [got[i] for i in range(1, 100, 2)]
    ordinary = [got[i] for i in range(0, 400, 2)]
    mean = lambda rs, f: sum(f(r) for r in rs) / len(rs)
    lead = [mean(x, lambda r: r["toxic_ll"] - r["plain_ll"]) for x in (phrased, ordinary)]
    score = [mean(x, lambda r: r["score"]) for x in (phrased, ordinary)]
    assert lead[0] > lead[1] + 0.04 and score[0] > score[1] + 0.1, (lead, score)


def test_toxicity_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = registered.queries()["op2_toxicity"](spark, d).where("held_out").join(
        spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    assert got.where("predicted = toxic").count() >= 0.96 * got.count()


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_oracle(spark, small_dir, name):
    import pandas as pd
    from check_oracle import duck, rows_of
    df = registered.queries()[name](spark, small_dir)
    mine = pd.DataFrame(rows(df), columns=df.columns)
    assert rows_of(mine) == rows_of(duck(small_dir).execute(registered.oracle_sql()[name]).fetchdf())
