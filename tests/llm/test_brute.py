"""Operators that SQL cannot state, against brute force on the small test tables and hand-made rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ragchew.llm import decontam, mixing, near_dups, pii, registered, sharding, suffix_index, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def table(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(table):
    return {r.doc_id: r.text for r in table.collect()}


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# --- near duplicates ---------------------------------------------------------------------------------

def shingles(text):
    words = WORD.findall(fold(text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def components(texts, num, den):
    sets, root = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def chain(n=9, words=120):
    """Texts of which only neighbours are alike."""
    base = [f"w{i * i % 977}x{i}" for i in range(words + n * 4)]
    return {10_000 + k: " ".join(base[k * 4:k * 4 + words]) for k in range(n)}


@pytest.mark.parametrize("similarity", [(85, 100), (80, 100)])
def test_near_duplicates(spark, texts, similarity):
    every = texts | chain() | {20_000: "A  b", 20_001: "a B", 20_002: None, 20_003: " "}
    df = spark.createDataFrame(list(every.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(df, similarity=similarity).collect()}
    assert got == components(every, *similarity)
    assert len({c for _, c in got.values()}) < len(every) - 5


# --- removed repeats ---------------------------------------------------------------------------------

def test_removed_repeats_all_columns(spark, texts):
    block = "".join(f"{i * 7919 % 1009:x}" for i in range(400))
    every = texts | {30_000: "é" + block + " ä " + block, 30_001: None, 30_002: "x" * 5000, 30_003: block[:199], 30_004: block[:200]}
    raw = {d: (t or "").encode() for d, t in every.items()}
    seen = Counter(b[i:i + 200] for b in raw.values() for i in range(len(b) - 199))
    want = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        want[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    df = spark.createDataFrame(list(every.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_index.remove_repeats(df).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 5000


# --- personal data -----------------------------------------------------------------------------------

KINDS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 9 <= len(digits(s)) <= 15),
]


def digits(s):
    return [int(c) for c in s if "0" <= c <= "9"]


def luhn(ds):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(ds))) % 10 == 0


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in KINDS for m in p.finditer(text or "") if ok(m.group())]


def test_personal_data_base(table, texts):
    found = 0
    for r in pii.detect(table).collect():
        want = base(texts[r.doc_id])
        found += len(want)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k, _, _ in KINDS]
        assert set(want) <= set(r.spans.split(",")) | {""}
    assert found > 10


def test_personal_data_written_otherwise_is_added(spark):
    data = []
    for i in range(400):
        phone = f"{200 + i} 555 {1000 + 7 * i}"
        mail = ["ann{0}@site{0}.org", "ann{0} (at) site{0} (dot) org", "ann{0}[at]site{0}[dot]org"][i % 3].format(i)
        call = [f"+34 {phone}", f"0034 {phone}"][i % 2]
        data.append((i, f"Filler text number {i % 5}. Write to {mail} or call {call}. Bought {i} of 12.5 kg on 2023-11-{i % 28 + 1:02d}."))
    got = {r.doc_id: r for r in pii.detect(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    spelled = [i for i in range(400) if i % 3]
    dialled = [i for i in range(400) if i % 2]
    assert sum("email" in got[i].spans and got[i].n_email == 0 for i in spelled) > 0.9 * len(spelled)
    assert sum("phone" in got[i].spans and got[i].n_phone == 0 for i in dialled) > 0.9 * len(dialled)
    for i, text in data:  # what is added covers just what was written, and nothing else
        for s in filter(None, got[i].spans.split(",")):
            kind, a, z = s.split(":")
            assert kind in ("email", "phone", "card") and (text[int(a):int(z)].startswith(("ann", "+34", "0034"))), text[int(a):int(z)]


def test_calibration_shares_no_document_with_training(spark):
    assert pii.is_personal(0, "a (at) b (dot) org") and not pii.is_personal(0, "a at b dot org")
    assert pii.is_personal(2, "4111.1111.1111.1111") and not pii.is_personal(2, "4111.1111.1111.1112")
    assert pii.is_personal(3, "0034 600 100 200") and not pii.is_personal(3, "600 100 200") and not pii.is_personal(1, "1.2.3.256")


# --- mixing ------------------------------------------------------------------------------------------

def water(sizes):
    """Targets by sharing out what is above the caps until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full, left = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        part = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if part[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return full | part
        for s in over:
            full[s] = 2.0 * sizes[s]
            left -= full[s]


def test_mix_targets_and_words(spark, table):
    more = spark.createDataFrame([(70_000, "one two  three", None), (70_001, None, None), (70_002, "", "lone"), (70_003, "x " * 9000, "src1")],
                                 "doc_id long, text string, source string")
    df = table.select("doc_id", "text", "source").unionByName(more)
    size = {r.doc_id: (len(WORD.findall(r.text or "")), r.source) for r in df.collect()}
    total = defaultdict(int)
    for n, s in size.values():
        total[s] += n
    target = water(dict(total))
    got = {r.doc_id: r for r in mixing.mix_documents(df).collect()}
    taken = defaultdict(int)
    for d, (n, s) in size.items():
        r = got[d]
        assert (r["size"], r["source_size"]) == (n, total[s]) and r["target"] == pytest.approx(target[s])
        assert r["taken"] in (0, n, 2 * n)
        taken[s] += r["taken"]
    for s in total:
        own = sorted(n for n, x in size.values() if x == s)
        if s not in ("src1", None):  # one long text in ten short ones; one text
            assert abs(taken[s] - target[s]) <= max(own[len(own) // 2], 1), s


def test_mix_is_fair(spark):
    """Over many seeds each document is taken as often as its share says."""
    df = spark.createDataFrame([(i, 10 + i % 7, "s" if i < 30 else "t") for i in range(90)], "doc_id long, size long, source string")
    counts, runs = Counter(), 5
    for seed in range(runs):
        for r in mixing.pivotal_copies(df, ["doc_id"], seed=seed).where("source = 't'").collect():
            counts[r.doc_id] += r.copies
            share = r.target / r.source_size
    assert all(abs(counts[d] / runs - share) < 0.8 for d in range(30, 90))
    assert abs(sum(counts[d] for d in range(30, 90)) / runs / 60 - share) < 0.03


# --- sharding ----------------------------------------------------------------------------------------

def test_shards_hold_the_law(table, texts):
    got = registered.queries()["op7_sharding"](table.sparkSession, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    load, slots = Counter(), defaultdict(list)
    for r in got:
        b = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(b) + 8, zlib.crc32(b), "bytes", None)
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert set(load) == set(range(24)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(load.values()) - min(load.values()) <= 0.1 * sum(load.values()) / 24


# --- decontamination ---------------------------------------------------------------------------------

PLAIN = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")


def leaks(texts, items):
    """Every passage of every text against every item, scored in full."""
    words = lambda t: PLAIN.findall((t or "").lower())
    bags = {i: Counter(words(t)) for i, t in items.items() if words(t)}
    df = Counter(w for b in bags.values() for w in b)
    mean = sum(sum(b.values()) for b in bags.values()) / max(len(bags), 1)
    out = defaultdict(set)
    for i, bag in bags.items():
        n = sum(bag.values())
        weight = {w: math.log1p((len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))
                  for w, tf in bag.items()}
        own, stride = sum(weight.values()), 64
        while stride < n:
            stride *= 2
        halves = [words(h) for h in decontam.halves(items[i])]
        for d, text in texts.items():
            ws = words(text)
            count = max(-(-len(ws) // stride) - 1, 1 if ws else 0)
            for p in range(count):
                part = ws[p * stride:] if p == count - 1 else ws[p * stride:(p + 2) * stride]
                inside = set(part)
                if sum(v for w, v in weight.items() if w in inside) / own < 0.6 - 1e-12:
                    continue
                grams = {tuple(part[k:k + 3]) for k in range(max(len(part) - 2, 1))}
                good = True
                for h in halves:
                    if len(h) >= 3:
                        of = {tuple(h[k:k + 3]) for k in range(len(h) - 2)}
                        good &= len(of & grams) >= 0.5 * len(of)
                    elif h:
                        good &= sum(w in inside for w in h) >= 0.5 * len(h)
                if good:
                    out[d].add(i)
    return {d: sorted(out[d]) for d in texts}


@pytest.mark.parametrize("block", [1, 8])
def test_leaks(spark, texts, small_dir, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK", block)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()}
    long = " ".join(f"t{i * i % 613}" for i in range(300))
    items |= {5000: long, 5001: "Is it? Yes.", 5002: None}
    every = texts | {40_000: "before " * 700 + long + " after" * 80, 40_001: "we ask: IS IT? yes. and more", 40_002: None, 40_003: ""}
    got = decontam.decontaminate(spark.createDataFrame(list(every.items()), "doc_id long, text string"),
                                 spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    want = leaks(every, items)
    assert {r.doc_id: r.leak_items for r in got} == want
    assert want[40_000] == [5000] and want[40_001] == [5001] and sum(map(bool, want.values())) > 4


def test_verdict_on_an_item_does_not_depend_on_others(spark):
    question, answer = " ".join(f"q{i}" for i in range(12)) + "?", " ".join(f"a{i}" for i in range(12)) + "."
    apart = question + " " + " ".join(f"between{i}" for i in range(500)) + " " + answer
    docs = spark.createDataFrame([(1, apart), (2, question + " " + answer)], "doc_id long, text string")
    one = [(9007199254740993, question + " " + answer), (None, "nobody has this one here")]
    unrelated = (3, " ".join(f"other{i}" for i in range(2000)))
    got = [{r.doc_id: r.leak_items for r in decontam.decontaminate(
        docs, spark.createDataFrame(rows, "item_id long, text string")).collect()} for rows in (one, [*one, unrelated])]
    assert got[0] == got[1] == {1: [], 2: [9007199254740993]}


def test_lists_are_skipped(spark, texts, small_dir):
    """The traversal looks at fewer postings than the lists of the passages' terms hold."""
    import numpy as np
    import pyarrow as pa
    from ragchew.llm.hashing import PLAIN as GAPS, word_hashes
    items = spark.createDataFrame([(i, " ".join(f"w{(i * 31 + j * j) % 997}" for j in range(40))) for i in range(400)], "item_id long, text string")
    (index,), = decontam.build_index(items)
    few = [" ".join([f"w{k * 31 % 997}", f"w{k * 31 + 4}", f"w{k * 31 + 9}", *(f"no{j}" for j in range(80))]) for k in range(20)]
    many = [" ".join(f"w{(k * 31 + j * j) % 997}" for j in range(40)) + " tail" * 90 for k in range(20)]
    words, firsts = word_hashes(pa.array(few + many), GAPS, fold=True)
    seen, held = [], 0
    found = {(x, index["ids"][i]) for x, _, _, i, _ in decontam.retrieve(index, words, firsts, index["stride"], seen)}
    assert {(20 + k, k) for k in range(20)} <= found and all(x >= 20 for x, _ in found)
    for a, z in zip(firsts, firsts[1:]):
        per = max(-(-(z - a) // 64) - 1, 1)
        for q in range(per):
            inside = np.unique(words[a + q * 64:z if q == per - 1 else a + (q + 2) * 64])
            t = np.flatnonzero(np.isin(index["terms"], inside))
            held += int((index["start"][t + 1] - index["start"][t]).sum())
    assert 0 < sum(seen) < held


# --- toxicity ----------------------------------------------------------------------------------------

def test_toxicity_likelihoods_by_hand(spark):
    """The interpolated models of a small corpus, word by word."""
    import random
    rnd = random.Random(8)
    vocabulary = [a + b for a in ("stone", "water", "winds", "fires") for b in ("", "s", "ing", "ed")] + ["odd", "rare"]
    data = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 14)))) for i in range(90)]
    data += [(90, "unseen waterfall unseen odd"), (91, "")]
    labels = [(i, int(i % 3 == 0)) for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}

    marks = spark.createDataFrame(labels, "id long, y int").where(~toxicity.held_out("id")).select(
        "id", "y", F.xxhash64("id", F.lit(17)).alias("o"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1000)).alias("f")).collect()
    least = min(Counter(m.y for m in marks).values())
    share = int(1000 * max(1, least // 4) / least)
    chosen = [m for y in (0, 1) for m in sorted((m for m in marks if m.y == y), key=lambda m: (m.o, m.id))[:least]]
    text = dict(data)
    has, follows, pair_docs = ({0: Counter(), 1: Counter()} for _ in range(3))
    for m in chosen:
        if m.f >= share:
            ws = text[m.id].split()
            has[m.y].update(set(ws))
            pair_docs[m.y].update(set(zip(ws, ws[1:])))
    for y in (0, 1):
        for a, b in pair_docs[y]:
            follows[y][b] += 1
    corpus = Counter(w for _, t in data for w in t.split())
    begun = Counter()
    for w, n in corpus.items():
        begun[w[:5]] += n
    every = sum(corpus.values())
    known = set(has[0]) | set(has[1])
    stems = {w[:5] for w in known}
    size = {y: max(sum(follows[y].values()), 1) for y in (0, 1)}
    stem_f = {y: Counter() for y in (0, 1)}
    for y in (0, 1):
        for w, n in follows[y].items():
            stem_f[y][w[:5]] += n
    kept = lambda n, d=2.0: max(n - d, 0)
    free_stem = max(1 - sum(kept(stem_f[y][s]) / size[y] for y in (0, 1) for s in stems) / 2, 1e-3)
    free_word = max(1 - sum(kept(follows[y][w]) / size[y] for y in (0, 1) for w in known) / 2, 1e-3)
    heads = {y: Counter() for y in (0, 1)}
    for y in (0, 1):
        for (a, b), n in pair_docs[y].items():
            heads[y][a] += n
    some = {p for p in set(pair_docs[0]) | set(pair_docs[1]) if pair_docs[0][p] + pair_docs[1][p] > 1}

    def chance(y, before, w):
        if w[:5] in stems:
            lower = (kept(stem_f[y][w[:5]]) / size[y] + free_stem * begun[w[:5]] / every) * min(corpus[w] / begun[w[:5]], 1)
        else:
            lower = free_stem * corpus[w] / every
        p = (kept(follows[y][w]) / size[y] if w in known else 0) + free_word * lower
        if before not in known:
            return p
        by_class = {c: {b: kept(pair_docs[c][(a, b)]) / max(heads[c][a], 1) for a, b in some if a == before} for c in (0, 1)}
        free_pair = max(1 - sum(sum(x.values()) for x in by_class.values()) / 2, 1e-3)
        both = {b: (pair_docs[0][(a, b)] + pair_docs[1][(a, b)] - 1) / max(heads[0][a] + heads[1][a], 1) for a, b in some if a == before}
        free_both = max(1 - sum(both.values()), 1e-3)
        return by_class[y].get(w, 0) + free_pair * both.get(w, 0) + free_pair * free_both * p

    for d, t in data:
        ws = t.split()
        assert got[d].n_words == len(ws)
        for y, column in ((1, "toxic_ll"), (0, "plain_ll")):
            want = sum(math.log(chance(y, b, w)) for b, w in zip([None, *ws], ws)) / max(len(ws), 1)
            assert got[d][column] == pytest.approx(want, abs=1e-9), (d, column)


# --- the pipeline ------------------------------------------------------------------------------------

ODD = ["score", "n_words", "n_passages", "leak_items", "_n", "_c", "_k", "_k0", "_h1", "_j", "cid", "rest", "vslot", "shard", "strange", "Taken"]


def odd_table(spark, table):
    """The documents with columns that the stages use for themselves, nulls, empty and repeated rows, and a very long text."""
    df = table.withColumns({c: F.concat(F.lit(c + " "), F.col("doc_id").cast("string")) for c in ODD})
    blank = [None] * (len(df.columns) - 2)
    extra = spark.createDataFrame([(80_000, None, *blank), (80_001, "", *blank), (None, "no id but words here", *blank),
                                   (80_002, "long " * 30_000, *blank), (80_003, "twice the same row", *blank),
                                   (80_003, "twice the same row", *blank)], df.schema)
    return df.unionByName(extra)


@pytest.mark.parametrize("number", range(5))
def test_stages_leave_rows_as_they_are(spark, table, small_dir, number):
    name, stage = corpus_pipeline.STAGES[number]
    docs = odd_table(spark, table).cache()
    out = stage(spark, docs, small_dir)
    assert out.columns[:len(docs.columns)] == docs.columns
    assert len(out.columns) == len(docs.columns) + (2 if name == "sharding" else 0)
    assert out.select(*docs.columns).distinct().exceptAll(docs.distinct()).count() == 0, name
    none = stage(spark, docs.where("false"), small_dir)
    assert none.columns == out.columns and none.count() == 0
    narrow = stage(spark, docs.select("doc_id", "text", "source"), small_dir)
    assert narrow.columns[:3] == ["doc_id", "text", "source"] and narrow.count() > 0


def test_filter_stages_against_brute_force(spark, table, texts, small_dir):
    stages = dict(corpus_pipeline.STAGES)
    kept = {r.doc_id for r in stages["near_duplicates"](spark, table, small_dir).collect()}
    assert kept == {d for d, (_, c) in components(texts, 80, 100).items() if d == c}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()}
    clean = {r.doc_id for r in stages["decontamination"](spark, table, small_dir).collect()}
    assert clean == {d for d, found in leaks(texts, items).items() if not found}
    scores = {r.doc_id: r.score for r in toxicity.score_documents(table, spark.read.parquet(f"{small_dir}/labels.parquet")).collect()}
    calm = {r.doc_id for r in stages["toxicity"](spark, table, small_dir).collect()}
    assert calm == {d for d, s in scores.items() if s < corpus_pipeline.REJECT}


def test_the_whole_pipeline_is_its_stages(spark, table, texts, small_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    last = corpus_pipeline.run(spark, small_dir).collect()
    docs = table
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, small_dir)
    left = {r.doc_id for r in docs.collect()}
    copies = Counter(r.doc_id for r in last)
    assert set(copies) <= left and max(copies.values()) <= 2
    size, total, taken = {}, defaultdict(int), defaultdict(int)
    for r in docs.collect():
        size[r.doc_id] = (len(WORD.findall(r.text or "")), r.source)
        total[r.source] += size[r.doc_id][0]
    for d, n in copies.items():
        taken[size[d][1]] += n * size[d][0]
    target = water(dict(total))
    assert sum(taken.values()) == pytest.approx(sum(target.values()), rel=0.1)
    assert {r.text for r in last} <= set(texts.values()) and {r.shard for r in last} <= set(range(24))
