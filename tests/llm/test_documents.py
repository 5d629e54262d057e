"""Corpus operators on small fixtures: nulls, empty and long texts, ties, repeated rows, empty
tables, further columns with clashing names; and brute force where SQL says nothing."""

import hashlib
import io
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvaspark.llm import decontamination, groups, hamming_search, jaccard_join, language_id, line_dedup, sharding, substring_dedup, suffix_automaton, toxicity, warc, words
from silvaspark.llm import sentencepiece_fst as spm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th long, node long, component long, score double, line string"


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}{'abcdefgh'[rng.randrange(8)]}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [sentence(rng, 60) for _ in range(12)]
    texts = [None, "", " \n\t ", "one", "one two", *base, *base[:4], base[0]]
    for t in base[:6]:  # near copies
        w = t.split()
        w[30] = "changed"
        texts.append(" ".join(w))
    texts.append("very long " + sentence(rng, 6000, 5000))
    out = [(k, t) for k, t in enumerate(texts)]
    return [*out, out[6], (None, base[1]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3, 0.5, "x") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substring_dedup(docs, rows, empty):
    first = {}
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - 12):
            if i is not None:
                first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    want = []
    for i, t in rows:
        w = (t or "").split()
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert substring_dedup.remove_repeats(empty).count() == 0


def brute_links(rows):
    sets = [({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set()) for _, t in rows]
    n = len(rows)
    link = [[i != j and bool(sets[i]) and bool(sets[j]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            x = todo.pop()
            for y in range(n):
                if link[x][y] and y not in seen:
                    seen.add(y)
                    todo.append(y)
        ids = [rows[x][0] for x in seen if rows[x][0] is not None]
        out.append((rows[i][0], min(ids) if ids else None, sum(link[i])))
    return out


def test_jaccard_join(docs, rows, empty):
    got = [(r.doc_id, r.class_id, r.n_links) for r in jaccard_join.similar_classes(docs).collect()]
    assert sorted(got, key=repr) == sorted(brute_links(rows), key=repr)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    linked = {c for _, c, n in brute_links(rows) if n}
    alone = [(i, t) for (i, t), (_, _, n) in zip(rows, brute_links(rows), strict=True) if not n]
    assert kept.count() == len(linked) + len(alone)
    assert jaccard_join.similar_classes(empty).count() == 0


def test_jaccard_join_splits_large_groups_without_loss(spark):
    # 12 groups of 320 members, each more than one bucket compares, whose signatures are equal
    rng = np.random.default_rng(4)
    sigs = [rng.integers(0, 1 << 32, jaccard_join.SIGNATURE, dtype=np.uint32).tobytes() for _ in range(12)]
    members = spark.createDataFrame([(k, bytearray(sigs[k % 12])) for k in range(12 * 320)], "member long, sig binary")
    u = groups.Union(12 * 320)
    for e in jaccard_join.candidate_edges(members, 0.8, 0.9995, 1.5, 3).collect():
        u.join(e.u, e.v)
    assert all(u.root(k) == k % 12 for k in range(12 * 320))


def test_sharding(docs, rows, empty):
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_moves_rows_only_into_the_new_shard(spark):
    ids = spark.range(4000).withColumnRenamed("id", "k")
    for n in (40, 41, 57):
        moved = sharding.assign(ids, "k", sharding.tree(n), sharding.tree(n + 1)).where(F.col("shard") != F.col("grown_shard"))
        assert {r.grown_shard for r in moved.select("grown_shard").distinct().collect()} == {n}
    heavy = sharding.assign(ids, "k", sharding.tree(10), sharding.tree(10, weights={3: 4.0}))
    share = heavy.where("grown_shard = 3").count() / 4000
    assert abs(share - 4 / 13) < 0.04


def test_the_tree_decides_and_confines_movement(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "k")
    # the same shards below one rack are dealt out otherwise
    flat = [sharding.Leaf(0, 0, x.shard, x.weight) for x in sharding.tree(40)]
    both = sharding.assign(ids, "k", sharding.tree(40), flat)
    assert both.where("shard <> grown_shard").count() > 15_000
    for got in ("shard", "grown_shard"):
        n = [r["count"] for r in both.groupBy(got).count().collect()]
        assert len(n) == 40 and min(n) > 380 and max(n) < 630
    # shard 3 (region 0, rack 0) grows: rows come into its region, rack and itself; nothing moves elsewhere
    moved = sharding.assign(ids, "k", sharding.tree(40), sharding.tree(40, weights={3: 6.0})).where("shard <> grown_shard")
    place = lambda s: (s // 20, s // 5)
    pairs = {(r.shard, r.grown_shard) for r in moved.collect()}
    assert pairs and all(place(b)[0] == 0 for _, b in pairs)
    assert all(place(b) == (0, 0) for a, b in pairs if place(a)[0] == 0)
    assert all(b == 3 for a, b in pairs if place(a) == (0, 0))
    # brute force of the descent
    k, shard = 17, sharding.assign(ids.where("k = 17"), "k", sharding.tree(40)).first().shard
    at = []
    for level, names in (("region", [0, 1]), ("rack", None), ("shard", None)):
        names = names or ([4 * at[0] + j for j in range(4)] if level == "rack" else [5 * at[1] + j for j in range(5)])
        h = spark.range(1).select(*[F.shiftrightunsigned(F.xxhash64(F.lit(str(k)), F.lit(level), F.lit(n), F.lit(sharding.SEED)), 11).alias(str(n)) for n in names]).first()
        at.append(max(names, key=lambda n: h[str(n)]))
    assert at[2] == shard


def test_sharding_counts_equal_rows(spark):
    d = [(1, "same")] * 300 + [(2, None), (2, ""), (None, "x"), (None, "x")]
    got = sharding.shard_documents(spark.createDataFrame(d, "doc_id long, text string").repartition(3)).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(d) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r.shard for r in got if r.doc_id == 1}) == 1


def test_line_dedup(spark, docs, rows, empty):
    a = "the quick brownish foxes jumped over sleeping dogs near riverbanks yesterday evening before supper"
    b = a.replace("dogs", "dags")
    d = [(1, f"{a}\nshort line\nunique words standing alone here today", 10), (2, f"keepers {a[:0]}first\n{a.upper()}!\nshort line", 10), (3, b, 10), (3, b, 10), (4, None, None), (5, "", 0)]
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(d, "doc_id long, text string, n_chars long"), n_chars="n_chars", removed="gone").collect()
    out = {r.doc_id: (r.text, r.gone) for r in got}
    # equal lines go at any length
    assert out[1][1] == 0 and out[2] == ("keepers first", 2) and out[3] == ("", 1) and out[4] == (None, 0) and out[5] == ("", 0)
    assert [r.n_chars for r in got if r.doc_id == 3] == [0, 0]
    kept = line_dedup.drop_repeated_lines(docs)
    assert kept.count() == len(rows) and kept.columns == docs.columns
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_line_dedup_finds_typos_and_replaced_words(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    d = [(0, "the quarterly financial statement was approved"), (1, "the quartexly financial statement was approved")]
    for k in range(1, 101):
        w = [word(7) for _ in range(10)]
        v = list(w)
        if k % 2:  # one letter of one word
            v[5] = v[5][:3] + ("x" if v[5][3] != "x" else "y") + v[5][4:]
        else:  # one word
            v[5] = word(7)
        d += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(spark.createDataFrame(d, "doc_id long, text string")).collect()}
    assert all(got[2 * k] for k in range(101)) and got[1] == ""
    assert sum(got[2 * k + 1] == "" for k in range(101)) >= 99


def test_line_dedup_of_scripts_without_spaces(spark):
    a, b = "本公司保留所有权利未经许可不得转载或者使用", "สงวนลิขสิทธิ์ตามกฎหมายห้ามทำซ้ำ"
    d = [(1, a), (2, a.replace("许", "允")), (3, f"{b}\n{a}"), (4, b), (5, "保留"), (6, "保留")]
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(spark.createDataFrame(d, "doc_id long, text string")).collect()}
    assert got == {1: a, 2: "", 3: b, 4: "", 5: "保留", 6: ""}


def test_line_groups_against_all_pairs(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines = []

    def variants(n, words, most):
        base = [word(rng.randrange(3, 9)) for _ in range(words)]
        for _ in range(n):
            w = list(base)
            for _ in range(rng.randrange(most + 1)):
                w[rng.randrange(words)] = word(rng.randrange(3, 9))
            lines.append(" ".join(w))
        return base

    for _ in range(40):
        variants(4, 12, 2)
    # a group that is larger than one bucket compares, and lines that are like a few of its members only
    hot = variants(4 * line_dedup.NEAR, 15, 2)
    for _ in range(6):
        lines.append(" ".join([*hot[:12], *(word(5) for _ in range(3))]))
    # lines that share a passage are not similar
    for _ in range(2 * line_dedup.NEAR):
        lines.append(" ".join([*(word(6) for _ in range(14)), *hot]))
    lines = sorted(set(lines))
    rng.shuffle(lines)
    want = groups.Union(len(lines))
    pairs = []
    for i, a in enumerate(lines):
        for j in range(i):
            n = max(len(a), len(lines[j]))
            if abs(len(a) - len(lines[j])) <= n * 0.2 and line_dedup.distance(a, lines[j], n) <= int(n * 0.2 + 1e-9):
                want.join(i, j)
                pairs.append((i, j))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    at = line_dedup.line_table(docs, "doc_id", "text")
    got = {r.lid: r.group for r in line_dedup.line_groups(docs, at).collect()}
    of = [got.get(h, h) for h in map(line_dedup.line_hash, lines)]
    assert len(pairs) > 3000 and sum(of[i] == of[j] for i, j in pairs) >= 0.97 * len(pairs)
    # nothing is grouped that similar pairs do not connect
    head = {}
    assert all(head.setdefault(of[i], want.root(i)) == want.root(i) for i in range(len(lines)))


def test_lines_of_large_buckets_meet_in_groups_that_agree():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (3, line_dedup.WORDS), np.uint64)
    # lines of three groups that differ from the next one of their group in a few bins, and lines that are alone
    check = []
    for k in range(3):
        row = base[k].copy()
        for _ in range(20):
            row = row ^ (np.uint64(15) << np.uint64(4 * int(rng.integers(16))))
            check.append(row)
    check = np.array([*check, *rng.integers(0, 1 << 63, (60, line_dedup.WORDS), np.uint64)])[rng.permutation(120)]
    u = groups.Union(len(check))
    for i in range(len(check)):
        for j in np.flatnonzero(line_dedup.agree(check, check[i])):
            u.join(i, int(j))
    want = {}
    for k in range(len(check)):
        want.setdefault(u.root(k), []).append(k)
    got = line_dedup.agreeing_groups(check)
    assert sorted(g.tolist() for g in got) == sorted(g for g in want.values() if len(g) > 1) and any(len(g) >= 20 for g in got)


def test_line_candidates_keep_only_lines_that_agree(spark, monkeypatch):
    # lines that share the beginning fill large buckets, but few of them agree with another one
    rng = random.Random(8)
    start = sentence(rng, 9)
    lines = [f"{start} {sentence(rng, 45)}" for _ in range(6000)]
    lines += [x + " more" for x in lines[-20:]]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    at = line_dedup.line_table(docs, "doc_id", "text")
    keys = line_dedup.table_keys(line_dedup.minhashes(lines), line_dedup.tables_for(len(lines)))[0]
    size = np.unique(keys, return_counts=True)[1]
    large = int(size[size > line_dedup.NEAR].sum())
    found = line_dedup.candidates(at, len(lines)).collect()
    assert large > 1000 and sum(r.kind == line_dedup.MEMBER for r in found) < large / 4
    group = lambda: {(r.lid, r.group) for r in line_dedup.line_groups(docs, at).collect()}
    once = group()
    assert len(once) >= 38
    # a bucket that is too large to be split is compared whole and gives the same
    monkeypatch.setattr(line_dedup, "SPLIT", line_dedup.NEAR)
    monkeypatch.setattr(line_dedup, "LEADERS", 2)
    assert group() == once


def test_a_claim_gives_memory_back():
    def mb():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    words.claim("one")
    held = [bytearray(2000) for _ in range(100_000)]
    full = mb()
    # the last one keeps what lies before it from going by itself
    del held[:-1]
    words.claim("another")
    assert full - mb() > 100


def test_line_dedup_leaves_no_shuffle_files(spark, docs):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        every = disk.getAllFiles()
        return {every.apply(k).getName() for k in range(every.size())}

    had, before = files(), spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    line_dedup.mark_lines(docs)
    end = time.time() + 20
    while (left := {x for x in files() - had if x.startswith("shuffle")}) and time.time() < end:
        time.sleep(0.5)
    assert not left and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_mixed_buckets_lose_no_link():
    # line 1 is like line 2 alone, which stands in another class
    rng = random.Random(5)
    w = [sentence(rng, 20) for _ in range(2)]
    near = w[1].replace(w[1].split()[3], "other")
    lines = [w[0], near, w[1]]
    tables = line_dedup.tables_for(3)
    sig = line_dedup.minhashes(lines)
    # the first bucket that the second and third line share
    keys = line_dedup.table_keys(sig, tables)[0]
    bucket = int(keys[1][keys[1] == keys[2]][0])
    rows = [(bucket, 0, 0, 0, k + 1, (1, 1, 3)[k], sig[k].tobytes(), lines[k]) for k in range(3)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=list("abcdefgh"))
    out = [(u, v) for b in line_dedup._mixed([batch], tables, 0.8) for u, v in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert out == [(2, 3)]


def test_common_subsequences_of_many_lines_at_once():
    rng = random.Random(4)
    lines = ["", "a", "ab" * 4, *("".join(rng.choice("abc dé\u4e00") for _ in range(rng.randrange(1, 90))) for _ in range(60))]
    places = [line_dedup.letter_places(x) for x in lines]
    for b in lines[1:20]:
        assert line_dedup.common_subsequences(places, b).tolist() == [line_dedup.common_subsequence(x, b) for x in lines]


def test_bounds_of_the_edit_distance():
    rng = random.Random(6)
    for _ in range(300):
        a = sentence(rng, rng.randrange(1, 40), 60)
        w = a.split()
        for _ in range(rng.randrange(10)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(3)] = ["x" * rng.randrange(8)] * rng.randrange(3)
            w = w or ["y"]
        b = " ".join(w)
        d = line_dedup.distance(a, b, 10**6)
        assert line_dedup._by_words(a, b)[0] >= d and line_dedup._anchored(a, b, 10**6) >= d
        assert max(len(a), len(b)) - line_dedup.common_subsequence(a, b) <= d
        assert line_dedup.distance(a, b, d) == d and (not d or line_dedup.distance(a, b, d - 1) >= d)


def test_edit_similarity():
    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, c in enumerate(a):
            q = [i + 1]
            for j, d in enumerate(b):
                q.append(min(q[-1] + 1, p[j + 1] + 1, p[j] + (c != d)))
            p = q
        return p[-1]

    rng = random.Random(1)
    for _ in range(500):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(14)))
        b = "".join(x for x in a if rng.random() > 0.1) + rng.choice(["", "c"])
        n = max(len(a), len(b))
        assert line_dedup.edit_similar(a, b, 0.8) == (not n or 1 - distance(a, b) / n >= 0.8 - 1e-12)


def test_decontamination_masks_lose_no_window():
    for i in range(13):
        for j in range(i + 1, 13):
            assert any(not {i, j} & {x + s for x in m} for m in decontamination.MASKS for s in range(13 - m[-1]))


def test_decontamination(spark, docs, rows, empty):
    rng = random.Random(9)
    item = sentence(rng, 30).split()
    touched = list(item)
    touched[8], touched[15] = "x", "y"
    half = item[:14] + [f"z{k}" for k in range(16)]
    far = [x if k % 4 else f"q{k}" for k, x in enumerate(item)]
    d = [(1, "start here " + " ".join(item)), (2, " ".join(touched) + " end"), (3, " ".join(half)), (4, " ".join(far)), (5, None), (6, ""), (7, ", ".join(item).upper())]
    bench = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, "a b"), (None, "x y z")], "item_id long, text string")
    got = {r.doc_id: [h.item_id for h in r.hits] for r in decontamination.contaminate(spark.createDataFrame(d, "doc_id long, text string"), bench).collect()}
    assert got == {1: [10], 2: [10], 3: [10], 4: [], 5: [], 6: [], 7: [10]}
    assert decontamination.drop_contaminated(docs, bench).count() == len(rows)
    assert decontamination.contaminate(empty, bench).count() == 0
    # a column named like the result is replaced, others stay; repeated rows and items each count
    e = spark.createDataFrame([(1, "x " + " ".join(item), "a", 7), (1, "x " + " ".join(item), "a", 7), (None, " ".join(item), "b", 8)], "doc_id long, text string, hits string, th int")
    twice = spark.createDataFrame([(10, " ".join(item)), (10, " ".join(item)), (13, "five words of an item"), (14, "one two three four")], "item_id long, text string")
    found = decontamination.contaminate(e, twice).collect()
    assert sorted(repr((r.doc_id, r.th, [(h.item_id, h.start, h.end) for h in r.hits])) for r in found) == sorted([repr((1, 7, [(10, 1, 31)] * 2))] * 2 + [repr((None, 8, [(10, 0, 30)] * 2))])
    assert decontamination.drop_contaminated(e, twice).columns == e.columns and decontamination.drop_contaminated(e, twice).count() == 0
    short = spark.createDataFrame([(1, "with Five words, of an ITEM in it"), (2, "five words of one item"), (3, "one two three four")], "doc_id long, text string")
    assert {r.doc_id: [h.item_id for h in r.hits] for r in decontamination.contaminate(short, twice).collect()} == {1: [13], 2: [], 3: []}
    assert decontamination.contaminate(docs, bench.limit(0)).where("size(hits) > 0").count() == 0


def test_sentencepiece(spark, docs, rows, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    t = spm.Transducer(open(spm.MODEL, "rb").read())
    rng = random.Random(2)
    parts = ["▁", " ", "  ", "\n", "a", "b", "th", "the", "ing", "☃", "漢", "é", "1", ".", "...", "<s>", "<0x0A>", "▁▁", "🙂", "tion", "====", "\t", "THE"]
    for _ in range(800):
        x = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        ids = np.frombuffer(t.encode(x), "<i4")
        assert ids.tolist() == sp.encode(x)
        assert t.decode(ids) == sp.decode(ids.tolist())
    got = spm.encode_documents(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.text is None:
            assert r.ids is None and r.n_ids is None
        else:
            assert r.ids == sp.encode(r.text) and r.n_ids == len(r.ids) and r.round_trip
    back = spm.decode_ids(spm.encode_documents(docs))
    assert back.where("text is not null and decoded <> text").count() == 0
    assert spm.encode_documents(empty).count() == 0


def unigram_model(pieces, kind=1, byte_fallback=False, remove_extra=True):
    """A serialised model of given pieces and scores."""
    import struct

    def field(k, data):
        return bytes([k << 3 | 2, *([len(data)] if len(data) < 128 else [len(data) & 127 | 128, len(data) >> 7])]) + data

    out = b""
    for text, score, what in pieces:
        body = field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + (b"\x18" + bytes([what]) if what != 1 else b"")
        out += field(1, body)
    trainer = b"\x18" + bytes([kind]) + (b"\x98\x02\x01" if byte_fallback else b"")
    norm = field(1, b"identity") + b"\x18\x01" + b"\x20" + bytes([remove_extra])
    return out + field(2, trainer) + field(3, norm)


@pytest.mark.parametrize("byte_fallback,remove_extra", [(False, True), (True, False), (False, False)])
def test_sentencepiece_unigram_paths_have_least_weight(byte_fallback, remove_extra):
    import sentencepiece

    rng = random.Random(21)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if byte_fallback:
        pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    words = {"▁", "a", "b", "c", "▁a", "ab", "abc", "bc", "ca", "▁ab", "cab", "▁abc", "aa", "bb"}
    pieces += [(w, round(-rng.uniform(1, 9), 3), 1) for w in sorted(words)]
    data = unigram_model(pieces, byte_fallback=byte_fallback, remove_extra=remove_extra)
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    t = spm.Transducer(data)
    for _ in range(400):
        x = "".join(rng.choice("aabbcc é ") for _ in range(rng.randrange(20)))
        ids = np.frombuffer(t.encode(x), "<i4").tolist()
        if byte_fallback:
            assert ids == sp.encode(x)
        else:  # the library writes neighbouring unknown characters as one
            one = [i for k, i in enumerate(ids) if not (i == 0 and k and ids[k - 1] == 0)]
            assert one == sp.encode(x)


def test_shortest_path_against_all_paths():
    rng = random.Random(22)
    for _ in range(200):
        n = rng.randrange(2, 7)
        arcs = [[(to, rng.randrange(4), float(rng.randrange(9))) for to in range(k + 1, n) for _ in range(rng.randrange(3))] for k in range(n - 1)] + [[]]
        weight = {(a, b): rng.choice([0.0, 1.0, float("inf")]) for a in (None, 0, 1, 2, 3) for b in range(4)}
        follows = lambda a, b: weight[a and a[2], b[2]] if a else weight[None, b[2]]  # noqa: B023, E731
        best, todo = float("inf"), [(0, None, 0.0)]
        while todo:
            at, last, w = todo.pop()
            if at == n - 1:
                best = min(best, w)
            for to, label, x in arcs[at]:
                todo.append((to, label, w + x + weight[last, label]))
        if best == float("inf"):
            with pytest.raises(ValueError):
                spm.shortest(arcs, follows)
            continue
        path = spm.shortest(arcs, follows)
        got, last = 0.0, None
        for a, b, label in path:
            got += min(x for to, m, x in arcs[a] if (to, m) == (b, label)) + weight[last, label]
            last = label
        assert got == best and path[0][0] == 0 and path[-1][1] == n - 1


def test_sentencepiece_long_unbroken_text():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    t = spm.Transducer(open(spm.MODEL, "rb").read())
    rng = random.Random(23)
    for x in ("ab" * 3000, "".join(rng.choice("etaoinshr") for _ in range(6000)), "=" * 5000):
        assert np.frombuffer(t.encode(x), "<i4").tolist() == sp.encode(x)


def test_suffix_automaton():
    rng = random.Random(3)
    seq = [rng.randrange(3) for _ in range(60)]
    s, c, nxt, n = suffix_automaton.build(seq)
    go = {(int(a), int(b)): int(d) for a, b, d in zip(s, c, nxt, strict=True)}

    def accepts(x):
        at = 0
        for v in x:
            at = go.get((at, v), -1)
            if at < 0:
                return False
        return True

    subs = {tuple(seq[i:j]) for i in range(60) for j in range(i, 61)}
    assert n <= 120 and all(accepts(x) for x in subs)
    for _ in range(500):
        x = tuple(rng.randrange(3) for _ in range(rng.randrange(8)))
        assert accepts(x) == (x in subs)


def test_language_id(spark, empty):
    rng = random.Random(4)
    syl = {"aa": ["ba", "du", "ko", "mi"], "bb": ["thr", "ost", "ein", "üg"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syl[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    d = [(k, text("aa" if k % 2 else "bb", 40), "aa" if k % 2 else "bb") for k in range(60)]
    df = spark.createDataFrame([*d, (100, None, "aa"), (101, "", None), (102, "12 ... 3", "bb"), (103, text("aa", 3000), None), (None, text("bb", 9), None)], "doc_id long, text string, lang string")
    m = language_id.fit(df, "lang", "doc_id", "text", train_on=F.coalesce(F.col("doc_id") < 40, F.lit(False)))
    got = {r.doc_id: r for r in language_id.identify(df, m).collect()}
    assert all(got[k].lang_pred == lang and 0 <= got[k].score <= 1 for k, _, lang in d)
    assert [got[k].lang_pred for k in (100, 101, 102, 103, None)] == ["und", "und", "und", "aa", "bb"]
    # ties go to the first language, repeated rows each count, and columns named like the result are ignored
    same = language_id.train({"b": ["abc abc"], "a": ["abc abc"]}, 1000)
    again = spark.createDataFrame([(1, "abc", "x", 9)] * 2, "doc_id long, text string, lang_pred string, score int")
    assert [(r.doc_id, r.lang_pred) for r in language_id.identify(again, same).collect()] == [(1, "a")] * 2
    nothing = language_id.fit(empty, "lang", "doc_id", "text")
    assert language_id.identify(empty, nothing).count() == 0
    assert {r.lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"}


def test_phrases_are_those_of_one_greedy_parse():
    rng = random.Random(14)
    text = lambda n: "".join(rng.choice("abc d") for _ in range(n))
    samples = {"x": [text(300), text(500)], "y": [text(400) + "e"]}
    m = language_id.train(samples, 10_000)
    lut = language_id.lookup(m.letters, m.classes)
    code = lambda t: language_id.encode(t, lut).tobytes()
    seqs = [b"".join(code(t) + b"\x01" for t in samples[x]) for x in m.langs]
    copied = (samples["x"][1] * 4)[: 3 * language_id.SEGMENT]
    texts = [text(n) for n in (1, 20, 511, 512, 513, 1600)] + [copied, "zz" + text(700) + "q", samples["x"][0] + samples["y"][0] * 3]
    want = []
    for t in texts:
        row = []
        for seq in seqs:
            c, at, n = code(t), 0, 1
            now = b""
            while at < len(c):
                if c[at] != 1 and now + c[at : at + 1] in seq:
                    now += c[at : at + 1]
                else:
                    n += 1
                    now = c[at : at + 1] if c[at] != 1 and c[at : at + 1] in seq else b""
                at += 1
            row.append(n)
        want.append(row)
    assert language_id.phrases([language_id.encode(t, lut) for t in texts], m).tolist() == want


def test_models_in_turn_answer_for_themselves(spark):
    texts = spark.createDataFrame([(1, "aba abab ba"), (2, "cdc cdcd dc")], "doc_id long, text string").coalesce(1)
    for k in range(6):
        names = (f"m{k}", f"n{k}")
        m = language_id.train({names[k % 2]: ["aba abab baab abba"], names[1 - k % 2]: ["cdc cdcd dccd cddc"]}, 1000)
        assert {r.doc_id: r.lang_pred for r in language_id.identify(texts, m).collect()} == {1: names[k % 2], 2: names[1 - k % 2]}


def test_rarer_letters_share_codes():
    rng = random.Random(2)
    han = [chr(0x4E00 + k) for k in range(900)]
    vocab = [["".join(rng.choice(han) for _ in range(rng.randrange(2, 4))) for _ in range(150)] for _ in range(2)]
    text = lambda k, n: "".join(rng.choice(vocab[k]) for _ in range(n))
    m = language_id.train({"a": [text(0, 1500)], "b": [text(1, 1500)]}, 10_000)
    assert m.classes and language_id.judge([text(0, 60), text(1, 60)], m)[0] == ["a", "b"]


def test_marginals_are_exact():
    rng = np.random.default_rng(0)
    w = np.exp(rng.normal(size=(2, 2)))
    crf = toxicity.Crf({}, tuple(map(tuple, np.log(w))), 0.3, 0)
    sizes = np.array([1, 5, 300, 129, 128])
    e = np.exp(rng.normal(size=sizes.sum()))
    p = toxicity.marginals(e, sizes, w, toxicity._enter(crf))
    at = 0
    for n in sizes:
        x = e[at : at + n]
        a, b = np.zeros((n, 2)), np.ones((n, 2))
        a[0] = [1, np.exp(0.3) * x[0]]
        for t in range(1, n):
            a[t] = a[t - 1] @ w * [1, x[t]]
            a[t] /= a[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = w @ (b[t + 1] * [1, x[t + 1]])
            b[t] /= b[t].sum()
        q = a * b
        assert np.allclose(q[:, 1] / q.sum(axis=1), p[at : at + n])
        at += n


def test_toxicity(spark, docs, rows, empty):
    rng = random.Random(8)
    d = []
    for k in range(240):
        w = sentence(rng, 40).split()
        if k % 4 == 0:
            w[rng.randrange(40)] = rng.choice(["vileword", "nastyterm"])
            w[rng.randrange(40)] = "grumblesnark"
        d.append((k, " ".join(w), int(k % 4 == 0)))
    df = spark.createDataFrame([*d, (900, None, None), (901, "", None)], "doc_id long, text string, toxic int")
    crf = toxicity.fit(df, df, train_on=F.col("id") < 160)
    got = {r.doc_id: r for r in toxicity.score(df, crf).collect()}
    assert all(got[k].predicted == y for k, _, y in d if k >= 160)
    assert got[900].score == got[901].score == 0 and not got[900].spans
    hit = got[160]
    assert {d[160][1][s.start : s.end] for s in hit.spans} <= {"vileword", "nastyterm", "grumblesnark"} and hit.spans
    assert toxicity.drop_toxic(df, crf).count() == 182
    assert toxicity.drop_toxic(docs, crf).columns == docs.columns
    none = toxicity.fit(empty.select("doc_id", "text").withColumn("toxic", F.lit(1)), empty.select("doc_id").withColumn("toxic", F.lit(1)))
    assert toxicity.score(docs, none).count() == len(rows)


def test_toxicity_of_balanced_and_of_useless_labels(spark):
    rng = random.Random(9)
    d = [(k, sentence(rng, 40) + (" grumblesnark" if k % 2 and k < 30 else " vileword" if k % 2 else ""), k % 2) for k in range(60)]
    df = spark.createDataFrame(d, "doc_id long, text string, toxic int")
    crf = toxicity.fit(df, df)
    assert [r.predicted for r in toxicity.score(df, crf).orderBy("doc_id").collect()] == [y for _, _, y in d]
    # labels that no word explains: nothing is learned and nothing dropped
    e = [(k, sentence(rng, 40), int(k % 5 > 0)) for k in range(40)]
    df = spark.createDataFrame(e, "doc_id long, text string, toxic int")
    crf = toxicity.fit(df, df)
    assert not crf.weights and crf.prior == 0.8
    assert not any(r.predicted for r in toxicity.score(df, crf).collect()) and toxicity.drop_toxic(df, crf).count() == 40


def test_warc(spark):
    long = "x" * 300_000
    d = [(3, "http://a/\n1", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (5, "u", ""), (7, "v", long), (7, "v", long), (8, "w", long), (None, "n", long)]
    pages = spark.createDataFrame(d, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(spark, pages).collect()), key=repr)
    dig = lambda x: warc.payload_digest((x or "").encode())
    first = {}
    for i, _, h in d:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = [(i, len((h or "").encode()), dig(h), *(("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))) for i, _, h in d]
    assert got == sorted(want, key=repr)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0
    # columns named like those of the result
    other = spark.createDataFrame([(1, "u", "<p>", "x", 5)], "page_id long, url string, html string, refers_to string, payload int")
    assert [(r.page_id, r.record_type, r.payload_bytes) for r in warc.round_trip(spark, other).collect()] == [(1, "response", 3)]


def test_warc_keeps_uris_as_they_are():
    out = io.BytesIO()
    for x in ("http://a/x%20y", "x%0Ay", "a%25b", "two\nlines"):
        warc.write_record(out, [("WARC-Type", "response"), ("WARC-Target-URI", x)], b"")
    got = [h["warc-target-uri"] for h, _ in warc.read_records(io.BytesIO(out.getvalue()))]
    assert got == ["http://a/x%20y", "x%0Ay", "a%25b", "two%0Alines"]
    # pages of one id and different payloads are records of their own
    assert warc.record_id(1, "A") != warc.record_id(1, "B")


def test_warc_reader_finds_damage():
    out = io.BytesIO()
    warc.write_record(out, [("WARC-Type", "response"), ("WARC-Block-Digest", "sha1:" + warc.payload_digest(b"abc"))], b"abc")
    n = len(out.getvalue())
    warc.write_record(out, [("WARC-Type", "response")], b"d" * 200_000)
    data = out.getvalue()
    assert [b for _, b in warc.read_records(io.BytesIO(data))] == [b"abc", b"d" * 200_000]
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(data[:-9])))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(data[: n - 1])))
    bad = io.BytesIO()
    warc.write_record(bad, [("WARC-Type", "response"), ("WARC-Block-Digest", "sha1:AAAA")], b"abc")
    with pytest.raises(warc.WarcError, match="digest"):
        list(warc.read_records(io.BytesIO(bad.getvalue())))


def test_hamming_search(spark):
    rng = np.random.default_rng(1)
    codes = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 400)]
    codes += [codes[0]] * 60 + [codes[1] ^ 1, codes[1] ^ 3, codes[1] ^ (1 << 40)]
    rows = list(enumerate(codes))
    df = spark.createDataFrame([*rows, rows[3]], "id long, code long")
    q = df.where("id % 50 = 0")
    got = {}
    for r in hamming_search.top_k(df, q, k=5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.distance, r.id)
    for i, c in rows:
        if i % 50 == 0:
            want = sorted((((c ^ o) & (2**64 - 1)).bit_count(), j) for j, o in rows if j != i)[:5]
            assert [got[i][k] for k in range(1, 6)] == want
    assert hamming_search.top_k(df.limit(0), df.limit(0)).count() == 0
    v = spark.createDataFrame([(1, [0.5, -1.0, None]), (2, None), (None, [1.0])], "vec_id long, embedding array<double>")
    assert [(r.id, r.code) for r in hamming_search.sign_codes(v).collect()] == [(1, 1)]
    wide = spark.createDataFrame([(1, [1.0] * 65)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="more than 64"):
        hamming_search.sign_codes(wide).collect()
    assert sum(w for _, w in hamming_search.segments_for(500)) == 64
    assert len(hamming_search.segments_for(10**9)) == 3 and sum(w for _, w in hamming_search.segments_for(10**9)) == 64


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    text = lambda n: sentence(rng, n, 3000)
    clean = [text(80) for _ in range(30)]
    item = text(25)
    w = clean[0].split()
    w[10] = "changed"
    d = [(k, t) for k, t in enumerate(clean)] + [(50, clean[1]), (51, " ".join(w)), (52, text(20) + " " + item), (60, None), (61, "")]
    toxic = [(200 + k, " ".join([*text(30).split(), "vileword", "grumblesnark"])) for k in range(60)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in d + toxic]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(i, 1, 1) for i, _ in toxic], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == sorted([*range(30), 50, 51, 60, 61])
    # the only lines of 50 and 51 repeat earlier ones, so these documents are empty now
    assert [{r.doc_id: r.n_ids for r in out}[k] for k in (50, 51)] == [0, 0]
    assert all(r.round_trip for r in out if r.n_ids is not None)
    assert hashlib.sha256(b"").hexdigest() == {r.doc_id: r.ids_sha256 for r in out}[61]


def test_workers_give_large_blocks_back_at_once():
    import ctypes

    import psutil
    import pyarrow as pa

    words.claim("test")
    assert pa.default_memory_pool().backend_name == "system"
    libc = ctypes.CDLL("libc.so.6")
    libc.malloc.restype, libc.malloc.argtypes, libc.free.argtypes = ctypes.c_void_p, [ctypes.c_size_t], [ctypes.c_void_p]
    size, rss = 24 << 20, lambda: psutil.Process().memory_info().rss
    libc.free(libc.malloc(size))  # else the next block of this size is not mapped on its own
    before = rss()
    block, small = libc.malloc(size), None
    ctypes.memset(block, 1, size)
    small = libc.malloc(1000)
    libc.free(block)
    assert rss() - before < size // 4
    libc.free(small)
