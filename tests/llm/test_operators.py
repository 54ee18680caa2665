import hashlib
import random
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.llm import bpe, html_text, media, mixing, near_dup, quality_classifier, quality_rules, registry, scratch, substring_dedup, toxicity, url_filter
from skarn.llm.components import connected_components

from . import brute

SF = "/root/testdata/sf0.001"
#: Least share of held-out toxic rows that must be found.
RECALL = 0.9
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]


def passage(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


ODD = [
    (1, " ".join(passage(1, 80)), "en", "a", 1),
    (1, " ".join(passage(1, 80)), "en", "a", 1),
    (2, " ".join(passage(1, 80)) + " more", None, None, None),
    (None, " ".join(passage(1, 80)), "en", "a", 1),
    (None, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, None, "en", "b", 0),
    (5, " \n\t\r ", "de", "b", 3),
    (6, "one two", "de", "b", 7),
    (7, "loop " * 20000, "en", "a", 5),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    rows = spark.createDataFrame(ODD, SCHEMA)
    return rows.withColumns({c: F.lit("own") for c in ("doc", "n_words", "n_removed", "kept", "copies", "place", "rate", "m", "score", "ids", "key", "block", "ranges")})


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(name, same_rows):
    same_rows(registry.QUERIES[name], registry.ORACLES[name])


# near duplicates


def test_near_duplicates_equal_brute_force(spark, documents, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(documents).collect()}
    assert got == brute.near_duplicates(texts)


def edited(n, most, seed=4, words=120):
    """Near copies of one text with up to ``most`` words replaced."""
    rng = random.Random(seed)
    base, rows = passage(9, words), []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(most)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i * 3, " ".join(w)))
    return rows


@pytest.mark.parametrize("most, block", [(6, 16), (12, 16), (3, 8)])
def test_large_group_in_many_blocks(spark, monkeypatch, most, block):
    rows = edited(150, most) + [(i * 3 + 1, " ".join(passage(100 + i, 60))) for i in range(40)]
    monkeypatch.setattr(near_dup, "BLOCK", block)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute.near_duplicates(rows)
    assert got == want and len({v[1] for v in want.values()}) > 40


def test_rows_of_long_lists_grow_in_proportion(spark, monkeypatch):
    """Rows that are compared: a large group of near copies makes a few for each member, however large it is."""
    seen, whole = [], near_dup._work
    count = spark.sparkContext.accumulator(0)

    def counting(compare):
        work = whole(compare)

        def run(table):
            count.add(len(table))
            yield from work(table)

        return run

    monkeypatch.setattr(near_dup, "_work", counting)
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    for n in (200, 800):
        count.value = 0
        assert near_dup.near_duplicates(spark.createDataFrame(edited(n, 3), "doc_id long, text string")).where("kept").count() == 1
        seen.append(count.value / n)
    assert seen[1] < 1.5 * seen[0]


SHARED = [(0, " ".join(passage(61, 30))), (1, " ".join(passage(62, 30))), (1, " ".join(passage(61, 30)) + " tail"), (1, " ".join(passage(62, 30))), (3, " ".join(passage(63, 30))), (4, " ".join(passage(63, 30) + passage(64, 1))),
          (4, " ".join(passage(65, 40))), (5, " ".join(passage(62, 30) + passage(66, 2))), (None, " ".join(passage(65, 40) + passage(67, 1))), (None, " ".join(passage(68, 25))), (None, " ".join(passage(68, 25))), (None, None), (9, "a b")]


@pytest.fixture(scope="module")
def hashes(spark):
    from skarn.llm.identity import text_hash

    found = {r.text or "": r.h for r in spark.createDataFrame(SHARED, "doc_id long, text string").withColumn("h", text_hash()).collect()}
    return found.__getitem__


def test_near_duplicates_with_shared_ids(spark, hashes):
    """Texts of one id are documents of their own: their links and sets are their own."""
    docs = spark.createDataFrame(SHARED, "doc_id long, text string")
    documents, place, ids = brute.by_text(SHARED, hashes)
    want = brute.near_duplicates(documents)
    expected = []
    for p in place:
        n, lead, kept = want[p]
        expected.append((ids[p], n, ids[lead], kept if ids[p] is None else ids[p] == ids[lead]))
    got = [tuple(r) for r in near_dup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    left = sorted(((r.doc_id, r.text) for r in near_dup.keep_first(docs).collect()), key=str)
    assert left == sorted((row for row, p in zip(SHARED, place, strict=True) if want[p][2]), key=str)


@pytest.mark.parametrize("bits", [substring_dedup.SKETCH_BITS, 0])
def test_passages_with_shared_ids(spark, hashes, bits, monkeypatch):
    """A word that occurs once is never removed, whatever other rows bear its id."""
    monkeypatch.setattr(substring_dedup.removed_ranges, "__defaults__", (20, 10, bits))
    docs = spark.createDataFrame(SHARED, "doc_id long, text string")
    documents, place, ids = brute.by_text(SHARED, hashes)
    want = brute.without_repeats(documents)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, digest=True).collect()), key=str)
    assert got == sorted(((ids[p], n, m, hashlib.sha256(" ".join(w).encode()).hexdigest()) for p in place for n, m, w in [want[p]]), key=str)


def test_near_duplicates_of_odd_rows(spark, odd):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(odd).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, 76, 1, True), (1, 76, 1, True), (2, 77, 1, False), (None, 76, 1, False), (None, 0, None, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 7, True)]))
    kept = near_dup.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == 8
    shuffled = near_dup.keep_first(odd, broadcast_bytes=0)
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, kept.collect()))


def test_near_duplicates_of_nothing(spark, odd):
    assert near_dup.near_duplicates(odd.where("1 = 0")).count() == 0


@pytest.mark.parametrize("local, kind", [(True, "long"), (False, "long"), (True, "string"), (True, "many")])
def test_components(spark, local, kind, monkeypatch):
    if kind == "many":
        monkeypatch.setattr("skarn.llm.components.HELD", 8)  # more tasks than one hold the edges
        kind = "long"
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 202), (202, 200)]
    table = spark.createDataFrame(edges, "a long, b long").repartition(3)
    if kind == "string":
        table = table.selectExpr("lpad(a, 5, '0') AS a", "lpad(b, 5, '0') AS b")
    found = connected_components(table, scratch.Scratch(spark, "test"), "c", local).collect()
    assert {int(r.node): int(r.component) for r in found} == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}, **{i: 200 for i in range(200, 203)}}
    assert len(found) == 31 + 40 + 3
    assert not connected_components(table.where("1 = 0"), scratch.Scratch(spark, "test"), "c", local).collect()


# passages


def planted(seed):
    rng = random.Random(seed)
    shared = [passage(50 + i, 60) for i in range(3)]
    rows = []
    for i in range(60):
        w = passage(1000 + i, rng.randrange(0, 120))
        for p in rng.sample(shared, rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[rng.randrange(20) : 60 - rng.randrange(20)]
        rows.append((i, " ".join(w)))
    rows += [(100 + i, rows[i][1]) for i in range(0, 60, 7)] + [(200, "a b " * 40), (201, "b a " * 30)]
    return rows


@pytest.mark.parametrize("bits", [substring_dedup.SKETCH_BITS, 0])
def test_passages_equal_brute_force(spark, bits, monkeypatch):
    monkeypatch.setattr(substring_dedup.removed_ranges, "__defaults__", (20, 10, bits))
    monkeypatch.setattr(substring_dedup, "SHARD_BITS", (6, 8))  # many shards where the sketch is not broadcast
    rows = planted(1)
    want = brute.without_repeats(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for limit in (substring_dedup.BROADCAST_BYTES, 0):
        got = substring_dedup.remove_repeats(df, digest=True, broadcast_bytes=limit).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == {i: (n, m, hashlib.sha256(" ".join(w).encode()).hexdigest()) for i, (n, m, w) in want.items()}
    got = substring_dedup.remove_repeats(df).collect()
    source = dict(rows)
    assert {r.doc_id: r.text for r in got} == {i: (" ".join(w) if m else source[i]) for i, (_, m, w) in want.items()}


def test_a_hot_shard_is_cut(spark, monkeypatch):
    """A passage that all documents share: its minimisers are looked up by many tasks, with the same results."""
    monkeypatch.setattr(substring_dedup.removed_ranges, "__defaults__", (20, 10, 0))
    monkeypatch.setattr(substring_dedup, "SHARD_BITS", (6, 8))
    monkeypatch.setattr(substring_dedup, "PLACES", 50)
    shared = " ".join(passage(7, 40))
    rows = [(i, f"{' '.join(passage(100 + i, 5))} {shared} {' '.join(passage(900 + i, 25))}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substring_dedup.remove_repeats(df, digest=True).collect()
    want = brute.without_repeats(rows)
    assert {r.doc_id: (r.n_words, r.n_removed) for r in got} == {i: (n, m) for i, (n, m, _) in want.items()}
    # one minimiser in every document: its places go to as many parts as there are
    shape, parts = substring_dedup.Shape(2, 6), spark.sparkContext.broadcast(np.full(4, 12, np.int32))
    batch = df.withColumns({substring_dedup.DOC: F.col("doc_id"), substring_dedup.SUB: F.lit(0).cast("long")}).drop("doc_id").coalesce(1)
    placed = batch.mapInArrow(substring_dedup._places(20, 10, shape, parts), substring_dedup.PLACE_SCHEMA)
    hot = placed.groupBy("hash").count().orderBy(F.desc("count")).first()
    sizes = [r["count"] for r in placed.where(F.col("hash") == hot.hash).groupBy("shard", "part").count().collect()]
    assert hot["count"] == 600 and len(sizes) == 12 and max(sizes) < 100


def test_passages_of_odd_rows(spark, odd):
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(odd).collect()), key=str)
    assert got == sorted([(1, 80, 0), (1, 80, 0), (2, 81, 80), (None, 80, 80), (None, 0, 0), (3, 0, 0), (4, 0, 0), (5, 0, 0), (6, 2, 0), (7, 20000, 19999)], key=str)
    assert substring_dedup.remove_repeats(odd.where("1 = 0"), digest=True).count() == 0


# byte-level BPE


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    codec = bpe.Codec(bpe.read_ranks(path), P.PATTERN)
    return path, P.PATTERN, codec, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.rank, special_tokens={})


def test_bpe_equals_tiktoken(tokenizers):
    _, _, codec, library = tokenizers
    rng = random.Random(0)
    alphabets = ["ab", "abc ", "aaaaab", "éèñ日本語", "thereading ing", "0123456789", "{}()[];\n\t ", "ßüöä'", "😀👍🏽a"]
    for _ in range(3000):
        a = rng.choice(alphabets)
        text = "".join(rng.choice(a) for _ in range(rng.choice([3, 20, 200])))
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert codec.decode(ids).decode() == text
    long = "a" * 30000 + "=-" * 10000
    assert np.frombuffer(codec.encode(long), "<u4").tolist() == library.encode_ordinary(long)


def test_bpe_query_equals_tiktoken(spark, documents, texts, tokenizers):
    *_, library = tokenizers
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in registry.op9_byte_bpe(spark, SF).collect()}
    for i, text in texts:
        ids = library.encode_ordinary(text)
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_of_odd_rows(spark, odd, tokenizers):
    path, pattern, *_ = tokenizers
    rows = bpe.encode(odd, path, pattern, decode=True).collect()
    assert sorted(len(r.decoded) for r in rows) == sorted(len((t or "").encode()) for _, t, *_ in ODD)
    assert bpe.encode(odd.where("1 = 0"), path, pattern).count() == 0


# media


def test_media_round_trip(spark, documents, texts):
    got = {r.doc_id: r for r in media.round_trip(documents).collect()}
    for i, text in texts:
        raw = text.encode()
        padded = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media.to_png(raw)), hashlib.sha256(media.to_png(raw)).hexdigest())


def test_media_of_odd_rows(spark, odd):
    rows = media.round_trip(odd).collect()
    assert sorted(str((r.doc_id, r.n_bytes)) for r in rows) == sorted(str((i, len((t or "").encode()))) for i, t, *_ in ODD)
    assert media.round_trip(odd.where("1 = 0")).count() == 0


def test_archives_are_plain_zip_and_ranges_cover_them(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * (i + 1)) for i in range(50)], "doc_id long, text string").coalesce(1)
    manifest = media.store(docs, f"file://{tmp_path}/a").collect()
    with zipfile.ZipFile(manifest[0].archive.removeprefix("file://")) as z:
        assert z.testzip() is None and len(z.namelist()) == manifest[0].members == 50
        assert media.from_png(z.read("7.png"))[0].rstrip() == b" ".join([b"text 7"] * 8)
    spark.dataSource.register(media.MediaSource)
    read = spark.read.format("skarn_media").option("path", f"file://{tmp_path}/a").option("range_bytes", 500).option("batch_bytes", 100).load()
    assert read.rdd.getNumPartitions() > 5
    assert sorted(r.name for r in read.collect()) == sorted(f"{i}.png" for i in range(50))


def test_a_broken_member_fails_alone(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * 500 + str(i)) for i in range(5)], "doc_id long, text string").coalesce(1)
    path = media.store(docs, f"file://{tmp_path}/b").collect()[0].archive.removeprefix("file://")
    with zipfile.ZipFile(path) as z:
        at = z.getinfo("2.png").header_offset
    with open(path, "r+b") as f:
        f.seek(at + 100)
        f.write(b"\xff\xff\xff\xff")
    spark.dataSource.register(media.MediaSource)
    rows = spark.read.format("skarn_media").option("path", f"file://{tmp_path}/b").load().collect()
    assert [r.name for r in rows if r.error] == ["2.png"] and len(rows) == 5
    assert media.describe(spark.createDataFrame(rows, "archive string, position long, name string, media binary, error string")).where("error IS NULL").count() == 4


def test_a_member_is_tried_again(tmp_path):
    archive = media._Archive(f"file://{tmp_path}/c")
    archive.add(b"1.png", b"data")
    path, *_ = archive.close()
    reader = media.MediaReader({"path": f"file://{tmp_path}/c"})

    class Flaky:
        closed = False

        def read_at(self, *_):
            raise OSError("lost")

        def close(self):
            Flaky.closed = True

    file = media._File(path)
    file.handle = Flaky()
    assert reader._member(file, 0, 4, zlib.crc32(b"data")) == (b"data", None) and Flaky.closed


def test_a_lost_member_fails_whatever_is_read(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * 500 + str(i)) for i in range(5)], "doc_id long, text string").coalesce(1)
    store = media.store

    def broken(rows, folder):
        manifest = spark.createDataFrame(store(rows, folder).collect())
        path = manifest.first().archive.removeprefix("file://").removeprefix("file:")
        with zipfile.ZipFile(path) as z:
            at = z.getinfo("0.png").header_offset
        with open(path, "r+b") as f:
            f.seek(at + 60)
            f.write(b"\xff\xff\xff\xff")
        return manifest

    monkeypatch.setattr(media, "store", broken)
    for columns in (["doc_id"], ["feature"], ["n_bytes"]):
        with pytest.raises(Exception, match="member 0.png"):
            media.round_trip(docs).select(*columns).collect()


def test_neighbouring_ranges_share_partitions(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * (i + 1)) for i in range(50)], "doc_id long, text string").coalesce(1)
    manifest = media.store(docs, f"file://{tmp_path}/d")
    manifest.write.parquet(f"{tmp_path}/m")
    reader = media.MediaReader({"manifest": f"file://{tmp_path}/m", "range_bytes": "500", "partitions": "3"})
    parts = reader.partitions()
    assert len(parts) == 3 and sum(len(p.ranges) for p in parts) > 5
    names = [n for p in parts for batch in reader.read(p) for n in batch.column("name").to_pylist()]
    assert sorted(names) == sorted(f"{i}.png" for i in range(50))


def plain_feature(samples):
    """Block means of the image, one by one."""
    rows = [samples[i : i + 192] for i in range(0, len(samples), 192)]
    cut = [k * len(rows) // 8 for k in range(9)]
    means = []
    for k in range(8):
        band = rows[cut[k] : cut[k + 1]] or rows[cut[k] : cut[k] + 1]
        means += [sum(sum(r[24 * c : 24 * c + 24]) for r in band) / (24 * len(band)) for c in range(8)]
    middle = sum(means) / 64
    bits = "".join("1" if m - middle > 1e-9 else "0" for m in means)
    return f"{int(bits, 2):016x}"


def test_features_equal_plain_ones(spark, documents, texts):
    got = {r.doc_id: r.feature for r in media.round_trip(documents).collect()}
    for i, text in texts:
        raw = text.encode()
        assert got[i] == plain_feature(raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")), i


# quality rules


def test_cascade_order_never_changes_a_verdict(spark, documents):
    rows = {r.doc_id: r.kept for r in quality_rules.cascade(documents).collect()}
    backward = quality_rules.features(documents).withColumn("kept", quality_rules.verdict(quality_rules.RULES[::-1]).isNull())
    assert {r.doc_id: r.kept for r in backward.collect()} == rows
    assert {r.doc_id for r in quality_rules.keep_good(documents).collect()} == {i for i, k in rows.items() if k}


def test_rules_are_native_and_planned_by_gain(spark, documents):
    order = quality_rules.plan(documents)
    assert {e.rule for e in order} == set(quality_rules.RULES) and sum(e.rejected > 0 for e in order) > 1
    assert order == quality_rules.plan(documents.repartition(5))
    for frame in (quality_rules.cascade(documents), quality_rules.keep_good(documents)):
        text = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "Arrow" not in text and "Exchange" not in text


def test_cascade_stops_at_the_first_rule_that_rejects(spark):
    """What a rejected row would compute next fails, so it is not computed."""
    docs = spark.createDataFrame([(1, "few words"), (2, "many " + "good words here " * 9)], "doc_id long, text string")
    broken = quality_rules.Rule("broken", "n_capitals > 0", ("n_capitals",))
    few = quality_rules.BASE[0]
    frame = docs.withColumn("v", quality_rules.verdict([few, broken]))
    assert dict(frame.select("doc_id", "v").collect()) == {1: "too_few_words", 2: None}
    old = quality_rules.MEASURES["n_capitals"]
    try:
        quality_rules.MEASURES["n_capitals"] = "cast(raise_error('computed') AS bigint)"
        first = docs.where("doc_id = 1").withColumn("v", quality_rules.verdict([few, broken]))
        assert first.first().v == "too_few_words"
        with pytest.raises(Exception, match="computed"):
            docs.withColumn("v", quality_rules.verdict([few, broken])).collect()
    finally:
        quality_rules.MEASURES["n_capitals"] = old


def test_cascade_of_odd_rows(spark, odd):
    rows = quality_rules.cascade(odd).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_repeat_words, r.kept)) for r in rows) == sorted(map(str, [(1, 80, 0, True), (1, 80, 0, True), (2, 81, 0, True), (None, 80, 0, True), (None, 0, 0, False), (3, 0, 0, False), (4, 0, 0, False), (5, 0, 0, False), (6, 2, 0, False), (7, 20000, 20000, False)]))
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == 4
    assert quality_rules.cascade(odd.where("1 = 0")).count() == 0
    for made in (quality_rules.features(odd), quality_rules.cascade(odd), quality_rules.keep_good(odd)):
        assert {r.m for r in made.collect()} == {"own"} and {"score", "block", "doc"} <= set(made.columns)


# mixing


def test_mixing_meets_its_weights(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, "rare").otherwise("rest").alias("source"))
    weights = {"hot": 0.2, "rare": 0.3}
    out = mixing.mix(docs, weights).groupBy("source").count().collect()
    share = {r.source: r["count"] / 20000 for r in out}
    assert share == pytest.approx({"hot": 0.2, "rare": 0.3, "rest": 0.5}, rel=0.08)
    a, b = (sorted(map(tuple, mixing.mix(docs.repartition(n), weights, broadcast_sources=limit).collect())) for n, limit in ((2, 10), (7, 0)))
    assert a == b


def test_mixing_counts_are_poisson(spark):
    docs = spark.range(30000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source"))
    for total, parts in ((45000, 1), (30000 * 50, 2)):
        table = mixing.rates(docs, {"s": 1.0}, total).first()
        assert table.parts == parts
        if parts == 1:
            n = dict(mixing.mix(docs, {"s": 1.0}, total).where("copy = 0").groupBy("copies").count().collect())
            want = [30000 * np.exp(-1.5) * 1.5**k / f for k, f in ((1, 1), (2, 2), (3, 6), (4, 24))]
            assert [n[k] for k in (1, 2, 3, 4)] == pytest.approx(want, rel=0.1)
    few = docs.where("doc_id < 400")
    assert mixing.mix(few, {"s": 1.0}, 400 * 50).count() == pytest.approx(400 * 50, rel=0.03)


def test_mixing_shuffles_and_checks_weights(spark, odd):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source"))
    ids = [r.doc_id for r in mixing.mix(docs, {}).collect()]
    hot = mixing.mix(docs.withColumn("doc_id", F.lit(1)), {}, 4000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = hot.groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and max(r["count"] for r in parts) < 0.6 * sum(r["count"] for r in parts)
    assert ids != sorted(ids) and len(ids) == pytest.approx(1000, rel=0.15)
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s": 1.5})
    many = mixing.mix(odd, {"a": 0.5, "gone": 0.2}, 2000)
    n = {k: v["count"] for k, v in ((r.source, r) for r in many.groupBy("source").count().collect())}
    assert sum(n.values()) == pytest.approx(2000, rel=0.2) and set(n) == {"a", "b", None} and n["a"] == pytest.approx(1000, rel=0.2)
    assert many.columns == [*odd.drop("copies", "place").columns, "copies", "copy", "place"] and many.where("rate = 'own' AND score = 'own'").count() == sum(n.values())
    assert len({r.copies for r in many.where("doc_id = 1").collect()}) == 1
    assert mixing.mix(odd.where("1 = 0"), {"a": 0.5}).count() == 0


# URL filter


def test_url_aliases(spark):
    link, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    rows = [
        (1, "http://a.com/x", link.format("https://b.net/y")), (2, "https://b.net/y#t", ""), (3, "http://c.com/", refresh.format("http://a.com/x?")), (3, "http://c.com/", refresh.format("http://a.com/x?")),
        (4, "http://example.net/en/1", link.format("http://a.com/x")), (5, None, None), (6, "nope", "x"), (None, "http://d.com/q?a=1", link.format("/z")), (8, "http://d.com/z", None),
        (9, "HTTP://X.ORG/fr/", ""), (10, "http://e.com/1", None), (11, "http://example.com/de/p", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("own"))
    redirects = spark.createDataFrame([("http://e.com/1", "http://e.com/2"), ("http://e.com/2", "http://example.com/de/p")], "source string, target string")
    got = {(r.page_id, r.rule, r.verdict) for r in url_filter.judge(pages, redirects=redirects).collect()}
    assert got == {(1, None, "block"), (2, "net/", "block"), (3, None, "block"), (4, "example.net/en/", "allow"), (5, None, "allow"), (6, None, "allow"), (None, None, "allow"), (8, None, "allow"), (9, "org/fr/", "allow"), (10, None, "block"), (11, "example.com/de/", "block")}
    assert url_filter.judge(pages.where("1 = 0")).count() == 0


def test_links_are_resolved(spark):
    """Targets equal urljoin's, for every link of a page."""
    from urllib.parse import urljoin, urlsplit

    links = ["y.html", "../de/x", "?p=2", "/go?u=http://x", "./", ".", "..", "../../../z", "/a/./b/../c", "//h.net/q", "a/b?x=../y", "http://t.com/u#f", "HTTPS://T.com/u?v", "#top", "//h.net", "d/.", "a..b/.c", "x?a=1&amp;b=2"]
    key = lambda u: "://" + urlsplit(u).netloc.lower() + urlsplit(u).path + ("?" + urlsplit(u).query if urlsplit(u).query else "")
    for url in ("https://a.org/en/x", "https://a.org/en/k/x?q=1", "https://a.org"):
        body = "".join(f'<link rel="canonical" href="{h}">' for h in links) + "<link rel=canonical href=mailto:a><meta http-equiv=refresh content='0; url=r1'><meta http-equiv=refresh content='0; url=r2'>"
        got = {(r.a, r.b) for r in url_filter.page_edges(spark.createDataFrame([(url, body)], "url string, html string")).collect()}
        joined = {key(urljoin(url, h.replace("&amp;", "&"))) for h in [*links, "r1", "r2"]}
        assert got == {(key(url), b) for b in joined - {key(url)}}
    pages = spark.createDataFrame([(1, "https://a.org/en/x", '<link rel="canonical" href="y.html">'), (2, "https://b.net/", '<link rel="canonical" href="https://c.org/"><link rel="canonical" href="https://a.org/en/y.html">')], "page_id long, url string, html string")
    assert {(r.page_id, r.verdict) for r in url_filter.judge(pages).collect()} == {(1, "block"), (2, "block")}


def test_links_that_do_not_count(spark):
    """Commented links and scripts are no links; rel may hold several words; other attributes than rel and href are not read."""
    link = "<link {} href='http://b.net/{}'>"
    bodies = {
        1: "<!-- " + link.format("rel=canonical", 1) + " -->", 2: "<script>var x = \"" + link.format("rel=canonical", 2) + "\"</script>", 3: link.format("rel='alternate canonical'", 3), 4: link.format('rel="canonical nofollow"', 4),
        5: link.format("rel=canonical2", 5), 6: link.format("data-rel=canonical", 6), 7: "<!-- x --><link data-href='http://no.net/' href='http://b.net/7' rel=canonical>", 8: link.format("rel=canonical", 8) * 2,
    }
    pages = spark.createDataFrame([(i, f"http://p.com/{i}", b) for i, b in bodies.items()], "page_id long, url string, html string")
    assert {(r.page_id, r.verdict) for r in url_filter.judge(pages).collect()} == {(i, "block" if i in (3, 4, 7, 8) else "allow") for i in bodies}


def test_rules_in_a_table(spark):
    """Many rules are joined, with the results of one expression."""
    rng = random.Random(3)
    hosts = [".".join(rng.choice("ab") for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    rules = {f"{h}/{''.join(rng.choice('xy/') for _ in range(rng.randrange(4)))}": rng.choice(["allow", "block"]) for h in hosts for _ in range(3)}
    rows = [(i, f"http://{rng.choice(hosts)}/{''.join(rng.choice('xy/') for _ in range(rng.randrange(6)))}", None) for i in range(300)] + [(1000, None, None), (1001, "http://a.b", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = spark.createDataFrame([(rows[i][1], rows[i + 1][1]) for i in range(0, 290, 7)], "source string, target string")
    one, other = (sorted(map(tuple, url_filter.judge(pages, rules, edges, n).collect())) for n in (10**6, 0))
    assert one == other and {r[-1] for r in one} == {"allow", "block"} and len({r[4] for r in one}) > 20


def test_longest_rule_and_subdomains(spark):
    rows = [("http://net/",), ("http://xnet/",), ("http://a.net",), ("http://m.example.net/en/q?x#y",), ("ftp://Example.Com/de/",), ("http://example.com/den",), ("http://a.example.net/EN/",)]
    pages = spark.createDataFrame(rows, "url string").withColumn("page_id", F.lit(1)).withColumn("html", F.lit(None).cast("string"))
    assert [(r.rule) for r in url_filter.judge(pages).collect()] == ["net/", None, None, "example.net/en/", "example.com/de/", None, "net/"]


# classifiers


@pytest.fixture(scope="module")
def labelled(spark):
    sf = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_quality_on_held_out_rows(labelled):
    docs, labels = labelled
    rows = quality_classifier.classify(docs, labels).join(labels, "doc_id").where("held_out").select("quality", "predicted").collect()
    assert sum(r.quality == r.predicted for r in rows) / len(rows) > 0.93


def test_quality_equals_a_plain_version(labelled):
    """Features word by word, gradients document by document: the same scores."""
    Q = quality_classifier
    docs, labels = labelled
    own = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    few = [i for c in (0, 1) for i in sorted((i for i in own if own[i] == c), key=lambda i: (len(texts[i]), i))[:25]]  # short ones
    model = Q.fit(docs.where(F.col("doc_id").isin(few)), labels.where(F.col("doc_id").isin(few)))
    found = {i: brute.quality_features(texts[i], Q.BITS, Q.GRAMS, [int(x) for x in Q._SPREAD], Q.AGAIN) for i in few}
    blob = lambda f: (np.array(sorted(f), np.int32).tobytes(), np.array([f[k] for k in sorted(f)], np.float32).tobytes())
    order = sorted(few, key=lambda i: (own[i], *blob(found[i])))
    rng = np.random.default_rng(Q.SEED)
    vectors, output, bias = rng.normal(0, 0.1, (Q.BUCKETS, Q.SIZE)), np.zeros((Q.SIZE, 2)), np.zeros(2)
    seen = [np.full(x.shape, 1e-8) for x in (vectors, output, bias)]
    many = [sum(own[i] == c for i in few) for c in (0, 1)]
    for _ in range(max(Q.EPOCHS, -(-Q.STEPS * Q.BATCH // len(few)))):
        turn = rng.permutation(len(few))
        for lo in range(0, len(turn), Q.BATCH):
            slopes = [np.zeros_like(x) for x in (vectors, output, bias)]
            size = len(turn[lo : lo + Q.BATCH])
            for p in turn[lo : lo + Q.BATCH]:
                i = order[p]
                total = sum(found[i].values())
                mean = sum(n / total * vectors[b] for b, n in found[i].items())
                z = mean @ output + bias
                e = np.exp(z - z.max())
                e = (e / e.sum() - np.eye(2)[own[i]]) * len(few) / (2 * many[own[i]]) / size
                slopes[1] += np.outer(mean, e)
                slopes[2] += e
                for b, n in found[i].items():
                    slopes[0][b] += n / total * (output @ e)
            for value, total, slope in zip((vectors, output, bias), seen, slopes, strict=True):
                total += slope * slope
                value -= Q.RATE * slope / np.sqrt(total + 1e-2)
    got = {r.doc_id: r.score for r in Q.score(docs, model).collect()}
    for i in sorted(texts, key=lambda i: (len(texts[i]), i))[:150]:
        f = brute.quality_features(texts[i], Q.BITS, Q.GRAMS, [int(x) for x in Q._SPREAD], Q.AGAIN)
        z = sum(n * (vectors[b] @ (output[:, 1] - output[:, 0])) for b, n in f.items()) / max(sum(f.values()), 1) + bias[1] - bias[0]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


@pytest.fixture(scope="module")
def toxic_truth(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    return docs.join(labels, "doc_id").select(*docs.columns), labels


def test_toxicity_on_held_out_rows(toxic_truth):
    docs, labels = toxic_truth
    rows = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    assert sum(r.predicted for r in rows if not r.toxic) / sum(not r.toxic for r in rows) < 0.01
    assert sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows) >= RECALL


def test_toxicity_equals_a_plain_version(labelled):
    """The chain with dense matrices over plainly made features: the same scores."""
    X = toxicity
    docs, labels = labelled
    own = {r.doc_id: float(r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    ids = [r.doc_id for r in X.sample(docs, labels, "toxic", X.PER_CLASS).collect()]
    ids.sort(key=lambda i: i * 2654435761 % (1 << 32))
    sets = {i: brute.toxic_features(t, X.BITS, X.BEGINNINGS) for i, t in texts.items()}
    y = np.array([own[i] for i in ids])

    def ratios(part, label):
        count = {}
        for k, i in enumerate(part):
            for b in sets[i]:
                n, h = count.get(b, (0, 0.0))
                count[b] = (n + 1, h + label[k])
        pos, n_all = max(label.sum(), 1.0), len(part)
        r = {b: np.log((h + 0.5) / (pos + 1)) - np.log((n - h + 0.5) / (n_all - label.sum() + 1)) for b, (n, h) in count.items() if n >= X.LEAST_TEXTS}
        return {b: v for b, v in r.items() if abs(v) >= X.LEAST_RATIO}

    def link(part, label, earlier):
        scale = ratios(part, label)
        names = sorted(scale)
        m = np.array([[scale[b] if b in sets[i] else 0.0 for b in names] for i in part]).reshape(len(part), len(names))
        w, c, bias = np.zeros(len(names)), np.zeros(earlier.shape[1]), np.log(max(label.sum(), 1.0) / max(len(part) - label.sum(), 1))
        moment = [np.zeros_like(w), np.zeros_like(c), 0.0]
        for _ in range(X.STEPS):
            error = (1 / (1 + np.exp(-np.clip(m @ w + earlier @ c + bias, -30, 30))) - label) / len(part)
            moment = [0.9 * a + b for a, b in zip(moment, (m.T @ error + X.DECAY * w, earlier.T @ error + X.DECAY * c, error.sum()), strict=True)]
            w, c, bias = w - 0.5 * moment[0], c - 0.05 * moment[1], bias - 0.5 * moment[2]
        weight = {b: v * scale[b] for b, v in zip(names, w, strict=True)}
        return lambda part, earlier: np.array([sum(weight.get(b, 0.0) for b in sets[i]) for i in part]) + earlier @ c + bias

    clear = {b for b, v in ratios(ids, y).items() if v > 0}
    toxic = [i for i, t in zip(ids, y, strict=True) if t]
    first = max(sorted(clear), key=lambda b: sum(b in sets[i] for i in toxic))
    second = max(sorted(clear), key=lambda b: sum(b in sets[i] and first not in sets[i] for i in toxic))
    with_second = lambda b: b == second or sum(b in sets[i] and second in sets[i] for i in toxic) > sum(b in sets[i] and first in sets[i] for i in toxic)
    groups = [{b for b in clear if with_second(b) == late} for late in (False, True)]
    targets = [np.array([t * bool(sets[i] & g) for i, t in zip(ids, y, strict=True)]) for g in groups] + [y]
    chain, outside, fold = [], np.zeros((len(ids), 0)), np.arange(len(ids)) % X.FOLDS
    for target in targets:
        chain.append(link(ids, target, outside))
        odds = np.zeros(len(ids))
        for f in range(X.FOLDS):
            learn, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            odds[test] = link([ids[k] for k in learn], target[learn], outside[learn])([ids[k] for k in test], outside[test])
        outside = np.column_stack([outside, np.clip(odds, -10, 10)])
    shown = sorted(texts)[:300]
    earlier = np.zeros((len(shown), 0))
    for one in chain:
        earlier = np.column_stack([earlier, np.clip(one(shown, earlier), -10, 10)])
    got = {r.doc_id: r.score for r in X.score(docs, labels).collect()}
    assert [got[i] for i in shown] == pytest.approx((1 / (1 + np.exp(-earlier[:, -1]))).tolist(), abs=1e-5)


def test_toxicity_chain_learns_from_a_large_sample():
    rng = np.random.default_rng(0)
    n, words = 3000, 400
    toxic = rng.random(n) < 0.15
    sets = [np.unique(np.concatenate([rng.integers(100, words, 60), rng.integers(0, 10, 3) if t else []])).astype(int) for t in toxic]
    row, bucket = np.repeat(np.arange(n), [len(s) for s in sets]), np.concatenate(sets)
    part = np.array([any(s[:3] < 5) for s in sets]) & toxic
    chain = toxicity.train(row, bucket, np.column_stack([part, toxic]).astype(float))
    found = toxicity.chained(chain, row, bucket, n)
    assert found.shape == (n, 2) and ((found[:, 1] > 0.5) == toxic).mean() > 0.99
    assert len(chain[1].coupling) == 1


def test_labels_never_come_from_held_out_rows(spark, labelled):
    docs, labels = labelled
    from skarn.llm.labelled import held_out, sample

    assert sample(docs, labels, "quality", 1000).where(held_out(F.col("doc_id"))).count() == 0
    ids = [r.doc_id for r in sample(docs, labels, "quality", 5).collect()]
    assert len(ids) == 10 and all(zlib.crc32(str(i).encode()) % 5 for i in ids)


def test_trained_classifiers_of_odd_rows(spark, odd, documents):
    """Models that were trained score null, empty, blank, very long, id-less and repeated rows."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clash = [c for c in odd.columns if c not in documents.columns]
    both = documents.unionByName(odd.select((F.col("doc_id") + 10**9).alias("doc_id"), *[c for c in odd.columns if c != "doc_id"]), allowMissingColumns=True)
    assert clash and set(clash) <= set(both.columns)
    for score in (quality_classifier.classify, toxicity.score):
        every = score(both, labels).collect()
        assert len({r.score for r in every}) > 10
        rows = [r for r in every if r.doc_id is None or r.doc_id >= 10**9]
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 10**9 + 1}) == 1
        empty = {r.score for r in rows if r.doc_id in (10**9 + 3, 10**9 + 4, 10**9 + 5)}
        assert len(empty) == 1


def test_classifiers_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    for rows in (odd, odd.where("1 = 0")):
        assert quality_classifier.classify(rows, labels).where("score = 0.5").count() == rows.count()
        assert toxicity.score(rows, labels).where("predicted = 0").count() == rows.count()


# HTML


def page(body, nav="<nav><ul><li><a href='/a'>Home</a></ul></nav>"):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{nav}{body}<footer>&copy; x</footer></body></html>"


def test_html_text():
    text = lambda h: html_text.text_of(html_text.parse(h))
    assert text(page("<!-- c --><div class='ad'>Buy</div><article><h1>A &amp; B</h1><p>one<br>two \n three<p><b>x<p>y</article>")) == "A & B\n\none two three\n\nx\n\ny"
    assert text(page("<article><header><h1>T</h1></header><p>p</p><div id=comments><p>no</p></div><form>f</form></article><aside>s</aside>")) == "T\n\np"
    assert text("<div class='cookie-notice'>c</div><div><p>1 &lt;b&gt; 2<ul><li>a<li>b</ul></div><p>4 < 5 &amp; <scr") == "1 <b> 2\n\na\n\nb\n\n4 < 5 &"
    assert text("") == text("<script>x") == text("<!-- open") == ""
    assert text("<p>" * 3000 + "deep" + "<div>" * 3000 + "er") == "deep\n\ner"


def test_names_never_take_the_article():
    text = lambda h: html_text.text_of(html_text.parse(h))
    story = "<article><header><h1>T</h1></header><p>p</p></article>"
    for around in ("<body class='has-sidebar'>{}", "<body class=menu>{}", "<div class='content-with-sidebar'>{}</div>", "<div id='page-no-comments'>{}</div>", "<div class='menu-open'>{}</div>", "<div class=widget><div id=promo>{}</div></div>"):
        assert text(around.format(story)) == "T\n\np", around
        assert text(around.format("<p>q")) == ("" if "promo" in around else "q"), around
    assert text("<div class=banner><main class=modal><p>p</main></div><article>a</article>") == "p\n\na"
    related = "<div class='related-posts'><article>other</article></div><div class='x ad-slot-3'>buy</div>"
    assert text(story + related) == "T\n\np"
    assert text("<div>own</div>" + related) == "own\n\nother"
    assert text("<div>own</div><article class=comment>c</article><aside><div class=ad><article>d</article></div></aside>") == "own"
    assert text("<div class=ad>" * 3000 + story) == "T\n\np"


def test_names_are_matched_whole():
    text = lambda h: html_text.text_of(html_text.parse(h))
    assert text("<article class='post share-price'><p>Shares</p><div class='related-work'><p>Work</p></div><div class='comment-free'><p>Free</p></div></article>") == "Shares\n\nWork\n\nFree"


def test_site_templates(spark):
    """A box without a telling name goes where it recurs, on both paths; a lone page's text and main content stay."""
    box = "<div class=zz><p>Call us</p></div>"
    rows = [(i, f"http://s.com/{i}", page(f"{box}<div><p>story {i}</p></div>")) for i in range(20)] + [(99, "http://t.com/", page(f"{box}<div><p>other</p></div>")), (98, "http://s.com/m", page(f"<main>{box}<p>kept</p></main>")), (None, None, None)]
    rows += rows[:1]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own"))
    want = {i: f"story {i}" for i in range(20)} | {99: "Call us\n\nother", 98: "Call us\n\nkept", None: ""}
    for limit in (html_text.BROADCAST_ROWS, -1):
        got = html_text.extract(pages, broadcast_rows=limit).collect()
        assert {r.page_id: r.text for r in got} == want and len(got) == len(rows)
        assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(pages.where("1 = 0")).count() == 0


def test_templates_of_a_large_host(spark):
    """A menu of one section goes on a large host as on a small one."""
    menu = "<div class=zz><p>Section</p></div>"
    rows = [(i, f"http://s.com/{i}", page(f"{menu if i < 12 else ''}<div><p>story {i}</p></div>")) for i in range(300)]
    rows += [(i, f"http://t.com/{i}", page(f"{menu if i < 309 else ''}<div><p>story {i}</p></div>")) for i in range(300, 320)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (html_text.BROADCAST_ROWS, -1):
        want = {i: f"Section\n\nstory {i}" if 300 <= i < 309 else f"story {i}" for i in range(320)}
        assert {r.page_id: r.text for r in html_text.extract(pages, broadcast_rows=limit).collect()} == want


def test_boxes_in_main_content(spark):
    """A box that recurs within articles goes on both paths; plain paragraphs, headings, words and copies of an article stay."""
    inner = "<h2 class=t>Summary</h2><p>As we said.</p>{}<div class=entry><p>By <a class=who href=/ann>Ann</a></p><p>story {}</p></div>"
    box, row = "<div class=zz><p>Join <b>us</b></p></div>", "<ul><li>Tweet</li></ul>"
    rows = [(i, f"http://s.com/{i}", page(f"<article id=n{i}>{inner.format(box + row, i)}</article>")) for i in range(20)]
    rows += [(i, f"http://s.com/{i}", page(f"<article id=n{i}>{inner.format('', 'again')}</article>")) for i in range(20, 40)]
    rows += [(50, "http://t.com/", page(f"<article>{inner.format(box, 50)}</article>")), (51, "http://s.com/p", page(f"<div>{box}<p>own</p></div>"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = "Summary\n\nAs we said.\n\n{}By Ann\n\nstory {}"
    want = {i: text.format("", i if i < 20 else "again") for i in range(40)} | {50: text.format("Join us\n\n", 50), 51: "Join us\n\nown"}
    for limit in (html_text.BROADCAST_ROWS, -1):
        assert {r.page_id: r.text for r in html_text.extract(pages, broadcast_rows=limit).collect()} == want


def test_boxes_of_the_table(spark):
    """Boxes that recur on ten pages of a host or more go from the table's own articles; without templates all of them stay."""
    from collections import Counter

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    host = lambda url: url.partition("://")[2].partition("/")[0].lower()
    own = {r.page_id: (host(r.url), r.text) for r in registry.op8_html_text(spark, SF).collect()}
    times = Counter((h, variant) for h, variant, _ in {(h, min(i % 7, 1), text) for i, (h, text) in own.items() if i % 4})  # an article that is printed twice counts once
    least = max(times.values())
    box = lambda i, n: f"\n\nOffer {min(i % 7, 1)}\n\nSee more" if i % 4 and times[own[i][0], min(i % 7, 1)] < n else ""
    for n in (least, html_text.LEAST_PAGES, 10**9):
        got = {r.page_id: r.text for r in html_text.extract(registry.boxed(pages), least_pages=n).collect()}
        assert got == {i: text + box(i, n) for i, (_, text) in own.items()}
    assert 0 < sum(bool(box(i, least)) for i in own) < sum(bool(box(i, 10**9)) for i in own)
    assert {r.page_id for r in registry.html_text_boxes(spark, SF).collect()} == set(own)


def test_very_long_urls_and_pages(spark):
    long = "http://h.net/" + "a/" * 200_000
    rows = [(1, long, "<p>" + "word " * 400_000), (2, "http://" + "s." * 20_000 + "org/fr/x", "<article>" + "<p>é</p>" * 50_000), (3, "x" * 300_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: (r.rule, r.verdict, len(r.path)) for r in url_filter.judge(pages).collect()} == {1: ("net/", "block", 400_001), 2: ("org/fr/", "allow", 5), 3: (None, "allow", 0)}
    got = {r.page_id: (r.n_chars, len(r.text)) for r in html_text.extract(pages).collect()}
    assert got == {1: (1_999_999, 1_999_999), 2: (149_998, 149_998), 3: (0, 0)}


def test_html_of_the_table(spark):
    import html
    import re

    for r in registry.op8_html_text(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"(?s)<article>(.*?)</article>", r.html)[1].replace("<br>", " ").replace("<b>", "").replace("</b>", "")
        blocks = [re.sub("[\x20\x09-\x0d]+", " ", html.unescape(b)).strip(" ") for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(b for b in blocks if b)
