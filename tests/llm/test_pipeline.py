import hashlib
import sys
from pathlib import Path

import numpy as np
import pytest

from pyspark.sql import functions as F

from skarn.llm import registry

from . import brute

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_equal_plain_versions(spark, duck, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    tables = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        tables.append(docs)
    assert all(t.columns == columns for t in tables[:-1])
    rows = lambda t: {r.doc_id: r.text for r in t.collect()}
    source = rows(spark.read.parquet(f"{SF}/documents.parquet"))

    kept = {r[0] for r in duck.sql(f"SELECT doc_id FROM ({registry.ORACLES['op4_quality_rules']}) WHERE kept").fetchall()}
    first = rows(tables[0])
    assert first == {i: source[i] for i in kept}

    near = brute.near_duplicates(first.items())
    second = rows(tables[1])
    assert second == {i: first[i] for i, (_, _, k) in near.items() if k}

    cut = brute.without_repeats(second.items())
    third = rows(tables[2])
    assert third == {i: (" ".join(w) if m else second[i]) for i, (n, m, w) in cut.items() if m == 0 or m < n}
    assert all(r.n_chars == len(r.text) for r in tables[2].collect() if cut[r.doc_id][1])

    mixed = tables[3].collect()
    assert {r.doc_id: r.text for r in mixed}.items() <= third.items() and 0.7 * len(third) < len(mixed) < 1.3 * len(third)

    import public_tokenizers as P
    import tiktoken

    from skarn.llm.bpe import read_ranks

    ranks = {t: i for i, t in enumerate(read_ranks(P.path(corpus_pipeline.VOCABULARY)))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = tables[4].collect()
    assert len(last) == len(mixed)
    for r in last:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode_ordinary(third[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(third[r.doc_id].encode()).hexdigest()


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]


ROWS = [
    (1, " ".join(f"word{i}" for i in range(60)), "en", "src0", 7), (1, " ".join(f"word{i}" for i in range(60)), "en", "src0", 7), (1, " ".join(f"other{i}" for i in range(60)), "en", "src0", 7),
    (2, " ".join(f"word{i}" for i in range(60)) + " end", None, None, None), (3, " ".join(f"word{i}" for i in range(30)) + " " + " ".join(f"own{i}" for i in range(60)), "de", "x", 5),
    (None, " ".join(f"null{i}" for i in range(40)), "en", "src1", 1), (None, None, None, None, None), (4, "", "en", "b", 0), (5, None, "en", "b", 0), (6, "short text", "en", "b", 0),
    (7, " ".join(f"long{i}" for i in range(60000)), "en", "src2", 3),
]
#: Names that the operators use for themselves.
NAMES = "rate src parts salt own_salt own_source name cdf n weight copies copy place deal ranges n_words n_removed kept m ws skarn_doc skarn_sub skarn_row skarn_text skarn_several label ids decoded key component lead sig a b".split()


@pytest.fixture(scope="module")
def odd_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(f"own {c}") for c in NAMES})


@pytest.mark.parametrize("k", range(5))
def test_stages_keep_columns_of_any_name(spark, odd_rows, k):
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, odd_rows, SF)
    rows = out.collect()
    if k < 4:
        assert out.columns == odd_rows.columns
        assert all(r[c] == f"own {c}" for r in rows for c in NAMES)
    texts = sorted(((r.doc_id, r.text) for r in rows), key=str) if k < 4 else None
    source = [(i, t) for i, t, *_ in ROWS]
    words = lambda t: len((t or "").split())
    if k == 0:
        assert texts == sorted(((i, t) for i, t in source if words(t) >= 10), key=str)
    elif k == 1:
        assert texts == sorted(((i, t) for i, t in source if i != 2), key=str)
    elif k == 2:
        want = [(i, t) for i, t in source if i not in (2, 3)] + [(2, None), (3, " ".join(f"own{i}" for i in range(60)))]
        assert [(i, t) for i, t in texts if i != 2] == sorted(((i, t) for i, t in want if i != 2), key=str)
        assert {r.n_chars for r in rows if r.doc_id == 3} == {len(" ".join(f"own{i}" for i in range(60)))}
    elif k == 3:
        assert {(i, t) for i, t in texts} <= set(source)
    else:
        assert len(rows) == len(ROWS) and sorted(r.n_tokens == 0 for r in rows) == sorted(not t for _, t in source)
    assert stage(spark, odd_rows.where("1 = 0"), SF).count() == 0


def test_fits_are_kept_by_number():
    """A pair of tokens in the memo of fits is one number, which takes less than half of a tuple's memory; pairs stay apart."""
    import public_tokenizers as P

    from skarn.llm import bpe

    codec = bpe.Codec(bpe.read_ranks(P.path(corpus_pipeline.VOCABULARY)), P.PATTERN)
    text = "Unwahrscheinlichkeitsrechnungen, straightforwardness; xyzzyplugh"
    ids = codec.encode(text)
    bpe.trimmed()
    assert codec.decode(ids) == text.encode() and codec.encode(text) == ids
    assert codec.fits and all(type(pair) is int for pair in codec.fits)
    n = len(codec.tokens)
    assert all(fit == (codec.merged(codec.tokens[pair // n] + codec.tokens[pair % n]) == [pair // n, pair % n]) for pair, fit in codec.fits.items())
