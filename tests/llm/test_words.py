import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from skarn.llm.words import MARKS, pieces, sequences, windows, words_of

from .brute import WORD

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \t\n\x0b\x0c\r\x1c\xa0日#", max_size=40)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_words_and_windows(texts, k):
    array = pa.array(texts, pa.string())
    w = words_of(array)
    spans = [w.data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends, strict=True)]
    want = [WORD.findall(t or "") for t in texts]
    assert spans == [x for t in want for x in t] and w.counts.tolist() == [len(t) for t in want]
    at, hashes = windows(w, k)
    runs = [tuple(t[i : i + k]) for t in want for i in range(len(t) - k + 1)]
    assert [tuple(spans[p : p + k]) for p in at] == runs
    assert len(set(zip(runs, hashes.tolist(), strict=True))) == len(set(runs)) == len(set(hashes.tolist()))
    whole = sequences(w, np.arange(len(texts)))
    assert len(set(whole.tolist())) == len({tuple(t) for t in want})


def test_slices_and_pieces():
    array = pa.array(["a b", None, "", "c" * 100, "d e f"])
    assert words_of(array[2:]).counts.tolist() == [0, 1, 3]
    assert list(pieces(array, 10)) == [(0, 3), (3, 4), (4, 5)]
    assert (words_of(array[4:]).hashes == words_of(array).hashes[-3:]).all()
    assert words_of(pa.array(["Idiot!! x-y"]), lower=True, breaks=MARKS).counts.tolist() == [3]


def test_blocks_clear_their_own_folders(spark):
    """Tables that another thread makes meanwhile stay, and nested blocks clear what is theirs."""
    import threading

    from skarn.llm.scratch import Scratch, cleared

    made = {}
    exists = lambda s: spark._jvm.java.io.File(s.root.removeprefix("file://")).exists()
    one = spark.range(1)

    def other():
        made["other"] = Scratch(spark, "test")
        made["other"].write(one, "t")

    with cleared():
        made["outer"] = Scratch(spark, "test")
        made["outer"].write(one, "t")
        thread = threading.Thread(target=other)
        thread.start()
        thread.join()
        with cleared():
            made["inner"] = Scratch(spark, "test")
            made["inner"].write(one, "t")
        assert {k: exists(s) for k, s in made.items()} == {"outer": True, "other": True, "inner": False}
    assert {k: exists(s) for k, s in made.items()} == {"outer": False, "other": True, "inner": False}
    made["other"].drop()
