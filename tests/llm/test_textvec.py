import re

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from partylens.llm import base, packing
from partylens.llm import textvec as V


@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_words_dont_depend_on_their_place(texts):
    w = V.words(V.codes(texts))
    for i, t in enumerate(texts):
        alone = V.words(V.codes([t]))
        assert (w.hash[w.bounds[i] : w.bounds[i + 1]] == alone.hash).all()


def test_words_and_shingles():
    w = V.words(V.codes(["The cat sat. the CAT", "", "cat"]))
    assert np.diff(w.bounds).tolist() == [5, 0, 1] and w.hash[0] == w.hash[3] and w.hash[1] == w.hash[5]
    h, bounds = V.shingles(w, 2)
    assert np.diff(bounds).tolist() == [4, 0, 1] and h[0] == h[3]


def test_runs_hold_whole_texts():
    texts = ["x" * n for n in (5, 0, 200, 3, 4)]
    got = list(base.runs(texts, 100))
    assert [x for a, b in got for x in texts[a:b]] == texts


@given(st.lists(st.one_of(st.text(alphabet="a b'stre1.,\n\t!é\u00a0", max_size=30), st.text(max_size=20)), min_size=1, max_size=4))
def test_token_counts_are_exact(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    count = packing.counts_of(packing.VOCABULARY)
    encode = packing.encoding(packing.VOCABULARY).encode_ordinary
    assert count(texts).tolist() == [len(encode(t)) for t in texts]


def test_scratch_is_in_the_shared_folder(spark):
    assert base.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    s = base.Scratch(spark)
    df = s.save(spark.range(3))
    assert df.count() == 3 and re.match(re.escape(base.shared_dir(spark)), s.root)
    s.drop(df)
