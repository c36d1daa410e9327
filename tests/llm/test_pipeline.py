"""The pipeline's stages against brute force on a small corpus, and the registered queries on the smallest tables."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline as C
from partylens.llm import neardup, queries


@pytest.fixture(scope="module")
def folder(spark, prose, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    r = random.Random(5)
    item = prose(4000, 25)
    rows, labels = [], []
    for i in range(200):
        words = prose(i, 60 + i % 50).split(" ")
        if i % 4 == 0:
            for _ in range(4):
                words[r.randrange(len(words))] = r.choice(["gruzzle", "vexnok"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    rows.append((500, prose(1, 61).replace("or", "our", 1)))  # nearly document 1
    rows.append((501, prose(9000, 40) + " " + item))
    rows += [(502, None), (503, ""), (None, prose(9100, 40))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "packing"]
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    clean = C.toxicity(spark, docs, folder)
    gone = ids(docs) - ids(clean)
    assert len([i for i in gone if i is not None and i < 200 and i % 4 == 0]) >= 45 and len([i for i in gone if i is None or i >= 200 or i % 4]) <= 3
    lined = C.line_dedup(spark, docs, folder)
    assert ids(lined) == ids(docs) and lined.columns == docs.columns
    near = C.near_dedup(spark, docs, folder)
    assert ids(docs) - ids(near) == {500}
    left = C.decontamination(spark, docs, folder)
    assert ids(docs) - ids(left) == {501}
    assert ids(C.packing(spark, docs, folder)) == ids(docs)
    for df in (clean, lined, near, left):
        assert df.columns == C.COLUMNS


def test_short_repeated_lines_go(spark):
    menu = "\n".join(f"w{i}" for i in range(60))
    rows = [(1, "first\n" + menu + "\nend"), (2, "other\n" + menu + "\nlast")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in C.line_dedup(spark, docs, "").collect()}
    assert got == {1: (rows[0][1], len(rows[0][1])), 2: ("other\nlast", 10)}


def test_run(spark, folder):
    out = C.run(spark, folder)
    got = {r["doc_id"] for r in out.collect()}
    assert {None, 502, 503} <= got and not {0, 4, 8} <= got and 501 not in got


def test_later_stages_agree_with_brute_force(spark, folder, prose, tmp_path):
    """Line dedup, near dedup and decontamination in turn, each row against versions written by hand."""
    from test_dedup import brute, cut_by_hand
    from test_layout import brute as contained

    r = random.Random(9)
    passage, item = prose(70, 40), prose(71, 18)
    rows = [(i, prose(i % 30, 50 + i % 7) if i % 5 else prose(100 + i, 40) + "\n" + passage) for i in range(60)]
    rows += [(60 + i, " ".join(w if r.random() > 0.03 else f"z{i}" for w in prose(300 + i % 4, 70).replace(".", "").replace("\n", " ").split(" "))) for i in range(12)]
    rows += [(90, prose(400, 30).replace(".", "") + " " + item), (91, None), (92, "")]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = lambda rs: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rs], "doc_id long, text string, lang string, source string, n_chars long")
    texts = lambda df: sorted((x["doc_id"], x["text"]) for x in df.collect())
    by_hand = cut_by_hand([t or "" for _, t in rows])
    lined = [(i, None if t is None else by_hand[k]) for k, (i, t) in enumerate(rows)]
    assert texts(C.line_dedup(spark, frame(rows), str(tmp_path))) == sorted(lined)
    gone = {i for i, g in brute(lined) if i != g}
    single = [x for x in lined if x[0] not in gone]
    assert texts(C.near_dedup(spark, frame(lined), str(tmp_path))) == sorted(single) and gone
    hit = {i for i, _ in contained(single, [(1, item)], 0.6)}
    assert texts(C.decontamination(spark, frame(single), str(tmp_path))) == sorted(x for x in single if x[0] not in hit) and 90 in hit


def test_hard_corpora(spark, folder, prose, tmp_path):
    """Nulls in every column, repeated rows and ids, very long texts, extra columns; and an empty corpus."""
    import shutil

    long = prose(1, 60_000)
    rows = [(1, long, None, None, None, 1, "x"), (1, long, None, None, None, 1, "x"), (2, None, None, None, None, None, None), (2, "", "en", "s", 0, 2, "y"), (None, None, None, None, None, None, None), (None, prose(3, 20), "en", "s", 1, 3, "z"), (4, prose(4, 20), "en", "s", 1, 3, "z"), (4, prose(5, 20), "en", "s", 1, 3, "z")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, node string"
    for name, some in (("hard", rows), ("empty", [])):
        d = f"{tmp_path}/{name}"
        for t in ("labels", "benchmark"):
            shutil.copytree(f"{folder}/{t}.parquet", f"{d}/{t}.parquet")
        spark.createDataFrame(some, schema).write.parquet(f"{d}/documents.parquet")
        out = C.run(spark, d).collect()
        assert {r["doc_id"] for r in out} == ({1, 2, 4, None} if some else set())
        if some:
            assert sum(r["doc_id"] is None for r in out) == 2 and sum(r["n_tokens"] for r in out if r["doc_id"] == 1) >= 60_000


@pytest.mark.parametrize("name", sorted(queries()))
def test_registered(spark, data, name):
    df = entry.queries()[name](spark, data)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
    assert neardup.THRESHOLD == 0.6 and "pipeline" in entry.queries()
