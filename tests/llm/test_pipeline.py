import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import brute  # noqa: E402
import test_packing  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Clean texts, poor ones, exact and near copies, and passages that recur."""
    rng = random.Random(6)
    fresh = lambda n: [f"w{rng.randint(0, 4000)}" for _ in range(n)]
    passage = fresh(60)
    texts = {}
    for i in range(300):
        kind = rng.random()
        if kind < 0.1:
            texts[i] = " ".join(w.upper() + "!!###" for w in fresh(50))
        elif kind < 0.15 or i < 3:
            texts[i] = "too short"
        elif kind < 0.3 and i > 20:
            words = texts[rng.choice([k for k in texts if "###" not in texts[k] and len(texts[k]) > 200])].split()
            texts[i] = " ".join(words if rng.random() < 0.4 else [*words[:-1], "edited"])
        elif kind < 0.4:
            texts[i] = " ".join(fresh(80) + passage + fresh(40))
        else:
            texts[i] = " ".join(fresh(rng.randint(50, 400)))
    folder = tmp_path_factory.mktemp("tables")
    source = {i: "hot" if rng.random() < 0.5 else f"s{rng.randint(0, 3)}" for i in texts}
    docs = brute.docs(spark, texts, source=source.get)
    docs.write.parquet(str(folder / "documents.parquet"))
    labels = [(i, int("###" not in t and t != "too short"), 0) for i, t in texts.items() if rng.random() < 0.6]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder), texts


def test_stages_against_brute_force(spark, tables, tmp_path):
    folder, texts = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, after = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs.columns == columns
        after.append(docs.collect())
    good, one, cut, mixed, packed = after
    assert {r.doc_id for r in good} == {i for i, t in texts.items() if "###" not in t and t != "too short"}
    assert {r.doc_id for r in one} == {i for i, (_, c) in brute.components({r.doc_id: r.text for r in good}).items() if i == c}
    expected = brute.removed([r.text for r in one])
    got = {r.doc_id: len(r.text.split()) for r in cut}
    assert got == {r.doc_id: n - gone for r, (n, gone, _) in zip(one, expected, strict=True)} and any(gone for _, gone, _ in expected)
    assert {r.doc_id for r in mixed} == set(got) and 1 < len(mixed) / len(cut) <= 2
    used, floor = test_packing._check(packed, [(r.doc_id, r.text) for r in mixed])
    assert used <= floor + 1
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def _tables(spark, folder, rows, labels):
    df = brute.clashing(spark.createDataFrame(rows, brute.DOCS))
    df.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def test_odd_tables(spark, tmp_path):
    """Null ids, texts and sources, empty and very long texts, repeated rows and ids, clashing columns."""
    rng = random.Random(8)
    fresh = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    one, two, long, nameless = fresh(60), fresh(70), fresh(60_000), fresh(40)
    rows = [
        (1, one, "en", "a", 1), (1, one, "en", "a", 1), (2, two, None, None, None), (2, fresh(50), "en", "b", 2), (3, None, "en", "a", 0), (4, "", "en", "a", 0),
        (5, " \n\t", "en", "", 0), (6, long, "en", "b", 3), (None, nameless, "en", "a", 4), (None, None, None, None, None), (7, "too short", "en", "c", 9),
    ]
    folder = _tables(spark, tmp_path / "odd", rows, [(1, 1, 0), (3, 0, None), (None, 1, 0), (2, None, None)])
    packed = corpus_pipeline.run(spark, folder).collect()
    # what the base rules reject goes, one of the repeated rows stays, and every other text is packed whole at least once
    assert {r.doc_id for r in packed} == {1, 2, 6, None}
    ends = {(r.doc_id, r.start + r.length) for r in packed}
    assert sum(i == 1 for i, _ in ends) == 1 and sum(r.doc_id == 2 and r.piece == 0 for r in packed) >= 2 and max(e for i, e in ends if i == 6) > 60_000
    assert all(r.offset + r.length <= 4096 for r in packed)


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, _tables(spark, tmp_path / "none", [], [])).collect() == []
    only = [(1, None, "en", "a", 0), (2, "", "en", "a", 0)]
    assert corpus_pipeline.run(spark, _tables(spark, tmp_path / "poor", only, [(1, 1, 0), (2, 0, 0)])).collect() == []
