import corpus_pipeline
from tests.llm.conftest import words
from tests.llm.test_dedup import shingles
from tickloom.llm import minhash_dedup


def brute_kept(rows, k=5, percent=80):
    """Ids that stay: the least of each component over shared five-word sets."""
    sets, name = {i: shingles(t, k) for i, t in rows}, {i: i for i, _ in rows}
    for a in sorted(sets):
        for b in sorted(sets):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((name[a], name[b]))
                name = {i: low if c == high else c for i, c in name.items()}
    return {i for i, c in name.items() if i == c}


def test_stage_keeps_what_five_words_keep_apart(spark):
    rows = []
    for seed, changed in enumerate((1, 1, 2, 1)):
        base = words(40 if seed < 2 else 60, 70 + seed)
        other = list(base)
        for i in range(changed):
            other[len(base) // 2 + i] = f"z{i}"
        rows += [(2 * seed, " ".join(base)), (2 * seed + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == brute_kept(rows) and {0, 1, 2, 3} <= kept and not {6, 7} <= kept


def test_rows_that_repeat_a_doc_id_with_different_texts(spark):
    """Each text is judged for itself; of near texts under one doc_id one stays."""
    a, b, c = words(100, 80), words(100, 81), words(100, 82)
    near = lambda w: " ".join([*w[:50], "changed", *w[51:]])
    rows = [(3, near(a)), (5, " ".join(a)), (5, " ".join(b)), (7, " ".join(c)), (7, near(c)), (9, near(b)), (9, "alone"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r["doc_id"], r["text"]) for r in minhash_dedup.keep_one(docs).collect()), key=str)
    one_of_c = [x for x in kept if x[0] == 7]
    assert len(one_of_c) == 1 and one_of_c[0] in rows
    assert kept == sorted([(3, near(a)), (5, " ".join(b)), (9, "alone"), (9, None), *one_of_c], key=str)
    out = minhash_dedup.near_duplicates(docs, k=4).collect()
    assert sorted((r["doc_id"], r["component_id"], r["n_shingles"], r["kept"]) for r in out if r["doc_id"] != 7) == [(3, 3, 97, True), (5, 3, 97, False), (5, 5, 97, True), (9, 5, 97, False), (9, 9, 0, True), (9, 9, 1, True)]
    assert sorted((r["component_id"], r["kept"]) for r in out if r["doc_id"] == 7) == [(7, False), (7, True)]
