import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm import mixing, packing, quality, token_files, tokens, url_reputation, vector_dedup
from tickloom.llm.common import Scratch, components

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def library_ids(path, t):
    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    return lib.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_gives_the_librarys_ids(path, texts):
    encode = tokens.encoder(path)
    odd = ["a\x0bb\x0cc\xa0d\u2003e", "it's I'LL x'Re", "¹²½ 12345 ªº", "\x00\x01 \x7f\x80\x9f\xad", "<|endoftext|> <|startoftext|>", "  two  spaces  ", "ǅ Ⱥ ɐ ẞ", "e\u0301 \u212b", "'" * 5, "\r\n\n x"]
    for t in [t or "" for _, t in texts] + odd:
        assert np.frombuffer(encode(t), encode.dtype).tolist() == library_ids(path, t)


def test_packing_places_every_id_once(docs, crowded, texts):
    for frame in (docs, crowded):
        rows = packing.pack(frame, WORD, length=256).collect()
        line = np.zeros(sum(r["length"] for r in rows), int)
        for r in rows:
            at = r["sequence_id"] * 256 + r["offset"]
            line[at : at + r["length"]] += 1
            ids = np.frombuffer(r["ids"], "<u2")
            assert r["offset"] + r["length"] <= 256 and r["ids_crc32"] == zlib.crc32(ids.astype("<u4").tobytes())
        assert (line == 1).all()
        want = collections.Counter(len(library_ids(WORD, t)) + 1 for _, t in texts)
        assert collections.Counter(r["doc_tokens"] for r in rows if r["start"] == 0) == want
    got = sorted((r for r in rows if r["doc_id"] == 7), key=lambda r: r["start"])
    assert [i for r in got for i in np.frombuffer(r["ids"], "<u2").tolist()] == library_ids(WORD, dict(texts)[7]) + [2]
    by = {r["doc_id"]: r["curve"] for r in rows}
    assert by[7] == by[10]


def test_hilbert_curve_is_a_walk():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert(side, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert (np.abs(np.diff(side[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_token_files_round_trip(spark, docs, crowded, texts, tmp_path):
    for k, frame in enumerate((docs, crowded)):
        folder = f"file://{tmp_path}/{k}"
        files = token_files.write_ids(frame, folder, BYTE)
        rows = token_files.read_ids(files, folder).collect()
        lengths = collections.defaultdict(list)
        for i, t in texts:
            ids = library_ids(BYTE, t) + [0]
            lengths[i].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == collections.Counter((i, *x) for i, v in lengths.items() for x in v)
        at = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_tokens"]
        known = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
        assert known[:2] == [None, None] and known[2:] == sorted(known[2:])


def test_rans_blocks_checkpoints_and_checksums():
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.zipf(1.3, 300_000), 50_000).astype(np.uint32)
    table = token_files.Frequencies(dict(zip(*[x.tolist() for x in np.unique(ids, return_counts=True)])))
    assert token_files.Frequencies.from_bytes(table.to_bytes()).slots.tolist() == table.slots.tolist()
    raw = token_files.encode_block(ids, table)
    assert len(raw) < len(ids) * 1.7
    assert (token_files.decode_block(raw, table) == ids).all()
    lanes = min(token_files.LANES, len(ids) // 256)
    later = token_files.decode_block(raw, table, mark=2)
    assert (later == ids[2 * token_files.MARK * lanes :]).all()
    with pytest.raises(ValueError):
        token_files.decode_block(raw[:-1] + bytes([raw[-1] ^ 1]), table)
    for n in (1, 2, 300):
        assert (token_files.decode_block(token_files.encode_block(ids[:n], table), table) == ids[:n]).all()
    one = token_files.Frequencies({7: 5})
    assert (token_files.decode_block(token_files.encode_block(np.full(1000, 7, np.uint32), one), one) == 7).all()


def test_urls(spark):
    rows = [(1, "http://A.Example.org/es/x?q#f"), (2, "https://example.org/en/12"), (3, "https://example.org/en/2"), (4, "ftp://x.com/fr/"), (5, "http://x.com/de/a"), (6, "http://org"), (7, None), (8, "no scheme"), (9, ""), (10, "http://net.org:80/a"), (11, "http://x.net?p=/fr/"), (11, "http://x.net?p=/fr/"), (12, "http://notexample.org/es/"), (None, "http://x.com/fr/#a"), (13, "http://a://b/c")]
    pages = spark.createDataFrame([(i, u, "x", "h") for i, u in rows], "page_id long, url string, host string, n string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_reputation.judge(pages, none).collect()}
    assert got == {(1, "a.example.org", "/es/x", "example.org/es/", "block"), (2, "example.org", "/en/12", "example.org/en/1", "block"), (3, "example.org", "/en/2", "org/", "allow"), (4, "x.com", "/fr/", "com/fr/", "allow"), (5, "x.com", "/de/a", "com/de/", "block"), (6, "org", "", None, "allow"), (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "", "", None, "allow"), (10, "net.org:80", "/a", None, "allow"), (11, "x.net", "", None, "allow"), (12, "notexample.org", "/es/", "org/", "allow"), (None, "x.com", "/fr/", "com/fr/", "allow"), (13, "a:", "//b/c", None, "allow")}
    assert url_reputation.judge(pages.limit(0), none).count() == 0


def test_host_reputation_shrinks_towards_domain(spark):
    pages, bad = [], []
    for host, n, k in (("spam.bad.net", 60, 57), ("new.bad.net", 3, 3), ("a.good.net", 60, 1), ("b.good.net", 1, 1), ("unseen.bad.net", 2, None), ("c.co.uk", 5, 0)):
        for i in range(n):
            pages.append((len(pages), f"http://{host}/{i}"))
            if k is not None:
                bad.append((pages[-1][0], int(i < k)))
    frame = spark.createDataFrame(pages, "page_id long, url string")
    out = {r["host"]: r for r in url_reputation.host_reputation(frame, spark.createDataFrame([*bad, (None, 1), (0, None)], "page_id long, bad int"), suffixes=("co.uk",)).collect()}
    assert out["spam.bad.net"]["bad_bound"] > 0.7 and out["a.good.net"]["bad_mean"] < 0.1
    assert out["b.good.net"]["bad_mean"] < 0.6 < out["unseen.bad.net"]["bad_mean"]
    verdict = {r["host"]: r["verdict"] for r in url_reputation.judge(frame, spark.createDataFrame(bad, "page_id long, bad int"), rules=()).collect()}
    assert verdict["spam.bad.net"] == "block" and verdict["a.good.net"] == verdict["b.good.net"] == "allow"


def test_quality_learns_and_holds_out(spark, docs, crowded, empty):
    from tests.llm.conftest import words

    rows = [(i, " ".join(words(40, i, 300)) if i % 3 else " ".join(w.upper() + "!!" for w in words(40, i, 300)), int(i % 3 > 0)) for i in range(600)]
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (3, None), (1, 1)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality.scores(frame, labels).collect()}
    held = [i for i in out if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(out[i]["held_out"] == (i in set(held)) for i in out)
    assert np.mean([out[i]["predicted"] == int(i % 3 > 0) for i in held]) > 0.97
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {i: r["score"] for i, r in out.items()} == {r["doc_id"]: r["score"] for r in quality.scores(frame, flipped).collect()}
    for odd in (docs, crowded):
        scored = quality.scores(odd, labels).collect()
        assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)
        assert quality.accepted(odd, labels).columns == odd.columns
    assert quality.scores(empty, labels).count() == 0
    assert {r["score"] for r in quality.scores(frame, labels.limit(0)).collect()} == {1.0}
    assert {r["score"] for r in quality.scores(frame, labels.where("quality = 0")).collect()} == {0.0}


def test_network_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    p = 1 / (1 + np.exp(-(x[:, 0] * 1.5 - 0.5)))
    y = (rng.random(4000) < p).astype(float)
    net = quality.Network(x, y)
    assert np.abs(net.scores(x) - p).mean() < 0.06


def test_mixing_draws_and_shares(spark, docs, crowded, empty):
    for frame in (docs, crowded):
        out = mixing.mixed_documents(frame, repeat=3.0)
        assert out.columns == frame.columns and out.count() > 0
    assert mixing.mix(empty).count() == 0
    big = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x" * 20).alias("text"), F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 < 9, "b").otherwise("c").alias("source"))
    out = mixing.mix(big, weights={"a": 0.2, "b": 0.3, "c": 0.5})
    share = {r["source"]: r["n"] / 6000 for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(share["a"] - 0.2) < 0.03 and abs(share["b"] - 0.3) < 0.03 and abs(share["c"] - 0.5) < 0.05
    rare = big.withColumn("source", F.when(F.col("doc_id") < 5, "tiny").otherwise("rest"))
    n = mixing.mix(rare, weights={"tiny": 0.5}).where("source = 'tiny'").count()
    assert abs(n - 6000) < 6 * 6000**0.5  # a mean of 1200 copies, drawn in parts
    ids = [r["doc_id"] for r in out.collect()]
    assert abs(np.corrcoef(ids, range(len(ids)))[0, 1]) < 0.1
    assert mixing.mix(big, weights={}).count() == 0


def vector_rows(n=300, dims=16, seed=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(0, 60):
        rows.append((1000 + i, (base[i % 7] + 0.05 * rng.normal(size=dims)).tolist()))
    rows += [(2000, base[3].tolist()), (2001, (2 * base[3]).tolist()), (2002, None), (2003, [0.0] * dims), (2004, [None] + [1.0] * (dims - 1)), (2005, [float("nan")] * dims), (2006, [float("inf")] + [1.0] * (dims - 1)), (2007, []), (2008, [1.0] * 3), (None, base[3].tolist()), (5, base[5].tolist()), (2009, (1e200 * base[9]).tolist())]
    return rows


def test_vectors_against_brute_force(spark):
    rows = vector_rows()
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, id string")
    got = vector_dedup.near_vectors(frame).collect()
    assert len(got) == len(rows)
    good = [(i, np.array(v) / np.abs(v).max()) for i, v in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    unit = np.array([v / np.linalg.norm(v) for _, v in good])
    linked = unit @ unit.T >= 0.95
    want = collections.defaultdict(list)
    for k, (i, _) in enumerate(good):
        want[i].append(int(linked[k].sum()) - 1)
    total = sum(x for v in want.values() for x in v)
    found = sum(r["n_links"] for r in got)
    assert total and 0.97 * total <= found <= total
    assert all(r["n_links"] == 0 and r["component_id"] == r["vec_id"] and r["kept"] for r in got if r["vec_id"] not in want)
    by = {r["vec_id"]: r["component_id"] for r in got}
    assert by[2001] == by[2000] == 3 and by[2009] == 9
    assert vector_dedup.near_vectors(frame.limit(0)).count() == 0
    assert vector_dedup.near_vectors(frame.where("vec_id = 2002")).collect()[0]["n_links"] == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200), (200, 300)]
    got = {r["node"]: r["component"] for r in components(Scratch(spark, "cc"), spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 300: 200}
