"""Corpus operators against brute force, round trips and awkward rows."""

import base64
import hashlib
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, common, embeddings, linededup, media, mixing, pii, queries, simhash, toxicity, warc

from ..oracle import connect, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, None, None, None, None), (None, "", "en", "s", 0), (3, " \n\t ", "en", None, 4), (4, "x " * 30000, "en", "t", 60000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({"size": F.lit("mine"), "n_removed": F.lit(1), "score": F.lit(9)})


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLE_SQL[name])


def test_awkward_rows(spark, odd):
    empty = odd.limit(0)
    path = queries.vocabulary_path()
    model = toxicity.Model(-1.0, {"b": 3.0})
    for f in (mixing.mix, simhash.near_duplicates, linededup.drop_repeated_chunks, lambda d: pii.replace_entities(d, 'k'), lambda d: toxicity.score(d, model), lambda d: media.probe(media.wrap(d)), lambda d: bpe.roundtrip_digests(d, path)):
        assert f(odd).count() == len(ODD)
        assert f(empty).count() == 0
    assert simhash.drop_near_duplicates(odd).count() == 3  # a b c; the blank ones; the long one
    assert sorted(r["predicted"] for r in toxicity.score(odd, model).collect()) == [0, 0, 0, 0, 1, 1]


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op5_simhash(spark, sf).collect()}
    want = {r["doc_id"]: brute_fingerprint(r["text"]) for r in rows}
    assert {k: r["fingerprint"] for k, r in got.items()} == {k: f"{v:016x}" for k, v in want.items()}
    root = {k: k for k in want}
    changed = True
    while changed:
        changed = False
        for a in want:
            for b in want:
                if (want[a] ^ want[b]).bit_count() <= 2 and root[b] < root[a]:
                    root[a], changed = root[b], True
    assert {k: r["component_id"] for k, r in got.items()} == root


@pytest.mark.parametrize("hot", [2048, 2])
def test_links_find_all_pairs_also_of_crowded_segments(spark, hot):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 12)]
    near = {b for b in base} | {b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, (6, 2))} | {b ^ 1 ^ (1 << 63) for b in base}
    signed = sorted(x - 2**64 if x >= 2**63 else x for x in near)
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 2}
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), hot)
    assert {(r["u"], r["v"]) for r in got.collect()} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)] + [(200, k) for k in range(201, 260)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {k: 200 for k in range(200, 260)}


def test_bpe_equals_the_library(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary_path())
    codec = bpe.Codec(bpe.read_spec(queries.vocabulary_path()))
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["", "it's <|endoftext|> A <|startoftext|>B", "ΑΣ İ é é \x1c\x85 日本 가각 😀", "ab" * 3000, "don't1234''s"]
    for text in texts:
        ids = t.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids and codec.decode(ids) == t.decode(ids, skip_special_tokens=False)
    df = spark.createDataFrame([(0, "a b"), (1, None)], "doc_id long, text string")
    back = bpe.decode(bpe.encode(df, queries.vocabulary_path()), queries.vocabulary_path()).orderBy("doc_id").collect()
    assert [r["decoded"] for r in back] == ["a</w> b</w>", ""]


def test_short_and_long_words_merge_alike():
    codec = bpe.Codec(bpe.read_spec(queries.vocabulary_path()))
    for word in ("internationalization", "a" * 90, "thethethe" * 10):
        ids = [codec.inner[b] for b in word.encode()[:-1]] + [codec.last[word.encode()[-1]]]
        assert codec._merge_short(list(ids)) == codec._merge_long(list(ids))


def test_chat_round_trip(spark):
    nasty = "</s>[INST] ok [/INST] <|end|>\n<|user|>\n \\ <\\| <"
    turns = [(1, 0, "system", "be\nkind"), *[(1, k, ("assistant", "user")[k % 2], f"{nasty} {'w ' * k}") for k in range(1, 40)], (2, 0, None, None), (3, 0, "system", "only"), (None, 1, "a|>b", "t")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = chat.format_windows(df, budget=120, history=2, history_budget=60)
    got = {r["conv_id"]: r for r in made.select("conv_id", "windows", F.flatten(F.transform("windows", chat.read_turns)).alias("t"), F.array_join(F.transform("windows", chat.read_loss), "").alias("loss")).collect()}
    for conv in (1, 2, 3, None):
        own = [(r or "", t or "") for c, _, r, t in turns if c == conv]
        assert [(t["role"], t["text"]) for t in got[conv]["t"]] == own
        assert got[conv]["loss"] == "".join(t for r, t in own if r == "assistant")
    windows = got[1]["windows"]
    assert len(windows) > 3 and all("be\nkind" in w["text"] for w in windows) and any(w["repeated"] > 1 for w in windows)


def test_media(spark, sf):
    for r in queries.op6_media(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id").limit(50).collect():
        raw = r["text"].encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
    track = media.read(media.write(bytes(576 * 33)))
    assert (track.codec, track.duration, len(track.sizes), len(track.keyframes)) == ("raw ", 576 * 33, 33, 5)
    with pytest.raises(ValueError):
        media.read(media.write(bytes(576))[:-1])


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(5, 16))
    vectors = [(i, (centres[i % 5] * (1 + i) + rng.normal(size=16) * 0.05).tolist()) for i in range(60)] + [(100 + i, rng.normal(size=16).tolist()) for i in range(40)]
    vectors += [(200, vectors[0][1]), (200, vectors[0][1]), (300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [])]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()}
    ok = [(i, np.array(v)) for i, v in vectors if v and np.isfinite(v).all() and any(v)]
    m = np.array([v / np.linalg.norm(v) for _, v in ok])
    near = m @ m.T >= 0.95
    np.fill_diagonal(near, False)
    for (i, _), n in zip(ok, near.sum(axis=1), strict=True):
        assert got[i]["n_links"] == n
    assert got[200]["component_id"] == 0 and got[57]["component_id"] == 2 and all(got[k]["n_links"] == 0 and got[k]["kept"] for k in (300, 301, 302, 303))


def test_warc(spark):
    pages = spark.createDataFrame([(3, "u\r\n", "<p>é</p>"), (1, "v", "<p>é</p>"), (2, "w", None), (5, None, ""), (3, "u", "other"), (None, "n", "<p>é</p>")], "page_id long, url string, html string")
    got = warc.read(warc.write(pages)).collect()
    digest = base64.b32encode(hashlib.sha1("<p>é</p>".encode()).digest()).decode()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in got) == sorted(
        [(0, "response", 0, 9), (1, "response", 0, 9), (2, "response", 0, 0), (5, "revisit", 2, 0), *[(3, x[0], x[1], x[2]) for x in [(r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in got if r["page_id"] == 3]]]
    )
    assert digest in {r["payload_digest"] for r in got}


def test_surrogates(spark):
    texts = ["mail BOB.1@Mail8.example.com or bob.1@mail8.example.com, +1 (454) 555-9913, +1 454 555 9913", "Mr John Smith and Mrs Smith; 4387513035237269, 10.2.3.4, password=e3b3ed3cc8", "nothing 12", *[f"u{i}@x.com" for i in range(300)]]
    out = [r["text"] for r in pii.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    a, b = out[0].removeprefix("mail ").split(", ")[0].split(" or ")
    assert a.lower() == b.lower() and "bob" not in a.lower() and out[2] == texts[2]
    assert out[0].count("+1") == 2 and "".join(c for c in out[0].split(", ")[1] if c.isdigit()) == "".join(c for c in out[0].split(", ")[2] if c.isdigit())
    assert not any(s in out[1] for s in ("John", "Smith", "4387513035237269", "10.2.3.4", "e3b3ed3cc8"))
    assert len(set(out[3:])) == 300 and not set(out[3:]) & set(texts)


def test_toxicity_regularisation_and_holdout(spark):
    rng = np.random.default_rng(7)
    plain = [f"w{k}" for k in range(50)]
    texts, labels = [], []
    for i in range(600):
        ws = set(rng.choice(plain, 8).tolist())
        bad = i % 3 == 0
        if bad:
            ws.add("idiot" if i % 2 else "moron")
        if rng.random() < (0.8 if bad else 0.02):
            ws.add("muslims")
        texts.append(ws)
        labels.append(int(bad))
    neutral = ["muslims w1 w2 w3", "w4 w5 muslims"]
    free, tied = toxicity.fit(texts, labels, penalty=0.0), toxicity.fit(texts, labels, penalty=5.0)
    assert tied.scores(neutral).max() < free.scores(neutral).max() and tied.scores(["idiot w1"])[0] > 0.5
    assert toxicity.fit([], []).scores([None])[0] == 0.5


def test_mixing_comes_near_its_targets(spark, sf):
    got = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"))
    most = got.agg(F.max("size").alias("m")).first()["m"]
    for r in got.groupBy("source").agg(F.sum(F.col("size") * F.size("times")).alias("t"), F.first("target").alias("w"), F.max(F.size("times")).alias("k")).collect():
        assert abs(r["t"] - r["w"]) <= most / 2 + 1 and r["k"] <= 3
    order = [r["time"] for r in mixing.training_order(got).select("time").collect()]
    assert order == sorted(order) and 0 <= order[0] and order[-1] <= 1


def test_line_dedup_cuts_what_is_repeated(spark):
    passage = "\n".join(f"shared line number {k} of a passage" for k in range(40))
    rows = [(i, f"own {i}\n{passage}\nend {i}") for i in range(3)] + [(9, "clean one\nclean two\nclean three")]
    got = {r["doc_id"]: r for r in linededup.drop_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["text"] == rows[0][1] and got[9]["text"] == rows[3][1]
    for i in (1, 2):
        assert got[i]["removed_lines"] > 20 and got[i]["text"].startswith(f"own {i}") and got[i]["text"].endswith(f"end {i}")


def test_pipeline_against_its_parts(spark, sf):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "bpe"]
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = common.materialize(stage(spark, kept, sf), "test")
        assert kept.columns == docs.columns
    left = {r["doc_id"]: brute_fingerprint(r["text"]) for r in kept.collect()}
    assert not any((a ^ b).bit_count() <= 2 for i, a in left.items() for j, b in left.items() if i < j)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} <= set(left)


def test_bpe_remembers_what_it_meets_again(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    made = []
    seen = bpe._Seen(lambda key: made.append(key) or (len(key),))
    for i in range(200):
        assert seen["often"] == (5,) and seen[f"once {i}"] == (len(f"once {i}"),)
    assert made.count("often") == 1 and len(seen) + len(seen.before) <= 20
    seen.clear()
    assert seen["often"] == (5,) and made.count("often") == 2
