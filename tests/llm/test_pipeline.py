"""The rows of the whole pipeline against a brute-force version, stage by stage, on a small table."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from sparsegrove.llm import mixing, pii, quality_fm, toxicity
from sparsegrove.llm.queries import GOOD_FROM, tokenizer_path


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def one_of_each(docs):
    """``docs`` (id to text) without near duplicates of smaller ids."""
    ids, sets = sorted(docs), {k: shingles(t) for k, t in docs.items()}
    group = {k: k for k in ids}
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in ids:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    return [k for k in ids if group[k] == k]


def test_pipeline_against_brute_force(spark, tmp_path):
    duckdb, tokenizers = pytest.importorskip("duckdb"), pytest.importorskip("tokenizers")
    r = random.Random(2)
    prose = "the of and river city people water market house small old long walked because under between story winter".split()
    junk = "buy click http $$$ free !!! win >>> cheap deal 999 www".split()
    rows = []
    for k in range(120):
        good = k % 3 > 0
        words = [r.choice(prose if good else junk) + ("" if r.random() < 0.6 else str(r.randrange(30))) for _ in range(r.randrange(40, 160))]
        if k % 10 == 5:
            words[20:20] = ["write", "to", f"anna.berg{k}@example.com", "today"]
        if k % 12 == 10:
            words = rows[-3][1].split(" ")[:-1] + ["changed"]
        rows.append((k, " ".join(words), "en", ("a", "a", "a", "b")[k % 4], 0, int(good)))
    spark.createDataFrame([x[:5] for x in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(x[0], x[5], 0) for x in rows], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    machine = quality_fm.fit(docs, labels, ~toxicity.held_out(4, 2))
    good = {x["doc_id"] for x in quality_fm.score(docs, machine).collect() if x["score"] >= GOOD_FROM}
    assert 0 < len(good) < len(rows)
    texts = {k: t for k, t, *_ in rows if k in good}
    kept = one_of_each(texts)
    assert len(kept) < len(texts)
    tagger, clean = pii.Tagger(pii.learn()), {}
    for k in kept:
        (base,), (more,) = pii.found([texts[k]], tagger)
        clean[k] = pii.redact(texts[k], [*((kind, s, e) for kind in pii.KINDS for s, e in base[kind]), *more])
    assert any("<EMAIL>" in t for t in clean.values())
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(k, t, rows[k][3]) for k, t in clean.items()])
    times = Counter(x[0] for x in db.execute(mixing.oracle(corpus_pipeline.REPEATS)).fetchall())
    assert set(times) == set(clean)
    encode = tokenizers.Tokenizer.from_file(tokenizer_path()).encode
    want = Counter({(k, 0, len(encode(clean[k], add_special_tokens=False).ids) + 1): n for k, n in times.items()})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((x["doc_id"], x["piece"], x["length"]) for x in got) == want
    ends = {}
    for x in sorted(got, key=lambda x: (x["sequence_id"], x["offset"])):
        assert x["offset"] == ends.get(x["sequence_id"], 0)
        ends[x["sequence_id"]] = x["offset"] + x["length"]
    assert max(ends.values()) <= 4096
