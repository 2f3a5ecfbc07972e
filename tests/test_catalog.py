"""Queries of the catalogue that have no SQL, against brute force on small tables."""

import math
import random

from sparsegrove.operators import overlap
from sparsegrove.plans import catalog, port_catalog


def conversations(spark, folder, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/conversations.parquet")
    return str(folder)


def common(a, b):
    """The length of the longest common subsequence."""
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        last = row
    return last[-1]


def test_fuzzy_neighbours_compares_whole_texts(spark, tmp_path):
    same = "the same beginning of both turns " * 10
    texts = [same + "one end", same + "quite another one", same[:150] + "x" * 300, "", "", None, "after a null"]
    got = {r["turn"]: r["ratio"] for r in catalog.fuzzy_neighbours(spark, conversations(spark, tmp_path, [(1, k, "user", t) for k, t in enumerate(texts)] + [(2, 0, "user", same)])).collect()}
    want = {k: None if a is None or b is None else 200 * common(a, b) / (len(a) + len(b)) if a or b else 100.0 for k, (a, b) in enumerate(zip(texts, texts[1:], strict=False), 1)}
    assert want[1] < 100 and got == {k: v if v is None else round(v, 4) for k, v in want.items()}


def pair(p, r, eps=0.0):
    return 2 * p * r / (p + r + eps) if p + r > 0 else 0.0


def near_dcg(rel, k):
    return sum(x / math.log2(i + 2) for i, x in enumerate(rel[:k]))


def close(row, want):
    assert all(math.isclose(row[c], v, abs_tol=2e-6) for c, v in want.items()), (row, want)


def test_keyphrase_queries_over_all_words(spark, tmp_path):
    r = random.Random(3)
    some = lambda n: " ".join(f"{r.choice('abcd')}{r.randrange(40)}" for _ in range(n))
    rows = [(c, t, ("user", "assistant", "system")[t % 3], some(r.randrange(15, 40))) for c in range(6) for t in range(7)] + [(7, 0, "user", some(30)), (8, 0, "assistant", some(30))]
    folder, found = conversations(spark, tmp_path, rows), {}
    for c in {x[0] for x in rows}:
        lists = [[w for x in sorted(rows) if x[0] == c and x[2] == role for w in x[3].split()] for role in ("assistant", "user")]
        found[c] = [list(dict.fromkeys(x)) for x in lists]
    assert max(len(t) for _, t in found.values()) > 24
    names = ["keyphrase_measures", "alpha_dcg", "set_measures", "loose_measures", "rouge_measures", "alignment_measures"]
    got = {n: {x["doc_id"]: x.asDict() for x in catalog.QUERIES[n](spark, folder).collect()} for n in names}
    documents = []
    for c, (p, t) in found.items():
        rel = [int(w in t) for w in p]
        hits, n = sum(rel[:5]), max(len(t), 1)
        ideal = near_dcg(sorted(rel, reverse=True), 5)
        m = {"hits": hits, "precision": hits / 5, "recall": hits / n, "f1": pair(hits / 5, hits / n), "ndcg": near_dcg(rel, 5) / ideal if ideal else 0.0, "ap": sum(x * sum(rel[: i + 1]) / (i + 1) for i, x in enumerate(rel[:5])) / n}
        documents.append(m | {"n": len(t)})
        close(got["keyphrase_measures"][c], m)
        both = len(set(p) & set(t))
        a, b = both / max(len(p), 1), both / n
        close(got["set_measures"][c], {"precision": a, "recall": b, "f1": pair(a, b)})
        hit = [any(x in y or y in x for y in t) for x in p]
        back = [any(x in y or y in x for y in p) for x in t]
        a, b = sum(hit) / max(len(p), 1), sum(back) / n
        close(got["loose_measures"][c], {"r_precision": sum(hit[: len(t)]) / n, "precision": a, "recall": b, "f1": pair(a, b)})
        for k in (1, 2):
            x, y = ({tuple(z[i : i + k]) for i in range(len(z) - k + 1)} for z in (p, t))
            a, b = len(x & y) / max(len(x), 1), len(x & y) / max(len(y), 1)
            close(got["rouge_measures"][c], {f"p{k}": a, f"r{k}": b, f"f{k}": pair(a, b, 1e-8)})
        gain = 0.0
        for w in t:
            seen = 0
            for i, x in enumerate(p[:5]):
                if x in w or w in x:
                    gain, seen = gain + 0.5**seen / math.log2(i + 2), seen + 1
        assert (c in got["alpha_dcg"]) == bool(p and t)
        if p and t:
            close(got["alpha_dcg"][c], {"alpha_dcg": gain})
        close(got["alignment_measures"][c], {"meteor": overlap.meteor_of(p, t), "self_bleu": slow_self_bleu(p)})
    mean = lambda c: sum(m[c] for m in documents) / len(documents)
    p, r_, hits = mean("precision"), mean("recall"), sum(m["hits"] for m in documents)
    a, b = hits / (5 * len(documents)), hits / sum(m["n"] for m in documents)
    close(catalog.QUERIES["keyphrase_corpus_measures"](spark, folder).first(), {"macro_p": p, "macro_r": r_, "macro_f1": pair(p, r_), "micro_p": a, "micro_r": b, "micro_f1": pair(a, b), "ndcg": mean("ndcg"), "map": mean("ap")})


def slow_self_bleu(phrases):
    tokens = [p.split() for p in phrases]
    return sum(overlap.bleu(tokens[:k] + tokens[k + 1 :], t) for k, t in enumerate(tokens)) / len(tokens) if len(tokens) > 1 else 0.0


def test_self_bleu_against_all_pairs():
    r = random.Random(5)
    for _ in range(300):
        phrases = [" ".join(r.choice("abc") for _ in range(r.randrange(0, 6))) for _ in range(r.randrange(0, 7))]
        assert math.isclose(overlap.self_bleu_of(phrases), slow_self_bleu(phrases), abs_tol=1e-12)


def test_yes_shares_are_those_of_the_sql_beyond_the_range_of_exp(spark, tmp_path):
    values = [-1.0, 0.0, 2.5, 709.78, 709.79, 900.0]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "event_id long, value double").selectExpr("event_id", "value", "timestamp '2024-01-01 00:00:00' AS ts")
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = [r["score"] for r in port_catalog.yes_shares(spark, str(tmp_path)).orderBy("event_id").collect()]
    assert got[:4] == [round(1 / (1 + math.exp(-v / 2)), 6) for v in values[:4]] and all(map(math.isnan, got[4:]))
