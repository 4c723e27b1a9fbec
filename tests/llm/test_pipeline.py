"""The pipeline's stages on the smallest tables."""

import re
from collections import Counter

import corpus_pipeline
from tickweave.llm.common import stage, table

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs
    seen = {}
    for name, apply in corpus_pipeline.STAGES:
        after = stage(apply(spark, before, SF), name)
        seen[name] = (before.toPandas(), after.toPandas())
        if name != "packing":
            assert after.columns == columns
        before = after
    ids = {name: (set(a["doc_id"]), set(b["doc_id"])) for name, (a, b) in seen.items()}
    assert all(out <= into for into, out in ids.values())
    good = {r["doc_id"] for r in table(spark, SF, "labels").where("quality = 1").collect()}
    long = {r["doc_id"] for r in docs.collect() if len(r["text"].split()) >= 60}
    assert len(good & long & ids["quality_rules"][1]) > 0.9 * len(good & long)
    assert len(ids["line_dedup"][0]) == len(ids["line_dedup"][1])
    # one document of each group, by brute force
    into, out = seen["ngram_join"]
    sets = dict(zip(into["doc_id"], into["text"].map(shingles)))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(sets)
    for k, a in enumerate(names):
        for b in names[:k]:
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert sorted(out["doc_id"]) == sorted({find(i) for i in names})
    # the mix repeats documents; packing holds every copy whole
    mixed, pieces = seen["packing"]
    copies = Counter(mixed["doc_id"])
    starts = Counter(pieces[pieces["start"] == 0]["doc_id"])
    assert starts == copies and max(copies.values()) <= 3
    lengths = pieces.groupby("sequence_id")["length"].sum()
    assert (lengths.sort_index().iloc[:-1] == 4096).all()
