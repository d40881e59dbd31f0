"""The corpus pipeline against a brute-force version of its stages on a small table."""

from __future__ import annotations

import collections
import random
import zlib

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from lakeweave.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    """Clean prose, insults, exact copies, near copies and a passage that many documents share."""
    r = random.Random(9)
    words = [f"word{i}" for i in range(400)]
    prose = lambda n: " ".join(r.choices(words, k=n)) + "."
    passage = prose(60)
    docs = [prose(r.randint(20, 200)) for _ in range(240)]
    for i in range(0, 60):
        docs[i] = prose(30) + f" you {r.choice(['oaf', 'lout', 'cad'])}. " + prose(30)
    docs += docs[100:110] + docs[100:105]
    for i in range(110, 125):
        w = docs[i].split()
        if len(w) > 60:
            w[10] = "other"
            docs.append(" ".join(w))
    docs += [prose(40) + " " + passage + " " + prose(30) for _ in range(12)] + ["", None]
    at = tmp_path_factory.mktemp("corpus")
    order = list(range(len(docs)))
    pd.DataFrame({"doc_id": order, "text": docs, "lang": "en", "source": "s", "n_chars": [len(d or "") for d in docs]}).to_parquet(at / "documents.parquet")
    pd.DataFrame({"doc_id": order, "quality": 1, "toxic": [int(i < 60) for i in order]}).to_parquet(at / "labels.parquet")
    return str(at), docs


def grams(t):
    w = (t or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    """(doc_id, text) that the first four stages leave."""
    left = {i: t for i, t in enumerate(docs) if i >= 60}  # the model has to find all insults, and only these
    last = {}
    for i, t in left.items():
        last[t or ""] = i
    left = {i: t for i, t in left.items() if last[t or ""] == i}
    sets = {i: grams(t) for i, t in left.items()}
    root = {i: i for i in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in left:
        for j in left:
            if i < j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    left = {i: t for i, t in left.items() if find(i) == i}
    seen = collections.Counter(b[k : k + 200] for t in left.values() for b in [(t or "").encode()] for k in range(len(b) - 199))
    out = {}
    for i, t in left.items():
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        out[i] = bytes(np.frombuffer(b, np.uint8)[~gone]).decode()
    return out


def test_stages_are_the_five_of_the_task():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"]


def test_run_equals_brute_force(spark, corpus):
    path, docs = corpus
    want = brute(docs)
    table = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, path)
        assert out.columns == table.columns
        table = out.cache()
    assert {r.doc_id: r.text or "" for r in table.collect()} == want
    assert any(len(want[i]) < len(docs[i] or "") for i in want)
    got = corpus_pipeline.run(spark, path).collect()
    lib = packing.word_ids(public_tokenizers.path("word_bpe_49k.json")).library
    ids = {i: [*lib.encode(t, add_special_tokens=False).ids, 0] for i, t in want.items()}
    assert {(r.doc_id, r.piece): (r.length, r.ids_crc32) for r in got} == {(i, p // 2048): (len(x[p : p + 2048]), zlib.crc32(np.array(x[p : p + 2048], "<u4").tobytes())) for i, x in ids.items() for p in range(0, len(x), 2048)}


def odd_rows():
    r = random.Random(3)
    prose = lambda n: " ".join(f"w{r.randrange(500)}" for _ in range(n))
    shared, long = prose(70), prose(80)
    twin = long.split()
    twin[40] = "other"
    rows = [(None, prose(30)), (None, prose(30)), (None, None), (None, ""), (None, " \n"), (1, prose(20)), (1, prose(25)), (2, long), (2, long), (3, long), (None, long), (4, " ".join(twin)), (5, " ".join(twin) + " x"), (5, prose(20) + " " + shared), (6, prose(22) + " " + shared), (6, "a"), (6, "b"), (7, "a"), (None, "z")]
    return [*rows, (8, "é" * 5000 + prose(10)), (9, "é" * 5000 + prose(10))]


@pytest.mark.parametrize("rows", [odd_rows(), []])
def test_stages_on_odd_rows(spark, tmp_path, rows):
    """Null and repeated ids, empty texts, columns whose names stages might use or can't quote."""
    pd.DataFrame({"doc_id": pd.Series([], dtype="int64"), "quality": pd.Series([], dtype="int64"), "toxic": pd.Series([], dtype="int64")}).to_parquet(tmp_path / "labels.parquet")
    schema = "doc_id long, text string, n_chars long, __keep string, `a.b` string, `__id` string, spans int, h long, `te``xt` string"
    table = spark.createDataFrame([(i, t, len(t or ""), "k", "a.b", "id", 7, 8, "q") for i, t in rows], schema)
    seen = {name: None for name, _ in corpus_pipeline.STAGES}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        assert out.columns == table.columns
        out.write.parquet(f"{tmp_path}/{name}")
        table = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = sorted(((r.doc_id, r.text or "") for r in table.collect()), key=str)
        assert all((r["__keep"], r["a.b"], r["__id"], r.spans, r.h, r["te`xt"]) == ("k", "a.b", "id", 7, 8, "q") for r in table.collect())
    plain = [(i, t or "") for i, t in rows]
    assert seen["toxicity"] == sorted(plain, key=str)
    best = {}
    for i, t in plain:
        best[t] = max(best.get(t, -1), -1 if i is None else i)
    exact = {(i, t) for i, t in plain if best[t] == (-1 if i is None else i)}
    assert seen["exact_dedup"] == sorted(exact, key=str)
    near, kept = [], []
    for i, t in sorted(exact, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
        g = grams(t)
        if not any(g and len(g & o) >= 0.8 * len(g | o) for o in near):
            kept.append((i, t))
        near.append(g)
    assert seen["ngram_jaccard_join"] == sorted(kept, key=str)
    count = collections.Counter(b[k : k + 200] for _, t in kept for b in [t.encode()] for k in range(len(b) - 199))
    want = []
    for i, t in kept:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        want.append((i, bytes(np.frombuffer(b, np.uint8)[~gone]).decode(errors="ignore")))
    assert seen["suffix_array_dedup"] == sorted(want, key=str)
    got = corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((i for i, _ in want), key=str)
