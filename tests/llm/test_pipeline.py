"""The pipeline's stages on the smallest tables, each against what a plain reading of its input gives."""

import os
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from hopweave.llm import bpe, mixing, secrets, simhash, toxicity
from hopweave.llm.common import materialize, table

SF = "/root/testdata/sf0.001"
if not os.path.isdir(SF):
    pytest.skip("no tables", allow_module_level=True)


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SF, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test-stage")
        out.append(docs)
    return out


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([" ".join(words)])


def test_names_and_columns(stages):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert all(s.columns == stages[0].columns for s in stages[:-1]) and stages[-1].columns == ["doc_id", "ids", "decoded"]


def test_toxic_documents_go_and_no_other(spark, stages):
    model = toxicity.train(stages[0], table(spark, SF, "labels"))
    scan = model.scanner()
    want = sorted(r["doc_id"] for r in stages[0].collect() if scan.score(r["text"] or "") < 0.5)
    assert sorted(r["doc_id"] for r in stages[1].collect()) == want


def test_one_of_each_group_stays(stages):
    before = {r["doc_id"]: shingles(r["text"]) for r in stages[1].collect()}
    left = {r["doc_id"] for r in stages[2].collect()}
    near = defaultdict(set)
    ids = sorted(before)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(before[a] & before[b])
            j = both / (len(before[a]) + len(before[b]) - both)
            if j >= 0.8:
                assert not (a in left and b in left)
            if j >= 0.6:
                near[a].add(b)
                near[b].add(a)
    assert left and all(near[x] for x in set(ids) - left)


def test_each_document_that_goes_has_a_partner(stages):
    before = {r["doc_id"]: shingles(r["text"]) for r in stages[1].collect()}
    gone = before.keys() - {r["doc_id"] for r in stages[2].collect()}
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    assert gone and all(any(j != i and alike(before[i], x) for j, x in before.items()) for i in gone)


def test_secrets_are_masked(stages):
    before, after = ({r["doc_id"]: r for r in s.collect()} for s in stages[2:4])
    assert before.keys() == after.keys()
    for i, r in after.items():
        spans = secrets.base_spans(before[i]["text"])
        if not spans:
            assert r["text"] == before[i]["text"] or "[SECRET]" in r["text"]
        else:
            assert all(before[i]["text"][s:e] not in r["text"] for s, _, e in spans) and r["n_chars"] == len(r["text"])


def test_mix_takes_what_its_plan_says(stages):
    plan = {r["doc_id"]: r for r in mixing.mix_plan(stages[3]).collect()}
    got = Counter(r["doc_id"] for r in stages[4].collect())
    assert all(got[i] * r["size"] == r["taken"] for i, r in plan.items())


def test_last_stage_equals_the_library(stages):
    tokenizer = bpe.Encoder(bpe.vocabulary(None)).tokenizer
    want = Counter()
    for r in stages[4].collect():
        e = tokenizer.encode(r["text"] or "", add_special_tokens=False)
        want[r["doc_id"], np.array(e.ids, "<u4").tobytes(), tokenizer.decode(e.ids, skip_special_tokens=False)] += 1
    assert Counter((r["doc_id"], np.array(r["ids"], "<u4").tobytes(), r["decoded"]) for r in stages[5].collect()) == want


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[5].count()


def test_near_duplicates_come_through_the_trees(spark, stages, monkeypatch):
    asked, trees, classes = [], simhash.links, []
    forest = simhash.components
    monkeypatch.setattr(simhash, "links", lambda fps, *a, **b: asked.append(fps) or trees(fps, *a, **b))
    monkeypatch.setattr(simhash, "components", lambda edges, name: classes.append(name) or forest(edges, name))
    left = corpus_pipeline.dedup_stage(spark, stages[1], SF)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(r["doc_id"] for r in stages[2].collect())
    assert len(asked) == 1 and "near" in classes
    words = [t for t in (r["text"] for r in stages[1].collect()) if (t or "").split()]
    assert {r["fp"] & (2**64 - 1) for r in asked[0].collect()} >= {simhash.fingerprint(t.encode()) for t in words}
