import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import mixing, toxicity
from tidemark.llm.queries import TOKENIZER

FOLDER = "/root/testdata/sf0.001"


def grams(text):
    ws = (text or "").split()
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def one_of_each(docs):
    """The smallest id of each group that links of 0.8 or more connect, by comparing all pairs."""
    sets = {d.doc_id: grams(d.text) for d in docs}
    label = {}
    for start in sorted(sets):
        todo = [start]
        while todo:
            i = todo.pop()
            if i not in label:
                label[i] = start
                todo += [j for j in sets if j not in label and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return set(label.values())


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], FOLDER).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def test_each_stage_against_brute_force(spark, stages):
    raw, clean, single, distinct, mixed, packed = [s.collect() for s in stages]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.score_toxicity(stages[0], labels).collect() if r.predicted}
    assert {r.doc_id for r in clean} == {r.doc_id for r in raw} - toxic and len(clean) == len(raw) - len(toxic)
    last = defaultdict(int)
    for r in clean:
        last[r.text] = max(last[r.text], r.doc_id)
    assert sorted(r.doc_id for r in single) == sorted(last.values())
    assert sorted(r.doc_id for r in distinct) == sorted(one_of_each(single))
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(stages[3]).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed) == copies
    for s in stages[1:5]:
        assert s.columns == stages[0].columns
    rows = {r.doc_id: tuple(r) for r in raw}
    assert all(tuple(r) == rows[r.doc_id] for s in (clean, single, distinct, mixed) for r in s)
    from tokenizers import Tokenizer

    tokenizer, fill = Tokenizer.from_file(TOKENIZER), Counter()
    want = Counter()
    for r in mixed:
        want[r.doc_id] += len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in packed:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        got[r.doc_id] += r.length
        fill[r.sequence_id] += r.length
    assert got == want and max(fill.values()) <= 2048


def test_run_gives_the_same(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER)
    order = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    assert got.columns == stages[-1].columns
    by_doc = lambda rows: Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0)
    assert by_doc(got.collect()) == by_doc(stages[-1].collect()) and order(got.collect())


def test_stages_take_odd_documents(spark, odd_documents, no_documents):
    for start in (odd_documents, no_documents):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, start, FOLDER).count() >= 0
