"""Each stage of the pipeline against brute force on its own input, and run() as a whole."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from eventloom.llm import mixing, quality, secrets
from eventloom.llm.common import DOCUMENT_COLUMNS, materialize
from eventloom.llm.pretokens import tokenizer, vocabulary_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The table with documents that hold secrets, and repeated rows and nulls, added."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = " ".join(f"plain{i}" for i in range(60))
    more = [(90_000 + i, f"{i} {words} token = 'abcdefgh{i}' then AKIA{'Q' * 16} {words[::-1]}{i * 7919}", "en", "src1", 1) for i in range(5)]
    more += [(90_010, words + " extra", None, None, 1), (90_010, words + " extra", None, None, 1), (None, words[50:] + " no id", "en", "src2", 1), (90_011, None, "en", "src3", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long")).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def steps(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = materialize(stage(spark, docs, folder))
        out.append((name, docs, made))
        docs = made
    return out


def test_stage_columns(steps):
    assert [name for name, *_ in steps] == ["quality_rules", "near_duplicates", "secret_scan", "mixing", "packing"]
    assert all(made.columns == DOCUMENT_COLUMNS for _, _, made in steps[:-1])


def test_quality_stage(steps):
    _, docs, made = steps[0]
    kept = Counter(r.doc_id for r in quality.quality_rules(docs).where("kept").collect())
    assert Counter(r.doc_id for r in made.collect()) == kept
    assert set(map(tuple, made.collect())) <= set(map(tuple, docs.select(*DOCUMENT_COLUMNS).collect()))


def test_near_duplicate_stage(steps):
    _, docs, made = steps[1]
    rows = docs.collect()
    sets = {r.doc_id: _set(r.text) for r in rows}
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets, key=lambda d: (d is not None, d))
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if len(x & y) >= 0.8 * len(x | y):
                p, q = sorted((root(a), root(b)), key=ids.index)
                up[q] = p
    assert Counter(r.doc_id for r in made.collect()) == Counter(dict.fromkeys({root(d) for d in ids}, 1))


def _set(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_secret_stage(steps):
    _, docs, made = steps[2]
    spans = {r.doc_id: r.spans for r in secrets.secret_scan(docs).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in made.collect():
        want, at = "", 0
        for span in filter(None, spans[r.doc_id].split(",")):
            _, a, b = span.split(":")
            if int(a) >= at:
                want += text[r.doc_id][at : int(a)] + secrets.MASK
            at = max(at, int(b))
        assert r.text == want + text[r.doc_id][at:] and r.n_chars == len(r.text)
    assert any(spans.values())


def test_mixing_stage(steps):
    _, docs, made = steps[3]
    want = Counter({r.doc_id: r.taken for r in mixing.mix(docs, ["doc_id"]).collect() if r.taken})
    got = Counter()
    for r in made.collect():
        got[r.doc_id] += len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    assert got == want


def test_packing_stage(steps):
    _, docs, made = steps[4]
    tok = tokenizer(vocabulary_path())
    want = Counter()
    for r in docs.collect():
        ids = [*tok.encode(r.text, add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[start : start + 4096], "<u4")
            want[r.doc_id, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    rows = made.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096


def test_run_equals_the_stages(spark, folder, steps):
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, steps[-1][2].collect()))


def test_run_of_odd_tables(spark, tmp_path):
    """An empty table, and one with a very long text, nulls in every column and columns that stages use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, rank int, size long, __host string, set_id string"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "empty/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
    words = lambda n, k: " ".join(f"w{(i * 7919 + k) % 100_003}" for i in range(n))
    rows = [(1, words(60_000, 1), "en", "a", 1), (2, None, "en", "a", None), (None, words(60, 2), None, None, 5), (4, words(70, 3), "en", "b", 5), (5, words(70, 3), "de", "c", 5), (6, "", None, "a", 0)]
    rows = [(*r, "x", 1, 2, "h", "s") for r in rows]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "odd/documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    # Null and empty texts fail the rules, of two equal texts the least id stays; the mix takes words of each source.
    assert {r.doc_id for r in out} <= {1, None, 4} and 1 in {r.doc_id for r in out}
    ends = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096
