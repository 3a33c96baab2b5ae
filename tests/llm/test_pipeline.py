import pytest
import sentencepiece as spm

import corpus_pipeline as P
from seqlake.llm import queries, toxicity
from seqlake.llm import sentencepiece as S
from seqlake.llm.common import landed, load
from tests.llm.test_line_dedup import BLANKS, brute
from tests.llm.test_simhash_mixing import plain_components, plain_fingerprint, plain_targets

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def outputs(spark):
    docs = load(spark, SF, "documents")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(landed(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def test_stages_follow_the_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "sentencepiece"]


def test_columns(outputs):
    assert all(d.columns == outputs[0].columns for d in outputs[:-1])


def test_toxicity_stage(spark, outputs):
    chain = queries.toxicity_chain(spark, outputs[0], SF)
    want = {r.doc_id for r in toxicity.score(outputs[0], chain).collect() if not r.is_toxic}
    assert {r.doc_id for r in outputs[1].collect()} == want
    marked = {r.doc_id for r in load(spark, SF, "labels").where("toxic = 0").collect()}
    lost = marked - want - ({r.doc_id for r in load(spark, SF, "labels").collect()} - marked)
    assert len(lost) <= 0.02 * len(marked)


def test_line_stage(outputs):
    rows = [(r.doc_id, r.text) for r in outputs[1].collect()]
    want = brute(rows)
    want = {i: want[i] for i, t in rows if not (t and want[i] != t and not want[i].strip(BLANKS))}
    got = {r.doc_id: r for r in outputs[2].collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_simhash_stage(outputs):
    rows = sorted((r.doc_id, r.text) for r in outputs[2].collect())
    groups = plain_components([plain_fingerprint(t) for _, t in rows])
    assert {r.doc_id for r in outputs[3].collect()} == {rows[g][0] for g in groups}


def test_mixing_stage(outputs):
    rows = outputs[3].collect()
    sizes, taken = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    for r in outputs[4].collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    want = plain_targets(sizes)
    assert all(abs(taken.get(s, 0) - want[s]) <= 1 for s in sizes)


def test_encoding_stage(outputs):
    lib = spm.SentencePieceProcessor(model_file=S.MODEL)
    want = sorted((r.doc_id, lib.encode(r.text)) for r in outputs[4].collect())
    got = sorted((r.doc_id, r.ids) for r in outputs[5].collect())
    assert got == want and outputs[5].where("NOT round_trip").count() == 0


def test_run_takes_odd_tables(spark, tmp_path):
    """Empty tables, NULLs and repeated rows go through every stage."""
    labels = "doc_id long, quality int, toxic int"
    for name, rows in (("empty", []), ("odd", [(None, None, None, None, None)] * 2 + [(1, "", "en", "s", 0)] * 2
                                      + [(2, "a word and another word of some text", None, None, None)] * 3)):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], labels).write.parquet(f"{d}/labels.parquet")
        got = P.run(spark, d).collect()
        assert sorted(r.n_tokens for r in got) == ([] if not rows else sorted(r.n_tokens for r in got))
        assert (len(got) > 0) == bool(rows)
