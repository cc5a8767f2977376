"""The corpus pipeline against its brute-force version."""

from test_contracts import AT, contamination, linked, sha, table
from test_line_dedup import brute

import corpus_pipeline
from loomline.llm import queries as q
from loomline.llm.bpe import default_path


def test_run(spark):
    from tokenizers import Tokenizer

    kept = {r.doc_id for r in q.op6_quality_rules(spark, AT).where("kept").collect()}
    docs = [(r.doc_id, r.text) for r in table(spark, "documents").collect() if r.doc_id in kept]
    cut = [(i, text) for i, (text, removed) in brute(docs).items() if not removed or text.split()]
    first = {i for i, _, _, keep in linked(cut, 80) if keep}
    first = [(i, text) for i, text in cut if i in first]
    items = [tuple(r) for r in table(spark, "benchmark").select("item_id", "text").collect()]
    clean = {x[0] for x in contamination(first, items) if not x[-1]}
    t = Tokenizer.from_file(default_path())
    want = {i: sha(",".join(map(str, t.encode(text, add_special_tokens=False).ids))) for i, text in first if i in clean}
    got = corpus_pipeline.run(spark, AT).collect()
    assert len(got) == len(want) and {r.doc_id: r.ids_sha256 for r in got} == want
    assert len(want) > 20


def test_stages_keep_columns(spark):
    docs = table(spark, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, AT)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), AT).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), AT).count() == 0
