from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
from test_exact_and_rules import measured, norm
from test_text_models import classes, sets_of
from vecweave.llm.queries import PII_KEY
from vecweave.llm import pii


def fails(m):
    n = m["n_words"]
    return (
        n < 10 or 100 * m["n_repeat_words"] > 20 * n or 2 * m["word_chars"] < 3 * n or m["word_chars"] > 40 * n
        or m["n_symbols"] > n or 2 * m["n_dup_lines"] > m["n_lines"]
        or 5 * m["n_plain_words"] < 4 * n or 2 * m["n_digits"] > m["word_chars"] or (m["n_lines"] > 4 and 10 * m["n_bullet_lines"] > 9 * m["n_lines"])
    )


def test_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("n_chars < 2500")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = [r for r in rows if not fails(measured(r[1]))]
    out = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, out, sf_dir)
        assert out.columns == docs.columns
        if name == "exact_dedup":
            first = {}
            for i, t in sorted(want):
                first.setdefault(norm(t), (i, t))
            want = list(first.values())
        if name == "near_dedup":
            keep = set(classes(sets_of(sorted(want))).values())
            want = [r for r in want if r[0] in keep]
        if name == "pii":
            want = [(i, pii.rewrite(t, PII_KEY, {})[0]) for i, t in want]
        assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted(want), name
    packed = corpus_pipeline.STAGES[4][1](spark, out, sf_dir).collect()
    total, held = {}, defaultdict(int)
    for r in packed:
        total[r.doc_id] = r.doc_tokens
        held[r.doc_id] += r.length
    assert total == held and set(total) == {i for i, _ in want}
