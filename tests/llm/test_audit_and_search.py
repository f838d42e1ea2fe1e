from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from helpers import EDGES, documents
from vecweave.llm import filter_audit, lexical

DOCS = "doc_id bigint, text string, source string, _id int, part string, mask int, _copies string, n_words int"
LABELS = "doc_id bigint, quality int, toxic int, part string, _good int"


def audited(docs, labels):
    """Every order by removing documents one filter after the other."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    by_part = defaultdict(list)
    for i, t, s in docs:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails = "".join(
            letter
            for letter, bad in zip(
                "ABCDE",
                (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and first[t] < i),
            )
            if bad
        )
        by_part[s or ""].append((fails, i in good and i is not None, i in toxic and i is not None))
    rows, shapley = [], Counter()
    for part, all_docs in by_part.items():
        for order in permutations("ABCDE"):
            left = all_docs
            for step, letter in enumerate(order, 1):
                out = [d for d in left if letter in d[0]]
                left = [d for d in left if letter not in d[0]]
                shapley[part, letter] += len(out)
                rows.append([
                    part, "".join(order), step, len(left), len(out), sum(letter in d[0] for d in all_docs) - len(out),
                    sum(d[0] == letter for d in all_docs), sum(d[1] for d in out), sum(d[2] for d in out),
                ])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in rows)


def test_audit_equals_applying_filters_in_turn(spark):
    words = " ".join(f"word{i}" for i in range(60))
    texts = [*EDGES, (20, words), (21, words), (19, words + " $"), (22, words.upper()), (23, "a b c " * 40), (24, "a b c " * 40 + "#"), (21, words), (20, words)]
    docs = [(i, t, [None, "", "hot", "x"][n % 4]) for n, (i, t) in enumerate(texts)] + [(100 + i, words, "hot") for i in range(40)]
    labels = [(20, 1, 0), (20, 0, 1), (21, 1, 1), (23, None, 1), (None, 1, 1), (24, 0, None), (999, 1, 1), (120, 1, 0)]
    rows = spark.createDataFrame([(*d, 1, "p", 2, "c", 3) for d in docs], DOCS)
    marks = spark.createDataFrame([(*x, "p", 1) for x in labels], LABELS)
    got = sorted(tuple(r) for r in filter_audit.interaction_audit(rows, marks).collect())
    assert got == audited(docs, labels)
    assert filter_audit.interaction_audit(rows, marks.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_audit_of_empty_tables_and_of_fewer_filters(spark):
    empty = spark.createDataFrame([], DOCS)
    assert filter_audit.interaction_audit(empty, spark.createDataFrame([], LABELS)).count() == 0
    counted = spark.createDataFrame([("p", 0, 5, 0, 0), ("p", 1, 2, 1, 0), ("p", 3, 4, 0, 4)], "part string, mask int, n bigint, good bigint, toxic bigint")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit(counted, "XY").collect()}
    assert got == {("XY", 1): (5, 6, 0, 2, 1, 4, 8), ("XY", 2): (5, 0, 4, 0, 0, 0, 4), ("YX", 1): (7, 4, 0, 0, 0, 4, 4), ("YX", 2): (5, 2, 4, 2, 1, 0, 8)}
    with pytest.raises(ValueError):
        filter_audit.audit(counted, "ABCDEFGH")


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BIG = 1 << 62


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def ranked(docs, items, k):
    """Every item scored against every document."""
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, words = len(counted), sum(c.total() for _, c in counted)
    holding = Counter(t for _, c in counted for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item].update(terms_of(text))
    rows = []
    for item, terms in wanted.items():
        hits = []
        for i, c in counted:
            long = 50 + (50 * c.total() * n_docs) // words
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * long)) for t in terms if c[t]
            )
            if score > 0:
                hits.append((-score, i is None, BIG if i is None else i, i))
        rows += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(hits, key=lambda h: h[:3])[:k], 1)]
    return sorted(rows, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"{rng.choice('abcdefgh')}{i}" for i in range(400)]
    topic = [rng.sample(words, 40) for _ in range(12)]
    texts = [" ".join(rng.choice(topic[i % 12] if rng.random() < 0.7 else words) for _ in range(rng.choice([1, 20, 80, 200]))) for i in range(n)]
    texts[: n // 3] = [texts[0] + " copy"] * (n // 3)
    items = [(i, " ".join(rng.sample(topic[i % 12], 8) + rng.choices(words, k=12))) for i in range(30)]
    return list(enumerate(texts)), items


@pytest.mark.parametrize("shard, block, width, k", [(1024, 32, 256, 50), (64, 4, 16, 3), (50, 8, 100, 10)])
def test_search_equals_scoring_everything(spark, monkeypatch, shard, block, width, k):
    for name, value in (("SHARD_DOCS", shard), ("BLOCK_DOCS", block), ("COORDINATES", width)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = corpus(shard, 900)
    docs += EDGES + [(None, docs[5][1]), (5, docs[5][1]), (77, "Häß häß 日本 日本")]
    items += [(90, None), (91, "  ,"), (92, "nothing_of_this qqqq"), (93, "HÄß 日本 one"), (None, "one two b1"), (3, "a0 a1 one")]
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id bigint, text string, doc_id string, rank int")
    got = lexical.ranked_search(documents(spark, docs), rows, k).collect()
    assert sorted(map(tuple, got), key=str) == ranked(docs, items, k)


def test_items_in_blocks_and_empty_tables(spark, monkeypatch):
    docs, items = corpus(5, 200)
    rows = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(lexical, "ITEM_TERMS", 200)
    monkeypatch.setattr(lexical, "MAX_CELLS", 400)
    blocks = list(lexical.item_blocks(rows))
    assert len(blocks) > 3 and sorted(i for b in blocks for i in b.ids) == list(range(30))
    assert all(len(b.ids) * len(b.terms) <= 400 or len(b.ids) == 1 for b in blocks)
    few = rows.filter("item_id < 4")
    assert sorted(map(tuple, lexical.ranked_search(documents(spark, docs), few, 7).collect()), key=str) == ranked(docs, items[:4], 7)
    assert lexical.ranked_search(documents(spark, []), few, 7).count() == 0
    assert lexical.ranked_search(documents(spark, docs), rows.limit(0), 7).columns == ["item_id", "rank", "doc_id", "score"]
    named = few.selectExpr("concat('i', item_id) AS item_id", "text")
    assert {r.item_id for r in lexical.ranked_search(documents(spark, docs), named, 2).collect()} == {"i0", "i1", "i2", "i3"}


def test_bounds_hold_and_blocks_are_skipped(spark):
    docs, items = corpus(9, 1200)
    [block] = lexical.item_blocks(spark.createDataFrame(items, "item_id bigint, text string"))
    index = lexical.build_index(documents(spark, docs[400:]).coalesce(1), block)
    best = lexical.Best(index.items, index.weights, index.coordinates, 5)
    for row in index.shards.collect():
        shard = lexical.Shard.of_row([row[c] for c in lexical._BINARY])
        doc, item = (x.ravel() for x in np.indices((len(shard.ends) - 1, len(block.ids))))
        filled = np.diff(shard.ends)[doc] > 0
        doc, item = doc[filled], item[filled]
        score = best.scores(shard, doc, item)
        best.floor[:] = np.sort(score.reshape(-1, len(block.ids)), axis=0)[-5]
        found = set(zip(*(x.tolist() for x in best.candidates(shard))))
        assert {(d, i) for d, i, s in zip(doc.tolist(), item.tolist(), score) if s >= best.floor[i]} <= found
        assert (np.diff(shard.block_ends) > 0).all() and shard.block_ends[-1] == len(shard.terms)
    assert best.opened < best.blocks / 2
