from __future__ import annotations

import hashlib
import re
import textwrap

import duckdb
import pytest
from pyspark.sql import functions as F

from check_oracles import connect, rows_of
from helpers import EDGES, LONG, documents
from vecweave.llm import exact_dedup, license, quality
from vecweave.llm.queries import ORACLES, QUERIES, SQL_OP1


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cur = connect(sf_dir).execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cur.fetchall())


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup_edges(spark):
    rows = exact_dedup.exact_dedup(documents(spark, EDGES)).collect()
    assert len(rows) == len(EDGES)
    groups = {}
    for i, t in EDGES:
        groups.setdefault(hashlib.sha256(norm(t).encode()).hexdigest(), []).append(i)
    kept = {}
    for r in rows:
        own = groups[r.text_sha256]
        ids = [i for i in own if i is not None]
        assert r.group_size == len(own) and r.keep_id == (min(ids) if ids else None)
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
    assert set(kept.values()) == {1}


def test_chunks_tile_texts_and_follow_content(spark):
    long = "".join(f"Sentence number {i} of many. " for i in range(3000))
    docs = spark.createDataFrame([(1, long), (2, "x" + long), (3, "y" * 20_000), (4, "")], "doc_id int, t string")
    rows = {r.doc_id: r.c for r in docs.select("doc_id", exact_dedup.chunks(F.col("t")).alias("c")).collect()}
    assert "".join(rows[1]) == long and "".join(rows[2]) == "x" + long and "".join(rows[3]) == "y" * 20_000 and rows[4] == []
    assert all(len(c) <= exact_dedup.MAX_CHUNK for r in rows.values() for c in r)


def test_ambiguous_identifiers_are_spelled(spark):
    texts = [(1, "alpha beta"), (2, "gamma delt"), (3, "alpha beta"), (4, "other words here")]
    docs = documents(spark, texts)
    rows = exact_dedup.groups(docs, identifier=F.length).collect()
    assert {r.doc_id: r.keep_id for r in rows} == {1: 1, 2: 2, 3: 1, 4: 4}


def test_keep_documents_keeps_columns_and_one_of_repeats(spark):
    docs = documents(spark, EDGES)
    rows = exact_dedup.keep_documents(docs).collect()
    assert rows[0].__fields__ == docs.columns
    assert len(rows) == len({norm(t) for _, t in EDGES})
    assert exact_dedup.keep_documents(documents(spark, [])).count() == 0
    assert exact_dedup.exact_dedup(documents(spark, [])).count() == 0


def measured(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = {w: windows.count(w) for w in set(windows)} if len(windows) < 5000 else {}
    again = {i + k for i, w in enumerate(windows) if count.get(w, 0) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(again),
        "n_plain_words": sum(bool(re.search(r"[0-9A-Za-z]|[^\x00-\x7F]", w)) for w in words),
        "n_digits": sum(c in "0123456789" for c in text or ""),
        "n_bullet_lines": sum(x.lstrip(" \t\n\r\v\f")[0] in "-*•" for x in lines),
    }


def test_ledger_measures(spark):
    own = [(20, "a b c d e x a b c d e"), (21, "é|é\n é|é\né|é\n\n"), (22, "a " * 40), (23, "x y z v w\nx y z v w\n" * 2), (24, "- a 1\n\t• é2\n * \n…\n-"), (25, "•"), (26, "12 3é | â€\n-")]
    rows = [r for r in EDGES if r[1] is None or len(r[1]) < 1000] + own
    got = quality.ledger(documents(spark, rows)).collect()
    want = sorted((str(i), sorted(measured(t).items())) for i, t in rows)
    assert sorted((str(r.doc_id), sorted((m, r[m]) for m in quality.MEASURES)) for r in got) == want
    assert quality.ledger(documents(spark, [])).count() == 0


def test_policies_and_ablation(spark):
    docs = documents(spark, [(1, "few words"), (2, "a b c d e " * 20), (3, " ".join(f"word{i}" for i in range(30))), (4, "# " * 4)])
    rows = quality.ledger(docs).cache()
    assert [r.doc_id for r in quality.apply_policy(rows, "v1").filter("kept").collect()] == [3]
    assert [r.doc_id for r in quality.apply_policy(rows, ("few_words",)).filter("kept").orderBy("doc_id").collect()] == [2, 3]
    table = {r.rule: (r.n_failed, r.n_only) for r in quality.ablation(rows).collect()}
    assert table["few_words"][0] == 2 and table["few_words"][1] == 1 and set(table) == set(quality.POLICIES["v2"])
    words = [" ".join(f"w{i}x{j}" for j in range(9)) for i in range(6)]
    more = documents(spark, [(1, "| ".join(words)), (2, " | ".join(" ".join(words).split())), (3, "\n- ".join(["", *words])), (4, "1234 567 x " * 2 + "99 8 " * 9), (5, "\n".join(words))])
    bits = {r.doc_id: r.fail_bits for r in quality.ledger(more).collect()}
    assert not bits[1] and bits[2] & quality.bit("marks") and bits[3] & quality.bit("bullet_lines") and bits[4] & quality.bit("digits") and not bits[5]
    assert {r.doc_id for r in quality.keep_documents(more).collect()} == {1, 5}
    kept = quality.keep_documents(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [3]
    assert {(r.n_failed, r.n_only) for r in quality.ablation(quality.ledger(documents(spark, []))).collect()} == {(0, 0)}


def test_license_edges(spark):
    apache = "licensed, under the APACHE license 2.0"  # six of seven words
    own = [(30, f"first line\n{apache}\nlast"), (31, "CC-BY cc by, All rights\nreserved"), (32, "xcc by ccby cc bye"), (33, "licensed under the sun version 2")]
    rows = {r.doc_id: r for r in license.scan(documents(spark, EDGES + own)).collect() if r.doc_id is not None}
    assert rows[30].labels == "apache-notice" and 0.8 <= rows[30].score < 1 and rows[30].n_base == 0 and rows[30].first_word is None
    assert (rows[31].base_labels, rows[31].n_base, rows[31].first_word, rows[31].last_word, rows[31].score) == ("cc-by,reserved", 3, 0, 4, 1.0)
    assert rows[32].n_base == 0 and rows[33].labels == "" and rows[33].score == 0
    assert rows[1].n_words == 0 and rows[1].labels == ""
    assert license.scan(documents(spark, EDGES)).count() == len(EDGES) and license.scan(documents(spark, [])).count() == 0


def test_short_notices_get_labels(spark):
    short = {
        "Released under the MIT License.": "mit-short", "This is licensed under the MIT license": "mit-short", "// SPDX-License-Identifier: MIT": "mit-spdx",
        "Released under the BSD 3-Clause License.": "bsd-3-clause", "BSD License": "bsd-short", "MIT License\n\nCopyright": "mit-short", "Licensed under the GPL v3": "gpl-short", "ISC License": "isc-short", "SPDX-License-Identifier: BSD-2-Clause": "bsd-spdx",
        "subject to the Mozilla Public License, v. 2.0": "mpl-short", "Licensed under the Apache License, Version 2.0.": "apache-notice", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-notice",
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-notice", "Released under the Sun License.": "", "taught at MIT, no license": "",
    }
    docs = documents(spark, [(i, f"some words\n\n{t}\n") for i, t in enumerate(short)])
    rows = {r.doc_id: r for r in license.scan(docs).collect()}
    assert [rows[i].labels for i in range(len(short))] == list(short.values())
    assert all((rows[i].score > 0) == bool(label) for i, label in enumerate(short.values()))


@pytest.mark.parametrize("width", [25, 70, 80])
@pytest.mark.parametrize("lead", ["", "# "])
def test_wrapped_notices_get_labels(spark, width, lead):
    long = {k: v for k, v in license.TEMPLATES.items() if len(v) > width}
    lines = {k: ("\n" + lead).join(textwrap.wrap(f"{'Copyright 2020 some one else.'} {v} and more words.", width)) for k, v in long.items()}
    docs = documents(spark, [(i, f"words\n\n{lead}{t}\n{lead}last words\n") for i, t in enumerate(lines.values())])
    docs = docs.union(documents(spark, [(100, "Permission is hereby granted, free of charge,\n\nto any person obtaining a copy of\n\nthis software and associated documentation files")]))
    rows = {r.doc_id: r for r in license.scan(docs).collect()}
    assert all("\n" in t for t in lines.values()) and rows[100].labels == ""
    assert [i for i, k in enumerate(lines) if k not in rows[i].labels.split(",")] == []


SCATTERED = [
    "Students at MIT work under " + " ".join(f"word{i}" for i in range(150)) + " the driving license",
    "The public library in Mozilla Square needs a license.",
    "Apache helicopters, " + "and more words here " * 5 + "licensed to carry 2.0 tons, a version " + "of many words " * 5 + "under the license",
    "license MIT and the license of GPL under it",
    "the MIT " + "x " * 30_000 + "License",
]


def test_scattered_template_words_have_no_label(spark):
    rows = license.scan(documents(spark, list(enumerate(SCATTERED)))).collect()
    assert [(r.labels, r.score) for r in rows] == [("", 0.0)] * len(SCATTERED)


def test_license_blocks_equal_sql(spark):
    wrapped = ["\n".join(textwrap.wrap(f"words before it {v} and after", w)) for v in license.TEMPLATES.values() for w in (20, 60)]
    dropped = [" ".join(w for i, w in enumerate(v.split()) if i % 7 != 3) for v in license.TEMPLATES.values()]
    mixed = [" x ".join(v.split()) for v in license.TEMPLATES.values()] + [" ".join(sorted(v.split())) for v in license.TEMPLATES.values()]
    crowd = ["MIT license " * 2000 + LONG]
    texts = [(i, t) for i, t in enumerate([*wrapped, *dropped, *mixed, *SCATTERED, *crowd, None, "", "\n\n"])]
    got = {tuple(r) for r in license.scan(documents(spark, texts)).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    assert got == set(con.execute(SQL_OP1).fetchall()) and len({r[6] for r in got}) > 15
