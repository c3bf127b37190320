import collections
import re
import zlib

import numpy as np
import pytest
from corpora import ODD, as_set, clashing, prose

from tidewatch.llm import boosting, license_rules, licenses, quality_model, quality_rules
from tidewatch.llm.license_rules import BASE_PHRASES


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    cover = [False] * len(words)
    for i in range(len(words) - 2):
        if grams[words[i], words[i + 1], words[i + 2]] > 1:
            cover[i] = cover[i + 1] = cover[i + 2] = True
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, rep = len(words), sum(cover)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n


BASE = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def key(r):
    return [(v is not None, str(v)) for v in r]


def test_base_counts_of_odd_rows(odd):
    assert as_set(quality_rules.judge(clashing(odd)), *BASE) == sorted(((d, *base_counts(t)) for d, t, *_ in ODD), key=key)


def test_base_counts_of_repetition(documents):
    texts = ["a b c a b c", "a a a a", "a b c d a b c", "a b c\na b c\r\n\n \na b c", "x " * 300, "a b", "#a *b |c| <d> &\n#a *b |c| <d> &"]
    rows = list(enumerate(texts))
    assert as_set(quality_rules.judge(documents(rows)), *BASE) == sorted(((d, *base_counts(t)) for d, t in rows), key=key)


def test_thresholds_follow_the_group(documents):
    def noisy(i):
        return " ".join(w + ("#" if k % 2 else "") for k, w in enumerate(prose(i, 90).split()))

    rows = [(i, prose(i, 90), "en", "plain") for i in range(100)] + [(1000 + i, noisy(i), "en", "code") for i in range(100)]
    rows += [(5000, noisy(5), "en", "plain"), (5001, noisy(6), "en", "rare"), (5002, prose(7, 90), "en", "rare")]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(documents(rows)).collect()}
    assert all(kept[i] for i in range(100)) and all(kept[1000 + i] for i in range(100))
    assert not kept[5000] and kept[5001] and kept[5002]


def test_rejected_rows_go_and_columns_stay(odd):
    table = clashing(odd)
    kept = quality_rules.without_rejected(table)
    assert kept.columns == table.columns
    verdicts = collections.Counter(str(r.doc_id) for r in quality_rules.judge(table).where("kept").collect())
    assert collections.Counter(str(r.doc_id) for r in kept.collect()) == verdicts and verdicts["6"] == 1


def test_no_python_on_the_main_path(odd):
    plan = quality_rules.judge(odd)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_empty_tables(empty, spark):
    assert quality_rules.judge(empty).count() == 0 and quality_rules.without_rejected(empty).count() == 0
    assert licenses.scan_licenses(empty).count() == 0
    model = quality_model.fit_quality(empty, spark.createDataFrame([], "doc_id long, quality long"))
    assert quality_model.score_quality(empty, model).count() == 0


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    places = [(i, label) for p, label in BASE_PHRASES.items() for q in [p.split()] for i in range(len(words)) if words[i: i + len(q)] == q]
    firsts = sorted(i for i, _ in places)
    return len(words), len(places), firsts[0] if firsts else None, firsts[-1] if firsts else None, ",".join(sorted({x for _, x in places}))


LICENSE_TEXTS = [
    ("Released under the MIT License.", "mit"), ("under-the\nMIT (license); under the mit license", "mit"),
    ("Licensed under the Apache License, Version 2.0 (the terms)", "apache-2"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("CC BY-NC-SA 4.0", "cc-by-nc"), ("licensed under cc by nc sa 4.0", "cc-by-nc,cc-by-nc-sa"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"), ("GNU Lesser General Public License v2.1", "lgpl-2.1"),
    ("released under the GNU Lesser General Public License v2.1", "lgpl-2.1"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2"), ("under the terms of the Mozilla Public License 2.0: licensed under the MPL 2.0", "mpl-2"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of it", "mit"), ("All rights reserved.", "all-rights-reserved"),
    ("the boost to license fees, mit students, apache helicopters", ""), ("Unlicense! This is free and unencumbered software released into the public domain.", "unlicense"),
    ("creative commons zero license", "cc0"), ("ISC License", "isc"), ("License: GPLv3", "gpl-3"),
]


def test_license_labels(documents):
    found = {r.doc_id: r for r in licenses.scan_licenses(documents([(i, t) for i, (t, _) in enumerate(LICENSE_TEXTS)])).collect()}
    assert {i: found[i].labels for i in found} == {i: x for i, (_, x) in enumerate(LICENSE_TEXTS)}
    assert all(bool(r.labels) == (r.score > 0) and 0 <= r.score <= 1 for r in found.values())


def test_hundreds_of_rules_in_order():
    assert len(licenses.RULES) >= 300
    assert [r.priority for r in licenses.RULES] == sorted(r.priority for r in licenses.RULES)


def test_every_license_is_found_by_its_identifier():
    for rule in licenses.RULES[:1]:
        assert rule.priority == 1
    words = "spdx license identifier eupl 1 2".split()
    assert [r.label for r, _, _ in licenses.detections(words, set(words))] == ["eupl-1.2"]


def test_contained_detections_are_suppressed():
    words = "this is licensed under the gnu general public license version 3 and mit license".split()
    taken = licenses.detections(words, set(words))
    assert [(r.label, a, b) for r, a, b in taken] == [("gpl-3", 2, 11), ("mit", 12, 14)]


def test_base_of_odd_and_stored_rows(odd, stored):
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert as_set(licenses.scan_licenses(clashing(odd)), *columns) == sorted(((d, *brute_base(t)) for d, t, *_ in ODD), key=key)
    rows = [(r.doc_id, r.text) for r in stored.collect()]
    assert as_set(licenses.scan_licenses(stored), *columns) == sorted(((d, *brute_base(t)) for d, t in rows), key=key)


@pytest.fixture(scope="module")
def labelled(spark):
    folder = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    model = quality_model.fit_quality(docs, labels, sample=3000)
    rows = quality_model.score_quality(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = rows[rows.quality == 1].score, rows[rows.quality == 0].score
    auc = np.mean([(good > b).mean() + (good == b).mean() / 2 for b in bad])
    assert auc > 0.98
    assert (rows.predicted == (rows.score >= 0.3)).all()
    assert rows[rows.quality == 1].predicted.mean() > 0.97 and rows[rows.quality == 0].predicted.mean() < 0.2


def test_scores_of_odd_rows(odd, labelled):
    model = quality_model.fit_quality(*labelled, sample=500)
    rows = quality_model.score_quality(clashing(odd), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_held_out_labels_never_count(spark, documents):
    rows = [(i, prose(i, 40)) for i in range(300)]
    out = {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}
    honest = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality long")
    lying = spark.createDataFrame([(i, 1 - i % 2 if i in out else i % 2) for i in range(300)], "doc_id long, quality long")
    docs = documents(rows)
    a, b = (quality_model.fit_quality(docs, x) for x in (honest, lying))
    assert (a.leaf == b.leaf).all() and (a.cut == b.cut).all()


def test_trees_learn_and_constant_labels():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = boosting.fit(x, y)
    assert ((model.score(x) > 0.5) == (y == 1)).mean() > 0.97
    assert boosting.fit(x, np.ones(2000)).score(x).std() == 0
    assert boosting.fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3


def test_gates_lose_no_detection():
    """Every spelling of every name, identifier and sentence: gated and ungated runs agree."""
    texts = [(name, f"licensed under the {t}") for _, name, _, _ in license_rules.NAMES for t in license_rules.spelled(name)]
    texts += [(short, f"spdx license identifier {t}") for _, _, short, _ in license_rules.NAMES for t in license_rules.spelled(short)]
    texts += [(text, t) for _, _, _, text, _ in license_rules.SENTENCES for t in license_rules.spelled(text)]
    assert len(texts) > 800
    for pattern, text in texts:
        words = text.replace(license_rules.WILD, "3").split()
        assert re.search(rf"(?<![^ ])(?:{pattern})(?![^ ])", " ".join(words)), (pattern, text)
        ungated = licenses.detections(words, set(licenses.KEYWORDS))
        assert ungated and licenses.detections(words, licenses.KEYWORDS.intersection(words)) == ungated, text


@pytest.mark.parametrize("text, label", [
    ("Licensed under the MPLv2", "mpl-2"), ("licensed under the EPLv2", "epl-2"), ("released under LGPL3", "lgpl-3"), ("under the AGPL3 license", "agpl-3"),
    ("licensed under CDDLv1", "cddl-1"), ("covered under the EUPLv1.2", "eupl-1.2")])
def test_joined_versions(documents, text, label):
    assert licenses.scan_licenses(documents([(1, text)])).first().labels == label
