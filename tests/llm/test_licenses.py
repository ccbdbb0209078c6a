import re
from collections import Counter

from loamspark.llm import licenses

SMALL = "/root/testdata/sf0.01"


PROBES = [
    ("MPL", "Mozilla Public License, version 2.0"),
    ("AGPL", "Licensed under the GNU Affero General Public License, version 3."),
    ("LGPL", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "This library is released under the MIT license, see below."),
    ("GPL", "You may copy it under the terms of the GNU General Public License version 2 as published."),
    ("GPL", "Released under GPL v3."),
    ("CC-BY", "Available under CC BY 4.0."),
    ("CC-BY-NC", "Released under CC BY-NC 4.0."),
    ("Apache-2.0", "Distributed under Apache 2.0."),
    ("BSD", "Distributed under BSD 3-Clause terms."),
    ("proprietary", "Unauthorized copying of this file is strictly prohibited."),
    (None, "A driving license costs forty dollars in this county."),
    (None, "Copyright law is a field of study."),
    (None, "The licence of the pub was renewed after a long quarrel with the neighbours."),
    (None, "Permission to enter the copyright office is granted by the guard."),
    (None, "She has a license to kill, and a degree from MIT."),
    (None, "This is it."),
]


def test_probes_and_prose(spark):
    rows = [*PROBES, *((None, t) for t in licenses.PROSE), *((f, t) for f, group in licenses.TEMPLATES.items() for t in group if len(t.split()) < 12)]
    docs = spark.createDataFrame([(k, f"Some prose of no interest here.\n{t}\nMore prose.", "own") for k, (_, t) in enumerate(rows)], "doc_id long, text string, family string")
    out = {r["doc_id"]: r for r in licenses.licenses(docs).collect()}
    assert {k: out[k]["family"] for k in out} == {k: f for k, (f, _) in enumerate(rows)}
    assert all(r["n_paragraphs"] == 3 and [s["paragraph"] for s in r["license_spans"]] == [1] * len(r["license_spans"]) for k, r in out.items() if rows[k][1].endswith("."))


def brute(text):
    """For tests: (paragraph, family, probability, confirmed) by plain Python and numpy, on every paragraph, without anchors."""
    model, out = licenses.trained(), []
    text = re.sub(licenses.WRAPPED, r"\1 ", re.sub(licenses.COMMENT, "", text or ""))
    for k, line in enumerate(x for x in re.split(r"\r?\n", text) if x.strip(" ")):
        cuts = licenses.windows(licenses._words(line)) or [[]]
        p = model.probabilities(cuts)
        best = min(range(len(cuts)), key=lambda i: (not (p[i].argmax() and p[i].max() >= licenses.CERTAIN), -p[i].max(), i))
        if p[best].argmax() and p[best].max() >= licenses.CERTAIN:
            w, family = cuts[best], model.classes[p[best].argmax()]
            shingles = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
            out.append((k, family, round(float(p[best].max()), 5), len(shingles & set(model.shingles(family))) >= 0.8 * len(shingles)))
    return out


WRAPPED = """# Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the "Software"), to deal
# in the Software without restriction, including without limitation the rights
# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
# copies of the Software, and to permit persons to whom the Software is
# furnished to do so, subject to the following conditions:

Some prose about a garden."""


def test_equals_brute_force(spark, awkward):
    rows = [WRAPPED, None, "", *(t for _, t in PROBES), "word " * 5000 + "Licensed under the MIT License. " + "word " * 5000, "\n".join(t for _, t in PROBES), "mit license\r\ngpl\r\n"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").unionByName(awkward.select("doc_id", "text"))
    for r in licenses.licenses(docs).select("text", "license_spans").collect():
        got = [(s["paragraph"], s["family"], round(s["probability"], 5), s["confirmed"]) for s in r["license_spans"]]
        want = brute(r["text"])
        assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want]
        assert all(abs(x[2] - y[2]) < 1e-4 for x, y in zip(got, want, strict=True))
    assert brute(WRAPPED)[0][1::2] == ("MIT", True)


def test_held_out_accuracy_and_calibration():
    model = licenses.trained()
    p, y = model._soft(model.held / model.temperature), model.held_class
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    assert right.mean() > 0.9
    bins = [(top > a / 10) & (top <= (a + 1) / 10) for a in range(10)]
    assert sum(abs(right[b].mean() - top[b].mean()) * b.mean() for b in bins if b.any()) < 0.03
    assert ((p.argmax(axis=1) > 0) & (top >= licenses.CERTAIN))[y == 0].mean() < 0.03


def test_text_without_anchors_has_no_feature():
    model = licenses.trained()
    assert all(licenses.anchored(g) for g in model.vocabulary)
    assert model.bias.argmax() == 0


def test_whole_table(spark):
    """Every notice line of the table is found, confirmed, and no other line is."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    known = {t: f for f, group in licenses.TEMPLATES.items() for t in group}
    out = {r["doc_id"]: r for r in licenses.op3_licenses(spark, SMALL).collect()}
    assert out.keys() == docs.keys()
    n = 0
    for i, t in docs.items():
        want = Counter(known[x] for x in (t or "").split("\n") if x in known)
        got = [(x["paragraph"], x["family"], x["confirmed"]) for x in out[i]["license_spans"]]
        assert got == [(k, f, sure) for k, f, _, sure in brute(t)]
        assert want <= Counter(f for _, f, _ in got)
        n += want.total()
    assert n


def test_awkward_and_empty(spark, awkward, no_docs):
    rows = licenses.licenses(awkward).collect()
    assert len(rows) == awkward.count() and all(r["family"] is None for r in rows)
    assert licenses.licenses(no_docs).collect() == []
