import numpy as np

from tests.llm.helpers import edge_docs, empty_docs
from veilwatch.llm import licences as L

SF = "/root/testdata/sf0.1"
# The notices in the given documents.
NOTICES = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "Released under the MIT License.": "mit",
           "This work is licensed under the GNU General Public License, version 3.": "gpl",
           "Licensed under the Apache License, Version 2.0.": "apache", "All rights reserved.": "proprietary"}


def test_notices_in_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {(r["doc_id"], r["paragraph"]): r["family"] for r in L.scan(docs).collect()}
    want = {(d, k): NOTICES[x] for d, t in docs.select("doc_id", "text").collect()
            for k, x in enumerate(t.split("\n")) if x in NOTICES}
    assert len(want) > 100 and got == want


def test_families_and_unknown(spark):
    sample = [x.encode() for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(200).collect()
              for x in r[0].split("\n")][:1500]
    model = L.train(sample)
    lines = [t.encode() for some in L.TEMPLATES.values() for t in some]
    named = {k: f for k, f, _, _ in model.scan(lines)}
    want = [f for f, some in L.TEMPLATES.items() for _ in some]
    assert np.mean([named.get(k) == f for k, f in enumerate(want)]) > 0.95
    held = [b"   This module is licensed under the MIT License; see the file.", b"(c) 2020 X. All Rights Reserved!",
            b"the licence fee for the boat is due in May", b"apache helicopters reserved the right to land",
            b"licensed under the Quux Community Licence 7", b"", b"of the and in to a"]
    found = {k: f for k, f, _, _ in model.scan(held)}
    assert found.get(0) == "mit" and found.get(1) == "proprietary"
    assert all(found.get(k, L.UNKNOWN) == L.UNKNOWN for k in range(2, len(held)))
    assert not {5, 6} & set(found)


def test_calibrated_on_held_out_half(spark):
    sample = [x.encode() for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(200).collect()
              for x in r[0].split("\n")][:1500]
    model = L.train(sample)
    lines, labels = L._examples(sample, 99)
    p = L._softmax(model.logits(lines) / model.temperature)
    right = p.argmax(axis=1) == labels
    assert right.mean() > 0.95 and abs(p.max(axis=1).mean() - right.mean()) < 0.05


def test_edge_rows(spark):
    docs = edge_docs(spark)
    extra = spark.createDataFrame([(500, "first\n\n  Released under the MIT License.", None, None, None)] * 2
                                  + [(None, "Licensed under the Apache License, Version 2.0", "en", "a", 3)],
                                  docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    both = docs.unionByName(extra, allowMissingColumns=True)
    got = sorted((r["doc_id"] or -1, r["paragraph"], r["family"]) for r in L.scan(both).collect())
    assert got == [(-1, 0, "apache"), (500, 2, "mit"), (500, 2, "mit")]


def test_empty_table(spark):
    assert L.scan(empty_docs(spark)).count() == 0


def test_notices_over_line_breaks(spark):
    gpl = ["This program is free software; you can redistribute it and/or modify",
           "it under the terms of the GNU General Public License as published by",
           "the Free Software Foundation; either version 2 of the License, or", "(at your option) any later version."]
    bsd = ["Copyright (c) 2020 X", "Redistribution and use in source and binary forms, with or without",
           "modification, are permitted provided that the following conditions are met:"]
    cc = ["the text is", "licensed under a Creative Commons", "Attribution 4.0", "International License"]
    texts = ["\n".join(gpl), "\n".join(f" * {x}" for x in gpl), "\n".join(f"dnl {x}" for x in gpl),
             "\n".join(f"# {x}" for x in bsd), "\n".join(f"// {x}" for x in cc), "\n".join([*bsd[:2], "", bsd[2]]),
             "Released under the MIT\n\nLicense", "Released under\nthe MIT License", "Released under the MIT"]
    docs = edge_docs(spark, clashing=False).select("doc_id", "text").unionByName(
        spark.createDataFrame([(1000 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    rows = [r for r in L.scan(docs).collect() if r["family"] != L.UNKNOWN]
    got = sorted((r["doc_id"], r["paragraph"], r["family"]) for r in rows)
    assert got == [(1000, 1, "gpl"), (1001, 1, "gpl"), (1002, 1, "gpl"), (1003, 1, "bsd"), (1004, 1, "cc-by"),
                   (1007, 0, "mit")]


def small_model(spark):
    return L.train(L.sample_lines(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))


def test_notices_inside_long_lines(spark):
    """Each template amid other words: up to 5,000 of them change nothing."""
    model = small_model(spark)
    other = [w for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
             for w in (r[0] or "").replace("\n", " ").split()][:5000]
    plain = np.zeros(1, int)
    assert [x for x in model.paragraphs([" ".join(other).encode()], plain) if x[1] != L.UNKNOWN] == []
    for size in (0, 10, 100, 1000, 5000):
        right = {}
        for family, some in L.TEMPLATES.items():
            for t in some:
                half = size // 2
                text = " ".join([*other[:half], t + ".", *other[half:size]]).encode()
                got = [(k, f) for k, f, _, _ in model.paragraphs([text], plain)]
                right.setdefault(family, []).append(got == [(0, family)])
        assert all(np.mean(x) >= 0.9 for x in right.values()), (size, right)


def test_several_notices_in_a_line(spark):
    model = small_model(spark)
    two = b"Released under the MIT License. Parts: Licensed under the Apache License, Version 2.0, see there"
    assert [x[:2] for x in model.paragraphs([two], np.zeros(1, int))] == [(0, "apache"), (0, "mit")]
    affero = [b"it under the terms of the GNU Affero General Public License as published by",
              b"the Free Software Foundation, either version 3 of the License, or"]
    assert [x[:2] for x in model.paragraphs(affero, np.zeros(2, int)) if x[1] != L.UNKNOWN] == [(0, "agpl")]
    many = b"under the terms of the GNU General Public License as published by the Free Software Foundation " * 20_000
    assert [x[:2] for x in model.paragraphs([many], np.zeros(1, int))] == [(0, "gpl")]
