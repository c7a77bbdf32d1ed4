import math
import re
from collections import Counter

from pageloom.llm import licenses, queries
from tests.llm import cases

EXPECTED = {"MIT": "the MIT License", "Apache-2.0": "Apache License", "GPL-3.0": "GNU General", "CC-BY-NC-4.0": "CC BY-NC"}


def brute(files, least=licenses.LEAST):
    """By (path, text) of different paths: (path, license, how)."""
    terms = lambda text: Counter(re.findall(licenses.TERM, text.lower()))
    units = {}
    for path, text in files:
        whole = bool(re.search(licenses.LICENSE_FILE, path))
        own = [text] if whole and text.strip() else [x for x in text.split("\n") if re.search(licenses.HINT, x)]
        units[path] = (whole, set(own))
    corpus = [u for _, own in units.values() for u in own] + [t for _, t in licenses.TEMPLATES]
    df = Counter(t for u in corpus for t in terms(u))
    weigh = lambda u: {t: (1 + math.log(n)) * (math.log((1 + len(corpus)) / (1 + df[t])) + 1) for t, n in terms(u).items()}
    norm = lambda w: math.sqrt(sum(x * x for x in w.values()))

    def best(u):
        w = weigh(u)
        if not w:
            return (0, "")
        models = [(name, weigh(t)) for name, t in licenses.TEMPLATES]
        return min((-round(sum(x * m.get(t, 0) for t, x in w.items()) / norm(w) / norm(m), 9), name) for name, m in models)

    own = {}
    for path, (whole, us) in units.items():
        found = min((best(u) for u in us), default=(0, ""))
        if -found[0] >= least:
            own[path] = (found[1], "file" if whole else "header")
    given = {p.rpartition("/")[0]: own[p][0] for p in sorted(own) if own[p][1] == "file"}
    out = []
    for path in units:
        if path in own:
            out.append((path, *own[path]))
            continue
        folder = path.rpartition("/")[0]
        while folder not in given and folder:
            folder = folder.rpartition("/")[0]
        out.append((path, given.get(folder), "inherited" if folder in given else None))
    return sorted(out)


def test_inheritance_and_brute_force(spark):
    rows = [
        ("LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        ("a/b/COPYING.txt", "This program is free software: you can redistribute it under the terms of the GNU General Public License, either version 3"),
        ("a/b/c/d.py", "code"), ("a/x.py", "code"), ("a/b/e.py", "# SPDX-License-Identifier: Apache-2.0\ncode"), ("top.py", ""),
        ("a/bb/f.py", "no license here for birds"), ("z/LICENSE", "   "), ("z/LICENSE-x", "something else entirely"), ("a/b/NOTICE", "copyright someone"),
    ]
    got = licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()
    assert sorted((r["path"], r["license"], r["how"]) for r in got) == brute(rows)
    assert {r["path"]: (r["license"], r["how"]) for r in got}["a/b/c/d.py"] == ("GPL-3.0", "inherited")
    assert {r["path"]: r["from_dir"] for r in got}["a/x.py"] == ""


def test_documents(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in cases.documents(spark, sf).collect()}
    rows = queries.QUERIES["op6_licenses"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        named = [name for name, words in EXPECTED.items() if words in texts[r["doc_id"]]]
        assert r["license"] in named if r["how"] == "header" else not named or r["how"] == "file" or "LICENSE-" in r["path"]


def test_hard_files(spark):
    rows = [(None, "MIT License"), ("p", None), ("p", None), ("q", "x" * 100_000), (None, None)]
    frame = spark.createDataFrame(rows, "path string, text string")
    got = licenses.scan(frame).collect()
    assert len(got) == 5 and all(r["license"] is None for r in got)
    assert licenses.scan(frame.limit(0)).count() == 0
