"""Secrets, personal data and licences against plain loops."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest

from feedloom.llm import licence_scan, pii, secret_scan

# ---- secrets ----


def secrets_by_hand(text):
    text, out = text or "", []
    for number, rule in enumerate(secret_scan.BASE + secret_scan.MORE):
        pattern = "[0-9a-f]+" if rule.kind == "hex" else rule.pattern.replace("(?i:", "(?ai:") if "(?i:" in rule.pattern else rule.pattern
        least = 16 if rule.kind == "hex" else rule.least
        out += [(m.start(), number, m.end(), rule.kind) for m in re.finditer(pattern, text) if len(m[rule.group]) >= least]
    return sorted(out)


def secret_texts(n):
    rng = random.Random(5)
    bits = ["password", "PassWD", "token", "api_key", "APIKEY", "secret", '"', "'", " ", ":", "=", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "x", "é", "漢", "😀", "\n", "abcDEF123+/_.=-", "ghp_" + "a1" * 18, "-----BEGIN RSA PRIVATE KEY-----", "xoxb-1234567890ab", "://u:p@", "http"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(n)]


def test_trigram_queries():
    query = {r.kind: secret_scan.trigram_query(r.pattern) for r in secret_scan.BASE + secret_scan.MORE}
    assert query["hex"] == [] and query["access"] == [frozenset({"aki", "kia"})]
    assert len(query["assign"]) == 6 and frozenset({"tok", "oke", "ken"}) in query["assign"]
    assert all(query[r.kind] for r in secret_scan.MORE)
    for text in secret_texts(4000):  # a match never lacks its query
        for rule in secret_scan.BASE + secret_scan.MORE:
            for m in re.finditer(rule.pattern, text):
                sets = query[rule.kind]
                assert not sets or any(all(t in m[0].lower() for t in s) for s in sets), (rule.kind, m[0])


@pytest.mark.parametrize("pattern, sets", [("abc|xyz", [{"abc"}, {"xyz"}]), ("ab?cde", [{"abc", "bcd", "cde"}, {"acd", "cde"}]), ("a.c", []), ("(abc)+d", [{"abc", "bcd"}]), ("ab[0-9]cd", []), ("abc|d", []), ("abcd{2}", [{"abc", "bcd", "cdd"}])])
def test_trigram_query_forms(pattern, sets):
    got = secret_scan.trigram_query(pattern)
    if pattern == "(abc)+d":
        assert got == [frozenset({"abc", "bcd"})] or got == [frozenset({"abc"})] or all({"abc"} <= s for s in got)
    else:
        assert sorted(got, key=sorted) == sorted(map(frozenset, sets), key=sorted)


def test_secrets(spark, documents, odd_docs, no_docs):
    made = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(secret_texts(600))], "doc_id long, text string")
    docs = documents.select("doc_id", "text").union(made).union(odd_docs.select("doc_id", "text")).union(made.limit(5))
    want = [(r.doc_id, secrets_by_hand(r.text)) for r in docs.collect()]
    got = [(r.doc_id, [tuple(s) for s in r.spans]) for r in secret_scan.scan_secrets(docs.selectExpr("*", "'x' as kinds", "'x' as spans")).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert secret_scan.scan_secrets(no_docs).count() == 0


def test_secret_plan_is_native(spark, documents, capsys):
    secret_scan.scan_secrets(documents).explain("formatted")
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


# ---- personal data ----

BASE_PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn_by_hand(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_by_hand(text):
    out = []
    for kind, pattern in enumerate(BASE_PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == 0 or kind == 1 and all(int(p) <= 255 for p in m[0].split(".")) or kind == 2 and 16 <= len(digits) <= 19 and luhn_by_hand(digits) or kind == 3 and 8 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans():
    rng = random.Random(1)
    for _ in range(15_000):
        text = "".join(rng.choice("a.@+-()  0123456789%é") for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == base_by_hand(text), text
    bits = ["a.b", "@", "x.com", "+1 ", "4736962573099581 ", "4736 9625 7309 9581", " ", ".", "255.1.2.3", "-9", "(017)", "12", "a", "999.1.1.1"]
    for _ in range(8000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == base_by_hand(text), text


def test_long_texts_stay_fast():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "+1" + "(" * 200_000, "@" * 100_000, "1 " * 150_000):
        pii.chosen_spans(text, pii.fit_forest(np.zeros((0, len(pii.FEATURES))), np.zeros(0, int), pii.Settings()))


def test_forest_learns_and_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, len(pii.FEATURES)))
    y = ((x[:, 2] > 0.2) & (x[:, 5] < 0.5) | (x[:, 7] > 1.5)).astype(int)
    settings = pii.Settings(trees=40)
    forest = pii.fit_forest(x[:2000], y[:2000], settings)
    p = forest.predict(x[2000:])
    assert ((p >= 0.5) == y[2000:]).mean() > 0.97
    cut = pii.calibrated(forest, x[2000:], y[2000:], settings)
    assert 0.5 <= cut <= 1 and y[2000:][p >= cut].mean() >= settings.precision
    assert pii.calibrated(forest, x[2000:], 0 * y[2000:], settings) == settings.never
    flat = pii.fit_forest(x, 0 * y, settings)
    assert np.allclose(flat.predict(x), flat.predict(x)[0])


def test_pii_over_a_table(spark, documents, odd_docs, no_docs):
    rng = random.Random(2)
    made = []
    for i in range(400):
        number = f"({rng.randrange(900):03d}) 555-{rng.randrange(10000):04d}"
        made.append((10**6 + i, f"call tel {'+1 ' if i % 2 else ''}{number} now, or a{i} (at) mail{i} (dot) example.com; order {rng.randrange(10**7, 10**8)}"))
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string")).union(odd_docs.select("doc_id", "text"))
    forest = pii.train(docs)
    again = pii.train(docs.repartition(3))
    assert forest.thresholds == again.thresholds and np.array_equal(forest.leaves, again.leaves)
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = pii.find_pii(docs, forest, redact=True).collect()
    assert len(got) == len(texts)
    found = sorted(((r.doc_id, [(s["kind"], s["start"], s["end"]) for s in r.spans if s["kind"] in pii.BASE]) for r in got), key=repr)
    assert found == sorted(((i, [(pii.KINDS[k], a, b) for k, a, b in base_by_hand(t)]) for i, t in texts), key=repr)
    assert all([s["kind"] for s in r.spans] == sorted((s["kind"] for s in r.spans), key=pii.KINDS.index) for r in got)
    for r in got:
        assert not base_by_hand(r.redacted)
    for r in got:  # beside base matches, chosen spans do not overlap
        ends = sorted((s["start"], s["end"]) for s in r.spans if s["kind"] in pii.MORE)
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    assert pii.find_pii(odd_docs, forest).columns == ["doc_id", "spans"]
    assert pii.find_pii(no_docs, pii.train(no_docs)).count() == 0


def planted(kind, rng):
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    return {
        "address": lambda: rng.choice([f"jo.{d(2)} (at) mail{d(1)} (dot) example (dot) org", f"ann{d(2)}[at]post{d(1)}.example.com", f"{'x' * 80}.{d(2)} [at] mail [dot] example [dot] com"]),
        "local": lambda: rng.choice([f"({d(3)}) 555-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) 555 {d(4)}"]),
        "date": lambda: rng.choice([f"20{d(2)}-0{rng.randrange(1, 9)}-1{d(1)}", f"1{d(1)}.0{rng.randrange(1, 9)}.19{d(2)}"]),
        "count": lambda: f"{rng.randrange(1, 10)}{d(rng.randrange(6, 15))}",
        "price": lambda: f"at (at) {d(3)}.{d(2)}",
    }[kind]()


def test_planted_personal_data(spark):
    """Disguised data that no base rule knows is found in texts the trees never saw, and other numbers are left alone."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    forest, rng = pii.train(docs), random.Random(8)
    texts = [r.text for r in docs.where("doc_id % 50 = 7").collect() if r.text and len(r.text.split()) > 20]
    share = {}
    for kind in ("address", "local", "date", "count", "price"):
        hits = 0
        for _ in range(200):
            words, span = rng.choice(texts).split()[:20], planted(kind, rng)
            text = " ".join(w for w in words[:10] if not re.search("[0-9+]", w)) + " " + span + " then " + " ".join(words[10:])
            hits += any(k > 3 and text[a:b] == span for k, a, b in pii.chosen_spans(text, forest))
        share[kind] = hits / 200
    assert share["address"] >= 0.9 and share["local"] >= 0.9, share
    assert max(share["date"], share["count"], share["price"]) <= 0.05, share
    extra = [s for r in pii.find_pii(docs, forest).collect() for s in r.spans if s["kind"] in pii.MORE]
    assert len(extra) <= 10


def test_disguises_are_proposed():
    """What the trees learn as label 1 is what a generator proposes, whole, and no base rule accepts it."""
    for k, span in ((0, "jo.smith@mail.example.com"), (2, "4736962573099581"), (3, "+1 (017) 555-7713"), (3, "+49 30 1234567")):
        for new in pii.disguises(k, span):
            assert any((a, b) == (5, 5 + len(new)) for _, a, b in pii.proposals(f"word {new} word")), new
            assert k not in [x[0] for x in pii.base_spans(f"word {new} word")]
    assert pii.disguises(1, "10.1.2.3") == []
    text = "x" * 200_000 + " (at) mail" + ".x" * 1000
    assert pii.proposals(text) == [(4, 0, len(text))]  # no proposal is cut


# ---- licences ----


def licences_by_hand(files, stand_in=True):
    words = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if w]
    vocabulary = {w for t in licence_scan.TEMPLATES for w in words(t.text)}
    df = collections.Counter(w for _, t in files for w in set(words(t or "")) & vocabulary)
    idf = lambda w: math.log((1 + len(files)) / (1 + df[w])) + 1

    def vector(text):
        raw = {w: n * idf(w) for w, n in collections.Counter(words(text)).items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        return {w: v / norm for w, v in raw.items()}

    templates = [(t.license, vector(t.text), set(t.must)) for t in licence_scan.TEMPLATES]
    own = {}
    for path, text in files:
        named = path is not None and re.search(licence_scan.FILE_NAMES, path.lower())
        for unit in [*(text or "").split("\n"), *([text or ""] if named else [])]:
            if words(unit):
                v = vector(unit)
                for name, t, must in templates:
                    score = round(sum(x * t.get(w, 0) for w, x in v.items()), 9)
                    if score >= licence_scan.THRESHOLD and must <= v.keys():
                        own[path, text] = min(own.get((path, text), (0, "")), (-score, name))
    folder = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    held = {}
    for (path, _), (minus, name) in own.items():
        if path is not None:
            named = bool(re.search(licence_scan.FILE_NAMES, path.lower()))
            if named or stand_in:
                order = (0, minus, path, name, minus) if named else (1, 0, path, name, minus)
                held[folder(path)] = min(held.get(folder(path), (9,)), order)
    out = []
    for path, text in files:
        row = (path, None, None, None, None)
        if (path, text) in own:
            minus, name = own[path, text]
            row = (path, name, -minus, "own", path)
        elif path is not None:
            d = folder(path)
            while True:
                if d in held:
                    row = (path, held[d][3], -held[d][4], "stand_in" if held[d][0] else "inherited", held[d][2])
                    break
                if not d:
                    break
                d = folder(d)
        out.append(row)
    return sorted(out, key=repr)


@pytest.mark.parametrize("stand_in", [True, False])
def test_licences(spark, stand_in):
    rng = random.Random(6)
    lines = [t.text for t in licence_scan.TEMPLATES] + ["SPDX-License-Identifier: Zlib", "MIT", "license", "the license", "nothing here", "", "public version of the work", "Licensed under the Apache License 2.0"]
    files = []
    for _ in range(150):
        path = "/".join(rng.choice("abc") for _ in range(rng.randrange(5))) + "/" + rng.choice(["x.c", "y.c", "LICENSE", "COPYING.txt", "z"])
        files.append((path.lstrip("/"), "\n".join(rng.choice(lines) if rng.random() < 0.12 else "plain words of a file" for _ in range(rng.randrange(5)))))
    files = list(dict(files).items()) + [(None, "Released under the MIT License."), (None, "x"), ("n", None), ("a/n", ""), ("a/long", "word " * 30_000)]
    files += files[:3]
    df = spark.createDataFrame(files, "path string, text string").selectExpr("*", "'x' as license", "'x' as folder", "'x' as line")
    got = licence_scan.scan_licences(df, stand_in=stand_in)
    assert got.columns == ["path", "license", "score", "origin", "source"]
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    want = licences_by_hand(files, stand_in)
    assert [(r[0], r[1], r[3], r[4]) for r in rows] == [(r[0], r[1], r[3], r[4]) for r in want]
    assert all((a[2] is None) == (b[2] is None) and (a[2] is None or abs(a[2] - b[2]) < 1e-8) for a, b in zip(rows, want))
    assert licence_scan.scan_licences(df.limit(0)).count() == 0


def test_anchors_lose_nothing():
    idf = {w: 1 + (len(w) % 5) for t in licence_scan.TEMPLATES for w in licence_scan.template_words(t.text)}
    vectors = licence_scan.weigh_templates(licence_scan.TEMPLATES, idf)
    chosen = set(licence_scan.anchors(vectors, 0.75, [t.must for t in licence_scan.TEMPLATES]))
    for v, t in zip(vectors, licence_scan.TEMPLATES):
        assert chosen & set(t.must) if t.must else math.sqrt(sum(x * x for w, x in v.items() if w not in chosen)) < 0.75


def test_usual_forms_are_recognised(spark):
    """Tags, titles and first lines of licence texts; names of other licences are left alone."""
    want = {
        "SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "# SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0", "MIT License": "MIT", "The MIT License (MIT)": "MIT",
        "This file is released under the MIT License.": "MIT", "                                 Apache License": "Apache-2.0", "BSD 3-Clause License": "BSD-3-Clause",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal': "MIT",
        "Permission to use, copy, modify, and/or distribute this software for any": None, "SPDX-License-Identifier: Zlib": None, "SPDX-License-Identifier: BSD-4-Clause": None, "MIT": None, "License": None,
        "a driving license from mit": None, "public": None, "GNU General Public License v1.0": None,
    }
    rows = [(f"d{i}/f.c", f"int x;\n{line}\nint y;") for i, line in enumerate(want)] + [(f"p{i}/g.c", "plain words here") for i in range(60)]
    got = {r.path: r.license for r in licence_scan.scan_licences(spark.createDataFrame(rows, "path string, text string"), stand_in=False).collect()}
    assert {line: got[f"d{i}/f.c"] for i, line in enumerate(want)} == want
    whole = spark.createDataFrame([("a/LICENSE", "MIT License\n\nCopyright (c) 2020 X\n"), ("a/b/c.py", "x = 1"), ("d.py", "y")], "path string, text string")
    assert {(r.path, r.license, r.origin) for r in licence_scan.scan_licences(whole).collect()} == {("a/LICENSE", "MIT", "own"), ("a/b/c.py", "MIT", "inherited"), ("d.py", None, None)}


def test_licence_plan_is_native(spark, documents, capsys):
    licence_scan.scan_licences(documents.selectExpr("source || '/' || doc_id as path", "text")).explain("formatted")
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
