import random
import re

from cases import frame, odd_texts

from textlake.llm import license_scan

PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
TEXTS = [
    *odd_texts(),
    "MIT License",
    "mit, license; MIT-LICENSE mit license",
    "summit license, mit licensed, mit x license",
    "Licensed under the Apache License, Version 2.0.\nunder the apache license",
    "This work is licensed under the GNU General Public License, version 3.",
    "General Public Licensé and General Publicé License",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "Permission is hereby granted free of charge to any human obtaining a copy of this software",
    "Permission is hereby granted, for a charge, to any person obtaining a copy of this software",
    "word " * 5000 + "apache license " + "word " * 5000 + "general public license",
    "license mit license apache license general public license",
    "2.0 apache license version",
]


def base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, k) for k, p in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({k for _, k in places})))


def scanned(spark, texts=TEXTS):
    docs = frame(spark, texts)
    got = license_scan.scan(docs).collect()
    return docs.collect(), got


def test_base_columns(spark):
    docs, got = scanned(spark)
    want = sorted([(r["doc_id"], *base(r["text"])) for r in docs], key=repr)
    assert sorted([tuple(r)[:6] for r in got], key=repr) == want
    for r in got:
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
        assert (r["score"] == 1.0) or not r["n_base"]


def test_own_labels(spark):
    _, got = scanned(spark)
    labels = {r["doc_id"]: r["labels"] for r in got}
    by = {TEXTS[i]: x for i, x in labels.items() if i is not None}
    assert by[TEXTS[-9]] == "apache,apache-2.0"
    assert by[TEXTS[-8]] == "gpl,gpl-3.0"
    assert by[TEXTS[-6]] == "mit"
    assert by[TEXTS[-5]] == "mit"  # a word of the notice differs, no mandatory one
    assert by[TEXTS[-4]] == ""  # a mandatory phrase is broken
    assert by["one"] == ""


def test_no_place_at_the_threshold_is_missed(spark):
    notice = "not use this file except in compliance with the license you may obtain a copy of the license at"
    common = {w: 50 for _, text, _ in license_scan.TEMPLATES for w in text.split()} | {"you": 40, "may": 40}
    docs = frame(spark, [f"Users must {notice}", notice])  # its two rarest words altered, and cut off
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(docs, (100, common)).collect()}
    assert [got[i][0] for i in (0, 1)] == ["apache-2.0"] * 2 and all(0.8 <= got[i][1] < 1 for i in (0, 1))


GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
# Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."""
MIT = license_scan.PARAGRAPHS[0][1]


def test_notices_paragraphs_and_identifiers(spark):
    inserted = MIT.replace("without limitation", "without any limitation")
    texts = {
        GPL: "gpl,gpl-3.0",
        GPL.replace("version 3", "version 2"): "gpl,gpl-2.0",
        "// SPDX-License-Identifier: MIT": "mit",
        "SPDX-License-Identifier: BSD-3-Clause\nx": "bsd,bsd-3-clause",
        "SPDX license identifier": "",
        "MIT identifier license spdx": "",
        inserted[inserted.index("documentation") :]: "mit",  # begins inside a paragraph, with a further word
        license_scan.PARAGRAPHS[4][1].upper(): "bsd-3-clause",
        "The origin of this software": "",
    }
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(frame(spark, list(texts))).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def brute_labels(text, weights, least=0.8):
    """Every template at every place, without an index."""
    rows, found = weights
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(license_scan.SEPARATORS, low) if w]
    labels = set()
    for _, label, template, phrases, base in license_scan._templates():
        share = [license_scan._idf(rows, found.get(w, 0)) for w in template]
        for start in range(-len(template), len(words)):
            here = [words[start + i] if 0 <= start + i < len(words) else None for i in range(len(template))]
            score = sum(s for s, a, b in zip(share, here, template, strict=True) if a == b) / sum(share)
            seen = " ".join(h for h in here if h is not None)
            if (here == template if base else score >= least) and all(f" {' '.join(p)} " in f" {seen} " for p in phrases):
                labels.add(label)
    return ",".join(sorted(labels))


def test_labels_of_altered_notices_by_brute_force(spark):
    rnd = random.Random(8)
    texts = []
    for _, _, template, _, _ in license_scan._templates():
        for altered in (0, 1, 2, 4):
            words = list(template)
            for _ in range(altered):
                words[rnd.randrange(len(words))] = rnd.choice(["software", "the", "license", "other"])
            texts.append(" ".join(rnd.choices(["some", "the", "free"], k=rnd.randrange(4)) + words[rnd.randrange(2) :] + ["end"]))
    docs = frame(spark, texts)
    weights = license_scan.word_weights(docs)
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(docs, weights).collect() if r["doc_id"] is not None}
    want = {r["doc_id"]: brute_labels(r["text"], weights) for r in docs.collect() if r["doc_id"] is not None}
    assert got == want and len({x for x in want.values()}) > 20


def test_empty_table(spark):
    assert scanned(spark, [])[1] == []


def test_weights_fall_with_the_number_of_documents(spark):
    rows, found = license_scan.word_weights(frame(spark, ["license"] * 9 + ["mit license"]))
    assert rows == 12 and found["license"] == 11 and found["mit"] == 2  # with the rows that frame() adds
