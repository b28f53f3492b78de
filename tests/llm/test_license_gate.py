"""The gate rejects nothing that a rule matches; line ends do not hide a grant; bodies have labels."""

import random
import re

import regex

from pyspark.sql import functions as F

from slotweave.llm import licenses

TEXTS = {
    "this code is released under the mit/x11 terms": "mit",
    "see the file [mit]": "mit",
    "(wtfpl)": "wtfpl",
    "Released under\nthe MIT License": "mit",
    "licensed  under the terms\tof the\r\nGNU  Lesser General\nPublic License, version 3.0": "gpl,lgpl-3.0",
    "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "subject to the\n  following conditions:": "mit",
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n1. Redistributions": "bsd-2-clause",
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n1. x\n3. Neither the name of A": "bsd-3-clause",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice": "isc",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "as long as you retain this notice you can do whatever you want with this stuff": "beerware",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met" + " a b" * 280 + " neither the name of " + "x " * 9000: "bsd-3-clause",
    "the terms of the house are provided under stress": "",
}


def test_texts_that_no_license_word_announces(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan(docs).collect()} == dict(enumerate(TEXTS.values()))


def test_gate_and_no_gate_agree(spark, folder):
    names = [(f"released under {label} x [{label}] 'x' ({label})",) for label, *_ in licenses.FAMILIES]
    names += [(f"provided\nunder the  terms of {phrase}",) for _, phrase, _ in licenses.BODIES] + [(phrase,) for _, phrase, _ in licenses.BODIES]
    extra = spark.createDataFrame([*[(t,) for t in TEXTS], *names], "text string")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("text").union(extra).select(F.xxhash64("text").alias("doc_id"), "text").coalesce(4)
    with_gate, without = (sorted(map(tuple, licenses.scan(docs, gated).collect()), key=str) for gated in (True, False))
    assert with_gate == without and len(with_gate) > 300


def test_every_body_needs_its_phrase():
    for label, phrase, pattern in licenses.BODIES:
        assert re.compile(pattern) and phrase == re.sub(r"\s+", " ", phrase), label


#: Forms of real files, and all their labels.
FORMS = {
    "SPDX-License-Identifier: MIT OR Apache-2.0": "apache-2.0,mit",
    "// SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0)\nint main": "gpl-2.0",
    "SPDX-License-Identifier: (LGPL-2.1-or-later AND (BSD-3-Clause OR MPL-2.0+)).": "bsd-3-clause,lgpl-2.1,mpl-2.0",
    "SPDX-License-Identifier: MIT/Apache-2.0": "apache-2.0,mit",
    "SPDX-License-Identifier: LicenseRef-own": "",
    "This file is licensed under Apache-2.0": "apache-2.0",
    "Dual-licensed under GPLv2 and MIT": "gpl-2.0,mit",
    "licensed under the GPLv3": "gpl-3.0",
    "released under either the LGPL v2.1, MPL 2.0 or BSD-2-Clause license.": "bsd-2-clause,lgpl-2.1,mpl-2.0",
    "published under ISCO rules, provided under mitigation": "",
    " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n"
    " * are met:\n * 1. Redistributions of source code": "bsd-2-clause",
    "# This is free and unencumbered software\n# released into the public domain.": "unlicense",
    "/*\n** Permission to use, copy, modify, and/or distribute this software for any\n** purpose with or without fee is hereby granted.\n*/": "0bsd",
    "This product includes software developed by the\n;; Apache Software Foundation (http://www.apache.org/).": "apache-1.1",
    "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). b Secondary License c": "epl-2.0",
}


def test_forms_of_real_files(spark):
    docs = spark.createDataFrame(list(enumerate(FORMS)), "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan(docs).collect()} == dict(enumerate(FORMS.values()))


def test_every_body_opens_the_gate():
    opened = ("licens", "licenc", *licenses.BODY_WORDS)
    for label, phrase, pattern in licenses.BODIES:
        assert any(word in phrase or word in pattern for word in opened), label


def plain_scan(text):
    """(labels, matches, matches that stay) by a search with every rule and comparison of all pairs."""
    line = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    line = regex.sub(r"\s+", " ", regex.sub(licenses._COMMENT, "\n", line, flags=regex.ASCII), flags=regex.ASCII)
    found = []
    for rule, priority, keyword, pattern, label in licenses.rules():
        if keyword in line:
            for m in regex.finditer(pattern, line, flags=regex.ASCII):
                found.append((priority, m.start(), m.end(), rule, label, m.group()))
    kept = [
        a
        for a in found
        if not any(
            b is not a and b[1] <= a[1] and a[2] <= b[2] and b[0] >= a[0] and (b[0] > a[0] or (b[1], b[2]) != (a[1], a[2]) or b[3] < a[3])
            for b in found
        )
    ]
    labels = set()
    for *_, label, matched in kept:
        if label == licenses.EXPRESSION:
            names = regex.split(r" (?:and|or) | ?/ ?", regex.sub(r"[()]", "", matched.removeprefix(licenses._SPDX).removeprefix(" ")))
            tags = {regex.sub(r"(?: with .*|-only|-or-later|\+|\.)+$", "", n) for n in names}
            labels |= tags & {name for name, *_ in licenses.FAMILIES}
        elif label == licenses.SHORT_LIST:
            labels |= {name for name, short in licenses.SHORT_NAMES if regex.search(rf"(?<![\w.-])(?:{short})(?!\w)(?!\.\d)", matched, flags=regex.ASCII)}
        else:
            labels.add(label)
    return labels, len(found), len(kept)


def test_suppression_by_brute_force(spark, folder):
    """Labels, matches and those that stay, over all documents and pieces of license texts put together."""
    pick = random.Random(4)
    pieces = [*TEXTS, *FORMS, *[f"released under the {n} license" for n in ("mit", "zlib", "gnu general public license version 3")], "[mit]", "'isc'", "x"]
    pieces = [p for p in pieces if len(p) < 4000]
    mixed = [" ".join(pick.choice(pieces) for _ in range(pick.randint(1, 6))) for _ in range(150)]
    extra = spark.createDataFrame([(t,) for t in mixed], "text string")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("text").union(extra).distinct()
    docs = docs.withColumn("doc_id", F.xxhash64("text")).coalesce(4)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        labels, found, kept = plain_scan(texts[r.doc_id])
        base = set(filter(None, r.base_labels.split(",")))
        assert (set(filter(None, r.labels.split(","))), r.n_found, r.n_kept) == (labels | base, found, kept), texts[r.doc_id][:300]
