"""Licence scans against a plain version, and over forms of the same text."""

import random
import re

from quire.llm import licences

SCHEMA = "doc_id long, text string"


def plain_scan(text):
    """(licences, sentence ids) by the stated rules, without columns."""
    known = {licences.normalised(s): name for name, s in licences.SENTENCES.items()}
    hits = set()
    wrapped = r"([.!?])[ \t\r\n]+|(:)[ \t\r]*\n|\n[ \t\r]*\n"
    for cut in (text, re.sub(r";[ \t\r]*\n", ";\n\n", text)):
        hits |= _hits(re.sub(wrapped, lambda m: (m[1] or "") + (m[2] or "") + "\1", cut).split("\1"), known)
    hits |= _hits(re.sub(r"([.!?])[ \t\r]+|\n", lambda m: (m[1] or "") + "\1", text).split("\1"), known)
    ids = [name for _, name in sorted(hits)]
    met = set()
    for licence, rule in licences.RULES:
        rest = iter(ids)
        if all(any(x == want for x in rest) for want in rule):
            if licence == "BSD-2-Clause" and "bsd-binary" in rule and ids.count("bsd-binary") <= ids.count("bsd-endorse"):
                continue
            met.add(licence)
    return sorted(met), ids


def _hits(parts, known):
    at, found = 0, set()
    for part in map(licences.normalised, parts):
        if part in known:
            found.add((at, known[part]))
        at += len(part.replace(" ", ""))
    return found


def _scan(spark, texts):
    rows = licences.scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    return {r.doc_id: (r.licence.licences, r.licence.sentence_ids) for r in rows}


def test_forms_of_a_sentence_are_one_sentence(spark):
    forms = [lambda s: s, lambda s: s.replace(" ", "\n"), lambda s: s.replace(" ", "  "), lambda s: s.replace(" ", " \t\r\n "), lambda s: s.upper(), lambda s: f"Before it.\n\n{s}\n\nAfter it."]
    names = list(licences.SENTENCES)
    texts = [form(licences.SENTENCES[n].rstrip(".")) + "." for n in names for form in forms]
    # a full stop or colon inside a sentence ends it where white space follows, in any form but the first
    whole = {n for n in names if not re.search(r"[.!?:;] ", licences.SENTENCES[n])}
    found = _scan(spark, texts)
    for k, n in enumerate(names):
        own = [found[k * len(forms) + f] for f in range(len(forms))]
        assert n in own[0][1]
        if n in whole:
            assert all(o[1] == own[0][1] and o[0] == own[0][0] for o in own), (n, own)


def test_scan_against_the_plain_version(spark):
    rng = random.Random(6)
    names = list(licences.SENTENCES)
    multi = [r for _, r in licences.RULES if len(r) > 1]
    texts = []
    for _ in range(400):
        picked = []
        for _ in range(rng.randrange(5)):
            picked += rng.choice(multi) if rng.random() < 0.5 else [rng.choice(names)]
        parts = [licences.SENTENCES[n] for n in picked] + ["A plain sentence here"] * rng.randrange(3)
        if rng.random() < 0.3:
            rng.shuffle(parts)
        parts = [p.replace(" ", "\n") if rng.random() < 0.2 else p for p in parts]
        texts.append("".join(p + rng.choice([". ", ".\n", "\n\n", ";\n", ":\n", "\n", " "]) for p in parts))
    found = _scan(spark, texts)
    for k, t in enumerate(texts):
        assert found[k] == plain_scan(t), t
    assert sum(bool(f[0]) for f in found.values()) > 200


def test_two_licences_stay_two(spark):
    two = [licences.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary")]
    three = [*two, licences.SENTENCES["bsd-endorse"]]
    spdx = "SPDX-License-Identifier: BSD-2-Clause\nSPDX-License-Identifier: BSD-3-Clause\n"
    found = _scan(spark, [spdx, ". ".join(two + three) + ".", ". ".join(three + two) + ".", ". ".join(three + three) + ".", "SPDX-License-Identifier: GPL-3.0-or-later", "All rights\nreserved.", "released into the public\n domain."])
    both = ["BSD-2-Clause", "BSD-3-Clause"]
    assert [found[k][0] for k in range(5)] == [both, both, both, ["BSD-3-Clause"], ["GPL-3.0"]]
    assert found[5][0] == ["Proprietary"]


def test_clashing_names_and_repeats(spark):
    rows = [(1, "Licensed under the MIT License", "a"), (1, "Licensed under the MIT License", "a"), (None, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumnRenamed("ids", "ids")
    done = licences.scan(docs.selectExpr("*", "ids as ids_", "1 as __ids", "2 as licence"))
    assert done.columns == ["doc_id", "text", "ids", "ids_", "__ids", "licence"]
    assert sorted((r.ids, r.ids_, r["__ids"], tuple(r.licence.licences)) for r in done.collect()) == [("a", "a", 1, ("MIT",)), ("a", "a", 1, ("MIT",)), ("b", "b", 1, ())]
