import random
import re

from quire.llm.licence_rules import RULES, WEIGHT
from quire.llm.licenses import BASE, scan_licences


def brute(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(i, label) for p, label in BASE.items() for i in range(len(words))
              if words[i:i + len(p.split())] == p.split()]
    base = sorted({label for _, label in places})
    line = " " + " ".join(words) + " "
    hits = []
    for r in RULES:
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", line):
            start = line.count(" ", 0, m.start()) - 1
            hits.append((start, start + m.group().count(" ") + 1, r.tier, r.number, r.label))
    kept = [h for h in hits if not any(
        g is not h and g[0] <= h[0] and g[1] >= h[1] and g[2] <= h[2]
        and (g[0], -g[1], g[2], g[3]) < (h[0], -h[1], h[2], h[3]) for g in hits)]
    kept.sort(key=lambda h: (h[0], -h[1], h[2], h[3]))
    missed = 1.0
    for h in kept:
        missed *= 1 - WEIGHT[h[2]]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base),
            ",".join(sorted(set(base) | {h[4] for h in kept})), round(1 - missed, 9), kept)


def test_rules_are_many_and_gated():
    assert len(RULES) > 200
    assert sorted(r.tier for r in RULES) == [r.tier for r in RULES]


def test_scan_equals_brute_force(spark):
    rng = random.Random(2)
    notices = [
        "Licensed under the Apache License, Version 2.0 (the \"License\")", "SPDX-License-Identifier: GPL-2.0-or-later",
        "released under the MIT License.", "All Rights Reserved", "cc by cc by", "CC-BY-NC-SA 4.0", "General Public License",
        "GNU General Public License as published by the Free Software Foundation, either version 3", "Copyright (c) 2020 by X",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "http://creativecommons.org/licenses/by-sa/4.0/", "the 3-clause BSD license", "all rights reserved all rights reserved",
        "this is provided AS IS", "Tous droits réservés", "some public domain dedication", "cc bye", "occ by", "cc\tby."]
    rows = [(i, " ".join(rng.choice(notices + ["word", "Été", "x1", "--", "submit"]) for _ in range(rng.randint(1, 25))), 1)
            for i in range(150)]
    rows += [(200, None, 1), (201, "", 1), (202, " ,.- ", 1), (None, "cc by", 1), (0, rows[0][1], 1), (203, "cc by " * 3000, 1),
             (204, "A" * 500000 + " all rights reserved", 1), (205, "cc by", 1), (206, "KC by cc by\u0085x  y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels int")
    frame = scan_licences(docs)
    assert not re.search("Python|Arrow|Exchange", frame._jdf.queryExecution().executedPlan().toString())
    by_text: dict = {}
    for i, t, _ in rows:
        by_text[i] = brute(t)
    got = frame.collect()
    assert len(got) == len(rows)
    for r in got:
        mine = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9),
                [(d.start, d.end, d.tier, d.number, d.label) for d in r.detections])
        assert mine == by_text[r.doc_id], (r.doc_id, rows[r.doc_id or 0][1][:300])
    assert scan_licences(docs.filter("false")).count() == 0


def samples(parsed):
    """Texts an expression matches: every alternative, with and without each optional part."""
    texts = [""]
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            some = [chr(value)]
        elif name == "IN":
            some = sorted({chr(v) if str(k) == "LITERAL" else chr(v[0]) for k, v in value})
        elif name == "SUBPATTERN":
            some = samples(value[3])
        elif name == "BRANCH":
            some = [t for branch in value[1] for t in samples(branch)]
        else:
            assert name in ("MAX_REPEAT", "MIN_REPEAT"), name
            least, most, part = value
            some = [t * n for n in {least, min(least + 1, int(most))} for t in samples(part)]
        texts = [a + b for a in texts for b in dict.fromkeys(some)]
    return texts


def test_every_match_opens_its_gate():
    closed = []
    for r in RULES:
        texts = samples(re._parser.parse(r.pattern))
        assert texts and all(re.fullmatch(r.pattern, t) for t in texts), r
        closed += [(r.number, r.keyword, t) for t in texts if r.keyword not in f" {t} "]
    assert closed == []


def test_matches_without_the_usual_keyword(spark):
    texts = ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", "THE BEER-WARE LICENSE (Revision 42)",
             "The Software shall be used for Good, not Evil", "PSF License", "for research use only",
             "may not be reproduced or distributed without prior written permission", "subject to the following terms"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in scan_licences(docs).collect():
        mine = [(d.start, d.end, d.tier, d.number, d.label) for d in r.detections]
        assert mine and mine == brute(texts[r.doc_id])[7]
